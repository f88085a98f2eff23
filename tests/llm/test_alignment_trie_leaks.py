"""Token alignment, conversation trie and decontamination against brute force, and on rows that must not break them."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import conversation_trie, decontaminate, token_alignment
from tidemark.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, part long, id long, key string, n_hit string"
EMPTY = hashlib.sha256(b"").hexdigest()


def docs(spark, rows):
    return spark.createDataFrame([(i, t, -1, -2, "k", "h") for i, t in rows], DOCS)


# token alignment


def aligned(texts):
    """The contract, by whole texts and plain loops."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a_bpe = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a_bpe.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}

    def b_bytes(i):
        p = pieces.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()

    rows, total = [], Counter()
    for text in texts:
        if not text:
            rows.append(None)
            continue
        got = a_bpe.encode(" " + text, add_special_tokens=False)
        a = list(zip(got.ids, (bytes(letter[c] for c in t) for t in got.tokens), strict=True))
        b = [(i, b_bytes(i)) for i in pieces.encode(text)]
        whole = (" " + text).encode()
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            rows.append(None)
            continue
        ends = []
        for side in (a, b):
            at, own = 0, []
            for _, x in side:
                at += len(x)
                own.append(at)
            ends.append(own)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, at = [], [0, 0]
        for cut in cuts:
            to = [own.index(cut, k) + 1 for own, k in zip(ends, at, strict=True)]
            groups.append([[i for i, _ in side[k:t]] for side, k, t in zip((a, b), at, to, strict=True)])
            at = to
        links = [(g[0][-1], g[1][-1]) for g in groups]
        total.update(links)
        rows.append((len(a), len(b), groups, links))
    top = defaultdict(int)
    for (_, y), n in total.items():
        top[y] = max(top[y], n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = r
        digest = hashlib.sha256(";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups).encode()).hexdigest()
        out.append((n_a, n_b, len(groups), len(links), sum(total[x] == top[x[1]] for x in links), sum(total[x] for x in links), digest))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_equals_brute_force(spark):
    rnd = random.Random(5)
    bits = ["the", "Ünder", "naïve", "日本語", "x1", "2024", ",", ".", "don't", "\n", "\t", "  ", "   ", "<s>", "<|endoftext|>", "😀", "antidisestablishmentarianism", "　", "<0x41>", " \n ", "½"]
    texts = ["".join(rnd.choice(bits) + rnd.choice(["", " "]) for _ in range(rnd.randint(1, 30))) for _ in range(300)]
    texts += [None, "", " ", "  ", "\n", "a", " a", "a ", "a▁b", "é", "same text here", "same text here", "word " * 20_000, "x" * 5_000, " " * 3_000 + "end <|endoftext|>"]
    got = token_alignment.align_tokenizers(docs(spark, list(enumerate(texts))).repartition(3))
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in got.collect()}
    assert [got[i] for i in range(len(texts))] == aligned(texts)


def test_alignment_of_given_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op11_token_alignment"](spark, sf).collect()}
    assert [got[r["doc_id"]] for r in rows] == aligned([r["text"] for r in rows])


def test_alignment_pairs_and_forgotten_units(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "KEPT_BYTES", 1)
    e = token_alignment.Encoder(token_alignment.default_path(), token_alignment.default_piece_path())
    for _ in range(3):
        n_a, n_b, groups, digests, links, *_ = token_alignment._block([b"one two", None, b"two \xff three", b"three"], e)
        assert [bool(d) for d in digests] == [True, False, False, True] and n_a.tolist()[1:3] == [0, 0]
    _, pairs = token_alignment.align_tokenizers(docs(spark, [(1, "one two"), (2, "two two")]), pairs=True)
    assert sorted(r["count"] for r in pairs.collect())[-1] == 3 and all(r["best"] for r in pairs.collect())


def test_alignment_of_invalid_bytes_and_ids(spark):
    bad = spark.sql("SELECT CAST(NULL AS LONG) AS doc_id, CAST(X'61FF62' AS STRING) AS text UNION ALL SELECT NULL, 'ab'")
    assert sorted((r["n_a"] > 0, r["groups_sha256"] != "") for r in token_alignment.align_tokenizers(bad).collect()) == [(False, False), (True, True)]
    assert token_alignment.align_tokenizers(docs(spark, [])).count() == 0


# conversation trie


def trie(turns):
    """Nodes by listing every prefix."""
    convs = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[c].append((turn is not None, turn or 0, tie, (role, text)))
    convs = {c: [x[3] for x in sorted(rows)] for c, rows in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = tuple(convs.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    nodes = set(members)
    out = []
    for p, cs in members.items():
        below = [q for q in nodes if q[: len(p)] == p]
        inner = {q[:-1] for q in nodes if q}
        ends = ",".join(map(str, sorted(c for c in cs if built[c] == p)))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), sum(len(q) == len(p) + 1 for q in below), sum(q not in inner for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def turn_rows(n=60, seed=3):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-20, 150), n):
        for t in range(rnd.choice([0, 1, 1, 2, 4, 9, 12])):
            rows.append((c, t, rnd.choice(["user", "assistant"][t % 2 : t % 2 + 1] * 5 + [None]), "hi" if t == 0 and rnd.random() < 0.6 else rnd.choice(["yes", "nö", "maybe", None, ""])))
    long = [(c, t, "user", f"turn {t}") for c in (200, 201, 205) for t in range(40)]
    return rows + long + [(205, None, "user", "before all"), (205, None, None, None), (None, 0, "user", "lost"), (201, 5, "user", "turn 5"), (201, 5, "user", "turn 5")]


@pytest.mark.parametrize("local", [1, 12, 1 << 15])
def test_trie_equals_brute_force(spark, local, monkeypatch):
    monkeypatch.setattr(conversation_trie, "CHUNK_BITS", 2)
    rows = turn_rows()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, bucket string, depth int")
    got = conversation_trie.conversation_trie(table, local_turns=local)
    assert sorted(map(tuple, got.collect()), key=str) == trie(rows)


def test_trie_of_copies_and_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(c, t, "user", f"t{t}") for c in range(0, 500, 5) for t in range(9)]
    got = conversation_trie.conversation_trie(spark.createDataFrame(rows, schema), local_turns=2)
    assert sorted(map(tuple, got.collect()), key=str) == trie(rows)
    assert conversation_trie.conversation_trie(spark.createDataFrame([], schema)).count() == 0
    assert conversation_trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], schema)).count() == 0


def test_deep_trie_needs_no_recursion():
    rows = [(list(range(5000)), [1] * 5000, 1, 1, "x"), (list(range(4000)), [1] * 4000, 2, 3, "y")]
    nodes = conversation_trie.grow(rows, 1, 0)
    assert len(nodes) == 5000 and nodes[0][4:7] == [1, 1, 3 * 4000] and nodes[3999][7] == "y"


# decontamination

ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def item_words(text):
    return ITEM_WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def leaks(documents, items):
    windows = defaultdict(set)
    for i, text in items:
        w = item_words(text)
        for k in range(max(len(w) - 9, 1) if w else 0):
            windows[tuple(w[k : k + 10])].add(i)
    out = []
    for i, text in documents:
        w, hit, found = item_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k : k + n]))
                if own:
                    hit |= set(range(k, k + n))
                    found |= own
        found = sorted(str(x) for x in found - {None})
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(9)
    vocabulary = ["a", "b", "Été", "10", "x1", "日本", "c"]
    text = lambda n: rnd.choice([" ", ", ", "\n"]).join(rnd.choice(vocabulary) for _ in range(n))
    long = [" ".join(f"w{rnd.randint(0, 40)}" for _ in range(30)) for _ in range(12)]
    items = [(10 + k, t) for k, t in enumerate(long)] + [(30, "five Words are ENOUGH here"), (31, "one"), (32, "seven words are in this short item"), (2, long[0]), (None, "ten words of an item that has no id whatsoever"), (33, None), (34, "..."), (40, long[3]), (40, long[4])]
    documents = [(k, text(rnd.randint(0, 40))) for k in range(60)]
    for k in range(60):
        source = rnd.choice(long).split()
        at, n = rnd.randint(0, 15), rnd.randint(7, 15)
        documents.append((100 + k, f"{text(6)} {'-'.join(source[at : at + n])} {text(4)}"))
    documents += [(300, None), (301, ""), (302, "ONE"), (302, "ONE"), (None, long[0]), (303, "say: five words are enough here, seven words are in this short item"), (304, " ".join(long)), (305, "ten words of an item that has no id whatsoever"), (306, ("filler " * 20_000) + long[5])]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit("w"))
    got = decontaminate.decontaminate(docs(spark, documents), table)
    assert sorted(map(tuple, got.collect()), key=str) == leaks(documents, items)


def test_leaks_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.decontaminate(docs(spark, [(1, "a b c"), (2, None)]), none)
    assert sorted(map(tuple, got.collect())) == [(1, 3, 0, 0, EMPTY, False), (2, 0, 0, 0, EMPTY, False)]
    assert decontaminate.decontaminate(docs(spark, []), none).count() == 0


def test_leaks_use_no_python_workers(spark, sf):
    plan = QUERIES["op13_winnowing"](spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", ["op12_conversation_trie", "op13_winnowing"])
def test_same_rows_as_sql(spark, sf, name):
    from compare import connect, same

    assert same(QUERIES[name](spark, sf), connect(sf), ORACLE_SQL[name]) > 0


def test_schemas(spark, sf):
    assert isinstance(QUERIES["op11_token_alignment"](spark, sf).schema["n_a"].dataType, T.LongType)
