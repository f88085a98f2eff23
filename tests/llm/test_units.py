"""Parts of the operators that need no Spark."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import crf_language, isolation_rules, license_scan, minhash_forest, packing, phrase_automata, template_extract
from tidemark.llm.projection_passes import passes_for
from tidemark.llm.tokens import default_path, vocabulary
from tidemark.llm.words import blocks, run_hash, text_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", " ", "a", " a  b ", "a\x0bb\x0cc", "é x", "\n\n", "日本 語", "x" * 5000, "a b\r\nc", "\x1c y \x85 z"]


def test_words_of_a_block():
    texts = ODD * 3
    got = []
    for block in blocks(pa.array(texts), limit=64):
        starts, ends, bounds = block.words()
        words = [block.data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
        got += [words[a:b] for a, b in zip(bounds, bounds[1:])]
    assert got == [WORD.findall(t) for t in texts]


def test_hashes_do_not_depend_on_place():
    a, b = (next(blocks(pa.array([t]))) for t in ("one two three four", "x one two three four"))
    ha, hb = (block.hashes(*block.words()[:2]) for block in (a, b))
    assert (ha == hb[1:]).all() and (run_hash(ha, 3) == run_hash(hb, 3)[1:]).all() and len(set(ha.tolist())) == 4


def test_sliced_and_null_columns():
    data, offsets = text_bytes(pa.array(["ab", None, "c", "d"]).slice(1, 2))
    assert data.tobytes() == b"c" and offsets.tolist() == [0, 0, 1]


@pytest.mark.parametrize("text", [*ODD, " the  cat<|endoftext|> sat ", "it's 12 o'clock!\n\n  Ok", "　 the  end"])
def test_token_ids_are_the_librarys(text):
    from tokenizers import Tokenizer

    v, t = vocabulary(default_path()), Tokenizer.from_file(default_path())
    ids = t.encode(text, add_special_tokens=False).ids
    assert v.ids(text.encode()).tolist() == ids and v.count(text.encode()) == len(ids)


N = 10**6
END = "<|endoftext|>"
LONG = {
    "spaces": " " * N,
    "line feeds": "\n" * N,
    "tabs": "\t" * N,
    "mixed": "\n \t " * (N // 4),
    "wide": " \u3000\xa0" * (N // 3) + "y",
    "words around": "word" + " " * N + "next one" + "\n" * N + "x",
    "special tokens around": "a" + " " * N + END + "\n" * 50_000 + END + END + " " * 50_000,
    "at the bound": (" " * 32768 + "w ") * 3 + " " * 32767 + "e",
    "letters": "a" * N,
}


@pytest.mark.parametrize("text", LONG.values(), ids=LONG)
def test_long_runs_are_the_librarys(text):
    from tokenizers import Tokenizer

    v, t = vocabulary(default_path()), Tokenizer.from_file(default_path())
    ids = t.encode(text, add_special_tokens=False).ids
    assert v.ids(text.encode()).tolist() == ids and v.count(text.encode()) == len(ids)


def test_whole_tokens_are_one_token():
    from tokenizers import Tokenizer

    v, t = vocabulary(default_path()), Tokenizer.from_file(default_path())
    some = random.Random(0).sample(sorted(v.whole), 500)
    assert all(len(e.ids) == 1 for e in t.encode_batch([" " + s.decode() for s in some], add_special_tokens=False))


@pytest.mark.parametrize("sizes", [[], [1], [2048], [2049, 1, 1], [5000, 10, 300, 700, 1500] * 20, [257] * 100])
def test_packing_round_trip(sizes):
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 50_000, n).astype(np.uint32) for n in sizes]
    packer = packing.Packer(3)
    for k, ids in enumerate(docs):
        packer.add(k, ids)
    packer.finish()
    rows = packer.take()
    filled, cover = collections.Counter(), collections.defaultdict(int)
    for doc, start, n, crc, total, seq, offset, tier, _ in sorted(rows, key=lambda r: (r[5], r[6])):
        assert offset == filled[seq] and total == len(docs[doc]) and n > 0
        assert crc == zlib.crc32(docs[doc][start : start + n].astype("<u4").tobytes())
        filled[seq] += n
        assert filled[seq] <= tier <= 2048
    for doc, start, n, *_ in sorted(rows):
        assert start == cover[doc]
        cover[doc] += n
    assert [cover[k] for k in range(len(docs))] == sizes
    assert sum(n for n in filled.values() if n & (n - 1)) < 256
    per_step = collections.Counter()
    for _, _, _, _, _, seq, offset, tier, step in rows:
        per_step[step] += tier * (offset == 0)
    assert all(n <= packing.STEP for n in per_step.values())


def test_step_groups_are_balanced():
    packer, r = packing.Packer(0), random.Random(2)
    for k in range(3000):
        packer.add(k, np.zeros(int(r.paretovariate(1) * 60), dtype=np.uint32))
    packer.finish()
    rows, size, cost = packer.take(), collections.Counter(), collections.Counter()
    for _, _, n, _, _, _, _, tier, step in rows:
        size[tier, step] += n
        cost[tier, step] += n * n
    for tier in packing.TIERS:
        full = [cost[k] for k, n in size.items() if k[0] == tier and n == packing.STEP]
        assert len(full) < 4 or min(full[:4]) >= 0.9 * max(full[:4])
        assert sum(n == packing.STEP for k, n in size.items() if k[0] == tier) >= len([1 for k in size if k[0] == tier]) - packing.LANES


def brute_removed(texts, window):
    words = [t.split() for t in texts]
    count = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append(gone)
    return out


def test_shard_finds_every_window():
    r = random.Random(1)
    passage = [f"p{i}".encode() for i in range(100)]
    shard = phrase_automata.Shard()
    shard.add(b" ".join(passage))
    for a, b in ((0, 100), (0, 35), (65, 100), (30, 66), (10, 44), (3, 90)):
        noise = [f"n{r.random()}".encode() for _ in range(20)]
        words = noise[:10] + passage[a:b] + noise[10:]
        gone = shard.removed(b" ".join(words), words)
        expected = np.zeros(len(words), dtype=bool)
        if b - a >= 35:
            expected[10 : 10 + b - a] = True
        assert (gone == expected).all()


def test_isolation_counts_equal_brute_force():
    r = random.Random(4)
    texts = [*ODD, "a b c a b c\nx\n x\nx\n\nx", *["\n".join(" ".join(r.choice("abc#|") for _ in range(r.randrange(9))) for _ in range(r.randrange(9))) for _ in range(200)]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts).cast(pa.binary())], names=["id", "text"])
    out = next(isolation_rules._count([batch])).to_pylist()
    for text, row in zip(texts, out):
        words = WORD.findall(text)
        grams = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        cover = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        assert (row["n_words"], row["word_chars"], row["n_dup_lines"], row["n_repeat_words"]) == (len(words), sum(map(len, words)), dup, len(cover))
        assert row["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text)) and row["n_distinct_words"] == len(set(words))


def test_isolation_forest_finds_outliers():
    rng = np.random.default_rng(0)
    x = np.vstack((rng.normal(0, 1, (2000, 3)), rng.normal(9, 1, (40, 3))))
    forest = isolation_rules.IsolationForest(x, rows=64)
    s = forest.score(x)
    limit = isolation_rules.threshold(s, np.arange(len(x)) < 2000)
    assert (s[2000:] >= limit).mean() > 0.95 and (s[:2000] >= limit).mean() < 0.01


def test_crf_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    e, start, move = rng.normal(size=(1, 5, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    for n in (1, 3, 5):
        post = crf_language._forward_backward(e, np.array([n]), start, move)[0, :n]
        total = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            w = math.exp(start[path[0]] + sum(e[0, i, y] for i, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
            total[np.arange(n), path] += w
        assert np.allclose(post, total / total.sum(axis=1, keepdims=True))


def test_crf_labels_switched_text():
    en, de = "the house and the garden with water", "das haus und der garten mit wasser"
    r = random.Random(0)
    texts = [" ".join(r.choices(s.split(), k=60)).encode() for s in (en, de) for _ in range(30)]
    model = crf_language.fit(texts, ["en"] * 30 + ["de"] * 30)
    mean, counts = model.label(next(blocks(pa.array([(en + " ") * 10 + (de + " ") * 5, "das", ""]))))
    assert model.languages == ["de", "en"] and counts[0].tolist() == [35, 70] and mean[1].argmax() == 0 and mean[2].sum() == 0


def test_minhash_estimates_similarity():
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    other = list(words)
    for i in r.sample(range(400), 12):
        other[i] = "z"
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([" ".join(words).upper(), " ".join(other), ""]).cast(pa.binary())], names=["id", "text"])
    out = next(minhash_forest._signatures([batch])).to_pylist()
    a, b = (np.frombuffer(o["signature"], dtype=">u4") for o in out[:2])
    sets = [{tuple(w[i : i + 5]) for i in range(396)} for w in (words, other)]
    true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert abs((a == b).mean() - true) < 0.2 and out[0]["n"] == 396 and out[2]["signature"] is None


def test_passes_grow_slowly():
    assert [passes_for(n) for n in (0, 1, 24)] == [1, 1, 1]
    assert 10 < passes_for(50_000) < 20 < passes_for(10**9) < 100


MIT = """/* The MIT License (MIT)
 *
 * Copyright (c) 2019 Jane Doe
 *
 * The above copyright notice and this permission notice shall be included in
 * all copies or substantial portions of the Software.
 */"""


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("some words\nReleased under the MIT License.", ["MIT"]),
        ("x. Licensed under the Apache Licence,\nVersion 2.0.\nThis work is licensed under the GNU General Public License, version 3.", ["Apache-2.0", "GPL-3.0"]),
        (MIT, ["MIT", "MIT-fragment"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        ("A driving licence is needed. No permission was given.", []),
        ("", []),
    ],
)
def test_licences(text, found):
    names = [n for n, _, _ in license_scan.known_sentences(text)]
    assert [m[0] for m in license_scan.match_rules(names)] == found


def test_every_known_sentence_has_a_hint():
    for sentences in license_scan.SENTENCES.values():
        for s in sentences:
            assert any(h.decode() in w for h in license_scan.HINTS for w in s.split()), s


def brute_rules(names, gap=license_scan.GAP):
    """All ways to place each rule's sentences, by trying every choice of positions."""
    import itertools

    free, out = set(range(len(names))), []
    for licence, parts in license_scan.RULES:
        for first in range(len(names)):
            ways = []
            for at in itertools.product(*[[k for k in free if names[k] == p] for p in parts]):
                between = [k for a, b in zip(at, at[1:]) for k in range(a + 1, b)]
                near = all(0 < b - a <= gap + 1 for a, b in zip(at, at[1:]))
                if at[0] == first and near and free.issuperset(between):
                    ways.append(at)
            if ways:
                best = min(ways)
                out.append((licence, list(best)))
                free -= set(best)
    owner = {s: licence for licence, parts in reversed(license_scan.RULES) for s in parts}
    out += [(f"{owner[names[k]]}-fragment", [k]) for k in free if names[k] in owner]
    return sorted(out, key=lambda x: x[1][0])


def test_rules_equal_exhaustive_search():
    r = random.Random(6)
    for _ in range(400):
        rules = r.sample(license_scan.RULES, 2)
        pool = [p for _, parts in rules for p in parts] + ["copyright", "gpl.see"]
        names = [p for _, parts in rules for p in parts] if r.random() < 0.5 else []
        for _ in range(r.randrange(5)):
            names.insert(r.randrange(len(names) + 1), r.choice(pool))
        assert license_scan.match_rules(names) == brute_rules(names), names


def written(r, sentence):
    """A known sentence as a file may have it: filled in, wrapped anywhere, with capitals, marks and punctuation."""
    words = [w for part in sentence.split() for w in (["some", "name", "here"][: r.randrange(1, 4)] if part == "*" else [part.replace("*", "999") + "," * (r.random() < 0.1 and part[-1:].isalpha())])]
    mark, out = r.choice(("", "// ", " * ", "# ")), ""
    for k, w in enumerate(words):
        w = w.title() if r.random() < 0.2 else w
        out += w if not k else (f"\n{mark}{w}" if r.random() < r.choice((0.05, 0.6)) else f" {w}")
    return f"{mark}{out}."


def test_written_sentences_are_found():
    """Every known sentence, however it is wrapped, between sentences that are none: what was put in comes out."""
    r, filler = random.Random(8), ["A line of other words.", "Nothing to see in this one!", "The tree grows; it is old."]
    known = [(s, name) for name, all_ in license_scan.SENTENCES.items() for s in all_ if name != "spdx"]
    for s, _ in known:
        parts, expected = [], []
        for x in [s, *[k for k, _ in r.sample(known, 2)]]:
            parts += [r.choice(filler), written(r, x)]
            expected.append(license_scan.sentence_id(x.replace(" *", " some name").replace("* ", "some name ").replace("*", "999")))
        found = license_scan.known_sentences("\n\n".join(parts))
        assert [n for n, _, _ in found] == expected, parts


def test_sentences_over_many_lines():
    grant = license_scan.SENTENCES["mit.grant"][0]
    assert [n for n, _, _ in license_scan.known_sentences(grant.replace(" ", "\n") + ".")] == ["mit.grant"]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("SPDX-License-Identifier: MIT", ["MIT"]),
        ("# SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause */", ["MIT", "Apache-2.0", "BSD-3-Clause"]),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0\nMIT", ["GPL-2.0-only WITH Classpath-exception-2.0"]),
        ("SPDX-License-Identifier:", []),
    ],
)
def test_spdx_expressions(text, found):
    assert [n for n, _, _ in license_scan.spdx_ids(text)] == found


def test_threshold_of_counted_steps():
    rng = np.random.default_rng(1)
    scores, good = rng.integers(0, 50, 3000), rng.random(3000) < 0.8
    keys, counts = np.unique(np.column_stack((scores, good)), axis=0, return_counts=True)
    a = isolation_rules.threshold(scores, good, 0.3)
    assert a == isolation_rules.threshold(keys[:, 0], keys[:, 1] == 1, 0.3, counts)
    share = lambda t, k: (scores[k] >= t).mean()
    best = max((t for t in range(50) if share(t, good) <= 0.3), key=lambda t: share(t, ~good) - share(t, good))
    assert share(a, ~good) - share(a, good) == share(best, ~good) - share(best, good)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("just text", "just text"),
        ("<p>a<p>b &amp; c<br>d", "a\n\nb & c d"),
        ("<body><nav>menu</nav><div class='content'><h2>T</h2><p>one  two\n three</p><div class='ad-slot'>buy</div></div><footer>f</footer>", "T\n\none two three"),
        ("<header>h</header><article><h1>T</h1><p>x<script>var a='</p>'</script> y</p><section class='comments'><p>c</p></section></article>", "T\n\nx y"),
        ("<div id=cookie-notice>We use</div><main><p>a</p><form>f</form></main>", "a"),
        ("<article><p>a</article></div><p>b", "a"),
    ],
)
def test_main_text(page, text):
    assert template_extract.main_text(page) == text
