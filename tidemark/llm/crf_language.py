"""Language identification by a linear-chain conditional random field.

Words are runs of letters (ASCII letters and all bytes from 0x80 on, lower
case for A-Z). A word's features are itself (lexicon), its first one to three
and last one to four bytes (affixes) and its three-byte runs with the word's
bounds (n-grams), hashed into ``BUCKETS`` weights for each language. Learned
transitions tie neighbouring words together. A text is cut into chains of
``CHAIN`` words; forward-backward gives each word's language probabilities,
and their mean over the text is the text's score for each language.

Training sequences are spliced from two places, of the same or of two
documents, so that the transitions learn how languages are switched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import LOWER, Block, blocks, span_hash
from .words import _BYTE_CODE as BYTE_CODE

BUCKETS = 1 << 18
CHAIN = 48
#: Documents of each language that are read for training, at most, and the characters of one: longer
#: texts give FIT_WINDOWS windows spread over the whole text instead.
FIT_DOCS = 160
FIT_CHARS = 1 << 16
FIT_WINDOWS = 16
#: More distinct languages are an error: each costs 2 ** 18 weights.
MOST_LANGUAGES = 128
#: Chains whose posteriors are held at a time.
PART_CHAINS = 4096
EPOCHS = 12
SEED = 41

UNKNOWN = "und"

LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all features of the words data[start:end], and where each word's begin."""
    n, size = len(starts), ends - starts
    grams = np.maximum(size - 2, 0)
    each = 8 + grams
    first = np.concatenate(([0], np.cumsum(each)))[:-1]
    a, b = np.empty(int(each.sum()), dtype=np.int64), np.empty(int(each.sum()), dtype=np.int64)
    kind = np.full(len(a), 8, dtype=np.uint64)
    a[first], b[first], kind[first] = starts, ends, 0
    for k in range(1, 4):
        a[first + k], b[first + k], kind[first + k] = starts, np.minimum(starts + k, ends), k
    for k in range(1, 5):
        a[first + 3 + k], b[first + 3 + k], kind[first + 3 + k] = np.maximum(ends - k, starts), ends, 3 + k
    at = np.arange(int(grams.sum())) - np.repeat(np.concatenate(([0], np.cumsum(grams)))[:-1], grams)
    slot = np.repeat(first + 8, grams) + at
    a[slot] = np.repeat(starts, grams) + at
    b[slot] = a[slot] + 3
    code = span_hash(BYTE_CODE[data], a, b) ^ (kind * np.uint64(0x9E3779B97F4A7C15))
    return ((code * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), first


def _forward_backward(emission: np.ndarray, length: np.ndarray, start: np.ndarray, move: np.ndarray, pairs: bool = False):
    """Posteriors of chains (chain, word, language), and with pairs the expected number of each move."""
    n, steps, k = emission.shape
    e = np.exp(emission - emission.max(axis=2, keepdims=True))
    t = np.exp(move - move.max())
    alpha, beta = np.empty_like(e), np.ones_like(e)
    now = np.exp(start - start.max()) * e[:, 0]
    alpha[:, 0] = now / now.sum(axis=1, keepdims=True)
    for i in range(1, steps):
        now = (alpha[:, i - 1] @ t) * e[:, i]
        alpha[:, i] = now / now.sum(axis=1, keepdims=True)
    for i in range(steps - 2, -1, -1):
        now = (e[:, i + 1] * beta[:, i + 1]) @ t.T
        now /= now.sum(axis=1, keepdims=True)
        beta[:, i] = np.where((length > i + 1)[:, None], now, 1)
    post = alpha * beta
    post /= post.sum(axis=2, keepdims=True)
    if not pairs:
        return post
    expected = np.zeros((k, k))
    for i in range(1, steps):
        joint = alpha[:, i - 1, :, None] * t * (e[:, i] * beta[:, i])[:, None, :]
        expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return post, expected


def _compact(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words data[start:end] alone, one after another, with their starts and ends there."""
    stop = np.cumsum(ends - starts)
    start = np.concatenate(([0], stop))[:-1]
    return data[np.arange(stop[-1]) + np.repeat(starts - start, ends - starts)], start, stop


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    start: np.ndarray
    move: np.ndarray

    def emissions(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.empty((0, len(self.languages)), dtype=np.float32)
        bucket, first = _features(data, starts, ends)
        return np.add.reduceat(self.weights[bucket], first, axis=0)

    def label(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """For each text the mean probability of each language, and the number of words labelled with it."""
        k = len(self.languages)
        mean, counts = np.zeros((len(block), k)), np.zeros((len(block), k), dtype=np.int64)
        starts, ends, bounds = block.runs(LETTER)
        if not len(starts):
            return mean, counts
        lower = Block(0, LOWER[block.data], block.offsets)
        _, pick, back = np.unique(lower.hashes(starts, ends), return_index=True, return_inverse=True)
        words = self.emissions(*_compact(lower.data, starts[pick], ends[pick]))
        sizes = np.diff(bounds)
        chains = -(-sizes // CHAIN)
        text = np.repeat(np.arange(len(block)), chains)
        number = np.arange(len(text)) - np.repeat(np.concatenate(([0], np.cumsum(chains)))[:-1], chains)
        begin = bounds[text] + number * CHAIN
        length = np.minimum(bounds[text + 1] - begin, CHAIN)
        for at in range(0, len(text), PART_CHAINS):
            part = slice(at, at + PART_CHAINS)
            word = np.minimum(begin[part, None] + np.arange(CHAIN), len(starts) - 1)
            post = _forward_backward(words[back[word]], length[part], self.start, self.move)
            used = np.arange(CHAIN) < length[part, None]
            best = post.argmax(axis=2)
            for y in range(k):
                mean[:, y] += np.bincount(text[part], weights=(post[:, :, y] * used).sum(axis=1), minlength=len(block))
                counts[:, y] += np.bincount(text[part], weights=((best == y) & used).sum(axis=1), minlength=len(block)).astype(np.int64)
        return mean / np.maximum(sizes, 1)[:, None], counts


def fit(texts: list[bytes], labels: list[str], seed: int = SEED) -> Model | None:
    """A model of whole texts with their languages; None without any word."""
    languages = sorted(set(labels))
    rng, k, half = np.random.default_rng(seed), len(languages), CHAIN // 2
    block = next(blocks(pa.array(texts, pa.binary()), limit=1 << 62), None) if texts else None
    if block is None:
        return None
    starts, ends, bounds = block.runs(LETTER)
    if not len(starts):
        return None
    data = LOWER[block.data]
    _, pick, back = np.unique(span_hash(BYTE_CODE[data], starts, ends), return_index=True, return_inverse=True)
    bucket, first = _features(data, starts[pick], ends[pick])
    each = np.diff(np.append(first, len(bucket)))
    language = np.repeat(np.array([languages.index(y) for y in labels]), np.diff(bounds))
    # half chains of each text; a second one follows, half the time from any other place
    heads = np.concatenate([np.arange(a, b - half + 1, half) for a, b in zip(bounds, bounds[1:], strict=False) if b - a >= half] or [np.zeros(0, dtype=np.int64)])
    if not len(heads):
        heads, half = np.arange(len(starts)), 1
    other = np.where(rng.random(len(heads)) < 0.5, rng.permutation(heads), np.minimum(heads + half, len(starts) - half))
    chain = np.concatenate((heads[:, None] + np.arange(half), other[:, None] + np.arange(half)), axis=1)
    word, gold = back[chain], language[chain]
    one = np.eye(k)
    observed = np.zeros((k, k))
    np.add.at(observed, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    begun = one[gold[:, 0]].sum(axis=0)
    # starting point: how much more often a feature occurs in a language than its words let expect
    by_word = np.column_stack([np.bincount(back[language == y], minlength=len(pick)) for y in range(k)]).astype(np.float64)
    spread = np.repeat(np.arange(len(pick)), each)
    share = by_word.sum(axis=0) / by_word.sum()
    seen = np.column_stack([np.bincount(bucket, weights=by_word[spread, y], minlength=BUCKETS) for y in range(k)])
    weights = 0.1 * np.log((seen + 2 * share) / ((seen.sum(axis=1, keepdims=True) + 2) * share))
    used = np.flatnonzero(seen.sum(axis=1) > 0)
    dense = np.zeros(BUCKETS, dtype=np.int64)
    dense[used] = np.arange(len(used))
    slot, weights = dense[bucket], weights[used]
    start, move = np.log(share + 1e-3), np.log((observed + 1) / (observed.sum(axis=1, keepdims=True) + k))
    squares, length = np.full_like(weights, 1.0), np.full(len(chain), chain.shape[1])
    squares_start, squares_move = np.full(k, 1.0), np.full((k, k), 1.0)
    for _ in range(EPOCHS if k > 1 else 0):
        emission = np.add.reduceat(weights[slot], first, axis=0)
        post, expected = _forward_backward(emission[word], length, start, move, pairs=True)
        error = (one[gold] - post).reshape(-1, k)
        flat = word.ravel()
        by_word = np.column_stack([np.bincount(flat, weights=error[:, y], minlength=len(pick)) for y in range(k)])
        step = np.column_stack([np.bincount(slot, weights=by_word[spread, y], minlength=len(used)) for y in range(k)]) - 0.01 * weights
        squares += step**2
        weights += 0.2 * step / np.sqrt(squares)
        step = begun - post[:, 0].sum(axis=0) - 0.01 * start
        squares_start += step**2
        start = start + 0.2 * step / np.sqrt(squares_start)
        step = observed - expected - 0.01 * move
        squares_move += step**2
        move = move + 0.2 * step / np.sqrt(squares_move)
    full = np.zeros((BUCKETS, k), dtype=np.float32)
    full[used] = weights
    return Model(languages, full, start, move)


def _predict(shared, text_field: str | None):
    """Predictions of the text column, or of the field of row that holds the text."""

    def run(batches):
        model: Model = shared.value
        names = model.languages
        for batch in batches:
            lang, score = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows)
            counts = np.zeros((batch.num_rows, len(names)), dtype=np.int64)
            for block in blocks(batch.column("row").field(text_field) if text_field else batch.column("text")):
                mean, own = model.label(block)
                at = slice(block.first, block.first + len(block))
                lang[at], score[at], counts[at] = mean.argmax(axis=1), mean.max(axis=1), own
            words = [[{"lang": names[y], "words": int(row[y])} for y in np.flatnonzero(row)] for row in counts]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("letters"), pa.array([names[y] for y in lang], pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(words, kind)], names=["row", "letters", "lang_pred", "score", "labelled"])

    return run


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the row is kept from training."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_sizes(usable: DataFrame) -> dict[str, int]:
    """Labelled rows of the MOST_LANGUAGES languages that have most of them; ties go by code point."""
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES)
    return {r["lang"]: r["count"] for r in counts.collect()}


def draw_below(n: int) -> int:
    """The limit that some 2 * FIT_DOCS of n draws of 63 bits lie below, or all."""
    return min((1 << 63) - 1, (1 << 64) * FIT_DOCS // n)


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[list[bytes], list[str]]:
    """FIT_DOCS texts of each language, or all there are, chosen by a hash of id and text; of long ones, windows of FIT_CHARS in all."""
    usable = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    usable = usable.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = language_sizes(usable)
    if not sizes:
        return [], []
    # twice as many pass the hash as are wanted, so that the ranks below have few rows to sort
    share = F.lit(0).cast("long")
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(draw_below(n))).otherwise(share)
    usable = usable.withColumn("draw", F.xxhash64("id", "text", F.lit(SEED))).filter(F.shiftrightunsigned("draw", 1) < share)
    size, part = F.length("text"), FIT_CHARS // FIT_WINDOWS
    windows = F.transform(F.sequence(F.lit(0), F.lit(FIT_WINDOWS - 1)), lambda i: F.substring("text", (i * (size - part) / (FIT_WINDOWS - 1)).cast("int") + 1, F.lit(part)))
    usable = usable.withColumn("text", F.when(size > FIT_CHARS, F.array_join(windows, " ")).otherwise(F.col("text")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id", "text"))
    rows = usable.withColumn("rank", rank).filter(F.col("rank") <= FIT_DOCS).orderBy("lang", "rank").select(F.col("text").cast("binary").alias("text"), "lang").collect()
    return [bytes(r["text"]) for r in rows], [r["lang"] for r in rows]


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: bool = False) -> DataFrame:
    """All columns of docs but text and language (these too with keep), with lang_pred, score and labelled (words by language).

    Learns from rows that are not held out and have a text and a language: a
    bounded sample of FIT_DOCS texts of each language, of at most FIT_CHARS
    characters each, taken from all over longer texts. A text that is null or
    has no letter gets ``und`` and score 0, as do all texts where nothing can be
    learnt. Texts of any length are read whole, in chains. Predictions see the
    text alone: equal texts and repeated rows get equal results; of languages
    with the same score the first by code point is taken. Null ids are ids like
    others. Columns named lang_pred, score or labelled, in any case, are
    replaced. An empty table gives an empty one. Of more than MOST_LANGUAGES
    distinct languages the most frequent ones are learnt.
    """
    spark = docs.sparkSession
    texts, labels = training_rows(docs, id_col, text_col, lang_col)
    model = fit(texts, labels)
    others = [c for c in docs.columns if (keep or c not in (text_col, lang_col)) and c.lower() not in ("lang_pred", "score", "labelled")]
    row = F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")
    letters = F.coalesce(F.col(f"`{text_col}`").rlike("\\p{L}"), F.lit(False)).alias("letters")
    rows = docs.select(row, letters, *([] if keep else [F.col(f"`{text_col}`").cast("binary").alias("text")]))
    labelled = "array<struct<lang: string, words: long>>"
    if model is None:
        out = rows.select("row", "letters", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.array().cast(labelled).alias("labelled"))
    else:
        out = rows.mapInArrow(_predict(spark.sparkContext.broadcast(model), text_col if keep else None), f"row {rows.schema['row'].dataType.simpleString()}, letters boolean, lang_pred string, score double, labelled {labelled}")
    return out.select(
        *[F.col(f"row.`{c}`").alias(c) for c in others],
        F.when(F.col("letters"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"),
        "labelled",
    )
