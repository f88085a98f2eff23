"""Quality rules with an isolation forest on their statistics.

Every document gets the counts behind common quality rules. Two of them reject
at once; for the rest an isolation forest judges the counts as rates: a
document that random splits separate early from a sample of all documents is
an anomaly. The forest is fitted on a bounded sample of the documents that the
rules pass, and its threshold is where all labelled ones are told apart best
while at most ``LOSS`` of the good rows fall: scores are counted in ``LEVELS``
steps, so that only these counts reach the driver. Repeated lines
and words are left to the rules: among the forest's rates they would set clean
short texts apart.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace
from .words import SPACE, blocks, full_runs, run_hash

TREES = 128
TREE_ROWS = 64
#: Documents that the forest is fitted on, at most.
FIT_ROWS = 8192
#: Steps of the scores, which lie between 0 and 1.
LEVELS = 10_000
#: Share of labelled good rows that the threshold may reject.
LOSS = 0.005
SEED = 29

#: The symbols that count.
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_distinct_words")


def _sum_over(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _earlier(keys: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key, whether its group has it more than once, and whether it is a repeat of an earlier one."""
    n = len(keys)
    again, later = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    if n > 1:
        order = np.lexsort((keys, group))
        k, g = keys[order], group[order]
        same = (k[1:] == k[:-1]) & (g[1:] == g[:-1])
        later[order[1:]] = same
        both = np.zeros(n, dtype=bool)
        both[1:] |= same
        both[:-1] |= same
        again[order] = both
    return again, later


def _count(batches):
    for batch in batches:
        out = np.zeros((batch.num_rows, len(COUNTS)), dtype=np.int64)
        for block in blocks(batch.column("text")):
            own = out[block.first : block.first + len(block)]
            data, offsets = block.data, block.offsets
            if not len(data):
                continue
            starts, ends, bounds = block.words()
            words = block.hashes(starts, ends)
            counts = np.diff(bounds)
            text = np.repeat(np.arange(len(block)), counts)
            own[:, 0] = counts
            space = SPACE[data]
            own[:, 1] = _sum_over(~space & ((data & 0xC0) != 0x80), offsets)
            own[:, 2] = _sum_over(_SYMBOL[data], offsets)
            own[:, 6] = _sum_over((data >= 65) & (data <= 90), offsets)
            # lines with a word, equal to an earlier one
            cut = np.unique(np.concatenate((np.flatnonzero(data == 10), offsets - 1)))
            cut = cut[cut >= 0]
            first = np.concatenate(([0], cut + 1))[: len(cut)]
            last = cut + (data[cut] != 10)
            inside = np.concatenate(([0], np.cumsum(~space)))
            used = inside[last] > inside[first]
            first, last = first[used], last[used]
            line_text = np.searchsorted(offsets, first, side="right") - 1
            _, later = _earlier(block.hashes(first, last), line_text)
            own[:, 3] = np.bincount(line_text[later], minlength=len(block))
            own[:, 5] = np.bincount(line_text, minlength=len(block))
            # words in three-word windows that the text has twice or more
            at, _ = full_runs(bounds, 3)
            covered = np.zeros(len(words) + 2, dtype=bool)
            again, _ = _earlier(run_hash(words, 3)[at], text[at])
            for k in range(3):
                covered[at[again] + k] = True
            own[:, 4] = _sum_over(covered[: len(words)], bounds)
            _, later = _earlier(words, text)
            own[:, 7] = counts - _sum_over(later, bounds)
        yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(out[:, k].copy()) for k in range(len(COUNTS))]], names=["id", *COUNTS])


def rule_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and COUNTS for each row of docs; a null text counts as empty."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_count, f"id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def rates(counts: np.ndarray) -> np.ndarray:
    """What the forest sees of rows of COUNTS."""
    n, chars, symbols, _, _, _, upper, distinct = counts.T.astype(np.float64)
    words, chars = np.maximum(n, 1), np.maximum(chars, 1)
    # vocabularies grow with a power of a text's length, so distinct words are compared on that scale
    variety = np.log1p(distinct) / np.log1p(words)
    return np.column_stack((chars / words, symbols / chars, upper / chars, variety))


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a random tree of n rows."""
    n = np.asarray(n, dtype=np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees as flat arrays: feature (-1 for a leaf), split, left child (the right one follows), leaf depth."""

    def __init__(self, x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.rows = min(rows, len(x))
        self.trees = [self._grow(x[rng.choice(len(x), self.rows, replace=False)], rng) for _ in range(trees)]

    def _grow(self, x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, split, left, depth = [-1], [0.0], [0], [0.0]
        todo, most = [(0, x, 0)], math.ceil(math.log2(max(self.rows, 2))) + 2
        while todo:
            node, own, d = todo.pop()
            spread = np.flatnonzero(own.max(axis=0) > own.min(axis=0)) if len(own) > 1 else ()
            if d >= most or not len(spread):
                depth[node] = d + float(_average_path(len(own)))
                continue
            f = int(rng.choice(spread))
            at = float(rng.uniform(own[:, f].min(), own[:, f].max()))
            feature[node], split[node], left[node] = f, at, len(feature)
            for k, part in enumerate((own[own[:, f] <= at], own[own[:, f] > at])):
                todo.append((len(feature), part, d + 1))
                feature.append(-1), split.append(0.0), left.append(0), depth.append(0.0)
        return np.array(feature), np.array(split), np.array(left), np.array(depth)

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1, high for rows that are separated early."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, split, left, depth in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                step = left[node] + (x[rows, np.maximum(f, 0)] > split[node])
                node = np.where(inner, step, node)
            total += depth[node]
        return 2.0 ** (-total / len(self.trees) / max(float(_average_path(self.rows)), 1e-9))


def threshold(scores: np.ndarray, good: np.ndarray, loss: float = LOSS, counts: np.ndarray | None = None) -> float:
    """The score from which rows are rejected: bad rows above less good rows above is greatest, and few good ones are.

    counts is the number of rows behind each score, 1 if it isn't given. Where
    all rows are of one kind, the share ``loss`` of them is rejected at most.
    """
    if not len(scores):
        return 2.0
    counts = np.ones(len(scores)) if counts is None else counts
    levels, at = np.unique(scores, return_inverse=True)
    above = [np.bincount(at[k], weights=counts[k], minlength=len(levels))[::-1].cumsum()[::-1] for k in (good, ~good)]
    if not above[0][0] or not above[1][0]:
        above[0] = above[1] = above[0] + above[1]
    good_above, bad_above = (x / x[0] for x in above)
    allowed = np.flatnonzero(good_above <= loss)
    if not len(allowed):
        return 2.0
    if above[0] is above[1]:
        return float(levels[allowed[0]])
    return float(levels[allowed[np.argmax((bad_above - good_above)[allowed])]])


def _rejects_at_once() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _judge(forest: IsolationForest):
    def run(batches):
        for batch in batches:
            counts = np.column_stack([batch.column(c).to_numpy() for c in COUNTS]) if batch.num_rows else np.zeros((0, len(COUNTS)), dtype=np.int64)
            scores = forest.score(rates(counts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "anomaly"])

    return run


def _sample(rows: DataFrame, most: int) -> np.ndarray:
    """COUNTS of at most so many rows, those with the least hash of id and counts."""
    n = rows.count()
    chosen = rows.withColumn("draw", F.xxhash64("id", *COUNTS, F.lit(SEED)))
    if n > 2 * most:  # so that few rows are ranked
        chosen = chosen.filter(F.pmod("draw", F.lit(1_000_000)) < int(2_000_000 * most / n) + 1)
    return chosen.orderBy("draw", *COUNTS).limit(most).select(*COUNTS).toPandas().to_numpy(dtype=np.int64)


def _limit(scored: DataFrame, labels: DataFrame, loss: float) -> int:
    """The step of the scores from which rows are rejected, by all labelled rows; without any, by all rows."""
    level = F.floor(F.col("anomaly") * LEVELS).cast("int").alias("level")
    for rows in (scored.join(labels, "id").select(level, "good"), scored.select(level, F.lit(1).alias("good"))):
        steps = rows.groupBy("level", (F.col("good") == 1).alias("good")).count().toPandas()
        if len(steps):
            break
    limit = threshold(steps["level"].to_numpy(), steps["good"].to_numpy(dtype=bool), loss, steps["count"].to_numpy(dtype=np.float64))
    return int(limit) if limit != 2.0 or 2 in set(steps["level"]) else LEVELS + 1


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", loss: float = LOSS) -> DataFrame:
    """One row for each row of docs: id, COUNTS, base_failed, anomaly, kept.

    Null and empty texts have no words and so fail. Texts are counted whole,
    however long. labels holds ids with a label, 1 for good; null ids and
    labels are not used, and of an id with several labels the least counts.
    Where no row passes the base rules, they alone decide; without labels the
    threshold is a quantile of the scores. Rows of equal counts get equal
    verdicts, repeated rows among them; a null id is judged like others. Other
    columns, whatever their names, are not read. An empty table gives an empty
    one.
    """
    work = Workspace(docs.sparkSession, "isolation-rules")
    counted = work.table(rule_counts(docs, id_col, text_col), "counts")
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("good")).dropna().groupBy("id").agg(F.min("good").alias("good"))
    base = _rejects_at_once()
    fit = _sample(counted.filter(~base), FIT_ROWS)
    if not len(fit):
        out = counted.withColumn("anomaly", F.lit(None).cast("double")).withColumn("normal", F.lit(True))
    else:
        kind = counted.schema["id"].dataType.simpleString()
        scored = counted.mapInArrow(_judge(IsolationForest(rates(fit))), f"id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", anomaly double")
        scored = work.table(scored, "scores")
        limit = _limit(scored.filter(~base), marked, loss)
        out = scored.withColumn("normal", F.floor(F.col("anomaly") * LEVELS) < limit)
    return out.select(F.col("id").alias(id_col), *COUNTS, base.alias("base_failed"), "anomaly", (~base & F.col("normal")).alias("kept"))
