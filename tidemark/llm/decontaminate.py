"""Passages of benchmark items in documents, by winnowed fingerprints and DataFrame operations only.

A window is ten consecutive words of an item, or all words of a shorter one. Its
fingerprint is the minimum hash of its k-grams of five words, or of its own
words if they are fewer. A document's windows of the same lengths get theirs
the same way, which is winnowing: runs of windows share a fingerprint, and
equal windows have equal ones, so no shared window is missed. Fingerprints that
join are extended to the windows of their runs, which are then compared as a
whole.

Documents are handled by their text, so copies are examined once. Windows that
occur in the same items share a number for that set of items, and documents
with the same sets share their list of items, so that a passage of many items
in many documents makes no pairs of the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Workspace

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WINDOW = 10
GRAM = 5
#: Words of 64 bits of the filter that keeps texts without a matching fingerprint from being shuffled: at most 2**this rows.
FILTER_BITS = 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.translate(text, _UPPER, _UPPER.lower()), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _upto(first: int, n: Column) -> Column:
    """first..n, or nothing."""
    return F.when(n >= first, F.sequence(F.lit(first), n)).otherwise(F.array().cast("array<int>"))


def _grams(w: Column, k: int) -> Column:
    """A hash of each k consecutive words."""
    return F.transform(_upto(0, F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))


def _windows(w: Column, size: int) -> Column:
    """The fingerprint of each window of so many words."""
    k = min(GRAM, size)
    if size == k:
        return _grams(w, k)
    return _let(_grams(w, k), lambda h: F.transform(_upto(0, F.size(h) - (size - k + 1)), lambda i: F.least(*[F.get(h, i + j) for j in range(size - k + 1)])))


def _runs(w: Column, size: int) -> Column:
    """(size, print, from, to) of runs of windows of one fingerprint, by number of their first word."""

    def split(m: Column) -> Column:
        starts = F.filter(_upto(0, F.size(m) - 1), lambda i: (i == 0) | (F.get(m, i) != F.get(m, i - 1)))
        run = lambda s: F.transform(s, lambda a, j: F.struct(F.lit(size).alias("size"), F.get(m, a).alias("print"), a.alias("from"), (F.coalesce(F.get(s, j + 1), F.size(m)) - 1).alias("to")))
        return _let(starts, run)

    return _let(_windows(w, size), split)


def _print_of(w: Column) -> Column:
    """The fingerprint of one window, whose words are w."""
    whole = F.array_min(_let(_grams(w, GRAM), lambda h: h))
    for k in range(1, GRAM):
        whole = F.when(F.size(w) == k, F.get(_grams(w, k), F.lit(0))).otherwise(whole)
    return whole


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, size, print, window) of all distinct windows of items."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - WINDOW + 1, F.lit(1)))
    rows = rows.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), F.lit(WINDOW)).alias("w"))
    return rows.select("item", F.size("w").alias("size"), _print_of(F.col("w")).alias("print"), F.array_join("w", " ").alias("window")).distinct()


def _likely(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows without most of those whose key is not among keys: a bitmap of hashed keys, bounded in size, is broadcast.

    Join the result by an inner join: a semi join would be planned before this filter.
    """
    h = F.xxhash64("key")
    word, flag = h.bitwiseAND((1 << FILTER_BITS) - 1), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 58).cast("int"))
    bitmap = keys.groupBy(word.alias("_word")).agg(F.bit_or(flag).alias("_bits"))
    return rows.withColumn("_word", word).join(F.broadcast(bitmap), "_word").filter(F.col("_bits").bitwiseAND(flag) != 0).drop("_word", "_bits")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or empty text has no words, is not hit and gives the digest of an
    empty list. Items without words have no window. An item without an id
    still hits words but is neither counted nor listed; rows of one item id are
    one item. Texts of any length are read whole; ids may be null or repeat,
    and repeated rows give repeated results. Columns that are not named,
    whatever their names, are not read. An empty table of documents gives an
    empty one, without items nothing is hit.
    """
    work = Workspace(docs.sparkSession, "decontaminate")
    windows = work.table(item_windows(items, item_col, item_text_col), "windows")
    # sets of items, named by count and two sums of hashes; one window stands for each
    h = [F.xxhash64(F.lit(seed), "item") for seed in (1, 2)]
    sets = windows.groupBy("window", "size").agg(F.count("item").alias("n"), *[F.bit_xor(F.when(F.col("item").isNotNull(), x)).alias(f"x{i}") for i, x in enumerate(h)], *[F.bit_xor(F.when(F.col("item").isNotNull(), F.shiftright(x, 7) * 31)).alias(f"y{i}") for i, x in enumerate(h)])
    sets = work.table(sets, "sets")
    named = ["n", "x0", "x1", "y0", "y1"]
    numbers = work.table(sets.groupBy(*named).agg(F.min("window").alias("window")).withColumn("items", F.monotonically_increasing_id()), "numbers")
    same = [sets[c].eqNullSafe(numbers[c]) for c in named]
    known = work.table(sets.join(numbers, on=same).select(sets["window"], "items"), "known")
    listed = numbers.join(windows, "window").filter("item IS NOT NULL").select("items", "item")

    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # at most WINDOW of them
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("key", F.md5(F.col("text")))
    runs = _let(words(F.col("text")), lambda w: F.concat(*[_runs(w, s) for s in sizes])) if sizes else F.array().cast("array<struct<size:int,print:bigint,from:int,to:int>>")
    runs = rows.filter("text IS NOT NULL").select("key", F.explode(runs).alias("r")).select("key", "r.*")
    prints = windows.select("size", "print").distinct()
    met = runs.join(prints, ["size", "print"], "left_semi").select("key", "size", "from", "to").distinct()
    met = work.table(met.groupBy("key").agg(F.collect_list(F.struct("size", "from", "to")).alias("runs")), "met")

    # windows of these runs, each compared whole
    texts = _likely(rows.select("key", "text"), met).join(met.select("key"), "key").groupBy("key").agg(F.first("text").alias("text"))
    starts = F.flatten(F.transform("runs", lambda r: F.transform(F.sequence(r["from"], r["to"]), lambda i: F.struct(i.alias("at"), r["size"].alias("size")))))
    seen = texts.join(met, "key").select("key", _let(words(F.col("text")), lambda w: F.transform(starts, lambda s: F.struct(s["at"].alias("at"), s["size"].alias("size"), F.array_join(F.slice(w, s["at"] + 1, s["size"]), " ").alias("window")))).alias("s"))
    seen = seen.select("key", F.explode("s").alias("s")).select("key", "s.*")
    hits = seen.join(known, "window").select("key", "at", "size", "items")
    earlier = Window.partitionBy("key").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("at") + F.col("size") - F.greatest(F.col("at"), F.coalesce(F.max(F.col("at") + F.col("size")).over(earlier), F.lit(0)))
    hits = hits.withColumn("new", F.greatest(new, F.lit(0)))
    found = work.table(hits.groupBy("key").agg(F.sum("new").alias("n_hit"), F.sort_array(F.collect_set("items")).alias("sets")), "found")

    lists = found.select("sets").distinct().select("sets", F.explode("sets").alias("items")).join(listed, "items").select("sets", "item").distinct()
    lists = lists.groupBy("sets").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("digest"))
    found = found.join(lists, "sets", "left").select("key", "n_hit", "n_items", "digest")
    out = rows.select("id", "key", F.coalesce(F.regexp_count(F.translate("text", _UPPER, _UPPER.lower()), F.lit(WORD)), F.lit(0)).cast("long").alias("n_words")).join(found, "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
