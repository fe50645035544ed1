"""Source divergence audit: how far every source's terms are from each other source's and from its language's.

Term counts of a source are sorted (term id, count) arrays in blocks of ids. For every unordered pair of sources a
task merges the two arrays of a block: terms of both are found by galloping, those of one side or of neither are
priced with the other side's share of an absent term.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.staging import discard, stage

SCALE, PRIOR = 1_000_000_000, 5     # shares are whole billionths; every term counts five times more than it occurs
BLOCK = 1 << 16                     # term ids of one merge task
HELD = 1 << 20                      # (group, term) entries that a counting task holds before it passes them on
PART = 8 << 20                      # bytes of a long text split at once
#: A-Z lower-cased, other ASCII but letters a gap
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, a long one in parts."""
    text = text.translate(LETTERS)
    start = 0
    while len(text) - start > PART:
        cut = text.find(b" ", start + PART)
        if cut < 0:
            break
        yield text[start:cut].split()
        start = cut
    yield text[start:].split()


def _count(batches):
    """``(lang, source, term, n, docs)`` of a task's rows, combined before anything is shuffled."""
    counts: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}

    def flush():
        for (lang, source), n in counts.items():
            names = pa.array(list(n), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_pydict({
                "lang": pa.repeat(pa.scalar(lang, pa.string()), len(n)), "source": pa.repeat(pa.scalar(source, pa.string()), len(n)),
                "term": names, "n": pa.array(list(n.values()), pa.int64()),
                "docs": pa.array(list(map(docs[lang, source].__getitem__, n)), pa.int64())})
        counts.clear()
        docs.clear()

    grown = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            n, seen = counts.setdefault((lang, source), Counter()), set()
            before = len(n)
            for part in terms(text):
                n.update(part)
                seen.update(part)
            docs.setdefault((lang, source), Counter()).update(seen)
            grown += len(n) - before
            if grown > HELD:
                yield from flush()
                grown = 0
    yield from flush()


def term_counts(rows: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences, and rows with the term, of ``rows(lang, source, text)``."""
    raw = rows.mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint")
    return raw.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column) -> Column:
    """``1 + floor(SCALE * (n + PRIOR) / total)``, exact however large the counts; 0 where there is no total."""
    top = (n + PRIOR).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    whole = F.call_function("div", top, total.cast("decimal(20,0)"))
    return F.when(total > 0, 1 + whole).otherwise(0)


def shares(n: np.ndarray, total: int) -> np.ndarray:
    """The same for an array, by long division in base 1000 so that no product passes 63 bits."""
    if total >= 1 << 53:
        return np.array([1 + SCALE * (int(x) + PRIOR) // total for x in n], np.int64)
    rest = n.astype(np.int64) + PRIOR
    out, rest = rest // total, rest % total
    for _ in range(3):
        rest *= 1000
        out = out * 1000 + rest // total
        rest %= total
    return out + 1


def gallop(few: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each of ``few``, the first place of ``many`` (sorted, not empty) not below it.

    Strides double from a guess of the place until they pass it, then halve: a near miss costs next to nothing.
    """
    n = len(many)
    guess = np.clip((few - many[0]) * n // max(int(many[-1]) - int(many[0]) + 1, 1), 0, n - 1).astype(np.int64)
    low, high = guess.copy(), guess.copy()
    step = 1
    while (far := (low >= 0) & (many[np.maximum(low, 0)] >= few)).any():
        low[far] = np.maximum(low[far] - step, -1)
        step *= 2
    step = 1
    while (far := (high < n) & (many[np.minimum(high, n - 1)] < few)).any():
        high[far] = np.minimum(high[far] + step, n)
        step *= 2
    while (wide := high - low > 1).any():
        mid = (low + high) // 2
        below = many[np.clip(mid, 0, n - 1)] < few
        low, high = np.where(wide & below, mid, low), np.where(wide & ~below, mid, high)
    return high


def merge(ids_a: np.ndarray, n_a: np.ndarray, total_a: int, ids_b: np.ndarray, n_b: np.ndarray, total_b: int) -> tuple[int, int]:
    """Sum of ``abs(p - q)`` over the terms of either side, and how many these are."""
    if len(ids_a) > len(ids_b):
        return merge(ids_b, n_b, total_b, ids_a, n_a, total_a)
    p, q = shares(n_a, total_a), shares(n_b, total_b)
    none_a, none_b = (int(shares(np.zeros(1, np.int64), t)[0]) for t in (total_a, total_b))
    if not len(ids_a):
        return int(np.abs(q - none_a).sum()), len(ids_b)
    at = gallop(ids_a, ids_b)
    both = (at < len(ids_b)) & (ids_b[np.minimum(at, len(ids_b) - 1)] == ids_a)
    only_b = np.ones(len(ids_b), bool)
    only_b[at[both]] = False
    value = np.abs(p[both] - q[at[both]]).sum() + np.abs(p[~both] - none_b).sum() + np.abs(q[only_b] - none_a).sum()
    return int(value), len(ids_a) + int(only_b.sum())


def _pack(key, rows):
    ids, n = rows.column("id").to_numpy(), rows.column("n").to_numpy()
    order = np.argsort(ids)
    step = np.diff(ids[order], prepend=0).astype("<u4")
    packed = pa.compress(step.tobytes() + n[order].astype("<i8").tobytes(), "zstd", asbytes=True)
    return pa.table({"lang": [key[0].as_py()], "source": [key[1].as_py()], "block": pa.array([key[2].as_py()], pa.int32()),
                     "size": pa.array([len(ids)], pa.int32()), "packed": pa.array([packed], pa.binary())})


def _unpack(side: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    if not side.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = side.column("size")[0].as_py()
    raw = pa.decompress(side.column("packed")[0].as_py(), 12 * size, "zstd", asbytes=True)
    return np.cumsum(np.frombuffer(raw, "<u4", size).astype(np.int64)), np.frombuffer(raw, "<i8", size, 4 * size)


def _merge_pair(key, left, right):
    side = left if left.num_rows else right
    value, size = merge(*_unpack(left), side.column("total_a")[0].as_py(), *_unpack(right), side.column("total_b")[0].as_py())
    return pa.table({"lang": [key[0].as_py()], "a": [key[1].as_py()], "b": [key[2].as_py()], "value": pa.array([value], pa.int64()),
                     "size": pa.array([size], pa.int64())})


def divergence(docs: DataFrame, least_docs: int = 30, top: int = 50, block: int = BLOCK, text_col: str = "text",
               lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(lang, source, part, item, value, rank)``.

    A term is a run of letters A-Z (lower-cased) and non-ASCII characters; a language keeps those in ``least_docs`` of its
    rows or more. With ``p(n) = 1 + floor(1e9 (n + 5) / (N + 5 V))``, N the occurrences of the V kept terms in a group:

    - part ``pair``: every other source of the language, by the sum over all kept terms of ``abs(p - q)``, all of them;
    - part ``term``: the ``top`` kept terms that the source uses with a larger share than its language, by the difference.

    Larger values first, ties by the item's UTF-8 bytes. Null text, language and source count as empty; rows that repeat
    an id are rows of their own; a group without terms has pairs and no terms; an empty table gives no rows. Other
    columns are ignored. Long texts are split in parts, whole.

    Counts are combined in the tasks, so a source with a third of all rows is at most one row a term. Ids are numbered
    per hashed block of the vocabulary, without a global sort. A pair meets in one task per block of ``block`` ids:
    that is what bounds a task, whatever the vocabulary. Pairs are the result asked for, so their number is its size.
    """
    def named(c: str) -> Column:
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))

    rows = docs.select(named(lang_col).alias("lang"), named(source_col).alias("source"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    counts = stage(term_counts(rows), "term-counts")
    vocabulary = stage(counts.groupBy("lang", "term").agg(F.sum("n").alias("whole"), F.sum("docs").alias("docs"))
                       .where(F.col("docs") >= least_docs).drop("docs"), "vocabulary")
    sizes = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("whole").alias("whole"))
    langs = stage(sizes.select("lang", "v", (F.col("whole") + PRIOR * F.col("v")).alias("total_lang")), "languages")
    place = F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / block)).cast("int")
    number = F.row_number().over(Window.partitionBy("lang", "block").orderBy("term"))
    ids = vocabulary.join(langs, "lang").select("lang", "term", "whole", "total_lang", place.alias("block")).withColumn("id", number)
    used = stage(counts.join(ids, ["lang", "term"]).select("lang", "source", "term", "block", "id", "n", "whole", "total_lang"), "used-terms")

    seen = rows.select("lang", "source").distinct()
    found = used.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = seen.join(found, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = stage(groups.select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"),
                                 (F.coalesce("n", F.lit(0)) + PRIOR * F.coalesce("v", F.lit(0))).alias("total")), "groups")
    discard(counts, vocabulary)

    p, q = share(F.col("n"), F.col("total")), share(F.col("whole"), F.col("total_lang"))
    own = used.join(groups, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                                       (p - q).alias("value")).where("value > 0")

    packed = stage(used.select("lang", "source", "block", "id", "n").groupBy("lang", "source", "block").applyInArrow(
        _pack, "lang string, source string, block int, size int, packed binary"), "term-arrays")
    a, b = (groups.select("lang", "v", F.col("source").alias(x), F.col("total").alias(f"total_{x}")) for x in "ab")
    pairs = stage(a.join(b.drop("v"), "lang").where("a < b"), "pairs")

    def side(x: str) -> DataFrame:
        of = packed.withColumnRenamed("source", x).join(pairs, ["lang", x])
        return of.select(*[F.col(c).alias(c) for c in ("lang", "a", "b", "block", "total_a", "total_b", "size", "packed")]).groupBy("lang", "a", "b", "block")

    merged = side("a").cogroup(side("b")).applyInArrow(_merge_pair, "lang string, a string, b string, value bigint, size bigint")
    merged = merged.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("size").alias("size"))
    nothing = F.abs(share(F.lit(0), F.col("total_a")) - share(F.lit(0), F.col("total_b")))
    value = F.coalesce("value", F.lit(0)) + nothing * (F.col("v") - F.coalesce("size", F.lit(0)))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                             F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s")
    other = pairs.join(merged, ["lang", "a", "b"], "left").select("lang", both, value.cast("bigint").alias("value"))
    other = other.select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    own = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return other.withColumn("rank", F.row_number().over(order)).unionByName(own)
