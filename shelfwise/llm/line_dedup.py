"""Line deduplication by site-relative frequency, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_keys(text: Column) -> Column:
    """128-bit keys of a text's distinct non-blank lines, as pairs of hashes. Lines are compared without outer spaces."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    return F.transform(F.array_distinct(lines), line_key)


def line_key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line, F.length(line)).alias("b"))


def boilerplate(docs: DataFrame, ratio: float = 0.1, least: int = 5, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(host, key, pages, total)``: lines in more than ``ratio`` of a host's pages and in ``least`` of them or more.

    Every page counts once per line; pages without text count in the host's total. A null host is a host.
    """
    pages = docs.select(F.col(host_col).alias("host"), F.col(text_col).cast("string").alias("text"))
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    counts = (pages.select("host", F.explode(line_keys(F.col("text"))).alias("key"))
              .groupBy("host", "key").agg(F.count("*").alias("pages")).where(F.col("pages") >= least))
    both = counts.join(totals, counts["host"].eqNullSafe(totals["host"]))
    return both.where(F.col("pages") > ratio * F.col("total")).select(counts["host"], "key", "pages", "total")


def dedup_lines(docs: DataFrame, ratio: float = 0.1, least: int = 5, id_col: str = "doc_id", host_col: str = "source",
                text_col: str = "text") -> DataFrame:
    """``docs`` with the boilerplate lines of their host taken out of the text, plus ``n_lines`` and ``n_removed``.

    A line is what stands between line feeds; blank lines stay and are not counted as removable. Lines are
    matched by 128-bit hashes, so only keys and the few frequent ones are shuffled until the drop list of a page
    meets its text. That list is keyed by page and host: rows that repeat an id, or lack one, are treated alike
    within a host, and lines another host repeats stay. Null text stays null with null counts.

    A frequent line of a hot host is one key with many pages: counts combine before the shuffle, and the join
    back is a plain equality join that adaptive execution broadcasts while the list is small, else splits.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    page = row.select("row", F.col("row")[id_col].alias("id"), F.col("row")[host_col].alias("host"))
    text = F.col("row")[text_col]                                  # taken after the join, so that a text is shuffled once
    common = boilerplate(docs, ratio, least, host_col, text_col).select(F.col("host").alias("h"), F.col("key").alias("k"))
    keys = page.select("id", "host", F.explode(line_keys(text)).alias("key"))
    drop = (keys.join(common, keys["host"].eqNullSafe(common["h"]) & (keys["key"] == common["k"]), "left_semi")
            .groupBy("id", "host").agg(F.collect_set("key").alias("drop"))
            .select(F.col("id").alias("d"), F.col("host").alias("g"), "drop"))
    joined = page.join(drop, page["id"].eqNullSafe(drop["d"]) & page["host"].eqNullSafe(drop["g"]), "left")
    lines = F.split(text, "\n")
    kept = F.when(F.col("drop").isNull(), lines).otherwise(
        F.filter(lines, lambda s: ~F.array_contains("drop", line_key(F.trim(s)))))
    out = joined.select("row", lines.alias("lines"), kept.alias("kept"))
    return out.select(*[(F.array_join("kept", "\n") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns
                        if c not in ("n_lines", "n_removed")],
                      F.when(F.col("lines").isNotNull(), F.size("lines")).cast("bigint").alias("n_lines"),
                      F.when(F.col("lines").isNotNull(), F.size("lines") - F.size("kept")).cast("bigint").alias("n_removed"))
