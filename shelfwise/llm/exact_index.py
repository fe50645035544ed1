"""Exact deduplication by an extendible-hash index kept in shared files.

Keys are 64-bit hashes of normalised texts. The directory maps key prefixes to buckets; a bucket that holds too
many bytes is split by one more bit, which doubles its part of the directory. One task owns a bucket, that is a range
of keys, and compares the bytes of texts whose keys collide. Copies cannot be split by bits: their bucket is chained
into pages, each deduplicated alone, and what is left of them meets again in the next round.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.staging import stage

KEY_BITS = 63
PAGE_BYTES = 32 << 20       # packed bytes of a bucket, and of a page of copies
SPACES = bytes([32, *range(9, 14)])
BEST = ("chars", "doc_id", "row")
ENTRY = "entry bigint, key bigint, n bigint, chars bigint, doc_id bigint, row bigint, text binary"


def normalise(text: bytes) -> bytes:
    """The text without ``[\\x20\\x09-\\x0D]``."""
    return text.translate(None, SPACES)


def text_key(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def better(a: tuple, b: tuple) -> tuple:
    """Of two ``(chars, doc_id, row)``: the longer text, then the smaller id (nulls last), then the earlier row."""
    return min(a, b, key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2]))


def _scan(batches):
    """One row per document; the first of equal texts of a batch carries the entry: packed text, count, best row."""
    part = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    at = 0
    for batch in batches:
        ids, chars = batch.column("doc_id").to_pylist(), batch.column("chars").to_pylist()
        first: dict[bytes, int] = {}
        entry, count, best, digest, packed = [], {}, {}, [], {}
        for i, text in enumerate(batch.column("text")):
            plain = normalise(text.as_buffer().to_pybytes() if text.is_valid else b"")
            j = first.setdefault(plain, i)
            entry.append(part + at + j)
            mine = (chars[i], ids[i], part + at + i)
            if i == j:
                digest.append(hashlib.sha256(plain).digest())
                count[i], best[i] = 1, mine
                packed[i] = (text_key(plain), _squeeze(plain))
            else:
                digest.append(digest[j])
                count[j] += 1
                best[j] = better(best[j], mine)
        some = [i in packed for i in range(len(ids))]

        def column(pick, kind):
            return pa.array([pick(i) if here else None for i, here in enumerate(some)], kind)

        yield pa.RecordBatch.from_pydict({
            "doc": pa.array(ids, pa.int64()), "at": pa.array(range(part + at, part + at + len(ids)), pa.int64()),
            "sha": pa.array(digest, pa.binary()), "entry": pa.array(entry, pa.int64()),
            "key": column(lambda i: packed[i][0], pa.int64()), "n": column(lambda i: count[i], pa.int64()),
            "chars": column(lambda i: best[i][0], pa.int64()), "doc_id": column(lambda i: best[i][1], pa.int64()),
            "row": column(lambda i: best[i][2], pa.int64()), "text": column(lambda i: packed[i][1], pa.binary())})
        at += len(ids)


def _squeeze(plain: bytes) -> bytes:
    """Same bytes in, same bytes out: length and compressed text."""
    return len(plain).to_bytes(8, "little") + pa.compress(plain, "zstd", asbytes=True)


def _plain(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True)


def _prefix(key: str, bits: int) -> Column:
    return F.shiftright(key, KEY_BITS - bits) if bits else F.lit(0).cast("bigint")


def directory(entries: DataFrame, page_bytes: int = PAGE_BYTES) -> tuple[DataFrame, int]:
    """``(slot, depth, low, high, bytes, pages)`` of every bucket, and the depth that the directory starts from.

    Buckets over ``page_bytes`` are split by a bit while they have several keys; one key alone is chained into
    pages of four entries or more. Only sums by prefix are shuffled, and one flag a round reaches the driver.
    """
    sizes = stage(entries.groupBy("key").agg(F.sum(F.length("text") + 64).alias("bytes"), F.count("*").alias("n")), "key-sizes")
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    start = depth = max(0, math.ceil(math.log2(max(2 * total / page_bytes, 1))))
    todo, done = sizes, None
    while True:
        buckets = stage(todo.groupBy(_prefix("key", depth).alias("prefix")).agg(
            F.min("key").alias("low"), F.max("key").alias("high"), F.sum("bytes").alias("bytes"), F.sum("n").alias("n")), "buckets")
        full = (F.col("bytes") > page_bytes) & (F.col("low") < F.col("high"))
        pages = F.when(F.col("low") == F.col("high"), F.greatest(F.lit(1), F.least(F.ceil(F.col("bytes") / page_bytes), F.floor(F.col("n") / 4))))
        leaves = buckets.where(~full).select(_prefix("low", start).alias("slot"), F.lit(depth).alias("depth"), "low", "high", "bytes",
                                             F.coalesce(pages, F.lit(1)).cast("int").alias("pages"))
        done = leaves if done is None else done.unionByName(leaves)
        over = buckets.where(full).select("prefix")
        if over.isEmpty():
            return stage(done, "directory"), start
        todo = todo.withColumn("prefix", _prefix("key", depth)).join(over, "prefix", "left_semi").drop("prefix")
        depth += 1


def _own(batches):
    """Rows sorted by bucket, page and key: entries of one key are chained, and those with equal bytes get one class.

    A chain holds one text per class; the entries of a page are a few numbers each.
    """
    out: list[tuple] = []
    here, chain = None, []

    def close():
        for packed, _, members, n, best, pages in chain:
            text = packed if pages > 1 else None
            out.extend((e, members[0], here[-1], n, *best, pages, text if e == members[0] else None) for e in members)
        chain.clear()

    def rows():
        cols = list(zip(*out)) or [[]] * len(CLASS)
        got = pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "text" else pa.int64()) for k, c in zip(CLASS, cols)], list(CLASS))
        out.clear()
        return got

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("slot", "low", "page", "key", "entry", "n", *BEST, "pages")]
        for k, (slot, low, page, key, entry, n, chars, doc, row, pages) in enumerate(zip(*cols)):
            if (now := (slot, low, page, key)) != here:
                close()
                here = now
            packed = batch.column("text")[k].as_py()
            best = (chars, doc, row)
            plain = None
            for link in chain:
                if len(link[0]) and link[0][:8] == packed[:8]:          # as long
                    plain = _plain(packed) if plain is None else plain
                    if link[1] is None:
                        link[1] = _plain(link[0])
                    if link[1] == plain:
                        link[2].append(entry)
                        link[3], link[4] = link[3] + n, better(link[4], best)
                        break
            else:
                chain.append([packed, plain, [entry], n, best, pages])
        yield rows()
    close()
    yield rows()


CLASS = ("entry", "rep", "key", "n", *BEST, "pages", "text")
OWNED = "entry bigint, rep bigint, key bigint, n bigint, chars bigint, doc_id bigint, row bigint, pages bigint, text binary"


def _owned(placed: DataFrame) -> DataFrame:
    where = ["slot", "low", "page"]
    rows = placed.select(*where, "key", "entry", "n", *BEST, F.col("pages").cast("bigint").alias("pages"), "text")
    return rows.repartition(*where).sortWithinPartitions(*where, "key", "entry").mapInArrow(_own, OWNED)


def classes(entries: DataFrame, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """``(entry, n, chars, doc_id, row)``: rows in the entry's class, and the one of them that stays."""
    leaves, start = directory(entries, page_bytes)
    # a bucket that was neither split nor chained is its slot
    odd = leaves.where((F.col("depth") > start) | (F.col("pages") > 1)).select(F.col("slot").alias("s"), "low", "high", "pages")
    slotted = entries.withColumn("slot", _prefix("key", start))
    placed = slotted.join(odd, (slotted.slot == odd.s) & F.col("key").between(odd.low, odd.high), "left")
    placed = placed.withColumn("pages", F.coalesce("pages", F.lit(1))).withColumn("low", F.coalesce("low", F.lit(0)))
    owned = stage(_owned(placed.withColumn("page", F.pmod(F.xxhash64("entry"), F.col("pages")))), "owned")
    final = owned.where("pages = 1").select("entry", "n", *BEST)
    chained = owned.where("pages > 1")
    if chained.isEmpty():
        return final
    # what the pages of one key have left: few, dealt by their length and streamed past each other
    left = chained.where("text IS NOT NULL").select("entry", "key", "n", *BEST, "text").withColumns(
        {"slot": F.col("key"), "low": F.crc32(F.substring("text", 1, 8)), "page": F.lit(0), "pages": F.lit(1)})
    last = stage(_owned(left), "owned-again").select(F.col("entry").alias("rep"), "n", *BEST)
    return final.unionByName(chained.select("entry", "rep").join(last, "rep").drop("rep"))


def exact_groups(docs: DataFrame, page_bytes: int = PAGE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256, keep_chars)``, one row per input row.

    Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``, compared byte by byte; a null
    text is empty, and empty texts are equal. The row with the most code points in its original text stays, then the
    smallest id (null ids last), then the first of rows that repeat both. ``keep_id`` is null only if no row of the
    group with as many code points has an id. Other columns are ignored; an empty table gives no rows; a text of
    any length is one entry of its bucket.

    Copies within a batch are combined before the shuffle. Rows get their class by entry, a key that holds no more
    rows than a batch, so a text that a third of all rows share is never one key of a join.
    """
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("chars"),
                       text.cast("binary").alias("text"))
    pages = stage(rows.mapInArrow(_scan, f"doc bigint, at bigint, sha binary, {ENTRY}"), "index-pages")
    found = classes(pages.where("text IS NOT NULL").select("entry", "key", "n", *BEST, "text"), page_bytes)
    marks = pages.select("doc", "at", "sha", "entry").join(found, "entry")
    return marks.select(F.col("doc").alias("doc_id"), F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"),
                        (F.col("at") == F.col("row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
                        F.col("chars").alias("keep_chars"))


def dedup_exact(docs: DataFrame, page_bytes: int = PAGE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the row of each group that stays, all columns as they are."""
    text = F.col(f"`{text_col}`").cast("string")
    groups = stage(exact_groups(docs, page_bytes, id_col, text_col), "exact-groups")
    stays = groups.where("kept").select("doc_id", "text_sha256", "keep_chars")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), F.col(f"`{id_col}`").cast("bigint").alias("i"),
                       F.sha2(F.translate(F.coalesce(text, F.lit("")), SPACES.decode(), "").cast("binary"), 256).alias("h"),
                       F.coalesce(F.length(text), F.lit(0)).alias("c"))
    out = rows.join(stays, F.col("i").eqNullSafe(stays.doc_id) & (F.col("h") == stays.text_sha256) & (F.col("c") == stays.keep_chars), "left_semi")
    if not groups.where("NOT kept AND doc_id <=> keep_id").isEmpty():       # rows that repeat the id of the one that stays
        out = out.dropDuplicates(["i", "h", "c"])
    return out.select("r.*")
