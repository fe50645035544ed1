"""Token ids of whole texts, and their files: frequency-ranked, byte-aligned, with control bytes apart.

A file row is a block of documents: ``shard`` (its file, in id order), ``before`` (ids of the shard's earlier
blocks), ``docs``/``sizes`` (who, and how many ids), ``control`` (two bits per value: its bytes less one, four
values a byte) and ``data`` (the values' bytes, little-endian). A value is the rank of an id by its count over
the corpus, so frequent ids take one byte.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.functions.staging import stage, stage_root
from shelfwise.llm.common import map_batches

KNOWN_LIMIT = 1_500_000     # words whose ids a worker remembers
BLOCK_IDS = 1 << 20         # ids in a block of the file

_KNOWN: dict[str, tuple] = {}


class Encoder:
    """Ids of a byte-level BPE tokenizer as little-endian bytes, two to an id if its vocabulary allows, else four.

    Its first step never joins text across a single space that stands between two other characters, so
    the pieces between such spaces are encoded once per worker and looked up from then on. A text with a
    space beside other white space, or at an end, is encoded as it stands.
    """

    def __init__(self, path: str, limit: int = KNOWN_LIMIT):
        self.path, self.limit = path, limit
        self.kind = "<u2" if _open(path).get_vocab_size() <= 1 << 16 else "<u4"

    def _tools(self):
        if self.path not in _KNOWN:
            tokenizer = _open(self.path)
            size = np.zeros(tokenizer.get_vocab_size(), np.int64)
            for token, i in tokenizer.get_vocab().items():
                size[i] = len(token)                    # one character a byte
            _KNOWN[self.path] = (tokenizer, size, {})
        return _KNOWN[self.path]

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _encode_new(self, new: list[str], tokenizer, size: np.ndarray) -> dict[str, bytes]:
        """Ids of ``" " + piece``: many pieces go as one text and are cut apart by the bytes of their ids."""
        out: dict[str, bytes] = {}
        width = int(self.kind[2])
        for i in range(0, len(new), 2048):
            part = new[i:i + 2048]
            ids = np.array(tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.cumsum([len(p.encode()) + 1 for p in part])
            cut = (width * (np.searchsorted(np.cumsum(size[ids]), ends) + 1)).tolist()
            raw, last = self._bytes(ids), 0
            for p, c in zip(part, cut):
                out[p] = raw[last:c]
                last = c
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        tokenizer, size, known = self._tools()
        whole, found, new = [], [], {}
        for text in texts:
            pieces = text.split(" ")
            head = pieces[0]
            ids = list(map(known.get, pieces))
            ids[0] = b""
            plain = len(pieces) == 1 or (head != "" and not head[-1].isspace())
            if plain and None in ids:
                unknown = [p for p, i in zip(pieces, ids) if i is None]
                plain = all(p and not p[0].isspace() and not p[-1].isspace() for p in unknown)
                if plain:
                    new.update(dict.fromkeys(unknown))
            whole.append(head if plain else text)
            found.append((pieces, ids) if plain else None)
        heads = [self._bytes(e.ids) for e in tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
        new = self._encode_new(list(new), tokenizer, size)
        if len(known) + len(new) <= self.limit:
            known.update(new)
        out = []
        for head, row in zip(heads, found):
            if row is None:
                out.append(head)
            else:
                pieces, ids = row
                out.append(head + b"".join(ids if None not in ids else [new[p] if i is None else i for p, i in zip(pieces, ids)]))
        return out


def _open(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def texts_of(batch: pa.RecordBatch, column: str = "text", size: int = 512) -> Iterator[tuple[int, list[str]]]:
    """A batch's texts in runs of ``size``; null counts as empty."""
    col = batch.column(column)
    for i in range(0, len(col), size):
        yield i, [t or "" for t in col.slice(i, size).to_pylist()]


def token_rows(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)``: all ids of each text and the end id, as bytes of ``Encoder(tokenizer).kind``."""
    encoder = Encoder(tokenizer)
    end = np.array([end_id], encoder.kind).tobytes()

    def run(batch):
        for i, texts in texts_of(batch):
            yield {"doc_id": batch.column("doc_id").slice(i, len(texts)),
                   "ids": pa.array([ids + end for ids in encoder.encode(texts)], pa.binary())}
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id bigint, ids binary")


# -- coding ------------------------------------------------------------------

def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """``control, data`` of unsigned 32-bit values."""
    size = 1 + (values > 0xFF) + (values > 0xFFFF) + (values > 0xFFFFFF)
    raw = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(4) < size[:, None]]
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[:len(values)] = size - 1
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    return control.astype(np.uint8).tobytes(), data.tobytes()


#: byte counts of the four values of each control byte
SIZES = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The first ``n`` values: sizes by table from the control bytes, then one gather of four bytes each."""
    size = SIZES[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(size) - size
    raw = np.frombuffer(data + bytes(4), np.uint8)
    values = np.lib.stride_tricks.sliding_window_view(raw, 4)[at].copy().view("<u4").reshape(-1)
    return values & MASKS[size - 1]


def rank_table(tokens: DataFrame, kind: str) -> np.ndarray:
    """Ids by falling count over all rows (ties: smaller id); as long as the largest id, so bounded by the vocabulary."""
    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind)
            if len(ids):
                more = np.bincount(ids, minlength=len(total))
                more[:len(total)] += total
                total = more
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(some, pa.int64()), "n": pa.array(total[some], pa.int64())})
    counted = tokens.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    rows = counted.collect()
    return np.array([r.id for r in sorted(rows, key=lambda r: (-r.n, r.id))], np.uint32)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text",
                 block_ids: int = BLOCK_IDS) -> None:
    """Write the token files of ``docs`` in ascending id order (nulls first) below ``path``, the table of ranks beside them.

    Files are numbered in id order. Rows that repeat an id are kept, ordered by their ids' bytes. The text is
    tokenized once: ids go to the shared folder, are counted, and are dealt by ranges of the document id.
    """
    spark = docs.sparkSession
    kind = Encoder(tokenizer).kind
    tokens = stage(token_rows(docs, tokenizer, end_id, id_col, text_col), "tokens")
    by_rank = rank_table(tokens, kind)
    ranks = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    ranks[by_rank] = np.arange(len(by_rank), dtype=np.uint32)

    def blocks(batches):
        shard, before = TaskContext.get().partitionId(), 0
        docs, held, total = [], [], 0

        def block():
            sizes = [len(h) // int(kind[2]) for h in held]
            control, data = pack(ranks[np.frombuffer(b"".join(held), kind)])
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int64()), "before": pa.array([before], pa.int64()),
                "docs": pa.array([docs], pa.list_(pa.int64())), "sizes": pa.array([sizes], pa.list_(pa.int64())),
                "control": pa.array([control], pa.binary()), "data": pa.array([data], pa.binary())})

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                docs.append(doc)
                held.append(ids)
                total += len(ids)
                if total >= block_ids * int(kind[2]):
                    yield block()
                    before += total // int(kind[2])
                    docs, held, total = [], [], 0
        if docs:
            yield block()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = tokens.repartitionByRange(parts, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "ids")
    (dealt.mapInArrow(blocks, "shard bigint, before bigint, docs array<bigint>, sizes array<bigint>, control binary, data binary")
     .write.option("compression", "zstd").parquet(f"{path}/blocks"))
    # bounded by the vocabulary
    (spark.createDataFrame([(by_rank.astype("<u4").tobytes(),)], "ids binary").coalesce(1).write.parquet(f"{path}/ranks"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document in the files at ``path``, decoded by table lookup.

    ``start`` counts the ids of all documents before it; ``ids`` are little-endian 32-bit bytes. All it needs is in
    the files: any later session can read them.
    """
    by_rank = np.frombuffer(spark.read.parquet(f"{path}/ranks").first().ids, "<u4")

    def run(batch):
        for shard, before, docs, sizes, control, data in zip(*(batch.column(c).to_pylist() for c in (
                "shard", "before", "docs", "sizes", "control", "data"))):
            ends = np.cumsum(sizes)
            ids = by_rank[unpack(control, data, int(ends[-1]))].astype("<u4") if ends[-1] else np.zeros(0, "<u4")
            raw = ids.tobytes()
            begin = ends - np.array(sizes)
            yield {"shard": pa.array([shard] * len(docs), pa.int64()), "doc_id": pa.array(docs, pa.int64()),
                   "within": pa.array(before + begin, pa.int64()), "n_tokens": pa.array(sizes, pa.int64()),
                   "ids": pa.array([raw[4 * a:4 * b] for a, b in zip(begin.tolist(), ends.tolist())], pa.binary())}
    files = spark.read.parquet(f"{path}/blocks")
    # one row per shard, of which a file set has no more than the writer's shuffle partitions
    sums = files.select("shard", F.aggregate("sizes", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("n"))
    shards = sums.groupBy("shard").agg(F.sum("n").alias("total"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    rows = map_batches(files, run, "shard bigint, doc_id bigint, within bigint, n_tokens bigint, ids binary")
    return rows.join(F.broadcast(shards), "shard").select(
        "doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids")


def token_path(spark: SparkSession) -> str:
    """A new place in the shared folder."""
    return f"{stage_root(spark)}/token-files-{uuid.uuid4().hex}"


def crc_column(df: DataFrame) -> DataFrame:
    """Replace ``ids`` by their checksum: Spark's ``crc32`` of the same bytes."""
    return df.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
