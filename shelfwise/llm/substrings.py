"""Substring deduplication over super-k-mers.

Windows of a fixed number of words are compared over all documents. Consecutive windows that share a
minimiser (the smallest hash of the word n-grams in them) travel as one packed string, so a word is sent
about three times instead of once per window. Equal windows have equal minimisers, so they meet in one
bucket, where sorting finds the first of each.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.staging import stage
from shelfwise.llm.common import Words, chunks, map_batches, mix, ngram_hashes, range_hashes

GRAM = 3                            # words of a minimiser
MAX_TASKS = 20_000                   # tasks that the buckets are dealt to at most
PART_BYTES = 16 << 20               # packed text that one bucket should hold
FLUSH_BYTES = 16 << 20              # packed text a task gathers before it sends
COUNTED = 1 << 20                   # super-k-mers counted before their sums are combined
FINE = 16                           # minimiser classes per bucket, for finding hot ones
NO_ID = -(1 << 63)                  # stands for a null id, which sorts first


class Packer:
    """Cuts texts into super-k-mers."""

    def __init__(self, window: int):
        self.window, self.gram = window, min(GRAM, window)

    def cut(self, texts: list[list[bytes]]):
        """``words, owner, start, stop, minimiser``: super-k-mers as ranges of window starts (word indices)."""
        words = Words(texts)
        n = len(words.starts)
        if n < self.window:
            return words, *(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint64)
        grams = ngram_hashes(words.hashes(), self.gram)
        least, span, want = grams, 1, self.window - self.gram + 1
        while span < want:                                  # minima over spans that double
            step = min(span, want - span)
            least, span = np.minimum(least[:len(least) - step], least[step:]), span + step
        owner = words.text_of(self.window)[:n - self.window + 1]
        cut = np.flatnonzero((owner[1:] != owner[:-1]) | (least[1:] != least[:-1])) + 1
        start = np.concatenate([[0], cut])
        stop = np.append(cut, len(owner))
        real = owner[start] >= 0
        start, stop = start[real], stop[real]
        return words, owner[start], start, stop, least[start]


def classes(minimiser: np.ndarray, fine: int) -> np.ndarray:
    return (mix(minimiser) % np.uint64(fine)).astype(np.int64)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc`` (null as the smallest id), ``tkey`` to tell rows with the same id apart, and ``text``."""
    return docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("doc"),
                       F.xxhash64(F.col(text_col).cast("string")).alias("tkey"), F.col(text_col).cast("binary").alias("text"))


def _load(rows: DataFrame, window: int, fine: int) -> DataFrame:
    """Packed bytes of each minimiser class."""
    packer = Packer(window)

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def summed():
            kinds, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return kinds, np.bincount(where, np.concatenate([n for _, n in held]), len(kinds))

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in chunks(texts):
                words, _, start, stop, least = packer.cut([(t or b"").split() for t in texts[part]])
                if len(start):
                    held.append((classes(least, fine), words.ends[stop + window - 2] - words.starts[start]))
                    waiting += len(start)
                if waiting > COUNTED:
                    held, waiting = [summed()], 0
        if held:
            kinds, size = summed()
            yield pa.RecordBatch.from_pydict({"kind": pa.array(kinds, pa.int64()), "bytes": pa.array(size.astype(np.int64), pa.int64())})
    return rows.select("text").mapInArrow(run, "kind bigint, bytes bigint").groupBy("kind").agg(F.sum("bytes").alias("bytes"))


def _pack(window: int, fine: int, parts: int, hot: dict[int, int]):
    packer = Packer(window)

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush():
            part = np.concatenate([h[0] for h in held])
            ids = [np.concatenate([h[i] for h in held]) for i in (1, 2, 3, 4)]
            strings = [s for h in held for s in h[5]]
            order = np.argsort(part, kind="stable")
            cut = np.flatnonzero(np.diff(part[order])) + 1
            press = zstandard.ZstdCompressor(level=3)
            out = []
            for of in np.split(order, cut):
                head = struct.pack("<q", len(of)) + b"".join(a[of].tobytes() for a in ids)
                out.append(press.compress(head + b"\n".join([strings[i] for i in of.tolist()])))
            first = np.concatenate([[0], cut])
            return pa.RecordBatch.from_pydict({"part": pa.array(part[order][first], pa.int64()), "blob": pa.array(out, pa.binary())})

        for batch in batches:
            texts, docs, keys = batch.column("text").to_pylist(), batch.column("doc").to_numpy(), batch.column("tkey").to_numpy()
            for piece in chunks(texts):
                words, owner, start, stop, least = packer.cut([(t or b"").split() for t in texts[piece]])
                if not len(start):
                    continue
                kind = classes(least, fine)
                own = np.zeros(len(kind), np.uint64)        # hot classes are dealt further by the row they come from
                salts = np.array([hot.get(k, 1) for k in kind.tolist()], np.int64)
                salted = salts > 1
                if salted.any():
                    own[salted] = mix(keys[piece][owner[salted]].view(np.uint64) + start[salted].astype(np.uint64)) % salts[salted].astype(np.uint64)
                part = (mix(kind.astype(np.uint64) * np.uint64(1 << 20) + own) % np.uint64(parts)).astype(np.int64)
                joined = words.joined
                a, b = words.starts[start], words.ends[stop + window - 2]
                strings = [joined[x:y] for x, y in zip(a.tolist(), b.tolist())]
                held.append((part, docs[piece][owner], keys[piece][owner], (start - words.first[owner]).astype(np.int64), salted, strings))
                size += int((b - a).sum())
                if size >= FLUSH_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
    return run


def first_windows(blobs: list[bytes], window: int):
    """Sorts all windows of a bucket: ``doc, tkey, start`` of the repeats, and the firsts of hot classes."""
    heads, strings = [[] for _ in range(4)], []
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = struct.unpack_from("<q", raw)[0]
        at = 8
        for k, kind in enumerate((np.int64, np.int64, np.int64, np.bool_)):
            heads[k].append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        strings.append(raw[at:])
    doc, tkey, begin, hot = (np.concatenate(h) for h in heads)
    text = b"\n".join(strings)
    data = np.frombuffer(text, np.uint8)
    line = np.append(np.flatnonzero(data == 10), len(data))
    ends = np.append(np.flatnonzero((data == 10) | (data == 32)), len(data))
    starts = np.concatenate([[0], ends[:-1] + 1])
    owner = np.searchsorted(line, ends)                     # super-k-mer of each word
    word = range_hashes(data, starts, ends, 0x9E3779B97F4A7C15)
    at = np.flatnonzero(owner[:len(owner) - window + 1] == owner[window - 1:])
    one = range_hashes(word, at, at + window, 0xD6E8FEB86659FD93)
    own = owner[at]
    word_first = np.searchsorted(owner, np.arange(len(doc)))
    start = begin[own] + at - word_first[own]
    order = np.argsort(one, kind="stable")
    sorted_one = one[order]
    same = sorted_one[1:] == sorted_one[:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    lone = order[~twice]
    busy = order[twice]
    busy = busy[np.lexsort((start[busy], doc[own[busy]], one[busy]))]
    lead = np.flatnonzero(np.concatenate([[True], one[busy][1:] != one[busy][:-1]])) if len(busy) else np.zeros(0, np.int64)
    leader = np.repeat(busy[lead], np.diff(np.append(lead, len(busy))))
    lo, hi = starts[at], ends[at + window - 1]
    pairs = zip(lo[busy].tolist(), hi[busy].tolist(), lo[leader].tolist(), hi[leader].tolist())
    alike = np.fromiter((text[a:b] == text[c:d] for a, b, c, d in pairs), bool, len(busy))
    if not alike.all():                                     # unequal windows with equal hashes: tell them apart by text
        seen: dict[bytes, int] = {}
        leader = np.array([seen.setdefault(text[lo[i]:hi[i]], i) for i in busy.tolist()])
    later = (doc[own[busy]] != doc[own[leader]]) | (start[busy] != start[leader])
    repeat = busy[later]
    first = np.concatenate([lone, busy[~later]])
    first = first[hot[own[first]]]
    grams = [text[a:b] for a, b in zip(lo[first].tolist(), hi[first].tolist())]
    pick = [(doc[own[i]], tkey[own[i]], start[i]) for i in (repeat, first)]
    return pick[0], pick[1], grams


def runs(doc: np.ndarray, tkey: np.ndarray, start: np.ndarray):
    """Consecutive window starts of a row as ``[from, to)``."""
    order = np.lexsort((start, tkey, doc))
    d, k, s = doc[order], tkey[order], start[order]
    new = np.flatnonzero((d[1:] != d[:-1]) | (k[1:] != k[:-1]) | (s[1:] > s[:-1] + 1)) + 1
    a = np.concatenate([[0], new]).astype(np.int64)[:len(d)]
    return d[a], k[a], s[a], s[np.append(new, len(d)) - 1] + 1 if len(d) else s


def _scan(window: int):
    schema = pa.schema([("doc", pa.int64()), ("tkey", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("gram", pa.binary())])

    def result(blobs):
        repeat, first, grams = first_windows(blobs, window)
        d, k, a, b = runs(*repeat)
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(k), pa.array(a), pa.array(b), pa.nulls(len(d), pa.binary())], schema=schema)
        if grams:
            d, k, a = first
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(k), pa.array(a), pa.array(a + 1), pa.array(grams, pa.binary())], schema=schema)

    def run(batches):
        now, blobs = None, []
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist()):
                if part != now and blobs:
                    yield from result(blobs)
                    blobs = []
                now = part
                blobs.append(blob)
        if blobs:
            yield from result(blobs)
    return run


def repeated_windows(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text",
                     part_bytes: int = PART_BYTES) -> DataFrame:
    """``(doc, tkey, runs)``: for each row, ranges of window starts whose words also start earlier.

    Earlier: a smaller id, or the same id and an earlier start. Null ids come first.
    """
    rows = _rows(docs, id_col, text_col)
    total = 3 * (docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // part_bytes + 1)
    fine = FINE * parts
    # at most four hot classes per bucket's worth of text
    heavy = _load(rows, window, fine).where(F.col("bytes") > part_bytes // 4).collect()
    hot = {r.kind: -(-r.bytes // (part_bytes // 8)) for r in heavy}
    packed = rows.mapInArrow(_pack(window, fine, parts, hot), "part bigint, blob binary")
    tasks = min(parts, MAX_TASKS)                           # beyond that a task sorts several buckets, one after the other
    found = stage(packed.repartitionById(tasks, (F.col("part") % tasks).cast("int")).sortWithinPartitions("part").mapInArrow(
        _scan(window), "doc bigint, tkey bigint, start bigint, stop bigint, gram binary"), "repeats")
    marks = found.where("gram IS NULL").select("doc", "tkey", "start", "stop")
    if hot:
        # the firsts of a hot class's shares: at most one per share and window, so the groups are small
        place = F.struct("doc", "start")
        late = (found.where("gram IS NOT NULL").withColumn("least", F.min(place).over(Window.partitionBy("gram")))
                .where(place != F.col("least")).select("doc", "tkey", "start", "stop"))
        marks = marks.unionByName(late)
    return marks.groupBy("doc", "tkey").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))


def dedup_substrings(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text",
                     part_bytes: int = PART_BYTES) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also starts earlier in the corpus.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, unchanged; windows are judged on the input.
    Returns one row per input row: ``doc_id, text`` (kept words joined by one space), ``n_words, n_removed``.

    Null or empty text: no words. Texts shorter than the window: kept whole. Rows that share an id do not
    remove each other's windows that start at the same place; a null id counts as the smallest.
    """
    marks = repeated_windows(docs, window, id_col, text_col, part_bytes)

    def run(batch):
        out: dict[str, list] = {"text": [], "n_words": [], "n_removed": []}
        for text, ranges in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
            words = (text or b"").split()
            keep = np.ones(len(words), bool)
            for r in ranges or ():
                keep[r["start"]:r["stop"] + window - 1] = False
            kept = words if keep.all() else [words[i] for i in np.flatnonzero(keep).tolist()]
            out["text"].append(b" ".join(kept))
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(kept))
        return {"doc_id": batch.column("doc_id"), "text": pa.array(out["text"], pa.binary()),
                "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64())}

    joined = _rows(docs, id_col, text_col).join(marks, ["doc", "tkey"], "left").select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "text", "runs")
    done = map_batches(joined, run, "doc_id bigint, text binary, n_words bigint, n_removed bigint")
    return done.withColumn("text", F.col("text").cast("string"))
