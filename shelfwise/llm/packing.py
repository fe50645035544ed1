"""Packing token streams into fixed windows, documents in the order of the rows.

Windows end at document or sentence boundaries where that is worth it: a dynamic program over the
possible cuts minimises padding plus a price per cut inside a document. The best predecessor of a cut is
the least of ``cost + place`` over the cuts within reach, kept in a monotone queue, so a block of text is
solved in time linear in its cuts.
"""

from __future__ import annotations

import zlib
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.tokens import Encoder, texts_of

STREAM_BITS = 33        # sequence ids: partition << 33 | number within it


@dataclass(frozen=True)
class Costs:
    """In padded tokens. ``far``: the longest stretch without a possible cut."""

    window: int = 1024
    sentence: float = 1.0
    inside: float = 6.0
    far: int = 256


def possible_cuts(ids: np.ndarray, ends_sentence: np.ndarray, doc_ends: np.ndarray, costs: Costs) -> tuple[np.ndarray, np.ndarray]:
    """Places (ids before them) where a window may end, rising, with their price."""
    n = len(ids)
    price = np.full(n + 1, np.inf)
    known = np.flatnonzero(ends_sentence) + 1
    price[known] = costs.sentence
    price[doc_ends] = 0.0
    price[0] = price[n] = 0.0
    known = np.flatnonzero(np.isfinite(price))
    for a, gap in zip(known[:-1][np.diff(known) > costs.far].tolist(), np.diff(known)[np.diff(known) > costs.far].tolist()):
        price[a + costs.far:a + gap:costs.far] = costs.inside
    # a full window from any of them is possible too
    known = np.flatnonzero(np.isfinite(price))
    full = known + costs.window
    full = full[full < n]
    full = full[~np.isfinite(price[full])]
    price[full] = costs.inside
    at = np.flatnonzero(np.isfinite(price))
    return at, price[at]


def best_cuts(at: np.ndarray, price: np.ndarray, costs: Costs) -> list[int]:
    """Window ends from the first place to the last at the least total cost.

    A window is padded to the full length unless its length is a power of two; of those, a half, a quarter
    and an eighth of the window are tried everywhere and the smaller ones at the end of the block.
    """
    places, prices = at.tolist(), price.tolist()
    n, width, last = len(places), costs.window, places[-1]
    index = np.full(last + 1, -1, np.int64)
    index[at] = np.arange(n)
    halves = [width >> k for k in (1, 2, 3)]
    short = [[-1] * n for _ in halves]
    for row, size in zip(short, halves):
        far = np.flatnonzero(at >= size)
        if len(far):
            row[far[0]:] = index[at[far] - size].tolist()
    small = [1 << k for k in range(width.bit_length())]
    cost, back, key = [0.0] * n, [0] * n, [0.0] * n
    queue: deque[int] = deque([0])          # candidates, rising cost + place
    for j, lists in enumerate(zip(*short)):
        if not j:
            continue
        p = places[j]
        while places[queue[0]] < p - width:
            queue.popleft()
        i = queue[0]
        best = key[i] + width - p
        for k in lists:                     # exact lengths cost no padding
            if k >= 0 and cost[k] < best:
                best, i = cost[k], k
        if last - p < width:                # near the end of the block all of them are tried
            for size in small:
                k = int(index[p - size]) if p >= size else -1
                if k >= 0 and cost[k] < best:
                    best, i = cost[k], k
        best += prices[j]
        cost[j], back[j] = best, i
        key[j] = now = best + p
        while queue and key[queue[-1]] >= now:
            queue.pop()
        queue.append(j)
    out, j = [], n - 1
    while j:
        out.append(places[j])
        j = back[j]
    return out[::-1]


def pack_block(ids: np.ndarray, ends_sentence: np.ndarray, doc_ends: np.ndarray, costs: Costs):
    """Pieces ``(document, start, stop, window, offset)`` of a block; starts count from the block's first id."""
    if not len(ids):
        return np.zeros((0, 5), np.int64)
    ends = np.array(best_cuts(*possible_cuts(ids, ends_sentence, doc_ends, costs), costs))
    stops = np.union1d(ends, doc_ends)
    stops = stops[stops > 0]
    starts = np.concatenate([[0], stops[:-1]])
    window = np.searchsorted(ends, stops)
    first = np.concatenate([[0], ends])[window]
    return np.stack([np.searchsorted(doc_ends, stops), starts, stops, window, starts - first], axis=1)


def _sentence_ids(tokenizer: str) -> np.ndarray:
    """Which ids end a sentence: their text ends in ``. ! ?`` or a line break, also before closing marks."""
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer)
    size = t.get_vocab_size()
    return np.array([(s := t.decode([i], skip_special_tokens=False).rstrip("\"')] ")) != "" and s[-1] in ".!?\n" for i in range(size)])


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, costs: Costs = Costs(), block_ids: int = 1 << 17,
                   keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents; one row per piece of a document in a window.

    ``doc_id, start`` (ids of the document before it), ``length``, ``ids`` (if ``keep_ids``), ``ids_crc32``,
    ``doc_tokens`` (with the end id), ``sequence_id, offset`` (in the window) and ``padded`` (length of the
    window with padding).

    Every input partition packs its own rows in their order, in blocks of whole documents with at least
    ``block_ids`` ids, so nothing is shuffled and memory holds one block (or one document, if that is
    longer). Null and empty texts are the end id alone; rows that repeat or lack an id are packed like others.
    """
    encoder, ends = Encoder(tokenizer), _sentence_ids(tokenizer)
    end, size = np.array([end_id], encoder.kind).tobytes(), int(encoder.kind[2])
    width = costs.window

    def run(batches):
        number = TaskContext.get().partitionId() << STREAM_BITS
        held_docs: list = []
        held: list[bytes] = []
        total = 0

        def solve():
            nonlocal number
            ids = np.frombuffer(b"".join(held), encoder.kind)
            raw = ids.astype("<u4").tobytes()
            sizes = np.array([len(h) // size for h in held])
            doc_ends = np.cumsum(sizes)
            pieces = pack_block(ids, ends[ids], doc_ends, costs)
            doc, start, stop, window, offset = pieces.T
            used = np.zeros(int(window[-1]) + 1, np.int64)
            np.maximum.at(used, window, offset + stop - start)
            padded = np.where(used & (used - 1), width, used)
            parts = [raw[4 * a:4 * b] for a, b in zip(start.tolist(), stop.tolist())]
            cols = {"doc_id": pa.array([held_docs[i] for i in doc.tolist()], pa.int64()),
                    "start": pa.array(start - (doc_ends - sizes)[doc], pa.int64()), "length": pa.array(stop - start, pa.int64()),
                    "ids": pa.array(parts if keep_ids else [None] * len(parts), pa.binary()),
                    "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64()), "doc_tokens": pa.array(sizes[doc], pa.int64()),
                    "sequence_id": pa.array(window + number, pa.int64()), "offset": pa.array(offset, pa.int64()),
                    "padded": pa.array(padded[window], pa.int64())}
            number += len(used)
            return pa.RecordBatch.from_pydict(cols)

        for batch in batches:
            for i, texts in texts_of(batch):
                for doc, ids in zip(batch.column("doc_id").slice(i, len(texts)).to_pylist(), encoder.encode(texts)):
                    held_docs.append(doc)
                    held.append(ids + end)
                    total += len(ids) // size + 1
                    if total >= block_ids:
                        yield solve()
                        held_docs, held, total = [], [], 0
        if held:
            yield solve()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids binary, ids_crc32 bigint, doc_tokens bigint, "
                                "sequence_id bigint, offset bigint, padded bigint")
