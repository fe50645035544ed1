"""What several operators share: table access, Arrow batches, words and their hashes, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.staging import stage

CHUNK_BYTES = 2 << 20       # text worked on at once by the vectorised helpers
SLICE = 1 << 17             # ranges hashed at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict] | dict | None], schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one batch that returns columns (or yields them)."""
    def run(batches):
        for batch in batches:
            out = fn(batch)
            for cols in ([out] if isinstance(out, dict) else out or ()):
                yield pa.RecordBatch.from_pydict(cols)
    return df.mapInArrow(run, schema)


def chunks(texts: list[bytes | None], limit: int = CHUNK_BYTES) -> Iterator[slice]:
    """Runs of consecutive texts of about ``limit`` bytes; one long text is a run of its own."""
    first = total = 0
    for i, t in enumerate(texts):
        total += len(t or b"")
        if total >= limit:
            yield slice(first, i + 1)
            first, total = i + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverses modulo 2**64, at least ``n`` of each (``base`` is odd)."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 20)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _POWERS[base] = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash modulo 2**64 of each ``values[start:end]`` (both rising), from running sums over slices of them."""
    out = np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), SLICE):
        first, last = starts[i:i + SLICE], ends[i:i + SLICE]
        part = values[first[0]:last[-1]].astype(np.uint64)
        part += np.uint64(1)                                # a zero is a value too
        power, inverse = _powers(base, len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        part *= power[:len(part)]
        np.cumsum(part, out=sums[1:])
        out[i:i + SLICE] = mix((sums[last - first[0]] - sums[first - first[0]]) * inverse[first - first[0]])
    return out


class Words:
    """The words of some texts, laid out one after the other.

    ``joined``: all words with one space between; ``starts``/``ends``: a word's bytes there;
    ``counts``: words of each text; ``first``: index of each text's first word.
    """

    def __init__(self, split: list[list[bytes]]):
        flat = [w for words in split for w in words]
        self.joined = b" ".join(flat)
        lens = np.fromiter(map(len, flat), np.int64, len(flat))
        self.ends = np.cumsum(lens + 1) - 1
        self.starts = self.ends - lens
        self.counts = np.fromiter(map(len, split), np.int64, len(split))
        self.first = np.cumsum(self.counts) - self.counts

    def hashes(self, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        return range_hashes(np.frombuffer(self.joined, np.uint8), self.starts, self.ends, base)

    def text_of(self, n: int) -> np.ndarray:
        """For every n-gram start (all but the last ``n - 1`` words of a text): its text; -1 elsewhere."""
        owner = np.repeat(np.arange(len(self.counts)), self.counts)
        left = np.repeat(self.first + self.counts, self.counts) - np.arange(len(owner))
        return np.where(left >= n, owner, -1)


def ngram_hashes(hashes: np.ndarray, n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of the ``n`` words from each position on (the last ``n - 1`` positions get none)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    at = np.arange(len(hashes) - n + 1)
    return range_hashes(mix(hashes), at, at + n, base)


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is the smallest node of its component.

    Alternating stars: neighbours above a node are tied to the smallest neighbour, then those below.
    Every round is one aggregation and one join, so a node with very many neighbours is combined on
    the map side; each is written to the shared folder, and one row per round reaches the driver.
    """
    tie = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    tie = stage(tie.distinct(), "edges")
    before = None
    while True:
        both = tie.unionByName(tie.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(large.distinct(), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        tie = stage(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "small")
        state = tie.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return tie.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
