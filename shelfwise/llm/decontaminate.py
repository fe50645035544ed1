"""Benchmark decontamination: rare word pairs of the test items are joined to the texts, Smith-Waterman alignment scores the passages."""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.staging import stage
from shelfwise.llm.common import Words, chunks, map_batches, mix
from shelfwise.llm.simhash import text_key

PUNCTUATION = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
MATCH, MISMATCH, GAP = 2, -1, -1
PAIR_BASE = np.uint64(0xD6E8FEB86659FD93)
COMMON = 64                 # occurrences in the corpus beyond which a place of an item is no seed where the rest suffices
LEFT = 2                    # an item keeps 1 part in so many of the pairs it needs to be sought, whatever their counts
BLOCK_BYTES = 16 << 20      # benchmark text sent to the tasks at once


def normal_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    if not text:
        return []
    return text.decode("utf-8", "replace").lower().encode().translate(PUNCTUATION).split()


def pair_hashes(hashes: np.ndarray, ahead: int) -> np.ndarray:
    """Hash of each word with the one ``ahead`` places on; the same for every ``ahead``."""
    return mix(mix(hashes[:-ahead]) + hashes[ahead:] * PAIR_BASE)


class Items:
    """The word hashes and seeds (word pairs) of a block of test items.

    An alignment with a score of ``least`` of the item's own has M matches and at most ``2 * (M - least * m)`` edits for
    an item of m words, so at least ``least * m - 1`` of its matches are followed by the next one with at most one edit
    between: the two words are one or two apart in the item and in the text. ``need`` is that number, ``span`` the most
    words such a passage can have. An item may lose any of its places if ``need`` falls by one for each, so its places
    that are common in the corpus are left out and the rare ones sought: ``need`` of them within ``span`` words. These
    are bounds, so nothing is missed.
    """

    def __init__(self, ids: list[int], texts: list[bytes], gram: int, least: float):
        words = Words([normal_words(t) for t in texts])
        hashes = words.hashes()
        self.ids = ids
        self.words = [hashes[a:a + n] for a, n in zip(words.first.tolist(), words.counts.tolist())]
        self.need = np.ceil(least * words.counts - 1e-9).astype(np.int64) - 1
        self.span = words.counts + np.floor(2 * words.counts * (1 - least) + 1e-9).astype(np.int64)
        keys, item, offset = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, w in enumerate(self.words):
            if len(w) < gram or self.need[i] < 1:
                continue
            for ahead in (1, 2):
                g = pair_hashes(w, ahead)
                keys.append(g)
                item.append(np.full(len(g), i))
                offset.append(np.arange(len(g)))
        self.item, self.offset = np.concatenate(item), np.concatenate(offset)
        self.keys, self.seed = np.unique(np.concatenate(keys), return_inverse=True)
        self._maybe = None

    def choose(self, counts: np.ndarray) -> None:
        """Leave out the places of each item whose pairs occur most in the corpus; ``counts`` are those of ``keys``."""
        if not len(self.item):
            return
        _, first, place = np.unique(self.item * (self.offset.max() + 1) + self.offset, return_index=True, return_inverse=True)
        weight = np.bincount(place, weights=counts[self.seed])
        item = self.item[first]
        order = np.lexsort((self.offset[first], -weight, item))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        spare = self.need - np.maximum(1, self.need // LEFT)
        out = (rank < spare[item]) & (weight > COMMON)
        self.need = self.need - np.bincount(item[out], minlength=len(self.need))
        keep = ~out[place]
        self.item, self.offset = self.item[keep], self.offset[keep]
        used, seed = np.unique(self.seed[keep], return_inverse=True)
        self.keys, self.seed = self.keys[used], seed

    def table(self) -> pa.Table:
        """One row per seed and item that has it."""
        rows = np.unique(self.seed * len(self.ids) + self.item)
        seed, item = np.divmod(rows, max(1, len(self.ids)))
        return pa.table({"seed": pa.array(seed, pa.int32()), "item": pa.array(item, pa.int32()),
                         "need": pa.array(self.need[item], pa.int32()), "span": pa.array(self.span[item], pa.int32())})

    def hits(self, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(seed, place)`` of every seed in the texts."""
        if self._maybe is None:                     # most pairs fail at a table of their last bits
            bits = max(16, int(8 * len(self.keys)).bit_length())
            self._mask, self._maybe = np.uint64((1 << bits) - 1), np.zeros(1 << bits, bool)
            self._maybe[self.keys & self._mask] = True
        owner = np.repeat(np.arange(len(words.counts)), words.counts)
        seeds, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for ahead in (1, 2):
            if len(hashes) <= ahead or not len(self.keys):
                continue
            grams = pair_hashes(hashes, ahead)
            place = np.flatnonzero(self._maybe[grams & self._mask])
            place = place[owner[place] == owner[place + ahead]]
            seed = np.minimum(np.searchsorted(self.keys, grams[place]), len(self.keys) - 1)
            hit = self.keys[seed] == grams[place]
            seeds.append(seed[hit])
            places.append(place[hit])
        return np.concatenate(seeds), np.concatenate(places)


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman over words for pairs side by side: best local score of each, and where it ends in the passage."""
    m, n = max(map(len, items)), max(map(len, passages))
    a = np.zeros((len(items), m), np.uint64)
    b = np.zeros((len(items), n), np.uint64)
    for k, (x, y) in enumerate(zip(items, passages)):
        a[k, :len(x)] = x
        b[k, :len(y)] = y
    ramp = -GAP * np.arange(n + 1, dtype=np.int32)
    row = np.zeros((len(items), n + 1), np.int32)
    best, end = np.zeros(len(items), np.int32), np.zeros(len(items), np.int64)
    for i in range(m):
        x = a[:, i:i + 1]
        step = np.where((x == b) & (x != 0), MATCH, MISMATCH)
        fresh = np.zeros_like(row)
        np.maximum(row[:, :-1] + step, row[:, 1:] + GAP, out=fresh[:, 1:])
        np.maximum(fresh, 0, out=fresh)
        # gaps in the item: the running maximum of score + distance
        row = np.maximum.accumulate(fresh + ramp, axis=1) - ramp
        at = row.argmax(axis=1)
        top = row[np.arange(len(row)), at]
        better = top > best
        best[better], end[better] = top[better], at[better]
    return best, end


def _words_of(texts: list[bytes | None]):
    """``(slice, words, hashes)`` for runs of texts of bounded size."""
    for part in chunks(texts):
        words = Words([normal_words(t) for t in texts[part]])
        yield part, words, words.hashes()


def seed_counts(rows: DataFrame, items: Items) -> np.ndarray:
    """How often each seed occurs in all texts: tasks add up, so at most one number a seed and task is shuffled."""
    def run(batches):
        total = np.zeros(len(items.keys), np.int64)
        for batch in batches:
            for _, words, hashes in _words_of(batch.column("text").to_pylist()):
                total += np.bincount(items.hits(words, hashes)[0], minlength=len(total))
        seed = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"seed": pa.array(seed, pa.int32()), "n": pa.array(total[seed], pa.int64())})
    found = rows.select("text").mapInArrow(run, "seed int, n bigint").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(items.keys), np.int64)
    out[found["seed"].to_numpy()] = found["n"].to_numpy()
    return out


def candidates(rows: DataFrame, items: Items) -> DataFrame:
    """``(doc_id, tkey, found)``: texts with enough seeds of an item close together, the items and where such stretches begin."""
    def run(batch):
        ids, keys = batch.column("doc_id"), batch.column("tkey")
        for part, words, hashes in _words_of(batch.column("text").to_pylist()):
            seed, place = items.hits(words, hashes)
            text = np.searchsorted(words.first + words.counts, place, "right")
            at = pa.array(part.start + text)
            yield {"doc_id": ids.take(at), "tkey": keys.take(at), "seed": pa.array(seed, pa.int32()),
                   "place": pa.array(place - words.first[text] if len(text) else place, pa.int32())}
    hits = map_batches(rows, run, "doc_id bigint, tkey bigint, seed int, place int")
    near = (hits.join(rows.sparkSession.createDataFrame(items.table()), "seed")
            .groupBy("doc_id", "tkey", "item", "need", "span").agg(F.sort_array(F.collect_set("place")).alias("p"))
            .where(F.size("p") >= F.col("need")))
    begins = F.filter(F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda j: F.when(
        F.get("p", j + F.col("need") - 1) - F.get("p", j) < F.col("span"), F.get("p", j))), lambda x: x.isNotNull())
    return (near.select("doc_id", "tkey", "item", begins.alias("begins")).where(F.size("begins") > 0)
            .groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("item", "begins")).alias("found")))       # at most one entry an item


def stretches(begins: list[int], span: int, n: int) -> list[tuple[int, int]]:
    """What a passage of ``span`` words around these places may cover in a text of n words; long ones in overlapping pieces."""
    out: list[list[int]] = []
    for place in begins:
        a, b = max(place - span, 0), min(place + span, n)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(c, min(b, c + 8 * span)) for a, b in out for c in range(a, max(a + 1, b - span), 7 * span)]


def _matches(rows: DataFrame, items: Items, least: float) -> DataFrame:
    near = candidates(rows, items).select(F.col("doc_id").alias("_doc"), F.col("tkey").alias("_key"), "found")
    joined = rows.join(near, rows["doc_id"].eqNullSafe(F.col("_doc")) & (rows["tkey"] == F.col("_key")))

    def run(batch):
        found = batch.column("found").to_pylist()
        best_of: dict[tuple, tuple] = {}
        for part, words, hashes in _words_of(batch.column("text").to_pylist()):
            todo = []
            for t, (first, n) in enumerate(zip(words.first.tolist(), words.counts.tolist())):
                for f in found[part.start + t]:
                    for a, b in stretches(f["begins"], int(items.span[f["item"]]), n):
                        todo.append((part.start + t, f["item"], a, hashes[first + a:first + b]))
            todo.sort(key=lambda x: len(x[3]))
            for i in range(0, len(todo), 256):
                some = todo[i:i + 256]
                score, end = align([items.words[x[1]] for x in some], [x[3] for x in some])
                for (row, item, a, _), top, stop in zip(some, score.tolist(), end.tolist()):
                    share = top / (MATCH * len(items.words[item]))
                    if share >= least:
                        best_of[row, item] = max((share, a + stop), best_of.get((row, item), (-1.0, 0)))
        at = pa.array([row for row, _ in best_of], pa.int64())
        return {"doc_id": batch.column("doc_id").take(at), "tkey": batch.column("tkey").take(at),
                "item_id": pa.array([items.ids[i] for _, i in best_of], pa.int64()),
                "score": pa.array([v[0] for v in best_of.values()], pa.float64()),
                "end_word": pa.array([v[1] for v in best_of.values()], pa.int64())}
    return map_batches(joined.select("doc_id", "tkey", "text", "found"), run,
                       "doc_id bigint, tkey bigint, item_id bigint, score double, end_word bigint")


def benchmark_blocks(benchmark: DataFrame, gram: int, least: float, block_bytes: int, id_col: str, text_col: str):
    """The test items in blocks of bounded size, each collected when its turn comes."""
    rows = benchmark.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where(
        "text IS NOT NULL").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = total // block_bytes + 1
    for k in range(parts):
        block = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k).select("id", F.col("text").cast("binary")).collect()
        block.sort(key=lambda r: (r.id is None, r.id or 0, bytes(r.text)))
        yield Items([r.id for r in block], [bytes(r.text) for r in block], gram, least)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, gram: int = 3,
                 block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                 item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, score, end_word)``: documents with a passage like a test item.

    ``score`` is the best local alignment (match 2, mismatch and gap -1) over that of the item with itself, at
    least ``least``; one row per id and item, with the best score. The benchmark, the stated query set, is worked
    on in blocks of ``block_bytes``, one after the other. Per block documents are read three times: to count the
    seeds in the whole corpus, to join the rare ones with the items, and to align the texts with enough of them.
    Every pair of that score is found, however its edits are spread (:class:`Items`).

    Null and empty texts and items match nothing, nor do items shorter than ``gram`` words or of which one word
    alone would reach ``least``. Repeated ids are reported as one document, null ids as null. A very long text is
    aligned in overlapping pieces; of equal scores the later ``end_word`` counts; empty tables give an empty one.
    """
    found = _found(docs, benchmark, least, gram, block_bytes, id_col, text_col, item_id, item_text)
    place = F.struct("score", "end_word")
    return found.groupBy("doc_id", "item_id").agg(F.max(place).alias("m")).select("doc_id", "item_id", "m.score", "m.end_word")


def _found(docs: DataFrame, benchmark: DataFrame, least: float, gram: int, block_bytes: int, id_col: str, text_col: str, item_id: str,
           item_text: str) -> DataFrame:
    """The matches of every row, told apart by id and ``tkey``, a hash of the text."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_key(text_col).alias("tkey"),
                       F.col(text_col).cast("binary").alias("text"))
    found = None
    for items in benchmark_blocks(benchmark, gram, least, block_bytes, item_id, item_text):
        if not len(items.keys):
            continue
        items.choose(seed_counts(rows, items))
        part = stage(_matches(rows, items, least), "matches")           # a block's seeds leave the tasks before the next come
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], "doc_id bigint, tkey bigint, item_id bigint, score double, end_word bigint")
    return found


def clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, gram: int = 3, block_bytes: int = BLOCK_BYTES,
          id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows that have a passage as in :func:`contaminated`; rows that share an id, or have none, are
    judged each by its own text."""
    bad = _found(docs, benchmark, least, gram, block_bytes, id_col, text_col, item_id, item_text)
    bad = stage(bad.select(F.col("doc_id").alias("_bad"), F.col("tkey").alias("_key")).distinct(), "contaminated")
    return docs.join(bad, docs[id_col].cast("bigint").eqNullSafe(bad["_bad"]) & (text_key(text_col) == bad["_key"]), "left_anti")
