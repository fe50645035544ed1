"""Phrase collocations by set-oriented mining of occurrence relations.

The relation of length 1 holds the frequent words of every piece in order. A longer one is merge-joined from it: places
where a frequent phrase is followed by the next word of its piece. Phrases are counted by group, and only places of
frequent ones are kept in the next relation, which is written before it is extended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.keys import dense_index
from shelfwise.functions.staging import discard, stage

CHUNK = 16 << 20            # bytes of text whose occurrences are one row of a relation
HELD = 4 * CHUNK            # text that a task holds over all its languages
SCALE = 2_000_000
BREAK = b"."                # no word: pieces end there
#: A-Z lower-cased; ends of pieces become full stops, tabs spaces
TABLE = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?" or 10 <= c <= 13 else 32 if c == 9 else c for c in range(256))
RELATION = "chunk bigint, lang string, size bigint, places binary"


def words(texts: list[bytes]) -> list[bytes]:
    """Words of all texts, with a full stop between pieces."""
    return b" . ".join(texts).translate(TABLE).replace(BREAK, b" . ").split()


def _packed(places: np.ndarray) -> bytes:
    return pa.compress(places.astype("<i4").tobytes(), "zstd", asbytes=True)


def _places(size: int, packed: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, 4 * size, "zstd", asbytes=True), "<i4")


def _read(chunk_bytes: int):
    """Chunks of one language each: distinct words, their counts, and the words' places in order (-1: a piece ends)."""
    def run(batches):
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def chunk(lang):
            nonlocal number
            names = pa.array(words(held.pop(lang)), pa.binary()).dictionary_encode()
            del size[lang]
            places, names = names.indices.to_numpy(), names.dictionary
            counts = np.bincount(places, minlength=len(names))
            stop = names.index(BREAK).as_py()
            places = places.astype(np.int32)
            if stop >= 0:
                counts[stop] = 0
                places[places == stop] = -1
            number += 1
            return pa.RecordBatch.from_pydict({
                "chunk": pa.array([number], pa.int64()), "lang": pa.array([lang], pa.string()),
                "size": pa.array([len(places)], pa.int64()), "places": pa.array([_packed(places)], pa.binary()),
                "words": pa.ListArray.from_arrays([0, len(names)], names.cast(pa.string())),
                "counts": pa.ListArray.from_arrays([0, len(names)], pa.array(counts, pa.int64()))})

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                held.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text)
                if size[lang] >= chunk_bytes:
                    yield chunk(lang)
                elif sum(size.values()) >= HELD:
                    yield chunk(max(size, key=size.get))
        for lang in list(held):
            yield chunk(lang)
    return run


def runs(places: np.ndarray) -> np.ndarray:
    """One -1 between runs, none at the ends."""
    word = places >= 0
    keep = word | np.append(False, word[:-1])
    out = places[keep]
    return out[:-1] if len(out) and out[-1] < 0 else out


def windows(places: np.ndarray, k: int) -> np.ndarray:
    """Places from which ``k`` words follow each other."""
    if len(places) < k:
        return np.zeros(0, np.int64)
    ok = places[:len(places) - k + 1] >= 0
    for j in range(1, k):
        ok = ok & (places[j:len(places) - k + 1 + j] >= 0)
    return np.flatnonzero(ok)


def grams(places: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct phrases at ``at``: place of one, phrase number of every place, occurrences, and what :func:`located`
    needs. Exact: the number of the shorter phrase and the next word make one 64-bit number."""
    number, levels = places[at].astype(np.int64), []
    for j in range(1, k):
        if j > 1:
            level, number = np.unique(number, return_inverse=True)
            levels.append(level)
        number = number << 32 | places[at + j].astype(np.int64)
    level, first, number, n = np.unique(number, return_index=True, return_inverse=True, return_counts=True)
    return at[first], number, n, [*levels, level]


def located(levels: list[np.ndarray], phrase: list[np.ndarray]) -> np.ndarray:
    """Numbers of phrases (a column per word) that occur among those of ``grams``."""
    number = phrase[0].astype(np.int64)
    for level, word in zip(levels, phrase[1:]):
        number = np.searchsorted(level, number << 32 | word.astype(np.int64))
    return number


def _rows(chunk: int | None, places: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    first, _, n, _ = grams(places, windows(places, k), k)
    for i in range(0, len(first), 1 << 18):
        some = first[i:i + (1 << 18)]
        cols = {f"w{j}": pa.array(places[some + j]) for j in range(k)}
        own = {} if chunk is None else {"chunk": pa.repeat(pa.scalar(chunk, pa.int64()), len(some))}
        # what repeats from row to row comes first, which compresses well
        yield pa.RecordBatch.from_pydict({"w0": cols.pop("w0")} | own | {"n": pa.array(n[i:i + len(some)], pa.int64())} | cols)


def _count(k: int):
    """Distinct phrases of ``k`` words of every chunk."""
    def run(batches):
        for batch in batches:
            for row in batch.select(["chunk", "size", "places"]).to_pylist():
                yield from _rows(row["chunk"], _places(row["size"], row["places"]), k)
    return run


def _count_last(k: int):
    """Distinct phrases of all chunks of a language that a task reads, some at a time: no place is looked for again."""
    def run(batches):
        held: dict[str, list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            for row in batch.select(["lang", "size", "places"]).to_pylist():
                held.setdefault(row["lang"], []).extend((_places(row["size"], row["places"]), np.full(1, -1, np.int32)))
                size += row["size"]
                if size >= HELD // 4:
                    for parts in held.values():
                        yield from _rows(None, np.concatenate(parts), k)
                    held, size = {}, 0
        for parts in held.values():
            yield from _rows(None, np.concatenate(parts), k)
    return run


def _relation(key, lang: str, places: np.ndarray) -> pa.Table:
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "lang": pa.array([lang], pa.string()),
                     "size": pa.array([len(places)], pa.int64()), "places": pa.array([_packed(places)], pa.binary())})


def _frequent_words(key, left, right):
    """The relation of frequent words, by their ids."""
    if not right.num_rows:
        return left.slice(0, 0)
    row = left.to_pylist()[0]
    places = _places(row["size"], row["places"])
    local = right.column("local").to_numpy()
    ids = np.full(max(int(local.max()), int(places.max(initial=0))) + 2, -1, np.int32)      # the last place stands for -1
    ids[local] = right.column("id").to_numpy()
    ids[-1] = -1
    return _relation(key, row["lang"], runs(ids[places]))


def _frequent(k: int):
    """The relation cut where a phrase of ``k`` words is not frequent: phrases of a run overlap by all but a word."""
    def run(key, left, right):
        if not right.num_rows:
            return left.slice(0, 0)
        row = left.to_pylist()[0]
        places = _places(row["size"], row["places"])
        at = windows(places, k)
        first, number, _, levels = grams(places, at, k)
        good = np.zeros(len(first), bool)
        good[located(levels, [right.column(f"w{j}").to_numpy() for j in range(k)])] = True
        at = at[good[number]]
        begins = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1))
        length = np.diff(np.append(begins, len(at))) + k                # the words of a run, and its end
        out = np.cumsum(length)
        index = np.arange(out[-1]) - np.repeat(out - length, length) + np.repeat(at[begins], length)
        found = places[np.minimum(index, len(places) - 1)]
        found[out - 1] = -1
        return _relation(key, row["lang"], found[:-1])
    return run


def _ratio(top: Column, total: Column) -> Column:
    """``floor(SCALE * top / total)``, exact however large."""
    return F.call_function("div", top.cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), total.cast("decimal(20,0)"))


def phrases(docs: DataFrame, longest: int = 4, least: int = 30, cover: int = 80, chunk_bytes: int = CHUNK, text_col: str = "text",
            lang_col: str = "lang") -> DataFrame:
    """``(lang, phrase, a, l, r, n, score)``: phrases of 2 to ``longest`` words with ``a >= least`` occurrences in a language.

    Texts (A-Z lower-cased) are cut at ``[.,;:!?\\\\x0A-\\\\x0D]``, words are ``[^\\\\x20\\\\x09]+``; occurrences lie within a piece and may
    overlap. ``l`` and ``r`` count the two parts at the cut whose score ``floor(2000000 a / (l + r))`` is lowest (the
    first of equal ones), ``n`` all words of the language. A phrase is left out if some longer frequent one around it
    has ``cover`` per cent of its occurrences or more. A null language is ``und``, a null text empty; rows that repeat an id
    all count; other columns are ignored; texts of any length are read whole; an empty table gives no rows.

    A row of a relation is a chunk of one language, so what a task holds is bounded. Counts are combined per chunk
    before they are shuffled, so the commonest phrase has one row a chunk. The semi-join sends phrases back by number.
    """
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    base = stage(rows.mapInArrow(_read(chunk_bytes), f"{RELATION}, words array<string>, counts array<bigint>"), "occurrences")
    totals = base.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda x, y: x + y)).alias("n"))
    own = base.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("local", "s"))
    own = own.select("chunk", "lang", "local", F.col("s.words").alias("word"), F.col("s.counts").alias("n")).where("n > 0")
    known = own.groupBy("lang", "word").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    known = stage(known.select(F.struct("lang", "word").alias("key"), "a"), "frequent-words")
    names = stage(dense_index(known, "key", "id").select("key.lang", "key.word", "id", "a"), "word-ids")
    hits = own.join(names.select("lang", "word", "id"), ["lang", "word"]).select(F.col("chunk").alias("of"), "local", "id")
    relation = stage(base.select("chunk", "lang", "size", "places").groupBy("chunk").cogroup(hits.groupBy("of"))
                     .applyInArrow(_frequent_words, RELATION), "places-1")
    counted = [names.select(F.array("id").alias("key"), "a")]
    for k in range(2, longest + 1):
        ids = [f"w{j}" for j in range(k)]
        rest = "".join(f", {c} int" for c in ids[1:])
        if k == longest:
            hits = relation.mapInArrow(_count_last(k), f"w0 int, n bigint{rest}").groupBy(*ids).agg(F.sum("n").alias("a"))
            counted.append(hits.where(F.col("a") >= least).select(F.array(*ids).alias("key"), "a"))
            break
        all_of = F.sum("n").over(Window.partitionBy(*ids))
        hits = relation.mapInArrow(_count(k), f"w0 int, chunk bigint, n bigint{rest}").withColumn("a", all_of)
        hits = stage(hits.where(F.col("a") >= least).select("chunk", *ids, "a"), f"frequent-{k}")
        counted.append(hits.select(F.array(*ids).alias("key"), "a").distinct())
        found = hits.select(F.col("chunk").alias("of"), *ids).groupBy("of")
        old, relation = relation, stage(relation.groupBy("chunk").cogroup(found).applyInArrow(_frequent(k), RELATION), f"places-{k}")
        discard(old)
    counts = counted[0]
    for more in counted[1:]:
        counts = counts.unionByName(more)
    counts = stage(counts, "phrase-counts")
    long = counts.where(F.size("key") > 1)

    cuts = long.select("key", "a", F.explode(F.sequence(F.lit(1), F.size("key") - 1)).alias("k"))
    cuts = cuts.select("key", "a", "k", F.slice("key", 1, F.col("k")).alias("left"),
                       F.slice("key", F.col("k") + 1, F.size("key") - F.col("k")).alias("right"))
    cuts = cuts.join(counts.select(F.col("key").alias("left"), F.col("a").alias("l")), "left")
    cuts = cuts.join(counts.select(F.col("key").alias("right"), F.col("a").alias("r")), "right")
    worst = F.min(F.struct(_ratio(F.col("a"), F.col("l") + F.col("r")).alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("key").agg(F.max("a").alias("a"), worst)

    inner = long.where(F.size("key") > 2).select("a", "key", F.explode(F.sequence(F.lit(2), F.size("key") - 1)).alias("m"))
    inner = inner.select("a", "key", "m", F.explode(F.sequence(F.lit(1), F.size("key") - F.col("m") + 1)).alias("at"))
    inner = inner.groupBy(F.slice("key", F.col("at"), F.col("m")).alias("key")).agg(F.max("a").alias("longer"))
    scored = scored.join(inner, "key", "left").where((100 * F.coalesce("longer", F.lit(0))) < cover * F.col("a"))

    spelt = scored.select("key", "a", "cut", F.posexplode("key").alias("at", "id")).join(names.select("id", "lang", "word"), "id")
    spelt = spelt.groupBy("key", "lang").agg(F.first("a").alias("a"), F.first("cut").alias("cut"),
                                             F.sort_array(F.collect_list(F.struct("at", "word"))).alias("s"))
    phrase = F.array_join(F.transform("s", lambda x: x["word"]), " ")
    return spelt.join(totals, "lang").select("lang", phrase.alias("phrase"), "a", "cut.l", "cut.r", "n", F.col("cut.score").alias("score"))


def top_phrases(docs: DataFrame, top: int = 2000, **options) -> DataFrame:
    """The first ``top`` phrases of every language by score, then occurrences, then UTF-8 bytes, with their ``rank``."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return phrases(docs, **options).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
