"""SimHash near-duplicates: one-wildcard segment variants, equality grouping, verification."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.staging import discard, stage
from shelfwise.llm.common import Words, chunks, components, map_batches, ngram_hashes

BITS = 64
GROUP_LIMIT = 512       # larger groups of equal variants are linked by shared neighbourhoods instead


def fingerprint(words: list[bytes], shingle: int) -> int:
    """Majority bits of the XXH64 (seed 42) of all ``shingle``-word runs; 0 without words."""
    if not words:
        return 0
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    last = ends[min(shingle, len(words)) - 1:].tolist()
    first = (ends - lens)[:len(last)].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(first, last)), np.uint64, len(last))
    ones = np.zeros(BITS, np.int64)
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, tkey, fp)``: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, whole texts; null text: no words.

    ``tkey`` (a hash of the text) tells rows with the same id apart.
    """
    def run(batch):
        texts = batch.column("text").to_pylist()
        return {"doc_id": batch.column("doc_id"), "tkey": batch.column("tkey"),
                "fp": pa.array([fingerprint((t or b"").lower().split(), shingle) for t in texts], pa.int64())}
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_key(text_col).alias("tkey"),
                       F.col(text_col).cast("binary").alias("text"))
    return map_batches(rows, run, "doc_id bigint, tkey bigint, fp bigint")


def text_key(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def segment_masks(max_bits: int) -> list[int]:
    """For each bit, the mask of its segment without it.

    With ``ceil((max_bits + 1) / 2)`` segments, one of them differs by at most one bit.
    """
    parts = (max_bits + 2) // 2
    out = []
    for i in range(parts):
        low, high = BITS * i // parts, BITS * (i + 1) // parts
        whole = (1 << high) - (1 << low)
        out += [whole & ~(1 << b) for b in range(low, high)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def star(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """At most one edge per fingerprint, tying together those reachable over links inside the group."""
    fps = fps.view(np.uint64)           # bits of a signed number are counted without its sign
    rest, out = fps[1:], []
    root, todo = int(fps[0]), [fps[0]]
    while len(rest):
        if not todo:
            root, todo, rest = int(rest[0]), [rest[0]], rest[1:]
        near = np.bitwise_count(rest ^ todo.pop()) <= max_bits
        if near.any():
            out += [(root, int(x)) for x in rest[near]]
            todo += list(rest[near])
            rest = rest[~near]
    return [tuple(int(np.uint64(x).view(np.int64)) for x in e) for e in out]


def _group_scan(max_bits: int, limit: int):
    """Scan rows sorted by variant: small groups give verified edges, rows of larger ones are passed on."""
    def run(batches):
        key, held, over = None, [], False

        def flush():
            if over or len(held) < 2:
                return []
            return star(np.array(held, np.int64), max_bits)

        for batch in batches:
            bit, rest, fp = (batch.column(c).to_numpy() for c in ("bit", "rest", "fp"))
            if not len(fp):
                continue
            cut = np.flatnonzero((bit[1:] != bit[:-1]) | (rest[1:] != rest[:-1])) + 1
            begin = np.concatenate([[0], cut])
            size = np.diff(np.append(begin, len(fp)))
            edges: list[tuple[int, int]] = []
            passed: list[int] = []
            # groups of one that neither continue nor end the batch need no look
            busy = np.flatnonzero((size > 1) | (begin == 0) | (begin == begin[-1]))
            for g in busy.tolist():
                a, n = int(begin[g]), int(size[g])
                if (now := (int(bit[a]), int(rest[a]))) != key:
                    edges += flush()
                    key, held, over = now, [], False
                rows = fp[a:a + n].tolist()
                if over or len(held) + n > limit:
                    passed += held + rows
                    held, over = [], True
                else:
                    held += rows
            yield pa.RecordBatch.from_pydict({
                "a": pa.array([e[0] for e in edges] + passed, pa.int64()),
                "b": pa.array([e[1] for e in edges] + [None] * len(passed), pa.int64())})
        edges = flush()
        yield pa.RecordBatch.from_pydict({"a": pa.array([e[0] for e in edges], pa.int64()),
                                          "b": pa.array([e[1] for e in edges], pa.int64())})
    return run


def _crowded(fps: DataFrame, max_bits: int) -> DataFrame:
    """Edges among crowded fingerprints: those alike but for the same ``max_bits`` bits are within reach
    of each other, so each is tied to the smallest of them. Linear in the rows, whatever the crowd."""
    masks = [~sum(1 << b for b in c) for c in itertools.combinations(range(BITS), max_bits)]
    masks = [m + (1 << 64) if m < -(1 << 63) else m for m in masks]
    wild = fps.select("fp", F.posexplode(F.array(*[F.lit(m).cast("bigint") for m in masks])).alias("k", "mask"))
    wild = wild.select("fp", "k", F.col("fp").bitwiseAND(F.col("mask")).alias("rest"))
    low = wild.groupBy("k", "rest").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1")
    return wild.join(low, ["k", "rest"]).where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b"))


def links(fps: DataFrame, max_bits: int = 2, limit: int = GROUP_LIMIT) -> DataFrame:
    """Edges ``(a, b)`` with the same components as all pairs of distinct ``fp`` within ``max_bits``.

    A group of equal variants up to ``limit`` is verified in memory and gives at most one edge per
    member; rows of a larger one are streamed on and linked by shared ``max_bits``-wildcard keys. Those
    keys grow too many beyond three bits: then a group is held whole, as eight bytes a fingerprint.
    """
    if max_bits > 3:
        limit = 1 << 62
    masks = F.array(*[F.lit(m).cast("bigint") for m in segment_masks(max_bits)])
    variants = (fps.select("fp", F.posexplode(masks).alias("bit", "mask"))
                .select("bit", F.col("fp").bitwiseAND(F.col("mask")).alias("rest"), "fp"))
    found = stage(variants.repartition("bit", "rest").sortWithinPartitions("bit", "rest", "fp")
                  .mapInArrow(_group_scan(max_bits, limit), "a bigint, b bigint"), "simhash-links")
    crowd = found.where("b IS NULL").select(F.col("a").alias("fp")).distinct()
    edges = found.where("b IS NOT NULL")
    return edges if crowd.isEmpty() else edges.unionByName(_crowded(crowd, max_bits))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``(doc_id, tkey, fp, component_id, root)``, one row per input row; ``root`` is a fingerprint of the component.

    ``component_id`` is the smallest id reachable over links of ``max_bits`` or fewer differing bits.
    Texts that are null or have no word have fingerprint zero and are linked like any other. Rows that
    repeat an id each get a row; a null id never names a component unless it has no other member.
    Only equal fingerprints' smallest id enters the search, so exact copies cost nothing there.
    """
    marked = stage(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fp")
    roots = components(links(distinct.select("fp"), max_bits))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id", "root")
    return marked.join(named, "fp").select("doc_id", "tkey", "fp", "component_id", "root")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (null ids last; then by a hash of the text)."""
    return _first_of_each(docs, near_duplicates(docs, shingle, max_bits, id_col, text_col), id_col, text_col)


def _first_of_each(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")
    copies = rows.groupBy("root", "doc_id", "tkey").agg(F.count("*").alias("n"))
    kept = stage(copies.groupBy("root").agg(F.min_by("n", place).alias("n"), F.min(place).alias("m"))
                 .select(F.col("m.doc_id").alias("_id"), F.col("m.tkey").alias("_key"), "n"), "kept")
    out = docs.join(kept, docs[id_col].cast("bigint").eqNullSafe(kept["_id"]) & (text_key(text_col) == kept["_key"]), "left_semi")
    if kept.where("n > 1").isEmpty():
        return out
    # rows that repeat both id and text
    return out.withColumn("_key", text_key(text_col)).dropDuplicates([id_col, "_key"]).drop("_key")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# -- similarity of shingle sets --------------------------------------------------------
SAMPLE, OFTEN, COMMON = 16, 4, 200_000      # one text in SAMPLE is counted; what is there OFTEN times is common, up to COMMON shingles
CENTRES, MOST_CENTRES = 4, 64         # texts that the others of a token are compared with, at first and at last
CROWD = 64                          # components of a token that are few enough for all their pairs


def shingle_sets(texts: list[bytes | None], shingle: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct ``shingle``-word runs of each text; a shorter text is one run, one without words has none."""
    words = Words([(t or b"").lower().split() for t in texts])
    hashes = words.hashes()
    out = []
    for a, n in zip(words.first.tolist(), words.counts.tolist()):
        out.append(np.unique(ngram_hashes(hashes[a:a + n], min(shingle, n)) if n else hashes[:0]).view(np.int64))
    return out


def set_key(grams: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes())).view(np.int64)) if len(grams) else 0


def _with_sets(docs: DataFrame, shingle: int, columns, schema: str) -> DataFrame:
    """``columns(batch, sets)`` of runs of texts; ``sets`` holds one array per row, the same object for equal texts."""
    def run(batch):
        texts = batch.column("text").to_pylist()
        for part in chunks(texts):
            own = dict.fromkeys(texts[part])
            own = dict(zip(own, shingle_sets(list(own), shingle)))
            yield columns(batch.slice(part.start, part.stop - part.start), [own[t] for t in texts[part]])
    return map_batches(docs, run, schema)


def pack_set(grams: np.ndarray) -> bytes:
    """Sorted hashes as compressed steps, a byte plane after the other."""
    steps = np.diff(np.sort(grams.view(np.uint64)), prepend=np.uint64(0))
    return pa.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def unpack_set(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel())


def _shared(batches):
    """Of rows sorted by token and key: distinct ones whose token has several keys."""
    names = ("token", "sig", "n", "pos")
    held, known = None, False
    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy() for c in names], axis=1)
        if held is not None:
            rows = np.concatenate([held, rows])
        if not len(rows):
            continue
        rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))]
        same = rows[1:, 0] == rows[:-1, 0]
        many = np.append(same, False) | np.append(known, same)
        held, known = rows[-1:], bool(many[-1])
        out = rows[:-1][many[:-1]]
        yield pa.RecordBatch.from_arrays([pa.array(out[:, k]) for k in range(4)], list(names))
    if held is not None and known:
        yield pa.RecordBatch.from_arrays([pa.array(held[:, k]) for k in range(4)], list(names))


def _compare(read, similar):
    """Of pairs with both sets: those for which ``similar(n, set, m, set)`` holds."""
    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "n", "x", "m", "y")))
            out = [(a, b) for a, b, n, x, m, y in rows if similar(n, read(n, x), m, read(m, y))]
            yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})
    return run


def _same(x: np.ndarray, y: np.ndarray) -> int:
    return len(np.intersect1d(x, y, assume_unique=True))


def _common(rows: DataFrame, shingle: int) -> list[int]:
    """At most ``COMMON`` shingles that a sample of the distinct texts has ``OFTEN`` times, the commonest first."""
    some = rows.where(F.pmod("tkey", F.lit(SAMPLE)) == 0).dropDuplicates(["tkey"]).select("text")
    often = _with_sets(some, shingle, lambda batch, sets: {"token": pa.array(np.concatenate([np.zeros(0, np.int64), *sets]), pa.int64())},
                       "token bigint").groupBy("token").count().where(F.col("count") >= OFTEN)
    return [r.token for r in often.orderBy(F.desc("count"), "token").limit(COMMON).collect()]


def similar_sets(docs: DataFrame, shingle: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, tkey, root)``, one row per input row: components over pairs with a Jaccard similarity of ``least`` or more.

    Exact: two sets that similar share one of the first ``n - ceil(least * n) + 1`` shingles in any order that is the
    same for all texts, and at the first one they share each has enough left behind it. The order puts shingles that a
    sample finds common last, so texts that share no more than a common passage do not meet. Texts that meet by a
    shingle are compared with ``CENTRES`` of them at most; while that leaves a crowd of components, with more of them;
    then all pairs that are still in different components and may be similar by size and place are compared. Equal sets are one; texts without words are alike; an
    empty table gives no rows. Shingles are shuffled for the first text of a set in each batch alone, and sets only for
    pairs that are compared.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), text_key(f"`{text_col}`").alias("tkey"),
                       F.col(f"`{text_col}`").cast("binary").alias("text"))
    common = _common(rows, shingle)
    tokens = np.array(sorted(common), np.int64)
    rank = np.zeros(len(tokens) + 1, np.int64)
    rank[np.searchsorted(tokens, np.array(common, np.int64))] = np.arange(len(common), 0, -1)

    def prefix(g: np.ndarray) -> np.ndarray:
        size = len(g) - int(np.ceil(least * len(g) - 1e-9)) + 1 if len(g) else 0
        if not len(tokens):
            return g[:size]
        at = np.minimum(np.searchsorted(tokens, g), len(tokens) - 1)
        return g[np.argsort(np.where(tokens[at] == g, rank[at], 0), kind="stable")[:size]]

    def marks(batch, sets):
        sigs = [set_key(g) for g in sets]
        first: dict[int, int] = {}
        firsts = [prefix(g) if first.setdefault(s, i) == i else g[:0] for i, (s, g) in enumerate(zip(sigs, sets))]
        ends = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
        return {"doc_id": batch.column("doc_id"), "tkey": batch.column("tkey"), "sig": pa.array(sigs, pa.int64()),
                "n": pa.array(list(map(len, sets)), pa.int64()), "prefix": pa.ListArray.from_arrays(ends, np.concatenate(firsts))}
    marked = stage(_with_sets(rows, shingle, marks, "doc_id bigint, tkey bigint, sig bigint, n bigint, prefix array<bigint>"), "shingle-marks")
    meets = marked.select(F.posexplode("prefix").alias("pos", "token"), "sig", "n").select("token", "sig", "n", F.col("pos").cast("bigint").alias("pos"))
    schema = "token bigint, sig bigint, n bigint, pos bigint"
    meets = stage(meets.repartition("token").sortWithinPartitions("token", "sig").mapInArrow(_shared, schema), "shingle-meets")

    def may(n: Column, i: Column, m: Column, j: Column) -> Column:
        return ((F.least(n, m) >= F.greatest(n, m) * least - 1e-9)
                & (F.least(n - i, m - j) >= (n + m) * (least / (1 + least)) - 1e-6))

    def pair(a: Column, b: Column) -> list[Column]:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    def by_pair(pairs: DataFrame, sets: DataFrame, column: str, read, similar) -> DataFrame:
        # the first set travels to the second, where the two are compared
        x = sets.select(F.col("sig").alias("a"), "n", F.col(column).alias("x"))
        y = sets.select(F.col("sig").alias("b"), F.col("n").alias("m"), F.col(column).alias("y"))
        both = pairs.join(x, "a").join(y, "b").select("a", "b", "n", "x", "m", "y")
        return both.mapInArrow(_compare(read, similar), "a bigint, b bigint")

    def enough(n: int, x: np.ndarray, m: int, y: np.ndarray) -> bool:
        """What the prefixes share, and all that may follow the one that ends first, reaches the limit."""
        return _same(x, y) + max(n - len(x), m - len(y)) >= (n + m) * (least / (1 + least)) - 1e-6

    def alike(n: int, x: np.ndarray, m: int, y: np.ndarray) -> bool:
        same = _same(x, y)
        return same >= (n + m - same) * least - 1e-9

    def verified(pairs: DataFrame) -> DataFrame:
        """``pairs`` that are similar: first by their prefixes, then by whole sets, made again for their texts alone."""
        prefixes = marked.where(F.size("prefix") > 0).select("sig", "n", "prefix").dropDuplicates(["sig"])
        pairs = stage(by_pair(pairs, prefixes, "prefix", lambda n, x: np.array(x, np.int64), enough), "shingle-likely")
        asked = pairs.select(F.col("a").alias("sig")).distinct().unionByName(pairs.select(F.col("b").alias("sig")).distinct()).distinct()
        one = marked.join(asked, "sig", "left_semi").groupBy("sig").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tkey")).alias("m"))
        one = one.select(F.col("m.doc_id").alias("_id"), F.col("m.tkey").alias("_key")).distinct()
        texts = rows.join(one, rows.doc_id.eqNullSafe(F.col("_id")) & (rows.tkey == F.col("_key")), "left_semi").select("text")
        sets = _with_sets(texts, shingle, lambda batch, sets: {
            "sig": pa.array([set_key(g) for g in sets], pa.int64()), "n": pa.array(list(map(len, sets)), pa.int64()),
            "packed": pa.array([pack_set(g) for g in sets], pa.binary())}, "sig bigint, n bigint, packed binary").dropDuplicates(["sig"])
        return by_pair(pairs, stage(sets, "shingle-sets"), "packed", lambda n, packed: unpack_set(packed, n), alike)

    left, tried, edges, centres = meets.withColumn("root", F.col("sig")), None, None, CENTRES
    while True:
        centre = F.xxhash64("sig", F.pmod("token", F.lit(centres)), F.lit(centres))
        chosen = left.groupBy("token").agg(F.min_by(F.struct("sig", "n", "pos", "root"), centre).alias("c"))
        new = left.join(chosen, "token").where((F.col("root") != F.col("c.root")) & may(F.col("n"), F.col("pos"), F.col("c.n"), F.col("c.pos")))
        new = new.select(*pair(F.col("sig"), F.col("c.sig"))).distinct()
        new = stage(new if tried is None else new.join(tried, ["a", "b"], "left_anti"), "shingle-pairs")
        tried = new if tried is None else tried.unionByName(new)
        edges = stage(verified(new) if edges is None else edges.unionByName(verified(new)), "shingle-links")
        roots = components(edges)
        named = meets.join(roots, meets.sig == roots.node, "left").select("token", "sig", "n", "pos", F.coalesce("root", "sig").alias("root"))
        # tokens whose texts are all in one component are done
        several = named.select("token", "root").distinct().groupBy("token").agg(F.count("*").alias("roots")).where("roots > 1")
        several = stage(several, "shingle-several")
        left = stage(named.join(several.select("token"), "token", "left_semi"), "shingle-open")
        crowd = several.agg(F.coalesce(F.max("roots"), F.lit(0))).first()[0]
        if centres >= MOST_CENTRES or crowd <= CROWD:
            break
        centres *= 4
    x, y = left.alias("x"), left.alias("y")
    more = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.root") < F.col("y.root"))
                  & may(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos")))
    more = stage(more.select(*pair(F.col("x.sig"), F.col("y.sig"))).distinct().join(tried, ["a", "b"], "left_anti"), "shingle-pairs")
    discard(meets, left)
    if not more.isEmpty():
        edges = stage(edges.unionByName(verified(more)), "shingle-links")
        roots = components(edges)
    return marked.join(roots, marked.sig == roots.node, "left").select("doc_id", "tkey", F.coalesce("root", "sig").alias("root"))


def keep_one_similar(docs: DataFrame, shingle: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of :func:`similar_sets`, chosen as by :func:`keep_one`."""
    return _first_of_each(docs, similar_sets(docs, shingle, least, id_col, text_col), id_col, text_col)
