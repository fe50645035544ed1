"""Source divergence, phrase mining and exact dedup against plain versions and edge cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import divergence, exact_index, phrases

CLASH = ("key", "row", "n", "value", "chunk", "word", "entry", "a", "total", "id", "term", "rank", "s", "kept", "i", "h", "c", "r")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, rows):
    base = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    return base.select("*", *[F.lit(7).alias(c) for c in CLASH])


def corpus(seed=1, n=160):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdé" for b in ("x", "Ynd", "zü")] + ["A", "1a2", "-", "b\x01"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", ". ", "\n", "  ", ", "]) for _ in range(rng.randrange(60)))
        rows.append((i, text, rng.choice(["en", "en", "fr", None]), rng.choice(["s0", "s0", "s1", "s2", None, ""])))
    odd = [(900, None, "en", "s0"), (901, "", "fr", "only-empty"), (None, "Ax ax bx", "en", None), (902, "Ax ax", None, None),
           (902, "Ax ax", None, None), (903, "ax bx cynd " * 4000, "en", "s0"), (904, " \t\n. , ", "xx", "q"), (905, "lone", "yy", "q")]
    return rows + odd


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# -- source divergence -----------------------------------------------------------------
def plain_divergence(rows, least, top):
    found, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        t = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        found[lang, source].update(t)
        docs[lang].update(set(t))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = {t for t, n in docs[lang].items() if n >= least}

        def p(n):
            total = sum(n[t] for t in kept)
            return {t: 1 + 10**9 * (n[t] + 5) // (total + 5 * len(kept)) for t in kept}
        whole = p(sum((found[lang, s] for s in sources), Counter()))
        price = {s: p(found[lang, s]) for s in sources}
        for s in sources:
            pair = [(x, sum(abs(price[s][t] - price[x][t]) for t in kept)) for x in sources if x != s]
            term = [(t, price[s][t] - whole[t]) for t in kept if found[lang, s][t] and price[s][t] > whole[t]]
            for part, items in (("pair", pair), ("term", term)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, x, v, k + 1) for k, (x, v) in enumerate(items) if part == "pair" or k < top]
    return sorted(out)


@pytest.mark.parametrize("least, top, block", [(30, 50, 1 << 16), (3, 4, 4), (1, 2, 1), (10_000, 5, 8)])
def test_divergence_matches_plain(spark, least, top, block):
    rows = corpus()
    got = divergence.divergence(frame(spark, rows), least, top, block).collect()
    assert sorted(tuple(r) for r in got) == plain_divergence(rows, least, top)


def test_divergence_empty(spark):
    assert divergence.divergence(frame(spark, corpus()).where("false")).count() == 0


def test_long_texts_are_counted_in_parts(monkeypatch):
    text = ("Ab cd-é " * 50).encode()
    monkeypatch.setattr(divergence, "PART", 7)
    parts = list(divergence.terms(text))
    assert len(parts) > 20 and [t for p in parts for t in p] == [b"ab", b"cd", "é".encode()] * 50


def test_counting_task_passes_on_early(monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 3)
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 4, "source": ["s", "t", "s", "s"], "text": [b"a b c d", b"a a", b"b c", b"e"]})
    got = Counter()
    batches = list(divergence._count([batch]))
    for b in batches:
        for r in b.to_pylist():
            got[r["source"], r["term"], "n"] += r["n"]
            got[r["source"], r["term"], "docs"] += r["docs"]
    assert len(batches) > 2 and got["s", "b", "n"] == 2 and got["t", "a", "n"] == 2 and got["t", "a", "docs"] == 1


def test_gallop_finds_places():
    rng = np.random.default_rng(0)
    for n, m in [(1, 1), (5, 1), (3, 1000), (400, 1000), (1000, 1000)]:
        many = np.unique(rng.integers(0, 5000, m))
        few = np.unique(np.append(rng.integers(-10, 5010, n), many[-1]))
        assert (divergence.gallop(few, many) == np.searchsorted(many, few)).all()
    uneven = np.unique(np.append(2 ** np.arange(40), 5))
    assert (divergence.gallop(np.arange(0, 70), uneven) == np.searchsorted(uneven, np.arange(0, 70))).all()


@pytest.mark.parametrize("total", [7, 10**6, 10**12 + 7, 9 * 10**15, 10**17])
def test_shares_are_exact(total):
    n = np.array([0, 1, 2, total // 3, total - 5], np.int64)
    assert divergence.shares(n, total).tolist() == [1 + 10**9 * (int(x) + 5) // total for x in n]


def test_share_column_is_exact(spark):
    rows = [(0, 7), (10**13, 3 * 10**13 + 1), (10**17, 10**17 + 9), (5, 0)]
    got = spark.createDataFrame(rows, "n bigint, total bigint").select(divergence.share(F.col("n"), F.col("total")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (n + 5) // t if t else 0 for n, t in rows]


# -- phrases ---------------------------------------------------------------------------
def plain_phrases(rows, longest, least, cover):
    count, n = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            count.update((lang, *w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    good = {g: a for g, a in count.items() if a >= least and len(g) > 2}
    covered = set()
    for g, f in good.items():
        covered |= {(g[0], *g[i:i + m]) for m in range(2, len(g) - 1) for i in range(1, len(g) - m + 1)
                    if 100 * f >= cover * count[(g[0], *g[i:i + m])]}
    out = []
    for (lang, *w), a in good.items():
        if (lang, *w) in covered:
            continue
        score, _, x, y = min((2_000_000 * a // (x + y), k, x, y) for k in range(1, len(w))
                             for x, y in [(count[(lang, *w[:k])], count[(lang, *w[k:])])])
        out.append((lang, " ".join(w), a, x, y, n[lang], score))
    return out


@pytest.mark.parametrize("longest, least, cover, chunk", [(4, 30, 80, 16 << 20), (4, 3, 80, 300), (5, 2, 50, 1), (2, 5, 80, 2000), (3, 1, 101, 500)])
def test_phrases_match_plain(spark, longest, least, cover, chunk):
    rows = corpus(2)
    got = phrases.phrases(frame(spark, rows), longest, least, cover, chunk).collect()
    assert sorted(map(tuple, got)) == sorted(plain_phrases(rows, longest, least, cover))


def test_top_phrases_rank_and_ties(spark):
    rows = corpus(3)
    want = defaultdict(list)
    for r in plain_phrases(rows, 4, 4, 80):
        want[r[0]].append(r)
    got = phrases.top_phrases(frame(spark, rows), 5, least=4).collect()
    for lang, items in want.items():
        items.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        assert [tuple(r)[:7] for r in sorted((r for r in got if r.lang == lang), key=lambda r: r.rank)] == items[:5]


def test_phrases_empty(spark):
    assert phrases.phrases(frame(spark, corpus()).where("false")).count() == 0
    assert phrases.phrases(frame(spark, [(1, None, None, None), (2, "", "en", "s"), (3, "a", "en", "s")]), least=1).count() == 0


def test_phrase_scores_are_exact(spark):
    rows = [(10**15, 3 * 10**15 + 1), (10**18, 2 * 10**18 - 1), (30, 61)]
    got = spark.createDataFrame(rows, "a bigint, t bigint").select(phrases._ratio(F.col("a"), F.col("t")).alias("s")).collect()
    assert [r.s for r in got] == [2_000_000 * a // t for a, t in rows]


def test_runs_and_windows():
    places = np.array([-1, 3, 4, -1, -1, 5, -1], np.int32)
    assert phrases.runs(places).tolist() == [3, 4, -1, 5]
    assert phrases.windows(places, 2).tolist() == [1]
    assert phrases.windows(places[:1], 2).tolist() == []


# -- exact dedup -----------------------------------------------------------------------
def plain_groups(rows):
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc or 0, doc))
    out = []
    for plain, members in groups.items():
        sha = hashlib.sha256(plain.encode()).hexdigest()
        best = min(members)
        kept = [True] + [False] * (len(members) - 1)
        for k, m in zip(kept, sorted(members)):
            out.append((str(m[3]), str(best[3]), len(members), k, sha, -best[0]))
    return sorted(out)


def copies(seed=5):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abc é\t\n\x0b\x1f\xa0") for _ in range(rng.randrange(30))) for _ in range(80)] + ["big " * 3000]
    rows = [(i, rng.choice(base) + rng.choice(["", " ", "\n\n"])) for i in range(500)]
    rows += [(1000 + i, base[0] + " " * (i % 3)) for i in range(300)]
    odd = [(None, base[0] + "     "), (2000, None), (2001, ""), (2002, " \t"), (2003, "x"), (2003, "x"), (None, None), (2004, "x ")]
    return [(d, t, "en", "s") for d, t in rows + odd]


@pytest.mark.parametrize("page_bytes, batch", [(32 << 20, 10_000), (3000, 7), (200, 3), (1, 1)])
def test_exact_groups_match_plain(spark, page_bytes, batch):
    rows = copies()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = exact_index.exact_groups(frame(spark, rows), page_bytes).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((str(r[0]), str(r[1]), *r[2:]) for r in map(tuple, got)) == plain_groups(rows)


def test_dedup_exact_keeps_rows_as_they_are(spark):
    rows = copies()
    docs = frame(spark, rows)
    got = exact_index.dedup_exact(docs)
    assert got.columns == docs.columns
    want = Counter((d, s) for d, _, _, k, s, _ in plain_groups(rows) if k)
    sha = [(str(r.doc_id), hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", r.text or "").encode()).hexdigest()) for r in got.collect()]
    assert Counter(sha) == want


def test_exact_groups_empty(spark):
    docs = frame(spark, copies()).where("false")
    assert exact_index.exact_groups(docs).count() == 0 and exact_index.dedup_exact(docs).count() == 0


def test_directory_splits_full_buckets_and_chains_copies(spark):
    rows = [(i, k, "t" * 40) for i, k in enumerate([5] * 40 + [1 << 62] + list(range(1 << 40, (1 << 40) + 60)))]
    entries = spark.createDataFrame(rows, "entry bigint, key bigint, text string")
    leaves, start = exact_index.directory(entries, 500)
    leaves = [r.asDict() for r in leaves.collect()]
    for _, key, _ in rows:
        assert sum(x["low"] <= key <= x["high"] for x in leaves) == 1
    assert all(x["bytes"] <= 500 or x["low"] == x["high"] for x in leaves)
    assert max(x["pages"] for x in leaves) == 9 and max(x["depth"] for x in leaves) > start


def test_equal_keys_are_told_apart_by_bytes():
    texts = [b"one", b"two", b"one", b"two", b"three"]
    packed = [exact_index._squeeze(t) for t in texts]
    cols = {"slot": [0] * 5, "low": [0] * 5, "page": [0] * 5, "key": [9] * 5, "entry": [*range(5)], "n": [1] * 5, "chars": [3, 3, 4, 3, 5],
            "doc_id": [1, 2, 3, None, 5], "row": [*range(5)], "pages": [1] * 5, "text": packed}
    out = [r for b in exact_index._own([pa.RecordBatch.from_pydict(cols)]) for r in b.to_pylist()]
    assert sorted((r["entry"], r["rep"], r["n"], r["doc_id"]) for r in out) == [(0, 0, 2, 3), (1, 1, 2, 2), (2, 0, 2, 3), (3, 1, 2, 2), (4, 4, 1, 5)]
