"""Packing, token files, URL rules, classifiers and neighbours against plain versions and edge cases."""

from __future__ import annotations

import random
import time
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfwise.llm import neighbours, packing, quality, tokens, toxicity, url_rules
from shelfwise.llm.queries import TOKENIZER, URL_RULES
from tests.llm.test_text_operators import ODD, frame

LONG = (77, "many words. Once more, " * 4000)


def ids_of(text):
    return Tokenizer.from_file(TOKENIZER).encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library():
    rng = random.Random(1)
    signs = [" ", "  ", "a", "B", "'s", "1", "\n", "\t", ".", "é", "\xa0", "!", "　", "ll", "<|endoftext|>", "漢", "\x1c", "​"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(1500)]
    whole = Tokenizer.from_file(TOKENIZER)
    for limit in (1 << 20, 10):
        tokens._KNOWN.clear()
        encoder = tokens.Encoder(TOKENIZER, limit)
        got = encoder.encode(texts)
        assert [np.frombuffer(g, encoder.kind).tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_packed_values_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        values = (rng.random(n) ** 8 * (2 ** 32 - 1)).astype(np.uint32)
        assert (tokens.unpack(*tokens.pack(values), n) == values).all()


def test_token_files_round_trip(spark):
    rows = ODD + [LONG, (-4, "ümlaut <|endoftext|>")]
    path = tokens.token_path(spark)
    tokens.write_tokens(frame(spark, rows), TOKENIZER, 2, path, block_ids=50)
    got = tokens.read_tokens(spark, path).collect()
    want = sorted(((d is not None, d or 0), ids_of(t) + [2]) for d, t in rows)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    got.sort(key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(d for d, _ in rows if d is not None) and got[0].doc_id is None
    crc = {r.ids_crc32 for r in tokens.crc_column(tokens.read_tokens(spark, path)).collect()}
    assert crc == {zlib.crc32(np.array(i, "<u4").tobytes()) for _, i in want}
    empty = tokens.token_path(spark)
    tokens.write_tokens(frame(spark, []), TOKENIZER, 2, empty)
    assert tokens.read_tokens(spark, empty).count() == 0


def test_best_cuts_is_optimal():
    rng = random.Random(2)
    costs = packing.Costs(window=16)
    for _ in range(60):
        at = sorted({0, *rng.sample(range(1, 60), 14), *range(8, 60, 8), 60})
        price = [0.0 if p in (0, 60) else rng.choice([0.0, 1.0, 6.0]) for p in at]

        def pad(a, b):
            exact = (16, 8, 4, 2, 1) if 60 - b < 16 else (16, 8, 4, 2)
            return 0 if b - a in exact else 16 - (b - a)
        best = {0: 0.0}
        for j, p in enumerate(at[1:], 1):
            best[p] = price[j] + min(best[q] + pad(q, p) for q in at[:j] if p - q <= 16)
        ends = packing.best_cuts(np.array(at), np.array(price), costs)
        total = sum(pad(a, b) + price[at.index(b)] for a, b in zip([0, *ends], ends))
        assert ends[-1] == 60 and total == best[60]


@pytest.mark.parametrize("block_ids", [1 << 17, 300])
def test_packing_keeps_every_id(spark, block_ids):
    rows = ODD + [LONG, (8, "One. Two! Three? " * 90), (9, "nostop " * 3000)]
    out = packing.pack_documents(frame(spark, rows), TOKENIZER, 0, block_ids=block_ids).collect()
    texts = {}
    for r in out:
        texts.setdefault((r.sequence_id), []).append(r)
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
    for parts in texts.values():
        parts.sort(key=lambda r: r.offset)
        at = 0
        for p in parts:
            assert p.offset == at
            at += p.length
        assert at <= 1024 and parts[0].padded == (at if at & (at - 1) == 0 else 1024)
    pieces = sorted(out, key=lambda r: (r.sequence_id, r.offset))
    stream = [i for r in pieces for i in np.frombuffer(r.ids, "<u4").tolist()]
    assert sorted(stream) == sorted(i for _, t in rows for i in ids_of(t) + [0])
    lone = [r for r in pieces if r.doc_id == 77]
    assert [i for r in lone for i in np.frombuffer(r.ids, "<u4").tolist()] == ids_of(LONG[1]) + [0]
    assert [r.start for r in lone] == np.cumsum([0] + [r.length for r in lone[:-1]]).tolist()
    assert packing.pack_documents(frame(spark, []), TOKENIZER, 0).count() == 0


def test_hosts_and_fixed_rules(spark):
    cases = [("http://a.Example.NET/en/x?q", "a.example.net", "/en/x", "example.net/en/", "allow"),
             ("https://b.net/", "b.net", "/", "net/", "block"), ("https://b.net", "b.net", "", None, "allow"),
             ("x://EXAMPLE.com/de/1#f", "example.com", "/de/1", "example.com/de/", "block"),
             ("x://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"), ("x://c.org/fr/", "c.org", "/fr/", "org/fr/", "allow"),
             ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
             ("a://b?c://d/e", "b", "", None, "allow"), ("http://É.net/en/", "É.net", "/en/", "net/", "block")]
    pages = spark.createDataFrame([(i, u) for i, (u, *_) in enumerate(cases)] + [(0, cases[0][0])], "page_id bigint, url string").withColumn("key", F.lit(1))
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    out = url_rules.judge_urls(pages, labels, URL_RULES)
    assert out.count() == len(cases) + 1
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert got == {i: tuple(c[1:]) for i, c in enumerate(cases)}
    assert url_rules.judge_urls(pages.where("false"), labels, URL_RULES).count() == 0


def test_rules_of_wide_urls_are_found(spark):
    """Sets of which a URL's surest tokens hold a part or nothing."""
    rng = np.random.default_rng(23)
    rows = [(sorted({f"t{i}" for i in np.flatnonzero(rng.random(9) < (0.7 if bad else 0.25))}), bool(bad)) for bad in rng.random(120) < 0.3]
    rows += [([f"t{i}" for i in range(9)], True)] * 6
    total, n_bad = len(rows), sum(bad for _, bad in rows)
    want = {}
    for size in (1, 2, 3):
        for rule in combinations([f"t{i}" for i in range(9)], size):
            held = [bad for tokens, bad in rows if set(rule) <= set(tokens)]
            hits = sum(held)
            if hits >= 0.05 * total and hits / len(held) >= 0.6 and hits / len(held) * total >= 1.5 * n_bad:
                want[rule] = (hits / len(held), hits / total)
    found = url_rules.mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.05, longest=3, widest=3)
    got = {tuple(r.rule): (r.confidence, r.support) for r in found.collect()}
    assert len(want) > 20 and all(np.allclose(got[r], want[r]) for r in got)
    # a rule that is left out has a part held by the same rows
    assert all(any(set(g) <= set(r) and np.allclose(got[g], want[r]) for g in got) for r in want)


def test_mined_rules_match_plain(spark):
    rng = random.Random(4)
    urls = [f"http://{rng.choice('abc')}.site.{rng.choice(['com', 'org'])}/{rng.choice(['x', 'y', 'bad'])}/{rng.randrange(99)}?{rng.choice('pq')}=1" for _ in range(300)]
    labels = [(i, None if i % 7 == 0 else int(not ("bad" in u and "?p" in u) or rng.random() < .1), int("//c." in u and "/y/" in u)) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(900, urls[5]), (901, None)], "page_id bigint, url string")
    known = spark.createDataFrame(labels + [(None, 0, 1)], "doc_id bigint, quality int, toxic int")
    tokens_of = {r.page_id: frozenset(r.t) for r in pages.select("page_id", url_rules.tokens_of(F.col("url")).alias("t")).collect()}
    rows = [(tokens_of[i], q == 0 or t == 1) for i, q, t in labels]
    share, sets = sum(b for _, b in rows) / len(rows), {frozenset(c) for t, _ in rows for n in range(1, min(len(t), 4) + 1) for c in combinations(sorted(t), n)}
    sure = {}
    for s in sets:
        inside = [b for t, b in rows if s <= t]
        if sum(inside) / len(rows) >= .02 and sum(inside) / len(inside) >= .6 and sum(inside) / len(inside) / share >= 1.5:
            sure[s] = sum(inside) / len(inside)
    assert sure
    got = url_rules.judge_urls(pages, known, {}, support=.02).collect()
    for r in got:
        want = max((c for s, c in sure.items() if s <= tokens_of[r.page_id]), default=None)
        assert r.verdict == ("allow" if want is None else "block") and (want is None or abs(want - r.confidence) < 1e-12)
    assert len(got) == 302


def test_long_urls_are_mined_in_time_and_judged_whole(spark):
    parts = [f"p{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    bad = "http://a.bad.com/" + "/".join(parts)
    near = ["http://a.bad.com/" + "/".join(parts[:k] + parts[k + 1:]) for k in range(20)]
    good = [f"http://b.good.com/{p}/{k}" for k, p in enumerate(parts[:20])]
    urls = [bad] * 20 + near + good
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    labels = spark.createDataFrame([(i, int(i >= 40), 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    start = time.time()
    got = {r.page_id: r.verdict for r in url_rules.judge_urls(pages, labels, {}).collect()}
    assert got == {i: "block" if i < 40 else "allow" for i in range(60)} and time.time() - start < 60
    rules = url_rules.mine_rules(spark.createDataFrame([(["x", "y"], True)] * 3 + [(["x"], False)] * 7, "tokens array<string>, bad boolean"))
    assert {(tuple(r.rule), r.key, r.confidence, round(r.support, 6)) for r in rules.collect()} == {(("y",), "y", 1.0, .3), (("x", "y"), "y", 1.0, .3)}


def test_neighbours_take_the_stored_length(spark):
    rng = random.Random(3)
    stored = [(i, [rng.random() for _ in range(4)]) for i in range(30)] + [(100 + i, [1.0] * 6) for i in range(10)]
    vectors = spark.createDataFrame(stored, "vec_id bigint, embedding array<double>")
    got = neighbours.nearest(vectors, vectors.where("vec_id >= 98 OR vec_id = 1"), 5).collect()
    assert {r.query_id for r in got} == {1} and len(got) == 5
    assert neighbours.nearest(vectors, vectors.where("vec_id >= 100"), 5).count() == 0


def test_quality_learns_and_keeps(spark):
    rng = random.Random(6)
    good = [" ".join(rng.choice(["the", "river", "runs", "over", "stones", "slowly"]) for _ in range(40)) + "." for _ in range(300)]
    junk = [" ".join(w.upper() + "!!" for w in t.split()) for t in good[:100]]
    rows = list(enumerate(good + junk)) + [(5000, None), (5001, ""), (None, good[0]), (7, good[7])]
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(0, 400, 2)] + [(1, None), (None, 0)], "doc_id bigint, quality int").withColumn("score", F.lit(0))
    out = {r.doc_id: r.score for r in quality.quality_scores(frame(spark, rows), labels).collect()}
    right = [(out[i] >= 0.5) == (i < 300) for i in range(1, 400, 2)]
    assert sum(right) >= 0.98 * len(right) and len(out) == 403 and all(0 <= s <= 1 for s in out.values())
    none = quality.quality_scores(frame(spark, rows), labels.where("false"))
    assert {r.score for r in none.collect()} == {1.0} and none.count() == len(rows)
    kept = quality.keep_good(frame(spark, rows), labels)
    assert kept.columns == frame(spark, []).columns and 300 <= kept.count() <= 310
    assert quality.quality_scores(frame(spark, []), labels).count() == 0


def test_word_features_match_plain_counts():
    texts = [b"Ab ab cd\tab", None, b"", b"x" * 5000, b" ".join(b"w%d" % (i % 7) for i in range(3000))]
    got = quality.word_features(texts)
    for t, row in zip(texts, got):
        words = (t or b"").lower().split()
        h = [int(x) for x in quality.mix(quality.Words([words]).hashes())]
        pairs = quality.mix(np.array([(a + 3 * b) % 2 ** 64 for a, b in zip(h, h[1:])], np.uint64)) if len(h) > 1 else []
        want = np.zeros(quality.HASHED)
        for g in h + [int(x) for x in pairs]:
            want[g % quality.HASHED] += 1 if g >> 63 else -1
        want = np.sign(want) * np.sqrt(np.abs(want))
        assert np.allclose(row, want / max(1, np.linalg.norm(want)))
    assert np.allclose(quality.word_features(texts[::-1])[::-1], got)


@pytest.mark.parametrize("teach", [100_000, 40])
def test_quality_reads_the_words(spark, teach):
    """Texts of equal style and page data, told apart by their words alone; few of the unlabelled rows teach."""
    rng = np.random.default_rng(21)
    names = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(names[:40] if i % 2 else names[20:], 40))) for i in range(600)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id bigint, quality int")
    out = {r.doc_id: r.score for r in quality.quality_scores(frame(spark, rows), labels, teach_rows=teach).collect()}
    assert sum((out[i] >= 0.5) == bool(i % 2) for i in range(300, 600)) >= 285


def test_quality_judges_rows_that_share_an_id(spark):
    good = [f"the river runs over stone {i} slowly." for i in range(100)]
    junk = [" ".join(w.upper() + "!!" for w in t.split()) for t in good]
    rows = list(enumerate(good + junk)) + [(None, good[0]), (None, junk[0]), (900, good[1]), (900, junk[1])]
    labels = spark.createDataFrame([(i, int(i < 100)) for i in range(200)], "doc_id bigint, quality int")
    kept = {(r.doc_id, r.text) for r in quality.keep_good(frame(spark, rows), labels).collect()}
    assert kept & set(rows[200:]) == {rows[200], rows[202]}


def test_quality_with_few_labels(spark):
    good = [f"the river runs over stone {i} slowly." for i in range(60)]
    junk = [" ".join(w.upper() + "!!" for w in t.split()) for t in good]
    rows = list(enumerate(good + junk))
    # one label of its kind: it is in the held fifth or in the rest, never in both
    few = spark.createDataFrame([(0, 1)] + [(i, 0) for i in range(60, 90)], "doc_id bigint, quality int")
    kept = [r.doc_id for r in quality.keep_good(frame(spark, rows), few).collect()]
    assert sorted(kept) == list(range(60))
    zeros = quality.quality_scores(frame(spark, rows), few.where("quality = 0"))
    assert {r.score for r in zeros.collect()} == {1.0}


def test_folding():
    assert toxicity.folded("1d1ot, ЅTUPID l0ser! m0r0n 1234 ＦＵＬＬ heat$$$") == ["idiot", "stupid", "loser", "moron", "1234", "full", "heat"]
    assert toxicity.folded(None) == [] and toxicity.folded(" . ") == []


def test_matcher():
    m = toxicity.Matcher({" loser ": 2.0, " low": 3.0, " lower ": 1.0}, ("sore loser",))
    assert m.score("a loser and a sore loser, lower") == (5.0, 2.0, 7)
    assert m.score(None) == (0.0, 0.0, 0) and m.score("flow losers") == (0.0, 0.0, 2)


def test_toxicity_learns(spark):
    rng = random.Random(8)
    plain = [" ".join(rng.choice(["the", "river", "runs", "over", "stones", "slow"]) for _ in range(30)) for _ in range(400)]
    bad = [t + f" you {rng.choice(['loser', 'moron'])} " + rng.choice(["", "zonkfa", "zonkle"]) for t in plain[:150]]
    rows = list(enumerate(plain + bad)) + [(9000, None), (9001, ""), (9002, "you l0ser"), (9003, "word " * 100000), (None, "moron")]
    known = spark.createDataFrame([(t, int(i >= 400)) for i, t in rows[:550] if i % 2] + [(None, 0), ("x", None)], "text string, toxic int")
    out = {r.doc_id: r.score for r in toxicity.toxicity(frame(spark, rows), known).collect()}
    assert all((out[i] >= 0.5) == (i >= 400) for i in range(550)) and out[9002] >= 0.5 > max(out[9000], out[9001], out[9003])
    assert {r.score for r in toxicity.toxicity(frame(spark, rows), known.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.toxicity(frame(spark, []), known).count() == 0


def test_hilbert_steps_are_unit_steps():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
        key = neighbours.hilbert(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_neighbours_recall_and_order(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 24))
    data = (centres[rng.integers(0, 10, 6000)] + rng.normal(size=(6000, 24))).astype(np.float32)
    data[3000:4500] = data[40]                              # one vector shared by a quarter
    rows = [(i, v.tolist(), 0) for i, v in enumerate(data)]
    odd = [(9000, None, 1), (9001, [0.0] * 24, 1), (9002, [None] + [1.0] * 23, 1), (9003, [float("nan")] * 24, 1), (9020, [float("inf")] * 24, 1),
           (9005, [1.0], 1), (None, data[0].tolist(), 1), (17, data[17].tolist(), 1)]
    vectors = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, curve int")
    got = {}
    for r in neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20, neighbours.Curves(share=0.04)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 6000, 20))
    wide, found, total = data.astype(np.float64), 0, 0
    for q, rows in got.items():
        rows.sort()
        score = (wide[q] * wide).sum(axis=1)
        score[q] = -np.inf
        order = np.lexsort((np.arange(6000), -score))[:20]
        assert [r for r, *_ in rows] == list(range(1, 21)) and all(score[v] == s for _, v, s in rows)
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        found += len({v for _, v, _ in rows} & set(order.tolist()))
        total += 20
    assert found / total >= 0.9
    few = vectors.where("vec_id < 5")
    assert neighbours.nearest(few, few.where("vec_id = 0"), 20).count() == 4
    assert neighbours.nearest(few.where("false"), few, 20).count() == 0


def test_labelled_texts_are_bounded(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"), F.lit(5).alias("toxic"))
    labels = spark.range(4000).select(F.when(F.col("id") < 3999, F.col("id")).alias("doc_id"), F.when(F.col("id") > 0, 0).alias("toxic"))
    labels = labels.unionByName(labels.where("doc_id = 7").withColumn("toxic", F.lit(1)))
    every = toxicity.labelled_texts(docs, labels).collect()
    assert len(every) == 3998 and [r.text for r in every if r.toxic == 1] == ["t7"]
    some = {r.text for r in toxicity.labelled_texts(docs, labels, most=1000).collect()}
    assert 850 < len(some) < 1150 and some == {r.text for r in toxicity.labelled_texts(docs, labels.repartition(3), most=1000).collect()}
