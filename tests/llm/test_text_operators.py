"""Line, substring and near-duplicate operators and decontamination against plain versions and edge cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import decontaminate, line_dedup, simhash, substrings
from shelfwise.llm.common import components
from tests.llm import brute

#: columns whose names the operators use inside
CLASH = "key string, fp bigint, row int, host string, tkey bigint, id int, root int, drop int, doc string"
ODD = [(1, "a b c"), (2, None), (3, ""), (4, " \t\n "), (None, "a b c"), (5, "x"), (5, "x"), (5, "y z"), (None, None)]


def frame(spark, rows, source="s"):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    base = spark.createDataFrame([(d, t, "en", source, len(t or "")) for d, t in rows], schema)
    for c in CLASH.split(", "):
        base = base.withColumn(c.split()[0], F.lit(None).cast(c.split()[1]))
    return base


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "Ünder", "A"]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    rows = []
    for i in range(150):
        text = rng.choice(base)
        w = text.split(" ")
        if rng.random() < 0.5:
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.4:
            w += rng.choice(base).split(" ")
        rows.append((i, rng.choice([" ", "  ", "\n", "\t"]).join(w)))
    return rows + [(200, "w1 " * 5000), (201, "w2 w3 " * 3000)] + [(300 + i, base[0]) for i in range(40)]


@pytest.mark.parametrize("window, part_bytes", [(20, 32 << 20), (5, 32 << 20), (5, 2000), (1, 4000), (3, 500)])
def test_substrings_match_plain(spark, corpus, window, part_bytes):
    rows = corpus + ODD
    got = substrings.dedup_substrings(frame(spark, rows), window, part_bytes=part_bytes).withColumn(
        "sha", F.sha2(F.col("text").cast("binary"), 256)).collect()
    want = brute.substring_dedup(rows, window)
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed, r.sha) for r in got) == sorted((d or -1, *want[d, t]) for d, t in rows)


def test_substrings_empty(spark):
    assert substrings.dedup_substrings(frame(spark, [(1, "a")]).where("false")).count() == 0


def test_fingerprints_and_components_match_plain(spark, corpus):
    rows = corpus + ODD
    got = simhash.near_duplicates(frame(spark, rows), max_bits=6).collect()
    assert len(got) == len(rows)
    fps = sorted({brute.fingerprint(t) for _, t in rows})
    root = dict(zip(fps, brute.components(fps, 6)))
    low = {}
    for d, t in rows:
        r = root[brute.fingerprint(t)]
        low[r] = min(x for x in (low.get(r), d) if x is not None) if d is not None or low.get(r) is not None else None
    want = sorted((str(d), brute.fingerprint(t), str(low[root[brute.fingerprint(t)]])) for d, t in rows)
    assert sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in got) == want


@pytest.mark.parametrize("bits, limit", [(2, 512), (2, 3), (1, 2), (3, 512), (7, 512)])
def test_links_give_all_components(spark, bits, limit):
    rng = random.Random(bits)
    fps = set()
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            fps.add(f)
            for _ in range(rng.randrange(1, bits + 2)):
                f ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), bits, limit)
    root = {r.node: r.root for r in components(edges).collect()}
    groups, want = {}, {}
    for f, label in zip(signed, brute.components(fps, bits)):
        groups.setdefault(root.get(f, f), set()).add(f)
        want.setdefault(label, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_keep_one(spark, corpus):
    rows = corpus + ODD
    kept = simhash.keep_one(frame(spark, rows), max_bits=2)
    assert kept.columns == frame(spark, []).columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    fps = sorted({brute.fingerprint(t) for _, t in rows})
    root = dict(zip(fps, brute.components(fps, 2)))
    assert sorted(root[brute.fingerprint(t)] for _, t in got) == sorted(set(root.values()))
    assert simhash.keep_one(frame(spark, []), max_bits=2).count() == 0


def test_lines(spark):
    rows = [(i, f"menu\nunique {i}\n\n menu ") for i in range(8)] + [(20, "menu"), (21, "unique 1\nlast"), (22, None), (23, ""), (None, "menu\nx")]
    other = frame(spark, [(40 + i, f"menu\nmenu\n{i}") for i in range(4)], "t")
    docs = frame(spark, rows).unionByName(other).unionByName(frame(spark, [(90, "menu"), (90, "menu")], None))
    got = {(r.doc_id, r.source): r for r in line_dedup.dedup_lines(docs, 0.5, 5).collect()}
    assert line_dedup.dedup_lines(docs, 0.5, 5).count() == docs.count()
    assert got[3, "s"].text == "unique 3\n" and (got[3, "s"].n_lines, got[3, "s"].n_removed) == (4, 2)
    assert got[20, "s"].text == "" and got[21, "s"].text == "unique 1\nlast" and got[None, "s"].text == "x"
    assert got[22, "s"].text is None and got[22, "s"].n_lines is None and got[23, "s"].text == ""
    assert got[41, "t"].text == "menu\nmenu\n1" and got[90, None].text == "menu"        # too few pages
    assert line_dedup.dedup_lines(docs.where("false")).count() == 0
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_alignment_matches_plain():
    rng = random.Random(5)
    pairs = [([rng.randrange(1, 6) for _ in range(rng.randrange(1, 25))], [rng.randrange(1, 6) for _ in range(rng.randrange(1, 60))]) for _ in range(80)]
    best, end = decontaminate.align([np.array(a, np.uint64) for a, _ in pairs], [np.array(b, np.uint64) for _, b in pairs])
    assert best.tolist() == [brute.smith_waterman(a, b) for a, b in pairs]


def test_decontamination(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(12, 40)))) for i in range(12)] + [(50, None), (51, ""), (52, "two words")]
    docs, leaks = [], {}
    for d in range(60):
        w = [rng.choice(vocabulary) for _ in range(200)]
        if d % 3 == 0:
            i, text = rng.choice(items[:12])
            passage = text.split()
            if d % 2:                               # edited: a word in eight replaced, one dropped
                passage = [rng.choice(vocabulary) if k % 8 == 7 else x for k, x in enumerate(passage)]
                del passage[len(passage) // 2]
            at = rng.randrange(200)
            w[at:at] = [x.upper() + "," if k % 5 == 0 else x for k, x in enumerate(passage)]
            leaks[d] = i
        docs.append((d, " ".join(w)))
    docs += [(d + 1000 if d else d, t) for d, t in ODD] + [(2000, " ".join(vocabulary) * 2000)]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("score", F.lit(1))
    for block in (16 << 20, 300):
        got = decontaminate.contaminated(frame(spark, docs), bench, block_bytes=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == set(leaks.items())
    plain = {(d, i): max(brute.smith_waterman(decontaminate.normal_words(x.encode()), decontaminate.normal_words(t.encode())), 0)
             / 2 / len(x.split()) for d, t in docs[:60] if d in leaks for i, x in items[:12] if leaks[d] == i}
    assert all(abs(plain[r.doc_id, r.item_id] - r.score) < 1e-12 for r in got)
    kept = decontaminate.clean(frame(spark, docs), bench)
    assert kept.count() == len(docs) - len(leaks) and kept.columns == frame(spark, []).columns
    assert decontaminate.contaminated(frame(spark, docs), bench.where("false")).count() == 0
    assert decontaminate.contaminated(frame(spark, []), bench).count() == 0


@pytest.mark.parametrize("common", [64, 0])
def test_decontamination_finds_what_plain_alignment_finds(spark, monkeypatch, common):
    """Copies with every k-th word replaced, doubled with filler or left out, against alignment of all pairs."""
    monkeypatch.setattr(decontaminate, "COMMON", common)
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [(i, [rng.choice(vocabulary) for _ in range(rng.randrange(30, 60))]) for i in range(8)] + [(8, ["v1", "v2", "v3"])]
    docs = []
    for d in range(70):
        w = [rng.choice(vocabulary) for _ in range(100)]
        passage, k = items[d % 8][1], d // 8
        if k in (0, 1, 2, 3):
            passage = [f"x{rng.randrange(10 ** 9)}" if j % (k + 2) == k + 1 else x for j, x in enumerate(passage)]
        elif k in (4, 5):
            passage = [y for j, x in enumerate(passage) for y in ([x, "filler"] if j % (k - 3) == 0 else [x])]
        elif k in (6, 7):
            passage = [x for j, x in enumerate(passage) if j % (k - 3)]
        else:
            passage = []
        at = rng.randrange(100)
        w[at:at] = passage
        docs.append((d, w))
    want = {}
    for d, w in docs:
        for i, x in items:
            score = brute.smith_waterman(x, w) / 2 / len(x)
            if score >= 0.5:
                want[d, i] = score
    assert {d // 8 for d, i in want if i == d % 8} >= {1, 2, 3, 4, 5, 6, 7}
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id bigint, text string")
    got = decontaminate.contaminated(frame(spark, [(d, " ".join(w)) for d, w in docs]), bench).collect()
    assert {(r.doc_id, r.item_id): r.score for r in got} == want


@pytest.mark.parametrize("often", [4, 1])
def test_similar_sets_match_plain(spark, corpus, monkeypatch, often):
    """Components at a five-word similarity of .8, just below and just above it, against all pairs."""
    monkeypatch.setattr(simhash, "OFTEN", often)
    rng = random.Random(4)
    rows = corpus + ODD
    for k in range(40):
        w = [f"t{k}_{i}" for i in range(200)]
        rows = rows + [(1000 + 10 * k, " ".join(w))]
        for j in range(1, 4):
            v = list(w)
            for at in rng.sample(range(200), rng.randrange(1, 8)):
                v[at] = "new"
            rows.append((1000 + 10 * k + j, " ".join(v)))
    rows += [(3000 + k, " ".join([f"f{i}" for i in range(100)] + [f"g{k}_{i}" for i in range(k % 14)])) for k in range(80)]
    sets = []
    for _, t in rows:
        w = brute.words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) * 5 >= len(a | sets[j]) * 4 and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    groups, want = {}, {}
    for r in simhash.similar_sets(frame(spark, rows)).collect():
        groups.setdefault(r.root, []).append((str(r.doc_id), r.tkey))
    keys = {t: k for t, k in spark.createDataFrame([(t,) for t in {t for _, t in rows}], "text string").select("text", simhash.text_key("text")).collect()}
    for (d, t), x in zip(rows, label):
        want.setdefault(x, []).append((str(d), keys[t]))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    kept = simhash.keep_one_similar(frame(spark, rows))
    assert kept.count() == len(want) and kept.columns == frame(spark, []).columns
    assert simhash.keep_one_similar(frame(spark, [])).count() == 0


def test_rows_are_judged_each_by_its_text(spark):
    item = " ".join(f"b{i}" for i in range(30))
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    rows = [(None, f"x {item} y"), (None, "clean"), (5, item), (5, "clean too"), (6, None)]
    kept = decontaminate.clean(frame(spark, rows), bench).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == [("5", "clean too"), ("6", "None"), ("None", "clean")]


def test_line_dedup_shuffles_a_text_once(spark):
    """What meets the drop lists holds the text in the row alone, not a second time beside it."""
    docs = spark.createDataFrame([(1, "a\nb", "s")], "doc_id long, text string, source string")

    def left_of_outer(plan):
        if plan.nodeName() == "Join" and "Left" in plan.joinType().toString() and "Semi" not in plan.joinType().toString():
            return plan.children().apply(0).schema().simpleString()
        found = [left_of_outer(plan.children().apply(i)) for i in range(plan.children().size())]
        return next((f for f in found if f), None)
    shuffled = left_of_outer(line_dedup.dedup_lines(docs)._jdf.queryExecution().optimizedPlan())
    assert shuffled.count("text:string") == 1
