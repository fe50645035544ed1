"""Quality classifier by co-training: a view of the text and a view of the page data teach each other."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.staging import stage
from shelfwise.llm.common import Words, chunks, map_batches, mix

# byte classes: 0 other ASCII marks, 1 lower, 2 upper, 3 digit, 4 blank, 5 line feed, 6 ends . ! ?, 7 beyond ASCII, 8 |*#$%&
_KINDS = np.zeros(256, np.uint8)
for _chars, _kind in (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3), (" \t", 4), ("\n", 5),
                      (".!?", 6), ("|*#$%&", 8)):
    _KINDS[np.frombuffer(_chars.encode(), np.uint8)] = _kind
_KINDS[128:] = 7
CLASSES = 9
BUCKETS = 16
HASHED = 128                # places that words and word pairs are hashed to
TEACH_ROWS = 100_000        # unlabelled rows, about, that the views label for each other; fewer are all used


def text_features(text: bytes | None) -> np.ndarray:
    """Shares of byte classes and of pairs of them, repeated words, distinct words, word length, size."""
    text = text or b""
    kinds = _KINDS[np.frombuffer(text, np.uint8)].astype(np.int64)
    n = max(len(kinds), 1)
    single = np.bincount(kinds, minlength=CLASSES) / n
    pairs = np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=CLASSES * CLASSES) / n
    words = text.split()
    w = max(len(words), 1)
    again = sum(a == b for a, b in zip(words, words[1:])) / w
    rest = [again, len(set(words)) / w, np.log1p(len(words)), len(text) / w / 10, float(not words)]
    return np.concatenate([single, np.sqrt(pairs), rest])


def word_features(texts: list[bytes | None]) -> np.ndarray:
    """Signed counts of hashed words and word pairs, A-Z lower-cased: square roots, as a vector of length 1 (or 0)."""
    out = np.zeros((len(texts), HASHED))
    for part in chunks(texts):
        words = Words([(t or b"").lower().split() for t in texts[part]])
        single = mix(words.hashes())
        owner = np.repeat(np.arange(len(words.counts)), words.counts)
        same = owner[1:] == owner[:-1]
        pairs = mix(single[:-1] + np.uint64(3) * single[1:])[same]
        for grams, of in ((single, owner), (pairs, owner[1:][same])):
            place = of * HASHED + (grams & np.uint64(HASHED - 1)).astype(np.int64)
            sign = np.where(grams >> np.uint64(63), 1.0, -1.0)
            out[part] += np.bincount(place, sign, len(words.counts) * HASHED).reshape(-1, HASHED)
    out = np.sign(out) * np.sqrt(np.abs(out))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1)


def view_of_text(texts: list[bytes | None]) -> np.ndarray:
    """What a text is made of and which words it has."""
    style = np.array([text_features(t) for t in texts]).reshape(len(texts), -1)
    return np.concatenate([style, word_features(texts)], axis=1)


def meta_features(lang: Column, source: Column, n_chars: Column) -> Column:
    """Language and source by hash bucket, size of the page; nulls have buckets and a flag of their own."""
    def bucket(c: Column, n: int) -> list[Column]:
        h = F.when(c.isNull(), F.lit(n)).otherwise(F.pmod(F.xxhash64(c.cast("string")), F.lit(n)))
        return [(h == i).cast("double") for i in range(n + 1)]
    size = F.log1p(F.greatest(F.coalesce(n_chars, F.lit(0)), F.lit(0)).cast("double"))
    return F.array(*bucket(lang, BUCKETS), *bucket(source, 2 * BUCKETS), size, size * size, n_chars.isNull().cast("double"))


def row_key(*cols: str) -> Column:
    """Hash of what a row is scored by; a null is a value of its own."""
    return F.xxhash64(*[x for c in cols for x in (F.col(c).cast("string"), F.col(c).isNull())])


def _fit(rows: DataFrame, view: str) -> LogisticRegressionModel:
    return LogisticRegression(featuresCol="features", labelCol="label", maxIter=40, regParam=1e-4).fit(
        rows.select(array_to_vector(view).alias("features"), F.col("label").cast("double").alias("label")))


def _scored(rows: DataFrame, model: LogisticRegressionModel, view: str, out: str) -> DataFrame:
    ready = rows.withColumn("features", array_to_vector(view))
    done = model.transform(ready)
    return done.withColumn(out, vector_to_array("rawPrediction")[1]).drop("features", "rawPrediction", "probability", "prediction")


def row_scores(docs: DataFrame, labels: DataFrame, rounds: int = 2, sure: float = 0.98, teach_rows: int = TEACH_ROWS, id_col: str = "doc_id",
               text_col: str = "text", lang_col: str = "lang", source_col: str = "source", size_col: str = "n_chars",
               label_col: str = "quality") -> DataFrame:
    """``(doc_id, tkey, score, text_score, meta_score)``, one row per input row: the probability of label 1.

    ``tkey`` (a hash of the text and the page data) tells rows with the same id apart.

    A fifth of the labelled rows (by hash of the id) is kept for calibration. In each round both views are fitted
    on the rest and on what the other view was ``sure`` of among the unlabelled rows, or among some ``teach_rows`` of
    them (chosen by a hash), which bounds the fits; every row is scored. The log-odds of each view
    are then calibrated (Platt) on the kept rows and added, less the prior they share.

    Labels that are null are ignored; several for one id: their mean, rounded. Without labels of both kinds every
    score is 1, so nothing is rejected for want of labels; with both, but not both in the fifth and in the rest, the
    views are fitted on all labels and not calibrated. Null and empty texts,
    null page data and null ids are scored like any others, very long texts whole; equal rows get equal scores. Other
    columns of ``docs`` are not read, so their names cannot clash.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("doc_id")).agg(
        F.round(F.avg(label_col)).cast("double").alias("label"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), row_key(text_col, lang_col, source_col, size_col).alias("tkey"),
                       F.col(text_col).cast("binary").alias("text"), meta_features(F.col(lang_col), F.col(source_col), F.col(size_col)).alias("meta"))

    def features(batch):
        return {"doc_id": batch.column("doc_id"), "tkey": batch.column("tkey"), "meta": batch.column("meta"),
                "words": pa.array(list(view_of_text(batch.column("text").to_pylist()).astype(np.float32)), pa.list_(pa.float32()))}
    seen = map_batches(rows, features, "doc_id bigint, tkey bigint, meta array<double>, words array<float>").withColumn(
        "words", F.col("words").cast("array<double>"))
    seen = stage(seen.join(known, "doc_id", "left"), "quality-views")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    train, check = seen.where(F.col("label").isNotNull() & ~held), seen.where(F.col("label").isNotNull() & held)
    free = seen.where("label IS NULL")
    share = teach_rows / max(free.count(), 1)
    free = free.where(F.pmod(F.xxhash64("tkey", "doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))) if share < 1 else free
    kinds = {r.label: r["count"] for r in train.groupBy("label").count().collect()}
    checks = {r.label: r["count"] for r in check.groupBy("label").count().collect()}
    if len(kinds.keys() | checks.keys()) < 2:
        return seen.select("doc_id", "tkey", *[F.lit(1.0).alias(c) for c in ("score", "text_score", "meta_score")])
    calibrated = len(kinds) == len(checks) == 2
    if not calibrated:
        train = seen.where(F.col("label").isNotNull())
        checks = {k: kinds.get(k, 0) + checks.get(k, 0) for k in (0.0, 1.0)}

    views = ("words", "meta")
    models = {v: _fit(train, v) for v in views}
    edge = float(np.log(sure / (1 - sure)))
    for _ in range(rounds):
        taught = {}
        for own, other in (views, views[::-1]):
            pseudo = _scored(free, models[other], other, "logit").where(F.abs("logit") >= edge).select(
                own, (F.col("logit") > 0).cast("double").alias("label"))
            taught[own] = _fit(train.select(own, "label").unionByName(pseudo), own)
        models = taught

    both = _scored(_scored(seen, models["words"], "words", "a"), models["meta"], "meta", "b").select("doc_id", "tkey", "label", "a", "b")
    platt = {c: F.col(c) for c in ("a", "b")}
    if calibrated:
        kept = stage(both.where(F.col("label").isNotNull() & held), "quality-check")
        for c in platt:
            m = LogisticRegression(maxIter=40, regParam=1e-4).fit(kept.select(array_to_vector(F.array(c)).alias("features"), "label"))
            platt[c] = F.col(c) * float(m.coefficients[0]) + float(m.intercept)
    prior = float(np.log(checks[1.0] / checks[0.0]))

    def sigmoid(x: Column) -> Column:
        return 1 / (1 + F.exp(-x))
    return both.select("doc_id", "tkey", sigmoid(platt["a"] + platt["b"] - prior).alias("score"), sigmoid(platt["a"]).alias("text_score"),
                       sigmoid(platt["b"]).alias("meta_score"))


def quality_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``(doc_id, score, text_score, meta_score)`` of :func:`row_scores`, one row per input row."""
    return row_scores(docs, labels, **options).drop("tkey")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
              source_col: str = "source", size_col: str = "n_chars", **options) -> DataFrame:
    """``docs`` without the rows scored below ``least``; rows that share an id, or have none, are judged each by itself."""
    cols = {"text_col": text_col, "lang_col": lang_col, "source_col": source_col, "size_col": size_col}
    bad = row_scores(docs, labels, id_col=id_col, **cols, **options).where(F.col("score") < least)
    bad = stage(bad.select(F.col("doc_id").alias("_bad"), F.col("tkey").alias("_key")).distinct(), "rejected")
    return docs.join(bad, docs[id_col].cast("bigint").eqNullSafe(bad["_bad"]) & (row_key(*cols.values()) == bad["_key"]), "left_anti")
