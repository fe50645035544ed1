"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.staging import stage
from shelfwise.llm.common import map_batches

# fixed values: letters of other scripts that look like Latin ones, and signs written for letters
LOOKALIKES = str.maketrans("авсеһіјкмнорԛѕтуԝхѵӏαβεικνορτυχω", "abcehijkmhopqstywxvlabeikvoptuxw")
SIGNS = str.maketrans("0134578@$!|", "oieastbasil")
# fixed values: phrases in which a lexicon word means no insult
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown", "idiot proof", "sore loser", "pond scum", "soap scum")

_SIGNED = re.compile(r"\S*[0134578@$!|]\S*")
_LETTER = re.compile(r"[^\W\d_]")
_WORD = re.compile(r"[^\W_]+")
STEMS = (4, 5, 6)
FIT_ROWS = 200_000          # labelled ids that lexicon and regression are fitted on


def _letters(match: re.Match) -> str:
    """Signs read as letters in a word that has letters; those at its end stay punctuation."""
    word = match[0]
    if not _LETTER.search(word):
        return word
    core = word.rstrip("!|$")
    return core.translate(SIGNS) + word[len(core):]


def folded(text: str | None) -> list[str]:
    """Words in lower case after compatibility forms, look-alike letters and signs for letters are folded."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if not text.isascii():
        text = text.translate(LOOKALIKES)
    return _WORD.findall(_SIGNED.sub(_letters, text))


def terms(words: list[str]) -> set[str]:
    """What may enter the lexicon: whole words ``" word "`` and word beginnings ``" begi"``."""
    own = set(words)
    out = {f" {w} " for w in own}
    for n in STEMS:
        out.update(f" {w[:n]}" for w in own if len(w) > n)
    return out


def labelled_texts(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic") -> DataFrame:
    """``(text, toxic)`` of the labelled rows of ``docs``, to fit on.

    Of more than ``most`` labelled ids, those with the lowest hashes are taken, so that some ``most`` ids and labels (a
    few MB) go to every task and no text is shuffled for this. Null ids and labels are ignored; of several labels for
    one id the highest holds.
    """
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.max(label_col).alias("toxic"))
    n = one.count()
    if n > most:
        one = one.where(F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(1 << 32)) < (most << 32) // n)
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("text"))
    return rows.join(F.broadcast(one), F.col("_doc") == F.col("_id")).select("text", "toxic")


def _term_counts(docs: DataFrame, known: dict[str, int] | None) -> DataFrame:
    """In how many texts each term (of ``known``, if given) occurs; summed within each batch first."""
    def run(batch):
        counts: Counter[str] = Counter()
        for text in batch.column("text").to_pylist():
            found = terms(folded(text))
            counts.update(found if known is None else found & known.keys())
        return {"term": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())}
    return map_batches(docs.select("text"), run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def learn_lexicon(labelled: DataFrame, share: float = 0.02, least: float = 3.0) -> dict[str, float]:
    """Term weights from ``(text, toxic)`` rows; equal texts count once.

    A term needs ``share`` of the toxic texts (so at most terms-per-text / ``share`` of them reach the driver) and
    a log-odds ratio of ``least`` or more. A beginning is left out where a whole word explains it.
    """
    rows = stage(labelled.where("toxic IS NOT NULL").groupBy("text").agg(F.max("toxic").alias("toxic")), "lexicon-texts")
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return {}
    top = {r.term: r.n for r in _term_counts(rows.where("toxic = 1"), None).where(F.col("n") >= max(2, share * bad)).collect()}
    rest = {r.term: r.n for r in _term_counts(rows.where("toxic = 0"), top).collect()}
    out = {}
    for term, n in top.items():
        other = rest.get(term, 0)
        weight = np.log((n + 0.5) / (bad - n + 0.5)) - np.log((other + 0.5) / (good - other + 0.5))
        if weight >= least:
            out[term] = float(weight)
    whole = {t[:k + 1]: n for t, n in top.items() if t in out and t[-1] == " " for k in STEMS if len(t) > k + 2}
    return {t: w for t, w in out.items() if t[-1] == " " or top[t] > 1.05 * whole.get(t, 0)}


class Matcher:
    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...]):
        self.automaton = ahocorasick.Automaton()
        for term, weight in lexicon.items():
            self.automaton.add_word(term, (len(term), weight))
        for phrase in exceptions:
            text = f" {' '.join(folded(phrase))} "
            if text.strip():
                self.automaton.add_word(text, (len(text), 0.0))
        self.automaton.make_automaton()
        self.empty = not len(self.automaton)

    def score(self, text: str | None) -> tuple[float, float, int]:
        """Sum of weights, number of hits (each word once, by its heaviest term), number of words."""
        words = folded(text)
        if self.empty or not words:
            return 0.0, 0.0, len(words)
        weight: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, w) in self.automaton.iter(f" {' '.join(words)} "):
            begin = end - size + 1
            if w:
                weight[begin] = max(w, weight.get(begin, 0.0))
            else:
                spared.append((begin, end))
        for a, b in spared:
            for at in [x for x in weight if a <= x < b]:
                del weight[at]
        return sum(weight.values()), float(len(weight)), len(words)


def toxicity(docs: DataFrame, labelled: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS, share: float = 0.02,
             least: float = 3.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, hits)``, one row per input row; ``score`` in [0, 1], 0.5 and above reads as toxic.

    ``labelled`` holds ``(text, toxic)``; only the text is an input of a score. The lexicon's hits in a text, as
    their sum and per words, are turned into a probability by a logistic regression on the labelled rows.
    Null, empty and wordless texts have no hits and get that score; without labels of both kinds every score is 0.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    labelled = stage(labelled.where("toxic IS NOT NULL").select("text", "toxic"), "labelled-texts")
    lexicon = learn_lexicon(labelled, share, least)
    if not lexicon:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(0.0).alias("hits"))
    matcher = {}

    def features(batch):
        if not matcher:
            matcher["m"] = Matcher(lexicon, exceptions)
        found = np.array([matcher["m"].score(t) for t in batch.column("text").to_pylist()]).reshape(-1, 3)
        total, hits, words = found.T
        cols = np.column_stack([np.log1p(total), total / np.sqrt(words + 10), 100 * hits / (words + 10), hits > 0])
        keep = {c: batch.column(c) for c in batch.schema.names if c != "text"}
        return keep | {"hits": pa.array(hits), "x": pa.array(list(cols.astype(float)), pa.list_(pa.float64()))}

    known = labelled.select("text", F.col("toxic").cast("double").alias("label"))
    fit = stage(map_batches(known, features, "label double, hits double, x array<double>"), "toxicity-fit")
    model = LogisticRegression(maxIter=50, regParam=1e-3).fit(fit.select(array_to_vector("x").alias("features"), "label"))
    logit = F.lit(float(model.intercept))
    for i, w in enumerate(model.coefficients.toArray().tolist()):
        logit = logit + F.col("x")[i] * w
    kind = dict(rows.dtypes)["doc_id"]
    return map_batches(rows, features, f"doc_id {kind}, hits double, x array<double>").select(
        "doc_id", (1 / (1 + F.exp(-logit))).alias("score"), "hits")
