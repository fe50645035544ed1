"""The registered queries of this subpackage, and the SQL for those that DuckDB can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import (decontaminate, divergence, exact_index, line_dedup, neighbours, packing, phrases, quality, simhash, substrings,
                           tokens, toxicity, url_rules)
from shelfwise.llm.common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
RATIO, LEAST_PAGES = 0.1, 5
WINDOW = 20
LEAST_DOCS, TOP_TERMS = 30, 50
LEAST_COUNT, COVER, TOP_PHRASES = 30, 80, 2000


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), RATIO, LEAST_PAGES)
    return out.select("doc_id", "text", "n_lines", "n_removed")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after removing 20-word windows that occur earlier."""
    out = substrings.dedup_substrings(table(spark, sf_dir, "documents"), WINDOW)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a passage like a test item."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 1024 ids."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER, 0, keep_ids=False).drop("ids")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of good quality for every document."""
    out = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the token files of all documents hold, read back."""
    path = tokens.token_path(spark)
    tokens.write_tokens(table(spark, sf_dir, "documents"), TOKENIZER, 2, path)
    return tokens.crc_column(tokens.read_tokens(spark, path))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = toxicity.toxicity(docs, toxicity.labelled_texts(docs, labels.where(~held)))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty nearest vectors of every twentieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far every source's terms are from each other source's, and its most typical terms."""
    return divergence.divergence(table(spark, sf_dir, "documents"), LEAST_DOCS, TOP_TERMS)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of every language."""
    out = phrases.top_phrases(table(spark, sf_dir, "documents"), TOP_PHRASES, least=LEAST_COUNT, cover=COVER)
    return out.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of equal texts of every document, and the row of it that stays."""
    return exact_index.exact_groups(table(spark, sf_dir, "documents")).drop("keep_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_line_dedup, op2_substring_dedup, op3_decontamination, op4_packing, op5_url_filter, op6_quality, op7_token_files,
    op8_toxicity, op9_simhash, op10_neighbours, op11_divergence, op12_phrases, op13_exact_dedup)}

ORACLE: dict[str, str] = {
    "op1_line_dedup": f"""
WITH split AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents),
keys AS (SELECT source, unnest(list_distinct(list_filter(list_transform(lines, lambda x: trim(x)), lambda x: x <> ''))) AS k FROM split),
counts AS (SELECT source, k, count(*) AS pages FROM keys GROUP BY source, k),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
common AS (SELECT c.source, list(k) AS ks FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
           WHERE pages >= {LEAST_PAGES} AND pages > {RATIO} * total GROUP BY c.source),
kept AS (SELECT doc_id, lines, list_filter(lines, lambda x: NOT coalesce(list_contains(ks, trim(x)), false)) AS kept
         FROM split s LEFT JOIN common c ON s.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, array_to_string(kept, chr(10)) AS text, len(lines) AS n_lines, len(lines) - len(kept) AS n_removed FROM kept""",
    "op2_substring_dedup": f"""
WITH split AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW} + 2)) AS start FROM split WHERE len(words) >= {WINDOW}),
windows AS (SELECT doc_id, start, array_to_string(list_slice(words, start, start + {WINDOW - 1}), ' ') AS gram FROM starts),
late AS (SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY gram ORDER BY doc_id, start) AS rn FROM windows) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + {WINDOW})) AS place FROM late),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM split),
left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS kept, count(*) AS n
              FROM each ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT s.doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM split s LEFT JOIN left_over l USING (doc_id)""",
    "op11_divergence": f"""
WITH docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
found AS MATERIALIZED (SELECT lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term, id
                       FROM (SELECT *, row_number() OVER () AS id FROM docs)),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS whole FROM found GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(whole) + 5 * count(*) AS total FROM kept GROUP BY lang),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM found SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS MATERIALIZED (SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(n, 0) + 5 * coalesce(v, 0) AS total
           FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN langs USING (lang)
           LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counts GROUP BY lang, source) c ON c.lang = g.lang AND c.source = g.source),
priced AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // g.total AS p,
                  1 + (1000000000::HUGEINT * (whole + 5)) // l.total AS q
           FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
           LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0)::BIGINT AS value
         FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value FROM priced x JOIN priced y USING (lang, term)
                    GROUP BY ALL) d ON d.lang = a.lang AND d.source = a.source AND d.other = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM priced WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
           FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}""",
    "op12_phrases": f"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang,
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM docs),
split AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS MATERIALIZED (
  SELECT lang, phrase, k, count(*) AS a FROM (
    SELECT lang, k, array_to_string(list_slice(w, start, start + k - 1), ' ') AS phrase
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS start FROM split, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k))
  GROUP BY lang, phrase, k HAVING count(*) >= {LEAST_COUNT}),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE k > 1),
cuts AS (SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS cut FROM cand),
parts AS (SELECT c.lang, c.phrase, c.a, c.cut, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a + y.a) AS score FROM cuts c
          JOIN grams x ON x.lang = c.lang AND x.k = cut AND x.phrase = array_to_string(list_slice(c.w, 1, cut), ' ')
          JOIN grams y ON y.lang = c.lang AND y.k = c.k - cut AND y.phrase = array_to_string(list_slice(c.w, cut + 1, c.k), ' ')),
scored AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_of AS (SELECT lang, array_to_string(list_slice(w, start, start + m - 1), ' ') AS phrase, max(a) AS longer
             FROM (SELECT *, unnest(range(1, k - m + 2)) AS start FROM (SELECT *, unnest(range(2, k)) AS m FROM cand)) GROUP BY ALL),
kept AS (SELECT s.* FROM scored s LEFT JOIN inner_of i ON i.lang = s.lang AND i.phrase = s.phrase
         WHERE 100 * coalesce(longer, 0) < {COVER} * a),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
           FROM kept JOIN n USING (lang))
SELECT * FROM ranked WHERE rank <= {TOP_PHRASES}""",
    "op13_exact_dedup": """
WITH plain AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents),
best AS (SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY length(text) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size
         FROM plain)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM best""",
}
