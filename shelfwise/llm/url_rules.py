"""URL filters: fixed host and path rules first, else association rules mined from labelled pages."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.staging import stage

BAD = "label:bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest of ``{"host/path": verdict}`` that fits, and its verdict: its host or a subdomain, its path a prefix."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        cut = rule.index("/")
        fits = ((host == rule[:cut]) | host.endswith("." + rule[:cut])) & path.startswith(rule[cut:])
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(rules[rule])).otherwise(verdict)
    return name, verdict


def tokens_of(url: Column) -> Column:
    """Distinct tokens: scheme, labels of the host, parts of the path, query keys; digits read as ``0``."""
    low = F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER)
    query = F.regexp_extract(low, r"\?([^#]*)", 1)

    def parts(text: Column, pattern: str, tag: str) -> Column:
        words = F.filter(F.split(text, pattern), lambda w: w != "")
        return F.transform(words, lambda w: F.concat(F.lit(tag), F.regexp_replace(w, r"\d+", "0")))
    scheme = F.regexp_extract(low, "^([^:/?#]*)://", 1)
    keys = F.transform(F.split(query, "&"), lambda p: F.split(p, "=")[0])
    return F.array_distinct(F.concat(
        F.when(scheme != "", F.array(F.concat(F.lit("scheme:"), scheme))).otherwise(F.array()),
        parts(host_of(low), r"\.", "host:"), parts(path_of(low), "[/.]+", "path:"),
        F.transform(F.filter(keys, lambda k: k != ""), lambda k: F.concat(F.lit("query:"), k))))


def frequent_sets(baskets: DataFrame, need: float, longest: int) -> DataFrame:
    """``(rule)``: sets of 1 to ``longest`` tokens held by ``need`` bad rows or more, from ``(tokens, n, hits)`` baskets.

    Level by level: the sets of a basket that are left so far take one of its later tokens each, and are counted. A set
    held by the same rows as one of its parts is left out, with all that hold it: the part says the same of every URL.
    What is left has only parts that are left, so no other set is missed.
    """
    baskets = stage(baskets.withColumn("basket", F.monotonically_increasing_id()), "url-baskets")
    later = baskets.select("basket", "n", "hits", F.explode("tokens").alias("token"))
    sums = [F.sum("n").alias("n"), F.sum("hits").alias("hits")]
    level = stage(later.groupBy(F.array("token").alias("rule")).agg(*sums).where(F.col("hits") >= need), "url-sets")
    held, every = later.select("basket", F.array("token").alias("rule")), level.select("rule")
    for size in range(2, longest + 1):
        grown = (held.join(level, "rule", "left_semi").join(later, "basket").where(F.col("token") > F.element_at("rule", -1))
                 .select("basket", "n", "hits", F.concat("rule", F.array("token")).alias("rule")))
        grown = stage(grown, "url-grown")
        often = grown.groupBy("rule").agg(*sums).where(F.col("hits") >= need)
        parts = F.array(*[F.concat(F.slice("rule", 1, i), F.slice("rule", i + 2, size)) for i in range(size)])
        whole = level.select(F.col("rule").alias("part"), F.col("n").alias("part_n"))
        own = (often.select("rule", "n", F.explode(parts).alias("part")).join(whole, "part")
               .groupBy("rule").agg(F.count("*").alias("parts"), F.min("part_n").alias("least"), F.first("n").alias("n")))
        level = stage(own.where((F.col("parts") == size) & (F.col("least") > F.col("n"))).select("rule", "n"), "url-sets")
        held, every = grown.select("basket", "rule"), every.unionByName(level.select("rule"))
    return every


def mine_rules(labelled: DataFrame, support: float = 0.002, confidence: float = 0.6, lift: float = 1.5, longest: int = 4,
               widest: int = 12) -> DataFrame:
    """``(rule, key, confidence, support)``: sets of up to ``longest`` tokens that point to bad pages, from ``(tokens, bad)`` rows.

    FP-growth proposes sets from the ``widest`` tokens of a URL that point to bad pages most surely (then the commonest):
    it knows no longest set, and all sets of a URL of 60 tokens would be 2^60. If any URL has more tokens that can be in
    a rule, :func:`frequent_sets` adds what whole URLs hold, but for sets that a smaller one of the same rows stands for,
    so no verdict and no confidence misses a rule. What is proposed is counted again
    over all tokens of all rows, so support, confidence and lift are those of whole URLs. ``key`` is the rule's rarest
    token, under which it is filed.
    """
    rows = stage(labelled.withColumn("row", F.monotonically_increasing_id()), "labelled-urls")
    total, bad = rows.agg(F.count("*"), F.sum(F.col("bad").cast("bigint"))).first()
    each = rows.select("row", "bad", F.explode("tokens").alias("token"))
    known = stage(each.groupBy("token").agg(F.count("*").alias("freq"), F.avg(F.col("bad").cast("int")).alias("sure"),
                                               F.sum(F.col("bad").cast("bigint")).alias("hits"))
                  .where(F.col("freq") >= support * total - 1e-9), "url-tokens")
    surest = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("sure")).alias("s"), (-F.col("freq")).alias("f"), "token"))), 1, widest)
    some = each.join(known, "token").groupBy("row").agg(F.transform(surest, lambda t: t["token"]).alias("some"))
    kept = F.coalesce("some", F.array().cast("array<string>"))
    baskets = rows.join(some, "row", "left").select(F.when(F.col("bad"), F.concat(kept, F.array(F.lit(BAD)))).otherwise(kept).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=support, minConfidence=1.0).fit(baskets).freqItemsets
    sets = sets.where(F.array_contains("items", BAD) & F.size("items").between(2, longest + 1))
    sets = sets.select(F.array_sort(F.array_remove("items", BAD)).alias("rule"))
    need = support * total - 1e-9
    apt = known.where(F.col("hits") >= need)
    whole = each.join(apt, "token").groupBy("row", "bad").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    baskets = stage(whole.groupBy("tokens").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("bigint")).alias("hits")), "labelled-baskets")
    if not baskets.where(F.size("tokens") > widest).isEmpty():
        sets = sets.unionByName(frequent_sets(baskets, need, longest)).distinct()
    rarest = (sets.select("rule", F.explode("rule").alias("token")).join(known, "token")
              .groupBy("rule").agg(F.min(F.struct("freq", "token")).alias("low")))
    posted = stage(rarest.select("rule", F.col("low.token").alias("key")), "proposed-rules")
    met = rows.select("tokens", "bad", F.explode("tokens").alias("key")).join(posted, "key").where(F.size(F.array_except("rule", "tokens")) == 0)
    counted = met.groupBy("rule", "key").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("int")).alias("hits"))
    counted = counted.select("rule", "key", (F.col("hits") / F.col("n")).alias("confidence"), (F.col("hits") / total).alias("support"))
    return stage(counted.where((F.col("confidence") >= confidence - 1e-12) & (F.col("confidence") * total >= lift * bad - 1e-9)
                               & (F.col("support") >= support - 1e-12)), "url-rules")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: dict[str, str], support: float = 0.002, confidence: float = 0.6,
               lift: float = 1.5, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id") -> DataFrame:
    """``(page_id, host, path, rule, verdict, confidence)``, one row per page.

    ``rule`` is the fixed rule that fits, else null, and decides; otherwise a page is blocked if the tokens of its
    URL hold those of a mined rule (``confidence``: the surest one), else allowed. A labelled page is bad if its
    quality is 0 or it is toxic. Every distinct URL is judged once, so a URL that many pages share is one row until
    the verdict is joined back.

    A null URL, or one without ``://``, has empty host and path and whatever tokens it holds. Repeated and null
    page ids keep their rows. Without labels of both kinds nothing is mined and unruled pages are allowed. A URL of any
    number of tokens is judged by all of them; an empty table of pages gives no rows.
    """
    bad = labels.groupBy(F.col(label_id).alias("l")).agg(F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    page = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    known = page.join(bad, page["page_id"] == bad["l"]).select(tokens_of(F.col("url")).alias("tokens"), "bad")
    urls = stage(page.select("url").distinct().where("url IS NOT NULL").withColumn("tokens", tokens_of(F.col("url"))), "urls")
    kinds = {r.bad for r in known.groupBy("bad").count().collect()}
    if kinds == {True, False}:
        mined = mine_rules(known, support, confidence, lift)
        posted = urls.select("url", "tokens", F.explode("tokens").alias("key"))
        hits = (posted.join(mined, "key").where(F.size(F.array_except("rule", "tokens")) == 0)
                .groupBy("url").agg(F.max("confidence").alias("confidence")))
    else:
        hits = urls.select("url", F.lit(None).cast("double").alias("confidence")).where("false")
    name, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    return (page.join(hits, "url", "left").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
            .select("page_id", "host", "path", name.alias("rule"),
                    F.coalesce(verdict, F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
                    "confidence"))
