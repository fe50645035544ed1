"""Crawl logs, streams, integrity checks and estimators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfwise.functions.staging import stage, stage_root
from shelfwise.functions.vectors import rounded
from shelfwise.operators import checks as ck
from shelfwise.operators import crawl_log as lg
from shelfwise.operators import encoding as en
from shelfwise.operators import estimators as es
from shelfwise.operators import labels as lb
from shelfwise.operators import layout as la
from shelfwise.operators import sampling as sm
from shelfwise.plans.recommend_queries import animelist_pages
from shelfwise.plans.registry import query
from shelfwise.streaming import streams as st

HREF = r'href="/([^"/]+)"'


def crawl_states(w):
    """Status log: one row per crawl attempt."""
    status = (F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "http_403")
              .when(F.col("event_type") == "click", "empty").otherwise("ok"))
    return w.table("events").select("event_id", "ts", "user_id", status.alias("status"), "value")


def crawl_users(w):
    """Crawl state per user; some crawls are still pending."""
    name = F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("username")
    per = crawl_states(w).groupBy("user_id").agg(
        F.min("ts").alias("discovered_at"), F.max_by("status", "event_id").alias("r"), F.min_by("status", "event_id").alias("p"))
    return per.select(name, "discovered_at", F.when(F.col("user_id") % 4 != 0, F.col("r")).alias("ratings_status"),
                      F.when(F.col("user_id") % 3 != 0, F.col("p")).alias("profile_status"))


@query("log_1", "SELECT page_id, name FROM links")
def log_1(w):
    return lg.link_targets(w.table("pages"), "html", HREF, keep=["page_id"])


@query("log_2", "SELECT lower(name) AS key, arg_min(name, {'p': page_id, 'n': name}) AS name, min(page_id) AS discovered_at FROM links GROUP BY lower(name)")
def log_2(w):
    return lg.first_seen(lg.link_targets(w.table("pages"), "html", HREF, keep=["page_id"]), "page_id")


@query("log_3", """SELECT 'ratings' AS crawl, username FROM (SELECT * FROM cusers WHERE ratings_status IS NULL ORDER BY discovered_at, username LIMIT 20)
UNION ALL SELECT 'profile', username FROM cusers WHERE profile_status IS NULL AND ratings_status = 'ok'""")
def log_3(w):
    users = crawl_users(w)
    ratings = lg.pending(users, "ratings_status", 20).select(F.lit("ratings").alias("crawl"), "username")
    return ratings.unionByName(lg.pending(users, "profile_status", needs_ok="ratings_status").select(F.lit("profile").alias("crawl"), "username"))


@query("log_4", "SELECT username, nullif(ratings_status, 'error') AS ratings_status FROM cusers")
def log_4(w):
    return lg.requeue_errors(crawl_users(w), "ratings_status").select("username", "ratings_status")


@query("log_5", "SELECT coalesce(ratings_status, 'pending') AS ratings_status, coalesce(profile_status, 'pending') AS profile_status, count(*) AS n FROM cusers GROUP BY 1, 2")
def log_5(w):
    return lg.status_counts(crawl_users(w), "ratings_status", "profile_status")


@query("log_6", "SELECT count(*) AS n FROM cusers WHERE ratings_status IN ('http_403', 'http_404', 'empty')")
def log_6(w):
    return lg.blacklisted(crawl_users(w), "ratings_status")


@query("log_7", """SELECT username, CASE WHEN anime_id % 29 = 0 THEN anime_id + 100000000 ELSE anime_id END AS anime_id, status, score,
0 AS num_episodes_watched, 0 AS is_rewatching, '' AS updated_at, '' AS start_date, '' AS finish_date FROM clean""")
def log_7(w):
    return lg.flatten_animelist(animelist_pages(w), "page")




def profile_records(w):
    """Profiles as nested JSON; favourites from the user's best-rated items."""
    favs = w.clean.where("score = 10").groupBy("username").agg(F.array_sort(F.collect_set("anime_id")).alias("f"))
    p = w.profiles.join(favs, "username", "left")
    stats = F.struct(F.lit("1.5").alias("days_watched"), F.lit("7.25").alias("mean_score"), F.lit("12").alias("completed"))
    body = F.struct("gender", F.concat(F.col("joined_year").cast("string"), F.lit("-03-04T05:06:07+00:00")).alias("joined"),
                    F.struct(F.transform("f", lambda i: F.struct(i.alias("mal_id"))).alias("anime")).alias("favorites"),
                    F.struct(stats.alias("anime")).alias("statistics"))
    return p.select("username", F.to_json(body).alias("record"))


_FAVS = "SELECT username, list(DISTINCT anime_id ORDER BY anime_id) AS f FROM clean WHERE score = 10 GROUP BY username"
_EMPTY_STATS = ", ".join(f"'' AS {s}" for s in lg.STATISTICS if s not in ("days_watched", "mean_score", "completed"))


@query("log_8", f"""SELECT p.username, coalesce(gender, '') AS gender, '' AS birthday, '' AS location, coalesce(joined_year || '-03-04', '') AS joined,
coalesce(array_to_string(f.f, ' '), '') AS favorites_anime, '1.5' AS days_watched, '7.25' AS mean_score, '12' AS completed, {_EMPTY_STATS}, 'jikan' AS source
FROM profiles p LEFT JOIN ({_FAVS}) f ON p.username = f.username""")
def log_8(w):
    return lg.flatten_profile(profile_records(w), "record")


def profile_pages(w):
    """Profiles as HTML pages in the crawled layout, favourites listed twice."""
    favs = w.clean.where("score = 10").groupBy("username").agg(F.array_sort(F.collect_set("anime_id")).alias("f"))
    counts = w.clean.groupBy("username").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "completed").alias("c"))
    p = w.profiles.join(favs, "username", "left").join(counts, "username", "left")

    def side(label, value):
        return F.when(value.isNull(), "").otherwise(F.concat(
            F.lit(f'<span class="user-status-title di-ib">{label}</span><span class="user-status-data di-ib"> '), value, F.lit(" </span>")))
    links = F.array_join(F.transform("f", lambda i: F.concat(
        F.lit('<a href="https://myanimelist.net/anime/'), i.cast("string"), F.lit('/x"><img src="https://cdn/images/anime/9/8.jpg"></a>'))), "")
    n = F.format_number(F.coalesce("n", F.lit(0)) + 1000, 0)
    html = F.concat(side("Gender", F.col("gender")), side("Joined", F.concat(F.lit("Mar 4, "), F.col("joined_year").cast("string"))),
                    F.lit('<div class="stats anime"><span>Days: </span> 1,012.5 <span>Mean Score: </span> <span class="s">7.25</span>\n<a>Completed</a> <span class="x">'),
                    F.coalesce("c", F.lit(0)).cast("string"), F.lit('</span><span>Total Entries</span><span>'), n,
                    F.lit('</span></div><div class="stats manga"><a>Completed</a><span>99</span></div>'),
                    F.when(F.col("f").isNull(), "").otherwise(F.concat(F.lit('<ul id="anime_favorites">\n'), links, links, F.lit('</ul><ul id="manga_favorites"></ul>'))))
    return p.select("username", html.alias("html"))


_NO_STATS = ", ".join(f"'' AS {s}" for s in lg.COUNT_LABELS if s not in ("completed", "total_entries"))


@query("log_9", f"""SELECT p.username, coalesce(gender, '') AS gender, '' AS birthday, '' AS location, coalesce(joined_year || '-03-04', '') AS joined,
coalesce(array_to_string(f.f, ' '), '') AS favorites_anime, '1012.5' AS days_watched, '7.25' AS mean_score, CAST(coalesce(c.c, 0) AS VARCHAR) AS completed,
CAST(coalesce(c.n, 0) + 1000 AS VARCHAR) AS total_entries, {_NO_STATS}, 'html' AS source FROM profiles p LEFT JOIN ({_FAVS}) f ON p.username = f.username
LEFT JOIN (SELECT username, count(*) AS n, count(*) FILTER (WHERE status = 'completed') AS c FROM clean GROUP BY username) c ON p.username = c.username""")
def log_9(w):
    return lg.profile_from_html(profile_pages(w), "html")


def _tag_structs(c):
    return F.transform(c, lambda t: F.struct(t.alias("name")))


@query("log_10", """SELECT mal_id, title, 'EN ' || title AS title_english, 'm.jpg' AS image_url, score, rank, popularity,
CASE type WHEN 'PROMO' THEN 'TV Special' WHEN 'SMALL' THEN 'ONA' ELSE type END AS type, start_year AS year, episodes, 'Finished Airing' AS status, genres, studios, CAST(NULL AS VARCHAR) AS synopsis, 'main' AS src FROM items
UNION ALL SELECT mal_id, NULL, NULL, NULL, NULL, rank, popularity, type, start_year, episodes, NULL, list_concat(genres, list_concat(themes, demographics)), studios, NULL, 'second' FROM items""")
def log_10(w):
    media = F.when(F.col("type") == "PROMO", "tv_special").when(F.col("type") == "SMALL", "ona").otherwise(F.lower("type"))
    main = w.items.select(F.to_json(F.struct(
        F.col("mal_id").alias("id"), "title", F.struct(F.concat(F.lit("EN "), "title").alias("en")).alias("alternative_titles"),
        F.struct(F.lit("m.jpg").alias("medium")).alias("main_picture"), F.col("score").alias("mean"), "rank", "popularity", media.alias("media_type"),
        "start_date", F.col("episodes").alias("num_episodes"), F.lit("finished_airing").alias("status"),
        _tag_structs("genres").alias("genres"), _tag_structs("studios").alias("studios"))).alias("j"))
    year = F.year(F.try_to_timestamp("start_date"))
    second = w.items.select(F.to_json(F.struct(
        "mal_id", "rank", "popularity", "type", "episodes", _tag_structs("genres").alias("genres"), _tag_structs("themes").alias("themes"),
        _tag_structs("demographics").alias("demographics"), _tag_structs("studios").alias("studios"),
        F.struct(F.struct(F.struct(year.alias("year")).alias("from")).alias("prop")).alias("aired"))).alias("j"))
    a = lg.normalise_detail(main, "j").withColumn("src", F.lit("main"))
    return a.unionByName(lg.normalise_second(second, "j").withColumn("src", F.lit("second")), allowMissingColumns=True)


@query("log_11", "SELECT r.mal_id, d.score, d.members FROM (SELECT DISTINCT l_partkey * 3 AS mal_id FROM lineitem) r LEFT JOIN details d ON r.mal_id = d.mal_id")
def log_11(w):
    return lg.lookup(w.table("lineitem").select((F.col("l_partkey") * 3).alias("mal_id")), w.details, ["score", "members"])


@query("log_12", """SELECT mal_id, title, CAST(NULL AS VARCHAR) AS title_english, CASE type WHEN 'SMALL' THEN 'Movie' ELSE type END AS type, start_year AS year, score AS mal_score, 'l.jpg' AS image_url, true AS in_corpus FROM items""")
def log_12(w):
    media = F.when(F.col("type") == "SMALL", "movie").otherwise(F.lower("type"))
    nodes = w.items.select(F.to_json(F.struct(
        F.col("mal_id").alias("id"), "title", F.struct(F.lit("").alias("en")).alias("alternative_titles"), media.alias("media_type"), "start_date",
        F.col("score").alias("mean"), F.struct(F.lit("l.jpg").alias("large")).alias("main_picture"))).alias("j"))
    return lg.search_results(nodes, "j", w.items)


_LAST = "SELECT user_id, arg_max(status, event_id) AS status, arg_max(value, event_id) AS value FROM clog GROUP BY user_id"


@query("log_13", _LAST)
def log_13(w):
    return lg.latest_state(crawl_states(w), "user_id", "event_id", ["status", "value"])


@query("log_14", f"SELECT username, unnest(f) AS anime_id, len(f) > 20 AS too_many FROM ({_FAVS.replace('score = 10', 'score >= 2')})")
def log_14(w):
    favs = w.clean.where("score >= 2").groupBy("username").agg(F.array_join(F.array_sort(F.collect_set("anime_id")).cast("array<string>"), " ").alias("favs"))
    return lg.split_favourites(favs, "favs")


# -- streams ------------------------------------------------------------------------------
def _folder(w, name):
    return f"{stage_root(w.spark)}/{name}-{uuid.uuid4().hex}"


_EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, status STRING, value DOUBLE"
_PAGE_SCHEMA = "page_id BIGINT, ts TIMESTAMP, html STRING"


FILES = 4           # files of an appended batch


def _in_files(df, by, path, parts=3, overlap=False):
    """Write ``df`` as ``parts`` appended batches in ``by`` order; ``overlap`` repeats earlier rows as an at-least-once log does."""
    lo, hi = df.agg(F.min(by)).scalar(), df.agg(F.max(by)).scalar()
    part = F.least(F.floor((F.col(by) - lo) * parts / (hi - lo + 1)), F.lit(parts - 1))
    tagged = stage(df.withColumn("_part", part), "replay")
    for i in range(parts):
        cond = F.col("_part") == i
        if overlap and i:
            cond = cond | ((F.col("_part") == i - 1) & (F.col(by) % 5 == 0))
        tagged.where(cond).drop("_part").repartition(FILES).write.mode("append").json(path)
    return path


def _stream(w, path, schema):
    """One appended batch at a time."""
    return st.read_log(w.spark, path, schema, FILES)


def _event_files(w, overlap=False):
    return _in_files(crawl_states(w), "event_id", _folder(w, "events"), overlap=overlap)


def _page_files(w):
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 7).alias("ts")
    return _in_files(w.table("pages").select("page_id", ts, "html"), "page_id", _folder(w, "pages"))


def _discovered(w, horizon_minutes):
    registry = st.NameRegistry(w.spark, _folder(w, "registry"), buckets=16)
    sightings = st.name_sightings(_stream(w, _page_files(w), _PAGE_SCHEMA), HREF)
    st.run_batches(st.fresh_names(sightings, horizon_minutes), registry.add, _folder(w, "cp"), mode="update")
    return registry


@query("str_1", "SELECT DISTINCT lower(name) AS key FROM links")
def str_1(w):
    """Recent names are state that expires; older ones are recognised by the registry."""
    return _discovered(w, 2).table().select("key")


@query("str_2", "SELECT user_id, CAST(floor(value) AS BIGINT) % 10 AS slot, arg_max(status, event_id) AS status, max(event_id) AS event_id FROM clog GROUP BY 1, 2")
def str_2(w):
    """At-least-once files merged to the newest row per key; the last batch is delivered twice."""
    schema = "user_id BIGINT, slot BIGINT, event_id BIGINT, status STRING"
    keyed = _stream(w, _event_files(w, overlap=True), _EVENT_SCHEMA).select(
        "user_id", (F.floor("value") % 10).alias("slot"), "event_id", "status")
    table = st.KeepLastTable(w.spark, _folder(w, "keep-last"), ["user_id", "slot"], "event_id", schema, fan=2)

    def twice(batch, batch_id):
        table.merge(batch, batch_id)
        table.merge(batch, batch_id)
    st.run_batches(keyed, twice, _folder(w, "cp"))
    return table.table().select("user_id", "slot", "status", "event_id")


@query("str_3", "SELECT status, count(*) AS n FROM clog GROUP BY status")
def str_3(w):
    board = st.StatusBoard(w.spark, _folder(w, "board"))
    st.run_batches(st.live_status(_stream(w, _event_files(w), _EVENT_SCHEMA)), board.show, _folder(w, "cp"), mode="complete")
    return board.table()


@query("str_4", """SELECT 1704067200 + first // 60 * 60 AS start, count(*) AS n_new FROM (
SELECT lower(name) AS key, min(page_id * 7) AS first FROM links GROUP BY 1) GROUP BY 1""")
def str_4(w):
    """First sightings, counted by event-time windows of a second stream."""
    registry, board = _discovered(w, 60), st.IntervalBoard(w.spark, _folder(w, "intervals"))
    st.run_batches(st.names_per_interval(registry.stream(), late="100 days"), board.show, _folder(w, "cp"), mode="update")
    return board.table().withColumn("start", F.unix_timestamp("start"))


@query("str_5", "SELECT run, n FROM (SELECT unnest([1, 2, 3]) AS run, unnest([(SELECT count(*) FROM clog WHERE event_id < 5000), (SELECT count(*) FROM clog WHERE event_id < 5000), (SELECT count(*) FROM clog)]) AS n)")
def str_5(w):
    """Rows in the table after a run, after a second run with nothing new, and after more files came."""
    path, out, cp = _folder(w, "events"), _folder(w, "appended"), _folder(w, "cp")
    early = crawl_states(w).where("event_id < 5000")
    late = crawl_states(w).where("event_id >= 5000")
    counts = []
    for run, new in ((1, early), (2, None), (3, late)):
        if new is not None:
            new.repartition(FILES).write.mode("append").json(path)
        st.run_append(_stream(w, path, _EVENT_SCHEMA), out, cp)
        counts.append((run, w.spark.read.schema(_EVENT_SCHEMA).parquet(out).count()))
    return w.spark.createDataFrame(counts, "run INT, n BIGINT")


_PARTS = """(SELECT event_id, user_id, status, least((event_id - lo) * 3 // (hi - lo + 1), 2) AS part
FROM clog, (SELECT min(event_id) AS lo, max(event_id) AS hi FROM clog))"""


@query("str_6", f"""SELECT p.event_id, p.user_id, p.status FROM {_PARTS} p JOIN (
SELECT user_id, upto, arg_max(status, event_id) AS newest FROM {_PARTS}, (SELECT unnest([0, 1, 2]) AS upto) WHERE part <= upto GROUP BY ALL) n
ON n.user_id = p.user_id AND n.upto = p.part WHERE newest = 'ok'""")
def str_6(w):
    """Rows of users whose newest status is ok when their file comes."""
    states = st.KeepLastTable(w.spark, _folder(w, "states"), ["user_id"], "event_id", "user_id BIGINT, event_id BIGINT, status STRING")
    out = _folder(w, "gated")
    gate = st.Gate(states, "user_id", out, F.col("status") == "ok", ["event_id", "user_id", "status"])
    st.run_batches(_stream(w, _event_files(w), _EVENT_SCHEMA), gate.step, _folder(w, "cp"))
    return w.spark.read.schema("event_id BIGINT, user_id BIGINT, status STRING").parquet(out).drop("batch")


# -- checks: our own tables (0 expected) beside tables with planted faults ------------------------
def _both(clean, planted):
    return clean.withColumn("data", F.lit("own")).unionByName(planted.withColumn("data", F.lit("planted")))


def _expected(*rows):
    """Oracle of a check: ``own`` is 0, ``planted`` an SQL count of the planted faults."""
    return " UNION ALL ".join(f"SELECT '{name}' AS \"check\", CAST({n} AS BIGINT) AS violations, '{data}' AS data" for name, data, n in rows)


def _pairs(name, planted):
    return [(name, "own", "0"), (name, "planted", f"({planted})")]


@query("chk_1", _expected(*_pairs("item rows", "SELECT count(*) FROM items WHERE anime_idx % 10 = 0")))
def chk_1(w):
    n = w.item_index.agg(F.count("*") - 2).scalar()
    return _both(ck.row_count(w.items, "item rows", n), ck.row_count(w.items.where("anime_idx % 10 <> 0"), "item rows", n))


@query("chk_2", _expected(*_pairs("type_id in range", "SELECT count(*) FROM item_feats WHERE type_id >= 4")))
def chk_2(w):
    f = en.item_features(w.items)
    return _both(ck.in_range(f, "type_id", 7), ck.in_range(f, "type_id", 4))


@query("chk_3", _expected(*_pairs("genres_multihot width and values", "SELECT count(*) FROM item_feats WHERE anime_idx % 7 = 0 OR anime_idx % 9 = 0")))
def chk_3(w):
    f = en.item_features(w.items).select("anime_idx", "genres_multihot").withColumn("_w", F.size("genres_multihot"))
    width = w.items.select(F.explode("genres").alias("t")).distinct().count() + 1
    bad = f.withColumn("genres_multihot", F.when(F.col("anime_idx") % 7 == 0, F.slice("genres_multihot", 1, 3))
                       .when(F.col("anime_idx") % 9 == 0, F.transform("genres_multihot", lambda x: (x + 2).cast("tinyint"))).otherwise(F.col("genres_multihot")))
    return _both(ck.binary_width(f, "genres_multihot", width), ck.binary_width(bad, "genres_multihot", width))


@query("chk_4", _expected(*_pairs("user_idx unique and dense", "SELECT count(*) FROM split WHERE user_idx % 100 = 0")))
def chk_4(w):
    twice = w.split.select("user_idx").unionByName(w.split.where("user_idx % 100 = 0").select("user_idx"))
    return _both(ck.unique_key(w.split, "user_idx", 0), ck.unique_key(twice, "user_idx", 0))


@query("chk_5", _expected(*_pairs("history_ids aligned with history_scores", "SELECT count(*) FROM users WHERE user_idx % 11 = 0")))
def chk_5(w):
    bad = w.users.withColumn("history_scores", F.when(F.col("user_idx") % 11 == 0, F.array_append("history_scores", F.lit(1))).otherwise(F.col("history_scores")))
    return _both(ck.aligned(w.users, "history_ids", "history_scores"), ck.aligned(bad, "history_ids", "history_scores"))


@query("chk_6", _expected(*_pairs("history_scores descending", "SELECT count(*) FROM users WHERE user_idx % 11 = 0 AND len(history_ids) > 0")))
def chk_6(w):
    bad = w.users.withColumn("history_scores", F.when(F.col("user_idx") % 11 == 0, F.array_append("history_scores", F.lit(99))).otherwise(F.col("history_scores")))
    return _both(ck.descending(w.users, "history_scores"), ck.descending(bad, "history_scores"))


@query("chk_7", _expected(*_pairs("cold in history", "SELECT count(*) FROM cold")))
def chk_7(w):
    rows = w.users.select("user_idx", F.explode(F.concat("history_ids", "hard_neg_ids")).alias("anime_idx"))
    bad = rows.unionByName(w.cold.select(F.lit(0).alias("user_idx"), "anime_idx"))
    return _both(ck.disjoint(rows, w.cold, ["anime_idx"], "cold in history"), ck.disjoint(bad, w.cold, ["anime_idx"], "cold in history"))


@query("chk_8", _expected(*_pairs("cold examples in cold set", "SELECT count(*) FROM examples WHERE split = 'val_cold'"),
                          *_pairs("cold examples in own split", "SELECT count(*) FROM examples WHERE split = 'val_cold'")))
def chk_8(w):
    moved = w.examples.withColumn("anime_idx", F.when(F.col("split") == "val_cold", -5).otherwise(F.col("anime_idx"))).withColumn(
        "split", F.when(F.col("split") == "val_cold", "test_cold").otherwise(F.col("split")))
    return _both(ck.cold_examples(w.examples, w.cold, w.split), ck.cold_examples(moved, w.cold, w.split))


@query("chk_9", _expected(*_pairs("seen covers history and queries", "SELECT count(*) FROM (SELECT user_idx, anime_idx FROM ehist UNION ALL SELECT user_idx, anime_idx FROM queries) WHERE anime_idx % 2 = 1")))
def chk_9(w):
    return _both(ck.seen_covers(w.seen_rows, w.eval_history, w.queries),
                 ck.seen_covers(w.seen_rows.where("anime_idx % 2 = 0"), w.eval_history, w.queries))


@query("chk_10", _expected(*_pairs("evaluation example in history", "SELECT count(*) FROM queries WHERE anime_idx % 2 = 0")))
def chk_10(w):
    ex = w.examples.where("split <> 'train'")
    pair = ["user_idx", "anime_idx"]
    bad = w.eval_history.select(*pair).unionByName(w.queries.where("anime_idx % 2 = 0").select(*pair))
    return _both(ck.leak(ex, w.eval_history), ck.leak(ex, bad))


@query("chk_11", _expected(*_pairs("prior sums to one", "1"), *_pairs("prior finite", "SELECT count(*) FROM items WHERE anime_idx % 50 = 0"),
                           *_pairs("cold count zero", "SELECT count(*) FROM cold")))
def chk_11(w):
    prior = sm.popularity_prior(w.item_index, w.examples.where("split = 'train'"))
    bad = prior.withColumn("log_q", F.when((F.col("anime_idx") % 50 == 0) & (F.col("anime_idx") >= 2), F.lit(float("nan"))).otherwise(F.col("log_q") + 0.1)).withColumn("count", F.col("count") + 1)
    return _both(ck.prior_sums(prior, w.cold), ck.prior_sums(bad, w.cold))


@query("chk_12", _expected(*_pairs("qid dense", "SELECT count(*) - 1 FROM (SELECT DISTINCT user_idx FROM pool)")))
def chk_12(w):
    ids = lb.group_ids(w.pool)
    return _both(ck.dense_groups(ids), ck.dense_groups(ids.withColumn("qid", F.col("qid") * 2)))


@query("chk_13", _expected(*_pairs("cold missing flags", "SELECT count(*) FROM cold"), *_pairs("cold log counts", "SELECT count(*) FROM cold"), *_pairs("cold imputed alike", "1")))
def chk_13(w):
    bad = w.numbers.withColumns({"mal_score_missing": F.lit(0.0), "log_members": F.lit(1.0), "mal_score": F.col("anime_idx").cast("double")})
    return _both(ck.cold_policy(w.numbers, w.cold), ck.cold_policy(bad, w.cold))


@query("chk_14", _expected(*_pairs("masked candidate in pool", "SELECT count(*) FROM qmask"),
                           *_pairs("special item in pool", "SELECT count(DISTINCT user_idx) FROM pool"),
                           *_pairs("label equals membership", "SELECT count(*) + (SELECT count(*) FROM lpool WHERE label = 0) - (SELECT count(*) FROM lpool WHERE label = 0) FROM lpool")))
def chk_14(w):
    pool = w.labelled.select("user_idx", "anime_idx", "label")
    flipped = pool.withColumn("label", 1 - F.col("label"))
    special = pool.select("user_idx").distinct().select("user_idx", F.lit(1).alias("anime_idx"), F.lit(0).alias("label"))
    bad = flipped.unionByName(special).unionByName(w.query_mask.select("user_idx", "anime_idx", F.lit(0).alias("label")))
    return _both(ck.pool_clean(pool, w.query_mask, w.queries), ck.pool_clean(bad, w.query_mask, w.queries))


@query("chk_15", _expected(*_pairs("pool sorted by cosine", "SELECT count(*) FROM (SELECT -cos AS c, lag(-cos) OVER (PARTITION BY user_idx ORDER BY pool_rank) AS p FROM pool) WHERE c > p"),
                           *_pairs("r_total counts queries", "SELECT count(*) FROM side")))
def chk_15(w):
    bad_side = w.side.withColumn("r_total", F.col("r_total") + 1)
    return _both(ck.pool_sorted(w.pool, w.side, w.queries), ck.pool_sorted(w.pool.withColumn("cos", -F.col("cos")), bad_side, w.queries))


@query("chk_16", _expected(*_pairs("pool of training users", "SELECT count(DISTINCT user_idx) FROM tlab"), *_pairs("labels recomputed", "SELECT count(*) FROM tlab"),
                           *_pairs("positive in every group", "SELECT count(*) FROM (SELECT max(label) AS m FROM tlab GROUP BY user_idx) WHERE m = 0")))
def chk_16(w):
    kept = lb.keep_positive_groups(w.train_labelled)
    bad = w.train_labelled
    return _both(ck.train_pool(kept, w.users, w.train_labelled),
                 ck.train_pool(bad, w.users.where("split = 'val'"), bad.withColumn("label", F.col("label") + 1)))


@query("chk_17", _expected(*_pairs("same anime_idx on both sides", "SELECT count(*) FROM items WHERE anime_idx % 3 = 0 OR anime_idx % 4 = 0")
                           ).replace("OR anime_idx % 4 = 0", "AND anime_idx % 4 <> 0 OR anime_idx % 4 = 0 AND anime_idx % 3 <> 0"))
def chk_17(w):
    return _both(ck.same_keys(w.ivec, w.item_index, "anime_idx"),
                 ck.same_keys(w.items.where("anime_idx % 3 <> 0"), w.items.where("anime_idx % 4 <> 0"), "anime_idx"))


@query("chk_18", _expected(*_pairs("map built from these vectors", "1")))
def chk_18(w):
    """A fingerprint kept beside a derived table against the source, unchanged and with one row repeated."""
    kept = stage(ck.fingerprint(w.ivec), "fingerprint")
    more = w.ivec.unionByName(w.ivec.where("anime_idx = 2"))
    name = "map built from these vectors"
    return _both(ck.same_fingerprint(kept, w.ivec, name), ck.same_fingerprint(kept, more, name))


@query("chk_19", _expected(*_pairs("vectors close", "SELECT count(*) FROM items WHERE anime_idx % 10 = 0")))
def chk_19(w):
    a = w.ivec.where("anime_idx >= 2")
    near = a.withColumn("vec", F.transform("vec", lambda x: x + F.lit(1e-9)))
    far = a.withColumn("vec", F.when(F.col("anime_idx") % 10 == 0, F.transform("vec", lambda x: x + F.lit(0.01))).otherwise(F.col("vec")))
    return _both(ck.vectors_close(a, near, "anime_idx", 1e-6), ck.vectors_close(a, far, "anime_idx", 1e-6))


# -- estimators -----------------------------------------------------------------------------------
@query("est_1")
def est_1(w):
    """Learned unit vectors of the items in training examples."""
    _, items = es.learn_vectors(w.examples.where("split = 'train'"))
    return items.withColumn("vec", rounded(F.col("vec"), 4))


@query("est_1_content")
def est_1_content(w):
    """Vectors of all items, cold ones too, from their genres, themes, studios and year."""
    _, learned = es.learn_vectors(w.examples.where("split = 'train'"))
    feats = w.items
    for column in ("genres", "themes", "studios"):
        feats = en.multi_hot(feats, column, f"{column}_bits")
    year = F.array(F.coalesce((F.year(F.try_to_timestamp("start_date")) - 2000) / 10.0, F.lit(0.0)))
    bits = [F.col(f"{column}_bits").cast("array<double>") for column in ("genres", "themes", "studios")]
    feats = feats.select("anime_idx", F.concat(*bits, year).alias("x"))
    out = es.fit_content(feats, learned, "anime_idx", "x").vectors(feats, "anime_idx", "x")
    return out.withColumn("vec", rounded(F.col("vec"), 4))


@query("est_2")
def est_2(w):
    """Feature importances of a ranker fitted on the training pools."""
    return es.importances(w.spark, w.ranker)


@query("est_2_scores")
def est_2_scores(w):
    """The evaluation pools scored by that ranker."""
    return w.ranked(w.pool).withColumn("pred", F.round("pred", 6))


@query("est_3")
def est_3(w):
    return es.kmeans(w.ivec.where("anime_idx >= 2"), "anime_idx", ["vec"], 28)[0]


@query("est_4")
def est_4(w):
    """Hard labels and shares of a mixture of diagonal Gaussians."""
    return w.mixture.select("anime_idx", "label", rounded(F.col("shares"), 4).alias("shares"))


@query("est_5")
def est_5(w):
    return es.kmeans(w.points, "mal_id", ["x", "y"], 12)[0]


@query("est_6")
def est_6(w):
    return es.project(w.ivec.where("anime_idx >= 2"), "anime_idx", "vec").withColumns({c: F.round(c, 4) for c in ("x", "y")})


@query("est_6_layout")
def est_6_layout(w):
    """Places of the safe items from their neighbour graph."""
    return w.layout.withColumns({c: F.round(c, 4) for c in ("x", "y")})


@query("est_6_kept")
def est_6_kept(w):
    """Share of linked items that stay neighbours on the map, for the layout and for the principal components."""
    flat = es.project(w.ivec.join(w.layout, "anime_idx", "left_semi"), "anime_idx", "vec")
    graph, components = (la.kept_neighbours(w.links, places).select(F.lit(name).alias("method"), F.round("share", 4).alias("share"))
                         for name, places in (("graph", w.layout), ("components", flat)))
    return graph.unionByName(components)


@query("est_7")
def est_7(w):
    """Sweep of clusterings over a grid of settings; equal settings run once (without a cut ``dims`` means nothing)."""
    grid = es.knob_grid(w.spark, {"k": [4, 8], "cut": [True, False], "dims": [16, 32]}, {"cut": ["dims"]})
    picked = es.random_settings(grid, 4, 7)
    return es.kmeans_sweep(w.ivec.where("anime_idx >= 2"), "vec", picked).withColumn("cost", F.round("cost", 3))


@query("est_7_ranker")
def est_7_ranker(w):
    """Metrics of every setting of the ranker on the evaluation pools."""
    return w.sweep.withColumn("value", F.round("value", 4))
