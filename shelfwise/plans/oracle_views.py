"""DuckDB common table expressions, in dependency order, for the oracle queries."""

from __future__ import annotations

from shelfwise.sources.adapters import DETAILS, LOG_ORDER, PROFILES, RATINGS

POOL = 200
_POS = "status IN ('completed', 'watching') AND NOT (score BETWEEN 1 AND 4)"
_NEG = "(status = 'dropped' OR score BETWEEN 1 AND 4)"


def u32(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def _list(col: str) -> str:
    return (f"CASE WHEN {col} IS NULL OR {col} = '[]' THEN []::VARCHAR[] ELSE "
            f"list_transform(regexp_extract_all({col}, '''[^'']*''|\"[^\"]*\"'), lambda q: q[2:len(q)-1]) END")


def _unrolled(rounds: int) -> str:
    """Pairs left by ``rounds`` of the k-core, without flagged users."""
    parts, live = [], "(SELECT username, anime_id FROM clean WHERE username NOT IN (SELECT username FROM flagged WHERE flagged))"
    for i in range(rounds):
        parts.append(f"k{i}u AS MATERIALIZED (SELECT * FROM {live} WHERE username IN (SELECT username FROM {live} GROUP BY username HAVING count(*) >= 10))")
        parts.append(f"k{i}i AS MATERIALIZED (SELECT * FROM k{i}u WHERE anime_id IN (SELECT anime_id FROM k{i}u GROUP BY anime_id HAVING count(*) >= 20))")
        live = f"k{i}i"
    return f"WITH {', '.join(parts)} SELECT * FROM {live}"


VIEWS: dict[str, str] = {
    "ratings_raw": f"SELECT *, row_number() OVER (ORDER BY {', '.join(LOG_ORDER)}) AS seq FROM ({RATINGS})",
    "details": DETAILS,
    "profiles": PROFILES,
    "clean": """
        SELECT username, anime_id, status, score FROM (
          SELECT *, row_number() OVER (PARTITION BY username, anime_id ORDER BY seq DESC) AS rn FROM ratings_raw
          WHERE status <> 'unknown' AND username IN (SELECT username FROM profiles)
            AND anime_id IN (SELECT mal_id FROM details)) WHERE rn = 1""",
    "stats": """
        SELECT username, count(*) AS n, count(*) FILTER (WHERE status <> 'plan_to_watch') AS watched,
               count(*) FILTER (WHERE score > 0) AS rated, avg(score) FILTER (WHERE score > 0) AS mean_score,
               stddev_samp(score) FILTER (WHERE score > 0) AS std_score FROM clean GROUP BY username""",
    "flagged": """
        SELECT *, spam_pos OR const_rater OR physical OR nan_lister AS flagged FROM (
          SELECT *, rated > 2000 AND mean_score > 9.0 AS spam_pos, rated > 500 AND std_score < 0.3 AS const_rater,
                 watched > 5000 AS physical, watched > 1000 AND mean_score IS NULL AS nan_lister FROM stats)""",
    "flagged_low": """
        SELECT *, spam_pos OR const_rater OR physical OR nan_lister AS flagged FROM (
          SELECT *, rated > 30 AND mean_score > 6.0 AS spam_pos, rated > 8 AND std_score < 2.2 AS const_rater,
                 watched > 48 AS physical, watched > 1 AND mean_score IS NULL AS nan_lister FROM stats)""",
    "kcore": _unrolled(12),
    "cleaned": """
        SELECT * FROM clean WHERE username IN (SELECT username FROM kcore) AND anime_id IN (SELECT anime_id FROM kcore)""",
    "items": f"""
        SELECT * REPLACE ({_list('genres')} AS genres, {_list('themes')} AS themes, {_list('studios')} AS studios,
                          {_list('demographics')} AS demographics),
               CAST(row_number() OVER (ORDER BY mal_id) + 1 AS INTEGER) AS anime_idx,
               CAST(substr(start_date, 1, 4) AS INTEGER) AS start_year, demographics AS demographics_text
        FROM details""",
    "cold": """
        SELECT anime_idx, mal_id, start_date FROM (
          SELECT *, row_number() OVER (ORDER BY start_date DESC, anime_idx) AS r FROM items WHERE start_date IS NOT NULL)
        WHERE r <= (SELECT ceil(count(*) * 0.05) FROM items)""",
    "item_index": """
        SELECT anime_idx, mal_id, anime_idx IN (SELECT anime_idx FROM cold) AS is_cold FROM items
        UNION ALL SELECT * FROM (VALUES (CAST(0 AS INTEGER), CAST(-1 AS BIGINT), false), (1, -1, false))""",
    "counts": f"""
        SELECT username, count(*) FILTER (WHERE {_POS}) AS n_pos, count(*) FILTER (WHERE {_NEG}) AS n_hardneg
        FROM cleaned GROUP BY username""",
    "split": f"""
        SELECT *, CAST(row_number() OVER (ORDER BY username) - 1 AS INTEGER) AS user_idx FROM (
          SELECT *, CASE WHEN n_pos < 11 OR {u32("username || ':42'")} % 100 < 90 THEN 'train'
                         WHEN {u32("username || ':42'")} % 100 < 95 THEN 'val' ELSE 'test' END AS split
          FROM counts WHERE n_pos >= 1)""",
    "base": f"""
        SELECT user_idx, anime_idx, is_pos, is_hardneg, score, split FROM (
          SELECT s.user_idx, i.anime_idx, {_POS} AS is_pos, {_NEG} AS is_hardneg, c.score, s.split
          FROM (SELECT * FROM cleaned) c JOIN (SELECT mal_id, anime_idx FROM items) i ON c.anime_id = i.mal_id
          JOIN (SELECT username, user_idx, split FROM split) s ON c.username = s.username)
        WHERE is_pos OR is_hardneg OR split <> 'train'""",
    "warm": f"""
        SELECT *, row_number() OVER (PARTITION BY user_idx ORDER BY tie, anime_idx) AS tie_rank,
               count(*) OVER (PARTITION BY user_idx) AS n_warm FROM (
          SELECT user_idx, anime_idx, score, split, {u32("'42:' || user_idx || ':' || anime_idx")} AS tie
          FROM base WHERE is_pos AND anime_idx NOT IN (SELECT anime_idx FROM cold))""",
    "marked": """
        SELECT *, split <> 'train' AND tie_rank <= least(greatest(round(0.2::DOUBLE * n_warm), 1), n_warm - 1) AS is_query
        FROM warm""",
    "examples": """
        SELECT user_idx, anime_idx, score, split FROM marked WHERE is_query OR split = 'train'
        UNION ALL SELECT user_idx, anime_idx, score, split || '_cold' FROM base
        WHERE is_pos AND split <> 'train' AND anime_idx IN (SELECT anime_idx FROM cold)""",
    "hrows": """
        SELECT user_idx, anime_idx, score, tie, split,
               CAST(row_number() OVER (PARTITION BY user_idx ORDER BY score DESC, tie, anime_idx) - 1 AS INTEGER) AS pos
        FROM marked WHERE NOT is_query""",
    "hist": """
        SELECT user_idx, list(anime_idx ORDER BY pos) AS history_ids, list(score ORDER BY pos) AS history_scores
        FROM hrows GROUP BY user_idx""",
    "hardneg": """
        SELECT user_idx, list_sort(list(DISTINCT anime_idx))[1:64] AS hard_neg_ids FROM base
        WHERE is_hardneg AND anime_idx NOT IN (SELECT anime_idx FROM cold) GROUP BY user_idx""",
    "gender_codes": """
        SELECT gender, CAST(row_number() OVER (ORDER BY gender) AS INTEGER) AS code
        FROM (SELECT DISTINCT gender FROM profiles WHERE gender IS NOT NULL)""",
    "profile_codes": """
        SELECT p.username, coalesce(g.code, 0) AS gender_id,
               CASE WHEN joined_year IS NULL THEN 4 WHEN joined_year <= 2012 THEN 0 WHEN joined_year <= 2016 THEN 1
                    WHEN joined_year <= 2019 THEN 2 WHEN joined_year <= 2021 THEN 3 ELSE 4 END AS joined_bucket
        FROM profiles p LEFT JOIN gender_codes g ON p.gender = g.gender""",
    "user_feats": """
        SELECT s.user_idx, s.split, coalesce(p.gender_id, 0) AS gender_id, coalesce(p.joined_bucket, 4) AS joined_bucket
        FROM (SELECT * FROM split) s LEFT JOIN profile_codes p ON s.username = p.username""",
    "users": """
        SELECT f.user_idx, f.split, f.gender_id, f.joined_bucket, coalesce(h.history_ids, []::INTEGER[]) AS history_ids,
               coalesce(h.history_scores, []::INTEGER[]) AS history_scores,
               coalesce(n.hard_neg_ids, []::INTEGER[]) AS hard_neg_ids
        FROM user_feats f LEFT JOIN hist h ON f.user_idx = h.user_idx LEFT JOIN hardneg n ON f.user_idx = n.user_idx""",
    "seen": "SELECT DISTINCT user_idx, anime_idx FROM base WHERE split <> 'train'",
    "type_codes": "SELECT value, CAST(row_number() OVER (ORDER BY value) AS INTEGER) AS code FROM (SELECT DISTINCT type AS value FROM details WHERE type IS NOT NULL)",
    "source_codes": "SELECT value, CAST(row_number() OVER (ORDER BY value) AS INTEGER) AS code FROM (SELECT DISTINCT source AS value FROM details WHERE source IS NOT NULL)",
    "rating_codes": "SELECT value, CAST(row_number() OVER (ORDER BY value) AS INTEGER) AS code FROM (SELECT DISTINCT rating AS value FROM details WHERE rating IS NOT NULL)",
    "demo_codes": "SELECT value, CAST(row_number() OVER (ORDER BY value) AS INTEGER) AS code FROM (SELECT DISTINCT demographics[1] AS value FROM items WHERE len(demographics) > 0)",
    "genre_tags": "SELECT list(DISTINCT t ORDER BY t) AS tags FROM (SELECT unnest(genres) AS t FROM items)",
    "theme_tags": "SELECT list(DISTINCT t ORDER BY t) AS tags FROM (SELECT unnest(themes) AS t FROM items)",
    "studio_tags": "SELECT list(t ORDER BY t) AS tags FROM (SELECT t FROM (SELECT unnest(studios) AS t FROM items) GROUP BY t HAVING count(*) >= 10)",
    "item_feats": """
        SELECT i.anime_idx, coalesce(a.code, 0) AS type_id, coalesce(b.code, 0) AS source_id,
               coalesce(c.code, 0) AS rating_id, coalesce(d.code, 0) AS demographics_id,
               CASE WHEN start_year IS NULL THEN 0 WHEN start_year <= 1989 THEN 1 WHEN start_year <= 1999 THEN 2
                    WHEN start_year <= 2009 THEN 3 WHEN start_year <= 2017 THEN 4 ELSE 5 END AS startyear_bucket,
               CASE WHEN episodes IS NULL OR episodes < 0 THEN 0 WHEN episodes <= 1 THEN 1 WHEN episodes <= 2 THEN 2
                    WHEN episodes <= 6 THEN 3 WHEN episodes <= 13 THEN 4 WHEN episodes <= 26 THEN 5
                    WHEN episodes <= 52 THEN 6 ELSE 7 END AS episodes_bucket,
               list_concat([CAST(list_contains(genres, t) AS TINYINT) FOR t IN gt],
                           [CAST(len(genres) > 0 AS TINYINT)]) AS genres_multihot,
               list_concat([CAST(list_contains(themes, t) AS TINYINT) FOR t IN tt],
                           [CAST(len(themes) > 0 AS TINYINT)]) AS themes_multihot,
               CASE WHEN len(studios) = 0 THEN [0] ELSE list_sort(list_distinct(
                 [CAST(coalesce(list_position(st, s), 0) AS INTEGER) + 1 FOR s IN studios])) END AS studio_ids
        FROM items i LEFT JOIN type_codes a ON i.type = a.value LEFT JOIN source_codes b ON i.source = b.value
        LEFT JOIN rating_codes c ON i.rating = c.value LEFT JOIN demo_codes d ON i.demographics[1] = d.value
        CROSS JOIN (SELECT tags AS gt FROM genre_tags) CROSS JOIN (SELECT tags AS tt FROM theme_tags)
        CROSS JOIN (SELECT tags AS st FROM studio_tags)""",
}


def _mean_vec(rows: str, weight: str = "1.0::DOUBLE") -> str:
    """(user_idx, vec): weighted mean of the item vectors of ``rows``."""
    return f"""
        SELECT user_idx, list(v ORDER BY d) AS vec FROM (
          SELECT user_idx, d, sum(v * w) / sum(w) AS v FROM (
            SELECT h.user_idx, {weight} AS w, unnest(i.vec) AS v, generate_subscripts(i.vec, 1) AS d
            FROM ({rows}) h JOIN ivec i ON h.anime_idx = i.anime_idx) GROUP BY user_idx, d) GROUP BY user_idx"""


def _unit(view: str) -> str:
    return f"""SELECT user_idx, [x / greatest(n, 1e-12) FOR x IN vec] AS vec
        FROM (SELECT user_idx, vec, sqrt(list_sum([y * y FOR y IN vec])) AS n FROM {view})"""


def _pool(users: str, mask: str, k: int, items: str = "SELECT anime_idx, vec FROM ivec WHERE anime_idx >= 2") -> str:
    return f"""
        SELECT user_idx, anime_idx, cos, row_number() OVER (PARTITION BY user_idx ORDER BY cos DESC, anime_idx) - 1 AS pool_rank
        FROM (SELECT u.user_idx, i.anime_idx, round(list_inner_product(u.vec, i.vec), 6) + 0.0 AS cos
              FROM ({users}) u, ({items}) i WHERE NOT EXISTS (SELECT 1 FROM {mask} m WHERE m.user_idx = u.user_idx AND m.anime_idx = i.anime_idx))
        QUALIFY row_number() OVER (PARTITION BY user_idx ORDER BY cos DESC, anime_idx) <= {k}"""


VIEWS |= {
    "ivec": """
        SELECT i.anime_idx, [CAST(x AS DOUBLE) FOR x IN e.embedding] AS vec, e.label, i.mal_id
        FROM items i JOIN embeddings e ON i.mal_id % (SELECT count(*) FROM embeddings) = e.vec_id""",
    "evalu": "SELECT user_idx, username, split FROM split WHERE split <> 'train'",
    "ehist": "SELECT * FROM hrows WHERE split <> 'train'",
    "upool": _mean_vec("SELECT * FROM ehist WHERE pos < 1024"),
    "uvec": f"""SELECT e.user_idx, coalesce(u.vec, [0.125::DOUBLE FOR x IN range(64)]) AS vec
        FROM evalu e LEFT JOIN ({_unit('upool')}) u ON e.user_idx = u.user_idx""",
    "queries": "SELECT user_idx, anime_idx, score, split FROM examples WHERE split IN ('val', 'test')",
    "qmask": """SELECT user_idx, anime_idx FROM seen WHERE user_idx IN (SELECT user_idx FROM queries)
        EXCEPT SELECT user_idx, anime_idx FROM queries""",
    "pool": _pool("SELECT * FROM uvec WHERE user_idx IN (SELECT user_idx FROM queries)", "qmask", POOL),
    "ritems": """
        SELECT x.anime_idx, x.is_cold, d.type, d.source, d.rating, d.demographics,
               CASE WHEN NOT x.is_cold THEN d.score END AS score, CASE WHEN NOT x.is_cold THEN d.popularity END AS popularity,
               CASE WHEN NOT x.is_cold THEN d.rank END AS rank, CASE WHEN x.is_cold THEN 0 ELSE d.scored_by END AS scored_by,
               CASE WHEN x.is_cold THEN 0 ELSE d.members END AS members, CASE WHEN x.is_cold THEN 0 ELSE d.favorites END AS favorites,
               d.episodes, CAST(substr(d.start_date, 1, 4) AS INTEGER) AS year, d.mal_id
        FROM item_index x LEFT JOIN details d ON x.mal_id = d.mal_id""",
    "numbers": """
        SELECT anime_idx, coalesce(score, (SELECT median(score) FROM ritems)) AS mal_score,
               (score IS NULL)::INT::DOUBLE AS mal_score_missing, ln(1 + coalesce(scored_by, 0)::DOUBLE) AS log_scored_by,
               ln(1 + coalesce(members, 0)::DOUBLE) AS log_members, ln(1 + coalesce(favorites, 0)::DOUBLE) AS log_favorites,
               coalesce(popularity::DOUBLE, (SELECT median(popularity) FROM ritems)) AS popularity,
               coalesce(rank::DOUBLE, (SELECT median(rank) FROM ritems)) AS rank, (rank IS NULL)::INT::DOUBLE AS rank_missing,
               coalesce(episodes::DOUBLE, (SELECT median(episodes) FROM ritems)) AS episodes,
               2024 - coalesce(year::DOUBLE, (SELECT median(year) FROM ritems)) AS recency_years FROM ritems""",
    "codes": """
        SELECT r.anime_idx, coalesce(a.code, 0) AS type_code, coalesce(b.code, 0) AS source_code, coalesce(c.code, 0) AS rating_code,
               coalesce(d.code, 0) AS demo_code, CASE WHEN year IS NULL THEN 0 WHEN year <= 1989 THEN 1 WHEN year <= 1999 THEN 2
               WHEN year <= 2009 THEN 3 WHEN year <= 2017 THEN 4 ELSE 5 END AS era_code
        FROM ritems r LEFT JOIN type_codes a ON r.type = a.value LEFT JOIN source_codes b ON r.source = b.value
        LEFT JOIN rating_codes c ON r.rating = c.value
        LEFT JOIN (SELECT v, CAST(row_number() OVER (ORDER BY v) AS INTEGER) AS code FROM (SELECT DISTINCT demographics AS v FROM details WHERE demographics <> '[]')) d
          ON r.demographics = d.v""",
    "tags": """
        SELECT DISTINCT anime_idx, 'genre' AS kind, tag FROM (SELECT anime_idx, unnest(genres) AS tag FROM items)
        UNION ALL SELECT DISTINCT anime_idx, 'theme', tag FROM (SELECT anime_idx, unnest(themes) AS tag FROM items)""",
    "ustats": """
        SELECT e.user_idx, coalesce(n, 0)::DOUBLE AS u_n_rated, coalesce(m, 0)::DOUBLE AS u_mean_score,
               coalesce(s, 0)::DOUBLE AS u_std_score, coalesce(len, 0)::DOUBLE AS support_len
        FROM evalu e LEFT JOIN (SELECT user_idx, count(*) FILTER (WHERE score >= 1) AS n, avg(score) FILTER (WHERE score >= 1) AS m,
               stddev_pop(score) FILTER (WHERE score >= 1) AS s, count(*) AS len FROM ehist GROUP BY user_idx) h ON e.user_idx = h.user_idx""",
    "ages": "SELECT e.user_idx, CAST(2024 - p.joined_year AS DOUBLE) AS u_account_age FROM evalu e LEFT JOIN profiles p ON e.username = p.username",
    "sims": """
        SELECT p.user_idx, p.anime_idx, coalesce(max(s), 0) AS hist_cos_max, coalesce(avg(s), 0) AS hist_cos_mean,
               coalesce(avg(s) FILTER (WHERE r <= 5), 0) AS hist_cos_top5_mean
        FROM pool p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY user_idx, anime_idx ORDER BY s DESC) AS r FROM (
          SELECT p.user_idx, p.anime_idx, list_inner_product(a.vec, b.vec) AS s FROM pool p JOIN ivec a ON p.anime_idx = a.anime_idx
          JOIN (SELECT * FROM ehist WHERE pos < 256) h ON p.user_idx = h.user_idx JOIN ivec b ON h.anime_idx = b.anime_idx)) x
          ON p.user_idx = x.user_idx AND p.anime_idx = x.anime_idx GROUP BY p.user_idx, p.anime_idx""",
    "taste": """
        SELECT h.user_idx, t.kind, t.tag, count(*)::DOUBLE / any_value(h.n) AS pref
        FROM (SELECT *, count(*) OVER (PARTITION BY user_idx) AS n FROM ehist WHERE pos < 256) h
        JOIN tags t ON h.anime_idx = t.anime_idx GROUP BY h.user_idx, t.kind, t.tag""",
    "aff": """
        SELECT p.user_idx, p.anime_idx, coalesce(sum(f.pref) FILTER (WHERE f.kind = 'genre'), 0) AS genre_aff,
               coalesce(sum(f.pref) FILTER (WHERE f.kind = 'theme'), 0) AS theme_aff,
               count(*) FILTER (WHERE f.kind = 'genre' AND f.pref > 0)::DOUBLE AS genre_overlap
        FROM pool p LEFT JOIN tags t ON p.anime_idx = t.anime_idx
        LEFT JOIN taste f ON f.user_idx = p.user_idx AND f.kind = t.kind AND f.tag = t.tag GROUP BY p.user_idx, p.anime_idx""",
    "liked": """
        SELECT q.user_idx, q.anime_idx FROM queries q JOIN ustats s ON q.user_idx = s.user_idx
        WHERE s.u_n_rated > 0 AND q.score >= 1 AND q.score > s.u_mean_score""",
    "side": """
        SELECT q.user_idx, count(*) AS r_total, (SELECT count(*) FROM liked l WHERE l.user_idx = q.user_idx) AS r_liked
        FROM queries q GROUP BY q.user_idx""",
    "lpool": """
        SELECT p.*, n.mal_score / 10 AS pred, (q.user_idx IS NOT NULL)::INT AS label, (l.user_idx IS NOT NULL)::INT AS label_liked
        FROM pool p JOIN numbers n ON p.anime_idx = n.anime_idx
        LEFT JOIN queries q ON p.user_idx = q.user_idx AND p.anime_idx = q.anime_idx
        LEFT JOIN liked l ON p.user_idx = l.user_idx AND p.anime_idx = l.anime_idx""",
    "rn": """
        SELECT *, (row_number() OVER (PARTITION BY user_idx ORDER BY cos, pool_rank) - 1)::DOUBLE / greatest(count(*) OVER (PARTITION BY user_idx) - 1, 1) AS rn_cos,
               (row_number() OVER (PARTITION BY user_idx ORDER BY pred, pool_rank) - 1)::DOUBLE / greatest(count(*) OVER (PARTITION BY user_idx) - 1, 1) AS rn_pred
        FROM lpool""",
    # training pools: all eligible users, their support and targets
    "tkeyed": f"""
        SELECT *, row_number() OVER (PARTITION BY user_idx ORDER BY k, pos) <= least(greatest(round(0.2::DOUBLE * n), 1), n - 1) AS is_target FROM (
          SELECT user_idx, anime_idx, score, pos, count(*) OVER (PARTITION BY user_idx) AS n, {u32("'42:' || user_idx || ':' || anime_idx")} AS k
          FROM hrows WHERE user_idx IN (SELECT user_idx FROM users WHERE split = 'train' AND len(history_ids) >= 5))""",
    "tsup": "SELECT user_idx, anime_idx, score FROM tkeyed WHERE NOT is_target",
    "ttgt": "SELECT user_idx, anime_idx, score FROM tkeyed WHERE is_target",
    "tmask": "SELECT user_idx, anime_idx FROM tsup UNION SELECT user_idx, unnest(hard_neg_ids) FROM hardneg WHERE user_idx IN (SELECT user_idx FROM tsup)",
    "tvec0": _mean_vec("SELECT * FROM tsup"),
    "tvec": _unit("tvec0"),
    "tpool": _pool("SELECT * FROM tvec", "tmask", POOL,
                   "SELECT anime_idx, vec FROM ivec WHERE anime_idx NOT IN (SELECT anime_idx FROM cold)"),
    "tlab": """
        SELECT p.*, coalesce(CASE WHEN t.score >= 10 THEN 4 WHEN t.score >= 9 THEN 3 WHEN t.score >= 7 THEN 2 WHEN t.score IS NOT NULL THEN 1 END, 0) AS label,
               coalesce(t.score, 0) AS target_score
        FROM tpool p LEFT JOIN ttgt t ON p.user_idx = t.user_idx AND p.anime_idx = t.anime_idx""",
}


def metrics_sql(pool: str, score: str, ks: list[int], *, by: str = "", side: str = "side", label: str = "label",
                total: str = "r_total", prefix: str = "", pooled: bool = False) -> str:
    """(by, metric, value) over a pool with columns user_idx, pool_rank, ``label`` and the score expression."""
    comma, part = (f"{by}, ", f"{by}, ") if by else ("", "")
    group = f"GROUP BY {by}" if by else ""
    inner = f"""SELECT *, row_number() OVER (PARTITION BY {part}user_idx ORDER BY {score} DESC, pool_rank) - 1 AS rk FROM ({pool})"""
    ideal = ", ".join(f"(SELECT sum(1 / log2(r + 2)) FROM range(least(any_value(s.{total}), {k})) t(r)) AS i{k}" for k in ks)
    sums = ", ".join(f"sum(CASE WHEN rk < {k} THEN {label} ELSE 0 END) AS h{k}, sum(CASE WHEN rk < {k} THEN {label} / log2(rk + 2) ELSE 0 END) AS d{k}" for k in ks)
    per = f"""SELECT {comma}p.user_idx, any_value(s.{total}) AS R, {sums}, {ideal} FROM ({inner}) p JOIN {side} s ON p.user_idx = s.user_idx
              WHERE s.{total} > 0 GROUP BY {comma}p.user_idx"""
    names, vals = [], []
    for k in ks:
        names.append(f"{prefix}recall@{k}")
        vals.append(f"avg(h{k}::DOUBLE / R)")
    for k in ks:
        names.append(f"{prefix}ndcg@{k}")
        vals.append(f"avg(d{k} / i{k})")
    names.append("n_users_liked" if prefix else "n_users")
    vals.append("count(*)::DOUBLE")
    if pooled:
        for k in ks:
            names.append(f"hitrate@{k}")
            vals.append(f"sum(h{k})::DOUBLE / sum(R)")
        names.append("n_pairs")
        vals.append("sum(R)::DOUBLE")
    cols = ", ".join(f"{v} AS m{i}" for i, v in enumerate(vals))
    return f"""SELECT {comma}unnest({names!r}) AS metric, unnest([{', '.join(f'm{i}' for i in range(len(vals)))}]) AS value
               FROM (SELECT {comma}{cols} FROM ({per}) {group})"""

_WARM = """SELECT anime_idx, vec FROM ivec WHERE anime_idx NOT IN (SELECT anime_idx FROM cold)
           AND anime_idx NOT IN (SELECT anime_idx FROM adult)"""

VIEWS |= {
    "adult": "SELECT anime_idx FROM items WHERE list_contains(genres, 'Hentai') OR rating = 'Rx - Hentai'",
    "wpool": _pool("SELECT * FROM uvec", "seen", POOL, _WARM),
    "wpred": """
        SELECT p.*, round(0.5::DOUBLE * p.cos + 0.03::DOUBLE * n.mal_score + 0.02::DOUBLE * n.log_members
                          + 0.01::DOUBLE * (n.mal_score - s.u_mean_score), 6) AS pred
        FROM wpool p JOIN numbers n ON p.anime_idx = n.anime_idx JOIN ustats s ON p.user_idx = s.user_idx""",
    "mainl": """
        SELECT *, row_number() OVER (PARTITION BY user_idx ORDER BY score DESC, anime_idx) AS rank FROM (
          SELECT *, (1 - 0.6::DOUBLE) * ((row_number() OVER (PARTITION BY user_idx ORDER BY cos, pool_rank) - 1)::DOUBLE / greatest(count(*) OVER (PARTITION BY user_idx) - 1, 1))
                    + 0.6::DOUBLE * ((row_number() OVER (PARTITION BY user_idx ORDER BY pred, pool_rank) - 1)::DOUBLE / greatest(count(*) OVER (PARTITION BY user_idx) - 1, 1)) AS score
          FROM wpred) QUALIFY row_number() OVER (PARTITION BY user_idx ORDER BY score DESC, anime_idx) <= 20""",
    "coldl": _pool("SELECT * FROM uvec", "seen", 10, """SELECT anime_idx, vec FROM ivec WHERE anime_idx IN (SELECT anime_idx FROM cold)
                   AND anime_idx NOT IN (SELECT anime_idx FROM adult)"""),
    "facts": """
        SELECT anime_idx, mal_id, coalesce(title, '?') AS title, coalesce(type, '?') AS type, start_year AS year, round(score, 2) AS mal_score,
               popularity, members, substr(start_date, 1, 10) AS start_date, genres, themes, studios FROM items""",
    "results": """
        SELECT r.*, f.* EXCLUDE (anime_idx) FROM (
          SELECT user_idx, anime_idx, 'main' AS section, CAST(rank AS INTEGER) AS rank FROM mainl
          UNION ALL SELECT user_idx, anime_idx, 'cold', CAST(pool_rank + 1 AS INTEGER) FROM coldl) r JOIN facts f ON r.anime_idx = f.anime_idx""",
    "coords": "SELECT anime_idx, vec[1] AS x, vec[2] AS y FROM ivec WHERE anime_idx NOT IN (SELECT anime_idx FROM adult)",
}

_KERNEL_R, _SIGMA, GRID_BINS = 6, 1.5, 32


def _smooth_pass(source: str, axis: str, other: str) -> str:
    n = GRID_BINS
    return f"""
        SELECT label, CASE WHEN m >= {n} THEN {2 * n - 1} - m ELSE m END AS {axis}, {other}, sum(d * w) AS d FROM (
          SELECT label, (({axis} + o) % {2 * n} + {2 * n}) % {2 * n} AS m, {other}, d, w FROM {source},
            (SELECT o, exp(-0.5::DOUBLE * (o / {_SIGMA}::DOUBLE) ** 2) / sum(exp(-0.5::DOUBLE * (o / {_SIGMA}::DOUBLE) ** 2)) OVER () AS w
             FROM range(-{_KERNEL_R}, {_KERNEL_R + 1}) t(o))) GROUP BY label, CASE WHEN m >= {n} THEN {2 * n - 1} - m ELSE m END, {other}"""


VIEWS |= {
    "mbase": """
        SELECT x.anime_idx, x.mal_id, i.title, i.type, i.genres, i.themes, i.demographics, i.popularity, x.is_cold,
               coalesce(i.genres[1], 'Unknown') AS primary_genre, i.start_year, v.label
        FROM item_index x JOIN items i ON x.mal_id = i.mal_id JOIN ivec v ON x.anime_idx = v.anime_idx
        WHERE x.anime_idx NOT IN (SELECT anime_idx FROM adult)""",
    "mtags": "SELECT DISTINCT anime_idx, label, tag FROM (SELECT anime_idx, label, unnest(list_concat(genres, themes)) AS tag FROM mbase)",
    "mcounts": """
        SELECT label, tag, count(*) AS c, any_value(g) AS g, any_value(n) AS n, any_value(ni) AS ni FROM (
          SELECT t.*, g.g, s.n, k.ni FROM mtags t JOIN (SELECT tag, count(*) AS g FROM mtags GROUP BY tag) g ON t.tag = g.tag
          JOIN (SELECT label, count(*) AS n FROM mbase GROUP BY label) s ON t.label = s.label
          JOIN (SELECT label, count(*) AS ni FROM mtags GROUP BY label) k ON t.label = k.label) GROUP BY label, tag""",
    "mgenre": """
        SELECT label, primary_genre AS fallback FROM (SELECT label, primary_genre, count(*) AS c FROM mbase GROUP BY label, primary_genre)
        QUALIFY row_number() OVER (PARTITION BY label ORDER BY c DESC, primary_genre) = 1""",
    "mlogodds": """
        SELECT label, tag, round(((ln(c + a) - ln(ni + 100 - c - a)) - (ln(g - c + a) - ln(total - ni + 100 - (g - c) - a)))
                                 / sqrt(1 / (c + a) + 1 / (g - c + a)), 9) AS score FROM (
          SELECT *, g::DOUBLE / total * 100 AS a FROM (SELECT *, (SELECT count(*) FROM mtags)::DOUBLE AS total FROM mcounts))
        WHERE c >= 3 AND c / n >= 0.05""",
    "mlift": "SELECT label, tag, round((c / n) / (g / (SELECT count(*) FROM mbase)), 9) AS score FROM mcounts WHERE c / n >= 0.15",
    "mtfidf": """
        SELECT m.label, m.tag, round(c / n * (ln(((SELECT count(DISTINCT label) FROM mbase) + 1)::DOUBLE / (coalesce(d.df, 0) + 1)) + 1), 9) AS score
        FROM mcounts m LEFT JOIN (SELECT tag, count(*) AS df FROM mcounts WHERE c / n >= 0.10 GROUP BY tag) d ON m.tag = d.tag""",
    "mpopular": "SELECT label, arg_min(title, popularity * 1000000 + mal_id) AS title FROM mbase GROUP BY label",
    "mpoints": """
        SELECT b.anime_idx, b.mal_id, b.title, c.x, c.y, b.label, CAST(b.popularity AS INTEGER) AS popularity, b.is_cold
        FROM mbase b JOIN coords c ON b.anime_idx = c.anime_idx""",
    "manchors": "SELECT label, median(x) AS cx, median(y) AS cy FROM mpoints GROUP BY label",
    "mframe": f"""SELECT min(x) - 0.5 AS x0, min(y) - 0.5 AS y0, (max(x) - min(x) + 1.0::DOUBLE) / {GRID_BINS} AS wx,
        (max(y) - min(y) + 1.0::DOUBLE) / {GRID_BINS} AS wy FROM mpoints""",
    "mcells": f"""
        SELECT label, CAST(least(floor((x - x0) / wx), {GRID_BINS - 1}) AS INTEGER) AS ix, CAST(least(floor((y - y0) / wy), {GRID_BINS - 1}) AS INTEGER) AS iy,
               count(*) AS d FROM mpoints, mframe GROUP BY ALL""",
    "mblur": _smooth_pass("mcells", "ix", "iy"),
    "mdens": f"""SELECT label, CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, round(d, 12) AS d
        FROM ({_smooth_pass('mblur', 'iy', 'ix')}) WHERE round(d, 12) > 0""",
    "mdom": """SELECT ix, iy, round(sum(d), 12) AS total, arg_max(label, {'d': d, 'n': -label}) AS label FROM mdens GROUP BY ix, iy""",
    "mland": """SELECT *, CASE WHEN total > (SELECT quantile_cont(total, 0.40) FROM mdom) THEN label + 1 ELSE 0 END AS field FROM mdom""",
    "mradius": """
        SELECT label, cx, cy, d AS radius FROM (
          SELECT a.label, a.cx, a.cy, sqrt((p.x - a.cx) ** 2 + (p.y - a.cy) ** 2) AS d,
                 row_number() OVER (PARTITION BY a.label ORDER BY sqrt((p.x - a.cx) ** 2 + (p.y - a.cy) ** 2)) - 1 AS rk, count(*) OVER (PARTITION BY a.label) AS n
          FROM mpoints p JOIN manchors a ON p.label = a.label) WHERE rk = least(floor(n * 0.8::DOUBLE), n - 1)""",
}


def top_tags(view: str, k: int) -> str:
    """(label, name) from the k best tags of a scored view."""
    return f"""SELECT label, string_agg(tag, '·' ORDER BY score DESC, tag DESC) AS name FROM (
        SELECT * FROM {view} QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, tag DESC) <= {k}) GROUP BY label"""

_STATUS = "CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'http_403' WHEN 'click' THEN 'empty' ELSE 'ok' END"
_HREF = 'href="/([^"/]+)"'

VIEWS |= {
    "clog": f"SELECT event_id, ts, user_id, {_STATUS} AS status, value FROM events",
    "cusers": """
        SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS username, min(ts) AS discovered_at,
               CASE WHEN user_id % 4 = 0 THEN NULL ELSE arg_max(status, event_id) END AS ratings_status,
               CASE WHEN user_id % 3 = 0 THEN NULL ELSE arg_min(status, event_id) END AS profile_status
        FROM clog GROUP BY user_id""",
    "links": f"SELECT DISTINCT page_id, url_decode(replace(raw, '+', '%2B')) AS name FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS raw FROM pages)",
}
