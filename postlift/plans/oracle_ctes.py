"""DuckDB twins of the fixtures, as common table expressions."""

from __future__ import annotations

_SLOTS = [f"{i:02d}" for i in range(1, 20)]


def _count(x):
    return f"ln(1 + greatest(0, coalesce({x}, 0)))"


def _or(x, default="0"):
    return f"coalesce(nullif(CAST({x} AS DOUBLE), 0), {default})"


def _flag(x):
    return f"CASE WHEN {x} THEN 1.0e0 ELSE 0.0e0 END"


_FEATURES = [
    _count("author_follower_count"), _count("author_following_count"),
    _count("author_total_heart_count"), _count("author_video_count"),
    _count("author_friend_count"),
    _or("duration"), _or("width"), _or("height"), _or("aspect_ratio", "1"), _or("vq_score"),
    _flag("user_verified"), _flag("is_private"), _flag("is_ad"), _flag("share_enabled"),
    _flag("stitch_enabled"),
    "sin(hour_of_day * 2 * pi() / 24)", "cos(hour_of_day * 2 * pi() / 24)",
    "sin(day_of_week * 2 * pi() / 7)", "cos(day_of_week * 2 * pi() / 7)",
]

SPLIT = ("CASE WHEN CAST('0x' || substr(md5(concat(id, '|42')), 1, 8) AS BIGINT) % 10 < 9 "
         "THEN 'train' ELSE 'test' END")

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "li": ((), """
SELECT l_orderkey, max(l_shipdate) AS st, CAST(count(*) AS BIGINT) AS n,
  CAST(max(l_linenumber) AS BIGINT) AS w, CAST(min(l_linenumber) AS BIGINT) AS h,
  max(l_discount) AS vq,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS shares,
  CAST(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS BIGINT) AS saves,
  CAST(sum(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN l_quantity ELSE 0 END)
    AS BIGINT) AS comments,
  CAST(sum(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN l_quantity ELSE 0 END)
    AS BIGINT) AS likes
FROM lineitem GROUP BY l_orderkey"""),
    "posts": (("li",), """
SELECT o_orderkey AS id, o_custkey AS user_id, c_name AS username, o_orderdate AS create_time,
  st AS stats_time, CAST(floor(o_totalprice) AS BIGINT) AS play_count,
  shares AS share_count, saves AS save_count, comments AS comment_count, likes AS digg_count,
  CAST(floor(c_acctbal) AS BIGINT) AS author_follower_count,
  CAST(c_nationkey AS BIGINT) AS author_following_count,
  10 * CAST(floor(c_acctbal) AS BIGINT) AS author_total_heart_count,
  CAST(oc.n_posts AS BIGINT) AS author_video_count,
  CAST(CASE WHEN o_custkey % 10 <> 0 THEN 1 END AS BIGINT) AS author_friend_count,
  li.n AS duration, 100 * w AS width, 100 * h AS height, vq AS vq_score,
  CAST(100 * w AS DOUBLE) / CAST(100 * h AS DOUBLE) AS aspect_ratio,
  c_mktsegment = 'BUILDING' AS user_verified, c_mktsegment = 'MACHINERY' AS is_private,
  o_orderpriority = '1-URGENT' AS is_ad, o_orderstatus <> 'P' AS share_enabled,
  o_orderstatus = 'F' AS stitch_enabled, n_name AS city,
  CASE WHEN o_orderkey % 11 <> 0 THEN r_name END AS poi_name,
  CAST(isodow(o_orderdate) - 1 AS INTEGER) AS day_of_week,
  CAST(hour(o_orderdate) AS INTEGER) AS hour_of_day,
  CAST(floor(epoch(o_orderdate)) AS BIGINT) AS create_s,
  CAST(floor(epoch(st)) AS BIGINT) AS stats_s
FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN (SELECT o_custkey AS k, count(*) AS n_posts FROM orders GROUP BY 1) oc ON k = o_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN li ON l_orderkey = o_orderkey"""),
    "captioned": (("posts",), """
SELECT posts.*, text AS description FROM posts
  LEFT JOIN documents ON doc_id = id % (SELECT count(*) FROM documents)"""),
    "raw_posts": (("posts",), """
SELECT id, user_id, username, city, poi_name, play_count, digg_count, comment_count, share_count,
  save_count, is_ad, share_enabled, stitch_enabled, create_s, stats_s,
  CASE WHEN id % 97 = 0 THEN '' WHEN id % 89 = 0 THEN 'junk'
    WHEN id % 83 = 0 THEN strftime(create_time, '%Y-%m-%d %H:%M:%S')
    ELSE CAST(create_s AS VARCHAR) END AS create_time,
  CAST(stats_s AS VARCHAR) AS stats_time,
  CASE id % 6 WHEN 0 THEN 't' WHEN 1 THEN 'true' WHEN 2 THEN 'True' WHEN 3 THEN 'f'
    WHEN 5 THEN '1' END AS user_verified,
  CASE id % 5 WHEN 0 THEN '["a","b"]' WHEN 1 THEN 'a, b,,c' WHEN 2 THEN ''
    WHEN 4 THEN '{"a":1,"b":2}' END AS challenges,
  CASE WHEN id % 31 = 0 THEN 'x' ELSE CAST(duration AS VARCHAR) END AS duration,
  CAST(vq_score AS VARCHAR) AS vq_score,
  CASE WHEN id % 97 <> 0 AND id % 89 <> 0 AND id % 83 <> 0 THEN create_s END AS epoch_s
FROM posts"""),
    "video_meta": (("posts",), """
SELECT id, CASE WHEN id % 7 <> 0 THEN play_count + 1 END AS view_count,
  digg_count AS like_count, share_count + 2 AS repost_count, width, height,
  CASE WHEN id % 2 <> 0 THEN aspect_ratio END AS aspect_ratio
FROM posts WHERE id % 3 <> 0"""),
    "user_meta": (("posts",), """
SELECT user_id, max(username) AS folder, max(author_follower_count) AS author_follower_count,
  max(author_following_count) AS author_following_count,
  max(author_total_heart_count) AS author_total_heart_count,
  max(author_video_count) AS author_video_count,
  max(author_friend_count) AS author_friend_count,
  bool_or(user_verified) AS is_verified, bool_or(is_private) AS is_private
FROM posts WHERE user_id % 4 <> 0 GROUP BY user_id"""),
    "objects": ((), """
SELECT l_orderkey AS id, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS detected_objects
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity / 50 > 0.85e0
GROUP BY l_orderkey"""),
    "interactions": ((), """
SELECT user_id, CAST(ts AS DATE) AS day,
  CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS play_count,
  CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS digg_count,
  CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS save_count,
  CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS BIGINT) AS comment_count,
  CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS share_count,
  min(ts) AS create_time, max(ts) AS stats_time
FROM events GROUP BY 1, 2"""),
    "panel0": ((), """
SELECT o_custkey AS entity, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS month,
  count(*) AS n_orders, max(o_totalprice) AS max_price
FROM orders GROUP BY 1, 2"""),
    "panel": (("panel0",), """
SELECT panel0.*, CASE WHEN max_price >= t THEN 1 ELSE 0 END AS label FROM panel0
  JOIN (SELECT month AS m, round(quantile_cont(max_price, 0.95), 9) AS t FROM panel0 GROUP BY 1)
  ON m = month"""),
    "scored0": (("posts",), """
SELECT *, CAST(4 * share_count + 3 * save_count + 2 * comment_count + digg_count AS DOUBLE)
    / (play_count + 1) AS e,
  ln(1 + play_count / (greatest(1, stats_s - create_s) / 3600.0e0)) AS v
FROM posts WHERE stats_time IS NOT NULL"""),
    "mx": (("scored0",), "SELECT max(e) AS me, max(v) AS mv FROM scored0"),
    "comb": (("scored0", "mx"),
             "SELECT scored0.*, round(e / me + v / mv, 9) AS s FROM scored0, mx"),
    "thr": (("comb",), "SELECT round(quantile_cont(s, 0.95), 9) AS t FROM comb"),
    "labelled": (("comb", "thr"), """
SELECT comb.*, CAST(CASE WHEN s >= t THEN 1 ELSE 0 END AS BIGINT) AS is_tail FROM comb, thr"""),
    "feat": (("labelled",), "SELECT id, create_time, create_s, e, v, is_tail, "
             + SPLIT + " AS split, "
             + ", ".join(f"{x} AS f{i}" for i, x in zip(_SLOTS, _FEATURES)) + " FROM labelled"),
    "fstats": (("feat",), "SELECT " + ", ".join(
        f"avg(f{i}) AS m{i}, stddev_pop(f{i}) AS s{i}" for i in _SLOTS)
        + " FROM feat WHERE split = 'train'"),
    "zed": (("feat", "fstats"), "SELECT feat.*, " + ", ".join(
        f"round((f{i} - m{i}) / (s{i} + 1e-6), 6) AS z{i}" for i in _SLOTS)
        + " FROM feat, fstats"),
    "logits": (("zed",), "SELECT zed.*, round("
               + " + ".join(f"z{i} * sin({int(i)})" for i in _SLOTS) + ", 6) AS logit FROM zed"),
    "scored": (("logits",), "SELECT logits.*, round(1 / (1 + exp(-logit)), 6) AS prob FROM logits"),
    "ranked": (("scored",), """
SELECT scored.*, row_number() OVER (ORDER BY create_time, id) - 1 AS rk,
  count(*) OVER () AS total FROM scored"""),
    "folds": (("ranked",), """
SELECT ranked.*, fold, CASE WHEN rk < floor(total * f) THEN 'train' ELSE 'val' END AS part
FROM ranked, (VALUES (1, 0.6e0), (2, 0.7e0), (3, 0.8e0), (4, 0.9e0)) t(fold, f)
WHERE rk < least(total, floor(total * f) + floor(total * 0.1e0))"""),
}


def sql(body: str, *needs: str) -> str:
    """``body`` with the named expressions and all they build on in front."""
    order: list[str] = []

    def visit(name):
        for dependency in CTES[name][0]:
            visit(dependency)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return body
    listed = ",\n".join(f"{name} AS MATERIALIZED ({CTES[name][1]})" for name in order)
    return f"WITH {listed}\n{body}"
