"""Labels, bins, splits, panels and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean
from ..operators import bins, explain, labels, quantiles, ranking, reshape, splits, temporal
from ..session import materialize
from . import fixtures as fx
from .oracle_ctes import sql
from .registry import query


@query("q_global_label", sql("""
SELECT id, round(e, 6) AS engagement_score, round(v, 6) AS view_velocity_score,
  s AS combined_score, is_tail FROM labelled""", "labelled"))
def global_label(spark, sf):
    stored = fx.stored_scores(spark, sf)
    stats = labels.tail_stats(stored)
    e, v = F.col("engagement_score"), F.col("view_velocity_score")
    return labels.label_tail(stored, stats).select(
        "id", F.round(e, 6).alias("engagement_score"), F.round(v, 6).alias("view_velocity_score"),
        labels.combined_score(e, v, stats.max_engagement, stats.max_velocity)
        .alias("combined_score"), "is_tail")


@query("q_global_threshold", sql("""
SELECT max(n) AS n, round(max(me), 6) AS max_engagement, round(max(mv), 6) AS max_velocity,
  max(t) AS threshold FROM (SELECT count(*) AS n FROM scored0), mx, thr""",
                                 "scored0", "mx", "thr"))
def global_threshold(spark, sf):
    stored = fx.stored_scores(spark, sf)
    stats = labels.tail_stats(stored)
    return stored.agg(
        F.count("*").alias("n"), F.lit(round(stats.max_engagement, 6)).alias("max_engagement"),
        F.lit(round(stats.max_velocity, 6)).alias("max_velocity"),
        F.lit(stats.threshold).alias("threshold"))


@query("q_cohort_threshold", """
SELECT strftime(o_orderdate, '%Y-%m') AS cohort_month, count(*) AS n,
  round(quantile_cont(o_totalprice, 0.95), 6) AS threshold FROM orders GROUP BY 1""")
def cohort_threshold(spark, sf):
    orders = fx.table(spark, sf, "orders").select(
        clean.cohort_month(F.col("o_orderdate")).alias("cohort_month"), "o_totalprice")
    return labels.cohort_thresholds(orders, "o_totalprice").withColumn(
        "threshold", F.round("threshold", 6))


@query("q_label_rate", sql("""
SELECT is_tail AS label, count(*) AS n,
  round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share
FROM labelled GROUP BY 1""", "labelled"))
def label_rate(spark, sf):
    stored = fx.stored_scores(spark, sf)
    rows = labels.label_tail(stored, labels.tail_stats(stored), label="label")
    total = rows.agg(F.count("*")).scalar()
    return labels.label_rate(rows, "label").withColumn("share", F.round(F.col("n") / total, 6))


@query("q_box_summary", """
WITH q AS (SELECT event_type, count(*) AS n, quantile_cont(value, 0.25) AS q1,
  quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
r AS (SELECT event_type, min(CASE WHEN value >= q1 - 1.5e0 * (q3 - q1) THEN value END) AS lo,
  max(CASE WHEN value <= q3 + 1.5e0 * (q3 - q1) THEN value END) AS hi
  FROM events JOIN q USING (event_type) GROUP BY 1)
SELECT event_type, n, round(q1, 6) AS q1, round(q2, 6) AS median, round(q3, 6) AS q3,
  round(least(lo, q1), 6) AS whisker_low, round(greatest(hi, q3), 6) AS whisker_high
FROM q JOIN r USING (event_type)""")
def box_summary(spark, sf):
    events = fx.table(spark, sf, "events").select("event_type", "value")
    return _rounded(quantiles.box_summary(events, "value", ("event_type",)))


_BOX = ("q1", "median", "q3", "whisker_low", "whisker_high")


def _rounded(boxes, columns=_BOX):
    return boxes.withColumns({c: F.round(c, 6) for c in columns})


def _report_sql(base, binned, measures, label, edges=None, joiner="–", unit="h"):
    """DuckDB text of a binned report over the rows of ``base``."""
    fixed = edges or (f"(SELECT list_sort(list_distinct(list_transform(quantile_cont({binned}, "
                      "[0, 0.2, 0.4, 0.6, 0.8, 1.0]), lambda x: round(x, 9)))) FROM base)")
    long = " UNION ALL ".join(
        f"SELECT bin, '{name}' AS measure, CAST({expr} AS DOUBLE) AS x FROM binned"
        for name, expr in measures)
    return sql("@", "posts").replace("\n@", f""",
base AS MATERIALIZED ({base}),
ends AS (SELECT {fixed} AS e),
binned AS MATERIALIZED (SELECT base.*, len(list_filter(e[2:len(e) - 1],
    lambda x: round({binned}, 9) > x)) AS bin FROM base, ends),
long AS ({long}),
q AS (SELECT bin, measure, count(*) AS n, quantile_cont(x, 0.25) AS q1,
  quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3 FROM long GROUP BY 1, 2),
r AS (SELECT bin, measure, min(CASE WHEN x >= q1 - 1.5e0 * (q3 - q1) THEN x END) AS lo,
  max(CASE WHEN x <= q3 + 1.5e0 * (q3 - q1) THEN x END) AS hi
  FROM long JOIN q USING (bin, measure) GROUP BY 1, 2)
SELECT CAST(bin AS INTEGER) AS bin, measure, n, round(q1, 6) AS q1, round(q2, 6) AS median,
  round(q3, 6) AS q3, round(least(lo, q1), 6) AS whisker_low,
  round(greatest(hi, q3), 6) AS whisker_high,
  {label.format(x='e[bin + 1]')} || '{joiner}' || {label.format(x='e[bin + 2]')} || '{unit}'
    AS label
FROM q JOIN r USING (bin, measure), ends""")


_SHORT = ("CASE WHEN trunc({x}) >= 1000000 THEN printf('%.1fM', trunc({x}) / 1e6) "
          "WHEN trunc({x}) >= 1000 THEN CAST(CAST(round_even(trunc({x}) / 1e3, 0) AS BIGINT) "
          "AS VARCHAR) || 'K' ELSE CAST(CAST(trunc({x}) AS BIGINT) AS VARCHAR) END")
_WHOLE = "CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"
_AGED = ("SELECT play_count, (stats_s - create_s) / 3600.0e0 AS hours FROM posts "
         "WHERE play_count > 0 AND stats_s IS NOT NULL")
_FOLLOWED = ("SELECT play_count, CAST(author_follower_count AS DOUBLE) AS followers FROM posts "
             "WHERE play_count > 0 AND author_follower_count > 0")
_PLAYS = [("play_count", "play_count"), ("log_play_count", "log10(play_count)")]


@query("q_report_account_size", _report_sql(_FOLLOWED, "followers", _PLAYS, _SHORT, unit=""))
def report_account_size(spark, sf):
    rows = materialize(fx.posts(spark, sf).select("play_count", "author_follower_count"), "sizes")
    return _rounded(bins.account_size_report(rows))


def _clocks(spark, sf):
    return materialize(fx.posts(spark, sf).select("play_count", "create_time", "stats_time"),
                       "clocks")


@query("q_report_age", _report_sql(f"SELECT * FROM ({_AGED}) WHERE hours > 0", "hours", _PLAYS,
                                   _WHOLE))
def report_age(spark, sf):
    return _rounded(bins.age_report(_clocks(spark, sf)))


@query("q_report_velocity", _report_sql(
    f"SELECT * FROM ({_AGED}) WHERE hours > 0", "hours",
    [("view_velocity_raw", "play_count / hours"),
     ("view_velocity_log", "ln(1 + play_count / hours)")], _WHOLE, joiner=" - "))
def report_velocity(spark, sf):
    return _rounded(bins.velocity_report(_clocks(spark, sf)))


_RECENT = "[12.0e0, 48.0e0, 128.0e0, 256.0e0, 512.0e0, 1024.0e0]"


@query("q_report_recent", _report_sql(
    f"SELECT * FROM ({_AGED}) WHERE hours BETWEEN 12 AND 1024", "hours",
    [("view_velocity", "ln(1 + play_count / hours)")], _WHOLE, _RECENT, " - "))
def report_recent(spark, sf):
    return _rounded(bins.recent_report(_clocks(spark, sf)))


def _bin_sql(base, value, label, edges=None, joiner="–", unit="h"):
    fixed = edges or (f"(SELECT list_sort(list_distinct(list_transform(quantile_cont({value}, "
                      "[0, 0.2, 0.4, 0.6, 0.8, 1.0]), lambda x: round(x, 9)))) FROM base)")
    return sql("@", "posts").replace("\n@", f""",
base AS MATERIALIZED ({base}),
ends AS (SELECT {fixed} AS e)
SELECT id, CAST(bin AS INTEGER) AS bin, {label.format(x='e[bin + 1]')} || '{joiner}'
  || {label.format(x='e[bin + 2]')} || '{unit}' AS label
FROM (SELECT id, e, len(list_filter(e[2:len(e) - 1],
  lambda x: round({value}, 9) > x)) AS bin FROM base, ends)""")


@query("q_bin_followers", _bin_sql(
    _FOLLOWED.replace("SELECT ", "SELECT id, "), "followers", _SHORT, unit=""))
def bin_followers(spark, sf):
    from ..functions.text import short_count
    rows = materialize(fx.posts(spark, sf).select("id", "play_count", "author_follower_count")
                       .where("play_count > 0 and author_follower_count > 0"), "sizes")
    binned = bins.quantile_cut(rows, "author_follower_count")
    return binned.select("id", "bin", bins.interval_label(
        short_count(F.col("lo")), short_count(F.col("hi"))).alias("label"))


def _aged_ids(spark, sf):
    rows = bins.with_age_hours(fx.posts(spark, sf).select(
        "id", "play_count", "create_time", "stats_time"))
    return materialize(rows.where("play_count > 0 and delta_hours > 0").select(
        "id", "delta_hours"), "ages")


@query("q_bin_age", _bin_sql(
    f"SELECT * FROM ({_AGED.replace('SELECT ', 'SELECT id, ')}) WHERE hours > 0", "hours", _WHOLE))
def bin_age(spark, sf):
    binned = bins.quantile_cut(_aged_ids(spark, sf), "delta_hours")
    return binned.select("id", "bin", bins.interval_label(
        bins.whole_hours(F.col("lo")), bins.whole_hours(F.col("hi")), unit="h").alias("label"))


@query("q_bin_recent", _bin_sql(
    f"SELECT * FROM ({_AGED.replace('SELECT ', 'SELECT id, ')}) WHERE hours BETWEEN 12 AND 1024",
    "hours", _WHOLE, _RECENT, " - "))
def bin_recent(spark, sf):
    binned = bins.cut(_aged_ids(spark, sf), "delta_hours", bins.SETTINGS.recent_edges_hours)
    return binned.select("id", "bin", bins.interval_label(
        bins.whole_hours(F.col("lo")), bins.whole_hours(F.col("hi")), " - ", "h").alias("label"))


@query("q_time_folds", sql("SELECT id, fold, part FROM folds", "folds"))
def time_folds(spark, sf):
    rows = fx.scored_posts(spark, sf).select("id", "create_time")
    return splits.time_folds(rows).select("id", "fold", "part")


@query("q_fold_threshold", sql("""
SELECT fold, round(me, 6) AS max_engagement, round(mv, 6) AS max_velocity, t AS threshold,
  count(*) AS n_val, CAST(sum(CASE WHEN round(e / me + v / mv, 9) >= t THEN 1 ELSE 0 END)
    AS BIGINT) AS n_val_tail
FROM folds JOIN (
  SELECT fold AS fo, any_value(me) AS me, any_value(mv) AS mv,
    round(quantile_cont(round(e / me + v / mv, 9), 0.95), 9) AS t
  FROM folds JOIN (SELECT fold AS ff, max(e) AS me, max(v) AS mv FROM folds WHERE part = 'train'
    GROUP BY 1) ON ff = fold WHERE part = 'train' GROUP BY 1) ON fo = fold
WHERE part = 'val' GROUP BY 1, 2, 3, 4""", "folds"))
def fold_threshold(spark, sf):
    rows = fx.stored_scores(spark, sf, "create_time")
    folds = materialize(splits.time_folds(rows), "folds")
    stats = labels.fold_tail_stats(folds)
    judged = labels.label_by_fold(folds.where("part = 'val'"), stats)
    return judged.groupBy("fold").agg(
        F.round(F.max("max_engagement"), 6).alias("max_engagement"),
        F.round(F.max("max_velocity"), 6).alias("max_velocity"),
        F.max("threshold").alias("threshold"),
        F.count("*").alias("n_val"), F.sum("is_tail").alias("n_val_tail"))


@query("q_random_split", """
SELECT o_orderkey AS id, CASE WHEN CAST('0x' || substr(md5(concat(o_orderkey, '|42')), 1, 8)
  AS BIGINT) % 10 < 9 THEN 'train' ELSE 'test' END AS split FROM orders""")
def random_split(spark, sf):
    ids = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return splits.random_split(ids)


_SEEDED = "ORDER BY md5(concat(o_orderkey, '|42')), o_orderkey"


@query("q_stat_sample", f"""
SELECT o_orderkey AS id, o_totalprice AS price FROM orders {_SEEDED} LIMIT 1000""")
def stat_sample(spark, sf):
    rows = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return splits.sample_rows(rows, 1000)


@query("q_random_row", f"""
SELECT o_orderkey AS id, o_totalprice AS price FROM orders {_SEEDED} LIMIT 1""")
def random_row(spark, sf):
    rows = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return splits.random_row(rows)


@query("q_latest_version", """
SELECT o_custkey AS user_id, max(o_orderkey) AS step,
  strftime(max_by(o_orderdate, o_orderkey), '%Y-%m-%d') AS day,
  'checkpoint-' || max(o_orderkey) AS name FROM orders GROUP BY 1""")
def latest_version(spark, sf):
    named = fx.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("user_id"),
        F.concat(F.lit("checkpoint-"), F.col("o_orderkey").cast("string")).alias("name"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return ranking.latest_by_suffix(named, "user_id", "name")


@query("q_panel_sorted", sql("""
SELECT entity, month, n_orders, max_price, label,
  row_number() OVER (ORDER BY month, entity) - 1 AS position FROM panel""", "panel"))
def panel_sorted(spark, sf):
    rows = fx.panel(spark, sf)
    return ranking.global_rank(rows, ["month", "entity"], "position").orderBy("month", "entity")


@query("q_label_dates", sql("""
SELECT month, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_positive
FROM panel GROUP BY 1""", "panel"))
def label_dates(spark, sf):
    return fx.panel(spark, sf).groupBy("month").agg(
        F.count("*").alias("n_rows"), F.sum("label").alias("n_positive")).orderBy("month")


@query("q_lag_range_join", sql("""
SELECT r.entity, l.month AS label_month, r.month AS feature_month, l.month - r.month AS lag,
  r.n_orders, r.max_price, l.label
FROM panel r JOIN panel l ON r.entity = l.entity AND l.month - r.month BETWEEN 3 AND 14""",
                               "panel"))
def lag_range_join(spark, sf):
    # Both sides read the panel, so it is derived once.
    return temporal.lag_pairs(materialize(fx.panel(spark, sf), "panel"), "entity", "month", ["n_orders", "max_price"],
                              "label", 3, 12)


_LAGS = range(3, 15)
_MATRIX_SQL = sql("""
SELECT l.entity, l.month AS label_month, l.label AS y, """ + ", ".join(
    f"CAST(coalesce(max(CASE WHEN l.month - r.month = {k} THEN r.{f} END), 0) AS DOUBLE) "
    f"AS {f}_lag{k}" for f in ("n_orders", "max_price") for k in _LAGS) + """
FROM panel l JOIN panel r ON r.entity = l.entity AND l.month - r.month BETWEEN 3 AND 14
GROUP BY 1, 2, 3""", "panel")


@query("q_supervised_matrix", _MATRIX_SQL)
def supervised_matrix(spark, sf):
    return temporal.supervised_matrix(fx.panel(spark, sf), "entity", "month", "label",
                                      ["n_orders", "max_price"], 3, 12)


@query("q_align_columns", sql("""
SELECT l.entity, l.month AS label_month, l.label AS y,
  CAST(coalesce(max(CASE WHEN l.month - r.month = 4 THEN r.n_orders END), 0) AS DOUBLE)
    AS n_orders_lag4, 0.0e0 AS n_orders_lag9,
  CAST(coalesce(max(CASE WHEN l.month - r.month = 3 THEN r.n_orders END), 0) AS DOUBLE)
    AS n_orders_lag3
FROM panel l JOIN panel r ON r.entity = l.entity AND l.month - r.month BETWEEN 3 AND 5
GROUP BY 1, 2, 3""", "panel"))
def align_columns(spark, sf):
    matrix = temporal.supervised_matrix(fx.panel(spark, sf), "entity", "month", "label",
                                        ["n_orders"], 3, 3)
    return temporal.align_columns(matrix, ["n_orders_lag4", "n_orders_lag9", "n_orders_lag3"],
                                  ["entity", "label_month", "y"])


_ENDS = """
ends AS (SELECT min(month) AS first, max(month) AS last FROM panel0),
months AS (SELECT DISTINCT month FROM panel0),
cuts AS (SELECT CAST(unnest(generate_series(last, first + 12 + 6 + 6 - 2, -6)) AS INTEGER)
  AS val_end, first FROM ends)"""


@query("q_timecuts", sql("@", "panel0").replace("\n@", f",{_ENDS}" """
SELECT val_end, min(month) AS val_start FROM cuts JOIN months ON month > val_end - 6
GROUP BY 1"""))
def timecuts(spark, sf):
    spec = fx.panel_spec(spark, sf)
    cuts = temporal.timecuts(spec)
    months = temporal.distinct_months(
        fx.table(spark, sf, "orders").select(
            clean.month_index(F.col("o_orderdate")).alias("month")), "month")
    ends = F.explode(F.array(*[F.lit(c) for c in cuts]))
    later = months.withColumn("val_end", ends).where(
        F.col("month") > F.col("val_end") - spec.update_freq)
    return later.groupBy("val_end").agg(F.min("month").alias("val_start"))


@query("q_timecut_windows", sql("@", "panel0").replace("\n@", f",{_ENDS}," """
w AS (SELECT val_end, first, min(month) AS val_start FROM cuts JOIN months ON month > val_end - 6
  GROUP BY 1, 2),
t AS (SELECT val_end, val_start, val_start - 3 AS train_end,
  greatest(val_start - 3 - 60 + 1, first + 12 + 3 - 1) AS train_start FROM w)
SELECT val_end, val_start, train_end, train_start,
  (SELECT count(*) FROM months WHERE month BETWEEN train_start AND train_end) AS n_train,
  (SELECT count(*) FROM months WHERE month BETWEEN val_start AND val_end) AS n_val
FROM t WHERE val_end IN (SELECT month FROM months)
  AND (SELECT count(*) FROM months WHERE month BETWEEN train_start AND train_end) > 0
  AND (SELECT count(*) FROM months WHERE month BETWEEN val_start AND val_end) > 0"""))
def timecut_windows(spark, sf):
    months = fx.table(spark, sf, "orders").select(
        clean.month_index(F.col("o_orderdate")).alias("month"))
    return temporal.timecut_windows(months, "month", fx.panel_spec(spark, sf))


@query("q_fallback_mean", sql("@", "panel").replace("\n@", f",{_ENDS}," """
w AS (SELECT val_end, first, min(month) AS val_start FROM cuts JOIN months ON month > val_end - 6
  GROUP BY 1, 2),
t AS (SELECT val_end AS timecut, val_start, val_start - 3 AS train_end,
  greatest(val_start - 3 - 60 + 1, first + 12 + 3 - 1) AS train_start FROM w),
m AS (SELECT timecut AS tc, round(avg(label), 6) AS p FROM t JOIN panel
  ON month BETWEEN train_start AND train_end GROUP BY 1)
SELECT entity, month AS label_month, label AS y, timecut, p
FROM t JOIN m ON tc = timecut JOIN panel ON month BETWEEN val_start AND timecut"""))
def fallback_mean(spark, sf):
    rows = fx.panel(spark, sf).select("entity", F.col("month").alias("label_month"),
                                      F.col("label").alias("y"))
    months = fx.table(spark, sf, "orders").select(
        clean.month_index(F.col("o_orderdate")).alias("month"))
    cuts = temporal.timecut_windows(months, "month", fx.panel_spec(spark, sf)).collect()
    scored = temporal.mean_fallback(temporal.tag_cuts(rows, cuts))
    return scored.select("entity", "label_month", "y", "timecut", F.round("p", 6).alias("p"))


@query("q_union_shards", """
SELECT o_orderkey AS id, o_orderstatus AS shard, o_totalprice AS price FROM orders""")
def union_shards(spark, sf):
    orders = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("shard"),
        F.col("o_totalprice").alias("price"))
    return reshape.union_shards([orders.where(F.col("id") % 3 == i) for i in range(3)])


@query("q_union_by_name", """
SELECT l_partkey AS part, l_returnflag AS flag, CASE WHEN l_returnflag = 'R'
  THEN sum(l_quantity) ELSE 0 END AS returned, CASE WHEN l_returnflag = 'A'
  THEN sum(l_quantity) ELSE 0 END AS accepted FROM lineitem
WHERE l_returnflag IN ('R', 'A') GROUP BY 1, 2""")
def union_by_name(spark, sf):
    items = fx.table(spark, sf, "lineitem")

    def side(flag, name):
        return (items.where(F.col("l_returnflag") == flag)
                .groupBy(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"))
                .agg(F.sum("l_quantity").alias(name)))

    return temporal.append_by_name(side("R", "returned"), side("A", "accepted"),
                                   ["returned", "accepted"])


@query("q_weight_norm", """
SELECT CAST(i AS INTEGER) AS feature, round(sqrt(sum(w * w)), 6) AS norm FROM (
  SELECT generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS w
  FROM embeddings) GROUP BY 1""")
def weight_norm(spark, sf):
    long = fx.table(spark, sf, "embeddings").select(
        F.posexplode("embedding").alias("feature", "weight"))
    return explain.weight_norms(long, "feature", "weight").withColumn("norm", F.round("norm", 6))
