"""The provided tables seen as posts, sidecars, detections, panels and scored rows.

Each builder has a DuckDB twin of the same name in ``oracle_ctes``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import clean, features, scores
from ..operators import labels, scoring, splits
from ..session import materialize

ZSLOTS = [f"z{slot[1:]}" for slot in features.FEATURE_SLOTS]
WEIGHTS = [math.sin(j) for j in range(1, len(ZSLOTS) + 1)]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def item_totals(spark, sf) -> DataFrame:
    def quantity(condition):
        return F.sum(F.when(condition, F.col("l_quantity")).otherwise(0)).cast("bigint")

    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_shipdate").alias("st"),
        F.count("*").alias("n"),
        F.max("l_linenumber").cast("bigint").alias("w"),
        F.min("l_linenumber").cast("bigint").alias("h"),
        F.max("l_discount").alias("vq"),
        quantity(flag == "R").alias("shares"),
        quantity(flag == "A").alias("saves"),
        quantity((flag == "N") & (status == "F")).alias("comments"),
        quantity((flag == "N") & (status == "O")).alias("likes"))


def posts(spark, sf) -> DataFrame:
    orders = table(spark, sf, "orders")
    per_user = orders.groupBy("o_custkey").agg(F.count("*").alias("n_posts"))
    places = (table(spark, sf, "nation")
              .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")))
    users = (table(spark, sf, "customer")
             .join(per_user, F.col("c_custkey") == F.col("o_custkey"))
             .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
             .drop("o_custkey"))
    joined = (orders.join(users, F.col("o_custkey") == F.col("c_custkey"))
              .join(item_totals(spark, sf), F.col("o_orderkey") == F.col("l_orderkey"), "left"))
    followers = F.floor("c_acctbal").cast("bigint")
    return joined.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
        F.col("c_name").alias("username"), F.col("o_orderdate").alias("create_time"),
        F.col("st").alias("stats_time"),
        F.floor("o_totalprice").cast("bigint").alias("play_count"),
        F.col("shares").alias("share_count"), F.col("saves").alias("save_count"),
        F.col("comments").alias("comment_count"), F.col("likes").alias("digg_count"),
        followers.alias("author_follower_count"),
        F.col("c_nationkey").cast("bigint").alias("author_following_count"),
        (followers * 10).alias("author_total_heart_count"),
        F.col("n_posts").alias("author_video_count"),
        F.when(F.col("o_custkey") % 10 != 0, 1).cast("bigint").alias("author_friend_count"),
        F.col("n").alias("duration"), (F.col("w") * 100).alias("width"),
        (F.col("h") * 100).alias("height"), F.col("vq").alias("vq_score"),
        F.try_divide(F.col("w") * 100, F.col("h") * 100).alias("aspect_ratio"),
        (F.col("c_mktsegment") == "BUILDING").alias("user_verified"),
        (F.col("c_mktsegment") == "MACHINERY").alias("is_private"),
        (F.col("o_orderpriority") == "1-URGENT").alias("is_ad"),
        (F.col("o_orderstatus") != "P").alias("share_enabled"),
        (F.col("o_orderstatus") == "F").alias("stitch_enabled"),
        F.col("n_name").alias("city"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("r_name")).alias("poi_name"),
        clean.weekday(F.col("o_orderdate")).alias("day_of_week"),
        F.hour("o_orderdate").alias("hour_of_day"))


def count_of(spark, sf, name):
    return table(spark, sf, name).agg(F.count("*")).scalar()


def with_captions(spark, sf, df: DataFrame) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("description"))
    keyed = df.withColumn("doc_id", F.col("id") % count_of(spark, sf, "documents"))
    return keyed.join(docs, "doc_id", "left").drop("doc_id")


def with_music(spark, sf, df: DataFrame) -> DataFrame:
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("_part"), F.col("p_name").alias("music_title"),
        F.col("p_brand").alias("music_author_name"))
    keyed = df.withColumn("_part", F.col("id") % count_of(spark, sf, "part"))
    return keyed.join(part, "_part", "left").drop("_part")


def challenges():
    case = F.col("id") % 5
    return (F.when(case == 0, '["a","b"]').when(case == 1, "a, b,,c").when(case == 2, "")
            .when(case == 4, '{"a":1,"b":2}'))


def raw_posts(spark, sf, stored: DataFrame | None = None, create_time: Column | None = None) -> DataFrame:
    """Posts as they arrive: text everywhere, with unreadable values mixed in.

    ``create_time`` takes the place of the creation times' text.
    """
    p = posts(spark, sf) if stored is None else stored
    i, created = F.col("id"), clean.epoch_seconds(F.col("create_time"))
    verified = i % 6
    return p.select(
        "id", "user_id", "username", "city", "poi_name", "play_count", "digg_count",
        "comment_count", "share_count", "save_count", "is_ad", "share_enabled", "stitch_enabled",
        (F.when(i % 97 == 0, "").when(i % 89 == 0, "junk")
         .when(i % 83 == 0, F.date_format("create_time", "yyyy-MM-dd HH:mm:ss"))
         .otherwise(created.cast("string")) if create_time is None else create_time).alias("create_time"),
        clean.epoch_seconds(F.col("stats_time")).cast("string").alias("stats_time"),
        F.when(verified == 0, "t").when(verified == 1, "true").when(verified == 2, "True")
        .when(verified == 3, "f").when(verified == 5, "1").alias("user_verified"),
        challenges().alias("challenges"),
        F.when(i % 31 == 0, "x").otherwise(F.col("duration").cast("string")).alias("duration"),
        F.col("vq_score").cast("string").alias("vq_score"))


def video_meta(stored: DataFrame) -> DataFrame:
    p = stored.where("id % 3 <> 0")
    return p.select(
        "id", F.when(F.col("id") % 7 != 0, F.col("play_count") + 1).alias("view_count"),
        F.col("digg_count").alias("like_count"),
        (F.col("share_count") + 2).alias("repost_count"), "width", "height",
        F.when(F.col("id") % 2 != 0, F.col("aspect_ratio")).alias("aspect_ratio"))


def user_meta(stored: DataFrame) -> DataFrame:
    p = stored.where("user_id % 4 <> 0")
    return (p.groupBy("user_id").agg(
        F.max("username").alias("folder"),
        *[F.max(c).alias(c) for c in (
            "author_follower_count", "author_following_count", "author_total_heart_count",
            "author_video_count", "author_friend_count")],
        F.max("user_verified").alias("is_verified"), F.max("is_private").alias("is_private")))


def manifest(spark, sf) -> DataFrame:
    """Paths of the asset folders, one folder per creator."""
    o = table(spark, sf, "orders").join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
        F.col("c_name").alias("username"))
    folder = F.concat_ws("/", F.lit("assets"), "username")
    stem = F.concat_ws("/", folder, F.col("id").cast("string"))
    # A creator's own file is listed once per post; the gate only asks whether it is there.
    paths = F.array(
        F.when(F.col("id") % 5 != 0, F.concat(stem, F.lit(".mp4"))),
        F.when(F.col("id") % 3 != 0, F.concat(stem, F.lit(".json"))),
        F.when(F.col("user_id") % 4 != 0, F.concat(folder, F.lit("/user.json"))))
    return o.select(F.explode(paths).alias("path")).where("path is not null")


def detections(spark, sf) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_type")
    return (table(spark, sf, "lineitem")
            .join(part, F.col("l_partkey") == F.col("p_partkey"))
            .select(F.col("l_orderkey").alias("id"), F.col("p_type").alias("label"),
                    (F.col("l_quantity") / 50).alias("score")))


def interactions(spark, sf) -> DataFrame:
    def n(kind):
        return F.sum(F.when(F.col("event_type") == kind, 1).otherwise(0))

    return (table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(
        n("view").alias("play_count"), n("click").alias("digg_count"),
        n("purchase").alias("save_count"), n("signup").alias("comment_count"),
        n("error").alias("share_count"),
        F.min("ts").alias("create_time"), F.max("ts").alias("stats_time")))


def panel(spark, sf) -> DataFrame:
    """(entity, month, n_orders, max_price, label), unique per entity and month."""
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("entity"),
        clean.month_index(F.col("o_orderdate")).alias("month"), "o_totalprice")
    rows = materialize(o.groupBy("entity", "month").agg(
        F.count("*").alias("n_orders"), F.max("o_totalprice").alias("max_price")), "months")
    return labels.label_cohorts(rows, "max_price", "month", "label")


def scored_posts(spark, sf) -> DataFrame:
    """Posts with both clocks and their two scores."""
    p = posts(spark, sf).where("stats_time is not null")
    c = F.col
    return p.withColumns({
        "engagement_score": scores.engagement(
            c("share_count"), c("save_count"), c("comment_count"), c("digg_count"),
            c("play_count")),
        "view_velocity_score": scores.view_velocity(
            c("play_count"), clean.epoch_seconds(c("create_time")),
            clean.epoch_seconds(c("stats_time")))})


def stored_scores(spark, sf, *extra: str) -> DataFrame:
    """Scores only, written once: the labelling passes must not repeat the joins."""
    return materialize(scored_posts(spark, sf).select(
        "id", *extra, "engagement_score", "view_velocity_score"), "scores")


def stored_features(spark, sf) -> DataFrame:
    """Identity, scores, label, split and the 19 features, written once."""
    slim = features.with_features(
        scored_posts(spark, sf), "id", "create_time", "engagement_score", "view_velocity_score")
    stored = materialize(splits.random_split(slim), "features")
    return labels.label_tail(stored, labels.tail_stats(stored))


def standardized(spark, sf) -> DataFrame:
    """Features as z-scores (6 decimals) by the training rows' statistics."""
    stored = stored_features(spark, sf)
    stats = scoring.feature_stats(stored.where("split = 'train'")).first().asDict()
    z = scoring.zscore(stored, stats)
    return z.withColumns({c: F.round(c, 6) for c in ZSLOTS})


def scored(spark, sf) -> DataFrame:
    """A fixed linear scorer over the z-scores: logit, prob and the true label."""
    z = standardized(spark, sf)
    logit = F.round(scoring.dot(ZSLOTS, WEIGHTS), 6)
    return (z.withColumn("logit", logit)
            .withColumn("prob", F.round(scores.logistic(F.col("logit")), 6)))


def panel_spec(spark, sf):
    """The temporal grid's combination over the panel's own first and last month."""
    from ..sources.grid import temporal_specs
    ends = table(spark, sf, "orders").select(
        clean.month_index(F.col("o_orderdate")).alias("m")).agg(F.min("m"), F.max("m")).first()
    return temporal_specs([ends[0]], [ends[1]])[0]

