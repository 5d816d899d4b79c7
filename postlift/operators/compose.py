"""Curated table: asset gate, joins, fallbacks, typing and the required gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import CONTRACT, REQUIRED, SETTINGS
from ..functions import clean, scores
from ..session import materialize

#: Bytes of media, and what a row takes besides, up to which a table of them goes to all tasks; posts up to
#: which their ids do.
FEW_BYTES, ROW_BYTES, FEW_POSTS = 64 << 20, 64, 1 << 20


def asset_gate(manifest: DataFrame, path: str = "path") -> DataFrame:
    """(id, folder) of posts whose media, own JSON and creator JSON all exist.

    ``manifest`` is a table of paths (from an inventory, or ``list_assets`` for small
    inputs); its projection is stored, since posts and creators are read apart.  A post's two files meet in one aggregate keyed by folder and id, which spreads
    a busy creator's files over all tasks; only the check for the creator's file
    goes by folder alone, and is left to the skew-join split.
    """
    name = F.substring_index(path, "/", -1)
    stem = F.substring_index(name, ".", 1)
    files = materialize(manifest.select(
        F.substring_index(F.substring_index(path, "/", -2), "/", 1).alias("folder"),
        name.alias("name"),
        F.when(F.contains(name, F.lit(".mp4")), F.regexp_extract(name, r"(\d+)\.mp4", 1))
        .try_cast("bigint").alias("media_id"),
        # Names that are no numbers are not cast: a failed cast costs many times a row.
        F.when(F.endswith(name, F.lit(".json")) & F.regexp_like(stem, F.lit(r"^-?\d+$")), stem)
        .try_cast("bigint").alias("detail_id")), "manifest")
    exact = F.concat(F.col("detail_id").cast("string"), F.lit(".json")) == F.col("name")
    parts = files.select("folder", F.coalesce("media_id", F.when(exact, F.col("detail_id")))
                         .alias("id"), F.col("media_id").isNotNull().alias("is_media"))
    both = (parts.where("id is not null").groupBy("folder", "id")
            .agg(F.max("is_media").alias("media"), F.min("is_media").alias("only_media"))
            .where("media and not only_media"))
    users = files.where("name = 'user.json'").select("folder").distinct()
    return (both.join(users, "folder", "left_semi")
            .groupBy("id").agg(F.max("folder").alias("folder")))


def detected_labels(detections: DataFrame, threshold: float = SETTINGS.detection_confidence
                    ) -> DataFrame:
    """Confident labels per post: distinct, sorted, comma-joined.

    Labels are gathered as sets, on the map side as well, so neither a list nor what is
    shuffled of a post is longer than the detector's label set; one shuffle.
    """
    pairs = detections.where(F.col("score") > threshold).select("id", "label")
    return pairs.groupBy("id").agg(
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("detected_objects"))


def aspect_ratio(stored: Column, width: Column, height: Column) -> Column:
    return F.coalesce(stored, F.try_divide(width, height)).cast("float")


def compose(base: DataFrame, assets: DataFrame, users: DataFrame, details: DataFrame,
            objects: DataFrame | None = None, settings=SETTINGS) -> DataFrame:
    """Join base posts with their sidecars into the curated columns (label still 0).

    ``assets`` is (id, folder), ``users`` is keyed by folder and ``details`` by id;
    columns missing on either side read as null.  Media bytes are not carried through these joins, see
    ``attach_media``; ``has_media`` records that the asset gate saw them.
    """
    a = assets.select(F.col("id").alias("_asset"), F.col("folder").alias("_folder"))
    b = base.join(a, F.col("id") == F.col("_asset")).alias("b")
    u = users.withColumnRenamed("folder", "_owner").alias("u")
    d = details.withColumnRenamed("id", "_detail").alias("d")
    # All joins on the post id share one partitioning; the creator join follows.
    joined = b.join(d, F.col("b.id") == F.col("d._detail"), "left")
    if objects is not None:
        o = objects.select(F.col("id").alias("_object"), "detected_objects").alias("o")
        joined = joined.join(o, F.col("b.id") == F.col("o._object"), "left")
    joined = joined.join(u, F.col("b._folder") == F.col("u._owner"), "left")

    def of(frame: DataFrame, prefix: str, name: str) -> Column:
        return F.col(f"{prefix}.{name}") if name in frame.columns else F.lit(None)

    def base_(name):
        return of(base, "b", name)

    def user_(name):
        return of(users, "u", name)

    def detail_(name):
        return of(details, "d", name)

    def count(detail_name, base_name):
        return F.coalesce(detail_(detail_name).try_cast("bigint"),
                          base_(base_name).try_cast("bigint"))

    counts = {
        "play_count": count("view_count", "play_count"),
        "digg_count": count("like_count", "digg_count"),
        "comment_count": count("comment_count", "comment_count"),
        "share_count": count("repost_count", "share_count"),
        "save_count": count("save_count", "save_count"),
    }
    kinds = dict(base.dtypes)
    created, measured = (clean.parse_epoch(base_(name), kinds.get(name, "string") == "string")
                         for name in ("create_time", "stats_time"))
    created_s, measured_s = clean.epoch_seconds(created), clean.epoch_seconds(measured)
    values = {
        "user_id": clean.whole_or_zero(F.coalesce(
            clean.whole_or_null(user_("user_id")), clean.whole_or_null(base_("user_id")))),
        "username": F.coalesce(user_("unique_id"), base_("username")),
        "user_language": user_("user_language"),
        "city": base_("city"),
        "user_verified": clean.parse_flag(
            F.coalesce(user_("is_verified").cast("string"), base_("user_verified").cast("string"))),
        "is_private": clean.parse_flag(user_("is_private")),
        "account_create_time": clean.parse_any_time(user_("account_create_time")),
        **{name: scores.zero(user_(name).try_cast("bigint")) for name in (
            "author_follower_count", "author_following_count", "author_total_heart_count",
            "author_video_count", "author_friend_count")},
        "id": F.col("b.id"),
        "description": base_("desc"),
        "create_time": clean.parse_any_time(base_("create_time")),
        "day_of_week": clean.weekday(created),
        "hour_of_day": F.hour(created),
        "is_ad": clean.parse_flag(base_("is_ad")),
        "share_enabled": clean.parse_flag(base_("share_enabled")),
        "stitch_enabled": clean.parse_flag(base_("stitch_enabled")),
        "diversification_id": clean.whole_or_null(base_("diversification_id")),
        "music_title": F.coalesce(detail_("track_name"), base_("music_title")),
        "music_album": F.coalesce(detail_("album_name"), base_("music_album")),
        "music_author_name": F.coalesce(detail_("primary_artist"), base_("music_author_name")),
        "aspect_ratio": aspect_ratio(detail_("aspect_ratio"), detail_("width"), detail_("height")),
        **{name: detail_(name) for name in (
            "width", "height", "filesize", "bitrate_tbr", "vcodec", "acodec", "format_id",
            "quality_tier")},
        "stats_time": clean.parse_any_time(base_("stats_time")),
        **counts,
        "engagement_score": scores.engagement(
            counts["share_count"], counts["save_count"], counts["comment_count"],
            counts["digg_count"], counts["play_count"], settings),
        "view_velocity_score": scores.view_velocity(counts["play_count"], created_s, measured_s),
        "is_tail": F.lit(0),
        "detected_objects": (F.coalesce(F.col("o.detected_objects"), F.lit(""))
                             if objects is not None else F.lit("")),
    }
    columns = [values.get(name, base_(name)).try_cast(kind).alias(name)
               for name, kind in CONTRACT if name != "video_bytes"]
    return joined.select(*columns, F.lit(True).alias("has_media"))


def find_media(posts: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """(id, video_bytes) of posts (id, key) whose media lie in ``store`` (key, video_bytes).

    Bytes move as seldom as can be.  A store counted to have ``FEW_BYTES`` at most goes to all
    tasks, and posts are dealt by id before the bytes are there.  Of a larger one only found media
    move on if the posts are counted to be ``FEW_POSTS`` at most, as all tasks know them.  Else the
    store is dealt once, by its key, and the posts go to where their media lie; then the key is
    a column too, for ``attach_media``.
    """
    held = store.agg(F.sum(F.coalesce(F.octet_length("video_bytes"), F.lit(0)) + ROW_BYTES)).first()[0] or 0
    if held <= FEW_BYTES:
        return posts.repartition("id").join(F.broadcast(store), key).select("id", "video_bytes")
    if posts.limit(FEW_POSTS + 1).count() <= FEW_POSTS:
        return F.broadcast(posts).join(store, key).select("id", "video_bytes")
    return posts.hint("shuffle_hash").join(store, key).select("id", key, "video_bytes")


def attach_media(df: DataFrame, media: DataFrame, by: tuple[str, ...] = ("id",)) -> DataFrame:
    """Add the media bytes, null where missing.

    Joined after all filters, so as few large values as possible are shuffled.  The rows
    without their bytes are what a task holds; the bytes stream past and are never sorted.
    Media that have the key under which they lie are attached ``by`` the id and that key: under
    ``session.TOGETHER`` the rows are then dealt by it, and the bytes stay.
    """
    return df.hint("shuffle_hash").join(media.select(*by, "video_bytes"), list(by), "left")


def required_gate(df: DataFrame, required=REQUIRED) -> DataFrame:
    """Keep rows whose required columns are all present (NaN counts as present).

    Before the bytes are attached, ``has_media`` stands in for them.
    """
    names = ["has_media" if c == "video_bytes" and c not in df.columns else c for c in required]
    keep = F.lit(True)
    for name in names:
        keep = keep & F.col(name).isNotNull()
    return df.where(keep)


def enforce_contract(df: DataFrame, contract=CONTRACT) -> tuple[DataFrame, DataFrame]:
    """(typed, rejects): rows whose present values all fit the declared types, and
    the others as they came with the names of the offending columns."""
    present = [(name, kind) for name, kind in contract if name in df.columns]
    bad = F.array_compact(F.array(*[
        F.when(F.col(name).isNotNull() & F.col(name).try_cast(kind).isNull(), F.lit(name))
        for name, kind in present]))
    checked = df.withColumn("violations", bad)
    typed = checked.where(F.size("violations") == 0).select(*[
        F.col(name).try_cast(kind).alias(name) if name in df.columns
        else F.lit(None).cast(kind).alias(name) for name, kind in contract])
    return typed, checked.where(F.size("violations") > 0)


def keep_present(df: DataFrame, columns) -> DataFrame:
    """The listed columns that exist, in the listed order."""
    return df.select(*[c for c in columns if c in df.columns])


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the earliest by ``order``; duplicates are kept elsewhere by default."""
    rest = F.struct(*[c for c in df.columns if c != key])
    return df.groupBy(key).agg(F.min_by(rest, order).alias("_row")).select(key, "_row.*")


def not_yet_written(df: DataFrame, written: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key was not processed before."""
    return df.join(written.select(key), key, "left_anti")
