"""Nested documents: profile pages with a JSON island and media payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Where a profile page keeps its state.
ISLAND_ID = "__UNIVERSAL_DATA_FOR_REHYDRATION__"
_SCOPE = "$.__DEFAULT_SCOPE__['webapp.user-detail'].userInfo"

# Creator fields, their path below the user-info node, their type.
PROFILE_FIELDS = (
    ("user_id", "user.id", "bigint"),
    ("unique_id", "user.uniqueId", "string"),
    ("is_verified", "user.verified", "boolean"),
    ("account_create_time", "user.createTime", "bigint"),
    ("is_private", "user.privateAccount", "boolean"),
    ("author_follower_count", "stats.followerCount", "bigint"),
    ("author_total_heart_count", "stats.heartCount", "bigint"),
    ("author_video_count", "stats.videoCount", "bigint"),
)

# Payload schema and the renaming of its fields.
PAYLOAD_SCHEMA = (
    "uploader string, view_count bigint, like_count bigint, repost_count bigint, "
    "comment_count bigint, track string, artist string, formats array<struct<"
    "vcodec: string, filesize: bigint, width: bigint, height: bigint>>"
)
PAYLOAD_FIELDS = (
    ("username", "uploader"), ("view_count", "view_count"), ("like_count", "like_count"),
    ("repost_count", "repost_count"), ("comment_count", "comment_count"),
    ("track_name", "track"), ("primary_artist", "artist"),
)
FORMAT_FIELDS = ("vcodec", "filesize", "width", "height")


def script_island(html: Column, element_id: str | None = None) -> Column:
    """Body of the first <script>, or of the one with the given id; '' if none."""
    attrs = "[^>]*" if element_id is None else rf"[^>]*id=[\"']{element_id}[\"'][^>]*"
    return F.regexp_extract(html, rf"(?s)<script{attrs}>(.*?)</script>", 1)


def html_lang(html: Column) -> Column:
    return F.regexp_extract(html, r"<html[^>]*lang=\"([^\"]*)\"", 1)


def project_profiles(pages: DataFrame, html: str, *keep: str) -> DataFrame:
    """Creator fields out of crawled profile pages; absent parts give null."""
    state = F.try_parse_json(F.nullif(script_island(F.col(html), ISLAND_ID), F.lit("")))
    parsed = pages.select(*keep, state.alias("_state"))
    return parsed.select(*keep, *[
        F.try_variant_get("_state", f"{_SCOPE}.{path}", kind).alias(name)
        for name, path, kind in PROFILE_FIELDS])


def project_payloads(payloads: DataFrame, text: str, *keep: str) -> DataFrame:
    """Media payloads to flat fields; technical ones come from the last format.

    Records without a username are not usable and are left out.
    """
    parsed = payloads.select(*keep, F.from_json(text, PAYLOAD_SCHEMA).alias("p"))
    best = F.try_element_at("p.formats", F.lit(-1))
    flat = parsed.select(
        *keep,
        *[F.col(f"p.{src}").alias(name) for name, src in PAYLOAD_FIELDS],
        *[best[name].alias(name) for name in FORMAT_FIELDS])
    return flat.where(F.col("username") != "")
