"""Scans, sinks, cleaning and scalar features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions import clean, features, media, scores, text
from ..operators import compose, labels, reshape, tokens
from ..session import TOGETHER, holding, materialize, passing, scratch_path
from ..sources import documents, frames, grid, packs, published, sinks, tables
from . import fixtures as fx
from .oracle_ctes import sql
from .registry import query


@query("q_scan_profile", """
SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS min_id, max(o_orderkey) AS max_id,
  max(o_totalprice) AS max_price FROM orders GROUP BY 1""")
def scan_profile(spark, sf):
    declared = "o_orderkey bigint, o_orderstatus string, o_totalprice double"
    orders = tables.read_table(spark, f"{sf}/orders.parquet", declared)
    return orders.groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.min("o_orderkey").alias("min_id"),
        F.max("o_orderkey").alias("max_id"), F.max("o_totalprice").alias("max_price"))


@query("q_resume_scan", """
SELECT o_orderkey AS id, o_custkey AS user_id FROM orders ORDER BY o_orderkey OFFSET 1000""")
def resume_scan(spark, sf):
    orders = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"))
    return tables.skip_rows(orders, "id", 1000)


_AFTER = 1000


@query("q_resume_marked", f"""
SELECT count(*) AS n, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id,
  round(sum(o_totalprice), 2) AS price, true AS pruned FROM orders WHERE o_orderkey > {_AFTER}""")
def resume_marked(spark, sf):
    """A reader that stopped at a key goes on behind it, opening only the ranges that follow."""
    path = scratch_path(spark, "ranges")
    orders = fx.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    published.write_ranges(orders, path, "o_orderkey", 16)
    published.save_mark(spark, path, "reader", _AFTER)
    rest = published.read_after(spark, path, published.load_mark(spark, path, "reader"))
    files = len(rest.inputFiles()), len(published.read_after(spark, path).inputFiles())
    return rest.agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_id"),
                    F.max("o_orderkey").alias("last_id"), F.round(F.sum("o_totalprice"), 2).alias("price"),
                    F.lit(files[0] < files[1]).alias("pruned"))


@query("q_take_n", """
SELECT o_orderkey AS id, o_totalprice AS price FROM orders ORDER BY o_orderkey LIMIT 200""")
def take_n(spark, sf):
    orders = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return tables.take_first(orders, "id", 200)


@query("q_asset_gate", """
SELECT o_orderkey AS id, c_name AS folder FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 AND o_custkey % 4 <> 0""")
def asset_gate(spark, sf):
    return compose.asset_gate(fx.manifest(spark, sf))


_USER_META = ("user_id bigint, author_follower_count bigint, author_following_count bigint, "
              "is_verified boolean")
_USER_ROWS = sql("""
SELECT user_id, 'n' || author_following_count AS folder, author_follower_count,
  author_following_count, is_verified FROM user_meta""", "user_meta")


def _written_sidecars(spark, sf):
    """Creator records below one folder per home country."""
    path = scratch_path(spark, "sidecars")
    records = fx.user_meta(fx.posts(spark, sf)).drop("folder").withColumn(
        "home", F.concat(F.lit("n"), F.col("author_following_count")))
    sinks.write_sidecars(records, path, "home")
    return path


@query("q_sidecar_load", _USER_ROWS)
def sidecar_load(spark, sf):
    """The folder comes from the path; records are whole documents of a line each."""
    loaded = tables.read_sidecars(spark, _written_sidecars(spark, sf), _USER_META, False)
    return loaded.select("user_id", F.regexp_replace("folder", "^home=", "").alias("folder"),
                         "author_follower_count", "author_following_count", "is_verified")


@query("q_sidecar_write", """
SELECT c.folder, count(*) AS n, min(user_id) AS first_user, CAST(sum(author_follower_count) AS BIGINT)
  AS followers FROM (""" + _USER_ROWS + """) c GROUP BY 1""")
def sidecar_write(spark, sf):
    """What stands in the folders, read without a declared record."""
    path = _written_sidecars(spark, sf)
    written = spark.read.json(path)
    return written.groupBy(F.col("home").alias("folder")).agg(
        F.count("*").alias("n"), F.min("user_id").alias("first_user"),
        F.sum("author_follower_count").alias("followers"))


@query("q_media_scan", """
SELECT o_orderkey AS id, strlen(html) AS n_bytes, md5(html) AS media_md5
FROM orders LEFT JOIN pages ON page_id = o_orderkey""")
def media_scan(spark, sf):
    """Media packed in archives and read by offset."""
    path = scratch_path(spark, "packs")
    number = F.col("page_id")
    packs.write_packs(fx.table(spark, sf, "pages").select(
        F.concat(F.lit("f"), number % 7).alias("folder"), F.concat(number, F.lit(".mp4")).alias("name"),
        F.encode("html", "UTF-8").alias("content")), path)
    ids = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    whole = compose.attach_media(ids, packs.packed_media(spark, path))
    return whole.select("id", F.octet_length("video_bytes").cast("bigint").alias("n_bytes"),
                        F.md5("video_bytes").alias("media_md5"))


@query("q_media_decode", """
WITH raw AS (SELECT page_id, hex(encode(coalesce(html, ''))) AS b, 3 + page_id % 3 AS w, 2 + page_id % 2 AS h FROM pages),
sized AS (SELECT *, length(b) // (6 * w * h) AS n FROM raw),
fine AS (SELECT page_id, array_to_string(list_transform(range(0, 64), lambda k: substr(b, 1 + CAST(6 * (
    floor((k // 4) * (n - 1) / 15.0e0) * w * h + ((k // 2) % 2) * h // 2 * w + (k % 2) * w // 2) AS BIGINT), 6)), '') AS f
  FROM sized WHERE n > 0 AND page_id % 11 <> 0 AND page_id % 13 <> 0 AND page_id % 17 <> 0 AND page_id % 19 <> 0)
SELECT o_orderkey AS id, f IS NOT NULL AS decoded, md5(coalesce(f, repeat('7C7468', 64))) AS frames_md5
FROM orders LEFT JOIN fine ON page_id = o_orderkey""")
def media_decode(spark, sf):
    """Sixteen frames of 2 x 2 pixels from raw videos whose pixels are the pages' bytes.

    Some files are cut, of another format, empty or missing; those posts get the neutral block.
    """
    path = scratch_path(spark, "packs")
    i, pixels = F.col("page_id"), F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    w, h = 3 + i % 3, 2 + i % 2
    n = F.floor(F.octet_length(pixels) / (3 * w * h))
    whole = frames.raw_video(w, h, n, F.substring(pixels, F.lit(1), (n * 3 * w * h).cast("int")))
    content = (F.when(i % 11 == 0, F.substring(whole, F.lit(1), F.octet_length(whole) - 1))
               .when(i % 13 == 0, F.concat(F.lit(bytearray(b"?")), whole))
               .when(i % 17 == 0, F.lit(bytearray())).when(i % 19 != 0, whole))
    packs.write_packs(fx.table(spark, sf, "pages").select(
        F.concat(F.lit("f"), i % 7).alias("folder"), F.concat(i, F.lit(".mp4")).alias("name"),
        content.alias("content")), path)
    ids = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return frames.decode_posts(spark, ids, path, height=2, width=2).select(
        "id", "decoded", F.md5(F.hex("frames").cast("binary")).alias("frames_md5"))


@query("q_packed_gate", """
SELECT o_orderkey AS id, c_name AS folder, md5('assets/' || c_name || '/' || o_orderkey || '.mp4') AS media_md5
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 AND o_custkey % 4 <> 0""")
def packed_gate(spark, sf):
    """The gate on the inventory alone; bytes are fetched for the posts that pass."""
    path = scratch_path(spark, "packs")
    place = F.col("path")
    packs.write_packs(fx.manifest(spark, sf).select(
        F.substring_index(F.substring_index(place, "/", -2), "/", 1).alias("folder"),
        F.substring_index(place, "/", -1).alias("name"), F.encode(place, "UTF-8").alias("content")), path)
    gate = compose.asset_gate(packs.packed_manifest(spark, path))
    media = packs.inventory(spark, path).withColumn("id", packs.media_id("name"))
    chosen = media.join(gate, ["id", "folder"], "left_semi")
    return packs.read_members(chosen, ["id", "folder"]).select("id", "folder", F.md5("content").alias("media_md5"))


@query("q_sidecar_packed", _USER_ROWS.replace("'n' || author_following_count", "'u' || user_id"))
def sidecar_packed(spark, sf):
    """Creator records, one document each, packed below one folder per creator."""
    path = scratch_path(spark, "packs")
    users = fx.user_meta(fx.posts(spark, sf)).drop("folder")
    packs.write_packs(users.select(
        F.concat(F.lit("u"), "user_id").alias("folder"), F.lit("user.json").alias("name"),
        F.encode(F.to_json(F.struct(*users.columns), {"pretty": "true"}), "UTF-8").alias("content")), path)
    return packs.packed_sidecars(spark, path, _USER_META, "user.json").drop("file_name")


@query("q_html_island", r"""
SELECT page_id, regexp_extract(html, '(?s)<script[^>]*>(.*?)</script>', 1) AS island,
  regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) AS lang FROM pages""")
def html_island(spark, sf):
    return fx.table(spark, sf, "pages").select(
        "page_id", documents.script_island(F.col("html")).alias("island"),
        documents.html_lang(F.col("html")).alias("lang"))


@query("q_profile_project", """
SELECT c_custkey AS id, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey END AS user_id,
  CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS unique_id,
  CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment = 'BUILDING' END AS is_verified,
  CASE WHEN c_custkey % 5 <> 0 THEN c_custkey + 1000000000 END AS account_create_time,
  CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment = 'MACHINERY' END AS is_private,
  CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 THEN CAST(floor(c_acctbal) AS BIGINT) END
    AS author_follower_count,
  CAST(NULL AS BIGINT) AS author_total_heart_count,
  CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 THEN CAST(c_nationkey AS BIGINT) END
    AS author_video_count
FROM customer""")
def profile_project(spark, sf):
    c = F.col
    user = F.struct(
        c("c_custkey").alias("id"), c("c_name").alias("uniqueId"),
        (c("c_mktsegment") == "BUILDING").alias("verified"),
        (c("c_custkey") + 1_000_000_000).alias("createTime"),
        (c("c_mktsegment") == "MACHINERY").alias("privateAccount"))
    stats = F.when(c("c_custkey") % 7 != 0, F.struct(
        F.floor("c_acctbal").alias("followerCount"), c("c_nationkey").alias("videoCount")))
    state = F.to_json(F.struct(F.struct(F.struct(F.struct(
        user.alias("user"), stats.alias("stats")).alias("userInfo")).alias("webapp.user-detail"))
        .alias("__DEFAULT_SCOPE__")))
    page = F.concat(F.lit("<html><script>var x = 1;</script><script id=\""),
                    F.when(c("c_custkey") % 5 != 0, documents.ISLAND_ID).otherwise("other"),
                    F.lit("\" type=\"application/json\">"), state, F.lit("</script></html>"))
    pages = fx.table(spark, sf, "customer").select(c("c_custkey").alias("id"), page.alias("html"))
    return documents.project_profiles(pages, "html", "id")


@query("q_payload_project", sql("""
SELECT id, username, play_count AS view_count, digg_count AS like_count,
  share_count AS repost_count, comment_count, city AS track_name, poi_name AS primary_artist,
  CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'low' ELSE 'high' END AS vcodec,
  CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN play_count ELSE 2 * play_count END AS filesize,
  CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN width ELSE 2 * width END AS width,
  CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN height ELSE 2 * height END AS height
FROM posts WHERE id % 13 <> 0""", "posts"))
def payload_project(spark, sf):
    c = F.col

    def shape(codec, factor):
        return F.struct(F.lit(codec).alias("vcodec"), (c("play_count") * factor).alias("filesize"),
                        (c("width") * factor).alias("width"),
                        (c("height") * factor).alias("height"))

    low, high = shape("low", 1), shape("high", 2)
    formats = (F.when(c("id") % 4 == 0, F.filter(F.array(low), lambda x: F.lit(False)))
               .when(c("id") % 4 == 1, F.array(low)).otherwise(F.array(low, high)))
    payload = F.to_json(F.struct(
        F.when(c("id") % 13 != 0, c("username")).alias("uploader"),
        c("play_count").alias("view_count"), c("digg_count").alias("like_count"),
        c("share_count").alias("repost_count"), "comment_count", c("city").alias("track"),
        c("poi_name").alias("artist"), formats.alias("formats")))
    payloads = fx.posts(spark, sf).select("id", payload.alias("payload"))
    return documents.project_payloads(payloads, "payload", "id")


@query("q_csv_roundtrip", """
SELECT o_orderkey AS id, o_totalprice AS price, o_orderpriority AS priority FROM orders""")
def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "csv")
    sinks.write_csv(fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"),
        F.col("o_orderpriority").alias("priority")), path)
    return tables.read_csv(spark, path, "id bigint, price double, priority string")


_GRID = {"feature_window": (6, 12), "update_freq": (3, 6), "h": (1, 3)}


@query("q_param_grid", sql("""
SELECT feature_window, update_freq, h, count(*) AS n_rows,
  count(DISTINCT month) AS n_months, (max(month) - min(month)) // update_freq + 1 AS n_updates
FROM panel0, (VALUES (6), (12)) a(feature_window), (VALUES (3), (6)) b(update_freq),
  (VALUES (1), (3)) c(h)
WHERE month >= (SELECT min(month) FROM panel0) + feature_window + h - 1
GROUP BY 1, 2, 3""", "panel0"))
def param_grid(spark, sf):
    start = fx.panel_spec(spark, sf).label_start
    months = (fx.table(spark, sf, "orders")
              .select("o_custkey", clean.month_index(F.col("o_orderdate")).alias("month"))
              .distinct().groupBy("month").agg(F.count("*").alias("n")))
    runs = grid.with_options(months, _GRID).where(
        F.col("month") >= F.col("feature_window") + F.col("h") + (start - 1))
    span = F.max("month") - F.min("month")
    return runs.groupBy(*_GRID).agg(
        F.sum("n").alias("n_rows"), F.count("month").alias("n_months"),
        (F.floor(span / F.col("update_freq")) + 1).alias("n_updates"))


@query("q_sharded_write", """
SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_ids, true AS shards_ok FROM orders""")
def sharded_write(spark, sf):
    path = scratch_path(spark, "shards")
    sinks.write_shards(fx.table(spark, sf, "orders"), path)
    written = published.read_published(spark, path)
    per_file = (written.select("o_orderkey", F.col("_metadata.file_path").alias("f"))
                .groupBy("f").agg(F.count("*").alias("n"),
                                  F.count_distinct("o_orderkey").alias("ids")))
    return per_file.agg(F.sum("n").alias("n_rows"), F.sum("ids").alias("n_ids"),
                        (F.max("n") <= SETTINGS.shard_rows).alias("shards_ok"))


@query("q_parse_epoch", sql("SELECT id, epoch_s FROM raw_posts", "raw_posts"))
def parse_epoch(spark, sf):
    return fx.raw_posts(spark, sf).select(
        "id", clean.epoch_seconds(clean.parse_epoch(F.col("create_time"))).alias("epoch_s"))


@query("q_parse_any_ts", sql("""
SELECT id, CASE WHEN id % 97 = 0 OR id % 89 = 0 THEN NULL ELSE create_s END AS epoch_s,
  stats_s FROM raw_posts""", "raw_posts"))
def parse_any_ts(spark, sf):
    return fx.raw_posts(spark, sf).select(
        "id", clean.epoch_seconds(clean.parse_any_time(F.col("create_time"))).alias("epoch_s"),
        clean.epoch_seconds(clean.parse_any_time(F.col("stats_time"))).alias("stats_s"))


# Forms of one instant: how it is written, what is put behind it, which part of it is lost, minutes of its offset.
_FORMS = (("d MMMM yyyy HH:mm:ss", "", 1, 0), ("MMMM d, yyyy h:mm a", "", 60, 0),
          ("EEE, dd MMM yyyy HH:mm:ss", " GMT", 1, 0), ("EEEE d MMM yyyy", "", 86400, 0),
          ("MMM. d yyyy h:mm:ss a", "", 1, 0), ("M/d/yyyy h:mm a", "", 60, 0), ("yyyy/M/d H:mm", "", 60, 0),
          ("yyyyMMdd'T'HHmmss", "Z", 1, 0), ("dd-MMM-yyyy HH:mm:ss", "+0530", 1, 330),
          ("yyyy-M-d H:mm:ss", " -08:00", 1, -480), ("d'th of' MMMM yyyy", "", 86400, 0),
          ("yyyy-MMM-dd h a", " UTC", 3600, 0), ("'32 'MMMM yyyy", "", 0, 0), ("d 'Foo' yyyy HH:mm", "", 0, 0))


@query("q_free_dates", f"""
WITH stamped AS (SELECT o_orderkey AS id, CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey * 7919 % 86400 AS s,
  o_orderkey % {len(_FORMS)} AS form FROM orders),
forms(form, lost, offset_min) AS (VALUES {", ".join(f"({k}, {f[2]}, {f[3]})" for k, f in enumerate(_FORMS))})
SELECT id, CASE WHEN lost > 0 THEN s - s % lost - offset_min * 60 END AS epoch_s
FROM stamped JOIN forms USING (form)""")
def free_dates(spark, sf):
    i = F.col("id")
    orders = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.timestamp_seconds(F.unix_timestamp("o_orderdate") + F.col("o_orderkey") * 7919 % 86400)
        .alias("at"))
    written = F.lit(None).cast("string")
    for k, (layout, behind, _, _) in enumerate(_FORMS):
        written = F.when(i % len(_FORMS) == k, F.concat(F.date_format("at", layout), F.lit(behind))).otherwise(written)
    texts = materialize(orders.select("id", F.when(i % 3 == 0, F.upper(written)).otherwise(written).alias("t")), "dates")
    return texts.select("id", clean.epoch_seconds(clean.parse_any_time(F.col("t"))).alias("epoch_s"))


@query("q_bool_dialects", sql("""
SELECT id, coalesce(lower(user_verified) IN ('t', 'true', '1'), false) AS flag,
  CASE WHEN user_verified IN ('t', 'true', 'True', '1') THEN 1 ELSE 0 END AS flag_int,
  CASE WHEN upper(user_verified) IN ('t', 'true', 'True', '1') THEN 1 ELSE 0 END AS upper_int
FROM raw_posts""", "raw_posts"))
def bool_dialects(spark, sf):
    v = F.col("user_verified")
    return fx.raw_posts(spark, sf).select(
        "id", clean.parse_flag(v).alias("flag"), clean.parse_flag_int(v).alias("flag_int"),
        clean.parse_flag_int(F.upper(v)).alias("upper_int"))


@query("q_numeric_coerce", sql("""
SELECT id, coalesce(try_cast(duration AS DOUBLE), 0) AS duration,
  coalesce(try_cast(vq_score AS DOUBLE), 0) AS vq_score FROM raw_posts""", "raw_posts"))
def numeric_coerce(spark, sf):
    return fx.raw_posts(spark, sf).select(
        "id", clean.coerce_number(F.col("duration")).alias("duration"),
        clean.coerce_number(F.col("vq_score")).alias("vq_score"))


@query("q_time_parts", sql("""
SELECT id, day_of_week, hour_of_day, strftime(create_time, '%Y-%m') AS cohort_month
FROM posts""", "posts"))
def time_parts(spark, sf):
    created = F.col("o_orderdate")
    return fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), clean.weekday(created).alias("day_of_week"),
        F.hour(created).alias("hour_of_day"), clean.cohort_month(created).alias("cohort_month"))


@query("q_scores", sql("""
SELECT id, round(e, 6) AS engagement_score, round(v, 6) AS view_velocity_score
FROM scored0""", "scored0"))
def score_posts(spark, sf):
    return fx.scored_posts(spark, sf).select(
        "id", F.round("engagement_score", 6).alias("engagement_score"),
        F.round("view_velocity_score", 6).alias("view_velocity_score"))


@query("q_text_counts", sql("""
SELECT id, length(coalesce(description, '')) AS caption_length,
  md5(substring(coalesce(description, ''), 1, 80)) AS head_md5 FROM captioned""", "captioned"))
def text_counts(spark, sf):
    ids = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    caption = F.col("description")
    return fx.with_captions(spark, sf, ids).select(
        "id", text.caption_length(caption).cast("bigint").alias("caption_length"),
        F.md5(text.caption_head(caption)).alias("head_md5"))


@query("q_hashtag_count", sql("""
SELECT id, CAST(CASE id % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 4 THEN 2 ELSE 0 END AS INTEGER)
  AS hashtag_count, CASE WHEN challenges IS NULL THEN 0
    WHEN json_valid(challenges) AND json_type(CASE WHEN json_valid(challenges) THEN challenges
      ELSE 'null' END) = 'ARRAY'
    THEN CAST(json_array_length(CASE WHEN json_valid(challenges) THEN challenges ELSE 'null' END)
      AS INTEGER)
    ELSE CAST(len(list_filter(string_split(challenges, ','), lambda x: trim(x) <> ''))
      AS INTEGER) END AS counted
FROM raw_posts""", "raw_posts"))
def hashtag_count(spark, sf):
    count = text.hashtag_count(F.col("challenges"))
    return fx.raw_posts(spark, sf).select("id", count.alias("hashtag_count"),
                                          count.alias("counted"))


@query("q_engage_ratio", sql("""
SELECT id, round((coalesce(digg_count, 0) + coalesce(comment_count, 0) + coalesce(share_count, 0))
  / CAST(play_count + 1 AS DOUBLE), 6) AS engage_ratio FROM posts""", "posts"))
def engage_ratio(spark, sf):
    numbers = [clean.coerce_number(F.col(c)) for c in (
        "digg_count", "comment_count", "share_count", "play_count")]
    return fx.posts(spark, sf).select(
        "id", F.round(scores.interaction_ratio(*numbers), 6).alias("engage_ratio"))


@query("q_tabular_vector", sql("SELECT id, " + ", ".join(
    f"round(f{i:02d}, 6) AS f{i:02d}" for i in range(1, 20)) + ", 19 AS width FROM feat", "feat"))
def tabular_vector(spark, sf):
    rows = features.with_features(fx.scored_posts(spark, sf), "id")
    vector = rows.select("id", features.feature_vector().alias("v"))
    return vector.select("id", *[F.round(F.col("v")[i], 6).alias(slot)
                                 for i, slot in enumerate(features.FEATURE_SLOTS)],
                         F.size("v").alias("width"))


@query("q_cyclic_time", sql("""
SELECT user_id, CAST(day AS VARCHAR) AS day,
  round(sin(hour(create_time) * 2 * pi() / 24), 6) AS sin_hour,
  round(cos(hour(create_time) * 2 * pi() / 24), 6) AS cos_hour,
  round(sin((isodow(create_time) - 1) * 2 * pi() / 7), 6) AS sin_day,
  round(cos((isodow(create_time) - 1) * 2 * pi() / 7), 6) AS cos_day
FROM interactions""", "interactions"))
def cyclic_time(spark, sf):
    sin_hour, cos_hour = features.cyclic(F.hour("create_time"), 24)
    sin_day, cos_day = features.cyclic(clean.weekday(F.col("create_time")), 7)
    named = {"sin_hour": sin_hour, "cos_hour": cos_hour, "sin_day": sin_day, "cos_day": cos_day}
    return fx.interactions(spark, sf).select(
        "user_id", F.col("day").cast("string").alias("day"),
        *[F.round(v, 6).alias(k) for k, v in named.items()])


@query("q_text_template", sql("""
SELECT id, md5(line) AS line_md5, length(line) AS line_length FROM (
  SELECT id, '[CLS] [TITLE] ' || coalesce(description, 'None') || ' [MUSIC] '
    || coalesce(p_name, 'None') || ' by ' || coalesce(p_brand, 'None') || ' [CHALLENGES] '
    || coalesce(CASE id % 5 WHEN 0 THEN '["a","b"]' WHEN 1 THEN 'a, b,,c' WHEN 2 THEN ''
      WHEN 4 THEN '{"a":1,"b":2}' END, 'None')
    || ' [OBJECTS] ' || coalesce(detected_objects, '') || ' [LOC] ' || coalesce(city, 'None')
    || ' ' || coalesce(poi_name, 'None') AS line
  FROM captioned LEFT JOIN part ON p_partkey = id % (SELECT count(*) FROM part)
    LEFT JOIN objects USING (id))""", "captioned", "objects"))
def text_template(spark, sf):
    p = fx.posts(spark, sf).select("id", "city", "poi_name", fx.challenges().alias("challenges"))
    objects = compose.detected_labels(fx.detections(spark, sf))
    # The long captions join last, after the narrow columns are complete.
    narrow = fx.with_music(spark, sf, p).join(objects, "id", "left")
    rows = fx.with_captions(spark, sf, narrow)
    c = F.col
    line = text.text_template(c("description"), c("music_title"), c("music_author_name"),
                              c("challenges"), F.coalesce("detected_objects", F.lit("")),
                              c("city"), c("poi_name"))
    return rows.select("id", F.md5(line).alias("line_md5"),
                       F.length(line).cast("bigint").alias("line_length"))


@query("q_token_window", r"""
WITH words AS MATERIALIZED (SELECT doc_id, list_filter(
    string_split_regex(text, '[ \t\n\r]+'), lambda w: w <> '') AS ws FROM documents),
vocab AS MATERIALIZED (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 1 AS tid FROM (
  SELECT token, count(*) AS n FROM (SELECT unnest(ws) AS token FROM words) GROUP BY 1)),
heads AS (SELECT doc_id, unnest(ws[1:256]) AS token,
  generate_subscripts(ws[1:256], 1) AS pos FROM words),
ids AS (SELECT doc_id, list(coalesce(tid, 1) ORDER BY pos) AS l
  FROM heads LEFT JOIN vocab USING (token) GROUP BY 1)
SELECT words.doc_id, CAST(coalesce(len(l), 0) AS INTEGER) AS n_tokens,
  md5(array_to_string(list_resize(coalesce(l, CAST([] AS BIGINT[])), 256, 0), ',')) AS ids_md5,
  CAST(coalesce(len(l), 0) AS INTEGER) AS mask_sum, 256 AS width
FROM words LEFT JOIN ids USING (doc_id)""")
def token_window(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    windows = tokens.token_windows(docs, "doc_id", "text", tokens.vocabulary(docs, "text"))
    return windows.select(
        "doc_id", "n_tokens", F.md5(F.concat_ws(",", F.col("input_ids").cast("array<string>")))
        .alias("ids_md5"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"),
        F.size("input_ids").alias("width"))


@query("q_targets", sql("""
SELECT id, round(ln(1 + greatest(0, e)), 6) AS log_engagement,
  round(ln(1 + greatest(0, v)), 6) AS log_velocity, CAST(is_tail AS DOUBLE) AS label
FROM labelled""", "labelled"))
def targets(spark, sf):
    stored = fx.stored_scores(spark, sf)
    rows = labels.label_tail(stored, labels.tail_stats(stored))
    t = scores.targets(F.col("engagement_score"), F.col("view_velocity_score"), F.col("is_tail"))
    return rows.select("id", t.alias("t")).select(
        "id", F.round(F.col("t")[0], 6).alias("log_engagement"),
        F.round(F.col("t")[1], 6).alias("log_velocity"), F.col("t")[2].alias("label"))


@query("q_frame_plan", """
SELECT o_orderkey AS id, array_to_string(list_transform(range(0, 16), lambda i:
    CAST(floor(i * (n - 1) / 15.0e0) AS BIGINT)), ',') AS positions, n // 2 AS middle
FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders)""")
def frame_plan(spark, sf):
    n = F.floor("o_totalprice").cast("bigint")
    return fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat_ws(",", media.frame_positions(n).cast("array<string>")).alias("positions"),
        media.middle_frame(n).alias("middle"))


@query("q_crop_plan", sql("""
SELECT id, CAST(nw AS BIGINT) AS new_w, CAST(nh AS BIGINT) AS new_h,
  CAST(floor((nw - 224) / 2) AS BIGINT) AS x1, CAST(floor((nh - 224) / 2) AS BIGINT) AS y1,
  width = 224 AND height = 224 AS noop
FROM (SELECT *, floor(width * s) AS nw, floor(height * s) AS nh FROM (
  SELECT *, greatest(224.0e0 / width, 224.0e0 / height) AS s FROM posts WHERE width IS NOT NULL))
""", "posts"))
def crop_plan(spark, sf):
    p = fx.item_totals(spark, sf).select(
        F.col("l_orderkey").alias("id"), (F.col("w") * 100).alias("width"),
        (F.col("h") * 100).alias("height"))
    orders = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    sized = p.join(orders, "id", "left_semi")
    return sized.select("id", media.crop_plan(F.col("width"), F.col("height")).alias("p")).select(
        "id", "p.*")


@query("q_schema_contract", sql("""
SELECT CASE WHEN id % 31 = 0 THEN 'duration' ELSE 'ok' END AS violations, count(*) AS n,
  count(DISTINCT id) AS n_ids FROM raw_posts GROUP BY 1""", "raw_posts"))
def schema_contract(spark, sf):
    raw = fx.raw_posts(spark, sf).select(
        "id", "user_id", "username", "city", "duration", "vq_score", "challenges", "play_count")
    typed, rejects = compose.enforce_contract(raw)
    bad = rejects.select("id", F.array_join("violations", ",").alias("violations"))
    good = typed.select("id", F.lit("ok").alias("violations"))
    return bad.unionByName(good).groupBy("violations").agg(
        F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"))


_FLAT_SQL = """
flat AS MATERIALIZED (SELECT raw_posts.*,
  strftime(make_timestamp(epoch_s * 1000000), '%Y-%m') AS cohort_month
FROM raw_posts WHERE epoch_s > 0 AND play_count IS NOT NULL),
cuts AS (SELECT cohort_month AS cm, round(quantile_cont(CAST(play_count AS DOUBLE), 0.95), 9) AS t
FROM flat GROUP BY 1)
"""


def _flat(body):
    return sql("@", "raw_posts").replace("\n@", ",\n" + _FLAT_SQL + body)


@query("q_cohort_label", _flat("""
SELECT id, cohort_month, CAST(play_count AS DOUBLE) AS play_count,
  CASE WHEN play_count >= t THEN 1 ELSE 0 END AS tail
FROM flat JOIN cuts ON cm = cohort_month"""))
def cohort_label(spark, sf):
    flat = labels.engineer_flat(fx.raw_posts(spark, sf)).select("id", "cohort_month", "play_count")
    return labels.label_cohorts(materialize(flat, "flat"), "play_count").select(
        "id", "cohort_month", "play_count", "tail")


_LABEL_TABLE_SQL = _flat("""
SELECT id, user_id, cohort_month, CASE WHEN play_count >= t THEN 1 ELSE 0 END AS tail,
  coalesce(try_cast(duration AS DOUBLE), 0) AS duration,
  coalesce(try_cast(vq_score AS DOUBLE), 0) AS vq_score, 0 AS music_original,
  CASE WHEN user_verified IN ('t', 'true', 'True', '1') THEN 1 ELSE 0 END AS user_verified,
  CAST(CASE id % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 4 THEN 2 ELSE 0 END AS INTEGER)
    AS hashtag_count,
  CAST(length(coalesce(text, '')) AS INTEGER) AS caption_length,
  CAST(hour(make_timestamp(epoch_s * 1000000)) AS INTEGER) AS post_hour,
  CAST(isodow(make_timestamp(epoch_s * 1000000)) - 1 AS INTEGER) AS post_dow,
  round((coalesce(digg_count, 0) + coalesce(comment_count, 0) + coalesce(share_count, 0))
    / CAST(play_count + 1 AS DOUBLE), 6) AS engage_ratio
FROM flat JOIN cuts ON cm = cohort_month
  LEFT JOIN documents ON doc_id = id % (SELECT count(*) FROM documents)""")


def _label_table(spark, sf):
    raw = fx.with_captions(spark, sf, fx.raw_posts(spark, sf)).withColumnRenamed(
        "description", "desc")
    flat = materialize(labels.engineer_flat(raw), "flat")
    cohort = labels.label_cohorts(flat, "play_count")
    return compose.keep_present(cohort, labels.LABEL_TABLE_COLUMNS).withColumn(
        "engage_ratio", F.round("engage_ratio", 6))


@query("q_label_table", _LABEL_TABLE_SQL)
def label_table(spark, sf):
    return _label_table(spark, sf)


@query("q_label_write", _LABEL_TABLE_SQL)
def label_write(spark, sf):
    path = scratch_path(spark, "label-table")
    sinks.write_label_table(_label_table(spark, sf), path)
    return published.read_published(spark, path)


@query("q_required_gate", sql("""
SELECT id, user_id, duration FROM posts
WHERE duration IS NOT NULL AND author_friend_count IS NOT NULL""", "posts"))
def required_gate(spark, sf):
    p = fx.posts(spark, sf).withColumns({
        "engagement_score": F.lit(0.0), "view_velocity_score": F.lit(0.0),
        "has_media": F.lit(True)})
    return compose.required_gate(p).select("id", "user_id", "duration")


@query("q_pipeline_counts", sql("""
SELECT 'read' AS stage, count(*) AS n_rows FROM raw_posts UNION ALL
SELECT 'usable', count(*) FROM raw_posts WHERE epoch_s > 0 AND play_count IS NOT NULL UNION ALL
SELECT 'dropped', count(*) FROM raw_posts WHERE NOT coalesce(epoch_s > 0, false)
  OR play_count IS NULL""", "raw_posts"))
def pipeline_counts(spark, sf):
    """Counted while the usable rows are written, not by a second reading."""
    path = scratch_path(spark, "usable")
    gates = {"usable": (clean.number_from_text(F.col("create_time")) > 0) & F.col("play_count").isNotNull()}
    return reshape.count_passing(spark, lambda session: fx.raw_posts(session, sf), gates,
                                 lambda kept: sinks.write_shards(kept, path) and None)


@query("q_entity_filter", """
SELECT o_orderkey AS id, o_custkey AS user_id, o_totalprice AS price FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def entity_filter(spark, sf):
    from ..operators.temporal import only_entities
    wanted = fx.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("user_id"))
    orders = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
        F.col("o_totalprice").alias("price"))
    return only_entities(orders, "user_id", wanted)


_COMPOSE_SQL = sql("""
SELECT p.id, p.user_id, p.username, p.city,
  coalesce(u.is_verified, false) AS user_verified, coalesce(u.is_private, false) AS is_private,
  u.author_follower_count, u.author_following_count, u.author_total_heart_count,
  u.author_video_count, coalesce(u.author_friend_count, 0) AS author_friend_count,
  CASE WHEN p.id % 97 <> 0 AND p.id % 89 <> 0 THEN p.create_s END AS create_s, p.stats_s,
  CASE WHEN epoch_s IS NOT NULL THEN isodow(make_timestamp(epoch_s * 1000000)) - 1 END
    AS day_of_week,
  CASE WHEN epoch_s IS NOT NULL THEN hour(make_timestamp(epoch_s * 1000000)) END AS hour_of_day,
  p.is_ad, try_cast(p.duration AS BIGINT) AS duration, p.challenges, m.width, m.height,
  round(coalesce(m.aspect_ratio, m.width / CAST(m.height AS DOUBLE)), 4) AS aspect_ratio,
  coalesce(m.view_count, p.play_count) AS play_count, m.like_count AS digg_count,
  p.comment_count, m.repost_count AS share_count, p.save_count,
  round((4 * coalesce(m.repost_count, 0) + 3 * coalesce(p.save_count, 0)
    + 2 * coalesce(p.comment_count, 0) + coalesce(m.like_count, 0))
    / CAST(coalesce(m.view_count, p.play_count) + 1 AS DOUBLE), 6) AS engagement_score,
  round(ln(1 + coalesce(m.view_count, p.play_count)
    / (greatest(1, coalesce(p.stats_s - epoch_s, 0)) / 3600.0e0)), 6) AS view_velocity_score,
  coalesce(detected_objects, '') AS detected_objects
FROM raw_posts p JOIN user_meta u USING (user_id) JOIN video_meta m USING (id)
  LEFT JOIN objects o USING (id)
WHERE p.id % 5 <> 0""", "raw_posts", "user_meta", "video_meta", "objects")


def _shown(composed):
    return composed.select(
        "id", "user_id", "username", "city", "user_verified", "is_private",
        "author_follower_count", "author_following_count", "author_total_heart_count",
        "author_video_count", "author_friend_count",
        clean.epoch_seconds(F.col("create_time")).alias("create_s"),
        clean.epoch_seconds(F.col("stats_time")).alias("stats_s"),
        "day_of_week", "hour_of_day", "is_ad", "duration", "challenges", "width", "height",
        F.round(F.col("aspect_ratio").cast("double"), 4).alias("aspect_ratio"),
        "play_count", "digg_count", "comment_count", "share_count", "save_count",
        F.round("engagement_score", 6).alias("engagement_score"),
        F.round("view_velocity_score", 6).alias("view_velocity_score"), "detected_objects")


@query("q_compose", _COMPOSE_SQL)
def compose_posts(spark, sf):
    # Base rows and sidecars are separate inputs; here all derive from one stored frame.
    stored = materialize(fx.posts(spark, sf), "posts")
    return _shown(compose.compose(
        fx.raw_posts(spark, sf, stored), compose.asset_gate(fx.manifest(spark, sf)),
        fx.user_meta(stored), fx.video_meta(stored),
        compose.detected_labels(fx.detections(spark, sf))))


#: Rows of an arriving file.
_ARRIVING = 1 << 18


@query("q_stream_compose", _COMPOSE_SQL)
def stream_compose(spark, sf):
    from ..streaming.incremental import compose_stream, read_shards
    stored = materialize(fx.posts(spark, sf), "posts")
    # Files of a bounded size, as many as keep all cores busy; either trigger takes one half.
    half = max(2, spark.sparkContext.defaultParallelism, -(-stored.count() // (2 * _ARRIVING)))
    arrived = materialize(fx.raw_posts(spark, sf, stored).repartition(2 * half), "arrived")
    # Static sides are stored once, else every micro-batch would derive them again.
    gate = materialize(compose.asset_gate(fx.manifest(spark, sf)), "gate")
    users = materialize(fx.user_meta(stored), "users")
    details = materialize(fx.video_meta(stored), "details")
    objects = materialize(compose.detected_labels(fx.detections(spark, sf)), "objects")
    sink = scratch_path(spark, "composed")
    compose_stream(spark, arrived.inputFiles()[0].rsplit("/", 1)[0], arrived.schema,
                   lambda batch: compose.compose(batch, gate, users, details, objects),
                   sink, scratch_path(spark, "composed-state"), files_per_trigger=half)
    return _shown(read_shards(spark, sink))


@query("q_stream_seen", """
SELECT o_orderkey AS id, o_totalprice AS price, 1 AS times,
  CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 1 END AS trigger FROM orders""")
def stream_seen(spark, sf):
    """Two triggers of one stream; the second delivers rows of the first again, in other files."""
    from ..streaming.incremental import compose_stream, read_shards
    orders = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), "o_orderstatus")
    inbox, sink, state = (scratch_path(spark, n) for n in ("inbox", "seen", "seen-state"))
    for trigger, arrived in ((1, "o_orderstatus <> 'O'"), (2, "o_orderstatus <> 'F'")):
        orders.where(arrived).drop("o_orderstatus").write.mode("append").parquet(inbox)
        compose_stream(spark, inbox, "id bigint, price double",
                       lambda batch, n=trigger: batch.withColumn("trigger", F.lit(n)), sink, state, key="id")
    return read_shards(spark, sink).groupBy("id", "price").agg(
        F.count("*").cast("int").alias("times"), F.max("trigger").alias("trigger"))


@query("q_build_labelled", sql("@", "raw_posts", "user_meta", "video_meta").replace("\n@", """,
joined AS (SELECT p.id, CASE WHEN p.id % 97 <> 0 THEN create_s END AS made, p.stats_s,
    try_cast(p.duration AS BIGINT) AS duration, try_cast(p.vq_score AS DOUBLE) AS vq, m.width, m.height,
    coalesce(m.aspect_ratio, m.width / CAST(m.height AS DOUBLE)) AS ratio,
    coalesce(m.view_count, p.play_count) AS plays, coalesce(m.repost_count, 0) AS shares,
    coalesce(p.save_count, 0) AS saves, coalesce(p.comment_count, 0) AS comments,
    coalesce(m.like_count, 0) AS likes
  FROM raw_posts p JOIN user_meta u USING (user_id) JOIN video_meta m USING (id) WHERE p.id % 5 <> 0),
kept AS MATERIALIZED (SELECT id, isodow(make_timestamp(made * 1000000)) - 1 AS day_of_week,
    (4 * shares + 3 * saves + 2 * comments + likes) / CAST(plays + 1 AS DOUBLE) AS e,
    ln(1 + plays / (greatest(1, coalesce(stats_s - made, 0)) / 3600.0e0)) AS v
  FROM joined WHERE made IS NOT NULL AND duration IS NOT NULL AND vq IS NOT NULL
    AND width IS NOT NULL AND height IS NOT NULL AND ratio IS NOT NULL AND plays IS NOT NULL),
tops AS (SELECT max(e) AS me, max(v) AS mv FROM kept),
summed AS MATERIALIZED (SELECT kept.*, round(e / me + v / mv, 9) AS s FROM kept, tops),
cut AS (SELECT round(quantile_cont(s, 0.95), 9) AS t FROM summed)
SELECT summed.id, day_of_week, round(e, 6) AS engagement_score, round(v, 6) AS view_velocity_score,
  strlen(html) AS n_bytes, CAST(CASE WHEN s >= t THEN 1 ELSE 0 END AS BIGINT) AS is_tail
FROM summed, cut JOIN pages ON page_id = summed.id % (SELECT count(*) FROM pages)"""))
def build_labelled(spark, sf):
    """Raw posts to the labelled dataset: compose, gate, media, shards, label.

    Creation times are numbers here, 0 where missing.
    """
    i, path = F.col("id"), scratch_path(spark, "dataset")
    with passing(spark):
        place = scratch_path(spark, "kept")
        with passing(spark):
            stored = materialize(fx.posts(spark, sf), "posts")
            base = fx.raw_posts(spark, sf, stored, F.when(
                i % 97 != 0, clean.epoch_seconds(F.col("create_time"))).otherwise(0))
            composed = compose.compose(
                base, compose.asset_gate(fx.manifest(spark, sf)), fx.user_meta(stored),
                fx.video_meta(stored), compose.detected_labels(fx.detections(spark, sf)))
            # Read twice, by the media and by the rows that they are attached to.
            kept = materialize(compose.required_gate(composed), "kept", place)
        pages = fx.table(spark, sf, "pages").select(
            F.col("page_id").alias("_page"), F.encode("html", "UTF-8").alias("video_bytes"))
        posts = kept.withColumn("_page", i % fx.count_of(spark, sf, "pages"))
        media = compose.find_media(posts.select("id", "_page"), pages, "_page")
        by = tuple(c for c in ("id", "_page") if c in media.columns)
        with holding(spark, TOGETHER):
            sinks.write_shards(compose.attach_media(posts, media, by).drop("_page"), path)
    with passing(spark):
        dataset = published.read_published(spark, path)
        labelled = labels.label_tail(dataset, labels.tail_stats(dataset))
    return labelled.select(
        "id", F.col("day_of_week"), F.round("engagement_score", 6).alias("engagement_score"),
        F.round("view_velocity_score", 6).alias("view_velocity_score"),
        F.octet_length("video_bytes").cast("bigint").alias("n_bytes"), "is_tail")


@query("q_object_labels", sql("""
SELECT o_orderkey AS id, coalesce(detected_objects, '') AS detected_objects
FROM orders LEFT JOIN objects ON id = o_orderkey""", "objects"))
def object_labels(spark, sf):
    found = compose.detected_labels(fx.detections(spark, sf))
    ids = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return ids.join(found, "id", "left").select(
        "id", F.coalesce("detected_objects", F.lit("")).alias("detected_objects"))


@query("q_label_media", _flat("""
SELECT id, cohort_month, CASE WHEN play_count >= t THEN 1 ELSE 0 END AS tail,
  strlen(html) AS n_bytes
FROM flat JOIN cuts ON cm = cohort_month LEFT JOIN pages ON page_id = id"""))
def label_media(spark, sf):
    labelled = cohort_label(spark, sf).drop("play_count")
    measured = fx.table(spark, sf, "pages").select(
        F.col("page_id").alias("id"), F.octet_length("html").cast("bigint").alias("n_bytes"))
    return labelled.join(measured, "id", "left")


@query("q_incremental_anti", """
SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderstatus <> 'F'""")
def incremental_anti(spark, sf):
    orders = fx.table(spark, sf, "orders")
    written = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    arriving = orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return compose.not_yet_written(arriving, written)


