import datetime

import pytest
from pyspark.sql import functions as F

from postlift.functions import dates, clean, features, media, scores, text


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize("value,expected", [
    ("1700000000", datetime.datetime(2023, 11, 14, 22, 13, 20)),
    (" 0 ", datetime.datetime(1970, 1, 1)),
    ("1.5", datetime.datetime(1970, 1, 1, 0, 0, 1, 500000)),
    ("-1", datetime.datetime(1969, 12, 31, 23, 59, 59)),
    ("", None), ("junk", None), ("12d", None), ("nan", None), ("1e300", None), (None, None),
    ("2020-01-01", None)])
def test_epoch_reader_takes_numbers_only(spark, value, expected):
    assert one(spark, clean.parse_epoch, value) == expected


def test_epoch_zero_number_means_missing(spark):
    assert one(spark, lambda c: clean.parse_epoch(c, is_text=False), 0, "bigint") is None
    assert one(spark, lambda c: clean.parse_epoch(c, is_text=False), 1, "bigint") is not None


@pytest.mark.parametrize("value,expected", [
    ("1700000000.9", datetime.datetime(2023, 11, 14, 22, 13, 20)),
    ("2020-02-03 04:05:06", datetime.datetime(2020, 2, 3, 4, 5, 6)),
    ("2020-02-03T04:05:06.789Z", datetime.datetime(2020, 2, 3, 4, 5, 6)),
    ("2020-02-03T04:05:06+02:00", datetime.datetime(2020, 2, 3, 2, 5, 6)),
    ("2020-02-03", datetime.datetime(2020, 2, 3)),
    ("02/03/2020", datetime.datetime(2020, 2, 3)),
    ("3 Feb 2020", datetime.datetime(2020, 2, 3)),
    ("Feb 3, 2020", datetime.datetime(2020, 2, 3)),
    ("not a date", None), ("", None), (None, None)])
def test_general_time_reader(spark, value, expected):
    assert one(spark, clean.parse_any_time, value) == expected


def test_two_flag_dialects(spark):
    values = ["t", "T", "true", "TRUE", "True", "1", "yes", "f", "0", "", None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = rows.select("i", clean.parse_flag(F.col("v")), clean.parse_flag_int(F.col("v"))
                      ).orderBy("i").collect()
    assert [r[1] for r in got] == [True] * 6 + [False] * 5
    assert [r[2] for r in got] == [1, 0, 1, 0, 1, 1, 0, 0, 0, 0, 0]
    assert one(spark, clean.parse_flag, True, "boolean") is True


def test_number_coercion(spark):
    for value, expected in [("3", 3.0), ("-.5e1", -5.0), ("x", 0.0), ("1f", 0.0), (None, 0.0)]:
        assert one(spark, clean.coerce_number, value) == expected
    assert one(spark, clean.coerce_number, float("nan"), "double") == 0.0


def test_optional_identifiers(spark):
    assert one(spark, clean.whole_or_zero, None) == 0
    assert one(spark, clean.whole_or_zero, "7") == 7
    assert one(spark, clean.whole_or_null, "0") is None
    assert one(spark, clean.whole_or_null, "7") == 7


def test_calendar_parts(spark):
    monday = datetime.datetime(2024, 1, 1, 5)
    assert one(spark, clean.weekday, monday, "timestamp_ntz") == 0
    assert one(spark, clean.cohort_month, monday, "timestamp_ntz") == "2024-01"
    assert one(spark, clean.month_index, monday, "timestamp_ntz") == 2024 * 12 + 1


@pytest.mark.parametrize("value,expected", [
    (None, 0), ('["a","b"]', 2), ("[]", 0), ("a, b,,c", 3), ("", 0), (" , ", 0),
    ('{"a":1,"b":2}', 2), ("solo", 1), ("7", 1)])
def test_hashtag_rule(spark, value, expected):
    assert one(spark, text.hashtag_count, value) == expected


def test_hashtag_list(spark):
    assert one(spark, text.hashtag_list_count, ["a", "b"], "array<string>") == 2
    assert one(spark, text.hashtag_list_count, None, "array<string>") == 0


def test_captions_count_code_points(spark):
    assert one(spark, text.caption_length, "né\U0001F600") == 3
    assert one(spark, text.caption_length, None) == 0
    assert one(spark, text.caption_head, "x" * 100) == "x" * 80
    assert one(spark, text.caption_head, None) == ""


def test_template_spells_missing_as_none(spark):
    row = spark.createDataFrame([("hi", None)], "a string, b string")
    a, b = F.col("a"), F.col("b")
    line = row.select(text.text_template(a, b, a, b, a, b, a)).first()[0]
    assert line == ("[CLS] [TITLE] hi [MUSIC] None by hi [CHALLENGES] None [OBJECTS] hi "
                    "[LOC] None hi")


@pytest.mark.parametrize("value,expected", [
    (999, "999"), (1000, "1K"), (2500, "2K"), (3500, "4K"), (1_250_000, "1.2M"), (0, "0"),
    (1_150_000, "1.1M"), (1_950_000, "1.9M"), (8_350_000, "8.3M"), (1_350_000, "1.4M"),
    (2_345_678_901, "2345.7M")])
def test_short_counts(spark, value, expected):
    assert one(spark, text.short_count, value, "bigint") == expected


def test_scores(spark):
    row = spark.createDataFrame([(9, 1, 2, 3, 4)], "p int, sh int, sa int, c int, l int")
    got = row.select(scores.engagement(*[F.col(x) for x in ("sh", "sa", "c", "l", "p")])).first()
    assert got[0] == (4 * 1 + 3 * 2 + 2 * 3 + 4) / 10


def test_velocity_age_floor_is_one_second(spark):
    import math
    rows = spark.createDataFrame(
        [(100, 7200), (100, 50), (100, None)], "a int, b int")
    got = [r[0] for r in rows.select(
        scores.view_velocity(F.lit(10), F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(math.log1p(10 / (7100 / 3600)))
    assert got[1] == got[2] == pytest.approx(math.log1p(36000))


def test_log_count_reads_dirt_as_zero(spark):
    for value in (None, float("nan"), -5.0, 0.0):
        assert one(spark, scores.log_count, value, "double") == 0.0


def test_untransform_inverts_targets(spark):
    assert one(spark, lambda c: scores.untransform(scores.log_count(c)), 3.5, "double") == \
        pytest.approx(3.5)


def test_feature_vector_defaults(spark):
    names = ("author_follower_count author_following_count author_total_heart_count "
             "author_video_count author_friend_count duration width height aspect_ratio vq_score "
             "user_verified is_private is_ad share_enabled stitch_enabled hour_of_day day_of_week"
             ).split()
    kinds = ["bigint"] * 8 + ["double"] * 2 + ["boolean"] * 5 + ["int"] * 2
    schema = "id bigint, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds))
    empty = spark.createDataFrame([(1, *[None] * 17)], schema)
    row = features.with_features(empty, "id").select(features.feature_vector().alias("v")).first()
    assert row.v == [0.0] * 8 + [1.0] + [0.0] * 6 + [0.0, 1.0, 0.0, 1.0]
    assert len(row.v) == 19
    with pytest.raises(ValueError):
        features.feature_vector(["f01"])


def test_frame_plan_matches_even_spacing(spark):
    for n in (1, 5, 16, 17, 300):
        got = one(spark, media.frame_positions, n, "int")
        assert got == [int(i * (n - 1) / 15.0) for i in range(16)]
        assert one(spark, media.middle_frame, n, "int") == n // 2


def test_crop_plan(spark):
    rows = spark.createDataFrame([(448, 224), (224, 224), (100, 200)], "w int, h int")
    got = [tuple(r.p) for r in rows.select(
        media.crop_plan(F.col("w"), F.col("h")).alias("p")).collect()]
    assert got == [(448, 224, 112, 0, False), (224, 224, 0, 0, True), (224, 448, 0, 112, False)]


@pytest.mark.parametrize("text,expected", [
    ("5 January 2024", "2024-01-05 00:00:00"), ("5th of Jan 2024 3pm", "2024-01-05 15:00:00"),
    ("Jan. 5, 2024, 12:07 AM", "2024-01-05 00:07:00"), ("january 5th 2024 12:07 p.m.", "2024-01-05 12:07:00"),
    ("Fri, 05 Jan 2024 10:20:30 GMT", "2024-01-05 10:20:30"), ("friday 5 sept 2024", "2024-09-05 00:00:00"),
    ("05-Jan-24 23:59:59.75", "2024-01-05 23:59:59"), ("5 jan 99", "1999-01-05 00:00:00"),
    ("20240105T102030Z", "2024-01-05 10:20:30"), ("20240105t1020+0200", "2024-01-05 08:20:00"),
    ("2024-1-5 1:02", "2024-01-05 01:02:00"), ("2024.01.05", "2024-01-05 00:00:00"),
    ("2024 Jan 05 10:20 UTC+02", "2024-01-05 08:20:00"), ("1/5/2024 7:08 pm", "2024-01-05 19:08:00"),
    ("25/12/2024", "2024-12-25 00:00:00"), ("12.25.2024 00:30 -0100", "2024-12-25 01:30:00"),
    ("  10:15   5 May   2024 ", None), ("29 February 2023", None), ("31/31/2024", None), ("January 2024", None),
    ("5 Janu 2024 25:00", None), ("5 jan 2024 13pm", None), ("5 Janx 2024", None), ("hello", None), ("", None),
    (None, None), ("may", None), ("5 may 2024 and more", None), ("12:30", None)])
def test_free_dates(spark, text, expected):
    got = one(spark, dates.parse_free_time, text)
    assert (None if got is None else str(got)) == expected


def test_day_first(spark):
    read = lambda c: dates.parse_free_time(c, day_first=True)
    assert str(one(spark, read, "1/5/2024")) == "2024-05-01 00:00:00"
    assert str(one(spark, read, "1/25/2024")) == "2024-01-25 00:00:00"
    assert str(one(spark, read, "2024-01-05")) == "2024-01-05 00:00:00"


def test_missing_times_are_not_parsed(spark):
    plan = spark.range(1).select(clean.parse_any_time(F.lit(None).cast("string")).alias("t"))
    assert plan.first()[0] is None
    assert "regexp" not in plan._jdf.queryExecution().optimizedPlan().toString().lower()
