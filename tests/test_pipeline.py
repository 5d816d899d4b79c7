import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from postlift.config import CONTRACT, REQUIRED
from postlift.operators import compose, splits
from postlift.session import materialize, scratch_path, scratch_root, scratch_scope
from postlift.sources import documents, published, sinks, tables
from postlift.streaming.incremental import compose_stream, read_shards


def paths(spark, *names):
    return spark.createDataFrame([(f"file:/data/{n}",) for n in names], "path string")


def test_gate_needs_all_three_files(spark):
    manifest = paths(spark, "u/user.json", "u/1.mp4", "u/1.json", "u/2.mp4", "u/3.json",
                     "v/4.mp4", "v/4.json", "u/x5.mp4", "u/5.json", "u/readme.txt")
    got = sorted(tuple(r) for r in compose.asset_gate(manifest).collect())
    assert got == [(1, "u"), (5, "u")]


def test_detected_labels_are_strict_distinct_sorted(spark):
    df = spark.createDataFrame([(1, "dog", 0.9), (1, "cat", 0.86), (1, "dog", 0.95),
                                (1, "cow", 0.85), (2, "cat", 0.1)],
                               "id bigint, label string, score double")
    assert [tuple(r) for r in compose.detected_labels(df).collect()] == [(1, "cat,dog")]


def composed(spark):
    base = spark.createDataFrame(
        [(1, 7, "anna", "1700000000", "1700003600", 10, 4, 2, 1, 3, "t", 15, 0.5, 0),
         (2, 7, "anna", "2023-11-14", "1700003600", 10, 4, 2, 1, 3, "f", 15, 0.5, 5),
         (3, 8, "bob", "1700000000", None, 10, 4, 2, 1, 3, "f", 15, 0.5, 5)],
        "id bigint, user_id bigint, username string, create_time string, stats_time string, "
        "play_count bigint, digg_count bigint, comment_count bigint, share_count bigint, "
        "save_count bigint, is_ad string, duration bigint, vq_score double, "
        "diversification_id bigint")
    assets = spark.createDataFrame([(1, "anna"), (2, "anna")], "id bigint, folder string")
    users = spark.createDataFrame(
        [("anna", 7, "anna_new", "true", 100, 1, 2, 3, 4, 1600000000)],
        "folder string, user_id bigint, unique_id string, is_verified string, "
        "author_follower_count bigint, author_following_count bigint, "
        "author_total_heart_count bigint, author_video_count bigint, author_friend_count bigint, "
        "account_create_time bigint")
    details = spark.createDataFrame([(1, 99, None, 300, 200)],
                                    "id bigint, view_count bigint, like_count bigint, "
                                    "width bigint, height bigint")
    objects = spark.createDataFrame([(1, "cat")], "id bigint, detected_objects string")
    return compose.compose(base, assets, users, details, objects)


def test_compose_fallbacks_and_types(spark):
    df = composed(spark)
    want = [(n, k) for n, k in CONTRACT if n != "video_bytes"] + [("has_media", "boolean")]
    assert df.dtypes == want
    rows = {r.id: r for r in df.collect()}
    assert set(rows) == {1, 2}
    one, two = rows[1], rows[2]
    assert (one.play_count, one.digg_count, one.username) == (99, 4, "anna_new")
    assert one.aspect_ratio == pytest.approx(1.5) and one.is_ad is True
    assert one.engagement_score == pytest.approx((4 * 1 + 3 * 3 + 2 * 2 + 4) / 100)
    assert (one.detected_objects, two.detected_objects) == ("cat", "")
    assert (one.diversification_id, two.diversification_id) == (None, 5)
    assert str(one.account_create_time) == "2020-09-13 12:26:40"
    # A date in words is a creation time, but gives no weekday or hour.
    assert two.create_time is not None and two.day_of_week is None and two.hour_of_day is None
    assert two.width is None


def test_numeric_zero_is_no_creation_time(spark):
    base = spark.createDataFrame([(1, 0, 5), (2, 1700000000, 5)], "id bigint, create_time bigint, play_count int")
    assets = spark.createDataFrame([(1, "a"), (2, "a")], "id bigint, folder string")
    users = spark.createDataFrame([("a", 1)], "folder string, user_id bigint")
    details = spark.createDataFrame([(1, 1)], "id bigint, width int")
    got = {r.id: r.hour_of_day for r in compose.compose(base, assets, users, details).collect()}
    assert got == {1: None, 2: 22}


def test_scratch_tables_go_when_the_scope_ends(spark):
    with scratch_scope(spark):
        kept = materialize(spark.range(3), "gone")
        path = os.path.dirname(kept.inputFiles()[0])
        assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_required_gate_and_media(spark):
    df = composed(spark)
    kept = compose.required_gate(df)
    assert [r.id for r in kept.collect()] == [1]
    media = spark.createDataFrame([(1, bytearray(b"xyz"))], "id bigint, video_bytes binary")
    assert compose.attach_media(kept, media).first().video_bytes == b"xyz"
    assert len(REQUIRED) == 20 and len(CONTRACT) == 57


def test_gate_keeps_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (None,)], "v double")
    assert compose.required_gate(df, ["v"]).count() == 1


def test_contract_rejects_name_the_column(spark):
    df = spark.createDataFrame([(1, "5"), (2, "x"), (3, None)], "id bigint, duration string")
    typed, rejects = compose.enforce_contract(df)
    assert typed.columns == [n for n, _ in CONTRACT] and typed.count() == 2
    assert [(r.id, r.violations) for r in rejects.collect()] == [(2, ["duration"])]


def test_dedupe_policies_and_incremental(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 5, "c")], "id int, at int, v string")
    assert sorted(tuple(r) for r in compose.first_per_key(df, "id", "at").collect()) == [
        (1, 1, "a"), (2, 5, "c")]
    assert compose.not_yet_written(df, df.where("id = 1")).count() == 1


def test_profile_island_paths_and_gaps(spark):
    state = {"__DEFAULT_SCOPE__": {"webapp.user-detail": {"userInfo": {
        "user": {"id": "12", "uniqueId": "anna", "verified": True, "createTime": 5},
        "stats": {"followerCount": 3, "heartCount": 4, "videoCount": 5}}}}}
    tag = f'<script id="{documents.ISLAND_ID}" type="application/json">'
    pages = spark.createDataFrame([
        (1, f"<html><script>x</script>{tag}{json.dumps(state)}</script></html>"),
        (2, f"{tag}{{}}</script>"), (3, f"{tag}broken</script>"), (4, "<html></html>")],
        "id int, html string")
    got = {r.id: tuple(r)[1:] for r in documents.project_profiles(pages, "html", "id").collect()}
    assert got[1] == (12, "anna", True, 5, None, 3, 4, 5)
    assert got[2] == got[3] == got[4] == (None,) * 8


def test_payload_last_format_and_missing_user(spark):
    payloads = [
        (1, {"uploader": "a", "view_count": 5, "formats": [{"width": 1}, {"width": 2}]}),
        (2, {"uploader": "b", "formats": []}), (3, {"uploader": "c"}), (4, {"view_count": 1}),
        (5, {"uploader": ""})]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in payloads], "id int, p string")
    got = {r.id: (r.username, r.view_count, r.width) for r in
           documents.project_payloads(df, "p", "id").collect()}
    assert got == {1: ("a", 5, 2), 2: ("b", None, None), 3: ("c", None, None)}


def test_sidecar_files_and_media_bytes(spark, tmp_path):
    folder = tmp_path / "assets" / "anna"
    folder.mkdir(parents=True)
    (folder / "user.json").write_text(json.dumps({"user_id": 7}, indent=4))
    (folder / "12.json").write_text(json.dumps({"user_id": 8, "other": 1}, indent=4))
    (folder / "12.mp4").write_bytes(b"movie")
    root = str(tmp_path / "assets")
    docs = tables.read_sidecars(spark, f"{root}/*/*.json", "user_id bigint")
    assert sorted((r.user_id, r.folder, r.file_name) for r in docs.collect()) == [
        (7, "anna", "user.json"), (8, "anna", "12.json")]
    media = tables.read_media(spark, root).collect()
    assert [(r.id, bytes(r.video_bytes)) for r in media] == [(12, b"movie")]
    assert [tuple(r) for r in compose.asset_gate(tables.list_assets(spark, root)).collect()] == [
        (12, "anna")]


def test_sidecar_writer_skips_empty_records(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ("b", None, None)], "username string, x int, y int")
    sinks.write_sidecars(df, str(tmp_path / "out"))
    assert [r.username for r in spark.read.json(str(tmp_path / "out")).collect()] == ["a"]


def test_csv_and_label_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01", "x, y"), (2, "2024-02", None)],
                               "id bigint, cohort_month string, t string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    back = tables.read_csv(spark, str(tmp_path / "csv"), df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    sinks.write_label_table(df, str(tmp_path / "labels"), by_cohort=True)
    read = published.read_published(spark, str(tmp_path / "labels")).where("cohort_month = '2024-01'")
    assert [r.id for r in read.collect()] == [1]


def test_shards_hold_at_most_the_given_rows(spark, tmp_path):
    sinks.write_shards(spark.range(95), str(tmp_path / "s"), rows=10)
    files = published.read_published(spark, str(tmp_path / "s")).groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in files) <= 10 and sum(r["count"] for r in files) == 95


def test_skip_take_and_resume(spark):
    df = spark.range(100).repartition(5)
    assert sorted(r.id for r in tables.skip_rows(df, "id", 97).collect()) == [97, 98, 99]
    assert tables.skip_rows(df, "id", 100).count() == 0
    assert tables.skip_rows(df, "id", 0).count() == 100
    assert [r.id for r in tables.take_first(df, "id", 3).collect()] == [0, 1, 2]
    assert tables.resume_after(df, "id", 96).count() == 3


def test_take_beyond_the_heap_uses_a_key_edge(spark, monkeypatch):
    monkeypatch.setattr(tables, "_HEAP_ROWS", 2)
    df = spark.range(50).repartition(3)
    assert sorted(r.id for r in tables.take_first(df, "id", 7).collect()) == list(range(7))
    assert tables.take_first(df, "id", 80).count() == 50


@pytest.mark.parametrize("most", [2, 100])
def test_take_first_with_ties_and_nulls(spark, monkeypatch, most):
    monkeypatch.setattr(tables, "_HEAP_ROWS", most)
    df = spark.createDataFrame([(i // 10 if i >= 3 else None, i) for i in range(40)], "id int, place int")
    rows = tables.take_first(df.repartition(4), "id", 15).collect()
    assert sorted(-1 if r.id is None else r.id for r in rows) == [-1] * 3 + [0] * 7 + [1] * 5
    assert len({r.place for r in rows}) == 15 and rows[0].asDict().keys() == {"id", "place"}


def test_samples_do_not_depend_on_partitions(spark):
    a = {r.id for r in splits.sample_rows(spark.range(500), 20).collect()}
    b = {r.id for r in splits.sample_rows(spark.range(500).repartition(9), 20).collect()}
    assert a == b and len(a) == 20
    assert splits.random_row(spark.range(500)).count() == 1


def test_scratch_folder_is_shared_setting_or_local(spark):
    assert scratch_root(spark) == scratch_root(spark)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    df = materialize(spark.range(3).withColumn("v", F.lit("a")))
    assert df.count() == 3 and "parquet" in df.inputFiles()[0]


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "id bigint, v bigint"
    side = spark.createDataFrame([(i, i * 10) for i in range(0, 40, 2)], "id bigint, w bigint")

    def transform(df):
        return df.join(side, "id").withColumn("s", F.col("v") + F.col("w"))

    def arrive(low, high):
        (spark.range(low, high).select("id", (F.col("id") + 1).alias("v"))
         .repartition(2).write.mode("append").parquet(source))

    def run():
        compose_stream(spark, source, schema, transform, sink, state, files_per_trigger=1)

    arrive(0, 20)
    run()
    first = read_shards(spark, sink).count()
    arrive(20, 40)
    run()
    run()  # nothing new: no file is taken twice
    batch = sorted(map(tuple, transform(spark.read.schema(schema).parquet(source)).collect()))
    assert first == 10
    assert sorted(tuple(r) for r in read_shards(spark, sink).select("id", "v", "w", "s").collect()
                  ) == batch


def test_stream_leaves_out_what_was_delivered_before(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def deliver(rows):
        (spark.createDataFrame(rows, "id bigint, at timestamp").repartition(2)
         .write.mode("append").parquet(source))
        compose_stream(spark, source, "id bigint, at timestamp", lambda b: b, sink, state, key="id")
        return sorted(-1 if r.id is None else r.id for r in read_shards(spark, sink).collect())

    at = datetime.datetime(2024, 1, 1)
    assert deliver([(1, at), (2, at), (2, at), (None, at)]) == [-1, 1, 2]
    assert deliver([(2, at), (3, at)]) == [-1, 1, 2, 3]
    assert deliver([(1, at), (None, at), (3, at)]) == [-1, 1, 2, 3]
    compose_stream(spark, source, "id bigint, at timestamp", lambda b: b, sink, state, key="id")
    assert read_shards(spark, sink).count() == 4


def test_rows_are_counted_while_they_are_written(spark, tmp_path):
    """Counts come from the run itself, and models still fit and score in the session afterwards."""
    from postlift.operators import reshape, training
    path, reads = str(tmp_path / "kept"), []

    def build(session):
        reads.append(session)
        return session.range(100).withColumn("v", F.when(F.col("id") % 7 != 0, F.col("id") % 3))

    gates = {"present": F.col("v").isNotNull(), "large": F.col("v") > 0}
    found = reshape.count_passing(spark, build, gates, lambda kept: kept.write.parquet(path))
    assert {r.stage: r.n_rows for r in found.collect()} == {"read": 100, "present": 85, "large": 56, "dropped": 44}
    assert spark.read.parquet(path).count() == 56 and len(reads) == 1 and reads[0] is not spark
    assert sorted(map(tuple, reshape.drop_accounting(build(spark), gates).collect())) == sorted(map(tuple, found.collect()))
    rows = spark.range(60).select((F.col("id") % 5).cast("double").alias("a"), (F.col("id") % 2).alias("y"))
    model = training.train_weighted(rows, ["a"], "y", maxIter=3)
    assert model.transform(training.assemble(rows, ["a"])).select("probability").count() == 60
    assert len(model.transform(training.assemble(rows, ["a"])).select("probability").collect()) == 60
    none = reshape.count_passing(spark, lambda s: build(s).limit(0), gates, lambda kept: kept.write.parquet(path + "0"))
    assert [r.n_rows for r in none.collect()] == [0, 0, 0, 0]


def test_streams_report_what_arrived(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.range(40).coalesce(1).write.parquet(source)
    told = compose_stream(spark, source, "id bigint", lambda b: b, sink, state,
                          counts={"even": F.count(F.when(F.col("id") % 2 == 0, 1)), "most": F.max("id")})
    assert [(t["read"], t["even"], t["most"]) for t in told if t["read"]] == [(40, 20, 39)]


def test_seen_set_within_a_watermark_forgets(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def deliver(*rows):
        (spark.createDataFrame([(i, datetime.datetime(2024, 1, 1, h)) for i, h in rows], "id bigint, at timestamp")
         .coalesce(1).write.mode("append").parquet(source))
        compose_stream(spark, source, "id bigint, at timestamp", lambda b: b, sink, state, key="id",
                       event_time="at", delay="2 hours")
        return sorted(r.id for r in read_shards(spark, sink).collect())

    assert deliver((1, 1), (1, 2)) == [1]
    assert deliver((1, 2), (2, 20)) == [1, 2]
    assert deliver((1, 21), (2, 21)) == [1, 1, 2]


def test_a_retried_batch_adds_nothing(spark, tmp_path, monkeypatch):
    """A batch that fails after it was published is run again and finds its token."""
    from postlift.streaming import incremental
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.range(10).write.parquet(source)
    whole = incremental.publish

    def late_failure(*args, **options):
        whole(*args, **options)
        raise OSError("lost after publishing")

    monkeypatch.setattr(incremental, "publish", late_failure)
    with pytest.raises(Exception):
        compose_stream(spark, source, "id bigint", lambda b: b, sink, state)
    monkeypatch.setattr(incremental, "publish", whole)
    compose_stream(spark, source, "id bigint", lambda b: b, sink, state)
    assert sorted(r.id for r in read_shards(spark, sink).collect()) == list(range(10))


def test_published_tables_change_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        published.read_published(spark, path)
    sinks.write_shards(spark.range(20), path, rows=4)
    before = published.read_published(spark, path)

    # Half of the tasks have written when one fails.
    bad = spark.range(100, 140, 1, 4).withColumn("x", F.when(F.col("id") == 139, F.raise_error(F.lit("killed")))
                                                 .otherwise(F.lit(1)))
    with pytest.raises(Exception):
        sinks.write_shards(bad, path)
    assert sorted(r.id for r in published.read_published(spark, path).collect()) == list(range(20))

    for _ in range(2):
        published.publish(spark.range(20, 30), path, append=True, token="run-1")
    assert published.read_published(spark, path).count() == 30
    for _ in range(2):
        sinks.write_shards(spark.range(3), path, token="run-2")
    assert published.read_published(spark, path).count() == 3
    # A frame read earlier keeps its state until the unlisted files go.
    assert before.count() == 20
    assert published.drop_unlisted(spark, path) >= 2
    assert published.read_published(spark, path).count() == 3


def test_writers_that_meet(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    published.publish(spark.range(1), path)
    latest = published.DocumentLog.latest
    stale = latest(published._manifest(spark, path))
    published.publish(spark.range(1), path, append=True)
    answers = iter([stale])
    monkeypatch.setattr(published.DocumentLog, "latest", lambda self: next(answers, None) or latest(self))
    published.publish(spark.range(1), path, append=True)
    assert published.read_published(spark, path).count() == 3
    answers = iter([stale])
    with pytest.raises(published.Conflict):
        published.publish(spark.range(9), path)
    assert published.read_published(spark, path).count() == 3


@pytest.mark.parametrize("after,left", [(None, 100), (-5, 100), (41, 58), (99, 0), (500, 0)])
def test_ranges_before_the_mark_are_not_opened(spark, tmp_path, after, left):
    path = str(tmp_path / "r")
    published.write_ranges(spark.range(100).withColumn("v", F.col("id") % 3).repartition(5), path, "id", 10)
    rest = published.read_after(spark, path, after)
    assert rest.count() == left and rest.columns == ["id", "v"]
    opened = len(rest.inputFiles()) if left else 0
    assert opened <= left / 10 + 2
    if after == 41:
        plan = rest._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [IsNotNull(id), GreaterThan(id,41)]" in plan and "_range=0" not in str(rest.inputFiles())


def test_marks_only_go_forward(spark, tmp_path):
    path = str(tmp_path / "r")
    published.write_ranges(spark.createDataFrame([("b",), ("a",)], "k string"), path, "k", 2)
    assert published.load_mark(spark, path, "me") is None
    for key in ("a", "b", "a"):
        published.save_mark(spark, path, "me", key)
    assert published.load_mark(spark, path, "me") == "b" and published.load_mark(spark, path, "you") is None
    assert published.read_after(spark, path, "a").collect()[0].k == "b"
    published.write_ranges(spark.createDataFrame([], "k string"), path, "k", 2)
    assert published.read_after(spark, path, "a").count() == 0


def test_cluster_without_shared_folder_is_refused():
    class Context:
        master, applicationId = "yarn", "app"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return self.folder if key == "spark.checkpoint.dir" else default

        folder = None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        scratch_root(Session())
    Session.conf.folder = "hdfs:///shared/"
    assert scratch_root(Session()) == "hdfs:///shared"


def test_arriving_files_follow_the_rows(spark, monkeypatch):
    """Two triggers of one half of the files each, however many rows arrive."""
    from postlift.plans import clean_queries
    from postlift.streaming import incremental

    class Seen(Exception):
        pass

    def stop(session, source, schema, transform, sink, state, files_per_trigger):
        raise Seen(len(session.read.schema(schema).parquet(source).inputFiles()), files_per_trigger)

    monkeypatch.setattr(incremental, "compose_stream", stop)
    for most, half in ((1 << 18, 4), (100, 8)):
        monkeypatch.setattr(clean_queries, "_ARRIVING", most)
        with pytest.raises(Seen) as found:
            clean_queries.stream_compose(spark, "/root/testdata/sf0.001")
        assert found.value.args == (2 * half, half)


def test_gate_casts_numbers_only(spark):
    """Names that are no plain number make no post; a creator's file is never cast."""
    names = ["1.mp4", "1.json", "2.mp4", "02.json", "+3.json", "3.mp4", "-4.json", "x-4.mp4", "5.mp4", "5.info.json",
             "user.json", "99999999999999999999.json"]
    paths = spark.createDataFrame([(f"assets/a/{n}",) for n in names], "path string")
    assert [tuple(r) for r in compose.asset_gate(paths).collect()] == [(1, "a")]


def test_labels_are_gathered_in_one_shuffle(spark):
    rows = spark.createDataFrame([(1, "b", 0.9), (1, "a", 0.95), (1, "b", 0.99), (2, "c", 0.1), (3, "d", 0.9)],
                                 "id bigint, label string, score double")
    found = compose.detected_labels(rows)
    assert sorted(map(tuple, found.collect())) == [(1, "a,b"), (3, "d")]
    assert found._jdf.queryExecution().sparkPlan().toString().count("Aggregate") == 2
