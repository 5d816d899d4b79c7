"""Decoding from packed archives: geometry, faults, bounded batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlift.functions import media
from postlift.sources import frames, packs


def video(n, h, w, seed=0):
    pixels = np.random.default_rng(seed).integers(0, 256, (n, h, w, 3), dtype=np.uint8)
    return pixels, b"RAWV" + w.to_bytes(2, "big") + h.to_bytes(2, "big") + n.to_bytes(4, "big") + pixels.tobytes()


@pytest.mark.parametrize("n,h,w", [(1, 1, 1), (3, 5, 4), (40, 9, 2)])
def test_frames_and_pixels_are_picked_by_plan(spark, n, h, w):
    pixels, data = video(n, h, w)
    plan = spark.range(1).select(media.frame_positions(F.lit(n)).alias("p")).first().p
    assert frames.positions(n, 16).tolist() == plan
    got = frames.decode_raw(data, 16, 4, 3)
    for k, at in enumerate(plan):
        for y in range(4):
            for x in range(3):
                assert (got[k, y, x] == pixels[at, y * h // 4, x * w // 3]).all()


@pytest.mark.parametrize("bad", [b"", b"RAWV", video(2, 2, 2)[1][:-1], video(2, 2, 2)[1] + b"x",
                                 b"RAWX" + video(2, 2, 2)[1][4:], video(0, 2, 2)[1], video(2, 0, 2)[1]])
def test_unsound_files_are_refused(bad):
    with pytest.raises(ValueError):
        frames.decode_raw(bad, 4, 2, 2)


def test_columns_make_raw_videos(spark):
    pixels, data = video(3, 4, 5)
    row = spark.createDataFrame([(bytearray(pixels.tobytes()),)], "b binary").select(
        frames.raw_video(F.lit(5), F.lit(4), F.lit(3), F.col("b")).alias("v")).first()
    assert bytes(row.v) == data


def test_posts_get_their_block_or_the_neutral_one(spark, tmp_path):
    good = {i: video(2 + i, 3, 3, i) for i in range(20)}
    listed = [("u", f"{i}.mp4", d) for i, (_, d) in good.items()]
    listed += [("a", "3.mp4", b"older"), ("u", "30.mp4", b"junk"), ("u", "31.mp4", b""), ("u", "x.mp4", b"?")]
    packs.write_packs(spark.createDataFrame(listed, "folder string, name string, content binary").repartition(4),
                      str(tmp_path), pack_bytes=2_000)
    ids = spark.createDataFrame([(i,) for i in [*good, 30, 31, 99, None, 5]], "id bigint")
    rows = frames.decode_posts(spark, ids, str(tmp_path), samples=3, height=2, width=2).collect()
    neutral = bytes(frames.NEUTRAL) * 12
    assert len(rows) == 25 and sum(r.id == 5 for r in rows) == 2
    for r in rows:
        if r.id in good:
            assert r.decoded and bytes(r.frames) == frames.decode_raw(good[r.id][1], 3, 2, 2).tobytes()
        else:
            assert not r.decoded and bytes(r.frames) == neutral
    shaped = frames.normalised(neutral, 3, 2, 2, (124 / 255, 116 / 255, 104 / 255), (1.0, 1.0, 1.0))
    assert shaped.shape == (3, 3, 2, 2) and np.abs(shaped).max() < 1e-6
    assert frames.decode_posts(spark, ids.limit(0), str(tmp_path)).count() == 0


def test_other_errors_of_a_decoder_fail_the_job(spark, tmp_path):
    packs.write_packs(spark.createDataFrame([("u", "1.mp4", b"x")], "folder string, name string, content binary"),
                      str(tmp_path))
    ids = spark.createDataFrame([(1,)], "id bigint")

    def faulty(data, samples, height, width):
        raise TypeError("a fault of the program")

    def short(data, samples, height, width):
        return np.zeros(3, np.uint8)

    with pytest.raises(Exception, match="a fault of the program"):
        frames.decode_posts(spark, ids, str(tmp_path), decoder=faulty).collect()
    assert [r.decoded for r in frames.decode_posts(spark, ids, str(tmp_path), decoder=short).collect()] == [False]


def test_batches_stay_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packs, "BATCH_BYTES", 100)
    packs.write_packs(spark.createDataFrame(
        [("u", f"{i}.mp4", video(2, 2, 2, i)[1]) for i in range(9)], "folder string, name string, content binary"), str(tmp_path))
    ids = spark.range(9)
    assert frames.decode_posts(spark, ids, str(tmp_path), samples=2, height=2, width=2).where("decoded").count() == 9
