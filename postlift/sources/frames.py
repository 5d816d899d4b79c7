"""Media decoded to blocks of sampled frames, straight from packed archives.

A block is ``samples`` frames of height x width x 3 bytes.  Bytes are fetched by offset and decoded
in the task that fetched them, a few megabytes at a time: neither media nor blocks ever stand
whole in a batch.

The decoder is pluggable.  The one here reads raw videos, a format without compression, so that
frames are picked by position: "RAWV", width and height (unsigned 16 bits), number of
frames (unsigned 32 bits), all big-endian, and the frames' pixels row by row, three bytes each.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import SETTINGS
from . import packs

# The code travels with the plan, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_MAGIC, _HEAD = b"RAWV", ">4sHHI"

#: The colour that stands in for what cannot be decoded (fixed values: the usual image mean of 255).
NEUTRAL = (124, 116, 104)

#: Errors that say a file is unreadable; others are faults of the program and fail the job.
UNREADABLE = (ValueError, LookupError, OSError, EOFError)


def raw_video(width: Column, height: Column, frames: Column, pixels: Column) -> Column:
    """The bytes of a raw video from its geometry and pixels."""
    def number(value: Column, digits: int) -> Column:
        return F.unhex(F.lpad(F.hex(value.cast("long")), digits, "0"))

    return F.concat(F.lit(bytearray(_MAGIC)), number(width, 4), number(height, 4), number(frames, 8), pixels)


def positions(n_frames: int, samples: int) -> np.ndarray:
    """Evenly spaced, truncated positions over 0..n-1, as ``functions.media.frame_positions`` has them."""
    return np.floor(np.arange(samples) * (n_frames - 1) / max(samples - 1, 1)).astype(np.int64)


def decode_raw(data: bytes, samples: int, height: int, width: int) -> np.ndarray:
    """Sampled frames of a raw video, each scaled to height x width by the nearest pixel above and left.

    Raises ValueError where the header, the size or the number of frames is not sound.
    """
    size = struct.calcsize(_HEAD)
    if len(data) < size:
        raise ValueError("shorter than a header")
    magic, w, h, n = struct.unpack_from(_HEAD, data)
    if magic != _MAGIC or not (w and h and n) or len(data) != size + n * h * w * 3:
        raise ValueError("not a whole raw video")
    frames = np.frombuffer(data, np.uint8, offset=size).reshape(n, h, w, 3)
    rows, columns = np.arange(height) * h // height, np.arange(width) * w // width
    return frames[positions(n, samples)][:, rows][:, :, columns]


def decode_members(rows: DataFrame, keep: list[str], decoder: Callable[[bytes, int, int, int], np.ndarray] = decode_raw,
                   samples: int = SETTINGS.num_frames, height: int = SETTINGS.target_height,
                   width: int = SETTINGS.target_width) -> DataFrame:
    """``keep`` columns, ``frames`` (the block's bytes) and ``decoded`` of inventory rows.

    Rows without archive, offset or length, members of missing or cut archives, and files that the decoder
    refuses (``UNREADABLE``) have the neutral block and ``decoded`` false.  Rows are dealt by
    archive and offset; a batch leaves once it holds ``packs.BATCH_BYTES``.
    """
    neutral = np.tile(np.array(NEUTRAL, np.uint8), samples * height * width).tobytes()
    most = max(1, packs.BATCH_BYTES // len(neutral))

    def block(content: bytes | None) -> bytes | None:
        if content is None:
            return None
        try:
            found = np.ascontiguousarray(decoder(content, samples, height, width), np.uint8)
        except UNREADABLE:
            return None
        return found.tobytes() if found.size == len(neutral) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, blocks = [], []
            for number, content in packs.contents(batch):
                numbers.append(number)
                blocks.append(block(content))
                if len(numbers) == most:
                    yield out_of(batch, numbers, blocks)
                    numbers, blocks = [], []
            if numbers:
                yield out_of(batch, numbers, blocks)

    def out_of(batch: pa.RecordBatch, numbers: list[int], blocks: list) -> pa.RecordBatch:
        taken = batch.take(pa.array(numbers, pa.int64()))
        return pa.RecordBatch.from_arrays(
            [*(taken.column(c) for c in keep), pa.array([neutral if b is None else b for b in blocks], pa.binary()),
             pa.array([b is not None for b in blocks])], names=[*keep, "frames", "decoded"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", frames binary, decoded boolean"
    return packs.dealt(rows, keep).mapInArrow(run, schema)


def decode_posts(spark: SparkSession, posts: DataFrame, path: str, **options) -> DataFrame:
    """(id, frames, decoded) of every post, from the packed file <id>.mp4; a post without one gets the neutral block.

    Ids and inventory rows meet; bytes do not.  Of several files of one post the greatest folder's is taken.
    """
    media = (packs.inventory(spark, path).withColumn("id", packs.media_id("name")).where("id is not null")
             .groupBy("id").agg(F.max_by(F.struct("archive", "offset", "length"), F.struct("folder", "archive", "offset"))
                                .alias("_m")))
    wanted = posts.select("id").join(media, "id", "left").select("id", "_m.*")
    return decode_members(wanted, ["id"], **options)


def normalised(block: bytes, samples: int, height: int, width: int, mean: tuple[float, ...],
               std: tuple[float, ...]) -> np.ndarray:
    """A block as model input: samples x 3 x height x width, (x / 255 - mean) / std."""
    pixels = np.frombuffer(block, np.uint8).reshape(samples, height, width, 3).astype(np.float32) / 255
    return ((pixels - np.float32(mean)) / np.float32(std)).transpose(0, 3, 1, 2)
