"""Questions about keys, asked by chunks of documents and answered by blocks of keys.

Documents are dealt into chunks.  A chunk sends every block of the key space the
distinct keys it holds (packed, one row per chunk and block), the block answers in the
same order, and the chunk meets its texts again with the answers.  A key that many
documents hold is sent once per chunk, so the hottest key costs a block no more than
one entry per chunk, and no row per key ever passes through Spark.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .textops import whole_texts

#: Text bytes of a chunk, and the least numbers of chunks and blocks.
CHUNK_BYTES, LEAST_CHUNKS, LEAST_BLOCKS = 9 << 20, 64, 96


def into_chunks(docs: DataFrame, *extra: str, chunk_bytes: int = CHUNK_BYTES
                ) -> tuple[DataFrame, int]:
    """Whole texts with a ``chunk`` number, even however ids or texts repeat; how many chunks.

    The number of chunks follows the bytes of all texts.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(LEAST_CHUNKS, math.ceil(total / chunk_bytes))
    number = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")
    return whole_texts(docs, *extra).withColumn("chunk", number), chunks


class KeySpace:
    """64-bit keys cut into equal blocks; within a block 32 bits tell keys apart.

    Blocks grow in number with the data, and so does the resolution.  Two keys that
    share a short form are taken as one, which the callers allow for.
    """

    def __init__(self, chunks: int):
        self.blocks = max(LEAST_BLOCKS, chunks)
        self.step = (1 << 64) // self.blocks + 1
        self.shift = max(0, self.step.bit_length() - 32)

    def short(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block, 32-bit key) of every key."""
        block = keys // np.uint64(self.step)
        return block.astype(np.int32), (
            (keys - block * np.uint64(self.step)) >> np.uint64(self.shift)).astype(np.uint32)

    def joint(self, keys: np.ndarray) -> np.ndarray:
        """Block and short key in one number that rises with the key."""
        block, short = self.short(keys)
        return (block.astype(np.uint64) << np.uint64(32)) | short

    def bounds(self, joint: np.ndarray) -> np.ndarray:
        """Offsets of the blocks in sorted joint numbers."""
        return np.searchsorted(joint, np.arange(self.blocks + 1, dtype=np.uint64) << np.uint64(32))


def packed(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()
