"""Fixed-width token windows over a frequency-ranked vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import SETTINGS
from .ranking import global_rank

# Ids below the first vocabulary word.
PAD, UNKNOWN, FIRST_WORD = 0, 1, 2
# Most frequent words that are sent to every task.
HEAVY = 1_000


def split_words(text: Column, first: int | None = None) -> Column:
    """Words between blanks, or only the ``first`` ones; null for blank text."""
    trimmed = F.btrim(text, F.lit(" \t\n\r"))
    # With a limit the rest of the text stays unsplit behind the last wanted word.
    words = F.split(trimmed, r"[ \t\n\r]+", -1 if first is None else first + 1)
    return F.when(trimmed != "", words if first is None else F.slice(words, 1, first))


def vocabulary(docs: DataFrame, text: str) -> DataFrame:
    """(token, token_id) of all words, the most frequent first (ties by the word).

    Words are counted with map-side combine and ranked on many tasks.
    """
    words = docs.select(F.explode(split_words(F.col(text))).alias("token"))
    counted = words.groupBy("token").agg((-F.count("*")).alias("_rare"))
    return global_rank(counted, ["_rare", "token"]).select(
        "token", (F.col("rank") + FIRST_WORD).alias("token_id"))


def token_windows(docs: DataFrame, key: str, text: str, vocab: DataFrame,
                  width: int = SETTINGS.max_text_len) -> DataFrame:
    """``input_ids`` and ``attention_mask`` of exactly ``width`` entries per text.

    Cutting to ``width`` tokens is the operator's contract, so later words are not
    even split off; a text's list is never longer than that.
    """
    words = docs.select(key, F.posexplode_outer(split_words(F.col(text), width))
                        .alias("pos", "token"))
    # The heaviest words would be hot keys: they are a fixed number of rows and travel to
    # the texts.  The rest meets the vocabulary in a join of its own.
    heavy = vocab.where(F.col("token_id") < HEAVY + FIRST_WORD).withColumnRenamed("token_id", "_own")
    tried = words.join(F.broadcast(heavy), "token", "left")
    known = tried.where("_own is not null or token is null").select(
        key, "pos", F.col("_own").alias("token_id"))
    rest = tried.where("_own is null and token is not null").drop("_own").join(
        vocab.where(F.col("token_id") >= HEAVY + FIRST_WORD), "token", "left").select(
        key, "pos", F.coalesce("token_id", F.lit(UNKNOWN)).alias("token_id"))
    coded = known.unionByName(rest)
    lists = coded.groupBy(key).agg(F.array_sort(F.collect_list(
        F.when(F.col("pos").isNotNull(), F.struct("pos", "token_id")))).alias("_t"))
    ids = F.transform("_t", lambda t: t["token_id"])
    n = F.size("_t")
    return lists.select(
        key, n.alias("n_tokens"),
        F.concat(ids, F.array_repeat(F.lit(PAD), F.lit(width) - n)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), n),
                 F.array_repeat(F.lit(0), F.lit(width) - n)).alias("attention_mask"))
