"""Intake: what a message is before anything is looked for in it."""

from pyspark.sql import functions as F

from mailsift.data import lists
from mailsift.functions.columns import collapse_spaces, let
from mailsift.functions.regex import WS


def prepare(messages, limit=None):
    """``messages(msg_id, raw, ...)`` -> adds text, characters, truncated, is_empty.

    ``truncated`` marks texts above the size that the rules were written for. They are read whole
    unless a ``limit`` of characters is given.
    """
    raw = F.coalesce(F.col("raw"), F.lit(""))
    characters = F.length(raw)
    return messages.select(
        *[c for c in messages.columns if c != "raw"],
        (F.substring(raw, 1, limit) if limit else raw).alias("text"),
        characters.cast("bigint").alias("characters"),
        (characters > lists.MAX_CHARACTERS).alias("truncated"),
        (~raw.rlike(rf"[^{WS}]")).alias("is_empty"))


def with_words(df):
    """Adds the number of words in the body."""
    return df.withColumn("words", let(collapse_spaces(F.col("body")), lambda t: F.when(t == "", 0).otherwise(
        F.length(t) - F.length(F.replace(t, F.lit(" "))) + 1)).cast("bigint"))
