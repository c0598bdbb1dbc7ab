"""Token counts: batch encoding in an Arrow function that returns lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder

LIMIT = 1024


def token_count(tokenizer: str):
    """Column function: text to its number of tokens, without special tokens; 0 for null.

    Blocks are balanced by bytes and long texts are cut at safe boundaries (see ``tokens.py``).
    """

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(tokenizer)
        for texts in batches:
            got = [c for _, c, _ in enc.blocks(texts, False)]
            yield pa.array(np.concatenate(got) if got else [], pa.int64())

    return count


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    Null texts count as empty (0 bytes, 0 tokens); long texts count whole; repeated rows and null doc_ids
    stay; other columns are ignored; an empty table gives an empty one.
    """
    return docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        token_count(tokenizer)(F.col("text")).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
