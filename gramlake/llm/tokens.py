"""Token counts of whole texts by the whole-token shortcut."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gramlake.llm.bpe import encoder, prove
from gramlake.llm.common import map_texts, read


def count_tokens(df: DataFrame, path: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",), limit: int = 512) -> DataFrame:
    """``carry``, n_bytes, n_tokens and over_limit (n_tokens > limit) for every row of ``df``.

    One pass, no shuffle. The proven table (at most the vocabulary's size) is broadcast; pre-tokens in it
    count as one without any merging, the rest are merged by the library's model, once for each worker's
    table. Null and empty texts have 0 bytes and 0 tokens; special strings inside a text are single
    tokens, as the library treats them by default. Repeated rows are counted each; other columns,
    whatever their names, are not read.
    """
    proven = df.sparkSession.sparkContext.broadcast(prove(df.sparkSession, path))

    def work():
        own = encoder(proven.value)

        def run(data, offsets):
            n = own.counts(data, offsets)
            return pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)

        return run

    return map_texts(df, work, "n_bytes long, n_tokens long, over_limit boolean", text, carry)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op3_token_counts": op3_token_counts}
