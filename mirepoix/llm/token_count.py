"""Token counts of whole texts by a compiled finite-state tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirepoix.llm.bpe import counter
from mirepoix.llm.common import map_texts


def token_counts(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024
) -> DataFrame:
    """``(id_col, n_bytes, n_tokens, over_limit)``, one row a document.

    Counts are those of the tokenizers library for the byte-level BPE file at ``tokenizer_path`` (a path on
    every executor), without added tokens; the file's special strings count one each. Null and empty texts
    have 0 bytes and tokens. Repeated rows come out repeatedly, other columns are ignored, an empty table
    gives an empty result.
    """

    def rows(texts: list) -> Iterator[tuple]:
        counted = counter(tokenizer_path)
        return ((counted.count(text),) for text in texts)

    source = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("n_bytes"),
    )
    return map_texts(source, "text", ["id", "n_bytes"], rows, "n_tokens bigint").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
