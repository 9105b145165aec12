"""What the operators of this subpackage share.

Rows are told apart by ``(doc_id, text_key)`` with ``text_key = xxhash64(text)``:
rows that repeat both are the same document and get equal results; rows that
share only the id are documents of their own.  A null text counts as empty.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored  # noqa: F401

#: White space of the word rules; any other code point belongs to a word.
BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """``doc_id, text_key, text`` with null texts made empty, and ``more``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text"), *more)


def same_doc(left: DataFrame, right: DataFrame) -> Column:
    """Null ids are equal to each other."""
    return (left["text_key"] == right["text_key"]) & left["doc_id"].eqNullSafe(right["doc_id"])


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order; none for null."""
    parts = F.split(F.coalesce(text, F.lit("")), BLANKS)
    return F.filter(parts, lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small_enough(df: DataFrame, max_rows: int, max_bytes: int = 64 << 20) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows and ``max_bytes`` of strings and lists; looks at no more rows than that."""
    wide = [c for c, t in df.dtypes if t in ("string", "binary")]
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in wide), F.lit(0).cast("long"))
    size = sum((F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) for c, t in df.dtypes if t.startswith(("array", "map", "struct"))), size)
    row = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("size")).first()
    return row["n"] <= max_rows and row["size"] <= max_bytes


def hinted(df: DataFrame, max_rows: int = 500_000) -> DataFrame:
    """``df`` with a broadcast hint if it is small enough; ``df`` should be cheap to read twice."""
    return F.broadcast(df) if small_enough(df, max_rows) else df


def env_path(name: str) -> str:
    """Place of a public tokenizer file; the folder may be set by CASELOOM_TOKENIZERS."""
    folder = os.environ.get("CASELOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
