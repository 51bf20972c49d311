"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import materialise, prepare, shared_dir  # noqa: F401
from ..sources.tables import table  # noqa: F401

#: What `[\x20\x09-\x0D]` matches.
BLANKS = " \t\n\x0b\x0c\r"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without_blanks(text: Column) -> Column:
    """The text without the characters of BLANKS; null becomes empty."""
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n: the split into folds that labels use."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(n)
