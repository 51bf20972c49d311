"""Bounded samples of labelled rows, the only rows that ever reach the driver for a fit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Hashes that a rate is measured against.
SPAN = 1 << 30


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, max_chars: int, id_col: str = "doc_id", text_col: str = "text", max_classes: int = 256, total_chars: int = 64_000_000) -> list[tuple[str, object]]:
    """At most `per_class` (text, label) of each class, chosen by a hash of the id among whole texts of at most `max_chars` characters.

    `labels` has (doc_id, label), the label one of at most `max_classes` values; rows with a
    null are left out, of repeated ids the largest label and the longest text count. A class
    gets texts up to its even share of `total_chars` characters, and one text at least, so
    all that is collected is bounded by these parameters: counts of classes, ids and lengths
    (about 1.3 x per_class of each class) and the texts of those chosen.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "label").where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    mine = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull() & (F.length("text") <= max_chars))
    lengths = mine.groupBy("doc_id").agg(F.max(F.length("text")).alias("chars"))
    eligible = materialise(known.join(lengths, "doc_id"), "labelled")
    counts = eligible.groupBy("label").count().orderBy(F.desc("count"), "label").limit(max_classes + 1).collect()
    if len(counts) > max_classes:
        raise ValueError(f"more than {max_classes} classes")
    if not counts:
        return []
    spark = docs.sparkSession
    rates = spark.createDataFrame([(r["label"], int(SPAN * min(1.0, (1.3 * per_class + 20) / r["count"]))) for r in counts], f"label {known.schema['label'].dataType.simpleString()}, below long")
    place = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(SPAN))
    chosen = eligible.join(F.broadcast(rates), "label").where(place < F.col("below")).select("doc_id", "label", "chars", place.alias("place")).collect()
    ids, taken = [], {}
    for r in sorted(chosen, key=lambda r: (r["place"], r["doc_id"])):
        n, chars = taken.get(r["label"], (0, 0))
        if n < per_class and (n == 0 or chars + r["chars"] <= total_chars // len(counts)):
            taken[r["label"]] = n + 1, chars + r["chars"]
            ids.append((r["doc_id"], r["label"], r["chars"]))
    wanted = spark.createDataFrame(ids, eligible.select("doc_id", "label", "chars").schema)
    rows = mine.join(F.broadcast(wanted), (mine["doc_id"] == wanted["doc_id"]) & (F.length(mine["text"]) == wanted["chars"])).groupBy(mine["doc_id"].alias("doc_id"), "label").agg(F.max("text").alias("text"))
    return [(r["text"], r["label"]) for r in sorted(rows.collect(), key=lambda r: r["doc_id"])]
