"""Checks of translations: glossary, copies, repetition, overlaps, pairing, checkpoints, placeholders.

A conversation is a job; its turns are units, user turns sources and assistant turns
targets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.repeats import codes_of, repeats_before, shares_run, winnowed
from ..registry import query
from ..sources.shared import materialise, prepare
from ..sources.tables import table

#: Terms of the glossary that the checks below use, with their variants.
GLOSSARY = {"the": ("the",), "of": ("of", "de"), "and": ("and", "und"), "tion": ("tion",)}


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def occurrences(text: Column, word: str) -> Column:
    """How often a word stands apart, without case: blanks part words here, doubled so that neighbours don't share one."""
    spaced = F.concat(F.lit(" "), F.replace(F.lower(text), F.lit(" "), F.lit("  ")), F.lit(" "))
    gone = F.replace(spaced, F.lit(f" {word} "), F.lit(""))
    return ((F.length(spaced) - F.length(gone)) / (len(word) + 2)).cast("bigint")


_COUNT = "((length(' ' || replace(lower(text), ' ', '  ') || ' ') - length(replace(' ' || replace(lower(text), ' ', '  ') || ' ', ' {w} ', ''))) // {n})"
_TERMS = {t: " + ".join(_COUNT.format(w=v, n=len(v) + 2) for v in vs) for t, vs in GLOSSARY.items()}


@query("glossary_freq", " UNION ALL ".join(f"SELECT doc_id, '{t}' AS term, ({e})::BIGINT AS n FROM documents WHERE {e} > 0" for t, e in _TERMS.items()))
def glossary_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each term of the glossary, in any variant, occurs in each text."""
    return frequencies(table(spark, sf_dir, "documents"), "doc_id").where("n > 0")


def frequencies(rows: DataFrame, id_col: str) -> DataFrame:
    counts = F.array(*(F.struct(F.lit(t).alias("term"), sum((occurrences(F.col("text"), v) for v in vs[1:]), occurrences(F.col("text"), vs[0])).alias("n")) for t, vs in GLOSSARY.items()))
    return rows.select(id_col, F.explode(counts).alias("c")).select(id_col, "c.*")


_PAIRS = "pairs AS (SELECT conv_id, turn, text AS source, following AS target FROM (SELECT conv_id, turn, role, text, lead(text) OVER w AS following, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant')"


def pairs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, source, target): a user turn and the assistant turn right after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = turns(spark, sf_dir).withColumns({"target": F.lead("text").over(w), "next_role": F.lead("role").over(w)})
    return p.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("source"), "target")


@query(
    "glossary_violations",
    f"WITH {_PAIRS} "
    + " UNION ALL ".join(f"SELECT conv_id, turn, '{t}' AS term FROM pairs WHERE {_TERMS[t].replace('lower(text)', 'lower(source)')} > 0 AND {_TERMS[t].replace('lower(text)', 'lower(target)')} = 0" for t in GLOSSARY),
)
def glossary_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that a source holds and its target lacks."""
    total = lambda c, vs: sum((occurrences(F.col(c), v) for v in vs[1:]), occurrences(F.col(c), vs[0]))
    missing = F.array_compact(F.array(*(F.when((total("source", vs) > 0) & (total("target", vs) == 0), F.lit(t)) for t, vs in GLOSSARY.items())))
    return pairs_of(spark, sf_dir).select("conv_id", "turn", F.explode(missing).alias("term"))


@query("fake_translate", "SELECT conv_id, turn, md5(upper(replace(text, 'ß', 'ss'))) AS target_md5, 'none' AS degradation FROM conversations WHERE role = 'user'")
def fake_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for a translator, the same for the same text, with its level of degradation."""
    return turns(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", F.md5(F.upper(F.replace("text", F.lit("ß"), F.lit("ss")))).alias("target_md5"), F.lit("none").alias("degradation"))


@query(
    "neighbour_context",
    "SELECT conv_id, turn, md5(lag(text) OVER w) AS before_md5, md5(lead(text) OVER w) AS after_md5, array_to_string(string_split(lag(text) OVER w, ' ')[-25:], ' ') AS tail FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
)
def neighbour_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit before and after each, and the last 25 words of the one before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = F.lag("text").over(w)
    return turns(spark, sf_dir).select("conv_id", "turn", F.md5(before).alias("before_md5"), F.md5(F.lead("text").over(w)).alias("after_md5"), F.substring_index(before, " ", -25).alias("tail"))


@query(
    "checkpoint_prefix",
    "WITH b AS (SELECT conv_id, turn, max(CASE WHEN length(text) % 7 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS broken FROM conversations) SELECT conv_id, count(*) FILTER (WHERE broken = 0) AS done, count(*) AS total FROM b GROUP BY conv_id",
)
def checkpoint_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many units from the first on are done without a gap."""
    bad = F.min(F.when(F.length("text") % 7 == 0, F.col("turn")))
    n = turns(spark, sf_dir).groupBy("conv_id").agg(bad.alias("bad"), F.collect_list("turn").alias("t"))
    return n.select("conv_id", F.when(F.col("bad").isNull(), F.size("t")).otherwise(F.size(F.filter("t", lambda x: x < F.col("bad")))).cast("bigint").alias("done"), F.size("t").cast("bigint").alias("total"))


GRAM = 160


@query(
    "ngram_copy",
    """WITH g AS (SELECT DISTINCT item_id, substr(text, i::BIGINT, 160) AS gram FROM (SELECT item_id, text, unnest(range(1, length(text) - 158)) AS i FROM benchmark WHERE length(text) >= 160))
    SELECT DISTINCT d.doc_id, g.item_id FROM (SELECT doc_id, substr(text, i::BIGINT, 160) AS gram FROM (SELECT doc_id, text, unnest(range(1, length(text) - 158)) AS i FROM documents WHERE length(text) >= 160)) d JOIN g USING (gram)""",
)
def ngram_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a span of 160 characters with a reference text."""
    return copied_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _winnowed(size: int) -> Callable:
    """The winnowed grams of each text, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                grams = np.unique(winnowed(codes_of(text.as_py()), size, size // 2)[0]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(grams), pa.int64()), pa.array(grams)], names=["id", "gram"])

    return run


def _sharing(size: int) -> Callable:
    """The pairs whose texts have a run in common, sign by sign."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(batch.column(2), batch.column(3), strict=True)
            yield batch.filter(pa.array([shares_run(codes_of(a.as_py()), codes_of(b.as_py()), size) for a, b in texts], pa.bool_())).select([0, 1])

    return run


def copied_spans(docs: DataFrame, references: DataFrame, size: int = GRAM, broadcast_grams: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id): all pairs of docs (doc_id, text) and references (item_id, text) with a common run of `size` characters.

    Of each `size` characters in a row of either side the least hashed run of half that
    length is a fingerprint, so texts that share a run share one of its fingerprints,
    wherever it stands. Fingerprints meet in a join: both sides are shuffled, unless those of
    the references are at most `broadcast_grams`, and neither is held whole by the driver or
    a task. Pairs that meet are compared sign by sign. Null texts and such that are shorter
    share nothing.
    """
    prepare(docs.sparkSession)
    d = docs.where(F.length("text") >= size).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("a"))
    r = references.where(F.length("text") >= size).select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("b"))
    grams = lambda rows: rows.mapInArrow(_winnowed(size), "id bigint, gram bigint")
    wanted = materialise(grams(r).withColumnRenamed("id", "item_id"), "grams")
    wanted = F.broadcast(wanted) if wanted.count() <= broadcast_grams else wanted
    pairs = grams(d).join(wanted, "gram").select(F.col("id").alias("doc_id"), "item_id").distinct()
    both = pairs.join(d, "doc_id").join(r, "item_id").select("doc_id", "item_id", "a", "b")
    return both.mapInArrow(_sharing(size), "doc_id bigint, item_id bigint").distinct()


@query(
    "repetition_grams",
    """WITH g AS (SELECT doc_id, i::BIGINT AS pos, md5(substr(text, i::BIGINT, 16)) AS gram FROM (SELECT doc_id, text, unnest(range(1, length(text) - 14)) AS i FROM documents WHERE length(text) >= 16)),
    p AS (SELECT *, lag(pos) OVER (PARTITION BY doc_id, gram ORDER BY pos) AS before FROM g)
    SELECT doc_id, count(*) AS repeats, min(before) AS first_pos, count(DISTINCT round(before / 0.03 / n)) AS regions FROM p JOIN (SELECT doc_id, length(text)::DOUBLE AS n FROM documents) USING (doc_id) WHERE pos - before BETWEEN 16 AND 600 GROUP BY doc_id""",
)
def repetition_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16-grams that come again within 600 characters, not overlapping: how many, the first, and in how many regions of 3% of the text."""
    prepare(spark)
    d = table(spark, sf_dir, "documents").where(F.length("text") >= 16)
    return d.select("doc_id", repeated_grams(F.col("text")).alias("r")).where("r.repeats > 0").select("doc_id", "r.*")


def _repeated(text: str, size: int, least: int, most: int) -> tuple[int, int | None, int]:
    code = codes_of(text)
    before = repeats_before(code, size)
    here = np.arange(len(before))
    before = before[(before >= 0) & (here - before >= least) & (here - before <= most)]
    regions = np.unique(np.floor((before + 1) / 0.03 / max(1, len(code)) + 0.5))
    return len(before), int(before.min() + 1) if len(before) else None, len(regions)


def repeated_grams(text: Column, size: int = 16, least: int = 16, most: int = 600) -> Column:
    """struct(repeats, first_pos, regions) of a whole text: grams are sorted by a hash, so equal ones stand side by side, and then compared."""

    @F.pandas_udf("repeats bigint, first_pos bigint, regions bigint")
    def found(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_repeated(t or "", size, least, most) for t in texts], columns=["repeats", "first_pos", "regions"]).astype({"first_pos": "Int64"})

    return found(text)


@query("repetition_profile")
def repetition_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often 4 to 15 characters are repeated at once in a text, and the first such; a back-reference, which the checking SQL lacks."""
    found = F.regexp_extract_all("text", F.lit(r"(.{4,15})\1"), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("bigint").alias("repeats"), F.get(found, F.lit(0)).alias("first"))


@query(
    "boundary_overlap",
    """WITH n AS (SELECT conv_id, turn, right(lag(text) OVER w, 800) AS a, left(text, 800) AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, coalesce(list_max(list_filter(range(1, 801), lambda k: k <= least(length(a), length(b)) AND right(a, k) = left(b, k))), 0)::BIGINT AS overlap FROM n WHERE a IS NOT NULL""",
)
def boundary_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest end of a unit that the next one starts with, up to 800 characters."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = turns(spark, sf_dir).select("conv_id", "turn", F.lag("text").over(w).alias("a"), F.col("text").alias("b")).where("a IS NOT NULL")
    return n.select("conv_id", "turn", overlap(F.col("a"), F.col("b")).alias("overlap"))


def overlap(a: Column, b: Column, most: int = 800) -> Column:
    """The longest end of a, up to `most` characters, that b starts with; 0 if either is null."""

    @F.pandas_udf("bigint")
    def longest(ends: pd.Series, starts: pd.Series) -> pd.Series:
        def one(end: str | None, start: str | None) -> int:
            if not end or not start:
                return 0
            at = max(len(end) - len(start), 0)
            while (at := end.find(start[0], at)) >= 0:
                if start.startswith(end[at:]):
                    return len(end) - at
                at += 1
            return 0

        return pd.Series([one(e, s) for e, s in zip(ends, starts, strict=True)], dtype="int64")

    return longest(F.right(a, F.lit(most)), F.left(b, F.lit(most)))


@query(
    "bilingual_pairs",
    f"WITH {_PAIRS}, l AS (SELECT conv_id, turn, string_split(source, chr(10)) AS s, string_split(target, chr(10)) AS t FROM pairs) SELECT conv_id, turn, CASE WHEN len(s) = len(t) THEN i ELSE 0 END AS place, md5(CASE WHEN len(s) = len(t) THEN s[i] ELSE array_to_string(s, chr(10)) END) AS source_md5, md5(CASE WHEN len(s) = len(t) THEN t[i] ELSE array_to_string(t, chr(10)) END) AS target_md5 FROM (SELECT *, unnest(range(1, CASE WHEN len(s) = len(t) THEN len(s) + 1 ELSE 2 END)) AS i FROM l)",
)
def bilingual_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of source and target by place where there are as many, else the two whole."""
    l = pairs_of(spark, sf_dir).withColumns({"s": F.split("source", "\n"), "t": F.split("target", "\n")})
    whole = F.array(F.struct(F.lit(0).alias("place"), F.col("source").alias("a"), F.col("target").alias("b")))
    each = F.transform(F.arrays_zip("s", "t"), lambda x, i: F.struct((i + 1).alias("place"), x["s"].alias("a"), x["t"].alias("b")))
    out = l.select("conv_id", "turn", F.explode(F.when(F.size("s") == F.size("t"), each).otherwise(whole)).alias("p"))
    return out.select("conv_id", "turn", F.col("p.place").cast("bigint").alias("place"), F.md5("p.a").alias("source_md5"), F.md5("p.b").alias("target_md5"))


PLACEHOLDER = r"⟦PH_\d+⟧"
PROTECTED = r"https?://[^ \n]+|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|\d{6,}|`[^`\n]+`"


def protect(text: Column) -> tuple[Column, Column]:
    """(text with numbered placeholders, array of what they stand for)."""
    kept, between = F.regexp_extract_all(text, F.lit(PROTECTED), F.lit(0)), F.split(text, PROTECTED, -1)
    mark = lambda i: F.concat(F.lit("⟦PH_"), F.lpad(i.cast("string"), 6, "0"), F.lit("⟧"))
    return F.array_join(F.transform(between, lambda x, i: F.when(i == 0, x).otherwise(F.concat(mark(i), x))), ""), kept


def restore(text: Column, kept: Column) -> Column:
    """What was protected, back in its place; null if placeholders aren't those, in order."""
    between, found = F.split(text, PLACEHOLDER, -1), F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))
    expected = F.transform(kept, lambda x, i: F.concat(F.lit("⟦PH_"), F.lpad((i + 1).cast("string"), 6, "0"), F.lit("⟧")))
    return F.when(found == expected, F.array_join(F.transform(between, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.get(kept, i - 1), x))), ""))


@query("protect_restore", "SELECT doc_id, len(regexp_extract_all(text, 'https?://[^ \\n]+|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|\\d{6,}|`[^`\\n]+`')) AS placeholders, TRUE AS whole FROM documents")
def protect_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with what must not be translated taken out and put back, and whether that gives the text again."""
    d = table(spark, sf_dir, "documents")
    marked, kept = protect(F.col("text"))
    p = d.select("doc_id", "text", marked.alias("marked"), kept.alias("kept"))
    return p.select("doc_id", F.size("kept").cast("bigint").alias("placeholders"), (restore(F.col("marked"), F.col("kept")) == F.col("text")).alias("whole"))


def token_chunks(text: Column, limit: int = 512) -> Column:
    """array<string>: sentences packed up to `limit` bytes of UTF-8, an upper bound of tokens; a longer sentence is cut at its blanks."""
    from ..functions.chunking import byte_groups

    sentences = F.regexp_extract_all(text, F.lit(r"(?s).+?(?:[.!?]\s+|\n|$)"), F.lit(0))
    words = lambda s: F.regexp_extract_all(s, F.lit(r"(?s)\S+\s*|\s+"), F.lit(0))
    parts = F.flatten(F.transform(sentences, lambda s: F.when(F.octet_length(s) <= limit, F.array(s)).otherwise(words(s))))
    return F.transform(byte_groups(parts, limit), lambda g: F.array_join(g, ""))


@query("token_chunks")
def token_chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of turns of bounded length in bytes: how many, the longest, and whether together they are the text."""
    prepare(spark)
    c = turns(spark, sf_dir).select("conv_id", "turn", "text", token_chunks(F.col("text")).alias("c"))
    return c.select("conv_id", "turn", F.size("c").cast("bigint").alias("chunks"), F.array_max(F.transform("c", F.octet_length)).cast("bigint").alias("longest"), (F.array_join("c", "") == F.col("text")).alias("whole"))


#: What the seat of the chunker is: numbers become placeholders, commas the ends of rows.
_ROWS = "regexp_replace(replace(text, ', ', '</tr>'), '[0-9.]+', '⟦PH_000001⟧'{g})"


@query(
    "safe_chunks",
    f"""WITH RECURSIVE t AS (SELECT conv_id, turn, {_ROWS.format(g=", 'g'")} AS text FROM conversations WHERE text <> ''),
    c AS (SELECT conv_id, turn, 0 AS chunk, '' AS part, text AS rest FROM t
      UNION ALL
      SELECT conv_id, turn, chunk + 1, left(rest, fin), substr(rest, fin + 1) FROM (
        SELECT *, CASE WHEN strlen(rest) <= 120 THEN CASE WHEN strlen(rest) > 60 AND len(ends) > 0 THEN coalesce(list_max(list_filter(ends, lambda p: strlen(left(rest, p)) <= 60)), ends[1]) ELSE length(rest) END
          WHEN len(ends) > 0 THEN coalesce(list_max(list_filter(ends, lambda p: strlen(left(rest, p)) <= 60)), ends[1])
          ELSE coalesce(nullif(length(regexp_replace(left(rest, hard), '[^ \t\n]*$', '')), 0), hard) END AS fin
        FROM (SELECT *, list_filter(range(1, hard + 1), lambda p: right(left(rest, p), 5) = '</tr>') AS ends
          FROM (SELECT *, length(regexp_replace(left(rest, list_max(list_filter(range(1, least(length(rest), 120) + 1), lambda k: strlen(left(rest, k)) <= 120))), '⟦[^⟧]*$', '')) AS hard FROM c WHERE rest <> ''))))
    SELECT conv_id, turn, chunk - 1 AS chunk, md5(part) AS part_md5, strlen(part) AS bytes FROM c WHERE chunk > 0""",
)
def safe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in chunks of at most 120 bytes that end where it is safe: with a row, within 60 bytes where it can be, else with a blank; placeholders stay whole."""
    from ..functions.cuts import chunks_of

    prepare(spark)
    t = turns(spark, sf_dir).where("text <> ''").select("conv_id", "turn", F.expr(_ROWS.format(g="")).alias("text"))
    c = t.select("conv_id", "turn", F.posexplode(chunks_of(F.col("text"), 120, 60)).alias("chunk", "part"))
    return c.select("conv_id", "turn", "chunk", F.md5("part").alias("part_md5"), F.octet_length("part").cast("bigint").alias("bytes"))
