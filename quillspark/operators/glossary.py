"""A glossary against translated chunks: what is demanded, what is missing, and where.

Forms of all entries are looked for at once in whole texts. What a chunk holds most often
is demanded of its translation; what the translation lacks is shown by the stretch between
placeholders that it stands in, beside the same stretch of the translation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.slices import slices
from ..registry import query
from ..sources.shared import materialise, prepare
from ..sources.tables import table
from .acceptance import PLACEHOLDER
from .translation import _PAIRS, pairs_of

#: Entries for a chunk, occurrences for an entry, characters of an excerpt, signs of a placeholder.
DEMANDED, SHOWN, EXCERPT, MARK = 50, 2, 200, 11
_CJK = "぀-ヿ㐀-鿿豈-﫿가-힯"


def _folded(text: str) -> str:
    """Lower case, sign for sign."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _found(forms: list[tuple[int, str, bool]]) -> Callable:
    """Places of forms in texts: whole words whatever their case, or, of forms with CJK signs, the same signs anywhere; of one form none overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine, same = ahocorasick.Automaton(), {}
        for number, form, cjk in forms:
            same.setdefault(_folded(form), []).append((number, form, cjk))
        for low, own in same.items():
            machine.add_word(low, (len(low), own))
        if same:
            machine.make_automaton()
        word = lambda c: c.isalnum() or c == "_"
        for whole in batches:
            at = 0
            for part in slices(whole.column(whole.num_columns - 1)):
                batch, at = whole.slice(at, len(part)), at + len(part)
                rows: list[tuple[int, int, int, int]] = []
                for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    after: dict[int, int] = {}
                    for last, (n, own) in machine.iter(_folded(text or "")) if same else ():
                        start, stop = last + 1 - n, last + 1
                        apart = word(text[start]) != (start > 0 and word(text[start - 1])) and word(text[last]) != (stop < len(text) and word(text[stop]))
                        for number, form, cjk in own:
                            if after.get(number, 0) <= start and (text[start:stop] == form if cjk else apart):
                                rows.append((i, number, start, stop))
                                after[number] = stop
                of, *spans = zip(*rows, strict=True) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([c.take(pa.array(of, pa.int64())) for c in batch.columns[:-1]] + [pa.array(s, pa.int64()) for s in spans], names=[*batch.schema.names[:-1], "form", "start", "stop"])

    return run


def places(texts: DataFrame, forms: DataFrame, block: int = 100_000) -> DataFrame:
    """texts (..., text) without text, with form, start and stop of each place where a form (form, value) stands.

    Forms go to the tasks in blocks of about `block`; each block reads the texts once.
    """
    prepare(texts.sparkSession)
    *keys, _ = texts.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:-1]) + ", form bigint, start bigint, stop bigint"
    wanted, out = forms.where("value <> ''").withColumn("cjk", F.col("value").rlike(f"[{_CJK}]")), None
    blocks = 1 + wanted.count() // block
    for b in range(blocks):
        own = [tuple(r) for r in wanted.where(F.pmod(F.xxhash64("form", "value"), F.lit(blocks)) == b).orderBy("form", "value").collect()]
        found = texts.mapInArrow(_found(own), schema)
        out = found if out is None else out.unionByName(found)
    return out


def demanded(chunks: DataFrame, glossary: DataFrame, limit: int = DEMANDED) -> tuple[DataFrame, DataFrame]:
    """((unit, chunk, entry, n, place), (unit, chunk, entry, start, stop)): the entries that each chunk holds most often, and where they stand.

    glossary (entry, source, translation): sources hold variants parted by `|`, whose counts
    add up. Of equal counts the entry with the longest variant counts first, then the smaller
    number; `place` is their order in a prompt: longest first, then by number. Entries
    without a source or a translation are none.
    """
    each = F.filter(F.transform(F.split("source", r"\|"), lambda v: F.trim(v)), lambda v: v != "")
    entries = glossary.where("trim(source) <> '' AND trim(translation) <> ''").select("entry", each.alias("v")).where("size(v) > 0")
    forms = materialise(entries.select("entry", F.array_max(F.transform("v", F.length)).alias("longest"), F.posexplode(F.array_distinct("v")).alias("i", "value")).withColumn("form", F.xxhash64("entry", "value")), "forms")
    spans = materialise(places(chunks.select("unit", "chunk", F.col("source").alias("text")), forms.select("form", "value")).join(forms.select("form", "entry", "longest"), "form").drop("form"), "spans")
    held = spans.groupBy("unit", "chunk", "entry").agg(F.count("*").alias("n"), F.max("longest").alias("longest"))
    by = Window.partitionBy("unit", "chunk")
    top = held.withColumn("k", F.row_number().over(by.orderBy(F.desc("n"), F.desc("longest"), "entry"))).where(F.col("k") <= limit)
    top = top.withColumn("place", F.row_number().over(by.orderBy(F.desc("longest"), "entry")).cast("bigint")).select("unit", "chunk", "entry", "n", "place")
    return top, spans.select("unit", "chunk", "entry", "start", "stop").distinct()


def missing(chunks: DataFrame, glossary: DataFrame, top: DataFrame) -> DataFrame:
    """(unit, chunk, entry) of the demanded entries whose translation does not stand in the output of their chunk."""
    forms = glossary.join(top.select("entry").distinct(), "entry", "left_semi").select(F.col("entry").alias("form"), F.trim("translation").alias("value"))
    there = places(chunks.select("unit", "chunk", F.col("output").alias("text")), forms).select("unit", "chunk", F.col("form").alias("entry")).distinct()
    return top.select("unit", "chunk", "entry").join(there, ["unit", "chunk", "entry"], "left_anti")


def stretches(chunks: DataFrame, text: str) -> DataFrame:
    """(unit, chunk, segment, start, n, text): what stands between placeholders, empty ones too, and where; starts are running sums."""
    parts = chunks.select("unit", "chunk", F.posexplode(F.split(text, PLACEHOLDER, -1)).alias("segment", "text"))
    before = F.sum(F.length("text") + MARK).over(Window.partitionBy("unit", "chunk").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    return parts.withColumns({"start": F.coalesce(before, F.lit(0)).cast("bigint"), "n": F.count("*").over(Window.partitionBy("unit", "chunk"))})


def in_segments(spans: DataFrame, segments: DataFrame) -> DataFrame:
    """spans (unit, chunk, start, ...) with s, struct(segment, start, n, text): the last segment that starts at or before each; an as-of join by one sort."""
    own = spans.withColumn("_row", F.struct(*spans.columns)).select("unit", "chunk", F.col("start").alias("_at"), F.lit(1).alias("_kind"), "_row")
    seg = segments.select("unit", "chunk", F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.struct("segment", "start", "n", "text").alias("_s"))
    both = own.unionByName(seg, allowMissingColumns=True)
    last = F.last("_s", ignorenulls=True).over(Window.partitionBy("unit", "chunk").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("s", last).where("_kind = 1").select("_row.*", "s")


def excerpt(text: Column, start: Column, stop: Column, size: int = EXCERPT) -> Column:
    """`size` characters around a place, stripped, with an ellipsis where something is cut; a shorter text whole."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    margin = F.greatest(F.floor((size - F.greatest(stop - start, F.lit(0))) / 2), F.lit(0))
    at = F.greatest(F.least(start - margin, F.length(text) - size), F.lit(0)).cast("int")
    cut = F.concat(F.when(at > 0, "…").otherwise(""), strip(F.substring(text, at + 1, F.lit(size))), F.when(at + size < F.length(text), "…").otherwise(""))
    return F.when(F.length(text) <= size, strip(text)).otherwise(cut)


def report(chunks: DataFrame, glossary: DataFrame, limit: int = DEMANDED, shown: int = SHOWN, size: int = EXCERPT) -> DataFrame:
    """(unit, entry, chunk, segment, source_excerpt, output_excerpt): of each entry that a unit misses somewhere, its first `shown` places.

    chunks (unit, chunk, source, output). A segment counts once for an entry, at its first
    place there; segment i of a source stands beside segment i of its output, so a chunk
    whose output has more or fewer placeholders shows none.
    """
    top, spans = demanded(chunks, glossary, limit)
    lost = materialise(missing(chunks, glossary, materialise(top, "demanded")), "missing")
    held = in_segments(spans.join(lost, ["unit", "chunk", "entry"], "left_semi"), stretches(chunks, "source"))
    first = held.groupBy("unit", "chunk", "entry", F.col("s.segment").alias("segment")).agg(F.min(F.struct("start", "stop", "s")).alias("f"))
    out = stretches(chunks, "output").select("unit", "chunk", "segment", F.col("n").alias("out_n"), F.col("text").alias("out_text"))
    both = first.join(out, ["unit", "chunk", "segment"]).where("f.s.n = out_n")
    rank = F.row_number().over(Window.partitionBy("unit", "entry").orderBy("chunk", "segment"))
    at = F.col("f.s.start")
    kept = both.withColumn("k", rank).where(F.col("k") <= shown)
    return kept.select("unit", "entry", "chunk", F.col("segment").cast("bigint").alias("segment"), excerpt(F.col("f.s.text"), F.col("f.start") - at, F.col("f.stop") - at, size).alias("source_excerpt"), excerpt(F.col("out_text"), F.lit(0), F.lit(0), size).alias("output_excerpt"))


# --- the seat: words of the reference texts are the glossary, pairs of turns the chunks ----


def glossary_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry, source, translation): words of four to seven letters, with their first three as a variant; their first four are the translation."""
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))).alias("w")
    w = table(spark, sf_dir, "benchmark").select(words).where("w rlike '^[a-z]{4,7}$'").distinct()
    numbered = w.withColumn("entry", F.row_number().over(Window.orderBy("w")).cast("bigint"))  # a glossary is a small table
    return numbered.select("entry", F.concat("w", F.lit(" | "), F.left("w", F.lit(3))).alias("source"), F.left("w", F.lit(4)).alias("translation"))


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, chunk, source, output): pairs of turns whose numbers and stops are placeholders."""
    marked = lambda c: F.regexp_replace(c, "[0-9,.]+", "⟦PH_000001⟧")
    return pairs_of(spark, sf_dir).select(F.col("conv_id").alias("unit"), F.col("turn").alias("chunk"), marked("source").alias("source"), marked("target").alias("output"))


_PIECES = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
_SELECTED = rf"""{_PAIRS}, c AS (SELECT conv_id AS unit, turn AS chunk, regexp_replace(source, '[0-9,.]+', '⟦PH_000001⟧', 'g') AS source, regexp_replace(target, '[0-9,.]+', '⟦PH_000001⟧', 'g') AS output FROM pairs),
    w AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS w FROM benchmark) WHERE regexp_full_match(w, '[a-z]{{4,7}}')), g AS (SELECT w, row_number() OVER (ORDER BY w) AS entry FROM w),
    v AS (SELECT entry, w AS value, length(w) AS longest FROM g UNION SELECT entry, left(w, 3), length(w) FROM g),
    t AS (SELECT unit, chunk, i, part, (sum(length(part)) OVER (PARTITION BY unit, chunk ORDER BY i) - length(part))::BIGINT AS start FROM (SELECT unit, chunk, unnest(p) AS part, unnest(range(1, len(p) + 1)) AS i FROM (SELECT unit, chunk, regexp_extract_all(source, '{_PIECES}') AS p FROM c))),
    spans AS (SELECT DISTINCT unit, chunk, entry, longest, start, start + length(part) AS stop FROM t JOIN v ON lower(part) = value),
    top AS (SELECT *, row_number() OVER (PARTITION BY unit, chunk ORDER BY n DESC, longest DESC, entry) AS k FROM (SELECT unit, chunk, entry, max(longest) AS longest, count(*) AS n FROM spans GROUP BY unit, chunk, entry) QUALIFY k <= 3)"""


@query("glossary_selection", rf"WITH {_SELECTED} SELECT unit, chunk, entry, n, row_number() OVER (PARTITION BY unit, chunk ORDER BY longest DESC, entry) AS place FROM top")
def glossary_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three entries of the glossary that each chunk holds most often, in the order of a prompt."""
    return demanded(chunks_of(spark, sf_dir), glossary_of(spark, sf_dir), 3)[0]


_CUT = "CASE WHEN length({t}) <= 40 THEN regexp_replace({t}, '^\\s+|\\s+$', '', 'g') ELSE CASE WHEN {a} > 0 THEN '…' ELSE '' END || regexp_replace(substr({t}, ({a})::BIGINT + 1, 40), '^\\s+|\\s+$', '', 'g') || CASE WHEN {a} + 40 < length({t}) THEN '…' ELSE '' END END"


@query(
    "glossary_report",
    rf"""WITH {_SELECTED}, there AS (SELECT DISTINCT unit, chunk, entry FROM (SELECT unit, chunk, lower(unnest(regexp_extract_all(output, '[\p{{L}}\p{{N}}_]+'))) AS part FROM c) JOIN g ON part = left(w, 4)),
    lost AS (SELECT unit, chunk, entry FROM top WHERE NOT EXISTS (SELECT 1 FROM there h WHERE h.unit = top.unit AND h.chunk = top.chunk AND h.entry = top.entry)),
    x AS (SELECT unit, chunk, entry, start, stop, string_split(source, '⟦PH_000001⟧') AS a, string_split(output, '⟦PH_000001⟧') AS b, length(left(source, start)) - length(replace(left(source, start), '⟦', '')) AS segment FROM spans JOIN lost USING (unit, chunk, entry) JOIN c USING (unit, chunk)),
    f AS (SELECT unit, chunk, entry, segment, min(start) AS start, arg_min(stop, (start, stop)) AS stop, any_value(a) AS a, any_value(b) AS b FROM x WHERE len(a) = len(b) GROUP BY unit, chunk, entry, segment),
    r AS (SELECT *, row_number() OVER (PARTITION BY unit, entry ORDER BY chunk, segment) AS k FROM f QUALIFY k <= 2),
    o AS (SELECT unit, entry, chunk, segment, a[segment + 1] AS s, b[segment + 1] AS o, start - coalesce(list_sum(list_transform(a[1:segment], lambda p: length(p))), 0) - 11 * segment AS lo, stop - start AS n FROM r)
    SELECT unit, entry, chunk, segment, {_CUT.format(t="s", a="greatest(least(lo - greatest((40 - n) // 2, 0), length(s) - 40), 0)")} AS source_excerpt, {_CUT.format(t="o", a="0")} AS output_excerpt FROM o""",
)
def glossary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each demanded entry that a conversation's translations lack, two places at most, source and translation side by side."""
    return report(chunks_of(spark, sf_dir), glossary_of(spark, sf_dir), limit=3, size=40)
