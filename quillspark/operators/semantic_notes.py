"""Notes rewritten as tokens that nothing else in a text can be taken for: an edit script by place, applied once to each line.

Which reference of a note is the first, the second and so on is a matter of the whole
document; what becomes of a line is a matter of the line. So references get their numbers by
a window over (document, label), and each line is put together once from what stands
between them. A note whose references are not as many as its contract says, or that has no
definition, is named; its document is not to be used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from .structure import _LINES, lines_of

REFERENCE = r"\[\^([^\]]+)\]"
DEFINITION = r"^\s*\[\^([^\]]+)\]:\s*(.*?)\s*$"


def token(note: Column, place: Column, marker: Column) -> Column:
    return F.concat(F.lit("@@NOTEREF__"), note, F.lit("__"), place.cast("string"), F.lit("__"), marker.cast("string"), F.lit("@@"))


def definitions(lines: DataFrame, notes: DataFrame) -> DataFrame:
    """lines (doc_id, line_no, line) with `of`, the label of a known note whose definition holds the line, else null, and `body`, what the line says of it.

    A definition goes on over lines that are indented by four blanks or a tab, and over a
    blank line before such a line.
    """
    by = Window.partitionBy("doc_id").orderBy("line_no")
    label, indented, blank = F.regexp_extract("line", DEFINITION, 1), F.col("line").rlike("^(    |\t)"), F.trim("line") == ""
    known = notes.select("doc_id", F.col("label").alias("_label"), F.lit(True).alias("_known"))
    l = lines.withColumns({"_label": F.nullif(label, F.lit("")), "_more": indented | (blank & F.coalesce(F.lead("line").over(by).rlike("^(    |\t)"), F.lit(False)))})
    l = l.join(known, ["doc_id", "_label"], "left")
    begins = F.when(F.col("_known"), F.col("_label"))
    # a line that neither begins a definition nor goes on with one ends it
    stop = F.when(begins.isNotNull() | ~F.col("_more"), F.struct(begins.alias("of")))
    of = F.last(stop, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))["of"]
    body = F.when(begins.isNotNull(), F.regexp_extract("line", DEFINITION, 2)).when(blank & ~indented, "").otherwise(F.regexp_replace("line", "^(    |\t)", ""))
    return l.select("doc_id", "line_no", "line", of.alias("of"), body.alias("body")).withColumn("body", F.when(F.col("of").isNotNull(), F.col("body")))


def rewritten(lines: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, line_no, line), (doc_id, id, finding, definition)) of lines (doc_id, line_no, line) and notes (doc_id, id, label, marker, refs).

    The first are the lines that are left, with a token for each reference of a known note
    that its contract has room for; definitions are gone from them and stand with their
    notes. finding is null, `more_references`, `fewer_references` or `no_definition`.
    References to unknown labels stay as they are.
    """
    read = definitions(lines, notes)
    left = read.where("of IS NULL")
    cut = left.select("doc_id", "line_no", F.split("line", REFERENCE, -1).alias("between"), F.regexp_extract_all("line", F.lit(REFERENCE), F.lit(1)).alias("labels"))
    refs = cut.select("doc_id", "line_no", F.posexplode("labels").alias("k", "label"))
    seen = refs.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "label").orderBy("line_no", "k"))).join(notes.select("doc_id", "id", "label", "marker", "refs"), ["doc_id", "label"], "left")
    kept = F.concat(F.lit("[^"), "label", F.lit("]"))
    edit = F.when(F.col("place") <= F.col("refs"), token(F.col("id"), F.col("place"), F.col("marker"))).otherwise(kept)
    script = seen.groupBy("doc_id", "line_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", edit.alias("edit")))), lambda e: e["edit"]).alias("edits"))
    whole = cut.select("doc_id", "line_no", "between").join(script, ["doc_id", "line_no"], "left")
    line = F.array_join(F.zip_with("between", F.concat(F.coalesce("edits", F.array().cast("array<string>")), F.array(F.lit(""))), lambda b, e: F.concat(b, e)), "")
    found = seen.where("id IS NOT NULL").groupBy("doc_id", "id").agg(F.count("*").alias("found"))
    bodies = read.where("of IS NOT NULL").groupBy("doc_id", F.col("of").alias("label")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "body"))), lambda b: b["body"]), "\n").alias("definition"))
    n = notes.join(found, ["doc_id", "id"], "left").join(bodies, ["doc_id", "label"], "left")
    many = F.coalesce("found", F.lit(0))
    finding = F.when(many > F.col("refs"), "more_references").when(many < F.col("refs"), "fewer_references").when(F.col("definition").isNull(), "no_definition")
    return whole.select("doc_id", "line_no", line.alias("line")), n.select("doc_id", "id", finding.alias("finding"), "definition")


#: The contract of the seat: labels 0 to 3, of which each is said to have so many references.
_SEAT = (("0", 2), ("1", 1), ("2", 3), ("n0", 2), ("n1", 0))


@query(
    "semantic_notes",
    rf"""WITH {_LINES}, c(label, refs) AS (VALUES {", ".join(f"('{l}', {n})" for l, n in _SEAT)}), f AS (SELECT doc_id, line_no, line, nullif(regexp_extract(line, '^\s*\[\^([^\]]+)\]:', 1), '') AS l, regexp_matches(line, '^(    |\t)') AS ind, trim(line) = '' AS bl, coalesce(regexp_matches(lead(line) OVER (PARTITION BY doc_id ORDER BY line_no), '^(    |\t)'), FALSE) AS nx FROM lines),
    k AS (SELECT f.doc_id, f.line_no, f.line, c.label AS l, f.ind OR (f.bl AND f.nx) AS more FROM f LEFT JOIN c ON c.label = f.l),
    g AS (SELECT *, last_value(CASE WHEN l IS NOT NULL OR NOT more THEN [l] END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM k),
    u AS (SELECT doc_id, line_no, line FROM g WHERE held IS NULL OR held[1] IS NULL),
    r AS (SELECT doc_id, line_no, i, p, label, row_number() OVER (PARTITION BY doc_id, label ORDER BY line_no, i) AS place FROM (SELECT doc_id, line_no, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS label, string_split_regex(line, '\[\^[^\]]+\]') AS p FROM (SELECT *, regexp_extract_all(line, '\[\^([^\]]+)\]', 1) AS m FROM u))),
    e AS (SELECT r.doc_id, r.line_no, any_value(p)[1] || string_agg(CASE WHEN place <= refs THEN '@@NOTEREF__n' || c.label || '__' || place || '__' || length(c.label) || '@@' ELSE '[^' || r.label || ']' END || p[i + 1], '' ORDER BY i) AS line FROM r LEFT JOIN c ON c.label = r.label GROUP BY r.doc_id, r.line_no)
    SELECT u.doc_id, count(*) AS lines, md5(string_agg(coalesce(e.line, u.line), chr(10) ORDER BY u.line_no)) AS text_md5 FROM u LEFT JOIN e USING (doc_id, line_no) GROUP BY u.doc_id""",
)
def semantic_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the definitions of the notes of a contract, their references as tokens as far as the contract goes."""
    lines = lines_of(spark, sf_dir)
    contract = F.explode(F.array(*(F.struct(F.lit(l).alias("label"), F.lit(n).alias("refs")) for l, n in _SEAT))).alias("c")
    notes = lines.select("doc_id").distinct().select("doc_id", contract).select("doc_id", F.concat(F.lit("n"), "c.label").alias("id"), "c.label", F.length("c.label").alias("marker"), "c.refs")
    out, _ = rewritten(lines, notes)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return out.groupBy("doc_id").agg(F.count("*").alias("lines"), F.md5(text).alias("text_md5"))
