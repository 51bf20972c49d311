"""Notes as an extractor states them against notes as they are found in the text: pair by pair, every rule by name.

The two lists of a document are paired by place. What a rule needs of the text (labels at a
line, pages, how many lines) comes by joins on the line; what it needs of sections and
sources of the document are arrays beside the pair. Order within a list is a fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..registry import query
from ..sources.shared import materialise
from .structure import markdown_documents, marks_of, notes_of, read_lines, recover, with_owner

#: The kinds of notes.
KINDS = ("footnote", "endnote", "editorial")
#: What may be wrong with a pair.
RULES = ("unsupported_kind", "id_differs", "label_differs", "kind_differs", "range_differs", "references_differ", "reference_ids_malformed", "reference_ids_differ", "no_anchor", "no_evidence", "has_anomalies", "id_repeats", "label_repeats", "bad_range", "no_references", "references_out_of_order", "pages_out_of_order", "unknown_section", "outside_of_section", "files_differ", "pages_differ", "reference_not_in_text", "definition_not_in_text", "wrong_section")
CONTRACT = "doc_id bigint, place bigint, id string, label string, kind string, start_line bigint, end_line bigint, section_id string, ref_lines array<bigint>, ref_ids array<string>, pages array<bigint>, files array<string>, anchor string, evidence array<string>, anomalies array<string>"
NOTE = "doc_id bigint, place bigint, id string, label string, kind string, start_line bigint, end_line bigint, section_id string, ref_lines array<bigint>, ref_ids array<string>"
SECTION = "doc_id bigint, id string, start_line bigint, end_line bigint, level bigint, title string, corrected boolean"
SOURCE = "doc_id bigint, path string, href string, start_line bigint, end_line bigint, pages array<bigint>"


def rising(values: Column, strictly: bool) -> Column:
    """Whether an array rises, by one fold that carries the last value."""
    begin = F.struct(F.lit(True).alias("fine"), F.lit(None).cast("bigint").alias("last"))
    ahead = lambda a, x: F.coalesce((x > a["last"]) if strictly else (x >= a["last"]), F.lit(True))
    return F.aggregate(values, begin, lambda a, x: F.struct((a["fine"] & ahead(a, x)).alias("fine"), x.alias("last")), lambda a: a["fine"])


def facts(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, defines, refers, anchor, page, n) of lines (doc_id, line_no, line, visible): labels, the page anchor of a line, the page it lies on, how many lines there are."""
    by = Window.partitionBy("doc_id")
    anchor, v = M.page_anchor(F.col("line")), F.col("visible")
    page = F.last(anchor, ignorenulls=True).over(by.orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    return lines.select("doc_id", "line_no", M.note_definition(v).alias("defines"), M.note_references(v).alias("refers"), anchor.alias("anchor"), page.alias("page"), F.max("line_no").over(by).alias("n"))


def _merged(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the documents: compressed it may lie below the limit of broadcasts, and its rows would fill the driver."""
    return df.hint("merge")


def findings(contracts: DataFrame, notes: DataFrame, own_sections: DataFrame, sections: DataFrame, sources: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, place, id, finding): a row for each rule that a pair breaks, and for each note that has no other side.

    contracts are the extractor's notes (CONTRACT) with the sections (SECTION) and sources
    (SOURCE) it names; notes (NOTE) and sections are those found in the text, whose lines are
    (doc_id, line_no, line, visible). A pair without a row here is as it should be.
    """
    f = materialise(facts(lines), "facts")
    of_doc = lambda df, name, *columns: df.groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias(name))
    ranges = ("level", "start_line", "id", "end_line", "title")
    c = contracts.withColumns({"id_nth": F.row_number().over(Window.partitionBy("doc_id", "id").orderBy("place")), "label_nth": F.row_number().over(Window.partitionBy("doc_id", "label").orderBy("place"))})
    both = c.alias("c").join(_merged(notes).alias("n"), (F.col("c.doc_id") == F.col("n.doc_id")) & (F.col("c.place") == F.col("n.place")), "full")
    both = both.select(F.coalesce("c.doc_id", "n.doc_id").alias("doc_id"), F.coalesce("c.place", "n.place").alias("place"), F.coalesce("c.id", "n.id").alias("id"), F.when(F.col("c.doc_id").isNotNull(), F.struct(*(F.col(f"c.{x}").alias(x) for x in c.columns))).alias("c"), F.when(F.col("n.doc_id").isNotNull(), F.struct(*(F.col(f"n.{x}").alias(x) for x in notes.columns))).alias("n"))
    start = f.select("doc_id", F.col("line_no").alias("_line"), F.struct("defines", "page").alias("at"))
    both = both.withColumn("_line", F.col("c.start_line")).join(_merged(start), ["doc_id", "_line"], "left").drop("_line")
    both = both.join(_merged(f.groupBy("doc_id").agg(F.max("n").alias("lines"))), "doc_id", "left")
    # labels at the lines that refer, pages on the lines that define
    asked = both.where("c IS NOT NULL").select("doc_id", "place", "c")
    refs = asked.select("doc_id", "place", F.col("c.label").alias("label"), F.explode("c.ref_lines").alias("line_no")).join(_merged(f), ["doc_id", "line_no"], "left")
    refs = refs.groupBy("doc_id", "place").agg(F.bool_and(F.coalesce(F.array_contains("refers", F.col("label")), F.lit(False))).alias("refs_there"))
    spread = F.sequence(F.greatest(F.col("c.start_line"), F.lit(1)), F.col("c.end_line"))
    held = asked.where("c.end_line >= greatest(c.start_line, 1)").select("doc_id", "place", F.explode(spread).alias("line_no")).join(_merged(f.where("anchor IS NOT NULL")), ["doc_id", "line_no"]).groupBy("doc_id", "place").agg(F.collect_set("anchor").alias("anchors"))
    both = both.join(_merged(refs), ["doc_id", "place"], "left").join(_merged(held), ["doc_id", "place"], "left")
    both = both.join(_merged(of_doc(own_sections, "own", *ranges)), "doc_id", "left").join(_merged(of_doc(sections, "made", *ranges, "corrected")), "doc_id", "left").join(_merged(of_doc(sources, "sources", "path", "href", "start_line", "end_line", "pages")), "doc_id", "left")

    col, lo, hi = (lambda x: F.col(f"c.{x}")), F.col("c.start_line"), F.col("c.end_line")
    some = lambda name: F.coalesce(F.col(name), F.array())
    within = lambda s: (s["start_line"] <= lo) & (hi <= s["end_line"])
    deepest = lambda name: F.array_max(F.transform(F.filter(some(name), within), lambda s: F.struct(s["level"], s["start_line"], s["id"])))
    stated = F.get(F.filter(some("own"), lambda s: s["id"] == col("section_id")), F.lit(0))
    plain = lambda t: F.lower(F.regexp_replace(F.trim(t), r"\s+", " "))
    twin = F.get(F.filter(some("made"), lambda s: (s["start_line"] == stated["start_line"]) & (s["end_line"] == stated["end_line"]) & (s["level"] == stated["level"]) & (plain(s["title"]) == plain(stated["title"]))), F.lit(0))
    corrected = F.exists(some("made"), lambda s: (s["id"] == F.col("n.section_id")) & F.coalesce(s["corrected"], F.lit(False)))
    owned = deepest("own")["id"].eqNullSafe(col("section_id")) & deepest("made")["id"].eqNullSafe(F.col("n.section_id")) & F.when(twin.isNotNull(), twin["id"] == F.col("n.section_id")).otherwise(corrected)
    over = lambda s: (s["start_line"] <= hi) & (lo <= s["end_line"])
    document = F.coalesce(F.substring_index(col("anchor"), "#", 1), F.lit(""))
    named = F.filter(some("sources"), lambda s: over(s) | F.exists(col("ref_lines"), lambda x: x.between(s["start_line"], s["end_line"])) | ((document != "") & (s["href"] == document)))
    wanted_files = F.array_sort(F.array_distinct(F.transform(named, lambda s: s["path"])))
    files_fine = (F.array_sort(col("files")) == wanted_files) & (F.size(F.array_distinct(col("files"))) == F.size(col("files"))) & (F.size(col("files")) > 0)
    on_lines = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(F.col("at.page")), F.coalesce("anchors", F.array().cast("array<bigint>"))))))
    of_sources = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(some("sources"), over), lambda s: s["pages"]))))
    pages = F.when(F.size(on_lines) > 0, on_lines).otherwise(of_sources)
    ids = F.transform(col("ref_lines"), lambda _, i: F.concat(F.lit("noteref_"), col("id"), F.lit("_"), F.lpad((i + 1).cast("string"), 3, "0")))
    differs = lambda x: ~col(x).eqNullSafe(F.col(f"n.{x}"))
    rules = {
        "unsupported_kind": ~F.coalesce(col("kind").isin(*KINDS), F.lit(False)), "id_differs": differs("id"), "label_differs": differs("label"), "kind_differs": differs("kind"), "range_differs": differs("start_line") | differs("end_line"),
        "references_differ": differs("ref_lines"), "reference_ids_malformed": ~col("ref_ids").eqNullSafe(ids), "reference_ids_differ": differs("ref_ids"), "no_anchor": F.trim(F.coalesce(col("anchor"), F.lit(""))) == "", "no_evidence": F.coalesce(F.size(col("evidence")), F.lit(0)) < 1, "has_anomalies": F.size(col("anomalies")) > 0,
        "id_repeats": col("id_nth") > 1, "label_repeats": col("label_nth") > 1, "bad_range": ~F.coalesce((lo > 0) & (hi >= lo) & (hi <= F.col("lines")), F.lit(False)), "no_references": F.coalesce(F.size(col("ref_lines")), F.lit(0)) < 1, "references_out_of_order": ~rising(col("ref_lines"), False), "pages_out_of_order": ~rising(col("pages"), True),
        "unknown_section": stated.isNull(), "outside_of_section": stated.isNotNull() & ~F.coalesce((stated["start_line"] > 0) & (lo >= stated["start_line"]) & (hi <= stated["end_line"]), F.lit(False)), "files_differ": ~F.coalesce(files_fine, F.lit(False)), "pages_differ": ~col("pages").eqNullSafe(pages),
        "reference_not_in_text": ~F.coalesce("refs_there", F.lit(True)), "definition_not_in_text": ~F.col("at.defines").eqNullSafe(col("label")), "wrong_section": ~F.coalesce(owned, F.lit(False)),
    }
    broken = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in ((name, rules[name]) for name in RULES))))
    every = F.when(F.col("n").isNull(), F.array(F.lit("not_in_text"))).when(F.col("c").isNull(), F.array(F.lit("not_extracted"))).otherwise(broken)
    return both.select("doc_id", "place", "id", F.explode(every).alias("finding"))


@query("note_contract")
def note_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with notes as a hasty extractor states them, who takes the first definition of a label for the only one and the page a note begins on for all of its pages; how often, by rule."""
    docs, marks = markdown_documents(spark, sf_dir), marks_of(spark, sf_dir)
    lines = read_lines(docs)
    sections = recover(marks).select("doc_id", F.col("section_id").alias("id"), "start_line", "end_line", "level", "title", F.lit(False).alias("corrected"))
    real = notes_of(marks).where("def_line IS NOT NULL").select("doc_id", "label", "ordinal", "def_line", "kind", "section_line")
    at = materialise(with_owner(marks.where("line_no > 0")).select("doc_id", "line_no", M.note_definition(F.col("visible")).alias("defines"), M.note_references(F.col("visible")).alias("refers")), "spots")
    refs = at.select("doc_id", "line_no", F.explode("refers").alias("label")).groupBy("doc_id", "label").agg(F.sort_array(F.collect_list("line_no")).alias("ref_lines"))
    first = at.where("defines IS NOT NULL").groupBy("doc_id", F.col("defines").alias("label")).agg(F.min("line_no").alias("first_line"))
    name = F.concat(F.lit("note_"), F.lpad(F.col("ordinal").cast("string"), 3, "0"))
    empty = F.array().cast("array<bigint>")
    n = real.join(_merged(refs), ["doc_id", "label"], "left").join(_merged(first), ["doc_id", "label"]).join(_merged(sections.select("doc_id", F.col("start_line").alias("section_line"), F.col("id").alias("section_id"))), ["doc_id", "section_line"], "left")
    n = materialise(n.withColumns({"id": name, "ref_lines": F.coalesce("ref_lines", empty)}).withColumn("ref_ids", F.transform("ref_lines", lambda _, i: F.concat(F.lit("noteref_"), F.col("id"), F.lit("_"), F.lpad((i + 1).cast("string"), 3, "0")))), "notes")
    notes = n.select("doc_id", F.col("ordinal").alias("place"), "id", "label", "kind", F.col("def_line").alias("start_line"), F.col("def_line").alias("end_line"), "section_id", "ref_lines", "ref_ids")
    where = facts(lines).select("doc_id", F.col("line_no").alias("first_line"), "page")
    pages = F.array_compact(F.array("page"))
    c = n.join(_merged(where), ["doc_id", "first_line"]).select("doc_id", F.col("ordinal").alias("place"), "id", "label", "kind", F.col("first_line").alias("start_line"), F.col("first_line").alias("end_line"), "section_id", "ref_lines", "ref_ids", pages.alias("pages"), F.array(F.lit("book.md")).alias("files"), F.concat(F.lit("book.xhtml#"), "id").alias("anchor"), F.array(F.lit("marker")).alias("evidence"), F.array().cast("array<string>").alias("anomalies"))
    whole = docs.select("doc_id", F.lit("book.md").alias("path"), F.lit("book.xhtml").alias("href"), F.lit(1).cast("bigint").alias("start_line"), F.size("lines").cast("bigint").alias("end_line"), empty.alias("pages"))
    return findings(c, notes, sections, sections, whole, lines).groupBy("finding").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))
