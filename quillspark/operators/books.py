"""Books: chapters, paragraph blocks, features, printed contents, shapes and counts, over the Markdown lines of `structure`."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..registry import query
from ..sources.shared import prepare
from .structure import _HEADS, _SECTIONS, _SEM, _by_doc, headings, markdown_documents, sections, semantic_of

_CHAPTERS = f"""{_HEADS}, top AS (SELECT doc_id, min(level) AS top FROM heads GROUP BY doc_id), marks AS (SELECT l.doc_id, l.line_no, l.line, s.visible, h.title, (h.level IS NOT NULL AND h.level = t.top)::INT AS begins FROM lines l JOIN sem s USING (doc_id, line_no) JOIN top t USING (doc_id) LEFT JOIN heads h USING (doc_id, line_no)),
placed AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM marks),
grouped AS (SELECT doc_id, k, min(line_no) AS start_line, max(line_no) AS end_line, max(CASE WHEN begins = 1 THEN title END) AS title, bool_or(trim(visible) <> '') AS seen, sum(octet_length(encode(line)) + 1)::BIGINT AS bytes FROM placed GROUP BY doc_id, k),
chapters AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS ordinal FROM grouped WHERE k > 0 OR seen)"""


@query("primary_chapters", f"WITH RECURSIVE {_CHAPTERS} SELECT doc_id, ordinal, start_line, end_line, bytes, CASE WHEN k = 0 THEN 'Front Matter' WHEN title = '' THEN 'Chapter ' || ordinal ELSE title END AS title FROM chapters")
def primary_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents split at the headings of their smallest level."""
    return chapters(semantic_of(spark, sf_dir)).select("doc_id", "ordinal", "start_line", "end_line", "bytes", "title")


def _chapter_lines(lines: DataFrame) -> DataFrame:
    """lines with level, top, begins and k, the number of the chapter that each is in; documents without a heading have none."""
    whole = Window.partitionBy("doc_id")
    l = lines.withColumn("level", M.atx_level(F.col("visible"))).withColumn("top", F.min("level").over(whole)).where("top IS NOT NULL")
    return l.withColumn("begins", F.coalesce(F.col("level") == F.col("top"), F.lit(False))).withColumn("k", F.sum(F.col("begins").cast("int")).over(_by_doc().rowsBetween(Window.unboundedPreceding, 0)))


def chapters(lines: DataFrame) -> DataFrame:
    """(doc_id, ordinal, k, start_line, end_line, bytes, title): what a reader can see before the first one is Front Matter."""
    title = F.max(F.when(F.col("begins"), M.heading_title(F.col("visible"))))
    g = _chapter_lines(lines).groupBy("doc_id", "k").agg(
        F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), title.alias("t"), F.max((F.trim("visible") != "").cast("int")).alias("seen"), F.sum(F.octet_length("line") + 1).cast("bigint").alias("bytes")
    )
    g = g.where("k > 0 OR seen = 1").withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy("k")).cast("bigint"))
    name = F.when(F.col("k") == 0, "Front Matter").when(F.col("t") == "", F.concat(F.lit("Chapter "), F.col("ordinal"))).otherwise(F.col("t"))
    return g.select("doc_id", "ordinal", F.col("k").cast("bigint").alias("k"), "start_line", "end_line", "bytes", name.alias("title"))


_BLOCK = f"""{_SEM}, f AS (SELECT l.doc_id, l.line_no, l.line, s.fenced, trim(l.line) = '' AND NOT s.fenced AS blank FROM lines l JOIN sem s USING (doc_id, line_no)),
b AS (SELECT *, sum(blank::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM f)"""


@query(
    "paragraph_blocks",
    rf"""WITH RECURSIVE {_BLOCK}, g AS (SELECT doc_id, k, min(line_no) AS start_line, max(line_no) AS end_line, string_agg(line, chr(10) ORDER BY line_no) AS text FROM b WHERE NOT blank GROUP BY doc_id, k)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_line) AS block, start_line, end_line, sha256(text) AS sha256, regexp_matches(text, '^(\s*<!--[^-]*-->)+\s*$') AS comment_only FROM g""",
)
def paragraph_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of lines that aren't blank, fences whole, with a hash of each; and whether one is nothing but comments."""
    return blocks(semantic_of(spark, sf_dir)).select("doc_id", "block", "start_line", "end_line", F.sha2("text", 256).alias("sha256"), comment_only(F.col("text")).alias("comment_only"))


def blocks(lines: DataFrame) -> DataFrame:
    """(doc_id, block, start_line, end_line, text)."""
    blank = (F.trim("line") == "") & ~F.col("fenced")
    b = lines.withColumn("k", F.sum(blank.cast("int")).over(_by_doc().rowsBetween(Window.unboundedPreceding, 0))).where(~blank)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    g = b.groupBy("doc_id", "k").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), text.alias("text"))
    return g.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("start_line")).cast("bigint").alias("block"), "start_line", "end_line", "text")


def comment_only(block: Column) -> Column:
    """Whether a block is complete comments and blanks; a comment within a comment is none."""
    return block.rlike(r"^(?:\s*<!--(?:(?!<!--)(?!-->)[\s\S])*-->)+\s*$")


@query(
    "section_features",
    rf"""WITH RECURSIVE {_SECTIONS}, m AS (SELECT doc_id, line_no, regexp_matches(line, '!\[[^\]]*\]\([^)]+\)') AS figure, starts_with(ltrim(line), '|') AS is_table, regexp_matches(line, '\$\$|\\\[|\\begin\{{(equation|align)') AS formula, regexp_matches(line, '^\s*\[\^([^\]]+)\]:') AS note FROM lines)
    SELECT s.doc_id, s.start_line, bool_or(figure) AS figure, bool_or(is_table) AS is_table, bool_or(formula) AS formula, bool_or(note) AS note, CASE WHEN bool_or(figure) OR bool_or(is_table) OR bool_or(formula) OR bool_or(note) THEN 0.9 ELSE 0.8 END::DOUBLE AS confidence
    FROM sections s JOIN m ON m.doc_id = s.doc_id AND m.line_no BETWEEN s.start_line AND s.end_line GROUP BY s.doc_id, s.start_line""",
)
def section_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each section holds: figures, tables, formulas, notes; and how sure it is, by the kinds of evidence."""
    return features(semantic_of(spark, sf_dir))


def features(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    m = lines.select("doc_id", "line_no", line.rlike(M.IMAGE).alias("figure"), F.startswith(F.ltrim(line), F.lit("|")).alias("is_table"), line.rlike(M.FORMULA).alias("formula"), line.rlike(M.NOTE_DEFINITION).alias("note"))
    kinds = ("figure", "is_table", "formula", "note")
    held = sections(lines).select("doc_id", "start_line", "end_line").join(m, "doc_id").where("line_no BETWEEN start_line AND end_line")
    g = held.groupBy("doc_id", "start_line").agg(*(F.bool_or(k).alias(k) for k in kinds))
    return g.withColumn("confidence", F.when(F.array_contains(F.array(*kinds), True), 0.9).otherwise(0.8))


_TOC = rf"""{_HEADS}, hh AS (SELECT l.doc_id, l.line_no, l.line, h.level, regexp_matches(lower(h.title), 'contents|inhaltsverzeichnis|目录') AS toc FROM lines l LEFT JOIN heads h USING (doc_id, line_no)),
st AS (SELECT *, last_value(CASE WHEN level IS NOT NULL THEN CASE WHEN toc THEN level ELSE 0 END END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_mark, coalesce(max(CASE WHEN toc THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS opened FROM hh),
openings AS (SELECT doc_id, line_no AS opened, level AS toc_level FROM hh WHERE toc), closing AS (SELECT o.doc_id, o.opened, min(h.line_no) AS closed FROM openings o JOIN hh h ON h.doc_id = o.doc_id AND h.line_no > o.opened AND h.level <= o.toc_level GROUP BY o.doc_id, o.opened),
inside AS (SELECT s.doc_id, s.line_no, s.line FROM st s LEFT JOIN closing c USING (doc_id, opened) WHERE s.opened > 0 AND s.level IS NULL AND (c.closed IS NULL OR s.line_no < c.closed)),
entries AS (SELECT doc_id, line_no, lower(regexp_replace(trim(regexp_extract(line, '^\s*(?:[-*+]\s+|\d+[.)]\s+)?(.+?)\s+(\d{{1,4}})\s*$', 1)), '\s+', ' ', 'g')) AS entry, try_cast(regexp_extract(line, '^\s*(?:[-*+]\s+|\d+[.)]\s+)?(.+?)\s+(\d{{1,4}})\s*$', 2) AS BIGINT) AS page FROM inside)"""


@query(
    "printed_toc",
    rf"""WITH RECURSIVE {_TOC}, e AS (SELECT doc_id, entry, arg_max(page, line_no) AS page FROM entries WHERE page IS NOT NULL AND entry <> '' GROUP BY doc_id, entry),
    t AS (SELECT doc_id, lower(regexp_replace(title, '\s+', ' ', 'g')) AS entry, min(line_no) AS section_line FROM heads GROUP BY ALL) SELECT e.doc_id, e.entry, e.page, t.section_line FROM e LEFT JOIN t USING (doc_id, entry)""",
)
def printed_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the printed contents, of equal ones the last, with the section that has their title."""
    lines = semantic_of(spark, sf_dir)
    titles = headings(lines).groupBy("doc_id", F.lower(F.regexp_replace("title", r"\s+", " ")).alias("entry")).agg(F.min("line_no").alias("section_line"))
    return toc_entries(lines).join(titles, ["doc_id", "entry"], "left").select("doc_id", "entry", "page", "section_line")


def toc_entries(lines: DataFrame) -> DataFrame:
    """(doc_id, entry, page): lines that end in a number, from a heading of contents to the next heading of its level or a smaller one."""
    h = lines.withColumn("level", M.atx_level(F.col("visible")))
    toc = F.coalesce(F.lower(M.heading_title(F.col("visible"))).rlike("contents|inhaltsverzeichnis|目录") & F.col("level").isNotNull(), F.lit(False))
    run = _by_doc().rowsBetween(Window.unboundedPreceding, 0)
    opened = F.max(F.when(toc, F.struct("line_no", "level"))).over(run)
    h = h.withColumn("toc", toc).withColumn("opened", opened).where("opened IS NOT NULL")
    shut = F.col("level").isNotNull() & ~F.col("toc") & (F.col("level") <= F.col("opened.level"))
    closed = F.max(shut.cast("int")).over(Window.partitionBy("doc_id", "opened.line_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    inside = h.withColumn("closed", closed).where("closed = 0 AND level IS NULL")
    part = lambda k: F.regexp_extract("line", M.TOC_ENTRY, k)
    e = inside.select("doc_id", "line_no", F.lower(F.regexp_replace(F.trim(part(1)), r"\s+", " ")).alias("entry"), part(2).try_cast("bigint").alias("page")).where("page IS NOT NULL AND entry <> ''")
    return e.groupBy("doc_id", "entry").agg(F.max_by("page", "line_no").alias("page"))


@query(
    "markdown_shape",
    rf"""WITH RECURSIVE {_SEM}, f AS (SELECT l.doc_id, l.line_no, l.line, s.fenced, regexp_extract(l.line, '^\s*(#{{1,6}})([ \t]|$)', 1) AS hashes FROM lines l JOIN sem s USING (doc_id, line_no)),
    c AS (SELECT *, trim(line) <> '' AND hashes = '' AS content, lag(trim(line) <> '' AND hashes = '') OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM f)
    SELECT doc_id, coalesce(string_agg(CASE WHEN NOT fenced AND hashes <> '' THEN length(hashes)::VARCHAR END, ',' ORDER BY line_no), '') AS shape, count(*) FILTER (WHERE content AND NOT coalesce(before, FALSE)) AS content_blocks,
      sum(len(regexp_extract_all(line, '\\n')))::BIGINT AS escaped_breaks, sum(len(regexp_extract_all(lower(line), '<br\s*/?>')))::BIGINT AS tag_breaks FROM c GROUP BY doc_id""",
)
def markdown_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The levels of the headings in order, how many blocks of content there are, and the breaks that a line can hold."""
    l = semantic_of(spark, sf_dir).withColumn("hashes", F.regexp_extract("line", M.ATX, 1))
    content = (F.trim("line") != "") & (F.col("hashes") == "")
    l = l.withColumn("content", content).withColumn("begins", F.col("content") & ~F.coalesce(F.lag("content").over(_by_doc()), F.lit(False)))
    levels = F.transform(F.array_sort(F.collect_list(F.when(~F.col("fenced") & (F.col("hashes") != ""), F.struct("line_no", F.length("hashes").cast("string").alias("n"))))), lambda x: x["n"])
    count = lambda p: F.sum(F.regexp_count("line", F.lit(p))).cast("bigint")
    return l.groupBy("doc_id").agg(F.array_join(levels, ",").alias("shape"), F.count_if("begins").alias("content_blocks"), count(r"\\n").alias("escaped_breaks"), count(r"(?i)<br\s*/?>").alias("tag_breaks"))


@query(
    "markdown_counts",
    rf"""WITH RECURSIVE {_SEM.split(', sem AS (', 1)[0]}, fence AS (SELECT *, left(regexp_extract(line, '^\s*(```|~~~)', 1), 3) AS mark FROM lines),
    st AS (SELECT doc_id, 0::BIGINT AS line_no, ''::VARCHAR AS open, FALSE AS prose, 0 AS opens FROM src UNION ALL
      SELECT f.doc_id, f.line_no, CASE WHEN f.mark = '' THEN s.open WHEN s.open = '' THEN f.mark WHEN s.open = f.mark THEN '' ELSE s.open END, f.mark = '' AND s.open = '', (f.mark <> '' AND s.open = '')::INT FROM st s JOIN fence f ON f.doc_id = s.doc_id AND f.line_no = s.line_no + 1),
    p AS (SELECT l.doc_id, l.line, s.prose, s.opens, regexp_matches(lower(l.line), '^ {{0,3}}#{{1,6}}\s+page\s+\d+\s*$') AS scaffold, regexp_matches(l.line, '^ {{0,3}}#{{1,6}}\s+\S') AS heading, regexp_matches(l.line, '^\s*\|.*\|\s*$') AND NOT regexp_matches(l.line, '^\s*\|[\s:|-]*\|\s*$') AS table_row,
      len(regexp_extract_all(' ' || l.line, '[^!]\[[^\[\]\n]*\]\([^()\n]*\)')) + len(regexp_extract_all(l.line, '<[A-Za-z][A-Za-z0-9+.\-]*:[^ <>\n]+>')) AS links FROM lines l JOIN st s USING (doc_id, line_no))
    SELECT doc_id, count(*) FILTER (WHERE prose AND scaffold) AS scaffolding, count(*) FILTER (WHERE prose AND heading AND NOT scaffold) AS headings, count(*) FILTER (WHERE prose AND NOT scaffold AND NOT heading AND table_row) AS table_rows,
      sum(CASE WHEN prose THEN links ELSE 0 END)::BIGINT AS links, sum(opens)::BIGINT AS code_blocks, sum(length(regexp_replace(line, '[ \t\n\v\f\r\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]', '', 'g')))::BIGINT AS non_space FROM p GROUP BY doc_id""",
)
def markdown_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What there is in each document outside of its code: headings, headings of pages, rows of tables, links; with its code blocks and characters."""
    return counts(markdown_documents(spark, sf_dir))


def counts(docs: DataFrame) -> DataFrame:
    """Counts of docs (doc_id, lines). A fence here is any line that starts with three marks, and ends with the same three."""
    l = docs.select("doc_id", F.posexplode("lines").alias("i", "line")).withColumn("mark", F.substring(F.regexp_extract("line", r"^\s*(```|~~~)", 1), 1, 3))
    runs = fence_runs(l)
    line, prose = F.col("line"), F.col("prose")
    scaffold, heading = line.rlike(r"(?i)^ {0,3}#{1,6}\s+page\s+\d+\s*$"), line.rlike(r"^ {0,3}#{1,6}\s+\S")
    row = line.rlike(r"^\s*\|.*\|\s*$") & ~line.rlike(r"^\s*\|[\s:|-]*\|\s*$")
    links = F.regexp_count(line, F.lit(r"(?<!!)\[[^\[\]\n]*\]\([^()\n]*\)")) + F.regexp_count(line, F.lit(r"<[A-Za-z][A-Za-z0-9+.\-]*:[^ <>\n]+>"))
    non_space = F.length(F.regexp_replace(line, r"[ \t\n\x0b\f\r\x{00A0}\x{2000}-\x{200A}\x{3000}]", ""))
    return runs.groupBy("doc_id").agg(
        F.count_if(prose & scaffold).alias("scaffolding"), F.count_if(prose & heading & ~scaffold).alias("headings"), F.count_if(prose & ~scaffold & ~heading & row).alias("table_rows"),
        F.sum(F.when(prose, links).otherwise(0)).cast("bigint").alias("links"), F.count_if("opens").alias("code_blocks"), F.sum(non_space).cast("bigint").alias("non_space"),
    )


def fence_runs(lines: DataFrame) -> DataFrame:
    """lines (doc_id, i, line, mark) with prose and opens: a pass over the marks of a document alone, which are few, tells what opens and closes."""

    @F.pandas_udf("array<struct<i: int, opens: boolean, until: int>>")
    def spans(marks: pd.Series) -> pd.Series:
        def one(found: list) -> list[dict]:
            out: list[dict] = []
            open_, since = "", 0
            for m in found:
                if not open_:
                    open_, since = m["mark"], m["i"]
                elif m["mark"] == open_:
                    out.append({"i": since, "opens": True, "until": m["i"]})
                    open_ = ""
            return out + ([{"i": since, "opens": True, "until": None}] if open_ else [])

        return marks.map(one)

    prepare(lines.sparkSession)
    whole = Window.partitionBy("doc_id")
    # each line sees the last fence that opened at or above it
    marks = lines.where("mark <> ''").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "mark"))).alias("m")).select("doc_id", F.explode(spans("m")).alias("s")).select("doc_id", "s.*")
    both = lines.join(marks, ["doc_id", "i"], "left")
    last = F.last(F.when(F.col("opens"), F.struct("i", F.coalesce("until", F.lit((1 << 31) - 1)).alias("until"))), ignorenulls=True).over(whole.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    inside = F.coalesce(F.col("i") <= last["until"], F.lit(False))
    return both.withColumn("prose", ~inside & (F.col("mark") == "")).withColumn("opens", F.coalesce("opens", F.lit(False)))


def hard_bound(text: str, limit: int) -> Iterator[str]:
    """Pieces of at most `limit` bytes of UTF-8: cut after the last blank of the second half of what fits, else between characters."""
    data = text.encode("utf-8")
    at = 0
    while len(data) - at > limit:
        end = at + limit
        while data[end] & 0xC0 == 0x80:
            end -= 1
        piece = data[at:end].decode("utf-8")
        blank = next((k for k in range(len(piece) - 1, -1, -1) if piece[k].isspace()), -1)
        cut = at + len(piece[: blank + 1].encode("utf-8"))
        end = cut if blank >= 0 and cut - at >= limit // 2 else end
        yield data[at:end].decode("utf-8")
        at = end
    if at < len(data):
        yield data[at:].decode("utf-8")


def bounded(texts: Column, limit: int = 65536) -> Column:
    """array<string> of the pieces of a unit (array<struct<text, fenced>> of its atoms in order): fences stay whole, other atoms are cut and packed up to `limit` bytes."""

    @F.pandas_udf("array<string>")
    def pieces(units: pd.Series) -> pd.Series:
        def one(atoms: list) -> list[str]:
            out, cur = [], ""
            for a in atoms:
                for p in [a["text"]] if a["fenced"] else list(hard_bound(a["text"], limit)):
                    if cur and len((cur + p).encode("utf-8")) > limit:
                        out.append(cur)
                        cur = ""
                    cur += p
                    if len(p.encode("utf-8")) > limit:
                        out.append(cur)
                        cur = ""
            return [*out, cur] if cur else out

        return units.map(one)

    return pieces(texts)


@query("bounded_units")
def bounded_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters in units of at most 600 bytes each: how many, the largest, and whether together they are the chapter."""
    return bound_chapters(semantic_of(spark, sf_dir), 600).select("doc_id", "k", F.size("units").cast("bigint").alias("units"), F.array_max(F.transform("units", F.octet_length)).cast("bigint").alias("largest"), (F.array_join("units", "") == F.col("text")).alias("whole"), (F.size("fences") > 0).alias("fenced"))


def bound_chapters(lines: DataFrame, limit: int = 65536) -> DataFrame:
    """(doc_id, k, text, units, fences): chapters cut into units of at most `limit` bytes.

    Lines between fences are atoms that can be cut, a fence is one that can't; a fence that
    is larger than the limit is a unit of its own.
    """
    prepare(lines.sparkSession)
    l = _chapter_lines(lines).withColumn("change", F.coalesce(F.col("fenced") != F.lag("fenced").over(Window.partitionBy("doc_id", "k").orderBy("line_no")), F.lit(False)).cast("int"))
    l = l.withColumn("atom", F.sum("change").over(Window.partitionBy("doc_id", "k").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: F.concat(x["line"], F.lit("\n"))), "")
    atoms = l.groupBy("doc_id", "k", "atom").agg(F.max("fenced").alias("fenced"), text.alias("text"))
    g = atoms.groupBy("doc_id", "k").agg(F.array_sort(F.collect_list(F.struct("atom", "text", "fenced"))).alias("atoms"))
    each = F.transform("atoms", lambda a: F.struct(a["text"].alias("text"), a["fenced"].alias("fenced")))
    return g.select("doc_id", F.col("k").cast("bigint").alias("k"), F.array_join(F.transform("atoms", lambda a: a["text"]), "").alias("text"), bounded(each, limit).alias("units"), F.filter("atoms", lambda a: a["fenced"]).alias("fences"))


@query(
    "heading_groups",
    f"""WITH RECURSIVE {_CHAPTERS}, under AS (SELECT p.doc_id, p.k, p.line_no, h.level, min(CASE WHEN h.level > t.top THEN h.level END) OVER (PARTITION BY p.doc_id, p.k) AS deeper FROM placed p JOIN top t USING (doc_id) LEFT JOIN heads h USING (doc_id, line_no)),
    starts AS (SELECT doc_id, k, line_no, row_number() OVER (PARTITION BY doc_id, k ORDER BY line_no) AS r FROM under WHERE level = deeper)
    SELECT doc_id, k, count(*) AS boundaries, min(line_no) AS first_boundary, max(line_no) AS last_boundary FROM starts GROUP BY doc_id, k""",
)
def heading_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a chapter that is too large can be cut first: at its headings of the next deeper level."""
    l = _chapter_lines(semantic_of(spark, sf_dir)).select("doc_id", F.col("k").cast("bigint").alias("k"), "line_no", "level", "top")
    deeper = F.min(F.when(F.col("level") > F.col("top"), F.col("level"))).over(Window.partitionBy("doc_id", "k"))
    return l.withColumn("deeper", deeper).where("level = deeper").groupBy("doc_id", "k").agg(F.count("*").alias("boundaries"), F.min("line_no").alias("first_boundary"), F.max("line_no").alias("last_boundary"))
