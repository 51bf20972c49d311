"""Paged text: running heads, titles over two lines, sections set at the size of chapters.

Lines of documents in fives are pages here; by its number a line of a page becomes a
running head, a title, a folio or stays prose. The rules applied to them are the real ones,
as windows over the lines of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..registry import query
from ..sources.shared import materialise
from ..sources.tables import table

_PAGED = """CASE {i} % 5
 WHEN 0 THEN CASE WHEN {p} % 6 = 0 THEN '# ' || CASE ({p} - {p} % 6) % 18 WHEN 0 THEN 'Alpha Head' WHEN 6 THEN 'Beta Head' ELSE '2.1 Gamma Head' END
   WHEN {p} % 2 = 0 THEN '## ' || {p} || ' ' || CASE ({p} - {p} % 6) % 18 WHEN 0 THEN 'Alpha Head' WHEN 6 THEN 'Beta Head' ELSE 'Gamma Head' END
   ELSE CASE ({p} - {p} % 6) % 18 WHEN 0 THEN 'Alpha Head' WHEN 6 THEN '**Beta Head**' ELSE 'Gamma Head' END || ' ' || {p} END
 WHEN 1 THEN CASE {p} % 4 WHEN 1 THEN '# ' || left(x, 18) || CASE {p} % 3 WHEN 0 THEN ' of' WHEN 1 THEN ',' ELSE '' END WHEN 2 THEN '# 1.' || {p} || ' ' || left(x, 10) ELSE x END
 WHEN 2 THEN CASE {p} % 4 WHEN 1 THEN '# ' || left(x, 12) WHEN 3 THEN '## ' || left(x, 9) || ' -' ELSE x END
 WHEN 3 THEN CASE WHEN {p} % 4 = 1 THEN '# and ' || left(x, 5) WHEN {p} % 4 = 3 THEN '' ELSE x END
 ELSE CASE WHEN {p} % 2 = 0 THEN '' || {p} WHEN {p} % 3 = 0 THEN 'xiv' ELSE '## of ' || left(x, 6) END END"""

#: How running heads and titles over two lines are told.
NUMBER = r"(?:\d{1,4}|[mM]{0,4}(?:[cC][mMdD]|[dD]?[cC]{0,3})(?:[xX][cClL]|[lL]?[xX]{0,3})(?:[iI][xXvV]|[vV]?[iI]{0,3}))"
_NO = r"[^\p{L}\p{N}_]"
MIN_REPEATS, MIN_PAGES, MAX_HEAD_CHARS, MIN_DENSITY, MIN_STEM, NOT_A_HEADING, MIN_CHAPTERS = 3, 4, 120, 0.5, 3, 7, 2
SECTION_NUMBER = r"^\d{1,3}(?:(?:\.\d{1,3})*\.|(?:\.\d{1,3})+)(?:\s|$)"
CONTINUES = ("of", "and", "or", "nor", "but")
DANGLES = ("a", "an", "the", "of", "and", "or", "nor", "but", "to", "in", "on", "for", "with", "as", "at", "from", "by", "into", "over", "under", "between", "about", "against", "toward", "towards", "its", "their")


def paged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page from 1, line_no in the document from 1, line)."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split(F.replace("text", F.lit(". "), F.lit(".\n")), "\n")).alias("i", "x"))
    page = F.expr("CAST(floor(i / 5) AS BIGINT)")
    return d.withColumn("p", page).select("doc_id", (F.col("p") + 1).alias("page"), (F.col("i") + 1).cast("bigint").alias("line_no"), F.expr(_PAGED.format(i="i", p="p")).alias("line"))


_PLINES = f"""plines AS (SELECT doc_id, p + 1 AS page, (i + 1)::BIGINT AS line_no, {_PAGED.format(i='i', p='p')} AS line
  FROM (SELECT doc_id, i, l[i + 1] AS x, floor(i / 5)::BIGINT AS p FROM (SELECT doc_id, l, unnest(range(0, len(l))) AS i FROM (SELECT doc_id, string_split(replace(text, '. ', '.' || chr(10)), chr(10)) AS l FROM documents WHERE text IS NOT NULL))))"""


def bare_number(line: Column) -> Column:
    """Whether a line is a folio: an Arabic or a Roman number with nothing but marks around it."""
    return line.rlike(rf"^{_NO}*+(?=[\p{{L}}\p{{N}}_]){NUMBER}{_NO}*+$")


def head_key(line: Column) -> Column:
    """A line without what changes from page to page: hashes, stars, a number at either end, case, marks at the ends.

    That a number goes only if MIN_STEM characters stay is said in the patterns: the first match alone counts,
    and each step names the one before once, as Spark evaluates an expression again wherever it is named.
    """
    stem = F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.regexp_replace(line, "^#+", ""), F.lit("*"), F.lit("")), r"\x{00A0}", " "), r"\s+", " "))
    stem = F.regexp_replace(stem, rf"(?s)^(?>{_NO}*{NUMBER}{_NO}+)(?=.{{{MIN_STEM}}})", "")
    last = rf"{_NO}+{NUMBER}{_NO}*$"
    stem = F.regexp_replace(stem, rf"(?s)^(?!.{{0,{MIN_STEM - 1}}}{last})(.{{{MIN_STEM},}}?){last}", "$1")
    return F.regexp_replace(F.lower(stem), r"^[ .,:;\-—–_|]+|[ .,:;\-—–_|]+$", "")


def printed_level(line: Column) -> Column:
    """The level of a heading; beyond all of them for what is none."""
    n = F.length(F.regexp_extract(line, r"^(#{1,6})(?:\s|$)", 1))
    return F.when(n > 0, n).otherwise(NOT_A_HEADING).cast("bigint")


_BARE = rf"(regexp_matches(trim(line), '^{_NO}*{NUMBER}{_NO}*$') AND regexp_matches(line, '[\p{{L}}\p{{N}}_]'))"
_STEM0 = r"trim(regexp_replace(replace(replace(regexp_replace(line, '^#+', ''), '*', ''), chr(160), ' '), '\s+', ' ', 'g'))"
_EDGES = rf"""{_PLINES}, live AS (SELECT *, min(line_no) OVER (PARTITION BY doc_id, page) AS top, max(line_no) OVER (PARTITION BY doc_id, page) AS bottom FROM plines WHERE trim(line) <> '' AND NOT {_BARE}),
edges0 AS (SELECT doc_id, page, line_no, line, line_no = top AS opens, {_STEM0} AS s0 FROM live WHERE line_no IN (top, bottom)),
edges1 AS (SELECT *, regexp_replace(s0, '^{_NO}*{NUMBER}{_NO}+', '') AS c1 FROM edges0), edges2 AS (SELECT *, CASE WHEN length(c1) >= 3 THEN c1 ELSE s0 END AS s1 FROM edges1),
edges3 AS (SELECT *, regexp_replace(s1, '{_NO}+{NUMBER}{_NO}*$', '') AS c2 FROM edges2),
edges AS (SELECT doc_id, page, line_no, line, opens, regexp_replace(lower(CASE WHEN length(c2) >= 3 THEN c2 ELSE s1 END), '^[ .,:;\-—–_|]+|[ .,:;\-—–_|]+$', '', 'g') AS head,
  CASE WHEN regexp_extract(line, '^(#{{1,6}})(\s|$)', 1) <> '' THEN length(regexp_extract(line, '^(#{{1,6}})(\s|$)', 1)) ELSE 7 END::BIGINT AS level FROM edges3 WHERE length(trim(line)) <= 120)"""


@query("page_edges", f"WITH {_EDGES} SELECT doc_id, page, line_no, head, level, opens FROM edges WHERE head <> ''")
def page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last line of each page that could be a running head: its form and its printed size."""
    return edges_of(paged_lines(spark, sf_dir)).select("doc_id", "page", "line_no", "head", "level", "opens")


def edges_of(lines: DataFrame) -> DataFrame:
    """lines (doc_id, page, line_no, line) at the edge of a page, with head, level and opens; folios and blank lines are stepped over."""
    return _edge_lines(lines).where("head <> ''")


def _edge_lines(lines: DataFrame) -> DataFrame:
    """The same with those whose head is empty."""
    w = Window.partitionBy("doc_id", "page")
    # a column, not a filter: a filter would be moved into the making of the lines, which then would be made for each place that names them
    live = lines.withColumn("live", (F.trim("line") != "") & ~bare_number(F.trim("line")))
    live = live.withColumns({"top": F.min(F.when(F.col("live"), F.col("line_no"))).over(w), "bottom": F.max(F.when(F.col("live"), F.col("line_no"))).over(w)})
    edge = live.where(F.col("live") & ((F.col("line_no") == F.col("top")) | (F.col("line_no") == F.col("bottom")))).where(F.length(F.trim("line")) <= MAX_HEAD_CHARS)
    return edge.select("doc_id", "page", "line_no", "line", (F.col("line_no") == F.col("top")).alias("opens"), head_key(F.col("line")).alias("head"), printed_level(F.col("line")).alias("level"))


_RUNNING = f"""{_EDGES}, sizes AS (SELECT *, min(level) OVER (PARTITION BY doc_id, head) AS low FROM edges WHERE head <> '' AND doc_id IN (SELECT doc_id FROM plines GROUP BY doc_id HAVING count(DISTINCT page) >= 4)),
heads AS (SELECT doc_id, head, count(DISTINCT page) AS pages, count(DISTINCT page)::DOUBLE / (max(page) - min(page) + 1) AS density, CASE WHEN count(*) FILTER (WHERE level = low) = 1 AND max(level) > min(level) THEN min(level) END AS title_level
  FROM sizes GROUP BY doc_id, head HAVING count(DISTINCT page) >= 3 AND count(DISTINCT page)::DOUBLE / (max(page) - min(page) + 1) >= 0.5)"""


@query("running_heads", f"WITH {_RUNNING} SELECT doc_id, head, pages, round(density, 6) AS density, title_level FROM heads")
def running_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running heads of each document, how densely they stand, and the size of the one printing that is a title."""
    return heads_of(paged_lines(spark, sf_dir)).select("doc_id", "head", "pages", F.round("density", 6).alias("density"), "title_level")


def heads_of(lines: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(doc_id, head, pages, density, title_level): forms at the edge of at least three pages, dense among the pages that they span, in documents of at least four.

    The title level is the smallest one, if it was printed once and others are deeper. Edges
    are those of the lines, for callers that have them.
    """
    long = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("n")).where(F.col("n") >= MIN_PAGES).select("doc_id")
    e = (edges_of(lines) if edges is None else edges).join(long, "doc_id", "left_semi")
    times = F.coalesce(*(F.nullif(F.count_if(F.col("level") == k), F.lit(0)) for k in range(1, NOT_A_HEADING + 1)))  # how often the smallest level was printed
    h = e.groupBy("doc_id", "head").agg(F.countDistinct("page").alias("pages"), F.min("page").alias("first"), F.max("page").alias("last"), F.min("level").alias("low"), F.max("level").alias("high"), times.alias("times"))
    h = h.withColumn("density", F.col("pages") / (F.col("last") - F.col("first") + 1).cast("double")).where((F.col("pages") >= MIN_REPEATS) & (F.col("density") >= MIN_DENSITY))
    return h.select("doc_id", "head", "pages", "density", F.when((F.col("times") == 1) & (F.col("high") > F.col("low")), F.col("low")).alias("title_level"))


_KEPT = f"""{_RUNNING}, dropped AS (SELECT e.doc_id, e.line_no FROM edges e JOIN heads h USING (doc_id, head) WHERE h.title_level IS NULL OR e.level <> h.title_level), kept AS (SELECT p.* FROM plines p LEFT JOIN dropped d USING (doc_id, line_no) WHERE d.line_no IS NULL)"""


@query(
    "pages_without_heads",
    f"""WITH {_KEPT}, joined AS (SELECT doc_id, page, trim(string_agg(line, chr(10) ORDER BY line_no), ' ' || chr(10)) AS text, count(*) AS lines FROM kept GROUP BY doc_id, page)
    SELECT doc_id, page, lines, length(regexp_replace(text, '\\s', '', 'g')) AS non_space, md5('<!-- page: ' || page || ' -->' || chr(10) || chr(10) || text) AS page_md5 FROM joined WHERE text <> ''""",
)
def pages_without_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without their running heads, each under its anchor; blank ones are left out."""
    return pages_of_lines(without_heads(paged_lines(spark, sf_dir))).select("doc_id", "page", "lines", F.length(F.regexp_replace("text", r"\s", "")).cast("bigint").alias("non_space"), F.md5(F.concat(F.lit("<!-- page: "), F.col("page"), F.lit(" -->\n\n"), F.col("text"))).alias("page_md5"))


def without_heads(lines: DataFrame) -> DataFrame:
    """The lines that are no running head; the one printing of a head that is a title stays."""
    # written, so that heads are taken from lines once; those of a page go with the page, whose lines meet there next
    e = materialise(_edge_lines(lines).select("doc_id", "page", "line_no", "head", "level"), "edges").where("head <> ''")
    dropped = e.join(heads_of(lines, e).select("doc_id", "head", "title_level"), ["doc_id", "head"]).where("title_level IS NULL OR level <> title_level")
    gone = dropped.groupBy("doc_id", "page").agg(F.collect_set("line_no").alias("gone"))
    return lines.join(gone, ["doc_id", "page"], "left").where("gone IS NULL OR NOT array_contains(gone, line_no)").select(*lines.columns)


def pages_of_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, page, text, lines) of the pages that hold anything."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    p = lines.groupBy("doc_id", "page").agg(text.alias("text"), F.count("*").alias("lines"))
    return p.withColumn("text", F.btrim("text", F.lit(" \n"))).where("text <> ''")


def heading_parts(lines: DataFrame) -> DataFrame:
    """lines with level and title of strict headings, null for others."""
    level = F.length(F.regexp_extract("line", r"^(#{1,6})(?:[ \t]+.*)?$", 1))
    return lines.withColumns({"level": F.when(level > 0, level.cast("bigint")), "title": F.when(level > 0, F.trim(F.regexp_extract("line", r"^#{1,6}(?:[ \t]+(.*))?$", 1)))})


_HP = r"CASE WHEN regexp_extract(line, '^(#{1,6})([ \t]+.*)?$', 1) <> '' THEN length(regexp_extract(line, '^(#{1,6})([ \t]+.*)?$', 1)) END::BIGINT AS level, CASE WHEN regexp_extract(line, '^(#{1,6})([ \t]+.*)?$', 1) <> '' THEN trim(regexp_extract(line, '^#{1,6}(?:[ \t]+(.*))?$', 1)) END AS title"


def wraps_onto(first: Column, second: Column) -> Column:
    """Whether two titles are one over two lines: the first breaks off, or ends in a word that no title ends in, or the second goes on in a small one."""
    words = lambda c: F.regexp_extract_all(c, F.lit(r"(\p{L}+)"), F.lit(1))
    last, head = F.lower(F.try_element_at(words(first), F.lit(-1))), F.try_element_at(words(second), F.lit(1))
    return (first != "") & (second != "") & (first.rlike(r"[-‐-―,;:]$") | F.coalesce(last.isin(*DANGLES), F.lit(False)) | F.coalesce(head.isin(*CONTINUES), F.lit(False)))


_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_WRAPPED = rf"""{_PLINES}, parts AS (SELECT *, {_HP} FROM plines), live AS (SELECT *, lead(level) OVER w AS next_level, lead(title) OVER w AS next_title, lead(line_no) OVER w AS next_line FROM parts WHERE trim(line) <> '' WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_no)),
flags AS (SELECT *, coalesce(level = next_level AND title <> '' AND next_title <> '' AND (regexp_matches(title, '[-‐-―,;:]$') OR coalesce(lower(regexp_extract_all(title, '(\p{{L}}+)', 1)[-1]) IN {_IN(DANGLES)}, FALSE) OR coalesce(regexp_extract_all(next_title, '(\p{{L}}+)', 1)[1] IN {_IN(CONTINUES)}, FALSE)), FALSE) AS wraps FROM live),
runs AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) - coalesce(max(CASE WHEN NOT wraps THEN pos END) OVER (PARTITION BY doc_id, page ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS k FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS pos FROM flags)),
merged AS (SELECT *, wraps AND k % 2 = 1 AS merges FROM runs)"""


@query("wrapped_headings", f"WITH {_WRAPPED} SELECT doc_id, page, line_no, next_line, level, title || ' ' || next_title AS merged FROM merged WHERE merges")
def wrapped_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles printed over two lines, put together."""
    return wrapped(paged_lines(spark, sf_dir)).where("merges").select("doc_id", "page", "line_no", "next_line", "level", F.concat_ws(" ", "title", "next_title").alias("merged"))


def wrapped(lines: DataFrame) -> DataFrame:
    """Lines that aren't blank with level, title, next_line, next_title and merges, whether a heading takes in the next.

    Of a run of headings that each go on in the next, the first takes the second, the third
    the fourth: what was put together is not put together again.
    """
    w = Window.partitionBy("doc_id", "page").orderBy("line_no")
    live = heading_parts(lines).where(F.trim("line") != "")
    live = live.withColumns({f"next_{c}": F.lead(c).over(w) for c in ("level", "title")} | {"next_line": F.lead("line_no").over(w), "pos": F.row_number().over(w)})
    wraps = F.coalesce((F.col("level") == F.col("next_level")) & wraps_onto(F.col("title"), F.col("next_title")), F.lit(False))
    stop = F.coalesce(F.max(F.when(~F.col("wraps"), F.col("pos"))).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return live.withColumn("wraps", wraps).withColumn("merges", F.col("wraps") & ((F.col("pos") - stop) % 2 == 1))


_NUMBERED = r"regexp_matches(title, '^\d{1,3}((\.\d{1,3})*\.|(\.\d{1,3})+)(\s|$)')"


@query(
    "subsection_demote",
    rf"""WITH {_PLINES}, parts AS (SELECT *, {_HP} FROM plines), o AS (SELECT doc_id, page, min(line_no) AS line_no FROM plines WHERE trim(line) <> '' AND NOT {_BARE} GROUP BY doc_id, page),
    h AS (SELECT p.doc_id, p.page, p.line_no, p.level, p.title, o.line_no IS NOT NULL AS opens, min(level) OVER (PARTITION BY p.doc_id) AS top, {_NUMBERED} AS numbered FROM parts p LEFT JOIN o USING (doc_id, page, line_no) WHERE level IS NOT NULL),
    c AS (SELECT *, level = top AND opens AS opener, bool_or(level = top AND opens AND NOT numbered) OVER (PARTITION BY doc_id) AS unnumbered FROM h), k AS (SELECT *, opener AND NOT (unnumbered AND numbered) AS chapter FROM c),
    n AS (SELECT *, sum(chapter::INT) OVER (PARTITION BY doc_id) AS chapters, sum(chapter::INT) OVER r AS so_far, last_value(CASE WHEN level = top THEN chapter END IGNORE NULLS) OVER r AS under FROM k WINDOW r AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT doc_id, line_no, level, opens, chapter, CASE WHEN top < 6 AND chapters >= 2 AND so_far >= 1 AND NOT under THEN least(level + 1, 6) ELSE level END AS new_level FROM n""",
)
def subsection_demote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings at the size of chapters that open no page or are numbered like sections go one level down, with what is below them."""
    return demoted(paged_lines(spark, sf_dir))


def demoted(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, level, opens, chapter, new_level) of each heading.

    Chapters are the headings of the top level that open a page, without those with a dotted
    number unless all have one. Once there are two, what comes after the first chapter and
    is none goes down; headings before it stay.
    """
    whole, run, page = Window.partitionBy("doc_id"), Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("doc_id", "page")
    live = (F.trim("line") != "") & ~bare_number(F.trim("line"))
    h = heading_parts(lines).withColumn("opens", F.col("line_no") == F.min(F.when(live, F.col("line_no"))).over(page)).where("level IS NOT NULL")
    h = h.withColumns({"top": F.min("level").over(whole), "numbered": F.col("title").rlike(SECTION_NUMBER)})
    opener = (F.col("level") == F.col("top")) & F.col("opens")
    h = h.withColumn("unnumbered", F.max((opener & ~F.col("numbered")).cast("int")).over(whole) == 1)
    h = h.withColumn("chapter", opener & ~(F.col("unnumbered") & F.col("numbered")))
    n = F.col("chapter").cast("int")
    under = F.last(F.when(F.col("level") == F.col("top"), F.col("chapter")), ignorenulls=True).over(run)
    down = (F.col("top") < 6) & (F.sum(n).over(whole) >= MIN_CHAPTERS) & (F.sum(n).over(run) >= 1) & ~under
    return h.select("doc_id", "line_no", "level", "opens", "chapter", F.when(down, F.least(F.col("level") + 1, F.lit(6))).otherwise(F.col("level")).cast("bigint").alias("new_level"))


@query("page_scaffold", f"WITH {_PLINES} SELECT doc_id, page, md5('## Page ' || page || chr(10) || chr(10) || CASE WHEN trim(string_agg(line, '')) = '' THEN '_No text._' ELSE string_agg(line, chr(10) ORDER BY line_no) END) AS page_md5 FROM plines GROUP BY doc_id, page")
def page_scaffold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plainest conversion of a page: a heading with its number and its text, or a word for none."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    p = paged_lines(spark, sf_dir).groupBy("doc_id", "page").agg(text.alias("t"))
    body = F.when(F.regexp_replace("t", r"[\n ]", "") == "", "_No text._").otherwise(F.col("t"))
    return p.select("doc_id", "page", F.md5(F.concat(F.lit("## Page "), F.col("page"), F.lit("\n\n"), body)).alias("page_md5"))
