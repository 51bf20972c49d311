"""Lines, pages, sections and notes: order-dependent work as windows over (document, line).

The documents at hand are prose, so they are seated on Markdown first: sentences become
lines, and by its number a line becomes a heading, an anchor of a page, a row of a table,
part of a fence, a comment, a code span, a note or a reference to one. The rules that are
applied to those lines are the real ones. Conversations are paged documents elsewhere: a
turn is a page.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..registry import query
from ..sources.shared import prepare
from ..sources.tables import table

#: What a line x of a document becomes by its number {i}: the same words in both dialects.
_AS_MARKDOWN = """CASE ({i} + doc_id) % 30
 WHEN 1 THEN '# ' || left(x, 24) WHEN 2 THEN '' WHEN 4 THEN '<!-- page: ' || {i} || ' -->' WHEN 5 THEN '## ' || left(x, 16)
 WHEN 7 THEN x || ' [^' || ({i} % 3) || '] and [^n' || ({i} % 2) || ']' WHEN 8 THEN '| cell | ' || left(x, 8) || ' |' WHEN 9 THEN '| --- | --- |' WHEN 10 THEN '#### ' || left(x, 12)
 WHEN 11 THEN '```text' WHEN 12 THEN '# not a heading' WHEN 13 THEN '```' WHEN 15 THEN '[^' || ({i} % 4) || ']: ' || x WHEN 16 THEN '    ' || x
 WHEN 17 THEN 'before <!-- hidden ' || left(x, 5) WHEN 18 THEN '# hidden too --> after' WHEN 19 THEN 'an `open span' WHEN 20 THEN '# not one either` closed ' || left(x, 9)
 WHEN 21 THEN '![fig](img/' || {i} || '.png) [link](http://x.y/' || {i} || ') <http://a.b/c>' WHEN 22 THEN '## Contents' WHEN 23 THEN '- ' || left(x, 16) || '  ' || {i}
 WHEN 25 THEN CASE WHEN doc_id % 3 = 0 THEN '# Bibliography' ELSE '## ' || left(x, 20) END WHEN 26 THEN '## [^' || ({i} % 4) || ']: small note' WHEN 27 THEN '$$ x $$' WHEN 28 THEN '<!-- only -->'
 WHEN 29 THEN x || '<br>' ELSE x END"""


def markdown_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lines array<string>): documents as Markdown; a null text has no row."""
    lines = f"transform(split(replace(text, '. ', '.\\n'), '\\n'), (x, j) -> {_AS_MARKDOWN.format(i='(j + 1)')})"
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.expr(lines).alias("lines"))


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no from 1, line)."""
    d = markdown_documents(spark, sf_dir).select("doc_id", F.posexplode("lines").alias("i", "line"))
    return d.select("doc_id", (F.col("i") + 1).cast("bigint").alias("line_no"), "line")


def read_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, fenced, visible, touched) of docs (doc_id, lines): the state of each line beside it."""
    prepare(docs.sparkSession)
    return docs.select("doc_id", "lines").mapInArrow(M.flat_lines, M.LINE)


def read_marks(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, visible, n, held) of docs (doc_id, lines): the lines that may be headings or notes, and line 0 for each document.

    What sections and notes need of a document, in one pass over its lines; few lines are left to be shuffled.
    """
    prepare(docs.sparkSession)
    return docs.select("doc_id", "lines").mapInArrow(M.flat_marks, M.MARK)


def semantic_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_lines(markdown_documents(spark, sf_dir))


def marks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_marks(markdown_documents(spark, sf_dir))


def _marks(lines: DataFrame) -> DataFrame:
    """Marks as they are, or those of lines."""
    if "held" in lines.columns:
        return lines
    filled = F.trim("line") != ""
    above = F.count_if(filled & M.page_anchor(F.col("line")).isNull()).over(_by_doc().rowsBetween(Window.unboundedPreceding, -1))
    own = lines.select("doc_id", "line_no", "visible", F.max("line_no").over(Window.partitionBy("doc_id")).alias("n"), above.alias("held"))
    whole = lines.groupBy("doc_id").agg(F.lit(0).cast("bigint").alias("line_no"), F.lit("").alias("visible"), F.max("line_no").alias("n"), F.count_if(filled).alias("held"))
    return own.where(M.atx_level(F.col("visible")).isNotNull() | F.contains("visible", F.lit("[^"))).unionByName(whole)


_LINES = f"""src AS (SELECT doc_id, string_split(replace(text, '. ', '.' || chr(10)), chr(10)) AS l FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, i::BIGINT AS line_no, {_AS_MARKDOWN.format(i='i')} AS line FROM (SELECT doc_id, l[i] AS x, i FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM src)))"""

#: The state of each line, one after the other; code spans here are of one backtick, as in the lines above.
_SEM = f"""{_LINES}, sem AS (
 SELECT doc_id, 0::BIGINT AS line_no, ''::VARCHAR AS mark, FALSE AS com, FALSE AS code, FALSE AS fenced, ''::VARCHAR AS visible, FALSE AS touched FROM src
 UNION ALL
 SELECT doc_id, line_no, CASE WHEN mark <> '' THEN CASE WHEN closes THEN '' ELSE mark END WHEN opens THEN fence ELSE '' END,
   CASE WHEN mark <> '' THEN com ELSE com2 END, CASE WHEN mark <> '' OR opens THEN code ELSE code2 END, mark <> '' OR opens,
   CASE WHEN mark <> '' OR opens THEN '' ELSE vis END, NOT (mark <> '' OR opens) AND (com OR vis <> line)
 FROM (SELECT *, regexp_extract(seen, '^ {{0,3}}(```+|~~~+)', 1) AS fence, regexp_matches(seen, '^ {{0,3}}(```+[^`]*|~~~+.*)$') AS opens, regexp_matches(line, '^ {{0,3}}(```+|~~~+)\\s*$') AND left(trim(line), 1) = left(mark, 1) AND length(regexp_extract(line, '(`+|~+)', 1)) >= length(mark) AS closes,
   CASE WHEN c0 AND NOT contains(seen, '`') THEN '' ELSE regexp_replace(regexp_replace(s0, '`[^`]*`', '', 'g'), '`.*$', '') END AS vis,
   CASE WHEN c0 AND NOT contains(seen, '`') THEN TRUE ELSE contains(regexp_replace(s0, '`[^`]*`', '', 'g'), '`') END AS code2
  FROM (SELECT *, code AS c0, CASE WHEN code THEN regexp_replace(seen, '^[^`]*`', '') ELSE seen END AS s0
   FROM (SELECT *, CASE WHEN com AND NOT contains(line, '-->') THEN '' ELSE regexp_replace(regexp_replace(l0, '<!--.*?-->', '', 'g'), '<!--.*$', '') END AS seen,
      CASE WHEN com AND NOT contains(line, '-->') THEN TRUE ELSE contains(regexp_replace(l0, '<!--.*?-->', '', 'g'), '<!--') END AS com2
    FROM (SELECT s.doc_id, l.line_no, l.line, s.mark, s.com, s.code, CASE WHEN s.com THEN regexp_replace(l.line, '^.*?-->', '') ELSE l.line END AS l0 FROM sem s JOIN lines l ON l.doc_id = s.doc_id AND l.line_no = s.line_no + 1)))))"""
_ATX = r"regexp_extract(visible, '^\s*(#{1,6})([ \t]|$)', 1)"
_HEADS = f"""{_SEM}, heads AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(visible, '^\\s*#+', ''), '^\\s+|\\s+$', '', 'g') AS title, length({_ATX})::BIGINT AS level FROM sem WHERE {_ATX} <> '')"""


def headings_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, title, level): headings that a reader sees."""
    return headings(marks_of(spark, sf_dir))


def headings(lines: DataFrame) -> DataFrame:
    level = M.atx_level(F.col("visible"))
    return lines.select("doc_id", "line_no", M.heading_title(F.col("visible")).alias("title"), level.alias("level")).where("level IS NOT NULL")


def _by_doc(*order: str) -> Window:
    return Window.partitionBy("doc_id").orderBy(*(order or ("line_no",)))


_ANCHOR = r"try_cast(regexp_extract(line, '^\s*<!--\s*page:\s*(\d+)\s*-->\s*$', 1) AS BIGINT)"


@query("page_fill_forward", f"WITH {_LINES} SELECT doc_id, line_no, last_value({_ANCHOR} IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS page FROM lines")
def page_fill_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of each line: that of the last anchor at or above it."""
    return lines_of(spark, sf_dir).select("doc_id", "line_no", page_of().alias("page"))


def page_of() -> Column:
    return F.last(M.page_anchor(F.col("line")), ignorenulls=True).over(_by_doc().rowsBetween(Window.unboundedPreceding, 0))


@query(
    "markdown_lines",
    rf"""WITH RECURSIVE {_SEM}, refs AS (SELECT doc_id, line_no, regexp_extract_all(regexp_replace(visible, '\[\^[^\]]+\]:', '', 'g'), '\[\^([^\]]+)\]', 1) AS refs FROM sem)
    SELECT s.doc_id, s.line_no, s.fenced, s.visible, nullif(length({_ATX}), 0)::BIGINT AS level, CASE WHEN {_ATX} <> '' THEN regexp_replace(regexp_replace(s.visible, '^\s*#+', ''), '^\s+|\s+$', '', 'g') END AS title, {_ANCHOR.replace('line,', 'l.line,')} AS anchor,
      nullif(regexp_extract(s.visible, '^\s*\[\^([^\]]+)\]:', 1), '') AS defines, array_to_string(r.refs, ',') AS refers,
      CASE WHEN NOT s.fenced AND NOT s.touched THEN nullif(regexp_extract(l.line, '^ {{0,3}}#{{1,6}}\s+(\[\^[^\]\s]+\]:.*)$', 1), '') END AS repaired
    FROM sem s JOIN lines l USING (doc_id, line_no) JOIN refs r USING (doc_id, line_no)""",
)
def markdown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each line is: fenced or not, what of it can be seen, heading, anchor, note; a note that was taken for a heading, without its hashes."""
    v = F.col("visible")
    level = M.atx_level(v)
    repaired = F.when(~F.col("fenced") & ~F.col("touched"), F.nullif(F.regexp_extract("line", M.NOTE_HEADING, 1), F.lit("")))
    return semantic_of(spark, sf_dir).select(
        "doc_id", "line_no", "fenced", "visible", level.alias("level"), F.when(level.isNotNull(), M.heading_title(v)).alias("title"), M.page_anchor(F.col("line")).alias("anchor"),
        M.note_definition(v).alias("defines"), F.array_join(M.note_references(v), ",").alias("refers"), repaired.alias("repaired"),
    )


_ABOVE = ", ".join(f"max(CASE WHEN level = {k} THEN line_no END) OVER w AS l{k}" for k in range(1, 6))


@query(
    "heading_parents",
    f"""WITH RECURSIVE {_HEADS}, a AS (SELECT *, {_ABOVE} FROM heads WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT doc_id, line_no, level, CASE level WHEN 1 THEN NULL {" ".join(f"WHEN {k} THEN greatest({', '.join(f'l{m}' for m in range(1, k))})" for k in range(2, 7))} END AS parent_line FROM a""",
)
def heading_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest heading above that is of a smaller level: one running maximum for each level."""
    return parents(headings_of(spark, sf_dir)).select("doc_id", "line_no", "level", "parent_line")


def parents(heads: DataFrame, levels: int = 6) -> DataFrame:
    """heads (doc_id, line_no, level) with parent_line."""
    w = _by_doc().rowsBetween(Window.unboundedPreceding, -1)
    seen = {k: F.max(F.when(F.col("level") == k, F.col("line_no"))).over(w) for k in range(1, levels)}
    out = F.lit(None).cast("bigint")
    for k in range(2, levels + 1):
        above = [seen[j] for j in range(1, k)]
        out = F.when(F.col("level") == k, F.greatest(*above) if len(above) > 1 else above[0]).otherwise(out)
    return heads.withColumn("parent_line", out)


_NEXT = ", ".join(f"min(CASE WHEN level <= {k} THEN line_no END) OVER w AS n{k}" for k in range(1, 7))
_SECTIONS = f"""{_HEADS}, total AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id), nxt AS (SELECT doc_id, line_no, title, level, {_NEXT}
  FROM heads WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
sections AS (SELECT doc_id, line_no AS start_line, title, level, coalesce(CASE level {" ".join(f"WHEN {k} THEN n{k}" for k in range(1, 7))} END - 1, n)::BIGINT AS end_line FROM nxt JOIN total USING (doc_id))"""


def sections_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start_line, end_line, title, level): a section ends before the next heading of its level or a smaller one, else with the document."""
    return sections(marks_of(spark, sf_dir))


def sections(lines: DataFrame) -> DataFrame:
    h = _marks(lines).withColumn("level", M.atx_level(F.col("visible"))).where("level IS NOT NULL")
    return h.select("doc_id", F.col("line_no").alias("start_line"), M.heading_title(F.col("visible")).alias("title"), "level", F.coalesce(_section_end(), "n").alias("end_line"))


def _section_end() -> Column:
    """The line before the next heading of the level of this one or a smaller, null if there is none: one running minimum for each level."""
    w = _by_doc().rowsBetween(1, Window.unboundedFollowing)
    end = F.lit(None).cast("bigint")
    for k in range(1, 7):
        end = F.when(F.col("level") == k, F.min(F.when(F.col("level") <= k, F.col("line_no"))).over(w) - 1).otherwise(end)
    return end


@query("section_ranges", f"WITH RECURSIVE {_SECTIONS} SELECT doc_id, start_line, end_line, level FROM sections")
def section_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last line of each section."""
    return sections_of(spark, sf_dir).select("doc_id", "start_line", "end_line", "level")


def _kind_sql(what: int) -> str:
    """The kind (0) or role (1) of a heading, in SQL."""
    cases = []
    for row in M.KINDS:
        tests = [f"contains(lower(title), '{p}')" for p in row[2]] + [f"lower(title) = '{w}'" for w in row[3]] + [f"starts_with(lower(title), '{s}')" for s in row[4]] + [f"ends_with(lower(title), '{e}')" for e in row[5]]
        cases.append(f"WHEN {' OR '.join(tests)} THEN '{row[what]}'")
    return f"CASE {' '.join(cases)} {'WHEN level = top THEN ' + repr('chapter') + ' ELSE ' + repr('section') if what == 0 else 'ELSE ' + repr('bodymatter')} END"


_ROLE_STEPS = f"""k AS (SELECT *, min(level) OVER (PARTITION BY doc_id) AS top FROM heads), roles AS (SELECT *, {_kind_sql(0)} AS kind, {_kind_sql(1)} AS own FROM k),
sticky AS (SELECT *, CASE WHEN max(CASE WHEN own = 'backmatter' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 THEN 'backmatter' ELSE own END AS role FROM roles)"""


@query(
    "sections_sticky_role",
    rf"""WITH RECURSIVE {_HEADS}, {_ROLE_STEPS} SELECT doc_id, line_no, kind, role, regexp_matches(lower(trim(title)), '^(|continuation|continuation .*|(chapter|unit|section)[_-][0-9]+)$') AS internal FROM sticky""",
)
def sections_sticky_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds and roles of sections by their titles; once the back matter has begun it goes on."""
    return roles(headings_of(spark, sf_dir)).select("doc_id", "line_no", "kind", "role", M.internal_title(F.col("title")).alias("internal"))


def roles(heads: DataFrame) -> DataFrame:
    """heads (doc_id, line_no, title, level) with kind and role."""
    k = heads.withColumn("_k", M.heading_kind(F.col("title"), F.col("level"), F.min("level").over(Window.partitionBy("doc_id"))))
    begun = F.max((F.col("_k.role") == "backmatter").cast("int")).over(_by_doc().rowsBetween(Window.unboundedPreceding, 0)) == 1
    return k.withColumns({"kind": F.col("_k.kind"), "role": F.when(begun, "backmatter").otherwise(F.col("_k.role"))}).drop("_k")


@query(
    "recovered_sections",
    f"""WITH RECURSIVE {_SECTIONS}, {_ROLE_STEPS}, first AS (SELECT l.doc_id, min(h.line_no) AS head_line, count(*) FILTER (WHERE l.line_no < h.line_no AND trim(l.line) <> '' AND {_ANCHOR} IS NULL) AS held FROM lines l LEFT JOIN (SELECT doc_id, min(line_no) AS line_no FROM heads GROUP BY doc_id) h ON h.doc_id = l.doc_id GROUP BY l.doc_id),
    every AS (SELECT s.doc_id, s.start_line, s.end_line, s.title, s.level, t.kind, t.role, 0.8::DOUBLE AS confidence FROM sections s JOIN sticky t ON t.doc_id = s.doc_id AND t.line_no = s.start_line
      UNION ALL SELECT doc_id, 1, head_line - 1, 'Front Matter', (SELECT min(level) FROM heads h WHERE h.doc_id = first.doc_id), 'frontmatter', 'frontmatter', 0.7 FROM first WHERE head_line > 1 AND held > 0
      UNION ALL SELECT f.doc_id, 1, t.n, 'Body', 1, 'chapter', 'bodymatter', 0.7 FROM first f JOIN total t USING (doc_id) WHERE head_line IS NULL AND EXISTS (SELECT 1 FROM lines l WHERE l.doc_id = f.doc_id AND trim(l.line) <> ''))
    SELECT doc_id, 'section_' || lpad(o::VARCHAR, 3, '0') AS section_id, start_line, end_line, title, level, kind, role, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_line) AS o FROM every)""",
)
def recovered_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of each document: what its headings begin, what can be read before the first, and the whole where there is none."""
    return recover(marks_of(spark, sf_dir))


def recover(lines: DataFrame) -> DataFrame:
    """(doc_id, section_id, start_line, end_line, title, level, kind, role, confidence).

    Line 0 of a document becomes what stands before its first heading, or the whole where
    there is none; headings and that go through the same windows, by document, once.
    """
    m = _marks(lines).withColumn("level", M.atx_level(F.col("visible"))).where("level IS NOT NULL OR line_no = 0")
    whole, order = Window.partitionBy("doc_id"), _by_doc()
    m = m.withColumns({"top": F.min("level").over(whole), "at": F.min(F.when(F.col("level").isNotNull(), F.struct("line_no", "held"))).over(whole), "end": _section_end()})
    m = m.withColumns({"title": M.heading_title(F.col("visible")), "_k": M.heading_kind(M.heading_title(F.col("visible")), F.col("level"), F.col("top"))})
    begun = F.max(F.when(F.col("level").isNotNull() & (F.col("_k.role") == "backmatter"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1
    row = lambda *values: F.struct(*(v.alias(n) for v, n in zip(values, ("start_line", "end_line", "title", "level", "kind", "role", "confidence"), strict=True)))
    line, text = lambda x: F.lit(x).cast("bigint"), F.lit
    own = row(F.col("line_no"), F.coalesce("end", "n"), F.col("title"), F.col("level"), F.col("_k.kind"), F.when(begun, "backmatter").otherwise(F.col("_k.role")), F.lit(0.8))
    front = row(line(1), F.col("at.line_no") - 1, text("Front Matter"), F.col("top"), text("frontmatter"), text("frontmatter"), F.lit(0.7))
    body = row(line(1), F.col("n"), text("Body"), line(1), text("chapter"), text("bodymatter"), F.lit(0.7))
    s = F.when(F.col("level").isNotNull(), own).when((F.col("at.line_no") > 1) & (F.col("at.held") > 0), front).when(F.col("at").isNull() & (F.col("held") > 0), body)
    every = m.select("doc_id", s.alias("s")).where("s IS NOT NULL").select("doc_id", "s.*")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("start_line")).cast("string")
    return every.withColumn("section_id", F.concat(F.lit("section_"), F.lpad(place, 3, "0"))).select("doc_id", "section_id", "start_line", "end_line", "title", "level", "kind", "role", "confidence")


_NOTES = r"""defs AS (SELECT doc_id, line_no, nullif(regexp_extract(visible, '^\s*\[\^([^\]]+)\]:', 1), '') AS label FROM sem), notes AS (SELECT doc_id, line_no AS note_line, label FROM defs WHERE label IS NOT NULL)"""


@query(
    "section_of_range",
    f"WITH RECURSIVE {_SECTIONS}, {_NOTES} SELECT n.doc_id, n.note_line, arg_max(s.start_line, s.level * 1000000 + s.start_line) AS section_line FROM notes n JOIN sections s ON s.doc_id = n.doc_id AND n.note_line BETWEEN s.start_line AND s.end_line GROUP BY n.doc_id, n.note_line",
)
def section_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest section that holds the definition of a note."""
    owned = with_owner(marks_of(spark, sf_dir)).where(M.note_definition(F.col("visible")).isNotNull() & F.col("owner").isNotNull())
    return owned.select("doc_id", F.col("line_no").alias("note_line"), F.col("owner.line_no").alias("section_line"))


def with_owner(marks: DataFrame) -> DataFrame:
    """marks with owner, struct(level, line_no, title): the deepest section that holds the line.

    A heading closes the sections of its level and deeper ones, and stays open until such
    a heading follows; so the last heading at or above a line is open there, and every other
    that is open has a smaller level. One running value finds it, without a join of ranges.
    """
    level = M.atx_level(F.col("visible"))
    heading = F.when(level.isNotNull(), F.struct(level.alias("level"), "line_no", M.heading_title(F.col("visible")).alias("title")))
    return marks.withColumn("owner", F.last(heading, ignorenulls=True).over(_by_doc().rowsBetween(Window.unboundedPreceding, 0)))


def _open_ranges(ranges: pd.Series) -> pd.Series:
    """Of each document's ranges the places from which on another one is the deepest that is open, by a sweep over starts and ends."""

    def sweep(held) -> list[dict]:
        every = [(int(r["level"]), int(r["start_line"]), int(r["end_line"]), str(r["id"])) for r in held if r["start_line"] is not None and r["end_line"] is not None and r["start_line"] <= r["end_line"]]
        starts, begun, heap, out = sorted(every, key=lambda r: r[1]), 0, [], []
        for at in sorted({r[1] for r in every} | {r[2] + 1 for r in every}):
            while begun < len(starts) and starts[begun][1] <= at:
                level, start, end, name = starts[begun]
                heapq.heappush(heap, (-level, -start, [-ord(c) for c in name], end, name))
                begun += 1
            while heap and heap[0][3] < at:  # what has ended goes once it comes to the top
                heapq.heappop(heap)
            out.append({"at": at, "id": heap[0][4] if heap else None})
        return out

    return ranges.map(lambda held: sweep(held) if held is not None else [])


def deepest_section(lines: DataFrame, sections: DataFrame) -> DataFrame:
    """lines (doc_id, line, ...) with deepest: the id of the section (doc_id, id, start_line, end_line, level) of the largest level, of these the last, of these the last by id, that holds the line; null if none does.

    For sections of any ranges, nested or not. The ranges of a document become the places
    where its deepest open section changes, two for a range at most; lines and places are
    sorted together and a line has what the last place at or above it says. Nothing is
    joined by range.
    """
    prepare(lines.sparkSession)
    change = F.pandas_udf(_open_ranges, "array<struct<at: bigint, id: string>>")
    places = sections.groupBy("doc_id").agg(F.collect_list(F.struct("start_line", "end_line", "level", F.col("id").cast("string").alias("id"))).alias("r")).select("doc_id", F.explode(change("r")).alias("c"))
    own = lines.withColumn("_row", F.struct(*lines.columns)).select("doc_id", F.col("line").cast("bigint").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("struct<id: string>").alias("_c"), "_row")
    both = own.unionByName(places.select("doc_id", F.col("c.at").alias("_at"), F.lit(0).alias("_kind"), F.struct("c.id").alias("_c")), allowMissingColumns=True)
    last = F.last("_c", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_last", last).where("_kind = 1").select("_row.*", F.col("_last.id").alias("deepest"))


@query(
    "interval_overlap",
    """SELECT a.l_orderkey AS key, a.l_linenumber AS line, b.l_linenumber AS other FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber
    AND a.l_shipdate <= b.l_shipdate + INTERVAL 5 DAY AND b.l_shipdate <= a.l_shipdate + INTERVAL 5 DAY""",
)
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of one document that overlap."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("s"), (F.col("l_shipdate") + F.expr("INTERVAL 5 DAYS")).alias("e"))
    a, b = l.alias("a"), l.alias("b")
    out = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.line") < F.col("b.line")) & (F.col("a.s") <= F.col("b.e")) & (F.col("b.s") <= F.col("a.e")))
    return out.select(F.col("a.l_orderkey").alias("key"), F.col("a.line").alias("line"), F.col("b.line").alias("other"))


_REFS = r"refs AS (SELECT doc_id, line_no, label, k FROM (SELECT doc_id, line_no, unnest(r) AS label, unnest(range(1, len(r) + 1)) AS k FROM (SELECT doc_id, line_no, regexp_extract_all(regexp_replace(visible, '\[\^[^\]]+\]:', '', 'g'), '\[\^([^\]]+)\]', 1) AS r FROM sem)))"


@query(
    "note_join",
    f"""WITH RECURSIVE {_SECTIONS}, {_NOTES}, {_REFS},
    d AS (SELECT doc_id, label, max(note_line) AS def_line, count(*) AS defs FROM notes GROUP BY doc_id, label), r AS (SELECT doc_id, label, count(*) AS refs, min(line_no * 1000 + k) AS first_ref FROM refs GROUP BY doc_id, label),
    j AS (SELECT coalesce(d.doc_id, r.doc_id) AS doc_id, coalesce(d.label, r.label) AS label, def_line, coalesce(refs, 0) AS refs, first_ref FROM d FULL JOIN r ON r.doc_id = d.doc_id AND r.label = d.label),
    a AS (SELECT *, coalesce(def_line, first_ref // 1000) AS anchor, row_number() OVER (PARTITION BY doc_id ORDER BY first_ref NULLS LAST, def_line) AS ordinal FROM j),
    o AS (SELECT a.doc_id, a.label, arg_max(s.title, s.level * 1000000 + s.start_line) AS section, max(s.level * 1000000 + s.start_line) % 1000000 AS section_line FROM a JOIN sections s ON s.doc_id = a.doc_id AND a.anchor BETWEEN s.start_line AND s.end_line GROUP BY a.doc_id, a.label)
    SELECT a.doc_id, a.label, a.ordinal, a.def_line, a.refs, o.section_line,
      CASE WHEN starts_with(lower(a.label), 'editor') THEN 'editorial' WHEN starts_with(lower(a.label), 'end') OR coalesce(regexp_matches(lower(o.section), 'notes|anmerkungen|注释'), FALSE) THEN 'endnote' ELSE 'footnote' END AS kind,
      CASE WHEN a.def_line IS NULL THEN 'note definition is missing' WHEN a.refs = 0 THEN 'note has no references' ELSE '' END AS anomaly FROM a LEFT JOIN o USING (doc_id, label)""",
)
def note_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes of each document: references and definitions side by side, what is missing on either side marked."""
    return notes_of(marks_of(spark, sf_dir))


def notes_of(lines: DataFrame) -> DataFrame:
    """(doc_id, label, ordinal, def_line, refs, section_line, kind, anomaly).

    Labels come in the order of their first reference, then those that are only defined; of
    several definitions the last counts. A note belongs to the deepest section that holds
    its definition, or else its first reference.
    """
    v, level = F.col("visible"), M.atx_level(F.col("visible"))
    # the last heading at or above a line, and whether it is one of notes, as one number: it rises with the line, so that of the last definition is the largest
    heading = F.when(level.isNotNull(), F.col("line_no") * 2 + F.lower(M.heading_title(v)).rlike("notes|anmerkungen|注释").cast("bigint"))
    marked = _marks(lines).withColumn("owner", F.coalesce(F.last(heading, ignorenulls=True).over(_by_doc().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    defined, no = M.note_definition(v), F.lit(None).cast("bigint")
    every = F.concat(F.array_compact(F.array(F.when(defined.isNotNull(), F.struct(defined.alias("label"), no.alias("spot"))))), F.transform(M.note_references(v), lambda x, k: F.struct(x.alias("label"), (F.shiftleft("line_no", 20) + k).alias("spot"))))
    each = marked.select("doc_id", "line_no", "owner", F.explode(every).alias("x")).select("doc_id", "line_no", "owner", "x.label", "x.spot")
    isdef = F.col("spot").isNull()
    # the window above has dealt the lines by document; notes and their order need no further shuffle, and sums of numbers no sort
    j = each.groupBy("doc_id", "label").agg(F.max(F.when(isdef, F.col("line_no"))).alias("def_line"), F.max(F.when(isdef, F.col("owner"))).alias("def_owner"), F.count("spot").alias("refs"), F.min("spot").alias("first"), F.min(F.when(~isdef, F.col("owner"))).alias("first_owner"))
    order = Window.partitionBy("doc_id").orderBy(F.col("first").asc_nulls_last(), "def_line")
    a = j.select("doc_id", "label", "def_line", "refs", F.row_number().over(order).cast("bigint").alias("ordinal"), F.coalesce("def_owner", "first_owner").alias("owner"))
    low = F.lower("label")
    kind = F.when(F.startswith(low, F.lit("editor")), "editorial").when(F.startswith(low, F.lit("end")) | (F.col("owner") % 2 == 1), "endnote").otherwise("footnote")
    anomaly = F.when(F.col("def_line").isNull(), "note definition is missing").when(F.col("refs") == 0, "note has no references").otherwise("")
    return a.select("doc_id", "label", "ordinal", "def_line", "refs", F.when(F.col("owner") > 0, F.shiftright("owner", 1)).alias("section_line"), kind.alias("kind"), anomaly.alias("anomaly"))


@query(
    "tree_findings",
    f"WITH RECURSIVE {_HEADS}, j AS (SELECT doc_id, line_no, level, lag(level) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM heads) SELECT doc_id, line_no, CASE WHEN before IS NULL THEN 'starts_below_top' ELSE 'level_jump' END AS finding FROM j WHERE level > coalesce(before, 0) + 1",
)
def tree_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings that skip a level."""
    before = F.lag("level").over(_by_doc())
    j = headings_of(spark, sf_dir).select("doc_id", "line_no", "level", before.alias("before"))
    return j.where("level > coalesce(before, 0) + 1").select("doc_id", "line_no", F.when(F.col("before").isNull(), "starts_below_top").otherwise("level_jump").alias("finding"))


@query(
    "structure_audit",
    f"WITH RECURSIVE {_SECTIONS} SELECT doc_id, count(*) AS nodes, max(level) AS max_level, count(*) FILTER (WHERE level = 1) AS chapters, count(*) FILTER (WHERE end_line = start_line) AS empty_nodes, count(DISTINCT title) AS titles FROM sections GROUP BY doc_id",
)
def structure_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over the sections of each document."""
    s = sections_of(spark, sf_dir)
    return s.groupBy("doc_id").agg(F.count("*").alias("nodes"), F.max("level").alias("max_level"), F.count_if(F.col("level") == 1).alias("chapters"), F.count_if(F.col("end_line") == F.col("start_line")).alias("empty_nodes"), F.countDistinct("title").alias("titles"))


@query(
    "page_islands",
    """WITH p AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role <> 'system' AND length(text) % 4 <> 0), g AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM p)
    SELECT conv_id, min(turn) AS first_page, max(turn) AS last_page, CASE WHEN min(turn) = max(turn) THEN min(turn)::VARCHAR ELSE min(turn) || '-' || max(turn) END AS label FROM g GROUP BY conv_id, island""",
)
def page_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive pages."""
    p = table(spark, sf_dir, "conversations").where("role <> 'system' AND length(text) % 4 <> 0").select("conv_id", "turn").distinct()
    g = p.withColumn("island", F.col("turn") - F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    out = g.groupBy("conv_id", "island").agg(F.min("turn").alias("first_page"), F.max("turn").alias("last_page"))
    label = F.when(F.col("first_page") == F.col("last_page"), F.col("first_page").cast("string")).otherwise(F.concat_ws("-", "first_page", "last_page"))
    return out.select("conv_id", "first_page", "last_page", label.alias("label"))


@query("line_offsets", f"WITH {_LINES} SELECT doc_id, line_no, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(line) - 1)::BIGINT AS start FROM lines")
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The character at which each line starts."""
    total = F.sum(F.length("line") + 1).over(_by_doc().rowsBetween(Window.unboundedPreceding, 0))
    return lines_of(spark, sf_dir).select("doc_id", "line_no", (total - F.length("line") - 1).cast("bigint").alias("start"))


@query(
    "uniform_sample",
    """WITH n AS (SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS n FROM documents), i AS (SELECT doc_id, n, unnest(range(0, 5)) AS i FROM n WHERE n > 2)
    SELECT DISTINCT doc_id, least(greatest(CASE WHEN n - 2 <= 5 THEN least(i + 1, n - 2) ELSE round_even((i + 1) * (n - 1) / 6.0::DOUBLE, 0)::BIGINT END, 1), n - 2)::BIGINT AS line FROM i""",
)
def uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five inner lines of each document, evenly apart, ends excluded."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n")).cast("bigint").alias("n")).where("n > 2")
    i = d.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    at = F.when(F.col("n") - 2 <= 5, F.least(F.col("i") + 1, F.col("n") - 2)).otherwise(F.bround((F.col("i") + 1) * (F.col("n") - 1) / F.lit(6.0)).cast("bigint"))
    return i.select("doc_id", F.least(F.greatest(at, F.lit(1)), F.col("n") - 2).cast("bigint").alias("line")).distinct()


@query(
    "page_spec_pack",
    """WITH s AS (SELECT p_partkey AS key, p_size AS n, '1,3-5,' || (p_size // 2 + 1) AS spec FROM part) SELECT key, list_aggregate(list_sort(list_filter(list_distinct([1, 3, 4, 5, n // 2 + 1]), lambda x: x <= n)), 'string_agg', ',') AS pages FROM s""",
)
def page_spec_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages selected by a specification like 1,3-5: sorted, once each, within the document."""
    spec = F.concat(F.lit("1,3-5,"), F.floor(F.col("p_size") / 2 + 1).cast("string"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.array_join(pages_of(spec, F.col("p_size")).cast("array<string>"), ",").alias("pages"))


def pages_of(spec: Column, total: Column) -> Column:
    """array<int> of the pages that a specification names."""
    one = lambda x, k: F.element_at(F.split(x, "-"), k).cast("int")
    every = F.flatten(F.transform(F.split(spec, ","), lambda x: F.sequence(one(x, 1), one(x, -1))))
    return F.array_sort(F.array_distinct(F.filter(every, lambda x: (x >= 1) & (x <= total))))
