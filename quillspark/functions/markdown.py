"""Rules of Markdown lines: headings, anchors, notes as column expressions; fences, comments and code spans, whose state runs on, as one pass over the lines of a text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns of the line rules.
ATX = r"^\s*(#{1,6})(?:[ \t]|$)"
PAGE_ANCHOR = r"^\s*<!--\s*page:\s*(\d+)\s*-->\s*$"
NOTE_DEFINITION = r"^\s*\[\^([^\]]+)\]:"
NOTE_REFERENCE = r"\[\^([^\]]+)\](?!:)"
NOTE_HEADING = r"^ {0,3}#{1,6}\s+(\[\^[^\]\s]+\]:.*)$"
IMAGE = r"!\[[^\]]*\]\([^)]+\)"
FORMULA = r"\$\$|\\\[|\\begin\{(?:equation|align)"
TOC_ENTRY = r"^\s*(?:[-*+]\s+|\d+[.)]\s+)?(.+?)\s+(\d{1,4})\s*$"
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$", re.DOTALL)
_RUN = re.compile("`+")
_STATEFUL = re.compile("`|~~~|<!--")


def atx_level(line: Column) -> Column:
    """1 to 6, null for what is no heading."""
    n = F.length(F.regexp_extract(line, ATX, 1))
    return F.when(n > 0, n.cast("bigint"))


def heading_title(line: Column) -> Column:
    """The line without its hashes and blanks at the ends."""
    return F.regexp_replace(F.regexp_replace(line, r"^\s*#+", ""), r"^\s+|\s+$", "")


def page_anchor(line: Column) -> Column:
    return F.regexp_extract(line, PAGE_ANCHOR, 1).try_cast("bigint")


def note_definition(line: Column) -> Column:
    """The label that a line defines, null if none."""
    return F.nullif(F.regexp_extract(line, NOTE_DEFINITION, 1), F.lit(""))


def note_references(line: Column) -> Column:
    """array<string> of the labels that a line refers to, repeats included."""
    return F.regexp_extract_all(line, F.lit(NOTE_REFERENCE), F.lit(1))


def strip_comments(line: str, inside: bool) -> tuple[str, bool]:
    """What of a line lies outside of HTML comments, and whether one goes on."""
    out = []
    while True:
        if inside:
            _, end, line = line.partition("-->")
            if not end:
                return "".join(out), True
            inside = False
        seen, begin, line = line.partition("<!--")
        out.append(seen)
        if not begin:
            return "".join(out), False
        inside = True


def strip_code_spans(line: str, width: int) -> tuple[str, int]:
    """What of a line lies outside of code spans, and the width of the run of backticks that is still open, else 0."""
    out, at = [], 0
    while True:
        if width:
            end = line.find("`" * width, at)
            if end < 0:
                return "".join(out), width
            at, width = end + width, 0
        run = _RUN.search(line, at)
        if run is None:
            return "".join(out) + line[at:], 0
        out.append(line[at : run.start()])
        at, width = run.end(), len(run.group())


def line_states(lines: list[str]) -> list[tuple[bool, str, bool]]:
    """(fenced, visible, touched) of each line: whether it is of a code fence or its marks, what a reader sees of it, and whether comments or code spans took some of it.

    A fence ends with its own marker, at least as wide and with nothing after it; the info
    of a fence of backticks holds none.
    """
    out, mark, inside, width = [], "", False, 0
    for line in lines:
        if not (mark or inside or width or _STATEFUL.search(line)):
            out.append((False, line, False))
            continue
        fence = _FENCE.match(line)
        if mark:
            if fence and fence[1][0] == mark[0] and len(fence[1]) >= len(mark) and not fence[2].strip():
                mark = ""
            out.append((True, "", False))
            continue
        before = inside
        seen, inside = strip_comments(line, inside)
        fence = _FENCE.match(seen)
        if fence and not (fence[1][0] == "`" and "`" in fence[2]):
            mark = fence[1]
            out.append((True, "", False))
            continue
        visible, width = strip_code_spans(seen, width)
        out.append((False, visible, before or visible != line))
    return out


#: What a reader could see as a heading or a note.
_MARKED = re.compile(r"\s*#{1,6}(?:[ \t]|\Z)|.*\[\^", re.DOTALL)
_ANCHOR_LINE = re.compile(PAGE_ANCHOR, re.ASCII)

LINE = "doc_id bigint, line_no bigint, line string, fenced boolean, visible string, touched boolean"
MARK = "doc_id bigint, line_no bigint, visible string, n bigint, held bigint"


def _is_anchor(line: str) -> bool:
    found = _ANCHOR_LINE.match(line)
    return found is not None and int(found[1]) < 1 << 63


def flat_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, lines) to LINE: a row for each line, its state beside it; the columns of a document are made as a whole."""
    for batch in batches:
        for key, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if lines:
                fenced, visible, touched = zip(*line_states([x or "" for x in lines]), strict=True)
                n = len(lines)
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array(range(1, n + 1), pa.int64()), pa.array(lines, pa.string()), pa.array(fenced), pa.array(visible), pa.array(touched)], names=["doc_id", "line_no", "line", "fenced", "visible", "touched"])


def flat_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, lines) to MARK: a row for each line that may be a heading or a note, and one of number 0 for the document.

    n is how many lines there are, held how many lines above hold anything but an anchor of a
    page; in row 0 it is how many hold anything.
    """
    for batch in batches:
        rows: list[tuple] = []
        for key, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not lines:
                continue
            lines = [x or "" for x in lines]
            rows.append((key, 0, "", len(lines), sum(x.strip(" ") != "" for x in lines)))
            held = 0
            for i, (line, (_, visible, _)) in enumerate(zip(lines, line_states(lines), strict=True), 1):
                if _MARKED.match(visible):
                    rows.append((key, i, visible, len(lines), held))
                held += line.strip(" ") != "" and not _is_anchor(line)
        cols = zip(*rows, strict=True) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "line_no", "visible", "n", "held"])


#: Words of a heading that tell its kind, in the order in which they count: (kind, role, parts of the lower-cased title, whole titles, starts, ends).
KINDS = (
    ("contents", "frontmatter", ("contents", "inhaltsverzeichnis", "目录"), (), (), ()),
    ("titlepage", "frontmatter", ("题名页",), ("title page", "titelblatt"), (), ()),
    ("copyright", "frontmatter", ("copyright", "impressum", "版权"), (), (), ()),
    ("preface", "frontmatter", ("preface", "foreword", "vorwort", "前言", "序言"), (), (), ()),
    ("bibliography", "backmatter", ("bibliography", "literaturverzeichnis", "参考文献"), (), (), ()),
    ("notes", "backmatter", ("endnotes", "anmerkungen", "注释"), ("notes",), (), ()),
    ("appendix", "backmatter", ("appendix", "anhang", "附录"), (), (), ()),
    ("part", "bodymatter", ("部分",), (), ("part ", "teil "), ("部",)),
)


def heading_kind(title: Column, level: Column, primary: Column) -> Column:
    """struct<kind, role>: by the words of the title, else a chapter where the level is the primary one, else a section."""
    low = F.lower(title)
    out = F.when(level == primary, F.struct(F.lit("chapter").alias("kind"), F.lit("bodymatter").alias("role"))).otherwise(F.struct(F.lit("section").alias("kind"), F.lit("bodymatter").alias("role")))
    for kind, role, parts, whole, starts, ends in reversed(KINDS):
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(low, F.lit(p))
        for w in whole:
            hit = hit | (low == w)
        for s in starts:
            hit = hit | F.startswith(low, F.lit(s))
        for e in ends:
            hit = hit | F.endswith(low, F.lit(e))
        out = F.when(hit, F.struct(F.lit(kind).alias("kind"), F.lit(role).alias("role"))).otherwise(out)
    return out


def internal_title(title: Column) -> Column:
    """Whether a title is one that only the machinery knows: empty, a continuation, chapter_7 and the like."""
    low = F.lower(F.trim(title))
    return (low == "") | (low == "continuation") | F.startswith(low, F.lit("continuation ")) | low.rlike(r"^(?:chapter|unit|section)[_-][0-9]+$")
