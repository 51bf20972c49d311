"""Reading XHTML that may be broken: its blocks in order, each with its inline text in Markdown."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .slices import by_slices

#: Elements that end others, hold nothing, are not read, or part blocks.
CLOSED_BY = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}}
VOID = {"br", "img", "hr", "meta", "link", "input", "col", "wbr", "source", "area", "base", "embed", "track", "param"}
SKIPPED = {"head", "script", "style", "title", "template", "noscript"}
BLOCKS = {"p", "div", "section", "article", "aside", "header", "footer", "main", "body", "ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "td", "th", "blockquote", "pre", "figure", "figcaption", "hr", "nav", "h1", "h2", "h3", "h4", "h5", "h6"}
EMPHASIS = {"em": "*", "i": "*", "strong": "**", "b": "**", "code": "`", "tt": "`"}
BLOCK_TYPE = "array<struct<kind: string, level: int, text: string, ref: string>>"


class _Reader(HTMLParser):
    """Collects (kind, level, text, ref): heading, para, item, quote, code, cell, rule, note; cells carry the number of their row, items their depth."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, dict]] = []
        self.blocks: list[dict] = []
        self.text: list[tuple[tuple[str, ...], str]] = []
        self.links: list[tuple[int, str]] = []
        self.rows = 0
        self.note: str | None = None
        self.counts: list[int] = []

    def inside(self, *tags: str) -> int:
        return sum(t in tags for t, _ in self.open)

    def add(self, text: str) -> None:
        """Text with the emphasis that is open around it."""
        marks = () if self.inside("pre") else tuple(EMPHASIS[t] for t, _ in self.open if t in EMPHASIS)
        self.text.append((tuple(dict.fromkeys(marks)), text))

    def joined(self, parts: list[tuple[tuple[str, ...], str]]) -> str:
        """Runs of one emphasis between its marks, blanks at their ends outside."""
        out = []
        for marks, run in groupby(parts, key=lambda x: x[0]):
            text = "".join(t for _, t in run)
            core = text.strip()
            at = text.find(core) if core else 0
            out.append(f"{text[:at]}{''.join(marks)}{core}{''.join(reversed(marks))}{text[at + len(core):]}" if core and marks else text)
        return "".join(out)

    def flush(self) -> None:
        raw, self.text = self.joined(self.text), []
        code = self.inside("pre") > 0
        text = raw.strip("\n") if code else re.sub(r"[ \t]*\n[ \t]*", "\n", re.sub(r"[ \t\r\f\xa0]+", " ", raw)).strip()
        if not text.strip():
            return
        level = next((int(t[1]) for t, _ in reversed(self.open) if re.fullmatch("h[1-6]", t)), 0)
        depth = self.inside("ul", "ol")
        if level:
            kind, n, ref = "heading", level, None
        elif code:
            kind, n, ref = "code", 0, None
        elif self.inside("td", "th"):
            kind, n, ref = "cell", self.rows, None
        elif self.inside("li") and depth:
            ordered = next((t for t, _ in reversed(self.open) if t in ("ul", "ol")), "ul") == "ol"
            kind, n, ref = "item", depth, str(self.counts[-1]) if ordered else None
        elif self.inside("blockquote"):
            kind, n, ref = "quote", self.inside("blockquote"), None
        else:
            kind, n, ref = "para", 0, None
        if self.note:
            kind, n, ref = "note", 0, self.note
        self.blocks.append({"kind": kind, "level": n, "text": text, "ref": ref})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag in CLOSED_BY:
            for k in range(len(self.open) - 1, -1, -1):
                other = self.open[k][0]
                if other in ("ul", "ol", "table", "dl", "div", "section", "article") and tag != "p":
                    break
                if other in CLOSED_BY[tag]:
                    self.close(k)
                    if tag != "tr" and other != "p":
                        break
                elif other in BLOCKS and other != "p" and tag == "p":
                    break
        if tag in SKIPPED or self.inside(*SKIPPED):
            if tag not in VOID:
                self.open.append((tag, a))
            return
        if tag in BLOCKS:
            self.flush()
        if tag == "math" and a.get("alttext"):
            self.add(f"${a['alttext']}$")
            self.open.append(("template", a))  # not read; its own end tag closes what is open then
            return
        if tag == "br":
            self.add("\n")
        elif tag == "hr":
            self.blocks.append({"kind": "rule", "level": 0, "text": "---", "ref": None})
        elif tag == "img":
            self.add(f"![{a.get('alt', '')}]({a.get('src', '')})")
        elif tag == "tr":
            self.rows += 1
        elif tag in ("ul", "ol"):
            self.counts.append(0)
        elif tag == "li" and self.counts:
            self.counts[-1] += 1
        if tag in VOID:
            return
        if tag == "a":
            self.links.append((len(self.text), a.get("href", "")))
        kind = f"{a.get('epub:type', '')} {a.get('role', '')} {a.get('class', '')}"
        if a.get("id") and re.search("footnote|endnote|rearnote", kind) and tag in BLOCKS:
            self.note = a["id"]
        self.open.append((tag, a))

    def close(self, k: int) -> None:
        """Ends the k-th open element and all within it."""
        while len(self.open) > k:
            tag, a = self.open[-1]
            if not self.inside(*SKIPPED):
                if tag == "a" and self.links:
                    self.end_link(a)
                if tag in BLOCKS:
                    self.flush()
                if tag in ("ul", "ol") and self.counts:
                    self.counts.pop()
            if self.note and a.get("id") == self.note:
                self.note = None
            self.open.pop()

    def end_link(self, a: dict) -> None:
        at, href = self.links.pop()
        label = self.joined(self.text[at:])
        del self.text[at:]
        if href.startswith("#") and ("noteref" in a.get("epub:type", "") or self.inside("sup")):
            label = f"[^{href[1:]}]"
        elif re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", href):
            label = f"[{label.strip()}]({href})"
        self.text.append(((), label))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag or tag == "math" and self.open[k][0] == "template":
                self.close(k)
                return

    def handle_data(self, data: str) -> None:
        if not self.inside(*SKIPPED):
            self.add(data if self.inside("pre") else re.sub(r"\s+", " ", data))

    def read(self, html: str) -> list[dict]:
        self.feed(html)
        self.close_all()
        return self.blocks

    def close_all(self) -> None:
        super().close()
        _Reader.close(self, 0)
        self.flush()


def blocks(html: Column, known: tuple[str, ...] | None = None) -> Column:
    """array<struct<kind, level, text, ref>> of the blocks of a document in their order; null for null.

    References are read as HTML has them, also without their semicolon; if `known` is given,
    only those names and only with it, and all others stay as they are written.
    """
    other = None if known is None else re.compile(f"&(?!(?:{'|'.join(map(re.escape, known))});)")

    kind = pa.list_(pa.struct([("kind", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("ref", pa.string())]))

    @F.arrow_udf(BLOCK_TYPE)
    def one(texts: pa.Array) -> pa.Array:
        return by_slices(texts, kind, lambda t: None if t is None else _Reader().read(t if other is None else other.sub("&amp;", t)))

    return one(html)
