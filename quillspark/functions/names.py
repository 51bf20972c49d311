"""Names of people, files and batches; page specifications; small values, each a column expression."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(c: Column) -> Column:
    """Trimmed; null where nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def display_name(last: Column, first: Column) -> Column:
    """`Last, First`, either alone, null for neither."""
    last, first = filled(last), filled(first)
    return F.when(last.isNotNull() & first.isNotNull(), F.concat(last, F.lit(", "), first)).otherwise(F.coalesce(last, first))


def plain_name(name: Column, first: Column, last: Column) -> Column:
    """The whole name, else `First Last`, else either."""
    last, first = filled(last), filled(first)
    return F.coalesce(filled(name), F.when(last.isNotNull() & first.isNotNull(), F.concat(first, F.lit(" "), last)), last, first)


def safe_slug(c: Column, most: int = 80) -> Column:
    """Reserved characters and runs of blanks as one blank, cut, `untitled` for nothing."""
    s = F.trim(F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|\x00-\x1f]+', " "), r"\s+", " "))
    return F.when(s == "", "untitled").otherwise(F.rtrim(F.left(s, F.lit(most))))


def safe_filename(c: Column, most: int = 80) -> Column:
    """Reserved characters and blanks as underscores, stripped of dots and underscores, cut, `img` for nothing."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|]', "_"), r"\s+", "_"), r"^[._]+|[._]+$", "")
    return F.when(s == "", "img").otherwise(F.left(s, F.lit(most)))


def url_stem(c: Column) -> Column:
    """What would end an address early as single underscores, `book` for nothing."""
    s = F.regexp_replace(F.regexp_replace(c, r"""[\s()\[\]<>"'`\\|#?%&]+""", "_"), "^_+|_+$", "")
    return F.when(s == "", "book").otherwise(s)


def directory_key(c: Column) -> Column:
    """The name in composed form and without case: what file systems hold for one name."""

    @F.pandas_udf("string")
    def key(names: pd.Series) -> pd.Series:
        return names.map(lambda s: None if s is None else unicodedata.normalize("NFC", s).casefold())

    return key(c)


def project_slug(c: Column, most: int = 80) -> Column:
    """In compatibility form; letters, digits, dot, hyphen and underscore stay, runs of all else are one underscore; null for nothing."""

    @F.pandas_udf("string")
    def composed(names: pd.Series) -> pd.Series:
        return names.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))

    s = F.regexp_replace(F.regexp_replace(composed(F.trim(c)), r"[^\p{L}\p{N}._\-]", "_"), "_+", "_")
    s = F.regexp_replace(s, r"^[ ._\-]+|[ ._\-]+$", "")
    return F.nullif(F.regexp_replace(F.left(s, F.lit(most)), r"[ ._\-]+$", ""), F.lit(""))


def batch_id(key: Column, md5: Column, start: Column, end: Column) -> Column:
    """Stable id of a run of pages."""
    pad = lambda n: F.when(F.length(n.cast("string")) < 4, F.lpad(n.cast("string"), 4, "0")).otherwise(n.cast("string"))
    return F.concat_ws("-", key.cast("string"), F.left(md5, F.lit(8)), pad(start), pad(end))


def normalised_text(c: Column) -> Column:
    """Without NUL, lines stripped at their right, runs of blank lines as one, ends stripped."""
    s = F.regexp_replace(F.regexp_replace(c, r"\x00", ""), r"[ \t\r\x0b\f]+(?=\n|$)", "")
    return F.regexp_replace(F.regexp_replace(s, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def short(c: Column, n: int) -> Column:
    """As it is up to n characters, else the first n - 3 and three dots."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.left(c, F.lit(n - 3)), F.lit("...")))


def excerpt(text: Column, start: Column, end: Column, size: int = 200) -> Column:
    """A window of at most `size` characters around [start, end), counted from 0, with dots where it is cut."""
    margin = F.greatest(F.floor((size - F.greatest(end - start, F.lit(0))) / 2), F.lit(0))
    first = F.greatest(F.least(start - margin, F.length(text) - size), F.lit(0)).cast("int")
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    body = strip(F.substring(text, first + 1, F.lit(size)))
    cut = F.concat(F.when(first > 0, "…").otherwise(""), body, F.when(first + size < F.length(text), "…").otherwise(""))
    return F.when(F.length(text) <= size, strip(text)).otherwise(cut)


def key_list(c: Column) -> Column:
    """Values between commas and line ends, trimmed, in order, once each."""
    return F.array_distinct(F.filter(F.transform(F.split(c, "[,\n]"), lambda x: F.trim(x)), lambda x: x != ""))


def allowed(values: Column, of: tuple[str, ...]) -> Column:
    """Trimmed and lower-cased values that are allowed, in order, once each."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.lower(F.trim(x))), lambda x: x.isin(*of)))


def front_matter(**values: Column) -> Column:
    """A block of `key: value` lines: null, numbers as they are, texts in quotes."""
    lines = [F.concat(F.lit(f"{k}: "), F.coalesce(v, F.lit("null"))) for k, v in values.items()]
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"))


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))


def provenance_key(c: Column) -> Column:
    """The key of eight after `OCR Source Key:`, in capitals; null if there is none."""
    return F.nullif(F.upper(F.regexp_extract(c, r"(?i)OCR Source Key:\s*([A-Z0-9]{8})(?![A-Za-z0-9_])", 1)), F.lit(""))


def fence_for(c: Column) -> Column:
    """Backticks that no run within the text can close."""
    longest = F.array_max(F.transform(F.regexp_extract_all(c, F.lit("(`+)"), F.lit(1)), F.length))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(longest, F.lit(0)) + 1))


def tri_state(c: Column) -> Column:
    """True, false, or null for nothing and for `auto`."""
    low = F.lower(F.trim(c))
    return F.when(low == "auto", None).otherwise(low.isin("1", "true", "yes", "on", "enabled"))


def magic(head: Column) -> Column:
    """What the first characters of a file say it is."""
    first = F.left(F.regexp_replace(head, r"^\s+", ""), F.lit(1))
    return F.when(F.startswith(head, F.lit("%PDF")), "pdf").when(first.isin("{", "["), "json").otherwise("other")


def signed_pages(spec: Column, total: Column) -> Column:
    """Pages of a specification whose negative numbers count from the end, in order of mention, once each; null where it names a page that is not there or runs down."""
    part = lambda x, k: F.nullif(F.regexp_extract(F.trim(x), r"^(-?\d+)(?:-(-?\d+))?$", k), F.lit("")).try_cast("int")
    real = lambda n: F.when(n < 0, total + 1 + n).otherwise(n)
    first, last = lambda x: real(part(x, 1)), lambda x: real(F.coalesce(part(x, 2), part(x, 1)))
    parts = F.split(spec, ",")
    bad = F.exists(parts, lambda x: part(x, 1).isNull() | (first(x) < 1) | (last(x) > total) | (last(x) < first(x)))
    return F.when(~bad, F.array_distinct(F.flatten(F.transform(parts, lambda x: F.sequence(first(x), last(x))))))


def batches(values: Column, n: int) -> Column:
    """The values in order, n at a time."""
    starts = F.sequence(F.lit(1), F.size(values), F.lit(n))
    return F.when(F.size(values) == 0, F.array().cast("array<array<string>>")).otherwise(F.transform(starts, lambda i: F.slice(values, i, F.lit(n))))


def sentence_cut(text: Column, budget: int) -> Column:
    """Up to the end of the first sentence at or beyond `budget` characters; whole if it is short or has no such end."""
    cut = F.regexp_extract(text, rf"(?s)^(.{{{budget - 1},}}?[.!?。！？])", 1)
    return F.when((F.length(text) <= budget) | (cut == ""), text).otherwise(cut)


def word_boundary(text: Column, position: Column) -> Column:
    """The place nearest to a position, left first, that is not within a word."""
    at = F.greatest(F.lit(0), F.least(position, F.length(text))).cast("int")
    before = F.length(F.regexp_extract(F.left(text, at), r"([\p{L}\p{N}]*)$", 1))
    after = F.length(F.regexp_extract(F.substring(text, at + 1, F.length(text)), r"^([\p{L}\p{N}]*)", 1))
    return F.when((before == 0) | (after == 0), at).when(before <= after, at - before).otherwise(at + after).cast("bigint")


def canonical_hash(**values: Column) -> Column:
    """SHA-256 of compact JSON with its keys in order."""
    return F.sha2(F.to_json(F.struct(*(values[k].alias(k) for k in sorted(values))), {"ignoreNullFields": "false"}), 256)
