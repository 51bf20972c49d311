"""Column functions on text, and their spelling in the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def n_chars(c: Column) -> Column:
    return F.length(c).cast("bigint")


def title_of(text: Column) -> Column:
    """The first line."""
    return F.substring_index(text, "\n", 1)


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, ends stripped."""
    return F.trim(F.regexp_replace(c, r"[ \t\n\x0b\f\r\x{00A0}]+", " "))


def non_space(c: Column) -> Column:
    """How many characters are not white space."""
    return F.length(F.regexp_replace(c, r"[ \t\n\x0b\f\r\x{00A0}\x{2000}-\x{200A}\x{3000}]", "")).cast("bigint")


def title_key(c: Column) -> Column:
    """Lower case, letters, digits and underscore only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", "")


def alnum_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def count_of(c: Column, pattern: str) -> Column:
    """Matches of a pattern."""
    return F.size(F.regexp_extract_all(c, F.lit(pattern), F.lit(0))).cast("bigint")


def truncate(c: Column, n: int) -> Column:
    """As it is up to n characters, else the first n, right-stripped, and three dots."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, n)), F.lit("...")))


def cjk_ratio(c: Column) -> Column:
    """Share of U+4E00 to U+9FFF among what is not white space; 0 of nothing."""
    cjk = F.length(F.regexp_replace(c, r"[^\x{4E00}-\x{9FFF}]", ""))
    return F.coalesce(F.try_divide(cjk.cast("double"), non_space(c)), F.lit(0.0))


def slug(c: Column) -> Column:
    """ASCII letters and digits in lower case, all else as single hyphens; a short hash where nothing is left."""
    s = F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"))
    s = F.regexp_replace(s, r"^-+|-+$", "")
    return F.when(s == "", F.substring(F.md5(c), 1, 12)).otherwise(s)


def bibliographic_year(c: Column) -> Column:
    """The first year of 19xx or 20xx that stands apart, null if there is none."""
    return F.regexp_extract(F.concat(F.lit(" "), c, F.lit(" ")), r"[^A-Za-z0-9_]((?:19|20)[0-9]{2})[^A-Za-z0-9_]", 1).try_cast("bigint")


def attachment_year(c: Column) -> Column:
    """The first of 1500 to 2199, standing apart or not; `unknown` if there is none."""
    y = F.regexp_extract(c, r"(1[5-9][0-9]{2}|2[01][0-9]{2})", 1)
    return F.when(y == "", F.lit("unknown")).otherwise(y)


def like_escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\%_])", r"\\$1")


def iso_seconds(c: Column) -> Column:
    """A time as text, to the second, in UTC."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
