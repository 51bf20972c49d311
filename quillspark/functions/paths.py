"""Paths and references: resolving, rewriting, judging; each a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decoded(c: Column) -> Column:
    """Without its percent signs; plus signs stay, what can't be decoded stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def normal_path(c: Column) -> Column:
    """Without empty parts and `.`, with `..` taken back where there is a part before; `.` for nothing."""
    parts = F.filter(F.split(c, "/"), lambda p: (p != "") & (p != "."))
    start = F.array().cast("array<string>")
    last = lambda a: F.try_element_at(a, F.lit(-1))
    rooted = F.startswith(c, F.lit("/"))
    back = lambda a, p: F.when((F.size(a) > 0) & (last(a) != ".."), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(rooted, a).otherwise(F.concat(a, F.array(p)))
    out = F.array_join(F.aggregate(parts, start, lambda a, p: F.when(p == "..", back(a, p)).otherwise(F.concat(a, F.array(p)))), "/")
    return F.when(rooted, F.concat(F.lit("/"), out)).when(out == "", ".").otherwise(out)


def resolve(base: Column, href: Column) -> Column:
    """A reference against the document that holds it, without its fragment."""
    target = decoded(F.substring_index(href, "#", 1))
    folder = F.regexp_extract(base, r"^(.*)/[^/]*$", 1)
    joined = F.when(F.startswith(target, F.lit("/")) | (folder == ""), target).otherwise(F.concat(folder, F.lit("/"), target))
    return F.when(target == "", base).otherwise(normal_path(joined))


RELATIVE = r"(?![A-Za-z][A-Za-z0-9+.\-]*:|/|#|\\|<)"


def rewrite_references(markdown: Column, prefix: str) -> Column:
    """Relative targets of Markdown links and images, and of src and href, below a prefix."""
    out = F.regexp_replace(markdown, rf"(!?\[[^\]]*\]\(){RELATIVE}([^\s)]+)([^)]*\))", rf"$1{prefix}/$2$3")
    return F.regexp_replace(out, rf"(?<![A-Za-z0-9_])(src|href)=(['\"]){RELATIVE}([^'\"]+)\2", rf"$1=$2{prefix}/$3$2")


def is_external(url: Column) -> Column:
    """Whether a reference names a host, or a scheme other than data and blob."""
    return F.startswith(url, F.lit("//")) | (url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") & ~F.lower(url).rlike("^(?:data|blob):"))


def escapes_root(base: Column, url: Column) -> Column:
    """Whether a reference leaves the package: a backslash, a leading slash, or more steps up than there are folders."""
    target = decoded(F.regexp_extract(url, r"^([^?#]*)", 1))
    folder = F.regexp_extract(base, r"^(.*)/[^/]*$", 1)
    whole = normal_path(F.when(folder == "", target).otherwise(F.concat(folder, F.lit("/"), target)))
    return ~F.lower(url).rlike("^(?:data|blob):") & (F.contains(target, F.lit("\\")) | F.startswith(target, F.lit("/")) | (whole == "..") | F.startswith(whole, F.lit("../")))


def css_urls(style: Column) -> Column:
    """array<string> of what url() and @import name."""
    urls = F.regexp_extract_all(style, F.lit(r"url\(\s*['\"]?([^'\")]+?)['\"]?\s*\)"), F.lit(1))
    return F.concat(urls, F.regexp_extract_all(style, F.lit(r"@import\s+['\"]([^'\"]+)['\"]"), F.lit(1)))


def srcset_urls(value: Column) -> Column:
    """array<string> of the candidates of a srcset; a data: address keeps its commas."""
    return F.regexp_extract_all(value, F.lit(r"(?:^|,)\s*((?:[Dd][Aa][Tt][Aa]:\S+|[^\s,]+))[^,]*"), F.lit(1))


def home_relative(path: Column, home: str) -> Column:
    return F.when(F.startswith(path, F.lit(home)), F.concat(F.lit("~"), F.substring(path, F.lit(len(home) + 1), F.length(path)))).otherwise(path)


def local_path(text: Column) -> Column:
    """Whether a text names a path of somebody's machine."""
    return text.rlike(r"(?:^|[^A-Za-z0-9_])(?:[A-Za-z]:[\\/](?![\\/])|file://)") | text.rlike(r"(?:^|[^A-Za-z0-9_./])/(?:Users|home)/[A-Za-z0-9_]") | text.rlike(r"(?:^|[^A-Za-z0-9_./])/mnt/[a-z](?:/|$|\s)")


def stored_path(path: Column, link_mode: Column, folder: Column) -> Column:
    """Where a file lies: `storage:` names are below their folder, for files of their own; other paths must be absolute, for linked files; null for all else."""
    inner = normal_path(F.substring(path, F.lit(9), F.length(path)))
    bad = (inner == ".") | (inner == "..") | F.startswith(inner, F.lit("../")) | F.startswith(inner, F.lit("/"))
    own = F.startswith(path, F.lit("storage:")) & link_mode.isin(0, 1) & ~bad
    return F.when(own, F.concat(folder, F.lit("/"), inner)).when(F.startswith(path, F.lit("/")) & (link_mode == 2), path)
