"""Scalar rules on names, texts, pages and paths, a query for each family, with the same rule in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import paths as P
from ..functions import text as T
from ..registry import query
from ..sources.shared import prepare
from ..sources.tables import table

#: A title with what files can't hold, and a creator of two, one or no name.
_TITLED = "d AS (SELECT doc_id, source, lang, text, split_part(text, chr(10), 1) AS title, CASE WHEN doc_id % 4 = 0 THEN '' ELSE coalesce(string_split(split_part(text, chr(10), 1), ' ')[1], '') END AS first, CASE WHEN doc_id % 3 = 0 THEN '' ELSE coalesce(string_split(split_part(text, chr(10), 1), ' ')[2], '') END AS last, '._ a:b/' || left(split_part(text, chr(10), 1), 60) || ' (x)?*_.' AS raw FROM documents)"


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = lambda k: F.coalesce(F.try_element_at(F.split(T.title_of(F.col("text")), " "), F.lit(k)), F.lit(""))
    d = table(spark, sf_dir, "documents")
    first, last = F.when(F.col("doc_id") % 4 == 0, "").otherwise(word(1)), F.when(F.col("doc_id") % 3 == 0, "").otherwise(word(2))
    raw = F.concat(F.lit("._ a:b/"), F.left(T.title_of(F.col("text")), F.lit(60)), F.lit(" (x)?*_."))
    return d.select("doc_id", "source", "lang", "text", T.title_of(F.col("text")).alias("title"), first.alias("first"), last.alias("last"), raw.alias("raw"))


_SLUG = lambda c, n: f"(CASE WHEN trim(regexp_replace(regexp_replace({c}, '[\\\\/:*?\"<>|\\x00-\\x1f]+', ' ', 'g'), '\\s+', ' ', 'g')) = '' THEN 'untitled' ELSE rtrim(left(trim(regexp_replace(regexp_replace({c}, '[\\\\/:*?\"<>|\\x00-\\x1f]+', ' ', 'g'), '\\s+', ' ', 'g')), {n})) END)"
_PLAIN = "coalesce(CASE WHEN doc_id % 5 = 0 THEN source END, CASE WHEN trim(first) <> '' AND trim(last) <> '' THEN trim(first) || ' ' || trim(last) END, nullif(trim(last), ''), nullif(trim(first), ''))"


@query(
    "name_pack",
    rf"""WITH {_TITLED} SELECT doc_id, CASE WHEN trim(first) <> '' AND trim(last) <> '' THEN trim(last) || ', ' || trim(first) ELSE coalesce(nullif(trim(last), ''), nullif(trim(first), '')) END AS display, {_PLAIN} AS plain,
    {_SLUG('raw', 80)} AS slug, left(regexp_replace(regexp_replace(regexp_replace(raw, '[\\/:*?"<>|]', '_', 'g'), '\s+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 40) AS filename,
    regexp_replace(regexp_replace(raw, '[\s()\[\]<>"''`\\|#?%&]+', '_', 'g'), '^_+|_+$', '', 'g') AS stem, {_SLUG(f"coalesce({_PLAIN}, 'unknown') || '_' || coalesce(nullif(regexp_extract(text, '(1[5-9][0-9][0-9]|2[01][0-9][0-9])', 1), ''), 'unknown') || '_' || title", 180)} AS basename,
    replace(lower(nfc_normalize(title)), 'ß', 'ss') AS directory_key, doc_id || '-' || left(md5(text), 8) || '-' || lpad((doc_id % 97)::VARCHAR, 4, '0') || '-' || lpad((doc_id % 97 + 12)::VARCHAR, 4, '0') AS batch_id FROM d""",
)
def name_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of creators, and names of files, folders and batches made from titles."""
    prepare(spark)
    c = F.col
    plain = N.plain_name(F.when(c("doc_id") % 5 == 0, c("source")), c("first"), c("last"))
    basename = N.safe_slug(F.concat_ws("_", F.coalesce(plain, F.lit("unknown")), T.attachment_year(c("text")), c("title")), 180)
    start = c("doc_id") % 97
    return titled(spark, sf_dir).select(
        "doc_id", N.display_name(c("last"), c("first")).alias("display"), plain.alias("plain"), N.safe_slug(c("raw")).alias("slug"), N.safe_filename(c("raw"), 40).alias("filename"), N.url_stem(c("raw")).alias("stem"),
        basename.alias("basename"), N.directory_key(c("title")).alias("directory_key"), N.batch_id(c("doc_id"), F.md5("text"), start, start + 12).alias("batch_id"),
    )


@query(
    "name_collisions",
    r"""WITH n AS (SELECT doc_id, regexp_replace(split_part(text, chr(10), 1), '[\\/:*?"<>|\s]+', '_', 'g') AS base FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY replace(lower(base), 'ß', 'ss') ORDER BY doc_id) AS k FROM n)
    SELECT doc_id, base, CASE WHEN k = 1 THEN base ELSE base || '_' || left(sha256(doc_id::VARCHAR), 12) END AS name, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS counted FROM r""",
)
def name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are alike but for case: the first keeps its own, others get a piece of a hash, or a count."""
    from pyspark.sql import Window

    prepare(spark)
    base = F.regexp_replace(T.title_of(F.col("text")), r'[\\/:*?"<>|\s]+', "_")
    n = table(spark, sf_dir, "documents").select("doc_id", base.alias("base")).withColumn("key", N.directory_key(F.col("base")))
    k = F.row_number().over(Window.partitionBy("key").orderBy("doc_id"))
    other = lambda tail: F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", tail))
    return n.withColumn("k", k).select("doc_id", "base", other(F.concat(F.lit("_"), F.left(F.sha2(F.col("doc_id").cast("string"), 256), F.lit(12)))).alias("name"), other(F.concat(F.lit("-"), F.col("k"))).alias("counted"))


@query(
    "rendering_pack",
    r"""WITH d AS (SELECT doc_id, lang, source, text, split_part(text, chr(10), 1) AS title, length(text) AS n FROM documents), f AS (SELECT *, greatest(least((n // 2) - (200 - 10) // 2, n - 200), 0) AS pos FROM d)
    SELECT doc_id, CASE WHEN length(title) <= 30 THEN title ELSE left(title, 27) || '...' END AS short,
      CASE WHEN n <= 200 THEN regexp_replace(text, '^\s+|\s+$', '', 'g') ELSE CASE WHEN pos > 0 THEN '…' ELSE '' END || regexp_replace(substr(text, pos + 1, 200), '^\s+|\s+$', '', 'g') || CASE WHEN pos + 200 < n THEN '…' ELSE '' END END AS excerpt,
      '---' || chr(10) || 'title: "' || replace(left(title, 20) || '"q"', '"', '\"') || '"' || chr(10) || 'pages: ' || doc_id || chr(10) || 'doi: null' || chr(10) || '---' AS front_matter,
      sha256('{"lang":"' || lang || '","n":' || n || ',"source":"' || source || '"}') AS canonical_hash, round(n / 1048576.0::DOUBLE, 1) AS size_mb,
      md5(regexp_replace(regexp_replace(regexp_replace(replace(text, '. ', '.  ' || chr(10) || chr(10) || chr(10)), '[ \t\r]+(\n)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS normalised_md5, 'src' || doc_id AS parent FROM f""",
)
def rendering_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut, excerpted, normalised and rendered: headers, canonical hashes, sizes."""
    c, title = F.col("text"), T.title_of(F.col("text"))
    half = F.floor(F.length(c) / 2)
    spaced = F.replace(c, F.lit(". "), F.lit(".  \n\n\n"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", N.short(title, 30).alias("short"), N.excerpt(c, half, half + 10).alias("excerpt"),
        N.front_matter(title=N.quoted(F.concat(F.left(title, F.lit(20)), F.lit('"q"'))), pages=F.col("doc_id").cast("string"), doi=F.lit(None).cast("string")).alias("front_matter"),
        N.canonical_hash(source=F.col("source"), n=F.length(c), lang=F.col("lang")).alias("canonical_hash"), F.round(F.length(c) / F.lit(1048576.0), 1).alias("size_mb"),
        F.md5(N.normalised_text(spaced)).alias("normalised_md5"), F.substring_index(F.concat(F.lit("src"), F.col("doc_id"), F.lit("#c3")), "#", 1).alias("parent"),
    )


@query(
    "value_pack",
    r"""WITH p AS (SELECT p_partkey AS k, p_size AS n, p_name, p_brand, p_type FROM part)
    SELECT k, array_to_string(list_distinct_ordered, ',') AS keys, upper(nullif(regexp_extract('ocr SOURCE key: ab' || lpad(k::VARCHAR, 6, '0') || ' x', 'key: ([a-z0-9]{8})', 1), '')) AS source_key, repeat('`', greatest(3, CASE WHEN n > 3 THEN n % 7 + 1 ELSE 1 END)) AS fence,
      CASE n % 4 WHEN 0 THEN NULL WHEN 1 THEN TRUE WHEN 2 THEN FALSE ELSE TRUE END AS enabled, CASE n % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'json' ELSE 'other' END AS magic,
      CASE WHEN n >= 4 THEN array_to_string(list_distinct_pages, ',') END AS pages, (len(b) + 2) // 3 AS batches, array_to_string(b[1:3], ' ') AS first_batch
    FROM (SELECT *, [p_brand, p_type, 'x'] AS list_distinct_ordered, CASE WHEN n >= 4 THEN [2, 3, 4] || CASE WHEN n IN (2, 3, 4) THEN []::BIGINT[] ELSE [n]::BIGINT[] END || [1] ELSE [] END AS list_distinct_pages, string_split('a b c d e f g', ' ')[1:(n % 8)] AS b FROM p)""",
)
def value_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of keys, keys in notes, fences, switches of three states, kinds of files, signed page ranges, batches."""
    n = F.col("p_size")
    keys = F.concat(F.lit(" "), F.col("p_brand"), F.lit(" ,"), F.col("p_type"), F.lit("\n,"), F.col("p_brand"), F.lit(", x\n"))
    note = F.concat(F.lit("ocr SOURCE key: ab"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit(" x"))
    code = F.concat(F.lit("a "), F.when(n > 3, F.repeat(F.lit("`"), n % 7)).otherwise(F.lit("")), F.lit(" b"))
    switch = F.element_at(F.array(F.lit(" Auto "), F.lit("yes"), F.lit("off"), F.lit("ENABLED")), (n % 4 + 1).cast("int"))
    head = F.element_at(F.array(F.lit("%PDF-1.7"), F.lit('\n {"a": 1}'), F.lit("GIF")), (n % 3 + 1).cast("int"))
    some = F.slice(F.split(F.lit("a b c d e f g"), " "), F.lit(1), (n % 8).cast("int"))
    b = N.batches(some, 3)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("k"), F.array_join(N.key_list(keys), ",").alias("keys"), N.provenance_key(note).alias("source_key"), N.fence_for(code).alias("fence"), N.tri_state(switch).alias("enabled"), N.magic(head).alias("magic"),
        F.array_join(N.signed_pages(F.lit("2-4,-1,3,1"), n.cast("int")).cast("array<string>"), ",").alias("pages"), F.size(b).cast("bigint").alias("batches"), F.coalesce(F.array_join(F.get(b, F.lit(0)), " "), F.lit("")).alias("first_batch"),
    )


_REFS = ["a%20b.html#x", "../up/./c.png", "../../../out", "/root", "http://h/x", "data:image/png,1", "//h/y", "", "d\\e"]


@query(
    "reference_pack",
    r"""WITH r AS (SELECT page_id, unnest(['a%20b.html#x', '../up/./c.png', '../../../out', '/root', 'http://h/x', 'data:image/png,1', '//h/y', '', 'd\e']) AS ref, unnest(range(9)) AS i FROM pages)
    SELECT page_id, ref, CASE i WHEN 0 THEN 'OPS/t/a b.html' WHEN 1 THEN 'OPS/up/c.png' WHEN 2 THEN '../out' WHEN 3 THEN '/root' WHEN 4 THEN 'OPS/t/http:/h/x' WHEN 5 THEN 'OPS/t/data:image/png,1' WHEN 6 THEN '/h/y' WHEN 7 THEN 'OPS/t/' || page_id || '.html' ELSE 'OPS/t/d\e' END AS resolved,
      i IN (0, 1, 2, 5, 7, 8) = FALSE AND i <> 3 AS external, i IN (2, 3, 6, 8) AS escapes, '[t](' || CASE WHEN i IN (0, 1, 2, 8) THEN 'img/' ELSE '' END || ref || ')' AS rewritten FROM r""",
)
def reference_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of every page, resolved, judged and rewritten."""
    base = F.concat(F.lit("OPS/t/"), F.col("page_id"), F.lit(".html"))
    r = table(spark, sf_dir, "pages").select("page_id", base.alias("base"), F.explode(F.array(*map(F.lit, _REFS))).alias("ref"))
    link = F.concat(F.lit("[t]("), F.col("ref"), F.lit(")"))
    return r.select("page_id", "ref", P.resolve(F.col("base"), F.col("ref")).alias("resolved"), P.is_external(F.col("ref")).alias("external"), P.escapes_root(F.col("base"), F.col("ref")).alias("escapes"), P.rewrite_references(link, "img").alias("rewritten"))


_NORMAL = r"""list_reduce(list_transform(list_filter(string_split({j}, '/'), lambda p: p <> '' AND p <> '.'), lambda p: [p]), lambda a, x: CASE WHEN x[1] <> '..' THEN list_concat(a, x) WHEN len(a) > 0 AND a[-1] <> '..' THEN a[1:len(a) - 1] WHEN starts_with({j}, '/') THEN a ELSE list_append(a, '..') END, []::VARCHAR[])"""


@query(
    "page_references",
    rf"""WITH p AS (SELECT page_id, url, html, split_part(split_part(url, '://', 2), '#', 1) AS spot FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
    b AS (SELECT *, 'OPS/' || split_part(split_part(spot, '?', 1), '/', 2) || '/' || page_id || '.html' AS base, split_part(spot, '/', 1) AS host FROM p),
    r AS (SELECT page_id, base, unnest(list_concat(regexp_extract_all(html, '(?:href|src)="([^"]*)"', 1), [url, '//' || spot, substr(spot, length(host) + 2), '../' || substr(spot, length(host) + 2), '../../../' || host, '#' || host, 'img\' || host])) AS ref FROM b),
    t AS (SELECT *, regexp_extract(base, '^(.*)/[^/]*$', 1) AS folder FROM r), j AS (SELECT *, CASE WHEN starts_with(split_part(ref, '#', 1), '/') THEN split_part(ref, '#', 1) ELSE folder || '/' || split_part(ref, '#', 1) END AS j, folder || '/' || regexp_extract(ref, '^([^?#]*)', 1) AS k, regexp_extract(ref, '^([^?#]*)', 1) AS bare FROM t),
    n AS (SELECT *, array_to_string({_NORMAL.format(j='j')}, '/') AS whole, array_to_string({_NORMAL.format(j='k')}, '/') AS inside FROM j)
    SELECT page_id, ref, CASE WHEN split_part(ref, '#', 1) = '' THEN base WHEN starts_with(j, '/') THEN '/' || whole WHEN whole = '' THEN '.' ELSE whole END AS resolved, starts_with(ref, '//') OR regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.\-]*:') AS external,
      contains(bare, '\') OR starts_with(bare, '/') OR inside = '..' OR starts_with(inside, '../') AS escapes, count(*) AS n FROM n WHERE NOT contains(ref, '%') GROUP BY ALL""",
)
def page_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every page refers to, its own address in several forms included: resolved against its place in a package, whether it is outside, whether it leaves the package."""
    p = table(spark, sf_dir, "pages").where("url IS NOT NULL AND html IS NOT NULL")
    at = F.substring_index(F.element_at(F.split("url", "://"), 2), "#", 1)
    p = p.select("page_id", "url", "html", F.coalesce(at, F.lit("")).alias("at")).withColumn("host", F.substring_index("at", "/", 1))
    rest = F.expr("substring(at, length(host) + 2)")
    folder = F.get(F.split(F.substring_index("at", "?", 1), "/"), F.lit(1))
    base = F.concat(F.lit("OPS/"), F.coalesce(folder, F.lit("")), F.lit("/"), F.col("page_id").cast("string"), F.lit(".html"))
    own = [F.col("url"), F.concat(F.lit("//"), "at"), rest, F.concat(F.lit("../"), rest), F.concat(F.lit("../../../"), "host"), F.concat(F.lit("#"), "host"), F.concat(F.lit("img\\"), "host")]
    refs = F.concat(F.regexp_extract_all("html", F.lit('(?:href|src)="([^"]*)"'), F.lit(1)), F.array(*own))
    r = p.select("page_id", base.alias("base"), F.explode(refs).alias("ref")).where("NOT contains(ref, '%')")
    out = r.select("page_id", "ref", P.resolve(F.col("base"), F.col("ref")).alias("resolved"), P.is_external(F.col("ref")).alias("external"), P.escapes_root(F.col("base"), F.col("ref")).alias("escapes"))
    return out.groupBy("page_id", "ref", "resolved", "external", "escapes").agg(F.count("*").alias("n"))


@query(
    "local_paths",
    r"""WITH t AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'see C:\x' WHEN 1 THEN 'at /home/me/a' WHEN 2 THEN 'http://a/home/me' WHEN 3 THEN '/mnt/c/x' ELSE html END AS s FROM pages)
    SELECT page_id, regexp_matches(s, '(^|[^A-Za-z0-9_])([A-Za-z]:\\[^\\/]|[A-Za-z]:\\$|[A-Za-z]:/[^\\/]|file://)') OR regexp_matches(s, '(^|[^A-Za-z0-9_./])/(Users|home)/[A-Za-z0-9_]') OR regexp_matches(s, '(^|[^A-Za-z0-9_./])/mnt/[a-z](/|$|\s)') AS leaks FROM t""",
)
def local_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that name a path of somebody's machine."""
    k = F.col("page_id") % 5
    s = F.when(k == 0, "see C:\\x").when(k == 1, "at /home/me/a").when(k == 2, "http://a/home/me").when(k == 3, "/mnt/c/x").otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", P.local_path(s).alias("leaks"))


@query(
    "commit_messages",
    r"""WITH m AS (SELECT conv_id, turn, regexp_replace(text, '\s+', ' ', 'g') AS t FROM conversations),
    j AS (SELECT conv_id, turn, length(replace(t, ' ', '')) AS n, turn % 3 AS k FROM m)
    SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN n < 40 THEN 'ZH summary section is too short' END, CASE WHEN k = 1 THEN 'missing EN summary section' WHEN n < 40 THEN 'EN summary section is too short' END, CASE WHEN k = 2 THEN 'JA label must be on its own line' END, CASE WHEN k = 2 THEN 'missing JA summary section' WHEN n < 40 THEN 'JA summary section is too short' END], lambda x: x IS NOT NULL), '; ') AS issues FROM j""",
)
def commit_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with messages that need a section in each of three languages."""
    t = F.regexp_replace("text", r"\s+", " ")
    k = F.col("turn") % 3
    english = F.when(k == 1, F.lit("")).otherwise(F.concat(F.lit("EN:\n"), t, F.lit("\n")))
    japanese = F.when(k == 2, F.concat(F.lit("JA: inline\n"))).otherwise(F.concat(F.lit("JA:\n"), t))
    message = F.concat(F.lit("Title\n\nZH:\n"), t, F.lit("\n"), english, japanese)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(message_issues(message), "; ").alias("issues"))


def message_issues(message, least: int = 40, labels: tuple[str, ...] = ("ZH", "EN", "JA")):
    """array<string>: a title, a body, and below a label alone on its line at least `least` characters that aren't blank, for each label."""
    title, body = F.trim(F.substring_index(message, "\n", 1)), F.trim(F.regexp_replace(message, r"^[^\n]*\n?", ""))
    out = [F.when(title == "", "missing commit title"), F.when(body == "", "missing detailed commit body")]
    every = "|".join(labels)
    for label in labels:
        held = F.regexp_extract(F.concat(F.lit("\n"), body), rf"(?s)\n[ \t]*{label}:[^\n]*(?:\n(.*?))?(?=\n[ \t]*(?:{every}):|$)", 1)
        there, inline = F.concat(F.lit("\n"), body).rlike(rf"\n[ \t]*{label}:"), F.concat(F.lit("\n"), body).rlike(rf"\n[ \t]*{label}:[ \t]*[^\s]")
        n = F.length(F.regexp_replace(held, r"\s", ""))
        out.append(F.when((body != "") & inline, f"{label} label must be on its own line"))
        out.append(F.when((body != "") & (~there | (n == 0)), f"missing {label} summary section").when((body != "") & (n < least), f"{label} summary section is too short"))
    return F.array_compact(F.array(*out))


@query(
    "boundary_pack",
    r"""WITH d AS (SELECT doc_id, split_part(text, chr(10), 1) AS t, doc_id % 37 AS p FROM documents), e AS (SELECT *, least(p, length(t)) AS pos, list_filter(range(0, length(t) + 1), lambda i: i <= 0 OR i >= length(t) OR NOT (regexp_matches(substr(t, i, 1), '[\p{L}\p{N}]') AND regexp_matches(substr(t, i + 1, 1), '[\p{L}\p{N}]'))) AS near FROM d)
    SELECT doc_id, (list_sort(list_transform(near, lambda i: abs(i - pos) * 100000 + i))[1] % 100000)::BIGINT AS boundary, md5(CASE WHEN length(t) <= 40 THEN t ELSE left(t, coalesce(list_min(list_filter(range(1, length(t) + 1), lambda i: i >= 40 AND regexp_matches(substr(t, i, 1), '[.!?。！？]'))), length(t))) END) AS cut_md5 FROM e""",
)
def boundary_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that are not within a word, and cuts at the end of a sentence, in titles."""
    t = T.title_of(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", N.word_boundary(t, F.col("doc_id") % 37).alias("boundary"), F.md5(N.sentence_cut(t, 40)).alias("cut_md5"))
