"""Measures, classifications and scans of texts, each one expression over a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.chunking import byte_groups, chunk_text
from ..registry import query
from ..sources.shared import materialise, prepare
from ..sources.tables import table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


_CHUNKS = r"""p AS (SELECT doc_id, list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), lambda x: {'chunks': []::VARCHAR[], 'cur': x}) AS ps FROM documents),
folded AS (SELECT doc_id, list_reduce(ps, lambda a, x: CASE
    WHEN length(x.cur) > 400 THEN {'chunks': list_concat(CASE WHEN a.cur <> '' THEN list_append(a.chunks, a.cur) ELSE a.chunks END, list_transform(range(0, length(x.cur), 370), lambda i: substr(x.cur, (i + 1)::BIGINT, 400))), 'cur': ''}
    WHEN length(a.cur) + length(x.cur) + 2 <= 400 THEN {'chunks': a.chunks, 'cur': CASE WHEN a.cur = '' THEN x.cur ELSE a.cur || chr(10) || chr(10) || x.cur END}
    ELSE {'chunks': CASE WHEN a.cur <> '' THEN list_append(a.chunks, a.cur) ELSE a.chunks END, 'cur': x.cur} END, {'chunks': []::VARCHAR[], 'cur': ''}) AS s FROM p),
plain AS (SELECT doc_id, CASE WHEN s.cur <> '' THEN list_append(s.chunks, s.cur) ELSE s.chunks END AS c FROM folded),
chunks AS (SELECT doc_id, (i - 1)::BIGINT AS chunk_idx, len(c)::BIGINT AS total_chunks, CASE WHEN i = 1 THEN c[1] ELSE right(c[i - 1], 30) || c[i] END AS chunk_text FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM plain))"""


def chunks_of(docs: DataFrame, size: int = 400, overlap: int = 30, separator: str = "\n") -> DataFrame:
    """(doc_id, chunk_idx, total_chunks, chunk_text)."""
    prepare(docs.sparkSession)
    c = docs.select("doc_id", chunk_text(F.col("text"), size, overlap, separator).alias("c"))
    return c.select("doc_id", F.size("c").cast("bigint").alias("total_chunks"), F.posexplode("c").alias("i", "chunk_text")).select("doc_id", F.col("i").cast("bigint").alias("chunk_idx"), "total_chunks", "chunk_text")


@query("chunk_text", f"WITH {_CHUNKS} SELECT doc_id, chunk_idx, total_chunks, md5(chunk_text) AS chunk_md5, length(chunk_text) AS n_chars FROM chunks")
def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping chunks of every document, lines as paragraphs."""
    c = chunks_of(documents(spark, sf_dir))
    return c.select("doc_id", "chunk_idx", "total_chunks", F.md5("chunk_text").alias("chunk_md5"), T.n_chars(F.col("chunk_text")).alias("n_chars"))


@query(
    "fulltext_context",
    f"""WITH {_CHUNKS}, literals AS (SELECT * FROM (SELECT doc_id AS query_id, array_to_string(string_split(lower(split_part(text, chr(10), 1)), ' ')[1:2], ' ') AS literal FROM documents WHERE doc_id % 50 = 0) WHERE length(literal) >= 3),
    near AS (SELECT *, lag(chunk_text) OVER w AS before, lead(chunk_text) OVER w AS after FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_idx)),
    hit AS (SELECT l.query_id, c.*, (length(lower(chunk_text)) - length(replace(lower(chunk_text), literal, ''))) // length(literal) AS hits FROM near c, literals l WHERE contains(lower(chunk_text), literal)),
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY hits DESC, chunk_idx) AS b FROM hit),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, doc_id) AS rank FROM best WHERE b = 1)
    SELECT query_id, doc_id, chunk_idx, hits, md5(before) AS before_md5, md5(after) AS after_md5, rank FROM ranked WHERE rank <= 10""",
)
def fulltext_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the literal of each document whose id is divisible by 50: the best chunk of each parent among all chunks, ten parents, each with the chunk before and after."""
    from .retrieval import asked_once, for_all, keyword_hits, literals_of

    # a chunk has a number of its own, whatever its document's is, and is cut once
    c = materialise(chunks_of(documents(spark, sf_dir)).withColumn("key", F.monotonically_increasing_id()), "chunks")
    each, members = asked_once(literals_of(spark, sf_dir).select("query_id", F.lower("literal").alias("literal")), "literal")
    hits = keyword_hits(c.select("key", F.lit("").alias("title"), F.col("chunk_text").alias("abstract")), each)
    found = hits.select("query_id", "key", F.col("abstract_hits").alias("hits")).join(c.select("key", "doc_id", "chunk_idx"), "key")
    best = found.groupBy("query_id", "doc_id").agg(F.max_by("chunk_idx", F.struct("hits", -F.col("chunk_idx"))).alias("chunk_idx"), F.max("hits").alias("hits"))
    top = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hits"), "doc_id")).cast("bigint")).where("rank <= 10")
    beside = lambda k, name: c.select("doc_id", (F.col("chunk_idx") - k).alias("chunk_idx"), F.md5("chunk_text").alias(name))
    near = top.join(beside(-1, "before_md5"), ["doc_id", "chunk_idx"], "left").join(beside(1, "after_md5"), ["doc_id", "chunk_idx"], "left")
    return for_all(near, members).select("query_id", "doc_id", "chunk_idx", "hits", "before_md5", "after_md5", "rank")


@query(
    "passages",
    f"WITH {_CHUNKS} SELECT doc_id, chunk_idx, substr(chunk_text, greatest(strpos(chunk_text, 'tion') - 40, 1), 84) AS snippet FROM chunks WHERE contains(chunk_text, 'tion')",
)
def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks that hold a literal, with the text around its first place."""
    return passages_of(documents(spark, sf_dir), "tion")


def passages_of(docs: DataFrame, literal: str, around: int = 40) -> DataFrame:
    """(doc_id, chunk_idx, snippet) of the chunks of docs that hold a literal."""
    c = chunks_of(docs).where(F.contains("chunk_text", F.lit(literal)))
    at = F.greatest(F.instr("chunk_text", literal) - around, F.lit(1))
    return c.select("doc_id", "chunk_idx", F.substring("chunk_text", at, F.lit(len(literal) + 2 * around)).alias("snippet"))


@query(
    "nonspace_cjk",
    r"""SELECT doc_id, length(regexp_replace(text, '[ \t\n\v\f\r\x{00A0}\x{2000}-\x{200A}\x{3000}]', '', 'g')) AS non_space,
    round(length(regexp_replace(text, '[^\x{4E00}-\x{9FFF}]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(text, '[ \t\n\v\f\r\x{00A0}\x{2000}-\x{200A}\x{3000}]', '', 'g')), 0), 6) AS cjk FROM documents WHERE text <> ''""",
)
def nonspace_cjk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that are not white space, and the share of ideographs among them."""
    return documents(spark, sf_dir).where("text <> ''").select("doc_id", T.non_space(F.col("text")).alias("non_space"), F.round(T.cjk_ratio(F.col("text")), 6).alias("cjk"))


@query(
    "text_quality_route",
    r"""WITH m AS (SELECT doc_id, source, length(text) AS n, length(regexp_replace(text, '[^\x{E000}-\x{F8FF}#$%&*]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(text, '\s', '', 'g')), 0) AS bad FROM documents)
    SELECT doc_id, CASE WHEN source = 'src3' THEN 'forced' WHEN n >= 240 AND NOT (n >= 1000 AND coalesce(bad, 0) >= 0.005) THEN 'direct' WHEN n >= 240 THEN 'layout' WHEN source IN ('src1', 'src2') THEN 'pipeline' ELSE 'ocr' END AS route FROM m""",
)
def text_quality_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which route a text takes: forced, direct if it can be read and is clean, by layout if it is degraded, else by its type."""
    bad = F.try_divide(F.length(F.regexp_replace("text", r"[^\x{E000}-\x{F8FF}#$%&*]", "")).cast("double"), F.length(F.regexp_replace("text", r"\s", "")))
    n, degraded = F.length("text"), (F.length("text") >= 1000) & (F.coalesce(bad, F.lit(0.0)) >= 0.005)
    route = F.when(F.col("source") == "src3", "forced").when((n >= 240) & ~degraded, "direct").when(n >= 240, "layout").when(F.col("source").isin("src1", "src2"), "pipeline").otherwise("ocr")
    return documents(spark, sf_dir).select("doc_id", route.alias("route"))


@query(
    "markdown_metrics",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, '^ {0,3}#{1,6}( |$)')) AS headings, count(*) FILTER (WHERE regexp_matches(line, '\|.*\|') AND NOT regexp_matches(line, '^[ |:-]+$')) AS table_rows,
    count(*) FILTER (WHERE regexp_matches(line, '^[*+-] ')) AS bullets, sum(len(regexp_extract_all(line, 'https?://[^ ]+')))::BIGINT AS links, count(*) AS lines FROM l GROUP BY doc_id""",
)
def markdown_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, rows of tables, bullets, links and lines of each text: filters over the array of its lines, no shuffle."""
    lines, count = F.split("text", "\n"), lambda a, f: F.size(F.filter(a, f)).cast("bigint")
    d = documents(spark, sf_dir).select("doc_id", lines.alias("l"), "text")
    return d.select(
        "doc_id",
        count(F.col("l"), lambda x: x.rlike(r"^ {0,3}#{1,6}( |$)")).alias("headings"),
        count(F.col("l"), lambda x: x.rlike(r"\|.*\|") & ~x.rlike(r"^[ |:-]+$")).alias("table_rows"),
        count(F.col("l"), lambda x: x.rlike(r"^[*+-] ")).alias("bullets"),
        T.count_of(F.col("text"), r"https?://[^ \n]+").alias("links"),
        F.size("l").cast("bigint").alias("lines"),
    )


@query(
    "language_signal",
    r"""SELECT doc_id, CASE WHEN regexp_matches(text, '[ñó]') AND NOT regexp_matches(text, '[äß]') THEN 'es' WHEN regexp_matches(text, '[äöüß]') THEN 'de' WHEN regexp_matches(text, '[éèêç]') THEN 'fr' ELSE 'en' END AS signal FROM documents""",
)
def language_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal of the language by letters, in order."""
    c = F.col("text")
    signal = F.when(c.rlike("[ñó]") & ~c.rlike("[äß]"), "es").when(c.rlike("[äöüß]"), "de").when(c.rlike("[éèêç]"), "fr").otherwise("en")
    return documents(spark, sf_dir).select("doc_id", signal.alias("signal"))


@query(
    "keyword_classify",
    r"""SELECT doc_id, CASE WHEN regexp_matches(' ' || lower(text) || ' ', '[^a-z0-9](licenses?|copyrights?|works?)[^a-z0-9]') THEN 'law' WHEN contains(lower(text), 'token') OR contains(lower(text), 'password') THEN 'adjacent' ELSE 'other' END AS class,
    nullif(regexp_extract(' ' || lower(text) || ' ', '[^a-z0-9](licenses?|copyrights?|works?)[^a-z0-9]', 1), '') AS basis FROM documents""",
)
def keyword_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three classes by keywords that stand apart, plural or not, and by substrings; with the first keyword found."""
    low = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    pattern = r"[^a-z0-9](licenses?|copyrights?|works?)[^a-z0-9]"
    kind = F.when(low.rlike(pattern), "law").when(F.contains(low, F.lit("token")) | F.contains(low, F.lit("password")), "adjacent").otherwise("other")
    return documents(spark, sf_dir).select("doc_id", kind.alias("class"), F.nullif(F.regexp_extract(low, pattern, 1), F.lit("")).alias("basis"))



@query(
    "keywords_top",
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(split_part(text, chr(10), 1), '[A-Za-z][A-Za-z-]{3,}') AS l FROM documents), u AS (SELECT doc_id, lower(x.w) AS w, min(x.i) AS i FROM (SELECT doc_id, unnest(list_transform(l, lambda v, k: {'w': v, 'i': k})) AS x FROM w) GROUP BY doc_id, lower(x.w)),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM u WHERE w NOT IN ('that', 'this', 'with', 'from', 'para', 'dans', 'nicht')) SELECT doc_id, w AS keyword, k AS place FROM r WHERE k <= 5""",
)
def keywords_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five different words of each title that aren't stop words: array functions, no shuffle."""
    return keywords(documents(spark, sf_dir)).select("doc_id", F.posexplode("k").alias("i", "keyword")).select("doc_id", "keyword", (F.col("i") + 1).cast("bigint").alias("place"))


def keywords(docs: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, k array<string>): the first n keywords of a title."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(T.title_of(F.col("text")), F.lit("[A-Za-z][A-Za-z-]{3,}"), F.lit(0)), F.lower))
    stop = F.array(*map(F.lit, ("that", "this", "with", "from", "para", "dans", "nicht")))
    return docs.select("doc_id", F.slice(F.array_except(words, stop), 1, n).alias("k"))


@query(
    "knowledge_graph",
    r"""WITH w AS (SELECT doc_id, source, regexp_extract_all(split_part(text, chr(10), 1), '[A-Za-z][A-Za-z-]{3,}') AS l FROM documents), u AS (SELECT doc_id, source, lower(x.w) AS w, min(x.i) AS i FROM (SELECT doc_id, source, unnest(list_transform(l, lambda v, k: {'w': v, 'i': k})) AS x FROM w) GROUP BY doc_id, source, lower(x.w)),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM u WHERE w NOT IN ('that', 'this', 'with', 'from', 'para', 'dans', 'nicht'))
    SELECT source, 'section:' || doc_id AS target, 'contains' AS kind FROM documents UNION ALL SELECT 'section:' || doc_id, 'keyword:' || w, 'theme' FROM r WHERE k <= 2""",
)
def knowledge_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from books to sections and from sections to their first two keywords."""
    d = documents(spark, sf_dir)
    section = F.concat(F.lit("section:"), F.col("doc_id"))
    contains = d.select("source", section.alias("target"), F.lit("contains").alias("kind"))
    theme = keywords(d, 2).select(section.alias("source"), F.explode("k").alias("w")).select("source", F.concat(F.lit("keyword:"), "w").alias("target"), F.lit("theme").alias("kind"))
    return contains.union(theme)


#: The pattern of a keyword, words that are none, and what stands for a text without any.
KEYWORD = r"[\x{4E00}-\x{9FFF}]{2,}|[A-Za-z][A-Za-z-]{3,}"
NO_KEYWORDS = ("这是", "这个", "说明", "主要", "内容", "chapter", "section", "with", "from", "that", "this")
CORE = "核心主题"


def theme_keywords(text: Column) -> Column:
    """array<string>: the different keywords of a text, runs of Han signs and Latin words as they are written, in the order in which they first come; one that stands for all where there is none."""
    words = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({KEYWORD})"), F.lit(1)))
    found = F.filter(words, lambda w: ~F.lower(w).isin(*NO_KEYWORDS))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(CORE)))


_THEMES = rf"""x AS (SELECT doc_id, source, regexp_replace(text, ' (un|le|der|and) ', ' 中文' || length(source) || '的 ', 'g') AS text FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, source, regexp_extract_all(text, '{KEYWORD}') AS l FROM x),
    u AS (SELECT doc_id, source, w, min(i) AS i FROM (SELECT doc_id, source, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS i FROM w) WHERE lower(w) NOT IN ({", ".join(f"'{n}'" for n in NO_KEYWORDS)}) GROUP BY doc_id, source, w),
    k AS (SELECT doc_id, source, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM u UNION ALL SELECT doc_id, source, '{CORE}', 1 FROM x WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.doc_id = x.doc_id))"""


@query(
    "theme_graph",
    f"""WITH {_THEMES} SELECT source AS book, 'book' AS source_node, 'section-' || doc_id AS target_node, 'contains' AS kind FROM x UNION ALL SELECT source, 'section-' || doc_id, 'keyword-' || w, 'theme' FROM k WHERE k <= 2
      UNION ALL SELECT DISTINCT source, NULL, 'keyword-' || w, 'node' FROM k WHERE k <= 2""",
)
def theme_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books, their sections, and the first two keywords of the whole text of each; every keyword of a book is one node. Some frequent words are made Han, as the tables hold none."""
    text = F.regexp_replace("text", " (un|le|der|and) ", " 中文@的 ")
    d = documents(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.col("source").alias("book"), F.replace(text, F.lit("@"), F.length("source").cast("string")).alias("text"))
    section = F.concat(F.lit("section-"), F.col("doc_id"))
    contains = d.select("book", F.lit("book").alias("source_node"), section.alias("target_node"), F.lit("contains").alias("kind"))
    theme = d.select("book", section.alias("source_node"), F.explode(F.slice(theme_keywords(F.col("text")), 1, 2)).alias("w")).select("book", "source_node", F.concat(F.lit("keyword-"), "w").alias("target_node"), F.lit("theme").alias("kind"))
    nodes = theme.select("book", F.lit(None).cast("string").alias("source_node"), "target_node", F.lit("node").alias("kind")).distinct()
    return contains.union(theme).union(nodes)


@query("topology_edges", "SELECT source AS book, doc_id AS section, next AS following FROM (SELECT source, doc_id, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS next FROM documents) WHERE next IS NOT NULL")
def topology_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from each section to the next of its book, repeated ids in a row too."""
    d = documents(spark, sf_dir).select("source", "doc_id")
    return next_in_group(d, "source", "doc_id").where("following IS NOT NULL").select(F.col("source").alias("book"), F.col("doc_id").alias("section"), "following")


def next_in_group(rows: DataFrame, group: str, order: str, span: int = 65_536) -> DataFrame:
    """rows (group, order) with `following`, the next of the group; `order` is a whole number.

    A group is cut into spans of the order, so one that holds a third of all rows is not one
    task; of each span only the first member, for the last of the span before, meets the group.
    """
    cut = rows.select(group, order, F.floor(F.col(order) / span).alias("_span"))
    within = F.lead(order).over(Window.partitionBy(group, "_span").orderBy(order))
    firsts = cut.groupBy(group, "_span").agg(F.min(order).alias("_first"))
    firsts = firsts.select(F.col(group).alias("_group"), F.col("_span").alias("_of"), F.lead("_first").over(Window.partitionBy(group).orderBy("_span")).alias("_next"))
    out = cut.withColumn("following", within)
    return out.join(firsts, F.col(group).eqNullSafe(F.col("_group")) & F.col("_span").eqNullSafe(F.col("_of")), "left").select(group, order, F.coalesce("following", "_next").alias("following"))


@query(
    "digest_decision",
    """WITH t AS (SELECT doc_id, string_split(lower(split_part(text, chr(10), 1)), ' ') AS w, len(string_split(text, chr(10))) AS sections FROM documents)
    SELECT doc_id, CASE WHEN list_has_any(w, ['not', 'or']) THEN FALSE WHEN list_has_any(w, ['the']) THEN TRUE ELSE sections >= 4 END AS digest FROM t""",
)
def digest_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a digest is made: excluded words first, included ones, else at least four sections."""
    w = F.split(F.lower(T.title_of(F.col("text"))), " ")
    has = lambda *x: F.arrays_overlap(w, F.array(*map(F.lit, x)))
    return documents(spark, sf_dir).select("doc_id", F.when(has("not", "or"), False).when(has("the"), True).otherwise(F.size(F.split("text", "\n")) >= 4).alias("digest"))


@query(
    "leak_scan",
    r"""SELECT page_id, 'script' AS kind, len(regexp_extract_all(html, '<script')) AS n FROM pages WHERE regexp_matches(html, '<script') UNION ALL
    SELECT page_id, 'local_link', len(regexp_extract_all(html, 'href="/[A-Za-z]')) FROM pages WHERE regexp_matches(html, 'href="/[A-Za-z]')""",
)
def leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds of each kind in each page: one pass, a row for each kind that occurs."""
    kinds = {"script": "<script", "local_link": 'href="/[A-Za-z]'}
    found = F.array(*(F.struct(F.lit(k).alias("kind"), T.count_of(F.col("html"), p).alias("n")) for k, p in kinds.items()))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(found).alias("f")).select("page_id", "f.*").where("n > 0")


@query(
    "redact",
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '<email>', 'g'), '(token|password)( ?= ?)["A-Za-z0-9]+', '\1\2<secret>', 'g')) AS redacted_md5 FROM documents WHERE regexp_matches(text, '@|token|password')""",
)
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses and secrets blanked out of the texts that may hold some."""
    out = F.regexp_replace(F.regexp_replace("text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "<email>"), r'(token|password)( ?= ?)["A-Za-z0-9]+', "$1$2<secret>")
    return documents(spark, sf_dir).where(F.col("text").rlike("@|token|password")).select("doc_id", F.md5(out).alias("redacted_md5"))


@query(
    "preserved_literals",
    r"""WITH l AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|https?://[^ \n]+|[0-9]{10,}'))) AS literal FROM documents) SELECT DISTINCT doc_id, literal FROM l""",
)
def preserved_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different addresses, links and long numbers of each text, which a translation must keep."""
    found = F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|https?://[^ \n]+|[0-9]{10,}"), F.lit(0))
    return documents(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(F.transform(found, F.lower))).alias("literal"))


@query(
    "slug_year",
    r"""SELECT o_orderkey AS key, regexp_replace(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
    try_cast(nullif(regexp_extract(' revised ' || strftime(o_orderdate, '%Y-%m-%d') || ' ', '[^A-Za-z0-9_]((?:19|20)[0-9]{2})[^A-Za-z0-9_]', 1), '') AS BIGINT) AS year FROM orders""",
)
def slug_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slug of a label, and the year of a free-form date."""
    date = F.concat(F.lit("revised "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), T.slug(F.col("o_orderpriority")).alias("slug"), T.bibliographic_year(date).alias("year"))


@query("dirty_names", "SELECT p_partkey AS key, p_name AS name FROM part WHERE regexp_matches(lower(p_name), '^[a-z]+ [0-9]*7$') OR lower(p_type) IN ('promo', 'small')")
def dirty_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that say nothing, by pattern and by list."""
    return table(spark, sf_dir, "part").where(F.lower("p_name").rlike("^[a-z]+ [0-9]*7$") | F.lower("p_type").isin("promo", "small")).select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))


@query(
    "html_sections",
    r"""SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title, len(regexp_extract_all(html, '<p>')) AS paragraphs, len(regexp_extract_all(html, '<li>')) AS items, len(regexp_extract_all(html, '<a href=')) AS links,
    length(regexp_replace(html, '<[^>]*>', '', 'g')) AS visible FROM pages""",
)
def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and counts of the flat tags of a page, and the length of its text without tags."""
    c = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(c, "<h1>([^<]*)</h1>", 1).alias("title"), *(T.count_of(c, p).alias(n) for n, p in (("paragraphs", "<p>"), ("items", "<li>"), ("links", "<a href="))), T.n_chars(F.regexp_replace(c, "<[^>]*>", "")).alias("visible"))


@query("jsonl_pages", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS page_no, try_cast(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def jsonl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects read from lines of JSON, numbered as pages within their file; lines that can't be read are left out."""
    e = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k bigint")["k"]).where("k IS NOT NULL")
    return e.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint").alias("page_no"), "k")


@query(
    "string_pack",
    r"""SELECT doc_id, length(trim(regexp_replace(text, '[ \t\n\v\f\r\x{00A0}]+', ' ', 'g'))) AS collapsed, CASE WHEN length(split_part(text, chr(10), 1)) <= 40 THEN split_part(text, chr(10), 1) ELSE rtrim(substr(split_part(text, chr(10), 1), 1, 40)) || '...' END AS short,
    regexp_replace(lower(split_part(text, chr(10), 1)), '[^\p{L}\p{N}]', '', 'g') AS title_key, len(regexp_extract_all(text, '[0-9]{10,}')) AS long_numbers, sha256(text) AS sha FROM documents""",
)
def string_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms of texts and titles."""
    c, title = F.col("text"), T.title_of(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", T.n_chars(T.collapse(c)).alias("collapsed"), T.truncate(title, 40).alias("short"), T.alnum_key(title).alias("title_key"), T.count_of(c, "[0-9]{10,}").alias("long_numbers"), F.sha2(c, 256).alias("sha"))


@query(
    "byte_groups",
    """WITH u AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: {'done': []::BIGINT[], 'n': octet_length(encode(x))::BIGINT, 'k': 1::BIGINT}) AS l FROM documents),
    f AS (SELECT doc_id, list_reduce(l, lambda a, x: CASE WHEN a.n + x.n <= 2000 OR a.k = 0 THEN {'done': a.done, 'n': a.n + x.n, 'k': a.k + 1} ELSE {'done': list_append(a.done, a.k), 'n': x.n, 'k': 1::BIGINT} END, {'done': []::BIGINT[], 'n': 0::BIGINT, 'k': 0::BIGINT}) AS s FROM u)
    SELECT doc_id, len(list_append(s.done, s.k)) AS n_groups, list_max(list_append(s.done, s.k)) AS most_units FROM f""",
)
def byte_groups_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines grouped greedily up to 2000 bytes."""
    prepare(spark)
    g = documents(spark, sf_dir).select("doc_id", byte_groups(F.split("text", "\n"), 2000).alias("g"))
    return g.select("doc_id", F.size("g").cast("bigint").alias("n_groups"), F.array_max(F.transform("g", F.size)).cast("bigint").alias("most_units"))
