"""Named queries over the test tables: each runs the library's operators and has its equivalent in SQL."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findmill.functions import text as X
from findmill.functions.recover import recovered_json
from findmill.functions.rules import DEFAULTS, MODELS, MODES, SOFT_TERMS
from findmill.operators import chunks as C
from findmill.operators import findings as D
from findmill.operators import inference as I
from findmill.operators import report as R
from findmill.operators import rollup as A
from findmill.operators import search_index as S
from findmill.plans.engine import run_scan, run_status
from findmill.sources.store import work_path
from findmill.sources.history import newest
from findmill.sources.tree import source_tree, write_tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("."), "lang").alias("file"), F.col("text").alias("content"))


SEVERITY_SQL = """CASE WHEN lower({0}) LIKE '%crit%' THEN 'Critical' WHEN lower({0}) LIKE '%high%' THEN 'High'
 WHEN lower({0}) LIKE '%med%' THEN 'Medium' ELSE 'Low' END"""
ORDER_SEVERITY = SEVERITY_SQL.format("replace(o_orderpriority, 'URGENT', 'CRITICAL')")
SOFT_SQL = " OR ".join(f"contains(lower({{0}}), '{t}')" for t in SOFT_TERMS)
CHUNK_SQL = """SELECT doc_id, source || '.' || lang AS file, CAST(i AS INTEGER) AS chunk_idx,
 CAST(ceil(length(text) / 500.0) AS INTEGER) AS n_chunks, substr(text, CAST(i * 500 + 1 AS BIGINT), 1000) AS chunk
 FROM (SELECT *, unnest(range(CAST(ceil(length(text) / 500.0) AS BIGINT))) AS i FROM documents WHERE regexp_matches(text, '\\S'))"""
RANK_SQL = "CASE {0} WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END"


def order_severity() -> F.Column:
    return X.severity(F.replace("o_orderpriority", F.lit("URGENT"), F.lit("CRITICAL")))


@query(f"""
WITH c AS ({CHUNK_SQL}), s AS (
 SELECT *, CASE doc_id % 4 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS severity,
 CASE WHEN {SOFT_SQL.format('chunk')} THEN 85.0 ELSE 100.0 END - CASE WHEN chunk_idx = 0 THEN 10.0 ELSE 0.0 END AS base FROM c),
 r AS (SELECT *, (base + (doc_id * 7 + chunk_idx * 13) % 101) / 2 AS confidence FROM s),
 k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, chunk_idx) AS n FROM r WHERE confidence >= 20)
SELECT file, count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'High') AS high,
 count(*) FILTER (severity = 'Medium') AS medium, count(*) FILTER (severity = 'Low') AS low,
 CAST(floor(sum(CAST(confidence * 2 AS BIGINT)) * 50 / count(*)) AS BIGINT) AS confidence_x100,
 CAST(100 - 20 * count(*) FILTER (severity = 'Critical') - 10 * count(*) FILTER (severity = 'High') AS BIGINT) AS score
FROM k WHERE n <= 6 GROUP BY file""")
def audit_rollup(spark, sf_dir):
    """Flagship: chunks, confidence of each, the best six of a document, counts and score by file."""
    cut = C.chunks(files_of(spark, sf_dir), 1000)
    number = (F.col("doc_id") * 7 + F.col("chunk_idx") * 13) % 101
    scored = cut.select(
        "doc_id", "file", F.lit(0).alias("_"), F.col("chunk_idx").alias("response_pos"),
        F.element_at(F.array(*map(F.lit, ("Critical", "High", "Medium", "Low"))), (F.col("doc_id") % 4 + 1).cast("int")).alias("severity"),
        D.confidence(F.col("chunk"), F.lit(1.0), F.col("chunk_idx").cast("string"), number.cast("double"), F.lit(0)).alias("confidence"),
    )
    best = D.select_findings(
        scored.withColumn("_s", F.col("severity")).withColumn("severity", F.lit("High")), "deep", ("doc_id",)
    ).withColumn("severity", F.col("_s"))
    made = best.groupBy("file").agg(
        *A.severity_counts(F.col("severity")),
        F.floor(F.sum((F.col("confidence") * 2).cast("long")) * 50 / F.count("*")).alias("confidence_x100"),
    )
    return made.withColumn("score", A.score(F.col("critical"), F.col("high")))


@query(f"SELECT doc_id, chunk_idx, n_chunks, CAST(length(chunk) AS INTEGER) AS chunk_len, file FROM ({CHUNK_SQL})")
def chunk_overlap(spark, sf_dir):
    return C.chunks(files_of(spark, sf_dir), 1000).select("doc_id", "chunk_idx", "n_chunks", F.length("chunk").alias("chunk_len"), "file")


@query("""SELECT doc_id, CAST(CASE WHEN length(text) < 4000 THEN 1 ELSE ceil(length(text) / 3500.0) END AS BIGINT) AS n
FROM documents WHERE regexp_matches(text, '\\S')""")
def chunk_whole_file(spark, sf_dir):
    return C.chunks(files_of(spark, sf_dir), 4000, whole_file=True).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"""SELECT doc_id, chunk_idx, CAST(17 + length(file) + length(chunk) AS INTEGER) AS prompt_len,
 CAST(180 + 10 * ((17 + length(file) + length(chunk)) // 10000) AS INTEGER) AS timeout FROM ({CHUNK_SQL})""")
def prompt_build(spark, sf_dir):
    made = C.prompts(C.chunks(files_of(spark, sf_dir), 1000), ("File: ", "\n---\n", "\n---"), "\n")
    prompt = F.col("prompt")
    return made.select("doc_id", "chunk_idx", F.length(prompt).alias("prompt_len"), X.timeout_seconds(180, prompt).alias("timeout"))


@query("""WITH d AS (SELECT doc_id, string_split(CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS l FROM documents),
 n AS (SELECT doc_id, l, CAST(doc_id % len(l) + 1 AS BIGINT) AS line FROM d),
 x AS (SELECT doc_id, line, l, unnest(range(greatest(1, line - 5), least(len(l), line + 5) + 1)) AS i FROM n)
SELECT doc_id, line, string_agg(CASE WHEN i = line THEN '>> ' ELSE '   ' END || i || ': ' || l[i], chr(10) ORDER BY i) AS context
FROM x GROUP BY doc_id, line""")
def line_context(spark, sf_dir):
    docs = files_of(spark, sf_dir)
    body = F.when(F.col("content").endswith("\n"), F.expr("left(content, length(content) - 1)")).otherwise(F.col("content"))
    line = (F.col("doc_id") % F.size(F.split(body, "\n")) + 1).cast("long")
    return docs.select("doc_id", line.alias("line"), "content").select("doc_id", "line", C.context(F.col("content"), F.col("line")).alias("context"))


@query("SELECT lang, count(*) AS n FROM documents WHERE regexp_matches(text, '\\S') GROUP BY lang")
def blank_filter(spark, sf_dir):
    return files_of(spark, sf_dir).where(X.has_text(F.col("content"))).groupBy(F.substring_index("file", ".", -1).alias("lang")).count().withColumnRenamed("count", "n")


_TREE_SQL = r"""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'dist/x/' WHEN 2 THEN '_lib/' ELSE 'src/' END || lang || '/' || 'd' || doc_id || file AS path, 'd' || doc_id || file AS file,
 regexp_replace(text, '\r\n?', chr(10), 'g') AS content FROM (SELECT *, CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.JS' WHEN 2 THEN '.test.js' WHEN 3 THEN '.env' ELSE '.d.ts' END AS file FROM documents) WHERE text IS NOT NULL"""
_SEEN_SQL = f"SELECT * FROM ({_TREE_SQL}) WHERE doc_id % 6 > 1"


def documents_tree(spark, sf_dir) -> str:
    """The documents as files of a tree in the shared folder: some in pruned folders, some with other suffixes."""
    pick = lambda by, *names: F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % by + 1).cast("int"))
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"), pick(5, ".py", ".JS", ".test.js", ".env", ".d.ts"))
    path = F.concat(pick(6, "node_modules/", "dist/x/", "_lib/", "src/", "src/", "src/"), "lang", F.lit("/"), name)
    folder = urlparse(work_path(spark, "tree")).path
    write_tree(table(spark, sf_dir, "documents").select(path.alias("path"), F.col("text").alias("content")), folder)
    return folder


@query(f"SELECT path, file, reverse(split_part(reverse(file), '.', 1)) AS ext, length(content) AS n_chars, md5(content) AS digest FROM ({_SEEN_SQL}) WHERE doc_id % 5 NOT IN (1, 3)")
def suffix_filter(spark, sf_dir):
    """A tree of files, walked with pruned folders and the suffixes of a mode."""
    folder = documents_tree(spark, sf_dir)
    files = source_tree(spark, folder, MODES["rapid"].suffixes)
    return files.select(F.substring(F.col("path"), F.lit(len(folder) + 2), F.length("path")).alias("path"), "file", "ext", F.length("content").cast("long").alias("n_chars"), F.md5(F.col("content").cast("binary")).alias("digest"))


@query(f"SELECT file, md5(content) AS digest FROM ({_SEEN_SQL}) WHERE path LIKE 'src/de/%' AND file LIKE '%.js'")
def tree_pushdown(spark, sf_dir):
    """Filters on path and name reach the walk of the tree."""
    folder = documents_tree(spark, sf_dir)
    wanted = source_tree(spark, folder).where(F.col("path").startswith(f"{folder}/src/de/") & (F.col("ext") == "js"))
    return wanted.select("file", F.md5(F.col("content").cast("binary")).alias("digest"))


@query("""WITH d AS (SELECT doc_id, string_split(CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS l FROM documents),
 f AS (SELECT doc_id, unnest(range(12)) AS k FROM documents UNION ALL SELECT doc_id, 12 FROM documents WHERE doc_id % 10 = 0),
 n AS (SELECT f.doc_id, k, l, CASE WHEN k = 3 THEN NULL ELSE (doc_id + k * 7) % (len(l) + 9) + 1 END AS line FROM f JOIN d USING (doc_id)),
 x AS (SELECT doc_id, k, line, l, unnest(range(greatest(1, line - 5), least(len(l), line + 5) + 1)) AS i FROM n WHERE k < 12 AND line IS NOT NULL),
 s AS (SELECT doc_id, k, string_agg(CASE WHEN i = line THEN '>> ' ELSE '   ' END || i || ': ' || l[i], chr(10) ORDER BY i) AS snippet FROM x GROUP BY doc_id, k)
SELECT n.doc_id, n.k, line, CASE WHEN n.k = 12 THEN 'Impossible d''extraire le contexte : gone/' || n.doc_id WHEN n.k = 5 THEN 'own' ELSE coalesce(nullif(snippet, ''), 'Code non disponible') END AS snippet
FROM n LEFT JOIN s ON s.doc_id = n.doc_id AND s.k = n.k""")
def snippets_band(spark, sf_dir):
    """Findings meet the lines around theirs: twelve or so a file, some beyond its end, some without a line or a file."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    k = F.sequence(F.lit(0).cast("long"), F.when(F.col("doc_id") % 10 == 0, 12).otherwise(11).cast("long"))
    n_lines = F.size(C.lines_of(F.col("text")))
    found = docs.select("doc_id", F.explode(k).alias("k"), n_lines.alias("n")).select(
        "doc_id", "k", F.when(F.col("k") != 3, (F.col("doc_id") + F.col("k") * 7) % (F.col("n") + 9) + 1).cast("long").alias("line"),
        F.concat(F.when(F.col("k") == 12, "gone/").otherwise("f/"), F.col("doc_id").cast("string")).alias("filepath"),
        F.when(F.col("k") == 5, "own").otherwise(DEFAULTS["snippet"]).alias("snippet"),
    )
    files = docs.select(F.concat(F.lit("f/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    return D.with_snippets(found, files).select("doc_id", "k", "line", "snippet")


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, coalesce(json_extract_string(props, '$.title'), 'Unknown') AS title FROM events")
def json_extract(spark, sf_dir):
    props = F.try_parse_json("props")
    get = lambda path, other: F.coalesce(F.try_variant_get(props, path, "string"), F.lit(other))
    return table(spark, sf_dir, "events").select("event_id", get("$.k", "none").alias("k"), get("$.title", "Unknown").alias("title"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""")
def json_recover(spark, sf_dir):
    """The props wrapped in prose, a list or a fence, or made unreadable."""
    kind, props = F.col("event_id") % 5, F.col("props")
    wrapped = (
        F.when(kind == 0, props).when(kind == 1, F.concat(F.lit("Answer: "), props, F.lit(" as asked")))
        .when(kind == 2, F.concat(F.lit("x ["), props, F.lit("] y"))).when(kind == 3, F.concat(F.lit("```json\n"), props, F.lit("\n```")))
        .otherwise(F.concat(props, F.lit(" and "), props))
    )
    found = F.parse_json(recovered_json(wrapped))
    k = F.coalesce(F.try_variant_get(found, "$.k", "bigint"), F.try_variant_get(found, "$[0].k", "bigint"))
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"))


@query(f"SELECT {ORDER_SEVERITY} AS severity, count(*) AS n FROM orders GROUP BY 1")
def severity_normalise(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(order_severity().alias("severity")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey AS key, nullif(TRY_CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS BIGINT), 0) AS line FROM part
UNION ALL SELECT page_id, nullif(TRY_CAST(regexp_replace(url, '[^0-9]', '', 'g') AS BIGINT), 0) FROM pages""")
def digits_line(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), X.digits(F.col("p_brand")).alias("line"))
    return part.unionAll(table(spark, sf_dir, "pages").select("page_id", X.digits(F.col("url"))))


@query(f"""WITH d AS (SELECT d.doc_id, text, quality, CASE WHEN d.doc_id % 9 = 0 THEN 'It SEEMS that ' || text ELSE text END AS t FROM documents d LEFT JOIN labels USING (doc_id))
SELECT doc_id, CAST(round(greatest(0.0, least(100.0, (100.0 - CASE WHEN {SOFT_SQL.format('t')} THEN 15.0 ELSE 0.0 END)
 * (0.7 + 0.3 * ((3 + CAST(quality IS NOT NULL AS INTEGER) + CAST(doc_id % 7 <> 0 AS INTEGER)) / 5.0)) - CASE WHEN doc_id % 7 = 0 THEN 10.0 ELSE 0.0 END)) * 100) AS BIGINT) AS confidence_x100 FROM d""")
def confidence_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    line = F.col("doc_id") % 7
    text = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("It SEEMS that "), "text")).otherwise(F.col("text"))
    complete = (3 + F.col("quality").isNotNull().cast("int") + (line != 0).cast("int")) / F.lit(5.0)
    made = D.confidence(text, complete, line.cast("string"), F.lit(None).cast("double"), F.lit(0))
    return docs.select("doc_id", F.round(made * 100).cast("long").alias("confidence_x100"))


@query("""SELECT p_partkey, CAST(CASE p_size % 3 WHEN 0 THEN CAST(contains(upper(p_type), 'XSS') AS INTEGER) + CAST(contains(upper(p_type), 'SQLI') AS INTEGER)
 WHEN 1 THEN CAST(contains(upper(p_type) || '|' || upper(p_name || ' resource'), 'RCE') AS INTEGER) + CAST(contains(upper(p_name), 'SQLI') OR contains(upper(p_type), 'SQLI') AS INTEGER) ELSE 0 END AS INTEGER) AS blocked FROM part""")
def type_blocklist(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, ("yml", "svg", "py"))), F.col("p_size") % 3 + 1)
    title = F.concat("p_name", F.when(F.col("p_size") % 3 == 1, " resource").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", X.blocked_terms(ext, F.col("p_type"), title).alias("blocked"))


@query(f"SELECT o_orderkey, {ORDER_SEVERITY} AS severity FROM orders WHERE {ORDER_SEVERITY} IN ('Critical', 'High')")
def severity_filter(spark, sf_dir):
    return D.by_severity(table(spark, sf_dir, "orders").select("o_orderkey", order_severity().alias("severity")), "rapid")


@query("SELECT event_id, value FROM events WHERE round(value, 2) >= 20")
def confidence_filter(spark, sf_dir):
    return D.by_confidence(table(spark, sf_dir, "events").withColumn("rounded", F.round("value", 2)), "rounded").select("event_id", "value")


@query("""SELECT l_orderkey, l_linenumber, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER
 (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) WHERE n <= 3""")
def topk_per_group(spark, sf_dir):
    order = (F.desc("l_extendedprice"), "l_linenumber", "l_partkey", "l_suppkey")
    return D.best_of(table(spark, sf_dir, "lineitem"), ("l_orderkey",), 3, order, "rank").select("l_orderkey", "l_linenumber", "rank")


@query("SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey, o_orderkey) AS id FROM orders")
def assign_ids(spark, sf_dir):
    return D.assign_ids(table(spark, sf_dir, "orders"), ("o_orderstatus",), ("o_custkey", "o_orderkey")).select("o_orderkey", "o_orderstatus", "id")


_COUNTS_SQL = ", ".join(f"count(*) FILTER (s = '{s}') AS {s.lower()}" for s in ("Critical", "High", "Medium", "Low"))
_SCORE_SQL = "CAST(100 - 20 * count(*) FILTER (s = 'Critical') - 10 * count(*) FILTER (s = 'High') AS BIGINT) AS score"


@query(f"SELECT o_custkey, {_COUNTS_SQL} FROM (SELECT *, {ORDER_SEVERITY} AS s FROM orders) GROUP BY o_custkey")
def severity_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(*A.severity_counts(order_severity()))


@query(f"SELECT o_custkey, {_SCORE_SQL} FROM (SELECT *, {ORDER_SEVERITY} AS s FROM orders) GROUP BY o_custkey")
def run_score(spark, sf_dir):
    counted = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(*A.severity_counts(order_severity()))
    return counted.select("o_custkey", A.score(F.col("critical"), F.col("high")).alias("score"))


_MEAN_SQL = "CAST((200 * sum({0}) + count(*)) // (2 * count(*)) AS DOUBLE) / 100"


@query(f"SELECT event_type, {_MEAN_SQL.format('event_id % 101')} AS mean, 0.0::DOUBLE AS empty FROM events GROUP BY event_type")
def mean_confidence(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("confidence", (F.col("event_id") % 101).cast("double"))
    empty = events.where("event_id < 0").agg(A.mean_confidence(F.col("confidence")).alias("empty"))
    return events.groupBy("event_type").agg(A.mean_confidence(F.col("confidence")).alias("mean")).withColumn("empty", empty.scalar())


@query(f"""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (s = 'Critical') AS critical, count(*) FILTER (s = 'High') AS high,
 count(*) FILTER (s = 'Medium') AS medium, count(*) FILTER (s = 'Low') AS low, {_MEAN_SQL.format('user_id % 101')} AS confidence_score, {_SCORE_SQL}
FROM (SELECT *, CASE event_id % 4 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS s FROM events) GROUP BY 1""")
def run_summary(spark, sf_dir):
    names = F.array(*map(F.lit, ("Critical", "High", "Medium", "Low")))
    rows = table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), F.element_at(names, (F.col("event_id") % 4 + 1).cast("int")).alias("severity"),
        (F.col("user_id") % 101).cast("double").alias("confidence"),
    )
    return A.run_summary(rows, "day")


@query("SELECT count(*) FILTER (event_type = 'purchase') AS successful_analyses, count(*) FILTER (event_type <> 'purchase') AS failed_analyses FROM events")
def call_counters(spark, sf_dir):
    status = F.when(F.col("event_type") == "purchase", "ok").otherwise("failed")
    return A.call_counters(table(spark, sf_dir, "events").select(status.alias("status")))


@query("SELECT event_type, min(event_id) AS first_id FROM events GROUP BY event_type")
def distinct_first_seen(spark, sf_dir):
    return A.first_seen(table(spark, sf_dir, "events"), "event_type", "event_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'token = ') OR contains(lower(source), 'token = ') OR (doc_id <> 0 AND contains(CAST(doc_id AS VARCHAR), 'token = '))")
def search_text(spark, sf_dir):
    return A.search(table(spark, sf_dir, "documents"), "TOKEN = ", ("text", "source"), "doc_id").select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'token = ') OR contains(lower(source), 'token = ') OR (doc_id <> 0 AND contains(CAST(doc_id AS VARCHAR), 'token = '))")
def search_indexed(spark, sf_dir):
    """The same search through an index of trigrams."""
    docs, path = table(spark, sf_dir, "documents"), work_path(spark, "grams")
    S.build(docs, path, "doc_id", ("text", "source"), "doc_id")
    return S.search_indexed(docs, path, "TOKEN = ", "doc_id", ("text", "source"), "doc_id").select("doc_id")


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('de', 'fr') AND source IN ('src1', 'src2', 'src3')")
def facet_filter(spark, sf_dir):
    return A.facets(table(spark, sf_dir, "documents"), lang=("de", "fr"), source=("src1", "src2", "src3")).select("doc_id", "lang", "source")


@query("""SELECT doc_id, lang, count(*) OVER () AS shown, (SELECT count(*) FROM documents) AS total FROM documents WHERE contains(lower(text), 'token') AND lang IN ('en', 'de')""")
def search_and_facets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    hits = A.facets(A.search(docs, "Token", ("text",), None), lang=("en", "de")).select("doc_id", "lang")
    return A.result_counts(hits, docs)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def point_lookup(spark, sf_dir):
    return A.by_id(table(spark, sf_dir, "orders"), 7, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT source AS file, min(doc_id) AS doc_id FROM documents WHERE source = 'src5' GROUP BY source")
def file_lookup(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("path"))
    names = files.where("file = 'src5'").select("file").distinct()
    return R.first_named(files, names).select("file", F.col("path").cast("long").alias("doc_id"))


@query(f"SELECT o_orderkey, severity, CAST(rk AS INTEGER) AS rank FROM (SELECT o_orderkey, severity, {RANK_SQL.format('severity')} AS rk FROM (SELECT *, {ORDER_SEVERITY} AS severity FROM orders)) ORDER BY rk DESC, o_orderkey LIMIT 5")
def top5_priority(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", order_severity().alias("severity"))
    return A.top_priority(orders, 5, key="o_orderkey").withColumn("rank", X.severity_rank(F.col("severity")))


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS date FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def history_top50(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), X.iso(F.col("o_orderdate")).alias("date"))
    return newest(runs)


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 501")
def ring_tail(spark, sf_dir):
    return A.tail(table(spark, sf_dir, "events"), "event_id").select("event_id", "event_type")


@query("""WITH t AS (SELECT max(event_id) + 1 AS n FROM events) SELECT event_id, CAST(floor((event_id + 1) * 100 / n) AS BIGINT) AS pct,
 CAST(floor(CAST(120.0 AS DOUBLE) / (event_id + 1) * (n - event_id - 1)) AS BIGINT) AS eta FROM events, t""")
def progress_eta(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id")
    total = events.agg(F.max("event_id") + 1).scalar()
    done = F.col("event_id") + 1
    return events.select("event_id", A.progress(done, total).alias("pct"), A.eta_seconds(F.lit(120.0), done, total).alias("eta"))


@query("""SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 240 WHEN 'BUILDING' THEN 150 ELSE 180 END AS timeout,
 CASE c_mktsegment WHEN 'MACHINERY' THEN 'high' WHEN 'BUILDING' THEN 'low' ELSE 'medium' END AS latency FROM customer""")
def dim_lookup_default(spark, sf_dir):
    names = {"deepseek-coder:6.7b": "MACHINERY", "qwen2.5-coder:14b": "_default", "qwen2.5-coder:32b": "BUILDING"}
    rows = [(names[k], m.timeout, m.latency) for k, m in MODELS.items()]
    models = spark.createDataFrame(rows, "c_mktsegment string, timeout int, latency string")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return A.with_default(customers, F.broadcast(models), "c_mktsegment", "_default").drop("c_mktsegment")


@query(f"""SELECT o_orderkey, CASE s WHEN 'Critical' THEN '2-4h' WHEN 'High' THEN '1-2h' WHEN 'Medium' THEN '30min-1h' ELSE '15-30min' END AS fix_time,
 CASE s WHEN 'Critical' THEN CASE o_orderstatus WHEN 'F' THEN 'production compromise' WHEN 'O' THEN 'data breach' ELSE 'high risk' END WHEN 'High' THEN 'compromised' WHEN 'Medium' THEN 'moderate' ELSE 'improvement' END AS impact,
 CASE s WHEN 'Critical' THEN 'red' WHEN 'High' THEN 'orange' ELSE 'blue' END AS colour FROM (SELECT *, {ORDER_SEVERITY} AS s FROM orders)""")
def enrich_impact(spark, sf_dir):
    status = F.col("o_orderstatus")
    kind = F.when(status == "F", "Remote RCE").when(status == "O", "SQL injection").otherwise("Other")
    sev = F.col("severity")
    return table(spark, sf_dir, "orders").withColumn("severity", order_severity()).select(
        "o_orderkey", X.fix_time(sev).alias("fix_time"), X.impact(sev, kind).alias("impact"), X.report_colour(sev).alias("colour")
    )


@query("SELECT 'documents' AS origin, doc_id AS id, lang FROM documents UNION ALL SELECT 'pages', page_id, NULL FROM pages")
def bag_union(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "lang")
    pages = table(spark, sf_dir, "pages").select(F.lit("pages").alias("origin"), F.col("page_id").alias("id"))
    return A.union_all(docs, pages)


@query("SELECT o_orderkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders")
def json_export(spark, sf_dir):
    """Rows written as JSON and parsed again."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    back = F.from_json("json", "o_orderkey bigint, o_orderstatus string, cents bigint")
    return R.json_rows(orders).select(back.alias("x")).select("x.*")


@query(f"""SELECT o_orderkey, '<div class="finding" style="border-color:' || CASE s WHEN 'Critical' THEN 'red' WHEN 'High' THEN 'orange' ELSE 'blue' END || '"><h3>&lt;' || o_orderpriority || '&gt;</h3><p>' || s
 || ' <b style="color:' || CASE WHEN o_orderkey % 101 >= 70 THEN 'green' WHEN o_orderkey % 101 >= 40 THEN 'orange' ELSE 'red' END || '">' || (o_orderkey % 101) || '.00</b></p><p>Status: ' || o_orderstatus || '</p></div>' AS html
FROM (SELECT *, {ORDER_SEVERITY} AS s FROM orders)""")
def html_fragment(spark, sf_dir):
    title = F.concat(F.lit("<"), "o_orderpriority", F.lit(">"))
    made = R.html_fragment(title, order_severity(), (F.col("o_orderkey") % 101).cast("double"), Status=F.col("o_orderstatus"), CVE=F.lit(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", made.alias("html"))


@query("SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9_.-]', '_', 'g') AS name FROM pages")
def sanitise_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.safe_name(F.col("url")).alias("name"))


@query("""SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, strftime(ts, '%H:%M:%S') AS clock, strftime(ts, '%d/%m/%Y %H:%M') AS shown,
 coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END, ''), 'N/A') AS kind FROM events""")
def ts_format(spark, sf_dir):
    ts = F.col("ts")
    kind = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        "event_id", X.file_stamp(ts).alias("stamp"), X.clock(ts).alias("clock"),
        X.shown_time(ts).alias("shown"), X.or_else(kind, "N/A").alias("kind"),
    )


@query("SELECT source, string_agg(lang, ', ' ORDER BY lang) AS langs FROM (SELECT DISTINCT source, lang FROM documents) GROUP BY source")
def array_join(spark, sf_dir):
    langs = X.joined(F.array_sort(F.collect_set("lang")))  # a handful of languages
    return table(spark, sf_dir, "documents").groupBy("source").agg(langs.alias("langs"))


@query(r"""WITH d AS (SELECT doc_id, source || '.' || lang AS file, doc_id % 3 + 1 AS n, text LIKE '%' || chr(10) AS ends,
 CASE WHEN text = '' THEN [] ELSE string_split(CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10)) END AS l FROM documents),
 x AS (SELECT *, len(l) AS m, greatest(1, n - 3) AS a, least(len(l), n + 3) AS e, l[n] AS old FROM d),
 y AS (SELECT *, repeat(' ', CASE WHEN trim(old, ' ' || chr(9)) = '' AND (n < m OR ends) THEN length(old) + 1 ELSE length(old) - length(ltrim(old, ' ' || chr(9))) END) || 'fixed line' AS new FROM x),
 b AS (SELECT doc_id, n, l, m, ends, old, new, unnest(range(a, e + 1)) AS i FROM y WHERE n <= m),
 t AS (SELECT doc_id, string_agg(CASE WHEN i = n THEN '-' ELSE ' ' END || l[i] || chr(10) || CASE WHEN i = m AND NOT ends THEN '\ No newline at end of file' || chr(10) ELSE '' END
  || CASE WHEN i = n THEN '+' || new || chr(10) ELSE '' END, '' ORDER BY i) AS body FROM b GROUP BY doc_id)
SELECT doc_id, n <= m AS ok, CASE WHEN n <= m THEN '--- a/' || file || chr(10) || '+++ b/' || file || chr(10) || '@@ -' || r || ' +' || r || ' @@' || chr(10) || body END AS diff,
 CASE WHEN n <= m THEN old END AS before, CASE WHEN n <= m THEN new END AS after, CASE WHEN n > m THEN 'line out of range' END AS error
FROM (SELECT *, CASE WHEN e = a THEN CAST(a AS VARCHAR) ELSE a || ',' || (e - a + 1) END AS r FROM y) LEFT JOIN t USING (doc_id)""")
def patch_diff(spark, sf_dir):
    """A unified diff for one line of each document."""
    made = files_of(spark, sf_dir).withColumn("line", (F.col("doc_id") % 3 + 1).cast("long")).withColumn("fix", F.lit("fixed line"))
    return made.select("doc_id", R.patch("file", "content", "line", "fix").alias("p")).select("doc_id", "p.*")


@query(f"SELECT o_orderkey, {ORDER_SEVERITY} IN ('Critical', 'High') AS alert FROM orders")
def alert_flag(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.alert(order_severity()).alias("alert"))


@query("""WITH n AS (SELECT doc_id % 3 AS k, min_by(text, doc_id) AS first FROM documents GROUP BY 1)
SELECT doc_id, 'src' || k AS file, CASE WHEN doc_id % 2 = 0 THEN text ELSE first END AS content FROM documents JOIN n ON doc_id % 3 = k""")
def patch_lookup(spark, sf_dir):
    """Files found by their path, or, where that is gone, the first with their name."""
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("src"), (F.col("doc_id") % 3).cast("string"))
    path = F.lpad(F.col("doc_id").cast("string"), 20, "0")
    files = docs.select(path.alias("path"), name.alias("file"), F.col("text").alias("content"))
    found = docs.select("doc_id", name.alias("file"), F.when(F.col("doc_id") % 2 == 0, path).otherwise("gone").alias("filepath"))
    return R.with_content(found, files).select("doc_id", "file", "content")


_SECOND = """'{"title": "second", "reasoning": {"pattern": "p"}}'"""


@query(f"""WITH o AS (SELECT o_orderkey AS k, o_custkey, {ORDER_SEVERITY} AS severity, CASE o_orderkey % 3 WHEN 0 THEN 'css' WHEN 1 THEN 'py' ELSE 'md' END AS ext FROM orders WHERE o_orderkey % 4 <> 3),
 f AS (SELECT k, 0 AS response_pos, 'f.' || ext AS file, CASE WHEN k % 5 = 0 THEN 'Vulnérabilité Inconnue' ELSE 'C' || o_custkey END AS title, severity,
  nullif(CAST(CASE WHEN k % 4 = 1 THEN k % 7 || '9' ELSE CAST(k % 7 AS VARCHAR) END AS BIGINT), 0) AS line,
  CASE k % 3 WHEN 0 THEN 'this SEEMS wrong' WHEN 1 THEN 'Pas de description fournie.' ELSE 'plain' END AS description,
  CASE WHEN k % 6 = 0 THEN '' ELSE 'f' END AS fix, CASE WHEN k % 2 = 1 THEN 'XSS' ELSE 'Unknown' END AS type, 'Non spécifié' AS pattern, severity AS mitigation_priority,
  100.0 - CASE WHEN k % 3 = 0 THEN 15.0 ELSE 0.0 END AS base,
  (CAST(k % 5 <> 0 AS INTEGER) + 1 + CAST(k % 4 = 1 OR k % 7 <> 0 AS INTEGER) + CAST(k % 3 <> 1 AS INTEGER) + CAST(k % 6 <> 0 AS INTEGER)) / CAST(5 AS DOUBLE) AS complete,
  CASE WHEN k % 4 = 1 OR k % 7 = 0 THEN 10.0 ELSE 0.0 END AS unclear, CASE WHEN k % 2 = 0 THEN CAST(k % 101 AS DOUBLE) END AS number,
  CASE WHEN k % 2 = 1 AND ext <> 'py' THEN 30.0 ELSE 0.0 END AS blocked FROM o
 UNION ALL SELECT k, 1, 'f.' || ext, 'second', 'Low', NULL, 'Pas de description fournie.', 'Pas de correctif proposé.', 'Unknown', 'p', 'Low', 100.0, 0.2, 10.0, NULL, 0.0 FROM o WHERE k % 4 = 2),
 s AS (SELECT *, CAST(base AS DOUBLE) * (0.7 + 0.3 * complete) - unclear AS score FROM f)
SELECT k, CAST(response_pos AS INTEGER) AS response_pos, file, title, severity, line, description, fix, type, pattern, mitigation_priority, false AS degraded,
 CAST(round(greatest(0.0, least(100.0, coalesce((score + number) / 2, score) - blocked)) * 100) AS BIGINT) AS confidence_x100 FROM s""")
def findings_raw(spark, sf_dir):
    """Responses as models write them (an object, a list with other values, a list in prose, no JSON) to typed findings."""
    k = F.col("o_orderkey")

    def quoted(name: str, value) -> F.Column:
        return F.concat(F.lit(f'"{name}": "'), value, F.lit('"'))

    line = F.when(k % 4 == 1, quoted("line", F.concat(F.lit("L"), (k % 7).cast("string"), F.lit("-9")))).otherwise(F.concat(F.lit('"line": '), (k % 7).cast("string")))
    description = F.when(k % 3 == 0, '"description": "this SEEMS wrong"').when(k % 3 == 2, '"description": "plain"')
    parts = [
        F.when(k % 5 != 0, quoted("title", F.concat(F.lit("C"), "o_custkey"))), quoted("severity", F.replace("o_orderpriority", F.lit("URGENT"), F.lit("CRITICAL"))), line, description,
        F.when(k % 6 == 0, '"fix": ""').otherwise('"fix": "f"'), F.when(k % 2 == 1, '"type": "XSS"').otherwise(F.concat(F.lit('"confidence": '), (k % 101).cast("string"))),
    ]
    first = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    raw = (
        F.when(k % 4 == 0, first).when(k % 4 == 1, F.concat(F.lit("["), first, F.lit(', "x"]')))
        .when(k % 4 == 2, F.concat(F.lit("Found: ["), first, F.lit(", "), F.expr(_SECOND), F.lit("] so far."))).otherwise("no defect")
    )
    path = F.concat(F.lit("src/f."), F.element_at(F.array(*map(F.lit, ("css", "py", "md"))), (k % 3 + 1).cast("int")))
    found = D.findings(table(spark, sf_dir, "orders").select(k.alias("k"), path.alias("filepath"), raw.alias("raw")))
    return found.select(
        "k", "response_pos", "file", "title", "severity", "line", "description", "fix", "type", F.col("reasoning.pattern").alias("pattern"),
        F.col("reasoning.mitigation_priority").alias("mitigation_priority"), "degraded", F.round(F.col("confidence") * 100).cast("long").alias("confidence_x100"),
    )


def _stub(prompt: str) -> str:
    n = len(prompt)
    return f'[{{"title": "t{n % 7}", "severity": "{("high", "critical", "low")[n % 3]}", "line": {n % 50}, "description": "d", "fix": "f", "confidence": {n % 101}}}]'


_REPLAY_CHUNK_SQL = CHUNK_SQL.replace("500.0", "3500.0").replace("i * 500", "i * 3500").replace("1000)", "4000)")


@query(f"""WITH p AS (SELECT doc_id || '/' || file AS filepath, chunk_idx, length(file) + length(chunk) + 2 AS n FROM ({_REPLAY_CHUNK_SQL})),
 f AS (SELECT filepath, chunk_idx, 't' || n % 7 AS title, CASE n % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Critical' ELSE 'Low' END AS severity, nullif(n % 50, 0) AS line,
 round((CAST(100.0 AS DOUBLE) * (0.7 + 0.3 * CASE WHEN n % 50 = 0 THEN 0.8 ELSE 1.0 END) - CASE WHEN n % 50 = 0 THEN 10.0 ELSE 0.0 END + n % 101) / 2, 2) AS confidence FROM p)
SELECT row_number() OVER (ORDER BY filepath, chunk_idx) AS id, * FROM f WHERE confidence >= 20""")
def infer_replay(spark, sf_dir):
    """Chunks to a stub model to findings to the best of each response, with ids."""
    cut = C.prompts(C.chunks(files_of(spark, sf_dir), 4000), ("", "\n", ""))
    asked = I.infer(cut.select("doc_id", "file", "chunk_idx", "prompt"), I.ReplayBackend(_stub), "qwen2.5-coder:14b", spark.sparkContext.defaultParallelism)
    raw = asked.where("status = 'ok'").select(F.lit("r").alias("run_id"), F.concat("doc_id", F.lit("/"), "file").alias("filepath"), "chunk_idx", "raw")
    found = D.assign_ids(D.select_findings(D.findings(raw), "devsecops"))
    return found.select("id", "filepath", "chunk_idx", "title", "severity", "line", "confidence")


def _audit(prompt: str) -> str:
    """A stub model: what it finds follows from how often the chunk has an e."""
    chunk = prompt[prompt.index("\n---\n") + 5 : prompt.rindex("\n---\n")]
    n = chunk.count("e")
    return f'[{{"title": "t", "severity": "{("critical", "high", "medium", "low")[n % 4]}", "line": {n % 9 + 1}, "description": "d", "fix": "f", "confidence": {n % 101}}}]'


_SCAN_SQL = f"""WITH s AS (SELECT path, file, content FROM ({_SEEN_SQL}) WHERE doc_id % 5 NOT IN (1, 3)),
 c AS (SELECT path, file, content, CAST(i AS INTEGER) AS chunk_idx, substr(content, CAST(i * 11500 + 1 AS BIGINT), 12000) AS chunk
  FROM (SELECT *, unnest(range(CAST(ceil(length(content) / 11500.0) AS BIGINT))) AS i FROM s WHERE regexp_matches(content, '\\S'))),
 e AS (SELECT *, length(chunk) - length(replace(chunk, 'e', '')) AS n FROM c),
 f AS (SELECT path, file, content, chunk_idx, CASE n % 4 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' END AS severity, CAST(n % 9 + 1 AS BIGINT) AS line, (100.0 + n % 101) / 2 AS confidence FROM e WHERE n % 4 < 2),
 o AS (SELECT *, row_number() OVER (ORDER BY path, chunk_idx) AS id, string_split(CASE WHEN content LIKE '%' || chr(10) THEN left(content, length(content) - 1) ELSE content END, chr(10)) AS l FROM f),
 x AS (SELECT id, line, l, unnest(range(greatest(1, line - 5), least(len(l), line + 5) + 1)) AS i FROM o),
 w AS (SELECT id, string_agg(CASE WHEN i = line THEN '>> ' ELSE '   ' END || i || ': ' || l[i], chr(10) ORDER BY i) AS snippet FROM x GROUP BY id)"""


@query(f"""{_SCAN_SQL} SELECT id, path, chunk_idx, severity, line, CAST(confidence AS DOUBLE) AS confidence, coalesce(nullif(snippet, ''), 'Code non disponible') AS snippet FROM o LEFT JOIN w USING (id)""")
def scan_findings(spark, sf_dir):
    """A whole scan over a tree of files: calls, findings, the best of each, ids, and the lines around them."""
    folder = documents_tree(spark, sf_dir)
    run = run_scan(spark, folder, I.ReplayBackend(_audit), urlparse(work_path(spark, "scan")).path, mode="rapid", max_calls=spark.sparkContext.defaultParallelism)
    return run.findings.select("id", F.substring(F.col("filepath"), F.lit(len(folder) + 2), F.length("filepath")).alias("path"), "chunk_idx", "severity", "line", "confidence", "snippet")


@query(f"""{_SCAN_SQL} SELECT (SELECT count(*) FROM s) AS files, count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'High') AS high, CAST(0 AS BIGINT) AS medium, CAST(0 AS BIGINT) AS low,
 CAST((200 * CAST(sum(confidence * 2) AS BIGINT) + 2 * count(*)) // (4 * count(*)) AS DOUBLE) / 100 AS confidence_score,
 CAST(100 - 20 * count(*) FILTER (severity = 'Critical') - 10 * count(*) FILTER (severity = 'High') AS BIGINT) AS score,
 (SELECT count(*) FROM c) AS successful_analyses, CAST(0 AS BIGINT) AS failed_analyses, (SELECT count(*) FROM s) AS done_files, (SELECT count(*) FROM c) AS done_calls, CAST(100 AS BIGINT) AS progress FROM f""")
def scan_summary(spark, sf_dir):
    """The summary of a whole scan, and how far its calls are by what the store holds."""
    store = urlparse(work_path(spark, "scan")).path
    run = run_scan(spark, documents_tree(spark, sf_dir), I.ReplayBackend(_audit), store, mode="rapid", max_calls=spark.sparkContext.defaultParallelism)
    status = run_status(spark, store, run.run_id)
    row = run.summary.select("stats.*", "confidence_score", "score", "successful_analyses", "failed_analyses")
    return row.withColumns({c: F.lit(status[c]).cast("long") for c in ("done_files", "done_calls", "progress")})


@query(f"SELECT {_COUNTS_SQL}, {_SCORE_SQL} FROM (SELECT {SEVERITY_SQL.format('event_type')} AS s FROM events)")
def stream_rollup(spark, sf_dir):
    """Running counts over a stream that takes what is there and ends."""
    import uuid

    from findmill.streaming.incremental import running_counts

    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    name = f"stream_rollup_{uuid.uuid4().hex}"
    running = running_counts(events, "event_type").writeStream.format("memory").queryName(name).outputMode("complete")
    running.trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)
