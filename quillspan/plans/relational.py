"""Scans, filters and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import filters
from ..sources import tables as S
from .kit import Plans

P = Plans()
CH, QU, ME, CA = S.CHUNKS, S.QUEUES, S.MEMORIES, S.CASES


@P.query("scan_chunks", f"SELECT c.chunk_id, c.chunk_index, c.city, c.country, c.province, c.place_type, c.latitude, c.longitude, c.n_chars, p.url AS source_location FROM {CH} c LEFT JOIN pages p ON p.page_id = c.document_id")
def scan_chunks(spark: SparkSession, d: str) -> DataFrame:
    pages = S.read(spark, d, "pages").select(F.col("page_id").alias("document_id"), F.col("url").alias("source_location"))
    own = ["chunk_id", "chunk_index", "city", "country", "province", "place_type", "latitude", "longitude", "n_chars"]
    return S.chunks(spark, d).select("document_id", *own).join(pages, "document_id", "left").select(*own, "source_location")


@P.query("join_chunk_document", f"SELECT p.page_id, count(c.chunk_id) AS n_chunks, sum(c.n_chars) AS n_chars FROM {CH} c LEFT JOIN pages p ON p.page_id = c.document_id GROUP BY p.page_id")
def join_chunk_document(spark: SparkSession, d: str) -> DataFrame:
    pages = S.read(spark, d, "pages").select("page_id")
    chunks = S.chunks(spark, d).select("chunk_id", "document_id", "n_chars")
    return chunks.join(pages, F.col("page_id") == F.col("document_id"), "left").groupBy("page_id").agg(F.count("chunk_id").alias("n_chunks"), F.sum("n_chars").alias("n_chars"))


@P.query("scan_queue", f"SELECT url_id, url, status FROM {QU} WHERE status <> 'completed'")
def scan_queue(spark: SparkSession, d: str) -> DataFrame:
    return S.queue(spark, d).filter("status <> 'completed'").select("url_id", "url", "status")


@P.query("queue_dequeue", f"SELECT url_id, url, 'processing' AS status FROM {QU} WHERE status = 'pending' ORDER BY added, url_id LIMIT 1")
def queue_dequeue(spark: SparkSession, d: str) -> DataFrame:
    return S.queue(spark, d).filter("status = 'pending'").orderBy("added", "url_id").limit(1).select("url_id", "url", F.lit("processing").alias("status"))


@P.query("queue_upsert", f"SELECT c.c_name AS url FROM customer c WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = c.c_custkey)")
def queue_upsert(spark: SparkSession, d: str) -> DataFrame:
    known = S.read(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"))
    return S.read(spark, d, "customer").join(known, "c_custkey", "left_anti").select(F.col("c_name").alias("url"))


@P.query(
    "queue_status_update",
    f"SELECT url_id, CASE WHEN status IN ('pending', 'processing') AND h.n IS NULL THEN 'failed' WHEN status IN ('pending', 'processing') THEN 'completed' ELSE status END AS status, "
    f"CASE WHEN status IN ('pending', 'processing') AND h.n IS NULL THEN 'no document' END AS error_message FROM {QU} q LEFT JOIN (SELECT document_id, count(*) AS n FROM {CH} GROUP BY document_id) h ON h.document_id = q.url_id",
)
def queue_status_update(spark: SparkSession, d: str) -> DataFrame:
    done = S.chunks(spark, d).groupBy(F.col("document_id").alias("url_id")).agg(F.count(F.lit(1)).alias("n"))
    open_ = F.col("status").isin("pending", "processing")
    q = S.queue(spark, d).select("url_id", "status").join(done, "url_id", "left")
    status = F.when(open_ & F.col("n").isNull(), "failed").when(open_, "completed").otherwise(F.col("status"))
    return q.select("url_id", status.alias("status"), F.when(open_ & F.col("n").isNull(), "no document").alias("error_message"))


@P.query("save_urls_dedup", "SELECT min(page_id) AS page_id, lower(regexp_replace(url, '[?#].*$', '')) AS url FROM pages WHERE page_id % 3 <> 0 AND lower(regexp_replace(url, '[?#].*$', '')) NOT IN (SELECT lower(regexp_replace(url, '[?#].*$', '')) FROM pages WHERE page_id % 3 = 0) GROUP BY 2")
def save_urls_dedup(spark: SparkSession, d: str) -> DataFrame:
    key = F.lower(F.regexp_replace("url", r"[?#].*$", ""))
    pages = S.read(spark, d, "pages").select("page_id", key.alias("url"))
    return pages.filter("page_id % 3 <> 0").join(pages.filter("page_id % 3 = 0").select("url"), "url", "left_anti").groupBy("url").agg(F.min("page_id").alias("page_id"))


@P.query("checkpointed_json", f"SELECT case_id, intent FROM {CA} WHERE case_id NOT IN (SELECT doc_id FROM labels)")
def checkpointed_json(spark: SparkSession, d: str) -> DataFrame:
    """Cases that a resumed run still has to do."""
    done = S.read(spark, d, "labels").select(F.col("doc_id").alias("case_id"))
    return S.cases(spark, d).select("case_id", "intent").join(done, "case_id", "left_anti")


@P.query("filter_metadata", f"SELECT chunk_id FROM {CH} WHERE lower(country) = 'en' AND lower(city) IN ('src1', 'src2', 'src7') AND place_type IN ('museum', 'beach')")
def filter_metadata(spark: SparkSession, d: str) -> DataFrame:
    return S.chunks(spark, d).filter(filters.metadata("EN", ["SRC1", "src2", "Src7"], None, ["museum", "beach"])).select("chunk_id")


@P.query("filter_metadata_ilike", f"SELECT chunk_id FROM {CH} WHERE country ILIKE 'E_' AND province ILIKE 'east_A'")
def filter_metadata_ilike(spark: SparkSession, d: str) -> DataFrame:
    return S.chunks(spark, d).filter(filters.metadata_like("E_", province="east_A")).select("chunk_id")


_INTENT = "CASE doc_id % 4 WHEN 0 THEN 'food_search' WHEN 1 THEN 'event_search' WHEN 2 THEN 'comparison' ELSE 'travel_information' END"


@P.query("build_filters", f"SELECT doc_id, CASE WHEN {_INTENT} IN ('food_search', 'event_search') THEN lang || ',' || source ELSE '' END AS hard FROM documents")
def build_filters(spark: SparkSession, d: str) -> DataFrame:
    q = S.read(spark, d, "documents").selectExpr("doc_id", f"{_INTENT} AS intent", "array(lang, source) AS place_types")
    return q.select("doc_id", F.array_join(filters.hard_place_types(F.col("intent"), F.col("place_types")), ",").alias("hard"))


_RQ = "SELECT n_nationkey AS query_id, 'src' || CAST(n_nationkey AS VARCHAR) AS q_city, CASE WHEN n_nationkey % 2 = 0 THEN 'North' ELSE 'Nowhere' END AS q_province FROM nation"


@P.query(
    "filter_relaxation",
    f"""WITH q AS ({_RQ}), f AS (SELECT query_id, chunk_id, coalesce(province = q_province, false) AS s FROM q JOIN {CH} c ON c.city = q.q_city)
SELECT query_id, chunk_id, NOT bool_or(s) OVER (PARTITION BY query_id) AS relaxed FROM f QUALIFY s OR NOT bool_or(s) OVER (PARTITION BY query_id)""",
)
def filter_relaxation(spark: SparkSession, d: str) -> DataFrame:
    q = S.read(spark, d, "nation").selectExpr("n_nationkey AS query_id", "concat('src', n_nationkey) AS q_city", "CASE WHEN n_nationkey % 2 = 0 THEN 'North' ELSE 'Nowhere' END AS q_province")
    rows = S.chunks(spark, d).select("chunk_id", "city", "province")
    out = filters.relaxed(q, rows, F.coalesce(F.col("province") == F.col("q_province"), F.lit(False)), F.col("city") == F.col("q_city"))
    return out.select("query_id", "chunk_id", "relaxed")


@P.query("task_scope_filter", f"WITH q AS ({_RQ}) SELECT query_id, count(chunk_id) AS n FROM q JOIN {CH} c ON lower(c.city) = lower(q.q_city) GROUP BY query_id")
def task_scope_filter(spark: SparkSession, d: str) -> DataFrame:
    """A task with cities searches those alone; its query's province is dropped."""
    q = S.read(spark, d, "nation").selectExpr("n_nationkey AS query_id", "lower(concat('src', n_nationkey)) AS c")
    return q.join(S.chunks(spark, d).select("chunk_id", F.lower("city").alias("c")), "c").groupBy("query_id").agg(F.count("chunk_id").alias("n"))


@P.query("known_cities", f"SELECT DISTINCT city FROM {CH} WHERE city IS NOT NULL AND city <> '' ORDER BY city")
def known_cities(spark: SparkSession, d: str) -> DataFrame:
    return S.chunks(spark, d).filter("city IS NOT NULL AND city <> ''").select("city").distinct().orderBy("city")


@P.query("min_words", "SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+')) AS n_words FROM documents WHERE len(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+')) > 18")
def min_words(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(T.tokens(F.col("text")))
    return S.read(spark, d, "documents").select("doc_id", n.cast("long").alias("n_words")).filter("n_words > 18")


_LETTERS = "CASE WHEN length(text) = 0 THEN 0.0 ELSE length(regexp_replace(text, '[^\\p{L}]', '', 'g')) / length(text) END"


@P.query("bad_chunk", f"SELECT doc_id FROM documents WHERE length(text) < 120 OR {_LETTERS} < 0.35 OR len(regexp_extract_all(text, 'https?://')) >= 3")
def bad_chunk(spark: SparkSession, d: str) -> DataFrame:
    return S.read(spark, d, "documents").filter(filters.bad_chunk(F.col("text"))).select("doc_id")


@P.query("noise_chunk", f"""SELECT doc_id FROM documents WHERE {_LETTERS} < 0.25
OR regexp_replace(regexp_replace(regexp_replace(text, '!?\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), 'https?://\\S+', '', 'g'), '[#*_`>|\\-\\s]', '', 'g') = ''
OR len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_matches(x, '^\\s*#{{1,6}}\\s'))) = 0""")
def noise_chunk(spark: SparkSession, d: str) -> DataFrame:
    return S.read(spark, d, "documents").filter(filters.noise_chunk(F.col("text"))).select("doc_id")


_LINES = "text || chr(10) || CASE doc_id % 8 WHEN 0 THEN 'Page 3 of 12' WHEN 1 THEN 'All rights reserved, 2020' WHEN 2 THEN '*** == ***' WHEN 3 THEN '12 / 80' WHEN 4 THEN '1. Copyright law' WHEN 5 THEN 'E-mail: x' WHEN 6 THEN 'Fax: ' ELSE 'Contents' END"


@P.query("useless_line", f"""WITH l AS (SELECT doc_id, unnest(string_split({_LINES}, chr(10))) AS line FROM documents), t AS (SELECT doc_id, trim(line) AS t FROM l)
SELECT doc_id, count(*) AS n_useless FROM t WHERE t <> '' AND NOT regexp_matches(t, '^(#|- |[0-9]+\\.)') AND (regexp_matches(lower(t), '{filters.PAGE_LINES}') OR regexp_matches(lower(t), '{filters.FURNITURE_LINES}')
OR (length(t) <= 40 AND length(regexp_replace(t, '[\\pL\\pN\\s]', '', 'g')) > 0.5 * length(t))) GROUP BY doc_id""")
def useless_line(spark: SparkSession, d: str) -> DataFrame:
    lines = S.read(spark, d, "documents").select("doc_id", F.explode(F.split(F.expr(_LINES), "\n", -1)).alias("line"))
    return lines.filter(filters.useless_line(F.col("line"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_useless"))


@P.query("url_keep", """SELECT page_id FROM (SELECT page_id, regexp_extract(lower(regexp_replace(url, '[?#].*$', '')), '^[a-z][a-z0-9+.-]*://[^/]*(.*)$', 1) AS path, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host FROM pages)
WHERE suffix(host, 'example.com') AND starts_with(path, '/') AND NOT regexp_matches(path, '\\.(jpg|jpeg|png|gif|pdf|zip|css|js)$') AND NOT regexp_matches(path, '/(login|cart|tag)(/|$)')""")
def url_keep(spark: SparkSession, d: str) -> DataFrame:
    return S.read(spark, d, "pages").filter(filters.kept_url(F.col("url"), "example.com")).select("page_id")


_DETAIL = "CASE page_id % 4 WHEN 0 THEN url || '?pid=' || page_id WHEN 1 THEN url || '?lang=en&pid=7#x' WHEN 2 THEN url || '?upid=3' ELSE 'https://other.org/?pid=1' END"


@P.query("detail_url", f"SELECT page_id, regexp_extract(u, '[?&]pid=([^&#]*)', 1) AS detail FROM (SELECT page_id, {_DETAIL} AS u FROM pages) WHERE regexp_matches(u, '[?&]pid=[^&#]') AND regexp_matches(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '(^|\\.)example\\.com$')")
def detail_url(spark: SparkSession, d: str) -> DataFrame:
    """Pages of one record: of the host, with its number in the query."""
    u = S.read(spark, d, "pages").select("page_id", F.expr(_DETAIL).alias("u"))
    return u.filter(filters.detail_url(F.col("u"), "example.com", "pid")).select("page_id", F.regexp_extract("u", "[?&]pid=([^&#]*)", 1).alias("detail"))


_TOLD = "list_filter(regexp_split_to_array(lower(text), '[^\\pL]+'), lambda w: w <> '')"
_COUNTS = {k: f"len(list_filter(w, lambda x: list_contains([{', '.join(repr(x) for x in v)}], x)))" for k, v in filters.COMMON_WORDS.items()}


@P.query("english_page", f"WITH t AS (SELECT doc_id, length(text) AS n, {_TOLD} AS w FROM documents) SELECT doc_id FROM t WHERE n >= 200 AND {_COUNTS['en']} > 0 AND " + " AND ".join(f"{_COUNTS['en']} > {v}" for k, v in _COUNTS.items() if k != "en"))
def english_page(spark: SparkSession, d: str) -> DataFrame:
    """Pages long enough to tell, whose common words are English ones more than of another language."""
    return S.read(spark, d, "documents").filter((F.char_length("text") >= 200) & (filters.language(F.col("text")) == "en")).select("doc_id")


_VISIBLE = "trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))"


@P.query("content_page", f"SELECT page_id, length({_VISIBLE}) AS n_visible FROM pages WHERE length({_VISIBLE}) >= 500")
def content_page(spark: SparkSession, d: str) -> DataFrame:
    return S.read(spark, d, "pages").select("page_id", F.char_length(T.visible_text(F.col("html"))).cast("long").alias("n_visible")).filter("n_visible >= 500")


@P.query("active_memories", f"SELECT user_id, memory_id, rn AS position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY importance DESC, seq DESC) AS rn FROM {ME} WHERE is_active) WHERE rn <= 5")
def active_memories(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("importance"), F.desc("seq"))
    return S.memories(spark, d).filter("is_active").withColumn("position", F.row_number().over(w)).filter("position <= 5").select("user_id", "memory_id", "position")


@P.query("vocab_whitelist", "SELECT doc_id, array_to_string(list_filter(string_split(lang || ',' || source || ',en', ','), lambda x: x IN ('en', 'de', 'src1', 'src3')), ',') AS kept FROM documents")
def vocab_whitelist(spark: SparkSession, d: str) -> DataFrame:
    values = F.split(F.concat_ws(",", "lang", "source", F.lit("en")), ",")
    return S.read(spark, d, "documents").select("doc_id", F.array_join(filters.whitelisted(values, ["en", "de", "src1", "src3"]), ",").alias("kept"))


@P.query("safe_url", "SELECT page_id, CASE WHEN regexp_matches(url, '^[hH][tT][tT][pP][sS]?://[^/?#\\s]+') THEN url END AS url, CASE WHEN regexp_matches(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '\\.gov(\\.|$)') THEN 'official_government' WHEN regexp_matches(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '\\.edu(\\.|$)') THEN 'academic' ELSE 'open_web' END AS source_type FROM pages")
def safe_url(spark: SparkSession, d: str) -> DataFrame:
    return S.read(spark, d, "pages").select("page_id", T.safe_url(F.col("url")).alias("url"), T.source_kind(F.col("url")).alias("source_type"))


@P.query("gap_list", "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus = 'O') WHERE rn <= 3")
def gap_list(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return S.read(spark, d, "orders").filter("o_orderstatus = 'O'").withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("o_orderkey", "o_custkey")


@P.query("queue_filter", f"SELECT status, count(*) AS n FROM {QU} WHERE status IN ('completed', 'failed') GROUP BY status")
def queue_filter(spark: SparkSession, d: str) -> DataFrame:
    return S.queue(spark, d).filter(F.col("status").isin("completed", "failed")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@P.query("semi_memory", f"SELECT memory_id FROM {ME} m WHERE EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = m.memory_id) OR EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = m.user_id)")
def semi_memory(spark: SparkSession, d: str) -> DataFrame:
    """An either-or semi-join as two equality joins whose marks are combined: no nested loop."""
    m = S.memories(spark, d).select("memory_id", "user_id")
    keys = S.read(spark, d, "part").select(F.col("p_partkey").alias("memory_id"), F.lit(True).alias("by_key"))
    values = S.read(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id"), F.lit(True).alias("by_value"))
    return m.join(keys, "memory_id", "left").join(values, "user_id", "left").filter("by_key OR by_value").select("memory_id")


@P.query("anti_existing", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 40)")
def anti_existing(spark: SparkSession, d: str) -> DataFrame:
    used = S.read(spark, d, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return S.read(spark, d, "part").select("p_partkey").join(used, "p_partkey", "left_anti")


@P.query("duplicate_document", "SELECT doc_id, bool_or(same_text) AS same_text, bool_or(same_place) AS same_place FROM (SELECT b.doc_id, true AS same_text, false AS same_place FROM documents b JOIN (SELECT text, lang, min(doc_id) AS f FROM documents GROUP BY ALL) a ON a.text = b.text AND a.lang = b.lang AND a.f < b.doc_id UNION ALL SELECT b.doc_id, false, true FROM documents b JOIN (SELECT source, n_chars, lang, min(doc_id) AS f FROM documents GROUP BY ALL) a ON a.source = b.source AND a.n_chars = b.n_chars AND a.lang = b.lang AND a.f < b.doc_id) GROUP BY doc_id")
def duplicate_document(spark: SparkSession, d: str) -> DataFrame:
    """Documents that an earlier one of their language equals in text, or in place (source and size)."""
    docs = S.read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("hash"))
    marks = None
    for keys, flags in ((["hash", "lang"], (True, False)), (["source", "n_chars", "lang"], (False, True))):
        first = docs.groupBy(*keys).agg(F.min("doc_id").alias("first"))
        hit = docs.join(first, keys).filter("first < doc_id").select("doc_id", F.lit(flags[0]).alias("t"), F.lit(flags[1]).alias("p"))
        marks = hit if marks is None else marks.unionByName(hit)
    return marks.groupBy("doc_id").agg(F.max("t").alias("same_text"), F.max("p").alias("same_place"))


@P.query("metadata_by_index", "SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic, l.doc_id IS NULL AS is_fallback FROM documents d LEFT JOIN labels l USING (doc_id)")
def metadata_by_index(spark: SparkSession, d: str) -> DataFrame:
    labels = S.read(spark, d, "labels").withColumn("known", F.lit(True))
    out = S.read(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left")
    return out.select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"), F.col("known").isNull().alias("is_fallback"))


@P.query("requirement_join", "WITH a AS (SELECT lower(trim(c_mktsegment)) AS k, max(c_custkey) AS last FROM customer WHERE c_mktsegment <> 'MACHINERY' GROUP BY 1) SELECT r.c_mktsegment AS requirement, CASE WHEN a.k IS NULL THEN 'not_covered' ELSE 'covered' END AS status, a.last FROM (SELECT DISTINCT c_mktsegment FROM customer) r LEFT JOIN a ON a.k = lower(trim(r.c_mktsegment))")
def requirement_join(spark: SparkSession, d: str) -> DataFrame:
    """Requirements with their last assessment by text without case; those without one are not covered."""
    c = S.read(spark, d, "customer").select("c_mktsegment", "c_custkey")
    told = c.filter("c_mktsegment <> 'MACHINERY'").groupBy(F.lower(F.trim("c_mktsegment")).alias("k")).agg(F.max("c_custkey").alias("last"))
    asked = c.select(F.col("c_mktsegment").alias("requirement")).distinct().withColumn("k", F.lower(F.trim("requirement")))
    return asked.join(told, "k", "left").select("requirement", F.when(F.col("last").isNull(), "not_covered").otherwise("covered").alias("status"), "last")


@P.query("valid_chunk_semi", "SELECT conv_id, count(*) AS n FROM (SELECT DISTINCT conv_id, turn FROM conversations) c WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = c.conv_id * 3 + c.turn) GROUP BY conv_id")
def valid_chunk_semi(spark: SparkSession, d: str) -> DataFrame:
    ids = S.read(spark, d, "documents").select(F.col("doc_id").alias("id"))
    cited = S.read(spark, d, "conversations").select("conv_id", (F.col("conv_id") * 3 + F.col("turn")).alias("id"), "turn").distinct()
    return cited.join(ids, "id", "left_semi").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


@P.query("judgment_join", "SELECT d.source AS case_id, count(*) AS n, sum(coalesce(l.quality * 2 + l.toxic, 0))::BIGINT AS grades FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source")
def judgment_join(spark: SparkSession, d: str) -> DataFrame:
    graded = S.read(spark, d, "documents").select("doc_id", "source").join(S.read(spark, d, "labels"), "doc_id", "left")
    return graded.groupBy(F.col("source").alias("case_id")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col("quality") * 2 + F.col("toxic"), F.lit(0))).alias("grades"))


@P.query("category_exclude", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag IN ('R', 'A'))")
def category_exclude(spark: SparkSession, d: str) -> DataFrame:
    barred = S.read(spark, d, "lineitem").filter(F.col("l_returnflag").isin("R", "A")).select(F.col("l_orderkey").alias("o_orderkey"))
    return S.read(spark, d, "orders").select("o_orderkey").join(barred, "o_orderkey", "left_anti")


@P.query("memory_subset", f"SELECT memory_id, memory_type FROM {ME} WHERE memory_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def memory_subset(spark: SparkSession, d: str) -> DataFrame:
    used = S.read(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("memory_id"))
    return S.memories(spark, d).select("memory_id", "memory_type").join(used, "memory_id", "left_semi")


@P.query("case_cross_config", f"SELECT case_id, unnest(['full', 'no_vector', 'no_bm25', 'no_rerank']) AS configuration FROM {CA}")
def case_cross_config(spark: SparkSession, d: str) -> DataFrame:
    """Each case under each of a fixed list of configurations."""
    return S.cases(spark, d).select("case_id", F.explode(F.array(*[F.lit(x) for x in ("full", "no_vector", "no_bm25", "no_rerank")])).alias("configuration"))
