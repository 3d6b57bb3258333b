"""Aggregates, telemetry and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import evaluation as E
from ..operators import understanding as U
from ..sources import tables as S
from . import understanding as Q
from .kit import Plans
from .retrieval import _BM25, lexical_ranks

P = Plans()
CH, ME, CA, QU = S.CHUNKS, S.MEMORIES, S.CASES, S.QUEUES


@P.query("group_mean", f"SELECT intent, user_id, round(avg(ndcg), 9) AS ndcg, round(avg(precision), 9) AS precision, round(avg(correctness) / 5, 9) AS correctness FROM {CA} GROUP BY intent, user_id")
def group_mean(spark: SparkSession, d: str) -> DataFrame:
    mean = lambda c, by=1.0: F.round(F.avg(c) / by, 9).alias(c)
    return S.cases(spark, d).groupBy("intent", "user_id").agg(mean("ndcg"), mean("precision"), mean("correctness", 5.0))


_TEL = "(SELECT event_id, event_type AS stage, user_id, CASE WHEN event_id % 911 = 0 THEN NULL ELSE value END AS cost, value AS latency, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS tokens FROM events)"


def telemetry(spark: SparkSession, d: str) -> DataFrame:
    return S.read(spark, d, "events").select(
        "event_id", F.col("event_type").alias("stage"), "user_id", F.when(F.col("event_id") % 911 != 0, F.col("value")).alias("cost"), F.col("value").alias("latency"),
        F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("tokens"),
    )


@P.query("telemetry_by_stage", f"SELECT stage, user_id, count(*) AS calls, round(sum(latency), 6) AS latency, sum(tokens)::BIGINT AS tokens, CASE WHEN count(cost) < count(*) THEN NULL ELSE round(sum(cost), 6) END AS cost FROM {_TEL} GROUP BY stage, user_id")
def telemetry_by_stage(spark: SparkSession, d: str) -> DataFrame:
    cost = F.when(F.count("cost") < F.count(F.lit(1)), None).otherwise(F.round(F.sum("cost"), 6))
    return telemetry(spark, d).groupBy("stage", "user_id").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("latency"), 6).alias("latency"), F.sum("tokens").alias("tokens"), cost.alias("cost"))


@P.query("latency_summary", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, n, round(avg(value), 6) AS mean, max(value) FILTER (WHERE i = n // 2) AS median, max(value) FILTER (WHERE i = ceil(0.95 * n) - 1) AS p95, min(value) AS min, max(value) AS max FROM r GROUP BY event_type, n")
def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.latency_summary(S.read(spark, d, "events"), "event_type", "value")


@P.query("token_totals", f"SELECT user_id, sum(tokens)::BIGINT AS total, sum(least(tokens, 3))::BIGINT AS cached, count(DISTINCT stage) AS stages FROM {_TEL} GROUP BY user_id")
def token_totals(spark: SparkSession, d: str) -> DataFrame:
    return telemetry(spark, d).groupBy("user_id").agg(F.sum("tokens").alias("total"), F.sum(F.least("tokens", F.lit(3))).alias("cached"), F.countDistinct("stage").alias("stages"))


@P.query("experiment_cost", f"SELECT user_id, round(coalesce(sum(cost) FILTER (WHERE stage = 'view'), 0) + coalesce(sum(cost) FILTER (WHERE stage = 'click'), 0), 6) AS total, round(sum(cost) / count(*), 6) AS mean_cost FROM {_TEL} GROUP BY user_id")
def experiment_cost(spark: SparkSession, d: str) -> DataFrame:
    of = lambda s: F.coalesce(F.sum(F.when(F.col("stage") == s, F.col("cost"))), F.lit(0.0))
    return telemetry(spark, d).groupBy("user_id").agg(F.round(of("view") + of("click"), 6).alias("total"), F.round(F.sum("cost") / F.count(F.lit(1)), 6).alias("mean_cost"))


@P.query("corpus_stats", "SELECT source, count(*) AS n_chunks, count(DISTINCT lang) AS n_langs, count(l.doc_id) AS n_labelled, max(n_chars) AS longest FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    labels = S.read(spark, d, "labels").select("doc_id", F.lit(1).alias("known"))
    j = S.read(spark, d, "documents").select("doc_id", "source", "lang", "n_chars").join(labels, "doc_id", "left")
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("lang").alias("n_langs"), F.count("known").alias("n_labelled"), F.max("n_chars").alias("longest"))


_SUMS = ", ".join(f"sum(('0x' || substr(h, {15 * i + 1}, 15))::BIGINT)::VARCHAR" for i in range(4))


@P.query("corpus_fingerprint", f"SELECT source, sha256(concat_ws('|', {_SUMS})) AS fingerprint FROM (SELECT source, sha256(concat_ws('|', doc_id::VARCHAR, sha256(text))) AS h FROM documents) GROUP BY source")
def corpus_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return E.corpus_fingerprint(S.read(spark, d, "documents"), "source", "doc_id", F.sha2("text", 256))


@P.query("gap_dashboard", "SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'P') AS pending, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 100000) AS answered, count(DISTINCT lower(o_orderpriority)) AS sources FROM orders GROUP BY o_custkey")
def gap_dashboard(spark: SparkSession, d: str) -> DataFrame:
    o = S.read(spark, d, "orders")
    return o.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"),
        F.count_if((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000)).alias("answered"), F.countDistinct(F.lower("o_orderpriority")).alias("sources"),
    )


@P.query("chunk_stats", f"SELECT p.page_id, count(c.chunk_id) AS n, coalesce(sum(c.n_chars), 0)::BIGINT AS chars, round(coalesce(avg(c.n_chars), 0), 6) AS mean, coalesce(min(c.n_chars), 0) AS least, coalesce(max(c.n_chars), 0) AS most FROM pages p LEFT JOIN {CH} c ON c.document_id = p.page_id GROUP BY p.page_id")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    c = S.chunks(spark, d).select(F.col("document_id").alias("page_id"), "n_chars").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 6).alias("mean"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))
    return S.read(spark, d, "pages").select("page_id").join(c, "page_id", "left").fillna(0)


_STATUS = "CASE l_linenumber % 3 WHEN 0 THEN 'covered' WHEN 1 THEN 'partial' ELSE 'not_covered' END"


@P.query("coverage_aggregate", f"SELECT l_orderkey, covered, partial, missing, n, round((covered + 0.5 * partial) / n, 9) AS ratio, missing = 0 AS sufficient FROM (SELECT l_orderkey, count(*) FILTER (WHERE s = 'covered') AS covered, count(*) FILTER (WHERE s = 'partial') AS partial, count(*) FILTER (WHERE s <> 'covered') AS missing, count(*) AS n FROM (SELECT l_orderkey, {_STATUS} AS s FROM lineitem) GROUP BY l_orderkey)")
def coverage_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return E.coverage(S.read(spark, d, "lineitem").selectExpr("l_orderkey", f"{_STATUS} AS status"), "l_orderkey", "status")


@P.query("answer_readiness", f"SELECT city, places, CASE WHEN missing = 0 AND places >= 3 THEN 'complete' WHEN missing < n THEN 'partial' ELSE 'insufficient' END AS readiness FROM (SELECT city, count(DISTINCT trim(place_type)) AS places, count(*) FILTER (WHERE place_type IS NULL) AS missing, count(*) AS n FROM {CH} GROUP BY city)")
def answer_readiness(spark: SparkSession, d: str) -> DataFrame:
    g = S.chunks(spark, d).groupBy("city").agg(F.countDistinct(F.trim("place_type")).alias("places"), F.count_if(F.col("place_type").isNull()).alias("missing"), F.count(F.lit(1)).alias("n"))
    state = F.when((F.col("missing") == 0) & (F.col("places") >= 3), "complete").when(F.col("missing") < F.col("n"), "partial").otherwise("insufficient")
    return g.select("city", "places", state.alias("readiness"))


@P.query("pearson", f"SELECT user_id, n, CASE WHEN n >= 2 AND sx * sy > 0 THEN round(c / (sx * sy), 6) END AS pearson_r FROM (SELECT user_id, count(*) AS n, covar_pop(ndcg, correctness) AS c, stddev_pop(ndcg) AS sx, stddev_pop(correctness) AS sy FROM {CA} GROUP BY user_id)")
def pearson(spark: SparkSession, d: str) -> DataFrame:
    return E.pearson(S.cases(spark, d), "ndcg", "correctness", ["user_id"]).withColumn("pearson_r", F.round("pearson_r", 6))


_OLD, _NEW = "SELECT source, doc_id FROM documents WHERE doc_id % 3 <> 0", "SELECT source, doc_id FROM documents WHERE doc_id % 2 = 0"


@P.query("recovery_effectiveness", f"SELECT source, count(*) AS new_candidates, count(*) FILTER (WHERE doc_id % 4 = 0) AS newly_selected, count(*) FILTER (WHERE doc_id % 4 = 0) > 0 AS improved FROM ({_NEW}) n WHERE NOT EXISTS (SELECT 1 FROM ({_OLD}) o WHERE o.doc_id = n.doc_id) GROUP BY source")
def recovery_effectiveness(spark: SparkSession, d: str) -> DataFrame:
    x = S.read(spark, d, "documents").select("source", "doc_id")
    new = x.filter("doc_id % 2 = 0").join(x.filter("doc_id % 3 <> 0").select("doc_id"), "doc_id", "left_anti")
    picked = F.count_if(F.col("doc_id") % 4 == 0)
    return new.groupBy("source").agg(F.count(F.lit(1)).alias("new_candidates"), picked.alias("newly_selected"), (picked > 0).alias("improved"))


@P.query("gap_diagnosis", "SELECT source, CASE WHEN probed = 0 THEN 'not_probed' WHEN found = 0 THEN 'likely_corpus_gap' WHEN good = 0 THEN 'selected_evidence_insufficient' WHEN toxic > good THEN 'likely_reranking_failure' ELSE 'likely_corpus_content_gap' END AS likely_cause FROM (SELECT source, count(l.doc_id) AS probed, count(*) FILTER (WHERE lang = 'en') AS found, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source)")
def gap_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    l = S.read(spark, d, "labels").withColumn("known", F.lit(1))  # noqa: E741
    g = S.read(spark, d, "documents").select("doc_id", "source", "lang").join(l, "doc_id", "left").groupBy("source").agg(
        F.count("known").alias("probed"), F.count_if(F.col("lang") == "en").alias("found"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic")
    )
    cause = F.when(F.col("probed") == 0, "not_probed").when(F.col("found") == 0, "likely_corpus_gap").when(F.col("good") == 0, "selected_evidence_insufficient").when(F.col("toxic") > F.col("good"), "likely_reranking_failure").otherwise("likely_corpus_content_gap")
    return g.select("source", cause.alias("likely_cause"))


@P.query("markdown_stats", "SELECT doc_id, length(text) AS chars, len(string_split(text, chr(10))) AS lines, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^#{1,6} '))) AS headings, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, '|'))) AS table_lines, len(regexp_extract_all(text, '\\[[^\\]]*\\]\\([^)]*\\)')) AS links FROM documents")
def markdown_stats(spark: SparkSession, d: str) -> DataFrame:
    lines = F.split("text", "\n", -1)
    return S.read(spark, d, "documents").select(
        "doc_id", F.char_length("text").cast("long").alias("chars"), F.size(lines).cast("long").alias("lines"), F.size(F.filter(lines, lambda x: x.rlike(r"^#{1,6} "))).cast("long").alias("headings"),
        F.size(F.filter(lines, lambda x: F.contains(x, F.lit("|")))).cast("long").alias("table_lines"), F.regexp_count("text", F.lit(r"\[[^\]]*\]\([^)]*\)")).cast("long").alias("links"),
    )


@P.query("response_mode_counts", "SELECT role, count(*) AS n, count(*) FILTER (WHERE length(text) > 100) AS long_turns, round(avg(length(text)) FILTER (WHERE turn > 0), 6) AS mean_chars FROM conversations GROUP BY role")
def response_mode_counts(spark: SparkSession, d: str) -> DataFrame:
    n = F.char_length("text")
    return S.read(spark, d, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(n > 100).alias("long_turns"), F.round(F.avg(F.when(F.col("turn") > 0, n)), 6).alias("mean_chars"))


@P.query("component_contribution", f"WITH m AS (SELECT user_id, intent, avg(ndcg) AS v FROM {CA} GROUP BY ALL) SELECT a.user_id, a.intent, round(f.v - a.v, 9) AS contribution FROM m a JOIN m f ON f.user_id = a.user_id AND f.intent = 'en' WHERE a.intent <> 'en'")
def component_contribution(spark: SparkSession, d: str) -> DataFrame:
    m = S.cases(spark, d).groupBy("user_id", "intent").agg(F.avg("ndcg").alias("v"))
    full = F.max(F.when(F.col("intent") == "en", F.col("v"))).over(Window.partitionBy("user_id"))
    return m.withColumn("full", full).filter("intent <> 'en' AND full IS NOT NULL").select("user_id", "intent", F.round(F.col("full") - F.col("v"), 9).alias("contribution"))


@P.query("repeat_line_count", "SELECT doc_id, k AS line_hash, count(*) AS n FROM (SELECT doc_id, md5(trim(unnest(string_split(text, chr(10))))) AS k FROM documents) GROUP BY ALL HAVING count(*) >= 2")
def repeat_line_count(spark: SparkSession, d: str) -> DataFrame:
    lines = S.read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.groupBy("doc_id", F.md5(F.trim("line")).alias("line_hash")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")


@P.query("url_destinations", "SELECT url, string_agg(DISTINCT status, ',' ORDER BY status) AS destinations FROM (SELECT lower(regexp_replace(url, '[?#].*$', '')) AS url, status FROM " + QU + ") GROUP BY url")
def url_destinations(spark: SparkSession, d: str) -> DataFrame:
    return S.queue(spark, d).groupBy(F.lower(F.regexp_replace("url", r"[?#].*$", "")).alias("url")).agg(F.array_join(F.sort_array(F.collect_set("status")), ",").alias("destinations"))


@P.query("geo_group", f"WITH k AS (SELECT city, place_type, min(chunk_id) FILTER (WHERE latitude IS NOT NULL) AS f FROM {CH} GROUP BY ALL) SELECT c.chunk_id, coalesce(c.latitude, s.latitude) AS latitude FROM {CH} c JOIN k ON k.city = c.city AND k.place_type IS NOT DISTINCT FROM c.place_type LEFT JOIN {CH} s ON s.chunk_id = k.f")
def geo_group(spark: SparkSession, d: str) -> DataFrame:
    """Missing coordinates from the first known ones of the same place and city: one row for each place is joined back."""
    c = S.chunks(spark, d).select("chunk_id", "city", "place_type", "latitude")
    first = c.filter("latitude IS NOT NULL").groupBy("city", "place_type").agg(F.min(F.struct("chunk_id", "latitude")).alias("s"))
    known = first.select(F.col("city").alias("k"), F.col("place_type").alias("t"), F.col("s.latitude").alias("known"))
    j = c.join(known, (F.col("city") == F.col("k")) & F.col("place_type").eqNullSafe(F.col("t")), "left")
    return j.select("chunk_id", F.coalesce("latitude", "known").alias("latitude"))


@P.query("metric_means", f"SELECT metric, round(avg(v), 9) AS mean, count(v) AS n FROM (SELECT unnest(['ndcg', 'precision', 'coverage']) AS metric, unnest([ndcg, precision, CASE WHEN missing > 0 THEN coverage END]) AS v FROM {CA}) GROUP BY metric")
def metric_means(spark: SparkSession, d: str) -> DataFrame:
    c = S.cases(spark, d).select("ndcg", "precision", F.when(F.col("missing") > 0, F.col("coverage")).alias("coverage"))
    long = c.unpivot([], ["ndcg", "precision", "coverage"], "metric", "v")
    return long.groupBy("metric").agg(F.round(F.avg("v"), 9).alias("mean"), F.count("v").alias("n"))


@P.query("source_summary_top10", "SELECT lower(c_mktsegment) || ':' || c_nationkey AS key, count(*) AS records, count(*) FILTER (WHERE c_acctbal > 5000) AS citations FROM customer GROUP BY 1 ORDER BY citations DESC, records DESC, key LIMIT 10")
def source_summary_top10(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws(":", F.lower("c_mktsegment"), "c_nationkey")
    g = S.read(spark, d, "customer").groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("c_acctbal") > 5000).alias("citations"))
    return g.orderBy(F.desc("citations"), F.desc("records"), "key").limit(10)


_JUDGED = "j AS (SELECT q.doc_id AS query_id, l.doc_id AS id, l.quality * 2 + l.toxic AS grade FROM labels l JOIN documents q ON q.doc_id = l.doc_id * 7 % (SELECT max(doc_id) // 50 + 1 FROM documents) * 50)"


def judged(spark: SparkSession, d: str) -> DataFrame:
    items = S.read(spark, d, "documents").select(F.col("doc_id").alias("query_id"))
    n = (items.agg(F.max("query_id")).first()[0] or 0) // 50 + 1  # labels are dealt to all queries
    l = S.read(spark, d, "labels").select((F.col("doc_id") * 7 % n * 50).alias("query_id"), F.col("doc_id").alias("id"), (F.col("quality") * 2 + F.col("toxic")).alias("grade"))  # noqa: E741
    return l.join(items, "query_id")


_METRICS = f"""WITH {_BM25}, {_JUDGED}, r AS (SELECT query_id, id, rank FROM br WHERE rank <= 200), g AS (SELECT r.*, coalesce(grade, 0) AS grade FROM r LEFT JOIN j USING (query_id, id)),
i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS i FROM j), ideal AS (SELECT query_id, sum(CASE WHEN i <= 5 THEN (2 ** grade - 1) / log2(i + 1) END) AS ideal, sum((grade >= 1)::INT) AS relevant FROM i GROUP BY query_id),
m AS (SELECT query_id, sum(CASE WHEN rank <= 5 THEN (2 ** grade - 1) / log2(rank + 1) ELSE 0 END) AS dcg, sum((rank <= 5 AND grade >= 2)::INT) / 5 AS precision_at_k, sum((rank <= 10 AND grade >= 1)::INT) AS hits, min(rank) FILTER (WHERE grade >= 2) AS first FROM g GROUP BY query_id)"""


def metrics(spark: SparkSession, d: str, deepest: int) -> DataFrame:
    """Metrics of lexical runs, of which those that are asked for read no rank beyond the deepest."""
    return E.ranking_metrics(lexical_ranks(spark, d, deepest).select("query_id", "id", "rank"), judged(spark, d))


@P.query("ndcg_at_5", f"{_METRICS} SELECT query_id, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 9) AS ndcg FROM m LEFT JOIN ideal USING (query_id)")
def ndcg_at_5(spark: SparkSession, d: str) -> DataFrame:
    return metrics(spark, d, 5).select("query_id", "ndcg")


@P.query("precision_at_5", f"{_METRICS} SELECT query_id, precision_at_k FROM m")
def precision_at_5(spark: SparkSession, d: str) -> DataFrame:
    return metrics(spark, d, 5).select("query_id", "precision_at_k")


@P.query("stage_metrics", f"{_METRICS} SELECT query_id, round(CASE WHEN relevant > 0 THEN hits / relevant ELSE 0 END, 9) AS pooled_recall, hits / 10 AS pooled_precision, round(coalesce(1.0 / first, 0), 9) AS mrr FROM m LEFT JOIN ideal USING (query_id)")
def stage_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics(spark, d, 200).select("query_id", "pooled_recall", "pooled_precision", "mrr")


_HITS = "len(list_filter({0}, lambda v: contains(lower(said), lower(v))))"


@P.query("weak_grade", f"""WITH h AS (SELECT conv_id, turn, role, {_HITS.format("['Hoi An', 'Hue']")} AS p, {_HITS.format("['Vietnam', 'Da Nang']")} AS l, {_HITS.format("['food', 'price', 'weather']")} AS k FROM {S.REQUESTS})
SELECT conv_id, turn, role, CASE WHEN p > 0 THEN 3 WHEN l > 0 AND k > 0 THEN 2 WHEN l > 0 OR k >= 2 THEN 1 ELSE 0 END AS grade FROM h""")
def weak_grade(spark: SparkSession, d: str) -> DataFrame:
    """A place counts 3, a location with a keyword 2, a location or two keywords 1."""
    names = [F.array(*[F.lit(x) for x in group]) for group in (("Hoi An", "Hue"), ("Vietnam", "Da Nang"), ("food", "price", "weather"))]
    return S.requests(spark, d).select("conv_id", "turn", "role", E.weak_grade(F.col("said"), *names).alias("grade"))


@P.query("weak_metrics")
def weak_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Lexical runs by known ids, every other query by what the texts name: its own first three words and the source."""
    docs = S.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    run = lexical_ranks(spark, d, 10).select("query_id", "id", "rank").join(docs.select("id", "text"), "id")
    words = F.slice(tokens(F.col("text")), 1, 3)
    none = F.array().cast("array<bigint>")
    own = docs.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.when(F.col("id") % 100 == 0, F.array("id", F.col("id") + 1)).otherwise(none).alias("relevant"), words.alias("places"), F.array("source").alias("locations"), words.alias("keywords"))
    return E.weak_metrics(run, own)


@P.query("set_f1", "WITH s AS (SELECT conv_id, list_distinct(list(role)) AS a, list_distinct(list(CASE turn % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' ELSE 'tool' END)) AS b FROM conversations GROUP BY conv_id) SELECT conv_id, round(2 * len(list_intersect(a, b)) / (len(a) + len(b)), 9) AS f1 FROM s")
def set_f1(spark: SparkSession, d: str) -> DataFrame:
    other = F.when(F.col("turn") % 3 == 0, "user").when(F.col("turn") % 3 == 1, "assistant").otherwise("tool")
    g = S.read(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("a"), F.collect_set(other).alias("b"))
    return g.select("conv_id", F.round(E.set_f1(F.col("a"), F.col("b")), 9).alias("f1"))


_GOLD = "CASE (conv_id * 7 + turn) % 16 WHEN 4 THEN 'Food_Search' WHEN 11 THEN 'attraction search' WHEN 12 THEN 'itinerary' WHEN 14 THEN 'food search' ELSE 'travel_information' END"
_GOLD_OPERATION = "CASE (conv_id * 7 + turn) % 16 WHEN 4 THEN 'Compare' WHEN 12 THEN 'plan' WHEN 6 THEN 'recommend' WHEN 14 THEN 'explain' ELSE 'lookup' END"
_FLAT = "trim(regexp_replace(replace(lower({0}), '_', ' '), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))"
_PARSED = f"(SELECT *, CASE {Q._CASES} ELSE 'travel_information' END AS intent, {_GOLD} AS gold, list_extract(list_filter({Q._list(Q.NAMES)}, lambda n: contains(lower(said), lower(n))), -1) AS city, {_GOLD_OPERATION} AS gold_operation FROM {S.REQUESTS})"
_OPERATED = f"(SELECT *, {Q._OPERATION} AS operation, {_GOLD_OPERATION} AS gold FROM (SELECT *, '' AS intent FROM {S.REQUESTS}))"


@P.query("intent_accuracy", f"SELECT role, round(avg(({_FLAT.format('intent')} = {_FLAT.format('gold')})::INT), 9) AS accuracy FROM {_PARSED} GROUP BY role")
def intent_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """The offline parser's intents against the phrases' own."""
    got = U.keyword_parse(F.col("said"), Q.NAMES, Q._RULES, "travel_information")["intent"]
    return S.requests(spark, d).withColumn("ok", E.same(got, F.expr(_GOLD))).groupBy("role").agg(F.round(F.avg(F.col("ok").cast("int")), 9).alias("accuracy"))


@P.query("operation_accuracy", f"SELECT role, round(avg(({_FLAT.format('operation')} = {_FLAT.format('gold')})::INT), 9) AS accuracy FROM {_OPERATED} GROUP BY role")
def operation_accuracy(spark: SparkSession, d: str) -> DataFrame:
    got = U.old_operation(F.col("said"), F.lit(""))
    return S.requests(spark, d).withColumn("ok", E.same(got, F.expr(_GOLD_OPERATION))).groupBy("role").agg(F.round(F.avg(F.col("ok").cast("int")), 9).alias("accuracy"))


@P.query("rewrite_concepts", f"""WITH x AS (SELECT conv_id, turn, role, {_FLAT.format('said')} AS t, CASE WHEN conv_id % 2 = 0 THEN ['Hue', 'hotel'] ELSE ['Hoi_An', 'food', 'beach'] END AS req, CASE WHEN conv_id % 3 = 0 THEN [] ELSE ['luxury', 'cheap'] END AS forb FROM {S.REQUESTS}),
h AS (SELECT *, len(list_filter(req, lambda v: contains(t, {_FLAT.format('v')}))) AS a, len(list_filter(forb, lambda v: contains(t, v))) AS b FROM x)
SELECT conv_id, turn, role, round(a / len(req), 9) AS recall, CASE WHEN len(forb) > 0 THEN round(b / len(forb), 9) ELSE 0 END AS forbidden, a = len(req) AND b = 0 AS passed FROM h""")
def rewrite_concepts(spark: SparkSession, d: str) -> DataFrame:
    words = lambda *w: F.array(*[F.lit(x) for x in w]) if w else F.array().cast("array<string>")
    x = E.concept_score(F.col("said"), F.when(F.col("conv_id") % 2 == 0, words("Hue", "hotel")).otherwise(words("Hoi_An", "food", "beach")), F.when(F.col("conv_id") % 3 == 0, words()).otherwise(words("luxury", "cheap")))
    return S.requests(spark, d).select("conv_id", "turn", "role", F.round(x["recall"], 9).alias("recall"), F.round(x["forbidden"], 9).alias("forbidden"), x["passed"].alias("passed"))


@P.query("parser_score", f"""SELECT *, intent AND city AND days AS exact FROM (SELECT conv_id, turn, role, {_FLAT.format('intent')} = {_FLAT.format('gold')} AS intent, lower(city) IS NOT DISTINCT FROM lower(CASE (conv_id * 7 + turn) % 16 WHEN 0 THEN 'Hoi An' WHEN 3 THEN 'hue' WHEN 5 THEN 'Hoi An' END) AS city,
try_cast(nullif(regexp_extract(lower(said), '(\\d+)\\s*days?\\b', 1), '') AS INTEGER) IS NOT DISTINCT FROM (CASE (conv_id * 7 + turn) % 16 WHEN 12 THEN 3 END) AS days FROM {_PARSED})""")
def parser_score(spark: SparkSession, d: str) -> DataFrame:
    """A parse against the one expected, field by field."""
    r = S.requests(spark, d).withColumn("p", U.keyword_parse(F.col("said"), Q.NAMES, Q._RULES, "travel_information"))
    i = (F.col("conv_id") * 7 + F.col("turn")) % 16
    city = F.when(i == 0, "HOI_AN").when(i == 3, "hue").when(i == 5, "Hoi An")
    x = E.field_score({"intent": (F.col("p.intent"), F.expr(_GOLD)), "city": (F.col("p.city"), city), "days": (F.col("p.days"), F.when(i == 12, 3))})
    return r.select("conv_id", "turn", "role", x.alias("x")).select("conv_id", "turn", "role", "x.*")


@P.query("list_prf", f"""WITH s AS (SELECT conv_id, list_filter({Q._list(Q.NAMES)}, lambda n: contains(said, n)) AS a, list_filter({Q._list(Q.NAMES)}, lambda n: contains(lower(said), 'hotel') OR n = 'Hue' AND conv_id % 2 = 0) AS b, turn, role FROM {S.REQUESTS}), h AS (SELECT *, len(list_intersect(a, b)) AS h FROM s),
q AS (SELECT *, CASE WHEN len(a) > 0 THEN h / len(a) ELSE (len(b) = 0)::INT END AS p, CASE WHEN len(b) > 0 THEN h / len(b) ELSE 1 END AS r FROM h) SELECT conv_id, turn, role, round(p, 9) AS precision, round(r, 9) AS recall, CASE WHEN p + r > 0 THEN round(2 * p * r / (p + r), 9) ELSE 0 END AS f1 FROM q""")
def list_prf(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in Q.NAMES])
    said = F.filter(names, lambda n: F.contains(F.col("said"), n))
    want = F.filter(names, lambda n: F.contains(F.lower("said"), F.lit("hotel")) | ((n == "Hue") & (F.col("conv_id") % 2 == 0)))
    x = E.list_prf(said, want)
    return S.requests(spark, d).select("conv_id", "turn", "role", *[F.round(x[k], 9).alias(k) for k in ("precision", "recall", "f1")])


@P.query("citation_count", "SELECT conv_id, turn, role, len(regexp_extract_all(text, '\\[E[0-9]+\\]')) AS citations, len(regexp_extract_all(text, '[.]')) AS sentences FROM conversations")
def citation_count(spark: SparkSession, d: str) -> DataFrame:
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return S.read(spark, d, "conversations").select("conv_id", "turn", "role", n(r"\[E[0-9]+\]").alias("citations"), n("[.]").alias("sentences"))



