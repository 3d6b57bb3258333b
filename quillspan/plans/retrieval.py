"""Search, fusion, ranking and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators.numbering import numbered
from ..sources import tables as S
from ..sources.providers import overlap_reranker
from .kit import Plans

P = Plans()
CH, ME, CA = S.CHUNKS, S.MEMORIES, S.CASES
NOW = "2026-01-01 00:00:00"

#: Vector queries are the rows whose id is divisible by 50, each against all rows.
_VEC = """vq AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0),
vs AS (SELECT query_id, vec_id AS id, round(round(list_dot_product(qv::DOUBLE[], embedding::DOUBLE[]) / (sqrt(list_dot_product(qv::DOUBLE[], qv::DOUBLE[])) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 9), 6) AS score FROM vq, embeddings),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vs)"""
#: Text queries are the documents whose id is divisible by 50, each against all documents.
_TOKENS = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda t: t <> '')"


def bm25_sql(documents: str) -> str:
    """Search by BM25 in SQL over a relation of doc_id and text: br has the ranks."""
    return f"""dt AS (SELECT doc_id AS id, unnest({_TOKENS}) AS term FROM {documents}),
tf AS (SELECT id, term, count(*) AS tf FROM dt GROUP BY ALL), dl AS (SELECT doc_id AS id, len({_TOKENS}) AS dl FROM {documents}),
tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, tot), mean AS (SELECT avg(raw) AS m FROM raw),
qt AS (SELECT doc_id AS query_id, unnest({_TOKENS}) AS term FROM {documents} WHERE doc_id % 50 = 0), qc AS (SELECT query_id, term, count(*) AS times FROM qt GROUP BY ALL),
bs AS (SELECT query_id, id, round(sum(times * CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
 FROM qc JOIN raw USING (term) JOIN tf USING (term) JOIN dl USING (id), tot, mean GROUP BY query_id, id),
br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bs)"""


_BM25 = bm25_sql("documents")


def vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = S.read(spark, d, "embeddings")
    return e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def vector_ranks(spark: SparkSession, d: str, k: int) -> DataFrame:
    """Ranked by the score to six places, ties by id."""
    return R.vector_topk(*vectors(spark, d), k)


def text_queries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = S.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return rows.filter("id % 50 = 0").withColumnRenamed("id", "query_id"), rows


def lexical_ranks(spark: SparkSession, d: str, k: int) -> DataFrame:
    return R.bm25_topk(*text_queries(spark, d), k)


@P.query("vector_topk_cosine", f"WITH {_VEC} SELECT query_id, id, score, rank FROM vr WHERE rank <= 30")
def vector_topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    return vector_ranks(spark, d, 30)


@P.query("bm25_topk", f"WITH {_BM25} SELECT query_id, id, score, rank FROM br WHERE rank <= 30")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical_ranks(spark, d, 30)


_FUSED = "SELECT query_id, id, a.rank AS first_rank, b.rank AS second_rank, round(coalesce(1 / (60 + a.rank), 0) + coalesce(1 / (60 + b.rank), 0), 9) AS rrf FROM (SELECT * FROM vr WHERE rank <= 30) a FULL JOIN (SELECT * FROM br WHERE rank <= 30) b USING (query_id, id)"


def fused(spark: SparkSession, d: str) -> DataFrame:
    return R.reciprocal_ranks(vector_ranks(spark, d, 30), lexical_ranks(spark, d, 30))


@P.query("fuse_outer_join", f"WITH {_VEC}, {_BM25} {_FUSED}")
def fuse_outer_join(spark: SparkSession, d: str) -> DataFrame:
    return fused(spark, d)


@P.query("rrf_fusion", f"WITH {_VEC}, {_BM25}, f AS ({_FUSED}) SELECT query_id, id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first_rank NULLS LAST, second_rank NULLS LAST) AS rank FROM f")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return R.fused_rank(fused(spark, d)).select("query_id", "id", "rrf", "rank")


_GEO = "0.02 / (1 + 6371.0 * 2 * atan2(sqrt(a), sqrt(1 - a)))"
_HAV = "pow(sin(radians(latitude - 16e0) / 2), 2) + cos(radians(16e0)) * cos(radians(latitude)) * pow(sin(radians(longitude - 1.06e2) / 2), 2)"


@P.query(
    "hybrid_retrieval",
    f"""WITH {_VEC}, {_BM25}, f AS ({_FUSED}), g AS (SELECT f.*, c.city, {_HAV} AS a FROM f LEFT JOIN {CH} c ON c.chunk_id = f.id),
s AS (SELECT *, round(rrf + coalesce({_GEO}, 0) + CASE WHEN city = 'src1' THEN 0.015 ELSE 0 END, 9) AS score FROM g)
SELECT query_id, id, city, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_rank NULLS LAST, second_rank NULLS LAST) AS rank FROM s) WHERE rank <= 8""",
)
def hybrid_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Vector and lexical lists, fused, boosted by distance and metadata, the best eight of each query."""
    chunk = S.chunks(spark, d).select(F.col("chunk_id").alias("id"), "city", "latitude", "longitude")
    geo = R.geo_boost(F.lit(16.0), F.lit(106.0), F.col("latitude"), F.col("longitude"))
    meta = R.metadata_boost(F.array(F.lit("src1")), F.array("city"), 0.015)
    scored = fused(spark, d).join(chunk, "id", "left").withColumn("score", F.round(F.col("rrf") + geo + F.coalesce(meta, F.lit(0.0)), 9))
    return R.fused_rank(scored, "score").filter("rank <= 8").select("query_id", "id", "city", "score", "rank")


_BAG = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[ \\t\\n\\x0b\\f\\r]+'), lambda t: t <> ''))"


@P.query("rerank_topk", f"""WITH {_BM25}, c AS (SELECT query_id, id, br.rank AS fused_rank, {_BAG.format("b.text")} AS qa, {_BAG.format("d.text")} AS da
FROM br JOIN documents b ON b.doc_id = query_id JOIN documents d ON d.doc_id = id WHERE br.rank <= 20),
s AS (SELECT query_id, id, fused_rank, round(len(list_intersect(qa, da)) / greatest(1, len(qa)), 6) AS score FROM c)
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused_rank) AS rank FROM s) WHERE rank <= 8""")
def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    """The reranker, a provider of scores for pairs of texts, orders the best twenty; ties as they came, eight stay."""
    q, rows = text_queries(spark, d)
    return R.reranked(lexical_ranks(spark, d, 20), q, rows, overlap_reranker, 8)


_RANKED = f"SELECT lang AS query_id, doc_id AS chunk_id, source AS city, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents"


def ranked_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = S.read(spark, d, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("chunk_id"), F.col("source").alias("city"), "n_chars")
    return numbered(docs, ["query_id"], [F.desc("n_chars"), F.asc("chunk_id")]).drop("n_chars")


def _balance_sql(src: str, top: int, per: int) -> str:
    return f"""SELECT query_id, chunk_id, city, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY reserved DESC, rank) AS turn
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, city ORDER BY rank) <= {per} AS reserved FROM ({src}))) WHERE turn <= {top}"""


@P.query("balanced_by_city", _balance_sql(_RANKED, 60, 2))
def balanced_by_city(spark: SparkSession, d: str) -> DataFrame:
    return R.balanced(ranked_chunks(spark, d), 60, 2).select("query_id", "chunk_id", "city", "rank", "position")


@P.query("comparison_balance", f"SELECT query_id, city, count(*) AS n, count(*) < 2 AS underrepresented FROM ({_balance_sql(f'SELECT query_id, chunk_id, city, position AS rank FROM ({_balance_sql(_RANKED, 80, 3)})', 40, 2)}) GROUP BY query_id, city")
def comparison_balance(spark: SparkSession, d: str) -> DataFrame:
    """Balanced before and after reranking; cities with too few rows are named."""
    first = R.balanced(ranked_chunks(spark, d), 80, 3).select("query_id", "chunk_id", "city", F.col("position").alias("rank"))
    return R.balanced(first, 40, 2).groupBy("query_id", "city").agg(F.count(F.lit(1)).alias("n")).withColumn("underrepresented", F.col("n") < 2)


@P.query("lowest_coverage", f"SELECT case_id, coverage, missing, row_number() OVER (ORDER BY coverage, missing DESC, case_id) AS selection_rank FROM {CA} ORDER BY coverage, missing DESC, case_id LIMIT 25")
def lowest_coverage(spark: SparkSession, d: str) -> DataFrame:
    chosen = S.cases(spark, d).select("case_id", "coverage", "missing").orderBy("coverage", F.desc("missing"), "case_id").limit(25)
    return chosen.withColumn("selection_rank", F.row_number().over(Window.orderBy("coverage", F.desc("missing"), "case_id")))  # 25 rows


@P.query("recent_conversations", "SELECT role, conv_id, last_turn, rank FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY last_turn DESC, conv_id) AS rank FROM (SELECT role, conv_id, max(turn) AS last_turn FROM conversations GROUP BY role, conv_id)) WHERE rank <= 50")
def recent_conversations(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("role").orderBy(F.desc("last_turn"), "conv_id")
    c = S.read(spark, d, "conversations").groupBy("role", "conv_id").agg(F.max("turn").alias("last_turn"))
    return c.withColumn("rank", F.row_number().over(w)).filter("rank <= 50")


@P.query("last_n_history", "SELECT conv_id, string_agg(role || ':' || md5(text), ' ' ORDER BY turn, role) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS rn FROM conversations) WHERE rn <= 4 GROUP BY conv_id")
def last_n_history(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"))
    last = S.read(spark, d, "conversations").withColumn("rn", F.row_number().over(w)).filter("rn <= 4")
    each = F.sort_array(F.collect_list(F.struct("turn", "role", F.md5("text").alias("h"))))
    return last.groupBy("conv_id").agg(F.array_join(F.transform(each, lambda x: F.concat(x["role"], F.lit(":"), x["h"])), " ").alias("history"))


@P.query("candidate_pool", f"""WITH u AS (SELECT query_id, chunk_id, 0 AS stage, rank FROM ({_RANKED}) WHERE rank % 3 = 0 AND rank <= 30 UNION ALL SELECT query_id, chunk_id, 1, rank FROM ({_RANKED}) WHERE rank <= 60),
b AS (SELECT query_id, chunk_id, min(stage * 1000 + rank) AS seq FROM u GROUP BY ALL)
SELECT query_id, chunk_id, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seq) AS position FROM b) WHERE position <= 50""")
def candidate_pool(spark: SparkSession, d: str) -> DataFrame:
    """Stages in order of trust, the first occurrence of a chunk counts, 50 for each query."""
    r = ranked_chunks(spark, d).filter("rank <= 60").select("query_id", "chunk_id", "rank")
    both = r.filter("rank % 3 = 0 AND rank <= 30").withColumn("seq", F.col("rank")).unionByName(r.withColumn("seq", 1000 + F.col("rank")))
    best = both.groupBy("query_id", "chunk_id").agg(F.min("seq").alias("seq"))
    return best.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("seq"))).filter("position <= 50").drop("seq")


@P.query("geo_candidate_rank", "SELECT n.n_nationkey AS place_id, c.c_custkey AS candidate, c.score FROM nation n JOIN (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY score DESC, c_custkey) AS rn FROM (SELECT c_nationkey, c_custkey, 10 * (c_custkey % 3 = 0)::INT + 4 * (c_mktsegment = 'BUILDING')::INT + 2 * (c_mktsegment = 'AUTOMOBILE')::INT + round(c_acctbal / 1e4, 4) AS score FROM customer)) c ON c.c_nationkey = n.n_nationkey AND c.rn = 1")
def geo_candidate_rank(spark: SparkSession, d: str) -> DataFrame:
    """Each place's best candidate: a name match counts 10, a city 4, a province 2, and its importance."""
    c = S.read(spark, d, "customer")
    score = F.when(F.col("c_custkey") % 3 == 0, 10).otherwise(0) + F.when(F.col("c_mktsegment") == "BUILDING", 4).otherwise(0) + F.when(F.col("c_mktsegment") == "AUTOMOBILE", 2).otherwise(0) + F.round(F.col("c_acctbal") / 1e4, 4)
    best = c.select("c_nationkey", F.struct(score.alias("score"), (-F.col("c_custkey")).alias("id")).alias("s")).groupBy("c_nationkey").agg(F.max("s").alias("s"))
    n = S.read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"))
    return n.join(best, "c_nationkey").select(F.col("c_nationkey").alias("place_id"), (-F.col("s.id")).alias("candidate"), "s.score")


@P.query("metadata_boost", "SELECT doc_id, round(len(list_filter(['src1', 'src2', 'src1', 'en'], lambda w: w = source OR w = lang)) * 0.015, 6) AS boost FROM documents")
def metadata_boost(spark: SparkSession, d: str) -> DataFrame:
    wanted = F.array(*[F.lit(x) for x in ("src1", "src2", "src1", "en")])
    return S.read(spark, d, "documents").select("doc_id", F.round(R.metadata_boost(wanted, F.array("source", "lang"), 0.015), 6).alias("boost"))


@P.query("haversine_km", f"SELECT chunk_id, round(6371.0 * 2 * atan2(sqrt(a), sqrt(1 - a)), 6) AS km FROM (SELECT chunk_id, {_HAV} AS a FROM {CH})")
def haversine_km(spark: SparkSession, d: str) -> DataFrame:
    return S.chunks(spark, d).select("chunk_id", F.round(R.haversine_km(F.lit(16.0), F.lit(106.0), F.col("latitude"), F.col("longitude")), 6).alias("km"))


@P.query("geo_boost", f"SELECT chunk_id, round(coalesce({_GEO}, 0), 9) AS boost FROM (SELECT chunk_id, {_HAV} AS a FROM {CH})")
def geo_boost(spark: SparkSession, d: str) -> DataFrame:
    return S.chunks(spark, d).select("chunk_id", F.round(R.geo_boost(F.lit(16.0), F.lit(106.0), F.col("latitude"), F.col("longitude")), 9).alias("boost"))


@P.query("freshness_boost", f"SELECT o_orderkey, round(0.01 * exp(-greatest(0, floor((epoch(TIMESTAMP '{NOW}') - floor(epoch(o_orderdate))) / 86400)) / 365.0), 9) AS boost FROM orders")
def freshness_boost(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp")
    return S.read(spark, d, "orders").select("o_orderkey", F.round(R.freshness_boost(at, F.to_timestamp(F.lit(NOW))), 9).alias("boost"))


@P.query("retrieval_confidence", f"""WITH {_BM25}, t AS (SELECT query_id, score, rank FROM br WHERE rank <= 8), m AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS mx FROM t),
g AS (SELECT query_id, count(*) AS n, round(0.7 / sum(exp(score - mx)) + least(count(*) / 5.0, 1.0) * 0.3, 4) AS confidence, round(max(score) FILTER (WHERE rank = 1) - max(score) FILTER (WHERE rank = 2), 4) AS score_gap FROM m GROUP BY query_id)
SELECT *, CASE WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END AS level FROM g""")
def retrieval_confidence(spark: SparkSession, d: str) -> DataFrame:
    return R.confidence(lexical_ranks(spark, d, 8))


@P.query("llm_cost", "SELECT l_orderkey, l_linenumber, round(((l_quantity * 100 - l_linenumber) * p.input + l_linenumber * coalesce(p.cached, p.input) + l_quantity * p.output) / 1e6, 10) AS cost FROM lineitem LEFT JOIN (VALUES ('N', 2.5e0, 1.25e0, 10e0), ('R', 0.15e0, NULL, 0.6e0)) p(model, input, cached, output) ON p.model = l_returnflag")
def llm_cost(spark: SparkSession, d: str) -> DataFrame:
    prices = spark.createDataFrame([("N", 2.5, 1.25, 10.0), ("R", 0.15, None, 0.6)], "l_returnflag string, input double, cached double, output double")
    x = S.read(spark, d, "lineitem").join(F.broadcast(prices), "l_returnflag", "left")  # a price list of two rows
    cost = ((F.col("l_quantity") * 100 - F.col("l_linenumber")) * F.col("input") + F.col("l_linenumber") * F.coalesce("cached", "input") + F.col("l_quantity") * F.col("output")) / 1e6
    return x.select("l_orderkey", "l_linenumber", F.round(cost, 10).alias("cost"))


@P.query("usage_normalize", "SELECT event_id, k AS prompt, least(k, k % 7) AS cached, k + 5 AS total FROM (SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k FROM events)")
def usage_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Prompt tokens under either name, cached ones at most those, and a total where none is given."""
    prompt = F.coalesce(F.get_json_object("props", "$.prompt_tokens"), F.get_json_object("props", "$.k"), F.lit("0")).cast("long")
    e = S.read(spark, d, "events").select("event_id", prompt.alias("prompt"), F.get_json_object("props", "$.total").cast("long").alias("given"))
    return e.select("event_id", "prompt", F.least("prompt", F.col("prompt") % 7).alias("cached"), F.coalesce("given", F.col("prompt") + 5).alias("total"))
