"""Paged sources, files, sessions and a few scalar rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import paged, scratch, sinks
from ..sources import tables as S
from .kit import Plans

P = Plans()
CA = S.CASES


def _paged(spark: SparkSession, d: str) -> DataFrame:
    """The table of pages as a paged API serves it, a hundred at a time."""
    path = scratch.new_path(spark, "api")
    rows = S.read(spark, d, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit("page "), "page_id").alias("title"), F.col("url").alias("link"), F.array(F.col("page_id") % 7, F.col("page_id") % 5).alias("categories"), F.floor(F.col("page_id") / 100 + 1).alias("page"))
    rows.repartition("page").write.partitionBy("page").json(path)
    last = rows.agg(F.max("page")).first()[0] or 0
    spark.dataSource.register(paged.PagedSource)
    return spark.read.format("paged").option("resource", path).option("per_page", 100).option("pages", last).load()


@P.query("wp_posts", "SELECT page_id AS id, 'page ' || page_id AS title, (page_id % 7) || ',' || (page_id % 5) AS categories FROM pages")
def wp_posts(spark: SparkSession, d: str) -> DataFrame:
    return _paged(spark, d).select("id", "title", F.array_join(F.transform("categories", lambda c: c.cast("string")), ",").alias("categories"))


@P.query("wikivoyage_api", "SELECT page_id % 7 AS category, count(*) AS n, min(url) AS link FROM pages GROUP BY 1")
def wikivoyage_api(spark: SparkSession, d: str) -> DataFrame:
    """Members of categories, page by page."""
    return _paged(spark, d).groupBy(F.element_at("categories", 1).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.min("link").alias("link"))


@P.query("pdf_folder", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def pdf_folder(spark: SparkSession, d: str) -> DataFrame:
    """Files of a folder tree by name pattern, sorted; here one folder for each language, counted by lines."""
    path = scratch.new_path(spark, "folder")
    S.read(spark, d, "documents").select("lang", F.md5("text").alias("value")).write.partitionBy("lang").text(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path)
    lines = F.regexp_count(F.decode("content", "UTF-8"), F.lit("\n"))
    return files.groupBy(F.regexp_extract("path", "/lang=([^/]+)/", 1).alias("lang")).agg(F.sum(lines).alias("n"))


@P.query("geocoder", f"WITH g AS (SELECT doc_id, lower(source) AS k, 10 + doc_id % 900 / 100 AS latitude FROM documents), p AS (SELECT DISTINCT source, lang FROM documents) SELECT source, lang, doc_id, round(latitude, 3) AS latitude, rank FROM (SELECT p.*, g.doc_id, g.latitude, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rank FROM p JOIN g ON g.k = lower(source)) WHERE rank <= 5")
def geocoder(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of places from a gazetteer, five each, by the key of their names; ranking is geo_candidate_rank."""
    docs = S.read(spark, d, "documents")
    gazetteer = docs.select(T.location_key(F.upper("source")).alias("key"), F.struct("doc_id", (10 + F.col("doc_id") % 900 / 100).alias("latitude")).alias("place"))
    # Five of each key are enough for any place: they are cut out slice by slice before names meet.
    part = Window.partitionBy("key", F.pmod(F.xxhash64("place"), F.lit(64))).orderBy("place")
    few = gazetteer.withColumn("i", F.row_number().over(part)).filter("i <= 5").withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("place"))).filter("rank <= 5")
    places = docs.select("source", "lang").distinct().withColumn("key", T.location_key(F.col("source")))
    return places.join(few, "key").select("source", "lang", "place.doc_id", F.round("place.latitude", 3).alias("latitude"), "rank")


@P.query("markdown_file", "SELECT item_id, length(text) AS n, md5(text) AS h FROM benchmark")
def markdown_file(spark: SparkSession, d: str) -> DataFrame:
    """Each document's Markdown in its folder, read back."""
    path = scratch.new_path(spark, "markdown")
    sinks.markdown_files(S.read(spark, d, "benchmark"), "item_id", "text", path)
    back = spark.read.schema("item_id long, markdown string, folder int").json(path)
    return back.select("item_id", F.char_length("markdown").cast("long").alias("n"), F.md5("markdown").alias("h"))


@P.query("conversation_messages", "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS position FROM conversations")
def conversation_messages(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return S.read(spark, d, "conversations").select("conv_id", "turn", "role", F.row_number().over(w).alias("position"))


@P.query("md5_norm", "SELECT conv_id, turn, role, md5(trim(regexp_replace(lower(text), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) AS h FROM conversations")
def md5_norm(spark: SparkSession, d: str) -> DataFrame:
    return S.read(spark, d, "conversations").select("conv_id", "turn", "role", T.normal_hash(F.col("text")).alias("h"))


@P.query("source_type", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'official_government' WHEN 1 THEN 'academic' ELSE 'open_web' END AS source_type FROM nation")
def source_type(spark: SparkSession, d: str) -> DataFrame:
    host = F.when(F.col("n_nationkey") % 3 == 0, "https://a.gov/x").when(F.col("n_nationkey") % 3 == 1, "http://b.edu").otherwise("https://gov.example.org/edu")
    return S.read(spark, d, "nation").select("n_nationkey", T.source_kind(host).alias("source_type"))


@P.query("telemetry_session", "WITH g AS (SELECT user_id, ts, value, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, session")
def telemetry_session(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user: events at most half an hour apart."""
    e = S.read(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"))
    return s.select("user_id", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
