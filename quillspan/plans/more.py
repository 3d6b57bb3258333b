"""Providers, sinks, validation and the remaining scalar rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import replies, robots
from ..operators.numbering import numbered
from ..sources import ledger, pdf, providers, scratch, sinks, telemetry
from ..sources import tables as S
from .kit import Plans

P = Plans()
CH, QU, CA = S.CHUNKS, S.QUEUES, S.CASES


@P.query("embed_chunks")
def embed_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = S.read(spark, d, "documents").select("doc_id", "text")
    e = providers.provided(docs, "text", "embedding", "array<float>", providers.hashed_embedder())
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return e.select("doc_id", F.size("embedding").alias("n"), F.round(norm, 3).alias("norm"), F.col("embedding_error").isNull().alias("ok"))


_URLS = ("https://a.org/x", "http://127.0.0.1/x", "http://172.16.3.4/", "http://169.254.1.1/a", "http://[::1]/", "https://u:p@a.org/", "https://a.org:8080/", "http://2130706433/", "ftp://a.org", "http://93.184.216.34:80/")
_PUBLIC = (0, 9)
_URL = f"CASE page_id % {len(_URLS)} " + " ".join(f"WHEN {i} THEN '{u}'" for i, u in enumerate(_URLS)) + " END"


@P.query("fetch_html", f"SELECT page_id, CASE WHEN page_id % {len(_URLS)} IN {_PUBLIC} THEN length({_URL}) * 3 END AS n, CASE WHEN page_id % {len(_URLS)} NOT IN {_PUBLIC} THEN 'not a public destination' END AS reason FROM pages")
def fetch_html(spark: SparkSession, d: str) -> DataFrame:
    """Pages by the fetching provider; its getter, here an offline one, is injected."""
    pages = S.read(spark, d, "pages").select("page_id", F.expr(_URL).alias("address"))
    got = providers.provided(pages, "address", "f", "struct<page: string, reason: string>", providers.fetcher(lambda u: u.encode() * 3))
    return got.select("page_id", F.char_length("f.page").cast("long").alias("n"), F.col("f.reason").alias("reason"))


@P.query("fetch_html_safe", f"SELECT page_id, page_id % {len(_URLS)} IN {_PUBLIC} AS allowed FROM pages")
def fetch_html_safe(spark: SparkSession, d: str) -> DataFrame:
    """Which destinations a fetch may go to: public addresses over http and https, in whatever way they are written."""

    @F.pandas_udf("boolean")
    def allowed(urls: pd.Series) -> pd.Series:
        return urls.map(providers.public_destination)

    return S.read(spark, d, "pages").select("page_id", allowed(F.expr(_URL)).alias("allowed"))


@P.query("json_dataset", f"SELECT case_id, user_id, missing FROM {CA}")
def json_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Cases written as JSON and read under a fixed schema."""
    path = scratch.new_path(spark, "cases")
    S.cases(spark, d).select("case_id", "user_id", "missing").write.json(path)
    return spark.read.schema("case_id long, user_id string, missing long").json(path)


@P.query("write_document_chunks", f"SELECT city, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM {CH} WHERE document_id IN (SELECT page_id FROM pages) GROUP BY city")
def write_document_chunks(spark: SparkSession, d: str) -> DataFrame:
    path = scratch.new_path(spark, "store")
    chunks = S.chunks(spark, d).select("chunk_id", "document_id", "city", "n_chars")
    sinks.write_document_chunks(S.read(spark, d, "pages").select(F.col("page_id").alias("document_id")), chunks, path)
    stored = spark.read.schema(chunks.schema).parquet(f"{path}/chunks")
    documents = spark.read.schema("document_id long").parquet(f"{path}/documents")
    return sinks.readable_chunks(stored, documents).groupBy("city").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@P.query("csv_json_report", f"SELECT user_id, count(*) AS n, round(avg(ndcg), 6) AS ndcg FROM {CA} GROUP BY user_id")
def csv_json_report(spark: SparkSession, d: str) -> DataFrame:
    path = scratch.new_path(spark, "report")
    report = S.cases(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ndcg"), 6).alias("ndcg"))
    sinks.csv_report(report, path)
    return spark.read.schema(report.schema).option("header", True).csv(path)


@P.query("ndjson_stream", "SELECT event_type AS stage, count(*) AS n FROM events GROUP BY event_type")
def ndjson_stream(spark: SparkSession, d: str) -> DataFrame:
    """Stage events as lines of JSON, read back."""
    path = scratch.new_path(spark, "stages")
    e = S.read(spark, d, "events")
    sinks.ndjson(e.select(sinks.stage_event(F.lit("stage"), stage=F.col("event_type"), id=F.col("event_id")).alias("value")), path)
    return spark.read.schema("type string, stage string, id long").json(path).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


@P.query("save_gap", "SELECT o_custkey, count(*) AS n, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS missing FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey")
def save_gap(spark: SparkSession, d: str) -> DataFrame:
    """Gaps with their missing requirements as an array column, appended once."""
    path = scratch.new_path(spark, "gaps")
    g = S.read(spark, d, "orders").filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("o_orderpriority")).alias("missing"))
    sinks.append_new(g, path, ["o_custkey"])
    sinks.append_new(g, path, ["o_custkey"])  # nothing is new
    return spark.read.schema(g.schema).parquet(path).withColumn("missing", F.array_join("missing", ","))


@P.query("save_telemetry", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def save_telemetry(spark: SparkSession, d: str) -> DataFrame:
    path = scratch.new_path(spark, "telemetry")
    e = S.read(spark, d, "events").select("event_id", "user_id")
    sinks.append_new(e, path, ["event_id"])
    return spark.read.schema(e.schema).parquet(path).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def greedy_matches(expected: list[str], found: list[str]) -> int:
    """Expected items that a found one equals or contains, or the other way, each found one used once, in order."""
    free, n = list(found), 0
    for e in expected:
        hit = next((f for f in free if e == f or e in f or f in e), None)
        if hit is not None:
            free.remove(hit)
            n += 1
    return n


@P.query("memory_prf")
def memory_prf(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of a user's memories against the ones expected: a matching in order, for each user."""
    m = S.memories(spark, d).groupBy("user_id").agg(
        F.sort_array(F.collect_set(F.lower("content"))).alias("found"), F.sort_array(F.collect_set(F.when(F.col("importance") > 100000, F.lower("content")))).alias("expected")
    )

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            hits = [greedy_matches(list(e), list(x)) for e, x in zip(f["expected"], f["found"], strict=True)]
            yield pd.DataFrame({"user_id": f["user_id"], "hits": hits, "precision": [h / max(1, len(x)) for h, x in zip(hits, f["found"], strict=True)], "recall": [h / len(e) if len(e) else 1.0 for h, e in zip(hits, f["expected"], strict=True)]})

    return m.mapInPandas(score, "user_id long, hits long, precision double, recall double")


_KEPT = "CASE WHEN conv_id % 3 = 0 THEN 'Hue' ELSE 'Da Nang' END"


@P.query("conversation_score", f"""WITH g AS (SELECT conv_id, max(CASE WHEN contains(text, 'a') THEN 'hue' ELSE 'DA_NANG' END) AS place, count(*) AS n, list_sort(list_distinct(list(role))) AS roles FROM conversations GROUP BY conv_id),
f AS (SELECT conv_id, (lower(replace(place, '_', ' ')) = lower({_KEPT}))::INT AS a, (n = 4)::INT AS b, len(list_intersect(roles, ['user', 'assistant', 'tool'])) AS h, len(roles) AS m FROM g), q AS (SELECT *, h / m AS p, h / 3 AS r FROM f)
SELECT conv_id, round((a + b + p + r + CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) / 5, 9) AS accuracy, a = 1 AND b = 1 AND p = 1 AND r = 1 AS exact FROM q""")
def conversation_score(spark: SparkSession, d: str) -> DataFrame:
    """A conversation's state against the one expected: scalar fields, and lists by precision, recall and F1."""
    place = F.when(F.contains("text", F.lit("a")), "hue").otherwise("DA_NANG")
    g = S.read(spark, d, "conversations").groupBy("conv_id").agg(F.max(place).alias("place"), F.count(F.lit(1)).alias("n"), F.collect_set("role").alias("roles"))
    x = E.state_score([(F.col("place"), F.expr(_KEPT)), (F.col("n").cast("string"), F.lit("4"))], [(F.col("roles"), F.array(*[F.lit(r) for r in ("user", "assistant", "tool")]))])
    return g.select("conv_id", F.round(x["accuracy"], 9).alias("accuracy"), x["exact"].alias("exact"))


def repaired(text: str | None) -> str | None:
    """UTF-8 that was read as Windows-1252, undone where that leaves fewer marks of it."""
    marks = ("Ã", "Â", "â€", "Ä", "Å")
    if not text or not any(m in text for m in marks):
        return text
    try:
        fixed = text.encode("cp1252").decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return text
    count = lambda t: sum(t.count(m) for m in marks)
    return fixed if count(fixed) < count(text) else text


@P.query("repair_mojibake")
def repair_mojibake(spark: SparkSession, d: str) -> DataFrame:
    """The text spoiled and repaired, and the text itself, which repair leaves as it is."""

    @F.pandas_udf("string")
    def spoil(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t.encode("utf-8").decode("cp1252", "replace") if t else t)

    @F.pandas_udf("string")
    def fix(s: pd.Series) -> pd.Series:
        return s.map(repaired)

    return S.read(spark, d, "documents").select("doc_id", F.md5(fix(spoil("text"))).alias("fixed"), F.md5(fix("text")).alias("same"))


@P.query("markdown_normalize", "SELECT doc_id, md5(array_to_string(list_filter(string_split(regexp_replace(regexp_replace(text, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '[ \\t]{2,}', ' ', 'g'), chr(10)), lambda x: length(x) - length(replace(x, '|', '')) < 3), chr(10))) AS h FROM documents")
def markdown_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Links become their text, spaces single, lines of three bars and more go."""
    t = F.regexp_replace(F.regexp_replace("text", r"\[([^\]]*)\]\([^)]*\)", "$1"), r"[ \t]{2,}", " ")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.char_length(x) - F.char_length(F.replace(x, F.lit("|"), F.lit(""))) < 3)
    return S.read(spark, d, "documents").select("doc_id", F.md5(F.array_join(lines, "\n")).alias("h"))


@P.query("batch_shape", "SELECT doc_id // 12 AS batch, doc_id AS chunk_index, n_chars AS n FROM documents WHERE (doc_id // 12) % 6 <> 5")
def batch_shape(spark: SparkSession, d: str) -> DataFrame:
    """Items of replies on twelve chunks each, however they are wrapped; one that wasn't asked for is in each."""
    rows = S.read(spark, d, "documents").select(F.floor(F.col("doc_id") / 12).alias("batch"), F.col("doc_id").alias("chunk_index"), F.col("n_chars").alias("n"))
    packs = rows.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "n"))).alias("own"))  # twelve at most
    said = F.to_json(F.concat(F.array(F.struct(F.lit(-1).cast("long").alias("chunk_index"), F.lit(0).cast("long").alias("n"))), F.col("own")))
    under = lambda name: F.concat(F.lit(f'{{"{name}": '), said, F.lit("}"))
    shapes = [under("items"), under("results"), said, F.concat(F.lit("Here they are: "), under("chunks"), F.lit(" That is all.")), F.concat(F.lit("```json\n"), said, F.lit("\n```")), F.lit("no reply")]
    reply = F.element_at(F.array(*shapes), (F.col("batch") % 6 + 1).cast("int"))
    batches = packs.select("batch", F.transform("own", lambda x: x["chunk_index"]).alias("asked"), reply.alias("reply"))
    return replies.assigned_items(batches, "batch", "asked", "reply", "chunk_index bigint, n bigint", "chunk_index")


@P.query("constraint_shape", "SELECT event_id, string_agg(k || '=' || v, ',' ORDER BY k) AS constraints FROM (SELECT event_id, unnest(json_keys(props)) AS k, json_extract_string(props, '$.k') AS v FROM events) GROUP BY event_id")
def constraint_shape(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.map_entries(F.from_json("props", "map<string,string>"))
    text = F.array_join(F.sort_array(F.transform(pairs, lambda p: F.concat(p["key"], F.lit("="), p["value"]))), ",")
    return S.read(spark, d, "events").select("event_id", text.alias("constraints"))


#: Robots files of hosts, by the length of their names: a fifth of the hosts have none.
_FILE = """CASE WHEN length(host) % 5 = 0 THEN NULL WHEN length(host) % 2 = 0 THEN '# all' || chr(10) || 'User-agent: *' || chr(10) || 'Disallow: /fr/' || chr(10) || 'Allow: /fr/8'
ELSE 'User-agent: other' || chr(10) || 'Disallow: /' || chr(10) || chr(10) || 'User-Agent: *' || chr(10) || 'Disallow: /*?page=' || chr(10) || 'Disallow:' END"""
_PARTS = "SELECT status, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^#]*)', 1) AS path FROM "


@P.query("useful_page_stats", f"""SELECT status, count(*) AS n, count(*) FILTER (WHERE may IS NULL) AS unknown_robots, count(*) FILTER (WHERE NOT may) AS forbidden FROM (SELECT status, CASE WHEN length(host) % 5 = 0 THEN NULL
WHEN length(host) % 2 = 0 THEN NOT starts_with(path, '/fr/') OR starts_with(path, '/fr/8') ELSE NOT contains(path, '?page=') END AS may FROM ({_PARTS}{QU})) GROUP BY status""")
def useful_page_stats(spark: SparkSession, d: str) -> DataFrame:
    """Pages by status, with those that the robots files of their hosts forbid, and those of hosts without a file."""
    queue = S.queue(spark, d).select("status", "url")
    hosts = queue.select(F.lower(F.regexp_extract("url", "^[A-Za-z]+://([^/?#]*)", 1)).alias("host")).distinct()
    told = robots.with_robots(queue, "url", robots.robots_table(hosts.select("host", F.expr(_FILE).alias("file")), "host", "file"), "quill")
    return told.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("may_fetch").isNull()).alias("unknown_robots"), F.count_if(~F.col("may_fetch")).alias("forbidden"))


def pdf_files(spark: SparkSession, d: str) -> DataFrame:
    """A PDF of two pages for each item of the benchmark; every fifth is none."""
    plain = F.regexp_replace("text", r"[^A-Za-z0-9 ,.]", "")
    stream = lambda t: F.concat(F.lit("<< >>\nstream\nBT /F1 12 Tf ("), t, F.lit(") Tj ET\nendstream"))
    parts = [F.lit("1 0 obj << /Type /Page /Contents 3 0 R >> endobj\n2 0 obj << /Type /Page /Contents [4 0 R] >> endobj\n3 0 obj "), stream(plain), F.lit(" endobj\n4 0 obj "), stream(F.upper(plain)), F.lit(" endobj\n%%EOF")]
    head = F.when(F.col("item_id") % 5 == 4, "%TXT-1\n").otherwise("%PDF-1.4\n")
    return S.read(spark, d, "benchmark").select("item_id", F.encode(F.concat(head, *parts), "UTF-8").alias("content"))


_PLAIN = "trim(regexp_replace(text, '[^A-Za-z0-9 ,.]', '', 'g'))"


@P.query("pdf_pages", f"SELECT item_id, page::INT AS page, CASE page WHEN 1 THEN md5({_PLAIN}) WHEN 2 THEN md5(upper({_PLAIN})) END AS h, CASE WHEN item_id % 5 = 4 THEN 'not a PDF' END AS reason FROM (SELECT *, unnest(CASE WHEN item_id % 5 = 4 THEN [NULL] ELSE [1, 2] END) AS page FROM benchmark)")
def pdf_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of PDF files; what isn't one gives its reason."""
    return pdf.pdf_pages(pdf_files(spark, d), "item_id", "content").select("item_id", "page", F.md5("text").alias("h"), "reason")


@P.query("pdf_convert", f"SELECT item_id, md5('## Page 1' || chr(10) || chr(10) || {_PLAIN} || chr(10) || chr(10) || '## Page 2' || chr(10) || chr(10) || upper({_PLAIN})) AS h FROM benchmark WHERE item_id % 5 <> 4")
def pdf_convert(spark: SparkSession, d: str) -> DataFrame:
    """Files as Markdown, a section for each page, by a converter of the register."""
    return pdf.sections(pdf.pdf_pages(pdf_files(spark, d), "item_id", "content", "text"), "item_id").select("item_id", F.md5("markdown").alias("h"))


def _offline_model() -> providers.Provider:
    """The stand-in of a language model: what a judge or a router would reply, by the prompt's length."""
    return lambda prompts: [f'{{"category": "travel", "grade": {len(p) % 5}}}' if len(p) % 7 else "no reply" for p in prompts]


@P.query("llm_completion", "SELECT conv_id, turn, role, 'judge' AS stage, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')) AS tokens_in, CASE WHEN length(text) % 7 > 0 THEN 4 ELSE 2 END AS tokens_out, round((len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')) * 0.15e0 + CASE WHEN length(text) % 7 > 0 THEN 4 ELSE 2 END * 0.6e0) / 1e6, 10) AS cost, NULL AS error FROM conversations")
def llm_completion(spark: SparkSession, d: str) -> DataFrame:
    """Calls of a language model with their telemetry."""
    t = S.read(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return providers.replies(t, "text", _offline_model, "judge", 0.15, 0.6).select("conv_id", "turn", "role", "stage", "tokens_in", "tokens_out", F.round("cost", 10).alias("cost"), "error")


@P.query("judge_grades", "SELECT conv_id, turn, role, CASE WHEN length(text) % 7 > 0 AND length(text) % 5 <= 3 THEN length(text) % 5 END::INT AS grade, CASE WHEN length(text) % 7 = 0 THEN 'no JSON' WHEN length(text) % 5 > 3 THEN 'out of range' END AS problem FROM conversations")
def judge_grades(spark: SparkSession, d: str) -> DataFrame:
    """A judge's grades from 0 to 3; a reply that holds none is named, not dropped."""
    t = S.read(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    judged = providers.replies(t, "text", _offline_model, "judge", 0.15, 0.6).withColumn("json", T.json_in(F.col("reply")))
    grade = F.get_json_object("json", "$.grade").try_cast("int")
    problem = F.coalesce("error", F.when(F.col("json").isNull(), "no JSON"), F.when(~F.coalesce(grade.between(0, 3), F.lit(False)), "out of range"))
    return judged.select("conv_id", "turn", "role", F.when(grade.between(0, 3), grade).alias("grade"), problem.alias("problem"))


@P.query("metadata_batches", "SELECT doc_id, source, i // 12 AS batch, CASE WHEN (i // 12) % 5 = 4 THEN NULL ELSE length(text) END AS n, CASE WHEN (i // 12) % 5 = 4 THEN 'RuntimeError: no model' END AS error FROM (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents)")
def metadata_batches(spark: SparkSession, d: str) -> DataFrame:
    """Chunks enriched a dozen at a time; a batch that fails keeps its rows, with the reason."""
    rows = numbered(S.read(spark, d, "documents").select("doc_id", "source", "text"), ["source"], [F.col("doc_id")], "i").withColumn("batch", F.floor((F.col("i") - 1) / 12))
    packs = rows.groupBy("source", "batch").agg(F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("items"))  # twelve at most

    def extractor() -> providers.Provider:
        def extract(batches: list) -> list:
            if any(b["batch"] % 5 == 4 for b in batches):
                raise RuntimeError("no model")
            return [[len(x["text"]) for x in b["items"]] for b in batches]

        return extract

    asked = packs.withColumn("pack", F.struct("batch", "items"))
    made = providers.provided(asked, "pack", "found", "array<bigint>", extractor, batch=1, sleep=lambda s: None)
    each = made.select("source", "batch", "found", "found_error", F.posexplode("items").alias("at", "item"))
    return each.select("item.doc_id", "source", "batch", F.get("found", F.col("at")).alias("n"), F.col("found_error").alias("error"))


@P.query("provider_ledger", "SELECT conv_id, turn, role, CASE WHEN length(text) % 11 > 0 THEN length(text) || ':' || left(text, 5) END AS reply, CASE WHEN length(text) % 11 = 0 THEN 'ValueError: no answer' END AS error FROM conversations")
def provider_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Replies through a ledger, in two runs: the second sends what the first one's half of the turns lacked, and no more.
    Inputs that the provider fails on are halved out of their batches."""

    def factory() -> providers.Provider:
        def ask(texts: list) -> list:
            if any(len(t) % 11 == 0 for t in texts):
                raise ValueError("no answer")
            return [f"{len(t)}:{t[:5]}" for t in texts]

        return ask

    book = ledger.Ledger(spark, scratch.new_path(spark, "ledger"))
    turns = S.read(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    book.ask(turns.filter("turn % 2 = 0"), "text", "reply", factory, "offline")
    return book.ask(turns, "text", "reply", factory, "offline").select("conv_id", "turn", "role", "reply", F.col("reply_error").alias("error"))


@P.query("run_telemetry", """SELECT 'read' AS stage, 'rows' AS metric, count(*)::DOUBLE AS value FROM documents UNION ALL SELECT 'read', 'chars', sum(n_chars)::DOUBLE FROM documents
UNION ALL SELECT 'long', 'rows', count(*)::DOUBLE FROM documents WHERE n_chars > 200 UNION ALL SELECT 'distinct', 'rows', count(DISTINCT text)::DOUBLE FROM documents WHERE n_chars > 200""")
def run_telemetry(spark: SparkSession, d: str) -> DataFrame:
    """What the stages of a run did, as Spark counted it while the run was written."""
    seen = telemetry.Telemetry(spark)
    read = seen.stage(S.read(spark, d, "documents").select("doc_id", "text", "n_chars"), "read", chars=F.col("n_chars"))
    long = seen.stage(read.filter("n_chars > 200"), "long")
    once = seen.stage(long.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id"), "distinct")
    once.write.parquet(scratch.new_path(spark, "run"))
    return seen.events().select("stage", "metric", "value")
