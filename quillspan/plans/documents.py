"""Text pipeline: cleaning, splitting, hashing, dedup and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import language as L
from ..operators import markdown as M
from ..operators import pages as G
from ..operators import text_ops as X
from ..operators.filters import noise_chunk
from ..operators.numbering import carried, numbered
from ..sources import tables as S
from ..sources.scratch import stored
from .kit import Plans

P = Plans()
CH = S.CHUNKS
_SP = "[ \\t\\n\\x0b\\f\\r]+"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return S.read(spark, d, "documents")


#: Text as a converter leaves it: marks around the documents' own.
_NOISY = r"""'##Title of ' || source || chr(13) || chr(10) || '**==> picture [1 x 2] <==**' || chr(10) || '**Bold &amp; Line**' || chr(10) || '----- Start of picture text -----' || chr(10) || left(text, 120) || chr(10) || '----- End of picture text -----' || chr(10) || text || chr(10) || '3 Name of it' || chr(10) || '<b>tag</b> *it* snake_case_x  ~~no~~ ,' || chr(10) || '• item'"""


@P.query("clean_markdown")
def clean_markdown(spark: SparkSession, d: str) -> DataFrame:
    noisy = docs(spark, d).select("doc_id", F.expr(_NOISY).alias("markdown"))
    return M.cleaned(noisy, "markdown").select("doc_id", F.md5("markdown").alias("cleaned"))


@P.query("picture_blocks", r"""WITH f AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(left(text, 40 + doc_id % 400) || ' .', chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS body FROM documents),
g AS (SELECT *, trim(regexp_replace(body, '[ \t\n\x0b\f\r]+', ' ', 'g')) AS flat FROM f)
SELECT doc_id, md5('intro' || CASE WHEN length(flat) >= 80 AND length(regexp_replace(flat, '[^\pL]', '', 'g')) / length(flat) >= 0.35 THEN chr(10) || chr(10) || '### Image OCR Text' || chr(10) || chr(10) || body || chr(10) || chr(10) ELSE chr(10) END || 'end') AS block FROM g""")
def picture_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Text read from pictures stays, under a heading, if it is long enough and mostly letters."""
    marked = F.concat(F.lit("intro\n**----- Start of picture text -----**\n"), F.expr("left(text, cast(40 + doc_id % 400 as int)) || ' .'"), F.lit("\n--- END OF PICTURE TEXT ---\nend"))
    return docs(spark, d).select("doc_id", F.md5(M.picture_blocks(marked)).alias("block"))


@P.query("repeated_lines", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), c AS (SELECT *, trim(line) AS bare, count(*) OVER (PARTITION BY doc_id, trim(line)) AS n FROM l), k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS t FROM c WHERE bare = '' OR regexp_matches(bare, '^(#|- |[0-9]+\\.)') OR length(bare) > 80 OR n < 3 GROUP BY doc_id) SELECT d.doc_id, md5(coalesce(t, '')) AS kept FROM documents d LEFT JOIN k USING (doc_id)")
def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.md5(M.without_repeated_lines(F.col("text"))).alias("kept"))


@P.query("word_count", f"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '{_SP}'), lambda t: t <> '')) AS n_words, length(text) AS n FROM documents")
def word_count(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_words"), F.char_length("text").cast("long").alias("n"))


@P.query("sha256_text", f"SELECT doc_id, sha256(text) AS chunk_hash, md5(trim(regexp_replace(lower(text), '{_SP}', ' ', 'g'))) AS norm_hash FROM documents")
def sha256_text(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.sha2("text", 256).alias("chunk_hash"), T.normal_hash(F.col("text")).alias("norm_hash"))


@P.query("dedup_chunk_hash", "SELECT sha256(text) AS chunk_hash, min(doc_id) AS first, max(doc_id) AS last, count(*) AS n FROM documents GROUP BY 1")
def dedup_chunk_hash(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk once: at its first place, with its last value."""
    return docs(spark, d).groupBy(F.sha2("text", 256).alias("chunk_hash")).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))


@P.query("dedup_norm_hash", f"SELECT min(doc_id) AS doc_id, md5(trim(regexp_replace(lower(text), '{_SP}', ' ', 'g'))) AS norm_hash FROM documents GROUP BY 2")
def dedup_norm_hash(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).groupBy(T.normal_hash(F.col("text")).alias("norm_hash")).agg(F.min("doc_id").alias("doc_id"))


@P.query("word_windows", f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{_SP}'), lambda t: t <> '') AS ws FROM documents), s AS (SELECT doc_id, ws, unnest(range(0, greatest(0, ceil((len(ws) - 180) / 140)::BIGINT * 140) + 1, 140)) AS s FROM w WHERE len(ws) > 0)
SELECT doc_id, (s // 140)::INT AS position, md5(array_to_string(ws[s + 1:s + 180], ' ')) AS h FROM s""")
def word_windows(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.posexplode(X.word_windows(F.col("text"))).alias("position", "w")).select("doc_id", "position", F.md5("w").alias("h"))


@P.query("header_split")
def header_split(spark: SparkSession, d: str) -> DataFrame:
    return X.header_sections(G.pages_to_markdown(S.read(spark, d, "pages"), "page_id", "html", "url"), "page_id", "markdown").select("page_id", "section", "h1", "h2", F.char_length("body").alias("n"))


@P.query("heading_context")
def heading_context(spark: SparkSession, d: str) -> DataFrame:
    s = X.header_sections(G.pages_to_markdown(S.read(spark, d, "pages"), "page_id", "html", "url"), "page_id", "markdown")
    return X.with_heading_context(s).select("page_id", "section", "section_heading", F.md5("chunk_text").alias("h"))


@P.query("recursive_split")
def recursive_split(spark: SparkSession, d: str) -> DataFrame:
    return X.chunked(docs(spark, d), "doc_id", "text").select("doc_id", "chunk_index", F.char_length("chunk_text").alias("n"), F.sha2("chunk_text", 256).alias("chunk_hash"))


@P.query("short_merge")
def short_merge(spark: SparkSession, d: str) -> DataFrame:
    """Lines as pieces, four to a section, short ones merged."""
    lines = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("head", F.expr("pos div 4"))
    return X.merge_short(lines, "doc_id", "pos", "line", "head", noise=noise_chunk).select("doc_id", "position", F.char_length("line").alias("n"))


@P.query("html_to_markdown_rules")
def html_to_markdown_rules(spark: SparkSession, d: str) -> DataFrame:
    m = G.pages_to_markdown(S.read(spark, d, "pages"), "page_id", "html", "url")
    return m.select("page_id", F.char_length("markdown").alias("n"), F.md5("markdown").alias("h"))


@P.query("html_strategies")
def html_strategies(spark: SparkSession, d: str) -> DataFrame:
    """Every converter of the register on every page."""
    pages, out = S.read(spark, d, "pages"), None
    for name in sorted(G.CONVERTERS):
        made = G.pages_to_markdown(pages, "page_id", "html", "url", name).select("page_id", F.lit(name).alias("converter"), F.char_length("markdown").alias("n"), F.md5("markdown").alias("h"))
        out = made if out is None else out.unionByName(made)
    return out


@P.query("extract_title", "SELECT page_id, left(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), 300) AS title FROM pages")
def extract_title(spark: SparkSession, d: str) -> DataFrame:
    return S.read(spark, d, "pages").select("page_id", F.substring(F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)), 1, 300).alias("title"))


_BARE = "regexp_replace(url, '[?#].*$', '')"
_NORM = f"lower(regexp_extract({_BARE}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || regexp_replace(lower(regexp_extract({_BARE}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)', 1)), '^www\\.', '') || regexp_replace(regexp_replace(regexp_extract({_BARE}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(.*)$', 1), '/+', '/', 'g'), '/$', '')"


@P.query("normalize_url", f"SELECT page_id, {_NORM} AS url FROM pages")
def normalize_url(spark: SparkSession, d: str) -> DataFrame:
    return S.read(spark, d, "pages").select("page_id", T.normal_url(F.col("url")).alias("url"))


_LINK = "CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link WHEN starts_with(link, '//') THEN 'https:' || link WHEN starts_with(link, '/') THEN regexp_extract(base, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') || link WHEN regexp_matches(link, '^[?#]') THEN regexp_replace(base, '[?#].*$', '') || link ELSE regexp_replace(regexp_replace(base, '[?#].*$', ''), '([^/:])/[^/]*$', '\\1') || '/' || link END"


@P.query("extract_links", f"""WITH l AS (SELECT page_id, url AS base, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]+)"', 1)) AS link FROM pages), a AS (SELECT page_id, {_LINK} AS url FROM l WHERE NOT regexp_matches(link, '^(?i:mailto:|tel:|javascript:|data:)')),
n AS (SELECT page_id, {_NORM} AS url FROM a WHERE regexp_matches(url, '^(?i:https?)://[^/?#]'))
SELECT page_id, url, count(*) AS n FROM n WHERE NOT regexp_matches(url, '\\.(jpg|jpeg|png|gif|pdf|zip|css|js)$') GROUP BY ALL""")
def extract_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of a page: absolute, normalised, those to pages."""
    links = S.read(spark, d, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="([^"]+)"'), F.lit(1))).alias("link"))
    told = links.filter(~F.col("link").rlike(r"^(?i:mailto:|tel:|javascript:|data:)")).select("page_id", T.absolute_url(F.col("url"), F.col("link")).alias("url"))
    kept = told.filter(F.col("url").rlike(r"^(?i:https?)://[^/?#]")).select("page_id", T.normal_url(F.col("url")).alias("url"))
    return kept.filter(~F.col("url").rlike(r"\.(jpg|jpeg|png|gif|pdf|zip|css|js)$")).groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("n"))


@P.query("source_name", "SELECT page_id, coalesce(nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), ''), nullif(list_extract(string_split(url, '/'), -1), ''), 'Unknown source') AS name FROM pages")
def source_name(spark: SparkSession, d: str) -> DataFrame:
    name = F.coalesce(F.nullif(T.host_of(F.col("url")), F.lit("")), F.nullif(F.element_at(F.split("url", "/"), -1), F.lit("")), F.lit("Unknown source"))
    return S.read(spark, d, "pages").select("page_id", name.alias("name"))


@P.query("canonical_text", f"SELECT conv_id, turn, role, md5(trim(regexp_replace(replace(lower(text), '_', ' '), '{_SP}', ' ', 'g'))) AS canonical FROM conversations")
def canonical_text(spark: SparkSession, d: str) -> DataFrame:
    return S.read(spark, d, "conversations").select("conv_id", "turn", "role", F.md5(T.canonical(F.col("text"))).alias("canonical"))


_PLACE = "source || ' Thành phố Đà Nẵng ' || lang || ' Huế-' || doc_id % 7 || ' Straße ' || left(text, 5)"


@P.query("location_key", f"SELECT doc_id, regexp_replace(replace(replace(strip_accents(lower({_PLACE})), 'đ', 'd'), 'ß', 'ss'), '[^\\pL\\pN]', '', 'g') AS key FROM documents")
def location_key(spark: SparkSession, d: str) -> DataFrame:
    """The key of a place name: letters and digits without accents, in any script."""
    return docs(spark, d).select("doc_id", T.location_key(F.expr(_PLACE)).alias("key"))


@P.query("truncate_text", "SELECT doc_id, CASE WHEN length(text) <= 500 THEN length(text) WHEN length(regexp_extract(left(text, 500), '(?s)^.*[.!?]')) > 250 THEN length(regexp_extract(left(text, 500), '(?s)^.*[.!?]')) ELSE 500 END AS n FROM documents")
def truncate_text(spark: SparkSession, d: str) -> DataFrame:
    """A text's head, cut at its last sentence end if that is past the middle."""
    head = F.substring("text", 1, 500)
    cut = F.regexp_extract(head, r"(?s)^.*[.!?]", 0)
    short = F.when(F.char_length("text") <= 500, F.col("text")).when(F.char_length(cut) > 250, cut).otherwise(head)
    return docs(spark, d).select("doc_id", F.char_length(short).cast("long").alias("n"))


@P.query("geocode_query", "SELECT c_custkey, array_to_string(list_filter([c_name, c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'Vietnam' END], lambda x: x IS NOT NULL AND x <> ''), ', ') AS query FROM customer")
def geocode_query(spark: SparkSession, d: str) -> DataFrame:
    parts = F.array("c_name", "c_mktsegment", F.when(F.col("c_custkey") % 2 != 0, "Vietnam"))
    return S.read(spark, d, "customer").select("c_custkey", F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), ", ").alias("query"))


_SAID = "CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN 'noise ' || props || ' tail' WHEN 2 THEN chr(96) || chr(96) || chr(96) || 'json' || chr(10) || props || chr(10) || chr(96) || chr(96) || chr(96) ELSE 'none' END"


@P.query("json_from_text", "SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, event_id % 4 <> 3 AS found FROM events")
def json_from_text(spark: SparkSession, d: str) -> DataFrame:
    """The object that a model's reply is or holds, with or without a fence around it."""
    found = S.read(spark, d, "events").select("event_id", T.json_in(F.expr(_SAID)).alias("j"))
    return found.select("event_id", F.get_json_object("j", "$.k").cast("long").alias("k"), F.col("j").isNotNull().alias("found"))


@P.query("doc_text", "SELECT doc_id, md5(concat_ws(chr(10), 'Place: ' || nullif(source, 'src3'), lang, text)) AS h FROM documents")
def doc_text(spark: SparkSession, d: str) -> DataFrame:
    place = F.concat(F.lit("Place: "), F.nullif("source", F.lit("src3")))
    return docs(spark, d).select("doc_id", F.md5(F.concat_ws("\n", place, "lang", "text")).alias("h"))


@P.query("evidence_ids", "SELECT doc_id, 'E' || row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS evidence_id FROM documents")
def evidence_ids(spark: SparkSession, d: str) -> DataFrame:
    n = numbered(docs(spark, d).select("doc_id", "source", "lang"), ["source", "lang"], [F.col("doc_id")], "n")
    return n.select("doc_id", F.concat(F.lit("E"), "n").alias("evidence_id"))


@P.query("date_range", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 AS INTEGER) AS VARCHAR) AS end_date, o_orderkey % 9 + 1 AS duration FROM orders")
def date_range(spark: SparkSession, d: str) -> DataFrame:
    days = (F.col("o_orderkey") % 9 + 1).cast("int")
    start = F.to_date("o_orderdate")
    end = F.date_add(start, days - 1)
    return S.read(spark, d, "orders").select("o_orderkey", end.cast("string").alias("end_date"), (F.datediff(end, start) + 1).cast("long").alias("duration"))


@P.query("safe_list", "SELECT event_id, coalesce(try_cast(CASE WHEN event_id % 3 = 0 THEN 'x' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE), 0) AS v, regexp_replace(event_type || ' #' || event_id, '[^A-Za-z0-9]+', '_', 'g') AS name FROM events")
def safe_list(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, "x").otherwise(F.col("event_id").cast("string"))
    name = F.regexp_replace(F.concat("event_type", F.lit(" #"), "event_id"), "[^A-Za-z0-9]+", "_")
    return S.read(spark, d, "events").select("event_id", F.coalesce(raw.try_cast("double"), F.lit(0.0)).alias("v"), name.alias("name"))


@P.query("fallback_metadata", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'Vietnam' ELSE 'known' END AS country, CASE WHEN l.doc_id IS NULL THEN left(text, 300) ELSE '' END AS summary, CASE WHEN l.doc_id IS NULL THEN 0.0 ELSE 1.0 END AS confidence, CASE WHEN l.doc_id IS NULL THEN 'no label' END AS reasoning, 0 AS n_tags FROM documents d LEFT JOIN labels l USING (doc_id)")
def fallback_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Where no enrichment came: the default country, the text's head as summary, no tags, no confidence, and the reason."""
    l = S.read(spark, d, "labels").select("doc_id", F.lit("known").alias("country"))  # noqa: E741
    j = docs(spark, d).select("doc_id", "text").join(l, "doc_id", "left")
    m = X.fallback_metadata(F.col("text"), F.lit("no label"), "Vietnam")
    none = F.col("country").isNull()
    return j.select("doc_id", F.coalesce("country", m["country"]).alias("country"), F.when(none, m["summary"]).otherwise("").alias("summary"), F.when(none, m["confidence"]).otherwise(1.0).alias("confidence"), F.when(none, m["reasoning"]).alias("reasoning"), F.size(m["tags"]).alias("n_tags"))


_WS = f"list_filter(regexp_split_to_array(text, '{_SP}'), lambda t: t <> '')"


@P.query("metadata_limits", f"SELECT doc_id, array_to_string(list_transform({_WS}[1:8], lambda t: left(t, 40)), ',') AS tags, array_to_string(list_transform({_WS}[1:4], lambda t: left(t, 40)), ',') AS styles, length(left(text, 300)) AS summary, length(left(text, 250)) AS reasoning, greatest(0.0, least(1.0, n_chars / 1e4 - 0.01)) AS confidence FROM documents")
def metadata_limits(spark: SparkSession, d: str) -> DataFrame:
    """An enrichment's limits: tags, styles, labels, summary, reasoning and confidence."""
    words = T.tokens(F.col("text"))
    m = X.limited_metadata(tags=words, styles=words, summary=F.col("text"), reasoning=F.col("text"), confidence=F.col("n_chars") / 1e4 - 0.01)
    return docs(spark, d).select("doc_id", F.array_join(m["tags"], ",").alias("tags"), F.array_join(m["styles"], ",").alias("styles"), F.char_length(m["summary"]).cast("long").alias("summary"), F.char_length(m["reasoning"]).cast("long").alias("reasoning"), m["confidence"].alias("confidence"))


@P.query("merge_unique", "WITH u AS (SELECT source, lang AS task, doc_id % 97 AS id, dense_rank() OVER (PARTITION BY source ORDER BY lang) * 100000 + row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS seq FROM documents), f AS (SELECT source, id, min(seq) AS seq, string_agg(DISTINCT task, ',' ORDER BY task) AS tasks FROM u GROUP BY source, id) SELECT source, id, tasks, row_number() OVER (PARTITION BY source ORDER BY seq) AS position FROM f")
def merge_unique(spark: SparkSession, d: str) -> DataFrame:
    """Groups of results in order, the first occurrence of an id counts; its place there is its rank."""
    x = docs(spark, d).select("source", F.col("lang").alias("task"), (F.col("doc_id") % 97).alias("id"), "doc_id")
    f = x.withColumn("seq", F.struct("task", "doc_id")).groupBy("source", "id").agg(F.min("seq").alias("seq"), F.array_join(F.sort_array(F.collect_set("task")), ",").alias("tasks"))
    return numbered(f, ["source"], [F.col("seq")], "position").select("source", "id", "tasks", "position")


_BLOCKS = r"""WITH b AS (SELECT doc_id, pos, trim(block, ' ' || chr(9) || chr(10) || chr(13)) AS block FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS block, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
k AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(block), '\[[^\]]+\]\([^)]+\)', '', 'g'), '[^a-z0-9à-ỹ\s]', ' ', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS key FROM b WHERE block <> ''),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, CASE WHEN length(key) > 180 THEN 'long ' || left(key, 180) ELSE 'short ' || key END ORDER BY pos) AS turn FROM k),
j AS (SELECT doc_id, string_agg(block, chr(10) || chr(10) ORDER BY pos) AS t FROM f WHERE key <> '' AND (turn = 1 OR starts_with(block, '#')) GROUP BY doc_id)
SELECT d.doc_id, length(coalesce(t, '')) AS n, md5(coalesce(t, '')) AS h FROM documents d LEFT JOIN j USING (doc_id)"""


@P.query("dedup_blocks", _BLOCKS)
def dedup_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Lines as blocks, each once, and once for each start of 180 characters."""
    kept = M.deduplicated_blocks(F.regexp_replace(F.col("text"), "\n", "\n\n"))
    return docs(spark, d).select("doc_id", F.char_length(kept).alias("n"), F.md5(kept).alias("h"))


@P.query("ordered_distinct", "SELECT doc_id, array_to_string(list_transform(list_sort(list_distinct(list_transform([lang, source, lang, 'x'], lambda v: list_position([lang, source, lang, 'x'], v)))), lambda i: [lang, source, lang, 'x'][i]), ',') AS v FROM documents")
def ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.array_join(F.array_distinct(F.array("lang", "source", "lang", F.lit("x"))), ",").alias("v"))


@P.query("normalize_list", "SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_transform([o_orderpriority, 'Sea-Food', o_orderstatus], lambda v: CASE lower(trim(v)) WHEN 'sea-food' THEN 'seafood' ELSE lower(trim(v)) END))), ',') AS v FROM orders")
def normalize_list(spark: SparkSession, d: str) -> DataFrame:
    """Lower case, trimmed, synonyms replaced, sorted, each once."""
    low = lambda v: F.lower(F.trim(v))
    values = F.transform(F.array("o_orderpriority", F.lit("Sea-Food"), "o_orderstatus"), lambda v: F.when(low(v) == "sea-food", "seafood").otherwise(low(v)))
    return S.read(spark, d, "orders").select("o_orderkey", F.array_join(F.sort_array(F.array_distinct(values)), ",").alias("v"))


@P.query("new_minus_old", "SELECT l_partkey AS id FROM lineitem WHERE l_quantity > 45 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity < 10")
def new_minus_old(spark: SparkSession, d: str) -> DataFrame:
    x = S.read(spark, d, "lineitem")
    return x.filter("l_quantity > 45").select(F.col("l_partkey").alias("id")).subtract(x.filter("l_quantity < 10").select("l_partkey"))


@P.query("rank_lists", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem")
def rank_lists(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    return S.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("rank"))


@P.query("carry_forward", f"SELECT chunk_id, lag(place_type) OVER w AS previous, last_value(place_type IGNORE NULLS) OVER (PARTITION BY city, country ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM {CH} WINDOW w AS (PARTITION BY city, country ORDER BY chunk_id)")
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    c = S.chunks(spark, d).select("chunk_id", "city", "country", "place_type")
    return carried(c, ["city", "country"], ["chunk_id"], "place_type").select("chunk_id", "previous", "known")


@P.query("batch_items", "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT doc_id, source, CASE WHEN n > 12 AND n % 12 > 0 AND n % 12 < 4 AND i // 12 = n // 12 THEN i // 12 - 1 ELSE i // 12 END AS batch FROM r")
def batch_items(spark: SparkSession, d: str) -> DataFrame:
    """Batches of twelve; a last one of under four joins the one before."""
    r = numbered(docs(spark, d).select("doc_id", "source"), ["source"], [F.col("doc_id")], "i", "n").withColumn("i", F.col("i") - 1)
    b = F.floor(F.col("i") / 12)
    last = (F.col("n") > 12) & (F.col("n") % 12 > 0) & (F.col("n") % 12 < 4) & (b == F.floor(F.col("n") / 12))
    return r.select("doc_id", "source", F.when(last, b - 1).otherwise(b).alias("batch"))


@P.query("page_language")
def page_language(spark: SparkSession, d: str) -> DataFrame:
    """The language of each document, by counts of the others' labels, all of them: two halves judge one another."""
    rows = docs(spark, d).select("doc_id", "text", "lang", (F.crc32(F.col("doc_id").cast("string")) % 2).alias("half"))
    parts = []
    for half in (0, 1):
        counts = stored(L.run_counts(rows.filter(F.col("half") != half), "text", "lang"), "languages")
        parts.append(L.told(rows.filter(F.col("half") == half), "doc_id", "text", counts))
    return parts[0].unionByName(parts[1]).select("doc_id", "language")
