"""The engine's tables, bound to the Parquet tables at hand.

Bindings are SQL expressions that Spark and other engines read alike; queries use them through these functions, checks
through the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CHUNK = {
    "chunk_id": "doc_id", "document_id": "doc_id % 300", "chunk_text": "text", "city": "source", "country": "lang",
    "province": "CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'North' WHEN 2 THEN 'South' WHEN 3 THEN 'East_A' WHEN 4 THEN 'EastBA' ELSE 'West' END",
    "place_type": "CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'museum' WHEN 2 THEN 'beach' WHEN 3 THEN 'restaurant' ELSE 'hotel' END",
    "latitude": "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 1e1 + (doc_id % 900) * 1e-2 END",
    "longitude": "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 1.02e2 + (doc_id % 700) * 1e-2 END",
    "chunk_index": "doc_id % 17", "n_chars": "n_chars",
}
QUEUE = {
    "url_id": "page_id", "url": "url", "added": "(page_id * 7919) % 1009", "document_id": "CASE WHEN page_id % 4 = 2 THEN page_id END",
    "status": "CASE page_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' ELSE 'failed' END",
}
MEMORY = {
    "memory_id": "o_orderkey", "user_id": "o_custkey", "importance": "o_totalprice", "seq": "o_orderkey",
    "memory_type": "CASE o_orderkey % 5 WHEN 0 THEN 'budget' WHEN 1 THEN 'tone' WHEN 2 THEN 'interest' WHEN 3 THEN 'avoid' ELSE 'style' END",
    "content": "o_orderpriority", "is_active": "o_orderstatus <> 'F'",
}
CASE = {
    "case_id": "doc_id", "intent": "lang", "user_id": "source", "ndcg": "(doc_id % 101) * 1e-2", "precision": "(doc_id % 6) * 2e-1",
    "correctness": "1e0 + doc_id % 5", "coverage": "(doc_id % 11) * 1e-1", "missing": "doc_id % 4",
}


#: Rows, and bytes of them but for one row that has more, that a Python task is given at a time, and so holds with what it
#: makes of them; a session may ask for fewer.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_BOUNDS = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; the session's batches for Python are bounded from then on."""
    for key, most in _BOUNDS.items():
        asked = spark.conf.get(key, None) or "0"
        if not (asked.isdigit() and 0 < int(asked) <= most):
            spark.conf.set(key, str(most))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def sql(columns: dict[str, str], table: str) -> str:
    return f"(SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {table})"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(read(spark, sf_dir, "documents"), CHUNK)


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(read(spark, sf_dir, "pages"), QUEUE)


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(read(spark, sf_dir, "orders"), MEMORY)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(read(spark, sf_dir, "documents"), CASE)


#: What travellers ask, by turn, after the conversations' own text.
PHRASES = (
    "My trip is ending in Hoi An after the beach.", "Where should I stay for the final three nights?", "Is Hue cheap, not a luxury place?", "We travel alone from Hue City to the south of Vietnam.",
    "Compare Da Nang versus Hoi An for food and price.", "What is the weather today in Da Nang?", "The average climate and weather by month, best time to go.", "Avoid luxury hotels in the old town of the wide city, but luxury spas are fine.",
    "I do not want a low-cost hostel, a mid-range hotel please.", "We finish in Hue. Any photography spots?", "Can I stay in a hotel for the last 2 nights?", "Hue Imperial Museum opening hours and ticket price.",
    "Plan 3 days in North Vietnam by train for the family.", "Ending in Da Nang, on my own, in northern vietnam.", "Explain the culture of food, step by step.", "Nothing more, thanks.",
)
CITY_NAMES = ("Hoi An", "Da Nang", "Hue", "Ha Long")
_WHICH = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHRASES))
REQUEST = {
    "conv_id": "conv_id", "turn": "turn", "role": "role", "said": f"text || ' ' || CASE (conv_id * 7 + turn) % {len(PHRASES)} {_WHICH} END",
    "phrase": f"CASE (conv_id * 7 + turn) % {len(PHRASES)} {_WHICH} END", "province": "CASE conv_id % 3 WHEN 0 THEN 'Hue' END",
}

_L = "coalesce(length(text), 17)"


def _given(name: str, when: str, value: str) -> str:
    """A field of a reply, null but when it is given."""
    return f"""'"{name}": ' || CASE WHEN {when} THEN {value} ELSE 'null' END"""


def _named(letter: str, number: str) -> str:
    return f"""'"{letter}' || CAST({number} AS STRING) || '"'"""


#: A model's reply to each turn: what it says of the trip, by the text's length; some are cut short or say what can't be.
_FIELDS = (
    _given("destination", f"{_L} % 3 = 0", _named("d", f"{_L} % 11")), _given("temporary_budget", f"{_L} % 4 = 1", _named("b", f"{_L} % 5")),
    _given("date_from", f"{_L} % 5 = 2", _named("2026-05-1", f"{_L} % 10")), _given("duration_days", f"{_L} % 5 = 2", f"CAST({_L} % 7 AS STRING)"),
    f"""'"selected_places": [' || {_named("p", f"{_L} % 13")} || '], "dropped_selected_places": [' || {_named("p", "turn % 13")} || ']'""",
    f"""'"reset": ' || CASE WHEN {_L} % 29 = 0 THEN 'true' ELSE 'false' END""",
)
UPDATE = {
    "conv_id": "conv_id", "turn": "turn", "role": "role", "h": "md5(text)", "len": _L,
    "reply": "'{' || " + " || ', ' || ".join(_FIELDS) + f" || CASE WHEN {_L} % 17 = 0 THEN '' ELSE '}}' END",
    "valid": f"{_L} % 17 <> 0 AND NOT ({_L} % 5 = 2 AND {_L} % 7 = 0)",
}


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(read(spark, sf_dir, "conversations"), UPDATE)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(read(spark, sf_dir, "conversations"), REQUEST)


REQUESTS, UPDATES = sql(REQUEST, "conversations"), sql(UPDATE, "conversations")
CHUNKS, QUEUES, MEMORIES, CASES = sql(CHUNK, "documents"), sql(QUEUE, "pages"), sql(MEMORY, "orders"), sql(CASE, "documents")
