"""Predicates and filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Intents for which place types are hard filters.
HARD_INTENTS = ("attraction_search", "accommodation_search", "food_search", "event_search")


def metadata(country: str | None = None, cities: list[str] = (), province: str | None = None, place_types: list[str] = ()) -> Column:
    """The conjunction of the given predicates: case doesn't count but for place types. No predicate: all rows."""
    out = F.lit(True)
    if country:
        out &= F.lower("country") == country.lower()
    if cities:
        out &= F.lower("city").isin(*[c.lower() for c in cities])
    if province:
        out &= F.lower("province") == province.lower()
    if place_types:
        out &= F.col("place_type").isin(*place_types)
    return out


def metadata_like(country: str | None = None, cities: list[str] = (), province: str | None = None, place_types: list[str] = ()) -> Column:
    """As metadata(), with country and province as patterns (% and _) of any case."""
    out = metadata(None, cities, None, place_types)
    if country:
        out &= F.col("country").ilike(country)
    if province:
        out &= F.col("province").ilike(province)
    return out


def hard_place_types(intent: Column, place_types: Column) -> Column:
    """Place types as a hard filter, empty for intents that only favour them."""
    return F.when(intent.isin(*HARD_INTENTS), place_types).otherwise(F.array().cast("array<string>"))


def relaxed(queries: DataFrame, rows: DataFrame, strict: Column, loose: Column) -> DataFrame:
    """Rows of each query under strict, or under loose for queries that strict leaves none. Columns of queries keep their
    names; queries is a stated set, joined on loose's equality, and only then split."""
    found = queries.join(rows, loose).withColumn("is_strict", strict)
    any_strict = found.filter("is_strict").select("query_id").distinct().withColumn("has_strict", F.lit(True))
    both = found.join(any_strict, "query_id", "left").withColumn("relaxed", F.col("has_strict").isNull())
    return both.filter(F.col("is_strict") | F.col("relaxed")).drop("has_strict", "is_strict")


def bad_chunk(text: Column, min_chars: int = 120, min_letters: float = 0.35, max_urls: int = 3) -> Column:
    """Too short, too few letters, or max_urls URLs and more."""
    return (F.char_length(text) < min_chars) | (T.letters_ratio(text) < min_letters) | (F.regexp_count(text, F.lit("https?://")) >= max_urls)


def noise_chunk(text: Column) -> Column:
    """All lines are headings, nothing is left without links and markup, or under a quarter are letters."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    headings = F.forall(lines, lambda x: x.rlike(r"^\s*#{1,6}\s"))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"!?\[[^\]]*\]\([^)]*\)", ""), r"https?://\S+", ""), r"[#*_`>|\-\s]", "")
    return headings | (bare == "") | (T.letters_ratio(text) < 0.25)


# What lines of page furniture are, and how they start.
PAGE_LINES = r"^(\d{1,4}|page\s+\d+(\s+of\s+\d+)?|\d+\s*/\s*\d+)$"
FURNITURE = (
    "table of contents$", "contents$", "index$", "references$", "bibliography$", r"copyright\b", r"all rights reserved\b", r"printed in\b", r"downloaded from\b", r"source:\s*$",
    r"website:\s*$", r"email:\s*$", r"tel:\s*$", r"phone:\s*$", r"fax:\s*$", r"follow us\b", r"visit us\b", r"click here\b", "back to top$",
)
FURNITURE_LINES = f"^({'|'.join(FURNITURE)})"


def useless_line(line: Column) -> Column:
    """Page numbers, furniture, and lines of at most 40 characters that are mostly symbols; headings and lists are safe."""
    t = F.trim(line)
    low = F.lower(t)
    symbols = F.char_length(F.regexp_replace(t, r"[\p{L}\p{N}\s]", ""))
    return (t != "") & ~t.rlike(r"^(#|- |[0-9]+\.)") & (low.rlike(PAGE_LINES) | low.rlike(FURNITURE_LINES) | ((F.char_length(t) <= 40) & (symbols > 0.5 * F.char_length(t))))


def without_useless_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~useless_line(x)), "\n")


def kept_url(url: Column, host: str, prefix: str = "/", blocked: tuple[str, ...] = ("jpg", "jpeg", "png", "gif", "pdf", "zip", "css", "js"), parts: tuple[str, ...] = ("login", "cart", "tag")) -> Column:
    """A page of the host below the prefix, without a blocked extension or part."""
    bare = F.lower(F.regexp_replace(url, r"[?#].*$", ""))
    path = F.regexp_extract(bare, r"^[a-z][a-z0-9+.-]*://[^/]*(.*)$", 1)
    return T.host_of(url).endswith(host) & path.startswith(prefix) & ~path.rlike(rf"\.({'|'.join(blocked)})$") & ~path.rlike(rf"/({'|'.join(parts)})(/|$)")


def whitelisted(values: Column, vocabulary: list[str]) -> Column:
    """Values of an array that are in a vocabulary, in their order."""
    return F.filter(values, lambda v: v.isin(*vocabulary))


def detail_url(url: Column, host: str, parameter: str) -> Column:
    """A page of the host or one below it, whose query has the parameter, not empty."""
    of = T.host_of(url)
    return ((of == host) | of.endswith(f".{host}")) & url.rlike(rf"[?&]{parameter}=[^&#]")


#: Words that are common in one language and rare in the others.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "is", "that", "it", "was", "for", "with", "this", "are", "be", "at", "you", "have", "not", "or", "from", "by"),
    "de": ("der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch"),
    "fr": ("le", "la", "les", "et", "des", "que", "est", "pour", "dans", "une", "du", "qui", "pas", "sur", "au", "avec", "plus", "ou", "ne", "ce"),
    "es": ("el", "los", "las", "y", "del", "una", "por", "con", "para", "su", "al", "lo", "como", "más", "pero", "sus", "este", "ya", "o", "fue"),
}


def language(text: Column) -> Column:
    """The language most of whose common words a text has, more than any other; null for none or a tie."""

    def one_of(terms: tuple[str, ...]) -> Callable[[Column], Column]:
        return lambda w: w.isin(*terms)

    def told(words: Column) -> Column:
        counts = {k: F.size(F.filter(words, one_of(v))) for k, v in COMMON_WORDS.items()}
        return T.let(F.array(*[F.struct(n.alias("n"), F.lit(k).alias("k")) for k, n in counts.items()]), best)

    def best(counts: Column) -> Column:
        most = F.array_max(F.transform(counts, lambda c: c["n"]))
        first = F.filter(counts, lambda c: (c["n"] == most) & (most > 0))
        return F.when(F.size(first) == 1, first[0]["k"])

    return T.let(F.split(F.lower(text), r"[^\p{L}]+", -1), told)
