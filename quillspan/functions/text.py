"""Text expressions: Spark columns; location_key alone needs a table of characters that only Python has."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"[ \t\n\x0b\f\r]+"


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once, however often it is used, in lambdas too."""
    return F.transform(F.array(value), of)[0]


def tokens(text: Column) -> Column:
    """Case-sensitive tokens between white space."""
    return F.array_remove(F.split(text, SPACE, -1), "")


def canonical(text: Column) -> Column:
    """Lower case, underscores as spaces, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "_", " "), SPACE, " "))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normal_hash(text: Column) -> Column:
    """A key for texts that differ in case and white space alone."""
    return F.md5(collapsed(F.lower(text)))


def letters_ratio(text: Column) -> Column:
    """Letters over all characters; 0 for none."""
    n = F.char_length(text)
    return F.when(n == 0, 0.0).otherwise(F.char_length(F.regexp_replace(text, r"[^\p{L}]", "")) / n)


def normal_url(url: Column) -> Column:
    """Scheme and host in lower case, no www., no query or fragment, single slashes, no slash at the end."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(.*)$", 1), r"/+", "/")
    return F.concat(scheme, F.lit("://"), host, F.regexp_replace(path, r"/$", ""))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def safe_url(url: Column) -> Column:
    """The URL if it is http or https with a host, else null."""
    return F.when(url.rlike(r"^[hH][tT][tT][pP][sS]?://[^/?#\s]+"), url)


def source_kind(url: Column) -> Column:
    host = host_of(url)
    return F.when(host.rlike(r"\.gov(\.|$)"), "official_government").when(host.rlike(r"\.edu(\.|$)"), "academic").otherwise("open_web")


def visible_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags, white space collapsed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    return collapsed(F.regexp_replace(t, r"(?s)<[^>]*>", " "))


def absolute_url(base: Column, link: Column) -> Column:
    """A link as seen from a page."""
    page, origin = F.regexp_replace(base, r"[?#].*$", ""), F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    folder = F.regexp_replace(page, r"([^/:])/[^/]*$", "$1")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(F.lit("https:"), link)).when(link.startswith("/"), F.concat(origin, link))
        .when(link.rlike(r"^[?#]"), F.concat(page, link)).otherwise(F.concat(folder, F.lit("/"), link))
    )


@F.pandas_udf(StringType())
def location_key(names: pd.Series) -> pd.Series:
    """Letters and digits of a name, case folded and without accents."""

    def key(name: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFKD", name.casefold().replace("đ", "d")) if c.isalnum())

    return names.map(lambda n: None if n is None else key(n))


def json_in(text: Column) -> Column:
    """The JSON object that a text is, or that is in it from its first { to its last }, as text; null if there is none."""
    bare = F.regexp_replace(F.btrim(text, F.lit(" \t\r\n")), r"^```[A-Za-z]*\s*|\s*```$", "")
    inner = F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))
    valid = lambda c: F.when(F.get_json_object(c, "$").isNotNull(), c)
    return F.coalesce(valid(F.when(bare.startswith("{"), bare)), valid(inner))
