"""Rules of query understanding: columns over the query's text, vocabularies as arguments."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Names that a vocabulary may have: it goes out with the expressions.
MOST_NAMES = 10_000

# What each rule looks for, and what it calls it.
REGIONS = {
    "northern vietnam": "northern_vietnam", "north vietnam": "northern_vietnam", "the north of vietnam": "northern_vietnam",
    "central vietnam": "central_vietnam", "the centre of vietnam": "central_vietnam", "the center of vietnam": "central_vietnam",
    "southern vietnam": "southern_vietnam", "south vietnam": "southern_vietnam", "the south of vietnam": "southern_vietnam",
}
ALONE = r"(?i)\b(solo|travel(?:ing|ling)? alone|on my own)\b"
BUDGETS = {"mid_range": r"mid[- ]range|moderate budget", "budget": r"budget|low[- ]cost|cheap", "luxury": r"luxury|high[- ]end"}
NEGATIONS = r"avoid|avoiding|without|not|no|rather than|don't want|do not want"
STAY = r"(?i)\b(where\s+(should|can)\s+i\s+(stay|base)|base myself|accommodation|hotel|hostel)\b"
NUMBERS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
NIGHTS = rf"(?i)\b(?:final|last)\s+(\d+|{'|'.join(NUMBERS)})\s+nights?\b"
ENDING = r"\bend(?:ing|s|ed)?\s+in\s+|\bfinish(?:ing|es|ed)?\s+in\s+"
PHOTOGRAPHY = r"(?i)\bphotograph(y|ic|er)?\b"
WEATHER = (
    "weather", "forecast", "temperature", "humidity", "rainfall", "rain", "storm", "typhoon", "flood", "air quality", "thời tiết", "dự báo", "nhiệt độ", "độ ẩm",
    "lượng mưa", "mưa", "bão", "lũ",
)
CLIMATE = ("monthly", "typical", "average", "historical", "climate", "seasonal", "best time", "usual", "normally", "theo tháng", "trung bình", "khí hậu", "mùa nào", "thường")
LIVE = (
    "current", "currently", "today", "tomorrow", "right now", "this week", "next week", "warning", "alert", "hiện tại", "hôm nay", "ngày mai", "tuần này", "tuần tới", "cảnh báo",
)
RECENT = (
    "opening hour", "open today", "closed", "closure", "admission", "ticket", "price", "fare", "cost", "schedule", "timetable", "departure", "arrival", "availability", "booking",
    "event", "festival", "concert", "visa", "entry requirement", "regulation", "rule", "construction", "service disruption", "route status", "operating", "giờ mở cửa", "đóng cửa",
    "giá vé", "giá", "lịch", "chuyến", "sự kiện", "lễ hội", "thị thực", "quy định", "đang hoạt động",
)
LIVE_HOURS, CACHE_HOURS, RECENT_DAYS = 24, 6, 90
ROUTES = ("travel", "out_of_scope", "ambiguous")
# Phrases of requirements that speak of the answer, and of queries that ask for just that. A phrase is whole
# words; 9 stands for any number.
CONDITIONS = ("weather", "climate", "permit", "permits", "permission")
CONDITIONS_ASKED = (*CONDITIONS, "practical consideration", "practical considerations")
VIEWS = ("scenic view", "scenic views", "photography opportunities", "photographic opportunities")
VEHICLES = ("train", "bus", "route", "transfer")
VIEWS_ASKED = ("scenic", *(f"{seen} {where}" for seen in ("view", "views", "photo", "photos", "photography", "photographic") for where in ("from", "along")), "photography on the route")
FORM = (
    "package tour", "packaged tour", "organized tour", "large group tour", "package tours", "packaged tours", "organized tours", "large group tours", "flexibility", "independent travel",
    "specified interests", "specified constraints", "priority recommendation", "priority recommendations", "recommendation for a 9 day", "recommendation for the 9 day",
    "recommendations for a 9 day", "recommendations for the 9 day", "prioritise for a trip", "prioritise for the trip", "prioritize for a trip", "prioritize for the trip",
)
ALONE_PHRASES, SAFETY = ("solo travel", "solo traveler", "solo traveller"), ("safety", "safe", "accessibility", "access")
LEVELS, PRICES = ("mid range", "budget level", "budget traveler"), ("cost", "price", "how much", "afford", "daily budget")
COMPARING = ("compare", "comparison", "contrast", "versus", "vs", "which is better")
SCHEDULING = ("itinerary", "day by day", "schedule", "plan for 9 day", "plan for 9 days")
NIGHTLIFE, DECLINED = ("nightlife",), ("avoid", "without", "not interested")


# Wordings of a search for a place to stay, and what is asked for instead where no property is named.
AREAS = (
    (("which accommodation located near", "which accommodations located near", "which accommodation are located near", "which accommodations are located near"), "which neighborhoods or base areas provide access to"),
    (("budget-friendly accommodation options", "budget friendly accommodation options"), "budget-friendly neighborhoods or base areas to stay"),
    (("accommodation options",), "neighborhoods or base areas to stay"), (("affordable accommodation", "affordable accommodations"), "budget-friendly neighborhoods or base areas"),
    (("budget hotel near", "budget hotels near", "hotel near", "hotels near"), "budget-friendly areas to stay near"),
)
PROPERTIES = ("hotel", "hostel", "resort", "property")
PROPERTY_ASKED = (
    *(f"{which} {p}" for which in ("specific", "named") for p in PROPERTIES), *(f"{which} {p}" for which in ("which", "what") for p in PROPERTIES[:3]), *(f"{p} {name}" for p in PROPERTIES for name in ("name", "names")),
)
ACCOMMODATION = "accommodation_search"


def vocabulary(names: DataFrame, column: str, most: int = MOST_NAMES) -> list[str]:
    """A column's distinct values, longest first; more than most of them are refused, not cut."""
    found = [r[0] for r in names.filter(F.col(column).isNotNull()).select(column).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"over {most} names: join them as a table instead")
    return sorted(found, key=lambda n: (-len(n), n))


def strings(values: list[str] | tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def has_any(text: Column, terms: tuple[str, ...]) -> Column:
    return F.exists(strings(terms), lambda t: F.contains(text, t))


def explicit_names(text: Column, names: list[str]) -> Column:
    """Names that the text says as whole words, in any case, not only as the start of a longer capitalised name."""
    alone = r"\E(?!\w)(?!\s+(?!(?:city|province)(?![\wÀ-ỹ'-]))(?-i:[A-ZÀ-Ỹ]))"
    return F.filter(strings(names), lambda n: F.regexp_like(text, F.concat(F.lit(r"(?iu)(?<!\w)\Q"), n, F.lit(alone))))


def region(text: Column, aliases: dict[str, str] = REGIONS) -> Column:
    """The region of the longest alias that the text says as whole words."""
    flat = F.regexp_replace(F.lower(text), r"\s+", " ")
    ordered = sorted(aliases, key=lambda a: (-len(a), a))
    return F.coalesce(*[F.when(flat.rlike(rf"(?<!\w){re.escape(a)}(?!\w)"), aliases[a]) for a in ordered], F.lit(None).cast("string"))


def located(text: Column, province: Column, aliases: dict[str, str] = REGIONS) -> Column:
    """region and province of a query: a region that is said takes the place of a province."""
    r = region(text, aliases)
    return F.struct(r.alias("region"), F.when(r.isNull(), province).alias("province"))


def budgets(text: Column, levels: dict[str, str] = BUDGETS) -> Column:
    """Levels of which one mention at least has no negation up to five words before it."""
    words = ""
    for _ in range(5):  # what looks back must have a longest match
        words = rf"(?:\s{{1,9}}\w{{1,30}}{words})?"
    free = rf"(?<!\b(?:{NEGATIONS}){words}\s{{0,9}})"
    return F.filter(strings(tuple(levels)), lambda n: reduce(lambda a, b: a | b, [(n == k) & text.rlike(rf"(?i)\b(?=(?:{p})\b){free}") for k, p in levels.items()]))


def stay_rewrites(turns: DataFrame, names: list[str], by: str = "conv_id", order: tuple[str, ...] = ("turn", "role"), text: str = "text") -> DataFrame:
    """turns with rewritten: where to stay for the last nights, by the city that the turns before end in; else null.

    The city is the longest of names that any turn before it says the trip ends in. Turns of later never count.
    """
    ends = F.filter(strings(names), lambda n: F.regexp_like(F.col(text), F.concat(F.lit(rf"(?i)(?:{ENDING})\Q"), n, F.lit(r"\E(?!\w)"))))
    place = F.when(F.size(ends) > 0, F.array_position(strings(names), ends[0]))  # names are longest first
    before = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = turns.withColumn("city", F.min(place).over(before)).withColumn("photo", F.max(F.col(text).rlike(PHOTOGRAPHY)).over(before))
    said = F.lower(F.regexp_extract(text, NIGHTS, 1))
    nights = F.coalesce(said.try_cast("int"), F.nullif(F.array_position(strings(NUMBERS), said), F.lit(0)).cast("int"))
    kind = F.when(F.col("photo"), "photography itinerary").otherwise("itinerary")
    full = F.concat(F.lit("Where should I stay in "), F.get(strings(names), F.col("city").cast("int") - 1), F.lit(" for the final "), nights, F.lit(" nights of the existing "), kind, F.lit("?"))
    asked = F.col(text).rlike(STAY) & (said != "") & F.col("city").isNotNull()
    return seen.withColumn("rewritten", F.when(asked, full)).drop("city", "photo")


def freshness(text: Column) -> Column:
    """live: weather, unless it is the climate and nothing of now; recent: what changes with operations; else stable."""
    flat = F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")
    return F.when(has_any(flat, WEATHER) & (has_any(flat, LIVE) | ~has_any(flat, CLIMATE)), "live").when(has_any(flat, RECENT), "recent").otherwise("stable")


def external_requirement(text: Column, now: Column, only_sensitive: bool = True) -> Column:
    """A struct of an uncovered requirement: freshness, whether it is searched for, its age limits, cutoff and expiry."""
    kind = freshness(text)
    return F.struct(
        kind.alias("freshness"), F.when(kind == "stable", F.lit(not only_sensitive)).otherwise(True).alias("eligible"),
        F.when(kind == "live", F.lit(LIVE_HOURS)).alias("max_age_hours"), F.when(kind == "recent", F.lit(RECENT_DAYS)).alias("max_age_days"),
        F.when(kind == "recent", F.date_sub(F.to_date(now), RECENT_DAYS)).alias("cutoff"), F.when(kind == "live", now + F.make_interval(hours=F.lit(CACHE_HOURS))).alias("expires"),
    )


def spoken(text: Column) -> Column:
    """The words of a text, in lower case with a blank on each side; 9 for a number."""
    return F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "), r"(?<![\p{L}\p{N}_])\d+(?![\p{L}\p{N}_])", "9"), F.lit(" "))


def says(words: Column, phrases: tuple[str, ...]) -> Column:
    """Does a text, as spoken() gives it, say one of the phrases?"""
    return has_any(words, tuple(f" {p} " for p in phrases))


def answer_rules(requirement: Column, query: Column, intent: Column, n_cities: Column) -> list[Column]:
    """What makes a requirement one about the answer: it says something that the query, if it asks for it, makes a fact."""
    unless = ((CONDITIONS, CONDITIONS_ASKED), (ALONE_PHRASES, SAFETY), (LEVELS, PRICES))
    return [
        *(says(requirement, topic) & ~says(query, asked) for topic, asked in unless),
        says(requirement, VIEWS) & says(requirement, VEHICLES) & ~says(query, VIEWS_ASKED),
        says(requirement, FORM),
        says(requirement, COMPARING) & (n_cities > 0),
        says(requirement, SCHEDULING) & (intent == "itinerary"),
        says(requirement, NIGHTLIFE) & says(requirement, DECLINED),
    ]


def response_only(requirement: Column, query: Column, intent: Column, n_cities: Column) -> Column:
    """Is a requirement about the answer's form or its limits, so that no evidence is to be found for it?"""
    rules = answer_rules(spoken(requirement), spoken(query), intent, n_cities)
    return F.coalesce(reduce(lambda a, b: a | b, rules), F.lit(False))


def area_level(text: Column, query: Column, intent: Column) -> Column:
    """A requirement or task of a search for a place to stay, as one for areas; as it is where the query asks for a property."""
    said = sorted(((p, to) for phrases, to in AREAS for p in phrases), key=lambda x: -len(x[0]))
    made = reduce(lambda t, x: F.regexp_replace(t, rf"(?i)\b{re.escape(x[0])}\b", x[1]), said, text)
    return F.when((intent == ACCOMMODATION) & ~F.coalesce(says(spoken(query), PROPERTY_ASKED), F.lit(False)), made).otherwise(text)


def compared_cities(operation: Column, intent: Column, cities: Column) -> Column:
    """The cities of a comparison: two and more, and not of transport; else none."""
    return F.when((operation == "compare") & (intent != "transport") & (F.size(cities) >= 2), cities).otherwise(F.array().cast("array<string>"))


def normal_plan(query: Column, requirements: Column, tasks: Column, dropped: Column, compared: Column, most: int = 6) -> Column:
    """A plan's requirements and tasks made consistent.

    requirements: array of text; dropped: array of flags, of those that need no evidence; tasks: array of struct<query,
    cities, indexes>. At most so many requirements stay, in order; where none does, each compared city is one, or the
    request itself. Tasks without a query go; their indexes are those of what stays, each once. In a comparison a task's
    cities are compared ones, and a city that no task has gets one in front; at most so many tasks stay.
    """
    marked = F.zip_with(requirements, dropped, lambda r, x: F.struct(F.trim(r).alias("r"), x.alias("x")))
    numbered = F.transform(marked, lambda m, i: F.struct(m["r"].alias("r"), m["x"].alias("x"), i.alias("i")))
    kept = F.slice(F.filter(numbered, lambda m: (m["r"] != "") & ~m["x"]), 1, most)
    told = F.slice(F.filter(tasks, lambda t: F.trim(t["query"]) != ""), 1, most)

    def asked(v: Column) -> Column:
        instead = F.transform(v["compared"], lambda c: F.concat(F.lit("Factual travel evidence about "), c, F.lit(" for the requested aspects")))
        instead = F.when(F.size(v["compared"]) > 0, instead).otherwise(F.array(F.lit("Factual evidence needed to answer the travel request")))
        return F.when(F.size(v["kept"]) > 0, F.transform(v["kept"], lambda x: x["r"])).otherwise(instead)

    def task(t: Column, compared: Column, places: Column) -> Column:
        own = F.filter(F.transform(t["indexes"], lambda i: F.array_position(places, i).cast("int") - 1), lambda i: i >= 0)
        cities = F.when(F.size(compared) > 0, F.filter(t["cities"], lambda c: F.array_contains(compared, c))).otherwise(t["cities"])
        return F.struct(t["query"].alias("query"), cities.alias("cities"), F.array_distinct(own).alias("indexes"))

    def plan(w: Column) -> Column:
        covered = F.flatten(F.transform(w["made"], lambda t: t["cities"]))
        lacking = F.filter(w["compared"], lambda c: ~F.array_contains(covered, c))
        every = F.sequence(F.lit(0), F.size(w["asked"]) - 1)
        added = F.transform(lacking, lambda c: F.struct(F.concat(c, F.lit(" "), query).alias("query"), F.array(c).alias("cities"), every.alias("indexes")))
        return F.struct(w["asked"].alias("requirements"), F.slice(F.concat(added, w["made"]), 1, most).alias("tasks"))

    # Each step's value is bound once: lambdas would compute it for every element, and every element of that.
    given = F.struct(kept.alias("kept"), told.alias("told"), compared.alias("compared"))
    placed = lambda v: F.struct(v["told"].alias("told"), v["compared"].alias("compared"), asked(v).alias("asked"), F.transform(v["kept"], lambda x: x["i"]).alias("places"))
    tasked = lambda u: F.struct(F.transform(u["told"], lambda t: task(t, u["compared"], u["places"])).alias("made"), u["compared"].alias("compared"), u["asked"].alias("asked"))
    return T.let(given, lambda v: T.let(placed(v), lambda u: T.let(tasked(u), plan)))


def answer_gate(sufficient: Column, any_evidence: Column, web_on: Column, n_searchable: Column, found: Column, limit: int = 3) -> Column:
    """A struct of web (what became of the search) and mode (how the answer is made) of a request.

    Without enough evidence the web is asked where it is on, for at most limit requirements, more are asked back; what it
    doesn't answer is answered from what evidence there is, and refused where there is none.
    """
    web = (
        F.when(sufficient, "not_needed").when(~web_on, "disabled_by_user").when(n_searchable > limit, "needs_clarification").when(n_searchable == 0, "skipped_stable")
        .when(found, "succeeded").otherwise("failed")
    )
    mode = F.when(web == "succeeded", "web").when(web == "needs_clarification", "clarification").when(sufficient | any_evidence, "normal").otherwise("blocked")
    return F.struct(web.alias("web"), mode.alias("mode"))


# What a request's wording says of its operation and, for old comparisons, of its intent.
OPERATIONS = (
    ("compare", "comparison", ("compare", "comparison", " versus ", " vs ", "khác nhau")), ("plan", "itinerary", ("itinerary", "plan a ", "lịch trình")),
    ("recommend", "recommendation", ("recommend", "suggest", "best ", "gợi ý")), ("explain", None, ("explain", "why ", "how does", "giải thích", "tại sao")),
)
OLD_COMPARISONS = (
    ("transport", ("train", "bus", "flight", "car", "taxi", "transport", "tàu", "xe", "bay")), ("accommodation_search", ("hotel", "hostel", "resort", "accommodation")),
    ("food_search", ("restaurant", "food", "dish", "cuisine")),
)
STYLES = ("family", "luxury", "adventure", "culture")


def old_operation(text: Column, intent: Column) -> Column:
    low = F.lower(text)
    return first_rule([((intent == named) | has_any(low, terms) if named else has_any(low, terms), operation) for operation, named, terms in OPERATIONS], "lookup")


def old_intent(text: Column, intent: Column) -> Column:
    low = F.lower(text)
    return F.when(intent != "comparison", intent).otherwise(first_rule([(has_any(low, terms), to) for to, terms in OLD_COMPARISONS], "recommendation"))


def keyword_parse(text: Column, names: list[str], rules: list[tuple[str, tuple[str, ...]]], otherwise: str, aliases: tuple[tuple[str, str], ...] = ()) -> Column:
    """The offline parser: a struct of intent (the first rule of which a term is said), city (the last of names, and then of
    aliases for them, that is said, whatever its case), style (the last of the styles) and duration."""
    low = F.lower(text)
    said = F.filter(strings(STYLES), lambda x: F.contains(low, x))
    called = [*[(n.lower(), n) for n in names], *[(a.lower(), n) for a, n in aliases]]
    said_as = F.array(*[F.struct(F.lit(a).alias("said"), F.lit(n).alias("name")) for a, n in called]) if called else F.array().cast("array<struct<said: string, name: string>>")
    city = F.try_element_at(F.filter(said_as, lambda c: F.contains(low, c["said"])), F.lit(-1))["name"]
    return F.struct(first_rule([(has_any(low, terms), to) for to, terms in rules], otherwise).alias("intent"), city.alias("city"), F.try_element_at(said, F.lit(-1)).alias("style"), days(low).alias("days"))


def routed(reply: Column) -> Column:
    """A struct of a router's reply: category and confidence; what isn't a known category is travel, of no confidence."""
    category, sure = F.get_json_object(reply, "$.category"), F.coalesce(F.get_json_object(reply, "$.confidence").try_cast("double"), F.lit(0.0))
    known = F.coalesce(category.isin(*ROUTES) & sure.between(0, 1), F.lit(False))
    return F.struct(F.when(known, category).otherwise("travel").alias("category"), F.when(known, sure).otherwise(0.0).alias("confidence"))


def merged_sources(cited: DataFrame, consulted: DataFrame, by: str, most: int = 20) -> DataFrame:
    """(by, source_id, url, title, published): sources of both lists by url, each once, the cited first, then as they came;
    a title or date that one list lacks comes from the other. Both have by, url, place, title, published."""
    both = cited.withColumn("list", F.lit(0)).unionByName(consulted.withColumn("list", F.lit(1))).filter(F.col("url").isNotNull())
    at = F.struct("list", "place")
    one = both.groupBy(by, "url").agg(F.min(at).alias("at"), *[F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), at)).alias(c) for c in ("title", "published")])
    ranked = one.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy("at", "url"))).filter(F.col("n") <= most)
    return ranked.select(by, F.concat(F.lit("W"), "n").alias("source_id"), "url", "title", "published")


def days(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(\d+)\s*days?\b", 1), F.lit("")).cast("int")


def fallback(value: Column, allowed: tuple[str, ...], default: str | None) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))


def first_rule(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first rule that holds."""
    return reduce(lambda acc, r: F.when(r[0], r[1]).otherwise(acc), reversed(rules), F.lit(otherwise))


def violations(rows: DataFrame, rules: dict[str, Column], by: list[str], of_groups: dict[str, Column], unique: dict[str, list[str]]) -> DataFrame:
    """(rule, violations): rows that break a rule, groups that do, and keys that occur more than once; none: no row.

    All rules of rows are told in one pass, those of groups in another, each set of keys in one of its own.
    """
    broken = lambda checks: F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in checks.items()]), lambda x: x.isNotNull())
    parts = [rows.select(F.explode(broken(rules)).alias("rule")), rows.groupBy(*by).agg(broken(of_groups).alias("b")).select(F.explode("b").alias("rule"))]
    parts += [rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit(name).alias("rule")) for name, keys in unique.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))
