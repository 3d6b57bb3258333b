"""Aggregates and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .numbering import numbered


def pearson(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Pearson's r of population sums for each group; null for fewer than two pairs or no variance.

    Values that are all the same are told by the least and the greatest: merged deviations of theirs may come out over 0.
    """
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    sums = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.covar_pop(x, y).alias("c"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"), ((F.min(x) < F.max(x)) & (F.min(y) < F.max(y))).alias("vary"))
    spread = F.col("sx") * F.col("sy")
    return sums.select(*by, "n", F.when((F.col("n") >= 2) & F.col("vary") & (spread > 0), F.try_divide(F.col("c"), spread)).alias("pearson_r"))


def latency_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """count, mean, upper median (place n // 2 of the sorted values), p95 (place ceil(0.95 n) - 1), least and most."""
    rows = df.filter(F.col(value).isNotNull()).select(by, value)
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    ranked = numbered(rows.withColumn("tie", F.monotonically_increasing_id()), [by], [F.col(value), F.col("tie")], "i").join(sizes, by)
    places = F.array(F.floor(F.col("n") / 2), F.ceil(0.95 * F.col("n")) - 1)
    pick = lambda k: F.max(F.when(F.col("i") - 1 == places[k], F.col(value)))
    out = ranked.groupBy(by, "n", "mean", "min", "max").agg(pick(0).alias("median"), pick(1).alias("p95"))
    return out.select(by, "n", F.round("mean", 6).alias("mean"), "median", "p95", "min", "max")


def gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / (F.log(rank + 1.0) / F.log(F.lit(2.0)))


def ranking_metrics(run: DataFrame, judged: DataFrame, k: int = 5, pool_k: int = 10) -> DataFrame:
    """ndcg, precision (grade 2 and more, over k), recall and precision of the pool at pool_k (grade 1 and more), mrr.

    run: query_id, id, rank; judged: query_id, id, grade. Unjudged rows have grade 0; the ideal is over all judged ones.
    """
    graded = run.join(judged, ["query_id", "id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    best = judged.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "id")))
    ideal = best.groupBy("query_id").agg(F.sum(F.when(F.col("i") <= k, gain(F.col("grade"), F.col("i")))).alias("ideal"), F.sum((F.col("grade") >= 1).cast("int")).alias("relevant"))
    got = graded.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= k, gain(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias("dcg"),
        (F.sum(((F.col("rank") <= k) & (F.col("grade") >= 2)).cast("int")) / k).alias("precision_at_k"),
        F.sum(((F.col("rank") <= pool_k) & (F.col("grade") >= 1)).cast("int")).alias("hits"),
        F.min(F.when(F.col("grade") >= 2, F.col("rank"))).alias("first"),
    )
    m = got.join(ideal, "query_id", "left")
    return m.select(
        "query_id", F.round(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0), 9).alias("ndcg"), "precision_at_k",
        F.round(F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant")).otherwise(0.0), 9).alias("pooled_recall"),
        (F.col("hits") / pool_k).alias("pooled_precision"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 9).alias("mrr"),
    )


def set_f1(a: Column, b: Column) -> Column:
    """F1 of two arrays as sets; both empty: 1."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when(F.size(x) + F.size(y) == 0, 0.0).otherwise(2.0 * both / (F.size(x) + F.size(y)))


def coverage(assessed: DataFrame, by: str, status: str) -> DataFrame:
    """covered, partial, missing (partial ones too), the ratio with partial as a half, and whether nothing is missing."""
    n = lambda s: F.count_if(F.col(status) == s)
    out = assessed.groupBy(by).agg(n("covered").alias("covered"), n("partial").alias("partial"), F.count_if(F.col(status) != "covered").alias("missing"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("ratio", F.round((F.col("covered") + 0.5 * F.col("partial")) / F.col("n"), 9)).withColumn("sufficient", F.col("missing") == 0)


def corpus_fingerprint(df: DataFrame, by: str, id_: str, content: Column) -> DataFrame:
    """A hash for each group that doesn't depend on the order of rows: of the sums of its rows' hashes, in four parts of
    sixty bits. Rows are summed up where they are, none is collected."""
    h = F.sha2(F.concat_ws("|", F.col(id_).cast("string"), content), 256)
    parts = [F.sum(F.conv(F.substring("h", 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return df.select(by, h.alias("h")).groupBy(by).agg(F.sha2(F.concat_ws("|", *parts), 256).alias("fingerprint"))


def same(a: Column, b: Column) -> Column:
    """Are two values alike in lower case, with spaces for underscores? Missing is like missing."""
    return T.canonical(a).eqNullSafe(T.canonical(b))


def list_prf(actual: Column, expected: Column) -> Column:
    """precision, recall and f1 of two arrays as sets of normal texts; nothing found is precise where nothing is expected."""
    x, y = (F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda v: T.canonical(v))) for c in (actual, expected))
    both = F.size(F.array_intersect(x, y))
    p = F.when(F.size(x) > 0, both / F.size(x)).otherwise((F.size(y) == 0).cast("double"))
    r = F.when(F.size(y) > 0, both / F.size(y)).otherwise(1.0)
    return F.struct(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def concept_score(text: Column, required: Column, forbidden: Column) -> Column:
    """recall of required concepts in a text, rate of forbidden ones, and whether all and none are there."""
    flat = T.canonical(text)
    hits = lambda c: F.size(F.filter(c, lambda v: F.contains(flat, T.canonical(v))))
    share = lambda c, none: F.when(F.size(c) > 0, hits(c) / F.size(c)).otherwise(none)
    return F.struct(share(required, 1.0).alias("recall"), share(forbidden, 0.0).alias("forbidden"), ((hits(required) == F.size(required)) & (hits(forbidden) == 0)).alias("passed"))


def field_score(pairs: dict[str, tuple[Column, Column]]) -> Column:
    """For each field: are its two values alike; and exact, whether all are."""
    told = {k: same(a.cast("string"), b.cast("string")) for k, (a, b) in pairs.items()}
    every = F.forall(F.array(*told.values()), lambda v: v)
    return F.struct(*[v.alias(k) for k, v in told.items()], every.alias("exact"))


def state_score(scalars: list[tuple[Column, Column]], lists: list[tuple[Column, Column]]) -> Column:
    """accuracy, the mean over scalar fields and lists' precision, recall and F1; exact, whether all are 1. None: 1."""
    values = [same(a, b).cast("double") for a, b in scalars]
    for a, b in lists:
        x = list_prf(a, b)
        values += [x["precision"], x["recall"], x["f1"]]
    if not values:
        return F.struct(F.lit(1.0).alias("accuracy"), F.lit(True).alias("exact"))
    every = F.array(*values)
    return F.struct((F.aggregate(every, F.lit(0.0), lambda a, v: a + v) / len(values)).alias("accuracy"), F.forall(every, lambda v: v == 1).alias("exact"))


def weak_grade(text: Column, places: Column, locations: Column, keywords: Column) -> Column:
    """3 for a place, 2 for a location with a keyword, 1 for a location or two keywords, else 0."""
    flat = T.canonical(text)
    hits = lambda c: F.size(F.filter(c, lambda v: F.contains(flat, T.canonical(v))))
    p, l, k = hits(places), hits(locations), hits(keywords)  # noqa: E741
    return F.when(p > 0, 3).when((l > 0) & (k > 0), 2).when((l > 0) | (k >= 2), 1).otherwise(0)


def weak_metrics(run: DataFrame, cases: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recall, precision, ndcg, mrr) of runs (query_id, id, rank, text) by known ids or, without, weak grades.

    cases: query_id, relevant (ids), places, locations, keywords. A known id has grade 3, others 0. The ideal list has
    grade 3 as often as there are known ids or places; gains are of the first five. Recall is that of known ids, or the
    share of places that the first k texts name.
    """
    known = F.size("relevant") > 0
    grade = F.when(known, F.when(F.array_contains("relevant", F.col("id")), 3).otherwise(0)).otherwise(weak_grade(F.col("text"), F.col("places"), F.col("locations"), F.col("keywords")))
    named = F.filter("places", lambda v: F.contains(T.canonical(F.col("text")), T.canonical(v)))
    g = run.join(cases, "query_id").withColumn("grade", grade).withColumn("named", F.when(F.col("rank") <= k, named))
    got = g.groupBy("query_id").agg(
        F.sum(((F.col("rank") <= k) & (F.col("grade") > 0)).cast("int")).alias("good"), F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first_good"),
        F.sum(F.when(F.col("rank") <= min(5, k), gain(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias("dcg"),
        F.count_distinct(F.when((F.col("rank") <= k) & F.array_contains("relevant", F.col("id")), F.col("id"))).alias("hits"), F.size(F.array_distinct(F.flatten(F.collect_list("named")))).alias("named"),
    )
    c = cases.select("query_id", F.size(F.array_distinct("relevant")).alias("n_known"), F.size("places").alias("n_places")).join(got, "query_id", "left")
    n = F.when(F.col("n_known") > 0, F.col("n_known")).otherwise(F.col("n_places"))
    ideal = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), F.least(n, F.lit(min(5, k))))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, i: a + gain(F.lit(3), i))
    recall = F.when(F.col("n_known") > 0, F.col("hits") / F.col("n_known")).when(F.col("n_places") > 0, F.col("named") / F.col("n_places")).otherwise(0.0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return c.select("query_id", zero(recall).alias("recall"), zero(F.col("good") / k).alias("precision"), zero(F.when(ideal > 0, F.col("dcg") / ideal)).alias("ndcg"), zero(1 / F.col("first_good")).alias("mrr"))
