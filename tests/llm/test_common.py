import os
import random

from pyspark.sql import functions as F

from quillspan.llm import common as C
from quillspan.llm.components import connected


def test_columns_of_the_same_name_give_way(spark):
    df = spark.createDataFrame([(1, "x", "y")], "a int, B string, `odd name` string")
    out = C.put(df, b=F.lit(2))
    assert out.columns == ["a", "odd name", "b"] and out.first()["b"] == 2


def test_scratch_tables_can_be_removed(spark):
    mark = C.scratch_mark()
    first, second = (C.materialize(spark.range(3), "t") for _ in range(2))
    paths = [f.removeprefix("file:") for f in (first.inputFiles()[0], second.inputFiles()[0])]
    C.clear_scratch(spark, mark, keep=1)
    assert not os.path.exists(paths[0].removeprefix("//")) and second.count() == 3 and C.scratch_mark() == mark + 1
    C.clear_scratch(spark, mark)
    assert C.scratch_mark() == mark


def test_ascii_lower_leaves_other_letters(spark):
    df = spark.createDataFrame([("ABCé",), ("ABC É İ",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(C.ascii_lower(F.col("t"))).collect()] == ["abcé", "abc É İ", "", None]


def test_components_of_paths_stars_and_random_links(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(200)] + [(5000, 5000)]
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {x["u"]: x["v"] for x in connected(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0
