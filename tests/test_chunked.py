"""Running values over range-sorted chunks against a plain loop."""

import random
from collections import Counter, defaultdict

import pytest

from tracelake.operators.chunked import running


@pytest.mark.parametrize("n", [1, 5, 40])
def test_running(spark, n):
    r = random.Random(n)
    rows = [(r.choice(["hot", "hot", "hot", "a", "b", None]), i, r.choice([None, r.randint(-5, 9)]), "x") for i in range(1500)]
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        df = spark.createDataFrame(rows, "g string, o long, v long, seg string").repartition(3)
        got = running(df, ["g"], ["o"], {"total": ("v", "sum"), "v": ("v", "last")})
        assert sorted(got.columns) == ["g", "o", "seg", "total", "v"]
        got = Counter((x.g, x.o, x.total, x.v) for x in got.collect())
        assert running(df.limit(0), ["g"], ["o"], {"total": ("v", "sum")}).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    total, last, want = defaultdict(int), {}, Counter()
    for g, o, v, _ in rows:
        total[g] += v or 0
        last[g] = v if v is not None else last.get(g)
        want[g, o, total[g], last[g]] += 1
    assert got == want


def test_refuses_other_sums(spark):
    with pytest.raises(ValueError):
        running(spark.range(1), ["id"], ["id"], {"x": ("id", "max")})
