"""Bit tables: nothing in the set is missed, on either side, and most of what isn't is told."""

import numpy as np
from pyspark.sql import functions as F

from tracelake.operators import bits
from tracelake.operators.events import distinct_events, repeated_ids
from helpers import trace


def test_both_sides_agree(spark):
    df = spark.range(-3000, 3000).withColumn("k", F.col("id") * 7_919_000_001)
    table = bits.bit_table(df.filter("id % 3 = 0").unionByName(df.filter("id = 0")).withColumn("k", F.when(F.col("id") != 9, F.col("k"))), "k")
    rows = bits.with_bit(df, "k", table, "in_set").select("id", "k", "in_set").toPandas()
    assert (bits.perhaps(bits.as_array(table), rows.k.to_numpy()) == rows.in_set.to_numpy()).all()
    assert rows.in_set[(rows.id % 3 == 0) & (rows.id != 9)].all() and rows.in_set[rows.id % 3 != 0].mean() < 0.01
    none = bits.with_bit(df.withColumn("k", F.lit(None).cast("long")), "k", table, "in_set")
    assert none.filter("in_set").count() == 0 == bits.bit_table(df.limit(0), "k").count()
    assert bits.with_bit(df, "k", bits.bit_table(df.limit(0), "k"), "in_set").filter("in_set").count() == 0


def test_full_tables_only_let_more_rows_pass(spark, monkeypatch):
    monkeypatch.setattr(bits, "WORDS", 2)
    rows = [{"event_id": i % 700, "func_name": f"f{i}", "size": i} for i in range(1000)] + [{"event_id": None, "func_name": "x"}] * 3
    t = trace(spark, rows).withColumn("word", F.lit(1)).withColumn("_tl_order", F.lit(1))
    assert repeated_ids(t).count() == 2
    got = distinct_events(t, ["func_name", "size"]).collect()
    assert len(got) == 703 and {r.event_id for r in got} == {None, *range(700)}
    assert np.sum([r.func_name == "x" for r in got]) == 3
    assert {r.event_id: r.func_name for r in got if r.event_id is not None} == {i: min(f"f{i}", f"f{i + 700}" if i < 300 else "g") for i in range(700)}


def test_a_table_made_on_the_driver_is_the_same(spark):
    keys = np.random.default_rng(4).integers(-(2**63), 2**63 - 1, 3000)
    df = spark.createDataFrame([(int(k),) for k in keys], "k long")
    for words in (None, 64):
        assert (bits.table_of(keys, words) == bits.as_array(bits.bit_table(df, "k", words), words)).all()
