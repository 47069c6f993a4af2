"""Line dedup in DataFrame functions: no Python on the executors, few pairs left to the exact test, few rows dealt out."""

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import components, line_dedup


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_signed_and_compared_without_python(spark):
    docs = spark.createDataFrame([(1, "some words of a line\nand of another one")], "doc_id long, text string")
    lines = line_dedup.signed_lines(docs)
    sets = line_dedup.shingle_sets(line_dedup.split_lines(docs).select("id", "line"))
    pairs = sets.select(F.col("id").alias("a"), F.col("id").alias("b"), *(F.col(c).alias(f"{c[0]}_{x}") for c in ("n", "shingles") for x in "ab"))
    for df in (lines.select(line_dedup.bands()), line_dedup.mapped(sets), line_dedup.similar_sets(pairs, 80, 100)):
        assert "Arrow" not in plan(df) and "Python" not in plan(df)  # MapInArrow before
        assert df.count() == 2


def test_maps_tell_long_lines_apart(spark):
    """Lines of some 1400 shingles, two thirds of which they share, are no pair for the exact test: maps of 512 bits let them through."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6))
    base = [word() for _ in range(200)]
    rows = [(0, " ".join(base)), (1, " ".join([*base[:160], *(word() for _ in range(40))])), (2, " ".join([*base[:198], word(), word()]))]
    traits = line_dedup.mapped(line_dedup.shingle_sets(spark.createDataFrame(rows, "id long, line string")))
    x, y = (traits.select(F.col("id").alias(i), F.col("trait").alias(f"t_{i}")) for i in "ab")
    near = x.join(y, F.col("a") < F.col("b")).where(line_dedup.close_traits(80, 100)(F.col("t_a"), F.col("t_b"))).select("a", "b").collect()
    assert [tuple(r) for r in near] == [(0, 2)]


def test_rows_are_filtered_where_they_are(spark):
    rows = spark.range(200_000).select(F.xxhash64("id").alias("key"), "id")
    wanted = rows.where("id % 5000 = 7").select("key")
    left = components.passing(rows, wanted, "key")
    assert "hashpartitioning" not in plan(left)
    assert left.join(wanted, "key").count() == 40 and left.count() < 200
