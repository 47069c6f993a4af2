"""How the work of corpus operators grows with groups."""

import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import components, katz, line_dedup
from weftline.llm.scratch import stored


def test_large_mixed_groups_compare_few_pairs_once_their_components_grow(spark):
    """Of one bucket of ids that link to their neighbours alone, far fewer pairs than all are compared, and no link is lost."""
    n, near, seen = 400, 40, []

    def linked(pairs):
        seen.append(pairs.count())
        return stored(pairs.where(F.abs(F.col("a") - F.col("b")) <= near), "links")

    found = components.bucket_components(spark.range(n).select(F.lit(1).cast("long").alias("key"), "id"), linked)
    assert found.select("component").distinct().count() == 1 and found.count() == n
    assert sum(seen) < 15_000  # 33,000 with one hub in each turn, 79,800 by all pairs


def test_pairs_of_many_common_buckets_are_joined_once(spark):
    ids = spark.range(60).select("id", F.explode(F.sequence(F.lit(0), F.lit(9)).cast("array<long>")).alias("key")).where("id % 10 != key")
    members = ids.select("key", "id", F.lit(54).cast("long").alias("n"), F.lit(0).cast("long").alias("excess"), F.col("id").alias("component"))
    pairs = components._all_pairs(members, None)
    assert pairs.count() == 60 * 59 // 2
    rows = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" in rows  # a pair of eight common buckets came out eight times


def test_removed_lines_are_taken_out_without_splitting_anew_for_each(spark):
    """A text of many lines takes time in proportion to them: that it is split for each line took minutes."""
    lines = [hashlib.sha256(str(k).encode()).hexdigest() if k % 2 else "the same line stands here again and again" for k in range(20_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    began = time.time()
    (left,) = line_dedup.dedup_lines(docs).collect()
    took = time.time() - began
    assert left.text.split("\n") == [x for k, x in enumerate(lines) if k % 2 or k == 0]
    assert took < 60


def test_katz_keeps_buckets_in_place_of_hashes(spark):
    """What blocks travel with in each order has a fraction of the bytes of the words' hashes; sums of buckets hold no table."""
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(500))) for k in range(40)]
    table = katz.blocks(spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.lit(False)))
    size = lambda df: sum(len(x) for row in df.collect() for x in row if isinstance(x, (bytes, bytearray)))
    assert size(katz.asked(table, 23)) < size(table) / 2
    words = katz.answer_words(katz.ask_words(table, 3), 3).where("kind = 'model'").collect()
    assert sum(r["v"] for r in words) == 20_000 and all(r["body"] is None for r in words)


@pytest.mark.parametrize("least", [0, -5, -(1 << 40)])
def test_keys_are_sorted_as_one_or_apart(least):
    rng = np.random.default_rng(7)
    keys = [rng.integers(least, 9, 500), rng.integers(0, 5, 500), rng.integers(0, 1 << 33, 500)]
    got, want = katz.ordered(*keys), np.lexsort(keys[::-1])
    assert all((x[got] == x[want]).all() for x in keys)
