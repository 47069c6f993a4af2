"""Data checks: tables of violations, empty when all is well.

Values of panels and candidates are checked against a second computation by another plan: sorted histories in arrays, looked at from
each week, instead of windows and intervals. It costs a row's whole history for each week, so give ``ids`` to check some customers or items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.scalars import cosine
from .candidates import KEY
from .features import vector_means



def repeated_keys(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(keys or KEY)).agg(F.count("*").alias("n")).where("n > 1")


def wrong_labels(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Positives that nobody bought and negatives that somebody did."""
    bought = log.select(*KEY).distinct().withColumn("_bought", F.lit(1))
    return rows.join(bought, KEY, "left").where(F.col("label") != F.coalesce("_bought", F.lit(0))).drop("_bought")


def panel_gaps(panel: DataFrame, key: str, start: int, end: int) -> DataFrame:
    """Ids that don't have each week of ``start..end`` once."""
    per = panel.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct("week_num").alias("weeks"), F.min("week_num").alias("lo"), F.max("week_num").alias("hi"))
    return per.where((F.col("n") != end - start + 1) | (F.col("weeks") != F.col("n")) | (F.col("lo") != start) | (F.col("hi") != end))


def coverage(wanted: DataFrame, rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row: how many of the wanted keys are among the rows."""
    keys = keys or KEY
    have = rows.select(*keys).distinct().withColumn("_have", F.lit(1))
    return wanted.select(*keys).distinct().join(have, keys, "left").agg(F.count("*").alias("wanted"), F.count("_have").alias("found"))


def provenance(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The full outer join of two tables by ``keys`` with ``provenance``: left_only, right_only or both.

    Keys with a null meet no other and stay on their side. Columns that both tables have besides are the left's.
    """
    own = [c for c in right.columns if c in keys or c not in left.columns]
    joined = left.withColumn("_left", F.lit(1)).join(right.select(*own).withColumn("_right", F.lit(1)), keys, "full")
    kind = F.when(F.col("_right").isNull(), "left_only").when(F.col("_left").isNull(), "right_only").otherwise("both")
    return joined.withColumn("provenance", kind).drop("_left", "_right")


def candidate_coverage(candidates: DataFrame, log: DataFrame, start: int, end: int) -> DataFrame:
    """``week_num, source, provenance, n``: candidates that were bought (both) or not (left_only), by source, and purchases that no source
    offered (right_only, source "none")."""
    bought = log.where(F.col("week_num").between(start, end)).select(*KEY).distinct()
    rows = provenance(candidates.select(*KEY, "source"), bought, KEY)
    return rows.groupBy("week_num", F.coalesce("source", F.lit("none")).alias("source"), "provenance").agg(F.count("*").alias("n"))


def observed(df: DataFrame, name: str = "written") -> tuple[DataFrame, Observation]:
    """``df`` that measures itself while it is written: rows, first and last week, nulls of each column. No second pass is needed.

    After the write, ``observation.get`` has the figures; fit for tables with a week.
    """
    found = Observation(name)
    figures = [F.count("*").alias("n_rows"), F.count_if(F.greatest(*(F.col(c).isNull().cast("int") for c in df.columns), F.lit(0)) > 0).alias("rows_with_nulls")]
    if "week_num" in df.columns:
        figures += [F.min("week_num").alias("first_week"), F.max("week_num").alias("last_week")]
    return df.observe(found, *figures, *(F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in df.columns)), found


def violations_of(measured: dict, start: int, end: int, n_rows: int | None = None, nullable: tuple[str, ...] = ()) -> list[str]:
    """What is wrong by the figures of a written table: weeks outside of the range, missing rows, nulls in columns that have none."""
    out = [f"{side} week is {measured[f'{side}_week']}, not {week}" for side, week in (("first", start), ("last", end)) if measured[f"{side}_week"] != week]
    if n_rows is not None and measured["n_rows"] != n_rows:
        out.append(f"{measured['n_rows']} rows, not {n_rows}")
    return out + [f"{n} nulls in {c[6:]}" for c, n in measured.items() if c.startswith("nulls_") and n and c[6:] not in nullable]


def _of(df: DataFrame, ids: DataFrame | None, key: str) -> DataFrame:
    return df if ids is None else df.join(ids.select(key).distinct(), key, "left_semi")


def _differs(a: Column, b: Column, tolerance: float) -> Column:
    """Whether two numbers are further apart than a share of the second; nulls are equal to nulls only."""
    far = F.abs(a - b) > tolerance * F.greatest(F.lit(1.0), F.abs(b))
    return ~a.eqNullSafe(b) & F.coalesce(far, F.lit(True))


def panel_shape(panel: DataFrame, ids: DataFrame, key: str, start: int, end: int) -> DataFrame:
    """Ids that the panel lacks or has besides, and those without each week once."""
    known = provenance(panel.select(key).distinct(), ids.select(key).distinct(), [key]).where("provenance != 'both'")
    return known.select(key, "provenance").unionByName(panel_gaps(panel, key, start, end).select(key, F.lit("weeks").alias("provenance")))


def active_customers(log: DataFrame, start: int, end: int) -> DataFrame:
    """The customers that a customers' panel has."""
    return log.where(F.col("week_num").between(start, end)).select("customer_id").distinct()


def item_panel_differences(panel: DataFrame, log: DataFrame, customers: DataFrame, start: int, history: tuple[int, int], ids: DataFrame | None = None, tolerance: float = 1e-6) -> DataFrame:
    """Rows of an item panel whose sales, price, age or running count another plan doesn't find; prices and ages where there is one to find."""
    log = _of(log.where(F.col("week_num").between(*history)), ids, "article_id").join(customers.select("customer_id", "age"), "customer_id", "left")
    past = log.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("week_num", "customer_id", "age", "price"))).alias("past"))
    rows = _of(panel, ids, "article_id").join(past, "article_id", "left")
    until = F.filter(F.coalesce("past", F.array().cast(past.schema["past"].dataType)), lambda r: r["week_num"] <= F.col("week_num"))
    rows = rows.withColumn("_until", until)
    week = F.array_max(F.transform("_until", lambda r: r["week_num"]))
    rows = rows.withColumn("_last", F.when(week >= start, week))
    at = F.filter("_until", lambda r: r["week_num"] == F.col("_last"))
    rows = rows.withColumn("_sold", F.size(F.filter("_until", lambda r: r["week_num"] == F.col("week_num"))))
    rows = rows.withColumn("_price", F.aggregate(at, F.lit(0.0), lambda s, r: s + r["price"]) / F.when(F.size(at) > 0, F.size(at)))
    known = F.array_max(F.transform("_until", lambda r, k: F.when(r["age"].isNotNull() & (r["week_num"] >= start), k)))
    upto = F.slice("_until", F.lit(1), F.coalesce(known + 1, F.lit(0)))
    rows = rows.withColumn("_age", F.aggregate(upto, F.lit(0.0), lambda s, r: s + F.coalesce(r["age"], F.lit(0.0))) / (known + 1))
    rows = rows.withColumn("_so_far", F.when(F.col("_last").isNotNull(), F.size("_until")).otherwise(0))
    wrong = _differs(F.col("weekly_sales_count"), F.col("_sold"), 0) | _differs(F.col("cumulative_sales_count"), F.col("_so_far"), 0)
    for name, other in (("weekly_avg_price", "_price"), ("cumulative_mean_age", "_age")):
        wrong = wrong | (F.col(other).isNotNull() & _differs(F.col(name), F.col(other), tolerance))
    return rows.where(wrong).select("article_id", "week_num", "weekly_sales_count", "_sold", "weekly_avg_price", "_price", "cumulative_mean_age", "_age", "cumulative_sales_count", "_so_far")


def _latest_items(log: DataFrame, weeks: DataFrame, k: int) -> DataFrame:
    """``customer_id, week_num, items``: the k latest distinct items up to and with each week, from the customer's sorted history."""
    past = log.groupBy("customer_id").agg(F.collect_list(F.struct("t_dat", "article_id", "price", "sales_channel_id", "week_num")).alias("past"))
    day = lambda r: F.struct((-F.unix_date(r["t_dat"])).alias("d"), r["article_id"].alias("a"), r["price"].alias("p"), r["sales_channel_id"].alias("c"), r["week_num"].alias("w"))
    past = past.withColumn("past", F.array_sort(F.transform("past", day)))
    seen = F.filter("past", lambda r: r["w"] <= F.col("week_num"))
    first = F.filter(F.col("_seen"), lambda r, n: F.array_position(F.transform("_seen", lambda o: o["a"]), r["a"]) == n + 1)
    return weeks.join(past, "customer_id", "left").withColumn("_seen", seen).withColumn("items", F.slice(first, 1, k)).drop("past", "_seen")


def customer_panel_differences(panel: DataFrame, log: DataFrame, embeddings: DataFrame, history: tuple[int, int], k: int = 5, ids: DataFrame | None = None, tolerance: float = 1e-6) -> DataFrame:
    """Rows of a customer panel whose price or vector is not the mean of the k latest distinct items; only weeks in which one of these has a vector."""
    key = ["customer_id", "week_num"]
    rows = _of(panel, ids, "customer_id")
    own = _of(log.where(F.col("week_num").between(*history)), ids, "customer_id")
    items = _latest_items(own, rows.select(*key), k).select(*key, F.explode("items").alias("i")).select(*key, F.col("i.a").alias("article_id"), F.col("i.p").alias("_p"))
    items = items.join(embeddings.select("article_id", "vector"), "article_id", "left")
    price = items.groupBy(*key).agg(F.avg("_p").alias("_price"), F.count("vector").alias("_n")).where("_n > 0")
    vector = vector_means(items.where("vector is not null"), key).withColumnRenamed("vector", "_vector")
    joined = rows.join(price, key).join(vector, key)
    apart = F.aggregate(F.zip_with("customer_avg_embedding", "_vector", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: F.greatest(s, x))
    wrong = _differs(F.col("customer_avg_price"), F.col("_price"), tolerance) | F.coalesce(apart > tolerance, F.lit(True))
    return joined.where(wrong).select(*key, "customer_avg_price", "_price", apart.alias("apart"))


def candidate_shape(rows: DataFrame, log: DataFrame, start: int, end: int) -> DataFrame:
    """Candidates' weeks outside of ``start..end``, and customers' weeks with purchases but without candidates, or the other way round."""
    outside = rows.where(~F.col("week_num").between(start, end)).select("customer_id", "week_num", F.lit("week").alias("provenance")).distinct()
    bought = log.where(F.col("week_num").between(start, end)).select("customer_id", "week_num").distinct()
    known = provenance(rows.select("customer_id", "week_num").distinct(), bought, ["customer_id", "week_num"])
    return outside.unionByName(known.where("provenance != 'both'").select("customer_id", "week_num", "provenance"))


def positives_not_bought(rows: DataFrame, log: DataFrame, restricted: bool = True) -> DataFrame:
    """Positives that nobody bought; if positives are restricted to candidates, also those that no source offered."""
    positive = rows.where("label = 1")
    wrong = positive.join(log.select(*KEY).distinct(), KEY, "left_anti")
    return wrong.unionByName(positive.where("source = 'positive'")).distinct() if restricted else wrong


def negatives_bought(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Negatives that somebody bought."""
    return rows.where("label = 0").join(log.select(*KEY).distinct(), KEY, "left_semi")


def last_purchases_missing(rows: DataFrame, log: DataFrame, start: int, end: int, default_week: int | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Purchases that are no candidates of the customer's next week with purchases, if that is in ``start..end``.

    The next week is sought among the set of the customer's weeks; after the last one it is ``default_week``, or none.
    """
    log = _of(log, ids, "customer_id").select(*KEY).distinct()
    weeks = log.groupBy("customer_id").agg(F.collect_set("week_num").alias("weeks"))
    after = F.array_min(F.filter("weeks", lambda w: w > F.col("week_num")))
    weeks = weeks.select("customer_id", "weeks", F.explode("weeks").alias("week_num")).withColumn("next", F.coalesce(after, F.lit(default_week).cast("int"))).drop("weeks")
    wanted = log.join(weeks, ["customer_id", "week_num"]).where(F.col("next").between(start, end)).select("customer_id", F.col("next").alias("week_num"), "article_id")
    return wanted.select(*KEY).distinct().join(rows.select(*KEY).distinct(), KEY, "left_anti")


def last_k_missing(rows: DataFrame, log: DataFrame, start: int, end: int, k: int, ids: DataFrame | None = None) -> DataFrame:
    """The k latest rows (by week, then item) before each week with candidates that are no candidates of it."""
    past = _of(log, ids, "customer_id").select(*KEY).distinct().groupBy("customer_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("week_num")).alias("w"), F.col("article_id").alias("a")))).alias("past"))
    weeks = _of(rows, ids, "customer_id").where(F.col("week_num").between(start, end)).select("customer_id", "week_num").distinct()
    before = F.filter("past", lambda r: -r["w"] < F.col("week_num"))
    wanted = weeks.join(past, "customer_id").select("customer_id", "week_num", F.explode(F.slice(before, 1, k)).alias("r")).select("customer_id", "week_num", F.col("r.a").alias("article_id")).distinct()
    return wanted.join(rows.select(*KEY).distinct(), KEY, "left_anti")


def repurchases_missing(rows: DataFrame, log: DataFrame, strategy: str, start: int, end: int, k: int = 12, default_week: int | None = None, ids: DataFrame | None = None) -> DataFrame:
    """What a repurchase strategy must have offered and hasn't; rows that were down-sampled can't be checked."""
    if strategy == "last_purchase":
        return last_purchases_missing(rows, log, start, end, default_week, ids)
    if strategy == "last_k_items":
        return last_k_missing(rows, log, start, end, k, ids)
    raise ValueError(f"no such strategy: {strategy}")


def candidate_checks(rows: DataFrame, log: DataFrame, strategy: str, start: int, end: int, k: int = 12, restricted: bool = True, ids: DataFrame | None = None) -> dict[str, DataFrame]:
    """All checks of labelled candidates by name."""
    return {
        "shape": candidate_shape(rows, log, start, end),
        "repeated": repeated_keys(rows),
        "positives": positives_not_bought(rows, log, restricted),
        "negatives": negatives_bought(rows, log),
        "repurchases": repurchases_missing(rows, log, strategy, start, end, k, ids=ids),
    }


def _week_before(panel: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return panel.select(key, (F.col("week_num") + 1).alias("week_num"), *(F.col(c).alias(f"_{c}") for c in columns))


def feature_differences(matrix: DataFrame, panel: DataFrame, key: str, columns: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Rows of a matrix whose features are not those of the panel's week before, or that the panel lacks."""
    joined = matrix.join(_week_before(panel, key, columns).withColumn("_there", F.lit(1)), [key, "week_num"], "left")
    wrong = F.col("_there").isNull()
    for c in columns:
        wrong = wrong | _differs(F.col(c), F.col(f"_{c}"), tolerance)
    return joined.where(wrong).select(*KEY, *columns, *(f"_{c}" for c in columns))


def customer_price_differences(matrix: DataFrame, panel: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Rows whose mean price is not that of the customer's week before; so a customer's week has one price."""
    return feature_differences(matrix, panel, "customer_id", ["customer_avg_price"], tolerance)


def item_feature_differences(matrix: DataFrame, panel: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Rows whose sales, price, age and running count are not those of the item's week before."""
    return feature_differences(matrix, panel, "article_id", ["weekly_sales_count", "weekly_avg_price", "cumulative_sales_count", "cumulative_mean_age"], tolerance)


def similarity_differences(matrix: DataFrame, panel: DataFrame, embeddings: DataFrame, tolerance: float = 1e-6, column: str = "similarity", own: str = "customer_avg_embedding", vector: str = "vector") -> DataFrame:
    """Rows whose similarity is not the cosine of the customer's vector of the week before and the item's; 0 without either."""
    joined = matrix.join(_week_before(panel, "customer_id", [own]), ["customer_id", "week_num"], "left").join(embeddings.select("article_id", F.col(vector).alias("_vector")), "article_id", "left")
    return joined.withColumn("_cosine", cosine(F.col(f"_{own}"), F.col("_vector"))).where(_differs(F.col(column), F.col("_cosine"), tolerance)).select(*KEY, column, "_cosine")


def matrix_shape(matrix: DataFrame, candidates: DataFrame) -> DataFrame:
    """Keys that the matrix lost, made up or repeated: its weeks, customers, items and rows are the candidates'."""
    n = lambda rows, name: rows.groupBy(*KEY).agg(F.count("*").alias(name))
    both = provenance(n(matrix, "in_matrix"), n(candidates, "in_candidates"), KEY)
    return both.where("provenance != 'both' or in_matrix != in_candidates or in_matrix > 1")


def matrix_nulls(matrix: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, n``: columns with missing values; a name that stands twice is an error."""
    columns = columns or matrix.columns
    if twice := sorted({c for c in columns if columns.count(c) > 1}):
        raise ValueError(f"columns stand twice: {twice}")
    counts = matrix.agg(F.array(*(F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("n")) for c in columns)).alias("x"))
    return counts.select(F.explode("x").alias("x")).select("x.*").where("n > 0")


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """``check, violations`` of several checks."""
    found = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations") for name, df in checks.items()]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
