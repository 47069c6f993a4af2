"""Queries of the retrieval and ranking operators over the test tables, and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import scalars as S
from ..operators import candidates as O
from ..operators import checks, features, listwise, popularity, profiles, ranking, repurchase, subsets
from ..operators.incremental import PanelStore
from ..operators.runs import marked
from ..sources.scratch import new_dir, stored
from ..sources.tables import Domain
from ..streaming import weekly
from ..streaming.rolling import RollingPopularity
from .oracle import FIRST, GRID, HISTORY, K, LAST, NEXT, seeded, sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
STATIC = ["club_member_status", "fashion_news_frequency", "postal_code", "age_bin"]
CODES = ["brand", "type", "size"]
FEATURES = ["bestseller_rank", "price", "age", "weekly_sales_count", "weekly_avg_price", "cumulative_mean_age", "cumulative_sales_count", "customer_avg_price", "similarity", "age_difference", "price_difference"]


def query(oracle: str | None):
    def add(f):
        name = f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Domain(spark, sf_dir))

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def calendar(d: Domain) -> C.Calendar:
    return C.Calendar(d.table("orders").agg(F.to_date(F.max("o_orderdate"))).first()[0])


def samples(d: Domain, restrict: bool = False):
    """(log, positives, candidates, popular items) of the training weeks; with ``restrict``, candidates that were bought are taken out."""
    log = d.transactions
    positives = O.positive_samples(log, FIRST, LAST)
    pairs = positives.select("customer_id", "week_num").distinct()
    rows, popular = O.negative_samples(log, pairs, FIRST, LAST, K, restrict=restrict)
    return log, positives, rows, popular


def customer_static(d: Domain) -> DataFrame:
    return features.customer_features(d.customers, STATIC, fill={"fashion_news_frequency": "unknown"})


def article_static(d: Domain) -> DataFrame:
    articles = d.articles.drop("name")
    return features.encoded(articles, features.ordinal_codes(articles, CODES), CODES)


def item_panel(d: Domain, log: DataFrame | None = None) -> DataFrame:
    return features.item_week_panel(log or d.transactions, d.articles, d.customers, *GRID, HISTORY)


def customer_panel(d: Domain, log: DataFrame | None = None) -> DataFrame:
    return features.customer_week_panel(log or d.transactions, d.embeddings, *GRID, HISTORY)


def with_features(d: Domain, rows: DataFrame, log: DataFrame, items: DataFrame | None = None, people: DataFrame | None = None) -> DataFrame:
    """``rows`` with all features; every table marks the kinds of its columns, and the matrix keeps the marks. Panels that are there already are not made again."""
    numbers = lambda df, *columns: marked(df, "numerical", list(columns))
    rows = marked(numbers(rows, "bestseller_rank", "price"), "id", O.KEY)
    articles, customers = marked(article_static(d), "categorical", CODES), numbers(marked(customer_static(d), "categorical", STATIC), "age")
    items = numbers(items or item_panel(d, log), "weekly_sales_count", "weekly_avg_price", "cumulative_mean_age", "cumulative_sales_count")
    people = numbers(people or customer_panel(d, log), "customer_avg_price")
    return numbers(ranking.ranking_matrix(rows, articles, customers, items, people, d.embeddings), "similarity", "age_difference", "age_ratio", "price_difference", "price_ratio")


def matrix(d: Domain) -> DataFrame:
    """The training matrix. The log is joined once and written; candidates and both panels read what they need of it."""
    log = stored(d.transactions.drop("quantity"), "log")
    return with_features(d, O.training_candidates(log, FIRST, LAST, calendar(d), K), log)


def ranker_rows(d: Domain) -> DataFrame:
    """What rankers read of the matrix, stored: they go over their rows several times."""
    return stored(matrix(d).select(*O.KEY, "label", *FEATURES), "matrix")


DAY = "((select d from mx) + 1 - (105 - week_num) * 7)"


@query(sql(f"select distinct cast(t_dat as varchar) as day, week_num, cast({DAY} as varchar) as week_start, cast(cast(t_dat - cast((isodow(t_dat) + 4) % 7 as integer) as date) as varchar) as wednesday, cast(year({DAY}) as integer) as year, cast(month({DAY}) as integer) as month from tx", "tx"))
def week_calendar(d: Domain) -> DataFrame:
    cal = calendar(d)
    days = d.transactions.select("t_dat", "week_num").distinct()
    start = cal.week_start(F.col("week_num"))
    dated = C.date_features(days, start)
    return dated.select(F.col("t_dat").cast("string").alias("day"), "week_num", start.cast("string").alias("week_start"), C.wednesday(F.col("t_dat")).cast("string").alias("wednesday"), "year", "month")


@query(sql("select case when t_dat > d - 7 then 'test' when t_dat > d - 14 then 'valid' else 'train' end as split, count(*) as n, count(distinct customer_id) as customers from tx, mx group by all", "tx"))
def temporal_split_counts(d: Domain) -> DataFrame:
    cal = calendar(d)
    split = C.split_of(F.col("t_dat"), F.lit(cal.start_of(103)), F.lit(cal.start_of(104)))
    return d.transactions.groupBy(split.alias("split")).agg(F.count("*").alias("n"), F.count_distinct("customer_id").alias("customers"))


@query(sql("select customer_id, array_to_string(list(article_id order by t_dat, article_id), ' ') as articles from tx group by all", "tx"))
def customer_article_mapping(d: Domain) -> DataFrame:
    return subsets.customer_items(d.transactions).select("customer_id", F.array_join(F.col("articles").cast("array<string>"), " ").alias("articles"))


@query(sql("select * from popular", "popular"))
def weekly_popular_items(d: Domain) -> DataFrame:
    return popularity.weekly_popular_items(d.transactions, K)


def _rolled(rows: str) -> str:
    """Sums over four weeks by moving each week's sums, then zeros for the smallest items."""
    return sql(
        f"""select week_num, article_id, total, place from (select *, row_number() over (partition by week_num order by total desc, article_id) as place from (
  select week_num, article_id, sum(v) as total from (
    select s.week_num + m.m as week_num, article_id, v from (select week_num, article_id, {rows} as v from tx group by all) s, (select unnest(range(0, 4))::integer as m) m
    where s.week_num + m.m <= (select max(week_num) from tx)
    union all select w.week_num, a.article_id, 0 from (select distinct article_id from tx) a, (select distinct week_num from tx) w) group by all)) where place <= {K}""",
        "tx",
    )


@query(_rolled("count(*)"))
def rolling_popular_items(d: Domain) -> DataFrame:
    return popularity.rolling_popular_items(d.transactions, 4, K)


@query(_rolled("sum(quantity)"))
def rolling_popular_quantity(d: Domain) -> DataFrame:
    return popularity.rolling_popular_items(d.transactions, 4, K, value="quantity")


@query(sql("select * from stats", "stats"))
def article_weekly_stats(d: Domain) -> DataFrame:
    return popularity.item_week_stats(d.transactions)


@query(sql(f"select article_id, bestseller_rank from popular where week_num = {NEXT - 1}", "popular"))
def default_prediction(d: Domain) -> DataFrame:
    return popularity.default_prediction(popularity.weekly_popular_items(d.transactions, K), NEXT)


@query(sql("select * from popularity", "popularity"))
def popularity_candidates(d: Domain) -> DataFrame:
    log = d.transactions
    pairs = log.where(F.col("week_num").between(FIRST, LAST)).select("customer_id", "week_num")
    before = log.where(F.col("week_num").between(FIRST - 1, LAST - 1))
    return popularity.popularity_samples(pairs, popularity.weekly_popular_items(before, K), popularity.item_week_stats(before))


@query(sql("select * from weeks", "weeks"))
def next_purchase_week(d: Domain) -> DataFrame:
    return repurchase.next_purchase_week(d.transactions)


@query(sql("select * from last_purchase", "last_purchase"))
def repurchase_last_purchase(d: Domain) -> DataFrame:
    return repurchase.repurchase_samples(d.transactions, "last_purchase", FIRST, LAST)


@query(sql("select * from last_k", "last_k"))
def repurchase_last_k(d: Domain) -> DataFrame:
    return repurchase.repurchase_samples(d.transactions, "last_k_items", FIRST, LAST, K)


@query(sql("select * from unseen", "unseen"))
def combined_candidates(d: Domain) -> DataFrame:
    return samples(d, restrict=True)[2]


@query(sql("select * from positives", "positives"))
def positive_samples(d: Domain) -> DataFrame:
    return O.positive_samples(d.transactions, FIRST, LAST)


@query(sql(f"select * exclude (r) from (select *, row_number() over (partition by customer_id, week_num order by {seeded('customer_id', 'week_num', 'article_id')}, article_id) as r from positives) where r <= 2", "positives"))
def positive_samples_limited(d: Domain) -> DataFrame:
    return O.positive_samples(d.transactions, FIRST, LAST, most=2)


@query(sql("select * from labelled", "labelled"))
def labelled_candidates(d: Domain) -> DataFrame:
    _, positives, rows, _ = samples(d)
    return O.labelled(positives, rows, restrict=True)


@query(sql("select *, 1 as label from positives union all by name select *, 0 as label from unseen", "positives", "unseen"))
def unrestricted_samples(d: Domain) -> DataFrame:
    _, positives, rows, _ = samples(d, restrict=True)
    return O.labelled(positives, rows, restrict=False)


@query(
    sql(
        f"""select * exclude (r, n, pos, neg) from (select l.*, row_number() over (partition by customer_id, week_num, label order by {seeded('customer_id', 'week_num', 'article_id')}, article_id) as r,
  count(*) over (partition by customer_id, week_num, label) as n, (select sum(label) from labelled) as pos, (select count(*) from labelled where label = 0) as neg from labelled l)
where label = 1 or pos = 0 or r <= round_even(least(1.0::double, 5.0::double * pos::double / neg::double) * n, 0)""",
        "labelled",
    )
)
def neg_pos_ratio_downsample(d: Domain) -> DataFrame:
    _, positives, rows, _ = samples(d)
    return O.downsampled(O.labelled(positives, rows, restrict=True), 5)


@query(sql("select * from dated", "dated"))
def candidate_features(d: Domain) -> DataFrame:
    return O.training_candidates(d.transactions, FIRST, LAST, calendar(d), K)


@query(
    sql(
        """select * exclude (d0), year(d0) as year, month(d0) as month, strftime(d0, '%Y-%m-%d') as week from (select *, (select d from mx) - 6 as d0 from offered_to_all)""",
        "offered_to_all",
    )
)
def inference_candidates(d: Domain) -> DataFrame:
    """Candidates of the target week for all customers who bought up to or in it."""
    log = d.transactions
    return O.inference_candidates(log, NEXT, calendar(d), K, customers=log.where(F.col("week_num") <= NEXT))


@query(sql("select * from static", "static"))
def static_customer_features(d: Domain) -> DataFrame:
    return customer_static(d)


@query(sql("""select * from (select 'brand' as column, v as value, cast(row_number() over (order by v) - 1 as double) as code from (select distinct p_brand as v from part)
union all select 'type', v, cast(row_number() over (order by v) - 1 as double) from (select distinct p_type as v from part)
union all select 'size', v, cast(row_number() over (order by v) - 1 as double) from (select distinct cast(p_size as varchar) as v from part))"""))
def ordinal_codes(d: Domain) -> DataFrame:
    return features.ordinal_codes(d.articles, CODES)


@query(sql("select * from articles", "articles"))
def static_article_features(d: Domain) -> DataFrame:
    return article_static(d)


@query("select p_partkey as article_id, coalesce(p_name, '') || ' ' || coalesce(p_brand, '') || ' ' || coalesce(p_type, '') as text from part")
def article_text(d: Domain) -> DataFrame:
    return d.articles.select("article_id", S.joined_text("name", "brand", "type").alias("text"))


@query(sql("select article_id, week_num, weekly_sales_count, round(weekly_avg_price, 3) as weekly_avg_price, cumulative_mean_age, cumulative_sales_count from item_panel", "item_panel"))
def article_week_panel(d: Domain) -> DataFrame:
    return item_panel(d).withColumn("weekly_avg_price", F.round("weekly_avg_price", 3))


LATE = (103, 104)


def appended(d: Domain) -> PanelStore:
    """Panels of the last two weeks, each appended to the state that the week before left."""
    log = stored(d.transactions.where(F.col("week_num").between(*HISTORY)), "log")
    store = PanelStore(d.spark, new_dir(d.spark, "panels"), LATE[0])
    store.begin(log, d.customers)
    for week in range(LATE[0], LATE[1] + 1):
        store.append(log, week, d.articles, d.customers, d.embeddings)
    return store


@query(sql(f"select article_id, week_num, weekly_sales_count, round(weekly_avg_price, 3) as weekly_avg_price, cumulative_mean_age, cumulative_sales_count from item_panel where week_num = {LATE[1]}", "item_panel", grid=LATE))
def appended_item_week(d: Domain) -> DataFrame:
    return appended(d).item_panel().where(F.col("week_num") == LATE[1]).withColumn("weekly_avg_price", F.round("weekly_avg_price", 3))


@query(sql(f"select customer_id, week_num, round(customer_avg_price, 3) as customer_avg_price, round(list_sum(vector), 6) as vector_sum from customer_panel where week_num = {LATE[1]}", "customer_panel", grid=LATE))
def appended_customer_week(d: Domain) -> DataFrame:
    total = F.aggregate("customer_avg_embedding", F.lit(0.0), lambda s, x: s + x)
    return appended(d).customer_panel().where(F.col("week_num") == LATE[1]).select("customer_id", "week_num", F.round("customer_avg_price", 3).alias("customer_avg_price"), F.round(total, 6).alias("vector_sum"))


@query(sql("select * from latest", "latest"))
def customer_last_k(d: Domain) -> DataFrame:
    log = d.transactions.where(F.col("week_num").between(*HISTORY))
    return repurchase.last_k_distinct(log, 5, *GRID)


@query(sql("select customer_id, week_num, round(customer_avg_price, 3) as customer_avg_price, round(list_sum(vector), 6) as vector_sum from customer_panel", "customer_panel"))
def customer_week_panel(d: Domain) -> DataFrame:
    total = F.aggregate("customer_avg_embedding", F.lit(0.0), lambda s, x: s + x)
    return customer_panel(d).select("customer_id", "week_num", F.round("customer_avg_price", 3).alias("customer_avg_price"), F.round(total, 6).alias("vector_sum"))


@query("select label, i - 1 as place, round(avg(x), 6) as mean from (select label, unnest(embedding::double[]) as x, unnest(range(1, len(embedding) + 1)) as i from embeddings) group by all")
def vector_mean(d: Domain) -> DataFrame:
    means = features.vector_means(d.table("embeddings"), ["label"], "embedding")
    return means.select("label", F.posexplode("embedding").alias("place", "x")).select("label", F.col("place").cast("bigint").alias("place"), F.round("x", 6).alias("mean"))


@query("select a.vec_id as article_id, b.vec_id as other_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as similarity from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def embedding_cosine(d: Domain) -> DataFrame:
    e = d.embeddings
    other = e.select((F.col("article_id") - 1).alias("article_id"), F.col("article_id").alias("other_id"), F.col("vector").alias("other"))
    return e.join(other, "article_id").select("article_id", "other_id", F.round(S.cosine(F.col("vector"), F.col("other")), 6).alias("similarity"))


@query(
    sql(
        """select * exclude (exact_price), round(s.age - cumulative_mean_age, 6) as age_difference, round((s.age - cumulative_mean_age) / s.age, 6) as age_ratio,
  round(case when exact_price <> 0 then (price - exact_price) / exact_price end, 6) as price_ratio from (
  select p.customer_avg_price as exact_price, c.customer_id, c.week_num, c.article_id, c.label, c.source, c.bestseller_rank, c.price, a.brand, a.type, a.size, i.weekly_sales_count, i.cumulative_mean_age, i.cumulative_sales_count,
    round(p.customer_avg_price, 3) as customer_avg_price, round(i.weekly_avg_price, 3) as weekly_avg_price,
    round(case when p.vector is null or e.embedding is null then 0.0 else list_cosine_similarity(p.vector, e.embedding::double[]) end, 5) as similarity
  from dated c left join articles a on a.article_id = c.article_id
  left join item_panel i on i.article_id = c.article_id and i.week_num = c.week_num - 1
  left join customer_panel p on p.customer_id = c.customer_id and p.week_num = c.week_num - 1
  left join embeddings e on e.vec_id = c.article_id) left join (select customer_id, age from static) s using (customer_id)""",
        "dated",
        "articles",
        "static",
        "item_panel",
        "customer_panel",
    )
)
def ranker_matrix(d: Domain) -> DataFrame:
    rounded = {"customer_avg_price": 3, "weekly_avg_price": 3, "similarity": 5, "age_difference": 6, "age_ratio": 6, "price_ratio": 6}
    plain = ["customer_id", "week_num", "article_id", "label", "source", "bestseller_rank", "price", "brand", "type", "size", "weekly_sales_count", "cumulative_mean_age", "cumulative_sales_count", "age"]
    return matrix(d).select(*plain, *(F.round(c, n).alias(c) for c, n in rounded.items()))


@query(
    sql(
        f"""select m.*, round(s.age - cumulative_mean_age, 6) as age_difference from (
  select c.customer_id, c.week_num, c.article_id, c.source, c.bestseller_rank, c.price, a.brand, i.weekly_sales_count, i.cumulative_mean_age, i.cumulative_sales_count,
    round(p.customer_avg_price, 3) as customer_avg_price, round(case when p.vector is null or e.embedding is null then 0.0 else list_cosine_similarity(p.vector, e.embedding::double[]) end, 5) as similarity
  from offered c left join articles a on a.article_id = c.article_id
  left join item_panel i on i.article_id = c.article_id and i.week_num = {NEXT - 1}
  left join customer_panel p on p.customer_id = c.customer_id and p.week_num = {NEXT - 1}
  left join embeddings e on e.vec_id = c.article_id) m left join (select customer_id, age from static) s using (customer_id)""",
        "offered",
        "articles",
        "static",
        "item_panel",
        "customer_panel",
    )
)
def inference_matrix(d: Domain) -> DataFrame:
    """What the ranker scores: the candidates of the target week with the features of the week before."""
    log = stored(d.transactions.drop("quantity"), "log")
    rows = with_features(d, O.inference_candidates(log, NEXT, calendar(d), K), log)
    rounded = {"customer_avg_price": 3, "similarity": 5, "age_difference": 6}
    plain = ["customer_id", "week_num", "article_id", "source", "bestseller_rank", "price", "brand", "weekly_sales_count", "cumulative_mean_age", "cumulative_sales_count"]
    return rows.select(*plain, *(F.round(c, n).alias(c) for c, n in rounded.items()))


@query(sql("select customer_id, week_num, count(*) as n from labelled group by all", "labelled"))
def group_sizes(d: Domain) -> DataFrame:
    _, positives, rows, _ = samples(d)
    return ranking.group_sizes(O.labelled(positives, rows, restrict=True))


def precision(d: Domain) -> DataFrame:
    log, _, rows, _ = samples(d)
    return ranking.precision_by_customer(ranking.actual_lists(log, FIRST, LAST), ranking.ranked_lists(rows, "price", K), K)


@query(sql("select customer_id, week_num, round(ap, 9) as ap, round(ideal_ap, 9) as ideal_ap from precision", "precision"))
def ap_at_k(d: Domain) -> DataFrame:
    return precision(d).select("customer_id", "week_num", F.round("ap", 9).alias("ap"), F.round("ideal_ap", 9).alias("ideal_ap"))


@query(sql("select count(*) as customers, round(avg(ap), 9) as map, round(avg(ideal_ap), 9) as ideal_map from precision", "precision"))
def map_at_k(d: Domain) -> DataFrame:
    log, _, rows, _ = samples(d)
    found = ranking.mean_precision(ranking.actual_lists(log, FIRST, LAST), ranking.ranked_lists(rows, "price", K), K)
    return found.select("customers", F.round("map", 9).alias("map"), F.round("ideal_map", 9).alias("ideal_map"))


@query(sql("select week_num, count(*) as customers, round(avg(ap), 9) as map, round(avg(ideal_ap), 9) as ideal_map from precision group by all", "precision"))
def map_by_week(d: Domain) -> DataFrame:
    log, _, rows, _ = samples(d)
    found = ranking.mean_precision(ranking.actual_lists(log, FIRST, LAST), ranking.ranked_lists(rows, "price", K), K, by_week=True)
    return found.select("week_num", "customers", F.round("map", 9).alias("map"), F.round("ideal_map", 9).alias("ideal_map"))


HEURISTIC_AP = f"""
  select a.customer_id, a.week_num, coalesce(h.s, 0) / least(a.n, {K}) as ap from (select customer_id, week_num, count(*) as n from actual group by all) a
  left join (select customer_id, week_num, sum(hit / place) as s from (
    select a.customer_id, a.week_num, p.place, row_number() over (partition by a.customer_id, a.week_num order by p.place) as hit from actual a
    join (select week_num + 1 as week_num, article_id, row_number() over (partition by week_num order by bestseller_rank, article_id) as place from popular) p on p.week_num = a.week_num and p.article_id = a.article_id) group by all) h
  on h.customer_id = a.customer_id and h.week_num = a.week_num"""


@query(
    sql(
        f"""select week_num, count(*) as customers, round(avg(ap), 9) as map from ({HEURISTIC_AP}) group by all""",
        "actual",
        "popular",
    )
)
def heuristic_map(d: Domain) -> DataFrame:
    log = d.transactions
    actual = ranking.actual_lists(log, FIRST, LAST)
    found = ranking.mean_precision(actual, ranking.heuristic_lists(actual, popularity.weekly_popular_items(log, K), K), K, by_week=True)
    return found.select("week_num", "customers", F.round("map", 9).alias("map"))


@query(
    sql(
        f"""select count(*) as customers, round(avg(ap), 9) as map_model, round((select avg(ap) from ({HEURISTIC_AP})), 9) as map_heuristic, round(avg(ideal_ap), 9) as map_ideal
from precision""",
        "precision",
        "actual",
        "popular",
    )
)
def evaluator(d: Domain) -> DataFrame:
    log, _, rows, _ = samples(d)
    actual = ranking.actual_lists(log, FIRST, LAST)
    popular = popularity.weekly_popular_items(d.transactions, K)
    found = ranking.evaluation(actual, ranking.ranked_lists(rows, "price", K), ranking.heuristic_lists(actual, popular, K), K)
    return found.select("customers", *(F.round(c, 9).alias(c) for c in ("map_model", "map_heuristic", "map_ideal")))


@query(
    sql(
        f"""select t.customer_id, count(*) as n, sum(t.price) as total from tx t join (
  select customer_id from (select c_custkey as customer_id, row_number() over (order by {seeded('c_custkey')}, c_custkey) as r, count(*) over () as n from customer)
  where r <= round_even(0.25 * n, 0)) s on s.customer_id = t.customer_id group by all""",
        "tx",
    )
)
def exact_subsample(d: Domain) -> DataFrame:
    kept, _, _ = subsets.subsample(d.transactions, d.customers, d.articles, 0.25)
    return kept.groupBy("customer_id").agg(F.count("*").alias("n"), F.sum("price").alias("total"))


@query("select c_custkey as customer_id, cast(c_custkey * 1000003 + 77 as varchar) as number, '0' || c_custkey as padded from customer")
def hex_id_parse(d: Domain) -> DataFrame:
    text = F.concat(F.lit("00feedfacecafebeef"), F.lpad(F.hex(F.col("customer_id") * 1000003 + 77), 16, "0"))
    return d.customers.select("customer_id", S.hex_id(text).cast("string").alias("number"), S.padded_id(F.col("customer_id")).alias("padded"))


@query(sql(" union all ".join(f"select '{c}' as column, count(*) as n_rows, count(*) - count({c}) as n_nulls, count(distinct {c}) as n_distinct from customers" for c in ("customer_id", "age", "club_member_status", "fashion_news_frequency", "postal_code")), "customers"))
def profile_nulls(d: Domain) -> DataFrame:
    return profiles.null_profile(d.customers)


@query(None)
def gbt_rank_topk(d: Domain) -> DataFrame:
    """The five best candidates of each customer and week by gradient-boosted trees."""
    rows = ranker_rows(d)
    ranker = ranking.GbtRanker(ranking.RankerConfig(FEATURES)).train(rows.where(F.col("week_num") < LAST))
    return ranker.ranks(rows.where(F.col("week_num") == LAST), 5)


LISTWISE = listwise.LambdaConfig(FEATURES, trees=6, depth=3, patience=2)


def listwise_ranker(d: Domain):
    """(matrix, ranker): learnt from the weeks before the last but one, stopped by that one."""
    rows = ranker_rows(d)
    week = F.col("week_num")
    return rows, listwise.LambdaRanker(LISTWISE).train(rows.where(week < LAST - 1), rows.where(week == LAST - 1))


@query(None)
def lambda_rank_topk(d: Domain) -> DataFrame:
    """The five best candidates of each customer of the last week by trees boosted on NDCG gradients."""
    rows, ranker = listwise_ranker(d)
    return ranker.ranks(rows.where(F.col("week_num") == LAST), 5)


@query(sql(f"select count(*) as customers, true as valid_not_worse, true as at_least_worst, true as at_most_best from (select distinct customer_id from tx where week_num = {LAST})", "tx"))
def listwise_bound(d: Domain) -> DataFrame:
    """Customers with purchases in the last week, and what holds for the listwise ranker whatever the purchases are: on the weeks that stop
    it, the trees that it keeps are no worse than none, and its MAP of the last week lies between those of the worst and the best
    order of its candidates. (The test tables' purchases are random: no order is better than another on later weeks.)"""
    rows, ranker = listwise_ranker(d)
    kept, start = ranker.history[ranker.best_round()]["valid"], ranker.history[0]["valid"]
    last = rows.where(F.col("week_num") == LAST)
    actual = ranking.actual_lists(d.transactions, LAST, LAST)
    found = ranking.mean_precision(actual, ranker.ranks(last, K), K)
    worst = ranking.mean_precision(actual, ranking.ranked_lists(last.withColumn("score", -F.col("label")), k=K), K).select(F.col("map").alias("worst"))
    best = ranking.mean_precision(actual, ranking.ranked_lists(last, "label", K), K).select(F.col("map").alias("best"))
    bounds = found.join(worst).join(best)
    return bounds.select("customers", F.lit((kept or 0.0) >= (start or 0.0)).alias("valid_not_worse"), (F.col("map") >= F.col("worst") - 1e-9).alias("at_least_worst"), (F.col("map") <= F.col("best") + 1e-9).alias("at_most_best"))


NUMBERS = ("customer_id", "week_num", "article_id", "price", "sales_channel_id", "quantity")


@query(
    sql(
        " union all ".join(
            f"""select '{c}' as column, count({c}) as n, round(avg({c}::double), 6) as mean, round(stddev_samp({c}::double), 6) as std, min({c})::double as min, quantile_cont({c}::double, 0.25) as q1,
  quantile_cont({c}::double, 0.5) as median, quantile_cont({c}::double, 0.75) as q3, max({c})::double as max from tx"""
            for c in NUMBERS
        ),
        "tx",
    )
)
def profile_describe(d: Domain) -> DataFrame:
    found = profiles.described(d.transactions, list(NUMBERS))
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query(
    sql(
        "select * from (select *, cast(row_number() over (partition by \"column\" order by n desc, value nulls last) as integer) as place from ("
        + " union all ".join(f"select '{c}' as column, cast({c} as varchar) as value, count(*) as n from customers group by all" for c in ("club_member_status", "fashion_news_frequency", "postal_code"))
        + ")) where place <= 5",
        "customers",
    )
)
def profile_top_values(d: Domain) -> DataFrame:
    return profiles.top_values(d.customers, 5, ["club_member_status", "fashion_news_frequency", "postal_code"])


@query(sql(" union all ".join(f"select '{c}' as column, count(*) as n_rows, count(*) - count({c}) as n_nulls, true as distinct_close, true as median_close, true as top_close from tx" for c in NUMBERS), "tx"))
def profile_sketches(d: Domain) -> DataFrame:
    """Sketches by week, merged: whether distinct counts are within 3 %, medians within 1 % of the ranks, and the top value's count within 1 / FREQUENT of the rows."""
    log = d.transactions.select(*NUMBERS)
    weekly = profiles.sketched(log.withColumn("_week", F.col("week_num")), list(NUMBERS), by=["_week"])
    found = profiles.estimated(profiles.merged(weekly), 1, (0.5,))
    counts = profiles.value_counts(log)
    exact = counts.groupBy("column").agg(F.count("value").alias("distinct"), F.max("n").alias("top_n"))
    median = found.select("column", F.col("quantiles")[0].alias("m"))
    values = counts.join(F.broadcast(median), "column").withColumn("v", F.col("value").cast("double"))
    ranks = values.groupBy("column").agg(F.sum(F.when(F.col("v") <= F.col("m"), F.col("n")).otherwise(0)).alias("upto"), F.sum(F.when(F.col("v") < F.col("m"), F.col("n")).otherwise(0)).alias("below"))
    joined = found.join(exact, "column").join(ranks, "column")
    far = F.col("top_n") - F.coalesce(F.get("top", F.lit(0))["count"], F.lit(0))
    return joined.select(
        "column", "n_rows", "n_nulls", (F.abs(F.col("n_distinct") - F.col("distinct")) <= 0.03 * F.col("distinct")).alias("distinct_close"),
        ((F.col("below") <= 0.51 * F.col("n_rows")) & (F.col("upto") >= 0.49 * F.col("n_rows"))).alias("median_close"), (far <= F.col("n_rows") / profiles.FREQUENT).alias("top_close"),
    )


@query(
    sql(
        """select week_num, coalesce(c.source, 'none') as source, case when a.article_id is null then 'left_only' when c.article_id is null then 'right_only' else 'both' end as provenance, count(*) as n
from candidates c full join actual a using (customer_id, week_num, article_id) group by all""",
        "candidates",
        "actual",
    )
)
def candidate_provenance(d: Domain) -> DataFrame:
    log, _, rows, _ = samples(d)
    return checks.candidate_coverage(rows, log, FIRST, LAST)


@query("select * from (values " + ", ".join(f"('{c}', 0)" for c in ("shape", "repeated", "positives", "negatives", "repurchases", "items", "customers", "matrix", "prices", "similarity")) + ") t(\"check\", violations)")
def data_checks(d: Domain) -> DataFrame:
    """Violations of the candidates', panels' and matrix's invariants: none is wanted."""
    log = stored(d.transactions.drop("quantity"), "log")  # every check and table reads it
    items, people = stored(item_panel(d, log), "items"), stored(customer_panel(d, log), "customers")
    made = stored(O.training_candidates(log, FIRST, LAST, calendar(d), K), "candidates")
    rows = stored(with_features(d, made, log, items, people), "matrix")
    found = checks.candidate_checks(rows, log, "last_purchase", FIRST, LAST)
    found |= {
        "items": checks.panel_shape(items, d.articles, "article_id", *GRID),
        "customers": checks.panel_shape(people, checks.active_customers(log, *GRID), "customer_id", *GRID),
        "matrix": checks.matrix_shape(rows, made),
        "prices": checks.customer_price_differences(rows, people),
        "similarity": checks.similarity_differences(rows, people, d.embeddings),
    }
    return checks.report(found).withColumn("violations", F.col("violations").cast("int"))


@query("select strftime(time_bucket(interval '7 days', ts, timestamp '1970-01-07'), '%Y-%m-%d') as week_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def event_weeks(d: Domain) -> DataFrame:
    events = d.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = weekly.weekly_counts(events)
    return found.select(F.date_format("week_start", "yyyy-MM-dd").alias("week_start"), "event_type", "n", F.round("total", 4).alias("total"))


def streamed_events(d: Domain) -> DataFrame:
    """The events as a stream of files; a pattern may be one file, a plain path must be a folder."""
    path = f"{d.dir}/[e]vents.parquet"
    return d.spark.readStream.schema(d.table("events").schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


@query("select count(*) as n, count(distinct event_id) as events, sum(hash_free) as total from (select distinct event_id, user_id as hash_free from events)")
def stream_distinct_events(d: Domain) -> DataFrame:
    """Events read twice by a stream, and kept once each."""
    folder = new_dir(d.spark, "events")
    twice = streamed_events(d).unionByName(streamed_events(d))
    kept = weekly.distinct_events(twice, "4000 days").select("event_id", "user_id")
    kept.writeStream.format("parquet").option("path", f"{folder}/kept").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return d.spark.read.parquet(f"{folder}/kept").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("events"), F.sum("user_id").alias("total"))


@query(
    f"""with e as (select cast(floor(date_diff('day', date '1970-01-01', cast(ts as date)) / 7) as integer) as week_num, user_id as article_id from events where user_id is not null)
select week_num, article_id, cast(total as bigint) as total, cast(place as integer) as place from (select *, row_number() over (partition by week_num order by total desc, article_id) as place from (
  select week_num, article_id, sum(v) as total from (
    select s.week_num + m.m as week_num, article_id, v from (select week_num, article_id, count(*) as v from e group by all) s, (select unnest(range(0, 4))::integer as m) m where s.week_num + m.m <= (select max(week_num) from e)
    union all select w.week_num, a.article_id, 0 from (select distinct article_id from e) a, (select unnest(range(min(week_num), max(week_num) + 1))::integer as week_num from e) w) group by all)) where place <= {K}"""
)
def stream_rolling_users(d: Domain) -> DataFrame:
    """The most active users of every four weeks, kept up by a stream of events."""
    state = RollingPopularity(d.spark, new_dir(d.spark, "rolling"), 4, K)
    week = F.floor(F.datediff("ts", F.lit("1970-01-01")) / 7)
    state.start(streamed_events(d).select(week.alias("week_num"), F.col("user_id").alias("article_id"))).awaitTermination()
    return state.lists()


@query(
    """select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from (
  select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as visit from (
    select *, case when lag(ts) over (partition by user_id order by ts) + interval '30 minutes' > ts then 0 else 1 end as new from events)) group by user_id, visit"""
)
def event_visits(d: Domain) -> DataFrame:
    events = d.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return weekly.visits(events).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
