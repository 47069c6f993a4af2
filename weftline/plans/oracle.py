"""DuckDB SQL for the registered queries, put together from named parts."""

from __future__ import annotations

K, FIRST, LAST, NEXT = 12, 93, 102, 104
GRID, HISTORY = (92, 104), (52, 104)
AGES = (18, 25, 35, 45, 55, 65)


def _parts(GRID: tuple[int, int]) -> dict[str, tuple[tuple[str, ...], str]]:  # noqa: N803  the name stands in all texts
    """The named parts for panels over the weeks of a grid."""
    found = {
        "mx": ((), "select max(cast(o_orderdate as date)) as d from orders"),
        "tx": (
            ("mx",),
            """select o_custkey as customer_id, l_partkey as article_id, cast(o_orderdate as date) as t_dat, round(l_extendedprice * 100) as price,
  case l_linestatus when 'O' then 1 else 2 end as sales_channel_id, l_quantity as quantity,
  cast(104 - date_diff('day', cast(o_orderdate as date), (select d from mx)) // 7 as integer) as week_num
from lineitem join orders on l_orderkey = o_orderkey""",
        ),
        "popular": (
            ("tx",),
            f"""select week_num, article_id, bestseller_rank from (
  select week_num, article_id, cast(dense_rank() over (partition by week_num order by n desc) as double) as bestseller_rank,
        row_number() over (partition by week_num order by n desc, article_id) as place
  from (select week_num, article_id, count(*) as n from tx group by all)) where place <= {K}""",
        ),
        "stats": (
            ("tx",),
            """select c.week_num, c.article_id, c.n as count, c.avg_price, m.sales_channel_id as mode_sales_channel_id
from (select week_num, article_id, count(*) as n, avg(price) as avg_price from tx group by all) c
join (select week_num, article_id, sales_channel_id, row_number() over (partition by week_num, article_id order by count(*) desc, sales_channel_id) as r
  from tx group by week_num, article_id, sales_channel_id) m on m.week_num = c.week_num and m.article_id = c.article_id and m.r = 1""",
        ),
        "pairs": (("tx",), f"select distinct customer_id, week_num from tx where week_num between {FIRST} and {LAST}"),
        "popularity": (
            ("pairs", "popular", "stats"),
            f"""select p.customer_id, p.week_num, b.article_id, s.avg_price as price, s.mode_sales_channel_id as sales_channel_id, 'popularity' as source
from pairs p join popular b on b.week_num = p.week_num - 1 and b.week_num between {FIRST - 1} and {LAST - 1}
left join stats s on s.week_num = b.week_num and s.article_id = b.article_id""",
        ),
        "weeks": (("tx",), "select customer_id, week_num, coalesce(lead(week_num) over (partition by customer_id order by week_num), 103) as next_week from (select distinct customer_id, week_num from tx)"),
        "last_purchase": (
            ("tx", "weeks"),
            f"""select tx.customer_id, tx.article_id, w.next_week as week_num, price, sales_channel_id, 'repurchase' as source
from tx join weeks w on w.customer_id = tx.customer_id and w.week_num = tx.week_num where w.next_week between {FIRST} and {LAST}""",
        ),
        "once": (
            ("tx",),
            "select * from (select *, row_number() over (partition by customer_id, week_num, article_id order by price, sales_channel_id) as one from tx) where one = 1",
        ),
        "last_k": (
            ("once",),
            f"""select customer_id, article_id, target as week_num, price, sales_channel_id, 'repurchase' as source from (
  select o.*, g.w as target, row_number() over (partition by customer_id, g.w order by week_num desc, article_id) as place
  from once o join (select unnest(range({FIRST}, {LAST + 1}))::integer as w) g on o.week_num < g.w) where place <= {K}""",
        ),
        "candidates": (
            ("popularity", "last_purchase", "pairs"),
            """select * exclude (r) from (select *, row_number() over (partition by customer_id, week_num, article_id order by source, price nulls last, sales_channel_id nulls last) as r
  from (select customer_id, week_num, article_id, price, sales_channel_id, source from popularity
        union all by name select * from last_purchase where customer_id in (select customer_id from pairs))) where r = 1""",
        ),
        "positives": (("once",), f"select customer_id, week_num, article_id, price, sales_channel_id, 'positive' as source from once where week_num between {FIRST} and {LAST}"),
        "labelled": (
            ("candidates", "positives"),
            "select c.*, case when p.article_id is null then 0 else 1 end as label from candidates c left join positives p on p.customer_id = c.customer_id and p.week_num = c.week_num and p.article_id = c.article_id",
        ),
        "unseen": (
            ("candidates", "tx"),
            "select * from candidates c where not exists (select 1 from tx where tx.customer_id = c.customer_id and tx.week_num = c.week_num and tx.article_id = c.article_id)",
        ),
        "dated": (("labelled", "popular", "mx"), "select c.*, {date} from labelled c left join popular b on b.article_id = c.article_id and b.week_num = c.week_num - 1"),
        "customers": (
            (),
            """select c_custkey as customer_id, case when c_acctbal >= 0 then cast(c_custkey % 60 + 16 as double) end as age, c_mktsegment as club_member_status,
  case when c_custkey % 7 <> 0 then 'F' || (c_custkey % 3) end as fashion_news_frequency, cast(c_nationkey as varchar) as postal_code from customer""",
        ),
        "static": (
            ("customers",),
            """select customer_id, coalesce(age, (select median(age) from customers)) as age,
  cast(dense_rank() over (order by club_member_status) - 1 as double) as club_member_status,
  cast(dense_rank() over (order by coalesce(fashion_news_frequency, 'unknown')) - 1 as double) as fashion_news_frequency,
  cast(dense_rank() over (order by postal_code) - 1 as double) as postal_code,
  cast(dense_rank() over (order by case {bins} end) - 1 as double) as age_bin from customers""".replace("{bins}", "when age is null then 'nan' " + " ".join(f"when age <= {e} then '{k}.0'" for k, e in enumerate(AGES)) + f" else '{len(AGES)}.0'"),
        ),
        "articles": (
            (),
            """select p_partkey as article_id, cast(dense_rank() over (order by p_brand) - 1 as double) as brand,
  cast(dense_rank() over (order by p_type) - 1 as double) as type, cast(dense_rank() over (order by cast(p_size as varchar)) - 1 as double) as size from part""",
        ),
        "recent": (("tx",), f"select * from tx where week_num between {HISTORY[0]} and {HISTORY[1]}"),
        "buyers": (
            ("recent", "customers"),
            """select article_id, week_num, age, sum(age) over w as s, count(*) over w as n
from recent join customers using (customer_id) window w as (partition by article_id order by week_num, customer_id rows between unbounded preceding and current row)""",
        ),
        "running": (
            ("buyers",),
            """select article_id, week_num, arg_max(s / n, n) filter (age is not null) as mean_age, max(n) as so_far from buyers group by all""",
        ),
        "item_panel": (
            ("recent", "running", "customers"),
            f"""select article_id, week_num, weekly_sales_count, coalesce(price, avg(price) over (partition by week_num)) as weekly_avg_price,
  coalesce(mean_age, (select median(age) from customers)) as cumulative_mean_age, coalesce(so_far, 0) as cumulative_sales_count from (
  select g.article_id, g.week_num, coalesce(n, 0) as weekly_sales_count, last_value(s.price ignore nulls) over f as price, last_value(r.mean_age ignore nulls) over f as mean_age, last_value(r.so_far ignore nulls) over f as so_far
  from (select p_partkey as article_id, w.w as week_num from part, (select unnest(range({GRID[0]}, {GRID[1] + 1}))::integer as w) w) g
  left join (select article_id, week_num, count(*) as n, avg(price) as price from recent group by all) s on s.article_id = g.article_id and s.week_num = g.week_num
  left join running r on r.article_id = g.article_id and r.week_num = g.week_num
  window f as (partition by g.article_id order by g.week_num rows between unbounded preceding and current row))""",
        ),
        "latest": (
            ("recent",),
            f"""select customer_id, target as week_num, article_id, price, place from (
  select *, row_number() over (partition by customer_id, target order by t_dat desc, article_id) as place from (
        select r.*, g.w as target, row_number() over (partition by customer_id, g.w, article_id order by t_dat desc, price, sales_channel_id) as one
        from recent r join (select unnest(range({GRID[0]}, {GRID[1] + 1}))::integer as w) g on r.week_num <= g.w) where one = 1) where place <= 5""",
        ),
        "basket": (
            ("latest",),
            """select customer_id, week_num, avg(price) as price, count(e.vec_id) as n from latest l left join embeddings e on e.vec_id = l.article_id group by all having count(e.vec_id) > 0""",
        ),
        "mean_vectors": (
            ("latest",),
            """select customer_id, week_num, list(x order by i) as vector from (
  select customer_id, week_num, i, avg(x) as x from (select customer_id, week_num, unnest(embedding::double[]) as x, unnest(range(1, len(embedding) + 1)) as i
        from latest join embeddings on vec_id = article_id) group by all) group by all""",
        ),
        "customer_panel": (
            ("recent", "basket", "mean_vectors"),
            f"""select customer_id, week_num, coalesce(price, avg(price) over (partition by week_num)) as customer_avg_price, vector from (
  select g.customer_id, g.week_num, last_value(b.price ignore nulls) over f as price, last_value(v.vector ignore nulls) over f as vector
  from (select distinct customer_id, w.w as week_num from recent, (select unnest(range({GRID[0]}, {GRID[1] + 1}))::integer as w) w where recent.week_num between {GRID[0]} and {GRID[1]}) g
  left join basket b on b.customer_id = g.customer_id and b.week_num = g.week_num
  left join mean_vectors v on v.customer_id = g.customer_id and v.week_num = g.week_num
  window f as (partition by g.customer_id order by g.week_num rows between unbounded preceding and current row))""",
        ),
        "offered": (
            ("tx", "popular", "stats", "mx"),
            f"""select c.customer_id, c.week_num, c.article_id, c.price, c.sales_channel_id, c.source, coalesce(b.bestseller_rank, 999.0) as bestseller_rank from (
  select *, row_number() over (partition by customer_id, week_num, article_id order by source, price, sales_channel_id) as r from (
        select c.customer_id, {NEXT} as week_num, b.article_id, s.avg_price as price, s.mode_sales_channel_id as sales_channel_id, 'popularity' as source
        from (select distinct customer_id from tx where week_num = {NEXT}) c, popular b join stats s on s.week_num = b.week_num and s.article_id = b.article_id where b.week_num = {NEXT - 1}
        union all select customer_id, {NEXT}, article_id, price, sales_channel_id, 'repurchase' from (select *, max(week_num) over (partition by customer_id) as m from tx where week_num < {NEXT}) where week_num = m
      and customer_id in (select customer_id from tx where week_num = {NEXT}))) c
left join popular b on b.week_num = {NEXT - 1} and b.article_id = c.article_id where r = 1""",
        ),
        "offered_to_all": (
            ("tx", "popular", "stats", "mx"),
            f"""select c.customer_id, c.week_num, c.article_id, c.price, c.sales_channel_id, c.source, coalesce(b.bestseller_rank, 999.0) as bestseller_rank from (
  select *, row_number() over (partition by customer_id, week_num, article_id order by source, price, sales_channel_id) as r from (
        select c.customer_id, {NEXT} as week_num, b.article_id, s.avg_price as price, s.mode_sales_channel_id as sales_channel_id, 'popularity' as source
        from (select distinct customer_id from tx where week_num <= {NEXT}) c, popular b join stats s on s.week_num = b.week_num and s.article_id = b.article_id where b.week_num = {NEXT - 1}
        union all select customer_id, {NEXT}, article_id, price, sales_channel_id, 'repurchase' from (select *, max(week_num) over (partition by customer_id) as m from tx where week_num < {NEXT}) where week_num = m)) c
left join popular b on b.week_num = {NEXT - 1} and b.article_id = c.article_id where r = 1""",
        ),
        "actual": (("tx",), f"select distinct customer_id, week_num, article_id from tx where week_num between {FIRST} and {LAST}"),
        "predicted": (
            ("candidates",),
            f"select * from (select customer_id, week_num, article_id, row_number() over (partition by customer_id, week_num order by price desc nulls last, article_id) as place from candidates) where place <= {K}",
        ),
        "hits": (
            ("actual", "predicted"),
            """select a.customer_id, a.week_num, p.place, row_number() over (partition by a.customer_id, a.week_num order by p.place) as hit
from actual a join predicted p on p.customer_id = a.customer_id and p.week_num = a.week_num and p.article_id = a.article_id""",
        ),
        "precision": (
            ("actual", "hits"),
            f"""select a.customer_id, a.week_num, coalesce(h.s, 0) / least(a.n, {K}) as ap, coalesce(h.n, 0) / least(a.n, {K}) as ideal_ap
from (select customer_id, week_num, count(*) as n from actual group by all) a
left join (select customer_id, week_num, sum(hit / place) as s, cast(count(*) as double) as n from hits group by all) h on h.customer_id = a.customer_id and h.week_num = a.week_num""",
        ),
    }
    first_day = "((select d from mx) + 1 - (105 - c.week_num) * 7)"
    date = f"year({first_day}) as year, month({first_day}) as month, strftime({first_day}, '%Y-%m-%d') as week, coalesce(b.bestseller_rank, 999.0) as bestseller_rank"
    found["dated"] = (found["dated"][0], found["dated"][1].replace("{date}", date))
    return found


def sql(final: str, *needs: str, grid: tuple[int, int] = GRID) -> str:
    """``final`` after the parts that it needs, each once, in order."""
    parts, order = _parts(grid), []

    def visit(name: str) -> None:
        if name not in order:
            for other in parts[name][0]:
                visit(other)
            order.append(name)

    for name in needs:
        visit(name)
    return "with " + ",\n".join(f"{n} as materialized ({parts[n][1]})" for n in order) + f"\n{final}" if order else final


def seeded(*columns: str, seed: int = 42) -> str:
    total = str(seed)
    for c in columns:
        total = f"((({total}) * 31 + ({c} % 1000003) * 7919 + 17) % 1000003)"
    return total
