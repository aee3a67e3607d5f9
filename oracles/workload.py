"""Expected results of the workload queries.

Money is summed as DECIMAL and turned into a double once, so that no engine's
order of addition shows in the last digit.
"""

REV = "cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2)))"
PRICE = "cast(o_totalprice as decimal(18,2))"
SPEND = f"""select o_custkey, cast(sum({PRICE}) as double) as total from orders group by o_custkey"""


def year(column: str, y: int) -> str:
    return f"year({column}) = {y}"


ORACLES = {
    "star_brand_year": f"""
        select cast(year(o_orderdate) as bigint) as order_year, p_brand,
               cast(sum({REV}) as double) as revenue
        from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
        where p_type = 'PROMO' and year(o_orderdate) = 1998
        group by 1, 2 order by revenue desc, p_brand limit 10""",
    "multi_avg_demographic": """
        select p_type,
               cast(sum(cast(l_quantity as decimal(18,2))) as double) / count(*) as avg_qty,
               cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / count(*) as avg_price,
               cast(sum(cast(l_discount as decimal(18,2))) as double) / count(*) as avg_discount
        from lineitem join orders on l_orderkey = o_orderkey
             join customer on o_custkey = c_custkey join part on l_partkey = p_partkey
        where c_mktsegment = 'BUILDING' group by p_type""",
    "above_group_average": f"""
        with spend as (
            select c_custkey, c_nationkey, sum({PRICE}) as amount
            from orders join customer on o_custkey = c_custkey group by 1, 2)
        select c_custkey, c_nationkey, cast(amount as double) as total from spend a
        where cast(amount as double) > 1.2::double * (
            select cast(sum(amount) as double) / count(*) from spend b
            where b.c_nationkey = a.c_nationkey)""",
    "subquery_having": """
        select n_name, count(*) as n_lines
        from lineitem join part p on l_partkey = p_partkey join orders on l_orderkey = o_orderkey
             join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
        where p.p_retailprice > 1.03::double * (
            select cast(sum(cast(q.p_retailprice as decimal(18,2))) as double) / count(*)
            from part q where q.p_type = p.p_type)
        group by n_name having count(*) >= 10""",
    "exists_or_exists": """
        select c_mktsegment, count(*) as n_customers from customer
        where exists (select 1 from orders where o_custkey = c_custkey and year(o_orderdate) = 1996)
          and (exists (select 1 from orders where o_custkey = c_custkey
                       and year(o_orderdate) = 1997 and o_orderpriority = '1-URGENT')
               or exists (select 1 from orders where o_custkey = c_custkey
                          and year(o_orderdate) = 1998 and o_orderstatus = 'F'))
        group by c_mktsegment""",
    "exists_not_exists": f"""
        select count(distinct l_orderkey) as n_orders, cast(sum({REV}) as double) as revenue
        from lineitem a
        where l_linestatus = 'F'
          and exists (select 1 from lineitem b
                      where b.l_orderkey = a.l_orderkey and b.l_suppkey <> a.l_suppkey)
          and not exists (select 1 from lineitem c
                          where c.l_orderkey = a.l_orderkey and c.l_returnflag = 'R')""",
    "self_semi_nonequi": f"""
        select count(*) as n_orders, cast(sum({PRICE}) as double) as total_price from orders
        where o_orderkey in (
            select a.l_orderkey from lineitem a join lineitem b
            on a.l_orderkey = b.l_orderkey and a.l_suppkey <> b.l_suppkey)""",
    "left_anti": f"""
        select count(*) as n_orders, cast(sum({PRICE}) as double) as total_price
        from orders left join lineitem on o_orderkey = l_orderkey where l_orderkey is null""",
    "full_outer_overlap": """
        with a as (select distinct o_custkey from orders
                   where year(o_orderdate) = 1996 and o_orderstatus = 'F'),
             b as (select distinct o_custkey from orders
                   where year(o_orderdate) = 1997 and o_orderstatus = 'F')
        select count(*) filter (b.o_custkey is null) as only_1996,
               count(*) filter (a.o_custkey is null) as only_1997,
               count(*) filter (a.o_custkey is not null and b.o_custkey is not null) as both_years
        from a full outer join b on a.o_custkey = b.o_custkey""",
    "cross_ratio": f"""
        select promo_revenue, total_revenue, promo_revenue / total_revenue as promo_share
        from (select cast(sum({REV}) as double) as promo_revenue
              from lineitem join part on l_partkey = p_partkey where p_type = 'PROMO')
             cross join (select cast(sum({REV}) as double) as total_revenue from lineitem)""",
    "range_join": """
        select a.o_custkey, count(*) as n_pairs
        from orders a join orders b on a.o_custkey = b.o_custkey
             and b.o_orderdate > a.o_orderdate
             and b.o_orderdate <= a.o_orderdate + interval 30 days
        group by a.o_custkey""",
    "theta_join": """
        select a.p_brand, count(*) as n_pairs
        from part a join part b on a.p_size < b.p_size and a.p_retailprice > b.p_retailprice + 50
        group by a.p_brand""",
    "long_join_chain": f"""
        select n1.n_name as customer_nation, n2.n_name as supplier_nation,
               cast(year(l_shipdate) as bigint) as ship_year, cast(sum({REV}) as double) as revenue
        from lineitem join orders on l_orderkey = o_orderkey
             join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
             join nation n1 on c_nationkey = n1.n_nationkey
             join nation n2 on s_nationkey = n2.n_nationkey
             join region on n1.n_regionkey = r_regionkey and n2.n_regionkey = r_regionkey
        group by 1, 2, 3""",
    "year_over_year": f"""
        with t as (select o_custkey, year(o_orderdate) as y, cast(sum({PRICE}) as double) as total
                   from orders group by 1, 2)
        select a.o_custkey, a.total as total_1996, b.total as total_1997, b.total / a.total as growth
        from t a join t b on a.o_custkey = b.o_custkey
        where a.y = 1996 and b.y = 1997 and b.total > a.total and a.total > 0""",
    "or_predicate_groups": f"""
        select cast(count(*) as bigint) as n_lines, cast(sum({REV}) as double) as revenue
        from lineitem join part on l_partkey = p_partkey
        where (p_type = 'PROMO' and l_quantity between 1 and 11)
           or (p_type = 'LARGE' and l_quantity between 10 and 20 and p_size <= 10)
           or (p_brand = 'Brand#12' and l_discount between 0.05::double and 0.07::double)""",
    "excess_discount": """
        select cast(count(*) as bigint) as n_lines,
               cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as price
        from lineitem a
        where l_discount > 1.3::double * (
            select cast(sum(cast(l_discount as decimal(18,2))) as double) / count(*)
            from lineitem b where b.l_partkey = a.l_partkey)""",
    "low_revenue_join": """
        with sales as (select l_suppkey, l_partkey,
                              sum(cast(l_extendedprice as decimal(18,2))) as r
                       from lineitem group by 1, 2),
             means as (select l_suppkey, cast(sum(r) as double) / count(*) as m
                       from sales group by 1)
        select sales.l_suppkey, l_partkey, cast(r as double) as revenue
        from sales join means on sales.l_suppkey = means.l_suppkey
        where cast(r as double) <= 0.1::double * m""",
    "frequent_items_max": f"""
        with spend as ({SPEND})
        select cast(count(*) as bigint) as n_lines, cast(sum({REV}) as double) as revenue
        from lineitem
        where l_partkey in (select l_partkey from lineitem group by l_partkey having count(*) > 40)
          and l_orderkey in (
              select o_orderkey from orders where o_custkey in (
                  select o_custkey from spend
                  where total > 0.7::double * (select max(total) from spend)))""",
    "count_between": """
        select o_orderkey, n_lines, c_custkey, c_name
        from (select l_orderkey, count(*) as n_lines from lineitem group by 1) n
             join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
        where n_lines between 9 and 12""",
    "intersect_count": """
        select count(*) as n_customers from (
            select o_custkey from orders where year(o_orderdate) = 1996
            intersect select o_custkey from orders where year(o_orderdate) = 1997
            intersect select o_custkey from orders where year(o_orderdate) = 1998)""",
    "except_count": """
        select count(*) as n_customers from (
            select o_custkey from orders where year(o_orderdate) = 1996
            except select o_custkey from orders where year(o_orderdate) = 1997)""",
    "union_channel_rollup": f"""
        select channel, l_linestatus, cast(sum(amount) as double) as amount from (
            select 'sales' as channel, l_linestatus, {REV} as amount
            from lineitem where l_returnflag = 'N'
            union all
            select 'returns', l_linestatus, -({REV}) from lineitem where l_returnflag = 'R')
        group by rollup(channel, l_linestatus)""",
    "rollup_avg": """
        select r_name, n_name, count(*) as n,
               cast(sum(cast(c_acctbal as decimal(18,2))) as double) / count(*) as avg_balance
        from customer join nation on c_nationkey = n_nationkey
             join region on n_regionkey = r_regionkey
        group by rollup(r_name, n_name)""",
    "cube_counts": """
        select o_orderstatus, o_orderpriority, count(*) as n_orders
        from orders group by cube(o_orderstatus, o_orderpriority)""",
    "grouping_sets": f"""
        select c_mktsegment, o_orderpriority,
               cast(grouping(c_mktsegment) as bigint) as all_segments,
               cast(grouping(o_orderpriority) as bigint) as all_priorities,
               count(*) as n_orders, cast(sum({PRICE}) as double) as total_price
        from orders join customer on o_custkey = c_custkey
        group by grouping sets ((c_mktsegment), (o_orderpriority), ())""",
    "rollup_rank_in_parent": f"""
        with r as (
            select r_name, n_name,
                   cast(grouping(r_name) + grouping(n_name) as bigint) as lochierarchy,
                   cast(sum({PRICE}) as double) as spend
            from orders join customer on o_custkey = c_custkey
                 join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
            group by rollup(r_name, n_name))
        select *, cast(rank() over (
            partition by lochierarchy, case when lochierarchy = 0 then r_name end
            order by spend desc) as bigint) as rank_in_parent
        from r""",
    "distinct_aggs": """
        select l_returnflag, count(distinct l_partkey) as n_parts,
               count(distinct l_suppkey) as n_suppliers,
               cast(sum(distinct cast(l_quantity as decimal(18,2))) as double)
                   / count(distinct l_quantity) as avg_distinct_qty
        from lineitem group by l_returnflag""",
    "stddev_cov": """
        with s as (select l_suppkey, count(q) as n, sum(q) as s1, sum(q * q) as s2
                   from (select l_suppkey, cast(round(l_quantity * 100) as hugeint) as q from lineitem)
                   group by 1),
             v as (select l_suppkey, sqrt(cast(n * s2 - s1 * s1 as double) * n / nullif(n - 1, 0))
                          / nullif(cast(s1 as double), 0) as variation from s)
        select * from v where variation > 0.5::double""",
    "bucket_scalar": "select "
    + ", ".join(
        f"""case when (select count(*) from lineitem where l_quantity between {lo} and {hi}) > 5000
            then (select cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / count(*)
                  from lineitem where l_quantity between {lo} and {hi})
            else (select cast(sum(cast(l_discount as decimal(18,2))) as double) / count(*)
                  from lineitem where l_quantity between {lo} and {hi})
            end as bucket_{lo}_{hi}"""
        for lo, hi in ((1, 10), (11, 30), (31, 33))
    ),
    "spend_segments": f"""
        select cast(floor(total / 500000) as bigint) as segment, count(*) as n_customers
        from ({SPEND}) group by 1""",
    "readiness_rollup": """
        select o_custkey, count(*) filter (o_orderstatus = 'F') as ready, count(*) as total,
               bool_and(o_orderstatus = 'F') as all_ready,
               (count(*) filter (o_orderstatus = 'F')) || '/' || count(*) as ready_of_total
        from orders group by o_custkey""",
    "top_n_per_group": f"""
        select p_type, p_brand, revenue, cast(place as bigint) as place from (
            select p_type, p_brand, revenue,
                   rank() over (partition by p_type order by revenue desc) as place
            from (select p_type, p_brand, cast(sum({REV}) as double) as revenue
                  from lineitem join part on l_partkey = p_partkey group by 1, 2))
        where place <= 3""",
    "share_of_group": f"""
        select p_type, p_brand, cast(r as double) as revenue,
               cast(r as double) / cast(sum(r) over (partition by p_type) as double) as share
        from (select p_type, p_brand, sum({REV}) as r
              from lineitem join part on l_partkey = p_partkey group by 1, 2)""",
    "lag_lead_month": f"""
        with m as (
            select o_orderpriority, cast(year(o_orderdate) as bigint) as order_year,
                   cast(month(o_orderdate) as bigint) as order_month, sum({PRICE}) as t
            from orders group by 1, 2, 3)
        select o_orderpriority, order_year, order_month, cast(t as double) as total,
               cast(lag(t) over w as double) as previous, cast(lead(t) over w as double) as next,
               cast(sum(t) over y as double) / count(*) over y as year_mean
        from m window w as (partition by o_orderpriority order by order_year, order_month),
                      y as (partition by o_orderpriority, order_year)""",
    "running_total": f"""
        select o_custkey, o_orderkey, cast(sum({PRICE}) over (
            partition by o_custkey order by o_orderdate, o_orderkey
            rows between unbounded preceding and current row) as double) as spent
        from orders""",
    "best_worst_pair": f"""
        with b as (select p_brand, cast(sum({REV}) as double) as revenue
                   from lineitem join part on l_partkey = p_partkey group by 1),
             up as (select *, row_number() over (order by revenue desc, p_brand) as place from b),
             down as (select *, row_number() over (order by revenue, p_brand) as place from b)
        select cast(up.place as bigint) as place, up.p_brand as best_brand,
               up.revenue as best_revenue, down.p_brand as worst_brand,
               down.revenue as worst_revenue
        from up join down on up.place = down.place where up.place <= 10""",
    "deviation_from_avg": f"""
        with q as (
            select o_orderpriority, cast(year(o_orderdate) as bigint) as order_year,
                   cast(quarter(o_orderdate) as bigint) as order_quarter, sum({PRICE}) as t
            from orders group by 1, 2, 3),
        m as (select o_orderpriority, order_year, order_quarter, cast(t as double) as total,
                     cast(sum(t) over g as double) / count(*) over g as mean
              from q window g as (partition by o_orderpriority))
        select * from m where abs(total - mean) > 0.1::double * mean""",
    "weekday_pivot": "select o_orderpriority, "
    + ", ".join(
        f"cast(sum(case when dayofweek(o_orderdate) = {i} then {PRICE} else 0 end) as double)"
        f" as {day}"
        for i, day in enumerate(
            ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
        )
    )
    + " from orders group by o_orderpriority",
    "month_pivot": "select n_name, "
    + ", ".join(
        f"cast(sum(case when month(l_shipdate) = {i}"
        f" then cast(l_quantity as decimal(18,2)) else 0 end) as double) as {month}"
        for i, month in enumerate(
            ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), 1
        )
    )
    + """ from lineitem join supplier on l_suppkey = s_suppkey
          join nation on s_nationkey = n_nationkey
          where year(l_shipdate) = 1997 group by n_name""",
    "before_after_date": """
        select n_name,
               cast(sum(case when l_shipdate < timestamp '1998-06-01'
                        then cast(l_quantity as decimal(18,2)) else 0 end) as double) as qty_before,
               cast(sum(case when l_shipdate >= timestamp '1998-06-01'
                        then cast(l_quantity as decimal(18,2)) else 0 end) as double) as qty_after
        from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
        where l_shipdate between timestamp '1998-05-02' and timestamp '1998-07-01'
        group by n_name""",
    "ship_lag_bucket": """
        select o_orderpriority, count(*) filter (lag < 0) as before_order,
               count(*) filter (lag between 0 and 30) as within_30,
               count(*) filter (lag between 31 and 365) as within_365,
               count(*) filter (lag > 365) as later
        from (select o_orderpriority,
                     date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)) as lag
              from lineitem join orders on l_orderkey = o_orderkey)
        group by o_orderpriority""",
    "string_prefix_concat": """
        select c_custkey, substr(c_name, 1, 10) as prefix,
               coalesce(c_name, '') || ', ' || coalesce(c_mktsegment, '') as label,
               cast(length(c_name) as bigint) as name_length, upper(c_mktsegment) as segment,
               (c_name like '%01' or c_name like '%02' or c_name like '%03'
                or c_name like '%9') as name_matches
        from customer""",
}
