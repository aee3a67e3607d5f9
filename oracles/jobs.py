"""Expected results of sources, sinks, statements, generator and benchmark runs."""

from .workload import ORACLES as _WORKLOAD

PRICE = "cast(o_totalprice as decimal(18,2))"
TOTAL = f"cast(sum({PRICE}) as double)"


def _modes(rows: list[tuple[str, str, str]]) -> str:
    """Orders per status for each mode: (mode, outcome, condition on the orders left)."""
    return " union all ".join(
        f"select o_orderstatus, count(*) as n_orders, '{mode}' as data_mode,"
        f" '{outcome}' as outcome from orders where {left} group by 1"
        for mode, outcome, left in rows
    )


def _schema_modes(rows: list[tuple[str, str, int]]) -> str:
    """(mode, what happened to a missing table, columns at the end); recreate keeps
    only the second load, the others hold both."""
    return " union all ".join(
        f"select o_orderstatus, {1 if mode == 'recreate' else 2} * count(*) as n_orders,"
        f" '{mode}' as schema_mode, '{missing}' as when_missing, {n}::bigint as n_columns"
        " from orders group by 1"
        for mode, missing, n in rows
    )


def _bench(names: tuple[str, ...], iterations: int, extra: str = "") -> str:
    return " union all ".join(
        f"select '{name}' as query, cast(i as bigint) as iteration,"
        f" (select count(*) from ({_WORKLOAD[name]})) as row_count{extra}"
        f" from range(1, {iterations + 1}) t(i)"
        for name in names
    )


_STATUS_COUNTS = "select o_orderstatus as status, count(*) as n_orders from orders {} group by 1"

ORACLES = {
    "jdbc_query_source": """
        select o_orderstatus, o_orderpriority, count(*) as n_orders, max(o_orderdate) as last_order
        from orders group by 1, 2""",
    "jdbc_partitioned_source": "select * from orders",
    "jdbc_text_partitioned_source": "select *, c_mktsegment || '/' || c_name as path from customer",
    "sql_transform": """
        select o_orderpriority, cast(month(o_orderdate) as bigint) as order_month,
               count(*) as n_orders
        from orders group by 1, 2""",
    "job_chain": """
        select c_mktsegment, c_nationkey, count(*) as n_orders
        from orders join customer on o_custkey = c_custkey group by 1, 2""",
    "job_resume": """
        select sink, 'stopped' as at_first, orders.*
        from orders, (values ('first'), ('second'), ('third')) s(sink)""",
    "file_sink_delimited": "select * from orders",
    "file_sink_format": """
        select supplier.*, format
        from supplier, (values ('csv'), ('json'), ('orc'), ('parquet'), ('xml')) f(format)""",
    "file_sink_codec": "select customer.*, codec from customer, (values ('gzip'), ('zstd')) c(codec)",
    "file_sink_partitioned": """
        select *, o_orderstatus as by_o_orderstatus, o_orderpriority as by_o_orderpriority
        from orders""",
    "file_sink_directory": "select *, year(o_orderdate) as year, month(o_orderdate) as month from orders",
    "file_sink_columns": "select l_shipdate, l_orderkey, l_returnflag from lineitem",
    "file_sink_batch": """
        select count(*) as n_lines, true as files_within_limit, true as enough_files
        from lineitem""",
    "file_sink_run_stamp": f"""
        select case o_orderstatus when 'F' then '20240101000000' else '20240102000000' end as run,
               o_orderstatus, count(*) as n_orders, {TOTAL} as price,
               o_orderstatus is distinct from 'F' as latest
        from orders group by o_orderstatus""",
    "file_sink_staged": "select * from orders",
    "file_sink_listed": "select *, 'stopped, refused' as outcomes, 2::bigint as n_runs from orders",
    "table_sink_append": "select * from orders",
    "table_sink_data_modes": _modes([
        ("append", "accepted", "true"),
        ("overwrite", "accepted", "o_orderstatus is distinct from 'F'"),
        ("error_if_data", "refused", "o_orderstatus = 'F'"),
        ("ignore_if_data", "accepted", "o_orderstatus = 'F'"),
    ]),
    "table_sink_schema_modes": _schema_modes([
        ("create_if_missing", "created", 6),
        ("recreate", "created", 2),
        ("fail_if_missing", "refused", 6),
    ]),
    "table_sink_cast_complex": """
        select vec_id, label, cast(len(embedding) as bigint) as n_elements from embeddings""",
    "table_sink_deletes": """
        select * from orders where coalesce(o_orderstatus not in ('F', 'P'), true)
        union all
        select * replace (o_totalprice + 2 as o_totalprice) from orders where o_orderstatus = 'P'
        union all
        select * replace (-o_orderkey - 1 as o_orderkey) from orders
        where o_orderstatus = 'O' and o_orderpriority <> '1-URGENT'""",
    "table_sink_idempotent": f"""
        select case when o_orderstatus = 'F' then 'done' else 'open' end as label,
               count(*) as n_orders, {TOTAL} as price, count(*) as ledger_rows
        from orders group by 1""",
    "table_sink_custom_sql": "select * from orders where o_orderstatus = 'P'",
    "sql_statement": """
        select o_orderstatus, count(*) as n_orders, count(distinct o_custkey) as n_customers
        from orders group by 1""",
    "sql_show_databases": _STATUS_COUNTS.format(""),
    "sql_drop_database": _STATUS_COUNTS.format("where o_orderstatus is distinct from 'P'"),
    "sql_create_database": "select * from customer",
    "sql_create_table": "select s_suppkey as id, s_name as name, s_acctbal as balance from supplier",
    "sql_show_tables": """
        select 'lines_' || name as "tableName", false as "isTemporary",
               count(l_orderkey) + count(case when l_orderkey is null and flag is not null
                                              then 1 end) as n_lines
        from (values ('a'), ('n'), ('r'), ('other')) t(name)
             left join (select l_orderkey, case when l_returnflag in ('A', 'N', 'R')
                                                then lower(l_returnflag) else 'other' end as flag
                        from lineitem) on flag = name
        group by name""",
    "sql_insert_values": """
        select segment, target::bigint as target, count(*) as n_customers
        from customer join (values ('BUILDING', 10), ('MACHINERY', 20), ('FURNITURE', 30),
                                   ('FURNITURE', 40)) t(segment, target) on segment = c_mktsegment
        group by 1, 2""",
    "sql_select": "select p_partkey, p_name from part where p_size <= 10",
    "sql_ctas": "select l_returnflag, l_linestatus, count(*) as n_lines from lineitem group by 1, 2",
    "sql_cvas": """
        select event_type, count(*) as n_events, max(ts) as last_seen from events group by 1""",
    "file_upload_table": "select * from customer",
    "bench_run": _bench(tuple(_WORKLOAD), 2, ", 'ok' as status"),
    "bench_filter": _bench(("year_over_year", "cube_counts"), 2),
    "bench_summary": """
        with runs as (select event_type as query, cast(round(value * 100) as bigint) as ms
                      from events)
        select query, count(*) as runs, 0::bigint as failed_runs, min(ms) as min_ms,
               cast(sum(ms) as double) / count(*) as avg_ms, max(ms) as max_ms,
               cast(median(ms) as double) as p50_ms
        from runs group by query""",
    "bench_results_sink": "select run_id, query, row_count from ("
    + _bench(("year_over_year", "count_between"), 1)
    + ") cross join (values ('first'), ('second')) r(run_id)",
    "rule_tagging": """
        select doc_id, case when contains(text, 'license') then 'licence text'
                            when contains(text, '@') then 'contact'
                            when contains(text, ' | ') then 'table'
                            when contains(text, 'the ') then 'prose'
                            else 'untagged' end as tag
        from documents""",
    "rule_table_tagging": """
        with words as (select item_id, regexp_extract_all(text, '[A-Za-z]{3,}') as w from benchmark),
        placed as (select item_id, unnest(w) as pattern, unnest(range(len(w))) as pos from words),
        rules as (select pattern, min(item_id * 1000000 + pos) as priority,
                         'item ' || min(item_id) as tag from placed group by pattern)
        select doc_id, coalesce((select min_by(tag, priority) from rules
                                 where contains(text, pattern)), 'none') as tag
        from documents""",
}
