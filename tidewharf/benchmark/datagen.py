"""Generate the star schema at a scale factor.

Every value is an integer formula on the row's number, so the rows do not depend
on the number of tasks or on a random seed, and a lost task is simply run again.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

# Rows at scale factor 1; regions and nations do not grow.
ROWS = {
    "region": 5,
    "nation": 25,
    "customer": 150_000,
    "supplier": 10_000,
    "part": 200_000,
    "orders": 1_500_000,
    "lineitem": 6_000_000,
}
_FIXED = ("region", "nation")
_LINES_PER_ORDER = ROWS["lineitem"] // ROWS["orders"]

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
ADJECTIVES = ("blue", "green", "large", "red", "small")
NOUNS = ("bolt", "gear", "ring", "widget")


def table_rows(scale: float) -> dict[str, int]:
    return {
        name: n if name in _FIXED else max(int(round(n * scale)), 1) for name, n in ROWS.items()
    }


def _pick(values: Iterable[str], index: str) -> str:
    values = tuple(values)
    listed = ", ".join(f"'{v}'" for v in values)
    return f"element_at(array({listed}), cast(({index}) % {len(values)} as int) + 1)"


def _day(number: str) -> str:
    return f"cast(date_add(date'1995-01-01', cast({number} as int)) as timestamp_ntz)"


def _columns(name: str, rows: dict[str, int]) -> dict[str, str]:
    order = f"(id div {_LINES_PER_ORDER})"
    order_day = "({order} * 263 + {order} div 17) % 2404"
    return {
        "region": {
            "r_regionkey": "cast(id as int)",
            "r_name": "concat('REGION_', id)",
        },
        "nation": {
            "n_nationkey": "cast(id as int)",
            "n_name": "concat('NATION_', id)",
            "n_regionkey": "cast(id % 5 as int)",
        },
        "customer": {
            "c_custkey": "id",
            "c_name": "concat('Customer#', lpad(cast(id as string), 9, '0'))",
            "c_nationkey": "cast((id * 7919 + id div 25) % 25 as int)",
            "c_acctbal": "((id * 104729) % 1099999 - 99999) / 100.0D",
            "c_mktsegment": _pick(SEGMENTS, "id * 31 + id div 7"),
        },
        "supplier": {
            "s_suppkey": "id",
            "s_name": "concat('Supplier#', lpad(cast(id as string), 9, '0'))",
            "s_nationkey": "cast((id * 6151 + id div 25) % 25 as int)",
            "s_acctbal": "((id * 15485863) % 1099999 - 99999) / 100.0D",
        },
        "part": {
            "p_partkey": "id",
            "p_name": f"concat({_pick(ADJECTIVES, 'id')}, ' ', {_pick(NOUNS, 'id div 5')})",
            "p_brand": "concat('Brand#', (id * 13 + id div 25) % 25)",
            "p_type": _pick(TYPES, "id * 5 + id div 11"),
            "p_size": "cast((id * 17 + id div 50) % 50 + 1 as int)",
            "p_retailprice": "(90000 + (id * 10) % 20001) / 100.0D",
        },
        "orders": {
            "o_orderkey": "id",
            "o_custkey": f"(id * 7919 + id div 11) % {rows['customer']}",
            "o_orderstatus": _pick("FOP", "id * 7 + id div 3"),
            "o_totalprice": "((id * 10007) % 49900000 + 100000) / 100.0D",
            "o_orderdate": _day(order_day.format(order="id")),
            "o_orderpriority": _pick(PRIORITIES, "id * 3 + id div 13"),
        },
        "lineitem": {
            "l_orderkey": order,
            "l_partkey": f"(id * 6007 + id div 19) % {rows['part']}",
            "l_suppkey": f"(id * 3571 + id div 23) % {rows['supplier']}",
            "l_linenumber": f"cast(id % {_LINES_PER_ORDER} + 1 as int)",
            "l_quantity": "cast((id * 29) % 50 + 1 as double)",
            "l_extendedprice": "((id * 29) % 50 + 1) * (90000 + (id * 6007) % 20001) / 100.0D",
            "l_discount": "(id * 7 + id div 3) % 11 / 100.0D",
            "l_tax": "id % 9 / 100.0D",
            "l_returnflag": _pick("ANR", "id * 5 + id div 29"),
            "l_linestatus": _pick("FO", "id div 2"),
            "l_shipdate": _day(f"{order_day.format(order=order)} + 1 + (id * 41) % 121"),
        },
    }[name]


def generate(
    spark: SparkSession, db: str, scale: float = 1, parallel: int | None = None
) -> dict[str, DataFrame]:
    """Write the seven tables into database ``db`` and return them.

    ``parallel`` is the number of tasks, and so of files, per table; by default
    twice the scale factor.
    """
    rows = table_rows(scale)
    tasks = parallel or max(int(2 * scale), 1)
    for name, n in rows.items():
        ids = spark.range(0, n, 1, min(tasks, n))
        columns = [f"{formula} AS {column}" for column, formula in _columns(name, rows).items()]
        ids.selectExpr(*columns).write.mode("overwrite").saveAsTable(f"{db}.{name}")
    return {name: spark.table(f"{db}.{name}") for name in rows}
