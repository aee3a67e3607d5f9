"""Joins, semi/anti joins, subqueries and set operations."""

from __future__ import annotations

from collections import Counter
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.exact import (
    CENTS, REVENUE, amount, cents, high, low, merge, partial, regroup, revenue_units, total,
)
from ..operators import day_slices, rows_per_day, running_sum, slices_for, stored, with_totals
from ..sources import load
from .common import bigint, count_rows, customer_years, in_year, in_years


def star_brand_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best PROMO brands of 1998 by revenue."""
    orders = load(spark, sf_dir, "orders").where(in_year("o_orderdate", 1998))
    promo = load(spark, sf_dir, "part").where("p_type = 'PROMO'")
    # Only lines of PROMO parts, a sixth or so, are shuffled to their orders.
    return (
        load(spark, sf_dir, "lineitem")
        .join(promo, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(bigint(F.lit(1998)).alias("order_year"), "p_brand")
        .agg(total(revenue_units(), REVENUE).alias("revenue"))
        .orderBy(F.desc("revenue"), "p_brand")
        .limit(10)
    )


def multi_avg_demographic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average quantity, price and discount by part type, for one segment's orders."""
    building = load(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    orders = load(spark, sf_dir, "orders").join(
        building, F.col("o_custkey") == F.col("c_custkey"), "left_semi"
    )
    by_part = (
        load(spark, sf_dir, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("l_partkey")
        .agg(
            *partial(cents("l_quantity"), "qty"),
            *partial(cents("l_extendedprice"), "price"),
            *partial(cents("l_discount"), "discount"),
            count_rows("n"),
        )
    )
    part = load(spark, sf_dir, "part")
    return (
        by_part.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("p_type")
        .agg(
            (merge("qty", CENTS) / F.sum("n")).alias("avg_qty"),
            (merge("price", CENTS) / F.sum("n")).alias("avg_price"),
            (merge("discount", CENTS) / F.sum("n")).alias("avg_discount"),
        )
    )


def _spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        load(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(*partial(cents("o_totalprice"), "spend"))
    )


def above_group_average(spark: SparkSession, sf_dir: str, **slicing) -> DataFrame:
    """Customers spending over 1.2 times their nation's average."""
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    spend = _spend(spark, sf_dir).join(
        customer, F.col("o_custkey") == F.col("c_custkey")
    ).select("c_custkey", "c_nationkey", "spend_hi", "spend_lo")
    nation = {
        "nation_hi": F.col("spend_hi"), "nation_lo": F.col("spend_lo"), "n": F.lit(1)
    }
    return (
        with_totals(spend, ["c_nationkey"], ["c_custkey"], nation, **slicing)
        .withColumn("total", amount("spend", CENTS))
        .where(F.col("total") > 1.2 * (amount("nation", CENTS) / F.col("n")))
        .select("c_custkey", "c_nationkey", "total")
    )


def subquery_having(spark: SparkSession, sf_dir: str, **slicing) -> DataFrame:
    """Lines of parts priced over 1.03 times their type's average, by nation."""
    part = load(spark, sf_dir, "part").select("p_partkey", "p_type", "p_retailprice")
    price = cents("p_retailprice")
    of_type = {"type_hi": high(price), "type_lo": low(price), "n": F.lit(1)}
    dear = with_totals(part, ["p_type"], ["p_partkey"], of_type, **slicing).where(
        F.col("p_retailprice") > 1.03 * (amount("type", CENTS) / F.col("n"))
    )
    by_order = (
        load(spark, sf_dir, "lineitem")
        .join(dear, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
        .groupBy("l_orderkey")
        .agg(count_rows("n"))
    )
    by_customer = (
        by_order.join(load(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey")
        .agg(F.sum("n").alias("n"))
    )
    return (
        by_customer.join(
            load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
        )
        .join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(F.sum("n").alias("n_lines"))
        .where("n_lines >= 10")
    )


def exists_or_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a 1996 order and (an urgent 1997 or an 'F' 1998 one), by segment."""
    active = (
        load(spark, sf_dir, "orders")
        .where(in_years("o_orderdate", 1996, 1998))
        .groupBy("o_custkey")
        .agg(
            F.bool_or(in_year("o_orderdate", 1996)).alias("in_1996"),
            F.bool_or(
                in_year("o_orderdate", 1997) & (F.col("o_orderpriority") == "1-URGENT")
            ).alias("urgent_1997"),
            F.bool_or(
                in_year("o_orderdate", 1998) & (F.col("o_orderstatus") == "F")
            ).alias("f_1998"),
        )
        .where("in_1996 and (urgent_1997 or f_1998)")
    )
    return (
        load(spark, sf_dir, "customer")
        .join(active, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
        .groupBy("c_mktsegment")
        .agg(count_rows("n_customers"))
    )


def exists_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """'F' lines of orders that have a second supplier and no returned line."""
    f_line = (F.col("l_linestatus") == "F") & F.col("l_suppkey").isNotNull()
    return (
        load(spark, sf_dir, "lineitem")
        .where("l_orderkey is not null")
        .groupBy("l_orderkey")
        .agg(
            F.min("l_suppkey").alias("first_supplier"),
            F.max("l_suppkey").alias("last_supplier"),
            F.coalesce(F.bool_or(F.col("l_returnflag") == "R"), F.lit(False)).alias("returned"),
            F.count_if(f_line).alias("f_lines"),
            *partial(F.when(f_line, revenue_units()), "revenue"),
        )
        .where("first_supplier <> last_supplier and not returned and f_lines > 0")
        .agg(count_rows("n_orders"), merge("revenue", REVENUE).alias("revenue"))
    )


def self_semi_nonequi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders supplied by at least two suppliers."""
    split = (
        load(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.min("l_suppkey").alias("lowest"), F.max("l_suppkey").alias("highest"))
        .where("lowest <> highest")
    )
    return (
        load(spark, sf_dir, "orders")
        .join(split, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
        .agg(count_rows("n_orders"), total(cents("o_totalprice"), CENTS).alias("total_price"))
    )


def left_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without lines."""
    with_lines = load(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    return (
        load(spark, sf_dir, "orders")
        .join(with_lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
        .agg(count_rows("n_orders"), total(cents("o_totalprice"), CENTS).alias("total_price"))
    )


def full_outer_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an 'F' order in 1996 only, in 1997 only, in both.

    A full outer join of the two yearly sets, done as one pass over the orders. An unknown
    customer of either year matches nobody and has no key on either side, so it counts
    under both "only" columns.
    """
    active = customer_years(spark, sf_dir, (1996, 1997), F.col("o_orderstatus") == "F")
    unknown = "o_custkey is null and"
    return active.agg(
        F.count_if(F.expr("o_custkey is not null and in_1996 and not in_1997")).alias("a"),
        F.count_if(F.expr("o_custkey is not null and not in_1996 and in_1997")).alias("b"),
        F.count_if(F.expr("o_custkey is not null and in_1996 and in_1997")).alias("both_years"),
        (F.count_if(F.expr(f"{unknown} in_1996")) + F.count_if(F.expr(f"{unknown} in_1997"))).alias(
            "unmatched"),
    ).selectExpr("a + unmatched AS only_1996", "b + unmatched AS only_1997", "both_years")


def cross_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of PROMO parts in all revenue, both totals from one pass."""
    by_part = (
        load(spark, sf_dir, "lineitem")
        .groupBy("l_partkey")
        .agg(*partial(revenue_units(), "revenue"))
    )
    promo = load(spark, sf_dir, "part").where("p_type = 'PROMO'").select("p_partkey")
    return (
        by_part.join(promo, F.col("l_partkey") == F.col("p_partkey"), "left")
        .agg(
            merge("revenue", REVENUE, when=F.col("p_partkey").isNotNull()).alias("promo_revenue"),
            merge("revenue", REVENUE).alias("total_revenue"),
        )
        .withColumn("promo_share", F.col("promo_revenue") / F.col("total_revenue"))
    )


PAIR_DAYS = 30


def range_join(spark: SparkSession, sf_dir: str, **slicing) -> DataFrame:
    """Pairs of a customer's orders at most 30 days apart, counted per customer.

    An order's partners are those dated up to 30 days later less those dated up
    to the same time. Both are running counts, so the pairs are never formed. Orders of
    one customer at one time are counted first, so a slice holds distinct times.
    """
    orders = load(spark, sf_dir, "orders").where("o_custkey is not null and o_orderdate is not null")
    # Every order is a point on its day and one 30 days later.
    days = rows_per_day(orders, "o_orderdate")
    both = Counter(days)
    for day, n in days.items():
        both[day + timedelta(days=PAIR_DAYS)] += n
    slices = day_slices(both, "at", F.date_trunc("hour", "at"), **slicing)
    points = orders.groupBy("o_custkey", "o_orderdate").agg(count_rows("n")).selectExpr(
        "o_custkey", "n",
        f"stack(2, o_orderdate, 0, n, o_orderdate + interval {PAIR_DAYS} days, 1, 0L) AS (at, turn, seen)",
    )
    counted = running_sum(
        points, ["o_custkey"], ["at", "turn"], "seen", with_peers=True, slice_by=slices, name="up_to",
    )
    later = F.col("n") * F.when(F.col("turn") == 1, F.col("up_to")).otherwise(-F.col("up_to"))
    return counted.groupBy("o_custkey").agg(F.sum(later).alias("n_pairs")).where("n_pairs > 0")


def theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a part and a larger one cheaper by over 50, counted by brand.

    Two sizes differ first at one bit, where the larger has 1 and the smaller 0.
    So every part is filed under the bits where its size has 1, looked up under
    those where it has 0, and the price condition becomes a running count in each
    such group. The cost is rows times the bits in which sizes differ (32 at most), not
    rows squared; sizes are shifted by 2**31 first, so that none is negative.
    """
    part = (
        load(spark, sf_dir, "part")
        .where("p_size is not null and p_retailprice is not null")
        .withColumn("size", F.expr("p_size + 2147483648L"))
    )
    ends = part.agg(F.min("size").alias("least"), F.max("size").alias("most")).first()
    # Above the highest bit in which any two sizes differ all have one prefix.
    n_bits = ((ends.least or 0) ^ (ends.most or 0)).bit_length()
    cells = (
        part.groupBy("p_brand", "size", "p_retailprice")
        .agg(count_rows("n"))
        .withColumn("bit", F.explode(F.array(*map(F.lit, range(n_bits))).cast("array<int>")))
        .selectExpr("p_brand", "p_retailprice", "n", "bit", "shiftright(size, bit) AS prefix")
    )
    # turn 0 looks up and comes first, so that it sees only strictly lower prices
    turns = cells.selectExpr(
        "p_brand", "n", "bit", "prefix | 1 AS prefix", "prefix & 1 AS turn",
        "IF(prefix & 1 = 1, p_retailprice + 50, p_retailprice) AS price",
        "IF(prefix & 1 = 1, n, 0L) AS larger",
    )
    counted = running_sum(
        turns, ["bit", "prefix"], ["price", "turn"], "larger",
        slice_by=F.floor("price"), name="cheaper_larger",
    )
    return (
        counted.where("turn = 0")
        .groupBy("p_brand")
        .agg(F.sum(F.col("n") * F.col("cheaper_larger")).alias("n_pairs"))
        .where("n_pairs > 0")
    )


def long_join_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue between nations of one region, by both nations and year of shipment."""
    nation = load(spark, sf_dir, "nation").join(
        load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    orders = (
        load(spark, sf_dir, "orders")
        .join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "c_nationkey")
    )
    # Summed to supplier, nation and year before the second shuffle.
    by_supplier = (
        load(spark, sf_dir, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("l_suppkey", "c_nationkey", bigint(F.year("l_shipdate")).alias("ship_year"))
        .agg(*partial(revenue_units(), "revenue"))
    )
    flows = (
        by_supplier
        .join(load(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("c_nationkey", "s_nationkey", "ship_year")
        .agg(*regroup("revenue"))
    )
    buyer = nation.select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("customer_nation"),
        "r_name",
    )
    seller = nation.select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("supplier_nation"),
        "r_name",
    )
    return (
        flows.join(buyer, "c_nationkey")
        .join(seller, ["s_nationkey", "r_name"])
        .groupBy("customer_nation", "supplier_nation", "ship_year")
        .agg(merge("revenue", REVENUE).alias("revenue"))
    )


def year_over_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers who spent more in 1997 than in 1996."""
    spent = cents("o_totalprice")
    return (
        load(spark, sf_dir, "orders")
        .where(in_years("o_orderdate", 1996, 1997) & F.col("o_custkey").isNotNull())
        .groupBy("o_custkey")
        .agg(
            total(F.when(in_year("o_orderdate", 1996), spent), CENTS).alias("total_1996"),
            total(F.when(in_year("o_orderdate", 1997), spent), CENTS).alias("total_1997"),
        )
        .where("total_1997 > total_1996 and total_1996 > 0")
        .withColumn("growth", F.col("total_1997") / F.col("total_1996"))
    )


def or_predicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of lines meeting one of three part-and-line conditions."""
    by_part = (
        load(spark, sf_dir, "lineitem")
        .select(
            "l_partkey",
            F.col("l_quantity").between(1, 11).alias("few"),
            F.col("l_quantity").between(10, 20).alias("some"),
            F.col("l_discount").between(0.05, 0.07).alias("reduced"),
            revenue_units().alias("units"),
        )
        .where("few or some or reduced")
        .groupBy("l_partkey", "few", "some", "reduced")
        .agg(*partial(F.col("units"), "revenue"), count_rows("n"))
    )
    return (
        by_part.join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .where(
            "(few and p_type = 'PROMO') or (some and p_type = 'LARGE' and p_size <= 10)"
            " or (reduced and p_brand = 'Brand#12')"
        )
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_lines"),
            merge("revenue", REVENUE).alias("revenue"),
        )
    )


def excess_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines discounted over 1.3 times their part's average.

    Lines are first counted per part and discount. Discounts are whole per cents,
    so the window over a part meets about a hundred rows, however often it sold.
    """
    rates = (
        load(spark, sf_dir, "lineitem")
        .where("l_partkey is not null")
        .groupBy("l_partkey", "l_discount")
        .agg(count_rows("n"), *partial(cents("l_extendedprice"), "price"))
    )
    of_part = Window.partitionBy("l_partkey")
    total_rate = F.sum(cents("l_discount") * F.col("n")).over(of_part)
    return (
        rates.withColumn("average", total_rate / F.lit(CENTS) / F.sum("n").over(of_part))
        .where(F.col("l_discount") > 1.3 * F.col("average"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_lines"),
            merge("price", CENTS).alias("price"),
        )
    )


def low_revenue_join(spark: SparkSession, sf_dir: str, slices: int | None = None) -> DataFrame:
    """Supplier-part pairs whose sales are at most a tenth of the supplier's mean.

    The sales are stored, as they are read for the means and for the pairs.
    """
    sales = stored(load(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(
        *partial(cents("l_extendedprice"), "revenue")), "sales")
    of_supplier = {
        "all_hi": F.col("revenue_hi"), "all_lo": F.col("revenue_lo"), "n": F.lit(1)
    }
    slices = slices or slices_for(sales.count())
    return (
        with_totals(sales, ["l_suppkey"], ["l_partkey"], of_supplier, slices=slices)
        .withColumn("revenue", amount("revenue", CENTS))
        .where(F.col("revenue") <= 0.1 * (amount("all", CENTS) / F.col("n")))
        .select("l_suppkey", "l_partkey", "revenue")
    )


def frequent_items_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of often-sold parts bought by customers near the top spender.

    Spend per customer is stored, for the top and for the customers near it, who are few. One
    pass over the lines: per part all are counted, and those of these customers' orders are summed.
    """
    orders = load(spark, sf_dir, "orders")
    spent = stored(
        orders.groupBy("o_custkey").agg(*partial(cents("o_totalprice"), "spend"))
        .select("o_custkey", amount("spend", CENTS).alias("spent")), "spent")
    # Orders of unknown customers are one group that may be the top, but nobody's.
    top = spent.agg(F.max("spent")).first()[0]
    best = spent.where((F.col("spent") > 0.7 * F.lit(top)) & F.col("o_custkey").isNotNull())
    best_orders = orders.select("o_orderkey", "o_custkey").join(best, "o_custkey", "left_semi").select(
        "o_orderkey").distinct()
    ours = F.col("o_orderkey").isNotNull()
    return (
        load(spark, sf_dir, "lineitem")
        .join(best_orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .where("l_partkey is not null")
        .groupBy("l_partkey")
        .agg(
            count_rows("n_sold"), F.count_if(ours).alias("n"),
            *partial(F.when(ours, revenue_units()), "revenue"),
        )
        .where("n_sold > 40")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_lines"),
            merge("revenue", REVENUE).alias("revenue"),
        )
    )


def count_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of 9 to 12 lines with their customer."""
    sized = (
        load(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(count_rows("n_lines"))
        .where("n_lines between 9 and 12")
    )
    return (
        sized.join(load(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "n_lines", "c_custkey", "c_name")
    )


def intersect_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers who ordered in each of three years: an intersection in one pass."""
    return (
        customer_years(spark, sf_dir, (1996, 1997, 1998))
        .where("in_1996 and in_1997 and in_1998")
        .agg(count_rows("n_customers"))
    )


def except_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers who ordered in 1996 and not in 1997: a difference in one pass."""
    return (
        customer_years(spark, sf_dir, (1996, 1997))
        .where("in_1996 and not in_1997")
        .agg(count_rows("n_customers"))
    )


QUERIES = {
    f.__name__: f
    for f in (
        star_brand_year, multi_avg_demographic, above_group_average, subquery_having,
        exists_or_exists, exists_not_exists, self_semi_nonequi, left_anti, full_outer_overlap,
        cross_ratio, range_join, theta_join, long_join_chain, year_over_year,
        or_predicate_groups, excess_discount, low_revenue_join, frequent_items_max,
        count_between, intersect_count, except_count,
    )
}
