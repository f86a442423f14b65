"""The relational operators of the understood query language, on the star schema.

Each entry pairs a DataFrame plan with the SQL that checks it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlgauge.plans.derived import read


class Tables:
    """Table access by attribute: ``t.orders``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return read(self._spark, self._folder, name)


_c = F.col


def _scan_project(t: Tables) -> DataFrame:
    return t.customer.select("c_name", "c_acctbal")


def _filter_cmp(t: Tables) -> DataFrame:
    keep = (_c("o_totalprice") >= 200000) & (_c("o_orderstatus") != "F") & (_c("o_custkey") < 1000)
    return t.orders.where(keep).select("o_orderkey", "o_totalprice")


def _filter_between(t: Tables) -> DataFrame:
    return t.part.where(_c("p_size").between(10, 20)).select("p_partkey", "p_size")


def _filter_like(t: Tables) -> DataFrame:
    return t.part.where(_c("p_name").ilike("%BLUE%")).select("p_partkey", "p_name")


def _filter_not_like(t: Tables) -> DataFrame:
    return t.part.where(~_c("p_name").ilike("%blue%")).select("p_partkey", "p_name")


def _filter_and_or(t: Tables) -> DataFrame:
    keep = (_c("c_mktsegment") == "BUILDING") & (_c("c_acctbal") > 5000) | (_c("c_nationkey") == 3)
    return t.customer.where(keep).select("c_custkey")


def _filter_in_list(t: Tables) -> DataFrame:
    return t.orders.where(_c("o_orderpriority").isin("1-URGENT", "5-LOW")).select("o_orderkey")


def _filter_null(t: Tables) -> DataFrame:
    # Customers without such orders leave NULLs behind; IS NULL finds them.
    spent = t.orders.where(_c("o_totalprice") > 300000).groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))
    joined = t.customer.join(spent, _c("c_custkey") == _c("o_custkey"), "left")
    return joined.where(_c("top").isNull()).select("c_custkey")


def _select_distinct(t: Tables) -> DataFrame:
    return t.part.select("p_brand", "p_type").distinct()


def _arith_units(t: Tables) -> DataFrame:
    return t.lineitem.select(
        "l_orderkey",
        (_c("l_extendedprice") * _c("l_discount")).alias("product"),
        (_c("l_extendedprice") - _c("l_tax")).alias("difference"),
        (_c("l_quantity") + _c("l_discount")).alias("total"),
        F.try_divide("l_extendedprice", "l_quantity").alias("quotient"),
    )


def _agg_all_five(t: Tables) -> DataFrame:
    q = _c("l_quantity")
    return t.lineitem.agg(
        F.max(q).alias("max_q"),
        F.min(q).alias("min_q"),
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(q), 2).alias("sum_q"),
        F.round(F.avg(q), 6).alias("avg_q"),
    )


def _agg_count_distinct(t: Tables) -> DataFrame:
    # Two levels of grouping, so that no task sees all values of a flag.
    per_value = t.lineitem.groupBy("l_returnflag", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return per_value.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n_suppliers"), F.sum("n").alias("n_rows")
    )


def _agg_sum_avg_distinct(t: Tables) -> DataFrame:
    per_value = t.lineitem.groupBy("l_linestatus", "l_quantity").agg(F.lit(1).alias("one"))
    return per_value.groupBy("l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_d"),
        F.round(F.avg("l_quantity"), 6).alias("avg_d"),
    )


def _group_by(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price")
    )


def _group_having(t: Tables) -> DataFrame:
    per_customer = t.orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 8).alias("mean_price")
    )
    return per_customer.where((_c("n") > 10) & (_c("mean_price") > 100000))


def _join_two(t: Tables) -> DataFrame:
    # Orders are counted per customer before they meet the customers, so that a
    # customer of very many orders is one row in the join.
    per_customer = (
        t.orders.where(_c("o_totalprice") > 100000)
        .groupBy("o_custkey")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    joined = t.customer.join(per_customer, _c("c_custkey") == _c("o_custkey"))
    return joined.groupBy("c_mktsegment").agg(F.sum("n").alias("n"))


def _join_three(t: Tables) -> DataFrame:
    # The sums shrink before every join: per customer, then per nation.
    totals = lambda df, *keys: df.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total")
    )
    orders = t.orders.select("o_custkey", F.lit(1).alias("n"), _c("o_totalprice").alias("total"))
    per_customer = totals(orders, "o_custkey")
    customers = per_customer.join(t.customer, _c("o_custkey") == _c("c_custkey"))
    named = (
        totals(customers, "c_nationkey")
        .join(t.nation, _c("c_nationkey") == _c("n_nationkey"))
        .join(t.region, _c("n_regionkey") == _c("r_regionkey"))
    )
    return totals(named, "r_name", "n_name").withColumn("total", F.round("total", 2))


def _join_self_alias(t: Tables) -> DataFrame:
    a, b = t.nation.alias("a"), t.nation.alias("b")
    pairs = a.join(b, (_c("a.n_regionkey") == _c("b.n_regionkey"))
                   & (_c("a.n_nationkey") < _c("b.n_nationkey")))
    names = pairs.select(
        _c("a.n_nationkey").alias("nk"), _c("a.n_name").alias("name_a"),
        _c("b.n_name").alias("name_b"),
    )
    # One row per customer of the first nation of a pair is not needed: count first.
    counts = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, _c("nk") == _c("c_nationkey")).select("name_a", "name_b", "n")


def _join_theta(t: Tables) -> DataFrame:
    # An equality plus an inequality: the shuffle is on the equality.
    joined = t.lineitem.join(
        t.orders, (_c("l_orderkey") == _c("o_orderkey")) & (_c("l_extendedprice") > _c("o_totalprice"))
    )
    return joined.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def _order_limit(t: Tables) -> DataFrame:
    return (
        t.orders.orderBy(_c("o_totalprice").desc(), "o_orderkey")
        .limit(10)
        .select("o_orderkey", "o_totalprice")
    )


def _order_by_agg_limit(t: Tables) -> DataFrame:
    per_customer = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return per_customer.orderBy(_c("n").desc(), "o_custkey").limit(7)


def _order_multi_dir(t: Tables) -> DataFrame:
    return (
        t.part.orderBy("p_size", _c("p_retailprice").desc(), "p_partkey")
        .limit(25)
        .select("p_partkey", "p_size", "p_retailprice")
    )


def _set_union(t: Tables) -> DataFrame:
    left = t.customer.select(_c("c_nationkey").alias("k"))
    return left.union(t.supplier.select("s_nationkey")).distinct()


def _set_union_all(t: Tables) -> DataFrame:
    left = t.customer.select(_c("c_nationkey").alias("k"))
    return left.union(t.supplier.select("s_nationkey")).groupBy("k").agg(F.count("*").alias("n"))


def _set_intersect(t: Tables) -> DataFrame:
    # Repeats go first: the join behind the operator then sees each key once.
    left = t.customer.select(_c("c_nationkey").alias("k")).distinct()
    return left.intersect(t.supplier.select("s_nationkey").distinct())


def _set_except(t: Tables) -> DataFrame:
    left = t.customer.select(_c("c_custkey").alias("k"))
    return left.subtract(t.orders.where(_c("o_totalprice") > 300000).select("o_custkey").distinct())


def _set_chain(t: Tables) -> DataFrame:
    # Set operators apply from left to right; the grouping is spelled out by the calls.
    sizes = t.part.select(_c("p_size").alias("k")).distinct()
    first = sizes.subtract(t.nation.select("n_nationkey"))
    return first.union(t.region.select("r_regionkey")).distinct()


def _sub_in(t: Tables) -> DataFrame:
    big = t.orders.where(_c("o_totalprice") > 300000).select("o_custkey").distinct()
    found = t.customer.join(big, _c("c_custkey") == _c("o_custkey"), "left_semi")
    return found.select("c_custkey", "c_name")


def not_in(left: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows of ``left`` for which ``column NOT IN (keys)`` is true; ``keys`` has one column.

    A NULL among the keys makes the condition true for no row, and a NULL on the left makes it
    true only without any key. Both facts are one-row scalars; the rest is a shuffled anti join.
    """
    key = keys.columns[0]
    n_keys = keys.agg(F.count(F.lit(1))).scalar()
    n_nulls = keys.agg(F.count_if(F.col(key).isNull())).scalar()
    possible = left.where((n_keys == 0) | ((n_nulls == 0) & F.col(column).isNotNull()))
    distinct = keys.where(F.col(key).isNotNull()).select(F.col(key).alias("_key")).distinct()
    return possible.join(distinct.hint("merge"), F.col(column) == F.col("_key"), "left_anti")


def _sub_not_in(t: Tables) -> DataFrame:
    big = t.orders.where(_c("o_totalprice") > 300000).select("o_custkey")
    return not_in(t.customer, "c_custkey", big).select("c_custkey")


def _sub_not_in_null(t: Tables) -> DataFrame:
    # NULLs left, right, and no key at all: three counts.
    customer = t.customer.select(F.nullif("c_custkey", F.lit(7)).alias("k"))
    big = t.orders.where(_c("o_totalprice") > 300000).select("o_custkey")
    cases = {
        "null_left": big,
        "null_right": big.select(F.expr("CASE WHEN o_custkey % 3 > 0 THEN o_custkey END").alias("o_custkey")),
        "no_key": big.where("o_custkey < 0"),
    }
    counts = [
        not_in(customer, "k", keys).agg(F.lit(name).alias("kind"), F.count(F.lit(1)).alias("n"))
        for name, keys in cases.items()
    ]
    return reduce(DataFrame.unionAll, counts)


def _sub_exists(t: Tables) -> DataFrame:
    late = t.lineitem.where(_c("l_discount") > 0.09).select("l_orderkey").distinct()
    return t.orders.join(late, _c("o_orderkey") == _c("l_orderkey"), "left_semi").select("o_orderkey")


def _sub_scalar(t: Tables) -> DataFrame:
    mean = t.orders.agg(F.avg("o_totalprice")).scalar()
    return t.orders.where(_c("o_totalprice") > mean * 1.5).select("o_orderkey", "o_totalprice")


def _sub_from(t: Tables) -> DataFrame:
    per_order = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("items"))
    return per_order.groupBy("items").agg(F.count(F.lit(1)).alias("n"))


def _sub_correlated(t: Tables) -> DataFrame:
    means = t.orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("mean"))
    return (
        t.orders.join(means, "o_custkey")
        .where(_c("o_totalprice") > _c("mean") * 1.2)
        .select("o_orderkey")
    )


# name: (plan, checking SQL)
GRAMMAR = {
    "scan_project": (_scan_project, "SELECT c_name, c_acctbal FROM customer"),
    "filter_cmp": (
        _filter_cmp,
        "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 200000 "
        "AND o_orderstatus != 'F' AND o_custkey < 1000",
    ),
    "filter_between": (
        _filter_between, "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20"
    ),
    "filter_like": (
        _filter_like, "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%BLUE%'"
    ),
    "filter_not_like": (
        _filter_not_like, "SELECT p_partkey, p_name FROM part WHERE p_name NOT ILIKE '%blue%'"
    ),
    "filter_and_or": (
        _filter_and_or,
        "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000 "
        "OR c_nationkey = 3",
    ),
    "filter_in_list": (
        _filter_in_list,
        "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')",
    ),
    "filter_null": (
        _filter_null,
        "SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS top "
        "FROM orders WHERE o_totalprice > 300000 GROUP BY o_custkey) ON c_custkey = o_custkey "
        "WHERE top IS NULL",
    ),
    "select_distinct": (_select_distinct, "SELECT DISTINCT p_brand, p_type FROM part"),
    "arith_units": (
        _arith_units,
        "SELECT l_orderkey, l_extendedprice * l_discount AS product, "
        "l_extendedprice - l_tax AS difference, l_quantity + l_discount AS total, "
        "l_extendedprice / l_quantity AS quotient FROM lineitem",
    ),
    "agg_all_five": (
        _agg_all_five,
        "SELECT max(l_quantity) AS max_q, min(l_quantity) AS min_q, count(*) AS n, "
        "round(sum(l_quantity), 2) AS sum_q, round(avg(l_quantity), 6) AS avg_q FROM lineitem",
    ),
    "agg_count_distinct": (
        _agg_count_distinct,
        "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n_suppliers, count(*) AS n_rows "
        "FROM lineitem GROUP BY l_returnflag",
    ),
    "agg_sum_avg_distinct": (
        _agg_sum_avg_distinct,
        "SELECT l_linestatus, round(sum(DISTINCT l_quantity), 2) AS sum_d, "
        "round(avg(DISTINCT l_quantity), 6) AS avg_d FROM lineitem GROUP BY l_linestatus",
    ),
    "group_by": (
        _group_by,
        "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS price "
        "FROM lineitem GROUP BY l_returnflag, l_linestatus",
    ),
    "group_having": (
        _group_having,
        "SELECT o_custkey, count(*) AS n, round(avg(o_totalprice), 8) AS mean_price FROM orders "
        "GROUP BY o_custkey HAVING count(*) > 10 AND round(avg(o_totalprice), 8) > 100000",
    ),
    "join_two": (
        _join_two,
        "SELECT c_mktsegment, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey "
        "WHERE o_totalprice > 100000 GROUP BY c_mktsegment",
    ),
    "join_three": (
        _join_three,
        "SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders "
        "JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey "
        "JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name",
    ),
    "join_self_alias": (
        _join_self_alias,
        "SELECT a.n_name AS name_a, b.n_name AS name_b, n FROM nation a JOIN nation b "
        "ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey JOIN "
        "(SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) "
        "ON a.n_nationkey = c_nationkey",
    ),
    "join_theta": (
        _join_theta,
        "SELECT o_orderpriority, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
        "AND l_extendedprice > o_totalprice GROUP BY o_orderpriority",
    ),
    "order_limit": (
        _order_limit,
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    ),
    "order_by_agg_limit": (
        _order_by_agg_limit,
        "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey "
        "ORDER BY count(*) DESC, o_custkey LIMIT 7",
    ),
    "order_multi_dir": (
        _order_multi_dir,
        "SELECT p_partkey, p_size, p_retailprice FROM part "
        "ORDER BY p_size ASC, p_retailprice DESC, p_partkey ASC LIMIT 25",
    ),
    "set_union": (
        _set_union, "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"
    ),
    "set_union_all": (
        _set_union_all,
        "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL "
        "SELECT s_nationkey FROM supplier) GROUP BY k",
    ),
    "set_intersect": (
        _set_intersect,
        "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    ),
    "set_except": (
        _set_except,
        "SELECT c_custkey AS k FROM customer EXCEPT "
        "SELECT o_custkey FROM orders WHERE o_totalprice > 300000",
    ),
    "set_chain": (
        _set_chain,
        "(SELECT p_size AS k FROM part EXCEPT SELECT n_nationkey FROM nation) "
        "UNION SELECT r_regionkey FROM region",
    ),
    "sub_in": (
        _sub_in,
        "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN "
        "(SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    ),
    "sub_not_in": (
        _sub_not_in,
        "SELECT c_custkey FROM customer WHERE c_custkey NOT IN "
        "(SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    ),
    "sub_not_in_null": (
        _sub_not_in_null,
        " UNION ALL ".join(
            f"SELECT '{kind}' AS kind, count(*) AS n FROM (SELECT nullif(c_custkey, 7) AS k FROM customer) "
            f"WHERE k NOT IN (SELECT {key} FROM orders WHERE o_totalprice > 300000 AND {keep})"
            for kind, key, keep in (
                ("null_left", "o_custkey", "TRUE"),
                ("null_right", "CASE WHEN o_custkey % 3 > 0 THEN o_custkey END", "TRUE"),
                ("no_key", "o_custkey", "o_custkey < 0"),
            )
        ),
    ),
    "sub_exists": (
        _sub_exists,
        "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE "
        "l_orderkey = o_orderkey AND l_discount > 0.09)",
    ),
    "sub_scalar": (
        _sub_scalar,
        "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > "
        "(SELECT avg(o_totalprice) FROM orders) * 1.5",
    ),
    "sub_from": (
        _sub_from,
        "SELECT items, count(*) AS n FROM (SELECT l_orderkey, count(*) AS items FROM lineitem "
        "GROUP BY l_orderkey) GROUP BY items",
    ),
    "sub_correlated": (
        _sub_correlated,
        "SELECT o_orderkey FROM orders o WHERE o_totalprice > 1.2 * "
        "(SELECT avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    ),
}
