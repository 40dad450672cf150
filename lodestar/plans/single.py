"""One query for each operator and function of the inventory that the workloads don't show by themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.exprs import contains, contains_in_order, divide_scaled, exact_sum, from_julian_day, hash_of, julian_day, one_of, raw_text, rehash, scaled, sequence, truncated, unscaled, year
from ..operators.relational import global_aggr, hash_aggr, hash_join, project, scan, select, semi_join, tap
from ..sources.files import Catalog, cached, read_tbl, result_lines, write_tbl


def scan_project(t: Catalog) -> DataFrame:
    return project(scan(t["part"], ["p_partkey", "p_size"]), "p_partkey", ("twice", F.col("p_size") * 2), ("thrice", F.col("twice") + F.col("p_size")))


def filter_or_values(t: Catalog) -> DataFrame:
    parts = scan(t["part"], ["p_partkey", "p_brand", "p_size"])
    return select(parts, one_of(F.col("p_brand"), "eq", "Brand#3", "Brand#5"), one_of(F.col("p_size"), "lt", 10, 20))


def contains_(t: Catalog) -> DataFrame:
    parts = scan(t["part"], ["p_partkey", "p_name"])
    return select(parts, contains(F.col("p_name"), "blue")).withColumn("then", contains_in_order(F.col("p_name"), "b", "t").cast("int"))


def starts_ends_with(t: Catalog) -> DataFrame:
    n = F.col("p_name")
    return select(scan(t["part"], ["p_partkey", "p_name"]), n.startswith("b") | n.endswith("t")).withColumn("bytes", F.octet_length("p_name"))


def join_unique_build(t: Catalog) -> DataFrame:
    """Each customer with one of its orders: that of the least key."""
    return hash_join(scan(t["customer"], ["c_custkey"]), ["c_custkey"], scan(t["orders"], ["o_custkey", "o_orderkey"]), ["o_custkey"], ["o_orderkey"], unique_build=True)


def join_semi(t: Catalog) -> DataFrame:
    return semi_join(scan(t["customer"], ["c_custkey", "c_name"]), ["c_custkey"], select(scan(t["orders"], ["o_custkey", "o_orderstatus"]), F.col("o_orderstatus") == "O"), ["o_custkey"])


def join_composite(t: Catalog) -> DataFrame:
    """Suppliers and customers of the same nation and balance sign."""
    suppliers = project(scan(t["supplier"], ["s_suppkey", "s_nationkey", "s_acctbal"]), "s_suppkey", "s_nationkey", ("s_poor", (F.col("s_acctbal") < 0).cast("int")))
    customers = project(scan(t["customer"], ["c_custkey", "c_nationkey", "c_acctbal"]), "c_custkey", "c_nationkey", ("c_poor", (F.col("c_acctbal") < 0).cast("int")))
    out = hash_join(customers, ["c_nationkey", "c_poor"], suppliers, ["s_nationkey", "s_poor"], ["s_suppkey"])
    return hash_aggr(out, ["c_nationkey", "c_poor"], {"pairs": F.count(F.lit(1))})


def agg_global_nonempty(t: Catalog) -> DataFrame:
    return global_aggr(select(scan(t["lineitem"], ["l_quantity"]), F.col("l_quantity") < 0), {"n": F.count(F.lit(1)), "sum_qty": exact_sum(scaled(F.col("l_quantity")), 2)})


def agg_minmax(t: Catalog) -> DataFrame:
    return hash_aggr(scan(t["lineitem"], ["l_returnflag", "l_quantity"]), ["l_returnflag"], {"least": F.min("l_quantity"), "most": F.max("l_quantity"), "any_row": F.max(F.lit(1))})


def agg_product(t: Catalog) -> DataFrame:
    """Product of one plus a bit of each region's key: exact in doubles."""
    return hash_aggr(scan(t["nation"], ["n_regionkey", "n_nationkey"]), ["n_regionkey"], {"product": F.product((1 + F.col("n_nationkey") % 2).cast("double"))})


def agg_having(t: Catalog) -> DataFrame:
    return select(hash_aggr(scan(t["orders"], ["o_custkey"]), ["o_custkey"], {"n": F.count(F.lit(1))}), F.col("n") >= 15)


def arith_mod_div(t: Catalog) -> DataFrame:
    k = F.col("p_partkey")
    price = scaled(F.col("p_retailprice"))
    return scan(t["part"], ["p_partkey", "p_size", "p_retailprice"]).select(
        "p_partkey",
        (k + F.col("p_size")).alias("added"),
        (k - F.col("p_size")).alias("subtracted"),
        (k % 7).alias("rest"),
        divide_scaled(-price, F.lit(7)).alias("quotient"),
        truncated(price, 1).alias("tenths"),
    )


def cast_(t: Catalog) -> DataFrame:
    return scan(t["part"], ["p_partkey", "p_size", "p_brand", "p_retailprice"]).select(
        "p_partkey",
        F.col("p_size").cast("smallint").cast("bigint").alias("size"),
        F.substring("p_brand", 7, 8).cast("bigint").alias("brand"),
        unscaled(scaled(F.col("p_retailprice")) * 10, 3).alias("price"),
    )


def julian(t: Catalog) -> DataFrame:
    d = F.col("o_orderdate")
    return scan(t["orders"], ["o_orderkey", "o_orderdate"]).select("o_orderkey", julian_day(d).alias("day"), year(d).alias("year"), from_julian_day(julian_day(d)).alias("date"))


def result_text(t: Catalog) -> DataFrame:
    rows = scan(t["lineitem"], ["l_orderkey", "l_returnflag", "l_shipdate", "l_extendedprice"])
    return result_lines(rows, [raw_text(F.col("l_orderkey"), "whole"), raw_text(F.col("l_returnflag"), "char"), raw_text(F.col("l_shipdate"), "date"), raw_text(F.col("l_extendedprice"), "money", 2)])


def not_(t: Catalog) -> DataFrame:
    """Parts that aren't small, of a brand that isn't the first: negated conditions, alone and of a conjunction."""
    parts = scan(t["part"], ["p_partkey", "p_brand", "p_size"])
    return select(parts, ~(F.col("p_size") < 10), ~((F.col("p_brand") == "Brand#1") & (F.col("p_size") > 20))).withColumn("minus", -F.col("p_size"))


def agg_named(t: Catalog) -> DataFrame:
    """Aggregates by their names."""
    orders = scan(t["orders"], ["o_orderstatus", "o_orderkey"])
    return hash_aggr(orders, ["o_orderstatus"], {"n": ("count",), "least": ("min", "o_orderkey"), "most": ("max", "o_orderkey"), "total": ("sum", "o_orderkey"), "one": ("const1",)})


def tapped(t: Catalog) -> DataFrame:
    """Rows that are counted as they stream by."""
    return tap(scan(t["nation"], ["n_nationkey", "n_name"]), "nations", last=("max", "n_nationkey"))[0]


_ORDERS = "o_orderkey bigint, o_orderstatus string, o_totalprice decimal(12,2), o_orderdate timestamp_ntz"


def tbl_round_trip(t: Catalog) -> DataFrame:
    """Orders, written as text and read again."""
    path = f"{t.session_folder()}/orders-{uuid.uuid4().hex}.tbl"
    write_tbl(t["orders"].selectExpr("o_orderkey", "o_orderstatus", "cast(o_totalprice as decimal(12,2))", "o_orderdate"), path)
    return read_tbl(t.spark, path, StructType.fromDDL(_ORDERS))


def column_cache(t: Catalog) -> DataFrame:
    """Parts by way of the column cache."""
    return scan(cached(t.spark, f"{t.session_folder()}/part", lambda: t["part"]), ["p_partkey", "p_brand", "p_size"])


def hash_rehash(t: Catalog) -> DataFrame:
    """Groups by a hash of two keys: as many as there are pairs."""
    orders = scan(t["orders"], ["o_custkey", "o_orderstatus"])
    groups = hash_aggr(orders, [rehash(hash_of(F.col("o_custkey")), F.col("o_orderstatus")).alias("h")], {"n": ("count",)})
    return global_aggr(groups, {"pairs": ("count",), "largest": ("max", "n")})


def numbered(t: Catalog) -> DataFrame:
    """Rows by number: as many numbers as rows, none below 0."""
    rows = scan(t["customer"], ["c_custkey"]).withColumn("number", sequence())
    return global_aggr(rows, {"rows": ("count",), "numbers": F.count_distinct("number"), "negative": F.count_if(F.col("number") < 0)})


#: name: (query over a catalog, SQL)
CATALOGUE = {
    "one_not": (not_, "select p_partkey, p_brand, p_size, -p_size minus from part where not (p_size < 10) and not (p_brand = 'Brand#1' and p_size > 20)"),
    "one_agg_named": (agg_named, "select o_orderstatus, count(*) n, min(o_orderkey) least, max(o_orderkey) most, cast(sum(o_orderkey) as bigint) total, 1 one from orders group by 1"),
    "one_tap": (tapped, "select n_nationkey, n_name from nation"),
    "one_tbl_round_trip": (tbl_round_trip, "select o_orderkey, o_orderstatus, cast(o_totalprice as decimal(12,2)) o_totalprice, o_orderdate from orders"),
    "one_column_cache": (column_cache, "select p_partkey, p_brand, p_size from part"),
    "one_hash_rehash": (hash_rehash, "select count(*) pairs, max(n) largest from (select count(*) n from orders group by o_custkey, o_orderstatus)"),
    "one_sequence": (numbered, "select count(*) \"rows\", count(*) numbers, cast(0 as bigint) negative from customer"),
    "one_scan_project": (scan_project, "select p_partkey, p_size * 2 twice, p_size * 3 thrice from part"),
    "one_filter_or_values": (filter_or_values, "select p_partkey, p_brand, p_size from part where p_brand in ('Brand#3', 'Brand#5') and (p_size < 10 or p_size < 20)"),
    "one_contains": (contains_, "select p_partkey, p_name, case when p_name like '%b%t%' then 1 else 0 end \"then\" from part where contains(p_name, 'blue')"),
    "one_starts_ends_with": (starts_ends_with, "select p_partkey, p_name, strlen(p_name)::int bytes from part where starts_with(p_name, 'b') or ends_with(p_name, 't')"),
    "one_join_unique_build": (join_unique_build, "select c_custkey, o_custkey, min(o_orderkey) o_orderkey from customer join orders on c_custkey = o_custkey group by 1, 2"),
    "one_join_semi": (join_semi, "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'O')"),
    "one_join_composite": (
        join_composite,
        "select c_nationkey, (c_acctbal < 0)::int c_poor, count(*) pairs from customer join supplier on c_nationkey = s_nationkey and (c_acctbal < 0) = (s_acctbal < 0) group by 1, 2",
    ),
    "one_agg_global_nonempty": (agg_global_nonempty, "select count(*) n, cast(sum(cast(l_quantity as decimal(12,2))) as decimal(30,2)) sum_qty from lineitem where l_quantity < 0 having count(*) > 0"),
    "one_agg_minmax": (agg_minmax, "select l_returnflag, min(l_quantity) least, max(l_quantity) most, 1 any_row from lineitem group by 1"),
    "one_agg_product": (agg_product, "select n_regionkey, product(1 + n_nationkey % 2) product from nation group by 1"),
    "one_agg_having": (agg_having, "select o_custkey, count(*) n from orders group by 1 having count(*) >= 15"),
    "one_arith_mod_div": (
        arith_mod_div,
        "select p_partkey, p_partkey + p_size added, p_partkey - p_size subtracted, p_partkey % 7 rest, -(cast(round(p_retailprice * 100) as bigint) // 7) quotient, "
        "cast(round(p_retailprice * 100) as bigint) // 10 tenths from part",
    ),
    "one_cast": (cast_, "select p_partkey, cast(p_size as bigint) size, cast(substr(p_brand, 7) as bigint) brand, cast(cast(p_retailprice as decimal(12,2)) as decimal(18,3)) price from part"),
    "one_julian_day": (julian, "select o_orderkey, date_diff('day', date '1970-01-01', cast(o_orderdate as date)) + 2440588 \"day\", cast(year(o_orderdate) as bigint) \"year\", cast(o_orderdate as date) \"date\" from orders"),
    "one_result_text": (
        result_text,
        "select l_orderkey || '|' || ascii(l_returnflag) || '|' || (date_diff('day', date '1970-01-01', cast(l_shipdate as date)) + 2440588) || '|' || cast(round(l_extendedprice * 100) as bigint) line from lineitem",
    ),
}
