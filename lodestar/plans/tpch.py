"""The TPC-H-derived queries and operator micro-queries, each with SQL that tells its result.

Money is summed in whole units of its smallest digit, exactly, and comes out as decimal(30, s). Constants are parameters; the
defaults select rows of the tables at hand (orders from 1995 on, part names of colours). No query sorts or limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import contains, day, exact_sum, scaled, year
from ..operators.relational import global_aggr, hash_aggr, hash_join, project, scan, select, semi_join
from ..sources.derived import PARTSUPP_SQL, partsupp
from ..sources.files import Catalog

YEAR, NEEDLE = 1996, "blue"


def _price() -> Column:
    return scaled(F.col("l_extendedprice"))


def _off() -> Column:
    return scaled(F.col("l_discount"))


def _revenue() -> Column:
    """price (1 - discount), scale 4"""
    return _price() * (100 - _off())


def q1(t: Catalog, until: str = "1998-09-02", discounts: bool = True) -> DataFrame:
    lines = scan(t["lineitem"], ["l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"])
    lines = project(
        select(lines, F.col("l_shipdate") <= day(until)),
        "l_returnflag",
        "l_linestatus",
        ("qty", scaled(F.col("l_quantity"))),
        ("price", _price()),
        ("off", _off()),
        ("disc_price", F.col("price") * (100 - F.col("off"))),
        ("charge", F.col("disc_price") * (100 + scaled(F.col("l_tax")))),
    )
    sums = {"sum_qty": exact_sum(F.col("qty"), 2), "sum_base_price": exact_sum(F.col("price"), 2), "sum_disc_price": exact_sum(F.col("disc_price"), 4), "sum_charge": exact_sum(F.col("charge"), 6)}
    if discounts:
        sums["sum_disc"] = exact_sum(F.col("off"), 2)
    return hash_aggr(lines, ["l_returnflag", "l_linestatus"], sums | {"count_order": F.count(F.lit(1))})


def _q1_sql(discounts: bool) -> str:
    more = ", cast(sum(cast(l_discount as decimal(12,2))) as decimal(30,2)) sum_disc" if discounts else ""
    return f"""select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as decimal(12,2))) as decimal(30,2)) sum_qty,
  cast(sum(cast(l_extendedprice as decimal(12,2))) as decimal(30,2)) sum_base_price,
  cast(sum(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2)))) as decimal(30,4)) sum_disc_price,
  cast(sum(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2))) * (1 + cast(l_tax as decimal(4,2)))) as decimal(30,6)) sum_charge{more},
  count(*) count_order
from lineitem where l_shipdate <= timestamp '1998-09-02' group by l_returnflag, l_linestatus"""


def q3(t: Catalog, segment: str = "BUILDING", date: str = "1995-03-15") -> DataFrame:
    customers = select(scan(t["customer"], ["c_custkey", "c_mktsegment"]), F.col("c_mktsegment") == segment)
    orders = select(scan(t["orders"], ["o_orderkey", "o_custkey", "o_orderdate"]), F.col("o_orderdate") < day(date))
    lines = select(scan(t["lineitem"], ["l_orderkey", "l_extendedprice", "l_discount", "l_shipdate"]), F.col("l_shipdate") > day(date))
    placed = hash_join(orders, ["o_custkey"], customers, ["c_custkey"])
    sold = hash_join(lines, ["l_orderkey"], placed, ["o_orderkey"], ["o_orderdate"])
    keys = ["l_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), F.lit(0).alias("o_shippriority")]
    return hash_aggr(sold, keys, {"revenue": exact_sum(_revenue(), 4)})


Q3_SQL = """select l_orderkey, cast(o_orderdate as date) o_orderdate, 0 o_shippriority,
  cast(sum(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2)))) as decimal(30,4)) revenue
from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
where c_mktsegment = 'BUILDING' and o_orderdate < timestamp '1995-03-15' and l_shipdate > timestamp '1995-03-15' group by 1, 2, 3"""


def _q5_joined(t: Catalog, region: str | None, of_year: int | None) -> DataFrame:
    regions = scan(t["region"], ["r_regionkey", "r_name"])
    orders = scan(t["orders"], ["o_orderkey", "o_custkey", "o_orderdate"])
    if region is not None:
        regions = select(regions, F.col("r_name") == region)
    if of_year is not None:
        orders = select(orders, F.col("o_orderdate") >= day(f"{of_year}-01-01"), F.col("o_orderdate") < day(f"{of_year + 1}-01-01"))
    nations = hash_join(scan(t["nation"], ["n_nationkey", "n_name", "n_regionkey"]), ["n_regionkey"], regions, ["r_regionkey"])
    suppliers = hash_join(scan(t["supplier"], ["s_suppkey", "s_nationkey"]), ["s_nationkey"], nations, ["n_nationkey"], ["n_name"])
    buyers = hash_join(orders, ["o_custkey"], scan(t["customer"], ["c_custkey", "c_nationkey"]), ["c_custkey"], ["c_nationkey"])
    sold = hash_join(scan(t["lineitem"], ["l_orderkey", "l_suppkey", "l_extendedprice", "l_discount"]), ["l_orderkey"], buyers, ["o_orderkey"], ["c_nationkey"])
    return hash_join(sold, ["l_suppkey", "c_nationkey"], suppliers, ["s_suppkey", "s_nationkey"], ["n_name"])


def q5(t: Catalog, region: str = "ASIA", of_year: int = YEAR) -> DataFrame:
    return hash_aggr(_q5_joined(t, region, of_year), ["n_name"], {"revenue": exact_sum(_revenue(), 4)})


def q5_no_sel(t: Catalog) -> DataFrame:
    return global_aggr(_q5_joined(t, None, None), {"revenue": exact_sum(_price() * _off(), 4), "count_order": F.count(F.lit(1))})


_Q5_FROM = """from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""
Q5_SQL = f"""select n_name, cast(sum(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2)))) as decimal(30,4)) revenue
{_Q5_FROM} where r_name = 'ASIA' and o_orderdate >= timestamp '{YEAR}-01-01' and o_orderdate < timestamp '{YEAR + 1}-01-01' group by n_name"""
Q5_NO_SEL_SQL = f"""select cast(sum(cast(l_extendedprice as decimal(12,2)) * cast(l_discount as decimal(4,2))) as decimal(30,4)) revenue, count(*) count_order
{_Q5_FROM} having count(*) > 0"""


def q6(t: Catalog, order: str = "stacked", of_year: int = YEAR, low: int = 5, high: int = 7, quantity: int = 24, empty_row: bool = False) -> DataFrame:
    """order: how the conjuncts are written (stacked: date first; tree: one condition; discount: discount second). All mean the same."""
    lines = scan(t["lineitem"], ["l_shipdate", "l_discount", "l_quantity", "l_extendedprice"])
    dates = (F.col("l_shipdate") >= day(f"{of_year}-01-01")) & (F.col("l_shipdate") < day(f"{of_year + 1}-01-01"))
    # the first two bounds are wider than the exact ones, and reach the scan
    off = (F.col("l_discount") > (low - 0.5) / 100) & (F.col("l_discount") < (high + 0.5) / 100) & _off().between(low, high)
    few = F.col("l_quantity") < quantity
    if order == "tree":
        lines = select(lines, dates, off, few)
    else:
        for c in {"stacked": (dates, few, off), "discount": (dates, off, few)}[order]:
            lines = select(lines, c)
    return global_aggr(lines, {"revenue": exact_sum(_price() * _off(), 4)}, empty_row)


def _q6_sql(of_year: int = YEAR, empty_row: bool = False) -> str:
    return f"""select cast(sum(cast(l_extendedprice as decimal(12,2)) * cast(l_discount as decimal(4,2))) as decimal(30,4)) revenue
from lineitem where l_shipdate >= timestamp '{of_year}-01-01' and l_shipdate < timestamp '{of_year + 1}-01-01'
and cast(l_discount as decimal(12,2)) between 0.05 and 0.07 and l_quantity < 24{"" if empty_row else " having count(*) > 0"}"""


def q6_row(t: Catalog, of_year: int = 1994) -> DataFrame:
    """The form whose accumulator starts at 0: one row even over nothing."""
    return q6(t, of_year=of_year, empty_row=True).select(F.coalesce("revenue", F.lit(0).cast("decimal(30,4)")).alias("revenue"))


def _q9_parts(t: Catalog, needle: str, until_part: int | None) -> DataFrame:
    parts = select(scan(t["part"], ["p_partkey", "p_name", "p_retailprice"]), contains(F.col("p_name"), needle))
    if until_part is not None:
        parts = select(parts, F.col("p_partkey") <= until_part)
    return project(partsupp(t, parts), "ps_partkey", "ps_suppkey", "ps_cost", ("p_partkey", F.col("ps_partkey")))


def _q9_suppliers(t: Catalog, until_nation: int | None = None, until_supplier: int | None = None) -> DataFrame:
    out = hash_join(scan(t["supplier"], ["s_suppkey", "s_nationkey"]), ["s_nationkey"], scan(t["nation"], ["n_nationkey", "n_name"]), ["n_nationkey"], ["n_name"])
    if until_nation is not None:
        out = select(out, F.col("n_nationkey") <= until_nation, F.col("s_suppkey") <= until_supplier)
    return out.select("s_suppkey", "n_nationkey", "n_name")


def _cost() -> tuple[str, Column]:
    return "ps_supplycost", (F.col("ps_cost").cast("decimal(18,0)") / 100).cast("decimal(12,2)")


def q9(t: Catalog, needle: str = NEEDLE) -> DataFrame:
    supplied = hash_join(_q9_parts(t, needle, None), ["ps_suppkey"], _q9_suppliers(t), ["s_suppkey"], ["n_name"])
    lines = scan(t["lineitem"], ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"])
    sold = hash_join(lines, ["l_partkey", "l_suppkey"], supplied, ["ps_partkey", "ps_suppkey"], ["ps_cost", "n_name"])
    placed = hash_join(sold, ["l_orderkey"], scan(t["orders"], ["o_orderkey", "o_orderdate"]), ["o_orderkey"], ["o_orderdate"])
    amount = _revenue() - F.col("ps_cost") * scaled(F.col("l_quantity"))
    return hash_aggr(placed, [F.col("n_name").alias("nation"), year(F.col("o_orderdate")).alias("o_year")], {"sum_profit": exact_sum(amount, 4)})


Q9_SQL = f"""with {PARTSUPP_SQL}
select n_name nation, cast(year(o_orderdate) as bigint) o_year,
  cast(sum(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2))) - ps_supplycost * cast(l_quantity as decimal(12,2))) as decimal(30,4)) sum_profit
from part join partsupp on p_partkey = ps_partkey join supplier on ps_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
join lineitem on l_partkey = ps_partkey and l_suppkey = ps_suppkey join orders on o_orderkey = l_orderkey
where contains(p_name, '{NEEDLE}') group by 1, 2"""


def q9a(t: Catalog, needle: str = NEEDLE, until_part: int = 10_000) -> DataFrame:
    return project(_q9_parts(t, needle, until_part), "ps_partkey", "ps_suppkey", _cost(), "p_partkey")


Q9A_SQL = f"""with {PARTSUPP_SQL} select ps_partkey, ps_suppkey, ps_supplycost, p_partkey from partsupp join part on ps_partkey = p_partkey
where contains(p_name, '{NEEDLE}') and p_partkey <= 10000 and ps_partkey <= 10000"""


def q9b(t: Catalog, needle: str = NEEDLE, until_part: int = 10_000, until_nation: int = 10, until_supplier: int = 100) -> DataFrame:
    out = hash_join(_q9_parts(t, needle, until_part), ["ps_suppkey"], _q9_suppliers(t, until_nation, until_supplier), ["s_suppkey"], ["n_name"])
    return project(out, "ps_partkey", "ps_suppkey", _cost(), "s_suppkey", "n_name")


Q9B_SQL = f"""with {PARTSUPP_SQL} select ps_partkey, ps_suppkey, ps_supplycost, s_suppkey, n_name from partsupp join part on ps_partkey = p_partkey
join supplier on ps_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
where contains(p_name, '{NEEDLE}') and p_partkey <= 10000 and ps_partkey <= 10000 and n_nationkey <= 10 and s_suppkey <= 100"""


def q9c(t: Catalog) -> DataFrame:
    return _q9_suppliers(t)


Q9C_SQL = "select s_suppkey, n_nationkey, n_name from supplier join nation on s_nationkey = n_nationkey"


def q18group(t: Catalog, more_than: int = 300) -> DataFrame:
    """The orders of more than so many units, by aggregation and a condition on its result."""
    units = hash_aggr(scan(t["lineitem"], ["l_orderkey", "l_quantity"]), ["l_orderkey"], {"sum_qty": exact_sum(scaled(F.col("l_quantity")), 2)})
    return select(units, F.col("sum_qty") > more_than)


Q18GROUP_SQL = """select l_orderkey, cast(sum(cast(l_quantity as decimal(12,2))) as decimal(30,2)) sum_qty
from lineitem group by l_orderkey having sum(cast(l_quantity as decimal(12,2))) > 300"""


def q18(t: Catalog, more_than: int = 300) -> DataFrame:
    large = q18group(t, more_than).select(F.col("l_orderkey").alias("ag_orderkey"))
    orders = semi_join(scan(t["orders"], ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"]), ["o_orderkey"], large, ["ag_orderkey"])
    placed = hash_join(orders, ["o_custkey"], scan(t["customer"], ["c_custkey", "c_name"]), ["c_custkey"], ["c_name"])
    sold = hash_join(scan(t["lineitem"], ["l_orderkey", "l_quantity"]), ["l_orderkey"], placed, ["o_orderkey"], ["c_name", "c_custkey", "o_orderdate", "o_totalprice"])
    keys = ["c_name", "c_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), F.col("o_totalprice").cast("decimal(12,2)").alias("o_totalprice")]
    return hash_aggr(sold, keys, {"sum_qty": exact_sum(scaled(F.col("l_quantity")), 2)})


Q18_SQL = f"""select c_name, c_custkey, o_orderkey, cast(o_orderdate as date) o_orderdate, cast(o_totalprice as decimal(12,2)) o_totalprice,
  cast(sum(cast(l_quantity as decimal(12,2))) as decimal(30,2)) sum_qty
from orders join customer on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
where o_orderkey in (select l_orderkey from ({Q18GROUP_SQL})) group by 1, 2, 3, 4, 5"""


def s1(t: Catalog) -> DataFrame:
    return scan(t["region"], ["r_regionkey", "r_name"])


def s2(t: Catalog, segment: str = "BUILDING") -> DataFrame:
    return select(scan(t["customer"], ["c_custkey", "c_name", "c_mktsegment"]), F.col("c_mktsegment") == segment)


def j1(t: Catalog) -> DataFrame:
    return hash_join(scan(t["nation"], ["n_regionkey", "n_nationkey", "n_name"]), ["n_regionkey"], scan(t["region"], ["r_regionkey", "r_name"]), ["r_regionkey"], ["r_name"])


def j2(t: Catalog, until_nation: int | None = None, until_supplier: int | None = None, swapped: bool = False) -> DataFrame:
    nations, suppliers = j1(t), scan(t["supplier"], ["s_nationkey", "s_suppkey"])
    if until_nation is not None:
        nations = select(nations, F.col("n_nationkey") <= until_nation)
    if until_supplier is not None:
        suppliers = select(suppliers, F.col("s_suppkey") <= until_supplier)
    if swapped:
        return hash_join(suppliers, ["s_nationkey"], nations, ["n_nationkey"], ["n_name", "r_name"])
    return hash_join(nations, ["n_nationkey"], suppliers, ["s_nationkey"], ["s_suppkey"])


_J_FROM = "from nation join region on n_regionkey = r_regionkey"
J1_SQL = f"select n_regionkey, n_nationkey, n_name, r_regionkey, r_name {_J_FROM}"


def _j2_sql(columns: str, more: str = "") -> str:
    return f"select {columns} {_J_FROM} join supplier on n_nationkey = s_nationkey {more}"


_J2_COLUMNS = "n_regionkey, n_nationkey, n_name, r_regionkey, r_name, s_nationkey, s_suppkey"


def aggr1(t: Catalog, after: str | None = None) -> DataFrame:
    lines = scan(t["lineitem"], ["l_shipdate"])
    if after is not None:
        lines = select(lines, F.col("l_shipdate") > day(after))
    return hash_aggr(lines, [F.col("l_shipdate").cast("date").alias("l_shipdate")])


def imv1(t: Catalog, before: str = "1996-01-01", quantity: int = 50) -> DataFrame:
    orders = select(scan(t["orders"], ["o_orderkey", "o_orderdate"]), F.col("o_orderdate") < day(before))
    lines = select(scan(t["lineitem"], ["l_orderkey", "l_quantity"]), F.col("l_quantity") < quantity)
    return global_aggr(hash_join(lines, ["l_orderkey"], orders, ["o_orderkey"]), {"n": F.count(F.lit(1))})


IMV1_SQL = """select count(*) n from lineitem join orders on l_orderkey = o_orderkey
where o_orderdate < timestamp '1996-01-01' and l_quantity < 50 having count(*) > 0"""

#: name: (query over a catalog, SQL)
CATALOGUE = {
    "q1": (q1, _q1_sql(True)),
    "q1_no_disc": (lambda t: q1(t, discounts=False), _q1_sql(False)),
    "q3": (q3, Q3_SQL),
    "q5": (q5, Q5_SQL),
    "q5_no_sel": (q5_no_sel, Q5_NO_SEL_SQL),
    "q6": (q6, _q6_sql()),
    "q6a": (q6, _q6_sql()),
    "q6b": (lambda t: q6(t, "tree"), _q6_sql()),
    "q6c": (lambda t: q6(t, "discount"), _q6_sql()),
    "q6_empty": (lambda t: q6(t, of_year=1994), _q6_sql(1994)),
    "q6_row": (q6_row, f"select coalesce(revenue, 0) revenue from ({_q6_sql(1994, True)})"),
    "q9": (q9, Q9_SQL),
    "q9a": (q9a, Q9A_SQL),
    "q9b": (q9b, Q9B_SQL),
    "q9c": (q9c, Q9C_SQL),
    "q18": (q18, Q18_SQL),
    "q18group": (q18group, Q18GROUP_SQL),
    "s1": (s1, "select r_regionkey, r_name from region"),
    "s2": (s2, "select c_custkey, c_name, c_mktsegment from customer where c_mktsegment = 'BUILDING'"),
    "j1": (j1, J1_SQL),
    "j2": (j2, _j2_sql(_J2_COLUMNS)),
    "j2a": (lambda t: j2(t, 10), _j2_sql(_J2_COLUMNS, "where n_nationkey <= 10")),
    "j2b": (lambda t: j2(t, 10, 100), _j2_sql(_J2_COLUMNS, "where n_nationkey <= 10 and s_suppkey <= 100")),
    "j2c": (lambda t: j2(t, 10, 100, True), _j2_sql("s_nationkey, s_suppkey, n_nationkey, n_name, r_name", "where n_nationkey <= 10 and s_suppkey <= 100")),
    "aggr1": (aggr1, "select distinct cast(l_shipdate as date) l_shipdate from lineitem"),
    "aggr1a": (lambda t: aggr1(t, "1995-03-15"), "select distinct cast(l_shipdate as date) l_shipdate from lineitem where l_shipdate > timestamp '1995-03-15'"),
    "imv1": (imv1, IMV1_SQL),
}
#: Tables whose rows count as a query's input.
INPUTS = {
    "q1": ["lineitem"], "q3": ["customer", "orders", "lineitem"], "q5": ["customer", "orders", "lineitem", "supplier", "nation", "region"], "q6": ["lineitem"],
    "q9": ["part", "lineitem", "supplier", "nation", "orders"], "q18": ["lineitem", "orders", "customer"], "imv1": ["lineitem", "orders"],
}
