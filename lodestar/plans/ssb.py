"""The Star Schema Benchmark's thirteen queries over the derived star, with SQL that tells their results.

Years, nations and cities are those that the derived star has; they are parameters. No query sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import exact_sum, one_of
from ..operators.relational import global_aggr, hash_aggr, hash_join, select, semi_join
from ..sources.derived import STAR_SQL, ssb_customer, ssb_date, ssb_lineorder, ssb_part, ssb_supplier
from ..sources.files import Catalog

YEAR, NATION, CITIES = 1996, "NATION_1", ("NATION_3 1", "NATION_3 5")


def _years(first: int, last: int) -> tuple[str, str]:
    """The days of these years, as ssb_lineorder takes them: what a condition on the date dimension means on the stored column."""
    return f"{first}-01-01", f"{last + 1}-01-01"


def flight1(t: Catalog, dates: Column, span: tuple[str, str], low: int, high: int, quantity: Column) -> DataFrame:
    """Sum of price times discount of some dates, discounts and quantities; the date is an existence test."""
    lines = select(ssb_lineorder(t, span), F.col("lo_discount").between(low * 100, high * 100), quantity)
    lines = semi_join(lines, ["lo_orderdate"], select(ssb_date(t), dates), ["d_datekey"])
    return global_aggr(lines, {"revenue": exact_sum(F.col("lo_extendedprice") * F.col("lo_discount"), 4)})


def star(t: Catalog, keys: list[str], measure: str, date: Column | None = None, part: Column | None = None, supplier: Column | None = None, customer: Column | None = None, span: tuple[str, str] | None = None) -> DataFrame:
    """Lines joined with the dimensions that are filtered or grouped by, grouped by keys. measure: revenue or profit."""

    def wanted(prefix: str, condition: Column | None) -> list[str] | None:
        own = [k for k in keys if k.startswith(prefix)]
        return own if own or condition is not None else None

    out = ssb_lineorder(t, span)
    needs_cost = measure == "profit"
    for prefix, condition, table, probe, build in (
        ("p_", part, ssb_part, "lo_partkey", "p_partkey"),
        ("s_", supplier, ssb_supplier, "lo_suppkey", "s_suppkey"),
        ("c_", customer, ssb_customer, "lo_custkey", "c_custkey"),
        ("d_", date, ssb_date, "lo_orderdate", "d_datekey"),
    ):
        columns = wanted(prefix, condition)
        if columns is None and not (prefix == "p_" and needs_cost):
            continue
        dim = table(t) if condition is None else select(table(t), condition)
        columns = (columns or []) + (["p_cost"] if prefix == "p_" and needs_cost else [])
        out = hash_join(out, [probe], dim, [build], columns)
    value = F.col("lo_revenue") - F.col("p_cost") if needs_cost else F.col("lo_revenue")
    return hash_aggr(out, keys, {measure: exact_sum(value, 2)})


def _sql(select_: str, joins: str, where: str, group: str | None) -> str:
    return f"with {STAR_SQL}\nselect {select_} from lo join d on lo_orderdate = d_datekey {joins} where {where} " + (f"group by {group}" if group else "having count(*) > 0")


_P, _S, _C = "join p on lo_partkey = p_partkey", "join su on lo_suppkey = s_suppkey", "join cu on lo_custkey = c_custkey"
_REV1 = "cast(sum(lo_extendedprice * lo_discount) as decimal(30,4)) revenue"
_REV, _PROFIT = "cast(sum(lo_revenue) as decimal(30,2)) revenue", "cast(sum(lo_revenue - lo_supplycost) as decimal(30,2)) profit"
_C1, _C2 = CITIES
_cities = f"c_city in ('{_C1}', '{_C2}') and s_city in ('{_C1}', '{_C2}')"


def _both(column: str, value) -> dict[str, Column]:
    values = value if isinstance(value, tuple) else (value,)
    return {"customer": one_of(F.col(f"c_{column}"), "eq", *values), "supplier": one_of(F.col(f"s_{column}"), "eq", *values)}


def _brands(t: Catalog, part: Column, region: str) -> DataFrame:
    return star(t, ["d_year", "p_brand1"], "revenue", part=part, supplier=F.col("s_region") == region)


def _cities_of(t: Catalog, date: Column, span: tuple[str, str]) -> DataFrame:
    return star(t, ["c_city", "s_city", "d_year"], "revenue", date, span=span, **_both("city", CITIES))


def _flight4(t: Catalog, keys: list[str], date: Column | None = None, span: tuple[str, str] | None = None) -> DataFrame:
    return star(t, keys, "profit", date, span=span, part=one_of(F.col("p_mfgr"), "eq", "MFGR#1", "MFGR#2"), **_both("region", "AMERICA"))


def _qty() -> Column:
    return F.col("lo_quantity")


def _year() -> Column:
    return F.col("d_year")


_NINETIES = "d_year between 1992 and 1997"

#: name: (query over a catalog, SQL)
CATALOGUE = {
    "ssb_q11": (lambda t: flight1(t, _year() == YEAR, _years(YEAR, YEAR), 1, 3, _qty() < 25), _sql(_REV1, "", f"d_year = {YEAR} and lo_discount between 1 and 3 and lo_quantity < 25", None)),
    "ssb_q12": (
        lambda t: flight1(t, F.col("d_yearmonthnum") == YEAR * 100 + 1, (f"{YEAR}-01-01", f"{YEAR}-02-01"), 4, 6, _qty().between(26, 35)),
        _sql(_REV1, "", f"d_yearmonthnum = {YEAR}01 and lo_discount between 4 and 6 and lo_quantity between 26 and 35", None),
    ),
    "ssb_q13": (
        lambda t: flight1(t, (F.col("d_weeknuminyear") == 6) & (_year() == YEAR), (f"{YEAR}-02-05", f"{YEAR}-02-12"), 5, 7, _qty().between(26, 35)),
        _sql(_REV1, "", f"d_weeknuminyear = 6 and d_year = {YEAR} and lo_discount between 5 and 7 and lo_quantity between 26 and 35", None),
    ),
    "ssb_q21": (
        lambda t: _brands(t, F.col("p_category") == "MFGR#12", "AMERICA"),
        _sql(f"d_year, p_brand1, {_REV}", f"{_P} {_S}", "p_category = 'MFGR#12' and s_region = 'AMERICA'", "d_year, p_brand1"),
    ),
    "ssb_q22": (
        lambda t: _brands(t, F.col("p_brand1").between("MFGR#2221", "MFGR#2228"), "ASIA"),
        _sql(f"d_year, p_brand1, {_REV}", f"{_P} {_S}", "p_brand1 between 'MFGR#2221' and 'MFGR#2228' and s_region = 'ASIA'", "d_year, p_brand1"),
    ),
    "ssb_q23": (
        lambda t: _brands(t, F.col("p_brand1") == "MFGR#2221", "EUROPE"),
        _sql(f"d_year, p_brand1, {_REV}", f"{_P} {_S}", "p_brand1 = 'MFGR#2221' and s_region = 'EUROPE'", "d_year, p_brand1"),
    ),
    "ssb_q31": (
        lambda t: star(t, ["c_nation", "s_nation", "d_year"], "revenue", _year().between(1992, 1997), span=_years(1992, 1997), **_both("region", "ASIA")),
        _sql(f"c_nation, s_nation, d_year, {_REV}", f"{_S} {_C}", f"c_region = 'ASIA' and s_region = 'ASIA' and {_NINETIES}", "c_nation, s_nation, d_year"),
    ),
    "ssb_q32": (
        lambda t: star(t, ["c_city", "s_city", "d_year"], "revenue", _year().between(1992, 1997), span=_years(1992, 1997), **_both("nation", NATION)),
        _sql(f"c_city, s_city, d_year, {_REV}", f"{_S} {_C}", f"c_nation = '{NATION}' and s_nation = '{NATION}' and {_NINETIES}", "c_city, s_city, d_year"),
    ),
    "ssb_q33": (
        lambda t: _cities_of(t, _year().between(1992, 1997), _years(1992, 1997)),
        _sql(f"c_city, s_city, d_year, {_REV}", f"{_S} {_C}", f"{_cities} and {_NINETIES}", "c_city, s_city, d_year"),
    ),
    "ssb_q34": (
        lambda t: _cities_of(t, F.col("d_yearmonth") == "Dec1997", ("1997-12-01", "1998-01-01")),
        _sql(f"c_city, s_city, d_year, {_REV}", f"{_S} {_C}", f"{_cities} and d_yearmonth = 'Dec1997'", "c_city, s_city, d_year"),
    ),
    "ssb_q41": (
        lambda t: _flight4(t, ["d_year", "c_nation"]),
        _sql(f"d_year, c_nation, {_PROFIT}", f"{_P} {_S} {_C}", "c_region = 'AMERICA' and s_region = 'AMERICA' and p_mfgr in ('MFGR#1', 'MFGR#2')", "d_year, c_nation"),
    ),
    "ssb_q42": (
        lambda t: _flight4(t, ["d_year", "s_nation", "p_category"], _year().isin(1997, 1998), _years(1997, 1998)),
        _sql(
            f"d_year, s_nation, p_category, {_PROFIT}",
            f"{_P} {_S} {_C}",
            "c_region = 'AMERICA' and s_region = 'AMERICA' and d_year in (1997, 1998) and p_mfgr in ('MFGR#1', 'MFGR#2')",
            "d_year, s_nation, p_category",
        ),
    ),
    "ssb_q43": (
        lambda t: star(
            t, ["d_year", "s_city", "p_brand1"], "profit", _year().isin(1997, 1998), F.col("p_category") == "MFGR#14",
            F.col("s_nation") == NATION, F.col("c_region") == "AMERICA", _years(1997, 1998),
        ),
        _sql(
            f"d_year, s_city, p_brand1, {_PROFIT}",
            f"{_P} {_S} {_C}",
            f"c_region = 'AMERICA' and s_nation = '{NATION}' and d_year in (1997, 1998) and p_category = 'MFGR#14'",
            "d_year, s_city, p_brand1",
        ),
    ),
}
