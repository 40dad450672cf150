"""Tables of the workloads that the folders don't hold, derived from those they do.

The same rules as SQL text, for either engine, are in PARTSUPP_SQL and STAR_SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import day, scaled
from .files import Catalog, cached

_MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"


def partsupp(t: Catalog, parts: DataFrame | None = None) -> DataFrame:
    """One row for each (part, supplier) that was sold; cost in hundredths: 0.6 of the retail price, half rounded up.

    parts: those to take. Lines of others are dropped before the pairs are made distinct, so only pairs that are asked for are shuffled."""
    price = (t["part"] if parts is None else parts).select("p_partkey", _cost().alias("ps_cost"))
    sold = t["lineitem"].select("l_partkey", "l_suppkey").join(price, F.col("l_partkey") == F.col("p_partkey"))
    return sold.select(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey"), "ps_cost").distinct()


def _cost():
    """Hundredths of 0.6 of the price: scale 4 to scale 2, half up."""
    tenths = scaled(F.col("p_retailprice")) * 60
    return F.floor((tenths + 50) / 100).cast("long")


#: Years of the date dimension.
YEARS = (1970, 2070)


def ssb_date(t: Catalog) -> DataFrame:
    """A calendar, which holds every order's date: it is made, not read, and small for any number of orders."""
    first, last = (F.lit(f"{y}-01-01").cast("date") for y in YEARS)
    d = t.spark.range(1).select(F.explode(F.sequence(first, F.date_sub(last, 1), F.expr("interval 1 day"))).alias("d_date"))
    y, m = F.year("d_date").cast("long"), F.month("d_date")
    return d.select(
        "d_date",
        (y * 10000 + m * 100 + F.dayofmonth("d_date")).alias("d_datekey"),
        y.alias("d_year"),
        (y * 100 + m).alias("d_yearmonthnum"),
        F.concat(F.substring(F.lit(_MONTHS), m * 3 - 2, F.lit(3)), y.cast("string")).alias("d_yearmonth"),
        (F.floor((F.dayofyear("d_date") - 1) / 7) + 1).alias("d_weeknuminyear"),
    )


def ssb_part(t: Catalog) -> DataFrame:
    n = F.substring("p_brand", 7, 8).cast("int")
    maker = F.concat(F.lit("MFGR#"), (F.floor((n - 1) / 5) + 1).cast("string"))
    category = F.concat(maker, ((n - 1) % 5 + 1).cast("string"))
    return t["part"].select(
        "p_partkey",
        maker.alias("p_mfgr"),
        category.alias("p_category"),
        F.concat(category, F.lpad((F.col("p_size") % 40 + 1).cast("string"), 2, "0")).alias("p_brand1"),
        _cost().alias("p_cost"),
    )


def _placed(t: Catalog, table: str, c: str, key: str) -> DataFrame:
    places = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return (
        t[table]
        .select(key, f"{c}_nationkey")
        .join(places, F.col(f"{c}_nationkey") == F.col("n_nationkey"))
        .select(
            key,
            F.col("r_name").alias(f"{c}_region"),
            F.col("n_name").alias(f"{c}_nation"),
            F.concat(F.rpad("n_name", 9, " "), (F.col(key) % 10).cast("string")).alias(f"{c}_city"),
        )
    )


def ssb_supplier(t: Catalog) -> DataFrame:
    return _placed(t, "supplier", "s", "s_suppkey")


def ssb_customer(t: Catalog) -> DataFrame:
    return _placed(t, "customer", "c", "c_custkey")


def ssb_lineorder(t: Catalog, span: tuple[str, str] | None = None) -> DataFrame:
    """Without the supply cost, which comes with the part; money and discount (a whole percentage) in hundredths, the revenue's cut half up.

    It is derived once for a session and folder, and read from then on. span: only orders from the first day on and before the second; its files
    are ordered by date, so most of them are skipped."""
    made = cached(t.spark, f"{t.session_folder()}/lineorder", lambda: _lineorder(t).repartitionByRange(F.col("o_orderdate")).sortWithinPartitions("o_orderdate"))
    if span is not None:
        made = made.where((F.col("o_orderdate") >= day(span[0])) & (F.col("o_orderdate") < day(span[1])))
    return made.drop("o_orderdate")


def _lineorder(t: Catalog) -> DataFrame:
    lines = t["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    orders = t["orders"].select("o_orderkey", "o_custkey", "o_orderdate")
    price, off = scaled(F.col("l_extendedprice")), scaled(F.col("l_discount"))
    date = F.col("o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("lo_custkey"),
        F.col("l_partkey").alias("lo_partkey"),
        F.col("l_suppkey").alias("lo_suppkey"),
        (F.year(date).cast("long") * 10000 + F.month(date) * 100 + F.dayofmonth(date)).alias("lo_orderdate"),
        F.col("l_quantity").cast("int").alias("lo_quantity"),
        price.alias("lo_extendedprice"),
        (off * 100).alias("lo_discount"),
        F.floor((price * (100 - off) + 50) / 100).cast("long").alias("lo_revenue"),
        "o_orderdate",
    )


PARTSUPP_SQL = """
partsupp as (
  select l_partkey ps_partkey, l_suppkey ps_suppkey,
         cast(max(cast(p_retailprice as decimal(12,2))) * cast(0.60 as decimal(3,2)) as decimal(12,2)) ps_supplycost
  from lineitem join part on l_partkey = p_partkey group by l_partkey, l_suppkey)"""

STAR_SQL = """
b as (select *, cast(substr(p_brand, 7) as int) bn from part),
p as (select p_partkey,
         'MFGR#'||cast(cast(floor((bn-1)/5) as int)+1 as varchar) p_mfgr,
         'MFGR#'||cast(cast(floor((bn-1)/5) as int)+1 as varchar)||cast((bn-1)%5+1 as varchar) p_category,
         'MFGR#'||cast(cast(floor((bn-1)/5) as int)+1 as varchar)||cast((bn-1)%5+1 as varchar)
                ||lpad(cast(p_size%40+1 as varchar), 2, '0') p_brand1,
         cast(p_retailprice as decimal(18,2)) rp from b),
d as (select distinct cast(o_orderdate as date) d_date,
         year(o_orderdate)*10000+month(o_orderdate)*100+day(o_orderdate) d_datekey,
         cast(year(o_orderdate) as bigint) d_year,
         year(o_orderdate)*100+month(o_orderdate) d_yearmonthnum,
         substr('JanFebMarAprMayJunJulAugSepOctNovDec', cast(month(o_orderdate)*3-2 as int), 3)
                ||cast(year(o_orderdate) as varchar) d_yearmonth,
         cast(floor((dayofyear(o_orderdate)-1)/7) as int)+1 d_weeknuminyear from orders),
su as (select s_suppkey, r_name s_region, n_name s_nation, rpad(n_name, 9, ' ')||cast(s_suppkey%10 as varchar) s_city
       from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
cu as (select c_custkey, r_name c_region, n_name c_nation, rpad(n_name, 9, ' ')||cast(c_custkey%10 as varchar) c_city
       from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
lo as (select o_custkey lo_custkey, l_partkey lo_partkey, l_suppkey lo_suppkey,
         year(o_orderdate)*10000+month(o_orderdate)*100+day(o_orderdate) lo_orderdate,
         cast(l_quantity as int) lo_quantity,
         cast(l_extendedprice as decimal(18,2)) lo_extendedprice,
         cast(cast(l_discount as decimal(12,2))*100 as decimal(18,2)) lo_discount,
         cast(cast(l_extendedprice as decimal(12,2))*(1-cast(l_discount as decimal(12,2))) as decimal(18,2)) lo_revenue,
         cast(rp*cast(0.60 as decimal(3,2)) as decimal(18,2)) lo_supplycost
       from lineitem join orders on l_orderkey = o_orderkey join p on p_partkey = l_partkey)"""
