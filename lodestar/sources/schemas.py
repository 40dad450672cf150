"""Schemas of the star-schema workloads' text files. Money is decimal; no column is null."""

from pyspark.sql.types import DateType, DecimalType, IntegerType, StringType, StructField, StructType

_M, _W = "decimal(12,2)", "decimal(18,2)"


_TYPES = {"int": IntegerType(), "string": StringType(), "date": DateType(), _M: DecimalType(12, 2), _W: DecimalType(18, 2)}


def _schema(text: str) -> StructType:
    return StructType([StructField(n, _TYPES[t]) for n, t in (x.split() for x in text.split(", "))])


TPCH = {
    "part": _schema(f"p_partkey int, p_name string, p_mfgr string, p_brand string, p_type string, p_size int, p_container string, p_retailprice {_M}, p_comment string"),
    "supplier": _schema(f"s_suppkey int, s_name string, s_address string, s_nationkey int, s_phone string, s_acctbal {_M}, s_comment string"),
    "partsupp": _schema(f"ps_partkey int, ps_suppkey int, ps_availqty int, ps_supplycost {_M}, ps_comment string"),
    "customer": _schema(f"c_custkey int, c_name string, c_address string, c_nationkey int, c_phone string, c_acctbal {_M}, c_mktsegment string, c_comment string"),
    "orders": _schema(f"o_orderkey int, o_custkey int, o_orderstatus string, o_totalprice {_M}, o_orderdate date, o_orderpriority string, o_clerk string, o_shippriority int, o_comment string"),
    "lineitem": _schema(
        f"l_orderkey int, l_partkey int, l_suppkey int, l_linenumber int, l_quantity {_M}, l_extendedprice {_M}, l_discount {_M}, l_tax {_M}, "
        "l_returnflag string, l_linestatus string, l_shipdate date, l_commitdate date, l_receiptdate date, l_shipinstruct string, l_shipmode string, l_comment string"
    ),
    "nation": _schema("n_nationkey int, n_name string, n_regionkey int, n_comment string"),
    "region": _schema("r_regionkey int, r_name string, r_comment string"),
}
SSB = {
    "lineorder": _schema(
        f"lo_orderkey int, lo_linenumber int, lo_custkey int, lo_partkey int, lo_suppkey int, lo_orderdate int, lo_orderpriority string, lo_shippriority string, "
        f"lo_quantity int, lo_extendedprice {_W}, lo_ordtotalprice {_W}, lo_discount {_W}, lo_revenue {_W}, lo_supplycost {_W}, lo_tax int, lo_commitdate int, lo_shipmode string"
    ),
    "part": _schema("p_partkey int, p_name string, p_mfgr string, p_category string, p_brand1 string, p_color string, p_type string, p_size int, p_container string"),
    "supplier": _schema("s_suppkey int, s_name string, s_address string, s_city string, s_nation string, s_region string, s_phone string"),
    "customer": _schema("c_custkey int, c_name string, c_address string, c_city string, c_nation string, c_region string, c_phone string, c_mktsegment string"),
    "date": _schema(
        "d_datekey int, d_date string, d_dayofweek string, d_month string, d_year int, d_yearmonthnum int, d_yearmonth string, d_daynuminweek int, d_daynuminmonth int, "
        "d_daynuminyear int, d_monthnuminyear int, d_weeknuminyear int, d_sellingseason string, d_lastdayinweekfl int, d_lastdayinmonthfl int, d_holidayfl int, d_weekdayfl int"
    ),
}
