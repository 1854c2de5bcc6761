"""A retail star over the source tables: fifteen dimensions, three facts, and ten materialised views on them.

Parts are items under a merchandise hierarchy (division, group, department, class, subclass), nations hold stores under an
organisation (chain, area, region, district), days form a 4-5-4 calendar, discounts are promotions. Every table is a
query text that both dialects read; ``[[div a | b]]`` and ``[[days a | b]]`` stand where they differ.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Query, bare, run_sql
from .tables import Table, scratch
from .views import Registry, View

#: The calendar's first day, a Sunday; a fiscal year has 52 weeks, a quarter periods of 4, 5 and 4.
FIRST_DAY, FIRST_YEAR = "1995-01-01", 1995

_N = f"[[days DATE '{FIRST_DAY}' | d]]"
_ITEM = """SELECT p_partkey AS item_id, p_name AS item_desc, CAST(substring(p_brand, 7, 1) AS INT) AS division_id, CAST(substring(p_brand, 7, 2) AS INT) AS group_id,
 CAST(substring(p_brand, 7, 2) AS INT) * 10 + [[div (p_size - 1) | 10]] AS dept_id, (CAST(substring(p_brand, 7, 2) AS INT) * 10 + [[div (p_size - 1) | 10]]) * 10 + (p_size - 1) % 10 AS class_id,
 ((CAST(substring(p_brand, 7, 2) AS INT) * 10 + [[div (p_size - 1) | 10]]) * 10 + (p_size - 1) % 10) * 10 + p_partkey % 3 AS subclass_id,
 CAST(p_retailprice * 0.6 AS DECIMAL(12,2)) AS unit_cost, CAST(p_retailprice AS DECIMAL(12,2)) AS unit_retail, CASE WHEN p_partkey % 25 = 0 THEN 'DISCON' ELSE 'ACTIVE' END AS item_status FROM {part}"""
_STORE = """SELECT n_nationkey * 10 + k AS store_id, n_name || ' ' || CAST(k AS VARCHAR(2)) AS store_name, n_nationkey AS district_id, n_regionkey AS region_id, [[div n_regionkey | 2]] AS area_id, [[div n_regionkey | 2]] % 2 AS chain_id,
 CASE WHEN k = 0 THEN 'FLAGSHIP' WHEN [[div n_regionkey | 2]] % 2 = 1 THEN 'OUTLET' ELSE 'HIGHSTREET' END AS store_format FROM {nation} CROSS JOIN (VALUES (0), (1), (2), (3)) AS s(k)"""

DIMENSIONS = {
    "calendar": ("day_key", f"""SELECT CAST(extract(year FROM d) * 10000 + extract(month FROM d) * 100 + extract(day FROM d) AS BIGINT) AS day_key, d AS calendar_date, {FIRST_YEAR} + [[div {_N} | 364]] AS fiscal_year, [[div ({_N} % 364) | 91]] + 1 AS fiscal_quarter,
 [[div ({_N} % 364) | 91]] * 3 + CASE WHEN {_N} % 91 < 28 THEN 1 WHEN {_N} % 91 < 63 THEN 2 ELSE 3 END AS fiscal_period, ({FIRST_YEAR} + [[div {_N} | 364]]) * 100 + [[div ({_N} % 364) | 7]] + 1 AS week_key, {_N} % 7 + 1 AS day_of_week, {_N} % 7 IN (0, 6) AS is_weekend
 FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM {{lineitem}}) days"""),
    "division": ("division_id", f"SELECT DISTINCT division_id, 'Division ' || CAST(division_id AS VARCHAR(9)) AS division_name FROM ({_ITEM}) i"),
    "group": ("group_id", f"SELECT DISTINCT group_id, division_id, 'Group ' || CAST(group_id AS VARCHAR(9)) AS group_name FROM ({_ITEM}) i"),
    "department": ("dept_id", f"SELECT DISTINCT dept_id, group_id, 20 + dept_id % 40 AS target_margin_pct FROM ({_ITEM}) i"),
    "class": ("class_id", f"SELECT DISTINCT class_id, dept_id FROM ({_ITEM}) i"),
    "subclass": ("subclass_id", f"SELECT DISTINCT subclass_id, class_id FROM ({_ITEM}) i"),
    "item": ("item_id", _ITEM),
    "supplier": ("supplier_id", "SELECT s_suppkey AS supplier_id, s_name AS supplier_name, s_nationkey AS country, 7 + s_suppkey % 5 * 7 AS lead_time_days FROM {supplier}"),
    "chain": ("chain_id", f"SELECT DISTINCT chain_id, CASE WHEN chain_id = 0 THEN 'Full Line' ELSE 'Outlet' END AS chain_name FROM ({_STORE}) s"),
    "area": ("area_id", f"SELECT DISTINCT area_id, chain_id FROM ({_STORE}) s"),
    "region": ("region_id", "SELECT r_regionkey AS region_id, [[div r_regionkey | 2]] AS area_id, r_name AS region_name FROM {region}"),
    "district": ("district_id", "SELECT n_nationkey AS district_id, n_regionkey AS region_id, n_name AS district_name FROM {nation}"),
    "store": ("store_id", _STORE),
    "promotion": ("promo_id", "SELECT DISTINCT CAST(round(l_discount * 100) AS INT) AS promo_id, CASE WHEN l_discount = 0 THEN 'NONE' WHEN l_discount >= 0.05 THEN 'MARKDOWN' ELSE 'MULTIBUY' END AS promo_type FROM {lineitem}"),
    "customer": ("customer_id", "SELECT c_custkey AS customer_id, CASE WHEN c_acctbal > 7500 THEN 'GOLD' WHEN c_acctbal > 5000 THEN 'SILVER' WHEN c_acctbal > 0 THEN 'BRONZE' ELSE 'NONE' END AS loyalty_tier, c_nationkey * 10 + c_custkey % 4 AS home_store_id FROM {customer}"),
}

_LINES = f"""SELECT c.day_key, c.week_key, l_partkey AS item_id, l_suppkey AS supplier_id, c_nationkey * 10 + c_custkey % 4 AS store_id, CAST(round(l_discount * 100) AS INT) AS promo_id, o_custkey AS customer_id, CAST(l_quantity AS BIGINT) AS units,
 CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS sales_retail, CAST(p_retailprice AS DECIMAL(10,2)) * CAST(0.6 AS DECIMAL(2,1)) * CAST(l_quantity AS DECIMAL(6,0)) AS sales_cost, CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS markdown_amt, l_returnflag, [[days CAST(o_orderdate AS DATE) | CAST(l_shipdate AS DATE)]] AS waited
 FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{customer}} ON o_custkey = c_custkey JOIN {{part}} ON l_partkey = p_partkey JOIN ({DIMENSIONS["calendar"][1]}) c ON c.calendar_date = CAST(l_shipdate AS DATE)"""

FACTS = {
    "sales": f"SELECT day_key, week_key, item_id, store_id, promo_id, customer_id, units AS sales_units, sales_retail, sales_cost, markdown_amt FROM ({_LINES}) l",
    "inventory": f"SELECT week_key, item_id, store_id, greatest(0, 120 - sum(units)) AS soh_units, CASE WHEN sum(units) > 60 THEN 60 ELSE 0 END AS on_order_units, sum(sales_cost) AS soh_cost, sum(sales_retail) AS soh_retail FROM ({_LINES}) l GROUP BY week_key, item_id, store_id",
    "receipts": f"SELECT week_key, item_id, supplier_id, units AS ordered_units, CASE WHEN l_returnflag = 'R' THEN units - 1 ELSE units END AS received_units, greatest(0, waited - 60) AS days_late, sales_cost AS receipt_cost FROM ({_LINES}) l",
}


def _sums(*names: str) -> str:
    return ", ".join(f"sum({n}) AS {n}" for n in names)


_SALES = ("sales_units", "sales_retail", "sales_cost", "markdown_amt")
_STOCK = ("soh_units", "soh_cost", "soh_retail")
#: The ten views: the fact, dimensions joined to it, keys, and sums.
VIEWS = {
    "sales_item_week": ("sales", ("item",), "f.week_key, f.item_id, item.dept_id, item.class_id, item.subclass_id", _sums(*_SALES) + ", count(*) AS line_count"),
    "sales_dept_store_week": ("sales", ("item", "store"), "f.week_key, item.dept_id, f.store_id, store.district_id, store.region_id, store.area_id", _sums(*_SALES)),
    "sales_class_week": ("sales", ("item",), "f.week_key, item.class_id, item.dept_id", _sums(*_SALES)),
    "sales_store_day": ("sales", ("calendar",), "f.day_key, f.week_key, f.store_id, calendar.day_of_week, calendar.is_weekend", _sums("sales_units", "sales_retail") + ", count(*) AS line_count"),
    "sales_promo_item_week": ("sales", ("item",), "f.week_key, f.promo_id, f.item_id, item.dept_id", _sums("sales_units", "sales_retail", "markdown_amt")),
    "inv_item_store_week": ("inventory", ("item",), "f.week_key, f.item_id, f.store_id, item.dept_id, item.class_id", _sums("soh_units", "on_order_units", "soh_cost", "soh_retail")),
    "inv_dept_week": ("inventory", ("item",), "f.week_key, item.dept_id", _sums(*_STOCK) + ", count(*) AS sku_store_count"),
    "inv_class_store_week": ("inventory", ("item", "store"), "f.week_key, item.class_id, f.store_id, store.region_id", _sums(*_STOCK)),
    "receipts_supplier_week": ("receipts", (), "f.week_key, f.supplier_id", _sums("ordered_units", "received_units", "receipt_cost") + """, count(*) AS po_lines, sum(CASE WHEN days_late = 0 THEN 1 ELSE 0 END) AS on_time_lines,
 sum(CASE WHEN received_units >= ordered_units THEN 1 ELSE 0 END) AS in_full_lines, sum(CASE WHEN days_late = 0 AND received_units >= ordered_units THEN 1 ELSE 0 END) AS otif_lines"""),
    "receipts_item_week": ("receipts", (), "f.week_key, f.item_id, f.supplier_id", _sums("ordered_units", "received_units", "receipt_cost")),
}


def for_spark(text: str) -> str:
    return re.sub(r"\[\[days (.*?) \| (.*?)\]\]", r"datediff(\2, \1)", _divided(text, "({} div {})"))


def for_duckdb(text: str) -> str:
    return bare(re.sub(r"\[\[days (.*?) \| (.*?)\]\]", r"date_diff('day', \1, \2)", _divided(text, "({} // {})")))


def _divided(text: str, form: str) -> str:
    # a dividend may hold a day count, but no other division
    return re.sub(r"\[\[div ((?:\[\[days .*?\]\]|.)*?) \| (\d+)\]\]", lambda m: form.format(m[1], m[2]), text)


def view_text(name: str, fact: Callable[[str], str], dimension: Callable[[str], str]) -> str:
    base, joined, keys, sums = VIEWS[name]
    joins = " ".join(f"JOIN {dimension(d)} {d} ON {d}.{DIMENSIONS[d][0]} = f.{DIMENSIONS[d][0]}" for d in joined)
    return f"SELECT {keys}, {sums} FROM {fact(base)} f {joins} GROUP BY {keys}"


def plain(df: DataFrame) -> DataFrame:
    """Sums as doubles and longs, as they compare across engines."""
    kind = lambda t: "double" if t.startswith("decimal") else "bigint" if t in ("int", "smallint") else t
    return df.select(*(F.col(c).cast(kind(t)).alias(c) for c, t in df.dtypes))


def _plain_text(text: str, doubles: tuple[str, ...], longs: tuple[str, ...]) -> str:
    return "SELECT * REPLACE (" + ", ".join([f"CAST({c} AS DOUBLE) AS {c}" for c in doubles] + [f"CAST({c} AS BIGINT) AS {c}" for c in longs]) + f") FROM ({text}) AS wide"


class Star:
    """The model's tables over a folder: facts and dimensions by name, built when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def dimension(self, name: str) -> DataFrame:
        return run_sql(self.spark, self.sf_dir, for_spark(DIMENSIONS[name][1]))

    def fact(self, name: str) -> DataFrame:
        return run_sql(self.spark, self.sf_dir, for_spark(FACTS[name]))

    def materialised(self, name: str) -> DataFrame:
        """A view built from its fact and dimensions, written as a versioned table, and read from there."""
        base, joined, _, _ = VIEWS[name]
        held = Registry(self.spark, {base: self.fact(base)} | {d: self.dimension(d) for d in joined})
        text = view_text(name, lambda f: "{f}", lambda d: f"{{{d}}}")
        held.create(View(name, lambda tables: self.spark.sql(text, f=tables[base], **{d: tables[d] for d in joined}), [base, *joined]))
        return held.read(name)


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    star, out = Star(spark, sf_dir), None
    for name, (key, _) in DIMENSIONS.items():
        one = star.dimension(name).agg(F.lit(name).alias("dimension"), F.count("*").alias("n"), F.countDistinct(key).alias("keys"))
        out = one if out is None else out.unionByName(one)
    return out


_SIZES = " UNION ALL ".join(f"SELECT '{name}' AS dimension, count(*) AS n, count(DISTINCT {key}) AS keys FROM ({for_duckdb(text)}) AS t" for name, (key, text) in DIMENSIONS.items())
#: Which fact's key must be in which dimension.
_REFERENCES = [("sales", d) for d in ("calendar", "item", "store", "promotion", "customer")] + [("inventory", "item"), ("inventory", "store"), ("receipts", "item"), ("receipts", "supplier")]


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each fact without a row in a dimension; the fact is written once and read for every check."""
    star, out, held = Star(spark, sf_dir), None, {}
    for fact, name in _REFERENCES:
        if fact not in held:
            held[fact] = Table(spark, scratch(spark, fact)).overwrite(star.fact(fact)).read()
        key = DIMENSIONS[name][0]
        one = held[fact].join(star.dimension(name).select(key), key, "left_anti").agg(F.lit(fact).alias("fact"), F.lit(name).alias("dimension"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


_ORPHANS = " UNION ALL ".join(f"SELECT '{fact}' AS fact, '{name}' AS dimension, count(*) AS n FROM ({for_duckdb(FACTS[fact])}) AS f ANTI JOIN ({for_duckdb(DIMENSIONS[name][1])}) AS d USING ({DIMENSIONS[name][0]})" for fact, name in _REFERENCES)

_MONEY = ("sales_retail", "sales_cost", "markdown_amt", "soh_cost", "soh_retail", "receipt_cost")
_COUNTS = ("sales_units", "soh_units", "on_order_units", "ordered_units", "received_units", "on_time_lines", "in_full_lines", "otif_lines")
_KEYS = ("day_key", "week_key", "item_id", "store_id", "promo_id", "customer_id", "supplier_id", "dept_id", "class_id", "subclass_id", "district_id", "region_id", "area_id", "day_of_week", "days_late")


def _compared(text: str, columns: str) -> str:
    """The oracle's text, its columns in the types of ``plain``."""
    shown = set(re.findall(r"(\w+)(?:,|$)", columns))
    return _plain_text(text, tuple(c for c in _MONEY if c in shown), tuple(c for c in (*_COUNTS, *_KEYS) if c in shown))


_FACT_COLUMNS = {
    "sales": "day_key, week_key, item_id, store_id, promo_id, customer_id, sales_units, sales_retail, sales_cost, markdown_amt",
    "inventory": "week_key, item_id, store_id, soh_units, on_order_units, soh_cost, soh_retail",
    "receipts": "week_key, item_id, supplier_id, ordered_units, received_units, days_late, receipt_cost",
}

QUERIES = [
    Query("e24_dimension_sizes", _sizes, _SIZES),
    Query("e24_orphans", _orphans, _ORPHANS),
    *(Query(f"e24_fct_{name}", lambda spark, sf_dir, name=name: plain(Star(spark, sf_dir).fact(name)), _compared(for_duckdb(text), _FACT_COLUMNS[name])) for name, text in FACTS.items()),
    *(
        Query(f"v13_{name}", lambda spark, sf_dir, name=name: plain(Star(spark, sf_dir).materialised(name)), _compared(view_text(name, lambda f: f"({for_duckdb(FACTS[f])})", lambda d: f"({for_duckdb(DIMENSIONS[d][1])})"), f"{VIEWS[name][2]}, {VIEWS[name][3]}"))
        for name in VIEWS
    ),
]
