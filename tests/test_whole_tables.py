"""Row-wise queries run over whole tables, and still hold on the rows that they were once limited to."""

import pytest

from marlstone import catalog

from .oracle import FOLDER, connect, rows

LINES, ORDERS = "SELECT count(*) FROM lineitem", "SELECT count(*) FROM orders"
COUNTS = {
    "f67_math": ORDERS,
    "k01_net_amount": LINES,
    "k03_sales_tax": LINES,
    "p02_computed_measure": LINES,
    "h10_xor": "SELECT count(*) FROM customer",
    "j20_date_band": "SELECT count(DISTINCT o_orderkey) FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 30 DAY",
    "j27_dense_grid": "SELECT 31 * count(DISTINCT user_id) FROM events",
}
#: What the queries returned over the id ranges that they had, by the filter that gives these rows.
LIMITED = {
    "k01_net_amount": ("l_orderkey < 300", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_orderkey < 300"),
    "k03_sales_tax": ("l_orderkey < 300", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_tax, 4) AS tax FROM lineitem WHERE l_orderkey < 300"),
    "f67_math": ("o_orderkey < 200", "SELECT o_orderkey, round(o_totalprice / 1000, 0) AS r, abs(-o_custkey) AS a, mod(o_orderkey, 7) AS m, o_orderkey % 5 AS k, power(2, o_orderkey % 10) AS p FROM orders WHERE o_orderkey < 200"),
    "h10_xor": ("c_custkey < 10", "SELECT c_custkey, CAST(0 AS BIGINT) AS zero FROM customer WHERE c_custkey < 10"),
}


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(COUNTS))
def test_no_row_is_left_out(spark, con, name):
    assert catalog.queries()[name](spark, FOLDER).count() == con.execute(COUNTS[name]).fetchone()[0]


@pytest.mark.parametrize("name", sorted(LIMITED))
def test_limited_rows_are_as_before(spark, con, name):
    where, text = LIMITED[name]
    found, cursor = catalog.queries()[name](spark, FOLDER).filter(where), con.execute(text)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows([d[0] for d in cursor.description], cursor.fetchall())


def test_every_user_counts(spark, con):
    pairs = con.execute("SELECT count(DISTINCT (user_id, CAST(ts AS DATE))) FROM events WHERE event_type = 'purchase' AND CAST(ts AS DATE) BETWEEN '2024-01-01' AND '2024-01-31'").fetchone()[0]
    assert catalog.queries()["e17_gap_filling"](spark, FOLDER).agg({"users": "sum"}).first()[0] == pairs
