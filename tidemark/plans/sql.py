"""Parts of the oracle SQL: the adapters of sources/adapters.py as common table expressions."""


def px(grain: str = "day") -> str:
    return f"px AS (SELECT o_orderpriority AS ticker, date_trunc('{grain}', o_orderdate)::DATE AS d, avg(o_totalprice) AS close FROM orders GROUP BY 1, 2)"


SUPPLIER_PX = "spx AS (SELECT 'S' || l_suppkey AS ticker, date_trunc('week', l_shipdate)::DATE AS d, avg(l_extendedprice / l_quantity) AS close FROM lineitem GROUP BY 1, 2)"

LEDGER = """li AS (SELECT 'B' || (l_suppkey % 7) AS book, 'S' || l_suppkey AS ticker, l_shipdate::DATE AS d,
  CASE WHEN l_returnflag = 'N' THEN 'buy' WHEN l_returnflag = 'R' THEN 'sell' WHEN l_linestatus = 'F' THEN 'dividend' ELSE 'fee' END AS action, * FROM lineitem),
raw AS (SELECT book, ticker, d, action,
  CASE action WHEN 'buy' THEN l_quantity WHEN 'sell' THEN l_quantity * 0.1::DOUBLE ELSE 0 END AS quantity,
  CASE WHEN action IN ('buy', 'sell') THEN l_extendedprice / l_quantity ELSE 0 END AS price,
  CASE WHEN action = 'dividend' THEN 0 ELSE l_tax * 10 END AS fee,
  CASE WHEN action = 'dividend' THEN l_extendedprice * l_discount / 100 ELSE 0 END AS cash,
  l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM li
  UNION ALL SELECT book, ticker, (min(d) - INTERVAL 1 DAY)::DATE, 'buy', 1000, 1500, 0, 0, 0, 0, 0, 0 FROM li GROUP BY book, ticker),
ledger AS (SELECT book, ticker, row_number() OVER (PARTITION BY ticker ORDER BY d,
  CASE WHEN action IN ('deposit', 'buy') THEN 0 WHEN action IN ('dividend', 'fee', 'interest') THEN 1 WHEN action = 'sell' THEN 2 ELSE 3 END,
  l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS ord, d, action, quantity, price, fee, cash FROM raw)"""

SPLITS = """sk AS (SELECT DISTINCT l_suppkey AS k FROM lineitem),
splits AS (SELECT 'S' || k AS ticker, DATE '1998-01-01' AS d, 2.0::DOUBLE AS ratio FROM sk WHERE k % 3 = 0
  UNION ALL SELECT 'S' || k, DATE '1997-06-01', 1.5 FROM sk WHERE k % 3 = 1
  UNION ALL SELECT 'S' || k, DATE '2000-01-01', 0.5 FROM sk WHERE k % 3 = 1)"""

TARGET = "target(ticker, w) AS (VALUES ('1-URGENT', 0.40::DOUBLE), ('2-HIGH', 0.25), ('3-MEDIUM', 0.20), ('4-NOT SPECIFIED', 0.15), ('5-LOW', 0.0))"

HELD = """pm AS (SELECT o_orderpriority AS ticker, date_trunc('month', o_orderdate)::DATE AS d, avg(o_totalprice) AS close FROM orders GROUP BY 1, 2),
lastpx AS (SELECT ticker, arg_max(close, d) AS price FROM pm GROUP BY 1),
held AS (SELECT c_mktsegment AS book, o_orderpriority AS ticker, count(*) * 10.0::DOUBLE + length(o_orderpriority) AS shares FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
hv AS (SELECT book, ticker, shares, shares * price AS value, price FROM held JOIN lastpx USING (ticker))"""

UNIVERSE = """uni AS (SELECT 'P' || p_partkey AS ticker, p_name AS name, p_type AS role, p_brand AS flavor, p_size <= 25 AS core,
  row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS file_ord FROM part)"""

FACTS = """facts AS (SELECT 'P' || p_partkey AS ticker, p_retailprice / 400000 AS expense_ratio, p_size * 1e7 AS aum, p_partkey % 200 * 1000.0::DOUBLE AS avg_volume,
  p_type AS category, (DATE '2001-08-01' - p_size * 60)::DATE AS inception, CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey % 90) / 100.0::DOUBLE END AS top_share FROM part)"""


def counted_start(rep: str, piece: str, most: str, seed: int = 42) -> str:
    """A bootstrap block's start: the same three congruential steps as bootstrap.counted_starts."""
    x = f"(({seed} * 1000003 + {rep} * 8191 + {piece} * 131071 + 12345) % 2147483647)::BIGINT"
    for _ in range(3):
        x = f"(({x}) * 48271 + 11) % 2147483647"
    return f"({x}) % {most}"
