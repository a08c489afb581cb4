"""SQL for the same inputs that sources.tables projects; queries put their own text after these."""

TRADES = """
trades AS (SELECT l_returnflag || l_linestatus AS ticker, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price, l_quantity AS volume,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount FROM lineitem)"""

NTH = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"

BARS = f"""{TRADES},
bars AS (SELECT ticker, date, first(price ORDER BY {NTH}) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY {NTH}) AS close, sum(volume) AS volume FROM trades GROUP BY ticker, date)"""

NATION_BARS = f"""{TRADES},
nb AS (SELECT CAST(s_nationkey AS VARCHAR) AS ticker, date, last(price ORDER BY {NTH}) AS close FROM trades JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, date)"""

#: Last rows by ticker: number n from the end.
LAST = "row_number() OVER (PARTITION BY ticker ORDER BY date DESC)"


def sma(col: str, n: int, out: str, keys: str = "PARTITION BY ticker ORDER BY date", fn: str = "avg") -> str:
    frame = f"({keys} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) OVER {frame} = {n} THEN {fn}({col}) OVER {frame} END AS {out}"


def ema(xs: str, span: int) -> str:
    """All values of an exponential mean of a list of doubles: states appended one by one."""
    a = 2.0 / (span + 1)
    return f"list_reduce(list_transform({xs}, lambda x: [x]), lambda s, x: list_append(s, s[-1] * (1 - {a!r}::DOUBLE) + x[1] * {a!r}::DOUBLE))"


def decayed(xs: str, n: int) -> str:
    """All sums of q**k x for a list of doubles, q = 1 - 1/n."""
    q = 1.0 - 1.0 / n
    return f"list_reduce(list_transform({xs}, lambda x: [x]), lambda s, x: list_append(s, s[-1] * {q!r}::DOUBLE + x[1]))"
