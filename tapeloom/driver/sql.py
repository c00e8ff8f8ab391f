"""SQL building blocks for the oracle texts: the same market tables in DuckDB."""

_BARS = """
{p}t AS (
  SELECT l.l_suppkey AS k, s.s_name, CAST(l.l_shipdate AS DATE) AS trade_date,
         CAST(l.l_quantity AS BIGINT) AS qty,
         (10 + l.l_suppkey) * (84 + (l.l_orderkey + 7 * l.l_partkey) % 33) AS px,
         l.l_orderkey * 1000000 + l.l_linenumber * 100000 + l.l_partkey AS ord
  FROM lineitem l LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey {where}
), {p}a AS (
  SELECT trade_date, k, min(s_name) AS s_name, min_by(px, ord) AS o, max(px) AS h,
         min(px) AS lo, max_by(px, ord) AS c,
         CAST(sum(qty) AS BIGINT) AS volume, CAST(sum(px * qty) AS BIGINT) AS amt
  FROM {p}t GROUP BY trade_date, k
), {p}bars AS (
SELECT trade_date, k, {code} AS code,
       (CASE WHEN k % 10 = 0 THEN '*ST ' WHEN k % 10 = 5 THEN 'st ' ELSE '' END) || s_name AS name,
       o / 100 AS open, h / 100 AS high, lo / 100 AS low, c / 100 AS close,
       c AS close_cents, volume, amt / 100 AS amount, amt AS amount_cents
FROM {p}a)"""


def code_of(k: str, unknown: bool = False) -> str:
    rest = f"lpad(CAST({k} % 1000 AS VARCHAR), 3, '0')"
    small = (
        f"CASE {k} % 8 WHEN 0 THEN '600' WHEN 1 THEN '688' WHEN 2 THEN '000' WHEN 3 THEN '300'"
        f" WHEN 4 THEN '430' WHEN 5 THEN '830' WHEN 6 THEN '920' ELSE '601' END"
    )
    odd = f"WHEN {k} % 50 = 49 THEN '510' || {rest} " if unknown else ""
    return (
        f"CASE {odd}WHEN {k} < 1000 THEN {small} || {rest}"
        f" WHEN {k} >= 100000 THEN {small} || {rest} || '-' || CAST({k} // 1000 AS VARCHAR)"
        f" WHEN {k} BETWEEN 30000 AND 30999 THEN CASE WHEN {k} % 2 = 0 THEN '605' ELSE '603' END || {rest}"
        f" ELSE CASE WHEN {k} % 2 = 0 THEN '4' ELSE '8' END || lpad(CAST({k} AS VARCHAR), 5, '0') END"
    )


def suffixed(code: str) -> str:
    return (
        f"CASE WHEN substr({code}, 1, 3) IN ('600','601','603','605','688','689')"
        f" THEN {code} || '.SH'"
        f" WHEN substr({code}, 1, 3) IN ('000','001','002','003','300','301','302')"
        f" THEN {code} || '.SZ'"
        f" WHEN substr({code}, 1, 1) IN ('4','8') OR substr({code}, 1, 3) = '920'"
        f" THEN {code} || '.BJ' ELSE {code} END"
    )


def bars(p: str = "", where: str = "", unknown: bool = False) -> str:
    return _BARS.format(p=p, where=where, code=code_of("k", unknown))


def listed(p: str = "", where: str = "") -> str:
    return bars(p, where) + f""", {p}listed AS (
  SELECT trade_date, {suffixed("code")} AS ticker, name, open, high, low, close, volume, amount,
         amount_cents
  FROM {p}bars)"""


BARS = "WITH " + bars()
LISTED = "WITH " + listed()

PANEL = LISTED + """, lagged AS (
  SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY trade_date) AS pre_close FROM listed
), panel AS (
  SELECT *, CASE WHEN pre_close <> 0 THEN (close - pre_close) / pre_close * 100e0 END AS pct_change,
         coalesce(upper(name) LIKE '%ST%', false) AS is_st
  FROM lagged)"""


def limit_rate(ticker: str, st: str) -> str:
    three, one = f"substr({ticker}, 1, 3)", f"substr({ticker}, 1, 1)"
    return (
        f"CASE WHEN {st} AND {three} IN ('600','601','603','605','000','001','002','003') THEN 5e0"
        f" WHEN {one} IN ('4','8') OR {three} = '920' THEN 30e0"
        f" WHEN {three} IN ('300','301','302','688','689') THEN 20e0 ELSE 10e0 END"
    )


FLAGGED = PANEL + f""", rated AS (
  SELECT *, {limit_rate("ticker", "is_st")} AS limit_pct FROM panel
), priced AS (
  SELECT *, round_even(pre_close * (1e0 + limit_pct / 100e0) * 100e0, 0) / 100e0 AS limit_up_price,
         round_even(pre_close * (1e0 - limit_pct / 100e0) * 100e0, 0) / 100e0 AS limit_down_price
  FROM rated
), flagged AS (
  SELECT *, coalesce(close >= limit_up_price - 0.001e0, false) AS is_limit_up,
         coalesce(close <= limit_down_price + 0.001e0, false) AS is_limit_down
  FROM priced
)"""

VIEW = FLAGGED + """, broken AS (
  SELECT *, coalesce(high >= limit_up_price - 0.001e0 AND NOT is_limit_up, false) AS is_broken_limit,
         sum(CASE WHEN is_limit_up THEN 0 ELSE 1 END)
           OVER (PARTITION BY ticker ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS island
  FROM flagged
), market AS (
  SELECT *, CASE WHEN is_limit_up THEN 'limit_up' WHEN is_limit_down THEN 'limit_down'
              WHEN is_broken_limit THEN 'broken' WHEN pct_change > 0 THEN 'up'
              WHEN pct_change < 0 THEN 'down' ELSE 'flat' END AS candle_state,
         CAST(CASE WHEN is_limit_up THEN
           sum(CASE WHEN is_limit_up THEN 1 ELSE 0 END)
             OVER (PARTITION BY ticker, island ORDER BY trade_date ROWS UNBOUNDED PRECEDING)
           ELSE 0 END AS INTEGER) AS boards
  FROM broken
)"""

RAW = "WITH " + bars(unknown=True) + """, raw AS (
SELECT k * 10 + n AS seq,
       CASE WHEN k % 3 = 0 THEN CAST(trade_date AS VARCHAR)
            WHEN k % 3 = 1 THEN replace(CAST(trade_date AS VARCHAR), '-', '')
            ELSE replace(CAST(trade_date AS VARCHAR), '-', '/') END AS trade_date_text,
       CASE WHEN code LIKE '000%' THEN CAST(TRY_CAST(code AS BIGINT) AS VARCHAR) ELSE code END AS code_text,
       CASE WHEN n = 2 THEN name || ' rev' ELSE name END AS name_text,
       CASE WHEN volume % 17 = 0 THEN '-' ELSE CAST(close AS VARCHAR) END AS close_text,
       CASE WHEN volume % 13 = 0 THEN '' ELSE CAST(volume AS VARCHAR) END AS volume_text,
       CASE WHEN k % 4 = 0 THEN 'yes' WHEN k % 4 = 1 THEN '0' WHEN k % 4 = 2 THEN '否' ELSE 'maybe' END AS flag_text,
       CASE WHEN k % 3 = 0 THEN 'tushare' WHEN k % 3 = 1 THEN 'sina' ELSE 'em' END AS source,
       trade_date, code, CAST(n AS INTEGER) AS n
FROM bars CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 AS n) d
WHERE n = 1 OR k % 7 = 0)"""

_STOCK = code_of("(user_id % (SELECT count(*) FROM supplier))")

NOTES = f"""notes AS (
  SELECT CAST(event_id AS INTEGER) AS id,
         CAST((SELECT min(CAST(l_shipdate AS DATE)) FROM lineitem) + CAST(event_id // 3 % (
           SELECT max(CAST(l_shipdate AS DATE)) - min(CAST(l_shipdate AS DATE)) + 1 FROM lineitem) AS INTEGER)
           AS DATE) AS trade_date,
         CASE WHEN event_id % 3 = 0 THEN 'market' WHEN event_id % 3 = 1 THEN 'theme' ELSE 'stock' END AS scope,
         CASE WHEN event_id % 3 = 0 THEN 'all' WHEN event_id % 3 = 1 THEN event_type
              ELSE {suffixed("(" + _STOCK + ")")} END AS key,
         CASE WHEN event_id % 3 = 1 THEN 'watch ' || ({_STOCK}) || ' ' || props ELSE props END AS content,
         ts AS created_at, {_STOCK} AS stock
  FROM events)"""

PHASES = """phases AS (
  SELECT trade_date, CASE WHEN n % 3 = 0 THEN 'rise' WHEN n % 3 = 1 THEN 'ebb' ELSE 'chaos' END AS phase,
         n % 2 = 0 AS "M1_core", n % 3 = 0 AS "M2_front", n % 5 = 0 AS "M3_identifiable",
         n % 7 = 0 AS "V_triggered"
  FROM (SELECT trade_date, count(*) AS n FROM bars GROUP BY trade_date) x)"""

TRADES = """trades AS (
  SELECT 'T' || CAST(o_orderkey AS VARCHAR) AS trade_id, CAST(o_custkey % 100 AS VARCHAR) AS ticker,
         CAST(o_orderdate AS DATE) AS entry_date, o_totalprice AS entry_price,
         o_orderpriority AS path_type, o_orderstatus AS notes
  FROM orders)"""
