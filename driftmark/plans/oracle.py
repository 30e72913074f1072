"""The same queries in plain SQL, written independently: theta joins and correlated windows
where the Spark side uses equi-joins and blocks."""
from __future__ import annotations

from driftmark.plans.catalogue import MODEL, NEGATIVE, PAGE_END, POSITIVE, PROMPT, SEED
from driftmark.plans.reports import COMPARED

HOLD = 8


def words(values) -> str:
    return ", ".join(f"'{v.upper()}'" for v in values)


def t_central(t: str, df: str) -> str:
    """P(|T| <= |t|) for whole df, each series term from log gamma."""
    cos2, sin = f"(({df}) / (({df}) + ({t}) * ({t})))", f"(abs({t}) / sqrt(({df}) + ({t}) * ({t})))"
    even = (f"{sin} * list_sum(list_transform(range(0, CAST(({df}) // 2 AS BIGINT)), lambda j: "
            f"exp(lgamma(2.0 * j + 1) - 2 * lgamma(j + 1.0) - 2 * j * ln(2.0) + j * ln({cos2}))))")
    odd = (f"(2 / pi()) * (atan(abs({t}) / sqrt({df})) + CASE WHEN ({df}) > 1 THEN {sin} * sqrt({cos2}) * "
           f"list_sum(list_transform(range(0, CAST((({df}) - 1) // 2 AS BIGINT)), lambda j: "
           f"exp(2 * j * ln(2.0) + 2 * lgamma(j + 1.0) - lgamma(2.0 * j + 2) + j * ln({cos2})))) ELSE 0 END)")
    return f"CASE WHEN CAST({df} AS BIGINT) % 2 = 0 THEN {even} ELSE {odd} END"


def r(expr: str, digits: int = 9) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0"


def returns_of(name: str, prices: str) -> str:
    return f"""
{name} AS (
  SELECT p.ticker, c.pos, p.date,
         CASE WHEN lag(c.pos) OVER w = c.pos - 1 THEN p.close / lag(p.close) OVER w - 1 END AS ret
  FROM {prices} p JOIN calendar c ON c.date = p.date
  WINDOW w AS (PARTITION BY p.ticker ORDER BY c.pos))"""


BASE = f"""
WITH RECURSIVE brand_week AS (
  SELECT p_brand AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
         sum(l_extendedprice) AS ext, sum(l_quantity) AS qty
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
prices AS (
  SELECT ticker, date, 1000 + 10 * ln(ext / qty) AS close FROM brand_week
  UNION ALL
  SELECT 'SEC' || CAST(CAST(substr(ticker, 7) AS INT) % 5 AS VARCHAR), date, 1000 + 10 * ln(sum(ext) / sum(qty))
  FROM brand_week GROUP BY 1, 2
  UNION ALL
  SELECT 'MKT', date, 1000 + 10 * ln(sum(ext) / sum(qty)) FROM brand_week GROUP BY 2),
calendar AS (
  SELECT CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS pos, date FROM (SELECT DISTINCT date FROM prices)),
span AS (SELECT max(pos) AS last, max(date) AS last_date FROM calendar),
{returns_of('rets', 'prices')},
first_line AS (
  SELECT l_orderkey, arg_min(l_partkey, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey) AS partkey
  FROM lineitem GROUP BY 1),
docs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS event_id, o_orderkey AS okey, p_brand AS ticker,
         o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)) AS published_at,
         3 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS guidance_tone,
         CAST(o_custkey % 5 - 2 AS INT) AS margins_tone, CAST(o_orderkey % 5 - 2 AS INT) AS demand_tone,
         CAST((o_orderkey // 7) % 5 - 2 AS INT) AS overall_tone,
         o_orderkey % 3 <> 0 AS margins_mentioned, o_orderkey % 3 <> 1 AS demand_mentioned,
         greatest(-2, least(2, 3 - CAST(substr(o_orderpriority, 1, 1) AS INT) + CAST(o_custkey % 3 AS INT) - 1)) AS guidance_other,
         o_totalprice AS size
  FROM orders JOIN first_line ON l_orderkey = o_orderkey JOIN part ON partkey = p_partkey),
scored AS (
  SELECT *, guidance_tone + CAST(0.1 AS DOUBLE) * ((overall_tone + margins_tone + demand_tone) / CAST(3 AS DOUBLE)) AS tone,
         CAST(published_at AS DATE) + CASE WHEN hour(published_at) >= 16 THEN 1 ELSE 0 END AS candidate
  FROM docs),
entry AS (
  SELECT d.candidate, min(c.pos) AS t0_pos FROM (SELECT DISTINCT candidate FROM scored) d
  LEFT JOIN calendar c ON c.date >= d.candidate GROUP BY 1),
dated AS (
  SELECT s.*, e.t0_pos, c.date AS t0 FROM scored s JOIN entry e ON e.candidate = s.candidate
  JOIN calendar c ON c.pos = e.t0_pos),
season_of AS (
  SELECT date AS t0, CASE WHEN month(date) < 3 THEN year(date) || '-03' WHEN month(date) < 6 THEN year(date) || '-06'
                          WHEN month(date) < 9 THEN year(date) || '-09' WHEN month(date) < 12 THEN year(date) || '-12'
                          ELSE (year(date) + 1) || '-03' END AS season FROM calendar)"""


def car_of(suffix: str, hold: int, bench: str, dated: str = "dated", rets: str = "rets") -> str:
    """CTEs ar/win/car/panel for a holding period; ``bench`` is the benchmark ticker expression of r."""
    return f""",
ar{suffix} AS (
  SELECT r.ticker, r.pos, r.ret - b.ret AS ar FROM {rets} r LEFT JOIN {rets} b ON b.ticker = {bench} AND b.pos = r.pos),
win{suffix} AS (
  SELECT k.ticker, k.t0_pos, max(CASE WHEN a.pos = k.t0_pos THEN a.ar END) AS day0,
         sum(CASE WHEN a.pos > k.t0_pos THEN a.ar END ORDER BY a.pos) AS ahead,
         count(CASE WHEN a.pos > k.t0_pos THEN a.ar END) AS seen
  FROM (SELECT DISTINCT ticker, t0_pos FROM {dated}) k
  LEFT JOIN ar{suffix} a ON a.ticker = k.ticker AND a.pos BETWEEN k.t0_pos AND k.t0_pos + {hold}
  WHERE k.ticker IN (SELECT ticker FROM {rets}) GROUP BY 1, 2),
car{suffix} AS (
  SELECT ticker, t0_pos, CASE WHEN ok THEN day0 END AS ar_day0, CASE WHEN ok THEN coalesce(ahead, 0) END AS car
  FROM (SELECT *, t0_pos + {hold} <= (SELECT last FROM span) AND ({hold} - seen) / CAST({hold} AS DOUBLE) <= 0.2 AS ok
        FROM win{suffix})),
panel{suffix} AS (
  SELECT d.*, w.ar_day0, w.car, s.season, d.t0 > DATE '2000-06-30' AS post_cutoff FROM {dated} d
  JOIN car{suffix} w ON w.ticker = d.ticker AND w.t0_pos = d.t0_pos JOIN season_of s ON s.t0 = d.t0)"""


PANEL = BASE + car_of("", HOLD, "'MKT'")

ROWS = PANEL + """,
sig AS (
  SELECT * FROM (
    SELECT 'tone' AS signal, tone AS value, * FROM panel
    UNION ALL SELECT 'guidance_tone', CAST(guidance_tone AS DOUBLE), * FROM panel
    UNION ALL SELECT 'size', size, * FROM panel) WHERE car IS NOT NULL),
every_sig AS (
  SELECT 'tone' AS signal, tone AS value, ticker, t0, published_at, event_id FROM panel
  UNION ALL SELECT 'guidance_tone', CAST(guidance_tone AS DOUBLE), ticker, t0, published_at, event_id FROM panel
  UNION ALL SELECT 'size', size, ticker, t0, published_at, event_id FROM panel)"""


def spearman_of(name: str, source: str, keys: str, x: str = "value", y: str = "car") -> str:
    return f""",
{name}_ranked AS (
  SELECT {keys}, {x} AS x, {y} AS y,
         rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0 AS rx,
         rank() OVER (PARTITION BY {keys} ORDER BY {y}) + (count(*) OVER (PARTITION BY {keys}, {y}) - 1) / 2.0 AS ry
  FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
{name} AS (
  SELECT {keys}, count(*) AS n, min(x) < max(x) AS varies,
         CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(rx, ry) END AS rho
  FROM {name}_ranked GROUP BY {keys})"""


ICS = ROWS + spearman_of("season_rho", "sig", "signal, season") + """,
ics AS (SELECT signal, season, n, rho AS ic FROM season_rho WHERE n >= 10 AND varies)"""

IC_SUMMARY = ICS + f""",
ic_base AS (
  SELECT signal, avg(ic) AS mean_ic, avg(ic) / stddev_samp(ic) * sqrt(count(*)) AS ic_t,
         avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS ic_pos_share, count(*) AS seasons
  FROM ics GROUP BY 1),
halving AS (
  SELECT DISTINCT seasons, CAST(0 AS DOUBLE) AS low, CAST(16 AS DOUBLE) AS high, 0 AS step FROM ic_base
  UNION ALL
  SELECT seasons, CASE WHEN mass < 0.95 THEN middle ELSE low END, CASE WHEN mass < 0.95 THEN high ELSE middle END, step + 1
  FROM (SELECT *, {t_central('middle', '(seasons - 1)')} AS mass FROM (SELECT *, (low + high) / 2 AS middle FROM halving))
  WHERE step < 50),
ic_stats AS (
  SELECT b.signal, mean_ic, ic_t, 1 - ({t_central('ic_t', '(b.seasons - 1)')}) AS ic_p, (h.low + h.high) / 2 AS ic_t_crit,
         ic_pos_share, b.seasons
  FROM ic_base b JOIN halving h ON h.seasons = b.seasons AND h.step = 50)"""

POOLED = """,
scoped AS (SELECT signal, 'all' AS scope, value, car FROM sig
           UNION ALL SELECT signal, 'post', value, car FROM sig WHERE post_cutoff)""" \
    + spearman_of("scope_rho", "scoped", "signal, scope") + """,
pooled AS (
  SELECT signal, max(CASE WHEN scope = 'all' THEN n END) AS n_events, max(CASE WHEN scope = 'all' THEN rho END) AS pooled_ic,
         coalesce(max(CASE WHEN scope = 'post' THEN n END), 0) AS post_cutoff_n,
         max(CASE WHEN scope = 'post' AND n > 10 THEN rho END) AS post_cutoff_pooled_ic
  FROM scope_rho GROUP BY 1)"""

QUANTILED = """,
quantiled AS (
  SELECT signal, season, event_id, ticker, t0_pos, car,
         CAST(greatest(least(ceil(row_number() OVER (PARTITION BY signal, season ORDER BY value, published_at, ticker, event_id)
              / CAST(count(*) OVER (PARTITION BY signal, season) AS DOUBLE) * 5), 5), 1) AS INTEGER) AS quantile
  FROM sig),
hits AS (
  SELECT signal, (count(*) FILTER (quantile = 5 AND car > 0) + count(*) FILTER (quantile = 1 AND car < 0))
           / CAST(count(*) FILTER (quantile IN (1, 5)) AS DOUBLE) AS hit_rate,
         count(*) FILTER (quantile IN (1, 5)) AS hit_n,
         avg(car) FILTER (quantile = 5) AS top_q_car, avg(car) FILTER (quantile = 1) AS bottom_q_car
  FROM quantiled GROUP BY 1)"""

MIDRANK = """,
cells AS (SELECT signal, t0_pos, value, count(*) AS n FROM sig GROUP BY 1, 2, 3),
earlier AS (
  SELECT q.signal, q.t0_pos, q.value, sum(d.n) AS n_prior,
         sum(CASE WHEN d.value < q.value THEN d.n ELSE 0 END) + 0.5 * sum(CASE WHEN d.value = q.value THEN d.n ELSE 0 END) AS mid
  FROM cells q JOIN cells d ON d.signal = q.signal AND d.t0_pos < q.t0_pos GROUP BY 1, 2, 3),
midrank AS (
  SELECT c.signal, c.t0_pos, c.value, CAST(coalesce(e.n_prior, 0) AS BIGINT) AS n_prior,
         CAST(e.mid AS DOUBLE) / CAST(e.n_prior AS DOUBLE) AS hist_pct
  FROM cells c LEFT JOIN earlier e USING (signal, t0_pos, value)),
legs AS (
  SELECT *, CAST(CASE WHEN n_prior >= 40 AND hist_pct <= 0.2 THEN -1 WHEN n_prior >= 40 AND hist_pct >= 0.8 THEN 1
                 ELSE 0 END AS INTEGER) AS leg FROM midrank)"""


def event_book(name: str, source: str, by: str) -> str:
    """Daily event-time returns from (by…, ticker, t0_pos, leg) documents in ``source``."""
    using = f"USING ({by}, pos)"
    return f""",
{name}_open AS (SELECT *, least(t0_pos + {HOLD}, (SELECT last FROM span)) AS until FROM {source}
                WHERE leg <> 0 AND t0_pos < (SELECT last FROM span)),
{name}_held AS (
  SELECT {by}, c.pos, count(*) FILTER (leg = 1) AS names_long, count(*) FILTER (leg = -1) AS names_short,
         count(r.ret) FILTER (leg = 1) AS valid_long, count(r.ret) FILTER (leg = -1) AS valid_short,
         avg(r.ret) FILTER (leg = 1) AS long, avg(r.ret) FILTER (leg = -1) AS short
  FROM {name}_open o JOIN calendar c ON c.pos BETWEEN o.t0_pos + 1 AND o.until
  LEFT JOIN rets r ON r.ticker = o.ticker AND r.pos = c.pos GROUP BY {by}, c.pos),
{name}_flow AS (
  SELECT {by}, pos, count(*) FILTER (leg = 1) AS flow_long, count(*) FILTER (leg = -1) AS flow_short FROM (
    SELECT {by}, leg, t0_pos + 1 AS pos FROM {name}_open UNION ALL
    SELECT {by}, leg, until + 1 FROM {name}_open WHERE until + 1 <= (SELECT last FROM span)) GROUP BY {by}, pos),
{name}_span AS (SELECT {by}, min(pos) AS first, max(pos) AS final FROM {name}_held WHERE valid_long + valid_short > 0 GROUP BY {by}),
{name}_days AS (
  SELECT s.*, c.pos, c.date FROM {name}_span s JOIN calendar c ON c.pos BETWEEN s.first AND s.final),
{name} AS (
  SELECT *, gross - cost AS net FROM (
    SELECT {by}, pos, d.date, h.long, h.short, coalesce(names_long, 0) AS names_long, coalesce(names_short, 0) AS names_short,
           coalesce(CASE WHEN h.long IS NOT NULL AND h.short IS NOT NULL THEN h.long - h.short
                         WHEN h.long IS NOT NULL THEN h.long - m.ret WHEN h.short IS NOT NULL THEN m.ret - h.short END, 0) AS gross,
           (CASE WHEN valid_long > 0 THEN coalesce(flow_long, 0) / CAST(valid_long AS DOUBLE) ELSE 0 END
            + CASE WHEN valid_short > 0 THEN coalesce(flow_short, 0) / CAST(valid_short AS DOUBLE) ELSE 0 END) * 10 / 1e4
           + CASE WHEN coalesce(valid_long, 0) + coalesce(valid_short, 0) > 0 THEN 50 / 1e4 / 252 ELSE 0 END AS cost
    FROM {name}_days d LEFT JOIN {name}_held h {using} LEFT JOIN {name}_flow f {using}
    LEFT JOIN (SELECT pos, ret FROM rets WHERE ticker = 'MKT') m USING (pos)))"""


EVENT_DOCS = """,
event_docs AS (SELECT s.signal, s.event_id, s.ticker, s.t0_pos, l.n_prior, l.leg FROM sig s JOIN legs l USING (signal, t0_pos, value))"""
EVENT_BOOK = MIDRANK + EVENT_DOCS + event_book("evt", "event_docs", "signal")

EXPOSURE = """,
exposure AS (
  SELECT signal, event_positions_long, event_positions_short,
         median(names_long) FILTER (names_long > 0 OR names_short > 0) AS event_median_names_long,
         median(names_short) FILTER (names_long > 0 OR names_short > 0) AS event_median_names_short,
         avg(CASE WHEN long IS NOT NULL AND short IS NOT NULL THEN 1.0 ELSE 0 END) AS event_share_both_legs,
         avg(CASE WHEN (long IS NULL) <> (short IS NULL) THEN 1.0 ELSE 0 END) AS event_share_one_leg
  FROM evt JOIN (SELECT signal, count(*) FILTER (leg = 1) AS event_positions_long,
                        count(*) FILTER (leg = -1) AS event_positions_short FROM event_docs GROUP BY 1) USING (signal)
  GROUP BY 1, 2, 3)"""

# the latest document with a score, whether it has a return or not, at every rebalance that was traded
LAGS = """,
lags AS (
  SELECT * FROM (
    SELECT s.signal, p.rebalance, s.t0, row_number() OVER (PARTITION BY s.signal, p.rebalance, s.ticker ORDER BY s.t0 DESC, s.published_at DESC, s.event_id DESC) AS rn
    FROM every_sig s JOIN period p ON s.t0 < p.rebalance AND s.t0 >= p.rebalance - 100) WHERE rn = 1 AND (signal, rebalance) IN (SELECT (signal, rebalance) FROM numbered))"""

SEASONAL = """,
reb AS (
  SELECT min(date) AS rebalance FROM calendar GROUP BY year(date), month(date) HAVING month(min(date)) IN (3, 6, 9, 12)),
period AS (SELECT rebalance, coalesce(lead(rebalance) OVER (ORDER BY rebalance), (SELECT last_date FROM span)) AS "end" FROM reb),
hold AS (SELECT p.rebalance, p."end", c.pos, c.date, min(c.pos) OVER (PARTITION BY p.rebalance) AS first_pos
         FROM period p JOIN calendar c ON c.date > p.rebalance AND c.date <= p."end"),
latest AS (
  SELECT * FROM (
    SELECT s.signal, p.rebalance, s.ticker, s.value, s.event_id, s.t0,
           row_number() OVER (PARTITION BY s.signal, p.rebalance, s.ticker ORDER BY s.t0 DESC, s.published_at DESC, s.event_id DESC) AS rn
    FROM sig s JOIN period p ON s.t0 < p.rebalance AND s.t0 >= p.rebalance - 100) WHERE rn = 1),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY signal, rebalance ORDER BY value, CAST('0x' || substr(md5(event_id), 1, 8) AS BIGINT), ticker) AS place,
         count(*) OVER (PARTITION BY signal, rebalance) AS n
  FROM latest WHERE rebalance IN (SELECT rebalance FROM hold)),
slegs AS (
  SELECT signal, rebalance, ticker, place, n // 5 AS k, CASE WHEN place <= n // 5 THEN -1 ELSE 1 END AS side,
         dense_rank() OVER (PARTITION BY signal ORDER BY rebalance) AS period_no
  FROM placed WHERE n // 5 >= 3 AND (place <= n // 5 OR place > n - n // 5)),
numbered AS (SELECT DISTINCT signal, rebalance, period_no FROM slegs),
moves AS (
  SELECT signal, period_no, sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) AS turnover
  FROM (SELECT signal, period_no, ticker, side / CAST(k AS DOUBLE) AS w FROM slegs) a
  FULL JOIN (SELECT signal, period_no + 1 AS period_no, ticker, side / CAST(k AS DOUBLE) AS w FROM slegs) b
  USING (signal, period_no, ticker) GROUP BY 1, 2),
turn AS (SELECT n.signal, n.rebalance, m.turnover FROM numbered n JOIN moves m USING (signal, period_no)),
sleg_ret AS (
  SELECT l.signal, h.pos, avg(r.ret) FILTER (side = 1) AS long, avg(r.ret) FILTER (side = -1) AS short
  FROM slegs l JOIN hold h USING (rebalance) JOIN rets r ON r.ticker = l.ticker AND r.pos = h.pos GROUP BY 1, 2),
seas AS (
  SELECT *, gross - cost AS net FROM (
    SELECT t.signal, t.rebalance, h.pos, h.date, x.long, x.short, coalesce(x.long - x.short, 0) AS gross,
           CASE WHEN h.pos = h.first_pos THEN t.turnover * 10 / 1e4 ELSE 0 END + 50 / 1e4 / 252 AS cost
    FROM turn t JOIN hold h USING (rebalance) LEFT JOIN sleg_ret x ON x.signal = t.signal AND x.pos = h.pos)),
holdings AS (
  SELECT l.signal, l.rebalance, p."end", max(l.k) AS n_per_leg, t.turnover,
         string_agg(l.ticker, ' ' ORDER BY place) FILTER (side = 1) AS longs,
         string_agg(l.ticker, ' ' ORDER BY place) FILTER (side = -1) AS shorts, g.period_net
  FROM slegs l JOIN turn t USING (signal, rebalance) JOIN period p USING (rebalance)
  JOIN (SELECT signal, rebalance, product(1 + net) - 1 AS period_net FROM seas GROUP BY 1, 2) g USING (signal, rebalance)
  GROUP BY l.signal, l.rebalance, p."end", t.turnover, g.period_net),
period_stats AS (
  SELECT signal, avg(turnover) AS seasonal_turnover, avg(CASE WHEN period_net > 0 THEN 1.0 ELSE 0 END) AS seasonal_periods_positive,
         count(*) AS seasonal_periods FROM holdings GROUP BY 1)"""


def perf(name: str, source: str, keys: str, ret: str = "ret") -> str:
    return f""",
{name}_w AS (SELECT {keys}, date, {ret} AS ret, product(1 + {ret}) OVER (PARTITION BY {keys} ORDER BY date) AS wealth
             FROM {source} WHERE {ret} IS NOT NULL),
{name}_d AS (SELECT *, wealth / max(wealth) OVER (PARTITION BY {keys} ORDER BY date) - 1 AS dd FROM {name}_w),
{name}_s AS (SELECT {keys}, avg(ret) * 252 AS ann_return, stddev_samp(ret) * sqrt(252) AS ann_vol, arg_max(wealth, date) AS wealth,
                    min(dd) AS max_drawdown, count(*) AS days, count(*) / CAST(252 AS DOUBLE) AS years
             FROM {name}_d GROUP BY {keys} HAVING count(*) >= 2),
{name} AS (SELECT {keys}, ann_return, pow(wealth, 1 / years) - 1 AS cagr, ann_vol,
                  CASE WHEN ann_vol > 0 THEN ann_return / ann_vol END AS sharpe,
                  CASE WHEN ann_vol > 0 THEN sqrt((1 + 0.5 * pow(ann_return / ann_vol, 2)) / years) END AS sharpe_se,
                  max_drawdown, wealth - 1 AS total_return, days FROM {name}_s)"""


BOOKS = ROWS + EVENT_BOOK + SEASONAL + """,
books AS (SELECT 'seasonal' AS kind, signal, date, long, short, gross, net FROM seas
          UNION ALL SELECT 'event', signal, date, long, short, gross, net FROM evt),
series AS (SELECT kind, signal, 'net' AS series, date, net AS ret FROM books
           UNION ALL SELECT kind, signal, 'gross', date, gross FROM books)"""
BOOK_PERF = BOOKS + perf("book_perf", "series", "kind, signal, series")

PERF_COLUMNS = ("ann_return", "cagr", "ann_vol", "sharpe", "sharpe_se", "max_drawdown", "total_return")


def perf_select(digits: int) -> str:
    return ", ".join(f"{r(c, digits)} AS {c}" for c in PERF_COLUMNS) + ", days"


SPLITS = """,
split_lines AS (
  SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_extendedprice AS ext, l_quantity AS qty, p_size,
         l_returnflag, l_linestatus, l_discount, l_tax FROM lineitem JOIN part ON l_partkey = p_partkey),
split_close AS (
  SELECT date, 1000 + 10 * ln(sum(ext) / sum(qty)) AS mkt,
         1000 + 10 * ln(sum(ext) FILTER (p_size <= 25) / sum(qty) FILTER (p_size <= 25)) AS small,
         1000 + 10 * ln(sum(ext) FILTER (p_size > 25) / sum(qty) FILTER (p_size > 25)) AS large,
         1000 + 10 * ln(sum(ext) FILTER (l_returnflag = 'R') / sum(qty) FILTER (l_returnflag = 'R')) AS rr,
         1000 + 10 * ln(sum(ext) FILTER (l_returnflag = 'N') / sum(qty) FILTER (l_returnflag = 'N')) AS nn,
         1000 + 10 * ln(sum(ext) FILTER (l_linestatus = 'O') / sum(qty) FILTER (l_linestatus = 'O')) AS oo,
         1000 + 10 * ln(sum(ext) FILTER (l_linestatus <> 'O') / sum(qty) FILTER (l_linestatus <> 'O')) AS ff,
         1000 + 10 * ln(sum(ext) FILTER (l_discount >= 0.05) / sum(qty) FILTER (l_discount >= 0.05)) AS cheap,
         1000 + 10 * ln(sum(ext) FILTER (l_discount < 0.05) / sum(qty) FILTER (l_discount < 0.05)) AS dear,
         1000 + 10 * ln(sum(ext) FILTER (l_tax >= 0.04) / sum(qty) FILTER (l_tax >= 0.04)) AS taxed,
         1000 + 10 * ln(sum(ext) FILTER (l_tax < 0.04) / sum(qty) FILTER (l_tax < 0.04)) AS untaxed
  FROM split_lines GROUP BY 1),
factors AS (
  SELECT date, mkt / lag(mkt) OVER w - 1 AS "Mkt-RF",
         (small / lag(small) OVER w - 1) - (large / lag(large) OVER w - 1) AS "SMB",
         (rr / lag(rr) OVER w - 1) - (nn / lag(nn) OVER w - 1) AS "HML",
         (oo / lag(oo) OVER w - 1) - (ff / lag(ff) OVER w - 1) AS "RMW",
         (cheap / lag(cheap) OVER w - 1) - (dear / lag(dear) OVER w - 1) AS "CMA",
         (taxed / lag(taxed) OVER w - 1) - (untaxed / lag(untaxed) OVER w - 1) AS "Mom"
  FROM split_close WINDOW w AS (ORDER BY date))"""

# One-factor OLS with Newey-West errors in closed form: X'X is 2 x 2, the middle matrix has three entries.
REGRESSION = """,
xy AS (SELECT r.ticker, r.date, r.ret AS y, m.ret AS x FROM rets r JOIN rets m ON m.ticker = 'MKT' AND m.date = r.date
       WHERE r.ticker LIKE 'Brand%' AND r.ret IS NOT NULL AND m.ret IS NOT NULL),
fit AS (SELECT ticker, regr_intercept(y, x) AS a, regr_slope(y, x) AS b, regr_r2(y, x) AS r2, count(*) AS n,
               sum(x) AS sx, sum(x * x) AS sxx FROM xy GROUP BY 1 HAVING count(*) >= 60),
score AS (SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i, y - a - b * x AS g0, (y - a - b * x) * x AS g1
          FROM xy JOIN fit USING (ticker)),
middle AS (
  SELECT p.ticker,
         sum((CASE WHEN p.i = q.i THEN 1.0 ELSE 1 - abs(p.i - q.i) / 6.0 END) * p.g0 * q.g0) AS m00,
         sum((CASE WHEN p.i = q.i THEN 1.0 ELSE 1 - abs(p.i - q.i) / 6.0 END) * p.g0 * q.g1) AS m01,
         sum((CASE WHEN p.i = q.i THEN 1.0 ELSE 1 - abs(p.i - q.i) / 6.0 END) * p.g1 * q.g1) AS m11
  FROM score p JOIN score q ON q.ticker = p.ticker AND q.i BETWEEN p.i - 5 AND p.i + 5 GROUP BY 1),
inv AS (SELECT fit.*, m00, m01, m11, sxx / (n * sxx - sx * sx) AS i00, -sx / (n * sxx - sx * sx) AS i01, n / (n * sxx - sx * sx) AS i11
        FROM fit JOIN middle USING (ticker)),
reg AS (SELECT ticker, a * 252 AS alpha_ann, a / sqrt(i00 * i00 * m00 + 2 * i00 * i01 * m01 + i01 * i01 * m11) AS alpha_t, r2, n,
               b AS beta_mkt, b / sqrt(i01 * i01 * m00 + 2 * i01 * i11 * m01 + i11 * i11 * m11) AS t_mkt FROM inv)"""


FACTOR_NAMES = ("Mkt-RF", "SMB", "HML", "RMW", "CMA", "Mom")


def six_factor(name: str, source: str, keys: str) -> str:
    """Six-factor OLS with Newey-West errors by orthogonalising: the regressor of interest goes last,
    so its residual x gives beta = <x, y> / <x, x> and its robust variance directly.

    ``source``: keys, date, y. Result: keys, n, r2 and beta/t of c (the constant) and f1..f6.
    """
    columns = ["c"] + [f"f{i}" for i in range(1, 7)]
    out = [f"""
{name}_b AS (
  SELECT * FROM (
    SELECT {keys}, y, CAST(1 AS DOUBLE) AS c, """ + ", ".join(f'f."{f}" AS f{i}' for i, f in enumerate(FACTOR_NAMES, 1)) + f""",
           row_number() OVER (PARTITION BY {keys} ORDER BY s.date) AS i, count(*) OVER (PARTITION BY {keys}) AS n
    FROM {source} s JOIN factors f ON f.date = s.date
    WHERE y IS NOT NULL AND """ + " AND ".join(f'f."{f}" IS NOT NULL' for f in FACTOR_NAMES) + ") WHERE n >= 60)"]
    for target in columns:
        order = [c for c in columns if c != target] + [target]
        previous = f"{name}_b"
        for step, pivot in enumerate(order[:-1]):
            rest = order[step + 1:] + (["y"] if target == "c" else [])
            moved = ", ".join(f"{x} - {pivot} * sum({x} * {pivot}) OVER w / sum({pivot} * {pivot}) OVER w AS {x}" for x in rest)
            out.append(f"{name}_{target}{step} AS (SELECT {keys}, i, {moved} FROM {previous} WINDOW w AS (PARTITION BY {keys}))")
            previous = f"{name}_{target}{step}"
        if target == "c":
            out.append(f"{name}_u AS (SELECT {keys}, i, y - c * sum(y * c) OVER w / sum(c * c) OVER w AS u FROM {previous} WINDOW w AS (PARTITION BY {keys}))")
        out.append(f"""
{name}_{target}s AS (
  SELECT {keys}, i, x.{target} AS x, x.{target} * u AS g, b.y FROM {previous} x JOIN {name}_u USING ({keys}, i) JOIN {name}_b b USING ({keys}, i)),
{name}_{target} AS (
  SELECT {keys}, beta AS beta_{target}, beta / (sqrt(m) / xx) AS t_{target} FROM
    (SELECT {keys}, sum(x * y) / sum(x * x) AS beta, sum(x * x) AS xx FROM {name}_{target}s GROUP BY {keys})
    JOIN (SELECT {", ".join("p." + k for k in keys.split(", "))}, sum((1 - abs(p.i - q.i) / 6.0) * p.g * q.g) AS m FROM {name}_{target}s p
          JOIN {name}_{target}s q ON {" AND ".join(f"p.{k} = q.{k}" for k in keys.split(", "))} AND q.i BETWEEN p.i - 5 AND p.i + 5
          GROUP BY {", ".join("p." + k for k in keys.split(", "))}) USING ({keys}))""")
    joins = " ".join(f"JOIN {name}_{c} USING ({keys})" for c in columns)
    out.append(f"""
{name} AS (
  SELECT * FROM (SELECT {keys}, count(*) AS n, 1 - sum(u * u) / (var_pop(y) * count(*)) AS r2 FROM {name}_u JOIN {name}_b USING ({keys}, i) GROUP BY {keys}) {joins})""")
    return ",\n" + ",\n".join(out)


def six_factor_select(prefix: str = "", digits: int = 6, group: str = "") -> str:
    """Columns as the engine names them; with ``group`` they are picked out of a joined summary."""
    pairs = [("alpha_ann", "beta_c * 252"), ("alpha_t", "t_c"), ("r2", "r2")]
    pairs += [(f"{kind}_{f}", f"{kind}_f{i}") for i, f in enumerate(FACTOR_NAMES, 1) for kind in ("beta", "t")]
    shown = [f'{r(f"max(CASE WHEN kind = {group} THEN {e} END)" if group else e, digits)} AS "{prefix}{n}"' for n, e in pairs]
    count = f'max(CASE WHEN kind = {group} THEN n END) AS "{prefix}n"' if group else f'n AS "{prefix}n"'
    return ", ".join(shown + [count])


def kappa(a: str, b: str, n: str = "1") -> str:
    expected = (f"(sum({n} * {a} * {a}) + sum({n} * {b} * {b}) - 2.0 * sum({n} * {a}) * sum({n} * {b}) / sum({n}))")
    return f"CASE WHEN {expected} > 0 THEN 1 - sum({n} * ({a} - {b}) * ({a} - {b})) / {expected} END"


def agreement_of(source: str, keys: str, a: str, b: str) -> str:
    return spearman_of("agree_rho", source, keys, a, b) + f""",
agreed AS (
  SELECT {keys}, count(*) AS n, avg(CASE WHEN {a} = {b} THEN 1.0 ELSE 0 END) AS exact,
         avg(CASE WHEN abs({a} - {b}) <= 1 THEN 1.0 ELSE 0 END) AS within_one, {kappa(a, b)} AS kappa
  FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {keys})"""


def agreement_select(keys: str) -> str:
    return f"""
SELECT {keys}, agreed.n, {r('exact')} AS exact, {r('within_one')} AS within_one, {r('rho')} AS spearman, {r('kappa')} AS kappa
FROM agreed JOIN agree_rho USING ({keys})"""


# -- texts -----------------------------------------------------------------------------------

def tone_of(positive: str, negative: str, dictionary: str = "") -> str:
    """Tokens by position, positive words with a look at the three before."""
    return f"""
WITH {dictionary} tok AS (
  SELECT doc_id, n_chars, list_transform(regexp_extract_all(text, '[A-Za-z]+(?:''[A-Za-z]+)?'), lambda x: upper(x)) AS w FROM documents),
pos AS (SELECT doc_id, w, len(w) AS words, unnest(range(1, len(w) + 1)) AS i FROM tok),
marked AS (
  SELECT doc_id, CASE WHEN w[i] IN ({positive}) THEN
           CASE WHEN list_has_any(w[greatest(i - 3, 1):i - 1], ['NO', 'NOT', 'NONE', 'NEITHER', 'NEVER', 'NOBODY']) AND i > 1 THEN -1 ELSE 1 END
           WHEN w[i] IN ({negative}) THEN -1 ELSE 0 END AS m FROM pos),
counted AS (
  SELECT t.doc_id, t.n_chars, CAST(len(t.w) AS INTEGER) AS lm_words, CAST(coalesce(p, 0) AS INTEGER) AS lm_pos, CAST(coalesce(n, 0) AS INTEGER) AS lm_neg
  FROM tok t LEFT JOIN (SELECT doc_id, count(*) FILTER (m = 1) AS p, count(*) FILTER (m = -1) AS n FROM marked GROUP BY 1) c
  ON c.doc_id = t.doc_id),
toned AS (SELECT *, CASE WHEN lm_pos + lm_neg > 0 THEN (lm_pos - lm_neg) / CAST(lm_pos + lm_neg AS DOUBLE) ELSE 0 END AS lm FROM counted)"""


TONE = tone_of(words(POSITIVE), words(NEGATIVE))
TONE_SELECT = f"SELECT doc_id, {r('lm')} AS lm, lm_pos, lm_neg, lm_words FROM toned"

BENCH_WORDS = """bench_words AS (
  SELECT word, min(item_id) % 3 = 0 AS positive, max(item_id) % 3 = 1 AS negative FROM (
    SELECT item_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z]+(?:''[A-Za-z]+)?'), lambda x: upper(x))) AS word
    FROM benchmark) GROUP BY 1),"""

MONTHS = ("(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?"
          "|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\\.?")
SUFFIX = "(?:,? (?:Inc|Corp|Corporation|Company|Co|plc)\\.?)?"

def masked_of(named: str) -> str:
    """``masked`` from a CTE body ``named`` (doc_id, body, ticker, name, core). RE2 has no look-around,
    so the ticker rule takes its neighbours along and runs twice; a sign that is no letter stands in
    for the mask until the end, as two tickers may touch."""
    return rf"""
named AS ({named}),
one AS (SELECT *, CASE WHEN length(name) > 2 THEN regexp_replace(body, '(?i)' || regexp_escape(name) || '{SUFFIX}', 'the Company', 'g') ELSE body END AS m1 FROM named),
two AS (SELECT *, CASE WHEN length(core) > 2 THEN regexp_replace(m1, '(?i)' || regexp_escape(core) || '{SUFFIX}', 'the Company', 'g') ELSE m1 END AS m2 FROM one),
three AS (SELECT *, CASE WHEN ticker IS NULL THEN m2 ELSE replace(regexp_replace(regexp_replace(m2,
            '(^|[^A-Za-z])' || regexp_escape(ticker) || '($|[^A-Za-z])', '\1' || chr(1) || '\2', 'g'),
            '(^|[^A-Za-z])' || regexp_escape(ticker) || '($|[^A-Za-z])', '\1' || chr(1) || '\2', 'g'), chr(1), 'TICKER') END AS m3 FROM two),
four AS (SELECT *, regexp_replace(m3, '\b{MONTHS}\s+\d{{1,2}},?\s+(?:19|20)\d{{2}}\b', '[DATE]', 'g') AS m4 FROM three),
five AS (SELECT *, regexp_replace(m4, '\b(?:19|20)\d{{2}}\b', '[YEAR]', 'g') AS m5 FROM four),
masked AS (SELECT doc_id, regexp_replace(m5, '\b(?:fiscal|FY)\s?''?\d{{2}}\b', 'fiscal [YEAR]', 'gi') AS masked FROM five)"""


MASKED = r"""
WITH parts AS (
  SELECT doc_id, text || ' On January 30, 2025 fiscal ''24 ended; since 1999.' AS body, regexp_split_to_array(text, '\s+') AS w FROM documents),""" \
    + masked_of("SELECT doc_id, body, w[4] AS ticker, concat_ws(' ', w[1], w[2], 'Inc.') AS name, concat_ws(' ', w[1], w[2]) AS core FROM parts") \
    + " SELECT doc_id, masked FROM masked"

REVIEW = ("WITH " + masked_of("SELECT doc_id, text AS body, upper(lang) AS ticker, source AS name, source AS core FROM documents") + """
SELECT CAST(row_number() OVER (ORDER BY md5('11|' || doc_id), CAST(doc_id AS VARCHAR)) AS INTEGER) AS number, CAST(doc_id AS VARCHAR) AS event_id,
       CAST(length(masked) AS INTEGER) AS characters FROM masked ORDER BY md5('11|' || doc_id), CAST(doc_id AS VARCHAR) LIMIT 30""")


# What the references in the pages and behind them stand for; the ampersand's come last.
REFERENCES = (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&pound;", "£"), ("&eacute;", "é"), ("&#163;", "£"),
              ("&#x20AC;", "€"), ("&#150;", "–"), ("&amp;", "&"), ("&#38;", "&"))


def _decoded(expr: str) -> str:
    for mark, char in REFERENCES:
        expr = f"replace({expr}, '{mark}', '{char}')"
    return expr


PAGE_TEXT = rf"""
WITH bare AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html || '{PAGE_END.replace("'", "''")}',
    '(?is)<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)', ' ', 'g'), '(?s)<!--.*?(?:-->|\z)', ' ', 'g'), '<[A-Za-z/!?][^>]*>', ' ', 'g') AS t FROM pages),
plain AS (SELECT page_id, {_decoded("t")} AS t FROM bare)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(replace(t, chr(160), ' '), '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM plain"""

PAGE_LINKS = r"""
WITH found AS (
  SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) || '/' AS base, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hrefs FROM pages),
placed AS (SELECT page_id, base, unnest(range(len(hrefs))) AS place, unnest(hrefs) AS href FROM found)
SELECT page_id, CAST(place AS INTEGER) AS place,
       CASE WHEN starts_with(href, 'http') THEN href WHEN starts_with(href, '/') THEN regexp_extract(base, '^[a-z]+://[^/]*') || href ELSE base || href END AS link
FROM placed"""


def log_key(event_id: str) -> str:
    return f"sha1({event_id} || '|{MODEL}|{PROMPT}|1')"


# the two-list balance of the masked text, as the rater of the query counts it
SCORED = ("WITH " + masked_of("SELECT doc_id, text AS body, upper(lang) AS ticker, source AS name, source AS core FROM documents") + f""",
heard AS (SELECT doc_id, list_transform(regexp_extract_all(masked, '[A-Za-z]+(?:''[A-Za-z]+)?'), lambda x: upper(x)) AS w, length(masked) AS size FROM masked),
told AS (SELECT doc_id, size, len(list_filter(w, lambda x: x IN ({words(POSITIVE)}))) AS p, len(list_filter(w, lambda x: x IN ({words(NEGATIVE)}))) AS n FROM heard)
SELECT {log_key('CAST(doc_id AS VARCHAR)')} AS key, CAST(doc_id AS VARCHAR) AS event_id,
       CAST(CASE WHEN p > n THEN 1 WHEN p < n THEN -1 ELSE 0 END AS INTEGER) AS guidance_tone, CAST(p % 5 - 2 AS INTEGER) AS margins_tone,
       CAST(n % 5 - 2 AS INTEGER) AS overall_tone, size || ' characters from ' || source AS reason
FROM told JOIN documents USING (doc_id) WHERE p + n > 0""")

# -- answers and registers -------------------------------------------------------------------

ANSWER_LOG = f"""
WITH log AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS event_id, CAST(l_linenumber % 5 - 2 AS INTEGER) AS guidance_tone, 'build-' || lower(l_returnflag) AS model_id,
         l_shipdate, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_returnflag DESC) AS rn
  FROM lineitem)"""

FILINGS = """
WITH filing AS (
  SELECT o_custkey AS company_no, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '8-K' ELSE '10-Q' END AS form,
         substr(o_orderpriority, 1, 1) AS prio, o_orderdate,
         printf('%010d-24-%06d', o_orderkey, o_orderkey % 1000) AS acc FROM orders),
company AS (
  SELECT 'C.' || c_custkey AS ticker, unnest(list_distinct(list_filter([CASE WHEN c_custkey % 6 <> 0 THEN c_custkey END,
         c_custkey + 1], lambda x: x IS NOT NULL))) AS company_no FROM customer WHERE c_custkey % 2 = 0)
SELECT c.ticker || '_' || f.acc AS event_id, c.ticker, f.o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)) + INTERVAL 312 SECOND AS published_at,
       'sec_8k_ex99' AS source, f.form, 'https://www.sec.gov/Archives/edgar/data/' || f.company_no || '/' || replace(f.acc, '-', '') || '/' AS url
FROM filing f JOIN company c USING (company_no)
WHERE form = '8-K' AND prio IN ('2', '4') AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2000-12-31'
  AND NOT ('C.' || f.company_no = c.ticker AND o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING max(l_returnflag) = 'R'))"""

LABELS = TONE + """,
ratings AS (
  SELECT l.doc_id, CAST(quality - toxic AS INTEGER) AS human, CASE WHEN lm > 0.3 THEN 1 WHEN lm < -0.3 THEN -1 ELSE 0 END AS main,
         CAST(n_chars % 3 - 1 AS INTEGER) AS other FROM labels l JOIN toned t ON t.doc_id = l.doc_id)"""

BOOTSTRAP = LABELS + f""",
indexed AS (SELECT human, main, other, row_number() OVER (ORDER BY human, main, other) - 1 AS i, count(*) OVER () AS n FROM ratings),
draws AS (SELECT rep, CAST('0x' || substr(md5('{SEED}|' || rep || '|' || draw), 1, 15) AS BIGINT) % (SELECT max(n) FROM indexed) AS i
          FROM (SELECT unnest(range(1, 2001)) AS rep), (SELECT unnest(range(1, (SELECT max(n) FROM indexed) + 1)) AS draw)),
reps AS (SELECT rep, {kappa('human', 'main')} - {kappa('human', 'other')} AS d FROM draws JOIN indexed USING (i) GROUP BY 1),
spread AS (SELECT quantile_cont(d, 0.05) AS low, quantile_cont(d, 0.95) AS high, count(d) AS replicates FROM reps),
point AS (SELECT count(*) AS n, {kappa('human', 'main')} AS kappa_main, {kappa('human', 'other')} AS kappa_other FROM ratings)
SELECT n, {r('kappa_main')} AS kappa_main, {r('kappa_other')} AS kappa_other, {r('kappa_main - kappa_other')} AS kappa_difference,
       {r('low')} AS low, {r('high')} AS high, replicates,
       CASE WHEN low > 0 THEN 'main agrees more' WHEN high < 0 THEN 'other agrees more' WHEN abs(kappa_main - kappa_other) < 0.1 THEN 'about equal'
            WHEN kappa_main > kappa_other THEN 'inconclusive, leans main' ELSE 'inconclusive, leans other' END AS verdict
FROM point, spread"""

PERIODS = ROWS + """,
labelled AS (SELECT *, CASE WHEN t0 <= DATE '1997-12-31' THEN '1 up to early cutoff' WHEN t0 <= DATE '2000-06-30' THEN '2 between cutoffs'
                       ELSE '3 after late cutoff' END AS period FROM sig)""" \
    + spearman_of("period_rho", "labelled", "period, signal") + f""",
tested AS (SELECT period, signal, n, rho, 1 - ({t_central('(rho * sqrt((n - 2) / (1 - rho * rho)))', '(n - 2)')}) AS p FROM period_rho)
SELECT period, signal, n AS documents, {r('CASE WHEN n >= 10 THEN rho END', 7)} AS rank_corr, {r('CASE WHEN n >= 10 THEN greatest(p, 0) END', 7)} AS p,
       n < 10 AS too_few, n >= 10 AND n < 100 AS small, n >= 10 AND n < 100 AND p <= 0.05 AS flagged FROM tested"""

CAR_SELECT = f"SELECT event_id, ticker, t0, {r('ar_day0')} AS ar_day0, {r('car')} AS car FROM panel"

WEALTH = BOOKS + f""",
grid AS (SELECT kind, date, signal FROM (SELECT DISTINCT kind, date FROM books WHERE true)
         JOIN (SELECT DISTINCT kind, signal FROM books WHERE true) USING (kind)),
aligned AS (SELECT kind, signal, date, coalesce(net, 0) AS ret FROM grid LEFT JOIN books USING (kind, signal, date))
SELECT kind, signal, date, {r('product(1 + ret) OVER (PARTITION BY kind, signal ORDER BY date)')} AS wealth FROM aligned"""

DAILY = BOOKS + """
SELECT date, """ + ", ".join(
    f"""{r(f"max(CASE WHEN signal = '{s}' AND kind = '{k}' THEN {c} END)")} AS {s}_{label}_{c}"""
    for s in ("tone", "guidance_tone", "size") for k, label in (("seasonal", "seasonal"), ("event", "event_time"))
    for c in ("gross", "net")) + f""", {r("max(market)")} AS "market_MKT"
FROM books LEFT JOIN (SELECT date, ret AS market FROM rets WHERE ticker = 'MKT') USING (date) GROUP BY date"""

DELAYS = ROWS + MIDRANK + EVENT_DOCS + """,
delayed AS (SELECT signal, delay_days, ticker, t0_pos + delay_days AS t0_pos, leg FROM event_docs,
            (SELECT unnest([0, 5, 10, 20, 40]) AS delay_days))""" + event_book("dly", "delayed", "signal, delay_days") \
    + perf("dly_perf", "dly", "signal, delay_days", "net") \
    + f" SELECT signal, CAST(delay_days AS INTEGER) AS delay_days, {r('sharpe', 8)} AS sharpe_net, {r('ann_return', 8)} AS ann_return_net FROM dly_perf"

MAIN_TEST = IC_SUMMARY + SEASONAL + perf("seas_perf", "seas", "signal", "net") + """,
wide AS (SELECT s.*, p.sharpe AS seasonal_net_sharpe, p.sharpe_se AS seasonal_net_sharpe_se FROM ic_stats s LEFT JOIN seas_perf p USING (signal))"""


def unpivoted(source: str, columns, digits: int) -> str:
    return " UNION ALL ".join(
        f"SELECT signal, '{c}' AS measure, {r(c, digits)} AS value FROM {source}" for c in columns)


def summary_perf() -> str:
    columns = []
    for kind in ("seasonal", "event"):
        for series in ("net", "gross"):
            for stat in PERF_COLUMNS:
                columns.append(f"""{r(f"max(CASE WHEN kind = '{kind}' AND series = '{series}' THEN {stat} END)", 7)} AS {kind}_{series}_{stat}""")
            columns.append(f"max(CASE WHEN kind = '{kind}' AND series = '{series}' THEN days END) AS {kind}_{series}_days")
    return ", ".join(columns)


SUMMARY = (IC_SUMMARY + POOLED + QUANTILED + BOOKS[len(ROWS):] + EXPOSURE + perf("book_perf", "series", "kind, signal, series") + SPLITS
           + """,
nets AS (SELECT kind, signal, date, net AS y FROM books)""" + six_factor("ff", "nets", "kind, signal") + f""",
perf_wide AS (SELECT signal, {summary_perf()} FROM book_perf GROUP BY 1),
ff_wide AS (SELECT signal, {six_factor_select('ff_', 6, "'seasonal'")}, {six_factor_select('ffe_', 6, "'event'")} FROM ff GROUP BY 1)
SELECT p.signal, n_events, {r('pooled_ic', 7)} AS pooled_ic, post_cutoff_n, {r('post_cutoff_pooled_ic', 7)} AS post_cutoff_pooled_ic,
       {r('mean_ic', 7)} AS mean_ic, {r('ic_t', 7)} AS ic_t, {r('ic_p', 7)} AS ic_p, {r('ic_t_crit', 7)} AS ic_t_crit,
       {r('ic_pos_share', 7)} AS ic_pos_share, seasons, {r('hit_rate', 7)} AS hit_rate, hit_n, {r('top_q_car', 7)} AS top_q_car,
       {r('bottom_q_car', 7)} AS bottom_q_car, {r('seasonal_turnover', 7)} AS seasonal_turnover,
       {r('seasonal_periods_positive', 7)} AS seasonal_periods_positive, seasonal_periods, event_positions_long, event_positions_short,
       event_median_names_long, event_median_names_short, {r('event_share_both_legs', 7)} AS event_share_both_legs,
       {r('event_share_one_leg', 7)} AS event_share_one_leg, w.* EXCLUDE (signal), f.* EXCLUDE (signal)
FROM pooled p LEFT JOIN ic_stats i USING (signal) LEFT JOIN hits h USING (signal) LEFT JOIN period_stats s USING (signal)
LEFT JOIN exposure e USING (signal) LEFT JOIN perf_wide w USING (signal) LEFT JOIN ff_wide f USING (signal)""")


_NET = "(SELECT sharpe FROM book_perf b WHERE b.signal = p.signal AND b.kind = '{}' AND b.series = 'net') AS {}_net_sharpe"
COMPARISON = (IC_SUMMARY + POOLED + QUANTILED + BOOKS[len(ROWS):] + perf("book_perf", "series", "kind, signal, series") + f""",
all_stats AS (SELECT *, {_NET.format('event', 'event')}, {_NET.format('seasonal', 'seasonal')} FROM pooled p JOIN ic_stats USING (signal) JOIN hits USING (signal))""").replace(
    "SELECT 'tone' AS signal, tone AS value, * FROM panel",
    "SELECT 'guidance_other' AS signal, CAST(guidance_other AS DOUBLE) AS value, * FROM panel") + """
SELECT measure, max(CASE WHEN signal = 'guidance_tone' THEN value END) AS main, max(CASE WHEN signal = 'guidance_other' THEN value END) AS other,
       max(CASE WHEN signal = 'size' THEN value END) AS baseline FROM (""" + unpivoted("all_stats", COMPARED, 7) + ") GROUP BY 1"

SECTOR = BASE + f""",
sector_docs AS (SELECT * REPLACE ('SEC' || CAST(CAST(substr(ticker, 7) AS INT) % 5 AS VARCHAR) AS ticker) FROM dated)""" \
    + car_of("", HOLD, "'MKT'", "sector_docs") + ROWS[len(PANEL):] + ICS[len(ROWS):] \
    + f" SELECT signal, season, n, {r('ic')} AS ic FROM ics"

ORACLE: dict[str, str] = {
    "returns_calendar_row": BASE + f" SELECT ticker, pos, date, {r('ret')} AS ret FROM rets",
    "assign_entry_day": BASE + " SELECT event_id, CASE WHEN okey % 97 <> 0 THEN e.t0_pos END AS t0_pos, CASE WHEN okey % 97 <> 0 THEN c.date END AS t0 FROM scored s JOIN entry e ON e.candidate = s.candidate"
                               " LEFT JOIN calendar c ON c.pos = e.t0_pos",
    "assign_entry_day_lagged": BASE + " SELECT event_id, CASE WHEN okey % 97 <> 0 THEN c.pos END AS t0_pos, CASE WHEN okey % 97 <> 0 THEN c.date END AS t0 FROM scored s JOIN entry e ON e.candidate = s.candidate"
                                      " LEFT JOIN calendar c ON c.pos = e.t0_pos + 2",
    "event_car": PANEL + CAR_SELECT,
    "event_car_to_calendar_end": BASE + car_of("", 20, "'MKT'") + CAR_SELECT,
    "sector_benchmark_car": BASE + car_of("", HOLD, "CASE WHEN r.ticker LIKE 'Brand%' THEN 'SEC' || CAST(CAST(substr(r.ticker, 7) AS INT) % 5 "
                                          "AS VARCHAR) ELSE 'MKT' END") + CAR_SELECT,
    "car_paths": PANEL + f""", path AS (
        SELECT k.ticker, k.t0_pos, d.day, CASE WHEN k.car IS NOT NULL THEN sum(CASE WHEN d.day = 0 THEN 0 ELSE coalesce(a.ar, 0) END)
               OVER (PARTITION BY k.ticker, k.t0_pos ORDER BY d.day) END AS path
        FROM car k JOIN (SELECT unnest(range(0, {HOLD + 1})) AS day) d ON true LEFT JOIN ar a ON a.ticker = k.ticker AND a.pos = k.t0_pos + d.day)
        SELECT event_id, CAST(day AS INTEGER) AS day, {r('path')} AS car FROM panel JOIN path USING (ticker, t0_pos)""",
    "season_labels": BASE + " SELECT event_id, d.t0, season FROM dated d JOIN season_of s ON s.t0 = d.t0",
    "rebalance_calendar": BASE + """ SELECT min(date) AS rebalance FROM calendar WHERE date BETWEEN DATE '1996-03-15' AND DATE '2000-12-31'
        AND month(date) IN (3, 6, 9, 12) GROUP BY year(date), month(date)""",
    "post_cutoff_counts": PANEL + " SELECT season, post_cutoff, count(*) AS documents FROM panel GROUP BY 1, 2",
    "events_in_window": BASE + " SELECT event_id, published_at FROM docs WHERE published_at >= TIMESTAMP '1997-07-01' AND published_at < TIMESTAMP '2000-07-01'",
    "ic_by_season": ICS + f" SELECT signal, season, n, {r('ic')} AS ic FROM ics",
    "ic_summary": IC_SUMMARY + f""" SELECT signal, {r('mean_ic', 8)} AS mean_ic, {r('ic_t', 8)} AS ic_t, {r('ic_p', 8)} AS ic_p,
        {r('ic_t_crit', 8)} AS ic_t_crit, {r('ic_pos_share', 8)} AS ic_pos_share, seasons FROM ic_stats""",
    "ic_season_table": ICS + f""" SELECT season, {r("max(CASE WHEN signal = 'tone' THEN ic END)")} AS tone,
        {r("max(CASE WHEN signal = 'guidance_tone' THEN ic END)")} AS guidance_tone, {r("max(CASE WHEN signal = 'size' THEN ic END)")} AS size
        FROM ics GROUP BY 1""",
    "pooled_spearman": ROWS + POOLED + f""" SELECT signal, n_events, {r('pooled_ic')} AS pooled_ic, post_cutoff_n,
        {r('post_cutoff_pooled_ic')} AS post_cutoff_pooled_ic FROM pooled""",
    "quantile_hit_rate": ROWS + QUANTILED + f""" SELECT signal, {r('hit_rate')} AS hit_rate, hit_n, {r('top_q_car')} AS top_q_car,
        {r('bottom_q_car')} AS bottom_q_car FROM hits""",
    "quantile_members": ROWS + QUANTILED + " SELECT signal, event_id, quantile FROM quantiled",
    "car_path_by_quintile": ROWS + QUANTILED + f""", steps AS (
        SELECT q.signal, q.quantile, q.event_id, d.day, CASE WHEN d.day = 0 THEN 0 ELSE coalesce(a.ar, 0) END AS step
        FROM quantiled q JOIN (SELECT unnest(range(0, {HOLD + 1})) AS day) d ON true LEFT JOIN ar a ON a.ticker = q.ticker AND a.pos = q.t0_pos + d.day),
        paths AS (SELECT *, sum(step) OVER (PARTITION BY signal, event_id ORDER BY day) AS path FROM steps)
        SELECT signal, quantile, CAST(day AS INTEGER) AS day, {r('avg(path)')} AS mean_car FROM paths GROUP BY 1, 2, 3""",
    "period_split_ic": PERIODS,
    "multiple_testing_flags": IC_SUMMARY + f""" SELECT signal, {r('ic_p', 8)} AS ic_p, count(*) OVER () AS tests, {r('0.05 / count(*) OVER ()', 8)} AS bar,
        ic_p < 0.05 AS nominal, ic_p >= 0.05 AND ic_p < 0.10 AS near, ic_p < 0.05 / count(*) OVER () AS survives FROM ic_stats""",
    "ic_chart": ICS + f""" SELECT signal, {r('avg(ic)')} AS mean_ic, {r('1.96 * stddev_samp(ic) / sqrt(count(*))')} AS half_width
        FROM ics GROUP BY 1 HAVING count(*) > 1""",
    "lm_tone": TONE + TONE_SELECT,
    "lm_tone_joined": tone_of("SELECT word FROM bench_words WHERE positive", "SELECT word FROM bench_words WHERE negative", BENCH_WORDS) + TONE_SELECT,
    "mask_identity": MASKED,
    "html_to_text": PAGE_TEXT,
    "page_links": PAGE_LINKS,
    "volume_estimate": f"SELECT count(*) AS documents, {r('sum(length(text)) / 4e6')} AS million_tokens FROM documents",
    "parsed_answers": BASE + """ SELECT event_id, guidance_tone, margins_tone, demand_tone, overall_tone, margins_mentioned, demand_mentioned,
        CASE WHEN okey % 11 = 0 THEN '(reason cut off at the length limit)' ELSE 'order ' || event_id END AS reason, okey % 11 = 0 AS reason_truncated
        FROM docs WHERE okey % 13 <> 0 AND okey % 17 <> 0""",
    "rejected_answers": BASE + """ SELECT event_id, CASE WHEN okey % 13 = 0 THEN 'not readable' ELSE 'overall_tone missing or out of range' END AS error
        FROM docs WHERE okey % 13 = 0 OR okey % 17 = 0""",
    "scored_documents": SCORED,
    "latest_answers": ANSWER_LOG + f" SELECT {log_key('event_id')} AS key, event_id, guidance_tone, model_id FROM log WHERE rn = 1",
    "incremental_todo": f"""SELECT {log_key('CAST(o_orderkey AS VARCHAR)')} AS key, CAST(o_orderkey AS VARCHAR) AS event_id FROM orders
        WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
    "model_version": ANSWER_LOG + " SELECT string_agg(model_id, ', ' ORDER BY model_id) AS model_version FROM (SELECT DISTINCT model_id FROM log)",
    "hash_sample": BASE + f" SELECT event_id, ticker FROM docs ORDER BY md5('{SEED}|' || event_id), event_id LIMIT 40",
    "first_documents": BASE + " SELECT event_id, ticker, published_at FROM docs ORDER BY published_at, ticker, event_id LIMIT 50",
    "review_sample": REVIEW,
    "build_tone_signals": BASE + f""" SELECT event_id, {r('tone')} AS tone, CAST(guidance_tone AS DOUBLE) AS tone_guidance,
        CAST(CASE WHEN margins_mentioned THEN margins_tone ELSE 0 END AS DOUBLE) AS tone_margins,
        CAST(CASE WHEN demand_mentioned THEN demand_tone ELSE 0 END AS DOUBLE) AS tone_demand, CAST(overall_tone AS DOUBLE) AS tone_overall FROM scored""",
    "signal_delta": BASE + """ SELECT event_id, CAST(guidance_tone - lag(guidance_tone) OVER (PARTITION BY ticker ORDER BY published_at, event_id) AS DOUBLE)
        AS tone_delta FROM docs""",
    "history_midrank": ROWS + MIDRANK + f" SELECT signal, t0_pos, {r('value')} AS value, n_prior, {r('hist_pct')} AS hist_pct FROM midrank",
    "event_time_legs": ROWS + MIDRANK + EVENT_DOCS + " SELECT signal, event_id, n_prior, leg FROM event_docs",
    "event_time_returns": ROWS + EVENT_BOOK + f""" SELECT signal, pos, date, {r('long')} AS long, {r('short')} AS short, {r('gross')} AS gross,
        {r('cost')} AS cost, {r('net')} AS net, names_long, names_short FROM evt""",
    "book_exposure": ROWS + EVENT_BOOK + EXPOSURE + f""" SELECT signal, event_positions_long, event_positions_short, event_median_names_long,
        event_median_names_short, {r('event_share_both_legs')} AS event_share_both_legs, {r('event_share_one_leg')} AS event_share_one_leg FROM exposure""",
    "entry_delay_sweep": DELAYS,
    "seasonal_holdings": ROWS + SEASONAL + f""" SELECT signal, rebalance, "end", n_per_leg, {r('turnover')} AS turnover, longs, shorts,
        {r('period_net')} AS period_net FROM holdings""",
    "seasonal_turnover": ROWS + SEASONAL + f" SELECT signal, rebalance, {r('turnover')} AS turnover FROM turn",
    "seasonal_period_stats": ROWS + SEASONAL + f""" SELECT signal, {r('seasonal_turnover')} AS seasonal_turnover,
        {r('seasonal_periods_positive')} AS seasonal_periods_positive, seasonal_periods FROM period_stats""",
    "seasonal_returns": ROWS + SEASONAL + f""" SELECT signal, rebalance, pos, date, {r('long')} AS long, {r('short')} AS short, {r('gross')} AS gross,
        {r('cost')} AS cost, {r('net')} AS net FROM seas""",
    "days_to_trade": ROWS + SEASONAL + LAGS + " SELECT signal, median(rebalance - t0) AS median_days_to_trade FROM lags GROUP BY 1",
    "book_performance": BOOK_PERF + f" SELECT kind, signal, series, {perf_select(8)} FROM book_perf",
    "fund_performance": BASE + perf("fund_perf", "rets", "ticker") + f" SELECT ticker, {perf_select(9)} FROM fund_perf",
    "wealth_chart": WEALTH,
    "daily_return_matrix": DAILY,
    "run_meta": ROWS + SEASONAL + LAGS + """ SELECT count(*) AS n_events, count(DISTINCT ticker) AS n_tickers, min(t0) AS first_event, max(t0) AS last_event,
        CAST(8 AS INTEGER) AS hold_days, false AS has_factors,
        'market' AS benchmark, 10.0::DOUBLE AS cost_bps, 50.0::DOUBLE AS borrow_bps, DATE '2000-06-30' AS training_cutoff, 'rater-a' AS rater,
        (SELECT string_agg('build-' || flag, ', ' ORDER BY flag) FROM (SELECT DISTINCT lower(l_returnflag) AS flag FROM lineitem)) AS model_version, (SELECT median(rebalance - t0) FROM lags WHERE signal = 'tone') AS median_days_to_trade FROM panel""",
    "scored_events": PANEL + f""" SELECT event_id, ticker, published_at, t0, season, post_cutoff, {r('ar_day0')} AS ar_day0, {r('car')} AS car_1_8,
        {r('tone')} AS tone, guidance_tone, {r('size')} AS size FROM panel""",
    "factor_returns": BASE + SPLITS + ' SELECT date, ' + ", ".join(
        f'{r(chr(34) + c + chr(34))} AS "{c}"' for c in ("Mkt-RF", "SMB", "HML", "RMW", "CMA", "Mom")) + " FROM factors",
    "one_factor_regression": BASE + REGRESSION + f""" SELECT ticker, {r('alpha_ann', 7)} AS alpha_ann, {r('alpha_t', 7)} AS alpha_t, {r('r2', 7)} AS r2, n,
        {r('beta_mkt', 7)} AS beta_mkt, {r('t_mkt', 7)} AS t_mkt FROM reg""",
    "six_factor_regression": BASE + SPLITS + ", brand_y AS (SELECT ticker, date, ret AS y FROM rets WHERE ticker LIKE 'Brand%')"
        + six_factor("ff", "brand_y", "ticker") + f" SELECT ticker, {six_factor_select()} FROM ff",
    "factor_files": BASE + SPLITS + f""" SELECT date, {r('round("Mkt-RF" * 100, 4) / 100', 8)} AS mkt_rf, {r('round("SMB" * 100, 4) / 100', 8)} AS smb
        FROM factors WHERE "Mkt-RF" IS NOT NULL AND "SMB" IS NOT NULL""",
    "rater_agreement": BASE + """, pair AS (
        SELECT 'all' AS sample, guidance_tone + CAST(0.1 AS DOUBLE) * overall_tone AS a, guidance_other + CAST(0.1 AS DOUBLE) * demand_tone AS b,
               guidance_tone, guidance_other FROM docs WHERE published_at >= TIMESTAMP '1996-01-01' AND published_at < TIMESTAMP '2001-01-01')"""
        + spearman_of("pair_rho", "pair", "sample", "a", "b") + f"""
        SELECT count(*) AS n, {r('max(rho)')} AS rank_corr, {r('avg(CASE WHEN guidance_tone = guidance_other THEN 1.0 ELSE 0 END)')} AS same_guidance,
        {r('avg(CASE WHEN abs(guidance_tone - guidance_other) <= 1 THEN 1.0 ELSE 0 END)')} AS within_one
        FROM pair JOIN pair_rho USING (sample)""",
    "weighted_kappa": BASE + agreement_of("docs", "ticker", "guidance_tone", "guidance_other") + agreement_select("ticker"),
    "consistency": BASE + """, passes AS (
        SELECT dimension, pass_1, least(pass_1 + CASE WHEN okey % 6 = 0 THEN 1 ELSE 0 END, 2) AS pass_2 FROM (
          SELECT okey, 'guidance_tone' AS dimension, guidance_tone AS pass_1 FROM docs UNION ALL SELECT okey, 'overall_tone', overall_tone FROM docs
          UNION ALL SELECT okey, 'margins_tone', margins_tone FROM docs UNION ALL SELECT okey, 'demand_tone', demand_tone FROM docs))"""
        + agreement_of("passes", "dimension", "pass_1", "pass_2") + agreement_select("dimension"),
    "human_check": LABELS + """, compared AS (
        SELECT 'main' AS comparison, human AS a, main AS b FROM ratings UNION ALL SELECT 'other', human, other FROM ratings
        UNION ALL SELECT 'raters', main, other FROM ratings)""" + agreement_of("compared", "comparison", "a", "b") + agreement_select("comparison"),
    "bootstrap_kappa_ci": BOOTSTRAP,
    "events_upsert": """SELECT event_id, ticker, published_at, source, 'log' AS form, '' AS url, path FROM (
        SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY arrival, ticker, published_at, source, path) AS rn FROM (
          SELECT 1 AS arrival, CAST(event_id AS VARCHAR) AS event_id, event_type AS ticker, ts AS published_at, 'arrival' AS source, props AS path FROM events
          UNION ALL SELECT 0, CAST(event_id AS VARCHAR), event_type, ts, 'register', props FROM events WHERE event_type = 'error')) WHERE rn = 1""",
    "manifest_register": """SELECT upper(role) || '_call_' || strftime(moment, '%Y%m%d%H%M') AS event_id, upper(role) AS ticker, moment AS published_at, path FROM (
        SELECT role, TIMESTAMP '2024-01-01' + to_minutes(conv_id * 10 + turn) AS moment, 'c/' || conv_id || '/' || turn AS path FROM conversations)""",
    "filing_selection": FILINGS,
    "press_release_links": """WITH line AS (
        SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
        ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey),
        ranked AS (SELECT *, CASE l_partkey % 5 WHEN 0 THEN 'EX-99.1' WHEN 1 THEN 'EX-99.2' WHEN 2 THEN 'EX-99' END AS kind FROM line)
        SELECT l_orderkey, arg_min('/d/' || l_partkey || '-' || l_suppkey || '.htm', CASE kind WHEN 'EX-99' THEN 0 WHEN 'EX-99.1' THEN 100 ELSE 200 END + l_linenumber)
        FILTER (kind IS NOT NULL AND l_suppkey % 4 <> 0) AS href FROM ranked GROUP BY 1""",
    "price_panel_assembly": BASE + f""", part_1 AS (
        SELECT replace(ticker, '#', '.') AS ticker, date, CASE WHEN dayofyear(date) % 3 <> 0 THEN close END AS close FROM prices),
        part_2 AS (SELECT replace(ticker, '#', '.') AS ticker, date, CASE WHEN dayofyear(date) % 4 <> 0 THEN close + 1 END AS close FROM prices),
        merged AS (SELECT ticker, date, coalesce(a.close, b.close) AS close FROM part_1 a FULL JOIN part_2 b USING (ticker, date))
        SELECT ticker, date, {r('close', 6)} AS close FROM merged WHERE ticker IN (SELECT ticker FROM merged WHERE close IS NOT NULL)""",
    "missing_price_tickers": BASE + """ SELECT DISTINCT ticker FROM prices p WHERE NOT EXISTS (
        SELECT 1 FROM prices q WHERE q.ticker = p.ticker AND q.close >= (SELECT avg(close) + 2 * stddev_samp(close) FROM prices))""",
    "backtest_summary": SUMMARY,
    "main_test": MAIN_TEST + " " + unpivoted("wide", ("mean_ic", "ic_t", "ic_p", "ic_t_crit", "ic_pos_share", "seasons", "seasonal_net_sharpe",
                                                     "seasonal_net_sharpe_se"), 8),
    "main_verdict": MAIN_TEST + f""" SELECT signal, {r('mean_ic', 8)} AS mean_ic, {r('ic_p', 8)} AS ic_p, ic_p < 0.05 AS significant,
        CASE WHEN seasonal_net_sharpe IS NULL OR seasonal_net_sharpe < 0.5 THEN 'little' ELSE 'profitable' END AS book FROM wide WHERE signal = 'tone'""",
    "noise_flags": BOOKS + SPLITS + ", nets AS (SELECT kind, signal, date, net AS y FROM books)" + six_factor("ff", "nets", "kind, signal")
        + f" SELECT signal, kind AS book, {r('t_c', 6)} AS alpha_t FROM ff WHERE abs(t_c) > 2",
    "model_comparison": COMPARISON,
    "sector_ic": SECTOR,
}
