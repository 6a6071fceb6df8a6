"""Building blocks of the oracle SQL: common table expressions over the fixture tables."""

from __future__ import annotations

import math

CATS = "['ALL','AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY']"

SALES = """
sales AS (
  SELECT c_nationkey AS territory_id, coalesce(c_mktsegment, 'ALL') AS category, m AS month, round(sum(l_extendedprice), 2) AS y
  FROM (SELECT c_nationkey, c_mktsegment, CAST(date_trunc('month', l_shipdate) AS DATE) AS m, l_extendedprice
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey) x
  GROUP BY GROUPING SETS ((c_nationkey, c_mktsegment, m), (c_nationkey, m)))"""

PANEL = (
    SALES
    + f""",
facts AS (SELECT * FROM sales WHERE month >= DATE '1998-01-01' AND month < DATE '2000-01-01'),
dense AS (
  SELECT s.territory_id, s.category, CAST(list_position({CATS}, s.category) - 1 AS INTEGER) AS cat_idx, CAST(k AS INTEGER) AS t,
         CAST(DATE '1998-01-01' + to_months(CAST(k AS INTEGER)) AS DATE) AS month
  FROM (SELECT DISTINCT territory_id, category FROM facts) s CROSS JOIN range(24) r(k)),
panel AS (
  SELECT d.*, f.y, CASE WHEN f.y > 0 THEN ln(f.y) END AS ly,
         count(f.y) OVER (PARTITION BY d.territory_id) = 24 * 6 AS is_full
  FROM dense d LEFT JOIN facts f USING (territory_id, category, month)),
nat AS (SELECT category, t, median(ly) AS n FROM panel WHERE is_full GROUP BY category, t),
dec AS (SELECT p.*, n.n, p.ly - n.n AS d FROM panel p LEFT JOIN nat n USING (category, t)),
grid AS (
  SELECT CAST(o AS INTEGER) AS o, CAST(h AS INTEGER) AS h, CAST(o + h AS INTEGER) AS t,
         CASE WHEN o + h BETWEEN 12 AND 17 THEN 'val' ELSE 'test' END AS split,
         CAST(CASE WHEN h <= 2 THEN 0 WHEN h <= 5 THEN 1 ELSE 2 END AS INTEGER) AS h_group
  FROM range(5, 23) a(o) CROSS JOIN range(1, 13) b(h) WHERE o + h BETWEEN 12 AND 23)"""
)

PUBLISHED = """
pub AS (
  SELECT category, CAST(datediff('month', DATE '1998-01-01', month) AS INTEGER) AS t, ln(round(sum(y), 2)) AS l
  FROM sales GROUP BY category, month)"""

#: Local models on d by origin: one row a model, series and target.
LOCAL = """
hist AS (
  SELECT a.territory_id, a.category, a.cat_idx, a.t AS o, a.d AS now,
         arg_max(b.d, b.t) FILTER (WHERE b.d IS NOT NULL) AS last,
         avg(b.d) FILTER (WHERE b.t > a.t - 3) AS m3, avg(b.d) FILTER (WHERE b.t > a.t - 12) AS m12,
         avg(b.d) FILTER (WHERE b.t > a.t - (a.t + 1) // 2) AS h2, avg(b.d) FILTER (WHERE b.t < (a.t + 1) // 2) AS h1,
         max(b.d) FILTER (WHERE b.t = a.t - 12) AS ago,
         list(b.d ORDER BY b.t) FILTER (WHERE b.d IS NOT NULL) AS vals
  FROM dec a JOIN dec b ON a.territory_id = b.territory_id AND a.category = b.category AND b.t <= a.t
  WHERE a.t BETWEEN 5 AND 22
  GROUP BY a.territory_id, a.category, a.cat_idx, a.t, a.d),
cells AS (
  SELECT h.*, g.h, g.t, g.split, g.h_group, s.d AS seas
  FROM hist h JOIN grid g ON h.o = g.o
  JOIN dec s ON s.territory_id = h.territory_id AND s.category = h.category AND s.t = g.t - 12),
local_f AS (
  SELECT 'naive' AS model, territory_id, category, cat_idx, o, h, t, split, h_group, last AS f FROM cells
  UNION ALL SELECT 'mean3', territory_id, category, cat_idx, o, h, t, split, h_group, coalesce(m3, last) FROM cells
  UNION ALL SELECT 'seasonal_naive', territory_id, category, cat_idx, o, h, t, split, h_group, seas FROM cells
  UNION ALL SELECT 'snaive_growth', territory_id, category, cat_idx, o, h, t, split, h_group,
    seas + CASE WHEN o >= 12 THEN now - ago ELSE 12.0 / ((o + 1) // 2) * (h2 - h1) END FROM cells
  UNION ALL SELECT 'ses', territory_id, category, cat_idx, o, h, t, split, h_group,
    CASE WHEN len(vals) > 0 THEN list_reduce(vals, lambda a, x: 0.5 * x + 0.5 * a) END FROM cells
  UNION ALL SELECT 'level_season', territory_id, category, cat_idx, o, h, t, split, h_group,
    coalesce(m3, last) + 0.3 * coalesce(seas - m12, 0) FROM cells)"""


def national(lag: int) -> str:
    """National forecasts with a publication lag: ``natf(method, category, o, h, t, nhat)`` and ``avg3``."""
    return f"""
own_g AS (
  SELECT a.category, a.t AS o, CASE WHEN a.t >= 12 THEN max(a.n) - max(b.n) FILTER (WHERE b.t = a.t - 12)
         ELSE 12.0 / ((a.t + 1) // 2) * (avg(b.n) FILTER (WHERE b.t > a.t - (a.t + 1) // 2) - avg(b.n) FILTER (WHERE b.t < (a.t + 1) // 2)) END AS g
  FROM nat a JOIN nat b ON a.category = b.category AND b.t <= a.t WHERE a.t >= 5 GROUP BY a.category, a.t),
years AS (
  SELECT c.category, g.o, g.h, g.t, k, lt.l - lo.l AS delta, lo.l - lp.l AS growth,
         row_number() OVER (PARTITION BY c.category, g.o, g.h ORDER BY k) AS r
  FROM (SELECT DISTINCT category FROM nat) c CROSS JOIN grid g CROSS JOIN range(1, {4 + (lag > 0)}) x(k)
  JOIN pub lt ON lt.category = c.category AND lt.t = g.t - 12 * k
  JOIN pub lo ON lo.category = c.category AND lo.t = g.o - 12 * k
  JOIN pub lp ON lp.category = c.category AND lp.t = g.o - 12 * k - 12
  WHERE g.t - 12 * k <= g.o - {lag}),
prof AS (SELECT category, o, h, t, avg(delta) AS delta, avg(growth) AS growth FROM years WHERE r <= 3 GROUP BY category, o, h, t),
natf AS (
  SELECT 'snaive_own' AS method, g.category, x.o, x.h, x.t, n.n + 0.5 * g.g AS nhat
  FROM own_g g JOIN grid x ON x.o = g.o JOIN nat n ON n.category = g.category AND n.t = x.t - 12
  UNION ALL
  SELECT 'snaive_nat', n.category, x.o, x.h, x.t, n.n + 0.5 * (a.l - b.l)
  FROM grid x JOIN nat n ON n.t = x.t - 12 JOIN pub a ON a.category = n.category AND a.t = x.o - {lag}
  JOIN pub b ON b.category = n.category AND b.t = x.o - {lag} - 12
  UNION ALL
  SELECT 'nat_profile', p.category, p.o, p.h, p.t, n.n + p.delta FROM prof p JOIN nat n ON n.category = p.category AND n.t = p.o
  UNION ALL
  SELECT 'nat_profile_g', p.category, p.o, p.h, p.t, n.n + p.delta + p.h / 12.0 * 0.5 * (a.l - b.l - p.growth)
  FROM prof p JOIN nat n ON n.category = p.category AND n.t = p.o
  JOIN pub a ON a.category = p.category AND a.t = p.o - {lag} JOIN pub b ON b.category = p.category AND b.t = p.o - {lag} - 12),
avg3 AS (
  SELECT category, o, h, t, CASE WHEN count(nhat) = 3 THEN avg(nhat) END AS nhat
  FROM natf WHERE method IN ('snaive_own', 'snaive_nat', 'nat_profile_g') GROUP BY category, o, h, t)"""


#: All local models with the national average: forecasts with actuals.
FORECASTS = (
    "WITH "
    + PANEL
    + ","
    + PUBLISHED
    + ","
    + LOCAL
    + ","
    + national(1)
    + """,
fc AS (
  SELECT l.*, a.nhat, a.nhat + l.f AS lf, exp(a.nhat + l.f) AS yhat, y.y, yl.y AS ylag
  FROM local_f l LEFT JOIN avg3 a ON a.category = l.category AND a.o = l.o AND a.h = l.h
  JOIN panel y ON y.territory_id = l.territory_id AND y.category = l.category AND y.t = l.t
  LEFT JOIN panel yl ON yl.territory_id = l.territory_id AND yl.category = l.category AND yl.t = l.t - 12)"""
)

METRICS = """round(avg(abs(y - yhat)), 6) + 0.0 AS MAE, round(1 - sum((y - yhat) ** 2) / (var_pop(y) * count(y)), 6) + 0.0 AS R2,
  round(sum(abs(y - yhat)) / sum(abs(y)), 6) + 0.0 AS WAPE, round(avg(2 * abs(y - yhat) / (abs(y) + abs(yhat))), 6) + 0.0 AS sMAPE, count(*) AS n,
  round(1 - sum(CASE WHEN ylag > 0 THEN (ln(y / ylag) - ln(yhat / ylag)) ** 2 END) / (var_pop(CASE WHEN ylag > 0 THEN ln(y / ylag) END) * count(CASE WHEN ylag > 0 THEN ln(y / ylag) END)), 6) + 0.0 AS R2_yoy"""


_U = lambda kind, key: f"CAST(('0x' || substr(md5('{kind}|' || b || '|' || {key}), 1, 8)) AS BIGINT) / 4294967296.0"


def _poisson_sql(u: str) -> str:
    cuts, at, p = [], 0.0, math.exp(-1)
    for k in range(8):
        at += p
        cuts.append(at)
        p /= k + 1
    return " + ".join(f"CAST({u} >= {c!r} AS INTEGER)" for c in cuts)
