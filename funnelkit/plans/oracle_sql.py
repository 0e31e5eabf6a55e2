"""DuckDB twins of the operators, used as the correctness oracle.

Each entry is plain SQL over the driver's tables; the canonical tables are
rebuilt with the same derivation as the Spark binding (``BINDING_SQL``).
Dates come from the same ``Params`` as the Spark run.  Conventions shared with
the Spark side: ratios are doubles rounded to 6 dp, money is summed as
DECIMAL(18,2) and returned as double, counts are BIGINT.
"""

from __future__ import annotations

from funnelkit.functions.predicates import epoch_ms_range, epoch_s_range
from funnelkit.plans.params import FILTERED, LOW_PAYERS, ONE_VERSION, Params, default_params
from funnelkit.sources.binding import BINDING_SQL


def D(d) -> str:
    return f"DATE '{d.isoformat()}'"


def q(v) -> str:
    return "'" + str(v).replace("'", "''") + "'"


def lst(vals) -> str:
    return ", ".join(q(v) for v in vals)


def with_binding(*ctes: str) -> str:
    parts = [BINDING_SQL.strip()] + [c.strip() for c in ctes if c.strip()]
    return "WITH " + ",\n".join(parts)


def pct(n: str, d: str, rounded: bool = True) -> str:
    e = f"CASE WHEN ({d}) > 0 THEN CAST({n} AS DOUBLE) * 100.0 / ({d}) ELSE 0.0 END"
    return f"round({e}, 6)" if rounded else e


def ratio(n: str, d: str, rounded: bool = True) -> str:
    e = f"CASE WHEN ({d}) > 0 THEN CAST({n} AS DOUBLE) / ({d}) ELSE 0.0 END"
    return f"round({e}, 6)" if rounded else e


def money(cond: str | None = None, amount: str = "price_usd") -> str:
    m = f"CAST(COALESCE({amount}, 0) AS DECIMAL(18,2))"
    if cond:
        m = f"CASE WHEN {cond} THEN {m} ELSE CAST(0 AS DECIMAL(18,2)) END"
    return f"CAST(COALESCE(SUM({m}), 0) AS DOUBLE)"


def valid(alias: str = "") -> str:
    a = f"{alias}." if alias else ""
    return (f"({a}payment_platform = 'direct' "
            f"OR ({a}payment_platform = 'apple' AND {a}purchase_id IS NOT NULL AND {a}purchase_id <> '') "
            f"OR ({a}payment_platform = 'googleplay' AND {a}google_order_number IS NOT NULL AND {a}google_order_number <> ''))")


def client_window(p: Params, start=None, end=None, alias: str = "") -> str:
    a = f"{alias}." if alias else ""
    s, e = start or p.start, end or p.end
    lo, hi = epoch_ms_range(s, e)
    return f"{a}date BETWEEN {D(s)} AND {D(e)} AND {a}res_timestamp >= {lo} AND {a}res_timestamp < {hi}"


def server_window(p: Params, start=None, end=None, alias: str = "") -> str:
    a = f"{alias}." if alias else ""
    s, e = start or p.start, end or p.end
    lo, hi = epoch_s_range(s, e)
    return f"{a}date BETWEEN {D(s)} AND {D(e)} AND {a}request_timestamp >= {lo} AND {a}request_timestamp < {hi}"


def attr_filters(p: Params, alias: str = "", os=True, versions=True, countries=True, exclusions=False,
                 floor=False, os_col="os", version_col="version_float", country_col="country") -> str:
    a = f"{alias}." if alias else ""
    conds = []
    if os and p.os:
        conds.append(f"{a}{os_col} IN ({lst(p.os)})")
    if versions and p.versions:
        vs = ", ".join(repr(float(v)) for v in p.versions)
        conds.append(f"{a}{version_col} IN ({vs})")
    if countries and p.countries:
        conds.append(f"{a}{country_col} IN ({lst(p.countries)})")
    if exclusions and p.exclude_testing_countries:
        conds.append(f"{a}{country_col} NOT IN ({lst(p.excluded_countries)})")
    if floor:
        conds.append(f"{a}{version_col} >= {p.version_floor!r}")
    if p.low_payers_only:
        conds.append(f"{a}{country_col} IN (SELECT country_code FROM dim_country WHERE is_low_payers_country)")
    return " AND ".join(conds) if conds else "TRUE"


TEST_LIKE = "'%LiveOpsData.exp_test%'"
CONTROL_LIKE = "'%LiveOpsData.exp_control%'"


def seg_ctes(p: Params, lookback: int = 30, latest: bool = True, name: str = "user_segments") -> str:
    order = "DESC" if latest else "ASC"
    return f"""
{name}_ev AS (
  SELECT distinct_id, date, time, event_id,
    CASE WHEN segments LIKE {TEST_LIKE} THEN 'test' WHEN segments LIKE {CONTROL_LIKE} THEN 'control' END AS segment,
    row_number() OVER (PARTITION BY distinct_id ORDER BY date {order}, time {order}, event_id {order}) AS rn
  FROM client_events
  WHERE event_name = 'config_loaded' AND date >= {D(p.days_before(lookback))}
    AND (segments LIKE {TEST_LIKE} OR segments LIKE {CONTROL_LIKE})
),
{name} AS (SELECT distinct_id, segment, date AS segment_date FROM {name}_ev WHERE rn = 1)"""


def seg_users_cte(p: Params, name: str = "seg_users", home: bool = True) -> str:
    cond = f"p.first_country IN ({lst(p.home_markets)})" if home else "TRUE"
    return seg_ctes(p) + f""",
{name} AS (
  SELECT p.distinct_id, p.first_event_time,
         CAST(date_diff('day', CAST(p.first_event_time AS DATE), {D(p.as_of)}) AS BIGINT) AS days_since_install,
         us.segment, us.segment_date
  FROM dim_player p JOIN user_segments us ON p.distinct_id = us.distinct_id
  WHERE {cond}
)"""


def _a4_active(p: Params) -> str:
    return f"date BETWEEN {D(p.effective_start)} AND {D(p.end)} AND {attr_filters(p, countries=False)}"


def sql_available_versions(p: Params) -> str:
    return with_binding() + f"""
SELECT DISTINCT version_float FROM client_events
WHERE version_float IS NOT NULL AND version_float >= {p.version_floor!r} AND date >= {D(p.days_before(90))}
ORDER BY version_float DESC"""


def sql_available_countries(p: Params) -> str:
    return with_binding() + f"""
SELECT DISTINCT country FROM client_events
WHERE country IS NOT NULL AND country <> '' AND date >= {D(p.days_before(90))}
ORDER BY country"""


def sql_segment_users(p: Params) -> str:
    return with_binding(seg_users_cte(p)) + "\nSELECT * FROM seg_users"


def sql_segment_stats(p: Params) -> str:
    return with_binding(seg_users_cte(p)) + f"""
SELECT segment, COUNT(DISTINCT distinct_id) AS users, round(avg(days_since_install), 1) AS avg_days_since_install
FROM seg_users d
WHERE d.distinct_id IN (SELECT distinct_id FROM client_events WHERE {_a4_active(p)})
GROUP BY segment ORDER BY segment"""


def sql_segment_daily_new_users(p: Params, days: int = 14) -> str:
    return with_binding(seg_ctes(p, latest=False, name="first_seg")) + f"""
SELECT segment_date, segment, COUNT(DISTINCT distinct_id) AS new_users
FROM first_seg WHERE segment_date >= {D(p.days_before(days))}
GROUP BY 1, 2 ORDER BY 1 DESC, 2"""


def sql_segment_daily_new_users_30d(p: Params) -> str:
    return sql_segment_daily_new_users(p, days=30)


def sql_segment_share(p: Params) -> str:
    return with_binding(seg_users_cte(p), f"""
stats AS (
  SELECT segment, COUNT(DISTINCT distinct_id) AS users FROM seg_users d
  WHERE d.distinct_id IN (SELECT distinct_id FROM client_events WHERE {_a4_active(p)})
  GROUP BY segment
),
s AS (
  SELECT CAST(COALESCE(SUM(CASE WHEN segment = 'test' THEN users END), 0) AS BIGINT) AS test_users,
         CAST(COALESCE(SUM(CASE WHEN segment = 'control' THEN users END), 0) AS BIGINT) AS control_users
  FROM stats
)""") + f"""
SELECT test_users, control_users, test_users + control_users AS total_users,
       {pct('test_users', 'test_users + control_users')} AS test_pct,
       {pct('control_users', 'test_users + control_users')} AS control_pct
FROM s"""


def _summary_cte(p: Params) -> str:
    return f"""
summary AS (
  SELECT {money()} AS total_revenue,
         {money("payment_platform = 'direct'")} AS direct_revenue,
         {money("payment_platform IN ('apple', 'googleplay')")} AS store_revenue,
         COUNT(*) AS total_purchases,
         COUNT(CASE WHEN payment_platform = 'direct' THEN 1 END) AS direct_purchases,
         COUNT(CASE WHEN payment_platform IN ('apple', 'googleplay') THEN 1 END) AS store_purchases
  FROM client_events
  WHERE event_name = 'purchase_successful' AND {_a4_active(p)} AND {valid()}
    AND distinct_id IN (SELECT distinct_id FROM seg_users)
)"""


def sql_purchase_summary(p: Params) -> str:
    return with_binding(seg_users_cte(p), _summary_cte(p)) + "\nSELECT * FROM summary"


def sql_purchase_margin(p: Params, fee: float = 0.30) -> str:
    keep = 1.0 - fee
    net = f"(direct_revenue + store_revenue * {keep!r})"
    return with_binding(seg_users_cte(p), _summary_cte(p)) + f"""
SELECT total_revenue, direct_revenue, store_revenue,
  {pct('direct_revenue', 'total_revenue')} AS direct_share_pct,
  {pct('store_revenue', 'total_revenue')} AS store_share_pct,
  round(direct_revenue * {fee!r}, 6) AS direct_savings,
  round(store_revenue * {fee!r}, 6) AS store_fees,
  round(direct_revenue, 6) AS net_direct,
  round(store_revenue * {keep!r}, 6) AS net_store,
  round({net}, 6) AS net_total,
  {pct('direct_revenue', net)} AS net_direct_share_pct,
  {pct(f'store_revenue * {keep!r}', net)} AS net_store_share_pct,
  round(total_revenue - {net}, 6) AS fees_paid,
  {pct(net, 'total_revenue')} AS effective_margin_pct
FROM summary"""


def all_sql(p: Params | None = None) -> dict[str, str]:
    p = p or default_params()
    out = {}
    for name, fn in globals().items():
        if name.startswith("sql_") and callable(fn):
            out[name[4:]] = fn(p)
    return out


# --- cohort analyses (A30-A45) -------------------------------------------------

def _cohort_users(p: Params, segment: str = "test") -> str:
    return seg_users_cte(p) + f""",
cohort_users AS (SELECT distinct_id FROM seg_users WHERE segment = '{segment}')"""


def _cohort_ev(p: Params, names=("purchase_click", "pre_purchase_click", "purchase_successful"), start=None) -> str:
    s = start or p.effective_start
    return f"""
cohort_ev AS (
  SELECT * FROM client_events
  WHERE date BETWEEN {D(s)} AND {D(p.end)} AND event_name IN ({lst(names)})
    AND {attr_filters(p, countries=False)}
    AND distinct_id IN (SELECT distinct_id FROM cohort_users)
)"""


CONT = "event_name = 'pre_purchase_click' AND cta_name = 'continue'"
SUCC = "event_name = 'purchase_successful'"
APPLE_OK = "payment_platform = 'apple' AND purchase_id IS NOT NULL AND purchase_id <> ''"
GOOGLE_OK = "payment_platform = 'googleplay' AND google_order_number IS NOT NULL AND google_order_number <> ''"


def cdf(cond: str, idc: str = "funnel_id") -> str:
    return f"COUNT(DISTINCT CASE WHEN {cond} THEN {idc} END)"


def _cohort_funnel_cte(p: Params) -> str:
    gate = "funnel_id IN (SELECT funnel_id FROM store_continue_funnels)"
    return _cohort_users(p) + "," + _cohort_ev(p) + f""",
store_continue_funnels AS (
  SELECT DISTINCT funnel_id FROM cohort_ev WHERE {CONT} AND payment_platform IN ('apple', 'googleplay')
),
funnel AS (
  SELECT
    {cdf("event_name = 'purchase_click'")} AS purchase_clicks,
    {cdf("event_name = 'purchase_click'", "distinct_id")} AS purchase_click_users,
    {cdf(CONT + " AND payment_platform = 'direct'")} AS direct_continue,
    {cdf(CONT + " AND payment_platform = 'apple'")} AS apple_continue,
    {cdf(CONT + " AND payment_platform = 'googleplay'")} AS google_continue,
    {cdf(SUCC + " AND payment_platform = 'direct'")} AS direct_purchases,
    {cdf(f"{SUCC} AND {APPLE_OK} AND {gate}")} AS apple_purchases,
    {cdf(f"{SUCC} AND {GOOGLE_OK} AND {gate}")} AS google_purchases,
    {money(SUCC + " AND payment_platform = 'direct'")} AS direct_revenue,
    {money(f"{SUCC} AND {APPLE_OK} AND {gate}")} AS apple_revenue,
    {money(f"{SUCC} AND {GOOGLE_OK} AND {gate}")} AS google_revenue,
    {cdf(SUCC + " AND payment_platform = 'direct'", "distinct_id")} AS direct_paying_users,
    {cdf(f"{SUCC} AND {APPLE_OK} AND {gate}", "distinct_id")} AS apple_paying_users,
    {cdf(f"{SUCC} AND {GOOGLE_OK} AND {gate}", "distinct_id")} AS google_paying_users
  FROM cohort_ev
)"""


def sql_cohort_funnel(p: Params) -> str:
    return with_binding(_cohort_funnel_cte(p)) + "\nSELECT * FROM funnel"


def sql_cohort_funnel_summary(p: Params, fee: float = 0.30) -> str:
    keep = 1.0 - fee
    srev = "(apple_revenue + google_revenue)"
    net = f"(direct_revenue + {srev} * {keep!r})"
    gross = f"(direct_revenue + {srev})"
    return with_binding(_cohort_funnel_cte(p)) + f"""
SELECT purchase_clicks,
  direct_purchases + apple_purchases + google_purchases AS total_purchases,
  round({gross}, 6) AS total_revenue,
  direct_continue, direct_purchases, round(direct_revenue, 6) AS direct_revenue,
  {pct('direct_purchases', 'direct_continue')} AS direct_conversion_pct,
  apple_continue + google_continue AS store_continue,
  apple_purchases + google_purchases AS store_purchases,
  round({srev}, 6) AS store_revenue,
  {pct('apple_purchases + google_purchases', 'apple_continue + google_continue')} AS store_conversion_pct,
  round(direct_revenue * {fee!r}, 6) AS direct_savings,
  round({srev} * {fee!r}, 6) AS store_fees,
  round({net}, 6) AS net_total,
  {pct(net, gross)} AS effective_margin_pct
FROM funnel"""


def sql_prepurchase_choice(p: Params) -> str:
    tot = "(direct_continue + apple_continue + google_continue)"
    return with_binding(_cohort_funnel_cte(p)) + f"""
SELECT 'direct' AS choice, direct_continue AS continue_clicks, {pct('direct_continue', tot)} AS pct FROM funnel
UNION ALL
SELECT 'store', apple_continue + google_continue, {pct('apple_continue + google_continue', tot)} FROM funnel"""


def sql_channel_funnel_steps(p: Params) -> str:
    return with_binding(_cohort_funnel_cte(p), """
steps AS (
  SELECT 'direct' AS channel, 'purchase_click' AS step, 1 AS step_order, purchase_clicks AS value FROM funnel
  UNION ALL SELECT 'direct', 'continue', 2, direct_continue FROM funnel
  UNION ALL SELECT 'direct', 'purchase_success', 3, direct_purchases FROM funnel
  UNION ALL SELECT 'store', 'purchase_click', 1, purchase_clicks FROM funnel
  UNION ALL SELECT 'store', 'continue', 2, apple_continue + google_continue FROM funnel
  UNION ALL SELECT 'store', 'purchase_success', 3, apple_purchases + google_purchases FROM funnel
),
kept AS (SELECT * FROM steps WHERE value > 0)""") + f"""
SELECT channel, step, CAST(step_order AS INTEGER) AS step_order, CAST(value AS BIGINT) AS value,
  {pct('value', 'first_value(value) OVER (PARTITION BY channel ORDER BY step_order)')} AS pct_of_first
FROM kept"""


def _cohort_daily_cte(p: Params) -> str:
    store_ok = f"{SUCC} AND (({APPLE_OK}) OR ({GOOGLE_OK}))"
    return _cohort_users(p) + "," + _cohort_ev(p) + f""",
daily AS (
  SELECT date AS event_date,
    {cdf("event_name = 'purchase_click'")} AS purchase_clicks,
    {cdf(CONT + " AND payment_platform = 'direct'")} AS direct_continue,
    {cdf(SUCC + " AND payment_platform = 'direct'")} AS direct_purchases,
    {money(SUCC + " AND payment_platform = 'direct'")} AS direct_revenue,
    {cdf(CONT + " AND payment_platform IN ('apple', 'googleplay')")} AS store_continue,
    {cdf(store_ok)} AS store_purchases,
    {money(store_ok)} AS store_revenue
  FROM cohort_ev GROUP BY date
)"""


def sql_cohort_daily(p: Params) -> str:
    return with_binding(_cohort_daily_cte(p)) + "\nSELECT * FROM daily ORDER BY event_date"


def sql_cohort_daily_conversion(p: Params) -> str:
    return with_binding(_cohort_daily_cte(p)) + f"""
SELECT event_date, {pct('direct_purchases', 'direct_continue')} AS direct_conversion_pct,
       {pct('store_purchases', 'store_continue')} AS store_conversion_pct
FROM daily ORDER BY event_date"""


def _direct_purchases_cte(p: Params) -> str:
    from datetime import timedelta
    s = p.effective_start - timedelta(days=365)
    return _cohort_users(p) + f""",
dp AS (
  SELECT distinct_id, date, funnel_id, time, event_id, CAST(COALESCE(price_usd, 0) AS DECIMAL(18,2)) AS amount,
    row_number() OVER (PARTITION BY distinct_id ORDER BY date, funnel_id NULLS FIRST, time, event_id) AS purchase_number
  FROM client_events
  WHERE date BETWEEN {D(s)} AND {D(p.end)} AND {SUCC} AND payment_platform = 'direct'
    AND {attr_filters(p, countries=False)}
    AND distinct_id IN (SELECT distinct_id FROM cohort_users)
)"""


def _rng(p: Params, c: str = "date") -> str:
    return f"{c} BETWEEN {D(p.effective_start)} AND {D(p.end)}"


def sql_first_vs_repeat(p: Params) -> str:
    return with_binding(_direct_purchases_cte(p)) + f"""
SELECT date AS event_date,
  COUNT(DISTINCT CASE WHEN purchase_number = 1 THEN distinct_id END) AS first_purchase_users,
  COUNT(DISTINCT CASE WHEN purchase_number > 1 THEN distinct_id END) AS repeat_purchase_users
FROM dp WHERE {_rng(p)} GROUP BY date ORDER BY date"""


def _depth_cte(p: Params) -> str:
    return _direct_purchases_cte(p) + f""",
umax AS (SELECT distinct_id, max(purchase_number) AS m FROM dp WHERE {_rng(p)} GROUP BY distinct_id),
depth AS (
  SELECT COUNT(DISTINCT CASE WHEN m >= 1 THEN distinct_id END) AS users_1st_purchase,
         COUNT(DISTINCT CASE WHEN m >= 2 THEN distinct_id END) AS users_2nd_purchase,
         COUNT(DISTINCT CASE WHEN m >= 3 THEN distinct_id END) AS users_3rd_purchase,
         COUNT(DISTINCT CASE WHEN m >= 4 THEN distinct_id END) AS users_4th_plus_purchase
  FROM umax
)"""


def sql_purchase_depth(p: Params) -> str:
    return with_binding(_depth_cte(p)) + "\nSELECT * FROM depth"


def sql_purchase_retention(p: Params) -> str:
    return with_binding(_depth_cte(p)) + f"""
SELECT *, {pct('users_2nd_purchase', 'users_1st_purchase')} AS retention_1_to_2,
  {pct('users_3rd_purchase', 'users_2nd_purchase')} AS retention_2_to_3,
  {pct('users_4th_plus_purchase', 'users_3rd_purchase')} AS retention_3_to_4,
  {pct('users_2nd_purchase', 'users_1st_purchase')} AS cumulative_2nd,
  {pct('users_3rd_purchase', 'users_1st_purchase')} AS cumulative_3rd,
  {pct('users_4th_plus_purchase', 'users_1st_purchase')} AS cumulative_4th
FROM depth"""


def sql_atv_by_purchase_number(p: Params) -> str:
    return with_binding(_direct_purchases_cte(p)) + f"""
SELECT CASE WHEN purchase_number = 1 THEN '1st Purchase' WHEN purchase_number = 2 THEN '2nd Purchase'
            WHEN purchase_number = 3 THEN '3rd Purchase' ELSE '4th+ Purchase' END AS purchase_tier,
       CAST(CASE WHEN purchase_number <= 3 THEN purchase_number ELSE 4 END AS BIGINT) AS tier_order,
       COUNT(*) AS num_purchases,
       CAST(SUM(amount) AS DOUBLE) AS total_revenue,
       round(CAST(SUM(amount) AS DOUBLE) / COUNT(*), 6) AS avg_transaction_value
FROM dp WHERE {_rng(p)} GROUP BY 1, 2 ORDER BY 2"""


def _ttf_cte(p: Params) -> str:
    return _direct_purchases_cte(p) + f""",
firstp AS (SELECT distinct_id, min(date) AS first_purchase_date FROM dp GROUP BY distinct_id),
ttp AS (
  SELECT f.distinct_id, date_diff('day', CAST(pl.first_event_time AS DATE), f.first_purchase_date) AS days
  FROM cohort_users c JOIN dim_player pl ON c.distinct_id = pl.distinct_id
  JOIN firstp f ON f.distinct_id = c.distinct_id
  WHERE {_rng(p, 'f.first_purchase_date')}
),
buckets AS (
  SELECT CASE WHEN days = 0 THEN 'Day 0 (Same day)' WHEN days = 1 THEN 'Day 1'
              WHEN days BETWEEN 2 AND 3 THEN 'Day 2-3' WHEN days BETWEEN 4 AND 7 THEN 'Day 4-7'
              WHEN days BETWEEN 8 AND 14 THEN 'Day 8-14' WHEN days BETWEEN 15 AND 30 THEN 'Day 15-30'
              ELSE 'Day 31+' END AS days_bucket,
         CAST(CASE WHEN days = 0 THEN 1 WHEN days = 1 THEN 2 WHEN days BETWEEN 2 AND 3 THEN 3
              WHEN days BETWEEN 4 AND 7 THEN 4 WHEN days BETWEEN 8 AND 14 THEN 5
              WHEN days BETWEEN 15 AND 30 THEN 6 ELSE 7 END AS BIGINT) AS bucket_order,
         COUNT(*) AS users, round(avg(days), 6) AS avg_days
  FROM ttp GROUP BY 1, 2
)"""


def sql_time_to_first_purchase(p: Params) -> str:
    return with_binding(_ttf_cte(p.replace(test_start=None))) + "\nSELECT * FROM buckets ORDER BY bucket_order"


def sql_time_to_first_stats(p: Params) -> str:
    return with_binding(_ttf_cte(p.replace(test_start=None))) + f"""
SELECT CAST(COALESCE(SUM(users), 0) AS BIGINT) AS total_users,
  round(COALESCE((SELECT AVG(days) FROM ttp), 0.0), 6) AS avg_days,
  {pct('COALESCE(SUM(CASE WHEN bucket_order = 1 THEN users END), 0)', 'SUM(users)')} AS day_0_pct,
  {pct('COALESCE(SUM(CASE WHEN bucket_order <= 4 THEN users END), 0)', 'SUM(users)')} AS week_1_pct
FROM buckets"""


def _exp_funnel_cte(p: Params) -> str:
    return seg_users_cte(p) + f""",
ef_ev AS (
  SELECT ce.*, CASE s.segment WHEN 'test' THEN 'Test' WHEN 'control' THEN 'Control' END AS segment
  FROM client_events ce JOIN seg_users s ON ce.distinct_id = s.distinct_id
  WHERE ce.date BETWEEN {D(p.effective_start)} AND {D(p.end)}
    AND ce.event_name IN ('purchase_click', 'purchase_successful')
),
ef AS (
  SELECT segment,
    {cdf("event_name = 'purchase_click'")} AS purchase_clicks,
    {cdf(SUCC)} AS total_purchases,
    {cdf(SUCC + " AND payment_platform = 'direct'")} AS direct_purchases,
    {cdf(f"{SUCC} AND (({APPLE_OK}) OR ({GOOGLE_OK}))")} AS store_purchases,
    {money(SUCC)} AS total_revenue
  FROM ef_ev GROUP BY segment
)"""


def sql_experiment_funnel(p: Params) -> str:
    return with_binding(_exp_funnel_cte(p)) + "\nSELECT * FROM ef ORDER BY segment DESC"


def sql_experiment_funnel_rates(p: Params) -> str:
    return with_binding(_exp_funnel_cte(p)) + f"""
SELECT segment, purchase_clicks, total_purchases, {pct('total_purchases', 'purchase_clicks')} AS conversion_pct
FROM ef"""


# --- channel switching (A46-A50) -----------------------------------------------

def _switch_ctes(p: Params) -> str:
    s = p.switch_since or p.effective_start
    return _cohort_users(p) + f""",
allp AS (
  SELECT distinct_id, date, payment_platform, price_usd FROM client_events
  WHERE date BETWEEN {D(s)} AND {D(p.end)} AND {SUCC}
    AND payment_platform IN ('direct', 'apple', 'googleplay') AND {attr_filters(p, countries=False)}
    AND distinct_id IN (SELECT distinct_id FROM cohort_users)
),
hist AS (
  SELECT distinct_id,
    MIN(CASE WHEN payment_platform = 'direct' THEN date END) AS first_direct_date,
    MIN(CASE WHEN payment_platform IN ('apple', 'googleplay') THEN date END) AS first_store_date,
    COUNT(CASE WHEN payment_platform = 'direct' THEN 1 END) AS direct_purchase_count,
    COUNT(CASE WHEN payment_platform IN ('apple', 'googleplay') THEN 1 END) AS store_purchase_count,
    {money("payment_platform = 'direct'")} AS direct_revenue,
    {money("payment_platform IN ('apple', 'googleplay')")} AS store_revenue
  FROM allp GROUP BY distinct_id
),
dts AS (
  SELECT distinct_id, first_direct_date, first_store_date FROM hist
  WHERE first_direct_date IS NOT NULL AND first_store_date IS NOT NULL AND first_store_date >= first_direct_date
),
after AS (
  SELECT s.distinct_id, s.first_direct_date, s.first_store_date,
    COUNT(CASE WHEN a.payment_platform = 'direct' AND a.date <= s.first_store_date THEN 1 END) AS direct_before_store,
    COUNT(CASE WHEN a.payment_platform = 'direct' AND a.date > s.first_store_date THEN 1 END) AS direct_after_store,
    COUNT(CASE WHEN a.payment_platform IN ('apple', 'googleplay') AND a.date > s.first_store_date THEN 1 END)
      AS store_after_first_store,
    COUNT(CASE WHEN a.payment_platform IN ('apple', 'googleplay') THEN 1 END) AS total_store,
    {money("a.payment_platform = 'direct'", "a.price_usd")} AS direct_revenue,
    {money("a.payment_platform IN ('apple', 'googleplay')", "a.price_usd")} AS store_revenue
  FROM dts s LEFT JOIN allp a ON s.distinct_id = a.distinct_id
  GROUP BY s.distinct_id, s.first_direct_date, s.first_store_date
)"""


def sql_switchers(p: Params) -> str:
    return with_binding(_switch_ctes(p)) + f"""
SELECT distinct_id, first_direct_date, first_store_date, direct_purchase_count, store_purchase_count,
  direct_revenue, store_revenue, CAST(date_diff('day', first_direct_date, first_store_date) AS BIGINT) AS days_between
FROM hist
WHERE first_direct_date IS NOT NULL AND first_store_date IS NOT NULL AND first_store_date >= first_direct_date
ORDER BY first_direct_date DESC, distinct_id{_limit(p.switcher_limit)}"""


def sql_switch_categories(p: Params) -> str:
    return with_binding(_switch_ctes(p), """
cats AS (
  SELECT CASE
    WHEN first_direct_date IS NOT NULL AND first_store_date IS NULL THEN 'direct_only'
    WHEN first_direct_date IS NULL AND first_store_date IS NOT NULL THEN 'store_only'
    WHEN first_store_date >= first_direct_date THEN 'direct_then_store'
    WHEN first_store_date < first_direct_date THEN 'store_then_direct' END AS category
  FROM hist
),
names(category) AS (VALUES ('direct_only'), ('store_only'), ('direct_then_store'), ('store_then_direct'))""") + """
SELECT n.category, COUNT(c.category) AS user_count
FROM names n LEFT JOIN cats c ON c.category = n.category
GROUP BY n.category"""


def _switch_return_cte(p: Params) -> str:
    return _switch_ctes(p) + """,
ret AS (
  SELECT CASE WHEN direct_after_store > 0 THEN 'Returned to direct' ELSE 'Never returned to direct' END AS behavior,
    COUNT(DISTINCT distinct_id) AS users,
    CAST(SUM(direct_after_store) AS BIGINT) AS direct_purchases_after_store,
    CAST(SUM(store_after_first_store) AS BIGINT) AS store_purchases_after_first_store
  FROM after GROUP BY 1
)"""


def sql_switch_return(p: Params) -> str:
    return with_binding(_switch_return_cte(p)) + "\nSELECT * FROM ret ORDER BY behavior"


def sql_switch_return_share(p: Params) -> str:
    return with_binding(_switch_return_cte(p)) + f"""
SELECT behavior, users, {pct('users', '(SELECT SUM(users) FROM ret)')} AS pct FROM ret"""


def sql_switcher_details(p: Params) -> str:
    return with_binding(_switch_ctes(p)) + f"""
SELECT distinct_id, first_direct_date, first_store_date, direct_before_store, direct_after_store, total_store,
  round(direct_revenue, 2) AS direct_revenue, round(store_revenue, 2) AS store_revenue,
  CASE WHEN direct_after_store > 0 THEN 'Yes' ELSE 'No' END AS returned_to_direct
FROM after ORDER BY direct_after_store DESC, first_direct_date, distinct_id{_limit(p.switcher_limit)}"""


# --- promo audit (A51-A54) -------------------------------------------------------

def _limit(rows: int | None) -> str:
    return "" if rows is None else f" LIMIT {rows}"


def _promo_ctes(p: Params) -> str:
    since = p.test_start or p.days_before(p.promo_days_back)
    path = p.extra.get("promo_config_path", "$.config_id")
    return seg_ctes(p) + f""",
labels AS (SELECT distinct_id, CASE segment WHEN 'test' THEN 'Test' ELSE 'Control' END AS segment FROM user_segments),
promo AS (
  SELECT * FROM client_events
  WHERE event_name = 'promo_impression' AND date >= {D(since)} AND promo_snapshot IS NOT NULL
    AND (CASE WHEN json_valid(promo_snapshot)
              THEN TRY_CAST(json_extract_string(promo_snapshot, '{path}') AS BIGINT) END) = {int(p.promo_config_id)}
),
per_user AS (
  SELECT distinct_id, MIN(date) AS first_impression_date, MAX(date) AS last_impression_date,
         COUNT(*) AS impression_count
  FROM promo GROUP BY distinct_id
),
promo_seg AS (
  SELECT COALESCE(l.segment, 'Not in Test/Control') AS segment, COUNT(DISTINCT u.distinct_id) AS users,
         CAST(SUM(u.impression_count) AS BIGINT) AS total_impressions
  FROM per_user u LEFT JOIN labels l ON u.distinct_id = l.distinct_id GROUP BY 1
)"""


def sql_promo_segments(p: Params) -> str:
    return with_binding(_promo_ctes(p)) + "\nSELECT * FROM promo_seg ORDER BY segment"


def sql_promo_user_details(p: Params) -> str:
    return with_binding(_promo_ctes(p)) + f"""
SELECT u.distinct_id, COALESCE(l.segment, 'Not in Test/Control') AS segment,
  u.first_impression_date, u.last_impression_date, u.impression_count
FROM per_user u LEFT JOIN labels l ON u.distinct_id = l.distinct_id
ORDER BY u.first_impression_date DESC, u.distinct_id{_limit(p.detail_limit)}"""


def sql_promo_outside_users(p: Params) -> str:
    return with_binding(_promo_ctes(p)) + f"""
SELECT pr.distinct_id, 'Not in Test/Control' AS segment, pr.country, pr.os,
  MIN(pr.date) AS first_impression_date, MAX(pr.date) AS last_impression_date, COUNT(*) AS impression_count
FROM promo pr LEFT JOIN labels l ON pr.distinct_id = l.distinct_id
WHERE l.segment IS NULL
GROUP BY pr.distinct_id, pr.country, pr.os
ORDER BY first_impression_date DESC, pr.distinct_id, pr.country, pr.os{_limit(p.detail_limit)}"""


def sql_promo_verdict(p: Params) -> str:
    return with_binding(_promo_ctes(p), """
v AS (
  SELECT CAST(COALESCE(SUM(CASE WHEN segment = 'Test' THEN users END), 0) AS BIGINT) AS test_users,
         CAST(COALESCE(SUM(CASE WHEN segment = 'Control' THEN users END), 0) AS BIGINT) AS control_users,
         CAST(COALESCE(SUM(CASE WHEN segment = 'Not in Test/Control' THEN users END), 0) AS BIGINT) AS other_users
  FROM promo_seg
)""") + """
SELECT test_users, control_users, other_users,
  CASE WHEN control_users = 0 AND test_users > 0 THEN 'only_test'
       WHEN test_users = 0 AND control_users > 0 THEN 'only_control'
       WHEN test_users > 0 AND control_users > 0 THEN 'both' ELSE 'none' END AS verdict
FROM v"""


# --- experiment read-outs (A22-A29) ------------------------------------------------

EVENT_DAY = "(DATE '1970-01-01' + CAST(res_timestamp // 86400000 AS INTEGER))"


def _first_purchase_cte(name: str = "ufp", users: str | None = None) -> str:
    restrict = f" AND distinct_id IN (SELECT distinct_id FROM {users})" if users else ""
    return f"""
{name} AS (
  SELECT distinct_id, MIN({EVENT_DAY}) AS first_purchase_date FROM client_events
  WHERE {SUCC} AND date >= DATE '2020-01-01' AND {valid()}{restrict}
  GROUP BY distinct_id
)"""


def _daily_kpi_select(src: str, keep: float = 0.70, exact: bool = False) -> str:
    rnd = (lambda e: e) if exact else (lambda e: f"round({e}, 6)")
    v = f"ce.{SUCC.replace('event_name', 'event_name')} AND {valid('ce')}"
    v = f"ce.event_name = 'purchase_successful' AND {valid('ce')}"
    amt = "CAST(COALESCE(ce.price_usd, 0) AS DECIMAL(18,2))"
    net = (f"CASE WHEN ce.payment_platform = 'direct' THEN {amt} "
           f"ELSE {amt} * CAST('{keep}' AS DECIMAL(3,2)) END")
    return f"""
dm AS (
  SELECT {EVENT_DAY.replace('res_timestamp', 'ce.res_timestamp')} AS event_date, ce.segment,
    COUNT(DISTINCT ce.distinct_id) AS active_users,
    COUNT(DISTINCT CASE WHEN {v} THEN ce.funnel_id END) AS total_purchases,
    {rnd(f"CAST(COALESCE(SUM(CASE WHEN {v} THEN {amt} END), 0) AS DOUBLE)")} AS gross_revenue,
    {rnd(f"CAST(COALESCE(SUM(CASE WHEN {v} THEN {net} END), 0) AS DOUBLE)")} AS net_revenue,
    COUNT(DISTINCT CASE WHEN {v} THEN ce.distinct_id END) AS paying_users,
    COUNT(DISTINCT CASE WHEN ce.event_name = 'purchase_successful' AND ce.interrupted = 1 THEN ce.funnel_id END)
      AS interrupted_purchases,
    COUNT(DISTINCT CASE WHEN ce.event_name = 'purchase_click' THEN ce.funnel_id END) AS purchase_clicks,
    COUNT(DISTINCT CASE WHEN ce.event_name = 'pre_purchase_click' AND ce.cta_name = 'continue' THEN ce.funnel_id END)
      AS pp_continue_clicks,
    COUNT(DISTINCT CASE WHEN {v}
      AND ufp.first_purchase_date = {EVENT_DAY.replace('res_timestamp', 'ce.res_timestamp')} THEN ce.distinct_id END)
      AS ftd_users
  FROM {src} ce LEFT JOIN ufp ON ce.distinct_id = ufp.distinct_id
  GROUP BY 1, 2
)"""


def _timeline_select(test_start, period: str, exact: bool = False) -> str:
    r = not exact
    return f"""
SELECT event_date, segment, {D(test_start)} AS test_start_date, {period} AS period,
  active_users, total_purchases, gross_revenue, net_revenue, paying_users, interrupted_purchases,
  purchase_clicks, pp_continue_clicks, ftd_users,
  {pct('paying_users', 'active_users', r)} AS ppu_percent,
  {pct('ftd_users', 'active_users', r)} AS ftd_percent,
  {ratio('gross_revenue', 'active_users', r)} AS arpdau,
  {ratio('net_revenue', 'active_users', r)} AS arpdau_net,
  {ratio('gross_revenue', 'paying_users', r)} AS arppu,
  {ratio('net_revenue', 'paying_users', r)} AS arppu_net,
  {ratio('gross_revenue', 'total_purchases', r)} AS atv,
  {ratio('net_revenue', 'total_purchases', r)} AS atv_net,
  {pct('pp_continue_clicks', 'purchase_clicks', r)} AS purchase_to_continue_rate,
  {pct('total_purchases', 'pp_continue_clicks', r)} AS continue_to_purchase_rate,
  {pct('interrupted_purchases', 'total_purchases', r)} AS interrupted_rate
FROM dm"""


def _timeline_cte(p: Params, name: str = "timeline", exact: bool = False) -> str:
    rs, ts, re_ = p.experiment_window
    return seg_users_cte(p) + f""",
arms AS (SELECT distinct_id, CASE segment WHEN 'test' THEN 'Test' ELSE 'Control' END AS segment FROM seg_users),
tl_rows AS (
  SELECT ce.*, a.segment FROM client_events ce JOIN arms a ON ce.distinct_id = a.distinct_id
  WHERE ce.date BETWEEN {D(rs)} AND {D(re_)} AND {attr_filters(p, 'ce', countries=False, floor=True)}
),""" + _first_purchase_cte("ufp", "arms") + "," + _daily_kpi_select("tl_rows", exact=exact) + f""",
{name} AS ({_timeline_select(ts, f"CASE WHEN event_date >= {D(ts)} THEN 'After' ELSE 'Before' END", exact)})"""


def sql_first_purchase_date(p: Params) -> str:
    return with_binding(_first_purchase_cte("ufp")) + "\nSELECT * FROM ufp"


def sql_experiment_timeline(p: Params) -> str:
    return with_binding(_timeline_cte(p)) + "\nSELECT * FROM timeline ORDER BY event_date, segment"


def _did_sql(kpis: list[str], src: str = "timeline", with_flags: bool = False) -> str:
    from funnelkit.operators.experiment import KPI_LABELS
    unions = "\n  UNION ALL ".join(
        f"SELECT '{k}' AS kpi, {i + 1} AS kpi_order, '{KPI_LABELS[k]}' AS label, segment, period, "
        f"CAST({k} AS DOUBLE) AS value FROM {src}" for i, k in enumerate(kpis))

    def cell(seg, per):
        return f"COALESCE(AVG(CASE WHEN segment = '{seg}' AND period = '{per}' THEN value END), 0.0)"

    def chg(d, b):
        return f"round(round(CASE WHEN {b} <> 0 THEN ({d}) / {b} * 100.0 ELSE 0.0 END, 9), 6)"
    flags = (",\n  bool_or(segment = 'Test') AS has_test, bool_or(segment = 'Control') AS has_control"
             if with_flags else "")
    return f"""
long AS (
  {unions}
),
cells AS (
  SELECT kpi, kpi_order, label, {cell('Test', 'Before')} AS tb, {cell('Test', 'After')} AS ta,
         {cell('Control', 'Before')} AS cb, {cell('Control', 'After')} AS ca{flags}
  FROM long GROUP BY kpi, kpi_order, label
)""", f"""
SELECT CAST(kpi_order AS INTEGER) AS kpi_order, kpi, label, round(round(tb, 9), 6) AS test_before, round(round(ta, 9), 6) AS test_after,
  {chg('ta - tb', 'tb')} AS test_change_pct, round(round(cb, 9), 6) AS control_before, round(round(ca, 9), 6) AS control_after,
  {chg('ca - cb', 'cb')} AS control_change_pct, round(round((ta - tb) - (ca - cb), 9), 6) AS diff_in_diff,
  {chg('(ta - tb) - (ca - cb)', 'cb')} AS diff_in_diff_pct{', has_test, has_control' if with_flags else ''}
FROM cells ORDER BY kpi_order"""


def sql_did_summary(p: Params) -> str:
    from funnelkit.operators.experiment import DID_KPIS
    cte, sel = _did_sql(DID_KPIS)
    return with_binding(_timeline_cte(p, exact=True), cte) + sel


def sql_did_summary_net(p: Params) -> str:
    from funnelkit.operators.experiment import DID_KPIS_NET
    cte, sel = _did_sql(DID_KPIS_NET)
    return with_binding(_timeline_cte(p, exact=True), cte) + sel


def sql_before_after(p: Params) -> str:
    from funnelkit.operators import experiment as X
    kpis = X._union(X.TIMELINE_MENU_1, X.TIMELINE_MENU_2, X.TIMELINE_MENU_1_NET, X.TIMELINE_MENU_2_NET)
    cte, sel = _did_sql(kpis, with_flags=True)
    return with_binding(_timeline_cte(p, exact=True), cte) + sel


def _purchaser_cte(p: Params, exact: bool = False) -> str:
    ts = p.test_start or p.start
    return f"""
tagged AS (
  SELECT DISTINCT distinct_id FROM client_events
  WHERE event_name = 'config_loaded' AND date >= {D(p.days_before(60))} AND segments LIKE {TEST_LIKE}
),
pt_users AS (
  SELECT distinct_id FROM dim_player
  WHERE first_country IN ({lst(p.home_markets)}) AND distinct_id IN (SELECT distinct_id FROM tagged)
),
direct_buyers AS (
  SELECT DISTINCT distinct_id FROM client_events
  WHERE {SUCC} AND payment_platform = 'direct' AND date >= {D(ts)}
    AND distinct_id IN (SELECT distinct_id FROM pt_users)
),
store_buyers AS (
  SELECT DISTINCT distinct_id FROM client_events
  WHERE {SUCC} AND (({APPLE_OK}) OR ({GOOGLE_OK})) AND date >= {D(ts)}
    AND distinct_id IN (SELECT distinct_id FROM pt_users)
),
groups AS (
  SELECT distinct_id,
    CASE WHEN distinct_id IN (SELECT distinct_id FROM direct_buyers) THEN 'Direct Purchasers'
         WHEN distinct_id IN (SELECT distinct_id FROM store_buyers) THEN 'Store-only Purchasers' END AS segment
  FROM pt_users
  WHERE distinct_id IN (SELECT distinct_id FROM direct_buyers) OR distinct_id IN (SELECT distinct_id FROM store_buyers)
),
pt_rows AS (
  SELECT ce.*, g.segment FROM client_events ce JOIN groups g ON ce.distinct_id = g.distinct_id
  WHERE ce.date BETWEEN {D(ts)} AND {D(p.as_of)} AND {attr_filters(p, 'ce', countries=False, floor=True)}
),""" + _first_purchase_cte("ufp", "groups") + "," + _daily_kpi_select("pt_rows", exact=exact) + f""",
ptl AS ({_timeline_select(ts, "'After'", exact)})"""


def sql_purchaser_timeline(p: Params) -> str:
    return with_binding(_purchaser_cte(p)) + "\nSELECT * FROM ptl ORDER BY event_date, segment"


def sql_purchaser_comparison(p: Params) -> str:
    from funnelkit.operators import experiment as X
    kpis = X._union(X.COMPARISON_KPIS, X.COMPARISON_MENU_1, X.COMPARISON_MENU_2)
    unions = "\n  UNION ALL ".join(
        f"SELECT '{k}' AS kpi, {i + 1} AS kpi_order, '{X.KPI_LABELS[k]}' AS label, segment, "
        f"CAST({k} AS DOUBLE) AS value FROM ptl" for i, k in enumerate(kpis))
    return with_binding(_purchaser_cte(p, exact=True), f"""
long AS (
  {unions}
),
cells AS (
  SELECT kpi, kpi_order, label,
    COALESCE(AVG(CASE WHEN segment = 'Direct Purchasers' THEN value END), 0.0) AS a,
    COALESCE(AVG(CASE WHEN segment = 'Store-only Purchasers' THEN value END), 0.0) AS b,
    bool_or(segment = 'Direct Purchasers') AS has_direct, bool_or(segment = 'Store-only Purchasers') AS has_store_only
  FROM long GROUP BY kpi, kpi_order, label
)""") + """
SELECT CAST(kpi_order AS INTEGER) AS kpi_order, kpi, label, round(round(a, 9), 6) AS direct_purchasers,
  round(round(b, 9), 6) AS store_only_purchasers, round(round(a - b, 9), 6) AS difference,
  round(round(CASE WHEN b <> 0 THEN (a - b) / b * 100.0 ELSE 0.0 END, 9), 6) AS difference_pct, has_direct, has_store_only
FROM cells ORDER BY kpi_order"""


# --- server-side funnels (A10-A16, A42, A43) ---------------------------------------

def _exp_users_cte(p: Params) -> str:
    return seg_ctes(p) + """,
exp_users AS (SELECT distinct_id FROM user_segments WHERE segment = 'test')"""


def _panel_ctes(p: Params, server_id: str | None = None, client_funnel: bool = False) -> str:
    """Client panel rows and server rows enriched the original way: a range
    LEFT JOIN on the user and a LAST_VALUE(... IGNORE NULLS) window per user."""
    extra = f" AND se.{server_id} IS NOT NULL" if server_id else ""
    cf = " AND funnel_id IS NOT NULL" if client_funnel else ""
    ex = p.apply_exclusions_everywhere
    srv_filter = attr_filters(p, os=False, floor=True, exclusions=ex, version_col="client_version_float",
                              country_col="client_country_code")
    return _exp_users_cte(p) + f""",
panel_client AS (
  SELECT * FROM client_events
  WHERE {client_window(p)} AND {attr_filters(p, floor=True, exclusions=ex)}{cf}
    AND distinct_id IN (SELECT distinct_id FROM exp_users)
),
meta AS (
  SELECT distinct_id, res_timestamp / 1000 AS ts_s, NULLIF(version_float, 0) AS version, country
  FROM client_events WHERE {client_window(p)}
),
enriched AS (
  SELECT se.*,
    LAST_VALUE(cm.version IGNORE NULLS) OVER (PARTITION BY se.distinct_id ORDER BY cm.ts_s
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS client_version_float,
    LAST_VALUE(cm.country IGNORE NULLS) OVER (PARTITION BY se.distinct_id ORDER BY cm.ts_s
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS client_country_code
  FROM server_events se LEFT JOIN meta cm ON se.distinct_id = cm.distinct_id AND cm.ts_s <= se.request_timestamp
  WHERE {server_window(p, alias='se')}{extra} AND se.distinct_id IN (SELECT distinct_id FROM exp_users)
),
panel_server AS (
  SELECT DISTINCT distinct_id, event_name, request_id, transaction_id, funnel_id, cta_name
  FROM enriched WHERE {srv_filter}
)"""


CLIENT_STEPS = {
    "purchase_click": "event_name = 'purchase_click'",
    "changed_selection": "event_name = 'pre_purchase_click' AND cta_name IN ('select_direct', 'select_store')",
    "direct_continue": "event_name = 'pre_purchase_click' AND cta_name = 'continue' AND payment_platform = 'direct'",
    "native_popup": "event_name = 'native_popup' AND payment_platform = 'direct'",
    "client_success": "event_name = 'purchase_successful' AND payment_platform = 'direct'",
    "validation_request": "event_name = 'verify_request' AND payment_platform = 'direct'",
    "validation_approval": "event_name = 'verify_approval' AND payment_platform = 'direct'",
    "rewards": "event_name = 'rewards' AND payment_platform = 'direct'",
}


def _server_steps_sql(success=("wf_success", "wh_success"), add_card=True) -> dict:
    s = {"webform_impression": "event_name = 'wf_impression'"}
    if add_card:
        s["webform_add_card"] = "event_name = 'wf_add_card'"
    s["webform_pay_click"] = "event_name = 'wf_checkout_click' AND cta_name = 'pay'"
    s["webform_success"] = f"event_name IN ({lst(success)})"
    return s


def _strip_sql(order, client_id, server_id, server_steps, prefix, suffix, client_src="panel_client",
               server_src="panel_server") -> str:
    cols = []
    for step in order:
        if step in CLIENT_STEPS:
            cols.append(f"(SELECT {cdf(CLIENT_STEPS[step], client_id)} FROM {client_src}) AS {prefix}{step}{suffix}")
        else:
            cols.append(f"(SELECT {cdf(server_steps[step], server_id)} FROM {server_src}) AS {prefix}{step}{suffix}")
    return "SELECT " + ",\n  ".join(cols)


def _user_funnel_cte(p: Params) -> str:
    from funnelkit.operators.funnels import USER_FUNNEL_ORDER
    return _panel_ctes(p) + f""",
strip AS ({_strip_sql(USER_FUNNEL_ORDER, 'distinct_id', 'distinct_id', _server_steps_sql(), '', '_users')})"""


def _exec_cte(p: Params) -> str:
    from funnelkit.operators.funnels import EXECUTION_ORDER
    return _panel_ctes(p, "transaction_id", True) + f""",
strip AS ({_strip_sql(EXECUTION_ORDER, 'funnel_id', 'transaction_id', _server_steps_sql(('wh_success',)),
                      'funnels_', '')})"""


def _by_request_cte(p: Params) -> str:
    from funnelkit.operators.funnels import BY_REQUEST_ORDER
    return _panel_ctes(p, "request_id", True) + f""",
strip AS ({_strip_sql(BY_REQUEST_ORDER, 'funnel_id', 'request_id', _server_steps_sql(add_card=False),
                      'funnels_', '')})"""


def _pct_sql(order, prefix="", suffix="") -> str:
    base = f"{prefix}{order[0]}{suffix}"
    parts = [f"SELECT {i + 1} AS step_order, '{s}' AS step, CAST({prefix}{s}{suffix} AS BIGINT) AS value, "
             f"{pct(prefix + s + suffix, base)} AS pct_of_base FROM strip WHERE {base} > 0"
             for i, s in enumerate(order)]
    return "\nUNION ALL ".join(parts)


def sql_user_funnel(p: Params) -> str:
    return with_binding(_user_funnel_cte(p)) + "\nSELECT * FROM strip"


def sql_user_funnel_pct(p: Params) -> str:
    from funnelkit.operators.funnels import USER_FUNNEL_ORDER
    return with_binding(_user_funnel_cte(p)) + "\n" + _pct_sql(USER_FUNNEL_ORDER, "", "_users")


def sql_execution_funnel(p: Params) -> str:
    return with_binding(_exec_cte(p)) + "\nSELECT * FROM strip"


def sql_execution_funnel_pct(p: Params) -> str:
    from funnelkit.operators.funnels import EXECUTION_ORDER
    return with_binding(_exec_cte(p)) + "\n" + _pct_sql(EXECUTION_ORDER, "funnels_")


def sql_execution_funnel_by_request(p: Params) -> str:
    return with_binding(_by_request_cte(p)) + "\nSELECT * FROM strip"


def sql_execution_funnel_by_request_pct(p: Params) -> str:
    from funnelkit.operators.funnels import BY_REQUEST_ORDER
    return with_binding(_by_request_cte(p)) + "\n" + _pct_sql(BY_REQUEST_ORDER, "funnels_")


def sql_server_event_enrichment(p: Params) -> str:
    return with_binding(_panel_ctes(p)) + """
SELECT DISTINCT distinct_id, request_id, event_name, transaction_id, funnel_id, cta_name, request_timestamp,
       client_version_float, client_country_code
FROM enriched"""


def sql_server_event_enrichment_asof(p: Params) -> str:
    """Per-event backward as-of: the last non-null value at or before the
    server event's own time."""
    return with_binding(_panel_ctes(p)) + f"""
SELECT se.distinct_id, se.request_id, se.event_name, se.transaction_id, se.funnel_id, se.cta_name,
  se.request_timestamp,
  (SELECT m.version FROM meta m WHERE m.distinct_id = se.distinct_id AND m.ts_s <= se.request_timestamp
     AND m.version IS NOT NULL ORDER BY m.ts_s DESC LIMIT 1) AS client_version_float,
  (SELECT m.country FROM meta m WHERE m.distinct_id = se.distinct_id AND m.ts_s <= se.request_timestamp
     AND m.country IS NOT NULL ORDER BY m.ts_s DESC LIMIT 1) AS client_country_code
FROM server_events se
WHERE {server_window(p, alias='se')} AND se.distinct_id IN (SELECT distinct_id FROM exp_users)"""


def _cohort_exec_cte(p: Params) -> str:
    from funnelkit.operators.funnels import EXECUTION_ORDER
    return _cohort_users(p) + f""",
cx_client AS (
  SELECT * FROM client_events
  WHERE date BETWEEN {D(p.effective_start)} AND {D(p.end)} AND {attr_filters(p, countries=False)}
    AND funnel_id IS NOT NULL AND distinct_id IN (SELECT distinct_id FROM cohort_users)
),
cx_server AS (
  SELECT * FROM server_events
  WHERE date BETWEEN {D(p.effective_start)} AND {D(p.end)} AND transaction_id IS NOT NULL
    AND distinct_id IN (SELECT distinct_id FROM cohort_users)
),
strip AS ({_strip_sql(EXECUTION_ORDER, 'funnel_id', 'transaction_id', _server_steps_sql(('wh_success',)),
                      'funnels_', '', 'cx_client', 'cx_server')})"""


def sql_cohort_execution_funnel(p: Params) -> str:
    return with_binding(_cohort_exec_cte(p)) + "\nSELECT * FROM strip"


def sql_cohort_execution_rates(p: Params) -> str:
    from funnelkit.operators.funnels import EXECUTION_ORDER
    n = len(EXECUTION_ORDER)
    rates = [("continue_rate", "direct_continue", "purchase_click"),
             ("webform_rate", "webform_impression", "direct_continue"),
             ("pay_click_rate", "webform_pay_click", "webform_impression"),
             ("success_rate", "client_success", "webform_pay_click"),
             ("overall_conversion", "client_success", "purchase_click")]
    rate_sql = "\nUNION ALL ".join(
        f"SELECT {n + i + 1} AS step_order, '{name}' AS step, CAST(NULL AS BIGINT) AS value, "
        f"{pct('funnels_' + a, 'funnels_' + b)} AS pct_of_base FROM strip WHERE funnels_purchase_click > 0"
        for i, (name, a, b) in enumerate(rates))
    return with_binding(_cohort_exec_cte(p)) + "\n" + _pct_sql(EXECUTION_ORDER, "funnels_") + "\nUNION ALL " + rate_sql


# --- channel-analytics panel: platform KPIs, adoption, latency (A9, A17-A21) ----

def _panel1_ctes(p: Params) -> str:
    return _exp_users_cte(p) + f""",
p1 AS (
  SELECT *, {EVENT_DAY} AS event_date FROM client_events
  WHERE {client_window(p)} AND {attr_filters(p, exclusions=True, floor=True)}
    AND distinct_id IN (SELECT distinct_id FROM exp_users)
)"""


def sql_platform_kpi(p: Params) -> str:
    rules = {"direct": ("os IN ('Apple', 'Android')", "TRUE", "payment_platform = 'direct'"),
             "apple": ("os = 'Apple'", "os = 'Apple'", APPLE_OK),
             "googleplay": ("os = 'Android'", "os = 'Android'", GOOGLE_OK)}
    blocks = []
    for pl, (act, cos, ok) in rules.items():
        okc = f"{SUCC} AND {ok}"
        blocks.append(f"""
  SELECT '{pl}' AS payment_platform,
    COUNT(DISTINCT CASE WHEN {act} THEN distinct_id END) AS active_users,
    {cdf(okc)} AS total_purchases,
    CAST(COALESCE(SUM(CASE WHEN {okc} THEN CAST(COALESCE(price_usd, 0) AS DECIMAL(18,2)) END), 0) AS DECIMAL(20,2)) AS gross,
    {cdf(okc, 'distinct_id')} AS ppu,
    {cdf(f"event_name = 'purchase_click' AND {cos}")} AS purchase_clicks,
    {cdf(f"{CONT} AND payment_platform = '{pl}' AND {cos}")} AS pp_continue_clicks,
    {cdf(f"{okc} AND funnel_id IN (SELECT funnel_id FROM cont WHERE payment_platform = '{pl}')")}
      AS pp_continue_purchases,
    {cdf(f"{okc} AND interrupted = 1")} AS interrupted_purchases
  FROM p1""")
    return with_binding(_panel1_ctes(p), f"""
cont AS (SELECT DISTINCT funnel_id, payment_platform FROM p1 WHERE {CONT} AND payment_platform IS NOT NULL),
m AS ({' UNION ALL '.join(blocks)}
)""") + f"""
SELECT payment_platform, active_users, total_purchases, round(CAST(gross AS DOUBLE), 6) AS total_gross_revenue,
  round(CASE WHEN payment_platform = 'direct' THEN CAST(gross AS DOUBLE)
             ELSE CAST(gross * CAST('0.70' AS DECIMAL(3,2)) AS DOUBLE) END, 6) AS total_net_revenue,
  ppu, {pct('ppu', 'active_users')} AS ppu_percentage,
  {ratio('CAST(gross AS DOUBLE)', 'active_users')} AS arpdau,
  {ratio('CAST(gross AS DOUBLE)', 'ppu')} AS arppu,
  {ratio('CAST(gross AS DOUBLE)', 'total_purchases')} AS atv,
  {pct('pp_continue_clicks', 'purchase_clicks')} AS pp_continue_from_purchase_clicks_rate,
  {pct('pp_continue_purchases', 'pp_continue_clicks')} AS pp_purchase_continue_to_successful_rate,
  interrupted_purchases, {pct('interrupted_purchases', 'total_purchases')} AS interrupted_purchases_rate
FROM m ORDER BY payment_platform"""


def _ttc_cte() -> str:
    return f"""
tm AS (
  SELECT c1.event_date, avg(CAST(c2.res_timestamp - c1.res_timestamp AS DOUBLE) / 1000.0) AS avg_s,
         quantile_disc(CAST(c2.res_timestamp - c1.res_timestamp AS DOUBLE) / 1000.0, 0.5) AS median_s
  FROM p1 c1 JOIN p1 c2 ON c1.funnel_id = c2.funnel_id AND c1.event_name = 'offer_impression'
    AND c2.event_name = 'pre_purchase_click' AND c2.cta_name = 'continue' AND c2.res_timestamp > c1.res_timestamp
  GROUP BY c1.event_date
)"""


def sql_time_to_continue_daily(p: Params) -> str:
    return with_binding(_panel1_ctes(p), _ttc_cte()) + """
SELECT event_date, round(round(avg_s, 9), 6) AS avg_time_offer_to_continue,
       median_s AS median_time_offer_to_continue
FROM tm ORDER BY event_date"""


def sql_adoption_daily(p: Params) -> str:
    ok = f"{SUCC} AND {valid()}"
    dok = f"{SUCC} AND payment_platform = 'direct'"
    return with_binding(_panel1_ctes(p), f"""
dm AS (
  SELECT event_date,
    COUNT(DISTINCT distinct_id) AS active_users,
    {cdf("event_name = 'purchase_click'")} AS purchase_clicks,
    {cdf(dok)} AS direct_purchases,
    {cdf(ok)} AS total_purchases,
    {money(dok)} AS direct_revenue,
    {money(ok)} AS total_revenue,
    {cdf(dok, 'distinct_id')} AS direct_payers,
    {cdf(ok, 'distinct_id')} AS total_payers,
    {cdf(CONT + " AND payment_platform = 'direct'")} AS direct_continues
  FROM p1 GROUP BY event_date
),""" + _ttc_cte()) + f"""
SELECT dm.event_date,
  {pct('direct_purchases', 'total_purchases')} AS direct_purchases_share,
  {pct('direct_revenue', 'total_revenue')} AS direct_revenue_share,
  {pct('direct_payers', 'total_payers')} AS direct_payers_share,
  {pct('direct_continues', 'purchase_clicks')} AS pp_continue_from_purchase_clicks_rate,
  {pct('direct_purchases', 'direct_continues')} AS pp_purchase_continue_to_successful_rate,
  round(round(COALESCE(tm.avg_s, 0.0), 9), 6) AS avg_time_offer_to_continue,
  COALESCE(tm.median_s, 0.0) AS median_time_offer_to_continue
FROM dm LEFT JOIN tm ON dm.event_date = tm.event_date ORDER BY dm.event_date"""


def _card_edit_cte(p: Params) -> str:
    return f"""
cee AS (
  SELECT DISTINCT transaction_id, request_timestamp FROM server_events
  WHERE event_name = 'wf_add_card' AND date BETWEEN {D(p.start)} AND {D(p.end)} AND transaction_id IS NOT NULL
),
card_edit AS (
  SELECT DISTINCT cee.transaction_id,
    LAST_VALUE(se.funnel_id IGNORE NULLS) OVER (PARTITION BY cee.transaction_id
      ORDER BY se.request_timestamp, se.funnel_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS funnel_id
  FROM cee LEFT JOIN server_events se ON cee.transaction_id = se.transaction_id AND se.funnel_id IS NOT NULL
  WHERE se.date BETWEEN {D(p.start)} AND {D(p.end)}
)"""


def sql_card_edit_funnels(p: Params) -> str:
    return with_binding(_card_edit_cte(p)) + "\nSELECT transaction_id, funnel_id FROM card_edit"


def _latency_sql(p: Params, exclude_first: bool) -> str:
    first = ""
    fc = fs = ""
    if exclude_first:
        first = f""",
first_f AS (
  SELECT DISTINCT distinct_id, FIRST_VALUE(funnel_id) OVER (PARTITION BY distinct_id
    ORDER BY res_timestamp, funnel_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS funnel_id
  FROM client_events
  WHERE date BETWEEN {D(p.start)} AND {D(p.end)} AND payment_platform = 'direct' AND funnel_id IS NOT NULL
    AND {CONT}
)"""
        fc = " AND funnel_id NOT IN (SELECT funnel_id FROM first_f WHERE funnel_id IS NOT NULL)"
        fs = fc
    srv_filter = attr_filters(p, os=False, floor=True, version_col="client_version_float",
                              country_col="client_country_code")
    if p.fix_units:
        wf = lambda a, b: f"CAST({a} - {b} AS DOUBLE)"
        wfc = "CAST(fe.success_ts AS DOUBLE) / 1000.0 - CAST(swe.wf_success_ts AS DOUBLE)"
    else:
        wf = lambda a, b: f"CAST({a} - {b} AS DOUBLE) / 1000.0"
        wfc = "CAST(fe.success_ts - swe.wf_success_ts AS DOUBLE) / 1000.0"
    ctes = _panel1_ctes(p) + "," + _card_edit_cte(p) + first + f""",
lc AS (
  SELECT * FROM p1 WHERE funnel_id IS NOT NULL
    AND funnel_id NOT IN (SELECT funnel_id FROM card_edit WHERE funnel_id IS NOT NULL){fc}
),
meta AS (
  SELECT distinct_id, res_timestamp / 1000 AS ts_s, NULLIF(version_float, 0) AS version, country
  FROM client_events WHERE {client_window(p)}
),
enriched AS (
  SELECT se.*,
    LAST_VALUE(cm.version IGNORE NULLS) OVER (PARTITION BY se.distinct_id ORDER BY cm.ts_s
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS client_version_float,
    LAST_VALUE(cm.country IGNORE NULLS) OVER (PARTITION BY se.distinct_id ORDER BY cm.ts_s
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS client_country_code
  FROM server_events se LEFT JOIN meta cm ON se.distinct_id = cm.distinct_id AND cm.ts_s <= se.request_timestamp
  WHERE {server_window(p, alias='se')} AND se.funnel_id IS NOT NULL
    AND se.distinct_id IN (SELECT distinct_id FROM exp_users)
),
ls AS (
  SELECT DISTINCT distinct_id, event_name, funnel_id, cta_name, request_timestamp FROM enriched
  WHERE {srv_filter}
    AND funnel_id NOT IN (SELECT funnel_id FROM card_edit WHERE funnel_id IS NOT NULL){fs}
),
fe AS (
  SELECT funnel_id, payment_platform,
    MAX(CASE WHEN {CONT} THEN res_timestamp END) AS continue_ts,
    MAX(CASE WHEN event_name = 'native_popup' THEN res_timestamp END) AS popup_ts,
    MAX(CASE WHEN {SUCC} AND {valid()} THEN res_timestamp END) AS success_ts,
    MAX(CASE WHEN event_name = 'rewards' THEN res_timestamp END) AS rewards_ts
  FROM lc GROUP BY funnel_id, payment_platform
),
swe AS (
  SELECT funnel_id,
    MAX(CASE WHEN event_name = 'wf_impression' THEN request_timestamp END) AS wf_impression_ts,
    MAX(CASE WHEN event_name = 'wf_checkout_click' AND cta_name = 'pay' THEN request_timestamp END) AS wf_click_ts,
    MAX(CASE WHEN event_name IN ('wf_success', 'wh_success') THEN request_timestamp END) AS wf_success_ts
  FROM ls GROUP BY funnel_id
),
td AS (
  SELECT fe.payment_platform,
    CAST(fe.rewards_ts - fe.continue_ts AS DOUBLE) / 1000.0 AS continue_to_rewards,
    CAST(fe.popup_ts - fe.continue_ts AS DOUBLE) / 1000.0 AS continue_to_popup,
    CAST(fe.success_ts - fe.popup_ts AS DOUBLE) / 1000.0 AS popup_to_success,
    CAST(fe.rewards_ts - fe.success_ts AS DOUBLE) / 1000.0 AS success_to_rewards,
    {wf('swe.wf_click_ts', 'swe.wf_impression_ts')} AS wf_impression_to_click,
    {wf('swe.wf_success_ts', 'swe.wf_click_ts')} AS wf_click_to_success,
    {wfc} AS wf_success_to_client_success
  FROM fe LEFT JOIN swe ON fe.funnel_id = swe.funnel_id
  WHERE fe.payment_platform IN ('direct', 'apple', 'googleplay') AND fe.continue_ts IS NOT NULL
)"""
    cd = ["continue_to_rewards", "continue_to_popup", "popup_to_success", "success_to_rewards"]
    wd = ["wf_impression_to_click", "wf_click_to_success", "wf_success_to_client_success"]
    cols = [f"quantile_disc({c}, 0.5) AS median_{c}" for c in cd]
    cols += [f"round(round(avg({c}), 9), 6) AS avg_{c}" for c in cd]
    cols += [f"CASE WHEN payment_platform = 'direct' THEN quantile_disc({c}, 0.5) END AS median_{c}" for c in wd]
    cols += [f"CASE WHEN payment_platform = 'direct' THEN round(round(avg({c}), 9), 6) END AS avg_{c}" for c in wd]
    return with_binding(ctes) + f"""
SELECT payment_platform,
  {', '.join(cols)}
FROM td WHERE continue_to_rewards > 0 GROUP BY payment_platform ORDER BY payment_platform"""


def sql_funnel_latency(p: Params) -> str:
    return _latency_sql(p, False)


def sql_funnel_latency_excl_first(p: Params) -> str:
    return _latency_sql(p, True)


def sql_experiment_timeline_test_only(p: Params) -> str:
    return with_binding(_timeline_cte(p)) + "\nSELECT * FROM timeline WHERE segment = 'Test' ORDER BY event_date"


def sql_user_funnel_filtered(p: Params) -> str:
    return sql_user_funnel(p.replace(**FILTERED))


def sql_execution_funnel_filtered(p: Params) -> str:
    return sql_execution_funnel(p.replace(**FILTERED))


def sql_platform_kpi_filtered(p: Params) -> str:
    return sql_platform_kpi(p.replace(**FILTERED))


def sql_execution_funnel_one_version(p: Params) -> str:
    return sql_execution_funnel(p.replace(**ONE_VERSION))


def sql_user_funnel_low_payers(p: Params) -> str:
    return sql_user_funnel(p.replace(**LOW_PAYERS))


def sql_funnel_latency_fixed_units(p: Params) -> str:
    return sql_funnel_latency(p.replace(fix_units=True))


def sql_execution_funnel_asof(p: Params) -> str:
    """The execution funnel with each server row's own last metadata."""
    from funnelkit.operators.funnels import EXECUTION_ORDER
    last = lambda v: (f"(SELECT m.{v} FROM meta m WHERE m.distinct_id = se.distinct_id AND m.ts_s <= se.request_timestamp "  # noqa: E731
                      f"AND m.{v} IS NOT NULL ORDER BY m.ts_s DESC LIMIT 1)")
    srv_filter = attr_filters(p, os=False, floor=True, version_col="client_version_float", country_col="client_country_code")
    return with_binding(_panel_ctes(p, "transaction_id", True) + f""",
asof_server AS (
  SELECT * FROM (
    SELECT se.*, {last('version')} AS client_version_float, {last('country')} AS client_country_code
    FROM server_events se WHERE {server_window(p, alias='se')} AND se.transaction_id IS NOT NULL
      AND se.distinct_id IN (SELECT distinct_id FROM exp_users))
  WHERE {srv_filter}
),
strip AS ({_strip_sql(EXECUTION_ORDER, 'funnel_id', 'transaction_id', _server_steps_sql(('wh_success',)), 'funnels_', '',
                      server_src='asof_server')})""") + "\nSELECT * FROM strip"


def sql_diff_in_diff(p: Params) -> str:
    from funnelkit.operators.experiment import DID_KPIS
    cte, sel = _did_sql(DID_KPIS, with_flags=True)
    return with_binding(_timeline_cte(p, exact=True), cte) + sel
