"""Shared column expressions: purchase validity, safe ratios, money, time ranges
and the dashboard filter predicates.  All are built-in Spark expressions, so
they stay inside whole-stage codegen and push down to the Parquet scan where
they reference scan columns."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelkit.functions import vocab as V
from funnelkit.plans.params import Params


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nonempty(c) -> Column:
    c = col(c)
    return c.isNotNull() & (c != "")


def valid_purchase(platform="payment_platform", pid="purchase_id", gon="google_order_number") -> Column:
    """Direct purchases are always valid; store purchases need their order id."""
    pl = col(platform)
    return ((pl == V.DIRECT)
            | ((pl == V.APPLE) & nonempty(pid))
            | ((pl == V.GOOGLEPLAY) & nonempty(gon)))


def r6(c) -> Column:
    return F.round(col(c), 6)


def r6_stable(c) -> Column:
    """Round a value that comes out of a floating-point *sum* (e.g. a mean of
    daily KPIs): summation order leaves noise in the last bits, so snap to
    9 dp first, then round to 6 dp."""
    return F.round(F.round(col(c), 9), 6)


def _ident(name: str) -> bool:
    return name.replace("_", "").isalnum()


def safe_ratio(n, d, scale: float = 1.0, rounded: bool = True) -> Column:
    """``n * scale / d`` as double when ``d > 0`` else 0 (rounded to 6 dp
    unless the value feeds a further aggregate)."""
    if isinstance(n, str) and isinstance(d, str) and _ident(n) and _ident(d):
        # same expression, parsed in one call (cheaper plan building)
        num = f"CAST({n} AS DOUBLE)" + (f" * {float(scale)!r}D" if scale != 1.0 else "")
        e = f"CASE WHEN {d} > 0 THEN {num} / CAST({d} AS DOUBLE) ELSE 0.0D END"
        return F.expr(f"round({e}, 6)" if rounded else e)
    n, d = col(n), col(d)
    num = n.cast("double") * F.lit(float(scale)) if scale != 1.0 else n.cast("double")
    out = F.when(d > 0, num / d.cast("double")).otherwise(F.lit(0.0))
    return r6(out) if rounded else out


def safe_pct(n, d, rounded: bool = True) -> Column:
    return safe_ratio(n, d, 100.0, rounded)


def money(c) -> Column:
    """Row amount as exact cents; missing amounts count 0."""
    return F.coalesce(col(c), F.lit(0.0)).cast("decimal(18,2)")


def money_sum(cond: Column | None = None, amount="price_usd") -> Column:
    """Exact sum of amounts (decimal cents), returned as double."""
    m = money(amount)
    if cond is not None:
        m = F.when(cond, m).otherwise(F.lit(0).cast("decimal(18,2)"))
    return F.coalesce(F.sum(m), F.lit(0).cast("decimal(18,2)")).cast("double")


def _epoch(d: date) -> int:
    return int(datetime(d.year, d.month, d.day, tzinfo=timezone.utc).timestamp())


def epoch_ms_range(start: date, end: date) -> tuple[int, int]:
    """Half-open ``[start 00:00, end + 1 day 00:00)`` in epoch milliseconds."""
    return _epoch(start) * 1000, _epoch(end + timedelta(days=1)) * 1000


def epoch_s_range(start: date, end: date) -> tuple[int, int]:
    return _epoch(start), _epoch(end + timedelta(days=1))


def date_between(start: date, end: date, c="date") -> Column:
    """Closed range on the partition column; literal bounds prune partitions."""
    return col(c).between(F.lit(start), F.lit(end))


def ms_between(start: date, end: date, c="res_timestamp") -> Column:
    lo, hi = epoch_ms_range(start, end)
    return (col(c) >= F.lit(lo)) & (col(c) < F.lit(hi))


def s_between(start: date, end: date, c="request_timestamp") -> Column:
    lo, hi = epoch_s_range(start, end)
    return (col(c) >= F.lit(lo)) & (col(c) < F.lit(hi))


def client_window(p: Params, start: date | None = None, end: date | None = None) -> Column:
    """Partition-column range plus the epoch-ms range of the client log."""
    s, e = start or p.start, end or p.end
    return date_between(s, e) & ms_between(s, e)


def server_window(p: Params, start: date | None = None, end: date | None = None) -> Column:
    s, e = start or p.start, end or p.end
    return date_between(s, e) & s_between(s, e)


def version_floor(p: Params, c="version_float") -> Column:
    return col(c) >= F.lit(float(p.version_floor))


def attribute_filters(p: Params, *, os=True, versions=True, countries=True, exclusions=False,
                      floor=False, os_col="os", version_col="version_float",
                      country_col="country") -> Column:
    """Row predicates of the filter panel (low-payer countries need a join,
    see ``low_payer_filter``).  Empty lists mean no predicate."""
    cond = F.lit(True)
    if os and p.os:
        cond = cond & col(os_col).isin(list(p.os))
    if versions and p.versions:
        vs = [float(v) for v in p.versions]
        cond = cond & (col(version_col).isin(vs) if len(vs) > 1 else (col(version_col) == F.lit(vs[0])))
    if countries and p.countries:
        cond = cond & col(country_col).isin(list(p.countries))
    if exclusions and p.exclude_testing_countries:
        cond = cond & ~col(country_col).isin(list(p.excluded_countries))
    if floor:
        cond = cond & version_floor(p, version_col)
    return cond


def low_payer_filter(df: DataFrame, p: Params, dim_country: DataFrame, country_col="country") -> DataFrame:
    """``country IN (low-payer countries)`` as a semi join.  The country
    dimension has one row per country (a fixed, small bound), so it is
    broadcast."""
    if not p.low_payers_only:
        return df
    low = dim_country.where(F.col("is_low_payers_country")).select(F.col("country_code").alias("__cc"))
    return df.join(F.broadcast(low), col(country_col) == F.col("__cc"), "left_semi")


# --- event predicates ----------------------------------------------------------

def is_click() -> Column:
    return F.col("event_name") == V.PURCHASE_CLICK


def is_continue() -> Column:
    return (F.col("event_name") == V.PRE_PURCHASE_CLICK) & (F.col("cta_name") == V.CTA_CONTINUE)


def is_success() -> Column:
    return F.col("event_name") == V.PURCHASE_SUCCESSFUL


def on(platform: str) -> Column:
    return F.col("payment_platform") == platform


def on_store() -> Column:
    return F.col("payment_platform").isin(*V.STORES)


def apple_ok() -> Column:
    return on(V.APPLE) & nonempty("purchase_id")


def google_ok() -> Column:
    return on(V.GOOGLEPLAY) & nonempty("google_order_number")


def store_ok() -> Column:
    return apple_ok() | google_ok()


def dec0() -> Column:
    return F.lit(0).cast("decimal(18,2)")


def country_filters(p: Params, *, countries=True, exclusions=False, country_col="country") -> Column:
    cond = F.lit(True)
    if countries and p.countries:
        cond = cond & col(country_col).isin(list(p.countries))
    if exclusions and p.exclude_testing_countries:
        cond = cond & ~col(country_col).isin(list(p.excluded_countries))
    return cond


def needs_country(p: Params, *, countries=True, exclusions=False, low_payers=True) -> bool:
    return bool((countries and p.countries) or (exclusions and p.exclude_testing_countries)
                or (low_payers and p.low_payers_only))


def filtered_client(t, p: Params, base: Column, *, countries=True, exclusions=False, floor=False,
                    low_payers=True) -> DataFrame:
    """Client rows meeting ``base`` and the filter panel.  Non-country
    predicates are applied first (they push down to the scan); the country is
    attached afterwards only if a country predicate is active."""
    df = t.client.where(base & attribute_filters(p, countries=False, floor=floor))
    if needs_country(p, countries=countries, exclusions=exclusions, low_payers=low_payers):
        df = t.with_country(df).where(country_filters(p, countries=countries, exclusions=exclusions))
        if low_payers:
            df = low_payer_filter(df, p, t.countries)
    return df
