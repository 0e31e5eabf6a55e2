"""Attach client metadata (app version, country) to payment-server events.

``mode="user"`` reproduces the original analyses: every server event of a user
gets the user's last non-null version / country at or before the user's
*latest* server event in scope (the original windowed a range join per user
with an unbounded frame).  It is computed without the range join's fan-out:
one aggregate for the user's latest server time, one equi join on the user key
with a residual ``<=`` (each client row meets at most one row), and a
``max(struct(ts, value))`` aggregate, all partially aggregated map-side.

``mode="event"`` is the backward as-of join the original comment describes:
each server event gets the last non-null value at or before *its own* time.
Server times are whole seconds, so both logs are first reduced to one row per
user and second (the client's value at the second's start and at its end);
values are then carried along within a user's hour, and from hour to hour.  A
window partition holds at most 3,600 rows, or one row an hour of the date
span, however many events a user has in them.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelkit.functions import predicates as P
from funnelkit.functions import vocab as V
from funnelkit.operators.segments import is_arm, packed_tag, tagged_config
from funnelkit.plans.params import Params
from funnelkit.sources.binding import Tables


# seconds in a window partition of the as-of mode
BUCKET_S = 3600


def client_metadata(t: Tables, p: Params, users: DataFrame | None = None) -> DataFrame:
    """Client rows of the window (of ``users``): user, time in (fractional)
    seconds, version (0 = unknown -> null), country."""
    rows = t.client.where(P.client_window(p))
    if users is not None:
        rows = rows.join(users, "distinct_id", "left_semi")
    return (t.with_country(rows)
            .select("distinct_id", (F.col("res_timestamp") / 1000.0).alias("ts_s"),
                    F.nullif(F.col("version_float"), F.lit(0.0)).alias("version"), "country"))


def _last_non_null(value: str):
    return F.max(F.when(F.col(value).isNotNull(), F.struct(F.col("ts_s"), F.col(value))))[value]


def enrich_user(server: DataFrame, meta: DataFrame) -> DataFrame:
    tmax = server.groupBy("distinct_id").agg(F.max("request_timestamp").alias("__tmax"))
    per_user = (meta.join(tmax, "distinct_id")
                .where(F.col("ts_s") <= F.col("__tmax"))
                .groupBy("distinct_id")
                .agg(_last_non_null("version").alias("client_version_float"),
                     _last_non_null("country").alias("client_country_code")))
    return server.join(per_user, "distinct_id", "left")


def test_arm(t: Tables, p: Params, server: DataFrame, tmax: Column, carried: dict[str, Column] | None = None,
             panel: Column | None = None, panel_flags: dict[str, Column] | None = None) -> DataFrame:
    """Test-arm users with their last client metadata (``mode="user"``), from one read of the client log.

    ``server`` has one row per user; ``tmax`` is the user's latest server time in scope there, and
    ``carried`` are further columns of it to pass on.  Output: ``distinct_id, client_version_float,
    client_country_code`` (only if a country predicate is active), the carried columns and, with
    ``panel`` (a predicate on client rows), 0/1 columns ``panel_flags`` that say whether a panel row of
    the user meets them.

    Tags, panel flags and metadata are aggregates of one shuffle: first by (user, date), which lets AQE
    split a user with a large part of the log in the join before it, then by user.  Where two rows share
    the latest time the larger version counts.
    """
    carried, panel_flags = carried or {}, panel_flags or {}
    start, end = min(p.start, p.days_before(30)), p.end
    in_window = P.client_window(p)
    rows = t.client.where((F.col("date") >= F.lit(start)) & (tagged_config(p) | in_window))
    countries = P.needs_country(p, exclusions=p.apply_exclusions_everywhere)
    if countries:
        rows = t.with_country(rows)
        if p.low_payers_only:
            low = t.countries.where(F.col("is_low_payers_country")).select(F.col("country_code").alias("country"), F.lit(True).alias("__low")).distinct()
            rows = rows.join(low, "country", "left")
    rows = rows.join(server.select("distinct_id", tmax.alias("__tmax"), *[c.alias(n) for n, c in carried.items()]),
                     "distinct_id", "left")
    before = in_window & (F.col("res_timestamp") / 1000.0 <= F.col("__tmax"))
    known = before & (F.col("version_float") != 0.0)
    order = F.expr("CAST(CAST(res_timestamp AS DECIMAL(19,0)) * CAST(1000000000 AS DECIMAL(10,0)) "
                   "+ try_cast(version_float AS DECIMAL(18,9)) AS DECIMAL(38,7))")
    aggs = [F.max(F.when(tagged_config(p), packed_tag())).alias("tag"),
            F.max(F.when(known, order)).alias("__vo"),
            F.max_by(F.when(known, F.col("version_float")), F.when(known, order)).alias("client_version_float")]
    again = [F.max("tag").alias("tag"), F.max_by("client_version_float", "__vo").alias("client_version_float")]
    if countries:
        aggs.append(F.max(F.when(before & F.col("country").isNotNull(), F.struct("res_timestamp", "country"))).alias("__c"))
        again.append(F.max("__c").alias("__c"))
    for n in carried:
        aggs.append(F.max(n).alias(n))
        again.append(F.max(n).alias(n))
    for n, c in panel_flags.items():
        aggs.append(F.max(F.when(in_window & panel & c, F.lit(1)).otherwise(F.lit(0))).alias(n))
        again.append(F.max(n).alias(n))
    per_day = rows.groupBy("distinct_id", "date").agg(*aggs)
    out = per_day.groupBy("distinct_id").agg(*again).where(is_arm(V.TEST)).drop("tag")
    if countries:
        out = out.withColumn("client_country_code", F.col("__c")["country"]).drop("__c")
    if p.low_payers_only:
        out = out.join(low.select(F.col("country").alias("client_country_code"), F.col("__low").alias("client_low")),
                       "client_country_code", "left").withColumn("client_low", F.coalesce("client_low", F.lit(False)))
    return out


def enrich_event(server: DataFrame, meta: DataFrame) -> DataFrame:
    """Each server row with the last non-null value at or before its second; of one time the larger value counts."""
    c = F.col
    second = F.floor(c("ts_s")).cast("bigint")
    at_start = c("ts_s") == second
    latest = lambda v, when: F.max(F.when(when & c(v).isNotNull(), F.struct("ts_s", v)))
    every = F.lit(True)
    client = meta.where(c("version").isNotNull() | c("country").isNotNull()).groupBy("distinct_id", second.alias("sec")).agg(
        latest("version", at_start)["version"].alias("v_at"), latest("version", every)["version"].alias("v_end"),
        latest("country", at_start)["country"].alias("c_at"), latest("country", every)["country"].alias("c_end"),
        F.lit(False).alias("asked"))
    asked = server.groupBy("distinct_id", c("request_timestamp").cast("bigint").alias("sec")).agg(F.lit(True).alias("asked"))
    values = ["v_at", "v_end", "c_at", "c_end"]
    # a row per user and second, however many events share it
    seconds = client.unionByName(asked, allowMissingColumns=True).groupBy("distinct_id", "sec").agg(
        *[F.max(v).alias(v) for v in values], F.max("asked").alias("asked"))
    seconds = seconds.withColumn("hour", F.expr(f"(sec - pmod(sec, {BUCKET_S}L)) div {BUCKET_S}L"))
    earlier = Window.partitionBy("distinct_id", "hour").orderBy("sec").rowsBetween(Window.unboundedPreceding, -1)
    within = seconds.select(
        "distinct_id", "sec", "hour", "asked",
        F.coalesce("v_at", F.last("v_end", ignorenulls=True).over(earlier)).alias("v_hour"),
        F.coalesce("c_at", F.last("c_end", ignorenulls=True).over(earlier)).alias("c_hour")).where("asked")
    end = lambda v: F.max(F.when(c(v).isNotNull(), F.struct("sec", v)))[v]
    hours = seconds.groupBy("distinct_id", "hour").agg(end("v_end").alias("v"), end("c_end").alias("c"))
    before = Window.partitionBy("distinct_id").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    carried = hours.select("distinct_id", "hour", F.last("v", ignorenulls=True).over(before).alias("v_carry"),
                           F.last("c", ignorenulls=True).over(before).alias("c_carry"))
    found = within.join(carried, ["distinct_id", "hour"]).select(
        "distinct_id", c("sec").alias("request_timestamp"), F.coalesce("v_hour", "v_carry").alias("client_version_float"),
        F.coalesce("c_hour", "c_carry").alias("client_country_code"))
    return server.join(found, ["distinct_id", "request_timestamp"], "left").select(
        *server.columns, "client_version_float", "client_country_code")


def enrich(server: DataFrame, meta: DataFrame, mode: str = "user") -> DataFrame:
    if mode == "user":
        return enrich_user(server, meta)
    if mode == "event":
        return enrich_event(server, meta)
    raise ValueError(f"unknown enrichment mode {mode!r}")


def server_filters(df: DataFrame, p: Params, t: Tables, exclusions: bool = False) -> DataFrame:
    """Version list, version floor, country list and low-payer filter applied
    through the attached client metadata (OS is not applied to server rows).
    ``df`` may be server rows or one row per user."""
    cond = P.attribute_filters(p, os=False, floor=True, exclusions=exclusions,
                               version_col="client_version_float", country_col="client_country_code")
    return P.low_payer_filter(df.where(cond), p, t.countries, "client_country_code")
