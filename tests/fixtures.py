"""Hand-made canonical tables for quirk tests (schemas of FIXTURES.md §1)."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from funnelkit.sources.binding import Tables

DAY0 = date(2024, 1, 1)

CLIENT = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("distinct_id", T.LongType()),
    T.StructField("date", T.DateType()), T.StructField("time", T.LongType()),
    T.StructField("res_timestamp", T.LongType()), T.StructField("event_name", T.StringType()),
    T.StructField("cta_name", T.StringType()), T.StructField("payment_platform", T.StringType()),
    T.StructField("funnel_id", T.LongType()), T.StructField("os", T.StringType()),
    T.StructField("country", T.StringType()), T.StructField("version_float", T.DoubleType()),
    T.StructField("price_usd", T.DoubleType()), T.StructField("interrupted", T.IntegerType()),
    T.StructField("purchase_id", T.StringType()), T.StructField("google_order_number", T.StringType()),
    T.StructField("segments", T.StringType()), T.StructField("promo_snapshot", T.StringType()),
])
SERVER = T.StructType([
    T.StructField("distinct_id", T.LongType()), T.StructField("date", T.DateType()),
    T.StructField("request_timestamp", T.LongType()), T.StructField("request_id", T.LongType()),
    T.StructField("event_name", T.StringType()), T.StructField("cta_name", T.StringType()),
    T.StructField("transaction_id", T.LongType()), T.StructField("funnel_id", T.LongType()),
])
PLAYERS = T.StructType([
    T.StructField("distinct_id", T.LongType()), T.StructField("first_event_time", T.TimestampNTZType()),
    T.StructField("first_country", T.StringType()),
])
COUNTRIES = T.StructType([T.StructField("country_code", T.StringType()),
                          T.StructField("is_low_payers_country", T.BooleanType())])


def ms(day: int, sec: int = 0) -> int:
    d = DAY0 + timedelta(days=day)
    return int(datetime(d.year, d.month, d.day, tzinfo=timezone.utc).timestamp() + sec) * 1000


_ids = iter(range(1, 10**9))


def ev(uid, day, name, sec=0, **kw):
    """One client event of user ``uid`` on day offset ``day``."""
    t = ms(day, sec)
    row = dict(event_id=next(_ids), distinct_id=uid, date=DAY0 + timedelta(days=day), time=t, res_timestamp=t,
               event_name=name, cta_name=None, payment_platform=None, funnel_id=None, os="Apple",
               country="NATION_1", version_float=0.378, price_usd=None, interrupted=0, purchase_id=None,
               google_order_number=None, segments=None, promo_snapshot=None)
    row.update(kw)
    return row


def tag(uid, day, segment, sec=0, **kw):
    tags = {"test": "x,LiveOpsData.exp_test", "control": "LiveOpsData.exp_control",
            "both": "LiveOpsData.exp_control,LiveOpsData.exp_test"}[segment]
    return ev(uid, day, "config_loaded", sec, segments=tags, **kw)


def srv(uid, day, name, sec=0, rid=None, **kw):
    row = dict(distinct_id=uid, date=DAY0 + timedelta(days=day), request_timestamp=ms(day, sec) // 1000,
               request_id=rid if rid is not None else next(_ids), event_name=name, cta_name=None,
               transaction_id=None, funnel_id=None)
    row.update(kw)
    return row


def player(uid, install_day=0, region="AMERICA"):
    d = DAY0 + timedelta(days=install_day)
    return dict(distinct_id=uid, first_event_time=datetime(d.year, d.month, d.day), first_country=region)


def tables(spark: SparkSession, client, server=(), players=None, countries=None) -> Tables:
    uids = sorted({r["distinct_id"] for r in client} | {r["distinct_id"] for r in server})
    players = players if players is not None else [player(u) for u in uids]
    countries = countries if countries is not None else [dict(country_code="NATION_1", is_low_payers_country=False)]
    c = spark.createDataFrame([tuple(r[f.name] for f in CLIENT.fields) for r in client], CLIENT)
    s = spark.createDataFrame([tuple(r[f.name] for f in SERVER.fields) for r in server], SERVER)
    pl = spark.createDataFrame([tuple(r[f.name] for f in PLAYERS.fields) for r in players], PLAYERS)
    co = spark.createDataFrame([tuple(r[f.name] for f in COUNTRIES.fields) for r in countries], COUNTRIES)
    te = spark.createDataFrame([], "distinct_id bigint")
    return Tables(client=c, server=s, players=pl, countries=co, testers=te)
