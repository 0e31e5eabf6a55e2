"""Canonical analytics tables, bound to the generic test tables.

The analyses read five canonical tables (client events, server events, player
dimension, country dimension, tester list; schemas in FIXTURES.md).  In a
deployment these are real date-partitioned tables and ``Tables`` is built with
``Tables.from_tables``.  For the shared test data they are *derived* from the
driver's ``events`` / ``customer`` / ``nation`` / ``region`` tables by
deterministic column expressions.  The same derivation exists as DuckDB SQL in
``BINDING_SQL`` so that every operator can be oracle-checked on identical rows.

The derivation is one narrow projection over the event scan (no shuffle).  The
country comes from a one-row-per-user map that operators join only when a
country predicate or column is actually needed (``Tables.with_country``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelkit.functions import vocab as V
from funnelkit.sources.readers import read_table


# rows of a day that go into one file of the event logs
ROWS_PER_FILE = 2_000_000


@dataclass(frozen=True)
class Tables:
    client: DataFrame
    server: DataFrame
    players: DataFrame
    countries: DataFrame
    testers: DataFrame
    # user -> country, when the client log does not carry a country column
    user_country: DataFrame | None = None
    # user -> day of the first valid purchase, kept up to date (``operators.first_purchases``)
    first_purchases: DataFrame | None = None

    def with_country(self, df: DataFrame) -> DataFrame:
        """``df`` with a ``country`` column.  Join it (on the user key, after
        the caller's filters) only when the log lacks it."""
        if "country" in df.columns or self.user_country is None:
            return df
        return df.join(self.user_country, "distinct_id", "left")

    @staticmethod
    def from_tables(spark: SparkSession, client="client_events", server="server_events",
                    players="dim_player", countries="dim_country", testers="tester_list") -> "Tables":
        """Bind to catalog tables that already have the canonical schemas."""
        t = spark.table
        return Tables(t(client), t(server), t(players), t(countries), t(testers))

    @staticmethod
    def from_parquet(spark: SparkSession, base: str) -> "Tables":
        """Canonical tables stored under ``base`` (as written by
        ``materialize``): the event logs are partitioned by ``date``, so the
        literal date bounds of every analysis prune whole directories."""
        r = spark.read.parquet
        return Tables(r(f"{base}/client_events"), r(f"{base}/server_events"), r(f"{base}/dim_player"),
                      r(f"{base}/dim_country"), r(f"{base}/tester_list"))

    def _logs(self) -> list[tuple[str, DataFrame]]:
        """The event logs, the country resolved into the client's."""
        return [("client_events", self.with_country(self.client)), ("server_events", self.server)]

    def _dimensions(self) -> list[tuple[str, DataFrame]]:
        return [("dim_player", self.players), ("dim_country", self.countries), ("tester_list", self.testers)]

    def materialize(self, base: str, rows_per_file: int = ROWS_PER_FILE) -> None:
        """Write the canonical tables in the production layout: event logs
        partitioned by ``date`` and clustered by user within a file, a day in as
        many files as its number of rows asks for; dimensions as plain Parquet."""
        for name, df in self._logs():
            days = df.groupBy("date").agg(F.expr(f"CAST(ceil(count(*) / {rows_per_file}) AS BIGINT)").alias("__files"))
            # one row a day: the calendar bounds what goes to every task
            dealt = df.join(F.broadcast(days), "date").withColumn("__file", F.pmod(F.xxhash64("distinct_id"), "__files"))
            total = days.agg(F.sum("__files")).first()[0] or 1
            (dealt.repartition(total, "date", "__file").sortWithinPartitions("date", "__file", "distinct_id").drop("__file", "__files")
             .write.mode("overwrite").partitionBy("date").parquet(f"{base}/{name}"))
        for name, df in self._dimensions():
            df.write.mode("overwrite").parquet(f"{base}/{name}")

    def materialize_bucketed(self, prefix: str, buckets: int, path: str | None = None) -> None:
        """Catalog tables bucketed by user, the logs also partitioned by ``date``: what joins or groups by the
        user reads its buckets as they lie, without an exchange.  Bind them with ``from_tables``."""
        for name, df in [*self._logs(), ("dim_player", self.players)]:
            out = df.repartition(buckets, "distinct_id").write.mode("overwrite").bucketBy(buckets, "distinct_id").sortBy("distinct_id")
            if name != "dim_player":
                out = out.partitionBy("date")
            (out.option("path", f"{path}/{name}") if path else out).saveAsTable(f"{prefix}{name}")
        for name, df in self._dimensions()[1:]:
            out = df.write.mode("overwrite")
            (out.option("path", f"{path}/{name}") if path else out).saveAsTable(f"{prefix}{name}")


# --- fixed values of the test binding (FIXTURES.md §2) -------------------------
EPOCH_DAY0 = "2024-01-01"
VIEW_NAMES = (V.OFFER_IMPRESSION, V.NATIVE_POPUP, V.PROMO_IMPRESSION)          # by k % 3
CLICK_NAMES = (V.PURCHASE_CLICK, V.PRE_PURCHASE_CLICK)                          # by k % 2
PURCHASE_NAMES = (V.PURCHASE_SUCCESSFUL, V.PURCHASE_SUCCESSFUL, V.VERIFY_REQUEST,
                  V.VERIFY_APPROVAL, V.REWARDS)                                  # by k % 5
CTA_NAMES = (V.CTA_CONTINUE, V.CTA_CONTINUE, V.CTA_SELECT_DIRECT, V.CTA_SELECT_STORE)  # by (k div 2) % 4
SERVER_NAMES = (V.WF_IMPRESSION, V.WF_ADD_CARD, V.WF_CHECKOUT_CLICK, V.WF_SUCCESS, V.WH_SUCCESS)  # by k % 5


def _pick(idx: Column, values) -> Column:
    out = None
    for i, v in enumerate(values):
        out = F.when(idx == i, F.lit(v)) if out is None else out.when(idx == i, F.lit(v))
    return out


def _derived(events: DataFrame) -> DataFrame:
    """Helper columns shared by client and server rows."""
    return events.select(
        "event_id", "ts", "user_id", "event_type", "value", "props",
        F.get_json_object("props", "$.k").try_cast("int").alias("k"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 1000").alias("ms"),
        F.to_date("ts").alias("date"),
        (F.date_diff(F.to_date("ts"), F.lit(EPOCH_DAY0).cast("date")) / 6).cast("int").alias("sess"),
    )


def user_country(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """One row per user: country name (nation is a fixed 25-row table)."""
    return (customer.select(F.col("c_custkey").alias("distinct_id"), "c_nationkey")
            .join((nation.select(F.col("n_nationkey").alias("c_nationkey"),
                                            F.col("n_name").alias("country"))),
                  "c_nationkey")
            .select("distinct_id", "country"))


def bind_client(events: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    e = _derived(events).where(F.col("event_type") != "error")
    k, et, uid = F.col("k"), F.col("event_type"), F.col("user_id")
    funnel_rows = et.isin("click", "view", "purchase")
    name = (F.when(et == "view", _pick(k % 3, VIEW_NAMES))
            .when(et == "click", _pick(k % 2, CLICK_NAMES))
            .when(et == "purchase", _pick(k % 5, PURCHASE_NAMES))
            .when(et == "signup", F.lit(V.CONFIG_LOADED)))
    order_id_ok = (k % 13) != 0
    even = (uid % 2) == 0
    client = e.select(
        "event_id",
        uid.alias("distinct_id"),
        "date",
        F.col("ms").alias("time"),
        F.col("ms").alias("res_timestamp"),
        name.alias("event_name"),
        F.when((et == "click") & (k % 2 == 1), _pick(F.expr("(k div 2) % 4"), CTA_NAMES)).alias("cta_name"),
        F.when(funnel_rows, F.when((uid * 5 + F.col("sess")) % 7 < 4, F.lit(V.DIRECT))
               .when(even, F.lit(V.APPLE)).otherwise(F.lit(V.GOOGLEPLAY))).alias("payment_platform"),
        F.when(funnel_rows, uid * 16 + F.col("sess")).alias("funnel_id"),
        F.when(even, F.lit("Apple")).otherwise(F.lit("Android")).alias("os"),
        F.when(F.col("event_id") % 29 == 0, F.lit(0.0))
         .otherwise((F.col("event_id") % 10 + 3773).cast("double") / 1e4).alias("version_float"),
        F.when((et == "purchase") & (k % 17 != 0), F.col("value")).alias("price_usd"),
        F.when(k % 9 == 0, 1).otherwise(0).cast("int").alias("interrupted"),
        F.when(even & order_id_ok,
               F.when(k % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("p"), F.col("event_id").cast("string"))))
         .alias("purchase_id"),
        F.when(~even & order_id_ok,
               F.when(k % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("g"), F.col("event_id").cast("string"))))
         .alias("google_order_number"),
        F.when(et == "signup",
               F.when(uid % 5 == 4, F.lit("other.flag"))
               .when((uid % 5 < 2) != (k < 8), F.lit("a,LiveOpsData.exp_test"))
               .otherwise(F.lit("LiveOpsData.exp_control"))).alias("segments"),
        F.col("props").alias("promo_snapshot"),
    )
    return client


def bind_server(events: DataFrame) -> DataFrame:
    e = _derived(events).where(F.col("event_type") == "error")
    k, uid = F.col("k"), F.col("user_id")
    fid = uid * 16 + F.col("sess")
    return e.select(
        uid.alias("distinct_id"),
        "date",
        F.expr("ms div 1000").alias("request_timestamp"),
        F.col("event_id").alias("request_id"),
        _pick(k % 5, SERVER_NAMES).alias("event_name"),
        F.when(k % 5 == 2, F.when(k % 2 == 0, F.lit(V.CTA_PAY)).otherwise(F.lit("cancel"))).alias("cta_name"),
        F.when(k % 19 != 0, fid * 3 + k % 3).alias("transaction_id"),
        F.when(k % 4 != 0, fid).alias("funnel_id"),
    )


def bind_players(events: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    first = events.groupBy(F.col("user_id").alias("distinct_id")).agg(F.min("ts").alias("first_event_time"))
    geo = (customer.select(F.col("c_custkey").alias("distinct_id"), F.col("c_nationkey").alias("n_nationkey"))
           .join((nation.select("n_nationkey", "n_regionkey")), "n_nationkey")
           .join((region.select(F.col("r_regionkey").alias("n_regionkey"),
                                           F.col("r_name").alias("first_country"))), "n_regionkey")
           .select("distinct_id", "first_country"))
    # one row per player; the first-event time is a unique-keyed left join, so
    # Catalyst drops the whole events aggregate when an analysis only needs
    # the player key and country
    return geo.join(first, "distinct_id", "left").select("distinct_id", "first_event_time", "first_country")


def bind_countries(nation: DataFrame) -> DataFrame:
    return nation.select(F.col("n_name").alias("country_code"),
                         ((F.col("n_nationkey") % 4) == 0).alias("is_low_payers_country"))


def bind_testers(customer: DataFrame) -> DataFrame:
    return customer.where(F.col("c_custkey") % 10 == 0).select(F.col("c_custkey").alias("distinct_id"))


def load_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Canonical tables derived from the Parquet tables in ``sf_dir``: lazy plans
    over the files that are there now."""
    ev = read_table(spark, sf_dir, "events")
    cu = read_table(spark, sf_dir, "customer")
    na = read_table(spark, sf_dir, "nation")
    re = read_table(spark, sf_dir, "region")
    return Tables(
        client=bind_client(ev, cu, na),
        server=bind_server(ev),
        players=bind_players(ev, cu, na, re),
        countries=bind_countries(na),
        testers=bind_testers(cu),
        user_country=user_country(cu, na),
    )


# --- DuckDB twin of the binding, used by the oracle SQL -------------------------
BINDING_SQL = """
ev AS (
  SELECT event_id, ts, user_id, event_type, value, props,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         epoch_us(ts) // 1000 AS ms,
         CAST(ts AS DATE) AS date,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 6 AS INTEGER) AS sess
  FROM events
),
user_country AS (
  SELECT c.c_custkey AS distinct_id, n.n_name AS country
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
),
client_events AS (
  SELECT e.event_id, e.user_id AS distinct_id, e.date, e.ms AS time, e.ms AS res_timestamp,
    CASE
      WHEN e.event_type = 'view' THEN CASE e.k % 3 WHEN 0 THEN 'offer_impression' WHEN 1 THEN 'native_popup' WHEN 2 THEN 'promo_impression' END
      WHEN e.event_type = 'click' THEN CASE e.k % 2 WHEN 0 THEN 'purchase_click' WHEN 1 THEN 'pre_purchase_click' END
      WHEN e.event_type = 'purchase' THEN CASE e.k % 5 WHEN 0 THEN 'purchase_successful' WHEN 1 THEN 'purchase_successful'
                                        WHEN 2 THEN 'verify_request' WHEN 3 THEN 'verify_approval' WHEN 4 THEN 'rewards' END
      WHEN e.event_type = 'signup' THEN 'config_loaded'
    END AS event_name,
    CASE WHEN e.event_type = 'click' AND e.k % 2 = 1 THEN
      CASE (e.k // 2) % 4 WHEN 0 THEN 'continue' WHEN 1 THEN 'continue' WHEN 2 THEN 'select_direct' WHEN 3 THEN 'select_store' END
    END AS cta_name,
    CASE WHEN e.event_type IN ('click', 'view', 'purchase') THEN
      CASE WHEN (e.user_id * 5 + e.sess) % 7 < 4 THEN 'direct' WHEN e.user_id % 2 = 0 THEN 'apple' ELSE 'googleplay' END
    END AS payment_platform,
    CASE WHEN e.event_type IN ('click', 'view', 'purchase') THEN e.user_id * 16 + e.sess END AS funnel_id,
    CASE WHEN e.user_id % 2 = 0 THEN 'Apple' ELSE 'Android' END AS os,
    CASE WHEN e.event_id % 29 = 0 THEN 0.0 ELSE CAST(3773 + e.event_id % 10 AS DOUBLE) / 1e4 END AS version_float,
    CASE WHEN e.event_type = 'purchase' AND e.k % 17 <> 0 THEN e.value END AS price_usd,
    CAST(CASE WHEN e.k % 9 = 0 THEN 1 ELSE 0 END AS INTEGER) AS interrupted,
    CASE WHEN e.user_id % 2 = 0 AND e.k % 13 <> 0 THEN
      CASE WHEN e.k % 11 = 0 THEN '' ELSE 'p' || CAST(e.event_id AS VARCHAR) END END AS purchase_id,
    CASE WHEN e.user_id % 2 = 1 AND e.k % 13 <> 0 THEN
      CASE WHEN e.k % 11 = 0 THEN '' ELSE 'g' || CAST(e.event_id AS VARCHAR) END END AS google_order_number,
    CASE WHEN e.event_type = 'signup' THEN
      CASE WHEN e.user_id % 5 = 4 THEN 'other.flag'
           WHEN (e.user_id % 5 < 2) <> (e.k < 8) THEN 'a,LiveOpsData.exp_test'
           ELSE 'LiveOpsData.exp_control' END
    END AS segments,
    e.props AS promo_snapshot,
    uc.country
  FROM ev e LEFT JOIN user_country uc ON e.user_id = uc.distinct_id
  WHERE e.event_type <> 'error'
),
server_events AS (
  SELECT e.user_id AS distinct_id, e.date, e.ms // 1000 AS request_timestamp, e.event_id AS request_id,
    CASE e.k % 5 WHEN 0 THEN 'wf_impression' WHEN 1 THEN 'wf_add_card' WHEN 2 THEN 'wf_checkout_click'
                 WHEN 3 THEN 'wf_success' WHEN 4 THEN 'wh_success' END AS event_name,
    CASE WHEN e.k % 5 = 2 THEN CASE WHEN e.k % 2 = 0 THEN 'pay' ELSE 'cancel' END END AS cta_name,
    CASE WHEN e.k % 19 <> 0 THEN (e.user_id * 16 + e.sess) * 3 + e.k % 3 END AS transaction_id,
    CASE WHEN e.k % 4 <> 0 THEN e.user_id * 16 + e.sess END AS funnel_id
  FROM ev e
  WHERE e.event_type = 'error'
),
dim_player AS (
  SELECT c.c_custkey AS distinct_id, f.first_event_time, r.r_name AS first_country
  FROM customer c
  JOIN nation n ON n.n_nationkey = c.c_nationkey
  JOIN region r ON r.r_regionkey = n.n_regionkey
  LEFT JOIN (SELECT user_id AS distinct_id, min(ts) AS first_event_time FROM events GROUP BY user_id) f
    ON c.c_custkey = f.distinct_id
),
dim_country AS (
  SELECT n_name AS country_code, n_nationkey % 4 = 0 AS is_low_payers_country FROM nation
),
tester_list AS (
  SELECT c_custkey AS distinct_id FROM customer WHERE c_custkey % 10 = 0
)
"""
