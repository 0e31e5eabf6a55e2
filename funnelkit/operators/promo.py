"""Promotion exposure audit (A51-A54): which experiment arm saw a promo config.

The config id is read from the JSON snapshot with ``get_json_object`` +
``try_cast`` (malformed JSON or a non-numeric id gives null and the row drops).
Segments here are the latest tags of *all* users (no home-market filter), and
labels are capitalised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.functions import vocab as V
from funnelkit.operators.segments import user_segments
from funnelkit.plans.params import Params, limited
from funnelkit.sources.binding import Tables

OUTSIDE = "Not in Test/Control"  # fixed label


def promo_rows(t: Tables, p: Params) -> DataFrame:
    since = p.test_start or p.days_before(p.promo_days_back)
    cfg = F.get_json_object("promo_snapshot", p.extra.get("promo_config_path", "$.config_id")).try_cast("bigint")
    return t.client.where((F.col("event_name") == V.PROMO_IMPRESSION) & (F.col("date") >= F.lit(since))
                          & F.col("promo_snapshot").isNotNull() & (cfg == F.lit(p.promo_config_id)))


def _labels(t: Tables, p: Params) -> DataFrame:
    return user_segments(t.client, p).select("distinct_id", F.initcap("segment").alias("segment"))


def _per_user(t: Tables, p: Params) -> DataFrame:
    return (promo_rows(t, p).groupBy("distinct_id")
            .agg(F.min("date").alias("first_impression_date"), F.max("date").alias("last_impression_date"),
                 F.count(F.lit(1)).alias("impression_count")))


def promo_segments(t: Tables, p: Params) -> DataFrame:
    """Users and impressions per segment of promo-exposed users."""
    seg = F.coalesce(F.col("segment"), F.lit(OUTSIDE))
    return (_per_user(t, p).join(_labels(t, p), "distinct_id", "left")
            .groupBy(seg.alias("segment"))
            .agg(F.count_distinct("distinct_id").alias("users"),
                 F.sum("impression_count").cast("bigint").alias("total_impressions"))
            .orderBy("segment"))


def promo_user_details(t: Tables, p: Params) -> DataFrame:
    """Exposed users with segment and first / last impression; latest first."""
    return (_per_user(t, p).join(_labels(t, p), "distinct_id", "left")
            .select("distinct_id", F.coalesce(F.col("segment"), F.lit(OUTSIDE)).alias("segment"),
                    "first_impression_date", "last_impression_date", "impression_count")
            .orderBy(F.col("first_impression_date").desc(), F.col("distinct_id").asc())
            .transform(limited(p.detail_limit)))


def promo_outside_users(t: Tables, p: Params) -> DataFrame:
    """Exposed users with no experiment tag, by user / country / OS."""
    per = (t.with_country(promo_rows(t, p)).groupBy("distinct_id", "country", "os")
           .agg(F.min("date").alias("first_impression_date"), F.max("date").alias("last_impression_date"),
                F.count(F.lit(1)).alias("impression_count")))
    return (per.join(_labels(t, p).select("distinct_id"), "distinct_id", "left_anti")
            .select("distinct_id", F.lit(OUTSIDE).alias("segment"), "country", "os",
                    "first_impression_date", "last_impression_date", "impression_count")
            .orderBy(F.col("first_impression_date").desc(), F.col("distinct_id").asc(),
                     F.col("country").asc(), F.col("os").asc())
            .transform(limited(p.detail_limit)))


def promo_verdict(segments: DataFrame) -> DataFrame:
    """Test / control / other users and whether the promo reached only
    the test arm, only control, both, or neither."""
    def users(label):
        return F.coalesce(F.sum(F.when(F.col("segment") == label, F.col("users"))), F.lit(0)).cast("bigint")
    s = segments.agg(users("Test").alias("test_users"), users("Control").alias("control_users"),
                     users(OUTSIDE).alias("other_users"))
    t, c = F.col("test_users"), F.col("control_users")
    verdict = (F.when((c == 0) & (t > 0), F.lit("only_test"))
               .when((t == 0) & (c > 0), F.lit("only_control"))
               .when((t > 0) & (c > 0), F.lit("both"))
               .otherwise(F.lit("none")))
    return s.select("test_users", "control_users", "other_users", verdict.alias("verdict"))
