"""
literal expected results."""

from datetime import date

from fixtures import ev, player, srv, tables, tag

from funnelkit.operators import cohort as C
from funnelkit.operators import experiment as X
from funnelkit.operators import funnels as FN
from funnelkit.operators import kpi as K
from funnelkit.operators import latency as L
from funnelkit.operators import promo as PR
from funnelkit.operators import segments as S
from funnelkit.operators import switching as SW
from funnelkit.plans.params import Params, default_params

P0 = default_params()


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_k9_latest_tag_wins_and_test_beats_control(spark):
    t = tables(spark, [
        tag(1, 2, "test"), tag(1, 5, "control"),            # latest = control
        tag(2, 3, "both"),                                   # both tags -> test
        tag(3, 4, "control"), tag(3, 4, "test", sec=10),     # same day, later time wins
        ev(4, 3, "config_loaded", segments="other.flag"),    # untagged
    ])
    got = {r["distinct_id"]: r["segment"] for r in rows(S.user_segments(t.client, P0))}
    assert got == {1: "control", 2: "test", 3: "test"}


def test_k9_lookback_window(spark):
    p = P0.replace(as_of=date(2024, 2, 20))  # 30-day look-back starts 2024-01-21
    t = tables(spark, [tag(1, 2, "test"), tag(2, 25, "control")])
    got = {r["distinct_id"]: r["segment"] for r in rows(S.user_segments(t.client, p))}
    assert got == {2: "control"}


def test_k1_k2_purchase_summary_validity_and_rows(spark):
    t = tables(spark, [
        tag(1, 1, "test"),
        ev(1, 16, "purchase_successful", payment_platform="direct", price_usd=10.0, funnel_id=7),
        ev(1, 16, "purchase_successful", payment_platform="direct", price_usd=10.0, funnel_id=7, sec=5),
        ev(1, 17, "purchase_successful", payment_platform="apple", price_usd=5.0, purchase_id=""),
        ev(1, 18, "purchase_successful", payment_platform="apple", price_usd=4.0, purchase_id="p1"),
    ])
    r = rows(S.purchase_summary(t, P0))[0]
    assert r["total_revenue"] == 24.0 and r["direct_revenue"] == 20.0 and r["store_revenue"] == 4.0
    assert r["total_purchases"] == 3 and r["direct_purchases"] == 2 and r["store_purchases"] == 1


def test_k2_k15_cohort_funnel_distinct_and_gating(spark):
    t = tables(spark, [
        tag(1, 1, "test"),
        ev(1, 16, "purchase_click", payment_platform="direct", funnel_id=7),
        ev(1, 16, "pre_purchase_click", cta_name="continue", payment_platform="direct", funnel_id=7),
        ev(1, 16, "purchase_successful", payment_platform="direct", price_usd=10.0, funnel_id=7),
        ev(1, 16, "purchase_successful", payment_platform="direct", price_usd=10.0, funnel_id=7, sec=1),
        # apple purchase without a store continue in its funnel: not counted (gated)
        ev(1, 17, "purchase_successful", payment_platform="apple", price_usd=3.0, purchase_id="a", funnel_id=8),
        # googleplay purchase whose funnel had an *apple* continue: counted (any store gates)
        ev(1, 18, "pre_purchase_click", cta_name="continue", payment_platform="apple", funnel_id=9),
        ev(1, 18, "purchase_successful", payment_platform="googleplay", price_usd=2.0,
           google_order_number="g", funnel_id=9),
    ])
    r = rows(C.cohort_funnel(t, P0))[0]
    assert r["direct_purchases"] == 1 and r["direct_revenue"] == 20.0  # K2
    assert r["apple_purchases"] == 0 and r["apple_revenue"] == 0.0 and r["apple_paying_users"] == 0
    assert r["google_purchases"] == 1 and r["google_revenue"] == 2.0 and r["google_paying_users"] == 1
    daily = {str(x["event_date"]): x for x in rows(C.cohort_daily(t, P0))}
    # day offsets count from 2024-01-01, so offset 18 is 2024-01-19
    assert daily["2024-01-19"]["store_purchases"] == 1 and daily["2024-01-19"]["store_revenue"] == 2.0
    assert daily["2024-01-19"]["store_continue"] == 1
    assert daily["2024-01-18"]["store_purchases"] == 1  # the daily view is not gated


def test_k13_effective_start():
    assert P0.effective_start == date(2024, 1, 15)
    assert P0.replace(test_start=date(2024, 3, 1)).effective_start == date(2024, 1, 1)
    assert P0.replace(start=date(2024, 1, 20)).effective_start == date(2024, 1, 20)
    assert P0.replace(test_start=None).effective_start == date(2024, 1, 1)


def test_k11_symmetric_window():
    lo, ts, hi = P0.experiment_window
    assert (ts, hi) == (date(2024, 1, 15), date(2024, 1, 30))
    assert (ts - lo).days == (hi - ts).days + 1 == 16


def test_k16_first_and_repeat_same_day(spark):
    d = dict(payment_platform="direct")
    t = tables(spark, [
        tag(1, 1, "test"), tag(2, 1, "test"),
        ev(1, 16, "purchase_successful", funnel_id=1, **d), ev(1, 16, "purchase_successful", funnel_id=2, **d),
        ev(2, 10, "purchase_successful", funnel_id=3, **d),   # before range: look-back only
        ev(2, 17, "purchase_successful", funnel_id=4, **d),
    ])
    got = {str(r["event_date"]): (r["first_purchase_users"], r["repeat_purchase_users"])
           for r in rows(C.first_vs_repeat(t, P0))}
    # user 2's first purchase is in the look-back, so the in-range one is a repeat
    assert got == {"2024-01-17": (1, 1), "2024-01-18": (0, 1)}
    depth = rows(C.purchase_depth(t, P0))[0]
    assert (depth["users_1st_purchase"], depth["users_2nd_purchase"], depth["users_3rd_purchase"]) == (2, 2, 0)


def test_atv_tiers_with_ties(spark):
    d = dict(payment_platform="direct")
    t = tables(spark, [tag(1, 1, "test")] + [
        ev(1, 16, "purchase_successful", funnel_id=1, price_usd=float(i + 1), sec=i, **d) for i in range(5)])
    got = {r["tier_order"]: (r["num_purchases"], r["total_revenue"]) for r in rows(C.atv_by_purchase_number(t, P0))}
    assert got == {1: (1, 1.0), 2: (1, 2.0), 3: (1, 3.0), 4: (2, 9.0)}


def test_k17_negative_days_bucket(spark):
    p = P0.replace(test_start=None)
    t = tables(spark, [tag(1, 1, "test"), tag(2, 1, "test"),
                       ev(1, 3, "purchase_successful", payment_platform="direct", funnel_id=1),
                       ev(2, 3, "purchase_successful", payment_platform="direct", funnel_id=2)],
               players=[player(1, install_day=5), player(2, install_day=3)])
    got = {r["days_bucket"]: r["users"] for r in rows(C.time_to_first_purchase(t, p))}
    assert got == {"Day 31+": 1, "Day 0 (Same day)": 1}


def test_k18_same_day_switch_is_direct_then_store(spark):
    t = tables(spark, [
        tag(1, 1, "test"), tag(2, 1, "test"),
        ev(1, 16, "purchase_successful", payment_platform="direct", funnel_id=1),
        ev(1, 16, "purchase_successful", payment_platform="apple", funnel_id=2, purchase_id="x"),
        ev(2, 16, "purchase_successful", payment_platform="apple", funnel_id=3, purchase_id="y"),
        ev(2, 18, "purchase_successful", payment_platform="direct", funnel_id=4),
    ])
    got = {r["category"]: r["user_count"] for r in rows(SW.switch_categories(t, P0))}
    assert got == {"direct_only": 0, "store_only": 0, "direct_then_store": 1, "store_then_direct": 1}


def test_k6_metadata_user_vs_event_mode(spark):
    client = [tag(1, 1, "test"),
              ev(1, 16, "purchase_click", sec=0, version_float=0.3776),
              ev(1, 16, "purchase_click", sec=100, version_float=0.0),     # 0 -> unknown, skipped
              ev(1, 16, "purchase_click", sec=200, version_float=0.3790)]
    server = [srv(1, 16, "wf_impression", sec=50, rid=11), srv(1, 16, "wf_success", sec=300, rid=12)]
    t = tables(spark, client, server)
    user = {r["request_id"]: r["client_version_float"] for r in rows(FN.server_event_enrichment(t, P0, "user"))}
    event = {r["request_id"]: r["client_version_float"] for r in rows(FN.server_event_enrichment(t, P0, "event"))}
    assert user == {11: 0.379, 12: 0.379}        # the user's latest value, for every event
    assert event == {11: 0.3776, 12: 0.379}      # as of each event's own time


def test_k6_event_mode_carries_over_days(spark):
    client = [tag(1, 1, "test"), ev(1, 14, "purchase_click", version_float=0.3777)]
    server = [srv(1, 16, "wf_impression", sec=10, rid=21)]
    t = tables(spark, client, server)
    event = {r["request_id"]: r["client_version_float"] for r in rows(FN.server_event_enrichment(t, P0, "event"))}
    assert event == {21: 0.3777}


def test_k22_even_sized_median_is_lower_middle(spark):
    d = dict(payment_platform="direct", funnel_id=None)
    client = [tag(1, 1, "test")]
    for f, gap in ((1, 10), (2, 20), (3, 30), (4, 40)):
        d["funnel_id"] = f
        client += [ev(1, 16, "pre_purchase_click", sec=f * 1000, cta_name="continue", **d),
                   ev(1, 16, "rewards", sec=f * 1000 + gap, **d)]
    t = tables(spark, client)
    r = {x["payment_platform"]: x for x in rows(L.funnel_latency(t, P0))}["direct"]
    assert r["median_continue_to_rewards"] == 20.0 and r["avg_continue_to_rewards"] == 25.0


def test_k19_latency_requires_positive_continue_to_rewards(spark):
    d = dict(payment_platform="direct")
    client = [tag(1, 1, "test"),
              ev(1, 16, "pre_purchase_click", sec=100, cta_name="continue", funnel_id=1, **d),
              ev(1, 16, "rewards", sec=50, funnel_id=1, **d)]
    t = tables(spark, client)
    assert rows(L.funnel_latency(t, P0)) == []


def test_k23_malformed_promo_json_dropped(spark):
    p = P0.replace(extra={"promo_config_path": "$.config_id"})
    t = tables(spark, [
        tag(1, 1, "test"),
        ev(1, 16, "promo_impression", promo_snapshot='{"config_id": 5}'),
        ev(2, 16, "promo_impression", promo_snapshot='{"config_id": 5'),       # malformed
        ev(3, 16, "promo_impression", promo_snapshot='{"config_id": "abc"}'),  # not numeric
        ev(4, 16, "promo_impression", promo_snapshot='{"config_id": 5}'),
    ])
    got = {r["segment"]: r["users"] for r in rows(PR.promo_segments(t, p))}
    assert got == {"Test": 1, "Not in Test/Control": 1}
    assert rows(PR.promo_verdict(PR.promo_segments(t, p)))[0]["verdict"] == "only_test"


def test_k27_zero_base_gives_no_rows(spark):
    t = tables(spark, [tag(1, 1, "test"), ev(1, 16, "rewards", payment_platform="direct", funnel_id=1)])
    strip = FN.user_funnel(t, P0)
    assert rows(strip)[0]["rewards_users"] == 1
    assert rows(FN.funnel_pct(strip, FN.USER_FUNNEL_ORDER, "", "_users")) == []


def test_platform_kpi_rules(spark):
    t = tables(spark, [
        tag(1, 1, "test"), tag(2, 1, "test", os="Android"),
        ev(1, 16, "purchase_click", os="Apple", payment_platform="apple", funnel_id=1),
        ev(1, 16, "pre_purchase_click", os="Apple", cta_name="continue", payment_platform="apple", funnel_id=1),
        ev(1, 16, "purchase_successful", os="Apple", payment_platform="apple", purchase_id="p", funnel_id=1,
           price_usd=10.0),
        ev(2, 16, "purchase_click", os="Android", payment_platform="direct", funnel_id=2),
    ])
    got = {r["payment_platform"]: r for r in rows(K.platform_kpi(t, P0))}
    assert got["apple"]["active_users"] == 1 and got["googleplay"]["active_users"] == 1
    assert got["direct"]["active_users"] == 2 and got["direct"]["pp_continue_from_purchase_clicks_rate"] == 0.0
    assert got["apple"]["pp_continue_from_purchase_clicks_rate"] == 100.0
    assert got["apple"]["pp_purchase_continue_to_successful_rate"] == 100.0
    assert got["apple"]["total_net_revenue"] == 7.0 and got["apple"]["ppu_percentage"] == 100.0


def test_k8_exclusions_only_in_panel_queries(spark):
    t = tables(spark, [tag(1, 1, "test", country="NATION_3"),
                       ev(1, 16, "purchase_click", country="NATION_3", payment_platform="direct", funnel_id=1)],
               players=[player(1)])
    kpi = {r["payment_platform"]: r for r in rows(K.platform_kpi(t, P0))}
    assert kpi["direct"]["active_users"] == 0                                      # excluded country
    assert rows(FN.user_funnel(t, P0))[0]["purchase_click_users"] == 1             # no exclusion here
    everywhere = P0.replace(apply_exclusions_everywhere=True)
    assert rows(FN.user_funnel(t, everywhere))[0]["purchase_click_users"] == 0


def test_did_missing_cell_counts_zero(spark):
    t = tables(spark, [tag(1, 16, "test"), ev(1, 20, "purchase_click", funnel_id=1, payment_platform="direct")])
    did = {r["kpi"]: r for r in rows(X.did_summary(X.experiment_timeline(t, P0, exact=True)))}
    a = did["active_users"]
    assert (a["test_before"], a["test_after"], a["control_before"], a["control_after"]) == (0.0, 1.0, 0.0, 0.0)
    assert a["test_change_pct"] == 0.0 and a["diff_in_diff"] == 1.0 and a["diff_in_diff_pct"] == 0.0


def test_pair_stats_match_brute_force(spark):
    """Hot and small funnels, equal times, hour borders and repeated rows: count, mean and lower median of all pairs."""
    import random
    import statistics
    from funnelkit.functions.pairs import pair_stats
    rng = random.Random(3)
    base = 1_700_000_000_000
    imp = [(1, base + 1000 * i + 7 * (i % 5), "d") for i in range(60)] * 2 + [(2, 5, "d"), (None, 1, "d")]
    later = [(1, base + 1500 * i + 3) for i in range(45)] + [(1, base + 86_400_000 + 250 * i) for i in range(10)] + [(2, 9), (3, 1)]
    for g in "efghi":  # wide and narrow spreads, so that the median falls in buckets of every size
        spread = {"e": 40, "f": 3_000, "g": 200_000, "h": 9_000_000, "i": 400_000_000}[g]
        for f in range(10, 14):
            imp += [(f * ord(g), base + rng.randrange(spread), g) for _ in range(rng.randrange(1, 30))]
            later += [(f * ord(g), base + rng.randrange(spread)) for _ in range(rng.randrange(1, 30))]
    rows = [(*r, True, False) for r in imp] + [(f, t, "z", False, True) for f, t in later]
    schema = "funnel_id bigint, t bigint, g string, first boolean, later boolean"
    got = {r["g"]: r for r in pair_stats(spark.createDataFrame(rows, schema), "g").collect()}
    for g in "defghi":
        deltas = sorted(c - i for k, i, h in imp if h == g for f, c in later if f == k and c > i)
        assert got[g]["n_pairs"] == len(deltas)
        assert abs(got[g]["avg_s"] - statistics.fmean(deltas) / 1000) < 1e-9
        assert got[g]["median_s"] == deltas[(len(deltas) + 1) // 2 - 1] / 1000
    assert len(got) == 6


def test_pair_stats_of_a_hot_funnel(spark):
    """One funnel of 10^5 events: 1.25 * 10^9 later pairs, known in closed form."""
    from funnelkit.functions.pairs import pair_stats
    n = 50_000
    rows = spark.range(2 * n).selectExpr("1L as funnel_id", "id * 50 as t", "'d' as g", "id % 2 = 0 as first", "id % 2 = 1 as later")
    r = pair_stats(rows, "g").first()  # n - j pairs of difference 100 * j + 50
    assert r["n_pairs"] == n * (n + 1) // 2
    assert abs(r["avg_s"] - sum((n - j) * (100 * j + 50) for j in range(n)) / r["n_pairs"] / 1000) < 1e-6
    seen, j = n, 0
    while seen < (r["n_pairs"] + 1) // 2:
        j += 1
        seen += n - j
    assert r["median_s"] == (100 * j + 50) / 1000


def test_low_payer_filter_semi_join(spark):
    p = P0.replace(low_payers_only=True)
    t = tables(spark, [tag(1, 1, "test", country="NATION_0"), tag(2, 1, "test", country="NATION_1"),
                       ev(1, 16, "purchase_click", country="NATION_0", payment_platform="direct", funnel_id=1),
                       ev(2, 16, "purchase_click", country="NATION_1", payment_platform="direct", funnel_id=2)],
               countries=[dict(country_code="NATION_0", is_low_payers_country=True),
                          dict(country_code="NATION_1", is_low_payers_country=False)])
    assert rows(FN.user_funnel(t, p))[0]["purchase_click_users"] == 1
    assert rows(FN.user_funnel(t, P0))[0]["purchase_click_users"] == 2
