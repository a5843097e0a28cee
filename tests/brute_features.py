"""The 37 features by plain loops over earlier rows; no Spark involved."""

from __future__ import annotations

import math
from statistics import mean, median, stdev


def _spread(values):
    return stdev(values) if len(values) > 1 else 0.0


def brute(rows, prior=None):
    """rows: dicts with trans_num, us, hour, amt, cc_num, merchant, city, state."""
    prior = median(r["amt"] for r in rows) if prior is None else prior
    ordered = sorted(rows, key=lambda r: (r["us"], r["cc_num"], r["trans_num"]))
    out = {}
    for i, r in enumerate(ordered):
        past = ordered[:i]
        own = [p for p in past if p["cc_num"] == r["cc_num"]]
        shop = [p["amt"] for p in past if p["merchant"] == r["merchant"]]
        pair = [p["amt"] for p in own if p["merchant"] == r["merchant"]]
        amounts = [p["amt"] for p in own]
        sec = r["us"] // 1_000_000
        card_all = [p for p in ordered if p["cc_num"] == r["cc_num"]]

        def recent(width, same=False):
            return sum(
                1
                for p in card_all
                if sec - width <= p["us"] // 1_000_000 < sec and (not same or p["amt"] == r["amt"])
            )

        m, s = (mean(amounts) if own else prior), _spread(amounts)
        pm, ps = (mean(pair) if pair else prior), _spread(pair)
        t1 = (r["us"] - own[-1]["us"]) / 1e6 if own else None
        gaps = [(b["us"] - a["us"]) / 1e6 for a, b in zip(own, own[1:])]
        angle = lambda h: 2 * math.pi * h / 24
        place = (r["state"], r["city"])
        n = len(own)
        city = sum(p["city"] == r["city"] for p in own)
        state = sum(p["state"] == r["state"] for p in own)
        f = {
            "A1_amt_diff_prev": abs(r["amt"] - own[-1]["amt"]) if own else 0.0,
            "A2_amt_user_cum_mean": m,
            "A3_amt_dev_user_cum_median": abs(r["amt"] - (median(amounts) if own else prior)),
            "A4_identical_amt_cnt_24h": recent(86_400, same=True),
            "A5_amt_user_std_score": abs(r["amt"] - m) / (s + 1e-9),
            "A6_amt_within_1std_user": int(m - s <= r["amt"] <= m + s),
            "A7_amt_diff_merchant_mean": abs(r["amt"] - (mean(shop) if shop else prior)),
            "A8_merchant_amt_std": _spread(shop),
            "A9_user_merchant_cum_mean": pm,
            "A10_user_merchant_cum_std": ps,
            "A11_user_merchant_cum_sum": max(sum(pair), 0.0),
            "A12_user_merchant_global_mean": pm,
            "A13_user_merchant_global_std": ps,
            "A14_user_merchant_global_sum": max(sum(pair), 0.0),
            "A15_amt_within_2std_user_merchant": int(pm - 2 * ps <= r["amt"] <= pm + 2 * ps),
            "A16_amt_within_confidence_user_merchant": int(pm - ps <= r["amt"] <= pm + ps and len(pair) >= 3),
            "T1_time_diff_sec": t1,
            "T2_amt_time_angle": 0.0 if t1 is None else math.atan2(r["amt"], max(t1, 1.0)),
            "T3_hour_sin": math.sin(angle(r["hour"])),
            "T4_hour_cos": math.cos(angle(r["hour"])),
            "T5_is_madrugada": int(r["hour"] < 6),
            "T6_user_madrugada_ratio_cum": sum(p["hour"] < 6 for p in own) / n if n else 0.0,
            "T7_user_hour_vonmises_proxy": math.hypot(
                sum(math.sin(angle(p["hour"])) for p in own), sum(math.cos(angle(p["hour"])) for p in own)
            )
            / n
            if n
            else 0.0,
            "T8_txn_count_1s": recent(1),
            "T8_txn_count_10s": recent(10),
            "T8_txn_count_60s": recent(60),
            "T8_txn_count_1h": recent(3_600),
            "T8_txn_count_2h": recent(7_200),
            "T9_time_interval_coherent": int(
                bool(gaps) and mean(gaps) - 2 * _spread(gaps) <= t1 <= mean(gaps) + 2 * _spread(gaps)
            ),
            "L1_user_city_visit_count": city,
            "L2_user_country_visit_count": state,
            "L3_user_unique_city_count": len({p["city"] for p in own}),
            "L3_user_unique_country_count": len({p["state"] for p in own}),
            "L4_user_city_txn_ratio": city / n if n else 0.0,
            "L4_user_country_txn_ratio": state / n if n else 0.0,
            "L5_same_location_as_prev": int(bool(own) and (own[-1]["state"], own[-1]["city"]) == place),
            "L6_location_seen_before": int(any((p["state"], p["city"]) == place for p in own)),
        }
        out[r["trans_num"]] = f
    return out
