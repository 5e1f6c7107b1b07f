"""Scalar rules on literal vectors."""

import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from adgauge.functions import agents, bots, geo, identity, stats, survey, text
from adgauge.operators import events

IPHONE = "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) AppleWebKit Version/17.0 Mobile Safari/604.1"
ANDROID_TABLET = "Mozilla/5.0 (Linux; Android 14; Tablet) Chrome/121.0 Safari/537.36"
EDGE = "Mozilla/5.0 (Windows NT 10.0) Chrome/121.0 Safari/537.36 Edg/121.0"


def evaluate(spark, rows, schema, *columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.mark.parametrize(("ua", "tracker", "consumer", "browser", "system"), [
    (None, "Unknown", "Unknown", "Unknown", "Unknown"),
    (" \t", "Unknown", "Unknown", "Unknown", "Unknown"),
    (IPHONE, "Mobile", "Mobile", "Safari", "iOS"),
    (ANDROID_TABLET, "Tablet", "Mobile", "Chrome", "Android"),
    (EDGE, "Desktop", "Desktop", "Edge", "Windows"),
    ("Opera/9.80 OPR/60", "Desktop", "Desktop", "Opera", "Other"),
    ("Mozilla/5.0 (SMART-TV; Linux)", "SmartTV", "Desktop", "Other", "Linux"),
    ("Mozilla (Macintosh; Mac OS X) Safari/1", "Desktop", "Desktop", "Safari", "MacOS"),
    ("Trident/7.0", "Desktop", "Desktop", "IE", "Other"),
])
def test_agents(spark, ua, tracker, consumer, browser, system):
    got = evaluate(
        spark, [(ua,)], "ua string", agents.device_tracker("ua"), agents.device_consumer("ua"),
        agents.browser("ua"), agents.os_name("ua"),
    )
    assert got == [(tracker, consumer, browser, system)]


def test_bot_rules_differ_on_blank_and_unknown(spark):
    rows = [(None,), ("",), ("Unknown",), ("GoogleBot",), ("curl/8",), (EDGE,)]
    got = evaluate(spark, rows, "ua string", *bots.bot_stream("ua"), *bots.bot_consumer("ua"))
    assert got == [
        (True, "missing_user_agent", True, "Empty user agent"),
        (False, None, True, "Empty user agent"),
        (True, "unknown_user_agent", False, None),
        (True, "user_agent_blacklist", True, "Bot pattern in user agent"),
        (True, "user_agent_blacklist", False, None),
        (False, None, False, None),
    ]


def test_agent_score_follows_the_formula(spark):
    rows = [("curl/7.64.1",), ("UNKNOWN",), (None,), (EDGE,), ("security scan tool of some kind",)]
    got = evaluate(spark, rows, "ua string", *bots.ua_score("ua"))
    assert [round(s, 6) for s, _ in got] == [1.5, 0.8, 1.0, 0.0, 0.7]
    assert got[0][1] == ["bot_pattern_in_ua", "suspiciously_short_ua", "no_common_browser_in_ua"]
    confidence, is_bot, _ = bots.combine_scores(bots.ua_score("ua"))
    assert evaluate(spark, [("curl/7.64.1",)], "ua string", confidence, is_bot) == [(0.375, False)]


def test_header_score_and_lookup(spark):
    rows = [
        ({"ACCEPT": "*/*", "X-Forwarded-For": " 1.2.3.4 , 9.9.9.9"},),
        ({"Accept": "text/html", "accept": "late", "X-S2S": "True", "User-Agent": "x"},),
        ({},),
        (None,),
    ]
    score, reasons = bots.header_score("h")
    got = evaluate(spark, rows, "h map<string,string>", F.round(score, 6), reasons,
                   events.client_ip("h"), events.is_s2s("h"), bots.header_value("h", "Accept"))
    assert got[0] == (0.7, ["missing_common_headers:accept-language,accept-encoding",
                            "suspicious_accept_header", "proxy_without_real_ip"], "1.2.3.4", False, "*/*")
    assert got[1][0] == 0.4 and got[1][3] is True and got[1][4] == "text/html"
    assert got[2] == (0.0, [], "Unknown", False, None)
    assert got[3] == (0.0, [], "Unknown", False, None)


def test_rate_and_fingerprint_scores(spark):
    rows = [("1.1.1.1", 101, 1001, True, "f" * 20, 1001), ("", 500, 5000, True, "short", 600)]
    schema = "ip string, m bigint, h bigint, r boolean, f string, d bigint"
    rate, why = bots.rate_score("ip", "m", "h", "r")
    print_score, print_why = bots.fingerprint_score("f", "d")
    got = evaluate(spark, rows, schema, F.round(rate, 6), why, F.round(print_score, 6), print_why)
    assert got[0] == (2.4, ["rate_limit_exceeded_per_minute:101", "rate_limit_exceeded_per_hour:1001",
                            "requests_too_rapid"], 1.0, ["fingerprint_overused:1001"])
    assert got[1] == (0.0, [], 0.8, ["fingerprint_suspicious_usage:600", "weak_fingerprint"])


def test_hashes(spark):
    rows = [("  Ann@Example.COM ", "+1 (555) 010-42"), (" ", None)]
    got = evaluate(spark, rows, "e string, p string", identity.hash_email("e"), identity.hash_phone("p"))
    assert got == [
        (hashlib.sha256(b"ann@example.com").hexdigest(), hashlib.sha256(b"155501042").hexdigest()),
        ("", ""),
    ]
    row = [("c", None, "u", "2024-05-06 07:08:09.123456")]
    schema = "c string, k string, u string, t string"
    [(value,)] = evaluate(spark, row, schema,
                          identity.tracking_hash("c", "k", "u", F.col("t").cast("timestamp")))
    digest = hashlib.sha256(b"c||u|2024-05-06T07:08:09.1234560Z").digest()
    assert value == base64.b64encode(digest).decode()[:16] and len(value) == 16


def test_device_fingerprint_treats_zero_offset_as_missing(spark):
    rows = [("ua", "1x1", 0, ["a", "b"]), (None, None, None, None), ("ua", None, 60, [])]
    schema = "ua string, r string, z int, p array<string>"
    got = evaluate(spark, rows, schema, identity.device_fingerprint("ua", "r", "z", "p"))
    want = [hashlib.sha256(t.encode()).hexdigest() for t in ("ua|1x1||a,b", "|||", "ua||60|")]
    assert [g for (g,) in got] == want


def test_age_ranges(spark):
    ages = [None, 17, 18, 24, 25, 34, 35, 44, 45, 54, 55, 64, 65, 100]
    got = evaluate(spark, [(a,) for a in ages], "a int", identity.age_range("a"))
    assert [g for (g,) in got] == [
        None, "<18", "18-24", "18-24", "25-34", "25-34", "35-44", "35-44", "45-54", "45-54",
        "55-64", "55-64", "65+", "65+",
    ]


def test_countries(spark):
    ips = ["1.0.0.1", "50.1.1.1", "51.1.1.1", "150.0.0.1", "200.0.0.1", "201.0.0.1", "x", None, "10.0.0.1", "::1"]
    got = evaluate(spark, [(i,) for i in ips], "ip string", geo.country_by_octet("ip"), geo.country_consumer("ip"))
    assert [g[0] for g in got] == ["US", "US", "UK", "DE", "FR", "XX", "XX", "XX", "US", "XX"]
    assert [g[1] for g in got][-2:] == ["US", "US"] and got[0][1] == "Unknown"


def test_answers_and_labels(spark):
    rows = [("YesNo", None, "No"), ("YesNo", None, "Yes"), ("Rating", None, "7"),
            ("LikertScale", ["low", "mid", "high"], "high"), ("OpenEnded", None, "5"),
            ("LikertScale", ["low"], "other")]
    got = evaluate(spark, rows, "k string, o array<string>, a string",
                   survey.answer_index("k", "o", "a"), survey.answer_value("k", "o", "a"))
    assert got == [(2.0, 0.0), (1.0, 1.0), (7.0, 7.0), (3.0, 3.0), (None, None), (None, None)]
    [(label, parts)] = evaluate(spark, [("brand_awareness", " a, ,b ,")], "m string, s string",
                                text.metric_label("m"), text.split_list("s"))
    assert label == "Brand Awareness" and parts == ["a", "b"]


def test_step_p_and_stars(spark):
    ts = [2.6, -2.0, 1.7, 1.645, 0.0]
    got = evaluate(spark, [(t,) for t in ts], "t double", stats.step_p("t"), stats.stars(stats.step_p("t")))
    assert got == [(0.001, "**"), (0.01, "*"), (0.05, "ns"), (0.10, "ns"), (0.10, "ns")]


def test_t_distribution_against_tables():
    # Critical values of the two-sided t test from standard tables.
    table = [(12.706, 1, 0.05), (63.657, 1, 0.01), (4.303, 2, 0.05), (2.571, 5, 0.05), (2.228, 10, 0.05),
             (3.169, 10, 0.01), (2.042, 30, 0.05), (1.980, 120, 0.05), (1.96, 10_000_000, 0.05)]
    for t, df, p in table:
        assert stats.two_sided_t(np.array([t]), np.array([df]))[0] == pytest.approx(p, rel=2e-3)
    assert stats.two_sided_t(np.array([0.0]), np.array([7]))[0] == 1.0
    assert stats.two_sided_t(np.array([np.inf]), np.array([7]))[0] == 0.0
    assert np.isnan(stats.two_sided_t(np.array([1.0]), np.array([0]))[0])
    exact = 1 - 2 / np.pi * np.arctan(1.5)
    assert stats.two_sided_t(np.array([1.5, -1.5]), np.array([1, 1])) == pytest.approx([exact, exact], abs=1e-13)
    big = stats.two_sided_t(np.array([40.0]), np.array([200]))[0]
    assert 0 < big < 1e-90


def test_pixel_url_and_errors(spark):
    url = "https://t.example/p?cid=c%201&uid=u&adserver=&x=1"
    df = spark.createDataFrame([(url,), ("::bad::",)], "url string")
    rows = events.parse_pixel_requests(df).collect()
    assert (rows[0].campaign_id, rows[0].creative_id, rows[0].panelist_token) == ("c 1", None, "u")
    assert rows[1].campaign_id is None
    got = evaluate(spark, [(None, " ", "x")], "a string, b string, c string", events.validation_errors(
        {"a": "a missing", "b": "b missing", "c": "c missing"}))
    assert got == [(["a missing", "b missing"],)]
