"""Bot rules: the stream blacklist, the consumer rule and the four-part score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adgauge.functions.text import any_token, as_col, is_blank

# User-agent tokens of the stream rule.
STREAM_TOKENS = (
    "bot", "crawler", "spider", "scraper", "curl", "wget", "python-requests",
    "java/", "go-http-client", "okhttp", "httpclient", "headless",
    "phantom", "selenium", "webdriver", "slurp", "bingbot", "googlebot",
    "baiduspider", "yandex", "duckduckbot", "facebookexternalhit",
)
# User-agent tokens of the consumer rule.
CONSUMER_TOKENS = (
    "bot", "crawl", "spider", "slurp", "scraper", "headless",
    "phantom", "selenium", "webdriver", "puppeteer",
)
# Tokens and weights of the score. Its bot tokens extend the stream list.
SCORE_BOT_TOKENS = STREAM_TOKENS + ("whatsapp", "telegram", "slack", "discord")
SCORE_SUSPICIOUS_TOKENS = (
    "test", "check", "monitor", "scan", "security", "penetration", "vulnerability",
)
SCORE_BROWSER_TOKENS = ("chrome", "firefox", "safari", "edge")
SCORE_COMMON_HEADERS = ("accept", "accept-language", "accept-encoding")


def bot_stream(ua) -> tuple[Column, Column]:
    """(is_bot, reason): listed token, null agent, or the literal "Unknown". Empty text passes."""
    c = as_col(ua)
    reason = (
        F.when(any_token(c, STREAM_TOKENS), "user_agent_blacklist")
        .when(c.isNull(), "missing_user_agent")
        .when(c == "Unknown", "unknown_user_agent")
    )
    return reason.isNotNull(), reason


def bot_consumer(ua, rate_exceeded=None) -> tuple[Column, Column]:
    """(is_bot, reason): blank agent, listed token, then the per-address rate flag if given."""
    c = as_col(ua)
    reason = F.when(is_blank(c), "Empty user agent").when(
        any_token(c, CONSUMER_TOKENS), "Bot pattern in user agent"
    )
    if rate_exceeded is not None:
        reason = reason.when(F.coalesce(as_col(rate_exceeded), F.lit(False)), "Rate limit exceeded")
    return reason.isNotNull(), reason


def passes_agent_checks(ua) -> Column:
    """Events the consumer rule lets through to its rate counter."""
    return ~is_blank(ua) & ~any_token(ua, CONSUMER_TOKENS)


def _weigh(checks: list[tuple[Column, float, Column]]) -> tuple[Column, Column]:
    """Sum of the weights and list of the reasons of the checks that hold."""
    score = F.lit(0.0)
    for condition, weight, _ in checks:
        score = score + F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))
    reasons = F.array_compact(F.array(*[F.when(cond, text) for cond, _, text in checks]))
    return score, reasons


def ua_score(ua) -> tuple[Column, Column]:
    c = as_col(ua)
    score, reasons = _weigh([
        (any_token(c, SCORE_BOT_TOKENS), 1.0, F.lit("bot_pattern_in_ua")),
        (any_token(c, SCORE_SUSPICIOUS_TOKENS), 0.5, F.lit("suspicious_ua_pattern")),
        (F.length(c) < 20, 0.3, F.lit("suspiciously_short_ua")),
        (~any_token(c, SCORE_BROWSER_TOKENS), 0.2, F.lit("no_common_browser_in_ua")),
    ])
    blank, unknown = is_blank(c), F.lower(c) == "unknown"
    return (
        F.when(blank, 1.0).when(unknown, 0.8).otherwise(score),
        F.when(blank, F.array(F.lit("missing_user_agent")))
        .when(unknown, F.array(F.lit("unknown_user_agent")))
        .otherwise(reasons),
    )


def rate_score(
    ip, n_minute, n_hour, rapid, per_minute: int = 100, per_hour: int = 1000
) -> tuple[Column, Column]:
    known = F.coalesce(as_col(ip) != "", F.lit(False))
    minute, hour = as_col(n_minute), as_col(n_hour)
    return _weigh([
        (known & (minute > per_minute), 1.0,
         F.concat(F.lit("rate_limit_exceeded_per_minute:"), minute.cast("string"))),
        (known & (hour > per_hour), 0.8,
         F.concat(F.lit("rate_limit_exceeded_per_hour:"), hour.cast("string"))),
        (known & as_col(rapid), 0.6, F.lit("requests_too_rapid")),
    ])


def header_score(headers) -> tuple[Column, Column]:
    """Header map, any key case. An empty or missing map scores nothing."""
    names = header_names(headers)
    present = F.coalesce(F.size(as_col(headers)) > 0, F.lit(False))
    missing = F.array_except(
        F.array(*[F.lit(h) for h in SCORE_COMMON_HEADERS]), names
    )
    accept = F.coalesce(header_value(headers, "accept"), F.lit(""))

    def has(name: str) -> Column:
        return F.array_contains(names, name)

    return _weigh([
        (present & (F.size(missing) >= 2), 0.4,
         F.concat(F.lit("missing_common_headers:"), F.array_join(missing, ","))),
        (present & (has("x-automated") | has("x-bot")), 1.0, F.lit("automation_header_present")),
        (present & accept.isin("*/*", ""), 0.2, F.lit("suspicious_accept_header")),
        (present & has("x-forwarded-for") & ~has("x-real-ip"), 0.1, F.lit("proxy_without_real_ip")),
    ])


def header_names(headers) -> Column:
    """Lower-case header names in map order; joined, lowered and split as one text."""
    return F.split(F.lower(F.array_join(F.map_keys(as_col(headers)), "\n")), "\n")


def header_value(headers, name: str) -> Column:
    """Header by name in any case, null when absent; of names equal but for case the first."""
    place = F.array_position(header_names(headers), name.lower()).cast("int") - 1
    return F.get(F.map_values(as_col(headers)), place)


def fingerprint_score(
    fingerprint, n_day, overused: int = 1000, suspicious: int = 500
) -> tuple[Column, Column]:
    f, n = as_col(fingerprint), as_col(n_day)
    known = F.coalesce(f != "", F.lit(False))
    return _weigh([
        (known & (n > overused), 1.0,
         F.concat(F.lit("fingerprint_overused:"), n.cast("string"))),
        (known & (n > suspicious) & (n <= overused), 0.5,
         F.concat(F.lit("fingerprint_suspicious_usage:"), n.cast("string"))),
        (known & (F.length(f) < 16), 0.3, F.lit("weak_fingerprint")),
    ])


# Limits of the scored rules.
SCORE_LIMITS = {
    "per_minute": 100, "per_hour": 1000, "overused": 1000, "suspicious": 500, "threshold": 0.7, "gap_ms": 100,
}


def bot_scored(
    ua="user_agent", ip="ip", headers="raw_headers", fingerprint="fingerprint", limits: dict | None = None
) -> tuple[Column, Column]:
    """(is_bot, reason) by the four-part score of rows with n_minute, n_hour, rapid and n_day.

    The reason is the joined reasons of the parts, null unless the row is a bot.
    """
    limit = SCORE_LIMITS | (limits or {})
    _, is_bot, reasons = combine_scores(
        ua_score(ua),
        rate_score(ip, "n_minute", "n_hour", "rapid", limit["per_minute"], limit["per_hour"]),
        header_score(headers),
        fingerprint_score(fingerprint, "n_day", limit["overused"], limit["suspicious"]),
        threshold=limit["threshold"],
    )
    return is_bot, F.when(is_bot, F.array_join(reasons, ","))


def combine_scores(
    *parts: tuple[Column, Column], divisor: float = 4.0, threshold: float = 0.7
) -> tuple[Column, Column, Column]:
    """(confidence, is_bot, reasons) from (score, reasons) parts, reasons in part order."""
    total = F.lit(0.0)
    for score, _ in parts:
        total = total + score
    confidence = F.least(total / F.lit(divisor), F.lit(1.0))
    return confidence, confidence >= threshold, F.concat(*[reasons for _, reasons in parts])
