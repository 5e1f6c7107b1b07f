"""Device, browser and operating system from a user agent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adgauge.functions.text import any_token, as_col, first_label, is_blank

# Label -> tokens, in the order they are tried.
TRACKER_DEVICES = {
    "Tablet": ("tablet", "ipad"),
    "Mobile": ("mobile", "android", "iphone", "ipod", "blackberry", "windows phone"),
    "SmartTV": ("smart-tv", "smarttv", "googletv"),
}
CONSUMER_DEVICES = {
    "Mobile": ("mobile", "android", "iphone"),
    "Tablet": ("tablet", "ipad"),
}
OPERATING_SYSTEMS = {
    "iOS": ("iphone", "ipad", "ipod"),
    "Android": ("android",),
    "Windows": ("windows nt",),
    "MacOS": ("mac os", "macos"),
    "Linux": ("linux",),
}
# Label -> (tokens of which one must occur, tokens that must not occur).
BROWSERS = {
    "Edge": (("edg/", "edge"), ()),
    "Opera": (("opr/", "opera"), ()),
    "Chrome": (("chrome",), ("edg",)),
    "Safari": (("safari",), ("chrome",)),
    "Firefox": (("firefox",), ()),
    "IE": (("msie", "trident"), ()),
}


def _classify(ua, table: dict[str, tuple[str, ...]], default: str) -> Column:
    rules = [("Unknown", is_blank(ua))]
    rules += [(label, any_token(ua, tokens)) for label, tokens in table.items()]
    return first_label(rules, default)


def device_tracker(ua) -> Column:
    """Tablet wins over mobile, so Android tablets are tablets."""
    return _classify(ua, TRACKER_DEVICES, "Desktop")


def device_consumer(ua) -> Column:
    """Mobile wins over tablet; no TV class."""
    return _classify(ua, CONSUMER_DEVICES, "Desktop")


def os_name(ua) -> Column:
    return _classify(ua, OPERATING_SYSTEMS, "Other")


def browser(ua) -> Column:
    rules = [("Unknown", is_blank(ua))]
    for label, (wanted, unwanted) in BROWSERS.items():
        condition = any_token(ua, wanted)
        if unwanted:
            condition = condition & ~any_token(ua, unwanted)
        rules.append((label, condition))
    return first_label(rules, "Other")


def or_unknown(value) -> Column:
    return F.coalesce(as_col(value), F.lit("Unknown"))


def source_label(s2s) -> Column:
    return F.when(as_col(s2s), "S2S").otherwise("Pixel")
