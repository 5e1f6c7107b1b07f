"""Country of an address and the attributes of a country."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adgauge.functions.text import as_col, first_label, lookup

# First-octet range -> country.
OCTET_COUNTRIES = {(1, 50): "US", (51, 100): "UK", (101, 150): "DE", (151, 200): "FR"}
# Country -> name, city, region, latitude, longitude.
COUNTRY_ATTRIBUTES = {
    "US": ("United States", "New York", "NY", 40.7128, -74.0060),
    "UK": ("United Kingdom", "London", "ENG", 51.5074, -0.1278),
    "DE": ("Germany", "Berlin", "BE", 52.5200, 13.4050),
    "FR": ("France", "Paris", "IDF", 48.8566, 2.3522),
}
UNKNOWN_ATTRIBUTES = ("Unknown", "Unknown", "XX", 0.0, 0.0)
ATTRIBUTE_NAMES = ("country_name", "city", "region", "latitude", "longitude")


def country_by_octet(ip) -> Column:
    octet = F.regexp_extract(as_col(ip), r"^(\d+)\.", 1).try_cast("int")
    rules = [(code, octet.between(low, high)) for (low, high), code in OCTET_COUNTRIES.items()]
    return first_label(rules, "XX")


def country_consumer(ip) -> Column:
    """Loopback and private ranges count as US, all else is unknown."""
    c = as_col(ip)
    local = c.isin("127.0.0.1", "::1") | c.startswith("192.168.") | c.startswith("10.")
    return F.when(local, "US").otherwise("Unknown")


def country_attributes(country) -> dict[str, Column]:
    """Attribute columns of a country code, by name."""
    return {
        name: lookup(
            country,
            {code: values[i] for code, values in COUNTRY_ATTRIBUTES.items()},
            UNKNOWN_ATTRIBUTES[i],
        )
        for i, name in enumerate(ATTRIBUTE_NAMES)
    }
