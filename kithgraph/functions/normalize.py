"""Column expressions that turn raw transaction fields into entity keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels and limits that decide an entity key.
KEY_LENGTH = 200
BUILD_MARK = " Build/"
TRIDENT = ("Trident/7.0", "Windows IE11")
UNKNOWN_OS = "unknown_os"
UNKNOWN_BROWSER = "unknown_browser"
NOT_A_PROXY = ("nan", "notfound", "")
DAY = 86_400


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_str(c: Column | str) -> Column:
    """Trimmed text; missing and blank become null."""
    return F.nullif(F.trim(_col(c).cast("string")), F.lit(""))


def safe_float(c: Column | str) -> Column:
    """Number, or null where the value is missing, NaN or not a number."""
    value = _col(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def _whole(c: Column | str) -> Column:
    return safe_float(c).try_cast("bigint")


def card_key(card1: Column | str) -> Column:
    return _whole(card1).cast("string")


def email_key(domain: Column | str) -> Column:
    return F.lower(safe_str(domain))


def addr_key(addr1: Column | str, addr2: Column | str) -> Column:
    """`region|country` as whole numbers (truncated toward zero), null unless both exist."""
    return F.concat(_whole(addr1).cast("string"), F.lit("|"), _whole(addr2).cast("string"))


def device_key(info: Column | str) -> Column:
    """Device name without its firmware suffix."""
    name = F.trim(F.split_part(F.trim(_col(info).cast("string")), F.lit(BUILD_MARK), F.lit(1)))
    name = F.replace(name, F.lit(TRIDENT[0]), F.lit(TRIDENT[1]))
    return F.nullif(F.substring(name, 1, KEY_LENGTH), F.lit(""))


def os_browser_key(os: Column | str, browser: Column | str) -> Column:
    """`os|browser`; a missing half gets a placeholder, two missing halves give null."""
    os, browser = safe_str(os), safe_str(browser)
    key = F.concat(
        F.coalesce(os, F.lit(UNKNOWN_OS)), F.lit("|"), F.coalesce(browser, F.lit(UNKNOWN_BROWSER))
    )
    key = F.substring(key, 1, KEY_LENGTH)
    return F.nullif(key, F.lit(f"{UNKNOWN_OS}|{UNKNOWN_BROWSER}"))


def proxy_label(c: Column | str) -> Column:
    """Proxy class, null where the lookup found none."""
    text = _col(c).cast("string")
    return F.when(~F.lower(text).isin(*NOT_A_PROXY), F.trim(text))


def has_identity(device_type: Column | str) -> Column:
    return _col(device_type).isNotNull()


def match_flag(c: Column | str) -> Column:
    """T is 1, F is 0, anything else is missing."""
    c = _col(c)
    return F.when(c == "T", F.lit(1.0)).when(c == "F", F.lit(0.0))


def time_bucket(dt: Column | str, seconds: int = DAY) -> Column:
    return F.floor(_col(dt) / F.lit(seconds)).cast("bigint")


def pct(num: Column, den: Column, digits: int) -> Column:
    """Rounded percentage, null for an empty denominator."""
    return F.round(F.lit(100.0) * num / F.nullif(den, F.lit(0)), digits)


def rate(num: Column, den: Column) -> Column:
    """Plain quotient as a double, null for an empty denominator."""
    return num.cast("double") / F.nullif(den, F.lit(0)).cast("double")


def is_fraud(c: Column | str = "isFraud") -> Column:
    """1 for a fraud label, 0 for anything else including a missing label."""
    return F.when(_col(c) == 1, F.lit(1)).otherwise(F.lit(0))
