"""Web request helpers: device class, visitor hash, referrer host, email attribution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of the user agents of robots and scripts.
ROBOTS = ["bot", "crawler", "spider", "crawling", "slurp", "facebookexternalhit", "preview", "monitor", "curl", "wget", "python-requests", "headless"]
BOTS = "(?i)" + "|".join(ROBOTS)


def device_class(ua: Column) -> Column:
    u = F.lower(ua)
    return (
        F.when(u.contains("ipad") | u.contains("tablet") | (u.contains("android") & ~u.contains("mobile")), "tablet")
        .when(u.contains("mobile") | u.contains("iphone"), "mobile")
        .when(u.contains("windows nt") | u.contains("macintosh") | u.contains("x11"), "desktop")
        .otherwise("unknown")
    )


def visitor_hash(salt: str, day: Column, ip: Column, ua: Column) -> Column:
    """First 16 hex digits of the salted daily hash."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(salt), day, ip, ua), 256), 1, 16)


def referrer_host(url: Column, own=()) -> Column:
    host = F.try_parse_url(url, F.lit("HOST"))
    return F.when(host.isNull() | host.isin(*own), "").otherwise(host) if own else F.coalesce(host, F.lit(""))


def from_own_page(origin: Column, referrer: Column, own) -> Column:
    """Whether a request comes from one of our origins: by its Origin header, or without one by its referrer."""
    parts = [F.try_parse_url(referrer, F.lit(p)) for p in ("PROTOCOL", "AUTHORITY")]
    told = F.coalesce(F.nullif(origin, F.lit("")), F.concat(parts[0], F.lit("://"), parts[1]))
    return F.coalesce(told.isin(*own), F.lit(False))


def email_attribution(url: Column):
    """(edition_day, edition_phase) of an email visit; missing unless each parameter occurs once and is valid."""
    query = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    pairs = F.split(query, "&")
    value = lambda k: F.filter(pairs, lambda p: p.startswith(k + "="))
    one = lambda k: F.when(F.size(value(k)) == 1, F.substring_index(F.get(value(k), F.lit(0)), "=", -1))
    day, phase = one("edition_day"), one("edition_phase")
    real = day.rlike(r"^(?!0000)\d{4}-\d{2}-\d{2}$") & day.try_cast("date").isNotNull()
    ok = F.coalesce((one("utm_source") == "email") & (one("utm_medium") == "report") & real & phase.isin("pre_open", "post_close"), F.lit(False))
    return F.when(ok, day), F.when(ok, phase)


def country_or_unknown(c: Column) -> Column:
    return F.when(c.rlike("^[A-Z][A-Z]$"), c).otherwise("unknown")
