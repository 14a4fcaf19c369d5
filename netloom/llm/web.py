"""Addresses and captures of web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: query parameters that only track visitors
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)"


def host(url: Column) -> Column:
    """The host of an address in lower case, without user, port and a leading www. or m."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(found, r"^.*@|:[0-9]*$", ""), r"^(www|m)\.", "")


def canonical(url: Column) -> Column:
    """An address that is the same for all spellings of one page: host as above,
    path without index file and closing slash, other than tracking parameters
    in order; scheme and fragment go. Null stays null."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"#.*$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), r"(/index\.html?|/)$", "")
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host(url), path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))
