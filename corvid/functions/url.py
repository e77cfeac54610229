"""URLs by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HTTP = r"(?i)^(https?)://([^/?#]*)([^?#]*).*$"


def canonical_url(u: Column) -> Column:
    """http(s) only: scheme and host in lower case without www., no trailing slash (the root keeps its own), no query or fragment; others unchanged."""
    host = F.regexp_replace(F.lower(F.regexp_extract(u, _HTTP, 2)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(u, _HTTP, 3), "/+$", "")
    return F.when(u.rlike(r"(?i)^https?://[^/?#]"), F.concat(F.lower(F.regexp_extract(u, _HTTP, 1)), F.lit("://"), host, F.when(path == "", "/").otherwise(path))).otherwise(u)


def canonical_host(u: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(u, _HTTP, 2)), r"^www\.", "")


def without_dots(path: Column) -> Column:
    """A rooted path whose segments "." are gone and whose ".." took the segment before with them, but not the root."""
    step = lambda kept, s: F.when(s == ".", kept).when(s == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(s)))
    kept = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.regexp_replace(F.array_join(kept, "/"), "^/+", ""))).otherwise(path)


def resolve_url(base: Column, href: Column) -> Column:
    """An absolute or rooted link, or one beside the base's last segment, without dot segments, in canonical form with the base's scheme. A bare query or fragment, or nothing, is the base itself; other schemes are empty. Paths of absolute links stay as they are."""
    scheme, root = F.lower(F.regexp_extract(base, _HTTP, 1)), F.regexp_extract(base, r"(?i)^(https?://[^/?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_replace(F.regexp_extract(base, _HTTP, 3), "[^/]*$", ""), F.lit("")), F.lit("/"))
    path = F.regexp_extract(href, "^[^?#]*", 0)
    full = (
        F.when(href.rlike("(?i)^https?://"), href)
        .when(href.rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.lit(""))
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, without_dots(path)))
        .when((href == "") | href.rlike("^[?#]"), base)
        .otherwise(F.concat(root, without_dots(F.concat(folder, path))))
    )
    return F.when(full == "", "").otherwise(F.regexp_replace(canonical_url(full), "^https?", scheme))


def is_internal(base: Column, url: Column) -> Column:
    return url.rlike("(?i)^https?://") & (canonical_host(base) == canonical_host(url))
