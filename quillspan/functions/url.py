"""URL functions as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Host in lower case without a leading www."""
    return F.lower(F.regexp_replace(F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1), r"^www\.", ""))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def canonical(url: Column) -> Column:
    """Lower-case host, single slashes, no closing slash, query or fragment."""
    path = F.rtrim(F.regexp_replace(F.regexp_extract(url, "^[a-z]+://[^/?#]+([^?#]*)", 1), "/+", "/"), F.lit("/"))
    return F.concat(F.regexp_extract(url, "^([a-z]+)://", 1), F.lit("://"), F.lower(F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1)), F.when(path == "", "/").otherwise(path))
