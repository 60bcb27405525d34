"""Keys from names of files and sessions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLIP = r"(s\d{2}e\d{2}[a-z])"


def natural_key(name: Column) -> Column:
    """An array by which names sort with their numbers in numerical order, whatever their
    length: runs of digits are, without leading zeros, behind the number of their digits;
    other runs are in lower case."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    number = lambda t: F.concat(F.lpad(F.length(t).cast("string"), 10, "0"), t)
    return F.transform(runs, lambda t: F.when(t.rlike("^[0-9]"), number(F.ltrim(t, F.lit("0")))).otherwise(t))


def clip_id(name: Column) -> Column:
    """The first clip id in a name, in lower case; null if there is none."""
    return F.nullif(F.regexp_extract(F.lower(name), CLIP, 1), F.lit(""))


def session_clip(key: Column, show: str = "friends") -> Column:
    """``<show>_<part>`` of a session key with exactly one "_task-", else null."""
    parts = F.split(key, "_task-")
    return F.when(F.size(parts) == 2, F.concat(F.lit(f"{show}_"), F.get(parts, F.lit(1))))


def of_season(key: Column, prefix: str = "task-s01") -> Column:
    return F.contains(F.lower(key), F.lit(prefix))
