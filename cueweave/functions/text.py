"""Text rules of caption files as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a cue line, a voice tag and a speaker prefix look like.
TIMING = r"(\d{2}):(\d{2}):(\d{2})[.,](\d{3})\s*-->\s*(\d{2}):(\d{2}):(\d{2})[.,](\d{3})"
VOICE = r"<v(?:\.[\w-]+)*\s+([^>]+)>"
PREFIX = r"(?U)^([A-Za-z][\w .'\-]{0,40}):\s+(.*)$"
TAG = r"<[^>]+>"
SENTENCE_END = r"[.!?]+[\"')\]]*$"


def trim_ws(c: Column) -> Column:
    """Strip Unicode white space, not only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    """Words between white space; no empty ones."""
    return F.filter(F.split(trim_ws(c), r"(?U)\s+"), lambda t: t != "")


def lines(c: Column) -> Column:
    """Lines that are not blank."""
    return F.filter(F.split(c, r"\R|[\x1c-\x1e]"), lambda t: trim_ws(t) != "")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, TAG, "")


def clock(line: Column) -> Column:
    """The eight numbers of a timing line, in order."""
    return F.regexp_extract_all(F.regexp_extract(line, TIMING, 0), F.lit(r"([0-9]+)"), 1)


def seconds(numbers: Column, first: int) -> Column:
    """The time whose hours are the number at ``first``."""
    part = [F.get(numbers, F.lit(first + i)).cast("double") for i in range(4)]
    return part[0] * 3600 + part[1] * 60 + part[2] + part[3] / F.lit(1000.0)


def ends_sentence(token: Column) -> Column:
    return token.rlike(SENTENCE_END)


def three_decimals(x: Column) -> Column:
    """A number with three decimals, rounded from its exact binary value, exact ties to even.

    The fraction times 2,000 is held exactly as the sum of two doubles (a product split by
    Veltkamp's and Dekker's method), and that sum is compared with the odd number between
    two candidates.  NaN and infinities are ``nan``, ``inf`` and ``-inf``; numbers of 2^63
    or more in size are null.
    """
    size = F.abs(x)
    whole = F.floor(size)
    part = size - whole.cast("double")
    spread = part * F.lit(134217729.0)
    high = spread - (spread - part)
    product = part * F.lit(2000.0)
    error = (high * F.lit(2000.0) - product) + (part - high) * F.lit(2000.0)
    low = F.floor(product / F.lit(2.0))
    over = (product - low.cast("double") * F.lit(2.0) - F.lit(1.0)) + error
    thousandths = low + F.when(over > 0, 1).when(over < 0, 0).otherwise(low % 2)
    carried = whole + F.floor(thousandths / 1000)
    text = F.concat(F.when(x.cast("string").startswith("-"), "-").otherwise(""), carried.cast("string"), F.lit("."), F.lpad((thousandths % 1000).cast("string"), 3, "0"))
    special = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return F.when(F.isnan(x) | (size == float("inf")), special).when(size < F.lit(2.0**63), text)
