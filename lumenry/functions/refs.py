"""Canonical forms of typed references (UUID text)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space of any script.
_SPACES = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def ref_key(ref: Column) -> Column:
    """Reference text without surrounding white space, braces, hyphens and case; null where it is no reference.

    Null, blank and all-zero text is no reference. Text that is no UUID keeps its folded form,
    so that it can be reported as pointing nowhere.
    """
    bare = F.lower(F.translate(F.btrim(ref, F.lit(_SPACES)), "{}-", ""))
    return F.try_element_at(F.regexp_extract_all(bare, F.lit("(?s)^(?!0*$)(.+)$"), F.lit(1)), F.lit(1))  # evaluates the text once


def is_uuid_key(key: Column) -> Column:
    """True for a key of ref_key that has the 32 hexadecimal digits of a UUID."""
    return key.rlike("^[0-9a-f]{32}$")


def uuid_text(key: Column) -> Column:
    """The canonical 8-4-4-4-12 lower-case form of a 32-digit key; other keys stay as they are."""
    parts = [F.substring(key, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(is_uuid_key(key), F.concat_ws("-", *parts)).otherwise(key)
