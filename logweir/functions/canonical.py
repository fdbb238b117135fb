"""Canonical JSON and digests."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

def canonical(text: Column) -> Column:
    """JSON text with sorted keys and without spaces; null if it isn't JSON. Meant for strings, integers, booleans and nesting."""
    return F.to_json(F.try_parse_json(text))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def without(text: Column, member: str, value: Column) -> Column:
    """Canonical JSON text without a string member of known value (quotes inside of strings are escaped, so nothing else matches)."""
    own = F.concat(F.lit(f'"{member}":"'), value, F.lit('"'))
    return F.replace(F.replace(text, F.concat(own, F.lit(","))), F.concat(F.lit(","), own))
