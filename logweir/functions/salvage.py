"""Observables in texts that nothing claims, as sorted distinct arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns of observables
OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
IPV4 = rf"\b{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}\b"
MAC = r"\b(?:[0-9A-Fa-f]{2}[:-]){5}(?:[0-9A-Fa-f]{2})\b"
URL = r"""(?i)https?://[^\s<>"'{}|\\^`]+"""
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PORT = r"(?i)\b(?:port|sport|dport|pt)[:=\s]+(\d{1,5})\b"
SHA256 = r"\b[a-fA-F0-9]{64}\b"
MD5 = r"\b[a-fA-F0-9]{32}\b"
PATTERNS = {"ip_addresses": IPV4, "mac_addresses": MAC, "urls": URL, "emails": EMAIL, "hashes_sha256": SHA256, "hashes_md5": MD5}


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """Distinct matches in order; null if there is none."""
    hits = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))))
    return F.when(F.size(hits) > 0, hits)


def ports(text: Column) -> Column:
    numbers = F.transform(F.regexp_extract_all(text, F.lit(PORT), F.lit(1)), lambda p: p.cast("int"))
    valid = F.array_sort(F.array_distinct(F.filter(numbers, lambda p: (p >= 1) & (p <= 65535))))
    return F.when(F.size(valid) > 0, valid)


def observables(text: Column) -> Column:
    """A struct of all observables; kinds that don't occur are null."""
    return F.struct(*[found(text, p).alias(k) for k, p in PATTERNS.items()], ports(text).alias("ports"))
