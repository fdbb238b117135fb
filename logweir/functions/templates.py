"""Message templates by masking, and how specific they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what is masked, in this order
MASKS = [r"\b(?:\d{1,3}\.){3}\d{1,3}\b", r"\b\d+\b", r"\b0x[0-9a-fA-F]+\b"]
WILDCARD = "<*>"
# fixed values: what the parse tree masks, in this order, and by which name
NAMED = {
    "IP": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "HEX": r"\b0x[a-fA-F0-9]+\b",
    "UUID": r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
    "NUM": r"\b\d+\b",
}


def template(text: Column) -> Column:
    out = F.regexp_replace(text, r"^\s+|\s+$", "")
    for mask in MASKS:
        out = F.regexp_replace(out, mask, WILDCARD)
    return out


def masked(text: Column) -> Column:
    """The text with masks by name, as the parse tree takes it."""
    out = F.regexp_replace(text, r"^\s+|\s+$", "")
    for name, mask in NAMED.items():
        out = F.regexp_replace(out, mask, f"<{name}>")
    return out


def specificity(pattern: Column) -> Column:
    """Share of tokens that aren't wildcards, to three places; 0 for an empty template."""
    tokens = F.filter(F.split(pattern, r"\s+"), lambda t: t != "")
    literal = F.filter(tokens, lambda t: ~(t.contains("<") & t.contains(">")))
    return F.when(F.size(tokens) > 0, F.round(F.size(literal) / F.size(tokens), 3)).otherwise(F.lit(0.0))
