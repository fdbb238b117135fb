"""Decoders: a text column becomes a map of its fields, or null if the format doesn't fit. All but XML are Catalyst expressions."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

# fixed values: the formats' patterns
RFC3164 = r"^<(?P<pri>\d{1,3})>(?P<timestamp>[A-Z][a-z]{2}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(?P<hostname>[^\s:]+)\s+(?P<app>[^\[:\s]+)(?:\[(?P<pid>\d+)\])?:\s*(?P<message>.*)$"
RFC5424 = r"^<(?P<pri>\d{1,3})>1\s+(?P<timestamp>[^\s]+)\s+(?P<hostname>[^\s]+)\s+(?P<app>[^\s]+)\s+(?P<procid>[^\s]+)\s+(?P<msgid>[^\s]+)\s+(?P<sd>-|\[.*?\])(?:\s+(?P<message>.*))?$"
CEF = r"^CEF:(?P<cef_version>\d+)\|(?P<device_vendor>[^|]*)\|(?P<device_product>[^|]*)\|(?P<device_version>[^|]*)\|(?P<device_event_class_id>[^|]*)\|(?P<name>[^|]*)\|(?P<severity>[^|]*)(?:\|(?P<extension>.*))?$"
LEEF = r"^LEEF:(?P<leef_version>[^|]+)\|(?P<vendor>[^|]*)\|(?P<product>[^|]*)\|(?P<version>[^|]*)\|(?P<event_id>[^|]*)\|(?P<extension>.*)$"
KEY_VALUE = r"""([a-zA-Z0-9_\.\-]+)=("[^"]*"|'[^']*'|[^\|\s,;]+)"""

#: Stand between and before the groups of a match; no log line holds them in this order.
BETWEEN, BEFORE = "\x1e\x01", "\x1e\x02"
STRINGS = "map<string,string>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once however often it is used; plans stay small where decoders nest."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def groups(text: Column, pattern: str) -> Column:
    """Named groups of the first match as a map (null: no match; a group that took no part is null).

    The match runs once: it is replaced by all groups in a row, and that text is split. An empty group counts as absent if the pattern
    makes it optional.
    """
    known = re.compile(pattern).groupindex
    java = re.sub(r"\(\?P<(\w+)>", "(", pattern)
    whole = f"(?s:^.*?){java}(?s:.*)$" if not java.startswith("^") else f"{java}(?s:.*)$" if not java.endswith("$") else java
    joined = F.regexp_replace(text, whole, BEFORE + BETWEEN.join(f"${i}" for i in known.values()))
    optional = [i for i, name in enumerate(known) if re.search(rf"\(\?:(?:(?!\(\?P<).)*\(\?P<{name}>(?:[^()]|\([^()]*\))*\)(?:[^()])*\)\?", pattern)]
    names = F.array(*map(F.lit, known))

    def split(row: Column) -> Column:
        parts = F.split(F.substring(row, len(BEFORE) + 1, 1 << 30), BETWEEN)
        if optional:
            parts = F.transform(parts, lambda v, i: F.when((v != "") | ~i.isin(optional), v))
        return F.when(row.startswith(BEFORE), F.map_from_arrays(names, parts))

    return let(joined, split)


def last_wins(keys: Column, values: Column) -> Column:
    """A map of parallel arrays in which later values of a key replace earlier ones."""
    def made(p: Column) -> Column:
        back = F.reverse(p["k"])
        last = lambda k: F.element_at(p["v"], (F.size(p["v"]) - F.array_position(back, k) + 1).cast("int"))
        return let(F.array_distinct(p["k"]), lambda own: F.map_from_arrays(own, F.transform(own, last)))

    return let(F.struct(keys.alias("k"), values.alias("v")), made)


def with_entries(fields: Column, names: Sequence[str], values: Sequence[Column]) -> Column:
    return F.when(fields.isNotNull(), F.map_concat(fields, F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*values))))


def syslog(pattern: str) -> Callable[[Column], Column]:
    def decode(text: Column) -> Column:
        pri = lambda fields: F.element_at(fields, "pri").cast("int")
        return let(groups(stripped(text), pattern), lambda f: with_entries(f, ["facility", "severity"], [F.shiftright(pri(f), 3).cast("string"), pri(f).bitwiseAND(F.lit(7)).cast("string")]))

    return decode


rfc3164, rfc5424 = syslog(RFC3164), syslog(RFC5424)


def unquoted(value: Column) -> Column:
    quoted = (value.startswith('"') & value.endswith('"')) | (value.startswith("'") & value.endswith("'"))
    return F.when(quoted & (F.length(value) >= 2), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def pairs(text: Column) -> Column:
    """All key=value pairs, quotes stripped; null if there is none."""
    keys = F.regexp_extract_all(text, F.lit(KEY_VALUE), F.lit(1))
    values = F.transform(F.regexp_extract_all(text, F.lit(KEY_VALUE), F.lit(2)), unquoted)
    return let(last_wins(keys, values), lambda m: F.when(F.size(m) > 0, m))


def keyvalue(text: Column) -> Column:
    """Pairs, if there are two keys at least."""
    return let(pairs(text), lambda m: F.when(F.size(m) >= 2, m))


def csv(text: Column, delimiter: str = ",", headers: Sequence[str] | None = None) -> Column:
    """Fields of a line by RFC 4180, named col_0, col_1, ... or by headers (the shorter of both decides)."""
    d = re.escape(delimiter)
    line = F.concat(F.lit(delimiter), stripped(text))
    cells = F.regexp_extract_all(line, F.lit(rf'{d}("(?:[^"]|"")*"[^{d}]*|[^{d}]*)'), F.lit(1))
    plain = F.transform(cells, lambda c: F.when(c.startswith('"'), F.regexp_replace(F.regexp_replace(c, r'^"((?:[^"]|"")*)"', "$1"), '""', '"')).otherwise(c))

    def named(row: Column) -> Column:
        if headers:
            n = F.least(F.size(row), F.lit(len(headers)))
            return F.map_from_arrays(F.slice(F.array(*map(F.lit, headers)), F.lit(1), n), F.slice(row, F.lit(1), n))
        return F.map_from_arrays(F.transform(row, lambda c, i: F.concat(F.lit("col_"), i.cast("string"))), row)

    return F.when(F.length(stripped(text)) > 0, let(plain, named))


def from_mark(text: Column, mark: str) -> Column:
    """The text from a format's mark on, which a syslog header may precede."""
    return let(stripped(text), lambda own: F.when(F.instr(own, mark) > 0, F.substring(own, F.instr(own, mark), F.length(own))))


def with_extension(fields: Column, decode: Callable[[Column], Column]) -> Column:
    """The header fields; the extension's pairs as JSON text under "extension", if they can be read."""

    def joined(f: Column) -> Column:
        head = F.map_filter(f, lambda k, v: k != "extension")
        return let(F.to_json(decode(F.element_at(f, "extension"))), lambda ext: F.when(ext.isNotNull(), F.map_concat(head, F.create_map(F.lit("extension"), ext))).otherwise(head))

    return let(fields, joined)


def cef(text: Column) -> Column:
    return with_extension(groups(from_mark(text, "CEF:"), CEF), keyvalue)


def leef(text: Column) -> Column:
    return with_extension(groups(from_mark(text, "LEEF:"), LEEF), pairs)


def embedded(text: Column, first: str, last: str) -> Column:
    """The text from the first to the last bracket."""
    def cut(own: Column) -> Column:
        start, end = F.instr(own, first), F.length(own) - F.instr(F.reverse(own), last) + 1
        return F.when((start > 0) & (F.instr(own, last) > 0) & (end > start), F.substring(own, start, end - start + 1))

    return let(stripped(text), cut)


def json_object(text: Column) -> Column:
    """Top-level members; nested ones stay JSON text; of equal keys the last counts."""
    def single(m: Column) -> Column:
        keys = F.map_keys(m)  # from_json keeps every member
        return F.when(F.size(F.array_distinct(keys)) < F.size(keys), last_wins(keys, F.map_values(m))).otherwise(m)

    return let(F.from_json(embedded(text, "{", "}"), STRINGS), single)


def xml_json(text: str | None) -> str | None:
    """JSON text of one member, the root element; null if the text isn't XML.

    Elements are shaped as they close, when all their children are known by tag: text alone stands for itself (attributes are dropped);
    otherwise a member for each tag, a list where it repeats, then #text and the attributes as @name. Namespaces are dropped.
    """
    if not text:
        return None
    reader = ElementTree.XMLPullParser(("start", "end"))
    levels: list[dict[str, list]] = [{}]
    try:
        reader.feed(text)
        reader.close()
        for event, node in reader.read_events():
            if event == "start":
                levels.append({})
                continue
            below, said = levels.pop(), (node.text or "").strip()
            if below or not said:
                value = {tag: found if len(found) > 1 else found[0] for tag, found in below.items()}
                value.update({"#text": said} if said else {})
                value.update(("@" + name, v) for name, v in node.attrib.items())
            else:
                value = said
            levels[-1].setdefault(node.tag.rpartition("}")[2], []).append(value)
            node.clear()
    except ElementTree.ParseError:
        return None
    return json.dumps({tag: found[0] for tag, found in levels[0].items()}, ensure_ascii=False)


@pandas_udf(T.StringType())
def xml_text(text: pd.Series) -> pd.Series:
    return text.map(xml_json)


def xml(text: Column) -> Column:
    """The root element as a map of one member with JSON text; the only decoder in Python (Arrow batches)."""
    return F.from_json(xml_text(embedded(text, "<", ">")), STRINGS)


DECODERS: dict[str, Callable[[Column], Column]] = {"syslog_rfc3164": rfc3164, "syslog_rfc5424": rfc5424, "keyvalue": keyvalue, "csv": csv, "cef": cef, "leef": leef, "json": json_object, "xml": xml}
