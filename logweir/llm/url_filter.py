"""URL filter: site rules first, then a weighted vocabulary found by an Aho-Corasick automaton.

A term counts where neither neighbour is an ASCII letter or digit. A url is blocked if one strict term or several distinct soft terms
(their weights summing to the limit) occur in it. Site rules have a host and a path: a rule fits its host and all subdomains if the
url's path starts with the rule's; of the rules that fit, the one longest as written wins (ties: the longer host).

Defined cases: a null url, or one without "://", has an empty host and path, fits no rule and is judged by its vocabulary alone (null:
allow). Repeated rows are judged alike; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

# fixed values: the vocabulary
STRICT_TERMS = "adult casino porn porno xxx viagra cialis spam phishing malware warez escort nsfw hentai sportsbook ransomware".split()
SOFT_TERMS = "ads adserver banner bet bets betting bonus cheap click crack deal deals farm free jackpot loan loans lottery pill pills poker popup promo slots sponsored torrent track tracker tracking win winner".split()
STRICT_WEIGHT, SOFT_WEIGHT, LIMIT = 2.0, 1.0, 2.0

#: (host, path, verdict)
Rule = tuple[str, str, str]
SPLIT = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host after the first "://", A-Z lower-cased; path from there to a ? or #."""
    found = SPLIT.search(url or "")
    return (found[1].translate(LOWER), found[2]) if found else ("", "")


def matching_rule(host: str, path: str, rules: Mapping[str, list[tuple[str, str]]]) -> tuple[str, str] | None:
    """(rule as written, verdict) of the longest fitting rule: a lookup for each suffix of the host's labels."""
    best, rest = None, host
    while rest:
        for prefix, verdict in rules.get(rest, ()):
            if path.startswith(prefix) and (best is None or len(rest) + len(prefix) > len(best[0])):
                best = (rest + prefix, verdict)
        rest = rest.partition(".")[2]
    return best


def automaton(weights: Mapping[str, float]):
    """The Aho-Corasick automaton of the terms."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for term in weights:
        out.add_word(term, term)
    out.make_automaton()
    return out


def hits(text: str, machine) -> set[str]:
    """Distinct terms in text that stand between boundaries."""
    found, last = set(), len(text) - 1
    for end, term in machine.iter(text):
        start = end - len(term) + 1
        if (start == 0 or not (text[start - 1].isascii() and text[start - 1].isalnum())) and (end == last or not (text[end + 1].isascii() and text[end + 1].isalnum())):
            found.add(term)
    return found


def judge(df: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[Rule] = (), strict: Sequence[str] = STRICT_TERMS, soft: Sequence[str] = SOFT_TERMS, limit: float = LIMIT) -> DataFrame:
    """One row per row of df: key, host, path, rule, verdict, strict_hits, soft_hits, weight."""
    by_host: dict[str, list[tuple[str, str]]] = {}
    for host, path, verdict in rules:
        by_host.setdefault(host.translate(LOWER), []).append((path, verdict))
    weights = {**dict.fromkeys(soft, SOFT_WEIGHT), **dict.fromkeys(strict, max(STRICT_WEIGHT, limit))}
    hard = set(strict)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(weights) if weights else None
        for b in batches:
            rows = []
            for u in b.column(1).to_pylist():
                host, path = split_url(u)
                fits = matching_rule(host, path, by_host)
                found = hits((u or "").translate(LOWER), machine) if machine else set()
                weight = sum(weights[t] for t in found)
                rows.append((host, path, fits and fits[0], fits[1] if fits else "block" if weight >= limit else "allow", len(found & hard), len(found - hard), weight))
            kinds = [pa.string()] * 4 + [pa.int32(), pa.int32(), pa.float64()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True))], names=["k", "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "weight"])

    source = df.selectExpr(f"`{key}` as k", f"`{url}` as u")
    out = source.mapInArrow(judged, f"k {dict(source.dtypes)['k']}, host string, path string, rule string, verdict string, strict_hits int, soft_hits int, weight double")
    return out.withColumnRenamed("k", key)
