"""The divergence audit against sums over all kept terms."""

import random
import re
from collections import Counter

import pytest

from logweir.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, value int"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(docs, least, ranks=10):
    docs = [((text or ""), (lang or ""), (source or "")) for text, lang, source in docs]
    out = set()
    for lang in {d[1] for d in docs}:
        own = [(TERM.findall(lowered(t)), s) for t, x, s in docs if x == lang]
        seen = Counter(w for terms, _ in own for w in set(terms))
        kept = sorted(w for w, n in seen.items() if n >= least)
        v = len(kept)
        counts = {s: Counter(w for terms, x in own if x == s for w in terms) for s in {s for _, s in own}}
        whole = Counter(w for terms, _ in own for w in terms)
        share = lambda c: {w: 1 + 1_000_000_000 * (c[w] + 2) // (sum(c[x] for x in kept) + 2 * v) for w in kept}
        gap = lambda p, q: (p - q) * (p - q) // (p + q)
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in counts:
            pairs = [(t, sum(gap(p[s][w], p[t][w]) for w in kept)) for t in counts if t != s]
            terms = [(w, gap(p[s][w], q[w])) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, rows in (("pair", pairs), ("term", terms)):
                rows.sort(key=lambda r: (-r[1], r[0].encode()))
                out |= {(lang, s, part, item, value, i) for i, (item, value) in enumerate(rows, 1) if part == "pair" or i <= ranks}
    return out


def told(spark, docs, **more):
    df = spark.createDataFrame([(i, *d, "x", 0) for i, d in enumerate(docs)], SCHEMA).repartition(3)
    got = divergence.audit(df, **more).collect()
    assert len(got) == len({tuple(r) for r in got})
    return {tuple(r) for r in got}


def drawn(seed, n=150):
    rnd = random.Random(seed)
    vocabulary = ["Wort", "été", "a", "B2b", "naïve", "x-y", "ÄÖ", "日本", *(f"w{chr(97 + i)}" for i in range(20))]
    docs = []
    for _ in range(n):
        source = "hot" if rnd.random() < 0.4 else rnd.choice(["s1", "s2", "s3", "é", None])
        docs.append((" ".join(rnd.choice(vocabulary[: rnd.randrange(4, 28)]) for _ in range(rnd.randrange(0, 40))), rnd.choice(["en", "de", None]), source))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_sum_over_all_terms(spark, seed):
    docs = drawn(seed)
    assert told(spark, docs) == brute(docs, 10)
    assert told(spark, docs, least=2, ranks=3) == brute(docs, 2, 3)


def test_nulls_empty_texts_and_languages_without_terms(spark):
    docs = [(None, None, None), ("", "en", "a"), ("12 34", "en", "b"), ("one", "en", "c"), ("TWO two Two", "fr", None), ("two", "fr", ""), ("two", "fr", "z")]
    assert told(spark, docs, least=2) == brute(docs, 2)
    assert told(spark, docs) == brute(docs, 10)


def test_repeated_rows_are_documents(spark):
    docs = [("same text", "en", "a")] * 10 + [("other", "en", "b")]
    assert told(spark, docs) == brute(docs, 10)


def test_a_text_in_pieces_counts_as_one_document(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 7)
    monkeypatch.setattr(divergence, "HELD", 3)
    assert [w for some in divergence.words(b"Abc dEf\xc3\xa9 g1h  ") for w in some] == [b"abc", b"def\xc3\xa9", b"g", b"h"]
    docs = [("wort " * 500 + f"x{chr(97 + i % 3)}", "de", "ab"[i % 2]) for i in range(12)]
    assert told(spark, docs) == brute(docs, 10)


def test_empty_table(spark):
    assert told(spark, []) == set()
