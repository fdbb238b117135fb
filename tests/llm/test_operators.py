"""Each operator against brute force on small tables, and its defined cases: nulls, empty and long texts, ties, repeats, empty tables,
further columns."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweir.llm import exact_dedup, html_extraction, language_id, mixing, ngram_join, packing, permutation_index, quality, sharding, url_filter
from logweir.llm.queries import RULES, vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k string, t string, score double"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = "the quick brown fox jumps over lazy dogs and then some more words follow here every day at noon".split()


def words(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(LETTERS) + str(rng.integers(1000)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = words(60, 1).split()
    near = [" ".join(base[:i] + ["x"] + base[i + 1 :]) for i in range(0, 60, 9)]
    rows = [None, "", " \n ", "one", "one", "One  two", "one two", words(3000, 5), words(4, 2), words(4, 2).upper(), " ".join(base), *near]
    return [(i, t, "en" if i % 2 else None, [None, "a", "b"][i % 3], len(t or ""), "k", "t", 0.5) for i, t in enumerate(rows)] + [(3, "one", "en", "a", 3, "k", "t", 0.5)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_dedup_matches_brute_force(docs, texts, none):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t[1] or "") for t in texts]
    first = {}
    for (i, *_), n in zip(texts, norm, strict=True):
        first[n] = min(first.get(n, i), i)
    got = exact_dedup.dedup(docs).collect()
    assert len(got) == len(texts)
    expected = sorted((t[0], first[n], norm.count(n), hashlib.sha256(n.encode()).hexdigest()) for t, n in zip(texts, norm, strict=True))
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == expected
    assert sum(r["kept"] for r in got) == len(set(norm))
    assert exact_dedup.dedup(none).count() == 0
    kept = exact_dedup.kept_rows(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(norm))


def test_dedup_keeps_rows_without_ids_and_clashing_names(spark):
    rows = [(None, f"text {i % 30} " + "é" * (i % 30), i) for i in range(90)] + [(7, "text 3 ééé", 90), (7, "other", 91), (7, "text 4 " + "é" * 4, 92), (8, "z" * 300_000, 93), (9, "z" * 300_000, 94)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h long").withColumns({"_sha": F.lit(1), "row": F.lit(2), "k": F.lit(3), "n": F.col("h")})
    got = exact_dedup.dedup(df).collect()
    size = {t: sum(x[1] == t for x in rows) for _, t, _ in rows}
    assert sorted((r["text_sha256"], r["group_size"]) for r in got) == sorted((hashlib.sha256(t.encode()).hexdigest(), size[t]) for _, t, _ in rows)
    assert sum(r["kept"] for r in got) == len(size)
    assert {r["keep_id"] for r in got if r["text_sha256"] == hashlib.sha256(rows[90][1].encode()).hexdigest()} == {7}
    kept = exact_dedup.kept_rows(df)
    assert kept.columns == df.columns
    assert sorted((r["text"], r["doc_id"] or 0) for r in kept.collect()) == sorted((t, {rows[90][1]: 7, rows[92][1]: 7, "other": 7, "z" * 300_000: 8}.get(t, 0)) for t in size)


def test_dedup_tells_clashing_fingerprints_apart(docs, texts):
    weak = exact_dedup.dedup(docs, primes=(3, 2), chunk=8).collect()  # nearly all fingerprints clash
    assert sorted(map(tuple, weak)) == sorted(map(tuple, exact_dedup.dedup(docs).collect()))


def test_fingerprints_compose():
    raw = np.random.default_rng(1).integers(0, 256, 1000).astype(np.uint8)
    base, prime = exact_dedup.BASES[0], exact_dedup.PRIMES[0]
    table = exact_dedup.powers(base, prime, 64)
    whole = exact_dedup.fingerprint(raw, base, prime, table, 64)
    h = 0
    for b in raw.tolist():
        h = (h * base + b + 1) % prime
    assert h == whole
    parts = [exact_dedup.fingerprint(x, base, prime, table, 64) for x in (raw[:333], raw[333:])]
    assert exact_dedup.combine(*parts, 667, base, prime) == whole


def shingle_set(t):
    w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if s and u and 100 * len(s & u) >= 75 * len(s | u):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i, s in sets}


def test_near_duplicates_match_brute_force(spark, docs, texts, none):
    got = {tuple(r) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == brute_components([(t[0], t[1]) for t in texts])
    rng = np.random.default_rng(3)
    rows = []
    for g in range(12):  # chains of edits: members link with some of their group only
        w = words(int(rng.integers(6, 90)), 100 + g).split()
        for _ in range(int(rng.integers(1, 7))):
            w = list(w)
            for _ in range(int(rng.integers(0, 3))):
                w[int(rng.integers(len(w)))] = f"e{rng.integers(99)}"
            rows.append((len(rows), " ".join(w)))
    passage = words(60, 7).split()  # a large group of near copies, and strangers that share its shingles
    for _ in range(120):
        w = list(passage)
        w[int(rng.integers(len(w)))] = f"n{rng.integers(9)}"
        rows.append((len(rows), " ".join(w)))
    for k in range(60):
        own = [f"own{k}x{i}" for i in range(int(rng.integers(5, 40)))]
        rows.append((len(rows), " ".join(passage[: int(rng.integers(20, 60))] + own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in ngram_join.near_duplicates(df).collect()} == brute_components(rows)
    assert ngram_join.near_duplicates(none).count() == 0


def test_packing_is_whole_and_tight(spark, docs, texts, none):
    got = packing.pack(docs, vocabulary("word_bpe_49k.json"), with_ids=True).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    expected = []
    for i, t, *_ in texts:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        expected += [(i, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(expected)
    at = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0) and len(r["ids"]) == 4 * r["length"]
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 2048 and len(at) == math.ceil(sum(at.values()) / 2048)
    assert packing.pack(none, vocabulary("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_every_piece(seed):
    rng = np.random.default_rng(seed)
    counts = {int(n): int(c) for n, c in zip(rng.integers(1, 129, 60), rng.integers(1, 500, 60), strict=True)}
    planned = packing.plan(counts, 128)
    used = {}
    for config, n in planned:
        assert sum(length * a for length, a in config) <= 128
        for length, a in config:
            used[length] = used.get(length, 0) + n * a
    assert used == counts
    bound = max(sum(n * c for n, c in counts.items()) / 128, sum(c for n, c in counts.items() if n > 64))
    assert sum(n for _, n in planned) <= 1.05 * bound


def test_mixing_meets_its_targets(docs, texts, none):
    got = mixing.mix(docs, block=16, keep=["text", "source"])
    rows = got.collect()
    size = {}
    for t in texts:
        size[t[3]] = size.get(t[3], 0) + len(WORD.findall(t[1] or ""))
    assert len(rows) == len(texts)
    taken = {}
    for r in rows:
        n = len(WORD.findall(r["text"] or ""))
        assert r["size"] == n and r["source_size"] == size[r["source"]] and r["taken"] <= 2 * n
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        for s in r["spans"]:
            assert 0 <= s["start"] and s["start"] + s["words"] <= n and 0 <= s["shard"] < mixing.SHARDS
    goal = {r["source"]: r["target"] for r in rows}
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)
    assert abs(sum(goal.values()) - 1.5 * sum(size.values())) < 1e-6
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(3), block=16, keep=["text", "source"]).collect()))
    made = mixing.mixed_texts(got).collect()
    assert sum(len(WORD.findall(r["text"])) for r in made) == sum(taken.values())
    assert mixing.shard_rows(got).count() == sum(len(r["spans"]) for r in rows)
    assert mixing.mix(none).count() == 0


def test_places_are_permutations():
    for n in (1, 2, 3, 5, 64, 1000):
        for key in (0, -5, 1 << 62):
            got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(got.tolist()) == list(range(n))
    assert (mixing.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 1)) != mixing.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 2))).sum() > 900


def test_targets_share_the_excess():
    assert mixing.targets([10, 100, 0, 100], [3, 1, 2, 3], 210, 2) == [20, 47.5, 0.0, 142.5]


def test_split_is_exact():
    out = mixing.split([7, 0, 100, 3], 8)
    assert out.sum(axis=1).tolist() == [7, 0, 100, 3] and set(out.sum(axis=0).tolist()) <= {13, 14}
    assert (out == mixing.split([7, 0, 100, 3], 8)).all()


def test_sharding_is_rendezvous_by_brute_force(spark, docs):
    """Every shard's hash of the key is computed apart, as rows, and the least weighted one wins; slots are gapless."""
    weights = [1.0, 2.0, 0.0, 1.5, 1.0]
    df = docs.unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    pairs = df.select("doc_id").distinct().crossJoin(spark.range(len(weights)).withColumnRenamed("id", "i"))
    hashes = pairs.select("doc_id", "i", F.xxhash64("doc_id", F.concat(F.lit("shard-"), F.col("i"))).alias("h")).collect()
    best = {}
    for r in hashes:
        if weights[r["i"]] > 0:
            u = ((r["h"] % (1 << 64) >> 12) + 0.5) / (1 << 52)
            best[r["doc_id"]] = min(best.get(r["doc_id"], (math.inf, 0)), (-math.log(u) / weights[r["i"]], r["i"]))
    rows = sharding.shard(df, weights=weights, bucket_rows=3).collect()
    assert len(rows) == df.count() and all(r["shard"] == best[r["doc_id"]][1] for r in rows)
    text = {}
    for d in df.collect():
        text.setdefault(d["doc_id"], []).append((len((d["text"] or "").encode()) + 16, zlib.crc32((d["text"] or "").encode())))
    own = {}
    for r in rows:
        own.setdefault(r["doc_id"], []).append((r["size"], r["text_crc32"]))
    assert {k: sorted(v) for k, v in own.items()} == {k: sorted(v) for k, v in text.items()}
    for s in range(len(weights)):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_sharding_moves_only_into_the_new_shard(spark, docs, texts, none):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).unionByName(docs.select("doc_id", "text")).unionByName(spark.createDataFrame([(None, None)], "doc_id long, text string"))
    rows = sharding.shard(df, weights=[1.0] * 8, bucket_rows=50).collect()
    assert len(rows) == 4000 + len(texts) + 1
    assert all(r["grown_shard"] in (r["shard"], 8) for r in rows)
    for s in range(8):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own))) and 350 < len(own) < 700
    bigger = {r["doc_id"]: r["shard"] for r in sharding.shard(df, weights=[1.0] * 9).collect()}
    assert all(bigger[r["doc_id"]] == r["grown_shard"] for r in rows)
    heavy = sharding.shard(df, weights=[3.0, 1.0]).groupBy("shard").count().orderBy("shard").collect()
    assert 2.5 < heavy[0]["count"] / heavy[1]["count"] < 3.5
    r = next(r for r in rows if r["doc_id"] is None)
    assert (r["size"], r["text_crc32"]) == (16, 0)
    assert sharding.shard(none).count() == 0


def test_urls(spark):
    cases = {
        "http://WWW.Example.com/en/1?q": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://a.www.example.com/en/": ("a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://a.example.com/en/x": ("a.example.com", "/en/x", "example.com/en/", "block"),
        "http://notexample.com/en/x": ("notexample.com", "/en/x", "com/", "allow"),
        "http://x.net/es/#f": ("x.net", "/es/", "net/es/", "block"),
        "http://x.com": ("x.com", "", None, "allow"),
        "https://big-casino.org/a": ("big-casino.org", "/a", None, "block"),
        "https://casinos.org/a": ("casinos.org", "/a", None, "allow"),
        "https://free-free.org/": ("free-free.org", "/", None, "allow"),
        "https://free-bets.org/": ("free-bets.org", "/", None, "block"),
        "nothing": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(cases)], "page_id long, url string, host string, k string")
    got = url_filter.judge(df, rules=RULES).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == list(cases.values())
    assert url_filter.judge(df.limit(0)).count() == 0


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:140] = x[99]  # ties
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000, None, 1), (1020, [0.0] * 16, 1), (1040, [float("nan")] * 16, 1), (1060, [1.0], 1), (1080, [None] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    run = lambda **k: permutation_index.search(df, F.col("vec_id") % 20 == 0, **k).collect()
    score = x.astype(float) @ x.astype(float).T
    for got, least in ((run(least=40, share=0.1, index_block=200, query_block=10), 0.9), (run(share=1.0, index_block=150), 1.0)):
        assert {r["query_id"] for r in got} == set(range(0, 600, 20))
        hit = 0
        for q in range(0, 600, 20):
            own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
            assert [r["rank"] for r in own] == list(range(1, 21))
            best = sorted((i for i in range(600) if i != q), key=lambda i: (-(x[i].astype(float) * x[q].astype(float)).sum(), i))[:20]
            hit += len({r["vec_id"] for r in own} & set(best))
            assert all(abs(r["score"] - score[q, r["vec_id"]]) < 1e-9 for r in own)
            if least == 1.0:
                assert [r["vec_id"] for r in own] == best
        assert hit >= least * 600
    assert permutation_index.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_languages(spark, none):
    en, de = "the river flows through green valleys and old towns", "der fluss strömt durch grüne täler und alte städte über"
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice((en if i % 2 else de).split(), 12)), ("en" if i % 2 else "de")) for i in range(80)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    test = spark.createDataFrame([(1, "green towns", None, 1), (2, "grüne städte", None, 1), (3, None, None, 1), (4, "12 ?!", None, 1), (5, "the old river " * 5000, None, 1)], "doc_id long, text string, lang string, score int")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(test, train).collect()}
    assert [got[i][0] for i in range(1, 6)] == ["en", "de", "und", "und", "en"] and got[3][1] == 0
    assert all(0 <= s <= 1 for _, s in got.values())
    assert {r["lang_pred"] for r in language_id.identify(test, train.limit(0)).collect()} == {"und"}
    assert language_id.identify(none).count() == 0


def test_automaton_holds_all_substrings():
    text = b"abracadabra"
    edges = language_id.suffix_automaton(text)

    def has(s):
        at = 0
        for c in s:
            if c not in edges[at]:
                return False
            at = edges[at][c]
        return True

    subs = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    assert all(has(s) for s in subs) and not any(has(s) for s in (b"aa", b"cb", b"abrad"))


def test_phrases_are_longest_matches():
    parser = language_id.Parser({"x": b"abcabcd", "y": b"zz"})
    raw = np.frombuffer(b"abcdabz", np.uint8)
    assert parser.phrases(raw, np.array([0, 7, 7])).tolist() == [[3, 7], [0, 0]]


def test_phrases_go_over_blocks_and_pieces():
    rng = np.random.default_rng(5)
    some = lambda letters, n: rng.choice(np.frombuffer(letters, np.uint8), n).tobytes()
    training = {"x": some(b"abc ", 300), "y": some(b"abd ", 300)}
    parser = language_id.Parser(training)
    texts = [some(b"abcdz ", n) for n in (0, 1, 255, 256, 257, 3000, 5)]

    def naive(text, known):
        at = count = 0
        while at < len(text):
            n = 1
            while at + n < len(text) and text[at : at + n + 1] in known:
                n += 1
            at, count = at + n, count + 1
        return count

    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    expected = [[naive(t, training[name]) for name in parser.names] for t in texts]
    assert parser.phrases(np.frombuffer(b"".join(texts), np.uint8), off).tolist() == expected
    long = np.frombuffer(texts[5], np.uint8)
    assert parser.phrases(long, np.array([0, len(long)]), piece=700).tolist() == [expected[5]]


def test_quality_learns_and_handles_odd_texts(spark, none):
    rng = np.random.default_rng(4)
    good = lambda i: " ".join(rng.choice(LETTERS, 40)) + "."
    bad = lambda i: " | ".join(w.upper() + "!!" for w in rng.choice(LETTERS, 40))
    rows = [(i, good(i) if i % 2 else bad(i), 7) for i in range(160)] + [(1000, None, 7), (1001, "", 7), (1002, good(0) * 300, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)] + [(5000, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(df, labels).collect()}
    assert len(got) == 163 and all(0 <= r["score"] <= 1 for r in got.values())
    assert np.mean([got[i]["predicted"] == i % 2 for i in range(100, 160)]) > 0.95 and got[1002]["predicted"] == 1
    assert got[1000]["score"] == got[1001]["score"]
    assert {r["score"] for r in quality.classify(df, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(none, labels).count() == 0


def test_gradient_of_the_attention_model():
    rng = np.random.default_rng(0)
    model = quality.Model.start(rng)
    for name, value in vars(model).items():
        setattr(model, name, value.astype(np.float64))
    x, size, y = rng.random((7, quality.FEATURES)), np.array([3, 4]), np.array([1.0, 0.0])

    def loss():
        p = model.forward(x, size)[0]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for p, g in zip(model.parts(), model.gradient(x, size, y, np.ones(2)), strict=True):
        at = tuple(0 for _ in p.shape)
        keep = p[at]
        p[at] = keep + 1e-5
        up = loss()
        p[at] = keep - 1e-5
        down = loss()
        p[at] = keep
        assert abs((up - down) / 2e-5 - g[at]) < 1e-5


def test_pages(spark):
    page = '<html><head><title>T</title><style>x</style><script>var a="</p>";</script></head><body><header>H</header><nav><ul><li>Menu</li></ul></nav><!-- c <p>no</p> --><div class="ad">Buy</div>{}<form>f</form><aside>s</aside><div id="comments"><p>me too</p></div><footer>&copy; x</footer></body></html>'
    body = "<article><h1>A &amp; B</h1><p>one\n  two<br>three <b>bold</b></p><p>same</p><p>same</p><div class='share'>Share</div></article>"
    plain = "<div class='box'><p>Text {} of a page</p></div><div class='box2'><p>Every page has this</p></div>"
    rows = [(1, "http://a.org/1", page.format(body)), (2, "http://a.org/2", None), (3, None, ""), (4, "x", "no <b>tags"), (5, "http://a.org/5", "<article>open <p>end"), *[(10 + i, f"http://b.org/{i}", page.format(plain.format(i))) for i in range(4)], (20, "http://c.org", "<!-- never closed <p>x"), (1, "http://a.org/1", page.format(body))]
    got = {r["page_id"]: r for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "A & B\n\none two three bold\n\nsame\n\nsame" and got[1]["n_chars"] == len(got[1]["text"])
    assert [got[i]["text"] for i in (2, 3, 4, 5, 20)] == ["", "", "no tags", "open\n\nend", ""]
    assert got[12]["text"] == "Text 2 of a page"
    assert html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def extracted(spark, rows):
    return {r["page_id"]: r["text"] for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_repeated_text_is_template_only_with_evidence(spark):
    page = "<html><body><div class='box'><p>{}</p></div></body></html>"
    copies = [(i, f"http://copies.org/{i}", page.format("the same page")) for i in range(2)]
    group = [(10 + i, f"http://group.org/{i}", page.format("hot copy" if i < 6 else f"own text {i}")) for i in range(8)]
    shared = [(20 + i, f"http://shared.org/{i}", page.format(f"shared words</p><p>own {i}")) for i in range(2)]
    hostless = [(30 + i, None, page.format(f"nobody's words</p><p>own {i}")) for i in range(4)]
    # on five of six pages, so not in its container's class; the last line is on each page
    partly = [(40 + i, f"http://partly.org/{i}", page.format(f"own {i}" + ("</p><p>often" if i else "") + "</p><p>each page has this")) for i in range(6)]
    got = extracted(spark, copies + group + shared + hostless + partly)
    assert [got[i] for i in range(2)] == ["the same page"] * 2
    assert [got[10 + i] for i in range(8)] == ["hot copy"] * 6 + ["own text 6", "own text 7"]
    assert [got[20 + i] for i in range(2)] == [f"shared words\n\nown {i}" for i in range(2)]
    assert [got[30 + i] for i in range(4)] == [f"nobody's words\n\nown {i}" for i in range(4)]
    assert [got[40 + i] for i in range(6)] == ["own 0", *[f"own {i}\n\noften" for i in range(1, 6)]]


def test_boilerplate_words_need_containers_that_close(spark):
    body = "<html><body{}>{}</body></html>"
    article, comment = "<article><p>Text</p></article>", "<section id='comments'><article class='comment'><p>me too</p></article></section>"
    pages = [
        body.format("", "<div class='ad'>Buy<br>" + article),
        body.format("", "<nav><ul><li>Menu</li></ul>" + article),
        body.format("", "<form action='/'><nav>Menu</nav>" + article + comment + "</form>"),
        body.format(" class='has-sidebar header'", "<nav>Menu</nav><p>Text</p>"),
        body.format("", "<form action='/'><nav>Menu</nav><p>Text</p></form>"),
        body.format("", "<div class='social'>" + article + "</div><nav>Menu</nav>"),
        body.format("", "<div class='social'>" + article + "</div><p>More</p>"),
        body.format("", "<nav>Menu</nav>" + article + comment),
        body.format("", "<nav>Menu<p>Text</p>"),
        body.format("", "<nav>Menu</nav><form>f</form>"),
    ]
    # the box is within a container that never closes, so it is in no class that nests
    loose = [(20 + i, f"http://loose.org/{i}", body.format("", f"<div class='outer'><div class='box'><p>same</p></div><p>own {i}</p>")) for i in range(4)]
    firm = [(30 + i, f"http://firm.org/{i}", f"<html><body><div class='outer'><div class='box'><p>same</p></div><p>own {i}</p></div>") for i in range(4)]
    got = extracted(spark, [(i, f"http://h{i}.org/", p) for i, p in enumerate(pages)] + loose + firm)
    assert [got[i] for i in range(len(pages))] == ["Text"] * 6 + ["Text\n\nMore", "Text", "Menu\n\nText", ""]
    assert [got[20 + i] for i in range(4)] == [f"same\n\nown {i}" for i in range(4)]
    assert [got[30 + i] for i in range(4)] == [f"own {i}" for i in range(4)]


def test_samples_count_distinct_texts(spark):
    hot = [(f"word{c} " + "abc" * 3, c) for c in "abcdef" for _ in range(300)]
    rows = [(i, t, lang) for i, (t, lang) in enumerate(hot + [(f"{c}{d} few others", c) for c in "abcdef" for d in "uvw"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.sample(df, "text", "lang", 4, 1000)
    assert sorted(got) == list("abcdef") and all(len(t.split()) == 2 + 3 * 3 for t in got.values())
    assert sorted(language_id.sample(df, "text", "lang", 0, 1000)) == list("abcdef")  # one text at least
    labels = df.selectExpr("doc_id", "cast(lang < 'd' as int) quality")
    bags, y = quality.training(df, labels, "doc_id", "text", "quality", 12, 1000)
    assert len(bags) == 24 and sum(y) == 12


def test_pipeline_stages(spark, docs, none):
    import corpus_pipeline as p

    rows, sizes = docs, []
    for name, stage in p.STAGES[:-1]:
        rows = spark.createDataFrame(stage(spark, rows.withColumn("extra", F.lit(1)), "").collect(), rows.select(*p.COLUMNS).schema)
        assert rows.columns == p.COLUMNS, name
        sizes.append(rows.count())
    assert sizes[0] == docs.where("text rlike '[a-zA-Z]'").count()
    found = brute_components([(r["doc_id"], r["text"]) for r in docs.where("text rlike '[a-zA-Z]'").dropDuplicates(["doc_id"]).collect()])
    assert sizes[2] == len({c for _, _, c in found})
    assert p.STAGES[-1][1](spark, rows, "").count() >= rows.count()
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, none, "").count() == 0


def test_registry_names_eleven_queries():
    import inspect

    from logweir.llm.queries import oracle_sql, queries

    known = queries()
    assert sorted(known) == sorted([*(f.__name__ for f in __import__("logweir.llm.queries", fromlist=["NUMBERED"]).NUMBERED), "pipeline"]) and len(known) == 11
    assert all(len(inspect.signature(f).parameters) == 2 for f in known.values()) and set(oracle_sql()) <= set(known)


def test_long_texts_are_tokenized_in_slices(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "SLICE", 16)
    path = vocabulary("word_bpe_49k.json")
    own, plain = packing.WordTokens(path), Tokenizer.from_file(path)
    for text in ("It's a long été text, with  spaces\n and 3.14 numbers " * 9, "odd 日本 text <|x|> with\tmarks " * 9, "unbroken" * 40, " " * 100):
        assert np.frombuffer(next(own.ids([text])), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
