"""Field inference: unknown keys are matched with canonical fields by similarity, keywords and value types, then routed by confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decoders
from ..functions.decoders import let
from ..functions.lookups import AUTO, REVIEW, catalogue

DIMENSIONS = 384
# fixed values: value patterns and word lists of the type rules
IPV4 = r"^(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)(?:\.(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)){3}$"
MAC = r"^(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$"
URL = r"(?i)^https?://"
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
ISO_TIME = r"^\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}"
BOOLEANS = ["true", "false", "0", "1", "yes", "no"]
VERDICTS = ["allow", "deny", "drop", "reject", "pass", "block", "success", "failed", "info", "warn", "error"]
LIFTED, STRICT = ["ip", "port", "mac", "url", "timestamp"], ["ip", "port", "mac"]


def value_type(key: Column, samples: Column) -> Column:
    """Semantic type of a key by its first five non-blank samples, or by its name if there are none."""
    low = F.lower(key)
    named = lambda *words: F.greatest(*[low.contains(w) for w in words], F.lit(False))
    by_name = F.when(named("ip"), "ip").when(named("port"), "port").when(named("time", "date"), "timestamp").otherwise("string")

    def typed(some: Column) -> Column:
        whole = lambda test: F.forall(some, test)
        part = lambda test: F.exists(some, test)
        return (
        F.when(F.coalesce(F.size(some), F.lit(0)) <= 0, by_name)
        .when(whole(lambda s: s.rlike(IPV4)), "ip")
        .when(whole(lambda s: s.rlike(r"^\d+$") & F.coalesce(s.try_cast("long").between(1, 65535), F.lit(False))) & named("port", "pt"), "port")
        .when(whole(lambda s: s.rlike(MAC)), "mac")
        .when(part(lambda s: s.rlike(URL)), "url")
        .when(part(lambda s: s.rlike(EMAIL)), "email")
        .when(whole(lambda s: F.lower(s).isin(BOOLEANS)), "bool")
        .when(part(lambda s: s.rlike(ISO_TIME)) | named("time", "date"), "timestamp")
        .when(whole(lambda s: F.lower(s).isin(VERDICTS)), "enum")
        .otherwise("string")
        )

    return let(F.slice(F.filter(F.transform(samples, lambda s: F.trim(s)), lambda s: s != ""), 1, 5), typed)


def embed(text: Column) -> Column:
    """Sparse unit vector (bucket -> weight) of hashed tokens (1 each) and their letter triples (1/2 each)."""
    slot = lambda t: F.pmod(F.xxhash64(t), F.lit(DIMENSIONS)).cast("int")
    triples = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, F.lit(3)))
    pieces = lambda ts: F.struct(F.transform(ts, slot).alias("one"), F.transform(F.flatten(F.transform(F.filter(ts, lambda t: F.length(t) >= 3), triples)), slot).alias("half"))

    def weighed(p: Column) -> Column:
        weight = lambda k: F.size(F.filter(p["one"], lambda x: x == k)) + F.size(F.filter(p["half"], lambda x: x == k)) * 0.5
        return let(F.array_distinct(F.concat(p["one"], p["half"])), lambda keys: F.struct(keys.alias("keys"), F.transform(keys, weight).alias("weights")))

    def unit(v: Column) -> Column:
        return let(F.sqrt(F.aggregate(v["weights"], F.lit(0.0), lambda a, w: a + w * w)), lambda norm: F.map_from_arrays(v["keys"], F.transform(v["weights"], lambda w: w / norm)))

    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[a-zA-Z0-9_]+"), F.lit(0))
    return let(let(let(tokens, pieces), weighed), unit)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two sparse unit vectors."""
    return F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0)))


def match(keys: DataFrame, top: int = 3) -> DataFrame:
    """Best canonical field of each distinct (key, samples, vendor).

    Returns key, samples, vendor, inferred_type, confidence, decision, target_field, top_candidates. Every key meets the catalogue's 15
    rows, which are broadcast; no two keys meet.
    """
    spark = keys.sparkSession
    fields = catalogue(spark)
    fields = fields.withColumn("c_vector", embed(F.concat_ws(" | ", "field", F.concat(F.lit("keywords: "), F.array_join("keywords", ",")), F.concat(F.lit("type: "), F.col("type")), "description")))
    hint = F.when(F.col("vendor").isNotNull(), F.concat(F.lit(" | vendor: "), F.col("vendor"))).otherwise("")
    asked = keys.withColumn("inferred_type", value_type(F.col("key"), F.col("samples")))
    asked = asked.withColumn("q_vector", embed(F.concat(F.col("key"), F.lit(" | samples: "), F.array_join(F.slice("samples", 1, 5), ","), F.lit(" | type: "), F.col("inferred_type"), hint)))
    low = F.replace(F.lower(F.col("key")), F.lit("-"), F.lit("_"))
    score = cosine(F.col("q_vector"), F.col("c_vector"))
    exact = F.array_contains(F.col("keywords"), low) | (low == F.element_at(F.split("field", r"\."), -1))
    score = F.when(exact, F.greatest(score, F.lit(0.94))).when(F.exists("keywords", lambda k: low.contains(k)), F.greatest(score, F.lit(0.72))).otherwise(score)
    same = F.col("type") == F.col("inferred_type")
    score = F.when(same & F.col("inferred_type").isin(LIFTED), F.least(F.lit(1.0), score + 0.15)).when(~same & F.col("inferred_type").isin(STRICT), F.greatest(F.lit(0.0), score - 0.40)).otherwise(score)
    scored = asked.join(F.broadcast(fields), F.lit(True)).withColumn("score", F.round(score, 4))
    order = F.struct((-F.col("score")).alias("s"), "place", "field", "score")
    best = scored.groupBy("key", "samples", "vendor", "inferred_type").agg(F.slice(F.array_sort(F.collect_list(order)), 1, top).alias("best"))  # 15 entries
    first = F.col("best")[0]
    custom = F.concat(F.lit("custom."), F.coalesce(F.lower("vendor"), F.lit("unknown")), F.lit("."), low)
    return best.select(
        "key", "samples", "vendor", "inferred_type",
        first["score"].alias("confidence"),
        F.when(first["score"] >= AUTO, "AUTO_MAP").when(first["score"] >= REVIEW, "HUMAN_REVIEW").otherwise("CUSTOM_FALLBACK").alias("decision"),
        F.when(first["score"] >= REVIEW, first["field"]).otherwise(custom).alias("target_field"),
        F.transform("best", lambda b: F.struct(b["field"].alias("field"), b["score"].alias("score"))).alias("top_candidates"),
    )


def candidates(text: Column) -> Column:
    """Keys and values of an unclaimed text: its JSON members, else its pairs."""
    return F.coalesce(decoders.json_object(text), decoders.keyvalue(text))


def infer(df: DataFrame, id_column: str = "event_id", text: str = "raw_text") -> DataFrame:
    """Per salvaged row: id, mappings (key -> canonical field, where taken over), confidence (the least of its keys), review (entries).

    Each distinct (key, value, vendor_hint) is matched once, then joined back. Rows may have a vendor_hint, which names their custom fields.
    """
    hint = F.col("vendor_hint").cast("string") if "vendor_hint" in df.columns else F.lit(None).cast("string")
    pairs = df.select(id_column, hint.alias("vendor"), F.explode(candidates(F.col(text))).alias("key", "value")).withColumn("samples", F.array(F.coalesce("value", F.lit(""))))
    known = match(pairs.select("key", "samples", "vendor").distinct()).withColumnRenamed("vendor", "_vendor")
    back = pairs.join(known, ["key", "samples"]).where(F.col("vendor").eqNullSafe(F.col("_vendor")))
    taken = F.when(F.col("decision") != "HUMAN_REVIEW", F.struct("key", "target_field"))  # fallbacks name a custom field
    asked = F.when(F.col("decision") == "HUMAN_REVIEW", F.struct("key", "target_field", "confidence", "inferred_type", "samples"))
    return back.groupBy(id_column).agg(F.map_from_entries(F.array_sort(F.collect_list(taken))).alias("mappings"), F.min("confidence").alias("confidence"), F.array_sort(F.collect_list(asked)).alias("review"))


def review_queue(inferred: DataFrame, events: DataFrame, id_column: str = "event_id", created_at: int = 0) -> DataFrame:
    """A pending row per event and key that people should look at; ids derive from event and key, so reruns agree."""
    rows = inferred.join(events.select(id_column, "cluster_id", "template"), id_column, "left").select(id_column, "cluster_id", "template", F.explode("review").alias("r"))
    return rows.select(
        F.sha2(F.concat_ws("|", id_column, "r.key"), 256).alias("review_id"), F.col("cluster_id").cast("int").alias("cluster_id"), F.col("r.key").alias("source_key"), F.col("r.target_field").alias("suggested_target"),
        F.col("r.confidence").cast("float").alias("confidence"), F.col("r.inferred_type").alias("inferred_type"), F.to_json("r.samples").alias("samples"), "template", F.lit("PENDING").alias("status"), F.lit(created_at).cast("long").alias("created_at"),
    )


def pending(queue: DataFrame) -> DataFrame:
    return queue.where(F.col("status") == "PENDING")
