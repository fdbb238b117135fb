"""Normalisation: decoded fields become one nested event per record, with typed columns for known paths and a map for the rest."""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decoders
from ..functions.lookups import CLASS_NETWORK, CLASS_UNMAPPED, SCHEMA_VERSION, disposition_id, severity_id, status_id
from ..sources.packs import BUILT_IN, Pack
from .detect import SALVAGE, by_pack

# fixed values: key families that are placed without a mapping; of several present keys the last of the list counts
FAMILIES = {
    "src_ip": ["src_ip", "srcip", "saddr", "client_ip"],
    "dst_ip": ["dst_ip", "dstip", "daddr", "target_ip"],
    "src_port": ["src_port", "sport"],
    "dst_port": ["dst_port", "dport"],
    "user": ["user", "username", "account"],
    "hostname": ["hostname", "host"],
    "action": ["action", "act"],
    "status": ["status", "result"],
    "severity": ["severity", "level", "pri"],
    "message": ["message", "msg"],
}
EXTENSION = {"src_ip": ["src", "srcip", "saddr", "src_ip"], "dst_ip": ["dst", "dstip", "daddr", "dst_ip"], "src_port": ["spt", "src_port", "sport"], "dst_port": ["dpt", "dst_port", "dport"], "action": ["act", "action"], "protocol": ["proto", "protocol"]}
UNPARSED = ["unparsed_salvage"]
#: Keys of families; keys of unmapped that are the engine's own.
KNOWN, TAKEN = [k for keys in FAMILIES.values() for k in keys], ("raw_locator", "raw_sha256")
#: Paths that have a column.
PLACED = ("src_endpoint.ip", "src_endpoint.port", "dst_endpoint.ip", "dst_endpoint.port", "actor.user.name", "device.hostname", "activity_name", "severity_id", "severity", "http_request.url", "http_request.http_method", "file.name", "file.hashes.sha256", "network_endpoint.mac", "message", "status_id", "connection_info.protocol_name", "connection_info.protocol_num", "metadata.product.name", "metadata.product.vendor_name", "metadata.product.version", "metadata.event_code", "process.pid")


#: Members of an event that are objects, and theirs.
OBJECTS: dict[str, dict] = {
    "actor": {"user": {"name": None}}, "connection_info": {"protocol_name": None, "protocol_num": None}, "device": {"hostname": None}, "dst_endpoint": {"ip": None, "port": None},
    "file": {"hashes": {"sha256": None}, "name": None}, "http_request": {"http_method": None, "url": None},
    "metadata": {"event_code": None, "labels": None, "original_time": None, "product": {"name": None, "vendor_name": None, "version": None}, "profiles": None, "version": None},
    "network_endpoint": {"mac": None}, "process": {"pid": None}, "src_endpoint": {"ip": None, "port": None},
}
#: Members that are none.
PLAIN = ("activity_name", "category_uid", "class_uid", "disposition_id", "message", "raw_data", "severity", "severity_id", "status_id", "time", "unmapped", "event_id", "sequence", "prev_hash", "fingerprint")


def further(packs: Sequence[Pack]) -> list[str]:
    """Paths that packs map to beyond the built-in ones. A path through a member that is no object, or to one that is, stays unmapped; of
    two paths of which one leads through the other, the shorter one counts."""
    out: list[str] = []
    for target in sorted({t for p in packs for t in p.mappings.values()}):
        parts = target.split(".")
        if not all(re.fullmatch(r"[A-Za-z]\w*", x) for x in parts) or parts[0] in PLAIN:
            continue
        at: dict | None = OBJECTS
        for x in parts:
            at = at.get(x, {}) if at is not None else None  # {}: new from here on
            if at is None:
                break
        known = at is None or at != {}
        if not known and not any(target.startswith(f"{o}.") for o in out):
            out.append(target)
    return out


def grafted(members: dict[str, Column], paths: Sequence[str], value: Callable[[str], Column], replaced: dict[str, Column]) -> dict[str, Column]:
    """The members of an event with further paths set, in objects that are there or in new ones; members stay in alphabetical order.

    value gives a path's text. Where `replaced` holds, the line's own keys have replaced the member's object, and nothing is set in it.
    """
    tree: dict = {}
    for p in paths:
        *inner, last = p.split(".")
        at = tree
        for x in inner:
            at = at.setdefault(x, {})
        at[last] = p

    def object_of(base: Column | None, known: dict, new: dict, keep: Column | None) -> tuple[Column, Column]:
        """(the object with its new members, whether any of these is set)."""
        fields, there = {k: base[k] for k in known} if base is not None else {}, F.lit(False)
        for k, below in new.items():
            if isinstance(below, dict):
                fields[k], some = object_of(fields.get(k), known.get(k) or {}, below, keep)
            else:
                fields[k] = value(below) if keep is None else F.when(keep, value(below))
                some = fields[k].isNotNull()
            there = there | some
        made = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
        return F.when(there | base.isNotNull() if base is not None else there, made), there

    out = dict(members)
    for top, new in tree.items():
        new = new if isinstance(new, dict) else None
        if new is None:
            out[top] = value(top)
        else:
            out[top] = object_of(members.get(top), OBJECTS.get(top, {}), new, ~replaced[top] if top in replaced else None)[0]
    return out


def empty_map() -> Column:
    return F.create_map().cast(decoders.STRINGS)


def picked(fields: Column, keys: Sequence[str]) -> Column:
    """Value of the last of the keys that is present."""
    return F.coalesce(*[F.try_element_at(fields, F.lit(k)) for k in reversed(keys)])


@dataclass
class Sides:
    """Where a line's fields go: texts by mapped path, texts by family of keys, and what stays unmapped as a map."""

    mapped: dict[str, Column]
    free: dict[str, Column]
    rest: Column


def newest(fields: Column, keys: Sequence[str]) -> Column:
    """Value of the key that comes last in the line."""
    if len(keys) == 1:
        return F.try_element_at(fields, F.lit(keys[0]))
    return F.try_element_at(fields, F.try_element_at(F.filter(F.map_keys(fields), lambda k: k.isin(*keys)), F.lit(-1)))


def known_sides(df: DataFrame, packs: Sequence[Pack], placed: Collection[str]) -> tuple[DataFrame, Sides]:
    """Sides of lines with their packs' mappings alone; needs no maps but the rest."""
    claimed, fields = F.col("claimed"), F.col("_fields")
    keys = {p.id: {t: [k for k, to in p.mappings.items() if to == t] for t in p.mappings.values()} for p in packs}
    mapped: dict[str, Column] = {}
    for p in packs:
        for t, own in keys[p.id].items():
            if t in placed or t == "time":
                mapped[t] = mapped.get(t, F).when(claimed == p.id, newest(fields, own))

    def free(key: str) -> Column:
        users, value = [p.id for p in packs if key in p.mappings], F.try_element_at(fields, F.lit(key))
        return F.when(~F.coalesce(claimed.isin(*users), F.lit(False)), value) if users else value

    def rest(p: Pack | None) -> Column:
        gone = [*KNOWN, *TAKEN, *(p.mappings if p else ())]
        kept = F.map_filter(fields, lambda k, v: ~k.isin(*gone))
        lost = {t: own for t, own in keys[p.id].items() if t not in placed} if p else {}
        if not lost:
            return kept
        there = [F.struct(F.lit(t).alias("k"), newest(fields, own).alias("v"), F.arrays_overlap(F.map_keys(fields), F.array(*map(F.lit, own))).alias("there")) for t, own in lost.items()]
        unplaced = F.map_from_entries(F.transform(F.filter(F.array(*there), lambda e: e["there"]), lambda e: F.struct(e["k"], e["v"])))
        return F.map_concat(F.map_filter(kept, lambda k, v: ~F.map_contains_key(unplaced, k)), F.map_filter(unplaced, lambda k, v: ~((k == "time") & v.try_cast("long").isNotNull())))

    return df, Sides(mapped, {k: F.coalesce(*[free(key) for key in reversed(own)]) for k, own in FAMILIES.items()}, by_pack(claimed, packs, rest, rest(None)))


def inferred_sides(df: DataFrame, packs: Sequence[Pack], placed: Collection[str]) -> tuple[DataFrame, Sides]:
    """Sides of lines whose mappings are partly inferred, so known only row by row. Mappings to paths without a column, and times that
    aren't numbers, aren't lost."""
    fields, inferred = F.col("_fields"), F.coalesce(F.col("mappings"), empty_map())
    maps = by_pack(F.col("claimed"), packs, lambda p: F.create_map(*[F.lit(x) for pair in p.mappings.items() for x in pair]) if p.mappings else empty_map(), empty_map())
    to = F.when(F.size(inferred) > 0, F.map_concat(F.map_filter(maps, lambda k, v: ~F.map_contains_key(inferred, k)), inferred)).otherwise(maps)
    df = df.withColumn("_to", to)
    to = F.col("_to")
    own = F.map_filter(fields, lambda k, v: F.map_contains_key(to, k))
    df = df.withColumns({
        "_mapped": decoders.last_wins(F.transform(F.map_keys(own), lambda k: F.element_at(to, k)), F.map_values(own)),
        "_free": F.map_filter(fields, lambda k, v: ~F.map_contains_key(to, k) & k.isin(*KNOWN)),
    })
    df = df.withColumn("_unplaced", F.map_filter("_mapped", lambda k, v: ~k.isin(*sorted(placed))))
    rest = F.map_filter(fields, lambda k, v: ~F.map_contains_key(to, k) & ~k.isin(*KNOWN, *TAKEN) & ~F.map_contains_key(F.col("_unplaced"), k))
    over = F.map_filter("_unplaced", lambda k, v: ~((k == "time") & v.try_cast("long").isNotNull()))
    return df, Sides({t: F.try_element_at("_mapped", F.lit(t)) for t in sorted({*placed, "time"})}, {k: picked(F.col("_free"), keys) for k, keys in FAMILIES.items()}, F.map_concat(rest, over))


def normalize(df: DataFrame, packs: Sequence[Pack] = BUILT_IN, now_ms: int | Column = 0) -> DataFrame:
    """Adds event (a struct whose members are in alphabetical order, as canonical JSON wants them).

    df has raw_text, raw_sha256, locator, claimed, pack, decoder, fields and, if inference ran, mappings (key -> canonical field); a
    vendor_hint, if there is one, stands for the vendor of lines that no pack claims.
    Precedence: a key's mapping (inferred before the pack's), then the families above, else the key stays under unmapped. What families
    find in endpoints, user and host replaces what mappings put there; an extension's pairs replace both.
    """
    now = F.lit(now_ms).cast("long") if isinstance(now_ms, int) else now_ms
    claimed = F.col("claimed")
    hinted = F.coalesce(F.nullif(F.col("vendor_hint"), F.lit("")), F.lit("Generic")) if "vendor_hint" in df.columns else F.lit("Generic")
    texts = lambda value, default: by_pack(claimed, packs, lambda p: F.lit(value(p)), F.lit(default))
    columns = df.columns
    df = df.withColumn("_fields", F.coalesce(F.col("fields"), empty_map()))
    fields, extra = F.col("_fields"), further(packs)
    # a pack's mappings are known when the plan is made, so its fields are read by name; inferred ones are known row by row
    df, sides = (inferred_sides if "mappings" in columns else known_sides)(df, packs, {*extra, *PLACED})
    at = {t: f"_mapped{i}" for i, t in enumerate(sides.mapped)}
    df = df.withColumns({"_ext": F.coalesce(F.from_json(F.try_element_at(fields, F.lit("extension")), decoders.STRINGS), empty_map()), "_rest": sides.rest, **{at[t]: c for t, c in sides.mapped.items()}, **{f"_free_{k}": c for k, c in sides.free.items()}})
    m = lambda path: F.col(at[path]) if path in at else F.lit(None).cast("string")
    f = lambda family: F.col(f"_free_{family}")
    x = lambda family: picked(F.col("_ext"), EXTENSION[family])
    port = lambda c: c.try_cast("int")

    def endpoint(side: str) -> tuple[Column, Column]:
        """(endpoint, whether the line's own keys name it)."""
        ip, number = F.coalesce(x(f"{side}_ip"), f(f"{side}_ip")), F.coalesce(port(x(f"{side}_port")), port(f(f"{side}_port")))
        own = ip.isNotNull() | number.isNotNull()
        there, at = m(f"{side}_endpoint.ip"), port(m(f"{side}_endpoint.port"))
        mapped_ = F.when(there.isNotNull() | at.isNotNull(), F.struct(there.alias("ip"), at.alias("port")))
        return F.when(own, F.struct(ip.alias("ip"), number.alias("port"))).otherwise(mapped_), own

    (src, own_src), (dst, own_dst) = endpoint("src"), endpoint("dst")
    action = F.coalesce(x("action"), f("action"))
    adopted = (F.lit("") if not packs else texts(lambda p: str(p.class_uid), "")).try_cast("int")
    class_uid, category = F.coalesce(adopted, F.lit(CLASS_UNMAPPED)), F.coalesce(by_pack(claimed, packs, lambda p: F.lit(p.category), F.lit(None).cast("int")), F.lit(0))
    network = (class_uid == CLASS_UNMAPPED) & (own_src | own_dst)
    when_not_null = lambda value, *parts: F.when(F.coalesce(*parts).isNotNull(), value)
    user, host = F.coalesce(f("user"), m("actor.user.name")), F.coalesce(f("hostname"), m("device.hostname"))
    protocol, protocol_num = F.coalesce(x("protocol"), m("connection_info.protocol_name")), m("connection_info.protocol_num")
    time_text = F.coalesce(F.try_element_at(fields, F.lit("time")), F.try_element_at(fields, F.lit("timestamp")), now.cast("string"))
    product = F.struct(
        F.coalesce(m("metadata.product.name"), F.try_element_at(fields, F.lit("device_product")), texts(lambda p: p.product, "Unknown")).alias("name"),
        F.coalesce(m("metadata.product.vendor_name"), F.try_element_at(fields, F.lit("device_vendor")), by_pack(claimed, packs, lambda p: F.lit(p.vendor), hinted)).alias("vendor_name"),
        F.coalesce(m("metadata.product.version"), texts(lambda p: p.version, "1.0")).alias("version"),
    )
    labels = by_pack(claimed, packs, lambda p: F.array(*map(F.lit, p.labels)).cast("array<string>"), F.array(*map(F.lit, UNPARSED)))
    mapped_time = m("time").try_cast("long")
    extras = F.map_from_arrays(F.array(*map(F.lit, TAKEN)), F.array(F.col("locator"), F.col("raw_sha256")))
    # keys are unique, so entries are in order of keys
    unmapped = F.map_from_entries(F.sort_array(F.map_entries(F.map_concat(F.col("_rest"), extras))))
    mapped_severity, mapped_status = m("severity_id"), m("status_id")
    members = {
        "activity_name": F.coalesce(action, m("activity_name")),
        "actor": when_not_null(F.struct(F.struct(user.alias("name")).alias("user")), user),
        "category_uid": F.when(network, 4).otherwise(category).cast("int"),
        "class_uid": F.when(network, CLASS_NETWORK).otherwise(class_uid).cast("int"),
        "connection_info": when_not_null(F.struct(protocol.alias("protocol_name"), protocol_num.alias("protocol_num")), protocol, protocol_num),
        "device": when_not_null(F.struct(host.alias("hostname")), host),
        "disposition_id": disposition_id(action),
        "dst_endpoint": dst,
        "file": when_not_null(F.struct(F.struct(m("file.hashes.sha256").alias("sha256")).alias("hashes"), m("file.name").alias("name")), m("file.name"), m("file.hashes.sha256")),
        "http_request": when_not_null(F.struct(m("http_request.http_method").alias("http_method"), m("http_request.url").alias("url")), m("http_request.http_method"), m("http_request.url")),
        "message": F.coalesce(f("message"), m("message")),
        "metadata": F.struct(m("metadata.event_code").alias("event_code"), labels.alias("labels"), time_text.alias("original_time"), product.alias("product"), F.array(F.lit("host"), F.lit("security_control")).alias("profiles"), F.lit(SCHEMA_VERSION).alias("version")),
        "network_endpoint": when_not_null(F.struct(m("network_endpoint.mac").alias("mac")), m("network_endpoint.mac")),
        "process": when_not_null(F.struct(m("process.pid").alias("pid")), m("process.pid")),
        "raw_data": F.col("raw_text"),
        "severity": m("severity"),
        "severity_id": F.coalesce(severity_id(f("severity")), mapped_severity.try_cast("int"), severity_id(mapped_severity)),
        "src_endpoint": src,
        "status_id": F.coalesce(status_id(f("status")), mapped_status.try_cast("int"), status_id(mapped_status)),
        "time": F.coalesce(mapped_time, now),
        "unmapped": unmapped,
    }
    replaced = {"src_endpoint": own_src, "dst_endpoint": own_dst, "actor": f("user").isNotNull(), "device": f("hostname").isNotNull()}
    members = grafted(members, extra, m, replaced)
    event = F.struct(*[members[k].alias(k) for k in sorted(members)])
    return df.select(*columns, event.alias("event"))


def valid(event: Column) -> Column:
    """Whether an event is complete: version, class and category, time, raw text, locator and digest."""
    parts = [event["metadata"], event["class_uid"], event["category_uid"], event["time"], event["raw_data"], event["unmapped"]]
    there = parts[0].isNotNull()
    for p in parts[1:]:
        there = there & p.isNotNull()
    return F.coalesce(there & event["metadata"]["version"].isNotNull() & F.map_contains_key(event["unmapped"], "raw_locator"), F.lit(False))


def strictly_valid(event: Column, scheme: str = "weir") -> Column:
    """valid, and of this schema version, with a locator of the vault and a digest."""
    locator, sha = F.try_element_at(event["unmapped"], F.lit("raw_locator")), F.try_element_at(event["unmapped"], F.lit("raw_sha256"))
    return F.coalesce(valid(event) & (event["metadata"]["version"] == SCHEMA_VERSION) & locator.startswith(f"{scheme}:raw:") & (F.length(sha) > 0), F.lit(False))


def field_keys() -> Column:
    return F.coalesce(F.map_keys("fields"), F.array().cast("array<string>"))


def traced() -> list[Column]:
    """What lineage() needs of events beside seals and the lake's columns, for chain.append."""
    return [F.col("pack"), F.col("decoder"), F.col("raw_bytes"), field_keys().alias("field_keys")]


def lineage(df: DataFrame) -> DataFrame:
    """Adds lineage: a struct of seven stages, from raw bytes to sink. df: events, or what lake.kept() and traced() leave of them."""
    salvaged = F.col("pack") == SALVAGE
    confidence = F.coalesce(F.col("confidence"), F.lit(1.0)) if "confidence" in df.columns else F.lit(1.0)
    keys = field_keys() if "fields" in df.columns else F.col("field_keys")
    return df.withColumn("lineage", F.struct(
        "event_id",
        F.struct(F.col("locator").alias("locator"), F.octet_length("raw_bytes").alias("byte_length"), F.sha2("raw_bytes", 256).alias("sha256")).alias("stage_1_raw"),
        F.struct(F.col("pack").alias("pack"), F.when(salvaged, "SALVAGE_FALLBACK").otherwise("CLAIMED").alias("status")).alias("stage_2_detection"),
        F.struct(F.col("decoder").alias("decoder"), F.size(keys).alias("field_count"), keys.alias("keys")).alias("stage_3_extraction"),
        F.struct(confidence.alias("vector_confidence"), F.when(confidence >= 0.85, "GREEN").when(confidence >= 0.60, "YELLOW").otherwise("RED").alias("confidence_band")).alias("stage_4_inference"),
        F.struct(F.lit(SCHEMA_VERSION).alias("ocsf_version"), F.col("event.class_uid" if "event" in df.columns else "class_uid").alias("class_uid")).alias("stage_5_normalization"),
        F.struct(F.lit("RFC8785_JCS").alias("canonical_scheme"), F.lit("SHA256").alias("algorithm"), F.col("fingerprint").alias("fingerprint"), F.col("prev_hash").alias("prev_hash")).alias("stage_6_attestation"),
        F.struct(F.lit("COMMITTED").alias("status"), F.array(F.lit("NDJSON"), F.lit("PARQUET")).alias("formats")).alias("stage_7_sink"),
    ))
