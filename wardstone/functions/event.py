"""The canonical event: schema, names, construction and validation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import choose, is_ipv4_shaped, mapped

# Fixed values of the event taxonomy.
VERSION = "1.8.0"
NETWORK, FINDING = 4001, 2004
CLASS_NAMES = {4001: "Network Activity", 2004: "Detection Finding"}
CATEGORY_OF = {4001: 4, 2004: 2}
CATEGORY_NAMES = {4001: "Network Activity", 2004: "Findings"}
SEVERITY_NAMES = {1: "Informational", 2: "Low", 3: "Medium", 4: "High", 5: "Critical"}
STATUS_NAMES = {1: "Success", 2: "Failure", 99: "Other"}
UNMAPPED_MOST = 20

ENDPOINT = "struct<ip:string,port:bigint>"


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_S, _I, _L = T.StringType(), T.IntegerType(), T.LongType()
_ENDPOINT = _struct(ip=_S, port=_L)
EVENT = _struct(
    class_uid=_I,
    class_name=_S,
    category_uid=_I,
    category_name=_S,
    activity_id=_I,
    activity_name=_S,
    type_uid=_L,
    type_name=_S,
    severity_id=_I,
    severity=_S,
    status_id=_I,
    status=_S,
    message=_S,
    time=_L,
    metadata=_struct(product=_struct(name=_S, vendor=_S, version=_S), version=_S, uid=_S, correlation_uid=_S),
    raw_data=_S,
    raw_data_hash=_S,
    raw_data_size=_I,
    observables=T.ArrayType(_struct(name=_S, type=_S, value=_S)),
    unmapped=T.MapType(_S, _S),
    src_endpoint=_ENDPOINT,
    dst_endpoint=_ENDPOINT,
    protocol_name=_S,
    protocol_num=_L,
    direction=_S,
    action=_S,
    traffic=_struct(packets=_L, bytes=_L),
    finding_info=_S,
    confidence=_S,
)
FIELDS = EVENT.fieldNames()

#: Types of what parsers give, where it is not text.
PART_TYPES = {
    **dict.fromkeys(("class_uid", "activity", "severity_id", "status_id"), "int"),
    **dict.fromkeys(("time", "src_port", "dst_port", "protocol_num", "packets", "bytes"), "long"),
    **{n: EVENT[n].dataType for n in ("observables", "unmapped")},
}

# Activities as parsers give them.
UNKNOWN, ALLOW, DENY, DETECT = 0, 1, 2, 6


def type_uid(class_uid: Column, activity_id: Column) -> Column:
    return class_uid.cast("long") * 100 + activity_id


def class_name(class_uid: Column) -> Column:
    return mapped(class_uid, CLASS_NAMES, "Unknown")


def category_uid(class_uid: Column) -> Column:
    return mapped(class_uid, CATEGORY_OF, 0)


def category_name(class_uid: Column) -> Column:
    return mapped(class_uid, CATEGORY_NAMES, "Uncategorized")


def severity_name(severity_id: Column) -> Column:
    return mapped(severity_id, SEVERITY_NAMES, "Unknown")


def canonical_activity(class_uid: Column, activity: Column) -> Column:
    """A detection is a denial in network events; findings only know creation."""
    network = choose([(activity == ALLOW, 1), (activity.isin(DENY, DETECT), 2)], 0)
    finding = F.when(activity.isin(ALLOW, DETECT), 1).otherwise(0)
    return choose([(class_uid == NETWORK, network), (class_uid == FINDING, finding)], activity)


def activity_name(class_uid: Column, activity_id: Column) -> Column:
    network = mapped(activity_id, {1: "Allow", 2: "Deny"}, "Unknown")
    finding = mapped(activity_id, {1: "Create"}, "Unknown")
    return choose([(class_uid == NETWORK, network), (class_uid == FINDING, finding)], "Unknown")


def type_name(class_uid: Column, activity_id: Column) -> Column:
    return F.concat(class_name(class_uid), F.lit(": "), activity_name(class_uid, activity_id))


def rfc3339(time: Column) -> Column:
    """Milliseconds as UTC text, without trailing zeros of the fraction."""
    text = F.date_format(F.timestamp_millis(time), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return F.concat(F.regexp_replace(text, r"(?:\.000|(?<=\.[0-9]{1,2})0+)$", ""), F.lit("Z"))


def digest(raw: Column) -> Column:
    return F.sha2(raw, 256)


def uuid_shaped(seed: Column) -> Column:
    """A version-4-shaped identifier that depends on the seed only."""
    h = F.sha2(seed, 256)
    part = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12))


def blank() -> dict[str, Column]:
    """What parsers leave unset."""
    s, n = F.lit(""), F.lit(0).cast("long")
    return {
        "status_id": F.lit(0),
        "status": s,
        "version": s,
        "correlation": s,
        "observables": F.expr("cast(array() as array<struct<name:string,type:string,value:string>>)"),
        "finding_info": s,
        "confidence": s,
        "packets": n,
        "bytes": n,
    }


def build(p: dict[str, Column]) -> dict[str, Column]:
    """The event's fields from a parser's columns: class_uid, activity, severity_id, message, time, product, vendor, uid, raw, ..."""
    p = blank() | p
    c = p["class_uid"]
    a = p["activity_id"] if "activity_id" in p else canonical_activity(c, p["activity"])
    endpoint = lambda side: F.struct(p[f"{side}_ip"].alias("ip"), p[f"{side}_port"].cast("long").alias("port"))
    product = F.struct(p["product"].alias("name"), p["vendor"].alias("vendor"), p["version"].alias("version"))
    values = {
        "class_uid": c,
        "class_name": class_name(c),
        "category_uid": category_uid(c),
        "category_name": category_name(c),
        "activity_id": a,
        "activity_name": activity_name(c, a),
        "type_uid": type_uid(c, a),
        "type_name": type_name(c, a),
        "severity_id": p["severity_id"],
        "severity": severity_name(p["severity_id"]),
        "status_id": p["status_id"],
        "status": p["status"],
        "message": p["message"],
        "time": p["time"],
        "metadata": F.struct(product.alias("product"), F.lit(VERSION).alias("version"), p["uid"].alias("uid"), p["correlation"].alias("correlation_uid")),
        "raw_data": p["raw"],
        "raw_data_hash": digest(p["raw"]),
        "raw_data_size": F.octet_length(p["raw"]),
        "observables": p["observables"],
        "unmapped": p["unmapped"],
        "src_endpoint": endpoint("src"),
        "dst_endpoint": endpoint("dst"),
        "protocol_name": p["protocol_name"],
        "protocol_num": p["protocol_num"].cast("long"),
        "direction": p["direction"],
        "action": p["action"],
        "traffic": F.struct(p["packets"].cast("long").alias("packets"), p["bytes"].cast("long").alias("bytes")),
        "finding_info": p["finding_info"],
        "confidence": p["confidence"],
    }
    return {f.name: values[f.name].cast(f.dataType) for f in EVENT.fields}


def parts(p: dict[str, Column]) -> dict:
    """A parser's columns by the names that validation uses. The digest is there whenever the raw line is."""
    c, a = p["class_uid"], p["activity_id"]
    return {
        "class_uid": c,
        "category_uid": category_uid(c),
        "activity_id": a,
        "type_uid": type_uid(c, a),
        **{n: p[n] for n in ("severity_id", "time", "unmapped")},
        "metadata": {"product": {"name": p["product"]}, "version": F.lit(VERSION), "uid": p["uid"]},
        "raw_data": p["raw"],
        "raw_data_hash": p["raw"],
        "src_endpoint": {"ip": p["src_ip"], "port": p["src_port"]},
        "dst_endpoint": {"ip": p["dst_ip"], "port": p["dst_port"]},
    }


def violation(e: Column | dict[str, Column], check_digest: bool = False) -> Column:
    """The first rule that an event (a struct, or its fields by name) breaks; null if it is valid."""
    missing = lambda c: c.isNull() | (c == "")
    ip_bad = lambda c: (c != "") & ~is_ipv4_shaped(c)
    port_bad = lambda c: ~c.between(0, 65535)
    c, m = e["class_uid"], e["metadata"]
    rules = [
        (~c.isin(NETWORK, FINDING), "class_uid must be 4001 or 2004"),
        (e["category_uid"] != category_uid(c), "category_uid must be that of the class"),
        (e["type_uid"] != type_uid(c, e["activity_id"]), "type_uid must be class*100+activity"),
        (~e["severity_id"].between(0, 5), "severity_id out of range 0-5"),
        (e["time"] <= 0, "time must be positive ms epoch"),
        (missing(m["product"]["name"]) | missing(m["version"]) | missing(m["uid"]), "metadata.product.name, metadata.version, metadata.uid are required"),
        (missing(e["raw_data"]), "raw_data is required"),
        (missing(e["raw_data_hash"]), "raw_data_hash is required"),
        (ip_bad(e["src_endpoint"]["ip"]) | ip_bad(e["dst_endpoint"]["ip"]), "invalid ip"),
        (port_bad(e["src_endpoint"]["port"]) | port_bad(e["dst_endpoint"]["port"]), "port out of range"),
        (F.size(e["unmapped"]) > UNMAPPED_MOST, "unmapped capped at 20 keys"),
    ]
    if check_digest:
        rules.append((e["raw_data_hash"] != digest(e["raw_data"]), "raw_data_hash must be sha256(raw_data)"))
    return choose(rules, F.lit(None).cast("string"))
