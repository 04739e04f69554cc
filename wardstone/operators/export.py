"""Events as other systems read them: ECS, CEF, LEEF and OCSF JSON. All take a normalized frame's columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.event import rfc3339
from ..functions.text import or_null


def ecs() -> dict[str, Column]:
    """The 14 ECS fields, by name."""
    return {
        "@timestamp": rfc3339(F.col("time")),
        "ecs.version": F.lit("8.17.0"),
        "event.kind": F.lit("event"),
        "event.category": F.array(F.lower("category_name")),
        "event.type": F.array(F.lower("activity_name")),
        "source.ip": F.col("src_endpoint.ip"),
        "source.port": F.col("src_endpoint.port"),
        "destination.ip": F.col("dst_endpoint.ip"),
        "destination.port": F.col("dst_endpoint.port"),
        "network.protocol": F.col("protocol_name"),
        "event.action": F.col("action"),
        "message": F.col("message"),
        "event.original": F.col("raw_data"),
        "labels.event_id": F.col("metadata.uid"),
    }


def query_escaped(c: Column) -> Column:
    """Form escaping that keeps '~' and escapes '*'; a space is '+'."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _joined(pairs: list[tuple[str, Column]], between: str) -> Column:
    return F.concat_ws(between, *[F.concat(F.lit(f"{k}="), F.coalesce(v, F.lit(""))) for k, v in pairs])


def _head(form: str) -> Column:
    product = F.col("metadata.product")
    parts = [F.lit(form), product["vendor"], product["name"], product["version"], F.col("type_uid").cast("string")]
    return F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])


def cef(uid: Column | None = None) -> Column:
    """CEF:0|vendor|product|version|type_uid|type_name|severity|extension, the extension's keys in order."""
    src, dst = F.col("src_endpoint"), F.col("dst_endpoint")
    values = {
        "src": src["ip"],
        "dst": dst["ip"],
        "spt": src["port"].cast("string"),
        "dpt": dst["port"].cast("string"),
        "proto": F.col("protocol_name"),
        "act": F.col("action"),
        "msg": F.col("message"),
        "cs1": F.col("metadata.uid") if uid is None else uid,
        "cs1Label": F.lit("event_id"),
    }
    extension = _joined([(k, query_escaped(values[k])) for k in sorted(values)], " ")
    return F.concat_ws("|", _head("CEF:0"), F.col("type_name"), F.col("severity_id").cast("string"), extension)


def leef(uid: Column | None = None) -> Column:
    """LEEF:2.0|vendor|product|version|type_uid| and ten attributes behind tabs."""
    src, dst = F.col("src_endpoint"), F.col("dst_endpoint")
    attributes = [
        ("cat", F.col("category_name")),
        ("src", src["ip"]),
        ("dst", dst["ip"]),
        ("srcPort", src["port"].cast("string")),
        ("dstPort", dst["port"].cast("string")),
        ("proto", F.col("protocol_name")),
        ("action", F.col("action")),
        ("sev", F.col("severity_id").cast("string")),
        ("msg", F.col("message")),
        ("eventID", F.col("metadata.uid") if uid is None else uid),
    ]
    return F.concat(_head("LEEF:2.0"), F.lit("|\t"), _joined(attributes, "\t"))


def ocsf_json() -> Column:
    """The event as JSON in its schema's order; empty values are left out where the schema allows."""
    some = lambda c: F.when(c != 0, c)
    text = lambda n: or_null(F.col(n)).alias(n)
    meta = F.col("metadata")
    product = F.struct(meta["product"]["name"].alias("name"), or_null(meta["product"]["vendor"]).alias("vendor"), or_null(meta["product"]["version"]).alias("version"))
    metadata = F.struct(product.alias("product"), meta["version"].alias("version"), meta["uid"].alias("uid"), or_null(meta["correlation_uid"]).alias("correlation_uid"))
    endpoint = lambda n: F.struct(or_null(F.col(f"{n}.ip")).alias("ip"), some(F.col(f"{n}.port")).alias("port")).alias(n)
    observables = F.transform("observables", lambda o: F.struct(o["name"].alias("name"), o["type"].alias("type"), or_null(o["value"]).alias("value")))
    whole = F.struct(
        "class_uid", text("class_name"), "category_uid", text("category_name"), "activity_id", text("activity_name"), "type_uid", text("type_name"),
        "severity_id", text("severity"), some(F.col("status_id")).alias("status_id"), text("status"), text("message"), "time", metadata.alias("metadata"),
        text("raw_data"), text("raw_data_hash"), some(F.col("raw_data_size")).alias("raw_data_size"),
        F.when(F.size("observables") > 0, observables).alias("observables"),
        F.when(F.size("unmapped") > 0, F.map_from_entries(F.array_sort(F.map_entries("unmapped")))).alias("unmapped"),
        endpoint("src_endpoint"), endpoint("dst_endpoint"), text("protocol_name"), some(F.col("protocol_num")).alias("protocol_num"),
        text("direction"), text("action"),
        F.struct(some(F.col("traffic.packets")).alias("packets"), some(F.col("traffic.bytes")).alias("bytes")).alias("traffic"),
        text("finding_info"), text("confidence"),
    )
    out = F.to_json(whole)
    for c, code in (("<", "003c"), (">", "003e"), ("&", "0026"), (" ", "2028"), (" ", "2029")):
        out = F.replace(out, F.lit(c), F.lit("\\u" + code))
    return out
