"""Suricata EVE, one JSON object a line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import event
from ..functions.text import choose, entries, is_ip, mapped, or_null, trimmed, without_line_end

NAME = "suricata"

FIELDS = {
    "": {"timestamp": "string", "event_type": "string", "src_ip": "string", "dest_ip": "string", "src_port": "bigint", "dest_port": "bigint", "proto": "string", "app_proto": "string", "flow_id": "bigint", "pcap_cnt": "bigint"},
    "alert": {"action": "string", "gid": "bigint", "signature_id": "bigint", "rev": "bigint", "signature": "string", "category": "string", "severity": "bigint"},
    "flow": {n: "bigint" for n in ("pkts_toserver", "pkts_toclient", "bytes_toserver", "bytes_toclient")},
    "http": {"hostname": "string", "url": "string", "http_user_agent": "string", "http_method": "string", "status": "bigint", "http_content_type": "string"},
}
TEXTS = [(part, n) for part, names in FIELDS.items() for n, kind in names.items() if kind == "string"]


def schema(text: str = "string") -> str:
    """The decoded part of a line; ``text`` is the type of its text fields."""
    own = lambda names: [f"{n}:{text if k == 'string' else k}" for n, k in names.items()]
    parts = [f"{part}:struct<{','.join(own(names))}>" for part, names in FIELDS.items() if part]
    return f"struct<{','.join([*own(FIELDS['']), *parts, 'dns:map<string,string>', 'broken:string'])}>"


OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
#: Lines in which a text field could hold something else than text or null; the key may also stand elsewhere.
MAYBE_NOT_TEXT = rf'"(?:{"|".join(dict.fromkeys(n for _, n in TEXTS))})"\s*+:\s*+(?!"|null\b)'
STAMP = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)$"
SEVERITY = {1: 4, 2: 3, 3: 2}
PROTOCOL = {"tcp": 6, "udp": 17, "icmp": 1}


def detect(line: Column) -> Column:
    return line.contains('"event_type"') & trimmed(line).startswith("{")


def _raw(line: Column, s: dict[str, Column]) -> dict[str, Column]:
    return {"raw": without_line_end(line)}


def _decoded(line: Column, s: dict[str, Column]) -> dict[str, Column]:
    return {"eve": F.from_json(s["raw"], schema(), OPTIONS)}


def not_text(raw: Column) -> Column:
    """Whether a decoded text field holds something else than text or null. Only lines that might are decoded again."""
    again = F.from_json(raw, schema("variant"), OPTIONS)
    kinds = [F.schema_of_variant(again[part][n] if part else again[n]) for part, n in TEXTS]
    return F.when(raw.rlike(MAYBE_NOT_TEXT), ~F.coalesce(F.forall(F.array(*kinds), lambda k: k.isNull() | k.isin("STRING", "VOID")), F.lit(True))).otherwise(False)


def is_one_value(raw: Column) -> Column:
    """Whether nothing follows the first value: the line must be all of an array, and all of an object's field.

    The second is only asked where a bracket behind an object could have closed the first.
    """
    alone = F.coalesce(F.json_array_length(F.concat(F.lit("["), raw, F.lit("]"))) == 1, F.lit(False))
    return alone & (~raw.rlike(r"\}\s*+\]") | F.json_object_keys(F.concat(F.lit('{"a":'), raw, F.lit("}"))).isNotNull())


def _fields(line: Column, s: dict[str, Column]) -> dict[str, Column]:
    e = s["eve"]
    text = lambda c: F.coalesce(c, F.lit(""))
    return {
        "invalid": e.isNull() | e["broken"].isNotNull() | ~is_one_value(s["raw"]) | not_text(s["raw"]),
        "kind": text(e["event_type"]),
        "grade": F.coalesce(e["alert"]["severity"], F.lit(0).cast("long")),
        "signature": text(e["alert"]["signature"]),
        "category": text(e["alert"]["category"]),
        "proto": F.lower(trimmed(text(e["proto"]))),
        "source": trimmed(text(e["src_ip"])),
        "target": trimmed(text(e["dest_ip"])),
        "stamp": timestamp(text(e["timestamp"])),
    }


#: What each step adds to the columns that parse() finds.
STEPS = (_raw, _decoded, _fields)


def timestamp(text: Column) -> Column:
    """Milliseconds of a stamp with a zone; null for anything else."""
    point = F.regexp_replace(text, ",", ".")
    return F.unix_millis(F.when(text.rlike(STAMP), point.try_cast("timestamp")))


def parse(line: Column, s: dict[str, Column], ingest_ms: Column) -> dict[str, Column]:
    raw, e = s["raw"], s["eve"]
    text = lambda c: F.coalesce(c, F.lit(""))
    number = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    alert = e["alert"]
    kind, grade, signature, category, proto, source, target, stamp = (s[n] for n in ("kind", "grade", "signature", "category", "proto", "source", "target", "stamp"))
    is_alert = kind == "alert"
    known = proto.isin("tcp", "udp", "icmp", "")
    uid = event.uuid_shaped(F.concat(F.lit(NAME), raw))
    flow = e["flow"]
    shown = lambda c: F.when(c != 0, c.cast("string"))
    only = lambda c: F.when(is_alert, c)
    wrong = lambda ip: (ip != "") & ~is_ip(ip)
    return {
        "class_uid": F.when(is_alert, event.FINDING).otherwise(event.NETWORK),
        "activity": F.lit(event.ALLOW),
        "severity_id": F.when(is_alert, mapped(grade, SEVERITY, F.when(grade <= 0, 1).otherwise(2))).otherwise(1),
        "status_id": F.when(is_alert, 99).otherwise(1),
        "status": F.when(is_alert, "Other").otherwise("Success"),
        "message": F.when(is_alert & (signature != ""), signature).otherwise(F.concat(F.lit("Suricata "), kind, F.lit(" event"))),
        "time": F.coalesce(stamp, ingest_ms),
        "product": F.lit("Suricata"),
        "vendor": F.lit("OISF"),
        "version": F.lit("6.x"),
        "uid": uid,
        "correlation": uid,
        "raw": raw,
        "src_ip": source,
        "src_port": number(e["src_port"]),
        "dst_ip": target,
        "dst_port": number(e["dest_port"]),
        "protocol_name": F.when(known, proto).otherwise(F.lower(text(e["proto"]))),
        "protocol_num": mapped(proto, PROTOCOL, 0),
        "direction": F.lit("unknown"),
        "action": F.when(is_alert, F.coalesce(or_null(text(alert["action"])), F.lit("Alert"))).otherwise(kind),
        "packets": number(flow["pkts_toserver"]) + number(flow["pkts_toclient"]),
        "bytes": number(flow["bytes_toserver"]) + number(flow["bytes_toclient"]),
        "finding_info": F.when(is_alert, signature).otherwise(""),
        "confidence": F.when(is_alert, category).otherwise(""),
        "unmapped": entries(
            ("suricata.event_type", kind),
            ("suricata.flow_id", shown(number(e["flow_id"]))),
            ("suricata.pcap_cnt", shown(number(e["pcap_cnt"]))),
            ("suricata.app_proto", text(e["app_proto"])),
            ("suricata.signature_id", only(shown(number(alert["signature_id"])))),
            ("suricata.gid", only(shown(number(alert["gid"])))),
            ("suricata.rev", only(shown(number(alert["rev"])))),
            ("suricata.category", only(category)),
            ("http.hostname", only(text(e["http"]["hostname"]))),
            ("http.url", only(text(e["http"]["url"]))),
            ("http.user_agent", only(text(e["http"]["http_user_agent"]))),
        ),
        "time_source": F.when(stamp.isNotNull(), "line").otherwise("ingest"),
        "error": choose(
            [
                (trimmed(raw) == "", "suricata: empty line"),
                (s["invalid"], "suricata: invalid JSON"),
                (kind == "", "suricata: missing event_type"),
                (wrong(source) | wrong(target), "suricata: invalid ip"),
            ],
            F.lit(None).cast("string"),
        ),
    }
