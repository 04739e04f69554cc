"""PAN-OS logs as CSV, LEEF or CEF. An extension: not in the default registry, as it would change the routing of other lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import event
from ..functions.text import choose, entries, first_group, integer, mapped, or_null, without_line_end

NAME = "panos"

# Places of the CSV's fields, and names of the others.
PLACES = {"time": 6, "src": 7, "dst": 8, "rule": 11, "app": 14, "session": 22, "sport": 24, "dport": 25, "proto": 29, "action": 30}
NAMES = {"src": "src", "dst": "dst", "sport": "srcPort|spt", "dport": "dstPort|dpt", "proto": "proto", "action": "action|act", "app": "Application|app", "rule": "RuleName|Rule|rule", "sev": "sev"}
ACTIVITY = {"allow": 1, "start": 1, "end": 1, "alert": 6, "deny": 2, "drop": 2, "block": 2, "reset-both": 2, "reset-client": 2, "reset-server": 2, "drop-all": 2, "block-url": 2}
PROTOCOL = {"tcp": 6, "udp": 17, "icmp": 1}


def detect(line: Column) -> Column:
    return line.contains("LEEF:") | line.startswith("CEF:") | line.contains(",THREAT,") | line.contains(",TRAFFIC,")


def _raw(line: Column, s: dict[str, Column]) -> dict[str, Column]:
    raw = without_line_end(line)
    return {"raw": raw, "is_csv": ~(line.contains("LEEF:") | line.startswith("CEF:"))}


def _fields(line: Column, s: dict[str, Column]) -> dict[str, Column]:
    raw, cells = s["raw"], F.split(s["raw"], ',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    cell = lambda n: F.coalesce(F.get(cells, F.lit(PLACES[n])), F.lit("")) if n in PLACES else F.lit("")
    pair = lambda n: first_group(raw, rf"(?:^|[|\t ])(?:{NAMES[n]})=([^|\t ]*)") if n in NAMES else F.lit("")
    out = {n: F.when(s["is_csv"], cell(n)).otherwise(pair(n)) for n in {**PLACES, **NAMES}}
    out["threat"] = F.when(s["is_csv"], raw.contains(",THREAT,")).otherwise(raw.rlike(r"(?:cat=THREAT|\|THREAT\|)"))
    return out


STEPS = (_raw, _fields)


def parse(line: Column, s: dict[str, Column], ingest_ms: Column) -> dict[str, Column]:
    raw, uid = s["raw"], event.uuid_shaped(F.concat(F.lit(NAME), s["raw"]))
    stamp = F.unix_millis(F.when(s["time"].rlike(r"^\d{4}/\d\d/\d\d \d\d:\d\d:\d\d$"), F.try_to_timestamp(s["time"], F.lit("yyyy/MM/dd HH:mm:ss"))))
    act, proto = F.lower(s["action"]), F.lower(s["proto"])
    return {
        "class_uid": F.when(s["threat"], event.FINDING).otherwise(event.NETWORK),
        "activity": F.when(s["threat"], event.DETECT).otherwise(mapped(act, ACTIVITY, 0)),
        "severity_id": F.when(integer(s["sev"]).between(1, 5), integer(s["sev"]).cast("int")).otherwise(F.when(s["threat"], 3).otherwise(1)),
        "message": F.concat(F.lit("PAN-OS "), F.when(s["threat"], "threat").otherwise("traffic"), F.lit(" "), s["action"]),
        "time": F.coalesce(stamp, ingest_ms),
        "product": F.lit("PAN-OS"),
        "vendor": F.lit("Palo Alto Networks"),
        "uid": uid,
        "correlation": uid,
        "raw": raw,
        "src_ip": s["src"],
        "src_port": integer(s["sport"]),
        "dst_ip": s["dst"],
        "dst_port": integer(s["dport"]),
        "protocol_name": proto,
        "protocol_num": mapped(proto, PROTOCOL, 0),
        "direction": F.lit("unknown"),
        "action": s["action"],
        "unmapped": entries(("rule", s["rule"]), ("app", s["app"]), ("session", s["session"])),
        "time_source": F.when(stamp.isNotNull(), "line").otherwise("ingest"),
        "error": choose([(or_null(s["src"]).isNull() & or_null(s["dst"]).isNull(), "panos: no addresses")], F.lit(None).cast("string")),
    }
