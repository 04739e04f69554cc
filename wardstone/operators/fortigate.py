"""FortiGate key=value logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import event
from ..functions.text import choose, found, integer, mapped, or_null

NAME = "fortigate"

# Keys that have a field of their own.
KNOWN = [
    "date", "time", "logid", "type", "subtype", "eventtype", "level", "vd", "eventtime",
    "srcip", "dstip", "srcport", "dstport", "proto", "service", "action", "direction",
    "bytes", "packets", "msg", "logdesc", "virus", "attack",
]
SEVERITY = {"information": 1, "notice": 1, "low": 2, "warning": 3, "medium": 3, "alert": 4, "high": 4, "critical": 5}
ACTIVITY = {"pass": 1, "accept": 1, "allow": 1, "login": 1, "ssl-login": 1, "deny": 2, "blocked": 6, "dropped": 6}
PROTOCOL = {"6": "tcp", "17": "udp", "1": "icmp"}

USED = [k for k in KNOWN if k not in ("vd", "eventtype")] + ["version"]

#: key=value, the value quoted with escapes, up to the line's end if its quote stays open, or bare.
TOKEN = r'([^= \t]*+)=("(?:[^"\\]++|\\["\\]|\\)*+"?|[^ \t]*+)'


def detect(line: Column) -> Column:
    return line.contains("logid=") & line.contains("type=")


def without_priority(line: Column) -> Column:
    return F.regexp_replace(line, r"^<[^>]*>", "")


def tokens(line: Column) -> tuple[Column, Column]:
    """The keys and the raw values of a line, last first, so that the last of a key is found first."""
    body = without_priority(line)
    pick = lambda g: F.reverse(F.regexp_extract_all(body, F.lit(TOKEN), F.lit(g)))
    return pick(1), pick(2)


def unquoted(v: Column) -> Column:
    """Without a backslash there is no quote inside, so those at the ends are all."""
    inner = F.regexp_replace(F.regexp_replace(v, r'^"((?:\\["\\]|[^"])*+)"?$', "$1"), r'\\(["\\])', "$1")
    return choose([(~v.startswith('"'), v), (~v.contains("\\"), F.btrim(v, F.lit('"')))], inner)


def _tokens(line: Column, s: dict[str, Column]) -> dict[str, Column]:
    keys, values = tokens(line)
    return {"keys": keys, "values": values}


def _raw_fields(line: Column, s: dict[str, Column]) -> dict[str, Column]:
    return {f"raw_{k}": found(s["keys"], s["values"], k) for k in USED}


def _fields(line: Column, s: dict[str, Column]) -> dict[str, Column]:
    others = F.array_sort(F.array_except(s["keys"], F.array(*[F.lit(k) for k in KNOWN])))
    return {**{k: unquoted(s[f"raw_{k}"]) for k in USED}, "others": F.slice(others, 1, event.UNMAPPED_MOST)}


#: What each step adds to the columns that parse() finds.
STEPS = (_tokens, _raw_fields, _fields)


def fields(s: dict[str, Column], key: str) -> Column:
    return unquoted(found(s["keys"], s["values"], key))


def timestamp(kv) -> Column:
    """Milliseconds: eventtime in seconds, else date and time in UTC; null without either."""
    seconds = F.when(kv("eventtime").rlike(r"^[+-]?[0-9]+$"), F.try_multiply(kv("eventtime").try_cast("long"), F.lit(1000).cast("long")))
    both = F.concat(kv("date"), F.lit(" "), kv("time"))
    stamp = F.when(both.rlike(r"^\d{4}-\d\d-\d\d \d{1,2}:\d\d:\d\d$"), F.try_to_timestamp(both, F.lit("yyyy-MM-dd H:mm:ss")))
    return F.coalesce(seconds, F.unix_millis(stamp))


def unmapped(s: dict[str, Column]) -> Column:
    """Keys without a field of their own, the first 20 by their bytes; of equal keys the last."""
    return F.map_from_arrays(s["others"], F.transform(s["others"], lambda k: unquoted(F.get(s["values"], (F.array_position(s["keys"], k) - 1).cast("int")))))


def parse(line: Column, s: dict[str, Column]) -> dict[str, Column]:
    kv = lambda key: s[key]
    action, low = kv("action"), lambda k: F.lower(kv(k))
    finding = (low("type") == "utm") & low("subtype").isin("virus", "ips") & F.lower(action).isin("blocked", "dropped")
    time = timestamp(kv)
    return {
        "class_uid": F.when(finding, event.FINDING).otherwise(event.NETWORK),
        "activity": mapped(F.lower(action), ACTIVITY, 0),
        "severity_id": mapped(low("level"), SEVERITY, 0),
        "message": F.coalesce(or_null(kv("msg")), kv("logdesc")),
        "time": time,
        "product": F.lit("FortiGate"),
        "vendor": F.lit("Fortinet"),
        "version": kv("version"),
        "uid": event.uuid_shaped(F.concat(F.lit(NAME), line)),
        "raw": line,
        "src_ip": kv("srcip"),
        "src_port": integer(kv("srcport")),
        "dst_ip": kv("dstip"),
        "dst_port": integer(kv("dstport")),
        "protocol_num": integer(kv("proto")),
        "protocol_name": mapped(kv("proto"), PROTOCOL, low("service")),
        "direction": kv("direction"),
        "action": action,
        "bytes": integer(kv("bytes")),
        "packets": integer(kv("packets")),
        "finding_info": F.when(finding, F.coalesce(or_null(kv("virus")), kv("attack"))).otherwise(""),
        "unmapped": unmapped(s),
        "time_source": choose([(time.isNotNull(), "line")], F.lit(None).cast("string")),
        "error": choose(
            [((kv("logid") == "") | (kv("type") == ""), "fortigate: not a FortiGate log"), (time.isNull(), "fortigate: no valid timestamp")],
            F.lit(None).cast("string"),
        ),
    }
