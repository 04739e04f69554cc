"""Cisco ASA syslog."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import event
from ..functions.text import choose, entries, first_group, has_any, is_ipv4, mapped, without_line_end

NAME = "cisco_asa"

# Message numbers, severities and the patterns below.
DENY_IDS = ["106023", "106015", "313004", "313005", "305006", "402119", "110002"]
ALLOW_IDS = ["302013", "302015", "302018", "302021", "305011", "305012", "302014", "302016", "725001", "725002", "602101"]
SEVERITY = {"0": 5, "1": 5, "2": 4, "3": 4, "4": 3, "5": 2}
VERBS = {"built": "Built", "teardown": "Teardown", "deny": "Deny", "denied": "Deny", "permitted": "Permit"}
PROTOCOL = {"tcp": 6, "udp": 17, "icmp": 1}

HEADER = r"%ASA-[0-9]-[0-9]+:[ \t\n\f\r]*.*"
NAMED = r"(inside|outside):([0-9.]+)(?:/([0-9]+))?"
SLASHED = r"(inside|outside)/([0-9.]+)\(([0-9]+)\)"
FROM = r"from[ \t\n\f\r]+([0-9]+\.[0-9.]+)(?:/([0-9]+))?"
TO = r"to[ \t\n\f\r]+([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)(?:/([0-9]+))?"
FOR_IP = r"for IP[ \t\n\f\r]+([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)"
PORT_BEYOND = 9_999_999


def detect(line: Column) -> Column:
    return line.contains("%ASA-")


def endpoint(ip: Column, port: Column) -> Column:
    """Null unless the address is one; a port too long for an integer stays out of range."""
    n = F.when(port == "", 0).otherwise(F.coalesce(port.try_cast("long"), F.lit(PORT_BEYOND)))
    return F.when(is_ipv4(ip), F.struct(ip.alias("ip"), n.cast("long").alias("port")))


def _all(raw: Column, mark: str, pattern: str, ip: int, port: int) -> Column:
    """All endpoints of a pattern, which only lines with ``mark`` can hold."""
    pick = lambda g: F.regexp_extract_all(raw, F.lit(pattern), F.lit(g))
    found = F.filter(F.zip_with(pick(ip), pick(port), endpoint), lambda e: e.isNotNull())
    return F.when(raw.contains(mark), found).otherwise(F.array().cast(f"array<{event.ENDPOINT}>"))


def endpoints(raw: Column) -> dict[str, Column]:
    """Candidates: named endpoints (colon form before slash form), the first 'from', the last 'to', 'for IP'."""
    return {
        "named": F.concat(_all(raw, "side:", NAMED, 2, 3), _all(raw, "side/", SLASHED, 2, 3)),
        "source": F.when(raw.contains("from"), endpoint(first_group(raw, FROM, 1), first_group(raw, FROM, 2))),
        "target": F.try_element_at(_all(raw, "to", TO, 1, 2), F.lit(-1)),
        "single": F.when(raw.contains("for IP"), endpoint(first_group(raw, FOR_IP, 1), F.lit(""))),
    }


def source_and_target(e: dict[str, Column]) -> tuple[Column, Column]:
    """Two named ones: the last two. One: that and 'to'. None: 'from' and 'to', or the target 'for IP' if there is neither."""
    n, none = F.size(e["named"]), F.lit(None).cast(event.ENDPOINT)
    at = lambda k: F.get(e["named"], n + k)
    source = choose([(n >= 2, at(-2)), (n == 1, at(-1))], e["source"])
    target = choose([(n >= 2, at(-1)), ((n == 1) | e["target"].isNotNull(), e["target"]), (e["source"].isNotNull(), none)], e["single"])
    return source, target


def _raw(line: Column, s: dict[str, Column]) -> dict[str, Column]:
    return {"raw": without_line_end(line)}


def _parts(line: Column, s: dict[str, Column]) -> dict[str, Column]:
    raw = s["raw"]
    return {"header": first_group(raw, HEADER, 0), "low_raw": F.lower(raw), **endpoints(raw)}


def _header(line: Column, s: dict[str, Column]) -> dict[str, Column]:
    """The header's parts: one digit of severity, the message's number up to a colon, the message."""
    rest = F.substr(s["header"], F.lit(8))
    number = F.substring_index(rest, ":", 1)
    return {"grade": F.substr(s["header"], F.lit(6), F.lit(1)), "number": number, "message": F.ltrim(F.substr(rest, F.length(number) + F.lit(2)), F.lit(" \t\n\f\r"))}


def _endpoints(line: Column, s: dict[str, Column]) -> dict[str, Column]:
    source, target = source_and_target(s)
    return {"from": source, "to": target, "low": F.lower(s["message"]), "word": first_group(s["message"], r"^\s*(\S+)"), "proto": first_group(s["low_raw"], r"\b(tcp|udp|icmp)\b")}


#: What each step adds to the columns that parse() finds.
STEPS = (_raw, _parts, _header, _endpoints)


def activity(number: Column, low: Column) -> Column:
    denied = has_any(low, "deny", "denied", "failed")
    return choose(
        [
            (number.isin(DENY_IDS), event.DENY),
            (number.isin(ALLOW_IDS), F.when(denied, event.DENY).otherwise(event.ALLOW)),
            (number == "106100", F.when(low.contains("denied"), event.DENY).otherwise(event.ALLOW)),
            (denied, event.DENY),
            (has_any(low, "built", "permitted", "allow"), event.ALLOW),
        ],
        event.UNKNOWN,
    )


def action(number: Column, word: Column) -> Column:
    return F.when(word == "", F.concat(F.lit("Unknown-"), number)).otherwise(mapped(F.lower(word), VERBS, word))


def volume(low: Column) -> Column:
    """The integer after the first 'bytes ' of a line in lower case."""
    rest = F.when(low.contains("bytes "), F.substr(low, F.instr(low, "bytes "))).otherwise("")
    return F.coalesce(first_group(rest, r"^bytes +([+-]?[0-9]+)").try_cast("long"), F.lit(0).cast("long"))


def excerpt(text: Column, most: int) -> Column:
    """The beginning of a text, for messages; an ellipsis stands for what is left out."""
    return F.concat(F.left(text, F.lit(most)), F.when(F.length(text) > most, "…").otherwise(""))


def timestamp(raw: Column) -> Column:
    """Milliseconds of the first 20 characters after a priority, as 'Jan 02 2006 15:04:05' in UTC; null if they are none."""
    text = F.substr(F.ltrim(raw, F.lit("<0123456789> ")), F.lit(1), F.lit(20))
    text = F.regexp_replace(text, " +", " ")
    good = text.rlike(r"^(?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec) [0-9]{1,2} [0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2}$")
    return F.unix_millis(F.when(good, F.try_to_timestamp(F.initcap(text), F.lit("MMM d yyyy H:mm:ss"))))


def parse(line: Column, s: dict[str, Column], ingest_ms: Column) -> dict[str, Column]:
    raw, grade, number, message, proto, low = (s[n] for n in ("raw", "grade", "number", "message", "proto", "low_raw"))
    failed = has_any(s["low"], "deny", "denied", "failed", "error")
    source, target = s["from"], s["to"]
    uid = event.uuid_shaped(F.concat(F.lit(NAME), raw))
    stamp = timestamp(raw)
    return {
        "class_uid": F.lit(event.NETWORK),
        "activity": activity(number, s["low"]),
        "severity_id": mapped(grade, SEVERITY, 1),
        "status_id": F.when(failed, 2).otherwise(1),
        "status": F.when(failed, "Failure").otherwise("Success"),
        "message": message,
        "time": F.coalesce(stamp, ingest_ms),
        "product": F.lit("ASA"),
        "vendor": F.lit("Cisco"),
        "version": F.lit("9.x"),
        "uid": uid,
        "correlation": uid,
        "raw": raw,
        "src_ip": F.coalesce(source["ip"], F.lit("")),
        "src_port": F.coalesce(source["port"], F.lit(0)),
        "dst_ip": F.coalesce(target["ip"], F.lit("")),
        "dst_port": F.coalesce(target["port"], F.lit(0)),
        "protocol_name": proto,
        "protocol_num": mapped(proto, PROTOCOL, 0),
        "direction": choose([(low.contains("outbound"), "outbound"), (low.contains("inbound"), "inbound")], "unknown"),
        "action": action(number, s["word"]),
        "bytes": volume(low),
        "unmapped": entries(("asa.message_id", number), ("asa.severity", grade), ("asa.connection_id", first_group(raw, r"connection[ \t\n\f\r]+([0-9]+)"))),
        "time_source": F.when(stamp.isNotNull(), "line").otherwise("ingest"),
        "error": F.when(s["header"] == "", F.concat(F.lit('cisco_asa: no %ASA-sev-id header: "'), excerpt(raw, 80), F.lit('"'))),
    }
