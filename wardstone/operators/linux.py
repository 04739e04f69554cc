"""Linux netfilter, UFW and sshd logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import event
from ..functions.text import choose, entries, first_group, found, has_any, mapped, or_null, trimmed

NAME = "linux"

# Fixed values.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
PROTOCOL = {"TCP": 6, "UDP": 17, "ICMP": 1, "ICMPV6": 58}
ACTIVITY = {"ALLOW": 1, "ACCEPT": 1, "BLOCK": 6, "DROP": 6, "FAIL": 6, "NEW": 6}
ACTIONS = [
    ("[UFW BLOCK]", "BLOCK"),
    ("[IPTABLES-DROP]", "DROP"),
    ("[UFW ALLOW]", "ALLOW"),
    ("Failed password", "FAIL"),
    ("Accepted password", "ACCEPT"),
    ("[NEW SSH]", "NEW"),
]
MESSAGES = [
    ("[UFW BLOCK]", "Linux UFW blocked network traffic"),
    ("[UFW ALLOW]", "Linux UFW allowed network traffic"),
    ("[IPTABLES-DROP]", "Linux iptables dropped network traffic"),
    ("Failed password", "SSH authentication failed"),
    ("Accepted password", "SSH authentication succeeded"),
    ("[NEW SSH]", "New SSH connection"),
]

#: KEY=value after white space or at the beginning.
PAIR = r"(?<![^ \t\n\f\r])([A-Z]++)=([^ \t\n\f\r]*+)"
STAMP = r"^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[ \t]+([0-9]{1,2})[ \t]+([0-9]{2}):([0-9]{2}):([0-9]{2})"


def detect(line: Column) -> Column:
    return (line.contains("SRC=") & line.contains("DST=")) | has_any(line, "[UFW", "[IPTABLES-DROP]", "sshd[")


KEYS = ["SRC", "DST", "SPT", "DPT", "PROTO", "IN", "OUT", "MAC", "LEN", "TOS", "TTL", "ID"]


def _raw(line: Column, s: dict[str, Column]) -> dict[str, Column]:
    return {"raw": trimmed(line)}


def _tokens(line: Column, s: dict[str, Column]) -> dict[str, Column]:
    raw = s["raw"]
    pick = lambda g: F.regexp_extract_all(raw, F.lit(PAIR), F.lit(g))
    return {
        "keys": pick(1),
        "values": pick(2),
        "stamp": first_group(raw, STAMP, 0),
        "audit": F.when(raw.contains("audit("), first_group(raw, r"audit\((\d+)")),
        "action": choose([(raw.contains(tag), name) for tag, name in ACTIONS], "UNKNOWN"),
        "digest": event.digest(raw),
    }


def _fields(line: Column, s: dict[str, Column]) -> dict[str, Column]:
    part = F.split(s["stamp"], r"[ \t:]+")
    number = lambda i: F.coalesce(F.get(part, F.lit(i)).try_cast("int"), F.lit(-1))
    return {
        **{k: found(s["keys"], s["values"], k) for k in KEYS},
        "month": F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.coalesce(F.get(part, F.lit(0)), F.lit(""))).cast("int"),
        **{n: number(i) for i, n in enumerate(("day", "hour", "minute", "second"), 1)},
    }


#: What each step adds to the columns that parse() finds.
STEPS = (_raw, _tokens, _fields)


def port(text: Column) -> Column:
    n = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("long"))
    return F.when(n.between(0, 65535), n).otherwise(0)


def direction(inward: Column, outward: Column) -> Column:
    return choose([((inward != "") & (outward != ""), "Bidirectional"), (inward != "", "Inbound"), (outward != "", "Outbound")], "")


def hostname(raw: Column) -> Column:
    """The fourth word behind a stamp, else the first without a colon, if there are so many."""
    stamped = first_group(raw, rf"^(?:{'|'.join(MONTHS)})\s+\S+\s+\S+\s+(\S+)")
    return F.coalesce(or_null(stamped), first_group(raw, r"^(\S*?):?\s"))


def ssh_user(raw: Column) -> Column:
    pick = lambda p: or_null(first_group(raw, p))
    return F.coalesce(
        pick(r"Failed password for invalid user\s+(\S+)"), pick(r"Failed password for\s+(\S+)"), pick(r"Accepted password for\s+(\S+)"), F.lit("")
    )


def timestamp(s: dict[str, Column], year: Column, zone: str) -> Column:
    """Milliseconds of a leading stamp in the assumed year and zone, or of an audit stamp; null without either.

    A day beyond the month's end runs on into the next month.
    """
    good = (s["month"] > 0) & s["day"].between(1, 31) & (s["hour"] <= 23) & (s["minute"] <= 59) & (s["second"] <= 59)
    least = lambda n, v: F.greatest(s[n], F.lit(v))
    first = F.try_make_timestamp(year, least("month", 1), F.lit(1), least("hour", 0), least("minute", 0), least("second", 0).cast("decimal(8,6)"), F.lit(zone))
    stamp = F.when(good, F.unix_millis(first + F.make_dt_interval(s["day"] - 1)))
    return F.coalesce(stamp, F.try_multiply(s["audit"].try_cast("long"), F.lit(1000).cast("long")))


def parse(line: Column, s: dict[str, Column], ingest_ms: Column, year: Column, zone: str) -> dict[str, Column]:
    raw = s["raw"]
    kv = lambda key: s[key]
    action = s["action"]
    uid = F.coalesce(or_null(kv("ID")), s["digest"])
    proto = F.upper(kv("PROTO"))
    seen = lambda name, v: F.when(v != "", F.struct(F.lit(name).alias("name"), F.lit("ip").alias("type"), v.alias("value")))
    stamp = timestamp(s, year, zone)
    ssh = raw.contains("sshd[")
    return {
        "class_uid": F.lit(event.NETWORK),
        "activity": mapped(action, ACTIVITY, 0),
        "severity_id": F.when(has_any(raw, "[UFW BLOCK]", "[IPTABLES-DROP]"), 2).otherwise(1),
        "message": choose([(raw.contains(tag), text) for tag, text in MESSAGES], "Linux network/security event"),
        "time": F.coalesce(stamp, ingest_ms),
        "product": F.lit("Linux"),
        "vendor": F.lit("Linux"),
        "uid": uid,
        "raw": raw,
        "src_ip": kv("SRC"),
        "src_port": port(kv("SPT")),
        "dst_ip": kv("DST"),
        "dst_port": port(kv("DPT")),
        "protocol_name": proto,
        "protocol_num": mapped(proto, PROTOCOL, 0),
        "direction": direction(kv("IN"), kv("OUT")),
        "action": action,
        "observables": F.filter(F.array(seen("source_ip", kv("SRC")), seen("destination_ip", kv("DST"))), lambda o: o.isNotNull()),
        "unmapped": entries(
            ("hostname", hostname(raw)),
            ("interface_in", kv("IN")),
            ("interface_out", kv("OUT")),
            ("mac", kv("MAC")),
            ("length", kv("LEN")),
            ("tos", kv("TOS")),
            ("ttl", kv("TTL")),
            ("id", uid),
            ("service", F.when(ssh, "sshd")),
            ("user", F.when(ssh, ssh_user(raw))),
        ),
        "time_source": F.when(stamp.isNotNull(), "line").otherwise("ingest"),
        "error": F.when(raw == "", "linux: empty line"),
    }
