"""Synthetic log lines: a pure function of (n, seed), in integer arithmetic that any SQL engine repeats.

Seed 0 takes the clock; n <= 0 gives no line.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START = 1_704_067_200


def draw(k: int, seed: int, below: int) -> str:
    """SQL for the k-th draw of row i, from 0 to below - 1."""
    return f"((((i + 1) * {48271 + 2 * k} + {seed} * 69621 + {k} * 16807) % 2147483647 * 40692) % 2147483399 // 11 % {below})"


def _addresses(seed: int) -> dict[str, str]:
    inner = f"'10.' || {draw(1, seed, 4)} || '.' || {draw(2, seed, 250)} || '.' || {draw(3, seed, 250)}"
    outer = f"'203.0.' || {draw(4, seed, 113)} || '.' || {draw(5, seed, 250)}"
    port = f"CASE {draw(6, seed, 5)} WHEN 0 THEN 22 WHEN 1 THEN 53 WHEN 2 THEN 80 WHEN 3 THEN 443 ELSE 8443 END"
    return {"ip_in": inner, "ip_out": outer, "port_in": f"(1024 + {draw(7, seed, 60000)})", "port_out": port, "volume": draw(8, seed, 200000), "conn": "(10000 + i)"}


def _case(of: str, arms: list[str]) -> str:
    return f"CASE {of} " + " ".join(f"WHEN {i} THEN {a}" for i, a in enumerate(arms)) + " END"


_OUT, _IN = "outside:' || ip_out || '/' || port_out || '", "inside:' || ip_in || '/' || port_in || '"
_KV = "srcip=' || ip_in || ' srcport=' || port_in || ' dstip=' || ip_out || ' dstport=' || port_out || ' proto="
_SRC = "IN=eth0 OUT= SRC=' || ip_out || ' DST=' || ip_in || ' LEN=60 TTL=64 ID=' || conn || ' PROTO="

ASA = [
    f"'6-302013: Built outbound TCP connection ' || conn || ' for {_OUT} to {_IN}'",
    f"'6-302014: Teardown TCP connection ' || conn || ' for {_OUT} to {_IN} duration 0:01:02 bytes ' || volume",
    f"'6-302015: Built inbound UDP connection ' || conn || ' for {_OUT} to {_IN}'",
    f"'6-302016: Teardown UDP connection ' || conn || ' for {_OUT} to {_IN} duration 0:00:30 bytes ' || volume",
    f"'6-302018: Built outbound TCP connection ' || conn || ' for {_OUT} to {_IN}'",
    f"'6-302021: Teardown ICMP connection ' || conn || ' for {_OUT} to {_IN} bytes ' || volume",
    f"'6-305011: Built dynamic TCP translation from {_IN} to {_OUT}'",
    f"'6-305012: Teardown dynamic TCP translation from {_IN} to {_OUT}'",
    f"'4-106023: Deny tcp src {_OUT} dst {_IN} by access-group acl'",
    "'6-106100: access-list acl permitted tcp inside/' || ip_in || '(' || port_in || ') -> outside/' || ip_out || '(' || port_out || ') hit-cnt 1'",
    "'6-106015: Deny TCP (no connection) from ' || ip_out || '/' || port_out || ' to ' || ip_in || '/' || port_in || ' flags RST'",
    "'6-725001: Starting SSL handshake with client from ' || ip_out || '/' || port_out || ' of session'",
    f"'4-313004: Deny ICMP type=0 from {_OUT} on interface outside'",
    f"'3-305006: portmap translation creation failed for tcp src {_IN} dst {_OUT}'",
    "'4-402119: IPSEC: Received an ESP packet from ' || ip_out || ' to ' || ip_in || ' that failed anti-replay checking'",
    "'6-110002: Failed to locate egress interface for TCP from ' || ip_in || '/' || port_in || ' to ' || ip_out || '/' || port_out",
]

FORTIGATE = [
    f"'type=\"traffic\" subtype=\"forward\" level=\"notice\" {_KV}6 action=\"accept\" bytes=' || volume || ' packets=7'",
    f"'type=\"traffic\" subtype=\"forward\" level=\"notice\" {_KV}17 action=\"deny\" msg=\"Denied by policy\"'",
    f"'type=\"traffic\" subtype=\"local\" level=\"notice\" {_KV}6 action=\"accept\"'",
    f"'type=\"utm\" subtype=\"virus\" level=\"warning\" {_KV}6 action=\"blocked\" virus=\"EICAR\"'",
    f"'type=\"utm\" subtype=\"ips\" level=\"alert\" {_KV}6 action=\"dropped\" attack=\"X.Y\"'",
    f"'type=\"utm\" subtype=\"app-ctrl\" level=\"information\" {_KV}6 action=\"pass\" app=\"Web\"'",
    "'type=\"event\" subtype=\"system\" level=\"warning\" logdesc=\"Interface changed\" status=\"up\"'",
    "'type=\"event\" subtype=\"user\" level=\"notice\" srcip=' || ip_in || ' action=\"login\" user=\"admin\"'",
    "'type=\"event\" subtype=\"vpn\" level=\"information\" srcip=' || ip_out || ' action=\"ssl-login\" user=\"u\"'",
    f"'type=\"utm\" subtype=\"webfilter\" level=\"warning\" {_KV}6 action=\"blocked\" hostname=\"h.example\"'",
    f"'type=\"utm\" subtype=\"webfilter\" level=\"warning\" {_KV}6 action=\"blocked\" hostname=\"w.example\"'",
]

LINUX = [
    f"'kernel: [UFW BLOCK] {_SRC}TCP SPT=' || port_in || ' DPT=' || port_out",
    f"'kernel: [UFW BLOCK] {_SRC}UDP SPT=' || port_in || ' DPT=' || port_out",
    f"'kernel: [UFW ALLOW] {_SRC}TCP SPT=' || port_in || ' DPT=' || port_out",
    f"'kernel: [IPTABLES-DROP] {_SRC}TCP SPT=' || port_in || ' DPT=' || port_out",
    f"'kernel: [NEW SSH] {_SRC}TCP SPT=' || port_in || ' DPT=22'",
    "'sshd[' || conn || ']: Failed password for root from ' || ip_out || ' port ' || port_in || ' ssh2'",
    "'sshd[' || conn || ']: Accepted password for admin from ' || ip_out || ' port ' || port_in || ' ssh2'",
    f"'kernel: [verdict] {_SRC}ICMP TYPE=8'",
]

_ENDS = "\"src_ip\": \"' || ip_out || '\", \"src_port\": ' || port_out || ', \"dest_ip\": \"' || ip_in || '\", \"dest_port\": ' || port_in || ', \"proto\": "
SURICATA = [
    *[f"""'"event_type": "alert", {_ENDS}"TCP", "alert": {{"action": "allowed", "gid": 1, "signature_id": ' || (2000000 + volume % 10) || ', "rev": 1, "signature": "SIG ' || (volume % 10) || '", "category": "Cat", "severity": {g}}}}}'""" for g in (1, 1, 2, 2, 2, 2, 3, 3, 3, 1, 2, 3)],
    f"""'"event_type": "http", {_ENDS}"TCP", "http": {{"hostname": "h"}}}}'""",
    f"""'"event_type": "dns", {_ENDS}"UDP"}}'""",
    f"""'"event_type": "flow", {_ENDS}"TCP", "flow": {{"pkts_toserver": 3, "pkts_toclient": 2, "bytes_toserver": ' || volume || ', "bytes_toclient": 1}}}}'""",
    f"""'"event_type": "tls", {_ENDS}"TCP"}}'""",
]

SHAPES = {"cisco_asa": ASA, "fortigate": FORTIGATE, "linux": LINUX, "suricata": SURICATA}


def spark_sql(sql: str) -> str:
    """Integer division as Spark writes it."""
    return sql.replace("//", "DIV")


def rows_sql(vendor: str, seed: int) -> list[tuple[str, str]]:
    """(name, SQL) of the columns of a generated row, over a column i."""
    return [*_addresses(seed).items(), ("shape", draw(9, seed, len(SHAPES[vendor])))]


def line_sql(vendor: str, dated: str, undated: str, iso: str, ymd: str, hms: str) -> str:
    body = _case("shape", SHAPES[vendor])
    return {
        "cisco_asa": f"CASE i % 3 WHEN 0 THEN '<134>' || {dated} || ': ' WHEN 1 THEN {dated} || ' fw: ' ELSE '' END || '%ASA-' || {body}",
        "fortigate": f"CASE i % 4 WHEN 0 THEN '<190>' ELSE '' END || 'date=' || {ymd} || ' time=' || {hms} || ' logid=\"0000000013\" eventtime=' || ({START} + i) || ' ' || {body}",
        "linux": f"{undated} || ' host kernel ' || {body}",
        "suricata": f"'{{\"timestamp\": \"' || {iso} || '.000001+0000\", \"flow_id\": ' || conn || ', ' || {body}",
    }[vendor]


def generate(spark: SparkSession, vendor: str, n: int, seed: int = 0) -> DataFrame:
    """n lines of a vendor: i, shape, value."""
    seed = seed or time.time_ns() % 1_000_003 + 1
    return lines_of(spark.range(max(0, n)).withColumnRenamed("id", "i"), vendor, seed)


def lines_of(rows: DataFrame, vendor: str, seed: int, *keep: str) -> DataFrame:
    """The line of each row's number i: i, shape, value, and the columns to keep."""
    df = rows.selectExpr("i", *keep, *[f"{spark_sql(sql)} AS {name}" for name, sql in rows_sql(vendor, seed)])
    at = f"timestamp_seconds({START} + i)"
    form = lambda p: f"date_format({at}, '{p}')"
    line = line_sql(vendor, form("MMM dd yyyy HH:mm:ss"), form("MMM dd HH:mm:ss"), f"replace({form('yyyy-MM-dd HH:mm:ss')}, ' ', 'T')", form("yyyy-MM-dd"), form("HH:mm:ss"))
    return df.select("i", "shape", *keep, F.explode(F.array(F.expr(line))).alias("value"))


def corpus(spark: SparkSession, n_each: int, seed: int = 42) -> DataFrame:
    """n_each lines of every vendor, interleaved by their place: place, vendor, value."""
    out = None
    for k, v in enumerate(("cisco_asa", "fortigate", "suricata", "linux")):
        one = generate(spark, v, n_each, seed).select((F.col("i") * 4 + k).alias("place"), F.lit(v).alias("vendor"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def write_samples(spark: SparkSession, vendor: str, path: str, n: int, seed: int = 0) -> None:
    generate(spark, vendor, n, seed).select("value").write.text(path)
