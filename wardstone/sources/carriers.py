"""Log lines rendered from the columns of ``events``, so that a parser's result can be held against those columns.

The expressions are plain SQL that Spark and DuckDB read alike; only the dates of the base differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COMMON = """event_id, user_id, event_type,
  '192.168.' || (user_id % 250) || '.' || (event_id % 250) AS ip_in,
  '203.0.' || (event_id % 113) || '.' || (user_id % 200) AS ip_out,
  1024 + event_id % 60000 AS port_in,
  CASE event_id % 4 WHEN 0 THEN 22 WHEN 1 THEN 53 WHEN 2 THEN 80 ELSE 443 END AS port_out,
  60 + (event_id * 37) % 200000 AS volume, 10000 + event_id AS conn"""

BASE_DUCK = f"""base AS (SELECT {_COMMON}, epoch_us(ts) // 1000000 AS sec, strftime(ts, '%b %d %Y %H:%M:%S') AS dated,
  strftime(ts, '%b %d %H:%M:%S') AS undated, strftime(ts, '%Y-%m-%d') AS ymd, strftime(ts, '%H:%M:%S') AS hms, ts FROM events)"""

_SPARK_DATES = {"dated": "MMM dd yyyy HH:mm:ss", "undated": "MMM dd HH:mm:ss", "ymd": "yyyy-MM-dd", "hms": "HH:mm:ss"}

_NET = "'IN=eth0 OUT= MAC=90:10:20:76 SRC=' || ip_out || ' DST=' || ip_in || ' LEN=60 TOS=0x00 TTL=' || (32 + event_id % 200) || ' ID=' || user_id || ' DF PROTO='"
_PORTS = "' SPT=' || port_in || ' DPT=' || port_out || ' SYN'"

#: Shapes: event_id % 7.
LINUX = f"""undated || ' host' || (user_id % 7) || ' ' || CASE event_id % 7
  WHEN 0 THEN 'kernel: [UFW BLOCK] ' || {_NET} || 'TCP' || {_PORTS}
  WHEN 1 THEN 'kernel: [UFW ALLOW] ' || {_NET} || 'UDP' || {_PORTS}
  WHEN 2 THEN 'kernel: [IPTABLES-DROP] ' || {_NET} || 'TCP' || {_PORTS}
  WHEN 3 THEN 'kernel: [NEW SSH] ' || {_NET} || 'TCP' || {_PORTS}
  WHEN 4 THEN 'sshd[' || conn || ']: Failed password for invalid user u' || user_id || ' from ' || ip_out || ' port ' || port_in || ' ssh2'
  WHEN 5 THEN 'sshd[' || conn || ']: Accepted password for u' || user_id || ' from ' || ip_out || ' port ' || port_in || ' ssh2'
  ELSE 'kernel: [fw] IN=eth0 OUT=eth1 SRC=' || ip_out || ' DST=' || ip_in || ' PROTO=icmp SPT=' || (65000 + event_id % 1000) || ' TYPE=8' END"""

_FLOW = "'srcip=' || ip_in || ' dstip=' || ip_out || ' srcport=' || port_in || ' dstport=' || port_out || ' '"

#: Shapes: event_id % 6.
FORTIGATE = f"""CASE WHEN event_id % 4 = 0 THEN '<190>' ELSE '' END || 'date=' || ymd || ' time=' || hms || ' logid="000000001' || (event_id % 6) || '" ' || CASE event_id % 6
  WHEN 0 THEN 'type="traffic" subtype="forward" level="notice" eventtime=' || sec || ' ' || {_FLOW} || 'proto=6 service="HTTPS" action="accept" policyid=1 sessionid=' || conn || ' bytes=' || volume || ' packets=' || (1 + event_id % 90) || ' app="Web: a, b=c"'
  WHEN 1 THEN 'type="traffic" subtype="forward" level="notice" eventtime=' || sec || ' ' || {_FLOW} || 'proto=17 service="DNS" action="deny" msg="Denied by policy ' || user_id || '"'
  WHEN 2 THEN 'type="utm" subtype="virus" level="warning" eventtime=' || sec || ' ' || {_FLOW} || 'proto=6 action="blocked" virus="EICAR-' || (event_id % 10) || '" filename="a' || chr(92) || '"b' || chr(92) || chr(92) || 'c"'
  WHEN 3 THEN 'type="utm" subtype="IPS" level="alert" eventtime=' || sec || ' ' || {_FLOW} || 'proto=6 action="dropped" attack="X.' || (event_id % 10) || '" severity="high" severity="low"'
  WHEN 4 THEN 'type="event" subtype="vpn" level="critical" srcip=' || ip_out || ' action="ssl-login" user=u' || user_id || ' logdesc="SSL VPN" service="Web"'
  ELSE 'type="utm" subtype="webfilter" level="warning" eventtime=' || sec || ' ' || {_FLOW} || 'proto=6 direction="outgoing" action="blocked" bare hostname="h.example" url="/p?a=1&b=2"' END"""

_PAIR = "outside:' || ip_out || '/' || port_out || '"
_INNER = "inside:' || ip_in || '/' || port_in || '"

#: Shapes: event_id % 9.
CISCO_ASA = f"""CASE event_id % 3 WHEN 0 THEN '<134>' || dated || ': ' WHEN 1 THEN dated || ' fw1 : ' ELSE '<166>' || dated || ' fw2: ' END || '%ASA-' || CASE event_id % 9
  WHEN 0 THEN '6-302013: Built outbound TCP connection ' || conn || ' for {_PAIR} (' || ip_out || '/' || port_out || ') to {_INNER} (' || ip_in || '/' || port_in || ')'
  WHEN 1 THEN '6-302014: Teardown TCP connection ' || conn || ' for {_PAIR} to {_INNER} duration 0:00:14 bytes ' || volume || ' TCP FINs'
  WHEN 2 THEN '4-106023: Deny udp src {_PAIR} dst {_INNER} by access-group "acl"'
  WHEN 3 THEN '6-106100: access-list acl permitted tcp inside/' || ip_in || '(' || port_in || ') -> outside/' || ip_out || '(' || port_out || ') hit-cnt 1'
  WHEN 4 THEN '6-106015: Deny TCP (no connection) from ' || ip_out || '/' || port_out || ' to ' || ip_in || '/' || port_in || ' flags RST'
  WHEN 5 THEN '6-725001: Starting SSL handshake with client from ' || ip_out || '/' || port_out || ' of session'
  WHEN 6 THEN '6-602101: PMTU-D packet 1420 bytes greater than effective mtu for IP ' || ip_in
  WHEN 7 THEN '5-111008: User enable_15 executed the write command'
  ELSE '3-305006: portmap translation creation failed for icmp src inside:' || ip_in || ' dst outside:' || ip_out END"""

_HEAD = """'{"timestamp": "' || ymd || 'T' || hms || '.250000+0100", "flow_id": ' || conn || ', "event_type": "'"""
_ENDS = """'", "src_ip": "' || ip_out || '", "src_port": ' || port_out || ', "dest_ip": "' || ip_in || '", "dest_port": ' || port_in || ', "proto": "'"""

#: Shapes: event_id % 4.
SURICATA = f"""{_HEAD} || CASE event_id % 4
  WHEN 0 THEN 'alert' || {_ENDS} || 'TCP", "pcap_cnt": ' || event_id || ', "alert": {{"action": "allowed", "gid": 1, "signature_id": ' || (2000000 + event_id % 50) || ', "rev": 3, "signature": "SIG ' || (event_id % 50) || '", "category": "Cat ' || (event_id % 7) || '", "severity": ' || (1 + event_id % 5) || '}}, "flow": {{"pkts_toserver": ' || (event_id % 9) || ', "pkts_toclient": 2, "bytes_toserver": ' || volume || ', "bytes_toclient": 100}}}}'
  WHEN 1 THEN 'http' || {_ENDS} || 'tcp", "app_proto": "http", "http": {{"hostname": "h", "url": "/x", "status": 200}}}}'
  WHEN 2 THEN 'dns' || {_ENDS} || 'UDP", "dns": {{"type": "query", "rrname": "a.b"}}}}'
  ELSE 'flow' || {_ENDS} || 'IPv6-ICMP", "flow": {{"pkts_toserver": 1, "pkts_toclient": 0, "bytes_toserver": ' || volume || ', "bytes_toclient": 0}}}}' END"""

NOISE = "'plain text ' || event_id"

LINES = {"fortigate": FORTIGATE, "linux": LINUX, "cisco_asa": CISCO_ASA, "suricata": SURICATA}
#: All vendors in turn, by event_id % 5; the shape still depends on the event_id as above.
MIXED = f"CASE event_id % 5 WHEN 0 THEN {FORTIGATE} WHEN 1 THEN {LINUX} WHEN 2 THEN {CISCO_ASA} WHEN 3 THEN {SURICATA} ELSE {NOISE} END"


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with the columns that lines are rendered from."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.selectExpr(*[x.strip() for x in _split(_COMMON)], "ts", "unix_seconds(ts) AS sec")
    return e.withColumns({n: F.date_format("ts", p) for n, p in _SPARK_DATES.items()})


def _split(select: str) -> list[str]:
    """The items of a select list."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(select):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(select[at:i])
            at = i + 1
    return [*out, select[at:]]


def lines(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Rows of ``events`` with ``value``, a line of that vendor (or 'mixed')."""
    return rendered(base(spark, sf_dir), MIXED if kind == "mixed" else LINES[kind])


def rendered(df: DataFrame, line: str) -> DataFrame:
    """Adds ``value``. The generator keeps filters on lines above their rendering, as they would stand above a scan of text."""
    return df.select("*", F.explode(F.array(F.expr(line))).alias("value"))
