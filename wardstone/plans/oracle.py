"""DuckDB SQL that computes, from the columns of ``events``, what the parsers have to find in the rendered lines."""

from __future__ import annotations

from ..sources import carriers


def _pick(of: str, *values: str) -> str:
    """The value at a shape's number."""
    return f"CASE {of} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _q(*texts: str) -> list[str]:
    return ["'" + t.replace("'", "''") + "'" for t in texts]


_SHA_UUID = """substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-4' || substr({h}, 14, 3) || '-a' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"""


def uuid_of(source: str) -> str:
    return _SHA_UUID.format(h=f"sha256('{source}' || line)")


_s7, _s6, _s9, _s4 = "event_id % 7", "event_id % 6", "event_id % 9", "event_id % 4"
_net = f"{_s7} < 4"
_alert = f"{_s4} = 0"
_host = "'hostname=host' || (user_id % 7) || ';id='"

LINUX = f"""SELECT event_id, line, 'linux' AS source, 4001 AS class_uid, {_pick(_s7, "2", "1", "2", "2", "2", "1", "0")} AS activity_id,
  {_pick(_s7, "2", "1", "2", "1", "1", "1", "1")} AS severity_id, 0 AS status_id, '' AS status,
  {_pick(_s7, *_q("Linux UFW blocked network traffic", "Linux UFW allowed network traffic", "Linux iptables dropped network traffic", "New SSH connection", "SSH authentication failed", "SSH authentication succeeded", "Linux network/security event"))} AS message,
  sec * 1000 AS time, 'Linux' AS product, 'Linux' AS vendor, '' AS version,
  CASE WHEN {_net} THEN CAST(user_id AS VARCHAR) ELSE sha256(line) END AS uid,
  CASE WHEN {_s7} IN (4, 5) THEN '' ELSE ip_out END AS src_ip, CASE WHEN {_s7} IN (4, 5) THEN '' ELSE ip_in END AS dst_ip,
  CASE WHEN {_net} THEN port_in WHEN {_s7} = 6 AND 65000 + event_id % 1000 <= 65535 THEN 65000 + event_id % 1000 ELSE 0 END AS src_port,
  CASE WHEN {_net} THEN port_out ELSE 0 END AS dst_port,
  {_pick(_s7, *_q("TCP", "UDP", "TCP", "TCP", "", "", "ICMP"))} AS protocol_name, {_pick(_s7, "6", "17", "6", "6", "0", "0", "1")} AS protocol_num,
  {_pick(_s7, *_q("Inbound", "Inbound", "Inbound", "Inbound", "", "", "Bidirectional"))} AS direction,
  {_pick(_s7, *_q("BLOCK", "ALLOW", "DROP", "NEW", "FAIL", "ACCEPT", "UNKNOWN"))} AS action, 0 AS packets, 0 AS bytes, '' AS finding_info, '' AS confidence,
  CASE WHEN {_net} THEN {_host} || user_id || ';interface_in=eth0;length=60;mac=90:10:20:76;tos=0x00;ttl=' || (32 + event_id % 200)
       WHEN {_s7} = 6 THEN {_host} || sha256(line) || ';interface_in=eth0;interface_out=eth1'
       ELSE {_host} || sha256(line) || ';service=sshd;user=u' || user_id END AS unmapped,
  CASE WHEN {_s7} IN (4, 5) THEN '' ELSE 'source_ip=' || ip_out || ';destination_ip=' || ip_in END AS observables
FROM lined"""

FORTIGATE = f"""SELECT event_id, line, 'fortigate' AS source, CASE WHEN {_s6} IN (2, 3) THEN 2004 ELSE 4001 END AS class_uid,
  {_pick(_s6, "1", "2", "1", "1", "1", "2")} AS activity_id, {_pick(_s6, "1", "1", "3", "4", "5", "3")} AS severity_id, 0 AS status_id, '' AS status,
  CASE {_s6} WHEN 1 THEN 'Denied by policy ' || user_id WHEN 4 THEN 'SSL VPN' ELSE '' END AS message, sec * 1000 AS time,
  'FortiGate' AS product, 'Fortinet' AS vendor, '' AS version, {uuid_of("fortigate")} AS uid,
  CASE WHEN {_s6} = 4 THEN ip_out ELSE ip_in END AS src_ip, CASE WHEN {_s6} = 4 THEN '' ELSE ip_out END AS dst_ip,
  CASE WHEN {_s6} = 4 THEN 0 ELSE port_in END AS src_port, CASE WHEN {_s6} = 4 THEN 0 ELSE port_out END AS dst_port,
  {_pick(_s6, *_q("tcp", "udp", "tcp", "tcp", "web", "tcp"))} AS protocol_name, {_pick(_s6, "6", "17", "6", "6", "0", "6")} AS protocol_num,
  CASE WHEN {_s6} = 5 THEN 'outgoing' ELSE '' END AS direction, {_pick(_s6, *_q("accept", "deny", "blocked", "dropped", "ssl-login", "blocked"))} AS action,
  CASE WHEN {_s6} = 0 THEN 1 + event_id % 90 ELSE 0 END AS packets, CASE WHEN {_s6} = 0 THEN volume ELSE 0 END AS bytes,
  CASE {_s6} WHEN 2 THEN 'EICAR-' || (event_id % 10) WHEN 3 THEN 'X.' || (event_id % 10) ELSE '' END AS finding_info, '' AS confidence,
  CASE {_s6} WHEN 0 THEN 'app=Web: a, b=c;policyid=1;sessionid=' || conn WHEN 1 THEN '' WHEN 2 THEN 'filename=a"b' || chr(92) || 'c'
    WHEN 3 THEN 'severity=low' WHEN 4 THEN 'user=u' || user_id ELSE 'hostname=h.example;url=/p?a=1&b=2' END AS unmapped, '' AS observables
FROM lined"""

_ids = ["302013", "302014", "106023", "106100", "106015", "725001", "602101", "111008", "305006"]
_grades = "664666653"
_named = f"{_s9} IN (0, 1, 2, 4, 5)"

CISCO_ASA = f"""SELECT event_id, line, 'cisco_asa' AS source, 4001 AS class_uid, {_pick(_s9, *"112121102")} AS activity_id, {_pick(_s9, *"113111124")} AS severity_id,
  CASE WHEN {_s9} IN (2, 4, 8) THEN 2 ELSE 1 END AS status_id, CASE WHEN {_s9} IN (2, 4, 8) THEN 'Failure' ELSE 'Success' END AS status,
  substr(line, strpos(line, '%ASA-') + 15) AS message, sec * 1000 AS time, 'ASA' AS product, 'Cisco' AS vendor, '9.x' AS version, {uuid_of("cisco_asa")} AS uid,
  CASE WHEN {_named} THEN ip_out WHEN {_s9} IN (3, 8) THEN ip_in ELSE '' END AS src_ip,
  CASE WHEN {_s9} IN (0, 1, 2, 4, 6) THEN ip_in WHEN {_s9} IN (3, 8) THEN ip_out ELSE '' END AS dst_ip,
  CASE WHEN {_named} THEN port_out WHEN {_s9} = 3 THEN port_in ELSE 0 END AS src_port,
  CASE WHEN {_s9} IN (0, 1, 2, 4) THEN port_in WHEN {_s9} = 3 THEN port_out ELSE 0 END AS dst_port,
  {_pick(_s9, *_q("tcp", "tcp", "udp", "tcp", "tcp", "", "", "", "icmp"))} AS protocol_name, {_pick(_s9, "6", "6", "17", "6", "6", "0", "0", "0", "1")} AS protocol_num,
  CASE WHEN {_s9} = 0 THEN 'outbound' ELSE 'unknown' END AS direction,
  {_pick(_s9, *_q("Built", "Teardown", "Deny", "access-list", "Deny", "Starting", "PMTU-D", "User", "portmap"))} AS action,
  0 AS packets, CASE WHEN {_s9} = 1 THEN volume ELSE 0 END AS bytes, '' AS finding_info, '' AS confidence,
  CASE WHEN {_s9} < 2 THEN 'asa.connection_id=' || conn || ';' ELSE '' END || 'asa.message_id=' || {_pick(_s9, *_q(*_ids))} || ';asa.severity=' || {_pick(_s9, *_q(*_grades))} AS unmapped,
  '' AS observables
FROM lined"""

_kind = _pick(_s4, *_q("alert", "http", "dns", "flow"))

SURICATA = f"""SELECT event_id, line, 'suricata' AS source, CASE WHEN {_alert} THEN 2004 ELSE 4001 END AS class_uid, 1 AS activity_id,
  CASE WHEN {_alert} THEN {_pick("event_id % 5", "4", "3", "2", "2", "2")} ELSE 1 END AS severity_id,
  CASE WHEN {_alert} THEN 99 ELSE 1 END AS status_id, CASE WHEN {_alert} THEN 'Other' ELSE 'Success' END AS status,
  CASE WHEN {_alert} THEN 'SIG ' || (event_id % 50) ELSE 'Suricata ' || {_kind} || ' event' END AS message, (sec - 3600) * 1000 + 250 AS time,
  'Suricata' AS product, 'OISF' AS vendor, '6.x' AS version, {uuid_of("suricata")} AS uid, ip_out AS src_ip, ip_in AS dst_ip, port_out AS src_port, port_in AS dst_port,
  {_pick(_s4, *_q("tcp", "tcp", "udp", "ipv6-icmp"))} AS protocol_name, {_pick(_s4, "6", "6", "17", "0")} AS protocol_num, 'unknown' AS direction,
  CASE WHEN {_alert} THEN 'allowed' ELSE {_kind} END AS action, CASE {_s4} WHEN 0 THEN event_id % 9 + 2 WHEN 3 THEN 1 ELSE 0 END AS packets,
  CASE {_s4} WHEN 0 THEN volume + 100 WHEN 3 THEN volume ELSE 0 END AS bytes, CASE WHEN {_alert} THEN 'SIG ' || (event_id % 50) ELSE '' END AS finding_info,
  CASE WHEN {_alert} THEN 'Cat ' || (event_id % 7) ELSE '' END AS confidence,
  CASE {_s4} WHEN 0 THEN 'suricata.category=Cat ' || (event_id % 7) || ';suricata.event_type=alert;suricata.flow_id=' || conn || ';suricata.gid=1;'
      || CASE WHEN event_id <> 0 THEN 'suricata.pcap_cnt=' || event_id || ';' ELSE '' END || 'suricata.rev=3;suricata.signature_id=' || (2000000 + event_id % 50)
    WHEN 1 THEN 'suricata.app_proto=http;suricata.event_type=http;suricata.flow_id=' || conn ELSE 'suricata.event_type=' || {_kind} || ';suricata.flow_id=' || conn END AS unmapped,
  '' AS observables
FROM lined"""

CORE = {"fortigate": FORTIGATE, "linux": LINUX, "cisco_asa": CISCO_ASA, "suricata": SURICATA}
TURN = {"fortigate": 0, "linux": 1, "cisco_asa": 2, "suricata": 3}

_NAMED = """SELECT event_id, source, line AS raw_data, CAST(class_uid AS INTEGER) AS class_uid, CASE class_uid WHEN 4001 THEN 'Network Activity' ELSE 'Detection Finding' END AS class_name,
  CASE class_uid WHEN 4001 THEN 4 ELSE 2 END AS category_uid, CASE class_uid WHEN 4001 THEN 'Network Activity' ELSE 'Findings' END AS category_name,
  CAST(activity_id AS INTEGER) AS activity_id,
  CASE WHEN class_uid = 2004 THEN CASE activity_id WHEN 1 THEN 'Create' ELSE 'Unknown' END ELSE CASE activity_id WHEN 1 THEN 'Allow' WHEN 2 THEN 'Deny' ELSE 'Unknown' END END AS activity_name,
  CAST(class_uid * 100 + activity_id AS BIGINT) AS type_uid, CAST(severity_id AS INTEGER) AS severity_id,
  CASE severity_id WHEN 1 THEN 'Informational' WHEN 2 THEN 'Low' WHEN 3 THEN 'Medium' WHEN 4 THEN 'High' WHEN 5 THEN 'Critical' ELSE 'Unknown' END AS severity,
  CAST(status_id AS INTEGER) AS status_id, status, message, CAST(time AS BIGINT) AS time, product, vendor, version, uid, sha256(line) AS raw_data_hash, CAST(strlen(line) AS INTEGER) AS raw_data_size,
  src_ip, CAST(src_port AS BIGINT) AS src_port, dst_ip, CAST(dst_port AS BIGINT) AS dst_port, protocol_name, CAST(protocol_num AS BIGINT) AS protocol_num, direction, action,
  CAST(packets AS BIGINT) AS packets, CAST(bytes AS BIGINT) AS bytes, finding_info, confidence, unmapped, observables FROM core"""


def with_events(kind: str) -> str:
    """WITH ..., n AS (one row per valid event of that vendor, or of the mixed lines)."""
    if kind == "mixed":
        core = " UNION ALL BY NAME ".join(f"SELECT * FROM ({CORE[v]}) WHERE event_id % 5 = {t}" for v, t in TURN.items())
        line = carriers.MIXED
    else:
        core, line = CORE[kind], carriers.LINES[kind]
    return f"""WITH {carriers.BASE_DUCK}, lined AS (SELECT *, {line} AS line FROM base), core AS ({core}),
named AS ({_NAMED}), n AS (SELECT *, class_name || ': ' || activity_name AS type_name FROM named)
"""
