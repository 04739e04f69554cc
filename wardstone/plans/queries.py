"""One registered query for each operator, and DuckDB SQL for what it must return."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import event
from ..functions.text import is_ipv4, is_ipv4_shaped
from ..operators import export, fortigate
from ..operators import registry as sources
from ..sources import carriers, synth
from ..sources import lines as text_lines
from ..streaming import pipeline
from . import analytics, oracle, store
from .normalize import accepted, flat, normalize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: What lines without a stamp get, and the year of Linux stamps, in these queries.
INGEST, YEAR = 1_700_000_000_000, 2024


def parsed(df: DataFrame, *keep: str, **options) -> DataFrame:
    return flat(normalize(df, ingest_ms=INGEST, assume_year=YEAR, **options), *keep)


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


# Fields of each vendor's events -------------------------------------------------------------------------------------


def _vendor(name: str, kind: str, *columns: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return parsed(carriers.lines(spark, sf_dir, kind), "event_id").select("event_id", *columns)

    _add(name, query, oracle.with_events(kind) + f"SELECT event_id, {', '.join(columns)} FROM n")


_vendor("asa_header_severity", "cisco_asa", "source", "severity_id", "severity", "message", "product", "vendor", "version")
_vendor("asa_activity_status", "cisco_asa", "class_uid", "activity_id", "activity_name", "type_uid", "type_name", "status_id", "status")
_vendor("asa_action", "cisco_asa", "action")
_vendor("asa_proto_direction", "cisco_asa", "protocol_name", "protocol_num", "direction")
_vendor("asa_endpoints", "cisco_asa", "src_ip", "src_port", "dst_ip", "dst_port")
_vendor("asa_traffic", "cisco_asa", "packets", "bytes")
_vendor("asa_time", "cisco_asa", "time")
_vendor("asa_unmapped", "cisco_asa", "unmapped", "uid")
_vendor("fgt_class_activity", "fortigate", "class_uid", "category_uid", "category_name", "activity_id", "activity_name", "type_uid", "type_name")
_vendor("fgt_severity_proto", "fortigate", "severity_id", "severity", "protocol_name", "protocol_num", "message")
_vendor("fgt_time", "fortigate", "time")
_vendor("fgt_traffic_endpoints", "fortigate", "src_ip", "src_port", "dst_ip", "dst_port", "direction", "action", "packets", "bytes", "finding_info")
_vendor("fgt_unmapped", "fortigate", "unmapped", "uid", "status", "product", "vendor", "version")
_vendor("linux_action_message", "linux", "action", "message", "activity_id", "activity_name", "severity_id", "severity")
_vendor("linux_fields", "linux", "src_ip", "src_port", "dst_ip", "dst_port", "protocol_name", "protocol_num", "direction")
_vendor("linux_hostname_user", "linux", "unmapped")
_vendor("linux_time", "linux", "time")
_vendor("linux_uid", "linux", "uid", "raw_data_hash", "raw_data_size")
_vendor("linux_observables", "linux", "observables")
_vendor("eve_decode", "suricata", "src_ip", "src_port", "dst_ip", "dst_port", "protocol_name", "protocol_num", "packets", "bytes", "direction")
_vendor("eve_class_severity", "suricata", "class_uid", "class_name", "severity_id", "severity", "status_id", "status", "message", "action", "finding_info", "confidence")
_vendor("eve_time", "suricata", "time")
_vendor("eve_unmapped", "suricata", "unmapped", "uid")
_vendor("event_names", "mixed", "class_uid", "class_name", "category_uid", "category_name", "activity_name", "type_uid", "type_name", "severity")
_vendor("raw_lossless", "mixed", "raw_data", "raw_data_hash", "raw_data_size")
# Lines that no source takes have no event.
QUERIES["event_names"], QUERIES["raw_lossless"] = (
    lambda spark, sf_dir, q=QUERIES[n], c=c: q(spark, sf_dir).filter(F.col(c).isNotNull()) for n, c in (("event_names", "class_uid"), ("raw_lossless", "raw_data"))
)

# Detection ----------------------------------------------------------------------------------------------------------


def detect_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = carriers.lines(spark, sf_dir, "mixed")
    return df.select("event_id", sources.default().detect(F.col("value")).alias("source"))


_add("detect_vendor", detect_vendor, "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'fortigate' WHEN 1 THEN 'linux' WHEN 2 THEN 'cisco_asa' WHEN 3 THEN 'suricata' ELSE '' END AS source FROM events")


def _literal(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    kinds = {int: "bigint", str: "string", bool: "boolean"}
    ddl = ", ".join(f"{n} {kinds[type(next((r[k] for r in rows if r[k] is not None), ''))]}" for k, n in enumerate(names))
    return spark.createDataFrame(rows, ddl)


def _values(rows: list[tuple], names: list[str]) -> str:
    def show(v: object) -> str:
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, int):
            return f"CAST({v} AS BIGINT)"
        return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(names)})"


PRECEDENCE = [
    (1, '{"event_type":"http","url":"?logid=1&type=2"}', "fortigate"),
    (2, "logid=1 subtype=x SRC=1.1.1.1 DST=2.2.2.2 %ASA-6-302013: Built", "fortigate"),
    (3, "SRC=1.1.1.1 DST=2.2.2.2 %ASA-6-302013: Built", "linux"),
    (4, '%ASA-6-302013: Built {"event_type"', "cisco_asa"),
    (5, '  {"event_type":"dns"}', "suricata"),
    (6, "SRC=1.1.1.1 only", ""),
    (7, "[UFW", "linux"),
    (8, "CEF:0|Vendor|Product|1|TRAFFIC|Log|1|src=1.1.1.1 dst=2.2.2.2", ""),
    (9, "1,2012/10/30 09:46:12,01606001116,THREAT,url,1", ""),
    (10, "", ""),
    (11, 'x {"event_type":"dns"}', ""),
    (12, "sudo: sshd[", "linux"),
]


def detect_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _literal(spark, [r[:2] for r in PRECEDENCE], ["k", "value"])
    return df.select("k", sources.default().detect(F.col("value")).alias("source"))


_add("detect_precedence", detect_precedence, _values([(r[0], r[2]) for r in PRECEDENCE], ["k", "source"]))


def detect_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", sources.default().detect(F.col("text")).alias("source"))


_add(
    "detect_documents",
    detect_documents,
    """SELECT doc_id, CASE WHEN contains(text, 'logid=') AND contains(text, 'type=') THEN 'fortigate'
  WHEN (contains(text, 'SRC=') AND contains(text, 'DST=')) OR contains(text, '[UFW') OR contains(text, '[IPTABLES-DROP]') OR contains(text, 'sshd[') THEN 'linux'
  WHEN contains(text, '%ASA-') THEN 'cisco_asa' WHEN starts_with(trim(text, ' \t\n\r'), '{') AND contains(text, '"event_type"') THEN 'suricata' ELSE '' END AS source FROM documents""",
)

# Tokens, addresses, numbers -----------------------------------------------------------------------------------------

TOKENS = [
    (1, "<134>a=1 b=two", "a=1;b=two"),
    (2, 'a="x, y: z" b=1', "a=x, y: z;b=1"),
    (3, 'a="say \\"hi\\" \\\\ \\n" b=2', 'a=say "hi" \\ \\n;b=2'),
    (4, "a=1 a=2", "a=2"),
    (5, "a= b=1", "a=;b=1"),
    (6, "word a=1 =v", "=v;a=1"),
    (7, 'a="open b=1', "a=open b=1"),
    (8, "a=1\tb=2=3", "a=1;b=2=3"),
    (9, "", ""),
    (10, "no equals", ""),
]


def fgt_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _literal(spark, [r[:2] for r in TOKENS], ["k", "line"])
    keys, values = fortigate.tokens(F.col("line"))
    df = df.select("k", keys.alias("keys"), values.alias("values"))
    pair = lambda k: F.concat(k, F.lit("="), fortigate.fields({"keys": F.col("keys"), "values": F.col("values")}, k))
    return df.select("k", F.array_join(F.transform(F.array_sort(F.array_distinct("keys")), pair), ";").alias("tokens"))


_add("fgt_tokenize", fgt_tokenize, _values([(r[0], r[2]) for r in TOKENS], ["k", "tokens"]))

ADDRESSES = [("1.2.3.4", True, True), ("999.999.999.999", True, False), ("01.2.3.4", True, False), ("1.2.3", False, False), ("1.2.3.4.5", False, False), ("", False, False), ("::1", False, False), ("1.2.3.4444", False, False), ("a.b.c.d", False, False), ("255.255.255.255", True, True), (" 1.2.3.4", False, False), ("1..2.3", False, False)]


def ipv4_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _literal(spark, [(a,) for a, _, _ in ADDRESSES], ["ip"])
    return df.select("ip", is_ipv4_shaped(F.col("ip")).alias("shaped"), is_ipv4(F.col("ip")).alias("strict"))


_add("ipv4_shape", ipv4_shape, _values(ADDRESSES, ["ip", "shaped", "strict"]))


def fgt_unmapped_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 25 keys without a field: the first 20 by their bytes stay."""
    extra = " ".join(f"' k{(7 * k) % 25:02d}=' || (event_id + {k}) ||" for k in range(25)).removesuffix("||")
    line = f"'date=2024-01-01 time=00:00:00 logid=\"1\" type=\"event\" version=\"7\"' || {extra}"
    df = carriers.rendered(carriers.base(spark, sf_dir), line)
    return parsed(df, "event_id").select("event_id", "unmapped", "version")


_add(
    "fgt_unmapped_top20",
    fgt_unmapped_top20,
    "SELECT event_id, " + " || ';' || ".join(f"'k{j:02d}=' || (event_id + {next(k for k in range(25) if 7 * k % 25 == j)})" for j in range(20)) + " AS unmapped, '7' AS version FROM events",
)

# Rejections and validation ------------------------------------------------------------------------------------------

EVE = '{"timestamp":"%s","event_type":"dns","src_ip":"%s","dest_ip":"2.2.2.2","src_port":%s,"proto":"UDP"}'
EVE_REJECTS = [
    (1, "", "suricata: empty line"),
    (2, "not json", "suricata: invalid JSON"),
    (3, '{"timestamp":"x"}', "suricata: missing event_type"),
    (4, EVE % ("2024-01-01T00:00:00Z", "999.999.999.999", "1"), "suricata: invalid ip"),
    (5, EVE % ("2024-01-01T00:00:00Z", "1.1.1.1", '"80"'), "suricata: invalid JSON"),
    (6, EVE % ("2024-01-01T00:00:00Z", "1.1.1.1", "80.5"), "suricata: invalid JSON"),
    (7, EVE % ("2024-01-01T00:00:00Z", "1.1.1.1", "80") + " trailing", "suricata: invalid JSON"),
    (8, '{"event_type":5}', "suricata: invalid JSON"),
    (9, EVE % ("2024-01-01T00:00:00Z", "1.1.1.1", "70000"), "suricata: port out of range"),
    (10, EVE % ("2024-01-01T00:00:00Z", "fe80::1", "80"), "suricata: invalid ip"),
    (11, EVE % ("2024-01-01T00:00:00Z", "1.1.1.1", "80"), None),
    (12, EVE % ("2024-01-01T00:00:00Z", "1.1.1.1", "-1"), "suricata: port out of range"),
    (13, '{"event_type":"smtp","src_ip":"1.1.1.1","email":{"url":["http://x/a"]}}', None),
    (14, '{"event_type":"alert","src_ip":"1.1.1.1","alert":{"signature":"s","metadata":{"category":["x"]}}}', None),
    (15, EVE % ("2024-01-01T00:00:00Z", "1.1.1.1", "80") + ' {"a":1}', "suricata: invalid JSON"),
    (16, EVE % ("2024-01-01T00:00:00Z", "1.1.1.1", "80") + " x}", "suricata: invalid JSON"),
    (17, EVE % ("2024-01-01T00:00:00Z", "1.1.1.1", "80") + "] [{}", "suricata: invalid JSON"),
    (18, EVE % ("2024-01-01T00:00:00Z", "1.1.1.1", "80") + ',{"a":1}', "suricata: invalid JSON"),
    (19, '{"event_type":"http","src_ip":"1.1.1.1","http":{"url":["x"]}}', "suricata: invalid JSON"),
    (20, '{"event_type":"http","src_ip":null,"http":{"url":null},"tags":[{"a":1}]}  ', None),
    (21, "{'event_type':'http'}", "suricata: invalid JSON"),
    (22, '{"event_type":"alert","alert":{"action":true}}', "suricata: invalid JSON"),
]


def eve_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    only = sources.Registry()
    whole = sources.default().get("suricata")
    only.register(sources.Source(whole.name, lambda line: F.lit(True), whole.steps, whole.parse))
    df = _literal(spark, [r[:2] for r in EVE_REJECTS], ["k", "value"])
    return parsed(df, "k", registry=only).select("k", F.col("parse_error").alias("error"))


_add("eve_rejects", eve_rejects, _values([(r[0], r[2]) for r in EVE_REJECTS], ["k", "error"]))

STAMPS = [
    (1, "2018-03-24T14:37:19.037299-0600", 1521923839037),
    (2, "2018-03-24T14:37:19-06:00", 1521923839000),
    (3, "2018-03-24T20:37:19Z", 1521923839000),
    (4, "2018-03-24T20:37:19,5Z", 1521923839500),
    (5, "2018-03-24T20:37:19", INGEST),
    (6, "2018-03-24", INGEST),
    (7, "12:00", INGEST),
    (8, "", INGEST),
    (9, "2018-13-24T20:37:19Z", INGEST),
]


def eve_time_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _literal(spark, [(k, EVE % (t, "1.1.1.1", "1")) for k, t, _ in STAMPS], ["k", "value"])
    return parsed(df, "k").select("k", "time")


_add("eve_time_forms", eve_time_forms, _values([(k, t) for k, _, t in STAMPS], ["k", "time"]))

LINUX_STAMPS = [
    (1, "Jan  2 03:04:05 h k: SRC=1.1.1.1 DST=2.2.2.2", 1704164645000),
    (2, "Feb 31 00:00:00 h k: SRC=1.1.1.1 DST=2.2.2.2", 1709337600000),
    (3, "Jan 32 00:00:00 h k: SRC=1.1.1.1 DST=2.2.2.2", INGEST),
    (4, "Jan 2 24:00:00 h k: SRC=1.1.1.1 DST=2.2.2.2", INGEST),
    (5, "type=X audit(1500000000.123:4): SRC=1.1.1.1 DST=2.2.2.2", 1500000000000),
    (6, "h k: SRC=1.1.1.1 DST=2.2.2.2", INGEST),
]


def linux_time_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(_literal(spark, [r[:2] for r in LINUX_STAMPS], ["k", "value"]), "k").select("k", "time")


_add("linux_time_forms", linux_time_forms, _values([(r[0], r[2]) for r in LINUX_STAMPS], ["k", "time"]))

FAULTS = [
    ("class_uid", "1", "class_uid must be 4001 or 2004"),
    ("category_uid", "9", "category_uid must be that of the class"),
    ("type_uid", "1", "type_uid must be class*100+activity"),
    ("severity_id", "6", "severity_id out of range 0-5"),
    ("time", "0", "time must be positive ms epoch"),
    ("metadata.uid", "''", "metadata.product.name, metadata.version, metadata.uid are required"),
    ("raw_data", "''", "raw_data is required"),
    ("raw_data_hash", "''", "raw_data_hash is required"),
    ("src_endpoint.ip", "'1.2.3'", "invalid ip"),
    ("dst_endpoint.ip", "'::1'", "invalid ip"),
    ("src_endpoint.port", "65536", "port out of range"),
    ("dst_endpoint.port", "-1", "port out of range"),
    ("unmapped", "map_from_entries(transform(sequence(1, 21), x -> struct(string(x), 'v')))", "unmapped capped at 20 keys"),
    ("raw_data_hash", "'other'", "raw_data_hash must be sha256(raw_data)"),
    ("src_endpoint.ip", "'999.1.1.1'", None),
    ("unmapped", "map_from_entries(transform(sequence(1, 20), x -> struct(string(x), 'v')))", None),
]


def validate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A valid event, changed in one field at a time."""
    line = "Jan 2 03:04:05 h k: [UFW BLOCK] SRC=1.1.1.1 DST=2.2.2.2 ID=7"
    rows = normalize(_literal(spark, [(line,)], ["value"]), ingest_ms=INGEST, assume_year=YEAR)
    whole = F.struct(*[F.col(f) for f in event.FIELDS])
    found = [event.violation(whole.withField(f, F.expr(v).cast(_kind(f))), check_digest=True) for f, v, _ in FAULTS]
    return rows.select(F.posexplode(F.array(*found)).alias("k", "error")).select(F.col("k").cast("long").alias("k"), "error")


def _kind(path: str):
    kind = event.EVENT
    for p in path.split("."):
        kind = kind[p].dataType
    return kind


_add("validate_rules", validate_rules, _values([(k, e) for k, (_, _, e) in enumerate(FAULTS)], ["k", "error"]))


def validate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full validation, digests taken again, over all mixed lines."""
    df = accepted(normalize(carriers.lines(spark, sf_dir, "mixed"), ingest_ms=INGEST, assume_year=YEAR))
    return df.withColumn("error", event.violation(F.struct(*[F.col(f) for f in event.FIELDS]), check_digest=True)).groupBy("source").agg(
        F.count("*").alias("events"), F.count("error").alias("invalid")
    )


_add("validate_all", validate_all, oracle.with_events("mixed") + "SELECT source, count(*) AS events, CAST(0 AS BIGINT) AS invalid FROM n GROUP BY source")


def hash_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", event.digest(F.col("text")).alias("raw_data_hash"), F.octet_length("text").alias("raw_data_size"))


_add("hash_raw", hash_raw, "SELECT doc_id, sha256(text) AS raw_data_hash, CAST(strlen(text) AS INTEGER) AS raw_data_size FROM documents")

# Export -------------------------------------------------------------------------------------------------------------


def _exported(name: str, column: Callable[[], Column], sql: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = accepted(normalize(carriers.lines(spark, sf_dir, "mixed"), ingest_ms=INGEST, assume_year=YEAR))
        return df.select("event_id", column().alias("line"))

    _add(name, query, oracle.with_events("mixed") + f"SELECT event_id, {sql} AS line FROM n")


_enc = lambda c: f"replace(url_encode({c}), '%20', '+')"
_exported(
    "to_cef",
    export.cef,
    f"""'CEF:0|' || vendor || '|' || product || '|' || version || '|' || type_uid || '|' || type_name || '|' || severity_id || '|act=' || {_enc("action")} || ' cs1=' || {_enc("uid")} || ' cs1Label=event_id dpt='
  || dst_port || ' dst=' || {_enc("dst_ip")} || ' msg=' || {_enc("message")} || ' proto=' || {_enc("protocol_name")} || ' spt=' || src_port || ' src=' || {_enc("src_ip")}""",
)
_exported(
    "to_leef",
    export.leef,
    """'LEEF:2.0|' || vendor || '|' || product || '|' || version || '|' || type_uid || '|' || chr(9) || 'cat=' || category_name || chr(9) || 'src=' || src_ip || chr(9) || 'dst=' || dst_ip || chr(9) || 'srcPort=' || src_port
  || chr(9) || 'dstPort=' || dst_port || chr(9) || 'proto=' || protocol_name || chr(9) || 'action=' || action || chr(9) || 'sev=' || severity_id || chr(9) || 'msg=' || message || chr(9) || 'eventID=' || uid""",
)
def event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = accepted(normalize(carriers.lines(spark, sf_dir, "mixed"), ingest_ms=INGEST, assume_year=YEAR)).select("event_id", export.ocsf_json().alias("j"))
    of = lambda path: F.get_json_object("j", path)
    parts = [of("$.type_uid"), of("$.metadata.uid"), of("$.raw_data"), F.coalesce(of("$.src_endpoint.ip"), F.lit("-")), F.coalesce(of("$.status"), F.lit("-"))]
    return df.select("event_id", F.concat_ws("|", *parts, F.array_join(F.json_object_keys("j"), ",")).alias("line"))


_add(
    "event_json",
    event_json,
    oracle.with_events("mixed")
    + """SELECT event_id, type_uid || '|' || uid || '|' || raw_data || '|' || CASE src_ip WHEN '' THEN '-' ELSE src_ip END || '|' || CASE status WHEN '' THEN '-' ELSE status END
  || '|class_uid,class_name,category_uid,category_name,activity_id,activity_name,type_uid,type_name,severity_id,severity' || CASE status_id WHEN 0 THEN '' ELSE ',status_id,status' END
  || CASE message WHEN '' THEN '' ELSE ',message' END || ',time,metadata,raw_data,raw_data_hash,raw_data_size' || CASE observables WHEN '' THEN '' ELSE ',observables' END
  || CASE unmapped WHEN '' THEN '' ELSE ',unmapped' END || ',src_endpoint,dst_endpoint' || CASE protocol_name WHEN '' THEN '' ELSE ',protocol_name' END || CASE protocol_num WHEN 0 THEN '' ELSE ',protocol_num' END
  || CASE direction WHEN '' THEN '' ELSE ',direction' END || ',action,traffic' || CASE finding_info WHEN '' THEN '' ELSE ',finding_info' END || CASE confidence WHEN '' THEN '' ELSE ',confidence' END AS line FROM n""",
)


def to_ecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = accepted(normalize(carriers.lines(spark, sf_dir, "mixed"), ingest_ms=INGEST, assume_year=YEAR))
    fields = export.ecs()
    return df.select("event_id", *[(F.array_join(c, ",") if n in ("event.category", "event.type") else c).alias(n.strip("@").replace(".", "_")) for n, c in fields.items()])


_add(
    "to_ecs",
    to_ecs,
    oracle.with_events("mixed")
    + """SELECT event_id, strftime(make_timestamp(time * 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN time % 1000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(time % 1000 AS VARCHAR), 3, '0'), '0') END || 'Z' AS timestamp,
  '8.17.0' AS ecs_version, 'event' AS event_kind, lower(category_name) AS event_category, lower(activity_name) AS event_type, src_ip AS source_ip, src_port AS source_port, dst_ip AS destination_ip, dst_port AS destination_port,
  protocol_name AS network_protocol, action AS event_action, message, raw_data AS event_original, uid AS labels_event_id FROM n""",
)

# The pipeline -------------------------------------------------------------------------------------------------------


def normalize_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: all vendors' lines to events, counted."""
    df = accepted(normalize(carriers.lines(spark, sf_dir, "mixed"), ingest_ms=INGEST, assume_year=YEAR))
    return df.groupBy("source", "class_uid", "activity_name", "severity").agg(
        F.count("*").alias("events"), F.sum("traffic.bytes").alias("bytes"), F.min("time").alias("first"), F.max("time").alias("last")
    )


_add(
    "normalize_all",
    normalize_all,
    oracle.with_events("mixed") + "SELECT source, class_uid, activity_name, severity, count(*) AS events, CAST(sum(bytes) AS BIGINT) AS bytes, min(time) AS first, max(time) AS last FROM n GROUP BY ALL",
)

BROKEN = "CASE event_id % 20 WHEN 0 THEN 'logid=\"\" type=\"x\"' WHEN 5 THEN 'logid=1 type=2 eventtime=5 srcip=1.2.3 ' WHEN 2 THEN '%ASA-x' WHEN 3 THEN '{\"event_type\": 1}' ELSE NULL END"


def route_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = carriers.lines(spark, sf_dir, "mixed").withColumn("value", F.coalesce(F.expr(BROKEN), "value"))
    return store.routing(normalize(df, ingest_ms=INGEST, assume_year=YEAR))


_add(
    "route_stats",
    route_stats,
    """SELECT CASE event_id % 5 WHEN 0 THEN 'fortigate' WHEN 1 THEN 'linux' WHEN 2 THEN 'cisco_asa' WHEN 3 THEN 'suricata' ELSE 'unrouted' END AS source, count(*) AS received,
  count(*) FILTER (WHERE event_id % 5 <> 4 AND event_id % 20 NOT IN (0, 5, 2, 3)) AS parsed, count(*) FILTER (WHERE event_id % 5 = 4 OR event_id % 20 IN (0, 5, 2, 3)) AS failed FROM events GROUP BY 1""",
)


def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = parsed(carriers.lines(spark, sf_dir, "linux"), "event_id").select("event_id", "uid", "action")
    return store.first_wins(df, F.col("uid"), "event_id").select("uid", "event_id", "action", "duplicates")


_add("dedup_first_wins", dedup_first_wins, oracle.with_events("linux") + "SELECT uid, min(event_id) AS event_id, arg_min(action, event_id) AS action, count(*) - 1 AS duplicates FROM n GROUP BY uid")


def linux_uid_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = carriers.lines(spark, sf_dir, "linux")
    one = lambda mode: parsed(df, "event_id", uid_mode=mode).agg(F.lit(mode).alias("mode"), F.count("*").alias("events"), F.count_distinct("uid").alias("uids"))
    return one("compat").unionByName(one("safe"))


_add(
    "linux_uid_collision",
    linux_uid_collision,
    oracle.with_events("linux") + "SELECT 'compat' AS mode, count(*) AS events, count(DISTINCT uid) AS uids FROM n UNION ALL SELECT 'safe', count(*), count(DISTINCT raw_data_hash) FROM n",
)


def _page(source: str | None) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = parsed(carriers.lines(spark, sf_dir, "mixed"), "event_id")
        return store.since(df.select("event_id", "source", "action"), 123, 50, source)

    return query


_add("events_since", _page(None), oracle.with_events("mixed") + ", a AS (SELECT e.event_id, coalesce(n.source, '') AS source, n.action FROM events e LEFT JOIN n ON n.event_id = e.event_id) SELECT event_id, source, action FROM a WHERE event_id > 123 ORDER BY event_id LIMIT 50")
_add("events_by_source", _page("suricata"), oracle.with_events("mixed") + "SELECT event_id, source, action FROM n WHERE source = 'suricata' AND event_id > 123 ORDER BY event_id LIMIT 50")


def retention_latest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.newest(carriers.lines(spark, sf_dir, "mixed").select("event_id", "value"), 777)


_add("retention_latest_n", retention_latest_n, f"WITH {carriers.BASE_DUCK} SELECT event_id, {carriers.MIXED} AS value FROM base ORDER BY event_id DESC LIMIT 777")

# Analytics ----------------------------------------------------------------------------------------------------------

_BY_USER = "CAST(user_id AS VARCHAR)"


def _activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid Linux events with the sender's user as their address."""
    df = carriers.lines(spark, sf_dir, "linux").withColumn("who", F.expr("'10.0.' || (user_id % 40)"))
    return accepted(normalize(df, ingest_ms=INGEST, assume_year=YEAR)).select("event_id", "who", "time", "activity_id", F.col("dst_endpoint.port").alias("dst_port"), F.col("raw_data_size").alias("size"))


_ACTIVITY = oracle.with_events("linux") + ", a AS (SELECT n.event_id, '10.0.' || (b.user_id % 40) AS who, n.time, n.activity_id, n.dst_port, n.raw_data_size AS size, n.time // 3600000 AS hour FROM n JOIN base b ON b.event_id = n.event_id)\n"


def ip_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analytics.features(_activity(spark, sf_dir), "who", size="size")
    return out.select("who", "events", "ports", *[F.round(c, 6).alias(c) for c in ("fail_ratio", "bytes_mean", "bytes_std", "hour_std", "gap_mean", "per_minute", "hour_entropy")])


_add(
    "ip_features",
    ip_features,
    _ACTIVITY
    + """, h AS (SELECT who, hour % 24 AS h, count(*) AS n FROM a GROUP BY ALL), e AS (SELECT who, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS hour_entropy FROM h GROUP BY who),
w AS (SELECT who, count(*) AS events, count(DISTINCT dst_port) AS ports, avg(CASE activity_id WHEN 2 THEN 1.0 ELSE 0.0 END) AS fail_ratio, avg(size) AS bytes_mean, coalesce(stddev_samp(size), 0) AS bytes_std,
  coalesce(stddev_samp(hour % 24), 0) AS hour_std, (max(time) - min(time)) / greatest(count(*) - 1, 1) / 1000.0 AS gap_mean, count(*) / greatest((max(time) - min(time)) / 60000.0, 1.0) AS per_minute FROM a GROUP BY who)
SELECT who, events, ports, round(CAST(fail_ratio AS DOUBLE), 6) AS fail_ratio, round(bytes_mean, 6) AS bytes_mean, round(bytes_std, 6) AS bytes_std, round(hour_std, 6) AS hour_std, round(CAST(gap_mean AS DOUBLE), 6) AS gap_mean,
  round(CAST(per_minute AS DOUBLE), 6) AS per_minute, round(hour_entropy, 6) AS hour_entropy FROM w JOIN e USING (who)""",
)


def ip_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analytics.rates(_activity(spark, sf_dir), "who", every="1 hour")
    return out.select("who", F.unix_millis("start").alias("start"), "n")


_add("ip_rate", ip_rate, _ACTIVITY + "SELECT who, hour * 3600000 AS start, count(*) AS n FROM a GROUP BY ALL")


def ip_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analytics.unusual(_activity(spark, sf_dir), "who")
    return out.select("who", "hour", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round("z", 6).alias("z"), "flag")


_add(
    "ip_zscore",
    ip_zscore,
    _ACTIVITY
    + """, c AS (SELECT who, hour, count(*) AS n FROM a GROUP BY ALL),
m AS (SELECT *, avg(n) OVER w AS mean, stddev_samp(n) OVER w AS std FROM c WINDOW w AS (PARTITION BY who ORDER BY hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT who, hour, n, round(mean, 6) AS mean, round(std, 6) AS std, round(CASE WHEN std > 0 THEN (n - mean) / std END, 6) AS z, coalesce(CASE WHEN std > 0 THEN (n - mean) / std END > 3, FALSE) AS flag FROM m""",
)


def ip_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analytics.features(_activity(spark, sf_dir), "who", size="size")
    out = analytics.outliers(rows, _SCORED)
    return out.select("who", F.round("score", 6).alias("score"), "flag")


_SCORED = ["events", "fail_ratio", "ports", "bytes_mean", "hour_entropy"]
_add(
    "ip_outliers",
    ip_outliers,
    _ACTIVITY
    + """, h AS (SELECT who, hour % 24 AS h, count(*) AS n FROM a GROUP BY ALL), e AS (SELECT who, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS hour_entropy FROM h GROUP BY who),
v AS (SELECT who, CAST(count(*) AS DOUBLE) AS events, CAST(count(DISTINCT dst_port) AS DOUBLE) AS ports, CAST(avg(CASE activity_id WHEN 2 THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS fail_ratio, avg(size) AS bytes_mean FROM a GROUP BY who),
w AS (SELECT * FROM v JOIN e USING (who)), q AS (SELECT """
    + ", ".join(f"quantile_disc({c}, 0.25) AS {c}_l, quantile_disc({c}, 0.5) AS {c}_m, quantile_disc({c}, 0.75) AS {c}_h" for c in _SCORED)
    + " FROM w), s AS (SELECT who, greatest("
    + ", ".join(f"abs({c} - {c}_m) / greatest({c}_h - {c}_l, 1e-9)" for c in _SCORED)
    + ") AS score FROM w, q) SELECT who, round(score, 6) AS score, score >= (SELECT quantile_disc(score, 0.9) FROM s) AS flag FROM s",
)


def asa_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each built connection with the teardown of the same number, the next event by construction, if that is not before it."""
    base = carriers.base(spark, sf_dir).withColumn("conn", F.expr("10000 + event_id - event_id % 9"))
    df = accepted(normalize(carriers.rendered(base, carriers.CISCO_ASA), ingest_ms=INGEST, assume_year=YEAR))
    return analytics.sessions(df).select(F.col("connection").cast("long").alias("connection"), "begun", "ended", "bytes", F.col("src_endpoint.ip").alias("src_ip"))


_add(
    "asa_sessions",
    asa_sessions,
    f"""WITH {carriers.BASE_DUCK} SELECT 10000 + b.event_id AS connection, b.sec * 1000 AS begun, t.sec * 1000 AS ended, CAST(t.volume AS BIGINT) AS bytes, b.ip_out AS src_ip
FROM base b JOIN base t ON t.event_id = b.event_id + 1 WHERE b.event_id % 9 = 0 AND t.sec >= b.sec""",
)


def severity_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = accepted(normalize(carriers.lines(spark, sf_dir, "mixed"), ingest_ms=INGEST, assume_year=YEAR))
    return df.cube("source", "severity_id").agg(F.count("*").alias("events"))


_add("severity_cube", severity_cube, oracle.with_events("mixed") + "SELECT source, severity_id, count(*) AS events FROM n GROUP BY CUBE (source, severity_id)")

# Generators ---------------------------------------------------------------------------------------------------------

SYNTH_N, SEED = 5000, 42
# By shape: activity, and whether the line carries a volume.
_ACTS = {
    "cisco_asa": ("1111111121212222", {1, 3, 5}),
    "fortigate": ("12111101122", {0}),
    "linux": ("22122210", set()),
    "suricata": ("1" * 16, {14}),
}


def _synth(vendor: str) -> None:
    acts, sized = _ACTS[vendor]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = accepted(normalize(synth.generate(spark, vendor, SYNTH_N, SEED), ingest_ms=INGEST, assume_year=YEAR))
        return df.groupBy(F.col("shape").cast("long").alias("shape"), "source", "activity_id").agg(F.count("*").alias("lines"), F.sum("traffic.bytes").alias("bytes"), F.min("i").alias("first"))

    columns = ", ".join(f"{sql} AS {name}" for name, sql in synth.rows_sql(vendor, SEED))
    act = "CASE shape " + " ".join(f"WHEN {k} THEN {a}" for k, a in enumerate(acts)) + " END"
    more = "volume + 1" if vendor == "suricata" else "volume"
    size = f"CASE WHEN shape IN ({', '.join(map(str, sorted(sized)))}) THEN {more} ELSE 0 END" if sized else "0"
    _add(
        f"synth_{vendor}",
        query,
        f"""WITH r AS (SELECT i, {columns} FROM range({SYNTH_N}) t(i)) SELECT CAST(shape AS BIGINT) AS shape, '{vendor}' AS source, CAST({act} AS INTEGER) AS activity_id, count(*) AS lines,
  CAST(sum({size}) AS BIGINT) AS bytes, CAST(min(i) AS BIGINT) AS first FROM r GROUP BY ALL""",
    )


for _v in _ACTS:
    _synth(_v)


def synth_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interleaved corpus: every line is taken by the source that it was made for."""
    df = normalize(synth.corpus(spark, 2000, SEED), ingest_ms=INGEST, assume_year=YEAR)
    return df.groupBy("vendor", "source").agg(F.count("*").alias("lines"), F.count("parse_error").alias("failed"), F.min("place").alias("first"))


_add("synth_corpus", synth_corpus, "SELECT vendor, vendor AS source, CAST(2000 AS BIGINT) AS lines, CAST(0 AS BIGINT) AS failed, CAST(k AS BIGINT) AS first FROM (VALUES ('cisco_asa', 0), ('fortigate', 1), ('suricata', 2), ('linux', 3)) t(vendor, k)")

# PAN-OS, an optional source ------------------------------------------------------------------------------------------

PANOS_ACTS = ["allow", "deny", "drop", "alert", "reset-both"]
_PANOS = {
    "kind": "CASE WHEN event_id % 4 = 0 THEN 'THREAT' ELSE 'TRAFFIC' END",
    "src": "'10.0.' || CAST(event_id % 200 AS VARCHAR(9)) || '.7'",
    "dst": "'192.0.2.' || CAST(event_id % 250 AS VARCHAR(9))",
    "spt": "CAST(1024 + event_id % 60000 AS VARCHAR(9))",
    "proto": "CASE WHEN event_id % 3 = 0 THEN 'udp' ELSE 'tcp' END",
    "act": "CASE event_id % 5 " + " ".join(f"WHEN {k} THEN '{a}'" for k, a in enumerate(PANOS_ACTS)) + " END",
}


def panos_cef(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CEF lines of PAN-OS, each field read back from the line."""
    x = _PANOS
    line = f"'CEF:0|V|PAN-OS|10|' || {x['kind']} || '|Log|1|src=' || {x['src']} || ' dst=' || {x['dst']} || ' spt=' || {x['spt']} || ' dpt=443 proto=' || {x['proto']} || ' act=' || {x['act']} || ' app=web'"
    df = carriers.rendered(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id"), line)
    columns = ["source", "class_uid", "activity_id", "severity_id", "src_ip", "src_port", "dst_ip", "dst_port", "protocol_name", "protocol_num", "action", "time", "unmapped"]
    return parsed(df, "event_id", registry=sources.extended()).select("event_id", *columns)


_add(
    "panos_cef",
    panos_cef,
    f"""WITH r AS (SELECT event_id, {', '.join(f'{sql} AS {name}' for name, sql in _PANOS.items())} FROM events)
SELECT event_id, 'panos' AS source, CASE kind WHEN 'THREAT' THEN 2004 ELSE 4001 END AS class_uid, CASE WHEN kind = 'THREAT' THEN 1 WHEN act = 'allow' THEN 1 ELSE 2 END AS activity_id,
  CASE kind WHEN 'THREAT' THEN 3 ELSE 1 END AS severity_id, src AS src_ip, CAST(spt AS BIGINT) AS src_port, dst AS dst_ip, CAST(443 AS BIGINT) AS dst_port, proto AS protocol_name,
  CAST(CASE proto WHEN 'udp' THEN 17 ELSE 6 END AS BIGINT) AS protocol_num, act AS action, CAST({INGEST} AS BIGINT) AS time, 'app=web' AS unmapped FROM r""",
)

# Streams ------------------------------------------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    import tempfile

    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="wardstone-")
    return f"{found.rstrip('/')}/{uuid.uuid4().hex}"


def stream_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written as text, followed as a stream, stored as events, read back and counted; every line twice."""
    at = shared_dir(spark)
    df = carriers.lines(spark, sf_dir, "mixed").select("value")
    text_lines.write_lines(df.unionByName(df), f"{at}/lines")
    stream = pipeline.events(text_lines.follow_lines(spark, f"{at}/lines"), ingest_ms=INGEST, assume_year=YEAR, uid_mode="safe")
    pipeline.store(stream, f"{at}/events", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/events").groupBy("source").agg(F.count("*").alias("events"), F.count_distinct("event_id").alias("ids"))


_add("stream_normalize", stream_normalize, oracle.with_events("mixed") + "SELECT source, count(DISTINCT raw_data_hash) AS events, count(DISTINCT raw_data_hash) AS ids FROM n GROUP BY source")
