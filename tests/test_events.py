from wardstone.operators.registry import Registry, Source, default, extended
from wardstone.plans import analytics, store
from wardstone.plans.normalize import accepted, flat, normalize, rejected
from wardstone.sources import lines, synth


def one(spark, line, **options):
    rows = flat(normalize(spark.createDataFrame([(line,)], "value string"), ingest_ms=5, assume_year=2024, **options)).collect()
    assert len(rows) == 1
    return rows[0]


def test_asa_last_two_endpoints_and_time(spark):
    r = one(spark, "<134>Nov 28 2007 17:20:48: %ASA-6-302013: Built outbound TCP connection 76118 for outside:207.68.178.45/80 (207.68.178.45/80) to inside:192.168.20.31/3530 (99.129.50.157/5967)\r\n")
    assert (r.src_ip, r.src_port, r.dst_ip, r.dst_port) == ("207.68.178.45", 80, "192.168.20.31", 3530)
    assert (r.time, r.action, r.direction, r.raw_data_size) == (1196270448000, "Built", "outbound", 175)
    assert r.unmapped == "asa.connection_id=76118;asa.message_id=302013;asa.severity=6"


def test_asa_octets_beyond_255_give_no_endpoint(spark):
    r = one(spark, "%ASA-4-106023: Deny tcp src outside:300.1.1.1/80 dst inside:10.0.0.1/22")
    assert (r.src_ip, r.src_port, r.dst_ip) == ("10.0.0.1", 22, "") and r.time == 5 and r.time_source == "ingest"


def test_asa_port_out_of_range_is_rejected(spark):
    assert one(spark, "%ASA-4-106023: Deny tcp src outside:3.1.1.1/70000 dst inside:10.0.0.1/22").parse_error == "cisco_asa: port out of range"


def test_fortigate_is_validated_later(spark):
    r = one(spark, "logid=1 type=traffic eventtime=9 srcip=1.2.3")
    assert r.parse_error is None and r.validation_error == "invalid ip"


def test_linux_first_key_wins_and_ports_fall_to_zero(spark):
    r = one(spark, "  h k: [UFW BLOCK] IN= OUT= OUT=eth1 SRC=1.1.1.1 DST=2.2.2.2 ID=7 ID=8 SPT=70000 DPT=22  ")
    assert (r.uid, r.src_port, r.dst_port, r.direction, r.raw_data[0]) == ("7", 0, 22, "", "h")


def test_linux_action_and_message_have_their_own_order(spark):
    r = one(spark, "h k: [UFW ALLOW] [IPTABLES-DROP] SRC=1.1.1.1 DST=2.2.2.2")
    assert (r.action, r.message) == ("DROP", "Linux UFW allowed network traffic")


def test_empty_lines_and_nulls_are_unrouted(spark):
    df = normalize(spark.createDataFrame([(None,), ("",), ("x",)], "value string"), ingest_ms=5)
    assert [r.source for r in df.collect()] == ["", "", ""] and accepted(df).count() == 0 and rejected(df).count() == 3


def test_empty_table(spark):
    assert normalize(spark.createDataFrame([], "value string"), ingest_ms=5).count() == 0


def test_registry_keeps_order(spark):
    r = Registry()
    for s in default().ordered():
        r.register(s)
    r.register(Source("linux", lambda c: c.contains("zzz"), (), lambda *a: {}))
    assert [s.name for s in r.ordered()] == ["fortigate", "linux", "cisco_asa", "suricata"] and r.names() == sorted(r.names())
    assert r.get("nothing") is None


def test_newest_keeps_ties_and_all(spark):
    df = spark.createDataFrame([(i // 2,) for i in range(100)], "event_id long")
    assert store.newest(df, 10).count() == 10 and store.newest(df, 9).count() == 10 and store.newest(df, 1000).count() == 100
    assert store.newest(df.filter("event_id < 0"), 5).count() == 0


def test_cursor(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(20)], "event_id long, source string")
    page = store.since(df, 4, 3, "a")
    assert [r.event_id for r in page.collect()] == [5, 7, 9] and store.next_cursor(page, 4) == 9 and store.next_cursor(df.filter("false"), 4) == 4


def test_panos_is_an_extension(spark):
    csv = '<14>Nov 30 16:09:08 PA 1,2012/10/30 09:46:12,01,THREAT,url,1,2012/04/10 04:39:56,192.168.0.2,175.16.199.1,0.0.0.0,0.0.0.0,"rule, one",u,,web,v,a,b,e1,e2,f,t,25149,1,59309,80,0,0,0x2,tcp,alert,"x"'
    r = one(spark, csv, registry=extended())
    assert (r.source, r.class_uid, r.src_ip, r.src_port, r.dst_ip, r.dst_port, r.action, r.protocol_num) == ("panos", 2004, "192.168.0.2", 59309, "175.16.199.1", 80, "alert", 6)
    assert r.time == 1334032796000 and r.unmapped == 'app=web;rule="rule, one";session=25149'
    r = one(spark, "CEF:0|V|PAN-OS|10|TRAFFIC|Log|1|src=192.168.1.100 dst=8.8.8.8 spt=5353 dpt=53 proto=udp act=allow app=dns", registry=extended())
    assert (r.class_uid, r.activity_name, r.src_port, r.dst_port, r.protocol_name) == (4001, "Allow", 5353, 53, "udp")
    assert one(spark, csv).source == ""


def test_linux_hostname_behind_many_characters(spark):
    pad, name = " " * 500, "h" * 450
    tail = "k: [UFW BLOCK] SRC=1.1.1.1 DST=2.2.2.2 ID=7"
    assert f"hostname={name};" in one(spark, f"{name}: {tail}").unmapped
    assert "hostname=far;" in one(spark, f"Jan 2{pad}01:02:03 far {tail}").unmapped


def test_one_scan_of_the_text(spark, tmp_path):
    spark.createDataFrame([("logid=1 type=x",)], "value string").write.text(f"{tmp_path}/lines")
    plan = normalize(spark.read.text(f"{tmp_path}/lines"), ingest_ms=5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and "Union" not in plan and "Exchange" not in plan


def test_registering_again_changes_parsing_but_not_routing(spark):
    r = default()
    old = r.get("linux")
    r.register(Source("linux", lambda c: c.contains("zzz"), old.steps, lambda line, s, c: old.parse(line, s, c) | {"message": line}))
    df = spark.createDataFrame([("h k: [UFW BLOCK] SRC=1.1.1.1 DST=2.2.2.2",), ("zzz",)], "value string")
    got = [(x.source, x.message) for x in normalize(df, ingest_ms=5, registry=r).collect()]
    assert got == [("linux", "h k: [UFW BLOCK] SRC=1.1.1.1 DST=2.2.2.2"), ("", None)]


def test_upsert_adds_what_is_new_and_counts_the_rest(spark):
    stored = spark.createDataFrame([("a", 0), ("b", 0)], "uid string, event_id long")
    new = spark.createDataFrame([("b", 1), ("c", 3), ("c", 2), ("d", 4), (None, 6), (None, 5)], "uid string, event_id long")
    added, counters = store.upsert(new, stored, "uid", "event_id")
    assert sorted((r.uid or "", r.event_id) for r in added.collect()) == [("", 5), ("c", 2), ("d", 4)]
    assert tuple(counters.first()) == (6, 3, 3)
    added, counters = store.upsert(new.filter("false"), stored, "uid", "event_id")
    assert added.count() == 0 and tuple(counters.first()) == (0, 0, 0)


def test_sessions_take_the_next_teardown_of_a_reused_id(spark):
    line = "%s: %%ASA-6-30201%d: %s TCP connection 7 for outside:1.1.1.1/80 to inside:2.2.2.2/22 bytes %d"
    rows = [("Nov 28 2007 17:00:0%d" % k, n, w, k) for k, (n, w) in enumerate([(3, "Built"), (4, "Teardown"), (3, "Built"), (3, "Built"), (4, "Teardown"), (4, "Teardown")])]
    df = accepted(normalize(spark.createDataFrame([(line % r,) for r in rows], "value string"), ingest_ms=5))
    got = sorted((r.begun, r.ended, r.bytes) for r in analytics.sessions(df).collect())
    start = 1196269200000
    assert got == [(start, start + 1000, 1), (start + 3000, start + 4000, 4)]


def test_asa_error_quotes_the_line(spark):
    r = one(spark, "%ASA- " + "x" * 200)
    assert r.parse_error == 'cisco_asa: no %ASA-sev-id header: "%ASA- ' + "x" * 74 + '…"'


def test_random_ids_keep_identical_lines_apart(spark):
    df = spark.createDataFrame([("%ASA-6-302013: Built outbound TCP connection 7 for outside:1.1.1.1/80 to inside:2.2.2.2/22",)] * 3 + [("h k: [UFW BLOCK] SRC=1.1.1.1 DST=2.2.2.2 ID=7",)], "value string")
    runs = [normalize(df, ingest_ms=5, assume_year=2024, uid_mode="random").filter("parse_error IS NULL").selectExpr("metadata.uid AS u", "metadata.correlation_uid AS c", "source").collect() for _ in range(2)]
    asa = [r for rows in runs for r in rows if r.source == "cisco_asa"]
    assert len({r.u for r in asa}) == 6 and all(r.c == r.u and len(r.u) == 36 for r in asa)
    assert [r.u for rows in runs for r in rows if r.source == "linux"] == ["7", "7"]


def test_time_of_ingest_is_the_present_by_default(spark):
    import time

    df = spark.createDataFrame([("%ASA-6-302013: Built outbound TCP connection 7 for outside:1.1.1.1/80 to inside:2.2.2.2/22",)], "value string")
    r = normalize(df).first()
    assert abs(r.time / 1000 - time.time()) < 60 and r.time_source == "ingest"


def test_lake_of_json_lines(spark, tmp_path):
    import json

    df = accepted(normalize(synth.corpus(spark, 20, 3), ingest_ms=5, assume_year=2024))
    lines.write_jsonl(df, f"{tmp_path}/lake")
    lines.write_jsonl(df, f"{tmp_path}/by", by_source=True)
    rows = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/lake").collect()]
    assert len(rows) == df.count() and sorted(r["raw_data"] for r in rows) == sorted(r.raw_data for r in df.collect())
    assert spark.read.text(f"{tmp_path}/by").groupBy("source").count().count() == 4


def test_timed_feed_gives_the_generators_lines(spark, tmp_path):
    stream = lines.timed_feed(spark, "linux", every=0.1, batch=25, seed=9)
    query = stream.writeStream.format("memory").queryName("feed").outputMode("append").start()
    try:
        query.processAllAvailable()
        import time

        until = time.time() + 20
        while time.time() < until and not spark.table("feed").count():
            time.sleep(0.5)
    finally:
        query.stop()
    got = {r.i: r.value for r in spark.table("feed").select("i", "value").collect()}
    want = {r.i: r.value for r in synth.generate(spark, "linux", max(got) + 1, 9).collect()}
    assert got and all(want[i] == v for i, v in got.items())


def test_stream_goes_on_after_a_failure(spark, tmp_path):
    """A query that ends before its last files goes on from its checkpoint, without rows lost or given twice."""
    from wardstone.streaming import pipeline

    parts = [synth.generate(spark, "linux", 30, seed).select("value") for seed in (1, 2)]
    for k, part in enumerate(parts):
        lines.write_lines(part.coalesce(1), f"{tmp_path}/in/{k}")
        stream = pipeline.events(lines.follow_lines(spark, f"{tmp_path}/in/*"), ingest_ms=5, assume_year=2024, uid_mode="safe")
        pipeline.store(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    want = {r.value for part in parts for r in part.collect()}
    got = [r.raw_data for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert len(got) == len(set(got)) and set(got) == want
