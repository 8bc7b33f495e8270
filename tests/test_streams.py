"""Streaming: stream results equal batch results, re-delivery and re-runs add nothing."""

import datetime as dt

from pyspark.sql import functions as F

from haulframe.plans.registry import load_all
from haulframe.session import scratch_path
from haulframe.streaming import payments as pm
from tests.conftest import SMALL


def _lines(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def _payload(i, typ, minute, user=1, cents=100):
    obj = {"id": f"evt_{i}", "type": typ, "created": f"2024-01-01T00:{minute:02d}:00.000000",
           "data": {"object": {"id": f"cs_{i}", "amount_total": cents, "metadata": {"user_id": str(user)}}}}
    import json
    return json.dumps(obj)


def test_route_stream_equals_batch(spark, tables):
    stream = load_all()["stm1_route_events"].fn(spark, SMALL)
    batch = pm.route_events(pm.parse(pm.payloads_from_events(tables.events))).select("id", "route")
    assert sorted(map(tuple, stream.collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)


def test_redelivery_after_restart_adds_nothing(spark):
    src, out, ck = scratch_path(spark, "t-src"), scratch_path(spark, "t-out"), scratch_path(spark, "t-ck")
    _lines(spark, [_payload(1, pm.EVENT_PAYMENT, 1), _payload(2, pm.EVENT_REFUND, 2)]).coalesce(1) \
        .write.mode("append").text(src)

    def run():
        s = spark.readStream.format("text").load(src)
        parsed = pm.parse(s).where(F.col("id").isNotNull())
        pm.run_dedupe(parsed.select("id", "created"), out, ck)

    run()
    # the same events delivered again, plus one new event, then the query restarts from its checkpoint
    _lines(spark, [_payload(1, pm.EVENT_PAYMENT, 1), _payload(3, pm.EVENT_PAYMENT, 3)]).coalesce(1) \
        .write.mode("append").text(src)
    run()
    ids = sorted(r.id for r in spark.read.parquet(out).collect())
    assert ids == ["evt_1", "evt_2", "evt_3"]


def test_batch_sink_rerun_is_idempotent(spark):
    out = scratch_path(spark, "t-idem")
    sink = pm._batch_sink(out)
    batch = spark.createDataFrame([("a", 1)], "id string, v int")
    sink(batch, 0)
    sink(batch, 0)  # the same micro-batch executed again after a failure
    assert spark.read.parquet(out).count() == 1


def test_payment_amounts_are_decimal_cents(spark):
    routed = pm.route_events(pm.parse(_lines(spark, [_payload(7, pm.EVENT_PAYMENT, 5, user=3, cents=1999)])))
    sessions = spark.createDataFrame([("3", "Acme")], "user_ref string, customer_name string")
    r = pm.payment_facts(routed, sessions).first()
    assert str(r.amount) == "19.99" and r.status == "ok" and r.created == dt.datetime(2024, 1, 1, 0, 5)


def test_malformed_payload_is_set_apart(spark):
    r = pm.route_events(pm.parse(_lines(spark, ['{"id": "evt_9", "typ'])))
    assert [x.route for x in r.collect()] == ["malformed"]


def test_late_and_distant_events_are_kept(spark):
    src, out, ck = scratch_path(spark, "t-src"), scratch_path(spark, "t-out"), scratch_path(spark, "t-ck")

    def payload(i, day):
        return _payload(i, pm.EVENT_PAYMENT, 0).replace("2024-01-01", day)

    def run():
        pm.run_dedupe(pm.parse(spark.readStream.format("text").load(src)).select("id", "created"), out, ck)

    # events over months, the last one older than all before it, one delivered twice much later
    for day_rows in ([payload(1, "2024-03-01"), payload(2, "2024-06-30")], [payload(3, "2024-01-02"), payload(1, "2024-03-01")]):
        _lines(spark, day_rows).coalesce(1).write.mode("append").text(src)
        run()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["evt_1", "evt_2", "evt_3"]


def test_subscription_state_survives_a_restart(spark):
    src, state, ck = scratch_path(spark, "t-src"), scratch_path(spark, "t-state"), scratch_path(spark, "t-ck")
    initial = spark.createDataFrame([("old@x", "acme", "lo", False)], "email string, company string, area string, removed boolean")

    def run(arrival, mail):
        _lines(spark, [f"{arrival},{mail}"]).coalesce(1).write.mode("append").text(src)
        stream = spark.readStream.format("text").load(src).select(
            F.split("value", ",")[0].cast("bigint").alias("arrival"), F.split("value", ",")[1].alias("em_nl"),
            F.lit("c").alias("cp_name"), F.lit(1).alias("tp_area"))
        pm.stream_subscriptions(spark, stream, state, initial, ck)

    run(1, "new@x")
    run(2, "later@x")
    assert sorted(r.email for r in pm.read_subscriptions(spark, state).collect()) == ["later@x", "new@x", "old@x"]


def test_events_without_a_time_are_delivered(spark, tables, tmp_path):
    """Rows with a null ts reach the streams; a sign-up request without one keeps its place in the order of arrival."""
    import duckdb

    for name in ("events", "customer"):
        table = spark.read.parquet(f"{SMALL}/{name}.parquet")
        if name == "events":
            table = table.withColumn("ts", F.when(F.col("event_id") % 3 > 0, F.col("ts")))
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("events", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("stm1_route_events", "stm2_dedupe_events", "stm5_stream_subscriptions"):
        job = load_all()[name]
        got = job.fn(spark, str(tmp_path))
        want = con.execute(job.sql)
        at = [got.columns.index(d[0]) for d in want.description]
        found = [tuple(r[i] for i in at) for r in got.collect()]
        assert sorted(map(repr, found)) == sorted(map(repr, want.fetchall())), name


def test_dedupe_reads_only_the_places_of_late_rows(spark, monkeypatch):
    """Rows near their arrival need no stored ids; late ones read the folders of their own days and hashes."""
    src, out, ck = scratch_path(spark, "t-src"), scratch_path(spark, "t-out"), scratch_path(spark, "t-ck")
    asked = []
    plain = pm.stored_events

    def watched(like, out_dir, columns, before=None, places=None):
        found = plain(like, out_dir, columns, before, places)
        if places is not None and found is not None:
            asked.append({d for d, _ in places})
            scan = next(line for line in found._jdf.queryExecution().toString().splitlines() if "FileScan" in line)
            # the condition is on the folders, and nothing is left to filter in the rows
            assert "PartitionFilters: [isnotnull(batch_id" in scan and "concat_ws" in scan and "DataFilters: []" in scan, scan
        return found

    monkeypatch.setattr(pm, "stored_events", watched)

    def run(rows, arrived):
        _lines(spark, [_payload(i, pm.EVENT_PAYMENT, 0).replace("2024-01-01", day) for i, day in rows]).coalesce(1).write.mode("append").text(src)
        parsed = pm.parse(spark.readStream.format("text").load(src)).select("id", "created")
        pm.run_dedupe(parsed, out, ck, arrived=F.lit(arrived).cast("timestamp"))

    run([(i, f"2024-01-{1 + i % 9:02d}") for i in range(90)], "2024-01-09 01:00:00")
    # repeats of a recent event and of two old ones, all known to the state; a late new one and a new one
    run([(8, "2024-01-09"), (0, "2024-01-01"), (9, "2024-01-01"), (500, "2024-01-02"), (501, "2024-01-10")], "2024-01-10 00:30:00")
    run([(502, "2024-03-01")], "2024-03-01 00:00:00")
    run([(505, "2024-03-01")], "2024-03-01 12:00:00")
    # the state has forgotten these by now
    run([(0, "2024-01-01"), (7, "2024-01-08"), (500, "2024-01-02"), (503, "2024-01-08"), (504, "2024-03-02")], "2024-03-02 00:00:00")
    stored = plain(spark.createDataFrame([], "id string, created timestamp_ntz"), out, ["id", "created"])
    ids = [r.id for r in stored.collect()]
    assert sorted(ids) == sorted(f"evt_{i}" for i in [*range(90), 500, 501, 502, 503, 504, 505])
    assert asked == [{"2024-01-02"}, {"2024-01-01", "2024-01-02", "2024-01-08"}]


def test_a_repeated_batch_of_events_overwrites_itself(spark):
    """The stream's commit is lost after its batch was written: the batch runs again and adds nothing."""
    import os

    src, out, ck = scratch_path(spark, "t-src"), scratch_path(spark, "t-out"), scratch_path(spark, "t-ck")

    def run():
        pm.run_dedupe(pm.parse(spark.readStream.format("text").load(src)).select("id", "created"), out, ck)

    _lines(spark, [_payload(i, pm.EVENT_PAYMENT, i) for i in range(5)]).write.mode("append").text(src)
    run()
    commits = ck.removeprefix("file:") + "/commits"
    for name in ("0", ".0.crc"):
        if os.path.exists(f"{commits}/{name}"):
            os.remove(f"{commits}/{name}")
    run()
    like = spark.createDataFrame([], "id string, created timestamp_ntz")
    assert sorted(r.id for r in pm.stored_events(like, out, ["id", "created"]).collect()) == [f"evt_{i}" for i in range(5)]


def _count_lines(spark, src, users):
    _lines(spark, users).coalesce(1).write.mode("append").text(src)


def test_running_counts_after_a_restart_and_a_repeated_batch(spark):
    import os

    src, out, ck = scratch_path(spark, "t-src"), scratch_path(spark, "t-out"), scratch_path(spark, "t-ck")

    def run():
        pm.run_running_counts(spark.readStream.format("text").load(src).select(F.col("value").alias("user_ref")), out, ck, bucket_rows=4)
        return {r.user_ref: r.requests for r in pm.latest_counts(spark, out).collect()}

    _count_lines(spark, src, [f"u{i % 20}" for i in range(50)])
    assert run() == {f"u{i}": 3 if i < 10 else 2 for i in range(20)}
    _count_lines(spark, src, ["u0", "u0", "new"])
    assert run() == {"u0": 5, "new": 1, **{f"u{i}": 3 if i < 10 else 2 for i in range(1, 20)}}
    table = pm.VersionedTable(spark, out, "user_ref", 4)
    m = table.manifest()
    assert len(m.buckets) > 4 and max(b.rows for b in m.buckets) <= 8 and sum(b.rows for b in m.buckets) == 21
    # the second batch touched the buckets of two users only: the others keep their files
    older = {b.path for b in table.manifest(m.version - 1).buckets}
    assert len([b for b in m.buckets if b.path not in older]) <= 4
    commits = ck.removeprefix("file:") + "/commits"
    for name in os.listdir(commits):
        if name.strip(".").split(".")[0] == "1":
            os.remove(f"{commits}/{name}")
    again = run()
    assert again["u0"] == 5 and again["new"] == 1 and table.manifest().version == m.version


def test_a_version_is_seen_when_committed_and_not_before(spark, monkeypatch):
    from haulframe.streaming.versions import VersionedTable

    table = VersionedTable(spark, scratch_path(spark, "t-versions"), "k", bucket_rows=10)
    table.create(spark.createDataFrame([(f"k{i}", i) for i in range(25)], "k string, v long"))
    table.create(spark.createDataFrame([("other", 1)], "k string, v long"))  # there already: nothing happens
    assert len(table.manifest().buckets) == 4 and table.read().count() == 25

    def merge(rows, changes):
        return rows.join(changes, "k", "left_anti").unionByName(changes)

    def change(n, tag):
        return spark.createDataFrame([(f"k{i}", -1) for i in range(n)] + [(tag, 0)], "k string, v long")

    pinned = table.read()
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_commit", lambda self, m: (_ for _ in ()).throw(OSError("ended")))
        try:
            table.apply(change(3, "lost"), F.col("k"), merge, stream="s", batch_id=0)
            raise AssertionError
        except OSError:
            pass
    assert sorted(map(tuple, table.read().collect())) == sorted((f"k{i}", i) for i in range(25))
    assert table.apply(change(3, "new"), F.col("k"), merge, stream="s", batch_id=0)
    assert not table.apply(change(9, "again"), F.col("k"), merge, stream="s", batch_id=0)
    want = {f"k{i}": -1 if i < 3 else i for i in range(25)} | {"new": 0}
    assert {r.k: r.v for r in table.read().collect()} == want
    assert pinned.count() == 25 and table.read(0).where("v < 0").count() == 0
    # another writer commits first
    other = VersionedTable(spark, table.root, "k", 10)
    held = table.manifest()
    other.apply(change(1, "other"), F.col("k"), merge, stream="t", batch_id=0)
    try:
        table._commit(type(held)(held.version + 1, held.buckets))
        raise AssertionError
    except RuntimeError:
        pass
    before = {r.k for r in table.read().collect()}
    assert table.expire(keep=1) > 0 and table.versions() == [2] and {r.k for r in table.read().collect()} == before
