"""Streams with a state of their own against their twins over tables."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from examlattice.plans import guarded
from examlattice.plans.queries import Tables, attempt_events
from examlattice.streaming import guards, jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture
def own(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    return session


def in_batches(rows, path, order, n=3):
    """Writes rows as n files in the order of time, as they would arrive."""
    table = rows.withColumn("part", F.ntile(n).over(Window.orderBy(*order))).cache()
    for i in range(1, n + 1):
        table.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)
    table.unpersist()


def stream(own, make, rows, tmp_path, mode, name):
    source = own.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = make(source).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    return own.table(name)


def test_lock_rules():
    s, fails = guards.SECOND, []
    for i in range(5):
        left, fails = guards.judge(fails, "name", i * 60 * s, "a", False)
        assert left == 0
    assert guards.judge(fails, "name", 240 * s + 1, "a", True)[0] == 900  # even the right password has to wait
    assert guards.judge(fails, "name", (240 + 899) * s, "a", False) == (1, fails)
    left, fails = guards.judge(fails, "name", (240 + 900) * s, "a", False)
    assert left == 0 and len(fails) == 2  # the others are older than the window
    assert guards.judge(fails, "name", 1200 * s, "a", True) == (0, [])
    mixed = [(1, "a"), (2, "b")]
    assert guards.judge(mixed, "ip", 3, "b", True) == (0, [(1, "a")])


def test_locks_on_a_stream(own, tmp_path):
    rows = guarded.logins(Tables(own, SF)).withColumns({"ip": F.lit("10.0.0.1"), "ts": F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 8))})
    in_batches(rows, str(tmp_path / "in"), ["ts", "attempt_id"])
    found = stream(own, lambda s: guards.lockouts(s, "1 second"), rows, tmp_path, "append", "locks")
    want = {tuple(r) for r in guards.lockouts_batch(rows).collect()}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want) and any(r[4] > 0 for r in want) and {r[1] for r in want if r[4] > 0} == {"name", "ip"}


def test_saves_on_a_stream(own, tmp_path):
    rows = guarded.save_events(Tables(own, SF))
    in_batches(rows, str(tmp_path / "in"), [F.col("kind") != "start", "ts", "seq"])
    found = stream(own, lambda s: guards.saved_answers(s, late="60 days"), rows, tmp_path, "update", "saves")
    want = {tuple(r) for r in guards.saves_in_time(rows).collect()}
    assert {tuple(r) for r in guards.current_answers(found).collect()} == want
    assert found.where("NOT taken").count() == rows.where("kind = 'save'").count() - found.where("taken").count() > 0


def test_older_writes_do_nothing(own, tmp_path):
    schema = "attempt_id long, kind string, question_id long, field string, value string, ts timestamp, seq long, deadline_at timestamp"
    at = lambda s: f"2024-01-01 00:00:{s:02d}"
    batches = [[(1, "start", -1, "", "", at(0), 0, at(30)), (1, "save", 1, "answer", "B", at(20), 5, None)], [(1, "save", 1, "answer", "A", at(10), 3, None), (1, "save", 2, "answer", "C", at(33), 6, None), (1, "save", 2, "answer", "D", at(34), 7, None), (2, "save", 1, "marked", "", at(40), 8, None)]]
    rows = None
    for b in batches:
        rows = own.createDataFrame(b, schema.replace("timestamp", "string")).withColumns({c: F.col(c).cast("timestamp") for c in ("ts", "deadline_at")})
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    found = stream(own, guards.saved_answers, rows, tmp_path, "update", "older")
    assert sorted((r.attempt_id, r.question_id, r.value, r.taken) for r in found.where("value IS NOT NULL").collect()) == [(1, 1, "B", True), (1, 2, "C", True), (1, 2, "D", False)]
    assert {tuple(r) for r in guards.current_answers(found).collect()} == {(1, 1, "B", None, None), (1, 2, "C", None, None), (2, 1, None, None, None)}


def test_attempts_are_graded_when_they_end(own, tmp_path):
    rows = attempt_events(Tables(own, SF)).withColumn("deadline_at", F.when(F.col("kind") == "start", F.col("ts") + F.expr("INTERVAL 20 HOURS")))
    end = rows.agg((F.max("ts") + F.expr("INTERVAL 900 HOURS")).alias("ts")).select(F.lit(-7).cast("long").alias("attempt_id"), "ts")
    last = end.select("attempt_id", "ts", F.lit(1).cast("long").alias("question_id"), F.lit("A").alias("value"), F.lit("save").alias("kind"), F.lit(None).cast("timestamp").alias("deadline_at"))
    first, second = rows.where("kind = 'start'"), rows.where("kind != 'start'")
    for part in (first.unionByName(second), last, last.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sheet = guarded.sheets(Tables(own, SF))
    found = stream(own, lambda s: guards.graded(jobs.closed_attempts(s), sheet), rows, tmp_path, "append", "graded")
    want = {tuple(r) for r in guards.graded(jobs.closed_attempts_batch(rows, "2100-01-01 00:00:00"), sheet).collect()}
    assert {tuple(r) for r in found.collect()} == want and {r[1] for r in want} == {"expired", "submitted"}
