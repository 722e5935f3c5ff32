import random
from datetime import datetime, timedelta, timezone

from codelattice.streaming import queue, watch
from conftest import rows
from pyspark.sql import functions as F


def test_batches_of_a_table_match_the_rule(spark):
    rng = random.Random(2)
    data = [(k, float(rng.randint(0, 400))) for k in "ab" for _ in range(120)] + [("c", None), ("d", 5.0)]
    df = spark.createDataFrame(data, "key string, at double")
    want = []
    for k in "abd":
        times = sorted(t for x, t in data if x == k)
        for batch in watch.close_times(times, 4, 20):
            want.append((k, times[batch[0]], times[batch[-1]], len(batch)))
    assert rows(watch.debounced(df, "key", "at", 4, 20)) == sorted(want, key=repr)
    assert rows(watch.debounced(df.limit(0), "key", "at", 4, 20)) == []


def test_the_stream_gives_the_batches_of_the_table(spark, tmp_path):
    start = datetime(2025, 1, 1, tzinfo=timezone.utc)
    seconds = [0, 1, 2, 9, 10, 30, 33, 36, 39, 42, 45, 48, 100]
    events = spark.createDataFrame([("k", f"p{s % 3}", start + timedelta(seconds=s)) for s in seconds] + [("k", "end", start + timedelta(hours=2))], "key string, path string, event_time timestamp")
    source = str(tmp_path / "events")
    events.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    out = watch.debounced_stream(stream, 4.0, 10.0)
    run = out.writeStream.format("memory").queryName("debounced_test").outputMode("append").option("checkpointLocation", watch.checkpoint_for(spark, f"t{random.random()}")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted((int(r.batch_start - start.timestamp()), r.n_events) for r in spark.table("debounced_test").collect())
    want = [(seconds[b[0]], len(b)) for b in watch.close_times([float(s) for s in seconds], 4, 10)]
    assert got == want


def test_micro_batches_replace_files_and_equal_a_full_build(spark, tmp_path):
    schema = "qualified_name string, file_path string, file_hash string, updated_at double"
    steps = [[("a::x", "a", "1", 1.0), ("a::y", "a", "1", 1.0), ("b::z", "b", "1", 1.0)], [("a::x", "a", "2", 2.0)], [("c::n", "c", "1", 3.0)]]
    source = str(tmp_path / "in")
    state = {"nodes": spark.createDataFrame([], schema)}

    def each(batch, _):
        state["nodes"] = spark.createDataFrame(watch.incremental_nodes(state["nodes"], batch).collect(), schema)

    for i, step in enumerate(steps):
        spark.createDataFrame(step, schema).coalesce(1).write.mode("append").parquet(source)
        watch.run_available(spark.readStream.schema(schema).parquet(source), f"inc{id(tmp_path)}", each)
    assert rows(state["nodes"].select("qualified_name", "file_hash")) == [("a::x", "2"), ("b::z", "1"), ("c::n", "1")]


def test_queue(spark):
    t = [(1, "update", 0, "pending", 1, 10.0, None), (2, "update", 5, "pending", 0, 5.0, None), (3, "embed", 1, "running", 3, 0.0, None), (4, "prune", 9, "pending", 0, 99.0, None), (5, "embed", 1, "running", 1, 0.0, None)]
    tasks = spark.createDataFrame(t, "id long, kind string, priority long, state string, attempts long, not_before double, last_error string").withColumn("created_at", F.timestamp_seconds("id"))
    assert rows(queue.coalesced(tasks).select("kind", "id", "priority", "n_merged")) == [("prune", 4, 9, 1), ("update", 1, 5, 2)]
    assert [r.id for r in queue.claimable(tasks, 50.0).collect()] == [2, 1]
    assert {r.id: r.state for r in queue.recovered(tasks).collect()} == {1: "pending", 2: "pending", 3: "dead", 4: "pending", 5: "pending"}
    failures = spark.createDataFrame([(3, "boom", False), (5, "late", False), (4, "bad", True)], "id long, error string, fatal boolean")
    assert {r.id: (r.state, r.last_error) for r in queue.failed(tasks, failures, 100.0).collect() if r.id > 2} == {3: ("dead", "boom"), 4: ("dead", "bad"), 5: ("pending", "late")}
    asked = spark.createDataFrame([("update", 7), ("update", 8), ("lint", 2)], "kind string, priority long").withColumn("created_at", F.timestamp_seconds(F.lit(99)))
    after = queue.enqueue(tasks, asked)
    assert {r.id: (r.kind, r.priority) for r in after.collect() if r.id in (1, 2, 6)} == {1: ("update", 8), 2: ("update", 5), 6: ("lint", 2)}
