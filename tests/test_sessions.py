import datetime as dt
import random

from weftarc.operators import jobs
from weftarc.streaming import sessions

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def test_events_out_of_order_give_what_the_table_gives(spark, tmp_path):
    rng = random.Random(3)
    events = [(s, START + dt.timedelta(seconds=s), rng.randrange(20_000), rng.choice([*sessions.KINDS, "progress"])) for s in range(30) for _ in range(rng.randrange(1, 5))]
    events += [(40, START, 14_000, "result"), (40, START, 14_000, "navigation"), (41, START, 15_000, "result"), (41, START, 3, "progress")]
    rng.shuffle(events)
    schema = "session_id long, started_at timestamp, at_ms long, kind string"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sessions.ROCKS_DB)
    try:
        def batch(rows, n):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")

        (tmp_path / "in").mkdir()
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        run = lambda: sessions.session_outcomes(stream, 10_000, late="60 seconds").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(300)
        batch(events[:40], 0)
        batch(events[40:], 1)
        batch([(99, START + dt.timedelta(hours=1), 0, "progress")], 2)  # passes all timers
        assert run()
        batch([(1, START + dt.timedelta(seconds=1), 1, "tab-closed"), (98, START + dt.timedelta(hours=2), 0, "progress")], 3)  # too late for its session
        assert run()  # from the state that the first run left
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = {tuple(r) for r in spark.read.schema(sessions.OUT).parquet(f"{tmp_path}/out").collect()}
    table = spark.createDataFrame(events, schema).select("session_id", "at_ms", "kind")
    want = {tuple(r) for r in jobs.session_outcomes(table, 10_000).collect()}
    assert {r for r in got if r[0] not in (98, 99)} == want and {r[0] for r in got if r[0] > 90} <= {99}
    assert (40, "navigation", 14_000) in want and (41, "timeout", 15_000) in want
