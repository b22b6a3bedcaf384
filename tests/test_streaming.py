import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cairn.operators.sessions import swept
from cairn.streaming.activity import activity_windows, drain
from cairn.streaming.lifecycle import archived_sessions


def test_stream_gives_the_sessions_that_a_batch_gives(spark, tmp_path):
    t = datetime(2024, 1, 1)
    touches = [(u, t + timedelta(minutes=m), float(m)) for u, ms in ((1, (0, 10, 35, 90, 95)), (2, (5, 50)), (9, (5000,))) for m in ms]
    df = spark.createDataFrame(touches, "user_id long, ts timestamp, value double")
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    got = drain(activity_windows(stream), "activity", f"file://{tmp_path}/cp")
    key = lambda r: (r.user_id, r.began, r.expires_at, r.touches, r.value)
    batch = sorted(map(key, activity_windows(df).where(F.col("user_id") < 9).collect()))
    assert batch == sorted(map(key, got.where(F.col("user_id") < 9).collect()))
    assert [b[3] for b in batch] == [3, 2, 1, 1]


def test_expired_sessions_of_a_stream_are_those_of_a_batch_sweep(spark, tmp_path):
    rng = random.Random(3)
    start, ttl = datetime(2024, 1, 1), 3600
    states = ["begun", "evidence_taken", "drafting", "validated", "committed", "abandoned", None]
    rows = []
    for i in range(25):
        at = start + timedelta(minutes=rng.randint(0, 900))
        for _ in range(rng.randint(1, 6)):
            rows.append((f"s{i}", f"r{i % 4}", at, rng.choice(states), 1, rng.randint(0, 3), rng.randint(0, 90)))
            at += timedelta(minutes=rng.randint(1, 59))
    rows.sort(key=lambda r: r[2])
    kind = "session_id string, repo_id string, at timestamp, state string, turns long, tool_calls long, tokens long"
    now = start + timedelta(minutes=700)  # the watermark at the end: sessions whose expiry is not past it stay open
    rows = [r for r in rows if r[2] <= now - timedelta(minutes=1)] + [("clock", "r", now, None, 0, 0, 0)]
    for k in range(0, len(rows), 20):
        spark.createDataFrame(rows[k : k + 20], kind).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        time.sleep(1.1)  # files are read by age
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    run = archived_sessions(stream, ttl).writeStream.format("memory").queryName("archived").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
    run.awaitTermination(300)
    got = {tuple(r) for r in spark.table("archived").collect()}
    want = set()
    for s in {r[0] for r in rows} - {"clock"}:
        own = [r for r in rows if r[0] == s]
        left, expires = next((r[3] for r in reversed(own) if r[3]), "begun"), own[-1][2] + timedelta(seconds=ttl)
        if expires <= now and left not in ("committed", "abandoned"):
            want.add((s, own[0][1], left, len(own), sum(r[5] for r in own), sum(r[6] for r in own), own[0][2], expires))
    assert got == want and len(want) > 5
    sessions = spark.createDataFrame([(s, r, o, None, c, e) for s, r, o, _, _, _, c, e in got], "session_id string, repo_id string, state string, abandoned_at timestamp, created_at timestamp, expires_at timestamp")
    assert {r.action for r in swept(sessions, F.lit(now), 10**9).collect()} == {"archive"}


def test_a_touch_after_the_expiry_opens_a_session_anew(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [("a", "r", start, "drafting", 1, 1, 1), ("a", None, start + timedelta(seconds=5), None, 1, 1, 1), ("a", "r", start + timedelta(hours=3), "committed", 7, 7, 7)]
    touches = spark.createDataFrame(rows, "session_id string, repo_id string, at timestamp, state string, turns long, tool_calls long, tokens long")
    touches.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(touches.schema).parquet(f"file://{tmp_path}/in")
    got = drain(archived_sessions(stream, 60), "anew", f"file://{tmp_path}/cp").collect()
    assert [(r.outcome, r.turns, r.created_at, r.expires_at) for r in got] == [("drafting", 2, start, start + timedelta(seconds=65))]
