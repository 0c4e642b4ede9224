"""The floor machine: the stream on shuffled, late and repeated input, the batch, and plain Python give the same rows."""

import random
from datetime import datetime, timedelta

from convolens.streaming import dialogues

EVENTS = "simulation_id long, event_id long, ts timestamp, kind string"
START = datetime(2024, 1, 1)


def walked(rows, patience):
    out = []
    for sim in sorted({r[0] for r in rows}):
        user = agent = asked = False
        since, seen = None, set()
        own = sorted((r[2], r[1], r[3]) for r in rows if r[0] == sim)
        for ts, event_id, kind in [*own, (START + timedelta(days=1), None, None)]:
            before = dialogues.state_of(user, agent, asked)
            if before == "waiting" and ts >= since + timedelta(seconds=patience):
                out.append((sim, since + timedelta(seconds=patience), None, "waiting", "idle"))
                asked, before = False, "idle"
            if kind not in dialogues.KINDS or event_id in seen:
                continue
            seen.add(event_id)
            if kind == "user_stop":
                asked, user = user or asked, False
            elif kind == "agent_stop":
                agent = False
            else:
                asked = False
                user, agent = user or kind == "user_start", agent or kind == "agent_start"
            after = dialogues.state_of(user, agent, asked)
            if after != before:
                out.append((sim, ts, event_id, before, after))
            if after == "waiting" and before != "waiting":
                since = ts
    return sorted(out, key=str)


def random_events(seed, n=400):
    rng, rows, at = random.Random(seed), [], 0
    for k in range(n):
        at += rng.choice((0, 1, 2, 5, 12))
        rows.append((rng.randrange(3), k, START + timedelta(seconds=at), rng.choice((*dialogues.KINDS, "noise"))))
    return rows


def shown(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_batch_equals_a_walk(spark):
    for seed in (1, 2):
        rows = random_events(seed)
        got = dialogues.floor_states_batch(spark.createDataFrame([*rows, *rows[:50], (None, 1, START, "user_start")], EVENTS))
        assert shown(got) == walked(rows, dialogues.PATIENCE)


def test_stream_equals_batch_on_shuffled_late_and_repeated_input(spark, tmp_path):
    rows = random_events(3, 150)
    rng = random.Random(9)
    shuffled = [r for _, r in sorted((k + rng.uniform(0, 25), r) for k, r in enumerate(rows))]
    feed = shuffled + rng.sample(shuffled[-20:], 10) + [(99, 10_000, START + timedelta(days=1), "agent_start")]
    cuts = [0, 40, 90, len(feed) - 1, len(feed)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        spark.createDataFrame(feed[a:b], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        job = dialogues.floor_states(stream, late="1 hour").writeStream.format("memory").queryName("floor").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
        job.awaitTermination(200)
        got = [r for r in shown(spark.table("floor")) if r[0] != 99]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    wanted = walked(rows, dialogues.PATIENCE)
    assert (sorted(set(got) - set(wanted), key=str), sorted(set(wanted) - set(got), key=str)) == ([], []) and len(got) == len(wanted)
