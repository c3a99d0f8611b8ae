"""Run states as a stream with late events, silence and a restart."""

import json

from heddle.streaming import runs


def test_states_silence_and_restart(spark, one_task, tmp_path):
    source, cp = tmp_path / "in", str(tmp_path / "cp")
    source.mkdir()
    before = {k: spark.conf.get(k, None) for k in runs.PROVIDER}

    def send(name, rows):
        (source / name).write_text("\n".join(json.dumps({"run_id": r, "id": i, "state": s, "happened": f"2024-01-01T{t}:00"}) for r, i, s, t in rows))
        stream = spark.readStream.schema("run_id string, id long, state string, happened timestamp").json(str(source))
        q = runs.run_states(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination(200)
        assert q.exception() is None
        return {(r.run_id, r.id): (r.state, r.before, r.allowed, r.late) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    try:
        for k, v in runs.PROVIDER.items():
            spark.conf.set(k, v)
        got = send("1.json", [("a", 1, "queued", "00:00"), ("a", 2, "starting", "00:01"), ("a", 3, "completed", "00:02"), ("b", 4, "running", "00:00"), ("b", 5, "queued", "00:03"), ("c", 6, "queued", "00:03")])
        assert got == {
            ("a", 1): ("queued", None, True, False), ("a", 2): ("starting", "queued", True, False), ("a", 3): ("completed", "starting", False, False),
            ("b", 4): ("running", None, False, False), ("b", 5): ("queued", None, True, False), ("c", 6): ("queued", None, True, False),
        }
        got = send("2.json", [("a", 7, "running", "00:20"), ("b", 8, "starting", "00:02"), ("a", 9, "completed", "00:21")])  # after a restart; b's is late
        assert got["a", 7] == ("running", "starting", True, False) and got["b", 8] == ("starting", "queued", False, True) and got["a", 9][2]
        got = send("3.json", [("d", 10, "queued", "02:00")])
        assert got["b", None] == ("failed", "queued", True, False) and got["c", None] == ("failed", "queued", True, False) and ("a", None) not in got and ("d", None) not in got
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
