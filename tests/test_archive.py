"""Archive by age: a round trip, and runs that break off at each step."""

import os
from datetime import datetime

import pytest

from heddle.sources import archive as A


def live_table(spark, path):
    rows = [(i, datetime(2024, 1 + i % 4, 1 + i % 20), f"row {i}") for i in range(200)]
    A.write_live(spark.createDataFrame(rows, "id long, at timestamp, what string").repartition(3), "at", path)
    return rows


def held(spark, live, archive):
    ids = [r.id for m in A.months(spark, live) for r in spark.read.parquet(f"{live}/month={m}").collect()]
    return ids, [r.id for m in A.months(spark, f"{archive}/rows") if m not in A.months(spark, live) for r in A.restore(spark, archive, m).collect()]


@pytest.mark.parametrize("killed", ["rows", "manifest", "verify", "delete"])
def test_nothing_is_lost_when_a_run_breaks_off(spark, tmp_path, killed):
    live, archive = str(tmp_path / "live"), str(tmp_path / "archive")
    rows = live_table(spark, live)

    def stop(what, month):
        if what == killed and month == "2024-02":
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        A.archive_before(spark, live, archive, "2024-04", stop)
    one, two = held(spark, live, archive)
    assert sorted(one + two) == [r[0] for r in rows] and A.months(spark, live) == ["2024-02", "2024-03", "2024-04"]
    assert A.archive_before(spark, live, archive, "2024-04") == ["2024-02", "2024-03"]
    one, two = held(spark, live, archive)
    assert sorted(one + two) == [r[0] for r in rows] and A.months(spark, live) == ["2024-04"]
    assert A.archive_before(spark, live, archive, "2024-04") == []


def test_restore_verifies(spark, tmp_path):
    live, archive = str(tmp_path / "live"), str(tmp_path / "archive")
    rows = live_table(spark, live)
    A.archive_before(spark, live, archive, "2024-02")
    assert {(r.id, r.at, r.what) for r in A.restore(spark, archive, "2024-01").collect()} == {r for r in rows if r[1].month == 1}
    with pytest.raises(ValueError, match="manifest"):
        A.restore(spark, archive, "2024-03")
    folder = tmp_path / "archive" / "rows" / "month=2024-01"
    one = next(f for f in os.listdir(folder) if f.endswith(".parquet"))
    os.remove(folder / one)
    with pytest.raises(ValueError, match="manifest"):
        A.restore(spark, archive, "2024-01")
