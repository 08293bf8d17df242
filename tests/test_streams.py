"""Streams stopped and begun again, late rows, repeated batches, pending writes and superseded jobs."""

import datetime
import json
import random

import pytest

from waybill.streaming import journal, windows

SCHEMA = "id long, ts timestamp, user string, value double"


def arrive(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("".join(json.dumps(dict(zip(("id", "ts", "user", "value"), r))) + "\n" for r in rows))


def row(i, minute):
    return i, f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z", f"u{i % 2}", 1.0


def test_append_survives_a_stop(spark, tmp_path):
    source, path, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    assert journal.appended(spark, path, SCHEMA).count() == 0
    arrive(source, "a", [row(i, i) for i in range(5)])
    seen = []
    journal.append_batches(stream(), path, checkpoint, seen.append).awaitTermination(120)
    arrive(source, "b", [row(i, i) for i in range(5, 9)])
    arrive(source, "c", [row(i, i) for i in range(9, 12)])

    def stop(number):
        if number == 1:  # written, not committed
            raise RuntimeError("stopped")

    with pytest.raises(Exception, match="stopped"):
        journal.append_batches(stream(), path, checkpoint, stop).awaitTermination(120)
    assert journal.appended(spark, path, SCHEMA).count() == 9
    journal.append_batches(stream(), path, checkpoint, seen.append).awaitTermination(120)
    assert sorted(r.id for r in journal.appended(spark, path, SCHEMA).collect()) == list(range(12))
    assert seen == [0, 1, 2]  # batch 1 ran again
    journal.append_batches(stream(), path, checkpoint, seen.append).awaitTermination(120)
    assert journal.appended(spark, path, SCHEMA).count() == 12


def test_windows_over_restarts_and_late_rows(spark, tmp_path):
    source, path, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
        journal.append_batches(windows.tumbling(stream, "10 minutes", ["user"], "10 minutes"), path, checkpoint).awaitTermination(120)

    schema = "window struct<start:timestamp,end:timestamp>, user string, n long, total double"
    arrive(source, "a", [row(0, 1), row(2, 2), row(1, 3)])
    run()
    arrive(source, "b", [row(4, 35)])  # closes the first window
    run()
    arrive(source, "c", [row(6, 4), row(8, 36)])  # the first is too late
    run()
    arrive(source, "d", [row(10, 90)])
    run()
    got = sorted((r.window.start.replace(tzinfo=None), r.user, r.n) for r in journal.appended(spark, path, schema).collect())
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    assert got == [(at(0), "u0", 2), (at(0), "u1", 1), (at(30), "u0", 2)]


def test_replayed(spark):
    r = random.Random(1)
    at = datetime.datetime(2024, 1, 1)
    store = {f"k{i}": r.choice("ab") for i in range(30)}
    pending = [(f"k{r.randrange(40)}", at + datetime.timedelta(minutes=i), f"c{i % 3}", r.choice(["a", "b", None]), r.choice("abc")) for i in range(120)]
    got = {x.key: (x.body, x.applied, x.conflict) for x in journal.replayed(spark.createDataFrame(list(store.items()), "key string, body string"), spark.createDataFrame(pending, "key string, at timestamp, client string, base string, body string")).collect()}
    want = {k: [v, 0, None] for k, v in store.items()}
    for k, _, _, base, new in sorted(pending, key=lambda x: x[1:3]):
        s = want.setdefault(k, [None, 0, None])
        if s[2] is None and s[0] != new:
            s[:] = [new, s[1] + 1, None] if s[0] == base else [s[0], s[1], new]
    assert got == {k: tuple(v) for k, v in want.items() if v[0] is not None or v[2] is not None}
    assert {bool(v[2]) for v in got.values()} == {True, False}


def test_superseded_jobs_are_refused(spark, tmp_path):
    path = str(tmp_path / "stats")
    assert journal.current(spark, path) is None
    one = journal.begin(spark, path)
    assert journal.publish(spark.range(1), path, one)
    two, three = journal.begin(spark, path), journal.begin(spark, path)
    assert one < two < three and not journal.publish(spark.range(2), path, two)
    assert journal.current(spark, path).count() == 1
    assert journal.publish(spark.range(3), path, three) and journal.current(spark, path).count() == 3
