"""Streams with state and event time against plain versions."""

import random
from datetime import datetime, timedelta

from codegrove.streaming import changes as C


def test_changes_between_listings(spark, tmp_path):
    """Files come, change, go, stay away for several listings and come back; several listings may lie in one batch."""
    rng, start, gap = random.Random(3), datetime(2024, 3, 1), timedelta(hours=6)
    polls, want, before = [], [], {}
    alive = {}
    for k in range(9):
        for f in "abcdefghij":
            p = rng.random()
            if f in alive and p < 0.3:
                del alive[f]
            elif f not in alive and p < 0.5 or f in alive and p < 0.5:
                alive[f] = alive.get(f, 0) + k + 1
        at = start + k * gap
        polls.append([(f, m, at) for f, m in alive.items()])
        for f in sorted({*alive, *before}):
            if f not in before:
                want.append((f, "created", at))
            elif f not in alive:
                want.append((f, "deleted", at))
            elif before[f] != alive[f]:
                want.append((f, "modified", at))
        before = dict(alive)
    schema, base = "path string, mtime long, at timestamp", str(tmp_path)
    with C.rocks(spark):
        stream = C.detect_changes(spark.readStream.schema(schema).parquet(f"{base}/in/*"), gap)
        for k, rows in enumerate([polls[0], polls[1], polls[2] + polls[3], polls[4], polls[5], polls[6] + polls[7] + polls[8],
                                  [("", 0, start + 8 * gap + timedelta(milliseconds=1))]]):
            spark.createDataFrame(rows, schema).write.parquet(f"{base}/in/{k}")
            C.drained(stream, f"{base}/out", f"{base}/checkpoint")
    got = [tuple(r) for r in spark.read.schema(C.CHANGES).parquet(f"{base}/out").filter("path <> ''").collect()]
    assert sorted(got) == sorted(want)


def test_late_and_repeated_events(spark, tmp_path):
    t0, base = datetime(2024, 5, 1, 12), str(tmp_path)
    minutes = lambda n: t0 + timedelta(minutes=n)
    first = [(1, 7, minutes(0), "x"), (2, 7, minutes(9), "error"), (3, 7, minutes(40), "x"), (4, 8, minutes(60), "x")]
    # 2 again; one late but in time, joining its session; one too late
    second = [(2, 7, minutes(9), "error"), (5, 7, minutes(45), "x"), (6, 8, minutes(5), "x"), (4, 8, minutes(60), "x")]
    end = [(-1, None, minutes(9999), "end")]
    schema = "event_id long, user_id long, ts timestamp, event_type string"
    stream = C.sessions(spark.readStream.schema(schema).parquet(f"{base}/in/*"), "10 minutes", "30 minutes")
    for k, rows in enumerate((first, second, end)):
        spark.createDataFrame(rows, schema).write.parquet(f"{base}/in/{k}")
        C.drained(stream, f"{base}/out", f"{base}/checkpoint")
    got = {(r.user_id, r.started, r.ended, r.events, r.errors) for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {
        (7, minutes(0), minutes(19), 2, 1), (7, minutes(40), minutes(55), 2, 0), (8, minutes(60), minutes(70), 1, 0),
    }
