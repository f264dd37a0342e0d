"""Archives read by members, and streams of repeated, late and disordered files against the batch result."""

import datetime as dt
import json
import random
import zipfile

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double"


def test_archive_members_are_read_by_many_tasks(spark, tmp_path):
    from plumbline.sources import archive

    want = []
    for a in ("one", "two"):
        with zipfile.ZipFile(tmp_path / f"{a}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for i in range(30):
                lines = [json.dumps({"i": i, "text": "ü " * j}, ensure_ascii=False) for j in range(i)]
                z.writestr(f"d/{i}.jsonl", "\n\n".join(lines) + ("\r\n" if i % 2 else ""))
                want += [(f"d/{i}.jsonl", 2 * j, x) for j, x in enumerate(lines)]
            z.writestr("notes.txt", "not read\n")
            z.writestr("long.jsonl", "x" * 9_000_000 + "\n" + "y" * 9_000_000)
            want += [("long.jsonl", 0, "x" * 9_000_000), ("long.jsonl", 1, "y" * 9_000_000)]
    df = archive.lines(spark, f"{tmp_path}/*.zip", partition_bytes=2000)
    assert df.rdd.getNumPartitions() > 10
    assert sorted((r.member, r.place, r.line) for r in df.collect()) == sorted(want)
    assert archive.lines(spark, f"file://{tmp_path}/one.zip", "notes*").collect()[0].line == "not read"
    assert archive.lines(spark, f"{tmp_path}/one.zip", "*.none").count() == 0 and archive.lines(spark, f"{tmp_path}/no*.zip").count() == 0


def brute_sessions(rows, gap):
    out = []
    by = {}
    for _, ts, user, _, value in {r[0]: r for r in rows}.values():
        if ts is not None:
            by.setdefault(user, []).append((ts, value))
    for user, events in by.items():
        events.sort()
        run = [events[0]]
        for e in events[1:]:
            if e[0] - run[-1][0] > gap:
                out.append((user, run))
                run = []
            run.append(e)
        out.append((user, run))
    return {(u, r[0][0], r[-1][0], len(r), round(sum(v for _, v in r), 6)) for u, r in out}


def test_sessions_of_disordered_files_are_the_batch_result(spark, tmp_path):
    from plumbline.streaming import incremental as inc

    rnd, day, gap = random.Random(7), dt.datetime(2024, 1, 1), dt.timedelta(minutes=30)
    rows = [(i, day + dt.timedelta(minutes=rnd.uniform(0, 3000)), rnd.choice([1, 1, 1, 2, 3, None]), "view", float(rnd.randrange(9))) for i in range(400)]
    rows += [(1000, day, 9, "view", 1.0), (1001, day + gap, 9, "view", 1.0), (1002, day + 2 * gap + dt.timedelta(microseconds=1), 9, "view", 1.0)]
    batch = inc.sessions(inc.once(spark.createDataFrame(rows + rows[:50], EVENT)))
    want = brute_sessions(rows, gap)
    assert {(r.user_id, r.start, r["last"], r.n, round(r.total, 6)) for r in batch.collect()} == want

    # Files in the order of time but for a shuffle within the lateness, every fourth event sent twice; one file a batch.
    rows.sort(key=lambda r: r[1] + dt.timedelta(minutes=rnd.uniform(0, 50)))
    stream = [x for i, r in enumerate(rows) for x in ([r, r] if i % 4 == 0 else [r])]
    end = [(-1, day + dt.timedelta(days=30), 99, "end", 0.0)], [(-2, day + dt.timedelta(days=60), 99, "end", 0.0)]
    size = -(-len(stream) // 6)
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    closed = inc.sessions(inc.once(inc.watermarked(source, "2 hours")))
    for i, part in enumerate([stream[k : k + size] for k in range(0, len(stream), size)] + list(end)):
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if i in (3, 6, 7):  # stopped and taken up again from its checkpoint
            q = inc.start_append(closed, f"{tmp_path}/out", f"{tmp_path}/ckpt")
            q.awaitTermination(120)
            assert q.exception() is None
    got = [(r.user_id, r.start, r["last"], r.n, round(r.total, 6)) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert {g for g in got if g[0] != 99} == want and len([g for g in got if g[0] != 99]) == len(want)
