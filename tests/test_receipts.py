import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from tracewell.operators import receipts as R
from tracewell.sources import tail
from tracewell.streaming.receipts import Ledger


def line(i, model="acme/m", total=10, **more):
    return json.dumps({"ts": "2024-01-02T00:00:00Z", "model": model, "source": "cli", "prompt": i, "completion": 1, "total": total, **more}) + "\n"


def write(path, text, mode="w"):
    with open(path, mode) as f:
        f.write(text)
    os.utime(path, (write.clock, write.clock))
    write.clock += 10


write.clock = 1_700_000_000


def plainly(folder):
    """Records of the files as they are, by a plain walk."""
    out = set()
    for name in os.listdir(folder):
        at = 0
        for raw in open(folder / name, "rb").read().splitlines(keepends=True):
            text = raw.decode().strip()
            if text:
                try:
                    j = json.loads(text)
                    counts = (j.get("prompt", 0), j.get("total", 0), j.get("requests", 0) or int(j.get("total", 0) > 0), False)
                except ValueError:
                    counts = (None, None, None, True)
                out.add((name, at, len(raw), hashlib.sha256(text.encode()).hexdigest(), *counts))
            at += len(raw)
    return out


def held(ledger):
    rows = ledger.records().collect()
    out = {(os.path.basename(r.path), r.offset, r.length, r.line_hash, r.prompt, r.total, r.requests, r.corrupt) for r in rows}
    assert len(rows) == len(out)
    return out


def run(ledger, logs, checkpoint):
    q = ledger.follow(str(logs), str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_stream_follows_growth_truncation_and_rewrites(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    write(logs / "2024-01-01.jsonl", line(1) + "\n" + "not json\n" + line(2, "plain", 0))
    write(logs / "2024-01-02.jsonl", line(3))
    write(logs / "notes.txt", "no log\n")
    os.remove(logs / "notes.txt")
    run(ledger, logs, tmp_path / "c")
    assert held(ledger) == plainly(logs)
    write(logs / "2024-01-02.jsonl", line(4) + line(5), "a")  # grew
    run(ledger, logs, tmp_path / "c")
    assert held(ledger) == plainly(logs)
    write(logs / "2024-01-02.jsonl", line(6)[:-9], "a")  # a line without an end waits
    before = held(ledger)
    run(ledger, logs, tmp_path / "c")
    assert held(ledger) == before
    write(logs / "2024-01-02.jsonl", line(6)[-9:] + line(7), "a")
    run(ledger, logs, tmp_path / "c")
    assert held(ledger) == plainly(logs)
    write(logs / "2024-01-01.jsonl", line(1))  # truncated
    write(logs / "2024-01-02.jsonl", "".join(line(90 + i) for i in range(9)))  # rewritten, and longer
    run(ledger, logs, tmp_path / "c")
    assert held(ledger) == plainly(logs)
    write(logs / "2024-01-01.jsonl", "")  # no line left
    run(ledger, logs, tmp_path / "c")
    assert held(ledger) == plainly(logs)
    rows = {(r.day, r.model, r.provider): (r.prompt, r.requests) for r in ledger.rollup().collect()}
    assert rows == {("2024-01-02", "acme/m", "acme"): (sum(range(90, 99)), 9)}
    ledger.compact(1000)
    assert held(ledger) == plainly(logs)


def test_batches_that_run_again_change_nothing(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    write(logs / "a.jsonl", "".join(line(i) for i in range(5)))
    write(logs / "b.jsonl", "".join(line(i) for i in range(7)))
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    lines = ledger._lines([str(logs)]).cache()
    some = lines.filter("offset < 200")
    ledger.apply(some, 0)
    ledger.apply(lines, 1)  # overlaps what is known
    first = held(ledger)
    assert first == plainly(logs)
    for batch, rows in ((1, lines), (0, some), (1, lines), (2, lines), (2, lines.limit(0))):
        ledger.apply(rows, batch)
        assert held(ledger) == first
    # A batch of which only the records were written doesn't count.
    ledger._write(ledger.records().withColumns({"offset": F.col("offset") + 100_000}), "records", 7)
    assert held(ledger) == first
    # Another text at a known place: the file is read again.
    write(logs / "a.jsonl", "".join(line(50 + i) for i in range(3)))
    changed = ledger._lines([str(logs / "a.jsonl")]).filter("offset = 0")
    ledger.apply(changed, 8)
    assert held(ledger) == plainly(logs)
    write(logs / "b.jsonl", line(5))
    ledger.reconcile([str(logs / "b.jsonl"), str(logs / "gone.jsonl")], 9)
    assert held(ledger) == plainly(logs)


@pytest.mark.parametrize("size", [1, 7, 40, 1000])
def test_ranges_give_each_line_once(tmp_path, size):
    path = tmp_path / "x.jsonl"
    path.write_bytes(b"one\n\n\r\ntwo and more\n" + "ßé\n".encode() + b"last")
    (file,) = tail.listed([str(path)], ".jsonl")
    got = [(r[1], r[5]) for p in tail.ranges(file, 0, file.size, False, True, size) for r in tail.lines(p)]
    assert got == [(0, "one"), (4, ""), (5, ""), (7, "two and more"), (20, "ßé"), (25, "last")]
    stream = [(r[1], r[4], r[5]) for p in tail.ranges(file, 0, 25, True, False, size) for r in tail.lines(p)]
    assert stream == [(0, True, None), *[(a, False, v) for a, v in got[:-1]]]


def test_batch_and_stream_read_the_same_lines(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    spark.dataSource.register(tail.TailedLines)
    for i, name in enumerate("cab"):
        write(logs / f"{name}.jsonl", f"{i}\n{i} again\n")
    stream = spark.readStream.format("tailed_lines").option("path", str(logs)).load()
    got = []

    def keep(df, batch):
        got.extend(df.collect())

    def once():
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)

    once()
    batch = spark.read.format("tailed_lines").option("path", str(logs)).load().collect()
    assert sorted((r.path, r.offset, r.value) for r in got if not r.fresh) == sorted((r.path, r.offset, r.value) for r in batch)
    assert [os.path.basename(r.path) for r in batch if r.offset == 0] == ["c.jsonl", "a.jsonl", "b.jsonl"]  # by time of change
    n = len(got)
    once()  # a restart repeats none
    assert len(got) == n
    write(logs / "a.jsonl", "new\n", "a")
    once()
    assert [(r.value, r.offset) for r in got[n:]] == [("new", 10)]


def test_settle(spark):
    records = spark.createDataFrame([("a", 0, 5, "h0"), ("a", 5, 5, "h1"), ("b", 0, 5, "x")], "path string, offset long, length int, line_hash string")
    receipts = spark.createDataFrame([("a", 5, 5, "h1"), ("a", 10, 5, "h2"), ("a", 10, 5, "h2"), ("b", 0, 5, "y"), ("b", 5, 5, "z"), ("c", 0, 3, "p"), ("c", 0, 3, "q"), ("d", 0, 4, "n")], records.schema)
    files = spark.createDataFrame([("a", 10), ("b", 5)], "path string, indexed long")
    fresh, again = R.settle(receipts, records, files)
    assert sorted(tuple(r) for r in fresh.select("path", "offset", "line_hash").collect()) == [("a", 10, "h2"), ("d", 0, "n")]
    assert sorted(r.path for r in again.collect()) == ["b", "c"]
