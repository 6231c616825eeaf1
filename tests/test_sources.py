import json

import pytest
from pyspark.sql import functions as F

from tracewell.sources import readers, sinks


def write(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    return str(path)


def test_transcripts_skip_what_is_malformed(spark, tmp_path):
    lines = [{"role": "user", "content": "hi"}, "", "{bad", {"content": "no role"}, {"type": "tool", "content": "out", "tool_call_id": "a"}, {"role": "assistant", "tool_calls": [{"id": "a", "name": "ls", "arguments": "{}"}]}]
    path = write(tmp_path / "s1.jsonl", lines)
    rows = readers.transcripts(spark, path).orderBy("line_no").collect()
    assert [r.role for r in rows] == ["user", "tool", "assistant"] and {r.session for r in rows} == {"s1"}
    assert rows[2].tool_calls[0].name == "ls"


def test_double_encoded_arguments(spark):
    df = spark.createDataFrame([('{"path": "a"}',), (json.dumps('{"path": "b"}'),), ("nope",)], "a string")
    assert [r.p for r in df.select(readers.arguments(F.col("a"), "path string")["path"].alias("p")).collect()] == ["a", "b", None]


def test_usage_log_defaults(spark, tmp_path):
    rows = readers.usage_log(spark, write(tmp_path / "u.jsonl", [{"session_id": "a", "tokens_in": 5}, "xx"])).collect()
    assert [(r.session_id, r.tokens_in, r.tokens_out, r.l3_reuse) for r in rows] == [("a", 5, 0, False)]


def test_daily_records(spark, tmp_path):
    for day in ("2024-01-01", "2024-01-02", "2024-01-03"):
        write(tmp_path / f"{day}.jsonl", [{"model": "p/m", "total": 3}])
    got = readers.daily_records(spark, str(tmp_path), "2024-01-02").collect()
    assert sorted(r.day for r in got) == ["2024-01-02", "2024-01-03"]


def test_export_and_import(spark, tmp_path):
    schema = readers.SLICE
    rows = [("id1", 3, 1, "é text", None, None, 0.5, {"origin": "user-curated", "result_status": "verified"}, 7), ("id2", 0, 0, "b", None, None, 0.0, {}, 1)]
    sinks.export_slices(spark.createDataFrame(rows, schema), str(tmp_path / "x"))
    back = readers.slice_export(spark, str(tmp_path / "x"))
    assert {r.ID: r.Content for r in back.collect()} == {"id1": "é text", "id2": "b"}
    got = {r.ID: r.Meta for r in readers.imported(back.unionByName(back)).collect()}
    assert got["id1"].origin == "import" and got["id1"].result_status == "probation" and len(got) == 2


def test_tsv(spark, tmp_path):
    good = write(tmp_path / "a.tsv", ["# c", "x\ty", "", "p\tq"])
    assert [tuple(r) for r in readers.tsv(spark, good, ["class", "query"]).collect()] == [("x", "y"), ("p", "q")]
    with pytest.raises(Exception, match="malformed"):
        readers.tsv(spark, write(tmp_path / "b.tsv", ["x\ty\tz"]), ["class", "query"]).collect()


def test_journal_traces_and_sse(spark, tmp_path):
    j = readers.journal(spark, write(tmp_path / "j", [{"j": 1, "bsize": 3}, {"op": "put", "s": {"ID": "a"}}, {"op": "del", "id": "a"}])).collect()
    assert [(r.op, r.id) for r in j] == [("put", "a"), ("del", "a")]
    t = readers.traces(spark, write(tmp_path / "t", [{"session": "s", "steps": [{"role": "assistant", "content": "c", "tools": [{"id": "1", "name": "n", "result": "r"}]}]}])).orderBy("step", "k").collect()
    assert [(r.role, r.content) for r in t] == [("assistant", "c"), ("tool", "r")]
    (s,) = readers.sse(spark, write(tmp_path / "e.sse", ['data: {"choices":[{"delta":{"content":"a"}}]}', "", 'data: {"content":"b"}', "data: [DONE]"])).collect()
    assert (s.content, s.done) == ("ab", True)


def test_rollup_days_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "r")
    sinks.write_rollup(spark.createDataFrame([("a", 1), ("b", 2)], "day string, n int"), path)
    sinks.write_rollup(spark.createDataFrame([("b", 5)], "day string, n int"), path)
    assert sorted((r.day, r.n) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 5)]
    rows = spark.createDataFrame([(1,), (2,)], "id int")
    sinks.archive_then_keep(rows, spark.createDataFrame([(2,)], "id int"), str(tmp_path / "arc"), str(tmp_path / "kept"))
    assert spark.read.json(str(tmp_path / "arc")).count() == 1 and spark.read.parquet(str(tmp_path / "kept")).count() == 1
    sinks.audit(rows, "evict", str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).filter("action = 'evict'").count() == 2


def test_skipped_lines_are_counted(spark, tmp_path):
    lines = ['{"ID": "a", "Type": 0}', "", "  ", "not json", '{"Type": 1}', '{"ID": "", "Type": 1}', '{"ID": "b"}', '{"ID": "c", "Content": "' + "x" * readers.LOG_LINE + '"}']
    (tmp_path / "export.jsonl").write_text("\n".join(lines))
    path = str(tmp_path / "export.jsonl")
    assert readers.export_counts(spark, path).first().asDict() == {"taken": 2, "oversized": 1, "malformed": 1, "nameless": 2}
    assert sorted(r.ID for r in readers.slice_export(spark, path).select("ID").collect()) == ["a", "b"]
