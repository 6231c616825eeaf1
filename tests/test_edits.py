import pytest
from pyspark.sql import functions as F

from tracewell import plans
from tracewell.operators import edits as E
from tracewell.plans import edits as edit_plans


def test_receipts(spark):
    rows = [("edited a b.py \nmore", ["a b.py"]), ("x\n wrote 12 bytes to /q/r.md\r", ["/q/r.md"]), ("one\ntwo\nthree\nedited d\nedited e", ["d\nedited e"]), ("wrote 3 files", []), ("EDITED x", []), ("", []), (None, [])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    got = {r.i: r.p for r in df.select("i", E.receipt_paths(F.col("t")).alias("p")).collect()}
    assert got == {i: p for i, (_, p) in enumerate(rows)}


def test_targets(spark):
    rows = {"cd /a/b": "/a/b", " cd /a/b// && ls": "/a/b", "cd x;y": "x", "cd": None, "cd /": None, "cdx /a": None, "ls": None, "cd a\tb": "a", None: None}
    df = spark.createDataFrame([(c,) for c in rows], "c string")
    assert {r.c: r.t for r in df.select("c", E.cd_target(F.col("c")).alias("t")).collect()} == rows


def test_longest_root_goes(spark):
    roots = spark.createDataFrame([("s", "/r"), ("s", "/r/src"), ("s", "C:/Work"), ("t", "/other"), ("s", "rel")], "session string, root string")
    paths = [("s", "/r/src/a.py", "a.py"), ("s", "/r/srcs/a.py", "srcs/a.py"), ("s", "/R/a", "/R/a"), ("s", r"c:\work\x\y", "x/y"), ("s", "/r", "/r"), ("s", "a.py", "a.py"), ("t", "/r/a", "/r/a"), ("s", "rel/z", "z"), ("s", "/r/a", "a"), ("s", "/r/a", "a"), ("s", None, None), ("s", "", "")]
    got = E.stripped(spark.createDataFrame([p[:2] for p in paths], "session string, path string"), roots).collect()
    assert sorted((r.session, str(r.path), str(r.file)) for r in got) == sorted((s, str(p), str(f)) for s, p, f in paths)


def test_directories_are_carried_on(spark):
    calls = [("s", 1, "ls"), ("s", 2, "cd /a/b/"), ("s", 3, None), ("s", 4, "cd ../c"), ("s", 5, "make"), ("s", 6, "cd d && x"), ("s", 7, "cd /z"), ("s", 8, "cd ../.."), ("s", 9, "ls"), ("t", 1, "cd x"), ("t", 2, "cd y"), ("t", 3, "ls")]
    got = {(r.session, r.seq): r.cwd for r in E.current_directory(spark.createDataFrame(calls, "session string, seq int, command string")).collect()}
    assert got == {("s", 1): None, ("s", 2): None, ("s", 3): "/a/b", ("s", 4): "/a/b", ("s", 5): "/a/c", ("s", 6): "/a/c", ("s", 7): "/a/c/d", ("s", 8): "/z", ("s", 9): "/", ("t", 1): None, ("t", 2): "x", ("t", 3): "x/y"}
    one = spark.createDataFrame([("/a", "b"), (None, "b"), ("/a", "/c"), ("/a/b", "../c"), ("/a", r"d\e")], "cwd string, p string")
    assert [r[0] for r in one.select(E.resolved(F.col("p"), F.col("cwd"))).collect()] == ["/a/b", "b", "/c", "/a/c", "/a/d/e"]


def test_directories_back_at_the_start_are_not_the_root(spark):
    calls = [(1, "cd lib"), (2, "cd .."), (3, "cd lib"), (4, "cd ../.."), (5, "cd x"), (6, "ls")]
    got = {r.seq: r.cwd for r in E.current_directory(spark.createDataFrame([("s", *c) for c in calls], "session string, seq int, command string")).collect()}
    assert got == {1: None, 2: "lib", 3: "", 4: "lib", 5: "..", 6: "../x"}


@pytest.mark.parametrize("name", ["edit_directories", "edit_receipts"])
def test_every_line_of_a_result_is_looked_at(spark, monkeypatch, name):
    """Before, lines from the fourth on were taken as one."""
    calls = [("s", 1, "cd /w", None), ("s", 2, None, "one\ntwo\nthree\nedited d\n\nedited e \nx\nwrote 3 bytes to /w/f"), ("s", 3, None, "edited a"), ("s", 4, None, None)]
    monkeypatch.setattr(edit_plans, "_calls", lambda t: spark.createDataFrame(calls, "session string, seq int, command string, result string"))
    got = sorted((r.seq, r.path) for r in plans.QUERIES[name](spark, "none").collect())
    below = "/w/" if name == "edit_directories" else ""
    assert got == sorted([(2, f"{below}d"), (2, f"{below}e"), (2, "/w/f"), (3, f"{below}a")])
