"""Queries on small tables that cuts would get wrong."""


from tracewell import plans


def write(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_merge_counts_exact_copies(spark, tmp_path):
    a, b, c = "red green blue cyan pink", "red green blue cyan gold", "one two three four five"
    texts = [a, c, b, a + " red", b, "alone here", c, "", "", c]
    path = write(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id long, text string")
    assert {(r.rep, r.n) for r in plans.QUERIES["near_duplicate_merge"](spark, path).collect()} == {(0, 4), (1, 3)}
    members = {(r.doc_id, r.representative) for r in plans.QUERIES["near_duplicate_members"](spark, path).collect()}
    assert members == {(0, 0), (1, 1), (2, 2), (3, 0), (4, 2), (5, 5), (6, 1), (9, 1)}


def test_ann_recall_on_the_query_s_own_table(spark):
    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        hits = lambda name: {(r.query_id, r.vec_id) for r in plans.QUERIES[name](spark, sf).collect()}  # noqa: B023, E731
        exact = hits("vector_topk")
        assert len(exact & hits("vector_ann")) >= 0.9 * len(exact)


def test_lineage_compares_whole_messages(spark, tmp_path):
    same = "the same opening of a turn, "
    rows = [(0, 0, same + "a"), (0, 1, same + "b"), (1, 0, same + "a"), (3, 0, same + "a"), (3, 1, "x"), (4, 0, same + "other")]
    path = write(spark, tmp_path, "conversations", rows, "conv_id long, turn long, text string")
    got = {r.id: r.state for r in plans.QUERIES["lineage_promotion"](spark, path).collect()}
    assert got == {0: "adopted", 1: "covered_copy", 3: "diverged", 4: "diverged"}


def test_false_hits_compare_whole_prompts(spark, tmp_path):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    same = "the same first sixty letters and blanks of a prompt, and then "
    texts = [(same, same + "x" * 900), (same + "a" * 90, same + "ä1" * 45), ("é" * 80 + "1", "é" * 80 + "2"), ("12345", "12346"), ("y" * 2049, "y" * 2049), ("y" * 2048, "y" * 2048)]
    rows = [(i, k, "user", x) for i, pair in enumerate(texts) for k, x in enumerate(pair)]
    path = write(spark, tmp_path, "conversations", rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.likeness for r in plans.QUERIES["false_hit_whole"](spark, path).collect()}
    want = {i: round(0.0 if max(map(len, p)) > 2048 else 1 - edits(*p) / max(map(len, p)), 6) for i, p in enumerate(texts)}
    assert got == {i: x for i, x in want.items() if x >= 0.2} and 0 not in got and 4 not in got


def test_clusters_of_a_long_chain_and_random_likes(spark, monkeypatch):
    """Rows whose likes are out already don't wait for the chain; before, likes were searched anew in each round."""
    import random

    from pyspark.sql import functions as F

    from tracewell.operators import cards

    rng = random.Random(4)
    pairs = {(i, i + 1) for i in range(6)} | {tuple(sorted(rng.sample(range(10, 50), 2))) for _ in range(90)}
    want = {}
    for i in range(52):
        want[i] = next((r for r in range(i) if want[r] == r and (r, i) in pairs), i)
    made = spark.sparkContext.accumulator(0)

    def seen(a):
        made.add(1)
        return a

    df = spark.createDataFrame(sorted(pairs), "a long, b long")
    got = cards.clusters(df.withColumn("a", F.udf(seen, "long")("a")), spark.range(52).coalesce(1))
    assert {r.id: r.rep for r in got.collect()} == want and made.value == len(pairs)
