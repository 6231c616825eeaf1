import random

from tracewell.llm import near_copies as c

SCHEMA = "doc_id long, text string, source string"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def by_hand(docs):
    """The least id of each group that Jaccard 0.8 joins, over all pairs."""
    sets = [(i, shingles(t)) for i, t in sorted(docs)]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted({find(i) for i in root})


def run(spark, docs):
    return sorted(r.doc_id for r in c.near_dedup(spark.createDataFrame([(i, t, "s") for i, t in docs], SCHEMA)).collect())


def test_links_are_those_of_brute_force_jaccard(spark):
    rng = random.Random(5)
    docs = []
    for _ in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 300))]
        for _ in range(5):
            w = list(base)
            for k in rng.sample(range(len(w)), rng.randint(0, max(1, len(w) // 25))):
                w[k] = "changed"
            docs.append((len(docs), " ".join(w)))
    want = by_hand(docs)
    assert len(want) < 150 and run(spark, docs) == want


def test_near_copies_beyond_the_fingerprints_radius_go(spark):
    from tracewell.llm import simhash

    words = [f"w{i}" for i in range(200)]
    docs = [(1, " ".join(words))]
    for at in (20, 60, 100, 140):
        docs.append((at, " ".join([*words[:at], "other", *words[at + 1 : at + 50], "word", *words[at + 51 :]])))
    far = [int.bit_count(simhash.fingerprint(docs[0][1].encode()) ^ simhash.fingerprint(t.encode())) for _, t in docs[1:]]
    assert any(d > simhash.RADIUS for d in far) and run(spark, docs) == [1]


def test_the_stage_uses_them(spark, sf):
    import corpus_pipeline

    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join([*words[: 8 * i], *([f"x{i}"] if i else []), *words[8 * i + 1 if i else 0 :]]), "en", "s", 1) for i in range(6)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.copies_stage(spark, frame, sf).collect()) == by_hand([d[:2] for d in docs])


def test_on_the_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, docs) == by_hand(docs)


def test_odd_rows(spark):
    rows = [(1, "a b"), (2, "A  b"), (3, None), (4, ""), (5, " \t"), (6, "a b c"), (6, "a b c")]
    assert run(spark, rows) == [1, 3, 6] and run(spark, []) == []


def test_trees_over_fingerprints_find_links_of_their_own(spark, monkeypatch):
    from pyspark.sql import functions as F

    words = [f"w{i}" for i in range(400)]
    docs = [(0, " ".join(words)), (1, " ".join([*words, "end"])), (2, " ".join([*(f"s{i}" for i in range(8)), *words])), (3, " ".join(words[:200])), (4, "a b c d e"), (5, "f g h i j")]
    fps = [c.fingerprint(c.shingles(t.encode())) for _, t in docs]
    far = [int.bit_count((fps[0] ^ x) % 2**64) for x in fps[1:3]]
    assert 0 < max(far) <= 4
    assert c.alike(*(c.shingles(docs[i][1].encode()) for i in (0, 1))) and not c.alike(*(c.shingles(docs[i][1].encode()) for i in (0, 3)))
    # No band is drawn: what is left is what SimHash and the check on whole sets link.
    monkeypatch.setattr(c, "_shards", lambda sets: c.stored(sets.select(F.col("set_id").alias("shard"), "set_id").limit(0)))
    assert run(spark, docs) == [0, 3, 4, 5]
