import math

import numpy as np
import pytest

from tracewell.llm import ordinal as o


def corpus(n=600, seed=1):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(n):
        grade = int(rng.choice([0, 1, 2], p=[0.15, 0.2, 0.65]))
        body = list(rng.choice(words, 60))
        if grade < 2:
            body[rng.integers(60)] = "awful"
        if grade == 0:
            body = [f"{w}&&&" for w in body]
        rows.append((" ".join(body), grade))
    return rows


def test_grades_on_held_out_rows():
    rows = corpus()
    slots = [np.array(o.features(t)) for t, _ in rows]
    grades = np.array([g for _, g in rows])
    model = o.fit(slots[:450], grades[:450], 3)
    assert model.thresholds[0] < model.thresholds[1]
    score = np.array([model.weights[s].sum() for s in slots[450:]])
    top = 1 - 1 / (1 + np.exp(-(model.thresholds[1] - score)))
    assert (((top >= 0.5) == (grades[450:] == 2)).mean()) > 0.95
    means = [score[grades[450:] == g].mean() for g in range(3)]
    assert means[0] < means[1] < means[2]


def test_slopes_are_those_of_a_plain_likelihood():
    rng = np.random.default_rng(8)
    slots = [np.unique(rng.integers(0, 9, 4)) for _ in range(40)]
    grades = rng.integers(0, 4, 40)
    rated = o.Rated(np.repeat(np.arange(40), list(map(len, slots))), np.concatenate(slots), grades, 4)

    def plain(w, free):
        cuts = [free[0]]
        for f in free[1:]:
            cuts.append(cuts[-1] + math.exp(f))
        total = 0.0
        for s, g in zip(slots, grades):
            score = sum(w[i] for i in s)
            below = [0.0, *(1 / (1 + math.exp(score - c)) for c in cuts), 1.0]
            total -= math.log(below[g + 1] - below[g])
        return total / 40 + o.DECAY * sum(x * x for x in w) / 80

    w, free, d = rng.normal(0, 1, 9), rng.normal(0, 0.5, 3), 1e-6
    loss, by_w, by_free = o.slope(rated, w, free)
    assert loss == pytest.approx(plain(w, free))
    for i in range(9):
        e = np.eye(9)[i] * d
        assert by_w[i] == pytest.approx((plain(w + e, free) - plain(w - e, free)) / (2 * d), abs=1e-6)
    for i in range(3):
        e = np.eye(3)[i] * d
        assert by_free[i] == pytest.approx((plain(w, free + e) - plain(w, free - e)) / (2 * d), abs=1e-6)


def test_fit_ends_where_the_slope_is_flat():
    rows = corpus(200)
    slots, grades = [np.array(o.features(t)) for t, _ in rows], np.array([g for _, g in rows])
    model = o.fit(slots, grades, 3)
    used, count = np.unique(np.concatenate(slots), return_counts=True)
    used = used[count >= o.LEAST_ROWS]
    kept = [np.searchsorted(used, s[np.isin(s, used)]) for s in slots]
    rated = o.Rated(np.repeat(np.arange(200), list(map(len, kept))), np.concatenate(kept), grades, 3)
    at = o.slope(rated, model.weights[used], np.array([model.thresholds[0], math.log(model.thresholds[1] - model.thresholds[0])]))
    start = o.slope(rated, np.zeros(len(used)), np.array([-1.0, 0.0]))
    assert at[0] < start[0] and np.abs(at[1]).max() < 0.05 * np.abs(start[1]).max()


@pytest.mark.parametrize("grade", [-1, 3, None])
def test_odd_grades_are_refused(spark, grade):
    rows = spark.createDataFrame([([1, 2], 0), ([3], grade)], "slots array<int>, grade int")
    with pytest.raises(ValueError, match="grade"):
        o.train(rows, 3)
    with pytest.raises(ValueError, match="sample"):
        o.train(rows, 3, sample=1)


def test_fit_does_not_depend_on_chance():
    rows = corpus(120)
    slots, grades = [np.array(o.features(t)) for t, _ in rows], np.array([g for _, g in rows])
    a, b = o.fit(slots, grades, 3), o.fit(slots, grades, 3)
    assert (a.weights == b.weights).all() and (a.thresholds == b.thresholds).all()


def test_tables(spark):
    rows = [(i, t) for i, (t, _) in enumerate(corpus(300))] + [(900, None), (901, ""), (None, "w1"), (5, "w1 w2"), (902, "w " * 50_000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(i, int(g == 2), int(g == 0)) for i, (_, g) in enumerate(corpus(300))] + [(None, 1, 0), (7, None, 0), (8, 1, 1)], "doc_id long, quality int, toxic int")
    rated = o.rated(docs, labels, 250)
    model = o.train(rated, 3, sample=250)
    got = o.score(docs, model, "doc_id").collect()
    assert len(got) == len(rows)
    assert all(0 <= r.p_top <= 1 and 0 <= r.expected_grade <= 2 and r.kept == (r.p_top >= o.KEEP) for r in got)
    again = o.train(o.rated(docs.repartition(7), labels, 250), 3, sample=250)
    assert (again.weights == model.weights).all()
    assert o.score(docs.limit(0), model, "doc_id").count() == 0
    assert o.train(rated.limit(0), 3).weights.shape == (o.WIDTH,)


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = o.train(o.rated(docs, labels.filter("doc_id % 4 <> 0")), 3)
    held = o.score(docs.join(labels.filter("doc_id % 4 = 0"), "doc_id"), model, "quality", "toxic").toPandas()
    clean, junk = held[(held.quality == 1) & (held.toxic == 0)], held[held.quality == 0]
    assert clean.kept.mean() > 0.99 and (~junk.kept).mean() > 0.85
