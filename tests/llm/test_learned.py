"""Hard negatives, the rule ensemble and centroid clustering against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog_engine.llm import centroids, negatives, rule_ensemble
from catalog_engine.llm.common import held_out
from tests.llm.conftest import LONG

SF = "/root/testdata/sf0.01"


@pytest.fixture
def vectors(spark):
    def make(rows, **extra):
        names = "".join(f", `{n}` string" for n in extra)
        return spark.createDataFrame(
            [(*r, *extra.values()) for r in rows], "vec_id bigint, embedding array<float>, label int" + names
        )

    return make


def drawn(n, size=64, seed=5, spread=1.0):
    draw = np.random.default_rng(seed)
    return draw.normal(scale=spread, size=(n, size)).astype(np.float32)


ODD = [
    (9001, None, 1),
    (9002, [], 1),
    (9003, [None] * 64, 1),
    (9004, [math.nan] * 64, 2),
    (9005, [math.inf] + [0.0] * 63, 2),
    (9006, [0.5] * 63, 3),
]


# Hard negatives


def test_strassen_equals_plain_products():
    draw = np.random.default_rng(1)
    for n, k, m in [(1, 1, 1), (7, 64, 9), (65, 64, 130), (100, 33, 67), (5, 0, 4), (129, 70, 1)]:
        a, b = draw.integers(-(1 << 28), 1 << 28, (n, k)), draw.integers(-(1 << 28), 1 << 28, (k, m))
        assert (negatives.strassen(a, b, leaf=4) == a @ b).all()
        assert (negatives.strassen(a, b) == a @ b).all()


def test_heaps_merge_as_a_sort():
    draw = np.random.default_rng(2)
    scores, ids = draw.integers(-3, 3, (20, 90)), draw.permutation(90)
    scores[draw.random(scores.shape) < 0.3] = negatives._NONE
    one, two = negatives.Heaps.empty(20, 4), negatives.Heaps.empty(20, 4)
    for at in range(0, 45, 15):
        one = one.offer(scores[:, at : at + 15], ids[at : at + 15])
        two = two.offer(scores[:, 45 + at : 60 + at], ids[45 + at : 60 + at])
    both = one.merge(two.scores, two.ids)
    for i in range(20):
        want = sorted((-s, k) for s, k in zip(scores[i].tolist(), ids.tolist()) if s != negatives._NONE)[:4]
        got = [(-s, k) for s, k in zip(both.scores[i].tolist(), both.ids[i].tolist()) if s != negatives._NONE]
        assert got == want


def mined(rows, anchor):
    """Brute force over (id, vector, label)."""
    whole = [(i, [math.floor(256 * float(x)) for x in v], k) for i, v, k in rows]
    out = []
    for i, v, k in whole:
        if not anchor(i):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, m) for j, w, m in whole if j != i and len(w) == len(v)]
        scored.sort()
        for p, j, m in [s for s in scored if s[2] == k][:5]:
            near = [s for s in scored if s[2] != k and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(i, j, n + 1, t, -p, -s) for n, (s, t, _) in enumerate(near)]
    return sorted(out)


def test_hard_negatives_against_brute_force(vectors, monkeypatch):
    monkeypatch.setattr(negatives, "TILE", 16)
    monkeypatch.setattr(negatives, "STRIP", 7)
    draw = random.Random(3)
    base = drawn(150, seed=8, spread=0.2)
    rows = []
    # A hot label, rare labels, many equal vectors.
    for i in range(150):
        vector = base[draw.choice([0, 1, i])] if i % 3 else base[i]
        rows.append((i, [float(x) for x in vector], draw.choice([0, 0, 0, 1, 2, 1000 + i % 5])))
    rows += [(200 + i, [float(x) for x in v], i % 2) for i, v in enumerate(drawn(20, 3, seed=4))]
    twice = rows + rows[:30] + ODD[:1] + ODD[2:5] + [(9100, rows[0][1], None), (None, rows[0][1], 0)]
    frame = vectors(twice, score="mine", rank="mine", bucket="mine", parts="mine")
    made = negatives.mine(negatives.quantised(frame), F.col("vec_id") % 4 == 0)
    assert sorted(tuple(r) for r in made.collect()) == mined(rows, lambda i: i % 4 == 0)


def test_hard_negatives_of_few_rows(vectors):
    def run(rows):
        return negatives.mine(negatives.quantised(vectors(rows)), F.col("vec_id") % 50 == 0).collect()

    assert run([]) == [] and run([(50, [1.0] * 4, 1)]) == [] and run(ODD) == []
    assert run([(50, [1.0], 1), (51, [1.0], 1)]) == []
    # Scores of 0 and of empty vectors: 50 p <= 100 n <= 95 p holds for 0.
    got = run([(50, [], 1), (51, [], 1), (52, [], 2), (53, [0.0], 2)])
    assert [tuple(r) for r in got] == [(50, 51, 1, 52, 0, 0)]
    with pytest.raises(Exception, match="64 bits"):
        run([(50, [1e6] * 64, 1)])


# Centroids


def clustered(rows, k=8, rounds=10):
    points = np.array([[math.floor(1024 * float(x)) for x in v] for _, v in rows], np.int64).reshape(len(rows), -1)
    order = sorted(
        (hashlib.sha256(f"3:{i}".encode()).hexdigest(), tuple(v), n) for n, (i, v) in enumerate(rows) if i is not None
    )
    centres = points[[n for *_, n in order[:k]]]
    for turn in range(rounds + 1):
        far = ((points[:, None] - centres[None]) ** 2).sum(2)
        near = far.argmin(1)
        if turn < rounds:
            centres = np.array(
                [points[near == c].sum(0) // (near == c).sum() if (near == c).any() else centres[c] for c in range(len(centres))]
            )
    least = far.min(1)
    return sorted(
        (
            str(rows[n][0]),
            int(near[n]),
            int(least[n]),
            int(least[near == near[n]].sum()),
            int(least.sum()),
            hashlib.sha256(",".join(map(str, centres[near[n]].tolist())).encode()).hexdigest(),
        )
        for n in range(len(rows))
    )


def test_centroids_against_brute_force(vectors, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK", 32)
    draw = np.random.default_rng(9)
    middles = drawn(6, seed=2)
    found = (middles[draw.integers(0, 6, 400)] + drawn(400, seed=3, spread=0.3)).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(found)]
    rows += rows[:40] + [rows[7]] * 60 + [(None, rows[3][1])]  # repeated rows, a row without an id
    frame = vectors([(*r, 1) for r in rows] + ODD, cluster="mine", distance="mine", block="mine", n="mine")
    scanned = []
    got = centroids.cluster(frame, progress=scanned)
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == clustered(rows)
    # Groups apart from each other: bounds settle most vectors once the centroids move little.
    assert scanned[0] == len(rows) and sum(scanned[5:]) < 3 * len(rows)


def test_centroids_of_few_rows(vectors):
    assert centroids.cluster(vectors([])).collect() == []
    assert centroids.cluster(vectors(ODD)).collect() == []
    few = [(i, [float(x) for x in v]) for i, v in enumerate(drawn(3))]
    assert sorted((str(r[0]), *r[1:]) for r in centroids.cluster(vectors([(*r, 1) for r in few])).collect()) == clustered(few)
    one = few[:1] * 5  # equal vectors: one cluster takes all, the others stay empty
    assert sorted((str(r[0]), *r[1:]) for r in centroids.cluster(vectors([(*r, 1) for r in one])).collect()) == clustered(one)
    with pytest.raises(Exception, match="exact range"):
        centroids.cluster(vectors([(1, [1e9] * 64, 1)])).collect()


def test_loosening_bounds_every_point_and_is_below_the_drift():
    draw = np.random.default_rng(4)
    tighter = 0
    for _ in range(40):
        old, new = draw.normal(size=(4, 8)) * 10, draw.normal(size=(4, 8)) * 3
        new += old
        radii = draw.uniform(0.1, 12, 4)
        loose = centroids.loosening(old, new, radii)
        drift = np.linalg.norm(new - old, axis=1)
        assert (loose <= drift[None] + 1e-9).all()
        tighter += (loose < 0.9 * drift[None]).sum()
        for i in range(4):
            points = draw.normal(size=(300, 8))
            points = old[i] + radii[i] * points / np.linalg.norm(points, axis=1, keepdims=True)
            fallen = np.linalg.norm(points[:, None] - old, axis=2) - np.linalg.norm(points[:, None] - new, axis=2)
            assert (fallen <= loose[i] + 1e-9).all()
    assert tighter > 100


def test_exact_distances_of_large_components():
    draw = np.random.default_rng(6)
    for most in (1 << 10, 1 << 21, 1 << 26):
        a, b = draw.integers(-most, most, (30, 64)), draw.integers(-most, most, (5, 64))
        want = [[sum((x - y) ** 2 for x, y in zip(p, q)) for q in b.tolist()] for p in a.tolist()]
        assert centroids.squared(a, b).tolist() == want


# Rule ensemble


def test_rules_are_the_paths_of_a_tree():
    tree = """DecisionTreeClassificationModel: depth=2
  If (feature 0 <= 3.5)
   If (feature 2 <= 0.25)
    Predict: 0.0
   Else (feature 2 > 0.25)
    Predict: 1.0
  Else (feature 0 > 3.5)
   If (feature 0 <= 1.0E2)
    Predict: 1.0
   Else (feature 0 > 1.0E2)
    Predict: 0.0
"""
    got = [str(r) for r in rule_ensemble.rules_of(tree, ("a", "b", "c"))]
    assert got == [
        "a <= 3.5",
        "a <= 3.5 and c <= 0.25",
        "a <= 3.5 and c > 0.25",
        "a > 3.5",
        "a > 3.5 and a <= 100",
        "a > 100",
    ]


def test_statistics_of_a_text(docs):
    text = "One TWO two!\n## 12 a long-word.\n## 12 a long-word.\n"
    row = rule_ensemble.with_statistics(docs([(1, text)])).first()
    got = {n: row["__stat_" + n] for n in rule_ensemble.NAMES}
    n = len(text)
    assert got == pytest.approx(
        {
            "words": 11,
            "word_length": n / 11,
            "upper": 4 / n,
            "symbols": 4 / 11,
            "stops": 3 / 11,
            "bangs": 1 / 11,
            "digits": 4 / n,
            "line_words": 11 / 4,
            "repeated_lines": 1 / 4,
            # one, two, two!, ##, 12, a, long-word., and the blank behind the last line end
            "new_words": 8 / 11**0.5,
            "repeated_words": 3 / 11,
            "short_words": 8 / 11,
        }
    )


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = rule_ensemble.fit(docs, labels.where(~held_out("doc_id", 4, 2)))
    again = rule_ensemble.fit(docs.repartition(5), labels.where(~held_out("doc_id", 4, 2)).repartition(3))
    assert model == again and model.rules
    scored = rule_ensemble.score(docs, model)
    # Native: the rules are one Spark column.
    assert "Python" not in scored._jdf.queryExecution().toString()
    tested = scored.join(labels, "doc_id").where(held_out("doc_id", 4, 2) & F.col("quality").isNotNull()).collect()
    bad = [r for r in tested if r.quality == 0]
    assert bad and sum(r.predicted == 0 for r in bad) >= 0.9 * len(bad)
    good = [r for r in tested if r.quality == 1]
    assert sum(r.predicted for r in good) >= 0.97 * len(good)
    # By hand: the log-odds are those of the rules that hold.
    row = rule_ensemble.with_statistics(docs).orderBy("doc_id").first()
    held = [
        w
        for rule, w in model.rules
        if all(
            (low is None or row["__stat_" + n] > low) and (high is None or row["__stat_" + n] <= high)
            for n, low, high in rule.bounds
        )
    ]
    want = 1 / (1 + math.exp(-(model.base + sum(held))))
    assert scored.where(F.col("doc_id") == row.doc_id).first().score == pytest.approx(want)


def test_quality_of_awkward_rows(spark, docs, awkward):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = rule_ensemble.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    scored = rule_ensemble.score(awkward, model)
    assert scored.columns == [c for c in awkward.columns if c not in ("score", "predicted")] + ["score", "predicted"]
    rows = scored.collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1  # null as empty
    assert {r.text for r in rows if r.doc_id == 5} == {LONG}
    assert rule_ensemble.score(docs([]), model).count() == 0


def test_quality_without_two_kinds_of_labels(spark, docs):
    schema = "doc_id bigint, quality int"
    some = docs([(1, "a text"), (2, "another one")])

    def scores(labels):
        model = rule_ensemble.fit(some, spark.createDataFrame(labels, schema))
        return {r.score for r in rule_ensemble.score(some, model).collect()}

    assert scores([]) == {0.0} and scores([(1, None), (None, 1), (77, 1)]) == {0.0}
    assert scores([(1, 1), (2, 1), (2, 0)]) == {1.0}
    # Two examples are too few to grow a tree: the rate.
    assert scores([(1, 1), (2, 0)]) == {0.5}
