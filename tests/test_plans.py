import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.functions.termhash import Terms, shingle_hashes
from quillmill.plans.components import connected_components
from quillmill.plans.ordered import running_totals
from quillmill.plans.skew import salted_join
from quillmill.plans.spread import spread
from quillmill.plans.vectors import fold_counts, fold_vectors


@pytest.mark.parametrize("parts", [1, 7])
def test_running_totals(spark, parts):
    r = random.Random(3)
    rows = [(r.choice(["a", "a", "a", "b", None]), i, r.randint(0, 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o int, w long").withColumn("one", F.lit(1).cast("long")).repartition(5)
    got = {(x.k, x.o): (x.s, x.n) for x in running_totals(df, ["k"], ["o"], {"s": "w", "n": "one"}, parts).collect()}
    assert len(got) == 400
    for k in ("a", "b", None):
        s = n = 0
        for key, o, w in sorted((x for x in rows if x[0] == k), key=lambda x: x[1]):
            assert got[key, o] == (s, n)
            s, n = s + w, n + 1
    assert running_totals(df.limit(0), ["k"], ["o"], {"s": "w"}).count() == 0


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 150), r.randint(0, 150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 340)] + [(5, 5), (None, 1)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    want = {}
    for x in list(parent):
        want[x] = find(x)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_fold_vectors(spark):
    df = spark.range(1000).repartition(7)
    got = fold_vectors(df, 10, lambda b: np.bincount(b.column(0).to_numpy() % 10, minlength=10))
    assert got.tolist() == [100] * 10
    assert fold_vectors(df.limit(0), 4, lambda b: np.zeros(4)).tolist() == [0] * 4


def test_terms():
    a, b = Terms(["The Cat, the cat".lower(), "", "x_y ½ é1"]), Terms(["the"])
    assert a.count.tolist() == [4, 0, 4]
    assert a.hash[0] == a.hash[2] == b.hash[0] and a.hash[0] != a.hash[1]
    values, owner = shingle_hashes(Terms(["a b c d", "b c d", "a b"]), 3)
    assert owner.tolist() == [0, 0, 1] and values[1] == values[2]


def test_fold_counts(spark):
    got = fold_counts(spark.range(1000).repartition(7), 10, lambda b: b.column(0).to_numpy() % 10)
    assert got.tolist() == [100] * 10 and fold_counts(spark.range(0), 4, lambda b: b.column(0).to_numpy()).tolist() == [0] * 4


def test_salted_join(spark):
    """A key with most rows is spread over several parts and joins as any other; keys without a partner fall away."""
    rows = spark.createDataFrame([("hot" if i % 10 else f"k{i}", i) for i in range(2000)], "k string, v int")
    other = spark.createDataFrame([("hot", "h"), ("k0", "a"), ("k10", "b"), ("none", "n"), ("k10", "c")], "k string, w string")
    want = sorted(map(tuple, rows.join(other, "k").collect()))
    assert sorted(map(tuple, salted_join(rows, other, "k", "v", 2000, key_rows=100).collect())) == want
    assert sorted(map(tuple, salted_join(rows, other, "k", "v", 2000).collect())) == want
    assert sorted(map(tuple, salted_join(rows.where("v > 50"), other, "k", "v", 2000, counted=rows, key_rows=100).collect())) == [x for x in want if x[1] > 50]


def test_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    few, many = spark.range(100).coalesce(1), spark.range(100).repartition(cores + 3)
    assert spread(few).rdd.getNumPartitions() == cores and spread(few).count() == 100
    assert spread(many) is many
