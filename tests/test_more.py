"""Operators against hand-made or brute-force answers, and plans without a single-key shuffle."""

import bisect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import text as tx
from gridloom.operators import evaluate as ev
from gridloom.operators import graph as gr
from gridloom.operators import lookup, ml, retrieval, trading
from gridloom.sources import readers, writers

from .conftest import SF


@pytest.mark.parametrize("metric", ["cosine", "inner", "l2"])
def test_top_k_over_lanes_matches_brute_force(spark, metric):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8 if i % 5 else 6).astype(float).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = retrieval.top_k(df, df.where("vec_id % 7 = 0"), 4, metric, block=16).collect()
    for q, v in rows[::7]:
        a = np.array(v)
        score = {"cosine": lambda b: a @ b / np.linalg.norm(a) / np.linalg.norm(b), "inner": lambda b: a @ b, "l2": lambda b: -np.linalg.norm(a - b)}[metric]
        want = sorted((-score(np.array(w)), i) for i, w in rows if len(w) == len(v))[:4]
        assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query == q] == [i for _, i in want]


def test_top_k_has_no_single_key_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e = spark.read.parquet(f"{SF}/embeddings.parquet")
        plan = retrieval.top_k(e, e.where("vec_id % 50 = 0"), 3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin [qdim" in plan and "qlane" in plan.split("SortMergeJoin", 1)[1].split("\n", 1)[0]


def test_menu_in_order(spark):
    numbers = [3.0, -1.0, 10.0, 2.5, 1000.0, -500.25, 0.0, 3.0, None]
    got = lookup.menu(spark.createDataFrame([(x,) for x in numbers], "v double"), "v", numeric=True).orderBy("place").collect()
    assert [r.value for r in got] == ["-500.25", "-1", "0", "2.5", "3", "10", "1000"] and [r.place for r in got] == list(range(7))
    words = ["pear", "peach", "apple", "", "p", "pe", "Zebra", "pea", None]
    got = lookup.menu(spark.createDataFrame([(x,) for x in words], "v string"), "v").orderBy("place").collect()
    assert [r.value for r in got] == sorted({w for w in words if w is not None})


def test_tiered_match_finds_parts_anywhere(spark):
    rng = random.Random(4)
    words = ["795", "ACSR", "Drake", "Rail", "ACSS", "266.8", "Hawk", "xx", "a"]
    labels = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(2, 5)))) for i in range(200)]
    asked = [(i, rng.choice(words), rng.choice(words), rng.choice(words) + rng.choice(["", " Bundled"])) for i in range(120)]
    out = lookup.tiered_match(
        spark.createDataFrame(asked, "k long, size string, kind string, name string"), spark.createDataFrame(labels, "row long, label string"), "k", "size", "kind", "name", "label", "row"
    ).collect()
    for r in out:
        _, s, k, n = asked[r.k]
        full, plain = f"{s} {k} {n}".lower(), f"{s} {k} {n.replace(' Bundled', '')}".lower()

        def three(label, parts=(s.lower(), k.lower(), n.replace(" Bundled", "").lower())):
            at = 0
            for p in parts:
                at = label.find(p, at)
                if at < 0:
                    return False
                at += len(p)
            return True

        tests = (lambda x: x == full, lambda x: x == plain, three)
        hits = [(t + 1, i) for t, test in enumerate(tests) for i, x in labels if test(x.lower())]
        assert (r.tier, r.row) == min(hits, default=(None, None))


def test_pr_curve_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), round(rng.uniform(-3, 3), 3), rng.randint(0, 1)) for _ in range(800)] + [("c", 0.2, 0), ("c", 0.9, 0)]
    curve = ev.pr_curve(spark.createDataFrame(rows, "g string, s double, t int"), "t", "s", "g")
    for r in curve.collect():
        said = [t for g, s, t in rows if g == r.g and s >= r.score]
        p, recall = sum(said) / len(said), sum(said) / max(1, sum(t for g, _, t in rows if g == r.g))
        assert abs(r.precision - p) < 1e-12 and abs(r.recall - recall) < 1e-12
    best = {r.g: r.threshold for r in ev.best_threshold(curve, "g").collect()}
    assert best["c"] == 0.5 and set(best) == {"a", "b", "c"}


def test_propagation_of_several_columns(spark):
    nodes = spark.createDataFrame([(1, "a", 1.0, 5.0), (1, "b", 2.0, 0.0), (1, "c", 4.0, 1.0), (2, "a", 7.0, 7.0)], "scenario int, node string, x double, y double")
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "b", "a"), (1, "c", "c")], "scenario int, src string, dst string")
    got = {(r.scenario, r.node): (r.x, r.y) for r in gr.propagated(nodes, edges, ["x", "y"], 2).collect()}
    a = np.array([[1, 1, 0], [1, 1, 1], [0, 1, 1]])
    w = a / np.sqrt(np.outer(a.sum(0), a.sum(0)))
    for i, n in enumerate("abc"):
        assert np.allclose(got[1, n], [(w @ w @ [1, 2, 4])[i], (w @ w @ [5, 0, 1])[i]])
    assert np.allclose(got[2, "a"], (7, 7))


def test_report_averages(spark):
    rows = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a")]
    got = {r.average: r for r in ev.report_averages(ev.class_report(spark.createDataFrame(rows, "t string, p string"), "t", "p")).collect()}
    assert abs(got["macro"].recall - (0.75 + 1 + 0) / 3) < 1e-12 and abs(got["weighted"].recall - (0.75 * 4 + 2) / 7) < 1e-12
    assert got["macro"].support == 7


def test_splits_and_clips(spark):
    df = spark.range(101).withColumnRenamed("id", "k")
    assert ev.random_split(df, "k").where("in_train").count() == 80
    days = spark.sql("select explode(sequence(timestamp_ntz'2020-01-01', timestamp_ntz'2020-01-31', interval 1 day)) as ts")
    assert ev.between_dates(days, "ts", "2020-01-05", "2020-01-09").count() == 5
    assert [r[0] for r in spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "p double").select(ev.clipped(F.col("p"), 0.1)).collect()] == [0.1, 0.5, 0.9]
    orders = spark.createDataFrame([("O",), ("f",)], "s string")
    assert trading.with_status(orders, "s", "F").count() == 1 and trading.with_status(orders, "s", "All").count() == 2


def test_system_row_and_history(spark):
    rows = spark.createDataFrame([(1, t, "user", f"t{t}") for t in range(5)] + [(2, 0, "user", "only")], "c long, turn long, role string, text string")
    got = sorted((r.c, r.turn, r.role) for r in tx.with_system_row(rows, "c", "turn", "be brief", 2).collect())
    assert got == [(1, -1, "system"), (1, 3, "user"), (1, 4, "user"), (2, -1, "system"), (2, 0, "user")]


def test_models_are_chosen_refitted_saved_and_score_batches(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i % 5, float(c), c + rng.gauss(0, 0.1), rng.gauss(0, 1)) for i in range(200) for c in [i % 3]]
    df = spark.createDataFrame(rows, "fold int, label double, a double, b double")
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier

    own = {"labelCol": "label", "featuresCol": "scaled"}
    models = {"logistic": LogisticRegression(**own), "weak": RandomForestClassifier(numTrees=1, maxDepth=0, seed=1, **own)}
    acc = ml.fold_accuracies(df, ["a", "b"], models)
    assert acc.count() == 10
    name, fitted = ml.refitted(df, ["a", "b"], models, acc)
    assert name == "logistic"
    ml.save(fitted, f"file://{tmp_path}/m")
    names = spark.createDataFrame([(0, "none"), (1, "one")], "code int, name string")
    out = ml.batch_scores(df.drop("label", "fold"), ml.load(f"file://{tmp_path}/m"), names).collect()
    assert sum(r.code == bisect.bisect([0.5, 1.5], r.a) for r in out) > 195 and {r.name for r in out} == {"none", "one", "unknown"}


def test_balanced_cv(spark):
    rng = random.Random(3)
    rows = [(i // 10 % 5, float(i % 10 == 0), (i % 10 == 0) * 2 + rng.gauss(0, 0.3)) for i in range(300)]
    out = ml.balanced_cv(spark.createDataFrame(rows, "fold int, label double, a double"), ["a"]).collect()
    assert len(out) == 5 and all(r.recall > 0.8 for r in out)


def test_bars_since(spark, tmp_path):
    rows = [("A", f"2020-01-0{d} 00:00:00", 1.0, 2.0, 0.5, None if d == 3 else 1.5, 10) for d in range(1, 6)]
    df = spark.createDataFrame(rows, "SYMBOL string, ts string, Open double, high double, low double, close double, volume long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(f"{tmp_path}/bars")
    assert readers.read_bars(spark, f"{tmp_path}/bars", "2020-01-02").count() == 3
    writers.write_metrics(spark.createDataFrame([("x", 0.5), ("y", 1.0)], "metric string, value double"), f"{tmp_path}/m")
    assert {(r.metric, r.value) for r in readers.read_metrics(spark, f"{tmp_path}/m").collect()} == {("x", 0.5), ("y", 1.0)}
