"""Boosting, the kernel machine, graph networks, flattened trees, the task frontier and matrix files."""

import math
import time

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from gridloom.operators import agents, boosting, kernel, ml, perceptron, retrieval, semantic, vector_index
from gridloom.operators import convolution as cv
from gridloom.operators import evaluate as ev
from gridloom.operators import graph as gr
from gridloom.operators import timeseries as ts
from gridloom.operators.passes import layered, layered_sums, weighted_sums
from gridloom.plans import library
from gridloom.sources import matrix, readers

from .conftest import SF

# Boosting


def split_by_trial(sums, ridge, least):
    """The best split of one node by trying every column, cut and side for the missing ones."""
    g, h = sums[0].sum(0)
    best = (1e-9, -1, 0, False)
    for c in range(sums.shape[0]):
        for cut in range(1, sums.shape[1] - 1):
            for side in (False, True):
                left = sums[c, 1 : cut + 1].sum(0) + (sums[c, 0] if side else 0)
                right = np.array([g, h]) - left
                if left[1] >= least and right[1] >= least:
                    gain = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge) - g**2 / (h + ridge)
                    if gain > best[0] + 1e-12:
                        best = (gain, c, cut, side)
    return best


def test_split_choice():
    rng = np.random.default_rng(1)
    sums = np.stack([rng.normal(0, 3, (20, 3, 9)), rng.uniform(0, 2, (20, 3, 9))], axis=3)
    sums[:, 1:] *= 0
    for n in range(20):  # every column holds the same rows in other bins
        for c in (1, 2):
            sums[n, c] = sums[n, 0][rng.permutation(9)]
    got = boosting.best_splits(sums, 1.0, 0.5)
    for n in range(20):
        gain, column, cut, side = split_by_trial(sums[n], 1.0, 0.5)
        assert got["column"][n] == column and got["gain"][n] == pytest.approx(gain if column >= 0 else 0)
        if column >= 0:
            assert (got["cut"][n], got["missing_left"][n]) == (cut, side)
    flat = np.zeros((1, 2, 5, 2))
    flat[..., 1] = 1.0
    assert boosting.best_splits(flat, 1.0, 0.5)["column"][0] == -1


def test_bins():
    x = np.array([[np.nan, 1.0, 2.0, 2.5, 9.0]])
    assert boosting.binned(x, [np.array([1.0, 2.0])]).tolist() == [[0, 1, 2, 3, 3]]


def rings(n=900, seed=0, missing=False):
    """Three classes by the distance from the centre: no line parts them."""
    rng = np.random.default_rng(seed)
    r, a = rng.uniform(0, 3, n), rng.uniform(0, 2 * math.pi, n)
    rows = [(i, float(x * math.cos(y)), float(x * math.sin(y)), float(int(x))) for i, (x, y) in enumerate(zip(r, a, strict=True))]
    return [(i, None if missing and i % 9 == 0 else a, b, y) for i, a, b, y in rows]


@pytest.fixture(scope="module")
def ringed(spark):
    return ev.stratified_folds(spark.createDataFrame(rings(), "id long, a double, b double, label double"), "id", "label", 3).drop("repeat").cache()


def test_boosting_learns_rings_and_matches_one_machine(spark, ringed):
    settings = boosting.Settings(rounds=4, depth=3)
    fitted = boosting.boosted(ringed, ["a", "b"], "label", 3, "fold", 3, settings)
    assert min(r.accuracy for r in fitted.fold_accuracies().collect()) > 0.75
    rows = ringed.orderBy("id").collect()
    x, y, fold = np.array([[r.a, r.b] for r in rows]).T, np.array([int(r.label) for r in rows]), np.array([r.fold for r in rows])
    bins = boosting.binned(x, fitted.shape.cuts)
    for f in range(3):  # the same trees by hand, from the rows of the other folds
        own = np.flatnonzero(fold != f)
        margins = np.zeros((3, len(own)))
        for trees in fitted.rounds:
            g, h = boosting.gradients(margins, y[own])
            for c in range(3):
                sums = np.zeros((2, settings.bins, 2))
                for j in range(2):
                    sums[j, :, 0] = np.bincount(bins[j, own], g[c], settings.bins)
                    sums[j, :, 1] = np.bincount(bins[j, own], h[c], settings.bins)
                gain, column, cut, _ = split_by_trial(sums, 1.0, 1.0)
                t = f * 3 + c
                assert (trees.column[t, 0], trees.cut[t, 0]) == (column, cut)
                left = bins[column, own] <= cut
                nodes = trees.nodes(t, bins[:, own], 1)
                assert (nodes == np.where(left, 1, 2)).all()
                for node in (3, 4, 5, 6):
                    at = trees.nodes(t, bins[:, own], 2) == node
                    if at.any():
                        assert trees.value[t, node] == pytest.approx(-g[c][at].sum() / (h[c][at].sum() + 1), rel=1e-4, abs=1e-6)
            for c in range(3):
                margins[c] += 0.3 * trees.value[f * 3 + c][trees.nodes(f * 3 + c, bins[:, own], 3)]


def test_a_task_for_each_fold_grows_the_trees_of_the_passes(spark, monkeypatch):
    rows = spark.createDataFrame([(a, b, float(i % 4), i % 5 - 1, y) for i, a, b, y in rings(1500, missing=True)], "a double, b double, c double, fold int, label double")
    settings = boosting.Settings(rounds=2, depth=2, bins=16)
    alone = boosting.boosted(rows, ["a", "b", "c"], "label", 3, "fold", 4, settings)
    monkeypatch.setattr(boosting, "_folds_alone", None)
    monkeypatch.setattr(boosting, "ALONE", 0)
    passes = boosting.boosted(rows, ["a", "b", "c"], "label", 3, "fold", 4, settings)
    for one, two in zip(alone.rounds, passes.rounds, strict=True):
        assert (one.column == two.column).all() and (one.cut == two.cut).all() and (one.missing_left == two.missing_left).all() and np.allclose(one.value, two.value)
    assert np.allclose(alone.gains, passes.gains)
    assert alone.fold_accuracies().orderBy("fold").collect() == passes.fold_accuracies().orderBy("fold").collect()


def test_few_cells_take_no_job_for_each_level(spark, ringed, monkeypatch):
    monkeypatch.setattr(boosting, "_splits", None)
    assert len(boosting.boosted(ringed, ["a", "b"], "label", 3, "fold", 3, boosting.Settings(rounds=2, depth=2)).rounds) == 2


def test_logistic_folds_train_together(spark, ringed):
    together = {r.fold: r.accuracy for r in ml.FoldedLogistic(maxIter=500, labelCol="label").fold_accuracies(ringed, ["a", "b"]).collect()}
    for fold, accuracy in together.items():
        one = ml.scaled_pipeline(["a", "b"], ml.FoldedLogistic(maxIter=500, labelCol="label", featuresCol="scaled")).fit(ringed.where(F.col("fold") != fold))
        said = one.transform(ringed.where(F.col("fold") == fold)).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
        assert said == pytest.approx(accuracy, abs=0.01)
    assert sorted(together) == [0, 1, 2]


def test_held_out_labels_teach_nothing(spark, ringed):
    settings = boosting.Settings(rounds=2, depth=2)
    other = ringed.withColumn("label", F.when(F.col("fold") == 1, 2 - F.col("label")).otherwise(F.col("label")))
    one, two = (boosting.boosted(d, ["a", "b"], "label", 3, "fold", 3, settings) for d in (ringed, other))
    for a, b in zip(one.rounds, two.rounds, strict=True):
        assert (a.column[3:6] == b.column[3:6]).all() and np.allclose(a.value[3:6], b.value[3:6])
    assert any((a.value[:3] != b.value[:3]).any() for a, b in zip(one.rounds, two.rounds, strict=True))


def test_missing_numbers_and_null_labels(spark):
    df = spark.createDataFrame([*rings(300, missing=True), (1000, 1.0, 1.0, None)], "id long, a double, b double, label double")
    fitted = boosting.boosted(df, ["a", "b"], "label", 3, settings=boosting.Settings(rounds=3, depth=3))
    assert all(np.isfinite(t.value).all() for t in fitted.rounds)
    empty = boosting.boosted(df.where("false"), ["a", "b"], "label", 3, settings=boosting.Settings(rounds=2, depth=2))
    assert all((t.column == -1).all() for t in empty.rounds)


@pytest.mark.parametrize("model", [boosting.SoftmaxBoosting(classes=3, rounds=8, depth=4, featuresCol="scaled"), kernel.KernelMachine(classes=3, count=128, steps=40, featuresCol="scaled"), perceptron.Perceptron(layers=[2, 16, 8, 3], steps=80, featuresCol="scaled")])
def test_models_are_saved_with_their_pipeline(spark, ringed, tmp_path, model):
    fitted = ml.scaled_pipeline(["a", "b"], model).fit(ringed)
    ml.save(fitted, str(tmp_path / "model"))
    read = ml.load(str(tmp_path / "model"))
    assert isinstance(read, PipelineModel)
    one, two = (m.transform(ringed).select("id", "label", "prediction").orderBy("id").collect() for m in (fitted, read))
    assert one == two and sum(r.label == r.prediction for r in one) > 0.85 * len(one)


def test_all_folds_in_the_same_passes(spark, ringed):
    models = {"boosted": boosting.SoftmaxBoosting(classes=3, rounds=10, depth=4), "kernel": kernel.KernelMachine(classes=3, count=128, steps=60), "perceptron": perceptron.Perceptron(layers=[2, 16, 8, 3], steps=100), "logistic": ml.classifiers(2, 3)["logistic"]}
    got = ml.fold_accuracies(ringed, ["a", "b"], models).groupBy("model").agg(F.avg("accuracy").alias("a"), F.count("*").alias("n")).collect()
    acc = {r.model: r.a for r in got}
    assert all(r.n == 3 for r in got) and acc["boosted"] > 0.85 and min(acc["kernel"], acc["perceptron"]) > 0.85 > 0.6 > acc["logistic"]


def test_fault_models_train_whole(spark):
    out = {r.model: r for r in library.fault_models_cv(spark, SF).collect()}
    assert set(out) == {"boosted", "forest", "kernel", "logistic", "perceptron"} and all(r.folds == 5 for r in out.values())
    assert all(0.1 < r.accuracy < 0.3 for r in out.values())  # six classes, and the columns tell nothing of them


def test_copies_of_rows_do_not_grow_the_blocks(spark, ringed):
    """Twice the same rows: no more cells and rows in blocks, and the same sums as from every row by itself."""
    twice = ringed.union(ringed)
    fitted = boosting.boosted(twice, ["a", "b"], "label", 3, "fold", 3, boosting.Settings(rounds=1, depth=2))
    blocks = [fitted.shape.read(r.asDict()) for r in fitted.blocks.collect()]
    assert sum(bins.shape[1] for bins, _, _ in blocks) <= 900 and sum(counts.sum() for _, counts, _ in blocks) == 1800
    label = np.array([0, 2, 2, 1])
    g, h = boosting.gradients(np.tile([[0.3], [0.1], [-2.0]], 4), label)
    both = boosting.cell_gradients(np.array([[0.3], [0.1], [-2.0]]), np.array([[1], [1], [2]]))
    assert np.allclose(both[0][:, 0], g.sum(1)) and np.allclose(both[1][:, 0], h.sum(1))
    rows = [kernel.row_blocks(d, ["a", "b"], "label", "fold", 3) for d in (ringed, twice)]
    x, y, n = (np.concatenate(v) for v in zip(*[kernel.block_of(r.asDict(), 2) for r in rows[1][0].collect()], strict=True))
    assert len(x) == 900 and (n.sum(1) == 2).all() and np.allclose(rows[1][2], 2 * rows[0][2]) and np.allclose(rows[1][3], rows[0][3]) and np.allclose(rows[1][4], rows[0][4])
    w = perceptron.start([2, 5, 3], 1)
    one, two = (perceptron.softmax_loss(x, y, w, [2, 5, 3], t) for t in (np.ones(900, bool), n.sum(1)))
    assert two[0] == pytest.approx(2 * one[0]) and np.allclose(two[1], 2 * one[1])


# Kernel machine


def test_fourier_features(spark):
    w, b = kernel.frequencies(3, 32, 0.5, 7)
    x = np.random.default_rng(0).normal(size=(5, 3))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, x array<double>")
    got = np.array([r.z for r in df.select("i", kernel.fourier_features(F.col("x"), w, b).alias("z")).orderBy("i").collect()])
    assert np.allclose(got, kernel.fourier(x, w, b))


def test_kernel_error():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 4))
    exact = np.exp(-0.25 * ((x[:, None] - x[None]) ** 2).sum(2))
    for count in (256, 4096):
        z = kernel.fourier(x, *kernel.frequencies(4, count, 0.25, 1))
        off = z @ z.T - exact
        assert off.std() < 1 / math.sqrt(count) and (np.abs(off) >= 0.5).mean() <= 2 * math.exp(-count * 0.25 / 8)


def test_perceptron_gradient():
    rng = np.random.default_rng(8)
    x, y, chosen, widths = rng.normal(size=(30, 3)), rng.integers(0, 4, 30), rng.random(30) < 0.7, [3, 5, 4, 4]
    w = perceptron.start(widths, 1) + 0.05
    _, g = perceptron.softmax_loss(x, y, w, widths, chosen)
    for i in range(len(w)):
        step = np.zeros_like(w)
        step[i] = 1e-6
        up, down = (perceptron.softmax_loss(x, y, w + s, widths, chosen)[0] for s in (step, -step))
        assert g[i] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-5)


def test_hinge_gradient_and_minimum():
    rng = np.random.default_rng(3)
    z, y, w = rng.normal(size=(40, 6)), rng.integers(0, 3, 40), rng.normal(size=(6, 3))
    chosen = rng.random(40) < 0.7
    _, g = kernel.hinge(z, y, w, chosen)
    for i, j in ((0, 0), (3, 2), (5, 1)):
        step = np.zeros_like(w)
        step[i, j] = 1e-6
        assert g[i, j] == pytest.approx((kernel.hinge(z, y, w + step, chosen)[0] - kernel.hinge(z, y, w - step, chosen)[0]) / 2e-6, rel=1e-4, abs=1e-5)
    steps = kernel.minimised(np.zeros(5), 200)
    target, scale = rng.normal(size=5), np.array([1, 10, 100, 3, 0.5])
    at = next(steps)
    try:
        while True:
            at = steps.send((float((scale * (at - target) ** 2).sum()), 2 * scale * (at - target)))
    except StopIteration as end:
        assert np.allclose(end.value, target, atol=1e-3)


# Graph networks


@pytest.fixture(scope="module")
def grid(spark):
    rng = np.random.default_rng(4)
    nodes, edges = [], []
    for s in range(4):
        load = rng.normal(size=30)
        for i in range(30):
            nodes.append((s, f"n{i}", float(load[i]), float(rng.normal()), 0))
        for i in range(30):
            edges += [(s, f"n{i}", f"n{(i + 1) % 30}"), (s, f"n{i}", f"n{int(rng.integers(0, 30))}")]
    n = spark.createDataFrame(nodes, "scenario int, node string, x double, z double, y int")
    e = spark.createDataFrame(edges, "scenario int, src string, dst string")
    near = gr.propagated(n, e, ["x"], 2).select("scenario", "node", (F.col("x") > 0).cast("int").alias("y"))
    n = n.drop("y").join(near, ["scenario", "node"]).withColumn("key", F.concat_ws("-", "scenario", "node")).withColumn("fold", F.when(F.col("scenario") == 3, 0).otherwise(1))
    return n.cache(), gr.normalised(n, e)


def test_propagation_is_the_weighted_sum(spark, grid):
    nodes, w = grid
    plain = w.join(nodes.select("scenario", F.col("node").alias("src"), "x"), ["scenario", "src"]).groupBy("scenario", F.col("dst").alias("node")).agg(F.sum(F.col("w") * F.col("x")).alias("p"))
    edges = w.where("src <> dst").select("scenario", "src", "dst")
    both = gr.propagated(nodes, edges, ["x"], 1).join(plain, ["scenario", "node"])
    assert both.count() == 120 and both.where("abs(x - p) > 1e-9").count() == 0


def one_block(grid):
    nodes, w = grid
    blocks, parts = cv.graph_blocks(nodes, w, ["x", "z"], "y", ["fold"])
    return [cv.Block.read(r.asDict(), 2, 1) for r in blocks.collect()], blocks, parts


def test_gradient_equals_finite_differences(grid):
    (block, *_), _, _ = one_block(grid)
    alpha, chosen = np.array([0.4, 0.6]), (block.fold[:, 0] == 1).astype(float)
    for net in (cv.Network(2, hidden=5), cv.Network(2, hidden=5, relu=False, dropout=0.0)):
        weights = net.start() + 0.05
        masks = (cv.mask(net, block.source, 1, 3), cv.mask(net, block.target, 2, 3)) if net.dropout else None
        _, g = cv.gradient(net, weights, block, masks, chosen, alpha)
        for i in range(net.size()):
            step = np.zeros_like(weights)
            step[i] = 1e-6
            up, down = (cv.gradient(net, weights + s, block, masks, chosen, alpha)[0] for s in (step, -step))
            assert g[i] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-5)


def test_blocks_and_tables_give_the_same_logits(spark, grid, monkeypatch):
    nodes, w = grid
    net = cv.Network(2, hidden=4)
    weights = net.start(1) + 0.1
    hashes = nodes.select("scenario", "node", F.xxhash64("scenario", "node").alias("h"))
    want = {r.h: (r.logit_0, r.logit_1) for r in cv.forward(net, weights, nodes, w, ["x", "z"]).join(hashes, ["scenario", "node"]).collect()}
    monkeypatch.setattr(cv, "EDGES_IN_BLOCK", 50)
    blocks, _, _ = one_block(grid)
    assert len(blocks) > 3
    got = {int(h): tuple(v) for b in blocks for h, v in zip(b.target, cv.logits(net, weights, b)[0], strict=True)}
    assert set(got) == set(want) and all(np.allclose(got[h], want[h]) for h in want)
    nodes_of = np.arange(100) * 7919
    drop = cv.mask(net, nodes_of, 1, 5)
    assert (drop[[3, 50]] == cv.mask(net, nodes_of[[3, 50]], 1, 5)).all() and 0.36 < (drop == 0).mean() < 0.44
    assert (drop != cv.mask(net, nodes_of, 1, 6)).any() and (drop != cv.mask(net, nodes_of, 2, 5)).any()


def test_sums_of_a_block_are_those_of_its_edges(grid):
    (block,), _, _ = one_block(grid)
    rng = np.random.default_rng(4)
    x, back = rng.normal(size=(len(block.source), 3)), rng.normal(size=(len(block.target), 3))
    target = np.repeat(np.arange(len(block.target)), block.sizes)
    want, sent = np.zeros_like(back), np.zeros_like(x)
    np.add.at(want, target, x[block.src] * block.w[:, None])
    np.add.at(sent, block.src, back[target] * block.w[:, None])
    some = np.flatnonzero(rng.random(len(want)) < 0.3)
    assert np.allclose(block.gathered(x), want) and np.allclose(block.gathered(x, some), want[some]) and np.allclose(block.scattered(back), sent)
    sizes = np.array([70, 33, 32, 5, 1, 1])  # groups beyond WIDE and below
    at, w, starts = rng.integers(0, len(x), sizes.sum()), rng.random(sizes.sum()), np.cumsum(sizes) - sizes
    assert np.allclose(weighted_sums(x, at, w, starts, sizes), [(w[a : a + n, None] * x[at[a : a + n]]).sum(0) for a, n in zip(starts, sizes, strict=True)])
    net = cv.Network(2, hidden=4)
    assert np.allclose(cv.logits(net, net.start(), block, rows=some)[0], cv.logits(net, net.start(), block)[0][some])


def test_layered_sums_and_numbers_of_32_bits(spark, grid):
    rng = np.random.default_rng(5)
    for sizes in (np.array([70, 33, 32, 5, 1, 1]), np.array([40, 34]), np.array([3, 3, 1]), np.zeros(0, int)):
        x, at, w, starts = rng.normal(size=(50, 3)), rng.integers(0, 50, sizes.sum()), rng.random(sizes.sum()), np.cumsum(sizes) - sizes
        order = layered(sizes).astype(int)
        assert sorted(order) == list(range(sizes.sum())) and np.allclose(layered_sums(x, at[order], w[order], sizes), weighted_sums(x, at, w, starts, sizes))
    blocks = one_block(grid)[1].collect()
    alpha, net = np.array([0.4, 0.6]), cv.Network(2)
    for kind in (np.float64, np.float32):
        block = cv.Block.read(blocks[0].asDict(), 2, 1, kind)
        masks = (cv.mask(net, block.source, 1, 3), cv.mask(net, block.target, 2, 3))
        assert cv.logits(net, net.start(), block)[1][0].dtype == kind
        loss, g = cv.gradient(net, net.start(), block, masks, np.ones(len(block.target)), alpha)
        if kind == np.float64:
            want = loss, g
    assert loss == pytest.approx(want[0], rel=1e-5) and np.abs(g - want[1]).max() < 1e-5 * np.abs(want[1]).max()


def test_units_drop_out_on_their_own():
    net = cv.Network(2)
    drop = np.concatenate([cv.mask(net, np.arange(40_000), 1, e) for e in (1, 2)], axis=1) == 0
    assert np.abs(drop.mean(0) - 0.4).max() < 0.015
    assert np.abs(np.corrcoef(drop.T) - np.eye(64)).max() < 0.03 and np.abs((drop[1:] == drop[:-1]).mean() - 0.52) < 0.005


def test_loss_falls_on_held_out_scenarios(spark, grid):
    _, blocks, parts = one_block(grid)
    net = cv.Network(2, hidden=16)
    fitted = cv.trained(net, blocks, parts, [(0, 0)], 1, cv.Training(epochs=60, rate=0.02))
    h = fitted.history[0]
    assert [r["epoch"] for r in h] == list(range(1, 61))
    assert h[-1]["val_loss"] < 0.5 * h[0]["val_loss"] and h[-1]["val_acc"] > 0.85
    best = min(h, key=lambda r: r["val_loss"])
    nodes, w = grid
    p = cv.probabilities(net, fitted.best[0], nodes.drop("y"), w, ["x", "z"]).join(nodes.where("fold = 0").select("scenario", "node", "y"), ["scenario", "node"])
    assert p.agg(F.avg(((F.col("probability") > 0.5).cast("int") == F.col("y")).cast("double"))).first()[0] == pytest.approx(best["val_acc"])


def test_models_of_a_cross_validation_are_independent(spark, grid):
    nodes, w = grid
    folds = ev.stratified_folds(nodes.drop("fold"), "key", "y", 2).drop("repeat")
    blocks, parts = cv.graph_blocks(folds, w, ["x", "z"], "y", ["fold"])
    net, t = cv.Network(2, hidden=4), cv.Training(epochs=5)
    both = cv.trained(net, blocks, parts, [(0, 0), (0, 1)], 1, t)
    alone = cv.trained(net, blocks, parts, [(0, 0)], 1, t)
    assert np.allclose(both.last[0], alone.last[0]) and not np.allclose(both.last[0], both.last[1])
    out = cv.cross_validated(net, nodes.drop("fold"), w, ["x", "z"], "y", "key", splits=3, repeats=2, training=cv.Training(epochs=30, rate=0.02)).collect()
    assert len(out) == 6 and sum(r.n for r in out) == 240 and min(r.f1 for r in out) > 0.5


def test_target_falls_back(spark):
    df = spark.createDataFrame([(1, 0)], "alarm_flag int, thermal_class int")
    assert gr.target_of(df, "Thermal_Class").first().target == 0 and gr.target_of(df, "voltage_class").first().target == 1
    with pytest.raises(ValueError, match="neither"):
        gr.target_of(df.drop("alarm_flag"), "voltage_class")


# Forecasts


def test_flat_trees_predict_like_the_model(spark):
    rng = np.random.default_rng(5)
    rows = [tuple(map(float, r)) for r in np.column_stack([rng.normal(size=(400, 9)), rng.normal(size=400)])]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in (*ts.FEATURES, "value")))
    model = ml.load_model(df, trees=5, depth=4)
    got = model.transform(df).select(*ts.FEATURES, "prediction").collect()
    x = np.array([[r[c] for c in ts.FEATURES] for r in got])
    assert np.allclose(ts.FlatTrees.of(model.stages[-1]).predicted(x), [r.prediction for r in got])


def test_long_forecast(spark):
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    rows = [(s, start + dt.timedelta(hours=h), float(h % 24 + k)) for k, s in enumerate(("a", "b", "c")) for h in range(60 if s == "c" else 400)]
    known = ts.features(spark.createDataFrame(rows, "series string, ts timestamp_ntz, value double")).cache()
    model = ml.load_model(known, trees=5, depth=4)
    out = ts.forecast(model, known, 500).orderBy("series", "ts").collect()
    assert len(out) == 1500 and out[0].ts == start + dt.timedelta(hours=400) and out[499].ts == start + dt.timedelta(hours=899)
    one = ts.forecast(model, known, 24).orderBy("series", "ts").collect()
    assert [r.prediction for r in one[:24]] == [r.prediction for r in out[:24]]
    first = known.where("series = 'a'").orderBy(F.desc("ts")).limit(168).orderBy("ts").collect()
    h = [r.value for r in first]
    for r in one[:24]:  # step by step through the model itself
        at = {"hour": r.ts.hour, "dayofweek": r.ts.weekday(), "month": r.ts.month, "is_weekend": int(r.ts.weekday() >= 5), "lag_1": h[-1], "lag_24": h[-24], "lag_168": h[-168]}
        at |= {"rolling_24h_mean": sum(h[-24:]) / 24, "rolling_168h_mean": sum(h[-168:]) / 168}
        h.append(float(ts.FlatTrees.of(model.stages[-1]).predicted(np.array([[at[c] for c in ts.FEATURES]]))[0]))
        assert h[-1] == pytest.approx(r.prediction)


# Task frontier


def test_frontier_retries_open_tasks_only(spark):
    plans = spark.createDataFrame([(1, "- first step -\n\n  second step\nthird"), (2, None), (3, "x\n" * 300)], "request int, plan string")
    tasks = agents.planned_tasks(plans, "request").withColumn("id", F.col("request") * 1000 + F.col("task_no"))
    assert [r.task for r in tasks.where("request = 1").orderBy("task_no").collect()] == ["first step", "second step", "third"] and tasks.where("request = 3").count() == 200
    seen = []

    def retrieve(todo):
        seen.append(sorted((r.task, r.tries, tuple(r.invalid)) for r in todo.collect()))
        return todo.withColumn("context", F.lit("api.good"))

    def execute(todo):  # the second step is right at its third try, the third never, and one task gets no answer
        name = F.when(F.col("task") == "first step", "good").when((F.col("task") == "second step") & (F.col("tries") >= 2), "good").otherwise("bad")
        return todo.where("task <> 'x'").select("id", F.concat(F.lit("api."), name, F.lit("()")).alias("result"))

    valid = spark.createDataFrame([("good",)], "name string")
    own = tasks.where("request = 1 or task_no = 0")
    done = agents.frontier(own, "id", retrieve, execute, lambda c: agents.names_used(c, r"api\.(\w+)"), valid)
    assert {r.task: (r.state, r.tries, r.result, r.invalid) for r in done.collect()} == {
        "first step": ("done", 1, "api.good()", []), "second step": ("done", 3, "api.good()", []), "third": ("failed", 4, "api.bad()", ["bad"]), "x": ("failed", 4, None, [])}
    assert [len(s) for s in seen] == [4, 3, 3, 2] and seen[1][0] == ("second step", 1, ("bad",))
    assert {r.request: (r.n_tasks, r.n_failed) for r in agents.summary(done, "request").collect()} == {1: (3, 1), 3: (1, 1)}
    assert agents.frontier(own.where("false"), "id", retrieve, execute, lambda c: agents.names_used(c, "x(y)"), valid).count() == 0


# Learned vectors


def test_singular_vectors(spark):
    rng = np.random.default_rng(7)
    topics = [[f"t{t}w{i}" for i in range(12)] for t in range(4)]
    texts = [(i, " ".join(rng.choice(topics[i % 4], 20))) for i in range(200)] + [(900, ""), (901, None)]
    df = spark.createDataFrame(texts, "vec_id long, text string")
    model = semantic.fit(df, size=4, columns=256, rounds=3)
    dense = np.zeros((len(texts), 256))
    for i, r in enumerate(df.select(semantic._places(F.coalesce("text", F.lit("")), 256).alias("p")).collect()):
        np.add.at(dense[i], r.p, 1)
    dense *= np.log((len(texts) + 1) / ((dense > 0).sum(0) + 1))
    size = np.sqrt((dense**2).sum(1, keepdims=True))
    dense /= np.where(size > 0, size, 1)
    _, singular, vt = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(model.singular, singular[:4], rtol=0.02)
    assert np.linalg.norm(model.vectors @ model.vectors.T - vt[:4].T @ vt[:4]) < 0.2
    hits = retrieval.top_k(model.embedded(df), model.embedded(df.where("vec_id < 8")), 10).collect()
    assert np.mean([h.query % 4 == h.id % 4 for h in hits]) > 0.97


def test_sparse_products():
    rng = np.random.default_rng(2)
    sizes = np.array([0, 1, 5000, 0, *rng.integers(0, 300, 1500)])
    flat = rng.integers(0, 1024, sizes.sum()).astype(np.int32)
    rows = semantic.Rows.of(flat, sizes, 1024)
    dense = np.zeros((len(sizes), 1024))
    np.add.at(dense, (np.repeat(np.arange(len(sizes)), sizes), flat), 1)
    own = np.repeat(np.arange(len(sizes)), np.diff(rows.starts))
    assert rows.starts[-1] == (dense > 0).sum() and np.array_equal(dense[own, rows.column], rows.count)
    thin, into, slow = rng.normal(size=(1024, 64)), np.zeros((1024, 64)), np.zeros((1024, 64))
    v = rows.count.astype(float)
    start = time.perf_counter()
    y = rows.times(v, thin)
    rows.back(v, y, into)
    took = time.perf_counter() - start
    np.add.at(slow, rows.column, y[own] * v[:, None])
    assert took < time.perf_counter() - start - took  # both products are faster than one that adds entry by entry
    assert np.allclose(y, dense @ thin) and np.allclose(into, dense.T @ y) and np.allclose(into, slow)
    empty = semantic.Rows.of(np.zeros(0, np.int32), np.zeros(0, np.int64), 8)
    assert len(empty.starts) == 1 and empty.times(np.zeros(0), np.zeros((8, 2))).shape == (0, 2)


# Vector index


def test_index_gives_the_exact_answers(spark, tmp_path):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16)) * 4
    rows = [(i, (centres[i % 12] + 0.3 * rng.normal(size=16)).tolist()) for i in range(3000)]
    rows += [(5000 + i, rows[0][1]) for i in range(700)] + [(6000, [0.0] * 16), (6001, None)]  # ties beyond a block
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vector_index.build_index(df, f"file://{tmp_path}/index")
    asked = df.where("vec_id % 100 = 0 or vec_id >= 5990")
    got, share = vector_index.search(spark, f"file://{tmp_path}/index", asked, 7)
    want = retrieval.top_k(df, asked, 7)
    pick = lambda d: sorted((r["query"], r["rank"], r["id"], round(r["score"], 9)) for r in d.collect())
    assert pick(got) == pick(want) and 0 < share < 0.35
    blocks = spark.read.parquet(f"{tmp_path}/index/lists")
    assert blocks.agg(F.sum("n")).first()[0] == 3701 and blocks.agg(F.max("n")).first()[0] <= vector_index.BLOCK
    many, _ = vector_index.search(spark, f"file://{tmp_path}/index", asked.limit(3), 5000)
    assert many.count() == 3 * 3701
    vector_index.build_index(df.where("false"), f"file://{tmp_path}/none")
    assert vector_index.search(spark, f"file://{tmp_path}/none", asked, 3)[0].count() == 0


# Files


def test_matrix_files(spark, tmp_path):
    values = np.arange(1000, dtype=np.float32).reshape(250, 4)
    np.save(tmp_path / "one.npy", values)
    df = matrix.read_matrix(spark, str(tmp_path / "one.npy"), rows_in_partition=60)
    rows = df.orderBy("row").collect()
    assert df.rdd.getNumPartitions() == 5 and [r.row for r in rows] == list(range(250)) and [list(r.embedding) for r in rows] == values.tolist()
    src = spark.createDataFrame([(i, v.astype(float).tolist()) for i, v in enumerate(values)], "id long, v array<double>")
    for n in (3, 2):  # the second one replaces the first
        matrix.write_matrix(src, "v", "id", str(tmp_path / "parts"), n)
        assert len(list((tmp_path / "parts").glob("*"))) == n
    back = matrix.read_matrix(spark, str(tmp_path / "parts"))
    assert back.schema["embedding"].dataType.simpleString() == "array<double>"
    assert [list(r.embedding) for r in back.orderBy("row").collect()] == values.tolist()
    (tmp_path / "chunks.json").write_text("[" + ", ".join(f'{{"text": "t{i}"}}' for i in range(250)) + "]")
    both = matrix.read_indexed_chunks(spark, str(tmp_path / "one.npy"), str(tmp_path / "chunks.json")).where("row = 77").first()
    assert both.text == "t77" and list(both.embedding) == values[77].tolist()
    (tmp_path / "few.json").write_text('[{"text": "a"}]')
    with pytest.raises(ValueError, match="250 vectors and 1 chunks"):
        matrix.read_indexed_chunks(spark, str(tmp_path / "one.npy"), str(tmp_path / "few.json"))


def test_matrix_ranges_read_their_own_bytes(tmp_path, monkeypatch):
    np.save(tmp_path / "m.npy", np.zeros((1000, 8), np.float32))
    read = []

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *error):
            self.f.close()

        def seek(self, n):
            self.f.seek(n)

        def read(self, n):
            read.append(n)
            return self.f.read(n)

    reader = matrix.MatrixReader({"path": str(tmp_path / "m.npy"), "rows_in_partition": "100"})
    parts = reader.partitions()

    class Store:
        def open_input_file(self, path):
            return Counted(open(path, "rb"))

    monkeypatch.setattr(matrix, "_at", lambda path: (Store(), path))
    assert sum(len(b) for b in reader.read(parts[3])) == 100 and sum(read) == 100 * 8 * 4


def test_latest_file(spark, tmp_path):
    for name, text in (("summary_2024.txt", "old"), ("summary_2025.txt", "new"), ("summary_2026.md", "no"), ("other_9.txt", "no")):
        (tmp_path / name).write_text(text)
    got = readers.latest_text(spark, str(tmp_path), "summary_")
    assert got.first().text == "new" and len(got.inputFiles()) == 1
    assert readers.latest_text(spark, str(tmp_path), "none_").count() == 0
    assert readers.since_days(200, "2025-03-01") == "2024-01-26"


# Forests on cells


def test_forest_depends_on_rows_alone(spark, tmp_path):
    from gridloom.operators.forest import CellForest, best_splits, grown

    rng = np.random.default_rng(5)
    rows = [(float(a), float(b), float((a > 5) + (a > 5 and b > 3))) for a, b in rng.integers(0, 10, (2000, 2))]
    df = spark.createDataFrame(rows, "a double, b double, label double")
    one = grown(df.coalesce(1), ["a", "b"], "label", 3, trees=6)
    other = grown(df.orderBy("b").repartition(7), ["a", "b"], "label", 3, trees=6)  # Spark's own forest draws by partition
    assert all(np.array_equal(getattr(one[0], n), getattr(other[0], n)) for n in ("column", "cut")) and np.array_equal(one[1], other[1])
    assert len({one[1][t].tobytes() for t in range(6)}) == 6  # each tree has a sample of its own
    fitted = ml.scaled_pipeline(["a", "b"], CellForest(numTrees=20, featuresCol="scaled")).fit(df)
    ml.save(fitted, f"file://{tmp_path}/forest")
    said = ml.load(f"file://{tmp_path}/forest").transform(df).select("label", "prediction").collect()
    assert np.mean([r.label == r.prediction for r in said]) > 0.99
    counts = np.zeros((1, 2, 3, 2))
    counts[0, 0] = counts[0, 1] = [[0, 0], [4, 0], [0, 4]]
    best = best_splits(counts, np.array([[False, True]]))
    assert (best["column"][0], best["cut"][0]) == (1, 1) and best["left"][0].tolist() == [4, 0] and best["right"][0].tolist() == [0, 4]


def test_split_ranks_one_bucket_of_each_label(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("y"))
    got = ev.stratified_split(df, "id", "y", 0.7)
    want = ev._placed(df, "id", "y", 42).withColumn("in_train", F.col("_place") < F.floor(F.col("_n") * 0.7)).where("y is not null")
    assert {tuple(r) for r in got.where("y is not null").select("id", "in_train").collect()} == {tuple(r) for r in want.select("id", "in_train").collect()}
    assert got.count() == 5000 and got.where("y is null and in_train").count() == 700
    assert ev.random_split(spark.createDataFrame([("k",)] * 10, "k string"), "k").where("in_train").count() == 8  # equal keys
    assert ev.random_split(df.where("false"), "id").count() == 0


# Balanced cross-validation


def test_balanced_cv_fits_distinct_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i % 5, float(a + b > 9), float(a), int(b)) for i, (a, b) in enumerate(rng.integers(0, 8, (600, 2)))] * 4
    df = spark.createDataFrame(rows, "fold int, label double, a double, b int")
    want = {}
    for fold in range(5):
        said = ml.alarm_model(df.where(F.col("fold") != fold), ["a", "b"]).transform(df.where(F.col("fold") == fold))
        want[fold] = tuple(said.agg(*ev.binary_measures("label", "prediction")).first())
    seen, plain = [], ml.balanced_weights
    monkeypatch.setattr(ml, "balanced_weights", lambda d, *a, **k: seen.append(d.count()) or plain(d, *a, **k))
    got = {r[0]: tuple(r[1:]) for r in ml.balanced_cv(df, ["a", "b"]).collect()}
    assert got == want
    assert len(seen) == 5 and max(seen) <= 4 * 64  # of 1920 rows


# Rounds over pairs


def test_rounds_over_pairs(spark, monkeypatch):
    from gridloom.operators import graph

    nodes = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (1, "c", 4.0), (1, "alone", 7.0), (2, "a", 5.0)], "scenario int, node string, x double")
    edges = spark.createDataFrame([(1, "b", "a"), (1, "a", "b"), (1, "b", "c"), (1, "c", "c"), (1, "c", "ghost"), (1, "ghost", "mist"), (2, "a", None)], "scenario int, src string, dst string")
    kept, plain = {}, graph.staged
    monkeypatch.setattr(graph, "staged", lambda d, name: kept.setdefault(name, plain(d, name)))
    got = {(r.scenario, r.node): r.x for r in graph.propagated(nodes, edges, ["x"], 2).collect()}
    assert kept["links"].count() == 4  # a pair once, not both ways, and no self loops
    names = ["a", "b", "c", "alone", "ghost", "mist"]
    near = np.zeros((6, 6))
    for a, b in ((0, 1), (1, 2), (2, 4), (4, 5)):
        near[a, b] = near[b, a] = 1
    near += np.diag([1, 1, 1, 1, 0, 0])  # what is no node has no self loop
    near /= np.sqrt(np.outer(near.sum(0), near.sum(0)))
    want = near @ near @ np.array([1.0, 2, 4, 7, 0, 0])
    assert got.pop((2, "a")) == 5
    assert set(got) == {(1, n) for n in names} and all(np.isclose(got[1, n], v) for n, v in zip(names, want, strict=True))


def test_forward_over_pairs_is_forward(spark):
    rng = np.random.default_rng(4)
    nodes = spark.createDataFrame([(i % 2, f"n{i}", float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(40, 2)))], "scenario int, node string, x double, z double")
    edges = spark.createDataFrame([(int(a) % 2, f"n{a}", f"n{b}") for a, b in rng.integers(0, 44, (120, 2))], "scenario int, src string, dst string")
    net = cv.Network(2, hidden=4)
    weights = rng.normal(size=net.size())
    of = lambda d: {(r.scenario, r.node): (r.logit_0, r.logit_1) for r in d.collect()}
    want, got = of(cv.forward(net, weights, nodes, gr.normalised(nodes, edges), ["x", "z"])), of(cv.forward_over_pairs(net, weights, nodes, gr.links(edges), ["x", "z"]))
    assert set(want) == set(got) and all(np.allclose(want[k], got[k]) for k in want)
