import numpy as np
import pytest
from pyspark.sql import functions as F

from gradlens.functions import exprs, metrics, plots
from gradlens.functions.linalg import NotFitted
from gradlens.operators import classify, crossval, kernel, levelset, local, moments, neighbors, tree
from gradlens.operators.active import ActiveSubspaces, full_points
from gradlens.operators.features import DISTRIBUTIONS, FeatureMap, anneal, distribution
from gradlens.operators.gp import GP, FixedGP, clipped_r2
from gradlens.sources import from_arrays, read_matrix, read_model, read_npy, read_samples_csv, write_matrix, write_model
from gradlens.streaming import StreamingSubspace


@pytest.fixture(scope="module")
def line(spark):
    """f along one direction, 300 rows."""
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (300, 2))
    t = x @ np.array([0.8, 0.6])
    return from_arrays(spark, x, np.sin(2 * t), 2 * np.cos(2 * t)[:, None] * np.array([0.8, 0.6])).persist()


def test_fit_transform_round_trip(spark, line):
    model = ActiveSubspaces(dim=0, n_boot=20).fit(line)
    assert model.dim == 1
    np.testing.assert_allclose(np.abs(model.W1[:, 0]), [0.8, 0.6], atol=1e-9)
    out = model.transform(line).limit(20).toPandas()
    y, z, x = (np.array(out[c].tolist()) for c in ("active", "inactive", "x"))
    np.testing.assert_allclose(y @ model.W1.T + z @ model.W2.T, x, atol=1e-12)
    assert (model.evals_br[0, 0] <= model.evals[0, 0] <= model.evals_br[0, 1])
    assert plots.eigenvalue_data(model, spark).count() == 2 and plots.eigenvector_data(model, spark).count() == 2
    assert plots.summary_data(model, line).columns == ["y0", "f"]
    with pytest.raises(TypeError):
        plots.eigenvalue_data(model, spark, 5)
    with pytest.raises(ValueError):
        plots.eigenvector_data(model, spark, 5)
    with pytest.raises(NotFitted):
        _ = ActiveSubspaces(dim=1).activity_scores


def test_golden_scores(spark):
    np.random.seed(42)
    g = np.random.uniform(-1, 1, 180).reshape(15, 3, 4)
    df = from_arrays(spark, g=g)
    np.testing.assert_array_almost_equal(ActiveSubspaces(dim=1).fit(df).activity_scores, [0.599489, 0.055179, 0.37102, 0.300374])
    np.testing.assert_array_almost_equal(ActiveSubspaces(dim=2).fit(df).activity_scores, [0.89979047, 0.58309172, 0.38654072, 0.6618360])
    plain, scaled = moments.moment_matrix(df), moments.moment_matrix(df, metric=2 * np.eye(3))
    np.testing.assert_allclose(scaled, 2 * plain)


def test_sql_and_numpy_moments_agree(spark, line):
    a = moments.moment_matrix(line)
    b, n = moments._dense(line.select("g", F.lit(1.0).alias("w")), 2, None)
    np.testing.assert_allclose(a, b / n)


def test_inverse_map(spark, line):
    model = ActiveSubspaces(dim=1, n_boot=None).fit(line)
    reduced = model.transform(line.limit(5))
    out = model.inverse_transform(reduced, 6).join(reduced.select("row_id", "active"), "row_id").toPandas()
    x = np.array(out["x"].tolist())
    assert len(out) == 30 and np.abs(x).max() <= 1 + 1e-9
    np.testing.assert_allclose(x @ model.W1, np.array(out["active"].tolist()), atol=1e-9)
    w = np.linalg.qr(np.random.default_rng(0).normal(size=(5, 5)))[0]
    many = full_points(np.array([0.2, 0.1]), w[:, :2], w[:, 2:], 200, np.random.default_rng(1))
    np.testing.assert_allclose(many @ w[:, :2], np.tile([0.2, 0.1], (200, 1)), atol=1e-9)
    assert np.abs(many).max() <= 1 + 1e-7


def test_local_linear_gradients(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (80, 2))
    df = from_arrays(spark, x, 2 - 5 * x[:, 0] + 4 * x[:, 1])
    g = np.array(neighbors.local_linear_gradients(df, 8).select("g").toPandas()["g"].tolist())
    np.testing.assert_allclose(g, np.tile([-5, 4], (len(g), 1)), atol=1e-9)
    with pytest.raises(TypeError):
        neighbors.local_linear_gradients(df, 8.0)
    with pytest.raises(ValueError):
        neighbors.local_linear_gradients(df, 2)
    with pytest.raises(ValueError):
        neighbors.local_linear_gradients(df.limit(2))


def test_golden_rank_shifted_gradients():
    np.random.seed(42)
    x, f = np.random.uniform(-1, 1, 60).reshape(15, 4), np.random.uniform(0, 5, 15)
    g, _ = neighbors.rank_shifted_gradients(x, f, np.random.mtrand._rand)
    values = np.linalg.eigvalsh(g.T @ g / len(g))[::-1]
    np.testing.assert_array_almost_equal(values, [13.794711, 11.102377, 3.467318, 1.116324], decimal=5)


def test_nearest_and_components(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3))
    df = from_arrays(spark, x)
    got = {(r["query_id"], r["rank"]): r["neighbour_id"] for r in neighbors.k_nearest(df, df, 4).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    assert all(got[i, k + 1] == j for i in range(60) for k, j in enumerate(np.argsort(d[i])[:4]))
    edges = spark.createDataFrame([(0, 1), (1, 2), (5, 4)], "src long, dst long")
    nodes = spark.range(6).withColumnRenamed("id", "node")
    label = {r["node"]: r["label"] for r in neighbors.components(edges, nodes).collect()}
    assert [label[i] for i in range(6)] == [0, 0, 0, 1, 2, 2]


def test_components_of_long_chains(spark):
    """A chain of shuffled nodes takes many rounds: plans must not keep sizes that multiply, nor labels walk node by node."""
    from collections import Counter

    order = np.random.default_rng(1).permutation(1000).tolist()
    edges = spark.createDataFrame([(a, b) for k, (a, b) in enumerate(zip(order, order[1:])) if k not in (99, 499)], "src long, dst long")
    label = {r["node"]: r["label"] for r in neighbors.components(edges, spark.range(1000).withColumnRenamed("id", "node")).collect()}
    parts = sorted((order[:100], order[100:500], order[500:]), key=min)
    assert Counter(label.values()) == {k: len(p) for k, p in enumerate(parts)} and all(label[v] == k for k, p in enumerate(parts) for v in p)


def test_planes_of_points_on_a_line(spark, tmp_path):
    """Copies of customers leave two places among the twelve nearest: the SQL's slopes are then 0 / 0 or by rounding."""
    import duckdb

    from gradlens.plans import catalog

    rng = np.random.default_rng(7)
    places = [(round(float(rng.uniform(-999, 9999)), 2), int(rng.integers(25))) for _ in range(60)]
    spark.createDataFrame([(c * 60 + k, n, b) for c in range(6) for k, (b, n) in enumerate(places)], "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, n, b + 1) for k, (b, n) in enumerate(places[:30])], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    duck = duckdb.connect()
    for t in ("customer", "supplier"):
        duck.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = duck.execute(f"select query_id, g0, g1 from ({catalog.oracle_sql()['local_planes_2d']}) order by 1").fetchall()
    got = [tuple(r) for r in catalog.local_planes_2d(spark, str(tmp_path)).orderBy("query_id").collect()]
    np.testing.assert_array_equal(np.array(got), np.array(want))
    assert any(v != v for r in want for v in r)


@pytest.mark.parametrize("kind", ["uniform", "gaussian"])
def test_group_normalisers_go_to_the_rows(spark, tmp_path, kind, monkeypatch):
    """Rows of few groups are not gathered by group; with more groups than may be sent the result is the same."""
    rng = np.random.default_rng(3)
    spark.createDataFrame([("ab"[k % 2], rng.normal(size=2).tolist(), rng.normal(size=2).tolist()) for k in range(200)], "label string, x array<double>, g array<double>").write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent = local.group_normalize(df, kind)
        assert "BroadcastHashJoin" in (plan := sent._jdf.queryExecution().executedPlan().toString()) and "SortMergeJoin" not in plan
        monkeypatch.setattr(local, "BROADCAST_GROUPS", 1)
        met = local.group_normalize(df, kind)
        assert "SortMergeJoin" in met._jdf.queryExecution().executedPlan().toString()
        a, b = (sorted((r["label"], *r["x"], *r["g"]) for r in out.collect()) for out in (sent, met))
        np.testing.assert_allclose([r[1:] for r in a], [r[1:] for r in b], rtol=1e-12)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_kept_rows_lie_in_small_partitions(spark, monkeypatch):
    seen = []

    class Watched(local.KMeansAS):
        def train(self, df):
            seen.append((df.rdd.getNumPartitions(), df.count()))
            super().train(df)

    rng = np.random.default_rng(5)
    df = from_arrays(spark, rng.normal(size=(400, 2)), rng.normal(size=400), rng.normal(size=(400, 2)))
    monkeypatch.setattr(local, "PART_ROWS", 40)
    model = Watched(local.ClusterConfig(2, restarts=0)).fit(df)
    assert seen == [(10, 400)] and sum(m.n for m in model.models.values()) == 400
    assert local.spread(df.limit(50)).count() == 50


def test_points_of_many_rows_at_once(spark, monkeypatch):
    """The numbers of one generator a row, without making one; means taken in the task are those of the points."""
    import pyarrow as pa

    from gradlens.operators import active

    keys = np.concatenate([np.random.default_rng(1).integers(0, 2**63 - 1, 200), [0, 1, 2**32 - 1, 2**32, 2**63 - 1]])
    for seed in (0, 42, 2**40):
        np.testing.assert_array_equal(active.uniform(seed, keys, 7), [np.random.default_rng([seed, int(k)]).random(7) for k in keys])
    w = np.linalg.qr(np.random.default_rng(2).normal(size=(2, 2)))[0]
    y = np.random.default_rng(3).uniform(-1, 1, (len(keys), 2)) @ w[:, :1]
    want = np.array([full_points(a, w[:, :1], w[:, 1:], 5, np.random.default_rng([42, int(k)])) for a, k in zip(y, keys)])
    monkeypatch.setattr(active, "POINT_NUMBERS", 300)
    monkeypatch.setattr(active, "full_points", None)
    batch = pa.record_batch([pa.array(keys), pa.array(keys), pa.array(y.tolist())], names=["id", "k", "y"])
    got = np.concatenate([x for _, x in active.points_of([batch], w[:, :1], w[:, 1:], 5, 42)])
    np.testing.assert_array_equal(got, want)
    monkeypatch.undo()
    df = from_arrays(spark, np.random.default_rng(6).uniform(-1, 1, (30, 2)), None, np.random.default_rng(7).normal(size=(30, 2)))
    model = ActiveSubspaces(dim=1, n_boot=None).fit(df)
    points = model.inverse_transform(model.transform(df), 4).collect()
    means = {r["row_id"]: r["mean"] for r in model.inverse_mean(model.transform(df), lambda x: x[:, 0] * x[:, 1], 4).collect()}
    assert len(means) == 30 and len(points) == 120
    for i, mean in means.items():
        assert abs(mean - np.mean([r["x"][0] * r["x"][1] for r in points if r["row_id"] == i])) < 1e-12


def test_normalizer(spark):
    df = from_arrays(spark, np.array([[0.0, 1.0], [4.0, 3.0], [1.0, 2.0]]))
    n = exprs.Normalizer.fit(df)
    out = df.select(n.forward().alias("z"), n.inverse(n.forward()).alias("b")).toPandas()
    np.testing.assert_allclose(np.array(out["z"].tolist()), [[-1, -1], [1, 1], [-0.5, 0]])
    np.testing.assert_allclose(np.array(out["b"].tolist()), [[0, 1], [4, 3], [1, 2]])
    flat = exprs.Normalizer.of([1, 0], [1, 1])
    assert df.select(F.get(flat.forward(), F.lit(0)).alias("v")).head()["v"] is None


def test_feature_map_and_kernel_goldens(spark):
    np.random.seed(42)
    g, x = np.random.uniform(-1, 1, 30).reshape(15, 2), np.random.uniform(-1, 1, 30).reshape(15, 2)
    w = np.random.multivariate_normal(np.zeros(2), np.eye(2), 4)
    fm = FeatureMap("multivariate_normal", np.ones((1, 4)), 2, 4, np.ones(2), 1.0)
    fm.matrix = w
    model = kernel.KernelActiveSubspaces(dim=1, feature_map=fm, n_features=4).fit(from_arrays(spark, x, g=g))
    np.testing.assert_array_almost_equal(model.evals[:, 0], [0.42588097, 0.19198234, 0.08228976, 0.0068496])
    assert model.transform(from_arrays(spark, x)).select(F.size("active")).head()[0] == 1
    with pytest.raises(NotImplementedError):
        model.inverse_transform()
    with pytest.raises(ValueError):
        kernel.KernelActiveSubspaces(dim=1, n_boot=51).fit(from_arrays(spark, x, g=g))
    eps = 1e-6
    for k in range(2):
        step = np.eye(2)[k] * eps
        np.testing.assert_allclose((fm.features(x + step) - fm.features(x - step)) / (2 * eps), fm.jacobian(x)[:, :, k], atol=1e-8)


def test_distributions_and_tuning():
    for name in DISTRIBUTIONS:
        assert distribution(name)(np.random.RandomState(0), 2, 3, np.array([1.0, 2.0])).shape == (3, 2)
    with pytest.raises(NameError):
        distribution("none")
    with pytest.raises(TypeError):
        FeatureMap(3, np.ones(1), 2, 3, np.ones(1))
    for method, bounds in (("grid", [slice(-2, 1, 0.5)]), ("annealing", [(-2, 1)]), ("bayes", [(-2, 1)])):
        fm = FeatureMap("laplace", np.ones(1), 2, 3, np.ones(1))
        score, params, matrix = fm.tune(lambda m, p: (np.log10(p[0]) + 0.5) ** 2, bounds, method, maxiter=15)
        assert score < 0.05 and matrix is fm.matrix
    assert anneal(lambda h: float(((h - 0.3) ** 2).sum()), [(-1, 1), (-1, 1)], 200, 1)[0] < 0.05


def test_cross_validation(spark, line):
    mean, std = crossval.CrossValidation(line, ActiveSubspaces(dim=1, n_boot=None), 3).run()
    assert mean < 0.05 and std < 0.05
    with pytest.raises(ValueError):
        crossval.CrossValidation(None, None)
    folds = list(crossval.mirrored_folds(10, 3, np.random.RandomState(0)))
    assert sorted(np.concatenate([v for _, v in folds])) == list(range(10)) and (folds[0][0] == -folds[0][1] - 1).all()


def test_metrics(spark):
    np.random.seed(42)
    p, t = np.random.uniform(-1, 1, 5), np.random.uniform(-1, 1, 5)
    assert metrics.rrmse_np(p, t) == pytest.approx(1.5298111757191089)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(p, t)], "p double, t double")
    assert metrics.rrmse(df, "p", "t") == pytest.approx(1.5298111757191089)
    p, t = p.reshape(5, 1) @ np.ones((1, 2)), np.column_stack([t, t**2])
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(p, t)], "p array<double>, t array<double>")
    assert metrics.rrmse(df, "p", "t") == pytest.approx(metrics.rrmse_np(p, t))
    with pytest.raises(ValueError):
        metrics.rrmse_np(np.ones(3), np.ones(4))


def test_gaussian_processes():
    rng = np.random.default_rng(5)
    x = rng.uniform(-1, 1, (40, 1))
    y = np.sin(3 * x)
    gp = GP(restarts=1).fit(x, y)
    assert clipped_r2(y, gp.predict(x)) > 0.99
    eps = 1e-5
    slope = (gp.predict(x + eps) - gp.predict(x - eps)) / (2 * eps)
    np.testing.assert_allclose(gp.gradient(x)[:, 0, 0], slope[:, 0], atol=1e-4)
    assert clipped_r2(y, FixedGP(1e-6).fit(x, y).predict(x)) > 0.999


def test_clusters(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(-1, 1, (200, 2))
    right = x[:, 0] > 0
    f = np.where(right, x[:, 0] ** 2 + 2 * x[:, 1], 3 * x[:, 0])
    g = np.where(right[:, None], np.column_stack([2 * x[:, 0], np.full(200, 2.0)]), np.tile([3.0, 0.0], (200, 1)))
    df = from_arrays(spark, x, f, g).persist()
    config = local.ClusterConfig(2, surface_rows=60, restarts=0)
    for kind in (local.KMeansAS, local.KMedoidsAS):
        model = kind(config).fit(df)
        assert set(model.models) == {0, 1} and model.compute_scores(df).count() == 1
    d = local.group_normalize(df.withColumn("label", (F.get("x", F.lit(0)) > 0).cast("int")), "gaussian")
    c = d.groupBy("label").agg(F.var_samp(F.get("x", F.lit(0))).alias("v"), F.covar_samp(F.get("x", F.lit(0)), F.get("x", F.lit(1))).alias("c")).collect()
    assert all(abs(r["v"] - 1) < 1e-9 and abs(r["c"]) < 1e-9 for r in c)
    with pytest.raises(ValueError):
        local.group_normalize(df, "other")
    with pytest.raises(TypeError):
        local.KMeansAS(config).fit(df.drop("f"))
    medoids = local.k_medoids(np.array([[0.0], [0.1], [5.0], [5.1], [5.2]]), 2)
    assert sorted(m > 1 for m in medoids) == [False, True]


def test_tree(spark):
    rng = np.random.default_rng(7)
    x = rng.uniform(0, 1, (150, 2))
    df = from_arrays(spark, x, x[:, 0] ** 4 - x[:, 1] ** 4, np.column_stack([4 * x[:, 0] ** 3, -4 * x[:, 1] ** 3])).persist()
    base = {"max_clusters": 5, "max_children": 3, "min_children": 2, "max_red_dim": 2, "score_tol": 0.98, "min_local": 8, "dim_cut": 0.95, "dim_criterion": "cum", "normalization": "uniform", "metric": "as", "refinement": "mean", "node_rows": 30, "restarts": 0}
    for change in ({}, {"metric": "kmeans", "refinement": "global"}, {"normalization": "gaussian", "refinement": "force", "metric": "C1"}):
        t = tree.HierarchicalAS().fit(df, base | change)
        leaves = t.leaves()
        assert 1 <= len(leaves) <= 5 and [n.label for n in leaves] == list(range(len(leaves)))
        assert sum(len(n.x) for n in leaves) == len(t.root.x)
    assert 0 <= t.compute_scores(df) <= 1
    assert t.predict(df).filter("label is null").isEmpty() and t.nodes(spark).count() >= len(leaves)
    with pytest.raises(KeyError):
        tree.TreeConfig.of({"max_clusters": 2})
    with pytest.raises(tree.MaximumDimensionReached):
        for _ in range(20):
            t.refine_one_step()


def test_classification(spark):
    rng = np.random.default_rng(8)
    a = np.column_stack([rng.uniform(-1, -0.2, 30), rng.uniform(-1, 1, 30)])
    b = np.column_stack([rng.uniform(0.2, 1, 30), rng.uniform(-1, 1, 30)])
    g = np.vstack([np.tile([1.0, 0.0], (30, 1)), rng.normal(size=(30, 2))])
    df = from_arrays(spark, np.vstack([a, b]), np.zeros(60), g)
    n, rows = classify.ClassifyAS(n_neighbours=5, threshold=0.99, subset=3).fit(df)
    got = {r["row_id"]: r["as_dim"] for r in rows.collect()}
    assert n >= 2 and all(got[i] == 1 for i in range(30)) and sum(got[i] == 2 for i in range(30, 60)) > 20
    with pytest.raises(AssertionError):
        classify.local_dims(df, 2, subset=3)
    with pytest.raises(ValueError):
        classify.local_dims(df, 5, criterion="max")


def test_level_sets(spark, tmp_path):
    rng = np.random.default_rng(9)
    x = rng.uniform(0, 1, (40, 2))
    g = np.column_stack([3 * x[:, 0] ** 2 + 0.2, 3 * x[:, 1] ** 2 + 0.6])
    net = levelset.RevNet(1, 3).init(1)
    np.testing.assert_allclose(net.backward(net.forward(x)), x, atol=1e-12)
    value, grads = levelset.loss(net, x, g, 1)
    for p, d in zip(net.parameters(), grads):
        at = np.unravel_index(np.abs(d).argmax(), d.shape)
        keep, eps = p[at], 1e-6
        p[at] = keep + eps
        up = levelset.loss(net, x, g, 1, False)[0]
        p[at] = keep - eps
        down = levelset.loss(net, x, g, 1, False)[0]
        p[at] = keep
        assert (up - down) / (2 * eps) == pytest.approx(d[at], rel=1e-3, abs=1e-6)
    df = from_arrays(spark, x, x[:, 0] ** 3, g)
    model = levelset.NonlinearLevelSet(4, 1, 0.02, 60).train(df)
    assert model.history[-1][1] < model.history[0][1] and model.reconstruction < 1e-5
    model.net.save(spark, str(tmp_path / "net"))
    again = levelset.RevNet.load(spark, str(tmp_path / "net"))
    np.testing.assert_allclose(again.forward(x), model.net.forward(x))
    assert model.summary_data(df).count() == 40 and model.loss_data(spark).count() == len(model.history)
    with pytest.raises(ValueError):
        model.train_arrays(np.ones((4, 3)), np.ones((4, 3)))


def test_sources_and_streams(spark, tmp_path, line):
    with open(tmp_path / "a.npy", "wb") as f:
        np.save(f, np.ones((2, 3)))
        np.save(f, np.zeros((1, 3)))
    assert read_npy(spark, str(tmp_path / "a.npy")).count() == 3
    (tmp_path / "s.csv").write_text("i,a,b,f,ga,gb\n0,1,2,3,4,5\n1,2,3,4,5,6\n")
    r = read_samples_csv(spark, str(tmp_path / "s.csv"), range(1, 3), 3, range(4, 6)).orderBy("row_id").collect()
    assert r[0]["x"] == [1.0, 2.0] and r[1]["f"] == 4.0 and r[1]["g"] == [5.0, 6.0]
    write_matrix(spark, np.eye(2), str(tmp_path / "m"), np.array([1.0, 2.0]))
    w, b = read_matrix(spark, str(tmp_path / "m"))
    assert (w == np.eye(2)).all() and b.tolist() == [1.0, 2.0]
    model = ActiveSubspaces(dim=1, n_boot=None).fit(line)
    write_model(spark, model, str(tmp_path / "as"))
    np.testing.assert_allclose(read_model(spark, str(tmp_path / "as")).evects, model.evects)
    s = StreamingSubspace(2)
    s(line.filter("row_id < 100"), 0)
    s(line.filter("row_id >= 100"), 1)
    s(line, 1)  # came again
    np.testing.assert_allclose(s.eigenpairs()[0], model.evals)
    fd = StreamingSubspace(2, sketch_size=2)
    fd(line, 0)
    assert fd.eigenpairs()[0][0, 0] > 0


def test_closed_forms_and_chains(spark):
    from gradlens.functions import testbed
    from gradlens.operators import sampling

    x = np.random.default_rng(0).uniform(-1, 1, (20, 2))
    eps = 1e-6
    df = from_arrays(spark, x)
    for name in testbed.FUNCTIONS:
        g = np.array(testbed.evaluated(df, name).orderBy("row_id").toPandas()["g"].tolist())
        for i in range(2):
            f = [testbed.evaluated(from_arrays(spark, x + s * eps * np.eye(2)[i]), name).orderBy("row_id").toPandas()["f"].to_numpy() for s in (1, -1)]
            np.testing.assert_allclose((f[0] - f[1]) / (2 * eps), g[:, i], atol=1e-6)
    err = testbed.gradient_error(testbed.evaluated(df, "cubic").withColumn("h", F.transform("g", lambda v: v * 1.1)), "g", "h")
    assert err.relative == pytest.approx(0.1)
    out = sampling.hmc(spark, lambda v: -0.5 * float(v @ v), lambda v: -v, np.zeros((2, 2)), 800, 100, 0.3, 8).toPandas()
    draws = np.array(out["x"].tolist())
    assert len(out) == 1600 and abs(draws.mean()) < 0.15 and abs(draws.var() - 1) < 0.25


@pytest.fixture(scope="module")
def crowded(spark):
    """9 points with 400 rows each, numbered so that row_id says nothing about x."""
    rng = np.random.default_rng(11)
    points = np.array([(a, b) for a in (-1.0, 0.0, 1.0) for b in (-1.0, 0.0, 1.0)])
    x = points[rng.permutation(np.repeat(np.arange(9), 400))]
    f = x[:, 0] ** 4 - x[:, 1] ** 2 + x[:, 1] + rng.normal(0, 0.05, len(x))
    return from_arrays(spark, x, f, np.column_stack([4 * x[:, 0] ** 3, 1 - 2 * x[:, 1]])).persist()


def test_tree_statistics_are_over_all_rows(spark, crowded):
    config = {"max_clusters": 4, "max_children": 3, "min_children": 2, "max_red_dim": 1, "score_tol": 0.999, "min_local": 300, "dim_cut": 0.95, "dim_criterion": "cum", "normalization": "uniform", "metric": "as", "refinement": "force", "node_rows": 20, "restarts": 0}
    t = tree.HierarchicalAS().fit(crowded, config)
    leaves = t.leaves()
    assert len(leaves) > 1 and t.root.totals.n == 3600
    counted = {r["label"]: r["count"] for r in t.predict(crowded).groupBy("label").count().collect()}
    assert counted == {n.label: n.totals.n for n in leaves} and min(counted.values()) >= 300
    assert t.nodes(spark).filter("label is not null").agg(F.sum("n")).head()[0] == 3600
    pdf = t.predict(crowded).toPandas()
    for leaf in leaves:
        own = pdf[pdf["label"] == leaf.label]
        x, g = (np.array(own[c].tolist()) for c in ("x", "g"))
        np.testing.assert_allclose(leaf.totals.moments, g.T @ g / len(g))
        np.testing.assert_allclose((leaf.totals.lo, leaf.totals.hi, leaf.totals.mean), (x.min(0), x.max(0), x.mean(0)), atol=1e-12)
        np.testing.assert_allclose(leaf.totals.cov, np.cov(x.T), atol=1e-9)
        assert leaf.score == pytest.approx(clipped_r2(own["f"].to_numpy(), own["prediction"].to_numpy()), abs=1e-9)


def test_gaussian_process_with_repeated_points():
    rng = np.random.default_rng(12)
    x = rng.integers(0, 6, (60, 1)) / 3.0
    y = np.sin(x) + rng.normal(0, 0.1, x.shape)
    gp = GP(normalize=False, restarts=1).fit(x, y)
    var, length, noise = gp.params
    k = lambda a, b: var * np.exp(-0.5 * (a - b.T) ** 2 / length**2)
    full = k(x, x) + (noise + 1e-8) * np.eye(60)
    at = np.linspace(0, 2, 7)[:, None]
    np.testing.assert_allclose(gp.predict(at), k(at, x) @ np.linalg.solve(full, y), atol=1e-8)
    assert gp.log_likelihood == pytest.approx(-0.5 * float((y.T @ np.linalg.solve(full, y))[0, 0]) - 0.5 * np.linalg.slogdet(full)[1], abs=1e-6)
    h, eps = np.log(gp.params) + 0.3, 1e-6
    points, again = np.unique(x, return_inverse=True)
    n = np.bincount(again.ravel()).astype(float)
    means = (np.bincount(again.ravel(), y[:, 0]) / n)[:, None]
    rest = ((points[:, None] - points[None]) ** 2, means, n, float(((y - means[again.ravel()]) ** 2).sum()))
    slope = [(gp._nll(h + eps * e, *rest)[0] - gp._nll(h - eps * e, *rest)[0]) / (2 * eps) for e in np.eye(3)]
    np.testing.assert_allclose(gp._nll(h, *rest)[1], slope, rtol=1e-4, atol=1e-5)


def test_clusters_of_thousands_of_rows_a_point(spark):
    a, b = F.expr("double(id % 3 - 1)"), F.expr("double(int(id / 3) % 3 - 1)")
    df = spark.range(27000).select(F.col("id").alias("row_id"), F.array(a, b).alias("x"), (a * a * a + b).alias("f"), F.array(3 * a * a, F.lit(1.0)).alias("g")).persist()
    config = local.ClusterConfig(3, surface_rows=60, restarts=0)
    assert local._capped(df.withColumn("label", F.lit(0)), "label", 60).select("x").distinct().count() == 9
    for model in (local.KMeansAS(config), local.KMedoidsAS(config, sample_rows=300)):
        model.fit(df)
        if isinstance(model, local.KMedoidsAS):
            assert len(np.unique(model.medoids, axis=0)) == 3
        assert sum(m.n for m in model.models.values()) == 27000 and set(model.models) == {0, 1, 2}
        r = model.compute_scores(df).head()
        assert r["r2_full"] > 0.9 and r["r2_local"] > 0.5


def test_cross_validation_scores_every_row(spark):
    rng = np.random.default_rng(13)
    x = rng.uniform(-1, 1, (900, 2))
    t = x @ np.array([0.8, 0.6])
    f, g = np.sin(2 * t), 2 * np.cos(2 * t)[:, None] * np.array([0.8, 0.6])
    for target in (f, np.column_stack([f, f**2])):
        cv = crossval.CrossValidation(from_arrays(spark, x, target, g), ActiveSubspaces(dim=1, n_boot=None), 2, surface_rows=25).fit(from_arrays(spark, x, target, g))
        assert len(cv.surface.x) == 25 and cv.predict(cv.df).count() == 900
        pdf = cv.predict(cv.df).toPandas()
        assert cv.score(cv.df) == pytest.approx(metrics.rrmse_np(np.array(pdf["prediction"].tolist()), np.array(pdf["f"].tolist())))


def test_level_set_trains_on_all_rows(spark):
    rng = np.random.default_rng(14)
    x = rng.uniform(0, 1, (5200, 2))
    g = np.column_stack([3 * x[:, 0] ** 2 + 0.2, 3 * x[:, 1] ** 2 + 0.6])
    df = from_arrays(spark, x, g=g)
    all_rows = levelset.NonlinearLevelSet(2, 1, 0.02, 4).train_arrays(x, g)
    for model in (levelset.NonlinearLevelSet(2, 1, 0.02, 4).train(df), levelset.NonlinearLevelSet(2, 1, 0.02, 4).train(df, driver_rows=6000)):
        np.testing.assert_allclose(model.history, all_rows.history, rtol=1e-9)
        for p, q in zip(model.net.parameters(), all_rows.net.parameters()):
            np.testing.assert_allclose(p, q, rtol=1e-7, atol=1e-10)
        assert model.reconstruction == pytest.approx(all_rows.reconstruction, abs=1e-12)


@pytest.mark.parametrize("cells", [1, 7, 64])
def test_nearest_against_brute_force(spark, monkeypatch, cells):
    """Ties, repeated points, groups smaller than k, points far from all others, null and NaN coordinates."""
    monkeypatch.setattr(neighbors, "CELL_ROWS", 400 // cells)
    monkeypatch.setattr(neighbors, "PART_ROWS", 50)
    rng = np.random.default_rng(5)
    x = np.concatenate([np.round(rng.normal(0, 1, (250, 3)), 1), np.zeros((120, 3)), rng.uniform(50, 90, (30, 3))])
    s = [0 if i % 40 else 1 for i in range(len(x))]
    rows = [(i, [float(v) for v in p], g) for i, (p, g) in enumerate(zip(x, s))]
    df = spark.createDataFrame([*rows, (900, [1.0, float("nan"), 0.0], 0), (901, None, 0), (902, [1.0, 2.0, 3.0], None)], "row_id long, x array<double>, s long")
    ask = df.filter("row_id % 3 = 0").withColumn("x", F.transform("x", lambda v: v + 0.05))
    for same in (None, "s"):
        got = neighbors.k_nearest(ask, df, 12, same_col=same).collect()
        q = {r["row_id"]: r for r in ask.collect() if r["x"] and not any(np.isnan(r["x"])) and (not same or r["s"] is not None)}
        held = [(i, p, g) for i, p, g in [*rows, *([] if same else [(902, [1.0, 2.0, 3.0], None)])]]
        by = {}
        for r in got:
            by.setdefault(r["query_id"], []).append(r)
        assert set(by) == set(q)
        for i, r in q.items():
            want = sorted((sum((a - b) ** 2 for a, b in zip(r["x"], p)), j) for j, p, g in held if not same or g == r["s"])[:12]
            mine = sorted(by[i], key=lambda v: v["rank"])
            assert [v["rank"] for v in mine] == list(range(1, len(want) + 1))
            np.testing.assert_allclose([v["d2"] for v in mine], [w[0] for w in want], atol=1e-12)
            assert {v["neighbour_id"] for v in mine if v["d2"] < want[-1][0] - 1e-9} == {j for d, j in want if d < want[-1][0] - 1e-9}
    assert neighbors.k_nearest(ask, df.limit(0), 3).count() == neighbors.k_nearest(ask.limit(0), df, 3).count() == 0


def test_bootstrap_draws_rows_not_values(spark):
    """Two distinct gradients in 4000 rows: the ranges are those of drawing rows, and as wide as resampling makes them."""
    g = np.array([[1.0, 0.0], [0.0, 1.0]])[np.arange(4000) % 2]
    model = ActiveSubspaces(dim=1, n_boot=200).fit(from_arrays(spark, g=g))
    assert 0.49 < model.evals_br[0, 0] <= model.evals_br[0, 1] < 0.54 and 0.46 < model.evals_br[1, 0] <= model.evals_br[1, 1] < 0.51
    with pytest.raises(ValueError):
        ActiveSubspaces(dim=1).fit(from_arrays(spark, g=g).drop("row_id"))


def test_bootstrap_of_vector_outputs(spark):
    from gradlens.operators import bootstrap

    rng = np.random.default_rng(8)
    g, metric = rng.normal(size=(300, 3, 2)), np.array([[2.0, 0.3, 0], [0.3, 1, 0], [0, 0, 0.5]])
    df = from_arrays(spark, g=g)
    model = ActiveSubspaces(dim=1, n_boot=40).fit(df, metric=metric)
    ids = np.array([r["row_id"] for r in df.select("row_id").collect()])
    rows = np.array([r["g"] for r in df.select("g").collect()])
    counts = bootstrap.poisson_counts(ids, 40, 42)
    matrices = bootstrap.matrices_of(rows, np.ones(len(rows)), counts, metric) / counts.sum(1)[:, None, None]
    values, errors = bootstrap.ranges(matrices, model.evects)
    np.testing.assert_allclose(model.evals_br, values)
    np.testing.assert_allclose(model.subs_br, errors, atol=1e-7)


def quadrants(spark, n, seed, first=0):
    """Two outputs whose active directions differ from side to side."""
    rng = np.random.default_rng(seed)
    x = rng.uniform(-1, 1, (n, 2))
    side = x[:, 0] > 0
    f = np.column_stack([np.where(side, x[:, 1] ** 2, x[:, 0] ** 3), np.where(side, 3 * x[:, 1], -x[:, 0])])
    rows = [(first + i, [float(v) for v in p], [float(v) for v in y]) for i, (p, y) in enumerate(zip(x, f))]
    return spark.createDataFrame(rows, "row_id long, x array<double>, f array<double>"), x, f


def test_tree_scores_by_output_and_nearest_row(spark):
    train, x, f = quadrants(spark, 240, 1)
    slope = np.where(x[:, :1] > 0, np.column_stack([0 * x[:, 0], 2 * x[:, 1] + 3]), np.column_stack([3 * x[:, 0] ** 2 - 1, 0 * x[:, 0]]))
    df = train.join(spark.createDataFrame([(i, [float(v) for v in g]) for i, g in enumerate(slope)], "row_id long, g array<double>"), "row_id")
    config = {"max_clusters": 4, "max_children": 2, "min_children": 2, "max_red_dim": 1, "score_tol": 0.999, "min_local": 8, "dim_cut": 0.95, "dim_criterion": "cum", "normalization": "uniform", "metric": "C1", "refinement": "force", "restarts": 0}
    t = tree.HierarchicalAS().fit(df, config)
    assert len(t.leaves()) > 1
    test, u, truth = quadrants(spark, 60, 2, 1000)
    out = {r["row_id"]: r for r in t.predict(test).collect()}
    label, value = t.leaf_of(u)
    np.testing.assert_allclose([out[1000 + i]["predictions"] for i in range(60)], value)
    want = np.mean([np.clip(1 - ((truth[:, j] - value[:, j]) ** 2).sum() / ((truth[:, j] - truth[:, j].mean()) ** 2).sum(), 0, 1) for j in range(2)])
    assert t.compute_scores(test) == pytest.approx(want)
    assert t.compute_scores(test, lambda f, p: F.avg(F.abs(f - p))) == pytest.approx(np.abs(truth - value).mean(0).mean())
    # The leaf of the nearest training row.
    own = t.leaf_of(x)[0][((u[:, None] - x[None]) ** 2).sum(2).argmin(1)]
    near = {r["row_id"]: r for r in t.predict_by_nearest(test, df).collect()}
    assert [near[1000 + i]["label"] for i in range(60)] == own.tolist()
    leaves = {leaf.label: leaf for leaf in t.leaves()}
    np.testing.assert_allclose([near[1000 + i]["predictions"] for i in range(60)], [leaves[k].predict(u[i : i + 1])[0] for i, k in enumerate(own)])
    assert 0 <= t.compute_scores(test, nearest_to=df) <= 1


def test_true_classes_and_log(spark, tmp_path):
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    rows = [(i, [float(i % 20) / 10 - 1, 0.1 * (i % 7)], int(i % 20 > 9), int(i % 20 > 9) if i % 10 else 0) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, x array<double>, label int, truth int")
    accuracy, mesh, right = classify.decision_boundaries(df, step=0.5, classifier=MultilayerPerceptronClassifier(layers=[2, 4, 2], maxIter=80, seed=1), truth_col="truth")
    assert accuracy > 0.95 and mesh.count() > 0 and right == pytest.approx(0.95, abs=0.03)
    x = np.random.default_rng(0).uniform(-1, 1, (40, 2))
    data = from_arrays(spark, x, x[:, 0] ** 2, np.column_stack([2 * x[:, 0], 0 * x[:, 0]]))
    from gradlens.operators.features import FeatureMap

    fm = FeatureMap("laplace", np.array([0.1]), 2, 4, np.zeros(1), 1.0)
    cv = crossval.CrossValidation(data, kernel.KernelActiveSubspaces(dim=1, feature_map=fm, n_features=4), folds=2)
    crossval.average_rrmse(np.zeros(1), cv, [10.0, None], resample=2, give_up=100, log_path=str(tmp_path / "log.csv"))
    lines = (tmp_path / "log.csv").read_text().splitlines()
    assert len(lines) == 2 and all(len(line.split(",")) == 3 for line in lines)
