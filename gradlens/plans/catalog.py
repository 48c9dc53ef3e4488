"""Queries over the benchmark tables by name, and the SQL that gives the same rows.

The model problem: an order line's charge = price (1 - discount) (1 + tax), in units of 10,000, as a function of the
parameters discount and tax, normalised to [-1, 1]; its gradient is known in closed form.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradlens.functions import exprs, metrics, plots, testbed
from gradlens.functions.linalg import linear_program, residual_energy_index, spectral_gap_dim
from gradlens.operators import classify, crossval, kernel, levelset, local, moments, neighbors, sampling, tree
from gradlens.operators.active import ActiveSubspaces
from gradlens.operators.bootstrap import POISSON, bootstrap
from gradlens.operators.features import DISTRIBUTIONS, FeatureMap, distribution

UNIT = 10_000.0
#: Fixed feature matrix and bias of the random-feature queries.
W = np.array([[0.6, -0.4], [1.1, 0.3], [-0.2, 0.9]])
BIAS = np.array([0.13, 0.77, 1.3])
METRIC = np.array([[2.0, 0.5], [0.5, 1.0]])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate").alias("line"), (F.col("l_extendedprice") / UNIT).alias("price"), F.array("l_discount", "l_tax").alias("raw"))


def _normalizer(spark: SparkSession, sf_dir: str) -> exprs.Normalizer:
    return exprs.Normalizer.fit(_raw(spark, sf_dir), "raw")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, l_linenumber, l_returnflag, l_quantity, x, f, g (with respect to the normalised parameters)."""
    n = _normalizer(spark, sf_dir)
    raw = _raw(spark, sf_dir)
    d, t = F.get("raw", F.lit(0)), F.get("raw", F.lit(1))
    g = F.array(-F.col("price") * (1 + t), F.col("price") * (1 - d))
    return raw.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "line", n.forward("raw").alias("x"), (F.col("price") * (1 - d) * (1 + t)).alias("f"), n.gradient(g).alias("g"))


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With row_id: order and line numbers alone are not unique in the benchmark tables."""
    return samples(spark, sf_dir).withColumnRenamed("line", "row_id")


CTE = """
WITH b AS (SELECT min(l_discount) d0, max(l_discount) d1, min(l_tax) t0, max(l_tax) t1 FROM lineitem),
s AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, l_discount, l_tax,
        2 * (l_discount - d0) / (d1 - d0) - 1 AS x0, 2 * (l_tax - t0) / (t1 - t0) - 1 AS x1,
        l_extendedprice / 10000 AS price,
        (l_extendedprice / 10000) * (1 - l_discount) * (1 + l_tax) AS f,
        -(l_extendedprice / 10000) * (1 + l_tax) * (d1 - d0) / 2 AS g0,
        (l_extendedprice / 10000) * (1 - l_discount) * (t1 - t0) / 2 AS g1 FROM lineitem, b)
"""
#: Closed form of the 2 x 2 symmetric eigenproblem with first components made non-negative.
EIG = (
    CTE
    + """, c AS (SELECT avg(g0 * g0) a, avg(g0 * g1) b, avg(g1 * g1) d FROM s),
h AS (SELECT a, b, d, (a + d) / 2 AS m, sqrt(((a - d) / 2) * ((a - d) / 2) + b * b) AS q FROM c),
l AS (SELECT a, b, d, m + q AS l1, m - q AS l2 FROM h),
v AS (SELECT l1, l2, abs(b) / sqrt(b * b + (l1 - a) * (l1 - a)) AS u0,
        sign(b) * (l1 - a) / sqrt(b * b + (l1 - a) * (l1 - a)) AS u1 FROM l),
e AS (SELECT l1, l2, u0, u1, CASE WHEN u1 > 0 THEN u1 ELSE -u1 END AS w0, CASE WHEN u1 > 0 THEN -u0 ELSE u0 END AS w1 FROM v)
"""
)


def _fit(spark: SparkSession, sf_dir: str, dim: int = 1) -> ActiveSubspaces:
    return ActiveSubspaces(dim=dim, n_boot=None).fit(samples(spark, sf_dir))


def normalize_lineitem(spark, sf_dir):
    n = _normalizer(spark, sf_dir)
    x = n.forward("raw")
    return _raw(spark, sf_dir).select("l_orderkey", "l_linenumber", _r(F.get(x, F.lit(0))).alias("x0"), _r(F.get(x, F.lit(1))).alias("x1"))


def denormalize_roundtrip(spark, sf_dir):
    n = _normalizer(spark, sf_dir)
    back = _raw(spark, sf_dir).withColumn("x", n.forward("raw")).withColumn("again", n.inverse("x"))
    off = lambda i: F.max(F.abs(F.get("again", F.lit(i)) - F.get("raw", F.lit(i))))
    return back.agg(_r(off(0), 9).alias("discount_off"), _r(off(1), 9).alias("tax_off"), F.count("*").alias("n"))


def _matrix(spark, c: np.ndarray) -> DataFrame:
    df = spark.createDataFrame([(float(c[0, 0]), float(c[0, 1]), float(c[1, 1]))], "c00 double, c01 double, c11 double")
    return df.select(*[_r(k).alias(k) for k in df.columns])


def moment_matrix(spark, sf_dir):
    return _matrix(spark, moments.moment_matrix(samples(spark, sf_dir)))


def weighted_moment_matrix(spark, sf_dir):
    df = samples(spark, sf_dir)
    total = df.agg(F.sum("l_quantity")).head()[0]
    return _matrix(spark, moments.moment_matrix(df.withColumn("w", F.col("l_quantity") / total), "g", "w"))


def vector_moment_metric(spark, sf_dir):
    """Outputs: charge and net price (without tax)."""
    n = _normalizer(spark, sf_dir)
    net = n.gradient(F.array(-F.col("price"), F.lit(0.0)))
    raw = _raw(spark, sf_dir)
    d, t = F.get("raw", F.lit(0)), F.get("raw", F.lit(1))
    charge = n.gradient(F.array(-F.col("price") * (1 + t), F.col("price") * (1 - d)))
    return _matrix(spark, moments.moment_matrix(raw.select(F.array(charge, net).alias("g")), "g", metric=METRIC))


def as2d_eigenpairs(spark, sf_dir):
    return _fit(spark, sf_dir).spectrum(spark).select("idx", _r("eval").alias("eval"), _r(F.get("evect", F.lit(0))).alias("e0"), _r(F.get("evect", F.lit(1))).alias("e1"))


def activity_scores(spark, sf_dir):
    scores = _fit(spark, sf_dir, 2).activity_scores
    df = spark.createDataFrame([(n, float(v)) for n, v in zip(("l_discount", "l_tax"), scores)], "param string, score double")
    return df.select("param", _r("score").alias("score"))


def dimension_choice(spark, sf_dir):
    evals = _fit(spark, sf_dir, 2).evals
    return spark.createDataFrame([(spectral_gap_dim(evals), residual_energy_index(evals))], "gap_dim int, residual_index int")


def as2d_transform(spark, sf_dir):
    out = _fit(spark, sf_dir).transform(samples(spark, sf_dir))
    return out.select("l_orderkey", "l_linenumber", _r(F.get("active", F.lit(0))).alias("active"), _r(F.get("inactive", F.lit(0))).alias("inactive"))


def reconstruct(spark, sf_dir):
    model = _fit(spark, sf_dir)
    out = model.transform(samples(spark, sf_dir)).withColumn("y", F.concat("active", "inactive")).withColumn("back", exprs.project("y", model.evects.T))
    return out.agg(_r(F.max(F.sqrt(exprs.squared_distance("x", "back"))), 9).alias("worst"), F.count("*").alias("n"))


def sufficient_summary(spark, sf_dir):
    out = plots.summary_data(_fit(spark, sf_dir), samples(spark, sf_dir))
    return out.groupBy(F.round("y0", 1).alias("y0")).agg(F.count("*").alias("n"), _r(F.avg("f")).alias("f")).withColumn("y0", F.col("y0") + 0.0)


def eigenvalue_plot(spark, sf_dir):
    return plots.eigenvalue_data(_fit(spark, sf_dir), spark).select("idx", _r("eval").alias("eval"))


def eigenvector_plot(spark, sf_dir):
    return plots.eigenvector_data(_fit(spark, sf_dir), spark, 2, ["l_discount", "l_tax"]).select("evect", "param", _r("component").alias("component"))


def local_as_by_flag(spark, sf_dir):
    rows = moments.grouped_moments(samples(spark, sf_dir), "l_returnflag", "g", 2)
    a, b, d = F.col("c_0_0"), F.col("c_0_1"), F.col("c_1_1")
    m, q = (a + d) / 2, F.sqrt(((a - d) / 2) * ((a - d) / 2) + b * b)
    return rows.select("l_returnflag", "n", _r(m + q).alias("lambda1"), _r(m - q).alias("lambda2"), _r((m + q) / (a + d)).alias("share"))


def uniform_normalize_by_group(spark, sf_dir):
    out = local.group_normalize(samples(spark, sf_dir), "uniform", "l_returnflag")
    return _group_summary(out)


def gaussian_normalize_by_group(spark, sf_dir):
    return _group_summary(local.group_normalize(samples(spark, sf_dir), "gaussian", "l_returnflag"))


def _group_summary(out: DataFrame) -> DataFrame:
    x = lambda i: F.get("x", F.lit(i))
    g = lambda i: F.get("g", F.lit(i))
    return out.groupBy("l_returnflag").agg(_r(F.avg(x(0) * x(0)), 5).alias("xx"), _r(F.avg(x(0) * x(1)), 5).alias("xy"), _r(F.avg(g(0) * g(0)), 5).alias("gg"), _r(F.avg(g(0) * g(1)), 5).alias("gh"))


def regression_scores(spark, sf_dir):
    df = samples(spark, sf_dir).withColumn("p", F.col("f") * 0.9 + 0.1 * F.get("x", F.lit(0))).withColumn("q", F.col("f") * 0.8)
    return metrics.scores(df, "p", "q", "f").select(*[_r(c).alias(c) for c in ("r2_full", "r2_local", "mae_full", "mae_local")])


def rrmse(spark, sf_dir):
    df = samples(spark, sf_dir).withColumn("p", F.col("f") * 0.9)
    return spark.createDataFrame([(round(metrics.rrmse(df, "p", "f"), 6),)], "rrmse double")


def _suppliers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_id"), F.array(F.col("s_acctbal") / 1000, F.col("s_nationkey").cast("double")).alias("x"), F.col("s_nationkey").cast("long").alias("label"), (2 * F.col("s_acctbal") / 1000 - F.col("s_nationkey")).alias("f"))


def _customers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), F.array(F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double")).alias("x"), (F.col("c_acctbal") * F.col("c_acctbal") / 1e6 + 3 * F.col("c_nationkey")).alias("f"))


def knn_topk(spark, sf_dir):
    near = neighbors.k_nearest(_suppliers(spark, sf_dir), _customers(spark, sf_dir), 3)
    return near.select("query_id", "neighbour_id", F.col("rank").cast("long").alias("rank"), _r("d2").alias("d2"))


def as_metric_knn(spark, sf_dir):
    """Distances along fixed directions, each scaled by its weight."""
    v, w = np.array([[0.6, -0.8], [0.8, 0.6]]), np.array([0.9, 0.1])
    mapped = lambda df: df.withColumn("x", neighbors.subspace_metric("x", v, w))
    near = neighbors.k_nearest(mapped(_suppliers(spark, sf_dir)), mapped(_customers(spark, sf_dir)), 2)
    return near.select("query_id", F.col("rank").cast("long").alias("rank"), _r("d2").alias("d2"))


def min_dist_assign(spark, sf_dir):
    out = neighbors.nearest_label(_customers(spark, sf_dir), _suppliers(spark, sf_dir))
    return out.groupBy("label").agg(F.count("*").alias("n"))


def local_planes_2d(spark, sf_dir):
    flat = lambda df: df.withColumn("x", F.array(F.get("x", F.lit(0)), F.get("x", F.lit(1)) / 25))
    out = neighbors.planes_by_moments(flat(_suppliers(spark, sf_dir)), flat(_customers(spark, sf_dir)), 12)
    return out.select("query_id", _r(F.get("g", F.lit(0)), 4).alias("g0"), _r(F.get("g", F.lit(1)), 4).alias("g1"))


def rff_map(spark, sf_dir):
    phi = exprs.rff_map("x", W, BIAS, 0.9)
    return samples(spark, sf_dir).withColumn("phi", phi).select("l_orderkey", "l_linenumber", *[_r(F.get("phi", F.lit(k))).alias(f"phi{k}") for k in range(3)])


def rff_jacobian(spark, sf_dir):
    j = samples(spark, sf_dir).withColumn("j", exprs.rff_jacobian("x", W, BIAS, 0.9))
    return j.select("l_orderkey", "l_linenumber", *[_r(F.get(F.get("j", F.lit(k)), F.lit(i))).alias(f"j{k}{i}") for k in range(3) for i in range(2)])


def kernel_moments_d2(spark, sf_dir):
    """Moments of pseudo-gradients for two features of two parameters, where they are a plain inverse."""
    fm = FeatureMap("normal", BIAS[:2], 2, 2, np.ones(1), 0.9)
    fm.matrix = W[:2]
    model = kernel.KernelActiveSubspaces(dim=1, feature_map=fm, n_features=2).fit(samples(spark, sf_dir))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(model.evals[:, 0])], "idx int, eval double")
    return df.select("idx", F.round("eval", 3).alias("eval"))


def kfold_assign(spark, sf_dir):
    rows = crossval.with_folds(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 5, "o_orderkey", None)
    return rows.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def knn_graph(spark, sf_dir):
    return neighbors.neighbour_graph(_suppliers(spark, sf_dir), 3)


def graph_components(spark, sf_dir):
    rows = _suppliers(spark, sf_dir)
    return neighbors.components(neighbors.neighbour_graph(rows, 3), rows.select(F.col("row_id").alias("node")))


def graph_components_by_dim(spark, sf_dir):
    """Only rows of equal class (nation modulo 3) are neighbours."""
    rows = _suppliers(spark, sf_dir).withColumn("as_dim", F.col("label") % 3)
    return neighbors.components(neighbors.neighbour_graph(rows, 2, "as_dim"), rows.select(F.col("row_id").alias("node")))


def embeddings_gram(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.transform("embedding", lambda v: v.cast("double")).alias("g"))
    c = moments.moment_matrix(vectors)
    rows = [(i, j, float(c[i, j])) for i in range(len(c)) for j in range(len(c))]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["i", "j", "c"])).select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.round("c", 5).alias("c")).withColumn("c", F.col("c") + 0.0)


def linear_program_corner(spark, sf_dir):
    """Least 2 x0 + x1 where x0 is at least the mean discount, x1 the mean tax, and both together the largest tax plus the largest discount."""
    r = table(spark, sf_dir, "lineitem").agg(F.avg("l_discount"), F.avg("l_tax"), F.max("l_discount") + F.max("l_tax")).head()
    x = linear_program([2, 1], [[1, 0], [0, 1], [1, 1]], [float(v) for v in r])
    return spark.createDataFrame([tuple(round(float(v), 6) for v in x)], "x0 double, x1 double")


def events_running_moments(spark, sf_dir):
    """Moments of (value, hour of day) by event type from a stream over the events table, read to its end."""
    from gradlens.streaming import running_moments

    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(_stream_path(spark, sf_dir, "events"))
    g = stream.filter("value is not null").select(F.array(F.col("value") / 100, F.hour("ts") / 24.0).alias("g"))
    name = f"running_{abs(hash(sf_dir)) % 10**8}"
    q = running_moments(g, 2).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select("n", _r("c_0_0").alias("c00"), _r("c_0_1").alias("c01"), _r("c_1_1").alias("c11"))


def _stream_path(spark, sf_dir: str, name: str) -> str:
    """A file stream takes a folder or a glob: a table that is one file is read by a glob that only it matches."""
    return f"{sf_dir}/{name}.parque[t]"


def _by_function(spark, sf_dir, name: str) -> DataFrame:
    """Moments of a closed-form function over the normalised parameters."""
    df = testbed.evaluated(samples(spark, sf_dir), name)
    g = lambda i: F.get("g", F.lit(i))
    return df.agg(F.lit(name).alias("name"), _r(F.avg("f")).alias("f"), _r(F.avg(g(0) * g(0))).alias("c00"), _r(F.avg(g(0) * g(1))).alias("c01"), _r(F.avg(g(1) * g(1))).alias("c11"))


def closed_form_functions(spark, sf_dir):
    out = None
    for name in testbed.FUNCTIONS:
        one = _by_function(spark, sf_dir, name)
        out = one if out is None else out.unionByName(one)
    return out


#: name -> f, g0, g1 in SQL.
FORMULAS = {
    "wave": ("0.5 * sin(2 * pi() * (x0 + x1)) + 1", "pi() * cos(2 * pi() * (x0 + x1))", "pi() * cos(2 * pi() * (x0 + x1))"),
    "bump": ("exp(-(x0 - 0.5) * (x0 - 0.5) - x1 * x1)", "-2 * (x0 - 0.5) * exp(-(x0 - 0.5) * (x0 - 0.5) - x1 * x1)", "-2 * x1 * exp(-(x0 - 0.5) * (x0 - 0.5) - x1 * x1)"),
    "cubic": ("x0 ** 3 + x1 ** 3 + 0.2 * x0 + 0.6 * x1", "3 * x0 * x0 + 0.2", "3 * x1 * x1 + 0.6"),
    "radial": ("cos(x0 * x0 + x1 * x1)", "-2 * x0 * sin(x0 * x0 + x1 * x1)", "-2 * x1 * sin(x0 * x0 + x1 * x1)"),
    "quartic": ("x0 ** 4 - x1 ** 4", "4 * x0 ** 3", "-4 * x1 ** 3"),
    "paraboloid": ("x0 ** 4 + x1 ** 4", "4 * x0 ** 3", "4 * x1 ** 3"),
}


def quadratic_moments(spark, sf_dir):
    """Mean and variance of chains that sample a normal density with the moment matrix as precision."""
    c = moments.moment_matrix(samples(spark, sf_dir)) / 50 + 0.5 * np.eye(2)
    draws = sampling.hmc(spark, lambda x: -0.5 * float(x @ c @ x), lambda x: -c @ x, np.zeros((4, 2)), 300, 100, 0.2, 12)
    return draws.groupBy("chain").agg(F.count("*").alias("n"), F.avg(F.get("x", F.lit(0))).alias("mean0"), F.max("accepted").alias("accepted"))


# Without SQL: random draws, iterative fits and models. Tests hold them against invariants.


def frequent_directions(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.transform("embedding", lambda v: v.cast("double")).alias("g"))
    evals, _ = moments.sketch(vectors, 16).eigenpairs()
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(evals[:, 0])], "idx int, eval double")


def randomized_spectrum(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.transform("embedding", lambda v: v.cast("double")).alias("g"))
    evals, _ = moments.eigenpairs(vectors, randomized_dim=8)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(evals[:, 0])], "idx int, eval double")


def bootstrap_ranges(spark, sf_dir):
    df = keyed(spark, sf_dir)
    _, evects = moments.eigenpairs(df)
    br, _ = bootstrap(df, evects, replicas=50, id_col="row_id")
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(br)], "idx int, lo double, hi double")


def bootstrap_by_customer(spark, sf_dir):
    """Ranges over 20 replicas; a customer's number decides how often it is drawn in each."""
    df = _customer_problem(spark, sf_dir)
    _, evects = moments.eigenpairs(df)
    br, _ = bootstrap(df, evects, replicas=20)
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(br)], "idx int, lo double, hi double")
    return rows.select("idx", _r("lo").alias("lo"), _r("hi").alias("hi"))


def _bootstrap_sql() -> str:
    """Counts by 64-bit mixing and the inverse Poisson distribution, then closed-form eigenvalues."""
    times = lambda x, factor: f"((({x})::UHUGEINT * {factor}::UHUGEINT) % {2**64}::UHUGEINT)::UBIGINT"
    mixed = lambda x, shift: f"xor({x}, {x} >> {shift})"
    drawn = " + ".join(f"(u >= {float(c)!r})::INT" for c in POISSON)
    return f"""
WITH b AS (SELECT min(c_acctbal) a0, max(c_acctbal) a1, min(c_nationkey) n0, max(c_nationkey) n1 FROM customer),
p AS (SELECT c_custkey AS k, 2 * (c_acctbal - a0) / (a1 - a0) - 1 AS x0, 2 * (c_nationkey - n0)::DOUBLE / (n1 - n0) - 1 AS x1 FROM customer, b),
g AS (SELECT k, 3 * x0 * x0 + 0.2 AS g0, 3 * x1 * x1 + 0.6 AS g1 FROM p),
h0 AS (SELECT r, g0, g1, ((k::UHUGEINT + r::UHUGEINT * {0x9E3779B97F4A7C15}::UHUGEINT + {42 * 0xD1342543DE82EF95 % 2**64}::UHUGEINT) % {2**64}::UHUGEINT)::UBIGINT AS x FROM g, range(1, 21) t(r)),
h1 AS (SELECT r, g0, g1, {times(mixed("x", 30), 0xBF58476D1CE4E5B9)} AS x FROM h0),
h2 AS (SELECT r, g0, g1, {times(mixed("x", 27), 0x94D049BB133111EB)} AS x FROM h1),
h3 AS (SELECT r, g0, g1, {mixed("x", 31)} AS x FROM h2),
u AS (SELECT r, g0, g1, (x >> 11)::DOUBLE / {2**53}::DOUBLE AS u FROM h3),
n AS (SELECT r, g0, g1, {drawn} AS n FROM u),
c AS (SELECT r, sum(n * g0 * g0) / sum(n) a, sum(n * g0 * g1) / sum(n) b, sum(n * g1 * g1) / sum(n) d FROM n GROUP BY r),
l AS (SELECT r, (a + d) / 2 AS m, sqrt(((a - d) / 2) * ((a - d) / 2) + b * b) AS q FROM c)
SELECT 0 AS idx, round(min(m + q), 6) AS lo, round(max(m + q), 6) AS hi FROM l UNION ALL SELECT 1, round(min(m - q), 6), round(max(m - q), 6) FROM l
"""


def _classes_sql(k: int = 6, threshold: float = 0.99) -> str:
    """Dimension of each supplier from all triples of its k nearest, then components of the graph among equal dimensions."""
    far = "(a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1)"
    return f"""
WITH RECURSIVE p AS (SELECT s_suppkey AS id, s_acctbal / 10000 AS x0, s_nationkey::DOUBLE / 25 AS x1 FROM supplier),
g AS (SELECT *, 4 * x0 * x0 * x0 AS g0, -4 * x1 * x1 * x1 AS g1 FROM p),
near AS (SELECT id, g0, g1, k FROM (SELECT a.id, b.g0, b.g1, row_number() OVER (PARTITION BY a.id ORDER BY {far}, b.id) AS k FROM p a, g b) WHERE k <= {k}),
triple AS (
  SELECT x.id, x.g0 * x.g0 + y.g0 * y.g0 + z.g0 * z.g0 AS a, x.g0 * x.g1 + y.g0 * y.g1 + z.g0 * z.g1 AS b, x.g1 * x.g1 + y.g1 * y.g1 + z.g1 * z.g1 AS d
  FROM near x JOIN near y ON x.id = y.id AND x.k < y.k JOIN near z ON z.id = y.id AND y.k < z.k),
dims AS (SELECT id, min(CASE WHEN (a + d) / 2 + sqrt(((a - d) / 2) * ((a - d) / 2) + b * b) > {threshold} * (a + d) THEN 1 ELSE 2 END) AS as_dim FROM triple GROUP BY 1),
e AS (
  SELECT src, dst FROM (SELECT a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.id ORDER BY {far}, b.id) AS k
    FROM p a JOIN dims s ON s.id = a.id, p b JOIN dims t ON t.id = b.id WHERE s.as_dim = t.as_dim) WHERE k <= {k}),
way AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
w AS (SELECT id AS node, id AS seen FROM p UNION SELECT w.node, way.dst FROM w JOIN way ON way.src = w.seen),
l AS (SELECT node, min(seen) AS m FROM w GROUP BY 1)
SELECT node AS row_id, as_dim::INT AS as_dim, (dense_rank() OVER (ORDER BY m) - 1)::INT AS label FROM l JOIN dims ON dims.id = node
"""


def _customer_problem(spark, sf_dir) -> DataFrame:
    """All customers: balance and nation as normalised parameters of the cubic function, with its gradient."""
    rows = _customers(spark, sf_dir).select("row_id", "x")
    n = exprs.Normalizer.fit(rows)
    return testbed.evaluated(rows.withColumn("x", n.forward("x")), "cubic")


def inverse_map(spark, sf_dir):
    model = _fit(spark, sf_dir)
    return model.inverse_transform(model.transform(keyed(spark, sf_dir)), 4)


def optimal_profile(spark, sf_dir):
    """Mean charge factor over points that share an active coordinate."""
    model = _fit(spark, sf_dir)
    n = _normalizer(spark, sf_dir)

    def factor(x: np.ndarray) -> np.ndarray:
        raw = n.inverse_np(x)
        return (1 - raw[:, 0]) * (1 + raw[:, 1])

    return model.inverse_mean(model.transform(keyed(spark, sf_dir)), factor, 20).withColumnRenamed("mean", "profile")


def local_gradients(spark, sf_dir):
    return ActiveSubspaces(dim=1, method="local", n_boot=None).fit(_customers(spark, sf_dir)).spectrum(spark)


def kmeans_as(spark, sf_dir):
    rows = keyed(spark, sf_dir)
    return local.KMeansAS(local.ClusterConfig(3, restarts=0)).fit(rows).compute_scores(rows)


def kmedoids_as(spark, sf_dir):
    rows = keyed(spark, sf_dir)
    return local.KMedoidsAS(local.ClusterConfig(3, restarts=0)).fit(rows).compute_scores(rows)


TREE = {"max_clusters": 4, "max_children": 3, "min_children": 2, "max_red_dim": 1, "score_tol": 0.95, "min_local": 4, "dim_cut": 0.95, "dim_criterion": "cum", "normalization": "uniform", "metric": "as", "refinement": "mean", "restarts": 0}


def hierarchical_as(spark, sf_dir):
    return tree.HierarchicalAS().fit(keyed(spark, sf_dir), TREE).nodes(spark)


def hierarchical_predict(spark, sf_dir):
    rows = keyed(spark, sf_dir)
    out = tree.HierarchicalAS().fit(rows, TREE).predict(rows)
    return out.groupBy("label").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("prediction") - F.col("f"))).alias("mae"))


def classify_by_dim(spark, sf_dir):
    rows = testbed.evaluated(_suppliers(spark, sf_dir).select("row_id", F.array(F.get("x", F.lit(0)) / 10, F.get("x", F.lit(1)) / 25).alias("x")), "quartic")
    return classify.ClassifyAS(n_neighbours=6, threshold=0.99, subset=3).fit(rows)[1].select("row_id", "as_dim", "label")


def class_boundaries(spark, sf_dir):
    rows = _customer_problem(spark, sf_dir).withColumn("label", (F.get("x", F.lit(0)) > 0).cast("int"))
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    return classify.decision_boundaries(rows, step=0.25, classifier=MultilayerPerceptronClassifier(layers=[2, 6, 2], maxIter=60, seed=1))[1]


def feature_distributions(spark, sf_dir):
    rng = np.random.RandomState(42)
    params = {"beta": [2.0, 3.0], "uniform": [-1.0, 1.0], "multivariate_normal": [1.0, 2.0]}
    rows = [(name, k, [float(v) for v in row]) for name in DISTRIBUTIONS for k, row in enumerate(distribution(name)(rng, 2, 4, np.array(params.get(name, [1.0]))))]
    return spark.createDataFrame(rows, "name string, feature_id int, w array<double>")


def tuned_features(spark, sf_dir):
    rows = _customer_problem(spark, sf_dir).persist()
    fm = FeatureMap("laplace", BIAS[:1], 2, 6, np.zeros(1), 1.0)
    cv = crossval.CrossValidation(rows, kernel.KernelActiveSubspaces(dim=1, feature_map=fm, n_features=6), folds=2)
    best = [0.8, None]
    score, params, _ = fm.tune(lambda m, p: crossval.average_rrmse(np.log10(p), cv, best, resample=1), [slice(-1.0, 1.0, 1.0)])
    rows.unpersist()
    return spark.createDataFrame([(float(score), float(params[0]))], "score double, param double")


def cross_validated_surface(spark, sf_dir):
    mean, std = crossval.CrossValidation(_customer_problem(spark, sf_dir), ActiveSubspaces(dim=1, n_boot=None), 4).run()
    return spark.createDataFrame([(mean, std)], "mean double, std double")


def level_set_loss(spark, sf_dir):
    return levelset.NonlinearLevelSet(3, 1, 0.01, 31).train(_customer_problem(spark, sf_dir)).loss_data(spark)


WITH_SQL = {
    "normalize_lineitem": (normalize_lineitem, CTE + "SELECT l_orderkey, l_linenumber, round(x0, 6) + 0.0 AS x0, round(x1, 6) + 0.0 AS x1 FROM s"),
    "denormalize_roundtrip": (denormalize_roundtrip, CTE + "SELECT round(max(abs((d1 - d0) * (x0 + 1) / 2 + d0 - l_discount)), 9) + 0.0 AS discount_off, round(max(abs((t1 - t0) * (x1 + 1) / 2 + t0 - l_tax)), 9) + 0.0 AS tax_off, count(*) AS n FROM s, b"),
    "moment_matrix": (moment_matrix, CTE + "SELECT round(avg(g0 * g0), 6) AS c00, round(avg(g0 * g1), 6) AS c01, round(avg(g1 * g1), 6) AS c11 FROM s"),
    "weighted_moment_matrix": (weighted_moment_matrix, CTE + "SELECT round(sum(l_quantity * g0 * g0) / sum(l_quantity), 6) AS c00, round(sum(l_quantity * g0 * g1) / sum(l_quantity), 6) AS c01, round(sum(l_quantity * g1 * g1) / sum(l_quantity), 6) AS c11 FROM s"),
    "vector_moment_metric": (vector_moment_metric, CTE + ", j AS (SELECT g0 AS a0, g1 AS a1, -price * (d1 - d0) / 2 AS h0 FROM s, b) SELECT round(avg(2 * a0 * a0 + a0 * h0 + h0 * h0), 6) AS c00, round(avg(2 * a0 * a1 + 0.5 * h0 * a1), 6) AS c01, round(avg(2 * a1 * a1), 6) AS c11 FROM j"),
    "as2d_eigenpairs": (as2d_eigenpairs, EIG + "SELECT 0 AS idx, round(l1, 6) AS eval, round(u0, 6) AS e0, round(u1, 6) AS e1 FROM e UNION ALL SELECT 1, round(l2, 6), round(w0, 6), round(w1, 6) FROM e"),
    "activity_scores": (activity_scores, EIG + "SELECT 'l_discount' AS param, round(l1 * u0 * u0 + l2 * w0 * w0, 6) AS score FROM e UNION ALL SELECT 'l_tax', round(l1 * u1 * u1 + l2 * w1 * w1, 6) FROM e"),
    "dimension_choice": (dimension_choice, EIG + "SELECT 1 AS gap_dim, CASE WHEN l1 * l1 / (l1 * l1 + l2 * l2) >= 0.99 THEN 0 ELSE 1 END AS residual_index FROM e"),
    "as2d_transform": (as2d_transform, EIG + "SELECT l_orderkey, l_linenumber, round(x0 * u0 + x1 * u1, 6) + 0.0 AS active, round(x0 * w0 + x1 * w1, 6) + 0.0 AS inactive FROM s, e"),
    "reconstruct": (reconstruct, "SELECT 0.0::DOUBLE AS worst, count(*) AS n FROM lineitem"),
    "sufficient_summary": (sufficient_summary, EIG + "SELECT round(x0 * u0 + x1 * u1, 1) + 0.0 AS y0, count(*) AS n, round(avg(f), 6) AS f FROM s, e GROUP BY 1"),
    "eigenvalue_plot": (eigenvalue_plot, EIG + "SELECT 1 AS idx, round(l1, 6) AS eval FROM e UNION ALL SELECT 2, round(l2, 6) FROM e"),
    "eigenvector_plot": (eigenvector_plot, EIG + "SELECT 1 AS evect, 'l_discount' AS param, round(u0, 6) AS component FROM e UNION ALL SELECT 1, 'l_tax', round(u1, 6) FROM e UNION ALL SELECT 2, 'l_discount', round(w0, 6) FROM e UNION ALL SELECT 2, 'l_tax', round(w1, 6) FROM e"),
    "local_as_by_flag": (local_as_by_flag, CTE + ", c AS (SELECT l_returnflag, count(*) AS n, avg(g0 * g0) a, avg(g0 * g1) b, avg(g1 * g1) d FROM s GROUP BY 1), h AS (SELECT *, (a + d) / 2 AS m, sqrt(((a - d) / 2) * ((a - d) / 2) + b * b) AS q FROM c) SELECT l_returnflag, n, round(m + q, 6) AS lambda1, round(m - q, 6) AS lambda2, round((m + q) / (a + d), 6) AS share FROM h"),
    "uniform_normalize_by_group": (uniform_normalize_by_group, CTE + ", k AS (SELECT l_returnflag, min(x0) a0, max(x0) b0, min(x1) a1, max(x1) b1 FROM s GROUP BY 1), z AS (SELECT s.l_returnflag, 2 * (x0 - a0) / (b0 - a0) - 1 AS y0, 2 * (x1 - a1) / (b1 - a1) - 1 AS y1, g0 * (b0 - a0) / 2 AS h0, g1 * (b1 - a1) / 2 AS h1 FROM s JOIN k USING (l_returnflag)) SELECT l_returnflag, round(avg(y0 * y0), 5) + 0.0 AS xx, round(avg(y0 * y1), 5) + 0.0 AS xy, round(avg(h0 * h0), 5) + 0.0 AS gg, round(avg(h0 * h1), 5) + 0.0 AS gh FROM z GROUP BY 1"),
    "gaussian_normalize_by_group": (gaussian_normalize_by_group, CTE + ", k AS (SELECT l_returnflag, avg(x0) u0, avg(x1) u1, covar_samp(x0, x0) a, covar_samp(x0, x1) b, covar_samp(x1, x1) d FROM s GROUP BY 1), q AS (SELECT *, sqrt(a * d - b * b) AS dt FROM k), r AS (SELECT *, sqrt(a + d + 2 * dt) AS t FROM q), m AS (SELECT l_returnflag, u0, u1, (a + dt) / t AS r00, b / t AS r01, (d + dt) / t AS r11, dt FROM r), z AS (SELECT s.l_returnflag, (r11 * (x0 - u0) - r01 * (x1 - u1)) / dt AS y0, (r00 * (x1 - u1) - r01 * (x0 - u0)) / dt AS y1, r00 * g0 + r01 * g1 AS h0, r01 * g0 + r11 * g1 AS h1 FROM s JOIN m USING (l_returnflag)) SELECT l_returnflag, round(avg(y0 * y0), 5) + 0.0 AS xx, round(avg(y0 * y1), 5) + 0.0 AS xy, round(avg(h0 * h0), 5) + 0.0 AS gg, round(avg(h0 * h1), 5) + 0.0 AS gh FROM z GROUP BY 1"),
    "regression_scores": (regression_scores, CTE + ", p AS (SELECT f, f * 0.9 + 0.1 * x0 AS p, f * 0.8 AS q FROM s) SELECT round(1 - sum((f - p) * (f - p)) / (count(*) * var_pop(f)), 6) AS r2_full, round(1 - sum((f - q) * (f - q)) / (count(*) * var_pop(f)), 6) AS r2_local, round(avg(abs(f - p)), 6) AS mae_full, round(avg(abs(f - q)), 6) AS mae_local FROM p"),
    "rrmse": (rrmse, CTE + "SELECT round(sqrt(sum((0.9 * f - f) * (0.9 * f - f)) / (count(*) * var_pop(f))), 6) AS rrmse FROM s"),
    "knn_topk": (knn_topk, "WITH d AS (SELECT s_suppkey AS query_id, c_custkey AS neighbour_id, (s_acctbal / 1000 - c_acctbal / 1000) * (s_acctbal / 1000 - c_acctbal / 1000) + (s_nationkey - c_nationkey)::DOUBLE * (s_nationkey - c_nationkey) AS d2 FROM supplier, customer), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, neighbour_id) AS rank FROM d) SELECT query_id, neighbour_id, rank, round(d2, 6) + 0.0 AS d2 FROM r WHERE rank <= 3"),
    "as_metric_knn": (as_metric_knn, "WITH p AS (SELECT s_suppkey AS id, 0.9::DOUBLE * (0.6::DOUBLE * s_acctbal / 1000 + 0.8::DOUBLE * s_nationkey) AS a, 0.1::DOUBLE * (-0.8::DOUBLE * s_acctbal / 1000 + 0.6::DOUBLE * s_nationkey) AS b FROM supplier), c AS (SELECT c_custkey AS id, 0.9::DOUBLE * (0.6::DOUBLE * c_acctbal / 1000 + 0.8::DOUBLE * c_nationkey) AS a, 0.1::DOUBLE * (-0.8::DOUBLE * c_acctbal / 1000 + 0.6::DOUBLE * c_nationkey) AS b FROM customer), d AS (SELECT p.id AS query_id, (p.a - c.a) * (p.a - c.a) + (p.b - c.b) * (p.b - c.b) AS d2, c.id AS n FROM p, c), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, n) AS rank FROM d) SELECT query_id, rank, round(d2, 6) + 0.0 AS d2 FROM r WHERE rank <= 2"),
    "min_dist_assign": (min_dist_assign, "WITH d AS (SELECT c_custkey AS id, s_suppkey AS s, s_nationkey AS label, (s_acctbal / 1000 - c_acctbal / 1000) * (s_acctbal / 1000 - c_acctbal / 1000) + (s_nationkey - c_nationkey)::DOUBLE * (s_nationkey - c_nationkey) AS d2 FROM supplier, customer), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, s) AS rank FROM d) SELECT label::BIGINT AS label, count(*) AS n FROM r WHERE rank = 1 GROUP BY 1"),
    "local_planes_2d": (local_planes_2d, "WITH d AS (SELECT s_suppkey AS query_id, c_custkey AS n, c_acctbal / 1000 AS x0, c_nationkey / 25.0::DOUBLE AS x1, c_acctbal * c_acctbal / 1e6 + 3 * c_nationkey AS f, (s_acctbal / 1000 - c_acctbal / 1000) * (s_acctbal / 1000 - c_acctbal / 1000) + (s_nationkey / 25.0::DOUBLE - c_nationkey / 25.0::DOUBLE) * (s_nationkey / 25.0::DOUBLE - c_nationkey / 25.0::DOUBLE) AS d2 FROM supplier, customer), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, n) AS rank FROM d), m AS (SELECT query_id, covar_pop(x0, x0) a, covar_pop(x0, x1) b, covar_pop(x1, x1) c, covar_pop(x0, f) p, covar_pop(x1, f) q FROM r WHERE rank <= 12 GROUP BY 1) SELECT query_id, round((p * c - q * b) / (a * c - b * b), 4) + 0.0 AS g0, round((a * q - b * p) / (a * c - b * b), 4) + 0.0 AS g1 FROM m"),
    "rff_map": (rff_map, CTE + "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(sqrt(2.0 / 3) * 0.9 * cos(x0 * {w[0]} + x1 * {w[1]} + {b}), 6) + 0.0 AS phi{k}" for k, (w, b) in enumerate(zip(W, BIAS))) + " FROM s"),
    "rff_jacobian": (rff_jacobian, CTE + "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(-sqrt(2.0 / 3) * 0.9 * sin(x0 * {w[0]} + x1 * {w[1]} + {b}) * {w[i]}, 6) + 0.0 AS j{k}{i}" for k, (w, b) in enumerate(zip(W, BIAS)) for i in range(2)) + " FROM s"),
    "kernel_moments_d2": (
        kernel_moments_d2,
        CTE
        + ", j AS (SELECT g0, g1, -0.9 * sin(x0 * 0.6 + x1 * -0.4 + 0.13) AS p, -0.9 * sin(x0 * 1.1 + x1 * 0.3 + 0.77) AS q FROM s), i AS (SELECT (g0 * 0.3 - g1 * 1.1) / (p * (0.6 * 0.3 + 0.4 * 1.1)) AS h0, (g1 * 0.6 + g0 * 0.4) / (q * (0.6 * 0.3 + 0.4 * 1.1)) AS h1 FROM j), c AS (SELECT avg(h0 * h0) a, avg(h0 * h1) b, avg(h1 * h1) d FROM i), h AS (SELECT (a + d) / 2 AS m, sqrt(((a - d) / 2) * ((a - d) / 2) + b * b) AS q FROM c) SELECT 0 AS idx, round(m + q, 3) AS eval FROM h UNION ALL SELECT 1, round(m - q, 3) FROM h",
    ),
    "kfold_assign": (kfold_assign, "SELECT (o_orderkey % 5)::INT AS fold, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1"),
    "knn_graph": (knn_graph, "WITH d AS (SELECT a.s_suppkey AS src, b.s_suppkey AS dst, (a.s_acctbal / 1000 - b.s_acctbal / 1000) * (a.s_acctbal / 1000 - b.s_acctbal / 1000) + (a.s_nationkey - b.s_nationkey)::DOUBLE * (a.s_nationkey - b.s_nationkey) AS d2 FROM supplier a, supplier b), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS k FROM d) SELECT src, dst FROM r WHERE k <= 3"),
    "graph_components": (graph_components, "WITH RECURSIVE d AS (SELECT a.s_suppkey AS src, b.s_suppkey AS dst, (a.s_acctbal / 1000 - b.s_acctbal / 1000) * (a.s_acctbal / 1000 - b.s_acctbal / 1000) + (a.s_nationkey - b.s_nationkey)::DOUBLE * (a.s_nationkey - b.s_nationkey) AS d2 FROM supplier a, supplier b), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS k FROM d), e AS (SELECT src, dst FROM r WHERE k <= 3 UNION SELECT dst, src FROM r WHERE k <= 3), w AS (SELECT s_suppkey AS node, s_suppkey AS seen FROM supplier UNION SELECT w.node, e.dst FROM w JOIN e ON e.src = w.seen), l AS (SELECT node, min(seen) AS m FROM w GROUP BY 1) SELECT node, (dense_rank() OVER (ORDER BY m) - 1)::INT AS label FROM l"),
    "graph_components_by_dim": (graph_components_by_dim, "WITH RECURSIVE d AS (SELECT a.s_suppkey AS src, b.s_suppkey AS dst, (a.s_acctbal / 1000 - b.s_acctbal / 1000) * (a.s_acctbal / 1000 - b.s_acctbal / 1000) + (a.s_nationkey - b.s_nationkey)::DOUBLE * (a.s_nationkey - b.s_nationkey) AS d2 FROM supplier a, supplier b WHERE a.s_nationkey % 3 = b.s_nationkey % 3), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS k FROM d), e AS (SELECT src, dst FROM r WHERE k <= 2 UNION SELECT dst, src FROM r WHERE k <= 2), w AS (SELECT s_suppkey AS node, s_suppkey AS seen FROM supplier UNION SELECT w.node, e.dst FROM w JOIN e ON e.src = w.seen), l AS (SELECT node, min(seen) AS m FROM w GROUP BY 1) SELECT node, (dense_rank() OVER (ORDER BY m) - 1)::INT AS label FROM l"),
    "embeddings_gram": (embeddings_gram, "WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), n AS (SELECT count(*) AS n FROM embeddings) SELECT a.i::INT AS i, b.i::INT AS j, round(sum(a.v * b.v) / any_value(n), 5) + 0.0 AS c FROM u a JOIN u b USING (vec_id), n GROUP BY 1, 2"),
    "closed_form_functions": (closed_form_functions, CTE + " UNION ALL ".join(f"SELECT '{n}' AS name, round(avg({f}), 6) + 0.0 AS f, round(avg(({a}) * ({a})), 6) + 0.0 AS c00, round(avg(({a}) * ({b})), 6) + 0.0 AS c01, round(avg(({b}) * ({b})), 6) + 0.0 AS c11 FROM s" for n, (f, a, b) in FORMULAS.items())),
    "linear_program_corner": (linear_program_corner, "WITH r AS (SELECT avg(l_discount) AS a, avg(l_tax) AS b, max(l_discount) + max(l_tax) AS c FROM lineitem) SELECT round(a, 6) AS x0, round(greatest(b, c - a), 6) AS x1 FROM r"),
    "events_running_moments": (events_running_moments, "WITH g AS (SELECT value / 100 AS a, hour(ts) / 24.0 AS b FROM events WHERE value IS NOT NULL) SELECT count(*) AS n, round(avg(a * a), 6) + 0.0 AS c00, round(avg(a * b), 6) + 0.0 AS c01, round(avg(b * b), 6) + 0.0 AS c11 FROM g"),
    "bootstrap_by_customer": (bootstrap_by_customer, _bootstrap_sql()),
    "classify_by_dim": (classify_by_dim, _classes_sql()),
}
ROWS_ONLY = (frequent_directions, randomized_spectrum, bootstrap_ranges, inverse_map, optimal_profile, local_gradients, kmeans_as, kmedoids_as, hierarchical_as, hierarchical_predict, class_boundaries, feature_distributions, tuned_features, cross_validated_surface, level_set_loss, quadratic_moments)


def queries() -> dict:
    return {name: f for name, (f, _) in WITH_SQL.items()} | {f.__name__: f for f in ROWS_ONLY}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in WITH_SQL.items()}
