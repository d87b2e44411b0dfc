"""All registered queries of the library over the driver's tables, and their SQL.

Floating results are rounded alike on both sides, since
the order in which partitions are added is not fixed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.operators import covariance, foundations, learning, leave_out, location, precision, resampling, series, shrinkage, sparse_clustering, sparse_models
from orbweave.sources.samples import sample

DIGITS = 6
LINE_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
#: What the columns' means and variances are compared with.
LINE_MEANS, LINE_VARIANCES = (25.0, 38000.0, 0.05, 0.04), (200.0, 5e8, 1e-3, 1e-3)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors with an even and with an odd label."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return tuple(sample(e.where(F.col("label") % 2 == k), "vec_id", "embedding") for k in (0, 1))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return sample(t, "l_orderkey", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), "value")


def one_row(spark: SparkSession, found: dict, *names: str) -> DataFrame:
    row = {n: found[n] for n in names}
    return spark.createDataFrame([tuple(int(v) if isinstance(v, int | np.integer) else round(float(v), DIGITS) for v in row.values())], list(row))


def matrix(spark: SparkSession, m: np.ndarray, digits: int = DIGITS) -> DataFrame:
    rows = [(i + 1, j + 1, round(float(m[i, j]), digits) + 0.0) for i in range(len(m)) for j in range(m.shape[1])]
    return spark.createDataFrame(rows, "i int, j int, v double")


def q_spatial_sign(spark, d):
    out = foundations.spatial_sign(vectors(spark, d))
    return out.select("id", *(F.round(F.get("sign", F.lit(k)), DIGITS).alias(f"u{k + 1}") for k in range(4)), F.round("norm", DIGITS).alias("norm"))


def q_spatial_rank(spark, d):
    out = foundations.spatial_rank(vectors(spark, d))
    return out.select("id", *(F.round(F.get("rank", F.lit(k)), DIGITS).alias(f"r{k + 1}") for k in range(4)))


def _coordinates(out: DataFrame, name: str) -> DataFrame:
    """Rows (id, d, v), one a coordinate; d from 1."""
    return out.select("id", F.posexplode(name).alias("d", "v")).select("id", (F.col("d") + 1).alias("d"), (F.round("v", DIGITS) + 0.0).alias("v"))


def q_spatial_sign_coordinates(spark, d):
    return _coordinates(foundations.spatial_sign(vectors(spark, d)), "sign")


def q_spatial_rank_coordinates(spark, d):
    return _coordinates(foundations.spatial_rank(vectors(spark, d)), "rank")


def q_sscm(spark, d):
    return matrix(spark, foundations.sscm(vectors(spark, d), center="none"))


def q_spatial_median(spark, d):
    return matrix(spark, foundations.spatial_median(vectors(spark, d)).value[None, :])


def q_tyler_shape(spark, d):
    return matrix(spark, foundations.tyler_shape(vectors(spark, d)).value)


def q_bai_saranadasa(spark, d):
    return one_row(spark, location.bai_saranadasa(*halves(spark, d)), "statistic", "raw", "trace_sigma2")


def q_srivastava_du(spark, d):
    return one_row(spark, location.srivastava_du(vectors(spark, d)), "statistic", "raw", "trace_r2")


def q_srivastava_katayama_kano(spark, d):
    return one_row(spark, location.srivastava_katayama_kano(*halves(spark, d)), "statistic", "raw")


def q_chen_qin(spark, d):
    return one_row(spark, location.chen_qin(*halves(spark, d)), "statistic", "raw", "a12")


def q_feng_sun(spark, d):
    return one_row(spark, leave_out.feng_sun_one_sample(vectors(spark, d)), "statistic", "raw", "trace_r2")


def q_inst_one_sample(spark, d):
    return one_row(spark, leave_out.inst_one_sample(vectors(spark, d)), "statistic", "p_value")


def q_weighted_median(spark, d):
    return matrix(spark, leave_out.weighted_scaled_spatial_median(vectors(spark, d)).value[None, :])


def q_weighted_max(spark, d):
    return one_row(spark, leave_out.weighted_max_test(vectors(spark, d)), "statistic", "raw")


def q_weighted_maxsum(spark, d):
    return one_row(spark, leave_out.weighted_maxsum(vectors(spark, d), m=0.5), "statistic", "p_value", "max", "sum")


def q_spatial_sign_maxsum(spark, d):
    return one_row(spark, leave_out.spatial_sign_maxsum(vectors(spark, d)), "statistic", "p_value", "max", "sum")


def q_feng_zou_wang(spark, d):
    return one_row(spark, leave_out.feng_zou_wang_two_sample(*halves(spark, d)), "statistic", "raw")


def q_tinst(spark, d):
    return one_row(spark, leave_out.tinst_two_sample(*halves(spark, d)), "statistic", "p_value")


def q_wang_peng_li(spark, d):
    return one_row(spark, location.wang_peng_li(vectors(spark, d)), "statistic", "raw")


def q_hotelling(spark, d):
    return one_row(spark, location.hotelling_two_sample(*halves(spark, d)), "statistic", "p_value", "t2")


def q_zhang_zhou_guo(spark, d):
    return one_row(spark, location.zhang_zhou_guo(vectors(spark, d)), "statistic", "raw", "df")


def q_john_sphericity(spark, d):
    return one_row(spark, covariance.john_sphericity(vectors(spark, d)), "statistic", "u")


def q_chen_zhang_zhong(spark, d):
    return one_row(spark, covariance.chen_zhang_zhong(vectors(spark, d)), "y1", "y2", "y3", "y4", "y5", "statistic")


def q_fisher_sun_gallagher(spark, d):
    return one_row(spark, covariance.fisher_sun_gallagher_sphericity(vectors(spark, d)), "statistic", "psi")


def q_sign_sum_sphericity(spark, d):
    return one_row(spark, covariance.sign_sum_sphericity(vectors(spark, d), "mean"), "statistic", "raw")


def q_sign_max_sphericity(spark, d):
    return one_row(spark, covariance.sign_max_sphericity(vectors(spark, d), "mean"), "statistic", "raw")


def q_regularized_sign_covariance(spark, d):
    return matrix(spark, covariance.regularized_sign_covariance(vectors(spark, d), "mean")["value"])


def q_spatial_sign_max(spark, d):
    return one_row(spark, location.spatial_sign_max_test(vectors(spark, d)), "statistic", "raw")


def q_covariance_threshold(spark, d):
    return matrix(spark, covariance.covariance_threshold(vectors(spark, d)))


def q_poet(spark, d):
    return matrix(spark, covariance.poet_covariance(vectors(spark, d), 2, 0.1))


def q_line_covariance(spark, d):
    return matrix(spark, covariance.covariance_threshold(lines(spark, d), level=0.0, divisor="n-1"), 3)


def q_cusum(spark, d):
    return one_row(spark, series.classical_cusum(values(spark, d)), "statistic", "k", "sigma2")


def q_portmanteau(spark, d):
    return one_row(spark, series.portmanteau(values(spark, d), 5), "statistic")


def q_lda(spark, d):
    t = _labelled(spark, d)
    return learning.classical_lda(t, ("0", "1")).predict(t).select("id", F.round("score", DIGITS).alias("score"), "label")


def q_independence_classifier(spark, d):
    t = _labelled(spark, d)
    return learning.independence_classifier(t, ("0", "1"), prior=(0.5, 0.5)).predict(t).select("id", F.round("score", 5).alias("score"))


def q_pca(spark, d):
    return matrix(spark, learning.classical_pca(vectors(spark, d), 5)["values"][None, :])


def q_kmeans(spark, d):
    fit = learning.lloyd_kmeans(vectors(spark, d), 10)
    return learning.assign(vectors(spark, d), fit["centers"]).select("id", "cluster", F.round("distance", DIGITS).alias("distance"))


def q_nagao(spark, d):
    return one_row(spark, covariance.nagao_identity(vectors(spark, d)), "statistic")


def q_wang_yao_john(spark, d):
    return one_row(spark, covariance.wang_yao_corrected_john(vectors(spark, d), center=True), "statistic", "raw")


def q_pesaran_cd(spark, d):
    return one_row(spark, series.pesaran_cd(vectors(spark, d)), "statistic")


def q_alpha_max(spark, d):
    return one_row(spark, series.alpha_max(vectors(spark, d)), "statistic")


def q_pesaran_yamagata(spark, d):
    return one_row(spark, series.pesaran_yamagata_alpha(vectors(spark, d)), "statistic", "rho2")


def q_threshold_soft(spark, d):
    return matrix(spark, covariance.covariance_threshold(vectors(spark, d), level=0.002, rule="soft"))


def q_threshold_scad(spark, d):
    return matrix(spark, covariance.covariance_threshold(vectors(spark, d), level=0.002, rule="scad"))


def q_threshold_adaptive_lasso(spark, d):
    return matrix(spark, covariance.covariance_threshold(vectors(spark, d), level=0.002, rule="adaptive_lasso"))


def q_adaptive_threshold(spark, d):
    return matrix(spark, covariance.adaptive_covariance_threshold(vectors(spark, d), delta=1.0))


def q_spatial_kendall(spark, d):
    return matrix(spark, foundations.spatial_kendall(vectors(spark, d)))


def q_rank_covariance(spark, d):
    return matrix(spark, foundations.spatial_rank_covariance(vectors(spark, d)))


def q_acg_loglik(spark, d):
    shape = np.diag(np.arange(1.0, 65.0))
    return one_row(spark, {"loglik": foundations.acg_loglik(vectors(spark, d), shape)}, "loglik")


def q_ollila_raninen(spark, d):
    return matrix(spark, shrinkage.ollila_raninen_shrinkage(vectors(spark, d), "ell2")["value"])


def q_basic_shape(spark, d):
    return matrix(spark, shrinkage.basic_shape(vectors(spark, d))["value"])


def q_basics_shape(spark, d):
    return matrix(spark, shrinkage.basics_shape(vectors(spark, d))["value"])


def q_li_chen(spark, d):
    return one_row(spark, covariance.li_chen(*halves(spark, d)), "statistic", "raw")


def q_feng_liu_ma_white_noise(spark, d):
    return one_row(spark, series.feng_liu_ma_white_noise(vectors(spark, d), lags=2), "max", "sum", "trace", "largest")


def q_spatial_sign_white_noise(spark, d):
    return one_row(spark, series.spatial_sign_white_noise(vectors(spark, d), lags=2), "statistic", "raw", "trace")


def q_gaussian_alpha_cauchy(spark, d):
    return one_row(spark, series.gaussian_alpha_cauchy(vectors(spark, d), trace_r2=64.0), "sum", "max")


def q_weighted_sign_alpha(spark, d):
    scores = foundations.spatial_sign(vectors(spark, d)).select("id", F.col("sign").alias("x"), F.col("norm").alias("radius"), F.lit(1.0).alias("h"))
    return one_row(spark, series.weighted_sign_alpha_oracle(scores, 64.0, lambda r: 1 / r), "statistic", "raw", "psi2")


def q_oracle_weighted_sign_sum(spark, d):
    found = location.oracle_weighted_sign_sum(vectors(spark, d), np.zeros(64), np.arange(1.0, 65.0), "inverse_norm", nu2=1.0, trace_r2=64.0)
    return one_row(spark, found, "statistic", "raw", "nu2")


def _labelled(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), (F.col("label") % 2).cast("string").alias("y"))


def q_sparse_plugin_lda(spark, d):
    rows = _labelled(spark, d)
    fit = learning.sparse_plugin_lda(rows, precision=np.diag(np.arange(1.0, 65.0)), levels=("0", "1"))
    return fit.predict(rows).select("id", F.round("score", DIGITS).alias("score"), "label")


def q_shao_threshold_lda(spark, d):
    rows = _labelled(spark, d)
    # all off-diagonal entries are below the first threshold, so that SQL needs no inverse
    fit = learning.shao_threshold_lda(rows, 10.0, 0.02, 0.3, levels=("0", "1"))
    return fit.predict(rows).select("id", F.round("score", DIGITS).alias("score"), "label")


def q_cheng_sscm_equality(spark, d):
    return one_row(spark, covariance.cheng_sscm_equality(*halves(spark, d), center="mean"), "statistic", "raw", "trace")


def q_elliptical_oracle(spark, d):
    rows = _labelled(spark, d)
    ones = np.full(64, 0.1)
    fit = learning.elliptical_oracle(("0", "1"), ones, np.eye(64), -ones, 2 * np.eye(64), lambda q: -34.0 * np.log1p(q / 4))
    return fit.predict(rows).select("id", F.round("score", DIGITS).alias("score"), "label")


def q_spatial_sign_precision_lda(spark, d):
    rows = _labelled(spark, d)
    fit = learning.spatial_sign_precision_lda(rows, precision.spatial_sign_precision(rows, 0.3, "sglasso"), levels=("0", "1"))
    return fit.predict(rows).select("id", F.round("score", 4).alias("score"), "label")


def q_kendall_factor_number(spark, d):
    found = learning.kendall_factor_number(vectors(spark, d), 8, 0.1)
    return one_row(spark, {"k": found["k"], "ratio": found["ratios"].max()}, "k", "ratio")


def q_graphical_lasso(spark, d):
    return matrix(spark, precision.gaussian_graphical_lasso(vectors(spark, d), 0.005).value, 4)


def q_clime(spark, d):
    return matrix(spark, precision.clime_precision(vectors(spark, d), 0.3).value, 4)


def q_spatial_sign_precision(spark, d):
    return matrix(spark, precision.spatial_sign_precision(vectors(spark, d), 0.3, "sglasso").value, 4)


def q_ec2_covariance(spark, d):
    return matrix(spark, precision.ec2_covariance(vectors(spark, d), 0.05, 0.1).value)


def q_wang_yao_lrt(spark, d):
    return one_row(spark, covariance.wang_yao_corrected_lrt(lines(spark, d), center=True), "raw", "ratio", "mean")


def q_hallin_paindaveine(spark, d):
    return one_row(spark, covariance.hallin_paindaveine_shape(vectors(spark, d), center="mean", score="sign"), "statistic", "contrast")


def q_hallin_paindaveine_wilcoxon(spark, d):
    return one_row(spark, covariance.hallin_paindaveine_shape(vectors(spark, d), center="mean", score="wilcoxon"), "statistic", "contrast")


def q_zhang_zhu_zhang(spark, d):
    return one_row(spark, location.zhang_zhu_zhang(*halves(spark, d)), "statistic", "df", "factor", "trace")


def q_mauchly(spark, d):
    return one_row(spark, covariance.mauchly_sphericity(lines(spark, d)), "log_v")


def q_covariance_lrt(spark, d):
    rows = lines(spark, d)
    found = covariance.gaussian_covariance_lrt(rows, np.diag(LINE_VARIANCES))
    return one_row(spark, {"mean_statistic": found["statistic"] / rows.count()}, "mean_statistic")


def q_wilks_independence(spark, d):
    return one_row(spark, series.gaussian_wilks_independence(lines(spark, d), 2), "lambda")


def q_hotelling_one(spark, d):
    return one_row(spark, location.hotelling_one_sample(lines(spark, d), LINE_MEANS, tol=1e-16), "statistic", "t2")


def q_hotelling_lines(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    return one_row(spark, location.hotelling_two_sample(*(sample(t.where(F.col("l_linenumber") % 2 == k), "l_orderkey", list(LINE_COLUMNS)) for k in (0, 1)), tol=1e-16), "statistic", "t2")


def q_grs_alpha(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    excess = t.select("l_orderkey", *((F.col(c) - m).alias(c) for c, m in zip(LINE_COLUMNS, LINE_MEANS, strict=True)))
    return one_row(spark, series.grs_alpha(sample(excess, "l_orderkey", list(LINE_COLUMNS))), "statistic")


def q_gaussian_lda_oracle(spark, d):
    fit = learning.gaussian_lda_oracle(("0", "1"), np.full(64, 0.1), np.full(64, -0.1), covariance=np.diag(np.arange(1.0, 65.0)), prior=(0.25, 0.75))
    return fit.predict(vectors(spark, d)).select("id", F.round("score", DIGITS).alias("score"), "label")


def q_gaussian_qda_oracle(spark, d):
    fit = learning.gaussian_qda_oracle(("0", "1"), np.full(64, 0.1), np.eye(64), np.full(64, -0.1), 2 * np.eye(64))
    return fit.predict(vectors(spark, d)).select("id", F.round("score", DIGITS).alias("score"), "label")


def q_park_ayyala_numerator(spark, d):
    return one_row(spark, {"raw": location.park_ayyala_numerator(vectors(spark, d))}, "raw")


def q_strong_correlation_sign(spark, d):
    found = resampling.strong_correlation_sign_test(vectors(spark, d), B=499, seed=7)
    return one_row(spark, found, "statistic", "raw")


def q_approximate_randomization(spark, d):
    found = resampling.approximate_randomization_test(*halves(spark, d), B=499, seed=7)
    return one_row(spark, found, "statistic", "evaluations")


def _clusters(fit: dict, rows: DataFrame, metric: np.ndarray, absolute: bool = False) -> DataFrame:
    return sparse_clustering.weighted_assign(rows, fit["centers"], metric, absolute).select("id", "cluster", F.round("distance", DIGITS).alias("distance"))


def q_sparse_kmeans(spark, d):
    rows = vectors(spark, d)
    fit = sparse_clustering.sparse_kmeans(rows, 3, 4.0, empty_action="farthest")
    return _clusters(fit, rows, fit["weights"])


def q_sparse_kmedian(spark, d):
    rows = vectors(spark, d)
    fit = sparse_clustering.sparse_kmedian(rows, 3, 4.0, empty_action="farthest")
    return _clusters(fit, rows, fit["weights"], True)


def q_sparse_kmeans_gap(spark, d):
    found = sparse_clustering.sparse_kmeans_select_s(vectors(spark, d), 3, [2.0, 4.0, 8.0], B=3, seed=11, empty_action="farthest")
    return spark.createDataFrame([(r["setting"], round(r["objective"], DIGITS), round(r["gap"], DIGITS), r["setting"] == found["selected"]) for r in found["table"]], "bound double, objective double, gap double, selected boolean")


def q_sparse_k_spatial_median(spark, d):
    rows = vectors(spark, d)
    fit = sparse_clustering.sparse_k_spatial_median(rows, 3, 0.05, tol=1e-7, empty_action="farthest", empty_active="largest", cycle_action="return")
    return _clusters(fit, rows, fit["active"].astype(float))


def q_sm_sscm(spark, d):
    rows = vectors(spark, d)
    fit = sparse_clustering.sm_sscm(rows, 3, 0.1, tol=1e-7, empty_action="farthest", cycle_action="return")
    return _clusters(fit, rows, fit["metric"])


def q_dsda(spark, d):
    rows = _labelled(spark, d)
    # the more rows of like classes, the nearer their means: from some size on no coefficient may be left
    fit = sparse_models.dsda_classifier(rows, 0.02, ("0", "1"), empty="tie")
    return fit.predict(rows).select("id", (F.round("score", 5) + 0.0).alias("score"), "label")


def q_fantope(spark, d):
    return matrix(spark, sparse_models.fantope_pca(vectors(spark, d), 2, 1e-4).value, 3)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("q_")}


_E = "e AS (SELECT vec_id AS id, label % 2 AS g, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS v FROM embeddings)"
_TWO = f"""
WITH {_E}, m AS (SELECT g, d, avg(v) AS m, count(*) AS n FROM e GROUP BY g, d),
c AS (SELECT e.id, e.g, e.d, v - m AS v, n FROM e JOIN m ON e.g = m.g AND e.d = m.d),
s AS (SELECT a.g, a.d AS i, b.d AS j, sum(a.v * b.v) / (max(a.n) - 1) AS s, max(a.n) AS n FROM c a JOIN c b ON a.id = b.id GROUP BY 1, 2, 3),
s2 AS (SELECT x.i, x.j, x.s AS s1, y.s AS s2, x.n AS n1, y.n AS n2, ((x.n - 1) * x.s + (y.n - 1) * y.s) / (x.n + y.n - 2) AS s FROM s x JOIN s y ON x.i = y.i AND x.j = y.j AND x.g = 0 AND y.g = 1),
f AS (SELECT x.d, x.m - y.m AS f FROM m x JOIN m y ON x.d = y.d AND x.g = 0 AND y.g = 1)
"""
_ONE = f"""
WITH {_E}, m AS (SELECT d, avg(v) AS m, count(*) AS n FROM e GROUP BY d),
c AS (SELECT e.id, e.d, v - m AS v, n FROM e JOIN m ON e.d = m.d),
s AS (SELECT a.d AS i, b.d AS j, sum(a.v * b.v) / (max(a.n) - 1) AS s, max(a.n) AS n FROM c a JOIN c b ON a.id = b.id GROUP BY 1, 2)
"""
_GRAM = f"WITH {_E}, k AS (SELECT a.id AS a, b.id AS b, sum(a.v * b.v) AS k FROM e a JOIN e b ON a.d = b.d GROUP BY 1, 2)"
_SIGNS = f"""
WITH {_E}, m AS (SELECT d, avg(v) AS m FROM e GROUP BY d), c AS (SELECT e.id, e.d, v - m AS v FROM e JOIN m ON e.d = m.d),
r AS (SELECT id, sqrt(sum(v * v)) AS r FROM c GROUP BY id), u AS (SELECT c.id, d, v / r AS v FROM c JOIN r ON c.id = r.id),
k AS (SELECT count(*)::DOUBLE AS n, 64.0::DOUBLE AS p, avg(1 / (r * r)) / pow(avg(1 / r), 2) AS r2, avg(1 / (r * r * r)) / pow(avg(1 / r), 3) AS r3 FROM r),
b AS (SELECT x.d AS i, y.d AS j, sum(x.v * y.v) / max(n) AS b FROM u x JOIN u y ON x.id = y.id, k GROUP BY 1, 2)
"""
_SUMS = "WITH r AS (SELECT event_id AS id, value, row_number() OVER w AS k, sum(value) OVER w AS s, lag(value) OVER w AS was FROM events WINDOW w AS (ORDER BY event_id)), n AS (SELECT count(*) AS n, sum(value) AS s, avg(value) AS m, sum((value - was) * (value - was)) / (2 * (count(*) - 1)) AS v FROM r)"


def _det(a: str) -> str:
    """The determinant of a 4 x 4 matrix of columns named ``a`` and two numbers."""
    pairs = [(1, 2, 3, 4, "+"), (1, 3, 2, 4, "-"), (1, 4, 2, 3, "+"), (2, 3, 1, 4, "+"), (2, 4, 1, 3, "-"), (3, 4, 1, 2, "+")]
    return " ".join(f"{sign} ({a}1{i} * {a}2{j} - {a}1{j} * {a}2{i}) * ({a}3{k} * {a}4{m} - {a}3{m} * {a}4{k})" for i, j, k, m, sign in pairs)


def _line_sql() -> dict[str, str]:
    """Statistics of lineitem's four columns by determinants; d' S^-1 d is the growth of det S by d d'."""
    entries = ", ".join(f"covar_pop({a}, {b}) AS a{i}{j}" for i, a in enumerate(LINE_COLUMNS, 1) for j, b in enumerate(LINE_COLUMNS, 1))
    means = ", ".join(f"avg({a}) AS m{i}" for i, a in enumerate(LINE_COLUMNS, 1))
    away = ", ".join(f"m{i} - ({v}::DOUBLE) AS d{i}" for i, v in enumerate(LINE_MEANS, 1))
    both = ", ".join(f"a{i}{j} + d{i} * d{j} AS b{i}{j}" for i in range(1, 5) for j in range(1, 5))
    one = f"WITH s AS (SELECT {entries}, {means}, count(*)::DOUBLE AS n FROM lineitem), t AS (SELECT *, {away} FROM s), u AS (SELECT *, {both} FROM t), q AS (SELECT n, ({_det('b')}) / ({_det('a')}) - 1 AS q FROM u)"
    pooled = ", ".join(f"(x.n * x.a{i}{j} + y.n * y.a{i}{j}) / (x.n + y.n - 2) AS a{i}{j}" for i in range(1, 5) for j in range(1, 5))
    apart = ", ".join(f"x.m{i} - y.m{i} AS d{i}" for i in range(1, 5))
    two = f"""WITH s AS (SELECT l_linenumber % 2 AS g, {entries}, {means}, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1), t AS (SELECT {pooled}, {apart}, x.n AS n1, y.n AS n2 FROM s x JOIN s y ON x.g = 0 AND y.g = 1),
        u AS (SELECT *, {both} FROM t), q AS (SELECT n1, n2, n1 * n2 / (n1 + n2) * (({_det('b')}) / ({_det('a')}) - 1) AS t2 FROM u)"""
    v1, v2, v3, v4 = (f"({v}::DOUBLE)" for v in LINE_VARIANCES)
    return {
        "q_mauchly": f"WITH s AS (SELECT {entries} FROM lineitem) SELECT round(ln({_det('a')}) - 4 * ln((a11 + a22 + a33 + a44) / 4), {DIGITS}) AS log_v FROM s",
        "q_covariance_lrt": f"WITH s AS (SELECT {entries} FROM lineitem) SELECT round(a11 / {v1} + a22 / {v2} + a33 / {v3} + a44 / {v4} - ln({_det('a')}) + ln({v1} * {v2} * {v3} * {v4}) - 4, {DIGITS}) AS mean_statistic FROM s",
        "q_wilks_independence": f"WITH s AS (SELECT {entries} FROM lineitem) SELECT round(({_det('a')}) / ((a11 * a22 - a12 * a21) * (a33 * a44 - a34 * a43)), {DIGITS}) AS lambda FROM s",
        "q_hotelling_one": f"{one} SELECT round((n - 4) * q / 4, {DIGITS}) AS statistic, round((n - 1) * q, {DIGITS}) AS t2 FROM q",
        "q_hotelling_lines": f"{two} SELECT round((n1 + n2 - 5) * t2 / (4 * (n1 + n2 - 2)), {DIGITS}) AS statistic, round(t2, {DIGITS}) AS t2 FROM q",
        "q_grs_alpha": f"{one} SELECT round((n - 4) / 4 * q, {DIGITS}) AS statistic FROM q",
    }


def _score_sql(score: str) -> str:
    return f"WITH {_E}, s AS (SELECT id, {score} AS score FROM e GROUP BY id) SELECT id, round(score, {DIGITS}) + 0.0 AS score, CASE WHEN score >= 0 THEN '0' ELSE '1' END AS label FROM s"


def oracle_sql() -> dict[str, str]:
    u = ", ".join(f"round(max(CASE WHEN d = {k} THEN v / norm END), {DIGITS}) AS u{k}" for k in range(1, 5))
    r = ", ".join(f"round(sum(CASE WHEN d = {k} AND norm > 0 THEN v / norm ELSE 0 END) / max(n), {DIGITS}) AS r{k}" for k in range(1, 5))
    z = f"WITH {_E}, r AS (SELECT id, row_number() OVER (ORDER BY id) AS k, sqrt(sum(v * v)) AS norm FROM e GROUP BY id), z AS (SELECT k, d, v, v / norm AS u FROM e JOIN r ON e.id = r.id), n AS (SELECT count(*)::DOUBLE AS n FROM r)"
    lagged = """h AS (SELECT unnest([0, 1, 2]) AS h), m AS (SELECT h, a.d AS i, b.d AS j, sum(a.{v} * b.{v}) AS m FROM h, z a JOIN z b ON b.k = a.k + h GROUP BY 1, 2, 3),
            s AS (SELECT k, sum({v} * {v}) AS q FROM z GROUP BY k), o AS (SELECT h, sum(a.q * b.q) AS o FROM h, s a JOIN s b ON b.k = a.k + h GROUP BY 1),
            q AS (SELECT m.h, sum(m * m) - max(o) AS q FROM m JOIN o ON m.h = o.h GROUP BY 1)"""
    minor = "({0} * {3} - {1} * {2})".format
    pairs = [(1, 2, 3, 4, "+"), (1, 3, 2, 4, "-"), (1, 4, 2, 3, "+"), (2, 3, 1, 4, "+"), (2, 4, 1, 3, "-"), (3, 4, 1, 2, "+")]
    det = " ".join(f"{sign} {minor(f'a1{i}', f'a1{j}', f'a2{i}', f'a2{j}')} * {minor(f'a3{k}', f'a3{m}', f'a4{k}', f'a4{m}')}" for i, j, k, m, sign in pairs)
    names = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    entries = ", ".join(f"covar_samp({a}, {b}) AS a{i}{j}" for i, a in enumerate(names, 1) for j, b in enumerate(names, 1))
    shape = """o AS (SELECT n, t2 - t * t / 64 AS c FROM (SELECT sum(b * b) AS t2, sum(CASE WHEN i = j THEN b END) AS t FROM b), (SELECT count(*)::DOUBLE AS n FROM embeddings))"""
    return {
        **_line_sql(),
        "q_gaussian_lda_oracle": _score_sql("sum(v / d * 0.2::DOUBLE) + ln(1 / 3::DOUBLE)"),
        "q_gaussian_qda_oracle": _score_sql("(sum((v + 0.1::DOUBLE) * (v + 0.1::DOUBLE)) / 2 - sum((v - 0.1::DOUBLE) * (v - 0.1::DOUBLE))) / 2 + 32 * ln(2)"),
        "q_park_ayyala_numerator": f"""WITH {_E}, t AS (SELECT d, sum(v) AS s, sum(v * v) AS q, count(*)::DOUBLE AS n FROM e GROUP BY d),
            w AS (SELECT a.v * b.v / ((q - a.v * a.v - b.v * b.v - pow(s - a.v - b.v, 2) / (n - 2)) / (n - 3)) AS w, n FROM e a JOIN e b ON a.d = b.d AND a.id <> b.id JOIN t ON t.d = a.d)
            SELECT round(sum(w) / max(n * (n - 1)), {DIGITS}) AS raw FROM w""",
        "q_chen_qin": f"""{_TWO}, k AS (SELECT a.g, a.id AS i, b.id AS j, sum(a.v * b.v) AS k FROM e a JOIN e b ON a.g = b.g AND a.d = b.d GROUP BY 1, 2, 3), r AS (SELECT g, i, sum(k) AS r, max(CASE WHEN i = j THEN k END) AS o, count(*)::DOUBLE AS n FROM k GROUP BY 1, 2),
            w AS (SELECT k.g, max(x.n) AS n, sum((k - (x.r - x.o - k) / (x.n - 2)) * (k - (y.r - y.o - k) / (x.n - 2))) / max(x.n * (x.n - 1)) AS w FROM k JOIN r x ON k.g = x.g AND k.i = x.i JOIN r y ON k.g = y.g AND k.j = y.i WHERE k.i <> k.j GROUP BY k.g),
            z AS (SELECT x.w AS w1, y.w AS w2, x.n AS n1, y.n AS n2, (SELECT sum(s1 * s2) FROM s2) AS a12, (SELECT sum(f * f) FROM f) - (SELECT sum(s1) FROM s2 WHERE i = j) / x.n - (SELECT sum(s2.s2) FROM s2 WHERE i = j) / y.n AS raw FROM w x JOIN w y ON x.g = 0 AND y.g = 1)
            SELECT round(raw / sqrt(2 * w1 / (n1 * (n1 - 1)) + 2 * w2 / (n2 * (n2 - 1)) + 4 * a12 / (n1 * n2)), {DIGITS}) AS statistic, round(raw, {DIGITS}) AS raw, round(a12, {DIGITS}) AS a12 FROM z""",
        "q_strong_correlation_sign": f"""WITH {_E}, r AS (SELECT id, sqrt(sum(v * v)) AS r FROM e GROUP BY id), u AS (SELECT d, sum(v / r) AS u FROM e JOIN r ON e.id = r.id GROUP BY d), n AS (SELECT count(*)::DOUBLE AS n FROM r),
            s AS (SELECT (sum(u * u) - max(n)) / 2 AS raw, max(n) AS n FROM u, n) SELECT round(raw / sqrt(n * (n - 1) / 2), {DIGITS}) AS statistic, round(raw, {DIGITS}) AS raw FROM s""",
        "q_approximate_randomization": f"""{_TWO} SELECT round((SELECT sum(f * f) FROM f) - sum(s1) / max(n1) - sum(s2) / max(n2), {DIGITS}) AS statistic, 499::BIGINT AS evaluations FROM s2 WHERE i = j""",
        "q_wang_yao_lrt": f"""WITH a AS (SELECT {entries}, count(*)::DOUBLE AS n FROM lineitem), l AS (SELECT 4 * ln((a11 + a22 + a33 + a44) / 4) - ln({det}) AS ratio, n - 1 AS m FROM a)
            SELECT round(ratio + (4 - m) * ln(1 - 4 / m) - 4, {DIGITS}) AS raw, round(ratio, {DIGITS}) AS ratio, round(-ln(1 - 4 / m) / 2, {DIGITS}) AS mean FROM l""",
        "q_hallin_paindaveine": f"""{_SIGNS}, {shape} SELECT round(n * 64 * 66 * c / 2, {DIGITS}) AS statistic, round(c, {DIGITS}) AS contrast FROM o""",
        "q_hallin_paindaveine_wilcoxon": f"""{_SIGNS.replace("b AS (SELECT", "q AS (SELECT id, rank() OVER (ORDER BY r) AS q FROM r), b AS (SELECT").replace("sum(x.v * y.v) / max(n) AS b FROM u x JOIN u y ON x.id = y.id, k", "sum(x.v * y.v * q) / max(n) / (max(n) + 1) AS b FROM u x JOIN u y ON x.id = y.id JOIN q ON q.id = x.id, k")}, {shape}
            SELECT round(n * 64 * 66 * c / 2 * 3, {DIGITS}) AS statistic, round(c, {DIGITS}) AS contrast FROM o""",
        "q_zhang_zhu_zhang": f"""{_TWO}, k AS (SELECT max(n1)::DOUBLE AS n1, max(n2)::DOUBLE AS n2, max(n1 + n2)::DOUBLE AS n FROM s2), v AS (SELECT i, (k.n2 * s1 + k.n1 * s2) / n AS d FROM s2, k WHERE i = j),
            t AS (SELECT sum(s1 * s1 / x.d / y.d) AS q1, sum(s2 * s2 / x.d / y.d) AS q2, sum(s1 * s2 / x.d / y.d) AS q12, sum(CASE WHEN s2.i = s2.j THEN s1 / x.d END) AS t1, sum(CASE WHEN s2.i = s2.j THEN s2.s2 / x.d END) AS t2 FROM s2 JOIN v x ON s2.i = x.i JOIN v y ON s2.j = y.i),
            w AS (SELECT 2 * n1 * n2 / n / n * q12 AS q12, n2 * n2 / n / n AS w1, n1 * n1 / n / n AS w2, q1, q2, t1, t2, n1, n2, n FROM t, k),
            z AS (SELECT n1 * n2 / (n * 64) * (SELECT sum(f * f / v.d) FROM f JOIN v ON f.d = v.i) AS statistic, 1 + (w1 * q1 + w2 * q2 + q12) / 512 AS factor,
                w1 * (n1 - 1) * (n1 - 1) / ((n1 - 2) * (n1 + 1)) * (q1 - t1 * t1 / (n1 - 1)) + w2 * (n2 - 1) * (n2 - 1) / ((n2 - 2) * (n2 + 1)) * (q2 - t2 * t2 / (n2 - 1)) + q12 AS trace FROM w)
            SELECT round(statistic, {DIGITS}) AS statistic, round(4096 / trace / CASE WHEN factor <= 1.2 THEN factor ELSE 1 END, {DIGITS}) AS df, round(factor, {DIGITS}) AS factor, round(trace, {DIGITS}) AS trace FROM z""",
        "q_feng_liu_ma_white_noise": f"""{z}, {lagged.format(v="v")}, g AS (SELECT i, m AS g FROM m WHERE h = 0 AND i = j),
            x AS (SELECT sqrt(max(n)) * max(abs(m) / sqrt(a.g * b.g)) AS largest FROM m JOIN g a ON m.i = a.i JOIN g b ON m.j = b.i, n WHERE h > 0),
            y AS (SELECT sum(CASE WHEN h = 0 THEN q END) / max(n * (n - 1)) AS trace, sum(CASE WHEN h > 0 THEN q END) / max(n * (n - 1)) AS q, max(n) AS n FROM q, n)
            SELECT round(largest * largest - 2 * ln(8192) + ln(ln(8192)), {DIGITS}) AS max, round(q / (sqrt(4 / (n * (n - 1))) * trace), {DIGITS}) AS sum, round(trace, {DIGITS}) AS trace, round(largest, {DIGITS}) AS largest FROM x, y""",
        "q_spatial_sign_white_noise": f"""{z}, {lagged.format(v="u")}, y AS (SELECT sum(CASE WHEN h = 0 THEN q END) / max(n * (n - 1)) AS trace, sum(CASE WHEN h > 0 THEN q / 2 / (n - h) END) AS raw FROM q, n)
            SELECT round(raw / trace, {DIGITS}) AS statistic, round(raw, {DIGITS}) AS raw, round(trace, {DIGITS}) AS trace FROM y""",
        "q_gaussian_alpha_cauchy": f"""{_ONE} SELECT round((sum(n * m * m / s) - 64) / sqrt(128), {DIGITS}) AS sum, round(max(n * m * m / s) - 2 * ln(64) + ln(ln(64)), {DIGITS}) AS max FROM s JOIN (SELECT d, m FROM m) m ON s.i = m.d WHERE s.i = s.j""",
        "q_weighted_sign_alpha": f"""{z}, t AS (SELECT d, sum(u / norm) AS t FROM z JOIN r ON z.k = r.k GROUP BY d), w AS (SELECT sum(1 / (norm * norm)) AS w, max(n) AS n FROM r, n),
            x AS (SELECT 64 * ((SELECT sum(t * t) FROM t) - w) / n AS raw, w / n AS psi2 FROM w)
            SELECT round(raw / (psi2 * sqrt(128)), {DIGITS}) AS statistic, round(raw, {DIGITS}) AS raw, round(psi2, {DIGITS}) AS psi2 FROM x""",
        "q_oracle_weighted_sign_sum": f"""WITH {_E}, r AS (SELECT id, sum(v * v / d) AS r2 FROM e GROUP BY id), t AS (SELECT d, sum(v / sqrt(d) / r2) AS t FROM e JOIN r ON e.id = r.id GROUP BY d),
            w AS (SELECT sum(1 / r2) AS w, count(*)::DOUBLE AS n FROM r), x AS (SELECT ((SELECT sum(t * t) FROM t) - w) / (n * (n - 1)) AS raw, w, n FROM w)
            SELECT round(raw * 64 / sqrt(128 / (n * (n - 1))), {DIGITS}) AS statistic, round(raw, {DIGITS}) AS raw, round(w / n, {DIGITS}) AS nu2 FROM x""",
        "q_sparse_plugin_lda": f"""WITH {_E}, m AS (SELECT g, d, avg(v) AS m, count(*)::DOUBLE AS n FROM e GROUP BY g, d),
            f AS (SELECT x.d, x.m AS m1, y.m AS m2, ln(x.n / y.n) AS prior FROM m x JOIN m y ON x.d = y.d AND x.g = 0 AND y.g = 1),
            s AS (SELECT id, sum((v - (m1 + m2) / 2) * e.d * (m1 - m2)) + max(prior) AS score FROM e JOIN f ON e.d = f.d GROUP BY id)
            SELECT id, round(score, {DIGITS}) + 0.0 AS score, CASE WHEN score >= 0 THEN '0' ELSE '1' END AS label FROM s""",
        "q_shao_threshold_lda": f"""{_TWO}, k AS (SELECT max(n1 + n2)::DOUBLE AS n FROM s2), w AS (SELECT i, s * (n - 2) / n AS w FROM s2, k WHERE i = j),
            b AS (SELECT x.d, (x.m + y.m) / 2 AS middle, x.m - y.m AS f FROM m x JOIN m y ON x.d = y.d AND x.g = 0 AND y.g = 1),
            q AS (SELECT id, sum((v - middle) * CASE WHEN abs(f) > 0.02::DOUBLE * pow(ln(64) / n, 0.3) THEN f ELSE 0 END / w) AS score FROM e JOIN b ON e.d = b.d JOIN w ON w.i = e.d, k GROUP BY id)
            SELECT id, round(score, {DIGITS}) + 0.0 AS score, CASE WHEN score >= 0 THEN '0' ELSE '1' END AS label FROM q""",
        "q_cheng_sscm_equality": f"""WITH {_E}, m AS (SELECT g, d, avg(v) AS m FROM e GROUP BY g, d), c AS (SELECT e.id, e.g, e.d, v - m AS v FROM e JOIN m ON e.d = m.d AND e.g = m.g),
            r AS (SELECT id, g, sqrt(sum(v * v)) AS r FROM c GROUP BY 1, 2), u AS (SELECT c.id, c.g, d, v / r AS v FROM c JOIN r ON c.id = r.id),
            k AS (SELECT g, count(*)::DOUBLE AS n, avg(1 / (r * r)) / pow(avg(1 / r), 2) AS r2, avg(1 / (r * r * r)) / pow(avg(1 / r), 3) AS r3 FROM r GROUP BY g),
            b AS (SELECT x.g, x.d AS i, y.d AS j, sum(x.v * y.v) / max(n) AS b FROM u x JOIN u y ON x.id = y.id JOIN k ON k.g = x.g GROUP BY 1, 2, 3),
            a AS (SELECT b.g, (max(n) * sum(b * b) - 1) / (max(n) - 1) AS a, max(n) AS n, max((2 - 2 * r2 + r2 * r2) / n / n + (8 * r2 - 6 * r2 * r2 + 2 * r2 * r3 - 2 * r3) / n / n / n) AS bias FROM b JOIN k ON b.g = k.g GROUP BY b.g),
            t AS (SELECT 64 * (sum(a) - 2 * (SELECT sum(x.b * y.b) FROM b x JOIN b y ON x.i = y.i AND x.j = y.j AND x.g = 0 AND y.g = 1)) AS raw, 64 * sum(bias) AS bias, 4096 * sum(n * (a - bias)) / sum(n) AS trace, sum(1 / n) AS f FROM a)
            SELECT round((raw - bias) / (2 * f / 66 * trace), {DIGITS}) AS statistic, round(raw, {DIGITS}) AS raw, round(trace, {DIGITS}) AS trace FROM t""",
        "q_elliptical_oracle": f"""WITH {_E}, q AS (SELECT id, sum(pow(v - 0.1::DOUBLE, 2)) AS a, sum(pow(v + 0.1::DOUBLE, 2)) / 2 AS b FROM e GROUP BY id),
            s AS (SELECT id, -34 * ln(1 + a / 4) + 34 * ln(1 + b / 4) + 32 * ln(2) AS score FROM q)
            SELECT id, round(score, {DIGITS}) + 0.0 AS score, CASE WHEN score >= 0 THEN '0' ELSE '1' END AS label FROM s""",
        "q_spatial_sign": f"WITH {_E}, n AS (SELECT id, sqrt(sum(v * v)) AS norm FROM e GROUP BY id) SELECT e.id, {u}, round(max(norm), {DIGITS}) AS norm FROM e JOIN n ON e.id = n.id GROUP BY e.id",
        "q_spatial_rank": f"""WITH {_E}, p AS (SELECT a.id, b.id AS o, a.d, a.v - b.v AS v FROM e a JOIN e b ON a.d = b.d),
            n AS (SELECT id, o, sqrt(sum(v * v)) AS norm FROM p GROUP BY 1, 2), c AS (SELECT count(*) AS n FROM embeddings)
            SELECT p.id, {r} FROM p JOIN n ON p.id = n.id AND p.o = n.o, c WHERE p.d <= 4 GROUP BY p.id""",
        "q_spatial_sign_coordinates": f"""WITH {_E}, n AS (SELECT id, sqrt(sum(v * v)) AS norm FROM e GROUP BY id)
            SELECT e.id, d::INTEGER AS d, round(CASE WHEN norm > 0 THEN v / norm ELSE 0 END, {DIGITS}) + 0.0 AS v FROM e JOIN n ON e.id = n.id""",
        "q_spatial_rank_coordinates": f"""WITH {_E}, p AS (SELECT a.id, b.id AS o, a.d, a.v - b.v AS v FROM e a JOIN e b ON a.d = b.d),
            n AS (SELECT id, o, sqrt(sum(v * v)) AS norm FROM p GROUP BY 1, 2), c AS (SELECT count(*) AS n FROM embeddings)
            SELECT p.id, d::INTEGER AS d, round(sum(CASE WHEN norm > 0 THEN v / norm ELSE 0 END) / max(n), {DIGITS}) + 0.0 AS v FROM p JOIN n ON p.id = n.id AND p.o = n.o, c GROUP BY 1, 2""",
        "q_nagao": f"""{_ONE} SELECT round((max(n) - 1) / 2.0 * sum(pow(s - CASE WHEN i = j THEN 1 ELSE 0 END, 2)), {DIGITS}) AS statistic FROM s""",
        "q_wang_yao_john": f"""{_ONE}, t AS (SELECT 64 * sum(s * s) / pow(sum(CASE WHEN i = j THEN s END), 2) - 1 AS u, max(n)::DOUBLE AS n FROM s), r AS (SELECT n * u - n * 64 / (n - 1) AS raw FROM t)
            SELECT round((raw - 1) / 2, {DIGITS}) AS statistic, round(raw, {DIGITS}) AS raw FROM r""",
        "q_pesaran_cd": f"""WITH {_E}, g AS (SELECT a.d AS i, b.d AS j, sum(a.v * b.v) AS g FROM e a JOIN e b ON a.id = b.id GROUP BY 1, 2), v AS (SELECT i, g FROM g WHERE i = j)
            SELECT round(sqrt(2 * (SELECT count(*) FROM embeddings) / (64 * 63.0)) * sum(g.g / sqrt(a.g * b.g)), {DIGITS}) AS statistic FROM g JOIN v a ON g.i = a.i JOIN v b ON g.j = b.i WHERE g.i < g.j""",
        "q_alpha_max": f"""{_ONE} SELECT round(max(n * m * m / s) - 2 * ln(64) + ln(ln(64)), {DIGITS}) AS statistic FROM s JOIN (SELECT d, m FROM m) m ON s.i = m.d WHERE s.i = s.j""",
        "q_pesaran_yamagata": f"""{_ONE}, v AS (SELECT i, s, n FROM s WHERE i = j), k AS (SELECT (max(n) - 1)::DOUBLE AS v FROM v),
            r AS (SELECT s.s / sqrt(a.s * b.s) AS r FROM s JOIN v a ON s.i = a.i JOIN v b ON s.j = b.i WHERE s.i < s.j),
            t AS (SELECT 2 * coalesce(sum(CASE WHEN abs(sqrt(v) * r) > {series._normal_quantile(1 - 0.1 / 128)!r} THEN r * r END), 0) / (64 * 63.0) AS rho2 FROM r, k),
            a AS (SELECT sum(n * m * m / s) AS t2 FROM v JOIN (SELECT d, m FROM m) m ON v.i = m.d)
            SELECT round((t2 - 64 * v / (v - 2)) / 8 / (v / (v - 2) * sqrt(2 * (v - 1) * (1 + 63 * rho2) / (v - 4))), {DIGITS}) AS statistic, round(rho2, {DIGITS}) AS rho2 FROM a, t, k""",
        "q_threshold_soft": f"""{_ONE}, w AS (SELECT i, j, s * (n - 1) / n AS c FROM s) SELECT i::INTEGER AS i, j::INTEGER AS j, round(sign(c) * greatest(abs(c) - 0.002::DOUBLE, 0), {DIGITS}) + 0.0 AS v FROM w""",
        "q_threshold_scad": f"""{_ONE}, w AS (SELECT i, j, s * (n - 1) / n AS c FROM s) SELECT i::INTEGER AS i, j::INTEGER AS j, round(CASE WHEN abs(c) <= 0.004::DOUBLE THEN sign(c) * greatest(abs(c) - 0.002::DOUBLE, 0)
            WHEN abs(c) <= 3.7::DOUBLE * 0.002::DOUBLE THEN (2.7::DOUBLE * c - sign(c) * 3.7::DOUBLE * 0.002::DOUBLE) / 1.7::DOUBLE ELSE c END, {DIGITS}) + 0.0 AS v FROM w""",
        "q_threshold_adaptive_lasso": f"""{_ONE}, w AS (SELECT i, j, s * (n - 1) / n AS c FROM s)
            SELECT i::INTEGER AS i, j::INTEGER AS j, round(CASE WHEN c = 0 THEN 0 ELSE sign(c) * greatest(abs(c) - 0.002::DOUBLE * 0.002::DOUBLE / abs(c), 0) END, {DIGITS}) + 0.0 AS v FROM w""",
        "q_adaptive_threshold": f"""{_ONE}, w AS (SELECT a.d AS i, b.d AS j, avg(a.v * b.v) AS c, var_pop(a.v * b.v) AS v, max(a.n)::DOUBLE AS n FROM c a JOIN c b ON a.id = b.id GROUP BY 1, 2)
            SELECT i::INTEGER AS i, j::INTEGER AS j, round(CASE WHEN abs(c) > sqrt(v * ln(64) / n) THEN c ELSE 0 END, {DIGITS}) + 0.0 AS v FROM w""",
        "q_spatial_kendall": f"""WITH {_E}, g AS (SELECT a.id AS a, b.id AS b, sum((a.v - b.v) * (a.v - b.v)) AS q FROM e a JOIN e b ON a.d = b.d AND a.id <> b.id GROUP BY 1, 2),
            z AS (SELECT g.a AS id, e.d, sum(CASE WHEN q > 0 THEN (x.v - e.v) / q ELSE 0 END) AS z FROM g JOIN e ON g.b = e.id JOIN e x ON x.id = g.a AND x.d = e.d GROUP BY 1, 2),
            n AS (SELECT count(*)::DOUBLE AS n FROM embeddings)
            SELECT e.d::INTEGER AS i, z.d::INTEGER AS j, round(2 * sum(e.v * z.z) / max(n * (n - 1)), {DIGITS}) + 0.0 AS v FROM e JOIN z ON e.id = z.id, n GROUP BY 1, 2""",
        "q_rank_covariance": f"""WITH {_E}, g AS (SELECT a.id AS a, b.id AS b, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS q FROM e a JOIN e b ON a.d = b.d AND a.id <> b.id GROUP BY 1, 2),
            n AS (SELECT count(*)::DOUBLE AS n FROM embeddings),
            r AS (SELECT g.a AS id, e.d, sum(CASE WHEN q > 0 THEN (x.v - e.v) / q ELSE 0 END) / max(n) AS r FROM g JOIN e ON g.b = e.id JOIN e x ON x.id = g.a AND x.d = e.d, n GROUP BY 1, 2)
            SELECT a.d::INTEGER AS i, b.d::INTEGER AS j, round(sum(a.r * b.r) / max(n), {DIGITS}) + 0.0 AS v FROM r a JOIN r b ON a.id = b.id, n GROUP BY 1, 2""",
        "q_ollila_raninen": f"""{_ONE}, g AS (SELECT d, avg(v * v * v * v) / pow(avg(v * v), 2) - 3 AS g2, max(n)::DOUBLE AS n FROM c GROUP BY d),
            k AS (SELECT greatest(-2 / 66.0, avg((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)) / 3) AS k, max(n) AS n FROM g),
            t AS (SELECT sum(s * s) AS q, sum(CASE WHEN i = j THEN s END) AS tr FROM s),
            y AS (SELECT k, n, tr, least(64, greatest(1, (k + n) * pow(n - 1, 2) / ((n - 2) * (3 * k * (n - 1) + n * (n + 1))) * (64 * q / (tr * tr) - n / (n + k) * (n / (n - 1) + k) * 64 / n))) AS y FROM k, t),
            w AS (SELECT tr / 64 AS eta, (y - 1) / (y - 1 + k * (2 * y + 64) / n + (y + 64) / (n - 1)) AS w FROM y)
            SELECT i::INTEGER AS i, j::INTEGER AS j, round(w * s + CASE WHEN i = j THEN (1 - w) * eta ELSE 0 END, {DIGITS}) + 0.0 AS v FROM s, w""",
        "q_acg_loglik": f"""WITH {_E}, u AS (SELECT id, ln(sum(v * v / d) / sum(v * v)) AS q, count(*) AS p FROM e GROUP BY id)
            SELECT round(-count(*) / 2.0 * (SELECT sum(ln(k)) FROM range(1, 65) r(k)) - 32 * sum(q), {DIGITS}) AS loglik FROM u""",
        "q_li_chen": f"""{_TWO}, k AS (SELECT a.g, a.id AS a, b.id AS b, sum(a.v * b.v) AS k FROM e a JOIN e b ON a.d = b.d AND a.g = b.g AND a.id <> b.id GROUP BY 1, 2, 3),
            o AS (SELECT g, a, sum(k) AS r, sum(k * k) AS q FROM k GROUP BY 1, 2), q AS (SELECT g, sum(q) AS sq, sum(r) AS o, sum(r * r) AS rr, count(*)::DOUBLE AS n FROM o GROUP BY g),
            t AS (SELECT g, n, sq / (n * (n - 1)) - 2 * (rr - sq) / (n * (n - 1) * (n - 2)) + (o * o - 4 * rr + 2 * sq) / (n * (n - 1) * (n - 2) * (n - 3)) AS t2 FROM q),
            w AS (SELECT x.t2 + y.t2 - 2 * (SELECT sum(s1 * s2) FROM s2) AS raw, 2 * x.t2 / y.n + 2 * y.t2 / x.n AS se FROM t x JOIN t y ON x.g = 0 AND y.g = 1)
            SELECT round(raw / se, {DIGITS}) AS statistic, round(raw, {DIGITS}) AS raw FROM w""",
        "q_sscm": f"""WITH {_E}, n AS (SELECT id, sqrt(sum(v * v)) AS norm FROM e GROUP BY id), c AS (SELECT count(*) AS n FROM embeddings)
            SELECT a.d::INTEGER AS i, b.d::INTEGER AS j, round(sum(a.v * b.v / (norm * norm)) / max(c.n), {DIGITS}) + 0.0 AS v FROM e a JOIN e b ON a.id = b.id JOIN n ON n.id = a.id, c GROUP BY 1, 2""",
        "q_bai_saranadasa": f"""{_TWO}, t AS (SELECT sum(s * s) AS ss, sum(CASE WHEN i = j THEN s END) AS tr, max(n1) AS n1, max(n2) AS n2 FROM s2),
            x AS (SELECT (SELECT sum(f * f) FROM f) - (n1 + n2) / (n1 * n2)::DOUBLE * tr AS raw, (n1 + n2) / (n1 * n2)::DOUBLE AS a, n1 + n2 AS n, n1 + n2 - 2 AS nu,
              (n1 + n2 - 2)::DOUBLE * (n1 + n2 - 2) / ((n1 + n2)::DOUBLE * (n1 + n2 - 3)) * (ss - tr * tr / (n1 + n2 - 2)) AS b FROM t)
            SELECT round(raw / sqrt(2 * a * a * (n - 1) / nu * b), {DIGITS}) AS statistic, round(raw, {DIGITS}) AS raw, round(b, {DIGITS}) AS trace_sigma2 FROM x""",
        "q_srivastava_du": f"""{_ONE}, v AS (SELECT i, s FROM s WHERE i = j), q AS (SELECT sum(s.s * s.s / (a.s * b.s)) AS r2, max(n) AS n FROM s JOIN v a ON s.i = a.i JOIN v b ON s.j = b.i),
            x AS (SELECT n * (SELECT sum(m * m / s) FROM m JOIN v ON m.d = v.i) AS raw, r2, n - 1 AS nu, 1 + r2 / pow(64, 1.5) AS c FROM q)
            SELECT round((raw - nu * 64 / (nu - 2)::DOUBLE) / sqrt(2 * (r2 - 4096 / nu::DOUBLE) * c), {DIGITS}) AS statistic, round(raw, {DIGITS}) AS raw, round(r2, {DIGITS}) AS trace_r2 FROM x""",
        "q_srivastava_katayama_kano": f"""{_TWO}, v AS (SELECT i, s1 / n1 + s2 / n2 AS d FROM s2 WHERE i = j),
            a AS (SELECT s2.i, s2.j, s1 / n1 / sqrt(x.d * y.d) AS a1, s2 / n2 / sqrt(x.d * y.d) AS a2, n1, n2 FROM s2 JOIN v x ON s2.i = x.i JOIN v y ON s2.j = y.i),
            t AS (SELECT sum(a1 * a1) AS q1, sum(a2 * a2) AS q2, sum(a1 * a2) AS q12, sum(CASE WHEN i = j THEN a1 END) AS t1, sum(CASE WHEN i = j THEN a2 END) AS t2, sum((a1 + a2) * (a1 + a2)) AS r2, max(n1) AS n1, max(n2) AS n2 FROM a),
            x AS (SELECT (SELECT sum(f * f / v.d) FROM f JOIN v ON f.d = v.i) AS raw, 2 * (q1 - t1 * t1 / (n1 - 1) + q2 - t2 * t2 / (n2 - 1) + 2 * q12) / 64 AS w, 1 + r2 / pow(64, 1.5) AS c FROM t)
            SELECT round((raw - 64) / 8 / sqrt(w * c), {DIGITS}) AS statistic, round(raw, {DIGITS}) AS raw FROM x""",
        "q_wang_peng_li": f"""WITH {_E}, z AS (SELECT id, sqrt(sum(v * v)) AS norm FROM e GROUP BY id), u AS (SELECT e.id, d, v / norm AS v FROM e JOIN z ON e.id = z.id),
            t AS (SELECT d, sum(v) AS t FROM u GROUP BY d), n AS (SELECT count(*)::DOUBLE AS n FROM embeddings),
            k AS (SELECT a.id AS a, b.id AS b, sum(a.v * b.v) AS k FROM u a JOIN u b ON a.d = b.d GROUP BY 1, 2),
            r AS (SELECT id, sum(v * t) - sum(v * v) AS r FROM u JOIN t ON u.d = t.d GROUP BY id),
            b AS (SELECT sum(k) AS s, sum((k - (x.r - k) / (n - 2)) * (k - (y.r - k) / (n - 2))) / max(n * (n - 1)) AS tr FROM k JOIN r x ON x.id = k.a JOIN r y ON y.id = k.b, n WHERE k.a <> k.b)
            SELECT round(s / 2 / sqrt(n * (n - 1) / 2 * tr), {DIGITS}) AS statistic, round(s / 2, {DIGITS}) AS raw FROM b, n""",
        "q_john_sphericity": f"""{_ONE}, t AS (SELECT 64 * sum(s * s) / pow(sum(CASE WHEN i = j THEN s END), 2) - 1 AS u, max(n) AS n FROM s)
            SELECT round((n - 1) * 64 * u / 2, {DIGITS}) AS statistic, round(u, {DIGITS}) AS u FROM t""",
        "q_chen_zhang_zhong": f"""{_GRAM}, n AS (SELECT count(*)::DOUBLE AS n FROM embeddings), o AS (SELECT a, sum(k) AS r FROM k WHERE a <> b GROUP BY a),
            q AS (SELECT sum(CASE WHEN a = b THEN k END) AS dg, sum(CASE WHEN a <> b THEN k * k END) AS sq, sum(CASE WHEN a <> b THEN k END) AS o FROM k), w AS (SELECT sum(r * r) AS rr FROM o),
            y AS (SELECT dg / n AS y1, sq / (n * (n - 1)) AS y2, o / (n * (n - 1)) AS y3, (rr - sq) / (n * (n - 1) * (n - 2)) AS y4, (o * o - 4 * rr + 2 * sq) / (n * (n - 1) * (n - 2) * (n - 3)) AS y5, n FROM q, w, n)
            SELECT round(y1, {DIGITS}) AS y1, round(y2, {DIGITS}) AS y2, round(y3, {DIGITS}) AS y3, round(y4, {DIGITS}) AS y4, round(y5, {DIGITS}) AS y5,
              round(n * (64 * (y2 - 2 * y4 + y5) / pow(y1 - y3, 2) - 1) / 2, {DIGITS}) AS statistic FROM y""",
        "q_fisher_sun_gallagher": f"""{_ONE}, q AS (SELECT a.i, b.j, sum(a.s * b.s) AS q FROM s a JOIN s b ON a.j = b.i GROUP BY 1, 2),
            t AS (SELECT sum(CASE WHEN s.i = s.j THEN s END) AS t1, sum(s * s) AS t2, sum(s * q) AS t3, sum(q * q) AS t4, max(n) - 1.0::DOUBLE AS n, 64.0::DOUBLE AS p FROM s JOIN q ON s.i = q.i AND s.j = q.j),
            a AS (SELECT n, p, n * n / ((n - 1) * (n + 2) * p) * (t2 - t1 * t1 / n) AS a2, n * n * n * n * n * (n * n + n + 2) / ((n + 1) * (n + 2) * (n + 4) * (n + 6) * (n - 1) * (n - 2) * (n - 3)) / p
              * (t4 - 4 / n * t3 * t1 - (2 * n * n + 3 * n - 6) / (n * (n * n + n + 2)) * t2 * t2 + 2 * (5 * n + 6) / (n * (n * n + n + 2)) * t2 * t1 * t1 - (5 * n + 6) / (n * n * (n * n + n + 2)) * pow(t1, 4)) AS a4 FROM t)
            SELECT round(sqrt(n * p / (8 * (8 + 12 * p / n + p * p / n / n))) * (a4 / (a2 * a2) - 1), {DIGITS}) AS statistic, round(a4 / (a2 * a2), {DIGITS}) AS psi FROM a""",
        "q_sign_sum_sphericity": f"""{_SIGNS}, x AS (SELECT max(p) / (max(n) * (max(n) - 1)) * (max(n * n) * sum(b * b) - max(n)) - 1 AS q FROM b, k)
            SELECT round((q - p * ((2 - 2 * r2 + r2 * r2) / n / n + (8 * r2 - 6 * r2 * r2 + 2 * r2 * r3 - 2 * r3) / n / n / n)) / sqrt(4 * (p - 1) / (n * (n - 1) * (p + 2))), {DIGITS}) AS statistic, round(q, {DIGITS}) AS raw FROM x, k""",
        "q_sign_max_sphericity": f"""{_SIGNS}, x AS (SELECT max(n * p * (p + 2) * CASE WHEN i = j THEN pow(b - 1 / p, 2) / (2 * (1 - 1 / p)) ELSE b * b END) AS g, max(p * (p + 1) / 2) AS c FROM b, k)
            SELECT round(g - 2 * ln(c) + ln(ln(c)), {DIGITS}) AS statistic, round(g, {DIGITS}) AS raw FROM x""",
        "q_regularized_sign_covariance": f"""{_SIGNS}, a AS (SELECT max(p) * sum(b * b) AS a FROM b, k), w AS (SELECT least(1, greatest(0, (n / (n - 1) * (a - p / n) - 1) / (a - 1))) AS w FROM a, k)
            SELECT i::INTEGER AS i, j::INTEGER AS j, round(w * p * b + CASE WHEN i = j THEN 1 - w ELSE 0 END, {DIGITS}) + 0.0 AS v FROM b, w, k""",
        "q_covariance_threshold": f"""{_ONE} SELECT i::INTEGER AS i, j::INTEGER AS j, CASE WHEN abs(s * (n - 1) / n) > sqrt(ln(64) / n) THEN round(s * (n - 1) / n, {DIGITS}) ELSE 0.0 END AS v FROM s""",
        "q_cusum": f"""{_SUMS}, c AS (SELECT k, abs(r.s - k / n::DOUBLE * n.s) / sqrt(n) / sqrt(v) AS c, v, n FROM r, n)
            SELECT round(max(c), {DIGITS}) AS statistic, arg_max(k, c) AS k, round(max(v), {DIGITS}) AS sigma2 FROM c WHERE k BETWEEN 1 AND n - 1""",
        "q_portmanteau": f"""{_SUMS}, g AS (SELECT b.k - a.k AS h, sum((a.value - m) * (b.value - m)) AS g FROM r a JOIN r b ON b.k BETWEEN a.k AND a.k + 5, n GROUP BY 1)
            SELECT round(max(n * (n + 2.0)) * sum(g.g * g.g / (z.g * z.g) / (n - g.h)), {DIGITS}) AS statistic FROM g, (SELECT g FROM g WHERE h = 0) z, n WHERE g.h > 0""",
    }
