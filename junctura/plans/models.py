"""Scoring jobs with Spark ML. The driver loops over folds and feature sets only;
fitting and scoring are distributed."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F

from junctura.operators.evaluation import grouped_recall, grouped_spearman, tweedie_deviance
from junctura.operators.folds import block_folds, stratified_folds
from junctura.operators.ranking import rank_average, ranked, running_totals
from junctura.operators.resampling import hash_int, replicates
from junctura.plans.history import FEATURES
from junctura.session import attach, stage


# The named feature groups, in the order in which they are added.
FEATURE_GROUPS = {
    "crash_only": FEATURES,
    "geometry": ["edge_count", "lane_count", "approach_asymmetry", "intersection_type"],
    "control": ["signal_present", "stop_control"],
    "roadway": ["functional_class", "freeway_proximity", "speed_limit"],
    "active_transport": ["bike_lane_present", "transit_proximity"],
    "terrain": ["slope_pct"],
}


def feature_sets(groups: dict[str, list[str]] = FEATURE_GROUPS) -> dict[str, list[str]]:
    """Cumulative sets (crash history, then one more group each time) and independent
    ones (crash history with a single group)."""
    base, *more = groups
    sets, so_far = {base: list(groups[base])}, list(groups[base])
    for g in more:
        so_far = so_far + groups[g]
        sets[f"up_to_{g}"] = so_far
    return sets | {f"{base}_and_{g}": groups[base] + groups[g] for g in more[1:]}


def persistence_score(crashes: Column, slope: Column) -> Column:
    """Event count with the trend as tie-break; remaining ties go to the id."""
    return crashes.cast("double") + F.coalesce(slope, F.lit(0.0)) / 100.0


def frequency_score(crashes: Column) -> Column:
    return F.coalesce(crashes, F.lit(0)).cast("double")


def _pipe(features: list[str], estimator, scaled: bool = True) -> Pipeline:
    stages = [VectorAssembler(inputCols=features, outputCol="raw_features", handleInvalid="keep")]
    if scaled:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="scaled_features", withMean=True, withStd=True))
    estimator = estimator.copy().setFeaturesCol("scaled_features" if scaled else "raw_features")
    return Pipeline(stages=[*stages, estimator])


def tweedie_glm(label: str, power: float = 1.3, offset: str | None = None, reg: float = 1e-3) -> GeneralizedLinearRegression:
    """Count regression with a log link; the offset turns it into a rate model."""
    g = GeneralizedLinearRegression(family="tweedie", variancePower=power, linkPower=0.0, labelCol=label,
                                    regParam=reg, maxIter=25, predictionCol="prediction")
    return g.setOffsetCol(offset) if offset else g


def forest_counts(label: str) -> RandomForestRegressor:
    return RandomForestRegressor(labelCol=label, numTrees=50, maxDepth=8, seed=42)


def logistic(label: str, reg: float = 1.0) -> LogisticRegression:
    return LogisticRegression(labelCol=label, weightCol="class_weight", regParam=reg, elasticNetParam=0.0, maxIter=100)


def boosted_binary(label: str) -> GBTClassifier:
    return GBTClassifier(labelCol=label, weightCol="class_weight", maxDepth=3, maxIter=20, subsamplingRate=0.8, seed=42)


def balanced(df: DataFrame, label: str) -> DataFrame:
    """``class_weight`` = n / (2 n_class), from one aggregate."""
    n = df.agg(F.count("*").alias("_n"), F.sum(F.col(label).cast("double")).alias("_p"))
    w = F.when(F.col(label) == 1, F.col("_n") / (2 * F.greatest("_p", F.lit(1.0)))).otherwise(
        F.col("_n") / (2 * F.greatest(F.col("_n") - F.col("_p"), F.lit(1.0))))
    return attach(df, n).withColumn("class_weight", w).drop("_n", "_p")


def _score_col(model_output: DataFrame) -> Column:
    if "probability" in model_output.columns:
        return vector_to_array("probability")[1]
    return F.col("prediction")


def _side_by_side(jobs: list[Callable[[], DataFrame]], workers: int = 8) -> list[DataFrame]:
    """Small fits leave most of a cluster idle, so a few are submitted at once; results keep their order."""
    with ThreadPoolExecutor(workers) as pool:
        return list(pool.map(lambda job: job(), jobs))


def out_of_fold(df: DataFrame, features: list[str], estimator, sid: str, fold: str, k: int,
                keep: list[str] = (), out: str = "oof_score", scaled: bool = True, staged: bool = False) -> DataFrame:
    """Exactly one held-out score per row: fit on the other folds, score this one.
    ``staged``: ``df`` is written and without nulls already."""
    base = df if staged else stage(df.fillna(0.0, features), "oof")
    parts = []
    for i in range(k):
        model = _pipe(features, estimator, scaled).fit(base.where(F.col(fold) != i))
        scored = model.transform(base.where(F.col(fold) == i))
        parts.append(scored.select(sid, fold, *keep, _score_col(scored).alias(out)))
    return reduce(DataFrame.unionByName, parts)


def predict_forward(train: DataFrame, test: DataFrame, features: list[str], estimator, label: str, key: list[str], keep: list[str]) -> DataFrame:
    """Scores of a later window's candidates by a model of an earlier one. ``key`` names a
    row (site and window): a row in both tables is an error, and the label of the scored window is dropped before the fit."""
    both = train.select(*key).join(test.select(*key), key, "left_semi")
    if not both.isEmpty():
        raise ValueError("the scored window shares rows with training")
    return fit_predict(train, test.drop(label), features, estimator, keep)


def fit_predict(train: DataFrame, test: DataFrame, features: list[str], estimator, keep: list[str], scaled: bool = True,
                out: str = "score") -> DataFrame:
    """Fit once on one window, predict only on another: the second window's labels
    are never read."""
    model = _pipe(features, estimator, scaled).fit(train.fillna(0.0, features))
    scored = model.transform(test.fillna(0.0, features))
    return scored.select(*keep, _score_col(scored).alias(out))


def choose_by_blocks(df: DataFrame, features: list[str], label: str, sid: str, fold: str, k: int, power: float = 1.3,
                     grid: tuple[float, ...] = (0.0, 1e-3, 1e-2, 1e-1, 1.0)) -> DataFrame:
    """(reg_param, cv_metric, chosen): mean Tweedie deviance over held-out blocks for each
    penalty; the smallest wins, then the smaller penalty. All fits write to one table of
    scores, and one aggregate gives the deviance of every (parameter, fold)."""
    base = stage(df.select(sid, fold, label, *features).fillna(0.0, features), "search")
    parts = _side_by_side([lambda r=r: out_of_fold(base, features, tweedie_glm(label, power, reg=r), sid, fold, k, keep=[label], staged=True).withColumn("reg_param", F.lit(float(r))) for r in grid])
    per = reduce(DataFrame.unionByName, parts).groupBy("reg_param", fold).agg(tweedie_deviance(F.col(label), F.col("oof_score"), power).alias("dev"))
    per = per.groupBy("reg_param").agg(F.avg("dev").alias("cv_metric"), F.count("*").alias("n_folds"))
    best = per.agg(F.min(F.struct("cv_metric", "reg_param"))["reg_param"].alias("_best"))
    return attach(per, best).withColumn("chosen", F.col("reg_param") == F.col("_best")).drop("_best")


def ablation(df: DataFrame, sets: dict[str, list[str]], label: str, sid: str, splits: dict[str, str], k: int, power: float = 1.3,
             ks: tuple[int, ...] = (100, 500)) -> DataFrame:
    """Long table (split, feature_set, n_features, spearman_rho, recalls) with frozen
    parameters; ``splits`` maps a split's name to its fold column. All scores go to one
    table, measured once by (split, feature set)."""
    base = stage(df.fillna(0.0, sorted({c for cols in sets.values() for c in cols})), "ablation")
    parts = _side_by_side([lambda split=split, fold=fold, name=name, cols=cols: out_of_fold(base, cols, tweedie_glm(label, power), sid, fold, k, keep=[label], staged=True).select(
        sid, label, "oof_score", F.lit(split).alias("split"), F.lit(name).alias("feature_set"), F.lit(len(cols)).alias("n_features"))
        for split, fold in splits.items() for name, cols in sets.items()])
    x = stage(reduce(DataFrame.unionByName, parts), "ablation_scores").withColumn("hit", (F.col(label) >= 1).cast("int"))
    keys = ["split", "feature_set", "n_features"]
    return grouped_spearman(x, keys, "oof_score", label).join(grouped_recall(x, keys, "oof_score", sid, "hit", ks), keys)


def glm_contributions(df: DataFrame, features: list[str], label: str, sid: str, power: float = 1.3, reg: float = 1e-3) -> tuple[DataFrame, list[str]]:
    """Per-row contributions coef * (x - mean) on the link scale, one column per
    feature, and ``link_score``: their sum and ``base_value``, the score at the means. Exact
    for a linear predictor. The driver reads one coefficient vector."""
    base = df.fillna(0.0, features)
    model = _pipe(features, tweedie_glm(label, power, reg=reg)).fit(base)
    scaler, glm = model.stages[1], model.stages[2]
    mean, std, coef = scaler.mean.toArray(), scaler.std.toArray(), glm.coefficients.toArray()
    names = [f"c_{f}" for f in features]
    cols = [((F.col(f) - float(m)) / float(s) * float(c) if s > 0 else F.lit(0.0)).alias(n)
            for f, n, m, s, c in zip(features, names, mean, std, coef)]
    out = base.select(sid, *features, *cols, F.lit(float(glm.intercept)).alias("base_value"))
    return out.withColumn("link_score", reduce(lambda a, n: a + F.col(n), names, F.col("base_value"))), names


def importance(contrib: DataFrame, names: list[str], groups: dict[str, str] = {}) -> DataFrame:
    """Mean absolute contribution per feature, its group and the group's sum."""
    one = contrib.agg(*[F.avg(F.abs(n)).alias(n) for n in names])
    long = one.select(F.explode(F.array(*[
        F.struct(F.lit(n[2:]).alias("feature"), F.lit(groups.get(n[2:], "crash_history")).alias("group"), F.col(n).alias("mean_abs"))
        for n in names])).alias("r")).select("r.*")
    return long.withColumn("group_mean_abs", F.sum("mean_abs").over(Window.partitionBy("group")))  # a row per feature


def two_stage(df: DataFrame, features: list[str], freq: str, share: str, sid: str, fold: str, k: int, keep: list[str] = (), reg: float = 1e-3) -> DataFrame:
    """Expected count times expected severe share, both held out."""
    a = out_of_fold(df, features, tweedie_glm(freq, reg=reg), sid, fold, k, keep=list(keep), out="freq_hat")
    b = out_of_fold(df, features, GeneralizedLinearRegression(family="gaussian", link="identity", labelCol=share, regParam=reg),
                    sid, fold, k, out="share_hat")
    return a.join(b.drop(fold), sid).withColumn(
        "score", F.col("freq_hat") * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("share_hat"))))


def split_estimates(df: DataFrame, score: str, sid: str, label: str, split: str, fold: str,
                    thresholds: tuple[int, ...], ks: tuple[int, ...]) -> DataFrame:
    """(split, threshold, estimate): ``folds`` averages the metrics of the folds that
    have positives at the threshold, ``pooled`` takes their rows as one list.

    Rows appear once for their fold and once for the pool, and one global order by (split,
    fold or pool, score) serves all thresholds: a threshold is a pair of running totals
    (rows of folds with positives, positives), so ranks, ties and cuts are read off the same order."""
    powered = df.groupBy(split, fold).agg(*[(F.max(label) >= t).cast("int").alias(f"_e{t}") for t in thresholds])
    x = df.select(sid, split, fold, F.col(score).alias("_s"), F.col(label).alias("_l")).join(powered, [split, fold])
    x = x.withColumn("_scope", F.explode(F.array(F.col(fold).cast("int"), F.lit(-1)))).select(
        split, "_scope", "_s", sid, "_l", *[F.col(f"_e{t}").cast("bigint").alias(f"_e{t}") for t in thresholds],
        *[(F.col("_l") >= t).cast("bigint").alias(f"_p{t}") for t in thresholds])  # a fold with positives is eligible, so _p implies _e
    run = running_totals(x, [(split, False), ("_scope", False), ("_s", True), (sid, False)],
                         {f"_c{m}{t}": f"_{m}{t}" for t in thresholds for m in ("e", "p")})
    first = run.groupBy(split, "_scope").agg(*[(F.min(F.col(f"_c{m}{t}") - F.col(f"_{m}{t}"))).alias(f"_f{m}{t}") for t in thresholds for m in ("e", "p")],
                                             *[F.sum(f"_{m}{t}").alias(f"_n{m}{t}") for t in thresholds for m in ("e", "p")])
    run = run.join(first, [split, "_scope"])
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), *[F.col(f"_{a}{t}").alias(a) for a in ("e", "p", "ce", "cp", "fe", "fp", "ne", "np")]) for t in thresholds]))
    long = run.select(split, "_scope", "_s", "_l", each.alias("t")).select(
        split, "_scope", "_s", "_l", "t.threshold", "t.p", "t.ne", "t.np", (F.col("t.ce") - F.col("t.fe")).alias("pos"), (F.col("t.cp") - F.col("t.fp")).alias("cum"), "t.e").where("e = 1")
    keys = [split, "_scope", "threshold"]
    ties = long.groupBy(*keys, "_s").agg(F.sum("p").alias("p"), F.count("*").alias("n"), F.max("cum").alias("cp"), F.max("pos").alias("cn"), F.max("np").alias("np"), F.max("ne").alias("ne"),
                                         *[F.sum(F.when(F.col("pos") <= k, F.col("p")).otherwise(0)).alias(f"h{k}") for k in ks])
    curve = ties.groupBy(*keys).agg((F.sum(F.col("p") * F.col("cp") / F.col("cn")) / F.max("np")).alias("auprc"),
                                    *[(F.sum(f"h{k}") / F.greatest(F.max("np"), F.lit(1))).alias(f"recall_{k}") for k in ks])
    # mid-ranks: of scores from the order, of labels from their counts
    labels = long.groupBy(*keys, "_l").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("_l").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # distinct labels
    labels = labels.select(*keys, "_l", (upto - (F.col("n") - 1) / 2).alias("rb"))
    cells = long.groupBy(*keys, "_s", "_l").agg(F.count("*").alias("w"))
    ranks = cells.join(ties.select(*keys, "_s", (F.col("ne") + 1 - (F.col("cn") - (F.col("n") - 1) / 2)).alias("ra"), "ne"), [*keys, "_s"]).join(labels, [*keys, "_l"])
    da, db, w = F.col("ra") - (F.col("ne") + 1) / 2, F.col("rb") - (F.col("ne") + 1) / 2, F.col("w")
    rho = ranks.groupBy(*keys).agg(F.coalesce(F.sum(da * db * w) / F.nullif(F.sqrt(F.sum(da * da * w) * F.sum(db * db * w)), F.lit(0.0)), F.lit(0.0)).alias("spearman_rho"))
    m = curve.join(rho, keys)
    pooled = F.when(F.col("_scope") == -1, "pooled").otherwise("folds")
    return m.groupBy(split, "threshold", pooled.alias("estimate")).agg(
        F.count("*").alias("n_folds"), F.avg("spearman_rho").alias("spearman_rho"), F.avg("auprc").alias("auprc"), *[F.avg(f"recall_{k}").alias(f"recall_{k}") for k in ks])


def arms_over_seeds(df: DataFrame, features: list[str], label: str, sid: str, baseline: str, stratum: str, block: str, *,
                    seeds: tuple[int, ...], k: int, power: float = 1.3) -> DataFrame:
    """(split, arm, seed, site, label, score) of one long table: a model per seed and split
    with folds dealt by that seed, the deterministic baseline once, and the rank average of
    the first seed's model with it."""
    base = stage(df.select(sid, label, stratum, block, baseline, *features).fillna(0.0, features), "arms")
    def held_out(seed: int, split: str) -> DataFrame:
        t = stratified_folds(base, sid, stratum, k, seed) if split == "random" else block_folds(base, block, k, seed=seed)
        oof = out_of_fold(t, features, tweedie_glm(label, power), sid, "fold", k, keep=[label])
        return oof.select(F.lit(split).alias("split"), F.lit("model").alias("arm"), F.lit(seed).alias("seed"), sid, label, F.col("oof_score").alias("score"))

    parts = _side_by_side([lambda seed=seed, split=split: held_out(seed, split) for seed in seeds for split in ("random", "spatial")])
    model = stage(reduce(DataFrame.unionByName, parts), "arm_scores")
    flat = base.select(F.explode(F.array(F.lit("random"), F.lit("spatial"))).alias("split"), F.lit("baseline").alias("arm"), F.lit(seeds[0]).alias("seed"), sid, label, F.col(baseline).cast("double").alias("score"))
    first = [model.where((F.col("seed") == seeds[0]) & (F.col("split") == split)).select(sid, F.col("score").alias("m")).join(base.select(sid, label, F.col(baseline).alias("b")).hint("merge"), sid) for split in ("random", "spatial")]
    both = [rank_average(t, ["m", "b"], sid, "score").join(t.select(sid, label).hint("merge"), sid).select(F.lit(split).alias("split"), F.lit("ensemble").alias("arm"), F.lit(seeds[0]).alias("seed"), sid, label, "score")
            for split, t in zip(("random", "spatial"), first, strict=True)]
    return stage(reduce(DataFrame.unionByName, [model, flat, *both]), "arms_long")


def compare_arms(arms: DataFrame, label: str, sid: str, *, k: int, draws: int, reference: str = "baseline") -> DataFrame:
    """(split, arm): mean and population deviation of recall@k and rank correlation over
    seeds, the paired difference of the first seed's recall to ``reference`` with its 95 %
    interval, and adoption: the interval lies above zero on both splits."""
    x = arms.withColumn("hit", (F.col(label) >= 1).cast("int"))
    keys = ["split", "arm", "seed"]
    per = grouped_recall(x, keys, "score", sid, "hit", (k,)).join(grouped_spearman(x, keys, "score", label), keys)
    level = per.groupBy("split", "arm").agg(F.count("*").alias("n_seeds"), F.avg(f"recall_{k}").alias("recall"), F.stddev_pop(f"recall_{k}").alias("recall_sd"), F.avg("spearman_rho").alias("spearman_rho"))
    # positives of the first seed: whether each arm has them in its list; draws share the positives across arms
    one = x.join(x.groupBy("split", "arm").agg(F.min("seed").alias("seed")), keys, "left_semi")
    w = Window.partitionBy("split", "arm").orderBy(F.desc("score"), sid)
    top = one.select(*keys, sid, F.row_number().over(w).alias("pos")).where(F.col("pos") <= k)  # limited before the shuffle
    held = one.where("hit = 1").join(top.select("split", "arm", sid, F.lit(1.0).alias("in_list")), ["split", "arm", sid], "left").fillna(0.0, ["in_list"])
    ref = held.where(F.col("arm") == reference).select("split", sid, F.col("in_list").alias("ref"))
    paired = held.where(F.col("arm") != reference).join(ref.hint("merge"), ["split", sid])
    pos = ranked(paired.select(sid).distinct(), [(sid, False)], "_i")
    n = pos.agg(F.count("*").alias("_n"))
    dealt = attach(replicates(pos.select(F.col("_i").alias("i")), draws), n)
    dealt = dealt.select("b", (hash_int(F.lit("pd"), F.col("b"), F.col("i")) % F.col("_n") + 1).alias("_i")).groupBy("b", "_i").agg(F.count("*").alias("times"))
    d = paired.join(pos.hint("merge"), sid).join(dealt.hint("merge"), "_i").groupBy("split", "arm", "b").agg((F.sum(F.col("times") * (F.col("in_list") - F.col("ref"))) / F.sum("times")).alias("d"))
    delta = d.groupBy("split", "arm").agg(F.avg("d").alias("delta"), F.percentile("d", 0.025).alias("lo"), F.percentile("d", 0.975).alias("hi"), F.avg((F.col("d") > 0).cast("double")).alias("p_better"))
    adopt = delta.groupBy("arm").agg(F.min(F.col("lo") > 0).alias("adopt"))
    return level.join(delta, ["split", "arm"], "left").join(adopt, "arm", "left").select("split", "arm", "n_seeds", "recall", "recall_sd", "spearman_rho", "delta", "lo", "hi", "p_better", F.coalesce("adopt", F.lit(False)).alias("adopt"))
