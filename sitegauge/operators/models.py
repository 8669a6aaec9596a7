"""Model stages on Spark ML: imputation, residual stack, intervals, calibration, checks (ML-*)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import PCA, Imputer, RobustScaler, StandardScaler, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.scalar import only_row
from sitegauge.operators.profiles import error_metrics
from sitegauge.operators.quantiles import group_quantiles
from sitegauge.operators.windows import ordered_position, quartile_band
from sitegauge.session import cut_lineage, spread

SEED = 42


def hash_share(id: str, salt: str = "split") -> Column:
    """A fixed number in [0, 1) per id."""
    return hash_number(F.concat(F.lit(salt + "|"), F.col(id).cast("string")), 8) / 2**32


def hash_number(text: Column, digits: int = 15) -> Column:
    """The first hex digits of the text's md5 as a whole number, the same in any engine; null counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, digits), 16, 10).cast("long")


#: Boosting rounds of every model unless a caller asks for others.
ROUNDS = 20
#: Models fitted at the same time.
SIDE_BY_SIDE = 4


def assembler(features: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep")


def regressor(label: str, prediction: str, features: str = "features", iterations: int = ROUNDS, weight: str | None = None) -> GBTRegressor:
    model = GBTRegressor(featuresCol=features, labelCol=label, predictionCol=prediction, maxIter=iterations, maxDepth=3, maxBins=64, seed=SEED, stepSize=0.3)
    return model.setWeightCol(weight) if weight else model


def fit_on_train_transform_all(train: DataFrame, rows: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """Median imputation and scaling fitted on the training rows only."""
    return _scaling(train, features, out).transform(rows).drop("_raw", *[f"_f_{c}" for c in features])


def _scaling(train: DataFrame, features: Sequence[str], out: str):
    filled = [f"_f_{c}" for c in features]
    steps = [
        Imputer(inputCols=list(features), outputCols=filled, strategy="median"),
        VectorAssembler(inputCols=filled, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol=out, withMean=True),
    ]
    return Pipeline(stages=steps).fit(train)


def impute_columns(df: DataFrame, targets: Sequence[str], predictors: Sequence[str], id: str, min_known: int = 150) -> tuple[DataFrame, DataFrame]:
    """Fill each target's nulls from a regression on the predictors, and report held-out errors.

    One pass counts what is known; targets with too little take their median.
    """
    known = df.agg(*[F.count(c).alias(c) for c in targets]).first().asDict()
    report = None
    df = assembler(predictors, "_x").transform(df)
    for c in targets:
        if known[c] < min_known:
            df = df.withColumn(c, F.coalesce(F.col(c), group_quantiles(df, [], c, [0.5]).scalar()))
            continue
        rows = df.filter(F.col(c).isNotNull())
        held = hash_share(id, c) < 0.2
        model = regressor(c, "_p", "_x").fit(rows.filter(~held))
        metrics = model.transform(rows.filter(held)).agg(*[m.alias(n) for n, m in error_metrics(c, "_p").items()])
        metrics = metrics.withColumn("target", F.lit(c))
        report = metrics if report is None else report.unionByName(metrics)
        df = model.transform(df).withColumn(c, F.coalesce(F.col(c), F.col("_p"))).drop("_p")
    return df.drop("_x"), report


def rank_features(train: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(feature, importance) of a probe model, largest first."""
    model = regressor(label, "_p").fit(assembler(features).transform(train))
    rows = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray(), strict=True)]
    return train.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def compress_tail(train: DataFrame, rows: DataFrame, ranked: Sequence[str], keep: int, components: int) -> DataFrame:
    """Keep the leading features; robust-scale the rest and replace them by principal components."""
    tail = list(ranked[keep:])
    steps = [
        VectorAssembler(inputCols=tail, outputCol="_tail"),
        RobustScaler(inputCol="_tail", outputCol="_scaled", lower=0.05, upper=0.95, withCentering=True),
        PCA(k=min(components, len(tail)), inputCol="_scaled", outputCol="_pca"),
    ]
    out = Pipeline(stages=steps).fit(train).transform(rows)
    parts = vector_to_array("_pca")
    return out.withColumns({f"tail_{i}": parts[i] for i in range(min(components, len(tail)))}).drop("_tail", "_scaled", "_pca", *tail)


def project_regimes(train: DataFrame, rows: DataFrame, features: Sequence[str], k: int = 5) -> DataFrame:
    scaling, extra = _scaling(train, features, "_regime_x"), ["_raw", *[f"_f_{c}" for c in features]]
    model = KMeans(k=k, seed=SEED, featuresCol="_regime_x", predictionCol="regime").fit(scaling.transform(train))
    return model.transform(scaling.transform(rows)).drop("_regime_x", *extra)


def group_oof(df: DataFrame, group: str, k: int, fit: Callable[[DataFrame], object], prediction: str, out: str) -> DataFrame:
    """Out-of-fold predictions; a whole group is always in one fold."""
    fold = F.pmod(F.xxhash64(F.col(group).cast("string")), F.lit(k))
    folded = cut_lineage(df.withColumn("_fold", fold))  # read once, not twice a fold
    parts = None
    for i in range(k):
        model = fit(folded.filter(F.col("_fold") != i))
        scored = model.transform(folded.filter(F.col("_fold") == i)).withColumnRenamed(prediction, out)
        parts = scored if parts is None else parts.unionByName(scored)
    return parts.drop("_fold")


def flag_unlearnable(oof: DataFrame, actual: str, predicted: str, threshold: float) -> DataFrame:
    return oof.withColumn("unlearnable", (F.abs(F.col(predicted) - F.col(actual)) > threshold).cast("int"))


def residual_stack(train: DataFrame, rows: DataFrame, features: Sequence[str], label: str, cohorts: Mapping[str, str]) -> DataFrame:
    """Base model, a residual head per cohort, then a scale corrector on what is left; their sum.

    Every stage is trained on the previous stage's residual; stage outputs are written to the
    checkpoint folder so lost executors do not replay the whole chain.
    """
    train, rows = (assembler(features).transform(d) for d in (train, rows))
    train = spread(train)
    base = regressor(label, "base").fit(train)
    train, rows = (cut_lineage(base.transform(d)) for d in (train, rows))
    train = train.withColumn("_left", F.col(label) - F.col("base"))

    def fitted_head(name: str):
        part = train.filter(F.expr(cohorts[name]))
        return regressor("_left", f"head_{name}").fit(part) if part.take(1) else None

    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        models = dict(zip(cohorts, pool.map(fitted_head, cohorts), strict=True))
    heads = []
    scored = train
    for name, head in models.items():
        if head is not None:
            gate = F.expr(cohorts[name])
            scored, rows = (head.transform(d).withColumn(f"head_{name}", F.when(gate, F.col(f"head_{name}")).otherwise(0.0)) for d in (scored, rows))
            heads.append(f"head_{name}")
    total = sum((F.col(h) for h in heads), F.lit(0.0))
    train = cut_lineage(scored.withColumn("_left", F.col("_left") - total))
    outputs = assembler(["base", *heads], "_stages")
    scale = LinearRegression(featuresCol="_stages", labelCol="_left", predictionCol="corrector", regParam=1.0, elasticNetParam=0.0)
    fitted = scale.fit(outputs.transform(train))
    rows = fitted.transform(outputs.transform(rows)).drop("_stages", "features")
    return rows.withColumn("prediction", F.col("base") + total + F.col("corrector"))


def stratified_models(train: DataFrame, rows: DataFrame, features: Sequence[str], label: str, band: str, bands: Sequence[str], min_rows: int = 10) -> DataFrame:
    """One model per band, each row scored by its own; null for bands with too few rows to learn from."""
    train, rows = (assembler(features).transform(d) for d in (train, rows))
    sizes = {r[0]: r[1] for r in train.filter(F.col(band).isin(list(bands))).groupBy(band).count().collect()}
    out = rows.filter(~F.col(band).isin([b for b in bands if sizes.get(b, 0) >= min_rows])).withColumn("stratum_prediction", F.lit(None).cast("double"))
    for b in bands:
        if sizes.get(b, 0) >= min_rows:
            model = regressor(label, "stratum_prediction").fit(train.filter(F.col(band) == b))
            out = out.unionByName(model.transform(rows.filter(F.col(band) == b)))
    return out.drop("features")


def catastrophe_classifier(train: DataFrame, rows: DataFrame, features: Sequence[str], error: str) -> DataFrame:
    """Chance that a row's error exceeds the training errors' 90 % quantile; classes weighted to balance."""
    edge = group_quantiles(train, [], error, [0.9]).scalar()
    labelled = train.withColumn("_bad", (F.col(error) > edge).cast("double"))
    share = labelled.agg(F.avg("_bad")).scalar()
    labelled = labelled.withColumn("_w", F.when(F.col("_bad") == 1, F.try_divide(F.lit(0.5), share)).otherwise(F.try_divide(F.lit(0.5), 1 - share)))
    model = GBTClassifier(featuresCol="features", labelCol="_bad", weightCol="_w", maxIter=ROUNDS, maxDepth=3, seed=SEED)
    scored = model.fit(assembler(features).transform(labelled)).transform(assembler(features).transform(rows))
    return scored.withColumn("catastrophe_probability", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction", "features")


def interval_by_band(oof: DataFrame, rows: DataFrame, actual: str, predicted: str, band: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """p10 and p90 from the out-of-fold residual quantiles of the row's band."""
    residuals = oof.withColumn("_res", F.col(actual) - F.col(predicted))
    edges = group_quantiles(residuals, [band], "_res", [low, high], ["_lo", "_hi"])
    out = rows.join(edges.withColumnRenamed(band, "_band"), F.col(band).eqNullSafe(F.col("_band")), "left").drop("_band")
    return out.withColumns({"p10": F.col(predicted) + F.col("_lo"), "p90": F.col(predicted) + F.col("_hi")}).drop("_lo", "_hi")


def terminal_calibrator(validation: DataFrame, rows: DataFrame, features: Sequence[str], actual: str, predicted: str, edge: float = 50.0) -> DataFrame:
    """Probabilities that a prediction runs over, is accurate, or runs under; fitted on validation rows."""
    residual = F.col(actual) - F.col(predicted)
    labelled = validation.withColumn("_class", F.when(residual < -edge, 0.0).when(residual <= edge, 1.0).otherwise(2.0))
    model = LogisticRegression(featuresCol="features", labelCol="_class", family="multinomial", maxIter=20, regParam=0.01, probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred")
    scored = model.fit(assembler(features).transform(labelled)).transform(assembler(features).transform(rows))
    p = vector_to_array("_prob")
    return scored.withColumns({"p_over": p[0], "p_accurate": F.get(p, F.lit(1)), "p_under": F.coalesce(F.get(p, F.lit(2)), F.lit(0.0))}).drop("_prob", "_raw", "_pred", "features")


def sample_weights(df: DataFrame, error: str, age_days: str, edges: Sequence[float]) -> DataFrame:
    """Inverse frequency of the row's error bin, times a maturity weight clip(age / 365, 0.1, 1)."""
    bin_ = sum(((F.col(error) >= e).cast("int") for e in edges), F.lit(0))
    binned = df.withColumn("error_bin", bin_)
    counts = binned.groupBy("error_bin").agg(F.count(F.lit(1)).alias("_n"))
    total = only_row(counts.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_bins")))
    out = binned.join(F.broadcast(counts), "error_bin").withColumns({"_all": total["_all"], "_bins": total["_bins"]})
    maturity = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.col(age_days) / 365))
    return out.withColumns({
        "frequency_weight": F.col("_all") / (F.col("_bins") * F.col("_n")), "maturity_weight": maturity,
        "weight": F.col("_all") / (F.col("_bins") * F.col("_n")) * maturity,
    }).drop("_n", "_all", "_bins")


def stratified_split(df: DataFrame, id: str, target: str, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """Exact shares per target quartile, rows in each taken in hash order; rows without a target are a stratum too."""
    banded = quartile_band(df, target, "_q").withColumn("_h", hash_number(F.col(id).cast("string")))
    placed = ordered_position(banded, ["_q"], "_h", id, "_pos")
    share = F.col("_pos") / F.col("group_size")
    split = F.when(share <= train, "train").when(share <= train + validation, "validation").otherwise("test")
    return placed.withColumn("split", split).drop("_q", "_h", "_pos", "group_size")


def tune(train: DataFrame, features: Sequence[str], label: str, fold: str, depths: Sequence[int], folds: int = 5) -> DataFrame:
    """(depth, rmse) from cross-validation over a given fold column, 0 to ``folds`` - 1 and none of them empty."""
    outside = F.raise_error(F.printf(F.lit(f"Fold number must be in range [0, {folds}), but got %s"), F.col(fold)))
    numbered = F.when((F.col(fold) >= 0) & (F.col(fold) < folds), F.col(fold)).otherwise(outside)
    data = spread(assembler(features).transform(train).select("features", label, numbered.alias("_fold")))
    found = {r[0] for r in data.select("_fold").distinct().collect()}
    for i in range(folds):
        if i not in found or found == {i}:
            raise ValueError(f"no rows to learn from or none to test on at fold {i}")
    evaluator = RegressionEvaluator(labelCol=label, metricName="rmse")

    def held_out(job: tuple[int, int]) -> float:
        depth, i = job
        model = regressor(label, "prediction").setMaxDepth(depth).fit(data.filter(F.col("_fold") != i))
        return evaluator.evaluate(model.transform(data.filter(F.col("_fold") == i)))

    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        errors = list(pool.map(held_out, [(d, i) for d in depths for i in range(folds)]))
    scores = [sum(errors[k * folds : (k + 1) * folds]) / folds for k in range(len(depths))]
    return train.sparkSession.createDataFrame([(int(d), float(s)) for d, s in zip(depths, scores, strict=True)], "depth int, rmse double")


def variance_filter(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Drop constant columns."""
    x = assembler(features, "_x").transform(df)
    model = VarianceThresholdSelector(featuresCol="_x", outputCol="_y", varianceThreshold=0.0).fit(x)
    keep = set(model.selectedFeatures)
    return df.drop(*[c for i, c in enumerate(features) if i not in keep])


def _yeo_johnson(x: Column, lam: float) -> Column:
    positive = F.log1p(F.abs(x)) if abs(lam) < 1e-9 else (F.pow(F.abs(x) + 1, F.lit(lam)) - 1) / lam
    negative = -F.log1p(F.abs(x)) if abs(lam - 2) < 1e-9 else -(F.pow(F.abs(x) + 1, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, positive).otherwise(negative)


def yeo_johnson(df: DataFrame, column: str, out: str, grid: Sequence[float] = tuple(i / 10 for i in range(-20, 41, 2))) -> tuple[DataFrame, float]:
    """Power transform with the exponent of greatest likelihood on a grid, found in one pass."""
    x = F.col(column).cast("double")
    slope = F.sum(F.signum(x) * F.log1p(F.abs(x)))
    scores = df.agg(*[
        (-F.count(x) / 2 * F.log(F.var_pop(_yeo_johnson(x, lam))) + (lam - 1) * slope).alias(str(i)) for i, lam in enumerate(grid)
    ]).first()
    best = max(range(len(grid)), key=lambda i: (scores[i] if scores[i] is not None else float("-inf")))
    return df.withColumn(out, _yeo_johnson(x, grid[best])), grid[best]


def ridge_arbiter(train: DataFrame, validation: DataFrame, rows: DataFrame, experts: Sequence[str], label: str, alphas: Sequence[float]) -> DataFrame:
    """Linear blend of expert outputs; the penalty with the least validation error, refitted on both."""
    x = assembler(experts, "_experts")
    train, validation, rows = (x.transform(d) for d in (train, validation, rows))

    def model(alpha: float) -> LinearRegression:
        return LinearRegression(featuresCol="_experts", labelCol=label, predictionCol="arbiter", regParam=alpha, elasticNetParam=0.0)

    errors = []
    for a in alphas:
        scored = model(a).fit(train).transform(validation)
        errors.append((scored.agg(error_metrics(label, "arbiter")["rmse"]).first()[0], a))
    best = min(errors)[1]
    both = train.select("_experts", label).unionByName(validation.select("_experts", label))
    return model(best).fit(both).transform(rows).drop("_experts")


def two_factor_grid(df: DataFrame, actual: str, predicted: str, over: str, under: str, f1: Sequence[float], f2: Sequence[float]) -> DataFrame:
    """(f1, f2, rmse) of predicted + over*f1 - under*f2, from one pass of sums of products."""
    e, a, b = F.col(predicted) - F.col(actual), F.col(over), F.col(under)
    s = df.agg(
        F.count(e).alias("n"), F.sum(e * e).alias("ee"), F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"),
        F.sum(e * a).alias("ea"), F.sum(e * b).alias("eb"), F.sum(a * b).alias("ab"),
    )
    grid = s.withColumn("f1", F.explode(F.array(*[F.lit(float(v)) for v in f1]))).withColumn("f2", F.explode(F.array(*[F.lit(float(v)) for v in f2])))
    f, g = F.col("f1"), F.col("f2")
    sse = F.col("ee") + f * f * F.col("aa") + g * g * F.col("bb") + 2 * f * F.col("ea") - 2 * g * F.col("eb") - 2 * f * g * F.col("ab")
    return grid.select("f1", "f2", F.sqrt(sse / F.col("n")).alias("rmse"))


def two_factor_calibrator(validation: DataFrame, rows: DataFrame, actual: str, predicted: str, over: str, under: str, f1: Sequence[float], f2: Sequence[float]) -> DataFrame:
    best = two_factor_grid(validation, actual, predicted, over, under, f1, f2).agg(F.min(F.struct("rmse", "f1", "f2")).alias("b"))
    best = best.scalar()
    return rows.withColumns({"factor_over": best["f1"], "factor_under": best["f2"]}).withColumn("calibrated", F.col(predicted) + F.col(over) * F.col("factor_over") - F.col(under) * F.col("factor_under"))


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-free hash of a set of rows: their number and the sums of two numbers from each row's md5, digested.

    Columns are read as text, null as ``-``; the same rows give the same fingerprint in any engine.
    """
    text = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns])
    halves = df.select(hash_number(text).alias("a"), hash_number(F.concat(text, F.lit("|"))).alias("b"))
    sums = halves.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(0)).cast("string").alias(c) for c in "ab"])
    return sums.select("n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), "a", "b"), 256).alias("fingerprint"))


def shared_keys(train: DataFrame, holdout: DataFrame, key: str) -> DataFrame:
    return train.select(key).distinct().join(holdout.select(key).distinct(), key, "left_semi").agg(F.count(F.lit(1)).alias("shared"))


def correlation_flags(df: DataFrame, target: str, columns: Sequence[str], warn: float = 0.7, fail: float = 0.9) -> DataFrame:
    from sitegauge.operators.profiles import top_correlations

    out = top_correlations(df, target, columns, len(columns))
    return out.withColumn("leak", F.when(F.col("abs_corr") > fail, "fail").when(F.col("abs_corr") > warn, "warn").otherwise("ok"))


def compare_models(df: DataFrame, id: str, actual: str, old: str, new: str) -> DataFrame:
    """Per-row improvement of the new model, summed up with the best case."""
    gain = F.abs(F.col(old) - F.col(actual)) - F.abs(F.col(new) - F.col(actual))
    return df.select(id, gain.alias("gain")).agg(
        F.count("gain").alias("n"), F.avg("gain").alias("mean_gain"), F.avg((F.col("gain") > 0).cast("int")).alias("improved_share"),
        F.max("gain").alias("best_gain"), F.max_by(id, F.struct(F.col("gain"), -F.col(id))).alias("best_id"),
    )


def importance_risers(old: DataFrame, new: DataFrame, k: int = 5) -> DataFrame:
    """Features whose importance rose most between two models (feature, importance); one that a model lacks counts 0."""
    both = old.select("feature", F.col("importance").alias("old")).join(new.select("feature", F.col("importance").alias("new")), "feature", "full")
    both = both.select("feature", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("old", "new")])
    return both.withColumn("change", F.col("new") - F.col("old")).orderBy(F.desc("change"), "feature").limit(k)


def conditional_expert(train: DataFrame, rows: DataFrame, features: Sequence[str], label: str, fires: str) -> DataFrame:
    """A model of the failure regime, scored only where the classifier fires; 0 elsewhere."""
    model = regressor(label, "expert").fit(assembler(features).transform(train.filter(F.expr(fires))))
    x = assembler(features).transform(rows)
    on = model.transform(x.filter(F.expr(fires)))
    off = x.filter(~F.coalesce(F.expr(fires), F.lit(False))).withColumn("expert", F.lit(0.0))
    return on.unionByName(off).drop("features")
