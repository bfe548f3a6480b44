"""Panel models on Spark ML: expected rates, classifiers, folds and diagnostics.

Fitting functions receive an already filtered DataFrame and refuse rows past their
cutoff. Loops run over folds, specifications or grid points, never over rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Interaction, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.functions import measures as M
from cellwise.operators import boosting, robust
from cellwise.operators.ordered import quantiles, row_numbers
from cellwise.operators.ranking import performance
from cellwise.operators.sampling import seeded_order
from cellwise.session import broadcast_checked, freeze


def winsorize(training: DataFrame, rows: DataFrame, value: str, name: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip at training quantiles; NULL stays NULL. Bounds arrive as one scalar subquery."""
    if not 0 <= low < high <= 1:
        raise ValueError("Clipping needs 0 <= low < high <= 1")
    cut = quantiles(training, [], value, {"lo": low, "hi": high}).select(F.struct("lo", "hi").alias("c")).scalar()
    v = F.col(value)
    return rows.withColumn(name, F.when(v.isNotNull(), F.greatest(F.least(v, cut["hi"]), cut["lo"])))


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with every listed field present and finite; numeric fields become doubles."""
    kinds = dict(df.dtypes)
    numeric = [c for c in columns if kinds[c] != "string"]
    return df.withColumns({c: M.finite(F.col(c)) for c in numeric if kinds[c] in ("double", "float")}).dropna(subset=list(columns))


def refuse_after(df: DataFrame, year: str, cutoff: int) -> None:
    last = df.agg(F.max(year)).first()[0]
    if last is None:
        raise ValueError("No complete training rows")
    if last > cutoff:
        raise ValueError(f"Training rows reach {last}, after the cutoff {cutoff}")


@dataclass(frozen=True)
class Spec:
    """Feature list of a model. ``interact`` pairs a numeric with a categorical column."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    year: str | None = None
    interact: tuple[str, str] | None = None
    name: str = "model"

    @property
    def fields(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([*self.numeric, *self.categorical, *([self.year] if self.year else [])]))

    def without(self, *omitted: str) -> "Spec":
        numeric = tuple(c for c in self.numeric if c not in omitted)
        categorical = tuple(c for c in self.categorical if c not in omitted)
        if not numeric and not categorical:
            raise ValueError("No predictor is left after leaving these out")
        return Spec(numeric, categorical, self.year, self.interact, f"{self.name}_without_{'_'.join(omitted)}")

    def replacing(self, old: str, *new: str) -> "Spec":
        numeric = tuple(n for c in self.numeric for n in (new if c == old else (c,)))
        return Spec(numeric, self.categorical, self.year, self.interact, f"{self.name}_{'_'.join(new)}")


def _encoders(categorical: Sequence[str]) -> list:
    """Drop-first dummies in label order; an unseen level is an error."""
    stages = []
    for c in categorical:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}_index", stringOrderType="alphabetDesc"))
        stages.append(OneHotEncoder(inputCol=f"{c}_index", outputCol=f"{c}_dummy", dropLast=True))
    return stages


# --- expected rate


@dataclass
class ExpectedModel:
    spec: Spec
    outcome: str
    cutoff: int
    pipeline: PipelineModel


def _as_text(df: DataFrame, spec: Spec, cutoff: int) -> DataFrame:
    """Year effects as text; years past the cutoff keep the effect of the last trained one."""
    if spec.year is None:
        return df
    return df.withColumn("_year_effect", F.least(F.col(spec.year), F.lit(cutoff)).cast("string"))


def fit_expected(
    df: DataFrame, outcome: str, spec: Spec, cutoff: int, year: str, estimator: str = "ols"
) -> ExpectedModel:
    """OLS by the normal equations (one pass), or Huber regression by reweighting (see ``robust``)."""
    clean = complete_cases(df, [outcome, *spec.fields])
    refuse_after(clean, year, cutoff)
    clean = _as_text(clean, spec, cutoff)
    categorical = [*spec.categorical, *(["_year_effect"] if spec.year else [])]
    stages = _encoders(categorical)
    inputs = [*spec.numeric, *[f"{c}_dummy" for c in categorical]]
    if spec.interact:
        number, group = spec.interact
        stages.append(VectorAssembler(inputCols=[number], outputCol="_number"))
        stages.append(Interaction(inputCols=["_number", f"{group}_dummy"], outputCol="_interaction"))
        inputs.append("_interaction")
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    if estimator not in ("ols", "huber"):
        raise ValueError(f"Unsupported estimator {estimator}")
    if estimator == "ols":
        stages.append(LinearRegression(labelCol=outcome, solver="normal", regParam=0.0, predictionCol="expected_rate"))
        return ExpectedModel(spec, outcome, cutoff, Pipeline(stages=stages).fit(clean))
    prepared = Pipeline(stages=stages).fit(clean)
    fitted = robust.huber(prepared.transform(clean).select("features", outcome), outcome, "expected_rate")
    return ExpectedModel(spec, outcome, cutoff, PipelineModel([*prepared.stages, fitted]))


def predict_expected(model: ExpectedModel, df: DataFrame, trained_on: DataFrame | None = None) -> DataFrame:
    """Expected rate and residual of complete rows.

    Where ``trained_on`` is given, rows whose group effect was not trained drop out.
    """
    clean = complete_cases(df, [model.outcome, *model.spec.fields])
    if trained_on is not None:
        for c in model.spec.categorical:
            known = complete_cases(trained_on, [model.outcome, *model.spec.fields]).select(c).distinct()
            clean = clean.join(broadcast_checked(known), c, "left_semi")
    scored = model.pipeline.transform(_as_text(clean, model.spec, model.cutoff))
    return scored.select(*df.columns, "expected_rate", (F.col(model.outcome) - F.col("expected_rate")).alias("residual"))


def expected_coefficients(model: ExpectedModel, spark) -> DataFrame:
    """(term, coefficient) in feature order, with the intercept."""
    fitted = model.pipeline.stages[-1]
    terms = list(model.spec.numeric)
    for stage in model.pipeline.stages:
        if hasattr(stage, "labelsArray") and stage.getInputCol() in [*model.spec.categorical, "_year_effect"]:
            terms.extend(f"{stage.getInputCol()}={level}" for level in stage.labels[:-1])
    values = [float(v) for v in fitted.coefficients]
    terms.extend(f"interaction_{i}" for i in range(len(values) - len(terms)))
    rows = [("const", float(fitted.intercept)), *zip(terms, values)]
    return spark.createDataFrame(rows, "term string, coefficient double")


# --- classifiers


@dataclass
class Classifier:
    spec: Spec
    label: str
    centers: dict[str, tuple[float, float]]
    levels: dict[str, list[str]]
    pipeline: PipelineModel | boosting.Boosted
    model: str

    @property
    def columns(self) -> list[str]:
        return [f"_x{i}" for i in range(len(self.terms))]

    @property
    def terms(self) -> list[str]:
        return [*self.centers, *[f"{c}={level}" for c, levels in self.levels.items() for level in levels[1:]]]

    def design(self, df: DataFrame) -> DataFrame:
        """One column per term: scaled numbers, then dummies of all but the first level.

        A level not seen in training has zeros everywhere.
        """
        numbers = [(F.col(c) - mean) / spread for c, (mean, spread) in self.centers.items()]
        dummies = [
            (F.col(c) == level).cast("double") for c, levels in self.levels.items() for level in levels[1:]
        ]
        return df.withColumns({f"_x{i}": x for i, x in enumerate([*numbers, *dummies])})


def training_scale(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of training columns, one pass; no spread counts as one."""
    row = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    ).first()
    return {c: (float(row[f"m_{c}"]), float(row[f"s_{c}"]) or 1.0) for c in columns}


def _estimator(model: str, params: Mapping[str, object], label: str, seed: int):
    if model == "logistic":
        settings = {"regParam": 1e-5, "elasticNetParam": 0.0, "maxIter": 200, "standardization": False, **params}
        return LogisticRegression(labelCol=label, featuresCol="features", **settings)
    if model == "random_forest":
        settings = {"numTrees": 40, "maxDepth": 6, "minInstancesPerNode": 10, **params}
        return RandomForestClassifier(labelCol=label, featuresCol="features", seed=seed, **settings)
    raise ValueError(f"Unsupported model {model}")


def fit_classifier(
    training: DataFrame, label: str, spec: Spec, model: str = "logistic", params: Mapping[str, object] | None = None, seed: int = 20261004
) -> Classifier:
    """Train-only scaling, drop-first dummies with unseen levels as zeros, a year trend.

    ``params`` of a boosted model are fields of ``boosting.Settings``.
    """
    clean = complete_cases(training, [label, *spec.fields])
    classes = clean.agg(F.min(label), F.max(label)).first()
    if classes[0] != 0 or classes[1] != 1:
        raise ValueError("Training rows must hold both classes")
    numeric = [*spec.numeric, *([spec.year] if spec.year else [])]
    levels = {
        c: [r[0] for r in clean.select(c).distinct().orderBy(c).collect()] for c in spec.categorical
    }
    fitted = Classifier(spec, label, training_scale(clean, numeric) if numeric else {}, levels, None, model)
    if model == "boosted":
        fitted.pipeline = boosting.fit(fitted.design(clean), fitted.columns, label, boosting.Settings(**(params or {})))
        return fitted
    assembler = VectorAssembler(inputCols=fitted.columns, outputCol="features")
    fitted.pipeline = Pipeline(stages=[assembler, _estimator(model, params or {}, label, seed)]).fit(fitted.design(clean))
    return fitted


def predict_probability(fitted: Classifier, df: DataFrame, name: str = "probability") -> DataFrame:
    """Positive-class probability of rows with complete features."""
    clean = complete_cases(df, list(fitted.spec.fields))
    if isinstance(fitted.pipeline, boosting.Boosted):
        return boosting.score(fitted.pipeline, fitted.design(clean), "_p").select(*df.columns, F.col("_p").alias(name))
    scored = fitted.pipeline.transform(fitted.design(clean))
    share = vector_to_array(F.col("probability"))[1]
    return scored.withColumn("_p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))).select(
        *df.columns, F.col("_p").alias(name)
    )


def logistic_coefficients(fitted: Classifier, spark) -> DataFrame:
    """Coefficients and odds ratios per scaled feature and dummy."""
    last = fitted.pipeline.stages[-1]
    rows = [("const", float(last.intercept)), *zip(fitted.terms, [float(v) for v in last.coefficients])]
    return spark.createDataFrame(rows, "term string, coefficient double").withColumn(
        "odds_ratio", F.exp(F.col("coefficient"))
    )


def fit_prevalence(training: DataFrame, label: str) -> float:
    low, high, mean = training.agg(F.min(label), F.max(label), F.avg(label)).first()
    if mean is None or low < 0 or high > 1:
        raise ValueError("Training labels must be present and binary")
    return float(mean)


# --- evaluation harness


def average_precision(scored: DataFrame, label: str, score: str) -> float:
    return float(performance(scored, [], label, score, {}).first()["average_precision"])


def out_of_fold(
    rows: DataFrame,
    folds: Sequence[str],
    label: str,
    spec: Spec,
    model: str = "logistic",
    params: Mapping[str, object] | None = None,
    prepare: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]] | None = None,
) -> DataFrame:
    """Fit on each fold's training rows, score its validation rows, pool the scores.

    ``rows`` carries ``fold`` and ``split_role``. Scores are frozen, so every metric
    reads the same numbers and no model runs twice.
    """
    pooled = None
    for fold in folds:
        training = rows.filter((F.col("fold") == fold) & (F.col("split_role") == "training"))
        validation = rows.filter((F.col("fold") == fold) & (F.col("split_role") == "validation"))
        if prepare is not None:
            training, validation = prepare(training, validation)
        fitted = fit_classifier(training, label, spec, model, params)
        scored = predict_probability(fitted, validation)
        pooled = scored if pooled is None else pooled.unionByName(scored)
    return freeze(pooled)


def inner_split(training: DataFrame, year: str) -> tuple[DataFrame, DataFrame]:
    """All but the latest predictor year, and the latest one."""
    bounds = training.agg(F.max(year), F.count_distinct(year)).first()
    if bounds[1] is None or bounds[1] < 2:
        raise ValueError("Inner tuning needs two predictor years")
    return training.filter(F.col(year) < bounds[0]), training.filter(F.col(year) == bounds[0])


def tune(
    training: DataFrame, label: str, spec: Spec, model: str, grid: Sequence[Mapping[str, object]], year: str
) -> tuple[Mapping[str, object], DataFrame]:
    """Grid winner by average precision on the latest training year; ties to the first."""
    fit, check = inner_split(training, year)
    rows = []
    for number, params in enumerate(grid, start=1):
        scored = freeze(predict_probability(fit_classifier(fit, label, spec, model, params), check))
        rows.append((model, number, str(dict(params)), average_precision(scored, label, "probability")))
    best = max(rows, key=lambda r: (r[3], -r[1]))
    table = training.sparkSession.createDataFrame(rows, "model string, candidate_id int, params string, inner_ap double")
    return grid[best[1] - 1], table


def permuted(df: DataFrame, column: str, keys: Sequence[str], seed: int) -> DataFrame:
    """``column`` shuffled over rows: positions by key meet positions by seeded hash.

    Both positions are distributed row numbers and meet in an equi-join.
    """
    order = [F.col(k).asc() for k in keys]
    rest = row_numbers(df.drop(column), [], order, "_place").drop("_place_of")
    shuffled = df.select(*keys, column).withColumn("_hash", seeded_order(keys, seed))
    moved = row_numbers(shuffled, [], [F.col("_hash").asc(), *order], "_place").select("_place", column)
    return rest.join(moved, "_place").drop("_place").select(*df.columns)


def permutation_importance(
    fitted: Classifier, validation: DataFrame, keys: Sequence[str], repeats: int = 3, seed: int = 20261004
) -> DataFrame:
    """Drop in average precision per permuted feature, mean and deviation over repeats."""
    from pyspark.sql import Window

    rows = freeze(complete_cases(validation, [fitted.label, *fitted.spec.fields]))
    base = average_precision(freeze(predict_probability(fitted, rows)), fitted.label, "probability")
    drops = []
    for feature in fitted.spec.fields:
        for repeat in range(repeats):
            changed = permuted(rows, feature, keys, seed + repeat)
            value = average_precision(freeze(predict_probability(fitted, changed)), fitted.label, "probability")
            drops.append((fitted.model, feature, repeat, base - value))
    long = validation.sparkSession.createDataFrame(drops, "model string, feature string, repeat int, ap_drop double")
    return long.groupBy("model", "feature").agg(
        F.avg("ap_drop").alias("importance"), F.stddev_pop("ap_drop").alias("importance_sd")
    ).withColumn("rank", F.rank().over(Window.partitionBy("model").orderBy(F.col("importance").desc())))


def partial_dependence(
    fitted: Classifier, training: DataFrame, variables: Sequence[str], keys: Sequence[str], grid_size: int = 12, sample_rows: int = 2500, seed: int = 20261004
) -> DataFrame:
    """Mean probability with one feature set to each grid value of its p05..p95 support.

    The operator works on a seeded sample of fixed size; the grid is a short literal
    array unfolded on those rows.
    """
    from cellwise.operators.sampling import seeded_sample

    sample = freeze(seeded_sample(complete_cases(training, list(fitted.spec.fields)), keys, sample_rows, seed))
    points = {f"q{i}": 0.05 + 0.9 * i / (grid_size - 1) for i in range(grid_size)}
    result = None
    for variable in variables:
        grid = sorted(set(quantiles(sample, [], variable, points).first()))
        changed = sample.drop(variable).withColumn(variable, F.explode(F.array(*[F.lit(float(v)) for v in grid])))
        part = (
            predict_probability(fitted, changed)
            .groupBy(F.col(variable).alias("feature_value"))
            .agg(F.avg("probability").alias("mean_probability"))
            .select(F.lit(variable).alias("feature"), "feature_value", "mean_probability")
        )
        result = part if result is None else result.unionByName(part)
    return result


def compare_specs(
    rows: DataFrame, folds: Mapping[str, int], outcome: str, specs: Sequence[Spec], year: str, estimators: Mapping[str, str] | None = None
) -> DataFrame:
    """Validation error of every expected-rate specification in every fold.

    ``folds`` maps a fold to the last year its model may learn from; the rows after
    it validate the model.
    """
    from cellwise.operators.evaluation import regression_metrics

    parts = None
    for fold, cutoff in folds.items():
        for spec in specs:
            training = rows.filter(F.col(year) <= cutoff)
            fitted = fit_expected(training, outcome, spec, cutoff, year, (estimators or {}).get(spec.name, "ols"))
            scored = predict_expected(fitted, rows.filter(F.col(year) > cutoff), training)
            tagged = scored.select(
                F.lit(fold).alias("fold"), F.lit(spec.name).alias("model"), outcome, "expected_rate"
            )
            parts = tagged if parts is None else parts.unionByName(tagged)
    return regression_metrics(freeze(parts), ["fold", "model"], outcome, "expected_rate")


def winner(metrics: DataFrame, value: str = "mae") -> DataFrame:
    """Specifications by mean error over folds and number of folds won."""
    from pyspark.sql import Window

    best = F.rank().over(Window.partitionBy("fold").orderBy(F.col(value).asc(), F.col("model").asc()))
    ranked = metrics.withColumn("_best", (best == 1).cast("int"))
    summary = ranked.groupBy("model").agg(F.avg(value).alias(f"mean_{value}"), F.sum("_best").alias("fold_wins"))
    order = Window.orderBy(F.col(f"mean_{value}").asc(), F.col("fold_wins").desc(), F.col("model").asc())
    return summary.withColumn("position", F.row_number().over(order))


def leave_one_out(
    rows: DataFrame, group: str, folds: Sequence[str], label: str, spec: Spec, model: str = "logistic"
) -> DataFrame:
    """Refit without each level of a category; score the remaining validation rows."""
    levels = [r[0] for r in rows.select(group).distinct().orderBy(group).collect()]
    result = None
    for level in levels:
        kept = rows.filter(F.col(group) != level)
        scored = out_of_fold(kept, folds, label, spec, model)
        part = performance(scored.withColumn("omitted", F.lit(level)), ["omitted"], label, "probability", {"top10": 0.1})
        result = part if result is None else result.unionByName(part)
    return result
