"""Model fitting and evaluation with MLlib boosted trees."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import date

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hourmart.functions.numeric import wet_flag
from hourmart.model import TRAIN_QUANTILE, WET_PROBABILITY, Panel, feature_columns
from hourmart.operators.stats import (
    class_balance, classification_metrics, error_metrics, split_date, year_bounds,
)
from hourmart.plans.scoring import PROBABILITY, in_range, two_stage
from hourmart.session import shared_folder, written

VECTOR = "_features"


@dataclass(frozen=True)
class TreeSettings:
    trees: int
    depth: int
    step: float = 0.05
    row_share: float = 0.8
    column_share: float = 0.8
    min_rows: int = 1
    seed: int = 42


@dataclass(frozen=True)
class TrainSettings:
    """Published sizes by default; MLlib trees have no L1/L2 terms to set."""

    value: TreeSettings = TreeSettings(trees=600, depth=9, min_rows=5)
    wet: TreeSettings = TreeSettings(trees=400, depth=7)
    amount: TreeSettings = TreeSettings(trees=400, depth=7, min_rows=3)
    quantile: float = TRAIN_QUANTILE

    @staticmethod
    def small(trees: int = 5, depth: int = 3) -> TrainSettings:
        tiny = TreeSettings(trees=trees, depth=depth)
        return TrainSettings(value=tiny, wet=tiny, amount=tiny)


@dataclass
class Models:
    """Fitted models by target column, the two rain stages apart.

    ``prepare`` turns feature columns into the one vector all of them read.
    """

    panel: Panel
    prepare: PipelineModel
    values: dict[str, GBTRegressionModel] = field(default_factory=dict)
    wet: GBTClassificationModel | None = None
    amount: GBTRegressionModel | None = None

    @property
    def gives_chance(self) -> bool:
        return self.wet is not None

    def score(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        return score(rows, self, keep)

    def save(self, spark: SparkSession, root: str) -> None:
        parts = {"prepare": self.prepare, **self.values}
        if self.wet is not None:
            parts["rain_classifier"] = self.wet
        if self.amount is not None:
            parts["rain_regressor"] = self.amount
        for name, part in parts.items():
            part.write().overwrite().save(f"{root}/{name}")
        # An amount model of an earlier training may still be there; say whether it counts.
        staged = F.lit("yes" if self.amount is not None else "no").alias("value")
        spark.range(1).select(staged).write.mode("overwrite").text(f"{root}/two_stage")

    @staticmethod
    def load(spark: SparkSession, root: str, panel: Panel) -> Models:
        """What :meth:`save` wrote; the amount model only if there is one."""
        models = Models(panel, PipelineModel.load(f"{root}/prepare"))
        for c in panel.columns:
            if c != panel.wet_column:
                models.values[c] = GBTRegressionModel.load(f"{root}/{c}")
        if panel.wet_column:
            models.wet = GBTClassificationModel.load(f"{root}/rain_classifier")
            if spark.read.text(f"{root}/two_stage").first()[0] == "yes":
                models.amount = GBTRegressionModel.load(f"{root}/rain_regressor")
        return models


def sample_weights(rows: DataFrame, year: str = "year", out: str = "weight") -> DataFrame:
    """Weights rising from 1 in the first year to 3 in the last; 1 if there is one year."""
    bounds = year_bounds(rows, year).select(F.struct("min_year", "max_year")).scalar()
    low, high = bounds.getField("min_year"), bounds.getField("max_year")
    share = F.try_divide((F.col(year) - low).cast("double"), (high - low).cast("double"))
    return rows.withColumn(out, 1.0 + 2.0 * F.coalesce(share, F.lit(0.0)))


def time_split(rows: DataFrame, day: str, split: date | Column) -> tuple[DataFrame, DataFrame]:
    """Rows up to and including the split day, and rows after it."""
    at = split if isinstance(split, Column) else F.lit(split)
    return rows.where(F.col(day) <= at), rows.where(F.col(day) > at)


def _numeric(rows: DataFrame, features: list[str]) -> DataFrame:
    """Features as doubles, which the imputer requires."""
    return rows.withColumns({c: F.col(c).cast("double") for c in features})


def fit_prepare(train: DataFrame, panel: Panel) -> PipelineModel:
    """Fill what is missing with training medians, then assemble in trained order."""
    features = feature_columns(panel)
    filled = [f"_{c}" for c in features]
    return Pipeline(stages=[
        Imputer(strategy="median", inputCols=features, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol=VECTOR),
    ]).fit(_numeric(train, features))


def vectors(rows: DataFrame, prepare: PipelineModel, panel: Panel, keep: list[str]) -> DataFrame:
    """``keep`` columns as they are, beside the feature vector."""
    kept = {f"_keep_{c}": F.col(c) for c in keep}
    ready = prepare.transform(_numeric(rows.withColumns(kept), feature_columns(panel)))
    return ready.select(*[F.col(f"_keep_{c}").alias(c) for c in keep], VECTOR)


def _learner(kind, label: str, weight: str | None, s: TreeSettings, output: str):
    learner = kind(
        featuresCol=VECTOR, labelCol=label, predictionCol=output, maxIter=s.trees,
        maxDepth=s.depth, stepSize=s.step, subsamplingRate=s.row_share,
        featureSubsetStrategy=str(s.column_share), minInstancesPerNode=s.min_rows,
        seed=s.seed, checkpointInterval=10, maxMemoryInMB=1024)   # a level of nodes in one pass
    return learner.setWeightCol(weight) if weight else learner


def _value_fits(train: DataFrame, panel: Panel, settings: TrainSettings, weight: str) -> dict:
    return {
        c: (_learner(GBTRegressor, c, weight, settings.value, f"{c}_pred"), train)
        for c in panel.columns if c != panel.wet_column
    }


def _rain_fits(train: DataFrame, panel: Panel, settings: TrainSettings, weight: str) -> dict:
    is_wet = F.col(panel.wet_column) > panel.wet_above
    balance = class_balance(train, is_wet).first()
    scaled = F.col(weight) * F.when(is_wet, F.lit(float(balance["scale_pos"]))).otherwise(1.0)
    labelled = train.withColumns({
        "_wet": wet_flag(F.col(panel.wet_column), panel.wet_above).cast("double"),
        "_wet_weight": scaled})
    classifier = _learner(GBTClassifier, "_wet", "_wet_weight", settings.wet, "_wet_pred")
    classifier = classifier.setProbabilityCol("_wet_probability").setRawPredictionCol("_wet_raw")
    fits = {"_wet": (classifier, labelled)}
    if balance["n_pos"]:
        fits["_amount"] = (
            _learner(GBTRegressor, panel.wet_column, None, settings.amount, "_amount"), train.where(is_wet))
    return fits


def _fitted(fits: dict) -> dict:
    """All models at once, each in a scheduler pool of its own.

    A boosted model is a chain of small jobs, so one fit leaves most of the cluster idle; several
    fits fill the gaps of one another. With ``spark.scheduler.mode=FAIR`` they share evenly.
    """
    def fit(name: str):
        learner, rows = fits[name]
        context = rows.sparkSession.sparkContext
        context.setLocalProperty("spark.scheduler.pool", f"fit {name}")
        try:
            return learner.fit(rows)
        finally:
            context.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(len(fits)) as threads:
        session = next(iter(fits.values()))[1].sparkSession
        running = {name: threads.submit(inheritable_thread_target(session)(fit), name) for name in fits}
        return {name: r.result() for name, r in running.items()}


def fit_values(train: DataFrame, panel: Panel, settings: TrainSettings, weight: str = "weight"
               ) -> dict[str, GBTRegressionModel]:
    """One weighted regressor per measure other than rain, on vectors."""
    return _fitted(_value_fits(train, panel, settings, weight))


def fit_rain(train: DataFrame, panel: Panel, settings: TrainSettings, weight: str = "weight"
             ) -> tuple[GBTClassificationModel, GBTRegressionModel | None]:
    """Wet/dry classifier with balanced weights, and the amount model on wet rows, if there are any."""
    found = _fitted(_rain_fits(train, panel, settings, weight))
    return found["_wet"], found.get("_amount")


def fit_all(train: DataFrame, panel: Panel, settings: TrainSettings, prepare: PipelineModel,
            weight: str = "weight") -> Models:
    """The independent models of all measures, fitted side by side."""
    fits = _value_fits(train, panel, settings, weight)
    if panel.wet_column:
        fits |= _rain_fits(train, panel, settings, weight)
    found = _fitted(fits)
    wet, amount = found.pop("_wet", None), found.pop("_amount", None)
    return Models(panel, prepare, found, wet, amount)


def score(rows: DataFrame, models: Models, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``<measure>_pred`` per fitted measure and the wet probability.

    Rain is the amount where the probability passes its cut, and 0 elsewhere.
    """
    panel = models.panel
    scored = vectors(rows, models.prepare, panel, keep)
    outputs = []
    for short, c in panel.measures:
        if c in models.values:
            scored = models.values[c].transform(scored)
            outputs.append(in_range(short, F.col(f"{c}_pred")).alias(f"{c}_pred"))
    if models.wet is not None:
        scored = models.wet.transform(scored)
        scored = scored.withColumn(PROBABILITY, vector_to_array("_wet_probability")[1])
        amount = F.lit(0.0)
        if models.amount is not None:
            scored = models.amount.transform(scored)
            amount = F.col("_amount")
        outputs += [two_stage(F.col(PROBABILITY), amount).alias(f"{panel.wet_column}_pred"),
                    F.col(PROBABILITY)]
    return scored.select(*keep, *outputs)


def evaluate(scored: DataFrame, panel: Panel) -> DataFrame:
    """MAE, RMSE and R2 per measure, and the wet/dry accuracy and F1, one row each."""
    metrics = error_metrics(scored, panel)
    if not panel.wet_column:
        return metrics
    flags = scored.select(
        wet_flag(F.col(panel.wet_column), panel.wet_above).alias("_a"),
        F.when(F.col(PROBABILITY) > WET_PROBABILITY, 1).otherwise(0).alias("_p"))
    wet = classification_metrics(flags, "_a", "_p").withColumn("target", F.lit("is_rainy"))
    return metrics.unionByName(wet, allowMissingColumns=True)


def train(table: DataFrame, panel: Panel, settings: TrainSettings | None = None
          ) -> tuple[Models, DataFrame]:
    """Fit all models on complete rows of ``model_rows`` and evaluate on the later part.

    The rows are written once, since every tree of every model reads them
    again. Returns the models and the metric table.
    """
    settings = settings or TrainSettings()
    features = feature_columns(panel)
    shared_folder(table.sparkSession)
    needed = list(dict.fromkeys([*panel.keys, "year", *features, *panel.columns]))
    rows = written(table.select(*needed), "training_rows")
    split = split_date(rows, panel.date, settings.quantile).first()["split_date"]
    if split is None:
        raise ValueError("no complete training rows")
    earlier, later = time_split(rows, panel.date, split)
    prepare = fit_prepare(earlier, panel)
    fit_on = written(
        vectors(sample_weights(earlier), prepare, panel, [*panel.columns, "weight"]), "vectors")
    models = fit_all(fit_on, panel, settings, prepare)
    scored = written(score(later, models, [*panel.keys, *panel.columns]), "holdout")
    return models, evaluate(scored, panel)
