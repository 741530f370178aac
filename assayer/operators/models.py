"""Model metrics as aggregates, and forests through MLlib."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import stage
from .ordering import prefix_sums


def regression_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """mse, rmse, mae, r2, mape (%) and max error in one aggregate.

    A true value of 0 has no percentage error and is left out of mape.
    """
    y, p = F.col(truth).cast("double"), F.col(guess).cast("double")
    error = y - p
    sums = df.filter(y.isNotNull() & p.isNotNull()).agg(
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.var_pop(y).alias("spread"),
        (100 * F.avg(F.abs(error / F.nullif(y, F.lit(0.0))))).alias("mape"),
        F.max(F.abs(error)).alias("max_error"),
    )
    return sums.select(
        "mse",
        F.sqrt("mse").alias("rmse"),
        "mae",
        (1 - F.col("mse") / F.nullif(F.col("spread"), F.lit(0.0))).alias("r2"),
        "mape",
        "max_error",
    )


def classification_metrics(df: DataFrame, truth: str, guess: str, cut: float = 0.5) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1; 0 on zero division.

    Scores with more than two distinct values are cut at ``> cut``.  Whether
    there are more than two is seen from a value other than min and max.
    """
    rows = df.select(F.col(truth).cast("double").alias("y"), F.col(guess).cast("double").alias("s")).filter(
        F.col("y").isNotNull() & F.col("s").isNotNull()
    )
    ends = rows.agg(F.struct(F.min("s").alias("lo"), F.max("s").alias("hi")).alias("e")).scalar()
    between = rows.agg(F.count_if((F.col("s") > ends["lo"]) & (F.col("s") < ends["hi"])).alias("k")).scalar()
    label = F.when(between > 0, (F.col("s") > cut).cast("double")).otherwise(F.col("s"))
    confusion = rows.select("y", label.alias("p")).groupBy("y", "p").agg(F.count(F.lit(1)).alias("c"))
    hit = F.when(F.col("y") == F.col("p"), F.col("c")).otherwise(0)
    cells = F.explode(
        F.array(
            F.struct(F.col("y").alias("label"), F.col("c").alias("support"), F.lit(0).cast("bigint").alias("guessed"), hit.alias("hits")),
            F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("c").alias("guessed"), F.lit(0).cast("bigint").alias("hits")),
        )
    )
    per_class = confusion.select(cells.alias("x")).groupBy("x.label").agg(
        F.sum("x.support").alias("support"), F.sum("x.guessed").alias("guessed"), F.sum("x.hits").alias("hits")
    )
    precision = F.coalesce(F.col("hits") / F.nullif(F.col("guessed"), F.lit(0)), F.lit(0.0))
    recall = F.coalesce(F.col("hits") / F.nullif(F.col("support"), F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    scored = per_class.withColumns({"precision": precision, "recall": recall}).withColumn("f1", f1)
    n = F.sum("support")
    weighted = lambda c: (F.sum(F.col(c) * F.col("support")) / n).alias(c)
    return scored.agg((F.sum("hits") / n).alias("accuracy"), weighted("precision"), weighted("recall"), weighted("f1"))


def auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the ROC curve with ties averaged; null unless two classes.

    Rows are counted per score, and negatives below each score come from
    bucketed running totals, so no task sorts the table.
    """
    rows = df.select(F.col(truth).alias("y"), F.col(score).cast("double").alias("s")).filter(
        F.col("y").isNotNull() & F.col("s").isNotNull()
    )
    rows = stage(rows.groupBy("s", "y").agg(F.count(F.lit(1)).alias("n")), "scores")  # the table is read once
    ends = rows.agg(F.struct(F.min("y").alias("lo"), F.max("y").alias("hi")).alias("e")).scalar()
    two = rows.agg(
        (F.count_if((F.col("y") > ends["lo"]) & (F.col("y") < ends["hi"])) == 0).alias("ok")
    ).scalar()
    marked = rows.select(
        "s", F.when(F.col("y") == ends["hi"], F.col("n")).otherwise(0).alias("pos"), F.when(F.col("y") != ends["hi"], F.col("n")).otherwise(0).alias("neg")
    )
    ranked = prefix_sums(marked, "s", ["pos", "neg"])
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    positives, negatives = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    value = wins / F.nullif(positives * negatives, F.lit(0.0))
    return ranked.agg(value.alias("auc")).select(F.when(two, F.col("auc")).alias("auc"))


class ForestModel:
    """Random forest over named feature columns; nulls count as 0."""

    def __init__(self, task: str = "regression", trees: int = 100, depth: int = 10, seed: int = 42, **options):
        if task not in ("regression", "classification"):
            raise ValueError(f"unknown task: {task}")
        kind = RandomForestRegressor if task == "regression" else RandomForestClassifier
        self.forest = kind(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="_features", predictionCol="prediction", **options)
        self.task, self.features, self.model = task, [], None

    def _ready(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"_f{i}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for i, c in enumerate(self.features)})

    def fit(self, df: DataFrame, features: list[str], target: str) -> "ForestModel":
        if set(features) & {"_features", "label"}:
            raise ValueError("feature names _features and label are taken")
        self.features = list(features)
        assembler = VectorAssembler(inputCols=[f"_f{i}" for i in range(len(features))], outputCol="_features")
        rows = self._ready(df.filter(F.col(target).isNotNull())).withColumn("label", F.col(target).cast("double"))
        self.model: PipelineModel = Pipeline(stages=[assembler, self.forest]).fit(rows)
        return self

    def _fitted(self) -> PipelineModel:
        if self.model is None:
            raise ValueError("the model is not fitted")
        return self.model

    def predict(self, df: DataFrame) -> DataFrame:
        """Input columns plus ``prediction``."""
        return self._fitted().transform(self._ready(df)).select(*df.columns, "prediction")

    def importances(self, spark) -> DataFrame:
        """(feature, importance), most important first."""
        weights = self._fitted().stages[-1].featureImportances.toArray().tolist()
        table = spark.createDataFrame(list(zip(self.features, weights)), "feature string, importance double")
        return table.orderBy(F.desc("importance"), "feature")

    def evaluate(self, df: DataFrame, target: str) -> DataFrame:
        """Metrics of the predictions on labelled rows, such as a validation part."""
        scored = stage(self.predict(df.filter(F.col(target).isNotNull())).select(target, "prediction"), "scored")
        if self.task == "regression":
            return regression_metrics(scored, target, "prediction")
        return classification_metrics(scored.withColumn("prediction", F.col("prediction").cast("int")), target, "prediction")

    def save(self, path: str) -> None:
        """Write the fitted forest and its feature names below ``path``."""
        self._fitted().write().overwrite().save(f"{path}/forest")
        names = SparkSession.active().createDataFrame([(i, c, self.task) for i, c in enumerate(self.features)], "place int, feature string, task string")
        names.write.mode("overwrite").parquet(f"{path}/features")

    @classmethod
    def load(cls, path: str) -> "ForestModel":
        """The forest that ``save`` wrote."""
        names = SparkSession.active().read.parquet(f"{path}/features").orderBy("place").collect()
        model = cls(names[0]["task"])
        model.features, model.model = [r["feature"] for r in names], PipelineModel.load(f"{path}/forest")
        return model
