"""Classifier and clustering models on Spark ML (M1-M5)."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candor.operators.projections import classifier_rows

INPUTS = ("word_count", "char_count", "avg_word_length", "space_ratio", "period_ratio", "comma_ratio")


def class_weights(labelled: DataFrame, label: str = "is_authentic") -> DataFrame:
    """n / (classes * n_class) per label, so every class weighs the same (M5)."""
    counts = labelled.groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy()  # one row per class
    weight = F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))
    return counts.select(label, "n", weight.alias("weight"))


def split_rows(df: DataFrame, eval_share: float = 0.2, id: str = "id") -> tuple[DataFrame, DataFrame]:
    """Repeatable train and evaluation rows by the hash of the id (M2)."""
    percent = F.conv(F.substring(F.md5(F.col(id).cast("string")), 1, 8), 16, 10).cast("long") % 100
    cut = F.lit(int(round((1 - eval_share) * 100)))
    return df.where(percent < cut), df.where(percent >= cut)


def train_classifier(rows: DataFrame, max_iter: int = 50) -> PipelineModel:
    """Logistic regression with balanced class weights over the six numeric inputs (M1)."""
    usable = rows.na.drop(subset=list(INPUTS))
    weights = class_weights(usable).drop("n")
    train = usable.join(F.broadcast(weights), "is_authentic").withColumn("label", F.col("is_authentic").cast("double"))
    stages = [
        VectorAssembler(inputCols=list(INPUTS), outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(weightCol="weight", maxIter=max_iter),
    ]
    return Pipeline(stages=stages).fit(train)


def train_classifier_v2(content: DataFrame, eval_share: float = 0.2, min_words: int = 5) -> tuple[PipelineModel, DataFrame]:
    """Model on 80 % of all rows above ``min_words`` and its predictions on the rest (M2)."""
    train, held = split_rows(classifier_rows(content, labelled_only=False, min_words=min_words), eval_share)
    model = train_classifier(train)
    return model, predict(model, held)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    usable = rows.na.drop(subset=list(INPUTS))
    return model.transform(usable).withColumn("label", F.col("is_authentic").cast("double"))


def evaluate(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy, precision, recall and F1 from one pass over the predictions (M3)."""
    yes, hit = F.col(prediction) == 1, F.col(label) == 1
    counts = predictions.agg(
        F.count_if(yes & hit).alias("tp"),
        F.count_if(yes & ~hit).alias("fp"),
        F.count_if(~yes & hit).alias("fn"),
        F.count_if(~yes & ~hit).alias("tn"),
    )
    precision = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0))
    recall = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    rated = counts.select(
        "*",
        F.try_divide(F.col("tp") + F.col("tn"), total).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
    )
    both = F.col("precision") + F.col("recall")
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), both), F.lit(0.0))
    return rated.withColumn("f1_score", f1)


def area_under_roc(predictions: DataFrame) -> float:
    return BinaryClassificationEvaluator().evaluate(predictions)


def embedding_clusters(embeddings: DataFrame, k: int = 50, seed: int = 1, max_iter: int = 20) -> tuple[PipelineModel, DataFrame]:
    """K-means on standardised text embeddings (M4): model and (content_id, cluster)."""
    rows = embeddings.where(F.col("content_type") == "text").select(
        "content_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("raw")
    )
    at_most = rows.limit(k).count()
    stages = [
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
        KMeans(k=max(2, min(k, at_most)), seed=seed, maxIter=max_iter, predictionCol="cluster"),
    ]
    model = Pipeline(stages=stages).fit(rows)
    return model, model.transform(rows).select("content_id", "cluster")
