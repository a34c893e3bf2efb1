"""A text classifier of hashed words, in place of a neural one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trained(rows: DataFrame, features: int = 1 << 16, regularisation: float = 1e-3):
    """A model of rows with text and label (a string). Rows with a null take no part."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, IndexToString, RegexTokenizer, StringIndexer

    rows = rows.select("text", "label").where("text is not null and label is not null")
    labels = StringIndexer(inputCol="label", outputCol="label_no", stringOrderType="alphabetAsc").fit(rows)
    words = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\\p{L}\\p{M}\\p{N}]+".replace("\\\\", "\\"))
    hashed = HashingTF(inputCol="words", outputCol="hashed", numFeatures=features)
    model = LogisticRegression(featuresCol="hashed", labelCol="label_no", predictionCol="class_no", regParam=regularisation, maxIter=50)
    return Pipeline(stages=[labels, words, hashed, model, IndexToString(inputCol="class_no", outputCol="predicted", labels=labels.labels)]).fit(rows)


def classified(model, rows: DataFrame) -> DataFrame:
    """The rows with text, and predicted."""
    out = model.transform(rows.where("text is not null").withColumn("label", F.lit(model.stages[0].labels[0])) if "label" not in rows.columns else rows.where("text is not null"))
    return out.select(*rows.columns, "predicted")
