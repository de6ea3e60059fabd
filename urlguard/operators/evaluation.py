"""Model metrics from a prediction table (y_true, prediction)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSES = (0, 1)


def ratio(part: Column, whole: Column) -> Column:
    """Quotient, 0 where the divisor is 0."""
    return F.when(whole != 0, part / whole).otherwise(0.0)


def confusion(df: DataFrame) -> DataFrame:
    """Rows per (actual, predicted) on the full label grid."""
    cells = [(a, p) for a in CLASSES for p in CLASSES]
    counts = df.agg(
        *[
            F.count_if((F.col("y_true") == a) & (F.col("prediction") == p)).alias(f"n{a}{p}")
            for a, p in cells
        ]
    )
    items = F.array(
        *[
            F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"n{a}{p}").alias("n"))
            for a, p in cells
        ]
    )
    return counts.select(F.explode(items).alias("c")).select("c.*")


def prf(df: DataFrame, positive: int = 1, by: list[str] | None = None) -> DataFrame:
    """accuracy, precision, recall and F1 of one class, zero where undefined."""
    hit = F.col("y_true") == positive
    said = F.col("prediction") == positive
    counts = df.groupBy(*(by or [])).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("y_true") == F.col("prediction")).alias("right"),
        F.count_if(hit & said).alias("tp"),
        F.count_if(said).alias("said"),
        F.count_if(hit).alias("real"),
    )
    return counts.select(
        *(by or []),
        ratio(F.col("right"), F.col("n")).alias("accuracy"),
        ratio(F.col("tp"), F.col("said")).alias("precision"),
        ratio(F.col("tp"), F.col("real")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("said") + F.col("real")).alias("f1"),
    )


def class_report(df: DataFrame) -> DataFrame:
    """Per class, macro average, weighted average and accuracy, as rows.

    One pass counts each (actual, predicted) cell; the report is arithmetic on the
    four cells.
    """
    cells = df.groupBy("y_true", "prediction").agg(F.count("*").alias("n"))
    roles = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("y_true").alias("cls"), F.lit("real").alias("role")),
                F.struct(F.col("prediction").alias("cls"), F.lit("said").alias("role")),
            )
        ).alias("r"),
        "n", (F.col("y_true") == F.col("prediction")).alias("right"),
    ).select("r.*", "n", "right")
    per_class = (
        roles.groupBy("cls")
        .agg(
            F.sum(F.when(F.col("role") == "real", F.col("n")).otherwise(0)).alias("support"),
            F.sum(F.when(F.col("role") == "said", F.col("n")).otherwise(0)).alias("said"),
            F.sum(F.when(F.col("right") & (F.col("role") == "real"), F.col("n")).otherwise(0)).alias("tp"),
        )
        .select(
            "cls", "support", "tp",
            ratio(F.col("tp"), F.col("said")).alias("precision"),
            ratio(F.col("tp"), F.col("support")).alias("recall"),
            ratio(2 * F.col("tp"), F.col("said") + F.col("support")).alias("f1"),
        )
    )
    total = F.sum("support")

    def weighted(name: str) -> Column:
        return F.sum(F.col(name) * F.col("support")) / total

    # GROUPING SETS ((cls), ()): the class rows and their total from one aggregation.
    return (
        per_class.rollup("cls")
        .agg(
            F.avg("precision").alias("precision"),
            F.avg("recall").alias("recall"),
            F.avg("f1").alias("f1"),
            weighted("precision").alias("wp"),
            weighted("recall").alias("wr"),
            weighted("f1").alias("wf"),
            (F.sum("tp") / total).alias("accuracy"),
            total.alias("support"),
            F.grouping("cls").alias("is_total"),
        )
        .select(
            F.explode(
                F.when(
                    F.col("is_total") == 0,
                    F.array(_report_row(F.col("cls").cast("string"), "precision", "recall", "f1")),
                ).otherwise(
                    F.array(
                        _report_row(F.lit("macro avg"), "precision", "recall", "f1"),
                        _report_row(F.lit("weighted avg"), "wp", "wr", "wf"),
                        _report_row(F.lit("accuracy"), "accuracy", "accuracy", "accuracy"),
                    )
                )
            ).alias("r")
        )
        .select("r.*")
    )


def _report_row(name: Column, p: str, r: str, f: str) -> Column:
    return F.struct(
        name.alias("row"), F.col(p).alias("precision"), F.col(r).alias("recall"),
        F.col(f).alias("f1"), F.col("support"),
    )


def sanity(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per model: ``degenerate`` when one class only is predicted, ``low_recall`` below 0.25."""
    counted = df.groupBy(*(by or [])).agg(
        F.min("prediction").alias("low"),
        F.max("prediction").alias("high"),
        F.count_if((F.col("y_true") == 1) & (F.col("prediction") == 1)).alias("tp"),
        F.count_if(F.col("y_true") == 1).alias("real"),
    )
    recall = ratio(F.col("tp"), F.col("real"))
    return counted.select(
        *(by or []),
        (F.col("low") == F.col("high")).alias("degenerate"),
        recall.alias("recall"),
        (recall < 0.25).alias("low_recall"),
    )


def compare(predictions: DataFrame, model: str = "model") -> DataFrame:
    """Model table rounded to 3 places, best accuracy first, then best F1."""
    table = prf(predictions, 1, [model])
    rounded = table.select(model, *[F.round(c, 3).alias(c) for c in table.columns if c != model])
    return rounded.orderBy(F.desc("accuracy"), F.desc("f1"), model)
