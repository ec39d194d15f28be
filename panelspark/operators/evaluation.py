"""Confusion counts, threshold sweeps, score histograms and ranked errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import GRID_POINTS, POSITIVE_BUCKETS, SWEEP_POINTS


def _rates(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = zero(tp, tp + fp), zero(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": zero(2 * p * r, p + r)}


def confusion(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(label, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support per class over the rows with a decision."""
    cells = confusion(df, label, predicted)
    # each cell counts towards its true class and towards its predicted class
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col(label).alias("class"), F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0).alias("tp"),
                         F.lit(0).cast("long").alias("np"), F.col("n").alias("nt")),
                F.struct(F.col(predicted).alias("class"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("np"),
                         F.lit(0).cast("long").alias("nt")),
            )
        ).alias("s")
    ).select("s.*")
    sums = sides.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("np").alias("np"), F.sum("nt").alias("support"))
    tp = F.col("tp")
    return sums.withColumns(_rates(tp, F.col("np") - tp, F.col("support") - tp)).drop("np", "tp").filter("support > 0")


def threshold_sweep(
    df: DataFrame, score: str, thresholds: list[float] = SWEEP_POINTS, label: str = "label", by: tuple[str, ...] = ()
) -> DataFrame:
    """Counts and rates at every threshold from one pass over the rows, for each value of ``by``."""
    hit, true = (lambda t: F.col(score) >= t), F.col(label) == "relevant"
    counts = df.groupBy(*by).agg(
        F.count_if(true).alias("_pos"),
        *[F.count_if(hit(t) & true).alias(f"_tp{i}") for i, t in enumerate(thresholds)],
        *[F.count_if(hit(t) & ~true).alias(f"_fp{i}") for i, t in enumerate(thresholds)],
    )
    points = F.array(
        *[
            F.struct(F.lit(t).alias("threshold"), F.col(f"_tp{i}").alias("tp"), F.col(f"_fp{i}").alias("fp"),
                     (F.col("_pos") - F.col(f"_tp{i}")).alias("fn"))
            for i, t in enumerate(thresholds)
        ]
    )
    rows = counts.select(*by, F.explode(points).alias("r")).select(*by, "r.*")
    rows = rows.withColumns(_rates(F.col("tp"), F.col("fp"), F.col("fn")))
    return rows.withColumn("n_pred", F.col("tp") + F.col("fp")).withColumn("precision_ok", F.col("precision") >= 0.90)


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Row with the highest F1 among thresholds that predict anything; ties go to the lower threshold."""
    rows = sweep.filter(F.col("n_pred") > 0)
    best = rows.agg(F.max_by(F.struct(*rows.columns), F.struct(F.col("f1"), -F.col("threshold"))).alias("b"))
    return best.select("b.*")


def compare_scores(df: DataFrame, scores: list[str], thresholds: list[float] = GRID_POINTS, label: str = "label") -> DataFrame:
    """Best threshold of each score column, one row per column, from one pass over the rows."""
    named = F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).alias("value")) for s in scores])).alias("_s")
    sweep = threshold_sweep(df.select(label, named).select(label, "_s.*"), "value", thresholds, label, ("score",)).filter("n_pred > 0")
    rest = [c for c in sweep.columns if c != "score"]
    best = sweep.groupBy("score").agg(F.max_by(F.struct(*rest), F.struct(F.col("f1"), -F.col("threshold"))).alias("b"))
    return best.select("b.*", "score")


def score_histogram(df: DataFrame, score: str, edges: list[float] = POSITIVE_BUCKETS, label: str = "label") -> DataFrame:
    """Number of relevant rows per half-open score bucket, empty buckets included."""
    s = F.col(score)
    pairs = list(zip(edges, edges[1:]))
    counts = df.filter(F.col(label) == "relevant").agg(
        *[F.count_if((s >= lo) & (s < hi)).alias(f"_b{i}") for i, (lo, hi) in enumerate(pairs)]
    )
    rows = F.array(
        *[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.col(f"_b{i}").alias("n")) for i, (lo, hi) in enumerate(pairs)]
    )
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def errors(df: DataFrame, score: str, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """False positives and false negatives, highest score first."""
    kind = F.when((F.col(label) == "irrelevant") & (F.col(predicted) == "relevant"), "FP").when(
        (F.col(label) == "relevant") & (F.col(predicted) == "irrelevant"), "FN"
    )
    return df.withColumn("error", kind).filter(F.col("error").isNotNull()).orderBy("error", F.desc(score), "id")


def rule_counts(df: DataFrame) -> DataFrame:
    return df.filter(F.col("rule_fired") != "").groupBy("rule_fired").agg(F.count(F.lit(1)).alias("n"))
