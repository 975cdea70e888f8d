"""Book-keeping of training runs."""

from pyspark.sql import DataFrame, Window, functions as F


def loss_progress(batch_losses: DataFrame, every: int) -> DataFrame:
    """Mean loss since the last report, at steps 0, every, 2*every, ...

    Report k covers the steps after report k-1 up to k*every. A report is complete when the
    epoch got to its step, whether or not that very step number is there; the steps after the
    last complete report are in none.
    """
    report = F.ceil(F.col("step") / every).cast("bigint") * every
    reached = batch_losses.groupBy("epoch").agg(F.max("step").alias("_reached"))
    return (batch_losses.groupBy("epoch", report.alias("report_step"))
            .agg(F.avg("loss").alias("mean_loss"), F.count("*").alias("steps"))
            .join(reached, "epoch").where(F.col("report_step") <= F.col("_reached"))
            .drop("_reached"))


def epoch_losses(batch_losses: DataFrame) -> DataFrame:
    """Loss, examples and steps per epoch, and the loss per example."""
    return batch_losses.groupBy("epoch").agg(
        F.sum("loss").alias("loss"), F.sum("examples").alias("examples"),
        F.count("*").alias("steps"),
        F.try_divide(F.sum("loss"), F.sum("examples")).alias("loss_per_example"))


def best_epochs(metrics: DataFrame, start: float = 0.0, metric: str = "ap") -> DataFrame:
    """The epochs of each run that beat the start value and every epoch before them."""
    before = (Window.partitionBy("run_id").orderBy("epoch")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (metrics.withColumn("_best", F.greatest(F.max(metric).over(before), F.lit(start)))
            .where(F.col(metric) > F.col("_best")).drop("_best"))
