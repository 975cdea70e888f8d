"""Evaluation of scored tables.

Multi-label scores are long rows (sample_id, label_id, logit, target): a sample
has one row per class, so one shuffle by sample and one sort serve all ranking
metrics. Masked-token scores are one row per position with the array of class
logits, and need no shuffle at all.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from visitseq.constants import IGNORED_LABEL


def soft_margin(logit: Column, target: Column) -> Column:
    """-[y log s(x) + (1-y) log s(-x)] in the form that cannot overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def sample_metrics(scored: DataFrame, *keep: str) -> DataFrame:
    """Average precision, ROC AUC and loss sum per sample.

    The running counts include ties, because the default frame of an ordered
    window takes in the rows of equal score. A sample without a positive has
    ap 0; one with a single class has no auc.
    """
    ranked = Window.partitionBy("sample_id").orderBy(F.desc("logit"))
    y = F.col("target")
    rows = scored.select(
        "sample_id", *keep, "target",
        soft_margin(F.col("logit"), y).alias("loss"),
        F.sum(y).over(ranked).alias("hits"),
        F.count("*").over(ranked).alias("seen"))
    per_sample = rows.groupBy("sample_id", *keep).agg(
        F.count("*").alias("n_labels"),
        F.sum(y).alias("pos"),
        F.sum(F.when(y == 1, F.col("hits") / F.col("seen"))).alias("precision_sum"),
        # Twice the pairs in order, a tie counting one: positives see the
        # negatives ahead of or level with them, negatives see the positives.
        F.sum(F.when(y == 1, F.col("hits") - F.col("seen")).otherwise(F.col("hits"))).alias("gain"),
        F.sum("loss").alias("loss_sum"))
    pairs = F.col("pos") * (F.col("n_labels") - F.col("pos"))
    return per_sample.select(
        "sample_id", *keep, "n_labels", "loss_sum",
        F.when(F.col("pos") > 0, F.col("precision_sum") / F.col("pos")).otherwise(0.0).alias("ap"),
        F.when(pairs > 0, (pairs + F.col("gain")) / (2 * pairs)).alias("auc"))


def sparse_sample_metrics(scored: DataFrame, n_labels: int, default_loss: float,
                          key=("patid",)) -> DataFrame:
    """The numbers of `sample_metrics` from `score.next_code_scores`, without a row per label.

    What is at or above a logit are the labels whose default is, corrected by the sample's own
    rows: each takes its default away and puts its logit in its place. `default_loss` is the
    loss of a sample whose labels all have their default logit and the target 0.
    """
    change = F.inline(F.array(
        F.struct(F.col("logit").alias("x"), F.lit(1).alias("w"), "target", "least", "above"),
        F.struct(F.col("if_new").alias("x"), F.lit(-1).alias("w"), F.lit(0).alias("target"),
                 F.lit(0).cast("bigint").alias("least"), F.lit(0).cast("bigint").alias("above"))))
    loss = soft_margin(F.col("logit"), F.col("target")) - soft_margin(F.col("if_new"), F.lit(0))
    rows = scored.select(*key, loss.alias("loss"), "logit", "if_new", "target", "least", "above")
    rows = rows.select(*key, "loss", change)
    ranked = Window.partitionBy(*key).orderBy(F.desc("x"))
    level = Window.partitionBy(*key, "x")
    hit = F.col("target") * (F.col("w") == 1).cast("int")
    rows = rows.select(
        *key, "w", hit.alias("hit"), F.when(F.col("w") == 1, F.col("loss")).alias("loss"),
        (F.col("least") + F.sum("w").over(ranked)).alias("seen"),
        (F.col("above") + F.sum("w").over(ranked) - F.sum("w").over(level)).alias("ahead"),
        F.sum(hit).over(ranked).alias("hits"), F.sum(hit).over(level).alias("level_hits"))
    # negatives below a positive count one, level ones a half
    level_negatives = F.col("seen") - F.col("ahead") - F.col("level_hits")
    misses = (F.col("ahead") - (F.col("hits") - F.col("level_hits"))) + level_negatives / 2
    per_sample = rows.groupBy(*key).agg(
        F.sum("hit").alias("pos"), (F.sum("loss") + default_loss).alias("loss_sum"),
        F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("seen"))).alias("precision_sum"),
        F.sum(F.when(F.col("hit") == 1, misses)).alias("misses"))
    negatives = n_labels - F.col("pos")
    pairs = F.col("pos") * negatives
    return per_sample.select(
        *key, F.lit(n_labels).cast("bigint").alias("n_labels"), "loss_sum",
        F.when(F.col("pos") > 0, F.col("precision_sum") / F.col("pos")).otherwise(0.0).alias("ap"),
        F.when(pairs > 0, 1 - F.col("misses") / pairs).alias("auc"))


def mean_metrics(samples: DataFrame, *group: str) -> DataFrame:
    """Means over the rows of `sample_metrics` in one pass; `rated` counts those with an auc."""
    return samples.groupBy(*group).agg(
        F.avg("ap").alias("ap"), F.avg("auc").alias("auc"), F.count("auc").alias("rated"),
        F.count("*").alias("samples"))


def average_precision(scored: DataFrame, *group: str) -> DataFrame:
    """Mean over the samples, overall or per group such as a batch."""
    return sample_metrics(scored, *group).groupBy(*group).agg(
        F.avg("ap").alias("ap"), F.count("*").alias("samples"))


def roc_auc(scored: DataFrame, *group: str) -> DataFrame:
    """Mean over the samples with both classes; `rated` counts them."""
    return sample_metrics(scored, *group).groupBy(*group).agg(
        F.avg("auc").alias("auc"), F.count("auc").alias("rated"), F.count("*").alias("samples"))


def multilabel_soft_margin(scored: DataFrame) -> DataFrame:
    """Mean over samples and classes."""
    return scored.agg(F.avg(soft_margin(F.col("logit"), F.col("target"))).alias("loss"))


def evaluate(scored: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """One report row: mean ap, mean auc, and the sum of the batches' mean losses."""
    batches = sample_metrics(scored, batch_col).groupBy(batch_col).agg(
        (F.sum("loss_sum") / F.sum("n_labels")).alias("loss"),
        F.sum("ap").alias("ap"), F.sum("auc").alias("auc"),
        F.count("*").alias("samples"), F.count("auc").alias("rated"))
    return batches.agg(
        (F.sum("ap") / F.sum("samples")).alias("ap"),
        F.try_divide(F.sum("auc"), F.sum("rated")).alias("auc"),
        F.sum("loss").alias("loss"),
        F.sum("samples").alias("samples"), F.sum("rated").alias("rated"),
        F.count("*").alias("batches"))


def _masked(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("label") != IGNORED_LABEL)


def predicted_class(logits: Column) -> Column:
    """Class of the highest logit, the lowest class among equals."""
    return F.array_position(logits, F.array_max(logits)) - 1


def masked_precision(scored: DataFrame, *group: str) -> DataFrame:
    """Share of masked positions (`logits`, `label`) whose top class is the label."""
    hit = (predicted_class(F.col("logits")) == F.col("label")).cast("double")
    return _masked(scored).groupBy(*group).agg(
        F.avg(hit).alias("precision"), F.count("*").alias("positions"))


def masked_cross_entropy(scored: DataFrame) -> DataFrame:
    """Mean over the masked positions of logsumexp(logits) - logits[label]."""
    top = _masked(scored).select("logits", "label", F.array_max("logits").alias("top"))
    exps = F.aggregate("logits", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top")))
    of_label = F.get("logits", F.col("label").cast("int"))
    return top.agg(F.avg(F.col("top") + F.log(exps) - of_label).alias("loss"))
