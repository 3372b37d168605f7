"""Binary-classifier evaluation, threshold choice, ensembles, regression scores and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.operators.ranks import average_ranks, value_ranks, with_ranks


def _div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def add_rates(counts: DataFrame, beta: float | None = None) -> DataFrame:
    """accuracy, precision, recall, f1 (and f_beta) from tp, fp, fn, tn; 0 on empty denominators."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = counts.withColumn("accuracy", _div(tp + tn, tp + fp + fn + tn)).withColumn("precision", _div(tp, tp + fp)).withColumn("recall", _div(tp, tp + fn))
    out = out.withColumn("f1", _div(2.0 * tp, 2 * tp + fp + fn))
    if beta is not None:
        b = beta * beta
        out = out.withColumn("f_beta", F.when((tp + fn == 0) | (fp + tn == 0), 0.0).otherwise(_div((1 + b) * tp, (1 + b) * tp + b * fn + fp)))
    return out


def confusion(rows: DataFrame, by: list[str], threshold: Column) -> DataFrame:
    """tp, fp, fn, tn of ``prob >= threshold`` against ``label`` by group."""
    hit, pos = F.col("prob") >= threshold, F.col("label") == 1
    n = lambda c: F.sum(c.cast("int"))
    return rows.groupBy(*by).agg(n(hit & pos).alias("tp"), n(hit & ~pos).alias("fp"), n(~hit & pos).alias("fn"), n(~hit & ~pos).alias("tn"))


def thresholds(start: float = 0.30, stop: float = 0.70, step: float = 0.05) -> list[float]:
    """Rounded decimals from start to stop, both inclusive."""
    return [round(start + i * step, 6) for i in range(round((stop - start) / step) + 1)]


def sweep(rows: DataFrame, by: list[str], cuts: list[float], beta: float | None = None) -> DataFrame:
    """Metrics of every group at every threshold, in one pass: counts are taken per threshold before the shuffle."""
    t = F.explode(F.array(*map(F.lit, cuts)))
    return add_rates(confusion(rows.withColumn("threshold", t), [*by, "threshold"], F.col("threshold")), beta)


def best_threshold(metrics: DataFrame, by: list[str], ties: str = "lowest") -> DataFrame:
    """Row of the highest F1 by group; ties go to the ``lowest`` or ``highest`` threshold."""
    order = F.asc("threshold") if ties == "lowest" else F.desc("threshold")
    w = Window.partitionBy(*by).orderBy(F.round("f1", 12).desc(), order)
    return metrics.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def calibrated(rows: DataFrame, by: list[str], fit_split: str, cuts: list[float]) -> DataFrame:
    """Threshold chosen on one value of ``split`` and applied to the others."""
    chosen = best_threshold(sweep(rows.filter(F.col("split") == fit_split), by, cuts), by).select(*by, "threshold")
    rest = rows.filter(F.col("split") != fit_split).join(F.broadcast(chosen), by)  # a row a model
    return add_rates(confusion(rest, [*by, "split", "threshold"], F.col("threshold")))


def ensembles(long: DataFrame, weights: DataFrame, temperatures: list[float]) -> DataFrame:
    """(method, sample_id, label, prob): soft, weighted, hard, max_confidence, median, geometric, rank and temperature ensembles of (model, sample_id, label, prob).

    ``weights`` is (model, w), a row a model. Confidence ties go to the first model by name.
    """
    p = F.col("prob")
    ranked = average_ranks(long, ["model"], "prob", "r", "of").withColumn("r", F.col("r") / F.col("of")).join(F.broadcast(weights), "model")
    logit = F.log(F.greatest(p, F.lit(1e-8)) / F.greatest(1 - p, F.lit(1e-8)))
    g = ranked.groupBy("sample_id", "label").agg(
        F.avg("prob").alias("soft"),
        (F.sum(p * F.col("w")) / F.sum("w")).alias("weighted"),
        F.avg((p >= 0.5).cast("double")).alias("hard"),
        F.min_by("prob", F.struct(-F.abs(p - 0.5), "model")).alias("max_confidence"),
        F.percentile("prob", F.lit(0.5)).alias("median"),
        F.exp(F.avg(F.log(F.greatest(p, F.lit(1e-8))))).alias("geometric"),
        F.avg("r").alias("rank"),
        *[F.avg(1 / (1 + F.exp(-logit / t))).alias(f"temperature_{round(t * 100)}") for t in temperatures],
    )
    names = [c for c in g.columns if c not in ("sample_id", "label")]
    return g.unpivot(["sample_id", "label"], names, "method", "prob")


def late_fusion(a: DataFrame, b: DataFrame, w: float = 0.5) -> DataFrame:
    """w * p1 + (1 - w) * p2, joined by sample_id."""
    return a.select("sample_id", "label", F.col("prob").alias("p1")).join(b.select("sample_id", F.col("prob").alias("p2")), "sample_id").select("sample_id", "label", (w * F.col("p1") + (1 - w) * F.col("p2")).alias("prob"))


def reproduction_status(rows: DataFrame, value: str, published: str) -> DataFrame:
    """Adds ``status``: reproduced without a published value or within .002, close within .01, else different."""
    d = F.abs(F.round(F.col(value) - F.col(published), 9))
    return rows.withColumn("status", F.when(F.col(published).isNull() | (d <= 0.002), "reproduced").when(d <= 0.01, "close").otherwise("different"))


def spearman(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks for ties; 0 where a side is constant."""
    r = rows.select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    r = with_ranks(with_ranks(r, value_ranks(r, by, "_x"), by, "_x", "rx"), value_ranks(r, by, "_y"), by, "_y", "ry")
    c = F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry"))
    return r.groupBy(*by).agg(F.coalesce(c, F.lit(0.0)).alias("rho"), F.count("*").alias("n"))


def screen_features(rows: DataFrame, features: list[str], target: str, least: int = 10) -> DataFrame:
    """Spearman of each feature with the target over non-NaN rows (more than ``least``), with significance marks by the t approximation."""
    long = rows.select(target, *[F.col(c).cast("double").alias(c) for c in features]).unpivot([target], features, "feature", "x")
    long = long.filter(F.col("x").isNotNull() & ~F.isnan("x"))
    s = spearman(long, ["feature"], "x", target).filter(F.col("n") > least)
    t = F.abs(F.col("rho")) * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("rho") ** 2, F.lit(1e-12)))
    return s.withColumn("mark", F.when(t > 3.291, "***").when(t > 2.576, "**").when(t > 1.96, "*").otherwise("")).withColumn("weak", F.abs(F.col("rho")) < 0.05)


def regression_scores(rows: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    """R2 = 1 - SSE / SST (0 where y is constant) and MAE."""
    w = Window.partitionBy(*by)
    d = rows.withColumn("_m", F.avg(y).over(w))
    sse, sst = F.sum((F.col(y) - F.col(p)) ** 2), F.sum((F.col(y) - F.col("_m")) ** 2)
    return d.groupBy(*by).agg(F.when(sst > 0, 1 - sse / sst).otherwise(0.0).alias("r2"), F.avg(F.abs(F.col(y) - F.col(p))).alias("mae"))


def weighted_losses(rows: DataFrame) -> DataFrame:
    """Class weight, entropy-weighted squared error and weighted cross entropy of (label, prob) as table metrics."""
    y, p = F.col("label").cast("double"), F.least(F.greatest(F.col("prob"), F.lit(1e-7)), F.lit(1 - 1e-7))
    h = -(p * F.log(p) + (1 - p) * F.log(1 - p)) / F.log(F.lit(2.0))
    w = 1 - F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0))
    pos = F.sum(y)
    ratio = F.when(pos > 0, (F.count("*") - pos) / pos).otherwise(1.0)
    ce_pos, ce_neg = F.sum(-y * F.log(p)), F.sum(-(1 - y) * F.log(1 - p))
    return rows.groupBy("model").agg(ratio.alias("pos_weight"), (F.sum(w * (y - p) ** 2) / F.sum(w)).alias("weighted_mse"), ((ratio * ce_pos + ce_neg) / F.count("*")).alias("weighted_ce"))


def run_statistics(rows: DataFrame, by: list[str], published: float = 0.4569) -> DataFrame:
    """Figures of a run with columns score, tokens_in, tokens_out, latency_ms: the standard deviation is the sample's."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("score").alias("mean_score"),
        F.stddev_samp("score").alias("std_score"),
        F.percentile("score", F.lit(0.5)).alias("median_score"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.avg("latency_ms").alias("mean_latency_ms"),
        (F.avg("score") - published).alias("delta"),
    )
