"""Burst and anomaly detectors on hourly series, and their scores.

The detectors are defined here from the papers named; parameters are arguments. Every one is a window function or a walk over one
cluster's hours, so a run over many clusters needs one shuffle by cluster.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from claimscope.operators.timeseries import history


def _burst_path(counts: np.ndarray, scale: float, gamma: float, states: int) -> np.ndarray:
    """State with the least cost so far at each window; ties to the lower."""
    mean, climb = counts.mean(), gamma * np.log(len(counts))
    rate = mean * scale ** np.arange(states)
    rise = climb * np.maximum(np.arange(states)[None, :] - np.arange(states)[:, None], 0)  # from row to column
    cost, out = climb * np.arange(states), np.zeros(len(counts), dtype=np.int32)
    for i, x in enumerate(counts):
        cost = (cost[:, None] + rise).min(axis=0) + rate - x * np.log(rate)
        out[i] = int(cost.argmin())
    return out


def _walked(series: DataFrame, name: str, kind: str, value: str, walk: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Adds a column that ``walk`` makes of one cluster's values in order of time; the other columns go along, so the series is read once."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("timestamp")
        return rows.append_column(name, pa.array(walk(rows.column(value).to_numpy().astype(float))))

    return series.groupBy("cluster_id").applyInArrow(run, StructType([*series.schema.fields, StructField(name, {"double": DoubleType(), "int": IntegerType()}[kind])]))


def kleinberg_states(series: DataFrame, scale: float = 2.0, gamma: float = 1.0, states: int = 3) -> DataFrame:
    """Adds ``kleinberg_state``: the cheapest state at each window of the burst automaton (Kleinberg 2002), without look-ahead.

    State i emits Poisson counts at mean * scale ** i, mean over the cluster's series; a rise costs gamma * ln(windows) a level, a fall nothing.
    Ties take the lower state. A group is one cluster's hours, whose number is that of the hours observed; the walk over them is linear.
    """

    return _walked(series, "kleinberg_state", "int", "tweet_count", lambda x: _burst_path(x, scale, gamma, states))


def simple_triggers(series: DataFrame, residual: float = 10.0, ratio: float = 3.0, velocity: float = 10.0) -> DataFrame:
    """Residual x - mean, ratio x / mean and velocity x - previous against earlier windows, and their triggers; 0 without history."""
    w, order = history(), Window.partitionBy("cluster_id").orderBy("timestamp")
    x, mean = F.col("tweet_count"), F.avg("tweet_count").over(w)
    out = series.select(
        "*",
        F.coalesce(x - mean, F.lit(0.0)).alias("residual"),
        F.coalesce(x / mean, F.lit(0.0)).alias("ratio"),
        F.coalesce(x - F.lag("tweet_count").over(order), F.lit(0)).alias("velocity"),
    )
    return out.withColumns({f"{n}_trigger": F.col(n) > t for n, t in (("residual", residual), ("ratio", ratio), ("velocity", velocity))})


def cold_start(scored: DataFrame, min_history: int = 6, threshold: float = 3.0) -> DataFrame:
    """Adds ``is_cold`` and ``cold_z``: clusters with little history are compared with all clusters' earlier hours.

    The hours are summed first, so the running sums go over as many rows as there are hours.
    """
    x = F.col("tweet_count").cast("double")
    hours = scored.groupBy("timestamp").agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    w = Window.orderBy("timestamp").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("timestamp", *[F.sum(c).over(w).alias(c) for c in "nsq"])
    mean, var = F.col("s") / F.col("n"), F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2
    hours = hours.select("timestamp", mean.alias("g_mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("g_std"))
    out = scored.join(hours, "timestamp").withColumn("is_cold", F.col("n_prev") < min_history)
    z = F.when(F.col("g_std") > 1e-9, (F.col("tweet_count") - F.col("g_mean")) / F.col("g_std")).otherwise(0.0)
    return out.withColumn("cold_z", z).withColumn("cold_trigger", F.col("is_cold") & (F.col("cold_z") > threshold)).drop("g_mean", "g_std")


def ensemble_trigger(scored: DataFrame, burst_state: int = 2) -> DataFrame:
    """Adds ``trigger_type``: cold, both, z_only, burst_only, or none; exclusive, in this order."""
    z, burst = F.col("is_anomaly_trigger"), F.col("kleinberg_state") >= burst_state
    kind = F.when(F.col("cold_trigger"), "cold").when(z & burst, "both").when(z, "z_only").when(burst & ~F.col("is_cold"), "burst_only").otherwise("none")
    return scored.withColumn("trigger_type", kind)


def _weights(n: int, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """Weight of each earlier window of a block for each later one, and what is left at each of the weights before the block."""
    lag = np.arange(n)[:, None] - np.arange(n)[None, :]
    return np.where(lag > 0, decay * (1 - decay) ** (np.maximum(lag, 1) - 1.0), 0.0), (1 - decay) ** np.arange(n, dtype=float)


def _kernel_scores(x: np.ndarray, decay: float, gammas: list[float], step: int = 256) -> np.ndarray:
    """(gammas, windows): 1 - decayed kernel mean similarity of each window to all before it.

    Windows before a block of ``step`` count by value: each distinct value holds the decayed weight of all its windows, so nothing is left out and the
    work is windows times distinct values.
    """
    values, code = np.unique(x, return_inverse=True)
    held, out = np.zeros(len(values)), np.ones((len(gammas), len(x)))
    for lo in range(0, len(x), step):
        now = x[lo : lo + step]
        weight, left = _weights(len(now), decay)
        for j, gamma in enumerate(gammas):
            before = np.exp(-gamma * (now[:, None] - values[None, :]) ** 2) @ held
            out[j, lo : lo + step] -= left * before + (weight * np.exp(-gamma * (now[:, None] - now[None, :]) ** 2)).sum(axis=1)
        held *= (1 - decay) ** len(now)
        np.add.at(held, code[lo : lo + step], decay * left[::-1])
    return out


def _fourier_scores(x: np.ndarray, decay: float, gamma: float, components: int, seed: int, step: int = 256) -> np.ndarray:
    """Like ``_kernel_scores``, with random Fourier features: what is held of the past is their decayed mean."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0.0, np.sqrt(2 * gamma), components), rng.uniform(0.0, 2 * np.pi, components)
    held, out = np.zeros(components), np.ones(len(x))
    for lo in range(0, len(x), step):
        now = x[lo : lo + step]
        weight, left = _weights(len(now), decay)
        z = np.cos(now[:, None] * w + b) * np.sqrt(2 / components)
        out[lo : lo + step] -= left * (z @ held) + (weight * (z @ z.T)).sum(axis=1)
        held = held * (1 - decay) ** len(now) + (decay * left[::-1]) @ z
    return out


def expose_grid(series: DataFrame, decays: list[float], gammas: list[float], values: list[str]) -> DataFrame:
    """(cluster_id, timestamp, decay, gamma, signal, expose_score): the score of ``expose`` for every setting, in one shuffle by cluster."""

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("timestamp")
        parts = []
        for value in values:
            x = rows[value].to_numpy(dtype=float)
            for decay in decays:
                for gamma, e in zip(gammas, _kernel_scores(x, decay, gammas), strict=True):
                    parts.append(rows[["cluster_id", "timestamp"]].assign(decay=decay, gamma=gamma, signal=value, expose_score=e))
        return pd.concat(parts)

    kind = {f.name: f.dataType.simpleString() for f in series.schema}
    rows = series.select("cluster_id", "timestamp", *[F.col(v).cast("double").alias(v) for v in values])
    return rows.groupBy("cluster_id").applyInPandas(score, f"cluster_id {kind['cluster_id']}, timestamp {kind['timestamp']}, decay double, gamma double, signal string, expose_score double")


def expose(series: DataFrame, value: str = "tweet_count", gamma: float = 0.1, decay: float = 0.1) -> DataFrame:
    """Adds ``expose_score`` = 1 - decayed kernel mean similarity to all earlier windows (after Schneider et al. 2016).

    The exact Gaussian kernel over the whole history; weights are decay * (1 - decay) ** (windows between). A group is one cluster's hours.
    """
    return _walked(series, "expose_score", "double", value, lambda x: _kernel_scores(x, decay, [gamma])[0])


def expose_fourier(series: DataFrame, value: str = "tweet_count", gamma: float = 0.1, decay: float = 0.1, components: int = 20_000, seed: int = 42) -> DataFrame:
    """Adds ``expose_score`` as ``expose`` does, from ``components`` random Fourier features: the work is linear in the windows whatever their values,
    and the past is one vector, as a stream needs it. The error's standard deviation is at most 1 / sqrt(components).
    """
    return _walked(series, "expose_score", "double", value, lambda x: _fourier_scores(x, decay, gamma, components, seed))


def trailing_baselines(series: DataFrame, rows: int = 12, random_p: float = 0.05) -> DataFrame:
    """Votes of simple detectors over the last ``rows`` windows: sigma rule, mean, median deviation, EWMA; their majority; a z-score and a random one beside it."""
    w = history(rows=rows)
    x = F.col("tweet_count").cast("double")
    s = series.withColumn("past", F.collect_list(x).over(w)).withColumn("n_past", F.size("past"))
    s = s.withColumn("mu", F.try_divide(F.aggregate("past", F.lit(0.0), lambda a, v: a + v), "n_past"))
    s = s.withColumn("sd", F.sqrt(F.try_divide(F.aggregate("past", F.lit(0.0), lambda a, v: a + (v - F.col("mu")) ** 2), "n_past")))
    middle = lambda c: (F.element_at(F.array_sort(c), F.floor((F.size(c) + 1) / 2).cast("int")) + F.element_at(F.array_sort(c), F.floor((F.size(c) + 2) / 2).cast("int"))) / 2
    s = s.withColumn("med", F.when(F.col("n_past") > 0, middle(F.col("past"))))
    s = s.withColumn("mad", F.when(F.col("n_past") > 0, middle(F.transform("past", lambda v: F.abs(v - F.col("med"))))))
    s = s.withColumn("ewma", F.aggregate("past", F.lit(None).cast("double"), lambda a, v: F.when(a.isNull(), v).otherwise(0.7 * a + 0.3 * v)))
    votes = {
        "vote_sigma": x > F.col("mu") + 3 * F.col("sd"),
        "vote_mean": x > 2 * F.col("mu"),
        "vote_mad": x > F.col("med") + 6 * F.col("mad"),
        "vote_ewma": x > F.col("ewma") + 3 * F.col("sd"),
    }
    s = s.withColumns({k: F.coalesce(v & (F.col("n_past") >= 6), F.lit(False)).cast("int") for k, v in votes.items()})
    uniform = F.conv(F.substring(F.md5(F.concat_ws("|", "cluster_id", F.unix_seconds(F.col("timestamp").cast("timestamp")))), 1, 8), 16, 10).cast("double") / float(2**32)
    total = sum((F.col(k) for k in votes), F.lit(0))
    z = F.round(F.try_divide(x - F.col("mu"), F.col("sd")), 9)
    s = s.withColumn("z_trigger", (F.col("n_past") >= 6) & (z > 3))
    return s.withColumn("skyline_trigger", total >= 3).withColumn("random_trigger", uniform < random_p).drop("past", "n_past", "mu", "sd", "med", "mad", "ewma")


def change_point(series: DataFrame, rows: int = 24) -> DataFrame:
    """Adds ``change_score``: log-likelihood gain of two Poisson rates over one, split before the current window of the last ``rows``."""
    w = history(rows=rows)
    x, n, s = F.col("tweet_count"), F.count("*").over(w), F.sum("tweet_count").over(w)
    term = lambda c, m: F.when(c > 0, c * F.log(c / m)).otherwise(0.0)
    return series.withColumn("change_score", F.when(n >= 6, term(x, 1) + term(s, n) - term(x + s, n + 1)).otherwise(0.0))


def loda(points: DataFrame, key: str, columns: list[str], projections: int = 16, bins: float = 2.0) -> DataFrame:
    """Mean -ln frequency over sparse random projections of standardised columns (after Pevny 2016): (key, loda_score).

    Weights are -1, 0 or 1 from an MD5 of projection and column, so that they are fixed; the histogram has cells of 1 / ``bins``.
    """
    import hashlib

    sign = {(j, c): int(hashlib.md5(f"{j}|{c}".encode()).hexdigest()[:8], 16) % 3 - 1 for j in range(projections) for c in columns}
    stats = points.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns], F.count("*").alias("total"))  # one row
    rows = points.crossJoin(F.broadcast(stats))
    z = {c: F.when(F.col(f"s_{c}") > 0, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0) for c in columns}
    cells = F.array(*[F.floor(F.round(sum((sign[j, c] * z[c] for c in columns if sign[j, c]), F.lit(0.0)) * bins, 6)) for j in range(projections)])
    each = rows.select(key, "total", F.posexplode(cells).alias("j", "cell"))
    counts = each.groupBy("j", "cell").agg(F.count("*").alias("c"))
    return each.join(counts, ["j", "cell"]).groupBy(key).agg(F.avg(-F.log(F.col("c") / F.col("total"))).alias("loda_score"))


def peaks(series: DataFrame) -> DataFrame:
    """First hour of the largest engagement by cluster, and the number of rows: (cluster_id, peak_time, top, n_rows)."""
    first = F.max_by("timestamp", F.struct("engagement", -F.unix_micros(F.col("timestamp").cast("timestamp"))))
    return series.groupBy("cluster_id").agg(first.alias("peak_time"), F.max("engagement").alias("top"), F.count("*").alias("n_rows"))


def _hours(a: str, b: str) -> Column:
    return (F.unix_seconds(F.col(b).cast("timestamp")) - F.unix_seconds(F.col(a).cast("timestamp"))) / 3600


def nab_figures(rows: DataFrame, fp_weight: float = 0.1, by: list[str] | None = None) -> DataFrame:
    """Score over clusters with columns lead_h (null if missed), is_fp, n_tp, n_detections.

    100 * (sum of lead / 24 over detected clusters - fp_weight * false-positive clusters) / clusters, with the rates beside it.
    """
    clusters = F.count("*")
    detected = F.count("lead_h")
    g = rows.groupBy(*(by or [])).agg(
        clusters.alias("clusters"),
        detected.alias("detected"),
        (100 * (F.coalesce(F.sum("lead_h"), F.lit(0.0)) / 24 - fp_weight * F.sum(F.col("is_fp").cast("int"))) / clusters).alias("nab_score"),
        (100 * detected / clusters).alias("detection_rate"),
        (100 - 100 * detected / clusters).alias("missed_rate"),
        F.when(F.sum("n_detections") > 0, 100 * F.sum("n_tp") / F.sum("n_detections")).otherwise(0.0).alias("precision"),
        F.percentile("lead_h", F.lit(0.5)).alias("median_lead"),
    )
    return g


def lead_rows(triggers: DataFrame, tops: DataFrame, window_h: int = 24, by: list[str] | None = None) -> DataFrame:
    """A row a cluster: lead of the first trigger in [peak - window_h, peak), whether any trigger lies outside, and counts."""
    by = by or []
    lead = _hours("timestamp", "peak_time")
    inside = (lead > 0) & (lead <= window_h)
    t = triggers.select(*by, "cluster_id", "timestamp").join(tops, "cluster_id")
    g = t.groupBy(*by, "cluster_id").agg(F.max(F.when(inside, lead)).alias("lead_h"), F.max((~inside).cast("int")).alias("out"), F.sum(inside.cast("int")).alias("n_tp"), F.count("*").alias("n_detections"))
    everyone = tops if not by else tops.crossJoin(triggers.select(*by).distinct())  # by: a bounded list of settings
    out = everyone.join(g, [*by, "cluster_id"], "left")
    return out.select(*by, "cluster_id", "n_rows", "lead_h", (F.coalesce("out", F.lit(0)) == 1).alias("is_fp"), F.coalesce("n_tp", F.lit(0)).alias("n_tp"), F.coalesce("n_detections", F.lit(0)).alias("n_detections"))


def lead_times(found: DataFrame, tops: DataFrame) -> DataFrame:
    """Signed hours from detection to peak: median, mean, quartiles and how many are positive."""
    h = found.join(tops, "cluster_id").select(_hours("detection_time", "peak_time").alias("h"))
    q = lambda p: F.percentile("h", F.lit(p))
    return h.agg(F.count("*").alias("n"), q(0.5).alias("median_lead"), F.avg("h").alias("mean_lead"), q(0.25).alias("p25_lead"), q(0.75).alias("p75_lead"), F.sum((F.col("h") > 0).cast("int")).alias("n_positive"))


def ground_truth(tops: DataFrame, found: DataFrame, thresholds: list[float]) -> DataFrame:
    """tp, fp, fn, tn, F1 and F2 of detection against total engagement at each threshold and at the 90th percentile, in one pass."""
    rows = tops.join(found.select("cluster_id", F.lit(1).alias("hit")), "cluster_id", "left").select("total", F.coalesce("hit", F.lit(0)).alias("hit"))
    p90 = rows.agg(F.percentile("total", F.lit(0.9)).alias("p90"))
    rows = rows.crossJoin(F.broadcast(p90))
    cuts = [F.struct(F.lit(f">={t:g}").alias("rule"), F.lit(float(t)).alias("cut")) for t in thresholds]
    rows = rows.select("hit", "total", F.explode(F.array(*cuts, F.struct(F.lit("p90").alias("rule"), F.col("p90").cast("double").alias("cut")))).alias("c"))
    pos, hit = F.col("total") >= F.col("c.cut"), F.col("hit") == 1
    n = lambda cond: F.sum(cond.cast("int"))
    g = rows.groupBy(F.col("c.rule").alias("rule")).agg(n(pos & hit).alias("tp"), n(~pos & hit).alias("fp"), n(pos & ~hit).alias("fn"), n(~pos & ~hit).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    f = lambda b: F.when(tp > 0, (1 + b * b) * tp / ((1 + b * b) * tp + b * b * fn + fp)).otherwise(0.0)
    return g.withColumn("f1", f(1)).withColumn("f2", f(2))


def compare_detectors(triggers: DataFrame, tops: DataFrame, positive: float) -> DataFrame:
    """By detector: clusters found, true positives (total engagement at or above ``positive``), recall over all such clusters, precision,
    and first detections with fewer than six earlier windows (sparse) or more (mature)."""
    first = triggers.groupBy("detector", "cluster_id").agg(F.min_by("n_prev", "timestamp").alias("n_prev"))
    pos = F.col("total") >= positive
    n = lambda c: F.sum(c.cast("int"))
    everyone = tops.agg(n(pos).alias("positives"))
    g = first.join(tops, "cluster_id").crossJoin(F.broadcast(everyone)).groupBy("detector", "positives").agg(F.count("*").alias("unique_clusters"), n(pos).alias("tp"), n(F.col("n_prev") < 6).alias("sparse"), n(F.col("n_prev") >= 6).alias("mature"))
    return g.select("detector", "unique_clusters", "tp", F.coalesce(F.try_divide("tp", "positives"), F.lit(0.0)).alias("recall"), (F.col("tp") / F.col("unique_clusters")).alias("precision"), "sparse", "mature")
