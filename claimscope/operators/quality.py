"""Data-quality checks, audits, study selection and report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_count_checks(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, n, expected, status) of tables against expected counts: OK, WARN within one percent, FAIL beyond or absent, INFO without expectation."""
    j = observed.join(expected, "name", "full_outer")
    off = F.abs(F.col("n") - F.col("expected"))
    status = F.when(F.col("expected").isNull(), "INFO").when(F.col("n").isNull(), "FAIL").when(off == 0, "OK").when(off <= 0.01 * F.col("expected"), "WARN").otherwise("FAIL")
    return j.select("name", "n", "expected", status.alias("status"))


def value_checks(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, status): equal within ``tol``, or after half-even rounding to ``digits``, any number from 0 to 9, where that is given."""
    j = expected.join(actual, "name", "left")
    near = F.abs(F.round(F.col("actual") - F.col("value"), 12)) <= F.coalesce("tol", F.lit(0.0))
    equal = lambda n: F.bround("actual", n) == F.bround("value", n)
    same = F.coalesce(*[F.when(F.col("digits") == n, equal(n)) for n in range(10)], near)
    return j.select("name", F.when(F.col("actual").isNull(), "MISSING").when(same, "OK").otherwise("FAIL").alias("status"))


def severity(checks: DataFrame) -> DataFrame:
    """One row: checks by status, and whether all passed."""
    n = lambda s: F.sum((F.col("status") == s).cast("int")).alias(f"n_{s.lower()}")
    return checks.agg(*[n(s) for s in ("OK", "WARN", "INFO", "FAIL")], (~F.bool_or(F.col("status") == "FAIL")).alias("passed"))


#: Statuses of an audit, the first rule that holds.
AUDIT = ("missing", "stale", "contradicted", "unverifiable", "rounded", "approximate", "external", "reproduced", "open")


def audit(claims: DataFrame) -> DataFrame:
    """(claim, audit): claims with value, evidence, tolerance, source and age_days get one of nine statuses."""
    v, e, t = F.col("value"), F.col("evidence"), F.coalesce("tolerance", F.lit(0.0))
    d = F.abs(F.round(v - e, 9))
    rules: list[tuple[Column, str]] = [
        (v.isNull(), "missing"),
        (F.col("age_days") > 365, "stale"),
        (e.isNull() & (F.col("source") == "external"), "external"),
        (e.isNull() & (F.col("source") == "none"), "unverifiable"),
        (e.isNull(), "open"),
        (d == 0, "reproduced"),
        (F.round(v, 2) == F.round(e, 2), "rounded"),
        (d <= t, "approximate"),
    ]
    status = F.coalesce(*[F.when(c, s) for c, s in rules], F.lit("contradicted"))
    return claims.select("claim", status.alias("audit"))


def schema_rows(df: DataFrame) -> DataFrame:
    """The schema as a table: (column, type)."""
    return df.sparkSession.createDataFrame(df.dtypes, "column string, type string")


def conformance(df: DataFrame, required: dict[str, str], expected_features: int | None = None, prefix: str = "feat_") -> DataFrame:
    """(column, status, n_rows, n_null) of required columns: ok, wrong type or missing, and how many rows lack a value; and a row on the number of feature columns."""
    want = df.sparkSession.createDataFrame(list(required.items()), "column string, wanted string")
    rows = want.join(schema_rows(df), "column", "left").select("column", F.when(F.col("type").isNull(), "missing").when(F.col("type") == F.col("wanted"), "ok").otherwise("wrong type").alias("status"))
    held = [c for c in required if c in df.columns]
    counted = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in held])
    each = counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col("_n").alias("n_rows"), (F.col("_n") - F.col(c)).alias("n_null")) for c in held])).alias("x")).select("x.*") if held else None
    rows = rows.join(each, "column", "left") if each is not None else rows.withColumns({"n_rows": F.lit(None).cast("long"), "n_null": F.lit(None).cast("long")})
    if expected_features is None:
        return rows
    n = sum(c.startswith(prefix) for c in df.columns)
    return rows.union(df.sparkSession.createDataFrame([(f"{prefix}*", "ok" if n == expected_features else "wrong number", None, None)], "column string, status string, n_rows long, n_null long"))


def study_selection(claims: DataFrame, n: int = 3) -> DataFrame:
    """(category, claim_id, rank, selection_score): clear positives, clear negatives and borderline claims, ``n`` each, ties to the smaller id.

    If no claim has a low probability, those marked not check-worthy take the negatives' place; the count behind this is one broadcast row.
    """
    p, c, v, h = (F.col(x) for x in ("checkworthiness_prob", "checkability_score", "verifiability_score", "harm_score"))
    fill = lambda x, d: F.coalesce(x, F.lit(float(d)))
    pos = claims.filter((p > 0.6) & (c.isNull() | (c > 60)) & (v.isNull() | (v > 60)))
    pos = pos.withColumn("s", fill(p, 0) * 100 + fill(c, 50) + fill(v, 50) + fill(h, 30) + F.when(F.col("is_viral"), 20.0).otherwise(0.0))
    low = claims.agg(F.sum((p < 0.4).cast("int")).alias("n_low"))
    neg = claims.crossJoin(F.broadcast(low)).filter(F.when(F.coalesce("n_low", F.lit(0)) > 0, p < 0.4).otherwise(~F.col("is_checkworthy")))
    neg = neg.withColumn("s", (1 - fill(p, 0.5)) * 100 + 100 - fill(c, 50) + 100 - fill(v, 50) + 100 - fill(h, 50)).drop("n_low")
    mid = claims.filter((p > 0.35) & (p < 0.65))
    mid = mid.withColumn("s", 100 - F.abs(p - 0.5) * 200 + (F.abs(fill(c, 50) - fill(h, 50)) + F.abs(fill(v, 50) - fill(h, 50))) * 0.5)
    out = None
    for name, part in (("positive", pos), ("negative", neg), ("borderline", mid)):
        top = part.select(F.lit(name).alias("category"), "claim_id", F.round("s", 6).alias("selection_score")).orderBy(F.desc("selection_score"), "claim_id").limit(n)
        out = top if out is None else out.unionByName(top)
    return out


def claim_report(claims: DataFrame, posts: DataFrame, found: DataFrame, tops: DataFrame, modules: list[str] | None = None) -> DataFrame:
    """(claim_id, report): a nested record as JSON — first post and its author, cluster size and engagement, module scores, verdict, lead hours.

    ``claims`` is (claim_id, cluster_id, prob) and the columns of ``modules``.
    """
    first = posts.groupBy("cluster_id").agg(F.min_by(F.struct("id", "user_id"), F.struct("created_at", "id")).alias("first"), F.count("*").alias("n_posts"), F.sum(F.col("like_count") + F.col("retweet_count")).alias("engagement"))
    lead = found.join(tops, "cluster_id").select("cluster_id", ((F.unix_seconds(F.col("peak_time").cast("timestamp")) - F.unix_seconds(F.col("detection_time").cast("timestamp"))) / 3600).cast("long").alias("lead_hours"))
    j = claims.join(first, "cluster_id").join(lead, "cluster_id", "left")
    record = F.struct(F.struct(F.col("first.id").alias("post"), F.col("first.user_id").alias("author")).alias("origin"), F.struct("n_posts", "engagement").alias("cluster"), *([F.struct(*modules).alias("modules")] if modules else []), F.when(F.col("prob") >= 0.5, "check").otherwise("skip").alias("verdict"), "lead_hours")
    return j.select("claim_id", F.to_json(record).alias("report"))
