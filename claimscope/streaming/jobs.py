"""Structured Streaming jobs: hourly aggregates, a stateful detector, clustering by micro-batch, a response cache, stage counters."""

from __future__ import annotations

import math
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from claimscope.operators.clustering import assign, cap_clusters, centroids, form_clusters, update_state
from claimscope.session import cut, discard


def replay(spark: SparkSession, path: str, schema: str, max_files: int = 1) -> DataFrame:
    """A stream of Parquet files in the order of their times."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def hourly(posts: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Tumbling hourly aggregates by cluster with a watermark; users are counted approximately, as a stream must."""
    return (
        posts.withColumn("created_at", F.col("created_at").cast("timestamp"))
        .withWatermark("created_at", delay)
        .groupBy("cluster_id", F.window("created_at", "1 hour").alias("w"))
        .agg(F.count("*").alias("tweet_count"), F.sum(F.col("like_count") + F.col("retweet_count")).alias("engagement"), F.approx_count_distinct("user_id").alias("unique_users"))
        .select("cluster_id", F.col("w.start").alias("timestamp"), "tweet_count", "engagement", "unique_users")
    )


def heartbeat(posts: DataFrame, delay: str = "3 hours") -> DataFrame:
    """One row of a finite replay's schema without a cluster, later than all others by more than the watermark: it closes the last windows and never closes its own."""
    last = posts.agg(F.max("created_at").alias("t"))
    return last.select(*[(F.col("t") + F.expr(f"INTERVAL {delay}") if f.name == "created_at" else F.lit(None)).cast(f.dataType).alias(f.name) for f in posts.schema])


class BurstDetector(StatefulProcessor):
    """Running mean and squared deviation (Welford) of a cluster's counts and engagement, and the costs of a burst automaton. State has a fixed size.

    z of each window is taken against all before it. State j of the automaton emits Poisson counts at 2 ** j times the mean of the earlier windows (the count itself at the first);
    a rise costs ln(windows so far) a level, a fall nothing; ties take the lower state.
    """

    STATES = 3

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("history", "n long, mean_c double, dev_c double, mean_e double, dev_e double, costs array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, mc, dc, me, de, costs = self.state.get() if self.state.exists() else (0, 0.0, 0.0, 0.0, 0.0, [0.0] * self.STATES)
        batch = pd.concat(list(rows)).sort_values("timestamp")
        out = []
        for t, x, e in zip(batch["timestamp"], batch["tweet_count"], batch["engagement"], strict=True):
            x, e = float(x), float(e)
            z = [(v - m) / (d / n) ** 0.5 if n and d / n > 1e-12 else 0.0 for v, m, d in ((x, mc, dc), (e, me, de))]
            rate, climb = max(mc if n else x, 1e-9), math.log(n + 1)
            costs = [min(c + climb * max(j - i, 0) for i, c in enumerate(costs)) + rate * 2**j - x * math.log(rate * 2**j) for j in range(self.STATES)]
            out.append((key[0], t, int(x), n, *z, costs.index(min(costs)), n >= 6 and round(max(z), 9) > 3))
            n += 1
            mc, dc, me, de = mc + (x - mc) / n, dc + (x - mc) * (x - mc - (x - mc) / n), me + (e - me) / n, de + (e - me) * (e - me - (e - me) / n)
        self.state.update((n, mc, dc, me, de, costs))
        yield pd.DataFrame(out, columns=["cluster_id", "timestamp", "tweet_count", "n_prev", "z_score_count", "z_score_engagement", "burst_state", "is_trigger"])

    def close(self) -> None:
        pass


DETECTED = "cluster_id long, timestamp timestamp, tweet_count long, n_prev long, z_score_count double, z_score_engagement double, burst_state int, is_trigger boolean"


def detect(windows: DataFrame) -> DataFrame:
    """z-scores, burst state and triggers on a stream of closed windows (cluster_id, timestamp, tweet_count, engagement), in time order within a cluster.

    Windows without ``engagement`` have none: 0.
    """
    windows = windows if "engagement" in windows.columns else windows.withColumn("engagement", F.lit(0).cast("long"))
    return windows.groupBy("cluster_id").transformWithStateInPandas(statefulProcessor=BurstDetector(), outputStructType=DETECTED, outputMode="Append", timeMode="None")


_HOUR, _NO_CLUSTER = 3_600_000, -(1 << 63)  # a null among keys would make the others floats on their way to Python


class HourlyDetector(StatefulProcessor):
    """Hours of a cluster, closed by event-time timers, and their z-scores against the session's earlier hours.

    Posts are added to the open hour they fall in. When the watermark passes an hour's end its timer closes it and gives a row, with 0 posts for an hour without
    any. After ``idle`` empty hours in a row the session ends: its history goes, and with no open hours the whole state. Posts of closed hours are late and
    left out, as Spark leaves out rows behind the watermark. The rows do not depend on how posts fall into batches.
    """

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "hour long", "tweet_count long, engagement long")
        self.session = handle.getValueState("session", "next long, n long, mean double, dev double, empty long")

    def _plan(self, next_hour: int | None) -> None:
        """One timer: the end of the next hour to close."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if next_hour is None and self.open.exists():
            next_hour = min(k[0] for k in self.open.keys())
        if next_hour is not None:
            self.handle.registerTimer(next_hour + _HOUR)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        closed = self.session.get()[0] if self.session.exists() else None
        for batch in () if key[0] == _NO_CLUSTER else rows:
            hours = batch["hour"].astype("int64")
            sums = batch.groupby(hours).agg(n=("hour", "size"), e=("engagement", "sum"))
            for hour, n, e in sums.itertuples():
                if closed is not None and hour < closed:
                    continue
                known = self.open.getValue((hour,)) if self.open.containsKey((hour,)) else (0, 0)
                self.open.updateValue((hour,), (int(known[0] + n), int(known[1] + e)))
        self._plan(closed)
        yield pd.DataFrame({c: pd.Series(dtype=t) for c, t in _CLOSED.items()})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        at, n, mean, dev, empty = self.session.get() if self.session.exists() else (None, 0, 0.0, 0.0, 0)
        out = []
        while True:
            if at is None:
                if not self.open.exists():
                    break
                at, n, mean, dev, empty = min(k[0] for k in self.open.keys()), 0, 0.0, 0.0, 0
            if at + _HOUR > now:
                break
            x, e = self.open.getValue((at,)) if self.open.containsKey((at,)) else (0, 0)
            if x:
                self.open.removeKey((at,))
            z = (x - mean) / (dev / n) ** 0.5 if n and dev / n > 1e-12 else 0.0
            out.append((key[0], at // 1000, x, e, n, z))
            n += 1
            mean, dev = mean + (x - mean) / n, dev + (x - mean) * (x - mean - (x - mean) / n)
            empty, at = 0 if x else empty + 1, at + _HOUR
            if empty >= self.idle:
                at = None
        if at is None or n == 0:
            self.session.clear()
        else:
            self.session.update((at, n, mean, dev, empty))
        self._plan(at)
        yield pd.DataFrame(out, columns=list(_CLOSED)).astype(_CLOSED)

    def close(self) -> None:
        pass


_CLOSED = {"cluster_id": "int64", "hour": "int64", "tweet_count": "int64", "engagement": "int64", "n_prev": "int64", "z_score_count": "float64"}
HOURS = "cluster_id long, hour long, tweet_count long, engagement long, n_prev long, z_score_count double"


def detect_hours(posts: DataFrame, delay: str = "2 hours", idle: int = 24) -> DataFrame:
    """(cluster_id, hour, tweet_count, engagement, n_prev, z_score_count) of every hour of a stream of posts, empty ones too, as the watermark closes it; ``hour`` in seconds since 1970.

    A session runs from its first hour to ``idle`` empty hours after the last post. Posts without a cluster only move the watermark.
    """
    when = F.col("created_at").cast("timestamp")
    rows = posts.select(F.coalesce("cluster_id", F.lit(_NO_CLUSTER)).alias("cluster_id"), when.alias("created_at"), (F.col("like_count") + F.col("retweet_count")).alias("engagement"))
    rows = rows.withWatermark("created_at", delay).withColumn("hour", F.unix_millis(F.date_trunc("hour", "created_at")))
    return rows.groupBy("cluster_id").transformWithStateInPandas(statefulProcessor=HourlyDetector(idle), outputStructType=HOURS, outputMode="Append", timeMode="EventTime")


def _version(spark: SparkSession, path: str, schema: str, n: int) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/version={n}") if n >= 0 else spark.createDataFrame([], schema)


def _versioned(path: str, batch_id: int, table: DataFrame) -> None:
    table.write.mode("overwrite").parquet(f"{path}/version={batch_id}")


CLUSTERS = "cluster_id long, centroid array<double>, size long, representatives array<string>"


def cluster_batches(vectors: DataFrame, state_path: str, checkpoint: str, threshold: float, most: int | None = None):
    """Online clustering as a sink: each micro-batch is assigned to the state's centroids, the rest forms clusters, and a new version is written.

    With ``most`` clusters at most, only the largest new ones that still find room are kept; the other rows go to the nearest cluster of all, which counts
    them but does not move. Versions are named by batch id and replaced if a batch is run again, so a failed batch leaves nothing behind. ``vectors`` is (vec_id, vec).
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = cut(batch.select("vec_id", "vec").repartition("vec_id"))  # a batch may be one file
        state = _version(batch.sparkSession, state_path, CLUSTERS, batch_id - 1)
        found = cut(assign(batch, "vec_id", state, threshold))
        old = update_state(state, batch, "vec_id", found)
        rest = batch.join(found.filter("cluster_id < 0").select("vec_id"), "vec_id")
        formed = form_clusters(rest.filter("vec is not null"), "vec_id", threshold)
        room = None if most is None else max(0, most - state.count())
        capped = formed.withColumn("over_cap", F.lit(False)) if room is None else cap_clusters(formed, "vec_id", room) if room else formed.withColumn("over_cap", F.lit(True))
        capped = cut(capped)
        new = rest.join(capped.filter("not over_cap").select("vec_id", "cluster_id"), "vec_id")
        name = F.col("vec_id").cast("string")
        first = new.select("cluster_id", name.alias("name"), F.row_number().over(Window.partitionBy("cluster_id").orderBy(name)).alias("r")).filter("r <= 10")
        ids = first.groupBy("cluster_id").agg(F.array_sort(F.collect_list("name")).alias("representatives"))
        made = centroids(new, "cluster_id").join(ids, "cluster_id").select("cluster_id", "centroid", "size", "representatives")
        out = cut(old.unionByName(made))
        extra = assign(rest.join(capped.filter("over_cap").select("vec_id"), "vec_id"), "vec_id", out, -1.0).filter("cluster_id >= 0").groupBy("cluster_id").agg(F.count("*").alias("more"))
        _versioned(state_path, batch_id, out.join(extra, "cluster_id", "left").withColumn("size", F.col("size") + F.coalesce("more", F.lit(0))).drop("more"))
        discard(batch, found, capped, out)

    return vectors.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


REGISTRY = "registry_id long, centroid array<double>, n_claims long, clusters array<long>"


def register_claims(claims: DataFrame, state_path: str, checkpoint: str, threshold: float):
    """A stateful claim registry as a sink: a claim near an entry's first claims joins it, others that are near each other make a new entry, named by the smallest claim id.

    An entry keeps the mean vector of the claims that made it, their number and the list of their clusters. ``claims`` is (claim_id, cluster_id, vec); versions as in ``cluster_batches``.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = cut(batch.select("claim_id", "cluster_id", "vec").repartition("claim_id"))  # a batch may be one file
        state = _version(batch.sparkSession, state_path, REGISTRY, batch_id - 1)
        known = state.select(F.col("registry_id").alias("cluster_id"), "centroid")
        found = cut(assign(batch, "claim_id", known, threshold).select("claim_id", F.col("cluster_id").alias("registry_id")))
        rest = batch.join(found.filter("registry_id < 0").select("claim_id"), "claim_id")
        made = rest.join(form_clusters(rest, "claim_id", threshold).withColumnRenamed("cluster_id", "registry_id"), "claim_id")
        vectors = centroids(made.select("registry_id", "vec"), "registry_id").select("registry_id", "centroid")
        told = batch.join(found.filter("registry_id >= 0"), "claim_id").select("registry_id", "cluster_id").unionByName(made.select("registry_id", "cluster_id"))
        told = told.groupBy("registry_id").agg(F.count("*").alias("n"), F.collect_set("cluster_id").alias("seen"))
        entries = state.select("registry_id", "centroid", "n_claims", "clusters").unionByName(vectors.select("registry_id", "centroid", F.lit(0).cast("long").alias("n_claims"), F.array().cast("array<long>").alias("clusters")))
        out = entries.join(told, "registry_id", "left")
        _versioned(state_path, batch_id, out.select("registry_id", "centroid", (F.col("n_claims") + F.coalesce("n", F.lit(0))).alias("n_claims"), F.array_sort(F.array_union("clusters", F.coalesce("seen", F.array().cast("array<long>")))).alias("clusters")))
        discard(batch, found)

    return claims.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_texts(posts: DataFrame, delay: str = "1 day") -> DataFrame:
    """Posts whose text has not been seen within the watermark: the response cache of a stream."""
    return posts.withColumn("text_hash", F.xxhash64("text")).withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["text_hash"])


class ResponseCache(StatefulProcessor):
    """Texts that have been answered, in one part of the cache, with the time until which each is held: a text not held is a miss and is held from then on, the rest are hits.

    Event-time timers on the hour remove what the watermark has passed; the size is kept beside the map, so no batch walks the cache.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "text_hash string", "until long")
        self.size = handle.getValueState("size", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        hits = misses = 0
        n, ends = self.size.get()[0] if self.size.exists() else 0, set()
        batch = pd.concat(list(rows)).sort_values(["at", "id"])
        for text, at in zip(batch["text_hash"], batch["at"].astype("int64"), strict=True):
            known = self.held.getValue((text,))[0] if self.held.containsKey((text,)) else None
            if known is not None and at < known:
                hits += 1
                continue
            misses, n = misses + 1, n + (known is None)
            until = int(at) + self.keep_ms
            self.held.updateValue((text,), (until,))
            ends.add((until // _HOUR + 1) * _HOUR)
        for t in ends:
            self.handle.registerTimer(t)
        self.size.update((n,))
        yield pd.DataFrame({"part": [key[0]], "hits": [hits], "misses": [misses], "size": [n]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        gone = [text for (text,), (until,) in self.held.iterator() if until <= now]
        for text in gone:
            self.held.removeKey((text,))
        n = (self.size.get()[0] if self.size.exists() else 0) - len(gone)
        self.size.update((n,))
        yield pd.DataFrame({"part": [key[0]], "hits": [0], "misses": [0], "size": [n]})

    def close(self) -> None:
        pass


CACHE = "part int, hits long, misses long, size long"


def cached(posts: DataFrame, parts: int = 64, keep_ms: int = 86_400_000, delay: str = "2 hours") -> DataFrame:
    """(part, hits, misses, size) of the response cache after each micro-batch: a row for each part of the cache that the batch touched, or that lost texts whose time was over.

    ``posts`` is (id, text, created_at); a text is answered once in ``keep_ms`` of event time. Null texts are not answered.
    """
    when = F.col("created_at").cast("timestamp")
    rows = posts.filter("text is not null").select(F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int").alias("part"), F.sha2("text", 256).alias("text_hash"), "id", when.alias("created_at"))
    rows = rows.withWatermark("created_at", delay).withColumn("at", F.unix_millis("created_at"))
    return rows.groupBy("part").transformWithStateInPandas(statefulProcessor=ResponseCache(keep_ms), outputStructType=CACHE, outputMode="Append", timeMode="EventTime")


def cache_misses(posts: DataFrame, cache: DataFrame) -> DataFrame:
    """Batch twin: posts whose text is not in the cache table, a text once."""
    h = F.sha2("text", 256)
    return posts.withColumn("text_hash", h).dropDuplicates(["text_hash"]).join(cache.select("text_hash"), "text_hash", "left_anti")


def counter_rows(query) -> list[tuple]:
    """(stage, batch_id, counter, value) of a query's progress so far: its observed metrics, a few a batch, to be appended to a metrics table."""
    return [(name, p.batchId, key, int(value)) for p in query.recentProgress for name, row in (p.observedMetrics or {}).items() for key, value in row.asDict().items() if value is not None]


COUNTERS = "stage string, batch_id long, counter string, value long"


def with_counters(posts: DataFrame, name: str, gate: str) -> DataFrame:
    """The stream with ``processed`` and ``passed`` observed; a query listener or ``lastProgress`` reads them."""
    return posts.observe(name, F.count(F.lit(1)).alias("processed"), F.sum(F.expr(gate).cast("int")).alias("passed"))


class CounterTable(StreamingQueryListener):
    """Appends the observed counters of every finished micro-batch to a table (stage, batch_id, counter, value)."""

    def __init__(self, path: str):
        self.path = path
        self.written: set[tuple] = set()

    def wait(self, query, seconds: float = 60) -> None:
        """Until the counters of an ended query's last batches are in the table: its events arrive after it ended."""
        expected = {(str(p.runId), p.batchId) for p in query.recentProgress if p.observedMetrics}
        until = time.monotonic() + seconds
        while not expected <= self.written:
            if time.monotonic() > until:
                raise TimeoutError(f"no progress events for {expected - self.written}")
            time.sleep(0.1)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        rows = [(name, progress.batchId, key, int(value)) for name, row in (progress.observedMetrics or {}).items() for key, value in row.asDict().items() if value is not None]
        if rows:
            SparkSession.active().createDataFrame(rows, COUNTERS).coalesce(1).write.mode("append").parquet(self.path)
        self.written.add((str(progress.runId), progress.batchId))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
