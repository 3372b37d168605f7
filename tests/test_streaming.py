"""Streams give what their batch twins give."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from claimscope.streaming import jobs

START = datetime(2024, 1, 1)
SCHEMA = "id long, user_id long, created_at timestamp, cluster_id long, like_count long, retweet_count long, text string"


@pytest.fixture
def posts(spark, tmp_path):
    rows = [(i, i % 5, START + timedelta(minutes=17 * i), i % 3, i % 7, 1, f"t{i % 40}") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.repartitionByRange(4, "created_at").write.parquet(f"{tmp_path}/posts")
    return df, f"{tmp_path}/posts"


def run(stream, tmp_path, name):
    q = stream.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/progress-{name}").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/{name}")
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{tmp_path}/{name}")


def test_closed_hours_equal_the_batch(spark, tmp_path, posts):
    df, path = posts
    got = {(r.cluster_id, r.timestamp): (r.tweet_count, r.engagement) for r in run(jobs.hourly(jobs.replay(spark, path, SCHEMA, 4)), tmp_path, "hourly").collect()}
    hour = F.date_trunc("hour", "created_at")
    want = {(r.cluster_id, r.h): (r.n, r.e) for r in df.groupBy("cluster_id", hour.alias("h")).agg(F.count("*").alias("n"), F.sum(F.col("like_count") + F.col("retweet_count")).alias("e")).collect()}
    assert got.items() <= want.items()
    last = max(t for _, t in want)
    assert set(want) - set(got) <= {k for k in want if k[1] >= last - timedelta(hours=3)}


def test_cache_passes_a_text_once(spark, tmp_path, posts):
    _, path = posts
    texts = [r.text for r in run(jobs.new_texts(jobs.replay(spark, path, SCHEMA, 4)), tmp_path, "texts").select("text").collect()]
    assert sorted(texts) == sorted({f"t{i}" for i in range(40)})


def test_detector_keeps_its_state_between_batches(spark, tmp_path):
    counts = [2, 3, 2, 3, 2, 3, 2, 30, 2]
    for k, part in enumerate((counts[:4], counts[4:])):
        rows = [(1, START + timedelta(hours=4 * k + i), x) for i, x in enumerate(part)]
        spark.createDataFrame(rows, "cluster_id long, timestamp timestamp, tweet_count long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/w")
    stream = jobs.detect(jobs.replay(spark, f"{tmp_path}/w", "cluster_id long, timestamp timestamp, tweet_count long", 1))
    got = [(r.n_prev, r.is_trigger) for r in run(stream, tmp_path, "d").orderBy("timestamp").collect()]
    assert got == [(i, i == 7) for i in range(9)]


def test_counters_are_observed(spark, tmp_path, posts):
    _, path = posts
    q = jobs.with_counters(jobs.replay(spark, path, SCHEMA, 10), "stages", "like_count >= 3").writeStream.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).format("noop").start()
    q.awaitTermination()
    seen = q.lastProgress["observedMetrics"]["stages"]
    assert seen["processed"] == 200 and seen["passed"] == sum(i % 7 >= 3 for i in range(200))


def plain_hours(posts: list[tuple], last: int, idle: int) -> list[tuple]:
    """(cluster, hour, n, engagement, n_prev) of the hours whose end is at or before ``last`` (hours from 0), by session."""
    out = []
    for c in {p[0] for p in posts}:
        counts: dict[int, list[int]] = {}
        for p in posts:
            if p[0] == c:
                counts.setdefault(p[1], []).append(p[2])
        hours, h, n, empty = sorted(counts), None, 0, 0
        while True:
            if h is None:
                if not hours:
                    break
                h, n, empty = hours[0], 0, 0
            if h + 1 > last:
                break
            if h in counts:
                hours.remove(h)
            out.append((c, h, len(counts.get(h, [])), sum(counts.get(h, [])), n))
            n, empty, h = n + 1, 0 if h in counts else empty + 1, h + 1
            if empty >= idle:
                h = None
    return sorted(out)


def test_timers_close_hours_with_gaps_and_late_rows(spark, tmp_path):
    """Hours 0 to 40 of two clusters with gaps in four files; a late row comes in the last but one, when its hour is closed."""
    posts = [(c, h, h % 5 + c) for c in (1, 2) for h in (0, 0, 1, 4, 5, 5, 5, 9, 20, 21, 34) if (c, h) != (2, 9)]
    files = [[p for p in posts if lo <= p[1] < hi] for lo, hi in ((0, 5), (5, 10), (10, 30), (30, 60))]
    files[2].append((1, 2, 100))
    rows = lambda part: [(i, 1, START + timedelta(hours=h, minutes=7), c, e, 0, "t") for i, (c, h, e) in enumerate(part)]
    for k, part in enumerate([*files, [(None, 60, 0)], [(None, 61, 0)]]):
        spark.createDataFrame(rows(part), SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/posts")
    out = run(jobs.detect_hours(jobs.replay(spark, f"{tmp_path}/posts", SCHEMA, 1), "1 hour", idle=6), tmp_path, "timers")
    first = int((START - datetime(1970, 1, 1)).total_seconds())
    got = sorted((r.cluster_id, (r.hour - first) // 3600, r.tweet_count, r.engagement, r.n_prev) for r in out.collect())
    assert got == plain_hours(posts, 60, 6)
    z = {(r.cluster_id, (r.hour - first) // 3600): r.z_score_count for r in out.collect()}
    history = [2, 1, 0, 0, 1]  # hours 0 to 4
    mean = sum(history) / 5
    assert z[1, 5] == pytest.approx((3 - mean) / (sum((x - mean) ** 2 for x in history) / 5) ** 0.5)


def test_cache_counts_over_three_batches(spark, tmp_path):
    """Texts are held for three hours of event time; the batches are an hour, an hour and ten hours apart."""
    parts = [(0, ["a", "b", "a", None]), (1, ["a", "c"]), (2, ["d", "c", "d", "b"]), (12, ["a", "d"]), (13, ["d"])]
    for k, (h, part) in enumerate(parts):
        rows = [(10 * k + i, t, START + timedelta(hours=h, minutes=i)) for i, t in enumerate(part)]
        spark.createDataFrame(rows, "id long, text string, created_at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen: dict = {}

    def keep(df, batch_id):
        seen[batch_id] = [(r.part, r.hits, r.misses, r["size"]) for r in df.collect()]

    stream = jobs.cached(jobs.replay(spark, f"{tmp_path}/in", "id long, text string, created_at timestamp", 1), parts=3, keep_ms=3 * 3_600_000, delay="1 hour")
    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start().awaitTermination()
    got = [(sum(r[1] for r in rows), sum(r[2] for r in rows)) for _, rows in sorted(seen.items()) if any(r[1] + r[2] for r in rows)]
    assert got == [(1, 2), (1, 1), (3, 1), (0, 2), (1, 0)]
    sizes: dict = {}
    for _, rows in sorted(seen.items()):
        sizes |= {r[0]: r[3] for r in rows}
    assert sum(sizes.values()) == 2  # only what came in the last hours is still held


def test_listener_appends_counters_to_a_table(spark, tmp_path, posts):
    _, path = posts
    listener = jobs.CounterTable(f"{tmp_path}/counters")
    spark.streams.addListener(listener)
    try:
        q = jobs.with_counters(jobs.replay(spark, path, SCHEMA, 1), "stages", "like_count >= 3").writeStream.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).format("noop").start()
        q.awaitTermination()
        listener.wait(q)
    finally:
        spark.streams.removeListener(listener)
    got = {(r.batch_id, r.counter): r.value for r in spark.read.schema(jobs.COUNTERS).parquet(f"{tmp_path}/counters").collect()}
    assert len({b for b, _ in got}) == 4 and sum(v for (_, c), v in got.items() if c == "processed") == 200
    assert sum(v for (_, c), v in got.items() if c == "passed") == sum(i % 7 >= 3 for i in range(200))
