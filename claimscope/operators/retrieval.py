"""Lexical and hybrid retrieval, self-consistency, contrastive pools, the claim registry and pair scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from claimscope.functions.text import jaccard
from claimscope.functions.vectors import dot, normalize
from claimscope.operators import clustering, postings
from claimscope.operators.graph import connected_components
from claimscope.session import cut


def bm25(queries: DataFrame, corpus: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(q, id, score, norm): BM25 of corpus rows (id, words) for queries (q, words) that share a word.

    idf = ln(N - df + .5) - ln(df + .5); negative ones become epsilon times the mean idf. A word twice in the query counts twice.
    ``norm`` is the score over the query's largest, or over 1 if that is not positive. Terms are counted by row before the join.
    """
    tf = corpus.select("id", F.size("words").alias("len"), F.explode("words").alias("w")).groupBy("id", "len", "w").agg(F.count("*").alias("tf"))
    df = tf.groupBy("w").agg(F.count("*").alias("df"))
    size = corpus.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("avgdl"))  # one row
    idf = df.crossJoin(F.broadcast(size.select("n"))).select("w", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = idf.agg(F.avg("raw").alias("mean"))
    idf = idf.crossJoin(F.broadcast(mean)).select("w", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    qf = queries.select("q", F.explode("words").alias("w")).groupBy("q", "w").agg(F.count("*").alias("qf"))
    part = F.col("qf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    s = qf.join(idf, "w").join(tf, "w").crossJoin(F.broadcast(size.select("avgdl"))).groupBy("q", "id").agg(F.sum(part).alias("score"))
    top = s.groupBy("q").agg(F.max("score").alias("top"))
    return s.join(top, "q").select("q", "id", "score", (F.col("score") / F.when(F.col("top") > 0, F.col("top")).otherwise(1.0)).alias("norm"))


def bm25_top(queries: DataFrame, corpus: DataFrame | postings.Index, k: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(q, id, score, norm) of the ``k`` best rows of ``bm25`` for each query, ties to the smaller id, from an index of the corpus, which is built here unless given."""
    index = corpus if isinstance(corpus, postings.Index) else postings.build(corpus, k1, b)
    weights = postings.term_weights(index, queries, epsilon).select("q", "w", (F.col("qf") * F.col("idf")).alias("on_part"), F.lit(0.0).alias("on_share"))
    s = postings.search(index, weights, k)
    top = F.max("part").over(Window.partitionBy("q"))  # k rows a query
    return s.select("q", "id", F.col("part").alias("score"), (F.col("part") / F.when(top > 0, top).otherwise(1.0)).alias("norm"))


def hybrid_candidates(queries: DataFrame, corpus: DataFrame, first: int = 20, cos: float = 0.5, lexical: float = 0.3) -> DataFrame:
    """(q, id, cos, bm25): for each query the ``first`` rows by ``cos`` times the cosine of word counts plus ``lexical`` times BM25 over its best, from one index.

    Both are sums over common words, so one traversal finds the best of them together.
    """
    index = postings.build(corpus)
    terms = cut(postings.term_weights(index, queries))
    only = terms.select("q", "w", (F.col("qf") * F.col("idf")).alias("on_part"), F.lit(0.0).alias("on_share"))
    top = postings.search(index, only, 1).select("q", F.when(F.col("part") > 0, F.col("part")).otherwise(1.0).alias("top"))  # a row a query
    length = queries.select("q", F.explode("words").alias("w")).groupBy("q", "w").agg(F.count("*").alias("n")).groupBy("q").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("length"))
    mixed = cut(terms.join(top, "q").join(length, "q").select("q", "w", (F.col("qf") * F.col("idf") / F.col("top")).alias("on_part"), (F.col("qf") / F.col("length")).alias("on_share")))  # read several times, and the first search is behind it
    return postings.search(index, mixed, first, lexical, cos).select("q", "id", F.col("share").alias("cos"), F.col("part").alias("bm25"))


def topic_first(scored: DataFrame, k: int) -> DataFrame:
    """The k best of (q, id, post, same_topic, similarity): the query's topic first, then all; a post once."""
    once = Window.partitionBy("q", "post").orderBy(F.desc("same_topic"), F.desc("similarity"), "id")
    rank = Window.partitionBy("q").orderBy(F.desc("same_topic"), F.desc("similarity"), "id")
    return scored.withColumn("_o", F.row_number().over(once)).filter("_o = 1").drop("_o").withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)


def _best_posts(q: np.ndarray, c: np.ndarray, ids: np.ndarray, posts: np.ndarray, own: np.ndarray, k: int) -> list[list[tuple]]:
    """For each query the ``k`` best (id, post, similarity), a post once and not its own id, ties to the smaller id; ``ids`` ascend. The best rows are taken, more of them while they have too few posts."""
    out: list[list[tuple]] = [[] for _ in q]
    open_, depth = np.arange(len(q)), 2 * k
    while len(open_) and len(ids):
        i, j, s = clustering._best(q[open_], c, ids, own[open_], min(depth, len(ids)))
        edges, left = np.searchsorted(i, np.arange(len(open_) + 1)), []
        for row, at in enumerate(open_):
            best: dict = {}
            for x in range(edges[row], edges[row + 1]):
                best.setdefault(posts[j[x]], (ids[j[x]], posts[j[x]], s[x]))
                if len(best) == k:
                    break
            out[at] = list(best.values())
            if len(best) < k and depth < len(ids):
                left.append(at)
        open_, depth = np.array(left, dtype=np.int64), 8 * depth
    return out


def _topic_blocks(k: int):
    def run(key, queries: pa.Table, corpus: pa.Table) -> pa.Table:
        found = []
        if queries.num_rows and corpus.num_rows:
            corpus = corpus.sort_by("id")
            ids, topics, posts = (corpus.column(c).to_numpy() for c in ("id", "topic", "post"))
            qs, own = queries.column("q").to_numpy(), queries.column("topic").to_numpy()
            side = lambda t: t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            asks, c = side(queries), side(corpus)
            missing = pc.is_null(queries.column("topic"), nan_is_null=True).to_numpy()
            groups = [(t, np.flatnonzero(own == t)) for t in np.unique(own[~missing])] + [(None, np.flatnonzero(missing))]
            for topic, rows in groups:
                like = np.zeros(len(ids), dtype=bool) if topic is None else topics == topic
                taken: list[dict] = [{} for _ in rows]
                for same, at in ((1, np.flatnonzero(like)), (0, np.flatnonzero(~like))):  # the topic's rows, then the others where posts are wanting
                    short = np.array([n for n, posts_of in enumerate(taken) if len(posts_of) < k], dtype=np.int64)
                    for n, best in zip(short, _best_posts(asks[rows[short]], c[at], ids[at], posts[at], qs[rows[short]], k), strict=True):
                        for id_, post, s in best:
                            if len(taken[n]) < k:
                                taken[n].setdefault(post, (qs[rows[n]], id_, post, same, s))
                found += [x for posts_of in taken for x in posts_of.values()]
        cols = list(zip(*found, strict=True)) if found else [()] * 5
        kinds = [queries.schema.field("q").type, corpus.schema.field("id").type, corpus.schema.field("post").type, pa.int32(), pa.float64()]
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("q", "id", "post", "same_topic", "similarity"), cols, kinds, strict=True)})

    return run


def topic_search(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """``topic_first`` by cosine over all rows: (q, id, post, same_topic, similarity, rank); a row is not its own answer.

    ``queries`` is (q, v, topic), ``corpus`` (id, v, topic, post), keys are numbers and vectors of one length. Both are dealt into blocks; each pair of blocks
    gives at most ``k`` posts a query, which are merged. Rows without a vector take no part.
    """
    unit = lambda df, key: df.filter("v is not null").withColumn("v", normalize(F.col("v"))).select(*[F.col(c).alias(c) for c in (key, "v", "topic", *(["post"] if key == "id" else []))])
    asked, held = unit(queries, "q"), unit(corpus, "id")
    n_q, n_c = clustering.grid(asked.count(), held.count(), held.agg(F.max(F.size("v"))).first()[0] or 0)
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("p", F.pmod(F.xxhash64("q"), F.lit(n_q)).cast("int")).withColumn("r", number(n_c))
    right = held.withColumn("r", F.pmod(F.xxhash64("id"), F.lit(n_c)).cast("int")).withColumn("p", number(n_q))
    kind = {c: (queries if c == "q" else corpus).schema[c].dataType.simpleString() for c in ("q", "id", "post")}
    found = left.groupBy("p", "r").cogroup(right.groupBy("p", "r")).applyInArrow(_topic_blocks(k), f"q {kind['q']}, id {kind['id']}, post {kind['post']}, same_topic int, similarity double")
    return topic_first(found, k)


def two_stage(candidates: DataFrame, threshold: float, verify: float, k: int = 5) -> DataFrame:
    """First hit of each query among its ``k`` best by post similarity at or above ``threshold`` whose claim similarity reaches ``verify``; score = mean of both.

    ``candidates`` is (q, id, post_sim, claim_sim).
    """
    w = Window.partitionBy("q").orderBy(F.desc("post_sim"), "id")
    top = candidates.withColumn("rank", F.row_number().over(w)).filter((F.col("rank") <= k) & (F.col("post_sim") >= threshold) & (F.col("claim_sim") >= verify))
    first = top.withColumn("_hit", F.row_number().over(w)).filter("_hit = 1")
    return first.select("q", "id", ((F.col("post_sim") + F.col("claim_sim")) / 2).alias("score"))


def hybrid(candidates: DataFrame, verify: float, weights: tuple[float, float, float] = (0.5, 0.3, 0.2), first: int = 20, k: int = 5) -> DataFrame:
    """Match by cosine, BM25 and entity overlap: (q, id, cos, bm25, eq, ec, claim_sim) -> (q, id, score).

    Entities are compared only for the ``first`` rows by the other two signals; the best verified one of the top ``k`` wins.
    """
    wc, wb, we = weights
    pre = candidates.withColumn("pre", F.round(wc * F.col("cos") + wb * F.col("bm25"), 9))
    some = pre.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("pre"), "id"))).filter(F.col("_r") <= first)
    full = some.withColumn("combined", F.round(F.col("pre") + we * jaccard(F.col("eq"), F.col("ec")), 9))
    w = Window.partitionBy("q").orderBy(F.desc("combined"), "id")
    top = full.withColumn("rank", F.row_number().over(w)).filter((F.col("rank") <= k) & (F.col("claim_sim") >= verify))
    return top.withColumn("_hit", F.row_number().over(w)).filter("_hit = 1").select("q", "id", ((F.col("combined") + F.col("claim_sim")) / 2).alias("score"))


def self_consistency(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(grp, id, mean_sim): the member most similar on average to the others of its group, the first on ties; a single member wins with 1.

    ``pairs`` is (grp, a, b, similarity) in both directions, ``members`` (grp, id).
    """
    mean = pairs.groupBy("grp", F.col("a").alias("id")).agg(F.avg("similarity").alias("mean_sim"))
    m = members.join(mean, ["grp", "id"], "left").withColumn("mean_sim", F.round(F.coalesce("mean_sim", F.lit(1.0)), 9))
    return m.withColumn("_r", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("mean_sim"), "id"))).filter("_r = 1").drop("_r")


def consistent_vectors(rows: DataFrame, grp: str, key: str, vec: str = "vec") -> DataFrame:
    """``self_consistency`` by cosine of vectors: (grp, id, mean_sim). The mean of v's similarities to the others is (v . sum of all - v . v) / (n - 1), so
    no pairs are formed: a group costs one sum by dimension. Rows without a vector take no part."""
    unit = rows.filter(F.col(vec).isNotNull()).select(F.col(grp).alias("grp"), F.col(key).alias("id"), normalize(F.col(vec)).alias("v"))
    total = unit.select("grp", F.posexplode("v").alias("d", "x")).groupBy("grp", "d").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    total = total.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("total"), F.max("n").alias("n"))  # a row a dimension
    mean = F.when(F.col("n") > 1, (dot(F.col("v"), F.col("total")) - dot(F.col("v"), F.col("v"))) / (F.col("n") - 1)).otherwise(1.0)
    each = unit.join(total, "grp").select("grp", "id", F.round(mean, 9).alias("mean_sim"))
    return each.groupBy("grp").agg(F.max_by("id", F.struct("mean_sim", -F.col("id"))).alias("id"), F.max("mean_sim").alias("mean_sim"))


def contrastive_pools(log: DataFrame, good: float = 0.7, bad: float = 0.3, most_bad: int = 500) -> DataFrame:
    """(id, pool): scored rows as good or bad examples; failed rows are skipped, a missing score is bad, at most ``most_bad`` bad ones by hash."""
    rows = log.filter(~F.col("prediction").rlike("^(ERROR|TIMEOUT):")).withColumn("s", F.coalesce("score", F.lit(0.0)))
    up = rows.filter(F.col("s") >= good).select("id", F.lit("good").alias("pool"))
    down = rows.filter(F.col("s") <= bad).select("id").orderBy(F.md5(F.col("id").cast("string")), "id").limit(most_bad).select("id", F.lit("bad").alias("pool"))
    return up.union(down)


def bad_examples(queries: DataFrame, pool: DataFrame, similar: int = 3, random: int = 2) -> DataFrame:
    """(q, id, kind, rank): for each query (q, v) the ``similar`` most similar rows of the pool of bad examples (id, v), then ``random`` others, none twice and never the query's own id.

    Random ones follow each other, from a place that the query's hash gives, in the pool's order of hashes. The pool is that of ``contrastive_pools``, which
    bounds it, and is broadcast; queries are not shuffled for it. Keys are numbers.
    """
    near = clustering.nearest(queries.select("q", "v"), pool.select("id", "v"), similar).select("q", "id", "rank")
    order = Window.orderBy(F.md5(F.col("id").cast("string")), "id")  # over the pool's few hundred rows
    placed = cut(pool.filter("id is not null and v is not null").select("id", (F.row_number().over(order) - 1).alias("place")))
    size = placed.count()
    start = F.pmod(F.conv(F.substring(F.md5(F.col("q").cast("string")), 1, 8), 16, 10).cast("long"), F.lit(max(size, 1)))
    tries = min(size, similar + random + 1)  # the similar ones and the query itself may be among them
    asked = queries.filter("q is not null and v is not null").select("q", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda i: (start + i) % size)).alias("no", "place")) if tries else near.select("q", F.lit(0).alias("no"), F.lit(0).alias("place")).limit(0)
    drawn = asked.join(F.broadcast(placed), "place").filter("q <> id").join(near.select("q", "id"), ["q", "id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("no"))
    drawn = drawn.withColumn("rank", rank).filter(F.col("rank") <= random)
    return near.select("q", "id", F.lit("similar").alias("kind"), "rank").unionByName(drawn.select("q", "id", F.lit("random").alias("kind"), "rank"))


def claim_registry(claims: DataFrame, links: DataFrame) -> DataFrame:
    """(registry_id, n_claims, clusters): near-duplicate claims share an entry named by the smallest id, with their clusters.

    ``claims`` is (claim_id, cluster_id), ``links`` (a, b) pairs of similar claims.
    """
    c = connected_components(links, "a", "b")
    named = claims.join(c, F.col("claim_id") == F.col("node"), "left").select(F.coalesce("component", "claim_id").alias("registry_id"), "claim_id", "cluster_id")
    return named.groupBy("registry_id").agg(F.count_distinct("claim_id").alias("n_claims"), F.array_sort(F.collect_set("cluster_id")).alias("clusters"))


def registry_figures(registry: DataFrame) -> DataFrame:
    """Normalisations, entries, dedups, dedup rate and clusters per claim."""
    n, m = F.sum("n_claims"), F.count("*")
    return registry.agg(n.alias("normalizations"), m.alias("claims"), (n - m).alias("dedups"), ((n - m) / n).alias("dedup_rate"), F.avg(F.size("clusters")).alias("clusters_per_claim"))


@F.pandas_udf(LongType())
def count_chunks(a: pd.Series, b: pd.Series) -> pd.Series:
    """Runs of consecutive words of ``a`` aligned with consecutive words of ``b``; each word takes its first free place, after the last if it can."""

    def one(xs, ys) -> int:
        free: dict[str, list[int]] = {}
        for j, y in enumerate(ys):
            free.setdefault(y, []).append(j)
        chunks, last_i, last_j = 0, None, None
        for i, x in enumerate(xs):
            places = free.get(x)
            if not places:
                continue
            want = last_j + 1 if last_i == i - 1 and last_j is not None else None
            j = want if want in places else places[0]
            places.remove(j)
            if want is None or j != want:
                chunks += 1
            last_i, last_j = i, j
        return chunks

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")


def score_pairs(pairs: DataFrame, alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> DataFrame:
    """Adds matches, precision, recall, f_mean and ``score`` for word arrays ``hyp`` and ``ref``: unigram F with a fragmentation penalty (exact stage)."""
    count = lambda ws: F.map_from_entries(F.transform(F.array_distinct(ws), lambda w: F.struct(w, F.size(F.filter(ws, lambda x: x == w)))))
    p = pairs.withColumn("_h", count(F.col("hyp"))).withColumn("_r", count(F.col("ref")))
    p = p.withColumn("matches", F.aggregate(F.map_keys("_h"), F.lit(0), lambda s, w: s + F.least(F.element_at("_h", w), F.coalesce(F.try_element_at(F.col("_r"), w), F.lit(0)))))
    p = p.withColumn("precision", F.coalesce(F.try_divide("matches", F.size("hyp")), F.lit(0.0))).withColumn("recall", F.coalesce(F.try_divide("matches", F.size("ref")), F.lit(0.0)))
    f = F.coalesce(F.try_divide(F.col("precision") * F.col("recall"), alpha * F.col("precision") + (1 - alpha) * F.col("recall")), F.lit(0.0))
    p = p.withColumn("f_mean", f).withColumn("chunks", count_chunks("hyp", "ref"))
    penalty = F.coalesce(gamma * F.pow(F.try_divide(F.col("chunks"), F.col("matches")), F.lit(beta)), F.lit(0.0))
    return p.withColumn("score", F.col("f_mean") * (1 - penalty)).drop("_h", "_r")


def hashed_text_vectors(rows: DataFrame, features: int = 256) -> DataFrame:
    """Rows with ``vec``: hashed TF-IDF of ``words``, unit length, by MLlib; a stand-in for a sentence encoder."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    steps = [HashingTF(inputCol="words", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_unit")]
    return Pipeline(stages=steps).fit(rows).transform(rows).withColumn("vec", vector_to_array("_unit")).drop("_tf", "_idf", "_unit")
