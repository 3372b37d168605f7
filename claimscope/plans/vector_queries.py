"""Queries over vectors and texts: clusters, nearest rows, lexical and hybrid retrieval, registry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimscope.functions.text import count_cosine, extract_entities
from claimscope.functions.vectors import cosine, dot, euclid, norm, normalize
from claimscope.operators import clustering, ingest, retrieval
from claimscope.plans.fixtures import table
from claimscope.plans.ingest_queries import _ENT
from claimscope.plans.registry import query, rounded

_UNIT = """u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS raw, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS nrm FROM embeddings),
n AS (SELECT vec_id, label, raw, nrm, list_transform(raw, lambda x: x / nrm) AS v FROM u)"""
_DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]))"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vec"))


@query(f"WITH {_UNIT} SELECT a.vec_id, round({_DOT.format(a='a.raw', b='b.raw')}, 6) AS dot, round({_DOT.format(a='a.v', b='b.v')}, 6) AS cosine, round(sqrt(list_sum(list_transform(range(1, len(a.raw) + 1), lambda i: power(a.raw[i] - b.raw[i], 2)))), 6) AS euclid, round(a.nrm, 6) AS norm FROM n a JOIN n b ON b.vec_id = a.vec_id + 1")
def v01_vector_functions(spark, sf_dir):
    a = _vectors(spark, sf_dir)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("w"))
    v, w = F.col("vec"), F.col("w")
    return rounded(a.join(b, "vec_id").select("vec_id", dot(v, w).alias("dot"), cosine(v, w).alias("cosine"), euclid(v, w).alias("euclid"), norm(v).alias("norm")))


_CENT = _UNIT + """, d AS (SELECT label, i, avg(v[i]) AS x, count(*) AS size FROM n, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i), c0 AS (SELECT label, list(x ORDER BY i) AS c, max(size) AS size FROM d GROUP BY label),
c AS (SELECT label, size, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) AS c FROM c0)"""


def _unit(spark, sf_dir):
    return _vectors(spark, sf_dir).withColumn("vec", normalize(F.col("vec")))


@query(f"WITH {_CENT} SELECT label, size, round(c[1], 6) AS first, round(c[64], 6) AS last FROM c")
def v01_centroids(spark, sf_dir):
    c = clustering.centroids(_unit(spark, sf_dir), "label")
    return rounded(c.select("label", "size", F.element_at("centroid", 1).alias("first"), F.element_at("centroid", 64).alias("last")))


@query(f"WITH {_CENT}, s AS (SELECT vec_id, c.label AS cl, round({_DOT.format(a='n.v', b='c.c')}, 9) AS s FROM n, c), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cl) AS r FROM s) SELECT vec_id, CASE WHEN s >= 0.3 THEN cl ELSE -1 END AS cluster_id, round(s, 6) AS similarity FROM b WHERE r = 1")
def v02_assign(spark, sf_dir):
    u = _unit(spark, sf_dir)
    c = clustering.centroids(u, "label").select(F.col("label").alias("cluster_id"), "centroid")
    return rounded(clustering.assign(u, "vec_id", c, 0.3).withColumn("cluster_id", F.col("cluster_id").cast("int")))


@query(f"""WITH {_CENT}, s AS (SELECT vec_id, c.label AS cl, round({_DOT.format(a='n.v', b='c.c')}, 9) AS s FROM n, c), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cl) AS r FROM s),
asg AS (SELECT vec_id, cl FROM b WHERE r = 1 AND s >= 0.3), m AS (SELECT cl, i, avg(v[i]) AS x, count(*) AS m FROM asg JOIN n USING (vec_id), (SELECT unnest(range(1, 65)) AS i) GROUP BY cl, i),
k AS (SELECT label, c.size + coalesce(m, 0) AS size, i, (c[i] * c.size + coalesce(x, 0) * coalesce(m, 0)) / (c.size + coalesce(m, 0)) AS x FROM (SELECT * FROM c, (SELECT unnest(range(1, 65)) AS i)) c LEFT JOIN m USING (i) WHERE m.cl = label),
z AS (SELECT label, max(size) AS size, sqrt(sum(x * x)) AS l, max(CASE WHEN i = 1 THEN x END) AS f FROM k GROUP BY label) SELECT label AS cluster_id, size, round(f / l, 6) AS first FROM z""")
def v02_update_state(spark, sf_dir):
    u = _unit(spark, sf_dir)
    state = clustering.centroids(u, "label").select(F.col("label").alias("cluster_id"), "centroid", "size", F.array().cast("array<string>").alias("representatives"))
    out = clustering.update_state(state, u, "vec_id", clustering.assign(u, "vec_id", state, 0.3))
    return rounded(out.select("cluster_id", "size", F.element_at("centroid", 1).alias("first")))


_PAIRS = _UNIT + f", p AS (SELECT a.vec_id AS a, b.vec_id AS b, {_DOT.format(a='a.v', b='b.v')} AS s FROM n a JOIN n b ON a.vec_id < b.vec_id), l AS (SELECT * FROM p WHERE round(s, 9) >= 0.5)"


@query(f"WITH {_PAIRS} SELECT a, b, round(s, 6) AS similarity FROM l")
def v06_similar_pairs(spark, sf_dir):
    return rounded(clustering.similar_pairs(_vectors(spark, sf_dir), "vec_id", 0.5))


_COMP = "WITH RECURSIVE " + _PAIRS + ", e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT vec_id AS x, vec_id AS y FROM n UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y), comp AS (SELECT x AS vec_id, min(y) AS cluster_id FROM r GROUP BY x)"


@query(_COMP + " SELECT vec_id, cluster_id FROM comp")
def v03_form_clusters(spark, sf_dir):
    return clustering.form_clusters(_vectors(spark, sf_dir), "vec_id", 0.5)


# The same at a threshold that links hundreds of rows of the smaller tables.
_LOOSE_PAIRS, _LOOSE = (x.replace("round(s, 9) >= 0.5", "round(s, 9) >= 0.3") for x in (_PAIRS, _COMP))


@query(f"WITH {_LOOSE_PAIRS} SELECT a, b, round(s, 6) AS similarity FROM l")
def v06_loose_pairs(spark, sf_dir):
    return rounded(clustering.similar_pairs(_vectors(spark, sf_dir), "vec_id", 0.3))


@query(_LOOSE + " SELECT vec_id, cluster_id FROM comp")
def v03_loose_clusters(spark, sf_dir):
    return clustering.form_clusters(_vectors(spark, sf_dir), "vec_id", 0.3)


@query(_LOOSE + """, z AS (SELECT cluster_id, row_number() OVER (ORDER BY count(*) DESC, cluster_id) AS r FROM comp GROUP BY cluster_id),
kd AS (SELECT vec_id, cluster_id, r > 20 AS over_cap, v FROM comp JOIN z USING (cluster_id) JOIN n USING (vec_id)), ce0 AS (SELECT cluster_id, i, avg(v[i]) AS x FROM kd, (SELECT unnest(range(1, 65)) AS i) WHERE NOT over_cap GROUP BY ALL),
ce1 AS (SELECT cluster_id, list(x ORDER BY i) AS c FROM ce0 GROUP BY cluster_id), ce AS (SELECT cluster_id, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) AS c FROM ce1),
sm AS (SELECT vec_id, kd.cluster_id AS own, over_cap, ce.cluster_id AS cl, round(""" + _DOT.format(a="kd.v", b="ce.c") + """, 9) AS s FROM kd, ce), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cl) AS r FROM sm WHERE over_cap OR own = cl)
SELECT vec_id, cl AS cluster_id, over_cap, round(s, 6) AS similarity FROM b WHERE r = 1""")
def v04_over_cap(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return rounded(clustering.assign_over_cap(clustering.cap_clusters(clustering.form_clusters(v, "vec_id", 0.3), "vec_id", 20), v, "vec_id"))


def _profile_sql(thresholds):
    parts = []
    for i, t in enumerate(thresholds):
        parts.append(f"l{i} AS (SELECT * FROM p WHERE round(s, 9) >= {t}), e{i} AS (SELECT a, b FROM l{i} UNION SELECT b, a FROM l{i}), r{i} AS (SELECT vec_id AS x, vec_id AS y FROM n UNION SELECT r{i}.x, e{i}.b FROM r{i} JOIN e{i} ON e{i}.a = r{i}.y), k{i} AS (SELECT x, min(y) AS c FROM r{i} GROUP BY x)")
    sizes = " UNION ALL ".join(f"SELECT CAST({t} AS DOUBLE) AS threshold, c, count(*) AS size FROM k{i} GROUP BY c" for i, t in enumerate(thresholds))
    n = lambda c, name: f"CAST(sum(CAST({c} AS INT)) AS BIGINT) AS {name}"
    bands = ", ".join(n(c, name) for c, name in (("size = 1", "size_1"), ("size BETWEEN 2 AND 5", "size_2_5"), ("size BETWEEN 6 AND 20", "size_6_20"), ("size BETWEEN 21 AND 100", "size_21_100"), ("size > 100", "size_over_100")))
    pairs = _PAIRS.split(", l AS (")[0]
    return f"WITH RECURSIVE {pairs}, {', '.join(parts)}, z AS ({sizes}), g AS (SELECT threshold, count(*) AS n_clusters, CAST(sum(size) AS BIGINT) AS total, {bands} FROM z GROUP BY threshold) SELECT *, round(100 * (total - size_1) / total, 6) AS yield_pct, round(100 * size_1 / n_clusters, 6) AS singleton_pct FROM g"


_THRESHOLDS = (0.25, 0.3, 0.35, 0.5)


@query(_profile_sql(_THRESHOLDS))
def a08_cluster_profile(spark, sf_dir):
    sizes = None
    for t, formed in zip(_THRESHOLDS, clustering.form_clusters_at(_vectors(spark, sf_dir), "vec_id", list(_THRESHOLDS)), strict=True):
        s = formed.groupBy("cluster_id").agg(F.count("*").alias("size")).withColumn("threshold", F.lit(t))
        sizes = s if sizes is None else sizes.unionByName(s)
    return rounded(clustering.threshold_profile(sizes, "threshold"))


@query(f"WITH {_CENT}, s AS (SELECT label, avg({_DOT.format(a='n.v', b='c.c')}) AS s FROM n JOIN c USING (label) WHERE size > 1 GROUP BY label ORDER BY label LIMIT 200) SELECT count(*) AS n, round(avg(s), 6) AS mean_similarity, round(stddev_pop(s), 6) AS std_similarity FROM s")
def a08_similarity_statistics(spark, sf_dir):
    return rounded(clustering.similarity_statistics(_unit(spark, sf_dir), "label"))


@query(_COMP + ", z AS (SELECT cluster_id, row_number() OVER (ORDER BY count(*) DESC, cluster_id) AS r FROM comp GROUP BY cluster_id) SELECT vec_id, cluster_id, r > 20 AS over_cap FROM comp JOIN z USING (cluster_id)")
def v04_cluster_cap(spark, sf_dir):
    return clustering.cap_clusters(clustering.form_clusters(_vectors(spark, sf_dir), "vec_id", 0.5), "vec_id", 20)


@query(_COMP + ", z AS (SELECT count(*) AS size FROM comp GROUP BY cluster_id) SELECT count(*) AS n_clusters, CAST(sum(size) AS BIGINT) AS total, round(avg(size), 6) AS mean_size, round(median(size), 6) AS median_size, max(size) AS max_size, min(size) AS min_size, CAST(sum(CAST(size = 1 AS INT)) AS BIGINT) AS n_singletons, CAST(sum(CAST(size >= 5 AS INT)) AS BIGINT) AS n_large FROM z")
def a07_cluster_sizes(spark, sf_dir):
    sizes = clustering.form_clusters(_vectors(spark, sf_dir), "vec_id", 0.5).groupBy("cluster_id").agg(F.count("*").alias("size"))
    return rounded(clustering.size_statistics(sizes))


@query("WITH z AS (SELECT CAST(floor(n_chars / k) AS BIGINT) AS c, k, count(*) AS size FROM documents, (SELECT unnest([10, 100, 1000]) AS k) GROUP BY ALL), g AS (SELECT k AS band, count(*) AS n_clusters, CAST(sum(size) AS BIGINT) AS total, CAST(sum(CAST(size = 1 AS INT)) AS BIGINT) AS size_1, CAST(sum(CAST(size BETWEEN 2 AND 5 AS INT)) AS BIGINT) AS size_2_5, CAST(sum(CAST(size BETWEEN 6 AND 20 AS INT)) AS BIGINT) AS size_6_20, CAST(sum(CAST(size BETWEEN 21 AND 100 AS INT)) AS BIGINT) AS size_21_100, CAST(sum(CAST(size > 100 AS INT)) AS BIGINT) AS size_over_100 FROM z GROUP BY k) SELECT *, round(100 * (total - size_1) / total, 6) AS yield_pct, round(100 * size_1 / n_clusters, 6) AS singleton_pct FROM g")
def a08_threshold_profile(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("n_chars", F.explode(F.array(F.lit(10), F.lit(100), F.lit(1000))).alias("band"))
    sizes = d.groupBy("band", F.floor(F.col("n_chars") / F.col("band")).alias("c")).agg(F.count("*").alias("size"))
    return rounded(clustering.threshold_profile(sizes, "band"))


@query(f"WITH {_CENT} SELECT label, round(avg({_DOT.format(a='n.v', b='c.c')}), 6) AS similarity FROM n JOIN c USING (label) WHERE size > 1 GROUP BY label")
def a08_intra_similarity(spark, sf_dir):
    return rounded(clustering.intra_similarity(_unit(spark, sf_dir), "label"))


@query(f"WITH {_UNIT} SELECT count(*) AS n, CAST(max(len(raw)) AS INTEGER) AS dim, round(avg(nrm), 6) AS mean_norm, round(stddev_pop(nrm), 6) AS std_norm, round(min(nrm), 6) AS min_norm, round(max(nrm), 6) AS max_norm FROM u")
def a22_embedding_statistics(spark, sf_dir):
    return rounded(clustering.embedding_statistics(_vectors(spark, sf_dir)))


@query(f"WITH {_CENT} SELECT label AS cluster_id, size, round(sqrt(list_sum(list_transform(c, lambda x: x * x))), 6) AS norm FROM c WHERE label = 3")
def a25_cluster_lookup(spark, sf_dir):
    c = clustering.centroids(_unit(spark, sf_dir), "label").filter("label = 3")
    return rounded(c.select(F.col("label").alias("cluster_id"), "size", norm(F.col("centroid")).alias("norm")))


@query(f"WITH {_UNIT}, s AS (SELECT a.vec_id AS q, b.vec_id AS id, round({_DOT.format(a='a.v', b='b.v')}, 9) AS s FROM n a JOIN n b ON a.vec_id <> b.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, id) AS rank FROM s) SELECT q, id, round(s, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5")
def v07_top_k(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    q = v.select(F.col("vec_id").alias("q"), F.col("vec").alias("v"))
    return rounded(clustering.nearest(q, v.select(F.col("vec_id").alias("id"), F.col("vec").alias("v")), 5).select("q", "id", "similarity", "rank"))


@query(f"WITH {_CENT}, s AS (SELECT vec_id, c.label AS topic, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: power(n.v[i] - c.c[i], 2)))), 9) AS d FROM n, c), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, topic) AS r FROM s) SELECT vec_id, topic FROM b WHERE r = 1")
def v08_assign_topics(spark, sf_dir):
    u = _unit(spark, sf_dir)
    return clustering.assign_topics(u, "vec_id", clustering.centroids(u, "label").select(F.col("label").alias("topic"), F.col("centroid").alias("c")))


@query()
def v08_topic_model(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    c = clustering.topic_model(v, 10)
    held = clustering.assign_topics(v, "vec_id", c).join(v, "vec_id").join(F.broadcast(c), "topic")
    return rounded(held.groupBy("topic").agg(F.count("*").alias("n"), F.avg(euclid(F.col("vec"), F.col("c"))).alias("mean_distance")))


@query(f"WITH {_UNIT}, s AS (SELECT a.vec_id AS q, b.vec_id AS id, b.vec_id % 200 AS post, CAST(a.label = b.label AS INT) AS same, round({_DOT.format(a='a.v', b='b.v')}, 9) AS s FROM n a JOIN n b ON a.vec_id <> b.vec_id), o AS (SELECT *, row_number() OVER (PARTITION BY q, post ORDER BY same DESC, s DESC, id) AS r FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY same DESC, s DESC, id) AS rank FROM o WHERE r = 1) SELECT q, id, same AS same_topic, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 8")
def v09_topic_first(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    rows = v.select(F.col("vec_id").alias("id"), F.col("vec").alias("v"), F.col("label").alias("topic"), (F.col("vec_id") % 200).alias("post"))
    return retrieval.topic_search(rows.withColumnRenamed("id", "q"), rows, 8).select("q", "id", "same_topic", "rank")


_BM = r"""doc AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '\p{L}+') AS ws FROM documents WHERE text IS NOT NULL), tf AS (SELECT id, len(ws) AS len, w, count(*) AS tf FROM (SELECT id, ws, unnest(ws) AS w FROM doc) GROUP BY ALL),
sz AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM doc), df AS (SELECT w, count(*) AS df FROM tf GROUP BY w), i0 AS (SELECT w, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, sz), idf AS (SELECT w, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM i0) ELSE raw END AS idf FROM i0),
qf AS (SELECT item_id AS q, w, count(*) AS qf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS w FROM benchmark) GROUP BY ALL),
sc AS (SELECT q, id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))) AS score FROM qf JOIN idf USING (w) JOIN tf USING (w), sz GROUP BY q, id)"""


def _bm25_sides(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), ingest.words(F.col("text")).alias("words"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), ingest.words(F.col("text")).alias("words"))
    return q, docs


@query(f"WITH {_BM}, r AS (SELECT *, score / CASE WHEN max(score) OVER (PARTITION BY q) > 0 THEN max(score) OVER (PARTITION BY q) ELSE 1 END AS norm, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, id) AS rank FROM sc) SELECT q, id, round(score, 6) AS score, round(norm, 6) AS norm FROM r WHERE rank <= 10")
def v10_bm25(spark, sf_dir):
    return rounded(retrieval.bm25_top(*_bm25_sides(spark, sf_dir), 10))


_CAND = _UNIT + f", cd AS (SELECT a.vec_id AS q, b.vec_id AS id, round({_DOT.format(a='a.v', b='b.v')}, 9) AS post_sim, round({_DOT.format(a='a.v', b='list_reverse(b.v)')}, 9) AS claim_sim FROM n a JOIN n b ON a.vec_id <> b.vec_id)"


@query(f"WITH {_CAND}, k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY post_sim DESC, id) AS r FROM cd), h AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY post_sim DESC, id) AS h FROM k WHERE r <= 5 AND post_sim >= 0.2 AND claim_sim >= 0.0) SELECT q, id, round((post_sim + claim_sim) / 2, 6) AS score FROM h WHERE h = 1")
def v12_two_stage(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    unit = v.select(F.col("vec_id").alias("id"), normalize(F.col("vec")).alias("v"))
    first = clustering.nearest(unit.withColumnRenamed("id", "q"), unit, 5)  # only the five best by post can match
    cand = first.join(unit.select(F.col("id").alias("q"), F.col("v").alias("qv")), "q").join(unit, "id").select("q", "id", F.col("similarity").alias("post_sim"), F.round(dot(F.col("qv"), F.reverse("v")), 9).alias("claim_sim"))
    return rounded(retrieval.two_stage(cand, 0.2, 0.0))


_CLAIM = r"regexp_extract_all(lower(substr({0}, 1, 200)), '\p{{L}}+')"
_COUNTS = "list_sum(list_transform(list_distinct({0}), lambda w: len(list_filter({0}, lambda x: x = w)) * len(list_filter({1}, lambda x: x = w))))"
_CLAIM_COS = f"coalesce({_COUNTS.format('cq', 'cd')} / nullif(sqrt({_COUNTS.format('cq', 'cq')}) * sqrt({_COUNTS.format('cd', 'cd')}), 0), 0)"


@query(f"""WITH {_BM}, qn AS (SELECT q, sqrt(sum(qf * qf)) AS qn FROM qf GROUP BY q), dn AS (SELECT id, sqrt(sum(tf * tf)) AS dn FROM tf GROUP BY id), dt AS (SELECT q, id, sum(qf * tf) AS d FROM qf JOIN tf USING (w) GROUP BY q, id),
pre AS (SELECT q, id, round(0.5 * d / (qn * dn) + 0.3 * score / CASE WHEN max(score) OVER (PARTITION BY q) > 0 THEN max(score) OVER (PARTITION BY q) ELSE 1 END, 9) AS pre FROM sc JOIN dt USING (q, id) JOIN qn USING (q) JOIN dn USING (id)),
f AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY pre DESC, id) AS r FROM pre), be AS (SELECT item_id AS q, {_ENT} AS eq, {_CLAIM.format('text')} AS cq FROM benchmark), de AS (SELECT doc_id AS id, {_ENT} AS ec, {_CLAIM.format('text')} AS cd FROM documents WHERE text IS NOT NULL),
fu AS (SELECT q, id, round({_CLAIM_COS}, 9) AS claim_sim, round(pre + 0.2 * CASE WHEN len(eq) = 0 AND len(ec) = 0 THEN 0.5 WHEN len(eq) = 0 OR len(ec) = 0 THEN 0 ELSE len(list_intersect(eq, ec)) / len(list_distinct(list_concat(eq, ec))) END, 9) AS combined FROM f JOIN be USING (q) JOIN de USING (id) WHERE r <= 20),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY combined DESC, id) AS rank FROM fu), h AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY combined DESC, id) AS h FROM k WHERE rank <= 5 AND claim_sim >= 0.2) SELECT q, id, round((combined + claim_sim) / 2, 6) AS score FROM h WHERE h = 1""")
def v13_hybrid(spark, sf_dir):
    found = retrieval.hybrid_candidates(*_bm25_sides(spark, sf_dir))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), F.col("text").alias("asked"))
    held = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), "text")
    claim = lambda c: ingest.words(F.substring(c, 1, 200))
    signals = extract_entities(F.col("asked")).alias("eq"), extract_entities(F.col("text")).alias("ec"), F.round(count_cosine(claim("asked"), claim("text")), 9).alias("claim_sim")
    return rounded(retrieval.hybrid(found.join(asked, "q").join(held, "id").select("q", "id", "cos", "bm25", *signals), 0.2))


@query(f"WITH {_UNIT}, p AS (SELECT a.label AS grp, a.vec_id AS id, {_DOT.format(a='a.v', b='b.v')} AS s FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id), m AS (SELECT grp, id, round(avg(s), 9) AS mean_sim FROM p GROUP BY grp, id), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY mean_sim DESC, id) AS r FROM m) SELECT grp, id, round(mean_sim, 6) AS mean_sim FROM r WHERE r = 1")
def v14_self_consistency(spark, sf_dir):
    return rounded(retrieval.consistent_vectors(_vectors(spark, sf_dir), "label", "vec_id"))


_LOG = _CENT + f""", l AS (SELECT n.vec_id AS id, n.v, round({_DOT.format(a="n.v", b="c.c")}, 9) AS score FROM n JOIN c USING (label) WHERE n.vec_id % 17 <> 0),
pool AS (SELECT id, v, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR)), id) - 1 AS place FROM l WHERE score <= 0.05 QUALIFY place < 500)"""


def _pools(spark, sf_dir):
    """Rows scored by the cosine to their label's centroid; every seventeenth failed."""
    v = _vectors(spark, sf_dir)
    cents = clustering.centroids(v.select("label", normalize(F.col("vec")).alias("vec")), "label")
    failed = F.when(F.col("vec_id") % 17 == 0, "TIMEOUT: 60 s").otherwise("ok")
    log = v.join(cents, "label").select(F.col("vec_id").alias("id"), failed.alias("prediction"), F.round(cosine(F.col("vec"), F.col("centroid")), 9).alias("score"))
    return v, retrieval.contrastive_pools(log, 0.2, 0.05)


@query(f"WITH {_LOG} SELECT id, 'good' AS pool FROM l WHERE score >= 0.2 UNION ALL SELECT id, 'bad' FROM pool")
def v15_contrastive_pools(spark, sf_dir):
    return _pools(spark, sf_dir)[1]


@query(f"""WITH {_LOG}, sz AS (SELECT count(*) AS size FROM pool), s AS (SELECT q.vec_id AS q, p.id, round({_DOT.format(a="q.v", b="p.v")}, 9) AS s FROM n q JOIN pool p ON q.vec_id <> p.id),
near AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY s DESC, id) AS rank FROM s QUALIFY rank <= 3),
dr AS (SELECT q, no, (CAST('0x' || substr(md5(CAST(q AS VARCHAR)), 1, 8) AS BIGINT) + no) % size AS place FROM (SELECT vec_id AS q, unnest(range(6)) AS no FROM n), sz WHERE no < size),
r AS (SELECT dr.q, pool.id, row_number() OVER (PARTITION BY dr.q ORDER BY no) AS rk FROM dr JOIN pool USING (place) LEFT JOIN near ON near.q = dr.q AND near.id = pool.id WHERE dr.q <> pool.id AND near.id IS NULL QUALIFY rk <= 2)
SELECT q, id, 'similar' AS kind, CAST(rank AS INTEGER) AS rank FROM near UNION ALL SELECT q, id, 'random', CAST(rk AS INTEGER) FROM r""")
def v15_bad_examples(spark, sf_dir):
    v, pools = _pools(spark, sf_dir)
    rows = v.select(F.col("vec_id").alias("id"), F.col("vec").alias("v"))
    return retrieval.bad_examples(rows.withColumnRenamed("id", "q"), rows.join(pools.filter("pool = 'bad'"), "id").select("id", "v"))


_REG = _COMP + ", rg AS (SELECT cluster_id AS registry_id, count(*) AS n_claims, list_sort(list(DISTINCT label)) AS clusters FROM comp JOIN embeddings USING (vec_id) GROUP BY cluster_id)"


def _registry(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return retrieval.claim_registry(v.select(F.col("vec_id").alias("claim_id"), F.col("label").alias("cluster_id")), clustering.joining_links(v, "vec_id", [0.5]))


@query(_REG + " SELECT registry_id, n_claims, array_to_string(clusters, ',') AS clusters FROM rg")
def v16_claim_registry(spark, sf_dir):
    return _registry(spark, sf_dir).withColumn("clusters", F.array_join(F.transform("clusters", lambda c: c.cast("string")), ","))


@query(_REG + " SELECT CAST(sum(n_claims) AS BIGINT) AS normalizations, count(*) AS claims, CAST(sum(n_claims) - count(*) AS BIGINT) AS dedups, round((sum(n_claims) - count(*)) / sum(n_claims), 6) AS dedup_rate, round(avg(len(clusters)), 6) AS clusters_per_claim FROM rg")
def a24_registry_figures(spark, sf_dir):
    return rounded(retrieval.registry_figures(_registry(spark, sf_dir)))


@query(r"WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '\p{L}+') AS w FROM benchmark), p AS (SELECT a.item_id, a.w AS h, b.w AS r FROM b a JOIN b ON b.item_id = a.item_id + 1), m AS (SELECT item_id, len(h) AS lh, len(r) AS lr, list_sum(list_transform(list_distinct(h), lambda x: least(len(list_filter(h, lambda y: y = x)), len(list_filter(r, lambda y: y = x))))) AS m FROM p) SELECT item_id, CAST(m AS INTEGER) AS matches, round(m / lh, 6) AS precision, round(m / lr, 6) AS recall, round(CASE WHEN m > 0 THEN (m / lh) * (m / lr) / (0.9 * m / lh + 0.1 * m / lr) ELSE 0 END, 6) AS f_mean FROM m")
def v17_score_pairs(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", ingest.words(F.col("text")).alias("hyp"))
    r = b.select((F.col("item_id") - 1).alias("item_id"), F.col("hyp").alias("ref"))
    return rounded(retrieval.score_pairs(b.join(r, "item_id")).select("item_id", "matches", "precision", "recall", "f_mean"))


@query()
def v17_full_scores(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", ingest.words(F.col("text")).alias("hyp"))
    r = b.select((F.col("item_id") - 1).alias("item_id"), F.col("hyp").alias("ref"))
    return rounded(retrieval.score_pairs(b.join(r, "item_id")).select("item_id", "chunks", "score"))


@query()
def v18_text_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", ingest.words(F.col("text")).alias("words"))
    v = retrieval.hashed_text_vectors(rows)
    near = clustering.nearest(v.select(F.col("item_id").alias("q"), F.col("vec").alias("v")), v.select(F.col("item_id").alias("id"), F.col("vec").alias("v")), 1)
    return rounded(v.join(near, F.col("q") == F.col("item_id"), "left").select("item_id", norm(F.col("vec")).alias("norm"), F.col("id").alias("nearest"), "similarity"))


@query(f"WITH {_UNIT}, s AS (SELECT a.vec_id AS q, b.label AS bl, a.label AS al, round({_DOT.format(a='a.v', b='b.v')}, 9) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_DOT.format(a='a.v', b='b.v')}, 9) DESC, b.vec_id) AS rank FROM n a JOIN n b ON a.vec_id <> b.vec_id), c AS (SELECT CAST(t AS DOUBLE) AS threshold, k FROM (SELECT unnest([0.2, 0.4]) AS t), (SELECT unnest([1, 5]) AS k)), g AS (SELECT threshold, k, count(DISTINCT CASE WHEN s >= threshold AND rank <= k THEN q END) AS n_answered, avg(CASE WHEN s >= threshold AND rank <= k THEN CAST(al = bl AS INT) END) AS accuracy FROM s, c GROUP BY threshold, k) SELECT threshold, k, n_answered, round(coalesce(accuracy, 0), 6) AS accuracy, row_number() OVER (ORDER BY round(coalesce(accuracy, 0), 6) DESC, n_answered DESC, threshold, k) AS place FROM g")
def m10_retrieval_tuning(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    q = v.select(F.col("vec_id").alias("q"), F.col("vec").alias("v"))
    found = clustering.nearest(q, v.select(F.col("vec_id").alias("id"), F.col("vec").alias("v")), 5)
    labels = v.select(F.col("vec_id").alias("id"), F.col("label").alias("bl"))
    rows = found.join(labels, "id").join(labels.select(F.col("id").alias("q"), F.col("bl").alias("al")), "q")
    grid = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(k).alias("k")) for t in (0.2, 0.4) for k in (1, 5)])).alias("c")
    hit = (F.col("similarity") >= F.col("c.threshold")) & (F.col("rank") <= F.col("c.k"))
    g = rows.select("*", grid).groupBy("c.threshold", "c.k").agg(F.count_distinct(F.when(hit, F.col("q"))).alias("n_answered"), F.avg(F.when(hit, (F.col("al") == F.col("bl")).cast("int"))).alias("accuracy"))
    g = g.withColumn("accuracy", F.round(F.coalesce("accuracy", F.lit(0.0)), 6))
    place = F.row_number().over(Window.orderBy(F.desc("accuracy"), F.desc("n_answered"), "threshold", "k")).cast("long")  # over a row a setting
    return g.withColumn("place", place)
