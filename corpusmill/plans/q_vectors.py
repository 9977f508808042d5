"""Queries over vectors (embeddings table) and experiment histories
(events table)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import experiments as X
from corpusmill.operators import vectors as V
from corpusmill.plans import fixtures as fx
from corpusmill.plans.registry import query
from corpusmill.session import materialize
from corpusmill.sources.io import table

LINK_DISTANCE = 1.15   # single-link cut (vectors are unit length, typical distance 1.41)
MIN_COSINE = 0.3
NEIGHBOURS = 5
PATIENCE = 3

VEC_SQL = "vecs AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
PAIRS_SQL = f"""{VEC_SQL},
pairs AS (SELECT a.id AS a, b.id AS b,
                 sqrt(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))) AS dist
          FROM vecs a JOIN vecs b ON a.id < b.id),
edges AS (SELECT a, b, dist FROM pairs WHERE dist <= {LINK_DISTANCE})"""

PAIRS_SQL_CTE = f"WITH RECURSIVE {PAIRS_SQL}, ts AS (SELECT unnest([0.95, 1.05, {LINK_DISTANCE}]::DOUBLE[]) AS t),"

COMPONENTS_SQL = f"""{PAIRS_SQL},
und AS (SELECT a AS src, b AS dst FROM edges UNION ALL SELECT b, a FROM edges),
reach AS (SELECT * FROM (WITH RECURSIVE r(src, dst) AS (
            SELECT id, id FROM vecs
            UNION
            SELECT r.src, u.dst FROM r JOIN und u ON r.dst = u.src)
          SELECT * FROM r)),
comp AS (SELECT src AS id, min(dst) AS cluster FROM reach GROUP BY src)"""


def _edges(spark, sf_dir, keeper=None):
    # the components as they are stored: half the bytes to shuffle, if they are four-byte ones
    vecs = fx.vectors(spark, sf_dir)
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    if own.schema["v"].dataType.simpleString() != "array<float>":
        own = vecs.select("id", "v")
    return vecs, V.epsilon_pairs(own, LINK_DISTANCE, keeper=keeper)


def _forest_edges(spark, sf_dir):
    """The vectors and, of all pairs, enough to have the components at every distance."""
    return _edges(spark, sf_dir, V.forest_only)


@query("pair_distances", f"WITH {PAIRS_SQL} SELECT a, b, round(dist, 6) AS dist FROM edges")
def pair_distances(spark, sf_dir):
    """C4: all pairs within the link distance with their distance."""
    return _edges(spark, sf_dir)[1].withColumn("dist", F.round("dist", 6))


@query("single_link", f"WITH {COMPONENTS_SQL} SELECT id, cluster FROM comp")
def single_link(spark, sf_dir):
    """Single-link clusters cut at the link distance."""
    vecs, edges = _forest_edges(spark, sf_dir)
    return V.connected_components(vecs.select("id"), edges)


CUTS = [0.95, 1.05, LINK_DISTANCE]


@query("single_link_cuts", f"""{PAIRS_SQL_CTE}
und AS (SELECT t, a AS src, b AS dst FROM edges, ts WHERE dist <= t UNION ALL SELECT t, b, a FROM edges, ts WHERE dist <= t),
reach AS (SELECT t, id AS src, id AS dst FROM vecs, ts
          UNION SELECT reach.t, reach.src, u.dst FROM reach JOIN und u ON reach.t = u.t AND reach.dst = u.src)
SELECT t, src AS id, min(dst) AS cluster FROM reach GROUP BY t, src""")
def single_link_cuts(spark, sf_dir):
    """The dendrogram (spanning forest up to the link distance) cut at three distances."""
    vecs, edges = _forest_edges(spark, sf_dir)
    forest = materialize(V.spanning_forest(edges), "forest")
    return V.cuts(vecs.select("id"), forest, CUTS)


@query("cluster_profile", f"""WITH {COMPONENTS_SQL}
SELECT c.cluster, v.label, count(*) AS n FROM comp c JOIN vecs v USING (id)
WHERE c.cluster IN (SELECT cluster FROM comp GROUP BY cluster HAVING count(*) > 1)
GROUP BY c.cluster, v.label""")
def cluster_profile(spark, sf_dir):
    """Label counts of every non-singleton cluster."""
    vecs, edges = _forest_edges(spark, sf_dir)
    comp = V.connected_components(vecs.select("id"), edges)
    multi = comp.groupBy("cluster").count().filter(F.col("count") > 1).select("cluster")
    return (comp.join(multi, "cluster", "left_semi").join(vecs.select("id", "label"), "id")
            .groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n")))


@query("nearest_vectors", f"""WITH {VEC_SQL},
u AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM vecs),
c AS (SELECT a.id, b.id AS other,
             round(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])), 6) AS cos
      FROM u a JOIN u b ON a.id <> b.id),
k AS (SELECT id, other, cos, row_number() OVER (PARTITION BY id ORDER BY cos DESC, other) AS rank
      FROM c WHERE cos >= {MIN_COSINE})
SELECT id, other, cos, rank FROM k WHERE rank <= {NEIGHBOURS}""")
def nearest_vectors(spark, sf_dir):
    """Five most cosine-similar vectors (similarity >= 0.3)."""
    vecs = fx.vectors(spark, sf_dir)
    return V.cosine_neighbours(vecs.select("id", "v"), MIN_COSINE, NEIGHBOURS) \
        .select("id", "other", "cos", "rank")


# ---- experiment histories -------------------------------------------------

HIST_SQL = """hist AS (
  SELECT user_id AS run, event_type AS metric, day(ts) AS epoch,
         arg_max(value, (ts, event_id)) AS value
  FROM events GROUP BY user_id, event_type, day(ts))"""


def _history(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), F.col("event_type").alias("metric"),
        F.dayofmonth("ts").alias("epoch"), "ts", F.col("event_id").alias("seq"), "value")
    return X.last_per_epoch(ev)


@query("metrics_last", f"WITH {HIST_SQL} SELECT run, metric, epoch, value FROM hist")
def metrics_last(spark, sf_dir):
    """Last value per (run, metric, epoch)."""
    return _history(spark, sf_dir)


@query("best_epoch", f"""WITH {HIST_SQL},
a AS (SELECT run, metric, min(value) AS mn, max(value) AS mx,
             arg_min(epoch, (value, epoch)) AS e_low, arg_min(epoch, (-value, epoch)) AS e_high
      FROM hist GROUP BY run, metric)
SELECT run, metric,
       CASE WHEN metric LIKE '%error%' OR metric LIKE '%loss%' OR metric LIKE '%coverage%' THEN mn ELSE mx END AS best_value,
       CASE WHEN metric LIKE '%error%' OR metric LIKE '%loss%' OR metric LIKE '%coverage%' THEN e_low ELSE e_high END AS best_epoch,
       round(mx - mn, 6) AS value_range
FROM a""")
def best_epoch(spark, sf_dir):
    """Best value, best epoch and range per (run, metric)."""
    return X.summary(_history(spark, sf_dir)).withColumn("value_range", F.round("value_range", 6))


@query("early_stop", f"""WITH {HIST_SQL},
s AS (SELECT run, epoch, value, row_number() OVER (PARTITION BY run ORDER BY epoch) AS i,
             min(value) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_best
      FROM hist WHERE metric = 'error'),
s2 AS (SELECT *, max(CASE WHEN prev_best IS NULL OR value < prev_best THEN i END)
                   OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_imp
       FROM s)
SELECT run, arg_min(epoch, (value, epoch)) AS best_epoch, min(value) AS best_value,
       coalesce(min(CASE WHEN i - last_imp >= {PATIENCE} THEN epoch END), max(epoch)) AS stopped_epoch,
       count(*) AS n_epochs
FROM s2 GROUP BY run""")
def early_stop(spark, sf_dir):
    """Best epoch and Keras-style stopping epoch (patience 3) of the
    'error' series of every run."""
    h = _history(spark, sf_dir).filter(F.col("metric") == "error").select("run", "epoch", "value")
    return X.early_stopping(h, PATIENCE)


@query("experiment_pivot", """
SELECT event_type AS metric,
""" + ",\n".join(f"       round(avg(value) FILTER (WHERE dayofweek(ts) + 1 = {d}), 6) AS dow_{d}" for d in range(1, 8))
       + "\nFROM events GROUP BY event_type")
def experiment_pivot(spark, sf_dir):
    """One row per metric, one column per day of week (mean value)."""
    ev = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("metric"), F.dayofweek("ts").alias("dow"), "value")
    return X.pivot_table(ev, "metric", "dow", range(1, 8), "value", "dow_")
