"""Labels, objects and hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import Later, query
from .views import assignments, surfels, table, tree

L = Later("operators.labels")
T = Later("operators.tree")

_CURRENT = "cur AS (SELECT object_id, label, confidence, originator FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY originator, confidence DESC, place) AS r FROM assignments WHERE originator <= 1) WHERE r = 1)"


@query("SELECT object_id, originator, label, confidence FROM (SELECT *, row_number() OVER (PARTITION BY object_id, originator ORDER BY confidence DESC, place) AS r FROM assignments) WHERE r = 1", "assignments")
def best_label(spark, sf):
    return L.best_label(assignments(spark, sf))


@query(f"WITH {_CURRENT} SELECT * FROM cur", "assignments")
def current_label(spark, sf):
    return L.current_label(assignments(spark, sf))


@query(f"WITH {_CURRENT} SELECT label, count(*) AS objects, round(avg(confidence), 4) AS confidence FROM cur GROUP BY 1", "assignments")
def label_counts(spark, sf):
    return L.label_counts(assignments(spark, sf)).withColumn("confidence", F.round("confidence", 4))


@query("""WITH h AS (SELECT object_id, label FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY confidence DESC, place) AS r FROM assignments WHERE originator = 0) WHERE r = 1),
          m AS (SELECT object_id, label FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY confidence DESC, place) AS r FROM assignments WHERE originator = 1) WHERE r = 1)
          SELECT m.label AS predicted, h.label AS truth, count(*) AS objects FROM h LEFT JOIN m USING (object_id) GROUP BY ALL""", "assignments")
def label_confusion(spark, sf):
    best = L.best_label(assignments(spark, sf))
    return L.confusion(best.where("originator = 1"), best.where("originator = 0"))


@query("""WITH o AS (SELECT object_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM (SELECT surfel_id % 100 AS object_id, x, y, z FROM surfels) GROUP BY 1),
          l AS (SELECT *, CASE WHEN object_id % 4 = 0 THEN 'a' WHEN object_id % 4 = 1 THEN 'b' END AS label FROM o),
          d AS (SELECT q.object_id, t.label, min((q.cx - t.cx) * (q.cx - t.cx) + (q.cy - t.cy) * (q.cy - t.cy) + (q.cz - t.cz) * (q.cz - t.cz)) AS d FROM l q JOIN l t ON q.label IS NULL AND t.label IS NOT NULL GROUP BY ALL)
          SELECT object_id, label, round(1 - 2 * d / (d + n), 6) AS confidence FROM (SELECT *, row_number() OVER w AS r, lead(d) OVER w AS n FROM d WINDOW w AS (PARTITION BY object_id ORDER BY d, label)) WHERE r = 1""", "surfels")
def classify_1nn(spark, sf):
    oid = (F.col("surfel_id") % 100).alias("object_id")
    objects = surfels(spark, sf).groupBy(oid).agg(*(F.avg(a).alias(f"c{a}") for a in "xyz"))
    kind = F.col("object_id") % 4
    objects = objects.withColumn("label", F.when(kind == 0, "a").when(kind == 1, "b"))
    return L.classify_nearest(objects, ("cx", "cy", "cz")).withColumn("confidence", F.round("confidence", 6))


@query("SELECT surfel_id, CASE WHEN surfel_id % 3 = 0 THEN surfel_id % 17 ELSE object_id END AS object_id FROM surfels", "surfels")
def instance_regroup(spark, sf):
    s = surfels(spark, sf)
    instances = s.where("surfel_id % 3 = 0").select("surfel_id", F.lit(1).alias("label_id"), (F.col("surfel_id") % 17).alias("instance_id"))
    return L.regroup(s, instances).select("surfel_id", "object_id")


@query("SELECT surfel_id, CASE WHEN object_id = 2 THEN 5 ELSE object_id END AS object_id FROM surfels", "surfels")
def merge_object(spark, sf):
    return L.merge_object(surfels(spark, sf), 2, 5).select("surfel_id", "object_id")


@query("SELECT surfel_id, CASE WHEN object_id = 4 THEN CASE WHEN x > 0 THEN 100 ELSE 101 END ELSE object_id END AS object_id FROM surfels", "surfels")
def split_object(spark, sf):
    return L.split_object(surfels(spark, sf), 4, F.col("x") > 0, 100, 101).select("surfel_id", F.col("object_id").cast("long").alias("object_id"))


@query("SELECT surfel_id, row_number() OVER (ORDER BY block_id, surfel_id) AS new_id FROM surfels", "surfels")
def order_identifiers(spark, sf):
    return L.order_identifiers(surfels(spark, sf)).select("surfel_id", "new_id")


_CLOSURE = """RECURSIVE c(ancestor, node_id, depth) AS (SELECT node_id, node_id, 0 FROM tree UNION ALL SELECT c.ancestor, t.node_id, c.depth + 1 FROM c JOIN tree t ON t.parent_id = c.node_id)"""


@query(f"WITH {_CLOSURE} SELECT c.ancestor AS node_id, count(*) AS nodes, round(sum(t.size), 2) AS size, max(depth) AS height FROM c JOIN tree t ON t.node_id = c.node_id GROUP BY 1", "tree")
def subtree_counts(spark, sf):
    own = {"nodes": F.lit(1).cast("long"), "size": F.col("size"), "height": F.lit(0)}
    out = T.roll_up(tree(spark, sf), own, {"nodes": F.sum, "size": F.sum, "height": F.max}, {"height": F.col("height") + 1})
    return out.withColumn("size", F.round("size", 2))


@query(f"WITH {_CLOSURE} SELECT c.ancestor AS node_id, min(t.size) AS low, max(t.size) AS high FROM c JOIN tree t ON t.node_id = c.node_id GROUP BY 1", "tree")
def subtree_bbox(spark, sf):
    return T.roll_up(tree(spark, sf), {"low": F.col("size"), "high": F.col("size")}, {"low": F.min, "high": F.max})


@query(f"WITH {_CLOSURE} SELECT node_id, parent_id FROM tree WHERE node_id NOT IN (SELECT node_id FROM c WHERE ancestor = 'n7')", "tree")
def remove_subtree(spark, sf):
    return T.remove_subtree(tree(spark, sf), "n7").select("node_id", "parent_id")


@query("SELECT node_id FROM tree WHERE node_id NOT IN (SELECT parent_id FROM tree WHERE parent_id IS NOT NULL)", "tree")
def remove_interior(spark, sf):
    return T.leaves(tree(spark, sf)).select("node_id")


@query(f"WITH {_CLOSURE} SELECT node_id FROM tree WHERE parent_id IS NULL OR node_id IN (SELECT c.ancestor FROM c JOIN lineitem l ON c.node_id = 'o' || l.l_orderkey WHERE l.l_quantity > 45)", "tree")
def remove_empty_objects(spark, sf):
    points = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("node_id"))
    return T.remove_empty(tree(spark, sf), points).select("node_id")


def _posed(spark, sf):
    """A chain of translations and scales down the hierarchy."""
    t = tree(spark, sf).where("node_id not like 'o%'")
    n = F.length("node_id").cast("double")
    one, zero = F.lit(1.0), F.lit(0.0)
    return t.withColumn("transform", F.array(one * 2, zero, zero, n, zero, one, zero, n * 2, zero, zero, one, zero, zero, zero, zero, one))


@query("""WITH RECURSIVE t AS (SELECT node_id, parent_id, length(node_id)::DOUBLE AS n FROM tree WHERE node_id NOT LIKE 'o%'),
          w(node_id, sx, tx, ty) AS (SELECT node_id, 2.0::DOUBLE, n, n * 2 FROM t WHERE parent_id IS NULL UNION ALL SELECT t.node_id, sx * 2, sx * n + tx, n * 2 + ty FROM w JOIN t ON t.parent_id = w.node_id)
          SELECT node_id, sx, tx, ty FROM w""", "tree")
def cumulative_transform(spark, sf):
    return T.cumulative_transforms(_posed(spark, sf)).select("node_id", F.col("world")[0].alias("sx"), F.col("world")[3].alias("tx"), F.col("world")[7].alias("ty"))
