"""Connected components of an edge table, distributed.

Each round does two things.  Hooking: a vertex, and the root it points to, take
the smallest label seen across the vertex's edges.  Jumping: a label is replaced
by its own label.  Labels only ever decrease inside a component, so the fixpoint
is the component's smallest vertex.  Hooking roots halves chains, so rounds grow
with the logarithm of the longest path.  Each round's labels are written to the
shared folder, and the only thing that reaches the driver is a count of changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, table


_ROWS_PER_FILE = 65_536


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b), in any order, repeats allowed -> (v, label), label = smallest v reachable.

    An empty table gives no rows; a self-loop makes its vertex a component.
    """
    spark = edges.sparkSession
    both, both_path = table(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    files = 1 + both.count() // _ROWS_PER_FILE  # small graphs make few files, large ones many
    labels, path = table(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label")).coalesce(files), "labels")
    while True:  # labels only fall, so the fixpoint comes
        seen = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("label").alias("low"))
        hooked = labels.join(seen, labels.v == seen.a).select("v", "label", F.least("label", "low").alias("new"))
        own = hooked.select("v", F.col("new").alias("cand"))
        roots = hooked.filter("new < label").groupBy(F.col("label").alias("v")).agg(F.min("new").alias("cand"))
        lower = own.union(roots).groupBy("v").agg(F.min("cand").alias("label"))
        up = lower.select(F.col("v").alias("u"), F.col("label").alias("up"))
        jumped = lower.join(up, lower.label == up.u, "left").select("v", F.least("label", F.coalesce("up", "label")).alias("label"))
        before, old = labels, path
        labels, path = table(jumped.coalesce(files), "labels")
        was = before.select("v", F.col("label").alias("was"))
        still = labels.join(was, "v").filter("label <> was").isEmpty()
        remove(spark, old)
        if still:
            remove(spark, both_path)
            return labels
