"""Connected components of a link table."""

import pyspark.sql.functions as F

from ..session import materialize


def components(links):
    """(node, root) for every node of the links (a, b); root is the least node of its component.

    Each round every node takes the least root among its own and its neighbours', then the
    root of that root, so the distance covered more than doubles; rounds go on until nothing
    changes. The table is stored after each round and never passes through the driver; a node
    with very many links only meets partial minima. A link of a node with itself gives a
    component of one.
    """
    both = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")))
    while True:
        near = (both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near")))
        nearer = roots.join(near, "node").select("node", F.col("root").alias("before"), F.least("root", "near").alias("root"))
        top = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
        roots = materialize(nearer.join(top, "root").select("node", F.least("root", "top").alias("root"), (F.least("root", "top") < F.col("before")).alias("moved")))
        if roots.filter("moved").limit(1).count() == 0:
            return roots.select("node", "root")
        roots = roots.select("node", "root")
