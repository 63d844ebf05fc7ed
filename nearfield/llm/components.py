"""Connected components of a table of links, by hooking and pointer jumping on distributed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import Scratch


def components(links: DataFrame, store: Scratch) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node that links reach."""
    links = links.where("a <> b")
    edges = store.step(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = store.step(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "roots")
    while True:
        # Tables are written before the joins that may meet a hub, so that Spark can split its rows.
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("m"))
        new = store.step(labels.join(near, labels["node"] == near["a"], "left").select("node", "root", F.least("root", F.coalesce("m", "root")).alias("low")), "lower")
        hooks = store.step(new.groupBy(F.col("root").alias("of")).agg(F.min("low").alias("hook")), "hooks")
        hooked = store.step(new.join(hooks, F.col("root") == F.col("of")).select("node", "root", F.least("low", "hook").alias("low")), "hooked")
        over = hooked.select(F.col("node").alias("at"), F.col("low").alias("jump"))
        after = store.step(hooked.join(over, F.col("low") == F.col("at")).select("node", F.col("root").alias("was"), F.col("jump").alias("root")), "roots")
        store.drop(labels, new, hooks, hooked)
        labels = after
        if after.where("root <> was").isEmpty():
            return labels.select("node", "root")
