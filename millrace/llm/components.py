"""Connected components of a link table, without collecting links anywhere.

Each partition folds its links into a spanning forest by union-find. A table
that fits one bounded task is done then; a larger one goes through rounds of
large-star and small-star contraction (Kiveris et al., 2014), staged to the
shared folder so that each round starts from files.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Staging

#: Links that one task may fold alone (some tens of MB in Python).
LOCAL_LINKS = 200_000


def _forest(batches):
    parent: dict = {}

    def find(x):
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    schema = None
    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if schema is not None:
        nodes = list(parent)
        for i in range(0, len(nodes), 50_000):
            part = nodes[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, schema.field(0).type), pa.array([find(x) for x in part], schema.field(1).type)], schema=schema)


def connected_components(links: DataFrame, staging: Staging, local_links: int = LOCAL_LINKS) -> DataFrame:
    """links(a, b) -> (node, root) for every node that has a link; root is the smallest node.

    Loops and repeated links are harmless; null ends are ignored; no links give no rows.
    """
    kind = links.schema["a"].dataType.simpleString()
    shape = f"node {kind}, root {kind}"
    clean = links.where("a is not null and b is not null and a <> b").select("a", "b")
    cur = staging.put(clean, "links")
    n = cur.count()
    if n <= local_links:
        out = staging.put(cur.coalesce(1).mapInArrow(_forest, shape), "components")
        staging.drop(cur)
        return out
    whole, cur = cur, staging.put(cur.mapInArrow(_forest, shape).where("node <> root"), "forest")
    staging.drop(whole)
    seen = None
    while True:
        both = cur.select(F.col("node").alias("u"), F.col("root").alias("v")).union(cur.select("root", "node"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staging.put(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct()
        nxt = staging.put(small.select(F.col("u").alias("node"), F.col("v").alias("root")), "small")
        staging.drop(cur, large)
        cur = nxt
        state = cur.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return cur.union(cur.select("root", "root").distinct())
