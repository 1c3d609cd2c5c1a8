"""Connected components of an edge list, as DataFrame operations.

Alternates "large star" (each node links its larger neighbours to the smallest label around it) and "small star"
(it links its smaller neighbours and itself to that label), until each node points straight at the smallest node
of its component. The smallest label per node is a map-side combined aggregate, so a node with a third of all
edges gathers nothing in one task; the join back to its edges is one that Spark splits where a key is hot.
Each round is checkpointed; the number of rounds grows with the logarithm of a component's size. Edges are held in
partitions of PART_EDGES, so that a short list takes its rounds within one task and shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.exchange import checkpointed

#: Edges a task holds.
PART_EDGES = 400_000
#: Rounds after which something is wrong: 2**40 nodes in a path need fewer.
MOST_ROUNDS = 60


def _turned(edges: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """(u, v): for each row, these pairs of its columns."""
    pair = F.explode(F.array(*[F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in pairs])).alias("pair")
    return edges.select(pair).select("pair.u", "pair.v")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v), u linked with v, u > v. One star round's edges, again u > v and distinct."""
    both = _turned(edges, ("u", "v"), ("v", "u")) if large else edges.select("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else _turned(joined, ("v", "m"), ("u", "m"))
    return out.where(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: two columns of one orderable type, rows (a, b) link a with b; nulls, loops and repeats are allowed.

    Returns (node, component) for every node with an edge to another one; component is the smallest node reachable.
    An edge list without such edges gives no rows.
    """
    a, b = edges.columns
    clean = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    now, last = checkpointed(clean), None
    for _ in range(MOST_ROUNDS):
        # a node that has one smaller neighbour, which has none, is done; when all are, labels are final
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or state == last:
            break
        last = state
        now = now.coalesce(-(-state["n"] // PART_EDGES))
        now = checkpointed(_star(_star(now, large=True), large=False))
    else:
        raise RuntimeError("components did not settle")
    return _turned(now, ("u", "v"), ("v", "v")).distinct().toDF("node", "component")
