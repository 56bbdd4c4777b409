"""Connected components of pairwise matches on a two-dimensional grid.

Vertices are hashed into blocks; an edge (u, v) belongs to the cell (block u,
block v), so the edges of a hub spread over a row and a column of cells. Each cell
runs union-find on its own edges and tells every vertex its smallest local
companion. A vertex collects at most one representative per cell of its row and
column; the smallest becomes its parent and the others are linked to it for the
next round. Rounds go on until no links are left, which is when parents are stable;
labels are then resolved from the last round back to the first.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.session import materialize, release, settled

#: Edges a cell should hold; a cell's union-find needs about 200 bytes an edge.
CELL_EDGES = 400_000


def local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the edges and the smallest vertex each is connected to."""
    names, codes = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = list(range(len(names)))
    half = len(u)
    for a, b in zip(codes[:half].tolist(), codes[half:].tolist()):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    for i in range(len(parent)):  # parents are smaller, so one pass in order is enough
        parent[i] = parent[parent[i]]
    return names, names[np.asarray(parent, dtype=np.int64)] if len(names) else names


def _cell_union(cell: pd.DataFrame) -> pd.DataFrame:
    names, roots = local_roots(cell["u"].to_numpy(), cell["v"].to_numpy())
    return pd.DataFrame({"v": names, "root": roots})


@settled
def connected_components(edges: DataFrame, a: str, b: str, *, cell_edges: int = CELL_EDGES, max_rounds: int = 40) -> DataFrame:
    """(vertex, component) for every vertex with a partner; component is the
    smallest vertex of the group in the order of the column's type.

    Nulls and pairs of a vertex with itself link nothing; repeated pairs, both
    orders and further columns change nothing; no edges give an empty table. Raises
    if the groups aren't stable after ``max_rounds``.
    """
    kind = edges.schema[a].dataType.simpleString()
    todo = (
        edges.select(F.col(a).alias("u"), F.col(b).cast(kind).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct()
    )
    todo = materialize(todo)
    rounds: list[DataFrame] = []
    count = todo.count()
    while count and len(rounds) < max_rounds:
        side = max(1, math.ceil(math.sqrt(count / cell_edges)))
        salt = F.lit(len(rounds))
        block = lambda c: F.pmod(F.xxhash64(F.col(c), salt), F.lit(side)).cast("int")
        # one group a cell: a task never holds more than one cell in memory
        cells = todo.withColumn("cell", block("u").cast("long") * side + block("v")).groupBy("cell")
        stars = cells.applyInPandas(_cell_union, f"v {kind}, root {kind}")
        # at most 2 * side representatives of a vertex, one from each cell it is in
        known = materialize(stars.groupBy("v").agg(F.array_sort(F.collect_set("root")).alias("r")))
        rounds.append(known)
        others = known.where("size(r) > 1").select(F.col("r")[0].alias("u"), F.explode(F.slice("r", 2, 2 * side)).alias("v"))
        release(todo)
        todo = materialize(others.distinct())
        count = todo.count()
    if count:
        raise RuntimeError(f"groups are not stable after {max_rounds} rounds")
    if not rounds:
        return todo.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    release(todo)
    labels = None
    for known in reversed(rounds):
        parents = known.select("v", F.col("r")[0].alias("p"))
        if labels is None:
            labels = parents
            continue
        up = labels.select(F.col("v").alias("p"), F.col("p").alias("_top"))
        resolved = parents.join(up, "p", "left").select("v", F.coalesce("_top", "p").alias("p"))
        # written each time: the next step reads it twice, which would double the plan
        step = materialize(resolved.unionByName(labels.join(parents.select("v"), "v", "left_anti")))
        release(labels)
        labels = step
    return labels.select(F.col("v").alias("vertex"), F.col("p").alias("component"))
