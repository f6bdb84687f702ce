"""Approximate nearest neighbours with a forest of random-projection trees.

The trees are fitted on a bounded sample, every row is indexed in a leaf of each tree. A
query searches all trees through one priority queue, ordered by how far it lies on the
wrong side of the splits passed, until the leaves popped hold enough rows. Queries and rows
then meet per leaf, the best of each leaf are reranked by exact distance.

Vectors without cluster structure have neighbours on both sides of most splits: for a
recall of 0.9 and more a query must see over half of the rows, at any size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwell.llm.groups import sorted_groups
from maskwell.llm.vectors import is_usable
from maskwell.shared import materialize


@dataclass
class Tree:
    """Inner nodes: unit ``normal``, ``offset``, ``children`` (a node, or -1 - leaf)."""

    normal: np.ndarray
    offset: np.ndarray
    children: np.ndarray
    root: int
    leaves: int

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        node = np.full(len(x), self.root)
        while (open_rows := np.flatnonzero(node >= 0)).size:
            at = node[open_rows]
            beyond = np.einsum("ij,ij->i", x[open_rows], self.normal[at]) > self.offset[at]
            node[open_rows] = self.children[at, beyond.astype(np.int64)]
        return -node - 1


def grow_tree(sample: np.ndarray, capacity: int, seed: int) -> Tree:
    """Split at the median along the line through two random points until leaves fit ``capacity``."""
    rng = np.random.default_rng(seed)
    normals: list[np.ndarray] = []
    offsets: list[float] = []
    children: list[list[int]] = []
    leaves = 0

    def grow(points: np.ndarray) -> int:
        nonlocal leaves
        if len(points) > capacity:
            a, b = points[rng.choice(len(points), 2, replace=False)]
            length = np.linalg.norm(a - b)
            if length > 0:
                side = points @ ((a - b) / length)
                cut = float(np.median(side))
                beyond = side > cut
                if beyond.any():
                    node = len(normals)
                    normals.append((a - b) / length)
                    offsets.append(cut)
                    children.append([0, 0])
                    children[node] = [grow(points[~beyond]), grow(points[beyond])]
                    return node
        leaves += 1
        return -leaves

    root = grow(sample)
    dim = sample.shape[1]
    return Tree(
        np.array(normals).reshape(-1, dim), np.array(offsets), np.array(children, dtype=np.int64).reshape(-1, 2), root, leaves
    )


def search_leaves(trees: list[Tree], sizes: list[np.ndarray], query: np.ndarray, wanted: float) -> list[tuple[int, int]]:
    """(tree, leaf) popped from the shared queue until they hold ``wanted`` rows."""
    queue: list[tuple[float, int, int, int]] = [(-np.inf, t, t, tree.root) for t, tree in enumerate(trees)]
    heapq.heapify(queue)
    sides = [tree.normal @ query - tree.offset for tree in trees]
    turn, held, found = len(trees), 0.0, []
    while queue and held < wanted:
        wrong, _, t, node = heapq.heappop(queue)
        if node < 0:
            found.append((t, -node - 1))
            held += sizes[t][-node - 1]
            continue
        side = sides[t][node]
        for child, beyond in zip(trees[t].children[node].tolist(), (side, -side), strict=True):
            turn += 1
            heapq.heappush(queue, (max(wrong, beyond), turn, t, child))
    return found


def _nearest(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """The ``k`` nearest rows of every query of a leaf. A row that a query meets in a tree before is not ranked again."""
    for unit in sorted_groups(batches, ["tree", "leaf", "row_block", "query_block"]):
        is_query = unit["is_query"].to_numpy()
        if is_query.all() or not is_query.any():
            continue
        x = np.stack([np.asarray(v, dtype=np.float64) for v in unit["vector"]])
        ids = unit["id"].to_numpy()
        every, names = x[~is_query], ids[~is_query]
        earlier = np.stack(unit["places"][~is_query])[:, : int(unit["tree"].iloc[0])]
        bits = np.frombuffer(b"".join(unit["seen"][is_query]), dtype=np.uint8).reshape(int(is_query.sum()), -1)
        visited = np.unpackbits(bits, axis=1).astype(bool)
        again = np.zeros((len(bits), len(every)), dtype=bool)
        for column in earlier.T:
            again |= visited[:, column]
        out_query, out_id, out_score = [], [], []
        for q, name, met in zip(x[is_query], ids[is_query], again, strict=True):
            fresh = np.flatnonzero(~met)
            score = np.sqrt(((every[fresh] - q) ** 2).sum(axis=1))
            top = np.arange(len(fresh))
            if len(fresh) > k:
                top = np.flatnonzero(score <= np.partition(score, k - 1)[k - 1])
            top = top[np.lexsort((names[fresh[top]], score[top]))[:k]]
            out_query.append(np.full(len(top), name))
            out_id.append(names[fresh[top]])
            out_score.append(score[top])
        yield pd.DataFrame(
            {"query": np.concatenate(out_query), "vec_id": np.concatenate(out_id), "score": np.concatenate(out_score)}
        )


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    trees: int = 8,
    leaves: int = 64,
    sample_size: int = 8192,
    search_share: float = 1.15,
    block: int = 8192,
    seed: int = 3,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest rows found of each query row.

    ``search_share`` is the number of rows in the leaves that a query visits over all trees,
    as a multiple of all rows (a row met in two trees counts twice here, but is ranked in the
    first of them only); a small table gets more, so that every query finds ``k`` rows if there are that many. The trees come from
    ``sample_size`` vectors of smallest hash; at most ``trees`` x ``leaves`` inner nodes are
    sent to the tasks. Nearness is Euclidean distance in double precision on the original
    vectors, ties go to the smaller id.

    Rows with a null id, and vectors that are null, empty, zero or hold a null or non-finite
    component, take no part. Vectors of as many components are searched among themselves, each
    number with a forest of its own. A query is never its own neighbour; rows that repeat its id count as its own. Of identical vectors
    the ``k`` + 1 smallest ids stay candidates, as no list can hold more, and identical
    queries are searched once. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")
    ).where(F.col("id").isNotNull() & is_usable(F.col("vector")))
    # One row per number of components that a query has.
    dims = [r.dim for r in rows.where("asks").select(F.size("vector").alias("dim")).distinct().orderBy("dim").collect()]
    found = [
        _search(rows.where(F.size("vector") == dim), k, trees, leaves, sample_size, search_share, block, seed) for dim in dims
    ]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, found)


def _search(
    rows: DataFrame, k: int, trees: int, leaves: int, sample_size: int, search_share: float, block: int, seed: int
) -> DataFrame:
    """:func:`nearest_neighbours` of usable vectors of one length: ``id``, ``vector``, ``asks``."""
    spark = rows.sparkSession
    # The limit per vector is applied in each task before the shuffle, so copies stay there.
    by_vector = Window.partitionBy("vector").orderBy("id")
    kept = rows.select("id", "vector").dropDuplicates().withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)
    kept = materialize(kept.select("id", "vector"), "ann-rows")
    asking = materialize(rows.where("asks").groupBy("vector").agg(F.min("id").alias("class")), "ann-queries")
    sample = kept.orderBy(F.xxhash64("vector"), "id").limit(sample_size).select("vector").collect()
    points = np.array([r.vector for r in sample], dtype=np.float64)
    capacity = max(1, -(-len(points) // leaves))
    forest = [grow_tree(points, capacity, seed + t) for t in range(trees)]
    shared = spark.sparkContext.broadcast(forest)

    # Leaves are numbered over all trees: a row carries its places, a query a bit for each leaf that it visits.
    firsts = np.cumsum([0, *(tree.leaves for tree in forest)])

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                some = batch.iloc[at : at + 2048]
                x = np.stack([np.asarray(v, dtype=np.float64) for v in some["vector"]])
                leaf = np.stack([tree.leaf_of(x) for tree in shared.value], axis=1)
                places = list((leaf + firsts[:-1]).astype(np.int32))
                for t in range(len(shared.value)):
                    yield some.assign(tree=t, leaf=leaf[:, t], places=places)

    element = kept.schema["vector"].dataType.simpleString()
    indexed = kept.mapInPandas(index, f"id long, vector {element}, tree int, leaf int, places array<int>")
    # One row per leaf of the bounded forest.
    counts = indexed.groupBy("tree", "leaf").count().collect()
    held = [np.zeros(tree.leaves) for tree in forest]
    for r in counts:
        held[r.tree][r.leaf] = r["count"]
    # Leaves of all trees that hold this many rows hold at least k + 1 different ones.
    wanted = max(search_share * float(held[0].sum()), trees * (k + 1.0))
    sizes_shared = spark.sparkContext.broadcast(held)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                some = batch.iloc[at : at + 64]
                parts = []
                for name, vector in zip(some["id"], some["vector"], strict=True):
                    q = np.asarray(vector, dtype=np.float64)
                    visits = search_leaves(shared.value, sizes_shared.value, q, wanted)
                    t, leaf = np.array(visits, dtype=np.int64).reshape(-1, 2).T
                    seen = np.zeros(firsts[-1], dtype=bool)
                    seen[firsts[t] + leaf] = True
                    bits = np.packbits(seen).tobytes()
                    parts.append(pd.DataFrame({"id": name, "vector": [vector] * len(t), "tree": t, "leaf": leaf, "seen": [bits] * len(t)}))
                yield pd.concat(parts)

    # A table of the queries may be one file: deal them to all tasks.
    visits = asking.select(F.col("class").alias("id"), "vector").repartition("id")
    visits = materialize(visits.mapInPandas(search, f"id long, vector {element}, tree int, leaf int, seen binary"), "ann-visits")
    asked = visits.groupBy("tree", "leaf").count().collect()
    plan = [
        (r.tree, r.leaf, -(-int(held[r.tree][r.leaf]) // block) or 1, -(-r["count"] // block) or 1) for r in asked
    ]
    blocks = spark.createDataFrame(plan, "tree int, leaf int, row_blocks int, query_blocks int")

    def dealt(frame: DataFrame, own: str, other: str, as_query: bool) -> DataFrame:
        # One row per leaf of the bounded forest is broadcast.
        frame = frame.join(F.broadcast(blocks), ["tree", "leaf"])
        return frame.select(
            "tree",
            "leaf",
            F.pmod(F.xxhash64("id"), f"{own}_blocks").cast("int").alias(f"{own}_block"),
            F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(f"{other}_block"),
            F.lit(as_query).alias("is_query"),
            "id",
            "vector",
            F.lit(None).cast("array<int>").alias("places") if as_query else "places",
            "seen" if as_query else F.lit(None).cast("binary").alias("seen"),
        )

    units = dealt(indexed, "row", "query", False).unionByName(dealt(visits, "query", "row", True))
    keys = ["tree", "leaf", "row_block", "query_block"]
    found = (
        units.repartition(*keys)
        .sortWithinPartitions(*keys)
        .mapInPandas(lambda batches: _nearest(batches, k + 1), "query long, vec_id long, score double")
        .distinct()
    )
    order = Window.partitionBy("query").orderBy("score", "vec_id")
    best = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
    best = materialize(best, "ann-best")
    members = rows.where("asks").select("id", "vector").distinct().join(asking, "vector").select("id", F.col("class").alias("query"))
    own = Window.partitionBy("query_id").orderBy("score", "vec_id")
    listed = members.join(best, "query").where("id <> vec_id").select(F.col("id").alias("query_id"), "vec_id", "score")
    return (
        listed.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
