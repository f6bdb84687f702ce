"""Embedding near-duplicates by spherical-cap filters (Becker, Ducas, Gama, Laarhoven, 2016).

A filter is a direction; a vector belongs to it if their inner product exceeds a bound. Two
vectors of high cosine share many filters, unrelated ones few. The directions are product
codes: every combination of one codeword from each block of dimensions. So the filters of a
vector are found by list decoding, block by block with the best possible rest as a bound,
without trying all directions. Vectors meet in their filters and are verified there by
cosine in double precision.

The number of directions follows from the data: it grows with the largest label so that a
filter holds about ``load`` unrelated vectors. The bound is then lowered until a share of ``meet``
of random pairs at the threshold have a filter in common, measured with the code itself: sums
of a few blocks have shorter tails than the normal distribution of the first estimate. A
filter more than that is one more copy of every vector in the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwell.llm.components import connected_components
from maskwell.llm.groups import sorted_groups, union_labels
from maskwell.llm.vectors import is_usable
from maskwell.shared import materialize

_CHUNK = 1024


@dataclass(frozen=True)
class CapCode:
    """``codes`` independent product codes of ``blocks`` blocks with ``words`` codewords each."""

    codes: int
    blocks: int
    words: int
    bound: float
    seed: int = 11

    @staticmethod
    def plan(
        largest: int, cosine: float, dim: int, load: float = 64.0, shared: float = 4.0, meet: float = 0.9995
    ) -> CapCode:
        """Code for labels of at most ``largest`` vectors of ``dim`` components.

        Each vector joins the best filter of every code at least; the rarer a filter is, the more
        codes give the fewest filters in all.
        """
        normal = NormalDist()
        codes = max(10, round(5.5 * math.log10(max(1, largest)) - 8))
        share = min(0.02, load / max(1, largest))
        bound = normal.inv_cdf(1 - share)
        # Probability that the partner of a vector in a filter is in it too (numerically).
        x = np.linspace(bound, bound + 8, 4001)
        density = np.exp(-x * x / 2)
        beyond = np.array([1 - normal.cdf((bound - cosine * v) / math.sqrt(1 - cosine**2)) for v in x])
        both = float((density * beyond).sum() / density.sum())
        directions = max(4.0, shared / (both * share) / codes)
        blocks = max(2, math.ceil(math.log(directions) / math.log(512)))
        code = CapCode(codes, blocks, max(2, math.ceil(directions ** (1 / blocks))), bound)
        a, b = _pairs_at(cosine, dim)
        while code.bound > 0:
            (row_a, name_a), (row_b, name_b) = code.decode(a), code.decode(b)
            common = np.intersect1d(name_a * len(a) + row_a, name_b * len(a) + row_b, assume_unique=True)
            if len(np.unique(common % len(a))) >= meet * len(a):
                break
            code = replace(code, bound=code.bound - 0.05)
        return code

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) for each filter that a unit vector exceeds; at least its best one per code."""
        dim = unit.shape[1]
        blocks = min(self.blocks, dim)
        rows_out, filters_out = [], []
        for code in range(self.codes):
            books = _codebooks(dim, blocks, self.words, self.seed + code)
            scores = [unit[:, cols] @ words.T * math.sqrt(dim) / math.sqrt(blocks) for cols, words in books]
            best = [s.max(axis=1) for s in scores]
            rest = np.cumsum([np.zeros(len(unit)), *best[::-1]], axis=0)[::-1]
            # A vector that exceeds no direction still joins its best one.
            bound = np.minimum(self.bound, rest[0] - 1e-9)
            row, name, total = np.arange(len(unit)), np.zeros(len(unit), dtype=np.int64), np.zeros(len(unit))
            for k, s in enumerate(scores):
                reach = total[:, None] + s[row]
                at, word = np.nonzero(reach >= (bound[row] - rest[k + 1][row])[:, None])
                total = reach[at, word]
                name = name[at] * self.words + word
                row = row[at]
            rows_out.append(row)
            filters_out.append(name * self.codes + code)
        return np.concatenate(rows_out), np.concatenate(filters_out)


@cache
def _codebooks(dim: int, blocks: int, words: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per block: its dimensions (a random split) and unit codewords."""
    rng = np.random.default_rng(seed)
    books = []
    for cols in np.array_split(rng.permutation(dim), blocks):
        book = rng.normal(size=(words, len(cols)))
        book /= np.linalg.norm(book, axis=1, keepdims=True)
        # Unit codewords of equal length in every block: scale by the block's share of dimensions.
        books.append((cols, book * math.sqrt(len(cols) * blocks / dim)))
    return books


def _pairs_at(cosine: float, dim: int, n: int = 4096, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Random unit vectors and a partner of each at ``cosine``."""
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(2, n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    if dim == 1:
        return a, a
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, cosine * a + math.sqrt(1 - cosine**2) * b


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _share_smaller(
    n: int, owner: np.ndarray, filters: np.ndarray, current: int, left: np.ndarray, right: np.ndarray
) -> np.ndarray:
    """Whether each two rows of ``left`` x ``right`` have a filter smaller than ``current`` in common.

    ``owner`` and ``filters`` list the filters of ``n`` rows. One product of the rows' memberships,
    however many pairs there are.
    """
    owner, filters = owner[filters < current], filters[filters < current]
    names, column, times = np.unique(filters, return_inverse=True, return_counts=True)
    met = times[column] > 1
    holds = np.zeros((n, len(names)), dtype=np.float32)
    holds[owner[met], column[met]] = 1
    return holds[left] @ holds[right].T > 0


def _verify(batches: Iterator[pd.DataFrame], codes: dict[int, CapCode], cosine: float) -> Iterator[pd.DataFrame]:
    keys = ["label", "dim", "filter", "block_a", "block_b"]
    for unit in sorted_groups(batches, keys):
        if len(unit) < 2:
            continue
        x = _unit(unit["vector"])
        sides = unit["block"].to_numpy()
        a, b = unit["block_a"].iloc[0], unit["block_b"].iloc[0]
        left, right = (np.flatnonzero(sides == a), np.flatnonzero(sides == b))
        near = x[left] @ x[right].T >= cosine
        if a == b:
            np.fill_diagonal(near, False)
        if not near.any():
            continue
        # Decoded anew where links are found: lists of filters in the shuffle would outweigh the vectors.
        owner, names = codes[int(unit["dim"].iloc[0])].decode(x)
        new = near & ~_share_smaller(len(x), owner, names, int(unit["filter"].iloc[0]), left, right)
        copies, links = unit["copies"].to_numpy(), np.zeros(len(unit), dtype=np.int64)
        links[left] += new @ copies[right]
        if a != b:
            links[right] += new.T @ copies[left]
        i, j = np.nonzero(near)
        labels = union_labels(np.arange(len(unit)), left[i], right[j])
        node = unit["node"].to_numpy()
        # The label of a class is its smallest position; any member serves as its centre.
        use = (links > 0) | (labels != np.arange(len(unit)))
        yield pd.DataFrame({"node": node[use], "links": links[use], "centre": node[labels[use]]})


def link_embeddings(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = 0.93,
    load: float = 64.0,
    block: int = 2048,
) -> DataFrame:
    """One row per row of ``vectors``: ``id_col``, ``n_links``, ``component_id``, ``kept``.

    Two vectors link if their labels are equal and not null, they have as many components
    and their cosine is at least ``cosine``. ``n_links`` counts the other rows linked
    directly; ``component_id`` is the smallest non-null id reachable. Vectors that are null,
    empty, zero or hold a null or non-finite component link with nothing and keep their own
    id. Identical vectors of a label become one node first, so copies cost nothing, and rows
    that repeat an id are vectors of their own. A filter with more than ``block`` vectors is
    compared block by block in different tasks; each link is counted in the first filter
    that both vectors share. Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    usable = F.col("label").isNotNull() & is_usable(F.col("vector"))
    nodes = materialize(
        rows.where(usable)
        .groupBy("label", "vector")
        .agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))
        .withColumns({"dim": F.size("vector"), "node": F.monotonically_increasing_id()}),
        "vector-nodes",
    )
    # One row per number of components.
    per_dim = nodes.groupBy("label", "dim").count().groupBy("dim").agg(F.max("count").alias("n")).collect()
    codes = {r.dim: CapCode.plan(r.n, cosine, r.dim, load) for r in per_dim}

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), _CHUNK):
                for dim, some in batch.iloc[at : at + _CHUNK].groupby("dim"):
                    row, name = codes[dim].decode(_unit(some["vector"]))
                    order = np.lexsort((name, row))
                    lists = np.split(name[order], np.searchsorted(row[order], np.arange(1, len(some))))
                    yield some.assign(filters=lists)

    kind = nodes.schema["label"].dataType.simpleString()
    element = nodes.schema["vector"].dataType.simpleString()
    schema = f"label {kind}, vector {element}, copies long, first_id long, dim int, node long, filters array<long>"
    decoded = nodes.select("label", "vector", "copies", F.col("first_id").cast("long"), "dim", "node")
    decoded = materialize(decoded.mapInPandas(decode, schema), "vector-filters")
    dealt = decoded.select("*", F.explode("filters").alias("filter"))
    keys = ["label", "dim", "filter"]
    heavy = dealt.groupBy(*keys).count().where(F.col("count") > block)
    heavy = materialize(heavy.select(*keys, F.ceil(F.col("count") / block).cast("int").alias("blocks")), "heavy-filters")
    placed = dealt.join(heavy, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    units = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.withColumns({"block_a": F.least("block", "other"), "block_b": F.greatest("block", "other")})
    keys = [*keys, "block_a", "block_b"]
    units = units.select(*keys, "block", "node", "vector", "copies")
    found = (
        units.repartition(*keys)
        .sortWithinPartitions(*keys)
        .mapInPandas(lambda batches: _verify(batches, codes, cosine), "node long, links long, centre long")
    )
    found = materialize(found, "vector-links")
    roots = connected_components(found.select("node", F.col("centre").alias("other")), "node", "other")
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    slim = nodes.select("node", "copies", "first_id")
    joined = slim.join(counted, "node", "left").join(roots, "node", "left")
    joined = joined.select(
        "node",
        "first_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("root"),
    )
    joined = materialize(joined, "vector-classes")
    firsts = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_node = materialize(joined.join(firsts, "root").select("node", "n_links", "component_id"), "vector-components")
    named = materialize(nodes.join(of_node, "node").select("label", "vector", "n_links", "component_id"), "vector-results")
    linked = rows.where(usable).join(named, ["label", "vector"]).select("id", "n_links", "component_id")
    alone = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
