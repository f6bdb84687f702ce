"""SimHash near-duplicates with vantage-point trees over Hamming distance.

1. Each text becomes a fingerprint (majority vote over hashed word shingles).
2. Equal fingerprints collapse to one node.
3. The fingerprint is read through a few keys, sets of its bits, so chosen that two near
   fingerprints differ by one bit or none in some key. A vantage-point tree per key, fitted
   on a bounded sample, deals every fingerprint to its home shard. A key just inside a sphere
   may have partners just outside, so it also visits the shards beyond the boundary that
   the triangle bounds leave open. Two keys within a bit meet once per tree, in the home of
   one of them.
4. Inside a shard the same bounds prune a local dual-tree search; pairs are kept by the
   distance of the whole fingerprints. Each shard gives the spanning edges of the links
   found, which connected components then join.

A tree over whole fingerprints would prune little: random ones lie 32 bits from a vantage
point, give or take 4, so a radius of 4 leaves nearly every boundary open. For a key of 21
bits the spread is 2.3 against a radius of 1, and no key has more than 22 values in reach:
what a fingerprint visits is bounded whatever the size of the data. Keys grow longer with
the table, so that the random partners of a value stay bounded too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.llm.components import connected_components
from maskwell.llm.groups import sorted_groups, union_labels, whole_groups
from maskwell.shared import materialize, release

_CHUNK = 8192
_DENSE = 1 << 22
#: A key of a fingerprint: ranges of bits, from the lowest, none across a multiple of 64.
Key = tuple[tuple[int, int], ...]


def shingle_hashes(text: str | None, words_per_shingle: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of every word shingle of a whole text, repeats included.

    Words are runs without ASCII white space, A-Z lower-cased. A text with fewer words than a
    shingle counts as one shingle, a text without a word has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    size = min(words_per_shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - size + 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)),
        dtype="<u8",
        count=n,
    )


def fingerprint(text: str | None, words_per_shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a whole text as an unsigned integer: a bit is 1 if over half the hashes have it.

    Without a word the result is 0.
    """
    return majority(shingle_hashes(text, words_per_shingle, seed))


def majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # Sums of up to 255 rows fit a byte.
        ones += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """A SimHash of 256 bits as little-endian bytes, from the same shingle hashes mixed anew."""
    parts = []
    for k in range(1, 5):
        x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        parts.append(majority(x ^ (x >> np.uint64(31))))
    return np.array(parts, dtype="<u8").tobytes()


#: Keys of a wide fingerprint: 16 words of 16 bits.
WIDE_KEYS: list[Key] = [((at, at + 16),) for at in range(0, 256, 16)]


def shingle_set(text: str | None, words_per_shingle: int = 5) -> np.ndarray:
    return np.unique(shingle_hashes(text, words_per_shingle))


def jaccard(a: str | None, b: str | None, words_per_shingle: int = 5) -> float:
    """Jaccard similarity of the sets of word shingles; two texts without words are equal."""
    return overlap(*(shingle_set(t, words_per_shingle) for t in (a, b)))


def overlap(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def with_fingerprint(docs: DataFrame, text_col: str, words_per_shingle: int = 4, seed: int = 42) -> DataFrame:
    """``docs`` with a column ``fingerprint`` (long, the 64 bits as a signed number)."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        values = [fingerprint(t, words_per_shingle, seed) for t in texts]
        return pd.Series(np.array(values, dtype=np.uint64).view(np.int64))

    return docs.withColumn("fingerprint", simhash(F.col(text_col)))


class VantageTree:
    """Vantage points and radii, fitted on a sample; leaves are shards."""

    def __init__(self, sample: np.ndarray, levels: int) -> None:
        self.vantage: list[int] = []
        self.inside: list[int] = []
        self.children: list[tuple[int, int]] = []
        self.leaves = 0
        self.root = self._grow(sample, levels)

    def _grow(self, points: np.ndarray, levels: int) -> int:
        """Index of the node, or -1 - shard for a leaf."""
        if levels > 0 and len(points) > 1:
            step = max(1, len(points) // 16)
            spread = [(np.bitwise_count(points ^ p).std(), int(p)) for p in points[::step]]
            vantage = np.uint64(max(spread)[1])
            distance = np.bitwise_count(points ^ vantage).astype(np.int64)
            inside = int(np.median(distance))
            if inside == distance.max():
                inside -= 1
            inner = distance <= inside
            if inner.any() and not inner.all():
                node = len(self.vantage)
                self.vantage.append(int(vantage))
                self.inside.append(inside)
                self.children.append((0, 0))
                self.children[node] = (self._grow(points[inner], levels - 1), self._grow(points[~inner], levels - 1))
                return node
        self.leaves += 1
        return -self.leaves

    def home(self, points: np.ndarray) -> np.ndarray:
        """The shard that each point lives in."""
        vantage, inside = np.array(self.vantage, dtype=np.uint64), np.array(self.inside, dtype=np.int64)
        children = np.array(self.children, dtype=np.int64).reshape(-1, 2)
        node = np.full(len(points), self.root)
        while (row := np.flatnonzero(node >= 0)).size:
            at = node[row]
            outside = np.bitwise_count(points[row] ^ vantage[at]) > inside[at]
            node[row] = children[at, outside.astype(np.int64)]
        return -node - 1

    def deal(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the point, shard, is at home) for every shard that a point must see."""
        vantage = np.array(self.vantage, dtype=np.uint64)
        inside = np.array(self.inside, dtype=np.int64)
        children = np.array(self.children, dtype=np.int64).reshape(-1, 2)
        row, node = np.arange(len(points)), np.full(len(points), self.root)
        home = np.ones(len(points), dtype=bool)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(row):
            leaf = node < 0
            done.append((row[leaf], -node[leaf] - 1, home[leaf]))
            row, node, home = row[~leaf], node[~leaf], home[~leaf]
            if not len(row):
                break
            gap = np.bitwise_count(points[row] ^ vantage[node]).astype(np.int64) - inside[node]
            inner = gap <= 0
            near_outer = gap + radius > 0
            # At home: own side only. Visiting: own side, and beyond the boundary if near it.
            go_in = np.where(home, inner, gap - radius <= 0)
            go_out = np.where(home, ~inner | near_outer, near_outer)
            row, node, home = (
                np.concatenate((row[go_in], row[go_out])),
                np.concatenate((children[node[go_in], 0], children[node[go_out], 1])),
                np.concatenate((home[go_in], home[go_out] & ~inner[go_out])),
            )
        return tuple(np.concatenate(parts) for parts in zip(*done, strict=True))


def _close_pairs(
    points: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``left`` x ``right`` within ``radius``, pruned by local vantage points."""
    if len(left) * len(right) > _DENSE:
        vantage = points[right[len(right) // 2]]
        dl = np.bitwise_count(points[left] ^ vantage).astype(np.int64)
        dr = np.bitwise_count(points[right] ^ vantage).astype(np.int64)
        mid = int(np.median(dr))
        parts = [
            (left[dl <= mid], right[dr <= mid]),
            (left[dl > mid], right[dr > mid]),
            (left[(dl <= mid) & (dl + radius > mid)], right[(dr > mid) & (dr - radius <= mid)]),
            (left[(dl > mid) & (dl - radius <= mid)], right[(dr <= mid) & (dr + radius > mid)]),
        ]
        if sum(len(a) * len(b) for a, b in parts) < 0.9 * len(left) * len(right):
            for a, b in parts:
                if len(a) and len(b):
                    yield from _close_pairs(points, a, b, radius)
            return
    step = max(1, _DENSE // 2 // max(1, len(right)))
    for at in range(0, len(left), step):
        some = left[at : at + step]
        i, j = np.nonzero(np.bitwise_count(points[some][:, None] ^ points[right][None, :]) <= radius)
        yield some[i], right[j]


def exact_keys(radius: int, total: int, bits: int = 64, most: float = 2048.0) -> list[Key]:
    """Keys of which two fingerprints within ``radius`` bits agree in one but for a bit.

    Of ``n`` words the ``k`` with the fewest differences hold at most one between them, if
    ``n`` is large enough; every choice of ``k`` words is a key. Longer keys are more trees
    with fewer random partners: the first choice that leaves a value ``most`` or fewer of
    them among ``total`` values is taken, or else the longest.
    """
    for k in (1, 2, 3):
        n = radius // 2 + 1 if k == 1 else radius + k - 1
        if n < 3:
            continue
        edges = [bits * i // n for i in range(n + 1)]
        keys = list(combinations(zip(edges, edges[1:], strict=False), k))
        if random_partners(keys, total) <= most:
            break
    return keys


def random_partners(keys: list[Key], total: int) -> float:
    """Values of ``total`` random ones that differ from a given one by a bit or none in some key, at most."""
    widths = [sum(b - a for a, b in key) for key in keys]
    return total * sum((w + 1) / 2.0**w for w in widths)


def key_values(lanes: np.ndarray, key: Key) -> np.ndarray:
    """The bits of a key of each row of ``lanes`` (64-bit words of fingerprints), packed."""
    value, at = np.zeros(len(lanes), dtype=np.uint64), 0
    for a, b in key:
        part = lanes[:, a // 64] >> np.uint64(a % 64)
        if b - a < 64:
            part &= np.uint64((1 << (b - a)) - 1)
        value |= part << np.uint64(at)
        at += b - a
    return value


def _lanes(frame: pd.DataFrame) -> np.ndarray:
    """Fingerprints of a frame: 64-bit words from ``bits``, or ``id`` itself where that is missing."""
    if "bits" not in frame:
        return frame["id"].to_numpy().astype(np.int64).view(np.uint64).reshape(-1, 1)
    flat = np.frombuffer(b"".join(frame["bits"]), dtype="<u8")
    return flat.reshape(len(frame), -1 if len(frame) else 1)


def _unit_edges(
    batches: Iterator[pd.DataFrame], keys: list[Key], radius: int, size_ratio: float
) -> Iterator[pd.DataFrame]:
    """Spanning edges of the links of each unit."""
    for unit in sorted_groups(batches, ["unit"]):
        lanes, ids = _lanes(unit), unit["id"].to_numpy().astype(np.int64)
        sizes = unit["size"].to_numpy() if "size" in unit else None
        values = key_values(lanes, keys[(int(unit["unit"].iloc[0]) >> _SHARD_AT) % len(keys)])
        homes, seekers = np.flatnonzero(unit["as_home"].to_numpy()), np.flatnonzero(unit["as_seeker"].to_numpy())
        labels = np.arange(len(unit))
        for i, j in _close_pairs(values, seekers, homes, 1):
            if sizes is not None:
                near = np.minimum(sizes[i], sizes[j]) >= size_ratio * np.maximum(sizes[i], sizes[j])
                i, j = i[near], j[near]
            for at in range(0, len(i), _DENSE):
                x, y = i[at : at + _DENSE], j[at : at + _DENSE]
                new = labels[x] != labels[y]
                x, y = x[new], y[new]
                apart = np.bitwise_count(lanes[x] ^ lanes[y]).sum(axis=1, dtype=np.int64)
                labels = union_labels(labels, x[apart <= radius], y[apart <= radius])
        linked = labels != np.arange(len(unit))
        yield pd.DataFrame({"a": ids[linked], "b": ids[labels[linked]]})


_SHARD_AT = 32


def _units(
    row: np.ndarray, shard: np.ndarray, home: np.ndarray, ids: np.ndarray, home_blocks: np.ndarray, seek_blocks: np.ndarray
) -> Iterator[pd.DataFrame]:
    """``row``, ``unit``, ``as_home``, ``as_seeker`` of each dealt point: every home block meets every seek block."""
    mixed = ids.view(np.uint64)[row] * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    of_homes, of_seeks = home_blocks[shard], seek_blocks[shard]
    own_home, own_seek = (mixed % of_homes).astype(np.int64), ((mixed >> np.uint64(32)) % of_seeks).astype(np.int64)

    def frame(at: np.ndarray, h: np.ndarray, s: np.ndarray, seeker: bool) -> pd.DataFrame:
        unit = shard[at] << _SHARD_AT | h << 16 | s
        return pd.DataFrame({"row": row[at], "unit": unit, "as_home": home[at] & (h == own_home[at]), "as_seeker": seeker})

    def spread(at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = counts[at].astype(np.int64)
        return np.repeat(at, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    at, h = spread(np.arange(len(row)), of_homes)
    yield frame(at, h, own_seek[at], True)
    at, s = spread(np.flatnonzero(home & (of_seeks > 1)), of_seeks)
    other = s != own_seek[at]
    yield frame(at[other], own_home[at[other]], s[other], False)


def hamming_links(
    points: DataFrame,
    radius: int = 4,
    keys: list[Key] | None = None,
    size_ratio: float = 0.0,
    sample_size: int = 131_072,
    shard_rows: int = 65_536,
    block_rows: int = 131_072,
) -> DataFrame:
    """Edges ``a``, ``b`` that span all links of the rows ``id`` (long, distinct) of ``points``.

    Two rows link at ``radius`` differing bits of ``bits`` (binary, whole 64-bit words; without
    that column the id is the fingerprint) or fewer, if they agree in one of ``keys`` but for a
    bit; by default those of :func:`exact_keys`, where the first implies the second. With a
    column ``size`` the smaller of the two must be at least ``size_ratio`` of the larger. Null
    ids take no part; an empty table has no links. ``points`` is read several times: give a stored table.

    The trees are fitted on at most ``sample_size`` rows (those of smallest hash), so each has at
    most an eighth as many shards and their size on the driver and in tasks is bounded; every row
    is searched. Shards whose homes exceed ``block_rows`` (a dense neighbourhood, or more data
    than the bounded tree has leaves for) are compared block by block in separate tasks.
    """
    spark = points.sparkSession
    columns = [c for c in ("id", "bits", "size") if c in points.columns]
    points = points.where("id is not null").select(*columns)
    total = points.count()
    keys = exact_keys(radius, total) if keys is None else keys
    levels = math.ceil(math.log2(max(1, total) / shard_rows)) if total > shard_rows else 0
    levels = max(0, min(levels, int(math.log2(max(8, sample_size) // 8))))
    # At most sample_size fingerprints come to the driver.
    sample = points.orderBy(F.xxhash64("id"), "id").limit(min(sample_size, max(1024, 8 << levels)))
    sampled = _lanes(pd.DataFrame(sample.collect(), columns=columns))
    trees = spark.sparkContext.broadcast([VantageTree(key_values(sampled, key), levels) for key in keys if total])

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
        """(batch, index of the row, shard, is at home)."""
        for batch in batches:
            for at in range(0, len(batch), 2 * _CHUNK):
                some = batch.iloc[at : at + 2 * _CHUNK]
                lanes = _lanes(some)
                for k, tree in enumerate(trees.value):
                    row, shard, home = tree.deal(key_values(lanes, keys[k]), 1)
                    yield some, row, shard.astype(np.int64) * len(keys) + k, home

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, _, shard, home in dealt(batches):
            seen, where = np.unique(shard, return_inverse=True)
            yield pd.DataFrame({"shard": seen, "homes": np.bincount(where, home), "n": np.bincount(where)}).astype("int64")

    # One row per shard of the bounded trees comes to the driver.
    sizes = points.mapInPandas(count, "shard long, homes long, n long").groupBy("shard").agg(F.sum("homes").alias("homes"), F.sum("n").alias("n")).collect()
    blocks = np.ones((2, 1 + max([r.shard for r in sizes], default=0)), dtype=np.uint64)
    for r in sizes:
        blocks[:, r.shard] = max(1, -(-r.homes // block_rows)), max(1, -(-r.n // (4 * block_rows)))
    blocks_shared = spark.sparkContext.broadcast(blocks)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some, row, shard, home in dealt(batches):
            for units in _units(row, shard, home, some["id"].to_numpy().astype(np.int64), *blocks_shared.value):
                if len(units):
                    own = some.iloc[units.pop("row").to_numpy()].reset_index(drop=True)
                    yield pd.concat([units.reset_index(drop=True), own], axis=1)

    kinds = {"id": "id long", "bits": "bits binary", "size": "size int"}
    schema = ", ".join(["unit long", "as_home boolean", "as_seeker boolean", *[kinds[c] for c in columns]])
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return (
        points.mapInPandas(deal, schema)
        .repartition(tasks, "unit")
        .sortWithinPartitions("unit")
        .mapInPandas(lambda batches: _unit_edges(batches, keys, radius, size_ratio), "a long, b long")
    )


def simhash_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_per_shingle: int = 4,
    radius: int = 4,
) -> DataFrame:
    """One row per document: ``id_col``, ``text_hash``, ``fingerprint``, ``component_id``.

    ``component_id`` is the smallest non-null id reachable over links of at most ``radius``
    differing bits. Null and empty texts have fingerprint 0 and link like any other; rows
    that repeat an id each get a row; a null id takes part and a class that has only null
    ids has a null ``component_id``. Other columns of ``docs``, whatever their names, are
    not read. An empty table gives an empty result.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = materialize(
        with_fingerprint(slim.withColumn("text_hash", F.xxhash64("text")), "text", words_per_shingle).drop("text"),
        "fingerprints",
    )
    distinct = materialize(prints.select(F.col("fingerprint").alias("id")).distinct(), "points")
    roots = connected_components(hamming_links(distinct, radius), "a", "b")
    nodes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
    rooted = materialize(
        nodes.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
            "fingerprint", "first_id", F.coalesce("component", "fingerprint").alias("root")
        ),
        "rooted",
    )
    firsts = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_print = materialize(rooted.join(firsts, "root").select("fingerprint", "component_id"), "classes")
    return prints.join(of_print, "fingerprint").select(
        F.col("doc_id").alias(id_col), "text_hash", "fingerprint", "component_id"
    )


#: Slots of hashes: a bounded broadcast that tells most rows which a join will not match from the rest.
SLOTS = 1 << 20


def _slot(hashed: str) -> Column:
    return F.pmod(F.col(hashed), F.lit(SLOTS)).alias("_slot")


def split_by_slots(rows: DataFrame, hashed: str, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may match ``listed`` by ``hashed``, rows that cannot), so that the second need no shuffle.

    At most ``SLOTS`` numbers are broadcast; once all slots are taken every row may match.
    """
    slots = F.broadcast(listed.select(_slot(hashed)).distinct())
    keyed = rows.withColumn("_slot", _slot(hashed))
    return keyed.join(slots, "_slot", "left_semi").drop("_slot"), keyed.join(slots, "_slot", "left_anti").drop("_slot")


def _shared_shingles(unit: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, number of common hashes) of each two rows of one unit that have any in common.

    ``hashes`` holds the sets of all rows one after another. Hashes that few rows of a unit
    share are paired up from their lists, the others by a matrix product per unit.
    """
    n = len(lengths)
    owner = np.repeat(np.arange(n), lengths)
    order = np.lexsort((hashes, unit[owner]))
    owner, sorted_hashes, sorted_unit = owner[order], hashes[order], unit[owner[order]]
    fresh = np.ones(len(owner), dtype=bool)
    fresh[1:] = (sorted_hashes[1:] != sorted_hashes[:-1]) | (sorted_unit[1:] != sorted_unit[:-1])
    starts = np.flatnonzero(fresh)
    posted = np.diff(np.append(starts, len(owner)))
    codes, weights = [], []
    for p in np.unique(posted[(posted > 1) & (posted <= _FEW)]):
        lists = np.sort(owner[starts[posted == p][:, None] + np.arange(p)], axis=1)
        a, b = np.triu_indices(p, 1)
        found, times = np.unique(lists[:, a] * n + lists[:, b], return_counts=True)
        codes.append(found)
        weights.append(times)
    many = starts[posted > _FEW]
    for u in np.unique(sorted_unit[many]):
        own = many[sorted_unit[many] == u]
        rows = np.unique(owner[np.searchsorted(sorted_unit, u) : np.searchsorted(sorted_unit, u, side="right")])
        holds = np.zeros((len(rows), len(own)), dtype=np.float32)
        for k, (at, p) in enumerate(zip(own, posted[np.searchsorted(starts, own)], strict=True)):
            holds[np.searchsorted(rows, owner[at : at + p]), k] = 1
        common = holds @ holds.T
        a, b = np.nonzero(np.triu(common, 1))
        codes.append(rows[a] * n + rows[b])
        weights.append(common[a, b].astype(np.int64))
    if not codes:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    code, where = np.unique(np.concatenate(codes), return_inverse=True)
    return code // n, code % n, np.bincount(where, np.concatenate(weights)).astype(np.int64)


_FEW = 64


def _similar_edges(batches: Iterator[pd.DataFrame], similarity: float) -> Iterator[pd.DataFrame]:
    """Spanning edges of the pairs of each ``unit`` whose sets are similar; pairs of one class are skipped."""
    for some in whole_groups(batches, "unit", lambda frame: sum(map(len, frame["hashes"])), 1 << 22):
        # A document that is read twice brings its set twice.
        some = some.drop_duplicates(["unit", "id"]).reset_index(drop=True)
        ids, classes = some["id"].to_numpy().astype(np.int64), some["class"].to_numpy().astype(np.int64)
        unit = np.unique(some["unit"].to_numpy().astype(str), return_inverse=True)[1]
        lengths = np.array([len(x) // 8 for x in some["hashes"]], dtype=np.int64)
        i, j, common = _shared_shingles(unit, lengths, np.frombuffer(b"".join(some["hashes"]), dtype="<u8"))
        near = (common >= similarity * (lengths[i] + lengths[j] - common)) & (classes[i] != classes[j])
        labels = union_labels(np.arange(len(some)), i[near], j[near])
        linked = labels != np.arange(len(some))
        yield pd.DataFrame({"a": ids[linked], "b": ids[labels[linked]]})


def _verified_links(sets: DataFrame, similarity: float, block_hashes: int, block_sets: int) -> DataFrame:
    """Edges ``a``, ``b`` that span the links of similarity within each group of ``sets``.

    ``sets`` has ``id``, ``group``, ``size`` and ``hashes``. A group whose sets are within both
    bounds is one unit. A larger one is dealt to blocks, each first searched in itself; what
    links there is one class, and of the blocks' pairs only those remain in which one row is
    outside the largest class of its group.
    """
    sizes = sets.groupBy("group").agg(F.sum("size").alias("hashes"), F.count("*").alias("n"))
    parts = F.greatest(F.ceil(F.col("hashes") / F.lit(block_hashes)), F.ceil(F.col("n") / F.lit(block_sets))).cast("int")
    sizes = materialize(sizes.select("group", parts.alias("parts")).where("parts > 1"), "large-groups")
    placed = sets.join(sizes, "group", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), "parts"))
    search = {"func": lambda batches: _similar_edges(batches, similarity), "schema": "a long, b long"}

    def searched(units: DataFrame, *unit) -> DataFrame:
        named = units.select(F.concat_ws(":", *unit).alias("unit"), "id", "class", "hashes")
        return materialize(named.repartition("unit").sortWithinPartitions("unit").mapInPandas(**search), "links")

    alone = F.col("id").alias("class")
    links = searched(placed.select("id", alone, "hashes", "group", "block"), "group", "block")
    if sizes.isEmpty():
        return links
    roots = connected_components(links, "a", "b")
    large = placed.where("parts > 1").join(roots.withColumnRenamed("node", "id"), "id", "left")
    large = materialize(large.withColumn("class", F.coalesce("component", "id")).drop("component"), "large-group-sets")
    counts = large.groupBy("group", "class").count()
    largest = counts.groupBy("group").agg(F.max(F.struct("count", "class")).alias("m")).select("group", F.col("m.class").alias("largest"))
    large = large.join(materialize(largest, "largest-classes"), "group")
    seeks = F.col("class") != F.col("largest")
    # Only blocks that hold a row outside the largest class seek, and they meet every block.
    seeking = large.where(seeks).groupBy("group").agg(F.sum("size").alias("hashes"), F.count("*").alias("n"))
    fewer = F.greatest(F.ceil(F.col("hashes") / F.lit(block_hashes)), F.ceil(F.col("n") / F.lit(block_sets))).cast("int")
    large = large.join(materialize(seeking.select("group", fewer.alias("seek_parts")), "seeking-groups"), "group")
    own = F.pmod(F.xxhash64("id", F.lit(1)), "seek_parts")
    as_home = large.withColumn("seek_block", F.explode(F.sequence(F.lit(0), F.col("seek_parts") - 1)))
    as_seeker = large.where(seeks).withColumn("seek_block", own)
    as_seeker = as_seeker.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    columns = ["id", "class", "hashes", "group", "block", "seek_block"]
    return links.unionByName(searched(as_home.select(*columns).unionByName(as_seeker.select(*columns)), "group", "block", "seek_block"))


def similar_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_per_shingle: int = 5,
    similarity: float = 0.8,
    radius: int = 60,
    block_hashes: int = 1 << 18,
    block_sets: int = 1024,
) -> DataFrame:
    """As :func:`simhash_classes`, by Jaccard similarity of sets of word shingles instead of bits alone.

    Texts with equal sets are one node, all others join by verified links alone: the sets of both
    texts have a similarity of at least ``similarity``. The trees search a fingerprint of 256 bits
    of each set, in which a repeated shingle counts once. A pair at 0.8 differs in 15 % of the bits:
    it agrees in one of 16 words of 16 bits but for a bit with a chance of 0.99, and ``radius`` bits
    lie over three standard deviations above what such a pair shows.

    Shards return spanning edges, so a crowd gives no pairs. What they span is a group; sets of one
    group meet, block by block where a group is large, and all their pairs are verified but those
    whose texts are joined already. ``class`` is the smallest node of a class. An empty table gives
    an empty result.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    text_hash = F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash")

    @F.pandas_udf("node long, bits binary, size int")
    def prints_of(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, words_per_shingle) for t in texts]
        nodes = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], dtype=np.uint64).view(np.int64)
        return pd.DataFrame({"node": nodes, "bits": [wide_fingerprint(x) for x in sets], "size": [len(x) for x in sets]})

    prints = materialize(slim.select("doc_id", text_hash, prints_of("text").alias("p")).select("doc_id", "text_hash", "p.*"), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "size", "bits"))
    nodes = materialize(prints.groupBy("node").agg(first.alias("first")).select(F.col("node").alias("id"), "first.*"), "nodes")
    groups = connected_components(hamming_links(nodes, radius, WIDE_KEYS, similarity), "a", "b")
    members = nodes.join(groups.select(F.col("node").alias("id"), F.col("component").alias("group")), "id")
    members = materialize(members.select("id", "group", "size", F.col("doc_id").alias("first_id"), "text_hash"), "members")

    @F.pandas_udf("binary")
    def hashes_of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, words_per_shingle).tobytes() for t in texts])

    # One text of each node that has a group: shingled once more instead of kept for all.
    grouped, _ = split_by_slots(slim.select("doc_id", "text", text_hash), "text_hash", members)
    texts = grouped.join(members, "text_hash").where(F.col("doc_id").eqNullSafe(F.col("first_id")))
    sets = materialize(texts.select("id", "group", "size", hashes_of("text").alias("hashes")), "shingle-sets")
    links = _verified_links(sets, similarity, block_hashes, block_sets)
    roots = connected_components(links, "a", "b")
    final = nodes.join(roots, F.col("id") == F.col("node"), "left").select("id", "doc_id", F.coalesce("component", "id").alias("class"))
    final = materialize(final, "rooted")
    firsts = final.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    of_node = materialize(final.join(firsts, "class").select(F.col("id").alias("node"), "class", "component_id"), "classes")
    release(nodes, members, sets, final)
    return prints.join(of_node, "node").select(F.col("doc_id").alias(id_col), "text_hash", "component_id", "class")


def keep_one_per_class(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, similarity: float = 0.8
) -> DataFrame:
    """``docs`` with one document of each class of similar texts, in the columns of ``docs``.

    The smallest non-null id stays (of equal ids, the smallest hash of the text; a class of
    null ids keeps the one with the smallest hash). Rows that repeat both id and text count
    as one. Null and empty texts are one class.
    """
    keys = ["no_id", "id", "hash"]
    key = [F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(id_col), F.lit(0)).alias("id")]
    hashed = F.coalesce(F.xxhash64(docs[text_col]), F.lit(0)).alias("hash")
    classes = similar_classes(docs, id_col, text_col, words_per_shingle, similarity).select(*key, F.col("text_hash").alias("hash"), "class")
    rows = materialize(classes.select(F.struct("no_id", "id", "hash").alias("k"), "class"), "class-members")
    crowds = rows.groupBy("class").agg(F.min("k").alias("kept"), F.count("*").alias("n")).where("n > 1")
    crowded = materialize(rows.join(crowds, "class").select("k.*", (F.col("k") == F.col("kept")).alias("stays")).distinct(), "crowded")
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), *key, hashed)
    # Rows alone in their class stay as they are; only the texts of the others are shuffled.
    touched, alone = split_by_slots(keyed, "hash", crowded)
    single = touched.dropDuplicates(keys).join(crowded.where("not stays"), keys, "left_anti")
    return single.select("_row.*").unionByName(alone.select("_row.*"))
