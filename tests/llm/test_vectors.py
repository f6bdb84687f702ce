import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from maskwell.llm import cap_filters, forest
from maskwell.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute_links(rows, cosine=0.93):
    """n_links and component of each position of (id, vector, label) rows."""
    units = []
    for _, vector, label in rows:
        ok = label is not None and vector and all(v is not None and np.isfinite(v) for v in vector) and any(vector)
        v = np.asarray(vector, float) if ok else None
        units.append(v / np.linalg.norm(v) if ok else None)
    near = [[j for j in range(len(rows)) if j != i and units[i] is not None and units[j] is not None
             and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine]
            for i in range(len(rows))]
    seen, component = set(), {}
    for start in range(len(rows)):
        if start in seen:
            continue
        stack, members = [start], []
        seen.add(start)
        while stack:
            at = stack.pop()
            members.append(at)
            for n in near[at]:
                if n not in seen:
                    seen.add(n)
                    stack.append(n)
        ids = [rows[m][0] for m in members if rows[m][0] is not None]
        component.update({m: min(ids, default=None) for m in members})
    return [(rows[k][0], len(near[k]), component[k]) for k in range(len(rows))]


def clustered(rng, n=120, dim=24):
    rows, k = [], 0
    for label in (1, 2):
        for _ in range(n // 6):
            centre = rng.normal(size=dim)
            for _ in range(rng.integers(1, 6)):
                rows.append((k, (centre + 0.12 * rng.normal(size=dim)).astype(np.float32).tolist(), label))
                k += 7
    return rows


def test_links_and_classes_equal_brute_force(spark):
    rows = clustered(np.random.default_rng(2))
    rows += [(10_000 + k, rows[0][1], rows[0][2]) for k in range(40)]  # copies
    rows += [(9_000, [2 * v for v in rows[3][1]], rows[3][2]), (9_001, rows[3][1], None), (9_002, None, 1)]
    rows += [(9_003, [], 1), (9_004, [0.0] * 24, 1), (9_005, [float("nan")] * 24, 1), (9_006, [None] * 24, 1)]
    rows += [(9_007, [float("inf")] + [1.0] * 23, 1), (9_008, rows[0][1][:5], 1), (None, rows[0][1], rows[0][2])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("x"))
    got = cap_filters.link_embeddings(frame, block=16)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got.collect()), key=str) == sorted(
        brute_links(rows), key=str
    )
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.where("vec_id is not null").collect())
    assert cap_filters.link_embeddings(frame.limit(0)).count() == 0


def test_query_1_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = [(r.vec_id, r.n_links, r.component_id) for r in QUERIES["op1_embedding_near_dedup"](spark, SF).collect()]
    assert sorted(got) == sorted(brute_links(rows))


@pytest.mark.parametrize("largest", [10, 5_000, 10**7, 10**9])
def test_filters_of_close_vectors_meet(largest):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(400, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    code = cap_filters.CapCode.plan(largest, 0.93, 64)
    (ra, fa), (rb, fb) = code.decode(a), code.decode(b)
    shared = [len(set(fa[ra == k]) & set(fb[rb == k])) for k in range(400)]
    assert np.mean(np.array(shared) > 0) >= 0.9975
    # The number of filters of a vector hardly follows the size of the data.
    assert len(ra) / 400 < 80


def pairs_at(rng, cosines, dim=64):
    a, b = rng.normal(size=(2, len(cosines), dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = np.asarray(cosines)[:, None]
    return a, c * a + np.sqrt(1 - c * c) * b


def write_embeddings(spark, rows, tmp_path):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    frame.write.parquet(str(tmp_path / "embeddings.parquet"))
    return QUERIES["op1_embedding_near_dedup"](spark, str(tmp_path)).collect()


def test_query_1_finds_the_pairs_near_the_threshold(spark, tmp_path):
    rng = np.random.default_rng(12)
    cosines = rng.uniform(0.9301, 0.935, 1500).tolist() + rng.uniform(0.925, 0.9299, 500).tolist()
    a, b = pairs_at(rng, cosines)
    rows = [(2 * k, x.tolist(), 3) for k, x in enumerate(a)] + [(2 * k + 1, x.tolist(), 3) for k, x in enumerate(b)]
    got = {r.vec_id: r for r in write_embeddings(spark, rows, tmp_path)}
    linked = [got[2 * k].component_id == got[2 * k + 1].component_id == 2 * k for k in range(2000)]
    assert sum(linked[:1500]) >= 1498 and not any(linked[1500:])


def test_query_1_counts_every_link_of_a_crowd(spark, tmp_path):
    rng = np.random.default_rng(13)
    centre = rng.normal(size=64)
    # Two vectors of the crowd have a cosine of about 0.93: nearly half of the pairs link.
    crowd = centre + 0.274 * rng.normal(size=(2000, 64)) * np.linalg.norm(centre) / 8
    unit = crowd / np.linalg.norm(crowd, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.93
    want = near.sum(axis=1) - 1
    rows = [(k, x.tolist(), 1) for k, x in enumerate(crowd)] + [(5000, crowd[0].tolist(), 2)]
    got = {r.vec_id: r for r in write_embeddings(spark, rows, tmp_path)}
    counted = np.array([got[k].n_links for k in range(2000)])
    assert 0.2 < near.mean() < 0.8 and got[5000].n_links == 0
    assert (counted <= want).all() and counted.sum() >= 0.9995 * want.sum()
    assert all(got[k].component_id == 0 for k in range(2000) if want[k] > 20)


def brute_nearest(rows, k=10):
    out = []
    usable = [(i, np.asarray(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    for q, x in usable:
        if q % 100 == 0:
            scored = sorted((float(np.sqrt(((y - x) ** 2).sum())), i) for i, y in usable if i != q)
            out += [(q, n + 1, i, s) for n, (s, i) in enumerate(scored[:k])]
    return out


def test_query_10_reaches_the_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = QUERIES["op10_nearest_neighbours"](spark, SF).collect()
    want = brute_nearest(rows)
    assert len(got) == len(want)
    exact = {(q, i): s for q, _, i, s in brute_nearest(rows, k=len(rows))}
    assert all(abs(exact[r.query_id, r.vec_id] - r.score) < 1e-12 for r in got)
    hits = {(q, i) for q, _, i, _ in want} & {(r.query_id, r.vec_id) for r in got}
    assert len(hits) / len(want) >= 0.9
    for q in {r.query_id for r in got}:
        mine = sorted((r.rank, r.score, r.vec_id) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)


def test_exact_when_all_leaves_are_searched_with_ties_and_bad_rows(spark):
    rng = np.random.default_rng(8)
    vectors = rng.integers(-2, 3, size=(150, 4)).astype(float)
    rows = [(k * 10, v.tolist()) for k, v in enumerate(vectors)] + [(5_000 + k, [1.0, 1.0, 1.0, 1.0]) for k in range(60)]
    rows += [(9_900, None), (9_800, []), (9_700, [0.0] * 4), (9_600, [float("nan")] * 4), (None, [1.0] * 4), (9_500, [1.0])]
    rows += [(9_400, [None, 1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = forest.nearest_neighbours(frame, F.col("vec_id") % 100 == 0, search_share=100.0, block=40, sample_size=64, leaves=8)
    rows += [(20_000 + 50 * k, rng.normal(size=3).tolist()) for k in range(30)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = forest.nearest_neighbours(frame, F.col("vec_id") % 100 == 0, search_share=100.0, block=40, sample_size=64, leaves=8)
    want = [w for dim in (3, 4) for w in brute_nearest([r for r in rows if r[1] is not None and len(r[1]) == dim])]
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got.collect()) == sorted(w[:3] for w in want)
    assert forest.nearest_neighbours(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    few = forest.nearest_neighbours(frame.where("vec_id in (0, 10, 20)"), F.col("vec_id") % 100 == 0)
    assert few.count() == len(brute_nearest(rows[:3]))


def test_a_row_of_several_visited_leaves_is_ranked_once():
    """All leaves of both trees are visited: every row is listed by the first tree and by no other."""
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(30, 4))
    leaf = np.stack([np.arange(30) % 3, 3 + np.arange(30) % 2], axis=1).astype(np.int32)
    bits = np.packbits(np.ones(5, dtype=bool)).tobytes()
    some = np.packbits(np.array([True, False, False, True, True])).tobytes()

    def unit(tree, at, seen):
        inside = np.flatnonzero(leaf[:, tree] == at)
        rows = [(tree, at - 3 * tree, 0, 0, False, int(i), vectors[i], leaf[i], None) for i in inside]
        ask = [(tree, at - 3 * tree, 0, 0, True, 1000, vectors[0], None, seen)]
        return pd.DataFrame(rows + ask, columns=["tree", "leaf", "row_block", "query_block", "is_query", "id", "vector", "places", "seen"])

    def met(seen, visits):
        return sorted(i for tree, at in visits for f in forest._nearest(iter([unit(tree, at, seen)]), 30) for i in f["vec_id"])

    assert met(bits, [(0, 0), (0, 1), (0, 2), (1, 3), (1, 4)]) == list(range(30))
    assert met(some, [(0, 0), (1, 3), (1, 4)]) == list(range(30))
    assert met(some, [(1, 3), (1, 4)]) == [i for i in range(30) if i % 3]
