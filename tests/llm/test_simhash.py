import inspect
import random
import re

import numpy as np
import pytest
import xxhash

from maskwell.llm import simhash
from maskwell.llm.components import connected_components
from maskwell.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    parent = {k: k for k in range(len(ids))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for k in range(len(ids)):
        groups.setdefault(find(k), []).append(k)
    return {k: min((ids[m] for m in g if ids[m] is not None), default=None) for g in groups.values() for k in g}


def test_fingerprint_of_edge_texts():
    for text in ["", None, " \t\n", "a", "A b C", "ü Ü ß x y", "\x1ca b\x0bc d", "w " * 9000, "x" * 50_000]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = [brute_fingerprint(r.text) for r in docs]
    want = brute_components([r.doc_id for r in docs], prints)
    got = {r.doc_id: r for r in QUERIES["op7_simhash_near_dedup"](spark, SF).collect()}
    assert len(got) == len(docs)
    for k, r in enumerate(docs):
        assert got[r.doc_id].fingerprint == f"{prints[k]:016x}"
        assert got[r.doc_id].component_id == want[k]
    assert len({r.component_id for r in got.values()}) < len(docs)


@pytest.mark.parametrize(("shard_rows", "sample_size"), [(16, 128), (16, 4096), (400, 128)])
def test_links_are_exact_over_many_shards_and_blocks(spark, shard_rows, sample_size):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(300)]
    dense = rng.getrandbits(64)
    for v in values[:60] + [dense] * 250:
        for _ in range(rng.randint(0, 5)):
            v ^= 1 << rng.randrange(64)
        values.append(v)
    values = sorted(set(values))
    signed = np.array(values, dtype=np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(v,) for v in [*signed, None]], "id long")
    links = simhash.hamming_links(frame, radius=4, sample_size=sample_size, shard_rows=shard_rows, block_rows=shard_rows)
    roots = {r.node: r.component for r in connected_components(links, "a", "b").collect()}
    got = [roots.get(v, v) for v in signed]
    want = brute_components(signed, values)
    assert [want[k] for k in range(len(values))] == [
        min(s for s, g in zip(signed, got) if g == mine) for mine in got
    ]


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 180)] + [(7, 7), (None, 3), (5, 4)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(frame, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, **{k: 100 for k in range(100, 180)}}
    assert connected_components(frame.limit(0), "a", "b").count() == 0


def test_nulls_ties_clashing_columns_and_empty_tables(spark):
    rows = [
        (3, "one two three four five", "a"),
        (2, "one two three four five", "b"),
        (2, "one two three four five", "b"),
        (None, "one two three four five", "c"),
        (9, None, None),
        (8, "", "d"),
        (None, "other words entirely here now", "e"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string").withColumnRenamed("x", "y")
    got = sorted(
        ((r.doc_id, r.component_id) for r in simhash.simhash_classes(docs).collect()), key=lambda x: str(x)
    )
    assert got == sorted([(3, 2), (2, 2), (2, 2), (None, 2), (9, 8), (8, 8), (None, None)], key=str)
    kept = simhash.keep_one_per_class(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.component_id) for r in kept.collect() if r.doc_id) == [(2, "b"), (8, "d")]
    assert kept.count() == 3
    empty = docs.limit(0)
    assert simhash.simhash_classes(empty).count() == 0
    assert simhash.keep_one_per_class(empty).count() == 0


def test_similar_texts_share_a_class(spark):
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(4000)]
    rows = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(200)]
        for edits in (0, 1, 2, 3, 4, 12):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    got = {r.doc_id: r["class"] for r in simhash.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if i // 6 == j // 6]
    near = [(i, j) for i, j in pairs if simhash.jaccard(rows[i][1], rows[j][1]) >= 0.8]
    assert len(near) > 150
    assert sum(got[i] == got[j] for i, j in near) >= 0.97 * len(near)
    assert not any(got[i] == got[j] for i in range(len(rows)) for j in range(i) if i // 6 != j // 6)
    assert not any(got[i * 6] == got[i * 6 + 5] for i in range(40))


@pytest.mark.parametrize("size", [8, 20, 46, 100, 200])
def test_pairs_at_the_threshold_become_candidates(size):
    radius = inspect.signature(simhash.similar_classes).parameters["radius"].default
    rng = np.random.default_rng(size)
    found = 0
    for _ in range(400):
        both = round(size * 2 * 0.8 / 1.8)
        hashes = rng.integers(0, 1 << 64, 2 * size - both, dtype=np.uint64)
        sides = (np.sort(hashes[:size]), np.sort(hashes[size - both :]))
        a, b = (np.frombuffer(simhash.wide_fingerprint(x), dtype="<u2") for x in sides)
        apart = np.bitwise_count(a ^ b)
        found += apart.sum() <= radius and apart.min() <= 1
    assert found >= 0.975 * 400


@pytest.mark.parametrize("total", [10**3, 4 * 10**6, 10**9, 10**11])
def test_keys_meet_all_near_fingerprints_and_few_random_ones(total):
    keys = simhash.exact_keys(4, total)
    assert simhash.random_partners(keys, total) <= 2048 or len(keys) == 20
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 64, 20_000, dtype=np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, len(b)).astype(np.uint64)
    apart = [np.bitwise_count(simhash.key_values(a[:, None], k) ^ simhash.key_values(b[:, None], k)) for k in keys]
    assert (np.min(apart, axis=0) <= 1).all()


def test_random_fingerprints_meet_as_few_as_planned():
    rng = np.random.default_rng(2)
    points = rng.integers(0, 1 << 64, 4_000_000, dtype=np.uint64)
    keys = simhash.exact_keys(4, 10**9)
    assert len(keys) > 3
    met = 0
    for key in keys:
        values = simhash.key_values(points[:, None], key)
        probes = simhash.key_values(points[:16, None], key)
        met += sum(int((np.bitwise_count(values ^ p) <= 1).sum()) - 1 for p in probes) / len(probes)
    planned = simhash.random_partners(keys, len(points))
    assert planned < 60 and 0.5 * planned - 2 <= met <= 2 * planned + 2


def brute_links(sets, similarity=0.8):
    return {(i, j) for j in range(len(sets)) for i in range(j) if simhash.overlap(sets[i], sets[j]) >= similarity}


@pytest.mark.parametrize(("hashes", "count"), [(1 << 18, 1024), (1500, 1024), (1 << 18, 7)])
def test_verified_links_equal_brute_force(spark, hashes, count):
    rng = np.random.default_rng(7)
    sets, groups = [], []
    for group in range(6):
        base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        for _ in range([1, 2, 5, 40, 90, 150][group]):
            own = base.copy()
            edits = int(rng.integers(0, 12))
            own[rng.choice(60, edits, replace=False)] = rng.integers(0, 1 << 63, edits, dtype=np.uint64)
            sets.append(np.unique(own))
            groups.append(group)
    frame = spark.createDataFrame(
        [(k, g, len(s), s.astype("<u8").tobytes()) for k, (s, g) in enumerate(zip(sets, groups, strict=True))],
        "id long, group long, size int, hashes binary",
    )
    links = simhash._verified_links(frame.union(frame.limit(3)), 0.8, hashes, count)
    roots = {r.node: r.component for r in connected_components(links, "a", "b").collect()}
    label = list(range(len(sets)))
    for i, j in sorted(brute_links(sets)):
        old, new = max(label[i], label[j]), min(label[i], label[j])
        label = [new if x == old else x for x in label]
    assert [roots.get(k, k) for k in range(len(sets))] == label
    assert 1 < len(set(label)) < len(sets)


@pytest.mark.parametrize("length", [9, 14, 30, 120])
def test_recall_on_short_and_long_texts(spark, length):
    rng = random.Random(length)
    rows = []
    for _ in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(length)]
        rows.append(base)
        # One word more at an end, and for longer texts a word changed inside.
        rows.append([*base, "end"])
        if length > 30:
            rows.append([*base[:50], "other", *base[51:]])
    texts = [" ".join(r) for r in rows]
    sets = [simhash.shingle_set(t) for t in texts]
    near = brute_links(sets)
    got = classes_of(spark, texts)
    assert len(near) >= 60
    assert sum(got[i] == got[j] for i, j in near) >= 0.97 * len(near)


def classes_of(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r["class"] for r in simhash.similar_classes(frame).collect()}


def test_repeats_of_a_line_do_not_hide_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(4000)}" for _ in range(200)]
    line = [f"l{k}" for k in range(7)]
    texts = [" ".join(base + line * n) for n in (1, 20, 40, 100)]
    assert simhash.jaccard(texts[0], texts[3]) >= 0.95
    assert len(set(classes_of(spark, texts).values())) == 1


def test_only_verified_links_join(spark):
    rng = np.random.default_rng(9)
    line = " ".join(f"l{k}" for k in range(7))
    texts = [" ".join([f"{side}{k}" for k in range(100)] + [line] * 40) for side in "ab"]
    while len(texts) < 10:
        words = [f"w{k}" for k in rng.integers(0, 1 << 40, 40)]
        copy = words[:34] + [f"x{k}" for k in rng.integers(0, 1 << 40, 6)]
        a, b = (simhash.shingle_set(" ".join(x)) for x in (words, copy))
        # Below the similarity, yet so near that bits alone would join them.
        if simhash.overlap(a, b) < 0.8 and (simhash.majority(a) ^ simhash.majority(b)).bit_count() <= 6:
            texts += [" ".join(words), " ".join(copy)]
    assert len(set(classes_of(spark, texts).values())) == len(texts)


def test_members_of_a_crowd_link_to_others(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(4000)]
    chain = [[rng.choice(vocabulary) for _ in range(200)]]
    for k in range(12):
        step = list(chain[-1])
        step[15 * k + 10] = rng.choice(vocabulary)
        chain.append(step)
    far = list(chain[-1])
    for at in (3, 50, 95, 140):
        far[at] = f"far{at}"
    texts = [" ".join(x) for x in [*chain, far]]
    assert simhash.jaccard(texts[12], texts[13]) >= 0.8 > simhash.jaccard(texts[0], texts[13])
    assert len(set(classes_of(spark, texts).values())) == 1
