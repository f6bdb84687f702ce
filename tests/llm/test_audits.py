"""Exact dedup by perfect hashing, filter audit and divergence: odd rows against plain Python."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwell.llm import digest_index, divergence, filter_audit
from maskwell.shared import materialize, new_path

FILLER = " ".join(f"w{k}" for k in range(60))
ROWS = [
    (1, FILLER, "en", "a"),
    (1, FILLER, "en", "a"),
    (2, FILLER, "en", "b"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (None, FILLER, "de", "a"),
    (None, None, "de", None),
    (5, "CAPS AND $ signs " * 30, "en", "b"),
    (6, "same same same " * 40, "de", "a"),
    (7, "é É ÀB KK ab" * 3 + " tail", "de", "b"),
    (8, "\x0b\x1c x \x85 y z " * 20, "de", "b"),
    (9, "long " * 60_000, "fr", "c"),
    (10, "!!! 123", "fr", "d"),
    (11, "Ab ab aB zz", "en", "c"),
    (12, "ab zz", "en", "c"),
    (13, "ab zz q", "en", ""),
    (14, "ab zz zz zz zz zz zz", "en", None),
    (15, "CAPS AND $ signs " * 30, "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def frame(spark, rows):
    clash = {"part": F.lit(1), "mask": F.lit("m"), "digest": F.lit(2), "n": F.lit(3), "term": F.lit(4), "id": F.lit(5), "row": F.lit(6)}
    return spark.createDataFrame(rows, SCHEMA).withColumns(clash)


def digests_of(n, seed):
    return np.random.default_rng(seed).integers(0, 256, (n, 32), dtype=np.uint8)


@pytest.mark.parametrize("n", [0, 1, 2, 700, 5000])
@pytest.mark.parametrize("levels", [1, 2, digest_index.LEVELS])
def test_perfect_hash_gives_every_digest_its_own_slot(n, levels):
    known = digests_of(n, n)
    hashed = digest_index.PerfectHash.of(known, levels)
    assert sorted(hashed.slots(known)) == list(range(n))
    strange = hashed.slots(digests_of(300, 99_999))
    assert strange.min(initial=0) >= -1 and strange.max(initial=-1) < n
    if levels == 1 and n == 700:
        assert hashed.rest


def by_text(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[text or ""].append(doc_id)
    return groups


@pytest.mark.parametrize("cut,shards,blocks", [(0, 1, 1), (5, 1, 1), (9, 3, 4), (len(ROWS), 7, 2)])
def test_exact_dedup_of_odd_rows(spark, cut, shards, blocks):
    slim = digest_index.document_digests(frame(spark, ROWS))
    known, new = (digest_index.group_digests(digest_index.document_digests(frame(spark, part))) for part in (ROWS[:cut], ROWS[cut:]))
    path = new_path(spark, "index")
    digest_index.write_index(known, path, shards)
    index, n_shards = digest_index.read_index(spark, path)
    assert n_shards == (shards if cut else 1)
    merged = materialize(digest_index.merge_groups(new, index, n_shards, blocks), "merged")
    groups = by_text(ROWS)
    want = {hashlib.sha256(t.encode()).digest(): (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}
    got = merged.collect()
    assert {bytes(r.digest): (r.winner, r.n) for r in got} == want and len(got) == len(want)
    assert sum(r.slot is not None for r in got) == len(by_text(ROWS[:cut]))

    marked = digest_index.mark_repeats(slim, merged).collect()
    rows = []
    for doc_id, text, *_ in ROWS:
        keep, size = want[hashlib.sha256((text or "").encode()).digest()]
        rows.append((doc_id, keep, size, doc_id == keep))
    assert Counter((r.id, r.keep_id, r.group_size, r.kept) for r in marked) == Counter(rows)


def test_only_texts_that_the_index_lacks_come_back(spark):
    known = digest_index.group_digests(digest_index.document_digests(frame(spark, ROWS[:5])))
    index = digest_index.build_index(known, 2)
    docs = frame(spark, ROWS)
    got = digest_index.unseen_documents(docs, index, 2)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
    assert digest_index.unseen_documents(docs.limit(0), index, 2).count() == 0


def brute_audit(rows, labels):
    first = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = defaultdict(list)
    for doc_id, text, _, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": re.search("[#$%&*|]", t) is not None,
            "E": doc_id is not None and doc_id > first[t],
        }
        docs[source or ""].append(({k for k, v in fails.items() if v}, doc_id in good, doc_id in toxic))
    out = {}
    for part, found in docs.items():
        total = Counter()
        for order in itertools.permutations("ABCDE"):
            left = found
            for step, name in enumerate(order, 1):
                out_now = [d for d in left if name in d[0]]
                left = [d for d in left if name not in d[0]]
                failing = [d for d in found if name in d[0]]
                total[name] += len(out_now)
                out[part, "".join(order), step] = [
                    len(left), len(out_now), len(failing) - len(out_now), sum(d[0] == {name} for d in found),
                    sum(d[1] for d in out_now), sum(d[2] for d in out_now), name,
                ]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = total[row[-1]]
    return out


def test_filter_audit_of_odd_rows(spark):
    marks = [(1, 1, 0), (1, 0, 1), (3, 1, 1), (5, None, 1), (9, 1, None), (None, 1, 1), (99, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumn("part", F.lit(0))
    cells = materialize(filter_audit.failure_cells(frame(spark, ROWS), labels), "cells")
    got = {(r.part, r.filter_order, r.step): list(r[3:]) for r in filter_audit.audit_orders(cells).collect()}
    assert got == brute_audit(ROWS, marks)
    assert filter_audit.audit_orders(filter_audit.failure_cells(frame(spark, []), labels)).count() == 0
    unlabelled = filter_audit.audit_orders(filter_audit.failure_cells(frame(spark, ROWS), labels.limit(0)))
    assert unlabelled.where("good_lost + toxic_lost > 0").count() == 0


def brute_divergence(rows):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        small = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", small)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
        groups.add((lang, source))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= 3]

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        def f(p, q):
            return (p - q) ** 2 // q

        p = shares(counts[lang, source])
        others = [s for x, s in groups if x == lang and s != source]
        pairs = [(s, sum(f(p[t], q[t]) for t in kept)) for s in others for q in [shares(counts[lang, s])]]
        whole = shares(sum((counts[g] for g in groups if g[0] == lang), Counter()))
        own = [(t, f(p[t], whole[t])) for t in kept if counts[lang, source][t] and p[t] > whole[t]]
        for part, items, most in (("pair", pairs, None), ("term", own, divergence.TOP_TERMS)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("held", [None, 8])
def test_divergence_of_odd_rows(spark, monkeypatch, held):
    if held:
        for name in ("HELD_TERMS", "HELD_PAIRS", "BLOCK", "PIECE"):
            monkeypatch.setattr(divergence, name, held)
    extra = [(100 + k, " ".join(f"t{'xyz'[j % 3]}{chr(97 + j)}" * (1 + (k * j) % 3) for j in range(k % 7)), "en", f"s{k % 11}") for k in range(80)]
    rows = ROWS + extra + [(None, "ab ab", "xx", "only"), (None, "ab", "xx", "only"), (2, "ab ab ab", "xx", "only")]
    got = sorted(tuple(r) for r in divergence.audit(frame(spark, rows)).collect())
    assert got == brute_divergence(rows)
    assert divergence.audit(frame(spark, [])).count() == 0


def test_shares_of_counts_beyond_long_products(spark):
    n, total = 3 * 10**12, 7 * 10**13
    row = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(10**7)).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 1) // (total + 10**7)
