import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from maskwell.llm import bpe, langid, quality, queries, token_files
from maskwell.llm.queries import QUERIES
from maskwell.shared import new_path

SF = "/root/testdata/sf0.001"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def awkward_texts():
    rnd = random.Random(1)
    alphabets = ["abc ", "  \n\t a", "é ü ß日本x", "'s're'll t", "0123456789 ,", "!?'.…— a", "<|endoftext|> a", "aAéÉØø×²<|>"]
    texts = ["".join(rnd.choice(a) for _ in range(n)) for a in alphabets for n in (0, 1, 5, 40, 700)]
    texts += ["a" * 3000, " " * 2000 + "x", "\n" * 900 + " y", "don't " * 300, "x<|endoftext|>y " * 60, "日本" * 900, "🙂" * 500]
    return texts + ["".join(rnd.choice("etaoin") for _ in range(6000)), "İstanbul ΣΑΣ K ẞ", "\x0b\x1c a"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "en") for k, t in enumerate(awkward_texts())]
    rows += [(500, None, "en"), (501, "", None), (None, "hello there", "en"), (502, "a " * 9000, "de"), (502, "a " * 9000, "de")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_tree_concatenation_equals_the_library():
    library, mine = Tokenizer.from_file(BYTE), bpe.ByteBpe(BYTE)
    for text in awkward_texts():
        want = library.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == want
        for leaf in (7, 64, 400):
            assert mine.concatenate([mine.encode(p) for p in bpe._halves(text, leaf)]) == want
        assert mine.decode(want) == library.decode(want, skip_special_tokens=False) == text


def brute_op3(rows):
    library = Tokenizer.from_file(BYTE)
    out = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        listed = ",".join(map(str, ids))
        out.append((doc_id, len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_3_equals_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, QUERIES["op3_bpe_encode_decode"](spark, SF).collect()), key=str) == brute_op3(docs)


def test_long_and_odd_texts_through_spark(spark, odd):
    got = queries.with_digests(bpe.encode_documents(odd, BYTE, leaf_chars=50), BYTE)
    assert sorted(map(tuple, got.collect()), key=str) == brute_op3([(r.doc_id, r.text) for r in odd.collect()])
    assert bpe.encode_documents(odd.limit(0), BYTE).count() == 0


def brute_op4(rows):
    library, start, out = Tokenizer.from_file(WORD), 0, []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=str)


def test_query_4_equals_the_library(spark):
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(map(tuple, QUERIES["op4_token_files"](spark, SF).collect()), key=str) == brute_op4(docs)


def test_token_files_with_nulls_ties_and_lookup(spark, odd):
    path = new_path(spark, "test-tokens")
    token_files.write_token_files(odd, path, WORD)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    got = token_files.token_positions(token_files.read_token_files(spark, path))
    assert sorted(map(tuple, got.collect()), key=str) == brute_op4(ordered)
    found = token_files.read_token_files(spark, path, [3, 502])
    assert sorted(r.doc_id for r in found.collect()) == [3, 502, 502]
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()
    empty = new_path(spark, "test-tokens")
    token_files.write_token_files(odd.limit(0), empty, WORD)
    assert token_files.token_positions(token_files.read_token_files(spark, empty)).count() == 0


def test_runs_of_any_length_do_not_fill_the_cache():
    mine, library = token_files.CachedEncoder(WORD), Tokenizer.from_file(WORD)
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcd'1é日!") for _ in range(n)) for n in (1, 63, 64, 65, 5000)] + ["x" * 200_000, "ab " * 3 + "y" * 70 + " ab"]
    for text in texts:
        assert np.frombuffer(mine.encode(text), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert max(map(len, [*mine.runs, *mine.pieces])) <= 64


def test_lookups_skip_what_cannot_hold_the_id(spark):
    """Even ids over many row groups: an odd one lies within their ranges, so only the Bloom filters tell."""
    path = new_path(spark, "test-lookup")
    docs = spark.range(0, 200_000, 2).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    token_files.write_token_files(docs, path, WORD)

    def rows_read(ids):
        frame = token_files.read_token_files(spark, path, ids)
        found = frame.collect()
        scan = frame._jdf.queryExecution().executedPlan()
        while scan.children().nonEmpty():
            scan = scan.children().head()
        return len(found), scan.metrics().apply("numOutputRows").value()

    assert rows_read([1001])[0] == 0 and rows_read([1001])[1] <= 20_000
    found, read = rows_read([1000])
    assert found == 1 and read <= 20_000


def test_query_2_learns_languages_held_out(spark):
    got = QUERIES["op2_language_id"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").collect()
    assert len(rows) == truth.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def brute_language(model, text):
    total = model.log_prior.copy()
    points = [ord(c) if c.isalpha() else 0 for c in (text or "").lower()]
    padded = [0] * 2 + points + [0] * 2
    for end in range(2, len(padded)):
        for order in langid.ORDERS:
            gram = padded[end - order + 1 : end + 1]
            if any(gram):
                value = order * 0x9E3779B1 & 0xFFFFFFFF
                for c in gram:
                    value = (value ^ c) * 0x85EBCA6B & 0xFFFFFFFF
                    value ^= value >> 15
                total += model.log_prob[:, value % model.log_prob.shape[1]]
    if not any(points):
        return "und", 0.0
    return model.languages[int(total.argmax())], float(1 / np.exp(total - total.max()).sum())


def predictions(spark, model, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = langid.with_language(frame, model).orderBy("row.doc_id").collect()
    return [r.lang_pred for r in rows], [r.score for r in rows]


def test_language_scores_equal_brute_force(spark, odd):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "le chat et le chien", "fr"), (4, None, "fr")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), buckets=256)
    assert model.languages == ("de", "en", "fr")
    texts = [r.text for r in odd.collect()] + ["x" * 300_000, "123 !", "die katze"]
    names, scores = predictions(spark, model, texts)
    part = model.part(0)
    for text, name, score in zip(texts, names, scores, strict=True):
        if len(text or "") < 5000:
            want = brute_language(part, text)
            assert (name, pytest.approx(score, abs=1e-9)) == (want[0], want[1])
    out = langid.with_language(odd.withColumn("score", F.lit("x")).withColumn("row", F.lit(1)), model)
    assert out.where("row.text is null").first().lang_pred == "und"
    assert langid.keep_identified(odd, model).columns == odd.columns
    nothing = langid.train(odd.select("text", F.lit(None).alias("lang")))
    assert predictions(spark, nothing, ["a", None])[0] == ["und", "und"]
    assert langid.with_language(odd.limit(0), model).count() == 0


def test_languages_in_blocks_score_like_one_block(spark):
    rng = random.Random(5)
    rows = [(k, "".join(rng.choice("abcdefg ") for _ in range(60)), f"l{k % 7}") for k in range(70)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = [r[1] for r in rows] + [None, "12", "a b"]
    whole, blocks = (predictions(spark, langid.train(frame, buckets=64, block=b), texts) for b in (256, 3))
    assert whole[0] == blocks[0] and blocks[1] == pytest.approx(whole[1], abs=1e-12)
    # Two languages with the same texts tie: the first of them is named.
    same = spark.createDataFrame([(1, "abc", "z"), (2, "abc", "b"), (3, "xyz", "m")], "doc_id long, text string, lang string")
    assert predictions(spark, langid.train(same, buckets=64, block=1), ["abc"])[0] == ["b"]


def test_query_2_equals_brute_force(spark):
    """Counts, prior and smoothing learnt anew from the rows whose fold is not 0; nothing else enters."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    buckets, counts, docs = 1 << 14, {}, {}
    for doc_id, text, lang in rows:
        if zlib.crc32(str(doc_id).encode()) % 5 == 0 or lang is None:
            continue
        docs[lang] = docs.get(lang, 0) + 1
        table = counts.setdefault(lang, np.full(buckets, 0.5))
        padded = [0, 0] + [ord(c) if c.isalpha() else 0 for c in (text or "").lower()] + [0, 0]
        for end in range(2, len(padded)):
            for order in (1, 2, 3):
                gram = padded[end - order + 1 : end + 1]
                if any(gram):
                    value = order * 0x9E3779B1 & 0xFFFFFFFF
                    for c in gram:
                        value = (value ^ c) * 0x85EBCA6B & 0xFFFFFFFF
                        value ^= value >> 15
                    table[value % buckets] += 1
    names = tuple(sorted(docs))
    prior = np.log([docs[n] / sum(docs.values()) for n in names])
    model = langid.LanguageModel(names, prior, np.log([counts[n] / counts[n].sum() for n in names]))
    got = {r.doc_id: r for r in QUERIES["op2_language_id"](spark, SF).collect()}
    short = [r for r in rows if len(r.text or "") < 3000]
    assert len(got) == len(rows) and len(short) > 100
    for doc_id, text, _ in short:
        assert (got[doc_id].lang_pred, pytest.approx(got[doc_id].score, abs=1e-9)) == brute_language(model, text)


def test_query_2_does_not_read_what_it_must_not(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = docs.withColumns({"lang": F.when(held, "xx").otherwise(F.col("lang")), "source": F.lit("s")})
    other.write.parquet(str(tmp_path / "documents.parquet"))
    a, b = (sorted(map(tuple, QUERIES["op2_language_id"](spark, d).collect())) for d in (SF, str(tmp_path)))
    assert a == b


def test_site_posteriors_shrink_sparse_sites(spark):
    rng = np.random.default_rng(0)
    rows = [("big", "a", float(p)) for p in rng.normal(0.2, 0.05, 400)] + [("mid", "a", float(p)) for p in rng.normal(0.9, 0.05, 300)]
    rows += [("tiny", "z", 0.01), (None, None, 0.5), (None, None, 0.6)]
    frame = spark.createDataFrame(rows, "host string, path string, p double")
    priors = quality.site_priors(frame)
    host_mean, path_mean = priors.posteriors()
    got = {r.host: r for r in priors.sums.select("host", host_mean.alias("host_mean"), path_mean.alias("path_mean")).collect()}
    assert priors.mean == pytest.approx(np.mean([r[2] for r in rows]))
    assert abs(got["big"].host_mean - 0.2) < 0.02 and abs(got["mid"].host_mean - 0.9) < 0.02
    assert 0.01 < got["tiny"].path_mean < priors.mean
    assert None in got
    # Without its own document a site of one has the global mean.
    alone = priors.sums.where("host = 'tiny'").select(priors.posteriors(F.lit(0.01), 1)[1].alias("m")).first().m
    assert alone == pytest.approx(priors.mean)
    assert quality.site_priors(frame.limit(0)).sums.count() == 0


def brute_quality(docs, labels):
    """The whole query in plain Python and numpy: fit, sums, strengths, leave-one-out odds."""
    first = {}
    for doc_id, label in labels:
        if label in (0, 1) and doc_id is not None:
            first[doc_id] = min(label, first.get(doc_id, 1))
    features = [quality.surface_features(text) for _, text, *_ in docs]
    known = [k for k, d in enumerate(docs) if d[0] in first]
    x, y = np.array([features[k] for k in known]), np.array([first[docs[k][0]] for k in known], float)
    mean, scale = x.mean(axis=0), np.where(x.std(axis=0) == 0, 1, x.std(axis=0))
    z = np.clip((x - mean) / scale, -8, 8)
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(400):
        # Newton's step by its gradient and Hessian, solved for weights and bias apart.
        p = 1 / (1 + np.exp(-(z @ w + b)))
        g = np.append(z.T @ (p - y) + w, (p - y).sum() + 1e-6 * b)
        full = np.column_stack((z, np.ones(len(z))))
        h = full.T @ (full * (p * (1 - p))[:, None]) + np.diag([1.0] * len(w) + [1e-6])
        step = np.linalg.lstsq(h, g, rcond=None)[0]
        w, b = w - step[:-1], b - step[-1]
    p = [float(1 / (1 + np.exp(-(np.clip((np.array(f) - mean) / scale, -8, 8) @ w + b)))) for f in features]
    total = sum(p) / len(p)

    def strength(groups, prior):
        n = sum(len(g) for g in groups.values())
        inner = sum(sum(v * v for v in g) - sum(g) ** 2 / len(g) for g in groups.values()) / n
        outer = sum(len(g) * (sum(g) / len(g) - prior(k)) ** 2 for k, g in groups.items()) / n - inner * len(groups) / n
        return min(1e6, max(1.0, inner / outer if outer > 1e-12 else 1e6))

    hosts, paths = {}, {}
    for value, (_, _, lang, source) in zip(p, docs, strict=True):
        hosts.setdefault(source, []).append(value)
        paths.setdefault((source, lang), []).append(value)
    kh = strength(hosts, lambda k: total)
    kp = strength(paths, lambda k: (sum(hosts[k[0]]) + kh * total) / (len(hosts[k[0]]) + kh))
    out = {}
    for value, (doc_id, _, lang, source) in zip(p, docs, strict=True):
        h, q = hosts[source], paths[source, lang]
        host = (sum(h) - value + kh * total) / (len(h) - 1 + kh)
        path = (sum(q) - value + kp * host) / (len(q) - 1 + kp)
        odds = value / (1 - value) * path / (1 - path) / (total / (1 - total))
        out[doc_id] = (value, host, path, odds / (1 + odds))
    return out


def test_query_6_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect()]
    want = brute_quality(docs, labels)
    got = QUERIES["op6_quality_classifier"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.p_text, r.host_mean, r.path_mean, r.quality) == pytest.approx(want[r.doc_id], rel=1e-5, abs=1e-7)
        assert r.kept == (r.quality >= 0.5)


def test_query_6_separates_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.where("doc_id % 3 <> 0"))
    rated = quality.with_quality(docs, model).select("row.doc_id", F.col("quality").alias("rated"))
    rows = rated.join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    good, poor = ([r.rated for r in rows if r.quality == k] for k in (1, 0))
    assert np.mean([g > p for g in good for p in poor]) > 0.9
    assert np.mean([g >= 0.5 for g in good]) > 0.97
    assert QUERIES["op6_quality_classifier"](spark, sf).count() == docs.count()


def test_quality_keeps_rows_with_nulls_and_clashing_names(spark, odd):
    frame = odd.withColumns({"source": F.lit(None).cast("string"), "lang": F.lit("x"), "quality": F.lit(1), "host": F.lit(2)})
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (None, 1), (0, 1)], "doc_id long, quality int")
    model = quality.train(frame, labels)
    rated = quality.with_quality(frame, model)
    assert rated.count() == frame.count() and rated.where("quality is null or quality < 0 or quality > 1").count() == 0
    assert quality.keep_good(frame, model).columns == frame.columns
    none = quality.train(frame, labels.limit(0))
    assert {r.p_text for r in quality.with_quality(frame, none).collect()} == {0.5}
    assert quality.keep_good(frame.limit(0), model).count() == 0
