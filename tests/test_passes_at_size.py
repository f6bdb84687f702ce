"""What leaves the workers in the passes over texts is what may count, and the rows are those of the plain rules."""

import random

from pyspark.sql import functions as F

from maskwell.operators import candidates, dictionary, passes


def test_words_that_workers_fold_are_no_table_and_are_matched(spark):
    names = spark.createDataFrame([("Bernhard", 1, 0), ("Иванова", 2, 1), ("Kestrel", 3, 2)], "surface string, entity long, ord long")
    said = "Bern hard met Ivanova, Ивановы and Иванова; Bérnhard, Kastrel, KESTREL, Иван ова, Bernd"
    texts = spark.createDataFrame([(1, said), (2, None), (3, "")], "id long, text string")
    assert {r.word for r in dictionary.vocabulary_of(texts).collect()} == {"Ивановы", "Иванова", "Иван", "ова"}
    found = {(r.phrase, r.entity, r.pass_name) for r in dictionary.match(texts, names, "id", ["and", "met"]).collect()}
    assert found == {
        ("Bern hard", 1, "fuzzy"), ("Ivanova", 2, "normalized"), ("Ивановы", 2, "fuzzy"), ("Иванова", 2, "exact"), ("Bérnhard", 1, "normalized"),
        ("Kastrel", 3, "fuzzy"), ("KESTREL", 3, "normalized"), ("Иван ова", 2, "fuzzy"),
    }


def test_layers_are_settled_once_where_every_name_has_a_surrogate(spark, monkeypatch):
    names = spark.createDataFrame([("Kestrel", 7, 0), ("Kestrel Nord", 8, 1), ("Falk", 9, 2)], "surface string, entity long, ord long")
    items = spark.createDataFrame([(1, "Falk Kestrel", "person", "Alex Brenner")], "item_id long, value string, entity_type string, surrogate string")
    texts = spark.createDataFrame([(1, "Falk Kestrel Nord, Kestrel and Falk Kestrel")], "id long, text string")
    calls, plain = [], dictionary.disjoint
    monkeypatch.setattr(dictionary, "disjoint", lambda *x: calls.append(x) or plain(*x))
    got = []
    for known in ([7, 8, 9], [7, 9], [8]):
        own = spark.createDataFrame([(k, f"W{k}", f"C{k}") for k in known], "entity long, surrogate string, canonical string")
        chosen, _ = passes.deterministic_spans(texts, "id", names, own, items, ["and"])
        got.append({(r.s, r.e, r.layer, r.surrogate, r.real) for r in chosen.collect()})
    first = {(0, 4, "dictionary", "W9", "C9"), (5, 17, "dictionary", "W8", "C8"), (19, 26, "dictionary", "W7", "C7"), (31, 35, "dictionary", "W9", "C9"), (36, 43, "dictionary", "W7", "C7")}
    assert got[0] == first and got[1] == {x for x in first if x[3] != "W8"} | {(5, 12, "pair", "Brenner", "Kestrel")}
    # Names without a surrogate leave their place to the items.
    assert got[2] == {x for x in first if x[3] == "W8"} | {(0, 4, "pair", "Alex", "Falk"), (19, 26, "pair", "Brenner", "Kestrel"), (31, 43, "pair", "Alex Brenner", "Falk Kestrel")}
    assert len(calls) == 2


def plain_candidates(spark, texts, session):
    """Capitalised words that are left by the rules of ``candidates``, each over a table of all words."""
    toks = dictionary.tokens(texts, "id")
    in_prose = dictionary.tokens(texts.select("id", candidates.prose(F.col("text")).alias("text")), "id")
    runs = candidates.case_runs(toks, "id", candidates.case_evidence(toks, "id", in_prose)).where("suppressed")
    titled = candidates.title_tokens(toks).where("lower(word) != 'die'")
    titled = titled.join(candidates.positional_noise(toks, "id"), ["id", "word"], "left_anti")
    titled = candidates.outside_ranges(titled, runs, "id")
    return candidates.outside_ranges(titled, passes.injected_ranges(texts, "id", session), "id")


def test_novel_names_store_no_words_and_follow_the_rules(spark, monkeypatch):
    rnd = random.Random(4)
    pieces = ["Anna", "anna", "Bernd", "Die", "Haus", "haus", "Äther", "ßig", "Ob", "ob", "x.Anna", "a.b+Anna@haus.de", "http://haus.Ob/x", "Vogt", "Vogtland", "7", "12"]
    gaps = [" ", "  ", "\t", ". ", "! ", "\n", "\n- ", "\n* ", "\n1. ", ": \"", "“ ", ", ", "-", ".\n\n", "\n# ", ") "]
    rows = [(k, "".join(rnd.choice(pieces) + rnd.choice(gaps) for _ in range(rnd.randint(0, 30)))) for k in range(300)]
    texts = spark.createDataFrame([*rows, (-1, None), (-2, "")], "id long, text string")
    session = spark.createDataFrame([(k, s) for k in range(0, 300, 2) for s in ("Vogt", "Bernd Vogt", "Anna")], "id long, surrogate string")
    stored, plain = [], passes.materialize
    monkeypatch.setattr(passes, "materialize", lambda df, name: stored.append(plain(df, name)) or stored[-1])
    none = spark.createDataFrame([], "word string")
    found = passes.novel_names(texts, "id", session, none, ["die"], lambda word, context: F.lit(True))
    want = {(r.id, r.s, r.e) for r in plain_candidates(spark, texts, session).collect()}
    got = {(r.id, r.s, r.e) for r in stored[0].select("id", "s", "e").collect()}
    assert got == want and len(want) > 200
    grown = candidates.coalesce_extents(plain_candidates(spark, texts, session).select("id", "s", "e", F.lit(None).cast("string").alias("entity_type")), texts, "id")
    assert sum(r.e - r.s for r in found.where("id % 2 = 1").collect()) == sum(r.e - r.s for r in grown.where("id % 2 = 1").collect())
    # A long text of words that are no names stores nothing.
    stored.clear()
    dull = spark.createDataFrame([(1, "so it goes " * 20_000)], "id long, text string")
    assert passes.novel_names(dull, "id", session, none, [], lambda word, context: F.lit(True)).count() == 0
    assert sum(t.count() for t in stored) == 0
