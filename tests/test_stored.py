"""Stored tables: whole versions, refused writers, replays; verdicts that outlive a run."""

import pytest
from pyspark.sql import functions as F

from maskwell.operators import stored
from maskwell.operators.stored import StaleWrite, StoredTable
from maskwell.shared import new_path

SCHEMA = "k long, workspace string, v string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def content(store):
    return sorted((tuple(r) for r in store.rows().collect()), key=str)


@pytest.fixture
def store(spark):
    rows = [(k, f"w{k % 3}", f"v{k}") for k in range(50)] + [(None, None, "nobody")]
    return StoredTable.create(table(spark, rows), new_path(spark, "store"), ["k", "workspace"], buckets=8)


def test_upserts_touch_their_buckets_and_replays_nothing(spark, store):
    updates = table(spark, [(3, "w0", "old"), (3, "w0", "new"), (100, "w1", "more"), (None, None, "somebody"), (4, "w1", "v4")])
    updates = updates.withColumn("seq", F.when(F.col("v") == "old", 0).otherwise(1))
    after = store.upserted(updates, order="seq")
    want = {(k, f"w{k % 3}"): f"v{k}" for k in range(50)} | {(3, "w0"): "new", (100, "w1"): "more", (None, None): "somebody"}
    assert {(k, w): v for k, w, v in content(after)} == want and len(content(after)) == len(want)
    moved = {b for b in after.folders if after.folders[b] != store.folders.get(b)}
    assert after.version == 2 and 1 <= len(moved) <= 3
    again = StoredTable.open(spark, store.path).upserted(updates, order="seq")
    assert again.version == 2 and content(again) == content(after)
    # Readers of an older version still see it.
    assert (3, "w0", "v3") in content(store)


def test_deletes_and_replacements(spark, store):
    gone = store.deleted(table(spark, [(k, f"w{k % 3}", "") for k in range(49)] + [(7, "w9", ""), (None, None, "")]))
    assert content(gone) == [(49, "w1", "v49")]
    assert gone.deleted(table(spark, [(7, "w9", "")])).version == gone.version
    empty = gone.replaced(table(spark, []))
    assert content(empty) == [] and empty.rows().columns == ["k", "workspace", "v"]
    assert content(empty.upserted(table(spark, [(1, "a", "b")]))) == [(1, "a", "b")]
    assert StoredTable.open(spark, store.path).version == 4


def test_a_writer_that_stops_before_the_swap_changes_nothing(spark, store, monkeypatch):
    before = content(store)

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as broken:
        broken.setattr(StoredTable, "_publish", stop)
        with pytest.raises(KeyboardInterrupt):
            store.upserted(table(spark, [(1, "w1", "half")]))
    found = StoredTable.open(spark, store.path)
    assert found.version == 1 and content(found) == before
    assert found.vacuumed() == 1 and content(StoredTable.open(spark, store.path)) == before


def test_a_second_writer_is_refused(spark, store):
    other = StoredTable.open(spark, store.path)
    store.upserted(table(spark, [(1, "w1", "first")]))
    with pytest.raises(StaleWrite):
        other.upserted(table(spark, [(2, "w2", "second")]))
    last = StoredTable.open(spark, store.path)
    assert (1, "w1", "first") in content(last) and (2, "w2", "v2") in content(last)
    assert content(last.upserted(table(spark, [(2, "w2", "second")])))[-1] is not None
    with pytest.raises(StaleWrite):
        StoredTable.create(table(spark, []), store.path, ["k"])
    with pytest.raises(FileNotFoundError):
        StoredTable.open(spark, store.path + "-none")


def test_a_vacuum_keeps_what_the_last_version_names(spark, store):
    last = store.upserted(table(spark, [(1, "w1", "x")]))
    assert last.vacuumed() == 1
    assert content(StoredTable.open(spark, store.path)) == content(last) and (1, "w1", "x") in content(last)


def test_verdicts_outlive_a_run(spark):
    rows = spark.createDataFrame([], "digest string, spans array<struct<s:int,e:int>>, used long")
    store = StoredTable.create(rows, new_path(spark, "verdicts"), ["digest"], buckets=4)
    asked = []

    def ask(unseen):
        asked.append(sorted(r.context for r in unseen.collect()))
        at = (F.instr("context", "Anna") - 1).cast("int")
        span = F.array(F.struct(at.alias("s"), (at + 4).alias("e")))
        return unseen.withColumn("spans", F.when(at >= 0, span).otherwise(F.array().cast("array<struct<s:int,e:int>>")))

    def run(store, contexts, now, most=10):
        frame = spark.createDataFrame([(k, c) for k, c in enumerate(contexts)], "id long, context string")
        store, found = stored.verdicts(store, frame, ask, F.lit(now).cast("long"), most)
        return store, {(r.id, r.context): [(x.s, x.e) for x in r.spans] for r in found.collect()}

    store, first = run(store, ["met Anna", "met Anna", "nobody", None], 1)
    assert first == {(0, "met Anna"): [(4, 8)], (1, "met Anna"): [(4, 8)], (2, "nobody"): [], (3, None): []}
    store, again = run(store, ["nobody", "met Anna"], 2)
    assert again == {(0, "nobody"): [], (1, "met Anna"): [(4, 8)]}
    assert asked == [["", "met Anna", "nobody"], []]
    # The longest unused verdict goes, and is asked again.
    store, _ = run(StoredTable.open(spark, store.path), ["Anna too"], 3, most=3)
    assert asked[-1] == ["Anna too"] and store.rows().count() == 3
    store, _ = run(store, [None], 4)
    assert asked[-1] == [""]
