"""Rows that cannot be read, and islands of very many spans."""

import json
import random
import time

from pyspark.sql import functions as F

from maskwell.operators import captures, overlap
from maskwell.sources import payloads

GOOD = json.dumps({"system": "be brief", "messages": [{"role": "user", "content": "met Anna"}]})
DEEP = '{"messages": ' + "[" * 5000 + '"Anna"' + "]" * 5000 + "}"
NESTED = '{"messages": [{"content": [{"type": "tool_use", "input": ' + '{"a": ' * 150 + '"Anna"' + "}" * 150 + "}]}]}"


def test_payloads_that_cannot_be_read_are_one_leaf(spark):
    bodies = [GOOD, "{broken", DEEP, None, "", '"Anna"', "7", '{"messages": [{"role": "user", "content": "half \\ud800 pair"}]}', NESTED]
    frame = spark.createDataFrame(list(enumerate(bodies)), "exchange_id long, payload string")
    found = payloads.leaves(frame)
    got = {}
    for r in found.collect():
        got.setdefault(r.exchange_id, []).append((r.path, r.part, r.text))
    assert got[0] == [("$.system", "system", "be brief"), ("$.messages[0].role", None, "user"), ("$.messages[0].content", "content", "met Anna")]
    assert got[1] == [("$!", None, "{broken")] and got[2] == [("$!", None, DEEP)] and got[4] == [("$!", None, "")]
    assert got[5] == [("$", None, "Anna")] and 3 not in got and 6 not in got
    assert got[7][1] == ("$.messages[0].content", "content", "half � pair")
    assert got[8][-1][2] == "Anna" and got[8][-1][1] == "content"

    shouted = found.select("exchange_id", "leaf_no", F.upper("text").alias("text"))
    new = {r.exchange_id: r.payload for r in payloads.rebuild(frame, shouted).collect()}
    assert json.loads(new[0])["messages"][0] == {"role": "USER", "content": "MET ANNA"}
    assert [new[k] for k in (1, 2, 3, 4, 6)] == [bodies[k] for k in (1, 2, 3, 4, 6)]
    assert json.loads(new[5]) == "ANNA" and json.loads(new[7])["messages"][0]["content"] == "HALF � PAIR" and '"ANNA"' in new[8]
    part = payloads.rebuild(frame, shouted.where("exchange_id = 7 AND leaf_no = 0")).where("exchange_id = 7").first()
    assert json.loads(part.payload)["messages"][0]["content"] == "half \ud800 pair"


def test_annotation_puts_nothing_into_what_it_has_put_in(spark):
    pair = "array<struct<real:string,surrogate:string>>"
    rows = [
        ("Anna Berg met Berg", [("Berg", "B"), ("Anna Berg", "X")], "[Anna Berg -> X] met [Berg -> B]"),
        ("Berg met Anna", [("Anna", "Berg"), ("Berg", "Anna")], "[Berg -> Anna] met [Anna -> Berg]"),
        ("a.b axb", [("a.b", "$1\\"), ("a.b", "second"), ("", "e"), (None, "n"), ("axb", None)], "[a.b -> $1\\] axb"),
        ("nothing", [], "nothing"),
        ("none", None, "none"),
        (None, [("a", "b")], None),
        ("", [("a", "b")], ""),
    ]
    frame = spark.createDataFrame(rows, f"text string, injected {pair}, want string")
    for r in frame.select("want", captures.annotate(F.col("text"), F.col("injected")).alias("got")).collect():
        assert r.got == r.want


def greedy(spans):
    kept = []
    for x in spans:
        if all(x[1] <= k[0] or k[1] <= x[0] for k in kept):
            kept.append(x)
    return kept


def test_a_sweep_keeps_what_the_greedy_rule_keeps():
    rnd = random.Random(2)
    for _ in range(500):
        spans = [(s, s + rnd.randint(1, 9)) for s in (rnd.randrange(60) for _ in range(rnd.randint(0, 40)))]
        kept = overlap.sweep([s for s, _ in spans], [e for _, e in spans])
        assert [spans[k] for k in kept] == greedy(spans)


def test_an_island_of_a_hundred_thousand_spans(spark):
    n = 100_000
    rnd = random.Random(5)
    rows = [(1, s, s + rnd.randint(4, 40)) for s in range(n)] + [(2, 0, 2), (2, 1, 5), (2, 5, 6), (2, 7, 7)]
    rows += [(3, s, s + rnd.randint(1, 30)) for s in (rnd.randrange(300) for _ in range(400))]
    found = spark.createDataFrame(rows, "id long, s int, e int")
    began = time.time()
    got = {}
    for r in overlap.disjoint(found, "id").collect():
        got.setdefault(r.id, set()).add((r.s, r.e))
    assert time.time() - began < 60
    for key in (2, 3):
        assert got[key] == set(greedy(sorted({(s, e) for k, s, e in rows if k == key and s < e}, key=lambda x: (x[0] - x[1], x[0]))))
    ordered = sorted(got[1])
    assert all(a[1] <= b[0] for a, b in zip(ordered, ordered[1:])) and len(ordered) > n / 45
