import json
import random
import re

import pytest
from pyspark.sql import functions as F

from maskwell.functions import spans, words
from maskwell.operators import candidates, dictionary, minting, passes, records, rewrite
from maskwell.operators.ordinal import with_ordinal
from maskwell.sources import files, payloads
from maskwell.streaming import events, restore


def l2(spark, text, names):
    texts = spark.createDataFrame([(1, text)], "id long, text string")
    entries = [(s, e, k) for k, (s, e) in enumerate(names)]
    table = spark.createDataFrame(entries, "surface string, entity long, ord long")
    rows = dictionary.disjoint(dictionary.match(texts, table, "id", ["kastel"]), "id").collect()
    return [(text[r.s : r.e], r.entity, r.pass_name) for r in sorted(rows, key=lambda r: r.s)]


def test_dictionary_passes(spark):
    names = [("Müller", 1), ("Torwald", 2), ("Klaus Torwald", 2), ("Pastel", 3)]
    assert l2(spark, "Muller met Torwaldr and Klaus  Torwald", names) == [
        ("Muller", 1, "normalized"), ("Torwaldr", 2, "fuzzy"), ("Klaus  Torwald", 2, "exact")]
    # A part of a longer word, another first letter and a line break are no match.
    assert l2(spark, "Torwaldsberg xTorwald kastel Klaus\nTorwald", names) == [("Torwald", 2, "exact")]
    assert l2(spark, "Klaus", [("Klaus", 5), ("Klaus", 4)]) == [("Klaus", 5, "first_name")]
    assert l2(spark, "", names) == []


def test_positional_noise(spark):
    text = "Rules: the rules apply.\n- Assist the user. Then Anna met the assistant then. 1. Zebra\n2. Bold Anna"
    texts = spark.createDataFrame([(1, text)], "id long, text string")
    noise = candidates.positional_noise(dictionary.tokens(texts, "id"), "id")
    assert {r.word for r in noise.collect()} == {"Rules", "Assist", "Then", "Bold"}


def brute_positional(text):
    """Word by word from the text before it, as a reader would tell."""
    found = list(re.finditer(r"\w+", text))
    starts, listed = {}, {}
    for m in found:
        if not (m[0][0].isupper() and m[0][1:].isalpha() and m[0][1:].islower()):
            continue
        ahead = text[: m.start()]
        line = ahead.rsplit("\n", 1)[-1]
        item = re.fullmatch(r"[ \t]*([0-9]+[.)])[ \t*_]*|[ \t_]*[*+-][ \t*+_-]*", line) is not None
        bare = ahead.rstrip("\"'‘“")
        sentence = bare != bare.rstrip() and bare.rstrip().rstrip("\"'’”)]").endswith((".", "!", "?"))
        start = item or sentence or bare != ahead or not line.strip(" \t#>*+-_\"'‘“")
        starts.setdefault(m[0], []).append(start)
        listed.setdefault(m[0], []).append(item)
    words = {m[0] for m in found}
    return {w for w, s in starts.items() if all(s) and (any(listed[w]) or w.lower() in words)}


def test_positional_noise_equals_brute_force(spark):
    rnd = random.Random(3)
    parts = ["Anna", "anna", "Rule", "rule", "Then", "x", "12", "3", "Été", "été"]
    gaps = [" ", " ", " ", ". ", "! ", "? ", ".) ", "\n", "\n- ", "\n* ", "\n12. ", "\n> ", "\n# ", ' "', " “", ", ", "\n\n", ": ", "\n 3) ", ".\" "]
    texts = ["".join(rnd.choice(parts) + rnd.choice(gaps) for _ in range(rnd.randint(1, 9))) for _ in range(400)]
    texts = [rnd.choice(["", "- ", "1. ", '"', "# ", " "]) + t for t in texts]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {}
    for r in candidates.positional_noise(dictionary.tokens(frame, "id"), "id").collect():
        got.setdefault(r.id, set()).add(r.word)
    for k, t in enumerate(texts):
        assert got.get(k, set()) == brute_positional(t), t


def test_evidence_counts_prose_only(spark):
    text = "Northwind at info@northwind-x.de and https://northwind.de/a or northwind.txt; northwind-x, northwind and Northwind"
    texts = spark.createDataFrame([(1, text)], "id long, text string")
    toks = dictionary.tokens(texts, "id")
    in_prose = dictionary.tokens(texts.select("id", candidates.prose(F.col("text")).alias("text")), "id")
    got = {r.folded: (r.n_lower, r.n_title) for r in candidates.case_evidence(toks, "id", in_prose).collect()}
    assert got["northwind"] == (1, 2) and "txt" not in got


def brute_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def close(spark, names, phrases, stopwords=()):
    table = spark.createDataFrame([(s, k, k) for k, s in enumerate(names)], "surface string, entity long, ord long")
    rows = spark.createDataFrame([(p, len(p.split(" "))) for p in phrases], "phrase string, k int").withColumn("folded", words.fold(F.col("phrase")))
    return {r.phrase: r.surface for r in dictionary.close_phrases(rows, table, list(stopwords)).collect()}


def brute_close(names, phrases):
    want = {}
    for p in phrases:
        near = [(brute_edits(p, s), k, s) for k, s in enumerate(names) if p[0] == s[0] and len(p) >= 5]
        near = [x for x in near if 1 <= x[0] <= 2]
        if near:
            want[p] = min(near)[2]
    return want


def test_close_words_equal_brute_force(spark):
    rnd = random.Random(6)
    names = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(5, 8))) for _ in range(12)})
    vocabulary = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(4, 10))) for _ in range(600)} - set(names))
    want = brute_close(names, vocabulary)
    assert close(spark, names, vocabulary) == want and len(want) > 50


def test_close_windows_and_long_names_equal_brute_force(spark):
    rnd = random.Random(7)
    names = sorted({"".join(rnd.choice("abc") for _ in range(n)) for n in (5, 6, 7, 8, 17, 18, 19, 20, 21, 22, 23, 30, 64) for _ in range(3)})
    phrases = set()
    for name in names:
        for _ in range(60):
            x = list(name)
            for _ in range(rnd.randint(1, 3)):
                at, kind = rnd.randrange(len(x)), rnd.choice("dis  ")
                if kind == "d":
                    del x[at]
                else:
                    x[at : at + (kind == "s")] = [" " if kind == " " else rnd.choice("abc")]
            phrase = "".join(x)
            if re.fullmatch(r"[abc]+( [abc]+){0,2}", phrase):
                phrases.add(phrase)
    phrases = sorted(phrases - set(names))
    want = brute_close(names, phrases)
    assert close(spark, names, phrases) == want
    assert sum(" " in p for p in want) > 100 and sum(len(p) > 21 for p in want) > 100


def test_a_name_that_a_blank_cuts_is_found(spark):
    assert l2(spark, "Did Hol stein or Hols te in or Holl stein, H olstein or hol stein call?", [("Holstein", 1)]) == [
        ("Hol stein", 1, "fuzzy"), ("Hols te in", 1, "fuzzy"), ("Holl stein", 1, "fuzzy"), ("H olstein", 1, "fuzzy")]
    # A line break, three edits and a stop-word are no match; a known name of several words goes before.
    assert l2(spark, "Hol\nstein Hu l stain", [("Holstein", 1)]) == []
    assert l2(spark, "Nord Licht", [("Nordlicht", 1), ("Nord Licht", 2)]) == [("Nord Licht", 2, "exact")]
    assert l2(spark, "Nord Licht " * 3000, [("Nordlicht", 1)])[-1] == ("Nord Licht", 1, "fuzzy")
    assert l2(spark, "Kas tel kastel", [("Kastem", 1)]) == [("Kas tel", 1, "fuzzy")]


def found_values(spark, rows):
    return spark.createDataFrame([(k, kind, value, 0) for k, (kind, value) in enumerate(rows)], "id long, kind string, value string, s int")


def phones(n, start=0):
    return [("phone", f"+49 30 {k:07d}") for k in range(start, start + n)]


def test_minting_stops_where_a_pool_ends(spark):
    assert len({r.surrogate for r in minting.mint_pii(found_values(spark, phones(100)), "id").collect()}) == 100
    with pytest.raises(Exception, match="no surrogate is left of the kind phone") as failed:
        minting.mint_pii(found_values(spark, phones(130)), "id").collect()
    assert "+49 30" not in str(failed.value)
    more = {r.surrogate for r in minting.mint_pii(found_values(spark, phones(130)), "id", beyond="reserved").collect()}
    assert len(more) == 130 and "PII-RESERVED-phone-0029" in more


def minted(spark, rows, known=(), issued=None, **more):
    table = spark.createDataFrame([(v,) for v in known], "value string")
    return {(r.kind, r.value): r.surrogate for r in minting.mint_pii(found_values(spark, rows), "id", table, issued, **more).collect()}


def test_minting_skips_known_values_and_keeps_what_was_issued(spark):
    got = minted(spark, [*phones(5), ("email", "a@b.de")], ["+1-555-0100", "+1-555-0102", "pii-user-0000@maskwell.invalid", None, "+1-555-0999", "x"])
    assert sorted(got.values()) == ["+1-555-0101", "+1-555-0103", "+1-555-0104", "+1-555-0105", "+1-555-0106", "pii-user-0001@maskwell.invalid"]
    # A value of that shape is minted only if it is known to be real, and never gets itself.
    assert minted(spark, [*phones(3), ("phone", "+1-555-0103")]) == minted(spark, phones(3))
    first = minting.mint_pii(found_values(spark, [*phones(3), ("phone", "+1-555-0103")]), "id", spark.createDataFrame([("+1-555-0103",)], "value string"))
    first = spark.createDataFrame(first.collect(), first.schema)
    assert {r.value: r.surrogate for r in first.collect()}["+1-555-0103"] == "+1-555-0104"
    later = minted(spark, phones(2, 2), issued=first)
    assert later == {**{(r.kind, r.value): r.surrogate for r in first.collect()}, ("phone", "+49 30 0000003"): "+1-555-0105"}
    many = minted(spark, phones(90), [f"+1-555-{100 + k:04d}" for k in range(0, 100, 3)] + ["PII-RESERVED-phone-0001"], beyond="reserved")
    free = [f"+1-555-{100 + k:04d}" for k in range(100) if k % 3] + [f"PII-RESERVED-phone-{k:04d}" for k in range(40) if k != 1]
    assert sorted(many.values()) == sorted(free[:90])


def test_numbered_names_skip_known_values(spark):
    names = spark.createDataFrame([("person", f"n{k}") for k in range(4)] + [("term", "t")], "kind string, value string")
    pool = spark.createDataFrame([("person", 0, "Arno Ahlborn")], "kind string, position int, entry string")
    known = spark.createDataFrame([("BFP0000",), ("BFP0002",), ("BFT00",), ("other",)], "value string")
    got = {r.value: r.surrogate for r in minting.mint_names(names, pool, known, ["value"]).collect()}
    assert got == {"n0": "Arno Ahlborn", "n1": "BFP0001", "n2": "BFP0003", "n3": "BFP0004", "t": "BFT0000"}


def test_running_sums_over_blocks(spark):
    sizes = [[], [4], list(range(255)), list(range(256)), list(range(700))]
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(sizes)], "k long, x array<int>")
    for r in frame.select("k", "x", spans.running(F.col("x")).alias("got")).collect():
        assert r.got == [sum(r.x[:i]) for i in range(len(r.x))]


def test_ordinals_over_many_parts(spark):
    rows = [(("a", "b")[k % 7 == 0], (k * 37) % 1000) for k in range(1000)]
    frame = spark.createDataFrame(rows, "g string, v long").repartition(5)
    got = {(r.g, r.v): r.ordinal for r in with_ordinal(frame, ["g"], ["v"]).collect()}
    for g in "ab":
        assert [got[g, v] for v in sorted(v for k, v in rows if k == g)] == list(range(sum(k == g for k, _ in rows)))


def test_restore_suffixes_words_and_signs(spark):
    session = [(1, "Bernd Vogt", "Anna Lee", 1), (1, "Vogt", "Lee", 1), (1, "a.b+", "real", 1), (1, "Vogt", "Li", 2)]
    frame = spark.createDataFrame(session, "id long, surrogate string, real string, seq long")
    cases = {
        "Bernd Vogts Haus": "Anna Lees Haus",
        "Vogt's and Vogten": "Li's and Lien",
        "Vogtland xVogt": "Vogtland xVogt",
        "a.b+ aXb+": "real aXb+",
        "": "",
    }
    texts = spark.createDataFrame([(1, t) for t in cases], "id long, text string")
    for r in rewrite.restore(texts, "id", frame).collect():
        assert r.restored == cases[r.text]


def test_surrogates_inside_words_come_back(spark):
    texts = ["call +1 (208) 555-1177 4284896609045836.", "éa.b@example.com, a.b@example.com's and a.b@example.com+4912345678+49123456789x", "none", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    located, _ = rewrite.contact_data(docs, "id", ["email", "phone", "card"], "reserved")
    blinded = rewrite.blind(docs, "id", located)
    session = rewrite.session_of(docs, "id", located).collect()
    frame = spark.createDataFrame(session, "id long, surrogate string, real string, seq long")
    whole = rewrite.restore(blinded.selectExpr("id", "blinded AS text"), "id", frame)
    for r in whole.collect():
        assert r.restored == texts[r.id]
        assert r.id > 1 or r.text != texts[r.id]
    # Chunks of a stream, three characters each.
    for r in blinded.collect():
        back = {x.surrogate: x.real for x in session if x.id == r.id}
        held, before, pieces = "", "", []
        for at in range(0, len(r.blinded) + 1, 3):
            piece, held, before = restore.step(held, before, r.blinded[at : at + 3], back, at + 3 > len(r.blinded))
            pieces.append(piece)
        assert "".join(pieces) == texts[r.id]


def test_workers_hand_on_only_runs_near_to_a_name(spark):
    names = spark.createDataFrame([("Bernhard", 1, 0), ("Müller", 2, 1)], "surface string, entity long, ord long")
    texts = spark.createDataFrame([(1, "Bern hard and Bern hart, Mül ler. Bern zuzu, B ern hard")], "id long, text string")
    vocabulary = dictionary.vocabulary_of(texts)
    found = dictionary.near_candidates(texts, vocabulary, names, 6, 8).where("k > 1")
    assert {r.phrase for r in found.collect()} == {"Bern hard", "Bern hart", "Mül ler", "B ern hard"}


@pytest.mark.parametrize("seed", range(5))
def test_chunks_restore_like_the_whole(seed):
    rnd = random.Random(seed)
    back = {"Bernd Vogt": "Anna Lee", "Vogt": "Li", "Team Atlas": "Ops"}
    text = " ".join(rnd.choice([*back, "und", "Vogts", "Team Atlas's", "Vogtland", "Bernd"]) for _ in range(200))
    whole = restore.step("", "", text, back, True)[0]
    held, before, pieces, at = "", "", [], 0
    while at < len(text):
        n = rnd.randint(1, 9)
        piece, held, before = restore.step(held, before, text[at : at + n], back, at + n >= len(text))
        pieces.append(piece)
        at += n
    assert "".join(pieces) == whole


def test_leaks_need_whole_words(spark):
    known = spark.createDataFrame([("Anna Lee",), ("Lee",), ("C++",)], "value string")
    texts = spark.createDataFrame([(1, "Anna Lee here"), (2, "Annalee Leeds"), (3, "use C++!")], "id long, text string")
    got = {(r.id, r.value) for r in rewrite.leaks(texts, "id", "text", known).collect()}
    assert got == {(1, "Anna Lee"), (1, "Lee"), (3, "C++")}


def test_minting_skips_taken_words_and_numbers_on(spark):
    names = spark.createDataFrame([("person", f"n{k:02d}") for k in range(4)], "kind string, value string")
    pool = minting.pool_table(spark, {"person": ["Ann Berg", "Carl Dorn"]})
    known = spark.createDataFrame([("my berg",)], "value string")
    got = [r.surrogate for r in minting.mint_names(names, pool, known, ["value"]).orderBy("value").collect()]
    assert got == ["Carl Dorn", "BFP0000", "BFP0001", "BFP0002"]


def test_failures_in_a_row_and_bursts(spark):
    rows = [("a", k, ok) for k, ok in enumerate([True, False, False, False, True, False])]
    frame = spark.createDataFrame(rows, "key string, n long, ok boolean")
    got = records.failure_runs(frame, "key", ["n"], F.col("ok")).orderBy("n").collect()
    assert [r.failures for r in got] == [0, 1, 2, 3, 0, 1] and [r.healthy for r in got] == [True, True, True, False, True, True]
    times = spark.createDataFrame([("a", 0), ("a", 3), ("a", 5), ("a", 9), ("a", 11)], "key string, s long").select("key", F.timestamp_seconds("s").alias("ts"))
    assert [r.probed_at.second for r in records.probes(times, "key").orderBy("probed_at").collect()] == [0, 5, 11]


def test_payloads_of_both_dialects(spark, tmp_path):
    path = tmp_path / "requests.jsonl"
    path.write_text(
        '{"system":"s","messages":[{"role":"user","content":[{"type":"text","text":"a"},{"type":"tool_result","content":"b"}]}]}\n'
        '{"messages":[{"role":"system","content":"x"},{"role":"tool","content":"[y]"}],"tools":[{"function":{"name":"f_g","parameters":{"type":"object"}}}]}\n'
        "broken\n"
    )
    requests = payloads.read_requests(spark, str(path))
    assert sorted(r[0] for r in requests.select(payloads.dialect(F.col("payload"))).collect()) == ["chat", "messages"]
    hops = {(r.hop_index, r.hop_kind, r.text) for r in payloads.hops(requests).collect()}
    assert hops == {(0, "tool_result", "a"), (0, "system", "x"), (1, "tool_result", "[y]")}
    marked = payloads.checked_leaves(payloads.leaves(requests)).collect()
    assert {r.path for r in marked if r.forbidden} == {"$.tools[0].function.name", "$.tools[0].function.parameters.type"}


def test_captures_stop_at_the_first_broken_line(spark, tmp_path):
    (tmp_path / "c1.jsonl").write_text('{"record":"header"}\n{"record":"footer"}\n')
    (tmp_path / "c2.jsonl").write_text('{"record":"header"}\n{"rec\n{"record":"footer"}\n')
    lines = files.read_captures(spark, str(tmp_path))
    assert {(r.file, r.status, r.n_records) for r in files.capture_status(lines).collect()} == {
        ("c1.jsonl", "complete", 2), ("c2.jsonl", "in-flight", 1)}


def test_seed_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text("kind,value,variations,relation,target\nterm,T1,a; b ;,employer,X\nother,P1,,,\n")
    got = [(r.kind, r.value, r.variations) for r in files.read_seed_csv(spark, str(tmp_path / "s.csv")).collect()]
    assert got == [("term", "T1", ["a", "b"]), ("person", "P1", [])]
    (tmp_path / "b.json").write_text('{"workspace":{"slug":"w"},"persons":[{"canonical_name":"A","variations":["B"]}],"terms":[],"org_units":[],"entity_relationships":[],"role_assignments":[]}')
    bundle = files.read_bundle(spark, str(tmp_path / "b.json"))
    assert bundle["entities"].first().asDict() == {"workspace": "w", "ord": 0, "kind": "person", "canonical": "A", "variations": ["B"]}
    (tmp_path / "w.txt").write_text("# c\nthe\n\n und \nthe\n")
    assert sorted(r.word for r in files.read_word_list(spark, str(tmp_path / "w.txt")).collect()) == ["the", "und"]


def request(spark, *bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "exchange_id long, payload string")


def test_parts_of_a_request_and_what_stays(spark):
    body = {
        "system": [{"type": "text", "text": "S"}, {"type": "image", "text": "no"}],
        "messages": [
            {"role": "user", "content": "A"},
            {"role": "assistant", "content": [{"type": "tool_use", "name": "f", "input": {"q": ["B", {"type": "C"}], "n": 1}}]},
            {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "i", "content": [{"type": "text", "text": "D"}]}, "bare"]},
        ],
        "tools": [
            {"name": "f", "description": "E", "input_schema": {"type": "object", "required": ["q"], "properties": {"description": {"type": "string", "description": "F"}}}},
            {"function": {"name": "g", "description": "G", "parameters": {"description": "H"}}},
        ],
    }
    rows = payloads.leaves(request(spark, json.dumps(body), '"text"', "[]")).collect()
    assert [(r.part, r.text) for r in rows if r.part] == [
        ("system", "S"), ("content", "A"), ("content", "B"), ("content", "C"), ("content", "D"), ("tool", "E"), ("schema", "F"), ("tool", "G"), ("schema", "H")]
    new = spark.createDataFrame([(0, r.leaf_no, r.text.lower()) for r in rows if r.part], "exchange_id long, leaf_no long, text string")
    back = {r.exchange_id: r.payload for r in payloads.rebuild(request(spark, json.dumps(body), '"text"', "[]"), new).collect()}
    want = json.dumps(body)
    for x in "SABCDEFGH":
        want = want.replace(f'"{x}"', f'"{x.lower()}"')
    assert json.loads(back[0]) == json.loads(want) and back[1] == '"text"' and back[2] == "[]"


def test_answers_of_both_dialects_are_restored(spark):
    bodies = [
        {"content": [{"type": "text", "text": "Bernd Vogt and Bernd"}, {"type": "tool_use", "name": "Vogt", "input": {"Vogt": "Vogts"}}]},
        {"choices": [{"message": {"content": "Vogt", "tool_calls": [{"function": {"arguments": "Vogt"}}]}}]},
    ]
    session = spark.createDataFrame([(k, "Bernd Vogt", "Anna Lee", 0) for k in (0, 1)], "exchange_id long, surrogate string, real string, seq long")
    got = [json.loads(r.payload) for r in payloads.restore_payloads(request(spark, *map(json.dumps, bodies)), session).orderBy("exchange_id").collect()]
    assert got[0]["content"][0]["text"] == "Anna Lee and Anna" and got[0]["content"][1] == {"type": "tool_use", "name": "Vogt", "input": {"Vogt": "Lees"}}
    assert got[1]["choices"][0]["message"] == {"content": "Lee", "tool_calls": [{"function": {"arguments": "Vogt"}}]}


def test_words_of_surrogates_need_one_meaning(spark):
    rows = [(1, "Alex Brenner", "Priya Nadkarni", 0), (1, "Alex Thal", "Omar Said", 1), (1, "Werk Nord GmbH", "Kestrel", 2), (1, "BFX0001", "Zed", 3)]
    session = spark.createDataFrame(rows, "id long, surrogate string, real string, seq long")
    texts = spark.createDataFrame([(1, "Alex, Brenner, Thal, Nord, Werk Nord GmbH, BFX0001, BFX")], "id long, text string")
    assert rewrite.restore(texts, "id", session).first().restored == "Alex, Nadkarni, Said, Nord, Kestrel, Zed, BFX"


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_events_in_chunks_of_any_size(size):
    back = {"Bernd Vogt": 'Anna "Lee"', "Vogt": "Li"}
    tool = json.dumps({"q": "Bernd Vogt", "n": [1, "Vogts"]})
    raw = "".join(
        f"event: {name}\ndata: {json.dumps(data)}\n\n"
        for name, data in [
            ("message_start", {}),
            *[("content_block_delta", {"index": 0, "delta": {"type": "text_delta", "text": t}}) for t in ("I met Ber", "nd Vo", "gt's. Vogtland")],
            ("content_block_stop", {"index": 0}),
            ("content_block_start", {"index": 1, "content_block": {"type": "tool_use"}}),
            *[("content_block_delta", {"index": 1, "delta": {"type": "input_json_delta", "partial_json": tool[a : a + 5]}}) for a in range(0, len(tool), 5)],
            ("content_block_stop", {"index": 1}),
            ("message_stop", {}),
        ]
    )
    held, rows = {}, []
    for at in range(0, len(raw), size):
        rows += events.advance(held, raw[at : at + size], back)
    text = "".join(t for _, _, kind, t in rows if kind == events.TEXT)
    assert text == 'I met Anna "Lee"\'s. Vogtland' and held["stopped"]
    assert [json.loads(t) for _, _, kind, t in rows if kind == events.TOOL] == [{"q": 'Anna "Lee"', "n": [1, "Lis"]}]
    # Cut off in the middle: what is held comes out, restored.
    held = {}
    rows = events.advance(held, raw[: raw.index("gt's")], back)
    rows += events.advance(held, "", back, ended=True)
    assert "".join(t for _, _, kind, t in rows if kind == events.TEXT) == "I met Bernd Vo"
    assert events.restore_tool_json('{"q": "Vogt', back) == '{"q": "Li'


def test_layers_by_precedence(spark):
    text = "Kestrel GmbH met Priya Nadkarni, Priya and a.b@corp.lan near Kestrel"
    texts = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    names = spark.createDataFrame([("Kestrel", 7, 0)], "surface string, entity long, ord long")
    known = spark.createDataFrame([(7, "Werk", "Kestrel")], "entity long, surrogate string, canonical string")
    items = spark.createDataFrame([(1, "Priya Nadkarni", "person", "Alex Brenner"), (2, "Kestrel GmbH", "organization", "Thal AG")], "item_id long, value string, entity_type string, surrogate string")
    chosen, minted = passes.deterministic_spans(texts, "id", names, known, items, ["and", "met", "near"])
    blinded = {r.id: r.blinded for r in passes.blind_texts(texts, "id", chosen).collect()}
    assert blinded[1] == "Werk GmbH met Alex Brenner, Alex and pii-user-0000@maskwell.invalid near Werk"
    assert blinded[2] is None and blinded[3] == ""
    back = rewrite.restore(spark.createDataFrame([(1, blinded[1])], "id long, text string"), "id", passes.session_of(chosen, "id"))
    assert back.first().restored == text
    assert [r.value for r in minted.collect()] == ["a.b@corp.lan"]


def test_novel_names_of_blinded_texts(spark):
    text = "Then Zaphod Beeblebrox met Alex Brenner. They said that Marvin was there; then marvin left for Trillian Alex."
    texts = spark.createDataFrame([(1, text)], "id long, text string")
    session = spark.createDataFrame([(1, "Alex Brenner", "x y", 0)], "id long, surrogate string, real string, seq long")
    harmless = spark.createDataFrame([("They",)], "word string")
    found = passes.novel_names(texts, "id", session, harmless, [], lambda word, context: F.length(word) > 3)
    assert sorted((r.value, text[r.s : r.e]) for r in found.collect()) == [(v, v) for v in ("Marvin", "Trillian Alex", "Zaphod Beeblebrox")]
    assert passes.novel_names(texts, "id", session, harmless, [], lambda w, c: F.lit(True), deterministic_only=True).count() == 0


def test_jdbc_tables_are_read_in_ranges(spark):
    frame = None
    try:
        frame = files.read_jdbc(spark, "jdbc:none:memory", "t", "id", 0, 10, 2)
    except Exception as e:
        # No driver is at hand here: the call reaches the source and names what is missing.
        assert "driver" in str(e).lower()
    assert frame is None
