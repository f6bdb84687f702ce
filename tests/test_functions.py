import hashlib
import hmac
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwell.functions import checks, crypto, scripts, spans, words
from maskwell.operators import detect, overlap
from maskwell.plans.records import KEY, QUERIES

# Published sample numbers: valid, then with a wrong digit.
NUMBERS = [
    (checks.luhn, "4111111111111111", "4111111111111112"),
    (checks.iban, "DE89370400440532013000", "DE88370400440532013000"),
    (checks.iban, "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33"),
    (checks.german_tax_id, "86095742719", "86095742718"),
    (checks.german_pension_id, "15070649C103", "15070649C104"),
    (checks.german_health_id, "A123456780", "A123456781"),
    (checks.german_doctor_id, "123456601", "123456701"),
]


@pytest.mark.parametrize(("check", "good", "bad"), NUMBERS)
def test_check_digits(spark, check, good, bad):
    frame = spark.createDataFrame([(good, bad)], "a string, b string")
    assert frame.select(check(F.col("a")), check(F.col("b"))).first()[:] == (True, False)


def found(spark, text, kinds=None):
    frame = spark.createDataFrame([(1, text)], "id long, text string")
    return [(r.kind, r.value, r.s, r.e) for r in detect.pii_spans(frame, "id", kinds=kinds).collect()]


def test_contact_data_with_offsets_beyond_the_basic_plane(spark):
    text = "🙂 mail a.b@corp.lan or x@y.invalid, call +49 30 1234567 ID: 123456"
    for kind, value, s, e in found(spark, text):
        assert text[s:e] == value
        assert kind in ("email", "phone", "id")
    assert [v for k, v, *_ in found(spark, text, ["email"])] == ["a.b@corp.lan", "x@y.invalid"]
    assert found(spark, "") == [] and found(spark, "IDEA-123456 12345678") == []


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 8)), max_size=12))
def test_spans_kept_never_overlap_and_splice_is_exact(spark, raw):
    text = "".join(chr(97 + k % 26) for k in range(60))
    items = [(s, s + n, f"<{k}>") for k, (s, n) in enumerate(raw)]
    rows = spark.createDataFrame([(1, *i) for i in items], "id long, s int, e int, r string")
    kept = overlap.disjoint(rows, "id").groupBy("id").agg(F.collect_list(F.struct("s", "e", "r")).alias("m"))
    row = kept.select("m", spans.splice(F.lit(text), F.col("m"), "r").alias("t")).first() if items else None
    want, chosen = text, []
    for s, e, r in sorted(items, key=lambda x: (x[0] - x[1], x)):
        if all(e <= a or b <= s for a, b, _ in chosen):
            chosen.append((s, e, r))
    for s, e, r in sorted(chosen, reverse=True):
        want = want[:s] + r + want[e:]
    assert sorted(tuple(k) for k in row.m) == sorted(chosen) if items else kept.count() == 0
    assert not items or row.t == want


def test_hmac_equals_the_standard_library(spark):
    for r in QUERIES["blind_index_hmac"](spark, "/root/testdata/sf0.001").limit(50).collect():
        assert r.blind_index == hmac.new(KEY, r.canonical.encode(), hashlib.sha256).hexdigest()


def test_cells_are_bound_to_key_and_context(spark):
    frame = spark.createDataFrame([("Ünal", "w1")], "v string, w string")
    cell = crypto.encrypt(F.col("v"), KEY, F.col("w"))
    other = crypto.derive_key(b"other", "cipher")
    row = frame.select(
        crypto.decrypt(cell, KEY, F.col("w")), crypto.decrypt(cell, other, F.col("w")), crypto.decrypt(F.lit("plain"), KEY, F.col("w"))
    ).first()
    assert row[:] == ("Ünal", None, None)


def test_legal_forms_and_folding(spark):
    names = ["Kestrel GmbH & Co. KG", "Kestrel KG", "KG", "Kestrel Ltd.", "GmbH Kestrel"]
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in frame.select(words.strip_legal_form(F.col("n"))).collect()]
    assert got == ["Kestrel", "Kestrel", "KG", "Kestrel", "GmbH Kestrel"]
    assert frame.select(words.fold(F.lit("Müßiggång Łódź Ærø"))).first()[0] == "mussiggang lodz aero"
    titles = spark.createDataFrame([(w,) for w in ["Anna", "Tomás", "IBM", "GmbH", "A", "Abc1"]], "w string")
    assert [r[0] for r in titles.select(words.is_title(F.col("w"))).collect()] == [True, True, False, False, False, False]


def test_folding_of_scripts(spark):
    cases = {
        "Müller": "muller", "Straße": "strasse", "ŁÓDŹ": "lodz", "Nguyễn Văn": "nguyen van", "ﬁn Ｔｏｋｙｏ": "fin tokyo",
        "Αθήνα": "athina", "Жуков": "zhukov", "Щукин Юрий": "shchukin iurii", "שלום": "shlvm", "דוד": "dvd",
        "محمد": "mhmd", "김민준": "gimminjun", "한글": "hangeul", "タナカ ジロウ": "tanaka jirou", "さくら": "sakura",
        "გიორგი": "giorgi", "Արամ": "aram", "日本": "日本", "a日b": "a日b", "x-1_2": "x-1_2", "😀é": "😀e", "": "", "ь": "",
    }
    frame = spark.createDataFrame([(t,) for t in [*cases, None]], "t string")
    got = {r.t: r.f for r in frame.select("t", words.fold(F.col("t")).alias("f")).collect()}
    assert got == {**cases, None: None}
    assert len(words.ACCENTED) == len(words.PLAIN)


def test_hangul_syllables_read_as_their_names(spark):
    codes = list(range(scripts.HANGUL, scripts.HANGUL_END))
    rows = spark.createDataFrame([(chr(c),) for c in codes], "t string").select("t", scripts.latin(F.col("t")).alias("f")).collect()
    assert [r.f for r in sorted(rows)] == [unicodedata.name(chr(c)).removeprefix("HANGUL SYLLABLE ").lower() for c in codes]
