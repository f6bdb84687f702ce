import pytest

from maskwell.functions.crypto import derive_key, encrypt
from maskwell.operators import explain, store
from pyspark.sql import functions as F

CAPTURES = [("a", "messages", "passed", True), ("b", "messages", "passed", False), ("c", "chat", None, False), ("d", "chat", "blocked", None)]
HOPS = [("a", 0, "user", "Ask Lena Vogel, not Lena"), ("b", 0, "user", None), ("b", 1, "assistant", "To Lena"), ("c", 0, "user", "Lena")]
PAIRS = [("a", "Lena", "Ina"), ("a", "Lena Vogel", "Ina Amsel"), ("a", "Lena", "Ina"), ("b", "Lena", "Ina"), ("c", "Lena", "Ina")]
REPLAYED = [("a", 0, "exact", 4, 14), ("a", 0, "exact", 4, 14), ("b", 1, "fuzzy", 3, 7)]


def made(spark, leaked=(), differ=(), captures=CAPTURES):
    frames = (
        (captures, "capture_id string, endpoint string, outcome string, adjudicated boolean"),
        (HOPS, "capture_id string, hop int, kind string, text string"),
        (PAIRS, "capture_id string, real string, surrogate string"),
        (list(leaked), "capture_id string, real string, surrogate string"),
        (list(differ), "capture_id string, surrogate string, severity string"),
        (REPLAYED, "capture_id string, hop int, pass_name string, s int, e int"),
    )
    lines = explain.report_lines(*(spark.createDataFrame(rows, schema) for rows, schema in frames))
    return {r.capture_id: r.report.split("\n") for r in explain.reports(lines).collect()}


def test_reports_mark_values_and_tell_what_did_not_run(spark):
    got = made(spark)
    assert got["a"] == [
        "capture a: messages",
        "hop 0 (user): Ask [Lena Vogel -> Ina Amsel], not [Lena -> Ina]",
        "  reconstructed by exact at 4-14: Lena Vogel",
        "summary: outcome passed, 2 values injected, 0 leaks",
        "  comparison: no divergence",
    ]
    assert got["b"] == [
        "capture b: messages",
        "hop 0 (user): ",
        "hop 1 (assistant): To [Lena -> Ina]",
        "  reconstructed by fuzzy at 3-7: Lena",
        "summary: outcome passed, 1 values injected, 0 leaks",
        "  note: no adjudicator took part in the replay",
        "  comparison: no divergence",
    ]
    assert got["c"] == ["capture c: in flight, no footer yet, nothing to compare"]
    assert got["d"][-1] == "  comparison: not run, there is no reconstructed section"
    assert made(spark, captures=[]) == {}


def test_only_leaks_and_defects_raise_the_banner_and_it_names_no_value(spark):
    got = made(spark, [("b", "Lena", None), ("a", "Lena", "Ina"), ("c", "Lena", "Ina")], [("a", "Ina", "defect"), ("b", "X", "expected"), ("d", "Y", "defect")])
    assert got["a"][:2] == ["MISMATCH: 1 leaks: Ina", "MISMATCH: 1 defects: Ina"]
    assert got["a"][-1] == "  divergence defect: Ina"
    assert got["b"][0].startswith("MISMATCH: 1 leaks: hash:") and "Lena" not in got["b"][0]
    assert got["b"][-1] == "  divergence expected: X"
    assert [line for c in "cd" for line in got[c] if line.startswith("MISMATCH")] == []


def test_a_store_with_a_plain_cell_is_refused(spark):
    key = derive_key(b"k", "cipher")
    rows = spark.createDataFrame([("w", 0, "Lena"), ("w", 1, None)], "workspace string, entity_id int, name string")
    good = rows.withColumn("cell", encrypt(F.col("name"), key, F.col("workspace")))
    assert store.encrypted_only(good, "names").count() == 2
    with pytest.raises(Exception, match="store names holds plain cells"):
        store.encrypted_only(good.withColumn("cell", F.coalesce("name", "cell")), "names").collect()
