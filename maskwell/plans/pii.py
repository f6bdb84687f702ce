"""Queries on contact data: detection, minting, rewrite, restore and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.functions import words
from maskwell.operators import detect, minting, rewrite
from maskwell.shared import materialize

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Kinds that the documents hold.
KINDS = ["email", "phone", "card"]
#: A whole table holds more phone numbers than one exchange: numbering goes on in the general reserved form.
BEYOND = "reserved"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and texts; what Spark would read in fewer tasks than there are cores is dealt to all cores first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores, "doc_id") if docs.rdd.getNumPartitions() < cores else docs


def sql_matches(source: str, key: str, pattern: str, kind: str, keep: str = "true") -> str:
    """Matches of a pattern with their offsets, by the lengths of matches and gaps."""
    return f"""
SELECT {key}, '{kind}' AS kind, value, s, s + length(value)::INT AS e FROM (
  SELECT {key}, v[i] AS value, (list_sum(list_transform(g[1:i], lambda x: length(x)))
    + coalesce(list_sum(list_transform(v[1:i-1], lambda x: length(x))), 0))::INT AS s
  FROM (SELECT {key}, v, g, unnest(range(1, len(v) + 1)) AS i FROM (
    SELECT {key}, regexp_extract_all(text, '{pattern}') AS v, string_split_regex(text, '{pattern}') AS g FROM {source}))
) WHERE {keep}"""


LUHN = """(list_sum(list_transform(range(1, length(value) + 1), lambda i:
  CASE WHEN i % 2 = 0 THEN substr(reverse(value), i, 1)::INT * 2 - CASE WHEN substr(reverse(value), i, 1)::INT > 4 THEN 9 ELSE 0 END
  ELSE substr(reverse(value), i, 1)::INT END)) % 10 = 0)"""

def _digit_list(x: str) -> str:
    return f"list_transform(string_split({x}, ''), lambda c: c::INT)"


_PLAIN = "upper(regexp_replace(value, '[ \\-]', '', 'g'))"
_TURNED = f"string_split(substr({_PLAIN}, 5) || substr({_PLAIN}, 1, 4), '')"


def _digit_sums(digits: str, weights: list[int]) -> str:
    return f"list_sum(list_transform(range(1, {len(weights) + 1}), lambda i: ({digits}[i] * {weights}[i]) // 10 + ({digits}[i] * {weights}[i]) % 10))"


def _letter(at: int) -> str:
    return f"lpad((ascii(substr(value, {at}, 1)) - 64)::VARCHAR, 2, '0')"


#: Check of a match of each kind, as :data:`detect.RECOGNISERS` has them.
CHECK_SQL = {
    "card": LUHN,
    "iban": f"""regexp_full_match({_PLAIN}, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}') AND list_reduce(list_transform({_TURNED}, lambda c:
  CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END), lambda a, d: CASE WHEN d > 9 THEN (a * 100 + d) % 97 ELSE (a * 10 + d) % 97 END) = 1""",
    "de_tax": f"""len(list_distinct(string_split(substr(value, 1, 10), ''))) IN (8, 9) AND (11 - list_reduce(list_concat([10], {_digit_list('substr(value, 1, 10)')}),
  lambda a, x: CASE WHEN (a + x) % 10 = 0 THEN 10 ELSE (a + x) % 10 END * 2 % 11)) % 10 = substr(value, 11, 1)::INT""",
    "de_pension": f"({_digit_sums(_digit_list('(substr(value, 1, 8) || ' + _letter(9) + ' || substr(value, 10, 2))'), [2, 1, 2, 5, 7, 1, 2, 1, 2, 1, 2, 1])}) % 10 = substr(value, 12, 1)::INT",
    "de_health": f"({_digit_sums(_digit_list('(' + _letter(1) + ' || substr(value, 2, 8))'), [1, 2] * 5)}) % 10 = substr(value, 10, 1)::INT",
    "de_doctor": f"(10 - list_sum(list_transform(range(1, 7), lambda i: {_digit_list('value')}[i] * [4, 9, 4, 9, 4, 9][i])) % 10) % 10 = substr(value, 7, 1)::INT",
}


def found_sql(kinds: list[str], source: str = "documents", key: str = "doc_id") -> str:
    each = [sql_matches(source, key, detect.RECOGNISERS[k][0], k, CHECK_SQL.get(k, "true")) for k in kinds]
    return f"found AS ({' UNION ALL '.join(each)})"


FOUND = found_sql(KINDS)
ALL_FOUND = found_sql(list(detect.RECOGNISERS))

MINTED = """firsts AS (SELECT kind, value, min((doc_id, s)) AS f FROM found GROUP BY ALL),
minted AS (SELECT kind, value, row_number() OVER (PARTITION BY kind ORDER BY f, value) - 1 AS ordinal FROM firsts),
named AS (SELECT kind, value, ordinal, CASE kind WHEN 'email' THEN 'pii-user-' || printf('%04d', ordinal) || '@maskwell.invalid'
  WHEN 'phone' THEN CASE WHEN ordinal < 100 THEN '+1-555-' || printf('%04d', 100 + ordinal) ELSE 'PII-RESERVED-phone-' || printf('%04d', ordinal - 100) END
  ELSE 'PII-RESERVED-' || kind || '-' || printf('%04d', ordinal) END AS surrogate FROM minted)"""

# Spans of different kinds never nest in these texts unless one is longer: longest first, then leftmost.
DISJOINT = """disjoint AS (SELECT a.* FROM found a WHERE NOT EXISTS (
  SELECT 1 FROM found b WHERE a.doc_id = b.doc_id AND a.s < b.e AND b.s < a.e
    AND (b.e - b.s > a.e - a.s OR (b.e - b.s = a.e - a.s AND b.s < a.s))))"""

LOCATED = "located AS (SELECT d.doc_id, d.s, d.e, n.surrogate FROM disjoint d JOIN named n USING (kind, value))"
WOVEN = """pieces AS (SELECT l.doc_id, l.s, substr(t.text, coalesce(lag(l.e) OVER w, 0) + 1, l.s - coalesce(lag(l.e) OVER w, 0)) || l.surrogate AS piece, l.e
  FROM located l JOIN documents t USING (doc_id) WINDOW w AS (PARTITION BY l.doc_id ORDER BY l.s)),
woven AS (SELECT doc_id, string_agg(piece, '' ORDER BY s) AS head, max(e) AS upto, count(*) AS n_spans FROM pieces GROUP BY doc_id),
blinded AS (SELECT t.doc_id, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN head IS NULL THEN text ELSE head || substr(text, upto + 1) END AS blinded FROM documents t LEFT JOIN woven USING (doc_id))"""
BLINDED = f"{LOCATED}, {WOVEN}"


def _query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


@_query("l1_email_spans", f"SELECT doc_id, value, s, e FROM ({sql_matches('documents', 'doc_id', words.EMAIL, 'email')})")
def l1_email_spans(spark, sf_dir):
    return detect.pii_spans(texts(spark, sf_dir), "doc_id", kinds=["email"]).drop("kind")


@_query("l1_phone_spans", f"SELECT doc_id, value, s, e FROM ({sql_matches('documents', 'doc_id', words.PHONE, 'phone')})")
def l1_phone_spans(spark, sf_dir):
    return detect.pii_spans(texts(spark, sf_dir), "doc_id", kinds=["phone"]).drop("kind")


@_query("l1_card_luhn", f"SELECT doc_id, value, s, e FROM ({sql_matches('documents', 'doc_id', words.CARD, 'card', LUHN)})")
def l1_card_luhn(spark, sf_dir):
    return detect.pii_spans(texts(spark, sf_dir), "doc_id", kinds=["card"]).drop("kind")


_MARKED = "SELECT c_custkey, 'customer ID: ' || lpad(c_custkey::VARCHAR, 7, '0') || ' and ID-' || c_custkey || ' of ' || c_name AS text FROM customer"


@_query("l1_id_marker", f"SELECT c_custkey, value, s, e FROM ({sql_matches('(' + _MARKED + ')', 'c_custkey', words.ID_MARK, 'id')})")
def l1_id_marker(spark, sf_dir):
    """The tables hold no marked ids: texts are composed from customer rows."""
    rows = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "concat('customer ID: ', lpad(c_custkey, 7, '0'), ' and ID-', c_custkey, ' of ', c_name) AS text"
    )
    return detect.pii_spans(rows, "c_custkey", kinds=["id"]).drop("kind")


@_query(
    "l1_iban_mod97",
    """SELECT c_custkey, iban FROM (
  SELECT c_custkey, 'DE' || lpad((c_custkey % 100)::VARCHAR, 2, '0') || '5001051754073' || lpad(c_custkey::VARCHAR, 5, '0') AS iban FROM customer)
WHERE (substr(iban, 5) || '1314' || substr(iban, 3, 2))::HUGEINT % 97 = 1""",
)
def l1_iban_mod97(spark, sf_dir):
    """Account numbers composed from customer keys with a counted check number: about 1 in 97 is valid."""
    rows = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "concat('pay DE', lpad(c_custkey % 100, 2, '0'), '5001051754073', lpad(c_custkey, 5, '0'), ' now') AS text"
    )
    return detect.pii_spans(rows, "c_custkey", kinds=["iban"]).select("c_custkey", F.col("value").alias("iban"))


def _de_sql(kind: str) -> str:
    digit = "substr(v, {}, 1)::INT"
    if kind == "de_doctor":
        return f"""SELECT c_custkey, v AS value FROM (SELECT c_custkey, lpad((c_custkey * 7919 % 1000000000)::VARCHAR, 9, '0') AS v FROM customer)
WHERE (10 - (4 * ({digit.format(1)} + {digit.format(3)} + {digit.format(5)}) + 9 * ({digit.format(2)} + {digit.format(4)} + {digit.format(6)})) % 10) % 10 = {digit.format(7)}"""
    terms = " + ".join(
        digit.format(k) if k % 2 else f"(2 * {digit.format(k)} // 10 + 2 * {digit.format(k)} % 10)" for k in range(1, 11)
    )
    return f"""SELECT c_custkey, 'A' || substr(v, 3) AS value FROM (SELECT c_custkey, '01' || lpad((c_custkey * 7919 % 1000000000)::VARCHAR, 9, '0') AS v FROM customer)
WHERE ({terms}) % 10 = substr(v, 11, 1)::INT"""


@_query("l1_german_doctor_id", _de_sql("de_doctor"))
def l1_german_doctor_id(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat('no. ', lpad(c_custkey * 7919 % 1000000000, 9, '0')) AS text")
    return detect.pii_spans(rows, "c_custkey", kinds=["de_doctor"]).select("c_custkey", "value")


@_query("l1_german_health_id", _de_sql("de_health"))
def l1_german_health_id(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat('no. A', lpad(c_custkey * 7919 % 1000000000, 9, '0')) AS text")
    return detect.pii_spans(rows, "c_custkey", kinds=["de_health"]).select("c_custkey", "value")


def _composed(name: str, kind: str, value: str) -> None:
    """A query on numbers composed from customer keys: the documents hold none of their kind."""

    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"concat('no. ', {value}) AS text")
        return detect.pii_spans(rows, "c_custkey", kinds=[kind]).select("c_custkey", "value")

    source = f"(SELECT c_custkey, 'no. ' || {value} AS text FROM customer)"
    found = sql_matches(source, "c_custkey", detect.RECOGNISERS[kind][0], kind, CHECK_SQL[kind])
    _query(name, f"SELECT c_custkey, value FROM ({found})")(run)


_composed("l1_german_tax_id", "de_tax", "cast(10000000000 + c_custkey * 6700417 % 90000000000 AS string)")
_composed("l1_german_pension_id", "de_pension", "concat(lpad(cast(c_custkey * 7919 % 100000000 AS string), 8, '0'), chr(cast(65 + c_custkey % 26 AS int)), lpad(cast(c_custkey % 1000 AS string), 3, '0'))")


@_query(
    "l1_counts_by_kind",
    f"WITH {FOUND} SELECT doc_id, kind, count(DISTINCT value) AS n_values, count(*) AS n_spans FROM found GROUP BY ALL",
)
def l1_counts_by_kind(spark, sf_dir):
    return detect.counts_by_kind(detect.pii_spans(texts(spark, sf_dir), "doc_id", kinds=KINDS), "doc_id")


@_query(
    "l1_distinct_values",
    f"WITH {FOUND} SELECT kind, value, count(*) AS n_spans, min(doc_id) AS first_doc FROM found GROUP BY ALL",
)
def l1_distinct_values(spark, sf_dir):
    found = detect.pii_spans(texts(spark, sf_dir), "doc_id", kinds=KINDS)
    return found.groupBy("kind", "value").agg(F.count("*").alias("n_spans"), F.min("doc_id").alias("first_doc"))


@_query("mint_pii_ranked", f"WITH {FOUND}, {MINTED} SELECT kind, value, ordinal, surrogate FROM named")
def mint_pii_ranked(spark, sf_dir):
    return minting.mint_pii(detect.pii_spans(texts(spark, sf_dir), "doc_id", kinds=KINDS), "doc_id", beyond=BEYOND)


@_query(
    "mint_phone_pool_guard",
    f"WITH {FOUND} SELECT kind, count(DISTINCT value) AS n_values FROM found WHERE kind = 'phone' GROUP BY kind HAVING count(DISTINCT value) > 100",
)
def mint_phone_pool_guard(spark, sf_dir):
    return minting.exhausted_pools(minting.mint_pii(detect.pii_spans(texts(spark, sf_dir), "doc_id", kinds=KINDS), "doc_id", beyond=BEYOND))


@_query("blind_documents", f"WITH {FOUND}, {MINTED}, {DISJOINT}, {BLINDED} SELECT doc_id, n_spans, blinded FROM blinded")
def blind_documents(spark, sf_dir):
    """Flagship: contact data of all documents replaced by surrogates."""
    return rewrite.blind_documents(texts(spark, sf_dir), "doc_id", KINDS, BEYOND)[0].drop("text")


_WHOLE = r"'(^|[^\p{L}\p{N}_])' || regexp_escape(value) || '([^\p{L}\p{N}_]|$)'"


@_query(
    "leak_gate_violations",
    f"WITH {FOUND}, {MINTED}, {DISJOINT}, {BLINDED}, near AS MATERIALIZED (SELECT doc_id, value, blinded FROM blinded JOIN (SELECT DISTINCT value FROM named) ON contains(blinded, value)) SELECT DISTINCT doc_id, value FROM near WHERE regexp_matches(blinded, {_WHOLE})",
)
def leak_gate_violations(spark, sf_dir):
    """Known values left in blinded texts; empty when the gate passes."""
    blinded, minted = rewrite.blind_documents(texts(spark, sf_dir), "doc_id", KINDS, BEYOND)
    blinded = materialize(blinded.select("doc_id", "blinded"), "blinded")
    return rewrite.leaks(blinded, "doc_id", "blinded", minted.select("value"))


@_query(
    "leak_gate_positive_control",
    f"WITH {FOUND}, near AS MATERIALIZED (SELECT doc_id, value, text FROM documents JOIN (SELECT DISTINCT value FROM found) ON contains(text, value)) SELECT DISTINCT doc_id, value FROM near WHERE regexp_matches(text, {_WHOLE})",
)
def leak_gate_positive_control(spark, sf_dir):
    """The same gate on the original texts must find every document with a known value."""
    docs = texts(spark, sf_dir)
    known = detect.pii_spans(docs, "doc_id", kinds=KINDS).select("value").distinct()
    return rewrite.leaks(docs, "doc_id", "text", known)


@_query(
    "reserved_form_check",
    """SELECT p_partkey, form, regexp_full_match(form, '(BFX|BFR|BFP|BFT|BFO|BFK)[0-9]{4,}') AS provisional,
  regexp_full_match(form, 'ID-RESERVED-[0-9]+') AS pii FROM (
  SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'BFX' || printf('%04d', p_partkey) WHEN 1 THEN 'BFX' || p_partkey % 100
    WHEN 2 THEN 'ID-RESERVED-' || p_partkey ELSE p_name END AS form FROM part)""",
)
def reserved_form_check(spark, sf_dir):
    forms = table(spark, sf_dir, "part").selectExpr(
        "p_partkey",
        "CASE p_partkey % 4 WHEN 0 THEN concat('BFX', lpad(p_partkey, greatest(4, length(p_partkey)), '0')) WHEN 1 THEN concat('BFX', p_partkey % 100) "
        "WHEN 2 THEN concat('ID-RESERVED-', p_partkey) ELSE p_name END AS form",
    )
    return forms.select("p_partkey", "form", words.is_reserved_provisional(F.col("form")).alias("provisional"), words.is_reserved_pii(F.col("form")).alias("pii"))


@_query("round_trip_identity", "SELECT doc_id, text AS restored, true AS same FROM documents")
def round_trip_identity(spark, sf_dir):
    """Blinding, then restoring with the surrogates of each document, gives the text back."""
    docs = texts(spark, sf_dir)
    located, _ = rewrite.contact_data(docs, "doc_id", KINDS, BEYOND)
    blinded = rewrite.blind(docs, "doc_id", located)
    session = rewrite.session_of(docs, "doc_id", located)
    back = rewrite.restore(blinded.selectExpr("doc_id", "blinded AS text", "text AS original"), "doc_id", session)
    return back.select("doc_id", "restored", (F.col("restored") == F.col("original")).alias("same"))


@_query("resolution_gate_violations", "SELECT doc_id, text AS surrogate FROM documents WHERE false")
def resolution_gate_violations(spark, sf_dir):
    """Surrogates of a document left in its restored text; empty when all were resolved."""
    docs = texts(spark, sf_dir)
    located, _ = rewrite.contact_data(docs, "doc_id", KINDS, BEYOND)
    session = rewrite.session_of(docs, "doc_id", located)
    blinded = rewrite.blind(docs, "doc_id", located).selectExpr("doc_id", "blinded AS text")
    return rewrite.unresolved(rewrite.restore(blinded, "doc_id", session), "doc_id", "restored", session)


@_query(
    "phone_shaped_candidates",
    r"""SELECT doc_id, regexp_extract(part, '((\([0-9]{3}\)[ ]?|[0-9]{3}[ \-.])?[0-9]{3}-[0-9]{4})') AS value FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, '(^|[^0-9])(\([0-9]{3}\)[ ]?|[0-9]{3}[ \-.])?[0-9]{3}-[0-9]{4}')) AS part FROM documents)""",
)
def phone_shaped_candidates(spark, sf_dir):
    return detect.phone_shaped(texts(spark, sf_dir), "doc_id").select("doc_id", "value")
