"""Queries on words: windows, dictionary passes, candidates and their suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.functions import words
from maskwell.functions.spans import subtract, trim_edges
from maskwell.operators import candidates, dictionary
from maskwell.plans.pii import table, texts

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
STOP = [w.lower() for w in candidates.STOPWORDS]


def _query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def _in(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


W = words.WORD


def sql_tokens(source: str, key: str) -> str:
    """CTE body of words with their places."""
    return f"""
SELECT {key}, n, word, s, (s + length(word))::INT AS e, gap FROM (
  SELECT {key}, n, word, gap, (coalesce(sum(length(gap) + length(word)) OVER (PARTITION BY {key} ORDER BY n
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(gap))::INT AS s FROM (
    SELECT {key}, i - 1 AS n, w[i] AS word, g[i] AS gap FROM (
      SELECT {key}, w, g, unnest(range(1, len(g) + 1)) AS i FROM (
        SELECT {key}, list_append(regexp_extract_all(text, '{W}'), '') AS w, string_split_regex(text, '{W}') AS g FROM {source}))))
WHERE word <> ''"""


HOPS_SQL = "hops AS (SELECT conv_id * 1000 + turn AS hop, conv_id, turn, role, text FROM conversations)"
TOKENS_SQL = f"toks AS ({sql_tokens('hops', 'hop')})"
DOC_TOKENS_SQL = f"toks AS ({sql_tokens('documents', 'doc_id')})"
TITLE = words.TITLE


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("conv_id * 1000 + turn AS hop", "conv_id", "turn", "role", "text")


def hop_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.tokens(hops(spark, sf_dir), "hop")


def _windows_sql(tokens_cte: str, key: str) -> str:
    return f"""{tokens_cte},
led AS (SELECT {key}, s, e, word, lead(word) OVER w AS w1, lead(gap) OVER w AS g1, lead(e) OVER w AS e1,
  lead(word, 2) OVER w AS w2, lead(gap, 2) OVER w AS g2, lead(e, 2) OVER w AS e2 FROM toks WINDOW w AS (PARTITION BY {key} ORDER BY n)),
wins AS (SELECT {key}, s, e, 1 AS k, word AS phrase FROM led
  UNION ALL SELECT {key}, s, e1, 2, word || ' ' || w1 FROM led WHERE regexp_full_match(g1, '[ \\t]+')
  UNION ALL SELECT {key}, s, e2, 3, word || ' ' || w1 || ' ' || w2 FROM led WHERE regexp_full_match(g1, '[ \\t]+') AND regexp_full_match(g2, '[ \\t]+'))"""


@_query("token_offsets", f"WITH {HOPS_SQL}, {TOKENS_SQL} SELECT hop, n, word, s, e FROM toks")
def token_offsets(spark, sf_dir):
    return hop_tokens(spark, sf_dir).drop("gap")


@_query("token_windows_k3", f"WITH {HOPS_SQL}, {_windows_sql(TOKENS_SQL, 'hop')} SELECT hop, s, e, k, phrase FROM wins")
def token_windows_k3(spark, sf_dir):
    return dictionary.windows(hops(spark, sf_dir), "hop", 3)


@_query("title_token_counts", f"WITH {HOPS_SQL}, {TOKENS_SQL} SELECT hop, count(*) AS n_title FROM toks WHERE regexp_matches(word, '{TITLE}') GROUP BY hop")
def title_token_counts(spark, sf_dir):
    return candidates.title_tokens(hop_tokens(spark, sf_dir)).groupBy("hop").agg(F.count("*").alias("n_title"))


@_query("stopword_filter", f"WITH {HOPS_SQL}, {TOKENS_SQL} SELECT lower(word) AS word, count(*) AS n FROM toks WHERE lower(word) NOT IN ({_in(STOP)}) GROUP BY ALL")
def stopword_filter(spark, sf_dir):
    kept = hop_tokens(spark, sf_dir).where(~F.lower("word").isin(STOP))
    return kept.groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"))


# Dictionary of the benchmark items: their first two words, their longest word and their first word.
DICT_SQL = f"""dict AS (
  SELECT item_id AS entity, item_id * 3 + j AS ord, CASE j WHEN 0 THEN w[1] || ' ' || w[2] WHEN 1 THEN list_min(list_transform(w, lambda x: (-length(x), x)))[2] ELSE w[1] END AS surface
  FROM (SELECT item_id, regexp_extract_all(text, '{W}') AS w FROM benchmark), (SELECT unnest([0, 1, 2]) AS j))"""


def benchmark_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words are shared by several items, as first names are."""
    w = words.words(F.col("text"))
    longest = F.array_min(F.transform(w, lambda x: F.struct((-F.length(x)).alias("k"), x.alias("w"))))["w"]
    items = table(spark, sf_dir, "benchmark").select(
        "item_id", F.array(F.concat_ws(" ", F.slice(w, 1, 2)), longest, F.element_at(w, 1)).alias("surfaces")
    )
    rows = items.select(F.col("item_id").alias("entity"), F.posexplode("surfaces").alias("j", "surface"))
    return rows.select("entity", (F.col("entity") * 3 + F.col("j")).alias("ord"), "surface")


def _fold_sql(x: str) -> str:
    folded = f"translate(lower({x}), '{words.ACCENTED}', '{words.PLAIN}')"
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th")):
        folded = f"replace({folded}, '{a}', '{b}')"
    return folded


def keyed_sql(source: str = "documents", key: str = "doc_id") -> str:
    """The passes apart, so that a query of one pass does not compute the others."""
    return f"""{DICT_SQL}, {_windows_sql(f"toks AS ({sql_tokens(source, key)})", key)},
phrases AS MATERIALIZED (SELECT phrase, {_fold_sql('phrase')} AS folded FROM (SELECT DISTINCT phrase FROM wins)),
ex AS (SELECT surface AS lookup, arg_min((surface, entity), ord) AS f, count(*) AS n FROM dict GROUP BY surface),
fo AS (SELECT {_fold_sql('surface')} AS lookup, arg_min((surface, entity), ord) AS f, count(*) AS n FROM dict GROUP BY 1),
hit AS (SELECT phrase, f[1] AS surface, f[2] AS entity, CASE WHEN n > 1 THEN 'first_name' ELSE 'exact' END AS pass_name FROM phrases JOIN ex ON phrase = lookup),
near AS (SELECT phrase, f[1] AS surface, f[2] AS entity, CASE WHEN n > 1 THEN 'first_name' ELSE 'normalized' END AS pass_name
  FROM phrases p JOIN fo ON folded = lookup WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.phrase = p.phrase))"""


def _shorter_sql(x: str) -> str:
    return f"list_transform(range(1, length({x}) + 1), lambda i: substr({x}, 1, i - 1) || substr({x}, i + 1))"


# Windows of one to three words, as the rule has them: any two forms within two edits share a form that is up to
# two letters shorter, and a blank is always lost.
FUZZY_SQL = f"""rest AS MATERIALIZED (SELECT phrase, folded, substr(phrase, 1, 1) AS initial, replace(folded, ' ', '') AS joined,
    length(folded) - length(replace(folded, ' ', '')) AS blanks FROM phrases
  WHERE length(phrase) >= 5 AND lower(phrase) NOT IN ({_in(STOP)}) AND folded NOT IN (SELECT lookup FROM fo)
    AND length(folded) <= (SELECT max(length(surface)) + 4 FROM dict)),
names AS MATERIALIZED (SELECT surface, entity, ord, substr(surface, 1, 1) AS initial, {_fold_sql('surface')} AS name FROM dict WHERE NOT contains(surface, ' ') AND length(surface) >= 5),
n1 AS (SELECT *, {_shorter_sql('name')} AS d1 FROM names),
n2 AS MATERIALIZED (SELECT DISTINCT surface, entity, ord, initial, name,
  unnest([name] || d1 || flatten(list_transform(d1, lambda y: {_shorter_sql('y')}))) AS k FROM n1),
r1 AS (SELECT *, CASE WHEN blanks < 2 THEN {_shorter_sql('joined')} ELSE [] END AS d1 FROM rest WHERE initial IN (SELECT initial FROM names)),
r2 AS (SELECT phrase, folded, initial,
  unnest(list_distinct([joined] || d1 || CASE WHEN blanks = 0 THEN flatten(list_transform(d1, lambda y: {_shorter_sql('y')})) ELSE [] END)) AS k FROM r1),
close AS (SELECT DISTINCT phrase, surface, entity, levenshtein(folded, name) AS dist, ord FROM r2 JOIN n2 USING (initial, k)
  WHERE levenshtein(folded, name) BETWEEN 1 AND 2),
fuzzy AS (SELECT phrase, arg_min((surface, entity), (dist, ord)) AS f FROM close GROUP BY phrase)"""
_KEYED = "SELECT * FROM hit UNION ALL SELECT * FROM near"
_FUZZY = "SELECT phrase, f[1] AS surface, f[2] AS entity, 'fuzzy' AS pass_name FROM fuzzy"


def matched_sql(passes: str, key: str = "doc_id") -> str:
    return f"matched AS (SELECT w.{key}, w.s, w.e, w.phrase, m.surface, m.entity, m.pass_name FROM wins w JOIN ({passes}) m USING (phrase))"


def l2_sql(source: str = "documents", key: str = "doc_id") -> str:
    return f"{keyed_sql(source, key)}, {FUZZY_SQL}, {matched_sql(f'{_KEYED} UNION ALL {_FUZZY}', key)}"


def kept_sql(key: str = "doc_id") -> str:
    """Greedy choice among ``matched``: longest first, then leftmost."""
    return f"""per AS (SELECT {key}, list({{'s': s, 'e': e, 'surface': surface, 'entity': entity, 'pass_name': pass_name}} ORDER BY s - e, s) AS m FROM matched GROUP BY {key}),
kept AS (SELECT {key}, list_reduce(list_transform(m, lambda x: [x]), lambda acc, y:
  CASE WHEN list_bool_or(list_transform(acc, lambda k: k.s < y[1].e AND y[1].s < k.e)) THEN acc ELSE list_concat(acc, y) END) AS m FROM per),
l2 AS (SELECT {key}, x.s AS s, x.e AS e, x.surface AS surface, x.entity AS entity, x.pass_name AS pass_name FROM (SELECT {key}, unnest(m) AS x FROM kept))"""


L2_SQL = l2_sql()
_PASS_SQL = {
    "l2_exact": f"{keyed_sql()}, {matched_sql('SELECT * FROM hit')}",
    "l2_folded": f"{keyed_sql()}, {matched_sql('SELECT * FROM near')}",
    "l2_fuzzy_le2": f"{keyed_sql()}, {FUZZY_SQL}, {matched_sql(_FUZZY)}",
    "l2_first_name_ambiguity": f"{keyed_sql()}, {matched_sql(_KEYED)}",
}


def l2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.match(texts(spark, sf_dir), benchmark_dictionary(spark, sf_dir), "doc_id", STOP)


for _name, _pass in (("l2_exact", "exact"), ("l2_folded", "normalized"), ("l2_fuzzy_le2", "fuzzy"), ("l2_first_name_ambiguity", "first_name")):

    def _run(spark, sf_dir, pass_name=_pass):
        return l2_matches(spark, sf_dir).where(F.col("pass_name") == pass_name)

    _query(_name, f"WITH {_PASS_SQL[_name]} SELECT * FROM matched WHERE pass_name = '{_pass}'")(_run)


# Letters of five scripts that read as one Latin letter each.
SCRIPTS = (
    ("abdegiklmnoprtxz", "αβδεγικλμνοπρτξζ"),
    ("abvgdezklmnoprstufy", "абвгдезклмнопрстуфы"),
    ("bdghklmnpqrstvyz", "בדגהכלמנפקרסטויז"),
    ("abdfhjklmnqrstwyz", "ابدفحجكلمنقرستويز"),
    ("abcdeghijklmnopqrstuvxz", "აბცდეგჰიძკლმნოპყრსტუვხზ"),
)


def _scripted_sql(x: str) -> str:
    cases = " ".join(f"WHEN {k} THEN translate({x}, '{a}{a.upper()}', '{b}{b}')" for k, (a, b) in enumerate(SCRIPTS))
    return f"CASE hop % {len(SCRIPTS)} {cases} END"


@_query(
    "l2_folded_scripts",
    f"""WITH {HOPS_SQL}, {keyed_sql("hops", "hop")},
written AS (SELECT hop, s, e, {_scripted_sql("phrase")} AS phrase, folded FROM wins JOIN phrases USING (phrase))
SELECT hop, s, e, phrase, f[1] AS surface, f[2] AS entity, 'normalized' AS pass_name FROM written JOIN fo ON folded = lookup
WHERE n = 1 AND phrase NOT IN (SELECT surface FROM dict)""",
)
def l2_folded_scripts(spark, sf_dir):
    """Hops written in one of five scripts meet Latin surfaces; the SQL looks for them in the Latin texts."""
    which = F.col("hop") % len(SCRIPTS)
    written = [F.when(which == k, F.translate("text", a + a.upper(), b + b)) for k, (a, b) in enumerate(SCRIPTS)]
    found = dictionary.match(hops(spark, sf_dir).withColumn("text", F.coalesce(*written)), benchmark_dictionary(spark, sf_dir), "hop", STOP)
    return found.where(F.col("pass_name") == "normalized")


@_query("l2_pass_priority", f"WITH {L2_SQL} SELECT pass_name, count(*) AS n, count(DISTINCT entity) AS n_entities FROM matched GROUP BY pass_name")
def l2_pass_priority(spark, sf_dir):
    return l2_matches(spark, sf_dir).groupBy("pass_name").agg(F.count("*").alias("n"), F.countDistinct("entity").alias("n_entities"))


@_query(
    "span_overlap_dedup",
    f"WITH {L2_SQL}, {kept_sql()} SELECT * FROM l2",
)
def span_overlap_dedup(spark, sf_dir):
    return dictionary.disjoint(l2_matches(spark, sf_dir), "doc_id")


@_query(
    "candidates_basic",
    f"""WITH {HOPS_SQL}, {TOKENS_SQL}, known AS (SELECT unnest(regexp_extract_all(text, '{W}')) AS word FROM benchmark)
SELECT hop, word, s, e FROM toks WHERE regexp_matches(word, '{TITLE}') AND word NOT IN ({_in(candidates.STOPWORDS)}) AND word NOT IN (SELECT word FROM known)""",
)
def candidates_basic(spark, sf_dir):
    """Capitalised words of all turns less stop-words and known surfaces."""
    known = table(spark, sf_dir, "benchmark").select(F.explode(words.words(F.col("text"))).alias("word"))
    titled = candidates.title_tokens(hop_tokens(spark, sf_dir)).where(~F.col("word").isin(candidates.STOPWORDS))
    return candidates.without(titled, known).select("hop", "word", "s", "e")


CONTEXT_SQL = f"""titled AS (SELECT t.hop, t.word, t.s, t.e, substr(h.text, greatest(0, t.s - 40) + 1, t.e + 40 - greatest(0, t.s - 40)) AS context,
  t.s - greatest(0, t.s - 40) AS "at" FROM toks t JOIN hops h USING (hop) WHERE regexp_matches(t.word, '{TITLE}'))"""


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    titled = candidates.title_tokens(hop_tokens(spark, sf_dir)).join(hops(spark, sf_dir).select("hop", "text"), "hop")
    return titled.select("hop", "word", "s", "e", candidates.context_of(F.col("text"), F.col("s"), F.col("e")).alias("c")).select("hop", "word", "s", "e", "c.*")


@_query("context_window_40", f'WITH {HOPS_SQL}, {TOKENS_SQL}, {CONTEXT_SQL} SELECT hop, word, s, context, "at" FROM titled')
def context_window_40(spark, sf_dir):
    return _contexts(spark, sf_dir).select("hop", "word", "s", "context", "at")


@_query(
    "verdict_cache_dedup",
    f"""WITH {HOPS_SQL}, {TOKENS_SQL}, {CONTEXT_SQL}, keyed AS (SELECT word, sha256(length(word) || ':' || word || length(context) || ':' || context || length("at"::VARCHAR) || ':' || "at") AS digest FROM titled)
SELECT digest, any_value(word) AS word, count(*) AS n_uses, length(any_value(word)) > 5 AS confirmed FROM keyed GROUP BY digest""",
)
def verdict_cache_dedup(spark, sf_dir):
    """Each distinct candidate is asked once; a rule on its length stands in for a model."""
    judged = candidates.adjudicate(_contexts(spark, sf_dir), lambda word, context: F.length(word) > 5)
    return judged.groupBy("digest").agg(F.first("word").alias("word"), F.count("*").alias("n_uses"), F.first("confirmed").alias("confirmed"))


@_query(
    "adjudication_counts",
    f"""WITH {HOPS_SQL}, {TOKENS_SQL}, t AS (SELECT hop, word FROM toks WHERE regexp_matches(word, '{TITLE}'))
SELECT hop, count(*) FILTER (ok) AS confirmed, count(*) FILTER (NOT ok) AS dismissed, count(*) AS candidates FROM (
  SELECT hop, length(word) > 7 OR word LIKE 'E%' AS ok FROM t) GROUP BY hop""",
)
def adjudication_counts(spark, sf_dir):
    """A cheap rule confirms, what it refuses goes to a second one."""
    verdict = candidates.cascade(lambda w, c: F.length(w) > 7, lambda w, c: w.startswith("E"))
    judged = candidates.adjudicate(_contexts(spark, sf_dir), verdict)
    return judged.groupBy("hop").agg(F.count_if("confirmed").alias("confirmed"), F.count_if(~F.col("confirmed")).alias("dismissed"), F.count("*").alias("candidates"))


@_query(
    "allowlist_phrase_suppression",
    f"""WITH {HOPS_SQL}, {TOKENS_SQL},
phrase AS (SELECT DISTINCT lower(w[1]) AS a, lower(w[2]) AS b FROM (SELECT regexp_extract_all(text, '{W}') AS w FROM conversations WHERE turn = 0)),
pairs AS (SELECT hop, s, lower(word) AS a, lower(lead(word) OVER w) AS b, lead(gap) OVER w AS g, lead(e) OVER w AS e FROM toks WINDOW w AS (PARTITION BY hop ORDER BY n)),
ranges AS (SELECT hop, s, e FROM pairs JOIN phrase USING (a, b) WHERE regexp_full_match(g, '\\s+'))
SELECT hop, word, s, e FROM toks t WHERE regexp_matches(word, '{TITLE}')
  AND NOT EXISTS (SELECT 1 FROM ranges r WHERE r.hop = t.hop AND t.s >= r.s AND t.e <= r.e)""",
)
def allowlist_phrase_suppression(spark, sf_dir):
    """The first two words of each conversation serve as allowed phrases."""
    w = words.words(F.col("text"))
    opening = table(spark, sf_dir, "conversations").where("turn = 0").select(F.concat_ws(" ", F.slice(w, 1, 2)).alias("phrase"))
    toks = hop_tokens(spark, sf_dir)
    ranges = candidates.phrase_ranges(toks, "hop", opening)
    return candidates.outside_ranges(candidates.title_tokens(toks), ranges, "hop").select("hop", "word", "s", "e")


CONV_TOKENS_SQL = f"{HOPS_SQL}, {TOKENS_SQL}, conv AS (SELECT h.conv_id, h.role, t.* FROM toks t JOIN hops h USING (hop))"


def _conv_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hop_tokens(spark, sf_dir).join(hops(spark, sf_dir).select("hop", "conv_id", "role"), "hop")


@_query(
    "system_confined_tokens",
    f"WITH {CONV_TOKENS_SQL} SELECT conv_id, word FROM conv WHERE regexp_matches(word, '{TITLE}') GROUP BY ALL HAVING bool_and(role = 'system')",
)
def system_confined_tokens(spark, sf_dir):
    return candidates.system_confined(_conv_tokens(spark, sf_dir), "conv_id", F.col("role") == "system")


EVIDENCE_SQL = f"""evidence AS (SELECT conv_id, replace(lower(word), 'ß', 'ss') AS folded, count(*) FILTER (regexp_matches(word, '^\\p{{Ll}}+$')) AS n_lower,
  count(*) FILTER (regexp_matches(word, '{TITLE}')) AS n_title FROM conv GROUP BY ALL HAVING n_lower > 0 OR n_title > 0)"""


@_query("case_inconsistency_evidence", f"WITH {CONV_TOKENS_SQL}, {EVIDENCE_SQL} SELECT * FROM evidence")
def case_inconsistency_evidence(spark, sf_dir):
    return candidates.case_evidence(_conv_tokens(spark, sf_dir), "conv_id")


@_query(
    "case_run_islands",
    f"""WITH {HOPS_SQL}, {TOKENS_SQL}, evidence AS (SELECT hop, replace(lower(word), 'ß', 'ss') AS folded, count(*) FILTER (regexp_matches(word, '^\\p{{Ll}}+$')) AS n_lower,
  count(*) FILTER (regexp_matches(word, '{TITLE}')) AS n_title FROM toks GROUP BY ALL),
prev AS (SELECT *, lag(word) OVER (PARTITION BY hop ORDER BY n) AS p FROM toks),
t AS (SELECT *, CASE WHEN coalesce(regexp_matches(p, '{TITLE}'), false) AND regexp_full_match(gap, '[ \\t]+') THEN 0 ELSE 1 END AS fresh FROM prev WHERE regexp_matches(word, '{TITLE}')),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY hop ORDER BY n) AS run, replace(lower(word), 'ß', 'ss') AS folded FROM t)
SELECT hop, min(s) AS s, max(e) AS e, count(*) AS n_words, bool_and(coalesce(n_lower > n_title, false)) AS suppressed FROM runs LEFT JOIN evidence USING (hop, folded) GROUP BY hop, run""",
)
def case_run_islands(spark, sf_dir):
    toks = hop_tokens(spark, sf_dir)
    return candidates.case_runs(toks, "hop", candidates.case_evidence(toks, "hop")).drop("run")


@_query("positional_noise")
def positional_noise(spark, sf_dir):
    """Look-around patterns: tested against brute force instead of SQL."""
    return candidates.positional_noise(hop_tokens(spark, sf_dir), "hop")


@_query(
    "declared_tool_components",
    "SELECT DISTINCT word FROM (SELECT unnest(list_concat([p_brand || '_' || p_name], regexp_split_to_array(p_brand || '_' || p_name, '[_.\\-]+'))) AS word FROM part) WHERE word <> ''",
)
def declared_tool_components(spark, sf_dir):
    """Brand and name of a part, joined by an underscore, serve as names of tools."""
    return candidates.declared_tools(table(spark, sf_dir, "part").selectExpr("concat(p_brand, '_', p_name) AS tool"), "tool")


@_query(
    "extent_coalescing",
    f"""WITH {HOPS_SQL}, {TOKENS_SQL}, t AS (SELECT hop, s, e, gap, CASE WHEN length(word) > 6 THEN 'person' END AS entity_type FROM toks WHERE regexp_matches(word, '{TITLE}')),
led AS (SELECT t.*, h.text, lag(t.e) OVER (PARTITION BY hop ORDER BY s) AS upto FROM t JOIN hops h USING (hop)),
runs AS (SELECT *, sum(CASE WHEN regexp_full_match(substr(text, upto + 1, s - upto), '[ \\t]+') THEN 0 ELSE 1 END) OVER (PARTITION BY hop ORDER BY s) AS run FROM led)
SELECT hop, min(s) AS s, max(e) AS e, arg_min(entity_type, s) FILTER (entity_type IS NOT NULL) AS entity_type, count(*) AS n FROM runs GROUP BY hop, run""",
)
def extent_coalescing(spark, sf_dir):
    titled = candidates.title_tokens(hop_tokens(spark, sf_dir)).select("hop", "s", "e", F.when(F.length("word") > 6, "person").alias("entity_type"))
    return candidates.coalesce_extents(titled, hops(spark, sf_dir), "hop")


@_query(
    "range_subtraction",
    """SELECT o_orderkey, a AS s, b AS e FROM (
  SELECT o_orderkey, unnest([{'a': 0, 'b': least(20, o_custkey % 30)}, {'a': o_custkey % 30 + 5, 'b': 20}]) AS p FROM orders) x, (SELECT 1) one, LATERAL (SELECT x.p.a AS a, x.p.b AS b) WHERE a < b""",
)
def range_subtraction(spark, sf_dir):
    """[0, 20) of every order less a range of five that its customer gives."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "array(struct(cast(o_custkey % 30 as int) AS s, cast(o_custkey % 30 + 5 as int) AS e)) AS r")
    return rows.select("o_orderkey", F.explode(subtract(F.lit(0), F.lit(20), F.col("r"))).alias("p")).select("o_orderkey", "p.s", "p.e")


@_query("whitespace_edge_trim", r"SELECT p_partkey, trim('  ' || p_name || ' ' || chr(10)::VARCHAR, ' ' || chr(10)) AS inner_text FROM part")
def whitespace_edge_trim(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("  "), "p_name", F.lit(" \n")).alias("t"))
    cut = trim_edges(F.col("t"), F.lit(0), F.length("t"))
    return rows.select("p_partkey", F.substring("t", cut["s"] + 1, cut["e"] - cut["s"]).alias("inner_text"))
