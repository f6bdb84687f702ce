"""DuckDB SQL of the numbered queries that SQL can express."""

from __future__ import annotations

from maskwell.llm import license_scan


def _values(rows: list[tuple]) -> str:
    def lit(x: object) -> str:
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower()

    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


def license_sql() -> str:
    entries = [(p, label, True, p) for p, label in license_scan.BASE_PHRASES.items()]
    entries += [(name, name, False, text) for name, text in license_scan.TEMPLATES.items()]
    return f"""
WITH template(template, label, base, body) AS (VALUES {_values(entries)}),
tw AS (SELECT *, string_split(body, ' ') AS w, len(string_split(body, ' ')) - 1 AS pairs FROM template),
tp AS (
  SELECT template, label, base, pairs, t, w[t + 1] AS a, w[t + 2] AS b
  FROM (SELECT *, unnest(range(pairs)) AS t FROM tw)
),
docs AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
),
dp AS (SELECT doc_id, d, w[d + 1] AS a, w[d + 2] AS b
       FROM (SELECT doc_id, w, unnest(range(len(w) - 1)) AS d FROM docs WHERE len(w) > 1)),
hits AS (
  SELECT doc_id, template, label, base, pairs, d - t AS diagonal,
         count(DISTINCT t) AS votes, list(DISTINCT t) AS ts, min(d) AS lo, max(d) AS hi
  FROM dp JOIN tp USING (a, b) GROUP BY ALL
),
base_spans AS (SELECT doc_id, template, label, base, lo AS first_word, 1.0::DOUBLE AS coverage
               FROM hits WHERE base AND votes = pairs),
marked AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER g <= {license_scan.MAX_DRIFT} THEN 0 ELSE 1 END AS fresh
  FROM hits WHERE NOT base WINDOW g AS (PARTITION BY doc_id, template ORDER BY diagonal)
),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM marked),
merged AS (
  SELECT doc_id, template, label, base, pairs, run, len(list_distinct(flatten(list(ts)))) AS merged,
         max(votes) AS single, min(lo) AS first_word, max(hi) + 1 AS last_word
  FROM runs GROUP BY ALL
),
spans AS (
  SELECT doc_id, template, label, base, first_word,
    (CASE WHEN last_word - first_word + 1 <= 2 * (pairs + 1) THEN merged ELSE single END)::DOUBLE / pairs AS coverage
  FROM merged
),
found AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(first_word) FILTER (base) AS first_word,
    max(first_word) FILTER (base) AS last_word,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score
  FROM (SELECT * FROM base_spans UNION ALL BY NAME SELECT * FROM spans WHERE coverage >= {license_scan.MIN_COVERAGE})
  GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0)::DOUBLE AS score
FROM docs d LEFT JOIN found f ON d.doc_id = f.doc_id
"""


def _shared(level: str, above: list[str]) -> str:
    """Shares of the children of each node by weight up to capacity, as integers."""
    keys = ", ".join([*above, level])
    group = "PARTITION BY " + (", ".join(above) if above else "0")
    budget = "any_value(budget)"
    return f"""
n_{level} AS (SELECT {keys}, sum(cap)::HUGEINT AS cap, any_value(w_{level})::HUGEINT AS weight, {budget}::HUGEINT AS budget
  FROM b_{above[-1] if above else 'root'} GROUP BY {keys}),
o_{level} AS (SELECT *, CASE WHEN weight > 0 THEN cap ELSE 0 END AS c, CASE WHEN weight > 0 THEN cap / weight ELSE 0.0 END AS ratio
  FROM n_{level}),
p_{level} AS (SELECT *, coalesce(sum(c) OVER w, 0)::HUGEINT AS c_before,
    (sum(weight) OVER ({group}) - coalesce(sum(weight) OVER w, 0))::HUGEINT AS w_left
  FROM o_{level}
  WINDOW w AS ({group} ORDER BY ratio, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f_{level} AS (SELECT *, weight = 0 OR c * w_left <= weight * (budget - c_before) AS is_full FROM p_{level}),
s_{level} AS (SELECT *, budget - coalesce(sum(c) FILTER (is_full) OVER ({group}), 0)::HUGEINT AS room,
    coalesce(sum(weight) FILTER (NOT is_full) OVER ({group}), 0)::HUGEINT AS open_weight
  FROM f_{level}),
a_{level} AS (SELECT {keys}, CASE WHEN is_full THEN c ELSE weight * greatest(room, 0) // open_weight END AS alloc FROM s_{level}),
b_{level} AS (SELECT n.* EXCLUDE (budget), a.alloc AS budget
  FROM b_{above[-1] if above else 'root'} n JOIN a_{level} a USING ({keys}))"""


def mixing_sql(weights: dict[str, dict[str, int]], epochs: int, seed: int) -> str:
    def weight(level: str) -> str:
        cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in sorted(weights[level].items()))
        return f"CASE {level} {cases} ELSE 1 END" if cases else "1"

    return f"""
WITH docs AS (
  SELECT doc_id, coalesce('d' || (TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4), '') AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))::BIGINT AS n_tokens
  FROM documents
),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens FROM docs GROUP BY ALL),
weighted AS (SELECT *, {weight('domain')} AS w_domain, {weight('lang')} AS w_lang, {weight('source')} AS w_source FROM leaves),
b_root AS (SELECT *, CASE WHEN least(w_domain, w_lang, w_source) = 0 THEN 0 ELSE tokens * {epochs} END AS cap,
  (SELECT sum(tokens) FROM leaves) AS budget FROM weighted),
{_shared('domain', [])},
{_shared('lang', ['domain'])},
{_shared('source', ['domain', 'lang'])},
plan AS (SELECT domain, lang, source, budget // tokens AS epochs, budget % tokens AS rest FROM b_source WHERE tokens > 0),
placed AS (
  SELECT d.*, p.epochs, p.rest,
    ('0x' || substr(md5('{seed}:' || p.epochs || ':' || d.doc_id), 1, 8))::BIGINT AS place
  FROM docs d JOIN plan p USING (domain, lang, source)
),
summed AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY (place, doc_id, n_tokens)
    RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM placed
)
SELECT doc_id, domain, lang, source, n_tokens, (epochs + (upto <= rest)::INT)::BIGINT AS copies
FROM summed WHERE epochs + (upto <= rest)::INT > 0
"""


def sharding_sql(shards: list[str], slots: int) -> str:
    names = ", ".join(f"'{s}'" for s in shards)
    return f"""
WITH RECURSIVE shard AS (
  SELECT i - 1 AS i, name, ('0x' || substr(md5('offset:' || name), 1, 8))::BIGINT % {slots} AS at0,
    ('0x' || substr(md5('skip:' || name), 1, 8))::BIGINT % {slots - 1} + 1 AS skip
  FROM (SELECT unnest([{names}]) AS name, unnest(range(1, {len(shards) + 1})) AS i)
),
pref AS (SELECT list(at0 ORDER BY i) AS at0, list(skip ORDER BY i) AS skip FROM shard),
-- seen: how far each shard has read its order; a turn looks 64 places ahead and, if all are taken, at the whole order.
fill(turn, taken, seen, slot) AS (
  SELECT 0, repeat('0', {slots})::BIT, list_transform(range({len(shards)}), lambda x: 0::BIGINT), -1::BIGINT
  UNION ALL
  SELECT turn + 1, set_bit(taken, ((a + j * k) % {slots})::INT, 1),
    seen[:i] || [j + 1] || seen[i + 2:], (a + j * k) % {slots}
  FROM (
    SELECT *, coalesce(
      list_filter(range(first, first + 64), lambda x: get_bit(taken, ((a + x * k) % {slots})::INT) = 0)[1],
      list_filter(range({slots}), lambda x: get_bit(taken, ((a + x * k) % {slots})::INT) = 0)[1]) AS j
    FROM (SELECT turn, taken, seen, turn % {len(shards)} AS i, at0[turn % {len(shards)} + 1] AS a,
            skip[turn % {len(shards)} + 1] AS k, seen[turn % {len(shards)} + 1] AS first
          FROM fill, pref WHERE turn < {slots})
  )
),
owner AS (SELECT slot, (turn - 1) % {len(shards)} AS i FROM fill WHERE turn > 0),
keyed AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {slots} AS slot FROM documents)
SELECT k.doc_id, k.slot::BIGINT AS slot, s.name AS shard
FROM keyed k JOIN owner o ON k.slot = o.slot JOIN shard s ON s.i = o.i
"""


def exact_dedup_sql() -> str:
    return """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def filter_audit_sql() -> str:
    """Every order is run over every document."""
    return """
WITH mark AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS copy FROM documents
),
masks AS (
  SELECT part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * copy::INT AS mask,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM docs LEFT JOIN mark USING (doc_id)
),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
),
steps AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM (SELECT *, unnest(range(1, 6)) AS step FROM orders)),
counts AS (
  SELECT part, filter_order, step, bit,
    count(*) FILTER (mask & before = 0 AND mask & bit = 0) AS kept,
    count(*) FILTER (mask & before = 0 AND mask & bit <> 0) AS removed,
    count(*) FILTER (mask & before <> 0 AND mask & bit <> 0) AS redundant,
    count(*) FILTER (mask = bit) AS unique_fails,
    count(*) FILTER (mask & before = 0 AND mask & bit <> 0 AND good = 1) AS good_lost,
    count(*) FILTER (mask & before = 0 AND mask & bit <> 0 AND toxic = 1) AS toxic_lost
  FROM masks, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counts
"""


def divergence_sql() -> str:
    """Every pair of sources meets every kept term."""
    return """
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents
),
words AS (SELECT row, lang, source, unnest(w) AS term FROM docs),
terms AS (SELECT lang, term, count(*) AS n_lang FROM words GROUP BY ALL HAVING count(DISTINCT row) >= 3),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n_lang)::HUGEINT AS total FROM terms GROUP BY ALL),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN terms USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM groups g LEFT JOIN counts USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + l.v) AS p,
    1 + 1000000000::HUGEINT * (t.n_lang + 1) // (l.total + l.v) AS q
  FROM totals g JOIN langs l USING (lang) JOIN terms t USING (lang) LEFT JOIN counts c USING (lang, source, term)
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p)::BIGINT AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
),
own AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value,
  (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)))::INT AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, rank FROM (
  SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)))::INT AS rank FROM own) WHERE rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    from maskwell.llm import queries

    return {
        "op5_license_scan": license_sql(),
        "op8_mix_sources": mixing_sql(queries.MIX_WEIGHTS, queries.MIX_EPOCHS, queries.MIX_SEED),
        "op9_shard_documents": sharding_sql(queries.SHARDS, queries.SLOTS),
        "op11_exact_dedup": exact_dedup_sql(),
        "op12_filter_audit": filter_audit_sql(),
        "op13_source_divergence": divergence_sql(),
    }
