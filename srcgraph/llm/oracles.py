"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

from srcgraph.llm import host_rules

EXACT = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
    sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER best = 1 AS kept, text_sha256
FROM d WINDOW best AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id)
"""

LINES = """
WITH raw AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS body,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS nth
  FROM documents),
tokens AS (
  SELECT doc_id, nth, list_transform(list_filter(string_split_regex(body, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''),
    lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t
  FROM raw),
lines AS (SELECT *, len(t) AS n, t[1:3] AS lead, greatest(len(t) - 3, 0) AS rest FROM tokens WHERE len(t) > 0),
parts AS (
  SELECT n, lead, p, least(any_value(rest), 16) AS parts,
    min(part) = max(part) AS same
  FROM (SELECT n, lead, rest, p, array_to_string(CASE WHEN rest <= 16 THEN t[4 + p:4 + p]
      ELSE t[4 + CAST(floor(rest * p / 16) AS BIGINT):3 + CAST(floor(rest * (p + 1) / 16) AS BIGINT)] END, ' ') AS part
    FROM lines, (SELECT unnest(range(16)) AS p))
  GROUP BY n, lead, p),
leaves AS (
  SELECT n, lead, count(*) FILTER (same AND p < parts) >= any_value(parts) * 0.5 AS alike FROM parts GROUP BY n, lead),
templates AS (
  SELECT doc_id, nth, CASE WHEN alike THEN concat(n, ' ', array_to_string(lead, ' '))
    ELSE concat('line ', array_to_string(t, ' ')) END AS template
  FROM lines JOIN leaves USING (n, lead)),
often AS (SELECT template FROM templates GROUP BY template HAVING count(DISTINCT doc_id) >= 20),
gone AS (SELECT doc_id, nth FROM templates JOIN often USING (template)),
kept AS (
  SELECT raw.doc_id, string_agg(body, chr(10) ORDER BY raw.nth) FILTER (gone.nth IS NULL) AS body,
    count(*) AS n_lines, count(gone.nth) AS n_dropped
  FROM raw LEFT JOIN gone ON raw.doc_id = gone.doc_id AND raw.nth = gone.nth GROUP BY raw.doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(body, '') END AS text,
  CASE WHEN text IS NULL THEN 0 ELSE n_lines END AS n_lines, n_dropped
FROM documents JOIN kept USING (doc_id)
"""

PASSAGES = """
WITH raw AS (
  SELECT doc_id, coalesce(text, '') AS own, unnest(string_split(coalesce(text, ''), chr(10))) AS body,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS nth
  FROM documents),
tokens AS (
  SELECT doc_id, own, nth, list_transform(list_filter(string_split_regex(body, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''),
    lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t
  FROM raw),
lines AS (SELECT *, len(t) AS n, t[1:3] AS lead FROM tokens WHERE len(t) > 0),
kinds AS (SELECT n, lead, t, count(DISTINCT own) AS docs FROM lines GROUP BY n, lead, t),
counts AS (
  SELECT n, lead, p, token, sum(docs) AS docs FROM (
    SELECT n, lead, docs, unnest(t[4:]) AS token, generate_subscripts(t[4:], 1) AS p FROM kinds)
  GROUP BY n, lead, p, token),
most AS (SELECT n, lead, p, token FROM counts QUALIFY row_number() OVER (PARTITION BY n, lead, p ORDER BY docs DESC, token DESC) = 1),
alike AS (
  SELECT k.n, k.lead, k.t, count(*) FILTER (k.t[m.p + 3] = m.token) >= (k.n - 3) * 0.5 AS same
  FROM kinds k JOIN most m ON m.n = k.n AND m.lead = k.lead GROUP BY k.n, k.lead, k.t),
templates AS (
  SELECT doc_id, own, nth, n, CASE WHEN coalesce(same, false) THEN concat(n, ' ', array_to_string(lead, ' '))
    ELSE concat('line ', array_to_string(t, ' ')) END AS template
  FROM lines LEFT JOIN alike USING (n, lead, t)),
often AS (SELECT template FROM templates GROUP BY template, n HAVING count(DISTINCT own) >= CASE WHEN n >= 50 THEN 3 ELSE 5 END),
gone AS (SELECT doc_id, nth FROM templates JOIN often USING (template)),
kept AS (
  SELECT raw.doc_id, string_agg(body, chr(10) ORDER BY raw.nth) FILTER (gone.nth IS NULL) AS body,
    count(*) AS n_lines, count(gone.nth) AS n_dropped
  FROM raw LEFT JOIN gone ON raw.doc_id = gone.doc_id AND raw.nth = gone.nth GROUP BY raw.doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(body, '') END AS text,
  CASE WHEN text IS NULL THEN 0 ELSE n_lines END AS n_lines, n_dropped
FROM documents JOIN kept USING (doc_id)
"""

SEARCH = """
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS t
  FROM documents),
sizes AS (SELECT doc_id, len(t) AS n FROM d WHERE len(t) > 0),
totals AS (SELECT count(*) AS n_all, sum(n)::BIGINT AS l FROM sizes),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY doc_id, term),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')) AS term
    FROM benchmark) GROUP BY item_id, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0 * n_all + 2)::DOUBLE / (2.0 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM tf, totals GROUP BY term, n_all),
scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_all) // l))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), totals
  GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER best <= 10
"""


def _leaf(text: str) -> str:
    fields = [f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
              for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(fields)})"


# Nodes of all levels of all trees, then of the tree of subroots (its group is one value); a fold climbs them again.
MERKLE = f"""
WITH RECURSIVE crc AS (
  SELECT i::UBIGINT AS i, 0 AS bits, i::UBIGINT AS v FROM range(256) r(i)
  UNION ALL SELECT i, bits + 1, xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END::UBIGINT) FROM crc WHERE bits < 8),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc WHERE bits = 8),
even AS (
  SELECT doc_id FROM documents, crc_table WHERE xor(4294967295::UBIGINT, list_reduce(
    list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::UBIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::BIGINT + 1]))) % 2 = 0),
base AS (
  SELECT doc_id, source, {_leaf('text')} AS leaf, {_leaf("replace(text, chr(10), '')")} AS changed,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY source) AS n
  FROM documents),
sources AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER () AS n_trees
  FROM (SELECT DISTINCT source FROM documents)),
leaves AS (SELECT base.*, tree, n_trees FROM base JOIN sources ON base.source IS NOT DISTINCT FROM sources.source),
low AS (
  SELECT tree, 0 AS height, place, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, height + 1, place // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY place))
  FROM low WHERE n > 1 GROUP BY tree, height, place // 3, n),
subroots AS (SELECT tree, height, digest FROM low WHERE n = 1),
high AS (
  SELECT 0 AS height, tree AS place, (SELECT count(*) FROM sources) AS n, digest FROM subroots
  UNION ALL
  SELECT height + 1, place // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY place))
  FROM high WHERE n > 1 GROUP BY height, place // 3, n),
nodes AS (
  SELECT 0 AS part, tree, height, place, digest FROM low WHERE n > 1
  UNION ALL SELECT 1, -1, height, place, digest FROM high WHERE n > 1),
steps AS (
  SELECT DISTINCT leaves.doc_id, nodes.part, nodes.height, CASE WHEN part = 0 THEN leaves.place ELSE leaves.tree END
    // CAST(pow(3, nodes.height) AS BIGINT) AS place, nodes.tree
  FROM leaves JOIN (SELECT DISTINCT part, tree, height FROM nodes) nodes ON nodes.tree IN (leaves.tree, -1)),
around AS (
  SELECT doc_id, steps.part, steps.height,
    coalesce(string_agg(digest, '' ORDER BY nodes.place) FILTER (nodes.place < steps.place), '') AS before,
    coalesce(string_agg(digest, '' ORDER BY nodes.place) FILTER (nodes.place > steps.place), '') AS after
  FROM steps JOIN nodes ON nodes.part = steps.part AND nodes.tree = steps.tree AND nodes.height = steps.height
    AND nodes.place // 3 = steps.place // 3
  GROUP BY doc_id, steps.part, steps.height),
path AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part, height) AS nth FROM around),
tampered AS (
  SELECT doc_id, tree, leaf, CASE WHEN crc32_even THEN changed ELSE leaf END AS start FROM (
    SELECT *, doc_id IN (SELECT doc_id FROM even) AS crc32_even FROM leaves)),
folds AS (
  SELECT doc_id, 0::BIGINT AS nth, start AS digest FROM tampered
  UNION ALL
  SELECT folds.doc_id, path.nth, sha256(before || digest || after) FROM folds JOIN path
    ON path.doc_id = folds.doc_id AND path.nth = folds.nth + 1),
ends AS (SELECT doc_id, arg_max(digest, nth) AS folded_root FROM folds GROUP BY doc_id),
proofs AS (SELECT doc_id, sha256(string_agg(before || after, '' ORDER BY nth)) AS proof_sha256 FROM path GROUP BY doc_id)
SELECT doc_id, leaf, subroots.digest AS subroot, r.digest AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
  folded_root, folded_root = r.digest AS verified
FROM tampered JOIN subroots USING (tree) LEFT JOIN proofs USING (doc_id) JOIN ends USING (doc_id),
  (SELECT digest FROM high WHERE n = 1) r
"""

def _host_rules() -> str:
    """The rules, limits and rates of host_rules.py in SQL."""
    rules = host_rules.RULES
    fails = ", ".join(f"100 * {a} > {limit} * {b} AS fails_{x}, 200 * {a} > {limit} * {b} AS near_{x}"
                      for x, (a, b, limit) in rules.items())
    any_ = " OR ".join(f"fails_{x}" for x in rules)
    names = [*rules, "any"]
    counts = ", ".join(f"count_if(fails_{x}) AS f_{x}" for x in names)
    totals = ", ".join(f"sum(f_{x}) / sum(n) AS m_{x}, sum(f_{x}::DOUBLE * f_{x} / n) AS q_{x}" for x in names)
    between = ", ".join(
        f"q_{x} / total - m_{x} * m_{x} - m_{x} * (1 - m_{x}) * (hosts - 1) / total AS v_{x}" for x in names)
    rates = ", ".join(
        f"CASE WHEN v_{x} <= 1e-12 THEN m_{x} ELSE (f_{x} + greatest(m_{x} * (1 - m_{x}) / v_{x} - 1, 0) * m_{x}) "
        f"/ (n + greatest(m_{x} * (1 - m_{x}) / v_{x} - 1, 0)) END AS rate_{x}" for x in names)
    broken = ", ".join(
        f"CASE WHEN rate_{x} >= {host_rules.ENFORCE} AND fails_{x} OR rate_any >= {host_rules.STRICT} AND near_{x} THEN '{x}' END"
        for x in rules)
    space = "[\\x20\\x09-\\x0D]"
    return f"""
WITH t AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '{space}+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM again) GROUP BY doc_id),
stats AS (
  SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals,
    length(text) - length(replace(text, '!', '')) AS n_marks, len(lines) AS n_lines
  FROM t LEFT JOIN repeated USING (doc_id)),
judged AS (SELECT *, {any_} AS fails_any FROM (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {fails} FROM stats)),
hosts AS (SELECT source, count(*) AS n, {counts} FROM judged GROUP BY source),
totals AS (SELECT *, {between} FROM (SELECT sum(n) AS total, count(*) AS hosts, {totals} FROM hosts)),
rates AS (SELECT source, {rates} FROM hosts, totals),
verdicts AS (
  SELECT judged.*, concat_ws(',', {broken}) AS broken FROM judged JOIN rates ON judged.source IS NOT DISTINCT FROM rates.source)
SELECT doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, broken,
  NOT base_failed AND broken = '' AS kept
FROM verdicts
"""


ORACLES: dict[str, str] = {
    "op5_exact_dedup": EXACT, "op6_line_dedup": LINES, "op6_passage_dedup": PASSAGES, "op11_term_pipeline": SEARCH,
    "op12_merkle_manifest": MERKLE, "op13_host_rules": _host_rules(),
}
