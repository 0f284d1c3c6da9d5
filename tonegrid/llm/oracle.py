"""SQL (DuckDB) for those queries whose rows SQL can express.

XXH64, CRC32, tokenizers, trained models and match offsets are beyond it; these queries are tested
against brute force.
"""

from __future__ import annotations

from . import licenses
from .queries import URL_RULES

WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w, least(len({WORDS}), 10) AS n FROM benchmark),
wanted AS (SELECT DISTINCT item, n, array_to_string(w[k : k + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM b WHERE n > 0)),
sizes AS (SELECT DISTINCT n FROM wanted),
found AS (SELECT doc_id, k, item, n FROM (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS s FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d CROSS JOIN sizes)) JOIN wanted USING (n, s)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _quoted(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _licenses() -> str:
    rows = ", ".join(f"({k}, '{t.label}', {str(t.base).lower()}, {t.offset}, {_quoted(t.phrase_words)}, {_quoted(t.words)})" for k, t in enumerate(licenses.TEMPLATES))
    firsts = _quoted(sorted({t.phrase_words[0] for t in licenses.TEMPLATES}))
    return f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
t(k, label, base, shift, phrase, notice) AS (VALUES {rows}),
places AS (SELECT doc_id, w, unnest(list_filter(range(1, len(w) + 1), lambda i: list_contains({firsts}, w[i]))) AS p FROM d),
m AS (SELECT doc_id, label, base, p - 1 - shift AS start,
  len(list_filter(range(0, len(notice)), lambda i: coalesce(CASE WHEN p - shift + i >= 1 THEN w[p - shift + i] END, '') = notice[i + 1])) / CAST(len(notice) AS DOUBLE) AS share
  FROM places JOIN t ON w[p] = phrase[1] AND w[p : p + len(phrase) - 1] = phrase),
g AS (SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS share FROM m GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN share IS NULL THEN CAST(0 AS DOUBLE) ELSE 0.5 + 0.5 * share END AS score
FROM d LEFT JOIN g USING (doc_id)"""


def _urls() -> str:
    rules = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in URL_RULES)
    return f"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), '{licenses.UPPER}', '{licenses.LOWER}') AS host, regexp_extract(rest, '/.*$') AS path FROM p),
r(rule, rule_host, rule_path, verdict) AS (VALUES {rules}),
f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM q JOIN r
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM q LEFT JOIN f USING (page_id)"""


#: Every order of the filters is walked step by step over the documents counted by flags and labels.
AUDIT = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, (CASE WHEN len(w) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END)
  || (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 'C' ELSE '' END)
  || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails FROM d),
l AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[1 : step - 1] AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, CAST(step AS INT) AS step, own,
  sum(n) FILTER (WHERE translate(fails, earlier || own, '') = fails) AS kept,
  sum(n) FILTER (WHERE contains(fails, own) AND translate(fails, earlier, '') = fails) AS removed,
  sum(n) FILTER (WHERE contains(fails, own) AND translate(fails, earlier, '') <> fails) AS redundant,
  sum(n) FILTER (WHERE fails = own) AS unique_fails,
  sum(n) FILTER (WHERE contains(fails, own) AND translate(fails, earlier, '') = fails AND good = 1) AS good_lost,
  sum(n) FILTER (WHERE contains(fails, own) AND translate(fails, earlier, '') = fails AND toxic = 1) AS toxic_lost FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""


def _field(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


#: CRC-32 of the decimal id, bit by bit: -1 is a shift.
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
  lambda i: [CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"""
MERKLE = f"""
WITH RECURSIVE l AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf('text')} AS leaf,
  CASE WHEN coalesce(({CRC} & 1) = 0, false) THEN {_leaf("replace(text, chr(10), '')")} END AS other FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM l),
n AS (SELECT tree, 0 AS level, place, leaf AS digest FROM p
  UNION ALL SELECT tree, level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS nodes FROM n) WHERE nodes > 1 GROUP BY tree, level, place // 3),
s AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS seat FROM (SELECT tree, arg_max(digest, level) AS digest FROM n GROUP BY tree)),
m AS (SELECT 0 AS level, seat, subroot AS digest FROM s
  UNION ALL SELECT level + 1, seat // 3, sha256(string_agg(digest, '' ORDER BY seat)) FROM (SELECT *, count(*) OVER () AS nodes FROM m) WHERE nodes > 1 GROUP BY level, seat // 3),
r AS (SELECT arg_max(digest, level) AS root, max(level) AS height FROM m),
h AS (SELECT tree, max(level) AS height FROM n GROUP BY tree),
u AS (SELECT doc_id, leaf, p.tree, p.place, n.level, string_agg(n.digest, '' ORDER BY n.place) FILTER (WHERE n.place < p.place // CAST(3 ** n.level AS BIGINT)) AS before,
    string_agg(n.digest, '' ORDER BY n.place) FILTER (WHERE n.place > p.place // CAST(3 ** n.level AS BIGINT)) AS after
  FROM p JOIN h USING (tree) JOIN n ON n.tree = p.tree AND n.level < h.height AND n.place // 3 = p.place // CAST(3 ** (n.level + 1) AS BIGINT) GROUP BY ALL),
v AS (SELECT tree, m.level, string_agg(m.digest, '' ORDER BY m.seat) FILTER (WHERE m.seat < s.seat // CAST(3 ** m.level AS BIGINT)) AS before,
    string_agg(m.digest, '' ORDER BY m.seat) FILTER (WHERE m.seat > s.seat // CAST(3 ** m.level AS BIGINT)) AS after
  FROM s, r, m WHERE m.level < r.height AND m.seat // 3 = s.seat // CAST(3 ** (m.level + 1) AS BIGINT) GROUP BY ALL),
w AS (SELECT tree, list(coalesce(before, '') || '|' || coalesce(after, '') ORDER BY level) AS steps FROM v GROUP BY tree),
o AS (SELECT tree, place, list(coalesce(before, '') || '|' || coalesce(after, '') ORDER BY level) AS steps FROM u GROUP BY tree, place),
f AS (SELECT p.doc_id, p.leaf, s.subroot, r.root, p.other, list_concat(coalesce(o.steps, []), coalesce(w.steps, [])) AS steps
  FROM p JOIN s USING (tree) CROSS JOIN r LEFT JOIN o ON o.tree = p.tree AND o.place = p.place LEFT JOIN w ON w.tree = p.tree),
g AS (SELECT *, list_reduce(list_prepend(coalesce(other, leaf), steps), lambda d, s: sha256(split_part(s, '|', 1) || d || split_part(s, '|', 2))) AS folded_root FROM f)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM g"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": DECONTAMINATION, "op4_licenses": _licenses(), "op8_urls": _urls(), "op11_filter_audit": AUDIT, "op12_merkle": MERKLE}
