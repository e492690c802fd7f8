"""DuckDB twins of the queries that SQL can express over whole tables."""

from __future__ import annotations

from sparkrecon.llm.licenses import BASE, BASE_PRIORITY, gate_stems, rules
from sparkrecon.llm.ngram_join import N
from sparkrecon.llm.rules import MAX_RATE, MIN_WORDS, Z
from sparkrecon.llm.substring_dedup import WINDOW
from sparkrecon.llm.super_minhash import PERCENT

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NGRAM_JOIN = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
), grams AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {N} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {N - 2}), lambda i: array_to_string(w[i:i + {N - 1}], ' ')) END) AS g FROM worded
), sets AS (SELECT DISTINCT doc_id, g FROM grams),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT p.a, p.b FROM pairs p JOIN sizes x ON x.doc_id = p.a JOIN sizes y ON y.doc_id = p.b
  WHERE 100 * o >= 75 * (x.n + y.n - o)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT DISTINCT a AS doc_id, a AS other FROM edges
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other
), least AS (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""

SUPER_MINHASH = NGRAM_JOIN.replace("100 * o >= 75 *", f"100 * o >= {PERCENT} *").replace(
    "SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id",
    "SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept",
)


def _host_sql() -> str:
    tests = {
        "short": f"n_words < {MIN_WORDS}",
        "repetitive": "100 * n_repeat_words > 50 * n_words",
        "symbols": "10 * n_symbols > n_words",
        "duplicate_lines": "10 * n_dup_lines > n_words",
        "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)",
    }
    sums = ", ".join(f"sum(({t})::INT)::DOUBLE AS {name}" for name, t in tests.items())
    priors, rejected = [], []
    for name in tests:
        mean = f"least(greatest(sum({name}) / sum(n), 1e-6), 1 - 1e-6)"
        spread = (
            f"greatest(sum({name} * {name} / n) / sum(n) - {mean} * {mean} - {mean} * (1 - {mean}) * count(*) / sum(n), 1e-9)"
        )
        strength = f"least(greatest({mean} * (1 - {mean}) / {spread} - 1, 2.0), 10000.0)"
        priors += [f"{mean} * {strength} AS {name}_a", f"(1 - {mean}) * {strength} AS {name}_b"]
        a, b = f"({name} + {name}_a)", f"(n - {name} + {name}_b)"
        rejected.append(f"{a} / ({a} + {b}) - {Z} * sqrt({a} * {b} / (({a} + {b}) * ({a} + {b}) * ({a} + {b} + 1))) > {MAX_RATE}")
    return rf"""
WITH worded AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), triples AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM worded WHERE len(w) >= 3
), keyed AS (SELECT doc_id, i, w[i:i + 2] AS k FROM triples),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM keyed),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(3) r(j) WHERE c > 1 GROUP BY doc_id),
split AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM worded),
copies AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM split WHERE regexp_matches(l, '{WORD}') GROUP BY doc_id
), counts AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(c.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM worded LEFT JOIN copies c USING (doc_id) LEFT JOIN covered r USING (doc_id)
), hosts AS (SELECT source, count(*)::DOUBLE AS n, {sums} FROM counts GROUP BY source),
prior AS (SELECT {", ".join(priors)} FROM hosts),
verdict AS (SELECT source, ({" OR ".join(rejected)}) AS host_rejected FROM hosts, prior),
judged AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM counts)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND NOT host_rejected) AS kept, host_rejected
FROM judged j JOIN verdict v ON j.source IS NOT DISTINCT FROM v.source
"""


SUBSTRING_DEDUP = rf"""
WITH worded AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM worded WHERE len(w) >= {WINDOW}
), windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS k FROM starts),
least AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM windows),
late AS (SELECT doc_id, i FROM least WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM late, range({WINDOW}) r(j)),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM worded WHERE doc_id IN (SELECT doc_id FROM lists)),
kept AS (
  SELECT doc_id, array_to_string(list(w[p] ORDER BY p), ' ') AS t
  FROM places ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(len(l.ps), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN l.ps IS NULL THEN array_to_string(d.w, ' ') ELSE coalesce(k.t, '') END) AS kept_sha256
FROM worded d LEFT JOIN lists l USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""


def _license_sql() -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    table = ", ".join(f"({i}, {quoted(l)}, {quoted(k)}, {quoted(p)}, {n})" for i, l, k, p, n in rules())
    gate = " OR ".join(f"contains(t, {quoted(stem)})" for stem in gate_stems())
    base = ", ".join(f"{i}" for i in range(len(BASE)))
    return rf"""
WITH rule(id, label, keyword, pattern, priority) AS (VALUES {table}),
joined AS (
  SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g'), ' ') AS j FROM documents
), spaced AS (SELECT doc_id, CASE WHEN j = '' THEN '' ELSE ' ' || j || ' ' END AS t FROM joined),
hits AS (
  SELECT doc_id, r.id, r.label, r.priority,
    unnest(list_filter(list_transform(string_split(regexp_replace(t, r.pattern, chr(1) || '\0', 'g'), ' '),
      lambda x, i: CASE WHEN x = chr(1) THEN (i - 1) // 2 END), lambda x: x IS NOT NULL)) AS s,
    unnest(list_transform(regexp_extract_all(t, r.pattern), lambda m: (length(m) - length(replace(m, ' ', ''))) // 2)) AS n
  FROM spaced, rule r WHERE ({gate}) AND contains(t, r.keyword) AND regexp_matches(t, r.pattern)
), kept AS (
  SELECT a.* FROM hits a WHERE NOT EXISTS (
    SELECT 1 FROM hits b WHERE b.doc_id = a.doc_id AND b.priority >= a.priority AND b.s <= a.s AND b.s + b.n >= a.s + a.n
      AND (b.s < a.s OR b.n > a.n OR b.priority > a.priority OR b.id < a.id))
), based AS (
  SELECT doc_id, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word,
    array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels, list(label) AS ls
  FROM hits WHERE id IN ({base}) GROUP BY doc_id
), labelled AS (SELECT doc_id, list(label) AS ls, max(priority) AS best FROM kept GROUP BY doc_id)
SELECT d.doc_id, ((length(t) - length(replace(t, ' ', ''))) // 2)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base,
  first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(l.ls, [])))), ','), '') AS labels,
  coalesce(best / 100, 0.0)::DOUBLE AS score
FROM spaced d LEFT JOIN based b USING (doc_id) LEFT JOIN labelled l USING (doc_id)
"""


ORACLES = {
    "op1_ngram_jaccard_join": NGRAM_JOIN,
    "op3_host_rules": _host_sql(),
    "op7_substring_dedup": SUBSTRING_DEDUP,
    "op10_license_rules": _license_sql(),
    "op12_super_minhash": SUPER_MINHASH,
}
