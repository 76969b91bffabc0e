"""What ``divergence`` computes, said in DuckDB's SQL over the table ``documents``."""

from __future__ import annotations

from eigenframe.llm.divergence import CLASSES, HISTOGRAM, PLAIN, Rules


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _term(p: str, q: str) -> str:
    """A bin's part of twice the divergence."""
    m = f"(({p} + {q}) / 2)"
    return f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / {m}) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / {m}) ELSE 0 END)"


def verdict_sql(rules: Rules = Rules()) -> str:
    sized = ", ".join(f"length(regexp_replace(r, {_text(rest)}, '', 'g')) AS c_{k}" for k, rest in CLASSES.items())
    others = " + ".join(f"c_{k}" for k in HISTOGRAM[:-1])
    sums = ", ".join(f"sum(c_{k}) AS s_{k}" for k in HISTOGRAM)
    by_class = " + ".join(_term(f"(c_{k} / n::DOUBLE)", f"(s_{k} / greatest(1, chars)::DOUBLE)") for k in HISTOGRAM)
    by_word = _term("(coalesce(k, 0) / n_words::DOUBLE)", "share")
    by_rest = _term("((n_words - seen) / n_words::DOUBLE)", "rest")
    limit = f"greatest({rules.word_limit}, {rules.short_base} + {rules.short_slope} / sqrt(n_words))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
m AS (SELECT *, length(t) AS n, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
      regexp_replace(t, {_text(PLAIN)}, '', 'g') AS r,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
a AS (SELECT *, len(w) AS n_words, n - length(array_to_string(w, '')) AS c_space, {sized} FROM m),
c AS MATERIALIZED (SELECT *, n - ({others}) AS c_rest FROM a),
e AS (SELECT rid, p, w[p] AS x, w[p + 1] AS y, w[p + 2] AS z FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 1, 1))) AS p FROM c)),
g AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, x, y, z) AS k FROM e),
again AS (SELECT rid, count(DISTINCT q) AS n_repeat_words FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM g WHERE k > 1) GROUP BY rid),
s AS (SELECT lang, sum(n_words) AS nw, sum(n) AS chars, {sums} FROM c WHERE lang IS NOT NULL GROUP BY lang),
l AS MATERIALIZED (SELECT * FROM s WHERE nw > 0 AND nw >= {rules.language_share} * (SELECT sum(nw) FROM s)),
u AS MATERIALIZED (SELECT rid, lang, lower(x) AS x, count(*) AS k FROM (SELECT rid, lang, unnest(w) AS x FROM c) GROUP BY ALL),
v AS (SELECT lang, x, sum(k) AS k FROM u GROUP BY ALL),
cw AS MATERIALIZED (SELECT lang, x, k / nw::DOUBLE AS share FROM v JOIN l USING (lang) WHERE k >= {rules.word_share} * nw),
bins AS (SELECT c.rid, l.lang, any_value(n_words) AS n_words, sum(coalesce(k, 0)) AS seen, greatest(0, 1 - sum(share)) AS rest, sum({by_word}) AS js
      FROM c CROSS JOIN l JOIN cw ON cw.lang = l.lang LEFT JOIN u ON u.rid = c.rid AND u.x = cw.x WHERE n_words > 0 GROUP BY ALL),
wd AS (SELECT rid, lang, sqrt(greatest((js + {by_rest}) / 2, 0)) AS word_distance FROM bins),
cd AS (SELECT rid, l.lang, CASE WHEN n > 0 THEN sqrt(greatest(({by_class}) / 2, 0)) ELSE 1 END AS class_distance FROM c CROSS JOIN l),
fine AS (SELECT c.rid FROM c JOIN cd USING (rid) JOIN wd USING (rid) WHERE cd.lang = wd.lang AND n_words > 0
      AND (n < {rules.class_chars} OR class_distance <= {rules.class_limit}) AND (n_words < {rules.word_words} OR word_distance <= {limit}) GROUP BY c.rid)
SELECT doc_id, n_words::BIGINT AS n_words, (n - c_space)::BIGINT AS word_chars, c_symbol::BIGINT AS n_symbols,
      (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
      n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed,
      NOT (n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words) AND fine.rid IS NOT NULL AS kept
FROM c LEFT JOIN again USING (rid) LEFT JOIN fine USING (rid)"""
