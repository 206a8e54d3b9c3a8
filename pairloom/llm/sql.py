"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import mixing, quality


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _rule(r: quality.Rule) -> str:
    n, d = ("1" if x == "one" else x for x in (r.numerator, r.denominator))
    held = []
    if r.low is not None:
        held.append(f"{n} * 1000 >= {d} * {round(1000 * r.low)}")
    if r.high is not None:
        held.append(f"{n} * 1000 <= {d} * {round(1000 * r.high)}")
    return f"({d} = 0 OR ({' AND '.join(held)}))"


def quality_sql(table: str = "documents", rules: tuple[quality.Rule, ...] = quality.RULES) -> str:
    """CTEs that end in ``judged``: a row for each row of the table, with the measures, the failed rules and kept."""
    stops = _quoted(sorted({v for ws in quality.STOP_WORDS.values() for x in ws for v in (x, x.capitalize())}))
    failed = ", ".join(f"CASE WHEN NOT {_rule(r)} THEN '{r.name}' END" for r in rules)
    return f"""
t AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS body FROM {table}),
w AS (SELECT *, list_filter(regexp_split_to_array(body, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
win AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c >= 2),
rep AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n_repeat_words
        FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice) GROUP BY rid),
m AS (SELECT w.*, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (length(body) - length(translate(body, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
             len(list_filter(ls, lambda x: regexp_matches(x, '^ *([-*] |•)')))::BIGINT AS n_bullet_lines,
             len(list_filter(ls, lambda x: suffix(x, '...') OR suffix(x, '…')))::BIGINT AS n_cut_lines,
             len(list_filter(ws, lambda x: x IN ({stops})))::BIGINT AS n_stop_words
      FROM w LEFT JOIN rep USING (rid)),
v AS (SELECT *, list_filter([{failed}], lambda x: x IS NOT NULL) AS failed FROM m),
judged AS (SELECT *, len(failed) = 0 AS kept FROM v)"""


def _weights(column: str, given: dict[str, int], other: int) -> str:
    cases = " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in sorted(given.items()))
    return f"(CASE {cases} ELSE {other} END)::BIGINT" if cases else f"{other}::BIGINT"


def _dealt(name: str, keys: list[str], source: str) -> str:
    """One level of the tree: ``source`` has the keys, cap, tokens, weight and budget; adds share."""
    parent = ", ".join(keys[:-1])
    by = f"PARTITION BY {parent} " if parent else ""
    order = f"{by}ORDER BY cap::DOUBLE / weight, {keys[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""
{name}_a AS (SELECT *, coalesce(sum(cap) OVER ({order}), 0) AS c0, coalesce(sum(weight) OVER ({order}), 0) AS w0, sum(weight) OVER ({by}) AS w1 FROM {source}),
{name}_b AS (SELECT *, cap * (w1 - w0) <= weight * (budget - c0) AS whole FROM {name}_a),
{name}_c AS (SELECT *, sum(CASE WHEN whole THEN cap ELSE 0 END) OVER ({by}) AS c2, sum(CASE WHEN whole THEN 0 ELSE weight END) OVER ({by}) AS w2,
  coalesce(sum(CASE WHEN whole THEN 0 ELSE weight END) OVER ({order}), 0) AS w3 FROM {name}_b),
{name} AS (SELECT {", ".join(keys)}, tokens, (CASE WHEN whole THEN cap ELSE ((w3 + weight) * (budget - c2)) // w2 - (w3 * (budget - c2)) // w2 END)::BIGINT AS share FROM {name}_c)"""


def mixing_sql(recipe: mixing.Recipe, table: str = "documents") -> str:
    """CTEs that end in ``taken``: the rows of the table that the mix takes, with the columns of the mix."""
    keys = list(mixing.LEVELS)
    named = (recipe.domains, recipe.langs, recipe.sources)
    parts = [f"""
r AS (SELECT *, coalesce(CASE WHEN regexp_matches(source, '^src[0-9]$') THEN 'web' ELSE 'curated' END, '<null>') AS m_domain,
             coalesce(lang, '<null>') AS m_lang, coalesce(source, '<null>') AS m_source,
             len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM {table}),
leaf AS (SELECT m_domain AS domain, m_lang AS lang, m_source AS source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * {recipe.epochs} AS cap FROM r GROUP BY ALL),
root AS (SELECT least({recipe.budget if recipe.budget is not None else f"(sum(tokens) * {recipe.permille}) // 1000"}, sum(cap)) AS budget FROM leaf)"""]
    for depth, name in enumerate(keys):
        own = keys[: depth + 1]
        up = "root" if depth == 0 else f"(SELECT {', '.join(own[:-1])}, share AS budget FROM s{depth - 1})"
        using = "CROSS JOIN root" if depth == 0 else f"JOIN {up} USING ({', '.join(own[:-1])})"
        parts.append(f"""
n{depth} AS (SELECT {", ".join(own)}, sum(cap)::BIGINT AS cap, sum(tokens)::BIGINT AS tokens, {_weights(name, named[depth], recipe.other)} AS weight FROM leaf GROUP BY {", ".join(own)}),
j{depth} AS (SELECT * FROM n{depth} {using}),{_dealt(f"s{depth}", own, f"j{depth}")}""")
    parts.append(f"""
plan AS (SELECT *, CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END AS epochs FROM s2),
k AS (SELECT r.*, p.share, p.epochs, p.share - p.epochs * p.tokens AS rest, md5('{recipe.seed}|' || (p.epochs + 1) || '|' || coalesce(r.doc_id::VARCHAR, '') || '|' || md5(coalesce(r.text, ''))) AS key
      FROM r JOIN plan p ON r.m_domain = p.domain AND r.m_lang = p.lang AND r.m_source = p.source),
u AS (SELECT *, sum(n_tokens) OVER (PARTITION BY m_domain, m_lang, m_source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k),
taken AS (SELECT *, least(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END, {recipe.epochs})::BIGINT AS n_epochs FROM u
          WHERE least(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END, {recipe.epochs}) > 0)""")
    return ",".join(parts)


def _mix_query() -> str:
    from .recipes import MIX

    return f"WITH {mixing_sql(MIX)}\nSELECT doc_id, m_domain AS domain, m_lang AS lang, m_source AS source, n_tokens, share, n_epochs FROM taken"


ORACLE_SQL: dict[str, str] = {
    "op3_source_mixing": _mix_query(),
    "op7_quality_rules": f"""WITH {quality_sql()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND kept) AS kept,
       array_to_string(failed, ',') AS failed_rules
FROM judged""",
}

ORACLE_SQL["op10_suffix_array_dedup"] = """
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
w AS (SELECT rid, doc_id, i, substr(hx, 2 * i + 1, 100) AS s FROM (SELECT rid, doc_id, hx, unnest(range(0, greatest(0, length(hx) // 2 - 49))) AS i FROM t)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING count(*) > 1),
hit AS (SELECT rid, i FROM w JOIN m ON w.s = m.s WHERE doc_id > least),
r AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 50 THEN 0 ELSE 1 END AS opens FROM hit),
g AS (SELECT *, sum(opens) OVER (PARTITION BY rid ORDER BY i) AS k FROM r),
sp AS (SELECT rid, k, min(i) AS a, max(i) + 50 AS z FROM g GROUP BY rid, k),
q AS (SELECT rid, a, z, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS p FROM sp),
l AS (SELECT q.rid, string_agg(substr(hx, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substr(any_value(hx), 2 * max(z) + 1) AS kept, sum(z - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans
 FROM q JOIN t ON q.rid = t.rid GROUP BY q.rid)
SELECT doc_id, (length(hx) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, hx))) AS kept_sha256
FROM t LEFT JOIN l ON t.rid = l.rid"""

ORACLE_SQL["op8_ngram_jaccard_join"] = r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS rid, doc_id,
  list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (SELECT DISTINCT rid, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT rid, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM t WHERE len(ws) > 0)),
n AS (SELECT rid, count(*)::BIGINT AS n FROM sh GROUP BY rid),
both_ AS (SELECT a.rid AS a, b.rid AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.rid <> b.rid GROUP BY a.rid, b.rid),
link AS (SELECT a, b FROM both_ JOIN n x ON a = x.rid JOIN n y ON b = y.rid WHERE 100 * i >= 80 * (x.n + y.n - i)),
reach AS (SELECT rid AS a, rid AS b FROM t UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM t LEFT JOIN n ON t.rid = n.rid JOIN (SELECT reach.a, min(doc_id) AS component_id FROM reach JOIN t ON reach.b = t.rid GROUP BY reach.a) c ON t.rid = c.a"""
