"""DuckDB SQL of the registered queries."""

from __future__ import annotations

from collections.abc import Sequence

from gravelake.functions.text import LINE_END, SPACE, WORD



def _tokens(column: str) -> str:
    return f"list_filter(string_split_regex(lower({column}), '{SPACE}+'), lambda x: x <> '')"


def _strip(column: str) -> str:
    return f"regexp_replace(regexp_replace({column}, '^{SPACE}+', ''), '{SPACE}+$', '')"


BASE = f"""
d AS MATERIALIZED (SELECT doc_id AS child_id, text, source, 'data/' || source || '/' || lang || '/' || doc_id AS file_path, lang AS block_name, {_tokens("text")} AS t FROM documents),
qs AS (SELECT item_id AS query_id, text AS query FROM benchmark)"""
INDEX = f"""{BASE},
len_ AS MATERIALIZED (SELECT child_id, len(t) AS dl FROM d),
post AS MATERIALIZED (SELECT term, child_id, count(*)::BIGINT AS tf FROM (SELECT child_id, unnest(t) AS term FROM d) GROUP BY ALL),
size_ AS (SELECT count(*)::BIGINT AS n_docs, avg(dl) AS avgdl FROM len_),
dfs AS MATERIALIZED (SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY term),
raw_ AS MATERIALIZED (SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS idf0 FROM dfs, size_),
mean_ AS (SELECT avg(idf0) AS avg_idf FROM raw_),
terms AS MATERIALIZED (SELECT term, df, CASE WHEN idf0 >= 0 THEN idf0 ELSE 0.25 * avg_idf END AS idf FROM raw_, mean_)"""


def _scores(queries: str = "qs") -> str:
    return f"""{INDEX},
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_tokens("query")}) AS term FROM {queries}) GROUP BY ALL),
sc AS (SELECT query_id, child_id, sum(round(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) / 1e-12::DOUBLE)::BIGINT)::DOUBLE * 1e-12::DOUBLE AS score
  FROM qt JOIN terms USING (term) JOIN post USING (term) JOIN len_ USING (child_id), size_ GROUP BY ALL)"""


def _bm25(k: int, where: str = "true", queries: str = "qs", name: str = "bm") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT query_id, child_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, child_id) AS rank
  FROM (SELECT q.query_id, d.child_id, coalesce(sc.score, 0.0) AS score FROM {queries} q CROSS JOIN d LEFT JOIN sc ON sc.query_id = q.query_id AND sc.child_id = d.child_id WHERE {where})) WHERE rank <= {k})"""


def _cosine(k: int, before: str = "true", after: str = "true", name: str = "ve") -> str:
    return f"""vecs AS (SELECT vec_id AS child_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, source, file_path FROM embeddings JOIN d ON d.child_id = vec_id),
unit AS (SELECT *, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM vecs WHERE list_dot_product(e, e) > 0),
qv AS (SELECT query_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM (SELECT item_id AS query_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM benchmark JOIN embeddings ON vec_id = item_id)),
near AS (SELECT query_id, child_id, file_path, round(list_dot_product(qv.u, unit.u), 12) AS score FROM qv, unit WHERE {before}),
{name} AS (SELECT query_id, child_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, child_id) AS rank FROM near) WHERE rank <= {k} AND {after})"""


def _hits(alpha: float = 0.5, k: int = 5, category: str | None = None, path: str | None = None, dedup: bool = True, n: int | None = None, name: str = "hits", base: bool = True) -> str:
    """CTEs up to the hits with their metadata; n hits are kept."""
    n = n or k
    cat = f"source = '{category}'" if category else "true"
    pat = f"contains(file_path, '{path}')" if path else "true"
    start = f"{_scores()}, {_bm25(10 * n, f'{cat} AND {pat}')}, {_cosine(10 * n, cat, pat)}," if base else ""
    return f"""{start}
{name}_f AS (SELECT coalesce(v.query_id, b.query_id) AS query_id, coalesce(v.child_id, b.child_id) AS child_id, round({alpha}::DOUBLE * coalesce(v.s, 0) + {1 - alpha}::DOUBLE * coalesce(b.s, 0), 12) AS score
  FROM (SELECT query_id, child_id, score / CASE WHEN max(score) OVER (PARTITION BY query_id) = 0 THEN 1 ELSE max(score) OVER (PARTITION BY query_id) END AS s FROM ve) v
  FULL JOIN (SELECT query_id, child_id, score / CASE WHEN max(score) OVER (PARTITION BY query_id) = 0 THEN 1 ELSE max(score) OVER (PARTITION BY query_id) END AS s FROM bm) b ON v.query_id = b.query_id AND v.child_id = b.child_id),
{name}_p AS (SELECT f.*, text, source, file_path, block_name, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, child_id) AS rn FROM {name}_f f JOIN d USING (child_id)),
{name} AS (SELECT * REPLACE (round(score, 6) AS score) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, child_id)::INT AS rank FROM {name}_p WHERE {"rn = 1" if dedup else "true"}) WHERE rank <= {n})"""


_HAY = "lower(coalesce(text, '') || ' ' || coalesce(block_name, '') || ' ')"
_WORDS = "list_filter(string_split(query, ' '), lambda w: w <> '')[1:{}]"
_ANY = "coalesce(len(list_filter({n}, lambda x: contains({h}, lower(x)))) > 0, false)"
_ALL = "coalesce(len(list_filter({n}, lambda x: contains({h}, lower(x)))) = len({n}), true)"
_PATH = "lower(replace(file_path, '\\', '/'))"


def _hit_rows(source: str, name: str) -> str:
    ok = _ANY.format(n=f"[array_to_string({_WORDS.format(4)}, ' ')]", h=_HAY)
    hit = ", ".join(f"coalesce(bool_or({ok} AND rank <= {k}) FILTER (WHERE rank IS NOT NULL), false) AS hit{k}" for k in (1, 3, 5))
    return f"""{name} AS (SELECT q.query_id AS id, query, {hit}, coalesce(max(substr(text, 1, 200)) FILTER (WHERE rank = 1), '') AS top_result,
  coalesce(max(score) FILTER (WHERE rank = 1), 0.0) AS top_score FROM qs q LEFT JOIN {source} h ON h.query_id = q.query_id GROUP BY ALL)"""


def _share(c: str) -> str:
    return f"round(coalesce(avg({c}::INT), 0.0), 6) AS {c}"


_HIT_SUMMARY = "SELECT count(*) AS total_queries, " + ", ".join(_share(f"hit{k}") for k in (1, 3, 5)) + ", '{e}' AS experiment FROM {r}"
_GRADE = "CASE WHEN hit1 THEN 'HIT@1' WHEN hit3 THEN 'HIT@3' WHEN hit5 THEN 'HIT@5' ELSE 'MISS' END"
_TWO = f"{_hits()}, {_hits(0.1, name='hitsb', base=False)}, {_hit_rows('hits', 'ra')}, {_hit_rows('hitsb', 'rb')}"
_COMPARED = f"""{_TWO}, cmp AS (SELECT a.id, a.g AS grade_a, b.g AS grade_b, CASE WHEN pb < pa THEN 'B better' WHEN pb > pa THEN 'A better' ELSE '' END AS note
  FROM (SELECT id, {_GRADE} AS g, list_position(['HIT@1', 'HIT@3', 'HIT@5', 'MISS'], {_GRADE}) AS pa FROM ra) a JOIN (SELECT id, {_GRADE} AS g, list_position(['HIT@1', 'HIT@3', 'HIT@5', 'MISS'], {_GRADE}) AS pb FROM rb) b USING (id))"""
_RULES = f"rules AS (SELECT query_id AS id, CASE WHEN query_id % 2 = 0 THEN ['/en/', '/fr/'] ELSE [] END AS paths, {_WORDS.format(2)} AS words FROM qs)"
_STRICT = f"((len(paths) = 0 OR {_ANY.format(n='paths', h=_PATH)}) AND {_ALL.format(n='words', h=_HAY)})"
_SOFT = _ANY.format(n="words", h=_HAY)
_GOLD = f"""{_hits()}, {_RULES}, gr AS (SELECT r.id, query, {", ".join(f"coalesce(bool_or({t} AND rank <= {k}) FILTER (WHERE rank IS NOT NULL), false) AS {n}{k}" for n, t in (("soft_hit", _SOFT), ("strict_hit", _STRICT)) for k in (1, 3, 5))},
  coalesce(max(score) FILTER (WHERE rank = 1), 0.0) AS top_score, coalesce(max(file_path) FILTER (WHERE rank = 1), '') AS top_file
  FROM rules r JOIN qs q ON q.query_id = r.id LEFT JOIN hits h ON h.query_id = r.id GROUP BY ALL)"""
_FEEDBACK = f"""{_hits()},
fg AS (SELECT query_id AS id, query_id % 5 <> 4 AS scorable, CASE WHEN query_id % 3 = 0 THEN ['/en/'] ELSE [] END AS acc, CASE WHEN query_id % 4 = 1 THEN ['/DE/'] END AS t1p,
  CASE WHEN query_id % 4 = 2 THEN {_WORDS.format(1)} END AS t1all, CASE WHEN query_id % 4 = 3 THEN {_WORDS.format(2)} END AS t1any, CASE WHEN query_id % 2 = 1 THEN ({_WORDS.format(2)})[2:2] END AS t3any,
  query_id % 7 = 3 AS guard, query_id % 6 = 5 AS skip FROM qs),
fq AS (SELECT q.query_id AS id, query, coalesce(scorable, true) AS scorable, coalesce(acc, []) AS acc, coalesce(t1p, acc, []) AS own, coalesce(t1all, []) AS t1all, coalesce(t1any, []) AS t1any, coalesce(t3any, []) AS t3any,
  coalesce(guard, false) AS guard, coalesce(skip, false) AS skip FROM qs q LEFT JOIN fg ON fg.id = q.query_id),
fx AS (SELECT fq.*, h.rank, h.file_path, {_HAY} AS hay, {_PATH} AS p, h.text, h.block_name FROM fq LEFT JOIN hits h ON h.query_id = fq.id),
fy AS (SELECT *, rank IS NOT NULL AS there, (len(own) = 0 OR {_ANY.format(n="own", h="p")}) AS pok, {_ANY.format(n="acc", h="p")} OR {_ANY.format(n="t1any", h="hay")} AS rel FROM fx),
fz AS (SELECT *, CASE WHEN len(t1all) > 0 THEN {_ALL.format(n="t1all", h="hay")} AND pok WHEN len(t1any) > 0 THEN {_ANY.format(n="t1any", h="hay")} AND pok ELSE pok END AS a1,
  CASE WHEN len(t3any) > 0 THEN {_ANY.format(n="t3any", h="hay")} ELSE rel END AS a3, NOT contains(p, 'wiki') AND contains(hay, 'the') AND (contains(p, 'game') OR contains(p, 'common')) AS wrong,
  coalesce(block_name, '') <> '' OR (contains(text, '=') AND contains(text, '{{')) AS act FROM fy),
fr_ AS (SELECT id, query, scorable, guard, skip, len(acc) > 0 AS has_paths, coalesce(bool_or(a1) FILTER (WHERE there AND rank = 1), false) AS t1, coalesce(bool_or(a3) FILTER (WHERE there AND rank <= 3), false) AS t3,
  coalesce(bool_or(wrong) FILTER (WHERE there AND rank <= 5), false) AS bad, coalesce(bool_or(act) FILTER (WHERE there AND rank = 1), false) AS actionability, count(*) FILTER (WHERE there AND rank <= 5) AS n5,
  count(*) FILTER (WHERE there AND rank <= 5 AND rel) AS r5, coalesce(max(substr(file_path, 1, 120)) FILTER (WHERE rank = 1), '') AS top1_file FROM fz GROUP BY ALL),
fb AS (SELECT id, query, scorable, CASE WHEN guard THEN NOT bad WHEN scorable THEN t1 ELSE false END AS top1_correct, CASE WHEN guard THEN NOT bad WHEN scorable THEN t3 ELSE false END AS top3_recall,
  CASE WHEN NOT guard AND scorable AND NOT skip THEN round(CASE WHEN has_paths THEN 1 - r5 / greatest(n5, 1) ELSE (n5 > 0)::INT::DOUBLE END, 6) END AS noise_top5, actionability, CASE WHEN guard THEN NOT bad END AS false_positive_pass, top1_file FROM fr_),
fs AS (SELECT count(*) AS scorable_queries, round(coalesce(avg(top1_correct::INT), 0.0), 6) AS top1, round(coalesce(avg(top3_recall::INT), 0.0), 6) AS top3, round(avg(noise_top5), 6) AS noise_top5_mean, {_share("actionability")}, 'base' AS experiment FROM fb WHERE scorable)"""
_SNIPPET_LINES = f"list_filter(list_transform(string_split_regex(coalesce(text, ''), '{LINE_END}'), lambda l: regexp_replace(regexp_replace(l, '^{SPACE}+', ''), '{SPACE}+$', '')), lambda l: l <> '')[1:3]"
_SNIPPET = f"CASE WHEN length(array_to_string({_SNIPPET_LINES}, chr(10))) > 280 THEN left(array_to_string({_SNIPPET_LINES}, chr(10)), 277) || '...' ELSE array_to_string({_SNIPPET_LINES}, chr(10)) END"
_BRIEF = "query_id, rank, child_id, score"
_OVERLAP = f"len(list_filter(terms_, lambda t: contains({_HAY}, t)))"
_TERMS = f"list_distinct(list_transform(regexp_extract_all(query, '{WORD}'), lambda x: lower(x)))"


def windows(size: int, step: int) -> str:
    """Windows of words of every document."""
    return f"""WITH {BASE}, w AS (SELECT child_id, source, t, unnest(range(0, greatest(len(t) - {size - step}, 1), {step})) AS pos FROM d WHERE len(t) > 0)
SELECT child_id AS doc_id, source, (pos // {step})::INT AS chunk_ord, len(t[pos + 1 : pos + {size}])::INT AS n_words, md5(array_to_string(t[pos + 1 : pos + {size}], ' ')) AS digest FROM w"""


def sweep(alphas: Sequence[float], k: int) -> str:
    """Hits of every question under every weight, in order and reranked."""
    out, parts = f"WITH {_scores()}, {_bm25(10 * k)}, {_cosine(10 * k)}", []
    for i, alpha in enumerate(alphas):
        h = f"h{i}"
        out += f""", {_hits(alpha, k, name=h, base=False).lstrip()}, {h}_r AS (SELECT h.* REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN len(terms_) = 0 THEN 0 ELSE -{_OVERLAP} END, score DESC, rank)::INT AS rank)
  FROM {h} h JOIN (SELECT query_id, {_TERMS} AS terms_ FROM qs) USING (query_id)), {_hit_rows(h, f'{h}_a')}, {_hit_rows(f'{h}_r', f'{h}_b')}"""
        parts += [f"SELECT {alpha}::DOUBLE AS alpha, '{mode}' AS mode, id, hit1, hit3, hit5, top_score FROM {h}_{x}" for mode, x in (("plain", "a"), ("rerank", "b"))]
    return f"{out} {' UNION ALL '.join(parts)}"


def _reranked(k: int, n: int) -> str:
    return f"""{_hits(k=k, n=n)}, ov AS (SELECT h.query_id, child_id, score, rank, len(terms_) = 0 AS plain, {_OVERLAP} AS overlap FROM hits h JOIN (SELECT query_id, {_TERMS} AS terms_ FROM qs) USING (query_id)),
rr AS (SELECT query_id, child_id, score, overlap, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN plain THEN 0 ELSE -overlap END, score DESC, rank)::INT AS rank FROM ov)"""


_EVENTS = """ev AS (SELECT event_id, user_id, event_type, CASE event_type WHEN 'click' THEN 'tips' WHEN 'view' THEN 'untidy' WHEN 'signup' THEN 'warning' WHEN 'purchase' THEN 'error' WHEN 'error' THEN 'fatal' END AS severity FROM events),
rep AS (SELECT *, list_position(['tips', 'untidy', 'warning', 'error', 'fatal'], severity) - 1 AS severity_idx FROM ev)"""
_MARKDOWN = r"""md AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<h([1-6])[^>]*>', chr(10) || '## ', 'g'), '</h[1-6]>', chr(10), 'g'), '</?(p|div|li|article|nav|ul)[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS text FROM pages)"""

_NATIONS = """c AS (SELECT c_nationkey AS k, string_agg(line, chr(10) ORDER BY line) AS body FROM (SELECT c_nationkey, chr(9) || 'customer = { key = ' || c_custkey || ' name = "' || c_name || '" }' AS line FROM customer) GROUP BY 1),
n AS (SELECT 'common/nations/' || n_name || '.txt' AS path, 'nation ' || n_name AS name, coalesce(body, '') AS body FROM nation LEFT JOIN c ON k = n_nationkey)"""

ORACLES = {
    "corpus_stats": f"WITH {INDEX} SELECT n_docs, round(avgdl, 6) AS avgdl, round(avg_idf, 6) AS avg_idf FROM size_, mean_",
    "term_df": f"WITH {INDEX} SELECT * FROM dfs",
    "lexical_build": f"WITH {INDEX} SELECT (SELECT count(*) FROM post) AS n_postings, (SELECT sum(tf)::BIGINT FROM post) AS n_words, (SELECT count(*) FROM terms) AS n_terms, (SELECT sum(df)::BIGINT FROM terms) AS sum_df, (SELECT count(*) FROM len_) AS n_docs, (SELECT sum(dl)::BIGINT FROM len_) AS sum_dl",
    "term_idf": f"WITH {INDEX} SELECT term, df, round(idf, 6) AS idf FROM terms",
    "bm25_postings": f"WITH {INDEX} SELECT * FROM post",
    "bm25_all": f"WITH {_scores()} SELECT query_id, child_id, round(score, 6) AS score FROM sc",
    "bm25_topk": f"WITH {_scores()}, {_bm25(10)} SELECT query_id, child_id, round(score, 6) AS score, rank::INT AS rank FROM bm",
    "bm25_topk_category": f"WITH {_scores()}, {_bm25(10, chr(39).join(['source = ', 'src0', '']))} SELECT query_id, child_id, round(score, 6) AS score, rank::INT AS rank FROM bm",
    "bm25_topk_path": f"WITH {_scores()}, {_bm25(10, chr(39).join(['contains(file_path, ', '/en/', ')']))} SELECT query_id, child_id, round(score, 6) AS score, rank::INT AS rank FROM bm",
    "bm25_zero_fill": f"WITH {_scores('(SELECT query_id, (' + _tokens('query') + ')[1] || chr(126) AS query FROM qs)')}, {_bm25(10)} SELECT query_id, child_id, round(score, 6) AS score, rank::INT AS rank FROM bm",
    "bm25_segments": f"WITH {_scores()}, {_bm25(10)} SELECT query_id, child_id, round(score, 6) AS score, rank::INT AS rank FROM bm",
    "wiki_parents": rf"""WITH {_MARKDOWN}, p AS (SELECT page_id, string_split(regexp_replace(text, '(?m)^(#{{2,}}\s)', chr(1) || '\1', 'g'), chr(1)) AS parts FROM md),
s AS (SELECT page_id, unnest(parts) AS part, unnest(range(len(parts)))::INT AS ord FROM p), t AS (SELECT page_id, ord, {_strip("part")} AS section FROM s),
u AS (SELECT *, CASE WHEN regexp_matches(section, '^#{{2,}}\s') THEN {_strip(f"regexp_extract(section, '^#{{2,}}{chr(92)}s+([^{chr(92)}n]*)', 1)")} ELSE 'page ' || page_id || ' (intro)' END AS section_title FROM t WHERE section <> ''),
v AS (SELECT *, row_number() OVER (PARTITION BY page_id, section_title ORDER BY ord) AS n, 'data/wiki/page_' || page_id || '.md' AS file_path FROM u)
SELECT file_path || '::' || section_title || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS parent_id, section_title, file_path, ord, md5(section) AS digest FROM v""",
    "script_parents": f"""WITH {_NATIONS}, b AS (SELECT path, name AS block_name, name || ' = {{' || chr(10) || body || chr(10) || '}}' AS content FROM n UNION ALL SELECT path, '', '{{ }}' FROM n)
SELECT path || '::' || block_name AS parent_id, block_name, 'nations' AS file_category, 'game_file' AS source_type, md5({_strip("content")}) AS digest FROM b""",
    "scan_scripts": r"""WITH t AS (SELECT source, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) || chr(10) AS x FROM documents)
SELECT 'source=' || source AS category, sum(length(x))::BIGINT AS n_chars, sum(length(x) - length(replace(x, chr(10), '')))::BIGINT AS n_lines FROM t GROUP BY 1""",
    "corpus_order": "SELECT doc_id, row_number() OVER (ORDER BY source, lang, doc_id) - 1 AS corpus_ord FROM documents",
    "cosine_topk": f"WITH {BASE}, {_cosine(10)} SELECT query_id, rank::INT AS rank, child_id, round(score, 6) AS score FROM ve",
    "cosine_topk_category": f"WITH {BASE}, {_cosine(10, chr(39).join(['source = ', 'src0', '']))} SELECT query_id, rank::INT AS rank, child_id, round(score, 6) AS score FROM ve",
    "cosine_topk_path_post": f"WITH {BASE}, {_cosine(10, 'true', chr(39).join(['contains(file_path, ', '/en/', ')']))} SELECT query_id, rank::INT AS rank, child_id, round(score, 6) AS score FROM ve",
    "cosine_cells_recall": f"""WITH {BASE}, v AS (SELECT vec_id FROM embeddings JOIN d ON d.child_id = vec_id WHERE list_dot_product(embedding, embedding) > 0)
SELECT count(*) FILTER (WHERE vec_id % 50 = 0) AS n_queries, count(*) FILTER (WHERE vec_id % 50 = 0) * least(10, count(*)) AS n_nearest, true AS enough FROM v""",
    "hybrid_topk": f"WITH {_hits()} SELECT {_BRIEF}, source AS parent_id, file_path FROM hits",
    "hybrid_exact": f"WITH {_hits(0.1)} SELECT {_BRIEF} FROM hits",
    "hybrid_filtered": f"WITH {_hits(category='src0', path='/en/')} SELECT {_BRIEF} FROM hits",
    "hybrid_no_dedup": f"WITH {_hits(dedup=False)} SELECT {_BRIEF} FROM hits",
    "lexical_rerank": f"WITH {_reranked(5, 5)} SELECT {_BRIEF}, overlap::INT AS overlap FROM rr",
    "overfetch_rerank": f"WITH {_reranked(3, 8)} SELECT {_BRIEF} FROM rr WHERE rank <= 3",
    "gold_rerank": f"""WITH {_hits()}, {_RULES}, g AS (SELECT h.query_id, child_id, score, rank, (paths IS NULL OR len(paths) = 0 OR {_ANY.format(n="paths", h=_PATH)})::INT AS path_ok,
  coalesce(len(list_filter(words, lambda x: contains({_HAY}, lower(x)))), 0)::INT AS token_hits FROM hits h LEFT JOIN rules r ON r.id = h.query_id)
SELECT query_id, child_id, score, path_ok, token_hits, row_number() OVER (PARTITION BY query_id ORDER BY path_ok DESC, token_hits DESC, score DESC, rank)::INT AS rank FROM g""",
    "pair_rerank": f"""WITH {_hits()}, pr AS (SELECT h.query_id, child_id, score, rank AS before, round(CASE WHEN len(w) = 0 THEN 0 ELSE len(list_intersect(w, {_tokens("text")}))::DOUBLE / len(w) END, 6) AS rerank_score,
  CASE WHEN len(w) = 0 THEN 0 ELSE len(list_intersect(w, {_tokens("text")}))::DOUBLE / len(w) END AS whole FROM hits h JOIN (SELECT query_id, list_distinct({_tokens("query")}) AS w FROM qs) USING (query_id))
SELECT query_id, child_id, score, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY whole DESC, before)::INT AS rank FROM pr""",
    "script_blocks": f"""WITH {_NATIONS}
SELECT path, 0 AS ord, name, md5(name || ' = {{' || chr(10) || body || chr(10) || '}}') AS digest FROM n UNION ALL SELECT path, 1, '', md5('{{ }}') FROM n""",
    "query_terms": f"WITH {BASE} SELECT query_id, unnest({_TERMS}) AS term FROM qs",
    "eval_hit_at_k": f"WITH {_hits()}, {_hit_rows('hits', 'r')} SELECT * FROM r",
    "eval_summary": f"WITH {_hits()}, {_hit_rows('hits', 'r')} {_HIT_SUMMARY.format(e='base', r='r')}",
    "gold_strict_soft": f"WITH {_GOLD} SELECT * FROM gr",
    "gold_summary": f"WITH {_GOLD} SELECT count(*) AS total_queries, {', '.join(_share(f'{n}{k}') for n in ('soft_hit', 'strict_hit') for k in (1, 3, 5))}, 'base' AS experiment FROM gr",
    "feedback_metrics": f"WITH {_FEEDBACK} SELECT * FROM fb",
    "feedback_summary": f"WITH {_FEEDBACK} SELECT * FROM fs",
    "grade_compare": f"WITH {_COMPARED} SELECT * FROM cmp",
    "compare_lists": f"WITH {_COMPARED} SELECT coalesce(string_agg(id::VARCHAR, ',' ORDER BY id::VARCHAR) FILTER (WHERE note = 'B better'), '') AS b_better, coalesce(string_agg(id::VARCHAR, ',' ORDER BY id::VARCHAR) FILTER (WHERE note = 'A better'), '') AS a_better FROM cmp",
    "metric_deltas": f"WITH {_TWO}, sa AS ({_HIT_SUMMARY.format(e='base', r='ra')}), sb AS ({_HIT_SUMMARY.format(e='exact', r='rb')}) "
    + " UNION ALL ".join(f"SELECT 'hit@{k}' AS metric, sa.hit{k} AS a, sb.hit{k} AS b, round(sb.hit{k} - sa.hit{k}, 6) AS delta FROM sa, sb" for k in (1, 3, 5)),
    "query_id_union": "SELECT item_id AS id FROM benchmark UNION SELECT doc_id FROM labels",
    "section_split": rf"""WITH {_MARKDOWN}, s AS (SELECT page_id, unnest(string_split(regexp_replace(text, '(?m)^(#{{2,}}\s)', chr(1) || '\1', 'g'), chr(1))) AS section FROM md),
t AS (SELECT page_id, {_strip("section")} AS section FROM s)
SELECT page_id, CASE WHEN regexp_matches(section, '^#{{2,}}\s') THEN {_strip(f"regexp_extract(section, '^#{{2,}}{chr(92)}s+([^{chr(92)}n]*)', 1)")} ELSE 'page ' || page_id || ' (intro)' END AS section_title, length(section)::INT AS n_chars, md5(section) AS digest FROM t WHERE section <> ''""",
    "dup_name_suffix": "SELECT event_id, event_type || CASE WHEN n > 0 THEN '#' || n ELSE '' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS n FROM events)",
    "category_from_path": "WITH p AS (SELECT doc_id AS child_id, string_split((CASE WHEN doc_id % 3 = 0 THEN 'common/' ELSE '' END) || (CASE WHEN doc_id % 2 = 0 THEN source || '/' ELSE '' END) || doc_id || '.txt', '/') AS x FROM documents) SELECT child_id, CASE WHEN x[1] = 'common' AND len(x) > 2 THEN x[2] ELSE x[1] END AS category FROM p",
    "word_window_chunks": f"WITH {BASE}, w AS (SELECT child_id, t, unnest(range(0, greatest(len(t) - 16, 1), 48)) AS pos FROM d WHERE len(t) > 0) SELECT child_id, (pos // 48)::INT AS chunk_ord, md5(array_to_string(t[pos + 1 : pos + 64], ' ')) AS digest FROM w",
    "greedy_pack_lines": f"""WITH RECURSIVE {BASE}, l AS (SELECT child_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: {_strip("x")} <> ''), lambda x: len({_tokens("x")})) AS n FROM d),
f AS (SELECT child_id, n, 1 AS i, 0 AS chunk, n[1] AS used FROM l WHERE len(n) > 0
  UNION ALL SELECT child_id, n, i + 1, CASE WHEN used > 0 AND used + n[i + 1] > 40 THEN chunk + 1 ELSE chunk END, CASE WHEN used > 0 AND used + n[i + 1] > 40 THEN n[i + 1] ELSE used + n[i + 1] END FROM f WHERE i < len(n))
SELECT child_id, chunk::INT AS chunk_ord, count(*) AS n_lines, sum(n[i])::BIGINT AS n_words FROM f GROUP BY ALL""",
    "instruct_queries": "SELECT item_id AS query_id, md5('Instruct: Find passages.' || chr(10) || 'Query:' || text) AS digest FROM benchmark",
    "pending_anti_join": "SELECT doc_id AS child_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "parent_last_wins": f"WITH {BASE} SELECT parent_id, child_id, file_path FROM (SELECT source AS parent_id, child_id, file_path, row_number() OVER (PARTITION BY source ORDER BY child_id DESC) AS rn FROM d) WHERE rn = 1",
    "keyed_upsert": f"WITH {BASE} SELECT vec_id AS child_id, 'new' AS file_path FROM embeddings UNION ALL SELECT child_id, file_path FROM d WHERE child_id NOT IN (SELECT vec_id FROM embeddings)",
    "severity_report": f"WITH {_EVENTS} SELECT severity, severity_idx::BIGINT AS severity_idx, count(*) AS n_reports FROM rep WHERE severity_idx >= 2 GROUP BY ALL",
    "severity_lines": f"""WITH {_EVENTS} SELECT severity_idx::BIGINT AS severity_idx, severity, 'f' || user_id AS file, '  [' || event_type || '] f' || user_id || CASE WHEN event_id % 4 <> 0 THEN ':' || (event_id % 4) ELSE '' END || ': ' ||
  CASE WHEN event_id % 3 <> 0 THEN 'm' || event_id WHEN event_id % 2 = 0 THEN 'second' ELSE 'r' || event_id END AS report FROM rep WHERE severity_idx >= 3""",
    "json_props": "SELECT event_id, key, json_extract_string(props, '$.\"' || key || '\"') AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)",
    "render_answers": f"""WITH {_hits()} SELECT query_id, md5(regexp_replace(rtrim(string_agg('[' || rank || '] score=' || printf('%.2f', round(score::DECIMAL(18, 6), 2)::DOUBLE) || '  Game · ' || source || ' · ' || block_name || '  (' || file_path || ')' || chr(10) || 'parent_id: ' || source || chr(10) || text || chr(10), chr(10) ORDER BY rank)), '\\n+$', '')) AS digest FROM hits GROUP BY query_id""",
    "render_cli": f"WITH {_hits()} SELECT query_id, rank, '  [' || rank || '] score=' || printf('%.4f', round(score::DECIMAL(18, 6), 4)::DOUBLE) || '  ' || source || '/' || block_name || '  (' || file_path || ')' AS line FROM hits",
    "review_blocks": f"""WITH {_hits()} SELECT query_id, rank, md5('### Rank ' || rank || chr(10) || chr(10) || '- score: `' || printf('%.4f', round(score::DECIMAL(18, 6), 4)::DOUBLE) || '`' || chr(10) || '- file: `' || file_path || '`' || chr(10) || '- title: `' || block_name || '`' || chr(10) || '- parent_id: `' || source || '`' || chr(10) || chr(10) || '```text' || chr(10) || {_SNIPPET} || chr(10) || '```' || chr(10)) AS digest FROM hits""",
    "snippets": f"WITH {BASE} SELECT child_id, {_SNIPPET} AS snippet FROM d",
    "feedback_matrix": f"WITH {_FEEDBACK}, pc AS (SELECT *, printf('%.0f%%', round_even(top1 * 100, 0)) AS p1, printf('%.0f%%', round_even(top3 * 100, 0)) AS p3, coalesce(printf('%.0f%%', round_even(noise_top5_mean * 100, 0)), '-') AS pn, printf('%.0f%%', round_even(actionability * 100, 0)) AS pa FROM fs) SELECT 'profile_' || c AS config, 'mode_' || m AS mode, '| profile_' || c || ' | mode_' || m || ' | ' || p1 || ' | ' || p3 || ' | ' || pn || ' | ' || pa || ' |' AS line FROM pc, range(8) a(c), range(3) b(m)",
    "actionable_hits": f"WITH {_hits()} SELECT query_id, rank, coalesce(block_name, '') <> '' OR (contains(text, '=') AND contains(text, '{{')) AS actionable FROM hits",
    "collection_of_id": "SELECT doc_id AS child_id, CASE WHEN doc_id % 2 = 0 OR doc_id % 5 = 0 THEN 'wiki' ELSE 'game' END AS collection FROM documents",
}
