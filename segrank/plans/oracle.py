"""DuckDB SQL for every registered query (the correctness check).

The driver registers the raw tables as views; each statement below first
re-derives the pipeline tables (same rules as ``plans/derived.py``) as
CTEs and then states the operator in plain SQL.  Unused CTEs are ignored
by DuckDB.
"""

from __future__ import annotations

# fixed values shared with the Spark side
SENT_RE = r"[^.!?\n]+[.!?]*"
TOK_RE = r"[\p{L}\p{N}]+"
BUDGET = 60


def _q(x: float) -> str:
    """float32 product then truncation toward zero."""
    return f"CAST(trunc(CAST({x} AS FLOAT) * CAST(100 AS FLOAT)) AS INTEGER)"


BASE = f"""
corpus AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS text FROM documents),
_sents AS (
  SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '{SENT_RE}'), lambda s: trim(s)),
                             lambda s: length(s) > 0) AS sents FROM corpus),
_cnts AS (
  SELECT doc_id, sents,
         list_transform(sents, lambda s: len(regexp_extract_all(lower(s), '{TOK_RE}'))) AS cnt FROM _sents),
doc_psgs AS (
  SELECT doc_id, sents, cnt,
         list_reduce(cnt, lambda acc, c: CASE WHEN acc.k = 0 OR acc.n + c > {BUDGET}
                                        THEN {{'n': c, 'k': acc.k + 1, 'starts': list_append(acc.starts, acc.k)}}
                                        ELSE {{'n': acc.n + c, 'k': acc.k + 1, 'starts': acc.starts}} END,
                     {{'n': 0, 'k': 0, 'starts': []::INT[]}}).starts AS starts
  FROM _cnts),
_psg0 AS (
  SELECT doc_id, sents, cnt, starts, unnest(generate_series(0, len(starts) - 1)) AS p FROM doc_psgs),
passages AS (
  SELECT doc_id, CAST(p AS INTEGER) AS psg,
         array_to_string(sents[starts[p + 1] + 1 : coalesce(starts[p + 2], len(sents))], ' ') AS text,
         CAST(list_sum(cnt[starts[p + 1] + 1 : coalesce(starts[p + 2], len(sents))]) AS INTEGER) AS n_tok,
         CAST(len(starts) AS INTEGER) AS n_psg
  FROM _psg0),
tokens AS (
  SELECT doc_id, psg, n_psg, n_tok, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos, unnest(t) AS term
  FROM (SELECT doc_id, psg, n_psg, n_tok, regexp_extract_all(lower(text), '{TOK_RE}') AS t FROM passages)),
queries AS (
  SELECT CAST(item_id AS VARCHAR) AS qid,
         array_to_string(regexp_extract_all(lower(text), '{TOK_RE}'), ' ') AS text
  FROM benchmark),
query_tokens AS (
  SELECT qid, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos, unnest(t) AS term
  FROM (SELECT qid, regexp_extract_all(lower(text), '{TOK_RE}') AS t FROM queries)),
qrels AS (
  SELECT CAST(b.item_id AS VARCHAR) AS qid, CAST(d.doc_id AS VARCHAR) AS doc_id,
         CAST(1 + coalesce(l.quality, 0) AS INTEGER) AS rel
  FROM documents d JOIN benchmark b ON contains(d.text, b.text)
  LEFT JOIN labels l ON l.doc_id = d.doc_id),
term_df AS (
  SELECT term, count(*) AS df
  FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '{TOK_RE}'))) AS term FROM corpus)
  GROUP BY term),
term_weights AS (
  SELECT term, ln(1.0 + CAST((SELECT count(*) FROM corpus) AS DOUBLE) / df) AS scale FROM term_df),
impacts AS (
  SELECT * FROM (
    SELECT doc_id, psg, n_psg, term,
           {_q("scale * (1.0 + ln(CAST(tf AS DOUBLE)))")} AS w
    FROM (SELECT doc_id, psg, n_psg, term, count(*) AS tf FROM tokens GROUP BY doc_id, psg, n_psg, term)
    JOIN term_weights USING (term)) WHERE w <> 0),
query_impacts AS (
  SELECT * FROM (
    SELECT qid, term, {_q("scale * c")} AS qw
    FROM (SELECT qid, term, count(*) AS c FROM query_tokens GROUP BY qid, term)
    JOIN term_weights USING (term)) WHERE qw <> 0),
judged AS (SELECT DISTINCT qid FROM qrels WHERE rel > 0)
"""


def with_base(*ctes: str, final: str) -> str:
    extra = "".join(",\n" + c for c in ctes)
    return "WITH " + BASE.strip() + extra + "\n" + final


def doc_agg_sql(mode: str, n: int | None, src: str = "impacts") -> str:
    """A1-A6 as a CTE body over ``impacts`` (``n`` None: all passages)."""
    n = 1_000_000_000 if n is None else n
    if mode == "first":
        return f"SELECT doc_id, term, CAST(w AS DOUBLE) AS w FROM {src} WHERE psg = 0"
    nu = f"least({n}, any_value(n_psg))"
    val = {
        "max": "greatest(max(CAST(w AS DOUBLE)), 0.0)",
        "sum": "sum(CAST(w AS DOUBLE))",
        "mean": f"sum(CAST(w AS DOUBLE)) / {nu}",
        "gmean": "CAST(ceil(exp(avg(ln(CAST(w AS DOUBLE)))) - 1e-9) AS DOUBLE)",
    }
    if mode == "exp":
        return f"""SELECT doc_id, term, CAST(ceil(m + ln(se + (least({n}, np) - cnt) * exp(-m)) - ln(CAST(least({n}, np) AS DOUBLE)) - 1e-9) AS DOUBLE) AS w
FROM (SELECT doc_id, term, max(CAST(w AS DOUBLE)) AS m, count(*) AS cnt, any_value(n_psg) AS np,
             list(CAST(w AS DOUBLE)) AS ws FROM {src} WHERE psg < {n} GROUP BY doc_id, term)
CROSS JOIN LATERAL (SELECT list_sum(list_transform(ws, lambda x: exp(x - m))) AS se)"""
    return f"SELECT doc_id, term, CAST({val[mode]} AS DOUBLE) AS w FROM {src} WHERE psg < {n} GROUP BY doc_id, term"


def topk_sql(scored: str, k: int, key: str = "qid", item: str = "doc_id") -> str:
    return f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {key} ORDER BY score DESC, {item} ASC) AS INTEGER) AS rank
FROM {scored}) WHERE rank <= {k}"""


def dot_run_sql(qv: str, dv: str, k: int) -> str:
    scored = f"(SELECT qid, doc_id, round(CAST(sum(qw * w) AS DOUBLE), 6) AS score FROM {qv} JOIN {dv} USING (term) GROUP BY qid, doc_id)"
    return topk_sql(scored, k)


def per_query_sql(run: str, k_rr: int = 10, k_ndcg: int = 10, k_rec: int = 1000) -> str:
    kmax = max(k_rr, k_ndcg, k_rec)
    return f"""SELECT i.qid,
  coalesce(1.0 / g.first_rel, 0.0) AS rr,
  coalesce(g.dcg / i.idcg, 0.0) AS ndcg,
  coalesce(CAST(g.n_hit AS DOUBLE) / i.n_rel, 0.0) AS recall
FROM (SELECT qid, sum(CASE WHEN ir <= {k_ndcg} THEN rel / log2(ir + 1) END) AS idcg, count(*) AS n_rel
      FROM (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC) AS ir FROM qrels WHERE rel > 0)
      GROUP BY qid) i
LEFT JOIN (
  SELECT r.qid, min(CASE WHEN erank <= {k_rr} THEN erank END) AS first_rel,
         sum(CASE WHEN erank <= {k_ndcg} THEN q.rel / log2(erank + 1) END) AS dcg,
         count(CASE WHEN erank <= {k_rec} THEN 1 END) AS n_hit
  FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC) AS erank FROM {run}) r
  JOIN (SELECT * FROM qrels WHERE rel > 0) q ON q.qid = r.qid AND q.doc_id = r.doc_id
  WHERE erank <= {kmax}
  GROUP BY r.qid) g ON g.qid = i.qid"""


def summary_sql(run: str, **kw) -> str:
    return f"""SELECT count(*) AS n_queries, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg,
       round(avg(recall), 6) AS recall FROM ({per_query_sql(run, **kw)})"""


EXPANSION = """
_cooc AS MATERIALIZED (
  SELECT a.term AS src_term, b.term AS term, count(*) AS c
  FROM tokens a JOIN tokens b ON a.doc_id = b.doc_id AND a.psg = b.psg
       AND b.pos BETWEEN a.pos - 2 AND a.pos + 2 AND b.pos <> a.pos
  WHERE a.term <> b.term GROUP BY a.term, b.term),
_cf AS (SELECT term, count(*) AS cf FROM tokens GROUP BY term),
expansion AS MATERIALIZED (
  SELECT term AS src_term, term, 1.0::DOUBLE AS s FROM term_df
  UNION ALL
  SELECT x.src_term, x.term, CAST(2 * x.c AS DOUBLE) / (ca.cf + cb.cf) AS s
  FROM _cooc x JOIN _cf ca ON ca.term = x.src_term JOIN _cf cb ON cb.term = x.term)"""


def quant(expr: str) -> str:
    return f"CAST(trunc(CAST({expr} AS FLOAT) * CAST(100 AS FLOAT)) AS INTEGER)"


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


K1, B = 0.9, 0.4


def first_n_docs_sql(n: int | None) -> str:
    cond = "" if n is None else f" AND p.psg < {n}"
    return f"""SELECT c.doc_id, coalesce(string_agg(p.text, ' ' ORDER BY p.psg), '') AS text
FROM corpus c LEFT JOIN passages p ON p.doc_id = c.doc_id{cond} GROUP BY c.doc_id"""


def bm25_ctes(n: int | None, prefix: str = "bm") -> list[str]:
    """CTEs ``{prefix}_docs(doc_id, dl)``, ``{prefix}_tok(doc_id, dl, pos, term)``,
    ``{prefix}_stats(n_docs, avgdl)``."""
    p = prefix
    return [
        f"{p}_d0 AS (SELECT doc_id, regexp_extract_all(lower(text), '{TOK_RE}') AS t FROM ({first_n_docs_sql(n)}))",
        f"{p}_docs AS MATERIALIZED (SELECT doc_id, len(t) AS dl FROM {p}_d0)",
        f"""{p}_tok AS MATERIALIZED (SELECT doc_id, len(t) AS dl, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos, unnest(t) AS term
FROM {p}_d0)""",
        f"{p}_stats AS (SELECT count(*) AS n_docs, avg(CAST(dl AS DOUBLE)) AS avgdl FROM {p}_docs)",
    ]


def bm25_term(tf: str, df: str, dl: str, n: str, avgdl: str) -> str:
    return (f"ln(1.0 + (CAST({n} AS DOUBLE) - CAST({df} AS DOUBLE) + 0.5) / (CAST({df} AS DOUBLE) + 0.5))"
            f" * CAST({tf} AS DOUBLE) / (CAST({tf} AS DOUBLE) + {dbl(K1)} * ({dbl(round(1.0 - B, 10))} + {dbl(B)} * CAST({dl} AS DOUBLE) / {avgdl}))")


def bm25_unit_sql(units: str, stats: str) -> str:
    """``units(qid, unit, qweight, doc_id, tf, dl)`` -> ``(qid, doc_id, s)``."""
    return f"""SELECT u.qid, u.doc_id, u.qweight * {bm25_term('u.tf', 'f.df', 'u.dl', 's.n_docs', 's.avgdl')} AS s
FROM {units} u JOIN (SELECT unit, count(DISTINCT doc_id) AS df FROM {units} GROUP BY unit) f USING (unit)
CROSS JOIN {stats} s"""


def term_units_sql(qweights: str, tok: str) -> str:
    return f"""(SELECT q.qid, t.term AS unit, q.qweight, t.doc_id, t.tf, t.dl
FROM (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM {tok}
      WHERE term IN (SELECT term FROM {qweights}) GROUP BY doc_id, term) t
JOIN {qweights} q ON q.term = t.term)"""


QTF = "(SELECT qid, term, CAST(count(*) AS DOUBLE) AS qweight FROM query_tokens GROUP BY qid, term)"


def bm25_run_sql(n: int | None, k: int, qweights: str = QTF, prefix: str = "bm") -> str:
    scored = f"""(SELECT qid, doc_id, round(sum(s), 6) AS score FROM ({bm25_unit_sql(term_units_sql(qweights, prefix + '_tok'), prefix + '_stats')})
GROUP BY qid, doc_id)"""
    return topk_sql(scored, k)


def pair_units_sql(tok: str, window: int | None) -> str:
    pairs = """(SELECT a.qid, a.term AS t1, b.term AS t2 FROM query_tokens a JOIN query_tokens b
            ON a.qid = b.qid AND b.pos = a.pos + 1)"""
    band = "p2.pos = p1.pos + 1" if window is None else \
        f"p2.pos BETWEEN p1.pos - {window - 1} AND p1.pos + {window - 1} AND p2.pos <> p1.pos"
    post = f"(SELECT * FROM {tok} WHERE term IN (SELECT term FROM query_tokens))"
    return f"""(SELECT q.qid, h.t1 || ' ' || h.t2 AS unit, q.qweight, h.doc_id, h.tf, h.dl
FROM (SELECT p1.doc_id, p1.term AS t1, p2.term AS t2, count(*) AS tf, any_value(p1.dl) AS dl
      FROM {post} p1 JOIN {post} p2 ON p1.doc_id = p2.doc_id AND {band}
      WHERE (p1.term, p2.term) IN (SELECT t1, t2 FROM {pairs})
      GROUP BY p1.doc_id, p1.term, p2.term) h
JOIN (SELECT qid, t1, t2, CAST(count(*) AS DOUBLE) AS qweight FROM {pairs} GROUP BY qid, t1, t2) q
  ON q.t1 = h.t1 AND q.t2 = h.t2)"""


# ------------------------------------------------------------- SDM features

def sdm_ctes(cand: str, n_psg: int, prefix: str = "s") -> list[str]:
    """``{p}_cells_soft`` / ``{p}_cells_exact`` (pid, psg, q_len, d_len, i, j, m) over candidates ``cand(qid, doc_id)``;
    ``{p}_keys(pid, qid, doc_id, psg)`` names the passages."""
    p = prefix
    return [
        f"""{p}_q AS (SELECT t.qid, t.pos + 1 AS i, t.term, coalesce(w.scale, 0.0) AS wq, l.q_len
  FROM query_tokens t LEFT JOIN term_weights w USING (term)
  JOIN (SELECT qid, count(*) + 2 AS q_len FROM query_tokens GROUP BY qid) l USING (qid))""",
        f"""{p}_keys AS MATERIALIZED (SELECT row_number() OVER (ORDER BY qid, doc_id, psg) AS pid, qid, doc_id, psg, n_tok + 2 AS d_len
  FROM (SELECT DISTINCT qid, doc_id FROM {cand}) JOIN passages USING (doc_id) WHERE psg < {n_psg})""",
        f"""{p}_d AS MATERIALIZED (SELECT k.pid, k.psg, k.qid, k.d_len, t.pos + 1 AS j, t.term FROM {p}_keys k JOIN tokens t ON t.doc_id = k.doc_id AND t.psg = k.psg)""",
        f"""{p}_qx AS MATERIALIZED (SELECT q.qid, q.q_len, q.i, e.src_term AS term, q.wq * ln(1.0 + e.s) AS m FROM {p}_q q JOIN expansion e ON e.term = q.term
  WHERE q.wq * e.s > 0)""",
        f"""{p}_cells_soft AS MATERIALIZED (SELECT d.pid, d.psg, x.q_len, d.d_len, x.i, d.j, x.m FROM {p}_d d JOIN {p}_qx x ON x.qid = d.qid AND x.term = d.term)""",
        f"""{p}_cells_exact AS MATERIALIZED (SELECT d.pid, d.psg, q.q_len, d.d_len, q.i, d.j, q.wq * ln(2.0) AS m
  FROM {p}_d d JOIN {p}_q q ON q.qid = d.qid AND q.term = d.term WHERE q.wq > 0)""",
    ]


def ordered_sql(cells: str, n: int, exact: bool) -> str:
    if n == 1:
        return f"SELECT pid, sum(v) AS value FROM (SELECT pid, i, max(m) AS v FROM {cells} GROUP BY pid, i) GROUP BY pid"
    having = f" HAVING count(*) = {n}" if exact else ""
    return f"""SELECT pid, sum(v) AS value FROM (
  SELECT pid, a, max(v) AS v FROM (
    SELECT pid, i - k AS a, j - k AS b, sum(m) AS v FROM {cells} CROSS JOIN range(0, {n}) AS g(k)
    WHERE i - k >= 0 AND i - k <= q_len - {n} AND j - k >= 0 AND j - k <= d_len - {n}
    GROUP BY pid, i - k, j - k{having})
  GROUP BY pid, a) GROUP BY pid"""


def prox_sql(cells: str, p: int) -> str:
    return f"""SELECT pid, any_value(q_len) AS q_len, i, j - k AS b, max(m) AS m FROM {cells} CROSS JOIN range(0, {p}) AS g(k)
  WHERE j - k >= 0 AND j - k <= d_len - {p} GROUP BY pid, i, j - k"""


def unordered_sql(pcells: str, n: int, exact: bool) -> str:
    having = f" HAVING count(*) = {n}" if exact else ""
    return f"""SELECT pid, sum(v) AS value FROM (
  SELECT pid, a, max(v) AS v FROM (
    SELECT pid, i - k AS a, b, sum(m) AS v FROM ({pcells}) CROSS JOIN range(0, {n}) AS g(k)
    WHERE i - k >= 0 AND i - k <= q_len - {n}
    GROUP BY pid, i - k, b{having})
  GROUP BY pid, a) GROUP BY pid"""


def passage_features_sql(prefix: str, exact: bool, windows, p: int, where: str | None = None) -> str:
    """Features of every passage; ``where`` restricts the cells."""
    some = lambda table: f"(SELECT * FROM {table} WHERE {where})" if where else table
    soft = some(f"{prefix}_cells_soft")
    base = some(f"{prefix}_cells_exact") if exact else soft
    parts = []
    for w in windows:
        cells = soft if w == 1 else base
        parts.append(f"SELECT pid, 'O_{w}' AS feature, value FROM ({ordered_sql(cells, w, exact and w > 1)})")
    for w in windows[1:]:
        parts.append(f"SELECT pid, 'U_{w}_p_{p}' AS feature, value FROM ({unordered_sql(prox_sql(base, p), w, exact)})")
    return f"SELECT qid, doc_id, psg, feature, value FROM ({' UNION ALL '.join(parts)}) JOIN {prefix}_keys USING (pid)"


def pooled_sql(pfeat: str, cand: str, names: list[str]) -> str:
    arr = ", ".join(f"'{n}'" for n in names)
    return f"""SELECT g.qid, g.doc_id, g.feature, coalesce(f.value, 0.0) AS value
FROM (SELECT DISTINCT qid, doc_id, unnest([{arr}]) AS feature FROM {cand}) g
LEFT JOIN (SELECT qid, doc_id, feature, max(value) AS value FROM ({pfeat}) GROUP BY qid, doc_id, feature) f
  ON f.qid = g.qid AND f.doc_id = g.doc_id AND f.feature = g.feature"""
