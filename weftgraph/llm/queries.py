"""The subpackage's queries, and their SQL where SQL can express them.

SQL cannot express the verdicts of op1 to op11, fingerprints and models: tests hold these against brute force.  What
it can express of four results stands in the base_ queries, which take their rows from the ten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from . import bpe_automaton, imatch, jaccard_join, lang_id, lbl_lm, mil, mixing, quotes, repetition, secret_scan, sketch_dedup, trie, whitening
from .common import table

#: Query, function, its tables.
SPECS = {
    "op1_suffix_repetition": (repetition.repetition_rule, "documents"),
    "op2_imatch_fingerprint": (imatch.imatch_digest, "documents"),
    "op3_secret_scan": (secret_scan.secret_digest, "documents"),
    "op4_source_mixing": (mixing.mix_digest, "documents"),
    "op5_mil_quality": (mil.quality_digest, "documents", "labels"),
    "op6_bpe_automaton": (bpe_automaton.bpe_digest, "documents"),
    "op7_jaccard_join": (jaccard_join.jaccard_classes, "documents"),
    "op8_language_id": (lang_id.lang_digest, "documents"),
    "op9_lbl_lm": (lbl_lm.lm_digest, "documents"),
    "op10_quote_linking": (quotes.link_quotes, "conversations"),
    "op11_embedding_whitening": (whitening.whitening_digest, "embeddings"),
    "op12_prefix_trie": (trie.trie_nodes, "conversations"),
    "op13_sketch_dedup": (sketch_dedup.near_duplicates, "documents"),
}

#: Query, the query that gives its rows, columns, SQL.
BASES = {
    "base_op1_repetition": (
        "op1_suffix_repetition",
        ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"],
        r"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
 x AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w WHERE len(ws) >= 5),
 k AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS five FROM x),
 g AS (SELECT doc_id, five FROM k GROUP BY doc_id, five HAVING count(*) > 1),
 r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT k.doc_id, unnest(generate_series(k.i, k.i + 4)) AS p FROM k JOIN g ON g.doc_id = k.doc_id AND g.five = k.five) GROUP BY doc_id)
SELECT l.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
 CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
 CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(ws) < 10 OR 100 * coalesce(r.n, 0) > 20 * len(ws) AS base_failed FROM l LEFT JOIN r ON r.doc_id = l.doc_id""",
    ),
    "base_op2_imatch": (
        "op2_imatch_fingerprint",
        ["doc_id", "n_chars", "edited_sha256"],
        """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), n AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first(t) OVER (ORDER BY doc_id DESC)) AS nxt FROM d)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 2) || substr(nxt, 1, length(t) // 2)) AS edited_sha256 FROM n""",
    ),
    "base_op3_secrets": (
        "op3_secret_scan",
        ["doc_id", "n_assign", "n_access", "n_hex"],
        r"""SELECT doc_id,
 CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 8)) AS BIGINT) AS n_assign,
 CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS BIGINT) AS n_access,
 CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 32)) AS BIGINT) AS n_hex FROM documents""",
    ),
    "base_op4_mixing": (
        "op4_source_mixing",
        ["doc_id", "size", "source_size"],
        r"""WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents)
SELECT doc_id, size, CAST(sum(size) OVER (PARTITION BY source) AS BIGINT) AS source_size FROM s""",
    ),
    "base_op11_whitening": (
        "op11_embedding_whitening",
        ["vec_id", "component", "n", "deviation"],
        """WITH x AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT) + 1000000) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
 f AS (SELECT DISTINCT x FROM x), n AS (SELECT count(*) AS n FROM f),
 s AS (SELECT i, sum(v) AS s FROM (SELECT unnest(x) AS v, unnest(range(len(x))) AS i FROM f) GROUP BY i),
 d AS (SELECT r, vec_id, sum((n * v - s) * (n * v - s)) AS deviation FROM (SELECT r, vec_id, unnest(x) AS v, unnest(range(len(x))) AS i FROM x) JOIN s USING (i), n GROUP BY r, vec_id)
SELECT vec_id, CAST(component AS INTEGER) AS component, CAST(n AS BIGINT) AS n, CAST(deviation AS BIGINT) AS deviation FROM d, n, range(1, 17) t(component)""",
    ),
}

#: Whole results in SQL.
WHOLE = {
    "op12_prefix_trie": """WITH RECURSIVE ct AS (SELECT i AS b, CAST(i AS BIGINT) AS v, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM ct WHERE k < 8),
 tab AS (SELECT list(v ORDER BY b) AS tab FROM ct WHERE k = 8),
 conv AS (SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
 h AS (SELECT c, turns, CAST(xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
   lambda a, b: xor(a >> 8, tab[CAST((xor(a, b) & 255) + 1 AS INTEGER)]))) % 9 AS INTEGER) AS h FROM conv, tab),
 reb AS (SELECT h.c, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN conv b ON b.c = h.c - h.c % 5),
 mem AS (SELECT c, d, turns[1:d] AS p, len(turns) = d AS e FROM (SELECT c, turns, unnest(range(len(turns) + 1)) AS d FROM reb)),
 node AS (SELECT p, d, min(c) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (e), '')) AS ends FROM mem GROUP BY p, d),
 tree AS (SELECT x.*, q.conv_id AS parent FROM node x LEFT JOIN node q ON x.d > 0 AND q.d = x.d - 1 AND q.p = x.p[1:x.d - 1]),
 kids AS (SELECT parent AS conv_id, d - 1 AS d, count(*) AS k FROM tree WHERE d > 0 GROUP BY ALL),
 own AS (SELECT t.*, coalesce(k, 0) AS k, CASE WHEN t.d > 0 THEN (n - 1) * strlen(p[t.d].t) ELSE 0 END AS bytes FROM tree t LEFT JOIN kids USING (conv_id, d)),
 sub AS (SELECT a.d AS d, p[1:a.d] AS p, sum(bytes) AS saved, count(*) FILTER (k = 0) AS leaves FROM (SELECT p, bytes, k, unnest(range(d + 1)) AS d FROM own) a GROUP BY ALL)
SELECT conv_id, CAST(own.d AS BIGINT) AS depth, parent AS parent_conv_id, n AS n_convs, k AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends AS ends_sha256
FROM own JOIN sub ON sub.d = own.d AND sub.p = own.p""",
    "op13_sketch_dedup": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS sh FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
 e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
 b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
 r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT b.v, r.c FROM r JOIN b ON b.u = r.d)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, g.c AS component_id, g.c = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) g ON g.d = w.doc_id""",
}


def _query(f: Callable, *names: str) -> Callable:
    return lambda spark, sf_dir: f(*(table(spark, sf_dir, n) for n in names))


def queries() -> dict[str, Callable]:
    out = {k: _query(*spec) for k, spec in SPECS.items()}
    part = lambda own, columns: lambda spark, sf_dir: own(spark, sf_dir).select(*map(F.col, columns))  # noqa: E731
    return out | {k: part(out[own], columns) for k, (own, columns, _) in BASES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, _, sql) in BASES.items()} | WHOLE
