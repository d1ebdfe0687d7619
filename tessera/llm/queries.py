"""The registered queries of this subpackage: name -> (query, SQL for the same rows or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import ann, bpe, decontaminate, jaccard, licenses, packing, ranked, sharding, substring_dedup, suffix_dedup, toxicity, variants, vec_dedup

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(table(spark, sf_dir, "documents"))


def op3_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_adaptive_scan_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.digest(table(spark, sf_dir, "embeddings"))


def op5_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"))


def op9_cross_polytope_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vec_dedup.digest(table(spark, sf_dir, "embeddings"))


def op10_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.digest(table(spark, sf_dir, "documents"))


def op11_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_pair_bound_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.digest(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, p, list_slice(w, p, p + 19) AS win
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS p FROM words)
), ranked AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS r FROM windows
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(p, p + 19)) AS p FROM ranked WHERE r > 1
), each AS (
  SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM words
), kept AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.p) FILTER (g.p IS NULL) AS t, count(g.p) AS n_removed
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id
), spans AS (
  SELECT doc_id, count(*) AS n_spans
  FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM gone)
  WHERE before IS NULL OR p > before + 1 GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256, CAST(coalesce(s.n_spans, 0) AS BIGINT) AS n_spans
FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id LEFT JOIN spans s ON w.doc_id = s.doc_id
"""

def _templates() -> str:
    rows = []
    for base, group in ((True, licenses.PHRASES), (False, licenses.NOTICES)):
        for label, text in group.items():
            w = licenses.template_words(text)
            rows += [f"('{label}', {base}, {t}, '{w[t]}', '{w[t + 1]}', {len(w) - 1})" for t in range(len(w) - 1)]
    return "(VALUES " + ", ".join(rows) + ") AS x(label, base, t, w1, w2, n)"


OP7_SQL = (
    r"""
WITH tmpl AS (SELECT * FROM """
    + _templates()
    + r"""
), words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), grams AS (
  SELECT doc_id, p, w[p + 1] AS a, w[p + 2] AS b FROM (SELECT doc_id, w, unnest(generate_series(0, len(w) - 2)) AS p FROM words)
), met AS (
  SELECT g.doc_id, m.label, m.base, m.n, m.t, g.p, g.p - m.t AS d FROM grams g JOIN tmpl m ON g.a = m.w1 AND g.b = m.w2
), diagonals AS (
  SELECT DISTINCT doc_id, label, base, d FROM met
), apart AS (
  SELECT *, CASE WHEN base OR d - lag(d) OVER o <= """
    + str(licenses.NEIGHBOUR)
    + r""" AND NOT base THEN CAST(base AS INT) ELSE 1 END AS new FROM diagonals WINDOW o AS (PARTITION BY doc_id, label ORDER BY d)
), runs AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id, label ORDER BY d) AS run FROM apart
), spans AS (
  SELECT m.doc_id, m.label, m.base, min(m.d) AS d, count(DISTINCT m.t) / any_value(m.n) AS share, count(DISTINCT m.t) = any_value(m.n) AS whole
  FROM met m JOIN runs r ON m.doc_id = r.doc_id AND m.label = r.label AND m.d = r.d GROUP BY m.doc_id, m.label, m.base, r.run
), found AS (
  SELECT doc_id, count(*) FILTER (base AND whole) AS n_base, min(d) FILTER (base AND whole) AS first_word, max(d) FILTER (base AND whole) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND whole) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND whole OR NOT base AND share >= """
    + str(licenses.SHARE)
    + r""") AS labels, max(share) AS score
  FROM spans GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(f.n_base, 0) AS BIGINT) AS n_base, CAST(f.first_word AS BIGINT) AS first_word,
       CAST(f.last_word AS BIGINT) AS last_word, coalesce(f.base_labels, '') AS base_labels, coalesce(f.labels, '') AS labels, coalesce(f.score, 0.0) AS score
FROM words w LEFT JOIN found f ON w.doc_id = f.doc_id
"""
)

OP9_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT v.vec_id, CAST((SELECT count(*) FROM links WHERE a = v.vec_id) AS BIGINT) AS n_links,
       min(r.b) AS component_id, v.vec_id = min(r.b) AS kept
FROM v JOIN reach r ON r.a = v.vec_id GROUP BY v.vec_id
"""

OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, list_slice(w, p, p + 3) AS s
    FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS p FROM words WHERE len(w) > 0))
), n AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT r.a AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM reach r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""

OP11_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, list_slice(w, p, p + least(len(w), 10) - 1) AS win, least(len(w), 10) AS m
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS p FROM items WHERE len(w) > 0)
), places AS (
  SELECT doc_id, p, m, list_slice(w, p, p + m - 1) AS win
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS p FROM words, (SELECT DISTINCT m FROM windows))
), met AS (
  SELECT d.doc_id, d.p, d.m, i.item FROM places d JOIN windows i ON d.win = i.win
), hit AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(generate_series(p, p + m - 1)) AS q FROM met) GROUP BY doc_id
), own AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(o.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(o.items, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
FROM words w LEFT JOIN hit h ON w.doc_id = h.doc_id LEFT JOIN own o ON w.doc_id = o.doc_id
"""

OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark
), totals AS (
  SELECT count(*) AS docs, sum(len(w)) AS terms FROM words WHERE len(w) > 0
), occurrences AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM words)
  WHERE term IN (SELECT term FROM items) GROUP BY doc_id, n, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS weight
  FROM (SELECT term, count(*) AS df FROM occurrences GROUP BY term), totals
), scores AS (
  SELECT i.item_id, o.doc_id, CAST(sum(x.weight * ((1000000000 * o.tf) // (1000 * o.tf + 20 * (50 + (50 * o.n * t.docs) // t.terms)))) AS BIGINT) AS score
  FROM items i JOIN occurrences o ON i.term = o.term JOIN weights x ON x.term = i.term CROSS JOIN totals t GROUP BY i.item_id, o.doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""

OP13_SQL = (
    r"""
WITH RECURSIVE crc AS (
  SELECT """
    + str(variants.CRC.tolist())
    + r""" AS t
), runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) WHERE length(run) >= 5
), hashed AS (
  SELECT run, k, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id || ':' || run, ''),
           lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) AS BIGINT) - 64] END))),
           lambda s, b: xor(t[(xor(s, b) & 255) + 1], s >> 8)), 4294967295) AS h
  FROM (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY doc_id, run), crc
), vocab AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), shorter AS (
  SELECT word, n, p, left(word, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS p FROM vocab)
), near AS (
  SELECT a.word, b.word AS other FROM shorter a JOIN shorter b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word FROM shorter a JOIN vocab b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM shorter a JOIN vocab b ON a.rest = b.word
), best AS (
  SELECT e.word, count(*) AS n_near, arg_min(e.other, {'less': -v.n, 'word': e.other}) AS form, max(v.n) AS form_n FROM near e JOIN vocab v ON v.word = e.other GROUP BY e.word
), forms AS (
  SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= 2 * v.n THEN b.form END AS form, CASE WHEN b.form_n >= 2 * v.n THEN b.form_n END AS form_n
  FROM vocab v LEFT JOIN best b ON b.word = v.word
), chain AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain c ON c.word = f.word JOIN forms l ON l.word = c.root WHERE l.form IS NULL
"""
)

REGISTRY: dict[str, tuple[Query, str | None]] = {
    "op1_suffix_dedup": (op1_suffix_dedup, None),
    "op2_best_fit_packing": (op2_best_fit_packing, None),
    "op3_toxicity_lexicon": (op3_toxicity_lexicon, None),
    "op4_adaptive_scan_ann": (op4_adaptive_scan_ann, None),
    "op5_external_shuffle": (op5_external_shuffle, None),
    "op6_substring_dedup": (op6_substring_dedup, OP6_SQL),
    "op7_license_scan": (op7_license_scan, OP7_SQL),
    "op8_byte_bpe": (op8_byte_bpe, None),
    "op9_cross_polytope_dedup": (op9_cross_polytope_dedup, OP9_SQL),
    "op10_token_group_join": (op10_token_group_join, OP10_SQL),
    "op11_wu_manber_decontamination": (op11_wu_manber_decontamination, OP11_SQL),
    "op12_pair_bound_maxscore": (op12_pair_bound_maxscore, OP12_SQL),
    "op13_spelling_variants": (op13_spelling_variants, OP13_SQL),
}
