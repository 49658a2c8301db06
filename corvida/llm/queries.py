"""The queries of this subpackage: each operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvida.llm import alignment, decontamination, divergence, exact_dedup, language_id, lm_scoring, mixing, ngram_join, packing, sharding, substring_dedup, token_binary, toxicity
from corvida.session import ready


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_components(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.token_files(_table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(_table(spark, sf_dir, "documents"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_packing": op2_packing,
    "op3_decontamination": op3_decontamination,
    "op4_ngram_join": op4_ngram_join,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_token_binary": op7_token_binary,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_language_id": op9_language_id,
    "op10_sharding": op10_sharding,
    "op11_mixing": op11_mixing,
    "op12_alignment": op12_alignment,
    "op13_divergence": op13_divergence,
}

_SPACES = r"[\x20\x09-\x0D]+"

_WORDS = r"[^\x20\x09-\x0D]+"

SQL: dict[str, str] = {
    "op1_substring_dedup": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
             s AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
             k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM s),
             r AS (SELECT k FROM k GROUP BY k HAVING count(*) > 1),
             g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM k JOIN r USING (k)),
             t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
             h AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.j) AS kept, count(*) AS n FROM t ANTI JOIN g ON t.doc_id = g.doc_id AND t.j = g.j GROUP BY t.doc_id)
        SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN h USING (doc_id)""",
    "op3_decontamination": rf"""
        WITH t AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
             w AS (SELECT row_number() OVER () AS k, kind, id, regexp_extract_all(lower(text), '{_WORDS}') AS w FROM t),
             s AS (SELECT DISTINCT k, kind, id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) >= 5),
             i AS (SELECT k, id, s, count(*) OVER (PARTITION BY k) AS n_item FROM s WHERE kind = 1),
             f AS (SELECT d.id AS doc_id, i.id AS item_id, i.n_item, count(*) AS n_shared FROM s d JOIN i ON d.kind = 0 AND d.s = i.s GROUP BY d.k, d.id, i.k, i.id, i.n_item)
        SELECT DISTINCT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM f WHERE n_shared >= 0.75 * n_item""",
    "op4_ngram_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents),
             s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                                       WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
             e AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS k FROM s GROUP BY doc_id),
             c AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY k) AS class_id FROM e),
             r AS (SELECT s.doc_id, s.s, c.n FROM s JOIN c ON s.doc_id = c.doc_id AND c.doc_id = c.class_id),
             l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM r a JOIN r b ON a.s = b.s AND a.doc_id < b.doc_id
                   GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
             m AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
             g AS (SELECT DISTINCT class_id AS node, class_id AS seen FROM c UNION SELECT g.node, m.b FROM g JOIN m ON g.seen = m.a),
             t AS (SELECT node, min(seen) AS component_id FROM g GROUP BY node)
        SELECT w.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(c.class_id, w.doc_id) AS class_id, coalesce(t.component_id, w.doc_id) AS component_id
        FROM w LEFT JOIN c ON w.doc_id = c.doc_id LEFT JOIN t ON c.class_id = t.node""",
    "op5_exact_dedup": rf"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACES}', ' ', 'g')) AS text_sha256 FROM documents),
             g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)""",
    "op11_mixing": rf"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) AS size,
                          md5('1:' || coalesce(doc_id::VARCHAR, '-' || md5(coalesce(text, '')))) AS place FROM documents),
             g AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
             s AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM g),
             o AS (SELECT *, row_number() OVER w AS pos, coalesce(sum(2 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
                          sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free, sum(source_size) OVER () AS total
                   FROM s WINDOW w AS (ORDER BY source_size::DOUBLE / weight, source)),
             v AS (SELECT *, (1.5::DOUBLE * total - held) / free::DOUBLE AS level FROM o),
             l AS (SELECT arg_min(level, pos) AS level FROM v WHERE level * weight <= 2 * source_size),
             t AS (SELECT source, source_size, least(weight * coalesce((SELECT level FROM l), 1e300), 2 * source_size)::DOUBLE AS target FROM s),
             c AS (SELECT d.*, (sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS first FROM d),
             f AS (SELECT c.*, source_size, target, floor(target)::BIGINT AS words FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               (CASE WHEN source_size = 0 THEN 0 ELSE words // source_size * size + greatest(0, least(size, words % source_size - first)) END)::BIGINT AS taken FROM f""",
    "op13_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
             t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
             k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
             c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
             v AS (SELECT lang, count(*) AS v, sum(total) AS lang_size FROM k GROUP BY lang),
             s AS (SELECT lang, source, sum(n) AS size FROM c GROUP BY lang, source),
             g AS (SELECT DISTINCT d.lang, d.source, coalesce(size, 0) AS size, coalesce(v, 0) AS v, lang_size FROM d LEFT JOIN s USING (lang, source) LEFT JOIN v USING (lang)),
             m AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (size + v) AS p, 1 + (1000000000::HUGEINT * (total + 1)) // (lang_size + v) AS q
                   FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
             f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM m a JOIN m b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
             u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                   LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
                   UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM m WHERE n > 0 AND p > q),
             o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM u)
        SELECT * FROM o WHERE part = 'pair' OR rank <= 200""",
}
