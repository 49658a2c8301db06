"""Queries over what is built from texts: an index that is searched, term vectors, batches in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvida.operators import numbering, search
from corvida.operators import term_vectors as TV
from corvida.plans.texts import _docs, _table, query
from corvida.session import ready, scratch_path

# -- document search --------------------------------------------------------------------------

_EXACT, _RELATED = ("die", "idiot"), {"der": 0.5, "que": 0.25, "les": 0.25}


def _sql(exact: tuple[str, ...], related: dict[str, float], match: str, limit: int | None) -> str:
    weights = ", ".join(f"('{t}', {w}::DOUBLE)" for t, w in {**dict.fromkeys(exact, 1.0), **related}.items())
    named = ", ".join(f"'{t}'" for t in exact)
    keep = {"exact": "WHERE named", "conceptual": "WHERE NOT named", "both": ""}[match]
    return rf"""WITH s(term, w) AS (VALUES {weights}), t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM documents),
      tf AS (SELECT doc_id, term, count(*) AS tf FROM t JOIN s USING (term) GROUP BY ALL), df AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
      r AS (SELECT doc_id, round(sum(tf * idf * w), 6) AS score, bool_or(term IN ({named})) AS named FROM tf JOIN df USING (term) JOIN s USING (term) GROUP BY 1)
      SELECT doc_id, CASE WHEN named THEN 'exact' ELSE 'conceptual' END AS match, score FROM r {keep} {f'ORDER BY score DESC, doc_id LIMIT {limit}' if limit else ''}"""


def _index(spark: SparkSession, sf_dir: str) -> search.Index:
    return search.build(_docs(spark, sf_dir), block=64)


@query(_sql(_EXACT, {}, "exact", 100))
def search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred best documents with one of the words."""
    return _index(spark, sf_dir).search(list(_EXACT), _RELATED, 100, "exact")


@query(_sql(_EXACT, _RELATED, "conceptual", 100))
def search_conceptual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred best that have related words only."""
    return _index(spark, sf_dir).search(list(_EXACT), _RELATED, 100, "conceptual")


@query(_sql(_EXACT, _RELATED, "both", 100))
def search_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred best with either."""
    return _index(spark, sf_dir).search(list(_EXACT), _RELATED, 100, "both")


@query(rf"""WITH x AS ({_sql(_EXACT, _RELATED, 'both', None)}) SELECT d.doc_id, d.lang, d.source FROM documents d JOIN x USING (doc_id) WHERE d.lang = 'de'
    UNION ALL SELECT d.doc_id, d.lang, d.source FROM documents d JOIN ({_sql(('idiot',), {}, 'exact', None)}) y USING (doc_id) WHERE d.lang = 'en'""")
def documents_copied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that pass a filter and a search, copied to a new table, then more of them onto it."""
    docs, index, path = _table(spark, sf_dir, "documents"), _index(spark, sf_dir), scratch_path(spark, "copied")
    search.copied(docs, path, F.col("lang") == "de", index.search(list(_EXACT), _RELATED))
    return search.copied(docs, path, F.col("lang") == "en", index.search(["idiot"], match_type="exact"), "append").select("doc_id", "lang", "source")


# -- terms and vectors ------------------------------------------------------------------------


@query(r"""WITH d AS (SELECT regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') AS w FROM documents), x AS (SELECT w, unnest(list_distinct(w)) AS t FROM d),
    v AS (SELECT t, count(*) AS df FROM x GROUP BY 1 HAVING count(*) >= 40), p AS (SELECT w[i] AS a, w[i + k] AS b FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM d), range(1, 6) r(k) WHERE i + k <= len(w)),
    q AS (SELECT a, b FROM p SEMI JOIN v va ON va.t = a SEMI JOIN v vb ON vb.t = b), n AS (SELECT a, b, count(*) AS n FROM (SELECT a, b FROM q UNION ALL SELECT b, a FROM q) GROUP BY ALL),
    s AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS total FROM n)
    SELECT a AS term, b AS other, n, round(ln(n::DOUBLE * total / (na::DOUBLE * nb)), 6) AS ppmi FROM s WHERE n::DOUBLE * total > na::DOUBLE * nb""")
def term_ppmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much more often than by chance terms of 40 documents or more stand within five words of each other."""
    docs = _docs(spark, sf_dir)
    terms = TV.stored(TV.vocabulary(docs, least=40), "vocabulary")
    rows = TV.ppmi(TV.stored(TV.neighbours(docs, terms), "neighbours"))
    name = lambda c, to: F.broadcast(terms.select(F.col("id").alias(c), F.col("term").alias(to)))  # noqa: E731  as many as the vocabulary's bound
    return rows.join(name("a", "term_"), "a").join(name("b", "other"), "b").select(F.col("term_").alias("term"), "other", "n", F.round("ppmi", 6).alias("ppmi"))


@query()
def term_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for each term."""
    return TV.build(_docs(spark, sf_dir)).select("term", "df", F.transform("vector", lambda x: F.round(x, 4)).alias("vector"))


@query()
def term_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten terms nearest to each of the fifty commonest, by the built vectors."""
    built = TV.build(_docs(spark, sf_dir))
    return TV.nearest(built, built.orderBy(F.desc("df"), "term").limit(50))


@query()
def document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit-normalised mean of each document's term vectors."""
    docs = _docs(spark, sf_dir)
    return TV.of_documents(docs, TV.build(docs)).select("doc_id", "n", F.transform("vector", lambda x: F.round(x, 4)).alias("vector"))


# -- batches in order -------------------------------------------------------------------------


@query("SELECT o_orderkey AS doc_id, o_orderdate AS date, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 400 AS batch FROM orders")
def date_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by date in batches of equal size."""
    rows = _table(ready(spark), sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("date"))
    return numbering.numbered(rows, "date", "doc_id", name="n").select("doc_id", "date", F.expr("(n - 1) div 400").alias("batch"))
