"""Suggested clusters and the outliers of each concept list: over the corpus, by value, over time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvida.operators import clusters
from corvida.operators import concepts as C
from corvida.plans import oracle_reports as O
from corvida.plans.reports import SLICE, SUBSET, Reports
from corvida.plans.texts import concept_vectors, query
from corvida.session import ready, stored

_SUBSET, _SLICE = O._SUBSET, O._SLICE
_FIELDS = "(SELECT DISTINCT doc_id, field FROM subsets) f"
Scope = Callable[[Reports], DataFrame]


def _by_field(r: Reports) -> DataFrame:
    return r.subsets.select("doc_id", "field").distinct()


# -- clusters ---------------------------------------------------------------------------------


def _clusters_sql(volume: str, keys: str) -> str:
    """WITH clauses up to ``best``: the same steps in SQL, one table for each."""
    k, using = (f"{keys}, ", keys) if keys else ("one, ", "one")
    part = f"PARTITION BY {using}"
    like = "round(list_cosine_similarity(vector, v), 9)"
    steps = [
        "names AS (SELECT p_name AS term, row_number() OVER (ORDER BY p_name) - 1 AS vec_id FROM (SELECT DISTINCT p_name FROM part))",
        "vecs AS (SELECT term AS concept, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM names JOIN embeddings USING (vec_id))",
        f"vol AS MATERIALIZED ({volume})",
        f"r AS MATERIALIZED (SELECT {k}concept, list_transform(x, lambda y: y / sqrt(list_dot_product(x, x))) AS vector, relevance AS weight FROM (SELECT *, 1 AS one FROM vol) JOIN vecs USING (concept))",
        f"s0 AS MATERIALIZED (SELECT {k}0 AS c, vector AS v FROM r QUALIFY row_number() OVER ({part} ORDER BY weight DESC, concept) = 1)",
    ]
    for i in range(1, clusters.K):
        far = f"SELECT {k}concept, any_value(vector) AS v, max({like}) AS l FROM r JOIN s{i - 1} USING ({using}) GROUP BY {k}concept"
        steps.append(f"s{i} AS MATERIALIZED (SELECT * FROM s{i - 1} UNION ALL SELECT {k}{i}, v FROM (SELECT * FROM ({far}) WHERE l < 1 QUALIFY row_number() OVER ({part} ORDER BY l, concept) = 1))")
    centres = f"s{clusters.K - 1}"
    for i in range(clusters.ROUNDS + 1):
        steps.append(f"p{i} AS MATERIALIZED (SELECT {k}concept, vector, c, {like} AS l FROM r JOIN {centres} USING ({using}) QUALIFY row_number() OVER (PARTITION BY {k}concept ORDER BY l DESC, c) = 1)")
        steps.append(f"mean{i} AS MATERIALIZED (SELECT {k}c, list(x ORDER BY i) AS v FROM (SELECT {k}c, i, avg(vector[i]) AS x FROM p{i}, range(1, 65) t(i) GROUP BY ALL) GROUP BY {k}c)")
        centres = f"mean{i}"
    w = f"PARTITION BY {k}c ORDER BY l DESC, concept"
    best = f"best AS (SELECT {k if keys else ''}c AS cluster, first(concept) OVER ({w}) AS cluster_label, (row_number() OVER ({w}))::INT AS rank, concept, round(l, 5) AS score FROM p{clusters.ROUNDS} QUALIFY rank <= {clusters.NEAREST})"
    return f"WITH {O.BASE}, {', '.join(steps)}, {best}"


def _clustered(r: Reports, scope: DataFrame | None, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The clusters of each key's concepts, heaviest by relevance there, and the concepts' volume."""
    volume = stored(C.volume(r.found, scope, r.n_docs, keys), "volume")  # a row for each key and concept; met again by the callers
    rows = volume.withColumn("weight", F.col("relevance")).join(concept_vectors(r).withColumnRenamed("term", "concept"), "concept")
    return clusters.suggested(rows, keys), volume


@query(f"{_clusters_sql(O._volume('no_keys', ''), '')} SELECT cluster, cluster_label, rank, concept AS term, score FROM best")
def clusters_suggested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven clusters of concept vectors, of each the four nearest its centre; the nearest gives the label."""
    return _clustered(Reports(ready(spark), sf_dir), None, ())[0].withColumnRenamed("concept", "term")


def _volumes(name: str, doc: str, scope: Scope, scope_sql: str, keys: tuple[str, ...], extra: str | None = None) -> None:
    keys_sql = ", ".join(keys)

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = Reports(ready(spark), sf_dir)
        found, volume = _clustered(r, scope(r), keys)
        out = found.join(volume, [*keys, "concept"])
        return out if extra is None else out.withColumn("value", F.lit(extra))

    build.__doc__ = doc
    more = "" if extra is None else f", '{extra}' AS value"
    query(f"{_clusters_sql(O._volume(scope_sql, keys_sql), keys_sql)} SELECT *{more} FROM best JOIN vol USING ({keys_sql}, concept)", name)(build)


_volumes("volume_subsets_clusters", "The volume of the suggested clusters' concepts by field value.", lambda r: r.subsets, "subsets", SUBSET)
_volumes("volume_subsets_all_clusters", "The same over all values of a field.", _by_field, _FIELDS, ("field",), "_all_")
_volumes("volume_over_time_clusters", "The same by month.", lambda r: r.in_slices("M"), "month_docs", SLICE)


def _drivers(name: str, doc: str, scope: Scope | None, scope_sql: str, keys: tuple[str, ...]) -> None:
    keys_sql = ", ".join(keys)
    on = f"{keys_sql}, concept" if keys else "concept"

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = Reports(ready(spark), sf_dir)
        inside = scope(r) if scope else None
        found, _ = _clustered(r, inside, keys)
        return found.join(C.drivers(r.found, r.scores(inside), ("driver_field", *keys)), [*keys, "concept"])

    build.__doc__ = doc
    query(f"{_clusters_sql(O._volume(scope_sql, keys_sql), keys_sql)} SELECT * FROM best JOIN ({O._drivers(scope_sql, keys_sql)}) d USING ({on})", name)(build)


_drivers("drivers_clusters", "The score drivers among the suggested clusters' concepts.", None, "no_keys", ())
_drivers("drivers_subsets_clusters", "The same by field value.", lambda r: r.subsets, "subsets", SUBSET)
_drivers("drivers_over_time_clusters", "The same by month.", lambda r: r.in_slices("M"), "month_docs", SLICE)


# -- outliers of each list --------------------------------------------------------------------

LIMIT = 20


def outliers_of_lists(found: DataFrame, listed: DataFrame, names: DataFrame, scope: DataFrame, docs: DataFrame, n_docs: int, keys: tuple[str, ...], match_type: str = "both") -> DataFrame:
    """Of each list and key: the concepts more frequent in the documents that no concept of the list
    matches than in the corpus, the first LIMIT by G2, with the list's coverage of the whole corpus.

    match_type ``exact``: only exact matches of the list's concepts cover a document. A list that covers all
    has no row; one that covers nothing has coverage 0, and where it leaves all documents of the corpus no
    concept is more frequent than there, so it has none either."""
    covered = listed if match_type == "both" else listed.where("exact = 1")
    out = C.outside(found, covered, names, scope, keys)
    rows = out.join(C.corpus_counts(found), "concept")
    a, row, n, n0 = F.col("exact_match_count").cast("double"), F.col("df0").cast("double"), F.col("filter_count").cast("double"), F.lit(float(n_docs))
    rows = rows.where(a * n0 > row * n).withColumn("g2", F.round(C.g2(a, row, n, n0), 4))
    seen = covered.select("doc_id", "list").distinct().join(docs.select("doc_id"), "doc_id", "left_semi").groupBy("list").agg(F.count(F.lit(1)).alias("covered"))
    share = names.select("list").distinct().join(seen, "list", "left").select("list", F.round(100.0 * F.coalesce("covered", F.lit(0)) / F.lit(n_docs), 4).alias("coverage"))
    best = C.ranked(rows, (*keys, "list"), "g2", LIMIT)
    conceptual = (F.col("match_count") - F.col("exact_match_count")).alias("conceptual_match_count")
    return best.join(share, "list").select("list", *keys, "concept", F.lit(match_type).alias("match_type"), "filter_count", "match_count", "exact_match_count", conceptual, "g2", "rank", "coverage")


def _outliers_sql(scope: str, keys: str) -> str:
    k = f"{keys}, list"
    cell = lambda o, r, c: f"CASE WHEN {o} > 0 THEN {o} * ln({o} * n0 / ({r} * {c})) ELSE 0 END"
    g2 = " + ".join(cell(*x) for x in (("a", "b", "nn"), ("(nn - a)", "(n0 - b)", "nn"), ("(b - a)", "b", "(n0 - nn)"), ("(n0 - nn - b + a)", "(n0 - b)", "(n0 - nn)")))
    return f"""WITH {O.BASE}, lists AS (SELECT DISTINCT list FROM lt), cov AS MATERIALIZED (SELECT DISTINCT doc_id, list FROM listed),
      out AS MATERIALIZED (SELECT s.*, list FROM {scope} s CROSS JOIN lists ANTI JOIN cov USING (doc_id, list)),
      size AS (SELECT {k}, count(*) AS filter_count FROM out GROUP BY ALL), counts AS (SELECT {k}, concept, count(*) AS match_count, count(*) FILTER (exact = 1) AS exact_match_count FROM out JOIN found USING (doc_id) GROUP BY ALL),
      x AS (SELECT {k}, concept, filter_count, match_count, exact_match_count, exact_match_count::DOUBLE AS a, df0::DOUBLE AS b, filter_count::DOUBLE AS nn, n0::DOUBLE AS n0 FROM counts JOIN size USING ({k}) JOIN df0 USING (concept) CROSS JOIN n),
      share AS (SELECT list, round(100.0 * count(o_orderkey) / (SELECT count(*) FROM orders), 4) AS coverage FROM lists LEFT JOIN (SELECT o_orderkey, list FROM orders JOIN cov ON doc_id = o_orderkey) USING (list) GROUP BY 1)
      SELECT {k}, concept, 'both' AS match_type, filter_count, match_count, exact_match_count, match_count - exact_match_count AS conceptual_match_count, g2, rank, coverage
      FROM (SELECT *, (row_number() OVER (PARTITION BY {k} ORDER BY g2 DESC, concept))::INT AS rank FROM (SELECT *, round(2 * ({g2}), 4) AS g2 FROM x WHERE a * n0 > b * nn)) JOIN share USING (list) WHERE rank <= {LIMIT}"""


def _outliers(name: str, doc: str, scope: Scope, scope_sql: str, keys: tuple[str, ...]) -> None:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = Reports(ready(spark), sf_dir)
        return outliers_of_lists(r.found, r.listed(), r.star.list_terms(), scope(r), r.docs, r.n_docs, keys)

    build.__doc__ = doc
    query(_outliers_sql(scope_sql, ", ".join(keys)), name)(build)


_outliers("outliers_lists", "Concepts of the documents that each shared list leaves out.", lambda r: r.docs.select("doc_id", F.lit("outliers").alias("special")), "(SELECT doc_id, 'outliers' AS special FROM docs)", ("special",))
_outliers("outlier_subsets_lists", "The same by field value.", lambda r: r.subsets, "subsets", SUBSET)
_outliers("outliers_over_time_lists", "The same by month.", lambda r: r.in_slices("M"), "month_docs", SLICE)
