"""Further kinds of the reports: lists, suggested by sentiment, distinctive, over all values of a
field, with example documents, for given concepts; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvida.operators import concepts as C
from corvida.operators import lexicon
from corvida.plans import oracle_reports as O
from corvida.plans.reports import LIST_KEYS, SLICE, SUBSET, TOP, Reports, sentiment_top, unique_to_filter, volume_subsets
from corvida.plans.tables import query

_LISTS, _SUBSET, _SLICE = "list, concept", "field, value", O._SLICE
_FIELDS = "(SELECT DISTINCT doc_id, field FROM subsets) f"
_LIST_SENTI = "(SELECT doc_id, list, concept, min_by(sentiment, pos) AS sentiment FROM t JOIN lt USING (term) GROUP BY 1, 2, 3) ls"
SUGGESTED = 500


def _per_field(r: Reports) -> DataFrame:
    """doc_id, field: a document counts once for each field, whatever values it has."""
    return r.subsets.select("doc_id", "field").distinct()


def _all(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.lit("_all_"))


# -- volume -----------------------------------------------------------------------------------


@query(f"""SELECT list, concept, coalesce(match_count, 0) AS match_count, coalesce(exact_match_count, 0) AS exact_match_count, coalesce(conceptual_match_count, 0) AS conceptual_match_count,
    n0 AS total_count, coalesce(relevance, 0) AS relevance FROM (SELECT DISTINCT list, concept FROM lt) LEFT JOIN ({O._volume('no_keys', '', 'listed', _LISTS)}) v USING (list, concept) CROSS JOIN n""")
def volume_lists(r: Reports) -> DataFrame:
    """Every concept of the lists, those without a match too."""
    every = r.star.list_terms().select(*LIST_KEYS).distinct()
    rows = every.join(C.volume(r.listed(), None, r.n_docs, by=LIST_KEYS), list(LIST_KEYS), "left")
    return rows.fillna(0, ["match_count", "exact_match_count", "conceptual_match_count", "relevance"]).fillna(r.n_docs, ["total_count"])


@query(O._volume("subsets", _SUBSET, "listed", _LISTS))
def volume_subsets_lists(r: Reports) -> DataFrame:
    return C.volume(r.listed(), r.subsets, r.n_docs, SUBSET, LIST_KEYS)


@query(O._volume("month_docs", _SLICE, "listed", _LISTS))
def volume_over_time_lists(r: Reports) -> DataFrame:
    return C.volume(r.listed(), r.in_slices("M"), r.n_docs, SLICE, LIST_KEYS)


def _by_sentiment(found: DataFrame, scope: DataFrame | None, keys: tuple[str, ...], limit: int) -> DataFrame:
    """The concepts with most positive or negative documents."""
    rows = C.sentiment(found, scope, keys).withColumn("polar_count", F.col("positive_count") + F.col("negative_count"))
    return C.ranked(rows, keys, "polar_count", limit).select(*keys, "concept", "polar_count", "rank")


def _by_sentiment_sql(scope: str, keys: str, limit: int) -> str:
    k = f"{keys}, " if keys else ""
    rows = f"SELECT *, positive_count + negative_count AS polar_count FROM ({O._sentiment(scope, keys)})"
    return f"SELECT {k}concept, polar_count, rank FROM ({O._top(rows, keys, 'polar_count', limit)})"


@query(f"SELECT * FROM ({_by_sentiment_sql('no_keys', '', SUGGESTED)}) s JOIN ({O._volume('no_keys', '')}) v USING (concept)")
def sentiment_suggested(r: Reports) -> DataFrame:
    """The concepts with most positive or negative documents, with their volume."""
    return _by_sentiment(r.with_sentiment(), None, (), SUGGESTED).join(C.volume(r.found, None, r.n_docs), "concept")


@query(f"SELECT * FROM ({_by_sentiment_sql('subsets', _SUBSET, TOP)}) s JOIN ({O._volume('subsets', _SUBSET)}) v USING (field, value, concept)")
def volume_subsets_sentiment(r: Reports) -> DataFrame:
    return _by_sentiment(r.with_sentiment(), r.subsets, SUBSET, TOP).join(C.volume(r.found, r.subsets, r.n_docs, SUBSET), [*SUBSET, "concept"])


@query(f"SELECT * FROM ({_by_sentiment_sql('month_docs', _SLICE, TOP)}) s JOIN ({O._volume('month_docs', _SLICE)}) v USING ({_SLICE}, concept)")
def volume_over_time_sentiment(r: Reports) -> DataFrame:
    scope = r.in_slices("M")
    return _by_sentiment(r.with_sentiment(), scope, SLICE, TOP).join(C.volume(r.found, scope, r.n_docs, SLICE), [*SLICE, "concept"])


@query(f"SELECT u.field, u.value, u.concept, g2, u.rank, v.* EXCLUDE (field, value, concept) FROM ({O._top(O._unique('subsets', _SUBSET), _SUBSET, 'g2', TOP)}) u JOIN ({O._volume('subsets', _SUBSET)}) v USING (field, value, concept)")
def volume_subsets_unique(r: Reports) -> DataFrame:
    """The volume of the concepts that tell a value's documents from the others."""
    best = C.ranked(C.unique_to(r.found, r.subsets, r.n_docs, SUBSET), SUBSET, "g2", TOP).select(*SUBSET, "concept", "g2", "rank")
    return best.join(C.volume(r.found, r.subsets, r.n_docs, SUBSET), [*SUBSET, "concept"])


@query(f"""SELECT s.*, v.* EXCLUDE (concept) FROM (SELECT start_date, end_date, iteration_counter, range_type, o.concept, o.rank AS overall_rank FROM ({O._TOP}) o CROSS JOIN months) s
    JOIN ({O._volume('month_docs', _SLICE)}) v USING ({_SLICE}, concept)""".replace("s.*, v.* EXCLUDE (concept)", f"{_SLICE}, concept, overall_rank, match_count, exact_match_count, conceptual_match_count, total_count, relevance"))
def volume_over_time_overall(r: Reports) -> DataFrame:
    """The top concepts of the whole corpus, followed over the slices."""
    top = C.ranked(C.volume(r.found, None, r.n_docs), (), "relevance", TOP).select("concept", F.col("rank").alias("overall_rank"))
    return C.volume(r.found, r.in_slices("M"), r.n_docs, SLICE).join(F.broadcast(top), "concept")  # TOP rows


@query(f"SELECT concept, match_count, exact_match_count, rank FROM ({O._top(O._volume('no_keys', ''), '', 'match_count', 3)})")
def most_matched(r: Reports) -> DataFrame:
    """The three concepts with most documents."""
    return C.ranked(C.volume(r.found, None, r.n_docs), (), "match_count", 3).select("concept", "match_count", "exact_match_count", "rank")


GIVEN = ("Blue Ring", " blue bolt", "no such concept")


@query("SELECT g.concept, count(DISTINCT doc_id) AS match_count, count(DISTINCT CASE WHEN exact = 1 THEN doc_id END) AS exact_match_count FROM (VALUES ('blue ring'), ('blue bolt'), ('no such concept')) g(concept) LEFT JOIN found USING (concept) GROUP BY 1")
def given_concepts(r: Reports) -> DataFrame:
    """The volume of concepts given by their texts, which are compared without case and outer space; 0 if nothing matches."""
    given = r.spark.createDataFrame([(x,) for x in GIVEN], "text string").select(F.lower(F.trim("text")).alias("concept")).distinct()
    hits = C.matches(r.terms, r.concepts.join(F.broadcast(given), "concept", "left_semi"))  # as many rows as texts are given
    counts = C.volume(hits, None, r.n_docs).select("concept", "match_count", "exact_match_count")
    return given.join(counts, "concept", "left").fillna(0)


# -- sentiment --------------------------------------------------------------------------------


def _list_sentiment(r: Reports) -> DataFrame:
    return C.first_sentiments(r.terms, r.star.list_terms(), LIST_KEYS)


def _list_sentiment_sql(scope: str, keys: str) -> str:
    return O._sentiment(scope, keys).replace("concept, count(*)", "list, concept, count(*)", 1).replace("FROM senti JOIN", f"FROM {_LIST_SENTI} JOIN")


@query(_list_sentiment_sql("no_keys", ""))
def sentiment_lists(r: Reports) -> DataFrame:
    return C.sentiment(_list_sentiment(r), by=LIST_KEYS)


@query(_list_sentiment_sql("subsets", _SUBSET))
def sentiment_subsets_lists(r: Reports) -> DataFrame:
    return C.sentiment(_list_sentiment(r), r.subsets, SUBSET, LIST_KEYS)


@query(f"SELECT *, '_all_' AS value FROM ({O._sentiment(_FIELDS, 'field')})")
def sentiment_subsets_all(r: Reports) -> DataFrame:
    return _all(C.sentiment(r.with_sentiment(), _per_field(r), ("field",)))


@query(O._sentiment("week_docs", _SLICE))
def sentiment_over_time_week(r: Reports) -> DataFrame:
    return C.sentiment(r.with_sentiment(), r.in_slices("W"), SLICE)


@query(f"SELECT concept, round(positive_count / sentiment_total - negative_count / sentiment_total, 6) AS net_sentiment FROM ({O._sentiment('no_keys', '')})")
def net_sentiment(r: Reports) -> DataFrame:
    """Positive less negative share."""
    net = F.col("positive_count") / F.col("sentiment_total") - F.col("negative_count") / F.col("sentiment_total")
    return sentiment_top(r).select("concept", F.round(net, 6).alias("net_sentiment"))


# -- drivers ----------------------------------------------------------------------------------


def _list_drivers_sql(scope: str, keys: str) -> str:
    out = O._drivers(scope, keys).replace("FROM found JOIN", "FROM listed JOIN")
    return out.replace("concept, exact_match_count, round", "list, concept, exact_match_count, round", 1).replace("concept, avg(score)", "list, concept, avg(score)", 1)


@query(_list_drivers_sql("no_keys", ""))
def drivers_lists(r: Reports) -> DataFrame:
    return C.drivers(r.listed(), r.scores(), ("driver_field",), LIST_KEYS)


@query(_list_drivers_sql("subsets", _SUBSET))
def drivers_subsets_lists(r: Reports) -> DataFrame:
    return C.drivers(r.listed(), r.scores(r.subsets), ("driver_field", *SUBSET), LIST_KEYS)


@query(f"SELECT *, '_all_' AS value FROM ({O._drivers(_FIELDS, 'field')})")
def drivers_subsets_all(r: Reports) -> DataFrame:
    return _all(C.drivers(r.found, r.scores(_per_field(r)), ("driver_field", "field")))


@query(O._drivers("week_docs", _SLICE))
def drivers_over_time_week(r: Reports) -> DataFrame:
    return C.drivers(r.found, r.scores(r.in_slices("W")), ("driver_field", *SLICE))


# -- outliers ---------------------------------------------------------------------------------


def _outlier_concepts(r: Reports, scope: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Concepts of each key's documents that the top concepts leave out."""
    top = C.ranked(C.volume(r.found, None, r.n_docs), (), "relevance", TOP).select("concept")
    hits = r.found.join(F.broadcast(top), "concept", "left_semi")  # TOP rows
    kinds = [C.uncovered(scope, hits, kind).withColumn("match_type", F.lit(kind)) for kind in ("both", "exact")]
    keys = ("match_type", *keys)
    return C.ranked(C.unique_to(r.found, kinds[0].unionByName(kinds[1]), r.n_docs, keys), keys, "g2", TOP)


def _outlier_concepts_sql(scope: str, keys: str) -> str:
    left = "SELECT *, '{0}' AS match_type FROM {1} WHERE doc_id NOT IN (SELECT doc_id FROM found JOIN ({2}) top10 USING (concept) WHERE {3})"
    out = " UNION ALL ".join(left.format(kind, scope, O._TOP, hit) for kind, hit in (("both", "true"), ("exact", "exact = 1")))
    return O._top(O._unique(f"({out}) sc", f"match_type, {keys}"), f"match_type, {keys}", "g2", TOP)


@query(_outlier_concepts_sql("subsets", _SUBSET))
def outlier_subsets_concepts(r: Reports) -> DataFrame:
    return _outlier_concepts(r, r.subsets, SUBSET)


@query(_outlier_concepts_sql("month_docs", _SLICE))
def outliers_over_time_concepts(r: Reports) -> DataFrame:
    return _outlier_concepts(r, r.in_slices("M"), SLICE)


# -- example documents ------------------------------------------------------------------------


def _examples_sql(rows: str, keys: str, hits: str) -> str:
    ids = ", ".join(f"coalesce(max(CASE WHEN rn = {i} THEN doc_id::VARCHAR END), '') AS example_doc{i}" for i in (1, 2, 3))
    ranked = f"SELECT {keys}, doc_id, row_number() OVER (PARTITION BY {keys} ORDER BY total_price DESC, doc_id) AS rn FROM {hits}"
    return f"SELECT v.*, example_doc1, example_doc2, example_doc3 FROM ({rows}) v JOIN (SELECT {keys}, {ids} FROM ({ranked}) WHERE rn <= 3 GROUP BY {keys}) e USING ({keys})"


def _priced(r: Reports, scope: DataFrame | None = None) -> DataFrame:
    """The exact documents of the concepts and their total prices."""
    hits = r.found.where("exact = 1").join(r.docs.select("doc_id", "total_price"), "doc_id")
    return hits if scope is None else hits.join(scope, "doc_id")


_HITS = "found JOIN docs USING (doc_id) {} WHERE exact = 1"


@query(_examples_sql(O._top(O._volume("subsets", _SUBSET), _SUBSET, "relevance", 10), f"{_SUBSET}, concept", _HITS.format("JOIN subsets USING (doc_id)")))
def volume_subsets_examples(r: Reports) -> DataFrame:
    return C.with_examples(volume_subsets(r), _priced(r, r.subsets), [*SUBSET, "concept"], F.col("total_price"))


@query(_examples_sql(O._sentiment("no_keys", ""), "concept", _HITS.format("")))
def sentiment_examples(r: Reports) -> DataFrame:
    return C.with_examples(sentiment_top(r), _priced(r), ["concept"], F.col("total_price"))


@query(_examples_sql(O._top(O._unique("subsets", _SUBSET), _SUBSET, "g2", 20), f"{_SUBSET}, concept", _HITS.format("JOIN subsets USING (doc_id)")))
def unique_examples(r: Reports) -> DataFrame:
    return C.with_examples(unique_to_filter(r), _priced(r, r.subsets), [*SUBSET, "concept"], F.col("total_price"))


# -- lexicon ----------------------------------------------------------------------------------

_LEXICON = """(SELECT *, CASE WHEN novel THEN 0.0 ELSE round(abs(known_score - linear_score), 6) END AS change FROM (
    SELECT term, total_doc_count, round(a, 6) AS axis_score, round(5 * round(a, 6), 6) AS linear_score, coalesce(k, 0)::DOUBLE AS known_score, coalesce(k, 0) = 0 AS novel, coalesce(k, 0) * round(5 * round(a, 6), 6) < 0 AS conflict
    FROM (SELECT term, count(DISTINCT doc_id) AS total_doc_count, (count(*) FILTER (sentiment = 'positive') - count(*) FILTER (sentiment = 'negative')) / count(*) AS a FROM t WHERE sentiment IS NOT NULL GROUP BY 1)
    LEFT JOIN (SELECT p_partkey AS term, p_size % 11 - 5 AS k FROM part WHERE p_size % 2 = 0) USING (term)))"""


def _lexicon(r: Reports) -> DataFrame:
    known = r.star.table("part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("term"), (F.col("p_size") % 11 - 5).alias("known_score"))
    return lexicon.beside_known(lexicon.linear_scores(r.terms), known)


@query(f"SELECT * FROM {_LEXICON} x")
def lexicon_scores(r: Reports) -> DataFrame:
    """Scores of all terms beside those of a known lexicon (parts of even size, scored by size)."""
    return _lexicon(r)


@query(f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (ORDER BY change DESC, term) AS rn FROM {_LEXICON} x WHERE NOT novel) WHERE rn <= 50")
def lexicon_most_changed(r: Reports) -> DataFrame:
    """The 50 known terms whose score moved most."""
    return _lexicon(r).where("not novel").orderBy(F.desc("change"), "term").limit(50)


@query(f"SELECT * FROM {_LEXICON} x WHERE novel ORDER BY total_doc_count DESC, term LIMIT 50")
def lexicon_novel(r: Reports) -> DataFrame:
    """The 50 terms in most documents that the known lexicon doesn't have."""
    return _lexicon(r).where("novel").orderBy(F.desc("total_doc_count"), "term").limit(50)
