"""Queries over texts, vectors and streams, each with its SQL twin where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvida.functions import encoding as E
from corvida.functions import text as T
from corvida.functions import vectors as V
from corvida.operators import boilerplate as B
from corvida.operators import concept_lists as L
from corvida.operators import concepts as C
from corvida.operators import intents as I
from corvida.operators import language, similarity
from corvida.plans.oracle_reports import BASE
from corvida.plans.reports import Reports
from corvida.plans.star import STRING_FIELDS
from corvida.session import ready, scratch_path, stored
from corvida.sources import files
from corvida.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(build):
        QUERIES[name or build.__name__] = build
        if sql is not None:
            SQL[name or build.__name__] = sql
        return build

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


# -- duplicates -------------------------------------------------------------------------------

_BAGS = r"""bags AS (SELECT *, min(doc_id) OVER (PARTITION BY tok) AS class_id FROM (SELECT doc_id, list_sort(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}')) AS tok FROM documents) WHERE len(tok) > 0),
 n AS (SELECT count(*) AS n FROM bags), copies AS (SELECT class_id, count(*) AS copies FROM bags GROUP BY 1),
 tf AS (SELECT class_id, token, count(*) AS tf FROM (SELECT class_id, unnest(tok) AS token FROM bags WHERE doc_id = class_id) GROUP BY ALL),
 dfs AS (SELECT token, sum(copies) AS df FROM tf JOIN copies USING (class_id) GROUP BY 1),
 x AS (SELECT class_id, token, df, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN dfs USING (token) CROSS JOIN n),
 w AS (SELECT class_id, token, df, x / sqrt(sum(x * x) OVER (PARTITION BY class_id)) AS w FROM x),
 pairs AS (SELECT a.class_id AS a, b.class_id AS b, sum(a.w * b.w) AS cosine FROM w a JOIN w b ON a.token = b.token AND a.class_id < b.class_id GROUP BY ALL HAVING sum(a.w * b.w) > 0.95)"""
_GROUPS = f"""WITH RECURSIVE {_BAGS},
 edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
 reach(s, e) AS (SELECT a, b FROM edges UNION SELECT s, b FROM reach JOIN edges ON e = a),
 grp AS (SELECT d.doc_id, coalesce((SELECT least(b.class_id, min(e)) FROM reach WHERE s = b.class_id), b.class_id, d.doc_id) AS group_id FROM documents d LEFT JOIN bags b USING (doc_id))"""


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(coalesce(text, ''))) AS keep_id FROM documents")
def dedupe_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("h"))
    return docs.join(docs.groupBy("h").agg(F.min("doc_id").alias("keep_id")), "h").select("doc_id", "keep_id")


@query(f"WITH {_BAGS} SELECT a, b, round(cosine, 4) AS cosine FROM pairs")
def dedupe_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different bags of words above the threshold."""
    docs = _docs(spark, sf_dir)
    return similarity.similar_pairs(docs, stored(similarity.classes(docs), "classes")).select("a", "b", F.round("cosine", 4).alias("cosine"))


@query(f"{_GROUPS} SELECT doc_id, group_id FROM grp")
def dedupe_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.duplicate_groups(_docs(spark, sf_dir))


def _keep(rule: str, order: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _docs(spark, sf_dir)
        return similarity.reconciled(docs, similarity.duplicate_groups(docs), rule)

    query(f"{_GROUPS} SELECT group_id, min_by(doc_id, {order}) AS doc_id, count(*) AS members FROM grp JOIN documents USING (doc_id) GROUP BY 1", f"dedupe_keep_{rule}")(run)


for _rule, _order in (("first", "doc_id"), ("shortest", "(length(coalesce(text, '')), doc_id)"), ("longest", "(-length(coalesce(text, '')), doc_id)")):
    _keep(_rule, _order)

# -- boilerplate ------------------------------------------------------------------------------

_GRAMS = r"""g AS (SELECT doc_id, i - 1 AS pos, tok[i:i + 6] AS g FROM (SELECT doc_id, tok, unnest(range(1, len(tok) - 5)) AS i FROM
   (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '\S+|\n'), lambda t: CASE WHEN t = chr(10) THEN '^^^' ELSE replace(lower(t), 'ß', 'ss') END) AS tok FROM documents) WHERE len(tok) >= 7)),
 seen AS (SELECT g, count(*) AS n FROM g GROUP BY 1)"""


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return B.matched(docs, B.frequent(docs))


@query(f"WITH {_GRAMS} SELECT array_to_string(g, ' ') AS gram, n::DOUBLE AS weight FROM seen WHERE n >= 6")
def boilerplate_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.frequent(_docs(spark, sf_dir), use_gaps=False)
    return found.select(F.array_join("gram", " ").alias("gram"), "weight")


@query(f"""WITH {_GRAMS} SELECT array_to_string(list_transform(g, lambda w, i: CASE WHEN i = k THEN '___' ELSE w END), ' ') AS gram, 0.5 * sum(n) AS weight, count(*) AS fillers
    FROM seen CROSS JOIN range(2, 7) r(k) GROUP BY 1 HAVING 0.5 * sum(n) >= 6""")
def boilerplate_gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.frequent(_docs(spark, sf_dir)).where("fillers > 0")
    return found.select(F.array_join("gram", " ").alias("gram"), "weight", "fillers")


@query()
def boilerplate_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("doc_id", F.inline("spans"))


@query()
def boilerplate_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.spliced(_matched(spark, sf_dir)).select("doc_id", "text", F.size("removed").alias("n_removed"))


@query()
def boilerplate_highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with the spans that would be removed shown in red."""
    return B.spliced(_matched(spark, sf_dir)).select("doc_id", T.highlighted(F.col("original_text"), F.col("removed")).alias("text"))


@query("""SELECT doc_id, tokens, before, before < 1000000 AS counted FROM (SELECT doc_id, tokens, coalesce(sum(tokens) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM
    (SELECT doc_id, CASE WHEN n < 7 THEN 0 ELSE n END AS tokens FROM (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\\S+|\\n')) AS n FROM documents)))""")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in order until a budget of tokens is reached."""
    return B.budgeted(_docs(spark, sf_dir))


# -- language ---------------------------------------------------------------------------------

_VOTES = " UNION ALL ".join(f"SELECT '{lang}' AS lang, unnest([{', '.join(repr(w) for w in own)}]) AS w" for lang, own in sorted(language.STOP_WORDS.items()))
_LANGUAGE = rf"""WITH s AS ({_VOTES}), t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]{{2,}}')) AS w FROM documents),
  v AS (SELECT doc_id, lang, count(*) AS n FROM t JOIN s USING (w) GROUP BY ALL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, lang) = 1)"""
_LANGUAGE = _LANGUAGE.replace("GROUP BY ALL QUALIFY", "GROUP BY doc_id, lang QUALIFY")


@query(f"{_LANGUAGE} SELECT doc_id, lang AS lang_pred, coalesce(n, 0) AS votes FROM documents d LEFT JOIN (SELECT doc_id, lang, n FROM v) v USING (doc_id)".replace("SELECT doc_id, lang AS", "SELECT d.doc_id, v.lang AS"))
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.votes(_docs(spark, sf_dir))


@query(f"{_LANGUAGE} SELECT d.doc_id FROM documents d LEFT JOIN v USING (doc_id) WHERE coalesce(v.lang, 'en') = 'en'")
def remove_foreign_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.without_foreign(_docs(spark, sf_dir)).select("doc_id")


# -- vectors and intents ----------------------------------------------------------------------

_DOT = "list_sum(list_transform(range(1, 65), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_DOT.format(a='a.embedding', b='b.embedding')}, 5) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND b.vec_id > a.vec_id ORDER BY cosine DESC, a, b LIMIT 300")
def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 300 most similar pairs of query vectors (ids divisible by 100) and later ones."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    blocks = rows.where("vec_id % 100 = 0").groupBy(F.floor(F.col("vec_id") / 100_000).alias("block")).agg(F.collect_list(F.struct("vec_id", "embedding")).alias("q"))
    met = rows.crossJoin(blocks).select("vec_id", "embedding", F.explode("q").alias("x")).where("x.vec_id < vec_id")
    pairs = met.select(F.col("x.vec_id").alias("a"), F.col("vec_id").alias("b"), F.round(V.dot(F.col("x.embedding"), F.col("embedding")), 5).alias("cosine"))
    return pairs.orderBy(F.desc("cosine"), "a", "b").limit(300)


def concept_vectors(r: Reports) -> DataFrame:
    """term, vector: the concepts with the vectors of the same places."""
    numbered = r.star.table("part").select(F.col("p_name").alias("term")).distinct().withColumn("vec_id", (F.row_number().over(Window.orderBy("term")) - 1).cast("long"))  # one row for each name
    return numbered.join(r.star.table("embeddings").select("vec_id", F.col("embedding").alias("vector")), "vec_id")


def _terms(r: Reports) -> DataFrame:
    """The concepts with a vector each."""
    volume = C.volume(r.found, None, r.n_docs).select(F.col("concept").alias("term"), "exact_match_count", "relevance")
    return concept_vectors(r).join(volume, "term")


def _exact(r: Reports) -> DataFrame:
    """doc_id, term: the concepts that documents have an exact term of, without a row for each related one; may repeat."""
    return r.terms.join(r.concepts.where("exact = 1"), "term").select("doc_id", F.col("concept").alias("term"))


_TERMS = f"""v AS (SELECT concept AS term, count(DISTINCT CASE WHEN exact = 1 THEN doc_id END) AS m FROM found GROUP BY 1),
 names AS (SELECT p_name AS term, row_number() OVER (ORDER BY p_name) - 1 AS vec_id FROM (SELECT DISTINCT p_name FROM part)),
 terms AS (SELECT term, embedding AS vector, m, round(m * ln(n0 / df0), 6) AS relevance FROM names JOIN embeddings USING (vec_id) JOIN v USING (term) JOIN df0 ON concept = term CROSS JOIN n),
 crossed AS (SELECT a.term, b.term AS term2, {_DOT.format(a='a.vector', b='b.vector')} AS c FROM terms a CROSS JOIN terms b),
 disp AS (SELECT term, stddev_pop((c > 0.6)::INT) AS d FROM crossed GROUP BY 1),
 inside AS (SELECT term, count(*) AS k FROM (SELECT unnest(string_split(term, ' ')) AS term FROM terms WHERE contains(term, ' ')) GROUP BY 1),
 scored AS (SELECT t.term, contains(t.term, ' ')::INT AS collocation, coalesce(k, 0) AS collocations, round(d, 6) AS dispersion,
   round((1 + contains(t.term, ' ')::INT) * (relevance / m) * (1 - d) * (coalesce(k, 0) + 1), 6) AS intent_score FROM terms t JOIN disp USING (term) LEFT JOIN inside USING (term))"""


@query(f"WITH {BASE}, {_TERMS} SELECT * FROM scored")
def intent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.scores(_terms(Reports(ready(spark), sf_dir))).select("term", "collocation", "collocations", "dispersion", "intent_score")


@query(f"""WITH {BASE}, {_TERMS} SELECT c.term || '-' || c.term2 AS name, c.term || ' ' || c.term2 AS text FROM crossed c
    JOIN (SELECT term FROM scored ORDER BY intent_score DESC, term LIMIT 75) USING (term) JOIN scored s2 ON s2.term = c.term2 WHERE c > 0.6 AND c < 0.98 AND s2.intent_score > 0""")
def intent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.pairs(I.scores(_terms(Reports(ready(spark), sf_dir))), threshold=0.0)


@query(f"""WITH {BASE}, {_TERMS}, ranked AS (SELECT *, row_number() OVER (ORDER BY intent_score DESC, term) AS r FROM scored)
    SELECT term, intent_score FROM ranked a WHERE NOT EXISTS (SELECT 1 FROM ranked b JOIN crossed c ON c.term = a.term AND c.term2 = b.term WHERE b.r < a.r AND c.c >= 0.85)""")
def intent_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.without_duplicates(I.scores(_terms(Reports(ready(spark), sf_dir)))).select("term", "intent_score")


@query(f"""WITH {BASE}, {_TERMS}, parts AS (SELECT label AS intent, vec_id % 2 AS part, embedding AS vector FROM (SELECT *, row_number() OVER (PARTITION BY label, vec_id % 2 ORDER BY vec_id) AS rn FROM embeddings) WHERE rn = 1),
  s AS (SELECT term, intent, part, pow({_DOT.format(a='terms.vector', b='parts.vector')}, 3) AS s FROM terms CROSS JOIN parts)
  SELECT doc_id, intent, round(avg(s), 5) + 0.0 AS score FROM (SELECT doc_id, intent, part, max(s) AS s FROM found JOIN s ON term = concept WHERE exact = 1 GROUP BY ALL) GROUP BY ALL""")
def intent_doc_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Reports(ready(spark), sf_dir)
    return I.document_scores(_exact(r), _terms(r).select("term", "vector"), _intents(r)).select("doc_id", "intent", (F.round("score", 5) + 0.0).alias("score"))  # no minus zero


_PARTS = "(SELECT label, vec_id % 2 AS part, embedding AS v FROM embeddings QUALIFY row_number() OVER (PARTITION BY label, vec_id % 2 ORDER BY vec_id) = 1)"
_KEPT = f"(SELECT label FROM (SELECT a.label, count(DISTINCT a.part) AS n, min({_DOT.format(a='a.v', b='b.v')}) AS least FROM {_PARTS} a JOIN {_PARTS} b USING (label) GROUP BY 1) WHERE n = 1 OR least < 0.9)"


def _intents(r: Reports) -> DataFrame:
    """intent, part, vector: each label stands for an intent, its first vectors of even and odd ids for its parts."""
    rn = F.row_number().over(Window.partitionBy("label", F.col("vec_id") % 2).orderBy("vec_id"))
    return r.star.table("embeddings").withColumn("rn", rn).where("rn = 1").select(F.col("label").alias("intent"), (F.col("vec_id") % 2).alias("part"), F.col("embedding").alias("vector"))


@query(f"SELECT label AS intent, part, list_transform(v, lambda x: round(x::DOUBLE, 5)) AS vector FROM {_PARTS} WHERE label IN {_KEPT}")
def intents_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intents whose parts say different things."""
    return I.kept(_intents(Reports(ready(spark), sf_dir))).withColumn("vector", F.transform("vector", lambda x: F.round(x.cast("double"), 5)))


@query(f"""WITH {BASE}, s AS (SELECT * FROM ({{}}) WHERE intent IN {_KEPT}), best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, intent) = 1),
    wide AS (SELECT doc_id, {', '.join(f"max(score) FILTER (intent = {i}) AS intent_{i}" for i in range(10))} FROM s GROUP BY 1)
    SELECT doc_id, intent, score, list_filter(['order_priority: ' || order_priority, 'order_status: ' || order_status, 'segment: ' || segment, 'total_price: ' || trunc(total_price)::BIGINT], lambda x: x IS NOT NULL) AS metadata, wide.* EXCLUDE (doc_id)
    FROM best JOIN wide USING (doc_id) JOIN docs USING (doc_id) WHERE score > 0.5""".replace("{}", SQL["intent_doc_scores"]))
def intent_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an intent above 0.5: the best one, its score, the metadata as ``name: value`` and the scores of all intents."""
    r = Reports(ready(spark), sf_dir)
    scored = I.document_scores(_exact(r), _terms(r).select("term", "vector"), I.kept(_intents(r))).withColumn("score", F.round("score", 5) + 0.0)
    value = [F.concat(F.lit(f"{f}: "), F.col(f)) for f in STRING_FIELDS] + [F.concat(F.lit("total_price: "), F.col("total_price").cast("long").cast("string"))]
    metadata = r.docs.select("doc_id", F.filter(F.array(*value), lambda x: x.isNotNull()).alias("metadata"))
    return I.labelled(scored, list(range(10)), prefix="intent_").join(metadata, "doc_id")


@query(r"SELECT doc_id, length(text) AS length, len(regexp_extract_all(text, '[^\x00-\x7f]')) AS n_damaged, text AS repaired, true AS clean_stays FROM documents")
def mojibake_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text damaged twice (its UTF-8 bytes read as single bytes) and repaired; the text itself stays as it is."""
    docs = _docs(spark, sf_dir)
    damaged = E.misread(E.misread(F.col("text")))
    repaired = E.repaired(damaged)
    marks = F.regexp_count(F.col("text"), F.lit(r"[^\x00-\x7f]")).cast("long")
    return docs.select("doc_id", F.length("text").cast("long").alias("length"), marks.alias("n_damaged"), repaired.alias("repaired"), (E.repaired(F.col("text")) == F.col("text")).alias("clean_stays"))


@query(f"""WITH {BASE}, {_TERMS}, lex AS (SELECT term, (row_number() OVER (ORDER BY term) % 7 - 3)::DOUBLE AS s FROM terms),
  near AS (SELECT c.term, s, c.c FROM crossed c JOIN lex ON lex.term = c.term2 WHERE s <> 0 AND c.term <> c.term2 QUALIFY row_number() OVER (PARTITION BY c.term ORDER BY c.c DESC, c.term2) <= 5)
  SELECT term, round(sum(c * s) / sum(c), 2) AS classifier_score FROM near GROUP BY 1""")
def domain_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New sentiment scores from the nearest terms that have one."""
    terms = _terms(Reports(ready(spark), sf_dir))
    lexicon = terms.select("term", (F.row_number().over(Window.orderBy("term")) % 7 - 3).cast("double").alias("sentiment"))  # one row for each name
    return I.neighbour_scores(terms.select("term", "vector"), lexicon)


# -- lists, threads, files --------------------------------------------------------------------


@query("""SELECT p_type AS list, p_brand AS concept FROM part WHERE p_type < 'P' GROUP BY ALL UNION ALL
    SELECT p_type, p_brand FROM part WHERE p_size > 25 AND p_type NOT IN (SELECT p_type FROM part WHERE p_type < 'P') GROUP BY ALL""")
def lists_copied(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    target = part.where("p_type < 'P'").select(F.col("p_type").alias("list"), F.col("p_brand").alias("concept")).distinct()
    source = part.where("p_size > 25").select(F.col("p_type").alias("list"), F.col("p_brand").alias("concept")).distinct()
    return L.copied(source, target)


@query("SELECT CASE WHEN p_brand = 'Brand#11' THEN 'Brand#12' ELSE p_brand END AS term, count(*) AS n FROM part WHERE p_brand NOT IN ('Brand#13') GROUP BY 1")
def concept_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One term ignored, one merged into another."""
    terms = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("term"))
    ignore, merge = spark.createDataFrame([("Brand#13",)], "term string"), spark.createDataFrame([("Brand#11", "Brand#12")], "old string, new string")
    return L.with_rules(terms, ignore, merge).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id * 1000 + turn AS id, min(conv_id * 1000 + turn) OVER (PARTITION BY conv_id) AS root_id FROM conversations")
def thread_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn of each conversation, found by going from each turn to the one before."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    parent = F.lag("id").over(Window.partitionBy("conv_id").orderBy("id"))
    return L.thread_roots(rows.select("id", parent.alias("parent_id")))


@query("SELECT conv_id * 1000 + turn AS id, text, role, turn::DOUBLE AS turn FROM conversations WHERE trim(text) <> ''")
def typed_csv_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as typed CSV and read back as documents."""
    path = scratch_path(ready(spark), "typed")
    rows = _table(spark, sf_dir, "conversations").select("text", F.col("role").alias("string_role"), F.col("turn").alias("number_turn"), (F.col("conv_id") * 1000 + F.col("turn")).alias("number_id"))
    rows.write.csv(path, header=True, escape='"')
    docs = files.typed_csv(spark, path)
    value = lambda n: F.get(F.filter("metadata", lambda e: e["name"] == n), F.lit(0))["value"]
    return docs.select(value("id").cast("double").cast("long").alias("id"), "text", value("role").alias("role"), value("turn").cast("double").alias("turn"))


# -- streams ----------------------------------------------------------------------------------


@query("""SELECT * FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL)
    WHERE window_end <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)""")
def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs.appended(jobs.windowed_counts(jobs.source(ready(spark), sf_dir)), "windows")
    return rows.withColumn("value", F.round("value", 4))


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 997")
def stream_retention_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.retained(jobs.source(ready(spark), sf_dir), jobs.latest(), "latest").select("event_id", "ts", "event_type")


@query("SELECT event_id, ts, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def stream_retention_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.retained(jobs.source(ready(spark), sf_dir), jobs.newer_than(1), "newest").select("event_id", "ts", "event_type")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase')")
def stream_topic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.appended(jobs.with_topics(jobs.source(ready(spark), sf_dir), ["click", "purchase"]), "topics").select("event_id", "event_type")


@query("SELECT event_id, ((row_number() OVER (ORDER BY ts, event_id) - 1) // 201)::BIGINT AS flush FROM events")
def stream_flushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A buffer is sent each time it holds 201 events; what is left has the number it will be sent by."""
    return jobs.flushes(jobs.source(ready(spark), sf_dir)).select("event_id", "flush")


@query("""WITH b AS (SELECT range AS batch, 1 + ('0x' || substr(md5('7-' || range), 1, 6))::BIGINT % 15 AS k FROM range(20)), p AS (SELECT batch, sum(k) OVER (ORDER BY batch) - k + unnest(range(k)) AS i FROM b),
    e AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM events)
    SELECT event_id, batch, pos FROM p JOIN e ON e.pos = (p.i + ('0x' || substr(md5('7'), 1, 8))::BIGINT % n) % n""")
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored events sent again, one to fifteen at a time, from a start that the seed gives."""
    from corvida.streaming import replay

    return replay.replayed(_table(spark, sf_dir, "events"), ["ts", "event_id"], seed=7, batches=20).select("event_id", "batch", "pos")


@query("SELECT count(*) AS rows FROM events")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listener has been told of a stream's batches: their rows add up to the input."""
    with jobs.progress(ready(spark)) as seen:
        jobs.appended(jobs.with_topics(jobs.source(spark, sf_dir), ["click"]), "progress")
    return seen.table().agg(F.sum("rows").alias("rows"))
