"""Document-level tables and scalar reports, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvida.functions import colors, emotions, fuzzy, slices, text, vectors
from corvida.operators import numbering
from corvida.operators import concepts as C
from corvida.plans.oracle_reports import BASE
from corvida.plans.reports import Reports

QUERIES: dict[str, Callable[[Reports], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, base: bool = True, name: str | None = None):
    """Registers a query and the SQL that gives the same rows."""

    def keep(build):
        key = name or build.__name__
        QUERIES[key] = build
        if sql is not None:
            SQL[key] = f"WITH {BASE} {sql}" if base else sql
        return build

    return keep


# -- metadata ---------------------------------------------------------------------------------

_DOC_META = """(SELECT doc_id, 'lang' AS field, lang AS value FROM documents WHERE lang IS NOT NULL
    UNION ALL SELECT doc_id, 'source', source FROM documents WHERE source IS NOT NULL)"""


def _doc_metadata(r: Reports) -> DataFrame:
    docs = r.star.table("documents").select("doc_id", F.explode(F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")).alias("field", "value"))
    return docs.where("value is not null")


@query(f"SELECT doc_id, field, 'string' AS type, value FROM {_DOC_META} m", base=False)
def doc_metadata(r: Reports) -> DataFrame:
    return _doc_metadata(r).select("doc_id", "field", F.lit("string").alias("type"), "value")


@query("SELECT doc_id, field, value FROM subsets")
def doc_subsets(r: Reports) -> DataFrame:
    return r.subsets


@query("""SELECT field, 'string' AS type, count(DISTINCT value) AS unique_values, NULL::DOUBLE AS minimum, NULL::DOUBLE AS maximum FROM subsets GROUP BY 1
    UNION ALL SELECT driver_field, 'score', count(DISTINCT score), min(score), max(score) FROM scores GROUP BY 1""")
def field_summary(r: Reports) -> DataFrame:
    strings = r.subsets.groupBy("field").agg(F.count_distinct("value").alias("unique_values"))
    scores = r.scores().where("score is not null").groupBy(F.col("driver_field").alias("field")).agg(F.count_distinct("score").alias("unique_values"), F.min("score").alias("minimum"), F.max("score").alias("maximum"))
    rows = strings.withColumn("type", F.lit("string")).unionByName(scores.withColumn("type", F.lit("score")), allowMissingColumns=True)
    return rows.select("field", "type", "unique_values", "minimum", "maximum")


@query("SELECT name, type, value, count FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY value) AS rn FROM (SELECT field AS name, 'string' AS type, value, count(DISTINCT doc_id) AS count FROM subsets GROUP BY ALL)) WHERE rn <= 200")
def list_metadata(r: Reports) -> DataFrame:
    """The first 200 values of each field with their documents."""
    counts = r.subsets.groupBy("field", "value").agg(F.count_distinct("doc_id").alias("count"))
    rn = F.row_number().over(Window.partitionBy("field").orderBy("value"))
    return counts.withColumn("rn", rn).where("rn <= 200").select(F.col("field").alias("name"), F.lit("string").alias("type"), "value", "count")


# -- filters ----------------------------------------------------------------------------------


@query("SELECT doc_id FROM subsets WHERE field = 'order_priority' AND value IN ('1-URGENT', '2-HIGH') INTERSECT SELECT doc_id FROM subsets WHERE field = 'segment' AND value = 'BUILDING'")
def filter_values(r: Reports) -> DataFrame:
    """Any of some values of one field, and a value of another."""
    one = r.subsets.where((F.col("field") == "order_priority") & F.col("value").isin("1-URGENT", "2-HIGH")).select("doc_id")
    two = r.subsets.where((F.col("field") == "segment") & (F.col("value") == "BUILDING")).select("doc_id")
    return one.join(two, "doc_id", "left_semi").distinct()


@query("SELECT doc_id, date, total_price FROM docs WHERE total_price BETWEEN 100000 AND 200000 AND date BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-01-01'")
def filter_range(r: Reports) -> DataFrame:
    """Ranges that include both ends."""
    dates = F.col("date").between(F.lit(datetime(1996, 1, 1)), F.lit(datetime(1997, 1, 1)))
    return r.docs.where(F.col("total_price").between(100000, 200000) & dates).select("doc_id", "date", "total_price")


@query("SELECT driver_field AS field, count(DISTINCT score) AS unique_values FROM scores GROUP BY 1 HAVING count(DISTINCT score) > 1")
def driver_fields(r: Reports) -> DataFrame:
    return r.scores().groupBy(F.col("driver_field").alias("field")).agg(F.count_distinct("score").alias("unique_values")).where("unique_values > 1")


@query("SELECT field, count(DISTINCT value) AS unique_values FROM subsets GROUP BY 1 HAVING count(DISTINCT value) < 200")
def best_subset_fields(r: Reports) -> DataFrame:
    return r.subsets.groupBy("field").agg(F.count_distinct("value").alias("unique_values")).where("unique_values < 200")


@query("""SELECT name, value, length(value) < 64 AS kept, max(length(value)) OVER (PARTITION BY name) <= 64 AS field_kept
    FROM (SELECT 'url' AS name, url AS value FROM pages UNION ALL SELECT 'text', text FROM documents UNION ALL SELECT 'source', source FROM documents)""", base=False)
def value_length_guard(r: Reports) -> DataFrame:
    """Values shorter than 64 characters; fields without any longer than 64."""
    docs = r.star.table("documents")
    rows = r.star.table("pages").select(F.lit("url").alias("name"), F.col("url").alias("value")).union(docs.select(F.lit("text"), "text")).union(docs.select(F.lit("source"), "source"))
    longest = rows.groupBy("name").agg(F.max(F.length("value")).alias("most"))
    return rows.join(F.broadcast(longest), "name").select("name", "value", (F.length("value") < 64).alias("kept"), (F.col("most") <= 64).alias("field_kept"))  # a row for each field


# -- documents and terms ----------------------------------------------------------------------


@query("""SELECT doc_id, concept, kind, sentiment, confidence FROM
    (SELECT doc_id, concept, 'top' AS kind, sentiment, confidence, row_number() OVER (PARTITION BY doc_id, concept ORDER BY pos) AS rn FROM t JOIN ct USING (term) WHERE exact = 1
     UNION ALL SELECT doc_id, concept, 'shared:' || list, sentiment, confidence, row_number() OVER (PARTITION BY doc_id, list, concept ORDER BY pos) FROM t JOIN lt USING (term)) WHERE rn = 1""")
def doc_term_summary(r: Reports) -> DataFrame:
    """Of each document and concept the first occurrence's sentiment, for the top and for every list."""
    top = C.first_sentiments(r.terms, r.concepts).withColumn("kind", F.lit("top"))
    lists = C.first_sentiments(r.terms, r.star.list_terms(), ("list", "concept")).withColumn("kind", F.concat(F.lit("shared:"), "list"))
    columns = ["doc_id", "concept", "kind", "sentiment", "confidence"]
    return top.select(columns).unionByName(lists.select(columns))


@query("""SELECT doc_id, term, pos, sentiment, confidence, list, concept FROM t LEFT JOIN lt USING (term)""")
def doc_term_sentiment(r: Reports) -> DataFrame:
    """Every occurrence, with each list and concept it belongs to, or none."""
    lists = r.star.list_terms().drop("exact")
    return r.terms.join(lists, "term", "left").select("doc_id", "term", "pos", "sentiment", "confidence", "list", "concept")


@query("""SELECT doc_id, brand, CASE WHEN min(sentiment) = max(sentiment) THEN min(sentiment) ELSE 'mixed' END AS sentiment, max_by(confidence, pos) FILTER (WHERE same) AS confidence
    FROM (SELECT *, min(sentiment = first) OVER (PARTITION BY doc_id, brand ORDER BY pos) AS same FROM
      (SELECT t.*, p_brand AS brand, first_value(sentiment) OVER (PARTITION BY doc_id, p_brand ORDER BY pos) AS first FROM t JOIN part ON p_partkey = term)) GROUP BY ALL""")
def term_sentiment_mixed(r: Reports) -> DataFrame:
    """The sentiment of a term in a document: mixed for good once it differs; the confidence is
    the last one before that."""
    rows = r.terms.join(r.star.table("part").select(F.col("p_partkey").alias("term"), F.col("p_brand").alias("brand")), "term")
    w = Window.partitionBy("doc_id", "brand").orderBy("pos")
    rows = rows.withColumn("first", F.first("sentiment").over(w)).withColumn("same", F.min((F.col("sentiment") == F.col("first")).cast("int")).over(w))
    sentiment = F.when(F.min("sentiment") == F.max("sentiment"), F.min("sentiment")).otherwise("mixed")
    return rows.groupBy("doc_id", "brand").agg(sentiment.alias("sentiment"), F.max_by("confidence", F.when(F.col("same") == 1, F.col("pos"))).alias("confidence"))


@query("""SELECT doc_id, p AS positive_count, u AS neutral_count, n AS negative_count, round(sp, 6) AS positive_sum, round(su, 6) AS neutral_sum, round(sn, 6) AS negative_sum,
      round(ap, 6) AS positive_average, round(an, 6) AS negative_average,
      round((ap + an) * (ap - an), 6) AS net, round((ap + an) * least(ap, an) / CASE WHEN greatest(ap, an) <= 0 THEN 1 ELSE greatest(ap, an) END, 6) AS polarization
    FROM (SELECT *, sp / (sp + su + sn) AS ap, sn / (sp + su + sn) AS an FROM (SELECT doc_id, count(*) FILTER (sentiment = 'positive') AS p, count(*) FILTER (sentiment = 'neutral') AS u, count(*) FILTER (sentiment = 'negative') AS n,
      coalesce(sum(confidence) FILTER (sentiment = 'positive'), 0) AS sp, coalesce(sum(confidence) FILTER (sentiment = 'neutral'), 0) AS su, coalesce(sum(confidence) FILTER (sentiment = 'negative'), 0) AS sn
      FROM t GROUP BY 1) WHERE sp + su + sn > 0)""")
def doc_sentiment_metrics(r: Reports) -> DataFrame:
    """Averages are a side's share of all confidence; net and polarization come from them. Documents without any confidence have no row."""
    kinds = ("positive", "neutral", "negative")
    counts = [F.count_if(F.col("sentiment") == k).alias(f"{k}_count") for k in kinds]
    sums = [F.coalesce(F.sum(F.when(F.col("sentiment") == k, F.col("confidence"))), F.lit(0.0)).alias(f"{k}_sum") for k in kinds]
    rows = r.terms.groupBy("doc_id").agg(*counts, *sums).withColumn("total", F.col("positive_sum") + F.col("neutral_sum") + F.col("negative_sum")).where("total > 0")
    p, n = F.col("positive_sum") / F.col("total"), F.col("negative_sum") / F.col("total")
    six = {f"{k}_sum": F.col(f"{k}_sum") for k in kinds} | {"positive_average": p, "negative_average": n, "net": colors.net_score(p, n), "polarization": colors.polar_score(p, n)}
    return rows.select("doc_id", *(f"{k}_count" for k in kinds), *(F.round(c, 6).alias(name) for name, c in six.items()))


def _shares(r: Reports) -> DataFrame:
    return C.sentiment(r.with_sentiment(), r.subsets, ("field", "value")).select("field", "value", "concept", "positive_share", "neutral_share", "negative_share")


_SHARES = """(SELECT field, value, concept, round(count(*) FILTER (sentiment = 'positive') / count(*), 6) AS p, round(count(*) FILTER (sentiment = 'neutral') / count(*), 6) AS u,
    round(count(*) FILTER (sentiment = 'negative') / count(*), 6) AS n FROM senti JOIN subsets USING (doc_id) GROUP BY ALL)"""
_NET = "((p - least(p, u * 0.5)) - (n - least(n, u * 0.5)))"


@query(f"""SELECT field, value, concept, round(v, 6) AS net, ['#ff0000', '#ff7f7f', '#f0f0f0', '#009dff', '#0000ff'][round_even((v + 1) * 2, 0)::INT + 1] AS color
    FROM (SELECT *, {_NET} AS v FROM {_SHARES})""")
def sentiment_colors_net(r: Reports) -> DataFrame:
    net = colors.net_value(F.col("positive_share"), F.col("neutral_share"), F.col("negative_share"))
    return _shares(r).select("field", "value", "concept", F.round(net, 6).alias("net"), colors.net_color(net).alias("color"))


@query(f"""SELECT field, value, concept, round(2 * least(p, n), 6) AS polarization, CASE WHEN 2 * least(p, n) < 0.40 THEN '#000000' WHEN 2 * least(p, n) < 0.80 THEN '#ca79fc' ELSE '#8000ff' END AS color FROM {_SHARES}""")
def sentiment_colors_polar(r: Reports) -> DataFrame:
    value = colors.polarization(F.col("positive_share"), F.col("negative_share"))
    return _shares(r).select("field", "value", "concept", F.round(value, 6).alias("polarization"), colors.polar_color(value).alias("color"))


@query(f"""SELECT field, value, concept, CASE WHEN o >= 0.80 THEN '#8000ff' WHEN o >= 0.40 THEN CASE WHEN p > n THEN '#0000ff' ELSE '#ff0000' END
      WHEN p - n < -0.25 THEN '#ff8000' WHEN p - n <= 0.25 THEN '#808080' ELSE '#00cc22' END AS color FROM (SELECT *, 2 * least(p, n) AS o FROM {_SHARES})""")
def sentiment_colors_story(r: Reports) -> DataFrame:
    p, n = F.col("positive_share"), F.col("negative_share")
    return _shares(r).select("field", "value", "concept", colors.story_color(p - n, colors.polarization(p, n)).alias("color"))


@query("""SELECT doc_id, coalesce(string_agg(CASE WHEN exact = 1 THEN concept END, '|' ORDER BY concept), '') AS exact_topics, coalesce(string_agg(CASE WHEN exact = 0 THEN concept END, '|' ORDER BY concept), '') AS conceptual_topics
    FROM found GROUP BY 1""")
def topic_labels(r: Reports) -> DataFrame:
    """The topics of a document by exact terms and, if there is none of those, by related terms."""
    names = lambda e: F.array_join(F.array_sort(F.collect_list(F.when(F.col("exact") == e, F.col("concept")))), "|")
    return r.found.groupBy("doc_id").agg(names(1).alias("exact_topics"), names(0).alias("conceptual_topics"))


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("SELECT doc_id, " + ", ".join(f"max(CASE WHEN list = '{x}' AND exact = 1 THEN 1 ELSE 0 END) AS exact_{i}, max(CASE WHEN list = '{x}' AND exact = 0 THEN 1 ELSE 0 END) AS conceptual_{i}" for i, x in enumerate(("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))) + " FROM found JOIN (SELECT DISTINCT p_name AS concept, p_type AS list FROM part) USING (concept) GROUP BY 1")
def topic_matrix(r: Reports) -> DataFrame:
    """A block of columns for exact topics and one for conceptual ones."""
    lists = r.star.table("part").select(F.col("p_name").alias("concept"), F.col("p_type").alias("list")).distinct()
    rows = r.found.join(lists, "concept")
    columns = []
    for i, x in enumerate(("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")):
        hit = F.col("list") == x
        columns += [F.max((hit & (F.col("exact") == 1)).cast("int")).alias(f"exact_{i}"), F.max((hit & (F.col("exact") == 0)).cast("int")).alias(f"conceptual_{i}")]
    return rows.groupBy("doc_id").agg(*columns)


@query("""SELECT doc_id, CASE WHEN m IS NULL THEN 'no' ELSE 'yes' END AS tagged, CASE WHEN m IS NULL THEN 'yes' ELSE 'no' END AS outlier, coalesce(m, 0) AS match_score, coalesce(tags, '') AS tags
    FROM docs LEFT JOIN (SELECT doc_id, count(*) AS m, string_agg(concept, '|' ORDER BY concept) AS tags FROM listed WHERE list = 'PROMO' GROUP BY 1) USING (doc_id)""")
def tag_columns(r: Reports) -> DataFrame:
    """Tags of one list as columns of the documents."""
    tags = r.listed().where("list = 'PROMO'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("m"), F.array_join(F.array_sort(F.collect_list("concept")), "|").alias("tags"))
    yes = F.when(F.col("m").isNull(), "no").otherwise("yes")
    return r.docs.select("doc_id").join(tags, "doc_id", "left").select("doc_id", yes.alias("tagged"), F.when(yes == "no", "yes").otherwise("no").alias("outlier"), F.coalesce("m", F.lit(0)).cast("long").alias("match_score"), F.coalesce("tags", F.lit("")).alias("tags"))


@query("SELECT doc_id, order_priority AS string_order_priority, order_status AS string_order_status, segment AS string_segment FROM docs")
def flatten_docs(r: Reports) -> DataFrame:
    """The long metadata as a column for each field; several values are joined by a bar."""
    rows = r.subsets.withColumn("name", F.concat(F.lit("string_"), "field"))
    names = ["string_order_priority", "string_order_status", "string_segment"]
    return rows.groupBy("doc_id").pivot("name", names).agg(F.array_join(F.array_sort(F.collect_set("value")), "|"))


# -- fuzzy search over documents --------------------------------------------------------------

_SEARCH = ("the", "idiot", "que")


def _term_scores(r: Reports) -> DataFrame:
    """For each document the share of its words that each search term has, times ten, by tanh."""
    docs = r.star.table("documents").select("doc_id", text.word_tokens(F.col("text")).alias("w"))

    def score(term: str) -> Column:
        share = F.try_divide(F.size(F.filter("w", lambda x: x == term)).cast("double"), F.size("w"))
        return fuzzy.tanh_clamp(F.coalesce(share, F.lit(0.0)) * 10)

    return docs.select("doc_id", *(score(t).alias(f"s{i}") for i, t in enumerate(_SEARCH)))


_SCORES = "(SELECT doc_id, " + ", ".join(f"greatest(0, tanh(coalesce(len(list_filter(w, lambda x: x = '{t}')) / nullif(len(w), 0), 0) * 10)) AS s{i}" for i, t in enumerate(_SEARCH)) + r" FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') AS w FROM documents))"
_H = "CASE WHEN {a} + {b} - {a} * {b} = 0 THEN 0 ELSE {a} * {b} / ({a} + {b} - {a} * {b}) END"


def _search(r: Reports, score) -> DataFrame:
    rows = _term_scores(r).select("doc_id", F.round(score, 6).alias("score"))
    return rows.orderBy(F.desc("score"), "doc_id").limit(100)


@query(f"SELECT doc_id, round({_H.format(a='s0', b='s1')}, 6) AS score FROM {_SCORES} ORDER BY score DESC, doc_id LIMIT 100", base=False)
def fuzzy_and_search(r: Reports) -> DataFrame:
    return _search(r, fuzzy.fuzzy_and(F.array("s0", "s1")))


@query(f"SELECT doc_id, round(1 - ({_H.format(a='(1 - s0)', b='(1 - s2)')}), 6) AS score FROM {_SCORES} ORDER BY score DESC, doc_id LIMIT 100", base=False)
def fuzzy_or_search(r: Reports) -> DataFrame:
    return _search(r, fuzzy.fuzzy_or(F.array("s0", "s2")))


@query(f"SELECT doc_id, round({_H.format(a='s0', b='(1 - s1)')}, 6) AS score FROM {_SCORES} ORDER BY score DESC, doc_id LIMIT 100", base=False)
def fuzzy_not_search(r: Reports) -> DataFrame:
    return _search(r, fuzzy.fuzzy_and(F.array(F.col("s0"), fuzzy.fuzzy_not(F.col("s1")))))


# -- text functions ---------------------------------------------------------------------------


@query()
def shorten_repeats(r: Reports) -> DataFrame:
    return r.star.table("documents").select("doc_id", text.shorten_repeats(F.col("text")).alias("short"))


@query("SELECT conv_id, turn, array_to_string(list_filter(string_split(text || ' http://a.b/c see //www.x y', ' '), lambda t: NOT (contains(t, 'http') OR contains(t, '//www.'))), ' ') AS cleaned FROM conversations", base=False)
def drop_url_tokens(r: Reports) -> DataFrame:
    return r.star.table("conversations").select("conv_id", "turn", text.drop_url_tokens(F.concat("text", F.lit(" http://a.b/c see //www.x y"))).alias("cleaned"))


@query("SELECT doc_id, translate(replace(text, 'e', '`') || '´', '`´', '''''') AS fixed FROM documents", base=False)
def fix_apostrophes(r: Reports) -> DataFrame:
    return r.star.table("documents").select("doc_id", text.fix_apostrophes(F.concat(F.replace("text", F.lit("e"), F.lit("`")), F.lit("´"))).alias("fixed"))


@query(r"SELECT p_partkey, regexp_replace(replace(p_name, ' ', '|en ') || '|en', '\|[a-z]+(\s|\z)', '\1', 'g') AS name, split_part(p_name || '|en', '|', 1) AS label FROM part", base=False)
def strip_lang_tag(r: Reports) -> DataFrame:
    tagged = F.concat(F.replace("p_name", F.lit(" "), F.lit("|en ")), F.lit("|en"))
    return r.star.table("part").select("p_partkey", text.strip_language_tags(tagged).alias("name"), text.before_bar(F.concat("p_name", F.lit("|en"))).alias("label"))


@query("SELECT p_partkey, upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2)) AS name FROM part", base=False)
def capitalize(r: Reports) -> DataFrame:
    return r.star.table("part").select("p_partkey", text.capitalised(F.col("p_name")).alias("name"))


_EMOTION_SQL = ", ".join(f"({k}, '{name}', '{entry}')" for k, (name, entries) in enumerate(text.EMOTIONS) for entry in entries)


@query(f"""SELECT word, min_by(list, k) AS list, min_by(entry, k) AS entry FROM
    (SELECT word, k, list, min(entry) AS entry FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) JOIN (VALUES {_EMOTION_SQL}) v(k, list, entry) ON contains(lower(entry), word)
     GROUP BY ALL HAVING count(*) = 1) GROUP BY 1""", base=False)
def emotion_placement(r: Reports) -> DataFrame:
    """The distinct words of all documents that name one emotion, with its list and entry."""
    words = r.star.table("documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return words.withColumn("at", text.emotion_of(F.col("word"))).where("at is not null").select("word", "at.list", "at.entry")


_EMOTIONS = f"""SELECT DISTINCT doc_id, list AS name, entry AS value FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) JOIN
    (SELECT word, min_by(list, k) AS list, min_by(entry, k) AS entry FROM (SELECT word, k, list, min(entry) AS entry FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)
     JOIN (VALUES {_EMOTION_SQL}) v(k, list, entry) ON contains(lower(entry), word) GROUP BY ALL HAVING count(*) = 1) GROUP BY 1) USING (word)"""


@query(_EMOTIONS, base=False)
def emotions_by_document(r: Reports) -> DataFrame:
    """Each document's emotions as metadata, by the lexicon."""
    return emotions.placed(r.star.table("documents").select("doc_id", "text"))


@query(_EMOTIONS, base=False)
def emotions_by_hook(r: Reports) -> DataFrame:
    """The same through a hook that runs in Arrow batches."""
    return emotions.placed(r.star.table("documents").select("doc_id", "text"), "lexicon_arrow")


_STATUS = "c_mktsegment || ' Employee - ' || CASE WHEN c_nationkey % 5 = 0 THEN 'Anonymous Employee' ELSE c_name END"


@query(f"""SELECT c_custkey, trim(split_part(s, '-', 1)) AS status, t AS title, trim(split_part(s, 'Employee', 1)) || ' ' || CASE WHEN contains(lower(t), 'anonymous') THEN 'Employee' ELSE t END || ' gave ' || (c_nationkey % 5 + 1)::INT || ' Stars' AS heading
    FROM (SELECT *, trim(string_split(s, '-')[-1]) AS t FROM (SELECT *, {_STATUS} AS s FROM customer))""", base=False)
def employee_titles(r: Reports) -> DataFrame:
    """Employee statuses of scraped ratings, taken apart, with a heading."""
    rows = r.star.table("customer").withColumn("s", F.expr(_STATUS))
    found = text.employee(F.col("s"))
    return rows.select("c_custkey", found["status"].alias("status"), found["title"].alias("title"), text.rating_title(F.col("s"), F.col("c_nationkey") % 5 + 1).alias("heading"))


@query("SELECT conv_id, string_agg(text, ' ¶ ' ORDER BY turn) AS text FROM conversations GROUP BY 1", base=False)
def texts_joined(r: Reports) -> DataFrame:
    """The answers of one respondent as one document."""
    turns = r.star.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))  # a document's own texts
    return turns.select("conv_id", F.nullif(text.joined_texts(F.transform("t", lambda x: x["text"])), F.lit("")).alias("text"))


@query("SELECT p_partkey, 'Q' || p_partkey AS question FROM part", base=False)
def question_names(r: Reports) -> DataFrame:
    return r.star.table("part").select("p_partkey", text.question_name(F.concat(F.lit("survey/QID"), "p_partkey")).alias("question"))


# -- dates ------------------------------------------------------------------------------------


@query("""SELECT doc_id, a AS first_format, date_trunc('day', date) AS second_format, NULL::TIMESTAMP AS bad FROM (SELECT doc_id, date, date_trunc('second', date) AS a FROM docs)""")
def parse_dates(r: Reports) -> DataFrame:
    iso, us = F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format("date", "MM/dd/yyyy")
    return r.docs.select("doc_id", slices.parsed(iso).alias("first_format"), slices.parsed(us).alias("second_format"), slices.parsed(F.lit("soon")).alias("bad"))


@query("""SELECT CASE WHEN m > 7 THEN 'M' WHEN w > 7 THEN 'W' ELSE 'D' END AS best, m AS months, w AS weeks, d AS days FROM
    (SELECT date_diff('month', min(date), max(date)) + 1 AS m, date_diff('day', date_trunc('week', min(date)), date_trunc('week', max(date))) // 7 + 1 AS w, date_diff('day', min(date), max(date)) + 1 AS d FROM docs)""")
def best_interval(r: Reports) -> DataFrame:
    """Bins between the first and the last date, empty ones included."""
    bins = lambda unit: F.expr(f"timestampdiff({unit}, date_trunc('{unit}', low), date_trunc('{unit}', high)) + 1")
    rows = r.docs.agg(F.min("date").alias("low"), F.max("date").alias("high")).select(bins("MONTH").alias("months"), bins("WEEK").alias("weeks"), bins("DAY").alias("days"))
    return rows.select(F.when(F.col("months") > 7, "M").when(F.col("weeks") > 7, "W").otherwise("D").alias("best"), "months", "weeks", "days")


@query("SELECT * FROM months UNION ALL SELECT * FROM weeks UNION ALL SELECT * FROM days")
def time_slices(r: Reports) -> DataFrame:
    end = r.docs.agg(F.max("date")).first()[0]
    return slices.slice_table(r.spark, [s for kind in "MWD" for s in slices.time_slices(end, kind)])


# -- reshaping --------------------------------------------------------------------------------


@query("SELECT page_id, question, answer AS text FROM (SELECT page_id, url AS text_url, html AS text_html FROM pages) UNPIVOT (answer FOR question IN (text_url, text_html))", base=False)
def unpivot_text_fields(r: Reports) -> DataFrame:
    wide = r.star.table("pages").select("page_id", F.col("url").alias("text_url"), F.col("html").alias("text_html"))
    return wide.unpivot("page_id", ["text_url", "text_html"], "question", "text").where("text is not null")


@query("SELECT doc_id, 'multi' AS name, unnest(string_split(order_priority || '|' || segment, '|')) AS value FROM docs WHERE segment IS NOT NULL")
def split_multi_values(r: Reports) -> DataFrame:
    both = F.concat_ws("|", "order_priority", "segment")
    return r.docs.where("segment is not null").select("doc_id", F.lit("multi").alias("name"), F.explode(F.split(both, r"\|")).alias("value"))


@query("""SELECT conv_id, kind, text, CASE kind WHEN 'pros' THEN n + 5 ELSE n END AS quasi_nps FROM
    (SELECT conv_id, count(*) AS n, max(CASE WHEN turn % 3 = 0 THEN text END) AS pros, max(CASE WHEN turn % 3 = 1 THEN text END) AS cons, max(CASE WHEN turn % 3 = 2 THEN text END) AS advice FROM conversations GROUP BY 1)
    UNPIVOT (text FOR kind IN (pros, cons, advice)) WHERE trim(text) <> ''""", base=False)
def review_fanout(r: Reports) -> DataFrame:
    """A document for each filled part of a review; the score of the pros is five higher."""
    part = lambda k: F.max(F.when(F.col("turn") % 3 == k, F.col("text")))
    wide = r.star.table("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), part(0).alias("pros"), part(1).alias("cons"), part(2).alias("advice"))
    rows = wide.unpivot(["conv_id", "n"], ["pros", "cons", "advice"], "kind", "text").where(F.trim("text") != "")
    return rows.select("conv_id", "kind", "text", F.when(F.col("kind") == "pros", F.col("n") + 5).otherwise(F.col("n")).alias("quasi_nps"))


@query("""SELECT doc_id, label, CASE WHEN label IS NULL OR rn > 0.3 * n THEN 'train' ELSE 'test' END AS part FROM
    (SELECT doc_id, label, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY md5(doc_id::VARCHAR), doc_id) AS rn FROM
      (SELECT d.doc_id, l.quality::VARCHAR || l.toxic::VARCHAR AS label FROM documents d LEFT JOIN labels l USING (doc_id))) WHERE label IS NULL OR n > 1""", base=False)
def train_test_split(r: Reports) -> DataFrame:
    """Stratified by label: three in ten to the test set; labels that occur once go, rows without one all train."""
    rows = r.star.table("documents").select("doc_id").join(r.star.table("labels"), "doc_id", "left").select("doc_id", F.concat(F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("label"))
    known = rows.where("label is not null").withColumn("key", F.md5(F.col("doc_id").cast("string")))
    # four labels, so neither numbers nor counts may be taken a label a task; as many rows as labels are broadcast
    sizes = F.broadcast(known.groupBy("label").agg(F.count(F.lit(1)).alias("n")))
    placed = numbering.numbered(known, "key", "doc_id", name="rn", within=("label",)).join(sizes, "label").where("n > 1")
    placed = placed.select("doc_id", "label", F.when(F.col("rn") > 0.3 * F.col("n"), "train").otherwise("test").alias("part"))
    return placed.unionByName(rows.where("label is null").withColumn("part", F.lit("train")))


# -- vectors ----------------------------------------------------------------------------------


def _vectors(r: Reports) -> DataFrame:
    return r.star.table("embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))


_CENTRES = """(SELECT label AS theme, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) GROUP BY 1)"""
_DOT = "list_sum(list_transform(range(1, 65), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"


@query(f"SELECT theme AS label, n, round(c[1], 6) AS first, round({_DOT.format(a='c', b='c')}, 6) AS squared FROM {_CENTRES} JOIN (SELECT label AS theme, count(*) AS n FROM embeddings GROUP BY 1) USING (theme)", base=False)
def subset_centroids(r: Reports) -> DataFrame:
    rows = vectors.centroids(_vectors(r), ["label"])
    return rows.select("label", "n", F.round(F.get("centroid", F.lit(0)), 6).alias("first"), F.round(vectors.dot(F.col("centroid"), F.col("centroid")), 6).alias("squared"))


def _themes(r: Reports) -> DataFrame:
    return vectors.centroids(_vectors(r), ["label"]).select(F.col("label").alias("theme"), F.col("centroid").alias("c"))


@query(f"SELECT vec_id, theme, round(s, 5) AS score FROM (SELECT vec_id, theme, {_DOT.format(a='embedding', b='c')} AS s FROM embeddings CROSS JOIN {_CENTRES}) WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, theme) = 1", base=False)
def doc_theme_assignment(r: Reports) -> DataFrame:
    """The theme with the largest dot product above 0; the earliest of equals."""
    themes = _themes(r).agg(F.array_sort(F.collect_list(F.struct("theme", "c"))).alias("themes"))  # a handful of themes in one row
    rows = _vectors(r).crossJoin(F.broadcast(themes))
    scored = F.transform("themes", lambda t: F.struct(vectors.dot(F.col("vector"), t["c"]).alias("s"), (-t["theme"]).alias("neg")))
    best = rows.select("vec_id", F.array_max(scored).alias("b")).where("b.s > 0")
    return best.select("vec_id", (-F.col("b.neg")).alias("theme"), F.round("b.s", 5).alias("score"))


@query("SELECT p_type AS theme, string_agg(concept, '|' ORDER BY concept) AS name, sum(n)::BIGINT AS exact_matches FROM (SELECT list AS p_type, concept, count(DISTINCT doc_id) AS n FROM listed GROUP BY ALL) GROUP BY 1")
def themes(r: Reports) -> DataFrame:
    """Concepts by theme, with joined names and added counts."""
    counts = C.volume(r.listed(), None, r.n_docs, by=("list", "concept"))
    return counts.groupBy(F.col("list").alias("theme")).agg(F.array_join(F.array_sort(F.collect_list("concept")), "|").alias("name"), F.sum("exact_match_count").alias("exact_matches"))


@query(f"""SELECT label, vec_id, rank, round(s, 5) AS score FROM (SELECT theme AS label, vec_id, s, (row_number() OVER (PARTITION BY theme ORDER BY round(s, 5) DESC, vec_id))::INT AS rank FROM
    (SELECT theme, vec_id, {_DOT.format(a='embedding', b='c')} / sqrt({_DOT.format(a='c', b='c')}) AS s FROM embeddings CROSS JOIN {_CENTRES})) WHERE rank <= 10""", base=False)
def subset_search(r: Reports) -> DataFrame:
    """The ten vectors nearest to each centroid."""
    rows = _vectors(r).select("vec_id", "vector").crossJoin(F.broadcast(_themes(r)))  # a handful of themes
    rows = rows.select(F.col("theme").alias("label"), "vec_id", F.round(vectors.dot(F.col("vector"), F.col("c")) / vectors.norm(F.col("c")), 5).alias("score"))
    rn = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rn).where("rank <= 10").select("label", "vec_id", "rank", "score")


@query(f"""SELECT query_id, vec_id, rank, score FROM (SELECT q.vec_id AS query_id, e.vec_id, round({_DOT.format(a='q.embedding', b='e.embedding')}, 5) AS score,
    (row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_DOT.format(a='q.embedding', b='e.embedding')}, 5) DESC, e.vec_id))::INT AS rank FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id) WHERE rank <= 10""", base=False)
def related_vectors_topk(r: Reports) -> DataFrame:
    """The ten nearest of each query vector; queries are the ids divisible by 100."""
    queries = _vectors(r).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("q"))
    rows = vectors.near_queries(_vectors(r), queries, 10).select("query_id", "vec_id", F.round(vectors.dot(F.col("q"), F.col("vector")), 5).alias("score"))
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rn).where("rank <= 10").select("query_id", "vec_id", "rank", "score")
