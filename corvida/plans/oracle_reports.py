"""The reports in plain SQL, to check them against another engine."""

_BASE = """
 first_part AS (SELECT p_name AS concept, min_by(p_brand, p_partkey) AS brand FROM part GROUP BY 1),
 ct AS (SELECT p_name AS concept, p_partkey AS term, 1 AS exact FROM part
        UNION ALL SELECT f.concept, p.p_partkey, 0 FROM first_part f JOIN part p ON p.p_brand = f.brand AND p.p_name <> f.concept),
 lt AS (SELECT p_type AS list, p_brand AS concept, p_partkey AS term FROM part),
 t AS (SELECT l_orderkey AS doc_id, l_partkey AS term, l_discount * 10 AS confidence,
              row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount) AS pos,
              CASE l_returnflag WHEN 'A' THEN 'positive' WHEN 'N' THEN 'neutral' WHEN 'R' THEN 'negative' END AS sentiment FROM lineitem),
 docs AS (SELECT o_orderkey AS doc_id, o_orderdate AS date, o_totalprice AS total_price, c_acctbal AS account_balance,
                 o_orderstatus AS order_status, o_orderpriority AS order_priority, c_mktsegment AS segment
          FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
 found AS (SELECT doc_id, concept, max(exact) AS exact FROM t JOIN ct USING (term) GROUP BY 1, 2),
 listed AS (SELECT DISTINCT doc_id, list, concept, 1 AS exact FROM t JOIN lt USING (term)),
 n AS (SELECT count(*) AS n0 FROM orders),
 subsets AS (SELECT doc_id, 'order_priority' AS field, order_priority AS value FROM docs WHERE order_priority IS NOT NULL
             UNION ALL SELECT doc_id, 'order_status', order_status FROM docs WHERE order_status IS NOT NULL
             UNION ALL SELECT doc_id, 'segment', segment FROM docs WHERE segment IS NOT NULL),
 df0 AS (SELECT concept, count(DISTINCT doc_id) AS df0 FROM found WHERE exact = 1 GROUP BY 1),
 last_day AS (SELECT max(o_orderdate) AS e FROM orders),
 m0 AS (SELECT CASE WHEN day(e) = 1 THEN date_trunc('day', e) - INTERVAL 1 DAY ELSE e END AS e FROM last_day),
 months AS (SELECT date_trunc('month', e) - to_months(i) AS start_date,
                   CASE WHEN i = 0 THEN e ELSE date_trunc('month', e) - to_months(i - 1) - INTERVAL 1 DAY END AS end_date,
                   i::INT AS iteration_counter, 'M' AS range_type FROM m0, range(7) r(i)),
 weeks AS (SELECT e - to_days((7 * (i + 1))::INT) AS start_date, e - to_days((7 * i)::INT) AS end_date, i::INT AS iteration_counter, 'W' AS range_type FROM last_day, range(7) r(i)),
 days AS (SELECT e - to_days((i + 1)::INT) AS start_date, e - to_days(i::INT) AS end_date, i::INT AS iteration_counter, 'D' AS range_type FROM last_day, range(7) r(i)),
 month_docs AS (SELECT doc_id, s.* FROM docs JOIN months s ON date BETWEEN start_date AND end_date),
 week_docs AS (SELECT doc_id, s.* FROM docs JOIN weeks s ON date BETWEEN start_date AND end_date),
 day_docs AS (SELECT doc_id, s.* FROM docs JOIN days s ON date BETWEEN start_date AND end_date),
 senti AS (SELECT doc_id, concept, min_by(sentiment, pos) AS sentiment FROM t JOIN ct USING (term) WHERE exact = 1 GROUP BY 1, 2),
 scores AS (SELECT doc_id, 'account_balance' AS driver_field, account_balance AS score FROM docs WHERE account_balance IS NOT NULL
            UNION ALL SELECT doc_id, 'total_price', total_price FROM docs WHERE total_price IS NOT NULL),
 no_keys AS (SELECT doc_id FROM docs)
"""
_SLICE = "start_date, end_date, iteration_counter, range_type"
_SUBSET = "field, value"


def _volume(scope: str, keys: str, found: str = "found", by: str = "concept") -> str:
    k = f"{keys}, " if keys else ""
    total = f"SELECT {k} count(DISTINCT doc_id) AS total_count FROM {scope}" + (f" GROUP BY {keys}" if keys else "")
    base = "df0" if found == "found" else f"(SELECT {by}, count(DISTINCT doc_id) AS df0 FROM {found} GROUP BY ALL)"
    on = f"JOIN ({total}) tt USING ({keys})" if keys else f"CROSS JOIN ({total}) tt"
    return f"""SELECT {k}{by}, match_count, exact_match_count, match_count - exact_match_count AS conceptual_match_count, total_count,
        round(CASE WHEN exact_match_count > 0 THEN exact_match_count * ln(n0 / df0) ELSE 0.0 END, 6) AS relevance
      FROM (SELECT {k}{by}, count(DISTINCT doc_id) AS match_count, count(DISTINCT CASE WHEN exact = 1 THEN doc_id END) AS exact_match_count
            FROM {found} JOIN {scope} USING (doc_id) GROUP BY ALL) c {on} LEFT JOIN {base} b USING ({by}) CROSS JOIN n"""


def _top(rows: str, keys: str, measure: str, limit: int) -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    return f"SELECT * FROM (SELECT *, (row_number() OVER ({part}ORDER BY {measure} DESC, concept))::INT AS rank FROM ({rows})) WHERE rank <= {limit}"


def _sentiment(scope: str, keys: str) -> str:
    k = f"{keys}, " if keys else ""
    return f"""SELECT *, round(positive_count / sentiment_total, 6) AS positive_share, round(neutral_count / sentiment_total, 6) AS neutral_share, round(negative_count / sentiment_total, 6) AS negative_share
      FROM (SELECT {k}concept, count(*) FILTER (sentiment = 'positive') AS positive_count, count(*) FILTER (sentiment = 'neutral') AS neutral_count,
            count(*) FILTER (sentiment = 'negative') AS negative_count, count(*) AS sentiment_total FROM senti JOIN {scope} USING (doc_id) WHERE sentiment IS NOT NULL GROUP BY ALL)"""


def _drivers(scope: str, keys: str) -> str:
    k = "driver_field" + (f", {keys}" if keys else "")
    return f"""SELECT {k}, concept, exact_match_count, round(a, 4) AS average_score, round(a - mean, 4) AS impact, round(abs(a - mean) * sqrt(exact_match_count) / nullif(dev, 0), 4) AS importance
      FROM (SELECT {k}, concept, avg(score) AS a, count(*) AS exact_match_count FROM found JOIN scores USING (doc_id) JOIN {scope} USING (doc_id) WHERE exact = 1 GROUP BY ALL)
      JOIN (SELECT {k}, avg(score) AS mean, stddev_pop(score) AS dev FROM scores JOIN {scope} USING (doc_id) GROUP BY ALL) USING ({k})"""


def _unique(scope: str, keys: str) -> str:
    cell = lambda o, r, c: f"CASE WHEN {o} > 0 THEN {o} * ln({o} * n0 / ({r} * {c})) ELSE 0 END"
    g2 = " + ".join(cell(*x) for x in (("a", "b", "nn"), ("(nn - a)", "(n0 - b)", "nn"), ("(b - a)", "b", "(n0 - nn)"), ("(n0 - nn - b + a)", "(n0 - b)", "(n0 - nn)")))
    return f"""SELECT {keys}, concept, exact_match_count, total_count, round(2 * ({g2}), 4) AS g2 FROM (
        SELECT {keys}, concept, x.a AS exact_match_count, total_count, x.a::DOUBLE AS a, df0::DOUBLE AS b, total_count::DOUBLE AS nn, n0::DOUBLE AS n0
        FROM (SELECT {keys}, concept, count(DISTINCT doc_id) AS a FROM found JOIN {scope} USING (doc_id) WHERE exact = 1 GROUP BY ALL) x
        JOIN (SELECT {keys}, count(DISTINCT doc_id) AS total_count FROM {scope} GROUP BY ALL) USING ({keys}) JOIN df0 USING (concept) CROSS JOIN n) WHERE a * n0 > b * nn"""


_TOP = _top(_volume("no_keys", ""), "", "relevance", 10)


def _coverage(scope: str, keys: str, kind: str) -> str:
    k = f"{keys}, " if keys else ""
    hit = "" if kind == "both" else "AND exact = 1"
    inside = f"SELECT doc_id FROM found JOIN ({_TOP}) top10 USING (concept) WHERE true {hit}"
    total = f"(SELECT {k} count(DISTINCT doc_id) AS document_count FROM {scope} {'GROUP BY ' + keys if keys else ''}) d"
    out = f"(SELECT {k} count(DISTINCT doc_id) AS fc FROM {scope} WHERE doc_id NOT IN ({inside}) {'GROUP BY ' + keys if keys else ''}) o"
    join = f"{total} LEFT JOIN {out} USING ({keys})" if keys else f"{total} CROSS JOIN {out}"
    return f"SELECT {k} '{kind}' AS match_type, coalesce(fc, 0) AS filter_count, document_count, round(100 - 100 * coalesce(fc, 0) / document_count, 4) AS coverage FROM {join}"


def _outliers(kind: str) -> str:
    hit = "" if kind == "both" else "AND exact = 1"
    scope = f"(SELECT doc_id, 'outliers' AS special FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM found JOIN ({_TOP}) top10 USING (concept) WHERE true {hit}))"
    rows = _top(_unique(scope + " sc", "special"), "special", "g2", 20)
    return f"SELECT r.* EXCLUDE (total_count), c.* FROM ({rows}) r CROSS JOIN ({_coverage('no_keys', '', kind)}) c"


_BODIES = {
    "volume_top": _TOP,
    "volume_subsets": _top(_volume("subsets", _SUBSET), _SUBSET, "relevance", 10),
    "volume_subsets_all": f"SELECT *, '_all_' AS value FROM ({_top(_volume('(SELECT DISTINCT doc_id, field FROM subsets) f', 'field'), 'field', 'relevance', 10)})",
    "volume_over_time_month": _top(_volume("month_docs", _SLICE), _SLICE, "relevance", 10),
    "volume_over_time_week": _top(_volume("week_docs", _SLICE), _SLICE, "relevance", 10),
    "volume_over_time_day": _top(_volume("day_docs", _SLICE), _SLICE, "relevance", 10),
    "sentiment_top": _sentiment("no_keys", ""),
    "sentiment_subsets": _sentiment("subsets", _SUBSET),
    "sentiment_over_time": _sentiment("month_docs", _SLICE),
    "drivers": _drivers("no_keys", ""),
    "drivers_suggested": _top(_drivers("no_keys", ""), "driver_field", "importance", 100),
    "drivers_subsets": _drivers("subsets", _SUBSET),
    "drivers_over_time": _drivers("month_docs", _SLICE),
    "outliers_both": _outliers("both"),
    "outliers_exact": _outliers("exact"),
    "outlier_subsets": f"{_coverage('subsets', _SUBSET, 'both')} UNION ALL {_coverage('subsets', _SUBSET, 'exact')}",
    "outliers_over_time": f"{_coverage('month_docs', _SLICE, 'both')} UNION ALL {_coverage('month_docs', _SLICE, 'exact')}",
    "unique_to_filter": _top(_unique("subsets", _SUBSET), _SUBSET, "g2", 20),
    "unique_over_time": _top(_unique("month_docs", _SLICE), _SLICE, "g2", 20),
    "terms": f"""SELECT list, concept, exact_match_count AS exact_matches, conceptual_match_count AS related_matches, relevance FROM
        (SELECT 'top' AS list, * FROM ({_volume("no_keys", "")}) UNION ALL BY NAME SELECT * FROM ({_volume("no_keys", "", "listed", "list, concept")}))""",
    "relative_frequency": f"""SELECT rank, concept, exact_match_count, match_count, printf('%.2f%%', 100.0 * exact_match_count / total_count) AS exact_share,
        printf('%.2f%%', 100.0 * match_count / total_count) AS match_share FROM ({_top(_volume("no_keys", ""), "", "relevance", 500)})""",
    "example_docs_top3": """SELECT v.concept, exact_match_count, coalesce(max(CASE WHEN rn = 1 THEN doc_id::VARCHAR END), '') AS example_doc1, coalesce(max(CASE WHEN rn = 2 THEN doc_id::VARCHAR END), '') AS example_doc2,
        coalesce(max(CASE WHEN rn = 3 THEN doc_id::VARCHAR END), '') AS example_doc3
      FROM (SELECT concept, count(DISTINCT CASE WHEN exact = 1 THEN doc_id END) AS exact_match_count FROM found GROUP BY 1) v
      LEFT JOIN (SELECT concept, doc_id, row_number() OVER (PARTITION BY concept ORDER BY total_price DESC, doc_id) AS rn FROM found JOIN docs USING (doc_id) WHERE exact = 1) e ON e.concept = v.concept AND rn <= 3
      GROUP BY v.concept, exact_match_count""",
    "doc_count_by_filter": """SELECT * FROM (WITH v AS (SELECT field, value, count(DISTINCT doc_id) AS value_count FROM subsets WHERE field IN (SELECT field FROM subsets GROUP BY 1 HAVING count(DISTINCT value) < 20) GROUP BY 1, 2)
      SELECT list, field, value, concept, coalesce(c, 0) AS count, round(coalesce(c, 0) / value_count, 6) AS field_value_percent
      FROM (SELECT DISTINCT list, concept FROM lt) CROSS JOIN v
      LEFT JOIN (SELECT list, concept, field, value, count(DISTINCT doc_id) AS c FROM listed JOIN subsets USING (doc_id) GROUP BY ALL) USING (list, concept, field, value)
      UNION ALL SELECT list, field, value, '_ALL_', value_count, 100.0::DOUBLE FROM (SELECT DISTINCT list FROM lt) CROSS JOIN v)""",
}

BASE = _BASE
SQL = {name: f"WITH {_BASE} {body}" for name, body in _BODIES.items()}
