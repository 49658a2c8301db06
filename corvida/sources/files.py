"""Files in and out: typed CSV, survey CSV, messages, concept lists, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvida.functions.slices import epoch, formatted
from corvida.functions.text import missing_to_null

TYPES = ("date", "number", "score", "string")
TITLE = 64
METADATA = "array<struct<name:string,type:string,value:string>>"


def _header(spark: SparkSession, path: str, rows: int = 1) -> list[list[str]]:
    """The first lines of a CSV, parsed by Spark, without a byte order mark."""
    first = spark.read.csv(path, header=False, multiLine=True, inferSchema=False).limit(rows).collect()
    return [[(x or "").lstrip("﻿") for x in row] for row in first]


def _body(spark: SparkSession, path: str, skip: int, columns: int) -> DataFrame:
    """All lines but the header of each file and ``skip`` - 1 more of the first, as columns c0, c1, ... and the line's number."""
    schema = ", ".join(f"c{i} string" for i in range(columns))
    df = spark.read.schema(schema).csv(path, header=True, multiLine=True, enforceSchema=True)
    return df.select("*", (F.monotonically_increasing_id() + 1).alias("line")).where(F.col("line") >= skip)


def _entries(kind: str, name: str, value: Column) -> Column:
    """The metadata entries of a cell; a string with bars has several values."""
    value = missing_to_null(value)
    values = F.split(value, r"\|") if kind == "string" else F.array(epoch(value).cast("string") if kind == "date" else value.try_cast("double").cast("string"))
    entries = F.transform(values, lambda v: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), F.trim(v).alias("value")))
    return F.coalesce(F.filter(entries, lambda e: e["value"].isNotNull() & (e["value"] != "")), F.array().cast(METADATA))


def typed_csv(spark: SparkSession, path: str, offset: int = 0, max_text: int = 0, keep: str | None = None) -> DataFrame:
    """Reads ``text``, ``title`` and ``type_name`` columns into doc_id, text, title, metadata.

    There is exactly one text column; rows with a blank text are left out; ``keep`` is a filter
    such as ``lang=en,fr|source=web``. Repeated headers make a field with several values."""
    header = [x.strip() for x in _header(spark, path)[0]]
    kinds = [(h.lower(), "") if h.lower() in ("text", "title") else tuple(h.split("_", 1)) if "_" in h else (h, "") for h in header]
    kinds = [(k.lower(), n) for k, n in kinds]
    if [k for k, _ in kinds].count("text") != 1:
        raise ValueError("exactly one text column is needed")
    bad = [h for h, (k, _) in zip(header, kinds, strict=True) if k not in (*TYPES, "text", "title")]
    if bad:
        raise ValueError(f"unknown column types: {bad}")
    at = {k: F.col(f"c{i}") for i, (k, _) in enumerate(kinds) if k in ("text", "title")}
    entries = [_entries(k, n, F.col(f"c{i}")) for i, (k, n) in enumerate(kinds) if k in TYPES]
    metadata = F.concat(*entries) if entries else F.array().cast(METADATA)
    text = F.substring(at["text"], 1, max_text) if max_text else at["text"]
    title = F.substring(at["title"], 1, TITLE) if "title" in at else F.lit("")
    rows = _body(spark, path, 1 + offset, len(header)).where(F.trim(at["text"]) != "")
    out = rows.select((F.col("line") - 1).alias("doc_id"), text.alias("text"), F.coalesce(title, F.lit("")).alias("title"), metadata.alias("metadata"))
    for part in (keep or "").split("|"):
        if part:
            name, _, values = part.partition("=")
            out = out.where(_has(name, values.split(",")))
    return out


def _has(name: str, values: list[str]) -> Column:
    return F.exists("metadata", lambda e: (e["name"] == name) & e["value"].isin(*values))


def survey_csv(spark: SparkSession, path: str) -> DataFrame:
    """Reads a survey: a row of types (``text & string`` is both), a row of names, then answers.

    Each text column becomes a document of its own, with the question as metadata."""
    types, names = _header(spark, path, 2)
    rows = _body(spark, path, 2, len(types))
    kinds = [[k.strip().lower() for k in t.split("&")] for t in types]
    titles = [F.col(f"c{i}") for i, k in enumerate(kinds) if "title" in k]
    entries = [_entries(k, names[i], F.col(f"c{i}")) for i, ks in enumerate(kinds) for k in ks if k in TYPES]
    metadata = F.concat(*entries) if entries else F.array().cast(METADATA)
    answers = F.array(*(F.struct(F.lit(names[i]).alias("question"), F.col(f"c{i}").alias("text")) for i, k in enumerate(kinds) if "text" in k))
    # a select of its own: beside an explode the names of struct fields are lost
    rows = rows.select((F.col("line") - 2).alias("row"), F.substring(F.concat_ws("_", *titles), 1, TITLE).alias("title"), metadata.alias("metadata"), answers.alias("answers"))
    rows = rows.select("row", "title", "metadata", F.explode("answers").alias("a"))
    question = F.array(F.struct(F.lit("Question").alias("name"), F.lit("string").alias("type"), F.col("a.question").alias("value")))
    return rows.where(F.trim("a.text") != "").select("row", "title", F.col("a.text").alias("text"), F.concat("metadata", question).alias("metadata"))


def messages(spark: SparkSession, path: str) -> DataFrame:
    """Texts of JSON lines (also packed) or of a CSV with a text column."""
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, multiLine=True).select("text")
    return spark.read.json(path)


def concept_lists(spark: SparkSession, path: str) -> DataFrame:
    """list, concept, texts, color from CSV or JSON; headers may have spaces around them."""
    if path.endswith(".json"):
        rows = spark.read.json(path, multiLine=True).select("concept_list_name", F.explode("concepts").alias("c"))
        return rows.select(F.col("concept_list_name").alias("list"), F.col("c.name").alias("concept"), F.transform(F.split("c.texts", ","), F.trim).alias("texts"), F.col("c.color").alias("color"))
    rows = spark.read.csv(path, header=True)
    rows = rows.toDF(*(c.strip() for c in rows.columns))
    return rows.select(F.col("concept_list_name").alias("list"), F.trim(F.coalesce("name", "texts")).alias("concept"), F.transform(F.split("texts", ","), F.trim).alias("texts"), F.trim("color").alias("color"))


def write_concept_lists(lists: DataFrame, path: str) -> None:
    """One CSV row for each concept, texts joined by commas."""
    lists.select(F.col("list").alias("concept_list_name"), F.array_join("texts", ",").alias("texts"), F.col("concept").alias("name"), "color").write.mode("overwrite").csv(path, header=True)


def scraped(rows: DataFrame) -> DataFrame:
    """Rows of (Content, Title, Source, Date, Name, Rating) as documents; blank and null are missing."""
    field = lambda n, t, v: F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"), v.alias("value"))
    date = F.coalesce(F.try_to_timestamp("Date", F.lit("MMM d, yyyy")), F.try_to_timestamp("Date", F.lit("yyyy-MM-dd")))
    entries = [field(n, "string", missing_to_null(F.col(n))) for n in ("Source", "Name")] + [field("Rating", "score", F.col("Rating").try_cast("double").cast("string")), field("Date", "date", F.unix_timestamp(date).cast("string"))]
    metadata = F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
    return rows.where(missing_to_null(F.col("Content")).isNotNull()).select(F.col("Content").alias("text"), F.coalesce(missing_to_null(F.col("Title")), F.lit("")).alias("title"), metadata.alias("metadata"))


def to_rows(docs: DataFrame, fields: list[tuple[str, str]], date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Documents with a column for each (type, name); several values are sorted and joined by a bar."""
    def column(kind: str, name: str) -> Column:
        values = F.transform(F.filter("metadata", lambda e: (e["name"] == name) & (e["type"] == kind)), lambda e: e["value"])
        values = F.transform(values, lambda v: formatted(v, date_format)) if kind == "date" else values
        return F.array_join(F.array_sort(F.array_distinct(values)), "|").alias(f"{kind}_{name}")

    return docs.select("text", "title", *(column(k, n) for k, n in fields))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One header for each file; ``mode='ignore'`` keeps what is there."""
    df.write.mode(mode).option("header", True).option("quoteAll", False).csv(path)


def shaped(df: DataFrame, columns: list[tuple[str, str, int | None]], project_id: str | None = None, legacy_fill: bool = False) -> DataFrame:
    """A table's columns (name, type, longest): texts are cut, missing columns are null, or 0 and '' on request."""
    out = [F.lit(project_id).alias("project_id")] if project_id is not None else []
    for name, kind, longest in columns:
        col = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        if kind == "string" and longest:
            col = F.substring(col, 1, longest)
        if legacy_fill:
            col = F.coalesce(col, F.lit("" if kind == "string" else 0).cast(kind))
        out.append(col.alias(name))
    return df.select(*out)
