"""Emotions of texts through a hook that can be exchanged.

A hook takes a text column and returns an array<string> of words or names of emotions: a column expression, a
pandas UDF around a model, a call of a service. What it returns is placed on the wheel in the same way.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvida.functions import text as T

Hook = Callable[[Column], Column]
HOOKS: dict[str, Hook] = {}


def hook(name: str) -> Callable[[Hook], Hook]:
    """Registers a hook under a name; a later one of the same name takes its place."""

    def keep(f: Hook) -> Hook:
        HOOKS[name] = f
        return f

    return keep


@hook("lexicon")
def _lexicon(text: Column) -> Column:
    """Every word of the text; the wheel itself is the lexicon."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0)))


@hook("lexicon_arrow")
def _lexicon_arrow(text: Column) -> Column:
    """The same in Arrow batches, as a model would be called."""

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        return texts.fillna("").str.lower().str.findall("[a-z]+").map(lambda w: list(dict.fromkeys(w)))

    return words(text)


def placed(docs: DataFrame, using: str | Hook = "lexicon", words: int | None = None) -> DataFrame:
    """doc_id, name, value: a metadata value for each list of the wheel and entry that a document's emotions name.

    docs: doc_id, text. ``words``: give the hook that many first words only, as one that is paid by length wants.
    Emotions that no list or several entries hold, empty ones and nulls place nothing; a document has each value once."""
    name = HOOKS[using] if isinstance(using, str) else using
    text = F.col("text") if words is None else T.first_words(F.col("text"), words)
    found = docs.select("doc_id", name(text).alias("emotions")).select("doc_id", F.explode("emotions").alias("emotion")).where("emotion <> ''")
    at = found.select("doc_id", T.emotion_of(F.col("emotion")).alias("at")).where("at is not null")
    return at.select("doc_id", F.col("at.list").alias("name"), F.col("at.entry").alias("value")).distinct()
