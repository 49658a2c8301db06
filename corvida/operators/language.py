"""Language by a vote of stop words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvida.functions.text import word_tokens

#: Common words of each language.
STOP_WORDS = {
    "de": ("der", "die", "das", "und", "ist", "ich", "nicht", "ein", "eine", "zu", "den", "mit", "von", "auf", "sich", "im"),
    "en": ("the", "and", "is", "of", "to", "in", "that", "it", "was", "for", "with", "are", "this", "be", "on", "have"),
    "es": ("el", "la", "de", "que", "y", "en", "los", "las", "por", "con", "una", "del", "se", "es", "para", "como"),
    "fr": ("le", "la", "les", "de", "et", "un", "une", "des", "est", "que", "dans", "pour", "pas", "qui", "sur", "il"),
}


def votes(docs: DataFrame) -> DataFrame:
    """doc_id, lang_pred (null without any stop word), the number of that language's stop words in the text."""
    words = word_tokens(F.col("text"))
    counts = []
    for i, (lang, own) in enumerate(sorted(STOP_WORDS.items())):
        hits = F.array_intersect(F.array(*map(F.lit, own)), F.col("w"))
        counts.append(F.struct(F.size(hits).alias("n"), F.lit(-i).alias("order"), F.lit(lang).alias("lang")))
    rows = docs.select("doc_id", words.alias("w")).select("doc_id", F.array_max(F.array(*counts)).alias("best"))
    return rows.select("doc_id", F.when(F.col("best.n") > 0, F.col("best.lang")).alias("lang_pred"), F.col("best.n").cast("long").alias("votes"))


def without_foreign(docs: DataFrame, lang: str = "en", least_votes: int = 1) -> DataFrame:
    """The documents in the language, and those too short to tell."""
    seen = votes(docs).where((F.col("lang_pred") != lang) & (F.col("votes") >= least_votes)).select("doc_id")
    return docs.join(seen, "doc_id", "left_anti")
