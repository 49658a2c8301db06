"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"(?U)\S+|\n"
NEWLINE, GAP, EDGE = "^^^", "___", "¶"


def tokens(text: Column) -> Column:
    """Runs of non-space and newlines, lower-case; a newline is one token of its own."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.transform(raw, lambda t: F.when(t == "\n", NEWLINE).otherwise(F.replace(F.lower(t), F.lit("ß"), F.lit("ss"))))


def word_tokens(text: Column) -> Column:
    """Lower-case words of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def ngrams(tok: Column, size: int) -> Column:
    """All runs of ``size`` tokens; none if there are fewer."""
    return F.when(F.size(tok) >= size, F.transform(F.sequence(F.lit(1), F.size(tok) - (size - 1)), lambda i: F.slice(tok, i, size))).otherwise(F.array().cast("array<array<string>>"))


def gapped(gram: Column, size: int) -> Column:
    """The variants of an n-gram with one inner word left open."""

    def open_at(k: int) -> Column:
        return F.transform(gram, lambda w, i: F.when(i == k, GAP).otherwise(w))

    return F.array(*map(open_at, range(1, size - 1)))


def shorten_repeats(text: Column, most: int = 4, unit: str = r"\S+?") -> Column:
    """A unit repeated more than ``most`` times is kept that many times."""
    return F.regexp_replace(text, f"({unit})\\1{{{most},}}", "$1" * most)


def drop_url_tokens(text: Column) -> Column:
    """Without the space-separated tokens that hold a web address."""
    return F.array_join(F.filter(F.split(text, " "), lambda t: ~(t.contains("http") | t.contains("//www."))), " ")


def fix_apostrophes(text: Column) -> Column:
    return F.translate(text, "`´", "''")


def strip_language_tags(term: Column) -> Column:
    """``newest|en product|en`` -> ``newest product``."""
    return F.regexp_replace(term, r"\|[a-z]+(?=\s|\z)", "")


def before_bar(term: Column) -> Column:
    return F.substring_index(term, "|", 1)


def capitalised(name: Column) -> Column:
    """The first letter in upper case, the rest in lower case."""
    return F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, 1 << 30)))


def quoted(text: Column) -> Column:
    """Percent-quoted for a URL's path."""
    return F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def project_of(url: Column) -> Column:
    """Of ``root/app/projects/workspace/project``: root, api, workspace, project."""
    root = F.substring_index(url, "/app", 1)
    parts = F.split(url, "/")
    return F.struct(root.alias("root"), F.concat(root, F.lit("/api/v5")).alias("api"), F.get(parts, F.lit(5)).alias("workspace"), F.get(parts, F.lit(6)).alias("project"))


def first_words(text: Column, n: int = 100) -> Column:
    return F.array_join(F.slice(F.split(text, " "), 1, n), " ")


def missing_to_null(text: Column) -> Column:
    """Blank and the word null are null."""
    trimmed = F.trim(text)
    return F.when((trimmed == "") | (F.lower(trimmed) == "null"), None).otherwise(trimmed)


def spreadsheet_index(letters: Column) -> Column:
    """A -> 0, Z -> 25, AA -> 26."""
    codes = F.transform(F.split(F.upper(letters), ""), lambda c: F.ascii(c) - 64)
    return F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(0), lambda acc, c: acc * 26 + c) - 1


def highlighted(text: Column, spans: Column) -> Column:
    """The text with its spans (arrays of start and end character, apart from each other) shown in red as HTML."""

    def wrap(acc: Column, s: Column) -> Column:
        start, end = F.get(s, F.lit(0)), F.get(s, F.lit(1))
        marked = F.concat(F.lit('<span style="color:red">{'), F.substring(acc, start + 1, end - start), F.lit("}</span>"))
        return F.concat(F.substring(acc, F.lit(1), start), marked, F.substring(acc, end + 1, F.length(acc)))

    return F.aggregate(F.reverse(F.array_sort(F.coalesce(spans, F.array().cast("array<array<int>>")))), text, wrap)


def employee(status: Column) -> Column:
    """Of ``Former Employee - Manager``: status, title, position. The status is what stands before the first dash, the
    title what stands after the last, the position is the title, or Employee for an anonymous one."""
    title = F.trim(F.substring_index(status, "-", -1))
    position = F.when(F.contains(F.lower(title), F.lit("anonymous")), "Employee").otherwise(title)
    return F.struct(F.trim(F.substring_index(status, "-", 1)).alias("status"), title.alias("title"), position.alias("position"))


def rating_title(status: Column, stars: Column) -> Column:
    """``Former Manager gave 4 Stars``."""
    return F.concat_ws(" ", F.trim(F.substring_index(status, "Employee", 1)), employee(status)["position"], F.lit("gave"), stars.cast("int").cast("string"), F.lit("Stars"))


def joined_texts(texts: Column) -> Column:
    """Several texts as one, an edge between any two; nulls are passed over."""
    return F.array_join(texts, f" {EDGE} ")


def question_name(question_id: Column) -> Column:
    """``QID5`` -> ``Q5``; null if there is no such id inside."""
    number = F.regexp_extract(question_id, r"QID(\d+)", 1)
    return F.when(number != "", F.concat(F.lit("Q"), number))


#: The emotions by strength, and the blends of two.
EMOTIONS = (
    ("Emotion 1", ("A:Ecstasy", "B:Admiration", "C:Terror", "D:Amazement", "E:Grief", "F:Loathing", "G:Rage", "H:Vigilance")),
    ("Emotion 2", ("A:Joy", "B:Trust", "C:Fear", "D:Surprise", "E:Sadness", "F:Disgust", "G:Anger", "H:Anticipation")),
    ("Emotion 3", ("A:Serenity", "B:Acceptance", "C:Apprehension", "D:Distraction", "E:Pensiveness", "F:Boredom", "G:Annoyance", "H:Interest")),
    ("Emotion 4", ("Love", "Submission", "Awe", "Disapproval", "Remorse", "Contempt", "Aggressiveness", "Optimism")),
)


def emotion_of(word: Column, lexicons=EMOTIONS) -> Column:
    """(list, entry) of the first list in which exactly one entry holds the word, ignoring case; else null."""
    out = F.lit(None).cast("struct<list:string,entry:string>")
    for name, entries in reversed(lexicons):
        hits = F.filter(F.array(*map(F.lit, entries)), lambda e: F.contains(F.lower(e), F.lower(word)))
        out = F.when(F.size(hits) == 1, F.struct(F.lit(name).alias("list"), F.get(hits, F.lit(0)).alias("entry"))).otherwise(out)
    return out
