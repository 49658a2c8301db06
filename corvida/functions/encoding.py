"""Repair of texts whose UTF-8 bytes were read in a one-byte encoding, as column expressions.

A misread character is a lead letter with one to three followers. If a text has one that clean text hardly
holds, all its runs of them whose bytes are valid UTF-8 are read anew; up to three times, for texts that
were misread more than once. The rest of the text, whatever it holds, stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that the bytes 0x80 to 0x9F stand for in windows-1252 (five stand for themselves).
_HIGH = {
    0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž",
    0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ",
}
_SHOWN, _BYTES = "".join(_HIGH.values()), "".join(map(chr, _HIGH))
_NEXT = rf"[\x80-\xBF{_SHOWN}]"
_TWO, _LONG = rf"[\xC2-\xDF]{_NEXT}", rf"(?:[\xE0-\xEF]{_NEXT}{{2}}|[\xF0-\xF4]{_NEXT}{{3}})"
#: What shows that a text was misread: Â or Ã, the leads of western letters and signs, with a follower; the leads
#: of quotes, dashes, currencies and emoji with theirs; or two further characters side by side. A single one of
#: another kind may be clean text, such as é before a fixed space and a closing quote.
_SURE = rf"(?=[\xC2-\xF4])(?:[\xC2\xC3]{_NEXT}|\xE2[€‚„]{_NEXT}|\xF0Ÿ{_NEXT}{{2}}|{_LONG}{{2}}|(?:{_TWO}){{2}})"
_RUN = rf"(?:{_LONG}|{_TWO})+"


def misread(text: Column) -> Column:
    """The UTF-8 bytes of a text as windows-1252 shows them."""
    return F.translate(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), _BYTES, _SHOWN)


def _read_anew(run: Column) -> Column:
    """A run's bytes as UTF-8, or the run itself if they aren't valid."""
    raw = F.encode(F.translate(run, _SHOWN, _BYTES), "ISO-8859-1")
    return F.coalesce(F.try_validate_utf8(raw.cast("string")), run)


def _joined(text: Column) -> Column:
    rest, runs = F.split(text, _RUN), F.regexp_extract_all(text, F.lit(_RUN), F.lit(0))
    return F.array_join(F.zip_with(rest, runs, lambda a, b: F.concat(a, F.coalesce(_read_anew(b), F.lit("")))), "")


def repaired(text: Column, times: int = 3) -> Column:
    """The text with its misread runs read anew. Null stays null, empty stays empty; a text without a sure sign is
    unchanged and looked at once."""
    if not times:
        return text
    # a step names its text several times: bound once
    again = F.get(F.transform(F.array(_joined(text)), lambda t: repaired(t, times - 1)), F.lit(0))
    return F.when(F.regexp_like(text, F.lit(_SURE)), again).otherwise(text)
