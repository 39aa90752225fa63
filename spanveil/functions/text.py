"""Whole-text expressions: masking, scrubbing, normalising, language by script and stop words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.dims import SCRUB

#: dashes that become a plain one
DASHES = "‐‑‒–—―﹘﹣－"
#: commonest short words of a language, for texts in Latin letters
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "is", "in", "that", "it", "with", "for", "are", "was", "this"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "von", "mit", "den", "ein", "eine", "auf", "zu"],
    "fr": ["le", "la", "les", "des", "et", "est", "une", "du", "que", "qui", "dans", "pour", "pas"],
    "es": ["el", "los", "las", "que", "del", "una", "por", "con", "para", "no", "es", "y", "se"],
    "pt": ["os", "as", "que", "do", "da", "em", "um", "uma", "com", "não", "para", "dos", "e"],
}


def scrubbed(text: Column) -> Column:
    for regex, label in SCRUB:
        text = F.regexp_replace(text, regex, label.replace("[", r"\[").replace("]", r"\]"))
    return text


def fences_masked(text: Column) -> Column:
    """Closed ``` blocks and `inline` code on one line blanked; line breaks and length stay. The masked part is found first, then blanked in place."""
    from ..operators.spans import matches

    found = matches(text, r"```[\s\S]*?```|`[^`\n]+`")
    step = lambda acc, m: F.concat(F.substring(acc, F.lit(1), m["start"]), F.regexp_replace(m["value"], "[^\n]", " "), F.substring(acc, m["end"] + 1, F.length(acc)))
    return F.aggregate(found, text, step)


def plain_dashes(text: Column) -> Column:
    return F.translate(text, DASHES, "-" * len(DASHES))


def unescaped(text: Column) -> Column:
    return F.replace(text, F.lit("\\_"), F.lit("_"))


def language(text: Column, least: float = 0.15, least_bytes: int = 20) -> Column:
    """Language by script (zh, ja, ko, ar) or by the share of words that are stop words; null for short or unclear texts."""
    from ..operators.spans import bound

    letters = F.greatest(F.length(F.regexp_replace(text, r"[^\p{L}]", "")), F.lit(1))
    classes = {"ja": (r"\x{3040}-\x{30FF}", 0.1), "ko": (r"\x{AC00}-\x{D7AF}", 0.3), "ar": (r"\x{0600}-\x{06FF}", 0.3), "zh": (r"\x{4E00}-\x{9FFF}", 0.3)}
    over = [(F.length(F.regexp_replace(text, f"[^{chars}]", "")) / letters > least_share, name) for name, (chars, least_share) in classes.items()]
    script = F.coalesce(*(F.when(hit, F.lit(name)) for hit, name in over))
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")

    def latin(ws: Column) -> Column:
        scores = F.array(*(F.struct(_stops(ws, k).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("lang")) for i, k in enumerate(STOP_WORDS)))
        return bound(scores, lambda s: bound(F.array_max(s), lambda best: F.when(best["n"] >= least * F.greatest(F.size(ws), F.lit(1)), best["lang"])))

    # most texts have no letter of the other scripts, and pay for one look
    other = F.when(F.regexp_like(text, F.lit("[" + "".join(c for c, _ in classes.values()) + "]")), script)
    return F.when(F.octet_length(text) >= least_bytes, F.coalesce(other, bound(words, latin)))


def _stops(words: Column, lang: str) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(STOP_WORDS[lang])))


def path_segments(path: Column) -> Column:
    """a[0].b as its segments."""
    return F.regexp_extract_all(path, F.lit(r"([^.\[\]]+)"), F.lit(1))


def words_and_marks(text: Column) -> Column:
    """Words of letters, digits and apostrophes; each other mark is a token of its own."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}']+|[^\p{L}\p{N}'\s]"), F.lit(0))
