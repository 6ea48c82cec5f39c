"""Text helpers as column expressions (no Python per row)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Collapse white space runs and trim."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def count_matches(c: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(pattern)), F.lit(0))


def beginning(chars: str, pattern: str) -> str:
    """A pattern whose matches begin with one of ``chars``, which a look ahead finds faster than its alternatives do."""
    return f"(?i)(?=[{chars}])(?:{pattern.removeprefix('(?i)')})"


def word_count(c: Column) -> Column:
    return count_matches(c, r"\S+")


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def first_tokens(c: Column, n: int) -> Column:
    """The first ``n`` tokens; the rest of the text is not cut up."""
    # one blank token may lead, and the last part is the rest
    return F.slice(F.filter(F.slice(F.split(c, r"\s+", n + 2), 1, n + 1), lambda x: x != ""), 1, n)


def content_hash(c: Column) -> Column:
    return F.sha2(squeeze(c), 256)


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, null when there is no match or it is empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def any_of(c: Column, needles: list[str]) -> Column:
    """True when the text contains one of the needles."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(n)) for n in needles])


def ladder(value: Column, steps: list[tuple[float, object]], default: object) -> Column:
    """First result whose threshold the value reaches (steps sorted high to low)."""
    (t0, r0), *rest = steps
    out = F.when(value >= t0, F.lit(r0))
    for t, r in rest:
        out = out.when(value >= t, F.lit(r))
    return out.otherwise(F.lit(default))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def straight_quotes(c: Column) -> Column:
    return F.translate(c, "’‘“”", "''\"\"")


# ---- readability ---------------------------------------------------------


def sentence_count(c: Column) -> Column:
    """Runs of text between sentence marks that hold a non-blank character."""
    return F.greatest(F.lit(1), count_matches(c, r"[^.!?\s][^.!?]*"))


# ASCII words bounded by non-word characters in the Unicode sense
WORD = r"(?U)\b[a-zA-Z]+\b"


def plain_word_count(c: Column) -> Column:
    return count_matches(c, WORD)


def syllable_count(c: Column) -> Column:
    """Vowel groups per word, silent final e dropped, one at least per word.

    Words of one or two letters count 1. The text is scanned in a fixed number
    of regex passes, so cost is linear in its length.
    """
    words = F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))

    def syllables(w: Column) -> Column:
        silent = w.endswith("e") & ~w.endswith("le")
        core = F.when(silent, F.left(w, F.length(w) - 1)).otherwise(w)
        groups = F.regexp_count(core, F.lit("[aeiouy]+"))
        return F.when(F.length(w) <= 2, F.lit(1)).otherwise(F.greatest(F.lit(1), groups))

    total = F.aggregate(F.transform(words, syllables), F.lit(0), lambda a, x: a + x)
    return F.greatest(F.lit(1), total)


def flesch_reading_ease(words: Column, sentences: Column, syllables: Column) -> Column:
    score = F.lit(206.835) - F.lit(1.015) * (words / sentences) - F.lit(84.6) * (syllables / words)
    return F.when(words == 0, F.lit(0.0)).otherwise(clamp(score, 0.0, 100.0))


def round_even(c: Column, digits: int) -> Column:
    """Half-even rounding of the scaled double; ``bround`` rounds the printed decimals, which end above a tie that the product meets."""
    return F.rint(c * 10.0**digits) / 10.0**digits


def grade_level(words: Column, sentences: Column, syllables: Column) -> Column:
    grade = F.lit(0.39) * (words / sentences) + F.lit(11.8) * (syllables / words) - F.lit(15.59)
    return F.when(words == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), round_even(grade, 1)))


def let(value: Column, body) -> Column:
    """Bind an expression once so that lambdas do not evaluate it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)
