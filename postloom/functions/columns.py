"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Regex flags that give Java the Unicode classes, line ends and case folding
# of the rules' own dialect: (?U) Unicode classes, (?d) only \n ends a line.
UNICODE = "(?dU)"
UNICODE_NOCASE = "(?idU)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Whitespace-separated words; an empty or blank text has none."""
    return F.filter(F.split(text_or_empty(text), r"(?U)\s+"), lambda w: w != F.lit(""))


def contains(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Regex search where a null text is false."""
    return F.coalesce(text.rlike((UNICODE_NOCASE if ignore_case else UNICODE) + pattern), F.lit(False))


def any_pattern(patterns: Sequence[str]) -> str:
    """One alternation that matches where any of the patterns does."""
    return "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"


def any_phrase(phrases: Sequence[str]) -> str:
    """One word-bounded alternation of plain phrases."""
    return r"\b(?:" + "|".join(phrases) + r")\b"


def cap(value: Column, bound: int | float) -> Column:
    return F.when(value.isNotNull(), F.least(value, F.lit(bound)))


def floor_to(value: Column, step: float) -> Column:
    return F.floor(value / F.lit(step)) * F.lit(step)


def log_grid(low: float, high: float, n: int) -> list[float]:
    """``n`` log-spaced values from ``low`` to ``high``, both included."""
    return [low * (high / low) ** (i / (n - 1)) for i in range(n)]


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(text.substr(F.lit(2), F.length(text))))


def remove_prefix_marker(name: Column, marker: str = "ex-") -> Column:
    """Drop every occurrence of the former-employer marker."""
    return F.replace(name, F.lit(marker), F.lit(""))


def without_accents(text: Column) -> Column:
    """Fold Latin letters with diacritics to their base letters, and letters without a base letter to their usual spelling."""
    out = F.translate(text, ACCENTED, PLAIN)
    for letter, spelt in SPELT.items():
        out = F.replace(out, F.lit(letter), F.lit(spelt))
    return out


# Latin letters with diacritics and their base letters.
ACCENTED = "ÀÁÂÃÄÅàáâãäåÈÉÊËèéêëÌÍÎÏìíîïÒÓÔÕÖØòóôõöøÙÚÛÜùúûüÇçÑñÝýÿŠšŽžĆćČčŁłŃńŚśŹźŻżĄąĘęĀāĒēĪīŌōŪūĞğİıŞş"
PLAIN = "AAAAAAaaaaaaEEEEeeeeIIIIiiiiOOOOOOooooooUUUUuuuuCcNnYyySsZzCcCcLlNnSsZzZzAaEeAaEeIiOoUuGgIiSs"

# Latin letters without a base letter, as they are spelt.
SPELT = {"ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th"}


def hash_unit(*key: Column) -> Column:
    """A uniform number in [0, 1) that depends only on the key, not on the partitioning."""
    digest = F.substring(F.md5(F.concat_ws(":", *[k.cast("string") for k in key])), 1, 13)
    return F.conv(digest, 16, 10).cast("long") / F.lit(float(16**13))
