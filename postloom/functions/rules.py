"""Rule tables compiled to column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions import fixed_values as fixed
from postloom.functions.columns import any_pattern, any_phrase, contains

Rules = Sequence[tuple[str, str]]
NO_MATCH = "(no match)"


def last_matching_label(text: Column, rules: Rules, default: str = NO_MATCH) -> Column:
    """Label of the last rule in the table that matches; later rules override earlier ones."""
    return F.coalesce(*[F.when(contains(text, p), F.lit(label)) for label, p in reversed(rules)], F.lit(default))


def matches_any(text: Column, rules: Rules) -> Column:
    return contains(text, any_pattern([p for _, p in rules])) if rules else F.lit(False)


def offer_flag(
    text: Column,
    include: Rules = fixed.OFFER_INCLUDE,
    exclude: Rules = fixed.OFFER_EXCLUDE,
    candidate: str = fixed.OFFER_CANDIDATE,
) -> Column:
    """True for a candidate that an include rule matches and no exclude rule.

    All exclude rules come after all include rules, so under "last match wins"
    a single exclude match decides. The candidate test runs first.
    """
    decided = F.when(matches_any(text, include), ~matches_any(text, exclude)).otherwise(F.lit(False))
    return F.when(contains(text, candidate), decided).otherwise(F.lit(False))


def offer_label(
    text: Column,
    include: Rules = fixed.OFFER_INCLUDE,
    exclude: Rules = fixed.OFFER_EXCLUDE,
    candidate: str = fixed.OFFER_CANDIDATE,
) -> Column:
    """Name of the winning rule of a candidate; null for other comments."""
    return F.when(contains(text, candidate), last_matching_label(text, [*include, *exclude]))


def referral_flag(text: Column, mention: str = fixed.REFERRAL_MENTION) -> Column:
    return contains(text, mention)


def request_flag(text: Column, phrases: Sequence[str] = fixed.REQUEST_PHRASES) -> Column:
    """True when the text holds one of the request phrases as whole words."""
    return contains(text, any_phrase(phrases))


def rule_flags(text: Column, rules: Rules) -> list[Column]:
    """One boolean column per rule."""
    return [contains(text, p).alias(name) for name, p in rules]


def platform_flags(text: Column, compat: bool = False) -> list[Column]:
    """The ten platform cues. ``compat`` reads the bracketed tokens as character classes."""
    flags = []
    for name, pattern in fixed.PLATFORM_CUES:
        flag = contains(text, pattern)
        if compat and name in fixed.CLASS_CUES:
            flag = contains(text, fixed.CLASS_CUES[name], ignore_case=False)
        if name == "previous_experience":
            # the open-ended pattern runs only on texts that can match it
            flag = flag | (contains(text, fixed.POSITION_HINT) & contains(text, fixed.POSITION_HELD))
        flags.append(flag.alias(name))
    return flags


def literature_flags(text: Column) -> list[Column]:
    """The twelve cues taken from the literature."""
    return rule_flags(text, fixed.LITERATURE_CUES)
