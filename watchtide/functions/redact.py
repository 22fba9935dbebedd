"""Redaction of credentials and personal identifiers in text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entity tag, pattern and replacement, in the order they apply.
# Cards start as issued cards do, so that times in milliseconds and request numbers stay. Cards go before phones. Phones need a plus sign or separators, so that
# twelve-digit account ids stay. No look-around, so that other engines can check them.
ENTITIES = (
    ("AWS_ACCESS_KEY", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "{AWS_ACCESS_KEY}"),
    (
        "AWS_SECRET_KEY",
        r"(?i)(secret_?(?:access_?)?key[\"']?\s*[:=]\s*[\"']?)[A-Za-z0-9/+]{40}",
        "$1{AWS_SECRET_KEY}",
    ),
    ("PASSWORD", r"(?i)(\b(?:password|passwd|pwd)[\"']?\s*[:=]\s*[\"']?)[^\s\"',;{}]+", "$1{PASSWORD}"),
    ("EMAIL", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "{EMAIL}"),
    (
        "CREDIT_DEBIT_CARD_NUMBER",
        r"\b(?:4\d{12}(?:\d{3})?|(?:5[1-5]|2[2-7])\d{14}|3[47]\d{13}|6(?:011|5\d{2})\d{12}"
        r"|(?:4\d{3}|5[1-5]\d{2}|2[2-7]\d{2}|6(?:011|5\d{2}))[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}|3[47]\d{2}[ \-]\d{6}[ \-]\d{5})\b",
        "{CREDIT_DEBIT_CARD_NUMBER}",
    ),
    ("US_SOCIAL_SECURITY_NUMBER", r"\b\d{3}-\d{2}-\d{4}\b", "{US_SOCIAL_SECURITY_NUMBER}"),
    (
        "PHONE",
        r"(?:\+\d{1,3}[ \-]?)?\(\d{3}\) ?\d{3}[ \-]\d{4}\b|\+\d{1,3}[ \-]?\d{2,4}(?:[ \-]?\d{2,4}){1,3}\b|\b\d{3}-\d{3}-\d{4}\b",
        "{PHONE}",
    ),
)
# Resource names are evidence and stay as they are, whatever they contain.
RESOURCE_NAME = r"arn:aws[^\s\"',;<>]*"


# What a text must hold for an entity to be in it, tested before the pattern is tried: plain searches, and one pass for
# four digits in a row, which every card, security number and phone without a plus sign has.
FOUR_DIGITS = "[0-9]{4}"


def _may_hold(text: Column) -> dict[str, Column]:
    lower, digits = F.lower(text), text.rlike(FOUR_DIGITS)
    return {
        "AWS_ACCESS_KEY": text.contains("AKIA") | text.contains("ASIA"),
        "AWS_SECRET_KEY": lower.contains("secret"),
        "PASSWORD": lower.contains("pass") | lower.contains("pwd"),
        "EMAIL": text.contains("@"),
        "CREDIT_DEBIT_CARD_NUMBER": digits,
        "US_SOCIAL_SECURITY_NUMBER": digits & text.contains("-"),
        "PHONE": text.contains("+") | (digits & text.contains("-")) | (digits & text.contains(")")),
    }


def _replace_if(may: Column, pattern: str, replacement: str) -> Callable[[Column], Column]:
    return lambda t: F.when(may, F.regexp_replace(t, pattern, replacement)).otherwise(t)


def _redact_plain(text: Column) -> Column:
    """Each entity's pattern, only over texts that may hold it. What patterns look for is never in a tag, so all tests
    read the text as it came. A step is a function of one variable: the expression grows by it, not twofold."""
    found = text
    for (_, pattern, replacement), may in zip(ENTITIES, _may_hold(text).values(), strict=True):
        found = F.transform(F.array(found), _replace_if(may, pattern, replacement))[0]
    return found


def redact(text: Column) -> Column:
    """`text` with each entity replaced by its tag; text inside resource names is left alone."""
    between = F.split(text, RESOURCE_NAME, -1)
    names = F.regexp_extract_all(text, F.lit(RESOURCE_NAME), F.lit(0))
    rebuilt = F.zip_with(between, names, lambda part, name: F.concat(_redact_plain(part), F.coalesce(name, F.lit(""))))
    return F.when(text.contains("arn:aws"), F.array_join(rebuilt, "")).otherwise(_redact_plain(text))


def entity_counts(text: Column) -> dict[str, Column]:
    """Entity tag to the number of tags of that kind in redacted text."""
    return {
        name: ((F.length(text) - F.length(F.replace(text, F.lit("{" + name + "}"), F.lit("")))) / len("{" + name + "}")).cast("long")
        for name, _, _ in ENTITIES
    }
