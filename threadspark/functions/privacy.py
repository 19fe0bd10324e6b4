"""Redaction of personal data inside one text."""

from pyspark.sql import Column, functions as F

from threadspark import fixed_values as fv


# What a text must hold at least for each pattern to match, in the same order.  The test is far
# cheaper than the pattern and most texts fail it.
NEEDS = ["[1-9][0-9]{4}", "(?iu)微信|v|w", "@", "[0-9]{15}", "1[3-9][0-9]", "[0-9]{7}"]


def _step(value: Column, need: str, pattern: str, placeholder: str) -> Column:
    """One replacement of a text that is computed once (a one-element array binds it to a name)."""
    replaced = F.transform(
        F.array(value),
        lambda v: F.when(v.rlike(need), F.regexp_replace(v, pattern, placeholder)).otherwise(v),
    )
    return replaced[0]


def redact_sensitive(value: Column) -> Column:
    for need, (pattern, placeholder) in zip(NEEDS, fv.SENSITIVE, strict=True):
        value = _step(value, need, pattern, placeholder)
    return value


def contains_sensitive(value: Column) -> Column:
    test = F.lit(False)
    for need, (pattern, _) in zip(NEEDS, fv.SENSITIVE, strict=True):
        test = test | (value.rlike(need) & value.rlike(pattern))
    return test


def redact_unknown_names(value: Column) -> Column:
    """Mentions and reply targets that are not known authors become a placeholder."""
    value = F.regexp_replace(value, fv.UNKNOWN_MENTION, "@" + fv.NAME_PLACEHOLDER)
    return F.regexp_replace(value, fv.UNKNOWN_TARGET, "$1" + fv.NAME_PLACEHOLDER)
