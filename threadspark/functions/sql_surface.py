"""SQL functions and views for users who write SQL text.

``redact_sensitive(text)``, ``contains_sensitive(text)`` and ``estimate_tokens(text)`` become temporary functions whose bodies
are SQL, so Catalyst inlines them like built-in ones.  Names depend on a thread's authors: they have a view.
"""

from pyspark.sql import DataFrame, SparkSession

from threadspark import fixed_values as fv
from threadspark.functions.privacy import NEEDS


def _literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _replaced(value: str, pattern: str, by: str) -> str:
    return f"regexp_replace({value}, {_literal(pattern)}, {_literal(by)})"


def _step(value: str, need: str, pattern: str, by: str) -> str:
    """One replacement where ``need`` is found, which is far cheaper to look for; the one-element array binds ``value`` to a name."""
    return f"transform(array({value}), v -> CASE WHEN v RLIKE {_literal(need)} THEN {_replaced('v', pattern, by)} ELSE v END)[0]"


def function_bodies() -> dict[str, tuple[str, str]]:
    """Return type and body by name; the argument is ``text``."""
    redacted = "text"
    for need, (pattern, placeholder) in zip(NEEDS, fv.SENSITIVE, strict=True):
        redacted = _step(redacted, need, pattern, placeholder)
    contained = " OR ".join(f"(text RLIKE {_literal(need)} AND text RLIKE {_literal(pattern)})" for need, (pattern, _) in zip(NEEDS, fv.SENSITIVE, strict=True))
    plain, wide = (f"length({_replaced('text', pattern, '')})" for pattern in (r"[^\x00-\x7F]+", r"[^\x{10000}-\x{10FFFF}]+"))
    tokens = f"transform(array({plain}), plain -> CAST(length(text) - plain + {wide} + ceil(plain / 3) AS BIGINT))[0]"
    return {"redact_sensitive": ("STRING", redacted), "contains_sensitive": ("BOOLEAN", contained), "estimate_tokens": ("BIGINT", tokens)}


def register_functions(spark: SparkSession) -> list[str]:
    """Creates the functions in this session and gives their names."""
    for name, (kind, body) in function_bodies().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS {kind} RETURN {body}")
    return list(function_bodies())


def register_redacted(replies: DataFrame, view: str = "redacted_replies") -> None:
    """A view of ``replies`` with ``author_alias`` and ``redacted``: personal data and the thread's names removed."""
    from threadspark.operators.payloads import redacted_replies

    redacted_replies(replies).createOrReplaceTempView(view)
