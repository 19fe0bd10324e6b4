"""Scalar text functions as Catalyst expressions.

White space follows the ECMAScript definition (``SPACE``).  Lengths count code points.
The only Python step is Unicode normalisation, which Spark has no built-in for.
"""

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from threadspark import fixed_values as fv

ZERO_WIDTH = r"[\x{200B}-\x{200D}\x{FEFF}]"


def _normal_form(form):
    @F.pandas_udf(StringType())
    def normalize(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize(form, v))

    return normalize


nfc = _normal_form("NFC")
nfkc = _normal_form("NFKC")


def trim(value: Column) -> Column:
    # not $, which also matches before a line end that is no space of the class (U+0085)
    return F.regexp_replace(value, rf"^[{fv.SPACE}]+|[{fv.SPACE}]+\z", "")


def blank_to_null(value: Column) -> Column:
    trimmed = trim(value)
    return F.when(trimmed != "", trimmed)


def squeeze(value: Column) -> Column:
    return trim(F.regexp_replace(value, f"[{fv.SPACE}]+", " "))


def clean_text(value: Column) -> Column:
    visible = F.regexp_replace(F.coalesce(value, F.lit("")), ZERO_WIDTH, "")
    return trim(F.regexp_replace(visible, r"[\t\r\n\x{A0} ]+", " "))


def canonical_text(value: Column) -> Column:
    """NFC, LF line ends, blanks squeezed and lines trimmed; null stays null."""
    lines = F.split(F.regexp_replace(nfc(value), r"\r\n?", "\n"), "\n", -1)
    tidy = F.transform(lines, lambda line: trim(F.regexp_replace(line, r"[\t\f\x0B ]+", " ")))
    return trim(F.array_join(tidy, "\n"))


def dedupe_key(value: Column) -> Column:
    """Key under which near-identical posts of one author compare equal; it covers the whole text."""
    lowered = F.lower(nfkc(value))
    target = rf"(?:回复|回覆)[{fv.SPACE}]*(?:@[^{fv.SPACE}:：]+|[0-9]+楼)?[{fv.SPACE}]*[:：]?"
    return F.regexp_replace(F.regexp_replace(lowered, target, ""), r"[^\p{L}\p{N}]+", "")


def repeat_key(value: Column) -> Column:
    return squeeze(F.lower(nfkc(value)))


def flatten_content(parts: Column) -> tuple[Column, Column]:
    """(text, image count) of content parts ``array<struct<type,text,c,origin_src,cdn_src>>``."""

    def kind(part):
        return safe_int(part["type"])

    def is_image(part):
        return (
            (F.coalesce(kind(part), F.lit(-1)) == 3)
            | part["origin_src"].isNotNull()
            | part["cdn_src"].isNotNull()
        )

    def is_text(part):
        return ~is_image(part) & (kind(part).isNull() | kind(part).isin(0, 2, 4))

    present = F.filter(F.coalesce(parts, F.array()), lambda p: p.isNotNull())
    texts = F.transform(
        F.filter(present, is_text), lambda p: clean_text(F.coalesce(p["text"], p["c"]))
    )
    return clean_text(F.array_join(texts, "")), F.size(F.filter(present, is_image))


def excerpt(value: Column, limit: int = 160, keep: int = 157) -> Column:
    compact = squeeze(value)
    return F.when(
        F.length(compact) > limit, F.concat(F.substring(compact, 1, keep), F.lit("…"))
    ).otherwise(compact)


def reply_excerpt(value: Column) -> Column:
    text = trim(value)
    return (
        F.when(text == "", F.lit("（该回复没有可读取文字）"))
        .when(F.length(text) > 240, F.concat(F.substring(text, 1, 240), F.lit("…")))
        .otherwise(text)
    )


def text_availability(content: Column, image_count: Column) -> Column:
    """Class of readable text: ``no_text``, ``image_only``, ``mask_only``, ``preview`` or ``full``."""
    text = trim(content)
    return (
        F.when((text == "") & (image_count > 0), F.lit("image_only"))
        .when(text == "", F.lit("no_text"))
        .when(text.rlike(fv.MASK_ONLY), F.lit("mask_only"))
        .when(F.length(text) > fv.PREVIEW_LENGTH, F.lit("preview"))
        .otherwise(F.lit("full"))
    )


def text_preview(content: Column) -> Column:
    text = trim(content)
    return F.when(
        F.length(text) > fv.PREVIEW_LENGTH,
        F.concat(F.substring(text, 1, fv.PREVIEW_LENGTH), F.lit("…")),
    ).otherwise(text)


def removal_notice(text: Column) -> Column:
    """The removed / folded / hidden notice inside a text, or the empty string."""
    return F.regexp_extract(clean_text(text), fv.REMOVAL_NOTICE, 0)


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it; keeps nested expressions small."""
    return F.get(F.transform(F.array(value), body), 0)


# --- numbers and ids -------------------------------------------------------------------------


def safe_int(value: Column) -> Column:
    """Integer from a number or a digit string; null unless it is exactly representable."""
    digits = F.regexp_extract(value.cast("string"), f"^[{fv.SPACE}]*(-?[0-9]{{1,16}})[{fv.SPACE}]*$", 1)
    number = F.nullif(digits, F.lit("")).try_cast("bigint")
    return F.when(F.abs(number) <= 9007199254740991, number)


def safe_count(value: Column, fallback: int = 0) -> Column:
    number = safe_int(value)
    return F.when(number >= 0, number).otherwise(F.lit(fallback).cast("bigint"))


def valid_reply_id(value: Column) -> Column:
    text = trim(value)
    return F.when(text.rlike(r"^[0-9]{1,32}$"), text)


def parse_number(value: Column) -> Column:
    """Double from a decimal string, with an optional percent sign left unapplied."""
    text = trim(F.regexp_replace(trim(value), r"%$", ""))
    return F.when(
        text.rlike(r"(?i)^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:e[+-]?[0-9]+)?$"),
        text.try_cast("double"),
    )


def parse_confidence(value: Column) -> Column:
    number = parse_number(value)
    percent = trim(value).endswith("%") | number.between(70, 100)
    return F.when(percent, number / 100).otherwise(number)


def compact_count(value: Column) -> Column:
    """``1.2万`` -> 12000; commas are ignored; null without a number."""
    text = F.regexp_replace(clean_text(value), ",", "")
    digits = F.regexp_extract(text, fv.COMPACT_COUNT, 1)
    number = F.when(digits != "", digits.try_cast("decimal(30,8)"))
    unit = F.when(F.regexp_extract(text, fv.COMPACT_COUNT, 2) != "", F.lit(10000)).otherwise(F.lit(1))
    return F.floor(number * unit).cast("bigint")


def declared_count(header_text: Column) -> Column:
    digits = F.regexp_extract(clean_text(header_text), fv.DECLARED_COUNT, 1)
    return F.when(digits != "", digits.try_cast("bigint"))


def unexpanded_estimate(declared: Column, visible: Column, control_texts: Column) -> Column:
    """Lower bound of nested replies not shown, from a declared total and the expand controls."""

    def per_control(raw):
        text = clean_text(raw)
        remaining = F.regexp_extract(text, rf"(?:还有|剩余)[{fv.SPACE}]*([0-9]+)[{fv.SPACE}]*条", 1)
        total = F.regexp_extract(text, rf"(?:共|全部|查看全部)[{fv.SPACE}]*([0-9]+)[{fv.SPACE}]*条", 1)
        return (
            F.when(remaining != "", remaining.try_cast("bigint"))
            .when(total != "", total.try_cast("bigint") - visible)
            .when((text != "") & ~text.contains("收起") & text.rlike("展开|更多|查看"), F.lit(1))
            .otherwise(F.lit(0))
        )

    base = F.greatest(F.lit(0), F.coalesce(declared - visible, F.lit(0)))
    return F.greatest(
        base.cast("bigint"),
        F.coalesce(F.array_max(F.transform(control_texts, per_control)), F.lit(0)).cast("bigint"),
    )


# --- times -----------------------------------------------------------------------------------


def epoch_ms(value: Column) -> Column:
    """Epoch milliseconds from seconds or milliseconds; null when not a positive integer."""
    number = safe_int(value)
    return F.when(number <= 0, F.lit(None)).otherwise(
        F.when(number < 10_000_000_000, number * 1000).otherwise(number)
    )


def iso_time(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_forum_time(value: Column) -> Column:
    """Epoch ms of a date-time text; a bare ``H:MM[:SS]`` gives ms of the day.  UTC session assumed."""
    text = trim(value)
    text = F.regexp_replace(text, r"[年/.月]", "-")
    text = F.regexp_replace(F.regexp_replace(text, "日", ""), f"[{fv.SPACE}]+", " ")
    stamp = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})(?:[ T]([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?)?$"

    def part(index, pattern=stamp):
        digits = F.regexp_extract(text, pattern, index)
        return F.when(digits == "", F.lit(0)).otherwise(digits.try_cast("int"))

    hms = r"^([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?$"
    full = F.try_make_timestamp(part(1), part(2), part(3), part(4), part(5), part(6))
    seconds = part(1, hms) * 3600 + part(2, hms) * 60 + part(3, hms)
    return F.when(text.rlike(stamp), F.unix_millis(full)).when(
        text.rlike(hms), seconds.cast("bigint") * 1000
    )


def extract_time_text(value: Column) -> Column:
    """First absolute date-time in a text, else the first relative time, else null."""
    text = clean_text(value)
    absolute = F.regexp_extract(text, fv.ABSOLUTE_TIME, 0)
    relative = F.regexp_extract(text, fv.RELATIVE_TIME, 0)
    return F.when(absolute != "", absolute).when(relative != "", relative)


# --- labels ----------------------------------------------------------------------------------


def reply_location(floor: Column, is_nested: Column, source_page: Column) -> Column:
    return (
        F.when(floor.isNotNull() & is_nested, F.concat(F.lit("第 "), floor, F.lit(" 楼的楼中楼")))
        .when(floor.isNotNull(), F.concat(F.lit("第 "), floor, F.lit(" 楼")))
        .when(is_nested, F.concat(F.lit("第 "), source_page, F.lit(" 页楼层号缺失的楼中楼")))
        .otherwise(F.concat(F.lit("第 "), source_page, F.lit(" 页楼层号缺失的回复")))
    )


def reply_label(floor: Column, is_nested: Column, source_page: Column, author: Column) -> Column:
    name = blank_to_null(author)
    who = F.when(name.isNull(), F.lit("用户名不可用")).otherwise(
        F.concat(F.lit("用户“"), name, F.lit("”"))
    )
    return F.concat(reply_location(floor, is_nested, source_page), F.lit("（"), who, F.lit("）"))


def floor_label(floor: Column, is_nested: Column) -> Column:
    known = F.when(floor > 0, floor)
    return (
        F.when(is_nested & known.isNotNull(), F.concat(F.lit("第 "), known, F.lit(" 楼的楼中楼")))
        .when(is_nested, F.lit("楼中楼（父楼未知）"))
        .when(known == 1, F.lit("主楼（1楼）"))
        .when(known.isNotNull(), F.concat(F.lit("第 "), known, F.lit(" 楼")))
        .otherwise(F.lit("主回复（楼层未知）"))
    )


# --- sizes -----------------------------------------------------------------------------------


def estimate_tokens(value: Column) -> Column:
    """Conservative token estimate: ASCII one per three, other characters one, supplementary two."""
    ascii_count = F.length(F.regexp_replace(value, r"[^\x00-\x7F]", ""))
    wide = F.length(F.regexp_replace(value, r"[^\x{10000}-\x{10FFFF}]", ""))
    return (F.length(value) - ascii_count + wide + F.ceil(ascii_count / 3)).cast("bigint")


# --- model text ------------------------------------------------------------------------------


def normalize_mode(value: Column) -> Column:
    return F.when(value == "deep", F.lit("deep")).otherwise(F.lit("fast"))


def enum_key(value: Column) -> Column:
    return F.regexp_replace(F.lower(trim(nfkc(value))), f"[{fv.SPACE}_/-]+", "")


def known_enums(values: Column, aliases: dict[str, list[str]]) -> Column:
    """For an array of model-written enum values, whether each is known; all are normalised in one step."""
    words = F.array(*[F.lit(word) for group in aliases.values() for word in group])
    joined = F.array_join(F.transform(values, lambda v: F.replace(F.coalesce(v, F.lit("")), F.lit("\x01"), F.lit("?"))), "\x01")
    keys = F.split(F.lower(nfkc(joined)), "\x01", -1)
    return F.transform(keys, lambda k: F.array_contains(words, F.regexp_replace(trim(k), f"[{fv.SPACE}_/-]+", "")))


def enum_alias(value: Column, aliases: dict[str, list[str]]) -> Column:
    """Canonical name of a model-written enum value; null when unknown."""
    key = enum_key(value)
    expression = F.lit(None).cast("string")
    for name, words in aliases.items():
        expression = F.when(key.isin(words), F.lit(name)).otherwise(expression)
    return expression


def truncate_safe(value: Column, limit) -> Column:
    """Cut to ``limit`` code points with an ellipsis; a token cut in the middle is removed whole."""
    limit = F.lit(limit)
    text = trim(value)
    prefix = F.substring(text, F.lit(1), limit - 1)
    following = F.substring(text, limit, F.lit(1))
    cut = F.when(
        following.rlike(f"^[{fv.WORDISH}]$") & prefix.rlike(fv.PARTIAL_TOKEN_AT_END),
        F.regexp_replace(
            F.regexp_replace(prefix, fv.PARTIAL_TOKEN_AT_END, ""), rf"[{fv.SPACE}]+\z", ""
        ),
    ).otherwise(prefix)
    return (
        F.when(text == "", F.lit(None).cast("string"))
        .when(F.length(text) <= limit, text)
        .otherwise(F.concat(cut, F.lit("…")))
    )


def first_sentences(value: Column, count: int) -> Column:
    head = F.regexp_extract(value, r"^(?:[^。！？!?]*[。！？!?]){%d}" % count, 0)
    return F.when(head != "", head).otherwise(value)


def sanitize_prose(value: Column, limit: int, max_sentences: int | None = None) -> Column:
    """Neutral words instead of protocol tokens, then a safe cut; null when nothing is left."""
    text = value if max_sentences is None else first_sentences(value, max_sentences)
    return truncate_safe(sanitize_tokens(text), limit)


def sanitize_tokens(value: Column) -> Column:
    """Neutral words instead of protocol tokens."""
    text = F.regexp_replace(value, fv.REPLY_TOKEN, fv.TOKEN_WORDS["reply"])
    text = F.regexp_replace(text, fv.AUTHOR_TOKEN, fv.TOKEN_WORDS["author"])
    return F.regexp_replace(text, fv.RULE_TOKEN, fv.TOKEN_WORDS["rule"])


def segment_narrative(value: Column) -> Column:
    """Display lines of model prose: broken at stage headings, list marks and sentence ends."""
    sp = f"[{fv.SPACE}]"
    text = F.regexp_replace(
        value,
        rf"^{sp}*(第(?:[一二三四五六七八九十百零〇两]+|[0-9]+){sp}*阶段[^：:\n]{{0,240}}[：:]){sp}*",
        "$1\n",
    )
    text = F.regexp_replace(
        text, rf"([、，]){sp}*(?=(?:主楼（1楼）|第{sp}*[0-9]+{sp}*楼|楼中楼（父楼未知）))", "$1\n"
    )
    text = F.regexp_replace(text, rf"([。！？；]){sp}*(?=[^{fv.SPACE}])", "$1\n")
    text = F.regexp_replace(text, rf"([：:]){sp}*(?=[0-9]+[.)、])", "$1\n")
    text = F.regexp_replace(text, rf"{sp}+(?=[0-9]+[.)、])", "\n")
    lines = F.transform(F.split(text, r"\r?\n", -1), trim)
    return F.filter(lines, lambda line: line != "")
