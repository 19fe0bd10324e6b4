"""Model answers: decoding, checks, allow-lists, claims, splitting, demotion and the final findings."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadspark import fixed_values as fv
from threadspark.functions.text import (
    bound, enum_alias, known_enums, parse_confidence, parse_number, repeat_key, reply_excerpt, sanitize_prose, sanitize_tokens, trim, truncate_safe,
)
from threadspark.operators.graph import connected_components
from threadspark.operators.ordinals import dealt, first_per_key
from threadspark.operators.reports import normalize_narrative, resolve_refs
from threadspark.operators.shapes import gathered_issues, shape_issues
from threadspark.session import cut_lineage
from threadspark.shape_library import ANSWER_LEGACY, ANSWER_V3

ITEM = "struct<title:string,summary:string,replyIds:array<string>>"
RESULT = (
    "protocolVersion string, summary string, uncertainties string, findings array<struct<type:string,severity:string,score:string,"
    "summary:string,offendingReplyIds:array<string>,contextReplyIds:array<string>,evidence:array<struct<replyId:string,explanation:string>>,"
    "primaryReasonId:string,confidence:string,rationale:string,uncertainties:string>>, report struct<overview:string,"
    f"stages:array<{ITEM}>,interactions:array<{ITEM}>,notes:array<struct<kind:string,title:string,summary:string,replyIds:array<string>>>,"
    "discussionOverview:string," + ",".join(f"{name}:string" for name in fv.LEGACY_REPORT_LISTS) + ">"
)
CANDIDATE = ["attempt_id", "candidate_no"]
#: Answers a task checks: a few milliseconds each, however few bytes the answers' rows had before.
ANSWERS = 500


def decode_result_json(content: Column) -> Column:
    """The JSON text of an answer: bare, or inside exactly one code fence; null otherwise."""
    text = trim(content)
    fenced = trim(F.regexp_extract(text, r"(?is)^```(?:json)?\s*(.*?)\s*```$", 1))
    return F.when(F.try_parse_json(text).isNotNull(), text).when(
        (fenced != "") & F.try_parse_json(fenced).isNotNull(), fenced
    )


def result_protocol(json_text: Column) -> Column:
    """3 for the current protocol (its number, or any of its report fields), else 2."""
    variant = F.try_parse_json(json_text)
    marks = [F.try_variant_get(variant, f"$.report.{name}", "variant").isNotNull() for name in ["overview", "stages", "interactions", "notes"]]
    flagged = F.coalesce(F.try_variant_get(variant, "$.protocolVersion", "int") == fv.PROTOCOL_VERSION, F.lit(False))
    return F.when(flagged | marks[0] | marks[1] | marks[2] | marks[3], F.lit(3)).otherwise(F.lit(2))


def answer_issues(answers: DataFrame) -> DataFrame:
    """``attempt_id, path, kind`` of ``attempt_id, json_text, protocol``: types, lists and texts against the protocol's shape."""
    parts = [
        shape_issues(answers.filter(F.col("protocol") == protocol), ["attempt_id"], F.try_parse_json("json_text"), shape)
        for protocol, shape in ((3, ANSWER_V3), (2, ANSWER_LEGACY))
    ]
    return parts[0].unionByName(parts[1])


def parse_results(model_results: DataFrame) -> DataFrame:
    """Parses ``attempt_id, thread_id, content, finish_reason``; adds ``doc``, ``protocol``, ``reject_code``
    and all ``issues`` (field path and kind; unknown keys are never echoed)."""
    # the checks cost far more than their bytes tell, so answers are dealt by their number
    model_results = dealt(model_results, ["attempt_id"], ANSWERS)
    # exploded, so that a text is decoded and parsed once and not in every check
    rows = model_results.withColumn("json_text", F.explode(F.array(decode_result_json(F.col("content")))))
    # the walk over the shapes needs the text and its protocol only
    plain = rows.select("attempt_id", "json_text", F.explode(F.array(result_protocol(F.col("json_text")))).alias("protocol"))
    read = F.struct(F.from_json("json_text", RESULT).alias("doc"), result_protocol(F.col("json_text")).alias("protocol"))
    rows = rows.withColumn("_read", F.explode(F.array(read))).withColumns({"doc": F.col("_read.doc"), "protocol": F.col("_read.protocol")}).drop("_read")
    found = F.col("doc.findings")
    rows = rows.withColumns({
        "known_types": known_enums(F.col("doc.findings.type"), fv.TYPE_ALIASES),
        "known_severities": known_enums(F.col("doc.findings.severity"), fv.SEVERITY_ALIASES),
    })

    def issue(test, path, kind):
        return F.when(test, F.concat(path if isinstance(path, Column) else F.lit(path), F.lit("("), F.lit(kind), F.lit(")")))

    def per_finding(f, i):
        at = F.concat(F.lit("findings["), i, F.lit("]."))
        score, sure = parse_number(f["score"]), parse_confidence(f["confidence"])
        return F.array_compact(
            F.array(
                issue(~F.get("known_types", i), F.concat(at, F.lit("type")), "enum"),
                issue(~F.get("known_severities", i), F.concat(at, F.lit("severity")), "enum"),
                issue(~F.coalesce(score.between(0, 100), F.lit(False)), F.concat(at, F.lit("score")), "number"),
                issue(F.coalesce(trim(f["summary"]), F.lit("")) == "", F.concat(at, F.lit("summary")), "missing"),
                issue(~F.coalesce(F.size(f["offendingReplyIds"]).between(1, 100), F.lit(False)), F.concat(at, F.lit("offendingReplyIds")), "length"),
                issue(F.coalesce(f["primaryReasonId"], F.lit("")) == "", F.concat(at, F.lit("primaryReasonId")), "missing"),
                issue(~F.coalesce(sure.between(0, 1), F.lit(False)), F.concat(at, F.lit("confidence")), "number"),
                issue(F.coalesce(trim(f["rationale"]), F.lit("")) == "", F.concat(at, F.lit("rationale")), "missing"),
            )
        )

    top = F.array_compact(
        F.array(
            issue(F.coalesce(trim(F.col("doc.summary")), F.lit("")) == "", "summary", "missing"),
            issue(found.isNull(), "findings", "type"),
            issue(F.size(found) > 300, "findings", "length"),
            issue((F.col("protocol") == 3) & F.col("doc.report.overview").isNull(), "report.overview", "missing"),
        )
    )
    none = F.array().cast("array<string>")
    issues = F.concat(top, F.coalesce(F.flatten(F.transform(found, per_finding)), none))
    shaped = gathered_issues(answer_issues(plain), ["attempt_id"], "shape_issues")
    rows = rows.withColumn("issues", F.coalesce(issues, none)).join(shaped, "attempt_id", "left")
    rows = rows.withColumn("issues", F.array_distinct(F.concat("issues", F.coalesce("shape_issues", none)))).drop("shape_issues")
    reject = (
        F.when(F.col("finish_reason") == "length", "truncated_output")
        .when(F.coalesce(trim(F.col("content")), F.lit("")) == "", "empty_content")
        .when(F.col("json_text").isNull(), "not_json")
        .when(F.size("issues") > 0, "schema")
    )
    return rows.withColumn("reject_code", reject).drop("known_types", "known_severities")


def clean_notes(values_json: Column, most: int, limit: int) -> Column:
    """The first ``most`` texts of a JSON list, cleaned and cut; what is no text, or blank when cleaned, is left out."""
    items = F.try_variant_get(F.try_parse_json(values_json), "$", "array<variant>")
    texts = F.transform(F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))
    cleaned = F.filter(F.transform(texts, lambda text: bound(sanitize_tokens(text), lambda t: truncate_safe(t, limit))), lambda text: text.isNotNull())
    return F.coalesce(F.slice(cleaned, 1, most), F.array().cast("array<string>"))


def candidates(parsed: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per finding of accepted answers, with normalised enums, numbers and prose."""
    rows = parsed.filter(F.col("reject_code").isNull()).select(
        "attempt_id", "thread_id", "protocol", F.posexplode("doc.findings").alias("candidate_no", "f")
    )
    v3 = F.col("protocol") == 3

    def prose(name, limit, legacy):
        return F.when(v3, sanitize_prose(F.col(name), limit)).otherwise(truncate_safe(F.col(name), legacy))

    known = rules.select(F.col("rule_id").alias("reason_id"), F.lit(True).alias("known_rule"))
    rows = rows.select(
        "attempt_id", "thread_id", "protocol", "candidate_no",
        enum_alias(F.col("f.type"), fv.TYPE_ALIASES).alias("risk_type"), enum_alias(F.col("f.severity"), fv.SEVERITY_ALIASES).alias("severity"),
        parse_number(F.col("f.score")).alias("score"), parse_confidence(F.col("f.confidence")).alias("confidence"),
        prose("f.summary", 100, 1500).alias("summary"), prose("f.rationale", 180, 800).alias("rationale"),
        F.col("f.primaryReasonId").alias("reason_id"), F.col("f.offendingReplyIds").alias("offending"),
        F.coalesce("f.contextReplyIds", F.array().cast("array<string>")).alias("context"),
        F.coalesce("f.evidence", F.array().cast("array<struct<replyId:string,explanation:string>>")).alias("evidence"),
        F.when(v3, clean_notes(F.col("f.uncertainties"), 3, 160)).otherwise(normalize_narrative(F.col("f.uncertainties"), 500, 20)).alias("uncertainties"),
    )
    # most candidates may name one rule, so they are not dealt by it
    rows = rows.join(F.broadcast(known), "reason_id", "left").withColumn("known_rule", F.coalesce("known_rule", F.lit(False)))
    return cut_lineage(rows)


def allowlist(listed: DataFrame, wires: DataFrame) -> DataFrame:
    """Keeps exact wire ids of the thread; adds local id, position and component.

    ``wires`` holds ``thread_id, wire_id, id, pos, component, author_alias, content``.
    """
    return listed.join(wires.select("thread_id", "wire_id", "id", "pos", "component"), ["thread_id", "wire_id"])


def offending_rows(cands: DataFrame, wires: DataFrame) -> DataFrame:
    listed = cands.filter("known_rule").select(
        *CANDIDATE, "thread_id", "risk_type", "confidence", "score", F.posexplode(F.array_distinct("offending")).alias("place", "wire_id")
    )
    return allowlist(listed, wires)


def claim_replies(offending: DataFrame) -> DataFrame:
    """Each reply goes to its first accepted candidate by confidence, score and order."""
    order = F.struct(-F.col("confidence"), -F.col("score"), F.col("candidate_no"))
    return first_per_key(offending.filter(F.col("confidence") >= fv.MIN_CONFIDENCE), ["attempt_id", "id"], order)


def split_offending(claimed: DataFrame, wires: DataFrame) -> DataFrame:
    """Adds ``group_no``: replies of a candidate joined by the reply relation or by repeated spam."""
    texts = wires.select("thread_id", "id", "author_alias", F.md5(repeat_key(F.col("content"))).alias("text_key"), (F.trim("content") != "").alias("has_text"))
    rows = cut_lineage(claimed.join(texts, ["thread_id", "id"]))
    by_chain = rows.groupBy(*CANDIDATE, "component").agg(F.min("pos").alias("head"))
    spam = rows.filter((F.col("risk_type") == "spam") & (F.col("author_alias") != "U0") & F.col("has_text"))
    by_text = spam.groupBy(*CANDIDATE, "author_alias", "text_key").agg(F.min("pos").alias("head"))
    edges = rows.join(by_chain, [*CANDIDATE, "component"]).select(*CANDIDATE, F.col("pos").alias("src"), F.col("head").alias("dst"))
    edges = edges.unionByName(
        spam.join(by_text, [*CANDIDATE, "author_alias", "text_key"]).select(*CANDIDATE, F.col("pos").alias("src"), F.col("head").alias("dst"))
    ).filter("src <> dst")
    both = edges.unionByName(edges.select(*CANDIDATE, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    found = connected_components(rows.select(*CANDIDATE, F.col("pos").alias("node")), both, CANDIDATE)
    rows = rows.join(found.select(*CANDIDATE, F.col("node").alias("pos"), F.col("component").alias("group_head")), [*CANDIDATE, "pos"])
    heads = rows.groupBy(*CANDIDATE, "group_head").agg(F.min("place").alias("first_place"))
    # A candidate lists at most a hundred replies, so its groups are numbered in one small window.
    numbered = heads.withColumn("group_no", F.row_number().over(Window.partitionBy(*CANDIDATE).orderBy("first_place")))
    return rows.join(numbered, [*CANDIDATE, "group_head"]).drop("text_key", "has_text", "author_alias", "group_head", "first_place")


def related_context(cands: DataFrame, members: DataFrame, wires: DataFrame) -> DataFrame:
    """Context replies of each group: in the same component and never offending in that candidate."""
    listed = cands.select(*CANDIDATE, "thread_id", F.posexplode(F.array_distinct("context")).alias("place", "wire_id"))
    own = cands.select(*CANDIDATE, F.explode(F.array_distinct("offending")).alias("wire_id"))
    context = allowlist(listed.join(own, [*CANDIDATE, "wire_id"], "left_anti"), wires)
    groups = members.select(*CANDIDATE, "group_no", "component").distinct()
    return context.join(groups, [*CANDIDATE, "component"]).select(*CANDIDATE, "group_no", "id", "place").distinct()


def finding_evidence(cands: DataFrame, members: DataFrame, wires: DataFrame) -> DataFrame:
    """First evidence per offending reply; a group without any gets one fallback on its first reply."""
    listed = cands.select(*CANDIDATE, F.posexplode("evidence").alias("item_no", "e")).select(
        *CANDIDATE, "item_no", F.col("e.replyId").alias("wire_id"), sanitize_prose(F.col("e.explanation"), 160).alias("explanation")
    )
    own = members.select(*CANDIDATE, "thread_id", "group_no", "id", "wire_id", "place", "score")
    given = first_per_key(listed.join(own, [*CANDIDATE, "wire_id"]), [*CANDIDATE, "id"], F.col("item_no"))
    given = given.select(*CANDIDATE, "group_no", "thread_id", "id", "score", F.concat(F.lit("AI："), "explanation").alias("signal"))
    bare = own.join(given.select(*CANDIDATE, "group_no").distinct(), [*CANDIDATE, "group_no"], "left_anti")
    fallback = first_per_key(bare, [*CANDIDATE, "group_no"], F.col("place")).select(
        *CANDIDATE, "group_no", "thread_id", "id", "score", F.lit(fv.FALLBACK_SIGNAL).alias("signal")
    )
    texts = wires.select("thread_id", "id", reply_excerpt(F.col("content")).alias("excerpt"))
    return given.unionByName(fallback).join(texts, ["thread_id", "id"])


def demote_low_confidence(cands: DataFrame, offending: DataFrame, claimed: DataFrame, max_notes: int | None = None) -> DataFrame:
    """Notes for candidates under the confidence gate that still hold a reply nobody claimed; the first ``max_notes`` per answer."""
    open_rows = offending.filter(F.col("confidence") < fv.MIN_CONFIDENCE).join(claimed.select("attempt_id", "id"), ["attempt_id", "id"], "left_anti")
    per = open_rows.groupBy(*CANDIDATE).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda r: r["id"]).alias("reply_ids"))
    first = F.try_element_at("uncertainties", F.lit(1))
    details = F.concat_ws("；", "summary", first)
    rows = cands.join(per, CANDIDATE).withColumn("note", F.coalesce(sanitize_prose(details, 160), F.lit("模型置信度不足，建议人工确认。")))
    order = [F.desc("confidence"), F.desc("score"), F.col("candidate_no")]
    numbered = rows.withColumn("note_no", F.row_number().over(Window.partitionBy("attempt_id").orderBy(*order)))
    kept = numbered if max_notes is None else numbered.filter(F.col("note_no") <= max_notes)
    return kept.select(
        *CANDIDATE, "note_no", F.lit("needs_human_check").alias("kind"), F.lit(fv.LOW_CONFIDENCE_TITLE).alias("title"), F.col("note").alias("summary"), "reply_ids"
    )


def report_notes(
    parsed: DataFrame, wires: DataFrame, max_checks: int | None = None, max_others: int | None = None, max_ids: int | None = None
) -> DataFrame:
    """Notes of version 3 answers with local reply ids; the bounds keep the first of each kind and of a note's ids."""
    v3 = parsed.filter(F.col("reject_code").isNull() & (F.col("protocol") == 3))
    rows = v3.select("attempt_id", "thread_id", F.posexplode("doc.report.notes").alias("item_no", "n")).filter(
        F.col("n.kind").isin("needs_human_check", "heated_but_allowed") & F.col("n.title").isNotNull() & F.col("n.summary").isNotNull() & F.col("n.replyIds").isNotNull()
    )
    rows = rows.withColumn("kind", F.col("n.kind"))
    kept, check = rows, F.col("kind") == "needs_human_check"
    if max_checks is not None or max_others is not None:
        kind_no = F.row_number().over(Window.partitionBy("attempt_id", "kind").orderBy("item_no"))
        bound = F.when(check, F.lit(max_checks)).otherwise(F.lit(max_others))
        kept = rows.withColumn("kind_no", kind_no).filter(bound.isNull() | (F.col("kind_no") <= bound))
    listed = F.array_distinct("n.replyIds")
    listed = listed if max_ids is None else F.slice(listed, 1, max_ids)
    ids = kept.select("attempt_id", "thread_id", "item_no", F.posexplode(listed).alias("place", "wire_id"))
    local = allowlist(ids, wires).groupBy("attempt_id", "item_no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda r: r["id"]).alias("reply_ids")
    )
    return kept.join(local, ["attempt_id", "item_no"], "left").select(
        "attempt_id", "item_no", "kind", sanitize_prose(F.col("n.title"), 32).alias("title"), sanitize_prose(F.col("n.summary"), 160).alias("summary"),
        F.coalesce("reply_ids", F.array().cast("array<string>")).alias("reply_ids"),
    )


def report_overview(parsed: DataFrame) -> DataFrame:
    """``attempt_id, overview`` of version 3 answers."""
    v3 = parsed.filter(F.col("reject_code").isNull() & (F.col("protocol") == 3))
    return v3.select("attempt_id", sanitize_prose(F.col("doc.report.overview"), fv.OVERVIEW_LENGTH).alias("overview"))


def _legacy(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reject_code").isNull() & (F.col("protocol") == 2))


def legacy_report(parsed: DataFrame) -> DataFrame:
    """Report texts of older answers: ``attempt_id, thread_id, section, item_no, text``.

    A report that is a bare text is its overview; one that is neither text nor object has no rows.  Items are texts, or
    objects whose known fields are joined.
    """
    report = F.try_variant_get(F.try_parse_json("json_text"), "$.report", "variant")
    kind = F.schema_of_variant(report)
    rows = _legacy(parsed).select("attempt_id", "thread_id", report.alias("report"), kind.alias("kind"))
    rows = rows.filter((F.col("kind") == "STRING") | F.col("kind").startswith("OBJECT"))

    def json_of(value):
        return F.when(~F.is_variant_null(value), F.to_json(value))

    def part(name):
        return F.try_variant_get("report", f"$.{name}", "variant")

    def one_item(value):
        blank = (F.schema_of_variant(value) == "STRING") & (trim(F.try_variant_get(value, "$", "string")) == "")
        return F.when(~F.coalesce(blank, F.lit(False)), F.concat(F.lit("["), json_of(value), F.lit("]")))

    overview = F.when(F.col("kind") == "STRING", one_item(F.col("report"))).otherwise(one_item(part("discussionOverview")))
    sections = [F.struct(F.lit("discussionOverview").alias("section"), normalize_narrative(overview, fv.LEGACY_OVERVIEW_LENGTH, 1, [], ["overview"]).alias("texts"))]
    for name in fv.LEGACY_REPORT_LISTS:
        texts = normalize_narrative(F.when(F.col("kind") != "STRING", json_of(part(name))), fv.LEGACY_ITEM_LENGTH, fv.LEGACY_ITEMS, fv.NARRATIVE_HEADING_FIELDS)
        sections.append(F.struct(F.lit(name).alias("section"), texts.alias("texts")))
    found = rows.select("attempt_id", "thread_id", F.explode(F.array(*sections)).alias("s"))
    return found.select("attempt_id", "thread_id", "s.section", F.posexplode("s.texts").alias("item_no", "text"))


def legacy_uncertainties(parsed: DataFrame, cands: DataFrame, offending: DataFrame, claimed: DataFrame) -> DataFrame:
    """Uncertainties of older answers: their own, then a prefixed summary and the notes of each candidate under the
    confidence gate; each text once, where it comes first: ``attempt_id, thread_id, note_no, text``."""
    keys = ["attempt_id", "thread_id"]
    own = _legacy(parsed).select(*keys, F.posexplode(normalize_narrative(F.col("doc.uncertainties"), 500, 50)).alias("no", "text"))
    own = own.select(*keys, F.struct(F.lit(0.0).alias("sure"), F.lit(0.0).alias("score"), F.lit(-1).alias("candidate"), "no").alias("place"), "text")
    open_rows = offending.filter(F.col("confidence") < fv.MIN_CONFIDENCE).join(claimed.select("attempt_id", "id"), ["attempt_id", "id"], "left_anti")
    low = cands.filter(F.col("protocol") == 2).join(open_rows.select(*CANDIDATE).distinct(), CANDIDATE, "left_semi")
    notes = F.concat(F.array(F.concat(F.lit(fv.LOW_CONFIDENCE_PREFIX), "summary")), "uncertainties")
    told = low.select(*keys, "confidence", "score", "candidate_no", F.posexplode(notes).alias("no", "text"))
    # the model's own notes come first: their place starts below every other
    place = F.struct((2 - F.col("confidence")).alias("sure"), (-F.col("score")).alias("score"), F.col("candidate_no").alias("candidate"), "no")
    firsts = own.unionByName(told.select(*keys, place.alias("place"), "text")).groupBy(*keys, "text").agg(F.min("place").alias("place"))
    numbered = F.row_number().over(Window.partitionBy("attempt_id").orderBy("place"))  # an answer's notes are bounded by the answer
    return firsts.select(*keys, numbered.alias("note_no"), "text")


def localized_narrative(rows: DataFrame, keys: list[str], labels: DataFrame) -> DataFrame:
    """``rows`` (``keys…, thread_id, text``) with references in ``text`` shown as local labels, and the ``reply_ids`` they name."""
    named = rows.withColumn("text_id", F.concat_ws("/", *keys))
    shown = resolve_refs(named.select("text_id", "thread_id", "text"), labels)
    return named.drop("text").join(shown.withColumnRenamed("shown", "text"), ["text_id", "thread_id"]).drop("text_id")


def report_items(parsed: DataFrame, wires: DataFrame, max_items: dict[str, int] | None = None, max_ids: int | None = None) -> DataFrame:
    """Stages and interactions of version 3 answers: ``attempt_id, section, item_no, title, summary, reply_ids``.

    Items without title, summary or list of ids are left out.  ``max_items`` keeps the first of a section.
    """
    v3 = parsed.filter(F.col("reject_code").isNull() & (F.col("protocol") == 3))
    sections = F.array(*[F.struct(F.lit(s).alias("section"), F.col(f"doc.report.{s}").alias("items")) for s in ("stages", "interactions")])
    rows = v3.select("attempt_id", "thread_id", F.explode(sections).alias("s")).select("attempt_id", "thread_id", "s.section", F.posexplode("s.items").alias("item_no", "n"))
    rows = rows.filter(F.col("n.title").isNotNull() & F.col("n.summary").isNotNull() & F.col("n.replyIds").isNotNull())
    if max_items is not None:
        bound = F.lit(None).cast("int")
        for section, count in max_items.items():
            bound = F.when(F.col("section") == section, F.lit(count)).otherwise(bound)
        place = F.row_number().over(Window.partitionBy("attempt_id", "section").orderBy("item_no"))
        rows = rows.withColumn("_place", place).filter(bound.isNull() | (F.col("_place") <= bound)).drop("_place")
    listed = F.array_distinct("n.replyIds") if max_ids is None else F.array_distinct(F.slice("n.replyIds", 1, max_ids))
    keys = ["attempt_id", "section", "item_no"]
    local = allowlist(rows.select(*keys, "thread_id", F.posexplode(listed).alias("place", "wire_id")), wires).groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda r: r["id"]).alias("reply_ids")
    )
    return rows.join(local, keys, "left").select(
        *keys, sanitize_prose(F.col("n.title"), 32).alias("title"), sanitize_prose(F.col("n.summary"), 160).alias("summary"),
        F.coalesce("reply_ids", F.array().cast("array<string>")).alias("reply_ids"),
    )


def merged_notes(reported: DataFrame, demoted: DataFrame, max_checks: int | None = None) -> DataFrame:
    """The model's own notes, then those of demoted candidates, in one numbering per answer.

    With ``max_checks`` demoted notes only fill up the human checks to that number; the model's own stay.
    """
    own = reported.select("attempt_id", F.struct(F.lit(0).alias("source"), F.col("item_no").alias("no")).alias("place"), "kind", "title", "summary", "reply_ids")
    added = demoted.select("attempt_id", F.struct(F.lit(1).alias("source"), F.col("note_no").alias("no")).alias("place"), "kind", "title", "summary", "reply_ids")
    rows = own.unionByName(added)
    if max_checks is not None:
        check = F.col("kind") == "needs_human_check"
        checks = F.count_if(check).over(Window.partitionBy("attempt_id").orderBy("place"))
        rows = rows.withColumn("_checks", checks).filter((F.col("place.source") == 0) | (F.col("_checks") <= max_checks)).drop("_checks")
    return rows.withColumn("note_no", F.row_number().over(Window.partitionBy("attempt_id").orderBy("place"))).drop("place")


def projected_uncertainties(notes: DataFrame) -> DataFrame:
    """Human checks as uncertainties of the whole answer: ``attempt_id, note_no, text, reply_ids``."""
    return notes.filter(F.col("kind") == "needs_human_check").select("attempt_id", "note_no", F.col("summary").alias("text"), "reply_ids")


def thread_findings(cands: DataFrame, members: DataFrame, context: DataFrame) -> DataFrame:
    """Final findings: one per group, with rewritten texts when a candidate was split."""
    groups = members.groupBy(*CANDIDATE, "thread_id", "group_no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda r: r["id"]).alias("reply_ids")
    )
    sizes = groups.groupBy(*CANDIDATE).agg(F.count("*").alias("group_count"))
    around = context.groupBy(*CANDIDATE, "group_no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda r: r["id"]).alias("context_reply_ids")
    )
    split = F.col("group_count") > 1
    rows = groups.join(sizes, CANDIDATE).join(around, [*CANDIDATE, "group_no"], "left").join(cands.drop("thread_id"), CANDIDATE)
    return rows.select(
        *CANDIDATE, "thread_id", "group_no",
        F.concat_ws("-", F.lit("AI"), F.col("candidate_no") + 1, "group_no", "risk_type", F.element_at("reply_ids", 1)).alias("finding_id"),
        "risk_type", "severity", "score", "confidence", "reason_id",
        F.when(split, F.lit(fv.SPLIT_SUMMARY)).otherwise(F.col("summary")).alias("summary"),
        F.when(split, F.lit(fv.SPLIT_RATIONALE)).otherwise(F.col("rationale")).alias("rationale"),
        "reply_ids", F.coalesce("context_reply_ids", F.array().cast("array<string>")).alias("context_reply_ids"),
        F.when(split, F.concat("uncertainties", F.array(F.lit(fv.SPLIT_NOTE)))).otherwise(F.col("uncertainties")).alias("uncertainties"),
    )


def structure_changed(cands: DataFrame, offending: DataFrame, members: DataFrame, context: DataFrame, wires: DataFrame) -> DataFrame:
    """``attempt_id, changed, kept``: anything dropped, split, demoted or cut from an answer."""
    kept = members.groupBy(*CANDIDATE).agg(F.count_distinct("id").alias("kept"), F.max("group_no").alias("groups"))
    listed = cands.select(*CANDIDATE, "thread_id", F.explode(F.array_distinct("context")).alias("wire_id"))
    own = cands.select(*CANDIDATE, F.explode(F.array_distinct("offending")).alias("wire_id"))
    valid = allowlist(listed.join(own, [*CANDIDATE, "wire_id"], "left_anti"), wires).groupBy(*CANDIDATE).agg(F.count("*").alias("valid_context"))
    used = context.groupBy(*CANDIDATE, "group_no").agg(F.count("*").alias("n")).groupBy(*CANDIDATE).agg(F.min("n").alias("least_context"), F.count("*").alias("groups_with"))
    seen = members.select(*CANDIDATE, "group_no", "wire_id").join(
        cands.select(*CANDIDATE, F.explode("evidence.replyId").alias("wire_id")).distinct(), [*CANDIDATE, "wire_id"]
    ).groupBy(*CANDIDATE, "group_no").agg(F.count("*").alias("e")).groupBy(*CANDIDATE).agg(F.min("e").alias("least_evidence"))
    rows = cands.join(kept, CANDIDATE, "left").join(valid, CANDIDATE, "left").join(used, CANDIDATE, "left").join(seen, CANDIDATE, "left")
    changed = (
        F.col("kept").isNull() | (F.col("kept") != F.size(F.array_distinct("offending"))) | (F.col("groups") > 1)
        | (F.coalesce("valid_context", F.lit(0)) != F.coalesce("least_context", F.lit(0)))
        | (F.coalesce("least_evidence", F.lit(0)) != F.size("evidence"))
    )
    return rows.groupBy("attempt_id").agg(F.bool_or(changed).alias("changed"), F.sum(F.coalesce("groups", F.lit(0))).alias("kept"))


def override_summary(parsed: DataFrame, changes: DataFrame) -> DataFrame:
    """``attempt_id, summary``: the model's own, or the final count when its structure changed."""
    head, tail = fv.KEPT_SUMMARY.split("%d")
    rows = parsed.filter(F.col("reject_code").isNull()).join(changes, "attempt_id", "left")
    own = F.when(F.col("protocol") == 3, sanitize_prose(F.col("doc.summary"), 180, 2)).otherwise(truncate_safe(F.col("doc.summary"), 3000))
    return rows.select(
        "attempt_id",
        F.when(~F.coalesce("changed", F.lit(False)), own)
        .when(F.col("kept") > 0, F.concat(F.lit(head), "kept", F.lit(tail)))
        .otherwise(F.lit(fv.NOTHING_KEPT_SUMMARY)).alias("summary"),
    )


def prose_references(
    parsed: DataFrame, cands: DataFrame, offending: DataFrame, members: DataFrame, summaries: DataFrame, labels: DataFrame, wires: DataFrame
) -> DataFrame:
    """``attempt_id, reply_ids``: replies that a result names in its prose.

    That is the final summary of any answer (``summaries`` of ``override_summary``), and of older answers the report, the
    uncertainties and the findings.  Prose of a finding cites only the components of its group; that of a split one is not the model's.
    """
    keys, told = ["attempt_id", "thread_id"], ["part", "no", "text"]
    notes = legacy_uncertainties(parsed, cands, offending, members)
    whole = [
        summaries.join(parsed.select(*keys), "attempt_id").select(*keys, F.lit("summary").alias("part"), F.lit(0).alias("no"), F.col("summary").alias("text")),
        legacy_report(parsed).toDF(*keys, *told), notes.select(*keys, F.lit("uncertainties").alias("part"), F.col("note_no").alias("no"), "text"),
    ]
    old = cands.filter(F.col("protocol") == 2)
    groups = members.select(*CANDIDATE, "group_no", "component").distinct()
    unsplit = groups.groupBy(*CANDIDATE).agg(F.max("group_no").alias("groups")).filter("groups = 1")
    own = old.join(unsplit, CANDIDATE, "left_semi").select(*keys, "candidate_no", F.lit("own").alias("part"), F.posexplode(F.array("summary", "rationale")).alias("no", "text"))
    doubts = old.select(*keys, "candidate_no", F.lit("doubts").alias("part"), F.posexplode("uncertainties").alias("no", "text"))
    items = old.select(*CANDIDATE, F.posexplode("evidence").alias("no", "e")).select(*CANDIDATE, "no", F.col("e.replyId").alias("wire_id"), F.col("e.explanation").alias("text"))
    items = items.join(members.select(*CANDIDATE, "thread_id", "group_no", "wire_id"), [*CANDIDATE, "wire_id"])
    firsts = first_per_key(items, [*CANDIDATE, "wire_id"], F.col("no")).select(*keys, "candidate_no", "group_no", F.lit("evidence").alias("part"), "no", "text")
    # a text of the whole answer has no candidate, and one of all groups of a candidate no group
    texts = reduce(lambda one, other: one.unionByName(other, allowMissingColumns=True), [firsts, own, doubts, *whole])
    texts = cut_lineage(texts.fillna(-1, ["candidate_no", "group_no"]).filter(F.col("text").isNotNull()))
    shown = localized_narrative(texts, [*CANDIDATE, "group_no", "part", "no"], labels)
    cited = shown.select(*keys, "candidate_no", F.col("group_no").alias("only"), F.explode("reply_ids").alias("id")).distinct()
    placed = cited.join(wires.select("thread_id", "id", "component"), ["thread_id", "id"]).join(groups, [*CANDIDATE, "component"], "left")
    inside = placed.filter((F.col("candidate_no") < 0) | (F.col("group_no").isNotNull() & ((F.col("only") < 0) | (F.col("only") == F.col("group_no")))))
    return inside.select("attempt_id", F.array("id").alias("reply_ids"))


def reply_refs(answers: DataFrame, findings: DataFrame, evidence: DataFrame, cited: list[DataFrame], replies: DataFrame) -> DataFrame:
    """Replies cited anywhere in a result, reduced to their location: ``attempt_id, thread_id, id, floor …``.

    ``answers`` holds ``attempt_id, thread_id``; ``cited`` are the result's other parts with ``attempt_id, reply_ids``: notes,
    stages and interactions, prose.  Answers without findings cite replies, too.
    """
    found = findings.select("attempt_id", "thread_id", F.explode(F.concat("reply_ids", "context_reply_ids")).alias("id"))
    named = reduce(DataFrame.unionByName, [part.select("attempt_id", F.explode("reply_ids").alias("id")) for part in cited])
    named = named.join(answers.select("attempt_id", "thread_id"), "attempt_id").select("attempt_id", "thread_id", "id")
    places = replies.select("thread_id", "id", "floor", "parent_reply_id", "is_nested", "source_page")
    every = found.unionByName(evidence.select("attempt_id", "thread_id", "id")).unionByName(named)
    return every.distinct().join(places, ["thread_id", "id"])


def hydrate_evidence(evidence: DataFrame, replies: DataFrame) -> DataFrame:
    """Evidence with author and time of the live snapshot; kept when the reply is gone."""
    live = replies.select("thread_id", "id", "author_name", "timestamp_ms", "floor", "is_nested", "source_page")
    return evidence.join(live, ["thread_id", "id"], "left")


def group_references(refs: DataFrame) -> DataFrame:
    """Cited replies grouped for display: nested ones by parent and author, others alone."""
    nested = F.col("is_nested") & F.col("parent_reply_id").isNotNull()
    key = F.when(nested, F.concat_ws("|", "parent_reply_id", F.coalesce("author_name", F.lit("用户未知")))).otherwise(F.col("id"))
    return refs.withColumn("group_key", key)


def sanitize_columns(rows: DataFrame, keys: list[str], columns: list[str], names: DataFrame) -> DataFrame:
    """Author names hidden in text columns and in columns of text lists; nulls and empty lists stay what they are.

    ``keys`` with ``thread_id`` tell the rows apart.  Every text is a row of its own, keyed by its column and place.
    """
    from threadspark.operators.payloads import MARK, mark_names

    lists = [name for name in columns if rows.schema[name].dataType.typeName() == "array"]
    kept = [name for name in keys if name != "thread_id"]
    tagged = rows.withColumn("_row", F.sha2(F.to_json(F.struct("thread_id", *kept)), 256))

    def part_of(name):
        texts = F.col(name) if name in lists else F.array(name)
        return F.transform(texts, lambda text, i: F.struct(F.lit(name).alias("part"), i.alias("place"), text.alias("text")))

    parts = [part_of(name) for name in columns]
    gone = F.array().cast("array<struct<part:string,place:int,text:string>>")
    texts = tagged.select("thread_id", "_row", F.explode(F.concat(*[F.coalesce(part, gone) for part in parts])).alias("one")).filter(F.col("one.text").isNotNull())
    marked = mark_names(
        texts.select("thread_id", F.concat_ws("/", "_row", "one.part", "one.place").alias("id"), "_row", "one.part", "one.place", F.replace("one.text", F.lit(MARK), F.lit("")).alias("text")),
        names.select("thread_id", "name", F.lit(fv.HIDDEN_NAME).alias("alias")),
    )
    clean = marked.select("_row", "part", "place", F.replace("marked", F.lit(MARK), F.lit(fv.HIDDEN_NAME)).alias("text"))
    # the texts of one row, bounded by that row
    gathered = clean.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("/", "part", "place").alias("key"), "text"))).alias("_texts"))
    back = tagged.join(gathered, "_row", "left")

    def fixed(name):
        if name in lists:
            return F.transform(name, lambda text, i: F.element_at("_texts", F.concat(F.lit(f"{name}/"), i)))
        return F.element_at("_texts", F.lit(f"{name}/0"))

    return back.withColumns({name: fixed(name) for name in columns}).select(*rows.columns)


def sanitize_result(findings: DataFrame, names: DataFrame) -> DataFrame:
    """Findings for storage: author names hidden in summary, rationale and every uncertainty; participants left out.

    A missing list of uncertainties is an empty one; other nulls stay.
    """
    listed = findings.withColumn("uncertainties", F.coalesce("uncertainties", F.array().cast("array<string>")))
    return sanitize_columns(listed, ["attempt_id", "finding_id"], ["summary", "rationale", "uncertainties"], names)


def sanitize_evidence(evidence: DataFrame, names: DataFrame) -> DataFrame:
    """Evidence for storage: no excerpt of the source, author names hidden in the signal."""
    keys = [*CANDIDATE, "group_no", "id"]
    return sanitize_columns(evidence.withColumn("excerpt", F.lit("")), keys, ["signal"], names)


def sanitize_report(items: DataFrame, keys: list[str], columns: list[str], names: DataFrame) -> DataFrame:
    """Report rows for storage (stages, interactions, notes, overviews, older lists): author names hidden in their prose."""
    return sanitize_columns(items, keys, columns, names)
