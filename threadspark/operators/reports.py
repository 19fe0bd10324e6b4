"""Showing results: references inside prose, author labels, older prose formats, overviews and history rows."""

from pyspark.sql import Column, DataFrame, functions as F

from threadspark import fixed_values as fv
from threadspark.functions.text import bound, nfkc, reply_label, reply_location, squeeze, trim, truncate_safe
from threadspark.functions.urls import canonical_thread_url, thread_id_from_url
from threadspark.operators.ordinals import top_per_group
from threadspark.operators.shapes import gathered_issues, shape_issues
from threadspark.shape_library import FINDING_ANSWER

ANY_REFERENCE = f"{fv.FLOOR_REFERENCE}|{fv.REPLY_TOKEN}|{fv.AUTHOR_TOKEN}"


def author_occurrences(replies: DataFrame) -> DataFrame:
    """``thread_id, alias, label``: each alias with its name and its first two distinct places.

    ``replies`` holds ``thread_id, pos, author_alias, author_name, floor, is_nested, source_page``.
    """
    place = reply_location(F.col("floor"), F.col("is_nested"), F.col("source_page"))
    rows = replies.select("thread_id", F.col("author_alias").alias("alias"), F.nullif(trim(F.coalesce("author_name", F.lit(""))), F.lit("")).alias("name"), place.alias("place"), "pos")
    names = rows.groupBy("thread_id", "alias").agg(F.min("name").alias("one"), F.max("name").alias("other"))
    firsts = rows.groupBy("thread_id", "alias", "place").agg(F.min("pos").alias("pos"))
    two = top_per_group(firsts, ["thread_id", "alias"], [F.col("pos")], 2, "n").groupBy("thread_id", "alias").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "place"))), lambda p: p["place"]), "、").alias("places")
    )
    seen = F.concat(F.lit("（出现于"), "places", F.lit("）"))
    label = (
        F.when(F.col("one") != F.col("other"), F.lit("无法定位的用户"))
        .when(F.col("one").isNull(), F.concat(F.lit("用户名不可用的用户"), seen))
        .otherwise(F.concat(F.lit("用户“"), "one", F.lit("”"), seen))
    )
    return names.join(two, ["thread_id", "alias"]).select("thread_id", "alias", label.alias("label"))


def reference_labels(replies: DataFrame, authors: DataFrame | None = None) -> DataFrame:
    """``thread_id, key, label, id, component`` for reply, author and unique-floor references.

    ``replies`` also holds ``wire_id`` and ``component``.  Without ``authors`` there are no labels of authors, which cite no reply.
    """
    label = reply_label(F.col("floor"), F.col("is_nested"), F.col("source_page"), F.col("author_name"))
    rows = replies.select("thread_id", "wire_id", "id", "component", "floor", "is_nested", label.alias("label"))
    by_reply = rows.select("thread_id", F.col("wire_id").alias("key"), "label", "id", "component")
    floors = rows.filter(~F.col("is_nested") & F.col("floor").isNotNull()).groupBy("thread_id", "floor").agg(
        F.count("*").alias("n"), F.min("label").alias("label"), F.min("id").alias("id"), F.min("component").alias("component")
    )
    by_floor = floors.filter("n = 1").select("thread_id", F.concat(F.lit("F"), "floor").alias("key"), "label", "id", "component")
    if authors is None:
        return by_reply.unionByName(by_floor)
    nothing = F.lit(None).cast("string").alias("id")
    by_author = authors.select("thread_id", F.col("alias").alias("key"), "label", nothing, F.lit(None).cast("bigint").alias("component"))
    return by_reply.unionByName(by_floor).unionByName(by_author)


def resolve_refs(texts: DataFrame, labels: DataFrame, author_components: DataFrame | None = None) -> DataFrame:
    """Adds ``shown`` and ``reply_ids`` to ``text_id, thread_id, text[, allowed]``.

    References become local labels; unknown ones are told to be unlocatable; ones outside the allowed
    component are told to be removed.  ``author_components`` holds ``thread_id, alias, component``.
    """
    scoped = texts if "allowed" in texts.columns else texts.withColumn("allowed", F.lit(None).cast("bigint"))
    pieces = F.split("text", ANY_REFERENCE, -1)
    tokens = F.regexp_extract_all("text", F.lit(ANY_REFERENCE), F.lit(0))
    rows = scoped.withColumns({"pieces": pieces, "tokens": tokens})
    found = rows.select("text_id", "thread_id", "allowed", F.posexplode("tokens").alias("n", "token"))
    plain = F.regexp_replace(F.upper(nfkc(F.col("token"))), r"[\t\p{Zs}]+", "")
    digits = F.regexp_extract(plain, "([0-9]+)", 1)
    kind = F.when(plain.endswith("楼"), "F").otherwise(F.substring(plain, 1, 1))
    found = found.withColumn("kind", kind).withColumn("key", F.concat(kind, digits))
    hits = found.join(labels, ["thread_id", "key"], "left")
    outside = F.col("allowed").isNotNull() & (F.col("component") != F.col("allowed"))
    if author_components is not None:
        inside = author_components.select("thread_id", F.col("alias").alias("key"), F.col("component").alias("allowed"), F.lit(True).alias("present")).distinct()
        hits = hits.join(inside, ["thread_id", "key", "allowed"], "left")
        stranger = (F.col("kind") == "U") & F.col("allowed").isNotNull() & F.col("present").isNull()
    else:
        stranger = F.lit(False)
    shown = (
        F.when(stranger, "已移除的无关用户引用")
        .when((F.col("kind") == "P") & F.col("allowed").isNotNull() & (outside | F.col("component").isNull()), "已移除的无关引用")
        .when(outside, "已移除的无关引用")
        .when(F.col("label").isNotNull(), F.col("label"))
        .when(F.col("kind") == "F", "无法定位的楼层")
        .when(F.col("kind") == "P", "无法定位的回复")
        .otherwise("无法定位的用户")
    )
    usable = F.when(F.col("label").isNotNull() & ~F.coalesce(outside, F.lit(False)), F.col("id"))
    # One text's references, bounded by the text.
    gathered = hits.groupBy("text_id", "thread_id").agg(F.array_sort(F.collect_list(F.struct("n", shown.alias("shown"), usable.alias("id")))).alias("found"))
    filled = rows.join(gathered, ["text_id", "thread_id"], "left")
    words = F.transform(F.col("found"), lambda f: f["shown"])
    rebuilt = F.array_join(F.zip_with("pieces", F.coalesce(words, F.array().cast("array<string>")), lambda p, w: F.concat(p, F.coalesce(w, F.lit("")))), "")
    ids = F.array_distinct(F.array_compact(F.transform("found", lambda f: f["id"])))
    return filled.select("text_id", "thread_id", rebuilt.alias("shown"), F.coalesce(ids, F.array().cast("array<string>")).alias("reply_ids"))


def normalize_narrative(
    values_json: Column, limit: int, max_items: int, headings: list[str] | None = None, first_fields: list[str] | None = None
) -> Column:
    """Prose list of older answers: strings, or objects of which only listed fields are used (``first_fields`` before the common ones).

    Items that do not fit are counted, and the count is told in the last slot.
    """
    names, none = {"head": headings or [], "body": [*(first_fields or []), *fv.NARRATIVE_TEXT_FIELDS]}, F.array().cast("array<string>")
    singles, lists = ([name for name, many in fv.NARRATIVE_REF_FIELDS if many == wanted] for wanted in (False, True))

    def values(fields, wanted):
        found = F.transform(F.array(*map(F.lit, wanted)), lambda name: F.try_element_at(fields, name))
        return F.filter(found, lambda v: v.isNotNull() & ~F.is_variant_null(v)) if wanted else F.array().cast("array<variant>")

    def is_text(v):
        return F.schema_of_variant(v) == "STRING"

    def as_text(v):
        return F.try_variant_get(v, "$", "string")

    def texts(found):
        return F.array_distinct(F.filter(F.transform(found, lambda v: trim(as_text(v))), lambda text: text != ""))

    def referenced(found):
        many = F.transform(found, lambda v: F.when(is_text(v), F.array(as_text(v))).otherwise(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda r: F.when(is_text(r), as_text(r)).otherwise("?"))))
        return F.array_distinct(F.flatten(many))

    def as_object(fields):
        parts = F.struct(
            values(fields, names["head"]).alias("head"), values(fields, names["body"]).alias("body"),
            values(fields, singles).alias("single"), values(fields, lists).alias("many"),
        )

        def told(part):
            wrong = F.exists(F.concat(part["head"], part["body"], part["single"]), lambda v: ~is_text(v))
            wrong |= F.exists(part["many"], lambda v: ~F.coalesce(F.size(F.try_variant_get(v, "$", "array<variant>")).between(0, 50), F.lit(False)))
            prose = F.struct(
                F.array_join(texts(part["head"]), " / ").alias("head"), F.array_join(texts(part["body"]), "；").alias("body"),
                referenced(F.concat(part["single"], part["many"])).alias("refs"),
            )
            return F.when(~wrong, bound(prose, cited))

        def cited(p):
            text = F.when((p["head"] != "") & (p["body"] != ""), F.concat_ws("：", p["head"], p["body"])).otherwise(F.concat(p["head"], p["body"]))
            sound = (F.concat(p["head"], p["body"]) != "") & ~F.exists(p["refs"], lambda r: ~r.rlike("^[PU][0-9]{1,9}$"))
            return F.when(sound, F.when(F.size(p["refs"]) > 0, F.concat(F.lit("相关对象："), F.array_join(p["refs"], "、"), F.lit("；"), text)).otherwise(text))

        return bound(parts, told)

    def normal(item):
        text = F.when(is_text(item), as_text(item)).when(
            F.schema_of_variant(item).startswith("OBJECT"), bound(F.try_variant_get(item, "$", "map<string,variant>"), as_object)
        )
        return bound(text, lambda one: truncate_safe(one, limit))

    def numbered(state):
        total, accepted = state["total"], state["accepted"]
        kept = F.when(total > F.least(F.size(accepted), F.lit(max_items)), F.slice(accepted, 1, max_items - 1)).otherwise(accepted)
        lost = bound(kept, lambda k: F.when(total > F.size(k), F.concat(k, F.array(F.concat(F.lit("有"), total - F.size(k), F.lit("条格式异常说明已忽略。"))))).otherwise(k))
        return F.when(total.isNull(), F.array(F.lit("有1条格式异常说明已忽略。"))).otherwise(lost)

    def whole(json):
        state = bound(items_of(json), lambda found: F.struct(F.when(found.isNotNull(), F.size(found)).alias("total"), F.array_compact(F.transform(found, normal)).alias("accepted")))
        return F.when(json.isNull() | (trim(json) == "null"), none).otherwise(bound(state, numbered))

    def items_of(json):  # a JSON text and a JSON number look alike once they are strings, so items stay variants
        return F.try_variant_get(F.try_parse_json(json), "$", "array<variant>")

    return bound(values_json, whole)


def parse_finding_results(answers: DataFrame, selected: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(answers with ``reject_code`` and ``issues``, kept reply ids, kept reasons, kept evidence) of one-finding answers.

    The shape is strict: other keys, other types and longer lists or texts than asked for reject an answer.
    ``selected`` holds ``selection_id, id`` and ``allowed`` holds ``selection_id, reason_id``; ids and evidence of other replies
    and other reasons are left out.
    """
    schema = (
        "summary string, type string, score double, replyIds array<string>, evidence array<struct<replyId:string,explanation:string>>,"
        "reasonCandidates array<struct<reasonId:string,confidence:double,rationale:string>>, uncertainties array<string>"
    )
    value = F.try_parse_json("content")
    issues = gathered_issues(shape_issues(answers, ["selection_id"], value, FINDING_ANSWER), ["selection_id"])
    rows = answers.withColumn("doc", F.from_json("content", schema)).join(issues, "selection_id", "left")
    code = F.when(value.isNull(), "not_json").when(F.col("issues").isNotNull(), "schema")
    rows = rows.withColumn("reject_code", code).withColumn("issues", F.coalesce("issues", F.array().cast("array<string>")))
    good = rows.filter(F.col("reject_code").isNull())
    ids = good.select("selection_id", F.explode(F.array_distinct("doc.replyIds")).alias("id")).join(selected, ["selection_id", "id"], "left_semi")
    reasons = good.select("selection_id", F.posexplode("doc.reasonCandidates").alias("reason_no", "r")).select(
        "selection_id", "reason_no", F.col("r.reasonId").alias("reason_id"), F.col("r.confidence").alias("confidence"), trim(F.col("r.rationale")).alias("rationale")
    )
    evidence = good.select("selection_id", F.posexplode("doc.evidence").alias("evidence_no", "e")).select(
        "selection_id", "evidence_no", F.col("e.replyId").alias("id"), trim(F.col("e.explanation")).alias("explanation")
    )
    kept = reasons.join(allowed, ["selection_id", "reason_id"], "left_semi"), evidence.join(selected, ["selection_id", "id"], "left_semi")
    return rows, ids, *kept


def pending_human_checks(parsed: DataFrame) -> DataFrame:
    """``attempt_id, pending``: human-check notes of version 3, else the number of uncertainties."""
    checks = F.size(F.filter(F.coalesce("doc.report.notes", F.array().cast("array<struct<kind:string,title:string,summary:string,replyIds:array<string>>>")), lambda n: n["kind"] == "needs_human_check"))
    older = F.coalesce(F.size(F.from_json("doc.uncertainties", "array<string>")), F.lit(0))
    return parsed.select("attempt_id", F.when(F.col("protocol") == 3, checks).otherwise(older).alias("pending"))


def review_overview(parsed: DataFrame, findings: DataFrame, replies: DataFrame) -> DataFrame:
    """Per attempt: findings, pending checks, readable replies, image gap and the leading finding."""
    counts = findings.groupBy("attempt_id").agg(
        F.count("*").alias("finding_count"),
        F.min_by(F.struct("risk_type", "severity"), F.struct(-F.col("confidence"), -F.col("score"), F.col("candidate_no"), F.col("group_no"))).alias("lead"),
    )
    sizes = replies.groupBy("thread_id").agg(F.count("*").alias("reply_count"), F.sum("image_count").alias("image_gap"))
    return (
        parsed.select("attempt_id", "thread_id").join(pending_human_checks(parsed), "attempt_id").join(counts, "attempt_id", "left").join(sizes, "thread_id", "left")
        .select("attempt_id", F.coalesce("finding_count", F.lit(0)).alias("finding_count"), "pending", "reply_count", "image_gap", F.col("lead.risk_type").alias("lead_type"), F.col("lead.severity").alias("lead_severity"))
    )


def history_for_thread(history: DataFrame, threads: DataFrame, host: str) -> DataFrame:
    """History rows whose id and canonical address both match a thread (``thread_id, thread_url``)."""
    known = threads.filter(thread_id_from_url(F.col("thread_url"), host) == F.col("thread_id")).select(
        "thread_id", canonical_thread_url(F.col("thread_url"), host).alias("thread_url")
    )
    return history.join(known.distinct(), ["thread_id", "thread_url"], "left_semi")


def create_history(attempts: DataFrame, host: str) -> DataFrame:
    """Normalised history rows; an address that does not match the thread is refused (null ``thread_url``)."""
    url_thread = thread_id_from_url(F.col("thread_url"), host)
    ok = url_thread.isNotNull() & F.coalesce(F.col("thread_id") == url_thread, F.lit(True))
    title = F.substring(squeeze(F.coalesce("thread_title", F.lit(""))), 1, 300)
    return attempts.withColumns(
        {
            "thread_title": F.when(title == "", F.concat(F.lit("帖子 "), url_thread)).otherwise(title),
            "thread_url": F.when(ok, canonical_thread_url(F.col("thread_url"), host)),
            "thread_id": F.when(ok, url_thread),
        }
    )
