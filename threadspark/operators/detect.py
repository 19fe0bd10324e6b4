"""Lexical and conversational risk scoring of replies into findings."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadspark import fixed_values as fv
from threadspark.functions.text import blank_to_null, dedupe_key, excerpt, parse_forum_time
from threadspark.operators.ordinals import top_per_group
from threadspark.operators.relations import resolve_targets
from threadspark.operators.skew import heavy_keys, skew_join
from threadspark.session import cut_lineage

UNKNOWN_AUTHOR = "[未知用户:"
# Fixed value: MD5 of the empty text, the key of replies without letters or digits.
EMPTY_TEXT_KEY = "d41d8cd98f00b204e9800998ecf8427e"


def author_key(author: Column, reply_id: Column) -> Column:
    return F.coalesce(blank_to_null(author), F.concat(F.lit(UNKNOWN_AUTHOR), reply_id, F.lit("]")))


def lexical_scores(replies: DataFrame, lexicon=None) -> DataFrame:
    """One row per reply: ``score_<type>`` and ``labels_<type>`` from the lexicon, in one pass.

    The lexicon is an argument of fixed size, so its patterns become expressions, not a join.
    """
    lexicon = fv.LEXICON if lexicon is None else lexicon
    explicit = F.col("parent_reply_id").isNotNull() | F.col("content").rlike(fv.EXPLICIT_TARGET)
    columns = {}
    # Every pattern runs once per text; scores and labels read its answer.
    replies = replies.withColumn("_hits", F.array(*[F.col("content").rlike("(?iu)" + p) for _, p, _, _ in lexicon], explicit))
    explicit = F.get("_hits", F.lit(len(lexicon)))
    for risk in dict.fromkeys(kind for kind, *_ in lexicon):
        hits = [(F.get("_hits", F.lit(k)), label, score) for k, (kind, _, label, score) in enumerate(lexicon) if kind == risk]
        total = sum((F.when(hit, F.lit(score)).otherwise(F.lit(0)) for hit, _, score in hits), F.lit(0))
        bonus = F.when((total > 0) & explicit, F.lit(fv.EXPLICIT_TARGET_BONUS)).otherwise(F.lit(0))
        labels = [F.when(hit, F.lit(label)) for hit, label, _ in hits]
        labels.append(F.when((total > 0) & explicit, F.lit(fv.EXPLICIT_TARGET_LABEL)))
        columns[f"score_{risk}"] = F.least(F.lit(100), total + bonus)
        columns[f"labels_{risk}"] = F.array_distinct(F.array_compact(F.array(*labels)))
    return replies.withColumns(columns).drop("_hits")


def duplicate_counts(posts: DataFrame) -> DataFrame:
    """``thread_id, author_key, text_key, n`` of texts one author posted three times or more."""
    return (
        posts.filter(F.col("text_key") != EMPTY_TEXT_KEY)
        .groupBy("thread_id", "author_key", "text_key")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= fv.DUPLICATE_MIN)
    )


def earliest_burst(
    events: DataFrame, group: list[str], width_ms: int, min_count: int, min_risk: int = 0
) -> DataFrame:
    """Per group the earliest start whose forward window qualifies: ``group…, start_ms, n``.

    ``events`` holds ``group…, timestamp_ms, risk``.  Rows are first reduced to one per millisecond and
    group, then cut into slices as wide as the window; each slice also gets the next one's rows.
    A slice therefore never holds more than two windows' worth of milliseconds, however hot the group.
    """
    per_ms = (
        events.filter(F.col("timestamp_ms").isNotNull())
        .groupBy(*group, "timestamp_ms")
        .agg(F.count("*").alias("posts"), F.sum("risk").alias("risk"))
    )
    slice_no = F.floor(F.col("timestamp_ms") / (width_ms + 1))
    copies = per_ms.withColumn(
        "_copy",
        F.explode(F.array(F.struct(slice_no.alias("slice"), F.lit(True).alias("own")),
                          F.struct((slice_no - 1).alias("slice"), F.lit(False).alias("own")))),
    ).select(*group, "timestamp_ms", "posts", "risk", "_copy.slice", "_copy.own")
    ahead = Window.partitionBy(*group, "slice").orderBy("timestamp_ms").rangeBetween(0, width_ms)
    return (
        copies.withColumn("n", F.sum("posts").over(ahead))
        .withColumn("window_risk", F.sum("risk").over(ahead))
        .filter(F.col("own") & (F.col("n") >= min_count) & (F.col("window_risk") >= min_risk))
        .groupBy(*group)
        .agg(F.min(F.struct(F.col("timestamp_ms").alias("start_ms"), "n")).alias("first"))
        .select(*group, "first.start_ms", "first.n")
    )


def in_burst(posts: DataFrame, bursts: DataFrame, group: list[str], width_ms: int) -> DataFrame:
    """Posts inside their group's burst window."""
    inside = F.col("timestamp_ms").between(F.col("start_ms"), F.col("start_ms") + width_ms)
    return skew_join(posts, bursts, group, ["id"]).filter(inside)


def _bonus(df: DataFrame, risk: str, score: Column, label: Column) -> DataFrame:
    return df.select("thread_id", "id", F.lit(risk).alias("risk_type"), score.cast("int").alias("score"), label.alias("label"))


def prepare_posts(replies: DataFrame, lexicon=None) -> DataFrame:
    """Replies with author key, timestamp, duplicate key and lexical scores; no full text."""
    time_text = F.col("time") if "time" in replies.columns else F.lit(None).cast("string")
    scored = lexical_scores(replies, lexicon).withColumn("_key", dedupe_key(F.col("content")))
    return scored.select(
        "thread_id", "id", "pos", "parent_reply_id",
        author_key(F.col("author_name"), F.col("id")).alias("author_key"),
        F.coalesce(F.col("timestamp_ms"), parse_forum_time(time_text)).alias("timestamp_ms"),
        (F.col("timestamp_ms").isNull() & time_text.isNull()).alias("lacks_time"),
        (F.col("image_count") > 0).alias("has_images"),
        F.md5("_key").alias("text_key"),
        *[c for c in scored.columns if c.startswith(("score_", "labels_"))],
    )


def risk_scores(posts: DataFrame, targets: DataFrame) -> DataFrame:
    """``thread_id, id, risk_type, score, labels`` over all signals, clamped to 100."""
    signals = None

    def add(df):
        nonlocal signals
        signals = df if signals is None else signals.unionByName(df)

    for risk in fv.RISK_TYPES[:3]:
        direct = posts.filter(F.col(f"score_{risk}") > 0).select(
            "thread_id", "id", F.lit(risk).alias("risk_type"), F.col(f"score_{risk}").alias("score"),
            F.array_join(f"labels_{risk}", "\n").alias("label"),
        )
        add(direct)

    copies = skew_join(posts, duplicate_counts(posts), ["thread_id", "author_key", "text_key"], ["id"])
    add(
        _bonus(
            copies, "spam",
            F.least(F.lit(fv.DUPLICATE_MAX), F.lit(fv.DUPLICATE_BASE) + (F.col("n") - fv.DUPLICATE_MIN) * fv.DUPLICATE_STEP),
            F.concat(F.lit("同一作者重复发布相同或近似文本（"), "n", F.lit("次）")),
        )
    )

    direct_risk = F.col("score_personal_attack") + F.col("score_provocation") + F.col("score_harassment")
    light = posts.select("thread_id", "id", "author_key", "timestamp_ms", direct_risk.alias("risk"))
    pair = ["thread_id", "left", "right"]
    exchanges = (
        light.join(targets, ["thread_id", "id"])
        .filter(F.col("target") != F.col("author_key"))
        .withColumn("left", F.least("author_key", "target"))
        .withColumn("right", F.greatest("author_key", "target"))
    )
    exchanges = cut_lineage(exchanges)
    busy = heavy_keys(exchanges, pair)
    per_direction = exchanges.groupBy("thread_id", "author_key", "target", "left", "right").agg(F.count("*").alias("sent"))
    mutual = (
        per_direction.groupBy(*pair)
        .agg(F.count("*").alias("sides"), F.sum("sent").alias("n"))
        .filter((F.col("sides") == 2) & (F.col("n") >= fv.MUTUAL_MIN))
        .drop("sides")
    )
    flagged = skew_join(exchanges, mutual, pair, ["id"], "left", heavy=busy)
    add(
        _bonus(
            flagged.filter(F.col("n").isNotNull()), "provocation", F.lit(fv.MUTUAL_BONUS),
            F.concat(F.lit("双方连续互回（"), "n", F.lit("条）")),
        )
    )
    own_bonus = F.when(F.col("n").isNotNull(), F.least(F.lit(fv.MUTUAL_BONUS), 100 - F.col("score_provocation"))).otherwise(F.lit(0))
    timed = flagged.join(posts.select("thread_id", "id", "score_provocation"), ["thread_id", "id"]).select(
        *pair, "id", "timestamp_ms", (F.col("risk") + own_bonus).alias("risk")
    )
    rule = fv.REPLY_BURST
    bursts = earliest_burst(timed, pair, rule["width_ms"], rule["min_count"], rule["min_risk"])
    add(
        _bonus(
            in_burst(timed, bursts, pair, rule["width_ms"]), "provocation", F.lit(rule["bonus"]),
            F.concat(F.lit("10分钟内密集互回（"), "n", F.lit("条）")),
        )
    )
    repeated = per_direction.filter(F.col("sent") >= fv.MENTION_MIN).select("thread_id", "author_key", "target", "sent")
    add(
        _bonus(
            skew_join(exchanges, repeated, ["thread_id", "author_key", "target"], ["id"]), "harassment", F.lit(fv.MENTION_BONUS),
            F.concat(F.lit("反复 @ 同一对象（"), "sent", F.lit("次）")),
        )
    )
    rule = fv.POSTING_BURST
    by_author = ["thread_id", "author_key"]
    fast = earliest_burst(light, by_author, rule["width_ms"], rule["min_count"])
    add(
        _bonus(
            in_burst(light, fast, by_author, rule["width_ms"]), "spam", F.lit(rule["bonus"]),
            F.concat(F.lit("2分钟内密集发布（"), "n", F.lit("条）")),
        )
    )
    # A reply has a handful of signals, bounded by the targets its own text names.
    return signals.groupBy("thread_id", "id", "risk_type").agg(
        F.least(F.lit(100), F.sum("score")).cast("int").alias("score"),
        F.array_distinct(F.split(F.array_join(F.array_sort(F.collect_list("label")), "\n"), "\n")).alias("labels"),
    )


def scored_members(posts: DataFrame, targets: DataFrame, scores: DataFrame, thresholds=None) -> DataFrame:
    """Replies at or over their type's threshold with the cluster of their first two participants."""
    limits = {**fv.THRESHOLDS, **(thresholds or {})}
    limit = F.lit(None).cast("int")
    for risk, value in limits.items():
        limit = F.when(F.col("risk_type") == risk, F.lit(value)).otherwise(limit)
    per_reply = targets.groupBy("thread_id", "id").agg(F.collect_set("target").alias("targets"))
    members = (
        scores.filter(F.col("score") >= limit)
        .join(posts.select("thread_id", "id", "pos", "author_key", "parent_reply_id", "lacks_time", "has_images"), ["thread_id", "id"])
        .join(per_reply, ["thread_id", "id"], "left")
        .withColumn("targets", F.coalesce("targets", F.array().cast("array<string>")))
    )
    everyone = F.array_sort(F.concat(F.array("author_key"), F.col("targets")))
    cluster = F.array_join(F.slice(everyone, 1, 2), "\x00")
    return members.withColumn("cluster", cluster)


FINDING = ["thread_id", "risk_type", "cluster"]


def reply_set_digest(reply_id: Column) -> Column:
    """Order-free digest of a set of ids as an aggregate."""
    part = F.conv(F.substring(F.md5(reply_id), 1, 15), 16, 10).cast("decimal(38,0)")
    return F.sum(part).cast("string")


def finding_participants(members: DataFrame) -> DataFrame:
    """Distinct known participants of each finding with the order in which they first appear."""
    people = F.concat(
        F.array(F.struct(F.lit(0).alias("rank"), F.col("author_key").alias("name"))),
        F.transform("targets", lambda n: F.struct(F.lit(1).alias("rank"), n.alias("name"))),
    )
    return (
        members.select(*FINDING, "pos", F.explode(people).alias("p"))
        .filter(~F.col("p.name").startswith(UNKNOWN_AUTHOR))
        .groupBy(*FINDING, F.col("p.name").alias("name"))
        .agg(F.min(F.struct("pos", "p.rank", -F.length("p.name"), "p.name")).alias("first_seen"))
    )


def severity(score: Column) -> Column:
    return F.when(score >= 85, "critical").when(score >= 65, "high").when(score >= 40, "medium").otherwise("low")


def reason_candidates(rules: DataFrame) -> DataFrame:
    """Best three rules per risk type: preferred ids, then keywords in the text, then in the category."""
    ranked = None
    for risk in fv.RISK_TYPES:
        score = F.lit(-1)
        for i, word in reversed(list(enumerate(fv.REASON_KEYWORDS[risk]))):
            score = F.when(F.col("category_title").contains(word), F.lit(10 - i)).otherwise(score)
        for i, word in reversed(list(enumerate(fv.REASON_KEYWORDS[risk]))):
            score = F.when(F.col("text").contains(word), F.lit(100 - i)).otherwise(score)
        for i, rule_id in enumerate(fv.PREFERRED_REASONS[risk]):
            score = F.when(F.col("rule_id") == rule_id, F.lit(1000 - i)).otherwise(score)
        rows = rules.select(F.lit(risk).alias("risk_type"), "rule_id", score.alias("match_score"))
        ranked = rows if ranked is None else ranked.unionByName(rows)
    best = top_per_group(
        ranked.filter(F.col("match_score") >= 0), ["risk_type"], [F.desc("match_score"), F.col("rule_id")], 3, "rank"
    )
    return best.select(
        "risk_type", "rule_id", "rank", F.greatest(F.lit(0.55), F.lit(0.94) - (F.col("rank") - 1) * 0.12).alias("confidence")
    )


def build_findings(members: DataFrame, replies: DataFrame, reasons: DataFrame) -> DataFrame:
    """One row per finding.  Lists are bounded: three reasons, eight pieces of evidence.

    All replies and participants of a finding stay in ``members`` and ``finding_participants``.
    """
    totals = members.groupBy(*FINDING).agg(
        F.count("*").alias("reply_count"),
        reply_set_digest(F.col("id")).alias("digest"),
        F.bool_or("lacks_time").alias("lacks_time"),
        F.bool_or("has_images").alias("has_images"),
        F.bool_or(F.col("parent_reply_id").isNotNull() & (F.size("targets") == 0)).alias("lost_parent"),
    )
    best = top_per_group(members, FINDING, [F.desc("score"), F.col("pos")], 8, "rank").join(
        replies.select("thread_id", "id", excerpt(F.col("content")).alias("excerpt")), ["thread_id", "id"]
    )
    evidence = best.groupBy(*FINDING).agg(
        F.avg(F.when(F.col("rank") <= 3, F.col("score"))).alias("top_average"),
        F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("reply_id"), "score", "labels", "excerpt"))).alias("evidence"),
    )
    leading = top_per_group(finding_participants(members), FINDING, [F.col("first_seen")], 3, "rank")
    people = leading.groupBy(*FINDING).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda p: p["name"]), "、").alias("people")
    )
    listed = reasons.groupBy("risk_type").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("rule_id").alias("reason_id"), "confidence"))).alias("reason_candidates")
    )
    label = F.lit(None).cast("string")
    for risk, text in fv.RISK_LABELS.items():
        label = F.when(F.col("risk_type") == risk, F.lit(text)).otherwise(label)
    score = F.least(F.lit(100), F.round(F.col("top_average") + F.least(F.lit(12), (F.col("reply_count") - 1) * 3)).cast("int"))
    notes = fv.UNCERTAINTY_TEXTS
    return (
        totals.join(evidence, FINDING)
        .join(people, FINDING, "left")
        .join(F.broadcast(listed), "risk_type", "left")
        .withColumn("score", score)
        .select(
            *FINDING,
            F.concat(F.lit("F-"), "risk_type", F.lit("-"), "digest").alias("finding_id"),
            "score",
            severity(F.col("score")).alias("severity"),
            "reply_count",
            F.concat(
                F.coalesce("people", F.lit("未知用户")), F.lit("的"), "reply_count", F.lit("条回复命中"), label,
                F.lit("信号，请回到原楼对照上下文复核。"),
            ).alias("summary"),
            "evidence",
            "reason_candidates",
            F.array_compact(
                F.array(
                    F.lit(notes["always"]),
                    F.when(F.col("lacks_time"), F.lit(notes["no_time"])),
                    F.when(F.col("has_images"), F.lit(notes["images"])),
                    F.when(F.col("lost_parent"), F.lit(notes["parent"])),
                    F.when(F.col("reason_candidates").isNull(), F.lit(notes["no_reason"])),
                )
            ).alias("uncertainties"),
        )
    )


def finding_members(replies: DataFrame, lexicon=None, thresholds=None) -> DataFrame:
    """Scored replies of every finding.  Inputs that every signal reads are written once."""
    posts = cut_lineage(prepare_posts(replies, lexicon))
    targets = cut_lineage(resolve_targets(replies))
    return cut_lineage(scored_members(posts, targets, risk_scores(posts, targets), thresholds))


def analyze_replies(replies: DataFrame, rules: DataFrame, lexicon=None, thresholds=None) -> DataFrame:
    """Findings of every thread."""
    members = finding_members(replies, lexicon, thresholds)
    return build_findings(members, replies, reason_candidates(rules))
