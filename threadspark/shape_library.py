"""Shapes of model answers, decisions and history entries.  Bounds and choices are fixed values of the formats."""

from threadspark import fixed_values as fv
from threadspark.operators.shapes import Shape, listed, number, record, text

TYPES, LEVELS = tuple(fv.ALL_RISK_TYPES), tuple(fv.SEVERITIES)
TOKEN = text(least=1, bare=True)
ANY = Shape(("object", "array", "string", "integer", "number", "boolean", "null"), strict=False)

# One finding answered for one selection: strict.
FINDING_ANSWER = record({
    "summary": text(1_500, 1),
    "type": text(choices=(*TYPES, "none"), bare=True),
    "score": number(0, 100),
    "replyIds": listed(TOKEN, 100),
    "evidence": listed(record({"replyId": TOKEN, "explanation": text(800, 1)}), 100),
    "reasonCandidates": listed(record({"reasonId": TOKEN, "confidence": number(0, 1), "rationale": text(800, 1)}), 10),
    "uncertainties": listed(text(500, 1), 20),
})


def _finding(summary: Shape, rationale: Shape, explanation: Shape) -> Shape:
    """Keys that nobody asked for are ignored; enums and numbers have their own, more lenient readers."""
    fields = {
        "summary": summary, "rationale": rationale, "primaryReasonId": TOKEN,
        "offendingReplyIds": listed(TOKEN), "contextReplyIds": listed(TOKEN, 100).or_null(),
        "evidence": listed(record({"replyId": TOKEN, "explanation": explanation}, strict=False), 100).or_null(),
    }
    return record(fields, optional=tuple(fields), strict=False)


def _answer(summary: Shape, finding: Shape, more: dict[str, Shape]) -> Shape:
    fields = {"summary": summary, "findings": listed(finding)} | more
    return record(fields, optional=tuple(fields), strict=False)


# A whole thread's answer, current protocol: longer texts are cut, so only their presence is checked.
ANSWER_V3 = _answer(
    text(least=1), _finding(text(least=1), text(least=1), text(least=1)),
    {"protocolVersion": number(fv.PROTOCOL_VERSION, fv.PROTOCOL_VERSION), "report": record({"overview": text(least=1)}, strict=False)},
)
# The older one bounds its texts.
ANSWER_LEGACY = _answer(text(3_000, 1), _finding(text(1_500, 1), text(800, 1), text(800, 1)), {})

# A stored decision.
VERSION = text(pattern=fv.SAFE_VERSION)
RECORD = record(
    {
        "schemaVersion": text(choices=(fv.SCHEMA_VERSION,), bare=True),
        "id": text(pattern=fv.RECORD_ID),
        "threadId": text(pattern="^[0-9]{1,30}$", bare=True).or_null(),
        "threadUrl": text(),
        "replyIds": listed(text(pattern=fv.REPLY_ID), 10_000),
        "decision": text(choices=tuple(fv.DECISIONS), bare=True),
        "primaryReasonId": text().or_null(),
        "internalTags": listed(text(choices=(*TYPES, *LEVELS), bare=True), 16),
        "reviewedAt": text(pattern=fv.ISO_TIME, bare=True),
        "analysisAttemptId": text(pattern=fv.ATTEMPT_ID).or_null(),
        "snapshotId": text(pattern=fv.DIGEST, bare=True).or_null(),
        "findingId": text(pattern=fv.FINDING_ID).or_null(),
        "analyzerVersions": record({"local": text(pattern=f"^disabled$|{fv.SAFE_VERSION}"), "cloud": VERSION.or_null(), "rules": VERSION}),
    },
    optional=("analysisAttemptId", "snapshotId", "findingId"),
)
RECORD_EXPORT = record({"schemaVersion": text(choices=(fv.SCHEMA_VERSION,), bare=True), "exportedAt": text(pattern=fv.ISO_TIME, bare=True), "records": listed(RECORD)})

# A history entry.
REPLY = text(pattern=fv.REPLY_ID)
COUNT, TOKENS = number(0, 1_000_000, whole=True), number(0, 10_000_000, whole=True)
USAGE = record({"inputTokens": TOKENS, "outputTokens": TOKENS, "totalTokens": TOKENS})
HISTORY_FINDING = record(
    {
        "id": text(300, 1), "type": text(choices=TYPES, bare=True), "severity": text(choices=LEVELS, bare=True), "score": number(0, 100),
        "summary": text(3_000, 1), "replyIds": listed(REPLY, 100), "contextReplyIds": listed(REPLY, 100), "participantNames": listed(ANY, 0),
        "evidence": listed(record({"replyId": REPLY, "excerpt": text(choices=("",), bare=True), "signals": listed(text(800, 1), 100), "score": number(0, 100)}), 100),
        "reasonCandidates": listed(record({"reasonId": text(pattern=r"^R[0-9]{2}\.[0-9]{2}$"), "confidence": number(0, 1), "rationale": text(800, 1)}), 50),
        "uncertainties": listed(text(4_000, 1), 50),
    },
    optional=("contextReplyIds",),
)
ITEM = {"title": text(32, 1), "summary": text(160, 1), "replyIds": listed(REPLY, 50)}
REPORT_V3 = record({
    "overview": text(240), "stages": listed(record(ITEM), 8), "interactions": listed(record(ITEM), 5),
    "notes": listed(record(ITEM | {"kind": text(choices=("needs_human_check", "heated_but_allowed"), bare=True)}), 8),
})
REPORT_LEGACY = record({"discussionOverview": text(20_000)} | {name: listed(text(4_000, 1), 100) for name in fv.LEGACY_REPORT_LISTS})
_RESULT = {
    "summary": text(3_000, 1), "findings": listed(HISTORY_FINDING, 300), "uncertainties": listed(text(4_000, 1), 50),
    "analyzedReplyCount": COUNT, "ruleCount": number(0, 10_000, whole=True), "omittedImageCount": COUNT, "usage": USAGE,
}
_PLAIN = r"^[^\x00-\x1F\x7F]*$"


def _entry(report: Shape, version: int, optional: tuple[str, ...]) -> Shape:
    result = record(_RESULT | {"protocolVersion": number(version, version), "report": report}, optional=("usage", *optional))
    return record(
        {
            "schemaVersion": number(fv.HISTORY_SCHEMA_VERSION, fv.HISTORY_SCHEMA_VERSION), "attemptId": text(pattern=fv.ATTEMPT_ID),
            "snapshotId": text(pattern=fv.DIGEST, bare=True), "analysisKey": text(pattern=fv.DIGEST, bare=True),
            "threadId": text(pattern="^[0-9]{1,30}$", bare=True), "threadUrl": text(),
            "threadTitle": text(300, 1, pattern=_PLAIN), "provider": text(choices=tuple(fv.PROVIDERS), bare=True), "model": text(160, 1, pattern=_PLAIN),
            "mode": text(choices=("fast", "deep"), bare=True), "analyzerVersion": text(pattern=fv.VERSION_TAG, bare=True),
            "rulesVersion": text(pattern=fv.VERSION_TAG, bare=True), "transportVersion": text(pattern=fv.VERSION_TAG, bare=True),
            "startedAt": text(pattern=fv.ISO_TIME, bare=True), "completedAt": text(pattern=fv.ISO_TIME, bare=True),
            "coverage": record({"visibleReplyCount": COUNT, "imageCount": COUNT, "unavailableReplyCount": COUNT}), "usage": USAGE, "result": result,
            "replyRefs": listed(record({"id": REPLY, "floor": number(1, 10_000_000, whole=True).or_null(), "parentReplyId": REPLY.or_null(), "isNested": Shape(("boolean",)), "sourcePage": number(1, 1_000_000, whole=True)}), 10_000),
        },
        optional=("usage",),
    )


HISTORY_V3 = _entry(REPORT_V3, 3, ())
HISTORY_LEGACY = _entry(REPORT_LEGACY, 2, ("protocolVersion", "report"))
