"""Constants, word lists, patterns and alias tables that results depend on.

Everything in this file is data.  Patterns are written for Java regular expressions.
"""

# White space and trimming follow the ECMAScript definition (Unicode spaces and the BOM).
SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
BLANK = r"\t\p{Zs}"

SCHEMA_VERSION = "1.0"
HISTORY_SCHEMA_VERSION = 1
CLOUD_ANALYZER_VERSION = "3.0.0"
TRANSPORT_VERSION = "sidepanel-v3"
PROTOCOL_VERSION = 3

MAX_PAYLOAD_BYTES = 2_000_000
MAX_PAYLOAD_TOKENS = 600_000
MAX_REPORTED_TOKENS = 10_000_000
TIMEOUT_MS = {"fast": 180_000, "deep": 600_000}
READ_LIMITS = {"main_pages": 500, "nested_pages": 500}
MAX_PAGE_NUMBER = 1_000_000

# Risk types, thresholds and display labels.
RISK_TYPES = ["personal_attack", "provocation", "harassment", "spam"]
ALL_RISK_TYPES = ["personal_attack", "provocation", "harassment", "spam", "privacy", "other"]
SEVERITIES = ["low", "medium", "high", "critical"]
THRESHOLDS = {"personal_attack": 20, "provocation": 20, "harassment": 25, "spam": 40}
RISK_LABELS = {
    "personal_attack": "人身攻击",
    "provocation": "挑衅引战",
    "harassment": "挂人骚扰",
    "spam": "刷屏",
}

# Lexicon: (risk type, pattern, label, score); each pattern counts once per reply.
LEXICON = [
    ("personal_attack", r"傻[" + SPACE + r"._-]*[逼屄比]|煞笔|脑残|智障|弱智", "高风险辱骂词", 28),
    ("personal_attack", r"死妈|司马|没妈|全家(?:死|火葬)", "针对亲属的恶毒辱骂", 36),
    ("personal_attack", r"废物|垃圾|畜生|狗东西|贱人|蟊贼", "贬损人格表达", 24),
    ("personal_attack", r"你有病|滚(?:出|回)?|闭嘴|脑子呢|带脑子", "贬损或驱赶表达", 15),
    ("provocation", r"急了|破防|气不气|红温|跳脚", "刺激对方情绪的表达", 20),
    ("provocation", r"小丑|孝死|典中典|赢麻|乐子|绷不住", "嘲弄或拱火表达", 16),
    ("provocation", r"不会真有人|就这|(?:来|敢)对线|不服来|(?:又|还)在洗", "挑衅式句型", 20),
    ("provocation", r"钓鱼|引战|拱火|带节奏", "引战或钓鱼表达", 22),
    ("harassment", r"开盒|人肉|盒武器|查你户籍", "人肉或开盒威胁", 42),
    ("harassment", r"挂人|曝光他|公开他|挂出来", "挂人或公开他人信息", 30),
    ("harassment", r"骚扰|私信轰炸|追着骂|大家去找他", "召集或持续骚扰", 30),
    ("harassment", r"真实姓名|住址|家庭住址|学校|工作单位|手机号", "涉及可识别个人信息", 22),
]
EXPLICIT_TARGET = (
    r"(?:回复|回覆)[" + SPACE + r"]*(?:第?[" + SPACE + r"]*[0-9]+[" + SPACE + r"]*楼"
    r"|@?[A-Za-z0-9_\x{3400}-\x{9FFF}-]{1,30})|@[A-Za-z0-9_\x{3400}-\x{9FFF}-]{1,30}"
)
EXPLICIT_TARGET_LABEL = "存在明确回复或 @ 对象"
EXPLICIT_TARGET_BONUS = 7

# Score rules: duplicated text, mutual exchange, bursts and repeated mentions.
DUPLICATE_MIN, DUPLICATE_BASE, DUPLICATE_STEP, DUPLICATE_MAX = 3, 48, 8, 90
MUTUAL_MIN, MUTUAL_BONUS = 4, 10
MENTION_MIN, MENTION_BONUS = 3, 27
REPLY_BURST = {"width_ms": 600_000, "min_count": 3, "min_risk": 35, "bonus": 9}
POSTING_BURST = {"width_ms": 120_000, "min_count": 5, "min_risk": 0, "bonus": 12}

REASON_KEYWORDS = {
    "personal_attack": ["人身攻击", "辱骂", "侮辱", "恶意攻击", "不友善"],
    "provocation": ["挑衅", "引战", "钓鱼", "拱火", "引起争端"],
    "harassment": ["挂人", "骚扰", "人肉", "开盒", "个人信息", "隐私"],
    "spam": ["刷屏", "重复", "灌水", "无意义回复"],
}
PREFERRED_REASONS = {
    "personal_attack": ["R03.01", "R03.04", "R03.05"],
    "provocation": ["R04.01", "R04.02", "R04.08"],
    "harassment": ["R04.07", "R05.01", "R01.04"],
    "spam": ["R06.05", "R06.07"],
}
UNCERTAINTY_TEXTS = {
    "always": "文本规则无法单独判断引用、反讽或熟人玩笑",
    "no_time": "部分回复缺少时间，短时升温判断可能不完整",
    "images": "图片内容未识别",
    "parent": "部分被回复内容未抓取，上下文可能不完整",
    "no_reason": "未在当前规则库中找到可靠的直接理由",
}

# Personal data patterns and their placeholders, in replacement order.
SENSITIVE = [
    (
        r"(?iu)(?:q[" + SPACE + r"]*q|扣扣|企鹅(?:号)?)(?:[" + SPACE + r"]*(?:号|号码|id))?["
        + SPACE + r"]*[:：]?[" + SPACE + r"]*[1-9][0-9]{4,11}",
        "[QQ号]",
    ),
    (
        r"(?iu)(?:微信|微信号|v[" + SPACE + r"]*x|v信|w[" + SPACE + r"]*x|wechat)(?:["
        + SPACE + r"]*(?:号|号码|id))?[" + SPACE + r"]*[:：]?[" + SPACE + r"]*[a-z][-_a-z0-9]{5,19}",
        "[微信号]",
    ),
    (
        r"(?iu)[a-z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
        r"(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)+",
        "[邮箱]",
    ),
    (r"(?iu)(?<![0-9a-z])(?:[0-9]{17}[0-9x]|[0-9]{15})(?![0-9a-z])", "[身份证]"),
    (
        r"(?<![0-9])(?:(?:\+|00)86[" + SPACE + r"-]?)?1[3-9][0-9][" + SPACE
        + r"-]?[0-9]{4}[" + SPACE + r"-]?[0-9]{4}(?![0-9])",
        "[手机号]",
    ),
    (
        r"(?<![0-9])(?:\+?86[" + SPACE + r"-]?)?0[0-9]{2,3}[" + SPACE + r"-]?[0-9]{7,8}(?![0-9])",
        "[电话]",
    ),
]
UNKNOWN_MENTION = r"@[\p{L}\p{N}_.\-·]{1,40}"
UNKNOWN_TARGET = r"((?:回复|回覆)[" + SPACE + r"]*@?)[\p{L}\p{N}_.\-·]{1,40}(?=[" + SPACE + r"]*[:：])"
NAME_PLACEHOLDER = "[用户名]"
HIDDEN_NAME = "相关用户"

# Relation evidence.
FLOOR_REFERENCE = r"(?:第[" + BLANK + r"]*)?([1-9][0-9]{0,8})[" + BLANK + r"]*楼"
ABOVE_REFERENCE = r"楼上|上一楼"

# Captured page wording.
REMOVAL_NOTICE = (
    r"(?:该|此)?(?:楼层|回复|内容|帖子)[^\n\r\x{2028}\x{2029}]{0,8}(?:已被?|被)?(?:删除|折叠|屏蔽|隐藏)"
    r"|(?:删除|折叠|屏蔽)提示"
)
ABSOLUTE_TIME = (
    r"20[0-9]{2}[-/.年][0-9]{1,2}[-/.月][0-9]{1,2}(?:日)?(?:[" + SPACE + r"]+[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)?"
    r"|[0-9]{1,2}[-/.月][0-9]{1,2}(?:日)?[" + SPACE + r"]+[0-9]{1,2}:[0-9]{2}"
    r"|今天[" + SPACE + r"]*[0-9]{1,2}:[0-9]{2}|昨天[" + SPACE + r"]*[0-9]{1,2}:[0-9]{2}"
)
RELATIVE_TIME = (
    r"刚刚|[0-9]+(?:\.[0-9]+)?[" + SPACE + r"]*(?:秒|分钟|小时|天|周|个月|月|年)前|昨天|前天"
)
COMPACT_COUNT = r"([0-9]+(?:\.[0-9]+)?)[" + SPACE + r"]*(万)?"
DECLARED_COUNT = r"(?:全部)?回复[^0-9]{0,6}([0-9]{1,7})"
MASK_ONLY = r"^[※*＊⋯…·" + SPACE + r"]+$"
PREVIEW_LENGTH = 240

# Model text: protocol tokens with word boundaries that include full-width letters and digits.
WORDISH = r"A-Za-z0-9_Ａ-Ｚａ-ｚ０-９＿"
REPLY_TOKEN = r"(?<![" + WORDISH + r"])[PpＰｐ][" + BLANK + r"]*[0-9０-９]+(?![" + WORDISH + r"])"
AUTHOR_TOKEN = r"(?<![" + WORDISH + r"])[UuＵｕ][" + BLANK + r"]*[0-9０-９]+(?![" + WORDISH + r"])"
RULE_TOKEN = (
    r"(?<![" + WORDISH + r"])[RrＲｒ][" + BLANK + r"]*[0-9０-９]{1,3}[" + BLANK + r"]*[.．]["
    + BLANK + r"]*[0-9０-９]{1,3}(?![" + WORDISH + r"])"
)
PARTIAL_TOKEN_AT_END = r"(?<![" + WORDISH + r"])[PpUuＰｐＵｕ][" + BLANK + r"]*[0-9０-９]*\z"
TOKEN_WORDS = {"reply": "相关回复", "author": "相关用户", "rule": "所选规范"}

TYPE_ALIASES = {
    "personal_attack": ["personalattack", "attack", "insult", "abuse", "人身攻击", "辱骂攻击", "辱骂"],
    "provocation": ["provocation", "flamebait", "挑衅", "引战", "挑衅引战"],
    "harassment": ["harassment", "骚扰", "挂人", "骚扰挂人"],
    "spam": ["spam", "flooding", "刷屏", "重复发布"],
    "privacy": ["privacy", "privacyleak", "doxxing", "隐私", "隐私泄露", "个人信息泄露"],
    "other": ["other", "其他"],
}
SEVERITY_ALIASES = {
    "low": ["low", "minor", "mild", "低", "低风险", "轻微"],
    "medium": ["medium", "moderate", "中", "中等", "中风险"],
    "high": ["high", "severe", "高", "高风险", "严重"],
    "critical": ["critical", "extreme", "极高", "极高风险", "特别严重", "危急"],
}
NARRATIVE_TEXT_FIELDS = [
    "note", "text", "description", "reason", "summary", "explanation", "rationale", "issue",
    "concern", "details",
]
NARRATIVE_HEADING_FIELDS = ["label", "topic"]
NARRATIVE_REF_FIELDS = [
    ("replyId", False), ("replyIds", True), ("relatedReplyId", False), ("relatedReplyIds", True),
    ("contextReplyId", False), ("contextReplyIds", True),
]
LEGACY_REPORT_LISTS = [
    "discussionMap", "participantDynamics", "borderlineCases", "normalHeatedDiscussion",
    "coverageNotes", "reviewPriorities",
]

OVERVIEW_LENGTH = 240
LEGACY_OVERVIEW_LENGTH, LEGACY_ITEM_LENGTH, LEGACY_ITEMS = 20_000, 4_000, 100

# Providers and endpoint rules.
DEFAULT_PROVIDER = "alibaba"
PROVIDERS = ["alibaba", "deepseek"]
PROVIDER_HOSTS = {"api.deepseek.com": "deepseek"}
CREDENTIAL_QUERY_KEYS = [
    "apikey", "key", "xapikey", "subscriptionkey", "accesstoken", "token", "secret",
    "clientsecret", "password", "passwd", "signature", "sig", "auth", "authorization",
    "credential", "credentials",
]
CREDENTIAL_QUERY_SUFFIXES = ["apikey", "subscriptionkey", "token", "secret"]

# Ledger vocabularies.
ATTEMPT_STATUSES = [
    "preparing", "running", "success", "failed_before_send", "failed_after_send",
    "cancelled_before_send", "cancelled_after_send", "unknown_after_disconnect",
]
UNSENT_STATUSES = ["preparing", "failed_before_send", "cancelled_before_send"]
ERROR_CATEGORIES = [
    "configuration", "permission", "capture_incomplete", "network", "timeout", "provider",
    "validation", "aborted", "storage", "disconnect", "unknown",
]
RECEIPT_STATUSES = ["preparing", "sent", "success", "failed_before_send", "history_deleted"]
DECISIONS = ["delete", "keep", "watch", "undecided"]
HISTORY_IDENTITY = [
    "snapshot_id", "analysis_key", "thread_id", "thread_url", "provider", "model", "mode",
    "analyzer_version", "rules_version", "transport_version", "started_at",
]
RECORD_ID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
REPLY_ID = (
    r"^(?:[0-9]{1,30}|[0-9]{1,30}-first-floor|(?:[0-9]{1,30}|thread)-page-[0-9]{1,6}-floor-[0-9]{1,10}"
    r"(?:-nested-[0-9]{1,6})?|[0-9]{1,30}-nested-[0-9]{1,6}"
    r"|kr-(?:lzl(?:-temp)?|comment-temp)-[A-Za-z0-9-]{16,120})$"
)
SAFE_VERSION = r"^[0-9]{1,4}\.[0-9]{1,4}(?:\.[0-9]{1,4})?(?:-[A-Za-z0-9.-]{1,32})?$"
ISO_TIME = r"^[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])T(?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:\.[0-9]+)?)?(?:Z|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])$"
VERSION_TAG = r"^[A-Za-z0-9._-]{1,64}$"
ATTEMPT_ID = r"^[A-Za-z0-9:_-]{1,128}$"
FINDING_ID = r"^[A-Za-z0-9:_-]{1,200}$"
DIGEST = r"^[a-f0-9]{64}$"
MAX_HISTORY_ENTRIES = 100
MAX_HISTORY_BYTES = 4 * 1024 * 1024
MAX_USAGE_ENTRIES = 500

# Message texts of split or incomplete findings.
SPLIT_SUMMARY = "模型原本将多条没有明确回复关系的内容合并为一组；本项已按可验证的互动链拆分，请单独复核。"
SPLIT_RATIONALE = "原模型结论混合了无明确结构关系的回复；仅保留本互动链的规范候选和置信度，需吧务回原文确认。"
SPLIT_NOTE = "原模型结果曾将无明确回复、楼层引用或点名关系的内容合并；本地已按可验证关系拆分。"
FALLBACK_SIGNAL = "AI：模型标记该回复，需结合前后文人工复核"
LOW_CONFIDENCE_TITLE = "未达到高置信门槛"
LOW_CONFIDENCE_PREFIX = "低置信线索（未列为违规）："
NOTHING_KEPT_SUMMARY = "模型候选经回复关系与协议校验后，未保留达到门槛的违规线索；以审阅报告和人工复核为准。"
KEPT_SUMMARY = "模型候选经回复关系与协议校验后整理为 %d 组，以下方线索卡和原文复核为准。"
MIN_CONFIDENCE = 0.7
UNKNOWN_RULE_TEXT = "当前理由库中不存在对应条目的规范（模型引用无效）"
LIMITATIONS = [
    "包含当前整帖只读接口能够返回的全部文字楼层和楼中楼。",
    "不包含帖子链接、用户名、Cookie、登录信息或图片内容。",
]

# Titles of a capture's diagnosis, and what a complete text leaves out.
DIAGNOSIS_TITLES = {
    "done": "接口可见文字已读完",
    "limit_reached": "读取达到安全上限，不能作为完整快照",
    "missing_pages": "主回复仍缺 %d 页",
    "failed_requests": "有 %d 个只读请求失败",
    "missing_parents": "仍有 %d 个楼中楼父楼未读完",
    "structure": "有 %d 个接口回复节点无法可靠解析",
    "unverified": "接口返回内容未通过完整性校验",
}
SCOPE_EXCLUSIONS = {
    "unavailable": "不会把 %d 条站点统计差额当作已读取内容",
    "image_count": "不包含 %d 张图片中的文字",
}
SCOPE_NOTE = "本次 AI 只分析已读取的文字；%s。"
