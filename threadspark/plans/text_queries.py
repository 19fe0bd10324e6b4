"""Queries over the scalar functions, each on whole tables and whole texts."""

from pyspark.sql import functions as F

from threadspark import fixed_values as fv
from threadspark.functions import privacy, text as tx, urls
from threadspark.plans.registry import WS, query, sql_clean, sql_squeeze, sql_trim

HOST = "forum.example.org"


@query("clean_text", f"SELECT doc_id, md5({sql_clean('text')}) AS clean_md5, length({sql_clean('text')}) AS clean_length FROM documents")
def clean_text(t):
    cleaned = t.documents.select("doc_id", tx.clean_text(F.col("text")).alias("c"))
    return cleaned.select("doc_id", F.md5("c").alias("clean_md5"), F.length("c").cast("bigint").alias("clean_length"))


@query(
    "canonical_text",
    "SELECT doc_id, md5(" + sql_trim(
        "array_to_string(list_transform(string_split(regexp_replace(nfc_normalize(text), '\\r\\n?', chr(10), 'g'), chr(10)), "
        "lambda x: " + sql_trim("regexp_replace(x, '[\\t\\f\\x{0B} ]+', ' ', 'g')") + "), chr(10))"
    ) + ") AS canonical_md5 FROM documents",
)
def canonical_text(t):
    return t.documents.select("doc_id", F.md5(tx.canonical_text(F.col("text"))).alias("canonical_md5"))


_DEDUPE_SQL = (
    "regexp_replace(regexp_replace(lower(nfc_normalize(@)), "
    f"'(?:回复|回覆)[{WS}]*(?:@[^{WS}:：]+|[0-9]+楼)?[{WS}]*[:：]?', '', 'g'), "
    "'[^\\p{L}\\p{N}]+', '', 'g')"
)


@query("dedupe_key", f"SELECT doc_id, {_DEDUPE_SQL.replace('@)', 'text)')} AS dedupe_key FROM documents")
def dedupe_key(t):
    return t.documents.select("doc_id", tx.dedupe_key(F.col("text")).alias("dedupe_key"))


@query("repeat_key", f"SELECT doc_id, md5({sql_squeeze('lower(nfc_normalize(text))')}) AS repeat_md5 FROM documents")
def repeat_key(t):
    return t.documents.select("doc_id", F.md5(tx.repeat_key(F.col("text"))).alias("repeat_md5"))


@query(
    "flatten_content",
    f"""SELECT conv_id, turn,
          md5({sql_trim("regexp_replace(concat(" + sql_clean("text") + ", CASE WHEN turn % 2 = 0 THEN 'tail' ELSE '' END), '[ ]+', ' ', 'g')")}) AS text_md5,
          CAST((turn % 3 = 0)::INT + 1 AS BIGINT) AS images
        FROM conversations""",
)
def flatten_content(t):
    def part(kind, text=None, c=None, origin=None):
        def value(v):
            return F.lit(None).cast("string") if v is None else v

        return F.struct(
            kind.cast("string").alias("type"), value(text).alias("text"), value(c).alias("c"),
            value(origin).alias("origin_src"), F.lit(None).cast("string").alias("cdn_src"),
        )

    turn = F.col("turn")
    parts = F.array(
        part(F.lit("0"), text=F.col("text")),
        part(F.lit("3"), text=F.lit("ignored")),
        F.when(turn % 2 == 0, part(F.lit(2), c=F.lit(" tail "))),
        F.when(turn % 3 == 0, part(F.lit("5"), origin=F.lit("http://img"))),
        part(F.lit("9"), text=F.lit("other kinds are skipped")),
    )
    content, images = tx.flatten_content(F.col("parts"))
    rows = t.conversations.select("conv_id", "turn", parts.alias("parts"))
    return rows.select("conv_id", "turn", F.md5(content).alias("text_md5"), images.cast("bigint").alias("images"))


@query(
    "epoch_ms",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL
         ELSE epoch_ms(o_orderdate) // 1000 * 1000 END AS timestamp_ms,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL
         ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') END AS iso FROM orders""",
)
def epoch_ms(t):
    seconds = F.unix_seconds("o_orderdate")
    raw = (
        F.when(F.col("o_orderkey") % 14 == 0, F.lit("yesterday"))
        .when(F.col("o_orderkey") % 7 == 0, F.lit("-5"))
        .when(F.col("o_orderkey") % 2 == 0, seconds.cast("string"))
        .otherwise((seconds * 1000).cast("string"))
    )
    ms = tx.epoch_ms(raw)
    return t.orders.select("o_orderkey", ms.alias("timestamp_ms"), tx.iso_time(ms).alias("iso"))


@query(
    "parse_forum_time",
    """SELECT event_id, CASE event_id % 4
         WHEN 0 THEN epoch_ms(date_trunc('minute', ts)) WHEN 1 THEN epoch_ms(date_trunc('day', ts))
         WHEN 2 THEN (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) * 1000 END AS parsed_ms FROM events""",
)
def parse_forum_time(t):
    kind = F.col("event_id") % 4
    shown = (
        F.when(kind == 0, F.date_format("ts", "yyyy年M月d日 HH:mm"))
        .when(kind == 1, F.date_format("ts", "yyyy.MM/dd"))
        .when(kind == 2, F.date_format("ts", "H:mm:ss"))
        .otherwise(F.lit("刚刚"))
    )
    return t.events.select("event_id", tx.parse_forum_time(shown).alias("parsed_ms"))


@query(
    "extract_time_text",
    """SELECT event_id, CASE event_id % 4
         WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M') WHEN 1 THEN concat(hour(ts), '小时前')
         WHEN 2 THEN concat('昨天 ', strftime(ts, '%H:%M')) END AS time_text FROM events""",
)
def extract_time_text(t):
    kind = F.col("event_id") % 4
    shown = (
        F.when(kind == 0, F.concat(F.lit("发布于 "), F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit(" 来自网页")))
        .when(kind == 1, F.concat(F.lit("楼主 "), F.hour("ts"), F.lit("小时前 发表")))
        .when(kind == 2, F.concat(F.lit("昨天 "), F.date_format("ts", "HH:mm")))
        .otherwise(F.col("event_type"))
    )
    return t.events.select("event_id", tx.extract_time_text(shown).alias("time_text"))


@query(
    "compact_count",
    """SELECT p_partkey, CAST(floor(CAST(p_retailprice AS DECIMAL(30,8)) * CASE WHEN p_partkey % 2 = 0 THEN 10000 ELSE 1 END) AS BIGINT) AS n,
         CAST(p_size AS BIGINT) AS declared FROM part""",
)
def compact_count(t):
    price = F.col("p_retailprice").cast("string")
    shown = F.when(F.col("p_partkey") % 2 == 0, F.concat(price, F.lit(" 万"))).otherwise(price)
    header = F.concat(F.lit("全部回复 ("), "p_size", F.lit(")"))
    return t.part.select(
        "p_partkey", tx.compact_count(shown).alias("n"), tx.declared_count(header).alias("declared")
    )


def _page_urls(t):
    page = F.col("page_id")
    url = (
        F.when(page % 5 == 0, F.col("url"))
        .when(page % 5 == 1, F.concat(F.lit(f"https://{HOST}/p/"), page, F.lit("?pn="), page % 7))
        .when(page % 5 == 2, F.concat(F.lit(f"http://{HOST}/p/"), page))
        .when(page % 5 == 3, F.concat(F.lit(f"https://{HOST}/p/"), page, F.lit("/more#x")))
        .otherwise(F.concat(F.lit(f"https://www.{HOST}/p/"), page))
    )
    return t.pages.select("page_id", url.alias("url"))


@query(
    "thread_id_from_url",
    """SELECT page_id, CASE WHEN page_id % 5 IN (1, 3) THEN CAST(page_id AS VARCHAR) END AS thread_id,
         CASE WHEN page_id % 5 IN (1, 3) THEN concat('https://forum.example.org/p/', page_id) END AS canonical_url
       FROM pages""",
)
def thread_id_from_url(t):
    return _page_urls(t).select(
        "page_id",
        urls.thread_id_from_url(F.col("url"), HOST).alias("thread_id"),
        urls.canonical_thread_url(F.col("url"), HOST).alias("canonical_url"),
    )


@query(
    "classify_url",
    """SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'unknown' WHEN page_id % 5 IN (1, 3) AND page_id % 2 = 1 THEN 'same'
         ELSE 'different' END AS kind FROM pages""",
)
def classify_url(t):
    page = F.col("page_id")
    own = F.when(page % 2 == 1, page.cast("string")).otherwise(F.lit("0x"))
    url = F.when(page % 11 != 0, F.col("url"))
    return _page_urls(t).select(
        "page_id", urls.classify_url(own, F.lit(None).cast("string"), url, HOST).alias("kind")
    )


@query(
    "page_number_from_url",
    """SELECT page_id, CASE WHEN n > 0 THEN n ELSE 1 END AS page_number FROM (
         SELECT page_id, CAST(nullif(regexp_extract(url, '[?&]page=([0-9]+)(?:&|#|$)', 1), '') AS INTEGER) AS n FROM pages)""",
)
def page_number_from_url(t):
    return t.pages.select("page_id", urls.page_number_from_url(F.col("url"), "page").alias("page_number"))


@query(
    "max_known_page",
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN greatest(CAST(page_id % 9 AS INTEGER), p_own, 4) ELSE greatest(p_own, 4) END AS max_page,
         false AS single_page FROM (SELECT page_id, greatest(CAST(page_id % 4 AS INTEGER), 1) AS p_own FROM pages)""",
)
def max_known_page(t):
    page = F.col("page_id")

    def link(thread, n):
        return F.concat(F.lit(f"https://{HOST}/p/"), thread, F.lit("?pn="), n)

    links = F.array(link(page, F.lit(4)), link(page + 1, F.lit(99)), F.concat(F.lit("/p/"), page))
    rows = t.pages.select(
        "page_id",
        link(page, page % 4).alias("url"),
        links.alias("links"),
        F.when(page % 3 == 0, (page % 9).cast("int")).alias("total"),
    )
    highest = urls.max_known_page(F.col("url"), F.col("links"), F.col("total"), HOST)
    return rows.select(
        "page_id",
        highest.alias("max_page"),
        urls.single_page_proven(highest, F.col("total"), F.lit("共 1 页")).alias("single_page"),
    )


@query(
    "removal_notice",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '该楼层已被删除' WHEN 1 THEN '删除提示' WHEN 2 THEN '内容因违规被折叠' ELSE '' END AS notice
       FROM documents""",
)
def removal_notice(t):
    kind = F.col("doc_id") % 4
    added = (
        F.when(kind == 0, F.lit(" 该楼层已被删除 "))
        .when(kind == 1, F.lit("[删除提示]"))
        .when(kind == 2, F.lit(" 内容因违规被折叠"))
        .otherwise(F.lit(""))
    )
    return t.documents.select("doc_id", tx.removal_notice(F.concat("text", added)).alias("notice"))


@query(
    "text_availability",
    f"""SELECT conv_id, turn, CASE turn % 5 WHEN 1 THEN 'no_text' WHEN 2 THEN 'image_only' WHEN 3 THEN 'mask_only'
          ELSE CASE WHEN length({sql_trim('text')}) > 240 THEN 'preview' ELSE 'full' END END AS availability,
          CASE turn % 5 WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN '※*⋯ …·'
          ELSE CASE WHEN length({sql_trim('text')}) > 240 THEN concat(substring({sql_trim('text')}, 1, 240), '…') ELSE {sql_trim('text')} END END AS preview
        FROM conversations""",
)
def text_availability(t):
    kind = F.col("turn") % 5
    content = (
        F.when(kind.isin(1, 2), F.lit(" \n"))
        .when(kind == 3, F.lit(" ※*⋯ …· "))
        .otherwise(F.col("text"))
    )
    images = F.when(kind == 2, F.lit(3)).otherwise(F.lit(0))
    return t.conversations.select(
        "conv_id", "turn",
        tx.text_availability(content, images).alias("availability"),
        tx.text_preview(content).alias("preview"),
    )


@query(
    "unexpanded_estimate",
    """SELECT p_partkey, CAST(greatest(0, p_size - 5, CASE p_partkey % 4 WHEN 0 THEN p_size + 2 WHEN 1 THEN p_size * 2 - 5 WHEN 2 THEN 1 ELSE 0 END) AS BIGINT) AS unexpanded FROM part""",
)
def unexpanded_estimate(t):
    size, kind = F.col("p_size"), F.col("p_partkey") % 4
    control = (
        F.when(kind == 0, F.concat(F.lit("还有 "), size + 2, F.lit(" 条回复")))
        .when(kind == 1, F.concat(F.lit("查看全部"), size * 2, F.lit("条")))
        .when(kind == 2, F.lit("展开更多"))
        .otherwise(F.lit("收起更多"))
    )
    return t.part.select(
        "p_partkey", tx.unexpanded_estimate(size, F.lit(5), F.array(control)).alias("unexpanded")
    )


@query(
    "safe_numbers",
    """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN l_partkey WHEN 1 THEN -l_partkey END AS as_int,
         CASE WHEN l_linenumber % 3 = 0 THEN l_partkey WHEN l_linenumber % 3 = 1 AND l_partkey = 0 THEN 0 ELSE 7 END AS as_count,
         CASE l_linenumber % 3 WHEN 0 THEN CAST(l_partkey AS VARCHAR) END AS reply_id FROM lineitem""",
)
def safe_numbers(t):
    kind = F.col("l_linenumber") % 3
    raw = (
        F.when(kind == 0, F.concat(F.lit(" "), "l_partkey", F.lit(" ")))
        .when(kind == 1, F.concat(F.lit("-"), "l_partkey"))
        .otherwise(F.concat("l_partkey", F.lit("12345678901234567x")))
    )
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", tx.safe_int(raw).alias("as_int"),
        tx.safe_count(raw, 7).alias("as_count"), tx.valid_reply_id(raw).alias("reply_id"),
    )


@query(
    "parse_confidence",
    """SELECT l_orderkey, l_linenumber, round(CASE l_linenumber % 4 WHEN 0 THEN l_quantity / 100
         WHEN 1 THEN CASE WHEN l_quantity BETWEEN 70 AND 100 THEN l_quantity / 100 ELSE l_quantity END
         WHEN 2 THEN (l_quantity + 50) / CASE WHEN l_quantity + 50 >= 70 THEN 100 ELSE 1 END END, 6) AS confidence FROM lineitem""",
)
def parse_confidence(t):
    kind, amount = F.col("l_linenumber") % 4, F.col("l_quantity").cast("int")
    raw = (
        F.when(kind == 0, F.concat(amount.cast("string"), F.lit(" %")))
        .when(kind == 1, F.concat(F.lit("+"), amount.cast("string"), F.lit(".0e0")))
        .when(kind == 2, (amount + 50).cast("string"))
        .otherwise(F.lit("high"))
    )
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(tx.parse_confidence(raw), 6).alias("confidence"))


@query(
    "excerpt",
    f"""SELECT doc_id, CASE WHEN length({sql_squeeze('text')}) > 160 THEN concat(substring({sql_squeeze('text')}, 1, 157), '…')
          ELSE {sql_squeeze('text')} END AS excerpt,
          CASE WHEN length({sql_trim('text')}) > 240 THEN concat(substring({sql_trim('text')}, 1, 240), '…') ELSE {sql_trim('text')} END AS evidence FROM documents""",
)
def excerpt(t):
    return t.documents.select(
        "doc_id", tx.excerpt(F.col("text")).alias("excerpt"), tx.reply_excerpt(F.col("text")).alias("evidence")
    )


@query(
    "reply_label",
    """SELECT conv_id, turn, concat('第 ', CASE WHEN turn % 4 = 3 THEN concat(turn // 5 + 1, ' 页楼层号缺失的', CASE WHEN turn % 3 = 2 THEN '楼中楼' ELSE '回复' END)
         ELSE concat(turn + 1, ' 楼', CASE WHEN turn % 3 = 2 THEN '的楼中楼' ELSE '' END) END, '（',
         CASE WHEN role = 'system' THEN '用户名不可用' ELSE concat('用户“', role, '”') END, '）') AS label,
         CASE WHEN turn % 3 = 2 THEN CASE WHEN turn % 4 = 3 THEN '楼中楼（父楼未知）' ELSE concat('第 ', turn + 1, ' 楼的楼中楼') END
              WHEN turn % 4 = 3 THEN '主回复（楼层未知）' WHEN turn = 0 THEN '主楼（1楼）' ELSE concat('第 ', turn + 1, ' 楼') END AS short_label
       FROM conversations""",
)
def reply_label(t):
    turn = F.col("turn")
    floor = F.when(turn % 4 != 3, turn + 1)
    author = F.when(F.col("role") == "system", F.lit("  ")).otherwise(F.col("role"))
    nested = turn % 3 == 2
    return t.conversations.select(
        "conv_id", "turn",
        tx.reply_label(floor, nested, F.floor(turn / 5) + 1, author).alias("label"),
        tx.floor_label(floor, nested).alias("short_label"),
    )


# RE2 has no look-around: boundary characters are captured and put back.
_SQL_REDACT = "text"
for _pattern, _replacement in [
    (f"(?i)(?:q[{WS}]*q|扣扣|企鹅(?:号)?)(?:[{WS}]*(?:号|号码|id))?[{WS}]*[:：]?[{WS}]*[1-9][0-9]{{4,11}}", "[QQ号]"),
    (f"(?i)(?:微信|微信号|v[{WS}]*x|v信|w[{WS}]*x|wechat)(?:[{WS}]*(?:号|号码|id))?[{WS}]*[:：]?[{WS}]*[a-z][-_a-z0-9]{{5,19}}", "[微信号]"),
    ("(?i)[a-z0-9.!#$%&''*+/=?^_`{|}~-]+@[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)+", "[邮箱]"),
    ("(?i)(^|[^0-9a-z])(?:[0-9]{17}[0-9x]|[0-9]{15})($|[^0-9a-z])", "\\1[身份证]\\2"),
    (f"(^|[^0-9])(?:(?:\\+|00)86[{WS}-]?)?1[3-9][0-9][{WS}-]?[0-9]{{4}}[{WS}-]?[0-9]{{4}}($|[^0-9])", "\\1[手机号]\\2"),
    (f"(^|[^0-9])(?:\\+?86[{WS}-]?)?0[0-9]{{2,3}}[{WS}-]?[0-9]{{7,8}}($|[^0-9])", "\\1[电话]\\2"),
]:
    _SQL_REDACT = f"regexp_replace({_SQL_REDACT}, '{_pattern}', '{_replacement}', 'g')"


@query("redact_sensitive", f"""SELECT doc_id, md5(r) AS redacted_md5, r <> text AS changed, false AS leaks
       FROM (SELECT doc_id, text, {_SQL_REDACT} AS r FROM documents)""")
def redact_sensitive(t):
    rows = t.documents.select("doc_id", "text", privacy.redact_sensitive(F.col("text")).alias("r"))
    return rows.select(
        "doc_id", F.md5("r").alias("redacted_md5"), (F.col("r") != F.col("text")).alias("changed"),
        privacy.contains_sensitive(F.col("r")).alias("leaks"),
    )


@query(
    "estimate_tokens",
    """SELECT doc_id, CAST(length(text) - a + w + ceil(a / 3) AS BIGINT) AS tokens, CAST(octet_length(encode(text)) AS BIGINT) AS bytes
       FROM (SELECT doc_id, text, length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS a,
         length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS w FROM documents)""",
)
def estimate_tokens(t):
    return t.documents.select(
        "doc_id", tx.estimate_tokens(F.col("text")).alias("tokens"),
        F.octet_length("text").cast("bigint").alias("bytes"),
    )


@query(
    "normalize_enum",
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'personal_attack' WHEN 1 THEN 'privacy' WHEN 2 THEN 'spam' WHEN 3 THEN 'provocation' WHEN 4 THEN 'harassment' END AS type,
         CASE doc_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'critical' WHEN 2 THEN 'high' END AS severity,
         CASE WHEN doc_id % 3 = 0 THEN 'deep' ELSE 'fast' END AS mode FROM documents""",
)
def normalize_enum(t):
    def pick(n, words):
        return F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("doc_id") % n + 1).cast("int"))

    kind = pick(6, [" Personal-Attack", "Ｐｒｉｖａｃｙ　leak", "FLOODING", "挑衅 / 引战", "挂人", "unclear"])
    level = pick(4, ["Minor", "极高 风险", "SEVERE", "?"])
    mode = pick(3, ["deep", "Deep", "fast"])
    return t.documents.select(
        "doc_id", tx.enum_alias(kind, fv.TYPE_ALIASES).alias("type"),
        tx.enum_alias(level, fv.SEVERITY_ALIASES).alias("severity"), tx.normalize_mode(mode).alias("mode"),
    )


@query(
    "truncate_safe",
    f"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat(repeat('甲', 30), '…') WHEN 1 THEN concat(repeat('甲', 27), 'CPU1…')
          ELSE CASE WHEN length({sql_trim('text')}) <= 32 THEN {sql_trim('text')} ELSE concat(substring({sql_trim('text')}, 1, 31), '…') END END AS cut
        FROM documents""",
)
def truncate_safe(t):
    kind = F.col("doc_id") % 3
    long = F.repeat(F.lit("甲"), 30)
    value = (
        F.when(kind == 0, F.concat(long, F.lit("P1234 后文"), "text"))
        .when(kind == 1, F.concat(F.repeat(F.lit("甲"), 27), F.lit("CPU1"), F.lit("23456 "), "text"))
        .otherwise(F.col("text"))
    )
    return t.documents.select("doc_id", tx.truncate_safe(value, 32).alias("cut"))


@query(
    "sanitize_prose",
    """SELECT doc_id, concat('相关回复 与 相关用户 违反 所选规范；CPU31 正常。', CASE WHEN doc_id % 2 = 0 THEN '第二句！' ELSE '第二句没有完' END) AS prose FROM documents""",
)
def sanitize_prose(t):
    value = F.concat(
        F.lit("P"), "doc_id", F.lit(" 与 ｕ３ 违反 R 03．1；CPU31 正常。"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("第二句！第三句 P9。")).otherwise(F.lit("第二句没有完")),
    )
    return t.documents.select("doc_id", tx.sanitize_prose(value, 160, max_sentences=2).alias("prose"))


@query(
    "segment_narrative",
    """SELECT conv_id, turn, line_no, line FROM (
         SELECT conv_id, turn, unnest(['第三阶段：', concat('甲说', turn, '。'), '乙反驳；', '第 3 楼补充、', '第 4 楼附和', '理由：', '1.重复', '2)离题']) AS line,
           unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS line_no FROM conversations)""",
)
def segment_narrative(t):
    value = F.concat(
        F.lit(" 第三阶段： 甲说"), "turn", F.lit("。乙反驳； 第 3 楼补充、 第 4 楼附和\r\n理由： 1.重复 2)离题\n\n")
    )
    rows = t.conversations.select("conv_id", "turn", F.posexplode(tx.segment_narrative(value)))
    return rows.select("conv_id", "turn", (F.col("pos") + 1).alias("line_no"), F.col("col").alias("line"))


@query(
    "normalize_endpoint",
    """SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '') AS endpoint,
         CASE WHEN page_id % 4 = 0 THEN 'deepseek' ELSE 'alibaba' END AS provider,
         concat(CASE WHEN url LIKE 'http://%' THEN 'plain_http|' ELSE '' END, CASE WHEN url LIKE '%#%' THEN 'fragment|' ELSE '' END) AS violations
       FROM pages""",
)
def normalize_endpoint(t):
    named = F.when(F.col("page_id") % 4 == 0, F.lit("https://API.deepseek.com/v1")).otherwise(F.col("url"))
    bad = urls.endpoint_violations(F.col("url"), HOST)
    return t.pages.select(
        "page_id", urls.normalize_endpoint(F.col("url")).alias("endpoint"),
        urls.normalize_provider(F.lit("?"), named).alias("provider"),
        F.array_join(F.transform(bad, lambda v: F.concat(v, F.lit("|"))), "").alias("violations"),
    )
