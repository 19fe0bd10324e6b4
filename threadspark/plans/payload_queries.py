"""Queries over redaction and payload building."""

from pyspark.sql import functions as F

from threadspark.functions import sql_surface
from threadspark.functions.privacy import contains_sensitive, redact_sensitive
from threadspark.operators import payloads
from threadspark.plans.registry import DISCUSSION, WS, query
from threadspark.plans.text_queries import _SQL_REDACT
from threadspark.plans.thread_queries import _EDGES, _NAMES, _UNDIRECTED
from threadspark.rule_library import RULE_LIBRARY
from threadspark.sources.rules import rules_table

_ALIASES = """aliases AS (SELECT thread_id, author_name AS name, concat('U', row_number() OVER (PARTITION BY thread_id ORDER BY min(pos))) AS alias
  FROM discussion GROUP BY thread_id, author_name)"""
_NAMED = "s"
for _name in ["user0", "user1", "assistant0", "assistant1", "system0", "system1"]:
    _NAMED = f"replace({_NAMED}, '{_name}', coalesce(chr(1) || m['{_name}'] || chr(2), '{_name}'))"
_REDACTED = f"""book AS (SELECT thread_id, map(list(name), list(alias)) AS m FROM aliases GROUP BY thread_id),
redacted AS (SELECT d.*, a.alias AS author_alias, replace(replace(regexp_replace(regexp_replace(named, '@[\\p{{L}}\\p{{N}}_.\\-·]{{1,40}}', '@[用户名]', 'g'),
    '((?:回复|回覆)[{WS}]*@?)[\\p{{L}}\\p{{N}}_.\\-·]{{1,40}}([{WS}]*[:：])', '\\1[用户名]\\2', 'g'), chr(1), ''), chr(2), '') AS redacted
  FROM (SELECT *, {_NAMED} AS named FROM (SELECT x.*, book.m, {_SQL_REDACT.replace('text', 'content', 1)} AS s FROM discussion x JOIN book USING (thread_id))) d
  JOIN aliases a ON a.thread_id = d.thread_id AND a.name = d.author_name)"""


@query("author_alias", f"WITH {DISCUSSION}, {_ALIASES} SELECT * FROM aliases")
def author_alias(t):
    return payloads.author_aliases(t.discussion)


_REDACT_NAMES = f"WITH {DISCUSSION}, {_ALIASES}, {_REDACTED} SELECT thread_id, id, author_alias, md5(redacted) AS redacted_md5 FROM redacted"


@query("redact_names", _REDACT_NAMES)
def redact_names(t):
    rows = payloads.redacted_replies(t.discussion)
    return rows.select("thread_id", "id", "author_alias", F.md5("redacted").alias("redacted_md5"))


@query("redact_names_by_join", _REDACT_NAMES)
def redact_names_by_join(t):
    rows = payloads.redacted_replies(t.discussion)
    return rows.select("thread_id", "id", "author_alias", F.md5("redacted").alias("redacted_md5"))


@query("sql_functions", """SELECT doc_id, md5(text) AS text_md5, CAST(length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))
   + ceil(length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / 3) AS BIGINT) AS tokens, true AS same FROM documents""")
def sql_functions(t):
    """The SQL functions over whole texts, next to the columns they stand for."""
    sql_surface.register_functions(t.spark)
    rows = t.documents.select("doc_id", "text")
    by_sql = rows.selectExpr("doc_id", "text", "md5(text) AS text_md5", "estimate_tokens(text) AS tokens", "redact_sensitive(text) AS by_sql", "contains_sensitive(text) AS held")
    same = (F.col("by_sql") == redact_sensitive(F.col("text"))) & (F.col("held") == contains_sensitive(F.col("text")))
    return by_sql.select("doc_id", "text_md5", "tokens", same.alias("same"))


@query("leak_guard", f"""WITH {DISCUSSION}, {_ALIASES}, {_REDACTED} SELECT thread_id,
   CAST(count(*) FILTER (id LIKE '%3' AND regexp_matches(redacted, author_alias)) AS BIGINT) AS alias_uses, 0 AS leaking,
   CAST((SELECT count(*) FROM discussion d WHERE d.thread_id = r.thread_id AND EXISTS (SELECT 1 FROM aliases a
     WHERE a.thread_id = d.thread_id AND contains(d.content, a.name))) AS BIGINT) AS raw_leaking
   FROM redacted r GROUP BY thread_id""")
def leak_guard(t):
    names = payloads.author_aliases(t.discussion)
    clean = payloads.redacted_replies(t.discussion)
    uses = clean.groupBy("thread_id").agg(
        F.count_if(F.col("id").endswith("3") & F.contains("redacted", "author_alias")).alias("alias_uses")
    )
    raw = payloads.leak_guard(t.discussion.select("thread_id", "id", F.col("content").alias("redacted")), names)
    after = payloads.leak_guard(clean, names)
    return uses.join(after, "thread_id").join(raw.withColumnRenamed("leaking", "raw_leaking"), "thread_id")


@query("build_thread_payloads", f"""WITH {DISCUSSION}, {_NAMES}, {_EDGES}, {_UNDIRECTED}, {_ALIASES}, {_REDACTED},
   rel AS (SELECT e.thread_id, e.src AS id, string_agg(concat('P', d.pos), ',' ORDER BY d.pos) AS related FROM edges e
     JOIN discussion d ON d.thread_id = e.thread_id AND d.id = e.dst GROUP BY ALL),
   rows AS (SELECT r.*, coalesce(rel.related, '') AS related,
     CAST(greatest(0, round((r.timestamp_ms - min(r.timestamp_ms) OVER (PARTITION BY r.thread_id)) / 60000.0)) AS BIGINT) AS minute
     FROM redacted r LEFT JOIN rel USING (thread_id, id))
   SELECT thread_id, 'ok' AS status, count(*) AS reply_count, 112 AS rules, concat('thread ', thread_id) AS title,
     md5(string_agg(concat_ws('|', concat('P', pos), related, author_alias, coalesce(CAST(minute AS VARCHAR), '-'), redacted), chr(10) ORDER BY pos)) AS replies_md5,
     CASE WHEN sum(image_count) > 0 THEN 3 ELSE 2 END AS limitations
   FROM rows GROUP BY thread_id""")
def build_thread_payloads(t):
    titles = t.discussion.select("thread_id").distinct().withColumn("title", F.concat(F.lit("thread "), "thread_id"))
    built = payloads.build_thread_payloads(t.discussion, titles)
    schema = (
        "threadTitle string, replies array<struct<id string, floor int, parentReplyId string, relatedReplyIds array<string>,"
        "authorAlias string, minuteOffset bigint, content string, isNested boolean>>, rules array<struct<id string>>, limitations array<string>"
    )
    p = F.from_json("payload", schema)
    line = F.transform(
        p["replies"],
        lambda r: F.concat_ws(
            "|", r["id"], F.array_join(r["relatedReplyIds"], ","), r["authorAlias"],
            F.coalesce(r["minuteOffset"].cast("string"), F.lit("-")), r["content"],
        ),
    )
    return built.select(
        "thread_id", "status", "reply_count", F.size(p["rules"]).alias("rules"), p["threadTitle"].alias("title"),
        F.md5(F.array_join(line, "\n")).alias("replies_md5"), F.size(p["limitations"]).alias("limitations"),
    )


def _finding_rows(t):
    chosen = t.discussion.filter(F.col("content").contains("你有病")).select(
        F.lit("s").alias("selection_id"), "thread_id", "id", F.col("pos").alias("ordinal")
    )
    return payloads.build_finding_payloads(t.discussion, chosen, radius=1, max_replies=100)


_FINDING = f"""WITH {DISCUSSION}, chosen AS (SELECT * FROM discussion WHERE regexp_matches(content, '你有病')),
  rows AS (SELECT d.*, d.id IN (SELECT id FROM chosen) AS is_selected FROM discussion d WHERE EXISTS (SELECT 1 FROM chosen c
    WHERE c.thread_id = d.thread_id AND (abs(c.pos - d.pos) <= 1 OR c.parent_reply_id = d.id)))"""


@query("build_finding_payloads", f"""{_FINDING}, al AS (SELECT thread_id, author_name, concat('U', row_number() OVER (PARTITION BY thread_id ORDER BY min(pos))) AS alias
    FROM rows GROUP BY thread_id, author_name)
  SELECT thread_id, id, is_selected, alias AS author_alias FROM rows JOIN al USING (thread_id, author_name)""")
def build_finding_payloads(t):
    return _finding_rows(t).select("thread_id", "id", "is_selected", "author_alias")


@query("preflight_summary", f"""{_FINDING} SELECT thread_id, count(*) AS reply_count, CAST(count(*) FILTER (is_selected) AS BIGINT) AS selected_reply_count,
   CAST(sum(image_count) AS BIGINT) AS omitted_image_count, 'api.example.com' AS hostname FROM rows GROUP BY thread_id""")
def preflight_summary(t):
    return payloads.preflight_summary(_finding_rows(t), F.lit("https://api.example.com/v1")).drop("selection_id")


_RULE_ROWS = ", ".join(f"('{key}.{i:02d}', {len(text)})" for key, (_, texts) in RULE_LIBRARY.items() for i, text in enumerate(texts, 1))


@query("allowed_reasons", f"""WITH {DISCUSSION}, c AS (SELECT thread_id, printf('R%02d.%02d', CAST(pos * length(content) % 18 AS INTEGER), CAST(length(content) % 11 AS INTEGER)) AS reason_id, pos FROM discussion),
   lib(reason_id, n) AS (VALUES {_RULE_ROWS}), a AS (SELECT thread_id, reason_id, min(pos) AS rank, n FROM c JOIN lib USING (reason_id) GROUP BY ALL)
   SELECT d.thread_id AS selection_id, count(*) AS reply_count, coalesce((SELECT string_agg(concat(reason_id, ':', n), ',' ORDER BY rank) FROM a WHERE a.thread_id = d.thread_id), '') AS reasons
   FROM discussion d GROUP BY d.thread_id""")
def allowed_reasons(t):
    rows = t.discussion.withColumn("selection_id", F.col("thread_id"))
    size = F.length("content")
    code = F.format_string("R%02d.%02d", (F.col("pos") * size % 18).cast("int"), (size % 11).cast("int"))
    reasons = payloads.allowed_reasons(rows.select("selection_id", code.alias("reason_id"), F.col("pos").alias("rank")), rules_table(t.spark))
    found = payloads.finding_requests(rows, reasons)
    listed = F.array_join(F.transform("allowed_reasons", lambda r: F.concat(r["id"], F.lit(":"), F.length(r["text"]))), ",")
    return found.select("selection_id", "reply_count", listed.alias("reasons"))
