"""Queries over labelled documents, the rule library and ledger tables."""

import uuid

from pyspark.sql import functions as F

from threadspark.operators import detect, evaluate, rule_search
from threadspark.plans.registry import query
from threadspark.plans.thread_queries import _KEY
from threadspark.rule_library import RULE_LIBRARY
from threadspark.session import shared_folder
from threadspark.sources import cases, durable, snapshots
from threadspark.sources.rules import rules_table

LEXICON = [("personal_attack", "(?:the|der|el) [a-z]+heed", "sample", 45), ("harassment", "leon|schein", "sample", 50)]


def _cases(t):
    """Every labelled document as a case; its lines are replies of one author per language."""
    docs = t.documents.join(t.labels, "doc_id")
    line = F.struct(
        F.lit(None).cast("string").alias("id"), F.col("lang").alias("author"), F.lit(None).cast("string").alias("content"),
        F.lit(None).cast("string").alias("parentId"), F.lit(None).cast("string").alias("time"), F.lit(None).cast("int").alias("floor"),
    )
    lines = F.transform(F.split("text", "\n", -1), lambda s, i: line.withField("content", s).withField("id", F.concat_ws("-", "doc_id", i)))
    case = F.struct(
        F.col("doc_id").cast("string").alias("id"), F.when(F.col("toxic") == 1, "severe_conflict").otherwise("normal_discussion").alias("label"), lines.alias("replies")
    )
    corpus = docs.select(F.lit("1.0").alias("schemaVersion"), F.array(case).alias("cases"))
    return cases.explode_cases(corpus)


@query("read_cases", """SELECT CAST(doc_id AS VARCHAR) AS thread_id, CASE WHEN toxic = 1 THEN 'severe_conflict' ELSE 'normal_discussion' END AS label,
   CAST(len(string_split(text, chr(10))) AS INTEGER) AS reply_count FROM documents JOIN labels USING (doc_id)""")
def read_cases(t):
    return _cases(t)[0].drop("schema_version")


@query("validate_cases", """SELECT CAST(doc_id AS VARCHAR) AS thread_id, 'label' AS code, 1 AS count FROM documents JOIN labels USING (doc_id) WHERE toxic = 1
   UNION ALL SELECT CAST(doc_id AS VARCHAR), 'schema_version', 1 FROM documents JOIN labels USING (doc_id) WHERE doc_id % 2 = 0""")
def validate_cases(t):
    found, replies = _cases(t)
    spoiled = found.withColumns(
        {"label": F.regexp_replace("label", "severe_conflict", "bad"), "schema_version": F.when(F.col("thread_id").cast("bigint") % 2 == 0, "2").otherwise("1.0")}
    )
    return cases.case_violations(spoiled, replies)


@query("evaluate_corpus", f"""WITH l AS (SELECT doc_id, toxic, lang, unnest(string_split(text, chr(10))) AS content FROM documents JOIN labels USING (doc_id)),
   s AS (SELECT doc_id, toxic, CASE WHEN regexp_matches(content, '(?i)(?:the|der|el) [a-z]+heed') THEN 45 ELSE 0 END AS pa, CASE WHEN regexp_matches(content, '(?i)leon|schein') THEN 50 ELSE 0 END AS ha, {_KEY} AS k FROM l),
   dup AS (SELECT doc_id, k FROM s WHERE k <> '' GROUP BY 1, 2 HAVING count(*) >= 3),
   c AS (SELECT doc_id, toxic, (max(pa) > 0)::INT + (max(ha) > 0)::INT + (doc_id IN (SELECT doc_id FROM dup))::INT AS n FROM s GROUP BY 1, 2)
   SELECT count(*) AS cases, count(*) FILTER (toxic = 1) AS severe_total, count(*) FILTER (toxic = 1 AND n > 0) AS severe_found, count(*) FILTER (toxic = 0) AS normal_total,
     count(*) FILTER (toxic = 0 AND n > 0) AS normal_flagged, CAST(quantile_disc(n, 0.95) AS BIGINT) AS p95_findings,
     round(count(*) FILTER (toxic = 1 AND n > 0) / count(*) FILTER (toxic = 1), 4) AS severe_recall, round(count(*) FILTER (toxic = 0 AND n > 0) / count(*) FILTER (toxic = 0), 4) AS normal_false_positive_rate,
     count(*) >= 30 AND count(*) FILTER (toxic = 1 AND n > 0) / count(*) FILTER (toxic = 1) >= 0.8 AS passed FROM c""")
def evaluate_corpus(t):
    found, replies = _cases(t)
    findings = detect.analyze_replies(replies, rules_table(t.spark), lexicon=[*LEXICON, ("provocation", "$^never", "none", 1)])
    return evaluate.evaluate_corpus(found, findings)


# --- the rule library as SQL -----------------------------------------------------------------

_RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(
    f"({n}, '{key}.{i:02d}', '{key}', '{title}', '{text}', {len(texts)})"
    for n, (key, title, i, text, texts) in enumerate(
        (key, title, i, text, texts) for key, (title, texts) in RULE_LIBRARY.items() for i, text in enumerate(texts, 1)
    )
) + ") r(n, rule_id, category_id, title, body, total))"
WORDS = ["", "辱骂", "r03", "刷屏", " 剧透 ", "nothing"]
_ASKED = "asked AS (SELECT doc_id, ['', '辱骂', 'r03', '刷屏', '剧透', 'nothing'][CAST(doc_id % 6 + 1 AS INTEGER)] AS q, CASE WHEN doc_id % 4 = 0 THEN 'R0' || (doc_id % 9 + 1) ELSE 'all' END AS c FROM documents)"
_MATCHED = """matched AS (SELECT doc_id AS query_id, r.*, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS match_no FROM asked JOIN rules r
   ON CASE WHEN q = '' THEN c = 'all' OR c = category_id ELSE contains(lower(rule_id), q) OR contains(title, q) OR contains(body, q) END)"""


def _asked(t):
    word = F.element_at(F.array(*[F.lit(w) for w in WORDS]), (F.col("doc_id") % 6 + 1).cast("int"))
    category = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("R0"), F.col("doc_id") % 9 + 1)).otherwise("all")
    return t.documents.select(F.col("doc_id").alias("query_id"), word.alias("query"), category.alias("category"))


@query("search_rules", f"WITH {_RULES}, {_ASKED}, {_MATCHED} SELECT query_id, CAST(match_no AS INTEGER) AS match_no, rule_id FROM matched")
def search_rules(t):
    return rule_search.search_rules(_asked(t)).select("query_id", "match_no", "rule_id")


@query("rule_counts", f"""WITH {_RULES}, {_ASKED}, {_MATCHED} SELECT query_id, category_id, count(*) FILTER (match_no <= 20) AS shown, count(*) AS matched, CAST(max(total) AS BIGINT) AS total
   FROM matched GROUP BY query_id, category_id HAVING count(*) FILTER (match_no <= 20) > 0""")
def rule_counts(t):
    return rule_search.rule_counts(rule_search.search_rules(_asked(t)), 20)


@query("reply_mentions_rule", f"""WITH {_RULES} SELECT conv_id, turn, md5(concat('见 ', '“', rtrim(body, '。！？；'), '”这一规范', '，XR01.01 与 当前理由库中不存在对应条目的规范（模型引用无效）: ', text)) AS shown_md5
   FROM conversations JOIN rules ON rule_id = concat('R01.0', turn % 6 + 1)""")
def reply_mentions_rule(t):
    value = F.concat(F.lit("见 r01.0"), F.col("turn") % 6 + 1, F.lit("，XR01.01 与 R99.99: "), "text")
    return t.conversations.select("conv_id", "turn", F.md5(rule_search.reply_mentions_rule(value)).alias("shown_md5"))


# --- durable tables --------------------------------------------------------------------------


@query("quarantine", "SELECT o_orderkey, o_totalprice > 1000 AND o_orderstatus <> 'P' AS kept FROM orders")
def quarantine(t):
    good, bad = durable.load_valid(t.orders, (F.col("o_totalprice") > 1000) & (F.col("o_orderstatus") != "P"))
    return good.select("o_orderkey", F.lit(True).alias("kept")).unionByName(bad.select("o_orderkey", F.lit(False).alias("kept")))


@query("upsert", """SELECT o_custkey, arg_max(o_orderkey, (epoch_us(o_orderdate) // 1000, o_orderkey % 2, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1""")
def upsert(t):
    rows = t.orders.select("o_custkey", "o_orderkey", F.unix_millis("o_orderdate").alias("at"))
    changes = rows.filter(F.col("o_orderkey") % 2 == 1)
    order = F.struct("at", F.col("o_orderkey") % 2, F.col("o_orderkey"))
    return durable.upserted(rows.filter(F.col("o_orderkey") % 2 == 0), changes, ["o_custkey"], order).select("o_custkey", "o_orderkey")


@query("delete_history", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def delete_history(t):
    gone = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return durable.without_keys(t.orders, gone, ["o_custkey"]).select("o_orderkey")


@query("snapshot_versions", """WITH v AS (SELECT 1 AS version, * FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT 2, * FROM orders)
   SELECT version, o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM v GROUP BY 1, 2""")
def snapshot_versions(t):
    """Two upserts of one table; the reader of the first version is not disturbed by the second."""
    rows, path = t.orders.select("o_custkey", "o_orderkey", "o_orderpriority"), f"{shared_folder(t.spark)}/table-{uuid.uuid4().hex}"
    key, order, late = ["o_custkey"], F.col("o_orderkey"), F.col("o_orderkey") % 3 == 0
    snapshots.upsert_table(t.spark, path, rows.filter(~late), key, order)
    first = snapshots.read_table(t.spark, path)
    snapshots.upsert_table(t.spark, path, rows.filter(late), key, order)
    second = snapshots.read_table(t.spark, path)
    return first.select(F.lit(1).alias("version"), "*").unionByName(second.select(F.lit(2).alias("version"), "*"))
