"""Names of the runnable queries, each with its optional SQL counterpart."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadspark.sources.tables import Tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(spark, folder))

        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return build

    return add


def all_queries():
    return dict(_QUERIES)


def all_sql():
    return dict(_SQL)


# Derived tables as SQL, the counterpart of ``sources.tables``.
REPLIES = """replies AS (
  SELECT CAST(conv_id AS VARCHAR) AS thread_id, turn + 1 AS pos, concat(conv_id, '-', turn) AS id,
         turn + 1 AS floor,
         CASE WHEN turn % 3 = 2 THEN concat(conv_id, '-', turn - 1) END AS parent_reply_id,
         role AS author_name, CAST(NULL AS BIGINT) AS timestamp_ms, text AS content,
         (turn % 3 = 2) AS is_nested, turn % 4 AS image_count, turn // 5 + 1 AS source_page
  FROM conversations)"""

DISCUSSION = (
    REPLIES
    + """, discussion AS (
  SELECT thread_id, pos, id, floor, parent_reply_id,
         concat(author_name, (pos - 1) % 2) AS author_name,
         CASE WHEN (pos - 1) % 11 <> 10
              THEN 1704067200000 + CAST(thread_id AS BIGINT) * 86400000 + (pos - 1) * 90000 END AS timestamp_ms,
         CASE WHEN CAST(thread_id AS BIGINT) % 6 = 2 AND (pos - 1) % 2 = 0 THEN '同样的内容 再发一次！'
         ELSE concat(content,
           CASE WHEN (pos - 1) % 7 = 3 THEN concat(' 回复 @user', (pos - 1) % 2, '：收到') ELSE '' END,
           CASE WHEN (pos - 1) % 5 = 4 THEN concat(' 见第', pos - 3, '楼') ELSE '' END,
           CASE WHEN (pos - 1) % 6 = 5 THEN ' 楼上说得对' ELSE '' END,
           CASE WHEN (pos - 1) % 4 = 1 THEN ' @user0 你好' ELSE '' END,
           CASE WHEN (pos - 1) % 8 = 6 THEN ' assistant1说过' ELSE '' END,
           CASE WHEN (CAST(thread_id AS BIGINT) + pos - 1) % 4 = 0 THEN ' 破防了，典中典' ELSE '' END,
           CASE WHEN (CAST(thread_id AS BIGINT) + pos - 1) % 9 = 1 THEN ' 你有病吧' ELSE '' END,
           CASE WHEN CAST(thread_id AS BIGINT) % 10 = 3 THEN ' 开盒警告' ELSE '' END) END AS content,
         is_nested, image_count, source_page
  FROM replies)"""
)

EVENT_REPLIES = """event_replies AS (
  SELECT event_type AS thread_id, CAST(user_id AS VARCHAR) AS author_name,
         CAST(event_id AS VARCHAR) AS id, event_id AS pos, epoch_us(ts) // 1000 AS timestamp_ms,
         CAST(trunc(value) AS INTEGER) AS risk
  FROM events)"""

# The ECMAScript white space class for RE2.
WS = r"\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def sql_trim(value: str) -> str:
    return f"regexp_replace({value}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def sql_squeeze(value: str) -> str:
    return sql_trim(f"regexp_replace({value}, '[{WS}]+', ' ', 'g')")


def sql_clean(value: str) -> str:
    visible = f"regexp_replace({value}, '[\\x{{200B}}-\\x{{200D}}\\x{{FEFF}}]', '', 'g')"
    return sql_trim(f"regexp_replace({visible}, '[\\t\\r\\n\\x{{A0}} ]+', ' ', 'g')")
