"""Queries over whole threads: relations, components, numbering, bursts and risk findings."""

from pyspark.sql import functions as F

from threadspark import fixed_values as fv
from threadspark.functions.text import dedupe_key
from threadspark.operators import detect, graph, ordinals, relations
from threadspark.operators.payloads import minute_offset, wire_ids
from threadspark.plans.registry import DISCUSSION, EVENT_REPLIES, REPLIES, WS, query, sql_squeeze
from threadspark.session import cut_lineage
from threadspark.sources.rules import rules_table

# --- relations -------------------------------------------------------------------------------

_NAMES = "names AS (SELECT DISTINCT thread_id, author_name AS name FROM discussion)"
_TARGETS = f"""targets AS (
  SELECT r.thread_id, r.id, p.author_name AS target FROM discussion r
    JOIN discussion p ON r.thread_id = p.thread_id AND r.parent_reply_id = p.id
  UNION
  SELECT r.thread_id, r.id, n.name FROM discussion r JOIN names n ON r.thread_id = n.thread_id
  WHERE n.name <> r.author_name AND (contains(r.content, '@' || n.name) OR
    regexp_matches(r.content, '(?:回复|回覆)[{WS}]*@?' || n.name || '(?:[{WS}]*[:：,，]|[{WS}]|$)')))"""
_EDGES = f"""pairs AS (
  SELECT r.thread_id, r.id AS src, p.id AS dst, 'parent' AS kind FROM discussion r
    JOIN discussion p ON r.thread_id = p.thread_id AND r.parent_reply_id = p.id
  UNION ALL
  SELECT r.thread_id, r.id, f.dst, 'floor' FROM (SELECT DISTINCT thread_id, id, CAST(unnest(regexp_extract_all(content,
      '(?:第[\\t\\p{{Zs}}]*)?([1-9][0-9]{{0,8}})[\\t\\p{{Zs}}]*楼', 1)) AS BIGINT) AS floor FROM discussion) r
    JOIN (SELECT thread_id, floor, min(id) AS dst FROM discussion WHERE NOT is_nested GROUP BY ALL HAVING count(*) = 1) f
      ON r.thread_id = f.thread_id AND r.floor = f.floor
  UNION ALL
  SELECT thread_id, id, dst, 'above' FROM (SELECT thread_id, id, content, max_dst AS dst FROM (
      SELECT r.thread_id, r.id, r.content, (SELECT arg_max(p.id, p.pos) FROM discussion p
         WHERE p.thread_id = r.thread_id AND p.pos < r.pos AND NOT p.is_nested) AS max_dst FROM discussion r))
    WHERE dst IS NOT NULL AND regexp_matches(content, '楼上|上一楼')
  UNION ALL
  SELECT thread_id, id, dst, 'mention' FROM (
    SELECT r.thread_id, r.id, n.name, arg_max(p.id, p.pos) AS dst FROM discussion r
      JOIN names n ON r.thread_id = n.thread_id
      JOIN discussion p ON p.thread_id = r.thread_id AND p.author_name = n.name AND p.pos < r.pos
    WHERE regexp_matches(r.content, '(?:@[{WS}]*|(?:回复|回覆)[{WS}]*@?[{WS}]*)' || n.name || '(?:$|[{WS}:：,，。！？])|(?:^|[{WS},，])'
      || n.name || '[{WS}]*[:：]|' || n.name || '(?:说|认为|提到|的(?:观点|回复|说法|原话))')
    GROUP BY r.thread_id, r.id, n.name))"""
_UNDIRECTED = """edges AS (SELECT DISTINCT thread_id, src, dst FROM (
  SELECT thread_id, src, dst FROM pairs UNION ALL SELECT thread_id, dst, src FROM pairs) WHERE src <> dst)"""
_COMPONENTS = """reach AS (
  SELECT thread_id, pos AS node, pos AS seen FROM discussion
  UNION
  SELECT r.thread_id, r.node, d.pos FROM reach r JOIN discussion s ON s.thread_id = r.thread_id AND s.pos = r.seen
    JOIN edges e ON e.thread_id = s.thread_id AND e.src = s.id JOIN discussion d ON d.thread_id = e.thread_id AND d.id = e.dst),
components AS (SELECT thread_id, node AS pos, min(seen) AS component FROM reach GROUP BY ALL)"""


@query("resolve_parent", f"""WITH {DISCUSSION} SELECT r.thread_id, r.id, p.author_name AS parent_author, p.pos AS parent_pos
   FROM discussion r LEFT JOIN discussion p ON r.thread_id = p.thread_id AND r.parent_reply_id = p.id""")
def resolve_parent(t):
    return relations.resolve_parent(t.discussion).select("thread_id", "id", "parent_author", "parent_pos")


@query("resolve_targets", f"WITH {DISCUSSION}, {_NAMES}, {_TARGETS} SELECT * FROM targets")
def resolve_targets(t):
    return relations.resolve_targets(t.discussion)


def _edge_query(name, kind, build):
    sql = f"WITH {DISCUSSION}, {_NAMES}, {_EDGES} SELECT DISTINCT thread_id, src, dst FROM pairs WHERE kind = '{kind}'"
    query(name, sql)(lambda t: build(t.discussion).distinct())


_edge_query("parent_edges", "parent", relations.parent_edges)
_edge_query("floor_edges", "floor", relations.floor_edges)
_edge_query("above_edges", "above", relations.above_edges)
_edge_query("mention_edges", "mention", relations.mention_edges)


@query("reply_edges", f"WITH {DISCUSSION}, {_NAMES}, {_EDGES}, {_UNDIRECTED} SELECT * FROM edges")
def reply_edges(t):
    return relations.reply_edges(t.discussion)


@query("reply_components", f"""WITH RECURSIVE {DISCUSSION}, {_NAMES}, {_EDGES}, {_UNDIRECTED}, {_COMPONENTS}
   SELECT d.thread_id, d.id, c.component,
     dense_rank() OVER (PARTITION BY d.thread_id ORDER BY c.component) AS component_no
   FROM discussion d JOIN components c USING (thread_id, pos)""")
def reply_components(t):
    found = graph.reply_components(t.discussion, relations.reply_edges(t.discussion))
    return graph.component_ordinal(found).select("thread_id", "id", "component", "component_no")


@query("context_replies", f"""WITH {DISCUSSION}, chosen AS (SELECT * FROM discussion WHERE regexp_matches(content, '你有病')),
   near AS (SELECT c.thread_id, c.pos AS ordinal, 0 AS step, p.id FROM chosen c JOIN discussion p ON p.thread_id = c.thread_id AND p.id = c.parent_reply_id
     UNION ALL SELECT c.thread_id, c.pos, CASE p.pos - c.pos WHEN -1 THEN 1 WHEN 1 THEN 2 WHEN -2 THEN 3 ELSE 4 END, p.id
       FROM chosen c JOIN discussion p ON p.thread_id = c.thread_id AND p.pos <> c.pos AND abs(p.pos - c.pos) <= 2),
   extra AS (SELECT thread_id, id, min((ordinal, step)) AS added FROM near
     WHERE (thread_id, id) NOT IN (SELECT (thread_id, id) FROM chosen) GROUP BY ALL),
   ranked AS (SELECT e.*, row_number() OVER (PARTITION BY thread_id ORDER BY added) AS n,
     (SELECT count(*) FROM chosen c WHERE c.thread_id = e.thread_id) AS k FROM extra e)
   SELECT thread_id, id, true AS is_selected FROM chosen UNION ALL
   SELECT thread_id, id, false FROM ranked WHERE n <= greatest(0, 5 - k)""")
def context_replies(t):
    chosen = t.discussion.filter(F.col("content").contains("你有病")).select(
        F.lit("s").alias("selection_id"), "thread_id", "id", F.col("pos").alias("ordinal")
    )
    return relations.context_replies(t.discussion, chosen, radius=2, max_replies=5).drop("selection_id")


# --- numbering -------------------------------------------------------------------------------


@query("thread_order", f"""WITH {DISCUSSION} SELECT thread_id, id, row_number() OVER (PARTITION BY thread_id
     ORDER BY CASE WHEN pos % 3 > 0 THEN floor END NULLS LAST, timestamp_ms NULLS LAST, is_nested, id) AS place FROM discussion""")
def thread_order(t):
    rows = t.discussion.select(
        "thread_id", "id", F.when(F.col("pos") % 3 > 0, F.col("floor")).alias("floor"), "timestamp_ms", "is_nested"
    )
    return ordinals.session_order(rows).select("thread_id", "id", "place")


@query("reconciled_order", f"""WITH {DISCUSSION}, r AS (SELECT *, CASE WHEN pos % 5 > 0 THEN floor END AS f FROM discussion)
   SELECT r.thread_id, r.id, row_number() OVER (PARTITION BY r.thread_id ORDER BY coalesce(r.f, p.f) NULLS LAST, r.parent_reply_id IS NOT NULL,
     r.timestamp_ms NULLS LAST, r.id) AS place FROM r LEFT JOIN r p ON p.thread_id = r.thread_id AND p.id = r.parent_reply_id AND r.parent_reply_id IS NOT NULL""")
def reconciled_order(t):
    rows = t.discussion.withColumn("floor", F.when(F.col("pos") % 5 > 0, F.col("floor"))).withColumn("is_nested", F.col("parent_reply_id").isNotNull())
    return ordinals.reconciled_order(rows).select("thread_id", "id", "place")


@query("wire_id", f"""WITH {DISCUSSION} SELECT r.thread_id, r.id, concat('P', r.pos) AS wire_id,
     CASE WHEN p.pos IS NOT NULL THEN concat('P', p.pos) END AS parent_wire_id,
     CAST(greatest(0, round((r.timestamp_ms - min(r.timestamp_ms) OVER (PARTITION BY r.thread_id)) / 60000.0)) AS BIGINT) AS minute_offset
   FROM discussion r LEFT JOIN discussion p ON p.thread_id = r.thread_id AND p.id = r.parent_reply_id""")
def wire_id(t):
    rows = minute_offset(wire_ids(t.discussion))
    return rows.select("thread_id", "id", "wire_id", "parent_wire_id", "minute_offset")


# --- signals ---------------------------------------------------------------------------------


def _sql_lexical(kind):
    rows = [(p.replace(fv.SPACE, WS), s) for k, p, _, s in fv.LEXICON if k == kind]
    total = " + ".join(f"CASE WHEN regexp_matches(content, '(?i){p}') THEN {s} ELSE 0 END" for p, s in rows)
    explicit = (
        "(parent_reply_id IS NOT NULL OR regexp_matches(content, '(?:回复|回覆)[" + WS + "]*(?:第?[" + WS + "]*[0-9]+[" + WS
        + "]*楼|@?[A-Za-z0-9_\\x{3400}-\\x{9FFF}-]{1,30})|@[A-Za-z0-9_\\x{3400}-\\x{9FFF}-]{1,30}'))"
    )
    return f"least(100, ({total}) + CASE WHEN ({total}) > 0 AND {explicit} THEN 7 ELSE 0 END)"


_DIRECT = "direct AS (SELECT *, " + ", ".join(f"{_sql_lexical(k)} AS {k}" for k in fv.RISK_TYPES[:3]) + " FROM discussion)"


@query("lexical_scores", f"""WITH {DISCUSSION}, {_DIRECT}
   SELECT thread_id, id, personal_attack, provocation, harassment FROM direct""")
def lexical_scores(t):
    rows = detect.lexical_scores(t.discussion)
    return rows.select("thread_id", "id", *[F.col(f"score_{k}").alias(k) for k in fv.RISK_TYPES[:3]])


_KEY = (
    "regexp_replace(regexp_replace(lower(nfc_normalize(content)), "
    f"'(?:回复|回覆)[{WS}]*(?:@[^{WS}:：]+|[0-9]+楼)?[{WS}]*[:：]?', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
)


@query("duplicate_spam", f"""WITH d AS (SELECT doc_id, lang, {_KEY.replace('content', 'text')} AS k FROM documents),
   g AS (SELECT lang, k, count(*) AS n FROM d WHERE k <> '' GROUP BY ALL HAVING count(*) >= 3)
   SELECT doc_id, n AS copies, least(90, 48 + (n - 3) * 8) AS score FROM d JOIN g USING (lang, k)""")
def duplicate_spam(t):
    posts = t.documents.select(
        "doc_id", F.lit("all").alias("thread_id"), F.col("lang").alias("author_key"), F.md5(dedupe_key(F.col("text"))).alias("text_key")
    )
    posts = cut_lineage(posts)
    found = posts.join(detect.duplicate_counts(posts), ["thread_id", "author_key", "text_key"])
    score = F.least(F.lit(fv.DUPLICATE_MAX), fv.DUPLICATE_BASE + (F.col("n") - fv.DUPLICATE_MIN) * fv.DUPLICATE_STEP)
    return found.select("doc_id", F.col("n").alias("copies"), score.alias("score"))


_HOURS = 6 * 3600 * 1000
_BURST = f"""WITH {EVENT_REPLIES}, w AS (
     SELECT a.thread_id, a.author_name, a.timestamp_ms AS start_ms, count(*) AS n, sum(b.risk) AS r FROM event_replies a
     JOIN event_replies b ON a.thread_id = b.thread_id AND a.author_name = b.author_name
       AND b.timestamp_ms BETWEEN a.timestamp_ms AND a.timestamp_ms + {_HOURS}
     GROUP BY a.thread_id, a.author_name, a.id, a.timestamp_ms)"""


@query("posting_burst", f"{_BURST} SELECT thread_id, author_name, start_ms, n FROM w WHERE n >= 3 QUALIFY row_number() OVER (PARTITION BY thread_id, author_name ORDER BY start_ms) = 1")
def posting_burst(t):
    return detect.earliest_burst(t.event_replies, ["thread_id", "author_name"], _HOURS, 3)


@query("risk_burst", f"{_BURST} SELECT thread_id, author_name, start_ms, n FROM w WHERE n >= 2 AND r >= 35 QUALIFY row_number() OVER (PARTITION BY thread_id, author_name ORDER BY start_ms) = 1")
def risk_burst(t):
    return detect.earliest_burst(t.event_replies, ["thread_id", "author_name"], _HOURS, 2, 35)


_SCORES = f"""{_NAMES}, {_TARGETS}, {_DIRECT},
ex AS (SELECT d.*, t.target, least(author_name, target) AS l, greatest(author_name, target) AS r FROM direct d
  JOIN targets t USING (thread_id, id) WHERE target <> author_name),
mutual AS (SELECT thread_id, l, r, count(*) AS n FROM ex GROUP BY ALL HAVING count(DISTINCT author_name) = 2 AND count(*) >= 4),
flagged AS (SELECT ex.*, m.n AS mutual_n, personal_attack + provocation + harassment
    + CASE WHEN m.n IS NULL THEN 0 ELSE least(10, 100 - provocation) END AS risk
  FROM ex LEFT JOIN mutual m USING (thread_id, l, r)),
starts AS (SELECT a.thread_id, a.l, a.r, min(a.timestamp_ms) AS start_ms FROM (
    SELECT a.thread_id, a.l, a.r, a.id, a.timestamp_ms, count(*) AS n, sum(b.risk) AS risk FROM flagged a JOIN flagged b
      ON a.thread_id = b.thread_id AND a.l = b.l AND a.r = b.r AND b.timestamp_ms BETWEEN a.timestamp_ms AND a.timestamp_ms + 600000
    GROUP BY ALL HAVING count(*) >= 3 AND sum(b.risk) >= 35) a GROUP BY ALL),
sent AS (SELECT thread_id, author_name, target, count(*) AS n FROM ex GROUP BY ALL HAVING count(*) >= 3),
keys AS (SELECT thread_id, id, author_name, {_KEY} AS k FROM discussion),
copies AS (SELECT thread_id, author_name, k, count(*) AS n FROM keys WHERE k <> '' GROUP BY ALL HAVING count(*) >= 3),
fast AS (SELECT a.thread_id, a.author_name, min(a.timestamp_ms) AS start_ms FROM (
    SELECT a.thread_id, a.author_name, a.id, a.timestamp_ms FROM discussion a JOIN discussion b ON a.thread_id = b.thread_id
      AND a.author_name = b.author_name AND b.timestamp_ms BETWEEN a.timestamp_ms AND a.timestamp_ms + 120000
    GROUP BY ALL HAVING count(*) >= 5) a GROUP BY ALL),
signals AS (
  SELECT thread_id, id, 'personal_attack' AS risk_type, personal_attack AS score FROM direct WHERE personal_attack > 0
  UNION ALL SELECT thread_id, id, 'provocation', provocation FROM direct WHERE provocation > 0
  UNION ALL SELECT thread_id, id, 'harassment', harassment FROM direct WHERE harassment > 0
  UNION ALL SELECT k.thread_id, k.id, 'spam', least(90, 48 + (c.n - 3) * 8) FROM keys k JOIN copies c USING (thread_id, author_name, k)
  UNION ALL SELECT thread_id, id, 'provocation', 10 FROM flagged WHERE mutual_n IS NOT NULL
  UNION ALL SELECT f.thread_id, f.id, 'provocation', 9 FROM flagged f JOIN starts s USING (thread_id, l, r)
    WHERE f.timestamp_ms BETWEEN s.start_ms AND s.start_ms + 600000
  UNION ALL SELECT e.thread_id, e.id, 'harassment', 27 FROM ex e JOIN sent s USING (thread_id, author_name, target)
  UNION ALL SELECT d.thread_id, d.id, 'spam', 12 FROM discussion d JOIN fast f USING (thread_id, author_name)
    WHERE d.timestamp_ms BETWEEN f.start_ms AND f.start_ms + 120000),
scores AS (SELECT thread_id, id, risk_type, CAST(least(100, sum(score)) AS INTEGER) AS score FROM signals GROUP BY ALL)"""


@query("risk_scores", f"WITH {DISCUSSION}, {_SCORES} SELECT * FROM scores")
def risk_scores(t):
    posts = cut_lineage(detect.prepare_posts(t.discussion))
    targets = cut_lineage(relations.resolve_targets(t.discussion))
    return detect.risk_scores(posts, targets).drop("labels")


_MEMBERS = """people AS (SELECT thread_id, id, list_sort(list(target)) AS targets FROM targets GROUP BY ALL),
members AS (SELECT s.*, d.pos, d.content, d.timestamp_ms, d.image_count, d.parent_reply_id, coalesce(p.targets, []) AS targets,
    d.author_name, array_to_string(list_slice(list_sort(list_concat([d.author_name], coalesce(p.targets, []))), 1, 2), chr(0)) AS cluster
  FROM scores s JOIN discussion d USING (thread_id, id) LEFT JOIN people p USING (thread_id, id)
  WHERE s.score >= CASE s.risk_type WHEN 'harassment' THEN 25 WHEN 'spam' THEN 40 ELSE 20 END)"""


@query("finding_members", f"WITH {DISCUSSION}, {_SCORES}, {_MEMBERS} SELECT thread_id, id, risk_type, score, replace(cluster, chr(0), '|') AS cluster FROM members")
def finding_members(t):
    members = detect.finding_members(t.discussion)
    return members.select("thread_id", "id", "risk_type", "score", F.replace("cluster", F.lit("\x00"), F.lit("|")).alias("cluster"))


@query("finding_participants", f"""WITH {DISCUSSION}, {_SCORES}, {_MEMBERS} SELECT DISTINCT thread_id, risk_type, replace(cluster, chr(0), '|') AS cluster,
   unnest(list_concat([author_name], targets)) AS name FROM members""")
def finding_participants(t):
    people = detect.finding_participants(detect.finding_members(t.discussion))
    return people.select("thread_id", "risk_type", F.replace("cluster", F.lit("\x00"), F.lit("|")).alias("cluster"), "name")


@query("analyze_replies", f"""WITH {DISCUSSION}, {_SCORES}, {_MEMBERS},
 ranked AS (SELECT *, row_number() OVER (PARTITION BY thread_id, risk_type, cluster ORDER BY score DESC, pos) AS rk FROM members),
 grouped AS (SELECT thread_id, risk_type, cluster, count(*) AS reply_count, CAST(sum(CAST(concat('0x', substr(md5(id), 1, 15)) AS BIGINT)) AS VARCHAR) AS digest, avg(score) FILTER (rk <= 3) AS top_average,
     string_agg(concat(id, '=', score, ':', CASE WHEN length({sql_squeeze('content')}) > 160 THEN concat(substring({sql_squeeze('content')}, 1, 157), '…') ELSE {sql_squeeze('content')} END), '|' ORDER BY rk) FILTER (rk <= 8) AS evidence,
     bool_or(timestamp_ms IS NULL) AS no_time, bool_or(image_count > 0) AS images, bool_or(parent_reply_id IS NOT NULL AND len(targets) = 0) AS lost
   FROM ranked GROUP BY ALL),
 scored AS (SELECT *, CAST(least(100, round(top_average + least(12, (reply_count - 1) * 3))) AS INTEGER) AS score FROM grouped)
 SELECT thread_id, risk_type, replace(cluster, chr(0), '|') AS cluster, concat('F-', risk_type, '-', digest) AS finding_id, reply_count, score,
   CASE WHEN score >= 85 THEN 'critical' WHEN score >= 65 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS severity,
   evidence, CAST(1 + no_time::INT + images::INT + lost::INT AS INTEGER) AS note_count,
   CASE risk_type WHEN 'personal_attack' THEN 'R03.01,R03.04,R03.05' WHEN 'provocation' THEN 'R04.01,R04.02,R04.08'
     WHEN 'harassment' THEN 'R04.07,R05.01,R01.04' ELSE 'R06.05,R06.07,R16.05' END AS reasons
 FROM scored""")
def analyze_replies(t):
    found = detect.analyze_replies(t.discussion, rules_table(t.spark))
    shown = F.transform("evidence", lambda e: F.concat(e["reply_id"], F.lit("="), e["score"], F.lit(":"), e["excerpt"]))
    return found.select(
        "thread_id", "risk_type", F.replace("cluster", F.lit("\x00"), F.lit("|")).alias("cluster"), "finding_id", "reply_count", "score", "severity",
        F.array_join(shown, "|").alias("evidence"), F.size("uncertainties").alias("note_count"),
        F.array_join(F.transform("reason_candidates", lambda r: r["reason_id"]), ",").alias("reasons"),
    )
