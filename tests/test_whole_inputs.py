"""Nothing is cut in silence: whole texts, all pages, every prose column, one parse of a page."""

from pyspark.sql import functions as F

from threadspark import fixed_values as fv
from threadspark.functions import text as tx
from threadspark.operators import ordinals, payloads, reconcile, results
from threadspark.sources import page_html


def test_dedupe_key_tells_long_texts_apart(spark):
    rows = spark.createDataFrame([("a" * 500 + "b",), ("a" * 500 + "c",)], "t string")
    assert rows.select(tx.dedupe_key(F.col("t"))).distinct().count() == 2


def test_every_missing_page_is_listed(spark):
    pages = spark.createDataFrame([("t", 1, 1, 1200, True)], "thread_id string, page int, current_page int, total_pages int, has_more boolean")
    assert reconcile.missing_pages(pages).count() == 1199
    assert reconcile.missing_pages(pages, limit=500).count() == 499
    assert reconcile.page_frontier(pages).first()["truncated"]


def test_no_prose_column_keeps_a_name(spark):
    rows = [("a", "t", "f1", "user0 spoke", None, ["see user0", "", "and 小明's post"]), ("a", "t", "f2", None, "by 小明", None)]
    found = spark.createDataFrame(rows, "attempt_id string, thread_id string, finding_id string, summary string, rationale string, uncertainties array<string>")
    names = spark.createDataFrame([("t", "user0"), ("t", "小明")], "thread_id string, name string")
    clean = {r["finding_id"]: r for r in results.sanitize_result(found, names).collect()}
    assert len(clean["f1"]["uncertainties"]) == 3 and clean["f2"]["uncertainties"] == []
    for row in clean.values():
        prose = " ".join(text or "" for text in [row["summary"], row["rationale"], *row["uncertainties"]])  # nulls stay null
        assert "user0" not in prose and "小明" not in prose and fv.HIDDEN_NAME in prose


def test_unknown_enums_reject_an_answer(spark):
    finding = (
        '{"type":"%s","severity":"%s","score":"50","summary":"s","offendingReplyIds":["P1"],"primaryReasonId":"R03.01","confidence":"0.9","rationale":"r"}'
    )
    body = '{"summary":"s","findings":[%s,%s],"report":{"overview":"o"}}'
    rows = [("a", "t", body % (finding % ("banana", "high"), finding % ("insult", "huge")), "stop"), ("b", "t", body % (finding % ("Ｉｎｓｕｌｔ", "高"), finding % ("insult", "low")), "stop")]
    parsed = results.parse_results(spark.createDataFrame(rows, "attempt_id string, thread_id string, content string, finish_reason string"))
    found = {r["attempt_id"]: r for r in parsed.collect()}
    assert found["a"]["reject_code"] == "schema" and found["a"]["issues"] == ["findings[0].type(enum)", "findings[1].severity(enum)"]
    assert found["b"]["reject_code"] is None and found["b"]["issues"] == []


def test_names_are_marked_longest_first_for_any_number(spark):
    names = [("t", f"n{k}", f"U{k}") for k in range(1500)] + [("t", "n", "U"), ("t", "名字", "X"), ("s", "other", "Y")]
    texts = [("t", "1", "n1499 met n7 and n and 名字名字 x"), ("t", "2", "nothing"[1:] + "😀n3"), ("s", "3", "n1 other"), ("u", "4", "n1"), ("t", "5", "")]
    marked = payloads.mark_names(spark.createDataFrame(texts, "thread_id string, id string, text string"), spark.createDataFrame(names, "thread_id string, name string, alias string"))
    found = {r["id"]: (r["marked"], r["aliases"]) for r in marked.collect()}
    mark = payloads.MARK
    assert found["1"] == (f"{mark} met {mark} a{mark}d {mark} a{mark}d {mark}{mark} x", ["U1499", "U7", "U", "U", "U", "X", "X"])
    assert found["2"] == (f"othi{mark}g😀{mark}", ["U", "U3"])
    assert found["3"] == (f"n1 {mark}", ["Y"]) and found["4"] == ("n1", []) and found["5"] == ("", [])


def test_reconciled_order_lends_the_floor_of_the_parent(spark):
    rows = [
        ("t", "a", 1, None, False, 10), ("t", "b", 2, None, False, 5), ("t", "c", None, "a", True, 30), ("t", "d", None, "a", True, 20),
        ("t", "e", None, None, False, 1), ("t", "f", None, "gone", True, 0),
    ]
    frame = spark.createDataFrame(rows, "thread_id string, id string, floor int, parent_reply_id string, is_nested boolean, timestamp_ms long")
    order = [r["id"] for r in ordinals.reconciled_order(frame).orderBy("place").collect()]
    assert order == ["a", "d", "c", "b", "e", "f"]


def test_a_page_is_parsed_once_and_yields_text_once_per_kind(spark):
    deep = "".join(f'<div class="x{k}">' for k in range(40)) + "word " * 50 + "</div>" * 40
    html = f'<title>T</title><div class="l_post" data-field="{{}}"><div class="d_post_content">{deep}</div><span class="tail-info">3楼</span></div>'
    elements = page_html.element_rows(spark.createDataFrame([("p", html)], "page_id string, html string"))
    assert sum(len(r["text"]) for r in elements.collect()) < 4 * len(html)
    threads = page_html.extract_html_threads(elements)
    assert threads.first()["content"].startswith("word word") and threads.first()["floor"] == 3
    plan = threads._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1


def test_finding_payload_hides_names_outside_the_selection(make_replies):
    rows = make_replies(("小明", "我是小明"), ("阿三", "小明和阿三，还有远方"), ("远方", "x"), ("甲", "y"))
    chosen = rows.filter("pos = 1").select(F.lit("s").alias("selection_id"), "thread_id", "id", F.col("pos").alias("ordinal"))
    found = {r["id"]: (r["author_alias"], r["redacted"]) for r in payloads.build_finding_payloads(rows, chosen, radius=1).collect()}
    assert found == {"r1": ("U1", "我是U1"), "r2": ("U2", f"U1和U2，还有{fv.NAME_PLACEHOLDER}")}


def test_reported_usage_takes_either_field_set(spark):
    bodies = [
        '{"prompt_tokens":3,"completion_tokens":4,"total_tokens":7}', '{"input_tokens":3,"output_tokens":4}', '{"input_tokens":3,"output_tokens":4,"total_tokens":8}',
        '{"input_tokens":"3","output_tokens":4}', '{"input_tokens":-1,"output_tokens":4}', '{"prompt_tokens":1.5,"completion_tokens":4}', "[]", "no", None,
    ]
    from threadspark.operators import ledger

    frame = spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "k int, b string")
    found = [r["u"] for r in frame.select("k", ledger.reported_usage(F.col("b")).alias("u")).orderBy("k").collect()]
    assert [u and (u["input_tokens"], u["output_tokens"], u["total_tokens"]) for u in found] == [(3, 4, 7), (3, 4, 7)] + [None] * 7


def test_id_rows_of_a_hot_thread_are_long_and_gathered_nowhere(spark):
    from threadspark.operators import merges

    hot = [("hot", str(k)) for k in range(3_000)] * 2
    asked = spark.createDataFrame([*hot, ("a", "1"), ("a", None), (None, "1"), (None, "2")], "thread_id string, id string")
    given = spark.createDataFrame([("hot", str(k)) for k in range(0, 3_000, 3)] + [("b", "1"), (None, "2")], "thread_id string, id string")
    found = merges.id_rows(asked, given)
    rows = {(r.thread_id, r.id): r.kind for r in found.collect()}
    assert found.count() == len(rows) == 3_003
    assert all(rows["hot", str(k)] == ("shared" if k % 3 == 0 else "missing") for k in range(3_000))
    assert rows["a", "1"] == rows[None, "1"] == "missing" and rows[None, "2"] == "shared"
    assert "collect" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_payload_bounds_are_arguments(spark, make_replies):
    from threadspark.operators import payloads

    rows = make_replies(*[("甲", "好" * 350_000)] * 2)
    titles = spark.createDataFrame([("t", "题")], "thread_id string, title string")
    assert payloads.build_thread_payloads(rows, titles).first()["status"] == "payload_too_large"
    whole = payloads.build_thread_payloads(rows, titles, max_bytes=10_000_000, max_tokens=5_000_000).first()
    assert whole["status"] == "ok" and whole["payload"].count("好" * 350_000) == 2
    assert payloads.build_thread_payloads(rows, titles, max_bytes=10_000_000, max_tokens=1_000).first()["status"] == "payload_too_large"
