import json

from pyspark.sql import functions as F

from threadspark.operators import merges, reconcile
from threadspark.sources import page_html, page_json


def _page(thread, page, posts, total=1, **extra):
    body = {
        "error_code": "0", "thread": {"id": thread, "title": "标题", "reply_num": "3"}, "forum": {"id": "9"},
        "page": {"current_page": str(page), "total_page": str(total), "has_more": "0"}, "post_list": posts, "user_list": [{"id": "5", "name": "n", "name_show": "昵称"}],
    }
    return (thread, page, json.dumps({**body, **extra}, ensure_ascii=False))


def _read(spark, *pages):
    raw = spark.createDataFrame(list(pages), "thread_id string, page bigint, body string")
    good, bad = page_json.split_bad_pages(page_json.parse_bodies(raw))
    return page_json.read_thread_pages(good), bad


def test_page_counts_and_preview(spark):
    posts = [
        {"id": "11", "floor": "1", "author_id": "5", "time": "1700000000", "content": [{"type": "0", "text": "正文"}, {"type": "3", "origin_src": "u"}],
         "sub_post_number": "3", "sub_post_list": {"pid": "11", "sub_post_list": [{"id": "12", "content": "预览"}]}},
        {"id": "bad", "content": "x", "sub_post_list": [{"id": "13", "content": "y"}]},
        {"id": "11", "floor": "1", "content": "again"},
    ]
    (replies, parents, pages), bad = _read(spark, _page("7", 1, posts))
    rows = {r["id"]: r for r in replies.collect()}
    assert set(rows) == {"11", "12"} and bad.count() == 0
    assert rows["11"]["author_name"] == "昵称" and rows["11"]["image_count"] == 1 and rows["11"]["unexpanded_nested_count"] == 2
    assert rows["12"]["floor"] == 1 and rows["12"]["parent_reply_id"] == "11"
    page = pages.first()
    assert (page["raw_count"], page["stable_count"], page["duplicate_count"], page["unparsed_count"]) == (5, 3, 1, 2)
    assert parents.first()["declared_count"] == 3


def test_bad_pages_are_told_apart(spark):
    post = [{"id": "1", "content": "x"}]
    _, bad = _read(
        spark, _page("7", 1, post), _page("7", 2, post, total=1), ("7", 3, " "), ("7", 4, "{"), _page("7", 5, post, total=9, error_code="4"),
        ("8", 1, _page("7", 1, post)[2]), _page("9", 1, []), _page("10", 1, post, forum={}),
    )
    codes = {(r["thread_id"], r["page"]): r["error_code"] for r in bad.collect()}
    assert codes == {
        ("7", 2): "page_contradiction", ("7", 3): "empty_body", ("7", 4): "not_json", ("7", 5): "remote_error",
        ("8", 1): "thread_mismatch", ("9", 1): "no_replies", ("10", 1): "no_forum_id",
    }


NESTED = (
    "thread_id string, parent_id string, page int, total_num int, total_pages int, current_page int, has_more boolean, has_trusted_pager boolean,"
    "raw_count int, stable_count int, duplicate_count int, unparsed_count int, unknown_count int, is_probe boolean, is_empty_sentinel boolean"
)


def _states(spark, pages, replies, declared=4):
    parents = spark.createDataFrame([("t", "p", declared, 1, 0, False)], "thread_id string, parent_id string, declared_count int, parent_floor int, preview_count int, satisfied boolean")
    listed = spark.createDataFrame(replies, "thread_id string, parent_id string, page int, id string")
    return reconcile.nested_reconcile(parents, spark.createDataFrame(pages, NESTED), listed).first()


def _nested(page, num, pages, n, probe=False, trusted=True, dup=0):
    return ("t", "p", page, num, pages, page, page < pages and not probe, trusted, n + dup, n + dup, dup, 0, 0, probe, probe)


def test_gap_needs_the_empty_page(spark):
    ids = [("t", "p", 1, "a"), ("t", "p", 1, "b"), ("t", "p", 2, "c")]
    pages = [_nested(1, 4, 2, 2), _nested(2, 4, 2, 1)]
    assert _states(spark, pages, ids)["gap_verified"] is False
    assert _states(spark, [*pages, _nested(3, None, 0, 0, probe=True)], ids)["gap_verified"] is True


def test_drift_duplicates_and_missing_pages(spark):
    drift = _states(spark, [_nested(1, 4, 2, 2), _nested(2, 5, 2, 2)], [("t", "p", p, f"{p}{i}") for p in (1, 2) for i in "ab"])
    assert drift["drift_count"] == 1 and drift["reached_end"]
    twice = _states(spark, [_nested(1, 4, 2, 2), _nested(2, 4, 2, 2)], [("t", "p", 1, "a"), ("t", "p", 1, "b"), ("t", "p", 2, "b"), ("t", "p", 2, "c")])
    assert twice["duplicate_count"] == 1 and twice["distinct_count"] == 3
    gap = _states(spark, [_nested(1, 6, 3, 2), _nested(3, 6, 3, 2)], [("t", "p", 1, "a"), ("t", "p", 1, "b"), ("t", "p", 3, "c")])
    assert gap["truncated"] and not gap["reached_end"] and gap["distinct_count"] == 2


CAPTURES = "capture_id int, thread_id string, parser_variant string, document_instance_id string, page_number int, captured_at int"


def _alive(spark, *rows):
    return {r["capture_id"] for r in merges.surviving_captures(spark.createDataFrame(list(rows), CAPTURES)).collect()}


def test_surviving_captures(spark):
    legacy = lambda n, page: (n, "t", "legacy", None, page, n)
    spa = lambda n, doc: (n, "t", "spa", doc, 1, n)
    api = lambda n: (n, "t", "api", None, 1, n)
    assert _alive(spark, legacy(1, 1), legacy(2, 2), legacy(3, 1)) == {2, 3}
    assert _alive(spark, legacy(1, 1), spa(2, "x"), spa(3, "x")) == {2, 3}
    assert _alive(spark, spa(1, "x"), spa(2, "y"), spa(3, "x")) == {3}
    assert _alive(spark, spa(1, None), spa(2, None)) == {2}
    assert _alive(spark, api(1), legacy(2, 1), spa(3, "x")) == {1}
    assert _alive(spark, api(1), api(2), spa(3, "x")) == {2}


def test_empty_sentinel_is_exact(spark):
    pages = [
        ("a", """<ul><li class="lzl_li_pager" data-field='{"total_num":null,"total_page":0}'></li></ul>"""),
        ("b", """<ul><li class="lzl_li_pager" data-field='{"total_num":0,"total_page":0}'></li></ul>"""),
        ("c", """<ul><li class="lzl_li_pager" data-field='{"total_num":null,"total_page":0,"x":1}'></li></ul>"""),
    ]
    rows, _ = page_html.read_nested_pages(page_html.element_rows(spark.createDataFrame(pages, "page_id string, html string")))
    assert {r["page_id"]: r["is_empty_sentinel"] for r in rows.collect()} == {"a": True, "b": False, "c": False}
    assert rows.filter(F.col("has_trusted_pager")).count() == 1
