import pytest
from pyspark.sql import functions as F

from threadspark.functions import text as tx, urls
from threadspark.sources import page_html


def _value(spark, expression, value):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "function,given,want",
    [
        (tx.compact_count, "回复 1,234", 1234), (tx.compact_count, "1.2万", 12000), (tx.compact_count, "无", None),
        (tx.parse_confidence, "85%", 0.85), (tx.parse_confidence, "85", 0.85), (tx.parse_confidence, "0.4", 0.4), (tx.parse_confidence, "hi", None),
        (tx.parse_forum_time, "2024年1月2日 3:04", 1704164640000), (tx.parse_forum_time, "1:02:03", 3723000), (tx.parse_forum_time, "2024-02-31", None),
        (tx.extract_time_text, "楼主 3 小时前 来", "3 小时前"), (tx.estimate_tokens, "abcd中😀", 5), (tx.epoch_ms, "1700000000", 1700000000000),
    ],
)
def test_scalars(spark, function, given, want):
    assert _value(spark, function, given) == want


def test_truncate_keeps_tokens_whole(spark):
    assert _value(spark, lambda c: tx.truncate_safe(c, 8), "甲甲甲甲 P1234") == "甲甲甲甲…"
    assert _value(spark, lambda c: tx.truncate_safe(c, 8), "甲甲CPU31234") == "甲甲CPU31…"


def test_thread_address(spark):
    check = lambda c: urls.thread_id_from_url(c, "f.example")
    assert _value(spark, check, "https://f.example/p/12?pn=2") == "12"
    for bad in ("http://f.example/p/12", "https://x.f.example/p/12", "https://f.example/p/12a", "nonsense"):
        assert _value(spark, check, bad) is None


def test_title_suffix_and_layouts(spark):
    pages = [
        ("a", "<title>贴 - 站点</title><div class='l_post'>x</div>"), ("b", "<h1 title='T'>y</h1><div class='pb-comment-item' data-id='1'>x</div>"),
        ("c", "<div class='pc-pb-reply-top'>全部回复 12</div>"), ("d", "<p>x"),
    ]
    facts = page_html.page_facts(page_html.element_rows(spark.createDataFrame(pages, "page_id string, html string")), "站点")
    rows = {r["page_id"]: r for r in page_html.classify_page(facts).collect()}
    assert rows["a"]["title"] == "贴 -"
    assert rows["b"]["title"] == "T"
    assert [rows[k]["status"] for k in "abc"] == ["ready", "ready", "not_ready"]
    assert rows["a"]["layout"] == "legacy" and rows["b"]["layout"] == "spa" and rows["c"]["declared_count"] == 12
    assert rows["d"]["status"] == "unsupported"


def test_parsed_pages_leave_in_frames_of_bounded_size():
    import pandas as pd

    page = "<h1>t</h1>" + "<p class='x'>a</p>" * 100
    batch = pd.DataFrame({"page_id": [str(n) for n in range(200)], "html": [page] * 199 + [None]})
    frames = list(page_html._parse_batches(iter([batch, batch.head(0)])))
    assert sum(map(len, frames)) == 199 * 102 + 1 and max(map(len, frames)) < page_html.FRAME_ROWS + 102
    assert pd.concat(frames)["page_id"].nunique() == 200
