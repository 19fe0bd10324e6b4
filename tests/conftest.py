import pytest

from threadspark.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests", shuffle_partitions=4)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


REPLY = (
    "thread_id string, pos bigint, id string, floor int, parent_reply_id string, author_name string, time string,"
    " timestamp_ms bigint, content string, is_nested boolean, image_count int, source_page int"
)


@pytest.fixture
def make_replies(spark):
    """Rows from (author, content) pairs or dicts, numbered from one, in thread ``t``."""

    def build(*items):
        rows = []
        for n, item in enumerate(items, 1):
            extra = {} if isinstance(item, tuple) else dict(item)
            author, content = item if isinstance(item, tuple) else (extra.pop("author", "甲"), extra.pop("content", ""))
            row = {
                "thread_id": "t", "pos": n, "id": f"r{n}", "floor": n, "parent_reply_id": None, "author_name": author, "time": None,
                "timestamp_ms": None, "content": content, "is_nested": False, "image_count": 0, "source_page": 1,
            }
            row.update(extra)
            rows.append(tuple(row.values()))
        return spark.createDataFrame(rows, REPLY)

    return build
