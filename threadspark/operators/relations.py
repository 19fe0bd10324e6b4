"""Which reply answers which: parents, named targets, floor references, "above" and mentions."""

from pyspark.sql import DataFrame, Window, functions as F

from threadspark import fixed_values as fv
from threadspark.functions.text import blank_to_null
from threadspark.operators.names import NAMING_ANCHORS, TARGET_ANCHORS, named_authors, thread_names
from threadspark.operators.ordinals import previous_value


def resolve_parent(replies: DataFrame) -> DataFrame:
    """Replies with their parent's author and position inside the same thread (null when absent)."""
    parents = replies.select(
        "thread_id",
        F.col("id").alias("parent_reply_id"),
        blank_to_null(F.col("author_name")).alias("parent_author"),
        F.col("pos").alias("parent_pos"),
    )
    # Main replies have no parent: they share no join key, so they stay out of the join.
    has_parent = F.col("parent_reply_id").isNotNull()
    answers = replies.filter(has_parent).join(parents, ["thread_id", "parent_reply_id"], "left")
    return answers.unionByName(replies.filter(~has_parent), allowMissingColumns=True)


def resolve_targets(replies: DataFrame) -> DataFrame:
    """``thread_id, id, target``: the parent's author and authors addressed by name."""
    by_parent = resolve_parent(replies.select("thread_id", "id", "pos", "author_name", "parent_reply_id"))
    by_parent = by_parent.filter(F.col("parent_author").isNotNull()).select(
        "thread_id", "id", F.col("parent_author").alias("target")
    )
    named = named_authors(replies, thread_names(replies), TARGET_ANCHORS)
    own = replies.select("thread_id", "id", blank_to_null(F.col("author_name")).alias("own"))
    by_name = (
        named.join(own, ["thread_id", "id"])
        .filter(~F.col("name").eqNullSafe(F.col("own")))
        .select("thread_id", "id", F.col("name").alias("target"))
    )
    return by_parent.unionByName(by_name).distinct()


def parent_edges(replies: DataFrame) -> DataFrame:
    known = replies.select("thread_id", F.col("id").alias("dst"))
    return (
        replies.filter(F.col("parent_reply_id").isNotNull())
        .select("thread_id", F.col("id").alias("src"), F.col("parent_reply_id").alias("dst"))
        .join(known, ["thread_id", "dst"], "left_semi")
        .select("thread_id", "src", "dst")
    )


def floor_edges(replies: DataFrame) -> DataFrame:
    """Edges to the only main reply at a floor that the text refers to."""
    unique_floor = (
        replies.filter(~F.col("is_nested") & F.col("floor").isNotNull())
        .groupBy("thread_id", F.col("floor").cast("bigint").alias("floor_no"))
        .agg(F.count("*").alias("n"), F.min("id").alias("dst"))
        .filter(F.col("n") == 1)
        .drop("n")
    )
    numbers = F.array_distinct(F.regexp_extract_all("content", F.lit(fv.FLOOR_REFERENCE), F.lit(1)))
    cited = replies.select("thread_id", F.col("id").alias("src"), F.explode(numbers).alias("floor_no"))
    cited = cited.withColumn("floor_no", F.col("floor_no").cast("bigint"))
    return cited.join(unique_floor, ["thread_id", "floor_no"]).select("thread_id", "src", "dst")


def above_edges(replies: DataFrame) -> DataFrame:
    """Edges from "the one above" to the main reply before it."""
    light = replies.select(
        "thread_id", "id", "pos", "is_nested", F.col("content").rlike(fv.ABOVE_REFERENCE).alias("says_above")
    )
    looked = previous_value(light, ["thread_id"], "pos", F.when(~F.col("is_nested"), F.col("id")), "dst")
    return looked.filter(F.col("says_above") & F.col("dst").isNotNull()).select(
        "thread_id", F.col("id").alias("src"), "dst"
    )


def mention_edges(replies: DataFrame) -> DataFrame:
    """Edges to the latest earlier reply of every author named in the text (an as-of join by position)."""
    named = named_authors(replies, thread_names(replies), NAMING_ANCHORS)
    posts = replies.select(
        "thread_id", blank_to_null(F.col("author_name")).alias("name"), "pos", F.col("id").alias("post_id"),
        F.lit(None).cast("string").alias("src"),
    ).filter(F.col("name").isNotNull())
    asks = named.select(
        "thread_id", "name", "pos", F.lit(None).cast("string").alias("post_id"), F.col("id").alias("src")
    )
    looked = previous_value(posts.unionByName(asks), ["thread_id", "name"], "pos", F.col("post_id"), "dst")
    return looked.filter(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("thread_id", "src", "dst")


def reply_edges(replies: DataFrame) -> DataFrame:
    """Undirected relation as distinct directed pairs, both ways, without self edges."""
    kinds = [parent_edges, floor_edges, above_edges, mention_edges]
    edges = None
    for kind in kinds:
        found = kind(replies)
        edges = found if edges is None else edges.unionByName(found)
    edges = edges.filter(F.col("src") != F.col("dst"))
    back = edges.select("thread_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.unionByName(back).distinct()


def context_replies(
    replies: DataFrame, selection: DataFrame, radius: int = 1, max_replies: int | None = None
) -> DataFrame:
    """Selected replies with parents and neighbours, numbered in the order they were added.

    ``selection`` holds ``selection_id, thread_id, id, ordinal``.  Neighbours come from exact
    positions (one equi-join per offset); selected replies are never dropped.  ``max_replies`` bounds
    selected and added replies together; without it all are kept.
    """
    light = replies.select("thread_id", "id", "pos", "parent_reply_id")
    chosen = selection.join(light, ["thread_id", "id"])
    known = light.select("thread_id", F.col("id").alias("parent_reply_id"))
    parents = chosen.join(known, ["thread_id", "parent_reply_id"], "left_semi").select(
        "selection_id", "thread_id", "ordinal", F.lit(0).alias("step"), F.col("parent_reply_id").alias("id")
    )
    steps = [(offset, sign) for offset in range(1, radius + 1) for sign in (-1, 1)]
    near = parents
    if steps:
        offsets = F.array(
            *[F.struct(F.lit(i + 1).alias("step"), F.lit(o * s).alias("shift")) for i, (o, s) in enumerate(steps)]
        )
        asked = chosen.select("selection_id", "thread_id", "ordinal", "pos", F.explode(offsets).alias("o"))
        asked = asked.select(
            "selection_id", "thread_id", "ordinal", "o.step", (F.col("pos") + F.col("o.shift")).alias("pos")
        )
        near = near.unionByName(
            asked.join(light.select("thread_id", "pos", "id"), ["thread_id", "pos"]).drop("pos")
        )
    keys = ["selection_id", "thread_id", "id"]
    extra = near.groupBy(*keys).agg(F.min(F.struct("ordinal", "step")).alias("added"))
    extra = extra.join(chosen.select(*keys), keys, "left_anti")
    sizes = chosen.groupBy("selection_id", "thread_id").agg(F.count_distinct("id").alias("selected_count"))
    rank = F.row_number().over(Window.partitionBy("selection_id", "thread_id").orderBy("added"))
    kept = extra
    if max_replies is not None:
        kept = (
            extra.withColumn("context_no", rank)
            .filter(F.col("context_no") <= max_replies)
            .join(sizes, ["selection_id", "thread_id"])
            .filter(F.col("context_no") <= F.greatest(F.lit(0), F.lit(max_replies) - F.col("selected_count")))
        )
    kept = kept.select(*keys, F.lit(False).alias("is_selected"))
    return chosen.select(*keys, F.lit(True).alias("is_selected")).distinct().unionByName(kept)
