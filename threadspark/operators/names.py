"""Finding author names in texts by equi-join.

Names are looked up where the text can hold them (after ``@``, before a colon …).  Each such place
gives one candidate per name length that occurs in the thread, and candidates meet the thread's
names in a join on (thread, name).  Work grows with the text, never with replies times authors.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from threadspark import fixed_values as fv
from threadspark.functions.text import blank_to_null
from threadspark.operators.skew import skew_join
from threadspark.session import cut_lineage

SP = f"[{fv.SPACE}]"


@dataclass(frozen=True)
class Anchor:
    """A place next to a name: the pattern before it (or after it, read backwards) and what must follow."""

    prefix: str
    following: str | None = None
    backwards: bool = False


REPLY_WORD = "(?:回复|回覆)"
TARGET_ANCHORS = [
    Anchor("@"),
    Anchor(REPLY_WORD + f"{SP}*", rf"^$|^[{fv.SPACE}:：,，]$"),
]
NAMING_ANCHORS = [
    Anchor(f"@{SP}*", rf"^$|^[{fv.SPACE}:：,，。！？]$"),
    Anchor(REPLY_WORD + f"{SP}*", rf"^$|^[{fv.SPACE}:：,，。！？]$"),
    Anchor(f"[:：]{SP}*", rf"^$|^[{fv.SPACE},，]$", backwards=True),
    Anchor("(?:说|为认|到提|(?:点观|复回|法说|话原)的)", backwards=True),
]


def thread_names(replies: DataFrame) -> DataFrame:
    """Distinct trimmed author names: ``thread_id, name``."""
    return (
        replies.select("thread_id", blank_to_null(F.col("author_name")).alias("name"))
        .filter(F.col("name").isNotNull())
        .distinct()
    )


def name_lengths(names: DataFrame) -> DataFrame:
    return names.groupBy("thread_id").agg(
        F.collect_set(F.length("name")).alias("lengths"), F.max(F.length("name")).alias("longest")
    )


def _candidates(anchor: Anchor, content: Column, lengths: Column, longest: Column) -> Column:
    text = F.reverse(content) if anchor.backwards else content
    pattern = F.concat(F.lit("(?=" + anchor.prefix + r"([\s\S]{1,"), longest + 1, F.lit("}))"))
    places = F.regexp_extract_all(text, pattern, F.lit(1))

    def at_place(tail):
        fitting = F.filter(lengths, lambda n: n <= F.length(tail))
        if anchor.following is not None:
            fitting = F.filter(
                fitting, lambda n: F.substring(tail, n + 1, F.lit(1)).rlike(anchor.following)
            )
        cut = F.transform(fitting, lambda n: F.substring(tail, F.lit(1), n))
        return F.transform(cut, F.reverse) if anchor.backwards else cut

    return F.flatten(F.transform(places, at_place))


def named_authors(replies: DataFrame, names: DataFrame, anchors: list[Anchor]) -> DataFrame:
    """Authors named next to an anchor: distinct ``thread_id, id, pos, name``."""
    sized = skew_join(replies.select("thread_id", "id", "pos", "content"), name_lengths(names), ["thread_id"], ["id"])
    found = F.array_distinct(
        F.concat(*[_candidates(a, F.col("content"), F.col("lengths"), F.col("longest")) for a in anchors])
    )
    # written once: the join looks at its heavy keys first
    candidates = cut_lineage(sized.select("thread_id", "id", "pos", F.explode(found).alias("name")))
    return skew_join(candidates, names, ["thread_id", "name"], ["id"], "left_semi").select("thread_id", "id", "pos", "name")
