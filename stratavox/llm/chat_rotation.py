"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the whole dialogue is rendered with that speaker as the assistant, everyone else
as a named user, and the loss mask on the assistant's turns. A rendering is one row, or, beyond `most` turns or
`chars` characters of text, several: contiguous parts in order, each with its first turn and its place in the whole, so
the parts of a perspective joined are its rendering.

Turns get their places from one range sort of slim rows (no texts): places within a range plus the ranges' counts, so a
conversation with a third of all turns is spread over its ranges. Sums over a conversation's parts go over groups of parts
first. Texts are moved to their row once and gathered by part, which is bounded.

Defined cases: exact repeats of a row are one turn; null turns come first; ties in the turn number are ordered by speaker,
then by the MD5 of the text; a null conversation id is a conversation; a null role speaks as `unknown`; a null
text is empty; `<|` in texts and names is written `< |`; narrators (`system`) are rendered but have no perspective, and
a conversation of narrators alone gives no row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import Scratch, written

END = "<|end|>\n"
ASSISTANT = "<|assistant|>\n"
#: A conversation: whether its id is null, and the id as text.
CONV = ["no_conv", "conv"]
#: Members of a group of a running sum.
GROUP = 4096


def _safe(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def running(rows: DataFrame, keys: list[str], place: str, values: dict[str, Column]) -> DataFrame:
    """rows with the sums of values over the rows of equal keys that come earlier by place (0, 1, ...): sums of groups of
    GROUP places first, then within a group."""
    rows = rows.withColumns({f"_{n}": v.cast("long") for n, v in values.items()}).withColumn("_group", F.floor(F.col(place) / GROUP))
    earlier = Window.partitionBy(*keys).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = rows.groupBy(*keys, "_group").agg(*(F.sum(f"_{n}").alias(f"_{n}") for n in values))
    groups = groups.select(*keys, "_group", *(F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_g_{n}") for n in values))
    inside = Window.partitionBy(*keys, "_group").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_i_{n}": F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0)) for n in values})
    out = rows.join(groups, [*keys, "_group"])
    sums = {n: F.col(f"_g_{n}") + F.col(f"_i_{n}") for n in values}
    return out.withColumns(sums).drop("_group", *(f"{p}{n}" for p in ("_", "_g_", "_i_") for n in values))


def placed(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """turns (CONV, turn, speaker, digest, ...) with `place`: their positions in their conversations' order."""
    order = [*CONV, "turn", "speaker", "digest"]
    rows = turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = scratch.written(rows.withColumn("range", F.shiftright("at", 33)), "ranges")
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ranges = rows.groupBy("range").agg(F.count("*").alias("n"))
    ranges = scratch.written(ranges.select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "starts")
    number = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)
    first = rows.groupBy(*CONV).agg(F.min("at").alias("at")).withColumn("range", F.shiftright("at", 33)).join(ranges, "range").select(*CONV, number.alias("first"))
    # a conversation of many ranges meets its start once a range
    starts = rows.select("range", *CONV).distinct().join(first, CONV).join(ranges, "range")
    return rows.join(starts, ["range", *CONV]).withColumn("place", number - F.col("first")).drop("at", "range", "before", "first")


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", narrators: Sequence[str] = ("system",), most: int = 256, chars: int = 1_000_000) -> DataFrame:
    """(conv_id, perspective, part, first_turn, start, n_turns, n_own, text, loss_spans).

    first_turn: the place of the part's first turn; start: the code points of the perspective's parts before this one;
    loss_spans: [start, end) code points of this text under the loss, the assistant's words and their end mark.
    """
    conv = F.col(conv_col)
    rows = turns.select(
        conv.isNull().alias("no_conv"),
        F.coalesce(conv.cast("string"), F.lit("")).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        _safe(F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown"))).alias("speaker"),
        _safe(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"),
    ).withColumn("digest", F.md5("text"))
    rows = rows.withColumn("row", F.md5(F.to_json(F.struct(*CONV, "turn", "speaker", "digest"))))
    named = lambda s: F.concat(F.lit("<|user name="), s, F.lit("|>\n"))
    told = lambda s: F.concat(F.lit("<|"), s, F.lit("|>\n"))
    speaker = F.col("speaker")
    other = F.when(speaker.isin(*narrators), told(speaker)).otherwise(named(speaker))
    with Scratch(turns.sparkSession) as passing:
        slim = rows.select(*CONV, "turn", "speaker", "digest", "row", F.length("text").alias("size")).distinct()
        slim = passing.written(running(placed(slim, passing), CONV, "place", {"said": F.col("size")}), "places")
        # a part's number before it is made dense; never less than that of an earlier turn
        slim = slim.withColumn("piece", F.floor(F.col("place") / most) + F.floor(F.col("said") / chars))
        lengths = (F.length(other) + F.col("size") + len(END)).alias("length")
        said = slim.select(*CONV, "piece", "speaker", lengths).groupBy(*CONV, "piece", "speaker").agg(F.sum("length").alias("length"), F.count("*").alias("own"))
        said = passing.written(said, "said")
        parts = said.groupBy(*CONV, "piece").agg(F.sum("length").alias("length"))
        parts = running(parts, CONV, "piece", {"part": F.lit(1), "before": F.col("length")}).select(*CONV, "piece", "part", "before")
        people = said.where(~speaker.isin(*narrators)).select(*CONV, F.col("speaker").alias("perspective")).distinct()
        own = said.select(*CONV, "piece", F.col("speaker").alias("perspective"), "own")
        views = parts.join(people, CONV).join(own, [*CONV, "piece", "perspective"], "left").withColumn("own", F.coalesce("own", F.lit(0)))
        views = running(views, [*CONV, "perspective"], "part", {"own_before": F.col("own")})
        start = F.col("before") + F.col("own_before") * (len(ASSISTANT) - F.length(named(F.col("perspective"))))
        views = written(views.select(*CONV, "piece", "perspective", "part", start.alias("start")), "views")
        places = written(slim.select("row", *CONV, "piece", "place"), "pieces")
    texts = rows.groupBy("row").agg(F.first("speaker").alias("speaker"), F.first("text").alias("text"))
    pieces = texts.join(places, "row").groupBy(*CONV, "piece").agg(F.array_sort(F.collect_list(F.struct("place", "speaker", "text"))).alias("turns"))
    both = views.join(pieces, [*CONV, "piece"])
    me = F.col("perspective")
    head = lambda s: F.when(s == me, F.lit(ASSISTANT)).when(s.isin(*narrators), told(s)).otherwise(named(s))
    segments = F.transform("turns", lambda t: F.struct(head(t.speaker).alias("head"), F.concat(t.text, F.lit(END)).alias("body"), (t.speaker == me).alias("own")))
    both = both.withColumn("segments", segments)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        start = acc.at + F.length(s.head)
        end = start + F.length(s.body)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(s.own, F.concat(acc.spans, span)).otherwise(acc.spans).alias("spans"))

    return both.select(
        F.when(~F.col("no_conv"), F.col("conv")).cast(turns.schema[conv_col].dataType).alias("conv_id"),
        "perspective",
        "part",
        F.col("turns")[0].place.alias("first_turn"),
        "start",
        F.size("segments").cast("long").alias("n_turns"),
        F.size(F.filter("segments", lambda s: s.own)).cast("long").alias("n_own"),
        F.array_join(F.transform("segments", lambda s: F.concat(s.head, s.body)), "").alias("text"),
        F.aggregate("segments", zero, step, lambda acc: acc.spans).alias("loss_spans"),
    )
