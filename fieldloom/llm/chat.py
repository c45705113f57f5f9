"""Chat formatting: one rendering of a dialogue for each of its speakers.

For every participant the dialogue is rendered with that speaker as the
assistant and all others as named users; the mask covers what the assistant
says, with the mark that ends its turn.  Turns of context roles (system) keep
their role in every rendering and are nobody's perspective.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import let

OPEN, SHUT = "<|im_start|>", "<|im_end|>\n"
#: Turn numbers that one part of a rendering spans; a dialogue of more has several parts.
PART_TURNS = 256


def rotate_perspectives(turns: DataFrame, context_roles: tuple[str, ...] = ("system",), part_turns: int = PART_TURNS) -> DataFrame:
    """One row for each dialogue, participant and part.

    turns has conv_id, turn, role (the speaker's name) and text; other columns
    are ignored.  Result: conv_id, speaker, part, n_turns, n_target_turns,
    rendered, mask (array of structs start, end: code points of rendered, end
    excluded), n_chars, n_masked_chars.

    Part p holds turn numbers p*part_turns up to (p+1)*part_turns, so no row
    holds a dialogue of unbounded length; the parts of a rendering, in order,
    are the whole of it.  Within a part, turns are in order of turn, role and
    text, nulls first; repeated rows are rendered as often as they stand.  A
    null turn belongs to part -1, before all others.  A null role is the
    speaker "unknown"; a null text is an empty one, which is rendered and
    masked like any other.  Rows with a null conv_id form one dialogue, whose
    conv_id is null.  A dialogue with context turns only has no participant
    and no row; an empty table gives no rows.
    """
    role = F.coalesce("role", F.lit("unknown"))
    said = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    part = F.coalesce(F.floor(F.col("turn") / part_turns).cast("long"), F.lit(-1).cast("long"))
    parts = turns.select("conv_id", part.alias("part"), said.alias("said")).groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("said")).alias("said"))

    context = F.array(*[F.lit(r) for r in context_roles]).cast("array<string>")
    own = F.array_distinct(F.filter(F.transform("said", lambda s: s.role), lambda r: ~F.array_contains(context, r)))
    # A dialogue of one part has its speakers at hand; of longer ones the distinct speakers are joined in.
    longer = turns.where((F.col("turn") < 0) | (F.col("turn") >= part_turns) | F.col("turn").isNull()).select("conv_id").distinct()
    roles = turns.select("conv_id", role.alias("speaker")).distinct().where(~F.array_contains(context, F.col("speaker")))
    roles = roles.join(longer, roles.conv_id.eqNullSafe(longer.conv_id), "left_semi")
    speakers = roles.groupBy("conv_id").agg(F.sort_array(F.collect_list("speaker")).alias("speakers")).withColumnRenamed("conv_id", "of").withColumn("found", F.lit(True))
    joined = parts.join(speakers, parts.conv_id.eqNullSafe(speakers["of"]), "left")
    seen = joined.select("conv_id", "part", "said", F.explode(F.coalesce("speakers", own)).alias("speaker"))

    def head(s):
        mine = s.role == F.col("speaker")
        return F.concat(F.lit(OPEN), F.when(mine, F.lit("assistant")).when(F.array_contains(context, s.role), s.role).otherwise(F.concat(F.lit("user name="), s.role)), F.lit("\n"))

    pieces = F.transform("said", lambda s: F.struct((s.role == F.col("speaker")).alias("mine"), head(s).alias("head"), F.concat(s.text, F.lit(SHUT)).alias("body")))
    seen = seen.select("conv_id", "speaker", "part", let(pieces, lambda p: F.struct(p.alias("p"), F.aggregate(p, _start(), _step).alias("m"), F.array_join(F.transform(p, lambda x: F.concat(x.head, x.body)), "").alias("rendered"))).alias("r"))
    mask = F.col("r.m.mask")
    return seen.select(
        "conv_id", "speaker", "part", F.size("r.p").alias("n_turns"), F.size(mask).alias("n_target_turns"), F.col("r.rendered").alias("rendered"), mask.alias("mask"),
        F.col("r.m.at").alias("n_chars"), F.aggregate(mask, F.lit(0), lambda a, x: a + x.end - x.start).alias("n_masked_chars"),
    )


def _start():
    return F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))


def _step(acc, x):
    begin = acc.at + F.length(x.head)
    end = begin + F.length(x.body)
    span = F.array(F.struct(begin.alias("start"), end.alias("end")))
    return F.struct(end.alias("at"), F.when(x.mine, F.concat(acc.mask, span)).otherwise(acc.mask).alias("mask"))
