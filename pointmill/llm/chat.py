"""Chat formatting: every participant in turn as the assistant.

For each conversation and each of its speakers, the dialogue is rendered with that speaker as assistant
and the others as named users; the masks mark what is to be learnt, which is what the chosen speaker
says, with its closing mark. The speakers of a conversation are few, so their set is aggregated map-side
and joined back to the turns. A dialogue is rendered in pages of PAGE turn numbers, which follow each
other: an ordinary one is a single page, an endless one is never gathered whole.

Marks inside a text or a name are escaped, so no turn can be forged. Nulls: a null role reads as the
speaker "unknown", the same as one of that name; a null text is the empty text; null turns come first,
on a page of their own, and turns of equal number go by speaker and text, all on one page. A null conversation id is a
conversation of its own. A conversation without participants (only scene-setting turns) is rendered once,
for the perspective null, with nothing to learn. Repeated rows are repeated turns. Very long texts stay
whole. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: A role that is never rotated: it sets the scene in every perspective.
SCENE = "system"
#: Turn numbers of a page.
PAGE = 256


def escaped(text: Column) -> Column:
    """The text with a backslash in each mark of the format."""
    for mark in (OPEN, CLOSE.strip()):
        text = F.replace(text, F.lit(mark), F.lit(mark[:-2] + "\\" + mark[-2:]))
    return text


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation, perspective and turn.

    `segment` is what is rendered, `mask_start` and `mask_end` (code points of the segment, end exclusive)
    what is learnt: the text and the closing mark of the chosen speaker, nothing for the others.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown")).alias("speaker"),
        escaped(F.coalesce(F.col(text_col), F.lit(""))).alias("text"),
    )
    speakers = rows.groupBy(F.col("conv_id").alias("c")).agg(F.collect_set(F.when(F.col("speaker") != SCENE, F.col("speaker"))).alias("speakers"))
    seen = rows.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "turn", "speaker", "text", F.explode_outer("speakers").alias("perspective"))
    own = F.col("speaker").eqNullSafe(F.col("perspective"))
    scene = F.col("speaker") == SCENE
    name = escaped(F.translate("speaker", "\r\n", "  "))
    head = F.when(own, F.lit(f"{OPEN}assistant\n")).when(scene, F.lit(f"{OPEN}{SCENE}\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), name, F.lit("\n")))
    return (
        seen.withColumn("head", head)
        .withColumn("segment", F.concat("head", "text", F.lit(CLOSE)))
        .select(
            "conv_id",
            "perspective",
            "turn",
            "speaker",
            F.when(own, "assistant").when(scene, SCENE).otherwise("user").alias("role"),
            "segment",
            F.when(own, F.char_length("head")).otherwise(0).cast("long").alias("mask_start"),
            F.when(own, F.char_length("segment")).otherwise(0).cast("long").alias("mask_end"),
        )
    )


def transcripts(segments: DataFrame, page: int = PAGE) -> DataFrame:
    """The rendered dialogue of each perspective, page by page.

    (conv_id, perspective, page, start, n_turns, text, masks: array of (start, end)). The pages' texts one
    after the other are the dialogue; `start` is where a page begins in it, `masks` are places in the page's
    text, both in code points.
    """
    key = ("conv_id", "perspective", "block")
    rows = segments.withColumn("block", F.floor(F.col("turn") / page))
    parts = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("t"), "turn", "speaker", "segment", "mask_start", "mask_end")))
    whole = rows.groupBy(*key).agg(parts.alias("parts"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def add(a, p):
        here = F.array(F.struct((a["at"] + p["mask_start"]).alias("start"), (a["at"] + p["mask_end"]).alias("end")))
        return F.struct((a["at"] + F.char_length(p["segment"])).alias("at"), F.when(p["mask_end"] > p["mask_start"], F.concat(a["spans"], here)).otherwise(a["spans"]).alias("spans"))

    pages = whole.select(*key, F.size("parts").cast("long").alias("n_turns"), F.concat_ws("", F.transform("parts", lambda p: p["segment"])).alias("text"), F.aggregate("parts", zero, add, lambda a: a["spans"]).alias("masks"))
    # one row a page: PAGE times fewer than turns
    order = Window.partitionBy("conv_id", "perspective").orderBy(F.col("block").asc_nulls_first())
    before = F.coalesce(F.sum(F.char_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return pages.select("conv_id", "perspective", (F.row_number().over(order) - 1).cast("long").alias("page"), before.alias("start"), "n_turns", "text", "masks")
