"""Chat formatting by multi-party perspective rotation. DataFrame and SQL functions only.

Method. For every participant of a conversation the dialogue is rendered once, with that speaker as assistant and all others as
named users. A rendered message is `<|im_start|>assistant` or `<|im_start|>user name=NAME`, a newline, the text, `<|im_end|>`, a
newline; a marker within a text or a name, and a line end within a name, is escaped (`escaped`), so no text can forge a turn. Its loss mask is the text and the end mark of the assistant's messages; messages of the system speak to everyone:
they keep the role system and are never a perspective.

Scale. The result has a row per perspective and message, in place of one text per perspective, so that a conversation of any
length never has to fit into a row or a task's memory: `start` is the message's place in the rendered dialogue (Unicode characters), and
the dialogue is the messages' concatenation by `position`. Both are running sums. They are taken in two steps, first
within slices of a conversation (SLICE turn numbers; where more than SLICE_ROWS rows share them, as rows without a turn do, parted by turn, name
and first characters), then over the slices' totals, so no task needs a whole conversation. `dialogues` joins them to whole texts.

Defined cases. A null role speaks as the name `unknown`, as does an empty one; a null text is empty. Null conv_ids are one
conversation, null turns come first in theirs. Turns that tie are ordered by role and text; rows that repeat stay as often as they
are, in an arbitrary order that can't be told apart. A conversation whose only speaker is the system has no perspective and no row. Empty
table: empty result. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read_table

#: Turn numbers in a slice, and rows after which it is parted.
SLICE, SLICE_ROWS = 256, 1 << 16
SYSTEM = "system"


def escaped(text: Column) -> Column:
    """A text in which no marker starts: `<|im_` becomes `<|\\im_` (and `<|\\im_` gets one backslash more, so this can be undone)."""
    return F.regexp_replace(text, r"<\|(\\*)im_", r"<|\\$1im_")


def escaped_name(name: Column) -> Column:
    """A name on one line: backslashes are doubled, line ends become \\n and \\r."""
    for plain, sign in (("\\", r"\\"), ("\n", r"\n"), ("\r", r"\r")):
        name = F.replace(name, F.lit(plain), F.lit(sign))
    return escaped(name)


def _slices(said: DataFrame, slice_turns: int, slice_rows: int) -> DataFrame:
    """Each row's slice: of its turn number, and, where so many rows share that, of the turn, the name and the text's first characters."""
    said = said.withColumn("of", F.floor(F.col("turn") / slice_turns))
    heavy = cut(said.groupBy("conv_id", "of").count().where(F.col("count") > slice_rows).select(F.col("conv_id").alias("c"), F.col("of").alias("o")), "heavy")
    within = (F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    if not heavy.isEmpty():
        said = said.join(heavy, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("of").eqNullSafe(F.col("o")), "left")
        parted = F.col("said_in").isNotNull()
        said = said.withColumn("said_in", F.when(F.col("c").isNotNull() | F.col("o").isNotNull(), F.lit(True)))
        within = (F.when(parted, F.col("turn").cast("long")), F.when(parted, F.col("name")), F.when(parted, F.substring("text", 1, 2)))
    return said.withColumn("slice", F.struct("of", *(c.alias(n) for c, n in zip(within, ("turn", "name", "head"), strict=True)))).select("conv_id", "turn", "name", "text", "slice")


def rotate(turns: DataFrame, slice_turns: int = SLICE, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """conv_id, perspective, position, role, name, rendered, start, mask_start, mask_end (equal where nothing bears loss)."""
    said = turns.select(
        "conv_id",
        "turn",
        F.when(F.coalesce("role", F.lit("")) == "", "unknown").otherwise(F.col("role")).alias("name"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    said = _slices(said, slice_turns, slice_rows)
    speakers = said.where(F.col("name") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("name").alias("perspective")).distinct()
    rows = said.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    own = F.col("name") == F.col("perspective")
    rows = rows.withColumn("role", F.when(own, "assistant").when(F.col("name") == SYSTEM, SYSTEM).otherwise("user"))
    head = F.concat(F.lit("<|im_start|>"), "role", F.when(F.col("role") == "user", F.concat(F.lit(" name="), escaped_name(F.col("name")))).otherwise(""), F.lit("\n"))
    rows = rows.withColumn("head", F.char_length(head)).withColumn("rendered", F.concat(head, escaped(F.col("text")), F.lit("<|im_end|>\n")))
    rows = rows.withColumn("n", F.char_length("rendered").cast("long"))
    group = ["conv_id", "perspective"]
    within = Window.partitionBy(*group, "slice").orderBy("turn", "name", "text")
    rows = rows.withColumn("k", F.row_number().over(within).cast("long")).withColumn("upto", F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    totals = rows.groupBy(*group, "slice").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("chars"))
    before = Window.partitionBy(*group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *(F.col(c).alias(f"_{c}") for c in [*group, "slice"]),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"),
    )
    same = F.lit(True)
    for c in [*group, "slice"]:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    start = F.col("chars_before") + F.col("upto") - F.col("n")
    bears = F.col("role") == "assistant"
    return rows.join(totals, same).select(
        *group,
        (F.col("rows_before") + F.col("k")).alias("position"),
        "role",
        "name",
        "rendered",
        start.alias("start"),
        F.when(bears, start + F.col("head")).otherwise(start).alias("mask_start"),
        F.when(bears, start + F.col("n") - 1).otherwise(start).alias("mask_end"),
    )


def dialogues(rows: DataFrame) -> DataFrame:
    """conv_id, perspective, text and masks (pairs of start and end of what bears loss) of each rendered dialogue, from rotate()'s rows.

    Here a dialogue is one row, so it must fit into one (2 GB)."""
    messages = F.array_sort(F.collect_list(F.struct("position", "rendered", "mask_start", "mask_end")))
    whole = rows.groupBy("conv_id", "perspective").agg(messages.alias("m"))
    masks = F.transform(F.filter("m", lambda x: x["mask_start"] < x["mask_end"]), lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end")))
    return whole.select("conv_id", "perspective", F.concat_ws("", F.col("m.rendered")).alias("text"), masks.alias("masks"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(read_table(spark, sf_dir, "conversations"))


ORACLE = r"""
with said as (
  select conv_id, turn, case when coalesce(role, '') = '' then 'unknown' else role end as name, coalesce(text, '') as text
  from conversations),
speakers as (select distinct conv_id as c, name as perspective from said where name <> 'system'),
r as (
  select said.*, perspective,
         case when name = perspective then 'assistant' when name = 'system' then 'system' else 'user' end as role
  from said join speakers on conv_id is not distinct from c),
h as (select *, '<|im_start|>' || role || case when role = 'user' then ' name=' || regexp_replace(replace(replace(replace(name, '\', '\\'), chr(10), '\n'), chr(13), '\r'), '<\|(\\*)im_', '<|\\\1im_', 'g')
  else '' end || chr(10) as head from r),
t as (select *, head || regexp_replace(text, '<\|(\\*)im_', '<|\\\1im_', 'g') || '<|im_end|>' || chr(10) as rendered from h),
o as (
  select *, length(rendered) as n,
         row_number() over w as position,
         sum(length(rendered)) over (w rows between unbounded preceding and current row) as upto
  from t window w as (partition by conv_id, perspective order by turn nulls first, name, text))
select conv_id, perspective, cast(position as bigint) as position, role, name, rendered, cast(upto - n as bigint) as start,
       cast(upto - n + case when role = 'assistant' then length(head) else 0 end as bigint) as mask_start,
       cast(case when role = 'assistant' then upto - 1 else upto - n end as bigint) as mask_end
from o
"""
