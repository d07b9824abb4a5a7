"""Chat formatting: every participant of a dialogue once as the assistant.

All in DataFrame operations. A dialogue is never gathered: rows stay one a turn,
and a turn's place in its rendering is a prefix sum in two steps (within a range
partition, then over the partitions' sums), so one huge dialogue spreads over
as many tasks as it has range partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyquery.llm.common import materialise

#: What opens or closes a segment, and what parts a head from its text: neither may come from a text or a name.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SYSTEM = "system"
NOBODY = "unknown"


def guarded(text: Column) -> Column:
    """``text`` with one backslash more between each "<" and the "|" behind it, so that it holds no mark; taking one away gives the text back."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def perspectives(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, speaker, role, segment, start, train_start, train_end.

    For every participant (each speaker but ``system``) of a dialogue there is
    one rendering, the segments in order of turn (then speaker, text; null turns
    last): the participant's turns have the role assistant, other speakers' are
    users with their name, system turns stay. ``start`` is the segment's first
    character in the rendering; train_start and train_end bound what a loss
    counts, the participant's own words and end mark, and are null elsewhere.
    Texts and names are :func:`guarded`, a name's line ends are blanks: neither
    can end its segment or begin another.
    Repeated rows (equal in conv_id, turn, role and text) are one turn. A null
    or blank role is the speaker ``unknown``, a null text is empty, rows of a
    null conv_id are one dialogue. A dialogue of system turns alone has no
    rendering.
    """
    speaker = F.coalesce(F.nullif(F.trim(F.col("role").cast("string")), F.lit("")), F.lit(NOBODY))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), speaker.alias("speaker"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    spark = turns.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", F.col("turn").asc_nulls_last(), "speaker", "text"]
    base = materialise(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "chat")
    cast = base.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    each = base.join(cast, base["conv_id"].eqNullSafe(cast["of"])).drop("of")
    role = F.when(F.col("speaker") == F.col("perspective"), F.lit("assistant")).when(F.col("speaker") == SYSTEM, F.lit(SYSTEM)).otherwise(F.lit("user"))
    each = each.withColumn("role", role)
    head = F.concat(F.lit(OPEN), F.col("role"), F.when(F.col("role") == "user", F.concat(F.lit(" name="), F.regexp_replace(guarded(F.col("speaker")), r"[\r\n]", " "))).otherwise(F.lit("")), F.lit("\n"))
    each = each.withColumn("head", F.length(head)).withColumn("segment", F.concat(head, guarded(F.col("text")), F.lit(CLOSE))).withColumn("size", F.length("segment").cast("long"))
    inside = Window.partitionBy("part", "conv_id", "perspective").orderBy(F.col("turn").asc_nulls_last(), "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    sums = each.groupBy("part", "conv_id", "perspective").agg(F.sum("size").alias("size"))
    ahead = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("part").alias("p"), F.col("conv_id").alias("c"), F.col("perspective").alias("v"), F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("base"))
    joined = placed.join(sums, (placed["part"] == sums["p"]) & placed["conv_id"].eqNullSafe(sums["c"]) & (placed["perspective"] == sums["v"]))
    start = F.col("base") + F.col("before")
    own = F.col("role") == "assistant"
    return joined.select(
        "conv_id", "perspective", "turn", "speaker", "role", "segment",
        start.alias("start"),
        F.when(own, start + F.col("head")).alias("train_start"),
        F.when(own, start + F.col("size") - 1).alias("train_end"),
    )


def query(turns: DataFrame) -> DataFrame:
    """op10: the renderings' rows, with a digest of each segment."""
    return perspectives(turns).select("conv_id", "perspective", "turn", "speaker", "role", "start", "train_start", "train_end", F.md5(F.col("segment").cast("binary")).alias("segment_md5"), "segment")


ORACLE = r"""
with rows as (
  select distinct conv_id, turn, coalesce(nullif(trim(role), ''), 'unknown') as speaker, coalesce(text, '') as text from conversations
), participants as (
  select distinct conv_id as of_conv, speaker as perspective from rows where speaker <> 'system'
), each as (
  select r.*, p.perspective,
    case when speaker = perspective then 'assistant' when speaker = 'system' then 'system' else 'user' end as role
  from rows r join participants p on r.conv_id is not distinct from p.of_conv
), headed as (
  select *, '<|im_start|>' || role || case when role = 'user' then ' name=' || regexp_replace(regexp_replace(speaker, '<(\\*)\|', '<\\\1|', 'g'), '[\r\n]', ' ', 'g') else '' end || chr(10) as head from each
), sized as (
  select *, head || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10) as segment from headed
), placed as (
  select *, coalesce(sum(length(segment)) over (partition by conv_id, perspective order by turn nulls last, speaker, text
    rows between unbounded preceding and 1 preceding), 0)::bigint as start from sized
)
select conv_id, perspective, turn, speaker, role, start,
  case when role = 'assistant' then start + length(head) end as train_start,
  case when role = 'assistant' then start + length(segment) - 1 end as train_end,
  md5(segment) as segment_md5, segment
from placed
"""
