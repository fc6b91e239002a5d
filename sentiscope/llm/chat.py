"""Chat formatting by multi-party perspective rotation.

Every speaker of a conversation takes the assistant's place once: in a speaker's
rendering its own turns are the assistant's and are trained on, all other speakers are
users with their names, and system turns are context that is nobody's. A rendering is
returned turn by turn, with the character span of each turn that counts for the loss, so
a conversation of any length is never gathered in one row or task; ``dialogues`` puts renderings
together where conversations are known to fit a row.

Turns meet the speakers of their conversation in a join on ``conv_id``; the speakers
come from a distinct aggregate that is combined before it is shuffled, and adaptive execution
splits the turns of a conversation that holds a great share of the table.

Defined cases: a null role speaks as the user ``unknown`` and has no rendering of its own; a
null text is empty; a null conv_id is a conversation; a conversation with system turns only
has no rendering; turns of the same number stay and are ordered by role and text;
repeated rows are repeated turns; control marks inside a text or a name are broken up with a
blank, and a name's line breaks and other control characters are blanks (``perspective`` keeps the role as it is); an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sentiscope.llm.common import table

SYSTEM = "system"
UNKNOWN = "unknown"

# Fixed values of the chat markup.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTROL = r"[\x00-\x1F\x7F]"


def _safe(c: F.Column) -> F.Column:
    """Text in which no control mark of the markup is left."""
    return F.replace(c, F.lit("<|im_"), F.lit("< |im_"))


def _safe_name(c: F.Column) -> F.Column:
    """A name on one line: control characters are blanks, so it cannot end its turn's head."""
    return _safe(F.regexp_replace(c, CONTROL, " "))


def rotate(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``perspective``, ``turn``, ``chat_role``, ``name``, ``rendered`` and the
    loss span [``loss_start``, ``loss_end``) in characters of ``rendered`` (empty: 0, 0)."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(UNKNOWN)).alias("speaker"),
                                 _safe(F.coalesce("text", F.lit(""))).alias("said"))
    speakers = (conversations.where(F.col("role").isNotNull() & (F.col("role") != SYSTEM))
                .select(F.col("conv_id").alias("_conv"), F.col("role").alias("perspective")).distinct())
    each = turns.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    own = F.col("speaker") == F.col("perspective")
    system = F.col("speaker") == SYSTEM
    role = F.when(system, SYSTEM).when(own, "assistant").otherwise("user")
    name = F.when(~system & ~own, _safe_name(F.col("speaker")))
    head = F.concat(F.lit(OPEN), F.col("chat_role"), F.coalesce(F.concat(F.lit(" name="), F.col("name")), F.lit("")), F.lit("\n"))
    body = F.concat(F.col("said"), F.lit(CLOSE))
    trained = F.col("chat_role") == "assistant"
    start = F.when(trained, F.char_length(head)).otherwise(0)
    return (each.withColumn("chat_role", role).withColumn("name", name)
            .select("conv_id", "perspective", "turn", "chat_role", "name", F.concat(head, body, F.lit("\n")).alias("rendered"),
                    start.alias("loss_start"), F.when(trained, start + F.char_length(body)).otherwise(0).alias("loss_end")))


def dialogues(turns: DataFrame) -> DataFrame:
    """One row for each conversation and perspective: ``text`` and the loss spans in it, for
    conversations whose renderings fit a row."""
    t = F.struct("turn", "chat_role", "name", "rendered", "loss_start", "loss_end")
    rows = turns.groupBy("conv_id", "perspective").agg(F.sort_array(F.collect_list(t)).alias("t"))
    spans = F.aggregate(
        "t", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + F.char_length(x["rendered"])).alias("at"),
            F.when(x["loss_end"] > 0, F.concat(a["spans"], F.array(F.struct(
                (a["at"] + x["loss_start"]).alias("start"), (a["at"] + x["loss_end"]).alias("end"))))).otherwise(a["spans"]).alias("spans")),
        lambda a: a["spans"])
    return rows.select("conv_id", "perspective", F.array_join(F.col("t.rendered"), "").alias("text"), spans.alias("spans"))


def op4_chat_rotation(spark, sf_dir: str) -> DataFrame:
    """Every turn of every conversation in each speaker's rendering."""
    return rotate(table(spark, sf_dir, "conversations"))


SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '{UNKNOWN}') AS speaker, replace(coalesce(text, ''), '<|im_', '< |im_') AS said
  FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role IS NOT NULL AND role <> '{SYSTEM}'),
e AS (
  SELECT t.*, s.perspective,
         CASE WHEN speaker = '{SYSTEM}' THEN '{SYSTEM}' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS chat_role,
         CASE WHEN speaker <> '{SYSTEM}' AND speaker <> perspective THEN replace(regexp_replace(speaker, '{CONTROL}', ' ', 'g'), '<|im_', '< |im_') END AS name
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
h AS (SELECT *, '{OPEN}' || chat_role || coalesce(' name=' || name, '') || chr(10) AS head FROM e)
SELECT conv_id, perspective, turn, chat_role, name, head || said || '{CLOSE}' || chr(10) AS rendered,
       CASE WHEN chat_role = 'assistant' THEN CAST(length(head) AS INTEGER) ELSE 0 END AS loss_start,
       CASE WHEN chat_role = 'assistant' THEN CAST(length(head) + length(said || '{CLOSE}') AS INTEGER) ELSE 0 END AS loss_end
FROM h
"""
