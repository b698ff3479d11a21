"""Chat formatting by prefix-target expansion, with DataFrame functions alone.

Every assistant turn becomes an example of its own: all turns before it are context, its
text is the only trainable part. Turns after the last assistant turn (all turns of a
conversation without one) form a last example in which nothing is trainable, so that the
output holds every turn. A conversation is joined once and each example is a beginning of
it; an example's text repeats its context by definition of the method, and a
conversation's turns meet in one task, as its text is one value in the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|turn|>", "<|says|>", "<|over|>"
#: Strings that mean something to common chat templates; inside a text they are escaped as the own marks are.
CONTROL = (START, SEP, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if c in r"\.[]{}()*+?^$|/<>" and c not in "/<>" else c for c in text)


_TAILS = "|".join(sorted({_quoted(c[1:]) for c in CONTROL}, key=len, reverse=True))
_PLAIN = "([<\\[])(" + _TAILS + ")"
_ESCAPED = "([<\\[])\\\\(" + _TAILS + ")"


def escape(text: Column) -> Column:
    """Double each backslash, then put one after the first character of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _PLAIN, "$1\\\\$2")


def unescape(text: Column) -> Column:
    """Undo `escape`: a lone backslash in a control string can only be its own."""
    return F.replace(F.regexp_replace(text, _ESCAPED, "$1$2"), F.lit("\\\\"), F.lit("\\"))


def expand(conversations: DataFrame) -> DataFrame:
    """conv_id, target (a turn's place from 1; null: nothing trainable), context, reply, text.

    Rows are ordered by turn; ties by role, then text. A null text or role is empty; only the role
    `assistant` has replies. A null conv_id is a conversation like any other. text = context + reply
    + the end mark of the reply's turn; the loss mask covers `reply` alone.
    """
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    marked = turns.select("conv_id", "turn", "role", "text", F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP)).alias("head"), escape(F.col("text")).alias("said"))
    placed = marked.select(
        "conv_id",
        "role",
        F.row_number().over(by).alias("place"),
        F.concat("head", "said", F.lit(END)).alias("chunk"),
        F.length("said").alias("chars"),
        F.sum(F.length("head") + F.length("said") + len(END)).over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias("upto"),
    )
    reply = F.struct(F.col("place").alias("target"), F.col("chars").alias("chars"), (F.col("upto") - len(END) - F.col("chars")).alias("start"), F.col("upto").alias("upto"))
    whole = placed.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "chunk"))), lambda x: x["chunk"]), "").alias("whole"),
        F.collect_list(F.when(F.col("role") == "assistant", reply)).alias("replies"),
        (F.max_by("role", "place") == "assistant").alias("answered"),
        F.max("upto").alias("upto"),
    )
    rest = F.array(F.struct(F.lit(None).cast("int").alias("target"), F.lit(0).alias("chars"), F.col("upto").alias("start"), F.col("upto").alias("upto")))
    examples = whole.select("conv_id", "whole", F.explode(F.when(F.col("answered"), F.col("replies")).otherwise(F.concat("replies", rest))).alias("x"))
    return examples.select(
        "conv_id",
        F.col("x.target").alias("target"),
        F.substring("whole", F.lit(1), F.col("x.start")).alias("context"),
        F.substring("whole", F.col("x.start") + 1, F.col("x.chars")).alias("reply"),
        F.substring("whole", F.lit(1), F.col("x.upto")).alias("text"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation: turns and trainable text as the formatted examples alone tell them."""
    length = F.length("text")
    kept = examples.select(
        "conv_id",
        F.coalesce("target", F.lit(2**31 - 1)).alias("at"),
        length.cast("long").alias("chars"),
        "text",
        # the mask covers what follows the context, up to the end mark
        F.when(F.col("target").isNotNull(), F.expr(f"substring(text, length(context) + 1, length(text) - length(context) - {len(END)})")).otherwise(F.lit("")).alias("trained"),
    )
    whole = kept.groupBy("conv_id").agg(
        F.max_by("text", "at").alias("text"),
        F.sum("chars").alias("formatted_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "trained"))), lambda x: unescape(x["trained"])), "").alias("loss"),
    )
    parts = F.split("text", _quoted(START), -1)
    turns = F.slice(parts, F.lit(2), F.size(parts) - 1)
    spoken = F.transform(
        turns,
        lambda t: F.concat(
            unescape(F.substring_index(t, SEP, 1)),
            F.lit("\n"),
            unescape(F.substring_index(F.substring_index(t, SEP, -1), END, 1)),
            F.lit("\n"),
        ),
    )
    return whole.select("conv_id", "loss", "formatted_chars", spoken.alias("turns"))


def op9_chat(spark, sf_dir: str) -> DataFrame:
    """Format all conversations and one with control strings in its texts; read the output back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    return read_back(expand(rows.unionByName(own))).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP9_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT conv_id, turn, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place,
    8 + 8 + 8 + length(role) + length(text)
      + length(text) - length(replace(text, '\\', ''))
      + length(role) - length(replace(role, '\\', ''))
      + len(regexp_extract_all(text || chr(1) || role, '<\\|turn\\|>|<\\|says\\|>|<\\|over\\|>|</?s>|\\[/?INST\\]|<</?SYS>>|<\\|im_start\\|>|<\\|im_end\\|>|<\\|endoftext\\|>')) AS chars
  FROM rows),
summed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS upto,
    lead(place) OVER (PARTITION BY conv_id ORDER BY place) IS NULL AS last
  FROM escaped)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR last) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id
"""
