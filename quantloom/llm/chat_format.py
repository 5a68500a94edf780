r"""Operator 1, chat formatting: prefix-target expansion.

A turn is written as ``<|im_start|>role\ntext<|im_end|>\n``. Control strings inside roles and texts, of this and of
other common templates, get a backslash after their first character (one more if they have some already), which is
taken away again when reading back. In roles, backslashes and line ends are escaped after that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings after their first character.
CONTROLS = r"\|[a-z_]+\|>|/?s>|<SYS>>|</SYS>>|/?INST\]"
ESCAPE = rf"([<\[])(\\*)({CONTROLS})"
UNESCAPE = rf"([<\[])\\(\\*)({CONTROLS})"


def escape(text):
    return F.regexp_replace(text, F.lit(ESCAPE), F.lit("$1\\\\$2$3"))


def unescape(text):
    return F.regexp_replace(text, F.lit(UNESCAPE), F.lit("$1$2$3"))


def escape_role(role):
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role):
    """Leftmost pairs of backslashes are the escaped ones, since no other escape ends in one: between them, \\n is a line
    end. No character stands for another in between."""
    pieces = F.split(role, r"\\\\", -1)
    return unescape(F.array_join(F.transform(pieces, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\"))


def prefix_examples(conversations: DataFrame, target_role: str = "assistant") -> DataFrame:
    """(conv_id, example, n_turns, text, loss_start, loss_end): one example for each turn of ``target_role``, with all
    turns before it as context; loss_start and loss_end (code points, end exclusive) are the only trainable part: that
    turn's text without its marks. Turns after the last target turn are the context of one more example, whose
    loss is empty, so that every turn can be read back.

    Turns are ordered by (turn, role, text), nulls first; repeated rows are turns of their own. Null text and role are
    empty; a null conv_id is a conversation. A conversation is put together in one row, since the last example is
    that text; columns besides conv_id, turn, role and text are ignored."""
    turn = F.struct(F.col("turn").alias("t"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    conv = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def segment(x):
        head = F.concat(F.lit(START), escape_role(x["role"]), F.lit("\n"))
        body = escape(x["text"])
        return F.struct(F.concat(head, body, F.lit(END)).alias("all"), F.char_length(head).alias("head"), F.char_length(body).alias("body"), (x["role"] == target_role).alias("target"))

    conv = conv.select("conv_id", F.transform("turns", segment).alias("segs"))
    last = F.col("k") == F.size("segs")
    rows = conv.select("conv_id", "segs", F.explode(F.sequence(F.lit(1), F.size("segs"))).alias("k"))
    rows = rows.withColumn("seg", F.element_at("segs", F.col("k"))).where(F.col("seg.target") | last)
    text = F.array_join(F.transform(F.slice("segs", F.lit(1), F.col("k")), lambda s: s["all"]), "")
    rows = rows.select("conv_id", F.col("k").alias("n_turns"), text.alias("text"), "seg")
    before = F.char_length("text") - F.char_length(F.col("seg.all"))
    start = F.when(F.col("seg.target"), before + F.col("seg.head")).otherwise(F.char_length("text"))
    end = F.when(F.col("seg.target"), start + F.col("seg.body")).otherwise(F.char_length("text"))
    return rows.select("conv_id", F.col("n_turns").alias("example"), "n_turns", "text", start.alias("loss_start"), end.alias("loss_end"))


def read_turns(text):
    """The turns (role, text) of a formatted text."""
    pieces = F.split(F.left(text, F.greatest(F.char_length(text) - len(END), F.lit(0))), r"\Q" + END + r"\E", -1)

    def turn(piece):
        body = F.substring(piece, F.lit(len(START) + 1), F.char_length(piece))
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring(body, F.char_length(role) + 2, F.char_length(body))).alias("text"))

    return F.transform(pieces, turn)


def digests(examples: DataFrame) -> DataFrame:
    """What the examples say of each conversation, read back from them."""
    loss = unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    own = examples.select("conv_id", "example", "text", loss.alias("loss"), (F.col("loss_end") > F.col("loss_start")).alias("has"))
    got = own.groupBy("conv_id").agg(F.max_by("text", "example").alias("text"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"), F.sum(F.char_length("text")).alias("formatted_chars"), F.count("*").alias("n_examples"))
    turns = read_turns(F.col("text"))
    got = got.select("*", turns.alias("turns"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return got.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"), F.col("n_examples").cast("long").alias("n_examples"))


def op1_chat_format(spark, sf_dir):
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return digests(prefix_examples(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)))


SQL = {
    "op1_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (
  SELECT *, length('<|im_start|>') + 1 + length('<|im_end|>') + 1
      + length(replace(replace(regexp_replace(role, '([<\[])(\\*)(\|[a-z_]+\|>|/?s>|<SYS>>|</SYS>>|/?INST\])', '\1\\\2\3', 'g'), '\', '\\'), chr(10), '\n'))
      + length(regexp_replace(text, '([<\[])(\\*)(\|[a-z_]+\|>|/?s>|<SYS>>|</SYS>>|/?INST\])', '\1\\\2\3', 'g')) AS chars FROM c),
r AS (
  SELECT *, sum(chars) OVER w AS upto, role = 'assistant' OR row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS ends
  FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (WHERE ends))::BIGINT AS formatted_chars, count(*) FILTER (WHERE ends) AS n_examples
FROM r GROUP BY conv_id"""
}
