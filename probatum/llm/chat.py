"""Chat formatting with Spark expressions only: sort turn structs, merge same-role neighbours, concatenate.

A formatted conversation is a run of blocks, one per stretch of turns with the same role:

    <|turn|>role<|body|>text of a turn<|next|>text of the next turn with that role<|end|>

``<|next|>`` keeps merged turns apart, so the turns can be read back one by one. A control string inside a role or a
text gets a backslash behind its first character (one more if it has some there already), which can be undone and
leaves no control string of the template in the result. The loss mask holds the spans of the assistant's texts.

Stated cases: a null role or text is an empty one; turns sort by number (null first), then by role and text, so ties
and repeated rows have one order and every row counts as a turn; rows without a conversation id form one conversation
with a null id; an empty table gives an empty result; other columns are ignored. A conversation becomes one value of
one row, so it has to fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatum.llm.common import typed

TURN, BODY, NEXT, END = "<|turn|>", "<|body|>", "<|next|>", "<|end|>"
ASSISTANT = "assistant"

# Control strings of this template and of common public chat templates, all escaped inside texts.
_CONTROL = r"\|[A-Za-z_]+\|>|/?s>|<SYS>>|</SYS>>|/?INST\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({_CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_CONTROL})", "$1$2$3")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows to (conv_id, formatted, loss_mask).

    ``loss_mask`` is an array of (start, length) in code points of ``formatted``, start from 0, one per assistant turn.
    """
    rows = typed(conversations, conv_id="bigint", turn="bigint", role="string", text="string").select(
        "conv_id",
        F.struct("turn", escape(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text")).alias("t"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def join_turn(blocks: Column, t: Column) -> Column:
        """The blocks with one more turn, in the last block if that has the turn's role."""
        one = F.array(F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts")))
        size = F.size(blocks)
        last = F.try_element_at(blocks, F.lit(-1))
        grown = F.array(F.struct(t["role"].alias("role"), F.concat(last["texts"], F.array(t["text"])).alias("texts")))
        same = (size > 0) & (last["role"] == t["role"])
        return F.when(same, F.concat(F.slice(blocks, F.lit(1), F.greatest(size - 1, F.lit(0))), grown)).otherwise(F.concat(blocks, one))

    empty = F.expr("cast(array() as array<struct<role:string,texts:array<string>>>)")
    blocks = turns.select("conv_id", F.aggregate("turns", empty, join_turn).alias("blocks"))
    written = blocks.select(
        "conv_id", "blocks",
        F.concat_ws("", F.transform("blocks", lambda b: F.concat(
            F.lit(TURN), b["role"], F.lit(BODY), F.concat_ws(NEXT, b["texts"]), F.lit(END)))).alias("formatted"),
    )
    # spans: where each text of each block starts, walked block by block
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("spans"))

    def walk_text(acc: Column, x: Column, learn: Column) -> Column:
        n = F.length(x).cast("bigint")
        span = F.array(F.struct(acc["at"].alias("start"), n.alias("length")))
        return F.struct((acc["at"] + n + len(NEXT)).alias("at"), F.when(learn, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    def walk_block(acc: Column, b: Column) -> Column:
        head = F.struct((acc["at"] + len(TURN) + len(BODY) + F.length(b["role"])).alias("at"), acc["spans"].alias("spans"))
        inside = F.aggregate(b["texts"], head, lambda a, x: walk_text(a, x, b["role"] == ASSISTANT))
        return F.struct((inside["at"] - len(NEXT) + len(END)).alias("at"), inside["spans"].alias("spans"))

    return written.select("conv_id", "formatted", F.aggregate("blocks", start, walk_block)["spans"].alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text), texts unescaped."""
    def turns_of(block: Column) -> Column:
        role = F.substring_index(block, BODY, 1)
        body = F.substring(block, F.length(role) + len(BODY) + 1, F.length(block) - F.length(role) - len(BODY) - len(END))
        return F.transform(F.split(body, r"<\|next\|>", -1), lambda x: F.struct(unescape(role).alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(F.slice(F.split(formatted, r"<\|turn\|>", -1), 2, 1 << 30), turns_of))


def read_loss_texts(formatted: Column, loss_mask: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(loss_mask, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
