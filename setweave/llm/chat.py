"""Chat formatting with Spark expressions only.

A conversation becomes blocks, one for each run of turns of the same role:

    ### assistant:
    first text</part>second text</turn>

Marks are `### `, `:` and newline after the role, `</part>` between merged turns
and `</turn>` with a newline after the last. Inside texts and roles a backslash becomes
`\\b`, `<` becomes `\\l`, `#` becomes `\\h`; in roles `:` also becomes `\\c`. Every
backslash of the output therefore starts an escape, no text can hold a mark, and
undoing `\\c`, `\\l`, `\\h` and at last `\\b` gives the texts back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, HEAD_END, PART, CLOSE = "### ", ":\n", "</part>", "</turn>\n"


def escaped(c: Column) -> Column:
    for a, b in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescaped(c: Column) -> Column:
    for a, b in (("\\l", "<"), ("\\h", "#"), ("\\c", ":"), ("\\b", "\\")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): one row per conversation.

    Turns are taken by turn number (null first), ties by role and text; null
    texts and roles count as empty. loss_spans holds the 0-based code-point start and
    length of every text of loss_role in formatted. A null conv_id is a
    conversation of its own, rows that repeat a turn are turns of their own, and other columns are not read. Only a conversation's own turns meet in a
    task: a conversation is one output row, so its size is bounded by what a row may hold.
    """
    turn = F.struct(
        F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # Neighbours of one role merge: a turn opens a block where its role differs from the one before, and closes it where it differs from the next.
    size = F.size("turns")
    role_at = lambda i: F.get(F.col("turns"), i)["role"]
    opens = lambda i: ~role_at(i).eqNullSafe(role_at(i - 1))
    piece = lambda s, loss: F.struct(s.alias("s"), loss.alias("loss"))

    def pieces_of(t: Column, i: Column) -> Column:
        head = F.concat(F.lit(OPEN), F.replace(escaped(t["role"]), F.lit(":"), F.lit("\\c")), F.lit(HEAD_END))
        end = F.when((i == size - 1) | opens(i + 1), CLOSE).otherwise(PART)
        said = F.array(piece(escaped(t["text"]), t["role"] == loss_role), piece(end, F.lit(False)))
        return F.when((i == 0) | opens(i), F.concat(F.array(piece(head, F.lit(False))), said)).otherwise(said)

    # Pieces in output order; those of loss_role's texts are under the mask.
    chats = chats.select("conv_id", F.flatten(F.transform("turns", pieces_of)).alias("pieces"))
    # Each turn's lengths are added up once; starts come from a running sum that is kept as one number a piece.
    lengths = F.transform("pieces", lambda p: F.length(p["s"]).cast("long"))
    running = F.aggregate(
        lengths, F.expr("named_struct('at', 0L, 'starts', cast(array() as array<bigint>))"),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts")), lambda acc: acc["starts"])
    spans = F.transform(
        F.filter(F.zip_with("pieces", running, lambda p, at: F.struct(p["loss"].alias("loss"), at.alias("start"), F.length(p["s"]).cast("long").alias("length"))), lambda x: x["loss"]),
        lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    return chats.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss_texts) out of format_chats' columns: turns as array of (role, text), loss_texts unescaped in order."""
    blocks = F.split("formatted", CLOSE, -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)  # nothing follows the last mark

    def turns(b: Column) -> Column:
        head = F.instr(b, HEAD_END)
        role = unescaped(F.substring(b, len(OPEN) + 1, head - 1 - len(OPEN)))
        body = F.substring(b, head + len(HEAD_END), F.length(b))
        return F.transform(F.split(body, PART, -1), lambda x: F.struct(role.alias("role"), unescaped(x).alias("text")))

    return formatted.select(
        "conv_id", "formatted",
        F.flatten(F.transform(blocks, turns)).alias("turns"),
        F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))).alias("loss_texts"))


def with_probe(conversations: DataFrame) -> DataFrame:
    """The given turns and conversation -7, whose two texts imitate the marks."""
    spark: SparkSession = conversations.sparkSession
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def chat_digest(conversations: DataFrame) -> DataFrame:
    """The digest columns of op8, all read back from the formatted text and its loss mask."""
    back = read_chats(format_chats(with_probe(conversations)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
