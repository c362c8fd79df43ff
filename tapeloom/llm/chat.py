r"""Chat formatting by event-sourced reconstruction (operator 10), with DataFrame functions alone.

A log of events is partitioned by conversation and message, sorted by sequence and folded
into final messages, which are then rendered with a template and read back.

Events: conv, msg (position of the message), seq, kind, role, text. Kinds:
  start       opens the message, or begins it anew: what came before it is void
  delta       appends its text
  edit        replaces the whole text so far
  regenerate  drops the text so far; later deltas make the new one
  delete      removes the message, unless a later event brings it back
A message is known by key columns beside the conversation, and folding is dealt by all of them, so a
conversation with very many messages is spread over tasks; only the rendered conversation, which is
one value, is put together at the end.

Rows of finished texts become such a log too: each row is replayed as what a service would have
recorded. By a hash of its key a text is streamed in two deltas; regenerated after a false start; edited
after a draft; or written after the row's message was deleted and begun anew.

Template: <|im_start|>ROLE\nTEXT<|im_end|>\n for each message. In roles and texts a
backslash becomes two and "<|" becomes "<\|", so no control string can arise from a text and
the escape is undone exactly; a newline in a role becomes "\n".

Defined cases: null role or text is empty; events with a null conversation form a conversation
of their own with a null id; rows of equal order are taken by role, then text; repeated rows are
messages of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold(events: DataFrame, key: tuple[str, ...] = ("conv", "msg")) -> DataFrame:
    """Final messages (*key, role, text) of events (*key, seq, kind, role, text)."""
    w = Window.partitionBy(*key).orderBy("seq", "kind", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    epoch = events.withColumn("epoch", F.sum(F.when(F.col("kind").isin("start", "edit", "regenerate", "delete"), 1).otherwise(0)).over(w))
    last = epoch.groupBy(*key, "epoch").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x.text), "").alias("text"),
        F.max(F.when(F.col("kind") == "delete", 1).otherwise(0)).alias("deleted"),
        F.count(F.when(F.col("kind") != "delete", 1)).alias("live"),
        F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("by"),
    )
    roles = Window.partitionBy(*key).orderBy("epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    newest = Window.partitionBy(*key).orderBy(F.desc("epoch"))
    return (
        last.withColumn("role", F.last("by.role", ignorenulls=True).over(roles))
        .withColumn("n", F.row_number().over(newest))
        .where("n = 1 and (deleted = 0 or live > 0)")
        .select(*key, F.coalesce("role", F.lit("")).alias("role"), "text")
    )


def render(messages: DataFrame, key: tuple[str, ...] = ("conv", "msg")) -> DataFrame:
    """(conv, formatted): the messages of a conversation, the first column of the key, in order of the others, nulls first."""
    turn = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"), escape(F.col("text")), F.lit(END + "\n"))
    conv, *place = key
    each = messages.select(F.col(conv).alias("conv"), F.struct(*place, turn.alias("_said")).alias("x"))
    return each.groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["_said"]), "").alias("formatted"))


def read_back(formatted: DataFrame, conv: str = "conv") -> DataFrame:
    """(conv, formatted, turns array<struct<role, text>>) from the output alone."""
    body = F.split(F.col("formatted"), r"<\|im_end\|>\n")
    full = F.slice(body, 1, F.size(body) - 1)
    header = F.length(F.lit(START))
    parsed = F.transform(
        full,
        lambda t: F.struct(
            F.regexp_replace(F.regexp_replace(F.substring_index(F.substr(t, header + 1), "\n", 1), r"(?<!\\)((?:\\\\)*)\\n", "$1\n"), r"(?s)\\(.)", "$1").alias("role"),
            unescape(F.substr(t, header + F.length(F.substring_index(F.substr(t, header + 1), "\n", 1)) + 2)).alias("text"),
        ),
    )
    return formatted.select(conv, "formatted", parsed.alias("turns"))


def training_view(parsed: DataFrame, conv: str = "conv", role: str = "assistant") -> DataFrame:
    """Digests of what was read back; the loss mask covers the texts of role."""
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t.role == role), lambda t: t.text), "")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return parsed.select(
        F.col(conv),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The columns by which the messages of a table of turns are known.
KEY = ("conv", "turn", "nth")
#: What a regenerated or edited message first said.
DRAFT = "draft <|im_end|> "


def events_from_rows(rows: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as a log (*KEY, seq, kind, role, text), in four ways by a hash of the key.

    Rows of one turn are numbered by role, then text; the number and the fold need the same exchange, by conversation and turn.
    """
    w = Window.partitionBy("conv", "turn").orderBy("role", "text")
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    numbered = rows.select(F.col("conv_id").alias("conv"), "turn", "role", "text").repartition("conv", "turn").withColumn("nth", F.row_number().over(w))
    first, second = F.substr(text, F.lit(1), half), F.substr(text, half + 1)
    each = lambda seq, kind, t: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), t.alias("text"))
    nothing, draft = F.lit(None).cast("string"), F.lit(DRAFT)
    ways = [
        F.array(each(0, "start", nothing), each(1, "delta", first), each(2, "delta", second)),
        F.array(each(0, "start", nothing), each(1, "delta", draft), each(2, "regenerate", nothing), each(3, "delta", first), each(4, "delta", second)),
        F.array(each(0, "start", draft), each(1, "delta", draft), each(2, "edit", first), each(3, "delta", second)),
        F.array(each(0, "start", draft), each(1, "delete", nothing), each(2, "start", first), each(3, "delta", second)),
    ]
    way = F.pmod(F.xxhash64("conv", "turn", "nth"), F.lit(len(ways)))
    log = F.when(way == 0, ways[0]).when(way == 1, ways[1]).when(way == 2, ways[2]).otherwise(ways[3])
    return numbered.select(*KEY, F.coalesce("role", F.lit("")).alias("role"), F.explode(log).alias("e")).select(*KEY, "e.seq", "e.kind", "role", "e.text")


def format_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text): the formatted text and its digests, read back from it."""
    parsed = read_back(render(fold(events_from_rows(rows), KEY), KEY))
    return training_view(parsed).withColumnRenamed("conv", "conv_id")
