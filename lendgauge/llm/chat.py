"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, only its reply is trainable. A turn
is written as ``### role: text`` with ``\\n</turn>\\n`` after it. Control strings inside a text, with any backslashes before
them, get one more backslash; nothing else is changed, and reading takes it away again. The end mark follows a line
break, an escaped one a backslash, so a text never looks like a mark.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "### ", "\n</turn>\n"
#: Strings that mark turns.
CONTROL = r"(?:###|</turn>)"


def escaped(text):
    return F.regexp_replace(text, r"\\*" + CONTROL, r"\\$0")


def unescaped(text):
    return F.regexp_replace(text, r"\\(\\*" + CONTROL + ")", "$1")


def header(role):
    """Start of a turn; the role is URL-encoded, so that any name can be read back."""
    return F.concat(F.lit(START), F.url_encode(role), F.lit(": "))


def examples(conversations: DataFrame, target_role="assistant") -> DataFrame:
    """One row per assistant turn: conv_id, target_turn (its place from 0), text, loss_start, loss_end, n_turns, complete.

    ``text`` is the formatted example and the loss mask covers its characters (code points) from ``loss_start`` up to
    ``loss_end``. ``complete`` marks the example with all turns of the conversation: the last one, and if the conversation
    doesn't end with an assistant turn, a further one without a target (empty mask, ``target_turn`` null).

    Rows are ordered by turn, a null turn first, ties by role and text; repeated rows are turns of their own. Null texts
    and roles are empty. Rows with a null conv_id form one conversation. A conversation is held as one value, like a text;
    its examples are made one after the other from it and never held together.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    written = ordered.select(
        "conv_id", F.transform("turns", lambda t: t["role"] == target_role).alias("wanted"),
        F.transform("turns", lambda t: F.concat(header(t["role"]), escaped(t["text"]))).alias("written"),
        F.transform("turns", lambda t: F.length(header(t["role"]))).alias("headers"))
    n = F.size("written")
    targets = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("wanted", i))
    ends_open = ~F.element_at("wanted", -1)
    goals = F.when(ends_open, F.concat(targets, F.array(F.lit(None).cast("int")))).otherwise(targets)
    goal = (written.withColumn("target_turn", F.explode(goals))
            .withColumn("n_turns", F.coalesce(F.col("target_turn") + 1, n)))
    text = F.concat(F.array_join(F.slice("written", F.lit(1), F.col("n_turns")), END), F.lit(END))
    end = F.length("text") - len(END)
    target = F.get("written", F.col("target_turn"))
    start = end - F.length(target) + F.get("headers", F.col("target_turn"))
    return goal.withColumn("text", text).select(
        "conv_id", "target_turn", "text", F.coalesce(start, end).alias("loss_start"), end.alias("loss_end"), "n_turns",
        (F.col("n_turns") == n).alias("complete"))


def read_turns(text):
    """Column: the turns of a formatted example as array<struct<role, text>>, unescaped."""
    marked = F.filter(F.split(text, END), lambda x: x != "")
    name = F.regexp_extract
    return F.transform(marked, lambda t: F.struct(
        F.url_decode(name(t, "^### ([^:]*): ", 1)).alias("role"),
        unescaped(F.regexp_replace(t, "^### [^:]*: ", "")).alias("text")))


def trainable(example):
    """Column: the unescaped text under the loss mask; ``example`` maps a name to a column."""
    return unescaped(F.substring(example("text"), example("loss_start") + 1, example("loss_end") - example("loss_start")))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, read from its examples: conv_id, turns, loss (trainable text in order), formatted_chars."""
    loss = F.when(F.col("target_turn").isNotNull(), trainable(F.col))
    # Context is dropped before the rows meet: what is gathered is each turn once.
    own = formatted.select("conv_id", "target_turn", loss.alias("loss"), F.length("text").cast("bigint").alias("chars"),
                           F.when(F.col("complete"), read_turns(F.col("text"))).alias("turns"))
    parts = F.array_sort(F.collect_list(F.when(F.col("target_turn").isNotNull(), F.struct("target_turn", "loss"))))
    return own.groupBy("conv_id").agg(
        F.max("turns").alias("turns"), F.array_join(F.transform(parts, lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"))
