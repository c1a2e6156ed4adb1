"""Chat formatting: turns to one training string and a loss mask, and back again.

A conversation becomes a row of blocks, one per run of turns with the same role::

    \\n<s>role\\n[INST]text\\n[/INST]text of the next turn\\n</s>

Each mark begins with a line feed, and a control string inside a text (or role) gets a
backslash in front, behind any it already has.  So a mark is never confused with text, and
taking the backslash away again gives the text back, whatever it holds.

Null texts and roles count as empty.  Turns are ordered by turn (null first), then role and
text, so ties and repeated rows have one order; every row is a turn.  Rows of a null conv_id
form one conversation.  A conversation is one string and so one row of a task: its size, not
the number of conversations, is what a task must hold.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

# The template's control strings.
OPEN, HEAD, PART, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
CONTROLS = (OPEN, HEAD, PART, CLOSE)
MARK_OPEN, MARK_HEAD, MARK_PART, MARK_CLOSE = (f"\n{c}" for c in CONTROLS)
_CONTROL = r"(?:<s>|\[INST\]|\[/INST\]|</s>)"


def escaped(text):
    return F.regexp_replace(text, rf"(?<!\\)(\\*+{_CONTROL})", r"\\$1")


def unescaped(text):
    return F.regexp_replace(text, rf"(?<!\\)\\(\\*+{_CONTROL})", "$1")


def formatted(turns, loss_role="assistant"):
    """conv_id, formatted, loss_spans.

    ``turns`` has conv_id, turn, role, text; other columns are ignored.  The spans cover
    the escaped texts of the loss role, without marks: start (from 0) and length in code points,
    and the same in bytes, by which a reader need not count the characters before.
    """
    rows = turns.select(
        "conv_id", "turn",
        escaped(F.coalesce(F.col("role"), F.lit(""))).alias("role"),
        escaped(F.coalesce(F.col("text"), F.lit(""))).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.lag("role").over(order)
    # The text before a turn's own: a new block's marks, or a mere part mark if the role stays.
    opened = F.concat(F.lit(MARK_OPEN), F.col("role"), F.lit(MARK_HEAD))
    marks = (
        F.when(before == F.col("role"), F.lit(MARK_PART))
        .when(before.isNull(), opened)
        .otherwise(F.concat(F.lit(MARK_CLOSE), opened))
    )
    pieces = rows.select(
        "*", F.row_number().over(order).alias("number"), marks.alias("marks")
    ).withColumn("piece", F.concat("marks", "text"))
    until = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    span = F.struct(
        (F.sum(F.length("piece")).over(until) - F.length("text")).cast("int").alias("start"),
        F.length("text").alias("length"),
        (F.sum(F.octet_length("piece")).over(until) - F.octet_length("text")).cast("int")
        .alias("byte_start"),
        F.octet_length("text").alias("byte_length"),
    )
    placed = pieces.select(
        "conv_id", "number", "piece", F.when(F.col("role") == loss_role, span).alias("span"))
    whole = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("number", "piece", "span"))).alias("pieces"))
    return whole.select(
        "conv_id",
        F.concat(F.array_join(F.col("pieces.piece"), ""), F.lit(MARK_CLOSE)).alias("formatted"),
        F.filter(F.col("pieces.span"), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def _after(text, mark):
    """What follows the mark's first occurrence."""
    return F.substring_index(text, mark, -1)


def turns_back(text):
    """The turns (role, text) read back from a formatted string."""
    blocks = F.filter(F.split(text, MARK_OPEN), lambda b: b != "")
    return F.flatten(F.transform(blocks, lambda b: F.transform(
        F.split(
            F.regexp_replace(_after(b, MARK_HEAD), r"\n</s>$", ""), r"\n\[/INST\]", -1),
        lambda part: F.struct(
            unescaped(F.substring_index(b, MARK_HEAD, 1)).alias("role"),
            unescaped(part).alias("text"),
        ),
    )))


def read_back(chats):
    """conv_id, turns and loss_texts, taken from ``formatted``'s output alone."""
    # The outer array holds the bytes once: each span is then cut out without counting.
    cut = F.transform(
        F.array(F.col("formatted").cast("binary")),
        lambda whole: F.transform("loss_spans", lambda s: unescaped(
            F.substring(whole, s["byte_start"] + 1, s["byte_length"]).cast("string"))))
    return chats.select(
        "conv_id", "formatted",
        turns_back(F.col("formatted")).alias("turns"),
        F.element_at(cut, 1).alias("loss_texts"),
    )


def digests(chats):
    """The contract's columns, read back from the output."""
    back = read_back(chats)
    turn = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(turn, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
