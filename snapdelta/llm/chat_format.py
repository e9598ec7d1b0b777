"""Conversations rebuilt from event logs and rendered with a chat template.

A log has rows ``conv_id, seq, turn, kind, role, text``. In the order of ``seq``, a
``delta`` appends its text to its turn, an ``edit`` replaces what the turn holds, and a
``regenerate`` empties its turn and takes back all later turns. What survives is folded
into messages, and the messages into one text per conversation with the spans that a
model is to learn from, in characters (code points).

The template puts ``<|im_start|>role``, a line feed, the text and ``<|im_end|>`` with a
line feed around each message. Inside texts and roles each ``<`` that is followed by any
number of backslashes and ``|`` gets one backslash more, so no text can hold a control
string, and reading takes it away again. A line feed in a role becomes ``<n``.

Defined cases: null texts are empty; a turn has the last role that any of its events names,
or else an empty one; a null ``conv_id`` is a conversation like
any other. Events of equal ``seq`` count in the order of turn, kind and text; repeated
events all count. A turn whose events were all taken back is gone. An empty log gives no
rows. Columns but the named are ignored. All work is built-in functions: sorts within a
conversation, running sums and aggregations. One conversation becomes one text, so its
rows meet in one group; different conversations never do. A text of any length is taken
whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>\n"
EVENTS = "conv_id long, seq long, turn long, kind string, role string, text string"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    return F.replace(F.regexp_replace(role, r"<(\\*)([|n])", r"<\\$1$2"), F.lit("\n"), F.lit("<n"))


def unescaped_role(role: Column) -> Column:
    return F.regexp_replace(F.replace(role, F.lit("<n"), F.lit("\n")), r"<\\(\\*)([|n])", r"<$1$2")


def events_of(
    conversations: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """A log of which finished conversations are the outcome.

    By a hash, a third of the messages are streamed as two deltas. A third are drafted, and
    an edit and a delta then bring the text. A third are drafted and answered by a turn that
    is taken back, when a regeneration starts the message anew. Rows of one turn stay
    separate messages, in the order of role and text.
    """
    rows = conversations.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.withColumn("number", F.row_number().over(order).cast("long"))
    half = (F.length("text") / 2).cast("int")
    way = F.pmod(F.xxhash64(F.lit(31), "conv_id", "number"), F.lit(3))
    first, second = F.expr("left(text, half)"), F.expr("substring(text, half + 1)")
    number, role, nobody = F.col("number"), F.col("role"), F.lit(None).cast("string")
    draft = F.concat(F.reverse(first), F.lit(" (draft)"))

    def event(place: int, turn: Column, kind: str, who: Column, text: Column) -> Column:
        return F.struct(
            (5 * number + place).alias("seq"), turn.alias("turn"), F.lit(kind).alias("kind"), who.alias("role"),
            text.alias("text"),
        )

    start, end = event(3, number, "delta", role, first), event(4, number, "delta", nobody, second)
    drafted = event(0, number, "delta", role, draft)
    events = (
        F.when(F.col("way") == 0, F.array(start, end))
        .when(F.col("way") == 1, F.array(drafted, event(3, number, "edit", nobody, first), end))
        .otherwise(F.array(
            drafted, event(1, number + 1, "delta", F.lit("user"), draft), event(2, number, "regenerate", nobody, nobody),
            start, end,
        ))
    )
    return numbered.withColumn("half", half).withColumn("way", way).select("conv_id", F.explode(events).alias("event")).select(
        "conv_id", "event.*"
    )


def fold(events: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text``: the final messages."""
    rows = events.select(
        "conv_id", "seq", "turn", "kind", "role", F.coalesce("text", F.lit("")).alias("text")
    )
    until_turn = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    of_turn = Window.partitionBy("conv_id", "turn")
    taken_back = F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(until_turn)
    replaced = F.max(F.when(F.col("kind") == "edit", F.col("seq"))).over(of_turn)
    named = F.max_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).over(of_turn)
    lived = rows.withColumn("_back", taken_back).withColumn("_edit", replaced).withColumn("_role", named).where(
        F.coalesce(F.col("seq") >= F.greatest("_back", "_edit"), F.lit(True))
    )
    return lived.groupBy("conv_id", "turn").agg(
        F.coalesce(F.max("_role"), F.lit("")).alias("role"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("seq", "kind", "text"))), lambda e: e["text"]), ""
        ).alias("text"),
    )


def render(messages: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_spans``: spans of the texts of ``learned_role``."""
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    pieces = messages.select(
        "conv_id", "turn", head.alias("head"), escaped(F.col("text")).alias("body"),
        (F.col("role") == learned_role).alias("learned"),
    ).withColumn("size", (F.length("head") + F.length("body") + len(END)).cast("long"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)))
    one = F.struct(
        "turn", F.concat("head", "body", F.lit(END)).alias("piece"), "learned",
        F.struct((F.col("at") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length")).alias("span"),
    )
    return placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("all")).select(
        "conv_id",
        F.array_join(F.transform("all", lambda m: m["piece"]), "").alias("formatted"),
        F.transform(F.filter("all", lambda m: m["learned"]), lambda m: m["span"]).alias("loss_spans"),
    )


def parsed(formatted: Column) -> Column:
    """The messages of a formatted text: array of ``role, text``."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    rest = lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p))
    role = lambda p: F.substring_index(rest(p), "\n", 1)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescaped_role(role(p)).alias("role"),
            unescaped(F.substring(p, F.length(role(p)) + (len(START) + 2), F.length(p))).alias("text"),
        ),
    )


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, as it was before escaping."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: unescaped(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int"))),
        ),
        "",
    )
