"""Chat formatting in budgeted windows, with DataFrame functions only.

A turn is written ``<|turn|>role<|text|>text<|end|>``. Inside roles and texts a backslash
becomes two and ``<|`` becomes ``<\\|``, so the template's marks never occur there, and the
unescaped text is got back by dropping the backslash of each pair.

Prefix sums of the turns' tokens choose the windows: a turn larger than half of a window's
room stands alone; the others between such turns are cut where their prefix sum enters the
next half room, so that no window overflows, and no turn is cut. Each window starts with the
conversation's system turn, if its first turn is one; later windows then repeat up to
``history_turns`` earlier turns that fit what the budget leaves for history. Assistant texts
are targets; a repeated turn's text is masked.

The texts are shuffled once, by conversation and block of turn numbers. Places, prefix sums,
history and the windows themselves are worked out where they then are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 2048
HISTORY_TURNS = 2
HISTORY_TOKENS = 512
BLOCK_TURNS = 256
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def tokens_of(text: Column) -> Column:
    """Tokens of a formatted turn: one for each four bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


_TURN_TYPE = "struct<formatted:string,size:int,tokens:bigint>"


def format_windows(
    df: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    budget: int = BUDGET,
    history_turns: int = HISTORY_TURNS,
    history_tokens: int = HISTORY_TOKENS,
    target_role: str = "assistant",
    block_turns: int | None = BLOCK_TURNS,
) -> DataFrame:
    """One row for each window: part (conv, block), conv, window (the place of its first new
    turn in the conversation), formatted text, n_repeated (turns at its start that an earlier
    window has already had), targets: array of (start, length) in code points of the formatted
    text, from 0, of the assistant texts to learn from; tokens.

    Turns are in the order of turn (null first), role, text; null roles and texts count as
    empty; rows that repeat are turns of their own; turns without a conversation (null) are
    one. Columns of other names are not used.

    A window exceeds ``budget`` only if a single turn with the system turn does: what the
    system turn leaves is the room; up to half of it, and ``history_tokens`` at most, is for
    history, the rest for new turns; a turn that needs the history's part gets it.

    ``block_turns`` turn numbers are formatted together, so that a giant conversation is many
    small groups; a window never reaches over a block's end, and its history not beyond the
    block before. With None a conversation is one block.
    """
    turn = F.col(turn_col).cast("long")
    block = F.lit(0).cast("long") if block_turns is None else F.floor(F.coalesce(turn, F.lit(-(1 << 40))) / block_turns)
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    turns = df.select(
        F.struct(F.col(conv_col).alias("conv"), block.alias("block")).alias("part"),
        turn.alias("turn"),
        role.alias("role"),
        text.alias("text"),
    )
    dealt = _measured(turns.repartition("part"))
    none = F.array().cast(f"array<{_TURN_TYPE}>")
    if block_turns is None:
        rows = dealt.withColumns({"n0": F.lit(0).cast("long"), "given": F.lit(None).cast(_TURN_TYPE), "tail": none})
    else:
        rows = dealt.join(_from_before(turns, dealt, history_turns), "part", "left")
        rows = rows.withColumns({"n0": F.coalesce("n0", F.lit(0)), "tail": F.coalesce("tail", none)})

    order = Window.partitionBy("part").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    opening = F.first(F.struct("role", F.struct("formatted", "size", "tokens").alias("turn"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns(
        {
            "i": F.row_number().over(order) - 1,
            "before": F.coalesce(F.sum("tokens").over(before), F.lit(0)),
            "chars": F.coalesce(F.sum("size").over(before), F.lit(0)),
            "opening": opening,
        }
    )
    # The system turn is the conversation's first one; in a later block it is given.
    rows = rows.withColumn("opens", (F.col("n0") == 0) & (F.col("opening.role") == "system"))
    rows = rows.withColumn("system", F.when(F.col("n0") > 0, F.col("given")).when(F.col("opens"), F.col("opening.turn"))).drop("opening", "given")
    rows = rows.withColumn("is_system", F.col("opens") & (F.col("i") == 0))
    room = F.lit(budget) - F.coalesce("system.tokens", F.lit(0))
    rows = rows.withColumn("room", room).withColumn("spare", F.greatest(F.least(F.lit(history_tokens), F.floor(room / 2)), F.lit(0)))
    half = F.greatest(F.floor((F.col("room") - F.col("spare")) / 2), F.lit(1))
    passed = F.col("before") - F.when(F.col("opens"), F.col("system.tokens")).otherwise(0)
    # A turn that stands alone has its own number; small turns have that of the half room. Small
    # turns around one that stands alone differ, as it is longer than the half room.
    cell = F.when(F.col("tokens") > half, -1 - F.col("i")).otherwise(F.floor(passed / half))
    rows = rows.withColumn("cell", F.when(~F.col("is_system"), cell))
    rows = rows.withColumn("cell", F.coalesce("cell", F.lead("cell").over(order), F.lit(0)))
    starts = F.coalesce(F.col("cell") != F.lag("cell").over(order), F.lit(True))

    # Earlier turns, the nearest first, each with the tokens from it to the window.
    earlier = F.array(
        *(F.lag(F.when(~F.col("is_system"), F.struct("formatted", "size", "tokens")), k).over(order) for k in range(1, history_turns + 1))
    ) if history_turns else none
    rows = rows.withColumn("earlier", earlier).withColumn("starts", starts)
    start = F.struct(
        "system",
        "opens",
        "room",
        "spare",
        F.concat(F.filter("earlier", lambda x: x.isNotNull()), "tail").alias("earlier"),
        F.col("chars").alias("base"),
        (F.col("n0") + F.col("i")).alias("window"),
    )
    piece = F.struct("i", "formatted", "size", "lead", "chars", (F.col("role") == target_role).alias("target"))
    windows = rows.select("part", "cell", "tokens", "is_system", F.when(F.col("starts"), start).alias("start"), piece.alias("piece"))
    windows = windows.groupBy("part", "cell").agg(
        F.first("start", ignorenulls=True).alias("start"),
        F.array_sort(F.collect_list("piece")).alias("pieces"),
        F.sum("tokens").alias("tokens"),
        F.sum(F.when(~F.col("is_system"), F.col("tokens")).otherwise(0)).alias("own"),
    )
    left = F.least(F.col("start.spare"), F.col("start.room") - F.col("own"))
    history = F.transform(
        F.slice("start.earlier", 1, max(history_turns, 1)),
        lambda x, i: F.struct(x["formatted"], x["size"], x["tokens"], _tokens_to(F.col("start.earlier"), i).alias("reach")),
    )
    history = F.reverse(F.filter(history, lambda x: x["reach"] <= left)) if history_turns else F.array()
    history = F.transform(
        history,
        lambda x: F.struct(x["formatted"].alias("formatted"), x["size"].alias("size"), x["tokens"].alias("tokens")),
    ) if history_turns else none
    system = F.when(
        F.col("start.system").isNotNull() & ((F.col("start.window") > 0) | ~F.col("start.opens")),
        F.array("start.system"),
    ).otherwise(none)
    windows = windows.withColumn("old", F.concat(system, history))
    shift = F.aggregate("old", F.lit(0), lambda n, x: n + x["size"]) - F.col("start.base")
    windows = windows.withColumn("shift", shift)
    targets = F.transform(
        F.filter("pieces", lambda x: x["target"]),
        lambda x: F.struct((F.col("shift") + x["chars"] + x["lead"]).alias("start"), (x["size"] - x["lead"] - len(END)).cast("long").alias("length")),
    )
    return windows.select(
        "part",
        F.col("part.conv").alias("conv"),
        F.col("start.window").cast("long").alias("window"),
        F.array_join(F.concat(F.transform("old", lambda x: x["formatted"]), F.transform("pieces", lambda x: x["formatted"])), "").alias("formatted"),
        F.size("old").alias("n_repeated"),
        targets.alias("targets"),
        (F.col("tokens") + F.aggregate("old", F.lit(0).cast("long"), lambda n, x: n + x["tokens"])).alias("tokens"),
    )


def _tokens_to(turns: Column, i: Column) -> Column:
    return F.aggregate(F.slice(turns, F.lit(1), i + 1), F.lit(0).cast("long"), lambda n, x: n + x["tokens"])


def _measured(turns: DataFrame) -> DataFrame:
    """Turns with their formatted text, its size and tokens, and where in it the text begins."""
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    out = turns.withColumn("formatted", F.concat(head, escape(F.col("text")), F.lit(END))).withColumn("lead", F.char_length(head))
    return out.withColumn("size", F.char_length("formatted")).withColumn("tokens", tokens_of(F.col("formatted")))


def _from_before(turns: DataFrame, dealt: DataFrame, history_turns: int) -> DataFrame:
    """What each block but a conversation's first needs of the turns before it: part, n0 (their
    number), given (the system turn) and tail (the last ones of the block before, latest first)."""
    conv = Window.partitionBy("part.conv").orderBy("part.block")
    blocks = turns.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    blocks = blocks.select(
        "part",
        F.sum("n").over(conv.rowsBetween(Window.unboundedPreceding, -1)).alias("n0"),
        F.lead("part").over(conv).alias("next"),
    )
    opening = F.min(F.struct("turn", "role", F.when(F.col("role") == "system", F.col("text")).alias("text"))).alias("o")
    system = turns.groupBy(F.struct("part.conv").alias("whose")).agg(opening).where("o.role = 'system'").select("whose", "o.role", "o.text")
    system = _measured(system).select("whose", F.struct("formatted", "size", "tokens").alias("given"))
    later = blocks.where("n0 > 0").select("part", "n0", F.struct("part.conv").alias("whose"))
    later = later.join(system, "whose", "left").drop("whose")
    last = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("turn"), F.desc("role"), F.desc("text")))
    tail = dealt.join(blocks.where("next is not null").select("part", "next", "n0"), "part").withColumn("back", last)
    # the conversation's system turn is given anyway
    tail = tail.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("part")))
    tail = tail.where((F.col("back") <= history_turns) & ~(F.col("n0").isNull() & (F.col("back") == F.col("n")) & (F.col("role") == "system")))
    turn = F.struct("back", F.struct("formatted", "size", "tokens").alias("turn"))
    tail = tail.groupBy(F.col("next").alias("part")).agg(F.transform(F.array_sort(F.collect_list(turn)), lambda x: x["turn"]).alias("tail"))
    return later.join(tail, "part", "left")


def read_turns(windows: DataFrame, whole_parts: bool = False) -> DataFrame:
    """The conversations read back from formatted windows: conv, n_turns, turns (text: role,
    line feed, text, line feed for each turn), loss_text (the targets in order, unescaped),
    formatted_chars and n_windows (of all windows).

    A conversation's whole text is one value here. ``whole_parts``: each part is a whole
    conversation (``block_turns=None``), so that the windows stay where they were made.
    """
    split = F.split(F.col("formatted"), r"<\|end\|>", -1)
    pieces = F.slice(split, F.col("n_repeated") + 1, F.size(split) - 1 - F.col("n_repeated"))
    read = windows.withColumn("pieces", pieces)
    role = lambda x: unescape(F.substring_index(F.substring(x, len(TURN) + 1, 1 << 30), TEXT, 1))
    turn = F.transform("pieces", lambda x: F.concat(role(x), F.lit("\n"), unescape(F.substring_index(x, TEXT, -1)), F.lit("\n")))
    loss = F.transform("targets", lambda x: unescape(F.substring(F.col("formatted"), x["start"].cast("int") + 1, x["length"].cast("int"))))
    key = F.col("part") if whole_parts else F.struct("part.conv")
    read = read.select(
        key.alias("part"),
        "window",
        F.size("pieces").alias("n"),
        F.array_join(turn, "").alias("turns"),
        F.array_join(loss, "").alias("loss"),
        F.char_length("formatted").alias("chars"),
    )
    whole = read.groupBy("part").agg(
        F.sum("n").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"),
        F.sum("chars").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_windows"),
    )
    text = lambda name: F.array_join(F.transform("w", lambda x: x[name]), "")
    return whole.select(
        F.col("part.conv").alias("conv"),
        "n_turns",
        text("turns").alias("turns"),
        text("loss").alias("loss_text"),
        "formatted_chars",
        "n_windows",
    )
