r"""Chat formatting in budgeted windows, with DataFrame functions only.

A turn becomes ``<|im_start|>role`` line end ``text<|im_end|>`` line end. Control strings inside
roles and texts get a backslash after their first character, backslashes are doubled, and a
line end inside a role gets a backslash before it; taking every backslash away restores them.

Prefix sums of turn tokens cut a conversation into windows of whole turns. With the system
turn's tokens S, the stride is half of budget - history - S (a quarter of the budget at least),
and a turn belongs to window floor(tokens before it / stride). So a window keeps to the budget
unless a single turn is longer than the stride. Every window starts with the system turn, then
the turns before it that lie within ``history`` tokens, then its own. Repeated turns are
masked: the loss covers the texts of a window's own assistant turns.

The sums are taken in two steps, inside blocks of turns and over blocks, so that a long
conversation is spread over tasks; windows are bounded by the budget.

Null roles and texts are empty. Turns are ordered by turn, role, text; ties and repeated rows are
turns of their own; a null turn comes first, and rows with a null conversation form one. The
system turn is the first one, if its role is system. An empty table gives no windows. Other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Strings that open or close something in common templates: fixed values.
CONTROL = r"<(?=\|)|<(?=/?s>)|<(?=</?SYS>>)|\[(?=/?INST\])"
#: What counts as one token where a table has no token counts.
TOKEN = r"[A-Za-z0-9]+|[^ \t\n\rA-Za-z0-9]"
TURN_BLOCK = 1024


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"({CONTROL})", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _placed(conversations: DataFrame, tokens: Column | None) -> DataFrame:
    """Rows with their number ``n`` in the conversation and the tokens ``before`` them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        text.alias("text"), (tokens if tokens is not None else F.regexp_count(text, F.lit(TOKEN)) + 4).cast("long").alias("tokens"),
        F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / TURN_BLOCK).alias("block"),
    ).withColumn("conv", F.coalesce(F.xxhash64("conv_id"), F.lit(0)))
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    inside = Window.partitionBy("conv", "conv_id", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({
        "n": F.count(F.lit(1)).over(inside), "upto": F.sum("tokens").over(inside),
    })
    blocks = rows.groupBy("conv", "conv_id", "block").agg(F.count(F.lit(1)).alias("rows"), F.sum("tokens").alias("sum"))
    earlier = Window.partitionBy("conv", "conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("conv").alias("c"), F.col("conv_id").alias("i"), F.col("block").alias("b"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("n0"),
        F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before0"),
    )
    same = (F.col("conv") == F.col("c")) & F.col("conv_id").eqNullSafe(F.col("i")) & (F.col("block") == F.col("b"))
    return rows.join(blocks, same).select(
        "conv", "conv_id", (F.col("n0") + F.col("n") - 1).alias("n"), "role", "text", "tokens",
        (F.col("before0") + F.col("upto") - F.col("tokens")).alias("before"),
    )


def format_windows(conversations: DataFrame, budget: int = 1024, history: int = 256, tokens: Column | None = None) -> DataFrame:
    """(conv_id, window, formatted, n_repeated, loss, n_tokens) of every window.

    ``loss`` lists (start, length) in characters of ``formatted``; the first ``n_repeated``
    turns of a window have been, or are, a window's own elsewhere.
    """
    rows = _placed(conversations, tokens)
    system = rows.where((F.col("n") == 0) & (F.col("role") == "system"))
    heads = system.select(F.col("conv").alias("c"), F.col("conv_id").alias("i"), F.col("tokens").alias("head"))
    here = (F.col("conv") == F.col("c")) & F.col("conv_id").eqNullSafe(F.col("i"))
    rest = rows.where((F.col("n") > 0) | (F.col("role") != "system")).join(heads, here, "left").drop("c", "i")
    rest = rest.withColumns({
        "before": F.col("before") - F.coalesce("head", F.lit(0)),
        "stride": F.greatest(F.floor((F.lit(budget - history) - F.coalesce("head", F.lit(0))) / 2), F.lit(max(1, budget // 4))),
    }).withColumn("window", F.floor(F.col("before") / F.col("stride")))
    starts = rest.groupBy(F.col("conv").alias("c"), F.col("conv_id").alias("i"), F.col("window").alias("w")).agg(F.min("before").alias("start"))
    # with history no longer than the stride, a turn can be history of the next window only
    next_one = here & (F.col("w") == F.col("window") + 1)
    past = rest.join(starts, next_one).where(
        F.col("start") - F.col("before") <= F.least(F.lit(history), F.col("stride"))
    )
    columns = ["conv", "conv_id", "window", "n", "repeated", "role", "text", "tokens"]
    own = rest.withColumn("repeated", F.lit(False))
    again = past.withColumn("repeated", F.lit(True)).withColumn("window", F.col("w"))
    first = system.withColumns({"window": F.lit(0).cast("long"), "repeated": F.lit(False)})
    later = starts.where("w > 0").join(
        system.withColumnsRenamed({"conv": "sc", "conv_id": "si"}),
        (F.col("sc") == F.col("c")) & F.col("si").eqNullSafe(F.col("i")),
    ).select(F.col("c").alias("conv"), F.col("i").alias("conv_id"), F.col("w").alias("window"), "n", F.lit(True).alias("repeated"), "role", "text", "tokens")
    turns = own.select(columns).unionByName(again.select(columns)).unionByName(first.select(columns)).unionByName(later.select(columns))
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    turns = turns.withColumns({
        "opening": F.concat(F.lit(START), role, F.lit("\n")), "body": escape(F.col("text")),
    }).withColumns({"skip": F.char_length("opening"), "chars": F.char_length("body")})
    upto = Window.partitionBy("conv", "conv_id", "window").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(F.col("skip") + F.col("chars") + len(END)).over(upto), F.lit(0)))
    learnt = ~F.col("repeated") & (F.col("role") == "assistant")
    span = F.struct((F.col("at") + F.col("skip")).alias("start"), F.col("chars").cast("long").alias("length"))
    return turns.groupBy("conv", "conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("n", F.concat("opening", "body", F.lit(END)).alias("s")))).alias("parts"),
        F.sum(F.col("repeated").cast("int")).cast("int").alias("n_repeated"),
        F.sort_array(F.collect_list(F.when(learnt, span))).alias("loss"),
        F.sum("tokens").alias("n_tokens"),
    ).select("conv_id", "window", F.array_join("parts.s", "").alias("formatted"), "n_repeated", "loss", "n_tokens")


def read_back(windows: DataFrame) -> DataFrame:
    """Turns and learnt texts of every window, taken from what ``format_windows`` wrote.

    ``turns`` holds role, line end, text, line end for each of the window's own turns; the
    repeated ones are left out.
    """
    marked = F.split("formatted", r"<\|im_end\|>\n")
    own = F.slice(marked, F.col("n_repeated") + 1, F.size(marked) - 1 - F.col("n_repeated"))
    opened = rf"(?s)^<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*)$"

    def plain(part: Column) -> Column:
        return F.concat(unescape(F.regexp_extract(part, opened, 1)), F.lit("\n"), unescape(F.regexp_extract(part, opened, 2)), F.lit("\n"))

    return windows.select(
        "conv_id", "window", F.size(own).alias("n_turns"), F.array_join(F.transform(own, plain), "").alias("turns"),
        F.array_join(
            F.transform("loss", lambda s: unescape(F.substring("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""
        ).alias("learnt"),
        F.char_length("formatted").cast("long").alias("chars"),
    )


def digests(windows: DataFrame) -> DataFrame:
    """One row per conversation: counts and digests of all that its windows hold."""
    ordered = read_back(windows).groupBy("conv_id").agg(
        F.sum("n_turns").cast("long").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("window", "turns", "learnt"))).alias("parts"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    learnt = F.array_join("parts.learnt", "")
    return ordered.select(
        "conv_id", "n_turns", F.sha2(F.array_join("parts.turns", ""), 256).alias("turns_sha256"),
        F.char_length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def control_conversation(like: DataFrame) -> DataFrame:
    """Conversation -7, whose texts are control strings, with the column types of ``like``."""
    kinds = {f.name: f.dataType for f in like.schema}
    two = like.sparkSession.range(2)
    return two.select(
        F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
