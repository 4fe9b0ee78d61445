"""Chat formatting into budgeted windows, in DataFrame code only.

Every turn is written ``<|im_start|>role``, a newline, the text, ``<|im_end|>`` and a
newline.  In texts ``&`` becomes ``&amp;`` and ``<|`` becomes ``&lt;|`` (in roles a
newline also becomes ``&nl;``), so no text can hold a marker and reading back is exact.

Prefix sums of the turns' tokens choose the windows: a window's own turns are those
whose last token falls into one span of the conversation's tokens.  Spans are the
budget less the system turn, the history and one turn's limit; so a window keeps to
the budget unless a turn is longer than that limit (such a turn stays whole and
``over_budget`` says so).  A window starts with the conversation's first system turn,
if that came before, and with as many last turns of the previous window as the
history allows.  The loss mask covers assistant texts among the window's own turns:
repeated ones are masked, so each assistant text is a target exactly once.

A conversation of at most ``MOST_TURNS`` turns and ``MOST_BYTES`` of text is gathered in
one row, where its windows are cut; its text is shuffled once.  Larger ones (one
conversation may hold much of the table, as rows without an id form one) are sorted
by ranges of (conversation, turn, role, text), so no task needs a whole conversation:
prefix sums over the rows' places are taken in two steps, over blocks of places and
within them, without the texts, and only a window's turns are gathered, which the
budget bounds.  Both ways give the same windows.  Only ``digests``, which hashes whole
conversations, brings a conversation's text into one row.

Defined results: null texts and roles count as empty; turns are ordered by number
(nulls first), role and text; repeated rows are repeated turns; conversations with a
null id form one conversation; a turn may be as long as a row may; an empty table gives
no window; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

BUDGET, HISTORY, TURN_LIMIT = 2048, 256, 768
TOKEN = r"\p{L}+|\p{N}|[^ \t\n\r\p{L}\p{N}]"
#: Tokens of a turn besides its text.
OVERHEAD = 4
#: What a conversation that is gathered in one row may have.
MOST_TURNS, MOST_BYTES = 4096, 4 << 20
#: Places that a task sums up at once, as a power of two.
BLOCK_BITS = 10
#: Ids of larger conversations that are broadcast at most (8 bytes each); more are joined by shuffle.
MOST_BROADCAST = 100_000
START, END = "<|im_start|>", "<|im_end|>\n"
SYSTEM, ASSISTANT = "system", "assistant"


def _replace(x: Column, what: str, by: str) -> Column:
    return F.replace(x, F.lit(what), F.lit(by))


def escape(x: Column) -> Column:
    return _replace(_replace(x, "&", "&amp;"), "<|", "&lt;|")


def unescape(x: Column) -> Column:
    return _replace(_replace(x, "&lt;", "<"), "&amp;", "&")


def _turns(conversations: DataFrame) -> DataFrame:
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))


def _tokens(text: str = "text") -> Column:
    return (F.regexp_count(text, F.lit(TOKEN)) + OVERHEAD).cast("long")


def _large(turns: DataFrame, most_turns: int, most_bytes: int) -> tuple[DataFrame | None, int]:
    """The ids of conversations that aren't gathered in one row, and their number; numbers only are shuffled."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("b"))
    large = shared.materialize(sizes.where((F.col("n") > most_turns) | (F.col("b") > most_bytes)).select(F.col("conv_id").alias("large_id")), "chat-large")
    n = large.count()
    return (F.broadcast(large) if n <= MOST_BROADCAST else large) if n else None, n


def _room(budget: int, history: int, turn_limit: int, system: Column) -> Column:
    """Tokens of own turns that a window has room for."""
    return F.greatest(F.lit(1), F.lit(budget - history - turn_limit) - F.coalesce(system, F.lit(0)))


def _gathered_rows(turns: DataFrame, budget: int, history: int, turn_limit: int) -> DataFrame:
    """(conv_id, window, turns) of conversations that fit a row: gathered once, then cut by array functions."""
    row = F.struct("turn", "role", "text", _tokens().alias("tokens"))
    whole = turns.select("conv_id", row.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    sums = F.aggregate(
        F.transform("t", lambda x: x["tokens"]),
        F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("ends")),
        lambda a, n: F.struct((a["s"] + n).alias("s"), F.array_append(a["ends"], a["s"] + n).alias("ends")),
        lambda a: a["ends"],
    )
    # r: the place of the retained system turn, from 1; 0 without one
    placed = whole.select("conv_id", "t", sums.alias("ends"), F.array_position(F.transform("t", lambda x: x["role"]), SYSTEM).cast("int").alias("r"))
    room = _room(budget, history, turn_limit, F.when(F.col("r") > 0, F.get("t", F.col("r") - 1)["tokens"]))
    spans = placed.select("*", room.alias("room")).select("*", F.transform("ends", lambda e: F.floor((e - 1) / F.col("room"))).alias("w"))
    spans = spans.select("*", F.array_distinct("w").alias("windows"))
    starts = spans.select("*", F.transform("windows", lambda x: F.array_position("w", x).cast("int")).alias("starts"))

    def window(x: Column, k: Column) -> Column:
        first = F.get("starts", k)
        size = F.coalesce(F.get("starts", k + 1), F.size("t") + 1) - first
        last = F.get("ends", first - 2)  # the tokens before the window
        past = F.when(k > 0, F.sequence(F.get("starts", k - 1), first - 1)).otherwise(F.array().cast("array<int>"))
        recent = F.filter(past, lambda i: (i != F.col("r")) & (last - F.get("ends", i - 1) + F.get("t", i - 1)["tokens"] <= history))
        system = F.when((F.col("r") > 0) & (F.col("r") < first), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
        own = F.sequence(first, first + size - 1)

        def turn(kind: int, at: Column) -> Column:
            one = F.get("t", at - 1)
            return F.struct(F.lit(kind).alias("kind"), one["role"].alias("role"), one["text"].alias("text"), one["tokens"].alias("tokens"))

        parts = F.concat(F.transform(system, lambda i: turn(0, F.col("r"))), F.transform(recent, lambda i: turn(1, i)), F.transform(own, lambda i: turn(2, i)))
        return F.struct(x.alias("window"), parts.alias("turns"))

    return starts.select("conv_id", F.explode(F.transform("windows", window)).alias("x")).select("conv_id", "x.window", "x.turns")


def _sorted_rows(turns: DataFrame, budget: int, history: int, turn_limit: int) -> DataFrame:
    """(conv_id, window, turns) of conversations of any size: rows sorted by ranges, windows chosen without texts."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ranged = turns.select("*", _tokens().alias("tokens")).repartitionByRange(*order).sortWithinPartitions(*order)
    table = shared.materialize(ranged.select("conv_id", "role", "text", "tokens", F.monotonically_increasing_id().alias("place")), "chat-sorted")
    rows = table.select("conv_id", "place", "tokens", (F.col("role") == SYSTEM).cast("long").alias("is_system"), F.shiftright("place", BLOCK_BITS).alias("block"))
    before = "over (partition by conv_id order by block rows between unbounded preceding and 1 preceding)"
    blocks = rows.groupBy("conv_id", "block").agg(F.sum("tokens").alias("t"), F.sum("is_system").alias("s"))
    blocks = blocks.select(F.col("conv_id").alias("b_conv"), F.col("block").alias("b_block"), F.expr(f"coalesce(sum(t) {before}, 0)").alias("t"), F.expr(f"coalesce(sum(s) {before}, 0)").alias("s"))
    upto = "over (partition by conv_id, block order by place rows unbounded preceding)"
    sums = rows.join(blocks, F.col("conv_id").eqNullSafe(F.col("b_conv")) & (F.col("block") == F.col("b_block"))).select(
        "conv_id", "place", "tokens", F.expr(f"t + sum(tokens) {upto}").alias("end"), F.expr(f"is_system = 1 and s + sum(is_system) {upto} = 1").alias("retained")
    )
    sums = shared.materialize(sums, "chat-sums")
    heads = sums.where("retained").select(F.col("conv_id").alias("s_conv"), F.col("tokens").alias("s_tokens"))
    room = _room(budget, history, turn_limit, F.col("s_tokens"))
    own = sums.join(heads, F.col("conv_id").eqNullSafe(F.col("s_conv")), "left").select("conv_id", "place", "tokens", "end", "retained", F.floor((F.col("end") - 1) / room).alias("window"))
    spans = own.groupBy("conv_id", "window").agg(F.max("end").alias("last")).select(F.col("conv_id").alias("w_conv"), F.col("window").alias("w"), "last", F.expr("lead(window) over (partition by conv_id order by window)").alias("following"))
    same = F.col("conv_id").eqNullSafe(F.col("w_conv"))
    repeated = own.join(spans, same & (F.col("window") == F.col("w"))).where(F.col("following").isNotNull() & ~F.col("retained") & (F.col("last") - F.col("end") + F.col("tokens") <= history))
    system = spans.join(own.where("retained"), same & (F.col("w") > F.col("window")))
    dealt = own.select("place", "window", F.lit(2).alias("kind")).unionAll(repeated.select("place", "following", F.lit(1))).unionAll(system.select("place", "w", F.lit(0)))
    turn = F.struct("kind", "place", "role", "text", "tokens")
    gathered = table.join(dealt, "place").groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return gathered.select("conv_id", "window", F.transform("turns", lambda x: F.struct(x["kind"].alias("kind"), x["role"].alias("role"), x["text"].alias("text"), x["tokens"].alias("tokens"))).alias("turns"))


def _formatted(gathered: DataFrame, budget: int) -> DataFrame:
    head = lambda t: F.concat(F.lit(START), _replace(escape(t["role"]), "\n", "&nl;"), F.lit("\n"))
    pieces = F.transform("turns", lambda x: F.struct(x["kind"].alias("kind"), x["role"].alias("role"), head(x).alias("head"), escape(x["text"]).alias("body"), x["tokens"].alias("tokens")))
    gathered = gathered.select("conv_id", "window", pieces.alias("pieces"))
    spots = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["head"]) + F.length(x["body"]) + len(END)).alias("at"),
            F.when((x["kind"] == 2) & (x["role"] == ASSISTANT), F.array_append(a["loss"], F.struct((a["at"] + F.length(x["head"])).alias("start"), F.length(x["body"]).alias("length")))).otherwise(a["loss"]).alias("loss"),
        ),
        lambda a: a["loss"],
    )
    tokens = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    return gathered.select(
        "conv_id",
        "window",
        F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"),
        F.size(F.filter("pieces", lambda x: x["kind"] < 2)).alias("n_context"),
        F.size("pieces").alias("n_turns"),
        spots.alias("loss"),
        tokens.alias("n_tokens"),
        (tokens > budget).alias("over_budget"),
    )


def _parts(conversations: DataFrame, budget: int, history: int, turn_limit: int, most_turns: int, most_bytes: int) -> list[DataFrame]:
    """The windows of conversations that fit a row, and of the others if there are any; a conversation is in one of them."""
    if budget <= history + turn_limit:
        raise ValueError("the budget must exceed the history and one turn")
    turns = _turns(conversations)
    large, n = _large(turns, most_turns, most_bytes)
    if not n:
        return [_formatted(_gathered_rows(turns, budget, history, turn_limit), budget)]
    same = F.col("conv_id").eqNullSafe(F.col("large_id"))
    rest, those = turns.join(large, same, "left_anti"), turns.join(large, same, "left_semi")
    return [_formatted(_gathered_rows(rest, budget, history, turn_limit), budget), _formatted(_sorted_rows(those, budget, history, turn_limit), budget)]


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, turn_limit: int = TURN_LIMIT, most_turns: int = MOST_TURNS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(conv_id, window, formatted, n_context, n_turns, loss, n_tokens, over_budget).

    ``window`` orders a conversation's windows; the first ``n_context`` of the
    ``n_turns`` turns are repeated ones; ``loss`` lists the (start, length) in code
    points of ``formatted`` that are targets.
    """
    first, *more = _parts(conversations, budget, history, turn_limit, most_turns, most_bytes)
    return first.unionAll(more[0]) if more else first


def window_digests(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, turn_limit: int = TURN_LIMIT, most_turns: int = MOST_TURNS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """digests(windows(...)); windows that were cut from one row are read back where they are, without another shuffle."""
    first, *more = map(digests, _parts(conversations, budget, history, turn_limit, most_turns, most_bytes))
    return first.unionAll(more[0]) if more else first


def read_back(formatted: DataFrame) -> DataFrame:
    """From windows: (conv_id, window, turns, targets) with the window's own turns as (role, text), unescaped."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>"), F.col("n_context") + 2, F.greatest(F.lit(0), F.col("n_turns") - F.col("n_context")))

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        body = F.substring(x, F.length(role) + 2, F.length(x) - F.length(role) - 1 - len(END))
        return F.struct(unescape(_replace(role, "&nl;", "\n")).alias("role"), unescape(body).alias("text"))

    targets = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.select("conv_id", "window", F.transform(pieces, turn).alias("turns"), targets.alias("targets"), F.length("formatted").cast("long").alias("chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """Of each conversation, from its windows: turns, their hash, the loss text's length and hash, all characters."""
    part = read_back(formatted).select(
        "conv_id",
        "window",
        F.size("turns").cast("long").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join("targets", "").alias("loss"),
        "chars",
    )
    whole = part.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("parts"), F.sum("chars").alias("formatted_chars"))
    joined = whole.select("conv_id", "n_turns", F.array_join("parts.turns", "").alias("turns"), F.array_join("parts.loss", "").alias("loss"), "formatted_chars")
    return joined.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
