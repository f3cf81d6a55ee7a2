"""Conversations: faults of their turns and the cheapest repair.

A conversation is well formed when the initials of its roles read `(s?(ua)+)?`.
Windows flag each turn's faults; the sorted turns of a conversation are then
folded by `aggregate()`.  The fold carries four (cost, audit) structs, one for
what the repaired turns may end with: nothing, system, user or assistant.  Each
turn is kept (0), given the role user or assistant (1) or deleted (2), and turns
without text may be inserted anywhere (5).  Blank and repeated turns must go; a
truncated turn that stays costs 5 more.  `least` keeps the cheapest way into each
state, of equally cheap ones the one whose audit is least.

That is exact: of two equally cheap ways to the same place neither audit begins
with the other (the longer one would have only insertions more, and they cost),
so whatever follows leaves them in the same order.

Long conversations are folded in blocks of BLOCK turns, each from any of the four
states, and the blocks' results are chained: audits then grow by blocks, not by
turns.  What a conversation has to be held for at once is its repaired text.

Null roles and texts are one space.  Turns go by number, nulls first; turns of
one number by role, then text.  A role without letters can't be kept.  Rows
without a conv_id are one conversation.  A span of turn numbers beyond a long
has the gaps null.  Only the four columns named are read, whatever else the table
has; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns folded at once.
BLOCK = 256

KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
#: What a truncated turn that stays costs beside.
TRUNCATED = 5
#: States: what the repaired turns end with.
STATES = ("nothing", "system", "user", "assistant")

_SPACE = " \t\n\x0b\x0c\r"
_BLANK, _DUPLICATE, _CUT = 1, 2, 3
_WAY = "struct<cost:bigint,audit:string>"
_WAYS = f"struct<{','.join(f'{s}:{_WAY}' for s in STATES)}>"

# The fold is written as SQL: an expression of so many parts takes seconds to build call by call.


def _way(cost: int = 0, audit: str = "") -> str:
    return f"named_struct('cost', {cost}L, 'audit', '{audit}')"


def _ways(ways: dict[str, str]) -> str:
    return f"named_struct({', '.join(f"'{s}', {ways[s]}" for s in STATES)})"


def _then(way: str, cost: str, letter: str, allowed: str = "true") -> str:
    """A way with one edit more; null where there is no such way.

    While folding, J is an inserted assistant and S a turn made an assistant's, I
    and R are the user's.  What an audit began with decides which of the two can
    follow, so audits have the same order as with I and R alone.
    """
    return f"if({way} IS NOT NULL AND {allowed}, named_struct('cost', {way}.cost + {cost}, 'audit', concat({way}.audit, '{letter}')), NULL)"


def _turn(now: str, turn: str) -> str:
    """The ways after one turn more."""
    stays, more = f"{turn}.fault NOT IN ({_BLANK}, {_DUPLICATE})", f"if({turn}.fault = {_CUT}, {TRUNCATED}, 0)"
    before_user = f"least({now}.nothing, {now}.system, {now}.assistant)"
    gone = {s: _then(f"{now}.{s}", str(DELETE), "D") for s in STATES}
    kept = lambda way, initial: _then(way, f"{KEEP} + {more}", "K", f"{stays} AND {turn}.initial = '{initial}'")
    return _ways({
        "nothing": gone["nothing"],
        "system": f"least({gone['system']}, {kept(f'{now}.nothing', 's')})",
        "user": f"least({gone['user']}, {kept(before_user, 'u')}, {_then(before_user, f'{REROLE} + {more}', 'R', stays)})",
        "assistant": f"least({gone['assistant']}, {kept(f'{now}.user', 'a')}, {_then(f'{now}.user', f'{REROLE} + {more}', 'S', stays)})",
    })


def _inserted(now: str) -> str:
    """The ways after what may be inserted behind a turn."""
    user = f"least({now}.user, {_then(f'least({now}.nothing, {now}.system, {now}.assistant)', str(INSERT), 'I')})"
    return _ways({"nothing": f"{now}.nothing", "system": f"{now}.system", "user": user, "assistant": f"least({now}.assistant, {_then(user, str(INSERT), 'J')})"})


def _start(state: str) -> str:
    """At `state` at no cost; where nothing is there yet, turns may be inserted."""
    ways = {s: _way() if s == state else f"CAST(NULL AS {_WAY})" for s in STATES}
    if state == "nothing":
        ways |= {"user": _way(INSERT, "I"), "assistant": _way(2 * INSERT, "IJ")}
    return _ways(ways)


def _fold(turns: str, state: str) -> str:
    # transform() over one element gives the ways after the turn a name
    return f"aggregate({turns}, {_start(state)}, (now, turn) -> transform(array({_turn('now', 'turn')}), then -> {_inserted('then')})[0])"


def _chained(parts: str) -> str:
    """The ways after all blocks: each way so far with the next block's ways from its state on."""

    def joined(at: str, to: str) -> str:
        a, b = f"now.{at}", f"part.ways.{at}.{to}"
        return f"if({a} IS NOT NULL AND {b} IS NOT NULL, named_struct('cost', {a}.cost + {b}.cost, 'audit', concat({a}.audit, {b}.audit)), NULL)"

    step = _ways({to: f"least({', '.join(joined(at, to) for at in STATES)})" for to in STATES})
    return f"aggregate(slice({parts}, 2, size({parts})), {parts}[0].ways.nothing, (now, part) -> {step})"


def flagged(turns: DataFrame, absent: str | None = None) -> DataFrame:
    """Every turn with place (from 1), initial, fault (0, 1 blank, 2 duplicate, 3 truncated), illegal and new_turn (another number than the turn before).

    Rows in which the boolean column `absent` holds aren't turns: they come last and have no place, but keep their conversation in the result.
    """
    gone = F.coalesce(F.col(absent), F.lit(False)) if absent else F.lit(False)
    text_of = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    rows = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), text_of("role"), text_of("text"), gone.alias("gone"))
    order = Window.partitionBy("conv_id").orderBy("gone", F.asc_nulls_first("turn"), "role", "text")
    rows = rows.select("*", F.row_number().over(order).alias("place"), F.substring("role", 1, 1).alias("initial"), F.lag("role").over(order).alias("before"), F.lag("turn").over(order).alias("turn_before"))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("place")) > 1
    ended = F.rtrim("text", F.lit(_SPACE))
    fault = F.when(ended == "", _BLANK).when(again, _DUPLICATE).when(~F.substring(ended, -1, 1).isin(".", "!", "?"), _CUT).otherwise(0)
    illegal = F.col("before").isNotNull() & ~F.concat(F.substring("before", 1, 1), "initial").isin("su", "ua", "au")
    rows = rows.select("conv_id", "turn", "role", "text", "gone", "place", "initial", fault.alias("fault"), illegal.alias("illegal"), (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))).alias("new_turn"))
    return rows


def repaired(turns: DataFrame, absent: str | None = None) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, and repaired (its turns as structs of role and text)."""
    rows = flagged(turns, absent).withColumn("here", ~F.col("gone"))
    here = lambda column: F.sum(F.when(F.col("here") & column, 1).otherwise(0)).cast("bigint")
    turn = F.when(F.col("here"), F.col("turn"))
    item = F.when(F.col("here"), F.struct("place", "initial", "fault", "role", "text"))
    blocks = rows.groupBy("conv_id", F.floor((F.col("place") - 1) / BLOCK).alias("block")).agg(
        F.array_sort(F.collect_list(item)).alias("turns"),
        F.min(turn).alias("first"), F.max(turn).alias("last"), here(F.col("new_turn")).alias("numbers"),
        *(here(F.col("fault") == k).alias(name) for k, name in ((_BLANK, "blank"), (_DUPLICATE, "duplicate"), (_CUT, "truncated"))),
        here(F.col("illegal")).alias("illegal"),
    )
    narrow = F.transform("turns", lambda t: F.struct(t["initial"].alias("initial"), t["fault"].alias("fault")))
    blocks = blocks.withColumn("narrow", narrow)
    # the first block begins with nothing
    each = ", ".join(f"'{s}', {_fold('narrow', s)}" if s == "nothing" else f"'{s}', if(block = 0, CAST(NULL AS {_WAYS}), {_fold('narrow', s)})" for s in STATES)
    ways = F.expr(f"named_struct({each})")
    blocks = blocks.withColumn("part", F.struct("block", ways.alias("ways"), "turns")).drop("turns", "narrow")
    whole = blocks.groupBy("conv_id").agg(
        F.array_sort(F.collect_list("part")).alias("parts"),
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("numbers").alias("numbers"),
        *(F.sum(name).alias(name) for name in ("blank", "duplicate", "truncated", "illegal")),
    )
    whole = whole.withColumn("ends", F.expr(_chained("parts"))).withColumn("best", F.least("ends.nothing", "ends.assistant")).withColumn("turns", F.flatten("parts.turns"))
    span = F.try_subtract(F.try_add(F.try_subtract("last", "first"), F.lit(1).cast("bigint")), F.col("numbers"))
    gaps = F.when(F.col("first").isNull(), F.lit(0).cast("bigint")).otherwise(span)
    return whole.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), F.translate("best.audit", "JS", "IR").alias("audit"), _applied(F.col("turns"), F.col("best.audit")).alias("repaired"))


def _applied(turns: Column, audit: Column) -> Column:
    """The turns that an audit leaves: for each turn the insertions before it and its edit, at last the insertions at the end."""
    made = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    empty = F.array().cast("array<struct<role:string,text:string>>")

    def inserted(marks: Column) -> Column:
        letters = F.filter(F.split(marks, ""), lambda c: c != "")
        return F.transform(letters, lambda c: made(F.when(c == "I", F.lit("user")).otherwise(F.lit("assistant")), F.lit("")))

    def edited(edit: Column, turn: Column) -> Column:
        mark = F.substring(edit, -1, 1)
        role = F.when(mark == "R", F.lit("user")).when(mark == "S", F.lit("assistant")).otherwise(turn["role"])
        stays = F.when(mark == "D", empty).otherwise(F.array(made(role, turn["text"])))
        return F.when(F.length(edit) == 1, stays).otherwise(F.concat(inserted(F.regexp_replace(edit, "[DKRS]", "")), stays))

    edits = F.regexp_extract_all(audit, F.lit("[IJ]*[DKRS]"), F.lit(0))
    return F.concat(F.flatten(F.zip_with(edits, turns, edited)), inserted(F.regexp_extract(audit, "[IJ]*$", 0)))


def digest(column: Column) -> Column:
    """SHA-256 of repaired turns as lines `role:text`, in lowercase hex."""
    return F.sha2(F.array_join(F.transform(column, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n"), 256)


def damaged(turns: DataFrame) -> DataFrame:
    """Turns damaged by the crc32 of `conv_id:turn` modulo 20: 0 drops a turn (dropped is true), 1 empties its text, 2 removes its `[.!?]`, 3 repeats it, 4 makes it a user's."""
    text_of = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    rows = turns.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), times.alias("copy")).drop("copy")


def damaged_and_repaired(turns: DataFrame) -> DataFrame:
    """What repairing the damaged conversations finds and does, with the digest of what comes out."""
    found = repaired(damaged(turns), absent="dropped")
    return found.withColumn("repaired_sha256", digest(F.col("repaired"))).drop("repaired")
