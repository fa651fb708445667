"""Chat formatting with a finite-state machine over roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: state: {role: next state}.  A conversation is valid when it starts in "start" and ends in an accepting state.
MACHINE: dict[str, dict[str, str]] = {
    "start": {"system": "system", "user": "user"},
    "system": {"user": "user"},
    "user": {"assistant": "assistant"},
    "assistant": {"user": "user", "tool": "tool"},
    "tool": {"assistant": "assistant"},
}
ACCEPTING = ("assistant", "user")
#: role: segments of (text, loss); "{text}" stands for the turn's text.
TEMPLATE: dict[str, list[tuple[str, bool]]] = {
    "system": [("<|system|>\n", False), ("{text}", False), ("<|end|>\n", False)],
    "user": [("<|user|>\n", False), ("{text}", False), ("<|end|>\n", False)],
    "assistant": [("<|assistant|>\n", False), ("{text}", True), ("<|end|>\n", True)],
    "tool": [("<|tool|>\n", False), ("{text}", False), ("<|end|>\n", False)],
}


def _segments(template: dict[str, list[tuple[str, bool]]]) -> Column:
    out: Column = F.lit(None)
    for role, parts in template.items():
        made = F.array(*[F.struct(F.lit(i).alias("segment"), (F.col("text") if text == "{text}" else F.lit(text)).alias("segment_text"), F.lit(loss).alias("loss")) for i, (text, loss) in enumerate(parts)])
        out = F.when(F.col("role") == role, made).otherwise(out)
    return out


#: Turn numbers of a block.  A block is one row while roles are run through the machine, so this bounds a row.
BLOCK = 256


def _checked(machine: dict[str, dict[str, str]], accepting: tuple[str, ...], template: dict[str, list[tuple[str, bool]]]) -> tuple[list[str], dict[str, list[int]]]:
    """(states, number of the state that each role leads to from each state); -1 where the machine has no step."""
    states = ["start", *sorted({*machine, *[to for steps in machine.values() for to in steps.values()]} - {"start"})]
    roles = sorted({role for steps in machine.values() for role in steps})
    if lacking := sorted(set(roles) - set(template)):
        raise ValueError(f"the template lacks roles of the machine: {lacking}")
    if unknown := sorted(set(accepting) - set(states)):
        raise ValueError(f"no such states: {unknown}")
    place = {s: i for i, s in enumerate(states)}
    return states, {role: [place.get(machine.get(s, {}).get(role, ""), -1) for s in states] for role in roles}


def format_chats(conversations: DataFrame, machine: dict[str, dict[str, str]] = MACHINE, accepting: tuple[str, ...] = ACCEPTING, template: dict[str, list[tuple[str, bool]]] = TEMPLATE) -> DataFrame:
    """(conv_id, position, segment, role, segment_text, loss, error): the segments of valid conversations, in order.

    ``machine`` is any finite-state machine over roles, whose states need not be named
    by roles; it starts in "start" and must end in an ``accepting`` state.  Turns are in
    the order of their numbers; turns that agree in number are a fault.  A conversation
    with a fault has one row: null position, role and text, and the first of null_field
    (a null role, text or turn), repeated_turn, bad_transition, bad_end.  Empty texts are
    texts.  A null conv_id is a conversation of its own.  An empty table gives no rows;
    other columns are ignored, whatever their names.  A machine with a role that the
    template lacks, or an accepting state that it lacks, is refused.

    A conversation is never in one task as a whole: equal turn numbers are counted before
    the shuffle, blocks of BLOCK turn numbers become functions from state to state, and
    these, one short row a block, are composed by conversation.  Texts go through one
    shuffle by block.
    """
    states, steps = _checked(machine, accepting, template)
    turns = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text", F.floor(F.col("turn") / F.lit(BLOCK)).cast("bigint").alias("_block"))
    each = turns.groupBy("conv_id", "_block", "turn").agg(F.count("*").alias("n"), F.min("role").alias("role"), F.max(F.col("turn").isNull() | F.col("role").isNull() | F.col("text").isNull()).alias("lacks"))
    table = F.create_map(*[x for role, to in steps.items() for x in (F.lit(role), F.array(*map(F.lit, to)))]) if steps else F.create_map().cast("map<string,array<int>>")
    step = lambda state, role: F.when(state < 0, F.lit(-1)).otherwise(F.coalesce(F.try_element_at(table, role)[F.greatest(state, F.lit(0))], F.lit(-1)))
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.coalesce(x["role"], F.lit("")))
    blocks = each.groupBy("conv_id", "_block").agg(F.count("*").alias("turns"), F.max("lacks").alias("lacks"), F.max(F.col("n") > 1).alias("repeats"), roles.alias("roles"))
    becomes = F.array(*[F.aggregate("roles", F.lit(i), step) for i in range(len(states))])
    blocks = blocks.select("conv_id", "_block", "turns", "lacks", "repeats", becomes.alias("becomes"))
    path = F.transform(F.array_sort(F.collect_list(F.struct("_block", "becomes"))), lambda x: x["becomes"])
    whole = blocks.groupBy("conv_id").agg(F.max("lacks").alias("lacks"), F.max("repeats").alias("repeats"), path.alias("path"))
    end = F.aggregate("path", F.lit(0), lambda state, to: F.when(state < 0, F.lit(-1)).otherwise(to[F.greatest(state, F.lit(0))]))
    last = [states.index(x) for x in accepting]
    fault = F.when(F.col("lacks"), "null_field").when(F.col("repeats"), "repeated_turn").when(F.col("end") < 0, "bad_transition").when(~F.col("end").isin(last), "bad_end")
    judged = whole.withColumn("end", end).select("conv_id", fault.alias("error"))
    good = judged.where("error IS NULL").select(F.col("conv_id").alias("_conv"))
    before = F.sum("turns").over(Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    places = blocks.select("conv_id", "_block", "turns").join(good, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(F.col("conv_id").alias("_conv"), F.col("_block").alias("_b"), F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "_block").orderBy("turn")) - 1
    kept = turns.join(places, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_block") == F.col("_b"))).withColumn("position", (F.col("_before") + inside).cast("bigint"))
    out = kept.select("conv_id", "position", "role", F.inline(_segments(template)), F.lit(None).cast("string").alias("error"))
    none = {"position": "bigint", "role": "string", "segment": "int", "segment_text": "string", "loss": "boolean"}
    bad = judged.where("error IS NOT NULL").select("conv_id", *[F.lit(None).cast(t).alias(c) for c, t in none.items()], "error")
    return out.select(bad.columns).unionByName(bad)


def chats_sql() -> str:
    steps = ", ".join(f"'{s}>{r}'" for s, x in MACHINE.items() for r in x)
    parts = " UNION ALL ".join(
        f"SELECT conv_id, position, role, {i} AS segment, " + ("text" if t == "{text}" else "'" + t.replace("\n", "' || chr(10) || '") + "'") + f" AS segment_text, {str(loss).lower()} AS loss, error FROM j WHERE error IS NULL AND role = '{role}'"
        for role, segments in TEMPLATE.items()
        for i, (t, loss) in enumerate(segments)
    )
    return f"""
    WITH t AS (
      SELECT *, row_number() OVER w - 1 AS position, coalesce(lag(role) OVER w, 'start') AS before, lag(turn) OVER w AS prior,
             row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS final
      FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
    f AS (SELECT *, CASE WHEN turn IS NULL OR role IS NULL OR text IS NULL THEN '1null_field' WHEN turn = prior THEN '2repeated_turn'
            WHEN before || '>' || role NOT IN ({steps}) THEN '3bad_transition' WHEN final AND role NOT IN {ACCEPTING} THEN '4bad_end' END AS fault FROM t),
    j AS (SELECT conv_id, position, role, text, substr(min(fault) OVER (PARTITION BY conv_id), 2) AS error FROM f)
    {parts}
    UNION ALL SELECT conv_id, NULL, NULL, NULL, NULL, NULL, error FROM j WHERE error IS NOT NULL AND position = 0
    """
