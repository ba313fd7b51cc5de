"""Chat formatting in windows of a token budget.

A conversation's turns stand in order of (turn, role, text), nulls first. Prefix sums of their token counts choose
windows of whole turns: a window grows until the next turn would pass the budget. Every window after the first shows the
leading system turn again and up to HISTORY turns before its own, as far as these fill no more than a quarter of the
budget. Only assistant turns that are new in a window are under its loss mask, so each is a target once. A turn longer
than the budget has a window of its own; none is dropped or cut.

Template: `<<SYS>>text<</SYS>>`, `[INST]text[/INST]`, `<s>text</s>` for system, user and assistant, and
`[ROLE:name]text[/ROLE]` (`[ROLE]` for null) for any other role. Inside texts and names, the characters \\ [ < ] become
\\0 \\1 \\2 \\3, so that no control string can stand there, and back when read.

Null text is empty. Turns of a null conversation id form one conversation. Repeated rows are turns of their own. Other
columns never enter. A conversation is read as a whole by one task, as its digest is of all its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY, TURN_COST = 512, 2, 2

# Fixed values of the template.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
ESCAPES = (("\\", "\\0"), ("[", "\\1"), ("<", "\\2"), ("]", "\\3"))
TURN = r"(<<SYS>>|\[INST\]|<s>|\[ROLE(?::[^\]]*)?\])([^<\[]*)(?:<</SYS>>|\[/INST\]|</s>|\[/ROLE\])"


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _mark(role: Column, end: int) -> Column:
    other = F.lit("[/ROLE]") if end else F.when(role.isNull(), F.lit("[ROLE]")).otherwise(F.concat(F.lit("[ROLE:"), escape(role), F.lit("]")))
    for name, marks in MARKS.items():
        other = F.when(role == name, F.lit(marks[end])).otherwise(other)
    return other


def chat_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window (from 0), formatted, repeated (leading turns shown again) and targets (start and length in formatted, code points from 0)."""
    text, role = F.coalesce("text", F.lit("")), F.col("role")
    cost = F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")) + TURN_COST
    turns = conversations.select("conv_id", "turn", "role", text.alias("text"), cost.cast("long").alias("cost"), _mark(role, 0).alias("open"), escape(text).alias("body"), _mark(role, 1).alias("close"))
    upto = F.sum("cost").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0))
    turns = turns.withColumn("upto", upto)
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("upto", "cost", "role", "open", "body", "close"))).alias("turns"))
    whole = whole.withColumn("sys", F.expr("int(coalesce(turns[0].role = 'system', false))"))
    # Starts of windows: at each turn i, (own, shown) are where the current window's new turns and shown history begin.
    start = f"""
        aggregate(sequence(0, size(turns) - 1),
            struct(0 as own, 0 as shown, array(struct(0 as own, 0 as shown)) as starts),
            (a, i) -> if(i > a.own and turns[i].upto - (turns[a.shown].upto - turns[a.shown].cost) + if(a.shown > 0, sys * turns[0].cost, 0L) > {budget},
                transform(array(coalesce(
                    element_at(filter(sequence(greatest(i - {history}, sys), i), j -> 4 * (turns[i].upto - turns[i].cost - (turns[j].upto - turns[j].cost)) <= {budget}), 1), i)),
                    j -> struct(i as own, j as shown, array_append(a.starts, struct(i as own, j as shown)) as starts))[0],
                a),
            a -> a.starts)"""
    whole = whole.withColumn("starts", F.expr(start))
    windows = """
        transform(starts, (w, k) -> struct(k as window, int(if(w.shown > 0, sys, 0) + w.own - w.shown) as repeated,
            concat(if(w.shown > 0 and sys = 1, slice(turns, 1, 1), slice(turns, 1, 0)),
                   slice(turns, w.shown + 1, if(k + 1 < size(starts), starts[k + 1].own, size(turns)) - w.shown)) as part))"""
    rows = whole.select("conv_id", F.explode(F.expr(windows)).alias("w")).select("conv_id", "w.window", "w.repeated", "w.part")
    targets = """
        aggregate(transform(part, (t, k) -> struct(k, t.role, length(t.open) as a, length(t.body) as b, length(t.close) as c)),
            struct(0 as at, cast(array() as array<struct<start:int,length:int>>) as found),
            (s, t) -> struct(s.at + t.a + t.b + t.c as at,
                if(t.role = 'assistant' and t.k >= repeated, array_append(s.found, struct(s.at + t.a as start, t.b as length)), s.found) as found),
            s -> s.found)"""
    formatted = F.expr("array_join(transform(part, t -> concat(t.open, t.body, t.close)), '')")
    return rows.select("conv_id", "window", "repeated", formatted.alias("formatted"), F.expr(targets).alias("targets"))


def read_windows(windows: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), targets (texts under the loss mask) and formatted_chars, read back from formatted windows."""
    marks = F.regexp_extract_all("formatted", F.lit(TURN), F.lit(1))
    bodies = F.regexp_extract_all("formatted", F.lit(TURN), F.lit(2))

    def role(mark: Column) -> Column:
        named = F.when(mark == "[ROLE]", F.lit(None).cast("string")).otherwise(unescape(F.substring(mark, F.lit(7), F.length(mark) - 7)))
        for name, (first, _) in MARKS.items():
            named = F.when(mark == first, F.lit(name)).otherwise(named)
        return named

    shown = F.zip_with("marks", "bodies", lambda m, b: F.struct(role(m).alias("role"), unescape(b).alias("text")))
    parts = windows.withColumns({"marks": marks, "bodies": bodies}).select(
        "conv_id", "window", F.slice(shown, F.col("repeated") + 1, F.size("marks")).alias("turns"), F.length("formatted").cast("long").alias("chars"),
        F.transform("targets", lambda t: unescape(F.substring(F.col("formatted"), t["start"] + 1, t["length"]))).alias("targets"),
    )
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "targets"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    return whole.select("conv_id", F.expr("flatten(w.turns)").alias("turns"), F.expr("flatten(w.targets)").alias("targets"), "formatted_chars")


def digests(read: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("targets", "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def probe(conversations: DataFrame) -> DataFrame:
    """The conversations, and one with id -1 whose turns say control strings."""
    said = conversations.sparkSession.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(said)


ORACLE = rf"""
    WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
    t AS (SELECT *, row_number() OVER w - 1 AS i, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + {TURN_COST} AS cost,
            length(text) + length(regexp_replace(text, '[^\\\[<\]]', '', 'g')) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 END AS chars
          FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
    g AS (SELECT conv_id, count(*) AS n, list(cost ORDER BY i) AS cost, list(chars ORDER BY i) AS chars, max(CASE WHEN i = 0 AND role = 'system' THEN 1 ELSE 0 END) AS sys,
            sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
            coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '') AS loss
          FROM t GROUP BY conv_id),
    f AS (SELECT *, list_reduce(list_transform(range(n), lambda x: {{'i': x, 'own': 0::BIGINT, 'shown': 0::BIGINT, 'more': 0::HUGEINT}}), lambda a, b:
            CASE WHEN b.i > a.own AND list_sum(cost[a.shown + 1 : b.i + 1]) + CASE WHEN a.shown > 0 THEN sys * cost[1] ELSE 0 END > {BUDGET} THEN
              list_transform([coalesce(list_filter(range(greatest(b.i - {HISTORY}, sys), b.i), lambda j: 4 * list_sum(cost[j + 1 : b.i]) <= {BUDGET})[1], b.i)], lambda j:
                {{'i': b.i, 'own': b.i, 'shown': j, 'more': a.more + CASE WHEN j > 0 THEN sys * chars[1] ELSE 0 END + coalesce(list_sum(chars[j + 1 : b.i]), 0)}})[1]
            ELSE {{'i': b.i, 'own': a.own, 'shown': a.shown, 'more': a.more}} END).more AS more FROM g)
    SELECT conv_id, n AS n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, (list_sum(chars) + more)::BIGINT AS formatted_chars FROM f
"""
