"""Chat formatting by a finite-state machine over roles.

A template declares, in plain data, the machine (start state, transitions by
state and role, accepting states) and each role's parts: literals or {text},
each with its loss flag. A conversation's roles, in the order of its turns, are
folded through the transitions by one higher-order aggregate; a valid one is
emitted as text segments, neighbouring parts of a turn with equal flags merged,
an invalid one as a single row that says which turn broke which rule. One
shuffle by conv_id, everything in the JVM.

The template's control strings are defused inside message texts (a zero-width
space after their first character), so a text can't open a turn of its own.

Defined results: a null text counts as an empty one, and empty texts keep their
turn; a null or unknown role, a null turn, two rows of one turn (repeated rows
included) and a turn order that the machine rejects make the conversation
invalid, with that reason; rows with a null conv_id form one invalid
conversation without a turn at fault, and are counted, not gathered. A
conversation is held by one task, as its text segments are one sequence. Rows of equal turn are ordered by role and text. The reason is
that of the first turn at fault. Other columns play no part. An empty table gives
an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TEXT = "{text}"
DEAD = "!"


@dataclass(frozen=True)
class Template:
    start: str
    transitions: dict[tuple[str, str], str]
    accepting: tuple[str, ...]
    parts: dict[str, tuple[tuple[str, bool], ...]]
    control: tuple[str, ...] = ()


def _turn(role: str, loss: bool) -> tuple[tuple[str, bool], ...]:
    return ((f"<|im_start|>{role}\n", False), (TEXT, loss), ("<|im_end|>", loss), ("\n", False))


#: An optional system turn, then user and assistant by turns, the assistant last; only what the assistant says is trained on.
CHATML = Template(
    start="begin",
    transitions={("begin", "system"): "ready", ("begin", "user"): "asked", ("ready", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"},
    accepting=("answered",),
    parts={"system": _turn("system", False), "user": _turn("user", False), "assistant": _turn("assistant", True)},
    control=("<|im_start|>", "<|im_end|>"),
)


def merged(parts: tuple[tuple[str, bool], ...]) -> list[tuple[list[str], bool]]:
    """Runs of parts with equal flags."""
    out: list[tuple[list[str], bool]] = []
    for text, loss in parts:
        if out and out[-1][1] == loss:
            out[-1][0].append(text)
        else:
            out.append(([text], loss))
    return out


def formatted(conversations: DataFrame, template: Template = CHATML) -> DataFrame:
    """(conv_id, segment, turn, role, text, loss, valid, reason): the segments of valid conversations, numbered from 0, and one row for each invalid one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    for c in template.control:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\u200b" + c[1:]))
    turns = F.array_sort(F.collect_list(F.struct(F.col("turn").cast("long").alias("turn"), "role", text.alias("text"))), _before)
    ident = F.col("conv_id").cast("long")
    convs = conversations.where(ident.isNotNull()).groupBy(ident.alias("conv_id")).agg(turns.alias("turns"))
    step = F.create_map(*[F.lit(x) for (s, r), t in template.transitions.items() for x in (f"{s}|{r}", t)])
    roles = F.array(*map(F.lit, template.parts))

    def fold(acc: F.Column, t: F.Column) -> F.Column:
        after = F.coalesce(F.try_element_at(step, F.concat_ws("|", acc["state"], t["role"])), F.lit(DEAD))
        why = F.when(t["turn"].isNull(), "null turn").when(t["turn"] == acc["turn"], "repeated turn").when(t["role"].isNull() | ~F.array_contains(roles, F.coalesce(t["role"], F.lit(""))), "unknown role").when(after == DEAD, "unexpected role")
        bad = acc["reason"].isNotNull()
        return F.struct(F.when(bad, acc["state"]).otherwise(after).alias("state"), t["turn"].alias("turn"), F.when(bad, acc["reason"]).otherwise(why).alias("reason"), F.when(bad, acc["at"]).otherwise(F.when(why.isNotNull(), t["turn"])).alias("at"))

    zero = F.struct(F.lit(template.start).alias("state"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("long").alias("at"))
    end = F.aggregate("turns", zero, fold)
    convs = convs.withColumn("end", end)
    reason = F.when(F.col("end.reason").isNotNull(), F.col("end.reason")).when(~F.col("end.state").isin(*template.accepting), "unfinished")
    convs = convs.withColumn("reason", reason)

    def segments(t: F.Column) -> F.Column:
        out = None
        for role, parts in template.parts.items():
            rows = [F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.concat(*[t["text"] if p == TEXT else F.lit(p) for p in texts]).alias("text"), F.lit(loss).alias("loss")) for texts, loss in merged(parts)]
            out = F.when(t["role"] == role, F.array(*rows)) if out is None else out.when(t["role"] == role, F.array(*rows))
        return out

    none = F.array(F.struct(F.when(F.col("end.reason").isNotNull(), F.col("end.at")).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("boolean").alias("loss")))
    body = F.when(F.col("reason").isNull(), F.flatten(F.transform("turns", segments))).otherwise(none)
    rows = convs.select("conv_id", "reason", F.posexplode(body).alias("segment", "s"))
    out = rows.select("conv_id", F.col("segment").cast("long").alias("segment"), "s.turn", "s.role", "s.text", "s.loss", F.col("reason").isNull().alias("valid"), "reason")
    none = conversations.where(ident.isNull()).agg(F.count("*").alias("n")).where("n > 0")
    void = [F.lit(None).cast(kind) for kind in ("long", "string", "string", "boolean")]
    return out.union(none.select(F.lit(None).cast("long"), F.lit(0).cast("long"), *void, F.lit(False), F.lit("null conversation")))


def _before(a: F.Column, b: F.Column) -> F.Column:
    """Order of turn, role, text; nulls first."""
    out = F.lit(0)
    for k in ("text", "role", "turn"):
        x, y = a[k], b[k]
        out = F.when(x.isNull() & y.isNull(), out).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).when(x > y, 1).otherwise(out)
    return out


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(table(spark, sf_dir, "conversations"))


QUERIES = {"op1_chat_format": op1_chat_format}
SQL = {
    "op1_chat_format": """
with turns as (select conv_id, turn, role, replace(replace(coalesce(text, ''), '<|im_start|>', '<' || chr(8203) || '|im_start|>'), '<|im_end|>', '<' || chr(8203) || '|im_end|>') as text,
  lag(role) over w as p_role, lag(turn) over w as p_turn, row_number() over w as k, count(*) over (partition by conv_id) as n from conversations window w as (partition by conv_id order by turn nulls first, role nulls first, text nulls first)),
faults as (select *, case when turn is null then 'null turn' when turn = p_turn then 'repeated turn' when role is null or role not in ('system', 'user', 'assistant') then 'unknown role'
  when not (case when k = 1 then role in ('system', 'user') when p_role = 'system' then role = 'user' when p_role = 'user' then role = 'assistant' when p_role = 'assistant' then role = 'user' else true end) then 'unexpected role' end as fault from turns),
convs as (select conv_id, case when conv_id is null then 'null conversation' when count(fault) > 0 then arg_min(fault, k) filter (where fault is not null) when max(role) filter (where k = n) <> 'assistant' then 'unfinished' end as reason,
  case when conv_id is not null and count(fault) > 0 then arg_min_null(turn, k) filter (where fault is not null) end as fault_turn from faults group by conv_id),
parts as (select t.conv_id, t.turn, t.role, t.k, x.part, x.text, x.loss from turns t join convs c on c.conv_id = t.conv_id and c.reason is null, lateral (
  select 0 as part, '<|im_start|>' || t.role || chr(10) || case when t.role = 'assistant' then '' else t.text || '<|im_end|>' || chr(10) end as text, false as loss
  union all select 1, t.text || '<|im_end|>', true where t.role = 'assistant'
  union all select 2, chr(10), false where t.role = 'assistant') x)
select conv_id, row_number() over (partition by conv_id order by k, part) - 1 as segment, turn, role, text, loss, true as valid, null::varchar as reason from parts
union all select conv_id, 0, fault_turn, null, null, null, false, reason from convs where reason is not null"""
}
