"""Chat formatting: a finite-state machine over roles and a declarative template, in built-in expressions only.

Every raw ``<`` or ``[`` of the formatted text starts a control mark: texts have the template's
escape characters replaced (``\\`` as ``\\e``, ``<`` as ``\\l``, ``[`` as ``\\b``), so no text can
imitate a mark, and reading back is exact.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mark:
    """How a role's turn is written, and whether the model learns its text."""

    role: str
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    """Marks by role; a role without a mark is written with its name in the ``other`` mark.

    ``transitions`` lists (state, role, next state). The machine begins in ``start``; a
    conversation is well formed if every turn has a transition and it ends in ``accepting``.
    """

    marks: tuple[Mark, ...]
    other: Mark = Mark("", "[ROLE]", "[/ROLE]")
    says: str = "[SAYS]"
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))
    start: str = "start"
    transitions: tuple[tuple[str, str, str], ...] = ()
    accepting: tuple[str, ...] = field(default=())

    def __post_init__(self):
        heads = {raw for raw, _ in self.escapes[1:]}
        for text in self.control_strings():
            if text[:1] not in heads or set(text[1:]) & {"\\"}:
                raise ValueError(f"mark {text!r} does not begin with an escaped character")

    def control_strings(self) -> list[str]:
        return [x for m in (*self.marks, self.other) for x in (m.open, m.close)] + [self.says]


#: Marks in the manner of instruction-tuned chat models.
INSTRUCT = ChatTemplate(
    marks=(
        Mark("system", "<<SYS>>", "<</SYS>>"),
        Mark("user", "[INST]", "[/INST]"),
        Mark("assistant", "<s>", "</s>", loss=True),
    ),
    transitions=(
        ("start", "system", "system"),
        ("start", "user", "user"),
        ("system", "user", "user"),
        ("user", "assistant", "assistant"),
        ("assistant", "user", "user"),
    ),
    accepting=("assistant",),
)


def escape(text: Column, template: ChatTemplate = INSTRUCT) -> Column:
    for raw, safe in template.escapes:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column, template: ChatTemplate = INSTRUCT) -> Column:
    for raw, safe in reversed(template.escapes):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def _by_role(role: Column, template: ChatTemplate, value) -> Column:
    out = F.when(F.lit(False), value(template.other))
    for mark in template.marks:
        out = out.when(role == mark.role, value(mark))
    return out.otherwise(value(template.other))


def format_turns(turns: DataFrame, template: ChatTemplate = INSTRUCT) -> DataFrame:
    """One row per turn: its three segments (open mark, body, close mark) and the body's loss flag."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    known = role.isin(*[m.role for m in template.marks])
    named = F.concat(F.lit(template.other.open), escape(role, template), F.lit(template.says))
    return turns.select(
        "conv_id",
        "turn",
        role.alias("role"),
        text.alias("text"),
        F.when(known, _by_role(role, template, lambda m: F.lit(m.open))).otherwise(named).alias("open"),
        escape(text, template).alias("body"),
        _by_role(role, template, lambda m: F.lit(m.close)).alias("close"),
        _by_role(role, template, lambda m: F.lit(m.loss)).alias("loss"),
    )


def _final_state(roles: Column, template: ChatTemplate) -> Column:
    pairs = [x for a, r, b in template.transitions for x in (F.lit(f"{a}|{r}"), F.lit(b))]
    table = F.create_map(*pairs)
    step = lambda state, role: F.coalesce(F.element_at(table, F.concat_ws("|", state, role)), F.lit("rejected"))
    return F.aggregate(roles, F.lit(template.start), step)


def format_conversations(turns: DataFrame, template: ChatTemplate = INSTRUCT) -> DataFrame:
    """Format (conv_id, turn, role, text) rows into one text per conversation.

    Returns ``conv_id, n_turns, formatted, segments, state, valid``: ``segments`` has the span
    (0-based start, length in code points) of each body with its role and loss flag; ``valid``
    tells whether the role order is accepted (malformed conversations are formatted all the same).

    Turns go in the order of (turn, role, text), nulls first, so ties and repeated rows have one
    result. A null text or role counts as empty, a null conv_id is a conversation of its own, an
    empty table gives no rows, other columns are ignored. A conversation is one row of the result,
    so its turns meet in one task: that is the unit of work, and it is bounded by the longest one.
    """
    rows = format_turns(turns.select("conv_id", "turn", "role", "text"), template)
    length = F.char_length("open") + F.char_length("body") + F.char_length("close")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    before = F.sum(length.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("start", F.coalesce(before, F.lit(0)) + F.char_length("open"))
    packed = F.struct("turn", "role", "text", "start", "open", "body", "close", "loss")
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(packed)).alias("t"))
    state = _final_state(F.transform("t", lambda x: x["role"]), template)
    return whole.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda x: F.concat(x["open"], x["body"], x["close"])), "").alias("formatted"),
        F.transform(
            "t",
            lambda x: F.struct(x["role"].alias("role"), x["start"].alias("start"), F.char_length(x["body"]).cast("long").alias("length"), x["loss"].alias("loss")),
        ).alias("segments"),
        state.alias("state"),
    ).withColumn("valid", F.col("state").isin(*template.accepting))


def read_back(formatted: Column, template: ChatTemplate = INSTRUCT) -> Column:
    """The turns of a formatted text again: array of (role, text)."""
    quote = re.escape
    plain = "([^" + "".join("\\" + raw for raw, _ in template.escapes[1:]) + "]*+)"
    opens = "|".join([*(quote(m.open) for m in template.marks), quote(template.other.open) + plain + quote(template.says)])
    closes = "|".join(quote(m.close) for m in (*template.marks, template.other))
    pattern = F.lit(f"({opens}){plain}(?:{closes})")
    marks, names, bodies = (F.regexp_extract_all(formatted, pattern, F.lit(i)) for i in (1, 2, 3))
    role_of = lambda mark, name: _first_match(mark, name, template)
    roles = F.zip_with(marks, names, role_of)
    return F.zip_with(roles, bodies, lambda r, b: F.struct(r.alias("role"), unescape(b, template).alias("text")))


def _first_match(mark: Column, name: Column, template: ChatTemplate) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for m in template.marks:
        out = out.when(mark == m.open, F.lit(m.role))
    return out.otherwise(unescape(name, template))


def loss_text(formatted: Column, segments: Column, template: ChatTemplate = INSTRUCT) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    spans = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")), template)), "")
