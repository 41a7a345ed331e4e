"""Chat formatting: a role state machine and a declarative turn template.

Everything here is built-in Spark expressions. A turn becomes three segments,
opening mark, text and closing mark; only the text of loss roles carries the
loss flag. Marks cannot occur inside texts: a backslash is doubled and a
control string gets one backslash after its first character, which
``unescape`` undoes exactly.

Defined cases: a null text or role is the empty string; rows of one
conversation are ordered by (turn, role, text), null turns first; repeated
rows are repeated turns; a null conv_id is a conversation of its own; an
empty table gives no conversations; roles the template does not name use its
``other`` marks and carry no loss. Extra input columns are ignored. A whole
conversation is one output string, so ``format_conversations`` needs it to
fit one row (Spark's 2 GB); ``segments`` has one row per segment and no such
limit.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Marks:
    """Opening and closing mark of a role, and whether its text is learned."""
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    """Declarative template. ``moves`` is the state machine over roles:
    (state, role) -> state; a missing move is an error that stays."""
    roles: dict[str, Marks] = field(default_factory=lambda: {
        "system": Marks("<<SYS>>", "<</SYS>>"),
        "user": Marks("[INST]", "[/INST]"),
        "assistant": Marks("<s>", "</s>", True),
    })
    other: Marks = Marks("[ROLE]", "[/ROLE]")
    other_text: str = "[TEXT]"
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "briefed",
        ("start", "user"): "asked",
        ("briefed", "user"): "asked",
        ("asked", "assistant"): "answered",
        ("answered", "user"): "asked",
    })
    final: tuple[str, ...] = ("answered",)

    def __post_init__(self):
        c = self.controls()
        if len(set(c)) != len(c) or any(len(x) < 2 or "\\" in x for x in c):
            raise ValueError("marks must differ, have two characters or more and no backslash")
        for a in c:
            for b in c:
                touch = any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b) + (a != b))))
                if touch or (a != b and b in a):
                    raise ValueError(f"marks overlap: {a!r}, {b!r}")

    def controls(self) -> list[str]:
        marks = [*self.roles.values(), self.other]
        return [x for m in marks for x in (m.open, m.close)] + [self.other_text]


def _quoted(s: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", s)


def escape(text: Column, template: ChatTemplate) -> Column:
    """Make a text free of control strings."""
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    inside = "|".join(f"(?<={_quoted(s[0])})(?={_quoted(s[1:])})" for s in template.controls())
    return F.regexp_replace(doubled, inside, r"\\")


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _role(role: Column, template: ChatTemplate, known, other: Column) -> Column:
    out = other
    for name, marks in template.roles.items():
        out = F.when(role == name, F.lit(known(marks))).otherwise(out)
    return out


def opening(role: Column, template: ChatTemplate) -> Column:
    other = F.concat(F.lit(template.other.open), escape(role, template), F.lit(template.other_text))
    return _role(role, template, lambda m: m.open, other)


def closing(role: Column, template: ChatTemplate) -> Column:
    return _role(role, template, lambda m: m.close, F.lit(template.other.close))


def learned(role: Column, template: ChatTemplate) -> Column:
    return _role(role, template, lambda m: m.loss, F.lit(False))


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))


def segments(conversations: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """One row per segment: conv_id, turn, role, part (0 opening, 1 text,
    2 closing), segment, loss. Row by row, no shuffle."""
    t = _turns(conversations)
    r = F.col("role")
    parts = F.array(
        F.struct(F.lit(0).alias("part"), opening(r, template).alias("segment"), F.lit(False).alias("loss")),
        F.struct(F.lit(1).alias("part"), escape(F.col("text"), template).alias("segment"),
                 learned(r, template).alias("loss")),
        F.struct(F.lit(2).alias("part"), closing(r, template).alias("segment"), F.lit(False).alias("loss")))
    return t.select("conv_id", "turn", "role", F.inline(parts))


def end_state(roles: Column, template: ChatTemplate) -> Column:
    """State of the role machine after an array of roles ("error" stays)."""
    moves = F.create_map(*[F.lit(x) for (s, r), to in template.moves.items() for x in (f"{s}\n{r}", to)])
    return F.aggregate(
        roles, F.lit("start"),
        lambda s, r: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit("\n"), r)), F.lit("error")))


def format_conversations(conversations: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """One row per conversation: conv_id, formatted, valid (the roles follow
    the machine and end in a final state), segments (array of segment, loss)."""
    t = _turns(conversations).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    pieces = F.flatten(F.transform("turns", lambda t: F.array(
        F.struct(opening(t["role"], template).alias("segment"), F.lit(False).alias("loss")),
        F.struct(escape(t["text"], template).alias("segment"), learned(t["role"], template).alias("loss")),
        F.struct(closing(t["role"], template).alias("segment"), F.lit(False).alias("loss")))))
    state = end_state(F.transform("turns", lambda t: t["role"]), template)
    return (t.select("conv_id", pieces.alias("segments"), state.isin(*template.final).alias("valid"))
            .select("conv_id", F.array_join(F.transform("segments", lambda s: s["segment"]), "").alias("formatted"),
                    "valid", "segments"))


def parse(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """Read a formatted string back: array of (role, text, loss)."""
    every = [*template.roles.values(), template.other]
    whole = "|".join(f"{_quoted(m.open)}.*?{_quoted(m.close)}" for m in every)
    found = F.regexp_extract_all(formatted, F.lit(f"(?s)({whole})"), F.lit(1))

    def inner(t, m):
        return F.substring(t, F.lit(len(m.open) + 1), F.length(t) - len(m.open) - len(m.close))

    def turn(t):
        o = inner(t, template.other)
        role = unescape(F.substring_index(o, template.other_text, 1))
        text = F.substring(o, F.instr(o, template.other_text) + len(template.other_text), F.length(o))
        loss = F.lit(False)
        for name, m in template.roles.items():
            here = F.startswith(t, F.lit(m.open))
            role = F.when(here, F.lit(name)).otherwise(role)
            text = F.when(here, inner(t, m)).otherwise(text)
            loss = F.when(here, F.lit(m.loss)).otherwise(loss)
        return F.struct(role.alias("role"), unescape(text).alias("text"), loss.alias("loss"))

    return F.transform(found, turn)


def digests(formatted: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Digest columns, read back from the formatted strings and their flags."""
    t = formatted.select(
        "conv_id", "valid", parse(F.col("formatted"), template).alias("turns"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["segment"])), "")
        .alias("masked"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return t.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2(F.col("masked"), 256).alias("loss_sha256"),
        "formatted_chars", "valid")
