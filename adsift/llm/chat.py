"""Chat formatting by a declarative template, with DataFrame expressions only.

A template names the control string before each role's text, the one behind every turn, the roles whose text is trained on
and the turns that may follow each other. Turns become text segments with a loss flag each; the formatted text is their
concatenation. Control strings and backslashes inside texts are escaped by a backslash, so the formatted text can be read
back: no control string stands in an escaped text, and none can arise where a text meets a control string.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """headers: control string of each role; other: control strings around the name of any further role; end: behind a turn.

    order: for each state the roles that may follow and the state they lead to; a conversation begins in state "start" and
    is complete in one of the states of `complete`.
    """

    headers: Mapping[str, str]
    other: tuple[str, str]
    end: str
    trained: frozenset[str]
    order: Mapping[str, Mapping[str, str]]
    complete: frozenset[str]
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        every = (*self.headers.values(), *self.other, self.end)
        object.__setattr__(self, "controls", every)
        if len(set(every)) < len(every) or any(len(c) < 2 or ESCAPE in c for c in every):
            raise ValueError("control strings must differ, have two characters or more and no backslash")
        for a in every:
            for b in every:
                # An overlap would let a text and the control string beside it make up another control string.
                if (a != b and a in b) or any(b.startswith(a[k:]) for k in range(1, len(a))):
                    raise ValueError(f"control strings overlap: {a!r}, {b!r}")


PLAIN = Template(
    headers={"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "},
    other=("### Role [", "]: "),
    end="</turn>\n",
    trained=frozenset({"assistant"}),
    order={
        "start": {"system": "told", "user": "asked"},
        "told": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    },
    complete=frozenset({"answered"}),
)


def escaped(text: Column, template: Template = PLAIN) -> Column:
    """The text with a backslash before every backslash and before the second character of every control string."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for control in template.controls:
        out = F.replace(out, F.lit(control), F.lit(control[0] + ESCAPE + control[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _checked(roles: Column, template: Template) -> Column:
    """(state, bad): the machine's last state, and the number of the first turn that it does not allow (from 1)."""
    step = {f"{state}>{role}": after for state, roles_ in template.order.items() for role, after in roles_.items()}
    table = F.create_map(*[F.lit(x) for pair in step.items() for x in pair])
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def follow(acc: Column, role: Column) -> Column:
        after = F.try_element_at(table, F.concat(acc["state"], F.lit(">"), role))
        bad = F.coalesce(acc["bad"], F.when(after.isNull(), acc["at"] + 1))
        return F.struct(F.coalesce(after, F.lit("lost")).alias("state"), (acc["at"] + 1).alias("at"), bad.alias("bad"))

    return F.aggregate(roles, start, follow)


def formatted(turns: DataFrame, template: Template = PLAIN, conv_col: str = "conv_id", turn_col: str = "turn",
              role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, segments (array of text, loss), formatted, valid, bad_turn.

    Turns stand by turn number (null first), equal ones by role and text; repeated rows are turns of their own. Null roles and texts
    count as empty; roles without a header get the template's general one. bad_turn is the first turn out of order (from 1),
    one beyond the last if the conversation is incomplete, and 0 for valid ones; invalid conversations are formatted all
    the same. Turns without conversation number make up one conversation. An empty table gives none; other columns are not
    read. A conversation is one row and must fit one.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    turn = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    whole = turns.select(F.col(conv_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def spoken(t: Column) -> Column:
        header = F.concat(F.lit(template.other[0]), escaped(t["role"], template), F.lit(template.other[1]))
        for name, control in template.headers.items():
            header = F.when(t["role"] == name, F.lit(control)).otherwise(header)
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            part(header, F.lit(False)),
            part(escaped(t["text"], template), t["role"].isin(*template.trained)),
            part(F.lit(template.end), F.lit(False)),
        )

    machine = _checked(F.transform("turns", lambda t: t["role"]), template)
    parts = whole.select("conv_id", F.size("turns").alias("n_turns"), F.flatten(F.transform("turns", spoken)).alias("segments"), machine.alias("m"))
    unfinished = F.when(~F.col("m.state").isin(*template.complete), F.col("n_turns") + 1)
    bad = F.coalesce(F.col("m.bad"), unfinished, F.lit(0))
    joined = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return parts.select("conv_id", "n_turns", "segments", joined.alias("formatted"), (bad == 0).alias("valid"), bad.alias("bad_turn"))


def read_back(formatted_text: Column, template: Template = PLAIN) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    pieces = F.split(formatted_text, r"\Q" + template.end + r"\E", -1)

    def turn(piece: Column) -> Column:
        inner = F.substr(piece, F.lit(len(template.other[0]) + 1))
        cut = F.instr(inner, template.other[1])
        role, text = unescaped(F.substr(inner, F.lit(1), cut - 1)), F.substr(inner, cut + len(template.other[1]))
        for name, control in template.headers.items():
            here = piece.startswith(F.lit(control))
            role = F.when(here, F.lit(name)).otherwise(role)
            text = F.when(here, F.substr(piece, F.lit(len(control) + 1))).otherwise(text)
        return F.struct(role.alias("role"), unescaped(text).alias("text"))

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def trained_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def digests(turns: DataFrame, template: Template = PLAIN) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid, bad_turn; all read from the output."""
    out = formatted(turns, template).withColumn("back", read_back(F.col("formatted"), template)).withColumn("trained", trained_text(F.col("segments")))
    line = F.lit("\n")
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], line, t["text"], line)), "")
    return out.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "bad_turn",
    )
