"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only.

The template gives each role an opening and a closing mark and says whether its texts are learned. Marks begin with "<"
or "["; in texts these two characters and the escape character are replaced by two-character escapes, so no text can
hold a mark, marks are found by a plain pattern, and escapes are undone without loss. Roles that the template does not
name get a mark that spells the role. The machine walks over the roles of a conversation and accepts or rejects the turn order;
rejected conversations are formatted as well and say so in `valid`.

A conversation is one row of the result, so its turns meet in one task; conversations are never gathered further.

Defined cases: null text and null role are empty; equal turn numbers are ordered by role and text, null turns come first; repeated
rows are turns of their own; rows with a null conversation id form one conversation; texts of any length are formatted whole, all turns of a
conversation in one task; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\s"), (">", "\\g"))  # the escape character first


@dataclass(frozen=True)
class Role:
    """Marks around a role's texts, and whether the text between them counts for the loss."""

    name: str
    opening: str
    closing: str
    loss: bool = False


TEMPLATE = (Role("system", "<<SYS>>", "<</SYS>>"), Role("user", "[INST]", "[/INST]"), Role("assistant", "<s>", "</s>", loss=True))
OTHER_OPENING, OTHER_END, OTHER_CLOSING = "<role:", ">", "</role>"

# (state, role) -> state: an optional system turn, then user and assistant in turn.
TURN_ORDER = {("start", "system"): "opened", ("start", "user"): "asked", ("opened", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"}
ACCEPTING = ("answered", "asked")


def escape(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ESCAPES, text)


def unescape(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), text)


def _by_role(template: Sequence[Role], role: Column, value: Mapping[str, Column], other: Column) -> Column:
    return reduce(lambda c, r: F.when(role == r.name, value[r.name]).otherwise(c), reversed(template), other)


def valid_order(roles: Column, moves: Mapping[tuple[str, str], str] = TURN_ORDER, accepting: Sequence[str] = ACCEPTING) -> Column:
    """Runs the machine over an array of roles."""
    table = F.create_map(*(F.lit(x) for (state, role), to in moves.items() for x in (f"{state}|{role}", to)))
    end = F.aggregate(roles, F.lit("start"), lambda state, role: F.coalesce(F.try_element_at(table, F.concat(state, F.lit("|"), role)), F.lit("rejected")))
    return end.isin(*accepting)


def format_chats(turns: DataFrame, template: Sequence[Role] = TEMPLATE, moves: Mapping[tuple[str, str], str] = TURN_ORDER, id_col: str = "conv_id",
                 turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id, valid, segments (array of text and loss flag) and formatted, their concatenation."""
    rows = turns.select(F.col(id_col), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                                                F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    listed = rows.groupBy(id_col).agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def parts(t: Column) -> Column:
        role = t["role"]
        opening = _by_role(template, role, {r.name: F.lit(r.opening) for r in template}, F.concat(F.lit(OTHER_OPENING), escape(role), F.lit(OTHER_END)))
        closing = _by_role(template, role, {r.name: F.lit(r.closing) for r in template}, F.lit(OTHER_CLOSING))
        loss = _by_role(template, role, {r.name: F.lit(r.loss) for r in template}, F.lit(False))
        return F.array(segment(opening, F.lit(False)), segment(escape(t["text"]), loss), segment(closing, F.lit(False)))

    out = listed.select(id_col, valid_order(F.transform("turns", lambda t: t["role"]), moves).alias("valid"), F.flatten(F.transform("turns", parts)).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def _quoted(mark: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() else c for c in mark)


def read_back(formatted: Column, template: Sequence[Role] = TEMPLATE) -> Column:
    """The turns of a formatted conversation as an array of (role, text)."""
    openings = "|".join([_quoted(r.opening) for r in template] + [f"{_quoted(OTHER_OPENING)}[^<>\\[]*{_quoted(OTHER_END)}"])
    closings = "|".join([_quoted(r.closing) for r in template] + [_quoted(OTHER_CLOSING)])
    pattern = f"({openings})([^<\\[]*)(?:{closings})"
    marks, texts = (F.regexp_extract_all(formatted, F.lit(pattern), F.lit(k)) for k in (1, 2))

    def turn(mark: Column, text: Column) -> Column:
        spelled = unescape(F.regexp_extract(mark, f"^{_quoted(OTHER_OPENING)}(.*){_quoted(OTHER_END)}$", 1))
        role = reduce(lambda c, r: F.when(mark == r.opening, r.name).otherwise(c), template, spelled)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.zip_with(marks, texts, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return unescape(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))
