"""Chat formatting with DataFrame functions only.

A finite-state machine over roles validates the order of turns; a template turns each conversation into
segments with a loss flag. Control strings inside texts are escaped, so the output can be read back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Fixed strings of a format. open + label + middle + text + close is one turn.

    transitions: state -> {role: next state}; a conversation is valid if every turn has a transition
    and it ends in one of the final states. Roles without a label use their own name.
    """

    open: str = "### "
    middle: str = ": "
    close: str = "\n</turn>\n"
    mark: str = "</turn>"
    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    transitions: dict[str, dict[str, str]] = field(default_factory=lambda: {"start": {"system": "told", "user": "asked"}, "told": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})
    final: tuple[str, ...] = ("answered",)

    def __post_init__(self) -> None:
        for control in (self.open, self.mark):
            if any(self.close.startswith(control[i:]) or self.middle.endswith(control[:i]) for i in range(1, len(control))):
                raise ValueError(f"{control!r} could arise where a text meets the template")
        if len(set(self.labels.values())) < len(self.labels):
            raise ValueError("two roles have one label")
        if self.mark not in self.close or not all((self.open, self.middle, self.close, self.mark)):
            raise ValueError("close must hold the mark, and no string may be empty")


#: Escapes inside texts: the backslash first, so that every backslash of the output begins an escape.
def _escapes(t: Template) -> list[tuple[str, str]]:
    return [("\\", "\\e"), (t.open, "\\o"), (t.mark, "\\m")]


def escaped(text: Column, t: Template) -> Column:
    for plain, code in _escapes(t):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, t: Template) -> Column:
    for plain, code in reversed(_escapes(t)):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text in order of turn): one row per conversation, null ids together.

    Turns with the same number are ordered by role and text, rows without a number come first; null
    roles and texts are empty. A conversation is one row of the result, so its turns must be together.
    """
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col("conv_id").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.withColumn("turns", F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))))


def formatted(convs: DataFrame, t: Template = Template()) -> DataFrame:
    """Adds state, valid, segments (array of text, loss) and formatted (their concatenation) to conversations().

    state is where the machine stops: 'invalid' from the first turn without a transition on. Conversations
    out of order are formatted too; `valid` lets a caller drop them. Roles are escaped as texts are.
    """
    labels, steps = _map(t.labels), _map({f"{a}\n{role}": b for a, edges in t.transitions.items() for role, b in edges.items()})
    state = F.aggregate("turns", F.lit(t.start), lambda s, x: F.coalesce(F.try_element_at(steps, F.concat(s, F.lit("\n"), x["role"])), F.lit("invalid")))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def of_turn(x: Column) -> Column:
        # A role that is spelt as the label of another is marked as itself.
        label = F.replace(escaped(F.coalesce(F.try_element_at(labels, x["role"]), x["role"]), t), F.lit(t.middle), F.lit("\\c"))
        own = ~x["role"].isin(*t.labels) & x["role"].isin(*t.labels.values())
        label = F.concat(F.when(own, "\\r").otherwise(""), label)
        return F.array(
            segment(F.concat(F.lit(t.open), label, F.lit(t.middle)), F.lit(False)),
            segment(escaped(x["text"], t), x["role"].isin(*t.loss_roles)),
            segment(F.lit(t.close), F.lit(False)),
        )

    return (
        convs.withColumn("state", state)
        .withColumn("valid", F.col("state").isin(*t.final))
        .withColumn("segments", F.flatten(F.transform("turns", of_turn)))
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    )


def read_back(df: DataFrame, t: Template = Template()) -> DataFrame:
    """Adds read (array of role, text) parsed from `formatted`, and trained: of these, the text of the roles under the loss mask."""
    names = _map({label: role for role, label in t.labels.items()})
    # split() takes a pattern; the close string is quoted, and the piece behind the last one is empty.
    pieces = F.filter(F.split("formatted", "\\Q" + t.close + "\\E", -1), lambda x: x != "")

    def parsed(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(t.open) + 1), F.length(piece))
        cut = F.instr(body, t.middle)
        head = F.substring(body, F.lit(1), cut - 1)
        own = F.startswith(head, F.lit("\\r"))
        head = F.when(own, F.substring(head, F.lit(3), F.length(head))).otherwise(head)
        label = unescaped(F.replace(head, F.lit("\\c"), F.lit(t.middle)), t)
        text = unescaped(F.substring(body, cut + len(t.middle), F.length(body)), t)
        return F.struct(F.when(own, label).otherwise(F.coalesce(F.try_element_at(names, label), label)).alias("role"), text.alias("text"))

    read = F.transform(pieces, parsed)
    trained = F.transform(F.filter("read", lambda x: x["role"].isin(*t.loss_roles)), lambda x: x["text"])
    return df.withColumn("read", read).withColumn("trained", F.array_join(trained, ""))


def digests(df: DataFrame) -> DataFrame:
    """The digest columns of read_back()'s rows."""
    turns = F.array_join(F.transform("read", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return df.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("trained").cast("long").alias("loss_chars"),
        F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
