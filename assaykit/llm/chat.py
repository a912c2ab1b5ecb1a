"""Chat formatting by schema fingerprints. DataFrame functions only.

A record is a variant of any shape. The nested field paths that it holds, among those that some layout names, are hashed; the
hash selects the layout, and the layout says declaratively where the turns are. Canonical turns are then written into one
template, together with a mask of what is learned from, and can be read back exactly.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import chain, combinations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Turn(NamedTuple):
    """One turn of a fixed role: the texts at ``paths`` that are there and not empty, joined by blank lines."""

    role: str
    paths: tuple[str, ...]


class Messages(NamedTuple):
    """A list of turns: an element's role and its text, which may be a list of ``parts``; ``roles`` renames roles."""

    path: str
    role: str
    text: str
    parts: str | None = None
    roles: tuple[tuple[str, str], ...] = ()


class Layout(NamedTuple):
    """A record shape: paths that must be there, paths that may be, and the turns in order."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    turns: tuple[Turn | Messages, ...]


SHARED_ROLES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))

# Earlier layouts win where two have the same paths.
LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), ("prompt",), (Messages("messages", "role", "content"),)),
    Layout("message_parts", ("messages[].role", "messages[].content[].text"), ("messages[].content", "prompt"),
           (Messages("messages", "role", "content", "text"),)),
    Layout("shared", ("conversations[].from", "conversations[].value"), ("system",),
           (Turn("system", ("system",)), Messages("conversations", "from", "value", roles=SHARED_ROLES))),
    Layout("dialog", ("dialog.turns[].speaker", "dialog.turns[].utterance"), (),
           (Messages("dialog.turns", "speaker", "utterance", roles=SHARED_ROLES),)),
    Layout("instruction", ("instruction", "output"), ("input", "system"),
           (Turn("system", ("system",)), Turn("user", ("instruction", "input")), Turn("assistant", ("output",)))),
    Layout("instruction_response", ("instruction", "response"), ("context",),
           (Turn("user", ("instruction", "context")), Turn("assistant", ("response",)))),
    Layout("question", ("question", "response"), ("system_prompt",),
           (Turn("system", ("system_prompt",)), Turn("user", ("question",)), Turn("assistant", ("response",)))),
    Layout("question_answer", ("question", "answer"), ("context",),
           (Turn("user", ("context", "question")), Turn("assistant", ("answer",)))),
    Layout("completion", ("prompt", "completion"), ("system",),
           (Turn("system", ("system",)), Turn("user", ("prompt",)), Turn("assistant", ("completion",)))),
    Layout("prompt_response", ("prompt", "response"), ("system",),
           (Turn("system", ("system",)), Turn("user", ("prompt",)), Turn("assistant", ("response",)))),
    Layout("nested", ("data.prompt.text", "data.response.text"), ("data.system.text",),
           (Turn("system", ("data.system.text",)), Turn("user", ("data.prompt.text",)), Turn("assistant", ("data.response.text",)))),
)

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
TURNS = "array<struct<role:string,text:string>>"
_CONTROL = r"<\|(\**)(turn|text|end)\|>"
_ESCAPED = r"<\|\*(\**)(turn|text|end)\|>"


def escaped(text: Column) -> Column:
    """A text without control strings: those it holds, starred or not, get one more star (``<|end|>`` becomes ``<|*end|>``)."""
    return F.regexp_replace(text, _CONTROL, r"<|*$1$2|>")


def unescaped(text: Column) -> Column:
    """The text that ``escaped`` was given: one star fewer."""
    return F.regexp_replace(text, _ESCAPED, r"<|$1$2|>")


def _get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, "$." + path, kind)


def _scalar(value: Column, path: str) -> Column:
    """Is there a value at the path that is no list and no object? A JSON null counts."""
    return F.coalesce(~F.schema_of_variant(_get(value, path, "variant")).rlike("^(ARRAY|OBJECT)<"), F.lit(False))


def _has(value: Column, path: str) -> Column:
    """Does the record hold this nested field path? A path through a list holds if any element has it."""
    head, step, tail = path.partition("[].")
    if not step:
        return _scalar(value, path)
    return F.coalesce(F.exists(_get(value, head, "array<variant>"), lambda e: _has(e, tail)), F.lit(False))


def _digest(paths: tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def known_paths(layouts: tuple[Layout, ...]) -> list[str]:
    return sorted({p for layout in layouts for p in layout.required + layout.optional})


def fingerprint(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """sha256 of the nested field paths of the record, among those that the layouts name, in order; null for a null record."""
    there = F.array(*[F.when(_has(record, p), F.lit(p)) for p in known_paths(layouts)])
    return F.when(record.isNotNull(), F.sha2(F.array_join(there, "\n"), 256))


def layout_table(layouts: tuple[Layout, ...]) -> dict[str, str]:
    """Fingerprint -> name of its layout, for every layout with every choice of its optional paths."""
    table: dict[str, str] = {}
    for layout in layouts:
        some = layout.optional
        for extra in chain.from_iterable(combinations(some, n) for n in range(len(some) + 1)):
            table.setdefault(_digest(layout.required + extra), layout.name)
    return table


def _turns(record: Column, part: Turn | Messages) -> Column:
    if isinstance(part, Turn):
        texts = F.array_compact(F.array(*[_get(record, p, "string") for p in part.paths]))
        there = F.filter(texts, lambda t: t != "")
        turn = F.array(F.struct(F.lit(part.role).alias("role"), F.array_join(there, "\n\n").alias("text")))
        # a system turn that is not there is no turn; an empty user or assistant turn is one
        return F.when(F.size(there) == 0, F.array().cast(TURNS)).otherwise(turn) if part.role == "system" else turn

    def one(e: Column) -> Column:
        role = F.coalesce(_get(e, part.role, "string"), F.lit(""))
        for old, new in part.roles:
            role = F.when(role == old, F.lit(new)).otherwise(role)
        text = _get(e, part.text, "string")
        if part.parts is not None:
            pieces = F.transform(_get(e, part.text, "array<variant>"), lambda x: F.coalesce(_get(x, part.parts, "string"), F.lit("")))
            text = F.when(_scalar(e, part.text), text).otherwise(F.array_join(pieces, ""))
        return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    return F.coalesce(F.transform(_get(record, part.path, "array<variant>"), one), F.array().cast(TURNS))


def canonical_turns(rows: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``rows`` with ``fingerprint``, ``layout`` and ``turns`` (role and text, in order).

    ``record`` is a variant (``F.try_parse_json`` of a JSON line, ``F.to_variant_object`` of a struct). Fields that no layout names are
    ignored. A record whose fingerprint belongs to no layout keeps its row with a null layout and null turns, so that a layout
    can be added for it; so does a null record, whose fingerprint is null. Missing or null texts and roles are empty; a missing
    system text is no turn. Existing columns of the added names are replaced. An empty table gives an empty table.
    """
    added = ("fingerprint", "layout", "turns")
    rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c.lower() not in added], fingerprint(F.col(record), layouts).alias("fingerprint"))
    names = F.create_map(*[F.lit(x) for pair in layout_table(layouts).items() for x in pair])
    rows = rows.withColumn("layout", F.element_at(names, F.col("fingerprint")))
    turns = F.lit(None).cast(TURNS)
    for layout in reversed(layouts):
        found = reduce(F.concat, [_turns(F.col(record), part) for part in layout.turns])
        turns = F.when(F.col("layout") == layout.name, found).otherwise(turns)
    return rows.withColumn("turns", turns)


def format_chats(rows: DataFrame, learned: str = "assistant") -> DataFrame:
    """``rows`` of ``canonical_turns`` with ``formatted`` and ``loss_mask``.

    A turn is written as ``<|turn|>role<|text|>text<|end|>``, where neither role nor text holds a control string (see ``escaped``).
    The mask has one entry a turn, ``skip`` and ``take``: so many code points since the last entry's end are not learned from, so
    many are. ``take`` is the whole escaped text of a turn of the role ``learned`` and 0 for others; what follows the last entry is
    not learned from. Null turns give nulls, no turns an empty string. Existing columns of these names are replaced.
    """
    rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c.lower() not in ("formatted", "loss_mask", "_written")],
                       F.transform("turns", lambda t: F.struct(escaped(t.role).alias("role"), escaped(t.text).alias("text"),
                                                               (t.role == learned).alias("learned"))).alias("_written"))
    pieces = F.transform("_written", lambda t: F.concat(F.lit(TURN), t.role, F.lit(TEXT), t.text, F.lit(END)))

    def entry(t: Column, i: Column) -> Column:
        head = F.when(i > 0, len(END)).otherwise(0) + len(TURN) + len(TEXT) + F.length(t.role)
        size = F.length(t.text)
        return F.struct(F.when(t.learned, head).otherwise(head + size).cast("int").alias("skip"),
                        F.when(t.learned, size).otherwise(0).cast("int").alias("take"))

    mask = F.transform("_written", entry)
    return rows.withColumns({"formatted": F.array_join(pieces, ""), "loss_mask": mask}).drop("_written")


def written_turns(formatted: Column) -> Column:
    """The pieces of a formatted text, one a turn, without their end mark."""
    pieces = F.split(formatted, r"<\|end\|>", -1)
    return F.slice(pieces, 1, F.size(pieces) - 1)


def read_turns(formatted: Column) -> Column:
    """The turns, roles and texts as they were, from the formatted text alone."""

    def one(piece: Column) -> Column:
        role = F.substring_index(piece, TEXT, 1)
        text = F.substring(piece, F.length(role) + (len(TEXT) + 1), F.length(piece))
        return F.struct(unescaped(F.substring(role, F.lit(len(TURN) + 1), F.length(role))).alias("role"), unescaped(text).alias("text"))

    return F.transform(written_turns(formatted), one)


def learned_texts(formatted: Column, mask: Column) -> Column:
    """The texts under the mask, as they were, in order. Each entry ends where its turn's text ends, so a pass over the pieces does."""
    under = F.zip_with(written_turns(formatted), mask, lambda piece, m: F.when(m.take > 0, F.right(piece, m.take)))
    return F.transform(F.array_compact(under), unescaped)


def gather(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of single turns as one record a conversation, in the layout of messages: the columns ``conversation`` and ``record``.

    Turns are ordered by number (null first), then role and text, so that ties have one order; repeated rows are turns of their
    own. A null conversation is one like any other, null texts and roles stay null. A conversation becomes one value, as it will be
    one sample: beyond two billion bytes Spark fails with a message. An empty table gives an empty table.
    """
    one = F.struct(F.col(turn).alias("t"), F.col(role).alias("role"), F.col(text).alias("content"))
    lists = rows.groupBy(F.col(conversation).alias("_c")).agg(F.sort_array(F.collect_list(one)).alias("m"))
    messages = F.transform("m", lambda x: F.struct(x.role.alias("role"), x.content.alias("content")))
    return lists.select(F.col("_c").alias(conversation), F.to_variant_object(F.struct(messages.alias("messages"))).alias("record"))
