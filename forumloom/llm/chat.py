"""Chat formatting: schema fingerprints select declarative layouts, turns are rendered with a loss mask and read back."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forumloom.llm.common import prepare, slices, stage

# Layouts ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """Turns that a layout takes from a record.

    Without ``each``: one turn of ``role`` (or of the role in ``role_field``) whose text is the non-empty ``texts``
    joined by a blank line; it is left out when all of them are null, unless ``always``. With ``each``: a turn per
    element of that array, ``role_field`` and ``texts`` being fields of the element. ``names`` maps roles.
    """

    texts: tuple[str, ...]
    role: str | None = None
    role_field: str | None = None
    each: str | None = None
    names: tuple[tuple[str, str], ...] = ()
    always: bool = False

    def paths(self) -> list[str]:
        fields = [*self.texts, *([self.role_field] if self.role_field else [])]
        return [f"{self.each}[].{f}" if self.each else f for f in fields]


@dataclass(frozen=True)
class Layout:
    """A record layout: its rules in order, and the field paths that a record may lack."""

    name: str
    rules: tuple[Rule, ...]
    optional: tuple[str, ...] = ()

    def paths(self) -> set[str]:
        return {p for rule in self.rules for p in rule.paths()}

    def fingerprints(self) -> list[str]:
        """The fingerprint of each set of paths that a record of this layout can have."""
        needed = self.paths() - set(self.optional)
        return [
            fingerprint(needed | set(extra))
            for n in range(len(self.optional) + 1)
            for extra in itertools.combinations(self.optional, n)
        ]


def fingerprint(paths: set[str]) -> str:
    """Hash of a set of nested field paths."""
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


_SHARED = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))

LAYOUTS = (
    Layout("messages", (Rule(("content",), role_field="role", each="messages"),), ("messages[].content",)),
    Layout("shared", (Rule(("value",), role_field="from", each="conversations", names=_SHARED),), ("conversations[].value",)),
    Layout(
        "instruction",
        (Rule(("system",), "system"), Rule(("instruction", "input"), "user"), Rule(("output",), "assistant")),
        ("system", "input", "output"),
    ),
    Layout(
        "completion", (Rule(("system",), "system"), Rule(("prompt",), "user"), Rule(("completion",), "assistant")),
        ("system", "completion"),
    ),
    Layout(
        "response", (Rule(("system",), "system"), Rule(("prompt",), "user"), Rule(("response",), "assistant")),
        ("system", "response"),
    ),
    Layout("question", (Rule(("question",), "user"), Rule(("answer",), "assistant")), ("answer",)),
    Layout("turn", (Rule(("text",), role_field="role", always=True),), ("role", "text")),
)
"""Layouts in order of preference where a record fits more than one."""


def field_paths(kind: T.DataType, prefix: str = "") -> Iterator[str]:
    """Paths of the leaves of a type: ``a.b`` for structs, ``a[].b`` for arrays of structs."""
    if isinstance(kind, T.StructType):
        for field in kind.fields:
            yield from field_paths(field.dataType, f"{prefix}.{field.name}" if prefix else field.name)
    elif isinstance(kind, T.ArrayType):
        yield from field_paths(kind.elementType, f"{prefix}[]")
    else:
        yield prefix


def _column(path: str) -> Column:
    return F.col(".".join(f"`{part}`" for part in path.split(".")))


def _present(path: str) -> Column:
    if "[]." in path:
        array, field = path.split("[].", 1)
        return F.coalesce(F.exists(_column(array), lambda x: x[field].isNotNull()), F.lit(False))
    return _column(path).isNotNull()


def record_fingerprint(known: Sequence[str]) -> Column:
    """Fingerprint of a record: the hash of those of the ``known`` paths that are not null in it."""
    present = [F.when(_present(p), F.lit(p)) for p in sorted(known)]
    return F.md5(F.concat_ws("\n", *present).cast("binary"))


def _turns(rule: Rule) -> Column:
    def turn(role: Column, texts: list[Column]) -> Column:
        role = F.coalesce(role.cast("string"), F.lit(""))
        for old, new in rule.names:
            role = F.when(role == old, F.lit(new)).otherwise(role)
        filled = [F.when(t != "", t) for t in texts]
        text = texts[0] if len(texts) == 1 else F.concat_ws("\n\n", *filled)
        return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    if rule.each:
        element = lambda x: turn(x[rule.role_field], [x[t].cast("string") for t in rule.texts])
        return F.transform(_column(rule.each), element)
    texts = [_column(t).cast("string") for t in rule.texts]
    one = F.array(turn(_column(rule.role_field) if rule.role_field else F.lit(rule.role), texts))
    if rule.always:
        return one
    return F.when(F.coalesce(*texts).isNotNull(), one).otherwise(F.expr("CAST(array() AS array<struct<role:string,text:string>>)"))


def canonical_turns(records: DataFrame, keep: Sequence[str], layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """One row per turn: ``keep`` columns, ``layout``, ``position`` (in the record), ``role`` and ``text``.

    ``records`` may mix layouts, as ``spark.read.json`` returns them: one column per field, null where a record
    has none. Of the paths that layouts know and the schema has, those present in a record make its fingerprint,
    which selects the layout. A record with an unknown fingerprint has one row with null layout, role and text;
    so has one without any turn (an empty message list), with its layout. No shuffle, no Python.

    Null roles and texts of turns are empty. Fields outside all layouts are ignored, also where they are named like
    new columns; a column of ``keep`` with such a name is an error.
    """
    clash = {"layout", "position", "role", "text"} & set(keep)
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)} before keeping them")
    there = set(field_paths(records.schema))
    usable = [x for x in layouts if x.paths() - set(x.optional) <= there and x.paths() & there]
    known = set().union(*[x.paths() & there for x in usable]) if usable else set()
    new = F.lit(None).cast("string")
    choice, turns = new, F.lit(None).cast("array<struct<role:string,text:string>>")
    for layout in reversed(usable):
        fits = F.col("_fingerprint").isin(layout.fingerprints())
        rules = [_turns(_within(rule, there)) for rule in layout.rules if set(_within(rule, there).paths()) & there]
        choice = F.when(fits, F.lit(layout.name)).otherwise(choice)
        turns = F.when(F.col("_layout") == layout.name, F.concat(*rules)).otherwise(turns)
    marked = records.withColumn("_fingerprint", record_fingerprint(sorted(known)) if known else new)
    marked = marked.withColumn("_layout", choice)
    kept = [F.col(f"`{c}`") for c in keep]
    return marked.select(*kept, F.col("_layout").alias("layout"), F.posexplode_outer(turns).alias("position", "_turn")).select(
        *kept, "layout", F.col("position").cast("long").alias("position"), "_turn.role", "_turn.text"
    )


def _within(rule: Rule, there: set[str]) -> Rule:
    """The rule without texts that the schema does not have."""
    texts = tuple(t for t in rule.texts if (f"{rule.each}[].{t}" if rule.each else t) in there)
    return Rule(texts, rule.role, rule.role_field, rule.each, rule.names, rule.always) if texts else rule


# Template --------------------------------------------------------------------------------------------

USER, ASSISTANT, SYSTEM = ("[INST] ", " [/INST]"), ("", "</s>"), ("<<SYS>>\n", "\n<</SYS>>\n\n")
OTHER, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
JOINER = "⁠"
_REST = r"s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|\|role\|>|\|text\|>|\|end\|>"
_CONTROL = rf"([<\[])({JOINER}*)({_REST})"
_ESCAPED = re.compile(rf"([<\[]){JOINER}({JOINER}*)({_REST})")


def escape(text: Column) -> Column:
    """A word joiner more inside every control string, with or without joiners there: so it can be undone."""
    return F.regexp_replace(text, _CONTROL, f"$1{JOINER}$2$3")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(turns: DataFrame) -> DataFrame:
    """``turns`` with ``piece``, the formatted turn, and ``loss``, spans of code points of the piece.

    The text of a conversation is its pieces one after the other. User turns are ``[INST] text [/INST]``, assistant
    turns ``text</s>``, system turns stand between ``<<SYS>>`` marks, other roles (the empty one too) between
    ``<|role|>``, ``<|text|>`` and ``<|end|>``. Control strings inside roles and texts are escaped, so marks are
    unambiguous and reading back gives the same role and text. The loss covers the texts of assistant turns.
    Columns named ``piece`` and ``loss`` are replaced.
    """
    role, text = F.col("role"), escape(F.col("text"))
    begin = F.when(role == "user", USER[0]).when(role == "assistant", ASSISTANT[0]).when(role == "system", SYSTEM[0])
    begin = begin.otherwise(F.concat(F.lit(OTHER), escape(role), F.lit(TEXT)))
    end = F.when(role == "user", USER[1]).when(role == "assistant", ASSISTANT[1]).when(role == "system", SYSTEM[1])
    parts = turns.withColumn("_begin", begin).withColumn("_text", text).withColumn("_end", end.otherwise(END))
    length = F.length("_begin").cast("long")
    span = F.struct(length.alias("start"), (length + F.length("_text")).alias("end"))
    nothing = F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)")
    return (
        parts.withColumn("piece", F.concat("_begin", "_text", "_end"))
        .withColumn("loss", F.when(role == "assistant", F.array(span)).otherwise(nothing))
        .drop("_begin", "_text", "_end")
    )


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts read from formatted text by its marks alone."""
    found, at = [], 0
    while at < len(formatted):
        if formatted.startswith(OTHER, at):
            split = formatted.index(TEXT, at)
            role, begin, mark = unescape(formatted[at + len(OTHER) : split]), split + len(TEXT), END
        elif formatted.startswith(USER[0], at):
            role, begin, mark = "user", at + len(USER[0]), USER[1]
        elif formatted.startswith(SYSTEM[0], at):
            role, begin, mark = "system", at + len(SYSTEM[0]), SYSTEM[1]
        else:
            role, begin, mark = "assistant", at, ASSISTANT[1]
        end = formatted.index(mark, begin)
        found.append((role, unescape(formatted[begin:end])))
        at = end + len(mark)
    return found


# Reading back ----------------------------------------------------------------------------------------

_READ = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Digest:
    def __init__(self):
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, spans: list[dict]) -> None:
        for role, text in parse(piece):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        for span in spans:
            text = unescape(piece[span["start"] : span["end"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.chars += len(piece)

    def row(self) -> tuple:
        return self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame, conversation: str, order: Sequence[str]) -> DataFrame:
    """Digests of each conversation, from its pieces and loss spans alone.

    Pieces of a conversation stream in order through one digest, so memory is bounded by a piece; a digest of all
    its text is one sequence, which no split of a very long conversation can spread. Null ids are one conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, out = None, None, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["_conv", *[c.split()[0] for c in _READ.split(", ")]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in slices(batches, "piece"):
            for conv, piece, spans in zip(*[batch.column(c).to_pylist() for c in ("_conv", "piece", "loss")], strict=True):
                if state is None or conv != current:
                    if state is not None:
                        out.append((current, *state.row()))
                    current, state = conv, _Digest()
                state.add(piece, spans)
            if len(out) >= 4096:
                yield flush()
                out.clear()
        if state is not None:
            out.append((current, *state.row()))
            yield flush()

    rows = formatted.withColumn("_conv", F.col(conversation).cast("long")).repartition("_conv")
    rows = rows.sortWithinPartitions("_conv", *[F.asc_nulls_first(c) for c in order]).select("_conv", "piece", "loss")
    return rows.mapInArrow(run, f"_conv long, {_READ}").withColumnRenamed("_conv", conversation)


def format_conversations(
    records: DataFrame, conversation: str = "conv_id", turn: str = "turn", layouts: Sequence[Layout] = LAYOUTS
) -> DataFrame:
    """Formatted turns of records of any layout, written to the shared folder once.

    Records with the same ``conversation`` follow each other by ``turn`` (null first), equal turns by role and piece;
    records of unknown layout, and those without turns, have no piece. An empty table gives no rows.
    """
    prepare(records)
    turns = canonical_turns(records, [conversation, turn], layouts).where(F.col("role").isNotNull())
    return stage(render(turns).select(conversation, turn, "position", "role", "piece", "loss"), "formatted")
