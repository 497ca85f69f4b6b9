"""Chat formatting: layouts found by schema fingerprint, turned into canonical turns, then text.

A table's nested field paths and types, cut to the vocabulary of field names that layouts use, are
hashed; the fingerprint is looked up in a registry that holds one for every accepted set of paths (a
layout's required fields with any choice of its optional ones) and gives a declarative mapping
(expressions) to canonical turns.  A table with fields of several layouts has a fingerprint of its own;
then the first layout whose fields are all there is taken.  Only metadata is read for the choice, and
everything that follows is DataFrame expressions.

The template writes ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn.  Inside roles and texts,
a ``|`` that follows ``<`` and any number of backslashes gets one backslash more, so no
control string occurs in them, and reading back takes exactly one away.  In roles, line feeds
and backslashes are escaped too.  ``loss`` lists the spans (turn, first code point, length) of the
assistants' texts in the formatted string.  Where a turn begins comes from sums over blocks of 2, 4,
8, ... turns, so n turns take about n log n steps; a conversation is one row and one string by
nature, so a task holds it whole.

Defined cases: null texts and roles are empty; turns are in order of (turn, role, text), so
ties and repeated rows have one order; rows of a null conversation id are one conversation;
ids may be whole numbers or strings; a conversation without turns is the empty text; extra columns,
whatever their names, are ignored unless they complete a layout listed before; of a preference pair
the chosen answer is formatted and the rejected one left out; an empty table gives an empty result;
an unknown layout is refused with its paths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _kind(name: str, kind: T.DataType, top: bool) -> str:
    if top and name in KEYS and isinstance(kind, (T.IntegralType, T.StringType)):
        return "key"
    return "int" if isinstance(kind, T.IntegralType) else kind.simpleString()


def field_paths(kind: T.DataType, at: tuple[str, ...] = ()) -> set[tuple[str, ...]]:
    """Names from the top to each leaf, the leaf's type last; array items are ``[]``.  Whole numbers are one type."""
    if isinstance(kind, T.StructType):
        return {p for f in kind.fields for p in field_paths(f.dataType, (*at, f.name))}
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, (*at, "[]"))
    return {(*at, _kind(at[-1], kind, len(at) == 1))}


def fingerprint(paths: set[tuple[str, ...]]) -> str:
    return hashlib.sha256("\n".join("\0".join(p) for p in sorted(paths)).encode()).hexdigest()[:16]


KEYS = ("id", "conv_id")


def _paths(*written: str) -> frozenset[tuple[str, ...]]:
    return frozenset(tuple(x for part in w.split(".") for x in part.split("/")) for w in written)


@dataclass(frozen=True)
class Layout:
    """Paths a table must have and may have, and SQL for its turns: an array of (turn, role, text), or one turn per row."""

    name: str
    paths: frozenset[tuple[str, ...]]
    conv_id: str
    turns: Callable[[set], str]  # of the optional paths that are there
    optional: frozenset[tuple[str, ...]] = frozenset()
    by_row: bool = False

    def accepted(self) -> list[frozenset]:
        extra = sorted(self.optional)
        return [self.paths | {x for k, x in enumerate(extra) if m >> k & 1} for m in range(1 << len(extra))]


def _said(*turns: tuple[str, str]) -> str:
    return "array(" + ", ".join(f"named_struct('turn', {k}L, 'role', '{r}', 'text', {t})" for k, (r, t) in enumerate(turns)) + ")"


def _list(field: str, role: str, text: str) -> str:
    names = f"case lower(m.{role}) when 'human' then 'user' when 'gpt' then 'assistant' when 'bot' then 'assistant' else m.{role} end"
    return f"transform({field}, (m, i) -> named_struct('turn', cast(i as bigint), 'role', {names}, 'text', {text}))"


_SYSTEM = _paths("system/string")
_ASK = "concat(instruction, if(coalesce(input, '') = '', '', concat('\\n\\n', input)))"


def _pair(first: str, second: str) -> Callable[[set], str]:
    pair = (("user", first), ("assistant", second))
    # a system text that is missing or empty is no turn
    return lambda there: f"if(coalesce(system, '') = '', {_said(*pair)}, {_said(('system', 'system'), *pair)})" if _SYSTEM & there else _said(*pair)


def _dialogue(field: str, role: str, text: str) -> Callable[[set], str]:
    turns = _list(field, role, text)
    head = "array(named_struct('turn', -1L, 'role', 'system', 'text', system))"
    return lambda there: f"if(coalesce(system, '') = '', {turns}, concat({head}, {turns}))" if _SYSTEM & there else turns


def _layout(name: str, key: str, fields: str, turns, optional: str = "system/string", **how) -> Layout:
    return Layout(name, _paths(f"{key}/key", *fields.split()), key, turns, _paths(*optional.split()), **how)


LAYOUTS = [
    _layout("rows", "conv_id", "turn/int role/string text/string", lambda there: "named_struct('turn', cast(turn as bigint), 'role', role, 'text', text)", "", by_row=True),
    _layout("messages", "id", "messages/[]/role/string messages/[]/content/string", _dialogue("messages", "role", "m.content")),
    _layout("messages-parts", "id", "messages/[]/role/string messages/[]/content/[]/type/string messages/[]/content/[]/text/string", _dialogue("messages", "role", "array_join(transform(filter(m.content, c -> c.type = 'text'), c -> coalesce(c.text, '')), '')")),
    _layout("conversations", "id", "conversations/[]/from/string conversations/[]/value/string", _dialogue("conversations", "from", "m.value")),
    _layout("instruction-input", "id", "instruction/string input/string output/string", _pair(_ASK, "output")),
    _layout("instruction", "id", "instruction/string output/string", _pair("instruction", "output")),
    _layout("prompt-completion", "id", "prompt/string completion/string", _pair("prompt", "completion")),
    _layout("prompt-response", "id", "prompt/string response/string", _pair("prompt", "response")),
    _layout("chosen", "id", "prompt/string chosen/string", _pair("prompt", "chosen"), "system/string rejected/string"),
    _layout("question-answer", "id", "question/string answer/string", _pair("question", "answer")),
]
VOCABULARY = frozenset(p for x in LAYOUTS for p in x.paths | x.optional)
REGISTRY: dict[str, Layout] = {fingerprint(set(paths)): x for x in reversed(LAYOUTS) for paths in x.accepted()}


def find_layout(schema: T.StructType) -> Layout:
    """The layout registered under the schema's fingerprint, else the first whose fields the schema has."""
    here = field_paths(schema)
    known = REGISTRY.get(fingerprint(here & VOCABULARY)) or next((x for x in LAYOUTS if x.paths <= here), None)
    if known is None:
        raise ValueError(f"no layout for the fields {', '.join(sorted('/'.join(p) for p in here))}")
    return known


def canonical(df: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (turn, role, text) in order."""
    layout = find_layout(df.schema)
    key, turns = F.col(f"`{layout.conv_id}`"), F.expr(layout.turns(field_paths(df.schema)))
    whole = isinstance(df.schema[layout.conv_id].dataType, T.IntegralType)
    rows = df.select(key.cast("long" if whole else "string").alias("conv_id"), turns.alias("turns"))
    if layout.by_row:
        rows = rows.groupBy("conv_id").agg(F.collect_list("turns").alias("turns"))
    clean = "transform(coalesce(turns, array()), m -> named_struct('turn', m.turn, 'role', coalesce(m.role, ''), 'text', coalesce(m.text, '')))"
    return rows.select("conv_id", F.array_sort(F.expr(clean)).alias("turns"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    parts = F.transform(F.split(role, r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return unescape(F.array_join(parts, "\\"))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are worked out once a row, however often they are used."""
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.withColumn("_made", made).select(*df.columns, *[F.col(f"_made.{n}").alias(n) for n in columns])


def _block_sums(sizes: str) -> Column:
    """Sums over blocks of 1, 2, 4, ... elements, as an array of arrays."""
    pairs = "transform(sequence(0, greatest(0, (size(element_at(acc, -1)) + 1) div 2 - 1)), j -> coalesce(get(element_at(acc, -1), 2 * j), 0L) + coalesce(get(element_at(acc, -1), 2 * j + 1), 0L))"
    return F.expr(f"aggregate(sequence(1, cast(ceil(log2(size({sizes}) + 1)) as int)), array({sizes}), (acc, k) -> concat(acc, array({pairs})))")


def _before(sums: str, i: str) -> str:
    """SQL for the sum of the first ``i`` elements: one block for each bit of ``i``."""
    return f"aggregate(sequence(0, size({sums}) - 1), 0L, (s, b) -> s + if(shiftright({i}, b) % 2 = 1, get(get({sums}, b), shiftright({i}, b) - 1), 0L))"


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (spans) from canonical turns."""
    said = F.transform("turns", lambda m: F.struct(F.concat(F.lit(OPEN), escape_role(m["role"]), F.lit("\n")).alias("head"), escape(m["text"]).alias("text"), (m["role"] == "assistant").alias("learn")))
    out = _once(turns.select("conv_id", "turns"), said=said).drop("turns")
    out = _once(out, sizes=F.transform("said", lambda m: (F.length(m["head"]) + F.length(m["text"]) + len(CLOSE) + 1).cast("long")))
    out = _once(out, sums=_block_sums("sizes"))
    learned = "filter(transform(said, (m, i) -> named_struct('turn', i, 'first', cast(length(m.head) as bigint), 'size', cast(length(m.text) as bigint), 'learn', m.learn)), x -> x.learn)"
    spans = F.expr(f"transform({learned}, x -> named_struct('turn', x.turn, 'first', x.first + {_before('sums', 'x.turn')}, 'size', x.size))")
    whole = F.array_join(F.transform("said", lambda m: F.concat(m["head"], m["text"], F.lit(CLOSE + "\n"))), "")
    return out.select("conv_id", whole.alias("formatted"), spans.alias("loss"))


def parse(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text) and learned (texts under the loss mask), unescaped."""
    pieces = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda p: p != "")
    out = _once(formatted.select("conv_id", "formatted", "loss"), pieces=pieces)
    out = _once(out, sizes=F.transform("pieces", lambda p: (F.length(p) + len(OPEN)).cast("long")))
    out = _once(out, sums=_block_sums("sizes"))
    turns = F.transform("pieces", lambda p: F.struct(unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(_body(p)).alias("text")))
    # a span is cut from its turn's piece, so its place is counted from there
    cut = f"transform(loss, m -> substring(get(pieces, m.turn), cast(m.first - {_before('sums', 'm.turn')} as int) - {len(OPEN)} + 1, cast(m.size as int)))"
    return out.select("conv_id", "formatted", turns.alias("turns"), F.transform(F.expr(cut), unescape).alias("learned"))


def _body(piece: Column) -> Column:
    head = F.length(F.substring_index(piece, "\n", 1)) + 1
    return F.substring(piece, head + 1, F.length(piece) - head - (len(CLOSE) + 1))


def digests(parsed: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    whole = F.array_join(F.transform("turns", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
