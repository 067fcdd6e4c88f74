"""Chat formatting with DataFrame functions only.

Conversations come in many layouts. The sorted paths of a layout's nested fields, hashed, are its fingerprint, and a table of
fingerprints gives the declarative mapping that turns a layout into canonical turns: ``conv_id, turn, role, text``. For a
DataFrame the paths come from its schema; for a column of JSON documents each row has its own.

Formatted, a turn reads ``<|turn|>role`` line end ``text<|end|>`` line end. Inside roles and texts the first character of
every control string, of this template or of common others, is spelled with a backslash and a digit, and so is a backslash;
so no text can end a turn or begin one, and reading back restores it.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

BEGIN, END = "<|turn|>", "<|end|>\n"
#: Fixed strings that common chat templates give a meaning. Each begins with one of the characters of ``_SPELLED``.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_SPELLED = {"<": "\\1", "[": "\\2"}
_LINE = "\\3"
#: Names of roles that mean a canonical one.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}


@dataclass(frozen=True)
class Layout:
    """Either a list of messages in ``items`` with ``role`` and ``text`` fields, or ``turns``: a role and the fields whose
    texts, those that are not empty, are joined to it by an empty line. Without both, each row is a turn."""

    name: str
    paths: tuple[str, ...]
    items: str | None = None
    role: str = "role"
    text: str = "content"
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()


def _flat(name: str, *turns: tuple[str, tuple[str, ...]]) -> Layout:
    return Layout(name, tuple(f for _, fields in turns for f in fields), turns=turns)


LAYOUTS = (
    Layout("turn rows", ("turn", "role", "text")),
    Layout("messages", ("messages[].role", "messages[].content"), "messages"),
    Layout("from and value", ("conversations[].from", "conversations[].value"), "conversations", "from", "value"),
    Layout("dialog", ("dialog[].speaker", "dialog[].text"), "dialog", "speaker", "text"),
    _flat("instruction with input", ("user", ("instruction", "input")), ("assistant", ("output",))),
    _flat("instruction", ("user", ("instruction",)), ("assistant", ("response",))),
    _flat("system prompt", ("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))),
    _flat("prompt and completion", ("user", ("prompt",)), ("assistant", ("completion",))),
    _flat("prompt and response", ("user", ("prompt",)), ("assistant", ("response",))),
    _flat("question and answer", ("user", ("question",)), ("assistant", ("answer",))),
)


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


MAPPINGS = {fingerprint(layout.paths): layout for layout in LAYOUTS}
_KNOWN = {p for layout in LAYOUTS for p in layout.paths}


def field_paths(kind: DataType, at: str = "") -> list[str]:
    """The paths of all leaves, ``[]`` standing for the items of an array."""
    if isinstance(kind, StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def layout_of(schema: StructType) -> Layout:
    """The mapping for a schema, by the fingerprint of those of its paths that any layout has; if other columns clash with a
    layout's, the first layout in the list with the most paths that are all there."""
    paths = set(field_paths(schema)) & _KNOWN
    found = MAPPINGS.get(fingerprint(paths))
    if found:
        return found
    whole = [layout for layout in LAYOUTS if paths.issuperset(layout.paths)]
    if not whole:
        raise ValueError(f"no layout for the fields {sorted(field_paths(schema))}")
    return max(whole, key=lambda layout: len(layout.paths))


def _canonical_role(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    low = F.lower(F.trim(role))
    return F.coalesce(names[low], F.when(low.isin("user", "assistant", "system"), low), role)


def _turns_of(fields: tuple[tuple[str, tuple[str, ...]], ...], get) -> Column:
    """An array of turns; a system turn without text is left out."""
    turns = []
    for role, names in fields:
        text = F.array_join(F.filter(F.array(*[get(n) for n in names]), lambda t: t != ""), "\n\n")
        turn = F.struct(F.lit(role).alias("role"), text.alias("text"))
        turns.append(F.when((text != "") | F.lit(role != "system"), turn))
    return F.filter(F.array(*turns), lambda t: t.isNotNull())


def _as_rows(df: DataFrame, conv_id: str, turns: Column) -> DataFrame:
    rows = df.select(F.col(conv_id).alias("conv_id"), F.posexplode(turns).alias("turn", "said"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "said.role", "said.text")


def canonical_turns(df: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """``conv_id, turn, role, text`` of a DataFrame in any of the layouts; a conversation without turns has no rows."""
    layout = layout_of(df.schema)
    if layout.items:
        said = F.transform(
            layout.items,
            lambda m: F.struct(
                _canonical_role(m[layout.role].cast("string")).alias("role"), m[layout.text].cast("string").alias("text")
            ),
        )
        return _as_rows(df, conv_id, said)
    if layout.turns:
        return _as_rows(df, conv_id, _turns_of(layout.turns, lambda n: F.col(n).cast("string")))
    turn, role, text = F.col("turn").cast("long").alias("turn"), F.col("role").cast("string"), F.col("text").cast("string")
    return df.select(F.col(conv_id).alias("conv_id"), turn, role.alias("role"), text.alias("text"))


def _json_shape(paths) -> str:
    """How the shape of a JSON document with these paths is spelled, without the types of its leaves."""
    lists: dict[str, list[str]] = {}
    for p in paths:
        top, _, rest = p.partition("[].")
        lists.setdefault(top, []).extend([rest] if rest else [])
    tops = [f"{k}: ARRAY<OBJECT<{', '.join(sorted(v))}>>" if v else k for k, v in sorted(lists.items())]
    return f"OBJECT<{', '.join(tops)}>"


def canonical_turns_of_json(df: DataFrame, json: str, conv_id: str = "conv_id") -> DataFrame:
    """``conv_id, turn, role, text`` of a column of JSON documents, each row in a layout of its own.

    A row's shape is hashed and looked up; a document with more fields takes the first layout whose fields it has. A document
    that is no JSON or fits no layout, and one without messages, has no rows.
    """
    layouts = [x for x in LAYOUTS if x.items or x.turns]
    doc = F.try_parse_json(F.col(json))
    shape = F.regexp_replace(F.expr("schema_of_variant(_doc)"), r": (?!ARRAY|OBJECT)[A-Z]+(\([0-9, ]+\))?", "")
    known = F.create_map(*[x for i, a in enumerate(layouts) for x in (F.xxhash64(F.lit(_json_shape(a.paths))), F.lit(i))])

    def has(path: str) -> Column:
        return F.expr(f"try_variant_get(_doc, '$.{path.partition('[]')[0]}') is not null")

    def text_at(name: str) -> Column:
        return F.expr(f"try_variant_get(_doc, '$.{name}', 'string')")

    def said(layout: Layout) -> Column:
        if layout.turns:
            return _turns_of(layout.turns, text_at)
        items = F.expr(
            f"try_variant_get(_doc, '$.{layout.items}', 'array<struct<`{layout.role}`: string, `{layout.text}`: string>>')"
        )
        return F.transform(
            items, lambda m: F.struct(_canonical_role(m[layout.role]).alias("role"), m[layout.text].alias("text"))
        )

    fits = [F.when(reduce(lambda a, b: a & b, map(has, x.paths)), F.lit(i)) for i, x in enumerate(layouts)]
    rows = df.select(F.col(conv_id).alias("_id"), doc.alias("_doc"))
    rows = rows.withColumn("_layout", F.coalesce(known[F.xxhash64(shape)], *fits))
    turns = F.coalesce(*[F.when(F.col("_layout") == i, said(x)) for i, x in enumerate(layouts)])
    return _as_rows(rows, "_id", turns)


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\0"))
    for control in CONTROL:
        out = F.replace(out, F.lit(control), F.lit(_SPELLED[control[0]] + control[1:]))
    return out


def unescaped(text: Column) -> Column:
    out = text
    for plain, spelled in [*_SPELLED.items(), ("\n", _LINE), ("\\", "\\0")]:
        out = F.replace(out, F.lit(spelled), F.lit(plain))
    return out


def format_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, formatted, loss_spans`` of canonical turns.

    Turns are ordered by number, then role and text; repeated ones stay. Null roles and texts are empty, null numbers come
    first, null ids are one conversation. ``loss_spans`` are the spans of code points, from 0, of the assistant's texts. An
    empty table gives no rows; other columns are not read.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    name = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit(_LINE))
    rows = rows.select("*", name.alias("name"), escaped(F.col("text")).alias("said"))
    rows = rows.withColumn("segment", F.concat(F.lit(BEGIN), "name", F.lit("\n"), "said", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("stop", F.sum(F.length("segment").cast("long")).over(order) - len(END))
    start = F.col("stop") - F.length("said")
    part = F.struct("stop", "segment", start.alias("start"), (F.col("role") == "assistant").alias("loss"))
    parts = F.array_sort(F.collect_list(part))
    whole = rows.groupBy("conv_id").agg(parts.alias("parts"))
    return whole.select(
        "conv_id",
        F.size("parts").cast("long").alias("n_turns"),
        F.array_join(F.transform("parts", lambda p: p["segment"]), "").alias("formatted"),
        F.transform(
            F.filter("parts", lambda p: p["loss"]),
            lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop")),
        ).alias("loss_spans"),
    )


def read_turns(formatted: str = "formatted") -> Column:
    """The turns of a formatted conversation, an array of ``role, text``."""
    parts = F.split(F.col(formatted), re.escape(BEGIN).replace("<", "[<]"), -1)
    bodies = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.substring(p, F.lit(1), F.length(p) - len(END)))

    def turn(body: Column) -> Column:
        name = F.substring_index(body, "\n", 1)
        text = F.substring(body, F.length(name) + 2, F.length(body))
        return F.struct(unescaped(name).alias("role"), unescaped(text).alias("text"))

    return F.transform(bodies, turn)


def read_loss(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """All text under the loss mask, unescaped."""
    whole = F.col(formatted)
    cut = lambda s: F.substring(whole, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))
    return F.array_join(F.transform(F.col(spans), lambda s: unescaped(cut(s))), "")


def digests(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, all read back from the output."""
    read = formatted.select("conv_id", "formatted", read_turns().alias("turns"), read_loss().alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
