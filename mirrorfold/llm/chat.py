"""Chat formatting: heterogeneous conversation layouts to one template, and back.

A layout is recognised by its fingerprint: the hash of those nested field
paths, among all paths that some mapping names, that a record has. Fields that
no mapping names do not matter. ``LAYOUTS`` maps each fingerprint to a
declarative mapping, which gives canonical turns, an array of (role, text).
``canonical_turns`` takes a typed struct column, whose paths its schema gives:
all rows have one fingerprint. ``canonical_json`` takes a column of JSON texts
and hashes the paths of each row; a field counts if any element of its list
has it. Everything is made of DataFrame functions.

The template marks where a turn starts, where its text starts and where it
ends. A control string inside a role or text gets a backslash behind its first
character; one that has backslashes there already gets one more. So no control
string is left inside, and taking one backslash away restores the text.

Null texts and roles are empty. A conversation is its rows by turn; equal turn
numbers are ordered by role, then text, and repeated rows are repeated turns.
Rows without a conversation id form one conversation. Unknown layouts and
invalid JSON give null turns, which format to null. Empty tables give empty
results; a layout's extra fields and other columns are left alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

TURNS = "array<struct<role: string, text: string>>"
START, TEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LEARNED = "assistant"

# Strings that common chat templates read as control.
CONTROL = [START, TEXT, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


@dataclass(frozen=True)
class Listed:
    """Turns in a list: the path of the list, its fields of role and text, and other names of roles."""

    path: str
    role: str
    text: str
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> list[str]:
        return [self.path, f"{self.path}[].{self.role}", f"{self.path}[].{self.text}"]


@dataclass(frozen=True)
class Fields:
    """Turns in single fields: the role, and the paths whose texts, one to a line, make the turn."""

    turns: tuple[tuple[str, tuple[str, ...]], ...]

    def paths(self) -> list[str]:
        return [p for _, paths in self.turns for p in paths]


OTHER_ROLES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))
LAYOUTS = {
    "messages": Listed("messages", "role", "content"),
    "message_texts": Listed("messages", "role", "text"),
    "conversations": Listed("conversations", "from", "value", OTHER_ROLES),
    "prompt": Fields((("user", ("prompt",)), ("assistant", ("completion",)))),
    "prompt_response": Fields((("user", ("prompt",)), ("assistant", ("response",)))),
    "system_prompt": Fields((("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    "instruction": Fields((("user", ("instruction",)), ("assistant", ("output",)))),
    "instruction_input": Fields((("user", ("instruction", "input")), ("assistant", ("output",)))),
    "nested": Fields((("user", ("data.question",)), ("assistant", ("data.answer",)))),
}
KNOWN_PATHS = sorted({p for layout in LAYOUTS.values() for p in layout.paths()})


def fingerprint(paths: Column) -> Column:
    """Hash of an array of paths in the order of ``KNOWN_PATHS``."""
    return F.xxhash64(F.array_join(paths, "\n"))


def paths_fingerprint(paths: list[str]) -> int:
    """The same hash of paths that are known before any row is read, those of a schema or a layout."""
    found = "\n".join(sorted(set(paths) & set(KNOWN_PATHS)))
    return int.from_bytes(xxhash.xxh64(found.encode(), seed=42).digest(), signed=True)


MAPPINGS = {paths_fingerprint(layout.paths()): layout for layout in LAYOUTS.values()}


def schema_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Every nested field path of a type; ``[]`` stands for the elements of a list."""
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{prefix}[]")
    found = []
    for field in getattr(kind, "fields", []):
        path = f"{prefix}.{field.name}" if prefix else field.name
        found += [path, *schema_paths(field.dataType, path)]
    return found


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _renamed(role: Column, roles: tuple[tuple[str, str], ...]) -> Column:
    out = role
    for other, name in roles:
        out = F.when(role == other, name).otherwise(out)
    return out


def _from_fields(layout: Fields, value) -> Column:
    turns = [_turn(F.lit(role), F.concat_ws("\n", *map(value, paths))) for role, paths in layout.turns]
    return F.array(*turns)


def _from_list(layout: Listed, listed: Column) -> Column:
    return F.transform(listed, lambda x: _turn(_renamed(x[layout.role], layout.roles), x[layout.text]))


def canonical_turns(df: DataFrame, record: str, turns: str = "turns") -> DataFrame:
    """``df`` with the canonical turns of the struct column ``record``; its schema selects the mapping."""
    spec = MAPPINGS.get(paths_fingerprint(schema_paths(df.schema[record].dataType)))
    if isinstance(spec, Listed):
        made = _from_list(spec, F.col(f"{record}.{spec.path}"))
    elif spec is not None:
        made = _from_fields(spec, lambda p: F.col(f"{record}.{p}").cast("string"))
    else:
        made = F.lit(None)
    return df.withColumn(turns, made.cast(TURNS))


def canonical_json(df: DataFrame, record: str, turns: str = "turns", layout: str = "layout") -> DataFrame:
    """``df`` with the canonical turns of the JSON texts ``record`` and the fingerprint that each row was read by."""
    value = F.try_parse_json(F.col(record))

    def at(path: str, kind: str) -> Column:
        return F.try_variant_get(value, f"$.{path}", kind)

    def there(path: str) -> Column:
        listed, _, name = path.partition("[].")
        if not name:
            return at(path, "variant").isNotNull()
        return F.exists(at(listed, "array<variant>"), lambda x: F.try_variant_get(x, f"$.{name}", "variant").isNotNull())

    found = fingerprint(F.array_compact(F.array(*[F.when(there(p), F.lit(p)) for p in KNOWN_PATHS])))
    made = F.lit(None).cast(TURNS)
    for number, spec in MAPPINGS.items():
        if isinstance(spec, Listed):
            kind = f"array<struct<`{spec.role}`: string, `{spec.text}`: string>>"
            mapped = _from_list(spec, at(spec.path, kind))
        else:
            mapped = _from_fields(spec, lambda p: at(p, "string"))
        made = F.when(found == number, mapped).otherwise(made)
    return df.withColumns({turns: made, layout: found})


_FIRST = "([<\\[])"
_REST = "(" + "|".join(re.sub(r"([\[\]|/])", r"\\\1", c[1:]) for c in CONTROL) + ")"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _FIRST + r"(\\*)" + _REST, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _FIRST + r"\\(\\*)" + _REST, "$1$2$3")


def format_turns(df: DataFrame, turns: str = "turns", formatted: str = "formatted", loss: str = "loss") -> DataFrame:
    """``df`` with the formatted text and its loss mask: for each turn the number
    of code points before its learned text, and under the mask, counted from
    the start of the turn; turns of other roles have none under it."""
    pieces = F.transform(turns, lambda t: F.struct(
        F.concat(F.lit(START), escaped(t["role"]), F.lit(TEXT)).alias("head"), escaped(t["text"]).alias("body"),
        (t["role"] == LEARNED).alias("learned")))
    made = df.withColumn("_pieces", pieces)
    return made.withColumn(formatted, F.array_join(F.transform("_pieces", lambda p: F.concat(
        p["head"], p["body"], F.lit(END))), "")).withColumn(loss, F.transform("_pieces", lambda p: F.struct(
            F.length(p["head"]).alias("before"),
            F.when(p["learned"], F.length(p["body"])).otherwise(0).alias("under")))).drop("_pieces")


def read_turns(formatted: str = "formatted") -> Column:
    """The canonical turns, read back from the formatted text."""
    parts = F.slice(F.split(F.col(formatted), re.sub(r"([|])", r"\\\1", START), -1), F.lit(2), F.length(formatted) + 1)
    return F.transform(parts, lambda p: F.struct(
        unescaped(F.substring_index(p, TEXT, 1)).alias("role"),
        unescaped(F.substring_index(F.substring_index(p, TEXT, -1), END, 1)).alias("text")))


def read_loss(formatted: str = "formatted", loss: str = "loss") -> Column:
    """All text under the loss mask, unescaped, turn after turn."""
    parts = F.slice(F.split(F.col(formatted), re.sub(r"([|])", r"\\\1", START), -1), F.lit(2), F.length(formatted) + 1)
    return F.array_join(F.zip_with(parts, F.col(loss), lambda p, m: F.when(m["under"] > 0, unescaped(
        F.substring(p, m["before"] + 1 - len(START), m["under"]))).otherwise("")), "")


def grouped_records(conversations: DataFrame) -> DataFrame:
    """One struct ``record`` per conversation: its rows by turn, as ``messages``."""
    rows = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"),
                                                F.coalesce("text", F.lit("")).alias("text"))))
    return conversations.select("conv_id", "turn", "role", "text").groupBy("conv_id").agg(rows.alias("messages")).select(
        "conv_id", F.struct("messages").alias("record"))


def digests(formatted: DataFrame) -> DataFrame:
    """Figures of every conversation, read back from ``formatted`` and ``loss``."""
    read = formatted.select("conv_id", "formatted", read_turns().alias("turns"), read_loss().alias("learned"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
                       F.length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
                       F.length("formatted").cast("bigint").alias("formatted_chars"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """All conversations and a control case, number -7, in another layout, formatted."""
    said = "</s>[INST] ok [/INST]"
    case = conversations.sparkSession.range(1).select(F.lit(-7).cast("bigint").alias("conv_id"), F.struct(
        F.lit(said).alias("prompt"), F.lit(said).alias("completion")).alias("record"))
    turns = [canonical_turns(df, "record").select("conv_id", "turns") for df in (grouped_records(conversations), case)]
    return format_turns(turns[0].union(turns[1]))
