"""Chat formatting by schema fingerprints.

A record may hold a dialogue in any of several layouts. Each row's fingerprint
is the hash of the nested field paths that hold a value; it selects a
declarative mapping, and the mapping turns the record into canonical turns.
A template then marks the turns, and control strings inside texts are escaped
in a way that ``read_back`` undoes. Everything runs as column functions.

Defined results: a null text or role is empty. Fields of a record that no
mapping knows are ignored; a record whose paths fit no mapping has null turns
and goes to ``unmapped``. Turns with the same number are ordered by role and
text; turns with null numbers come first. Empty conversations give an empty
string. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TURNS = "array<struct<role:string,text:string>>"

#: Columns that hold a record in one of the layouts below.
RECORD_SCHEMA = (
    "prompt string, completion string, instruction string, input string, "
    "output string, messages array<struct<role:string,content:string>>, "
    "conversations array<struct<from:string,value:string>>"
)


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns.

    ``paths`` is the set of field paths that hold a value. ``parts`` is either
    (role, path) pairs of scalar fields, or one (role field, text field) pair
    inside the array ``within``.
    """

    paths: tuple[str, ...]
    parts: tuple[tuple[str, str], ...]
    within: str | None = None


MAPPINGS = (
    Mapping(("prompt", "completion"), (("user", "prompt"), ("assistant", "completion"))),
    Mapping(("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Mapping(
        ("instruction", "input", "output"),
        (("system", "instruction"), ("user", "input"), ("assistant", "output")),
    ),
    Mapping(("messages[].role", "messages[].content"), (("role", "content"),), "messages"),
    Mapping(("conversations[].from", "conversations[].value"), (("from", "value"),), "conversations"),
)


def field_paths(schema: StructType) -> list[tuple[str, Column]]:
    """Each nested field path with a test that the row holds it.

    A scalar field is held if it isn't null, a field inside an array if the
    array has elements, whatever they hold.
    """

    def walk(kind: DataType, path: str, held: Column, at: Column) -> list:
        if isinstance(kind, StructType):
            found = []
            for field in kind.fields:
                inner = at[field.name]
                keep = held if "[]" in path else held & inner.isNotNull()
                found += walk(field.dataType, f"{path}.{field.name}", keep, inner)
            return found
        if isinstance(kind, ArrayType):
            keep = held if "[]" in path else held & (F.size(at) > 0)
            return walk(kind.elementType, f"{path}[]", keep, at)
        return [(path, held)]

    out = []
    for field in schema.fields:
        column = F.col(f"`{field.name}`")
        out += walk(field.dataType, field.name, column.isNotNull(), column)
    return out


def fingerprint_of(paths: Column) -> Column:
    return F.xxhash64(F.array_join(F.array_sort(paths), "|"))


def fingerprint(records: DataFrame, ignore: tuple[str, ...] = ()) -> Column:
    """Hash of the field paths that a row holds; ``ignore`` names other columns."""
    schema = StructType([f for f in records.schema.fields if f.name not in ignore])
    held = [F.when(test, F.lit(path)) for path, test in field_paths(schema)]
    return fingerprint_of(F.array_compact(F.array(*held)))


def _turns(mapping: Mapping) -> Column:
    empty = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    if mapping.within is not None:
        role, text = mapping.parts[0]
        return F.transform(
            mapping.within,
            lambda m: F.struct(empty(m[role]).alias("role"), empty(m[text]).alias("text")),
        )
    return F.array(
        *[
            F.struct(F.lit(role).alias("role"), empty(F.col(path)).alias("text"))
            for role, path in mapping.parts
        ]
    )


def canonical_turns(
    records: DataFrame, ignore: tuple[str, ...] = (),
    mappings: tuple[Mapping, ...] = MAPPINGS,
) -> DataFrame:
    """Add ``fingerprint`` and ``turns``; turns are null if no mapping fits."""
    have = {path for path, _ in field_paths(
        StructType([f for f in records.schema.fields if f.name not in ignore])
    )}
    turns = F.lit(None).cast(TURNS)
    for mapping in mappings:
        if not set(mapping.paths) <= have:
            continue
        own = fingerprint_of(F.array(*[F.lit(p) for p in mapping.paths]))
        turns = F.when(F.col("fingerprint") == own, _turns(mapping)).otherwise(turns)
    return records.withColumn("fingerprint", fingerprint(records, ignore)).withColumn(
        "turns", turns
    )


def escape(text: Column) -> Column:
    r"""Double each backslash, then write ``<|`` as ``<\|``.

    After doubling, a single backslash between ``<`` and ``|`` is new.
    """
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    opened = F.replace(text, F.lit("<\\|"), F.lit("<|"))
    return F.replace(opened, F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    r"""As a text, and a line end as ``<\n``."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def formatted(turns: Column) -> Column:
    """Canonical turns as one string of the template."""
    return F.array_join(
        F.transform(
            turns,
            lambda t: F.concat(
                F.lit(OPEN), escape_role(t["role"]), F.lit("\n"),
                escape(t["text"]), F.lit(CLOSE),
            ),
        ),
        "",
    )


def parsed(text: Column) -> Column:
    """Roles and still escaped bodies of a formatted string.

    Controls never occur inside a text, so a split at the opening one is exact.
    """
    pieces = F.filter(F.split(text, "<\\|im_start\\|>"), lambda p, i: i > 0)
    plain = F.transform(
        pieces,
        lambda p: F.struct(
            F.char_length(p).alias("size"),
            F.substring_index(p, "\n", 1).alias("head"),
            p.alias("piece"),
        ),
    )
    return F.transform(
        plain,
        lambda p: F.struct(
            unescape_role(p["head"]).alias("role"),
            p["piece"].substr(
                F.char_length(p["head"]) + 2,
                p["size"] - F.char_length(p["head"]) - F.lit(1 + len(CLOSE)),
            ).alias("body"),
        ),
    )


def format_records(
    records: DataFrame, key: str, part: str,
) -> DataFrame:
    """One row per key with the formatted text of all its parts in order.

    ``records`` holds a dialogue in one or more records, numbered by ``part``.
    Parts are formatted each for itself, so only finished strings are gathered.
    """
    turns = canonical_turns(records, (key, part))
    pieces = turns.where(F.col("turns").isNotNull()).select(
        F.col(key), F.col(part).alias("_part"), formatted(F.col("turns")).alias("_piece")
    )
    return pieces.groupBy(key).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_part", "_piece"))),
                lambda p: p["_piece"],
            ),
            "",
        ).alias("formatted")
    )


def unmapped(records: DataFrame, key: str, part: str) -> DataFrame:
    """Records that no mapping fits, with their fingerprint."""
    found = canonical_turns(records, (key, part))
    return found.where(F.col("turns").isNull()).select(key, part, "fingerprint")


def read_back(formatted_rows: DataFrame, key: str) -> DataFrame:
    """The unescaped turns of formatted texts."""
    with_turns = formatted_rows.select(
        key, "formatted", F.explode_outer(F.array(parsed(F.col("formatted")))).alias("_p")
    )
    return with_turns.select(
        key,
        "formatted",
        F.transform(
            "_p",
            lambda p: F.struct(p["role"].alias("role"), unescape(p["body"]).alias("text")),
        ).alias("turns"),
    )


def loss_texts(turns: Column) -> Column:
    """The assistant texts, in order."""
    own = F.filter(turns, lambda t: t["role"] == "assistant")
    return F.transform(own, lambda t: t["text"])


def blocks_of_turns(
    rows: DataFrame, key: str = "conv_id", turn: str = "turn",
    role: str = "role", text: str = "text", block: int = 64,
) -> DataFrame:
    """Turn rows as records of up to ``block`` turn numbers each.

    A conversation of any length becomes many small groups. The layout follows
    from the turns: a user and an assistant turn make a prompt record, a lone
    system, user and assistant an instruction record, others a list of
    messages.
    """
    clean = rows.select(
        F.col(key).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    groups = clean.groupBy(
        "conv_id", F.expr(f"floor(turn / {block})").alias("part")
    ).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    roles = F.transform("t", lambda t: t["role"])
    is_pair = roles == F.array(F.lit("user"), F.lit("assistant"))
    is_three = roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    even = F.coalesce(F.pmod("conv_id", F.lit(2)) == 0, F.lit(True))
    odd = ~even
    other = ~is_pair & ~is_three
    as_messages = F.transform(
        "t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))
    )
    as_values = F.transform(
        "t", lambda t: F.struct(t["role"].alias("from"), t["text"].alias("value"))
    )
    at = lambda i: F.get("t", F.lit(i))["text"]
    return groups.select(
        "conv_id",
        "part",
        F.when(is_pair & even, at(0)).alias("prompt"),
        F.when(is_pair & even, at(1)).alias("completion"),
        F.when(is_pair & odd, at(0)).when(is_three, at(0)).alias("instruction"),
        F.when(is_three, at(1)).alias("input"),
        F.when(is_pair & odd, at(1)).when(is_three, at(2)).alias("output"),
        F.when(other & even, as_messages).alias("messages"),
        F.when(other & odd, as_values).alias("conversations"),
    )
