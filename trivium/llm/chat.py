r"""Chat formatting by schema fingerprints (operator 2), with DataFrame functions only.

Records of different layouts (prompt and completion, instruction and input, lists of messages,
one row per turn) lie in one DataFrame. The nested field paths that are present in a record are
hashed; the hash selects a declarative mapping from that layout to canonical turns (role, text).
A record whose fingerprint no mapping names has the mapping null and no turns; its conversation is formatted all the
same, from its other records if any, and counts it as unmapped.

The template writes a turn as

    <turn role=ROLE>
    TEXT</turn>

and a line feed. In texts, \ becomes \b and the control strings <turn and </turn become \lturn and
\l/turn; in roles, <, > and line feeds become \l, \g and \n also. Every backslash of the output
therefore starts an escape, and undoing \l (\g, \n) before \b gives the text back exactly.

The loss mask of a turn is a span of code points within its segment; it covers the text of each
assistant turn and nothing else.

Defined results: null roles and texts are empty; records are ordered by turn and then by their turns' segments, nulls
first, repeated ones included; a null conv_id is a conversation of its own; a conversation without turns is
the empty string; an empty table gives an empty table; columns that no layout names are ignored, input columns named mapping or
turns are replaced by the outputs. A conversation must fit in one string (2 GB).
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A mapping to canonical turns, for records that have all of `needs` and any of `may` among their paths.

    turns: (role, path of the text) for each turn; a role that starts with "$" is a path itself, and with "%" one whose names ROLES translates. With
    `each`, the paths are those within one element of that array.
    """

    name: str
    needs: tuple[str, ...]
    may: tuple[str, ...]
    turns: tuple[tuple[str, str], ...]
    each: str = ""


#: The mappings, in natural order.
LAYOUTS = (
    Layout("turn_rows", ("turn_row",), ("turn_row.role", "turn_row.text"), (("$turn_row.role", "turn_row.text"),)),
    Layout("messages", ("messages[]",), ("messages[].role", "messages[].content"), (("$role", "content"),), each="messages"),
    Layout("conversations", ("conversations[]",), ("conversations[].from", "conversations[].value"), (("%from", "value"),), each="conversations"),
    Layout("prompt_completion", ("prompt", "completion"), (), (("user", "prompt"), ("assistant", "completion"))),
    Layout("instruction", ("instruction", "output"), (), (("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", ("instruction", "input", "output"), (), (("system", "instruction"), ("user", "input"), ("assistant", "output"))),
)
#: Role names of other layouts and what they are here: fixed values.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _has(name: str):
    return lambda x: x[name].isNotNull()


def _turn_of(layout: Layout):
    return lambda m: _turn(*layout.turns[0], at=lambda p: m[p])


def present_paths(schema: T.StructType) -> dict[str, Column]:
    """Nested field paths of a schema, each with a test that a record has it."""
    paths: dict[str, Column] = {}

    def walk(kind: T.DataType, column: Column, path: str) -> None:
        if path:
            paths[path] = F.coalesce(column.isNotNull(), F.lit(False))
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, column[f.name] if path else F.col(f"`{f.name}`"), f"{path}.{f.name}".lstrip("."))
        elif isinstance(kind, T.ArrayType):
            paths[f"{path}[]"] = paths.pop(path)
            if isinstance(kind.elementType, T.StructType):
                for f in kind.elementType.fields:
                    paths[f"{path}[].{f.name}"] = F.coalesce(F.exists(column, _has(f.name)), F.lit(False))

    walk(schema, None, "")
    return paths


def path_hash(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def fingerprint(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Hash of the sorted nested paths present in a record, among the paths that layouts name."""
    named = {p for x in layouts for p in (*x.needs, *x.may)}
    have = {p: c for p, c in present_paths(df.schema).items() if p in named}
    return path_hash(F.array_compact(F.array(*[F.when(have[p], F.lit(p)) for p in sorted(have)])))


def _expected(layout: Layout) -> list[tuple[str, ...]]:
    """All path sets of a layout's records, for any of its optional paths present."""
    return [tuple(sorted((*layout.needs, *some))) for k in range(len(layout.may) + 1) for some in combinations(layout.may, k)]


def _field(schema: T.StructType, path: str) -> bool:
    kind: T.DataType = schema
    for name in path.replace("[]", "").split("."):
        kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return False
        kind = kind[name].dataType
    return True


def _turn(role: str, path: str, at=F.col) -> Column:
    name = at(role[1:]).cast("string") if role[0] in "$%" else F.lit(role)
    if role[0] == "%":
        name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair]), name), name)
    name = F.coalesce(name, F.lit(""))
    return F.struct(name.alias("role"), F.coalesce(at(path).cast("string"), F.lit("")).alias("text"))


def canonical(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """df with mapping (the layout's name, null if unknown) and turns, array of (role, text)."""
    usable = [x for x in layouts if all(_field(df.schema, p) for p in x.needs)]
    print_ = F.col("_trivium_fingerprint")
    marked = df.withColumn("_trivium_fingerprint", fingerprint(df, tuple(usable)) if usable else F.lit(None).cast("long"))
    name, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for x in reversed(usable):
        hashes = [path_hash(F.array(*map(F.lit, paths))) for paths in _expected(x)]
        if x.each:
            made = F.transform(F.col(x.each), _turn_of(x))
        else:
            made = F.array(*[_turn(*t) for t in x.turns])
        hit = print_.isin(hashes)
        name, turns = F.when(hit, F.lit(x.name)).otherwise(name), F.when(hit, made.cast(TURNS)).otherwise(turns)
    return marked.withColumns({"mapping": name, "turns": turns}).drop("_trivium_fingerprint")


def escape(text: Column) -> Column:
    for plain, coded in (("\\", "\\b"), ("<turn", "\\lturn"), ("</turn", "\\l/turn")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    for plain, coded in (("\\", "\\b"), ("<", "\\l"), (">", "\\g"), ("\n", "\\n")):
        role = F.replace(role, F.lit(plain), F.lit(coded))
    return role


def unescape_role(role: Column) -> Column:
    for plain, coded in (("<", "\\l"), (">", "\\g"), ("\n", "\\n"), ("\\", "\\b")):
        role = F.replace(role, F.lit(coded), F.lit(plain))
    return role


HEAD, HEAD_END, TAIL = "<turn role=", ">\n", "</turn>\n"


def segment(turn: Column) -> Column:
    """(segment, loss_start, loss_end) of one turn; no loss where start = end."""
    head = F.concat(F.lit(HEAD), escape_role(turn["role"]), F.lit(HEAD_END))
    body = escape(turn["text"])
    start = F.length(head).cast("long")
    return F.struct(
        F.concat(head, body, F.lit(TAIL)).alias("segment"), start.alias("loss_start"),
        (start + F.when(turn["role"] == "assistant", F.length(body)).otherwise(0)).alias("loss_end"),
    )


def format_turns(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, formatted, loss, unmapped): one string for each conversation of canonical() rows, rendered before the exchange.

    loss: array of (turn, start, end), code points within the turn's segment. unmapped: records without a mapping.
    """
    made = df.select(key, "mapping", F.struct(F.col(order).alias("o"), F.transform("turns", segment).alias("s")).alias("_s"))
    rows = made.groupBy(key).agg(F.sort_array(F.collect_list("_s")).alias("_s"), F.count_if(F.col("mapping").isNull()).alias("unmapped"))
    flat = rows.select(key, "unmapped", F.flatten(F.transform("_s", lambda r: r["s"])).alias("_s"))
    loss = F.transform("_s", lambda s, i: F.struct(i.alias("turn"), s["loss_start"].alias("start"), s["loss_end"].alias("end")))
    return flat.select(
        key, F.array_join(F.transform("_s", lambda s: s["segment"]), "").alias("formatted"),
        F.filter(loss, lambda m: m["start"] < m["end"]).alias("loss"), "unmapped",
    )


def read_back(formatted: DataFrame, key: str) -> DataFrame:
    """(key, turns, losses, formatted_chars, unmapped): turns and loss texts parsed from the formatted string alone and its mask."""
    cut = F.split("formatted", "</turn>\n", -1)
    parts = formatted.select(key, "formatted", "loss", "unmapped", F.slice(cut, 1, F.size(cut) - 1).alias("_p"))
    head_end = lambda p: F.instr(p, HEAD_END)
    turns = F.transform("_p", lambda p: F.struct(
        unescape_role(F.substring(p, F.lit(len(HEAD) + 1), head_end(p) - len(HEAD) - 1)).alias("role"),
        unescape(F.substring(p, head_end(p) + len(HEAD_END), F.length(p))).alias("text")))
    losses = F.transform("loss", lambda m: unescape(F.substring(F.get("_p", m["turn"]), (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))))
    return parts.select(key, turns.alias("turns"), losses.alias("losses"), F.length("formatted").cast("long").alias("formatted_chars"), "unmapped")


def digests(back: DataFrame) -> DataFrame:
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.withColumn("_loss", F.array_join("losses", "")).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars", "unmapped",
    )
