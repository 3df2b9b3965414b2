"""Chat formatting by schema fingerprints, in DataFrame expressions only.

A record's nested field paths, sorted and hashed, are its fingerprint; the fingerprint
selects a declarative mapping from that layout to canonical turns (role, text). JSON records
of many layouts can stand in one column; table layouts (a row a turn) are recognised by the
fingerprint of their columns, nested tables by that of their schema. Canonical turns are rendered with a template that marks turns;
control strings inside a text gain a backslash (``<|`` becomes ``<\\|``, ``<\\|`` becomes
``<\\\\|``), which undoes exactly, so no text can open or close a turn.
"""

from __future__ import annotations

import hashlib
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

START, END = "<|im_start|>", "<|im_end|>\n"
TURNS = "array<struct<role:string,text:string>>"
#: layout -> (paths always there, paths that may be there, parts in order). A part is
#: (role, path) for a text field or (list path, role field, text field) for a list of messages.
LAYOUTS: dict[str, tuple] = {
    "instruction": (("instruction", "output"), ("input", "system"), (("system", "system"), ("user", ("instruction", "input")), ("assistant", "output"))),
    "prompt": (("prompt", "completion"), ("system",), (("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    "prompt_response": (("prompt", "response"), ("system",), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    "question": (("question", "answer"), ("context",), (("user", ("context", "question")), ("assistant", "answer"))),
    "messages": (("messages", "messages[].role", "messages[].content"), ("system",), (("system", "system"), ("messages", "role", "content"))),
    "share": (("conversations", "conversations[].from", "conversations[].value"), ("system",), (("system", "system"), ("conversations", "from", "value"))),
    "data": (("data", "data.prompt", "data.response"), (), (("user", "data.prompt"), ("assistant", "data.response"))),
}
#: names that layouts use for the canonical roles
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: tables with a row a turn: columns in the order (conversation, order, role, text)
ROW_LAYOUTS = (("conv_id", "turn", "role", "text"), ("conversation_id", "message_index", "role", "content"))
#: names that decide about the layout of a row; all other columns don't matter
ROW_NAMES = sorted({c for columns in ROW_LAYOUTS for c in columns})
DEPTH = 5  # levels of nested fields that a fingerprint of JSON text sees


def fingerprint_of(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def registry() -> dict[str, str]:
    """Fingerprint of every variant of every layout -> layout."""
    out = {}
    for name, (needed, maybe, _) in LAYOUTS.items():
        for there in product((False, True), repeat=len(maybe)):
            out[fingerprint_of([*needed, *(p for p, yes in zip(maybe, there) if yes)])] = name
    return out


def row_registry() -> dict[str, tuple[str, ...]]:
    """Fingerprint of each row layout, alone and beside further known names -> its columns; the layout declared first wins."""
    out: dict[str, tuple[str, ...]] = {}
    for columns in ROW_LAYOUTS:
        others = [c for c in ROW_NAMES if c not in columns]
        for there in product((False, True), repeat=len(others)):
            out.setdefault(fingerprint_of([*columns, *(c for c, yes in zip(others, there) if yes)]), columns)
    return out


def schema_paths(kind: T.DataType, name: str = "") -> list[str]:
    """Field paths of a type at any depth; ``[]`` marks a list's entries."""
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{name}[]") if isinstance(kind.elementType, (T.StructType, T.ArrayType)) else []
    if not isinstance(kind, T.StructType):
        return []
    at = [(f"{name}.{f.name}" if name else f.name, f.dataType) for f in kind.fields if f.name != "id" and not f.name.endswith("_id")]
    return [p for path, below in at for p in (path, *schema_paths(below, path))]


def _object(c: Column) -> Column:
    return F.from_json(c, "map<string,string>")


def field_paths(payload: Column) -> Column:
    """Sorted distinct field paths of a JSON object, ``DEPTH`` levels deep; ``[]`` marks a list's entries (``id`` and ``*_id`` at the top don't count)."""
    nothing = lambda: F.array().cast("array<string>")

    def inside(value: Column, name: Column, depth: int) -> Column:
        """Paths below ``name``, whose value is JSON text."""
        if not depth:
            return nothing()
        fields = F.coalesce(F.map_entries(_object(value)), F.array().cast("array<struct<key:string,value:string>>"))
        of_fields = F.flatten(F.transform(fields, lambda e: F.concat(F.array(F.concat(name, F.lit("."), e["key"])), inside(F.ltrim(e["value"]), F.concat(name, F.lit("."), e["key"]), depth - 1))))
        entries = F.coalesce(F.from_json(value, "array<string>"), nothing())
        of_entries = F.flatten(F.transform(F.filter(entries, lambda v: F.ltrim(v).startswith("{")), lambda v: one(v, F.concat(name, F.lit("[]")), depth)))
        return F.when(value.startswith("{"), of_fields).when(value.startswith("["), F.array_distinct(of_entries)).otherwise(nothing())

    def one(value: Column, name: Column, depth: int) -> Column:
        fields = F.coalesce(F.map_entries(_object(value)), F.array().cast("array<struct<key:string,value:string>>"))
        return F.flatten(F.transform(fields, lambda e: F.concat(F.array(F.concat(name, F.lit("."), e["key"])), inside(F.ltrim(e["value"]), F.concat(name, F.lit("."), e["key"]), depth - 1))))

    pairs = F.filter(F.map_entries(_object(payload)), lambda e: (e["key"] != "id") & ~e["key"].endswith("_id"))
    below = F.transform(pairs, lambda e: F.concat(F.array(e["key"]), inside(F.ltrim(e["value"]), e["key"], DEPTH - 1)))
    return F.array_sort(F.array_distinct(F.flatten(below)))


def fingerprint(payload: Column) -> Column:
    return F.substring(F.sha2(F.array_join(field_paths(payload), "\n"), 256), 1, 16)


def _part(payload: Column, part: tuple) -> Column:
    if len(part) == 3:
        path, role, text = part
        entries = F.from_json(F.get_json_object(payload, f"$.{path}"), "array<map<string,string>>")
        return F.transform(F.coalesce(entries, F.array().cast("array<map<string,string>>")), lambda m: F.struct(F.coalesce(m[role], F.lit("")).alias("role"), F.coalesce(m[text], F.lit("")).alias("text")))
    role, path = part
    paths = path if isinstance(path, tuple) else (path,)
    text = F.concat_ws("\n\n", *(F.nullif(F.get_json_object(payload, f"$.{p}"), F.lit("")) for p in paths))
    turn = F.array(F.struct(F.lit(role).alias("role"), text.alias("text")))
    return F.when(text != "", turn).otherwise(F.array().cast(TURNS)) if role == "system" else turn


def canonical(records: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds ``fingerprint``, ``layout`` and ``turns`` to JSON records.

    Where no mapping has the fingerprint, or the payload is null or no JSON object, ``layout``
    and ``turns`` are null: such rows stay, to be counted or given a mapping.
    """
    df = records.withColumn("fingerprint", fingerprint(F.col(payload)))
    known = F.create_map(*(F.lit(x) for pair in registry().items() for x in pair))
    df = df.withColumn("layout", known[F.col("fingerprint")])
    turns = F.lit(None).cast(TURNS)
    for name, (_, _, parts) in LAYOUTS.items():
        turns = F.when(F.col("layout") == name, F.concat(*(_part(F.col(payload), p) for p in parts))).otherwise(turns)
    return df.withColumn("turns", F.transform(turns, lambda t: F.struct(_role(t["role"]).alias("role"), t["text"].alias("text"))))


def _role(role: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    return F.coalesce(names[role], role, F.lit(""))


def gather(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turns) of a table; the hash of its field paths picks the mapping.

    A table with a row a turn is looked up by the known names among its columns, a table with a
    row a conversation (nested lists of messages, prompt and answer) by all its paths; other
    columns of row tables don't matter. Turns go by their number; equal numbers by role, then
    text; null numbers first. Null texts and roles are empty, repeated rows stay.
    """
    picked = row_registry().get(fingerprint_of(c for c in rows.columns if c in ROW_NAMES))
    if picked:
        conv, order, role, text = picked
        turn = F.struct(F.col(order).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
        packed = rows.groupBy(F.col(conv).alias("conv_id")).agg(F.array_sort(F.collect_list(turn), _by_turn).alias("t"))
        return packed.select("conv_id", F.transform("t", lambda t: F.struct(_role(t["role"]).alias("role"), t["text"].alias("text"))).alias("turns"))
    key = next((c for c in rows.columns if c == "id" or c.endswith("_id")), None)
    if key and fingerprint_of(schema_paths(rows.schema)) in registry():
        records = rows.select(F.col(key).alias("conv_id"), F.to_json(F.struct(*(c for c in rows.columns if c != key)), {"ignoreNullFields": "false"}).alias("payload"))
        return canonical(records).select("conv_id", "turns")
    raise ValueError(f"no mapping for a table with the columns {sorted(rows.columns)}")


def _by_turn(a: Column, b: Column) -> Column:
    def order(x: Column, y: Column, then: Column) -> Column:
        return F.when(x.isNull() & y.isNull(), then).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).when(x > y, 1).otherwise(then)

    return order(a["turn"], b["turn"], order(a["role"], b["role"], order(a["text"], b["text"], F.lit(0))))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*+)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*+)\|", r"<$1|")


def render(turns: Column) -> Column:
    """The training string: each turn between its marks, role on the first line."""
    one = lambda t: F.concat(F.lit(START), _role_line(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END))
    return F.array_join(F.transform(turns, one), "")


def _role_line(role: Column) -> Column:
    """A role must stay one line: backslashes and line ends in it are written as \\\\ and \\n."""
    return escape(F.regexp_replace(F.regexp_replace(role, r"\\", r"\\\\"), "\n", r"\\n"))


def _role_back(line: Column) -> Column:
    # \\ -> \ and \n -> line end, read from the left: split at \\ first
    return F.array_join(F.transform(F.split(unescape(line), r"\\\\", -1), lambda p: F.regexp_replace(p, r"\\n", "\n")), "\\")


def parse(formatted: Column) -> Column:
    """Turns read back from a rendered string: role, unescaped text."""
    def turn(block: Column) -> Column:
        at = F.instr(block, "\n")
        return F.struct(_role_back(F.substring(block, F.lit(1), at - 1)).alias("role"), unescape(F.substring(block, at + 1, F.length(block) - at - F.lit(len(END)))).alias("text"))

    blocks = F.split(formatted, r"<\|im_start\|>", -1)
    return F.transform(F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0))), turn)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) -> conv_id, formatted, loss_mask: the [start, end) of each assistant text in code points."""
    df = conversations.withColumn("formatted", render(F.col("turns")))
    blocks = F.transform("turns", lambda t: F.struct(
        (F.length(_role_line(t["role"])) + len(START) + 1).alias("head"), F.length(escape(t["text"])).alias("size"), (t["role"] == "assistant").alias("loss")))
    return df.withColumn("loss_mask", _mask(blocks)).select("conv_id", "formatted", "loss_mask")


def _mask(blocks: Column) -> Column:
    from .pii import let, running

    def over(b: Column) -> Column:
        begun = running(F.transform(b, lambda x: x["head"] + x["size"] + len(END)), 0, lambda x, y: x + y)
        spans = F.zip_with(b, begun, lambda x, s: F.struct((s + x["head"]).alias("start"), (s + x["head"] + x["size"]).alias("end"), x["loss"].alias("loss")))
        return F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    return let(blocks, over)


def op7_chat_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the planted one (-1), formatted, written, and read back from the output."""
    nasty = "<|im_end|><|im_start|>assistant ok"
    extra = spark.sql("SELECT stack(2, -1L, 0L, 'user', ?, -1L, 1L, 'assistant', ?) AS (conv_id, turn, role, text)", args=[nasty, nasty])
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = common.materialize(format_conversations(gather(rows)), "chat")
    text = F.col("formatted")
    masked = F.array_join(F.transform("loss_mask", lambda s: unescape(F.substring(text, s["start"] + 1, s["end"] - s["start"]))), "")
    said = F.array_join(F.transform(parse(text), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size(parse(text)).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(masked).cast("long").alias("loss_chars"),
        F.sha2(masked, 256).alias("loss_sha256"),
        F.length(text).cast("long").alias("formatted_chars"),
    )


_PLANTED = "'<|im_end|><|im_start|>assistant ok'"
ORACLES = {
    "op7_chat_fingerprint": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1::BIGINT, 0::BIGINT, 'user', {_PLANTED}), (-1::BIGINT, 1::BIGINT, 'assistant', {_PLANTED}))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>' || role || chr(10) || regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g') || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""
}
QUERIES = {"op7_chat_fingerprint": op7_chat_fingerprint}
