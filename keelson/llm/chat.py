"""Chat formatting: schema fingerprints choose declarative mappings to canonical turns.

A *layout* is the sorted list of the nested field paths that any mapping knows
(``messages[].role``); its hash picks the mapping, so typed tables (paths of
the DataFrame schema) and JSON records (paths of each record) with different
prompt, instruction or message layouts become the same ``array<struct<role,
text>>``.  Everything is DataFrame / SQL functions.

Template: ``<turn ROLE>TEXT</turn>\\n`` for each turn.  Inside texts a backslash
becomes ``\\s`` and ``<`` becomes ``\\l`` (in roles ``>`` becomes ``\\g`` too), so no
text can hold a control string, and the change is reversible by plain replaces.

Contract for odd input: a null role or text is empty; turns sort by turn (nulls
first), then role, then text, repeated rows stay; a record of an unknown layout
(or no valid JSON object) keeps its row with layout null and no turns; an empty
table gives an empty table.  Paths no mapping knows do not enter the
fingerprint, so extra columns and fields are harmless.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """``fields``: DDL of the record; ``turns``: SQL for its turns, or None for one row per turn."""

    name: str
    paths: tuple[str, ...]
    fields: str
    turns: str | None


def _pair(*turns: tuple[str, str]) -> str:
    return "array(" + ", ".join(f"named_struct('role', '{r}', 'text', coalesce({t}, ''))" for r, t in turns) + ")"


def _list(of: str, role: str, text: str) -> str:
    return f"transform({of}, m -> named_struct('role', coalesce({role}, ''), 'text', coalesce({text}, '')))"


# in `turns`, {r} stands before a field of the record
_SPEAKER = "CASE m.`from` WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.`from` END"
_ASK = "if(coalesce({r}input, '') = '', {r}instruction, concat(coalesce({r}instruction, ''), '\\n\\n', {r}input))"

MAPPINGS = (
    Mapping("turn_rows", ("role", "text", "turn"), "", None),
    Mapping("messages", ("messages", "messages[].content", "messages[].role"),
            "messages array<struct<role:string,content:string>>", _list("{r}messages", "m.role", "m.content")),
    Mapping("speakers", ("conversations", "conversations[].from", "conversations[].value"),
            "conversations array<struct<`from`:string,value:string>>", _list("{r}conversations", _SPEAKER, "m.value")),
    Mapping("prompt_response", ("prompt", "response"), "prompt string, response string",
            _pair(("user", "{r}prompt"), ("assistant", "{r}response"))),
    Mapping("prompt_completion", ("completion", "prompt"), "prompt string, completion string",
            _pair(("user", "{r}prompt"), ("assistant", "{r}completion"))),
    Mapping("system_prompt_response", ("prompt", "response", "system"),
            "system string, prompt string, response string",
            _pair(("system", "{r}system"), ("user", "{r}prompt"), ("assistant", "{r}response"))),
    Mapping("instruction", ("instruction", "output"), "instruction string, output string",
            _pair(("user", "{r}instruction"), ("assistant", "{r}output"))),
    Mapping("instruction_input", ("input", "instruction", "output"),
            "instruction string, input string, output string",
            _pair(("user", _ASK), ("assistant", "{r}output"))),
    Mapping("question_answer", ("answer", "question"), "question string, answer string",
            _pair(("user", "{r}question"), ("assistant", "{r}answer"))),
)
KNOWN_PATHS = tuple(sorted({p for m in MAPPINGS for p in m.paths}))
LISTS = tuple(sorted({p.split("[]")[0] for p in KNOWN_PATHS if "[]" in p}))


def fingerprint(paths) -> str:
    """Hash of the known ones among the field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths) & set(KNOWN_PATHS))).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(m.paths): m for m in MAPPINGS}


def schema_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a schema; ``[]`` stands for the elements of an array."""
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{prefix}[]")
    if not isinstance(kind, T.StructType):
        return []
    out = []
    for f in kind.fields:
        path = f"{prefix}.{f.name}" if prefix else f.name
        out += [path, *schema_paths(f.dataType, path)]
    return out


def mapping_of(df: DataFrame) -> Mapping | None:
    return BY_FINGERPRINT.get(fingerprint(schema_paths(df.schema)))


def _prefixed(names: Column, prefix: Column) -> Column:
    return F.transform(names, lambda k: F.concat(prefix, k))


def json_fingerprint(record: Column) -> Column:
    """The same hash for a JSON record: its own field names and, of known lists, those of all elements."""
    none = F.array().cast("array<string>")
    paths = [F.coalesce(F.json_object_keys(record), none)]
    for name in LISTS:
        elements = F.from_json(F.get_json_object(record, f"$.{name}"), "array<string>")
        inner = F.flatten(F.transform(elements, lambda e: F.coalesce(F.json_object_keys(e), none)))
        prefix = F.lit(f"{name}[].")
        paths.append(F.coalesce(_prefixed(inner, prefix), none))
    known = F.array_intersect(F.flatten(F.array(*paths)), F.array(*map(F.lit, KNOWN_PATHS)))
    return F.sha2(F.array_join(F.sort_array(known), "\n").cast("binary"), 256)


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, layout, turns) of a typed table, by the fingerprint of its schema."""
    m = mapping_of(df)
    if m is None:
        return df.select(F.col(id_col), F.lit(None).cast("string").alias("layout"),
                         F.expr(f"cast(array() as {TURNS})").alias("turns"))
    if m.turns is not None:
        return df.select(F.col(id_col), F.lit(m.name).alias("layout"),
                         F.coalesce(F.expr(m.turns.format(r="")), F.expr(f"cast(array() as {TURNS})")).alias("turns"))
    # one row per turn: a conversation is one output value, so its rows must meet
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return (df.groupBy(id_col).agg(F.sort_array(F.collect_list(turn)).alias("rows"))
            .select(F.col(id_col), F.lit(m.name).alias("layout"),
                    F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns")))


def canonical_turns_json(df: DataFrame, id_col: str = "conv_id", record_col: str = "record") -> DataFrame:
    """(id, layout, turns) of JSON records, each by its own fingerprint."""
    record = F.col("__record")
    keyed = df.select(F.col(id_col).alias("__id"), F.col(record_col).cast("string").alias("__record")) \
        .withColumn("__key", json_fingerprint(record))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for key, m in BY_FINGERPRINT.items():
        if m.turns is not None:
            hit = F.col("__key") == key
            layout = F.when(hit, m.name).otherwise(layout)
            turns = F.when(hit, F.expr(m.turns.format(r=f"from_json(__record, '{m.fields}')."))).otherwise(turns)
    return keyed.select(F.col("__id").alias(id_col), layout.alias("layout"),
                        F.coalesce(turns, F.expr(f"cast(array() as {TURNS})")).alias("turns"))


# ---------------------------------------------------------------- template

def escaped(text: Column, role: bool = False) -> Column:
    text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))
    return F.replace(text, F.lit(">"), F.lit("\\g")) if role else text


def unescaped(text: Column) -> Column:
    for mark, char in (("\\g", ">"), ("\\l", "<"), ("\\s", "\\")):
        text = F.replace(text, F.lit(mark), F.lit(char))
    return text


HEAD, HEAD_END, TAIL = "<turn ", ">", "</turn>\n"


def format_turns(df: DataFrame, learn: str = "assistant") -> DataFrame:
    """``df`` (with ``turns``) plus ``formatted`` and ``loss_mask``: the places, in code points, of the
    escaped texts of role ``learn`` (array<struct<start,end>>, end exclusive)."""
    parts = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(HEAD), escaped(t["role"], role=True), F.lit(HEAD_END)).alias("head"),
        escaped(t["text"]).alias("body"), (t["role"] == learn).alias("learn")))
    sized = F.transform("__parts", lambda p: F.struct(
        F.length(p["head"]).alias("head"), F.length(p["body"]).alias("body"), p["learn"].alias("learn")))
    empty = F.struct(F.lit(0).cast("bigint").alias("at"),
                     F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("mask"))

    def step(acc, p):
        start = acc["at"] + p["head"]
        span = F.struct(start.alias("start"), (start + p["body"]).alias("end"))
        return F.struct((start + p["body"] + len(TAIL)).alias("at"),
                        F.when(p["learn"], F.concat(acc["mask"], F.array(span))).otherwise(acc["mask"]).alias("mask"))

    formatted = F.array_join(F.transform("__parts", lambda p: F.concat(p["head"], p["body"], F.lit(TAIL))), "")
    return (df.withColumn("__parts", parts)
            .withColumn("formatted", formatted)
            .withColumn("loss_mask", F.aggregate(sized, empty, step)["mask"])
            .drop("__parts"))


def read_turns(formatted: Column) -> Column:
    """The turns (array<struct<role,text>>) read back from a formatted conversation."""
    parts = F.filter(F.split(formatted, TAIL), lambda p: p != "")   # texts hold no `<`, every part starts with HEAD
    return F.transform(parts, lambda p: F.struct(
        unescaped(F.substring(F.substring_index(p, HEAD_END, 1), F.lit(len(HEAD) + 1),
                              F.length(F.substring_index(p, HEAD_END, 1)))).alias("role"),
        unescaped(F.substring(p, F.length(F.substring_index(p, HEAD_END, 1)) + 2, F.length(p))).alias("text")))


def read_masked(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(mask, lambda m: unescaped(
        F.substring(formatted, (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))), "")
