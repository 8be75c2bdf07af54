"""Chat formatting with schema fingerprints, in DataFrame functions only.

A record is a VARIANT of any layout. The nested field paths of each record (order left out, objects, arrays and scalars told
apart) are hashed, as far as some layout names them; the fingerprint selects a declarative mapping that says where the
turns are: either fixed roles with the paths of each text, or an array of turns with the names of its role and text
fields. Canonical turns are written as

    <|im_start|>role\\ntext<|im_end|>\\n

Inside roles and texts "<|" cannot occur: every "<", any backslashes and "|" in a row get one more backslash, which reading
takes away again; a line feed in a role is written as "<|nl|>". The loss mask is the list of spans (start, length in code
points) of assistant texts in the formatted string.

Edge cases: null texts and roles are empty; turns are in order of their number, then role and text; rows that repeat are
turns of their own; a record whose array of turns is empty has no turns and an empty output; a record of an
unknown layout has null turns and null output, with its fingerprint, so that none is lost; an empty table gives an empty result; other columns are ignored. A record is one VARIANT value, which bounds it to
what Spark stores in one.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapfold.llm.common import free_names

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"
TURNS = "array<struct<role:string,text:string>>"

#: Layouts: either ("fields", ((role, paths of its text, joined by an empty line), ...)) or ("array", path of the turns, role
#: field, text field). The names are those of layouts in use.
LAYOUTS = (
    ("fields", (("user", ("prompt",)), ("assistant", ("response",)))),
    ("fields", (("user", ("prompt",)), ("assistant", ("completion",)))),
    ("fields", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    ("fields", (("user", ("data.prompt",)), ("assistant", ("data.response",)))),
    ("fields", (("user", ("question",)), ("assistant", ("answer",)))),
    ("fields", (("user", ("instruction",)), ("assistant", ("output",)))),
    ("fields", (("user", ("instruction", "input")), ("assistant", ("output",)))),
    ("array", "messages", "role", "content"),
    ("array", "messages", "role", "text"),
    ("array", "conversations", "from", "value"),
    ("array", "conversation.turns", "speaker", "text"),
)

#: Names of roles in layouts whose role field is called otherwise than "role"; a "role" is taken as it is given.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def required(layout: tuple) -> list[str]:
    """The field paths that a layout reads, sorted; "[]" stands for the elements of an array."""
    if layout[0] == "fields":
        return sorted({p for _, paths in layout[1] for p in paths})
    return sorted(f"{layout[1]}[].{name}" for name in layout[2:])


def field_paths(record: Column) -> Column:
    """Sorted paths of all scalars of a variant, such as "data.prompt" or "messages[].content"; kinds of scalars are left out.

    The tokens of the schema text, OBJECT<a: T, b: ARRAY<OBJECT<c: U>>>, are folded with a stack of open containers.
    An array, an object and a scalar of the same name have different paths.
    """
    tokens = F.regexp_extract_all(F.schema_of_variant(record), F.lit(r"(`(?:[^`]|``)*`|[^<>:,`\s]+): |OBJECT<|ARRAY<|>|[A-Z_]+(?:\([0-9, ]*\))?"), F.lit(0))
    kind = "struct<stack:array<string>,name:string,out:array<string>>"
    start = F.struct(F.array(F.lit("")).alias("stack"), F.lit("").alias("name"), F.array().alias("out")).cast(kind)

    def step(s: Column, token: Column) -> Column:
        here = F.concat(F.element_at(s["stack"], -1), s["name"])
        inside = F.concat(here, F.when(here == "", "").otherwise("."))
        stack = F.when(token == "OBJECT<", F.concat(s["stack"], F.array(inside))).when(token == "ARRAY<", F.concat(s["stack"], F.array(here))).when(token == ">", F.slice(s["stack"], 1, F.greatest(F.lit(1), F.size(s["stack"]) - 1))).otherwise(s["stack"])
        named = F.endswith(token, F.lit(": "))
        name = F.when(named, F.replace(F.regexp_replace(token, "^`|`?: $", ""), F.lit("``"), F.lit("`"))).when(token == "ARRAY<", "[]").otherwise("")
        scalar = ~named & ~token.isin("OBJECT<", "ARRAY<", ">")
        return F.struct(stack.alias("stack"), name.alias("name"), F.when(scalar, F.concat(s["out"], F.array(here))).otherwise(s["out"]).alias("out")).cast(kind)

    return F.array_sort(F.array_distinct(F.aggregate(tokens, start, step)["out"]))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _named(role: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, role), role)


def _mapped(record: Column, layout: tuple) -> Column:
    if layout[0] == "fields":
        texts = lambda paths: F.concat_ws("\n\n", *(F.try_variant_get(record, f"$.{p}", "string") for p in paths))
        return F.array(*(_turn(F.lit(role), texts(paths)) for role, paths in layout[1]))
    _, path, role, text = layout
    rows = F.try_variant_get(record, f"$.{path}", f"array<struct<`{role}`:string,`{text}`:string>>")
    return F.transform(rows, lambda x: _turn(x[role] if role == "role" else _named(x[role]), x[text]))


def _empty(record: Column, path: str) -> Column:
    """Whether a record holds an array without elements where a layout has its turns."""
    return F.coalesce(F.size(F.try_variant_get(record, f"$.{path}", "array<variant>")) == 0, F.lit(False))


def canonical_turns(records: DataFrame, record: str = "record", layouts: tuple = LAYOUTS) -> DataFrame:
    """Adds fingerprint (of the paths that any layout reads) and turns (null for unknown layouts) to rows with a variant.

    A layout is selected by the fingerprint of its paths; a record that holds the paths of several is read by the one
    with the most. Paths that no layout names play no part.
    """
    named = sorted({p for x in layouts for p in required(x)})
    own = F.array_intersect(field_paths(F.col(record)), F.array(*map(F.lit, named)))
    (free,) = free_names(records, "paths")
    out = records.withColumn(free, own).withColumn("fingerprint", F.sha2(F.array_join(free, ","), 256))
    turns = F.lit(None).cast(TURNS)
    ordered = sorted(layouts, key=lambda x: len(required(x)))
    # the last condition asked is the first to hold: exact fingerprints, then the layout with the most paths, then arrays
    # of no turns, whose elements have no paths
    for path in dict.fromkeys(x[1] for x in layouts if x[0] == "array"):
        turns = F.when(_empty(F.col(record), path), F.array().cast(TURNS)).otherwise(turns)
    for x in ordered:
        turns = F.when(F.size(F.array_except(F.array(*map(F.lit, required(x))), F.col(free))) == 0, _mapped(F.col(record), x)).otherwise(turns)
    for x in ordered:
        turns = F.when(F.col("fingerprint") == hashlib.sha256(",".join(required(x)).encode()).hexdigest(), _mapped(F.col(record), x)).otherwise(turns)
    return out.withColumn("turns", turns).drop(free)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(BREAK))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(BREAK), F.lit("\n")))


def formatted(rows: DataFrame) -> DataFrame:
    """Adds formatted (the chat text) and loss_spans (start from 0, length) to rows with turns."""
    parts = F.transform("turns", lambda t: F.struct((t["role"] == "assistant").alias("loss"), F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body")))
    tail = F.lit(END + "\n")
    (own,) = free_names(rows, "parts")
    rows = rows.withColumn(own, parts)
    done = F.array_join(F.transform(own, lambda p: F.concat(p["head"], p["body"], tail)), "")
    # a running position over the turns of one record
    at = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        start, size = state["at"] + F.length(p["head"]), F.length(p["body"]).cast("long")
        span = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct((start + size + F.length(tail)).alias("at"), F.when(p["loss"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    spans = F.aggregate(own, at, step)["spans"]
    return rows.withColumn("formatted", done).withColumn("loss_spans", spans).drop(own)


def read_back(rows: DataFrame) -> DataFrame:
    """Adds read_turns and read_loss (the texts under the mask, unescaped), both from formatted and loss_spans alone."""
    parts = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, 1 << 30)

    def turn(part: Column) -> Column:
        head = F.substring_index(part, "\n", 1)
        body = F.substr(part, F.length(head) + 2, F.length(part) - F.length(head) - 1 - len(END) - 1)
        return F.struct(unescape_role(head).alias("role"), unescape(body).alias("text"))

    under = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return rows.withColumn("read_turns", F.transform(parts, turn)).withColumn("read_loss", under)


def records_of_turns(turns: DataFrame) -> DataFrame:
    """conv_id and record: rows by turn (conv_id, turn, role, text) as one messages record each."""
    row = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    grouped = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    messages = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["content"].alias("content")))
    return grouped.select("conv_id", F.to_variant_object(F.struct(messages.alias("messages"))).alias("record"))


def digests(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read back from the output."""
    said = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("read_loss", "")
    return read_back(rows).select("conv_id", F.size("read_turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
