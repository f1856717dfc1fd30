"""Chat formatting: records of any known layout, chosen by a fingerprint of their field paths, to one template.

A record is a JSON object. The paths of its fields, at every depth and over all elements of its lists, make
its shape, in the order of names and without the kinds of single values; the shape's hash selects a declarative
mapping from LAYOUTS, which says where the turns are. All expressions are built-in ones; nothing is shuffled by
format_chat itself.

Template: each turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Within roles and texts a backslash is
doubled and each control string (see CONTROLS) gets a backslash after its first character, so the
markers of the formatted text are the only ones in it; a backslash before a newline marks one inside
a role. Dropping each backslash that precedes another character restores the original.

Defined cases: null texts and roles are empty; an unknown layout or a malformed record (of repeated keys, or
one whose field is in one turn a string and in another a list) gives a null layout, no turns and an empty formatted
text; keys that the layout does not use change the fingerprint, so such a record needs a layout of its own; turns
keep their order, repeated ones included; repeated records are formatted each; roles and texts may have any length
(of records over LONG bytes the shape is taken with strings left out); an empty table gives an empty result; other
columns pass through, but those named like the results are replaced by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Strings that no formatted text may hold outside the template's own marks.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Role names in conversations and dialogs to canonical ones; others, and those of messages, stay.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: name -> (paths, kind, fields): kind "list" takes an array of (role, text) objects; kind "parts" one whose texts are
#: lists of parts, joined by an empty line; kind "fields" takes one turn for each (role, field) whose field is not
#: blank, several fields of a turn joined by an empty line.
LAYOUTS = {
    "messages": (("messages[].content", "messages[].role"), "list", ("messages", "role", "content")),
    "messages_parts": (("messages[].content[].text", "messages[].content[].type", "messages[].role"), "parts", ("messages", "role", "content", "text")),
    "conversations": (("conversations[].from", "conversations[].value"), "list", ("conversations", "from", "value")),
    "dialog": (("dialog[].speaker", "dialog[].text"), "list", ("dialog", "speaker", "text")),
    "instruction": (("instruction", "output"), "fields", (("user", ("instruction",)), ("assistant", ("output",)))),
    "instruction_input": (("input", "instruction", "output"), "fields", (("user", ("instruction", "input")), ("assistant", ("output",)))),
    "instruction_system": (("instruction", "output", "system"), "fields", (("system", ("system",)), ("user", ("instruction",)), ("assistant", ("output",)))),
    "prompt_completion": (("completion", "prompt"), "fields", (("user", ("prompt",)), ("assistant", ("completion",)))),
    "prompt_response": (("prompt", "response"), "fields", (("user", ("prompt",)), ("assistant", ("response",)))),
    "question_answer": (("answer", "question"), "fields", (("user", ("question",)), ("assistant", ("answer",)))),
    "question_context_answer": (("answer", "context", "question"), "fields", (("user", ("context", "question")), ("assistant", ("answer",)))),
}
TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        text = F.replace(text, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


#: Bytes beyond which a record's shape is taken from a copy without its strings, of which only the colons tell keys.
LONG = 8 << 20
STRING = r'"(?:[^"\\]++|\\.)*+"'


def shape_of(paths: tuple[str, ...]) -> str:
    """Declared paths -> the shape of records that have just these; [] stands for the elements of a list."""
    tree: dict = {}
    for path in paths:
        at = tree
        for step in path.replace("[]", ".[]").split("."):
            at = at.setdefault(step, {})

    def said(node: dict) -> str:
        if not node:
            return "?"
        if "[]" in node:
            return f"ARRAY<{said(node['[]'])}>"
        return f"OBJECT<{', '.join(f'{k}: {said(v)}' for k, v in sorted(node.items()))}>"

    return said(tree)


def shape(record: Column) -> Column:
    """The record's nested field paths, in one canonical form; null if it is malformed. VARIANT stays, which marks a field
    of mixed kinds, so that no layout fits it."""
    bare = F.regexp_replace(F.regexp_replace(record, rf"(?s)([:\[,{{]\s*+){STRING}(?!\s*+:)", '$1""'), r"(\{[^{}]*+\})(?:\s*+,\s*+\1)++", "$1")
    read = F.schema_of_variant(F.try_parse_json(F.when(F.octet_length(record) > LONG, bare).otherwise(record)))
    return F.regexp_replace(read, r"(?<=: |ARRAY<)(?!VARIANT)(?:[A-Z_]+(?:\([0-9, ]*\))?)(?=[,>])", "?")


def fingerprint(shape: Column) -> Column:
    return F.xxhash64(shape)


def turns_of(record: Column, fields: Column, layout: Column) -> Column:
    out = F.array().cast(TURNS)
    for name, (_, kind, how) in LAYOUTS.items():
        if kind == "list":
            at, role, text = how
            items = F.from_json(fields[at], f"array<struct<`{role}`:string,`{text}`:string>>")
            turns = F.transform(items, lambda x: F.struct(F.coalesce(x[role], F.lit("")).alias("role"), F.coalesce(x[text], F.lit("")).alias("text")))  # noqa: B023
        elif kind == "parts":
            at, role, parts, text = how
            items = F.from_json(fields[at], f"array<struct<`{role}`:string,`{parts}`:array<struct<`{text}`:string>>>>")
            joined = lambda x: F.array_join(F.transform(x[parts], lambda y: y[text]), "\n\n")  # noqa: B023, E731
            turns = F.transform(items, lambda x: F.struct(F.coalesce(x[role], F.lit("")).alias("role"), F.coalesce(joined(x), F.lit("")).alias("text")))  # noqa: B023
        else:
            each = [F.struct(F.lit(r).alias("role"), F.array_join(F.filter(F.array(*(fields[c] for c in cols)), lambda v: v.isNotNull() & (v != "")), "\n\n").alias("text")) for r, cols in how]
            turns = F.filter(F.array(*each), lambda t: t["text"] != "")
        out = F.when(layout == name, F.coalesce(turns, F.array().cast(TURNS))).otherwise(out)
    named = lambda role: F.coalesce(*(F.when(role == said, F.lit(to)) for said, to in ROLES.items()), role)
    renamed = F.transform(out, lambda t: F.struct(named(t["role"]).alias("role"), t["text"].alias("text")))
    return F.when(layout.isin("conversations", "dialog"), renamed).otherwise(out)


def format_chat(records: DataFrame, record: str = "record") -> DataFrame:
    """records -> their columns and fingerprint, layout, formatted, loss_runs.

    loss_runs is the loss mask as run lengths, an element for each turn: skip code points outside the
    mask, then keep inside it, then rest outside. The mask covers each assistant text, escaped, once.
    """
    fields = F.from_json(F.col(record), "map<string,string>")
    df = records.withColumn("__fields", fields).withColumn("fingerprint", fingerprint(shape(F.col(record))))
    known = F.lit(None).cast("string")
    for name, (paths, _, _) in LAYOUTS.items():
        known = F.when(F.col("fingerprint") == fingerprint(F.lit(shape_of(paths))), F.lit(name)).otherwise(known)
    df = df.withColumn("layout", known).withColumn("__turns", turns_of(F.col(record), F.col("__fields"), F.col("layout")))

    def laid(t: Column) -> Column:
        role = F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\\n"))
        return F.struct(F.concat(F.lit(START), role, F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("kept"))

    def run(t: Column) -> Column:
        head, body = F.length(t["head"]), F.length(t["body"])
        kept = F.when(t["kept"], body).otherwise(0)
        return F.struct((head + body - kept).alias("skip"), kept.alias("keep"), F.lit(len(END)).alias("rest"))

    df = df.withColumn("__laid", F.transform("__turns", laid))
    text = F.array_join(F.transform("__laid", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    return df.withColumn("formatted", text).withColumn("loss_runs", F.transform("__laid", run)).drop("__fields", "__turns", "__laid")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text, escapes undone."""
    marked = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    head = r"(?s)^<\|im_start\|>((?:[^\\\n]++|\\.)*+)\n(.*)$"  # possessive: no recursion over a long role
    return F.transform(marked, lambda p: F.struct(unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_extract(p, head, 2)).alias("text")))


def masked_texts(formatted: Column, runs: Column) -> Column:
    """The texts under the loss mask, escapes undone; a piece for each turn, empty where nothing is kept."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    return F.zip_with(parts, runs, lambda p, r: unescape(F.substring(p, r["skip"] + 1, r["keep"])))
