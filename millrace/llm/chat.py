"""Chat formatting by schema fingerprints: a hash of nested field paths selects how a layout becomes turns. DataFrame functions only."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Roles that other layouts call by other names.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """Where a record keeps its turns: one field for each role in order, then a list of messages with a role and a text field.

    With a turn field the record is one turn of its conversation, its number, role and text as they are written.
    """

    messages: str = ""
    role: str = ""
    text: str = ""
    turn: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    #: Further fields that are put behind the user's text, after an empty line.
    joined: tuple[str, ...] = ()

    @property
    def paths(self) -> list[str]:
        if self.turn:
            return sorted([self.turn, self.role, self.text])
        listed = [f"{self.messages}[].{self.role}", f"{self.messages}[].{self.text}"] if self.messages else []
        return sorted([*listed, *(f for _, f in self.fields), *self.joined])


_PLAIN = (
    Layout(messages="messages", role="role", text="content"),
    Layout(messages="conversations", role="from", text="value"),
    Layout(messages="turns", role="role", text="text"),
    Layout(fields=(("user", "prompt"), ("assistant", "response"))),
    Layout(fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout(fields=(("user", "prompt"), ("assistant", "response")), joined=("input",)),
    Layout(fields=(("user", "prompt"), ("assistant", "completion")), joined=("input",)),
    Layout(fields=(("user", "instruction"), ("assistant", "output"))),
    Layout(fields=(("user", "instruction"), ("assistant", "output")), joined=("input",)),
    Layout(fields=(("user", "question"), ("assistant", "answer"))),
)
#: Each also with a system field before its turns; and one turn a record.
LAYOUTS = (*_PLAIN, *(replace(layout, fields=(("system", "system"), *layout.fields)) for layout in _PLAIN), Layout(turn="turn", role="role", text="text"))


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Leaves of a schema: a.b for fields, a[].b within lists."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, at + "[]")
    return [at]


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(layout.paths): layout for layout in LAYOUTS}
KNOWN_PATHS = sorted({p for layout in LAYOUTS for p in layout.paths})
WIDEST_FIRST = sorted(LAYOUTS, key=lambda layout: -len(layout.paths))


def _role(role: Column) -> Column:
    low = F.lower(F.coalesce(role, F.lit("")))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair]), low), low)


def _turns(layout: Layout, record: str = "") -> Column:
    """Array of (turn, role, text) structs."""
    at = f"{record}." if record else ""
    if layout.turn:
        turn, role, text = (F.col(at + name) for name in (layout.turn, layout.role, layout.text))
        return F.array(F.struct(turn.cast("long").alias("turn"), F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text")))
    out = []
    for role, name in layout.fields:
        text = F.coalesce(F.col(at + name), F.lit(""))
        if role == "user":
            for more in layout.joined:
                extra = F.coalesce(F.col(at + more), F.lit(""))
                text = F.when(extra == "", text).otherwise(F.concat(text, F.lit("\n\n"), extra))
        out.append(F.struct(F.lit(len(out)).cast("long").alias("turn"), F.lit(role).alias("role"), text.alias("text")))
    if not layout.messages:
        return F.array(*out)
    listed = F.transform(F.col(at + layout.messages), lambda m, k: F.struct((k + len(out)).cast("long").alias("turn"), _role(m[layout.role]).alias("role"), F.coalesce(m[layout.text], F.lit("")).alias("text")))
    return F.concat(F.array(*out), F.coalesce(listed, F.array())) if out else listed


def known_paths(df: DataFrame) -> list[str]:
    return [p for p in field_paths(df.schema) if p in KNOWN_PATHS]


def chosen_layout(paths: list[str]) -> Layout | None:
    """The layout that a table of these known paths has: that of their fingerprint, else, of those whose paths are all there, the turn layout or the widest."""
    inside = [x for x in WIDEST_FIRST if set(x.paths) <= set(paths)]
    return BY_FINGERPRINT.get(fingerprint(paths)) or next((x for x in inside if x.turn), inside[0] if inside else None)


def passed_over(df: DataFrame) -> list[str]:
    """The paths of df that belong to some layout but not to the one that turns_of_table takes."""
    layout = chosen_layout(known_paths(df))
    return sorted(set(known_paths(df)) - set(layout.paths if layout else ()))


def turns_of_table(df: DataFrame, id_col: str) -> DataFrame:
    """conv_id, turn, role, text from a table of one layout, known by its schema's fingerprint.

    Columns that no layout names are left out of it; should those of several layouts be there, one turn a row comes
    first, then the layout with the most paths; passed_over() lists the rest. A table without any is an error. A null list
    has no turns, a null field is an empty text.
    """
    own = known_paths(df)
    layout = chosen_layout(own)
    if layout is None:
        raise ValueError(f"no layout has only fields of {field_paths(df.schema)}")
    conv = F.col(f"`{id_col}`").cast("long").alias("conv_id")
    if layout.turn:
        return df.select(conv, _turns(layout)[0].alias("one")).select("conv_id", "one.turn", "one.role", "one.text")
    return df.select(conv, F.explode(_turns(layout)).alias("one")).select("conv_id", "one.turn", "one.role", "one.text")


def _all_layouts() -> T.StructType:
    out = T.StructType()
    for layout in _PLAIN:
        if layout.messages:
            out.add(layout.messages, T.ArrayType(T.StructType().add(layout.role, "string").add(layout.text, "string")))
    for name in sorted({p for p in KNOWN_PATHS if "[]" not in p}):
        out.add(name, "string")
    return out


def _marked(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """conv_id, record, r (its known fields), keys, paths, print (the layout's fingerprint, null where no layout fits)."""
    record = F.col(f"`{json_col}`").cast("string")
    parsed = df.select(F.col(f"`{id_col}`").cast("long").alias("conv_id"), record.alias("record"), F.from_json(record, _all_layouts()).alias("r"), F.from_json(record, "map<string,string>").alias("keys"))
    lists = sorted({layout.messages for layout in LAYOUTS if layout.messages})
    parsed = parsed.withColumns({f"in_{name}": F.flatten(F.transform(F.from_json(F.element_at("keys", name), "array<map<string,string>>"), lambda m: F.coalesce(F.map_keys(m), F.array()))) for name in lists})

    # The parsed record does not tell a null field from a missing one; the maps' keys do.
    def present(path: str) -> Column:
        name, _, inner = path.partition("[].")
        if inner:
            there = F.coalesce(F.exists(F.col(f"r.{name}"), lambda m: m[inner].isNotNull()), F.lit(False)) | F.coalesce(F.array_contains(F.col(f"in_{name}"), inner), F.lit(False))
        else:
            there = F.col(f"r.{name}").isNotNull() | F.coalesce(F.map_contains_key("keys", name), F.lit(False))
        return F.when(there, F.lit(path))

    marked = parsed.withColumn("paths", F.array_compact(F.array(*map(present, KNOWN_PATHS))))
    own = F.sha2(F.array_join("paths", "\n"), 256)
    held = [F.when(F.size(F.array_except(F.array(*map(F.lit, layout.paths)), F.col("paths"))) == 0, F.lit(fingerprint(layout.paths))) for layout in WIDEST_FIRST]
    return marked.withColumn("print", F.coalesce(F.when(own.isin(*BY_FINGERPRINT), own), *held))


def turns_of_json(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """conv_id, turn, role, text from JSON records of mixed layouts, each row by its own fingerprint.

    A field counts by being there, whatever its value; a null one is an empty text. Should known fields be there
    that no layout has together, the layout with the most paths among them counts, as in turns_of_table. A record
    that is null, broken or without all fields of any layout has no turns: unmatched lists these.
    """
    turns = F.coalesce(*[F.when(F.col("print") == key, _turns(layout, "r")) for key, layout in BY_FINGERPRINT.items()])
    return _marked(df, id_col, json_col).select("conv_id", F.explode(turns).alias("one")).select("conv_id", "one.turn", "one.role", "one.text")


def unmatched(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """conv_id, record, fields, print of each JSON record that turns_of_json finds no layout for: its own field names, sorted, and their fingerprint, so that a layout can be declared. Both are null for a null or broken record."""
    fields = F.array_sort(F.map_keys("keys"))
    return _marked(df, id_col, json_col).where("print is null").select("conv_id", "record", fields.alias("fields"), F.sha2(F.array_join(fields, "\n"), 256).alias("print"))


#: A turn is <|role|>, a line feed, the text, the end mark and a line feed. In texts and roles & < [ | are written as references, so no mark can stand there.
END = "<|end|>\n"
_REFERENCES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("|", "&#124;"))
_TURN = r"<\|([^|<]*)\|>\n([^<]*)<\|end\|>\n"


def escape(text: Column) -> Column:
    for plain, written in _REFERENCES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(_REFERENCES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_mask: each conversation as one text, with the (start, length) code-point spans that loss_role wrote.

    Turns stand by turn number; equal numbers by role, then text; null numbers first. Null roles and texts count
    as empty, null conv_ids are one conversation, repeated rows are repeated turns, an empty table gives no rows;
    columns besides the four are left out. One conversation is one row of the result, so its turns meet in one
    task, once: the running lengths that place the mask and the grouping use the same shuffle.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = turns.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"), text.alias("text"))
    rows = rows.withColumns({"head": F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>\n")), "body": escape(F.col("text"))})
    rows = rows.withColumn("n", F.length("head") + F.length("body") + len(END))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.select("conv_id", F.row_number().over(order).alias("k"), before.alias("at"), "role", "head", "body")
    grouped = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("k", "at", "role", "head", "body"))).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    mask = F.transform(F.filter("turns", lambda t: t["role"] == loss_role), lambda t: F.struct((t["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).cast("long").alias("length")))
    return grouped.select("conv_id", formatted.alias("formatted"), mask.alias("loss_mask"))


def read_turns(formatted: str = "formatted") -> Column:
    """Array of (role, text), read back from a formatted column."""
    roles, bodies = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(1)), F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(2))
    return F.transform(F.arrays_zip(roles.alias("role"), bodies.alias("text")), lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")))


def under_mask(formatted: str = "formatted", mask: str = "loss_mask") -> Column:
    """The unescaped text of all of the mask's spans, in order, nothing between."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(F.col(formatted), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
