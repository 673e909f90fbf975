"""Chat formatting: layouts are recognised by a fingerprint of their field paths.

The fingerprint of a table, or of each row of a JSON column, is a hash over the sorted nested field
paths that any layout knows.  It selects a declarative mapping, which turns prompts, instructions,
message lists or turn rows into canonical turns (conv_id, n, role, text).  A template marks the turns;
control strings inside roles and texts are escaped so that they can be read back exactly.
"""

import hashlib

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .shared import table

START, END = "<|im_start|>", "<|im_end|>"

#: Layouts: fields joined to one text for each turn, a list of messages, or one turn in each row.
LAYOUTS = (
    {"turns": (("user", ("prompt",)), ("assistant", ("completion",)))},
    {"turns": (("user", ("prompt",)), ("assistant", ("response",)))},
    {"turns": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))},
    {"turns": (("user", ("question",)), ("assistant", ("answer",)))},
    {"turns": (("user", ("instruction",)), ("assistant", ("output",)))},
    {"turns": (("user", ("instruction", "input")), ("assistant", ("output",)))},
    {"list": "messages", "role": "role", "text": "content"},
    {"list": "messages", "role": "role", "text": "text"},
    {"list": "conversations", "role": "from", "text": "value", "names": {"human": "user", "gpt": "assistant"}},
    {"row": "turn", "role": "role", "text": "text"},
)


def paths_of(layout: dict) -> list:
    """Field paths of a layout; ``[]`` stands for the elements of a list."""
    if "turns" in layout:
        return sorted({field for _, fields in layout["turns"] for field in fields})
    if "list" in layout:
        return sorted([layout["list"], f"{layout['list']}[].{layout['role']}", f"{layout['list']}[].{layout['text']}"])
    return sorted([layout["row"], layout["role"], layout["text"]])


def fingerprint(paths) -> str:
    """Hash of those of the paths that any layout knows."""
    return hashlib.sha256("\n".join(sorted(set(paths) & KNOWN)).encode()).hexdigest()


KNOWN = {path for layout in LAYOUTS for path in paths_of(layout)}
BY_FINGERPRINT = {fingerprint(paths_of(layout)): layout for layout in LAYOUTS}


def schema_paths(kind: T.DataType, prefix: str = "") -> list:
    """Nested field paths of a schema."""
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, prefix + "[]")
    if isinstance(kind, T.StructType):
        start = prefix + "." if prefix else ""
        return [p for f in kind.fields for p in (start + f.name, *schema_paths(f.dataType, start + f.name))]
    return []


def layout_of(df: DataFrame) -> dict:
    """The layout of a table. Fields that no layout knows make no difference.

    If further columns have names that other layouts use, the layout with most paths among those that
    the table holds in full is taken, the first of equals.
    """
    paths = set(schema_paths(df.schema))
    found = BY_FINGERPRINT.get(fingerprint(paths))
    whole = [layout for layout in LAYOUTS if paths.issuperset(paths_of(layout))]
    if found is None and not whole:
        raise ValueError(f"no layout has the field paths of {df.schema.simpleString()}")
    return found or max(whole, key=lambda layout: len(paths_of(layout)))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(
        F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text")
    )


def _renamed(role: Column, names: dict) -> Column:
    for old, new in names.items():
        role = F.when(role == old, new).otherwise(role)
    return role


def _joined(fields: list) -> Column:
    """The first field, then those of the others that hold text, with an empty line between."""
    more = [F.when(F.length(f) > 0, F.concat(F.lit("\n\n"), f)).otherwise(F.lit("")) for f in fields[1:]]
    return F.concat(F.coalesce(fields[0], F.lit("")), *more)


def _turns(layout: dict, field, items) -> Column:
    """Array of turns; ``field`` gives a field of the row, ``items`` a list of (role, text)."""
    if "turns" in layout:
        return F.array(*[_turn(F.lit(role), _joined([field(f) for f in fields])) for role, fields in layout["turns"]])
    names = layout.get("names", {})
    found = items(layout["list"], layout["role"], layout["text"])
    return F.transform(F.coalesce(found, F.array()), lambda m: _turn(_renamed(m["role"], names), m["text"]))


def _numbered(df: DataFrame, turns: Column) -> DataFrame:
    each = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.posexplode(turns).alias("n", "t"))
    return each.select("conv_id", F.col("n").cast("long").alias("n"), "t.role", "t.text")


def canonical_turns(df: DataFrame) -> DataFrame:
    """(conv_id, n, role, text) of a table in any known layout; null roles and texts become empty."""
    layout = layout_of(df)
    if "row" in layout:
        turn = _turn(F.col(layout["role"]), F.col(layout["text"]))
        return df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col(layout["row"]).cast("long").alias("n"), turn.alias("t")).select(
            "conv_id", "n", "t.role", "t.text"
        )

    def items(name, role, text):
        return F.transform(F.col(name), lambda m: F.struct(m[role].cast("string").alias("role"), m[text].cast("string").alias("text")))

    return _numbered(df, _turns(layout, lambda f: F.col(f).cast("string"), items))


def json_turns(df: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Turns of a table (conv_id, payload) whose JSON rows have layouts of their own, and the rows not understood.

    Every row gets its own fingerprint from the known paths it holds. A payload that is no JSON, null,
    in no known layout, or a list without elements goes to the second table with its fingerprint.
    """
    rows = df.select("conv_id", F.col(payload).alias("payload"), F.try_parse_json(payload).alias("v"))
    held = [
        F.when(F.try_variant_get("v", "$." + path.replace("[]", "[0]"), "variant").isNotNull(), F.lit(path))
        for path in sorted(KNOWN)
    ]
    rows = rows.withColumn("fingerprint", F.sha2(F.array_join(F.array_compact(F.array(*held)), "\n").cast("binary"), 256))

    def field(name):
        return F.try_variant_get("v", "$." + name, "string")

    def items(name, role, text):
        found = F.try_variant_get("v", "$." + name, f"array<struct<{role}:string,{text}:string>>".replace("from:", "`from`:"))
        return F.transform(found, lambda m: F.struct(m[role].alias("role"), m[text].alias("text")))

    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for print_, layout in BY_FINGERPRINT.items():
        if "row" not in layout:
            turns = F.when(F.col("fingerprint") == print_, _turns(layout, field, items)).otherwise(turns)
    rows = rows.withColumn("turns", turns)
    return _numbered(rows.filter("turns IS NOT NULL"), F.col("turns")), rows.filter("turns IS NULL").select(
        "conv_id", "payload", "fingerprint"
    )


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("<|"), F.lit("<~1"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<~1"), F.lit("<|")), F.lit("~0"), F.lit("~"))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of each conversation; a span is (start, length) in code points, from 0.

    Turns follow ``n``, nulls first, and ties the role and the text, so repeated rows stay and reruns
    agree. Only assistants' texts are under the loss. A null conv_id is one conversation. A
    conversation is one row of the result and must fit a row; a table without rows gives none.
    """
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("~2"))
    order = Window.partitionBy("conv_id").orderBy(F.col("n").asc_nulls_first(), "role", "text")
    head = F.concat(F.lit(START), role, F.lit("\n"))
    pieces = turns.select("conv_id", "n", "role", "text", head.alias("head"), escape(F.col("text")).alias("body")).withColumn(
        "size", F.char_length("head") + F.char_length("body") + len(END) + 1
    )
    placed = pieces.select(
        "conv_id", "role", F.row_number().over(order).alias("k"),
        F.concat("head", "body", F.lit(END + "\n")).alias("piece"), F.char_length("body").alias("length"),
        (F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.char_length("body") - len(END) - 1).alias("start"),
    )
    grouped = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("k", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("k", "start", "length")))).alias("spans"),
    )
    return grouped.select(
        "conv_id", F.array_join(F.col("pieces.piece"), "").alias("formatted"),
        F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>", -1), F.lit(2), F.greatest(F.size(F.split(formatted, r"<\|im_start\|>", -1)) - 1, F.lit(0)))

    def turn(part):
        body = F.substring(part, F.lit(1), F.char_length(part) - len(END) - 1)
        role = F.substring_index(body, "\n", 1)
        text = F.substring(body, F.char_length(role) + 2, F.char_length(body))
        return F.struct(unescape(F.replace(role, F.lit("~2"), F.lit("\n"))).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def digest(chats: DataFrame) -> DataFrame:
    """Figures read back from formatted conversations."""
    turns = chats.withColumn("turns", read_turns(F.col("formatted"))).withColumn(
        "loss",
        F.array_join(
            F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int")))), ""
        ),
    )
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op1_chat(spark, sf_dir):
    """All conversations (turn rows) and conversation -1 (a list of messages)."""
    text = F.lit(f"{END}{START}assistant ok")
    told = F.array(*[F.struct(F.lit(role).alias("role"), text.alias("content")) for role in ("user", "assistant")])
    own = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), told.alias("messages"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = canonical_turns(rows).unionByName(canonical_turns(own))
    return digest(format_chats(turns))


ORACLE = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
), marked AS (
  SELECT *, 12 + length(replace(replace(replace(role, '~', '~0'), '<|', '<~1'), chr(10), '~2')) + 1
         + length(replace(replace(text, '~', '~0'), '<|', '<~1')) + 11 AS chars
  FROM turns
), told AS (
  SELECT conv_id, count(*) AS n_turns, sum(chars) AS formatted_chars,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS all_text,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss
  FROM marked GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(all_text) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM told
"""
