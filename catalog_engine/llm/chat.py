"""Chat formatting by schema fingerprints (operator 8, DataFrame functions only).

Records come as JSON in many layouts. The nested field paths of a record are hashed; the hash
selects a declared mapping that gives canonical turns (role, text). Turns are written with marks
that no text can contain, since the characters of marks are escaped inside texts and roles, and a
loss mask says which code points of the result are assistant text.

A record that is null, not JSON, or of an unknown layout has null turns and a null result; its
fingerprint is given, so that a mapping can be declared. Long texts and many turns have no bound of
their own: the shape is that of the record with empty texts and without repeated elements. Where
even this is more than Spark can parse, the query fails. Null texts and roles count as empty. A
record without turns gives an empty result. Repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_engine.llm.common import let

OPEN, CLOSE = "<turn>", "</turn>\n"

#: What is escaped: the backslash, the character that begins marks, and the end of a role.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("\n", "\\n"))

#: Parsing has a bound of 20 million characters for a text, beyond which it would be null.
UNBOUNDED = {"maxStringLen": "2147483647"}

TURNS = "array<struct<role:string,text:string>>"
#: Role names of layouts that call them otherwise.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def escape(text: Column, line_ends: bool = False) -> Column:
    """Every backslash of the result begins one of the escapes."""
    for plain, escaped in ESCAPES if line_ends else ESCAPES[:2]:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape(text: Column) -> Column:
    for plain, escaped in reversed(ESCAPES):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


@dataclass(frozen=True)
class Layout:
    """The shape of a record, that is its nested field paths, and how its turns are read."""

    name: str
    shape: str
    turns: Callable[[Column], Column]


def _list(field: str, role: str, text: str) -> Callable[[Column], Column]:
    schema = f"`{field}` array<struct<`{role}`:string,`{text}`:string>>"
    def read(record: Column) -> Column:
        names = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
        return F.transform(
            F.from_json(record, schema, UNBOUNDED)[field],
            lambda t: F.struct(
                F.coalesce(names[t[role]], t[role], F.lit("")).alias("role"),
                F.coalesce(t[text], F.lit("")).alias("text"),
            ),
        )

    return read


def _fields(**roles: str) -> Callable[[Column], Column]:
    """One turn for each field, in the order given: role=field, fields joined by +."""
    fields = [f for value in roles.values() for f in value.split("+")]
    schema = ", ".join(f"`{f}` string" for f in fields)

    def read(record: Column) -> Column:
        row = F.from_json(record, schema, UNBOUNDED)
        return F.array(
            *(
                F.struct(
                    F.lit(role).alias("role"),
                    F.concat_ws("\n\n", *(F.coalesce(row[f], F.lit("")) for f in value.split("+"))).alias("text"),
                )
                for role, value in roles.items()
            )
        )

    return read


def _shape_of_list(field: str, *names: str) -> str:
    return f"OBJECT<{field}: ARRAY<OBJECT<{', '.join(sorted(names))}>>>"


def _shape_of(*names: str) -> str:
    return f"OBJECT<{', '.join(sorted(names))}>"


LAYOUTS = (
    Layout("messages", _shape_of_list("messages", "role", "content"), _list("messages", "role", "content")),
    Layout("turns", _shape_of_list("turns", "role", "text"), _list("turns", "role", "text")),
    Layout("sharegpt", _shape_of_list("conversations", "from", "value"), _list("conversations", "from", "value")),
    Layout("prompt-response", _shape_of("prompt", "response"), _fields(user="prompt", assistant="response")),
    Layout("prompt-completion", _shape_of("prompt", "completion"), _fields(user="prompt", assistant="completion")),
    Layout("question-answer", _shape_of("question", "answer"), _fields(user="question", assistant="answer")),
    Layout("instruction", _shape_of("instruction", "output"), _fields(user="instruction", assistant="output")),
    Layout(
        "instruction-input",
        _shape_of("instruction", "input", "output"),
        _fields(user="instruction+input", assistant="output"),
    ),
    Layout(
        "system-prompt-response",
        _shape_of("system", "prompt", "response"),
        _fields(system="system", user="prompt", assistant="response"),
    ),
)


#: Characters of an outline that Spark can parse for certain.
PARSED = 1 << 24


def outline(record: Column) -> Column:
    """A JSON record with empty strings as values, and one of equal objects that follow each other.

    What is not JSON stays so: bad escapes and control characters are kept, or the result is null.
    """
    # Escapes are written without quotes and backslashes; what stands for them is not in any JSON.
    text = F.when(~record.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), record)
    text = F.replace(text, F.lit("\\\\"), F.lit("\x01"))
    text = F.replace(text, F.lit('\\"'), F.lit("\x02"))
    text = F.regexp_replace(text, r"\\([/bfnrt]|u[0-9A-Fa-f]{4})", "\x03$1")
    # No group is repeated: Java would need stack for each turn of it.
    inside = r'[^"\\\x00\x04-\x1F]*+'
    text = F.regexp_replace(text, rf'("[^"]*+"[ \t\r\n]*+:)|("){inside}(")', "$1$2$3")
    for mark, escaped in (("\x01", "\\\\"), ("\x02", '\\"'), ("\x03", "\\")):
        text = F.replace(text, F.lit(mark), F.lit(escaped))
    return F.regexp_replace(text, r"(\{[^{}\[\]]*+\})[ \t\r\n]*+,[ \t\r\n]*+(?=\1)", "")


def shape(record: Column) -> Column:
    """Nested field paths of a JSON record as text, without the types of its values."""
    small = let(outline(record), lambda x: F.struct(x.alias("json"), F.try_parse_json(x).alias("parsed")))
    typed = let(
        small,
        lambda x: F.when(
            x["parsed"].isNull() & (F.length(x["json"]) > PARSED),
            F.raise_error(F.lit("the shape of a record is too large to be parsed")),
        ).otherwise(F.schema_of_variant(x["parsed"])),
    )
    return F.regexp_replace(typed, r": (?!OBJECT|ARRAY)[A-Z_]+(\([0-9,]*\))?", "")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(shape(record))


def canonical_turns(
    records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS
) -> DataFrame:
    """Adds ``fingerprint``, ``layout`` (null if unknown) and ``turns``."""
    stamped = records.withColumn("fingerprint", fingerprint(F.col(record)))
    names, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for known in reversed(layouts):
        same = F.col("fingerprint") == F.xxhash64(F.lit(known.shape))
        names = F.when(same, F.lit(known.name)).otherwise(names)
        turns = F.when(same, known.turns(F.col(record)).cast(TURNS)).otherwise(turns)
    return stamped.withColumns({"layout": names, "turns": turns})


def render(frame: DataFrame, turns: str = "turns", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Adds ``formatted`` and ``loss_mask``.

    The mask has a run (before, under, after) for each turn, in code points: runs follow each
    other without a gap and together are as long as the text; ``under`` is learned from.
    """
    parts = F.transform(
        turns,
        lambda t: F.struct(
            F.concat(F.lit(OPEN), escape(t["role"], line_ends=True), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
            t["role"].isin(*learn).alias("learn"),
        ),
    )
    staged = frame.withColumn("__parts", parts)
    runs = F.transform(
        "__parts",
        lambda p: F.when(
            p["learn"],
            F.struct(
                F.length(p["head"]).cast("long").alias("before"),
                F.length(p["body"]).cast("long").alias("under"),
                F.lit(len(CLOSE)).cast("long").alias("after"),
            ),
        ).otherwise(
            F.struct(
                (F.length(p["head"]) + F.length(p["body"]) + len(CLOSE)).cast("long").alias("before"),
                F.lit(0).cast("long").alias("under"),
                F.lit(0).cast("long").alias("after"),
            )
        ),
    )
    text = F.array_join(F.transform("__parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    return staged.withColumns({"formatted": text, "loss_mask": runs}).drop("__parts")


def read_back(frame: DataFrame) -> DataFrame:
    """Adds ``read_turns`` and ``loss_text`` (all text under the mask, unescaped), both from
    ``formatted`` and ``loss_mask`` alone."""
    segments = F.filter(F.split("formatted", CLOSE), lambda s: s != "")
    split = frame.withColumn("__segments", segments)

    def turn(segment: Column) -> Column:
        role = F.substring_index(segment, "\n", 1)
        return F.struct(
            unescape(F.substring(role, len(OPEN) + 1, F.length(role))).alias("role"),
            unescape(F.substring(segment, F.length(role) + 2, F.length(segment))).alias("text"),
        )

    under = F.zip_with(
        "__segments",
        "loss_mask",
        lambda s, m: F.substring(s, (m["before"] + 1).cast("int"), m["under"].cast("int")),
    )
    return split.withColumns(
        {
            "read_turns": F.transform("__segments", turn),
            "loss_text": unescape(F.array_join(under, "")),
        }
    ).drop("__segments")


def by_conversation(rows: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Rows of single turns as one JSON record a conversation, in the plainest layout that holds
    it: ``key`` and ``record``. Equal turn numbers are ordered by role, then text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    grouped = rows.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("n"), role.alias("role"), text.alias("text")))).alias("t")
    )
    roles = F.transform("t", lambda x: x["role"])

    def text_at(i: int) -> Column:
        return F.get("t", F.lit(i))["text"]

    def is_just(*names: str) -> Column:
        return roles == F.array(*(F.lit(n) for n in names))

    record = (
        F.when(
            is_just("user", "assistant"),
            F.to_json(F.struct(text_at(0).alias("prompt"), text_at(1).alias("response"))),
        )
        .when(
            is_just("system", "user", "assistant"),
            F.to_json(F.struct(text_at(0).alias("system"), text_at(1).alias("prompt"), text_at(2).alias("response"))),
        )
        .otherwise(
            F.to_json(
                F.struct(
                    F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns")
                )
            )
        )
    )
    return grouped.select(key, record.alias("record"))
