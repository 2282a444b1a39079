"""Chat formatting: records of several layouts to canonical turns, and turns to text.

The nested field paths of a record are hashed. The hash selects a declarative
mapping, which says where prompts, instructions or messages stand; a record with
another hash is reported, never guessed. A template marks turns with control strings;
wherever a text holds one (of this template or of others), it is escaped reversibly.
Everything is column expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"
PART = 256  # turns of a conversation that are formatted together
LARGE = 32 << 20  # bytes of turns that become no record; variants end at 128 MB


@dataclass(frozen=True)
class Said:
    """One turn: a fixed role, its text at a path; left out if the path has null."""

    role: str
    path: str
    optional: bool = False


@dataclass(frozen=True)
class Listed:
    """Turns in an array at a path, with their fields for role and text."""

    path: str
    role: str
    text: str


@dataclass(frozen=True)
class Mapping:
    """Layouts (field paths as ``layout`` writes them) and the turns they hold."""

    name: str
    layouts: tuple[str, ...]
    turns: tuple[Said | Listed, ...]
    roles: tuple[tuple[str, str], ...] = ()  # role names of the layout and canonical ones


MAPPINGS = (
    Mapping("prompt", ("OBJECT<prompt, response>", "OBJECT<prompt, response, system>"),
            (Said("system", "$.system", True), Said("user", "$.prompt"),
             Said("assistant", "$.response"))),
    Mapping("completion", ("OBJECT<completion, prompt>",),
            (Said("user", "$.prompt"), Said("assistant", "$.completion"))),
    Mapping("instruction",
            ("OBJECT<instruction, output>", "OBJECT<input, instruction, output>"),
            (Said("system", "$.instruction"), Said("user", "$.input", True),
             Said("assistant", "$.output"))),
    Mapping("question", ("OBJECT<data: OBJECT<answer, question>>", "OBJECT<answer, question>"),
            (Said("user", "$.data.question", True), Said("assistant", "$.data.answer", True),
             Said("user", "$.question", True), Said("assistant", "$.answer", True))),
    Mapping("messages", ("OBJECT<messages: ARRAY<OBJECT<content, role>>>", "OBJECT<messages: ARRAY>"),
            (Listed("$.messages", "role", "content"),)),
    Mapping("conversations",
            ("OBJECT<conversations: ARRAY<OBJECT<from, value>>>",
             "OBJECT<conversations: ARRAY<OBJECT<from, value>>, system>"),
            (Said("system", "$.system", True), Listed("$.conversations", "from", "value")),
            (("human", "user"), ("gpt", "assistant"))),
)


def layout(record: Column) -> Column:
    """The nested field paths of a variant, without the types of the values.

    Objects list their fields in order of name. A null and an empty array have no
    paths of their own.
    """
    shape = F.schema_of_variant(record)
    scalar = r": (?!OBJECT<|ARRAY<)[A-Z_]+(?:\([0-9,]+\))?"
    bare = F.regexp_replace(shape, scalar, "")
    return F.regexp_replace(bare, r"ARRAY<(?!OBJECT<|ARRAY<)[A-Z_]+(?:\([0-9,]+\))?>", "ARRAY")


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(paths)


def _renamed(part: Listed):
    return lambda message: F.struct(message[part.role].alias("role"),
                                    message[part.text].alias("text"))


def _turns(record: Column, mapping: Mapping) -> Column:
    parts = []
    for part in mapping.turns:
        if isinstance(part, Said):
            text = F.try_variant_get(record, part.path, "string")
            turn = F.array(F.struct(F.lit(part.role).alias("role"), text.alias("text")))
            empty = F.array().cast(TURNS)
            parts.append(F.when(text.isNotNull(), turn).otherwise(empty)
                         if part.optional else turn)
        else:
            kind = f"array<struct<`{part.role}`:string,`{part.text}`:string>>"
            found = F.try_variant_get(record, part.path, kind)
            parts.append(F.transform(found, _renamed(part)))
    turns = F.concat(*parts) if len(parts) > 1 else parts[0]
    names = dict(mapping.roles)

    def canonical(turn: Column) -> Column:
        role = F.coalesce(turn["role"], F.lit(""))
        for own, common in names.items():
            role = F.when(turn["role"] == own, common).otherwise(role)
        return F.struct(role.alias("role"), F.coalesce(turn["text"], F.lit("")).alias("text"))

    return F.transform(turns, canonical)


def canonical_turns(df: DataFrame, record: str = "record",
                    mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Add ``fingerprint``, ``mapping``, ``turns`` and ``problem`` to rows with JSON records.

    A null, broken or unknown record keeps its row with null turns and a ``problem``
    ('not JSON', 'unknown layout', or 'no turns' where the mapping finds no array of
    messages). Null roles and texts become empty. Equal records give equal rows.
    Columns of the input with these names are replaced.
    """
    kept = df.drop("fingerprint", "mapping", "turns", "problem", "_record", "_layout")
    parsed = kept.withColumn("_record", F.try_parse_json(F.col(record)))
    shaped = parsed.withColumn("fingerprint", fingerprint(layout(F.col("_record"))))
    name = turns = None
    for mapping in mappings:
        here = F.lit(False)
        for one in mapping.layouts:
            here = here | (F.col("fingerprint") == fingerprint(F.lit(one)))
        found = _turns(F.col("_record"), mapping)
        name = F.when(here, mapping.name) if name is None else name.when(here, mapping.name)
        turns = F.when(here, found) if turns is None else turns.when(here, found)
    return (shaped.withColumn("mapping", name).withColumn("turns", turns)
            .withColumn("problem", F.when(F.col("_record").isNull(), "not JSON")
                        .when(F.col("mapping").isNull(), "unknown layout")
                        .when(F.col("turns").isNull(), "no turns"))
            .drop("_record"))


def layout_census(df: DataFrame, record: str = "record") -> DataFrame:
    """How many records have each layout: what mappings are still to be written."""
    paths = layout(F.try_parse_json(F.col(record)))
    return (df.groupBy(paths.alias("layout")).agg(F.count("*").alias("records"))
            .withColumn("fingerprint", fingerprint(F.col("layout"))))


@dataclass(frozen=True)
class Template:
    """Control strings around role and text, and those of other templates to be escaped."""

    start: str = "<|start|>"
    middle: str = "<|text|>"
    end: str = "<|end|>"
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
                                "<|im_start|>", "<|im_end|>", "<|endoftext|>")
    learned: tuple[str, ...] = ("assistant",)

    def _rests(self) -> str:
        controls = (self.start, self.middle, self.end, *self.foreign)
        heads = "".join(sorted({re.escape(c[0]) for c in controls}))
        rests = "|".join(sorted({re.escape(c[1:]) for c in controls}, key=lambda r: (-len(r), r)))
        return f"([{heads}])%s(\\\\*)(?={rests})"

    def escape(self, text: Column) -> Column:
        """One more backslash after the first character of every control string."""
        return F.regexp_replace(text, self._rests() % "", r"$1\\$2")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._rests() % "\\\\", "$1$2")

    def pieces(self, turns: Column) -> Column:
        """Per turn: its formatted text, the place of its text in it, whether it is learned."""

        def piece(turn: Column) -> Column:
            head = F.concat(F.lit(self.start), self.escape(turn["role"]), F.lit(self.middle))
            body = self.escape(turn["text"])
            return F.struct(
                F.concat(head, body, F.lit(self.end)).alias("all"),
                F.length(head).alias("head"), F.length(body).alias("body"),
                turn["role"].isin(*self.learned).alias("loss"))

        return F.transform(turns, piece)

    def turns(self, formatted: Column) -> Column:
        """Read the turns back from a formatted text."""

        def turn(piece: Column) -> Column:
            at = F.instr(piece, F.lit(self.middle))
            role = F.substring(piece, F.lit(len(self.start) + 1), at - len(self.start) - 1)
            text = F.substring(piece, at + len(self.middle), F.length(piece))
            return F.struct(self.unescape(role).alias("role"), self.unescape(text).alias("text"))

        pieces = F.split(formatted, re.escape(self.end))
        return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def format_turns(df: DataFrame, template: Template = Template()) -> DataFrame:
    """Add ``formatted`` and ``loss_spans`` (start and length in code points, from 0) to
    rows with canonical ``turns``. No turns give the empty text; null turns give null.
    """
    kept = df.drop("formatted", "loss_spans", "_pieces").withColumn(
        "_pieces", template.pieces(F.col("turns")))
    spans = "array<struct<start:int,length:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("spans"))

    def add(done: Column, piece: Column) -> Column:
        span = F.array(F.struct((done["at"] + piece["head"]).alias("start"),
                                piece["body"].alias("length")))
        return F.struct(
            (done["at"] + F.length(piece["all"])).alias("at"),
            F.when(piece["loss"], F.concat(done["spans"], span)).otherwise(
                done["spans"]).cast(spans).alias("spans"))

    return (kept.withColumn("formatted", F.array_join(
        F.transform("_pieces", lambda p: p["all"]), ""))
            .withColumn("loss_spans", F.aggregate("_pieces", start, add, lambda a: a["spans"]))
            .drop("_pieces"))


def learned_texts(template: Template = Template()) -> Column:
    """The unescaped texts under the loss spans of formatted rows."""
    return F.transform("loss_spans", lambda s: template.unescape(
        F.substring(F.col("formatted"), s["start"] + 1, s["length"])))


def _said() -> Column:
    return F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").alias("role"),
                    F.col("text").alias("text"))


def known_conversations(rows: DataFrame) -> DataFrame:
    """The part of :func:`conversations` that has conv_ids."""
    return (rows.filter(F.col("conv_id").isNotNull()).groupBy(F.col("conv_id").cast("long").alias(
        "conv_id")).agg(F.sort_array(F.collect_list(_said())).alias("said")))


def lone_rows(rows: DataFrame) -> DataFrame:
    """The part of :func:`conversations` that has none."""
    return rows.filter(F.col("conv_id").isNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.array(_said()).alias("said"))


def conversations(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) to one row per conversation with its turns in order.

    Rows of equal turn are ordered by role and text; repeated rows stay. A row
    without conv_id belongs to no other row and is a conversation of its own.
    """
    return known_conversations(rows).unionByName(lone_rows(rows))


def parts(grouped: DataFrame, size: int = PART) -> DataFrame:
    """Conversations cut into rows (conv_id, part, said) of at most ``size`` turns, in order.

    Turns are formatted one by one, so the formatted parts in order are the formatted
    conversation. Nothing is shuffled.
    """
    last = F.floor((F.size("said") - 1) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(
        F.col("said"), i * size + 1, F.lit(size)))
    return grouped.select("conv_id", F.posexplode(cut).alias("part", "said"))


def as_records(grouped: DataFrame, limit: int = LARGE) -> DataFrame:
    """Conversations (or parts of them) to JSON records of the layout that fits their roles.

    Beyond ``limit`` bytes there is no record; the turns are in ``direct`` then, see
    :func:`with_direct`.
    """
    role = F.transform("said", lambda s: s["role"])

    def text(at: int) -> Column:
        return F.get(F.col("said"), at)["text"]

    def is_roles(*names: str) -> Column:
        return F.coalesce(role == F.array(*[F.lit(n) for n in names]), F.lit(False))

    def record(**fields: Column) -> Column:
        return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]),
                         {"ignoreNullFields": "false"})

    messages = F.transform("said", lambda s: F.struct(
        s["role"].alias("role"), s["text"].alias("content")))
    def width(name: str, turn: Column) -> Column:
        return F.coalesce(F.octet_length(turn[name]), F.lit(0)).cast("long")

    large = F.aggregate("said", F.lit(0).cast("long"), lambda n, s: n + width("role", s)
                        + width("text", s)) > limit
    direct = F.transform("said", lambda s: F.struct(
        F.coalesce(s["role"], F.lit("")).alias("role"),
        F.coalesce(s["text"], F.lit("")).alias("text")))
    return grouped.select(
        *[c for c in grouped.columns if c != "said"], F.when(
            large, F.lit(None).cast("string")).when(
            is_roles("user", "assistant"), record(prompt=text(0), response=text(1))).when(
            is_roles("system", "user", "assistant") & text(1).isNotNull(),
            record(instruction=text(0), input=text(1), output=text(2))).otherwise(
            record(messages=messages)).alias("record"),
        F.when(large, direct).alias("direct"))


def with_direct(df: DataFrame) -> DataFrame:
    """Rows of :func:`canonical_turns` with the turns of conversations that had no record.

    A row that is left without turns stops the job.
    """
    lost = F.raise_error(F.concat(F.lit("conversation "), F.coalesce(
        F.col("conv_id").cast("string"), F.lit("null")), F.lit(": "), F.col("problem")))
    return df.withColumn("turns", F.coalesce("turns", "direct", lost.cast(TURNS))).withColumn(
        "problem", F.when(F.col("direct").isNull(), F.col("problem"))).drop("direct")
