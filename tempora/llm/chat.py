"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

A record is a JSON text in one of many layouts. Its schema, the nested field paths without the
types of their values, is hashed; the hash selects a ``Layout``, which says by paths where roles
and texts are. The turns are rendered with a template whose marks can't occur inside a text,
since the characters that begin control strings are escaped, and can be read back exactly.
Everything is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
# Reversible: the first escape character is replaced first and restored last.
TEXT_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))
ROLE_ESCAPES = (*TEXT_ESCAPES, ("\n", "&nl;"))
TRAINED = "assistant"


@dataclass(frozen=True)
class Layout:
    """``schema``: field paths as ``schema_of`` writes them. Either ``turns``: pairs of a role and
    the path of its text, in order (a path that starts with ``?`` is left out if its text is
    empty); or ``items``, ``role``, ``text`` and ``names``: an array of messages, the fields in
    it, and canonical names of roles."""

    name: str
    schema: str
    turns: tuple[tuple[str, str], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    names: tuple[tuple[str, str], ...] = ()


LAYOUTS = (
    Layout("messages", "OBJECT<messages: ARRAY<OBJECT<content: v, role: v>>>", items="messages", role="role", text="content"),
    Layout("from-value", "OBJECT<conversations: ARRAY<OBJECT<from: v, value: v>>>", items="conversations", role="from", text="value",
           names=(("human", "user"), ("gpt", "assistant"))),
    Layout("prompt-response", "OBJECT<prompt: v, response: v>", turns=(("user", "prompt"), ("assistant", "response"))),
    Layout("prompt-completion", "OBJECT<completion: v, prompt: v>", turns=(("user", "prompt"), ("assistant", "completion"))),
    Layout("instruction", "OBJECT<instruction: v, output: v>", turns=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction-input", "OBJECT<input: v, instruction: v, output: v>",
           turns=(("user", "instruction"), ("user", "?input"), ("assistant", "output"))),
    Layout("instruction-system", "OBJECT<instruction: v, output: v, system: v>",
           turns=(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    Layout("nested", "OBJECT<data: OBJECT<answer: v, question: v>>", turns=(("user", "data.question"), ("assistant", "data.answer"))),
)

MESSAGES = "array<struct<role: string, text: string>>"
# A JSON parser takes strings and records of bounded size, so the texts of longer conversations are
# carried beside the record, which holds this mark and a text's number in their place.
ATTACHED = "\x00attached:"
RECORD_CHARS = 4_000_000


def schema_of(record: Column) -> Column:
    """Nested field paths of a JSON record, such as ``OBJECT<a: v, b: ARRAY<OBJECT<c: v>>>``, where v
    stands for a value of any type; null if it is no JSON."""
    s = F.schema_of_variant(F.try_parse_json(record))
    s = F.regexp_replace(s, r": [A-Z][A-Z0-9_]*(\([0-9, ]*\))?(?=[,>])", ": v")
    return F.regexp_replace(s, r"ARRAY<[A-Z][A-Z0-9_]*(\([0-9, ]*\))?>", "ARRAY<v>")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(schema_of(record))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _mapped(layout: Layout, v: Column) -> Column:
    if layout.items:
        names = F.create_map(*[F.lit(x) for p in layout.names for x in p]) if layout.names else None
        items = F.try_variant_get(v, f"$.{layout.items}", f"array<struct<`{layout.role}`: string, `{layout.text}`: string>>")

        def one(m: Column) -> Column:
            role = m[layout.role]
            return _turn(F.coalesce(names[role], role) if names is not None else role, m[layout.text])

        return F.transform(items, one)
    turns = [(role, path.lstrip("?"), path.startswith("?")) for role, path in layout.turns]
    own = F.array(*[F.struct(F.lit(r).alias("role"), F.coalesce(F.try_variant_get(v, f"$.{p}", "string"), F.lit("")).alias("text"),
                             F.lit(maybe).alias("maybe")) for r, p, maybe in turns])
    return F.transform(F.filter(own, lambda t: ~t["maybe"] | (t["text"] != "")), lambda t: _turn(t["role"], t["text"]))


def canonical_turns(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS,
                    attached: str | None = None) -> DataFrame:
    """Adds ``layout`` and ``turns`` (array of role and text) to ``records``.

    ``attached``: a column with the texts that marks in the record stand for, or null or empty if
    it holds its texts itself (as it must without this column: the parser gives null, so no
    layout, for strings over 20 million characters).

    The fingerprint of the record's schema selects the layout. Records that are null, no JSON
    object or of a schema that no layout has get null in both. A null role or text reads as
    empty; an empty list of messages has no schema of messages and so no layout. Columns of
    those names are replaced, all others are kept.
    """
    own = records.withColumn("__v", F.try_parse_json(record)).withColumn("__f", fingerprint(F.col(record)))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(MESSAGES)
    for x in layouts:
        same = F.col("__f") == F.xxhash64(F.lit(x.schema))
        name = F.when(same, F.lit(x.name)).otherwise(name)
        turns = F.when(same, _mapped(x, F.col("__v"))).otherwise(turns)
    if attached:
        def whole(t: Column) -> Column:
            at = F.substr(t["text"], F.lit(len(ATTACHED) + 1)).try_cast("int")
            return _turn(t["role"], F.when(t["text"].startswith(ATTACHED), F.get(attached, at)).otherwise(t["text"]))

        turns = F.when(F.size(F.coalesce(attached, F.array().cast("array<string>"))) > 0, F.transform(turns, whole)).otherwise(turns)
    return own.withColumn("layout", name).withColumn("turns", turns).drop("__v", "__f")


def _escaped(c: Column, escapes) -> Column:
    for raw, by in escapes:
        c = F.replace(c, F.lit(raw), F.lit(by))
    return c


def _plain(c: Column, escapes) -> Column:
    for raw, by in reversed(escapes):
        c = F.replace(c, F.lit(by), F.lit(raw))
    return c


def formatted(turns_df: DataFrame, turns: str = "turns", trained: str = TRAINED) -> DataFrame:
    """Adds ``formatted`` and ``loss_spans`` (array of start, from 0, and length in characters).

    Each turn is ``<|turn|>``, its role, a line break, its text, ``<|end|>`` and a line break,
    with ``&``, ``<`` and ``[`` of role and text (and line breaks of the role) escaped; the spans
    are the escaped texts of the trained role. Null turns give null; no turns the empty text.
    """
    parts = F.transform(turns, lambda t: F.struct(
        F.concat(F.lit(TURN), _escaped(t["role"], ROLE_ESCAPES), F.lit("\n")).alias("head"),
        _escaped(t["text"], TEXT_ESCAPES).alias("body"), (t["role"] == trained).alias("trained")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, length: bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.char_length(p["head"])
        n = F.char_length(p["body"]).cast("long")
        span = F.array(F.struct(start.alias("start"), n.alias("length")))
        return F.struct((start + n + len(END)).alias("at"),
                        F.when(p["trained"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    out = turns_df.withColumn("__parts", parts)
    return (out.withColumn("formatted", F.array_join(F.transform("__parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""))
            .withColumn("loss_spans", F.aggregate("__parts", zero, step, lambda a: a["spans"])).drop("__parts"))


def read_back(rendered: DataFrame, text: str = "formatted", spans: str = "loss_spans") -> DataFrame:
    """Adds ``turns_read`` (array of role and text) and ``loss_read`` (array of the unescaped texts
    under the spans), from the formatted text alone."""
    parts = F.slice(F.split(text, r"<\|turn\|>"), 2, 1 << 30)

    def one(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        start = F.char_length(head) + 2
        body = F.substr(p, start, F.char_length(p) - start + 1 - len(END))
        return F.struct(_plain(head, ROLE_ESCAPES).alias("role"), _plain(body, TEXT_ESCAPES).alias("text"))

    return (rendered.withColumn("turns_read", F.transform(parts, one))
            .withColumn("loss_read", F.transform(spans, lambda s: _plain(
                F.substr(F.col(text), s["start"].cast("int") + 1, s["length"].cast("int")), TEXT_ESCAPES))))


def records_of(conversations: DataFrame, most: int = RECORD_CHARS) -> DataFrame:
    """``conv_id, record, attached``: each conversation of a table of turns as one JSON record.

    If its texts have more than ``most`` characters together, they are in ``attached`` and the
    record holds marks in their place; else ``attached`` is empty.

    As sources differ in their layouts, the shape of a conversation decides on its: one exchange
    is a prompt and a response; a system row and one exchange are an instruction with a system
    field; other conversations are lists of messages, those with an odd id and known roles with
    the fields ``from`` and ``value``. Rows are ordered by turn, then role and text; a null role
    or text reads as empty; a null id is a conversation of its own.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    one = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    long = F.aggregate("rows", F.lit(0).cast("long"), lambda n, r: n + F.char_length(r["text"])) > most
    marked = F.transform("rows", lambda r, i: r.withField("text", F.when(r["text"] == "", "").otherwise(F.concat(F.lit(ATTACHED), i.cast("string")))))
    one = one.withColumn("attached", F.when(long, F.transform("rows", lambda r: r["text"])).otherwise(F.array().cast("array<string>"))).withColumn(
        "rows", F.when(long, marked).otherwise(F.col("rows")))
    roles = F.transform("rows", lambda r: r["role"])
    text = [F.col("rows")[i]["text"] for i in range(3)]
    sharing = F.transform("rows", lambda r: F.struct(
        F.when(r["role"] == "user", "human").when(r["role"] == "assistant", "gpt").otherwise(r["role"]).alias("from"), r["text"].alias("value")))
    plain = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("content")))
    known = F.forall(roles, lambda r: r.isin("system", "user", "assistant"))
    record = (F.when(roles == F.array(F.lit("user"), F.lit("assistant")), F.to_json(F.struct(text[0].alias("prompt"), text[1].alias("response"))))
              .when(roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")),
                    F.to_json(F.struct(text[0].alias("system"), text[1].alias("instruction"), text[2].alias("output"))))
              .when((F.pmod("conv_id", F.lit(2)) == 1) & known, F.to_json(F.struct(sharing.alias("conversations"))))
              .otherwise(F.to_json(F.struct(plain.alias("messages")))))
    return one.select("conv_id", record.alias("record"), "attached")
