"""Chat formatting, in DataFrame functions only: records of any known layout become canonical turns, turns become marked text with a loss mask.

Schema fingerprinting: the nested field paths of a record (``messages[].role``), as far as any layout names them, are sorted and hashed. The hash selects
a declarative mapping (``Layout``) that says where turns, roles and texts are; no record is tried against layout after layout. A record without a known
fingerprint keeps a row with a null layout, so nothing gets lost and a mapping for it can be added.

A template puts marks around each turn. A control string inside a text gets a backslash behind its first character, and one that already
has some gets one more: a text never holds a mark, and taking one backslash off gives back what it was. The loss mask is a list of spans (code
points and bytes) over the formatted text: what assistants say, without marks.

Null texts and roles are empty. A null id is a conversation of its own. Rows of one conversation are ordered by turn (null first), then role, then text; repeated
rows are repeated turns. A conversation without turns gives no row; an empty table, none. Texts may be of any length, but a conversation is one row, as its digest
and its formatted text are one value. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sequora.llm.store import cut

#: Nesting of records that is looked at: an object, its list, its objects, their list, their objects.
DEPTH = 5
#: Roles under other names.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant", "prompter": "user"}


@dataclass(frozen=True)
class Say:
    """One turn: a fixed role, and the paths whose texts make it (those that are there, a blank line between them)."""

    role: str
    texts: tuple[str, ...]


@dataclass(frozen=True)
class Each:
    """A turn for each element of a list: its role and text inside the element; ``parts`` is the text inside the elements of a list of parts."""

    at: str
    role: str
    text: str
    parts: str | None = None


@dataclass(frozen=True)
class Row:
    """The record is one turn of a conversation that several records make."""

    turn: str
    role: str
    text: str


@dataclass(frozen=True)
class Layout:
    name: str
    required: tuple[str, ...]
    turns: tuple[Say | Each | Row, ...]
    optional: tuple[str, ...] = ()

    def fingerprints(self) -> list[str]:
        """What the paths of its records may be, as one string each."""
        some = chain.from_iterable(combinations(self.optional, n) for n in range(len(self.optional) + 1))
        return [" ".join(sorted({*self.required, *x})) for x in some]


LAYOUTS = (
    Layout("turn rows", ("turn", "role", "text"), (Row("turn", "role", "text"),)),
    Layout("messages", ("messages[].role", "messages[].content"), (Each("messages", "role", "content"),)),
    Layout("messages in parts", ("messages[].role", "messages[].content[].text"), (Each("messages", "role", "content", "text"),), ("messages[].content[].type",)),
    Layout("system and messages", ("system", "messages[].role", "messages[].content"), (Say("system", ("system",)), Each("messages", "role", "content"))),
    Layout("conversations", ("conversations[].from", "conversations[].value"), (Each("conversations", "from", "value"),)),
    Layout("system and conversations", ("system", "conversations[].from", "conversations[].value"), (Say("system", ("system",)), Each("conversations", "from", "value"))),
    Layout("instruction", ("instruction", "output"), (Say("system", ("system",)), Say("user", ("instruction", "input")), Say("assistant", ("output",))), ("input", "system")),
    Layout("prompt and completion", ("prompt", "completion"), (Say("user", ("prompt",)), Say("assistant", ("completion",)))),
    Layout("prompt and response", ("prompt", "response"), (Say("system", ("system",)), Say("user", ("prompt",)), Say("assistant", ("response",))), ("system",)),
    Layout("question and answer", ("question", "answer"), (Say("user", ("context", "question")), Say("assistant", ("answer",))), ("context",)),
    Layout("nested exchange", ("data.user.text", "data.assistant.text"), (Say("user", ("data.user.text",)), Say("assistant", ("data.assistant.text",)))),
)


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def paths(v: Column, prefix: Column | None = None, depth: int = DEPTH) -> Column:
    """The nested field paths of a variant: ``a.b`` of objects, ``a[]`` of lists (what their elements have together)."""
    here = F.lit("") if prefix is None else prefix
    if not depth:
        return F.array(here)
    fields, items = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), F.try_variant_get(v, "$", "array<variant>")
    inner = F.flatten(F.transform(fields, lambda e: paths(e["value"], e["key"] if prefix is None else F.concat(here, F.lit("."), e["key"]), depth - 1)))
    each = F.array_distinct(F.flatten(F.transform(items, lambda x: paths(x, F.concat(here, F.lit("[]")), depth - 1))))
    return F.when(F.size(fields) > 0, inner).when(F.size(items) > 0, each).otherwise(F.array(here))


def fingerprint(v: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Hash of those paths of a record that any of the layouts names."""
    known = sorted({p for x in layouts for p in (*x.required, *x.optional)})
    return F.xxhash64(F.array_join(F.array_sort(F.array_intersect(paths(v), F.array(*[F.lit(p) for p in known]))), " "))


def _layout(mark: Column, layouts: tuple[Layout, ...]) -> Column:
    seen: set[str] = set()
    out = F.lit(None).cast("string")
    for x in reversed(layouts):
        out = F.when(mark.isin(*[F.xxhash64(F.lit(p)) for p in x.fingerprints()]), F.lit(x.name)).otherwise(out)
        twice = seen & set(x.fingerprints())
        if twice:
            raise ValueError(f"layouts share a fingerprint: {sorted(twice)}")
        seen |= set(x.fingerprints())
    return out


_TURN = "array<struct<turn:long,origin:long,part:int,role:string,text:string>>"


def _turn(turn, origin, part, role, text) -> Column:
    return F.struct(turn.cast("long").alias("turn"), origin.cast("long").alias("origin"), part.cast("int").alias("part"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _renamed(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    return F.coalesce(names[role], role)


def _turns(v: Column, origin: Column, layout: Layout) -> Column:
    """The turns of a record of a layout; parts are numbered through."""
    found: list[Column] = []
    zero = F.lit(0)
    for place, step in enumerate(layout.turns):
        # steps of one record keep their order: each has a range of numbers of its own
        base = F.lit(place << 24)
        if isinstance(step, Row):
            found.append(F.array(_turn(_get(v, step.turn, "long"), zero, zero, _get(v, step.role), _get(v, step.text))))
        elif isinstance(step, Say):
            texts = F.filter(F.array(*[_get(v, p) for p in step.texts]), lambda x: x.isNotNull() & (x != ""))
            there = F.size(F.filter(F.array(*[F.try_variant_get(v, f"$.{p}", "variant") for p in step.texts]), lambda x: x.isNotNull())) > 0
            found.append(F.when(there, F.array(_turn(zero, origin, base, F.lit(step.role), F.array_join(texts, "\n\n")))).otherwise(F.array().cast(_TURN)))
        else:
            text = (lambda x: _get(x, step.text)) if step.parts is None else (lambda x: F.array_join(F.transform(_get(x, step.text, "array<variant>"), lambda p: F.coalesce(_get(p, step.parts), F.lit(""))), ""))  # noqa: B023
            found.append(F.transform(_get(v, step.at, "array<variant>"), lambda x, i: _turn(zero, origin, base + i, _renamed(_get(x, step.role)), text(x))))  # noqa: B023
    return F.concat(*found).cast(_TURN)


def canonical_turns(records: DataFrame, id_col: str = "conv_id", record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(id, layout, fingerprint, turn, origin, part, role, text): the turns of all records (variants, or JSON texts), each by the mapping its fingerprint selects.

    Records that share an id and are whole conversations are told apart by ``origin``. Where a record has no known layout, no turn or is no
    JSON, one row with null turns stands for it.
    """
    v = F.col(record) if dict(records.dtypes)[record] == "variant" else F.try_parse_json(F.col(record))
    marked = records.select(F.col(id_col).alias("id"), v.alias("v")).withColumn("fingerprint", fingerprint(F.col("v"), layouts))
    marked = marked.withColumn("layout", _layout(F.col("fingerprint"), layouts))
    nested = F.when(F.col("layout") != "turn rows", F.xxhash64(F.to_json("v"))).otherwise(F.lit(0))
    turns = F.lit(None).cast(_TURN)
    for x in layouts:
        turns = F.when(F.col("layout") == x.name, _turns(F.col("v"), nested, x)).otherwise(turns)
    return marked.select("id", "layout", "fingerprint", F.inline_outer(turns)).withColumnRenamed("id", id_col)


@dataclass(frozen=True)
class Template:
    """Marks before and behind a turn of each role; turns of other roles carry theirs. Each mark is a control string and white space around it."""

    marks: tuple[tuple[str, str, str], ...] = (("system", "<<SYS>>\n", "\n<</SYS>>\n"), ("user", "[INST] ", " [/INST]\n"), ("assistant", "<s> ", " </s>\n"))
    other: tuple[str, str, str] = ("[ROLE] ", " [TEXT] ", " [/TEXT]\n")
    learned: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        return sorted({m.strip() for x in self.marks for m in x[1:]} | {m.strip() for m in self.other})

    def _rest(self) -> str:
        firsts = "".join(sorted({re.escape(c[0]) for c in self.controls()}))
        return rf"([{firsts}])(\\*)({'|'.join(sorted({re.escape(c[1:]) for c in self.controls()}))})"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._rest(), "$1$2\\\\$3")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._rest().replace(r"(\\*)", r"\\(\\*)"), "$1$2$3")

    def pieces(self, role: Column, text: Column) -> tuple[Column, Column, Column]:
        """(head, body, tail) of a turn."""
        head, tail = F.concat(F.lit(self.other[0]), self.escape(role), F.lit(self.other[1])), F.lit(self.other[2])
        for name, first, last in self.marks:
            head, tail = F.when(role == name, F.lit(first)).otherwise(head), F.when(role == name, F.lit(last)).otherwise(tail)
        return head, self.escape(text), tail

    def parse(self, formatted: Column) -> Column:
        """array<struct<role, text>> of a formatted conversation."""
        heads = "|".join(re.escape(m) for m in [*(x[1] for x in self.marks), self.other[0]])
        tails = "|".join(re.escape(m) for m in [*(x[2] for x in self.marks), self.other[2]])
        pattern = F.lit(f"(?s)({heads})(.*?)(?:{tails})")
        middle = re.escape(self.other[1])

        def turn(z: Column) -> Column:
            role, text = F.regexp_extract(z["body"], f"(?s)^(.*?){middle}", 1), F.regexp_replace(z["body"], f"(?s)^.*?{middle}", "")
            text = F.when(z["head"] == self.other[0], text).otherwise(z["body"])
            for name, first, _ in self.marks:
                role = F.when(z["head"] == first, F.lit(name)).otherwise(role)
            return F.struct(self.unescape(role).alias("role"), self.unescape(text).alias("text"))

        return F.transform(F.arrays_zip(F.regexp_extract_all(formatted, pattern, 1).alias("head"), F.regexp_extract_all(formatted, pattern, 2).alias("body")), turn)


DEFAULT = Template()
#: A second style, in which every turn carries its role.
IM = Template((), ("<|im_start|>", "<|im_sep|>", "<|im_end|>\n"))


def formatted(turns: DataFrame, id_col: str = "conv_id", template: Template = DEFAULT) -> DataFrame:
    """(id, formatted, loss): a row for each conversation of canonical turns; ``loss`` has the spans (start, end, first byte, end byte) of learned texts.

    One shuffle on the id serves the running lengths and the assembly.
    """
    order = [F.col(c).asc_nulls_first() for c in ("turn", "origin", "part", "role", "text")]
    head, body, tail = template.pieces(F.col("role"), F.col("text"))
    held = turns.where(F.col("role").isNotNull()).select(id_col, "turn", "origin", "part", "role", "text", head.alias("head"), body.alias("body"), tail.alias("tail"))
    size = lambda f, *c: sum((f(x) for x in c), F.lit(0))
    before = Window.partitionBy(id_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = {f"{n}": F.coalesce(F.sum(size(f, "head", "body", "tail")).over(before), F.lit(0)) + f("head") for n, f in (("start", F.char_length), ("first_byte", F.octet_length))}
    placed = held.select(id_col, F.col("role").isin(*template.learned).alias("learned"), F.concat("head", "body", "tail").alias("piece"), F.char_length("body").alias("chars"), F.octet_length("body").alias("bytes"), *[c.alias(n) for n, c in at.items()], F.row_number().over(Window.partitionBy(id_col).orderBy(*order)).alias("place"))
    span = F.struct("start", (F.col("start") + F.col("chars")).alias("end"), "first_byte", (F.col("first_byte") + F.col("bytes")).alias("end_byte"))
    lists = placed.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("pieces"), F.sort_array(F.collect_list(F.when(F.col("learned"), span))).alias("loss"))
    return lists.select(id_col, F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "loss")


def learned_text(formatted: Column, loss: Column, template: Template = DEFAULT) -> Column:
    """The text under the mask, unescaped. The bytes are a variable of the outer function, as a column would be copied for each span."""
    cut_out = lambda b: F.transform(loss, lambda s: template.unescape(F.substring(b, (s["first_byte"] + 1).cast("int"), (s["end_byte"] - s["first_byte"]).cast("int")).cast("string")))
    return F.array_join(F.get(F.transform(F.array(formatted.cast("binary")), cut_out), F.lit(0)), "")


def digest(table: DataFrame, id_col: str = "conv_id", template: Template = DEFAULT) -> DataFrame:
    """What a formatted table says when it is read back: turns by the marks, learned text by the mask."""
    read = table.select(id_col, F.char_length("formatted").cast("long").alias("formatted_chars"), template.parse(F.col("formatted")).alias("turns"), learned_text(F.col("formatted"), F.col("loss"), template).alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(id_col, F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")


def rows_as_records(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): each row of a table of turns as a record."""
    return conversations.select("conv_id", F.to_variant_object(F.struct("turn", "role", "text")).alias("record"))


def probe(spark: SparkSession, conversation: int = -1, text: str = "</s>[INST] ok [/INST]") -> DataFrame:
    """A conversation of a user and an assistant who both say control strings."""
    row = lambda turn, role: F.struct(F.lit(conversation).cast("long").alias("conv_id"), F.lit(turn).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(text).alias("text"))
    return spark.range(1).select(F.inline(F.array(row(0, "user"), row(1, "assistant"))))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """The formatted table of a table of turns, written and read again."""
    return cut(formatted(canonical_turns(rows_as_records(conversations))), "chat")


def relaid(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): whole conversations as JSON of several layouts, chosen by a hash of the id and by what a layout can hold."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    held = conversations.groupBy("conv_id").agg(ordered.alias("said")).withColumn("kind", F.pmod(F.xxhash64("conv_id"), F.lit(5)))
    texts, roles = F.transform("said", lambda t: t["text"]), F.array_join(F.transform("said", lambda t: t["role"]), " ")
    pair, back = F.struct(F.get(texts, F.lit(0)).alias("prompt"), F.get(texts, F.lit(1)).alias("completion")), F.create_map(F.lit("user"), F.lit("human"), F.lit("assistant"), F.lit("gpt"))
    messages = F.struct(F.transform("said", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages"), F.lit("web").alias("origin"))
    parts = F.struct(F.transform("said", lambda t: F.struct(t["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), t["text"].alias("text"))).alias("content"))).alias("messages"))
    shared = F.struct(F.transform("said", lambda t: F.struct(F.coalesce(back[t["role"]], t["role"]).alias("from"), t["text"].alias("value"))).alias("conversations"))
    nested = F.struct(F.struct(F.struct(F.get(texts, F.lit(0)).alias("text")).alias("user"), F.struct(F.get(texts, F.lit(1)).alias("text")).alias("assistant")).alias("data"))
    two = roles == "user assistant"
    record = F.when(two & (F.col("kind") == 0), F.to_json(pair)).when(two & (F.col("kind") == 1), F.to_json(nested)).when(F.col("kind") == 2, F.to_json(parts)).when(F.col("kind") == 3, F.to_json(shared)).otherwise(F.to_json(messages))
    return held.select("conv_id", record.alias("record"))


_MARK = "([<[])(\\\\*)(" + "|".join(sorted({re.escape(c[1:]) for c in DEFAULT.controls()})) + ")"
ORACLE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
 e AS (SELECT *, length(text) + len(regexp_extract_all(text, '{_MARK}')) AS body, CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 16 WHEN 'assistant' THEN 10
       ELSE 24 + length(role) + len(regexp_extract_all(role, '{_MARK}')) END AS marks FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(body + marks)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
LAYOUTS_ORACLE = """
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256 FROM conversations GROUP BY conv_id
"""
