"""Chat formatting by schema fingerprints (operator 11, native).

A record (a VARIANT, of any layout) has a set of nested field paths, such as ``messages[].role``. Those paths
that any layout knows are hashed; the hash selects a declarative layout, and that one says where the record
keeps its turns. All records become one canonical form, an array of (role, text), whatever their layout.

A template then marks the turns. Its control strings can't occur inside texts: an escape character is put
into each that a text holds, and doubled where the text has it, so that everything can be read back. Beside
the formatted text stand the spans of its assistant texts, for a loss mask.

All of it is column expressions: no Python runs on the executors, and each record is handled where it lies.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Listed:
    """Turns in an array of objects: where it is, and the fields of role, text and order (None: as they lie)."""

    name: str
    at: str
    role: str
    text: str
    order: str | None = None
    blocks: str | None = None  # the text is an array of blocks, of which this field counts
    roles: tuple[tuple[str, str], ...] = ()  # other names of roles

    def fingerprints(self) -> list[tuple[str, ...]]:
        fields = [self.role, self.text if self.blocks is None else f"{self.text}[].{self.blocks}", *([self.order] if self.order else [])]
        return [tuple(sorted(f"{self.at}[].{f}" for f in fields))]

    def turns(self, record: Column) -> Column:
        fields = [self.role, self.text, *([self.order] if self.order else [])]
        kinds = [f"`{f}`: " + ("bigint" if f == self.order else f"array<struct<`{self.blocks}`: string>>" if f == self.text and self.blocks else "string") for f in fields]
        rows = F.try_variant_get(record, f"$.{self.at}" if self.at else "$", f"array<struct<{', '.join(kinds)}>>")

        def turn(x: Column) -> Column:
            role = F.coalesce(x[self.role], F.lit(""))
            for other, plain in self.roles:
                role = F.when(x[self.role] == other, plain).otherwise(role)
            text = x[self.text] if self.blocks is None else F.array_join(F.transform(x[self.text], lambda b: b[self.blocks]), "")
            order = [x[self.order].alias("order")] if self.order else []
            return F.struct(*order, role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))

        made = F.transform(rows, turn)
        return F.transform(F.array_sort(made), lambda x: F.struct(x.role.alias("role"), x.text.alias("text"))) if self.order else made


@dataclass(frozen=True)
class Fields:
    """Turns in fields of their own: (role, fields); those of one role are joined by an empty line. Optional fields may be absent."""

    name: str
    parts: tuple[tuple[str, tuple[str, ...]], ...]
    optional: tuple[str, ...] = ()

    def fingerprints(self) -> list[tuple[str, ...]]:
        needed = [f for _, fields in self.parts for f in fields if f not in self.optional]
        return [tuple(sorted((*needed, *some))) for k in range(len(self.optional) + 1) for some in combinations(self.optional, k)]

    def turns(self, record: Column) -> Column:
        made = []
        for role, fields in self.parts:
            texts = [F.try_variant_get(record, f"$.{f}", "string") for f in fields]
            if all(f in self.optional for f in fields):
                shown = F.concat_ws("\n\n", *[F.nullif(t, F.lit("")) for t in texts])
                made.append(F.when(shown != "", F.struct(F.lit(role).alias("role"), shown.alias("text"))))
            else:
                first, *more = [F.coalesce(t, F.lit("")) if f not in self.optional else F.nullif(t, F.lit("")) for f, t in zip(fields, texts)]
                made.append(F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", first, *more).alias("text")))
        return F.filter(F.array(*made), lambda x: x.isNotNull())


#: Layouts of training sets in use.
LAYOUTS = (
    Listed("turn_rows", "rows", "role", "text", "turn"),
    Listed("messages", "messages", "role", "content"),
    Listed("message_blocks", "messages", "role", "content", blocks="text"),
    Listed("message_list", "", "role", "content"),
    Listed("from_value", "conversations", "from", "value", roles=(("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))),
    Fields("instruction", (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input")),
    Fields("prompt_completion", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system",)),
    Fields("prompt_response", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Fields("question_answer", (("system", ("context",)), ("user", ("question",)), ("assistant", ("answer",))), optional=("context",)),
)


def paths(record: Column) -> Column:
    """The nested field paths of a record, sorted; an array adds ``[]`` to its path, a null record has none.

    They are read off the record's own schema, by a walk over its tokens with a stack of open objects and arrays.
    """
    tokens = F.regexp_extract_all(F.schema_of_variant(record), F.lit(r"(?:`(?:[^`]|``)*`|[^\s<>,:`]+): |OBJECT<|ARRAY<|>|[A-Z_]+(?:\([0-9, ]*\))?"), F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit("").alias("name"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        top = F.coalesce(F.try_element_at(s.open, F.lit(-1)), F.lit(""))
        here = F.when(top == "", s["name"]).when(s["name"] == "", top).otherwise(F.concat(top, F.lit("."), s["name"]))
        named = F.regexp_replace(F.regexp_replace(t, ": $", ""), "^`|`$", "")
        to = lambda open_, name, out: F.struct(open_.alias("open"), name.alias("name"), out.alias("out"))
        return (
            F.when(t.endswith(": "), to(s.open, named, s.out))
            .when(t == "OBJECT<", to(F.array_append(s.open, here), F.lit(""), s.out))
            .when(t == "ARRAY<", to(F.array_append(s.open, F.concat(here, F.lit("[]"))), F.lit(""), s.out))
            .when(t == ">", to(F.slice(s.open, F.lit(1), F.greatest(F.size(s.open) - 1, F.lit(0))), F.lit(""), s.out))
            .otherwise(to(s.open, F.lit(""), F.array_append(s.out, here)))
        )

    return F.coalesce(F.array_sort(F.array_distinct(F.aggregate(tokens, start, step, lambda s: s.out))), F.array().cast("array<string>"))


def fingerprint(path_list: Column, layouts=LAYOUTS) -> Column:
    """The hash of those paths that some layout knows, so that fields beside the turns don't matter."""
    known = sorted({p for x in layouts for f in x.fingerprints() for p in f})
    return F.xxhash64(F.array_join(F.array_intersect(path_list, F.array(*[F.lit(p) for p in known])), "\n"))


def canonical(rows: DataFrame, record: str, layouts=LAYOUTS) -> DataFrame:
    """``rows`` with ``paths``, ``layout`` and ``turns`` (role, text) of the VARIANT column ``record``.

    A record whose paths fit no layout, and a null one, has a null layout and null turns, and stays; its paths
    say what a new layout would have to name. A null text is an empty one, a null role an empty role; a list
    without a turn fits no layout. Ordered layouts sort by order (nulls first), then role, then text, so that
    ties and repeated turns come out the same each time. Columns of these three names are replaced.
    """
    table = [x for layout in layouts for f in layout.fingerprints() for x in (F.xxhash64(F.lit("\n".join(f))), F.lit(layout.name))]
    marked = rows.withColumn("paths", paths(F.col(record)))
    marked = marked.withColumn("layout", F.try_element_at(F.create_map(*table), fingerprint(F.col("paths"), layouts)))
    turns = reduce(lambda otherwise, x: F.when(F.col("layout") == x.name, x.turns(F.col(record)).cast(TURNS)).otherwise(otherwise), layouts, F.lit(None).cast(TURNS))
    return marked.withColumn("turns", turns)


@dataclass(frozen=True)
class Template:
    """How turns are marked: (before, after) of each role with marks of its own, and (before, between, after) of
    any other, whose name is written out. ``start`` opens the conversation.

    Every mark but the spaces at a text's side is a control string; each begins with one of ``openers``.
    """

    start: str = "<s>"
    roles: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>> ", " <</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>")})
    other: tuple[str, str, str] = ("<|role|> ", " <|text|> ", " <|end|>")

    def control(self) -> list[str]:
        marks = [self.start, *[m for pair in self.roles.values() for m in pair], *self.other]
        return sorted({m.strip() for m in marks if m.strip()}, key=lambda m: (-len(m), m))

    def inside(self) -> str:
        """A pattern of the places where the escape goes: at an escape, and after the first character of a control string."""
        return r"\\|" + "|".join(f"(?<={re.escape(m[0])})(?={re.escape(m[1:])})" for m in self.control())

    def turn(self) -> str:
        """A pattern of one formatted turn."""
        q = lambda m: re.escape(m).replace(r"\ ", " ")
        own = [f"{q(a)}.*?{q(b)}" for a, b in self.roles.values()]
        a, b, c = self.other
        return "(?s)" + "|".join([f"{q(a)}.*?{q(b)}.*?{q(c)}", *own])


INST = Template()


def escaped(text: Column, template: Template = INST) -> Column:
    return F.regexp_replace(text, template.inside(), r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def offsets(lengths: Column, block: int = 256) -> Column:
    """Running sums before each element. Sums of blocks come first, so that long arrays don't take quadratic time."""

    def summed(x: Column) -> Column:
        return F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)

    def spread(xs: Column) -> Column:
        n_blocks = F.ceil(F.size(xs) / block).cast("int")
        sums = F.transform(F.sequence(F.lit(0), F.greatest(n_blocks - 1, F.lit(0))), lambda b: summed(F.slice(xs, b * block + 1, F.lit(block))))

        def placed(own: Column) -> Column:
            bases = F.transform(own, lambda v, i: summed(F.slice(own, F.lit(1), i)))
            return let(bases, lambda base: F.transform(xs, lambda v, i: F.get(base, F.floor(i / block).cast("int")) + summed(F.slice(xs, F.floor(i / block).cast("int") * block + 1, i % block))))

        return let(sums, placed)

    return let(lengths, spread)


def formatted(rows: DataFrame, template: Template = INST, loss_role: str = "assistant", turns: str = "turns") -> DataFrame:
    """``rows`` with ``formatted`` and ``loss_spans`` (start, end of the texts of ``loss_role``, in code points, end exclusive).

    Null turns have a null text and null spans; no turns have the start mark alone. Columns of these names are replaced.
    """

    def piece(t: Column) -> Column:
        a, b, c = template.other
        out = F.struct(F.concat(F.lit(a), escaped(t.role, template), F.lit(b)).alias("before"), F.lit(c).alias("after"))
        for role, (before, after) in template.roles.items():
            out = F.when(t.role == role, F.struct(F.lit(before).alias("before"), F.lit(after).alias("after"))).otherwise(out)
        return let(out, lambda o: F.struct(o.before.alias("before"), escaped(t.text, template).alias("text"), o.after.alias("after"), (t.role == loss_role).alias("loss")))

    rows = rows.withColumn("__pieces", F.transform(turns, piece))
    whole = F.concat(F.lit(template.start), F.array_join(F.transform("__pieces", lambda p: F.concat(p.before, p.text, p.after)), ""))
    at = offsets(F.transform("__pieces", lambda p: (F.length(p.before) + F.length(p.text) + F.length(p.after)).cast("long")))
    begin = lambda p, o: o + len(template.start) + F.length(p.before)
    spans = F.filter(F.zip_with("__pieces", at, lambda p, o: F.when(p.loss, F.struct(begin(p, o).alias("start"), (begin(p, o) + F.length(p.text)).alias("end")))), lambda x: x.isNotNull())
    return rows.withColumn("formatted", whole).withColumn("loss_spans", spans).drop("__pieces")


def read_back(text: Column, template: Template = INST) -> Column:
    """The turns (role, text) of a formatted text."""

    def turn(x: Column) -> Column:
        a, b, c = template.other
        inner = F.substring(x, F.lit(len(a) + 1), F.length(x) - len(a) - len(c))
        out = F.struct(unescaped(F.substring_index(inner, b, 1)).alias("role"), unescaped(F.substring(inner, F.locate(b, inner) + len(b), F.length(inner))).alias("text"))
        for role, (before, after) in template.roles.items():
            body = F.substring(x, F.lit(len(before) + 1), F.length(x) - len(before) - len(after))
            out = F.when(x.startswith(before), F.struct(F.lit(role).alias("role"), unescaped(body).alias("text"))).otherwise(out)
        return out

    body = F.substring(text, F.lit(len(template.start) + 1), F.length(text))
    return F.transform(F.regexp_extract_all(body, F.lit(template.turn()), F.lit(0)), turn)


def masked(text: Column, spans: Column) -> Column:
    """What the loss mask covers, as texts."""
    return F.transform(spans, lambda s: unescaped(F.substring(text, (s.start + 1).cast("int"), (s.end - s.start).cast("int"))))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is one record, and one row of the result, so its turns meet in one group."""
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    records = given.unionByName(added).groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("rows"))
    records = records.select("conv_id", F.to_variant_object(F.struct("rows")).alias("record"))
    rows = formatted(canonical(records, "record")).select("conv_id", "formatted", "loss_spans")
    back = F.array_join(F.transform(read_back(F.col("formatted")), lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join(masked(F.col("formatted"), F.col("loss_spans")), "")
    rows = rows.select("conv_id", F.size(read_back(F.col("formatted"))).cast("long").alias("n_turns"), back.alias("back"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return rows.select("conv_id", "n_turns", F.sha2(F.col("back").cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


#: Lengths of the marks are added up; a control string takes one escape, and so does an escape.
ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\]', '', 'g')) + len(regexp_extract_all(text, '</?s>|\[/?INST\]|<</?SYS>>|<\|(role|text|end)\|>'))
    + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 WHEN 'system' THEN 17
      ELSE 27 + length(role) + length(regexp_replace(role, '[^\\]', '', 'g')) + len(regexp_extract_all(role, '</?s>|\[/?INST\]|<</?SYS>>|<\|(role|text|end)\|>')) END AS n
  FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(n))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""
