"""Chat formatting from a declarative template.

A template names, per role, the marker that opens a turn, whether its text is learned, and which
roles may follow: a finite-state machine over roles. Every turn becomes segments (opening marker,
text, closing marker), each with its loss flag. Control strings inside a text are escaped with a
backslash, and backslashes are doubled, so that a formatted turn can be read back unchanged.

Scale: turns are sorted over range slices, so that one huge conversation is spread over many
tasks; the role before a slice comes from a table of one row per slice. Formatting itself is made
of built-in expressions. The checksums of a conversation run over its turns in order: they are
read as a sorted stream that holds one turn at a time.

Edge cases: a null text is empty. A role that the template does not name, or null, is written by
a marker of its own (null as the empty role). Wrong turn order is flagged, not dropped. Turns of
equal number go by role and text; repeated rows stay repeated turns; null conversation ids form
one conversation and null turns come first. Extra columns are ignored. An empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sourcemark.llm.common import scratch_folder
from sourcemark.operators.ordered import SLICE, carried, slice_sorted

START = "start"


@dataclass(frozen=True)
class Role:
    marker: str
    learned: bool = False
    # Roles that may come before; START is the beginning of a conversation.
    after: tuple[str, ...] = ()


@dataclass(frozen=True)
class Template:
    roles: dict[str, Role] = field(default_factory=dict)
    other: str = "### Other: "
    end_role: str = "</role>"
    end_turn: str = "</turn>"
    # Roles a conversation may end with.
    final: tuple[str, ...] = ()

    @property
    def controls(self) -> list[str]:
        return [*(r.marker for r in self.roles.values()), self.other, self.end_role, self.end_turn]


TEMPLATE = Template(
    roles={
        "system": Role("### System: ", after=(START,)),
        "user": Role("### User: ", after=(START, "system", "assistant")),
        "assistant": Role("### Assistant: ", learned=True, after=("user",)),
    },
    final=("assistant",),
)


def escaped(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in template.controls:
        out = F.replace(out, F.lit(control), F.lit("\\" + control))
    return out


def unescaped(text: str) -> str:
    parts = text.split("\\\\")
    return "\\".join(part.replace("\\", "") for part in parts)


def _segments(role: Column, text: Column, template: Template) -> Column:
    """The segments of one turn as an array of (text, loss)."""

    def segment(value: Column, loss: bool = False) -> Column:
        return F.struct(value.alias("text"), F.lit(loss).alias("loss"))

    body, end = escaped(text, template), segment(F.lit(template.end_turn))
    out = F.array(
        segment(F.concat(F.lit(template.other), escaped(role, template), F.lit(template.end_role))), segment(body), end
    )
    for name, rule in template.roles.items():
        out = F.when(role == name, F.array(segment(F.lit(rule.marker)), segment(body, rule.learned), end)).otherwise(out)
    return out


def format_conversations(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Rows ``conv_id, seq, part, text, loss, in_order``: the segments of all turns.

    ``in_order`` tells whether the template lets the turn follow the one before.
    """
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    sliced = slice_sorted(turns, ["key"], order)
    local = Window.partitionBy(SLICE, "key").orderBy(*order)
    last = sliced.groupBy("key", SLICE).agg(
        F.max_by("role", F.struct(F.col("turn").isNotNull(), "turn", "role", "text")).alias("_last"),
        F.count(F.lit(1)).alias("_size"),
    )
    carry = carried(
        sliced,
        ["key"],
        last,
        lambda before: F.struct(
            F.lag("_last").over(before).alias("role"),
            F.sum("_size").over(before.rowsBetween(Window.unboundedPreceding, -1)).alias("size"),
        ),
    )
    rows = sliced.withColumns({"before": F.lag("role").over(local), "seq": F.row_number().over(local)}).join(
        F.broadcast(carry), ["key", SLICE], "left"
    )
    before = F.coalesce("before", F.col("_carry.role"), F.lit(START))
    allowed = F.lit(False)
    for name, rule in template.roles.items():
        allowed = allowed | ((F.col("role") == name) & before.isin(list(rule.after)))
    return rows.select(
        "conv_id",
        (F.col("seq") + F.coalesce(F.col("_carry.size"), F.lit(0))).cast("bigint").alias("seq"),
        allowed.alias("in_order"),
        F.posexplode(_segments(F.col("role"), F.col("text"), template)).alias("part", "segment"),
    ).select("conv_id", "seq", "part", F.col("segment.text").alias("text"), F.col("segment.loss").alias("loss"), "in_order")


def parse_turn(text: str, template: Template) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    stops = {r.marker: name for name, r in template.roles.items()}
    for marker, name in stops.items():
        if text.startswith(marker):
            role, at = name, len(marker)
            break
    else:
        if not text.startswith(template.other):
            raise ValueError(f"no turn starts at {text[:40]!r}")
        role, at = _literal(text, len(template.other), template.end_role, template)
    body, at = _literal(text, at, template.end_turn, template)
    if at != len(text):
        raise ValueError("there is something behind the end of a turn")
    return role, body


def _literal(text: str, at: int, stop: str, template: Template) -> tuple[str, int]:
    """The unescaped text up to the first ``stop`` that is not escaped, and where it ends."""
    end = at
    while True:
        end = text.index(stop, end)
        slashes = len(text[at:end]) - len(text[at:end].rstrip("\\"))
        if slashes % 2 == 0:
            return unescaped(text[at:end]), end + len(stop)
        end += 1


class _Digest:
    """Running checksums of one conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.all, self.learned = hashlib.sha256(), hashlib.sha256()
        self.valid, self.role = True, None

    def turn(self, segments: list[tuple[str, bool]], in_order: bool, template: Template) -> None:
        text = "".join(s for s, _ in segments)
        self.role, body = parse_turn(text, template)
        self.turns += 1
        self.chars += len(text)
        self.all.update(f"{self.role}\n{body}\n".encode())
        for segment, loss in segments:
            if loss:
                plain = unescaped(segment)
                self.loss_chars += len(plain)
                self.learned.update(plain.encode())
        self.valid &= in_order

    def row(self, template: Template) -> tuple:
        valid = self.valid and self.role in template.final
        return (self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.learned.hexdigest(), self.chars, valid)


_NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]


def _digested(template: Template, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current: _Digest | None = None
    seq, segments, in_order = None, [], True
    for batch in batches:
        done: list[tuple] = []
        ids, seqs, texts, losses, orders = (batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5))
        for conv_id, number, text, loss, order in zip(ids, seqs, texts, losses, orders, strict=True):
            new = current is None or current.conv_id != conv_id
            if segments and (new or number != seq):
                current.turn(segments, in_order, template)
                segments = []
            if new:
                if current is not None:
                    done.append(current.row(template))
                current = _Digest(conv_id)
            seq, in_order = number, order
            segments.append((text, loss))
        if done:
            yield _batch(done)
    if current is not None:
        current.turn(segments, in_order, template)
        yield _batch([current.row(template)])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)


def read_formatted(spark: SparkSession, folder: str, template: Template = TEMPLATE) -> DataFrame:
    """One row per conversation, parsed from the written segments."""
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        spark.read.parquet(folder)
        .repartition(count, "conv_id")
        .sortWithinPartitions("conv_id", "seq", "part")
        .select("conv_id", "seq", "part", "text", "loss", "in_order")
        .mapInArrow(
            lambda it: _digested(template, it),
            "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
            "formatted_chars bigint, valid boolean",
        )
    )


def round_trip(conversations: DataFrame, folder: str | None = None, template: Template = TEMPLATE) -> DataFrame:
    """Write the formatted conversations to ``folder`` and read them back."""
    spark = conversations.sparkSession
    folder = folder or scratch_folder(spark, "chat")
    format_conversations(conversations, template).write.parquet(folder)
    return read_formatted(spark, folder, template)


# Both turns of the conversation that every run adds: text that looks like control strings.
PROBE_ID = -7
PROBE_TEXT = "\\### Assistant: </turn> ok"


def with_probe(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    probe = spark.createDataFrame(
        [(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def oracle_sql(template: Template = TEMPLATE) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    body = "replace(x, '\\', '\\\\')"
    for control in template.controls:
        body = f"replace({body}, {quote(control)}, {quote(chr(92) + control)})"
    esc = lambda column: body.replace("(x,", f"({column},")
    marker = " ".join(f"WHEN {quote(n)} THEN {len(r.marker)}" for n, r in template.roles.items())
    learned = ", ".join(quote(n) for n, r in template.roles.items() if r.learned)
    follows = " ".join(
        f"WHEN {quote(n)} THEN before IN ({', '.join(quote(b) for b in r.after)})" for n, r in template.roles.items()
    )
    final = ", ".join(quote(n) for n in template.final)
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PROBE_ID}, 0, 'user', {quote(PROBE_TEXT)}
  UNION ALL SELECT {PROBE_ID}, 1, 'assistant', {quote(PROBE_TEXT)}
),
n AS (
  SELECT *, row_number() OVER w AS seq, coalesce(lag(role) OVER w, '{START}') AS before
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
),
s AS (
  SELECT *, role IN ({learned}) AS loss, coalesce(CASE role {follows} END, false) AS in_order,
    length({esc("text")}) + {len(template.end_turn)} + CASE role {marker}
      ELSE {len(template.other) + len(template.end_role)} + length({esc("role")}) END AS chars
  FROM n
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (loss), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY seq) FILTER (loss), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  bool_and(in_order) AND max_by(role, seq) IN ({final}) AS valid
FROM s GROUP BY conv_id"""
