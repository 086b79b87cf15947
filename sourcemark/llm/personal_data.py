"""Personal data in texts: base patterns as seeds, and bootstrapped contextual extraction beyond them.

Seeds are what the base patterns find. The words around a seed form lexical patterns (two words
before; one before and one after). Every other run with a digit or an at sign is a candidate in the
same kind of contexts. Patterns and instances (distinct values) are the two sides of a graph that
Spark scores in rounds: a pattern's confidence in a kind is the share of its distinct instances that
are believed to be of that kind, an instance's belief is what its patterns leave no doubt of
(1 minus the product of their doubts). A candidate is found if its loose form admits the kind
and its belief reaches the limit; a pattern speaks only with enough distinct seeds behind it.

A context that holds kinds side by side, or numbers of all sorts, never gets confident. Copies of a
document add nothing to a pattern, as instances count once. Every pass is over all texts; the graph
holds digests and counts, never texts, and its joins deal out patterns and instances that hold many
edges. Base spans always stay; a candidate never overlaps one.

Edge cases: null and empty texts have no spans. Texts are read whole; all searches take time in
proportion to the text, also on runs of a million digits or letters. Repeated rows and rows of one
or no id are rows of their own. Equal spans of two kinds are both listed, in the order of the
kinds. An empty table gives no rows, other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcemark.llm.common import scratch_folder
from sourcemark.operators.joins import attach

# Fixed by the contract: the kinds, in their order among spans of one start.
KINDS = ("email", "ip", "card", "phone")

# How far around a span its context words are read, in code points.
REACH = 64
# Rounds of scoring; distinct seeds a pattern needs of a kind; confidence and belief that count.
ROUNDS = 3
SUPPORT = 4
CONFIDENT = 0.8
BELIEVED = 0.8
# Instances without a known kind weigh this much against a pattern.
DOUBT = 0.5

_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_ZONE = re.compile(r"[0-9][0-9. ()-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# What makes a run a candidate, and the punctuation around it that is left out.
_MARK = re.compile(r"[0-9@]")
_EDGE = "\"'`<>()[]{},;:!?.*=|#&$%~"
_DIGITS = re.compile(r"[0-9]")
_SPACE = re.compile(r"\s")
_WORD = re.compile(r"\S+")

# Loose forms: what a candidate must look like to be of a kind at all.
_LOOSE = {
    "email": re.compile(r"[^\s@]+@[^\s@]+"),
    "ip": re.compile(r"[0-9]{1,3}(?:[.,:_-][0-9]{1,3}){3}|(?=(?:[^:]*:){2})[0-9A-Fa-f:]{4,39}"),
    "card": re.compile(r"[0-9](?:[-./_]?[0-9]){11,18}"),
    "phone": re.compile(r"\+?[(]?[0-9](?:[-.()/]{0,2}[0-9]){5,14}"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


def _run_start(text: str, ends: re.Pattern, low: int, high: int) -> int:
    """Where the run up to ``high`` begins, not before ``low``; read backwards in windows that widen."""
    reach = 64
    while True:
        bound = max(low, high - reach)
        start = bound
        for m in ends.finditer(text, bound, high):
            start = m.end()
        if start > bound or bound == low:
            return start
        reach *= 4


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: per at sign the whole run before it and the whole domain after it."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = _run_start(text, _NOT_LOCAL, end, at)
        if start < at:
            domain = _DOMAIN.match(text, at + 1)
            if domain:
                end = domain.end()
                yield start, end
        at = text.find("@", max(at + 1, end))


def _zone_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """IP addresses and cards: both lie within runs of digits, dots, spaces, hyphens and brackets."""
    for zone in _ZONE.finditer(text):
        first, last = zone.span()
        if last - first < 7:
            continue
        for m in _IP.finditer(text, first, last):
            parts = (p.lstrip("0") for p in m.group().split("."))
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                yield "ip", *m.span()
        for m in _CARD.finditer(text, first, last):
            if m.end() - m.start() < 12:
                continue
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the base patterns, by start, then kind."""
    if not text:
        return []
    spans = [("email", a, b) for a, b in _emails(text)]
    spans += _zone_spans(text)
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.findall(m.group())) <= 15:
                spans.append(("phone", *m.span()))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def candidates(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Runs without white space that hold a digit or an at sign and touch no span; punctuation around is left out."""
    taken = sorted((a, b) for _, a, b in spans)
    nth, position = 0, 0
    # How far the spans before the next one reach: spans of two kinds may lie within each other.
    reached = 0
    while True:
        hit = _MARK.search(text, position)
        if hit is None:
            return
        start = _run_start(text, _SPACE, position, hit.start())
        end = _SPACE.search(text, hit.start())
        end = len(text) if end is None else end.start()
        position = end
        while nth < len(taken) and taken[nth][0] < end:
            reached = max(reached, taken[nth][1])
            nth += 1
        if reached > start:
            continue
        word = text[start:end]
        low = len(word) - len(word.lstrip(_EDGE.replace("(", "")))
        word = word[low:].rstrip(_EDGE)
        if word:
            yield start + low, start + low + len(word)


def loose_kinds(value: str) -> int:
    """Kinds whose loose form the whole value has, a bit each."""
    if len(value) > 320:
        return 0
    return sum(1 << i for i, kind in enumerate(KINDS) if _LOOSE[kind].fullmatch(value))


def normal(value: str) -> str:
    """One spelling per instance: lower case, digits and letters and the signs that tell values apart."""
    return re.sub(r"[\s()-]+", "", value.lower())


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a place: ``left2`` two words before it, ``both`` one before and one after.

    Digits in context words are told apart only by their number.
    """
    left = [_word(w) for w in _WORD.findall(text[max(0, start - REACH) : start])[-2:]]
    right = [_word(w) for w in _WORD.findall(text[end : end + REACH])[:1]]
    left = [""] * (2 - len(left)) + left
    out = [f"l {left[0]} {left[1]}"] if left[0] else []
    if left[1] or right:
        out.append(f"b {left[1]} _ {right[0] if right else ''}")
    return out


def _word(word: str) -> str:
    return _DIGITS.sub("0", word.lower())


_SPAN = "struct<kind:string,start:bigint,end:bigint>"
_NODE = "struct<kind:string,start:bigint,end:bigint,loose:int,instance:binary,contexts:array<binary>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_NODES = pa.list_(
    pa.struct(
        [
            ("kind", pa.string()),
            ("start", pa.int64()),
            ("end", pa.int64()),
            ("loose", pa.int32()),
            ("instance", pa.binary()),
            ("contexts", pa.list_(pa.binary())),
        ]
    )
)
# Nodes that one written row holds at most; a text with more gets further rows, without spans.
NODES = 20_000


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=12).digest()


def _nodes(text: str, spans: list[tuple[str, int, int]]) -> Iterator[dict]:
    """Seeds and candidates with the digests of their value and contexts."""
    for kind, start, end in spans:
        yield _node(text, kind, start, end, 1 << KINDS.index(kind))
    for start, end in candidates(text, spans):
        yield _node(text, None, start, end, loose_kinds(text[start:end]))


def _node(text: str, kind: str | None, start: int, end: int, loose: int) -> dict:
    return {
        "kind": kind,
        "start": start,
        "end": end,
        "loose": loose,
        "instance": _digest(normal(text[start:end])),
        "contexts": [_digest(c) for c in contexts(text, start, end)],
    }


def _rows(batch: pa.RecordBatch, places: list[int], spans: list, nodes: list) -> pa.RecordBatch:
    rows = pa.array(places, pa.int64())
    columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(spans, _SPANS), pa.array(nodes, _NODES)]
    return pa.record_batch(columns, ["row", "doc_id", "spans", "nodes"])


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places: list[int] = []
        spans: list = []
        nodes: list = []
        held = 0

        for i, value in enumerate(batch.column(2)):
            text = value.as_py()
            found = base_spans(text)
            listed: list | None = [dict(zip(("kind", "start", "end"), s, strict=True)) for s in found]
            stream = _nodes(text, found) if text else iter(())
            while (part := list(islice(stream, NODES))) or listed is not None:
                places.append(i)
                spans.append(listed)
                nodes.append(part)
                listed = None
                held += len(part)
                if held >= NODES:
                    yield _rows(batch, places, spans, nodes)
                    places, spans, nodes, held = [], [], [], 0
        yield _rows(batch, places, spans, nodes)


def _written(df: DataFrame, name: str) -> DataFrame:
    folder = scratch_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One pass over the texts, written out: row, doc_id, base ``spans`` and graph ``nodes`` (seeds and candidates).

    A row's number is fixed by the written table, so later steps can join on it.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")
    )
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return _written(
        rows.mapInArrow(_scanned, f"row bigint, doc_id {id_type}, spans array<{_SPAN}>, nodes array<{_NODE}>"), "personal"
    )


def edges(scanned: DataFrame) -> DataFrame:
    """The graph: one row per distinct (pattern, instance), with the seed kind of the instance there, if any."""
    nodes = scanned.select(F.explode("nodes").alias("n"))
    pairs = nodes.select("n.instance", "n.kind", "n.loose", F.explode("n.contexts").alias("pattern"))
    return pairs.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.bit_or("loose").alias("loose"))


def _belief(kind: str) -> Column:
    return F.col(f"is_{kind}")


def _admits(kind: str) -> Column:
    return F.col("loose").bitwiseAND(1 << KINDS.index(kind)) > 0


def score(graph: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT) -> DataFrame:
    """Belief per kind for instances that are no seeds and that some pattern speaks for.

    Patterns without enough distinct seeds never speak, so the graph is cut to those that have them before
    the rounds start; their other instances stay in it and count against them.
    """
    seeds = graph.where(F.col("kind").isNotNull()).groupBy("pattern", "kind").count()
    able = seeds.where(F.col("count") >= support).select("pattern").distinct()
    graph = _written(attach(graph, able, ["pattern"], how="inner"), "patterns")
    beliefs = None
    for _ in range(rounds):
        if beliefs is None:
            believed = graph.select("*", *[F.lit(0.0).alias(f"is_{k}") for k in KINDS])
        else:
            believed = attach(graph, beliefs, ["instance"])
        known = F.col("kind").isNotNull()
        held = [
            F.when(known, (F.col("kind") == k).cast("double")).otherwise(F.coalesce(_belief(k), F.lit(0.0))).alias(f"is_{k}")
            for k in KINDS
        ]
        patterns = believed.select("pattern", "kind", *held).groupBy("pattern").agg(*[_confidence(k, support) for k in KINDS])
        told = attach(graph.where(~known), patterns, ["pattern"])
        found = told.groupBy("instance").agg(
            F.bit_or("loose").alias("loose"),
            *[F.sum(F.log(F.greatest(1.0 - F.col(f"sure_{k}"), F.lit(1e-9)))).alias(f"doubt_{k}") for k in KINDS],
        )
        # Rounded, so that the order of additions never decides.
        now = [F.when(_admits(k), F.round(1.0 - F.exp(f"doubt_{k}"), 9)).otherwise(0.0).alias(f"is_{k}") for k in KINDS]
        beliefs = _written(found.select("instance", *now).where(F.greatest(*[_belief(k) for k in KINDS]) > 0), "beliefs")
    return beliefs


def _confidence(kind: str, support: int) -> Column:
    """Share of a pattern's instances believed to be of ``kind``; those of no known kind weigh half."""
    belief = _belief(kind)
    pro = F.sum(belief)
    contra = F.sum((1.0 - belief) * F.when(F.col("kind").isNull(), DOUBT).otherwise(1.0))
    sure = F.round(pro / (pro + contra), 9)
    enough = F.count_if(F.col("kind") == kind) >= support
    return F.when(enough & (sure >= CONFIDENT), sure).otherwise(0.0).alias(f"sure_{kind}")


def found_spans(scanned: DataFrame, beliefs: DataFrame, believed: float = BELIEVED) -> DataFrame:
    """Per row the candidate spans whose instance is believed to be of a kind that its loose form admits."""
    nodes = scanned.select("row", F.explode("nodes").alias("n")).where(F.col("n.kind").isNull() & (F.col("n.loose") > 0))
    places = nodes.select("row", "n.start", "n.end", "n.loose", "n.instance")
    strong = beliefs.where(F.greatest(*[_belief(k) for k in KINDS]) >= believed)
    told = attach(places, strong, ["instance"], how="inner")
    # The kind believed most; the first in order among equals.
    ranked = F.array_min(
        F.array(
            *[
                F.struct(F.when(_admits(k), -_belief(k)).otherwise(0.0).alias("doubt"), F.lit(i).alias("order"), F.lit(k).alias("kind"))
                for i, k in enumerate(KINDS)
            ]
        )
    )
    sure = told.select("row", "start", "end", ranked.alias("best")).where(F.col("best.doubt") <= -believed)
    spans = sure.select("row", F.struct(F.col("best.kind").alias("kind"), "start", "end").alias("span"))
    # No larger than what the row's own text holds.
    return spans.groupBy("row").agg(F.collect_list("span").alias("found"))


def _listed(spans: Column) -> Column:
    """Spans by start, then kind, as kind:start:end."""
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(
        spans, lambda s: F.struct(s["start"], F.array_position(order, s["kind"]).alias("order"), s["end"], s["kind"])
    )
    return F.array_join(
        F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Per row: doc_id, ``base`` spans and spans ``found`` beyond them (arrays of kind, start, end in code points)."""
    scanned = scan(docs, id_col, text_col)
    found = found_spans(scanned, score(edges(scanned), rounds))
    rows = scanned.where(F.col("spans").isNotNull()).select("row", "doc_id", F.col("spans").alias("base")).join(found, "row", "left")
    return rows.select("doc_id", "base", F.coalesce("found", F.array().cast(f"array<{_SPAN}>")).alias("found"))


def _of_kind(kind: str, span: Column) -> Column:
    return span["kind"] == kind


def digest(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""
    counts = [F.size(F.filter("base", partial(_of_kind, k))).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", "found")).alias("spans"),
        F.size("found").cast("bigint").alias("n_found"),
    )
