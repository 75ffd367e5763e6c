"""Chat formatting by event-sourced reconstruction.

A log holds events of conversations: a turn opens with a role, text streams in as deltas,
an edit replaces what a turn holds, a regeneration discards the turn's text and
everything after the turn. Events are partitioned by conversation and sorted by sequence;
the fold of a turn starts at its last edit or regeneration. An event is dead if a later
regeneration, of its turn or one before, discards it; that is a running minimum from the
end of the log. What is left is sorted by turn and streams through one pass
that holds a single turn in memory, however long its conversation is.

The template writes ``<|turn|>role<|text|>content<|end|>`` and a line break per turn.
Texts and roles may hold control strings, the template's own or those of other
known templates; inside each a backslash is put behind its first character. Control
strings that already hold backslashes there get one more, so unescaping is exact.
The loss mask covers the contents of assistant turns.

Defined cases: NULL text and NULL role are empty; NULL sequence sorts first, ties by
kind, turn, role and text; a turn whose opening is missing has the empty role; repeated
conversation rows are turns of their own; an empty table gives an empty result. Extra columns are
ignored. A conversation of which nothing is left has no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template's control strings, and those of other public chat templates.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL_STRINGS = (
    TURN,
    TEXT,
    END,
    "<|im_start|>",
    "<|im_end|>",
    "<|endoftext|>",
    "<s>",
    "</s>",
    "[INST]",
    "[/INST]",
    "<<SYS>>",
    "<</SYS>>",
)
OPEN, DELTA, EDIT, REGENERATE = "open", "delta", "edit", "regenerate"
TRAINED_ROLE = "assistant"

_RESERVED = "|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in CONTROL_STRINGS)
_ESCAPE = re.compile(_RESERVED)
_UNESCAPE = re.compile(_RESERVED.replace(r"\\*", r"\\+"))
_TURN = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}\n", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][0] + m[0][2:], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and the bounds of the loss mask in it (equal if the turn is not trained on)."""
    head = f"{TURN}{escape(role)}{TEXT}"
    body = escape(text)
    stop = len(head) + (len(body) if role == TRAINED_ROLE else 0)
    return f"{head}{body}{END}\n", len(head), stop


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of formatted text."""
    out, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return out


def events_of(conversations: DataFrame) -> DataFrame:
    """A log that ends in these conversations, as a chat would have written it.

    Each row opens a turn. By hash, a quarter of the turns delivers a draft that an edit replaces, a quarter a draft
    and an answer to it that a regeneration discards; all others deliver their text in two deltas.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turn = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    rows = conversations.select("conv_id", turn.alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("way", F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)))
    half = F.floor(F.length("text") / 2).cast("int")
    draft = F.concat(F.lit("draft: "), F.substring(F.col("text"), F.lit(1), half))

    def event(place: int, kind: str, text: Column, later: int = 0) -> Column:
        return F.struct((F.col("turn") * 10 + place).alias("seq"), (F.col("turn") + later).alias("turn"), F.lit(kind).alias("kind"), text.alias("text"))

    opened = event(0, OPEN, F.col("role"))
    halves = [event(6, DELTA, F.substring(F.col("text"), F.lit(1), half)), event(7, DELTA, F.substring(F.col("text"), half + 1, F.length("text")))]
    edited = [event(1, DELTA, draft), event(2, EDIT, F.col("text"))]
    answer = [event(2, OPEN, F.lit("user"), 1), event(3, DELTA, F.lit("say it again"), 1)]
    again = [event(1, DELTA, draft), *answer, event(4, REGENERATE, F.lit("")), *halves]
    parts = F.when(F.col("way") == 0, F.array(opened, *edited)).when(F.col("way") == 1, F.array(opened, *again)).otherwise(F.array(opened, *halves))
    return rows.select("conv_id", F.inline(parts)).select("conv_id", "seq", "turn", "kind", "text")


def live(events: DataFrame) -> DataFrame:
    """Events no later regeneration discards."""
    later = Window.partitionBy("conv_id").orderBy(F.col("seq").desc_nulls_last(), F.col("kind").desc(), F.col("turn").desc(), F.col("text").desc())
    regenerated = F.when(F.col("kind") == REGENERATE, F.col("turn"))
    cut = F.min(regenerated).over(later.rowsBetween(Window.unboundedPreceding, -1))
    # The turn's own opening survives its regeneration; its text and all later turns do not.
    gone = (F.col("turn") > F.col("cut")) | ((F.col("turn") == F.col("cut")) & (F.col("kind") != OPEN))
    return events.withColumn("cut", cut).filter(~F.coalesce(gone, F.lit(False))).drop("cut")


def folded(rows: Iterator[tuple]) -> Iterator[tuple[object, int, str, str]]:
    """(conversation, turn, role, text) from live events sorted by conversation, turn and sequence."""
    key, role, parts = None, "", []
    for conv, turn, kind, text in rows:
        if key is not None and key != (conv, turn):
            yield (*key, role, "".join(parts))
        if key != (conv, turn):
            key, role, parts = (conv, turn), "", []
        text = text or ""
        if kind == OPEN:
            role = text
        elif kind == DELTA:
            parts.append(text)
        elif kind == EDIT:
            parts = [text]
        elif kind == REGENERATE:
            parts = []
    if key is not None:
        yield (*key, role, "".join(parts))


def _sorted(events: DataFrame) -> DataFrame:
    kept = live(events.select("conv_id", "seq", "turn", "kind", "text"))
    order = ["conv_id", "turn", F.col("seq").asc_nulls_first(), "kind", "text"]
    return kept.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "turn", "kind", "text")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "kind", "text")))


def format_turns(events: DataFrame, batch: int = 256) -> DataFrame:
    """conv_id, turn, formatted, loss_start, loss_end: one row per turn, bounds in characters of the row.

    The formatted conversation is its rows' texts by turn; rows are kept apart so
    that no conversation must fit one record.
    """
    ordered = _sorted(events)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for conv, turn, role, text in folded(_rows(batches)):
            held.append((conv, turn, *render(role, text)))
            if len(held) == batch:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    def _batch(held: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*held))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "turn", "formatted", "loss_start", "loss_end"])

    return ordered.mapInArrow(run, "conv_id bigint, turn bigint, formatted string, loss_start bigint, loss_end bigint")


class Digest:
    """What is read back from one formatted conversation, turn after turn."""

    def __init__(self, conv: object) -> None:
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int, stop: int) -> None:
        for role, text in parse(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        trained = unescape(formatted[start:stop])
        self.loss_chars += len(trained)
        self.loss.update(trained.encode("utf-8", "surrogatepass"))
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, parsed from formatted turns.

    Streams through sorted partitions; a conversation costs two running hashes.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: Digest | None = None
        for batch in batches:
            done: list[tuple] = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))
            for conv, text, start, stop in zip(*columns):
                if current is None or current.conv != conv:
                    if current is not None:
                        done.append(current.row())
                    current = Digest(conv)
                current.add(text, start, stop)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(current.row()), kinds)], names)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return ordered.mapInArrow(run, schema)


def probe(conversations: DataFrame, said: str) -> DataFrame:
    """The conversations and one more, -1, whose two turns say a control string of another template."""
    extra = conversations.sparkSession.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, TRAINED_ROLE, said)], "conv_id bigint, turn bigint, role string, text string"
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
