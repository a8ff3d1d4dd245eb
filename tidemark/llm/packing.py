"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

Documents (or dialogues) are encoded, split where they exceed a sequence, and what remains of each is placed by the
dot-product heuristic: an open sequence takes the piece whose demand vector has the largest dot product with what the
sequence has left, both in shares of the limits, among those that fit. A gap that nothing fills is closed with the head of another piece.
Each task packs the rows of its own partition in bounded windows, so there is no shuffle; what is left over at the
end of a partition goes into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import TOKENIZER, encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 128
    loss: int = 1024
    #: A gap of fewer tokens is left as padding.
    gap: int = 8
    #: Pieces that the heuristic chooses from at a time.
    window: int = 2048


class Packer:
    """Places pieces (document, start, length, loss tokens). `emit` gets (sequence, offset, piece) for each placed piece."""

    def __init__(self, limits: Limits, emit):
        self.limits, self.emit, self.sequence, self.items = limits, emit, 0, []

    def add(self, doc, loss: np.ndarray) -> None:
        """loss: prefix sums of the document's loss-bearing tokens, beginning with 0."""
        n, at = len(loss) - 1, 0
        while n - at >= self.limits.tokens and loss[at + self.limits.tokens] - loss[at] <= self.limits.loss:
            self._close([(doc, at, self.limits.tokens, loss)])
            at += self.limits.tokens
        while at < n:
            end = min(n, at + self.limits.tokens, int(np.searchsorted(loss, loss[at] + self.limits.loss, "right")) - 1)
            self.items.append((doc, at, end - at, loss))
            at = end
        if len(self.items) >= 2 * self.limits.window:
            self.pack(self.limits.window)

    def pack(self, leave: int) -> None:
        """Fill sequences until at most `leave` pieces are left, or those no longer fill one."""
        lim = self.limits
        cap = np.array([lim.tokens, lim.segments, lim.loss], float)
        demand = np.array([(n, 1, loss[at + n] - loss[at]) for _, at, n, loss in self.items], float).reshape(-1, 3)
        alive = np.ones(len(demand), bool)
        left = int(alive.sum())
        total = demand[:, 0].sum()
        while left > leave and (leave or total >= lim.tokens):
            free, placed = cap.copy(), []
            while True:
                fits = np.flatnonzero(alive & (demand <= free).all(axis=1))
                if not len(fits):
                    break
                best = fits[np.argmax(demand[fits] / cap @ (free / cap))]
                placed.append(self.items[best])
                free -= demand[best]
                total -= demand[best, 0]
                alive[best] = False
                left -= 1
                if free[0] < 1 or free[1] < 1:
                    break
            if free[0] >= lim.gap and free[1] >= 1 and free[2] >= 1 and left:
                best = int(np.argmax(np.where(alive, demand[:, 0], -1)))
                doc, at, n, loss = self.items[best]
                cut = min(n - 1, int(free[0]), int(np.searchsorted(loss, loss[at] + free[2], "right")) - 1 - at)
                if cut > 0:
                    placed.append((doc, at, cut, loss))
                    self.items[best] = (doc, at + cut, n - cut, loss)
                    demand[best] = (n - cut, 1, loss[at + n] - loss[at + cut])
                    total -= cut
            self._close(placed)
        self.items = [x for x, a in zip(self.items, alive, strict=True) if a]

    def finish(self) -> None:
        """What is left goes into sequences whose lengths are powers of two."""
        self.pack(0)
        lim, rest = self.limits, [list(x) for x in self.items]
        while rest:
            fit, segments, loss_sum = 0, 0, 0
            for doc, at, n, loss in rest[: lim.segments]:
                room = int(np.searchsorted(loss, loss[at] + lim.loss - loss_sum, "right")) - 1 - at
                take = min(n, lim.tokens - fit, room)
                fit, segments, loss_sum = fit + take, segments + 1, loss_sum + int(loss[at + take] - loss[at])
                if take < n:
                    break
            size, placed = 1 << (max(fit, 1).bit_length() - 1), []
            while size:
                doc, at, n, loss = rest[0]
                take = min(n, size)
                placed.append((doc, at, take, loss))
                size -= take
                rest[0][1:3] = [at + take, n - take]
                if take == n:
                    rest.pop(0)
            self._close(placed)
        self.items = []

    def _close(self, placed: list) -> None:
        offset = 0
        for piece in placed:
            self.emit(self.sequence, offset, piece)
            offset += piece[2]
        self.sequence += 1


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None, tokenizer: str = TOKENIZER, end_id: int = 0, limits: Limits = Limits(), keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each placed piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens, and the whole numbers `keep` of its document.

    A document's ids are those of its text (null: empty) and then end_id; every id lies in exactly one piece. loss_col,
    if given, is the number of leading characters that bear no loss (a prompt; null: 0); otherwise every token bears loss.
    Repeated and null ids are packed as rows of their own. sequence_id is the partition's number times 2**32 plus a count.
    """
    prompt = F.coalesce(F.col(loss_col).cast("long"), F.lit(0)) if loss_col else F.lit(0).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), prompt.alias("prompt"), *(F.col(c).cast("long").alias(c) for c in keep))
    schema = ", ".join([SCHEMA, *(f"{c} long" for c in keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        base = TaskContext.get().partitionId() << 32
        out: list[tuple] = []

        def emit(sequence: int, offset: int, piece: tuple) -> None:
            (doc_id, ids, kept), at, n, loss = piece
            out.append((doc_id, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids), base + sequence, offset, int(loss[at + n] - loss[at]), *kept))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [()] * (8 + len(keep))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[f.split()[0] for f in schema.split(", ")])

        packer = Packer(limits, emit)
        for b in batches:
            kept = list(zip(*(b.column(3 + i).to_pylist() for i in range(len(keep))), strict=True)) if keep else [()] * b.num_rows
            for doc_id, text, prompt, own in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), kept, strict=True):
                text = text.as_py()
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                bears = np.arange(len(ids) + 1, dtype=np.int64)
                if prompt > 0:
                    bears = np.maximum(bears - len(encode(text[:prompt])), 0)
                packer.add((doc_id, ids, own), bears)
            if len(out) >= 4096:
                yield flush()
        packer.finish()
        yield flush()

    return rows.mapInArrow(run, schema)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens; every token bears loss, as in pretraining.

    Null and empty texts are the end id alone. Repeated rows, repeated and null ids are packed as rows of their own; an empty
    table gives none; other columns aren't read; long texts are cut, whole, into pieces.
    """
    from .common import documents

    return pack(documents(spark, sf_dir))


#: Limits for dialogues: about four fifths of a sequence's tokens may bear loss, and at most three answers share one.
DIALOGUES = Limits(tokens=1024, segments=3, loss=800)


def answers(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, text, prompt): every assistant's turn after the turn before it, which bears no loss.

    Turns are joined by (conversation, turn), so a very long conversation is spread like many short ones. Of rows with the same
    conversation and turn one counts, that with the greatest text and then role, so no turn is met twice. A turn without one
    before it has no prompt; null texts are empty; rows without a conversation or turn stand for themselves, without a prompt.
    """
    rows = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("x"))
    named = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    last = rows.filter(named).groupBy("conv_id", "turn").agg(F.max(F.struct("x", "r")).alias("s")).select("conv_id", "turn", "s.r", "s.x")
    before = last.select("conv_id", (F.col("turn") + 1).alias("turn"), F.concat("x", F.lit("\n")).alias("b"))
    both = last.filter("r = 'assistant'").join(before, ["conv_id", "turn"], "left")
    alone = rows.filter(~named & (F.col("r") == "assistant")).withColumn("b", F.lit(None).cast("string"))
    asked = F.coalesce("b", F.lit(""))
    return both.unionByName(alone).select("conv_id", "turn", F.concat(asked, F.col("x")).alias("text"), F.length(asked).cast("long").alias("prompt"))


def pack_dialogues(spark, sf_dir: str) -> DataFrame:
    """Answers of all conversations under the limits on tokens, segments and loss-bearing tokens at once.

    A piece is named by its conversation and turn. Null and empty answers are the end id alone; an empty table gives no rows; long
    answers are cut, whole, into pieces; other columns aren't read.
    """
    rows = answers(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return pack(rows, id_col="conv_id", loss_col="prompt", limits=DIALOGUES, keep=("turn",)).withColumnRenamed("doc_id", "conv_id")
