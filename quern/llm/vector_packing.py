"""Vector bin packing of tokenised rows into training sequences (dot-product heuristic).

A sequence has three limits at once: tokens, segments (pieces) and loss-bearing tokens. Of the
waiting items that fit, the next one placed is that with the largest dot product between what it needs
and what the open sequence has left (each as a share of its limit). When nothing fits whole, the item
with the largest need is cut to fill the sequence; its rest waits on.

Sequences are closed full or at a power of two, so nothing is padded: a sequence that hits another
limit first, or a task's last one, is cut back to a power of two and the rest packed again.

Every task packs the rows of its own input split, in pools of bounded size, and nothing is shuffled;
a task run again makes the same pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.ranking import running_counts, same_keys
from . import tokens
from .common import staged

#: A pool is packed when it holds so many items or tokens: bounds a task's memory.
POOL_ITEMS, POOL_TOKENS = 2048, 1 << 20
#: Bytes of ids that ``pack_conversations`` gathers before it hands them on, and the rows it unpacks at once.
HAND_ON, AT_ONCE = 4_000_000, 256

PIECE_FIELDS = ["doc_id", "start", "length", "ids", "loss_tokens", "doc_tokens", "sequence_id", "offset"]


@dataclass(slots=True)
class Item:
    """A document's ids from ``start`` on; ``loss`` is a cumulative count of loss-bearing tokens."""

    doc_id: object
    ids: np.ndarray
    loss: np.ndarray | None
    total: int
    start: int = 0

    @property
    def length(self) -> int:
        return len(self.ids) - self.start

    def loss_of(self, n: int) -> int:
        """Loss-bearing tokens among the next ``n``."""
        return n if self.loss is None else int(self.loss[self.start + n] - self.loss[self.start])

    def fitting(self, room: int, loss_room: int) -> int:
        """How many of the next tokens fit into both limits."""
        n = min(room, self.length)
        if self.loss is None:
            return min(n, loss_room)
        most = int(np.searchsorted(self.loss, self.loss[self.start] + loss_room, side="right")) - 1
        return min(n, most - self.start)


@dataclass
class Packer:
    """Packs a stream of items; ``sequences`` yields lists of (item, start, length)."""

    max_tokens: int
    max_segments: int
    max_loss: int
    #: Never cut an item that fits into an empty sequence; sequences then end where nothing more fits.
    whole: bool = False
    pool: list[Item] = field(default_factory=list)
    tokens: int = 0

    def add(self, item: Item) -> Iterator[list[tuple[Item, int, int]]]:
        while item.length >= self.max_tokens and item.fitting(self.max_tokens, self.max_loss) == self.max_tokens:
            yield [(item, item.start, self.max_tokens)]
            item = Item(item.doc_id, item.ids, item.loss, item.total, item.start + self.max_tokens)
        while self.whole and item.length and (n := item.fitting(self.max_tokens, self.max_loss)) < item.length:
            # what is longer than a sequence is cut before it meets others
            self._wait(Item(item.doc_id, item.ids[: item.start + n], item.loss, item.total, item.start))
            item = Item(item.doc_id, item.ids, item.loss, item.total, item.start + n)
        if item.length:
            self._wait(item)
        if len(self.pool) >= POOL_ITEMS or self.tokens >= POOL_TOKENS:
            yield from self.pack(keep=min(self.tokens // 8, 8 * self.max_tokens))

    def _wait(self, item: Item) -> None:
        self.pool.append(item)
        self.tokens += item.length

    def pack(self, keep: int = 0) -> Iterator[list[tuple[Item, int, int]]]:
        """Pack until at most ``keep`` tokens wait."""
        while self.tokens > keep:
            pool = self.pool
            need = np.array([i.length for i in pool], dtype=np.int64)
            loss = np.array([i.loss_of(i.length) for i in pool], dtype=np.int64)
            alive = np.ones(len(pool), dtype=bool)
            while self.tokens > keep and alive.any():
                placed = self._one(pool, need, loss, alive)
                n = sum(x[2] for x in placed)
                if n < self.max_tokens and not self.whole:
                    placed = self._cut_back(placed, n, pool)
                    need = np.concatenate([need, [i.length for i in pool[len(need) :]]])
                    loss = np.concatenate([loss, [i.loss_of(i.length) for i in pool[len(loss) :]]])
                    alive = np.concatenate([alive, np.ones(len(pool) - len(alive), dtype=bool)])
                self.tokens -= sum(x[2] for x in placed)
                yield placed
            self.pool = [i for i, a in zip(pool, alive, strict=True) if a]

    def _one(self, pool, need, loss, alive) -> list[tuple[Item, int, int]]:
        """Fill one sequence from the pool."""
        placed: list[tuple[Item, int, int]] = []
        room, slots, loss_room = self.max_tokens, self.max_segments, self.max_loss
        while room and slots and alive.any():
            fits = alive & (need <= room) & (loss <= loss_room)
            score = (
                (need / self.max_tokens) * (room / self.max_tokens)
                + (1 / self.max_segments) * (slots / self.max_segments)
                + (loss / self.max_loss) * (loss_room / self.max_loss)
            )
            if fits.any():
                k = int(np.argmax(np.where(fits, score, -1.0)))
                n = int(need[k])
                alive[k] = False
            elif self.whole:
                break
            else:
                k = int(np.argmax(np.where(alive, score, -1.0)))
                n = pool[k].fitting(room, loss_room)
                if n == 0:
                    break
            item = pool[k]
            placed.append((item, item.start, n))
            room, slots, loss_room = room - n, slots - 1, loss_room - item.loss_of(n)
            if alive[k]:
                pool[k] = rest = Item(item.doc_id, item.ids, item.loss, item.total, item.start + n)
                need[k], loss[k] = rest.length, rest.loss_of(rest.length)
        return placed

    @staticmethod
    def _cut_back(placed, n: int, pool: list[Item]) -> list[tuple[Item, int, int]]:
        """Cut a sequence of n tokens to a power of two; what is cut off waits again."""
        over = n - (1 << (n.bit_length() - 1))
        while over:
            item, start, length = placed.pop()
            k = min(over, length)
            pool.append(Item(item.doc_id, item.ids[: start + length], item.loss, item.total, start + length - k))
            if length > k:
                placed.append((item, start, length - k))
            over -= k
        return placed


def pack_vectors(
    rows: DataFrame,
    *,
    max_tokens: int = 4096,
    max_segments: int = 256,
    max_loss: int | None = None,
    tokenizer: str | None = None,
    end_id: int = 2,
) -> DataFrame:
    """Pack ``rows`` (doc_id, text and optionally loss_from) into sequences; a row per piece. doc_id may have any type.

    Ids are the text's (``tokenizer``, no special tokens) and then ``end_id``. ``loss_from`` (int) is the
    number of leading tokens that bear no loss, as a prompt's; without it every token bears loss.
    Output: doc_id, start, length, ids (little-endian uint32), loss_tokens, doc_tokens, sequence_id,
    offset. A NULL or empty text is the end id alone; a NULL doc_id stays NULL; repeated rows are packed
    each; other columns are ignored. Over an empty table the result is empty.

    ``max_loss`` is ``max_tokens`` if it isn't given. Limits below one are an error.
    """
    path = tokenizer or tokens.default_path()
    limit = max_tokens if max_loss is None else max_loss
    if min(max_tokens, max_segments, limit) < 1:
        raise ValueError("each limit of a sequence must be at least 1")
    masked = "loss_from" in rows.columns
    rows = rows.select(
        "doc_id",
        "text",
        (F.col("loss_from").cast("int") if masked else F.lit(None).cast("int")).alias("loss_from"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        memo = tokens.chunk_ids(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        packer = Packer(max_tokens, max_segments, limit)
        out, size, k, key = [], 0, 0, None

        def emit(sequences):
            nonlocal size, k
            for placed in sequences:
                offset = 0
                for item, start, length in placed:
                    part = item.ids[start : start + length].tobytes()
                    bearing = length if item.loss is None else int(item.loss[start + length] - item.loss[start])
                    out.append((item, start, length, part, bearing, base + k, offset))
                    offset += length
                    size += len(part)
                k += 1
                if size > 8_000_000:
                    yield flush()

        def flush() -> pa.RecordBatch:
            nonlocal size
            columns = list(zip(*[(i.doc_id, s, n, p, b, i.total, q, o) for i, s, n, p, b, q, o in out], strict=True))
            out.clear()
            size = 0
            kinds = [key, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], PIECE_FIELDS)

        for batch in batches:
            key = batch.schema.field(0).type
            for doc_id, text, first in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids = np.frombuffer(tokens.encode(memo, text) + end, dtype="<u4")
                loss = None
                if first is not None:
                    loss = np.maximum(np.arange(len(ids) + 1) - max(first, 0), 0)
                yield from emit(packer.add(Item(doc_id, ids, loss, len(ids))))
        yield from emit(packer.pack())
        if out:
            yield flush()

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids binary, loss_tokens long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(run, schema)


def conversation_parts(turns: DataFrame, max_tokens: int, tokenizer: str | None, end_id: int, bearing: str) -> DataFrame:
    """conv_id, segment, part, turn, ids, bears of every turn, staged: turns of one (conv_id, segment, part) are one item.

    A conversation of up to ``max_tokens`` is one segment. A longer one is cut between turns, where a turn starts behind a
    multiple of ``max_tokens``; turns that share a number are dealt over parts, if they are more than a sequence holds. So no
    task has to hold a whole conversation: where turns start comes from running counts. Turns are dealt by a number that each
    row got when it was staged, so copies of one turn don't meet in one part.
    """
    path = tokenizer or tokens.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        memo = tokens.chunk_ids(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids: list[bytes] = []
            done = size = 0
            for i, text in enumerate(batch.column(0), 1):
                ids.append(tokens.encode(memo, text.as_py()) + end)
                size += len(ids[-1])
                if size > HAND_ON or i == batch.num_rows:
                    rest = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(range(row, row + len(ids)), pa.int64())]
                    yield pa.RecordBatch.from_arrays([*batch.slice(done, len(ids)).columns[1:], *rest], ["conv_id", "turn", "bears", "ids", "n", "row"])
                    done, size, row = i, 0, row + len(ids)
                    ids.clear()

    bears = F.coalesce(F.col("role") == bearing, F.lit(False))
    own = turns.select("text", F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1).cast("long")).alias("turn"), bears.alias("bears"))
    rows = staged(own.mapInArrow(run, "conv_id long, turn long, bears boolean, ids binary, n long, row long"), "turns")
    starts = running_counts(rows, ["conv_id"], "turn", {"n": F.sum("n")}).select("conv_id", "turn", (F.col("upto_n") - F.col("n")).alias("before"), F.col("n").alias("tied"), "all_n")
    r, s = rows.alias("r"), starts.alias("s")
    met = r.join(s, same_keys("r", "s", ["conv_id", "turn"])).select("r.*", "before", "tied", "all_n")
    segment = F.when(F.col("all_n") <= max_tokens, 0).otherwise(F.floor(F.col("before") / max_tokens))
    # without a conversation every turn is its own
    part = F.when(F.col("conv_id").isNull(), F.col("row")).otherwise(
        F.when(F.col("tied") > max_tokens, F.pmod(F.xxhash64("ids", "row"), F.ceil(F.col("tied") / max_tokens))).otherwise(0)
    )
    return met.select("conv_id", segment.cast("long").alias("segment"), part.cast("long").alias("part"), "turn", "ids", "bears")


def pack_conversations(
    turns: DataFrame, *, max_tokens: int = 4096, max_segments: int = 256, max_loss: int | None = None, tokenizer: str | None = None, end_id: int = 2, bearing: str = "assistant"
) -> DataFrame:
    """Pack whole conversations (conv_id, turn, role, text) into sequences; a row per piece.

    A conversation's turns, in order and each followed by ``end_id``, are one item, so that an answer stands behind what it
    answers; only the turns of role ``bearing`` bear loss. An item that fits into a sequence by itself is never
    cut; a longer conversation is cut (see ``conversation_parts``), and so is an item with more loss than a sequence may bear.
    Output: conv_id, turn (the item's first), start, length, ids, loss_tokens, item_tokens, sequence_id, offset.
    Sequences are not padded to a length: they end where nothing more fits.

    A NULL text is the end id alone, a NULL role bears no loss, NULL turns come first; turns with one number are ordered by their
    ids. Turns without a conv_id are items of their own. Other columns are ignored; an empty table gives no rows.

    A task holds a pool, one item of less than two sequences and a turn, and what it hands on: its memory depends on the
    longest turn, not on the rows, nor on a conversation's length or on how often a turn is repeated in it.
    """
    limit = max_tokens if max_loss is None else max_loss
    if min(max_tokens, max_segments, limit) < 1:
        raise ValueError("each limit of a sequence must be at least 1")
    rows = conversation_parts(turns, max_tokens, tokenizer, end_id, bearing)
    by = ["conv_id", "segment", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens.forget()  # the turns are ids by now
        base, k, size = TaskContext.get().partitionId() << 33, 0, 0
        packer = Packer(max_tokens, max_segments, limit, whole=True)
        out: list[tuple] = []

        def emit(sequences) -> Iterator[pa.RecordBatch]:
            nonlocal k, size
            for placed in sequences:
                offset = 0
                for item, start, length in placed:
                    bears = int(item.loss[start + length] - item.loss[start])
                    out.append((*item.doc_id, start, length, item.ids[start : start + length].tobytes(), bears, item.total, base + k, offset))
                    offset += length
                k += 1
                size += 4 * offset
                if size > HAND_ON:
                    yield table()

        def table() -> pa.RecordBatch:
            nonlocal size
            kinds = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 4
            arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            out.clear()
            size = 0
            return pa.RecordBatch.from_arrays(arrays, ["conv_id", "turn", "start", "length", "ids", "loss_tokens", "item_tokens", "sequence_id", "offset"])

        now, held, n = None, [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal n
            if held:
                ids = np.concatenate([x for _, x, _ in held])
                marks = np.concatenate([np.full(len(x), b, dtype=np.int64) for _, x, b in held])
                loss = np.concatenate([[0], np.cumsum(marks)])
                first = held[0][0]
                held.clear()
                n = 0
                yield from emit(packer.add(Item((now[0], first), ids, loss, len(ids))))

        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                for conv, segment, part, turn, ids, bears in zip(*(c.to_pylist() for c in batch.slice(at, AT_ONCE).columns), strict=True):
                    # only turns that share a number can be more than two sequences
                    if (conv, segment, part) != now or n >= 2 * max_tokens:
                        yield from close()
                        now = (conv, segment, part)
                    held.append((turn, np.frombuffer(ids, dtype="<u4"), int(bears)))
                    n += len(ids) // 4
        yield from close()
        yield from emit(packer.pack())
        if out:
            yield table()

    schema = "conv_id long, turn long, start long, length long, ids binary, loss_tokens long, item_tokens long, sequence_id long, offset long"
    return rows.repartition(*by).sortWithinPartitions(*by, "turn", "ids").mapInArrow(run, schema)
