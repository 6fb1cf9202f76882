"""Best-fit-decreasing packing of token ids into fixed-length rows.

Items are placed longest first, each into the open row with the least room that still holds it. The
rows' rooms are the leaves of a segment tree, so that row is found in log2(length) steps. Texts longer
than a row are cut into full rows and a rest, losslessly; nothing else is cut.

Tasks pack the rows of their own split in pools of bounded size. Nothing is shuffled.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import tokens

#: Items and tokens of a pool: bounds a task's memory.
POOL_ITEMS, POOL_TOKENS = 65_536, 1 << 22

ROW_SCHEMA = (
    "sequence_id long, n_tokens int, input_ids binary, cu_seqlens array<int>,"
    " position_resets array<int>, doc_ids array<long>, doc_starts array<long>"
)


class RoomTree:
    """A segment tree over rooms 0..length; a node tells how many open rows lie below it."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the row with the least room of at least ``need``; it is taken out."""
        node, count = need + self.leaves, self.count
        if not count[node]:
            # up until a right neighbour has rows, then down to its leftmost
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not count[node]:
                    node += 1
        room = node - self.leaves
        row = self.rows[room].pop()
        self._change(room, -1)
        return room, row


def best_fit_decreasing(lengths: list[int], length: int) -> list[list[int]]:
    """Rows of item indices; every item is at most ``length`` long. Equal lengths keep their order."""
    tree, rows = RoomTree(length), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if found := tree.take(lengths[i]):
            room, row = found
            rows[row].append(i)
        else:
            room, row = length, len(rows)
            rows.append([i])
        if room > lengths[i]:
            tree.put(room - lengths[i], row)
    return rows


def pack_best_fit(
    rows: DataFrame, *, length: int = 2048, pad_id: int = 0, end_id: int = 2, tokenizer: str | None = None
) -> DataFrame:
    """Pack ``rows`` (doc_id, text) into a matrix of ids, a row per sequence.

    ``input_ids`` has ``length`` little-endian uint32 ids, ``pad_id`` after the first ``n_tokens``;
    ``cu_seqlens`` the cumulative segment lengths from 0; ``position_resets`` the offsets at which
    positions restart; ``doc_ids`` and ``doc_starts`` where each segment comes from. A text's ids are
    followed by ``end_id``; a NULL or empty text is that id alone. NULL doc_ids stay NULL, repeated rows
    are packed each, other columns are ignored, an empty table gives no rows.
    """
    path = tokenizer or tokens.default_path()
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 33
        memo = tokens.chunk_ids(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        pad = np.array([pad_id], dtype="<u4").tobytes()
        pool: list[tuple[int | None, int, bytes]] = []
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, waiting
            packed = best_fit_decreasing([len(x[2]) // 4 for x in pool], length)
            for at in range(0, len(packed), 1024):
                out: list[list] = [[] for _ in range(7)]
                for row in packed[at : at + 1024]:
                    parts = [pool[i] for i in row]
                    ends = np.cumsum([0] + [len(p[2]) // 4 for p in parts]).tolist()
                    ids = b"".join([p[2] for p in parts])
                    values = (
                        sequence, ends[-1], ids + pad * (length - ends[-1]), ends, ends[:-1],
                        [p[0] for p in parts], [p[1] for p in parts],
                    )
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                    sequence += 1
                kinds = [
                    pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()),
                    pa.list_(pa.int64()), pa.list_(pa.int64()),
                ]
                names = [x.split()[0] for x in ROW_SCHEMA.split(",")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)
            pool.clear()
            waiting = 0

        for batch in batches:
            for doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                ids = tokens.encode(memo, text) + end
                for start in range(0, len(ids), 4 * length):
                    part = ids[start : start + 4 * length]
                    pool.append((doc_id, start // 4, part))
                    waiting += len(part) // 4
                if len(pool) >= POOL_ITEMS or waiting >= POOL_TOKENS:
                    yield from flush()
        if pool:
            yield from flush()

    return rows.mapInArrow(run, ROW_SCHEMA)


def _files(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_matrices(rows: DataFrame, path: str) -> None:
    """Write the rows of ``pack_best_fit`` below ``path``, a folder that all executors share.

    Each task writes a matrix of little-endian uint32 ids, row after row (``.ids``), and beside it, row after row, little-endian int64
    numbers (``.seg``): sequence_id, n_tokens, the number of segments s, s + 1 cumulative lengths from 0, s doc_ids, s doc_starts and
    a bit mask (as one number a segment) of NULL doc_ids. Positions restart at the cumulative lengths but the last. Files carry a
    name of their own for every attempt; ``manifest.json`` names those of the attempts that Spark counted, with rows and
    checksums, and is written last, under another name first. So a failed, repeated or speculative task leaves files that
    no manifest names, and a folder without a manifest is no result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        files, folder = _files(path)
        name, n, width, ids_crc, seg_crc = f"part-{uuid.uuid4().hex}", 0, 0, 0, 0
        ids_out = seg_out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if ids_out is None:
                files.create_dir(folder, recursive=True)
                ids_out, seg_out = (files.open_output_stream(f"{folder}/{name}.{kind}") for kind in ("ids", "seg"))
            for r in batch.to_pylist():
                ids, width = r["input_ids"], len(r["input_ids"]) // 4
                told = [r["sequence_id"], r["n_tokens"], len(r["doc_ids"]), *r["cu_seqlens"]]
                told += [0 if d is None else d for d in r["doc_ids"]] + r["doc_starts"] + [int(d is None) for d in r["doc_ids"]]
                seg = np.array(told, dtype="<i8").tobytes()
                ids_out.write(ids)
                seg_out.write(seg)
                ids_crc, seg_crc, n = zlib.crc32(ids, ids_crc), zlib.crc32(seg, seg_crc), n + 1
        if ids_out is not None:
            ids_out.close()
            seg_out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, n, width, ids_crc, seg_crc)], ["name", "n", "width", "ids_crc", "seg_crc"])

    parts = [r.asDict() for r in rows.mapInArrow(run, "name string, n long, width long, ids_crc long, seg_crc long").collect()]  # a row a task
    files, folder = _files(path)
    files.create_dir(folder, recursive=True)
    with files.open_output_stream(f"{folder}/.manifest") as out:
        out.write(json.dumps({"parts": sorted(parts, key=lambda p: p["name"]), "whole": True}).encode())
    files.move(f"{folder}/.manifest", f"{folder}/manifest.json")


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``write_matrices``, each file checked against the manifest; a task reads a file in blocks of rows."""
    files, folder = _files(path)
    with files.open_input_stream(f"{folder}/manifest.json") as f:
        parts = json.loads(f.read())["parts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = _files(path)
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = [x.split()[0] for x in ROW_SCHEMA.split(",")]
        for batch in batches:
            for p in batch.to_pylist():
                ids_crc = seg_crc = 0
                with files.open_input_stream(f"{folder}/{p['name']}.ids") as ids, files.open_input_stream(f"{folder}/{p['name']}.seg") as seg:
                    for at in range(0, p["n"], 1024):
                        out: list[list] = [[] for _ in range(7)]
                        for _ in range(min(1024, p["n"] - at)):
                            row, head = ids.read(4 * p["width"]), seg.read(24)
                            sequence, n, s = np.frombuffer(head, dtype="<i8").tolist()
                            rest = seg.read(8 * (4 * s + 1))
                            ids_crc, seg_crc = zlib.crc32(row, ids_crc), zlib.crc32(rest, zlib.crc32(head, seg_crc))
                            told = np.frombuffer(rest, dtype="<i8").tolist()
                            ends, docs, starts, nulls = told[: s + 1], told[s + 1 : 2 * s + 1], told[2 * s + 1 : 3 * s + 1], told[3 * s + 1 :]
                            docs = [None if gone else d for d, gone in zip(docs, nulls, strict=True)]
                            for column, value in zip(out, (sequence, n, row, ends, ends[:-1], docs, starts), strict=True):
                                column.append(value)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)
                if (ids_crc, seg_crc) != (p["ids_crc"], p["seg_crc"]):
                    raise ValueError(f"{p['name']} is not what was written")

    schema = "name string, n long, width long, ids_crc long, seg_crc long"
    listed = spark.createDataFrame([tuple(p.values()) for p in parts], schema).repartition(max(1, len(parts)))
    return listed.mapInArrow(run, ROW_SCHEMA)
