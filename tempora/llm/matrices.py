"""Packed token-id matrices by best-fit decreasing.

Documents are cut losslessly at multiples of the window. Pieces are placed longest first, each in
the open sequence with the least room that still holds it. A segment tree over the amounts of
room finds that sequence; equal pieces and sequences with equal room are placed in one step.

Texts are dealt into groups of bounded bytes and each group is packed by its own task, so the
work is one shuffle of the texts and nothing passes through the driver but their total size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm import tokens
from tempora.llm.common import byte_column, sliced

WINDOW = 2048
END_ID = 2
GROUP_BYTES = 16 << 20  # of text packed together by one task
ROWS_A_BATCH = 1024

SCHEMA = ("sequence_id long, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, "
          "starts array<long>")


class Rooms:
    """Segment tree over 0..size: which amounts of room have an open sequence."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.some = [False] * (2 * self.leaves)

    def put(self, room: int, there: bool) -> None:
        i = room + self.leaves
        self.some[i] = there
        while i > 1:
            i //= 2
            self.some[i] = self.some[2 * i] or self.some[2 * i + 1]

    def least(self, room: int) -> int | None:
        """The least amount of at least ``room`` with an open sequence."""
        i = room + self.leaves
        if not self.some[i]:
            while i > 1 and (i & 1 or not self.some[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.some[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple]:
    """Plan rows (see ``windows``) of best-fit decreasing for a histogram of lengths.

    Equal pieces that go to sequences with equal room fill one of these after another: once a
    sequence has taken a piece, it has less room than the others, so it is the best fit for the
    next piece until none fits.
    """
    rooms, open_, plan, used = Rooms(window), {}, [], 0

    def add(room: int, at: int, n: int) -> None:
        if n and room:
            open_.setdefault(room, []).append((at, n))
            rooms.put(room, True)

    for x in sorted(counts, reverse=True):
        first, left = 0, counts[x]
        while left:
            room = rooms.least(x)
            if room is None:
                room, at, n = window, used, -(-left // (window // x))
                used += n
            else:
                at, n = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.put(room, False)
            each = room // x
            take = min(left, n * each)
            plan.append((x, first, take, each, at, window - room))
            whole, rest = divmod(take, each)
            add(room - each * x, at, whole)
            if rest:
                add(room - rest * x, at + whole, 1)
            add(room, at + whole + bool(rest), n - whole - bool(rest))
            first += take
            left -= take
    return plan


def placed(lengths: np.ndarray, plan: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece: the pieces of a length take the plan's places in turn."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(lengths, kind="stable")
    low = {int(x): i for x, i in zip(*np.unique(lengths[order], return_index=True))}
    for x, first, number, each, at, where in plan:
        rows = order[low[x] + first: low[x] + first + number]
        step = np.arange(number)
        sequence[rows] = at + step // each
        offset[rows] = where + step % each * x
    return sequence, offset


def packed_matrices(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, pad_id: int = 0,
                    doc_id: str = "doc_id", text: str = "text", dtype: str = "<u2",
                    special_as_text: bool = False) -> DataFrame:
    """One row a sequence of a matrix of width ``window``.

    ``sequence_id``; ``input_ids``: ``window`` ids in ``dtype``, padded with ``pad_id``;
    ``position_ids``: 32-bit positions that start again at 0 with each piece and with the
    padding; ``cu_seqlens``: cumulative piece lengths from 0; ``doc_ids`` and ``starts``: the
    document of each piece and the ids of it that come before.

    Overlong documents are cut, no id is lost. A null or empty text is the end id alone; repeated
    rows and null ids are packed like any other; an empty table gives an empty result; further
    columns are ignored. The tokenizer is a local file on every executor.
    """
    kind = np.dtype(dtype)
    end = np.array([end_id], "<u4").tobytes()
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    schema = pa.schema(list(zip(names, types)))

    def pieces(batches):
        for b in sliced(batches, "t", tokens.TEXT_BYTES):
            doc, at = b.column(0).to_pylist(), 0
            for part in tokens.batches(byte_column(b, "t")):
                for body in tokens.encoder(tokenizer, special_as_text)(part):
                    ids = np.frombuffer(body + end, "<u4")
                    if int(ids.max()) > np.iinfo(kind).max:
                        raise ValueError(f"ids beyond {dtype}")
                    for s in range(0, len(ids), window):
                        yield doc[at], s, ids[s:s + window].astype(kind)
                    at += 1

    def run(batches):
        found = list(pieces(batches))
        lengths = np.array([len(x[2]) for x in found], np.int64)
        counts = {int(x): int(n) for x, n in zip(*np.unique(lengths, return_counts=True))}
        sequence, offset = placed(lengths, best_fit_plan(counts, window))
        order = np.lexsort((offset, sequence))
        cuts = np.flatnonzero(np.diff(sequence[order], prepend=-1, append=-1)) if len(order) else np.zeros(1, np.int64)
        base = TaskContext.get().partitionId() << 32
        cols: list[list] = [[] for _ in schema]
        for i, j in zip(cuts[:-1], cuts[1:]):
            own = [found[k] for k in order[i:j]]
            n = sum(len(x[2]) for x in own)
            rest = window - n
            at = np.concatenate([*[np.arange(len(x[2])) for x in own], np.arange(rest)]).astype("<u4")
            row = np.concatenate([*[x[2] for x in own], np.full(rest, pad_id, kind)])
            cu = np.cumsum([0] + [len(x[2]) for x in own]).astype(np.int32)
            for col, v in zip(cols, (base + int(sequence[order[i]]), row.tobytes(), at.tobytes(), cu,
                                     [x[0] for x in own], [x[1] for x in own])):
                col.append(v)
            if len(cols[0]) == ROWS_A_BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
                cols = [[] for _ in schema]
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"))
    size = texts.agg(F.sum(F.octet_length("t")), F.count("*")).first()
    groups = 1 + max((size[0] or 0) // GROUP_BYTES, size[1] // 100_000)
    return texts.repartition(groups).mapInArrow(run, SCHEMA)


def write_matrices(packed: DataFrame, path: str) -> None:
    """Writes packed rows as Parquet files under ``path``, a folder that all executors share."""
    packed.write.mode("errorifexists").parquet(path)
