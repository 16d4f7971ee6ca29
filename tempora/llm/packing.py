"""Packing by minimum bin slack.

A document's ids are cut every ``window`` ids; whole windows stand alone. The remainders are
packed by their lengths: for each window a subset-sum over the remaining lengths, kept as the
bits of one integer, finds the fill closest to the capacity; walking back through the saved bit
sets tells which lengths, and how many of each, make it up. The same choice is then repeated
while there are enough remainders of those lengths.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm import tokens
from tempora.llm.common import byte_column, map_batches
from tempora.llm.windows import placed
from tempora.session import materialize

WINDOW = 4096
END_ID = 2


def best_fill(counts: dict[int, int], lengths: list[int], capacity: int) -> dict[int, int]:
    """Lengths and numbers whose sum is closest to the capacity, from below.

    ``lengths``: the candidates, longest first, all at least 1. Each takes part up to as often as
    it is there, in groups of 1, 2, 4, ... pieces; the search ends at an exact fill.
    """
    full = 1 << capacity
    mask = (full << 1) - 1
    reach, steps = 1, []
    for x in lengths:
        left = min(counts[x], capacity // x)
        group = 1
        while left > 0 and not reach & full:
            n = min(group, left)
            steps.append((x, n, reach))
            reach |= reach << (x * n) & mask
            left -= n
            group *= 2
        if reach & full:
            break
    at, used = reach.bit_length() - 1, {}
    for x, n, before in reversed(steps):
        if not before >> at & 1:
            used[x] = used.get(x, 0) + n
            at -= x * n
    return used


def minimum_slack_plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple]:
    """Plan rows (see ``windows``) for the histogram ``counts`` of lengths up to ``window``."""
    left = {x: n for x, n in counts.items() if n}
    first = dict.fromkeys(left, 0)
    order = sorted(left, reverse=True)
    plan, sequence = [], 0
    while order:
        lead = order[0]
        left[lead] -= 1
        used = best_fill(left, [x for x in order if left[x]], window - lead) if lead < window else {}
        left[lead] += 1
        used[lead] = used.get(lead, 0) + 1
        repeat = min(left[x] // n for x, n in used.items())
        offset = 0
        for x, n in used.items():
            plan.append((x, first[x], n * repeat, n, sequence, offset))
            first[x] += n * repeat
            left[x] -= n * repeat
            offset += n * x
        sequence += repeat
        order = [x for x in order if left[x]]
    return plan


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, doc_id: str = "doc_id",
           text: str = "text", special_as_text: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens``: each document's ids, with the end id, cut
    at multiples of the window. The tokenizer is a local file on every executor."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(b: pa.RecordBatch) -> dict:
        ids = b.column(0).to_pylist()
        out: list[list] = [[], [], [], [], []]
        at = 0
        for part in tokens.batches(byte_column(b, "t")):
            for body in tokens.encoder(tokenizer, special_as_text)(part):
                body += end
                n = len(body) // 4
                for s in range(0, n, window):
                    x = body[s * 4:(s + window) * 4]
                    for col, v in zip(out, (ids[at], s, len(x) // 4, zlib.crc32(x), n)):
                        col.append(v)
                at += 1
        return dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens"), out))

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")), cut,
                       "doc_id long, start long, length long, ids_crc32 long, doc_tokens long", tokens.TEXT_BYTES)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, doc_id: str = "doc_id",
         text: str = "text", special_as_text: bool = False) -> DataFrame:
    """One row a piece: the columns of ``pieces`` with ``sequence_id`` (from 0) and ``offset``.

    Every id of every document lies in one piece; the pieces of a sequence lie side by side from
    0 and never beyond the window. A null or empty text is the end id alone; a long one becomes
    several pieces; repeated rows and null ids are packed like any other; an empty table gives an
    empty result; further columns are ignored.
    """
    cut = materialize(pieces(docs, tokenizer, window, end_id, doc_id, text, special_as_text), "pieces")
    return placed(cut, lambda c: minimum_slack_plan(c, window), ["doc_id", "start", "ids_crc32", "doc_tokens"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
