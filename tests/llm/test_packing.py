"""Packing: exact round trips of every id, plans against brute force, edge cases."""

import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tempora.llm import matrices as M
from tempora.llm import packing as P
from tempora.llm.queries import REGISTRY, tokenizer

SF = "/root/testdata/sf0.001"


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


def spread(plan, counts):
    """Pieces (length, sequence, offset) of a plan; checks that every rank is placed once."""
    seen = {x: [] for x in counts}
    out = []
    for x, first, number, each, sequence, offset in plan:
        for i in range(number):
            seen[x].append(first + i)
            out.append((x, sequence + i // each, offset + i % each * x))
    assert {x: sorted(v) for x, v in seen.items()} == {x: list(range(n)) for x, n in counts.items()}
    return out


def whole(pieces, window):
    by = {}
    for x, s, o in pieces:
        by.setdefault(s, []).append((o, x))
    assert sorted(by) == list(range(len(by)))
    fills = []
    for own in by.values():
        at = 0
        for o, x in sorted(own):
            assert o == at
            at += x
        assert at <= window
        fills.append(at)
    return fills


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 9), max_size=8))
def test_both_plans_place_every_piece(counts):
    n = sum(x * c for x, c in counts.items())
    assert sum(whole(spread(P.minimum_slack_plan(counts, 24), counts), 24)) == n
    assert sum(whole(spread(M.best_fit_plan(counts, 24), counts), 24)) == n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 15), min_size=1, max_size=8), st.integers(1, 40))
def test_fill_is_the_closest(items, capacity):
    counts = {x: items.count(x) for x in set(items)}
    used = P.best_fill(counts, sorted((x for x in counts), reverse=True), capacity)
    best = max(s for n in range(len(items) + 1) for c in itertools.combinations(items, n) if (s := sum(c)) <= capacity)
    assert sum(x * n for x, n in used.items()) == best and all(n <= counts[x] for x, n in used.items())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=40))
def test_best_fit_decreasing_equals_one_by_one(items):
    room = []
    for x in sorted(items, reverse=True):
        fit = min((i for i, r in enumerate(room) if r >= x), key=lambda i: room[i], default=None)
        if fit is None:
            room.append(20)
            fit = len(room) - 1
        room[fit] -= x
    fills = whole(spread(M.best_fit_plan({x: items.count(x) for x in set(items)}, 20), {x: items.count(x) for x in set(items)}), 20)
    assert sorted(20 - r for r in room) == sorted(fills)


def test_query_keeps_every_id(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = dict(zip(docs, ids_of(docs.values())))
    rows = REGISTRY["op5_min_slack_packing"](spark, SF).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc.keys() == want.keys()
    for d, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            x = np.array(want[d][at:at + r.length], "<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(want[d]), zlib.crc32(x))
            at += r.length
        assert at == len(want[d])
    fills = whole([(x, s, o) for s, own in by_seq.items() for o, x in own], 4096)
    assert sum(4096 - f for f in fills) < 4096 * 1.5


def test_matrix_query_keeps_every_id(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = dict(zip(docs, ids_of(docs.values())))
    got = {}
    for r in REGISTRY["op8_best_fit_matrices"](spark, SF).collect():
        ids, cu = np.frombuffer(r.input_ids, "<u2"), r.cu_seqlens
        assert len(ids) == 2048 and cu[0] == 0 and len(cu) == len(r.doc_id) + 1 and (ids[cu[-1]:] == 0).all()
        at = np.concatenate([np.arange(b - a) for a, b in zip(cu, [*cu[1:], 2048])]).astype("<u4")
        assert r.positions_crc32 == zlib.crc32(at.tobytes())
        for d, s, a, b in zip(r.doc_id, r.starts, cu, cu[1:]):
            got.setdefault(d, []).append((s, list(ids[a:b])))
    assert {d: [x for _, p in sorted(own) for x in p] for d, own in got.items()} == want


EDGE = [(1, None, 5), (2, "", 5), (3, "  \t", 5), (4, "It's <|endoftext|> a TEST\x1cx", 5), (4, "It's <|endoftext|> a TEST\x1cx", 5),
        (None, "Éa é ÇA\u0085b", 5), (6, "word " * 9000, 5), (7, "x" * 30000, 5)]


def test_edge_cases(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string, length long")
    rows = P.pack(df, tokenizer()).collect()
    want = ids_of([t for _, t, _ in EDGE])
    assert sorted(r.doc_tokens for r in rows if r.start == 0) == sorted(map(len, want))
    assert sum(r.length for r in rows) == sum(map(len, want)) and len(rows) > len(EDGE)
    whole([(r.length, r.sequence_id, r.offset) for r in rows], 4096)
    crcs = {(r.doc_id, r.start): r.ids_crc32 for r in rows}
    for (d, _, _), x in zip(EDGE, want):
        assert crcs[d, 0] == zlib.crc32(np.array(x[:4096], "<u4").tobytes())
    m = M.packed_matrices(df, tokenizer()).collect()
    assert sum(r.cu_seqlens[-1] for r in m) == sum(map(len, want))
    assert P.pack(df.limit(0), tokenizer()).count() == 0 and M.packed_matrices(df.limit(0), tokenizer()).count() == 0


def test_written_matrices_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b c"), (2, "d e")], "doc_id long, text string")
    M.write_matrices(M.packed_matrices(df, tokenizer(), window=16), str(tmp_path / "m"))
    got = spark.read.parquet(str(tmp_path / "m")).collect()
    assert [len(r.input_ids) for r in got] == [32] * len(got) and sum(len(r.doc_ids) for r in got) == 2


def test_common_length_is_ranked_in_shards(spark, monkeypatch):
    from tempora.llm import windows as W

    monkeypatch.setattr(W, "RANKED_TOGETHER", 10)
    df = spark.range(200).selectExpr("id as doc_id", "if(id % 3 = 0, 5, id % 7 + 1) as length")
    rows = W.placed(df, lambda c: P.minimum_slack_plan(c, 16), ["doc_id"]).collect()
    assert len(rows) == 200
    whole([(r.length, r.sequence_id, r.offset) for r in rows], 16)


def test_encoder_equals_the_library():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from tempora.llm.tokens import encoder

    texts = ["It's THE end, isn't it? x='s y're!'ll", "Élève ÉLÈVE, schön×schön÷ ß. ſ", "áb é, ≠ x̸!", "“quoted”, ‘x’… 1,000.50 v2.0b",
             "<|endoftext|> <|ENDOFTEXT|>, x<|startoftext|>", "foo<|endoftext|>", "a b c\u0085d\x1ce", "pass=ab12-cd_ef!!! %%% |", "日本語、テスト。 한국어",
             "İstanbul ΣΑΣ, ΑΣ", "", " \n"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        for special in (False, True):
            t = Tokenizer.from_file(P.path(name))
            t.encode_special_tokens = special
            got = encoder(P.path(name), special)([x.encode() for x in texts])
            assert [list(np.frombuffer(x, "<u4")) for x in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]
