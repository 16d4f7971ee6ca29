"""Token alignment against a plain restatement, one document at a time."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tempora.llm import crosstokens

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(rows):
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    from tokenizers.decoders import ByteLevel

    tables, docs = Counter(), []
    letters = {v: k for k, v in crosstokens._byte_of_letter().items()}
    assert ByteLevel().decode([letters[b] for b in " é".encode()]) == " é"
    back = {v: k for k, v in letters.items()}
    for i, text in rows:
        ids_a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = sp.encode(text) if text else []
        parts_a = [bytes(back[c] for c in tok.id_to_token(x)) for x in ids_a]
        parts_b = []
        for x in ids_b:
            p = sp.id_to_piece(x)
            parts_b.append(bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode())
        whole = b" " + (text or "").encode()
        if not text or b"".join(parts_a) != whole or b"".join(parts_b) != whole:
            docs.append((i, [], [], []))
            continue
        ends = []
        for parts in (parts_a, parts_b):
            at, own = 0, []
            for p in parts:
                at += len(p)
                own.append(at)
            ends.append(own)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, last = [], 0
        for c in cuts:
            groups.append(([x for x, e in zip(ids_a, ends[0]) if last < e <= c], [x for x, e in zip(ids_b, ends[1]) if last < e <= c]))
            last = c
        pairs = [(a[-1], b[-1]) for a, b in groups]
        tables.update(pairs)
        docs.append((i, ids_a, ids_b, groups))
    best = {}
    for (_, b), n in tables.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for i, ids_a, ids_b, groups in docs:
        pairs = [(a[-1], b[-1]) for a, b in groups]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((i, len(ids_a), len(ids_b), len(groups), len(pairs), sum(tables[p] == best[p[1]] for p in pairs),
                    sum(tables[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def result(df):
    return [tuple(r) for r in crosstokens.aligned(df, A, B).select(COLUMNS).collect()]


ROWS = [(0, "The quick brown fox jumps over the lazy dog."), (1, None), (2, ""), (3, "a  b\t c\n\nd "), (4, "<|endoftext|> and </s> and <s>"),
        (5, "déjà vu — naïve 東京 🙂 " * 20), (6, "x" * 5000), (6, "x" * 5000), (None, "1234567890 antidisestablishmentarianism"), (8, " "), (9, "▁"),
        (10, "ﬁne ½ Å ́ \x00 \x07"), (11, "<0x41> <unk>"), (12, "don't we'll I'M \r\n"), (13, "a" + "​" + "b"), (14, "the the the the")]


def test_rows_equal_a_plain_restatement(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in ROWS], "doc_id long, text string, lot string")
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted(result(df), key=key) == sorted(brute(ROWS), key=key)


def test_counts_are_of_the_whole_table(spark):
    """Many small slices in several tasks come to the same as one."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    rows = [tuple(r) for r in docs.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(result(df)) == sorted(brute(rows))


def test_slices_without_a_link_and_empty_table(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(result(df)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    assert result(df.limit(0)) == []


@pytest.mark.parametrize("text", ["one two three", "¡hola! señor", "tabs\tand\nlines"])
def test_groups_of_one_slice(text):
    out = crosstokens.aligned_slice([text.encode()], A, B)
    assert out["n_links"].sum() == len(out["codes"]) == out["times"].sum()
    assert (out["pairs"][1:] > out["pairs"][:-1]).all()


WORDS = st.sampled_from(["the", "déjà", " ", "  ", "\n", "\t ", " ", " ", "　", "—", "12", "n't", "東京", "🙂", "▁", "<s>", "\x00", "\x1c", "ﬁ", "a", "...", "\r\n", "​"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(WORDS, max_size=12).map(" ".join) | st.text(max_size=30) | st.lists(WORDS, max_size=12).map("".join), min_size=1, max_size=5))
def test_chunks_have_the_ids_of_whole_texts(texts):
    raw = [t.encode("utf-8", "replace") for t in texts]
    for path, got in zip((A, B), crosstokens.encoded(raw, A, B)):
        encode, *_ = crosstokens.tokenizer(path)
        for t, ids in zip(raw, got.to_pylist()):
            if t and "▁".encode() not in t:  # such texts have no tokens
                assert ids == list(encode([t.decode()])[0])
