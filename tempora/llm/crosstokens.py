"""Alignment of two tokenizers over the same bytes.

Both tokenizers cut ``space + text`` into byte ranges. Tasks work on slices of texts in Arrow
tables: id lists are flattened with their parent indices, segmented cumulative sums of the token
sizes give the ends, a hash join on (document, end) links the tokens that end together, and a
group-by counts the linked pairs of the slice. Spark adds up the counts of all slices, and gives
each slice back the totals of its own pairs only.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import byte_column, sliced
from tempora.session import materialize, shared_folder

LOT_BYTES = 1 << 20  # of text a slice; its tables take some hundred bytes a byte
LOTS_A_FILE = 16  # slices a file of the written table, so a reader's batch stays small
ENCODED = 256  # strings a call of a tokenizer
GROUP = 200  # chunks a string

PER_DOCUMENT = ("doc_id array<long>, n_a array<int>, n_b array<int>, n_groups array<int>, n_links array<int>, "
                "groups_sha256 array<string>")
LOTS = f"lot string, {PER_DOCUMENT}, codes array<int>, pairs array<long>, times array<long>"
RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")

_LOADED: dict = {}


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one letter: visible bytes as themselves, the others
    as the letters from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _byte_level(path: str) -> tuple[Callable, list[bytes], bool]:
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    size = tok.get_vocab_size(with_added_tokens=True)
    letters, names = _byte_of_letter(), [tok.id_to_token(i) or "" for i in range(size)]
    own = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in names]
    cuts = getattr(tok.pre_tokenizer, "use_regex", False) and tok.normalizer is None
    return lambda texts: [e.ids for e in tok.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], own, cuts


def _pieces(path: str) -> tuple[Callable, list[bytes], bool]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
           for i in range(sp.get_piece_size())]
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    cuts = all("▁" not in x.lstrip("▁") for x in names) and sp.encode("a  b c") == sp.encode("a") + sp.encode(" b") + sp.encode("c")
    return lambda texts: sp.encode(texts, out_type=int, num_threads=1), own, cuts


def tokenizer(path: str) -> tuple[Callable[[list[str]], list[list[int]]], pa.Array, pa.Array, bool]:
    """(encoder of texts into the ids of ``space + text``, the bytes of each id, each id in decimal
    followed by nothing, comma, bar and semicolon, whether ``chunks`` can be encoded apart).
    ``.model`` files are sentence pieces, which add the space themselves; others are byte-level
    vocabularies."""
    if path not in _LOADED:
        encode, own, cuts = (_pieces if path.endswith(".model") else _byte_level)(path)
        shown = [f"{i}{after}" for after in ("", ",", "|", ";") for i in range(len(own))]
        _LOADED[path] = (encode, pa.array(own, pa.large_binary()), pa.array([x.encode() for x in shown], pa.large_binary()), bool(cuts))
    return _LOADED[path]


# Whether a byte after a space is surely none of white space: visible ASCII, and leads of letters
# beyond it other than those under which white space has its code points.
_SOLID = np.zeros(256, bool)
_SOLID[[*range(0x21, 0x7F), *range(0xC3, 0xE0), *range(0xE4, 0xF5)]] = True


def chunks(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The texts, each after a space, cut before single spaces with something visible behind; and the
    number of chunks before each text. Byte-level splitters start a word there, and sentence
    pieces hold spaces only at their start, so the ids of a text are those of its chunks."""
    buf = b"".join(b" " + t for t in texts)
    raw = np.frombuffer(buf, np.uint8)
    space = raw == 0x20
    cut = np.zeros(len(raw), bool)
    cut[1:-1] = space[1:-1] & ~space[:-2] & _SOLID[raw[2:]]
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    cut[first[:-1]] = True
    at = np.append(np.flatnonzero(cut), len(raw))
    return (pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(buf)]),
            np.searchsorted(at, first))


def _encoded(encode: Callable, texts: list[bytes]) -> pa.Array:
    """A list of ids a text."""
    plain = [t.decode("utf-8", "replace") for t in texts]
    parts = [pa.array(encode(plain[i:i + ENCODED]), pa.large_list(pa.int32())) for i in range(0, len(plain), ENCODED)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.large_list(pa.int32()))


def _grouped(encode: Callable, vocabulary: pa.Array, words: pa.Array) -> pa.Array:
    """A list of ids for each chunk. Chunks that begin with one space before something visible and
    end without a space are encoded side by side in long strings; the bytes of the ids tell
    where each ends."""
    size = pc.binary_length(words).to_numpy()
    at = np.r_[0, np.cumsum(size)]
    raw = np.frombuffer(words.buffers()[2], np.uint8)
    near = _SOLID[raw[np.minimum(at[:-1] + 1, len(raw) - 1)]] & (size > 1) & (raw[at[1:] - 1] != 0x20)
    plain, odd = np.flatnonzero(near), np.flatnonzero(~near)
    chosen = words.take(pa.array(plain)).to_pylist()
    ids = _encoded(encode, [b"".join(chosen[i:i + GROUP])[1:] for i in range(0, len(chosen), GROUP)])
    flat = pc.list_flatten(ids)
    ends = np.cumsum(pc.binary_length(vocabulary.take(flat)).to_numpy())
    last = np.searchsorted(ends, np.cumsum(size[plain]))
    if len(plain) and (len(ends) == 0 or not np.array_equal(ends[np.minimum(last, len(ends) - 1)], np.cumsum(size[plain]))):
        return _encoded(encode, [x[1:] for x in words.to_pylist()])  # some chunk isn't what its ids join to
    together = pa.LargeListArray.from_arrays(pa.array(np.r_[0, last + 1]), flat)
    rest = _encoded(encode, [x[1:] for x in words.take(pa.array(odd)).to_pylist()])
    order = np.empty(len(words), np.int64)
    order[np.r_[plain, odd]] = np.arange(len(words))
    return pa.concat_arrays([together, rest]).take(pa.array(order))


def encoded(texts: list[bytes], *paths: str) -> list[pa.Array]:
    """For each tokenizer a list of ids a text. Each distinct chunk of the texts is encoded once."""
    found = [tokenizer(p) for p in paths]
    if not texts or not all(cuts for _, _, _, cuts in found):
        return [_encoded(encode, texts) for encode, *_ in found]
    each, first = chunks(texts)
    each = each.dictionary_encode()
    out = []
    for encode, vocabulary, *_ in found:
        own = _grouped(encode, vocabulary, each.dictionary).take(each.indices)
        out.append(pa.LargeListArray.from_arrays(pa.array(own.offsets.to_numpy()[first]), pc.list_flatten(own)))
    return out


def _tokens(ids: pa.Array, vocabulary: pa.Array) -> tuple[memoryview, np.ndarray, pa.Table]:
    """The joined bytes of all tokens, where each document's begin and end in them, and a row a token
    with its document, its end in the document's bytes and its id."""
    flat, doc = pc.list_flatten(ids), pc.list_parent_indices(ids)
    taken = vocabulary.take(flat)
    ends = pc.cumulative_sum(pc.binary_length(taken).cast(pa.int64()))
    all_ends = np.r_[0, ends.to_numpy()]
    bounds = all_ends[ids.offsets.to_numpy() - ids.offsets[0].as_py()]
    local = pc.subtract(ends, pa.array(bounds).take(doc))
    joined = memoryview(taken.buffers()[2] or b"").cast("B")[: int(all_ends[-1])]
    return joined, bounds, pa.table({"doc": doc.cast(pa.int64()), "end": local, "id": flat})


def _same(joined: memoryview, bounds: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Whether the joined bytes of each document are those of the space and its text."""
    return np.array([joined[i:j] == b" " + t for i, j, t in zip(bounds, bounds[1:], texts)], bool)


def links(a: pa.Table, b: pa.Table) -> pa.Table:
    """``doc, end, a, b`` for all tokens whose byte ranges end together, in order."""
    found = a.rename_columns(["doc", "end", "a"]).join(b.rename_columns(["doc", "end", "b"]), ["doc", "end"], join_type="inner", use_threads=False)
    return found.sort_by([("doc", "ascending"), ("end", "ascending")])


def _group_texts(a: pa.Table, b: pa.Table, cuts: np.ndarray, docs: int, shown_a: pa.Array, shown_b: pa.Array) -> list[bytes]:
    """For each document its groups as text: ids of A, bar, ids of B, semicolon, and so on. ``cuts``:
    the sorted shared ends as document * 2^40 + end."""
    sides = []
    for t, shown in ((a, shown_a), (b, shown_b)):
        key = (t["doc"].to_numpy() << 40) | t["end"].to_numpy()
        sides.append((t["id"].to_numpy().astype(np.int64), np.searchsorted(cuts, key, "left"), len(shown) // 4))
    (ids_a, at_a, size_a), (ids_b, at_b, size_b) = sides
    n_a, n_b = (np.bincount(at, minlength=len(cuts)) for at in (at_a, at_b))
    start = np.cumsum(n_a + n_b) - n_a - n_b
    place_a = start[at_a] + np.arange(len(ids_a)) - (np.cumsum(n_a) - n_a)[at_a]
    place_b = (start + n_a)[at_b] + np.arange(len(ids_b)) - (np.cumsum(n_b) - n_b)[at_b]
    last_a, last_b = (np.diff(at, append=len(cuts)) != 0 for at in (at_a, at_b))
    doc_b = cuts[at_b] >> 40
    over = np.diff(doc_b, append=docs) != 0
    codes = np.empty(len(ids_a) + len(ids_b), np.int64)
    codes[place_a] = ids_a + size_a * np.where(last_a, 2, 1)
    codes[place_b] = len(shown_a) + ids_b + size_b * np.where(over, 0, np.where(last_b, 3, 1))
    text = pa.concat_arrays([shown_a, shown_b]).take(pa.array(codes)) if len(codes) else pa.array([], pa.large_binary())
    at = np.r_[0, np.cumsum(pc.binary_length(text).to_numpy())]
    ends = np.searchsorted(cuts[np.repeat(np.arange(len(cuts)), n_a + n_b)] >> 40 if len(codes) else codes, np.arange(docs + 1), "left")
    raw = memoryview(text.buffers()[2] or b"").cast("B")
    return [raw[at[i]:at[j]] for i, j in zip(ends, ends[1:])]


def aligned_slice(texts: list[bytes], path_a: str, path_b: str) -> dict[str, list | np.ndarray]:
    """What one slice of texts comes to: per text ``n_a, n_b, n_groups, n_links, groups_sha256``; per
    link its place in ``pairs`` (``codes``); per distinct pair (id of A * 2^32 + id of B) how often
    it is linked (``times``)."""
    (_, bytes_a, shown_a, _), (_, bytes_b, shown_b, _) = tokenizer(path_a), tokenizer(path_b)
    own = []
    for ids, vocabulary in zip(encoded(texts, path_a, path_b), (bytes_a, bytes_b)):
        joined, bounds, table = _tokens(ids, vocabulary)
        own.append((table, _same(joined, bounds, texts)))
    good = own[0][1] & own[1][1] & np.array([bool(t) for t in texts], bool)
    n, kept = len(texts), pa.array(good)
    a, b = (t.filter(kept.take(t["doc"].combine_chunks())) if not good.all() else t for t, _ in own)
    found = links(a, b)
    doc = found["doc"].to_numpy()
    key = (doc << 40) | found["end"].to_numpy()
    cuts = key[np.diff(key, prepend=-1) != 0]
    per = {c: np.bincount(x, minlength=n) for c, x in (("n_a", a["doc"].to_numpy()), ("n_b", b["doc"].to_numpy()),
                                                       ("n_groups", cuts >> 40), ("n_links", doc))}
    shas = [hashlib.sha256(x).hexdigest() if ok else "" for x, ok in zip(_group_texts(a, b, cuts, n, shown_a, shown_b), good)]
    pair = (found["a"].to_numpy().astype(np.int64) << 32) | found["b"].to_numpy()
    counted = pa.table({"pair": pair}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
    pairs, times = counted["pair"].to_numpy(), counted["count_all"].to_numpy()
    order = np.argsort(pairs)
    return per | {"groups_sha256": shas, "codes": np.searchsorted(pairs[order], pair).astype(np.int32), "pairs": pairs[order], "times": times[order]}


def aligned_lots(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One written row a slice of documents, with lists over its documents, links and distinct pairs.
    A slice's name is drawn when it is written, so it is the same wherever the table is read."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(LOTS))

    def run(batches):
        for b in sliced(batches, "t", LOT_BYTES):
            if b.num_rows:
                out = aligned_slice(byte_column(b, "t"), path_a, path_b) | {"lot": uuid.uuid4().hex, "doc_id": b.column(0)}
                yield pa.RecordBatch.from_arrays([pa.array([out[f.name]], f.type) if f.name in ("lot", "groups_sha256") else
                                                  _one_list(out[f.name], f.type) for f in arrow], schema=arrow)

    lots = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, LOTS)
    path = shared_folder(docs.sparkSession, "lots")
    lots.write.option("maxRecordsPerFile", LOTS_A_FILE).parquet(path)
    return docs.sparkSession.read.parquet(path)


def _one_list(values: np.ndarray | pa.Array, kind: pa.DataType) -> pa.Array:
    flat = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat.cast(kind.value_type)).cast(kind)


def pair_counts(lots: DataFrame) -> DataFrame:
    """``pair, count, best``: how many links all slices hold of each id pair, and whether no pair with
    the same id of B has more. Written once."""
    each = lots.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("p.pairs", "p.times")
    counts = materialize(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("count")), "pairs")
    low = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = counts.groupBy(low.alias("b")).agg(F.max("count").alias("most"))
    return materialize(counts.withColumn("b", low).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "counts")


def aligned(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A and B are the files of two public tokenizers on every executor; special tokens' strings are
    plain text. Offsets at which tokens of both end cut them into groups; a link is a pair of
    tokens that end together, its count the number of links of its id pair in all documents;
    ``n_best``: links whose pair no other pair of the same id of B exceeds. Documents whose text
    is null, empty or not what the tokens of A or of B join to have no tokens: zeros and an empty
    digest. A text is handled whole; repeated rows and null ids come out as often as they come
    in; an empty table gives an empty result; further columns are ignored.
    """
    lots = aligned_lots(docs, path_a, path_b, doc_id, text)
    counts = pair_counts(lots)
    own = lots.select("lot", F.posexplode("pairs").alias("at", "pair")).join(counts, "pair")
    totals = own.groupBy("lot").agg(F.array_sort(F.collect_list(F.struct("at", "count", "best"))).alias("t")).select(
        F.col("lot"), F.col("t.count").alias("count"), F.col("t.best").alias("best"))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                col = {name: b.column(k).slice(i, 1) for k, name in enumerate(b.schema.names)}
                flat = {k: pc.list_flatten(v) for k, v in col.items() if pa.types.is_list(v.type)}
                size = flat["n_links"].to_numpy()
                code = flat["codes"].to_numpy()
                count, best = (np.r_[0, np.cumsum(flat[k].cast(pa.int64()).to_numpy()[code])] for k in ("count", "best"))
                end = np.cumsum(size)
                sums = {"count_sum": count[end] - count[end - size], "n_best": best[end] - best[end - size]}
                names = [x.split()[0] for x in RESULT.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(sums[k]) if k in sums else
                                                  flat[k].cast(pa.string() if k == "groups_sha256" else pa.int64()) for k in names], names)

    # slices without a link have no pairs and no totals
    met = lots.drop("pairs", "times").join(totals, "lot", "left").withColumns(
        {"count": F.coalesce("count", F.array().cast("array<long>")), "best": F.coalesce("best", F.array().cast("array<boolean>"))})
    return met.mapInArrow(run, RESULT)
