"""Token ids of whole texts by a public tokenizer file."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TEXT_BYTES = 4 << 20  # of text encoded together: the more, the fewer words are encoded again
GROUP = 500  # words encoded as one string
GATHERED = 1 << 18  # words whose ids are put in place at once

# A Latin letter before ASCII punctuation other than the apostrophe, where every word splitter cuts.
_CUT = r"([a-z\x{df}-\x{f6}\x{f8}-\x{ff}])([!-&(-/:-@\[-`{-~])"
# Lower-case Latin words, which normalisers leave alone and splitters keep whole.
_PLAIN = r"^[a-z\x{df}-\x{f6}\x{f8}-\x{ff}]+$"
_ENCODERS: dict = {}


def encoder(path: str, special_as_text: bool = False) -> Callable[[list[bytes]], list[bytes]]:
    """UTF-8 texts -> their ids as little-endian unsigned 32-bit integers.

    The ids are those of ``encode(text, add_special_tokens=False)``. If the tokenizer splits at
    white space, drops it, takes letters as lower case and marks the ends of words, a text's ids
    are those of its words, one after another: each distinct word of the texts is encoded once,
    many to a call, and its ids are put wherever it stands. Texts in which a special token may
    stand, and all texts with other tokenizers, are encoded whole.
    """
    key = (path, special_as_text)
    if key not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[key] = _encoder(path, special_as_text)
    return _ENCODERS[key]


def _encoder(path: str, special_as_text: bool) -> Callable[[list[bytes]], list[bytes]]:
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = special_as_text

    def encoded(t: Tokenizer, texts: list[str], most: int) -> Iterator[np.ndarray]:
        """Ids of each text; the library's own objects exist for ``most`` texts at a time."""
        for i in range(0, len(texts), most):
            for e in t.encode_batch_fast(texts[i:i + most], add_special_tokens=False):
                yield np.array(e.ids, np.uint32)

    def whole(texts: list[str]) -> list[np.ndarray]:
        return list(encoded(tok, texts, 2000))

    one, two, both, upper, spaced = [list(x) for x in whole(["one", "two!", "one two!", "ONE", " one\n\t"])]
    mark = getattr(tok.model, "end_of_word_suffix", None)
    if both != one + two or upper != one or spaced != one or not mark:
        return lambda texts: [x.astype("<u4").tobytes() for x in whole([t.decode() for t in texts])]

    # the same model for plain words: no normaliser, cut at spaces only
    plain = Tokenizer.from_file(path)
    plain.normalizer = normalizers.Sequence([])
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"),
                                                   pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    ends = np.zeros(tok.get_vocab_size(with_added_tokens=True), bool)
    for token, i in tok.get_vocab(with_added_tokens=False).items():
        ends[i] = token.endswith(mark)

    def plain_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has."""
        groups = [" ".join(words[i:i + GROUP]) for i in range(0, len(words), GROUP)]
        ids = np.concatenate([np.zeros(0, np.uint32), *encoded(plain, groups, 20)])
        return ids, np.diff(np.flatnonzero(ends[ids]), prepend=-1)

    def words_ids(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words, where each word's begin, and how many there are."""
        simple = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False)
        first, other = np.flatnonzero(simple), np.flatnonzero(~simple)
        ids, n = plain_words(words.take(pa.array(first)).to_pylist())
        rest = whole(words.take(pa.array(other)).to_pylist())
        size = np.zeros(len(words), np.int64)
        if len(n) != len(first):
            raise ValueError(f"{path}: words without an end")
        size[first], size[other] = n, [len(x) for x in rest]
        order = np.r_[first, other]
        at = np.zeros(len(words), np.int64)
        at[order] = np.cumsum(size[order]) - size[order]
        return np.concatenate([ids, *rest]), at, size

    def encode(texts: list[bytes]) -> list[bytes]:
        special = [i for i, t in enumerate(texts) if b"<|" in t]
        own = dict(zip(special, whole([texts[i].decode() for i in special])))
        low = pa.array([b"" if i in own else t.lower() for i, t in enumerate(texts)], pa.large_string())
        runs = pc.ascii_split_whitespace(pc.replace_substring_regex(low, _CUT, r"\1 \2"))
        coded = runs.flatten().dictionary_encode()
        code, cuts = coded.indices.to_numpy(), runs.offsets.to_numpy()
        ids, at, size = words_ids(coded.dictionary)
        out: list[bytes] = []
        while len(out) < len(texts):
            i = len(out)
            j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + GATHERED, "right")) - 1)
            part = code[cuts[i]:cuts[j]]
            end = np.r_[0, np.cumsum(size[part])]
            found = ids[np.repeat(at[part] - end[:-1], size[part]) + np.arange(end[-1])].astype("<u4")
            bounds = end[cuts[i:j + 1] - cuts[i]]
            out += [found[a:b].tobytes() if k not in own else own[k].astype("<u4").tobytes()
                    for k, a, b in zip(range(i, j), bounds, bounds[1:])]
        return out

    return encode


def batches(texts: list[bytes], most: int = TEXT_BYTES) -> Iterator[list[bytes]]:
    """Slices of at most ``most`` bytes (or one text)."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield texts[at:]
