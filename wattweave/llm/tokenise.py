"""Whole texts to token ids with a public tokenizer file, in Arrow batches.

The tokenizer splits texts at white space before anything else, and runs of
letters from punctuation, so the ids of a word don't depend on its neighbours.
Arrow splits the texts of a batch at ASCII white space, numbers the distinct
words and cuts each into letters and the punctuation that follows; only distinct
runs of letters are looked up. A worker keeps the ids of the runs it has met and
asks the tokenizer for new ones together; a table that is full takes no more,
which bounds memory and changes no result. A word that isn't plain Latin letters
with punctuation behind goes to the tokenizer as it stands.
"""

from __future__ import annotations

import string

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer, pre_tokenizers

TOKENIZER = "word_bpe_49k.json"
#: Runs of letters, and other words, held by a worker at most.
RUNS, WORDS = 200_000, 20_000
#: Letters whose lower case is one letter and that NFC leaves alone.
LATIN = "a-zA-ZÀ-ÖØ-öø-įı-ňŊ-ž"
_RUN = f"^[{LATIN}]*$"
_PLAIN = regex.compile(rf"[{LATIN}\x21-\x7e]+")
_MARKS = string.punctuation
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_TOGETHER = 200


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as itself where it prints, else as the next letter from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in plain)}


class Words:
    """The ids of words, by one tokenizer file."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.runs: dict[str, bytes] = {"": b""}
        self.others: dict[str, bytes] = {"": b""}
        probe = ["It's", "Él", "3x-ñ?!", "der", "Ä,", "don't_"]
        self.split_at_space = (
            getattr(self.tokenizer.model, "end_of_word_suffix", None) == "</w>"
            and b"".join(map(self.other, probe)) == self.whole(" ".join(probe))
        )

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, runs: list[str]) -> dict[str, bytes]:
        """Ids of lower-case pieces, many in one call: a piece ends with the token that ends a word."""
        byte = [r if r.isascii() else "".join(map(self.letters.__getitem__, r.encode())) for r in runs]
        lines = [" ".join(byte[i : i + _TOGETHER]) for i in range(0, len(byte), _TOGETHER)]
        ids = np.array([i for e in self.bare.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids], dtype="<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(runs):
            raise ValueError("a piece has no token that ends it")
        raw, cuts = ids.tobytes(), (4 * np.concatenate([[0], ends])).tolist()
        return {r: raw[a:b] for r, a, b in zip(runs, cuts, cuts[1:], strict=False)}

    def run_ids(self, runs: list[str]) -> list[bytes]:
        new = [r for r in runs if r not in self.runs]
        got = self._learn(new) if new else {}
        if len(self.runs) < RUNS:
            self.runs.update(got)
            return [self.runs[r] for r in runs]
        return [self.runs.get(r) or got.get(r, b"") for r in runs]

    def other(self, word: str) -> bytes:
        out = self.others.get(word)
        if out is None:
            if _PLAIN.fullmatch(word) and not any(s in word for s in self.specials):
                out = b"".join(self.run_ids(_PIECES.findall(word.lower())))
            else:
                out = self.whole(word)
            if len(self.others) < WORDS:
                self.others[word] = out
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string array (no nulls) in one row, and the bounds of each text's; equal to
        ``encode(text, add_special_tokens=False)`` of each."""
        if not self.split_at_space:
            each = [self.whole(t) for t in texts.to_pylist()]
            return np.frombuffer(b"".join(each), dtype="<u4"), np.cumsum([0, *(len(x) // 4 for x in each)])
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        core = pc.utf8_rtrim(words, _MARKS)
        simple = pc.match_substring_regex(core, _RUN).to_numpy(zero_copy_only=False)
        rest = pc.if_else(simple, pc.utf8_lower(core), "").dictionary_encode()
        # What follows the letters, or the whole of a word that isn't simple.
        tail = pc.if_else(simple, _suffix(words, core), words).dictionary_encode()
        table = self.run_ids(rest.dictionary.to_pylist())
        n_runs = len(table)
        table += map(self.other, tail.dictionary.to_pylist())
        sizes = np.fromiter(map(len, table), dtype=np.int64, count=len(table)) // 4
        known = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.frombuffer(b"".join(table), dtype="<u4"))
        )
        at = coded.indices.to_numpy()
        both = np.empty(2 * len(at), dtype=np.int32)
        both[0::2] = rest.indices.to_numpy()[at]
        both[1::2] = tail.indices.to_numpy()[at] + n_runs
        ids = known.take(pa.array(both)).flatten().to_numpy()
        upto = np.concatenate([[0], np.cumsum(sizes[both])])[::2]
        cuts = split.offsets.to_numpy().astype(np.int64)
        return ids, upto[cuts - cuts[0]]


def _suffix(words: pa.Array, core: pa.Array) -> pa.Array:
    """What rtrim took off: single bytes, so the bytes from the core's end on."""
    begin = pc.binary_length(core).to_numpy(zero_copy_only=False).astype(np.int64)
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) - begin
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)
    starts = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words)].astype(np.int64) + begin
    upto = np.concatenate([[0], np.cumsum(size)])
    pick = np.repeat(starts - upto[:-1], size) + np.arange(upto[-1])
    return pa.Array.from_buffers(pa.string(), len(words), [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(data[pick])])


_HELD: dict[str, Words] = {}


def words(path: str | None = None) -> Words:
    """The worker's table for a tokenizer file (a path, or the name of an installed file)."""
    path = path or public_tokenizers.path(TOKENIZER)
    if path not in _HELD:
        _HELD[path] = Words(path)
    return _HELD[path]
