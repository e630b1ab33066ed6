"""Token ids of whole texts, with the ids of a word computed once per task.

The vocabulary works word by word: white space ends every piece and is dropped. So a text is cut at the six
ASCII spaces, and a word that was seen before is looked up. A full store keeps the words that came up again.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from faultline.llm.common import SLICE_BYTES, ragged, split_words

END_ID = 1
LONG = 200


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file, as this machine knows it."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: How the public word vocabulary normalizes and splits.
WORD_RULES = [
    {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
]
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_PUNCTUATION = b".,;:!?"
_ENCODERS: dict[str, WordEncoder] = {}


def _only_letters(word: bytes) -> bool:
    """Letters beyond ASCII that stay letters in lower case, already composed, without context-dependent case."""
    text = word.decode("utf-8", "replace")
    return text.isalpha() and text.lower().isalpha() and "\u03a3" not in text and unicodedata.is_normalized("NFC", text)


def encoder(path: str) -> WordEncoder:
    """The encoder of this process for a vocabulary; tasks that follow each other in a process share its words."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class WordEncoder:
    """``path``: a file of the tokenizers library, or its name among the public ones (found on each machine).

    Where the file splits words as ``WORD_RULES`` says, a run of letters is one piece and punctuation after it another.
    Letters are then encoded many words at a time, joined by spaces; where the ids do not show as many word ends as there
    are words, and for all other words, each is encoded by itself.
    """

    def __init__(self, path: str, limit: int = 350_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path if "/" in path else vocabulary(path))
        rules = json.loads(self.tokenizer.to_str())
        self.plain = None
        if [rules["normalizer"], rules["pre_tokenizer"]] == WORD_RULES and rules["model"]["end_of_word_suffix"]:
            rules["normalizer"] = None
            rules["pre_tokenizer"]["pretokenizers"][0] = {"type": "WhitespaceSplit"}
            self.plain = Tokenizer.from_str(json.dumps(rules))
            self.ends_word = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
            suffix = rules["model"]["end_of_word_suffix"]
            self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 12, np.int64)
        self.again = np.zeros(1 << 12, bool)
        self.size = 0

    def _shrink(self) -> None:
        """Keep the words that came up again since the last time; none, if these are most."""
        words, keep, pool, ends = list(self.index), np.flatnonzero(self.again[:self.size]), self.pool, self.ends
        self._clear()
        if len(keep) <= self.limit * 2 // 3:
            lengths = ends[keep + 1] - ends[keep]
            self._add([words[i] for i in keep.tolist()], pool[ragged(ends[keep], lengths)], lengths)

    def _add(self, words: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        start, used = int(self.ends[self.size]), self.size
        if start + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool) + len(ids), np.uint32)])
        if used + len(words) + 1 > len(self.ends):
            more = len(self.ends) + len(words)
            self.ends, self.again = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.ends, self.again))
        self.pool[start:start + len(ids)] = ids
        self.ends[used + 1:used + 1 + len(words)] = start + np.cumsum(lengths)
        self.size += len(words)
        self.index.update(zip(words, range(used, self.size)))

    def _each(self, words: list[bytes]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(
            [w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
        self._add(words, np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64))

    def _letters(self, words: list[bytes]) -> None:
        joined = [b" ".join(words[i:i + 100]).decode().lower() for i in range(0, len(words), 100)]
        ids = np.array([i for e in self.plain.encode_batch_fast(joined, add_special_tokens=False) for i in e.ids], np.uint32)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            self._each(words)
        else:
            self._add(words, ids, np.diff(ends, prepend=0))

    def _learn(self, words: list[bytes]) -> None:
        index, stems, other, split = self.index, set(), [], []
        for w in words:
            stem = w.rstrip(_PUNCTUATION)
            if self.plain and len(w) <= LONG and (stem.isalpha() or stem and _only_letters(stem)):
                if stem not in index:
                    stems.add(stem)
                if len(stem) < len(w):
                    split.append((w, stem, w[len(stem):]))
            else:
                other.append(w)
        other += {mark for _, _, mark in split}.difference(index, other)
        if stems:
            self._letters(list(stems))
        if other:
            self._each(other)
        if split:
            at = np.array([index[x] for _, stem, mark in split for x in (stem, mark)])
            lengths = self.ends[at + 1] - self.ends[at]
            self._add([w for w, _, _ in split], self.pool[ragged(self.ends[at], lengths)], lengths.reshape(-1, 2).sum(1))

    def _places(self, words: list[bytes]) -> np.ndarray:
        if self.size > self.limit:
            self._shrink()
        new = [w for w in words if w not in self.index]
        known = self.size
        if new:
            self._learn(new)
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        self.again[at[at < known]] = True
        return at

    def _run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        codes, words, n_words = split_words(texts)
        at = self._places(words)[codes]
        starts = self.ends[at]
        lengths = self.ends[at + 1] - starts
        ends = np.cumsum(n_words)
        seen = np.concatenate([[0], np.cumsum(lengths)])
        return self.pool[ragged(starts, lengths)], seen[ends] - seen[ends - n_words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, each text ended by ``END_ID``; ids of each text with the end).

        ``texts``: binary, null for empty. A text longer than a slice is taken in parts.
        """
        texts = texts.cast(pa.binary())
        if len(texts) > 1 or texts.nbytes <= 2 * SLICE_BYTES:
            ids, counts = self._run(texts)
        else:
            parts = [self._run(pa.array([p], pa.binary()))[0] for p in pieces(texts[0].as_py() or b"")]
            ids = np.concatenate([np.zeros(0, np.uint32), *parts])
            counts = np.array([len(ids)])
        out = np.full(len(ids) + len(counts), END_ID, np.uint32)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(counts + 1) - 1] = False
        out[keep] = ids
        return out, counts + 1


def pieces(text: bytes, most: int = SLICE_BYTES) -> Iterator[bytes]:
    """A text in parts of about ``most`` bytes; no word is cut."""
    start = 0
    while start < len(text):
        space = _SPACE.search(text, start + most)
        end = space.start() if space else len(text)
        yield text[start:end]
        start = end
