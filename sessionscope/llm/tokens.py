"""Byte-level BPE ids of many texts at once, with every distinct word encoded once.

A byte-level tokenizer cuts a text into pieces before it merges bytes, and a space
before a visible character always opens a piece.  So a text may be cut there, each
distinct cut encoded once by the tokenizer and the ids strung together again.  Arrow cuts
the texts, numbers the distinct words and strings the ids, so that Python sees distinct
words only.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

# Spark keeps the cores busy; the tokenizer's own threads would only wait for each other.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

ID_TYPE = "<u4"
ID_BYTES = 4
SEGMENT = 1 << 23
# Signs that never join the letters before them; an apostrophe may.
_SIGNS = '.,;:!?)]}"%$&*|/-'
_OPENS = re.compile(" [!-~]")

# A space before anything that some engine might read as white space or as a control
# character: such a text is encoded in one go.
_UNSAFE = re.compile(" (?:[^!-~¡-ᙿᚁ-᠍᠏-῿⁰-⿿、-퟿]|\\Z)")


class WordEncoder:
    """Encodes texts to little-endian id bytes.

    Words are remembered in two halves of about ``limit / 2``: when the newer half is full, the
    older one is forgotten, except for the words that were met again since.
    """

    _shared: dict = {}

    def __init__(self, path: str, limit: int = 300_000, joined: int = 512):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.limit, self.joined = limit, joined
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # Every character of a byte-level token stands for one byte.
        vocabulary = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, number in vocabulary.items():
            self.n_bytes[number] = len(token)

    @classmethod
    def shared(cls, path: str) -> "WordEncoder":
        """One encoder per Python worker: its words serve the worker's later tasks too."""
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def _whole(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=ID_TYPE).tobytes() for e in encoded]

    def _lookup(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words that each followed a space."""
        if len(self.known) > self.limit // 2:
            self.older, self.known = self.known, {}
        found = list(map(self.known.get, words))
        missing = [word for word, ids in zip(words, found) if ids is None]
        if not missing:
            return found
        self.known.update((word, self.older[word]) for word in missing if word in self.older)
        self._learn_pieces([word for word in missing if word not in self.older])
        return list(map(self.known.__getitem__, words))

    def _learn_pieces(self, words: list[str]) -> None:
        """Encodes many words in one call and cuts the ids where each word's bytes end."""
        groups = [words[i : i + self.joined] for i in range(0, len(words), self.joined)]
        encoded = self.tokenizer.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False)
        for group, encoding in zip(groups, encoded):
            ids = np.array(encoding.ids, dtype=ID_TYPE)
            ends = np.cumsum([len(w.encode()) + 1 for w in group])
            cuts = (np.searchsorted(np.cumsum(self.n_bytes[ids]), ends) + 1) * ID_BYTES
            data, start = ids.tobytes(), 0
            for word, end in zip(group, cuts.tolist()):
                self.known[word] = data[start:end]
                start = end

    def _segments(self, text: str) -> Iterator[str]:
        """The text in pieces of about ``SEGMENT`` characters, cut where a word opens."""
        start = 0
        while len(text) - start > SEGMENT:
            cut = _OPENS.search(text, start + SEGMENT)
            if cut is None:
                break
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Id bytes of each text."""
        return list(self.stream(texts))

    def stream(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Id bytes of each text in turn; only about ``SEGMENT`` characters are split up at a time."""
        waiting, size = [], 0
        for text in texts:
            if size + len(text) > SEGMENT:
                yield from self._encode(waiting)
                waiting, size = [], 0
            if len(text) > SEGMENT:
                yield b"".join(ids for segment in self._segments(text) for ids in self._encode([segment]))
            else:
                waiting.append(text)
                size += len(text)
        yield from self._encode(waiting)

    def _encode(self, texts: list[str]) -> list[bytes]:
        result: list = [b""] * len(texts)
        cut, whole = [], []
        for i, text in enumerate(texts):
            if text:
                (whole if _UNSAFE.search(text) else cut).append(i)
        for i, ids in zip(cut, self._strung([texts[i] for i in cut])):
            result[i] = ids
        for i, ids in zip(whole, self._whole([texts[i] for i in whole])):
            result[i] = ids
        return result

    def _strung(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of texts in which every space opens a word; what is before the first space is a head."""
        if not texts:
            return
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        parts, starts = split.values, split.offsets.to_numpy()[:-1]
        follows = np.ones(len(parts), dtype=bool)
        follows[starts] = False
        words = parts.filter(pa.array(follows)).dictionary_encode()
        heads = parts.take(pa.array(starts)).dictionary_encode()
        ids = [self._word_ids(words.dictionary), pa.array(self._whole(heads.dictionary.to_pylist()), pa.large_binary())]
        place = np.empty(len(parts), dtype=np.int64)
        place[follows] = words.indices.to_numpy()
        place[starts] = heads.indices.to_numpy() + len(words.dictionary)
        strung = pa.concat_arrays(ids).take(pa.array(place))
        ends = np.frombuffer(strung.buffers()[1], dtype=np.int64)[: len(parts) + 1]
        data, ends = strung.buffers()[2], ends[[*starts, len(parts)]].tolist()
        for start, end in zip(ends, ends[1:]):
            yield data[start:end].to_pybytes()

    def _word_ids(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words; letters and the signs after them are pieces of their own."""
        stems = pc.utf8_rtrim(words, _SIGNS)
        signed = pc.and_(pc.utf8_is_alpha(stems), pc.less(pc.binary_length(stems), pc.binary_length(words)))
        pairs = zip(words.filter(signed).to_pylist(), stems.filter(signed).to_pylist())
        tails = pa.array([word[len(stem) :] for word, stem in pairs], pa.large_string()).dictionary_encode()
        stems = pc.if_else(signed, stems, words).dictionary_encode()
        # The last tail is none.
        place = np.full(len(words), len(tails.dictionary))
        place[signed.to_numpy(zero_copy_only=False)] = tails.indices.to_numpy()
        stem_ids = pa.array(self._lookup(stems.dictionary.to_pylist()), pa.large_binary())
        tail_ids = pa.array([*self._whole(tails.dictionary.to_pylist()), b""], pa.large_binary())
        return pc.binary_join_element_wise(stem_ids.take(stems.indices), tail_ids.take(pa.array(place)), pa.scalar(b"", pa.large_binary()))
