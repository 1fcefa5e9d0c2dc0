"""Ids of a public word-level BPE vocabulary for whole texts, fast: equal pre-tokens are encoded once.

The vocabulary's rules: canonical composition, white space to blanks, lower case; then pre-tokens
(runs of letters, single digits, runs of other symbols, English contractions), each encoded on its
own. So the ids of a text are those of its pre-tokens one after the other, which tests hold against
the library on the whole text. Texts with characters outside the Latin blocks, apostrophes or special
tokens take the library's own path.
"""

from __future__ import annotations

import os

import numpy as np
import regex

from .spans import Cache, gather, span_hashes

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: Characters below this need no composition and lower-case one to one, but for those left out.
_LATIN = 0x250


def vocabulary_path(name: str, folder: str | None = None) -> str:
    """The vocabulary file: in folder, or where the installed package of public tokenizers has it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.cache = Cache()
        random = np.random.default_rng(7)
        chars = [chr(c) for c in range(_LATIN)]
        lower = [c.lower() if len(c.lower()) == 1 and ord(c.lower()) < _LATIN else c for c in chars]
        self.lower = np.array([ord(c) for c in lower], np.uint16)
        #: 0 white space, 1 letter, 2 digit, 3 other.
        self.kind = np.array([0 if c in " \t\n\r\f\v" else 1 if regex.match(r"\p{L}", c) else 2 if regex.match(r"\p{N}", c) else 3 for c in lower], np.uint8)
        hard = [c for c in range(_LATIN) if chr(c) == "'" or c in (0x130, 0xA0) or 0x7F <= c < 0xA0 or (c < 0x20 and chr(c) not in "\t\n\r\f\v") or len(chars[c].lower()) > 1 or ord(chars[c].lower()) >= _LATIN]
        self.hard = np.zeros(_LATIN, bool)
        self.hard[hard] = True
        self.value = random.integers(1, 2**63, _LATIN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids): words are encoded as one text; ends of words show."""
        ids = np.array(self.library.encode(" ".join(words), add_special_tokens=False).ids, np.int32)
        ends = np.flatnonzero(self.ends[ids])
        if len(ends) != len(words):  # a word without an end piece: one by one
            each = [self.library.encode(w, add_special_tokens=False).ids for w in words]
            return np.array([len(x) for x in each], np.int64), np.concatenate([np.array(x, np.int32) for x in each])
        return np.diff(ends, prepend=-1), ids

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        easy = []
        for i, (text, code) in enumerate(zip(texts, codes, strict=True)):
            if len(code) and code.max() < _LATIN and not self.hard[code].any() and "<|" not in text:
                easy.append(i)
            elif len(code):
                out[i] = np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)
            else:
                out[i] = np.zeros(0, np.int32)
        if easy:
            lengths = np.array([len(codes[i]) + 1 for i in easy])
            data = np.full(int(lengths.sum()), 32, np.uint16)
            at = np.cumsum(lengths) - lengths
            for i, a in zip(easy, at, strict=True):
                data[a : a + len(codes[i])] = codes[i]
            data = self.lower[data]
            kind = self.kind[data]
            change = np.ones(len(data) + 1, bool)
            change[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
            edges = np.flatnonzero(change)
            full = kind[edges[:-1]] != 0
            starts, ends = edges[:-1][full], edges[1:][full]

            def fill(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                return self._encode_words([data[starts[i] : ends[i]].astype(np.uint32).tobytes().decode("utf-32-le") for i in which])

            which, begin, count = self.cache.rows(span_hashes(data, starts, ends, self.value), fill)
            ids = gather(self.cache.flat, begin[which], count[which])
            bounds = np.searchsorted(starts, np.append(at, len(data)))
            sums = np.concatenate([[0], np.cumsum(count[which])])[bounds]
            for k, i in enumerate(easy):
                out[i] = ids[sums[k] : sums[k + 1]]
        return out  # type: ignore[return-value]


_loaded: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per worker process."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]
