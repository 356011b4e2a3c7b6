"""Token ids of whole texts from a public tokenizer file, with a cache of words."""

from __future__ import annotations

import itertools
import os
import re
import unicodedata

import numpy as np

from .common import pieces

#: Words that a worker remembers before it starts afresh, and words that are encoded as one line.
CACHE_TOKENIZED, LINE_WORDS = 1_000_000, 128
#: Bytes of texts that are encoded together.
PIECE_BYTES = 1 << 20
_PUNCTUATION = b".,!?;:*&$%#|"
_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyz")


class WordTokenizer(dict):
    """Ids of texts under a tokenizer that drops white space and lower-cases (``word_bpe_49k.json``).

    No token of such a tokenizer spans white space, so a text's ids are its words' ids in a row; every distinct
    word is encoded by the tokenizers library once and remembered. Words are lower-cased in ASCII first, as the
    tokenizer would do, unless the text may hold the literal of a special token. Trailing ASCII punctuation
    behind an ASCII letter is a piece of its own for the tokenizer, so such a word is looked up in two parts.
    Words of letters alone are one piece, whose last token is marked as a word's end, so many are encoded in one line
    and told apart by these marks."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        suffix = spec["model"].get("end_of_word_suffix")
        if "Lowercase" not in kinds or not suffix:
            raise ValueError("WordTokenizer needs a tokenizer that lower-cases, drops white space and marks the ends of words")
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.ids = np.empty(1 << 16, np.uint32)  # all words' ids; a word has `sizes` from `starts`
        self.used = 0
        self.starts = np.empty(0, np.int64)
        self.sizes = np.empty(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at

    def _ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the number of each text's."""
        each = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter(itertools.chain.from_iterable(each), np.uint32, int(sizes.sum())), sizes

    def _keep(self, at: list[int], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remember ids in a row as those of the words ``at``."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(self.used + 2 * len(ids), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        where = np.array(at, np.int64)
        self.starts[where] = self.used + np.cumsum(sizes) - sizes
        self.sizes[where] = sizes
        self.used += len(ids)

    def _learn(self) -> None:
        """Encode the words met since the last call."""
        plain, other, pairs, first = [], [], [], len(self.starts)
        while self.new:  # the parts of a word may be new as well
            new, self.new = self.new, []
            at = first + len(plain) + len(other) + len(pairs)
            for i, word in enumerate(new, at):
                if word.isalpha():  # ASCII letters
                    plain.append((i, word))
                    continue
                core = word.rstrip(_PUNCTUATION)
                if core and len(core) < len(word) and core[-1] in _LETTERS:
                    pairs.append((i, self[core], self[word[len(core) :]]))
                    continue
                s = word.decode("utf-8", "replace")
                alone = s.isalpha() and unicodedata.is_normalized("NFC", s) and s.lower().isalpha()
                (plain if alone else other).append((i, word))
        more = len(plain) + len(other) + len(pairs)
        self.starts = np.concatenate([self.starts, np.zeros(more, np.int64)])
        self.sizes = np.concatenate([self.sizes, np.zeros(more, np.int64)])
        lines = [plain[k : k + LINE_WORDS] for k in range(0, len(plain), LINE_WORDS)]
        ids, sizes = self._ids_of([b" ".join([w for _, w in line]).decode() for line in lines])
        ends = self.ends[ids]
        before = np.concatenate([[0], np.cumsum(sizes)])
        words_in = np.diff(np.concatenate([[0], np.cumsum(ends)])[before])
        wrong = [k for k, line in enumerate(lines) if words_in[k] != len(line)]
        if wrong:
            right = np.ones(len(lines), bool)
            right[wrong] = False
            other += [x for k in wrong for x in lines[k]]
            plain = [x for k, line in enumerate(lines) if right[k] for x in line]
            ids = ids[np.repeat(right, sizes)]
            ends = self.ends[ids]
        if plain:
            self._keep([i for i, _ in plain], ids, np.diff(np.flatnonzero(ends), prepend=-1))
        if other:
            self._keep([i for i, _ in other], *self._ids_of([w.decode("utf-8", "replace") for _, w in other]))
        if pairs:
            parts = np.array(pairs, np.int64)
            both = self._gather(parts[:, 1:].ravel())
            self._keep(parts[:, 0], both, self.sizes[parts[:, 1]] + self.sizes[parts[:, 2]])

    def _gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of the words ``at`` in a row."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """One array of ids for each text; null gives none."""
        out, group, size = [], [], 0
        for text in texts:
            data = text.encode("utf-8", "replace") if text else b""
            if b"<|" not in data:
                data = data.lower()
            if len(data) > PIECE_BYTES:
                out += self._some(group)
                out.append(np.concatenate([x for piece in pieces(data, PIECE_BYTES) for x in self._some([piece])]))
                group, size = [], 0
                continue
            group.append(data)
            size += len(data)
            if size >= PIECE_BYTES:
                out += self._some(group)
                group, size = [], 0
        return out + self._some(group)

    def _some(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self) > CACHE_TOKENIZED:
            self._forget()
        each = [data.split() for data in texts]
        at = np.fromiter(map(self.__getitem__, itertools.chain.from_iterable(each)), np.int64, sum(map(len, each)))
        if self.new:
            self._learn()
        if not each:
            return []
        bounds = np.concatenate([[0], np.cumsum(self.sizes[at])])[np.cumsum([len(w) for w in each])]
        return np.split(self._gather(at), bounds[:-1])


_CACHE: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for a file, kept from batch to batch."""
    if path not in _CACHE:
        _CACHE[path] = WordTokenizer(path)
    return _CACHE[path]


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    if not re.fullmatch(r"[\w.]+", name):
        raise ValueError(name)
    return public_tokenizers.path(name)
