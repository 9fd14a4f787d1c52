"""Token ids of whole texts, by way of a cache of the ids of words.

The public word vocabulary splits a text at white space before anything else, so the ids of a text are those of its
white-space separated parts in a row.  Natural text repeats its words: encoding each distinct part once and joining the
results is several times as fast as encoding text by text, with the same ids (the tests compare the two).
"""

from __future__ import annotations

import os

import numpy as np

#: White space for Python's split() but not for the vocabulary.
_ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")


def parts(text: str) -> list[str]:
    """Pieces of a text whose ids, joined, are those of the text.

    Where commas and full stops are the only signs and none stand side by side, each is a piece of its own in the
    vocabulary too, and letter case is no matter; other texts are split at white space alone.
    """
    if any(sign in text for sign in _ODD_SPACE):
        return [text]
    plain = not (".." in text or ",," in text or ".," in text or ",." in text or "\u03a3" in text)
    if plain and text.replace(",", "").replace(".", "").replace(" ", "").replace("\n", "").isalnum():
        return text.lower().replace(",", " , ").replace(".", " . ").split()
    return text.split()


class WordTokenizer:
    """Encodes texts with a `tokenizers` file that drops white space.

    max_words bounds the cache: later words are then encoded each time they come, with the same result.
    """

    def __init__(self, path: str, max_words: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = False
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.max_words = max_words
        #: Ids at which a word ends; none in vocabularies that don't mark word ends.
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for piece, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[i] = piece.endswith("</w>")
        self.cache: dict[str, bytes] = {}

    def encode(self, texts: list[str | None], end_id: int | None) -> list[bytes]:
        """Ids of each text as little-endian bytes of self.dtype, with end_id at the end; null counts as empty."""
        end = b"" if end_id is None else np.array([end_id], self.dtype).tobytes()
        out: list[bytes] = []
        group: list[list[str]] = []
        size = 0
        for text in texts:
            group.append(parts(text) if text else [])
            size += len(group[-1])
            if size > 200_000:
                out += self._join(group, end)
                group, size = [], 0
        return out + self._join(group, end)

    def _join(self, group: list[list[str]], end: bytes) -> list[bytes]:
        get = self.cache.get
        found = [list(map(get, words)) for words in group]
        missed = [k for k, ids in enumerate(found) if None in ids]
        new = list({w for k in missed for w, ids in zip(group[k], found[k], strict=True) if ids is None})
        if new:
            fresh = self._words(new)
            for k in missed:
                found[k] = [fresh[w] if ids is None else ids for w, ids in zip(group[k], found[k], strict=True)]
            if len(self.cache) < self.max_words:
                self.cache |= fresh
        return [b"".join(ids) + end for ids in found]


    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word; words of letters alone go in rows of 300, to be parted at the ids that end words."""
        fresh: dict[str, bytes] = {}
        plain = [w for w in words if w.isalpha()] if self.ends.any() else []
        if plain:
            rows = [" ".join(plain[i : i + 300]) for i in range(0, len(plain), 300)]
            got = self.tokenizer.encode_batch_fast(rows, add_special_tokens=False)
            ids = np.concatenate([np.array(x.ids, self.dtype) for x in got])
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()
            if len(cuts) == len(plain):
                whole = ids.tobytes()
                fresh = {w: whole[i:j] for w, i, j in zip(plain, [0, *cuts], cuts, strict=False)}
        rest = [w for w in words if w not in fresh]
        got = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        return fresh | {w: np.array(x.ids, self.dtype).tobytes() for w, x in zip(rest, got, strict=True)}


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per Python worker, kept between its tasks."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def word_vocabulary() -> str:
    """The default vocabulary file; every operator takes another path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
