"""Encoding of texts with a fixed public tokenizer, through a cache of pieces.

A byte-level BPE splits texts before a space that precedes a word and merges
nothing across such a split. A text without runs of white space that hold a
space is therefore cut at its spaces, each distinct piece is encoded once by
the tokenizers library and its ids are joined; other texts are encoded whole.
"""

from __future__ import annotations

import os
import re

_ODD = re.compile(r" (?:\s|$)")
CACHE_SIZE = 450_000
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Texts to little-endian unsigned 32-bit ids. ``path``: a tokenizers JSON file of a byte-level BPE. ``cache_size``: pieces of a generation of the cache, about 150 bytes each."""

    def __init__(self, path: str, cache_size: int = CACHE_SIZE):
        self.cache_size = cache_size
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        ids = self.tokenizer.get_vocab()
        self.spaced = bytearray(max(ids.values()) + 1)  # 1 for ids whose token starts with a space
        for token, k in ids.items():
            self.spaced[k] = token.startswith("Ġ")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece after a space. As one text that has a space only before each piece, they are cut where a token starts with one."""
        import numpy as np

        if "" not in pieces:
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(np.frombuffer(self.spaced, np.uint8)[ids])
            if len(cuts) == len(pieces):
                raw, at = ids.tobytes(), [*(cuts * 4).tolist(), 4 * len(ids)]
                return [raw[a:b] for a, b in zip(at[:-1], at[1:])]
        return self._encode([" " + p for p in pieces])

    def _learn(self, pieces: set[str]) -> None:
        """After it, ``young`` has all ``pieces``. Pieces not asked for during a generation are forgotten."""
        if len(self.young) > self.cache_size:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = [p for p in pieces if p not in young]
        young.update((p, old[p]) for p in missing if p in old)
        new = [p for p in missing if p not in old]
        for i in range(0, len(new), 2000):
            part = new[i : i + 2000]
            young.update(zip(part, self._encode_pieces(part)))

    def encode_all(self, texts: list[str | None]):
        """Ids of each text in turn; pieces are looked up for about a million characters at a time."""
        i = 0
        while i < len(texts):
            j, size, split, odd = i, 0, [], []
            while j < len(texts) and (j == i or size < 1 << 20):
                t = texts[j] or ""
                size += len(t)
                if _ODD.search(t):
                    odd.append(t)
                    split.append(None)
                else:
                    split.append(t.split(" "))
                j += 1
            heads = iter(self._encode([s[0] for s in split if s]))
            odd_ids = iter(self._encode(odd) if odd else ())
            self._learn(set().union(*(s[1:] for s in split if s)))
            get = self.young.__getitem__
            for s in split:
                yield next(odd_ids) if s is None else next(heads) + b"".join(map(get, s[1:]))
            i = j


def encoder(path: str, cache_size: int = CACHE_SIZE) -> Encoder:
    """One for each path and Python worker; its cache is as large as was asked for last."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].cache_size = cache_size
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
