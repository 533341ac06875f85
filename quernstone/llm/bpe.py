"""Exact byte-level BPE ids of whole texts, fast enough for corpora.

The vocabulary's pre-tokenizer never lets a piece run across a space that a non-space follows, nor across a
lone newline. So a text without adjacent white space is cut there, and each piece's ids come from a bounded
cache; other texts are encoded in one go. Ids equal those of the `tokenizers` library for the same vocabulary,
including its reading of the end-of-text string as one id; tests compare both.
"""

from __future__ import annotations

import base64
import re
from array import array

import numpy as np

SPECIAL = "<|endoftext|>"
#: White space that the cut at " " and "\n" doesn't cover.
_ODD = re.compile(r"\s\s|[^\S \n]|^\s|\s\Z")
_WIDE = re.compile(r"[^\S ]")
#: Words encoded in one go.
_RUN = 200_000


class _Pieces(dict):
    """Bytes of the ids of a piece; a leading newline stands for a newline and a piece without a space before it."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        ids = self.encode("\n") + self.encode(piece[1:]) if piece[0] == "\n" else self.encode(" " + piece)
        out = self[piece] = array("I", ids).tobytes()
        return out


class Bpe:
    """limit: pieces kept at once in a Python worker (about 200 bytes each)."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str, limit: int = 400_000):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._plain = tiktoken.Encoding("quernstone", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._json, self._full = json_path, None
        self._pieces = _Pieces(self._plain.encode_ordinary, limit)
        self._skip = 4 * len(self._plain.encode_ordinary("\n"))
        self._ranks, self._opens = ranks, None

    def _reference(self, text: str) -> list[int]:
        if self._full is None:
            from tokenizers import Tokenizer

            self._full = Tokenizer.from_file(self._json)
        return self._full.encode(text, add_special_tokens=False).ids

    def ids(self, text: str | None) -> np.ndarray:
        """Little-endian unsigned 32-bit ids; none for null or empty texts."""
        if not text:
            return np.empty(0, "<u4")
        if SPECIAL in text:
            return np.array(self._reference(text), "<u4")
        if _ODD.search(text):
            return np.array(self._plain.encode_ordinary(text), "<u4")
        pieces = ("\n" + text).replace("\n", " \n").split(" ")[1:]
        return np.frombuffer(b"".join(map(self._pieces.__getitem__, pieces)), "<u4", offset=self._skip)

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word as after a space, one word after the other, and how many each word has. Words are UTF-8, not empty and without
        spaces, so the ids that begin with one tell them apart. Those with other white space are encoded one by one."""
        if self._opens is None:
            self._opens = np.zeros(max(self._ranks.values()) + 1, bool)  # ids that begin with a space
            self._opens[[i for b, i in self._ranks.items() if b[:1] == b" "]] = True
        out, sizes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for a in range(0, len(words), _RUN):
            run = words[a : a + _RUN]
            text = " " + b" ".join(run).decode()
            wide = np.zeros(len(run), bool)
            if _WIDE.search(text):
                run = text[1:].split(" ")
                wide = np.array([_WIDE.search(w) is not None for w in run])
                text = "".join(" " + w for w, odd in zip(run, wide, strict=True) if not odd)
            ids = np.array(self._plain.encode_ordinary(text), np.int64)
            single = [self._plain.encode_ordinary(" " + run[i]) for i in np.flatnonzero(wide)]
            size = np.empty(len(run), np.int64)
            size[~wide] = np.diff(np.append(np.flatnonzero(self._opens[ids]), len(ids)))
            size[wide] = [len(x) for x in single]
            mixed, odd = np.empty(size.sum(), np.int64), np.repeat(wide, size)
            mixed[~odd], mixed[odd] = ids, [i for x in single for i in x]
            out.append(mixed)
            sizes.append(size)
        return np.concatenate(out), np.concatenate(sizes)


_open: dict[tuple, Bpe] = {}


def tokenizer(json_path: str | None = None, ranks_path: str | None = None, limit: int = 400_000) -> Bpe:
    """One per Python worker. Paths: of the installed public vocabulary if not given."""
    key = (json_path, ranks_path, limit)
    if key not in _open:
        import public_tokenizers as p

        _open[key] = Bpe(json_path or p.path("byte_bpe_50k.json"), ranks_path or p.path("byte_bpe_50k.tiktoken"), p.PATTERN, limit)
    return _open[key]
