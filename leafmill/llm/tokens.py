"""Whole-text encoding with a tokenizers file, memoised by white-space delimited pieces.

The vocabularies named in ``CUTTABLE`` never form a pre-token that reaches from a non-space into a space, so a text may
be cut before each space that follows a non-space: the ids of the parts, in order, are the ids of the text.
Pieces repeat far more often than texts do; each is encoded once per cache fill and then looked up. With any other
vocabulary, of which that is not known, a text is one piece.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np

#: Unicode White_Space, as the tokenizers' own patterns read it (Python's \s has four more characters).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A run of Latin letters may also end before ASCII punctuation: letters never share a pre-token with it.
CUT = re.compile(f"[{SPACE}]*+[{LATIN}]++(?=[!-/:-@\\[-`{{-~])|[{SPACE}]*+[^{SPACE}]++|[{SPACE}]+")
#: Vocabulary files that texts may be cut for.
CUTTABLE = ("byte_bpe_50k.json", "word_bpe_49k.json")
#: Pieces in the cache of a Python worker, about 200 bytes each; a full cache is emptied.
CACHE_PIECES = 400_000


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; it is resolved where the code runs, on driver or executor."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Encoder:
    """Encodes whole texts; ids are the library's own, whatever way a piece takes."""

    def __init__(self, name: str, special_as_text: bool = False, held: int = CACHE_PIECES):
        self.held = held
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        path = vocabulary(name)
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text  # as the library has it, their strings give the tokens
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.cuttable = os.path.basename(path) in CUTTABLE
        self.folds = spec["normalizer"] is not None
        self.width = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        # One pre-token for certain: it can go to the BPE model without the passes before it.
        self.single = re.compile(f"[{SPACE}]*[{LATIN}]+" if self.folds else f" ?[{LATIN}]+").fullmatch
        self.letters = _byte_letters()
        self.ids: dict[str, bytes] = {}
        self.spans: dict[str, tuple[bytes, bytes]] = {}

    def _piece(self, piece: str) -> str:
        if self.folds:
            piece = piece.strip().lower()
        return piece.encode().decode("latin-1").translate(self.letters)

    def cut(self, texts: list[str]) -> list[list[str]]:
        """The pieces of each text; their ids are in ``ids`` until the next call."""
        cut = [CUT.findall(t) for t in texts] if self.cuttable else [[t] for t in texts]
        if len(self.ids) > self.held or not self.cuttable:
            self.ids.clear()
        new = set().union(*cut).difference(self.ids) if cut else ()
        slow, model, dt = [], self.tok.model.tokenize, self.width
        kind = "H" if dt.itemsize == 2 else "I"
        from array import array

        for p in new:
            if self.cuttable and self.single(p):
                self.ids[p] = array(kind, [x.id for x in model(self._piece(p))]).tobytes()
            else:
                slow.append(p)
        for p, e in zip(slow, self.tok.encode_batch_fast(slow, add_special_tokens=False), strict=True):
            self.ids[p] = array(kind, e.ids).tobytes()
        return cut

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text, its ids as little-endian unsigned integers of ``width``."""
        cut = self.cut(texts)
        get = self.ids.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def offsets(self, pieces: list[str], base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every token of the pieces, in code points from their ``base``, and its piece."""
        if len(self.spans) > self.held // 3 or not self.cuttable:
            self.spans.clear()
        new = list({*pieces}.difference(self.spans))
        for p, e in zip(new, self.tok.encode_batch(new, add_special_tokens=False), strict=True):
            at = np.array(e.offsets, "<i4").reshape(-1, 2)
            self.spans[p] = (at[:, 0].tobytes(), at[:, 1].tobytes())
        parts = [self.spans[p] for p in pieces]
        of = np.repeat(np.arange(len(parts)), [len(a) // 4 for a, _ in parts])
        starts, ends = (np.frombuffer(b"".join(x[k] for x in parts), "<i4") + base[of] for k in (0, 1))
        return starts, ends, of


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(name: str, special_as_text: bool = False, held: int = CACHE_PIECES) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    if (name, special_as_text) not in _encoders:
        _encoders[name, special_as_text] = Encoder(name, special_as_text, held)
    return _encoders[name, special_as_text]


def forget() -> None:
    """Drops this worker's encoders with their caches: workers outlive stages, and the next one needs the memory."""
    _encoders.clear()
    give_back()


def give_back() -> None:
    """Returns what earlier stages of this worker freed to the system, where it can be asked to."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        return


def blocks(texts: list[str | None], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` characters, or of one row, so that temporary arrays stay small."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > begin and held + n > size:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(texts):
        yield begin, len(texts)
