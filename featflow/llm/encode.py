"""Token ids of whole texts with the tokenizers library.

Two kinds of tokenizer are taken apart: byte-level BPE, and BPE over lower-cased
words without white space. Both cut a text by a pattern into words, numbers,
runs of marks and white space, and the ids of a cut depend on nothing else. A
text of Latin-1 characters is cut here by the same pattern (its classes written
out for Latin-1, where normalising is lower case alone), and a new cut goes to
the tokenizer's own model. Cuts repeat a lot: their ids are kept in a table of
at most ``CACHE_BYTES`` in each worker, those met first, so the common ones.

Any other text is split at single spaces between characters that are not white
space, where both kinds cut anyway; its Latin-1 pieces go the same way, and
every other piece through the library whole. Other kinds of tokenizer encode
whole texts through the library.

With ``added``, as ``encoder`` sets it, the strings of the tokenizer's added
tokens are their ids, as in the library's plain ``encode``: a text is cut at
them first, before anything is normalised. Without it they are ordinary text.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

CACHE_BYTES = 32 << 20
ENTRY_BYTES = 200           # of a table entry besides its characters and ids
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_WORDS, _NUMBERS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t\n\x0b\x0c\r \x85\xa0"        # \p{L}, \p{N} and \s in Latin-1
#: The patterns of the two kinds of tokenizer, for Latin-1.
_BYTE_LEVEL = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_WORDS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_WORDS}{_NUMBERS}]+"
                         rf"|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
_LOWERING = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_WORDS}]+|[{_NUMBERS}]|[^{_SPACES}{_WORDS}{_NUMBERS}]+")
_LOWERING_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The printable character that byte-level BPE uses for each byte: itself
    where it is printable Latin-1, else the next character from U+0100 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class Encoder:
    """``bytes_of(text)`` are the text's ids as little-endian ``dtype``."""

    def __init__(self, path: str, limit: int = CACHE_BYTES, added: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        tokens = self.tokenizer.get_added_tokens_decoder() if added else {}
        self.tokenizer.encode_special_tokens = True     # in a piece their strings are ordinary text
        self.model = self.tokenizer.model
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.native = sys.byteorder == "little" and array(self.code).itemsize == self.dtype.itemsize
        self.letters = dict(enumerate(byte_letters()))
        normal, cuts = str(self.tokenizer.normalizer), str(self.tokenizer.pre_tokenizer)
        byte_level = normal == "None" and cuts.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in cuts
        self.lowering = ("NFC()" in normal and "Lowercase()" in normal and _LOWERING_PATTERN in cuts.replace("\\\\", "\\") and "Removed" in cuts
                         and "ByteLevel(add_prefix_space=False" in cuts and "use_regex=False" in cuts)
        self.cuts = (_BYTE_LEVEL if byte_level else _LOWERING).findall if byte_level or self.lowering else None
        self.table = _Table(self, limit)
        self.added = {t.content: self._packed([i]) for i, t in tokens.items()}
        names = sorted(self.added, key=len, reverse=True)       # leftmost, then longest, as the library matches
        self.cut = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        plain = all(t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word) for t in tokens.values())
        self.whole = None if plain else Tokenizer.from_file(path)       # matches that a cut cannot follow

    def _packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes() if self.native else np.array(ids, self.dtype).tobytes()

    def _library(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def cut_ids(self, cut: str) -> bytes:
        """Ids of one cut, by the model: bytes written as its letters."""
        letters = cut if cut.isascii() and cut.isalpha() else cut.encode().decode("latin-1").translate(self.letters)
        return self._packed([t.id for t in self.model.tokenize(letters)])

    def bytes_of(self, text: str) -> bytes:
        if self.whole:
            return self._packed(self.whole.encode(text, add_special_tokens=False).ids)
        if self.cut is None:
            return self._bytes_between(text)
        parts = self.cut.split(text)
        if len(parts) == 1:
            return self._bytes_between(text)
        return b"".join(self.added[p] if k % 2 else self._bytes_between(p) for k, p in enumerate(parts))

    def _bytes_between(self, text: str) -> bytes:
        """Ids of a text in which no added token is looked for."""
        if self.cuts is None:
            return self._library(text)
        if _latin(text):
            return self._latin_ids(text)
        first, *rest = _SAFE_SPACE.split(text)
        return b"".join([self._piece(first), *(self._piece(" " + x) for x in rest)])

    def _piece(self, piece: str) -> bytes:
        return self._latin_ids(piece) if _latin(piece) else self._library(piece)

    def _latin_ids(self, text: str) -> bytes:
        return b"".join(map(self.table.__getitem__, self.cuts(text.lower() if self.lowering else text)))

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.bytes_of(text), self.dtype)


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Table(dict):
    """Ids of cuts."""

    def __init__(self, encoder: Encoder, limit: int):
        super().__init__()
        self.encoder, self.left = encoder, limit

    def __missing__(self, cut: str) -> bytes:
        made = self.encoder.cut_ids(cut)
        if self.left > 0 and len(cut) < 64:
            self.left -= ENTRY_BYTES + len(cut) + len(made)
            self[cut] = made
        return made


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process; only the last is kept."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path, added=True)
    return _encoders[path]


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[None]:
    """Within, jobs hand rows to Python in batches of at most ``rows`` rows and
    about ``size`` bytes: ids take more room than texts, and both sides hold a
    batch or two."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
