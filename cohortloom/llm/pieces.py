"""Safe pieces of texts and byte-bounded memory for them, for the tokenizer operators.

A byte-level tokenizer splits before a space that stands between two characters that
are not white space, whatever surrounds them, so a text may be cut there and its
pieces encoded apart. Words repeat within a block of texts far more than texts do, so
each block looks its distinct pieces up once.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

#: A single space between two characters that are not white space.
_SPLIT = re.compile(r"(?<=\S) (?=\S)")
#: White space beside spaces and line ends.
_OTHER = re.compile(r"[^\S \n]")
#: Bytes of pieces and values that a Python worker remembers, about.
REMEMBERED_BYTES = 128 << 20
#: Bytes that an entry takes beside its characters: two objects and a place in a table.
ENTRY_BYTES = 190
#: Characters up to which a piece is remembered.
SHORT = 48
#: What a worker has made last, by purpose: it serves many tasks.
_made: dict[str, tuple[tuple, object]] = {}


def once_per_worker(purpose: str, key: tuple, make: Callable[[], object]):
    """What ``make`` returns, kept for a worker's later tasks until the purpose has another key.

    A worker holds one thing for each purpose, so what earlier runs left behind goes.
    """
    held = _made.get(purpose)
    if held is None or held[0] != key:
        _made.pop(purpose, None)
        held = _made[purpose] = key, make()
    return held[1]


def forget() -> None:
    """Drop what the tokenizer operators keep: a worker's memory is for the operator at work.

    The C library keeps what was freed in small parts until it is told to return it.
    """
    if _made:
        _made.clear()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)


def byte_level_pieces(text: str) -> list[str]:
    """Pieces of a text, cut at every safe place; all but the first lost their space."""
    if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or _OTHER.search(text):
        return _SPLIT.split(text)
    return text.split(" ")  # every space is a safe place


class PieceCache(dict):
    """Values of short pieces in two generations: a full young one becomes the old one.

    Each generation holds half of ``most_bytes``. A piece of the old generation that is asked
    for moves to the young one, so frequent pieces stay however many rare ones pass.
    """

    def __init__(self, values_of: Callable[[list], list], most_bytes: int = REMEMBERED_BYTES) -> None:
        super().__init__()
        self.values_of, self.half, self.used, self.old = values_of, most_bytes // 2, 0, {}

    def keep(self, piece, value) -> None:
        """Remember one value, unless its piece is long."""
        if len(piece) > SHORT:
            return
        if self.used >= self.half:
            self.old = dict(self)
            self.clear()
            self.used = 0
        self[piece] = value
        self.used += ENTRY_BYTES + len(piece) + (len(value) if hasattr(value, "__len__") else 0)

    def values(self, pieces: Iterable) -> dict:
        """A dictionary of the distinct pieces' values; those not remembered are computed in one call."""
        found = dict.fromkeys(pieces)
        young, old, new = self.get, self.old.get, []
        for p in found:
            value = young(p)
            if value is None:
                value = old(p)
                if value is None:
                    new.append(p)
                    continue
                self.keep(p, value)
            found[p] = value
        for p, value in zip(new, self.values_of(new)):
            found[p] = value
            self.keep(p, value)
        return found


def text_blocks(texts: list[str], most_chars: int) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` with about ``most_chars`` characters each."""
    begin, total = 0, 0
    for i, t in enumerate(texts):
        if i > begin and total + len(t) > most_chars:
            yield begin, i
            begin, total = i, 0
        total += len(t)
    if begin < len(texts):
        yield begin, len(texts)
