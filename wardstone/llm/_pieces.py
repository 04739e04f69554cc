"""Splitting texts where no token can cross, and remembering what each piece gives.

Tokens never cross the matches of a byte-level tokenizer's split pattern. These pieces repeat, so a worker
keeps what it found for them in a table of bounded size.

The pattern glues a single space to what follows it. So a text may also be cut before each space whose
neighbours are both no white space, and each part be split by itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

#: A space beside white space, where a part can't simply be cut.
_ODD = re.compile(r"\s | \s")
#: White space other than spaces and line feeds.
_OTHER = re.compile(r"[^\S \n]")
#: Bytes that a worker's table of pieces may take, roughly; beyond, only those of the present block stay, which costs time only.
MOST = 224 << 20
#: What an entry takes beside its characters and its value.
ENTRY = 220


def is_plain(text: str) -> bool:
    """Whether a text can be cut at each space and line feed: only these two, at most two line feeds together, no other
    run of white space but one line feed before a space, and none at the end."""
    return not ("  " in text or " \n" in text or "\n\n\n" in text or "\n\n " in text or text[-1:] in (" ", "\n") or _OTHER.search(text))


def plain_words(text: str) -> list[str]:
    """The words of a plain text. The first stands for itself, and so do those that begin with a line feed; before all
    others belongs a space. The split pattern cuts between all of them, whatever stands beside them."""
    return (text.replace("\n", " \n") if "\n" in text else text).split(" ")


def parts(text: str) -> list[str]:
    """The parts of a text; joined they are the text."""
    found = text.split(" ")
    if not _ODD.search(text):
        return [found[0], *[" " + x for x in found[1:]]] if found[0] else [" " + x for x in found[1:]]
    out, last = [], found[0]
    for x in found[1:]:
        if x and last and not x[0].isspace() and not last[-1].isspace():
            out.append(last)
            last = " " + x
        else:
            last += " " + x
    out.append(last)
    return [x for x in out if x]


class Remembered:
    """piece -> value, found for all new pieces of a block of texts at once, in a table of ``most`` bytes and one block."""

    def __init__(self, split: Callable[[str], list[str]], find: Callable[[list[str]], list], most: int = MOST):
        self.split, self.find, self.most, self.seen, self.size = split, find, most, {}, 0

    def _add(self, pieces: list[str], values: list) -> None:
        self.seen.update(zip(pieces, values, strict=True))
        self.size += sum(map(len, pieces)) + sum(map(len, values)) + ENTRY * len(pieces)

    def known(self, wanted: set) -> dict:
        """The table, with at least all that is wanted."""
        new = [p for p in wanted if p not in self.seen]
        if self.size + sum(map(len, new)) + ENTRY * len(new) > self.most:
            kept = [p for p in wanted if p in self.seen]
            old, self.seen, self.size = self.seen, {}, 0
            self._add(kept, [old[p] for p in kept])
        for k in range(0, len(new), 1 << 16):
            some = new[k : k + (1 << 16)]
            self._add(some, self.find(some))
        return self.seen

    def __call__(self, texts: list[str]) -> Iterator[map]:
        """For each text, the values of its pieces."""
        split = list(map(self.split, texts))
        get = self.known(set().union(*split)).__getitem__
        for p in split:
            yield map(get, p)


def text_blocks(column, most: int = 1 << 21) -> Iterator[tuple[int, int, list[str]]]:
    """Ranges of a string column of up to ``most`` bytes (a longer text stands alone); null as empty."""
    from ._bytes import blocks, buffers

    _, off = buffers(column)
    for i, j in blocks(off, most):
        yield i, j, [x or "" for x in column.slice(i, j - i).to_pylist()]
