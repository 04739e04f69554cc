"""Exact token counts at every prefix of a text, by dynamic programming.

For each prefix of a piece (a match of the split pattern) the programme stores the last token and the
number of tokens. The last token of a prefix is the one vocabulary entry that ends there and may follow
the last token of the shorter prefix: two tokens may stand side by side unless some merge across their
border would have come first. Each prefix has exactly one such entry, so no text is merged again. Prefixes
are shared between pieces and remembered. From the stored counts, the token count of any prefix, whether
a text passes a limit, and the longest prefix within a budget are read off.

Prefixes that the pattern would split otherwise than the whole text (white space at their end, a cut
contraction, a cut special string) are counted as texts of their own, so every count is that of the
library for exactly that prefix.

A piece beyond ``ALONE`` bytes keeps the tables of its own prefixes in flat arrays (eight bytes a byte) instead of the
shared tree. Tokenizer files with settings that these counts don't follow (a normaliser, a space put before texts, added
tokens that are not special or take white space along, other models than plain byte-level merges) are a ValueError.

Defined results: a null text counts as empty, with no tokens. A special string inside a text is one token,
as the library takes it by default. Texts of any length are taken whole.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._pieces import Remembered, parts, text_blocks
from ._store import ship

END = 1 << 30
#: Bytes beyond which a piece's prefixes are not shared with other pieces.
ALONE = 4096
_RUN = re.compile(r"\s\s")


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _check(spec: dict) -> None:
    """Raises for a tokenizer file whose counts would not be those found here."""
    model, odd = spec["model"], []
    if spec.get("normalizer"):
        odd.append("normalizer")
    odd += [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if model.get("type", "BPE") != "BPE":
        odd.append(f"model {model['type']}")
    before = spec.get("pre_tokenizer") or {}
    if any(x.get("add_prefix_space") for x in (before, *before.get("pretokenizers", []))):
        odd.append("add_prefix_space")
    for t in spec["added_tokens"]:
        if not t["special"] or any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            odd.append(f"added token {t['content']!r}")
    if odd:
        raise ValueError(f"tokenizer settings that are not counted: {', '.join(odd)}")


class Counter:
    """Prefix counts for one tokenizer file."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _check(spec)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        special = {x["content"] for x in spec["added_tokens"] if x["special"]}
        ids = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.ids = {raw(t): i for t, i in ids.items()}
        self.pattern = regex.compile(pattern)
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.ends: dict = {}
        for t, i in self.ids.items():
            at = self.ends
            for b in reversed(t):
                at = at.setdefault(b, {})
            at[-1] = i
        self.rank, self.halves, self.formed = {}, {}, {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            a, b, t = ids[a], ids[b], ids[a + b]
            self.rank[a, b] = r
            if t not in self.halves:
                self.halves[t], self.formed[t] = (a, b), r
        self.edges: dict[tuple[int, int], list] = {}
        self.beside: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self._forget()
        self.pieces = Remembered(self.pattern.findall, self._pieces)
        self.parts = Remembered(parts, self._parts)

    def _forget(self) -> None:
        """Prefixes as a tree: (node, byte) -> node; of each node its last token and its count. Node 0 is empty."""
        self.tree: dict[int, int] = {}
        self.last, self.count = [-1], [0]

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens along one edge of a token's merge tree, each with the rank of the merge that takes it up."""
        key = (token, side)
        if key not in self.edges:
            out, above = [], END
            t = token
            while True:
                out.append((t, above))
                if t not in self.halves:
                    break
                above, t = self.formed[t], self.halves[t][side]
            self.edges[key] = out
        return self.edges[key]

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether a and b can stand side by side: no merge of a right edge of a with a left edge of b comes first."""
        key = a << 24 | b
        ok = self.beside.get(key)
        if ok is None:
            ok = True
            for x, above_x in self._edge(a, 1):
                for y, above_y in self._edge(b, 0):
                    r = self.rank.get((x, y))
                    if r is not None and r < above_x and r <= above_y:
                        ok = False
                        break
                if not ok:
                    break
            if len(self.beside) > 2_000_000:
                self.beside.clear()
            self.beside[key] = ok
        return ok

    def _is_whole(self, token: int) -> bool:
        """Whether a token's bytes give that token."""
        ok = self.alone.get(token)
        if ok is None:
            a, b = self.halves.get(token, (-1, -1))
            ok = a < 0 or (self._is_whole(a) and self._is_whole(b) and self._first_merge(a, b))
            self.alone[token] = ok
        return ok

    def _first_merge(self, a: int, b: int) -> bool:
        """Whether a and b are both formed before any merge across their border."""
        own = self.rank[a, b]
        for x, above_x in self._edge(a, 1):
            for y, above_y in self._edge(b, 0):
                r = self.rank.get((x, y))
                if (x, y) != (a, b) and r is not None and r < above_x and r <= above_y and r < own:
                    return False
        return True

    def _alone(self, piece: bytes) -> array:
        """What piece() gives, for a long one: its prefixes stand in flat arrays that go with it."""
        last, count, beside = array("i", [-1]), array("i", [0]), self.beside
        for e in range(len(piece)):
            at, s = self.ends, e
            while True:
                at = at.get(piece[s])
                t = at.get(-1)
                if t is not None:
                    if s == 0:
                        if self._is_whole(t):
                            break
                    else:
                        a = last[s]
                        ok = beside.get(a << 24 | t)
                        if ok or (ok is None and self._may_follow(a, t)):
                            break
                s -= 1
            last.append(t)
            count.append(count[s] + 1)
        return count[1:]

    def piece(self, piece: bytes) -> list[int] | array:
        """The token count at each byte of a piece (after one byte, after two, ...)."""
        if len(piece) > ALONE:
            return self._alone(piece)
        if len(self.last) > 400_000:
            self._forget()
        tree, last, count, beside = self.tree, self.last, self.count, self.beside
        node, path = 0, [0]
        for e, b in enumerate(piece):
            key = node << 8 | b
            node = tree.get(key, 0)
            if not node:
                at, s = self.ends, e
                while True:
                    at = at.get(piece[s])
                    t = at.get(-1)
                    if t is not None:
                        if s == 0:
                            if self._is_whole(t):
                                break
                        else:
                            a = last[path[s]]
                            ok = beside.get(a << 24 | t)
                            if ok or (ok is None and self._may_follow(a, t)):
                                break
                    s -= 1
                node = len(last)
                last.append(t)
                count.append(count[path[s]] + 1)
                tree[key] = node
            path.append(node)
        return [count[k] for k in path[1:]]

    def _whole(self, text: str) -> int:
        return sum(self.piece(p.encode())[-1] for p in self.pattern.findall(text))

    def _plain(self, text: str, base: int, out: array) -> int:
        """Appends the count at each character of a text without special strings; gives the count of all of it."""
        run = 0  # where the present run of white space begins
        before = base
        for m in self.pattern.finditer(text):
            piece = m.group()
            if piece.isspace():
                if not (m.start() and text[m.start() - 1].isspace()):
                    run, before = m.start(), base
                own = self.piece(text[run : m.end()].encode())
                at = len(text[run : m.start()].encode())
                for c in piece:
                    at += len(c.encode())
                    out.append(before + own[at - 1])
            else:
                raw = piece.encode()
                own = self.piece(raw)
                i = 0
                if piece[0] == " " and m.start() and text[m.start() - 1].isspace():
                    if not (m.start() >= 2 and run < m.start()):
                        run = m.start() - 1
                    out.append(before + self.piece(text[run : m.start() + 1].encode())[-1])
                    i = 1
                if piece[0] == "'" and len(piece) == 3 and piece[1].isalpha():
                    out.extend((base + own[0], base + own[0] + self._whole(piece[1])))
                    i = 2
                if len(raw) == len(piece):
                    out.extend(base + c for c in own[i:])
                else:
                    at = len(piece[:i].encode())
                    for c in piece[i:]:
                        at += len(c.encode())
                        out.append(base + own[at - 1])
            base += self.piece(piece.encode())[-1]
        return base

    def counts(self, text: str) -> array:
        """The token count of each prefix of one, two, ... characters."""
        out = array("i")
        base = at = 0
        if self.special:
            for m in self.special.finditer(text):
                segment = text[at : m.start()]
                start = base
                base = self._plain(segment, base, out)
                for k in range(1, m.end() - m.start()):
                    out.append(start + self._whole(segment + m.group()[:k]))
                base += 1
                out.append(base)
                at = m.end()
        self._plain(text[at:], base, out)
        return out

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The steps between the counts at each character of single pieces."""
        out = []
        for p in pieces:
            if p[0] == "'":
                out.append(self._steps(p))
                continue
            raw = p.encode()
            own = self.piece(raw)
            if len(raw) != len(p):
                at, ends = 0, array("i")
                for c in p:
                    at += len(c.encode())
                    ends.append(own[at - 1])
                own = ends
            out.append(_differences(own))
        return out

    def _steps(self, text: str) -> bytes:
        return _differences(self.counts(text))

    def _parts(self, some: list[str]) -> list[bytes]:
        return [self._steps(p) for p in some]

    def prefixes(self, texts: list[str]) -> Iterator[np.ndarray]:
        """For each text, the token count at every prefix: entry i is that of the first i characters.

        In most texts the steps are those of their pieces, one after the other. Texts with longer white space or a
        special string are gone through part by part, as there a prefix may be split otherwise than the whole.
        """
        odd = [bool(_RUN.search(t) or (self.special and self.special.search(t))) for t in texts]
        by_part = self.parts([t for t, o in zip(texts, odd, strict=True) if o])
        by_piece = self.pieces([t for t, o in zip(texts, odd, strict=True) if not o])
        for o in odd:
            steps = np.frombuffer(b"".join(next(by_part if o else by_piece)), np.int32)
            out = np.zeros(len(steps) + 1, np.int32)
            np.cumsum(steps, out=out[1:])
            yield out


def _differences(own: list[int] | array) -> bytes:
    """The steps from count to count, from 0 on, as 32-bit integers."""
    if len(own) > ALONE:
        return np.diff(np.asarray(own, np.int32), prepend=np.int32(0)).tobytes()
    return array("i", map(sub, own, [0, *own[:-1]])).tobytes()


@lru_cache(2)
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


def fits(prefix: np.ndarray, budget: int) -> int:
    """The characters of the longest prefix of up to ``budget`` tokens."""
    if prefix[-1] <= budget:
        return len(prefix) - 1
    return int(np.flatnonzero(prefix <= budget)[-1])


def _count(path: str, pattern: str, limit: int, store: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, pattern)
        for batch in batches:
            for i, j, texts in text_blocks(batch.column(1)):
                n, size, fit, kept = [], [], [], []
                for t, prefix in zip(texts, c.prefixes(texts), strict=True):
                    n.append(int(prefix[-1]))
                    size.append(len(t.encode()))
                    fit.append(fits(prefix, limit))
                    if store:
                        kept.append(prefix.astype("<i4").tobytes())
                columns = [batch.column(0).slice(i, j - i), *(pa.array(x, pa.int64()) for x in (size, n)), pa.array([x > limit for x in n], pa.bool_()), pa.array(fit, pa.int64())]
                names = ["id", "n_bytes", "n_tokens", "over_limit", "fit_chars"]
                if store:
                    columns.append(pa.array(kept, pa.binary()))
                    names.append("prefix_counts")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = 1024, text: str = "text", row_id: str = "doc_id", store: bool = False) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit, fit_chars (of the longest prefix within the limit).

    With ``store``, prefix_counts holds the count at every prefix as little-endian 32-bit integers; :func:`fits`
    answers any budget from it.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col(row_id).alias("id"), F.col(text).cast("string").alias("text"))
    long = T.LongType()
    fields = [T.StructField("id", docs.schema["id"].dataType), T.StructField("n_bytes", long), T.StructField("n_tokens", long), T.StructField("over_limit", T.BooleanType()), T.StructField("fit_chars", long)]
    if store:
        fields.append(T.StructField("prefix_counts", T.BinaryType()))
    return docs.mapInArrow(_count(path, pattern, limit, store), T.StructType(fields)).withColumnRenamed("id", row_id)
