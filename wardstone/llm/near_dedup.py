"""Near-duplicate groups: a multi-index Hamming join of MinHash signatures, completed by bins, confirmed on full shingle sets.

A text's set is the distinct five-word shingles (ASCII lower case, ASCII white space). Its signature
is 120 symbols of b = 12 bits, each the folded minimum of one hash over the set. The first 60 symbols
form 12 chunks of five. Two signatures that differ in up to 23 of these 60 symbols have, by the
pigeonhole principle, a chunk with at most one differing symbol; so each chunk is indexed five times,
each time with one symbol left out, and every such pair shares one of its 60 keys. (A pair of
similarity 0.85 differs in nine symbols on average; more than 23 come about once in a million.)

Symbols are a matter of chance, so the rest has an exact index beside it. Sets of similarity t differ in at most
D = (1 - t) / (1 + t) * (|A| + |B|) shingles. One hash deals the shingles into k > D bins, k by the size of the set; at most D
bins differ, so some bin holds the same shingles in both, and the digest of a bin's shingles is a key; see bins(). Every
pair that meets the threshold shares a key of one index or the other; no key is left out and no bucket is capped.

From sets to links, without all pairs of a bucket and without any cap:

1. Equal sets meet first (one aggregation); only one representative of each goes on, and only if it can have a partner:
   similar sets share so many of their smallest fingerprints that a set whose own are found in too few others has none (see
   lowest()). Both indexes hold what remains.
2. In each bucket every member is held against one pivot (in several rounds with other pivots, if asked
   for). Pairs that cannot meet the threshold, by their sizes or by the parities of their shingles (see differ()), are left
   out, all others are confirmed on the full sets. After that, members of one component need no further comparison.
   Parities are 1,024 for all sets, and for pairs of larger sets, which these don't tell apart, as many as the sets have
   shingles; so full sets are moved for pairs that are nearly similar enough.
3. What is left in a bucket - members of different components - is compared in tiles of bounded size, each
   pair at the first symbol key that it shares only, and at bins if it shares none; a tile gives the links that connect
   its members.

Defined results: null and empty texts, and texts without a word, have an empty set and are linked
with nothing. Rows without an id form no links (component null, kept). Rows that repeat an id and a set are one
node; an id with several sets is a node for each, and only the rows of a component's first node are kept.
distinct() takes null and repeated ids too: it decides on rows by id and text, and of a group exactly one row stays
(ids before null ones). The smallest id of a group stays. An empty table gives an empty result.
A ``percent`` that no index over all 24 chunks answers surely enough (below 66) is a ValueError; see indexed().
Other columns, of whatever name, are neither read nor changed.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache, partial
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import U64, blocks, buffers, mix, shingles
from ._rows import numbered, unique
from ._store import drop, ship, written
from .components import components

SYMBOLS, BITS, PER_CHUNK = 120, 12, 5
CHUNKS = SYMBOLS // PER_CHUNK
#: Chunks that are indexed at least, and the share of pairs at the very threshold that may be left to the bins.
INDEXED, MISSED = 12, 1e-6
#: Parities a set is told by, and how often its shingles are dealt anew while too many bins stay empty.
PARITIES, DEALS = 1024, 4
#: One in so many of a set's shingles is asked for in other sets.
ASKED = 20


def indexed(percent: int) -> int:
    """How many chunks are indexed: at least 12, and as many as leave a pair of just that similarity to the bins
    less often than once in a million (at 85: 4 in 10^10; at 80: once in 10^7)."""
    q = 1 - percent / 100
    kept = (1 - q) ** PER_CHUNK + PER_CHUNK * q * (1 - q) ** (PER_CHUNK - 1)
    for k in range(INDEXED, CHUNKS + 1):
        if (1 - kept) ** k <= MISSED:
            return k
    raise ValueError(f"a similarity of {percent} % is too low for this index")


def differ(total, percent: int):
    """In how many shingles two sets of that similarity, of ``total`` shingles together, can differ at most.

    Each shingle that differs turns one parity, so sets whose parities differ in more cannot be that similar.
    """
    return total - 2 * -(-percent * total // (100 + percent))


def lowest(grams: np.ndarray, percent: int) -> np.ndarray:
    """The smallest fingerprints of a sorted set: as many as may differ, and one in 20 more.

    If two sets of n and m share c >= percent of each, the first j that they share are among the smallest n - c + j and m - c + j.
    So a set with a partner finds one in 20 of the smaller one's number, and one more, in other sets' smallest; see asked().
    """
    n = len(grams)
    fewest = -(-percent * n // 100)
    return grams[: n - fewest + 1 + n // ASKED] if fewest < n or 100 * n // percent > n else grams[:0]


def asked(n, percent: int):
    """In how many of its smallest fingerprints a set of n (number or Column) that has a partner meets other sets at least."""
    hundredths = percent * n + 99
    return 1 + (hundredths - hundredths % (100 * ASKED)) / (100 * ASKED)


_LOWS = [1]


def _low(n: int) -> int:
    """The smallest size of the class that n belongs to; a class's largest is 5/4 of its smallest."""
    while _LOWS[-1] <= n:
        _LOWS.append(_LOWS[-1] * 5 // 4 + 1)
    return _LOWS[bisect_right(_LOWS, n) - 1]


@lru_cache(maxsize=None)
def _dealt(low: int, percent: int) -> tuple[int, int]:
    """(bins, most bins that differ) for pairs whose larger set is of that class: enough bins that seldom too many are empty."""
    most, least = 2 * (low * 5 // 4) * (100 - percent) // (100 + percent), -(-percent * low // 100)
    k = most + 2
    while k < 8 * low:
        none, one = exp(-least / k), least / k * exp(-least / k)
        if k - most > k * none + 3 * (k * none * (1 - none - one)) ** 0.5:
            break
        k += 1
    return k, most


def bins(grams: np.ndarray, first: np.ndarray, second: np.ndarray, percent: int) -> np.ndarray:
    """The keys of a set's bins, for partners at least as large and for those of its class.

    Of k bins at most ``most`` differ, so a set with more than ``most`` bins that aren't empty shares one of these with each
    partner. A set with fewer is dealt again by another hash, for partners that have too few as well; if all deals fail, each
    of its shingles is a key. Sets whose partners can only be equal (these have met before) have no keys.
    ``first`` and ``second`` are two hashes of the shingles.
    """
    out = []
    low = _low(max(1, len(grams)))
    while low <= 100 * len(grams) // percent:
        (k, most), this, low = _dealt(low, percent), low, low * 5 // 4 + 1
        if not most:
            continue
        for deal in range(DEALS):
            h = mix(grams ^ mix(np.array([2001 + deal], np.uint64))) if deal else first
            digest = np.zeros(k, np.uint64)
            np.add.at(digest, ((h >> U64(32)) * U64(k) >> U64(32)).astype(np.int64), second)
            full = np.flatnonzero(digest)
            out.append(mix(digest[full] ^ mix(full.astype(np.uint64) + U64((this * (DEALS + 1) + deal) << 32))))
            if len(full) > most:
                break
        else:
            out.append(mix(second ^ mix(np.array([(this * (DEALS + 1) + DEALS) << 32], np.uint64))))
    return np.concatenate(out) | U64(1) if out else np.zeros(0, np.uint64)


def parities(grams: np.ndarray, many: int = PARITIES) -> np.ndarray:
    """For each of 1,024 (or another power of two) classes of shingles whether the set holds an odd number of them, as packed bits."""
    odd = np.bincount((mix(grams) & U64(many - 1)).astype(np.int64), minlength=many) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide(grams: np.ndarray) -> np.ndarray:
    """A set's parities for at least as many classes as it has shingles; none if those are the 1,024 that each set has."""
    return parities(grams, 1 << (len(grams) - 1).bit_length()) if len(grams) > PARITIES else np.zeros(0, np.int64)


def _nearer(x: np.ndarray, y: np.ndarray, total: int, percent: int) -> bool:
    """Whether sets of ``total`` shingles together can be that similar by their wide parities."""
    if not len(x) or not len(y):
        return True
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):  # a class of half as many is two of these
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) <= differ(total, percent)


_SECOND = U64(0x5851F42D4C957F2D)
_A = (mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64)) >> U64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(1001, SYMBOLS + 1001, dtype=np.uint64)) >> U64(32)).astype(np.uint32)


def signature(grams: np.ndarray) -> np.ndarray:
    """The packed signature of a set: one 60-bit integer for each chunk."""
    h = (grams >> U64(32)).astype(np.uint32)
    low = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 4096):
        np.minimum(low, (h[None, i : i + 4096] * _A[:, None] + _B[:, None]).min(axis=1), out=low)
    s = ((low * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint64).reshape(CHUNKS, PER_CHUNK)
    return (s << (np.arange(PER_CHUNK, dtype=np.uint64) * U64(BITS))).sum(axis=1, dtype=np.uint64).astype(np.int64)


def _sign(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, n_shingles, h1, h2, lowest)."""
    for batch in batches:
        data, off = buffers(batch.column(1))
        for i, j in blocks(off):
            found = list(shingles(data[off[i] : off[j]], off[i : j + 1] - off[i]))
            low = _lists([lowest(g, percent) for g in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *_named(found), low], ["id", "n", "h1", "h2", "lowest"])


def _named(found: list[np.ndarray]) -> list[pa.Array]:
    """What names a set in the table of equal sets: its size and two sums."""
    h1 = np.array([mix(g).sum(dtype=np.uint64) for g in found], np.uint64).view(np.int64)
    h2 = np.array([mix(g ^ _SECOND).sum(dtype=np.uint64) for g in found], np.uint64).view(np.int64)
    return [pa.array([len(g) for g in found], pa.int64()), pa.array(h1), pa.array(h2)]


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows).view(np.int64)))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, rep, ...) sorted by key and rep -> one for each key and rep, of the keys that have several reps."""
    last, given = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        key, rep = (rows.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (rep[1:] != rep[:-1])]))
        same = key[at[1:]] == key[at[:-1]]
        give = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        known, give[0] = given, give[0] and not given
        yield rows.take(pa.array(at[give]))
        last, given = rows.slice(int(at[-1]), 1), bool(give[-1] or (known and len(at) == 1))


def _marked(marks: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (..., at) whose bit is set, without at."""
    for batch in batches:
        at = batch.column(batch.num_columns - 1).to_numpy()
        yield batch.filter(pa.array((marks[at >> 6] >> (at & 63)) & 1 == 1)).select(list(range(batch.num_columns - 1)))


def _index(chunks: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, sig) -> (key, place, rep) for each indexed chunk and each symbol left out."""
    hole = ~(U64((1 << BITS) - 1) << (np.arange(PER_CHUNK, dtype=np.uint64) * U64(BITS)))
    place = np.arange(chunks * PER_CHUNK, dtype=np.uint64)
    for batch in batches:
        for k in range(0, batch.num_rows, 2000):
            part = batch.slice(k, 2000)
            n = part.num_rows
            sig = part.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(n, CHUNKS)[:, :chunks]
            keys = mix((sig[:, :, None] & hole).reshape(n, -1) ^ (place << U64(60)) ^ mix(place + U64(1))) & ~U64(1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys.reshape(-1).view(np.int64)),
                    pa.array(np.tile(place.astype(np.int32), n)),
                    part.column(0).take(pa.array(np.repeat(np.arange(n), chunks * PER_CHUNK))),
                ],
                ["key", "place", "rep"],
            )


def _packed(percent: int, found: list[np.ndarray]) -> list[pa.Array]:
    """Sets as sorted fingerprints in bytes, their parities, signatures, bins and wide parities."""
    sig = [signature(g) if len(g) else np.zeros(CHUNKS, np.int64) for g in found]
    keys = [bins(g, mix(g), mix(g ^ _SECOND), percent) for g in found]
    sets, more = (pa.array([f(g).tobytes() for g in found], pa.binary()) for f in (np.asarray, wide))
    return [sets, _lists([parities(g) for g in found]), _lists(sig), _lists(keys), more]


def _sets(percent: int, marks: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, at) -> (id, n, set, odd, sig, bins, wide) of marked rows."""
    for batch in _marked(marks, batches):
        data, off = buffers(batch.column(1))
        for i, j in blocks(off):
            found = list(shingles(data[off[i] : off[j]], off[i : j + 1] - off[i]))
            size = pa.array([len(g) for g in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), size, *_packed(percent, found)], ["rep", "n", "set", "odd", "sig", "bins", "wide"])


def _hashed_sets(percent: int, marks: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, at) -> (id, n, h1, h2, set, odd, sig, bins, wide) of marked rows: with what names sets in the table of equal ones."""
    for batch in _marked(marks, batches):
        data, off = buffers(batch.column(1))
        for i, j in blocks(off):
            found = list(shingles(data[off[i] : off[j]], off[i : j + 1] - off[i]))
            columns = [batch.column(0).slice(i, j - i), *_named(found), *_packed(percent, found)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "h1", "h2", "set", "odd", "sig", "bins", "wide"])


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b, set_a, set_b) -> the pairs whose sets are similar enough."""
        for batch in batches:
            sets = ([np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(c)] for c in (2, 3))
            keep = [_similar(x, y, percent) for x, y in zip(*sets, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return confirm


def _nearer_pairs(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n, m, wide_a, wide_b) -> the pairs that can be similar enough by their wide parities."""
    for batch in batches:
        total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
        odd = ([np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(c)] for c in (4, 5))
        keep = [_nearer(x, y, t, percent) for x, y, t in zip(*odd, total.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _may(x: str, y: str, n: str, m: str, percent: int) -> Column:
    """Whether sets of n and m shingles can be that similar, by their sizes and their parities x and y."""
    total, turned = F.col(n) + F.col(m), F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    both = F.floor((percent * total + 99 + percent) / F.lit(100 + percent))
    sizes = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    return sizes & (F.aggregate(turned, F.lit(0), lambda c, v: c + v) <= total - 2 * both)


def _pairs(place: np.ndarray, rep: np.ndarray, label: np.ndarray, block: np.ndarray, n: np.ndarray, odd: np.ndarray, sig: np.ndarray, cross: bool, percent: int):
    """Of one tile, the index pairs of different components that may be similar enough and share no symbol key before this one
    (in a tile of a bin: none at all)."""
    order = np.argsort(block, kind="stable")
    cut = int((block[order] == block.min()).sum()) if cross else len(order)
    left, right = order[:cut], order[cut:] if cross else order
    if not len(left) or not len(right):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    apart = label[left][:, None] != label[right][None, :]
    apart &= rep[left][:, None] < rep[right][None, :] if not cross else rep[left][:, None] != rep[right][None, :]
    apart &= 100 * np.minimum(n[left][:, None], n[right][None, :]) >= percent * np.maximum(n[left][:, None], n[right][None, :])
    i, j = np.nonzero(apart)
    chunk, hole = divmod(int(place[0]), PER_CHUNK) if place[0] >= 0 else (sig.shape[1], 0)
    lowest = np.uint64(sum(1 << (BITS * p) for p in range(PER_CHUNK)))
    out = []
    for k in range(0, len(i), 1 << 16):
        x, y = left[i[k : k + (1 << 16)]], right[j[k : k + (1 << 16)]]
        may = np.bitwise_count(odd[x] ^ odd[y]).sum(axis=1, dtype=np.int64) <= differ(n[x] + n[y], percent)
        x, y = x[may], y[may]
        d = sig[x] ^ sig[y]
        for bits in (6, 3, 1, 1):
            d |= d >> bits
        c = np.bitwise_count(d & lowest)
        ok = (c[:, :chunk] > 1).all(axis=1)
        if hole:
            ok &= c[:, chunk] == 1
        out.append((x[ok], y[ok]))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2


def _runs(table: pa.Table, names: tuple[str, ...]) -> list[tuple[int, int]]:
    """Where rows of equal keys begin and end."""
    ids = [table.column(c).to_numpy() for c in names]
    new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1
    return list(zip([0, *new.tolist()], [*new.tolist(), table.num_rows], strict=True))


def _whole_tiles(batches: Iterator[pa.RecordBatch], least: int = 4096) -> Iterator[pa.Table]:
    """Rows sorted by (key, i, j) -> tables that hold whole tiles."""
    names = ("key", "i", "j")
    rest: pa.Table | None = None
    for batch in batches:
        rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if rest.num_rows >= least:
            last = [rest.column(c)[-1].as_py() for c in names]
            same = np.all([rest.column(c).to_numpy() == v for c, v in zip(names, last, strict=True)], axis=0)
            cut = int(np.argmax(same))
            if cut:
                yield rest.slice(0, cut).combine_chunks()
            rest = rest.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def _tiles(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each tile that have a candidate partner in it: (key, i, j, at, rep, partners).

    ``at`` numbers a tile's members; partners are numbers of members that come later.
    """
    for t in _whole_tiles(batches):
        i_, j_ = (t.column(c).to_numpy() for c in ("i", "j"))
        place, rep, label, block = (t.column(c).to_numpy() for c in ("place", "rep", "label", "block"))
        n, odd, sig = t.column("n").to_numpy(), *(t.column(c).combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1).view(np.uint64) for c in ("odd", "s"))
        rows, at, partners = [], [], []
        for a, b in _runs(t, ("key", "i", "j")):
            x, y = _pairs(place[a:b], rep[a:b], label[a:b], block[a:b], n[a:b], odd[a:b], sig[a:b], bool(i_[a] != j_[a]), percent)
            if not len(x):
                continue
            x, y = np.minimum(x, y), np.maximum(x, y)
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            members = np.unique(np.concatenate([x, y]))
            cut = np.searchsorted(x, members), np.searchsorted(x, members, side="right")
            rows.append(members + a)
            at.append(members)
            partners += [y[u:v].astype(np.int32).tobytes() for u, v in zip(*cut, strict=True)]
        if rows:
            picked = t.select(["key", "i", "j"]).take(pa.array(np.concatenate(rows))).combine_chunks()
            columns = [picked.column(c).combine_chunks() for c in ("key", "i", "j")]
            reps = t.column("rep").take(pa.array(np.concatenate(rows))).combine_chunks()
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(at).astype(np.int32)), reps, pa.array(partners, pa.binary())], ["key", "i", "j", "at", "rep", "partners"])


def _nearer_tiles(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of tiles with their sizes and wide parities -> those that keep a partner, as of _tiles()."""
    for t in _whole_tiles(batches, 256):
        at, n, partners = t.column("at").to_numpy(), t.column("n").to_numpy(), t.column("partners").to_pylist()
        odd = [np.frombuffer(v, np.uint64) for v in t.column("wide").to_pylist()]
        kept = np.zeros(t.num_rows, bool)
        for a, b in _runs(t, ("key", "i", "j")):
            for k in range(a, b):
                later = np.frombuffer(partners[k], np.int32)
                place = a + np.searchsorted(at[a:b], later)
                near = np.array([_nearer(odd[k], odd[m], int(n[k] + n[m]), percent) for m in place], bool)
                partners[k] = later[near].tobytes()
                kept[place[near]] = True
                kept[k] |= near.any()
        if kept.any():
            t = t.select(["key", "i", "j", "at", "rep"]).append_column("partners", pa.array(partners, pa.binary()))
            yield from t.filter(pa.array(kept)).combine_chunks().to_batches()


def _confirm_tiles(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of tiles with their sets -> links that connect what the tile's similar pairs connect.

    A pair whose members are connected already, by links confirmed in the tile, needs no further look.
    """
    for t in _whole_tiles(batches, 256):
        at, rep = t.column("at").to_numpy(), t.column("rep")
        sets, partners = t.column("set").to_pylist(), t.column("partners").to_pylist()
        left, right = [], []
        for a, b in _runs(t, ("key", "i", "j")):
            place = {int(v): k for k, v in enumerate(at[a:b], a)}
            grams = [np.frombuffer(v, np.uint64) for v in sets[a:b]]
            root = list(range(b - a))

            def find(k: int, root: list[int] = root) -> int:
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            for k in range(a, b):
                for v in np.frombuffer(partners[k], np.int32).tolist():
                    m = place[v]
                    p, q = find(k - a), find(m - a)
                    if p != q and _similar(grams[k - a], grams[m - a], percent):
                        root[max(p, q)] = min(p, q)
                        left.append(k)
                        right.append(m)
        if left:
            yield from pa.table([rep.take(pa.array(left)), rep.take(pa.array(right))], ["a", "b"]).combine_chunks().to_batches()


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


class _Links:
    """Confirms candidate pairs on full sets and keeps the links found so far."""

    def __init__(self, sets: DataFrame, kind: T.DataType, percent: int):
        self.sets, self.kind, self.percent, self.found = sets, kind, percent, []

    def confirm(self, pairs: DataFrame) -> bool:
        schema = T.StructType([T.StructField("a", self.kind), T.StructField("b", self.kind)])
        pairs = written(pairs, "near")
        b = _among(self.sets.select(F.col("rep").alias("b"), F.col("n").alias("m"), F.col("wide").alias("wide_b")), pairs, "b")
        a = _among(self.sets.select(F.col("rep").alias("a"), "n", F.col("wide").alias("wide_a")), pairs, "a")
        rows = pairs.join(b, "b").join(a, "a").select("a", "b", "n", "m", "wide_a", "wide_b")
        pairs, all_pairs = written(rows.mapInArrow(partial(_nearer_pairs, self.percent), schema), "nearer"), pairs
        b = _among(self.sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b")), pairs, "b")
        a = _among(self.sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a")), pairs, "a")
        rows = pairs.join(b, "b").join(a, "a").select("a", "b", "set_a", "set_b")
        found = self.keep(rows.mapInArrow(_confirm(self.percent), schema))
        drop(pairs, all_pairs)
        return found

    def keep(self, links: DataFrame) -> bool:
        links = written(links, "links")
        if links.isEmpty():
            return False
        self.found.append(links)
        return True

    def labels(self) -> DataFrame:
        edges = self.found[0]
        for more in self.found[1:]:
            edges = edges.union(more)
        return components(edges)


def groups(docs: DataFrame, text: str = "text", row_id: str = "doc_id", percent: int = 85, rounds: int = 1) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable), kept.

    Two rows are linked if 100 * |intersection| >= percent * |union| of their shingle sets.
    ``rounds`` pivots are tried in each bucket before what is left is compared in tiles.
    """
    spark, chunks = docs.sparkSession, indexed(percent)
    ship(spark)
    docs = docs.select(F.col(row_id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = docs.schema["id"].dataType
    field = lambda name, t: T.StructField(name, t)
    long = T.LongType()
    signed = T.StructType([field("id", kind), field("n", long), field("h1", long), field("h2", long), field("lowest", T.ArrayType(long))])
    whole = written(docs.mapInArrow(partial(_sign, percent), signed), "smallest")
    prep = written(whole.select("id", "n", "h1", "h2"), "named")

    equal = written(prep.filter("n > 0 AND id IS NOT NULL").groupBy("h1", "h2", "n").agg(F.min("id").alias("rep")), "sets")
    several = not unique(prep.filter("n > 0 AND id IS NOT NULL"), "id")
    if several:
        equal = written(equal.withColumnRenamed("rep", "owner").sort("owner", "h1", "h2", "n").withColumn("rep", F.monotonically_increasing_id()), "sets")
        kind = long

    low = whole.filter("n > 0 AND id IS NOT NULL").select(F.explode("lowest").alias("key"), F.col("h1").alias("rep"))
    met = _several(low).groupBy(F.col("rep").alias("h1")).agg(F.count("*").alias("met"))
    involved = equal.join(met, "h1").filter(F.col("met") >= asked(F.col("n"), percent))
    involved = written(involved.select("rep", *(["h1", "h2", "n", "owner"] if several else [])), "involved")
    drop(whole)

    packed = [field("set", T.BinaryType()), *(field(c, T.ArrayType(long)) for c in ("odd", "sig", "bins")), field("wide", T.BinaryType())]
    # Texts are not shuffled: a bit tells an involved id. Others that meet one by chance have no partner, or their equal's.
    marks = _marks(involved, "owner" if several else "rep")
    texts = docs.filter("id IS NOT NULL").select("id", "text", F.pmod(F.xxhash64("id"), F.lit(64 * len(marks))).alias("at"))
    if several:
        nodes = involved.withColumnRenamed("owner", "id")
        sets = texts.mapInArrow(partial(_hashed_sets, percent, marks), T.StructType([field("id", docs.schema["id"].dataType), field("n", long), field("h1", long), field("h2", long), *packed]))
        sets = sets.join(nodes, ["id", "n", "h1", "h2"]).groupBy("rep").agg(F.min("n").alias("n"), F.min("set").alias("set"), *(F.min_by(c, "set").alias(c) for c in ("odd", "sig", "bins", "wide")))
    else:
        sets = texts.mapInArrow(partial(_sets, percent, marks), T.StructType([field("rep", kind), field("n", long), *packed]))
    sets = written(sets, "involved-sets")
    signs = written(sets.select("rep", "n", "odd", F.slice("sig", 1, chunks).alias("s")), "involved-signs")

    members = sets.select("rep", "sig").mapInArrow(partial(_index, chunks), T.StructType([field("key", long), field("place", T.IntegerType()), field("rep", kind)]))
    dealt = sets.select(F.explode("bins").alias("key"), "rep", F.lit(-1).alias("place"))
    buckets = written(_several(members.select("key", "rep", "place").union(dealt)), "buckets")

    links, labels, live = _Links(sets, kind, percent), None, buckets
    for r in range(rounds):
        pivot = live.groupBy("key").agg(F.min_by("rep", F.xxhash64("rep", F.lit(r))).alias("a"))
        pairs = live.join(pivot, "key").filter("a <> rep")
        pairs = pairs.select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct()
        if labels is not None:
            pairs = _apart(pairs, labels)
        near = pairs.join(signs.select(F.col("rep").alias("b"), F.col("odd").alias("y"), F.col("n").alias("m")), "b")
        near = near.join(signs.select(F.col("rep").alias("a"), F.col("odd").alias("x"), "n"), "a")
        near = near.filter(_may("x", "y", "n", "m", percent)).select("a", "b")
        if links.confirm(near):
            drop(*([labels] if labels is not None else []))
            labels = links.labels()
        live, old = _live(buckets, labels), live
        drop(*([old] if r else []))
        if live.isEmpty():
            break
    else:
        if links.keep(_left(live, signs, sets, kind, percent)):
            drop(*([labels] if labels is not None else []))
            labels = links.labels()

    if labels is None:
        merged = equal.withColumn("component", F.col("rep"))
    else:
        merged = equal.join(labels, equal.rep == labels.node, "left").withColumn("component", F.coalesce("label", "rep"))
    merged = merged.select("h1", "h2", "n", "component", (F.col("rep") == F.col("component")).alias("first"))
    if several:
        owners = equal.select(F.col("rep").alias("component"), "owner")
        merged = merged.join(owners, "component").select("h1", "h2", "n", F.col("owner").alias("component"), "first")
    # Empty sets have no partner here; under their ids' hashes they don't gather in one task.
    spread = F.when(F.col("n") > 0, F.col("h1")).otherwise(F.xxhash64("id")).alias("h1")
    out = prep.select("id", "n", spread, "h2").join(merged, ["h1", "h2", "n"], "left")
    component = F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component"))).otherwise(F.col("id"))
    out = out.select("id", "n", component.alias("component"), F.coalesce("first", F.lit(True)).alias("first"))
    drop(buckets, involved, signs, sets, live, *links.found)
    return out.select(
        F.col("id").alias(row_id),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        (F.col("id").eqNullSafe(F.col("component")) & (F.col("first") | F.col("id").isNull())).alias("kept"),
    )


def _several(rows: DataFrame) -> DataFrame:
    """The different rows (key, rep, ...) of keys that have several reps, by one sort."""
    return rows.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(_shared, rows.schema)


def _marks(ids: DataFrame, name: str) -> np.ndarray:
    """A bit for each id, by its hash; 16 times as many bits as ids, up to 32 MB."""
    words = min(1 << 22, 1 + ids.count() // 4)
    at = ids.select(F.pmod(F.xxhash64(name), F.lit(64 * words)).alias("at"))
    rows = at.groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits")).toArrow()
    marks = np.zeros(words, np.int64)
    marks[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return marks


def _among(table: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The rows of a table whose id is marked, so that a join need not move all others (few unmarked ones stay)."""
    marks = _marks(ids, name)
    rows = table.withColumn("at", F.pmod(F.xxhash64(name), F.lit(64 * len(marks))))
    return rows.mapInArrow(partial(_marked, marks), table.schema)


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs that no link joins so far."""
    la = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    lb = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    out = pairs.join(lb, "b", "left").join(la, "a", "left")
    return out.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def _live(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The buckets of three or more members that hold more than one component (pairs have met their pivot)."""
    if labels is None:
        rows = buckets.withColumn("label", F.col("rep"))
    else:
        rows = buckets.select("key", "place", "rep").join(labels, buckets.rep == labels.node, "left")
        rows = rows.select("key", "place", "rep", F.coalesce("label", "rep").alias("label"))
    mixed = rows.groupBy("key").agg(F.count("*").alias("c"), F.min("label").alias("x"), F.max("label").alias("y"))
    return written(rows.join(mixed.filter("c > 2 AND x <> y").select("key"), "key"), "live")


def _left(live: DataFrame, signs: DataFrame, sets: DataFrame, kind: T.DataType, percent: int) -> DataFrame:
    """Links between members of one bucket that are in different components: candidates may be similar by sizes and parities.

    A bucket is dealt into blocks of some 1,024 members and a million shingles, and each pair of blocks is a tile.
    First the tiles' members meet with their signatures; those that have a candidate partner (each pair counts at
    the first key that it shares) meet again with their wide parities, tile by tile, and what is left with their sets.
    No pair is a row.
    """
    field = lambda name, t: T.StructField(name, t)
    weight = live.join(signs.select("rep", "n"), "rep").groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    blocks_ = F.greatest(F.ceil(F.col("size") / 1024), F.ceil(F.col("total") / 1_000_000)).cast("int")
    rows = live.join(weight.select("key", blocks_.alias("blocks")), "key")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep", "key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    rows = rows.select("key", "i", "j", "place", "rep", "label", "block").join(signs, "rep")
    rows = rows.select("key", "i", "j", "place", "rep", "label", "block", "n", "odd", "s")
    tiles = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")
    whole, number = T.LongType(), T.IntegerType()
    schema = T.StructType([field("key", whole), field("i", number), field("j", number), field("at", number), field("rep", kind), field("partners", T.BinaryType())])
    members = written(tiles.mapInArrow(partial(_tiles, percent), schema), "candidates")
    odd = members.join(_among(sets.select("rep", "n", "wide"), members, "rep"), "rep").select("key", "i", "j", "at", "rep", "partners", "n", "wide")
    odd = odd.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "at")
    members = written(odd.mapInArrow(partial(_nearer_tiles, percent), schema), "nearer")
    full = members.join(_among(sets.select("rep", "set"), members, "rep"), "rep").select("key", "i", "j", "at", "rep", "partners", "set")
    full = full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "at")
    return full.mapInArrow(partial(_confirm_tiles, percent), T.StructType([field("a", kind), field("b", kind)]))


def distinct(docs: DataFrame, text: str = "text", row_id: str = "doc_id", percent: int = 80) -> DataFrame:
    """The rows of which one of each group stays, with their own columns."""
    if unique(docs, row_id):
        gone = groups(docs, text, row_id, percent).filter(~F.col("kept")).select(F.col(row_id).alias("nd_gone")).distinct()
        return docs.join(gone, docs[row_id] == gone["nd_gone"], "left_anti")
    rows = numbered(docs, "nd_row", text, row_id)
    gone = groups(rows, text, "nd_row", percent).filter(~F.col("kept")).select(F.col("nd_row").alias("nd_gone")).distinct()
    return rows.join(gone, rows["nd_row"] == gone["nd_gone"], "left_anti").dropDuplicates(["nd_row"]).drop("nd_row")
