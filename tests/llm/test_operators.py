"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import hashlib
import random
import warnings
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from wardstone.llm import _bytes, _pieces, bpe, chat, components, exact_dedup, lang_id, mixing, near_dedup, quality, token_counts, token_files, topk

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
LONG = "word and another " * 20_000
TEXTS = ["", None, "a", "  a \n\n b  ", "don't we'll 'l", "<|endoftext|> x<|endo", "日本語 テキスト　é", "x" * 3000, "aaaa" * 50, "\t\tif:\n    y = 1\n\n\n", "!!!??? ''ll", "🙂🙂 a🙂", LONG, "a", "a b c d e f g h i j"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    made = ["".join(r.choice(" \n\t'abcdelrstv!?.é日<|>0 9 ") for _ in range(r.randint(1, 50))) for _ in range(300)]
    return TEXTS + made


@pytest.fixture(scope="module")
def docs(spark, texts):
    """With columns that clash with those the operators add."""
    rows = [(i, t, None if i % 3 else "en", "s", 1, "k", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int, keep_id string, id int")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def empty(docs):
    return docs.filter("false")


def test_exact(docs, texts):
    import re

    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for t in texts]
    got = by_id(exact_dedup.mark(docs))
    for i, n in enumerate(norm):
        same = [j for j, m in enumerate(norm) if m == n]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (same[0], len(same), i == same[0])
        assert got[i].text_sha256 == hashlib.sha256(n.encode()).hexdigest()
    kept = exact_dedup.distinct(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, r in sorted(got.items()) if r.kept]
    assert exact_dedup.mark(empty(docs)).count() == 0


def test_exact_merges_sorted_runs(docs):
    """Both sides of each exchange are sorted by the key, and merged in that order."""
    runs = docs.select(F.col("doc_id").alias("xd_id"), *exact_dedup._keys(F.col("text"), F.col("doc_id"), 512))
    plan = exact_dedup._up(runs.select("xd_run", *exact_dedup.KEY, F.col("xd_id").alias("xd_keep"), F.lit(1).alias("xd_n")), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate") >= 2 and plan.count("Sort [") >= 2 and "HashAggregate" not in plan


def test_exact_null_ids(spark):
    df = spark.createDataFrame([(None, "x"), (None, "x"), (4, "y"), (None, "y"), (4, "y")], "doc_id long, text string")
    got = sorted((r.text_sha256, str(r.doc_id), r.kept, r.group_size) for r in exact_dedup.mark(df).collect())
    assert sorted(g[2] for g in got) == [False, True, True, True, True] and {g[3] for g in got} == {2, 3}


def _components(texts, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(k) for k in range(len(sets))], [len(s) for s in sets]


@pytest.mark.parametrize("percent", [85, 70])
def test_near_against_brute_force(spark, percent):
    r = random.Random(5)
    base = [[f"w{r.randint(0, 5000)}" for _ in range(r.randint(8, 150))] for _ in range(12)]
    made = ["", None, "one two", "One  two", "a b c d e", "A B C D E"]
    for b in base:
        for _ in range(25):
            c = list(b)
            for _ in range(r.randint(0, max(1, len(c) // 25))):
                c[r.randrange(len(c))] = f"w{r.randint(0, 5000)}"
            made.append(" ".join(c))
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    want, size = _components(made, percent)
    got = by_id(near_dedup.groups(df, percent=percent))
    assert [got[i].component_id for i in range(len(made))] == want
    assert [got[i].n_shingles for i in range(len(made))] == size
    assert all(got[i].kept == (want[i] == i) for i in got)


def test_near_edges(spark, docs):
    assert near_dedup.groups(empty(docs)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (9, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_dedup.groups(df).collect())
    assert got == [("2", "2", True), ("2", "2", True), ("3", "2", False), ("9", "9", True), ("None", "None", True)]
    assert near_dedup.distinct(docs).columns == docs.columns


def test_index_follows_the_similarity(spark):
    assert [near_dedup.indexed(p) for p in (95, 85, 80)] == [12, 12, 12] and 12 < near_dedup.indexed(75) < near_dedup.indexed(66) <= near_dedup.CHUNKS
    with pytest.raises(ValueError, match="too low"):
        near_dedup.groups(spark.createDataFrame([(1, "a")], "doc_id long, text string"), percent=65)


def test_near_very_long_texts(spark):
    r = random.Random(9)
    long = [f"w{r.randint(0, 50000)}" for _ in range(60_000)]
    rows = [(5, " ".join(long)), (3, " ".join([*long[:-3], "other"])), (4, " ".join(long[::-1])), (6, "z" * 400_000), (7, "z" * 400_000)]
    got = by_id(near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: g.component_id for i, g in got.items()} == {5: 3, 3: 3, 4: 4, 6: 6, 7: 6}


def _unlucky():
    """A text, and one with 34 further words (similarity 200/234) chosen so that nearly every MinHash symbol differs."""
    r = random.Random(3)
    text = [f"w{r.randint(0, 50000)}" for _ in range(204)]
    sign = lambda w: near_dedup.signature(next(_bytes.shingles(*_bytes.buffers(pa.array([" ".join(w)])))))
    lowest = np.uint64(sum(1 << (near_dedup.BITS * k) for k in range(near_dedup.PER_CHUNK)))

    def differing(x, y):
        d = (x ^ y).view(np.uint64)
        for bits in (6, 3, 1, 1):
            d |= d >> np.uint64(bits)
        return np.bitwise_count(d & lowest)

    own, more = sign(text), list(text)
    for _ in range(34):
        more.append(max((f"x{r.randint(0, 50000)}" for _ in range(60)), key=lambda w: int(np.minimum(differing(own, sign([*more, w])), 2).sum())))
    return " ".join(text), " ".join(more), differing(own, sign(more))


def test_near_links_pairs_whatever_their_symbols(spark):
    a, b, counts = _unlucky()
    assert counts.sum() > 35 and (counts[: near_dedup.INDEXED] > 1).all()
    (c, _), (c2, _) = _near_copies(2)
    more = [" ".join([*a.split(), *(f"y{k}" for k in range(36))])]
    df = spark.createDataFrame(list(enumerate([b, a, c, c2, *more])), "doc_id long, text string")
    want, _ = _components([b, a, c, c2, *more], 85)
    got = by_id(near_dedup.groups(df))
    assert want[:4] == [0, 0, 2, 2] and [got[i].component_id for i in range(5)] == want


@pytest.mark.parametrize("percent", [66, 80, 85, 95])
def test_bins_and_parities_hold_for_every_similar_pair(percent):
    r = np.random.default_rng(percent)
    keys = lambda s: set(near_dedup.bins(s, _bytes.mix(s), _bytes.mix(s ^ np.uint64(77)), percent).tolist())
    for _ in range(1500):
        both = int(r.integers(1, 60)) if r.random() < 0.7 else int(r.integers(60, 900))
        out = both * 100 // percent - both
        left = int(r.integers(0, out + 1))
        pool = r.integers(0, 2**63, both + out, dtype=np.uint64)
        x, y = pool[: both + left], np.concatenate([pool[:both], pool[both + left :]])
        assert near_dedup._similar(np.sort(x), np.sort(y), percent)
        assert out == 0 or keys(x) & keys(y)
        turned = int(np.bitwise_count((near_dedup.parities(x) ^ near_dedup.parities(y)).view(np.uint64)).sum())
        assert turned <= out <= near_dedup.differ(len(x) + len(y), percent)
        met = len(set(near_dedup.lowest(np.sort(x), percent).tolist()) & set(near_dedup.lowest(np.sort(y), percent).tolist()))
        assert out == 0 or met >= max(near_dedup.asked(len(x), percent), near_dedup.asked(len(y), percent))


@pytest.mark.parametrize("percent", [66, 80, 85, 95])
def test_wide_parities_hold_for_every_similar_pair_and_part_others(percent):
    r = np.random.default_rng(percent)
    for both in (900, 1020, 1500, 1990, 2040, 4090, 9000):
        out = both * 100 // percent - both
        for left in (0, out // 2, out):
            pool = r.integers(0, 2**63, both + out, dtype=np.uint64)
            x, y = np.sort(pool[: both + left]), np.sort(np.concatenate([pool[:both], pool[both + left :]]))
            odd = [near_dedup.wide(s).view(np.uint64) for s in (x, y)]
            assert near_dedup._similar(x, y, percent) and near_dedup._nearer(*odd, len(x) + len(y), percent) and near_dedup._nearer(*odd[::-1], len(x) + len(y), percent)
    x, y = (np.sort(r.integers(0, 2**63, n, dtype=np.uint64)) for n in (9000, 8600))
    assert not near_dedup._nearer(*(near_dedup.wide(s).view(np.uint64) for s in (x, y)), 17_600, percent)


def test_sets_are_moved_for_pairs_that_are_nearly_similar(spark, monkeypatch):
    """Long texts that share passages share bins, and 1,024 parities don't tell them apart; their sets stay where they are."""
    r = random.Random(8)
    word = lambda: f"w{r.randint(0, 10**9)}"
    passages = [[word() for _ in range(60)] for _ in range(20)]
    texts = []
    for _ in range(16):
        parts = [*passages, *([word() for _ in range(140)] for _ in range(20))]
        r.shuffle(parts)
        texts.append([w for p in parts for w in p])
    texts.append([*texts[3][:-90], *(word() for _ in range(90))])
    made, moved, among = [" ".join(t) for t in texts], [], near_dedup._among

    def counted(table, ids, name):
        if any(c.startswith("set") for c in table.columns):
            moved.append(ids.count())
        return among(table, ids, name)

    monkeypatch.setattr(near_dedup, "_among", counted)
    want, size = _components(made, 85)
    got = by_id(near_dedup.groups(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")))
    assert want[16] == 3 and [(got[i].component_id, got[i].n_shingles) for i in range(17)] == list(zip(want, size, strict=True))
    assert 2 <= sum(moved) <= 4


def test_bins_dealt_again(monkeypatch):
    """Sets that leave too many bins empty find each other by further deals, at last by single shingles."""
    r = np.random.default_rng(2)
    calls = []
    for deals in (4, 1):
        monkeypatch.setattr(near_dedup, "DEALS", deals)
        for _ in range(3000):
            pool = r.integers(0, 2**63, 7, dtype=np.uint64)
            x, y = (near_dedup.bins(s, _bytes.mix(s), _bytes.mix(s ^ np.uint64(77)), 85) for s in (pool[:6], pool))
            calls.append(len(x) > 3)
            assert set(x.tolist()) & set(y.tolist())
    assert any(calls)


def test_keys_of_several_owners():
    r = np.random.default_rng(4)
    rows = sorted(zip(r.integers(0, 300, 2000).tolist(), r.integers(0, 6, 2000).tolist(), strict=True))
    rows += [(300, 1)] * 40 + [(301, k // 9) for k in range(40)]
    owners = {k: {o for q, o in rows if q == k} for k, _ in rows}
    for size in (1, 2, 7, 5000):
        batches = [pa.RecordBatch.from_arrays([pa.array([v[c] for v in rows[i : i + size]], pa.int64()) for c in (0, 1)], ["key", "rep"]) for i in range(0, len(rows), size)]
        got = [tuple(v.values()) for b in near_dedup._shared(iter(batches)) for v in b.to_pylist()]
        assert sorted(got) == sorted((k, o) for k, found in owners.items() if len(found) > 1 for o in found)


def test_signature_guarantee():
    """Signatures that differ in up to 23 of the indexed symbols share a key."""
    r = np.random.default_rng(1)
    for _ in range(200):
        a = r.integers(0, 4096, 60)
        b = a.copy()
        where = r.choice(60, 23, replace=False)
        b[where] = (b[where] + 1) % 4096
        x, y = a.reshape(12, 5), b.reshape(12, 5)
        assert ((x != y).sum(axis=1) <= 1).any()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


def test_bpe(docs, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.encode(docs, RANKS, P.PATTERN, keep_ids=True))
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode(empty(docs), RANKS, P.PATTERN).count() == 0


def test_token_counts(docs, texts):
    lib = Tokenizer.from_file(JSON)
    n = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    got = by_id(token_counts.count_tokens(docs, JSON, P.PATTERN, limit=6, store=True))
    for i, t in enumerate(texts):
        t = t or ""
        prefix = np.frombuffer(got[i].prefix_counts, "<i4")
        assert got[i].n_tokens == n(t) == prefix[-1] and got[i].n_bytes == len(t.encode()) and got[i].over_limit == (n(t) > 6)
        if len(t) < 60:
            assert prefix.tolist() == [n(t[:k]) for k in range(len(t) + 1)]
            assert got[i].fit_chars == max(k for k in range(len(t) + 1) if n(t[:k]) <= 6)
    assert token_counts.count_tokens(empty(docs), JSON, P.PATTERN).count() == 0


def test_counts_of_one_long_piece():
    r = random.Random(6)
    pieces = ["".join(r.choice("abcdeéthingr日") for _ in range(9000)), "x" * 6000, "🙂" * 3000, " " * 5000 + "a"]
    c, library = token_counts.Counter(JSON, P.PATTERN), Tokenizer.from_file(JSON)
    for p, prefix in zip(pieces, c.prefixes(pieces), strict=True):
        assert len(prefix) == len(p) + 1 and len(c.last) < 30_000
        for k in (0, 1, 77, len(p) // 3, len(p) // 2, len(p)):
            assert prefix[k] == len(library.encode(p[:k], add_special_tokens=False).ids)


def test_counts_refuse_settings_they_do_not_follow():
    import json

    with open(JSON, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"] = {k: v for k, v in spec["model"].items() if k not in ("vocab", "merges")}
    token_counts._check(spec)
    plain = dict(spec["added_tokens"][0], content="<x>", special=False)
    for odd in ({"normalizer": {"type": "NFC"}}, {"added_tokens": [plain]}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}):
        with pytest.raises(ValueError, match="not counted"):
            token_counts._check(spec | odd)


@pytest.mark.parametrize("pattern", [P.PATTERN, None])
def test_token_files(docs, texts, pattern):
    lib = Tokenizer.from_file(JSON)
    manifest = token_files.write(docs, JSON, 2, pattern)
    got, at = by_id(token_files.read(manifest, docs.schema["doc_id"].dataType)), 0
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens) == (at, len(ids)) and got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    shard = manifest.first()
    ids, offsets, rows = token_files.mapped(shard.path, shard.width)
    assert ids.dtype == np.dtype("<u2") and len(offsets) == len(rows) + 1 and int(offsets[-1]) == len(ids) == shard.tokens
    none = token_files.write(empty(docs), JSON, 2, pattern)
    assert token_files.read(none, docs.schema["doc_id"].dataType).count() == 0


def test_token_files_order_repeated_and_null_ids(spark):
    rows = [(2, "b"), (None, "n"), (1, "y"), (2, "a"), (1, "x"), (1, "x")]
    manifest = token_files.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), JSON, 2, P.PATTERN)
    got = sorted(token_files.read(manifest, T.LongType()).collect(), key=lambda r: r.start)
    lib, at = Tokenizer.from_file(JSON), 0
    for r, (i, t) in zip(got, [(None, "n"), (1, "x"), (1, "x"), (1, "y"), (2, "a"), (2, "b")], strict=True):
        ids = [*lib.encode(t, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_words_of_plain_texts_encode_alike():
    """Cut at spaces and line feeds or split by the pattern: the library's ids either way."""
    r = random.Random(5)
    some = [" ", "\n", " a", "b,", "'s", "1", "é", "中", "!", "\n\n", "x\ny", " word", "\t"]
    texts = ["", " ", "\n", "\n\n the", *("".join(r.choice(some) for _ in range(r.randint(1, 12))) for _ in range(6000))]
    lib, want = token_files.Library(JSON, P.PATTERN), Tokenizer.from_file(JSON)
    assert sum(map(_pieces.is_plain, texts)) > 1000
    for t, raw in zip(texts, lib.encode(texts, 2), strict=True):
        assert np.frombuffer(raw, "<u2").tolist() == [*want.encode(t, add_special_tokens=False).ids, 2], t


def test_tables_of_pieces_are_bounded_in_bytes():
    table = _pieces.Remembered(lambda t: [t], lambda ps: [p.encode() for p in ps], most=10_000)
    for k in range(200):
        assert b"".join(next(table([f"{k}" * 300]))) == f"{k}".encode() * 300
        assert table.size <= 10_000 + 900 and table.size == sum(2 * len(p) + _pieces.ENTRY for p in table.seen)


def test_chat_messages_without_an_id_are_no_named_ones(spark):
    rows = [(1, k, "message", m, "user", t) for k, (m, t) in enumerate([(None, "A"), ("row 0", "B"), ("row 1", "C"), (None, "D")])]
    events = spark.createDataFrame(rows, "conv_id long, seq long, op string, msg string, role string, text string").coalesce(1)
    assert [r.text for r in chat.fold(events).orderBy("pos").collect()] == ["A", "B", "C", "D"]


def test_chat_fold_and_reading_back(spark):
    rows = [
        (1, 0, "message", "u", "user", "hi"), (1, 1, "message", "a", "assistant", ""), (1, 2, "delta", "a", None, "he"), (1, 3, "delta", "a", None, "llo"),
        (1, 4, "message", "b", "user", "gone"), (1, 5, "regenerate", "a", None, None), (1, 6, "delta", "a", None, "new \\# <x>"), (1, 7, "edit", "u", None, "hey"),
        (2, None, "message", None, None, None), (None, 0, "message", None, "assistant", "</turn>\n### user: x"),
    ]
    events = spark.createDataFrame(rows, "conv_id long, seq long, op string, msg string, role string, text string")
    got = {}
    for r in chat.fold(events).orderBy("conv_id", "pos").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {1: [("user", "hey"), ("assistant", "new \\# <x>")], 2: [("", "")], None: [("assistant", "</turn>\n### user: x")]}
    rendered = chat.render(chat.fold(events))
    back = {r.conv_id: r for r in chat.read_back(rendered).collect()}
    assert back[1].loss_chars == len("new \\# <x>") and back[None].loss_sha256 == hashlib.sha256(b"</turn>\n### user: x").hexdigest()
    assert back[1].turns_sha256 == hashlib.sha256(b"user\nhey\nassistant\nnew \\# <x>\n").hexdigest()
    assert chat.read_back(chat.render(chat.fold(events.filter("false")))).count() == 0


def test_chat_edges(spark):
    """Very long texts, equal sequence numbers, rows given twice, and columns of clashing names."""
    long = "é\\# </turn>\n" * 40_000
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", long), (1, 1, "assistant", long), (2, 0, "user", ""), (2, 1, "assistant", "ok")]
    table = spark.createDataFrame([(c, t, r, x, "p", 7) for c, t, r, x in rows], "conv_id long, turn long, role string, text string, pos string, cut int")
    got = by_id(chat.read_back(chat.format_conversations(table)), "conv_id")
    assert got[1].n_turns == 3 and got[1].loss_chars == 2 * len(long) and got[1].loss_sha256 == hashlib.sha256((2 * long).encode()).hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(f"user\nhi\nassistant\n{long}\nassistant\n{long}\n".encode()).hexdigest()
    assert (got[2].n_turns, got[2].loss_chars) == (2, 2)


def test_topk(spark):
    r = np.random.default_rng(2)
    vecs = [(i, r.normal(size=8).round(1).astype(float).tolist()) for i in range(300)]
    vecs[7] = (7, vecs[3][1])
    bad = [(1000, None), (1001, [1.0, None] * 4), (1002, [float("nan")] * 8), (1003, [float("inf")] * 8), (1004, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in vecs + bad], "vec_id long, embedding array<float>, score string")
    got = topk.search(df, F.col("vec_id") % 50 == 0, k=5).collect()
    q = {i: np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(np.int64) for i, v in vecs}
    for i in range(0, 300, 50):
        want = sorted(((-int(q[i] @ q[j]), j) for j in q if j != i))[:5]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == i] == [(j, -s) for s, j in want]
    assert topk.search(df.filter("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_repeated_ids(spark):
    """A repeated id is a candidate as often as it stands there, never its own; its least vector asks."""
    rows = [(0, [1.0, 0.0]), (0, [2.0, 0.0]), (1, [3.0, 0.0]), (1, [3.0, 0.0]), (2, [1.0, 1.0])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=3, scale=1)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == [(0, 1, 1, 3), (0, 2, 1, 3), (0, 3, 2, 1)]


def test_topk_tiles_are_narrow_and_whole():
    for most, width in ((127, 1), (128, 2), (1 << 15, 4), (1 << 31, 8)):
        m = np.array([[most, -most, 0], [1, 2, 3]], np.int64)
        raw = topk.narrow(m)
        assert len(raw) == 6 * width and (topk.wide(raw, 2, 3) == m).all()
    assert topk.wide(topk.narrow(np.zeros((3, 0), np.int64)), 3, 0).shape == (3, 0)


def test_topk_large_components():
    a, b = np.full((1, 4), 1 << 40), np.full((1, 4), 1 << 30)
    assert topk.product(a, b)[0, 0] == (1 << 63) - 1
    assert topk.product(a, np.full((1, 4), 3))[0, 0] == 12 << 40


WORDS = {"xx": ["the", "and", "of", "this", "with"], "yy": ["der", "und", "von", "nicht", "mit"], "zz": ["le", "et", "de", "dans", "avec"]}


def test_language(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(WORDS[v]) for _ in range(r.randint(3, 60))), v) for i, v in enumerate(r.choice(list(WORDS)) for _ in range(300))]
    rows += [(1000, None, None), (1001, "", "xx"), (1002, "12 !!", None), (1003, "THE AND OF", None), (1004, WORDS["yy"][0] * 3000, None)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, lang string, score int, id int")
    model = lang_id.learn(df, F.col("doc_id") % 4 != 2)
    got = by_id(lang_id.identify(df, model))
    held = [x for x in rows[:300] if x[0] % 4 == 2]
    assert sum(got[i].lang_pred == v for i, _, v in held) >= 0.97 * len(held)
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3 and got[1003].lang_pred == "xx"
    assert all(0 <= g.score <= 1 for g in got.values())
    kept = lang_id.accepted(df, model)
    assert kept.columns == df.columns and {1000, 1001, 1002}.isdisjoint(r.doc_id for r in kept.collect())
    assert lang_id.learn(df.filter("lang = 'none'"), F.lit(True)) is None
    assert {r.lang_pred for r in lang_id.identify(df, None).collect()} == {"und"}
    assert lang_id.identify(empty(df), model).count() == 0


def test_codewords_differ():
    for n in (1, 2, 5, 7, 8, 20):
        code = lang_id.codewords(n)
        assert len(np.unique(code, axis=0)) == n


def _quality_rows():
    r = random.Random(4)
    good = lambda: " ".join(r.choice("lorem ipsum dolor sit amet elit sed".split()) for _ in range(r.randint(6, 14))) + "."
    bad = lambda: " ".join(f"{w.upper()}!!" for w in good().split())
    rows, labels = [], []
    for i in range(200):
        q = int(r.random() < 0.7)
        rows.append((i, "\n".join([good()] + [(good if q else bad)() for _ in range(r.randint(1, 6))])))
        labels.append((i, q, int(q and r.random() < 0.3)))
        if labels[-1][2]:
            rows[-1] = (i, rows[-1][1] + " nasty vile nasty")
    return rows, labels


def test_quality(spark):
    rows, labels = _quality_rows()
    rows += [(900, None), (901, ""), (902, "\n \n"), (903, "A!! " * 30_000)]
    docs = spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.learn(docs, marks, F.col("doc_id") % 5 != 0)
    got = by_id(quality.classify(docs, model))
    held = [(i, q) for i, q, _ in labels if i % 5 == 0]
    assert sum(got[i].predicted == q for i, q in held) >= 0.95 * len(held)
    assert got[900].score == got[901].score == got[902].score and got[903].predicted == 0 and all(0 <= g.score <= 1 for g in got.values())
    assert {r.score for r in quality.classify(docs, quality.learn(docs, empty(marks), F.lit(True))).collect()} == {0.5}
    assert quality.classify(empty(docs), model).count() == 0


def test_chain_marginals_against_enumeration():
    import itertools

    r = np.random.default_rng(3)
    field = quality.Field(np.zeros((1, 10)), r.normal(size=(2, 2)))
    u = r.normal(size=(5, 2))
    text = np.array([0, 0, 0, 0, 1])
    p, _ = field.marginals(text, u)
    total, one = 0.0, np.zeros(4)
    for s in itertools.product((0, 1), repeat=4):
        w = np.exp(sum(u[k, v] for k, v in enumerate(s)) + sum(field.trans[a, b] for a, b in itertools.pairwise(s)))
        total += w
        one += w * np.array(s)
    assert np.allclose(p[:4], one / total) and np.isclose(p[4], np.exp(u[4, 1]) / np.exp(u[4]).sum())


def test_mixing(spark):
    rows, labels = _quality_rows()
    rows += [(900, None), (901, "")]
    docs = spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, rate string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = mixing.learn(docs, marks)
    targets = {"quality=1 toxic=0": 0.7, "quality=1 toxic=1": 0.2, "quality=0 toxic=0": 0.1, "unknown": 3.0}
    got = mixing.mix(docs, model, targets).collect()
    p, t, w = (np.array([getattr(g, n) for g in got]) for n in ("posterior", "n_tokens", "rate"))
    total = (p * (t * w)[:, None]).sum(axis=0)
    want = np.array([targets[n] for n in model.names])
    assert (w >= 0).all() and np.allclose(total / total.sum(), want / want.sum(), atol=1e-3)
    assert {g.doc_id: g.n_tokens for g in got}[900] == 0 and len(got) == len(rows)
    assert {r.rate for r in mixing.mix(docs, mixing.learn(docs, empty(marks)), targets).collect()} == {1.0}
    assert mixing.mix(empty(docs), model, targets).count() == 0


def test_scores_of_repeated_rows_are_equal(spark):
    """Rows given twice are scored twice, alike; equal texts tie."""
    rows, labels = _quality_rows()
    docs = spark.createDataFrame([(i, t, "xx" if i % 2 else None) for i, t in rows + rows[:20] + [(500, rows[3][1])]], "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scored = quality.classify(docs, quality.learn(docs, marks, F.lit(True))).collect()
    named = lang_id.identify(docs, lang_id.learn(docs, F.lit(True))).collect()
    model = mixing.learn(docs, marks)
    mixed = mixing.mix(docs, model, {n: 1.0 for n in model.names}).collect()
    for found, value in ((scored, "score"), (named, "score"), (mixed, "rate")):
        of = {}
        for r in found:
            of.setdefault(r.doc_id, []).append(r[value])
        assert len(found) == len(rows) + 21 and all(len(of[i]) == 2 and of[i][0] == of[i][1] for i in range(20)) and of[500][0] == of[3][0]


def _scarce(toxic=0.01, junk=0.1, n=3000):
    """Texts of equal lengths with few toxic ones, and their labels."""
    r = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        u = r.random()
        kind = (1, 1) if u < toxic else (0, 0) if u < toxic + junk else (1, 0)
        words = [r.choice("lorem ipsum dolor sit amet elit sed".split()) for _ in range(24)]
        if kind == (1, 1):
            words[:6] = ["nasty", "vile"] * 3
        rows.append((i, " ".join(f"{w.upper()}!!" for w in words) if kind == (0, 0) else " ".join(words) + "."))
        labels.append((i, *kind))
    return rows, labels


def test_mixing_scarce_domain_keeps_clean_whole(spark, tmp_path):
    """With 1 % toxic tokens and a target of 4 %, no clean document goes for it."""
    import corpus_pipeline

    rows, labels = _scarce()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = {r.doc_id for r in corpus_pipeline.mixing_stage(spark, docs, str(tmp_path)).collect()}
    kept = lambda q, t: sum(i in left for i, *v in labels if v == [q, t]) / sum(v == [q, t] for _, *v in labels)
    assert kept(1, 0) >= 0.99 and kept(1, 1) >= 0.8 and kept(0, 0) < 0.6


def test_mixing_copies_are_rates_on_average(spark):
    """Toxic documents a little beyond their target share go by chance; their realised share is that target."""
    from wardstone.llm.queries import CLEAN, TARGETS

    rows, labels = _scarce(toxic=0.045)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = mixing.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = mixing.mix(docs, model, TARGETS, whole=CLEAN)
    count = mixing.copies(F.col("rate"), F.col("doc_id"))
    mean = got.agg(F.avg(count).alias("c"), F.avg("rate").alias("r")).first()
    assert mean.c == pytest.approx(mean.r, abs=0.01)
    copies = {r.doc_id: r.c for r in got.select("doc_id", count.alias("c")).collect()}
    toxic, clean = ([copies[i] for i, *v in labels if v == kind] for kind in ([1, 1], [1, 0]))
    assert sum(toxic) < 0.93 * len(toxic) and sum(c >= 1 for c in clean) >= 0.99 * len(clean)
    share = {r.domain: r for r in mixing.shares(got, model, TARGETS, count).collect()}
    assert share["quality=1 toxic=1"].target == pytest.approx(0.04) and share["quality=1 toxic=1"].realised < 0.044


def test_mixing_settles_with_a_domain_without_target(spark):
    r = np.random.default_rng(6)
    share = np.array([0.1, 0.02, 0.09, 0.79])
    label = r.choice(4, 4000, p=share)
    z = np.log(share) + 6 * np.eye(4)[label] + r.normal(size=(4000, 4))
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    df = spark.createDataFrame([(int(n), v.tolist()) for n, v in zip(r.integers(20, 400, 4000), p, strict=True)], "n_tokens long, posterior array<double>")
    targets = {"d0": 0.04, "d2": 0.04, "d3": 0.92}
    names = ["d0", "d1", "d2", "d3"]
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        steps = mixing.rates(df, names, targets, whole="d3")
    t = np.array([x.n_tokens for x in df.collect()], float)
    w, got = mixing._fold(p, steps), (t[:, None] * p).sum(axis=0)
    aim = np.minimum(np.array([0.04, 0, 0.04, 0.92]) * got[3] / 0.92, got)
    carried = sum(aim[d] / got[d] * (t[:, None] * p)[p.argmax(axis=1) == d, 1].sum() for d in (0, 2, 3))
    want = np.where([True, False, True, True], aim, carried)
    assert 0 < len(steps) < 20 and np.abs((t * w) @ p - want).max() < 1e-5 * t.sum()
    # The nearest rates to 1 that give these totals: w = max(0, 1 - p.v) for one v.
    v, *_ = np.linalg.lstsq(p[w > 0], 1 - w[w > 0], rcond=None)
    assert np.allclose(w, np.maximum(0, 1 - p @ v), atol=1e-6)
    with pytest.warns(RuntimeWarning, match="not settled after 1 steps"):
        assert len(mixing.rates(df, names, targets, whole="d3", most_steps=1)) == 1


def test_repeated_ids_are_learned_from_once(spark):
    """Three labelled ids over thousands of rows: the driver gets three."""
    rows = spark.range(6000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("some words here "), F.col("id").cast("string")).alias("text"))
    marks = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert mixing.learn(rows, marks, most_docs=10).names == ["quality=0 toxic=0", "quality=1 toxic=0", "quality=1 toxic=1"]
    assert quality.learn(rows, marks, F.lit(True), most_docs=10).prior == pytest.approx(2 / 3)


def test_too_many_classes_are_an_error(spark):
    df = spark.range(201).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.concat(F.lit("l"), "id").alias("lang"))
    with pytest.raises(ValueError, match="200 languages"):
        lang_id.learn(df, F.lit(True))
    marks = df.filter("doc_id < 65").select("doc_id", F.col("doc_id").alias("quality"), F.lit(0).alias("toxic"))
    with pytest.raises(ValueError, match="64 domains"):
        mixing.learn(df, marks)


def _near_copies(n):
    """Texts that are no copies of each other, each with a near copy."""
    r = random.Random(12)
    base = [[f"w{r.randint(0, 9000)}" for _ in range(120)] for _ in range(n)]
    return [" ".join(b) for b in base], [" ".join([*b[:-1], "other"]) for b in base]


def test_near_repeated_ids_with_differing_texts(spark):
    (a, b, c, d), (a2, b2, c2, d2) = _near_copies(4)
    rows = [(2, a), (2, b), (5, b2), (1, a2), (7, c), (7, c2), (6, a), (6, d), (8, d2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.groups(df, percent=80).collect())
    assert got == [(1, 1, True), (2, 1, False), (2, 2, True), (5, 2, False), (6, 1, False), (6, 6, True), (7, 7, False), (7, 7, True), (8, 6, False)]
    kept = {(r.doc_id, r.text) for r in near_dedup.distinct(df).collect()}
    assert len(kept) == 4 and {(1, a2), (2, b), (6, d)} < kept and kept - {(1, a2), (2, b), (6, d)} < {(7, c), (7, c2)}


def test_null_and_repeated_ids_are_decided_on_by_row(spark, tmp_path):
    import corpus_pipeline

    exact = spark.createDataFrame([(None, "x"), (None, "x"), (4, "y"), (4, "y"), (None, "y")], "doc_id long, text string")
    assert sorted((r.text, r.doc_id) for r in exact_dedup.distinct(exact).collect()) == [("x", None), ("y", 4)]
    (a, b), (a2, b2) = _near_copies(2)
    near = spark.createDataFrame([(None, a), (None, a2), (None, b), (3, b2), (3, b2)], "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in near_dedup.distinct(near).collect()]
    assert len(kept) == 2 and (3, b2) in kept and ((None, a) in kept or (None, a2) in kept)
    rows, labels = _scarce()
    junk = {i for i, q, _ in labels if not q}
    docs = spark.createDataFrame(rows + [(None, t) for i, t in rows if i in junk], "doc_id long, text string")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = sum(r.doc_id is None for r in corpus_pipeline.mixing_stage(spark, docs, str(tmp_path)).collect())
    assert 0 < left < 0.5 * len(junk)
