"""Token ids as flat files that can be memory-mapped, and reading them back.

Texts are range-partitioned by id and sorted, so that shards in order hold all documents in ascending
order. Each task encodes its partition and writes one shard in the shared folder: ``.ids`` (unsigned
little-endian integers, 16 bits wide if the vocabulary allows, else 32), ``.offsets`` (64-bit offsets of
the documents in the shard, one more than documents) and the row ids beside them. (Ids instead of texts in
the shuffle would need a table of them first, as range bounds are sampled; they are no smaller than texts of
rare words.) A task that runs
again writes its own files; only those it reports are in the manifest. Prefix sums of the shards'
lengths give each shard's base, so a document's place in the whole is base plus offset.

The format's end id is appended to each document. Encoding is the library's, piece by piece: texts are cut
where no token crosses, and a worker remembers the ids of the pieces it has seen.

Defined results: a null text counts as empty and holds the end id only. Rows with one id are ordered by
their text; null ids come first. An empty table gives no shard and an empty result.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._pieces import Remembered, is_plain, plain_words, text_blocks
from ._store import new_path, ship, written

MANIFEST = T.StructType([T.StructField(n, T.LongType()) for n in ("shard", "docs", "tokens")] + [T.StructField("path", T.StringType()), T.StructField("width", T.LongType())])


class Library:
    """The tokenizers library; for byte-level tokenizers on the pieces that its pattern splits texts into."""

    def __init__(self, path: str, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        split = spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.pattern = regex.compile(pattern).findall if pattern and plain else None
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocab.values()) + 1, bool)
        self.spaced[[i for t, i in vocab.items() if t[0] == "\u0120"]] = True
        self.run = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.line = vocab.get("\u010a", -1)
        self.remembered = Remembered(self.pattern, self._encode) if self.pattern else None
        self.words = Remembered(lambda t: plain_words(t)[1:], self._words)

    def _encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, by the library, each by itself."""
        ids = [e.ids for e in self.run(texts, add_special_tokens=False)]
        return self._cut(np.fromiter(chain.from_iterable(ids), f"<u{self.width}"), np.cumsum([0, *map(len, ids)]))

    def _cut(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        raw = ids.tobytes()
        at = (at * self.width).tolist()
        return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def _joined(self, words: list[str], begins: np.ndarray) -> dict[str, bytes]:
        """The ids of words that go to the library in strings of 256: there they are split alike, and the marked tokens begin one."""
        rows = ["".join(words[k : k + 256]) for k in range(0, len(words), 256)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.run(rows, add_special_tokens=False)), f"<u{self.width}")
        first = np.flatnonzero(begins[ids])
        found = self._cut(ids, np.append(first, len(ids))) if len(first) == len(words) else self._encode(words)
        return dict(zip(words, found, strict=True))

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of words of plain texts, a space before all that don't begin with a line feed."""
        full = [w if w[0] == "\n" else " " + w for w in words]
        lines = np.zeros(len(self.spaced), bool)
        lines[self.line] = True
        of = self._joined([w for w in full if w[0] == " "], self.spaced)
        of |= self._joined([w for w in full if w[0] == "\n" and len(w) > 1], lines)
        of["\n"] = self._encode(["\n"])[0]
        return [of[w] for w in full]

    def encode(self, texts: list[str], end: int) -> Iterator[bytes]:
        """The ids of each text and the end id; texts with an added token's string go to the library as they are."""
        last = np.array([end], f"<u{self.width}").tobytes()
        kind = ["whole" if self.pattern is None or any(a in t for a in self.added) else "plain" if is_plain(t) else "odd" for t in texts]
        of = lambda k: [t for t, x in zip(texts, kind, strict=True) if x == k]
        plain = of("plain")
        heads, rest = iter(self._encode([plain_words(t)[0] for t in plain])), self.words(plain)
        found = {"whole": iter(self._encode(of("whole"))), "odd": map(b"".join, self.remembered(of("odd"))) if self.remembered else iter(())}
        for x in kind:
            yield (next(heads) + b"".join(next(rest)) if x == "plain" else next(found[x])) + last


@lru_cache(2)
def library(path: str, pattern: str | None) -> Library:
    return Library(path, pattern)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")
    return fs, path


def _write(folder: str, tokenizer: str, pattern: str | None, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lib = library(tokenizer, pattern)
        shard = TaskContext.get().partitionId()
        uri = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}"
        fs, path = _open(uri)
        out, sizes, ids, kind = None, [], [], None
        for batch in batches:
            for i, j, texts in text_blocks(batch.column(1)):
                if out is None:
                    fs.create_dir(os.path.dirname(path), recursive=True)
                    out = fs.open_output_stream(path + ".ids")
                for raw in lib.encode(texts, end):
                    out.write(raw)
                    sizes.append(len(raw) // lib.width)
                ids.append(batch.column(0).slice(i, j - i))
        if out is None:
            return
        out.close()
        offsets = np.zeros(len(sizes) + 1, "<u8")
        np.cumsum(np.array(sizes, np.uint64), out=offsets[1:])
        with fs.open_output_stream(path + ".offsets") as f:
            f.write(offsets.tobytes())
        kind = ids[0].type
        with fs.open_output_stream(path + ".rows") as f, pa.ipc.new_stream(f, pa.schema([("id", kind)])) as w:
            for a in ids:
                w.write_batch(pa.RecordBatch.from_arrays([a], ["id"]))
        yield pa.RecordBatch.from_pylist([{"shard": shard, "docs": len(sizes), "tokens": int(offsets[-1]), "path": uri, "width": lib.width}], schema=pa.schema([("shard", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64()), ("path", pa.string()), ("width", pa.int64())]))

    return run


def write(docs: DataFrame, tokenizer: str, end: int, pattern: str | None = None, folder: str | None = None, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Encodes and writes all documents; the manifest: shard, docs, tokens, path, width, base.

    With ``pattern``, the split pattern of a byte-level tokenizer, pieces are encoded once and remembered; without it,
    and for all other tokenizers, whole texts go to the library.

    Only the manifest, one row a shard, comes together in one place, for the prefix sums.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or new_path(spark, "token-ids")
    docs = docs.select(F.col(row_id).alias("id"), F.col(text).cast("string").alias("text"))
    ordered = docs.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", "text")
    shards = sorted(written(ordered.mapInArrow(_write(folder, tokenizer, pattern, end), MANIFEST), "manifest").collect(), key=lambda r: r.shard)
    bases = np.concatenate([[0], np.cumsum([r.tokens for r in shards])]).tolist()
    rows = [(r.shard, r.docs, r.tokens, r.path, r.width, int(b)) for r, b in zip(shards, bases, strict=False)]
    return spark.createDataFrame(rows, T.StructType([*MANIFEST.fields, T.StructField("base", T.LongType())]))


def mapped(uri: str, width: int) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """A shard's ids, offsets and row ids; memory-mapped where the folder is a mounted one."""
    fs, path = _open(uri)
    if urlparse(uri).scheme in ("", "file"):
        ids = np.memmap(path + ".ids", f"<u{width}", "r") if os.path.getsize(path + ".ids") else np.zeros(0, f"<u{width}")
        offsets = np.memmap(path + ".offsets", "<u8", "r")
    else:
        with fs.open_input_file(path + ".ids") as f:
            ids = np.frombuffer(f.read(), f"<u{width}")
        with fs.open_input_file(path + ".offsets") as f:
            offsets = np.frombuffer(f.read(), "<u8")
    with fs.open_input_stream(path + ".rows") as f:
        rows = pa.ipc.open_stream(f).read_all()
    return ids, offsets, rows


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in batch.to_pylist():
            ids, offsets, rows = mapped(s["path"], s["width"])
            key = rows.column("id").combine_chunks()
            offsets = offsets.astype(np.int64)
            for k in range(0, len(key), 4096):
                o = offsets[k : k + 4097]
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(o[:-1], o[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([key.slice(k, 4096), pa.array(o[:-1] + s["base"]), pa.array(np.diff(o)), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])


def read(manifest: DataFrame, kind: T.DataType, row_id: str = "doc_id") -> DataFrame:
    """One row per document, from the files: id, start, n_tokens, ids_crc32 (of its ids as 32-bit integers)."""
    spark = manifest.sparkSession
    ship(spark)
    long = T.LongType()
    schema = T.StructType([T.StructField("id", kind), T.StructField("start", long), T.StructField("n_tokens", long), T.StructField("ids_crc32", long)])
    n = max(1, manifest.count())
    return manifest.repartition(n).mapInArrow(_read, schema).withColumnRenamed("id", row_id)
