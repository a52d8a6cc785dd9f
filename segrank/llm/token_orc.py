"""Token ids as ORC: a row a document with its ids as an integer array.

ORC gives what a training reader needs without a format of our own: run-length encoded integers, stripes that are
read in parallel, row indexes and a Bloom filter on doc_id, so that a lookup by id reads a few row groups only.
Documents are range-partitioned by doc_id and sorted, so file order is document order, and ``row_no`` (part << 33 | row)
states that order in the file itself.

Encoding looks the words between white space up in a cache of pieces that the tokenizers library fills; most words are one
piece, the others are split as the tokenizer's own pre-tokenizer does (no piece has white space).  Texts with characters for which the two could differ (outside printable Latin-1, or with a
special token's string) are encoded whole by the library.

Defined cases: a null or empty text is the end id alone; null ids come first; rows that repeat an id are ordered by
text and each is written; an empty table gives an empty folder and an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segrank.llm.common import bounded_batches, read_table, scratch, stored

END_ID = 2
CACHE_PIECES = 400_000
PART_BYTES = 32 << 20      # text in a file
# The pre-tokenizer's pattern, its letters and numbers written out for lower-cased printable Latin-1.
LETTERS, NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa1-\xff]*")
# How the byte-level pre-tokenizer spells the two UTF-8 bytes of the characters from 0xa1 on: bytes that print stand for themselves,
# the others take the characters from 256 on, in order.
SPELT = {b: chr(b) for b in [*range(0x21, 0x7f), *range(0xa1, 0xad), *range(0xae, 0x100)]}
SPELT |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in SPELT)}
BYTE_LEVEL = {c: "".join(SPELT[b] for b in chr(c).encode()) for c in range(0xa1, 0x100)}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Known(dict):
    """The ids of pieces, and through them those of lower-cased words between white space.  Only pieces are kept."""

    def __init__(self, ids_of):
        self.ids_of = ids_of

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():
            return self.piece(word)
        core, last = word[:-1], word[-1]
        if core.isalpha() and not last.isalnum():      # letters and one other character: two pieces
            return self[core] + self[last]
        pieces = PIECES.findall(word)
        return b"".join(map(self.piece, pieces)) if len(pieces) > 1 else self.piece(word)

    def piece(self, p: str) -> bytes:
        ids = self.get(p)
        if ids is None:
            ids = self.ids_of(p)
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[p] = ids
        return ids


class Encoder:
    """Texts to packed little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, end_id: int):
        import os
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize      # the property makes a new object each time
        self.end = np.array([end_id], dtype="<u4").tobytes()
        self.known = Known(self.new_piece)
        probe = PIECES.findall(bytes([*range(0x20, 0x7f), *range(0xa1, 0x100)]).decode("latin-1").lower() + " the 's x")
        self.direct = dict(self.by_model(probe)) == dict(self.pieces(probe))

    def by_model(self, new: list[str]) -> Iterator[tuple[str, bytes]]:
        """The ids of pieces from the tokenizer's model itself, which skips what was done already: normalising and splitting."""
        tokenize = self.tokenize
        for p in new:
            yield p, array("I", [t.id for t in tokenize(p if p.isascii() else p.translate(BYTE_LEVEL))]).tobytes()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes()
                for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def pieces(self, new: list[str]) -> Iterator[tuple[str, bytes]]:
        """The ids of pieces, many in one call: with spaces between them, each is a word of its own to the pre-tokenizer."""
        for k in range(0, len(new), 500):
            part = new[k:k + 500]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, word = np.array(found.ids, dtype="<u4"), np.array(found.word_ids)
            if word[-1] != len(part) - 1:
                yield from zip(part, self.whole(part))
                continue
            edge = np.searchsorted(word, np.arange(len(part) + 1))
            yield from ((p, ids[a:b].tobytes()) for p, a, b in zip(part, edge[:-1].tolist(), edge[1:].tolist()))

    def new_piece(self, p: str) -> bytes:
        if self.direct:
            return array("I", [t.id for t in self.tokenize(p if p.isascii() else p.translate(BYTE_LEVEL))]).tobytes()
        return next(self.pieces([p]))[1]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, the end id last."""
        get = self.known.__getitem__
        for t in texts:
            if t and "<|" not in t and PLAIN.fullmatch(t):
                yield b"".join(map(get, t.lower().split())) + self.end
            else:
                yield (self.whole([t])[0] if t else b"") + self.end


@lru_cache(maxsize=1)
def worker_encoder(path: str, end_id: int) -> Encoder:
    """A Python worker's encoder: its pieces serve all tasks that the worker runs."""
    return Encoder(path, end_id)


def encoded(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, row_no, ids) from (doc_id, row_no, text)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path, end_id)
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                packed = list(encoder.encode(part.column("text").to_pylist()))
                offsets = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
                ids = pa.array(np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row_no"), pa.ListArray.from_arrays(pa.array(offsets), ids)],
                    ["doc_id", "row_no", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "row_no", "text").mapInArrow(
        run, "doc_id long, row_no long, ids array<int>")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, part_bytes: int = PART_BYTES) -> None:
    """Writes ``docs`` (doc_id, text) as ORC files in ascending doc_id order."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes), docs.sparkSession.sparkContext.defaultParallelism)
    ordered = (docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
               .withColumn("row_no", F.monotonically_increasing_id()))
    (encoded(ordered, tokenizer, end_id).write
     .option("compression", "zstd").option("orc.stripe.size", 64 << 20).option("orc.row.index.stride", 1000)
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01).orc(path))


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The written rows; with ``doc_ids``, stripes and row groups without them are skipped by the files' metadata."""
    rows = spark.read.schema("doc_id long, row_no long, ids array<int>").orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def id_digests(rows: DataFrame) -> DataFrame:
    """(doc_id, row_no, n_tokens, ids_crc32) of (doc_id, row_no, ids)."""
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            offsets = lists.offsets.to_numpy()
            raw = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(raw[a:z]) for a, z in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("row_no"), pa.array(np.diff(offsets).astype(np.int64)),
                 pa.array(crc, pa.int64())], ["doc_id", "row_no", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, row_no long, n_tokens long, ids_crc32 long")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the files.  Starts are a running sum within a file plus the
    sum of the files before it; only the sums, a row a file, meet in one task."""
    rows = stored(id_digests(read_tokens(spark, path)), "token-index").withColumn("part", F.shiftright("row_no", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = (rows.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
            .select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("base")))
    within = Window.partitionBy("part").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
            .join(F.broadcast(base), "part")
            .select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32"))


def tokenize(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes ``docs`` to a new folder in the shared folder and gives its index, read from the files."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens-orc")
    write_tokens(docs, path, tokenizer or tokenizer_path())
    return token_index(spark, path)


def op8_token_ids(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    return tokenize(read_table(spark, sf_dir, "documents"))
