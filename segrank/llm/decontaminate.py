"""Benchmark decontamination with a broadcast hash set of normalised n-grams.

Documents are scanned once a block of the benchmark; a block's n-gram table has a fixed size bound, so a large
benchmark means more blocks and never a larger broadcast.  The scan works on whole UTF-8 buffers in numpy: word
hashes from a prefix polynomial, window hashes from the word hashes, a bitmap of the benchmark's hashes as a first
filter, and the words themselves compared for all that pass.

Defined cases: null or empty texts have no words, so documents have zeros and items match nothing; an empty benchmark
leaves every document clean; a window or an item that repeats counts once; null item ids count as items that have no
id and stand first, as empty strings; rows that repeat an id give a row each; other columns are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segrank.llm.common import CHUNK_BYTES, bounded_batches, read_table, text_chunks

WINDOW = 10
BLOCK_BYTES = 16 << 20   # benchmark text in a broadcast block
SPANS = "array<struct<first:int,last:int>>"

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[:128] = False
IS_WORD[48:58] = True
IS_WORD[97:123] = True

BYTE_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
WORD_BASE = np.uint64(0xC2B2AE3D27D4EB4F | 1)
BITMAP_BITS = 22


INVERSE = np.uint64(pow(int(BYTE_BASE), -1, 1 << 64))
TABLE = 1 << 21          # positions that a prefix sum covers
POWERS: list[np.ndarray] = []


def powers() -> list[np.ndarray]:
    """Powers of the byte base and of its inverse, made once a process."""
    if not POWERS:
        for base in (BYTE_BASE, INVERSE):
            out = np.full(TABLE + 1, base, dtype=np.uint64)
            out[0] = 1
            POWERS.append(np.multiply.accumulate(out))
    return POWERS


def word_bounds(low: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a lower-cased byte buffer."""
    edge = np.diff(is_word[low].view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each word that depends on its bytes only: the sum of byte * base ** (distance from its start), as the
    difference of two prefix sums.  A buffer longer than the table is taken in parts, cut between words."""
    parts, k = [], 0
    power, inverse = powers()
    while k < len(starts):
        at = int(starts[k])
        to = max(k + 1, int(np.searchsorted(ends, at + TABLE, side="right")))
        if ends[to - 1] - at > TABLE:        # one word, longer than the table
            h = np.zeros(1, dtype=np.uint64)
            for x in range(int(ends[k]) - 1, at - 1, -1):
                h = h * BYTE_BASE + np.uint64(low[x]) + np.uint64(1)
        else:
            own = low[at:int(ends[to - 1])].astype(np.uint64)
            own += np.uint64(1)
            own *= power[:len(own)]
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own, dtype=np.uint64)])
            s, e = starts[k:to] - at, ends[k:to] - at
            h = (total[e] - total[s]) * inverse[s]
        parts.append(h)
        k = to
    h = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of ``n`` words (windows over a document's end included)."""
    count = len(words) - n + 1
    h = np.zeros(max(count, 0), dtype=np.uint64)
    for k in range(n if count > 0 else 0):
        h *= WORD_BASE
        h += words[k:k + count]
    return h


class Windows:
    """The n-grams of a block of items: for each window length a bitmap and hash -> [(words, item numbers)]."""

    def __init__(self, items: list[tuple[str | None, bytes]], n: int):
        self.ids = ["" if i is None else i for i, _ in items]
        found: dict[int, dict[tuple, set[int]]] = {}
        for k, (_, text) in enumerate(items):
            low = LOWER[np.frombuffer(text or b"", dtype=np.uint8)]
            s, e = word_bounds(low)
            raw = low.tobytes()
            words = [raw[a:b] for a, b in zip(s.tolist(), e.tolist())]
            size = min(n, len(words))
            for j in range(len(words) - size + 1 if size else 0):
                found.setdefault(size, {}).setdefault(tuple(words[j:j + size]), set()).add(k)
        self.by_length = {}
        for size, grams in found.items():
            table: dict[int, list] = {}
            for gram, ks in grams.items():
                buf = np.frombuffer(b" ".join(gram), dtype=np.uint8)
                s, e = word_bounds(buf)
                h = window_hashes(word_hashes(buf, s, e), size)
                table.setdefault(int(h[0]), []).append((b" ".join(gram), sorted(ks)))
            bitmap = np.zeros(1 << BITMAP_BITS, dtype=bool)
            bitmap[np.fromiter(table, dtype=np.uint64, count=len(table)) >> np.uint64(64 - BITMAP_BITS)] = True
            self.by_length[size] = (bitmap, table)


def scan(windows: Windows, texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int]], list[int]]]:
    """For each text: number of words, merged spans of hit words (first, last + 1), numbers of the items found."""
    low = LOWER[np.frombuffer(b"\n".join(texts), dtype=np.uint8)]
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    text_end = np.cumsum(sizes)
    starts, ends = word_bounds(low)
    owner_first = np.searchsorted(starts, text_end - sizes)
    owner_last = np.searchsorted(starts, text_end)
    hashes = word_hashes(low, starts, ends)
    raw = low.tobytes()
    hits: dict[int, list] = {}
    for n, (bitmap, table) in windows.by_length.items():
        h = window_hashes(hashes, n)
        at = np.flatnonzero(bitmap[h >> np.uint64(64 - BITMAP_BITS)])
        doc = np.searchsorted(owner_last, at, side="right")
        for p, d, key in zip(at.tolist(), doc.tolist(), h[at].tolist()):
            if key in table and p + n <= owner_last[d]:
                own = b" ".join(raw[starts[j]:ends[j]] for j in range(p, p + n))
                for gram, ks in table[key]:
                    if gram == own:
                        hits.setdefault(d, []).append((p - int(owner_first[d]), p - int(owner_first[d]) + n, ks))
    for d in range(len(texts)):
        found = hits.get(d, ())
        yield (int(owner_last[d] - owner_first[d]), merged((a, b) for a, b, _ in found),
               sorted({k for _, _, ks in found for k in ks}))


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the bytes from each span's first word to its last."""
    starts, ends = word_bounds(LOWER[np.frombuffer(text, dtype=np.uint8)])
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, text[at:]])


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items in blocks of about ``block_bytes`` of text; only one block is on the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("id"),
                             F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).collect()
        yield sorted(((r["id"], r["text"].encode()) for r in part), key=lambda x: (x[0] is not None, x[0], x[1]))


def broadcast_blocks(spark, benchmark: DataFrame, n: int, block_bytes: int = BLOCK_BYTES) -> list:
    bounded_batches(spark)
    return [spark.sparkContext.broadcast(Windows(items, n)) for items in item_blocks(benchmark, block_bytes)]


def scan_blocks(blocks: list, texts: list[bytes]) -> list[tuple[int, list, list[str]]]:
    """Number of words, spans and item ids of each text, over all blocks."""
    words, spans, items = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
    for block in blocks:
        ids = block.value.ids
        for d, (count, found, ks) in enumerate(scan(block.value, texts)):
            words[d] = count
            spans[d] += found
            items[d].update(ids[k] for k in ks)
    return [(w, merged(s), sorted(i)) for w, s, i in zip(words, spans, items)]


def hit_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, spans, items): the spans of words that lie in a benchmark window, and the items' ids."""
    blocks = broadcast_blocks(docs.sparkSession, benchmark, n, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_chunks(batches, "doc_id", "text", CHUNK_BYTES // 2):
            found = scan_blocks(blocks, texts)
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, pa.int64()), pa.array([w for w, _, _ in found], pa.int64()),
                pa.array([[{"first": a, "last": b} for a, b in s] for _, s, _ in found],
                         pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                pa.array([i for _, _, i in found], pa.list_(pa.string()))],
                ["doc_id", "n_words", "spans", "items"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, f"doc_id long, n_words long, spans {SPANS}, items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """One row a document: n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"])
    return hit_spans(docs, benchmark, n).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "drop", n: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated documents (``drop``), or with the hit passages cut out of them (``spans``).
    One pass over the documents, all columns kept, nothing shuffled."""
    if mode not in ("drop", "spans"):
        raise ValueError(f"mode is drop or spans, not {mode!r}")
    blocks = broadcast_blocks(docs.sparkSession, benchmark, n)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans: list[list] = []
            texts: list[bytes] = []
            for _, part in text_chunks([b], "doc_id", "text", CHUNK_BYTES // 2):
                spans += [s for _, s, _ in scan_blocks(blocks, part)]
                texts += part
            if mode == "drop":
                yield b.filter(pa.array([not s for s in spans], pa.bool_()))
            else:
                old = b.column(at).to_pylist()
                new = [without_spans(t, s).decode() if s else o for t, s, o in zip(texts, spans, old)]
                yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item, windows of 10 words."""
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH dw AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(10, len(w)) AS n FROM bw WHERE len(w) > 0),
bg AS MATERIALIZED (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
dg AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM dw, (SELECT DISTINCT n FROM bg) WHERE len(w) >= n)),
hit AS MATERIALIZED (SELECT doc_id, item_id, n, i FROM dg JOIN bg USING (n, gram)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
       FROM (SELECT DISTINCT doc_id, coalesce(CAST(item_id AS VARCHAR), '') AS id FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
