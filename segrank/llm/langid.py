"""Language identification: multinomial naive Bayes over hashed character n-grams.

N-grams of 1 to 3 code points of the lower-cased text are hashed into a fixed number of columns; training counts them
for each language by Spark, and the log-probability matrix (columns x languages, a fixed bound) is broadcast.  Scoring
runs over batches of texts in numpy: hashed columns, gathered rows of the matrix, and sums for each text.

Defined cases: a null text or one without a letter is ``und`` with score 0; ties go to the language first by code
point; without any training row every text is ``und``; null ids belong to fold 0; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segrank.llm.common import CHUNK_BYTES, bounded_batches, id_fold, read_table

COLUMNS = 1 << 15
ORDERS = (1, 2, 3)
SMOOTH = 0.5
HELD_OUT = 2
SAMPLE = 20_000          # training documents for each language at most: the least by hash of the id
LETTER = regex.compile(r"\p{L}")
MIX = np.uint32(0x9E3779B1)


def columns_of(points: np.ndarray) -> list[np.ndarray]:
    """For each order the hashed column of the n-gram that starts at each code point."""
    out = []
    h = np.zeros(len(points), dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):
        m = len(points) - n + 1
        if m <= 0:
            out.append(np.zeros(0, dtype=np.uint32))
            continue
        h = (h[:m] ^ points[n - 1:]) * MIX
        h ^= h >> np.uint32(15)
        out.append((h ^ np.uint32(n * 0x85EB)) & np.uint32(COLUMNS - 1))
    return out


def points_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, one after the other, and where each text ends."""
    low = [t.lower() for t in texts]
    return (np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32),
            np.cumsum([len(t) for t in low], dtype=np.int64))


def sums(values: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``values`` (for n-grams starting at each code point) summed for each text; n-grams over an end left out."""
    total = np.zeros((len(ends), values.shape[1]))
    starts = np.concatenate([[0], ends[:-1]])
    last = ends - n + 1
    full = np.flatnonzero(last > starts)
    if len(full):
        edges = np.stack([starts[full], last[full]], axis=1).ravel()
        padded = np.concatenate([values, np.zeros((1, values.shape[1]), values.dtype)])
        total[full] = np.add.reduceat(padded, np.minimum(edges, len(values)), axis=0, dtype=np.float64)[::2]
    return total


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (lang, text) to (lang, counts): one count vector a language and task."""
    held: dict[str, np.ndarray] = {}
    for b in batches:
        texts: dict[str, list[str]] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            texts.setdefault(lang, []).append(text or "")
        for lang, own in texts.items():
            points, _ = points_of(["\n".join(own)])
            row = held.setdefault(lang, np.zeros(len(ORDERS) * COLUMNS, dtype=np.int64))
            for k, cols in enumerate(columns_of(points)):
                row[k * COLUMNS:(k + 1) * COLUMNS] += np.bincount(cols, minlength=COLUMNS)
    for lang, row in held.items():
        at = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at])],
            ["lang", "gram", "n"])


def train(rows: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages by code point and the log-probability matrix [order x column, language].

    ``rows``: (doc_id, text, lang).  At most about ``sample`` documents of each language are used: those whose id hashes
    below sample / count.  What reaches the driver has languages x columns x orders cells at most."""
    bounded_batches(rows.sparkSession)
    known = rows.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    share = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) * F.col("size")) < F.lit(float(sample * (1 << 20)))
    counted = (known.join(F.broadcast(sizes), "lang").where(share).select("lang", "text")
               .mapInArrow(gram_counts, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    table = counted.toPandas()
    langs = sorted(table["lang"].unique().tolist())
    counts = np.zeros((len(ORDERS) * COLUMNS, len(langs)))
    if langs:
        counts[table["gram"].to_numpy(), np.searchsorted(langs, table["lang"].to_numpy(dtype=str))] = table["n"].to_numpy()
    matrix = np.zeros_like(counts)
    for k in range(len(ORDERS)):
        part = counts[k * COLUMNS:(k + 1) * COLUMNS] + SMOOTH
        matrix[k * COLUMNS:(k + 1) * COLUMNS] = np.log(part / part.sum(axis=0)) if langs else 0
    return langs, matrix.astype(np.float32)


def identify(docs: DataFrame, langs: list[str], matrix: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score) of every row; score is the posterior of the language under equal priors."""
    spark = docs.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast((langs, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights = model.value
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), [t or "" for t in b.column("text").to_pylist()]
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK_BYTES // 8):
                    size += len(texts[to])
                    to += 1
                part = texts[at:to]
                pred, score = ["und"] * len(part), np.zeros(len(part))
                if names:
                    points, ends = points_of(part)
                    logs = np.zeros((len(part), len(names)))
                    for k, cols in enumerate(columns_of(points)):
                        logs += sums(weights[cols + np.uint32(k * COLUMNS)], ends, k + 1)
                    best = logs.argmax(axis=1)
                    odds = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                    for i, t in enumerate(part):
                        if LETTER.search(t):
                            pred[i], score[i] = names[best[i]], odds[i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at:to], pa.int64()), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                    ["doc_id", "lang_pred", "score"])
                at = to

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double")


def op9_language(spark, sf_dir: str) -> DataFrame:
    """Every document; learned from the folds that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    langs, matrix = train(docs.where(id_fold() != HELD_OUT))
    return identify(docs, langs, matrix).select("doc_id", (id_fold() == HELD_OUT).alias("held_out"), "lang_pred", "score")
