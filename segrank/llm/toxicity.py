"""Toxicity by weak supervision.

Many voters look at a document: terms mined from labelled training rows (words, and the first 4 to 8 characters of
words), a fixed lexicon, patterns, and one that votes clean.  A generative label model with two hidden classes
estimates from the votes alone how often each voter speaks in either class (its accuracy) and which voters depend on
each other within a class; dependent voters share their weight.  A linear classifier is then trained on the
posterior labels, with the presence of terms as features, and scores every text.

Defined cases: a null or empty text has no feature and scores as the classifier's bias says; without a toxic training
row only the lexicon and the patterns vote; null labels and null ids are not used for training (null ids are in
fold 0); a document with several labels is toxic if any of them says so; rows that repeat an id are scored each;
other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segrank.llm.decontaminate import LOWER, WORD_BASE, window_hashes, word_bounds, word_hashes
from segrank.llm.common import bounded_batches, id_fold, read_table, stored

HELD_OUT = 2
THRESHOLD = 0.3
SAMPLE = 20_000     # labelled training documents at most, about: those with the least hash of the id
TERMS = 4000        # mined terms at most, the strongest
LEAST = 4           # toxic training documents that a mined term is in
ODDS = 1.8          # least log odds, by two standard errors, of a mined term
VOTERS = 400        # mined terms that also vote
PREFIXES = (4, 5, 6, 7, 8)
WORD = re.compile(r"[^\W\d_]+")
LEXICON = ("idiot", "moron", "stupid", "trash", "loser", "scum", "pathetic", "clown", "worthless", "disgusting", "vermin")
PATTERNS = (re.compile(r"\byou(?:'re| are) (?:an? )?(?:idiot|moron|loser|clown)", re.I), re.compile(r"\bshut up\b", re.I),
            re.compile(r"\b(?:kill|hate) (?:you|yourself|them all)\b", re.I))


def terms_of(word: str) -> tuple[str, ...]:
    """A word's own term and those of its first characters."""
    return (word, *(word[:n] + "*" for n in PREFIXES if len(word) > n))


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (text, toxic) to (term, clean, bad): in how many documents of each label a term is."""
    counts: tuple[dict, dict] = ({}, {})
    for b in batches:
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
            held = counts[toxic]
            for t in {t for w in words_of(text) for t in terms_of(w)}:
                held[t] = held.get(t, 0) + 1
    terms = list(counts[0].keys() | counts[1].keys())
    yield pa.RecordBatch.from_arrays(
        [pa.array(terms, pa.string()), *(pa.array([c.get(t, 0) for t in terms], pa.int64()) for c in counts)],
        ["term", "clean", "bad"])


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds two min-hashes of a text's 5-word shingles."""
    for b in batches:
        marks: tuple[list, list] = ([], [])
        for t in b.column("text").to_pylist():
            low = LOWER[np.frombuffer((t or "").encode(), dtype=np.uint8)]
            starts, ends = word_bounds(low)
            words = word_hashes(low, starts, ends)
            h = window_hashes(words, min(5, len(words))) if len(words) else np.zeros(1, np.uint64)
            marks[0].append(int(h.min()) >> 1)
            marks[1].append(int((h * WORD_BASE ^ h >> np.uint64(31)).min()) >> 1)
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(m, pa.int64()) for m in marks)], [*b.schema.names, "sig1", "sig2"])


def unlike(rows: DataFrame) -> DataFrame:
    """Training rows without most near copies, whose rare words would look like evidence."""
    rows = rows.mapInArrow(signatures, "doc_id long, text string, toxic int, sig1 long, sig2 long")
    for sig in ("sig1", "sig2"):
        rows = (rows.groupBy(F.col(sig).alias("sig"))
                .agg(F.min_by(F.struct("doc_id", "text", "toxic", "sig1", "sig2"), "doc_id").alias("r")).select("r.*"))
    return rows.select("text", "toxic")


def distinct_terms(mined: dict[str, tuple[int, int]]) -> list[str]:
    """``mined`` (term -> bad, clean) without the prefixes of a longer term that explains nearly all their toxic
    documents and meets fewer clean ones."""
    return [t for t, (bad, clean) in mined.items() if not (t[-1] == "*" and any(
        o != t and o.startswith(t[:-1]) and b >= 0.9 * bad and c < clean for o, (b, c) in mined.items()))]


class Features:
    """Presence of terms; a word's features are looked up once."""

    def __init__(self, terms: list[str]):
        self.number = {t: k for k, t in enumerate(terms)}
        self.known: dict[str, tuple[int, ...]] = {}

    def of(self, text: str | None) -> list[int]:
        known, number = self.known, self.number
        words = words_of(text)
        for w in words.difference(known):
            known[w] = tuple(number[t] for t in terms_of(w) if t in number)
        found = {k for w in words for k in known[w]}
        if len(known) > 300_000:
            known.clear()
        return sorted(found)


def votes_of(found: list[int], text: str | None, lexicon: set[int], voters: int) -> list[int]:
    """Numbers of the voters that speak: mined terms, the lexicon, two of its words, patterns, and last the clean one."""
    hits = sum(k in lexicon for k in found)
    votes = [k for k in found if k < voters]
    votes += [voters] * (hits > 0) + [voters + 1] * (hits > 1)
    votes += [voters + 2 + k for k, p in enumerate(PATTERNS) if text and p.search(text)]
    return votes or [voters + 2 + len(PATTERNS)]


def label_model(votes: np.ndarray, prior: float, rounds: int = 25) -> np.ndarray:
    """Posterior of the toxic class for each row of the 0/1 matrix ``votes`` (documents x voters; the last voter
    says clean, the others toxic).  EM for the rates at which a voter speaks in either class; after each round the
    correlation of voters within the classes sets how much of a voter's weight is its own."""
    n, m = votes.shape
    toxic = np.full(m, 0.2)
    toxic[-1] = 0.05
    clean = np.full(m, 0.01)
    clean[-1] = 0.9
    share = np.ones(m)
    post = np.full(n, prior)
    for turn in range(rounds):
        speak = share * np.log(toxic / clean)
        silent = share * np.log((1 - toxic) / (1 - clean))
        # Voters that say toxic abstain when they are silent; only what they say counts.
        silent[:-1] = 0.0
        logit = math.log(prior / (1 - prior)) + votes @ (speak - silent) + silent.sum()
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        for rate, weight in ((toxic, post), (clean, 1 - post)):
            rate[:] = (votes.T @ weight + 0.5) / (weight.sum() + 1.0)
        toxic[:-1] = np.maximum(toxic[:-1], clean[:-1] * 1.05)
        clean[-1] = max(clean[-1], toxic[-1] * 1.05)
        if turn in (2, 8):
            left = votes - (np.outer(post, toxic) + np.outer(1 - post, clean))
            cov = left.T @ left / max(n, 1)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            corr = np.clip(cov / np.outer(sd, sd), 0, 1)
            share = 1 / np.where(corr > 0.3, corr, 0).sum(axis=1).clip(1)
    return post


def fit_linear(rows: list[list[int]], target: np.ndarray, size: int, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by AdaGrad over minibatches, features present or not."""
    w, bias = np.zeros(size), -2.0
    gw, gb = np.full(size, 1e-6), 1e-6
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    flat = np.concatenate([np.array(r, dtype=np.int64) for r in rows]) if len(rows) and at[-1] else np.zeros(0, np.int64)
    order = np.random.default_rng(0)
    for _ in range(rounds):
        for pick in np.array_split(order.permutation(len(rows)), max(1, len(rows) // 256)):
            own = np.repeat(np.arange(len(pick)), at[pick + 1] - at[pick])
            cols = np.concatenate([flat[at[k]:at[k + 1]] for k in pick]) if len(pick) else flat[:0]
            z = bias + np.bincount(own, weights=w[cols], minlength=len(pick))
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[pick]
            g = np.bincount(cols, weights=err[own], minlength=size) + 1e-4 * w
            gw += g * g
            w -= 0.5 * g / np.sqrt(gw)
            gb += err.sum() ** 2
            bias -= 0.5 * err.sum() / math.sqrt(gb)
    return w, float(bias)


def train(rows: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, float]:
    """(terms, weights, bias) from labelled rows (doc_id, text, toxic)."""
    spark = rows.sparkSession
    bounded_batches(spark)
    n = rows.count()
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) * F.lit(n) < F.lit(float(sample * (1 << 20))))
    rows = stored(unlike(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                                     F.col("toxic").cast("int").alias("toxic"))), "labelled")
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, clean = size.get(1, 0), size.get(0, 0)
    if not bad + clean:
        return sorted(LEXICON), np.full(len(LEXICON), 4.0), -3.0
    # Log odds less two standard errors: what a few chance meetings in long texts suggest does not count.
    odds = (F.log((F.col("bad") + 0.5) / F.lit(bad + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(clean + 1.0))
            - 2 * F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("clean") + 0.5)))
    mined = (rows.mapInArrow(term_counts, "term string, clean long, bad long").groupBy("term")
             .agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad")).where(F.col("bad") >= LEAST)
             .withColumn("odds", odds).where(F.col("odds") > ODDS)
             .orderBy((F.col("odds") * F.sqrt("bad")).desc(), "term").limit(TERMS).collect())
    terms = distinct_terms({r["term"]: (r["bad"], r["clean"]) for r in mined})
    voters = min(VOTERS, len(terms))
    terms += sorted(set(LEXICON) - set(terms))
    lexicon = {k for k, t in enumerate(terms) if t in LEXICON}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(terms)
        for b in batches:
            texts = b.column("text").to_pylist()
            found = [features.of(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.list_(pa.int32())),
                 pa.array([votes_of(f, t, lexicon, voters) for f, t in zip(found, texts)], pa.list_(pa.int32()))],
                ["found", "votes"])

    seen = sorted((r["found"], r["votes"]) for r in
                  rows.mapInArrow(look, "found array<int>, votes array<int>").collect())
    votes = np.zeros((len(seen), voters + 3 + len(PATTERNS)), dtype=np.float32)
    for k, (_, v) in enumerate(seen):
        votes[k, v] = 1
    posterior = label_model(votes, min(0.5, max(0.01, bad / (bad + clean))))
    return terms, *fit_linear([f for f, _ in seen], posterior, len(terms))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of labelled documents that are not held out."""
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(id_fold() != HELD_OUT)
             .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    return docs.select("doc_id", "text").join(known, "doc_id")


def scorer(spark, model: tuple[list[str], np.ndarray, float]):
    """A function that makes a task's own text scorer."""
    shared = spark.sparkContext.broadcast(model)

    def task():
        terms, weights, bias = shared.value
        features = Features(terms)
        return lambda text: 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + float(weights[features.of(text)].sum())))))
    return task


def scored(docs: DataFrame, model: tuple[list[str], np.ndarray, float]) -> DataFrame:
    """(doc_id, score) of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    task = scorer(spark, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = task()
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([score(t) for t in b.column("text").to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: tuple[list[str], np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more, all columns kept; nothing is shuffled."""
    spark = docs.sparkSession
    bounded_batches(spark)
    task = scorer(spark, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = task()
        for b in batches:
            yield b.filter(pa.array([score(t) < threshold for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document, scored by what the folds that are not held out teach."""
    docs = read_table(spark, sf_dir, "documents")
    model = train(training_rows(docs, read_table(spark, sf_dir, "labels")))
    return scored(docs, model).select("doc_id", (id_fold() == HELD_OUT).alias("held_out"), "score",
                                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
