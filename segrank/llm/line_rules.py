"""Quality rules: a conditional random field marks the lines of a text as content or boilerplate.

Method.  The words, lines and repetitions of a text give counts, of which plain rules reject a text that is too short or
mostly repeats itself.  For all others the share of its content decides: each line with a word is a position of a
linear chain with the states content and boilerplate; figures of the line (symbols, bars, capitals, word lengths,
repeats, its place) fall into bins, each bin has a weight, and so has each step from state to state.  The weights
maximise the conditional likelihood (forward-backward, gradient ascent) on a bounded sample of labelled documents.  Labels
are of documents: a first fit without steps, in which every line carries its document's label, finds the lines of bad
documents that look as those of good ones do; they are content for the second fit (but the worst line of a bad document
never is).  Viterbi decoding labels the lines of every document; the text is kept if content lines hold at least
``CONTENT_SHARE`` of its words.

Spark: the sample is taken by the order of a hash of the id (``SAMPLE`` documents of each label, of up to ``SAMPLE_LINES``
lines); all documents are then read once, without any shuffle, and the model (a few hundred numbers) travels with the task.

Defined cases: a null text is empty; an empty text has zeros everywhere and fails the rules; a text of any length is
read whole; without labelled documents of both kinds every line is content; repeated rows and null ids are rows like any
other; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segrank.llm.common import bounded_batches, id_fold, read_table, text_chunks

LEAST_WORDS = 50         # a text with fewer words fails
REPEAT_SHARE = 50        # in a hundred; a text with more of its words in repeated windows fails
CONTENT_SHARE = 0.5      # of the words are in content lines, at least
SAMPLE = 1500            # labelled documents of each label that the field learns from, at most
SAMPLE_LINES = 300       # a document with more lines is not in the sample
STEPS = 120              # of the gradient ascent
HELD_OUT = 2             # this fold of the ids is not learnt from

SYMBOLS, SPACE = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
CAPITALS, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
CLOSING = (b".", b"!", b"?", b":", b";", b'"', b")", b"\xe2\x80\xa6", b"\xc2\xbb", b"\xe2\x80\x9d", b"\xe3\x80\x82")

# Figures of a line and the upper bounds of their bins (fixed values)
FIGURES = {
    "words": (1, 3, 7, 15, 31, 63),
    "symbols_per_word": (0, 0.02, 0.1, 0.3, 0.6, 1),
    "bars_per_word": (0, 0.05, 0.2, 0.4),
    "exclamations_per_word": (0, 0.05, 0.2, 0.5),
    "capitals_share": (0, 0.04, 0.1, 0.3, 0.6),
    "digits_share": (0, 0.05, 0.2, 0.5),
    "distinct_words": (0.1, 0.3, 0.5, 0.7, 0.85),
    "chars_per_word": (2, 3, 4, 5, 6, 8, 12),
    "short_words": (0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7),
    "repeated_windows": (0, 0.1, 0.3, 0.5, 0.8),
    "closed": (0,),
    "same_as_earlier": (0,),
    "place": (0, 1, 2),   # first, inside, last, only line
}
WIDTH = 1 + max(map(len, FIGURES.values()))


@dataclass
class Field:
    """Weights: of a figure's bin for the state boilerplate (against content), of the first state, of the steps."""
    bins: np.ndarray
    start: np.ndarray
    step: np.ndarray


def repeated_words(ids: np.ndarray) -> np.ndarray:
    """For each word whether a window of three words that it is in occurs twice or more."""
    covered = np.zeros(len(ids), bool)
    if len(ids) < 4:
        return covered
    wide = ids.astype(np.int64)
    kinds = int(wide.max()) + 1
    pairs = np.unique(wide[:-1] * kinds + wide[1:], return_inverse=True)[1]
    _, of, times = np.unique(pairs[:-1] * kinds + wide[2:], return_inverse=True, return_counts=True)
    again = times[of] > 1
    for k in range(3):
        covered[k:len(ids) - 2 + k] |= again
    return covered


def removed(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def read_text(text: bytes) -> tuple[dict[str, int], list[int], list[list[float]]]:
    """The text's counts, the numbers of its lines with a word, and their figures in the order of FIGURES."""
    known: dict[bytes, int] = {}
    ids: list[int] = []
    numbers, rows, ends, earlier, same = [], [], [], set(), 0
    for number, line in enumerate(text.split(b"\n")):
        words = line.split()
        n = len(words)
        if not n:
            continue
        again = line in earlier
        earlier.add(line)
        same += again
        ids += [known.setdefault(w, len(known)) for w in words]
        chars = len(line.decode()) - removed(line, SPACE)
        rows.append([n, removed(line, SYMBOLS) / n, line.count(b"|") / n, line.count(b"!") / n, removed(line, CAPITALS) / chars,
                     removed(line, DIGITS) / chars, len(set(words)) / n, chars / n, sum([len(w) < 4 for w in words]) / n,
                     0.0, words[-1].endswith(CLOSING), again, 1])
        numbers.append(number)
        ends.append(len(ids))
    covered = repeated_words(np.array(ids, np.int64))
    sums = np.concatenate([[0], np.cumsum(covered)])
    before = 0
    for row, end in zip(rows, ends):
        row[9] = int(sums[end] - sums[before]) / row[0]
        before = end
    if rows:
        rows[0][-1], rows[-1][-1] = 0, 2
        if len(rows) == 1:
            rows[0][-1] = 3
    return ({"n_words": len(ids), "word_chars": len(text.decode()) - removed(text, SPACE), "n_symbols": removed(text, SYMBOLS),
             "n_dup_lines": same, "n_repeat_words": int(sums[-1])}, numbers, rows)


def binned(rows: list[list[float]]) -> np.ndarray:
    """Lines x figures: the number of the bin, counted over all figures."""
    values = np.array(rows, np.float64).reshape(len(rows), len(FIGURES))
    return np.stack([np.searchsorted(bounds, values[:, k], "left") + k * WIDTH
                     for k, bounds in enumerate(FIGURES.values())], axis=1)


def fit(lines: list[np.ndarray], states: list[np.ndarray], chain: bool = True, steps: int = STEPS, rate: float = 0.1,
        decay: float = 1e-3) -> Field:
    """Conditional maximum likelihood of the sequences of ``states``; without ``chain``, of each line alone.

    Documents are sorted by length, so that the forward and backward passes take all documents a line at a time."""
    order = sorted(range(len(lines)), key=lambda k: -len(lines[k]))
    size = np.array([len(lines[k]) for k in order])
    active = [int((size > t).sum()) for t in range(int(size[0]))]
    at = [np.stack([lines[k][t] for k in order[:many]]) for t, many in enumerate(active)]    # documents x figures
    gold = [np.array([states[k][t] for k in order[:many]], int) for t, many in enumerate(active)]
    total, longest = int(size.sum()), len(active)
    w = {"bins": np.zeros(len(FIGURES) * WIDTH), "start": np.zeros(2), "step": np.zeros((2, 2))}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    told = {k: np.zeros_like(v) for k, v in w.items()}                    # what the gold sequences have of each
    for t in range(longest):
        told["bins"] += np.bincount(at[t].ravel(), np.repeat(gold[t], at[t].shape[1]), len(told["bins"]))
        if t:
            np.add.at(told["step"], (gold[t - 1][:active[t]], gold[t]), 1)
    told["start"] += np.bincount(gold[0], minlength=2)
    for round_ in range(1, steps + 1):
        emit = [np.stack([np.zeros(active[t]), w["bins"][at[t]].sum(axis=1)], axis=1) for t in range(longest)]
        ahead = [emit[0] + w["start"]]
        for t in range(1, longest):
            ahead.append(emit[t] + np.logaddexp.reduce(ahead[-1][:active[t], :, None] + w["step"], axis=1))
        back = np.zeros((active[-1], 2))
        grad = {k: v.copy() for k, v in told.items()}
        for t in range(longest - 1, -1, -1):
            both = ahead[t] + back
            chance = np.exp(both - np.logaddexp.reduce(both, axis=1, keepdims=True))
            grad["bins"] -= np.bincount(at[t].ravel(), np.repeat(chance[:, 1], at[t].shape[1]), len(w["bins"]))
            if t == 0:
                grad["start"] -= chance.sum(axis=0)
                break
            here = (emit[t] + back)[:, None, :] + w["step"]               # documents x state before x state at t
            pair = ahead[t - 1][:active[t], :, None] + here
            grad["step"] -= np.exp(pair - np.logaddexp.reduce(pair.reshape(len(pair), 4), axis=1)[:, None, None]).sum(axis=0)
            back = np.zeros((active[t - 1], 2))
            back[:active[t]] = np.logaddexp.reduce(here, axis=2)
        for k in w if chain else ("bins",):                               # Adam
            g = grad[k] / total - decay * w[k]
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w[k] = w[k] + rate * (m / (1 - 0.9 ** round_)) / (np.sqrt(v / (1 - 0.99 ** round_)) + 1e-8)
    return Field(w["bins"], w["start"], w["step"])


def line_states(lines: list[np.ndarray], bad: list[int]) -> list[np.ndarray]:
    """States of the lines: a good document's are content; a bad one's are boilerplate, but for those that a fit of single
    lines takes for content."""
    alone = fit(lines, [np.full(len(x), b) for x, b in zip(lines, bad)], chain=False)
    states = []
    for x, b in zip(lines, bad):
        score = alone.bins[x].sum(axis=1)
        states.append((score > 0) | (score == score.max()) if b else np.zeros(len(x), bool))
    return states


def decode(field: Field, boilerplate: np.ndarray) -> np.ndarray:
    """Viterbi: the likeliest states of one text's lines; ``boilerplate`` has each line's score for that state."""
    (cc, cb), (bc, bb) = field.step.tolist()
    from_c, from_b = [], []          # for each line, whether each state is best reached from boilerplate
    c, b = field.start.tolist()
    for k, e in enumerate(boilerplate.tolist()):
        if k:
            to_c, to_b = b + bc > c + cc, b + bb > c + cb
            c, b = (b + bc if to_c else c + cc), (b + bb if to_b else c + cb)
            from_c.append(to_c)
            from_b.append(to_b)
        b += e
    state = b > c
    states = [state]
    for to_c, to_b in zip(reversed(from_c), reversed(from_b)):
        state = to_b if state else to_c
        states.append(state)
    return np.array(states[::-1], bool)


SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_words long, "
          "marks string")


def marker(field: Field | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow function: (doc_id, text) to the counts and ``marks``, a character for each \\n-split line of the text:
    C content, B boilerplate, - no word."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_chunks(batches, "doc_id", "text"):
            read = [read_text(t) for t in texts]
            rows = [r for _, _, lines in read for r in lines]
            scores = field.bins[binned(rows)].sum(axis=1) if field and rows else np.zeros(len(rows))
            out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                                    "content_words", "marks")}
            first = 0
            for text, (counts, numbers, lines) in zip(texts, read):
                bad = decode(field, scores[first:first + len(lines)]) if field and lines else np.zeros(len(lines), bool)
                first += len(lines)
                for k, v in counts.items():
                    out[k].append(v)
                out["content_words"].append(sum(int(r[0]) for r, x in zip(lines, bad) if not x))
                marks = bytearray(b"-" * (text.count(b"\n") + 1))
                for number, x in zip(numbers, bad):
                    marks[number] = 66 if x else 67
                out["marks"].append(marks.decode())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys)] + [pa.array(v, pa.string() if k == "marks" else pa.int64()) for k, v in out.items()],
                ["doc_id", *out])
    return mark


def sample(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> DataFrame:
    """(labelled, bad, text) of up to ``per_label`` labelled documents of each label, the first by a hash of the id."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(id_fold() != HELD_OUT).select(
        F.col("doc_id").alias("labelled"), (1 - F.col("quality")).cast("int").alias("bad"), F.xxhash64("doc_id").alias("h"))
    picked = None
    for bad in (0, 1):
        part = known.where(F.col("bad") == bad).orderBy("h", "labelled").limit(per_label)
        picked = part if picked is None else picked.unionByName(part)
    found = docs.select(F.col("doc_id").alias("labelled"), F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(picked), "labelled")
    # one text an id, however often the id is repeated
    return found.groupBy("labelled", "bad").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def line_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of up to SAMPLE_LINES lines to the bins of their lines, one after the other."""
    for b in batches:
        for bad, text in zip(b.column("bad").to_pylist(), b.column("text")):
            lines = read_text((text.as_py() or "").encode())[2]
            if 0 < len(lines) <= SAMPLE_LINES:
                yield pa.RecordBatch.from_arrays([pa.array([bad], pa.int32()), pa.array([binned(lines).ravel().tolist()],
                                                                                       pa.list_(pa.int32()))], ["bad", "bins"])


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> Field | None:
    """The field; None if the sample lacks one of the labels.  Rows come to the driver as bins, at most
    2 * per_label * SAMPLE_LINES lines."""
    bounded_batches(docs.sparkSession)
    rows = sample(docs, labels, per_label).mapInArrow(line_bins, "bad int, bins array<int>").collect()
    rows = sorted((r["bad"], r["bins"]) for r in rows)
    if len({bad for bad, _ in rows}) < 2:
        return None
    lines = [np.array(bins).reshape(-1, len(FIGURES)) for _, bins in rows]
    return fit(lines, line_states(lines, [bad for bad, _ in rows]))


def marked(docs: DataFrame, field: Field | None) -> DataFrame:
    """One row a document: doc_id, the counts, content_words, marks, base_failed, kept."""
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    out = docs.mapInArrow(marker(field), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    enough = F.col("content_words") >= CONTENT_SHARE * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & enough)


def op11_quality_lines(spark, sf_dir: str) -> DataFrame:
    """Every document."""
    docs = read_table(spark, sf_dir, "documents")
    field = train(docs, read_table(spark, sf_dir, "labels"))
    return marked(docs, field).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                      "base_failed", "kept", "content_words")
