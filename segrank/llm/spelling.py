"""Spelling variant grouping: words one edit apart, found by permuterm rotations.

Method.  A word ``xcy`` is marked by a terminator and rotated: ``y$xc``.  Its rotations are sorted by all that comes
before the edited character, so a replacement of ``c`` is the range of rotations with the prefix ``y$x`` and length one
more, and the word without ``c`` is the whole rotation ``y$x`` that opens that range.  Each range (at most one row for
each letter of the alphabet, and one for the shorter word) is scanned in order; all its members are one edit apart, so
a member only needs the range's size and its best two words: no pairs are written.  A letter that repeats (``aab``,
``ab``) makes the same deletion at several places; it counts where the next character differs only.

Words longer than ``LONG`` code points do not get rotations of their full length, as those take the square of the
length: their rotations are numbered by two polynomial fingerprints, and every pair that these propose is compared
character by character.

Shuffles: one of added-up word counts, one of the rotations of the distinct words, one of what the ranges report.

Defined cases: a null text has no words; a null id is the empty string in ``<doc_id>:<run>``; a repeated row counts
again; an empty table gives an empty result; other columns are ignored, whatever their names; a run may be of any length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segrank.llm.common import bounded_batches, read_table, stored

LETTERS = "[A-Za-zÀ-ÿ]"
LEAST = 7          # code points of a word, at least
OCCURRENCES = 2    # of a word, at least
FACTOR = 10        # a form occurs at least so many times as often as its word
EVERY = 31         # a run whose checksum this divides loses a code point
LONG = 64          # code points; rotations of longer words are fingerprints
END = "$"          # the terminator; no letter of a word

UPPER_CASE, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, least: int = LEAST, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n) of the words.  A run that is too short before its deletion is not cut out of the text at all."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all("text", F.lit(LETTERS + "{%d,}" % least), F.lit(0))).alias("run"))
    lower = runs.select("id", F.when(F.lower("run") == F.col("run"), F.col("run"))
                        .otherwise(F.translate("run", UPPER_CASE, LOWER_CASE)).alias("run"))
    marked = lower.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % EVERY == 0,
                  F.concat(F.expr("left(run, int(h % length(run)))"), F.substring("run", at + 2, F.length("run"))))
    return (marked.select(word.otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= occurrences))


def rotations(words: DataFrame) -> DataFrame:
    """(key, skipped, n): for each code point c of a word xcy the key y$x with c skipped, and each whole rotation
    y$x with nothing skipped."""
    size = F.length("word")
    at = words.select("word", "n", F.explode(F.sequence(F.lit(0), 2 * size)).alias("i"))
    edited = F.col("i") < size                     # then size + 1 whole rotations
    cut = F.when(edited, F.col("i")).otherwise(F.col("i") - size)
    return at.withColumn("cut", cut).select(
        F.concat(F.substring("word", F.col("cut") + F.when(edited, 2).otherwise(1), size), F.lit(END),
                 F.expr("left(word, cut)")).alias("key"),
        F.when(edited, F.substring("word", F.col("cut") + 1, F.lit(1))).otherwise("").alias("skipped"), "n")


def near_by_rotation(words: DataFrame) -> DataFrame:
    """(word, near, best) of each range a word is in: ``near`` words that it meets there and at no other place, and
    ``best``, (-n, word) of the largest other word."""
    after, before = F.substring_index("key", END, 1), F.substring_index("key", END, -1)
    rows = rotations(words).repartition("key").select(
        "key", "skipped", F.struct((-F.col("n")).alias("less"), F.concat(before, "skipped", after).alias("word")).alias("best"))
    sort = Window.partitionBy("key").orderBy("best")
    whole = sort.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    repeated = F.col("skipped") == F.substring("key", 1, 1)   # this deletion counts where the run of the letter ends
    shorter = F.col("skipped") == ""
    scanned = rows.select(
        "best", shorter.alias("shorter"), repeated.alias("repeated"), F.row_number().over(sort).alias("at"),
        F.count(F.lit(1)).over(whole).alias("members"), F.max(shorter).over(whole).alias("any_shorter"),
        F.max(repeated).over(whole).alias("any_repeated"), F.nth_value("best", 1).over(whole).alias("first"),
        F.nth_value("best", 2).over(whole).alias("second")).where("members > 1")
    elsewhere = (F.col("shorter") & F.col("any_repeated")) | (F.col("repeated") & F.col("any_shorter"))
    return scanned.select(
        F.col("best.word").alias("word"), (F.col("members") - 1 - elsewhere.cast("long")).alias("near"),
        F.when(F.col("at") == 1, F.col("second")).otherwise(F.col("first")).alias("best"))


def powers(base: int, count: int, prime: int) -> np.ndarray:
    """base^0 to base^(count-1) modulo ``prime``."""
    out = np.ones(count, np.uint64)
    done = 1
    while done < count:
        m = min(done, count - done)
        out[done:done + m] = out[:m] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
        done += m
    return out


def rotation_prints(word: str) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the keys y$x of all edited and of all whole rotations."""
    codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = len(codes)
    out = []
    for prime, base in ((2147483647, 1000003), (2147483629, 998244)):
        p = np.uint64(prime)
        up, down = powers(base, size + 2, prime), powers(pow(base, -1, prime), size + 2, prime)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * up[:size] % p) % p])

        def key(end: np.ndarray, start: np.ndarray) -> np.ndarray:
            """Of y = word[start:], the terminator and x = word[:end]."""
            y = (sums[size] + p - sums[start]) % p * down[start] % p
            return (y + np.uint64(ord(END)) * up[size - start] % p + sums[end] * up[size - start + 1] % p) % p

        at = np.arange(size + 1)
        out.append((key(at[:-1], at[1:]), key(at, at)))
    (a, b), (c, d) = out
    return a << np.uint64(31) | c, b << np.uint64(31) | d


def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for word_id, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist()):
            edited, whole = rotation_prints(word)
            sizes = np.concatenate([np.full(len(edited), len(edited) - 1), np.full(len(whole), len(edited))])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([edited, whole]).astype(np.int64)), pa.array(sizes),
                                              pa.array([word_id] * len(sizes))], ["key", "size", "id"])


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes one of the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    low, high = 0, len(a)          # the first difference, by halves: slices are compared by the interpreter's memcmp
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return a[low + (len(a) == len(b)):] == b[low + 1:]


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.filter(pa.array([one_edit(x.as_py(), y.as_py()) for x, y in zip(b.column("word"), b.column("other"))], pa.bool_()))


def near_by_print(words: DataFrame, long: int = LONG) -> DataFrame:
    """As :func:`near_by_rotation`, for words of ``long`` code points or more; pairs with a longer word only."""
    bounded_batches(words.sparkSession)
    named = words.select(F.md5(F.col("word").cast("binary")).alias("id"), "word", "n")
    groups = (named.select("id", "word").mapInArrow(prints, "key long, size long, id string")
              .groupBy("key", "size").agg(F.collect_set("id").alias("ids")).where(F.size("ids") > 1))
    pairs = (groups.select("ids", F.posexplode("ids").alias("i", "a"))
             .select("a", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("b"))
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    texts = (pairs.join(named.select(F.col("id").alias("a"), "word", "n"), "a")
             .join(named.select(F.col("id").alias("b"), F.col("word").alias("other"), F.col("n").alias("other_n")), "b")
             .where((F.length("word") > long) | (F.length("other") > long)).select("word", "n", "other", "other_n"))
    sure = texts.mapInArrow(verified, texts.schema)
    best = lambda n, w: F.struct((-F.col(n)).alias("less"), F.col(w).alias("word")).alias("best")
    one = F.lit(1).cast("long").alias("near")
    return sure.select("word", one, best("other_n", "other")).unionByName(
        sure.select(F.col("other").alias("word"), one, best("n", "word")))


def with_roots(forms: DataFrame, largest: int, least: int = OCCURRENCES, factor: int = FACTOR) -> DataFrame:
    """(word, root) of words with a form.  A form is ``factor`` times as frequent as its word, so a chain has at most
    log_factor(largest / least) steps, and each round doubles the steps that a word has taken."""
    roots = forms.select("word", F.col("form").alias("root"))
    steps = max(1, math.ceil(math.log(max(largest, 1) / least + 1, factor)))
    for _ in range(math.ceil(math.log2(steps))):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = stored(roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
    return roots


def spelling_variants(docs: DataFrame, least: int = LEAST, occurrences: int = OCCURRENCES, factor: int = FACTOR,
                      long: int = LONG) -> DataFrame:
    """word, form, root, n, n_near, form_n (see the module's contract)."""
    words = stored(word_counts(docs, least, occurrences), "spelling-words")
    near = (near_by_rotation(words.where(F.length("word") <= long))
            .unionByName(near_by_print(words.where(F.length("word") >= long), long))
            .groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best")))
    much = -F.col("best.less") >= factor * F.col("n")
    formed = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(much, F.col("best.word")).alias("form"),
        F.when(much, -F.col("best.less")).alias("form_n")), "spelling-forms")
    largest = formed.agg(F.max("n")).first()[0] or 0
    roots = with_roots(formed.where("form IS NOT NULL"), largest, occurrences, factor)
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
runs AS (SELECT translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, id FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
    WHERE length(run) >= 7),
each AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS bytes FROM runs GROUP BY id, run),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(length(bytes) // 2),
        lambda i: (strpos('0123456789ABCDEF', bytes[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', bytes[2 * i + 2]) - 1)),
        lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1]))) AS h FROM each, tab),
w AS (SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
               ELSE run END AS word, n FROM h) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT DISTINCT word, n, i, substr(word, 1, i) AS x, substr(word, i + 2) AS y
        FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
near AS (SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.x = b.x AND a.y = b.y AND a.word <> b.word
         UNION SELECT a.word, b.word, b.n FROM cut a JOIN w b ON a.x || a.y = b.word
         UNION SELECT b.word, a.word, a.n FROM cut a JOIN w b ON a.x || a.y = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS other_n FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form,
             CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n FROM w LEFT JOIN best USING (word)),
chain AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL
          UNION ALL SELECT c.word, f.form FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL),
last AS (SELECT c.word, c.root FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(last.root, f.word) AS root, f.n, f.n_near, f.form_n FROM f LEFT JOIN last USING (word)
"""


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """All words of all documents."""
    return spelling_variants(read_table(spark, sf_dir, "documents"))
