"""Mixing sources to target weights by balanced sampling with the cube method.

Every document of a source is to be taken target / source size times.  The whole part of that is copies of all its
documents; the fraction is an inclusion probability, and the cube method turns the probabilities into choices that keep
both the number of documents and the sum of their sizes: three undecided documents at a time move along the null
space of the two constraints until one of them is decided.  Blocks of a source do this in parallel; each leaves two
documents at most, which meet in larger blocks, until one block a source lands the last two.

Defined cases: a null text has size 0; a null source is a source and comes last; a source of size 0 has target 0 and
gives nothing; an empty table gives an empty result; rows that repeat an id are documents of their own; other
columns are not read.  Choices depend on ids, sizes and the seed only, so reruns agree.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segrank.llm.common import read_table, stored

WEIGHTS = (5, 2, 1)
MOST = 3.0          # times a source's size
BLOCK = 4096        # documents that one flight decides
SEED = 20


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.coalesce(
        F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long").alias("size"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_no, source_size, n_docs, target), a row a source.

    Resharing the excess by weight ends where sum(min(most * size, level * weight)) is the whole.  With the sources
    ordered by the level at which they fill up, that level follows from two running sums; the windows see one row a
    source."""
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    number = F.row_number().over(by_name) - 1
    own = own.withColumn("source_no", number).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, map(float, weights))), F.pmod("source_no", F.lit(len(weights))) + 1))
    own = own.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source_no"))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    own = own.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    final = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(every)["level"]
    return own.withColumn("final", final).select(
        "source", "source_no", "source_size", "n_docs",
        F.when(F.col("full"), F.col("cap")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def step(units: list[list], u: list[float], draw: float) -> None:
    """Moves the units' probabilities along ``u`` or against it, until one of them is 0 or 1."""
    up = min(((1 - x[2]) if d > 0 else x[2]) / abs(d) for x, d in zip(units, u) if d)
    down = min((x[2] if d > 0 else (1 - x[2])) / abs(d) for x, d in zip(units, u) if d)
    move = up if draw * (up + down) < down else -down
    for x, d in zip(units, u):
        p = x[2] + move * d
        x[2] = 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p


def direction(units: list[list], landing: bool) -> list[float] | None:
    """A null-space vector of the constraints (document count, size) on the units; when landing, the size constraint
    is given up first, then the count."""
    s = [float(x[1]) for x in units]
    if len(s) == 3:
        u = [s[1] - s[2], s[2] - s[0], s[0] - s[1]]
        return u if any(u) else [1.0, -1.0, 0.0]
    if len(s) == 2 and (landing or s[0] == s[1]):
        return [1.0, -1.0]
    return [1.0] if len(s) == 1 and landing else None


def flight(units: Iterator[list], seed: str, landing: bool) -> Iterator[list]:
    """[row, size, probability] with probabilities moved to 0 or 1, but for two units at most unless landing."""
    draw = random.Random(seed).random
    active: list[list] = []
    units = iter(units)
    while True:
        while len(active) < 3 and (x := next(units, None)) is not None:
            if 0 < x[2] < 1:
                active.append(x)
            else:
                yield x
        u = direction(active, landing)
        if u is None:
            yield from active
            return
        step(active, u, draw())
        yield from (x for x in active if x[2] in (0.0, 1.0))
        active = [x for x in active if 0 < x[2] < 1]


def flier(seed: int, level: int):
    """The flight of one block, as a function of its key and rows."""
    def fly(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        part = part.sort_by([("mark", "ascending"), ("doc_id", "ascending"), ("size", "ascending")])
        sizes, p = part["size"].to_pylist(), part["p"].to_pylist()
        ends = part["blocks"][0].as_py() <= 1
        draws = f"{seed}/{key[0].as_py()}/{level}/{key[1].as_py()}"
        for k, _, x in flight(([k, s, x] for k, (s, x) in enumerate(zip(sizes, p))), draws, ends):
            p[k] = x
        at = part.schema.get_field_index("p")
        return part.set_column(at, "p", pa.array(p, pa.float64())).drop_columns(["mark", "block"])
    return fly


def cube(rows: DataFrame, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """``rows`` (doc_id, size, p, source_no, n_docs) with ``p`` moved to 0 or 1."""
    most = rows.agg(F.max("n_docs")).first()[0] or 0
    rows = rows.select("doc_id", "size", "p", "source_no", F.ceil(F.col("n_docs") / F.lit(block)).cast("long").alias("blocks"))
    most = -(-most // block)
    done, level = [rows.where("p <= 0 or p >= 1")], 0
    rows = rows.where("p > 0 and p < 1")
    while True:
        last = most <= 1

        flown = stored(
            rows.withColumn("mark", F.xxhash64("doc_id", F.lit(seed + level)))
            .withColumn("block", F.pmod("mark", "blocks"))
            .groupBy("source_no", "block").applyInArrow(flier(seed, level), rows.schema), "flight")
        done.append(flown.where("p = 0 or p = 1"))
        if last:
            break
        rows = flown.where("p > 0 and p < 1").withColumn("blocks", F.ceil(F.col("blocks") * 2 / F.lit(block)).cast("long"))
        most, level = -(-2 * most // block), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("blocks")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: float = MOST, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_no, source_size, target, copies): how often each document is taken."""
    sizes = stored(sized(docs), "sizes")
    goals = stored(targets(sizes, weights, most), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = (sizes.join(goals, sizes["source"].eqNullSafe(goals["source"]))
            .select("doc_id", "size", "source_no", "n_docs", "source_size", "target", ratio.alias("ratio")))
    whole = F.floor(F.col("ratio") + F.lit(1e-9))
    chosen = cube(rows.select("doc_id", "size", F.greatest(F.col("ratio") - whole, F.lit(0.0)).alias("p"), "source_no", "n_docs"),
                  seed, block)
    goals = goals.select("source_no", "source_size", "target")
    return (chosen.join(goals, "source_no").withColumn("ratio", ratio)
            .select("doc_id", "size", "source_no", "source_size", "target",
                    (whole + F.when(F.col("p") > 0.5, 1).otherwise(0)).cast("int").alias("copies")))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it (not at all to three times).  Rows are told apart by a hash of all
    their columns, so rows that share an id are taken one by one; equal rows share what is taken of them all."""
    keyed = docs.withColumn("_row", F.xxhash64(*[x for c in docs.columns for x in (F.col(c).cast("string"), F.isnull(c))]))
    rows = keyed.select(F.col("_row").alias("doc_id"), "text", "source")
    taken = mix(rows, **options).groupBy(F.col("doc_id").alias("_row")).agg(F.sum("copies").alias("_total"), F.count(F.lit(1)).alias("_equal"))
    place = F.row_number().over(Window.partitionBy("_row").orderBy("doc_id")) - 1
    copies = F.floor((F.col("_total") + F.col("_place")) / F.col("_equal")).cast("int")
    return (keyed.join(taken.where("_total > 0"), "_row").withColumn("_place", place).withColumn("_copies", copies).where("_copies > 0")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents; the words that the mix takes of each."""
    return mix(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
