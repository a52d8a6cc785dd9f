"""Source divergence audit: how far the sources of a language are from each other, and which terms set one apart.

Method (count cells).  Every term that a language keeps has a count in each (lang, source) group and one in the whole
language; what is asked of a term depends on those two counts only.  So terms are grouped into cells by
(group count, language count), ``f`` is evaluated once a cell, cells of equal value are merged, the merged values are
ranked by their cumulative multiplicity, and only the cells that reach the wanted ranks are expanded into terms, in
UTF-8 order.  Sums over all kept terms for two sources come from cells as well: terms that both sources have are met
in the term's own posting row, terms that one or none of them has are taken from the source's histogram of counts.

Shuffles: one by (lang, term) of counts that each task has added up; everything later is cells, histograms and sums.

Defined cases: null text, lang and source are the empty string; a group without terms takes part with counts of zero;
a language without kept terms has value 0 for every pair and no term rows; a repeated row is another document; an
empty table gives an empty result; other columns are ignored, whatever their names; a text of any length is read in
pieces that end between terms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segrank.llm.common import bounded_batches, read_table, stored

MIN_DOCS = 10            # documents of the language that a kept term is in, at least
RANKS = 10               # ranks of the part ``term``
ENTRIES = 100_000        # terms that a task adds up before it passes them on
PIECE = 4 << 20          # bytes of a text that are split into terms at once
BROADCAST_ROWS = 50_000  # a table of groups or cells with more rows than this is joined by a shuffle

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(rb"[a-z\x80-\xff]+")
GAP = re.compile(rb"[^a-z\x80-\xff]")


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """``text`` in pieces of about ``size`` bytes that end where no term goes on."""
    at = 0
    while len(text) - at > size:
        gap = GAP.search(text, at + size)
        if not gap:
            break
        yield text[at:gap.end()]
        at = gap.end()
    yield text[at:]


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, text) to (lang, source, term, n, docs), added up until ``ENTRIES`` terms are held."""
    names = ["lang", "source", "term", "n", "docs"]
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in found.items():
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()),
                pa.array([t.decode() for t in n], pa.string()), pa.array(n.values(), pa.int64()),
                pa.array([docs[t] for t in n], pa.int64())], names)
        found.clear()

    held = 0
    for b in batches:
        texts = b.column("text").cast(pa.large_binary() if pa.types.is_large_string(b.column("text").type) else pa.binary())
        for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), texts):
            n, docs = found.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(n), set()
            for piece in pieces(text.as_py().translate(LOWER)):
                terms = TERM.findall(piece)
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            held += len(n) - before
            if held >= ENTRIES:
                yield from out()
                held = 0
    yield from out()


def share(count, total, v):
    """p = 1 + floor(10^9 * (count + 2) / (total + 2 V)); decimals, as the product can pass 64 bits."""
    big = (F.col(count) if isinstance(count, str) else count).cast("decimal(19,0)") + F.lit(2).cast("decimal(1,0)")
    over = F.col(total).cast("decimal(19,0)") + F.lit(2).cast("decimal(1,0)") * F.col(v).cast("decimal(12,0)")
    whole = F.call_function("div", F.lit(10 ** 9).cast("decimal(10,0)") * big, F.when(over > 0, over))
    return F.lit(1) + whole


def far(p: str, q: str):
    """f = floor((p - q)^2 / (p + q)); both are at most 10^9 + 1, so longs hold it."""
    d = F.col(p) - F.col(q)
    return F.call_function("div", d * d, F.col(p) + F.col(q))


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a stored table) to be broadcast if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def kept_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, lang_n, first) of the kept terms: the counts in the group and in the language; ``first``
    is 1 in one row of each (lang, term)."""
    bounded_batches(docs.sparkSession)
    raw = docs.mapInArrow(term_counts, "lang string, source string, term string, n long, docs long")
    # one shuffle: both the group's and the language's sums are local to the (lang, term) partition
    by_source = (raw.repartition("lang", "term").groupBy("lang", "source", "term")
                 .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    term = Window.partitionBy("lang", "term")
    return (by_source.withColumns({"lang_n": F.sum("n").over(term), "lang_docs": F.sum("docs").over(term),
                                   "first": (F.row_number().over(term.orderBy("source")) == 1).cast("int")})
            .where(F.col("lang_docs") >= MIN_DOCS).select("lang", "source", "term", "n", "lang_n", "first"))


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row for every occurring group: (lang, source, total, kinds, lang_total, v, p0); ``kinds`` kept terms occur
    in it, ``p0`` is the share of a count of zero."""
    groups = docs.select("lang", "source").distinct()
    found = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"),
                                               F.sum("first").alias("firsts"))
    langs = found.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("firsts").alias("v"))
    zero = F.lit(0).cast("long")
    return (groups.join(found.drop("firsts"), ["lang", "source"], "left").join(langs, "lang", "left")
            .select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "kinds", "lang_total", "v")])
            .withColumn("p0", share(zero, "total", "v")))


def pair_values(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of sources of a language: f summed over all kept terms.

    With p0, q0 for counts of zero, the sum over all terms is
    sum over terms of both [f(p,q) - f(p,q0) - f(p0,q) + f(p0,q0)] + sum over a's terms f(p,q0)
    + sum over b's terms f(p0,q) + (V - kinds a - kinds b) f(p0,q0)."""
    few = bounded(totals)
    shared = (kept.join(few, ["lang", "source"]).select("lang", "term", "source", share("n", "total", "v").alias("p"), "p0")
              .groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("have")))
    one = shared.select("lang", "have", F.posexplode("have").alias("i", "a"))
    both = (one.select("lang", "a", F.explode(F.slice("have", F.col("i") + 2, F.size("have"))).alias("b"))
            .select("lang", F.least("a.source", "b.source").alias("source"), F.greatest("a.source", "b.source").alias("item"),
                    F.col("a.p").alias("p"), F.col("b.p").alias("q"), F.col("a.p0").alias("p0"), F.col("b.p0").alias("q0"))
            .groupBy("lang", "source", "item")
            .agg(F.sum(far("p", "q") - far("p", "q0") - far("p0", "q") + far("p0", "q0")).alias("value")))
    other = totals.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("kinds").alias("item_kinds"))
    few_other = bounded(other)
    histogram = kept.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("terms"))
    alone = (histogram.join(few, ["lang", "source"]).withColumn("p", share("n", "total", "v"))
             .join(few_other, "lang").where("source <> item")
             .groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * far("p", "q0")).alias("value")))
    neither = (totals.join(few_other, "lang").where("source <> item")
               .select("lang", "source", "item",
                       F.coalesce((F.col("v") - F.col("kinds") - F.col("item_kinds")) * far("p0", "q0"),
                                  F.lit(0)).alias("value")))
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    parts = [both, turned(both), alone, turned(alone), neither]
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return total.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def ranked_cells(kept: DataFrame, totals: DataFrame, ranks: int = RANKS) -> DataFrame:
    """(lang, source, n, lang_n, value): the cells whose terms reach the first ``ranks`` ranks of their group."""
    cells = stored(
        kept.groupBy("lang", "source", "n", "lang_n").agg(F.count(F.lit(1)).alias("terms"))
        .join(bounded(totals), ["lang", "source"])
        .withColumns({"p": share("n", "total", "v"), "q": share("lang_n", "lang_total", "v")})
        .where("p > q").withColumn("value", far("p", "q"))
        .select("lang", "source", "n", "lang_n", "terms", "value"), "divergence-cells")
    merged = cells.groupBy("lang", "source", "value").agg(F.sum("terms").alias("terms"))
    down = Window.partitionBy("lang", "source").orderBy(F.col("value").desc())
    # a value has one term at least, so no value beyond the first ``ranks`` can matter
    first = merged.withColumn("at", F.row_number().over(down)).where(F.col("at") <= ranks)
    before = F.sum("terms").over(down.rowsBetween(Window.unboundedPreceding, -1))
    reach = (first.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < ranks)
             .select("lang", "source", "value"))
    return cells.join(bounded(stored(reach, "divergence-values")), ["lang", "source", "value"]).select(
        "lang", "source", "n", "lang_n", "value")


def term_values(kept: DataFrame, totals: DataFrame, ranks: int = RANKS) -> DataFrame:
    """(lang, source, item, value) of the terms in the cells that reach the first ``ranks`` ranks, and no others."""
    cells = bounded(stored(ranked_cells(kept, totals, ranks), "divergence-ranked"))
    return kept.join(cells, ["lang", "source", "n", "lang_n"]).select("lang", "source", F.col("term").alias("item"), "value")


def source_divergence(docs: DataFrame, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank) as the module's contract says."""
    empty = F.lit("")
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("lang", "source", "text")])
    kept = stored(kept_counts(docs), "divergence-counts")
    totals = stored(group_totals(docs, kept), "divergence-totals")
    down = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = term_values(kept, totals, ranks).withColumn("rank", F.row_number().over(down)).where(F.col("rank") <= ranks)
    pairs = pair_values(kept, totals).withColumn("rank", F.row_number().over(down))
    shape = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return shape(pairs, "pair").unionByName(shape(terms, "term"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
every AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.lang_n
          FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS lang_total
      FROM every GROUP BY lang, source),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v) AS p,
             1 + (1000000000::HUGEINT * (lang_n + 2)) // (lang_total + 2 * v) AS q
      FROM every JOIN s USING (lang, source)),
pair AS (SELECT g.lang, g.source, o.source AS item FROM g JOIN g o ON g.lang = o.lang AND g.source <> o.source),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
       FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
part_pair AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value
              FROM pair LEFT JOIN pv USING (lang, source, item)),
part_term AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value
              FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
           FROM (SELECT * FROM part_pair UNION ALL SELECT * FROM part_term))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    """All documents: every pair of sources of a language, and the first ten terms of every group."""
    return source_divergence(read_table(spark, sf_dir, "documents"))
