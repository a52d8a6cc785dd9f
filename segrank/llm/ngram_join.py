"""N-gram Jaccard self-join by a size-aware heavy-light split, and its components.

A document's set are the hashes of its distinct 5-word shingles; equal sets are one node (copies are never compared).
Tokens have one global order, rare ones first, with the frequent ones found by bounded counts.  Of two sets that link,
the l-prefixes (the first size - least overlap + l tokens) share at least l tokens, so

* light sets (up to a size boundary) are filed under every 2-subset of their 2-prefix,
* heavy sets, and light ones near enough in size to link with them, under every token of their 1-prefix, and those
  inverted lists are scanned.

The boundary minimises the number of subsets and list entries, from the sizes of all sets and list lengths measured on a
hash slice of the tokens.  Lists are never multiplied out while their members may be one component: first
each node meets the least node of its lists, then the least node of each list, and only members of a list that
are in different components by then meet each other, under size and position bounds.  Every candidate is verified by
the whole sets, after a bound from bitmaps of the sets.  What is broadcast has a fixed bound: the frequent tokens (2 ** 20) and bitmaps.

Defined cases: a null text, or one without words, has an empty set and links with nothing; fewer than five words are
one shingle; rows that repeat an id give a row each and the id's texts all count as its node's; null ids are the
largest in a component; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segrank.llm.common import CHUNK_BYTES, bounded_batches, forget, read_table, stored, text_chunks
from segrank.llm.decontaminate import LOWER, window_hashes, word_bounds, word_hashes

WORDS = 5
PERCENT = 80
FREQUENT = 1 << 20       # frequent tokens at most (8 MB of tokens, 8 MB of counts)
SLICE = 256              # list lengths are measured on this part of the tokens
BITMAP = 1 << 26         # bits of a membership bitmap
BOUNDARIES = (0, 5, 10, 15, 20, 30, 40, 60, 80, 120)

SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    low = LOWER[np.frombuffer(b"\n".join(texts), dtype=np.uint8)]
    starts, ends = word_bounds(low, SPACED)
    words = word_hashes(low, starts, ends)
    grams = window_hashes(words, WORDS)
    at = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= WORDS:
            out.append(np.unique(grams[a:b - WORDS + 1]))
        else:
            out.append(window_hashes(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def node_of(grams: np.ndarray) -> int:
    """The node of a set: 63 bits of a digest of its sorted hashes."""
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little") >> 1


def least_overlap(size: int) -> int:
    return -(-PERCENT * size // 100)


def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    for keys, texts in text_chunks(batches, "doc_id", "text", CHUNK_BYTES // 4):
        yield keys, shingle_sets(texts)


def census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, node, size) of each document, then the task's token counts: (null, token, documents), those that may
    be frequent (a bounded summary: counts are added, then the cut-off count is taken off all) and a hash slice."""
    tokens, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    pile: list[np.ndarray] = []
    piled = 0

    def settle() -> None:
        nonlocal tokens, counts, pile, piled
        own, n = np.unique(np.concatenate(pile), return_counts=True) if pile else (tokens[:0], counts[:0])
        all_tokens, back = np.unique(np.concatenate([tokens, own]), return_inverse=True)
        summed = np.bincount(back, weights=np.concatenate([counts, n]), minlength=len(all_tokens)).astype(np.int64)
        if len(all_tokens) > FREQUENT:
            cut = np.partition(summed, len(summed) - FREQUENT - 1)[len(summed) - FREQUENT - 1]
            summed = summed - cut
        tokens, counts, pile, piled = all_tokens[summed > 0], summed[summed > 0], [], 0

    for keys, sets in sets_of(batches):
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array([node_of(s) for s in sets], pa.int64()),
             pa.array([len(s) for s in sets], pa.int64())], ["doc_id", "node", "size"])
        pile += sets
        piled += sum(map(len, sets))
        if piled > 2 * FREQUENT:
            settle()
    settle()
    keep = (counts > 1) | (tokens % np.uint64(SLICE) == 0)
    tokens, counts = tokens[keep], counts[keep]
    for k in range(0, len(tokens), 100_000):
        part = tokens[k:k + 100_000]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(part), pa.int64()), pa.array(part.view(np.int64)), pa.array(-counts[k:k + 100_000])],
            ["doc_id", "node", "size"])


class Order:
    """The global token order and the filing of a set, as broadcast to the tasks."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, boundary: int):
        at = np.argsort(tokens)
        self.tokens, self.counts, self.boundary = tokens[at], counts[at], boundary

    def prefix(self, grams: np.ndarray, length: int) -> np.ndarray:
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, grams), len(self.tokens) - 1)
            rank = np.where(self.tokens[at] == grams, self.counts[at], 0)
            if rank.any():
                return grams[np.lexsort((grams, rank))[:length]]
        return grams[:length]

    def keys(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys that a set is filed under, and the position of the first of its tokens in the set's order."""
        size, least = len(grams), least_overlap(len(grams))
        if size < 4:            # 100 * overlap >= 80 * union then means equal sets
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = self.prefix(grams, size - least + 2)
        out, at = [], []
        if size <= self.boundary:
            i, j = np.triu_indices(len(first), 1)
            a, b = np.minimum(first[i], first[j]), np.maximum(first[i], first[j])
            h = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
            out.append((h ^ (h >> np.uint64(31))) | np.uint64(1))
            at.append(i)
        if size * 100 >= self.boundary * PERCENT:
            single = first[:size - least + 1]
            out.append((single ^ (single >> np.uint64(33))) & ~np.uint64(1))
            at.append(np.arange(len(single)))
        return (np.concatenate(out).view(np.int64), np.concatenate(at)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def bitmap_of(df: DataFrame, column: str, bits: int = BITMAP, slices: int = 64) -> np.ndarray:
    """A bitmap of ``bits`` bits with a bit for each value's hash: the same size however many values there are."""
    width = bits // slices

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        held = np.zeros(width // 8, dtype=np.uint8)
        for m in table["bits"]:
            held |= np.frombuffer(m.as_py(), dtype=np.uint8)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([held.tobytes()], pa.binary())})

    def spot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros(bits // 8, dtype=np.uint8)
        for b in batches:
            own = np.unique(slot(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits))
            if len(own):
                head = np.flatnonzero(np.append(True, np.diff(own >> 3) > 0))
                packed[own[head] >> 3] |= np.bitwise_or.reduceat((128 >> (own & 7)).astype(np.uint8), head)
        packed = packed.reshape(slices, -1)
        at = np.flatnonzero(packed.any(axis=1))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([packed[k].tobytes() for k in at], pa.binary())],
                                             ["slice", "bits"])

    out = np.zeros((slices, width // 8), dtype=np.uint8)
    for r in (df.select(column).coalesce(128).mapInArrow(spot, "slice int, bits binary").groupBy("slice")
              .applyInArrow(merge, "slice int, bits binary").toLocalIterator()):
        out[r["slice"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out.ravel()


def slot(values: np.ndarray, bits: int) -> np.ndarray:
    h = values * np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> np.uint64(32))) & np.uint64(bits - 1)).astype(np.int64)


def in_bitmap(packed: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = slot(values, len(packed) * 8)
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def boundary_of(sizes: DataFrame, tokens: DataFrame) -> int:
    """The size up to which sets are light, by least cost.  A light set costs its 2-subsets, a heavy one the entries of
    the lists that it scans: tokens times the mean length of the list that a token is in."""
    lengths = tokens.where(F.pmod("token", F.lit(SLICE)) == 0).agg(
        F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs"), F.sum("n").alias("all")).first()
    mean = float(lengths["pairs"] or 1) / float(lengths["all"] or 1)
    small = sizes.where(F.col("size") <= max(BOUNDARIES) * 100 // PERCENT).groupBy("size").count().collect()

    def cost(x: int) -> float:
        total = 0.0
        for r in small:
            s, n = r["size"], r["count"]
            p = s - least_overlap(s) + 1
            total += n * (p * (p + 1) / 2 if s <= x else p * mean) + (n * p if x * PERCENT <= s * 100 <= x * 100 else 0)
        return total
    return min(BOUNDARIES, key=cost)


def least_frequent(counts: DataFrame, most: int = FREQUENT) -> int:
    """The least count, 3 or more, that at most ``most`` tokens have."""
    held = {r["step"]: r["count"] for r in
            counts.where("n >= 3").groupBy(F.floor(F.log2(F.col("n") / 3.0)).cast("int").alias("step")).count().collect()}
    total, least = 0, None
    for k in sorted(held, reverse=True):
        total += held[k]
        if total > most:
            break
        least = k
    return 3 << (max(held, default=-1) + 1 if least is None else least)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of the nodes of ``edges`` (a, b): each takes its least neighbour, trees are cut short, and the graph
    is contracted until no edge is left.  The least node of a component is its comp."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stored(both.select(F.col("a").alias("node")).distinct().withColumn("comp", F.col("node")), "labels")
    left = stored(both.where("a <> b").distinct(), "edges")
    while not left.isEmpty():
        near = stored(left.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("up")), "hooks")
        hook = near
        for _ in range(2):
            top = near.select(F.col("a").alias("up"), F.col("up").alias("top"))
            hook = hook.join(top, "up").select("a", F.col("top").alias("up"))
        hook = stored(hook, "hooks")
        to = hook.select(F.col("a").alias("comp"), "up")
        labels = stored(labels.join(to, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")), "labels")
        a, b = hook.select("a", F.col("up").alias("x")), hook.select(F.col("a").alias("b"), F.col("up").alias("y"))
        left = stored(left.join(a, "a").join(b, "b").where("x <> y")
                      .select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
    return labels


def least_common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least overlap with which sets of sizes ``x`` and ``y`` link."""
    return -(-PERCENT * (x + y) // (100 + PERCENT))


def outline(grams: np.ndarray) -> bytes:
    """A bitmap of a set, with 4 to 8 bits an element."""
    bits = 1 << max(8, int(4 * len(grams) - 1).bit_length())
    held = np.zeros(bits, dtype=bool)
    held[(grams >> np.uint64(17)) & np.uint64(bits - 1)] = True
    return np.packbits(held).tobytes()


def sifted(pairs: DataFrame, outlines: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose bitmaps allow a link: the bits in which they differ are elements of one set only, and of
    those two sets that link have size + size - 2 * least overlap at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x, y = t.column("size_a").to_numpy(), t.column("size_b").to_numpy()
            most = x + y - 2 * least_common(x, y)
            keep = np.zeros(t.num_rows, dtype=bool)
            for k, (p, q) in enumerate(zip(t.column("bits_a").to_pylist(), t.column("bits_b").to_pylist())):
                p, q = np.frombuffer(p, dtype=np.uint8), np.frombuffer(q, dtype=np.uint8)
                while len(p) > len(q):
                    p = p[:len(p) // 2] | p[len(p) // 2:]
                while len(q) > len(p):
                    q = q[:len(q) // 2] | q[len(q) // 2:]
                keep[k] = np.bitwise_count((p ^ q).view(np.uint64)).sum() <= most[k]
            yield t.select(["a", "b"]).filter(pa.array(keep))

    a, b = (outlines.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab")
    return pairs.select("a", "b").join(a, "a").join(b, "b").mapInArrow(run, "a long, b long")


def sets_in(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, grams) of at least the ``nodes``, from the texts."""
    inside = docs.sparkSession.sparkContext.broadcast(bitmap_of(nodes, "node"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in sets_of(batches):
            ids = np.array([node_of(s) for s in sets], dtype=np.int64)
            at = np.flatnonzero(in_bitmap(inside.value, ids.view(np.uint64)))
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at]), pa.array([sets[k].view(np.int64) for k in at], pa.list_(pa.int64()))], ["node", "grams"])

    return docs.mapInArrow(gather, "node long, grams array<long>").groupBy("node").agg(F.first("grams").alias("grams"))


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose whole sets link."""
    a = sets.select(F.col("node").alias("a"), F.col("grams").alias("grams_a"))
    b = sets.select(F.col("node").alias("b"), F.col("grams").alias("grams_b"))
    common = F.size(F.array_intersect("grams_a", "grams_b"))
    return (pairs.select("a", "b").join(a, "a").join(b, "b")
            .where(common * 100 >= (F.size("grams_a") + F.size("grams_b") - common) * PERCENT).select("a", "b"))


def least_size(x):
    """``least_overlap`` of a column."""
    return F.ceil(x * F.lit(PERCENT) / F.lit(100.0) - F.lit(1e-9))


def may_link(x: str, y: str, met_x: str, met_y: str, boundary: int):
    """Sizes and prefixes allow a link.  ``met``: how many tokens of a set's 1-prefix are in the 1-prefix of others too.

    Of the common tokens, need - least overlap + 1 at least are in a set's 1-prefix, the first ones in the global order.
    Both prefixes have the smaller of the two numbers in common; a set's other tokens may be anywhere in the larger set.
    Only of sets that are both filed under their 1-prefix is this known."""
    x, y = F.col(x), F.col(y)
    need = F.ceil((x + y) * F.lit(PERCENT) / F.lit(100.0 + PERCENT) - F.lit(1e-9))
    both = need - F.greatest(least_size(x), least_size(y)) + 1
    filed = F.least(x, y) * 100 >= boundary * PERCENT
    return (x >= need) & (y >= need) & (~filed | (F.least(met_x, met_y) >= both))


def links(docs: DataFrame, tokens: DataFrame, boundary: int) -> DataFrame:
    """Components of the sets: (node, comp) of the nodes that link with another.

    ``docs``: (doc_id, text); ``tokens``: (token, n)."""
    spark = docs.sparkSession
    frequent = tokens.where("frequent").select("token", "n").toArrow()
    order = spark.sparkContext.broadcast(Order(frequent["token"].to_numpy().view(np.uint64), frequent["n"].to_numpy(), boundary))

    def filed(only: "object | None"):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, sets in sets_of(batches):
                held: tuple[list, list, list, list] = ([], [], [], [])
                for s in sets:
                    keys, at = order.value.keys(s)
                    if only is not None and len(keys):
                        hit = in_bitmap(only.value, keys.view(np.uint64))
                        keys, at = keys[hit], at[hit]
                    if len(keys):
                        for x, y in zip(held, (keys, np.full(len(keys), node_of(s)), np.full(len(keys), len(s)), at)):
                            x.append(y)
                if held[0]:
                    cols = [np.concatenate(x).astype(np.int64) for x in held]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "node", "size", "at"])
        return run

    schema = "key long, node long, size long, at long"
    shared = stored(docs.mapInArrow(filed(None), schema).groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"))
                    .where("low < high").select("key"), "shared-keys")
    hits = spark.sparkContext.broadcast(bitmap_of(shared, "key"))
    own = docs.mapInArrow(filed(hits), schema).groupBy("key", "node").agg(F.min("size").alias("size"), F.min("at").alias("at"))
    filings = stored(own.join(shared, "key"), "filings")
    # A list's pivot is the member with the least prefix tokens of its own: what copies were made from has its tokens in
    # common with them.
    single = F.count(F.when(F.pmod("key", F.lit(2)) == 0, 1))
    ranked = filings.groupBy("node").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n"), single.alias("met")).select(
        "node", (F.col("n") / F.col("size")).alias("common"), "met")
    # Tokens of the node's 1-prefix that others have in theirs too, from this one on.
    onward = Window.partitionBy("node").orderBy("at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = stored(filings.join(ranked, "node").withColumn("onward", single.over(onward)), "ranked")
    forget(filings)
    pivots = (ranked.groupBy("key").agg(F.max(F.struct("common", "node", "size", "met")).alias("best"))
              .select("key", F.col("best.node").alias("pivot"), F.col("best.size").alias("pivot_size"),
                      F.col("best.met").alias("pivot_met"), F.col("best.common").alias("worth")))
    members = stored(ranked.join(stored(pivots, "pivots"), "key"), "members")
    forget(ranked)

    inside = spark.sparkContext.broadcast(bitmap_of(members.select("node").distinct(), "node"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in sets_of(batches):
            ids = np.array([node_of(s) for s in sets], dtype=np.int64)
            at = np.flatnonzero(in_bitmap(inside.value, ids.view(np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[at]), pa.array([len(sets[k]) for k in at], pa.int64()), pa.array([outline(sets[k]) for k in at], pa.binary())],
                ["node", "size", "bits"])

    outlines = stored(docs.mapInArrow(draw, "node long, size long, bits binary").groupBy("node").agg(
        F.first("size").alias("size"), F.first("bits").alias("bits")), "outlines")

    stars = (members.where("node <> pivot").where(may_link("size", "pivot_size", "met", "pivot_met", boundary))
             .groupBy(F.col("pivot").alias("a"), F.col("node").alias("b")).agg(F.max("worth").alias("worth")))
    stars = stored(sifted(stars, outlines).join(stars, ["a", "b"]), "stars")
    sets = stored(sets_in(docs, ends_of(stars)), "sets")
    first = stored(stars.groupBy("b").agg(F.max_by("a", F.struct("worth", "a")).alias("a")).select("a", "b"), "pairs")
    found = stored(verified(first, sets), "links")
    labels = components(found)

    def apart(pairs: DataFrame) -> DataFrame:
        ca = labels.select(F.col("node").alias("a"), F.col("comp").alias("comp_a"))
        cb = labels.select(F.col("node").alias("b"), F.col("comp").alias("comp_b"))
        return (pairs.join(ca, "a", "left").join(cb, "b", "left")
                .where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b"))

    second = stored(apart(stars.join(first, ["a", "b"], "left_anti")), "pairs")
    more = stored(verified(second, sets), "links")
    if not more.isEmpty():
        found = stored(found.unionByName(more), "links")
        labels = components(found)

    # Members of a list that are still in different components meet each other, the pivot apart: all have met it.  It is
    # enough that a pair that links meets at its first common key, where all that both prefixes have in common is yet to come.
    placed = members.where("node <> pivot").join(labels, "node", "left").select(
        "key", "node", "size", "at", "onward", F.coalesce("comp", "node").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    open_lists = stored(placed.join(mixed, "key"), "open-lists")
    x = open_lists.select("key", *(F.col(c).alias(c + "_x") for c in ("node", "size", "at", "onward", "comp")))
    y = open_lists.select("key", *(F.col(c).alias(c + "_y") for c in ("node", "size", "at", "onward", "comp")))
    need = F.ceil((F.col("size_x") + F.col("size_y")) * F.lit(PERCENT) / F.lit(100.0 + PERCENT) - F.lit(1e-9))
    third = (x.join(y, "key").where("node_x < node_y").where(F.col("comp_x") != F.col("comp_y"))
             .where(may_link("size_x", "size_y", "onward_x", "onward_y", boundary))
             .where((F.col("at_x") <= F.col("size_x") - need) & (F.col("at_y") <= F.col("size_y") - need))
             .select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct())
    third = stored(sifted(third, outlines).join(second.unionByName(first), ["a", "b"], "left_anti"), "pairs")
    if not third.isEmpty():
        forget(sets)
        last = stored(verified(third, stored(sets_in(docs, ends_of(third)), "sets")), "links")
        labels = components(found.unionByName(last))
    return labels


def near_copies(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = stored(docs.withColumn("doc_id", F.col("doc_id")).mapInArrow(census, "doc_id long, node long, size long"), "census")
    own = counted.where("size >= 0")
    counts = stored(counted.where("size < 0").groupBy(F.col("node").alias("token")).agg(F.sum(-F.col("size")).alias("n")), "counts")
    tokens = stored(counts.withColumn("frequent", F.col("n") >= F.lit(least_frequent(counts)))
                    .where(F.col("frequent") | (F.pmod("token", F.lit(SLICE)) == 0)), "tokens")
    forget(counts)
    nodes = stored(own.where("size > 0").groupBy("node").agg(F.min("size").alias("size"), F.min("doc_id").alias("least_id")), "nodes")
    labels = links(docs, tokens, boundary_of(nodes, tokens))
    classes = stored(nodes.join(labels, "node", "left").select("node", "least_id", F.coalesce("comp", "node").alias("comp")), "classes")
    ids = classes.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    by_node = stored(classes.join(ids, "comp").select("node", "component_id"), "by-node")
    return own.join(by_node, "node", "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with the first document of each component; documents without words all stay."""
    keep = near_copies(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["_kept_id"]), "left_semi")


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Every document, 5-word shingles, similarity of 0.8 or more."""
    return near_copies(read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ') || '/' || least(5, len(w))) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r(doc_id, r) AS (
  SELECT doc_id, doc_id FROM w
  UNION SELECT e.a, r.r FROM r JOIN e ON e.b = r.doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id)
JOIN (SELECT doc_id, min(r) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""
