"""Candidate assembly and sequential-dependence reranking.

The reference scores a (query, passage) pair from a match matrix
``M[i, j] = w_q[i] * logit(doc position j -> query token i)`` with tensor shifts.  Here Spark assembles each candidate
passage's matrix as a row: the query's side (which document terms reach which of its positions, and how strongly) is
built once from the expansion table, and the tokens of the candidates' passages are joined with it on (query, term).
A small numpy function then takes the windows of one matrix:

* cells ``(i, j, m)``, slots with one zero-weight boundary at each end (``q_len = tokens + 2``, ``d_len = tokens + 2``);
* ordered window n: sum of m along a diagonal of n cells (exact: all n present), max over its start j, sum over i;
* proximity P: ``p(i, b) = max_{k<P} m(i, b+k)``;
* unordered window n: sum of n successive p(i, b) (exact: all n present), max over b, sum over i.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segrank.functions.numeric import log1p_relu, r6
from segrank.plans.util import small

PAIR = ["qid", "doc_id"]
CELL_KEYS = ["qid", "doc_id", "psg", "q_len", "d_len"]


@dataclass(frozen=True)
class SdmConfig:
    """One reranker configuration."""
    exact: bool = True
    windows: tuple = (1, 2)
    proximity: int = 8
    n_psg: int = 1

    @property
    def feature_names(self) -> list[str]:
        return [f"O_{w}" for w in self.windows] + [f"U_{w}_p_{self.proximity}" for w in self.windows[1:]]

    @property
    def config_id(self) -> str:
        v = "exact" if self.exact else "soft"
        return f"{v}_w{'-'.join(map(str, self.windows))}_p{self.proximity}_n{self.n_psg}"


# --------------------------------------------------------------- assembly

def candidates(run: DataFrame, k: int) -> DataFrame:
    """F3 inside K1: first ``k`` candidates per query in rank order."""
    w = Window.partitionBy("qid").orderBy("rank")
    return run.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def pair_table(run: DataFrame, queries: DataFrame, passages: DataFrame, k: int, n_psg: int) -> DataFrame:
    """K1: (query, candidate, passage) rows for the first ``n_psg`` passages
    of the top-``k`` candidates.  Candidates of unknown queries are dropped
    (inner join); a candidate without passages keeps one row with NULL
    passage (its features are 0)."""
    c = candidates(run, k).join(queries.select("qid", F.col("text").alias("query")), "qid")
    return c.join(first_passages(passages, c, n_psg), "doc_id", "left").select("qid", "doc_id", "rank", "query", "psg", "text")


def first_passages(passages: DataFrame, wanted: DataFrame, n_psg: int) -> DataFrame:
    """``(doc_id, psg, text)`` of the first ``n_psg`` passages of the documents that ``wanted`` names: the others stay where they are."""
    return (passages.filter(F.col("psg") < n_psg).join(small(wanted.select("doc_id").distinct()), "doc_id", "left_semi")
            .select("doc_id", "psg", "text"))


def clean_triplets(triplets: DataFrame, passages: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Keep triplets whose positive and negative documents exist (and,
    optionally, whose query exists)."""
    docs = passages.select("doc_id").join(small(triplet_documents(triplets)), "doc_id", "left_semi").distinct()
    t = triplets.join(small(docs.withColumnRenamed("doc_id", "pos_id")), "pos_id", "left_semi") \
        .join(small(docs.withColumnRenamed("doc_id", "neg_id")), "neg_id", "left_semi")
    if queries is not None:
        t = t.join(queries.select("qid"), "qid", "left_semi")
    return t.select("qid", "pos_id", "neg_id")


def triplet_documents(triplets: DataFrame) -> DataFrame:
    """``(doc_id)``: each document of a triplet once.  They are few beside the triplets, which are positives times negatives."""
    return triplets.select(F.explode(F.array("pos_id", "neg_id")).alias("doc_id")).distinct()


def triplet_passages(triplets: DataFrame, passages: DataFrame, n_psg: int) -> DataFrame:
    """K2: positive and negative passages of every triplet, tagged by role."""
    t = triplets.select("qid", "pos_id", "neg_id", F.explode(F.array(
        F.struct(F.lit("pos").alias("role"), F.col("pos_id").alias("doc_id")),
        F.struct(F.lit("neg").alias("role"), F.col("neg_id").alias("doc_id")))).alias("x")) \
        .select("qid", "pos_id", "neg_id", "x.role", "x.doc_id")
    p = first_passages(passages, triplet_documents(triplets), n_psg)
    return t.join(p, "doc_id").select("qid", "pos_id", "neg_id", "role", "doc_id", "psg", "text")


BLOCK_DOCS = 256      # documents of one role in a block of triplets, about


def text_triplets(triplets: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """K3: triplets with the query text and both document texts.

    A query's triplets are cut into blocks by hashes of the positive and of the negative.  A block gets the texts of its
    documents once: a row a positive, with its negatives' ids, and one row of the negatives' texts, which meet on the block and are
    opened there.  So no row with a triplet's texts is exchanged; what is grows with the documents times the blocks."""
    per = triplets.groupBy("qid").agg(*[F.ceil(F.approx_count_distinct(f"{role}_id") / F.lit(BLOCK_DOCS)).alias(f"{role}_blocks") for role in ("pos", "neg")])
    block = ["qid", "pos_block", "neg_block"]
    of = lambda role: F.pmod(F.xxhash64(f"{role}_id"), F.greatest(F.col(f"{role}_blocks"), F.lit(1))).alias(f"{role}_block")
    placed = triplets.join(small(per), "qid").select("qid", of("pos"), of("neg"), "pos_id", "neg_id")
    text = lambda role: corpus.select(F.col("doc_id").alias(f"{role}_id"), F.col("text").alias(role)).join(
        small(triplets.select(f"{role}_id").distinct()), f"{role}_id", "left_semi")
    pos = (placed.groupBy(*block, "pos_id", "neg_id").agg(F.count(F.lit(1)).cast("int").alias("copies"))
           .groupBy(*block, "pos_id", "copies").agg(F.collect_list("neg_id").alias("wanted"))
           .join(text("pos"), "pos_id").join(queries.select("qid", F.col("text").alias("query")), "qid"))
    neg = placed.select(*block, "neg_id").distinct().join(text("neg"), "neg_id").groupBy(*block).agg(F.collect_list(F.struct("neg_id", "neg")).alias("side"))
    mine = F.filter("side", lambda x: F.array_contains("wanted", x["neg_id"]))
    rows = F.when(F.col("copies") == 1, mine).otherwise(F.flatten(F.array_repeat(mine, F.col("copies"))))
    return (pos.join(neg, block).select("qid", "pos_id", "query", "pos", F.inline(rows))
            .select("qid", "pos_id", "neg_id", "query", "pos", "neg"))


# ------------------------------------------------------------------ cells

def query_slots(query_tokens: DataFrame, term_weights: DataFrame) -> DataFrame:
    """``(qid, i, term, wq, q_len)``: slot i = token position + 1; the
    weight of a term unknown to the weight table is 0."""
    qlen = query_tokens.groupBy("qid").agg((F.count(F.lit(1)) + 2).cast("int").alias("q_len"))
    return (query_tokens.join(term_weights, "term", "left").join(qlen, "qid")
            .select("qid", (F.col("pos") + 1).alias("i"), "term",
                    F.coalesce(F.col("scale"), F.lit(0.0)).alias("wq"), "q_len"))


def query_expansion(qslots: DataFrame, expansion: DataFrame) -> DataFrame:
    """K4/K5 from the query's side: ``(qid, q_len, term, cells ARRAY<STRUCT<i, m, same>>)``.  A document token ``term`` matches
    query position i with ``m = w_q * log1p(relu(s))`` where it expands to that position's term; ``same`` marks equal terms,
    the exact cells.  Only expansions that end in a query term are read, and a row has at most q_len cells."""
    q = qslots.filter(F.col("wq") > 0).select("qid", "q_len", "i", F.col("term").alias("to"), "wq")
    hits = expansion.select("src_term", F.col("term").alias("to"), "s").join(small(q), "to").select(
        "qid", "q_len", F.col("src_term").alias("term"), F.col("i").cast("int").alias("i"),
        (F.col("wq") * log1p_relu(F.col("s"))).alias("m"), (F.col("src_term") == F.col("to")).alias("same"))
    return hits.where("m > 0").groupBy("qid", "q_len", "term").agg(F.collect_list(F.struct("i", "m", "same")).alias("cells"))


def candidate_terms(pairs: DataFrame, passage_terms: DataFrame, n_psg: int) -> DataFrame:
    """``(qid, term)``: the terms in the first ``n_psg`` passages of a query's candidates, each once."""
    tokens = candidate_passages(pairs, passage_terms, n_psg).select("qid", F.explode("terms").alias("term"))
    return tokens.distinct()


def candidate_passages(pairs: DataFrame, passage_terms: DataFrame, n_psg: int) -> DataFrame:
    return passage_terms.where(F.col("psg") < n_psg).join(small(pairs.select(*PAIR).distinct()), "doc_id")


def expansion_of(wanted: DataFrame, qslots: DataFrame, expansion: DataFrame) -> DataFrame:
    """:func:`query_expansion` for the ``wanted(qid, term)`` alone.  Each is asked for with the terms of its query, so what is
    exchanged grows with the candidates and the queries' lengths; a stop word's neighbours are not copied for its queries."""
    q = qslots.filter(F.col("wq") > 0).select("qid", "q_len", F.col("term").alias("to"), "wq", F.col("i").cast("int").alias("i"))
    slots = q.groupBy("qid", "q_len", "to", "wq").agg(F.collect_list("i").alias("at"))
    known = expansion.select(F.col("src_term").alias("term"), F.col("term").alias("to"), "s").join(small(q.select("to").distinct()), "to", "left_semi")
    hits = (wanted.join(small(slots), "qid").join(known, ["term", "to"])
            .select("qid", "q_len", "term", "at", (F.col("wq") * log1p_relu(F.col("s"))).alias("m"), (F.col("term") == F.col("to")).alias("same")))
    cells = F.transform("at", lambda i: F.struct(i.alias("i"), F.col("m").alias("m"), F.col("same").alias("same")))
    return hits.where("m > 0").groupBy("qid", "q_len", "term").agg(F.flatten(F.collect_list(cells)).alias("cells"))


def match_rows(pairs: DataFrame, passage_terms: DataFrame, query_cells: DataFrame, n_psg: int) -> DataFrame:
    """The match matrix of every candidate passage as one row: ``(qid, doc_id, psg, q_len, d_len, columns
    ARRAY<STRUCT<j, cells>>)`` for the first ``n_psg`` passages; slots are positions + 1, lengths have the two boundary slots.
    A passage without a match has no row."""
    psgs = candidate_passages(pairs, passage_terms, n_psg)
    tokens = psgs.select(*PAIR, "psg", (F.size("terms") + 2).alias("d_len"), F.posexplode("terms").alias("pos", "term"))
    hits = tokens.join(query_cells, ["qid", "term"])
    return hits.groupBy(*CELL_KEYS).agg(F.collect_list(F.struct((F.col("pos") + 1).alias("j"), "cells")).alias("columns"))


def cells(rows: DataFrame) -> DataFrame:
    """``(qid, doc_id, psg, q_len, d_len, i, j, m, same)`` of the matrices."""
    return rows.select(*CELL_KEYS, F.inline("columns")).select(*CELL_KEYS, "j", F.inline("cells"))


# --------------------------------------------------------------- features

@dataclass(frozen=True)
class Shape:
    """Windows, proximity and variant of a feature vector: a configuration without its passage count."""
    exact: bool
    windows: tuple
    proximity: int

    @property
    def name(self) -> str:
        return f"{'exact' if self.exact else 'soft'}_w{'-'.join(map(str, self.windows))}_p{self.proximity}"


def shape_of(cfg: SdmConfig) -> Shape:
    return Shape(cfg.exact, tuple(cfg.windows), cfg.proximity)


def window_maxima(m, height: int, width: int, n: int, p: int, exact: bool):
    """For one stretch of document slots: the best ordered window (K7/K8) and the best unordered one over proximity
    for each query start, over the window starts 0 .. ``width`` - 1.  ``m`` has slots beyond ``width`` as far as windows reach."""
    import numpy as np
    starts = height - n + 1
    ordered = sum(m[k:k + starts, k:k + width] for k in range(n))
    near = m[:, :width].copy()
    for k in range(1, p):
        np.maximum(near, m[:, k:k + width], out=near)
    unordered = sum(near[k:k + starts] for k in range(n))
    if exact:
        for k in range(n):
            ordered = np.where(m[k:k + starts, k:k + width] > 0, ordered, 0.0)
            unordered = np.where(near[k:k + starts] > 0, unordered, 0.0)
    return ordered, unordered


def matrix_features(q_len: int, d_len: int, i, j, m, same, shape: Shape, block: int = 4096) -> dict[str, float]:
    """K6-K12 of one match matrix, given by its cells; features without any window are left out.  ``O_1`` uses the soft
    cells in both variants (Q6).  The matrix is laid out ``block`` document slots at a time, so that a passage of any
    length takes bounded memory: maxima over window starts are taken block by block."""
    import numpy as np
    best = np.zeros(q_len)
    np.maximum.at(best, i, m)
    out = {"O_1": float(best.sum())}
    if shape.exact:
        i, j, m = i[same], j[same], m[same]
    p = shape.proximity
    for n in shape.windows:
        if n == 1:
            continue
        if q_len < n or not len(m):
            continue
        top_o, top_u = np.zeros(q_len - n + 1), np.zeros(q_len - n + 1)
        reach = max(n, p)
        for start in range(0, d_len, block):
            inside = (j >= start) & (j < start + block + reach)
            if not inside.any():
                continue
            grid = np.zeros((q_len, block + reach if d_len - start > block else d_len - start + reach))
            grid[i[inside], j[inside] - start] = m[inside]
            width = min(block, d_len - start)
            ordered, unordered = window_maxima(grid, q_len, width, n, p, shape.exact)
            for part, top, size in ((ordered, top_o, n), (unordered, top_u, p)):
                allowed = min(width, d_len - size - start + 1)      # window starts 0 .. d_len - size
                if allowed > 0:
                    np.maximum(top, part[:, :allowed].max(axis=1), out=top)
        out[f"O_{n}"], out[f"U_{n}_p_{p}"] = float(top_o.sum()), float(top_u.sum())
    return {k: v for k, v in out.items() if v > 0}


def feature_rows(shapes: list[Shape]):
    """Arrow function: match rows to ``(qid, doc_id, psg, shape, feature, value)``, one matrix at a time."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("qid", "doc_id", "psg", "shape", "feature", "value")}
            columns = b.column("columns")
            keys = [b.column(c).to_pylist() for c in ("qid", "doc_id", "psg", "q_len", "d_len")]
            for k in range(b.num_rows):
                mine = columns[k].values
                lists = mine.field("cells")
                sizes = np.asarray(lists.value_lengths())
                flat = lists.flatten()
                i, m, same = (np.asarray(flat.field(c).to_numpy(zero_copy_only=False)) for c in ("i", "m", "same"))
                j = np.repeat(np.asarray(mine.field("j")), sizes)
                for shape in shapes:
                    for feature, value in matrix_features(keys[3][k], keys[4][k], i, j, m, same.astype(bool), shape).items():
                        for c, v in zip(out, (keys[0][k], keys[1][k], keys[2][k], shape.name, feature, value)):
                            out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (
                pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64()))], list(out))
    return run


def shape_features(rows: DataFrame, shapes: list[Shape]) -> DataFrame:
    """K12 for several shapes in one pass over the matrices: ``(qid, doc_id, psg, shape, feature, value)``.

    Soft matrices are dense (every stop word reaches most positions), so windows over them are sliding sums of an array; as
    rows, each cell would be multiplied by the window and the proximity."""
    return rows.mapInArrow(feature_rows(shapes), "qid string, doc_id string, psg int, shape string, feature string, value double")


def passage_features(rows: DataFrame, cfg: SdmConfig) -> DataFrame:
    """``(qid, doc_id, psg, feature, value)`` for one configuration."""
    return shape_features(rows, [shape_of(cfg)]).drop("shape")


def pooled_features(pfeat: DataFrame, pairs: DataFrame, cfg: SdmConfig) -> DataFrame:
    """Per-feature max over the passages of a document; every pair gets
    every feature (0 when it has no cell or no passage)."""
    pooled = pfeat.groupBy("qid", "doc_id", "feature").agg(F.max("value").alias("value"))
    names = F.explode(F.array(*[F.lit(f) for f in cfg.feature_names])).alias("feature")
    grid = pairs.select(*PAIR).distinct().select(*PAIR, names)
    return grid.join(pooled, [*PAIR, "feature"], "left").select(
        *PAIR, "feature", F.coalesce(F.col("value"), F.lit(0.0)).alias("value"))


def default_weights(cfg: SdmConfig) -> dict[str, float]:
    """Fixed fusion weights used when none were fitted: 1 for the unigram
    feature, 0.5 for ordered, 0.25 for unordered windows."""
    w = {}
    for f in cfg.feature_names:
        w[f] = 1.0 if f == "O_1" else (0.5 if f.startswith("O_") else 0.25)
    return w


def fuse(pooled: DataFrame, weights: DataFrame, bias: float = 0.0) -> DataFrame:
    """``score = sum_f weight_f * value_f + bias`` per (query, doc);
    ``weights(feature, weight)`` has one row per feature (broadcast)."""
    j = pooled.join(small(weights), "feature")
    return j.groupBy(*PAIR).agg(r6(F.sum(F.col("weight") * F.col("value")) + F.lit(bias)).alias("score"))


def weights_frame(spark, weights: dict[str, float]) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "feature string, weight double")


def rerank(pairs: DataFrame, scores: DataFrame, k: int | None = None) -> DataFrame:
    """New run from fused scores (ties: doc_id ascending)."""
    s = pairs.select(*PAIR).distinct().join(scores, PAIR, "left") \
        .select(*PAIR, F.coalesce(F.col("score"), F.lit(0.0)).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("doc_id").asc())
    out = s.withColumn("rank", F.row_number().over(w).cast("int"))
    if k is not None:
        out = out.filter(F.col("rank") <= k)
    return out.select("qid", "doc_id", "rank", "score")


def feature_differences(features: DataFrame, triplets: DataFrame, names: list[str]) -> DataFrame:
    """``(qid, pos_id, neg_id, d0, d1, ..)``: the positive's features less the negative's."""
    wide = features.groupBy(*PAIR).agg(*[F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f"v{k}") for k, f in enumerate(names)])
    side = lambda role: wide.select("qid", F.col("doc_id").alias(f"{role}_id"), *[F.col(f"v{k}").alias(f"{role}{k}") for k in range(len(names))])
    t = triplets.join(side("pos"), ["qid", "pos_id"]).join(side("neg"), ["qid", "neg_id"])
    return t.select("qid", "pos_id", "neg_id", *[(F.col(f"pos{k}") - F.col(f"neg{k}")).alias(f"d{k}") for k in range(len(names))])


def fit_fusion_weights(differences: DataFrame, names: list[str], reg: float = 1e-3, tol: float = 1e-9,
                       max_steps: int = 25) -> tuple[dict[str, float], list[tuple[int, str, float]]]:
    """Pairwise softmax cross-entropy of (pos, neg) with a linear scorer and frozen features: the mean of
    ``log(1 + exp(-w.d))`` plus ``reg / 2 |w|^2`` over the differences d (the bias cancels; the small penalty keeps separable
    data finite).

    Newton's method: each step is one aggregation over all differences, which yields loss, gradient and curvature (a
    handful of sums, combined map-side), until the largest part of the gradient is below ``tol``.  ``differences`` is a stored
    table, so that a step reads it and nothing else.  Returns the weights and the log ``(step, name, value)``: the loss and each
    weight before every step (M6).  Without differences all weights are 0."""
    import numpy as np
    size = len(names)
    d = [F.col(f"d{k}") for k in range(size)]
    w, log = np.zeros(size), []
    for step in range(max_steps):
        z = sum((F.lit(float(w[k])) * d[k] for k in range(1, size)), F.lit(float(w[0])) * d[0])
        z = F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(z))
        row = differences.select(*d, p.alias("p"), F.log1p(F.exp(-z)).alias("loss")).agg(
            F.avg("loss"), *[F.avg(F.col("p") * x) for x in d],
            *[F.avg(F.col("p") * (1 - F.col("p")) * d[i] * d[j]) for i in range(size) for j in range(size)]).first()
        if row[0] is None:
            break
        gradient = -np.array(row[1:1 + size]) + reg * w
        curvature = np.array(row[1 + size:]).reshape(size, size) + reg * np.eye(size)
        log += [(step, "loss", float(row[0]))] + [(step, f, float(x)) for f, x in zip(names, w)]
        if np.abs(gradient).max() < tol:
            break
        w = w - np.linalg.solve(curvature, gradient)
    return {f: float(x) for f, x in zip(names, w)}, log


def grid_runs(rows: DataFrame, pairs: DataFrame, configs: list[SdmConfig], weights: dict[str, dict[str, float]]) -> DataFrame:
    """Every configuration in one job.  Each match matrix yields the features of all shapes at once; a passage ``psg``
    then serves every configuration with ``n_psg > psg`` (one explode), pooling / fusion / ranking are keyed by
    ``config_id``.  ``weights`` maps config_id -> {feature: weight}.  Returns ``(config_id, qid, doc_id, rank, score)``."""
    spark = pairs.sparkSession
    shapes = sorted({shape_of(c) for c in configs}, key=lambda s: s.name)
    ids = F.array(*[F.struct(F.lit(shape_of(c).name).alias("shape"), F.lit(c.n_psg).alias("n"), F.lit(c.config_id).alias("config_id"))
                    for c in configs])
    x = shape_features(rows, shapes).select("*", F.explode(F.filter(
        ids, lambda e: (F.col("shape") == e["shape"]) & (F.col("psg") < e["n"]))).alias("c")) \
        .select(F.col("c.config_id").alias("config_id"), *PAIR, "feature", "value")
    pooled = x.groupBy("config_id", *PAIR, "feature").agg(F.max("value").alias("value"))
    wdf = spark.createDataFrame([(cid, f, float(v)) for cid, fw in weights.items() for f, v in fw.items()],
                                "config_id string, feature string, weight double")
    found = pooled.join(small(wdf), ["config_id", "feature"]).groupBy("config_id", *PAIR) \
        .agg(F.sum(F.col("weight") * F.col("value")).alias("score"))
    every = pairs.select(*PAIR).distinct().select(F.explode(F.array(*[F.lit(c.config_id) for c in configs])).alias("config_id"), *PAIR)
    scores = every.join(found, ["config_id", *PAIR], "left").withColumn("score", r6(F.coalesce("score", F.lit(0.0))))
    w = Window.partitionBy("config_id", "qid").orderBy(F.col("score").desc(), F.col("doc_id").asc())
    return scores.withColumn("rank", F.row_number().over(w).cast("int")).select("config_id", *PAIR, "rank", "score")
