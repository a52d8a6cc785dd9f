"""Stages of the pipeline against plain Python on a small table, and on an empty one."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from segrank.llm import token_orc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(12)
    words = ["".join(r.choice("abcdefgé") for _ in range(r.randint(2, 7))) for _ in range(400)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(5, 120))) for _ in range(60)]
    texts = list(base)
    for t in base[:25]:
        w = t.split()
        w[r.randrange(len(w))] = "other"
        texts.append(" ".join(w))
        texts.append(t.upper() + " " + " ".join(r.choice(words) for _ in range(r.randint(0, 12))))
    texts += [base[40] + " " + base[41], None, "", "x y", "X  y", " ".join(words[:30]) + " tail", "head " + " ".join(words[5:15])]
    return [(k, t, "en", None if k % 7 == 0 else f"s{k % 4}", 0) for k, t in enumerate(texts)], " ".join(words[:20])


@pytest.fixture(scope="module")
def sf(spark, rows, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("stage"))
    spark.createDataFrame([(1, rows[1]), (2, None), (3, "x y"), (4, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def kept(spark, name, rows, sf):
    return sorted(x.doc_id for x in STAGE[name](spark, spark.createDataFrame(rows[0], DOCS), sf).collect())


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near_copies_stage(spark, rows, sf):
    sets = [shingles(t) for _, t, *_ in rows[0]]
    comp = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for a in range(len(sets)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                    low = min(comp[a], comp[b])
                    comp = [low if c in (comp[a], comp[b]) else c for c in comp]
                    changed = True
    want = [k for k, c in enumerate(comp) if k == c]
    assert kept(spark, "near_copies", rows, sf) == want and len(want) < len(sets)


def test_decontamination_stage(spark, rows, sf):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    windows = set()
    for item in (rows[1], "x y"):
        w = find(item)
        windows |= {tuple(w[i:i + 10]) for i in range(len(w) - 9)} if len(w) >= 10 else {tuple(w)}
    want = []
    for k, t, *_ in rows[0]:
        w = find(t)
        if not any(tuple(w[i:i + len(x)]) == x for x in windows for i in range(len(w))):
            want.append(k)
    assert kept(spark, "decontamination", rows, sf) == want and len(want) < len(rows[0])


def test_token_stage(spark, rows, sf):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(str(token_orc.tokenizer_path()))
    some = rows[0][:30]
    got = sorted(((x.doc_id, x.start, x.n_tokens, x.ids_crc32) for x in STAGE["tokens"](spark, spark.createDataFrame(some, DOCS), sf).collect()))
    at, want = 0, []
    for k, t, *_ in some:
        ids = [*(tok.encode(t, add_special_tokens=False).ids if t else []), 2]
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


@pytest.mark.parametrize("name", ["near_copies", "decontamination", "mixing", "tokens"])
def test_empty_stage(spark, sf, name):
    docs = spark.createDataFrame([], DOCS)
    out = STAGE[name](spark, docs, sf)
    assert out.count() == 0 and (name == "tokens" or out.columns == docs.columns)
