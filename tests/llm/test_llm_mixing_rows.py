"""op6's ``mixed`` with ids that repeat, null ids, equal rows and clashing columns."""

import collections
import random

from segrank.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, copies int, size long"


def test_rows_of_a_repeated_id_are_taken_one_by_one(spark):
    r = random.Random(2)
    rows = [(None if k % 40 == 0 else k % 8, " ".join("w" for _ in range(r.randint(1, 60))) + f" {k if k % 10 else ''}", "en",
             ["a", "b", "c", "d", None][k % 5], 1, 2) for k in range(600)]
    rows += rows[:30] + [(9, None, "en", "a", 1, 2), (9, "", None, "b", 1, 2)]
    docs = spark.createDataFrame(rows, DOCS)
    out = [tuple(x) for x in mixing.mixed(docs).collect()]
    have, took = collections.Counter(rows), collections.Counter(out)
    assert set(took) <= set(have) and all(took[x] <= 3 * have[x] for x in took)
    target = {x.source_no: x.target for x in mixing.mix(docs).collect()}
    names = sorted({x[3] for x in rows if x[3]}) + [None]
    words = collections.Counter()
    for x in out:
        words[x[3]] += len((x[1] or "").split())
    for k, name in enumerate(names):
        want = next(t for n, t in target.items() if n == min(target) + k)
        assert abs(words[name] - want) <= 130, (name, words[name], want)
    assert sorted(out, key=repr) == sorted((tuple(x) for x in mixing.mixed(docs).collect()), key=repr)
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.mixed(docs).columns == docs.columns
