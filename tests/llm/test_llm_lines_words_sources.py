"""Line quality, spelling variants and source divergence against plain Python: nulls, empty and long texts, ties, repeated
rows, null and repeated ids, empty tables, extra columns with clashing names."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from segrank.llm import divergence, line_rules, queries, spelling

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n long, word string, key string, value long, rank int, marks string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, s, 5, "w", "k", 9, 1, "CB") for i, t, g, s in rows], DOCS)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def sql_rows(sql, columns, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return sorted(con.sql(sql).select(*columns).fetchall(), key=repr)


def test_registered_names():
    assert [sum(q.startswith(f"op{n}_") for q in queries.QUERIES) for n in range(11, 14)] == [1] * 3


# ------------------------------------------------------------------ line quality

def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


LINES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_line_counts(spark):
    r = random.Random(5)
    texts = [None, "", " \n\t\x0b\x0c\r\n ", "a b c a b c", "a a a a", "a a a", "a b c", "x y z é\u0085 ß", "same\nsame\n same\nsame",
             "# * | <b>&\n\n$$%% é", "\x1c one\x1f two\x00 three", "q " * 49, "q " * 50, " ".join(f"w{k}" for k in range(50)),
             " ".join(f"w{k % 40}" for k in range(70)), "z" * 200_000, " ".join(str(r.randint(0, 9)) for _ in range(30_000)),
             *["\n".join(" ".join(r.choice("a b c dé e|f #".split(" ")) for _ in range(r.randint(0, 9))) for _ in range(r.randint(1, 20)))
               for _ in range(40)]]
    docs = frame(spark, [(None if k == 3 else k // 2, t, "en", None) for k, t in enumerate(texts)])
    got = line_rules.marked(docs, None)
    want = sorted(((None if k == 3 else k // 2, *plain_counts(t)) for k, t in enumerate(texts)), key=repr)
    assert rows_of(got, *LINES) == want
    assert all(r.kept == (not r.base_failed) and "B" not in r.marks for r in got.collect())
    marks = rows_of(got, "n_words", "marks")
    assert marks == sorted(((plain_counts(t)[0], "".join("C" if x.split(" ") and re.search(r"[^\x20\x09-\x0D]", x) else "-"
                                                         for x in (t or "").split("\n"))) for t in texts), key=repr)
    assert line_rules.marked(docs.limit(0), None).count() == 0


def random_field(seed):
    r = np.random.default_rng(seed)
    return line_rules.Field(r.normal(size=len(line_rules.FIGURES) * line_rules.WIDTH), r.normal(size=2), r.normal(size=(2, 2)))


def path_score(field, scores, path):
    return (field.start[path[0]] + sum(s for s, x in zip(scores, path) if x)
            + sum(field.step[a, b] for a, b in zip(path, path[1:])))


@pytest.mark.parametrize("seed", range(8))
def test_viterbi_against_all_paths(seed):
    field, r = random_field(seed), np.random.default_rng(seed)
    for n in range(1, 9):
        scores = r.normal(size=n) * 2
        best = max(itertools.product((0, 1), repeat=n), key=lambda p: path_score(field, scores, p))
        assert tuple(line_rules.decode(field, scores).astype(int)) == best


def test_fit_gradient_is_zero_at_the_optimum():
    """The fitted weights are a maximum of the penalised likelihood, which is summed over all paths here."""
    r = np.random.default_rng(1)
    width = line_rules.WIDTH
    lines = [np.stack([r.integers(0, 3, size=n) + k * width for k in range(len(line_rules.FIGURES))], axis=1) for n in (1, 2, 4, 3, 4)]
    states = [r.integers(0, 2, size=len(x)) for x in lines]
    field = line_rules.fit(lines, states, steps=1500, rate=0.03, decay=0.05)

    def objective(f):
        out = 0
        for x, s in zip(lines, states):
            scores = f.bins[x].sum(axis=1)
            every = [path_score(f, scores, p) for p in itertools.product((0, 1), repeat=len(x))]
            out += path_score(f, scores, s) - np.logaddexp.reduce(every)
        return out / sum(map(len, lines)) - 0.025 * sum((v ** 2).sum() for v in (f.bins, f.start, f.step))

    best = objective(field)
    for seed in range(6):
        other = random_field(seed)
        for part in ("bins", "start", "step"):
            moved = line_rules.Field(field.bins.copy(), field.start.copy(), field.step.copy())
            getattr(moved, part)[...] += 0.02 * getattr(other, part)
            assert objective(moved) < best


def test_line_verdicts_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    field = line_rules.train(docs, labels)
    got = {r.doc_id: r for r in line_rules.marked(docs, field).collect()}
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    judged = [(r.kept, q) for r, q in held if not r.base_failed]
    assert len(judged) > 40 and sum(k == bool(q) for k, q in judged) >= 0.97 * len(judged)
    assert all(k for k, q in judged if q)                       # no clean document goes
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    assert any("B" in r.marks and "C" in r.marks for r in got.values())
    for i, r in got.items():
        assert r.content_words == sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x, m in zip(texts[i].split("\n"), r.marks) if m == "C")
        assert r.kept == (not r.base_failed and 2 * r.content_words >= r.n_words)


def test_line_field_needs_both_labels(spark):
    docs = frame(spark, [(1, "a b", "en", "s"), (1, "c d", "en", "s"), (None, "e", None, None)])
    assert line_rules.train(docs, spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")) is None
    assert line_rules.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")) is None
    both = line_rules.train(docs, spark.createDataFrame([(1, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int"))
    assert both is not None and rows_of(line_rules.marked(docs, both), "doc_id", "n_words") == [(1, 2), (1, 2), (None, 1)]


# ------------------------------------------------------------------ spelling variants

def plain_variants(rows, least=7):
    n = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    met = {w: [v for v in n if near(v, w)] for w in n}
    form = {}
    for w, vs in met.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(met[w]), n.get(form[w])))
    return sorted(out, key=repr)


WORDS = ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.fixture(scope="module")
def wordy():
    r = random.Random(11)
    base = ["".join(r.choice("abcé×ÀX") for _ in range(r.randint(6, 10))) for _ in range(40)]
    family = ["aaaaaaaa", "aaaaaaa", "aaaaaaaaa", "aaaaaab", "baaaaaaa", "abaaaaa"]
    chain = ["information"] * 300 + ["informatioon"] * 30 + ["informmatioon"] * 3
    rows = []
    for k in range(60):
        words = [r.choice(base) for _ in range(60)] + [r.choice(family) for _ in range(9)]
        for _ in range(12):
            w = list(r.choice(base))
            w[r.randrange(len(w))] = r.choice("abzé")
            words.append("".join(w))
        rows.append((None if k == 7 else k // 2, r.choice([" ", "\n", "-", "1"]).join(words)))
    return [*rows, (900, " ".join(chain)), (901, None), (902, ""), (903, "short words only"), (904, "ünder ünderÿ" * 3)]


def test_variants(spark, wordy):
    docs = frame(spark, [(i, t, "en", None) for i, t in wordy])
    want = plain_variants(wordy)
    assert rows_of(spelling.spelling_variants(docs), *WORDS) == want
    assert any(w[2] != w[1] and w[1] for w in want) and any(w[4] > 2 for w in want)
    assert sql_rows(spelling.SQL, WORDS, documents=docs) == want
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_variants_of_long_words(spark, wordy):
    """With a low bound most words take the fingerprints; both ways meet at words of exactly that length."""
    r = random.Random(2)
    long = ["".join(r.choice("abc") for _ in range(n)) for n in (63, 64, 65, 300)]
    rows = [*wordy, *[(950 + k, " ".join([w, w, w[:30] + w[31:], w[:30] + w[31:], w[:9] + "z" + w[10:], w[:9] + "z" + w[10:]] * 2))
                      for k, w in enumerate(long)]]
    docs = frame(spark, [(i, t, "en", None) for i, t in rows])
    want = plain_variants(rows)
    assert rows_of(spelling.spelling_variants(docs), *WORDS) == want
    for bound in (7, 8, 9):
        assert rows_of(spelling.spelling_variants(docs, long=bound), *WORDS) == want


def test_variants_of_a_huge_run(spark):
    w = "".join(random.Random(4).choice("abcdefgh") for _ in range(20_000))
    rows = [(1, f"{w} {w}"), (2, f"{w[:700]}{w[701:]}!{w[:700]}{w[701:]}"), (3, "a" * 20_000 + " " + "a" * 20_000), (4, ("a" * 20_001 + ".") * 2)]
    got = spelling.spelling_variants(frame(spark, [(i, t, "en", None) for i, t in rows])).collect()
    assert sorted((len(r.word), r.n_near) for r in got) == [(19_999, 1), (20_000, 1), (20_000, 1), (20_001, 1)]


def test_one_edit():
    words = ["".join(p) for n in range(4) for p in itertools.product("ab", repeat=n)]
    for a, b in itertools.product(words, words):
        short, large = sorted((a, b), key=len)
        near = (sum(x != y for x, y in zip(a, b)) == 1 if len(a) == len(b)
                else len(large) - len(short) == 1 and any(large[:k] + large[k + 1:] == short for k in range(len(large))))
        assert spelling.one_edit(a, b) == near, (a, b)


# ------------------------------------------------------------------ source divergence

def plain_divergence(rows, ranks=10):
    rows = [tuple(x or "" for x in r[1:]) for r in rows]
    count, docs = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        terms = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in terms]
        groups.add((lang, source))
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    kept = {lang: [t for t, k in c.items() if k >= 10] for lang, c in docs.items()}
    out = []

    def shares(counts, terms):
        total = sum(counts[t] for t in terms)
        return {t: 1 + 10 ** 9 * (counts[t] + 2) // (total + 2 * len(terms)) for t in terms}

    for lang, source in groups:
        terms = kept.get(lang, [])
        p = shares(count[lang, source], terms)
        whole = Counter()
        for g, c in count.items():
            if g[0] == lang:
                whole.update(c)
        q = shares(whole, terms)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        pair = []
        for g, other in groups:
            if g == lang and other != source:
                o = shares(count[lang, other], terms)
                pair.append((-sum(f(p[t], o[t]) for t in terms), other))
        term = [(-f(p[t], q[t]), t) for t in terms if count[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:ranks])):
            out += [(lang, source, part, item, -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out, key=repr)


SOURCES = ["lang", "source", "part", "item", "value", "rank"]


@pytest.fixture(scope="module")
def audited():
    r = random.Random(8)
    words = ["".join(r.choice("abcdEÉ") for _ in range(r.randint(1, 3))) for _ in range(120)] + ["日本", "x y", "z\U0001F600"]
    rows = []
    for k in range(300):
        lang, source = r.choice(["en", "de", None]), r.choice(["hot"] * 6 + ["s1", "s2", "é", "", None])
        rows.append((k // 2, r.choice([" ", "1", "\n"]).join(r.choice(words[:40 + 20 * (k % 5)]) for _ in range(r.randint(0, 40))), lang, source))
    rows += [(None, None, "fr", "s1"), (900, "rare words", "fr", "s2"), (901, "", "en", "empty"), (902, "1 2 3", "de", "digits")]
    return rows + rows[:20]


def test_divergence(spark, audited):
    docs = frame(spark, audited)
    want = plain_divergence(audited)
    assert rows_of(divergence.source_divergence(docs), *SOURCES) == want
    assert sql_rows(divergence.SQL, SOURCES, documents=docs) == want
    assert {r[2] for r in want} == {"pair", "term"} and any(r[2] == "pair" and r[4] == 0 for r in want)
    assert divergence.source_divergence(docs.limit(0)).count() == 0


def test_divergence_with_ties_small_memory_and_shuffled_tables(spark, monkeypatch):
    rows = [(k, f"t{k % 7} " * 2 + " ".join(f"{c}x" for c in "abcdefghijklmnop"), "en", f"s{k % 3}") for k in range(90)]
    monkeypatch.setattr(divergence, "bounded", lambda df, rows=0: df)          # no broadcast at all
    assert rows_of(divergence.source_divergence(frame(spark, rows)), *SOURCES) == plain_divergence(rows)
    assert rows_of(divergence.source_divergence(frame(spark, rows), ranks=3), *SOURCES) == plain_divergence(rows, 3)


def test_term_counts_in_pieces_and_parts(monkeypatch, spark):
    import pyarrow as pa
    text = "Ab1ab é日本 " * 50
    assert b"".join(divergence.pieces(text.encode(), 7)) == text.encode()
    assert [t for p in divergence.pieces(text.encode().lower(), 7) for t in divergence.TERM.findall(p)] == divergence.TERM.findall(text.encode().lower())
    monkeypatch.setattr(divergence, "ENTRIES", 2)
    batch = pa.RecordBatch.from_pydict({"lang": ["a"] * 9, "source": ["b"] * 9, "text": [text] * 9})
    out = [r for b in divergence.term_counts(iter([batch])) for r in b.to_pylist()]
    assert len(out) > 3
    total = Counter()
    for r in out:
        total[r["term"]] += r["n"]
    assert total == {"ab": 900, "é日本": 450} and sum(r["docs"] for r in out if r["term"] == "ab") == 9
