"""op7: elements that browsers do not let swallow text, pages without semantic tags, Viterbi against all labellings."""

import itertools
import random

import pytest

from segrank.llm import html_crf

SF = "/root/testdata/sf0.01"
HEAD = "<html><head><title>A title of the page</title></head><body>"
H = "<h1>A title of the page</h1>"
P = "<p>This is a first paragraph of plain text that says something, and then goes on for a while.</p>"
Q = "<p>A second paragraph follows it, which is as long as the first one was, more or less.</p>"
R = "<p>The third paragraph ends the story with a few more words than needed.</p>"
T, p, q, r = (x[x.index(">") + 1:x.rindex("<")] for x in (H, P, Q, R))


@pytest.fixture(scope="module")
def field(spark):
    return html_crf.train(spark.read.parquet(f"{SF}/pages.parquet"))


PAGES = [
    ("<article>" + H + P + "<svg width='1'/>" + Q + R + "</article>", [T, p, q, r]),
    ("<article>" + H + P + "<svg><path d='M1'/><g><text>Label</text></g></svg>" + Q + "</article>", [T, p, "Label", q]),
    ("<article>" + H + P + "<object data='x'>" + Q + R + "</article>", [T, p, q, r]),
    ("<article>" + P + "<p>Here <math><mi>abc</mi><mo>=</mo><mi>def</mi></math> ends.</p>" + Q, [p, "Here abc=def ends.", q]),
    ("<article>" + P + "<noscript><p>Inside of a noscript there is some text.</p></noscript>" + Q, [p, "Inside of a noscript there is some text.", q]),
    ("<article>" + P + "<p>Words before <button>PRESSME</button> and after it.</p>" + Q, [p, "Words before and after it.", q]),
    ("<article>" + P + "<p>Take <select><option>one<option>two</select> of them now.</p>" + Q, [p, "Take of them now.", q]),
    ("<article>" + P + "<textarea>not <p>this</textarea><script>var a = '<p>nor that</p>';</script>" + Q, [p, q]),
    ('<div class="story">' + H + P + Q + "</div></body></html>", [T, p, q]),
    ('<div class="zork">' + H + P + "</div>", [T, p]),
    ("<div class='sitenav'><a href=/>Home</a> <a href=/>News</a></div><div class='zork'>" + H + P + Q + R + "</div><div class='foo'>&copy; 2024 Somebody</div>",
     [T, p, q, r]),
    ("<table><tr><td><a href=/>Home</a></td><td>" + H + P + Q + "</td></tr></table>", [T, p, q]),
    (P + Q + R, [p, q, r]),
    ("<ul class='menu'><li><a href=/>Home</a><li><a href=/>News</a></ul><div id='w17'><div id='w18'>" + H + P + "<div class='comments'><p>I do not agree with this at all.</p></div></div></div>",
     [T, p]),
    ("<nav><ul><li><a href=/>Home</a></ul></nav>" + H + P + Q + "<aside><p>See what others have read today.</p></aside><footer>&copy; x</footer>", [T, p, q]),
]


@pytest.mark.parametrize("k", range(len(PAGES)))
def test_probe(field, k):
    page, want = PAGES[k]
    assert field.main_text(HEAD + page) == "\n\n".join(want)


def test_layouts_are_marked_and_learnt(field):
    for page in html_crf.layout_pages(4):
        blocks, _ = html_crf.leaf_blocks(page)
        got = set(field.main_text(page).split("\n\n"))
        wrong = sum((b.text in got) != b.main for b in blocks)
        assert any(b.main for b in blocks) or wrong == 0
        assert wrong <= 1


def test_viterbi_and_marginals_against_all_labellings():
    r = random.Random(3)
    for _ in range(30):
        field = html_crf.Field()
        field.step = [r.gauss(0, 2) for _ in range(4)]
        e = [r.gauss(0, 2) for _ in range(r.randint(1, 8))]

        def score(path):
            return sum(x for x, y in zip(e, path) if y) + sum(field.step[2 * a + b] for a, b in zip(path, path[1:]))

        paths = list(itertools.product((0, 1), repeat=len(e)))
        assert tuple(field.viterbi(e)) == max(paths, key=score)
        import math
        z = sum(math.exp(score(x)) for x in paths)
        one, pairs = field.marginals(e)
        for k in range(len(e)):
            assert abs(one[k] - sum(math.exp(score(x)) for x in paths if x[k]) / z) < 1e-9
        assert abs(sum(pairs) - (len(e) - 1)) < 1e-9


def test_tables_and_long_pages(spark, field):
    schema = "page_id long, url string, html string, text string, n_chars long, label int"
    long = HEAD + "<article>" + H + (P + Q) * 4000
    rows = [(1, "u", long, "t", 5, 1), (1, None, None, "t", 5, 1), (None, "v", HEAD + "<article>" + H + P, None, None, None), (2, "w", "", "", 0, 0)]
    pages = spark.createDataFrame(rows, schema)
    got = sorted(((x.page_id or 0, x.url or "", x.text, x.n_chars) for x in html_crf.extract(pages, field).collect()))
    whole = "\n\n".join([T] + [p, q] * 4000)
    assert got == [(0, "v", f"{T}\n\n{p}", len(T) + 2 + len(p)), (1, "", "", 0), (1, "u", whole, len(whole)), (2, "w", "", 0)]
    assert html_crf.extract(pages.limit(0), field).count() == 0
    assert html_crf.train(pages.limit(0)).main_text(HEAD + "<article>" + H + P) == f"{T}\n\n{p}"
