"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is cut into leaf blocks, the runs of text between block-level tags.  Each has features of its ancestors (tags,
class and id words) and of its text (length, link share, closing mark, digits, likeness to the title).  The field
is trained on labelled pages by gradient of its log-likelihood (forward-backward) and decoded by Viterbi.
Labelled pages are the layouts below, whose blocks are marked by hand, and a bounded sample of the given pages whose
semantic tags leave no doubt; each is also learnt with the tags that name the content taken for plain ones, so that the
field does not rest on them.

Only script, style, textarea and title swallow what they hold; all other elements, self-closed or never closed, are
ancestors of their text, but the words of buttons and selections are never text.

Defined cases: a null or empty html, and a page without content, give an empty text; broken markup is read as browsers
do (unknown end tags ignored, open ones closed); rows that repeat a page_id give a row each; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segrank.llm.common import bounded_batches, read_table

SAMPLE = 400        # pages of the table to train on at most: those with the least hash of the id
ROUNDS = 30
LEAST_STEPS = 60_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(script|style|textarea|title)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>(.*?)(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|([^<]+|<)", re.S | re.I)
MARKS = re.compile(r"(?<![\w-])(class|id|role|data-main)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr br input button select option optgroup datalist svg math object".split())
FOREIGN = frozenset(("svg", "math"))                        # what they hold is inline, and may be closed by its own tag
CONTROLS = frozenset(("button", "select", "datalist"))      # their words belong to a form wherever they stand
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header "
                     "hr main menu nav ol p pre section table ul".split())
CLOSES_SELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
               "th": ("td", "th"), "option": ("option",)}
HOLDS = frozenset("ul ol dl table".split())


class Block:
    __slots__ = ("text", "path", "words", "link", "main")

    def __init__(self, text, path, words, link, main):
        self.text, self.path, self.words, self.link, self.main = text, path, words, link, main


def leaf_blocks(page: str) -> tuple[list[Block], str]:
    """The leaf blocks in page order and the page's title."""
    stack: list[tuple[str, tuple[str, ...], bool]] = []
    blocks: list[Block] = []
    pieces: list[str] = []
    linked, title = 0, ""

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                blocks.append(Block(text, [t for t, _, _ in stack if t not in INLINE], [w for _, ws, _ in stack for w in ws],
                                    linked / len(text), any(m for _, _, m in stack)))
            pieces.clear()
        linked = 0

    for m in TOKEN.finditer(page):
        text = m[6]
        if text is not None:
            if any(t in CONTROLS for t, _, _ in stack):
                continue
            text = entities.unescape(text)
            pieces.append(text)
            if any(t == "a" for t, _, _ in stack):
                linked += len(" ".join(text.split()))
            continue
        if m[1]:
            if m[1].lower() == "title" and not title:
                title = " ".join(entities.unescape(m[2]).split())
            continue
        if not m[4]:
            continue
        tag = m[4].lower()
        if m[3]:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if at is not None:
                if any(t not in INLINE for t, _, _ in stack[at:]) and not any(t in FOREIGN for t, _, _ in stack[:at]):
                    flush()
                del stack[at:]
            elif tag == "p":
                flush()
            continue
        foreign = tag in FOREIGN or any(t in FOREIGN for t, _, _ in stack)
        if foreign and m[5] and m[5].rstrip().endswith("/"):
            continue
        if tag not in INLINE and not foreign:
            flush()
            drop = ("p",) if tag in CLOSES_P else CLOSES_SELF.get(tag, ())
            if drop:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in drop:
                        del stack[k:]
                        break
                    if stack[k][0] in HOLDS or (drop == ("p",) and stack[k][0] not in INLINE):
                        break
        elif tag == "br":
            pieces.append(" ")
        if tag not in VOID or foreign:
            words: list[str] = []
            main = False
            if m[5]:
                for name, *values in MARKS.findall(m[5]):
                    value = "".join(values)
                    if name.lower() == "data-main":
                        main = True
                    else:
                        words += re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower())
            stack.append((tag, tuple(words), main))
    flush()
    return blocks, title


def features(blocks: list[Block], title: str) -> list[list[str]]:
    out = []
    for b in blocks:
        n = len(b.text)
        own = ["bias", f"tag:{b.path[-1] if b.path else ''}", f"len:{min(4, int(math.log2(n + 1)) // 2)}",
               f"link:{0 if b.link == 0 else 1 + min(3, int(b.link * 4))}", "end:" + ("mark" if b.text[-1] in ".!?:;\"”»…" else "none")]
        own += [f"in:{t}" for t in set(b.path) - {"html", "body"}] + [f"cls:{w}" for w in set(b.words)]
        own.append("under:" + ">".join(b.path[-2:]))
        if title and (b.text == title or (len(title) > 20 and b.text.startswith(title[:40]))):
            own.append("title")
        if sum(c.isdigit() for c in b.text) * 4 > n:
            own.append("digits")
        if "©" in b.text or "|" in b.text or "·" in b.text:
            own.append("sign")
        out.append(own)
    return out


def log_sum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


class Field:
    """Two labels (0 boilerplate, 1 content); a feature has one weight, added to label 1; four transition weights."""

    def __init__(self):
        self.weight: dict[str, float] = {}
        self.step = [0.0, 0.0, 0.0, 0.0]

    def emit(self, rows: list[list[str]]) -> list[float]:
        get = self.weight.get
        return [sum(get(f, 0.0) for f in row) for row in rows]

    def marginals(self, e: list[float]) -> tuple[list[float], list[float]]:
        """Probability of label 1 at each block, and of the four transitions summed over the page."""
        t, n = self.step, len(e)
        ahead = [(0.0, e[0])]
        for x in e[1:]:
            a, b = ahead[-1]
            ahead.append((log_sum(a + t[0], b + t[2]), x + log_sum(a + t[1], b + t[3])))
        back = [(0.0, 0.0)] * n
        for k in range(n - 2, -1, -1):
            a, b = back[k + 1][0], back[k + 1][1] + e[k + 1]
            back[k] = (log_sum(t[0] + a, t[1] + b), log_sum(t[2] + a, t[3] + b))
        z = log_sum(*ahead[-1])
        one = [math.exp(f[1] + b[1] - z) for f, b in zip(ahead, back)]
        pairs = [0.0] * 4
        for k in range(n - 1):
            for i in (0, 1):
                for j in (0, 1):
                    pairs[2 * i + j] += math.exp(ahead[k][i] + t[2 * i + j] + (e[k + 1] if j else 0.0) + back[k + 1][j] - z)
        return one, pairs

    def train(self, pages: list[tuple[list[list[str]], list[int]]], rounds: int = ROUNDS, rate: float = 0.2) -> "Field":
        """Stochastic gradient on the negative log-likelihood, a page at a time, in an order fixed by a seed, with a
        falling rate and L2; the weights of the later half of the rounds are averaged."""
        order = random.Random(0)
        pages = [p for p in pages if p[0]]
        rounds = max(rounds, -(-LEAST_STEPS // max(1, len(pages))))
        total, steps, taken = {}, [0.0] * 4, 0
        for turn in range(rounds):
            order.shuffle(pages)
            r = rate / (1 + 4 * turn / rounds)
            for rows, labels in pages:
                one, pairs = self.marginals(self.emit(rows))
                grad: dict[str, float] = {}
                for row, p, y in zip(rows, one, labels):
                    for f in row:
                        grad[f] = grad.get(f, 0.0) + p - y
                for f, g in grad.items():
                    old = self.weight.get(f, 0.0)
                    self.weight[f] = old - r * (g + 1e-4 * old)
                for a, b in zip(labels, labels[1:]):
                    pairs[2 * a + b] -= 1
                for k, g in enumerate(pairs):
                    self.step[k] -= r * (g + 1e-4 * self.step[k])
            if 2 * turn >= rounds - 1:
                taken += 1
                for f, w in self.weight.items():
                    total[f] = total.get(f, 0.0) + w
                steps = [a + b for a, b in zip(steps, self.step)]
        self.weight = {f: w / taken for f, w in total.items()}
        self.step = [x / max(1, taken) for x in steps]
        return self

    def viterbi(self, e: list[float]) -> list[int]:
        t, score, back = self.step, (0.0, e[0]), []
        for x in e[1:]:
            a, b = score
            back.append((int(b + t[2] > a + t[0]), int(b + t[3] > a + t[1])))
            score = max(a + t[0], b + t[2]), x + max(a + t[1], b + t[3])
        path = [int(score[1] > score[0])]
        for k in reversed(back):
            path.append(k[path[-1]])
        return path[::-1]

    def main_text(self, page: str | None) -> str:
        blocks, title = leaf_blocks(page or "")
        if not blocks:
            return ""
        labels = self.viterbi(self.emit(features(blocks, title)))
        return "\n\n".join(b.text for b, y in zip(blocks, labels) if y)


# Layouts with the content marked by hand (data-main).  {h} is a short headline, {s} a sentence, {p} a paragraph, {w} a word.
HEAD = "<!DOCTYPE html><html><head><title>{t}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>"
MENU = '<ul class="menu"><li><a href="/">{w}</a></li><li><a href="/">{w}</a></li><li><a href="/">{w}</a></li></ul>'
COMMENTS = '<div class="{c}"><h3>{w} {w}</h3><div class="{d}"><b>{w}</b><p>{s}</p></div><div class="{d}"><p>{p}</p></div><ul><li>{s}</li><li>{p}</li></ul></div>'
NOTICE = '<div class="{n}"><p>{s}</p><button>{w}</button></div>'
ADVERT = '<div class="{a}"><p>{s}</p><a href="/">{w}</a></div>'
FORM = '<form class="search" action="/"><label>{w}</label><input type="text"><button>{w}</button><p>{s}</p></form>'
SIDE = '<aside class="sidebar"><h3>{w}</h3><p>{s}</p><ul><li><a href="/">{h}</a></li><li><a href="/">{h}</a></li></ul></aside>'
BODY = '<h1 data-main>{t}</h1><p data-main>{p}</p><p data-main>{p}</p><h2 data-main>{h}</h2><p data-main>{s}</p><p data-main>{p}</p>'
RICH = ('<h1 data-main>{t}</h1><p data-main>{p}</p><ul data-main><li>{s}</li><li>{s}</li></ul><blockquote data-main><p>{p}</p></blockquote>'
        '<table data-main><tr><th>{w}</th><th>{w}</th></tr><tr><td>{w}</td><td>{s}</td></tr></table><pre data-main>{s}</pre>'
        '<ol data-main><li>{s}</li><li>{w} {w}</li></ol><figure><img><figcaption data-main>{s}</figcaption></figure><p data-main>{p}</p>')
OPEN = '<h1 data-main>{t}</h1><p data-main><b>{p}<br><p data-main>{s}</p><p data-main>{w}.</p><p data-main>{p}'
FOOT = "<footer>&copy; {w} &middot; {s}</footer>"
LAYOUTS = (
    HEAD + "<nav>" + MENU + "</nav>" + ADVERT + "<article>" + BODY + "</article>" + FOOT + "</body></html>",
    HEAD + "<nav>" + MENU + "</nav>" + ADVERT + "<article>" + OPEN + "</article>" + FOOT,
    HEAD + "<header><h2>{w}</h2><p>{s}</p>" + MENU + "</header>" + NOTICE + "<main><article>" + RICH + "</article>" + COMMENTS + "</main>" + SIDE + FOOT,
    HEAD + '<div id="header"><p>{s}</p>' + MENU + '</div><div id="content">' + BODY + ADVERT + "<p data-main>{p}</p></div>" + COMMENTS + SIDE
    + '<div id="footer"><p>{s}</p></div>',
    HEAD + NOTICE + '<div class="nav">' + MENU + '</div><div class="post"><div class="entry-content">' + RICH + "</div></div>" + FORM + COMMENTS + FOOT,
    HEAD + '<div class="top"><a href="/">{w}</a></div><main>' + BODY + FORM + "<p data-main>{p}</p></main>" + '<div class="sidebar"><p>{p}</p></div>' + FOOT,
    HEAD + "<header><h1>{w}</h1></header><nav>" + MENU + "</nav><section class=\"article-body\">" + BODY + "</section><section class=\"{c}\"><h2>{w}</h2><p>{p}</p><p>{s}</p></section>" + FOOT,
    HEAD + "<article><header>" + '<h1 data-main>{t}</h1></header><p data-main>{p}</p>' + ADVERT + "<p data-main>{p}</p><aside><p>{s}</p></aside><p data-main>{p}</p>" + COMMENTS + "</article>" + FOOT,
    HEAD + "<nav>" + MENU + "</nav><p>{s}</p>" + FOOT,
    HEAD + '<nav><a href="/">{w}</a></nav><article><h1 data-main>{t}</h1><p data-main>{p}</p></article>' + FOOT,
    HEAD + '<header><a href="/">{w}</a> <a href="/">{w}</a></header><nav>{w} | {w}</nav><article>' + BODY + "</article>" + FOOT,
    HEAD + "<nav>" + MENU + "</nav><article><p data-main>{p}</p></article>" + NOTICE + SIDE + FOOT,
    HEAD + '<nav>' + MENU + '</nav><div class="{n}">{s}</div><article>' + BODY + '<section id="{c}"><div class="{d}">{s}</div><div class="{d}">{p}</div></section></article>' + FOOT,
    HEAD + MENU + "<h1 data-main>{t}</h1><p data-main>{p}</p><p data-main>{p}</p>" + COMMENTS + FOOT,
    HEAD + '<nav>' + MENU + '</nav><div class="{a}">{s}</div><div role="main">' + BODY + '</div><div class="related"><h3>{w}</h3><ul><li><a href="/">{h}</a></li><li><a href="/">{h}</a></li></ul></div>' + FOOT,
    # no semantic tags, and names that say nothing
    HEAD + '<div class="{x}">' + BODY + "</div></body></html>",
    HEAD + '<div class="{x}"><h1 data-main>{t}</h1><p data-main>{p}</p><p data-main>{p}</p></div>',
    HEAD + '<div class="{x}"><a href="/">{w}</a> <a href="/">{w}</a> <a href="/">{w}</a></div><div class="{x}">' + RICH + '</div><div class="{x}">&copy; {w} {w}</div>',
    HEAD + '<table><tr><td><a href="/">{w}</a><br><a href="/">{w}</a></td><td><h2 data-main>{t}</h2><p data-main>{p}</p><p data-main>{s}</p></td></tr></table>',
    HEAD + '<div id="{x}">' + MENU + '</div><div id="{x}"><div class="{x}"><h1 data-main>{t}</h1><div data-main>{p}</div><div data-main>{p}</div></div></div>'
    + '<div id="{x}"><a href="/">{w}</a> | <a href="/">{w}</a></div>',
    HEAD + "<article><p data-main>{p}</p><p data-main>{s}</p><p data-main>{p}</p></article>",
    HEAD + "<p data-main>{p}</p><p data-main>{s}</p>",
    HEAD + '<div class="{x}"><p data-main>{s}</p><p data-main>{p}</p></div>',
    HEAD + '<div class="{x}"><a href="/">{w}</a> <a href="/">{w}</a></div><div class="{x}"><h1 data-main>{t}</h1><p data-main>{s}</p><p data-main>{p}</p>'
    + '<p data-main>{s}</p></div><div class="{x}">&copy; {w} {w}</div>',
    HEAD + '<table><tr><td><a href="/">{w}</a></td><td><h1 data-main>{t}</h1><p data-main>{s}</p><p data-main>{s}</p></td></tr></table>',
    HEAD + '<div class="{x}"><h1 data-main>{t}</h1><p data-main>{s}</p><p data-main>{s}</p></div>' + NOTICE,
    HEAD + '<h1 data-main>{t}</h1><p data-main>{p}</p><noscript><p data-main>{s}</p></noscript><p data-main>{p} <math><mi>x</mi></math></p><p data-main>{s}</p>' + FOOT,
)
FILL = {"c": ("comments", "comment list", "reader comments", "discussion", "responses", "disqus thread"),
        "d": ("comment", "comment body", "reply", "response"), "n": ("cookie notice", "cookie banner", "notice", "banner", "consent", "popup", "modal", "alert", "newsletter"),
        "a": ("ad", "ads", "advert", "advertisement", "sponsor", "promo", "ad-slot")}


def layout_pages(copies: int = 12) -> list[str]:
    """The layouts filled with made-up words; only shapes are learned from them."""
    r = random.Random(7)

    def words(a: int, b: int) -> str:
        return " ".join("".join(r.choice("aeionrstlhd") for _ in range(r.randint(2, 8))) for _ in range(r.randint(a, b)))

    def fill(name: str) -> str:
        if name in FILL:
            return r.choice(FILL[name])
        if name == "x":
            return words(1, 2).lower()
        if name == "w":
            return words(1, 1).capitalize()
        if name == "h":
            return words(3, 7).capitalize()
        text = words(5, 20) if name == "s" else " ".join(words(8, 25).capitalize() + "." for _ in range(r.randint(2, 6)))
        return (text[0].upper() + text[1:] + ".") if name == "s" else text

    out = []
    for layout in LAYOUTS:
        for _ in range(copies):
            title = words(4, 10).capitalize()
            out.append(re.sub(r"\{([a-z])\}", lambda m: title if m[1] == "t" else fill(m[1]), layout).replace("{{}}", "{}"))
    return out


AWAY = frozenset("nav footer header aside form menu dialog".split())


NAMES = frozenset("article main section".split())


def labelled(page: str, marked: bool, short: random.Random | None = None, plain: str | None = None) -> tuple[list[list[str]], list[int]] | None:
    """Features and labels of a page: marked blocks, or those in a page's one article but outside what is never content.
    With ``short``, half of the content blocks are cut to a word or two, as content need not be long; with ``plain``,
    the tags in NAMES are taken for that one ("": for none), the words of content blocks' classes are left out, and
    pages whose title has an odd length lose their first content block, so that content need not open with a headline."""
    blocks, title = leaf_blocks(page)
    if marked:
        labels = [int(b.main) for b in blocks]
    else:
        if not any("article" in b.path for b in blocks) or any(b.words for b in blocks if "article" in b.path):
            return None
        labels = [int("article" in b.path and not AWAY & set(b.path)) for b in blocks]
    if plain is not None:
        for b, y in zip(blocks, labels):
            b.path = [x for x in (plain if t in NAMES else t for t in b.path) if x]
            b.words = [] if y else b.words
        headline = labels.index(1) if 1 in labels else 0
        if blocks and len(title) % 2 and sum(labels) > 1:       # half of the pages: no headline opens the content
            del blocks[headline], labels[headline]
    if short:
        for b, y in zip(blocks, labels):
            if y and short.random() < 0.5:
                b.text = " ".join(b.text.split()[:short.randint(1, 2)]).rstrip(".") + short.choice([".", ""]) or b.text
        title = ""
    return features(blocks, title), labels


def train(pages: DataFrame, sample: int = SAMPLE) -> Field:
    """The field trained on the layouts and on at most ``sample`` of ``pages``."""
    mark = F.xxhash64("page_id")
    least = [r[0] for r in pages.where("html is not null").select(mark.alias("mark")).orderBy("mark").limit(sample).collect()]
    rows = pages.where("html is not null").where(mark <= F.lit(least[-1])).select("html").limit(2 * sample).collect() if least else []
    own = sorted(r["html"] for r in rows)
    cut = random.Random(1)
    known = [(p, True) for p in layout_pages()] + [(p, False) for p in own]
    ways = ((None, None), (cut, None), (None, "div"), (None, ""))
    return Field().train([x for p, marked in known for short, plain in ways if (x := labelled(p, marked, short, plain))])


def extract(pages: DataFrame, field: Field) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    spark = pages.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [model.value.main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")


def op7_main_text(spark, sf_dir: str) -> DataFrame:
    """Every whole page."""
    pages = read_table(spark, sf_dir, "pages")
    return extract(pages, train(pages))
