"""HTML extraction by a tree-structured graphical model.

Every element of a page is a node with a hidden state, main content or not. A node's own
potential comes from its tag, the words of its class and id, how much text it holds and how
much of that is linked; an edge potential ties each child to its parent. Sum-product messages
go up from the leaves and down from the root, and give every node's marginal exactly. A block
of text is kept if its element's marginal favours content.

Potentials are smoothed log ratios of counts over labelled pages (see labelled_pages).
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from functools import cache
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import str_texts, table

#: Fixed values of HTML: elements without an end tag, elements that begin and end a block of text, and elements whose text is never shown as text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
HIDDEN = frozenset("head script style noscript template title svg math iframe object canvas audio video select option textarea button datalist".split())
#: Which open elements a start tag ends: paragraphs end at any block, list items and cells at their own kind.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: A page is taken to have some content: if none is found, the prior is raised by these steps.
LIFTS = (0.0, 0.5, 1.0, 2.0, 3.0)
#: Elements at which the search for an open element to end stops.
FENCES = frozenset("html body article section main div table ul ol dl nav aside header footer form td th".split())
#: Text right below one of these gets an anonymous block of its own.
ROOTS = frozenset(("#root", "html", "body"))


class Page(HTMLParser):
    """The tree of a page: for each node its parent, tag, words of class and id; and its text blocks.

    Work is linear in the page: the places of open elements are kept by tag, and what is hidden
    or linked is known from the element above.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.words = [-1], ["#root"], [()]
        self.own, self.linked = [0], [0]  # characters of text right below a node, and of those linked
        # the open elements: tag, node, whether hidden, whether linked; what is hidden has no node of its own
        self.names, self.stack, self.hidden, self.link = ["#root"], [0], [False], [False]
        self.places: dict[str, list[int]] = defaultdict(list)  # of open elements in the stack, by tag
        self.fences: list[int] = []
        self.blocks, self.open = [], []
        self.feed(html)
        self.close()
        self.flush()

    def parse_marked_section(self, i, report=1):
        """<![...> is a comment in HTML, whatever stands in it."""
        return self.parse_bogus_comment(i, report)

    def flush(self) -> None:
        """Ends a block: its pieces become one line."""
        if self.open:
            text = " ".join("".join(t for _, t in self.open).split())
            if text:
                self.blocks.append((self.open, text))
            self.open = []

    def push(self, tag: str, words: tuple = ()) -> None:
        hidden = self.hidden[-1] or tag in HIDDEN
        if not hidden:
            self.parent.append(self.stack[-1])
            self.tag.append(tag)
            self.words.append(words)
            self.own.append(0)
            self.linked.append(0)
        self.places[tag].append(len(self.stack))
        if tag in FENCES:
            self.fences.append(len(self.stack))
        self.names.append(tag)
        self.stack.append(self.stack[-1] if hidden else len(self.tag) - 1)
        self.hidden.append(hidden)
        self.link.append(self.link[-1] or tag == "a")

    def pop_to(self, i: int) -> None:
        """Ends the open elements from place i of the stack on."""
        for tag in self.names[i:]:
            self.places[tag].pop()
            if tag in FENCES:
                self.fences.pop()
        del self.names[i:], self.stack[i:], self.hidden[i:], self.link[i:]

    def last_open(self, *tags: str) -> int:
        return max((self.places[t][-1] for t in tags if self.places[t]), default=0)

    def end_open(self, *tags: str) -> None:
        i = self.last_open(*tags)
        if i and i >= (self.fences[-1] if self.fences else 0):
            self.pop_to(i)

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            if self.open:
                self.open.append((self.stack[-1], " "))
            return
        if tag in BLOCK:
            self.flush()
            if self.places["#text"]:
                self.pop_to(self.places["#text"][-1])
            self.end_open("p")
        if tag in ENDS:
            self.end_open(*ENDS[tag])
        if tag in VOID:
            return
        if tag not in BLOCK and tag not in HIDDEN and self.names[-1] in ROOTS:
            self.push("#text")
        words = tuple(sorted({w for k, v in attrs if k in ("class", "id", "role") and v for w in re.split(r"[^a-z]+", v.lower()) if w}))
        if any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and "display:none" in v.replace(" ", "") for k, v in attrs):
            words = (*words, "#hidden")
        self.push(tag, words)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math", "iframe"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        i = self.last_open(tag)
        if i and (tag in BLOCK or i >= (self.fences[-1] if self.fences else 0)):
            self.pop_to(i)

    def handle_data(self, text):
        if self.hidden[-1]:
            return
        n = len(text) - text.count(" ")
        if self.names[-1] in ROOTS and not text.isspace():
            self.push("#text")
        node = self.stack[-1]
        self.open.append((node, text))
        self.own[node] += n
        if self.link[-1]:
            self.linked[node] += n

    def features(self) -> list[tuple]:
        """For each node the names of what its own potential is made of."""
        size, linked = self.own[:], self.linked[:]
        for i in range(len(size) - 1, 0, -1):
            size[self.parent[i]] += size[i]
            linked[self.parent[i]] += linked[i]
        return [("t:" + t, "s:%d" % min(4, n.bit_length() // 2), "l:%d" % (4 * k // n if n else 0), *("w:" + w for w in words)) for t, n, k, words in zip(self.tag, size, linked, self.words, strict=True)]


class Model:
    """Node and edge potentials, as log ratios and logs of probabilities, from labelled pages."""

    def __init__(self, pages: list[tuple[str, str]]):
        """pages: html, and the word whose presence in a block's text marks it as content."""
        counts, total, edge = (Counter(), Counter()), [0, 0], [[1.0, 1.0], [1.0, 1.0]]
        for html, mark in pages:
            page = Page(html)
            state = [0] * len(page.tag)
            for pieces, text in page.blocks:
                for node, piece in pieces:
                    if mark in text and piece.strip():
                        state[node] = 1
            # a container is content if all the text below it is; an article's wrapper may hold intruders
            text_of = Counter(n for pieces, _ in page.blocks for n, p in pieces if p.strip())
            good, all_ = [s * text_of[i] for i, s in enumerate(state)], [text_of[i] for i in range(len(state))]
            for i in range(len(state) - 1, 0, -1):
                good[page.parent[i]] += good[i]
                all_[page.parent[i]] += all_[i]
            wraps = [page.tag[i] in ("article", "main") or bool({"body", "content", "main", "post", "story"} & set(page.words[i])) for i in range(len(state))]
            state = [int(a > 0 and (g == a or g > 0.6 * a and w)) for g, a, w in zip(good, all_, wraps, strict=True)]
            for i, names in enumerate(page.features()):
                total[state[i]] += 1
                counts[state[i]].update(names)
                if i:
                    edge[state[page.parent[i]]][state[i]] += 1
        self.counts, self.total = counts, total
        self.edge = [[math.log(x / sum(row)) for x in row] for row in edge]

    @cache  # noqa: B019  a model lives as long as its process
    def weight(self, name: str) -> float:
        """Log ratio of a feature's share in content to its share elsewhere, one pseudo count each."""
        on, off = ((c[name] + 1.0) / (n + 20.0) for c, n in zip(self.counts[::-1], self.total[::-1], strict=True))
        return max(-6.0, min(6.0, math.log(on / off)))

    def marginals(self, page: Page, lift: float = 0.0) -> list[float]:
        """P(content) of each node, by one pass of messages up and one down. lift: added to each log ratio."""
        n, edge, parent = len(page.tag), self.edge, page.parent
        own = [lift + sum(map(self.weight, names)) for names in page.features()]
        belief = [[0.0, x] for x in own]  # log potential times the messages from below
        message = [[0.0, 0.0]] * n
        for i in range(n - 1, 0, -1):  # children come after their parents
            b = belief[i]
            message[i] = m = [_logsum(edge[s][0] + b[0], edge[s][1] + b[1]) for s in (0, 1)]
            belief[parent[i]][0] += m[0]
            belief[parent[i]][1] += m[1]
        belief[0][1] = -1e9  # the document itself is not content
        out = [0.0] * n
        for i in range(n):
            if i:
                p, m = belief[parent[i]], message[i]
                # the parent's belief without what this child told it, sent through the edge
                rest = (p[0] - m[0], p[1] - m[1])
                b = belief[i]
                belief[i] = b = [b[s] + _logsum(rest[0] + edge[0][s], rest[1] + edge[1][s]) for s in (0, 1)]
            d = belief[i][0] - belief[i][1]
            out[i] = 1 / (1 + math.exp(min(700.0, max(-700.0, d))))
        return out

    def main_text(self, html: str) -> str:
        page = Page(html)
        kept: list[str] = []
        for lift in LIFTS:
            p = self.marginals(page, lift)
            for pieces, text in page.blocks:
                size = sum(len(t.strip()) for _, t in pieces)
                if sum(len(t.strip()) * p[node] for node, t in pieces) * 2 >= size:
                    kept.append(text)
            if kept:
                break
        return "\n\n".join(kept)


def _logsum(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def labelled_pages(n: int = 400, seed: int = 5) -> list[tuple[str, str]]:
    """n pages of varied build, made from a seed. Every content block holds the word Zq.

    They differ in how the article is wrapped, in block lengths, in what stands around and
    inside it, and in missing end tags, as real sites do.
    """
    r = random.Random(seed)

    def words(lo, hi):
        return " ".join(r.choice("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()) for _ in range(r.randint(lo, hi)))

    def said(lo, hi):
        return f"Zq {words(lo, hi)}. {words(lo, hi)}." if r.random() < 0.8 else f"Zq {words(1, 2)}."

    def links(lo, hi):
        return "".join(f'<li><a href="/{words(1, 1)}">{words(1, 3)}</a></li>' for _ in range(r.randint(lo, hi)))

    inner = (
        lambda: f"<p>{said(1, 90)}</p>", lambda: f"<p>{said(1, 90)}</p>", lambda: f"<p>{said(1, 90)}</p>", lambda: f"<p><b>{said(2, 30)}<br>", lambda: f"<p>{said(3, 60)}", lambda: f"<h2>{said(1, 6)}</h2>", lambda: f"<h3>{said(1, 4)}</h3>",
        lambda: "<ul>" + "".join(f"<li>{said(1, 15)}</li>" for _ in range(r.randint(1, 5))) + "</ul>", lambda: f"<blockquote><p>{said(3, 40)}</p></blockquote>", lambda: f"<pre><code>{said(1, 20)}</code></pre>",
        lambda: f'<table><tr><td>{said(1, 4)}</td><td>{said(1, 4)}</td></tr></table>', lambda: f'<p>{said(4, 40)} <a href="/x">{words(1, 3)}</a> <em>{words(1, 4)}</em></p>', lambda: f"<figure><img src=x><figcaption>{said(2, 12)}</figcaption></figure>", lambda: f"<div>{said(3, 60)}</div>",
        lambda: f"<p>{said(3, 40)} <svg><path d=x /></svg> {words(2, 9)}<script>x()</script> {words(1, 9)}.</p>", lambda: f"<div>{said(3, 50)}<br><br>{words(5, 30)}<br>{words(3, 20)}.</div>", lambda: f"<section><h2>{said(1, 5)}</h2><p>{said(3, 60)}</p></section>",
    )
    intruders = (
        lambda: f'<div class="ad">{words(3, 40)}.</div>', lambda: f'<aside class="related"><h4>{words(1, 3)}</h4><ul>{links(2, 5)}</ul></aside>', lambda: f'<div class="share"><a href="/s">{words(1, 2)}</a></div>', lambda: f'<div class="advert promo"><p>{words(5, 30)}</p></div>', lambda: f'<form><p>{words(2, 8)}</p><input></form>',
        lambda: f'<div class="newsletter subscribe"><p>{words(5, 20)}.</p></div>', lambda: f'<p class="byline meta">{words(2, 5)}</p>',
    )
    around = (
        lambda: f"<nav><ul>{links(3, 8)}</ul></nav>", lambda: f'<ul class="menu">{links(3, 8)}</ul>', lambda: f'<header class="site-header"><h1><a href="/">{words(1, 3)}</a></h1><p>{words(2, 8)}</p></header>', lambda: f"<header><div>{words(1, 5)}</div></header>", lambda: f'<div id="header"><p>{words(1, 8)}</p></div>',
        lambda: f'<div class="breadcrumbs"><a href="/">{words(1, 1)}</a> &gt; <a href="/">{words(1, 2)}</a></div>', lambda: f'<div class="cookie-notice banner">{words(5, 40)}. <button>{words(1, 1)}</button></div>', lambda: f'<div class="notice" role="alert"><p>{words(5, 30)}.</p></div>',
        lambda: f'<aside class="sidebar"><h3>{words(1, 3)}</h3><p>{words(5, 60)}.</p><ul>{links(2, 6)}</ul></aside>', lambda: f'<div id="sidebar" class="widget"><p>{words(5, 60)}.</p></div>', lambda: f"<aside><p>{words(5, 60)}.</p></aside>", lambda: f'<div class="ad">{words(5, 60)}.</div>', lambda: f'<div class="banner sponsored ads">{words(5, 40)}.</div>',
        lambda: f'<section class="comments" id="comments"><h3>{words(1, 3)}</h3>' + "".join(f'<div class="comment"><p>{words(5, 60)}.</p></div>' for _ in range(r.randint(1, 4))) + "</section>", lambda: f'<form class="search login"><label>{words(1, 3)}</label><input></form>', lambda: f'<div class="popup modal overlay"><p>{words(4, 30)}.</p></div>',
        lambda: f'<ol class="comment-list">' + "".join(f'<li class="comment"><article class="comment-body"><p>{words(5, 60)}.</p></article></li>' for _ in range(r.randint(1, 3))) + "</ol>", lambda: f'<div class="pagination">{words(1, 3)} <a href="/2">2</a></div>',
        lambda: f"<footer>&copy; {words(1, 4)} &middot; {words(4, 40)}.</footer>", lambda: f'<footer class="site-footer"><p>{words(4, 40)}.</p><ul>{links(1, 5)}</ul></footer>', lambda: f'<div id="footer" class="copyright">{words(4, 40)}.</div>', lambda: f'<div class="tags">{words(1, 4)} <a href="/t">{words(1, 1)}</a></div>',
    )
    wraps = (
        ("<article>", "</article>"), ("<article>", "</article>"), ('<main><article class="post">', "</article></main>"), ("<main>", "</main>"), ('<div id="content">', "</div>"), ('<div class="post-body entry-content">', "</div>"), ('<section class="article-body">', "</section>"), ('<div class="main content"><div class="story text">', "</div></div>"), ('<div role="main">', "</div>"), ("<div>", "</div>"), ("", ""), ("", ""), ('<table class="layout"><tr><td>', "</td></tr></table>"),
    )
    pages = []
    for _ in range(n):
        left, right = r.choice(wraps)
        if left in ("", "<div>") and r.random() < 0.5:  # text without an element of its own
            loose = "<br>".join(said(2, 60) for _ in range(r.randint(1, 5)))
            if r.random() < 0.3:
                pages.append((loose if r.random() < 0.5 else f"<html><body>{loose}</body></html>", "Zq"))
                continue
            left, right = left + loose, (f"<b>{said(1, 4)}</b> {words(2, 9)}" if r.random() < 0.3 else "") + right
        body = [f"<h1>{said(1, 8)}</h1>"] * r.randint(0, 1) + [r.choice(inner)() for _ in range(r.randint(1, 9))]
        if r.random() < 0.4:
            body.insert(r.randint(0, len(body)), r.choice(intruders)())
        before = [r.choice(around)() for _ in range(r.randint(0, 4))]
        after = [r.choice(around)() for _ in range(r.randint(0, 4))]
        pages.append((f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{''.join(before)}{left}{''.join(body)}{right}{''.join(after)}" + "</body></html>" * (r.random() < 0.8), "Zq"))
    return pages


@cache
def default_model() -> Model:
    """The model of labelled_pages, trained once in each process that uses it (under a second)."""
    return Model(labelled_pages())


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with a column main_text (replaced if there is one): the main text of each page.

    A null or empty page, or one without text, gives an empty text. Malformed markup is read as
    browsers read it: unknown declarations are comments, open elements end with the page, stray
    end tags mean nothing. No page stops the job. References are decoded,
    white space in a block becomes one space, blocks are joined by an empty line in page
    order. Rows may repeat. An empty input gives no rows; other columns pass through.
    """
    own, page_html = [c for c in pages.columns if c != "main_text"], "html_of_page"
    while page_html in own:
        page_html = "_" + page_html

    def run(batches):
        import pyarrow as pa

        model = default_model()
        for batch in batches:
            texts = [model.main_text(h) if h else "" for h in str_texts(batch.column(len(own)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(texts, pa.string())], [*own, "main_text"])

    return pages.select(*own, F.col(html_col).alias(page_html)).mapInArrow(run, pages.select(*own).schema.add("main_text", "string"))


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = extract(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
