"""Main text of HTML pages: flat blocks of text, classified by a decision tree over words and links of a block and its neighbours.

A page is cut at its block elements into a flat list of texts. Each has a few numbers: words and link density of itself,
of the block before and of the block after it, whether it is a heading, and what the elements around it say (an article,
a menu, a form, readers' comments). The tree is trained by Spark's DecisionTreeClassifier on the blocks of `labelled()`,
a thousand rows or so that a rule makes from page layouts; its nodes, a few dozen, go to the tasks. Pages are rows that need
no others, so there is no shuffle, and no text is cut.

Null and empty pages, and pages without a main block, give the empty text. Repeated and null ids are rows like others.
An element that is never closed ends with the element around it; a comment, a script or a tag that is never closed takes
the rest of the page. A run of white space (line breaks of `<br>` included) is one space. Time and memory are linear in
the page. Other columns are not read.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkbasin.llm.common import lean, small_batches, table

#: Elements whose content is no text.
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "noscript", "xmp"}
#: Elements that open a part of the page; the parts around a block say what it is.
PARTS = set("html body div section article main aside nav header footer form fieldset ul ol dl li dt dd table tr td th blockquote figure details dialog menu search button select template svg object label address center".split())
#: Elements that begin and end a block of text.
BLOCKS = PARTS - {"button", "label", "svg", "object"} | set("p h1 h2 h3 h4 h5 h6 hr pre figcaption caption tbody thead tfoot legend option optgroup summary dir hgroup".split())
#: Elements that a sibling of the same name ends.
SIBLINGS = {"li", "dt", "dd", "td", "th", "tr"}
BAD = {"nav", "aside", "footer", "dialog", "menu", "search", "button", "select", "template", "svg", "object"}
FORM = {"form", "fieldset", "label"}
BAD_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar tablist status note".split())
#: Words of class and id names, whole or as beginnings, that mark what is not the article.
BAD_WORDS = set("ad ads adv adslot adsense nav side aside tags tag meta byline legal copyright disclaimer pager rss print skip top bottom user account rating votes likes tools links notice gdpr privacy consent alert hidden ticker".split())
BAD_STARTS = ("advert", "sponsor", "navig", "navbar", "menu", "breadcrumb", "sidebar", "footer", "masthead", "banner", "cookie", "popup", "modal", "overlay", "newsletter", "subscri", "share", "sharing", "social", "related", "recommend", "promo", "teaser", "widget", "toolbar", "paginat", "login", "signin", "signup", "search", "outbrain", "taboola")
COMMENT_STARTS = ("comment", "disqus", "respond", "reply", "replies", "discussion", "guestbook", "feedback", "reader", "kommentar", "commentaire", "comentario")
GOOD_WORDS = set("article post entry content story main articlebody storybody maincontent text body".split())
#: Headings that begin the comments or what else is not the article, until the part around them ends.
TAIL_HEADING = re.compile(r"(?i)^\W*(\d+\s+)?(reader\s+)?(comments?|repl(y|ies)|responses?|discussion|leave a (reply|comment)|join the conversation|kommentare?|commentaires?|comentarios?|related|read (more|next)|more (from|stories)|you may also like|share this|see also|recommended|advertisement)\b.{0,40}$")

_TAG = re.compile(r"<(?:(?P<name>/?[a-zA-Z][^\s/>]*+)|!--|[!?/])")
_END = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z][-\w:]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_NAMES = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_WORD_MARK = re.compile(r"\w")

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "outside", "inside", "elsewhere", "form", "comments", "mark"]


def _marks(tag: str, rest: str) -> tuple[bool, bool, bool]:
    """Whether names and roles of a tag mark it as not the article, as the article, as comments."""
    bad = good = comment = False
    for key, *values in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), next((v for v in values if v), "")
        if key in ("class", "id"):
            names = [x.lower() for x in _NAMES.findall(value)]
            mine = GOOD_WORDS.intersection(names)
            for before, name in zip(["", *names], names):
                if before in ("has", "with", "no", "without"):
                    continue
                comment |= name.startswith(COMMENT_STARTS)
                bad |= name in BAD_WORDS or name.startswith(BAD_STARTS) or name == "header" and not mine
            good |= bool(mine)
        elif key == "role":
            bad |= value.lower() in BAD_ROLES
            good |= value.lower() in ("main", "article")
        elif key == "itemprop":
            good |= value.lower() == "articlebody"
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            bad = True
    return bad, good and not bad and not comment, comment


def blocks(page: str) -> list[tuple[str, int, int, bool, bool, bool, bool, bool]]:
    """(text, words, linked words, heading, outside, inside, form, comments) of each block of a page, in order."""
    out: list[tuple[str, int, int, bool, bool, bool, bool, bool]] = []
    text: list[str] = []
    link: list[str] = []
    # of the parts that are open: name and (outside, inside, form, comments)
    stack: list[tuple[str, tuple[bool, bool, bool, bool]]] = [("", (False, False, False, False))]
    open_: dict[str, int] = {}
    heading = own_bad = own_comment = False
    linked = 0  # number of parts that were open where a link began, 0 outside of links
    quotes = True

    def add(piece: str) -> None:
        if "&" in piece:
            piece = html.unescape(piece)
        text.append(piece)
        if linked:
            link.append(piece)
        elif link:
            link.append(" ")

    def end() -> None:
        nonlocal own_bad, own_comment, heading
        if text:
            words = "".join(text).split()
            if words:
                bad, good, form, comment = stack[-1][1]
                said = " ".join(words)
                if heading and TAIL_HEADING.match(said):
                    # until the part around the heading ends
                    stack[-1] = (stack[-1][0], (bad, good, form, True))
                    comment = True
                out.append((said, len(words), min(len(words), len("".join(link).split())), heading, bad or own_bad, good, form, comment or own_comment))
            text.clear()
            link.clear()
        own_bad = own_comment = False

    def close(name: str) -> None:
        nonlocal linked
        if open_.get(name):
            while True:
                last = stack.pop()[0]
                open_[last] -= 1
                if last == name:
                    break
            if linked > len(stack):
                linked = 0

    at, n = 0, len(page)
    while at < n:
        tag = _TAG.search(page, at)
        if tag is None:
            add(page[at:])
            break
        if tag.start() > at:
            add(page[at : tag.start()])
        name = tag["name"]
        if name is None:
            stop = page.find("-->" if tag[0] == "<!--" else ">", tag.end())
            at = n if stop < 0 else stop + (3 if tag[0] == "<!--" else 1)
            continue
        rest = _END.match(page, tag.end()) if quotes else None
        if rest:
            at = rest.end()
        else:
            quotes = False  # a quote stays open: from here on tags end at the first bracket
            stop = page.find(">", tag.end())
            at = n if stop < 0 else stop + 1
        name, closing = name.lstrip("/").lower(), name[0] == "/"
        inner = page[tag.end() : at - 1]
        if closing:
            if name in BLOCKS:
                end()
                heading = False
            if name == "a" or name == "p":
                linked = 0
            if name in PARTS:
                close(name)
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = n if stop is None else stop.start()
            continue
        if name == "a":
            linked = len(stack)
        elif name == "br":
            add(" ")
        if name in BLOCKS:
            end()
            heading = name[0] == "h" and name[1:] in ("1", "2", "3", "4", "5", "6")
        if name in PARTS:
            if name in SIBLINGS and stack[-1][0] == name:
                close(name)
            bad, good, form, comment = stack[-1][1]
            if name not in ("html", "body"):
                b, g, c = _marks(name, inner) if inner else (False, False, False)
                if name == "main":
                    bad = form = False
                elif name == "article":
                    form = False
                bad |= b or name in BAD or name == "header" and not good
                comment |= c
                good |= name in ("main", "article") or g
                form |= name in FORM
            if not inner.endswith("/"):
                stack.append((name, (bad, good, form, comment)))
                open_[name] = open_.get(name, 0) + 1
        elif name in BLOCKS and inner:
            own_bad, _, own_comment = _marks(name, inner)
    end()
    return out


def features(pages: list[list[tuple]]) -> np.ndarray:
    """FEATURES of all blocks of some pages, one after another."""
    flat = [b for p in pages for b in p]
    n = len(flat)
    out = np.zeros((n, len(FEATURES)))
    if not n:
        return out
    out[:, 0] = [b[1] for b in flat]
    out[:, 1] = [b[2] / b[1] for b in flat]
    size = np.array([len(p) for p in pages])
    first = np.repeat(np.cumsum(size) - size, size)
    place = np.arange(n)
    before, after = place > first, place < first + np.repeat(size, size) - 1
    out[1:, 2:4] = np.where(before[1:, None], out[:-1, :2], 0)
    out[:-1, 4:6] = np.where(after[:-1, None], out[1:, :2], 0)
    out[:, [6, 7, 8, 10, 11]] = np.array([(b[3], b[4], b[5], b[6], b[7]) for b in flat], float)
    some = np.repeat([any(b[5] and not b[4] and not b[7] for b in p) for p in pages], size)
    out[:, 9] = some & (out[:, 8] == 0)
    out[:, 12] = [b[0][0] == "©" or not _WORD_MARK.search(b[0]) for b in flat]
    return out


def _prose(start: int, words: int) -> str:
    """Words of no meaning, sentences of eight; `start` makes it differ from others."""
    made = [f"{'bcdfglmnprst'[(start + 5 * i) % 12]}{'aeiou'[(start + i) % 5]}{'lnrst'[(3 * start + i) % 5]}{'aeo'[i % 3]}" for i in range(words)]
    return " ".join(f"{w}." if i % 8 == 7 or i == words - 1 else w for i, w in enumerate(made)) + f" x{start}x"


def labelled(pages: int = 72) -> list[tuple[list[float], float]]:
    """The labelled table: FEATURES and label (1: main text) of the blocks of `pages` small pages that a rule makes.

    The rule goes through kinds of article (marked by an element, by a name, or not at all), what stands around it
    (marked or not), and lengths of paragraphs, short ones among them.
    """
    made, count = [], 0
    for k in range(pages):
        label: dict[str, int] = {}

        def said(words: int, main: int) -> str:
            nonlocal count
            count += 1
            text = _prose(count, words)
            label[text] = main
            return text

        marked, around, kind = k % 4 != 3, k % 8 != 7, k % 8
        menu = "<ul>" + "".join(f'<li><a href="/x">{said(1 + (k + i) % 3, 0)}</a></li>' for i in range(4 + k % 3)) + "</ul>"
        open_, close = [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="entry-content">', "</div>"), ("<div>", "</div>")][k % 4]
        paragraphs = "".join(f"<p>{said([30, 6, 60, 2, 45, 12, 90, 25][(k + i) % 8] + 3 * i, 1)}</p>" if i % 4 != 3 else f"<h2>{said(2 + k % 4, 1)}</h2>" for i in range(5 + k % 4))
        if k % 5 == 4:  # one paragraph only, between short blocks
            paragraphs = f"<p>{said(28 + k, 1)}</p>"
        head = f'<div class="top-banner">{said(9 + k % 20, 0)}</div>' if kind in (1, 5) else f"<header><p>{said(4 + k % 5, 0)}</p></header>" if kind in (2, 6) else ""
        nav = f"<nav>{menu}</nav>" if kind in (0, 3) else f'<div class="menu">{menu}</div>' if kind in (1, 4) else menu
        ad = f'<div class="ad">{said([5, 14, 40][k % 3], 0)}</div>' if around else ""
        notice = f'<div id="cookie-notice"><p>{said(35, 0)}</p></div>' if around and k % 3 == 0 else ""
        aside = f"<aside><h3>{said(2, 0)}</h3><p>{said([8, 35, 70][k % 3], 0)}</p></aside>" if around and k % 2 else ""
        within = f'<aside>{said(20, 0)}</aside><div class="share">{said(3, 0)}</div>' if marked and k % 3 == 1 else ""
        form = f'<form><label>{said(2, 0)}</label><p>{said([6, 30][k % 2], 0)}</p><button>{said(1, 0)}</button></form>' if k % 3 != 2 and around else ""
        loose = f"<div><p>{said([12, 45][k % 2], 0)}</p></div>" if marked and k % 4 < 2 and k % 3 else ""
        comments = f'<section class="comments"><h3>{said(2, 0)}</h3>' + "".join(f"<p>{said([10, 30, 55][(k + i) % 3], 0)}</p>" for i in range(2 + k % 2)) + "</section>" if k % 3 < 2 else ""
        foot = f"<footer>&copy; {said(6 + k % 30, 0)}</footer>" if k % 2 else f'<div class="footer"><p>{said(4 + k % 25, 0)}</p></div>' if around else f'<p><a href="/">{said(3, 0)}</a> <a href="/">{said(2, 0)}</a></p>'
        if not around:
            # nothing but length and links tells these from the article
            head = f"<div>{said(2 + k % 6, 0)}</div>"
            aside = f"<div><h3>{said(2 + k % 3, 0)}</h3><ul>" + "".join(f'<li><a href="/y">{said(3 + (k + i) % 7, 0)}</a></li>' for i in range(3)) + "</ul></div>" if k % 16 == 7 else ""
            foot += f"<div>{said(3 + k % 7, 0)}</div><div>{said(2 + k % 5, 0)}</div>"
        title = f"<h1>{said(1 + k % 7, 1)}</h1>"
        inner = comments if k % 4 < 2 and k % 2 else ""
        if k % 8 == 7 and k % 3 != 1:  # nothing but the article
            head = nav = ad = notice = aside = form = loose = comments = foot = inner = within = ""
        if k % 12 == 5:  # a page of links
            title = paragraphs = within = inner = comments = ""
        page = f"<html><head><title>t</title></head><body>{head}{nav}{ad}{notice}{open_}{title}{paragraphs}{within}{inner}{close}{aside}{form}{loose}{'' if inner else comments}{foot}</body></html>"
        found = blocks(page)
        rows = features([found])
        for block, row in zip(found, rows):
            parts = [v for t, v in label.items() if t in block[0]]
            made.append((row.tolist(), float(max(parts))))
    return made


class Tree:
    """A decision tree as arrays: feature (-1: leaf), threshold, children, and what a leaf says."""

    def __init__(self, model):
        self.nodes: list[list[float]] = []
        self._add(model._java_obj.rootNode())

    def _add(self, node) -> int:
        at = len(self.nodes)
        self.nodes.append([-1, 0.0, 0, 0, node.prediction()])
        if node.getClass().getSimpleName() == "InternalNode":
            self.nodes[at][:2] = [node.split().featureIndex(), node.split().threshold()]
            self.nodes[at][2] = self._add(node.leftChild())
            self.nodes[at][3] = self._add(node.rightChild())
        return at

    def main(self, rows: np.ndarray) -> np.ndarray:
        """Whether each row of FEATURES is main text."""
        nodes = np.array(self.nodes)
        at = np.zeros(len(rows), np.int64)
        while True:
            feature = nodes[at, 0].astype(np.int64)
            inner = feature >= 0
            if not inner.any():
                return nodes[at, 4] > 0.5
            left = rows[np.arange(len(rows)), feature.clip(0)] <= nodes[at, 1]
            at = np.where(inner, np.where(left, nodes[at, 2], nodes[at, 3]).astype(np.int64), at)


def trained(spark: SparkSession, examples: list[tuple[list[float], float]] | None = None, depth: int = 8) -> Tree:
    """The tree of a labelled table: FEATURES and label, one row a block. It should fit the driver."""
    rows = spark.createDataFrame([(v, y) for v, y in (labelled() if examples is None else examples)], "v array<double>, label double").coalesce(1)
    learner = DecisionTreeClassifier(featuresCol="features", maxDepth=depth, minInstancesPerNode=2, maxBins=64, seed=11)
    return Tree(learner.fit(rows.select(array_to_vector("v").alias("features"), "label")))


def _texts(tree: Tree):
    def rows(batches):
        for batch in batches:
            pages = [blocks(p) if p else [] for p in batch.column("html").to_pylist()]
            keep = tree.main(features(pages)).tolist()
            texts, at = [], 0
            for found in pages:
                texts.append("\n\n".join(b[0] for b, k in zip(found, keep[at : at + len(found)]) if k))
                at += len(found)
            others = [c for c in batch.schema.names if c != "html"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(texts, pa.string())], names=[*others, "text"])

    return rows


def main_texts(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """page_id, url, text of pages (page_id, url, html)."""
    small_batches(pages.sparkSession)
    mine = pages.select("page_id", "url", "html")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in mine.schema if f.name != "html")
    return mine.mapInArrow(lean(_texts(tree or trained(pages.sparkSession))), f"{kinds}, text string")


def op11_block_tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
