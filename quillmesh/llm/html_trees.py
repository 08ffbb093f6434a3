"""Main-text extraction from HTML: gradient-boosted trees score DOM nodes, a tree search decides them together.

A tolerant parser builds the DOM of one page as lists, in one pass forward. Every block element (and every span with a class or
id) is a node with features: its tag's family, text and link and tag density of its subtree, tokens of class, id and role
attributes of itself and its ancestors, depth, and its place among its siblings. The forest gives each node's log-odds to be
part of the article. Decoding picks the likeliest labelling in which a dropped node has no kept descendant: from the leaves up, a
subtree is worth either dropping it whole or keeping its root and the best of each child. The text of kept nodes is joined in
page order. What no reader sees as text (scripts, styles, form controls) is left out; hidden elements are judged as all others.

The forest is trained here, on generated pages of known structure (`synthetic_pages`), the same each time. Names there are only
hints: boilerplate often has none or a plain one, and paragraphs of articles as often have names that boilerplate has. Articles hold
sections, bare divs and lists of links, and many are shorter than the menus around them.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.forest import Forest, fit
from quillmesh.llm.textscan import small_batches

#: Fixed values of HTML: elements without content, with raw text, inline ones, and those that a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr ruby rt rp img math mi mn mo ms mrow mfrac msup msub msqrt mtext".split())
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
#: Tags that change what a start tag closes, and elements that an inline end tag does not reach across.
CHANGES = frozenset(t for closed, within in CLOSED_BY.values() for t in closed | within)
BARRIERS = frozenset(["td", "th", "table"])
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements whose text is never page text: what scripts and styles need, and form controls.
SILENT = frozenset("head script style noscript template iframe noembed noframes svg textarea select option datalist title xmp".split())
FAMILIES = [
    frozenset(["p"]), frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("ul ol dl menu".split()), frozenset("li dt dd".split()), frozenset("div section center".split()),
    frozenset("article main".split()), frozenset("nav aside footer header".split()), frozenset(["form", "fieldset"]), frozenset("table thead tbody tfoot tr td th".split()),
    frozenset("blockquote pre figure figcaption".split()), frozenset(["span"]), frozenset("html body".split()),
]
#: Words in class, id and role values: of blocks that are no article's, of page furniture whose names articles use too, of content.
FOREIGN = frozenset("""footer colophon ad ads advert adverts advertisement adsense sponsor sponsored promo promoted promotion cookie cookies consent gdpr popup modal overlay newsletter subscribe
subscription signup login register searchbox comment comments commentlist disqus respond discussion paywall contentinfo""".split())
FURNITURE = frozenset("""nav navbar navigation menu menubar header masthead topbar banner bottom sidebar side aside rail notice notices alert warning search form reply replies share sharing social follow
related recommended recommendations more popular trending breadcrumb breadcrumbs pagination pager widget toolbar tags copyright legal terms privacy skip hidden complementary dialog reader readers
reactions feedback announcement teaser toc links""".split())
INNER = frozenset("article content main post entry story body text page document prose copy lead headline title".split())

NAMES = [*(f"family_{i}" for i in range(len(FAMILIES))), "depth", "log_chars", "share", "link_share", "tags_per_char", "log_words", "marks_per_word", "own_foreign", "above_foreign", "own_furniture", "above_furniture", "own_inner", "above_inner",
         "in_article", "in_outer_tag", "in_form", "siblings", "place", "sibling_share", "same_tag_before", "paragraphs", "list_share", "text_before", "inputs", "mean_word", "article_on_page", "outer_child_share",
         "parent_log_chars", "parent_paragraphs", "parent_link_share", "parent_share", "beside_article", "own_chars_share", "page_log_chars", "prose_share", "parent_prose_share", "parent_inner", "parent_foreign", "share_of_parent"]

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MARK = re.compile(r"[.,;:!?]")


class Page:
    """Nodes (parallel lists) and, in page order, pieces of text (node, text) and breaks (-1, "")."""

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.depth, self.tokens, self.silent, self.tags_in = ["html"], [-1], [0], [frozenset()], [False], [0]
        self.pieces: list[tuple[int, str]] = []
        self.links: list[bool] = []
        self._parse(html)

    def _node(self, tag: str, parent: int, attributes: str) -> int:
        tokens: frozenset[str] = frozenset()
        if attributes and "=" in attributes:
            found = set()
            for name, *values in _ATTRIBUTE.findall(attributes):
                if name.lower() in ("class", "id", "role"):
                    found.update(w.lower() for w in _WORD.findall(values[0] or values[1] or values[2]))
            tokens = frozenset(found)
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.tokens.append(tokens)
        self.silent.append(self.silent[parent] or tag in SILENT)
        self.tags_in.append(0)
        return len(self.tag) - 1

    @staticmethod
    def _tags(html: str) -> Iterator[tuple[int, int, str, str, str] | int]:
        """(start, end, slash, name, attributes) of each tag and comment (name empty), in one pass. A place sent back is where the
        scan goes on. A quote that nothing closes is an ordinary character; where a tag has no end outside quotes, this one and
        all later tags end at their next ">"; where none is left, the rest is text."""
        at, size, last_end, quoted = 0, len(html), html.rfind(">"), True
        last = {q: html.rfind(q) for q in "\"'"}
        while True:
            i = html.find("<", at)
            if i < 0:
                return
            head = html[i + 1 : i + 2]
            if head == "!" or head == "?":
                mark = "-->" if html.startswith("!--", i + 1) else "]]>" if html.startswith("![CDATA[", i + 1) else ">"
                end = html.find(mark, i + 2)
                end = size if end < 0 else end + len(mark)
                at = (yield i, end, "", "", "") or end
                continue
            slash = "/" if head == "/" else ""
            found = _NAME.match(html, i + 1 + len(slash)) if i < last_end else None
            if not found:
                at = i + 1
                continue
            begin = stop = found.end()
            while quoted:
                hit = _STOP.search(html, stop)
                if hit is None:
                    quoted = False
                elif html[hit.start()] == ">":
                    stop = hit.start()
                    break
                else:
                    stop = hit.end()
                    if hit.start() < last[hit[0]]:
                        stop = html.index(hit[0], stop) + 1
            if not quoted:
                stop = html.find(">", begin)
            at = (yield i, stop + 1, slash, found[0].lower(), html[begin:stop]) or stop + 1

    def _parse(self, html: str) -> None:
        # Open elements: tag, the node that its text belongs to, the place of the p that the next block closes (-1: none), and the
        # places of the elements that certain start tags close, by group.
        groups = {closing: g for g, closing in enumerate(CLOSED_BY)}
        stack: list[tuple[str, int, int, tuple[int, ...]]] = [("html", 0, -1, (-1,) * len(groups))]
        at, size, links = 0, len(html), 0
        pieces, link_flags = self.pieces, self.links
        opened: Counter[str] = Counter()
        inner: list[Counter[str]] = [Counter()]  # inline elements open within each table part

        def text(part: str) -> None:
            if part:
                node = stack[-1][1]
                if not self.silent[node]:
                    pieces.append((node, entities.unescape(part) if "&" in part else part))
                    link_flags.append(links > 0)

        def gap() -> None:
            pieces.append((-1, ""))
            link_flags.append(False)

        def close(to: int) -> None:
            nonlocal links
            while len(stack) > to:
                tag = stack.pop()[0]
                opened[tag] -= 1
                if tag == "a":
                    links -= 1
                if tag in INLINE:
                    inner[-1][tag] -= 1
                else:
                    gap()
                    if tag in BARRIERS:
                        inner.pop()

        tags = self._tags(html)
        onward = None
        while True:
            try:
                start, end, slash, tag, attributes = tags.send(onward)
            except StopIteration:
                break
            onward = None
            text(html[at:start])
            at = end
            if not tag:
                continue
            if slash:
                if tag == "br" or tag == "p" and not opened["p"]:
                    gap()
                elif (inner[-1][tag] if tag in INLINE else opened[tag]) > 0:
                    i = len(stack) - 1
                    while stack[i][0] != tag:
                        i -= 1
                    close(i)
                continue
            self.tags_in[stack[-1][1]] += 1
            if tag == "html" or tag in VOID:
                if tag not in INLINE:
                    gap()
                if tag == "input":
                    self._node(tag, stack[-1][1], "")
                continue
            if tag in CLOSES_P and stack[-1][2] >= 0:
                close(stack[-1][2])
            if tag in groups and stack[-1][3][groups[tag]] >= 0:
                close(stack[-1][3][groups[tag]])
            inline = tag in INLINE
            if not inline:
                gap()
            _, own, paragraph, closable = stack[-1]
            if not inline or tag == "span" and attributes.strip() or tag in SILENT:
                own = self._node(tag, own, attributes)
            if attributes.endswith("/") and (inline or tag in ("svg", "path")):
                continue
            if tag in RAW:
                found = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
                if not found:
                    at = size
                    break
                onward = at = html.find(">", found.start()) + 1 or size
                continue
            if tag in CHANGES:
                closable = tuple(len(stack) if tag in closed else -1 if tag in within else c for c, (closed, within) in zip(closable, CLOSED_BY.values(), strict=True))
            paragraph = len(stack) if tag == "p" else paragraph if inline else -1
            links += tag == "a"
            opened[tag] += 1
            if inline:
                inner[-1][tag] += 1
            elif tag in BARRIERS:
                inner.append(Counter())
            stack.append((tag, own, paragraph, closable))
        text(html[at:])

    def features(self) -> np.ndarray:
        """nodes x NAMES."""
        n = len(self.tag)
        chars, link, words, marks, tags = ([0] * n for _ in range(5))
        paragraphs, items, inputs, first = [0] * n, [0] * n, [0] * n, [0] * n
        seen = 0
        for (node, part), linked in zip(self.pieces, self.links, strict=True):
            if node < 0:
                continue
            held = part.split()
            size = sum(map(len, held)) + len(held)
            chars[node] += size
            words[node] += len(held)
            link[node] += size if linked else 0
            marks[node] += len(_MARK.findall(part))
        own_chars, parent, tag = list(chars), self.parent, self.tag
        before = [0] * n
        for i in range(n):
            before[i] = seen
            seen += own_chars[i]
            tags[i] = self.tags_in[i]
            paragraphs[i], items[i], inputs[i] = int(tag[i] == "p"), int(tag[i] == "li"), int(tag[i] in ("input", "textarea", "select", "button"))
        for i in range(n - 1, 0, -1):  # children come after their parents
            p = parent[i]
            for v in (chars, link, words, marks, tags, paragraphs, items, inputs):
                v[p] += v[i]
        total = max(1, chars[0])
        count, own_foreign, own_furniture, own_inner = [0] * n, [0] * n, [0] * n, [0] * n
        child_chars, outer_children = [0] * n, [0] * n
        above_foreign, above_furniture, above_inner, in_article, in_outer, in_form = ([0] * n for _ in range(6))
        page_article = any(t in ("article", "main") for t in tag)
        holds = [int(t in ("article", "main")) for t in tag]
        prose = [chars_of if t == "p" or t in FAMILIES[9] else 0 for t, chars_of in zip(tag, chars, strict=True)]  # text in paragraphs and quotes
        for i in range(n - 1, 0, -1):
            holds[parent[i]] += holds[i]
            prose[parent[i]] = max(prose[parent[i]], min(prose[parent[i]] + prose[i], chars[parent[i]]))
        last_same: dict[tuple[int, str], int] = {}
        out = np.zeros((n, len(NAMES)), np.float32)
        base = len(FAMILIES)
        for i in range(n):
            t, p = tag[i], parent[i]
            own = self.tokens[i]
            if own:
                own_foreign[i], own_furniture[i], own_inner[i] = len(own & FOREIGN), len(own & FURNITURE), len(own & INNER)
            if p >= 0:
                above_foreign[i] = above_foreign[p] + own_foreign[p]
                above_furniture[i] = above_furniture[p] + own_furniture[p]
                above_inner[i] = above_inner[p] + own_inner[p]
                in_article[i] = in_article[p] + (tag[p] in ("article", "main"))
                in_outer[i] = in_outer[p] + (tag[p] in ("nav", "aside", "footer", "header"))
                in_form[i] = in_form[p] + (tag[p] == "form")
                first[i] = count[p]
                count[p] += 1
                child_chars[p] += chars[i]
                if t in ("nav", "aside", "footer", "header", "form") or own_foreign[i] or own_furniture[i]:
                    outer_children[p] += chars[i]
        for i in range(n):
            t, p = tag[i], parent[i]
            row = out[i]
            for f, family in enumerate(FAMILIES):
                if t in family:
                    row[f] = 1
                    break
            same = last_same.get((p, t), 0)
            last_same[p, t] = same + 1
            c = max(1, chars[i])
            row[base:] = (
                min(self.depth[i], 30), np.log1p(chars[i]), chars[i] / total, link[i] / c, tags[i] / c, np.log1p(words[i]), marks[i] / max(1, words[i]), min(own_foreign[i], 3), min(above_foreign[i], 3), min(own_furniture[i], 3), min(above_furniture[i], 3), min(own_inner[i], 3),
                min(above_inner[i], 3), min(in_article[i], 2), min(in_outer[i], 2), min(in_form[i], 1), min(count[p], 50) if p >= 0 else 0, first[i] / max(1, count[p]) if p >= 0 else 0,
                chars[i] / max(1, child_chars[p]) if p >= 0 else 1, min(same, 20), min(paragraphs[i], 50), items[i] / max(1, tags[i]), before[i] / total, min(inputs[i], 5), chars[i] / max(1, words[i]), page_article, outer_children[i] / c,
                *((np.log1p(chars[p]), min(paragraphs[p], 50), link[p] / max(1, chars[p]), chars[p] / total) if p >= 0 else (0, 0, 0, 1)),
                page_article and not holds[i] and not in_article[i], own_chars[i] / c, np.log1p(total), prose[i] / c,
                *((prose[p] / max(1, chars[p]), min(own_inner[p], 3), min(own_foreign[p] + own_furniture[p], 3), chars[i] / max(1, chars[p])) if p >= 0 else (0, 0, 0, 1)),
            )
        return out

    def decode(self, margin: np.ndarray) -> list[bool]:
        """The likeliest labels in which nothing kept lies below something dropped."""
        n = len(self.tag)
        keep = -np.logaddexp(0, -margin)  # log p
        drop = -np.logaddexp(0, margin)
        keep_sum, drop_sum = keep.tolist(), drop.tolist()
        below_drop = list(drop_sum)
        for i in range(n):
            if self.silent[i]:
                keep_sum[i], drop_sum[i], below_drop[i] = -1e9, 0.0, 0.0
        best = [0.0] * n
        for i in range(n - 1, -1, -1):
            best[i] = max(below_drop[i], keep_sum[i])
            p = self.parent[i]
            if p >= 0:
                below_drop[p] += below_drop[i]
                keep_sum[p] += best[i]
        kept = [False] * n
        for i in range(n):
            kept[i] = (i == 0 or kept[self.parent[i]]) and (i == 0 or keep_sum[i] >= below_drop[i])
        return kept

    def text(self, kept: list[bool]) -> str:
        return " ".join("".join([" " if node < 0 else part for node, part in self.pieces if node < 0 or kept[node]]).split())


# Generated pages with known labels

_OUTER_PARTS = ["menu", "header", "footer", "side", "notice", "advert", "form", "comments", "related", "share", "crumbs"]


def synthetic_pages(count: int, seed: int = 1) -> Iterator[tuple[str, set[int]]]:
    """(html, ids of the article's elements): every element has a data-n number; the article's root, all below it and the
    containers above it belong to the article. Names, structure, order, lengths and languages of words vary."""
    rng = random.Random(seed)
    FURNITURE_NAMES, INNER_NAMES, FOREIGN_NAMES = sorted(FURNITURE), sorted(INNER), sorted(FOREIGN)  # noqa: N806
    letters = ["abcdeilmnorstu", "aeioulnrst", "bdghklnrstäöüe", "áéíoulrsñc"]

    for _ in range(count):
        pool = rng.choice(letters)
        vocabulary = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 11))) for _ in range(300)]
        number, labels, out = 0, set(), []

        def words(n: int) -> str:
            found = [rng.choice(vocabulary) for _ in range(max(1, n))]
            found = [w + rng.choice([",", "", "", "", "", ""]) for w in found]
            if rng.random() < 0.08:
                found = [w + rng.choice(["###", "$$$", "&amp;&amp;", " |"]) for w in found]
            return " ".join(found).capitalize()

        def sentence(n: int) -> str:
            return words(n) + rng.choice([".", ".", ".", "!", "?", ""])

        def element(tag: str, body: str, main: bool, attributes: str = "", void: bool = False) -> str:
            nonlocal number
            number += 1
            if main:
                labels.add(number)
            return f'<{tag} data-n="{number}"{attributes}>{body}' + ("" if void else f"</{tag}>")

        plain = rng.choice([0.1, 0.4, 0.8])  # how often this page's boilerplate has no telling name

        def named(*names: str) -> str:
            pick = rng.choice(names)
            if rng.random() < plain:
                pick = rng.choice(["box", "block", "row", "inner", "wrap", "c" + str(rng.randint(1, 99)), *INNER_NAMES[:4]])
            return f' {rng.choice(["class", "id"])}="{rng.choice([pick, pick + "-box", "c" + str(rng.randint(1, 99)) + " " + pick, "site-" + pick])}"' if not plain or rng.random() < 0.85 else ""

        def links(n: int, item: str | None) -> str:
            every = [f'<a href="/{rng.choice(vocabulary)}">{words(rng.randint(1, 3))}</a>' for _ in range(n)]
            return "".join(element(item, a, False) for a in every) if item else rng.choice([" ", " | ", " &middot; "]).join(every)

        def outer(kind: str, inside: bool = False) -> str:
            """A block that is no article's. One inside an article, and one that holds prose, has a telling name, as nothing else would
            tell it from a part of an article or a short one."""
            nonlocal plain
            box, usual = rng.choice(["div", "div", "section"]), plain
            plain = 0 if inside or kind in ("side", "notice", "advert", "comments") else plain
            made = block(kind, box, inside)
            plain = usual
            return made

        def block(kind: str, box: str, inside: bool) -> str:
            if kind == "menu":
                body = element("ul", links(rng.randint(2, 12), "li"), False) if rng.random() < 0.7 else links(rng.randint(2, 9), None)
                return element("nav", body, False, named("nav", "menu")) if rng.random() < 0.6 else element(box, body, False, named("nav", "menu", "navigation", "navbar"))
            if kind == "header":
                body = rng.choice([element("h1", words(2), False), element("div", words(3), False), element("p", sentence(5), False)]) + (links(3, None) if rng.random() < 0.5 else "")
                return element("header", body, False, named("header", "masthead")) if rng.random() < 0.6 else element(box, body, False, named("header", "banner", "masthead", "topbar"))
            if kind == "footer":
                body = rng.choice(["&copy; " + words(4), element("p", "&copy; 2024 " + sentence(rng.randint(3, 15)), False), links(4, None) + element("p", sentence(9), False)])
                return element("footer", body, False, named("footer")) if rng.random() < 0.6 else element(box, body, False, named("footer", "copyright", "colophon"))
            if kind == "side":
                body = element("h3", words(2), False) + rng.choice([element("ul", links(5, "li"), False), "".join(element("p", sentence(rng.randint(6, 30)), False) for _ in range(rng.randint(1, 3)))])
                return element("aside", body, False, named("sidebar", "aside")) if rng.random() < 0.6 else element(box, body, False, named("sidebar", "side", "widget", "rail"))
            if kind == "notice":
                body = rng.choice([sentence(rng.randint(5, 30)), element("p", sentence(rng.randint(8, 30)), False)]) + (element("button", "OK", False) if rng.random() < 0.6 else "")
                return element(box, body, False, named("cookie", "consent", "notice", "alert", "banner", "popup", "newsletter"))
            if kind == "advert":
                body = rng.choice([sentence(rng.randint(3, 30)), f'<a href="/x">{words(6)}</a>', element("p", sentence(rng.randint(5, 25)), False)])
                return element(rng.choice([box, "aside"]), body, False, named("ad", "ads", "advert", "advertisement", "sponsored", "promo"))
            if kind == "form":
                body = element("label", words(2), False) + '<input type="text">' + rng.choice(["", element("p", sentence(10), False), element("textarea", "", False)]) + element("button", words(1), False)
                return element("form", body, False, named("search", "form", "signup", "subscribe", "login"))
            if kind == "comments":
                body = element("h3", words(2), False) if rng.random() < 0.7 else ""
                for _ in range(rng.randint(1, 7)):
                    body += element(rng.choice(["div", "li", "article"]), rng.choice([element("b", words(1), False) + " ", element("span", words(2), False, ' class="author"')]) + element("p", sentence(rng.randint(3, 60)), False), False, named("comment", "reply"))
                return element(rng.choice([box, "section"]), body, False, named("comments", "comment", "discussion", "respond", "disqus"))
            if kind == "related":
                body = element("h3", words(2), False) + element("ul", links(rng.randint(3, 8), "li"), False)
                return element(box, body, False, named("related", "recommended", "popular", "more"))
            if kind == "share":
                return element(box, links(rng.randint(2, 5), None), False, named("share", "social"))
            return element(box, links(rng.randint(2, 4), None), False, named("breadcrumb", "breadcrumbs"))

        def hint(tag: str = "div") -> str:
            """Names of an article's parts: mostly none, else any; those of foreign blocks only on parts that hold no others."""
            if rng.random() < busy:
                picks = [rng.choice(FURNITURE_NAMES), rng.choice(INNER_NAMES), rng.choice(vocabulary)] + ([rng.choice(FOREIGN_NAMES)] * 2 if tag in ("p", "blockquote", "h2", "h3", "ul", "pre") else [])
                pick = rng.choice(picks)
                return f' class="{rng.choice([pick, pick, pick + "-note", "text-" + pick])}"'
            return rng.choice(["", "", "", ' style="color:red"', " hidden"]) if rng.random() < 0.1 else ""

        busy = rng.choice([0.0, 0.1, 0.3, 0.6])
        sloppy, sectioned = rng.random() < 0.4, rng.random() < 0.15
        sizes = rng.choice([[1, 2, 5, 15, 40, 90, 160], [15, 40, 90], [1, 2, 5]])

        def part(level: int) -> str:
            """One block of an article, or a container of some."""
            draw, size = rng.random() if level or not sectioned else 0.35, rng.choice(sizes)
            inner = sentence(size)
            if rng.random() < 0.2:
                inner = f"<b>{words(3)}</b> {inner} <a href='/y'>{words(2)}</a> {sentence(4)}"
            if draw < 0.06:
                tag = rng.choice(["h2", "h3"])
                return element(tag, words(4), True, hint(tag))
            if draw < 0.11:
                return element("ul", "".join(element("li", sentence(rng.randint(2, 14)), True) for _ in range(rng.randint(2, 6))), True, hint("ul"))
            if draw < 0.16:
                items = "".join(element("li", f'<a href="/{rng.choice(vocabulary)}">{words(rng.randint(1, 6))}</a>' + (" " + sentence(3) if rng.random() < 0.3 else ""), True) for _ in range(rng.randint(2, 7)))
                return element(rng.choice(["ul", "ul", "ol"]), items, True, hint("ul"))
            if draw < 0.20:
                return element("blockquote", element("p", inner, True, hint("p")), True, hint("blockquote"))
            if draw < 0.23:
                return element("table", element("tr", "".join(element("td", words(2), True) for _ in range(3)), True), True)
            if draw < 0.31:
                return element("div", rng.choice([inner, inner, element("p", inner, True) + element("p", sentence(9), True)]), True, hint())
            if draw < 0.42 and level < 2:
                heading = element("h2", words(rng.randint(1, 5)), True) if rng.random() < 0.5 else ""
                return element(rng.choice(["section", "section", "div"]), heading + "".join(part(level + 1) for _ in range(rng.choice([1, 1, 2, 3]))), True, hint())
            if draw < 0.46:
                return element(rng.choice(["object", "map", "figure", "details", "section", "pre", "dl", "x-part", "canvas", "button"]), rng.choice([inner, element("p", inner, True)]), True, hint())
            if sloppy and draw < 0.6:
                return element("p", f"<b>{inner}<br>", True, void=True)
            return element("p", inner, True, hint("p"))

        def article(tag: str, attributes: str) -> str:
            heading = element("h1", words(rng.randint(1, 12)), True) if rng.random() < 0.8 else ""
            if heading and rng.random() < 0.15:
                heading = element("header", heading, True)
            body = heading
            for _ in range(rng.choice([1, 1, 2, 3, 5, 9, 20])):
                body += part(0)
                if rng.random() < 0.05:
                    body += outer(rng.choice(["advert", "share", "related", "notice"]), True)
            if rng.random() < 0.05:
                body += outer("comments", True)
            return element(tag, body, True, attributes) if tag else body

        main = article(*rng.choice([("article", ""), ("article", named("post", "entry", "story")), ("main", ""), ("div", named("content", "article", "post", "story", "entry", "main")), ("div", named("content", "article", "post", "story", "entry", "main")), ("div", hint()), ("div", ""), ("section", hint()), ("", "")]))
        if rng.random() < 0.3:
            main = element("main", main, True)
        before = "".join(outer(k) for k in rng.sample(_OUTER_PARTS, rng.randint(0, 5)))
        after = "".join(outer(k) for k in rng.sample(_OUTER_PARTS, rng.randint(0, 5)))
        if rng.random() < 0.4:
            aside = outer("side") if rng.random() < 0.5 else ""
            main = element("div", main + aside if rng.random() < 0.5 else aside + main, True, rng.choice(["", ' class="wrapper"', ' id="page"', ' class="container row"']))
        out = before + main + after
        if rng.random() < 0.3:
            out = element("div", out, True, rng.choice(["", ' id="wrapper"', ' class="layout"']))
        yield f"<!DOCTYPE html><html><head><title>{words(4)}</title><script>var a='<p>';</script></head><body>{out}</body></html>", labels


class _Numbered(Page):
    """Also keeps the data-n numbers of generated pages."""

    def __init__(self, html: str) -> None:
        self.numbers: list[int | None] = [None]
        super().__init__(html)

    def _node(self, tag: str, parent: int, attributes: str) -> int:
        found = re.search(r'data-n="(\d+)"', attributes)
        self.numbers.append(int(found[1]) if found else None)
        return super()._node(tag, parent, re.sub(r' ?data-n="\d+"', "", attributes))


def labelled_nodes(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rows, labels = [], []
    for html, main in synthetic_pages(count, seed):
        page = _Numbered(html)
        own = [i for i, n in enumerate(page.numbers) if n is not None and not page.silent[i]]
        rows.append(page.features()[own])
        labels += [int(page.numbers[i] in main) for i in own]
    return np.concatenate(rows), np.array(labels)


TRAINING_PAGES = 2200


@functools.cache
def trained(pages: int = TRAINING_PAGES, seed: int = 1) -> Forest:
    """The forest, fitted once in a process."""
    x, y = labelled_nodes(pages, seed)
    return fit(x, y, trees=80, depth=6, rate=0.2, bins=40, share=0.35)


_TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("nodes", pa.int64()), ("kept_nodes", pa.int64())])


def extract_pages(pages: DataFrame, forest: Forest | None = None) -> DataFrame:
    """page_id, url, text, n_chars, nodes, kept_nodes of every page, from the whole html. A null or empty html, and one without
    article, has an empty text. Null ids and urls and repeated rows pass through; other columns are not read; an empty table gives
    no row. Time is linear in a page's length; of labellings that tie the one that keeps more is taken."""
    small_batches(pages.sparkSession)
    forest = trained() if forest is None else forest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, htmls = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for first in range(0, len(ids), 100):
                parsed = [Page(h.as_py() or "") for h in htmls[first : first + 100]]
                every = [p.features() for p in parsed]
                margins = np.split(forest.margin(np.concatenate(every).astype(float)), np.cumsum([len(e) for e in every])[:-1])
                kept = [p.decode(m) for p, m in zip(parsed, margins, strict=True)]
                texts = [p.text(k) for p, k in zip(parsed, kept, strict=True)]
                columns = ids[first : first + 100], urls[first : first + 100], texts, [len(t) for t in texts], [len(p.tag) for p in parsed], [sum(k) for k in kept]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _TEXT, strict=True)], schema=_TEXT)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long, nodes long, kept_nodes long")
