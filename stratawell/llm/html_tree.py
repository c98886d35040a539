"""Main text of HTML pages by a tree-structured graphical model.

A page is parsed into a tree of block elements and text runs (inline markup
does not part a run; a block boundary does).  Each node is content or not.  A
node's own evidence (tag, words of class, id and role, lengths, link density,
sentence marks) is a logistic model; parent-child potentials say how labels of
neighbours go together, by the child's kind.  Sum-product messages upward and
downward give each node's marginal; runs of 0.5 or more make the text, in page
order, joined by line feeds, white space inside a run turned into one space.

The model is trained on pages that training_pages() writes with known labels
(a fixed seed and number); no page of the input is used to train it.

Nulls and empty pages give an empty text.  Broken markup, unclosed elements and
cut pages are parsed as far as they go.  Equal pages have equal texts.  Extra
input columns are not read.
"""

from __future__ import annotations

import html
import random
import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from stratawell.llm.arrow_map import map_batches

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role|aria-label|hidden|style|itemprop)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "title", "template", "iframe", "textarea", "svg", "select", "annotation")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var picture".split())
#: Formulas are part of the text around them.
INLINE |= frozenset("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
#: Elements that stand for their content: inside a paragraph they don't part it.
CLEAR = frozenset("noscript object".split())
BREAKS = frozenset("br wbr".split())
#: What an opening tag closes if it is the innermost of its kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
LIMITS = frozenset("ul ol dl table body html article section div nav".split())

TAGS = ["#text", "other"] + "html body div section article main header footer nav aside form p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th tbody blockquote pre figure figcaption button dialog details summary address fieldset hr center menu head noscript object".split()
TAG_ID = {t: i for i, t in enumerate(TAGS)}
#: Words of class, id and role, one group per kind of page part.
WORDS = [
    re.compile(rf"(?:^|[^a-z])(?:{w})", re.I)
    for w in (
        "ad(?![a-z])|ads(?![a-z])|advert|sponsor|promo|banner|adsense|dfp|outbrain|taboola|commercial(?![a-z])",
        "nav(?:bar|igation)?(?![a-z])|menu|breadcrumb|crumb|toolbar|tabs?(?![a-z])|pagination|pager|skip|toc(?![a-z])",
        "comments?(?![a-z])|comment(?:list|body|form|area|text)|disqus|repl(?:y|ies)(?![a-z])|respon(?:ses?|d)(?![a-z])|discussions?(?![a-z])|reader|feedback|reviews(?![a-z])",
        "footer|foot(?![a-z])|copyright|legal(?![a-z])|bottom|colophon|imprint",
        "head(?:er)?(?![a-z])|masthead|topbar|logo(?![a-z])|site-title|brand(?![a-z])|hero(?![a-z])",
        "side(?![a-z])|sidebar|rail(?![a-z])|widget|related|recommend|popular|trending|more-|see-also|teaser|archive|tagcloud",
        "cookie|consent|notice|alert|warning|gdpr|privacy|modal|popup|overlay|toast|dialog|message|info(?:box)?(?![a-z])|paywall|announcement",
        "share|social|follow|subscribe|newsletter|signup|sign-up|login|search|form(?![a-z])|download(?![a-z])|print(?![a-z])",
        "article|content|post(?!ed)|entry|story|main|body|text|prose|paragraph|chapter|blog",
        "meta|byline|author|date|tags?(?![a-z])|categor|caption|credit|contact",
    )
]
BINS = (4, 25, 80, 200)
N_BITS = len(WORDS) + 1
SECTIONS = [TAG_ID[t] for t in "nav header footer aside form article main button ul ol table figure".split()]
N_FEATURES = len(TAGS) * 2 + N_BITS * 2 + len(SECTIONS) + 8 + (len(BINS) + 1) + 4 + 3 + 2
KINDS = 3  # child is a text run, a block that holds runs only, any other


class Page:
    """Nodes of a page in document order: parent, tag, attribute bits; texts and link characters of runs."""

    _bits: dict[str, int] = {}

    def __init__(self, source: str):
        self.parent, self.tag, self.bits, self.depth = [-1], [TAG_ID["html"]], [0], [0]
        self.runs: list[tuple[int, str, int]] = []
        self._parse(source)

    @classmethod
    def attribute_bits(cls, attrs: str) -> int:
        if not attrs or attrs.isspace():
            return 0
        got = cls._bits.get(attrs)
        if got is None:
            said, got = "", 0
            for name, value in ATTRIBUTE.findall(attrs):
                name, value = name.lower(), value.strip("\"'")
                if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    got |= 1 << len(WORDS)
                elif name != "style":
                    said += " " + re.sub(r"([a-z])([A-Z])", r"\1-\2", value)
            for i, w in enumerate(WORDS):
                if said and w.search(said):
                    got |= 1 << i
            if len(cls._bits) > 20_000:
                cls._bits.clear()
            if len(attrs) < 300:
                cls._bits[attrs] = got
        return got

    def _add(self, tag: str, bits: int) -> int:
        up = self._open[-1][1]
        self.parent.append(up)
        self.tag.append(TAG_ID.get(tag, 1))
        self.bits.append(bits)
        self.depth.append(self.depth[up] + 1)
        return len(self.parent) - 1

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.runs.append((self._add("#text", 0), text, min(self._link, len(text))))
            self._text.clear()
        self._link = 0

    def _parse(self, source: str) -> None:
        self._open: list[tuple[str, int]] = [("", 0)]
        self._text: list[str] = []
        self._link, links, at, size = 0, 0, 0, len(source)
        text, opened, scan = self._text, self._open, TOKEN.search
        while at < size:
            m = scan(source, at)
            a = m.start() if m else size
            if a > at:
                piece = source[at:a]
                if "&" in piece:
                    piece = html.unescape(piece)
                text.append(piece)
                if links:
                    self._link += len(piece)
            if not m:
                break
            at = m.end()
            tag = m["tag"] or m["tag2"]
            if tag is None:
                if source.startswith("<![CDATA[", a):
                    text.append(source[a + 9 : at].removesuffix("]]>"))
                continue
            tag = tag.lower()
            if m["close"] or m["close2"]:
                if tag == "a":
                    links = max(0, links - 1)
                elif tag not in INLINE and tag not in VOID:
                    for k in range(len(opened) - 1, 0, -1):
                        if opened[k][0] == tag:
                            self._flush()
                            del opened[k:]
                            links = 0
                            break
                        if tag == "p" and opened[k][0] in LIMITS or tag == "li" and opened[k][0] in ("ul", "ol"):
                            break
                continue
            if tag in BREAKS:
                text.append(" ")
                continue
            if tag in VOID:
                if tag == "hr":
                    self._flush()
                continue
            if tag in RAW:
                end = RAW[tag].search(source, at)
                if end is None and tag in ("script", "style", "title", "textarea"):
                    break
                at = end.end() if end else at
                continue
            if tag in INLINE or tag in CLEAR and opened[-1][0] == "p":
                if tag == "a":
                    links += 1
                continue
            self._flush()
            links = 0
            if opened[-1][0] == "p" and tag != "p" or tag == "p":
                for k in range(len(opened) - 1, 0, -1):
                    if opened[k][0] == "p":
                        del opened[k:]
                        break
                    if opened[k][0] in LIMITS or opened[k][0] in ("li", "td", "th", "blockquote"):
                        break
            if tag in CLOSES:
                for k in range(len(opened) - 1, 0, -1):
                    if opened[k][0] in CLOSES[tag]:
                        del opened[k:]
                        if tag != "tbody" and tag != "tr":
                            break
                    elif opened[k][0] in LIMITS:
                        break
            if tag in ("html", "body") and any(t == tag for t, _ in opened):
                continue
            opened.append((tag, self._add(tag, self.attribute_bits(m["attrs"] or m["attrs2"] or ""))))
        self._flush()
        del self._open, self._text


class Forest:
    """Node arrays of several pages, with the sums over subtrees, level by level."""

    def __init__(self, pages: list[Page]):
        base = np.cumsum([0] + [len(p.parent) for p in pages])
        self.first = base[:-1]
        join = lambda xs, kind=np.int64: np.array([v for x in xs for v in x], kind)
        parent = join([p.parent for p in pages])
        shift = np.repeat(base[:-1], np.diff(base))
        self.parent = np.where(parent >= 0, parent + shift, -1)
        self.tag, self.bits, depth = join([p.tag for p in pages]), join([p.bits for p in pages]), join([p.depth for p in pages])
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []
        n = len(self.parent)
        self.chars, self.linked, self.marks, self.ends, self.children = (np.zeros(n) for _ in range(5))
        run = join([[b + i for i, _, _ in p.runs] for b, p in zip(base, pages)])
        texts = [t for p in pages for _, t, _ in p.runs]
        self.chars[run] = [len(t) for t in texts]
        self.linked[run] = [k for p in pages for _, _, k in p.runs]
        self.marks[run] = [t.count(".") + t.count(",") + t.count("!") + t.count("?") + t.count("。") for t in texts]
        self.ends[run] = [t[-1] in ".!?:…\"'”»)。" for t in texts]
        self.kind = np.full(n, 2)
        has_block = np.zeros(n, bool)
        inner = self.parent >= 0
        has_block[self.parent[inner & (self.tag != 0)]] = True
        self.kind[~has_block] = 1
        self.kind[self.tag == 0] = 0
        # What lies above a node: attribute words and sectioning tags of all its ancestors.
        self.above = np.zeros(n, np.int64)
        mine = self.bits | np.where(self.tag[:, None] == np.array(SECTIONS), 1 << (N_BITS + np.arange(len(SECTIONS))), 0).sum(axis=1)
        for level in self.levels[1:]:
            up = self.parent[level]
            self.above[level] = self.above[up] | mine[up]
        for level in self.levels[:0:-1]:
            up = self.parent[level]
            for x in (self.chars, self.linked, self.marks):
                np.add.at(x, up, x[level])
        np.add.at(self.children, self.parent[inner], 1)

    def features(self) -> np.ndarray:
        """Row numbers of the weights that apply to each node (n, k); -1 for none."""
        n, at = len(self.tag), 0
        cols = []

        def put(code, size, on=None):
            nonlocal at
            cols.append(np.where(on, code + at, -1) if on is not None else code + at)
            at += size

        put(self.tag, len(TAGS))
        put(np.where(self.parent >= 0, self.tag[self.parent], 1), len(TAGS))
        for b in range(N_BITS):
            put(np.zeros(n, np.int64), 1, (self.bits >> b) & 1 == 1)
        for b in range(N_BITS + len(SECTIONS)):
            put(np.zeros(n, np.int64), 1, (self.above >> b) & 1 == 1)
        # A header or form of the page and one of an article are told apart.
        within = lambda *tags: sum(((self.above >> (N_BITS + SECTIONS.index(TAG_ID[t]))) & 1) for t in tags) > 0
        for t in ("header", "form", "footer", "aside"):
            put((within("article", "main")).astype(np.int64), 2, within(t) | (self.tag == TAG_ID[t]))
        put(np.searchsorted(BINS, self.chars, "right"), len(BINS) + 1)
        share = self.linked / np.maximum(self.chars, 1)
        put(np.searchsorted([0.01, 0.35, 0.75], share, "right"), 4)
        put(np.minimum(self.marks, 2).astype(np.int64), 3)
        put(self.ends.astype(np.int64), 2, self.tag == 0)
        return np.stack(cols, axis=1)

    def messages(self, own: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Log odds of content of each node, by sum-product; pair is log potentials (kind, parent, child)."""
        total, up = own.copy(), np.zeros(len(own))
        p = pair[self.kind]
        for level in self.levels[:0:-1]:
            a, q = total[level], p[level]
            up[level] = np.logaddexp(q[:, 1, 0], q[:, 1, 1] + a) - np.logaddexp(q[:, 0, 0], q[:, 0, 1] + a)
            np.add.at(total, self.parent[level], up[level])
        belief = total.copy()
        for level in self.levels[1:]:
            a, q = belief[self.parent[level]] - up[level], p[level]
            belief[level] += np.logaddexp(q[:, 0, 1], q[:, 1, 1] + a) - np.logaddexp(q[:, 0, 0], q[:, 1, 0] + a)
        return belief


def training_pages(n: int = 1000, seed: int = 11) -> list[tuple[str, list[tuple[str, bool]]]]:
    """Pages with their text runs in order, each with its label."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeiou") + r.choice("bcdfghklmnprstvw") for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    out = []
    for _ in range(n):
        page, runs = [], []

        def sentence(a=3, b=14):
            return words(a, b).capitalize() + r.choice([".", ".", ".", "!", "?"])

        def say(text, label):
            runs.append((text, label))
            return text

        def attr(*names):
            return r.choice(["", f' class="{r.choice(names)}"', f' id="{r.choice(names)}"', f' class="{word()} {r.choice(names)}-{word()}"']) if r.random() < 0.3 else f' class="{r.choice(names)}"'

        def link_list(tag="ul"):
            return f"<{tag}>" + "".join(f'<li><a href="/{word()}">{say(words(1, 3), False)}</a></li>' for _ in range(r.randint(2, 8))) + f"</{tag}>"

        def noise_text(a=1, b=3):
            return " ".join(sentence() for _ in range(r.randint(a, b)))

        def nav():
            a = attr("nav", "menu", "navbar", "breadcrumbs", "main-menu", "pagination", "toc")
            return r.choice([f"<nav{r.choice(['', a])}>{link_list()}</nav>", f"<div{attr('nav', 'menu', 'navigation', 'breadcrumb')}>{link_list(r.choice(['ul', 'ol']))}</div>"])

        def advert():
            names = ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot")
            tag = r.choice(["div", "div", "aside", "section", "p"])
            return f"<{tag}{attr(*names) or ' class=ad'}>{say(noise_text(), False)}</{tag}>" if r.random() < 0.7 else f'<div class="{r.choice(names)}"><p>{say(noise_text(), False)}</p></div>'

        def notice():
            names = ("cookie-notice", "notice", "consent", "alert", "warning", "gdpr", "modal", "popup", "message", "info-box", "paywall")
            body = f"<p>{say(noise_text(), False)}</p>" if r.random() < 0.5 else say(noise_text(), False)
            return r.choice([f'<div class="{r.choice(names)}">{body}<button>{say(words(1, 2), False)}</button></div>', f'<div role="{r.choice(["alert", "dialog"])}">{body}</div>']) if r.random() < 0.5 else f'<div class="{r.choice(names)}">{body}</div>'

        def side():
            names = ("sidebar", "related", "widget", "popular", "rail", "recommended", "trending")
            body = f"<h3>{say(words(1, 4), False)}</h3>" + (link_list() if r.random() < 0.5 else "".join(f"<p>{say(noise_text(1, 2), False)}</p>" for _ in range(r.randint(1, 3))))
            tag = r.choice(["aside", "aside", "div", "section"])
            return f"<aside{r.choice(['', attr(*names)])}>{body}</aside>" if tag == "aside" else f'<{tag} class="{r.choice(names)}">{body}</{tag}>'

        def form():
            field = f"<div><label>{say(words(1, 2), False)}</label><input></div>"
            return f"<form{attr('search', 'newsletter', 'login', 'subscribe')}>{field}<p>{say(noise_text(1, 1), False)}</p><div><button>{say(words(1, 2), False)}</button></div></form>"

        def comments():
            names = ("comments", "comment-list", "discussion", "responses", "reader-comments", "disqus")
            body = f"<h3>{say(words(1, 3), False)}</h3>" if r.random() < 0.7 else ""
            for _ in range(r.randint(1, 5)):
                body += r.choice(["<div class=\"comment\">{}</div>", "<li>{}</li>", "<article class=\"comment\">{}</article>", "<div>{}</div>"]).format("".join(f"<p>{say(noise_text(1, 4), False)}</p>" for _ in range(r.randint(1, 2))))
            tag = r.choice(["section", "div", "ol", "ul"])
            return f'<{tag} {r.choice(["class", "id"])}="{r.choice(names)}">{body}</{tag}>'

        def share():
            return f'<div class="{r.choice(["share", "social", "follow-us", "tags", "byline", "meta", "author-box"])}">{say(words(1, 6), False)}</div>'

        def head():
            kind = r.randrange(5)
            if kind == 0:
                body = f'<div class="{r.choice(["logo", "site-title", "brand"])}">{say(words(1, 3), False)}</div>'
            elif kind == 1:
                body = f"<p>{say(words(2, 8), False)}</p>"
            elif kind < 4:
                body = f"<h1>{say(words(1, 3), False)}</h1>" + (f"<p>{say(noise_text(1, 1), False)}</p>" if kind == 3 else "")
            else:
                body = say(words(1, 6), False)
            return r.choice(["<header{}>{}</header>", "<header{}>{}</header>", '<div class="header">{1}</div>', '<div id="masthead">{1}</div>']).format(attr("site-header", "header", "top"), body + (nav() if r.random() < 0.4 else ""))

        def foot():
            body = "&copy; " + word()
            shown = "© " + body[7:]
            rest = " " + noise_text(0, 2) if r.random() < 0.7 else ""
            say((shown + rest).strip(), False)
            return r.choice(["<footer{}>{}</footer>", "<footer{}>{}</footer>", '<div class="footer">{1}</div>', '<div id="site-footer"><p>{1}</p></div>']).format(r.choice(["", attr("footer", "site-footer", "bottom")]), body + rest)

        def inline(text):
            x = text.split(" ")
            if len(x) > 3 and r.random() < 0.3:
                k = r.randrange(len(x))
                tag = r.choice(["b", "em", "strong", 'a href="/x"', "span", "code"])
                x[k] = f"<{tag}>{x[k]}</{tag.split()[0]}>"
            return " ".join(x)

        def extra():
            """Rarer parts of an article: links alone, sources, terms, formulas, notes."""
            link = lambda text: f'<a href="/{word()}">{text}</a>'
            kind = r.randrange(7)
            if kind == 0:
                return f"<p>{link(say(words(2, 9), True))}</p>"
            if kind == 1:
                n = r.choice("234")
                title = f"<h{n}>{say(words(1, 3), True)}</h{n}>"
                return title + "<ul>" + "".join(f"<li>{link(say(words(1, 8), True))}</li>" for _ in range(r.randint(1, 5))) + "</ul>"
            if kind == 2:
                return "<dl>" + "".join(f"<dt>{say(words(1, 2), True)}</dt><dd>{say(sentence(), True)}</dd>" for _ in range(r.randint(1, 3))) + "</dl>"
            if kind == 3:
                a, b, c = sentence(), word(), words(2, 6)
                say(f"{a} {b} {c}", True)
                return f"<p>{a} <math><mrow><mi>{b}</mi></mrow></math> {c}</p>"
            if kind == 4:
                return f"<{(tag := r.choice(['noscript', 'object']))}><p>{say(noise_text(), True)}</p></{tag}>"
            if kind == 5:
                return f'<section class="{r.choice(["footnotes", word(), word() + "-" + word()])}"><ol>' + "".join(f"<li>{say(words(2, 9), True)}</li>" for _ in range(r.randint(1, 3))) + "</ol></section>"
            return f'<div class="{r.choice([word(), "commentary", "football", "sidelines", "format-standard", "information"])}"><p>{say(noise_text(1, 4), True)}</p></div>'

        def paragraph():
            kind = r.random()
            if r.random() < 0.08:
                return extra()
            text = lambda a=1, b=6: say(" ".join(sentence(1, 16) for _ in range(r.randint(a, b))), True)
            if kind < 0.7:
                end = r.choice(["</p>", "</p>", "</p>", ""])
                return f"<p>{inline(text(1, r.choice([1, 2, 8])))}{end}"
            if kind < 0.78:
                tag = f"h{r.randint(2, 4)}"
                return f"<{tag}>{say(words(1, 6), True)}</{tag}>"
            if kind < 0.84:
                tag = r.choice(["ul", "ol"])
                return f"<{tag}>" + "".join(f"<li>{inline(say(words(1, 12), True))}</li>" for _ in range(r.randint(1, 5))) + f"</{tag}>"
            if kind < 0.88:
                return f"<blockquote><p>{text(1, 3)}</p></blockquote>"
            if kind < 0.91:
                return f"<pre>{say(words(3, 20), True)}</pre>"
            if kind < 0.94:
                return f"<figure><img><figcaption>{say(words(3, 10), True)}</figcaption></figure>"
            if kind < 0.97:
                return "<table>" + "".join("<tr>" + "".join(f"<td>{say(words(1, 3), True)}</td>" for _ in range(2)) + "</tr>" for _ in range(2)) + "</table>"
            return f"<div>{text(1, 4)}</div>"

        def article():
            body = f"<h1>{say(words(2, 12), True)}</h1>" if r.random() < 0.9 else ""
            if body and r.random() < 0.15:
                body = f"<header>{body}</header>"
            if r.random() < 0.15:
                body += share()
            for _ in range(r.choice([1, 2, 4, 8, 12])):
                body += paragraph()
                if r.random() < 0.12:
                    body += r.choice([advert, advert, side, notice, form, form])()
            if r.random() < 0.15:
                body += share()
            if r.random() < 0.15:
                body += comments()
            if r.random() < 0.05:
                body += f"<footer>{say(words(1, 6), False)}</footer>"
            kind = r.random()
            if kind < 0.55:
                return f"<article{r.choice(['', '', attr('post', 'article', 'entry', 'commentary', 'football', 'format-standard', word())])}>{body}</article>"
            if kind < 0.7:
                return f"<main{r.choice(['', attr('content', 'main')])}>{body}</main>"
            name = r.choice(["content", "article", "post", "main", "entry-content", "story", "article-body", "post-body", "text"])
            if kind < 0.95:
                return f"<div {r.choice(['class', 'id'])}=\"{name}\">{body}</div>"
            return f"<div><div>{body}</div></div>"

        parts = [x() for x in r.sample([nav, head, advert, notice, form], r.randint(1, 3))]
        wrap = r.random() < 0.3
        if r.random() < 0.2:
            parts.append(side())
        if r.random() < 0.08:
            parts.insert(0, f"<noscript>{say(noise_text(1, 1), False)}</noscript>")
        core = article()
        if r.random() < 0.2:
            core = f"<main>{core}" + (comments() if r.random() < 0.4 else "") + "</main>"
        parts.append(core)
        parts += [x() for x in r.sample([side, comments, advert, form, share, nav], r.randint(0, 2))]
        if r.random() < 0.85:
            parts.append(foot())
        body = "".join(f"<!-- {word()} -->" + x if r.random() < 0.1 else x for x in parts)
        if wrap:
            body = f'<div class="{r.choice(["wrapper", "page", "container", "layout"])}">{body}</div>'
        out.append((f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><script>var a='</p>';</script></head><body>{body}" + r.choice(["</body></html>", ""]), runs))
    return out


class Model:
    def __init__(self, weights: np.ndarray, bias: float, pair: np.ndarray):
        self.weights, self.bias, self.pair = weights, bias, pair

    def marginals(self, pages: list[Page]) -> list[np.ndarray]:
        """Probability of content of each page's nodes."""
        f = Forest(pages)
        own = np.append(self.weights, 0.0)[f.features()].sum(axis=1) + self.bias
        p = 1 / (1 + np.exp(-np.clip(f.messages(own, self.pair), -50, 50)))
        return np.split(p, f.first[1:])

    def texts(self, sources: list[str | None]) -> list[str]:
        pages = [Page(s or "") for s in sources]
        return ["\n".join(t for i, t, _ in p.runs if m[i] >= 0.5) for p, m in zip(pages, self.marginals(pages))] if pages else []


def train(samples=None, steps: int = 400, scale: float = 2.5) -> Model:
    """Unary weights by logistic regression and pair potentials by smoothed counts, from pages with labelled runs."""
    samples = training_pages() if samples is None else samples
    pages = [Page(s) for s, _ in samples]
    f = Forest(pages)
    on, both = np.zeros(len(f.tag)), np.zeros(len(f.tag))
    for b, p, (_, runs) in zip(f.first, pages, samples):
        left = [(" ".join(t.split()), y) for t, y in runs]
        at = 0
        for i, t, _ in p.runs:
            while at < len(left) and left[at][0] != t:
                at += 1
            if at == len(left):  # a run that joins several said texts
                y, at = any(k for s, k in left if s and s in t), 0
            else:
                y, at = left[at][1], at + 1
            both[b + i], on[b + i] = len(t), len(t) * y
    for level in f.levels[:0:-1]:
        np.add.at(both, f.parent[level], both[level])
        np.add.at(on, f.parent[level], on[level])
    y = (on > 0.5 * both).astype(float)
    used = both > 0
    x = f.features()[used]
    yy, w, bias = y[used], np.zeros(N_FEATURES + 1), 0.0
    m, s = np.zeros(len(w)), np.zeros(len(w))
    flat = np.where(x >= 0, x, N_FEATURES)
    for t in range(1, steps + 1):
        d = (1 / (1 + np.exp(-(w[flat].sum(axis=1) + bias))) - yy) / len(yy)
        g = np.bincount(flat.ravel(), np.repeat(d, flat.shape[1]), minlength=len(w)) + 5e-5 * w
        g[N_FEATURES] = 0
        m += 0.1 * (g - m)
        s += 0.01 * (g * g - s)
        w -= 0.1 * (1 - 0.8 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        bias -= 2 * d.sum()
    pair = np.zeros((KINDS, 2, 2))
    inner = used & (f.parent >= 0)
    for k in range(KINDS):
        child = np.flatnonzero(inner & (f.kind == k))
        n = np.ones((2, 2))
        np.add.at(n, (y[f.parent[child]].astype(int), y[child].astype(int)), 1)
        share = n / n.sum()
        pair[k] = np.log(share / np.outer(share.sum(axis=1), share.sum(axis=0)))
    return Model(w[:N_FEATURES] * scale, bias * scale, pair)


_model: list[Model] = []


def trained() -> Model:
    """The trained model, once per process."""
    if not _model:
        _model.append(train())
    return _model[0]


def extract(pages: DataFrame, model: Model | None = None, keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keys, text and n_chars of each row of pages."""
    model, types = model or trained(), dict(pages.dtypes)

    def make():
        def work(batch):
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = model.texts(part.column(len(keys)).to_pylist())
                yield {k: part.column(i) for i, k in enumerate(keys)} | {"text": texts, "n_chars": [len(t) for t in texts]}

        return work

    return map_batches(pages.select(*keys, F.col("html").alias("__html")), make, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", text string, n_chars bigint")


def op7_tree_model(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
