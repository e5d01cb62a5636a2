"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element of a page is a node with two states, content or not. A node's own potential is a weighted sum of
features (tag, class and id words, length and link share of its text ...); an edge to its parent has a potential for each
pair of states, by whether the child is a block of its own or a part of a list or table. Sum-product messages go from the
leaves up and back down, which gives each node's exact marginal. Weights are fitted by the gradient of the labelled
pages' likelihood, for which the same messages give the expectations. The labelled pages come from a rule: layouts of
sites with marked blocks, in many variants. Comments of readers that no class or id tells are known by what heads them,
by bylines, and by like blocks of a name and a text side by side; a lone comment with none of these stays in the text.
"""

from __future__ import annotations

import html
import math
import random
import re
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, text_or_empty

#: Fixed values of HTML: elements without content, whose content isn't text to read, that begin a block, and what an
#: opening tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
UNREAD = frozenset("script style template noscript head title textarea select option button object svg canvas iframe math audio video xmp noembed noframes datalist".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol optgroup p pre search section summary table caption colgroup tbody td tfoot th thead tr ul".split()
)
ITEMS = frozenset("li dd dt td th tr tbody thead tfoot caption figcaption summary".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCE = frozenset("table ul ol dl body html article section div aside nav main form".split())

TOKEN = re.compile(
    r"<(/?)([A-Za-z][^\s/>]*)(?:>|(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^<>]*(?:>|\Z))|<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SPACE = re.compile(r"\s+")
#: What heads readers' comments, what stands in a comment's byline, and words of address (four languages).
TALK = re.compile(
    r"(?:\d+ )?(?:(?:reader|user) )?(?:comments?|replies|kommentare?|leserkommentare|commentaires?|comentarios?)(?: ?\(\d+\))?:?|"
    r"\d+ (?:responses?|reactions?|thoughts on .*|antworten|reaktionen|meinungen|réponses?|réactions?|respuestas?|opiniones)|"
    r"(?:leave|post|add|write) a (?:comment|reply)|join the (?:discussion|conversation)|what (?:our )?(?:readers|people|others) (?:say|think)|"
    r"comments? (?:on|from|by) .*|(?:das sagen|meinungen) unsere[r]? leser|avis des lecteurs|opiniones de (?:los )?lectores",
    re.I,
)
BYLINE = re.compile(
    r"\b\d+ ?(?:s|min|h|d|seconds?|minutes?|hours?|days?|weeks?|months?|years?) ago\b|\b(?:vor|hace|il y a) \d+ \w+|\b\d{1,2}:\d\d\b|\b\d{4}-\d\d-\d\d\b|"
    r"\b(?:says|said|wrote|writes|schrieb|schreibt|sagt|a écrit|dit|escribió|dice) ?:?$|\b(?:reply|antworten|répondre|responder)$|^@\w+",
    re.I,
)
SPOKEN = re.compile(r"@?\w[\w.-]*(?: \w[\w.-]*){0,2},? (?:says|said|wrote|writes|schrieb|schreibt|sagt|a écrit|dit|escribió|dice|\(?\d+ ?(?:min|h|d|minutes?|hours?|days?|weeks?|months?|years?) ago\)?) ?: ", re.I)
PERSON = re.compile(r"\b(?:i|i'm|i've|my|me|you|your|thanks|ich|mein|meine|danke|je|j'ai|mon|merci|yo|mi|gracias)\b", re.I)
HEADS = frozenset("h1 h2 h3 h4 h5 h6 dt th summary caption figcaption legend".split())
CLOSERS = {name: re.compile(f"</{name}(?=[\\s/>])|\\Z", re.I) for name in RAW}


@dataclass
class Node:
    tag: str
    parent: int
    attributes: str = ""
    chars: int = 0
    link_chars: int = 0
    links: int = 0
    stops: int = 0
    children: int = 0
    talk: bool = False
    said: bool = False
    person: bool = False


@dataclass
class Page:
    """Block elements in page order (node 0 is the page), and blocks of text with the node that holds each."""

    nodes: list[Node] = field(default_factory=lambda: [Node("#page", -1)])
    blocks: list[tuple[int, str]] = field(default_factory=list)


def parse(text: str) -> Page:
    """Reads any text as HTML: unclosed, crossed and cut-off tags are put right in the usual way."""
    page = Page()
    stack: list[tuple[str, int]] = [("#page", 0)]  # open elements, with the block node each belongs to
    count: dict[str, int] = {}  # of open elements by tag
    pieces: list[str] = []
    unread = links = 0

    def flush() -> None:
        if pieces:
            block = SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            pieces.clear()
            if block:
                node = stack[-1][1]
                page.blocks.append((node, block))
                page.nodes[node].chars += len(block)
                page.nodes[node].stops += block.count(". ") + block.count(", ") + block.endswith(".")
                page.nodes[node].talk |= len(block) <= 80 and TALK.fullmatch(block) is not None
                page.nodes[node].said |= (len(block) <= 80 and BYLINE.search(block) is not None) or SPOKEN.match(block) is not None
                page.nodes[node].person |= len(block) <= 1000 and PERSON.search(block) is not None

    def pop() -> None:
        nonlocal unread, links
        tag, _ = stack[-1]
        if tag in BLOCK:
            flush()
        unread -= tag in UNREAD
        links -= tag == "a"
        count[tag] -= 1
        stack.pop()

    def close(names: tuple[str, ...], fence: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                while len(stack) > k:
                    pop()
                return
            if stack[k][0] in fence:
                return

    def say(s: str) -> None:
        if s and not unread:
            pieces.append(s)
            if links:
                page.nodes[stack[-1][1]].link_chars += len(s)

    at = 0
    while m := TOKEN.search(text, at):
        say(text[at : m.start()])
        token, at, name = m[0], m.end(), m[2]
        if name is None:
            if token.startswith("<![CDATA["):
                say(html.escape(token[9:].removesuffix("]]>"), quote=False))
            continue
        name = name.lower()
        if m[1]:
            if count.get(name):
                if stack[-1][0] == name:
                    pop()
                    continue
                close((name,), frozenset() if name in BLOCK or name in UNREAD else FENCE)
            elif name == "p":
                flush()
            continue
        if name == "br":
            say(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in BLOCK:
            if count.get("p"):
                close(("p",), FENCE - {"p"})
            flush()
        if name in CLOSES:
            close(CLOSES[name], FENCE)
        node = stack[-1][1]
        if name in BLOCK and not unread:
            page.nodes[node].children += 1
            page.nodes.append(Node(name, node, token))
            node = len(page.nodes) - 1
        if token.endswith("/>") and name not in BLOCK:
            continue
        if name == "a":
            page.nodes[node].links += 1
        stack.append((name, node))
        count[name] = count.get(name, 0) + 1
        unread += name in UNREAD
        links += name == "a"
        if name in CLOSERS:
            at = CLOSERS[name].search(text, at).start()
    say(text[at:])
    while len(stack) > 1:
        pop()
    flush()
    return page


def attribute_words(token: str) -> list[str]:
    words = []
    for name, *values in ATTRIBUTE.findall(token):
        if name.lower() in ("class", "id", "role", "aria-label", "itemprop"):
            words += [w.lower() for w in PART.findall("".join(values))]
    return words


def talk_of(page: Page) -> tuple[list[int], list[int]]:
    """What tells comments without marks: whether a node is a heading of comments (1), holds such a heading first (2) or
    follows one (3); and the number, up to 3, of like siblings that are each a byline or name with a text (also for what is
    inside them), or 4 for a node that holds three or more of them.
    """
    nodes = page.nodes
    n = len(nodes)
    parts, said, opens, first = [0] * n, [x.said for x in nodes], [x.talk for x in nodes], [-1] * n
    for i, (k, _) in enumerate(page.blocks):
        parts[k] += 1
        while k >= 0 and first[k] < 0:
            first[k] = i
            k = nodes[k].parent
    for k in range(n - 1, 0, -1):
        p = nodes[k].parent
        parts[p] += parts[k]
        said[p] |= said[k]
        opens[p] |= opens[k] and first[k] == first[p]
    groups: dict[tuple[int, str], int] = {}
    alike = [False] * n
    for k in range(1, n):
        tag = nodes[k].tag
        if first[k] < 0 or tag in HEADS:
            continue
        holder, opening = page.blocks[first[k]]
        named = parts[k] in (2, 3, 4) and len(opening) <= 40 and opening[-1] not in ".!?:" and nodes[holder].tag not in HEADS and not nodes[holder].links
        alike[k] = nodes[k].said or (tag in ("div", "li", "section", "article", "blockquote", "dd") and (named or (said[k] and parts[k] <= 6)))
        if alike[k]:
            at = (nodes[k].parent, tag)
            groups[at] = groups.get(at, 0) + 1
    most: dict[int, int] = {}
    for (p, _), c in groups.items():
        most[p] = max(most.get(p, 0), c)
    talk, like = [0] * n, [0] * n
    after, told = [False] * n, [False] * n  # of the children so far: a heading of comments came last; a byline alone came last
    for k in range(1, n):
        p = nodes[k].parent
        if opens[k]:
            talk[k] = 1 if nodes[k].talk else 2
            after[p] = True
        elif nodes[k].tag in ("h1", "h2", "h3") or nodes[k].tag == "footer":
            after[p] = False
        elif after[p] or talk[p] in (2, 3):
            talk[k] = 3
        own = min(groups[p, nodes[k].tag], 3) if alike[k] else min(groups.get((p, nodes[k].tag), 0), 3) if told[p] else 0
        told[p] = nodes[k].said and parts[k] == 1 and nodes[k].chars <= 80
        like[k] = max(own, like[p] if like[p] < 4 else 0) or (4 if most.get(k, 0) >= 3 else 0)
    return talk, like


def node_keys(page: Page) -> list[tuple]:
    """What a node's features follow from: tag, parent's tag, size, link share, share of the page and of what is before, stops, own text, talk, attributes."""
    nodes = page.nodes
    chars, linked, stops = [n.chars for n in nodes], [n.link_chars for n in nodes], [n.stops for n in nodes]
    for k in range(len(nodes) - 1, 0, -1):
        p = nodes[k].parent
        chars[p] += chars[k]
        linked[p] += linked[k]
        stops[p] += stops[k]
    whole = max(chars[0], 1)
    before, done = [0] * len(nodes), 0
    for k, n in enumerate(nodes):
        before[k] = done
        done += n.chars
    talk, like = talk_of(page)
    return [
        (n.tag, nodes[n.parent].tag if n.parent >= 0 else "", min((c + 1).bit_length() - 1, 9), min(4 * i // c, 3) if c else 0, min(4 * c // whole, 3), min(4 * b // whole, 3), min(s, 3), n.chars > 0, n.children > 0, t, a, n.said, n.person, n.attributes if len(n.attributes) > len(n.tag) + 2 else "")
        for n, c, i, s, b, t, a in zip(nodes, chars, linked, stops, before, talk, like, strict=True)
    ]


def features_of(key: tuple) -> list[str]:
    """Names of the features that hold for a node."""
    tag, above, size, linked, share, before, stops, own, nested, talk, like, said, person, attributes = key
    f = ["bias", f"tag {tag}", f"size {size}", f"linked {linked}", f"share {share}", f"stops {stops}", f"own {own}{nested}", f"below {above}"]
    f += [f"talk {talk}"] * (talk > 0) + [f"like {like}", f"like {like} after {before}"] * (like > 0) + ["said"] * said + [f"person {like > 1}"] * person
    return f + sorted({f"word {w}" for w in attribute_words(attributes)}) if attributes else f


def edge_kind(n: Node) -> int:
    return int(n.tag in ITEMS)


def _lse(a: float, b: float) -> float:
    m = a if a > b else b
    return m + math.log1p(math.exp(-abs(a - b)))


@dataclass
class TreeModel:
    weights: dict[str, float]
    #: [kind of edge][state of parent][state of child]
    edges: list[list[list[float]]]
    known: dict[tuple, float] = field(default_factory=dict)

    def unary(self, keys: list[tuple]) -> list[float]:
        out = []
        for key in keys:
            u = self.known.get(key)
            if u is None:
                if len(self.known) > 100_000:
                    self.known.clear()
                u = self.known[key] = sum(self.weights.get(x, 0.0) for x in features_of(key))
            out.append(u)
        return out

    def marginals(self, page: Page, u: list[float], with_edges: bool = True) -> tuple[list[float], list[tuple[float, float, float, float]]]:
        """P(content) of each node, and P(parent state, child state) of each edge, by messages up and then down."""
        nodes = page.nodes
        n = len(nodes)
        up0, up1 = [0.0] * n, u[:]  # a node's own potential and the messages of its children
        m0, m1 = [0.0] * n, [0.0] * n
        for k in range(n - 1, 0, -1):
            e = self.edges[edge_kind(nodes[k])]
            m0[k], m1[k] = (_lse(e[p][0] + up0[k], e[p][1] + up1[k]) for p in (0, 1))
            up0[nodes[k].parent] += m0[k]
            up1[nodes[k].parent] += m1[k]
        down0, down1 = [0.0] * n, [0.0] * n
        z = _lse(up0[0], up1[0])
        out, pairs = [math.exp(up1[0] - z)], [(0.0, 0.0, 0.0, 0.0)]
        for k in range(1, n):
            p, e = nodes[k].parent, self.edges[edge_kind(nodes[k])]
            rest0, rest1 = up0[p] - m0[k] + down0[p], up1[p] - m1[k] + down1[p]
            down0[k], down1[k] = (_lse(rest0 + e[0][c], rest1 + e[1][c]) for c in (0, 1))
            out.append(math.exp(up1[k] + down1[k] - z))
            if with_edges:
                pairs.append(tuple(math.exp(r + e[p_][c] + s - z) for p_, r in ((0, rest0), (1, rest1)) for c, s in ((0, up0[k]), (1, up1[k]))))
        return out, pairs

    def extract(self, text: str, cut: float = 0.5) -> str:
        page = parse(text)
        if not page.blocks:
            return ""
        p, _ = self.marginals(page, self.unary(node_keys(page)), False)
        return "\n".join(block for node, block in page.blocks if p[node] >= cut)


def fit(pages: list[tuple[Page, list[int]]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-3) -> TreeModel:
    """Gradient steps (scaled for each weight by its past gradients) on the log-likelihood of the node labels."""
    model = TreeModel({}, [[[0.0, 0.0], [0.0, 0.0]] for _ in range(2)])
    past: dict = {}
    prepared = [(page, [features_of(key) for key in node_keys(page)], labels) for page, labels in pages]
    order = random.Random(1)
    for _ in range(rounds):
        order.shuffle(prepared)
        for page, features, labels in prepared:
            p, pairs = model.marginals(page, [sum(model.weights.get(x, 0.0) for x in f) for f in features])
            slope: dict = {}
            for k, (f, y) in enumerate(zip(features, labels, strict=True)):
                for x in f:
                    slope[x] = slope.get(x, 0.0) + y - p[k]
                if k:
                    kind, above = edge_kind(page.nodes[k]), labels[page.nodes[k].parent]
                    for s in range(4):
                        at = (kind, s >> 1, s & 1)
                        slope[at] = slope.get(at, 0.0) + ((s >> 1, s & 1) == (above, y)) - pairs[k][s]
            for x, g in slope.items():
                if isinstance(x, str):
                    g -= decay * model.weights.get(x, 0.0)
                past[x] = past.get(x, 1e-6) + g * g
                step = rate * g / math.sqrt(past[x])
                if isinstance(x, str):
                    model.weights[x] = model.weights.get(x, 0.0) + step
                else:
                    model.edges[x[0]][x[1]][x[2]] += step
    return model


def labelled_page(seed: int) -> tuple[str, str]:
    """(html, main text) of a made-up page. Content is marked by data-y="1", other blocks by data-y="0"."""
    r = random.Random(seed)
    y = lambda v: f' data-y="{v}"'
    word = lambda: "".join(r.choice("bdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))

    def sentence(a: int = 4, b: int = 18) -> str:
        s = words(a, b).split()
        for k in range(2, len(s) - 1, 5):
            s[k] += r.choice([",", "", "", "&amp;"])
        return " ".join(s).capitalize() + r.choice(". . . ! ?".split())

    body: list[str] = []
    texts: list[str] = []
    close = lambda tag: "" if tag in ("p", "li") and r.random() < 0.15 else f"</{tag}>"

    def content(tag: str, inner: str) -> str:
        texts.append(SPACE.sub(" ", html.unescape(re.sub(r"<[^>]+>", lambda m: " " if m[0] == "<br>" else "", inner))).strip())
        return f"<{tag}{y(1)}>{inner}{close(tag)}"

    def paragraph() -> str:
        s = " ".join(sentence() for _ in range(r.choice([1, 1, 2, 3, 5, 9])))
        if r.random() < 0.25:
            s = words(1, 3) + r.choice([".", ""])
        if r.random() < 0.15:
            s = r.choice(["I ", "My ", "You ", "Thanks, "]) + s
        if r.random() < 0.25:
            s = f"<b>{s}<br>"
        elif r.random() < 0.3:
            s = s.replace(" ", f' <a href="/{word()}">{word()}</a> ', 1)
        return content("p", s)

    def link_list(n: int) -> str:
        return "<ul" + y(0) + ">" + "".join(f'<li{y(0)}><a href="/{word()}">{words(1, 3)}</a>{close("li")}' for _ in range(n)) + "</ul>"

    def boiler(kind: str) -> str:
        names = {
            "nav": ["nav", "menu", "navbar", "navigation", "topnav", "breadcrumb", "breadcrumbs", "main-menu"], "header": ["header", "masthead", "site-header", "banner", "topbar", "page-header"],
            "footer": ["footer", "site-footer", "bottom", "copyright", "colophon", "legal"], "aside": ["sidebar", "aside", "related", "widget", "side-bar", "recommended", "popular", "trending", "rail"],
            "notice": ["notice", "cookie-banner", "cookie", "consent", "alert", "gdpr", "popup", "modal", "disclaimer"], "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "promo", "banner-ad", "sponsored", "promoted"],
            "form": ["newsletter", "subscribe", "signup", "search-form", "login", "search"], "comments": ["comments", "comment-list", "discussion", "responses", "replies", "disqus", "reader-comments"], "share": ["share", "social", "share-bar", "tags", "pagination", "author-box", "toolbar"],
        }[kind]
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}.get(kind, "div") if r.random() < 0.6 else r.choice(["div", "section", "div"])
        mark = f' {r.choice(["class", "class", "id"])}="{r.choice(names)}"' if tag in ("div", "section") or r.random() < 0.4 else ""
        if kind == "nav":
            inner = link_list(r.randint(2, 9))
        elif kind == "header":
            inner = r.choice([f"<h1{y(0)}>{words(1, 3)}</h1>", f'<a href="/">{words(1, 2)}</a>', f"<p{y(0)}>{words(2, 6)}</p>"]) + (f"<nav{y(0)}>{link_list(3)}</nav>" if r.random() < 0.4 else "")
        elif kind == "footer":
            inner = r.choice([f"&copy; {word()}.example.com &middot; {sentence()}", f"<p{y(0)}>&copy; 20{r.randint(10, 25)} {words(1, 3)}. {sentence(3, 9)}</p>", link_list(4) + f"<p{y(0)}>{words(2, 5)}</p>"])
        elif kind == "aside":
            inner = f"<h3{y(0)}>{words(1, 3)}</h3>" + r.choice([link_list(4), f"<p{y(0)}>{sentence()} {sentence()}</p>", sentence()])
        elif kind == "comments":
            inner = f"<h3{y(0)}>{r.randint(1, 40)} {words(1, 2)}</h3>" * (r.random() < 0.7) + "".join(r.choice([f'<div class="comment"{y(0)}><p{y(0)}>{sentence()} {sentence()}</p></div>', f'<p class="comment"{y(0)}>{sentence()}</p>', f'<li class="comment"{y(0)}>{sentence()}</li>']) for _ in range(r.randint(1, 5)))
        elif kind == "form":
            inner = f"<p{y(0)}>{sentence()}</p>" * (r.random() < 0.6) + f'<label>{words(1, 2)}</label><input name="q"><button>{word()}</button>'
        elif kind == "share":
            inner = " ".join(f'<a href="/{word()}">{word()}</a>' for _ in range(4))
        else:
            inner = r.choice([sentence(), f"<p{y(0)}>{sentence()}</p>", f'{sentence()} <a href="/{word()}">{words(1, 3)}</a>', f"<p{y(0)}>{sentence()} {sentence()} {sentence()}</p>"])
        return f"<{tag}{mark}{y(0)}>{inner}</{tag}>"

    def comments() -> str:
        """Comments of readers that no class or id marks."""
        name = lambda: " ".join(word().capitalize() for _ in range(r.choice([1, 1, 2])))
        when = lambda: r.choice([f"{r.randint(2, 40)} {r.choice(['minutes', 'hours', 'days', 'months'])} ago", f"vor {r.randint(2, 20)} Tagen", f"20{r.randint(10, 25)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}", f"{r.randint(1, 23)}:{r.randint(10, 59)}"])
        says = lambda: r.choice(["says", "wrote", "writes", "schrieb", "a écrit", "dice"])
        p = lambda s: f"<p{y(0)}>{s}</p>"

        def remark() -> str:
            s = " ".join(sentence(3, 14) for _ in range(r.choice([1, 1, 2, 3])))
            return r.choice(["I ", "Thanks, ", "My ", "You ", "", "", ""]) + s

        style, n = r.choice([0, 1, 2, 3, 4, 5, 6, 7, 7, 7]), r.randint(1, 6)
        head = r.choice([f"{r.randint(1, 40)} comments", "Comments", f"Comments ({n})", "Leave a comment", f"{n} responses", "Kommentare", "Commentaires", "Comentarios", "Join the discussion", "What readers say", "Reader comments"])
        headed = r.random() < 0.6 or style == 7
        n = n if headed else max(n, 2)
        t = r.choice(["h2", "h3", "h4", "p", "div"])
        out = f"<{t}{y(0)}>{head}</{t}>" if headed else ""
        item = r.choice(["div", "div", "li", "section"]) if style < 4 else "div"
        for _ in range(n):
            if style == 0:
                out += f"<{item}{y(0)}><b>{name()}</b>{p(remark())}</{item}>"
            elif style == 1:
                out += f"<{item}{y(0)}>{p(name() + r.choice([' · ', ', ', ' ']) + when())}{p(remark())}</{item}>"
            elif style == 2:
                out += f"<{item}{y(0)}>{p(name())}{p(remark())}" + '<a href="#">Reply</a>' * (r.random() < 0.5) + f"</{item}>"
            elif style == 3:
                out += f"<{item}{y(0)}><b>{name()}</b> {says()}: {remark()}</{item}>"
            elif style == 4:
                out += p(f"<b>{name()}</b> {says()}:") + p(remark())
            elif style == 5:
                out += p(f"{name()} ({when()}): {remark()}")
            elif style == 6:
                out += f"<div{y(0)}>{p(remark())}{p(name() + ', ' + when())}</div>"
            else:
                out += p(remark())
        box = "ul" if item == "li" else r.choice(["div", "div", "section", "", "ol"]) if style < 4 and item != "section" else r.choice(["div", "section", ""])
        box = box if box != "ol" else "div"
        return f"<{box}{y(0)}>{out}</{box}>" if box else out

    for kind in ("header", "nav", "notice", "ad"):
        if r.random() < 0.55:
            body.append(boiler(kind))
    r.shuffle(body)
    head = f"<h1{y(1)}>{words(3, 10)}{r.choice(['.', '', ''])}</h1>"
    article: list[str] = []
    if r.random() < 0.8:
        texts.append(SPACE.sub(" ", re.sub(r"<[^>]+>", "", head)).strip())
        article.append(f"<header{y(1)}>{head}</header>" if r.random() < 0.15 else head)
    if r.random() < 0.08:
        article.append(content("p", f"{words(1, 2).title()}, {r.randint(2, 20)} days ago"))
    for _ in range(r.randint(0, 9)):
        roll = r.random()
        if roll < 0.7:
            article.append(paragraph())
        elif roll < 0.78:
            article.append(content(r.choice(["h2", "h3"]), words(1, 6)))
        elif roll < 0.86:
            article.append("<ul" + y(1) + ">" + "".join(content("li", sentence(2, 9)) for _ in range(r.randint(2, 5))) + "</ul>")
        elif roll < 0.88:
            article.append(f"<div{y(1)}>" + (content("h3", words(1, 4)) if r.random() < 0.5 else "") + "".join(paragraph() for _ in range(r.randint(1, 3))) + "</div>")
        elif roll < 0.89:
            article.append("<ul" + y(1) + ">" + "".join(content("li", f"<b>{words(1, 2).capitalize()}</b>: {sentence()}") for _ in range(r.randint(2, 5))) + "</ul>")
        elif roll < 0.9:
            article.append(content("blockquote", sentence()))
        elif roll < 0.93:
            article.append(f"<table{y(1)}><tr{y(1)}>" + "".join(content("td", words(1, 4)) for _ in range(3)) + "</tr></table>")
        else:
            article.append(boiler(r.choice(["ad", "share", "aside", "form", "notice"])))
    roll = r.random()
    if roll < 0.2:
        article.append(boiler("comments"))
    elif roll < 0.4:
        article.append(comments())
    tag = r.choice(["article", "article", "main", "div", "section"])
    mark = f' class="{r.choice(["content", "post", "entry-content", "article-body", "story", "main", "post-content", "text"])}"' if tag in ("div", "section") or r.random() < 0.3 else ""
    body.append(f"<{tag}{mark}{y(1)}>" + "".join(article) + f"</{tag}>")
    for kind in ("aside", "comments", "form", "share", "ad", "notice", "footer"):
        if r.random() < (0.7 if kind == "footer" else 0.3):
            body.append(comments() if kind == "comments" and r.random() < 0.6 else boiler(kind))
    inner = "".join(body)
    if r.random() < 0.4:
        inner = f'<div class="{r.choice(["wrapper", "container", "page", "row", "layout"])}"{y(1)}>{inner}</div>'
    return f'<!DOCTYPE html><html{y(1)}><head><meta charset="utf-8"><title>{words(2, 5)}</title><style>p{{margin:0}}</style></head><body{y(1)}>{inner}<script>var t="</p>";</script></body></html>', "\n".join(t for t in texts if t)


def labels_of(page: Page) -> list[int]:
    """Marks of the made-up pages; a node without one is as its parent."""
    out = [1]
    for n in page.nodes[1:]:
        m = re.search(r'data-y="([01])"', n.attributes)
        out.append(int(m[1]) if m else out[n.parent])
    return out


@lru_cache(4)
def trained(pages: int = 1000, seed: int = 0) -> TreeModel:
    parsed = [parse(labelled_page(seed + k)[0]) for k in range(pages)]
    return fit([(p, labels_of(p)) for p in parsed])


def extract_pages(pages: DataFrame, model: TreeModel | None = None, *, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per row of pages: id, the columns named in keep, text, n_chars (code points of the text).

    The whole html is read; null and empty ones, and pages without content, give an empty text. Blocks are in page order
    with one line feed between them, white space inside a block is one space, references are decoded. Other columns are
    not read.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model or trained())  # a few hundred weights
    fields = [f for f in pages.select(id_col, *keep).schema.fields]

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [sent.value.extract(h) for h in b.column(b.num_columns - 1).to_pylist()]
        return pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*(f.name for f in fields), "text", "n_chars"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["text string", "n_chars bigint"])
    return arrow_map(pages.select(id_col, *keep, text_or_empty(html_col).alias("_html")), one, schema, batch_bytes=4 << 20)
