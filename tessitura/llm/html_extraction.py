"""Main-text extraction: a linear-chain conditional random field over a page's leaf blocks.

A page is walked once, tag by tag, with a stack of open elements. Text between block-level tags is a leaf block; its
features are its ancestors' tags and the words of their class, id and role attributes, its own element, length, link
density, punctuation and neighbourhood on the page. The field has the two labels article and furniture, is trained
on labelled pages (``labelled_pages``: layouts drawn from a seed, whose labels are known as they are made) by gradient
ascent on the conditional likelihood, and is decoded by Viterbi. Blocks labelled article are joined in page order. A
page in which no element has a telling name is judged by features of its own kind: what its blocks say, their elements
and their neighbours. A quarter of the training pages is made so. Names that no training page had say nothing, and neither do
furniture's names around a page's whole body (a form around everything). Where the likeliest labels leave a page empty that
has an article element or long prose outside of furniture, the likeliest labels with such a block in the article hold.

Text: scripts, styles, markup and what only holds controls are never blocks; character references are decoded, white
space (line breaks included) becomes one space, ends are trimmed. Cases: null, empty and blank html give an empty text;
unclosed and stray tags are met as browsers do roughly (a stray end tag is ignored, an element ends with its parent, an
open head ends at text or at the first tag that can't be in it; quotes open a string only behind ``=``); a cut tag at the end is dropped; repeated rows give their row again; very long pages are walked whole, in linear time;
null urls stay null; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_slices

# Element kinds of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead tr ul head title".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is no text of the page. The first four hold raw text, which ends at their own end tag only.
RAW_TAGS = frozenset(("script", "style", "textarea", "title"))
SILENT_TAGS = RAW_TAGS | frozenset("head noscript template svg math iframe object canvas audio video select button datalist".split())
#: An element of the key's kind ends at the start of any of these, if it is open inside the same container.
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"},
}
CONTAINERS = frozenset("ul ol menu dl table tbody thead tfoot body html div section article main".split())

#: Start tags that may stand in an open head; any other one, or text, ends it.
HEAD_TAGS = frozenset("html head title meta link script style base basefont bgsound noscript template noframes".split())
#: Elements that an implied end looks for; containers stop that search.
IMPLIED = frozenset(CLOSED_BY) | {"p"}

#: Comments, declarations and tags; quotes open a string only behind ``=``. Every part is possessive and ends with the page at
#: the latest, so that the whole page is read once, whatever is left open in it.
TOKEN = re.compile(r"""<!--(?:.*?-->|.*+)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>\x00]*+)((?:[^>=]|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)(?:>|\Z)""", re.S)
NAMED = re.compile(r"""(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++)))?""", re.I)
PARTS = re.compile(r"[a-z]+|[0-9]+")
#: Words that furniture's own texts hold, in blocks of ``SHORT`` characters at most.
SHORT = 240
SAYS = frozenset(
    "cookie cookies consent privacy terms subscribe newsletter copyright reserved rights login sign register menu home contact about "
    "share tweet comment comments reply replies responses advertisement sponsored promoted related popular trending search navigation "
    "skip follow imprint impressum datenschutz anmelden suche kommentare mentions accueil commentaires recherche inicio buscar comentarios "
    "aviso accept agree close read more".split()
)
SPOKEN_WORD = re.compile(r"[^\W\d_]+")


#: Cues that say nothing about a page's layout.
PLAIN_CUES = frozenset(f"<{t}>" for t in "h1 h2 h3 h4 h5 h6 ul ol li table tbody tr td th pre blockquote figure figcaption hr dl dt dd label center".split())


#: Parts of names, and elements, that stand for furniture.
FURNITURE_CUES = frozenset(
    "<nav> <header> <footer> <aside> <form> nav navbar menu breadcrumb breadcrumbs footer sidebar widget cookie consent modal popup newsletter "
    "ad ads advert advertisement sponsored promo form search login signup comment comments reply replies responses hidden".split()
)
#: Characters from which a sentence outside of furniture can be a page's whole article.
PROSE = 100


class Block:
    """A leaf block: its text, the share of it inside links, its element and the cues of its ancestors."""

    __slots__ = ("text", "linked", "tag", "cues")

    def __init__(self, text: str, linked: int, tag: str, cues: tuple[str, ...]):
        self.text, self.linked, self.tag, self.cues = text, linked, tag, cues


def _cues(tag: str, attributes: str) -> tuple[str, ...]:
    found = {f"<{tag}>"} if tag in BLOCK_TAGS and tag not in ("html", "body", "div", "p") else set()
    if attributes and not attributes.isspace():
        for m in NAMED.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                found.add("hidden")
            elif name in ("class", "id", "role"):
                found.update(PARTS.findall(value))
    return tuple(found)


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks of a page, in order. Linear in the page's length, whatever its nesting."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    active: dict[str, int] = {}  # cues of the open elements, counted
    opened: dict[str, int] = {}  # open elements by tag, counted
    inside: list[str] = []  # open block elements
    marks: list[tuple[int, str]] = []  # places in the stack of containers and of what can end by implication
    parts: list[str] = []
    linked = silent = 0
    cached: tuple[str, ...] | None = ()

    def push(tag: str, attributes: str) -> None:
        nonlocal silent, cached
        cues = _cues(tag, attributes)
        if tag in CONTAINERS or tag in IMPLIED:
            marks.append((len(stack), tag))
        if tag in BLOCK_TAGS:
            inside.append(tag)
        stack.append((tag, cues))
        opened[tag] = opened.get(tag, 0) + 1
        silent += tag in SILENT_TAGS
        for cue in cues:
            active[cue] = active.get(cue, 0) + 1
        cached = None if cues else cached

    def pop() -> None:
        nonlocal silent, cached
        tag, cues = stack.pop()
        if marks and marks[-1][0] == len(stack):
            marks.pop()
        if tag in BLOCK_TAGS:
            inside.pop()
        opened[tag] -= 1
        silent -= tag in SILENT_TAGS
        for cue in cues:
            active[cue] -= 1
            if not active[cue]:
                del active[cue]
        cached = None if cues else cached

    def flush() -> None:
        nonlocal linked, parts, cached
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                if cached is None:
                    cached = tuple(active)
                out.append(Block(text, linked, inside[-1] if inside else "body", cached))
            parts, linked = [], 0

    def end(names: set[str]) -> None:
        """End the innermost open element of these names, unless a container is open inside it."""
        for place, tag in reversed(marks):
            if tag in names:
                while len(stack) > place:
                    pop()
                return
            if tag in CONTAINERS:
                return

    def end_head() -> None:
        while opened.get("head"):
            pop()

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        stop = m.start() if m else size
        if stop > at:
            text = page[at:stop] if m else page[at:].removesuffix("/").removesuffix("<") if page.endswith(("<", "</")) else page[at:]
            if silent and stack[-1][0] == "head" and not text.isspace():
                end_head()
            if not silent:
                parts.append(text)
                if opened.get("a"):
                    linked += len(text.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag == "br":
            parts.append("\n") if not silent else None
            continue
        if tag in BLOCK_TAGS:
            flush()
        if m[1]:
            if opened.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in VOID_TAGS:
            continue
        if opened.get("head") and tag not in HEAD_TAGS and stack[-1][0] == "head":
            end_head()
        if tag in BLOCK_TAGS and opened.get("p") and tag != "body":
            end({"p"})  # a block ends an open paragraph of its own container
        for name, enders in CLOSED_BY.items():
            if tag in enders and opened.get(name):
                end({name})
        if m[3].endswith("/") and tag in ("svg", "math", "path"):
            continue
        push(tag, m[3])
        if tag in RAW_TAGS:
            ending = re.compile(rf"</{tag}\b[^>]*+(?:>|\Z)", re.I).search(page, at)
            at = ending.end() if ending else size
            pop()
    flush()
    return out


def _silent_cues(blocks: list[Block], known: frozenset[str] | None) -> set[str]:
    """Cues that say nothing on this page: those that no training page had, and furniture's names around the page's own body.

    A form, say, around most of the text and around the first heading is how the page is built, not a form in it.
    """
    covered: dict[str, int] = {}
    for b in blocks:
        for c in b.cues:
            covered[c] = covered.get(c, 0) + len(b.text)
    total = sum(len(b.text) for b in blocks)
    first = next((b for b in blocks if b.tag == "h1"), None)
    around = {c for c, n in covered.items() if c in FURNITURE_CUES and n >= (0.6 if first else 0.9) * total and (first is None or c in first.cues)}
    return around | ({c for c in covered if c not in known} if known is not None else set())


def features(blocks: list[Block], known: frozenset[str] | None = None) -> list[list[str]]:
    """Names of the features that hold for each block; ``known`` are the cues that a trained field has seen (None: all)."""
    out, n, shared = [], len(blocks), {}
    if silent := _silent_cues(blocks, known):
        blocks = [Block(b.text, b.linked, b.tag, tuple(c for c in b.cues if c not in silent)) for b in blocks]
    # a page without a telling name or element has features of its own, since nothing there speaks for a block but itself
    bare = all(c in PLAIN_CUES for b in blocks for c in b.cues)
    headed = False
    longest = max((len(b.text) for b in blocks), default=1)
    for i, b in enumerate(blocks):
        size = len(b.text)
        if (above := shared.get(b.cues)) is None:
            above = shared[b.cues] = [f"in:{c}" for c in b.cues] or ["in:none"]
        dense = b.linked / size if size else 0
        own = [
            "bias",
            f"tag:{b.tag}",
            f"size:{min(size, 1023).bit_length()}",
            "links:all" if dense > 0.8 else "links:many" if dense > 0.3 else "links:some" if dense else "links:none",
            "ends:sentence" if b.text[-1] in ".!?…:;»”\"" else "ends:open",
            f"commas:{min(b.text.count(','), 3)}",
            "long:page" if 2 * size >= longest else "short:page",
            "place:first" if i < 2 else "place:last" if i >= n - 2 else "place:inside",
        ]
        if size <= SHORT:
            own += {f"says:{w}" for w in SPOKEN_WORD.findall(b.text.lower()) if w in SAYS}
        if bare:
            own += ["follows:" + (blocks[i - 1].tag if i else "nothing"), "behind:title" if headed else "before:title"]
            headed = headed or b.tag == "h1"
        if b.text[0] in "©®" or "©" in b.text:
            own.append("sign:copyright")
        if "|" in b.text or "·" in b.text or "»" in b.text:
            own.append("sign:bar between links" if b.linked else "sign:bar")
        out.append([f"bare {name}" for name in own] if bare else own + above)
    return out


class Field:
    """Weights by feature and label, label transitions; label 1 is article."""

    def __init__(self, weights: dict[str, float], steps: np.ndarray):
        self.weights, self.steps, self._cues = weights, steps, None

    def cues(self) -> frozenset[str]:
        """Names and elements that the training pages had."""
        if self._cues is None:
            self._cues = frozenset(name[3:] for name in self.weights if name.startswith("in:")) | PLAIN_CUES
        return self._cues

    def decode(self, rows: list[list[str]], candidates: list[int] = ()) -> list[int]:
        """Viterbi: the likeliest labels. If they have no article block, the likeliest of those with the best candidate in it."""
        labels = self._decode(rows)
        if not any(labels) and candidates:
            best = max(candidates, key=lambda i: sum(self.weights.get(name, 0.0) for name in rows[i]))
            labels = self._decode(rows, best)
        return labels

    def _decode(self, rows: list[list[str]], must: int = -1) -> list[int]:
        if not rows:
            return []
        get = self.weights.get
        (s00, s01), (s10, s11) = self.steps.tolist()
        a = b = None
        came: list[tuple[int, int]] = []
        for i, names in enumerate(rows):
            w = 1e6 if i == must else 0.0
            for name in names:
                w += get(name, 0.0)
            if a is None:
                a, b = 0.0, w
                came.append((0, 0))
                continue
            stay, turn = a + s00, b + s10
            begin, go = a + s01, b + s11
            came.append((0 if stay >= turn else 1, 0 if begin >= go else 1))
            a, b = max(stay, turn), max(begin, go) + w
        label = int(b > a)
        labels = [label]
        for back in reversed(came[1:]):
            label = back[label]
            labels.append(label)
        return labels[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 150, rate: float = 0.1, penalty: float = 1e-4) -> Field:
    """Gradient ascent (Adam) on the mean conditional log-likelihood, all pages at once by forward and backward sums."""
    names = {name: k for k, name in enumerate(sorted({x for rows, _ in pages for names in rows for x in names}))}
    most, many = max(len(rows) for rows, _ in pages), len(pages)
    where, what = [], []
    gold = np.zeros((many, most), dtype=int)
    real = np.zeros((many, most), dtype=bool)
    for p, (rows, labels) in enumerate(pages):
        gold[p, : len(rows)], real[p, : len(rows)] = labels, True
        for t, own in enumerate(rows):
            where += [p * most + t] * len(own)
            what += [names[x] for x in own]
    where, what = np.array(where), np.array(what)
    w, steps = np.zeros(len(names)), np.zeros((2, 2))
    moments = [(np.zeros_like(w), np.zeros_like(w)), (np.zeros_like(steps), np.zeros_like(steps))]
    pairs = real[:, 1:]
    seen = np.array([[(pairs & (gold[:, :-1] == i) & (gold[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)], dtype=float)
    total = real.sum()
    flat, weight = gold - 0.0, real / total
    for turn in range(1, rounds + 1):
        # forward and backward sums as probabilities, scaled at each block
        lift = np.exp(np.clip(np.bincount(where, weights=w[what], minlength=many * most).reshape(many, most), -60, 60)) * real
        base = real.astype(float)
        move = np.exp(steps - steps.max())
        forward, backward = np.zeros((most, many, 2)), np.ones((most, many, 2))
        for t in range(most):
            own = forward[t - 1] @ move if t else np.ones((many, 2))
            own = own * np.stack([base[:, t], lift[:, t]], axis=1)
            forward[t] = own / np.maximum(own.sum(1, keepdims=True), 1e-300)
        for t in range(most - 2, -1, -1):
            own = (backward[t + 1] * np.stack([base[:, t + 1], lift[:, t + 1]], axis=1)) @ move.T
            own = np.where(real[:, t + 1, None], own, 1.0)
            backward[t] = own / np.maximum(own.sum(1, keepdims=True), 1e-300)
        both = forward * backward
        own = (both[:, :, 1] / np.maximum(both.sum(2), 1e-300)).T * real
        ahead = backward[1:] * np.stack([base[:, 1:].T, lift[:, 1:].T], axis=2)
        pair = forward[:-1, :, :, None] * move[None, None] * ahead[:, :, None, :]
        pair = pair / np.maximum(pair.sum((2, 3), keepdims=True), 1e-300) * pairs.T[:, :, None, None]
        dw = np.bincount(what, weights=((flat - own) * weight).ravel()[where], minlength=len(names)) - penalty * w
        ds = (seen - pair.sum((0, 1))) / total - penalty * steps
        # Adam: means of the gradient and of its square, both freed of their start
        for value, slope, (mean, square) in ((w, dw, moments[0]), (steps, ds, moments[1])):
            mean += 0.1 * (slope - mean)
            square += 0.01 * (slope**2 - square)
            value += rate * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-8)
    return Field({name: float(w[k]) for name, k in names.items()}, steps)


# What the labelled pages are made of.
FURNITURE = {
    "nav": ["nav", "navbar", "main-nav", "menu", "topmenu", "breadcrumb", "breadcrumbs", "site-navigation", "pagination", "toc", "skip-link"],
    "head": ["header", "site-header", "masthead", "top-bar", "banner", "branding", "logo"],
    "foot": ["footer", "site-footer", "colophon", "copyright", "legal", "bottom"],
    "side": ["sidebar", "aside", "widget", "widget-area", "related", "related-posts", "recommended", "popular", "trending", "right-rail", "tags", "tag-list"],
    "notice": ["cookie-notice", "cookie", "consent", "gdpr-banner", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "overlay", "disclaimer"],
    "ad": ["ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "sponsor", "promo", "promotion", "adsense", "commercial"],
    "form": ["form", "search", "search-form", "login", "signup", "contact-form", "share", "social", "social-share"],
    "comment": ["comment", "comments", "comment-list", "comment-body", "replies", "reply", "responses", "disqus", "discussion", "user-comments"],
}
ARTICLE = ["content", "article", "article-body", "post", "post-content", "entry", "entry-content", "story", "story-body", "main", "main-content", "text", "body", "page-content"]
SPOKEN = "the of and to in is was that for with on as it by from une des les que dans pour sur der die und das ist mit von los las por con para como also many old new first water house stone river light table music paper morning people city story world"
#: What furniture says about itself.
PHRASES = {
    "nav": ["Home", "Contact", "About us", "Menu", "Skip to content", "Login", "Search", "Accueil", "Inicio", "Impressum"],
    "head": ["Sign up", "Menu", "Search", "Subscribe"],
    "foot": ["All rights reserved.", "Privacy and terms", "Contact and imprint", "Terms of use | Privacy policy", "Datenschutz"],
    "side": ["Related stories", "Most read", "Popular", "Trending now", "Follow us"],
    "notice": ["We use cookies to improve this site.", "By using this site you agree to our privacy terms.", "Subscribe to our newsletter.", "Accept all cookies", "Close"],
    "ad": ["Advertisement", "Sponsored", "Promoted content"],
    "form": ["Sign in", "Register", "Search this site", "Share", "Tweet this", "Subscribe"],
    "comment": ["3 comments", "Reply", "Leave a comment", "Comments", "Log in to reply"],
}
#: Of the pages, those whose elements have no telling names at all.
UNNAMED = 0.25
MARK = "\ue000"


def labelled_pages(many: int = 800, seed: int = 5) -> list[str]:
    """Training pages; article blocks begin with ``MARK``."""
    rng = np.random.default_rng(seed)
    words = SPOKEN.split()
    pick = lambda items: items[int(rng.integers(len(items)))]
    chance = lambda p: bool(rng.random() < p)

    def sentence(lo: int, hi: int) -> str:
        own = [pick(words) + pick(["", "", "er", "ly", "ing", ","]) for _ in range(int(rng.integers(lo, hi)))]
        return " ".join(own).strip(",").capitalize() + pick([".", ".", ".", "!", "?", ""])

    def prose(lo: int = 1, hi: int = 6) -> str:
        if chance(0.25):  # odd paragraphs are text too
            return pick([pick(words), pick(words).upper() + "!!", pick(words).capitalize(), sentence(1, 3), " | ".join(sentence(1, 2) for _ in range(8)), " | ".join(pick(words) for _ in range(int(rng.integers(2, 30)))) + " |", sentence(8, 20).upper(), "### ".join(sentence(1, 3) for _ in range(6)), f"© {sentence(5, 20)}", "1,000 &amp; 2"])
        return " ".join(sentence(4, 22) for _ in range(int(rng.integers(lo, hi))))

    def link(text: str) -> str:
        return f'<a href="/{pick(words)}">{text}</a>'

    def links() -> str:
        items = [link(sentence(1, 4).strip(".!?")) for _ in range(int(rng.integers(2, 8)))]
        return f"<ul>{''.join(f'<li>{x}' + pick(['</li>', '</li>', '']) for x in items)}</ul>" if chance(0.7) else pick([" | ", " · ", " "]).join(items)

    def furniture(kind: str) -> str:
        inside = {
            "nav": links,
            "head": lambda: f"<{pick(['div', 'p', 'h1', 'h2', 'span'])}>{sentence(1, 6)}</div>" + (links() if chance(0.5) else ""),
            "foot": lambda: f"{pick(['&copy; ', '&copy; 2020 ', ''])}{pick(words)}.example.com &middot; {sentence(2, 12)}" + (links() if chance(0.3) else ""),
            "side": lambda: f"<h3>{sentence(1, 3)}</h3>" + (links() if chance(0.6) else f"<p>{prose(1, 3)}</p>"),
            "notice": lambda: f"<p>{prose(1, 3)}</p>" if chance(0.6) else prose(1, 3),
            "ad": lambda: prose(1, 3) if chance(0.6) else f"<p>{prose(1, 3)}</p>{link(sentence(1, 3))}",
            "form": lambda: f"<label>{sentence(1, 4)}</label><input name=q><p>{sentence(2, 9)}</p><button>{sentence(1, 2)}</button>",
            "comment": lambda: "".join(f"<div class='{pick(FURNITURE['comment'])}'><b>{sentence(1, 3)}</b><p>{prose(1, 4)}</p></div>" for _ in range(int(rng.integers(1, 5)))),
        }[kind]()
        own = {"nav": ["nav"], "head": ["header"], "foot": ["footer"], "side": ["aside"], "form": ["form"]}.get(kind, ["div", "section"])
        if chance(0.4):
            inside = f"<{(t := pick(['p', 'div', 'h3', 'span']))}>{pick(PHRASES[kind])}</{t}>{inside}"
        tag = pick(own) if chance(0.6) else pick(["div", "section", "ul" if kind == "nav" else "div"])
        name = pick(FURNITURE[kind])
        label = "" if tag in ("nav", "header", "footer", "aside", "form") and chance(0.5) else f' {pick(["class", "id", "class", "role"])}="{name}{pick(["", "", "-1", " wide", " box"])}"'
        return f"<{tag}{label}>{inside}</{tag}>"

    def paragraph() -> str:
        text = MARK + prose()
        kind = rng.random()
        if kind < 0.62:
            return f"<p>{text}" + pick(["</p>", "</p>", "</p>", ""])
        if kind < 0.70:
            return f"<p><b>{text}<br>"
        if kind < 0.78:
            return f"<p>{text} {link(sentence(1, 5))} {prose()}</p>"
        if kind < 0.84:
            return f"<ul><li>{MARK}{sentence(3, 12)}</li><li>{MARK}{sentence(3, 12)}</ul>"
        if kind < 0.89:
            return f"<blockquote>{text}</blockquote>"
        if kind < 0.92:
            return f"<pre>{text}</pre>"
        if kind < 0.95:
            return f"<table><tr><td>{MARK}{sentence(1, 6)}<td>{MARK}{sentence(1, 6)}</tr></table>"
        if kind < 0.97:
            return f"<figure><figcaption>{MARK}{sentence(3, 9)}</figcaption></figure>"
        return f"<div>{text}</div>"

    def article() -> str:
        parts = [f"<{pick(['h1', 'h1', 'h2'])}>{MARK}{sentence(2, 12)}</h1>"] if chance(0.9) else []
        brief = chance(0.12)  # a note of one short block
        if brief:
            parts.append(f"<p>{MARK}{sentence(2, 9)}</p>")
        for _ in range(0 if brief else int(rng.integers(1, 12))):
            parts.append(f"<{(h := pick(['h2', 'h3', 'h4']))}>{MARK}{sentence(1, 6)}</{h}>" if chance(0.12) else paragraph())
            if chance(0.12):
                parts.append(furniture(pick(["ad", "notice", "form", "side", "nav"])))
        inside = "".join(parts)
        shape = rng.random()
        if shape < 0.45:
            inside = f"<article>{inside}</article>"
        elif shape < 0.6:
            inside = f"<main>{inside}</main>"
        elif shape < 0.9:
            tag = pick(["div", "div", "section"])
            inside = f'<{tag} {pick(["class", "id", "role"])}="{pick(ARTICLE)}{pick(["", "", "-1", " wide", " box"])}">{inside}</{tag}>'
        else:
            inside = f"<section>{inside}</section>" if chance(0.4) else f"<div>{inside}</div>"
        return inside if chance(0.7) else f"<main><div class=container>{inside}</div></main>"

    out = []
    for _ in range(many):
        unnamed = chance(UNNAMED)  # such pages have only furniture that gives itself away
        before = [furniture(k) for k in (("head", "nav", "form") if unnamed else ("notice", "head", "nav", "ad", "form")) if chance(0.45)]
        after = [furniture(k) for k in (("nav", "form", "foot") if unnamed else ("ad", "side", "comment", "form", "foot", "notice")) if chance(0.45)]
        body = "".join(before) + article() + "".join(after)
        if unnamed:
            body = re.sub(r"<(/?)(?:article|main|section|nav|header|footer|aside|form)\b", r"<\1div", re.sub(r""" (?:class|id|role)=(?:"[^"]*"|'[^']*'|\w+)""", "", body))
            if chance(0.4):  # paragraphs are divisions too
                body = re.sub(r"<(/?)(?:p|h[1-4])\b", r"<\1div", body)
        head = pick([f"<head><title>{sentence(2, 8)}</title><style>p{{}}</style></head><body>", f"<head><title>{sentence(2, 8)}</title>", f"<title>{sentence(2, 8)}</title><body>"])
        out.append(f"<!DOCTYPE html><html>{head}{body}" + pick(["</body></html>", ""]))
    return out


def learn(pages: list[str]) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels of marked pages."""
    out = []
    for page in pages:
        blocks = blocks_of(page)
        labels = [int(MARK in b.text) for b in blocks]
        for b in blocks:
            b.text = b.text.replace(MARK, "") or "."
        if blocks:
            out.append((features(blocks), labels))
    return out


@lru_cache(1)
def trained_field() -> Field:
    return train(learn(labelled_pages()))


def candidates_of(blocks: list[Block]) -> list[int]:
    """Blocks that can be a page's whole article: those of an article element, and long prose outside of furniture."""
    free = [i for i, b in enumerate(blocks) if not FURNITURE_CUES & set(b.cues) - _silent_cues(blocks, None) and 2 * b.linked < len(b.text)]
    return [i for i in free if "<article>" in blocks[i].cues or (len(blocks[i].text) >= PROSE and blocks[i].text[-1] in ".!?…»”\"")]


def main_text(page: str | None, field: Field) -> str:
    blocks = blocks_of(page)
    labels = field.decode(features(blocks, field.cues()), candidates_of(blocks))
    return "\n".join(b.text for b, label in zip(blocks, labels, strict=True) if label)


def extract(pages: DataFrame, field: Field | None = None, page_id: str = "page_id", url: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row; one pass, no shuffle."""
    shared = pages.sparkSession.sparkContext.broadcast(field or trained_field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "html"):
            texts = [main_text(p, shared.value) for p in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html_column).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
