"""Main text of web pages: a linear-chain conditional random field over the blocks of a page.

A page is scanned into blocks: the text between the tags of block elements, in page order, with the tags that stand above
it. Features of a block are its ancestors' tags, the words of their class, id and role, its length, punctuation and share
of links, and its place. The field labels each block as main text or not; it is trained on labelled pages, by
the gradient of the exact likelihood, and decoded by Viterbi. Text in script, style and such elements is no block at all.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = frozenset("address article aside blockquote body br button center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noframes ol option p pre search section select summary table tbody td tfoot th thead title tr ul video audio textarea iframe object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page; the content of the first ones is not even markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("script style template noscript title head textarea xmp iframe noembed noframes svg math select option button datalist object audio video canvas".split())
#: An element of the first kind ends when one of the second begins.
CLOSED_BY = {"p": BLOCKS - {"br", "button", "option"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]), "head": frozenset(["body"])}
#: A p in one of these does not end one outside it.
SCOPE = frozenset("table td th button li ul ol dl dd dt nav article section div aside header footer main form body html figure blockquote details fieldset".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACES = re.compile(r"\s+")


@dataclass(eq=False)
class Scope:
    """What an open element adds to those around it: block tags and attribute words that none of them has. Blocks share
    scopes, so that a page takes memory by its length, however deep it is nested."""

    above: Scope | None = None
    tags: tuple[str, ...] = ()
    words: tuple[str, ...] = ()
    block: str = ""
    main: bool = False

    def line(self) -> list[Scope]:
        """From the outermost scope to this one."""
        out, scope = [], self
        while scope is not None:
            out.append(scope)
            scope = scope.above
        return out[::-1]


@dataclass
class Block:
    text: str
    scope: Scope
    linked: int = 0
    label: int = field(default=0)

    @property
    def path(self) -> tuple[str, ...]:
        """The different block tags around the text."""
        return tuple(t for s in self.scope.line() for t in s.tags)

    @property
    def words(self) -> tuple[str, ...]:
        """The different attribute words around the text."""
        return tuple(w for s in self.scope.line() for w in s.words)


class _Open:
    """The elements that are open, and how often each tag and word is among them."""

    def __init__(self):
        self.frames: list[tuple[str, tuple[str, ...], Scope]] = []
        self.tags: Counter[str] = Counter()
        self.words: Counter[str] = Counter()
        self.root = Scope()

    @property
    def scope(self) -> Scope:
        return self.frames[-1][2] if self.frames else self.root

    def push(self, tag: str, words: tuple[str, ...]) -> None:
        above, block = self.scope, tag in BLOCKS
        new_tags = (tag,) if block and not self.tags[tag] else ()
        new_words = tuple(w for w in dict.fromkeys(words) if not self.words[w])
        same = not new_tags and not new_words and (not block or above.block == tag)
        self.frames.append((tag, words, above if same else Scope(above, new_tags, new_words, tag if block else above.block, above.main or tag in ("article", "main"))))
        self.tags[tag] += 1
        self.words.update(words)

    def pop(self) -> str:
        tag, words, _ = self.frames.pop()
        self.tags[tag] -= 1
        self.words.subtract(words)
        return tag

    def remove(self, place: int) -> None:
        """Takes out an element from between the others."""
        above = [(t, w) for t, w, _ in self.frames[place + 1 :]]
        for _ in range(len(above) + 1):
            self.pop()
        for tag, words in above:
            self.push(tag, words)


@lru_cache(maxsize=4096)
def _attribute_words(attributes: str) -> tuple[str, ...]:
    out = []
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            out.append("-hidden")
        elif name != "style":
            out += _WORD.findall(value)
    return tuple(dict.fromkeys(out))


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page, in order. Character references are decoded; white space becomes one space each."""
    out: list[Block] = []
    stack = _Open()
    pending: list[str] = []
    linked, dropped, links = 0, 0, 0
    at, n = 0, len(page)

    def flush():
        nonlocal linked
        if pending:
            text = _SPACES.sub(" ", html.unescape("".join(pending))).strip()
            if text:
                out.append(Block(text, stack.scope, linked))
            pending.clear()
        linked = 0

    def close(upto: int):
        nonlocal dropped, links
        while len(stack.frames) > upto:
            tag = stack.pop()
            dropped -= tag in DROPPED
            links -= tag == "a"

    while at < n:
        cut = page.find("<", at)
        if cut < 0:
            cut = n
        if cut > at and not dropped:
            pending.append(page[at:cut])
            if links:
                linked += cut - at
        if cut == n:
            break
        m = _TOKEN.match(page, cut)
        if m is None:  # a sign, not a tag
            if not dropped:
                pending.append("<")
            at = cut + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if not stack.tags[tag]:
                if tag in ("p", "br"):
                    flush()
                continue
            place = next(i for i in range(len(stack.frames) - 1, -1, -1) if stack.frames[i][0] == tag)
            if tag not in BLOCKS and any(t in BLOCKS for t, *_ in stack.frames[place:]):
                # an inline element that was left open around blocks ends by itself
                links -= tag == "a"
                dropped -= tag in DROPPED
                stack.remove(place)
                continue
            if tag in BLOCKS:
                flush()
            close(place)
            continue
        if tag in BLOCKS:
            flush()
            for i in range(len(stack.frames) - 1, -1, -1):
                if tag in CLOSED_BY.get(stack.frames[i][0], ()):
                    close(i)
                    break
                if stack.frames[i][0] in SCOPE:
                    break
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "path"):
            continue
        stack.push(tag, _attribute_words(m[3]))
        dropped += tag in DROPPED
        links += tag == "a"
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else n
    flush()
    return out


def own_features(blocks: list[Block]) -> list[list[str]]:
    """Names of the binary features that each block has of its own text, place and nearest elements."""
    out = []
    n = len(blocks)
    for i, b in enumerate(blocks):
        length, link = len(b.text), b.linked / max(1, len(b.text))
        words = b.text.count(" ") + 1
        f = ["bias", f"tag={b.scope.block}", f"words={min(8, words.bit_length())}", f"links={0 if link < 0.05 else 1 if link < 0.5 else 2}", f"end={b.text[-1] if b.text[-1] in '.!?:;,' else 'x'}", f"first={i == 0}", f"last={i == n - 1}"]
        f += ["main=no"] * (not b.scope.main)
        f += ["sign"] * any(c in b.text for c in "©®→»|·") + ["long"] * (length > 200) + ["short"] * (length < 25)
        out.append(f)
    return out


def scope_features(scope: Scope) -> list[str]:
    return [f"in={t}" for t in scope.tags] + [f"word={w}" for w in scope.words]


def features_of(blocks: list[Block]) -> list[list[str]]:
    """Names of all binary features of each block, those of the elements around it included."""
    return [own + [f for s in b.scope.line() for f in scope_features(s)] for own, b in zip(own_features(blocks), blocks)]


class Field:
    """A linear chain of two labels (1: main text): weights of features for label 1, and of transitions."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, transitions: np.ndarray):
        self.names, self.weights, self.transitions = names, weights, transitions

    def scores(self, features: list[list[str]]) -> np.ndarray:
        names, weights = self.names, self.weights
        return np.array([sum(weights[names[x]] for x in f if x in names) for f in features])

    def block_scores(self, blocks: list[Block]) -> np.ndarray:
        """The scores of blocks: what elements around them add is made once for each scope."""
        held: dict[int, float] = {}

        def of(scope: Scope | None) -> float:
            todo = []
            while scope is not None and id(scope) not in held:
                todo.append(scope)
                scope = scope.above
            total = held[id(scope)] if scope is not None else 0.0
            for s in reversed(todo):
                total += sum(self.weights[self.names[x]] for x in scope_features(s) if x in self.names)
                held[id(s)] = total
            return total

        return self.scores(own_features(blocks)) + np.array([of(b.scope) for b in blocks])

    def viterbi(self, features: list[list[str]]) -> list[int]:
        """The labels that are likeliest together; 0 before 1 where two paths are as likely."""
        return self.decode(self.scores(features))

    def decode(self, scores: np.ndarray) -> list[int]:
        if not len(scores):
            return []
        s, t = scores.tolist(), self.transitions.tolist()
        best, back = [0.0, s[0]], []
        for x in s[1:]:
            came, now = [], []
            for label in (0, 1):
                a, b = best[0] + t[0][label], best[1] + t[1][label]
                came.append(int(b > a))
                now.append(max(a, b) + (x if label else 0.0))
            back.append(came)
            best = now
        label = int(best[1] > best[0])
        out = [label]
        for came in reversed(back):
            label = came[label]
            out.append(label)
        return out[::-1]

    @classmethod
    def train(cls, pages: list[tuple[list[list[str]], list[int]]], rounds: int = 120, rate: float = 0.1, decay: float = 0.002, least: int = 3) -> Field:
        """Maximises the log likelihood of labelled pages by Adam; expectations by forward and backward sums."""
        counts: dict[str, int] = {}
        for features, _ in pages:
            for f in features:
                for x in f:
                    counts[x] = counts.get(x, 0) + 1
        names = {x: i for i, x in enumerate(sorted(x for x, c in counts.items() if c >= least))}
        rows = []
        for features, labels in pages:
            row = np.concatenate([[k] * sum(x in names for x in f) for k, f in enumerate(features)] or [[]]).astype(int)
            column = np.array([names[x] for f in features for x in f if x in names], int)
            rows.append((row, column, np.array(labels, int)))
        w, t = np.zeros(len(names)), np.zeros((2, 2))
        m, v = np.zeros(len(names) + 4), np.zeros(len(names) + 4)
        for step in range(1, rounds + 1):
            gw, gt = decay * w * len(pages), decay * t * len(pages)
            for row, column, labels in rows:
                n = len(labels)
                if not n:
                    continue
                s = np.zeros((n, 2))
                s[:, 1] = np.bincount(row, w[column], n)
                forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
                forward[0] = s[0]
                for i in range(1, n):
                    forward[i] = s[i] + np.logaddexp(forward[i - 1, 0] + t[0], forward[i - 1, 1] + t[1])
                for i in range(n - 2, -1, -1):
                    backward[i] = np.logaddexp(t[:, 0] + s[i + 1, 0] + backward[i + 1, 0], t[:, 1] + s[i + 1, 1] + backward[i + 1, 1])
                total = np.logaddexp(*forward[-1])
                p = np.exp(forward[:, 1] + backward[:, 1] - total)
                gw += np.bincount(column, (p - labels)[row], len(w))
                if n > 1:
                    gt += np.exp(forward[:-1, :, None] + t + (s[1:] + backward[1:])[:, None, :] - total).sum(0)
                    np.subtract.at(gt, (labels[:-1], labels[1:]), 1)
            g = np.concatenate([gw, gt.reshape(-1)]) / len(pages)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, t = w - change[:-4], t - change[-4:].reshape(2, 2)
        return cls(names, w, t)


def main_text(page: str, model: Field) -> str:
    blocks = blocks_of(page)
    return "\n".join(b.text for b, label in zip(blocks, model.decode(model.block_scores(blocks))) if label)


# --- labelled pages -------------------------------------------------------------------------------------------------

_SYLLABLES = "ba be bi bo da de do fa fe ga go ha he ka ko la le li lo ma me mi mo na ne no pa pe ra re ri ro sa se si so ta te ti to va ve vo za".split()


class PageWriter:
    """Writes pages of many layouts from a seed; the text of each main block is marked by its place in the list of blocks."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.nesting = random.Random(seed + 1)

    def words(self, a: int, b: int) -> str:
        return " ".join("".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4))) for _ in range(self.r.randint(a, b)))

    def sentence(self, a: int = 4, b: int = 18) -> str:
        text = self.words(a, b).capitalize()
        if self.r.random() < 0.15:
            text = text.replace(" ", self.r.choice(["%%% ", "&amp;&amp; ", "### ", " | ", ", ", "*** "]), self.r.randint(1, 6))
        return text + self.r.choice([".", ".", ".", ".", "!", "?", ""])

    def prose(self) -> str:
        return " ".join(self.sentence() for _ in range(self.r.choice([1, 1, 1, 2, 3, 5, 9])))

    def inline(self, text: str) -> str:
        parts = text.split(" ")
        for _ in range(self.r.randint(0, 2)):
            i = self.r.randrange(len(parts))
            parts[i] = self.r.choice(["<b>{}</b>", "<em>{}</em>", "<a href='/x'>{}</a>", "<span class=\"t\">{}</span>", "<code>{}</code>"]).format(parts[i])
        return " ".join(parts)

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(n))

    def named(self, tag: str, names: str, body: str) -> str:
        key = self.r.choice(["class", "class", "class", "id", "role"])
        value = self.r.choice(names.split())
        return f'<{tag} {key}="{self.r.choice(["", "", "site-", "page-", "js-"])}{value}">{body}</{tag}>'

    def noise(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            tag = r.choice(["nav", "nav", "div", "ul"])
            body = self.links(r.randint(2, 8))
            return f"<{tag}><ul>{body}</ul></{tag}>" if tag == "nav" and r.random() < 0.6 else self.named(tag, "nav navbar menu navigation breadcrumb breadcrumbs topnav toc", body if tag == "ul" else f"<ul>{body}</ul>")
        if kind == "header":
            tag = r.choice(["header", "header", "div"])
            body = f"<div>{self.words(1, 5)}</div>" + r.choice(["", f"<p>{self.sentence()}</p>", f"<h2>{self.words(1, 4)}</h2>"])
            return f"<header>{body}</header>" if tag == "header" and r.random() < 0.5 else self.named(tag, "header masthead banner top topbar branding", body)
        if kind == "footer":
            body = r.choice(["&copy; ", "© 2020 ", "Copyright "]) + self.words(1, 4) + r.choice([" &middot; ", " | ", ". "]) + self.sentence(2, 8)
            body = r.choice([body, f"<p>{body}</p>", f"<p>{body}</p><ul>{self.links(3)}</ul>"])
            return f"<footer>{body}</footer>" if r.random() < 0.6 else self.named("div", "footer foot copyright colophon bottom legal", body)
        if kind == "ad":
            return self.named(r.choice(["div", "div", "aside", "section"]), "ad ads advert advertisement sponsored promo banner sponsor promoted", r.choice(["{}", "<p>{}</p>"]).format(self.prose()))
        if kind == "side":
            body = f"<h3>{self.words(1, 3)}</h3>" * r.randint(0, 1) + r.choice([f"<ul>{self.links(r.randint(2, 6))}</ul>", f"<p>{self.prose()}</p>"])
            return f"<aside>{body}</aside>" if r.random() < 0.5 else self.named(r.choice(["div", "aside", "section"]), "sidebar side widget related recommended more share social tags aside", body)
        if kind == "notice":
            return self.named(r.choice(["div", "section", "p"]), "cookie cookies notice consent alert gdpr popup modal subscribe newsletter paywall warning message toast", self.sentence(3, 14) if r.random() < 0.5 else f"{self.sentence()} <button>{self.words(1, 2)}</button>")
        if kind == "form":
            return f'<form action="/s" class="{r.choice(["search", "login", "signup", "f"])}"><label>{self.words(1, 4)}</label><input name="q"><p>{self.sentence(2, 8)}</p><button>{self.words(1, 2)}</button></form>'
        if kind == "comments":
            one = "".join(r.choice(['<div class="comment">{}</div>', "<li>{}</li>", "<p>{}</p>", "<article>{}</article>"]).format(r.choice([self.prose(), f"<p>{self.prose()}</p>"])) for _ in range(r.randint(1, 5)))
            return self.named(r.choice(["div", "section", "ol"]), "comments comment responses discussion replies disqus reviews", f"<h3>{self.words(1, 3)}</h3>" * r.randint(0, 1) + one)
        return r.choice(['<script>var a="<p>x</p>";</script>', "<style>p{margin:0}</style>", f"<!-- {self.words(1, 3)} -->", "<noscript>x</noscript>"])

    def article(self) -> str:
        r, out = self.r, []
        if r.random() < 0.9:
            out.append(f"<h1>{self.sentence(2, 9)}</h1>")
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 11, 14])):
            kind = r.random()
            if kind < 0.62:
                out.append(r.choice(["<p>{}</p>"] * 6 + ["<p>{}", "<p><b>{}<br>", "<div>{}</div>", "<p>{}<br></p>"]).format(self.inline(self.prose())))
            elif kind < 0.72:
                out.append(f"<h{r.randint(2, 4)}>{self.sentence(1, 6)}</h2>".replace("</h2>", "</h2>" if r.random() < 0.1 else "</h3>"))
            elif kind < 0.82:
                out.append("<ul>" + "".join(f"<li>{self.inline(self.sentence(1, 14))}" + r.choice(["</li>", ""]) for _ in range(r.randint(1, 6))) + "</ul>")
            elif kind < 0.87:
                out.append(f"<blockquote>{r.choice(['<p>{}</p>', '{}']).format(self.prose())}</blockquote>")
            elif kind < 0.91:
                out.append(f"<pre>{self.words(2, 20)}</pre>")
            elif kind < 0.95:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 3)}</td>" for _ in range(2)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            else:
                out.append(f"<figure><img src='x.png'><figcaption>{self.sentence(3, 10)}</figcaption></figure>")
        return "".join(out)

    def page(self) -> tuple[str, list[tuple[str, int]]]:
        """(html, its parts as (html, 1 if main))"""
        r = self.r
        parts = [(f"<!DOCTYPE html><html lang=\"en\"><head><meta charset=\"utf-8\"><title>{self.sentence()}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head><body>", 0)]
        before = [k for k, p in (("notice", 0.2), ("header", 0.5), ("nav", 0.8), ("form", 0.15), ("ad", 0.4), ("junk", 0.2), ("side", 0.15)) if r.random() < p]
        after = [k for k, p in (("side", 0.4), ("ad", 0.2), ("comments", 0.4), ("form", 0.2), ("nav", 0.15), ("notice", 0.2), ("footer", 0.8), ("junk", 0.2)) if r.random() < p]
        if r.random() < 0.2:  # an article by itself, cut off or without a head
            before, after = [], []
            parts = [(r.choice(["", "<html><body>", parts[0][0]]), 0)]
        parts += [(self.noise(k), 0) for k in before]
        shell = r.choice(["article"] * 5 + ["main", "main", '<div class="{}">'.format(r.choice(["content", "post", "entry", "article-body", "story", "main-content", "post-content"])), '<div id="{}">'.format(r.choice(["content", "main", "article"])), ""])
        opened, closed = (f"<{shell}>", f"</{shell}>") if shell in ("article", "main") else (shell, "</div>" if shell else "")
        parts.append((opened, 0))
        body = self.article() if before or after or r.random() < 0.5 else f"<p>{self.prose()}</p>"
        if self.nesting.random() < 0.08:  # paragraphs whose elements are never closed
            body = body.replace("</p>", "").replace("<p>", self.nesting.choice(["<div>", "<div class=\"p\">", "<section>"]) * self.nesting.choice([1, 1, 4]))
            body = "".join(f"<div>{self.words(1, 4)}" for _ in range(self.nesting.choice([0, 0, 30]))) + body
        if r.random() < 0.25:  # noise inside the article
            halves = body.split("<p>", 2)
            parts.append((halves[0], 1))
            inside = self.noise(r.choice(["ad", "side", "notice", "form", "comments", "nav"]))
            parts += [(inside, 0), ("".join("<p>" + h for h in halves[1:]), 1)]
        else:
            parts.append((body, 1))
        if r.random() < 0.15:
            parts.append((self.noise("comments"), 0))
        parts.append((closed, 0))
        parts += [(self.noise(k), 0) for k in after]
        parts.append(("</body></html>", 0))
        return "".join(p for p, _ in parts), parts


def labelled_page(writer: PageWriter) -> tuple[str, list[Block]]:
    """A page and its blocks with their labels. Main text is marked while the page is scanned, and the marks are taken out."""
    page, parts = writer.page()
    mark = ""
    marked = "".join(re.sub(r">([^<>]*[^<>\s][^<>]*)(?=<|$)", lambda m: f">{mark}{m[1]}", p) if main else p for p, main in parts)
    blocks = blocks_of(marked)
    for b in blocks:
        b.label = int(mark in b.text)
        b.text = _SPACES.sub(" ", b.text.replace(mark, "")).strip()
        b.linked = min(b.linked, len(b.text))
    return page, [b for b in blocks if b.text]


@lru_cache(maxsize=2)
def trained(pages: int = 400, seed: int = 7) -> Field:
    """The field that is trained on pages of the writer; made anew by each driver, always the same."""
    writer = PageWriter(seed)
    made = [labelled_page(writer)[1] for _ in range(pages)]
    return Field.train([(features_of(b), [x.label for x in b]) for b in made])


def extract(pages: DataFrame, model: Field | None = None, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text (main blocks, one a line) and n_chars (its code points) of each row.

    A null page is the empty page, whose text is empty, as is that of a page without main blocks. Rows are kept as they
    are, repeated ones included; other columns are not looked at. No shuffle: each row is worked on where it is read.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64)
                texts = [main_text(h or "", sent.value) for h in rows.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
