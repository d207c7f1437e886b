"""Main text of web pages: a linear-chain conditional random field over the page's leaf blocks."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that begin a new block, elements without end tags, and elements whose content is no text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup "
    "option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("script style noscript template svg iframe object canvas title select textarea".split())
#: Elements that may stand in a page's head, and those that may stand in a select.
HEAD_TAGS = frozenset("base link meta noscript script style template title".split())
SELECT_TAGS = frozenset("hr optgroup option script template".split())
#: Words of class, id and role attributes that say what an element is for.
HINTS = frozenset(
    "ad ads advert advertisement article banner body breadcrumb comment comments consent content cookie copyright entry "
    "footer form header legal login main masthead menu meta modal nav navigation newsletter notice pager popup post promo "
    "related reply share sidebar social sponsor sponsored story subscribe text toolbar widget".split()
)
#: A quote holds a value only after an equals sign and if it ends; any other is a sign like any other.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|)|[\"'])*+)(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_MARKS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_CLOSES_P = BLOCK_TAGS - {"body", "html", "button"}
#: An end tag or a new item closes these, but not beyond the elements named with them.
_ITEMS = {"li": {"ul", "ol", "menu", "dir"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}


@dataclass
class Block:
    """One leaf block: its text, its nearest element, its ancestors' tags and hints, and how many of its characters are in links."""

    text: str
    own: str
    tags: frozenset[str]
    hints: frozenset[str]
    linked: int


@dataclass
class _Open:
    """An open element, with the tags and hints of itself and its ancestors."""

    tag: str
    tags: frozenset[str]
    hints: frozenset[str]


class _Stack:
    """Open elements, with the places of each tag, so that no step walks over what stays open."""

    def __init__(self) -> None:
        self.items: list[_Open] = []
        self.places: dict[str, list[int]] = {}
        self.silent = 0

    def last(self, tag: str) -> int:
        """The place of the innermost open element of that tag, or -1."""
        found = self.places.get(tag)
        return found[-1] if found else -1

    def push(self, tag: str, hints: frozenset[str]) -> None:
        tags, known = (self.items[-1].tags, self.items[-1].hints) if self.items else (frozenset(), frozenset())
        self.places.setdefault(tag, []).append(len(self.items))
        self.items.append(_Open(tag, tags if tag in tags else tags | {tag}, known if hints <= known else known | hints))
        self.silent += tag in SILENT_TAGS

    def pop_to(self, depth: int) -> None:
        while len(self.items) > depth:
            tag = self.items.pop().tag
            self.places[tag].pop()
            self.silent -= tag in SILENT_TAGS


def _hints(attributes: str) -> frozenset[str]:
    found = " ".join(a or b or c for a, b, c in _MARKS.findall(attributes))
    return HINTS.intersection(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", found).lower()))


def leaf_blocks(page: str) -> list[Block]:
    """Blocks of text between block-level tags, in page order; broken and unfinished markup is tolerated.

    A head ends where something begins that can't stand in one, a select likewise; an element whose content is no text
    counts only if its end tag follows. The work is linear in the page, however many elements stay open.
    """
    out: list[Block] = []
    stack = _Stack()
    parts: list[str] = []
    linked = links = 0
    at = 0
    ends = {m[1].lower(): m.start() for m in re.finditer(r"</([a-zA-Z]+)", page)}

    def close_block() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            here = stack.items[-1] if stack.items else _Open("none", frozenset(), frozenset())
            out.append(Block(text, here.tag, here.tags, here.hints, linked))
        linked = 0

    def take(raw: str) -> None:
        nonlocal linked
        if raw and not stack.silent:
            text = html.unescape(raw)
            parts.append(text)
            if links:
                linked += len(text.strip())

    def implied_ends(tag: str) -> None:
        for holder, allowed in (("head", HEAD_TAGS), ("select", SELECT_TAGS)):
            place = stack.last(holder)
            if place >= 0 and tag not in allowed:
                stack.pop_to(place)
        if stack.items and stack.items[-1].tag == "p" and tag in _CLOSES_P:
            stack.pop_to(len(stack.items) - 1)
        if tag in _ITEMS:
            place = stack.last(tag)
            if place > max(map(stack.last, _ITEMS[tag])):
                stack.pop_to(place)

    for m in _TOKEN.finditer(page):
        take(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag == "a":
            links = 0 if m[2] else 1
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in BLOCK_TAGS and tag not in SILENT_TAGS:
            continue
        close_block()
        links = 0
        if m[2]:
            if stack.last(tag) >= 0:
                stack.pop_to(stack.last(tag))
            continue
        implied_ends(tag)
        if tag in SILENT_TAGS and ends.get(tag, -1) < m.start():
            continue
        if tag not in VOID_TAGS and not m[4].endswith("/"):
            stack.push(tag, _hints(m[4]))
    take(page[at:])
    close_block()
    return out


def block_features(block: Block) -> list[str]:
    """Names of the features that a block shows: ancestors, hints, and what its text is like."""
    text, words = block.text, block.text.split(" ")
    n = len(words)
    size = "1" if n == 1 else "2-4" if n < 5 else "5-14" if n < 15 else "15-39" if n < 40 else "40+"
    share = block.linked / len(text)
    found = [f"in:{t}" for t in block.tags] + [f"hint:{h}" for h in block.hints]
    found += ["bias", f"own:{block.own}", f"size:{size}", f"links:{'none' if share == 0 else 'some' if share < 0.5 else 'most'}"]
    found.append(f"ends:{'stop' if text[-1] in '.!?:;' else 'other'}")
    found.append(f"commas:{min(3, text.count(','))}")
    lower = text.lower()
    found += [f"sign:{s}" for s, w in (("copy", "©"), ("rights", "rights reserved"), ("cookie", "cookie")) if w in lower]
    return found


@dataclass
class Field:
    """Weights of (feature, label), of label pairs, and of the first and last label. Label 1 is main text."""

    names: dict[str, int]
    unary: np.ndarray
    pairs: np.ndarray
    ends: np.ndarray

    def scores(self, blocks: list[Block]) -> np.ndarray:
        """(blocks, 2) unary scores; features not seen in training weigh nothing."""
        out = np.zeros((len(blocks), 2))
        for i, b in enumerate(blocks):
            at = [self.names[f] for f in block_features(b) if f in self.names]
            out[i] = self.unary[at].sum(axis=0)
        return out

    def decode(self, blocks: list[Block]) -> list[int]:
        """The labels of the likeliest sequence, by Viterbi; ties go to label 0."""
        if not blocks:
            return []
        unary = self.scores(blocks).tolist()
        pairs, (first, last) = self.pairs.tolist(), self.ends.tolist()
        best = [unary[0][y] + first[y] for y in (0, 1)]
        back: list[tuple[int, int]] = []
        for u in unary[1:]:
            came = tuple(int(best[1] + pairs[1][y] > best[0] + pairs[0][y]) for y in (0, 1))
            best = [best[came[y]] + pairs[came[y]][y] + u[y] for y in (0, 1)]
            back.append(came)
        y = int(best[1] + last[1] > best[0] + last[0])
        labels = [y]
        for came in reversed(back):
            y = came[y]
            labels.append(y)
        return labels[::-1]


def train(pages: list[tuple[str, list[int]]], rounds: int = 120, decay: float = 1e-3) -> Field:
    """Fit by gradient ascent on the mean log-likelihood of labelled pages (html, label of each leaf block)."""
    parsed = [([block_features(b) for b in leaf_blocks(page)], y) for page, y in pages]
    names = {f: i for i, f in enumerate(sorted({f for rows, _ in parsed for row in rows for f in row}))}
    longest = max(len(y) for _, y in parsed)
    x = np.zeros((len(parsed), longest, len(names)), dtype=np.float32)
    y = np.zeros((len(parsed), longest), dtype=np.int64)
    real = np.zeros((len(parsed), longest), dtype=bool)
    for i, (rows, labels) in enumerate(parsed):
        assert len(rows) == len(labels), "a label is needed for each leaf block"
        y[i, : len(labels)], real[i, : len(labels)] = labels, True
        for t, row in enumerate(rows):
            x[i, t, [names[f] for f in row]] = 1
    truth = np.eye(2)[y] * real[:, :, None]
    last = real.sum(axis=1) - 1
    all_rows = np.arange(len(parsed))
    both = real[:, 1:] & real[:, :-1]
    weights = {"unary": np.zeros((len(names), 2)), "pairs": np.zeros((2, 2)), "ends": np.zeros((2, 2))}
    state = {k: (np.zeros_like(w), np.zeros_like(w)) for k, w in weights.items()}

    def log_sum(z: np.ndarray, axis: int) -> np.ndarray:
        top = z.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(z - top).sum(axis=axis))

    for step in range(1, rounds + 1):
        unary = x @ weights["unary"]
        pairs, (first, end) = weights["pairs"], weights["ends"]
        fore, rear = np.zeros_like(unary), np.zeros_like(unary)
        fore[:, 0] = unary[:, 0] + first
        for t in range(1, longest):
            fore[:, t] = log_sum(fore[:, t - 1, :, None] + pairs, 1) + unary[:, t]
        for t in range(longest - 1, -1, -1):
            if t + 1 < longest:
                rear[:, t] = log_sum(pairs + (unary[:, t + 1] + rear[:, t + 1])[:, None, :], 2)
            rear[:, t] = np.where((last == t)[:, None], end, rear[:, t])
        total = log_sum(fore[all_rows, last] + end, 1)
        single = np.exp(fore + rear - total[:, None, None]) * real[:, :, None]
        joint = np.exp(
            fore[:, :-1, :, None] + pairs + (unary[:, 1:] + rear[:, 1:])[:, :, None, :] - total[:, None, None, None]
        )
        joint *= both[:, :, None, None]
        known = (truth[:, :-1, :, None] * truth[:, 1:, None, :]).sum(axis=(0, 1))
        gradients = {
            "unary": np.einsum("btf,bty->fy", x, truth - single),
            "pairs": known - joint.sum(axis=(0, 1)),
            "ends": np.stack([(truth - single)[:, 0].sum(axis=0), (truth - single)[all_rows, last].sum(axis=0)]),
        }
        for k, w in weights.items():
            g = gradients[k] / len(parsed) - decay * w
            m, v = state[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(names, weights["unary"], weights["pairs"], weights["ends"])


def labelled_pages(count: int, seed: int) -> list[tuple[str, list[int]]]:
    """Made-up pages of many layouts with a label for each leaf block: 1 inside the article's own text, else 0."""
    rng = np.random.default_rng(seed)
    made = []

    def pick(*some):
        return some[int(rng.integers(len(some)))]

    def words(low: int, high: int) -> str:
        n = int(rng.integers(low, high + 1))
        text = " ".join("".join(pick("an", "er", "th", "on", "re", "st", "é", "ou", "ing", "ü") for _ in range(int(rng.integers(1, 5)))) for _ in range(n))
        return text.capitalize()

    def sentence(low: int = 4, high: int = 25) -> str:
        return words(low, high) + pick(".", ".", ".", ",", "!", "?", "")

    def paragraph() -> str:
        return " ".join(sentence() for _ in range(int(rng.integers(1, 7))))

    def links(n: int) -> list[tuple[str, int]]:
        return [(f'<a href="/{i}">{words(1, 3)}</a>', 0) for i in range(n)]

    def menu() -> list[tuple[str, int]]:
        items = "".join(f"<li>{a}</li>" for a, _ in links(int(rng.integers(3, 9))))
        name = pick("menu", "nav", "navigation", "breadcrumb", "top-menu")
        open_tag, close_tag = pick(("<nav>", "</nav>"), (f'<div class="{name}">', "</div>"), ("<header>", "</header>"), (f'<div id="{name}">', "</div>"))
        return [(f"{open_tag}<ul>{items}</ul>{close_tag}", [0] * items.count("<li>"))]

    def extra() -> list[tuple[str, int]]:
        kind = pick("ad", "ad", "notice", "aside", "form", "share", "comments", "related")
        if kind == "ad":
            name = pick("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad")
            return [(f'<div class="{name}">{pick(sentence(), paragraph())}</div>', [0])]
        if kind == "notice":
            name = pick("cookie-notice", "notice", "consent", "popup", "legal-notice")
            return [(f'<div class="{name}"><p>{pick("We use cookies. ", "")}{paragraph()}</p><button>{words(1, 2)}</button></div>', [0, 0])]
        if kind == "aside":
            open_tag, close_tag = pick(("<aside>", "</aside>"), ('<div class="sidebar">', "</div>"), ('<div id="sidebar" role="complementary">', "</div>"))
            return [(f"{open_tag}<h3>{words(1, 3)}</h3><p>{paragraph()}</p>{close_tag}", [0, 0])]
        if kind == "form":
            if rng.random() < 0.3:
                n = int(rng.integers(2, 6))
                return [(f"<select>{''.join(f'<option>{words(1, 2)}' for _ in range(n))}", [0] * n)]
            return [(f'<form class="{pick("newsletter", "login", "search", "subscribe")}"><label>{words(1, 3)}</label><input name="q"><p>{sentence()}</p><button>{words(1, 2)}</button></form>', [0, 0, 0])]
        if kind == "share":
            return [(f'<div class="{pick("social", "share", "toolbar")}">{"".join(a for a, _ in links(3))}</div>', [0])]
        if kind == "related":
            return [(f'<div class="related"><h2>{words(2, 4)}</h2><ul>{"".join(f"<li>{a}</li>" for a, _ in links(4))}</ul></div>', [0] * 5)]
        n = int(rng.integers(1, 5))
        open_tag, close_tag = pick(('<section class="comments">', "</section>"), ('<div id="comments">', "</div>"), ('<ol class="comment-list">', "</ol>"))
        body = "".join(f'<div class="comment"><p>{paragraph()}</p></div>' for _ in range(n))
        return [(f"{open_tag}{body}{close_tag}", [0] * n)]

    def article() -> list[tuple[str, int]]:
        parts: list[tuple[str, list[int]]] = []
        title = pick(f"<h1>{words(3, 12)}</h1>", f"<header><h1>{words(3, 12)}</h1></header>", f"<h2>{sentence()}</h2>")
        if rng.random() < 0.9:
            parts.append((title, [1]))
        for _ in range(int(rng.integers(1, 12))):
            kind = rng.random()
            if kind < 0.62:
                parts.append((f"<p>{paragraph()}</p>", [1]))
            elif kind < 0.72:
                parts.append((f"<p><b>{paragraph()}<br>", [1]))
            elif kind < 0.78:
                parts.append((f"<h2>{words(1, 6)}</h2>", [1]))
            elif kind < 0.84:
                n = int(rng.integers(2, 5))
                parts.append((f"<ul>{''.join(f'<li>{sentence()}</li>' for _ in range(n))}</ul>", [1] * n))
            elif kind < 0.88:
                parts.append((f"<blockquote>{paragraph()}</blockquote>", [1]))
            elif kind < 0.91:
                parts.append((f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>", [1, 1]))
            elif kind < 0.94:
                parts.append((f'<p>{sentence()} <a href="/x">{words(1, 3)}</a> {sentence()}</p>', [1]))
            else:
                parts += extra()
        if rng.random() < 0.15:
            parts += extra()
        open_tag, close_tag = pick(
            ("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"),
            ('<div class="content">', "</div>"), ('<div class="post-body">', "</div>"), ('<div id="main">', "</div>"),
            ('<section class="story entry">', "</section>"), ("<div>", "</div>"),
        )
        return [(open_tag, []), *parts, (close_tag, [])]

    for _ in range(count):
        parts: list[tuple[str, list[int]]] = []
        if rng.random() < 0.9:
            parts += menu()
        for _ in range(int(rng.integers(0, 3))):
            parts += extra()
        parts += article()
        for _ in range(int(rng.integers(0, 3))):
            parts += extra()
        if rng.random() < 0.9:
            open_tag, close_tag = pick(("<footer>", "</footer>"), ("<footer>", "</footer>"), ('<div class="footer">', "</div>"), ('<div id="footer">', "</div>"))
            parts.append((f"{open_tag}{pick('&copy; ', '')}{words(1, 3)} &middot; {sentence()}{close_tag}", [0]))
        page = "<!DOCTYPE html><html><head><title>" + words(2, 6) + "</title></head><body>" + "".join(p for p, _ in parts)
        made.append((page + pick("</body></html>", ""), [y for _, ys in parts for y in ys]))
    return made


@lru_cache(maxsize=2)
def default_field(count: int = 240, seed: int = 7) -> Field:
    """The field trained on made-up labelled pages; count bounds what it is fitted on."""
    return train(labelled_pages(count, seed))


def main_text(page: str | None, chosen: Field) -> str:
    """Blocks labelled as main text, joined by blank lines; empty if there is none."""
    blocks = leaf_blocks(page or "")
    return "\n\n".join(b.text for b, y in zip(blocks, chosen.decode(blocks), strict=True) if y)


def extract(
    pages: DataFrame, html_col: str = "html", chosen: Field | None = None, text_col: str = "text"
) -> DataFrame:
    """Main text of every row's whole page: pages' other columns, then text and n_chars.

    Inside a block character references are decoded and white space becomes one space; nothing is cut or capped. A
    null or empty page, and one without main text, gives an empty text. Repeated rows and nulls in other columns are
    kept as they are; columns of pages named text or n_chars give way to the results; an empty table gives no rows.
    """
    model = chosen or default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py(), model) for p in batch.column(html_col)]
            rest = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string())], [*kept, text_col])

    kept = [c for c in pages.columns if c not in (html_col, text_col, "n_chars")]
    wanted = pages.select(*kept, F.col(html_col).cast("string"))
    schema = wanted.select(*kept, F.col(html_col).alias(text_col)).schema
    return wanted.mapInArrow(run, schema).withColumn("n_chars", F.length(text_col).cast("bigint"))
