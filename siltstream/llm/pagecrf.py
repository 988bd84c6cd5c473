"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A page is read tag by tag into leaf blocks: runs of text between block-level tags, each with its open
elements. A block's features are its ancestors' tags, the words of their classes, ids and roles, the
element that holds it, its length, punctuation and share of link text. A two-label chain (main or not)
with transitions between neighbouring blocks is trained by gradient on the conditional likelihood of
labelled pages, and each page is decoded by Viterbi's algorithm.

The labelled pages are written here, by `labelled_pages`: a grammar of page layouts with known main
blocks (articles in different wrappers; menus, headers, footers, sidebars, notices, adverts, forms and
reader comments around and inside them), since the tables hold no labels. Their number and seed are
parameters; nothing is learned from the pages that are extracted.

Defined results: null, empty or textless html gives an empty text. Unclosed and misnested tags, stray <, and
unfinished comments are read as browsers do, as far as text goes. Blocks are whole, in page order, one space
between; white space inside is one space; character references are decoded. A page of any length is read whole, in
time and memory that grow with its own length. Of equally likely labels a block is not main. One row out for one row
in, repeated pages too; an empty table gives an empty one. Columns other than those asked for are not read, whatever their names.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import small_batches
from ._shared import begin_stage

# Fixed values of the HTML standard: elements by kind.
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
SKIPPED = frozenset("script style title textarea noscript iframe xmp noembed noframes template svg math object canvas audio video".split())
#: Elements whose name says what they hold.
TELLING = frozenset("article aside footer form header main menu nav button dialog search select".split())
#: A start tag that ends an open element of these, within the nearest of the second set.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Whatever a < can begin. Nothing here backtracks, so a tag costs its own length.
TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)?)?|=)*+)(?P<shut>>?)",
    re.DOTALL,
)
#: An open p ends where a block begins, unless one of these stands between.
P_HOLDERS = ("td", "th", "table", "button", "article", "section", "div", "li")
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-label|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
#: What the words of classes, ids and roles speak of.
SPEAKS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pager pagination toc tabs skip",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner dfp adsense teaser outbrain taboola",
    "notice": "cookie cookies consent notice gdpr popup modal overlay alert dialog newsletter subscribe subscription paywall toast disclaimer warning",
    "comment": "comment comments reply replies disqus discussion respond reader readers feedback thread review reviews",
    "side": "sidebar side aside related widget widgets recommend recommended share sharing social complementary trending popular more rail tags author byline meta",
    "foot": "footer foot bottom copyright legal contentinfo colophon",
    "head": "header head masthead topbar top logo brand branding",
    "form": "form search login signin signup register contact",
    "main": "article content main post entry story text body copy prose document maincontent articlebody",
}
WORD_SPEAKS = {w: k for k, words in SPEAKS.items() for w in words.split()}


@dataclass
class Block:
    text: str
    features: tuple[str, ...]


def _words_of(attrs: str) -> list[str]:
    """Features of a start tag's attributes."""
    out = []
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            out.append("hidden")
        elif name != "style":
            for w in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()):
                if w in WORD_SPEAKS:
                    out.append(f"says {WORD_SPEAKS[w]}")
    return out


def _length(n: int) -> str:
    return "1" if n < 2 else "2-4" if n < 5 else "5-9" if n < 10 else "10-19" if n < 20 else "20-49" if n < 50 else "50+"


class Open:
    """The open elements. Every step takes constant time on average, however deep they are: by name there are the places of the open ones; an inline element that ends below others stays as an empty place until those above it go."""

    def __init__(self):
        self.names: list[str | None] = []  # None: an empty place
        self.features: list[tuple[str, ...]] = []  # of the element and those above
        self.nearest: list[str] = []  # what the nearest element that tells says
        self.holder: list[str] = []  # the nearest block
        self.blocks: list[int] = []  # how many blocks there are up to here
        self.at: dict[str, list[int]] = {}

    def last(self, *names: str) -> int:
        """The place of the innermost of these that is open, or -1."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def push(self, name: str, features: tuple[str, ...], nearest: str) -> None:
        self.at.setdefault(name, []).append(len(self.names))
        block = name in BLOCK
        self.holder.append(name if block else self.holder[-1] if self.holder else "body")
        self.blocks.append((self.blocks[-1] if self.blocks else 0) + block)
        self.names.append(name)
        self.features.append(features)
        self.nearest.append(nearest)

    def blocks_from(self, k: int) -> bool:
        return self.blocks[-1] > (self.blocks[k - 1] if k else 0)

    def cut(self, k: int) -> None:
        """Ends the elements from place k."""
        for name in self.names[k:]:
            if name is not None:
                self.at[name].pop()
        for x in (self.names, self.features, self.nearest, self.holder, self.blocks):
            del x[k:]

    def end_inline(self, name: str) -> None:
        """Ends the innermost of this name alone."""
        self.names[self.at[name].pop()] = None
        while self.names and self.names[-1] is None:
            for x in (self.names, self.features, self.nearest, self.holder, self.blocks):
                x.pop()


def blocks(page: str | None) -> list[Block]:
    """The page's leaf blocks that have text, in order. One pass forward, in time that grows with the page's length; as in browsers, a tag that the page's end cuts off is no text."""
    if not page:
        return []
    out: list[Block] = []
    open_ = Open()
    parts: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        if not parts:
            return
        text = " ".join(html.unescape("".join(parts)).split())
        link = linked
        parts.clear()
        linked = 0
        if not text:
            return
        share = link / len(text)
        own = (
            f"in {open_.holder[-1] if open_.holder else 'body'}",
            f"words {_length(text.count(' ') + 1)}",
            "links " + ("none" if link == 0 else "some" if share < 0.5 else "most"),
            "stops" if text[-1] in ".!?…。\"”»" else "no stop",
            f"nearest {open_.nearest[-1] if open_.nearest else 'nothing'}",
            *(["copyright"] if "©" in text[:40] or "(c)" in text[:40].lower() else []),
            "bias",
        )
        out.append(Block(text, (*(open_.features[-1] if open_.features else ()), *own)))

    def cut(k: int) -> None:
        if open_.blocks_from(k):
            flush()
        open_.cut(k)

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            parts.append(text)
            if open_.at.get("a"):
                linked += len(text)
        if m is None:
            break
        at = m.end()
        name = m["name"]
        if name is None:
            if m[0].startswith("<![CDATA["):
                parts.append(" ")
            continue
        if not m["shut"]:
            break
        name = name.lower()
        if m["end"]:
            if name == "br":
                parts.append(" ")
            elif not open_.at.get(name):
                if name in BLOCK:
                    flush()
            elif name in BLOCK:
                cut(open_.last(name))
            else:
                open_.end_inline(name)
            continue
        if name in SKIPPED:
            if name == "svg" and m["attrs"].rstrip().endswith("/"):
                continue
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.IGNORECASE).search(page, at)
            at = close.end() if close else n
            if name in ("iframe", "video", "object"):
                flush()
            continue
        if name in BLOCK:
            if name != "option" and name != "button" and (k := open_.last("p")) > open_.last(*P_HOLDERS):
                cut(k)
            flush()
            if name in CLOSES:
                ends, within = CLOSES[name]
                if (k := open_.last(*ends)) > open_.last(*within):
                    cut(k)
        elif name in VOID:
            parts.append(" " if name in ("br", "img", "input") else "")
        if name in VOID:
            continue
        above = open_.features[-1] if open_.features else ()
        said = _words_of(m["attrs"])
        telling = [f for f in said if f != "says main"] or ([name] if name in TELLING else said)
        nearest = telling[0] if telling else open_.nearest[-1] if open_.nearest else "nothing"
        new = [f for f in ([f"under {name}"] if name in BLOCK else []) + said if f not in above]
        open_.push(name, (*above, *dict.fromkeys(new)), nearest)
    flush()
    return out


# -- labelled pages


def _sentence(r: random.Random, words: list[str], n: int) -> str:
    return " ".join(r.choice(words) for _ in range(n)).capitalize() + r.choice([".", ".", ".", "!", "?", ""])


def labelled_pages(n: int = 600, seed: int = 11) -> list[tuple[str, list[str]]]:
    """(html, its main blocks' texts): layouts put together by chance, with the same texts in main and other blocks, so that length alone tells little."""
    r = random.Random(seed)
    words = ["".join(r.choice(["an", "er", "tion", "is", "ou", "ar", "en", "st", "la", "mi", "do"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    out = []
    for number in range(n):
        main: list[str] = []
        mark = [number * 1000]

        def said(short: bool = False, keep: bool = False) -> str:
            mark[0] += 1
            text = f"{_sentence(r, words, r.choice([1, 2, 3, 5] if short else [3, 6, 12, 20, 45, 80]))[:-1]} {mark[0]}{r.choice(['.', '.', '!', ''])}"
            if keep:
                main.append(text)
            return text

        def tag(name: str, inner: str, *classes: str) -> str:
            said_class = f' {r.choice(["class", "class", "id"])}="{r.choice(classes)}"' if classes and r.random() < 0.9 else ""
            return f"<{name}{said_class}>{inner}</{name}>"

        def links(k: int) -> str:
            return "".join(f'<li><a href="/{i}">{said(True)}</a></li>' for i in range(k))

        def others(k: int) -> str:
            return "".join(
                r.choice(
                    [
                        lambda: tag("nav", f"<ul>{links(r.randint(2, 6))}</ul>"),
                        lambda: f'<div class="{r.choice(["menu", "navbar", "breadcrumb", "nav-links"])}"><ul>{links(r.randint(2, 6))}</ul></div>',
                        lambda: f'<div{r.choice(["", " class=x1", " class=bar"])}>' + r.choice([" ", " | ", ""]).join(f'<a href="/{i}">{said(True)}</a>' for i in range(r.randint(2, 6))) + "</div>",
                        lambda: f'<div class="{r.choice(["ad", "ads", "advert", "ad-banner", "sponsored", "promo-box"])}">{r.choice(["{}", "<p>{}</p>", "<p>{}</p><p>{}</p>", "<h3>{}</h3><p>{}</p>"]).replace("{}", said())}</div>',
                        lambda: f'<div class="{r.choice(["cookie-notice", "gdpr consent", "newsletter", "modal popup", "alert"])}" role="{r.choice(["alert", "dialog", ""])}"><p>{said()}</p><button>{said(True)}</button></div>',
                        lambda: f'<aside class="{r.choice(["sidebar", "related", "", "widget"])}"><h3>{said(True)}</h3><p>{said()}</p><ul>{links(3)}</ul></aside>',
                        lambda: f'<div class="{r.choice(["sidebar", "related-posts", "widget", "social share"])}"><h4>{said(True)}</h4><p>{said()}</p></div>',
                        lambda: f'<form action="/s"><label>{said(True)}</label><input><button>{said(True)}</button><p>{said()}</p></form>',
                    ]
                )()
                for _ in range(k)
            )

        def comments() -> str:
            each = "".join(f'<{t}{c}><p>{said()}</p></{t}>' for t, c in [(r.choice(["div", "li", "article"]), r.choice([' class="comment"', ' class="reply"', ""])) for _ in range(r.randint(1, 4))])
            return f'<{(t := r.choice(["section", "div", "ol"]))} {r.choice(["class", "id"])}="{r.choice(["comments", "comment-list", "disqus_thread", "reader-comments", "discussion"])}"><h3>{said(True)}</h3>{each}</{t}>'

        def body() -> str:
            parts = []
            for _ in range(r.randint(1, 8)):
                kind = r.random()
                if kind < 0.62:
                    t = said(keep=True)
                    w = t.split(" ")
                    if len(w) > 8 and r.random() < 0.3:  # with a link inside
                        k = r.randrange(len(w) - 3)
                        parts.append(f'<p>{" ".join(w[:k])} <a href="/y">{" ".join(w[k : k + 3])}</a> {" ".join(w[k + 3 :])}</p>')
                    else:
                        parts.append(f"<p>{t}</p>" if r.random() < 0.85 else f"<p><b>{t}<br>")
                elif kind < 0.72:
                    h = r.choice(["h2", "h3"])
                    parts.append(f"<{h}>{said(True, True)}</{h}>")
                elif kind < 0.8:
                    parts.append("<ul>" + "".join(f"<li>{said(keep=True)}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
                elif kind < 0.85:
                    parts.append(f"<blockquote>{said(keep=True)}</blockquote>")
                elif kind < 0.88:
                    parts.append(f"<pre>{said(keep=True)}</pre>")
                elif kind < 0.91:
                    parts.append(f"<table><tr><td>{said(True, True)}</td><td>{said(True, True)}</td></tr></table>")
                elif kind < 0.92:
                    parts.append(f"<div>{said(keep=True)}</div>")
                else:
                    parts.append(others(1))
            return "".join(parts)

        heading = f"<h1>{said(True, True)}</h1>" if r.random() < 0.85 else ""
        if heading and r.random() < 0.15:
            heading = f"<header>{heading}</header>"
        inner = heading + body()
        tail = comments() if r.random() < 0.45 else ""
        inside = r.random() < 0.5
        if inside:
            inner += tail
        inner = r.choice(
            [
                lambda: tag("article", inner, "post", "", "story"),
                lambda: f"<article>{inner}</article>",
                lambda: f"<main><article>{inner}</article></main>",
                lambda: f"<main>{inner}</main>",
                lambda: f'<div {r.choice(["class", "id"])}="{r.choice(["content", "post-body", "entry-content", "article", "main", "story text"])}">{inner}</div>',
                lambda: f'<div role="main">{inner}</div>',
                lambda: f"<div>{inner}</div>",
                lambda: inner,
            ]
        )()
        if not inside:
            inner += tail
        head = r.choice([f'<header><a href="/">{said(True)}</a><p>{said()}</p></header>', f'<div class="{r.choice(["header", "masthead", "topbar"])}"><h1>{said(True)}</h1></div>', ""])
        foot = r.choice([f"<footer>&copy; {said(True)} &middot; {said()}</footer>", f'<div class="footer"><p>{said()}</p></div>', f"<footer><p>{said()}</p><ul>{links(3)}</ul></footer>", ""])
        whole = others(r.randint(0, 2)) + inner + others(r.randint(0, 2))
        if r.random() < 0.3:
            whole = f'<div class="{r.choice(["wrapper", "container", "page", "site"])}">{whole}</div>'
        out.append((f"<!DOCTYPE html><html><head><title>{said(True)}</title><style>p{{margin:0}}</style></head><body>{head}{whole}{foot}</body></html>", main))
    return out


def labels_of(found: list[Block], main: list[str]) -> np.ndarray:
    """Which of a labelled page's blocks are main: those whose text is one of the main texts."""
    wanted = {" ".join(t.split()) for t in main}
    return np.array([b.text in wanted for b in found], np.int64)


class ChainField:
    """Weights for each feature and label, and for each pair of neighbouring labels."""

    def __init__(self, weights: dict[str, tuple[float, float]], moves: np.ndarray):
        self.weights, self.moves = weights, moves

    @classmethod
    def train(cls, pages: list[tuple[list[Block], np.ndarray]], steps: int = 200, rate: float = 0.3, penalty: float = 1e-3) -> "ChainField":
        """Adagrad on the penalised conditional log likelihood, all pages at once."""
        pages = [(b, y) for b, y in pages if b]
        names = sorted({f for b, _ in pages for x in b for f in x.features})
        number = {f: i for i, f in enumerate(names)}
        longest, n = max(len(b) for b, _ in pages), len(pages)
        y, on = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
        where, which = [], []
        for i, (b, labels) in enumerate(pages):
            y[i, : len(b)], on[i, : len(b)] = labels, True
            for t, x in enumerate(b):
                where += [i * longest + t] * len(x.features)
                which += [number[f] for f in x.features]
        where, which = np.array(where), np.array(which)
        w, moves = np.zeros((len(names), 2)), np.zeros((2, 2))
        seen_w, seen_m = np.full_like(w, 1e-6), np.full_like(moves, 1e-6)
        gold = np.zeros((n * longest, 2))
        gold[np.flatnonzero(on.ravel()), y.ravel()[on.ravel()]] = 1
        both = on[:, 1:] & on[:, :-1]
        gold_moves = np.zeros((2, 2))
        np.add.at(gold_moves, (y[:, :-1][both], y[:, 1:][both]), 1)
        for _ in range(steps):
            score = np.zeros((n * longest, 2))
            for k in (0, 1):
                score[:, k] = np.bincount(where, w[which, k], n * longest)
            s = score.reshape(n, longest, 2)
            ahead, back = np.zeros_like(s), np.zeros_like(s)
            ahead[:, 0] = s[:, 0]
            for t in range(1, longest):
                step = np.logaddexp(ahead[:, t - 1, 0, None] + moves[0], ahead[:, t - 1, 1, None] + moves[1]) + s[:, t]
                ahead[:, t] = np.where(on[:, t, None], step, ahead[:, t - 1])
            for t in range(longest - 2, -1, -1):
                x = s[:, t + 1] + back[:, t + 1]
                step = np.logaddexp(moves[:, 0] + x[:, 0, None], moves[:, 1] + x[:, 1, None])
                back[:, t] = np.where(on[:, t + 1, None], step, 0)
            total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
            p = np.where(on[..., None], np.exp(ahead + back - total[:, None, None]), 0).reshape(-1, 2)
            pair = np.exp(ahead[:, :-1, :, None] + moves + (s + back)[:, 1:, None, :] - total[:, None, None, None]) * both[..., None, None]
            rest = gold - p
            g = np.stack([np.bincount(which, rest[where, k], len(names)) for k in (0, 1)], 1) - penalty * n * w
            gm = gold_moves - pair.sum((0, 1)) - penalty * n * moves
            seen_w += g * g
            seen_m += gm * gm
            w += rate * g / np.sqrt(seen_w)
            moves += rate * gm / np.sqrt(seen_m)
        return cls({f: (float(w[i, 0]), float(w[i, 1])) for f, i in number.items()}, moves)

    def decode(self, found: list[Block]) -> list[bool]:
        """The likeliest labels of a page's blocks (Viterbi); of equal ones, not main."""
        if not found:
            return []
        get, none = self.weights.get, (0.0, 0.0)
        (m00, m01), (m10, m11) = self.moves.tolist()
        a = b = 0.0
        came = []
        for t, x in enumerate(found):
            u = v = 0.0
            for f in x.features:
                p, q = get(f, none)
                u += p
                v += q
            if t:
                to0, to1 = b + m10 > a + m00, b + m11 > a + m01
                came.append((to0, to1))
                a, b = u + (b + m10 if to0 else a + m00), v + (b + m11 if to1 else a + m01)
            else:
                a, b = u, v
        label = b > a
        out = [label]
        for to0, to1 in reversed(came):
            label = to1 if label else to0
            out.append(label)
        return out[::-1]


_trained: dict[tuple[int, int], ChainField] = {}


def trained(n: int = 600, seed: int = 11) -> ChainField:
    """The field of n labelled pages, trained once in a process."""
    if (n, seed) not in _trained:
        pages = [(b := blocks(page), labels_of(b, main)) for page, main in labelled_pages(n, seed)]
        _trained[n, seed] = ChainField.train(pages)
    return _trained[n, seed]


def main_text(field: ChainField, page: str | None) -> str:
    found = blocks(page)
    return " ".join(b.text for b, on in zip(found, field.decode(found), strict=True) if on)


def extract_pages(pages: DataFrame, field: ChainField, keep: tuple[str, ...] = ("page_id", "url"), page: str = "html") -> DataFrame:
    """The columns `keep`, text and n_chars of each row."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema)

    def extracted(batches):
        begin_stage("pages")
        for batch in small_batches(batches, 4 << 20):
            texts = [main_text(field, x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return pages.select(F.col(page).cast("string").alias("_html"), *keep).mapInArrow(extracted, f"{schema}, text string, n_chars long")


def op10_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), trained())


#: What the tables' pages hold as their article; of the references only those that occur there.
OP10_SQL = r"""
WITH inner_html AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '<[^>]*>', ' ', 'g') AS t FROM pages),
plain AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM inner_html)
SELECT page_id, url, text, length(text) AS n_chars FROM plain
"""
