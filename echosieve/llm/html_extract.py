"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

Each block of a page is boilerplate or main text.  A block scores by the tags and names of its
open elements and by its text (length, share of links, ends, signs), neighbours by how well their
labels follow each other; the best labelling of a page is found by Viterbi.  The field is trained
by gradient ascent on labelled pages: a bounded sample of the table's own pages that mark their
text with one ``article`` (``SAMPLE_PAGES``), and made-up ones that show what these lack: comments
within articles, forms, notices, pages without any landmark.

Pages are parsed and decoded where they lie; only the sample's features reach the driver.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echosieve.llm.html_blocks import Block, Element, blocks

SAMPLE_PAGES = 200
MOST_BLOCKS, MOST_DEPTH = 400, 200  # of a page of the sample; others do not train
MADE_PAGES = 160
ROUNDS = 150

#: Names of elements that are no main text even within an article.
ASIDE_TAGS = {"nav", "aside", "footer", "form", "button", "noscript", "select"}
ASIDE_NAMES = {
    "ad", "ads", "advert", "banner", "comment", "comments", "cookie", "newsletter", "promo",
    "related", "replies", "share", "sidebar", "social",
}


def place_features(element: Element) -> list[str]:
    """What an element says of a block in it, but for its tags and names."""
    return ["bias", f"inner:{element.inner}", f"depth:{min(element.depth, 12) // 3}"]


def path_features(element: Element) -> list[str]:
    return place_features(element) + [f for e in element.path() for f in e.fresh]


def text_features(block: Block) -> list[str]:
    text = block.text
    size = len(text)
    words = text.count(" ") + 1
    share = block.linked / max(size, 1)
    return [
        f"words:{min(words.bit_length(), 8)}",
        "links:none" if share == 0 else "links:some" if share < 0.5 else "links:most",
        "ends" if text[-1] in ".!?:。…\"'" else "open",
        f"marks:{min(sum(map(text.count, '.,;')) * 20 // max(words, 1), 4)}",
        *(["sign"] if any(c in text for c in "©|·»") else []),
        *(["digits"] if sum(c.isdigit() for c in text[:200]) * 4 > min(size, 200) else []),
    ]


def features(page: list[Block]) -> list[list[str]]:
    rows = [path_features(b.element) + text_features(b) for b in page]
    if rows:
        rows[0].append("first")
        rows[-1].append("last")
    return rows


def landmark_labels(page: list[Block]) -> list[int] | None:
    """Labels of a page that marks its text with an article; null if it has none."""

    def label(block: Block) -> int:
        path = block.element.path()
        tags = [e.tag for e in path]
        if "article" not in tags:
            return 0
        inside = path[tags.index("article"):]
        return int(not any(e.tag in ASIDE_TAGS or ASIDE_NAMES & set(e.names) for e in inside))

    labels = [label(b) for b in page]
    return labels if any(labels) else None


# --- made-up labelled pages ------------------------------------------------------------------


def _prose(rng: random.Random, least: int, most: int) -> str:
    word = lambda: "".join(rng.choice(("ta", "ro", "min", "el", "us", "ker", "o", "an"))
                           for _ in range(rng.randint(1, 4)))
    out = [word() for _ in range(rng.randint(least, most))]
    for i in range(0, len(out), rng.randint(6, 12)):
        out[i] = out[i].capitalize()
        if i:
            out[i - 1] += rng.choice((".", ".", ","))
    return " ".join(out) + "."


def _label(rng: random.Random) -> str:
    return _prose(rng, 1, 3).rstrip(".")


def made_page(rng: random.Random) -> str:
    """A page whose main text is marked ``data-gold="1"``, all else ``data-gold="0"``."""
    links = lambda n: "".join(f'<li><a href="#">{_label(rng)}</a></li>' for _ in range(n))
    off = lambda tag, name, inner: f'<{tag}{name and f" class={chr(34)}{name}{chr(34)}"} data-gold="0">{inner}</{tag}>'
    small = lambda: f"<p>{_prose(rng, 4, 30)}</p>"
    pick = rng.choice
    before = [
        off("nav", pick(("", "menu", "main-nav")), f"<ul>{links(rng.randint(2, 8))}</ul>"),
        off("header", pick(("", "site-header", "top")), f"<div>{_label(rng)}</div>"),
        off("div", pick(("ad", "advert", "ad-banner", "promo")), pick((small(), _prose(rng, 4, 25)))),
        off("div", pick(("cookie-notice", "notice cookie", "banner consent")), small() + "<button>OK</button>"),
        off("aside", pick(("", "sidebar", "related")), small() + f"<ul>{links(4)}</ul>"),
        off("ul", pick(("breadcrumb", "menu")), links(3)),
        off("form", pick(("", "search", "login")), f"<label>{_label(rng)}</label><button>{_label(rng)}</button>"),
    ]
    after = [
        off("footer", pick(("", "site-footer")), f"&copy; {_label(rng)} &middot; {_prose(rng, 3, 20)}"),
        off("section", pick(("comments", "comment-list", "replies")), "".join(
            f'<div class="comment"><p>{_prose(rng, 5, 60)}</p></div>' for _ in range(rng.randint(1, 4)))),
        off("div", pick(("newsletter", "share social", "related")), small()),
        off("aside", pick(("sidebar", "")), small() + f"<ul>{links(5)}</ul>"),
        off("form", pick(("comment-form", "newsletter", "")), f"<p>{_label(rng)}</p><button>{_label(rng)}</button>"),
    ]
    body = [f"<h1>{_prose(rng, 3, 10).rstrip('.')}</h1>"]
    for _ in range(rng.randint(2, 9)):
        body.append(pick((
            f"<p>{_prose(rng, 12, 120)}</p>", f"<p>{_prose(rng, 12, 120)}</p>",
            f"<p>{_prose(rng, 2, 12)}</p>", f"<h2>{_label(rng)}</h2>",
            f"<ul><li>{_prose(rng, 3, 15)}</li><li>{_prose(rng, 3, 15)}</li></ul>",
            f"<blockquote>{_prose(rng, 8, 40)}</blockquote>",
            f'<p>{_prose(rng, 8, 30)} <a href="#">{_label(rng)}</a> {_prose(rng, 8, 30)}</p>',
            f"<table><tr><td>{_label(rng)}</td><td>{_label(rng)}</td></tr></table>",
            off("div", pick(("ad", "share")), _prose(rng, 2, 12)),
            f"<pre>{_prose(rng, 5, 30)}</pre>",
        )))
    inner = "".join(body) + (pick(after[1:]) if rng.random() < 0.3 else "")
    tag, name = pick((("article", ""), ("main", ""), ("div", "content"), ("div", "post-body"),
                      ("section", "entry"), ("td", "text")))
    main = f'<{tag}{name and f" class={chr(34)}{name}{chr(34)}"} data-gold="1">{inner}</{tag}>'
    head = rng.sample(before, rng.randint(1, 4))
    tail = rng.sample(after, rng.randint(1, 4))
    wrap = rng.random() < 0.3
    page = "".join(head) + main + "".join(tail)
    return f"<html><body>{'<div class=page>' if wrap else ''}{page}</body></html>"


# --- the field -------------------------------------------------------------------------------


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = ROUNDS, decay: float = 1e-3):
    """``(weights by feature, transitions)`` of the likeliest field for labelled pages (Adam).

    A feature's weight is what it adds to label 1; ``transitions[a][b]`` scores b after a.
    """
    import numpy as np

    pages = [p for p in pages if p[0]]
    index: dict[str, int] = {}
    n, longest = len(pages), max((len(rows) for rows, _ in pages), default=0)
    labels, real = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    cell, feature = [], []
    for p, (rows, own) in enumerate(pages):
        labels[p, :len(own)], real[p, :len(own)] = own, True
        for t, row in enumerate(rows):
            for f in row:
                cell.append(p * longest + t)
                feature.append(index.setdefault(f, len(index)))
    cell, feature = np.array(cell, int), np.array(feature, int)
    params = np.zeros(len(index) + 4)
    m, v = np.zeros_like(params), np.zeros_like(params)
    both = real[:, 1:] & real[:, :-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[:, :-1][both], labels[:, 1:][both]), 1)
    for k in range(1, rounds + 1):
        move = params[-4:].reshape(2, 2)
        score = np.zeros((n, longest, 2))
        score[:, :, 1] = np.bincount(cell, params[feature], n * longest).reshape(n, longest)
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for t in range(1, longest):
            step = np.logaddexp.reduce(forward[:, t - 1, :, None] + move, axis=1) + score[:, t]
            forward[:, t] = np.where(real[:, t, None], step, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(
                move + (score[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2
            )
            backward[:, t] = np.where(real[:, t + 1, None], step, 0.0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        chance = np.exp(forward + backward - total[:, None, None])[:, :, 1] * real
        pair = np.exp(
            forward[:, :-1, :, None] + move + (score + backward)[:, 1:, None, :]
            - total[:, None, None, None]
        ) * both[:, :, None, None]
        off = ((labels - chance) * real).ravel()
        grad = np.concatenate([
            np.bincount(feature, off[cell], len(index)), (seen - pair.sum((0, 1))).ravel()
        ]) / n - decay * params
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        params += 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return {f: float(params[i]) for f, i in index.items()}, params[-4:].reshape(2, 2).tolist()


def viterbi(scores: list[float], move: list[list[float]]) -> list[int]:
    """The likeliest labels for blocks whose label 1 scores ``scores``."""
    if not scores:
        return []
    (oo, oi), (io, ii) = move
    a, b, back = 0.0, scores[0], []
    for s in scores[1:]:
        back.append((b + io > a + oo, b + ii > a + oi))
        a, b = max(a + oo, b + io), max(a + oi, b + ii) + s
    label = int(b > a)
    labels = [label]
    for came in reversed(back):
        label = int(came[label])
        labels.append(label)
    return labels[::-1]


class Extractor:
    def __init__(self, weights: dict[str, float], move: list[list[float]]):
        self.weights, self.move = weights, move

    def path_score(self, element: Element) -> float:
        """Score of the tags and names of the open elements, each element's added once."""
        weight, todo = self.weights.get, []
        while element.score is None and element.parent:
            todo.append(element)
            element = element.parent
        score = element.score or 0.0
        for element in reversed(todo):
            score += sum(weight(f, 0.0) for f in element.fresh)
            element.score = score
        return score

    def labels(self, page: list[Block]) -> list[int]:
        weight = self.weights.get
        scores = [
            self.path_score(b.element)
            + sum(weight(f, 0.0) for f in place_features(b.element))
            + sum(weight(f, 0.0) for f in text_features(b))
            for b in page
        ]
        if scores:
            scores[0] += weight("first", 0.0)
            scores[-1] += weight("last", 0.0)
        return viterbi(scores, self.move)

    def text(self, html: str | None) -> str:
        page = blocks(html)
        return "\n".join(b.text for b, keep in zip(page, self.labels(page)) if keep)


def _labelled(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        rows, labels = [], []
        for html in batch.column("html"):
            page = blocks(html.as_py())
            fits = len(page) <= MOST_BLOCKS and all(b.element.depth <= MOST_DEPTH for b in page)
            own = landmark_labels(page) if fits else None
            if own:
                rows.append(features(page))
                labels.append(own)
        yield pa.RecordBatch.from_arrays([
            pa.array(rows, pa.list_(pa.list_(pa.string()))), pa.array(labels, pa.list_(pa.int32())),
        ], ["rows", "labels"])


def fit(pages: DataFrame, page_id: str = "page_id", html: str = "html",
        sample_pages: int = SAMPLE_PAGES) -> Extractor:
    """The field for a table: about ``sample_pages`` of its own pages and the made-up ones."""
    share = min(1.0, sample_pages / max(pages.count(), 1))
    drawn = F.pmod(F.xxhash64(F.lit(3), page_id), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    own = (
        pages.filter(drawn).select(F.col(html).alias("html"))
        .mapInArrow(_labelled, "rows array<array<string>>, labels array<int>")
        .collect()
    )
    rng = random.Random(5)
    made = []
    for _ in range(MADE_PAGES):
        page = blocks(made_page(rng))
        made.append((features(page), [b.gold for b in page]))
    return Extractor(*train([*((r["rows"], r["labels"]) for r in own), *made]))


def _extract(weights, move):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        extractor = Extractor(weights, move)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [extractor.text(page.as_py()) for page in batch.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return run


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
              extractor: Extractor | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)``: the main blocks of every page, a line each.

    Character references are decoded, white space within a block is one blank, nothing is cut.
    A null or empty html and a page without main text give an empty text.  Repeated rows and
    null ids stay; other columns are ignored.
    """
    field = extractor or fit(pages, page_id, html)
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.col(html).alias("html"),
    )
    return rows.mapInArrow(
        _extract(field.weights, field.move), "page_id long, url string, text string, n_chars long"
    )
