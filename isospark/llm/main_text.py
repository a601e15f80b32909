"""Main text of web pages: boosted trees over features of their block elements, decoded from the top.

No table says which elements of a page are its article, so the trees learn from pages that are
made up here, with elements of all kinds, names and places and known parts (`made_page`): a
fixed number of pages from a fixed seed, whatever the input. A page's elements then get a
probability each, and the likeliest consistent choice is taken: from the page's root downwards
each path is outside the article at first, may enter it once, and may leave it once for good.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isospark.llm.common import held, slices, texts_of
from isospark.llm.dom import Page, attribute_tokens

#: Made pages; trees, their depth, rate and least rows of a leaf; bins of a feature.
PAGES, TREES, DEPTH, RATE, LEAST, BINS = 600, 100, 4, 0.2, 20, 32
#: What entering the article, leaving it, and leaving it at a paragraph, title or item costs beside the elements' own likelihoods.
ENTER, LEAVE, LEAVE_TEXT = 0.7, 0.8, 3.0

_KINDS = ["p", "h1", "h2", "li", "ul", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "td", "tr", "table", "blockquote", "pre", "figure", "body"]
_KIND_OF = {**{k: k for k in _KINDS}, "h3": "h2", "h4": "h2", "h5": "h2", "h6": "h2", "ol": "ul", "dl": "ul", "menu": "nav", "dt": "li", "dd": "li", "th": "td", "tbody": "table", "thead": "table", "figcaption": "p", "fieldset": "form", "search": "form", "dialog": "aside", "hgroup": "header", "center": "div"}
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr blockquote pre figcaption caption".split())
_AT = {k: i for i, k in enumerate(_KINDS)}


class TokenOdds:
    """How much likelier an attribute's word is in the article than outside, as a logarithm; 0 for words not seen."""

    def __init__(self, seen: list[tuple[set[str], int]]):
        inside, outside = Counter(), Counter()
        for tokens, label in seen:
            (inside if label else outside).update(tokens)
        n, m = max(1, sum(label for _, label in seen)), max(1, sum(not label for _, label in seen))
        self.of = {t: float(np.log((inside[t] + 0.5) / (n + 1)) - np.log((outside[t] + 0.5) / (m + 1))) for t in {*inside, *outside} if inside[t] + outside[t] >= 5}

    def range(self, attributes: str) -> tuple[float, float]:
        """The smallest and the largest of an element's words, with 0."""
        found = [self.of.get(t, 0.0) for t in attribute_tokens(attributes)]
        return min([0.0, *found]), max([0.0, *found])


def features(page: Page, odds: TokenOdds) -> np.ndarray:
    """A row of numbers for each element: its kind, words of its attributes and of those above, depth, brothers, and the texts, links and elements of its subtree."""
    n, parents = len(page.tags), page.parents
    chars, words, linked, marks, pieces = (np.zeros(n) for _ in range(5))
    before, so_far = np.zeros(n), 0.0
    first = np.full(n, -1.0)
    for element, text, link in page.texts:
        if text is None:
            continue
        size = len(text.strip())
        if not size:
            continue
        chars[element] += size
        words[element] += text.count(" ") + 1
        linked[element] += size * link
        marks[element] += text.count(".") + text.count(",") + text.count("?") + text.count("!") + text.count(";")
        pieces[element] += 1
        if first[element] < 0:
            first[element] = so_far
        so_far += size
    own_chars, own_linked = chars.copy(), linked.copy()
    below, controls, paragraphs, items = np.zeros(n), np.array(page.controls, float), np.zeros(n), np.zeros(n)
    heading = np.array([t in ("h1", "h2", "h3") for t in page.tags], float)
    children, depth = np.zeros(n), np.zeros(n)
    for i in range(n - 1, 0, -1):
        p = parents[i]
        for x in (chars, words, linked, marks, pieces, controls, heading):
            x[p] += x[i]
        below[p] += below[i] + 1
        paragraphs[p] += page.tags[i] in ("p", "blockquote", "pre")
        items[p] += page.tags[i] == "li"
        children[p] += 1
        if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
            first[p] = first[i]
    low, high = np.zeros(n), np.zeros(n)
    above_low, above_high = np.zeros(n), np.zeros(n)
    place, same = np.zeros(n), np.zeros(n)
    kinds = [_KIND_OF.get(t, "div") for t in page.tags]
    met, brothers = np.zeros(n), defaultdict(int)
    for i in range(n):
        low[i], high[i] = odds.range(page.attributes[i])
        if i:
            p = parents[i]
            depth[i] = depth[p] + 1
            place[i] = met[p]
            met[p] += 1
            brothers[p, kinds[i]] += 1
            above_low[i], above_high[i] = min(above_low[p], low[p]), max(above_high[p], high[p])
    for i in range(1, n):
        same[i] = brothers[parents[i], kinds[i]] / max(1, children[parents[i]])
    up = np.array([max(0, p) for p in parents])
    # texts of the brothers beside each
    left, right, last = np.zeros(n), np.zeros(n), {}
    for i in range(1, n):
        p = parents[i]
        if p in last:
            left[i], right[last[p]] = chars[last[p]], chars[i]
        last[p] = i
    before = np.where(first >= 0, first, so_far)
    total = max(1.0, so_far)
    one = np.maximum(chars, 1)
    kind = np.zeros((n, len(_KINDS)))
    kind[np.arange(n), [_AT[k] for k in kinds]] = 1
    inside = np.zeros((n, 4))
    for j, names in enumerate((("article", "main"), ("nav", "footer", "aside", "form"), ("header",), ("li",))):
        for i in range(1, n):
            inside[i, j] = inside[parents[i], j] or kinds[parents[i]] in names
    numbers = [
        low, high, above_low, above_high, depth, place, place / np.maximum(1, children[up]), same, children, np.log1p(chars), np.log1p(own_chars), np.log1p(words), linked / one, own_linked / np.maximum(own_chars, 1),
        marks / one, chars / np.maximum(1, pieces), np.log1p(below), chars / (below + 1), paragraphs / np.maximum(1, children), items / np.maximum(1, children), controls / (below + 1), heading / (below + 1), chars / total, before / total,
        chars[up] / total, linked[up] / one[up], paragraphs[up] / np.maximum(1, children[up]), np.log1p(left), np.log1p(right), chars / one[up],
    ]
    return np.column_stack([*numbers, kind, inside])


@dataclass
class Trees:
    """Boosted regression trees of one depth: of each inner node a feature and a cut, of each leaf a value."""

    at: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def probability(self, rows: np.ndarray) -> np.ndarray:
        total, each = np.full(len(rows), self.start), np.arange(len(rows))
        for at, cut, leaf in zip(self.at, self.cut, self.leaf, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (rows[each, at[node]] > cut[node])
            total += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def boosted(rows: np.ndarray, labels: np.ndarray, trees: int = TREES) -> Trees:
    """Gradient boosting of the logistic loss, by histograms of the features' quantile bins; each level of a tree is split at once."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in rows.T]
    binned = np.stack([np.searchsorted(q, c, "left") for q, c in zip(cuts, rows.T, strict=True)])  # bin b: above cuts b - 1, up to cut b
    start = float(np.log(max(labels.mean(), 1e-6) / max(1 - labels.mean(), 1e-6)))
    total, inner = np.full(len(rows), start), 2**DEPTH - 1
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = labels - p, p * (1 - p)
        node = np.zeros(len(rows), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            gain, best = np.zeros(width), np.full(width, -1, np.int64)
            slot = node - first
            for f in range(len(cuts)):
                if not len(cuts[f]):
                    continue
                G, H, N = (np.bincount(slot * BINS + binned[f], w, width * BINS).reshape(width, BINS).cumsum(1) for w in (g, h, None))
                gl, hl, nl = G[:, :-1], H[:, :-1], N[:, :-1]
                ga, ha, na = G[:, -1:], H[:, -1:], N[:, -1:]
                score = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
                score = np.where((nl >= LEAST) & (na - nl >= LEAST), score, 0.0)[:, : len(cuts[f])]
                k = score.argmax(1)
                better = score[np.arange(width), k] > gain + 1e-9
                gain = np.where(better, score[np.arange(width), k], gain)
                best = np.where(better, f * BINS + k, best)
            for s in np.flatnonzero(best >= 0).tolist():
                out.at[t, first + s], out.cut[t, first + s] = best[s] // BINS, cuts[best[s] // BINS][best[s] % BINS]
            node = 2 * node + 1 + (rows[np.arange(len(rows)), out.at[t][node]] > out.cut[t][node])
        slot = node - inner
        out.leaf[t] = RATE * np.bincount(slot, g, inner + 1) / (np.bincount(slot, h, inner + 1) + 1)
        total += out.leaf[t][slot]
    return out


def decoded(page: Page, probability: np.ndarray) -> list[bool]:
    """Which elements are the article: the likeliest choice in which each path from the root is outside, then inside, then left for good.

    So nothing inside an element that is left is kept, nor a part of what is beside the article,
    and each element that is kept is below kept ones up to where its path enters.
    """
    parents, p = page.parents, np.clip(probability, 1e-6, 1 - 1e-6)
    leave = [LEAVE_TEXT if t in _TEXTUAL else LEAVE for t in page.tags]
    out_cost, in_cost = (-np.log(1 - p)).tolist(), (-np.log(p)).tolist()
    outside, inside, left = out_cost[:], in_cost[:], out_cost[:]
    for i in range(len(parents) - 1, 0, -1):
        up = parents[i]
        outside[up] += min(outside[i], inside[i] + ENTER)
        inside[up] += min(inside[i], left[i] + leave[i])
        left[up] += left[i]
    state = [0] * len(parents)
    for i in range(1, len(parents)):
        above = state[parents[i]]
        if above == 0:
            state[i] = int(inside[i] + ENTER < outside[i])
        elif above == 1:
            state[i] = 1 + int(left[i] + leave[i] < inside[i])
        else:
            state[i] = 2
    return [s == 1 for s in state]


# Names that pages give to their parts.
_ARTICLE_NAMES = "article content post entry story main body text blog news detail single page column primary".split()
_OTHER_NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav pagination pager tabs links skip dropdown toc".split(),
    "header": "header masthead branding logo top topbar hero site banner title".split(),
    "footer": "footer bottom copyright legal colophon credits site foot".split(),
    "aside": "sidebar aside widget related recommended rail secondary popular trending more archive tags author".split(),
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay message disclaimer privacy warning toast".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adsense commercial banner".split(),
    "form": "form search login signup contact subscribe newsletter register".split(),
    "comments": "comments comment respond reply replies discussion disqus feedback reader".split(),
    "share": "share social sharing follow buttons".split(),
}


@lru_cache(maxsize=1)
def _made_words() -> list[str]:
    rng = np.random.default_rng(4)
    return ["".join(np.array(list("etaonrishdlu"))[rng.integers(0, 12, k)]) for k in rng.integers(1, 10, 4000)]


class _Maker:
    """One made page; elements of the article carry data-y=1, all others data-y=0."""

    def __init__(self, rng: np.random.Generator):
        self.rng, self.named, self.many = rng, rng.random() < 0.8, float(rng.choice([0.3, 0.7, 1.0, 1.4]))

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def pick(self, options):
        return options[int(self.rng.integers(len(options)))]

    def words(self, n: int, marks: bool = True) -> str:
        out = [_made_words()[k] for k in self.rng.integers(0, 4000, n).tolist()]
        for k in np.flatnonzero(self.rng.random(n) < 0.12).tolist() if marks else ():
            out[k] += self.pick(",.;?")
        return (" ".join(out)).capitalize() + ("." if marks else "")

    def link(self, n: int = 2) -> str:
        return f'<a href="/{self.words(1, False)}">{self.words(int(self.rng.integers(1, n + 1)), False)}</a>'

    def attributes(self, names: list[str]) -> str:
        if not self.named or self.chance(0.2):
            return f' class="{self.pick(["c", "x", "row", "col", "inner", "wrap", "box", "block"])}{int(self.rng.integers(99))}"' if self.chance(0.4) else ""
        name = self.pick(names) + (self.pick(["", "", "-", "_"]) + self.pick(["box", "wrapper", "container", "inner", "area", "list", "item", "1"]) if self.chance(0.4) else "")
        return f' {self.pick(["class", "class", "id"])}="{self.pick(["", "", "site-", "l-", "c-"])}{name}"'

    def element(self, tag: str, label: int, inner: str, names: list[str] | None = None) -> str:
        return f'<{tag}{self.attributes(names) if names else ""} data-y="{label}">{inner}</{tag}>'

    def other(self, kind: str) -> str:
        e, names = lambda tag, inner: self.element(tag, 0, inner), _OTHER_NAMES[kind]
        links = lambda n: self.element("ul", 0, "".join(e("li", self.link()) for _ in range(n)))
        k = int(self.rng.integers(2, 9))
        if kind == "nav":
            inner = links(k) if self.chance(0.7) else " | ".join(self.link() for _ in range(k))
            tag = self.pick(["nav", "nav", "div", "ul", "header"])
            inner = "".join(e("li", self.link()) for _ in range(k)) if tag == "ul" else inner
        elif kind == "header":
            inner, tag = (e("h1", self.link()) if self.chance(0.3) else e("div", self.words(3, False))) + (e("p", self.words(6)) if self.chance(0.5) else "") + (links(k) if self.chance(0.5) else ""), self.pick(["header", "header", "div"])
        elif kind == "footer":
            inner, tag = self.pick([f"&copy; {self.words(3, False)} &middot; {self.words(int(self.rng.integers(3, 12)))}", e("p", f"&copy; 2020 {self.words(5)}") + links(k), links(k) + self.words(8)]), self.pick(["footer", "footer", "div"])
        elif kind == "aside":
            inner = (e(self.pick(["h2", "h3", "h4", "div"]), self.words(2, False)) if self.chance(0.7) else "") + self.pick([links(k), "".join(e("p", self.words(int(self.rng.integers(5, 25)))) for _ in range(2)), "".join(e("div", self.link(6) + " " + self.words(8)) for _ in range(k))])
            tag = self.pick(["aside", "aside", "div", "section"])
        elif kind == "notice":
            inner, tag = self.pick([lambda: self.words(int(self.rng.integers(6, 30))), lambda: e("p", self.words(int(self.rng.integers(6, 30)))) + self.link() + "<button>OK</button>"])(), self.pick(["div", "div", "section", "aside", "dialog"])
        elif kind == "ad":
            inner, tag = self.pick([lambda: self.words(int(self.rng.integers(3, 25))), lambda: self.link(8), lambda: e("p", self.words(12)) + self.link()])(), self.pick(["div", "div", "aside", "section"])
        elif kind == "form":
            inner, tag = self.words(int(self.rng.integers(1, 8))) + "<label>x</label><input name=q>" * int(self.rng.integers(1, 4)) + "<button>Go</button>", "form"
            return self.element("div", 0, self.element(tag, 0, inner, names), names) if self.chance(0.3) else self.element(tag, 0, inner, names)
        elif kind == "comments":
            tag = self.pick(["section", "div", "ol", "aside"])
            one = lambda: self.element(self.pick(["div", "div", "div", "li", "article"]) if tag != "ol" else "li", 0, e("p", self.words(2, False)) * self.chance(0.6) + "".join(e("p", self.words(int(self.rng.integers(3, 40)))) for _ in range(int(self.rng.integers(1, 3)))), names)
            inner = (e(self.pick(["h2", "h3"]), self.words(2, False)) if tag != "ol" and self.chance(0.6) else "") + "".join(one() for _ in range(k)) + (self.other("form") if tag != "ol" and self.chance(0.4) else "")
        else:
            inner, tag = " ".join(self.link(1) for _ in range(k)), self.pick(["div", "ul", "p"])
            inner = "".join(e("li", self.link(1)) for _ in range(k)) if tag == "ul" else inner
        # what names nothing can only be told by what it holds, or not at all
        return self.element(tag, 0, inner, names)

    def article(self) -> str:
        e = lambda tag, inner, names=None: self.element(tag, 1, inner, names)
        n, long = int(self.rng.choice([1, 2, 2, 3, 3, 5, 8, 14, 25])), self.pick([8, 20, 30, 40, 80, 200])
        least = self.pick([2, 2, long // 2])
        text = lambda: self.words(int(self.rng.integers(least, long)))
        inline = lambda: text() if self.chance(0.7) else f"{text()} {self.link(4)} <b>{self.words(3, False)}</b> {text()}"
        parts = []
        for _ in range(n):
            r = self.rng.random()
            if r < 0.72:
                parts.append(e("p", inline()))
            elif r < 0.8:
                parts.append(e(self.pick(["h2", "h3"]), self.words(int(self.rng.integers(1, 7)), False)) + e("p", inline()))
            elif r < 0.86:
                parts.append(e(self.pick(["ul", "ol"]), "".join(e("li", inline()) for _ in range(int(self.rng.integers(2, 7))))))
            elif r < 0.9:
                parts.append(e("blockquote", self.pick([text(), e("p", text())])))
            elif r < 0.93:
                parts.append(e("figure", "<img src=x>" + e("figcaption", self.words(6))))
            elif r < 0.96:
                parts.append(e("table", "".join(e("tr", "".join(e("td", self.words(2)) for _ in range(3))) for _ in range(3))))
            else:
                parts.append(e(self.pick(["div", "section"]), "".join(e("p", inline()) for _ in range(2)), _ARTICLE_NAMES if self.chance(0.3) else None))
        if self.chance(0.15):  # texts without elements of their own
            parts = ["<br><br>".join(text() for _ in range(n + 1))]
        if self.chance(0.75):
            title = e("h1", self.words(int(self.rng.integers(2, 12)), False))
            parts.insert(0, e("header", title) if self.chance(0.2) else title)
        for _ in range(int(self.rng.choice([0, 0, 1, 2, 3]))):
            parts.insert(int(self.rng.integers(1, len(parts) + 1)), self.other(self.pick(["ad", "ad", "share", "aside", "form", "notice", "comments", "nav"])))
        if self.chance(0.15):
            parts.append(self.other(self.pick(["comments", "share", "aside", "footer"])))
        inner = "".join(parts)
        if self.chance(0.25):
            inner = e("div", inner, _ARTICLE_NAMES)
        return e(self.pick(["article", "article", "article", "article", "main", "main", "div", "div", "div", "section", "td"]), inner, _ARTICLE_NAMES)

    def page(self) -> str:
        others = lambda kinds, p: "".join(self.other(k) for k in kinds if self.chance(p * self.many))
        top = others(["notice", "ad"], 0.25) + others(["header", "nav", "form"], 0.55) + others(["ad", "aside"], 0.3)
        middle = "" if self.chance(0.05) else self.article()
        beside = others(["aside", "ad", "nav"], 0.3)
        if middle.startswith("<td"):
            columns = [middle, *[self.element("td", 0, x) for x in (beside,) if x]]
            middle = self.element("table", 0, self.element("tr", 0, "".join(columns if self.chance(0.5) else columns[::-1])))
        else:
            middle = middle + beside if self.chance(0.7) else beside + middle
        middle += others(["comments", "share", "aside"], 0.3)
        for _ in range(int(self.rng.integers(0, 3))):
            middle = self.element(self.pick(["div", "div", "div", "main", "section"]), 0, middle, ["wrapper", "container", "page", "layout", "row", "site", "main", "wrap"])
        whole = f'{top}{middle}{others(["form", "notice", "nav"], 0.2)}{others(["footer"], 0.8)}{others(["notice", "ad"], 0.15)}'
        return f'<html><head><title>{self.words(4)}</title></head><body data-y="0">{whole}</body></html>' if self.chance(0.85) else whole


def made_page(seed: int) -> str:
    return _Maker(np.random.default_rng(seed)).page()


@lru_cache(maxsize=2)
def model(pages: int = PAGES, trees: int = TREES) -> tuple[TokenOdds, Trees]:
    """Word odds and trees, learned from `pages` made pages: the same ones at any size of the input."""
    made = [Page(made_page(seed)) for seed in range(pages)]
    labels = [np.array([page.attribute(i, "data-y") == "1" for i in range(len(page.tags))], float) for page in made]
    odds = TokenOdds([(attribute_tokens(a), int(y)) for page, own in zip(made, labels, strict=True) for a, y in zip(page.attributes, own, strict=True)])
    return odds, boosted(np.concatenate([features(page, odds) for page in made]), np.concatenate(labels), trees)


def main_texts(pages: list[str], odds: TokenOdds, trees: Trees) -> Iterator[str]:
    """The main text of each page; the features of several pages go through the trees together."""
    read = [Page(x) for x in pages]
    rows = [features(page, odds) for page in read]
    chances = np.split(trees.probability(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1]) if rows else []
    for page, chance in zip(read, chances, strict=True):
        yield page.text(decoded(page, chance))


def extracted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each row of `pages`: its main text, blocks joined by line ends, and its code points.

    Null and empty pages, and those without an article, have an empty text. Pages of any length
    are read whole, whatever their markup; repeated rows and null ids stay each for itself; an
    empty table gives an empty one; other columns are not read.
    """
    learned = pages.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds, trees = held("main_text", lambda: learned.value)
        for batch in slices(batches, 64, 16):
            texts = list(main_texts(texts_of(batch.column(2)), odds, trees))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), "url", F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
