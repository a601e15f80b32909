"""HTML as a table of block elements and a list of texts: what a page's features and its text are made of."""

from __future__ import annotations

import re
from html import unescape

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements that break the line, and so have texts of their own.
BLOCKS = frozenset(
    "html body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is not shown, or is no text but a control.
_UNSEEN = frozenset("head title script style noscript template iframe object svg math canvas audio video textarea select button option datalist noframes noembed xmp map".split())
#: Of these, what is read up to the end tag whatever it holds.
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Of these, what holds no block: it ends where one begins.
_SHUT = frozenset("head select button option datalist".split())
#: What ends an open element of the same kind, or a paragraph, without an end tag.
_ENDS_PARAGRAPH = BLOCKS - {"html", "body", "caption", "tbody", "thead", "tfoot", "tr", "td", "th", "legend"}
_SAME = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_SAME |= {x: ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}) for x in ("tbody", "thead", "tfoot")}


class Page:
    """The block elements of a page in page order, a parent before its children, and its pieces of text.

    Element 0 is the page itself. `texts` are (element, text, whether in a link), or (element,
    None, False) where a block begins or ends. End tags that are missing, too many or crossed
    are settled as browsers do, as far as blocks go. Comments, scripts, styles, the head and
    controls give no text. References are decoded; nothing is cut.
    """

    def __init__(self, html: str):
        self.tags, self.parents, self.attributes, self.controls = ["html"], [-1], [""], [0]
        self.texts: list[tuple[int, str | None, bool]] = []
        stack: list[int] = [0]
        unseen: list[str] = []
        link, at = False, 0

        def close(depth: int) -> None:
            del stack[depth:]
            self.texts.append((stack[-1], None, False))

        pos = 0
        while True:
            found = _TOKEN.search(html, pos)
            end = found.start() if found else len(html)
            if end > at and not unseen:
                self.texts.append((stack[-1], unescape(html[at:end]), link))
            if not found:
                break
            pos = at = found.end()
            closing, tag, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
            if not tag:
                continue
            tag = tag.lower()
            if tag in _UNSEEN:
                if tag in _RAW and not closing and not attributes.endswith("/"):
                    over = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, pos)
                    pos = at = over.end() if over else len(html)
                elif closing and tag in unseen:
                    del unseen[unseen.index(tag) :]
                elif not closing and not attributes.endswith("/"):
                    unseen.append(tag)
                if not closing:
                    self.controls[stack[-1]] += tag in ("textarea", "select", "button")
                continue
            if tag in BLOCKS and unseen and _SHUT.issuperset(unseen):
                unseen = []  # a head or a button without an end tag ends here
            if unseen:
                continue
            if tag == "br":
                self.texts.append((stack[-1], " ", link))
            elif tag == "a":
                link = not closing
            elif tag in ("input", "label"):
                self.controls[stack[-1]] += not closing
            elif tag not in BLOCKS:
                continue
            elif closing:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tags[stack[k]] == tag:
                        close(k)
                        break
            elif tag == "html":
                self.attributes[0] += attributes
            elif tag == "body" and any(self.tags[i] == "body" for i in stack):
                continue
            else:
                self._open(tag, attributes, stack, close)
        self.texts.append((0, None, False))

    def _open(self, tag: str, attributes: str, stack: list[int], close) -> None:
        if tag in _ENDS_PARAGRAPH and self.tags[stack[-1]] == "p":
            close(len(stack) - 1)
        ended, within = _SAME.get(tag, ((), ()))
        for k in range(len(stack) - 1, 0, -1) if ended else ():
            open_ = self.tags[stack[k]]
            if open_ in within:
                break
            if open_ in ended:
                close(k)
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and self.tags[stack[-1]] in ("h1", "h2", "h3", "h4", "h5", "h6"):
            close(len(stack) - 1)
        self.texts.append((stack[-1], None, False))
        self.tags.append(tag)
        self.parents.append(stack[-1])
        self.attributes.append(attributes)
        self.controls.append(0)
        if tag not in _VOID:
            stack.append(len(self.tags) - 1)

    def attribute(self, i: int, name: str) -> str:
        return next((b or c or d or "" for a, b, c, d in _ATTRIBUTE.findall(self.attributes[i]) if a.lower() == name), "")

    def text(self, kept: list[bool]) -> str:
        """The texts of the kept elements: white space in a block is one space, blocks are joined by one line end, empty ones go."""
        blocks, now = [], []
        for element, text, _ in [*self.texts, (0, None, False)]:
            if text is None:
                block = " ".join("".join(now).split())
                if block:
                    blocks.append(block)
                now = []
            elif kept[element]:
                now.append(text)
        return "\n".join(blocks)


_NAMES = ("class", "id", "role", "itemprop", "aria-label", "style", "hidden", "aria-hidden")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def attribute_tokens(attributes: str) -> set[str]:
    """The words of an element's class, id, role and the like, in small letters; `hidden` is one of its own."""
    if not attributes.strip():
        return set()
    out: set[str] = set()
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in _NAMES:
            value = a or b or c
            out.update(w.lower() for w in _WORDS.findall(value))
            if name in ("hidden", "aria-hidden") and value.lower() != "false" or name == "style" and "none" in value:
                out.add("hidden")
    return out
