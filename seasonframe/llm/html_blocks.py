"""HTML as a sequence of leaf blocks: text between block-level tags, with the tags and names above it."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from functools import lru_cache

# Element names by their role in HTML.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var "
    "math menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle "
    "msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
VOID = frozenset("area base basefont br col embed frame hr img input keygen link meta param source track wbr".split())
HIDDEN = frozenset("annotation annotation-xml button canvas datalist iframe select svg template".split())
# All that may stand in a head; anything else, and text, ends it.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table td th tr ul xmp".split())
# An opening tag ends an open one of the second list, unless one of the third stands between.
IMPLIED = {
    "li": ("li", "ol ul menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("thead tbody tr td th", "table"),
    "tfoot": ("thead tbody tr td th", "table"), "option": ("option", "select"), "body": ("head", "html")}
IMPLIED_SETS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED.items()}
P_BARRIER = frozenset("article aside blockquote body button caption div fieldset figure footer form header li main nav object section td th".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
      | <(?P<raw>script|style|textarea|title|xmp)\b[^>]*+(?:(?<=/)>|>(?P<inside>.*?)(?:</(?P=raw)\s*>|\Z))
      | <[!?][^>]*+(?:>|\Z)
      | </(?P<close>[a-z][^\s>/]*)[^>]*+(?:>|\Z)
      | <(?P<open>[a-z][^\s>/]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
      | <(?P<bad>[a-z][^\s>/]*)[^>]*+(?:>|\Z)
      | (?P<text>[^<]++|<)""", re.S | re.I | re.X)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_MARK = re.compile(r'data-label="([01])"')
_PART = re.compile(r"[a-z0-9]+")


@dataclass(slots=True)
class Block:
    text: str
    path: tuple[str, ...]
    tag: str
    link_chars: int
    label: int


@lru_cache(maxsize=1 << 14)
def element_names(tag: str, rest: str) -> tuple[str, ...]:
    """The tag, and the words of its class, id and role."""
    words = {f".{w}" for value in _NAMES.findall(rest) for w in _PART.findall(value.lower()) if not w.isdigit() and len(w) <= 24}
    return (tag, *sorted(words))


def blocks(page: str) -> list[Block]:
    """The leaf blocks in page order, character references decoded and white space made one space.

    Tags need not balance: an end tag closes down to its opening or is ignored, paragraphs, items and cells end
    where HTML ends them, and an open head ends at the first text or tag that may not stand in it, which opens the
    body. Contents of scripts, styles, titles, fields and hidden elements are no blocks; formulas are text of their
    paragraph, and the contents of noscript, object and xmp are blocks.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], bool, int]] = []
    text: list[str] = []
    hidden = links = link_chars = 0
    head = -1

    def flush() -> None:
        nonlocal link_chars
        if text:
            joined = "".join(text)
            joined = " ".join((html.unescape(joined) if "&" in joined else joined).split())
            text.clear()
            if joined:
                path = {name for entry in stack if entry[0] not in INLINE for name in entry[1]}
                tag = next((e[0] for e in reversed(stack) if e[0] not in INLINE), "body")
                out.append(Block(joined, tuple(sorted(path)), tag, link_chars, stack[-1][3] if stack else -1))
        link_chars = 0

    def pop_to(depth: int) -> None:
        nonlocal hidden, links, head
        if depth <= head:
            head = -1
        for tag, _, is_hidden, _ in stack[depth:]:
            hidden -= is_hidden
            links -= tag == "a"
        del stack[depth:]

    def end_open(tags: frozenset[str], barrier: frozenset[str]) -> None:
        cut = None
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] in tags:
                cut = depth
            elif stack[depth][0] in barrier:
                break
        if cut is not None:
            pop_to(cut)

    def end_head(tag: str) -> None:
        if head >= 0 and not hidden and tag not in HEAD:
            pop_to(head)
            if tag != "body":
                stack.append(("body", ("body",), False, stack[-1][3] if stack else -1))

    for m in _TOKEN.finditer(page):
        kind = m.lastgroup
        if kind == "text":
            if not hidden:
                if not m["text"].isspace():
                    end_head("")
                text.append(m["text"])
                if links:
                    link_chars += len(m["text"])
        elif m["raw"]:
            tag = m["raw"].lower()
            end_head(tag)
            if tag == "xmp" and not hidden:
                flush()
                end_open(frozenset(("p",)), P_BARRIER)
                stack.append((tag, (tag,), False, stack[-1][3] if stack else -1))
                # Its text has no character references.
                text.append((m["inside"] or "").replace("&", "&amp;"))
                flush()
                pop_to(len(stack) - 1)
        elif kind in ("rest", "open", "bad"):
            tag = (m["open"] or m["bad"]).lower()
            end_head(tag)
            if tag == "br":
                if not hidden:
                    text.append(" ")
                continue
            if tag not in INLINE and tag not in ("img", "wbr", "input"):
                flush()
            if tag in VOID:
                continue
            rest = m["rest"] or ""
            if tag in CLOSES_P:
                end_open(frozenset(("p",)), P_BARRIER)
            if tag in IMPLIED_SETS:
                end_open(*IMPLIED_SETS[tag])
            if rest.endswith("/") and tag not in INLINE:
                continue
            mark = _MARK.search(rest) if "data-label" in rest else None
            stack.append((tag, element_names(tag, rest), tag in HIDDEN, int(mark[1]) if mark else stack[-1][3] if stack else -1))
            hidden += tag in HIDDEN
            if tag == "head" and head < 0:
                head = len(stack) - 1
            links += tag == "a"
        elif kind == "close":
            tag = m["close"].lower()
            if tag not in INLINE:
                flush()
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    pop_to(depth)
                    break
                if tag in INLINE and stack[depth][0] not in INLINE:
                    break
    flush()
    return out
