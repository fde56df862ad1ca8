"""Pages as sequences of text blocks with their tag paths."""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

#: Elements that do not end a block (fixed values).
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math mfrac mi mn mo mover mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split())
#: Elements without content or end tag (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is not shown in the page (fixed values).
HIDDEN = frozenset("template svg select head".split())
#: Elements whose content has no tags and is no text of the page (fixed values).
RAW = frozenset("script style title textarea iframe".split())
#: Elements that an open element of the same group ends (fixed values).
ENDS = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]), "select": frozenset(["select"])}
#: Containers that such an end does not reach out of (fixed values).
WALLS = frozenset("ul ol dl table article section div body main aside nav form blockquote td th".split())
#: Block elements that end an open paragraph (fixed values).
NO_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(class|id|role|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z0-9]+")


class Block(NamedTuple):
    text: str
    #: Place of the innermost open element in the page's elements; -1 without one.
    at: int
    #: Characters of the text inside links.
    linked: int
    #: Value of the nearest data-y attribute; training pages carry their labels there.
    mark: str


class Page(NamedTuple):
    """Blocks in order, and the elements around them: each knows its parent, so paths share what they have in common."""

    blocks: list[Block]
    #: Place of each element's parent, -1 without one; parents come first.
    parent: list[int]
    #: Name of each element and words of its classes and ids, e.g. "t:div", "c:menu".
    names: list[tuple[str, ...]]

    def path(self, block: Block) -> list[str]:
        """Names around a block, outermost first."""
        out, at = [], block.at
        while at >= 0:
            out.append(self.names[at])
            at = self.parent[at]
        return [n for names in reversed(out) for n in names]


def _names(tag: str, attrs: str) -> tuple[tuple[str, ...], str]:
    out, mark = [f"t:{tag}"], ""
    if attrs:
        for m in _ATTR.finditer(attrs):
            value = m[2] or m[3] or m[4] or ""
            if m[1].lower() == "data-y":
                mark = value
            else:
                out += [f"c:{w}" for w in _PART.findall(value.lower())]
    return tuple(out), mark


def parse(page: str) -> Page:
    """Text blocks of a page in order; references decoded, white space made single, empty blocks left out.

    Text that ends inside a tag or comment ends there. Unknown and unclosed
    elements are taken as they come. Elements of HIDDEN without an end tag end
    where a block starts, at the latest with the element around them; an
    unclosed script ends with the page, other elements of RAW at the next tag.
    Work grows with the page's length, however deep its elements are nested.
    """
    out, parent, names_of = [], [], []
    stack: list[tuple[str, int, str]] = []  # (tag, place, nearest mark)
    open_now: Counter[str] = Counter()
    inline_now: list[Counter[str]] = [Counter()]  # inline elements since each other element
    held: list[str] = []
    linked, hidden, n = 0, 0, len(page)
    last_end: dict[str, int] = {}

    def ends_later(tag: str, at: int) -> bool:
        if tag not in last_end:
            last_end[tag] = max((m.start() for m in re.finditer(rf"</{tag}\b", page, re.I)), default=-1)
        return last_end[tag] >= at

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append(Block(text, stack[-1][1] if stack else -1, min(linked, len(text)), stack[-1][2] if stack else ""))
        linked = 0

    def push(tag: str, attrs: str) -> None:
        nonlocal hidden
        names, mark = _names(tag, attrs)
        parent.append(stack[-1][1] if stack else -1)
        names_of.append(names)
        stack.append((tag, len(parent) - 1, mark or (stack[-1][2] if stack else "")))
        open_now[tag] += 1
        hidden += tag in HIDDEN
        if tag in INLINE:
            inline_now[-1][tag] += 1
        else:
            inline_now.append(Counter())

    def pop_to(at: int) -> None:
        nonlocal hidden
        while len(stack) > at:
            tag = stack.pop()[0]
            open_now[tag] -= 1
            hidden -= tag in HIDDEN
            if tag in INLINE:
                inline_now[-1][tag] -= 1
            else:
                inline_now.pop()

    def last(tags: frozenset[str], walls: frozenset[str] = frozenset()) -> int | None:
        """Place in the stack of the last open element of ``tags`` that no wall is in front of."""
        if any(open_now[t] for t in tags):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in tags:
                    return i
                if stack[i][0] in walls:
                    return None
        return None

    def text_run(part: str) -> None:
        nonlocal linked
        if part and not hidden:
            held.append(part)
            if open_now["a"]:
                linked += len(part)

    at = 0
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            text_run(page[at:])
            break
        text_run(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in INLINE:
                if inline_now[-1][tag]:
                    pop_to(last(frozenset([tag])))
            else:
                flush()
                place = last(frozenset([tag]))
                if place is not None:
                    pop_to(place)
            continue
        attrs = m[3] or m[6] or ""
        if tag in RAW:
            flush()
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at) if ends_later(tag, at) else None
            at = end.end() if end else n if tag == "script" else max(at, page.find("<", at)) if page.find("<", at) >= 0 else n
            continue
        if tag in INLINE:
            if tag == "br":
                held.append(" ")
        else:
            flush()
        if hidden and (tag in NO_P or tag == "body"):  # what nothing closes ends where a block starts
            place = next((i for i, (t, _, _) in enumerate(stack) if t in HIDDEN and (t == "head" and tag == "body" or not ends_later(t, at))), None)
            if place is not None:
                pop_to(place)
        ends = ENDS.get(tag, frozenset()) | (frozenset(["p"]) if tag in NO_P else frozenset())
        place = last(ends, WALLS) if ends else None
        if place is not None:
            pop_to(place)
        if tag not in VOID and not attrs.endswith("/"):
            push(tag, attrs)
    flush()
    return Page(out, parent, names_of)
