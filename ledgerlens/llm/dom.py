"""A small DOM of block structure: what wrapper induction aligns.

Inline markup is transparent, so unclosed or crossed inline tags do no harm.
A node's text falls into blocks, cut by structural tags and line breaks.
Elements nested deeper than MAX_DEPTH are parsed like any other but stand outside
the tree that is aligned: their texts belong to the deepest element within it.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|[^<]+|<", re.DOTALL
)
#: After the first tag whose quotes never close, quotes hide no tag's end any more.
_UNQUOTED_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?([a-zA-Z][^\s/>]*+)([^>]*+)>|[^<]+|<", re.DOTALL)
_TAG_START = re.compile(r"</?[a-zA-Z]")
_ATTRIBUTE = re.compile(r"\b(class|id|role|style)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Levels of the aligned tree; a path's outermost article or main element has one more.
MAX_DEPTH = 150

# Element kinds of HTML.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr img picture source html body".split()
)
VOID = frozenset("area base br col embed hr input link meta param track".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
SCOPES = frozenset("table ul ol dl article section main div aside nav form footer header select".split())

# Roles that are never article text: by element, and by word in class, id or role.
BOILERPLATE_TAGS = frozenset("nav footer aside form button select dialog menu template svg canvas object head".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation"
    " menu breadcrumb breadcrumbs sidebar aside complementary footer contentinfo masthead cookie cookies consent gdpr"
    " notice notices banner popup modal overlay dialog alert newsletter subscribe subscription signup login search"
    " share sharing social related recommended recommendations pagination pager comment comments commentlist disqus"
    " replies respond widget toolbar skip copyright hidden".split()
)
HEADER_NAMES = frozenset({"header"})
# Words beside which a role word still names a role: "comment-list", "related-links".
PARTS = frozenset(
    "area bar block body box button buttons card container content count form group header icon icons inner inline item items"
    " label left link links list main message meta news outer panel post posts reader right row section side site slot text"
    " thread title top bottom unit user wrap wrapper".split()
)
ARTICLE = frozenset({"article", "main"})


@dataclass(eq=False)
class Node:
    tag: str
    label: str
    boilerplate: bool
    article: bool
    parent: Node | None = None
    kids: list[Node] = field(default_factory=list)
    number: int = 0
    deep: bool = False


@dataclass
class Block:
    node: Node
    slot: int
    text: str


def _named(attributes: str, article: bool) -> tuple[set[str], str]:
    """Words that name an element's role, and the first class word (for the label).

    Outside articles these are all words of class, id and role.  Inside one, where
    headings and sections have ids of their own, a name counts only if each of its
    words names a role or a part (PARTS)."""
    names: set[str] = set()
    first = ""
    for key, value in _ATTRIBUTE.findall(attributes):
        value = value.strip("\"'")
        if key.lower() == "style":
            if re.search(r"display\s*:\s*none", value, re.IGNORECASE):
                names.add("hidden")
            continue
        found = [w.lower() for w in _NAME.findall(value)]
        if article:
            for name in value.split():
                own = {w.lower() for w in _NAME.findall(name)}
                names.update(own if own <= BOILERPLATE_NAMES | PARTS else ())
        else:
            names.update(found)
        if key.lower() == "class" and found:
            first = found[0]
    if re.search(r"\shidden(\s|=|/|\Z)", attributes, re.IGNORECASE):
        names.add("hidden")
    return names, first


def parse(page: str) -> tuple[Node, list[Block]]:
    """The block tree of a page (nodes numbered in page order) and its text blocks."""
    root = Node("", "", False, False)
    stack, blocks = [root], []
    count = 1
    places: dict[str, list[int]] = {}
    scopes: list[int] = []
    slots: dict[int, int] = {}
    pending: list[str] = []

    def flush() -> None:
        if pending:
            text = " ".join("".join(pending).split())
            pending.clear()
            if text:
                node = stack[-1]
                slot = slots.get(node.number, 0)
                slots[node.number] = slot + 1
                blocks.append(Block(node, slot, text))

    def nearest(names: set[str]) -> int:
        """The place on the stack of the last opened element of ``names``, or 0."""
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def cut(k: int) -> None:
        for node in stack[k:]:
            places[node.tag].pop()
            if node.tag in SCOPES:
                scopes.pop()
        del stack[k:]

    def close(names: set[str]) -> None:
        """Close the nearest open element of ``names`` within the current scope."""
        k = nearest(names)
        if k and (not scopes or k > scopes[-1]):
            cut(k)

    at, end = 0, len(page)
    token, last_end = _TOKEN, page.rfind(">")
    while at < end:
        if at > last_end:  # no tag ends here any more: what is left is text, up to a comment
            rest = page[at:].split("<!--", 1)[0]
            pending.append(html.unescape(rest) if "&" in rest else rest)
            break
        m = token.match(page, at)
        if m[0] == "<" and _TAG_START.match(page, at):
            token = _UNQUOTED_TOKEN
            m = token.match(page, at)
        at = m.end()
        name = m[1]
        if name is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                pending.append(html.unescape(piece) if "&" in piece else piece)
            continue
        tag = name.lower()
        opening = page[m.start() + 1] != "/"
        if tag in INLINE:
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        if not opening:
            k = nearest({tag})
            if k:
                flush()
                cut(k)
            continue
        flush()
        if tag in RAW:
            closing = re.compile(rf"</{tag}[\s/>]", re.IGNORECASE).search(page, at)
            at = end if closing is None else closing.start()
            continue
        close({"p"})
        if tag in CLOSES:
            close(CLOSES[tag])
        above = stack[-1]
        article = above.article or tag in ARTICLE
        names, first = _named(m[2], above.article) if m[2].strip() else (set(), "")
        bad = tag in BOILERPLATE_TAGS or (tag not in ARTICLE and bool(names & BOILERPLATE_NAMES))
        bad = bad or (tag in ARTICLE and bool(names & {"comment", "related", "ad", "sponsored"}))
        bad = bad or (not article and (tag == "header" or bool(names & HEADER_NAMES)))
        deep = len(stack) > MAX_DEPTH and not (tag in ARTICLE and not above.article)
        parent = above.parent if above.deep else above
        node = Node(tag, f"{tag}.{first}", above.boilerplate or bad, article, parent, [], count, deep)
        count += 1
        if not deep:
            parent.kids.append(node)
        places.setdefault(tag, []).append(len(stack))
        if tag in SCOPES:
            scopes.append(len(stack))
        stack.append(node)
    flush()
    return root, blocks


def align(page: Node, seed: Node) -> dict[int, int]:
    """Simple tree matching: page node number -> seed node number.

    Equal labels at both ends of two child lists match; what is left in the
    middle is matched in order so that the most nodes match in all.
    """
    found: dict[int, int] = {}
    sizes: dict[tuple[int, int], int] = {}

    def table(a: list[Node], b: list[Node]) -> list[list[int]]:
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + size(x, y))
        return best

    def size(x: Node, y: Node) -> int:
        if x.label != y.label:
            return 0
        key = (x.number, y.number)
        if key not in sizes:
            sizes[key] = 1 + (table(x.kids, y.kids)[-1][-1] if x.kids and y.kids else 0)
        return sizes[key]

    todo = [(page, seed)]
    while todo:
        x, y = todo.pop()
        found[x.number] = y.number
        a, b = x.kids, y.kids
        low, high = 0, 0
        while low < min(len(a), len(b)) and a[low].label == b[low].label:
            low += 1
        while high < min(len(a), len(b)) - low and a[-1 - high].label == b[-1 - high].label:
            high += 1
        todo += zip(a[:low], b[:low], strict=True)
        if high:
            todo += zip(a[-high:], b[-high:], strict=True)
        a, b = a[low : len(a) - high], b[low : len(b) - high]
        if a and b:
            best = table(a, b)
            i, j = len(a), len(b)
            while i and j:
                gain = size(a[i - 1], b[j - 1])
                if gain and best[i][j] == best[i - 1][j - 1] + gain:
                    todo.append((a[i - 1], b[j - 1]))
                    i, j = i - 1, j - 1
                elif best[i][j] == best[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
    return found
