"""A forgiving HTML reader: block elements as nodes, their texts as segments in page order."""

from __future__ import annotations

import html
import re
from bisect import bisect_right

# One attribute: a name, and a value that may be quoted. A quote opens a string only where a value begins; one that is never
# closed ends with the tag.
_ATTR = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|["'][^>]*+)?+)?+"""
_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ATTR})*+)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|["'][^>]*+)?+)?+""")
_NAMED = frozenset("class id role aria-label itemprop".split())
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")

#: Fixed values of the HTML standard.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page: code, the title and frames, whose content is raw up to their end tag, fields of
#: forms, and templates, which are not shown. Of all but code, those without an end tag are as if their start tag were not there.
#: The head needs no rule: all that can stand in it is here or void. Any other element's text is judged: formulas, drawings and
#: what stands in for a medium are part of the block that they stand in.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
CODE = frozenset("script style".split())
SKIPPED = frozenset("template select button datalist".split())
#: Open elements that the search for an open paragraph stops at.
SCOPE = frozenset("td th caption table".split())
#: Start tags that end an open paragraph.
ENDS_P = BLOCKS - frozenset("body html caption tbody td tfoot th thead tr legend option optgroup".split())
#: For a start tag: open elements that it ends, and those that the search for them stops at.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}


class Node:
    """A block element. segments: numbers of its own texts. links: characters of them that stand in links."""

    __slots__ = ("tag", "tokens", "parent", "children", "segments", "links", "depth", "hidden")

    def __init__(self, tag: str, tokens: frozenset, parent: Node | None, hidden: bool = False):
        self.tag, self.tokens, self.parent, self.hidden = tag, tokens, parent, hidden
        self.children: list[Node] = []
        self.segments: list[int] = []
        self.links = 0
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.children.append(self)


def attribute_tokens(attributes: str) -> tuple[frozenset, bool]:
    """Lower-cased words of class, id, role and the like; whether the element is hidden."""
    words, hidden = set(), False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden":
            hidden = True
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif name in _NAMED:
            words.update(w.lower() for w in _WORD.findall(value))
    return frozenset(words), hidden


def squeeze(text: str) -> str:
    """Character references decoded, runs of white space as one blank, trimmed."""
    return " ".join(html.unescape(text).split())


def raw_end(source: str, tag: str, at: int) -> int | None:
    """Where the end tag of a raw element ends whose content starts at ``at``."""
    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
    return end.end() if end else None


def skipped_ends(source: str, tag: str, at: int) -> tuple[dict[int, int], bool]:
    """Ends of the skipped elements of a tag by where their content starts, from that at ``at`` on; whether all of the source was read.

    Reading stops where that element ends. Those without an end tag are left out.
    """
    found: dict[int, int] = {}
    still = [at]
    while still:
        m = _TOKEN.search(source, at)
        if not m:
            return found, True
        at = m.end()
        name = (m[2] or "").lower()
        closed = (m[3] or "").rstrip().endswith("/")
        if name == tag and m[1]:
            found[still.pop()] = at
        elif name == tag and not closed:
            still.append(at)
        elif name in RAW and not m[1] and not closed:
            at = raw_end(source, name, at) or at
    return found, False


def parse(source: str) -> tuple[Node, list[str], list[Node]]:
    """The root, all texts in page order, and the node of each."""
    root = Node("#root", frozenset(), None)
    stack: list[tuple[str, Node]] = [("#root", root)]
    open_at: dict[str, list[int]] = {}  # places in the stack of the open elements of each tag, so no search walks the stack
    texts: list[str] = []
    owners: list[Node] = []
    held: list[str] = []
    link = linked = 0
    known: dict[str, dict[int, int]] = {}  # ends of skipped elements, of tags that were read to the end of the source

    def flush() -> None:
        nonlocal held, linked
        if held:
            text = squeeze("".join(held))
            if text:
                node = stack[-1][1]
                node.segments.append(len(texts))
                node.links += min(linked, len(text))
                texts.append(text)
                owners.append(node)
        held, linked = [], 0

    def push(tag: str, node: Node) -> None:
        open_at.setdefault(tag, []).append(len(stack))
        stack.append((tag, node))

    def close(to: int) -> None:
        flush()
        for tag, _ in reversed(stack[to:]):
            open_at[tag].pop()
        del stack[to:]

    def innermost(tags) -> int:
        """The place of the innermost open element of the tags, 0 if there is none."""
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    at, size = 0, len(source)
    while at < size:
        m = _TOKEN.search(source, at)
        stop = m.start() if m else size
        if stop > at:
            text = source[at:stop]
            held.append(text)
            if link:
                linked += len(text)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag, ending, attributes = tag.lower(), bool(m[1]), m[3] or ""
        if ending:
            if tag == "a":
                link = max(0, link - 1)
            elif tag == "br":
                held.append(" ")
            elif tag in BLOCKS:
                k = innermost((tag,))
                if k and tag not in ("html", "body"):
                    close(k)
                else:
                    flush()
            continue
        if tag in RAW:
            at = raw_end(source, tag, at) or (size if tag in CODE else at)
            held.append(" ")
        elif tag in SKIPPED:
            if not attributes.rstrip().endswith("/"):
                ends = known.get(tag)
                if ends is None:
                    ends, whole = skipped_ends(source, tag, at)
                    if whole:
                        known[tag] = ends
                at = ends.get(at, at)
        elif tag == "a":
            link = 1
        elif tag in ("br", "wbr", "img"):
            held.append(" " if tag == "br" else "")
        elif tag in BLOCKS:
            flush()
            if tag in ("html", "body"):
                if tag == "body" and not open_at.get("body"):
                    words, hidden = attribute_tokens(attributes)
                    push(tag, Node(tag, words, stack[-1][1], hidden))
                continue
            if tag in ENDS_P:
                k = innermost(("p",))
                if k > innermost(SCOPE):
                    close(k)
            if tag in ENDS:
                shut, bound = ENDS[tag]
                k = innermost(bound)
                inside = [places[i] for t in shut if (places := open_at.get(t)) and (i := bisect_right(places, k)) < len(places)]
                if inside:
                    close(min(inside))
            if tag not in VOID:
                words, hidden = attribute_tokens(attributes) if attributes else (frozenset(), False)
                push(tag, Node(tag, words, stack[-1][1], hidden))
            link = 0
    flush()
    return root, texts, owners
