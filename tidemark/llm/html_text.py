"""Main text of web pages by tree scoring.

A page is parsed to a tree. Each paragraph gives points, for its length and its commas,
to the elements above it, less the further up they are; an element's points are
discounted by the share of its text that is in links. The best element holds the
article, together with those of its siblings that score well enough or are plain
paragraphs. What isn't text of the article is left out before scoring.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

# Kinds of elements, and names that tell what an element is for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title template iframe object svg canvas select audio video noembed noframes".split())
DROPPED = RAW | frozenset("head nav header footer aside button menu dialog map applet".split())
FORMS = frozenset("form fieldset".split())  # some pages are all in one
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol "
    "p pre section summary table tbody td tfoot th thead tr ul aside hgroup legend menu dialog".split()
)
PARAGRAPHS = frozenset("p pre blockquote td li dd h2 h3 h4 div section article main body center figcaption figure".split())
CLOSES = {  # what a start tag ends if it is open, and what keeps that from being reached
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
# End tags that don't reach beyond these elements.
LIGHT, WALLS = frozenset("p b i a span li div".split()), ("table", "article", "body")
_STRONG = (
    r"ads?|adverts?|advertis\w*|adsense|adslot|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscri\w*|comments?|commentlist|disqus|"
    r"sidebar|widget|nav\w*|breadcrumbs?|pager|pagination|toolbar|topbar|masthead|footer|recirc|outbrain|taboola|login|signup|hidden|sr-only|author-bio|toc"
)
_WEAK = r"side|related|recommended|discussion|thread|answers|search|legal|social|notices?|alert|respond|reply|replies|rail|menu|header|foot|share|sharing|tags|meta|byline|copyright|disclaimer|skip"
UNLIKELY = re.compile(rf"(?i)(?:^|[\s_-])(?:{_STRONG}|{_WEAK})(?=$|[\s_-])")
# Whole class names that are of such words only; weak ones are said of text as well.
NOISE = re.compile(rf"(?i)(?:(?:{_STRONG}|{_WEAK})[_-])*(?:{_STRONG})(?:[_-](?:{_STRONG}|{_WEAK}))*")
WEAK_NOISE = re.compile(rf"(?i)(?:{_WEAK})(?:[_-](?:{_WEAK}))*")
# Parts of names, between hyphens and the like, that say for certain what an element is for.
CERTAIN = frozenset("comment comments commentlist disqus ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsors sponsored cookie cookies notice notices".split())
# Parts of names of what stands behind an article.
FOLLOWS = frozenset("related recommended thread answers respond reply replies share sharing social rail".split())
# Names that say what an element has or lacks, not what it is, and ids that are so whatever heading they are of.
DENIED = re.compile(r"(?i)(?<![\w-])(?:no|not|without|has|have|with|hide|show)[_-][\w-]+")
REMARKS = frozenset("comment comments disqus".split())
# What an element of a weak name must have to be text: characters, and at most that share of them in links.
LONG, LINKED = 200, 0.3
# What names say of an element: nothing, or doubt by its id, by parts of class names, by weak or by other whole class names,
# or by a part that is certain.
BY_ID, BY_PART, BY_WEAK, BY_CLASS, SURE = 1, 2, 3, 4, 5
LIKELY = re.compile(r"(?i)(?:^|[\s_-])(?:article|body|content|entry|main|page|post|story|text|blog|hentry)(?=$|[\s_-])")
BODY = re.compile(r"(?i)article|content-body|post-body|entry-content")
COMMENT = re.compile(r"(?i)(?:^|[\s_-])(?:comments?|reply|replies|respond|advert\w*|sponsor\w*|promo\w*)(?=$|[\s_-])")
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TAG = re.compile(r"""<!--(?:>|->|.*?(?:-->|--!>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")


class Node:
    __slots__ = ("tag", "parent", "children", "block", "dropped", "doubtful", "noise", "bonus", "score", "text", "links", "name", "follows")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, doubtful: int = 0, bonus: float = 0.0):
        self.tag, self.parent, self.dropped, self.doubtful, self.bonus = tag, parent, dropped, doubtful, bonus
        self.block: Node = self if tag in BLOCKS or parent is None else parent.block  # the nearest that is one
        self.children: list[Node | str] = []
        self.score, self.name, self.follows = 0.0, "", False
        self.noise = True  # whether it is left out of an article, too, if in doubt
        self.text = self.links = 0  # characters below, and those of them in links


def parts_of(names: str) -> list[str]:
    return re.split(r"[\s_-]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", names).lower())


def certain(names: str) -> bool:
    """Whether a whole part of a name says for certain that an element isn't of the article."""
    return not CERTAIN.isdisjoint(parts_of(DENIED.sub(" ", names)))


def _role(tag: str, attributes: str, parent: Node) -> tuple[bool, int, float, str, bool]:
    """(left out, how its names are doubtful, bonus, id, whether it follows articles) of an element by its tag and attributes.
    The header of an article is kept for its headings, by blocks()."""
    drop, doubt, name, follows = tag in DROPPED and not (tag == "header" and parent.tag in ("article", "main", "section")), 0, "", False
    doubt = BY_CLASS if tag in FORMS else doubt
    bonus = 25.0 if tag == "article" else 15.0 if tag == "main" else 0.0
    if attributes and not attributes.isspace():
        a = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
        name = a.get("id", "")
        names = DENIED.sub(" ", f"{a.get('class', '')} {name}").strip()
        main = tag in ("main", "body", "html")
        if a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or HIDDEN.search(a.get("style", "")):
            drop = drop or not main
        if names and not main and tag not in HEADINGS:
            if certain(names):
                doubt = SURE
            elif tag == "article":
                doubt = BY_CLASS if COMMENT.search(names) else 0
            elif doubt:
                pass
            elif UNLIKELY.search(names) and not BODY.search(names):
                classes = a.get("class", "").split()
                whole = BY_CLASS if any(map(NOISE.fullmatch, classes)) else BY_WEAK if any(map(WEAK_NOISE.fullmatch, classes)) else 0
                follows = not FOLLOWS.isdisjoint(parts_of(names))
                doubt = whole or (BY_PART if UNLIKELY.search(" ".join(classes)) else BY_ID)
            elif LIKELY.search(names):
                bonus += 10.0
    return drop, doubt, bonus, name, follows


def slug(text: str) -> str:
    """A heading as generators of pages make an id of it."""
    return re.sub(r"[\W_]+", "-", html.unescape(text).lower()).strip("-")


def titled(n: Node) -> bool:
    """Whether an element is the section of a heading: its id is made of the heading that it
    begins with. Remarks of readers are remarks also below such a heading."""
    if not n.name or n.name.lower() in REMARKS:
        return False
    first = next((c for c in n.children if isinstance(c, Node) or c.strip()), None)
    return isinstance(first, Node) and first.tag in HEADINGS and slug(_inline(first)) == slug(n.name)


class Path:
    """The open elements, from the root on, and where in that path those of each name are."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {root.tag: [0]}

    def last(self, names: Iterable[str]) -> int:
        """Place of the innermost open element of these names; 0, the root's, if there is none."""
        return max([self.places[n][-1] for n in names if self.places.get(n)], default=0)

    def cut(self, place: int) -> None:
        """Ends the element at a place and all inside it; never the root."""
        while len(self.nodes) > max(1, place):
            self.places[self.nodes.pop().tag].pop()

    def open(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(_child(node))


def parse(page: str) -> Node:
    """The tree of a page. Wrong or missing end tags are mended as browsers do: a block
    ends an open paragraph, a list item the one before it, and an end tag whatever is
    open inside its element. Nothing is searched from tag to tag, so that time grows with
    the page only."""
    root = Node("html", None)
    path, at, end = Path(root), 0, len(page)
    low = None
    while at < end:
        node = path.nodes[-1]
        start = page.find("<", at)
        if start < 0:
            node.children.append(page[at:])
            break
        if start > at:
            node.children.append(page[at:start])
        m = TAG.match(page, start)
        if not m:
            node.children.append("<")
            at = start + 1
            continue
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            place = path.last((name,))
            if place and not (name in LIGHT and path.last(WALLS) > place):
                path.cut(place)
            continue
        if name in ("html", "body"):
            if name == "body" and node.tag != "body":
                path.cut(1)
                path.open(Node("body", root))
            continue
        if name in BLOCKS and node.block.tag == "p":
            path.cut(path.last(("p",)))
        if name in CLOSES:
            ends, stops = CLOSES[name]
            stop = path.last(stops)
            outer = [own[k] for own in map(path.places.get, ends) if own and (k := bisect_right(own, stop)) < len(own)]
            if outer:
                path.cut(min(outer))
        node = path.nodes[-1]
        attributes = m[3] or m[6] or ""
        if name == "br":
            node.children.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                _child(Node("hr", node))
            continue
        drop, doubt, bonus, own_id, follows = _role(name, attributes, node)
        if name in RAW and not attributes.endswith("/"):
            # Its content isn't markup: what counts is the next end tag of that name.
            if low is None:
                low = page.lower() if page.isascii() else re.sub("[A-Z]+", lambda x: x[0].lower(), page)
            stop = low.find(f"</{name}", at)
            at = end if stop < 0 else (low.find(">", stop) + 1 or end)
            continue
        child = Node(name, node, drop, doubt, bonus)
        child.name, child.follows = own_id if doubt else "", follows
        if not attributes.endswith("/") or name in BLOCKS:
            path.open(child)
        else:
            _child(child)
    return root


def _child(node: Node) -> Node:
    node.parent.children.append(node)
    return node


def settle(root: Node) -> None:
    """Leaves out elements whose names say that they aren't of the article, but for the
    sections of headings, and for what holds the article nevertheless: an article or main
    element, or, on a page without one, most of the text in several paragraphs. Long text
    without many links isn't left out for an id. What is named for certain is held to be
    the article only if there is none elsewhere."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        if not n.dropped:
            order.append(n)
            stack.extend(c for c in n.children if isinstance(c, Node))
    if not any(n.doubtful for n in order):
        return
    for n in order:
        if n.doubtful and titled(n):
            n.doubtful = 0
    sums: dict[int, list[int]] = {id(n): [sum(len(c.strip()) for c in n.children if isinstance(c, str)), 0, 0, 0] for n in order}
    for n in reversed(order):
        own = sums[id(n)]
        own[1] += n.tag in ("article", "main") and not n.doubtful
        own[2] += n.tag == "p"
        own[3] = own[0] if n.tag == "a" else own[3]
        if n.parent is not None:
            up = sums[id(n.parent)]
            for k in range(4):
                up[k] += own[k] if k != 1 or n.doubtful != SURE else 0
    total, mains = sums[id(root)][:2]
    for n in order:
        text, inside, paragraphs, links = sums[id(n)]
        is_text, most = text >= LONG and links <= LINKED * text, not mains and paragraphs > 2 and text > 0.6 * total
        if n.doubtful == SURE:
            n.dropped = not most
        else:
            n.dropped = bool(n.doubtful) and not inside and not most and not (n.doubtful == BY_ID and is_text)
        n.noise = n.doubtful in (BY_CLASS, SURE) or n.doubtful == BY_WEAK and not is_text


def restored(nodes: list[Node]) -> list[Node]:
    """These nodes, with what was left out in them for no more than parts of names or an
    id, or for a weak name although it is text; but not related pages and answers, if they
    stand behind the last paragraph that isn't in doubt itself."""
    order, stack, last = [], [(n, False) for n in reversed(nodes) if n.tag not in ("html", "body")], -1
    while stack:
        n, doubt = stack.pop()
        doubt = doubt or n.dropped or bool(n.doubtful)
        if n.dropped and (n.noise or not n.doubtful):
            continue
        if n.tag == "p" and not doubt and _inline(n).strip():
            last = len(order)
        order.append(n)
        stack.extend((c, doubt) for c in reversed(n.children) if isinstance(c, Node))
    for k, n in enumerate(order):
        if n.dropped and (k < last or last < 0 or not n.follows):
            n.dropped = False
    return nodes


def measure(root: Node) -> list[Node]:
    """Sets characters and link characters of all nodes that aren't left out, without
    recursion, and returns these in page order."""
    settle(root)
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        if not n.dropped:
            order.append(n)
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))
    for n in reversed(order):
        n.text += sum(len(c.strip()) for c in n.children if isinstance(c, str))
        if n.tag == "a":
            n.links = n.text
        if n.parent is not None:
            n.parent.text += n.text
            n.parent.links += n.links
    return order


def density(n: Node) -> float:
    return n.links / n.text if n.text else 0.0


def article(root: Node) -> list[Node]:
    """The best container and the siblings that belong to it, in page order. What the page
    itself marks as its article or main part is taken whole and has no such siblings."""
    order = measure(root)
    candidates: dict[int, Node] = {}
    for n in order:
        if n.tag not in PARAGRAPHS:
            continue
        own = " ".join(c if isinstance(c, str) else "" if c.tag in BLOCKS else _inline(c) for c in n.children).strip()
        if not own:
            continue
        points = 1.0 + own.count(",") + own.count("、") + min(len(own) / 100.0, 3.0)
        up = n.parent if n.tag not in ("div", "section", "article", "main", "body", "center", "figure") else n
        for level in range(5):
            if up is None:
                break
            up.score += points / (1.0, 2.0, 6.0, 9.0, 12.0)[level]
            candidates[id(up)] = up
            up = up.parent
    if not candidates:
        return [root]
    final = {k: (n.score + n.bonus) * (1.0 - density(n)) for k, n in candidates.items()}
    place = {id(n): k for k, n in enumerate(order)}
    best = max(candidates.values(), key=lambda n: (final[id(n)], -place.get(id(n), 0)))
    up = best
    while up.parent is not None:  # an article is not cut to the best of its sections
        up = up.parent
        if up.tag == "article":
            best = up
    if best.parent is None or best.tag in ("article", "main"):
        return [best]
    least = max(10.0, 0.2 * final[id(best)])
    chosen = []
    for s in best.parent.children:
        if not isinstance(s, Node) or s.dropped:
            continue
        plain = s.tag in ("p", *HEADINGS) and (s.text > 80 and density(s) < 0.25 or 0 < s.text <= 80 and s.links == 0)
        if s is best or final.get(id(s), 0.0) >= least or plain and best.tag in ("div", "section"):
            chosen.append(s)
    return chosen


def _inline(n: Node) -> str:
    """Text of an inline element, but of no block in it."""
    out, stack = [], [n]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.dropped and (x is n or x.tag not in BLOCKS):
            stack.extend(reversed(x.children))
    return "".join(out)


def blocks(nodes: list[Node]) -> list[str]:
    """The blocks of text below some nodes, in page order: character references decoded,
    white space runs as one space, trimmed, empty ones left out."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    for top in nodes:
        stack: list[Node | str | None] = [top]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                run.append(x)
            elif not x.dropped:
                if x.tag == "header":  # an article's: its headings only
                    x.children = [c for c in x.children if isinstance(c, Node) and (c.tag in HEADINGS or c.tag in ("hgroup", "div"))]
                if x.tag in BLOCKS:
                    flush()
                    stack.append(None)
                stack.extend(reversed(x.children))
        flush()
    return out


def main_text(page: str | None) -> str:
    return "\n".join(blocks(restored(article(parse(page))))) if page else ""


def extract_text(pages: DataFrame, markup: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row per row of ``pages``: the columns ``keep``, text (blocks of the article in
    page order, joined by a line break) and n_chars (its code points).

    A null or empty page, and one without any text, has an empty text. Pages of any
    length and depth are parsed whole, without recursion. Rows are independent: repeated
    rows, further columns and an empty table change nothing. ``keep`` may name any columns
    but the added ones.
    """
    kept = pages.select(*keep, F.col(markup).alias("_html"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]

    def run(batches):
        for b in batches:
            at = b.num_columns - 1
            for part in slices(b, at, 128, 1 << 22):
                texts = [main_text(x) for x in part.column(at).to_pylist()]
                arrays = [part.column(i) for i in range(at)] + [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names[:at], "text", "n_chars"])

    return kept.mapInArrow(run, ", ".join([*fields, "text string", "n_chars long"]))
