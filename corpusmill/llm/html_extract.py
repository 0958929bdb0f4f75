"""Main text of web pages by tree scoring.

Every paragraph earns points for its length and its commas and passes them up:
all to its container, a share to the next ancestors.  A container's sum is
discounted by its link density.  The best container is kept with those siblings
that score well themselves; menus, headers, footers, sidebars, notices, adverts,
forms, comments and what is hidden have left the tree before.  What the kept part
holds comes out whole.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusmill.llm.common import batches_of, require

# Fixed vocabularies of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th pre blockquote figcaption caption summary".split())
#: An opening tag ends these when they are open and nothing of the second set lies between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
LEFT_OUT = frozenset(
    "nav header footer aside form script style noscript template iframe button select option textarea svg canvas object dialog menu head title input label fieldset audio video".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form status tablist".split())
#: Words in class or id that name what isn't the article.
UNWANTED = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner breadcrumb breadcrumbs comment comments commentlist disqus
    replies reply respond discussion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login register paywall footer foot
    header masthead menu nav navbar navigation topbar sidebar sidebars aside rail related recommended recommendations share sharing shares social pager pagination toolbar widget
    widgets search skip hidden""".split()
)
#: Those of them that also describe a page's layout ("has-sidebar"): an article inside is kept all the same.
LAYOUT = frozenset("footer foot header masthead menu nav navbar navigation topbar sidebar sidebars rail search skip social share".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<""", re.S)
#: Those that name what readers write.
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond discussion".split())
#: A name that begins with one of these tells what its element has ("has-comments"), not what it is.
TELLS = frozenset("has have with no not without".split())
#: Words that say of an unwanted name's element only that it is one ("share-buttons").
BOXES = frozenset("area bar block bottom box btn button buttons card cards container content group icons inline inner item items left link links list module outer panel post posts row section slot small top right unit wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_RIGHTS = re.compile(r"\s*(?:©|\(c\)|copyright\b|all rights reserved)", re.I)
#: Levels of Node.out: a layout word, another unwanted word, a word for comments speak against it; it goes for certain.
LAID_OUT, NAMED, COMMENTED, GONE = 1, 2, 3, 4
#: One attribute after the other, so that no value is read as a name.
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "parent", "parts", "out", "own", "score", "chars", "linked")

    def __init__(self, tag: str, parent: "Node | None", own: int):
        self.tag, self.parent, self.own = tag, parent, own
        self.out = own if parent is None else max(parent.out, own)  # what is in a node goes with it
        self.parts: list = []  # texts and nodes
        self.score = 0.0
        self.chars = self.linked = 0


def _named(value: str, alone: bool) -> set[str]:
    """The unwanted words of a class or id; "hidden" counts alone only, since hidden-print and overflow-hidden are seen.

    ``alone``: a name counts as a whole only, if all its words are unwanted or say that it is a box.
    """
    found: set[str] = set()
    for name in value.split():
        words = _SPLIT.split(_HUMP.sub("-", name).lower())
        if words[0] not in TELLS and not (alone and not all(w in UNWANTED or w in BOXES or w.isdigit() for w in words)):
            found |= UNWANTED.intersection(words) - ({"hidden"} if len(words) > 1 else set())
    return found


def _unwanted(tag: str, attributes: str, in_article: bool) -> int:
    """0 for what stays, or how much speaks against it; what is in an article goes for a whole name only, and no heading there for its name."""
    if tag in LEFT_OUT:
        return GONE
    if not attributes or tag in ("html", "body", "main"):
        return 0
    heading = in_article and tag in HEADINGS
    against = 0
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id") and not heading:
            named = _named(value, in_article)
            if tag == "article":  # an article may be called anything but a comment
                named &= {"comment", "comments", "reply", "replies"}
            if named:
                against = max(against, COMMENTED if named & COMMENTS else LAID_OUT if named <= LAYOUT else NAMED)
        elif name == "role":
            if value.lower() in ROLES:
                return GONE
        elif name == "style":
            if _HIDDEN.search(value):
                return GONE
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return GONE
    return against


def parse(page: str) -> Node:
    """The tree of a page; unclosed and misplaced tags are mended as browsers roughly do."""
    root = Node("html", None, 0)
    at, stack = root, [root]
    held: defaultdict[str, list[int]] = defaultdict(list)  # by name, where on the stack its open elements are

    def shut(down_to: int) -> None:
        for node in reversed(stack[down_to:]):
            held[node.tag].pop()
        del stack[down_to:]

    scan, pos, end = _TOKEN.match, 0, len(page)
    articles = mains = 0  # kept so far
    while pos < end:
        m = scan(page, pos)
        pos = m.end()
        closing, tag, attributes = m[1], m[2], m[3]
        if tag is None:
            closing, tag, attributes = m[4], m[5], m[6]
        if tag is None:
            text = m[0]
            if text[:9] == "<![CDATA[" or text[:2] in ("<!", "<?"):
                continue
            at.parts.append(text)
            continue
        tag = tag.lower()
        if closing:
            if held[tag]:
                shut(held[tag][-1])
                at = stack[-1]
            elif tag in BLOCK:
                at.parts.append(Node("br", at, 0))
            continue
        if tag in ("html", "body"):
            continue
        ended, until = ENDS.get(tag, ((), ()))
        if tag in BLOCK and held["p"]:
            ended, until = {"p", *ended}, {"table", "td", "th", "caption", "button", "object", *until}
        last = max((held[x][-1] for x in ended if held[x]), default=0)
        if last > max((held[x][-1] for x in until if held[x]), default=0):
            shut(last)
            at = stack[-1]
        own = _unwanted(tag, attributes, bool(held["article"] or held["main"]))
        if tag in ("article", "main") and own == 0 and 0 < at.out < GONE:
            # after an article, one in a box of comments or of related pages is not the page's own
            if at.out == LAID_OUT or not articles and (at.out == NAMED or not mains):
                up = at
                while up is not None and up.out:
                    up.out, up.own, up = 0, 0, up.parent
        node = Node(tag, at, own)
        articles += tag == "article" and not node.out
        mains += tag == "main" and not node.out
        at.parts.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, pos)
            pos = close.end() if close else end
            node.own = node.out = GONE
        elif tag not in VOID and not attributes.endswith("/"):
            held[tag].append(len(stack))
            stack.append(node)
            at = node
    return root


def _plain(node: Node) -> tuple[int, int]:
    """Characters outside and inside of links of what is not gone for certain in a node that was put out."""
    plain = linked = 0
    todo = [(node, False)]
    while todo:
        x, link = todo.pop()
        link = link or x.tag == "a"
        for p in x.parts:
            if type(p) is not str:
                if p.own < COMMENTED:
                    todo.append((p, link))
            elif link:
                linked += len(p.strip())
            else:
                plain += len(p.strip())
    return plain, linked


def _reclaim(root: Node) -> None:
    """Take back what only its name speaks against where next to nothing else is left.

    Such a box comes back unless it is short or mostly links.
    """
    boxes: list[Node] = []
    left, todo = 0, [root]
    while todo:
        x = todo.pop()
        for p in x.parts:
            if type(p) is str:
                left += len(p.strip()) if x.tag != "a" else 0
            elif not p.out:
                todo.append(p)
            elif p.out < COMMENTED:
                boxes.append(p)
    sizes = [(box, *_plain(box)) for box in boxes]
    if sum(plain for _, plain, _ in sizes) < 4 * left:
        return
    for box, plain, linked in sizes:
        if plain < 80 or linked > plain:
            continue
        box.own = 0
        again = [box]
        while again:
            x = again.pop()
            x.out = max(x.parent.out, x.own)
            again += [p for p in x.parts if type(p) is not str]


def _measure(node: Node, in_link: bool, below: list) -> None:
    """Characters and linked characters of every kept node; ``below`` gets the paragraphs."""
    todo = [(node, in_link, False)]
    while todo:
        x, link, done = todo.pop()
        if done:
            own = 0
            for p in x.parts:
                if type(p) is str:
                    own += len(p) - p.count(" ") if link else len(p.strip())
                elif not p.out:
                    x.chars += p.chars
                    x.linked += p.linked
            x.chars += own
            x.linked += own if link else 0
            if x.tag in PARAGRAPH or own:
                below.append(x)
            continue
        link = link or x.tag == "a"
        todo.append((x, link, True))
        todo += [(p, link, False) for p in x.parts if type(p) is not str and not p.out]


def _text_of(node: Node, only: set[int] | None = None) -> list[str]:
    """Blocks of a node in page order, white space folded, references decoded; ``only``: of the parts with these ids."""
    blocks: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            blocks.append(text)
        run.clear()

    todo: list = [(node, only is None)]
    while todo:
        x, wanted = todo.pop()
        wanted = wanted or only is not None and id(x) in only
        if x is None:
            close()
        elif type(x) is str:
            if wanted:
                run.append(x)
        elif not x.out:
            if x.tag == "br":
                run.append(" ")
            elif x.tag in BLOCK:
                close()
                todo.append((None, False))
                todo += [(p, wanted) for p in reversed(x.parts)]
            else:
                todo += [(p, wanted) for p in reversed(x.parts)]
    close()
    return blocks


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def main_text(page: str | None) -> str:
    """The article of a page; empty if there is none."""
    if not page or not page.strip():
        return ""
    root = parse(page)
    _reclaim(root)
    found: list[Node] = []
    _measure(root, False, found)
    scored: list[Node] = []
    for block in found:
        if not block.chars:
            continue
        top = block
        while top.tag not in BLOCK and top.parent is not None:  # text of an inline element belongs to its block
            top = top.parent
        text = sum(len(p) for p in block.parts if type(p) is str)
        commas = sum(p.count(",") + p.count("،") + p.count("，") for p in block.parts if type(p) is str)
        points = (1 + commas + min(text / 100, 3)) * (1 - _density(block))
        to, share = (top.parent or top) if top.tag in PARAGRAPH else top, 1.0
        while to is not None and share > 0.2:
            if not to.score:
                scored.append(to)
            to.score += points * share
            to, share = to.parent, share * 0.5
    if not scored:
        return ""
    value = {id(x): x.score * (1 - _density(x)) for x in scored}
    best = max(scored, key=lambda x: value[id(x)])
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up is not None:
        best = up
    else:  # a parent that scores nearly as well holds the article in several parts
        while best.parent is not None and best.parent.parent is not None and value.get(id(best.parent), 0.0) >= 0.75 * value.get(id(best), 0.0):
            best = best.parent
    if best.parent is None:
        return " ".join(_text_of(best))
    kept = _beside(best, value)
    if best.tag == "article":  # every article is the page's own, wherever it stands
        kept |= {id(x) for x in _articles(root) if _density(x) < 0.5}
    return " ".join(_text_of(root, kept))


def _articles(root: Node) -> list[Node]:
    """The articles that are not out, those inside of another left aside."""
    found, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.tag == "article":
            found.append(x)
        else:
            todo += [p for p in x.parts if type(p) is not str and not p.out]
    return found


def _beside(best: Node, value: dict[int, float]) -> set[int]:
    """The ids of the best container and of those beside it that belong to it, bare texts among them.

    Siblings that score well, tables, lists and paragraphs that are not mostly links,
    and bare texts stay; a heading stays if it is the page's first or what follows it
    stays.  A paragraph about rights is a footer.
    """
    enough = max(10.0, 0.2 * value.get(id(best), 0.0))
    kept: set[int] = set()
    follows = False  # whether what comes next stays
    for x in reversed(best.parent.parts):
        if type(x) is str:
            if len(re.findall(r"\w{2,}", x)) > 1 and not _RIGHTS.match(x):
                kept.add(id(x))
            continue
        if x.out or not x.chars:
            continue
        density = _density(x)
        if x is best or value.get(id(x), 0.0) >= enough and density < 0.5:
            follows = True
        elif x.tag in HEADINGS:
            follows = density < 0.5 and (x.tag == "h1" or follows)
        elif x.tag == "p":
            bare = "".join(p for p in x.parts if type(p) is str)
            follows = (x.chars > 80 and density < 0.25 or not x.linked) and not _RIGHTS.match(html.unescape(bare))
        else:
            follows = x.tag in ("table", "ul", "ol", "dl", "pre", "blockquote", "figure", "math") and density < 0.25
        if follows:
            kept.add(id(x))
    return kept


def extract_pages(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row.

    Null and empty html and pages without an article give an empty text.  Pages are
    taken whole, however long; repeated rows give repeated results; an empty table an
    empty one; other columns are left out.  Nothing is shuffled.
    """
    require(pages, id_col, url_col, html_col)
    kinds = {f.name: f for f in pages.schema.fields}
    schema = T.StructType([kinds[id_col], kinds[url_col], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.select(id_col, url_col, html_col).mapInArrow(run, schema)
