"""Forgiving reader of HTML pages: elements as style paths, and the text blocks below them."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from html import unescape

#: Comments, declarations and tags. Every part takes what it can and gives nothing back, and what is never closed ends with the
#: page, so each character is read once: a quote without its partner stands for itself, in one way only.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(?P<end>/?+)(?P<tag>[A-Za-z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)",
    re.DOTALL,
)
#: The slash of a tag without attributes, or after a quoted value.
OWN = re.compile(r"(?:^|[\"'])/\Z")
#: The slash of a self-closing tag, which is not part of an unquoted value.
OWN_END = re.compile(r"(?:^|[\s\"'])/\Z")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea xmp title svg math object".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
#: A start tag ends an open element of the listed kinds unless a container lies between.
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
CONTAINERS = frozenset("html body div section article main aside header footer nav form table td th ul ol dl blockquote".split())

BOILERPLATE_TAGS = frozenset("nav aside footer menu dialog button select head".split())
BOILERPLATE_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split()
)
#: What these words of class names and ids name is dropped, as are these tags, unless it holds the main text.
FORMS = frozenset(["form", "fieldset"])
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promotion banner sidebar "
    "nav navbar navigation menu submenu breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices notification popup "
    "modal overlay subscribe subscription newsletter share sharing social related recommended recommendations comment comments "
    "disqus reply replies respond widget widgets toolbar pagination pager login signup masthead topbar skip skiplink".split()
)
#: What follows these words tells a state, as in has-sidebar.
STATE_WORDS = frozenset("has no with without not non hide".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 header".split())
LANDMARKS = frozenset(["article", "main"])
#: How a name or tag tells boilerplate: as a part of a longer name, or with a whole name.
PART, WHOLE = 1, 2
NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
DIGITS = re.compile(r"\d+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


@dataclass(slots=True)
class Node:
    tag: str
    label: str
    path: int
    parent: Node | None
    #: -1 boilerplate by its name, 1 part of the main text by its name, 0 for the style tree to decide.
    prior: int
    dropped: bool
    inside: bool
    #: Kind of landmark, if it is one; how it is named as boilerplate, PART or WHOLE.
    landmark: str = ""
    named: int = 0
    children: list[str] = field(default_factory=list)


@dataclass(slots=True)
class Page:
    nodes: list[Node]
    #: (element, text without markup) in page order; None stands for a block's border.
    texts: list[tuple[Node, str] | None]
    landmark: bool


def path_hash(parent: int, label: str) -> int:
    data = f"{parent}/{label}".encode("utf-8", "surrogatepass")
    return (zlib.crc32(data) << 32 | zlib.crc32(data, 0x5BD1E995)) - (1 << 63)


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(rest)}


class _Reader:
    def __init__(self) -> None:
        root = Node("#page", "", 0, None, 0, False, False)
        self.open = [root]
        self.page = Page([root], [], False)
        self.known: dict[tuple[int, str], int] = {}

    def border(self) -> None:
        if self.page.texts and self.page.texts[-1] is not None:
            self.page.texts.append(None)

    def text(self, raw: str) -> None:
        if raw and not raw.isspace():
            self.page.texts.append((self.open[-1], unescape(raw) if "&" in raw else raw))
        elif raw and self.page.texts and self.page.texts[-1] is not None:
            self.page.texts.append((self.open[-1], " "))

    def close_to(self, at: int) -> None:
        if any(node.tag not in INLINE for node in self.open[at:]):
            self.border()
        del self.open[at:]

    def implied(self, tag: str) -> None:
        if tag in INLINE or tag == "br":
            return
        kinds = CLOSES.get(tag, set()) | {"p"}
        for at in range(len(self.open) - 1, 0, -1):
            found = self.open[at].tag
            if found in kinds:
                self.close_to(at)
                if found == "p" and tag in CLOSES:
                    continue
                return
            if found in CONTAINERS:
                return

    def start(self, tag: str, rest: str) -> Node:
        self.implied(tag)
        parent = self.open[-1]
        values = _attributes(rest) if rest.strip() else {}
        names = sorted(values.get("class", "").split()) + [values.get("id", "")]
        label = DIGITS.sub("#", ".".join([tag, *[n for n in names if n]])) if values else tag
        key = parent.path, label
        if key not in self.known:
            self.known[key] = path_hash(parent.path, label)
        prior = _prior(tag, values, names, parent)
        landmark = _landmark(tag, values) if prior >= 0 else ""
        named = _named(tag, values, names, landmark) if prior >= 0 else 0
        node = Node(tag, label, self.known[key], parent, prior, prior < 0, parent.inside or bool(landmark), landmark, named)
        parent.children.append(label)
        self.page.nodes.append(node)
        if tag == "br":
            self.page.texts.append((parent, " "))
        elif tag not in INLINE:
            self.border()
        if tag not in VOID:
            self.open.append(node)
        return node

    def end(self, tag: str) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                self.close_to(at)
                return
            if tag in INLINE and self.open[at].tag in CONTAINERS:
                return


def _landmark(tag: str, values: dict[str, str]) -> str:
    role = values.get("role", "").lower()
    return tag if tag in LANDMARKS else role if role in LANDMARKS else ""


def _named(tag: str, values: dict[str, str], names: list[str], landmark: str) -> int:
    """How names tell boilerplate; main and the page itself are never named so, an article only by a whole name."""
    found = PART if tag in FORMS or values.get("role", "").lower() == "form" else 0
    for name in names if values and tag not in ("html", "body") and landmark != "main" else []:
        words = [w.lower() for w in NAME_WORDS.findall(name) if not w.isdigit()]
        words = words[: next((i for i, w in enumerate(words) if w in STATE_WORDS), len(words))]
        hits = sum(w in BOILERPLATE_NAMES for w in words)
        if hits:
            found = max(found, WHOLE if hits == len(words) else PART)
    return 0 if landmark and found < WHOLE else found


def _prior(tag: str, values: dict[str, str], names: list[str], parent: Node) -> int:
    if tag in BOILERPLATE_TAGS or (tag == "header" and not parent.inside):
        return -1
    if values:
        role = values.get("role", "").lower()
        if role in BOILERPLATE_ROLES or "hidden" in values or values.get("aria-hidden") == "true":
            return -1
        if "style" in values and HIDDEN.search(values["style"]):
            return -1
    if _landmark(tag, values) or tag in ("html", "body", "h1"):
        return 1
    # Without a name of its own, an element inside the main text is part of it.
    return 1 if parent.inside and not any(names) else 0


def _holders(page: Page) -> set[int]:
    """Elements (id) named as boilerplate that hold the main text all the same.

    Those are the ones around ``main``; around articles where no other article is left and these hold most of the page's
    text; and the ones with most of the text themselves, if no article beside them has a text. Part of a
    longer name counts less than a whole name: inside an article it does not matter what else the article has.
    """
    own: dict[int, int] = {}
    for item in page.texts:
        if item is not None:
            own[id(item[0])] = own.get(id(item[0]), 0) + sum(map(len, item[1].split()))
    below: dict[int, bool] = {}  # in a branch named as boilerplate
    article: dict[int, bool] = {}
    heading: dict[int, bool] = {}
    dropped: dict[int, bool] = {}
    free = free_text = held_text = 0
    for node in page.nodes:  # parents come before their children
        i, up = id(node), id(node.parent)
        dropped[i] = node.prior < 0 or dropped.get(up, False)
        below[i] = node.named > 0 or below.get(up, False)
        article[i] = node.landmark == "article" or article.get(up, False)
        heading[i] = node.tag in HEADINGS or heading.get(up, False)
        if article[i] and not dropped[i]:
            free += not below[i]
            free_text += 0 if below[i] or heading[i] else own.get(i, 0)
            held_text += own.get(i, 0) if below[i] else 0
    total: dict[int, int] = {}
    holds: dict[int, set[str]] = {}
    for node in reversed(page.nodes):
        i = id(node)
        total[i] = 0 if dropped[i] else total.get(i, 0) + own.get(i, 0)
        if node.landmark and not dropped[i]:
            holds.setdefault(i, set()).add(node.landmark)
        if node.parent is not None:
            total[id(node.parent)] = total.get(id(node.parent), 0) + total[i]
            if i in holds:
                holds.setdefault(id(node.parent), set()).update(holds[i])
    most = total[id(page.nodes[0])] / 2
    found = set()
    for node in page.nodes:
        i = id(node)
        if node.named and not dropped[i]:
            landmarks = holds.get(i, ())
            around = "main" in landmarks or ("article" in landmarks and not free and held_text > most)
            if around or (total[i] > most and (not free_text or (node.named == PART and article[i]))):
                found.add(i)
    return found


def _decide(page: Page) -> None:
    """Sets what is dropped by its name, and whether the page marks its main text."""
    holders = _holders(page) if any(node.named for node in page.nodes) else set()
    doubtful: dict[int, bool] = {}  # below a holder with a whole name, which may be comments after all
    for node in page.nodes:
        if node.named:
            node.prior = 0 if id(node) in holders else -1
        node.dropped = node.prior < 0 or (node.parent is not None and node.parent.dropped)
        doubtful[id(node)] = node.landmark != "main" and (doubtful.get(id(node.parent), False) or node.named == WHOLE)
        page.landmark |= node.inside and not node.dropped and not doubtful[id(node)]


def read(html: str) -> Page:
    """The elements and text blocks of a page, in one pass; never fails on broken markup."""
    reader = _Reader()
    at = 0
    while True:
        match = MARKUP.search(html, at)
        if match is None:
            break
        reader.text(html[at : match.start()])
        at = match.end()
        tag = (match["tag"] or "").lower()
        if not tag:
            continue
        if match["end"]:
            reader.end(tag)
            continue
        if tag in ("svg", "math") and OWN_END.search(match["rest"]):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(html, at)
            at = close.end() if close else len(html)
            if tag not in ("svg", "math"):
                reader.border()
            continue
        reader.start(tag, match["rest"])
        if OWN.search(match["rest"]) and tag not in VOID and tag not in CONTAINERS and tag != "p":
            reader.end(tag)
    reader.text(html[at:])
    _decide(reader.page)
    return reader.page


def blocks(page: Page, removed: frozenset[int] | set[int] = frozenset()) -> list[str]:
    """Main text of a page, block by block: without boilerplate branches and branches at ``removed`` paths.

    When the page marks its main text (article, main), only that is taken.
    """
    gone: dict[int, bool] = {}
    for node in page.nodes:  # parents come before their children
        above = node.parent is not None and gone[id(node.parent)]
        gone[id(node)] = above or node.dropped or (node.prior == 0 and node.path in removed)

    found: list[str] = []
    parts: list[str] = []
    for item in [*page.texts, None]:
        if item is None:
            text = " ".join("".join(parts).split())
            if text:
                found.append(text)
            parts = []
        elif (item[0].inside or not page.landmark) and not gone[id(item[0])]:
            parts.append(item[1])
    return found
