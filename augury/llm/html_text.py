"""Main text of a page by tree scoring.

Blocks of text pass points for length and commas to their parent and, by half, to their grandparent; a container's points
are cut by its link density. The best container is kept, with siblings that score near it or are text with few links. Nodes named
like page furniture, and forms, are skipped unless they hold the only article or most of the text."""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript xmp iframe noembed noframes template".split())
SKIP = RAW | set("nav header footer aside form button select option menu svg canvas object dialog head audio video map fieldset label math".split())
BLOCK = set("address article blockquote body center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup html li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
PARAS = set("p pre blockquote td li dd dt h1 h2 h3 h4 h5 h6 figcaption".split())
#: Words of page furniture in class names and ids, and words that only say where or how such a part is laid out. A name means
#: furniture when one of its words does and all its others are layout: ``site-header``, but not ``header-image`` or ``related-work``.
_NOISE = re.compile(r"(?:ads?|adv|advert\w*|banners?|sponsor\w*|promos?|promotions?|comments?|respond|replies|disqus|sidebars?|nav\w*|menus?|footers?|headers?|masthead|breadcrumbs?|cookies?|consent|notices?|gdpr|newsletters?|subscribe|popups?|modals?|overlay|shares?|sharing|social|related|recommend\w*|widgets?|login|signup|pagination|pager|toolbar|alerts?|disclaimer)", re.I)
_LAYOUT = re.compile(
    r"(?:\d+(?:x\d+)?|site|page|global|main|primary|secondary|top|bottom|left|right|upper|lower|inner|outer|fixed|sticky|mobile|desktop|wrap|wrapper|container|box|bar|block|area|"
    r"section|region|zone|slot|unit|panel|pane|column|col|row|list|items?|group|links?|buttons?|btn|icons?|form|body|text|title|message|wrapping|holder|outer|strip|rail|module|component|"
    r"the|my|js|is|u|l|c|o|posts?|articles?|stories|content|media|user|thread|tree|count|meta|policy|privacy|law|eu|google|amp|dfp|gpt)", re.I)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert", "form"}
_SPACE = re.compile(r"\s+")

#: Layout words: with-sidebar, no-header and the like name a page's frame, not a part of it.
_FRAME = re.compile(r"(?:with|without|no|not|has)[_-]", re.I)
_TALK = re.compile(r"comment|respond|replies|disqus", re.I)
HARD, SOFT, TALK = 1, 2, 3


class Node:
    __slots__ = ("tag", "parent", "kids", "skip", "score", "text", "link", "commas")

    def __init__(self, tag, parent, skip):
        self.tag, self.parent, self.kids, self.skip = tag, parent, [], skip
        self.score, self.text, self.link, self.commas = 0.0, 0, 0, 0


def _noisy(tag: str, attrs: str) -> int:
    """HARD for nodes that never hold the main text, SOFT (TALK for comments) for those that might."""
    if tag in SKIP and tag != "form":
        return HARD
    soft = SOFT if tag == "form" else 0
    if not attrs or tag in ("html", "body", "article", "main"):
        return soft
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "role" and value.lower() in _ROLES):
            return HARD
        if name in ("class", "id"):
            for word in value.split():
                parts = [x for x in re.split(r"[-_]+", word) if x]
                noise = [bool(_NOISE.fullmatch(x)) for x in parts]
                if any(noise) and not _FRAME.match(word) and all(n or _LAYOUT.fullmatch(x) for n, x in zip(noise, parts)):
                    soft = max(soft, TALK if _TALK.search(word) else SOFT)
    return soft


def _spare(root: Node) -> None:
    """Unskip soft nodes with over half of the text outside links, or with an article and more text than all outside soft
    nodes, on pages without an article outside them.

    Comments are unskipped only where they hold all of it."""
    nodes, stack = [], [(root, False, False)]
    size, holds, outside, plain = {}, set(), False, 0
    while stack:
        node, link, soft = stack.pop()
        link, soft = link or node.tag == "a", soft or node.skip > HARD
        nodes.append(node)
        size[node] = 0 if link else sum(len(k.strip()) for k in node.kids if isinstance(k, str))
        plain += 0 if soft else size[node]
        if node.tag in ("article", "main"):
            holds.add(node)
            outside = outside or not soft
        stack.extend((k, link, soft) for k in node.kids if isinstance(k, Node) and k.skip != HARD)
    for node in reversed(nodes):
        if node.parent is not None:
            size[node.parent] += size[node]
            if node in holds:
                holds.add(node.parent)
    for node in nodes:
        if node.skip == TALK:
            spared = size[node] == size[root] > 0
        else:
            spared = node.skip == SOFT and not outside and (2 * size[node] > size[root] or (node in holds and size[node] > plain))
        if spared:
            node.skip = 0


def parse(source: str) -> Node:
    root = node = Node("html", None, 0)
    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if not m:
            node.kids.append(source[at:])
            break
        if m.start() > at:
            node.kids.append(source[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            continue
        tag = m[2] and m[2].lower()
        if not tag:
            continue
        if m[1]:
            up = node
            while up.parent is not None and up.tag != tag:
                up = up.parent
            # A stray end tag closes nothing; an inline one does not close a block around it.
            if up.tag == tag and up.parent is not None:
                node = up.parent
            continue
        if tag in ("html", "body"):
            continue
        if tag in VOID:
            node.kids.append(" " if tag in ("br", "hr") else "")
            continue
        if tag in BLOCK:
            # A block start ends an open paragraph, with whatever inline tags stand open in it.
            up = node
            while up.parent is not None and up.tag not in BLOCK:
                up = up.parent
            if up.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or (up.tag == tag and tag in ("li", "dt", "dd", "tr", "td", "th")):
                node = up.parent or root
        new = Node(tag, node, _noisy(tag, m[3]))
        node.kids.append(new)
        if m[0].endswith("/>") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            at = end.end() if end else n
            continue
        node = new
    return root


def _walk(root: Node):
    """Nodes in page order, without those skipped; no recursion, since pages can nest without bound."""
    stack = [root]
    while stack:
        node = stack.pop()
        if node.skip:
            continue
        yield node
        stack.extend(k for k in reversed(node.kids) if isinstance(k, Node))


def _blocks(top: Node) -> list[str]:
    out, now, stack = [], [], [top]
    def flush():
        line = _SPACE.sub(" ", "".join(now)).strip()
        now.clear()
        if line:
            out.append(line)
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            now.append(entities.unescape(x))
        elif not x.skip:
            block = x.tag in BLOCK
            if block:
                flush()
                stack.append(None)
            stack.extend(reversed(x.kids))
    flush()
    return out


def extract(source) -> str:
    """The main text; empty for a null or empty page and for a page of nothing but markup and menus."""
    if not isinstance(source, str) or not source:
        return ""
    root = parse(source)
    _spare(root)
    nodes = list(_walk(root))
    for node in reversed(nodes):
        own = sum(len(k.strip()) for k in node.kids if isinstance(k, str))
        node.text += own
        node.commas += sum(k.count(",") for k in node.kids if isinstance(k, str))
        if node.tag == "a":
            node.link = node.text
        if node.parent is not None:
            node.parent.text += node.text
            node.parent.link += node.link
            node.parent.commas += node.commas
    scored = []
    for node in nodes:
        loose = node.tag not in PARAS and node.tag in BLOCK and any(isinstance(k, str) and len(k.strip()) > 25 for k in node.kids)
        if not (node.tag in PARAS or loose) or node.text - node.link < 1:
            continue
        points = (1 + node.commas + min(node.text / 100, 3)) * (1 - node.link / max(node.text, 1))
        to = node if loose else node.parent
        for share in (1, 0.5):
            if to is not None:
                to.score += points * share
                scored.append(to)
                to = to.parent
    if not scored:
        return "\n".join(_blocks(root))
    rank = lambda x: x.score * (1 - x.link / max(x.text, 1)) * (1.5 if x.tag in ("article", "main") else 1)
    best = max(dict.fromkeys(scored), key=rank)
    # Inside an article element, the article is the container.
    up = best
    while up is not None:
        if up.tag in ("article", "main"):
            best = up
            break
        up = up.parent
    if best.parent is None or best.tag in ("article", "main"):
        return "\n".join(_blocks(best))
    bar, out = max(10.0, 0.2 * rank(best)), []
    for kid in best.parent.kids:
        if not isinstance(kid, Node) or kid.skip:
            continue
        density = kid.link / max(kid.text, 1)
        short = kid.tag not in PARAS and kid.text and density < 0.25
        if kid is best or rank(kid) >= bar or short or (kid.tag in PARAS and ((kid.text > 80 and density < 0.25) or (kid.text and density == 0 and kid.tag != "li"))):
            out += _blocks(kid)
    return "\n".join(out)


def main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text of each row; a column of that name is replaced. Repeated rows stay, a null or empty
    page has an empty text, and an empty table stays empty. Of containers with equal scores the one found first is taken. Time
    and memory grow in proportion to a page's length."""
    run = F.pandas_udf(lambda s: pd.Series([extract(x) for x in s], dtype=object), "string")
    return pages.withColumn("text", run(F.col(html)))
