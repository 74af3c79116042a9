"""Main-text extraction by consensus host paths.

1. Each page is parsed into blocks and containers; menus, adverts, forms and the like are
   set aside by tag, role and class words. The page's best container is the deepest one that
   still holds most of the remaining text, and its path is generalised: tags with classes,
   digits as ``#``.
2. Spark counts the votes of paths for each host and keeps, for each host, the paths that a
   twentieth of its pages or more vote for (so at most twenty).
3. Each page is extracted again from the container at its host's winning path, the most
   voted one that it has with text; a page with none of them uses its own best container.

Only (host, path) votes are shuffled; the winners are looked up by host (see ``look_up``).
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from functools import reduce

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import map_texts
from larkspur.llm.language_id import host_of
from larkspur.llm.shared import cut_lineage, look_up

LEAST_SHARE = 0.05
DEEPER = 0.8
TAG = re.compile(r"""<!--|<!\[CDATA\[|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:\-]*)((?:"[^"]*"|'[^']*'|[^'"<>])*+)>?""")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
UNSEEN = re.compile(r"(?i)(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

RAW = frozenset("script style template noscript textarea title iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav object ol optgroup option p pre search section select summary svg "
    "table tbody td tfoot th thead tr ul video audio canvas math".split()
)
CONTAINERS = frozenset("article body div main section td center".split())
CLOSES_P = BLOCKS - {"button", "option", "optgroup", "select", "svg", "object", "video", "audio", "canvas", "math", "body", "html", "head"}
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
SCOPES = frozenset("table td th button object body html article section main aside nav header footer div li".split())
ASIDE = frozenset("nav footer aside form button select svg dialog menu search object video audio canvas math head optgroup option".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
NEVER = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion comment comments commentlist reply replies respond "
    "disqus discussion cookie cookies consent gdpr newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "breadcrumb breadcrumbs pagination pager popup modal overlay paywall".split()
)
RARELY = frozenset("sidebar side menu nav navbar navigation footer foot header masthead topbar banner notice notices alert widget widgets toolbar skip tags meta byline aside".split())
PARTS = frozenset("area bar block box button buttons container content form inner item items links list nav notice panel region section slot unit widget wrap wrapper zone".split())
GOOD = frozenset("article content main post entry story body text page blog prose document".split())


class Node:
    """A block element. ``step`` is its part of the path; ``key`` hashes all steps from the root, so that deep pages hold no long paths."""

    __slots__ = ("tag", "step", "key", "out", "good", "inside", "parent", "total", "linked")

    def __init__(self, tag: str, step: str, key: int, out: bool, good: bool, inside: bool, parent: int):
        self.tag, self.step, self.key, self.out, self.good, self.inside, self.parent = tag, step, key, out, good, inside, parent
        self.total = self.linked = 0


def _key(above: int, step: str) -> int:
    return xxhash.xxh64_intdigest(step.encode("utf-8", "surrogatepass"), above)


def _attributes(raw: str) -> tuple[list[list[str]], str, str, bool]:
    """(words of each class name and of the id, role, generalised class names, whether it is hidden); a name counts once."""
    named: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(raw):
        named.setdefault(name.lower(), a or b or c)
    tokens = [[w.lower() for w in WORDS.findall(x)] for x in (*named.get("class", "").split(), *named.get("id", "").split())]
    names = re.sub(r"\d+", "#", re.sub(r"[\x00-\x20>]", " ", named.get("class", "").lower())).split()
    shown = "." + ".".join(sorted(set(names))) if "class" in named else ""
    hidden = "hidden" in named or named.get("aria-hidden", "").lower() == "true" or bool(UNSEEN.search(named.get("style", "")))
    return tokens, named.get("role", "").lower().strip(), shown, hidden


def _says(tokens: list[list[str]], words: frozenset[str]) -> bool:
    """Whether a class name or id is one of the words, or ends with one that its first word qualifies (``site-footer``)."""
    return any(t and (t[-1] in words and len(t) <= 2 or len(t) == 2 and t[0] in words and t[1] in PARTS or len(t) == 1 and t[0] in words) for t in tokens)


class Page:
    """Nodes of block elements in page order, and blocks of text with their node."""

    def __init__(self, text: str | None):
        self.nodes: list[Node] = [Node("", "", 0, False, False, False, -1)]
        self.blocks: list[tuple[int, str]] = []
        self._stack = [0]
        self._open_tags: Counter[str] = Counter()
        self._parts: list[str] = []
        self._anchor = 0
        self._linked = 0
        self._parse(text or "")
        self._flush()
        for at, (node, block) in enumerate(self.blocks):
            self.nodes[node].total += len(block)
            self.nodes[node].linked += self._links[at]
        for n in reversed(self.nodes[1:]):  # a parent comes before its children
            self.nodes[n.parent].total += n.total
            self.nodes[n.parent].linked += n.linked

    def _flush(self) -> None:
        if self._parts:
            block = " ".join(entities.unescape("".join(self._parts)).split())
            if block and not self.nodes[self._stack[-1]].out:
                self.blocks.append((self._stack[-1], block))
                self._links.append(min(self._linked, len(block)))
            self._parts, self._linked = [], 0

    def _text(self, text: str) -> None:
        self._parts.append(text)
        if self._anchor:
            self._linked += len(text)

    def _parse(self, text: str) -> None:
        self._links: list[int] = []
        at, size = 0, len(text)
        while at < size:
            m = TAG.search(text, at)
            if not m:
                self._text(text[at:])
                return
            if m.start() > at:
                self._text(text[at : m.start()])
            at = m.end()
            if m.group(2) is None:
                if m.group() == "<!--":
                    end = text.find("-->", m.end())
                    at = size if end < 0 else end + 3
                elif m.group() == "<![CDATA[":
                    end = text.find("]]>", m.end())
                    self._text(text[m.end() : size if end < 0 else end].replace("&", "&amp;"))
                    at = size if end < 0 else end + 3
                continue
            tag = m.group(2).lower()
            if m.group(1):
                self._close(tag)
            elif tag in RAW:
                end = re.compile(rf"(?i)</{tag}(?![a-z0-9])[^>]*>?").search(text, at)
                at = size if end is None else end.end()
            else:
                self._open(tag, m.group(3))

    def _open(self, tag: str, raw: str) -> None:
        if tag == "a":
            self._anchor = 1
        if tag == "br" or tag == "hr" or tag == "img":
            self._parts.append(" ")
        if tag in VOID or tag not in BLOCKS:
            return
        self._flush()
        if tag in CLOSES_P:
            self._pop({"p"}, SCOPES)
        if tag in CLOSES:
            self._pop(*CLOSES[tag])
        if tag[0] == "h" and tag[1:].isdigit() and self.nodes[self._stack[-1]].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self._cut(len(self._stack) - 1)
        self._anchor = 0 if tag != "li" else self._anchor
        above = self.nodes[self._stack[-1]]
        tokens, role, shown, hidden = _attributes(raw) if raw else ([], "", "", False)
        said = {w for t in tokens for w in t}
        good = tag in ("article", "main") or bool(said & GOOD) or role in ("main", "article")
        out = above.out or tag in ASIDE or role in ROLES or hidden or _says(tokens, NEVER)
        out = out or (_says(tokens, RARELY) and not said & GOOD and tag not in ("body", "html", "main", "article")) or (tag == "header" and not above.inside)
        if tag in ("html", "body"):
            out = False
        step = tag + shown
        self.nodes.append(Node(tag, step, _key(above.key, step), out, good, above.inside or tag in ("article", "main"), self._stack[-1]))
        self._stack.append(len(self.nodes) - 1)
        self._open_tags[tag] += 1

    def _cut(self, at: int) -> None:
        """Close the open elements from a place of the stack on."""
        for i in self._stack[at:]:
            self._open_tags[self.nodes[i].tag] -= 1
        del self._stack[at:]

    def _pop(self, tags: set[str], until: frozenset[str] | set[str]) -> None:
        """Close the innermost open elements down to the outermost of ``tags`` within the scope."""
        cut = None
        for k in range(len(self._stack) - 1, 0, -1):
            tag = self.nodes[self._stack[k]].tag
            if tag in tags:
                cut = k
            elif tag in until:
                break
        if cut is not None:
            self._cut(cut)

    def _close(self, tag: str) -> None:
        if tag == "a":
            self._anchor = 0
        if tag == "p" or tag in BLOCKS:
            self._flush()
            if self._open_tags[tag]:
                self._cut(next(k for k in range(len(self._stack) - 1, 0, -1) if self.nodes[self._stack[k]].tag == tag))

    def score(self, node: Node) -> float:
        """Text that isn't linked, with credit for tags and classes that name content."""
        return (node.total - 1.5 * node.linked) * (1.25 if node.good else 1.0)

    def best(self) -> int:
        """The deepest container that holds most of the text; explicit articles come first."""
        children: dict[int, list[int]] = {}
        for i, n in enumerate(self.nodes[1:], 1):
            children.setdefault(n.parent, []).append(i)
        at = 0
        while True:
            below, queue = [], list(children.get(at, ()))
            while queue:  # the nearest containers below
                i = queue.pop()
                if self.nodes[i].tag in CONTAINERS and not self.nodes[i].out:
                    below.append(i)
                elif not self.nodes[i].out:
                    queue += children.get(i, ())
            below = [i for i in below if self.nodes[i].total]
            if not below:
                return at
            top = max(below, key=lambda i: (self.score(self.nodes[i]), -i))
            rest = self.score(self.nodes[at])
            need = 0.5 if self.nodes[top].good and self.nodes[top].tag in ("article", "main") else DEEPER
            if self.nodes[at].tag in ("article", "main") or self.nodes[top].total <= 0 or self.score(self.nodes[top]) < need * max(rest, 1.0):
                return at
            at = top

    def text(self, container: int) -> str:
        """Blocks of a container in page order."""
        inside = {container}
        for i in range(container + 1, len(self.nodes)):
            if self.nodes[i].parent in inside:
                inside.add(i)
        return "\n".join(block for node, block in self.blocks if node in inside)

    def path(self, node: int) -> str:
        """The generalised path of a node, from the root."""
        steps = []
        while node > 0:
            steps.append(self.nodes[node].step)
            node = self.nodes[node].parent
        return "".join(f">{step}" for step in reversed(steps))

    def at_path(self, path: str) -> int | None:
        """The container at a generalised path with the highest score, if one has text."""
        key = reduce(_key, path.split(">")[1:], 0)
        found = [i for i, n in enumerate(self.nodes) if n.key == key and not n.out and n.total]
        return max(found, key=lambda i: (self.score(self.nodes[i]), -i), default=None)


def vote(text: str | None) -> tuple[str | None, float]:
    """(generalised path, score) of a page's best container; no path for a page without text."""
    page = Page(text)
    best = page.best()
    if not page.nodes[best].total:
        return None, 0.0
    return page.path(best), page.score(page.nodes[best])


def extract_page(text: str | None, paths: list[str] | None) -> str:
    """The main text of a page, from the first of the paths that it has, else from its best container."""
    page = Page(text)
    for path in paths or ():
        if (at := page.at_path(path)) is not None:
            return page.text(at)
    return page.text(page.best())


def winning_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html", least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, paths array<string>): the paths of each host's votes, most voted first.

    Pages without text have no vote; null and malformed addresses share the empty host; an
    empty table has no hosts.
    """
    hosts = pages.select(host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").alias("t"))

    def kernel():
        def apply(texts: list) -> dict:
            made = [vote(t) for t in texts]
            return {"path": [p for p, _ in made], "score": [s for _, s in made]}

        return apply

    votes = map_texts(hosts, ["host"], "t", kernel, [("path", "string"), ("score", "double")]).where("path is not null")
    # Written once: the votes of paths are read for each host's pages and again for its winners.
    votes = cut_lineage(votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score")).alias("score")))
    whole = votes.groupBy("host").agg(F.sum("n").alias("pages"))
    votes = votes.join(whole, "host").where(F.col("n") >= least_share * F.col("pages"))
    ranked = F.reverse(F.array_sort(F.collect_list(F.struct("n", "score", "path"))))
    return votes.groupBy("host").agg(ranked.alias("r")).select("host", F.col("r.path").alias("paths"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars): the main text of every page.

    Null and empty pages have an empty text of 0 characters; pages with null or malformed
    addresses share one host; repeated rows stay; ties between paths go by score, then by
    path; an empty table gives an empty table; other columns are ignored.
    """
    rows = pages.select(
        F.col(f"`{id_col}`").alias("i"), F.col(f"`{url_col}`").alias("u"), host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").alias("t")
    )
    rows = look_up(rows, winning_paths(pages, url_col, html_col), ["host"], "i")
    # The paths travel as one string in front of the page, so that the kernel sees both.
    marked = F.concat(F.array_join(F.coalesce("paths", F.array().cast("array<string>")), "\x01"), F.lit("\x02"), F.coalesce("t", F.lit("")))

    def kernel():
        def apply(texts: list) -> dict:
            out = []
            for t in texts:
                paths, _, page = t.partition("\x02")
                out.append(extract_page(page, [p for p in paths.split("\x01") if p]))
            return {"text": out, "n_chars": [len(x) for x in out]}

        return apply

    out = map_texts(rows.select("i", "u", marked.alias("t")), ["i", "u"], "t", kernel, [("text", "string"), ("n_chars", "bigint")])
    return out.select(F.col("i").alias(id_col), F.col("u").alias(url_col), "text", "n_chars")
