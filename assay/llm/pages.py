"""Main text of web pages, by paths that the pages of a host agree on.

Each page scores its containers and names the path of its best one: the tags and classes from
the root down, without numbers. Spark counts these votes per host. Every page is then read
again, and its text taken from the first of its host's winning paths that it has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import Skew
from ..plans.skew import salted_lookup
from ..plans.stage import staged
from .tables import mapped, portions

# What HTML calls its parts, and what sites call theirs.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIPPED = frozenset("nav header footer aside form script style noscript template iframe button select textarea dialog menu svg head title".split())
BLOCKS = frozenset(
    "address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li "
    "main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article main section div td body".split())
NOT_TEXT = frozenset(
    "ad ads adsense advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus "
    "footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related replies respond "
    "share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Start tags that end an open p, and elements that end one of their own kind.
CLOSES_P = BLOCKS - frozenset("body html tbody td tfoot th thead tr dd dt".split())
OWN_KIND = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table article section div main body html aside nav header footer form".split())

#: Share of a host's votes from which a path wins.
SHARE = 0.1

#: Rows and bytes of winning paths that are broadcast; more are joined by shuffle, hot hosts cut.
BROADCAST_HOSTS = 200_000
BROADCAST_BYTES = 32 << 20

# Words that name a box and not what it holds.
BOX_WORDS = frozenset(
    "area bar block body box button buttons bottom container content form icon icons inner item items left links list main outer page "
    "panel posts right section site slot stories text thread top unit wrap wrapper".split()
)
#: Mis-quoted tags after which the rest of a page is read without regard to quotes.
MIS_QUOTED = 100

_START = r"<!--.*?(-->|\Z)|<(script|style|textarea)\b[^>]*>.*?(</\2\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)"
_TOKEN = re.compile(_START + r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*>", re.DOTALL | re.IGNORECASE)
_PLAIN_TOKEN = re.compile(_START + r"([^>]*)>", re.DOTALL | re.IGNORECASE)
_NAME = re.compile(r"""\b(class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
_PARTS = re.compile(r"[a-z]+")
#: Elements whose nearest open one in scope a start tag may end.
_TRACKED = frozenset({"p", *OWN_KIND})


class Node:
    """An open element: its nearest container, and the open elements that a tag may end."""

    __slots__ = ("tag", "parent", "container", "path", "skipped", "linked", "article", "head", "near")

    def __init__(self, tag: str, parent: Node | None, container: int, path: int, skipped: bool):
        self.tag, self.parent, self.container, self.path, self.skipped = tag, parent, container, path, skipped
        self.linked = tag == "a" or (parent is not None and parent.linked)
        self.article = tag in ("article", "main") or (parent is not None and parent.article)
        self.head = self if tag == "head" else parent.head if parent is not None else None
        near = parent.near if parent is not None and tag not in SCOPES else {}
        self.near = {**near, tag: self} if tag in _TRACKED else near


class Page:
    """Kept blocks of text, and containers in page order. Paths are numbered by (path above,
    step), so a deep page takes no more room than a flat one; 0 is the empty path."""

    def __init__(self):
        self.blocks: list[tuple[int, bool, str]] = []  # container or -1, in a link, text
        self.tags: list[str] = []
        self.above: list[int] = []
        self.paths: list[int] = []
        self.steps: dict[tuple[int, str], int] = {}

    def number(self, path: str) -> int | None:
        """The number of a path, None where the page does not have it."""
        at = 0
        for step in path.split("/")[1:]:
            at = self.steps.get((at, step))
            if at is None:
                return None
        return at

    def name(self, number: int) -> str:
        at = list(self.steps)  # numbers ascend from 1 as steps are added
        out = []
        while number:
            number, step = at[number - 1]
            out.append(step)
        return "".join("/" + step for step in reversed(out))

    def scores(self) -> dict[int, float]:
        """Of each container with text: text counts in full where it stands and less for each
        container above it, links count against. One pass from the innermost up."""
        sums: dict[int, float] = {}
        for container, linked, text in self.blocks:
            if container >= 0:
                sums[container] = sums.get(container, 0.0) + len(text) * (-0.5 if linked else 1.0)
        for c in range(len(self.tags) - 1, -1, -1):
            if c in sums and self.above[c] >= 0:
                sums[self.above[c]] = sums.get(self.above[c], 0.0) + 0.7 * sums[c]
        return {c: v * (1.5 if self.tags[c] in ("article", "main") else 1.0) for c, v in sums.items()}

    def inside(self, path: int) -> list[bool]:
        """Whether each container is at or below one of that path."""
        out: list[bool] = []
        for p, above in zip(self.paths, self.above):
            out.append(p == path or (above >= 0 and out[above]))
        return out


def _step(tag: str, attributes: str) -> str:
    """A tag with its classes and id, numbers left out, as a step of a path."""
    words = " ".join(a or b or c for _, a, b, c in _NAME.findall(attributes)).lower()
    plain = ".".join(sorted({re.sub(r"\d+", "#", w) for w in words.split()}))
    return f"{tag}.{plain}".replace("/", "|") if plain else tag


def _not_text(tag: str, attributes: str, article: bool) -> bool:
    """Whether classes and id name something but text.

    Inside an article or main, and on headings and sections anywhere, a name counts as a whole:
    each of its words must name such a thing or a box ("cookie-notice", "ad-slot", but not
    "related-work"), and ids of headings and sections, which are slugs of their titles, do not
    count. Elsewhere any word does.
    """
    if tag in ("html", "body", "main", "article"):
        return False
    titled = tag == "section" or (len(tag) == 2 and tag[0] == "h" and tag[1].isdigit())
    for kind, a, b, c in _NAME.findall(attributes):
        if titled and kind.lower() == "id":
            continue
        for name in (a or b or c).lower().split():
            parts = _PARTS.findall(name)
            named = [p in NOT_TEXT for p in parts]
            if any(named) and (not (article or titled) or all(n or p in BOX_WORDS for n, p in zip(named, parts))):
                return True
    return False


def read(html: str) -> Page:
    """The page's kept text and its containers, in time linear in its length.

    What stands in skipped elements, or in those named as anything but text, is left out.
    Elements that nobody closed end where their parent or the next block does.
    """
    page = Page()
    root = node = Node("", None, -1, 0, False)
    opened: dict[str, int] = {}
    pieces: list[str] = []
    holder = root

    def flush() -> None:
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            page.blocks.append((holder.container, holder.linked, text))

    def close(target: Node) -> None:
        nonlocal node
        while True:
            opened[node.tag] -= 1
            last, node = node, node.parent
            if last is target:
                return

    end = odd = 0
    stop = html.rfind(">") + 1  # no tag ends beyond
    unclosed = False
    pattern = _TOKEN
    while m := pattern.search(html, end, stop):
        if m.start() > end and not node.skipped:
            if not pieces:
                holder = node
            pieces.append(unescape(html[end : m.start()]))
        end = m.end()
        tag = m[5]
        if tag is None:
            unclosed = m[1] == "" or m[3] == ""
            if html[m.start() + 1] not in "!?" and m[2] is None:
                odd += 1
                pattern = _PLAIN_TOKEN if odd > MIS_QUOTED else pattern
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            pieces.append(" ")
        if m[4]:
            if opened.get(tag):
                found = node
                while found.tag != tag:
                    found = found.parent
                close(found)
            continue
        if tag in VOID:
            continue
        if (tag == "body" or tag in CLOSES_P) and node.head is not None:
            close(node.head)
        if tag in CLOSES_P and "p" in node.near:
            close(node.near["p"])
        for kind in OWN_KIND.get(tag, ()):
            while kind in node.near:
                close(node.near[kind])
        attributes = m[6]
        if attributes.endswith("/") and tag not in BLOCKS:
            continue
        container, path = node.container, node.path
        if tag in CONTAINERS or tag == "html":
            path = page.steps.setdefault((path, _step(tag, attributes)), len(page.steps) + 1)
            if tag != "html":
                page.tags.append(tag)
                page.above.append(container)
                page.paths.append(path)
                container = len(page.tags) - 1
        other = tag in SKIPPED or (bool(attributes) and _not_text(tag, attributes, node.article))
        node = Node(tag, node, container, path, node.skipped or other)
        opened[tag] = opened.get(tag, 0) + 1
    if end < len(html) and not node.skipped and not (unclosed and end == stop):
        # Text after the last tag; half a tag at the very end is none.
        rest = html[end:]
        cut = re.search(r"<[a-zA-Z/!][^>]*\Z", rest)
        if not pieces:
            holder = node
        pieces.append(unescape(rest[: cut.start()] if cut else rest))
    flush()
    return page


def _best(scored: dict[int, float]) -> int | None:
    return max(scored, key=lambda c: (scored[c], -c), default=None)


def best_path(page: Page) -> str | None:
    """The path of the container with the highest score, the first of equal ones."""
    best = _best(page.scores())
    return page.name(page.paths[best]) if best is not None else None


def text_at(page: Page, paths: list[str]) -> str:
    """Blocks below the first of `paths` that the page has with text, else below its own best one.

    An article or main element that is the page's own best and stands apart from that path goes
    before it: such a page is of another template than those that voted for the path.
    """

    def below(path: int) -> list[str]:
        inside = page.inside(path)
        return [text for c, _, text in page.blocks if c >= 0 and inside[c]]

    own = _best(page.scores())
    semantic = own is not None and page.tags[own] in ("article", "main")
    for name in paths:
        path = page.number(name)
        found = below(path) if path is not None else []
        if not found:
            continue
        if semantic:
            inside = page.inside(path)
            under = page.inside(page.paths[own])
            apart = not inside[own] and not any(under[c] for c, p in enumerate(page.paths) if p == path)
            # A winning path inside or around the page's own article tells it more exactly.
            if apart:
                return "\n".join(below(page.paths[own]))
        return "\n".join(found)
    return "\n".join(below(page.paths[own]) if own is not None else [text for _, _, text in page.blocks])


def host(url: str):
    """The lower-cased host of a url column; null or odd urls share the empty host."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def votes(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, votes): pages of the host whose best container has that path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "html"):
            found = [best_path(read(h)) if h else None for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["host", "path"])

    rows = pages.select(host(url_col).alias("host"), F.col(html_col).cast("string").alias("html"))
    return mapped(rows, run, "host string, path string").filter("path IS NOT NULL").groupBy("host", "path").agg(F.count("*").alias("votes"))


def winners(counted: DataFrame, share: float = SHARE) -> DataFrame:
    """(host, paths): the paths with that share of the host's votes, most votes first."""
    total = counted.groupBy("host").agg(F.sum("votes").alias("total"))
    kept = counted.join(total, "host").filter(F.col("votes") >= F.col("total") * share)
    # At most 1 / share paths per host.
    order = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("n"), "path")))
    return kept.groupBy("host").agg(F.transform(order, lambda s: s["path"]).alias("paths"))


def with_paths(rows: DataFrame, won: DataFrame, *, most: int = BROADCAST_HOSTS, size: int = BROADCAST_BYTES, skew: Skew | None = None) -> DataFrame:
    """`rows` (host, html and others) with the `paths` of their host, null where it has none."""
    found = won.agg(F.count("*").alias("n"), F.sum(F.length(F.concat_ws("", "paths"))).alias("bytes")).first()
    if found["n"] <= most and (found["bytes"] or 0) <= size:
        return rows.join(F.broadcast(won), "host", "left")
    # A host all of whose pages are empty has no paths.
    known = rows.select("host").distinct().join(won, "host", "left")
    return salted_lookup(rows, known, ["host"], spread_on="html", skew=skew or Skew())


def extract(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = SHARE
) -> DataFrame:
    """(id, url, text, n_chars), one row per row of `pages`, repeated rows too.

    A null or empty html, and one without main text, gives the empty text. A null url is its
    own host; ids may be null. Winning paths are written as a table and measured: up to
    BROADCAST_HOSTS of at most BROADCAST_BYTES they are broadcast, and no html is moved; more
    are joined by host, with the pages of a large host cut over many tasks.
    """
    won = staged(winners(votes(pages, url_col=url_col, html_col=html_col), share), "paths")
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), host(url_col).alias("host"), F.col(html_col).cast("string").alias("html"))
    rows = with_paths(rows, won).select("_id", "_url", "html", "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "html"):
            both = zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist())
            found = pa.array([text_at(read(h), p or []) if h else "" for h, p in both], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_url"), found], ["_id", "_url", "text"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = mapped(rows, run, f"_id {kind['_id']}, _url {kind['_url']}, text string")
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
