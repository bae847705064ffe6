"""Main text of pages by site style trees.

A page's DOM becomes blocks: runs of text between block-level tags, each with
the path of its elements (tag and class, digits masked). The DOMs of one host
are merged: for every element the distinct pages that have it are counted, for
every inner element how its pages lay out its children (presentation), and for
every leaf in how many pages each of its contents stands. After Yi, Liu and
Li, a leaf's importance is one less the mean entropy of its contents, which is
log n / log m for a content in n of m pages; an inner element's mixes the
entropy of its layouts with its children's importance, the layouts' part
being 1 - DECAY ** (number of layouts). Elements under ``THRESHOLD`` whose
descendants all are under it too are removed from each page of the host.

Pages of one content count once, so copies of a page don't look like a menu. On few
pages an importance is evidence of little: it is drawn to 1 as if ``PRIOR``
further pages had shown the element to matter. ``article`` and ``main`` are merged like the rest, but in them an element goes
only under ``THRESHOLD_INSIDE``. Apart from the tree, an element goes on its own declaration: navigation, header, footer,
sidebar, form, script, style, notice, advert or comments, by tag, role, class
or id. When one ``article`` or ``main`` holds most of a page's undeclared text,
what lies outside it is not the page's main text. It must not be under a declared element nor
have a class or id that declares it (``_side``); without such a root all
undeclared blocks are left to the tree.

Defined results: null or empty html gives an empty text; markup that never
closes is read to its end; a null url is a host of its own; repeated rows each
get their row; an empty table gives an empty table; further columns are
ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_lookup, settle, texts_of

DECAY = 0.9
THRESHOLD = 0.2
#: Inside article and main repetition is weaker evidence: about half of 1,000 pages, where 0.2 is a quarter of them.
THRESHOLD_INSIDE = 0.1
PRIOR = 1
#: Characters of removed elements up to which they are sent to every worker; beyond, they are joined.
BROADCAST_CHARS = 4 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = RAW | frozenset("head nav footer aside form button select option input label menu dialog object canvas audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
CONTENT = frozenset({"article", "main"})
#: Parts of class and id names that declare something other than the article.
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|banner|breadcrumb|breadcrumbs|comment|comments|commentlist|consent|cookie|cookies|disqus|"
    r"footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|overlay|paywall|popup|promo|promoted|related|replies|reply|respond|"
    r"share|sharing|sidebar|side-bar|skip|social|sponsor|sponsored|subscribe|toolbar|topbar|widget|widgets)(?:$|[\s_-])"
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("table ul ol dl select article section main div body".split())

_token = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</?[a-zA-Z][^\s/>]*(?:\"[^\"]*\"|'[^']*'|[^'\">])*(?:>|$)|<|[^<]+", re.S)
_attr = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_name = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ends: dict[str, re.Pattern] = {}


def _attributes(tag: str, start: int) -> dict[str, str]:
    if "=" not in tag and "hidden" not in tag:
        return {}
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _attr.finditer(tag, start)}


def _declared(name: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether an element says of itself that it is not the article."""
    if name in DROPPED or (name == "header" and not inside):
        return True
    if not attributes:
        return False
    if attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")):
        return True
    if name in CONTENT or name in ("body", "html"):
        return False
    return bool(BOILERPLATE.search(_names(attributes)))


def _names(attributes: dict[str, str]) -> str:
    return re.sub(r"(?<=[a-z])(?=[A-Z])", "-", f"{attributes.get('class', '')} {attributes.get('id', '')}").lower()


def _side(name: str, attributes: dict[str, str]) -> int:
    """Whether a class or id speaks against an article or main: 2 a whole name of an article (``comment``), 1 a part of one (``tag-social``), 0 none."""
    if name not in CONTENT or not attributes:
        return 0
    own = _names(attributes)
    whole = name == "article" and any((m := BOILERPLATE.search(x)) and m[0] == x for x in own.split())
    return 2 if whole else int(bool(BOILERPLATE.search(own)))


def page_blocks(html: str) -> list[tuple[str, tuple[str, ...], bool, int]]:
    """Blocks of a page in order: text, path of elements, declared boilerplate, number of the article or main that may be the page's root (0 for none)."""
    # an open element: tag, label, declared, inside content, root, in an article that declares itself
    stack: list[tuple[str, str, bool, bool, int, bool]] = []
    out: list[tuple[str, tuple[str, ...], bool, int, bool]] = []
    roots = 0
    parts: list[str] = []
    where: tuple = ()

    def flush() -> None:
        nonlocal where
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                top = where[-1] if where else ("", "", False, False, 0, False)
                out.append((text, tuple(x[1] for x in where if x[0] in BLOCK or x[0] not in _INLINE), top[2], top[4], top[5]))
            parts.clear()

    at, n = 0, len(html)
    while at < n:
        m = _token.match(html, at)
        piece = m[0]
        at = m.end()
        if piece[0] != "<" or len(piece) == 1:
            if not parts:
                where = tuple(stack)
            parts.append(piece)
            continue
        if piece[1] in "!?":
            if piece.startswith("<![CDATA["):
                parts.append(entities.escape(piece[9:].removesuffix("]]>")))
            continue
        found = _name.match(piece)
        name = found[1].lower()
        if name in BLOCK or name in DROPPED:
            flush()
        elif parts and stack and piece[1] != "/":
            attributes = _attributes(piece, found.end())
            if attributes and _declared(name, attributes, stack[-1][3]):
                flush()
        if piece[1] == "/":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if stack[-1][2] != (stack[i - 1][2] if i else False):
                        flush()
                    del stack[i:]
                    break
                if stack[i][0] in SCOPES and name not in BLOCK:
                    break
            continue
        attributes = _attributes(piece, found.end())
        if name in RAW:
            end = _ends.get(name) or _ends.setdefault(name, re.compile(rf"</{name}\s*/?>", re.I))
            if piece.endswith("/>") and name in ("svg", "math"):
                continue
            close = end.search(html, at)
            at = close.end() if close else n
            continue
        if name in BLOCK and name not in ("br", "hr"):
            while stack and (stack[-1][0] == "p" or stack[-1][0] in _INLINE):
                # a block closes an open paragraph and the inline elements left open in it
                if not any(x[0] == "p" for x in stack):
                    break
                stack.pop()
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in CLOSES.get(name, ()):
                del stack[i:]
                break
            if stack[i][0] in SCOPES:
                break
        if name in VOID or piece.endswith("/>"):
            continue
        above = stack[-1] if stack else ("", "", False, False, 0, False)
        label = name + "." + re.sub(r"\d+", "#", ".".join(sorted(attributes.get("class", "").split()))) if attributes.get("class") else name
        declared, side, root = above[2] or _declared(name, attributes, above[3]), _side(name, attributes), above[4]
        if name in CONTENT and not (declared or side or root or above[5]):
            root = roots = roots + 1
        stack.append((name, label, declared, above[3] or name in CONTENT, root, above[5] or side == 2))
    flush()
    # an article that declares itself is believed where other text stands
    other = any(not drop and not aside for _, _, drop, _, aside in out)
    return [(text, path, drop or (aside and other), root) for text, path, drop, root, aside in out]


def page_root(blocks: list[tuple[str, tuple[str, ...], bool, int]]) -> int:
    """The article or main that holds most of the page's undeclared text; 0 if none does."""
    held = Counter()
    for text, _, drop, root in blocks:
        if not drop:
            held[root] += len(text)
    root = max((r for r in held if r), key=held.__getitem__, default=0)
    return root if 2 * held[root] > sum(held.values()) else 0


_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())


def host_of(url: str) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)", url)
    return m[1].lower() if m else ""


def _key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _parse(pages: DataFrame) -> DataFrame:
    """page_id, url, host, content (key of its blocks) and blocks of each page."""

    def run(batches):
        for b in batches:
            hosts, contents, blocks = [], [], []
            for url, page in zip(b.column(1).to_pylist(), texts_of(b.column(2))):
                found = page_blocks(page)
                main = page_root(found)
                hosts.append(host_of(url) if url else "\x00null")
                contents.append(_key("\x00".join(x[0] for x in found if not x[2])))
                blocks.append([{"text": t, "path": list(p), "keep": not drop and main in (0, root), "drop": drop} for t, p, drop, root in found])
            kind = pa.list_(pa.struct([("text", pa.string()), ("path", pa.list_(pa.string())), ("keep", pa.bool_()), ("drop", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hosts, pa.string()), pa.array(contents, pa.int64()), pa.array(blocks, kind)], names=["page_id", "url", "host", "content", "blocks"])

    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(
        run, "page_id long, url string, host string, content long, blocks array<struct<text:string,path:array<string>,keep:boolean,drop:boolean>>"
    )


def _observations(parsed: DataFrame) -> DataFrame:
    """(host, path, kind, what, content): that a page has an element (0), lays its children out so (1), or holds this content in a leaf (2)."""

    def run(batches):
        for b in batches:
            rows = defaultdict(set)
            for host, content, blocks in zip(*(b.column(i).to_pylist() for i in range(3))):
                children: dict[str, list[str]] = defaultdict(list)
                for x in blocks:
                    if x["drop"]:
                        continue
                    path = x["path"]
                    for i in range(1, len(path) + 1):
                        here = "/".join(path[:i])
                        rows[host, here, 0, 0].add(content)
                        if i < len(path) and (not children[here] or children[here][-1] != path[i]):
                            children[here].append(path[i])
                    rows[host, "/".join(path), 2, _key(x["text"])].add(content)
                for here, kids in children.items():
                    rows[host, here, 1, _key(" ".join(kids))].add(content)
            flat = [(*k, c) for k, v in rows.items() for c in v]
            cols = list(zip(*flat)) if flat else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["host", "path", "kind", "what", "content"])

    return parsed.select("host", "content", "blocks").mapInArrow(run, "host string, path string, kind int, what long, content long")


def _bar(path: str) -> float:
    return THRESHOLD_INSIDE if any(x.partition(".")[0] in CONTENT for x in path.split("/")) else THRESHOLD


def low_elements(layouts: dict[str, Counter], contents: dict[str, Counter], pages: dict[str, int], once: dict[str, int]) -> list[str]:
    """The topmost elements of one host's style tree that are under the threshold with all their descendants.

    ``once`` counts the contents of a leaf that stand on one page only; their entropy is 0, so that they count in the mean and need no entries.
    """
    kids: dict[str, list[str]] = defaultdict(list)
    for path in pages:
        if "/" in path:
            kids[path.rpartition("/")[0]].append(path)
    worth: dict[str, float] = {}
    low: set[str] = set()
    for path in sorted(pages, key=lambda p: -p.count("/")):
        m = pages[path]
        parts = []
        leaves = len(contents.get(path, ())) + once.get(path, 0)
        if leaves:
            parts.append(1 - sum(math.log(n) for n in contents.get(path, Counter()).values()) / (math.log(m) * leaves) if m > 1 else 1.0)
        if kids[path]:
            total = sum(layouts[path].values())
            shares = [n / total for n in layouts[path].values()]
            spread = -sum(p * math.log(p) for p in shares) / math.log(m) if m > 1 else 1.0
            weight = DECAY ** len(shares)
            inner = sum(worth[k] * pages[k] for k in kids[path]) / sum(pages[k] for k in kids[path])
            parts.append((1 - weight) * spread + weight * inner)
        worth[path] = max(parts) if parts else 1.0
        if (m * worth[path] + PRIOR) / (m + PRIOR) < _bar(path) and low.issuperset(kids[path]):
            low.add(path)
    return sorted(p for p in low if p.rpartition("/")[0] not in low)


def _style_trees(parsed: DataFrame) -> DataFrame:
    """(host, low): the elements to remove, from each host's merged tree.

    What one group holds is the merged tree, counts by element, layout and
    repeated content, and not the pages.
    """
    once = _observations(parsed).distinct()
    counts = once.groupBy("host", "path", "kind", "what").agg(F.count(F.lit(1)).alias("n"))
    # contents that stand in one page only are all alike to the formula: they are summed before a host is gathered
    single = (F.col("kind") == 2) & (F.col("n") == 1)
    counts = counts.groupBy("host", "path", "kind", F.when(single, F.lit(None)).otherwise(F.col("what")).alias("what")).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("times"))
    # on fewer pages an importance of 0 is not under the threshold either
    wide = counts.where(F.lit(PRIOR) / (F.col("n") + PRIOR) < THRESHOLD).where("kind = 0").select("host").distinct()

    def run(table: pa.Table) -> pa.Table:
        layouts, contents, pages = defaultdict(Counter), defaultdict(Counter), {}
        host = table.column("host")[0].as_py()
        once = Counter()
        for path, kind, what, n, times in zip(*(table.column(c).to_pylist() for c in ("path", "kind", "what", "n", "times"))):
            if kind == 0:
                pages[path] = n
            elif kind == 1:
                layouts[path][what] += n
            elif what is None:
                once[path] += times
            else:
                contents[path][what] = n
        low = low_elements(layouts, contents, pages, once)
        return pa.table({"host": pa.array([host], pa.string()), "low": pa.array([low], pa.list_(pa.string()))})

    return counts.join(wide, "host", "left_semi").groupBy("host").applyInArrow(run, "host string, low array<string>").where("size(low) > 0")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""
    parsed = settle(_parse(pages), "pages")
    trees = settle(_style_trees(parsed), "trees")
    size = trees.agg(F.coalesce(F.sum(F.length("host") + F.length(F.array_join("low", ""))), F.lit(0)).alias("n")).first()["n"]
    if size <= BROADCAST_CHARS:
        both = parsed.join(F.broadcast(trees), "host", "left")
    else:
        both = salted_lookup(parsed, trees, ["host"], "left", F.monotonically_increasing_id())
    inside = lambda b: F.exists("low", lambda p: F.startswith(F.concat(F.array_join(b["path"], "/"), F.lit("/")), F.concat(p, F.lit("/"))))
    kept = F.filter("blocks", lambda b: b["keep"] & (F.col("low").isNull() | ~inside(b)))
    return both.select("page_id", "url", F.array_join(F.transform(kept, lambda b: b["text"]), " ").alias("text"))
