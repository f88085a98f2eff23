"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: the tags of its containers, each told apart by
the path of containers around it, and its text runs. Over the pages of one
host, tokens with the same occurrence vector (the same number of occurrences
on every page) form an equivalence class. A class is valid if it has enough
tokens and pages. The class whose tokens occur
once on every page that has any is the host's outer template; classes of fewer
pages or of repeated tokens that hold containers of their own are taken to nest
in its gaps, without a check of their order: layouts, notices on some pages,
repeated boxes. Text runs of both are page furniture, but a page of which they
would leave nothing keeps those of the inner classes, or all: such pages are
copies of one article. Classes of text runs alone that miss a page are content
that recurs, and stay.

What remains between template tokens are the slots. Each container of the
template has the mean text that its slots hold on the host's pages. From the
page's root, the way goes down into the container whose slots hold ``SHARE`` or
more of the text, as long as there is one; where it ends is the article. Link
text and furniture by name (navigation, forms, comments, adverts, which no
template can tell from an article if they change from page to page) count for
nothing and are left out. An element named article or main ends the way, and
needs half of the text only. Containers that the template lacks, as on hosts of
a page or two, are judged by the page itself.

Vectors are never gathered: a token's vector is the XOR of a mixed hash of
page and count, so that one aggregation over (host, token) yields the classes
of any number of pages. Equal pages of a host count as one page for the
template. Pages are then dealt in parts of their host, and each part meets all
tokens of the host's template.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace

#: A valid class has at least so many tokens and pages.
CLASS_TOKENS = 3
CLASS_PAGES = 3
#: A host is dealt in parts of so many pages or characters, about.
PART_PAGES = 256
PART_CHARS = 1 << 22
#: The share of a container's slot text at which the article is looked for in the container below it; for those named ARTICLES.
SHARE = 0.9
NAMED_SHARE = 0.5

# Element names by their role.
CONTAINERS = frozenset("html body header nav main article section aside footer div form ul ol dl table figure dialog details fieldset menu".split())
RAW = frozenset("script style noscript template textarea title iframe svg math select button object canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img input".split())
FURNITURE = frozenset("nav header footer aside form dialog menu".split())
ARTICLES = frozenset("article main".split())
SECTIONS = frozenset("html body div section".split()) | ARTICLES
#: Words of class, id and role names that mark furniture.
NAMES = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies footer header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())

#: Words beside which such a name tells of something else.
TELLING = frozenset("with without has no article main".split())
#: Containers nested deeper have the path of the one at this depth.
DEEPEST = 200
#: The share of a page's text that names must leave.
OUTSIDE = 0.1

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>"']|"[^"]*"|'[^']*')*)[^>]*)(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", re.I)
_SPACES = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")


def host_of(url: str | None) -> str:
    """The host of a URL in lower case; empty if there is none."""
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _key(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(parts)) - (1 << 63)


class _Open:
    """An open container: its name, its label in paths, the path to it, the text in it, and whether it is furniture."""

    __slots__ = ("above", "chars", "depth", "furniture", "label", "marked", "name", "path")

    def __init__(self, name: str, attributes: str, above: _Open | None, in_article: bool):
        label, marked = name, name in FURNITURE and not (name == "header" and in_article)
        if attributes:
            for a, value in _NAMED.findall(attributes):
                a, value = a.lower(), value.strip("\"'").lower()
                if a == "hidden" or a == "aria-hidden" and value == "true":
                    marked = True
                elif a != "aria-hidden":
                    label += "." + _DIGITS.sub("0", value).replace("/", ":")
                    marked = marked or name not in ("html", "body", *ARTICLES) and any(_is_furniture(x) for x in value.split())
        self.name, self.label, self.marked, self.above = name, label, marked, above
        self.depth = above.depth + 1 if above else 1
        self.path = f"{above.path if above else ''}/{label}" if self.depth <= DEEPEST else above.path
        self.chars, self.furniture = 0, marked or bool(above and above.furniture)


def _is_furniture(token: str) -> bool:
    words = _WORD.findall(token)
    return not NAMES.isdisjoint(words) and TELLING.isdisjoint(words)


def page_tokens(page: str) -> list[tuple]:
    """('open' or 'close', container) and ('text', container or None, words, in a link) ('space',) and ('block',) for each token of a page.

    Names may not silence a page: where less than OUTSIDE of its text, links
    apart, lies outside of what they mark, marked containers that hold half of
    the text or more are no furniture.
    """
    tokens = list(_scan(page))
    everything = outside = 0
    for t in tokens:
        if t[0] == "text" and not t[3]:
            n = len(t[2].strip())
            everything += n
            if t[1]:
                t[1].chars += n
            if not (t[1] and t[1].furniture):
                outside += n
    if outside >= OUTSIDE * everything:
        return tokens
    opened = [t[1] for t in tokens if t[0] == "open"]
    for c in reversed(opened):
        if c.above:
            c.above.chars += c.chars
    for c in opened:
        c.furniture = bool(c.above and c.above.furniture) or c.marked and 2 * c.chars < everything
    return tokens


def _scan(page: str):
    stack: list[_Open] = []
    names: dict[str, int] = defaultdict(int)
    at, link, skip = 0, 0, ""
    for found in _TOKEN.finditer(page):
        if not skip and found.start() > at and (run := page[at : found.start()]).strip():
            yield "text", stack[-1] if stack else None, run, link > 0
        at = found.end()
        if found[2] is None:
            continue
        end, name = bool(found[1]), found[2].lower()
        if skip:
            if end and name == skip:
                skip = ""
            continue
        if name in RAW:
            if not end and not found[3].rstrip().endswith("/"):
                skip = name
        elif name in CONTAINERS:
            yield ("block",)
            if not end:
                stack.append(_Open(name, found[3], stack[-1] if stack else None, names["article"] > 0))
                names[name] += 1
                yield "open", stack[-1]
            elif names[name]:
                while True:
                    yield "close", stack[-1]
                    closed = stack.pop().name
                    names[closed] -= 1
                    if closed == name:
                        break
        elif name == "a":
            link = max(0, link + (-1 if end else 1))
        elif name == "br":
            yield ("space",)
        elif name not in INLINE:
            yield ("block",)
    if not skip and page[at:].strip():
        yield "text", stack[-1] if stack else None, page[at:], link > 0


def _clean(run: str) -> str:
    return _SPACES.sub(" ", html.unescape(run))


def _mixed(page: int, count: int) -> int:
    return xxhash.xxh3_64_intdigest(page.to_bytes(8, "little", signed=True) + count.to_bytes(8, "little")) - (1 << 63)


def _occurrences(batches):
    """(host, kind, token, place, path) with the vector's XOR, pages, occurrences and slot characters, summed over a batch.

    place is the container of a text run, or a container itself.
    """
    for batch in batches:
        total: dict[tuple, list[int]] = {}
        for host, number, page in zip(batch.column("host").to_pylist(), batch.column("number").to_pylist(), batch.column("html").to_pylist(), strict=True):
            counts: dict[tuple, int] = defaultdict(int)
            mass: dict[tuple, int] = defaultdict(int)
            for token in page_tokens(page or ""):
                if token[0] == "text":
                    where = token[1].path if token[1] else ""
                    run, place = _clean(token[2]).strip(), _key("open", where)
                    key = "text", _key("text", where, run), place, ""
                    counts[key] += 1
                    if token[1] and not token[1].furniture and not token[3]:
                        mass[key] += len(run)
                        mass["open", place, place, where] += len(run)
                elif token[0] in ("open", "close"):
                    place = _key("open", token[1].path)
                    counts[token[0], _key(token[0], token[1].path), place, token[1].path if token[0] == "open" else ""] += 1
            if counts:
                counts["page", 0, 0, ""] = 1
            for k, n in counts.items():
                row = total.setdefault((host, *k), [0, 0, 0, 0])
                row[0] ^= _mixed(number, n)
                row[1] += 1
                row[2] += n
                row[3] += mass.get(k, 0)
        keys = list(total)
        columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
        columns += [pa.array([total[k][i] for k in keys], pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays(columns, names=["host", "kind", "token", "place", "path", "vector", "pages", "times", "chars"])


def _distinct(pages: DataFrame, work: Workspace) -> DataFrame:
    """(host, number, html) of pages, equal ones of a host once; only those are moved."""
    pages = pages.withColumn("number", F.xxhash64("html"))
    copies = work.table(pages.groupBy("host", "number").agg(F.count("*").alias("n")).filter("n > 1").select("host", "number"), "copies")
    once = pages.join(copies, ["host", "number"], "left_semi").groupBy("host", "number").agg(F.first("html").alias("html"))
    return pages.join(copies, ["host", "number"], "left_anti").select("host", "number", "html").union(once)


def templates(pages: DataFrame, work: Workspace) -> DataFrame:
    """(host, kind, token, path, outer, slot) of pages (host, html): text runs of the outer template and of the classes in it, and containers with the mean text of their slots."""
    schema = "host string, kind string, token long, place long, path string, vector long, pages long, times long, chars long"
    tokens = _distinct(pages, work).mapInArrow(_occurrences, schema).groupBy("host", "token", "kind", "place", "path")
    tokens = tokens.agg(F.bit_xor("vector").alias("vector"), F.sum("pages").alias("pages"), F.sum("times").alias("times"), F.sum("chars").alias("chars"))
    tokens = work.table(tokens.filter((F.col("pages") >= CLASS_PAGES) | (F.col("kind") == "page")), "tokens")
    hosts = tokens.filter("kind = 'page'").select("host", F.col("pages").alias("host_pages"))
    tokens = tokens.filter("kind <> 'page'")
    members = tokens.groupBy("host", "vector", "pages", "times").agg(F.count("*").alias("members"), F.count_if(F.col("kind") == "open").alias("nested"))
    tokens = tokens.join(members.filter(F.col("members") >= CLASS_TOKENS), ["host", "vector", "pages", "times"]).join(hosts, "host")
    outer = (F.col("pages") == F.col("host_pages")) & (F.col("times") == F.col("pages"))
    tokens = tokens.withColumn("outer", outer).filter((F.col("kind") == "open") | ((F.col("kind") == "text") & (F.col("outer") | (F.col("nested") > 0))))
    fixed = F.sum(F.when(F.col("kind") == "text", F.col("chars")).otherwise(0)).alias("fixed")
    fixed = tokens.filter("kind = 'text'").groupBy("host", "place").agg(fixed)
    tokens = tokens.join(fixed, ["host", "place"], "left")
    slot = F.when(F.col("kind") == "open", (F.col("chars") - F.coalesce("fixed", F.lit(0))) / F.col("pages"))
    return tokens.select("host", "kind", "token", "path", "outer", slot.alias("slot"))


def _name(path: str) -> str:
    return path.rpartition("/")[2].partition(".")[0]


def article_path(slots: dict[str, float]) -> str:
    """Where the article is, among containers (by path) whose slots hold so much text; the empty path is the page."""
    below: dict[str, float] = defaultdict(float)
    children: dict[str, set[str]] = defaultdict(set)
    for path, text in slots.items():
        while path:
            below[path] += text
            above = path.rpartition("/")[0]
            children[above].add(path)
            path = above
        below[""] += text
    node = ""
    while _name(node) not in ARTICLES:
        best = max((c for c in children[node] if _name(c) in SECTIONS), key=lambda c: (below[c], _name(c) in ARTICLES, c), default=None)
        if best is None or not below[best] or below[best] < (NAMED_SHARE if _name(best) in ARTICLES else SHARE) * below[node]:
            break
        node = best
    return node


def main_text(page: str, slots: dict[str, float] | None = None, furniture: frozenset[int] = frozenset()) -> str:
    """The article of a page, its blocks joined by two line feeds.

    slots (mean text by container path) and furniture (text tokens) are the
    host's template; containers that it lacks count by their text on the page.
    """
    tokens = list(page_tokens(page))
    own: dict[str, float] = defaultdict(float)
    for t in tokens:
        if t[0] == "text" and not t[3] and not (t[1] and t[1].furniture):
            own[t[1].path if t[1] else ""] += len(t[2].strip())
        elif t[0] == "open":
            own[t[1].path] += 0
    found = article_path({p: slots[p] if slots and p in slots else n for p, n in own.items()})
    blocks, now = [], []
    depth = 0 if found else 1
    for t in tokens:
        if t[0] == "text":
            if depth > 0 and not (t[1] and t[1].furniture) and not (furniture and _key("text", t[1].path if t[1] else "", _clean(t[2]).strip()) in furniture):
                now.append(t[2])
            continue
        if t[0] == "space":
            if now:
                now.append(" ")
            continue
        if t[0] == "open" and t[1].path == found:
            depth += 1
        elif t[0] == "close" and t[1].path == found:
            depth -= 1
        if now:
            blocks.append(_clean("".join(now)).strip())
            now = []
    if now:
        blocks.append(_clean("".join(now)).strip())
    return "\n\n".join(b for b in blocks if b)


def _extract(pages: pa.Table, template: pa.Table) -> pa.Table:
    """The texts of one part of a host."""
    tokens = template.to_pylist()
    slots = {t["path"]: t["slot"] for t in tokens if t["kind"] == "open"}
    outer, inner = (frozenset(t["token"] for t in tokens if t["kind"] == "text" and t["outer"] == o) for o in (True, False))
    levels = [outer | inner, *([outer] if inner else []), *([frozenset()] if outer else [])]
    out = []
    for page in pages.column("html").to_pylist():
        out.append(next((text for f in levels if (text := main_text(page or "", slots, f))), ""))
    columns = [pages.column("row"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]
    return pa.table(columns, names=["row", "text", "n_chars"])


def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """All columns of pages but the html, with text and n_chars (code points).

    A null or empty page has an empty text and no say in its host's template.
    Pages without a host, null URLs included, share the empty host. Equal pages
    and repeated rows have equal texts and count once for the template; a null
    page_id is a value like others. Pages are read whole, however long; of
    containers with equal slots, the last in path order is taken. Columns named
    text or n_chars, in any case, are replaced. An empty table gives an empty
    one.
    """
    others = [c for c in pages.columns if c != html_col and c.lower() not in ("text", "n_chars")]
    row = F.struct(*[F.col(f"`{c}`") for c in others])
    host = F.lower(F.coalesce(F.regexp_extract(F.col(f"`{url_col}`"), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    rows = pages.select(row.alias("row"), host.alias("host"), F.col(f"`{html_col}`").cast("string").alias("html"))
    work = Workspace(pages.sparkSession, "template-extract")
    known = work.table(templates(rows.select("host", "html"), work), "templates")
    sizes = rows.groupBy("host").agg(F.ceil(F.greatest(F.count("*") / PART_PAGES, F.coalesce(F.sum(F.length("html")), F.lit(0)) / PART_CHARS)).alias("parts"))
    sizes = work.table(sizes, "sizes")
    dealt = rows.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("html", F.to_json("row")), "parts")).select("host", "part", "row", "html")
    known = known.join(sizes, "host").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    kind = rows.schema["row"].dataType.simpleString()
    out = dealt.groupBy("host", "part").cogroup(known.groupBy("host", "part")).applyInArrow(_extract, f"row {kind}, text string, n_chars long")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in others], "text", "n_chars")
