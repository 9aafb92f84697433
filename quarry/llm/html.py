"""HTML extraction by equivalence-class template deduction.

A token is an element at its place in the tree (its path of tags, ids and classes, so that equal tags in different places
are different tokens), or a whole block of text at such a place. Its occurrence vector over the pages of a host is how
often it occurs in each of them. Tokens with the same vector form an equivalence class; the vector is never built: the
sum over pages of a hash of (page, count) stands for it, so that counting is one aggregation of partial sums, whatever
share of all pages a host holds. Equal pages of a host count once.

A class is of the template if it has at least two tokens and is on at least half of the host's pages. It nests by the
paths of its tokens: those with one parent are a group, which must occur in one order in all pages, as often as the class
does; a group that doesn't is not valid. Nesting the valid groups below their parents gives the host's template. Text tokens
in it are the same on most pages: template text. What stands between the template's tokens are slots, and the blocks in
them are what a page says itself.

A page's main text is the blocks in its slots, in page order, without those whose path says what they are (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, comments), and, if it has an article or main element, only what is
in those. If most of an article's text is template text, the host repeats the article and not a template: it stays whole. So does a
page that would lose all of its text.

Each page is parsed once; its tokens and blocks are written to the shared scratch folder.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
#: Elements that close an open one of their kind when they begin, up to the nearest of these.
SCOPE = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select", "thead": "table", "tbody": "table", "tfoot": "table"}
NOT_MAIN = frozenset("nav header footer aside form script style noscript template iframe button select textarea input svg canvas object menu dialog head title fieldset datalist".split())
NOT_MAIN_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Elements below this depth share the path of the last one above it: so deep, places are no longer told apart.
DEEP = 200
REGION = ("article", "main")
#: Words of an id or class that say that an element is no main text.
NOT_MAIN_WORD = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|adverts?|advertisements?|advertising|adbox|adslot|banners?|sponsor(?:s|ed)?|promos?|promotions?|cookies?|consent|gdpr|notices?|notification|"
    r"popups?|modals?|overlay|newsletter|subscribe|subscription|signup|social|share|sharing|sharebar|sidebars?|side|aside|related|recommend(?:ed|ations?)?|comments?|commentlist|"
    r"discussion|disqus|respond|repl(?:y|ies)|responses?|breadcrumbs?|menus?|menubar|nav|navbar|navigation|topnav|topbar|footers?|foot|headers?|masthead|site-?header|site-?footer|"
    r"pagination|pager|login|search|searchbox|widgets?|copyright|legal|disclaimer|toolbar|skip-?link|tags?|tagcloud|metadata|byline|alert|warning)(?=$|[\s_-]|\d)",
    re.I,
)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
# possessive: a tag that never ends costs one look at the rest
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]*))?""")
_SPACE = re.compile(r"\s+")


@dataclass(frozen=True)
class Settings:
    """support: share of a host's pages on which a class of the template is, at least. pages: different pages of a host, at least, for
    it to have a template. size: tokens of a class, at least. copy: share of an article that is template text, from which on the article
    itself is repeated. broadcast: template tokens of all hosts, at most, that are broadcast; more go to the pages in a join by host."""

    support: float = 0.5
    pages: int = 3
    size: int = 2
    copy: float = 0.5
    broadcast: int = 1_000_000


@dataclass
class Page:
    """items, in page order: (path, None, False, False) of an element that begins; (path of its element, text, excluded, whether
    in an article or main element) of a block."""

    items: list[tuple[str, str | None, bool, bool]] = field(default_factory=list)

    @property
    def blocks(self) -> list[tuple[str, str, bool]]:
        return [(path, text, out) for path, text, out, _ in self.items if text is not None]


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(text)} if "=" in text or text.strip() else {}


def _hidden(attrs: dict[str, str]) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()


def _excluded(tag: str, attrs: dict[str, str]) -> bool:
    if tag in NOT_MAIN or _hidden(attrs) or attrs.get("role", "").lower() in NOT_MAIN_ROLES:
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    return any(NOT_MAIN_WORD.search(_CAMEL.sub("-", unescape(attrs[k]))) for k in ("id", "class") if attrs.get(k))


def _step(tag: str, attrs: dict[str, str]) -> str:
    """A path step; digits of ids don't tell places apart."""
    name = re.sub(r"\d+", "", unescape(attrs.get("class", "") or attrs.get("id", "")))
    return f"{tag}.{'.'.join(sorted(name.split()))}" if name.strip() else tag


def _next_tag(html: str, at: int) -> tuple[tuple[int, int] | None, int, bool, str, str]:
    """(range of the text before, place after the markup, whether it ends an element, tag, attributes) of the next markup; tag is
    empty for comments and the like, and the range None if there is no more. A tag that the page's end cuts off is markup."""
    i = at
    while (i := html.find("<", i)) >= 0:
        after = html[i + 1 : i + 3]
        if html.startswith("<!--", i):
            end = html.find("-->", i + 4)
            return (at, i), end + 3 if end >= 0 else len(html), False, "", ""
        if after[:1] in ("!", "?"):
            end = html.find(">", i)
            return (at, i), end + 1 if end >= 0 else len(html), False, "", ""
        if _NAME.match(html, i):
            close = html.find(">", i)
            if close < 0:
                return (at, i), len(html), False, "", ""
            if m := _TAG.match(html, i):
                return (at, i), m.end(), bool(m[1]), m[2].lower(), m[3]
            m = _NAME.match(html, i)  # a quote that never ends: up to the next bracket
            return (at, i), close + 1, bool(m[1]), m[2].lower(), html[m.end() : close]
        i += 1
    return None, at, False, "", ""


def parse(html: str) -> Page:
    """Blocks of text and elements of a page; never fails, whatever is left open or cut off. Inline elements are part of the
    block around them; those that are hidden stand on the stack up to their end tag, and their own text is left out."""
    page = Page()
    stack: list[tuple[str, str, bool]] = [("", "", False)]
    text: list[str] = []

    def flush() -> None:
        if text:
            t = _SPACE.sub(" ", unescape("".join(text))).strip()
            text.clear()
            if t:
                up = next(s for s in reversed(stack) if s[0] not in INLINE)  # text of a hidden inline element never gets here
                page.items.append((up[1], t, up[2], any(s[0] in REGION for s in stack)))

    def close(tag: str, scope: str = "") -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == tag:
                flush()
                del stack[i:]
                return
            if stack[i][0] in scope.split():
                return

    at, n = 0, len(html)
    while at < n:
        begin, at, end_tag, tag, rest = _next_tag(html, at)
        shown = stack[-1][0] not in INLINE
        if begin is None:
            text.append(html[at:] if shown else "")
            break
        if shown:
            text.append(html[begin[0] : begin[1]])
        if not tag:
            continue
        if end_tag:
            if tag in INLINE:
                if stack[-1][0] == tag:
                    stack.pop()
                else:
                    close(tag)
                continue
            if tag == "br":
                text.append(" ")
                continue
            if tag == "p" and not any(s[0] == "p" for s in stack):
                flush()
            close(tag)
            continue
        if tag in INLINE:
            if tag in VOID:
                continue
            # within a hidden element, one of its kind must be told from it at the end tag
            if not rest.endswith("/") and (any(s[0] == tag for s in stack) or _hidden(_attributes(rest))):
                stack.append((tag, stack[-1][1], True))
            continue
        if tag == "br":
            text.append("\n")
            continue
        flush()
        if tag in VOID:
            continue
        attrs = _attributes(rest)
        if tag in RAW:  # up to its end tag there is no markup
            page.items.append((f"{stack[-1][1]}/{_step(tag, attrs)}", None, False, False))
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if tag in SCOPE:
            close(tag, SCOPE[tag])
            if tag in ("dt", "dd"):
                close("dd" if tag == "dt" else "dt", "dl")
            if tag in ("td", "th"):
                close("td" if tag == "th" else "th", "tr table")
        elif stack[-1][0] == "p":
            stack.pop()
        if rest.endswith("/") and tag not in ("p", "div", "li"):
            continue
        up = stack[-1]
        path = f"{up[1]}/{_step(tag, attrs)}" if len(stack) < DEEP else up[1]
        page.items.append((path, None, False, False))
        stack.append((tag, path, up[2] or _excluded(tag, attrs)))
    flush()
    return page


def host(url: str):
    """Lower-case host of an address column, without a leading www. or m.; empty if there is none."""
    found = F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(found), r"^(?:www|m)\.", "")


def _id(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass"), 7) - (1 << 63)


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, page (equal for equal html), and, in page order, for each token: token, parent (of its group) and text
    (null for an element), out (excluded by its path) and inside (an article or main element)."""
    fields = [
        T.StructField("page_id", pages.schema["page_id"].dataType), T.StructField("url", T.StringType()), T.StructField("host", T.StringType()), T.StructField("page", T.LongType()),
        T.StructField("token", T.ArrayType(T.LongType())), T.StructField("parent", T.ArrayType(T.LongType())), T.StructField("text", T.ArrayType(T.StringType())),
        T.StructField("out", T.ArrayType(T.BooleanType())), T.StructField("inside", T.ArrayType(T.BooleanType())),
    ]
    names = [f.name for f in fields]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column("html").to_pylist()
            known: dict[str, tuple[int, int]] = {}  # of a path: its token, and its parent's
            for a, b in common.slices(whole):
                columns: list[list] = [[] for _ in kinds]
                ends = [0]
                for html in whole[a:b]:
                    for path, text, out, inside in parse(html or "").items:
                        if path not in known:
                            known[path] = _id(path), _id(path.rpartition("/")[0])
                        own = known[path]
                        row = (own[0], own[1], None, False, False) if text is None else (_id(path, text), own[0], text, out, inside)
                        for column, value in zip(columns, row):
                            column.append(value)
                    ends.append(len(columns[0]))
                offsets = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(c, k)) for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("page_id", "url", "host", "page")), *lists], names)
        common.release()

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), host("url").alias("host"), F.xxhash64("html").alias("page"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, T.StructType(fields))


def _sums(found: DataFrame) -> DataFrame:
    """Per host and token of found(host, page, token, parent, block): parent, block, pages, total, and vector, which stands for the
    occurrence vector. The host's own row has token 0 and parent null."""
    schema = "host string, token long, parent long, block boolean, pages long, total long, vector long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple, list[int]] = {}
            for name, page, tokens, parents, block in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "token", "parent", "block"))):
                what = {t: (p, b) for t, p, b in zip(tokens, parents, block)}
                for token, n in Counter(tokens).items():
                    got = sums.setdefault((name, token, *what[token]), [0, 0, 0])
                    got[0] += 1
                    got[1] += n
                    got[2] = (got[2] + (page * 0x9E3779B97F4A7C15 + n) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
                sums.setdefault((name, 0, None, None), [0, 0, 0])[0] += 1
            rows = [(*k, v[0], v[1], v[2] - (1 << 64) if v[2] >> 63 else v[2]) for k, v in sums.items()]
            types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names)
        common.release()

    # the tasks' sums modulo 2**64 are added as decimals, and taken modulo 2**64 again
    vector = F.pmod(F.sum(F.col("vector").cast("decimal(38,0)")), F.expr("cast(18446744073709551616 as decimal(38,0))"))
    return found.mapInArrow(run, schema).groupBy("host", "token", "parent", "block").agg(F.sum("pages").alias("pages"), F.sum("total").alias("total"), vector.alias("vector"))


def _with_hosts(pages: DataFrame, rows: DataFrame, columns: list[str], s: Settings) -> DataFrame:
    """pages with arrays of the columns of rows(host, ...), those of a page's host; null without any."""
    lists = rows.groupBy("host").agg(F.collect_list(F.struct(*columns)).alias("rows")).select("host", *[F.col("rows")[c].alias(f"host_{c}") for c in columns])
    small = rows.limit(s.broadcast + 1).count() <= s.broadcast
    return pages.join(lists.hint("broadcast" if small else "merge"), "host", "left")


def _orders(found: DataFrame, groups: DataFrame, s: Settings) -> DataFrame:
    """(host, group) of groups(host, token, group, members) that occur in one order: on each page all members, time after time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], list[int]] = {}
        of: dict[str, tuple[dict, dict]] = {}
        for batch in batches:
            lists = [batch.column(f"host_{c}") for c in ("token", "group", "members")]
            for i, (name, page, tokens) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("host", "page", "token")))):
                if name not in of:
                    if len(of) > 1000:
                        of.clear()
                    t, g, m = (x[i].as_py() or [] for x in lists)
                    of[name] = dict(zip(t, g)), dict(zip(g, m))
                group_of, members = of[name]
                order: dict[int, list[int]] = {}
                for t in tokens:
                    if (g := group_of.get(t)) is not None:
                        order.setdefault(g, []).append(t)
                for g, run_ in order.items():
                    m = members[g]
                    first = tuple(run_[:m])
                    ordered = len(set(first)) == m and run_ == list(first) * (len(run_) // m)
                    low, high = (hash(first), hash(first)) if ordered else (-(1 << 63), (1 << 63) - 1)
                    got = seen.setdefault((name, g), [low, high])
                    got[0], got[1] = min(got[0], low), max(got[1], high)
        if seen:
            yield pa.RecordBatch.from_pydict({
                "host": pa.array([k[0] for k in seen], pa.string()), "group": pa.array([k[1] for k in seen], pa.int64()),
                "least": pa.array([v[0] for v in seen.values()], pa.int64()), "most": pa.array([v[1] for v in seen.values()], pa.int64()),
            })

    told = _with_hosts(found, groups, ["token", "group", "members"], s).filter("host_token is not null")
    per = told.mapInArrow(run, "host string, group long, least long, most long").groupBy("host", "group").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    return per.filter("least = most").select("host", "group")


def templates(found: DataFrame, s: Settings = Settings()) -> DataFrame:
    """host, token: the tokens of the hosts' templates, and whether they are text (block), from parsed pages."""
    pages = found.select("host", "page", "token", "parent", F.transform("text", lambda t: t.isNotNull()).alias("block"))
    pages = common.settle(pages.dropDuplicates(["host", "page"]))
    sums = common.settle(_sums(pages).filter("pages > 1 or token = 0"))
    hosts = sums.filter("token = 0 and parent is null").select("host", F.col("pages").alias("all_pages")).filter(F.col("all_pages") >= s.pages)
    frequent = sums.filter("parent is not null").join(hosts, "host").filter(F.col("pages") >= F.col("all_pages") * s.support)
    classes = frequent.groupBy("host", "vector").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= s.size)
    member = frequent.join(classes, ["host", "vector"]).select("host", "token", "block", F.xxhash64("vector", "parent").alias("group"))
    member = common.settle(member)
    groups = member.groupBy("host", "group").agg(F.count(F.lit(1)).alias("members"))
    ordered = _orders(pages, member.join(groups.filter("members > 1"), ["host", "group"]), s)
    alone = groups.filter("members = 1").select("host", "group")  # always in order
    return member.join(alone.unionByName(ordered), ["host", "group"]).select("host", "token", "block")


def main_text(blocks: list[tuple[int, str, bool, bool]], template: frozenset | set, s: Settings = Settings()) -> str:
    """The main text of a page's blocks (token, text, excluded, in an article) under its host's template text."""
    rest = [b for b in blocks if not b[2]]
    article = [b for b in rest if b[3]]
    rest = article or rest
    own = [b for b in rest if b[0] not in template]
    whole = sum(len(b[1]) for b in rest)
    if article and whole - sum(len(b[1]) for b in own) > s.copy * whole:
        own = rest
    return " ".join(b[1] for b in own or rest)


def extract(pages: DataFrame, s: Settings = Settings()) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages(page_id, url, html).

    A null html has an empty text. Pages without a host in their address share the template of the empty host. Repeated
    rows give equal rows. Other columns are left out. Empty input gives an empty frame.
    """
    schema = T.StructType([
        T.StructField("page_id", pages.schema["page_id"].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()),
    ])
    found = common.settle(parsed(pages))
    fixed = common.settle(templates(found, s).filter("block").select("host", "token"))
    rows = _with_hosts(found.select("page_id", "url", "host", "token", "text", "out", "inside"), fixed, ["token"], s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str, frozenset] = {}
        for batch in batches:
            template, out = batch.column("host_token"), []
            names = batch.column("host").to_pylist()
            for i, blocks in enumerate(zip(*(batch.column(c) for c in ("token", "text", "out", "inside")))):
                if names[i] not in sets:
                    if len(sets) > 1000:
                        sets.clear()
                    sets[names[i]] = frozenset(template[i].as_py() or ())
                out.append(main_text([b for b in zip(*(c.as_py() for c in blocks)) if b[1] is not None], sets[names[i]], s))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], schema.names)
        common.release()

    return rows.mapInArrow(run, schema)
