"""Main text of web pages by template deduction over the pages of a host.

A page is a sequence of tokens: tags with their place in the tree, and pieces
of text with theirs.  Tokens of a host that occur equally often in each of its
pages have the same occurrence vector and form an equivalence class (Arasu and
Garcia-Molina 2003).  A class is valid if it spans at least half of the host's
pages, and three at least, if its tokens come in one order on all of them, if
it crosses no larger class, and if it lies in the same gap of the same class
wherever it occurs.  So the valid classes nest: they make up the host's
template, a tree whose nodes are classes and whose edges are the gaps between
their tokens.  What a page has beside its template fills the slots; their text
is extracted, except in parts that are not the article.

Scale: each page is parsed once, and its tokens and the blocks that may be
article are written to the shared folder.  A host may have a third of all
pages, so vectors are never gathered: a vector is represented by the sum of
hash(page) over the occurrences, which is equal for equal vectors, adds up in
map-side combines, and makes a class one number.  Order and nesting are checked
over the stored tokens, one row a class and batch of pages.  Templates hold
only tokens that half of a host's pages share, so they are smaller than its
pages; they are sent to all tasks if they hold at most ``max_broadcast`` tokens
in all, and joined by host, frequent hosts spread, otherwise.

Which slots are the article: those inside an article or main element, if the
page has text there; else all slots that are not menus, headers, footers,
sidebars, notices, adverts, forms or comments by element, role or class name,
and not blocks of links only.  An article that is template throughout is a
copy of one article on one host, not a template, and is kept whole.

Defined results: a null or empty html, or one without article text, gives the
empty text; very long pages are parsed whole; markup that never ends is
dropped; unclosed elements end with their parent; a null url, or one without
``://``, belongs to the host of empty name; repeated rows count as pages of
their own; other columns pass through, but for the html, unless it is asked
for, and a column that bears a result's name is replaced by the result.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.common import join_spread, stored, table
from kinweave.llm.urlfilter import url_host

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<(/?)([a-zA-Z][\w:-]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([\w:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAMES = re.compile(r"[a-z0-9]+")
_TELLS = re.compile("class|id|role|style|itemprop|aria", re.I)  # attributes that say what an element is; hidden has "id", too
#: Element names of the HTML standard, by how they are treated.
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements, roles and class or id words of parts that are not the article.
OUT_TAGS = frozenset("nav footer aside form head menu dialog button select option label object audio video canvas".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies"
    " disclaimer disqus footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination"
    " popup promo promoted recommended related replies reply respond search share sharing sidebar signup skip social sponsor"
    " sponsored subscribe subscription toolbar topbar widget widgets".split()
)
IN_NAMES = frozenset("article articlebody".split())
_CELL = frozenset("td th br img input".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def _kind(name: str, attributes: str) -> tuple[bool, bool, str]:
    """(not the article, the article, label) of an opening tag."""
    out, inside, label = name in OUT_TAGS, name in ("article", "main"), name
    if attributes and _TELLS.search(attributes):
        found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
        names = set(_NAMES.findall(f"{found.get('class', '')} {found.get('id', '')}".lower()))
        role = found.get("role", "").lower()
        label = f"{name}.{' '.join(sorted(names))}"
        inside = inside or role == "main" or bool(IN_NAMES & set(found.get("itemprop", "").lower().split()))
        if name not in ("html", "body"):
            out = out or role in OUT_ROLES or bool(OUT_NAMES & names) or found.get("aria-hidden") == "true"
            out = out or bool(re.search(r"(^|\s)hidden(\s|=|$)", attributes)) or "display:none" in found.get("style", "").replace(" ", "")
        if name == "header" or "header" in names and name not in HEADING:
            out = out or not inside
    elif name == "header":
        out = True
    return out, inside, label


def blocks_of(page: str) -> tuple[list[tuple[str, str, bool, bool, bool]], list[tuple[str, str]]]:
    """((path, text, out, in article, links only) of each text block, (path, text) of all tokens; no text: a tag) in page order."""
    found: list = []
    tokens: list[tuple[str, str]] = []
    stack: list[tuple[str, bool, bool, str]] = []  # (name, out, inside, path)
    parts: list[str] = []
    linked = plain = False
    where = ("", False, False)

    def flush():
        nonlocal linked, plain
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                found.append((where[0], text, where[1], where[2], linked and not plain))
                tokens.append((where[0], text))
            parts.clear()
        linked = plain = False

    def add(text: str):
        nonlocal linked, plain, where
        if text:
            if not text.isspace():
                if not (linked or plain):
                    block = next((s for s in reversed(stack) if s[0] in BLOCK), None)
                    top = stack[-1] if stack else ("", False, False, "")
                    where = (block[3] if block else "", top[1], top[2])
                if any(s[0] == "a" for s in stack):
                    linked = True
                else:
                    plain = True
            parts.append(text)

    def leave(i: int):
        if any(s[0] in BLOCK or s[1] != (stack[i - 1][1] if i else False) for s in stack[i:]):
            flush()
        del stack[i:]

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if i is not None:
                leave(i)
            continue
        attributes = m[3] if m[2] else m[6]
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in BLOCK:
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"), None)
            if i is not None and not any(s[0] in ("button", "table") for s in stack[i:]):
                leave(i)
            flush()
        for other in _CLOSES.get(name, ()):
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in (other, "ul", "ol", "dl", "table")), None)
            if i is not None and stack[i][0] == other:
                leave(i)
        if name in _CELL:
            parts.append(" ")
        if name in VOID:
            continue
        out, inside, label = _kind(name, attributes)
        up = stack[-1] if stack else ("", False, False, "")
        if up[1] != (up[1] or out):
            flush()
        in_article = up[2] or inside
        # the head of an article holds its heading; nothing else of a header is article
        out = (up[1] and not (name in HEADING and any(s[0] == "header" and s[2] for s in stack) and not any(s[1] and s[0] != "header" for s in stack))) or out
        path = f"{up[3]}/{label}"
        tokens.append((path, ""))
        stack.append((name, out, in_article, path))
    flush()
    return found, tokens


def _hash(path: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{path}\x00{text}") - 2**63


def tokens_of(page: str) -> list[int]:
    """The hashed tokens of a page, tags and texts by path, in page order."""
    return [_hash(*t) for t in blocks_of(page)[1]]


def main_text(page: str | None, template: frozenset | set = frozenset()) -> str:
    """The article's blocks, joined by newlines."""
    return _article([(_hash(b[0], b[1]), b[1], b[3], b[4]) for b in blocks_of(page or "")[0] if not b[2]], template)


def _article(blocks, template) -> str:
    """Of (token, text, in article, links only) the article's texts that fill slots of the template."""
    slots = [b for b in blocks if b[0] not in template]
    article = [b[1] for b in slots if b[2]] or [b[1] for b in blocks if b[2]]
    return "\n".join(article or [b[1] for b in slots if not b[3]])


def _orders(tokens: list[int], of: dict[int, int], size: dict[int, int]) -> Iterator[tuple[int, int, int, bool]]:
    """Of each class of a page: (class, hash of its order, 0, whether it repeats in that order)."""
    own: dict[int, list[int]] = {}
    for t in tokens:
        if t in of:
            own.setdefault(of[t], []).append(t)
    for c, x in own.items():
        first = x[: size[c]]
        good = len(set(first)) == size[c] and x == first * (len(x) // size[c])
        yield c, xxhash.xxh64_intdigest(np.array(first, np.int64).tobytes()) - 2**63, 0, good


def _nesting(tokens: list[int], of: dict[int, int], size: dict[int, int]) -> Iterator[tuple[int, int, int, bool]]:
    """Of each class of a page, all in order: (class, class and gap around it, whether it crosses no larger class and has one gap)."""
    bad: set[int] = set()
    seen: dict[int, int] = {}
    around: dict[int, tuple[int, int]] = {}
    stack: list[int] = []  # classes that have begun and not ended
    for t in tokens:
        c = of.get(t)
        if c is None or c in bad:
            continue
        if not seen.get(c):
            up = (stack[-1], seen[stack[-1]]) if stack else (0, 0)
            if around.setdefault(c, up) != up:
                bad.add(c)
                continue
            stack.append(c)
        while stack[-1] != c and c not in bad:
            bad.add(stack.pop() if size[stack[-1]] <= size[c] else c)
        if c in bad:
            stack.remove(c)
            continue
        seen[c] = (seen.get(c, 0) + 1) % size[c]
        if seen[c] == 0:
            stack.pop()
    for c, up in around.items():
        yield c, *up, c not in bad


def parsed_pages(pages: DataFrame, url: str = "url", html: str = "html", keep: list[str] = ()) -> DataFrame:
    """(h, row, mark, tokens, place, text, inside, links), stored: each page's host, kept columns, hash, tokens, and the
    blocks that may be article, ``place`` being the token of each."""
    rows = pages.select(F.xxhash64(url_host(F.col(url))).alias("h"), F.struct(*([F.col(f"`{c}`") for c in keep] or [F.lit(0).alias("_")])).alias("row"), F.col(html).alias("html"))
    more = "mark long, tokens array<long>, place array<int>, text array<string>, inside array<boolean>, links array<boolean>"
    schema = T.StructType([*rows.drop("html").schema, *T.StructType.fromDDL(more)])

    def parse(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                own = batch.slice(i, 512)
                out: tuple[list, ...] = ([], [], [], [], [], [])
                known: dict[str, int] = {}
                for page in own.column(2).to_pylist():
                    found, tokens = blocks_of(page or "")
                    texts = [k for k, t in enumerate(tokens) if t[1]]
                    kept = [(k, b) for k, b in zip(texts, found, strict=True) if not b[2]]
                    hashed = [_hash(*t) if t[1] else known.get(t[0]) or known.setdefault(t[0], _hash(*t)) for t in tokens]
                    for x, y in zip(out, (xxhash.xxh64_intdigest(page or "") >> 33, hashed, [k for k, _ in kept], *([b[j] for _, b in kept] for j in (1, 3, 4))), strict=True):
                        x.append(y)
                types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.bool_()))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], names=schema.names)

    return stored(rows.mapInArrow(parse, schema))


def _vectors(batches):
    """(h, token, n_pages, vector): the sums of a batch over its pages; token 0 stands for the page itself."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column(2)
        page = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
        page = np.concatenate([page, np.arange(batch.num_rows)])
        token = np.concatenate([lists.flatten().to_numpy(zero_copy_only=False), np.zeros(batch.num_rows, np.int64)])
        host = batch.column(0).to_numpy(zero_copy_only=False)[page]
        order = np.lexsort((page, token, host))
        page, token, host = page[order], token[order], host[order]
        new = np.ones(len(page), bool)
        new[1:] = (token[1:] != token[:-1]) | (host[1:] != host[:-1])
        at = np.flatnonzero(new)
        other = new.copy()
        other[1:] |= page[1:] != page[:-1]
        mark = batch.column(1).to_numpy(zero_copy_only=False)[page]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (host[at], token[at], np.add.reduceat(other.astype(np.int64), at), np.add.reduceat(mark, at))], names=["h", "token", "n_pages", "vector"])


class _Model:
    """Templates by host: a dictionary for all tasks if they are small, a table otherwise."""

    def __init__(self, rows: DataFrame, max_broadcast: int):
        """``rows``: (h, n, tokens, classes), n the pages of the host."""
        self.rows, self.shared = rows, None
        if (rows.agg(F.sum(F.size("tokens"))).first()[0] or 0) <= max_broadcast:
            found = {r.h: (r.tokens, r.classes) for r in rows.collect()}
            self.shared = rows.sparkSession.sparkContext.broadcast(found)

    def beside(self, pages: DataFrame) -> DataFrame:
        """The pages, with the columns tokens and classes of their templates if these are not sent to the tasks."""
        if self.shared is not None:
            return pages
        model = self.rows.select("h", "n", F.col("tokens").alias("t_tokens"), F.col("classes").alias("t_classes"))
        return join_spread(pages, model, ["h"], ["mark"], how="left").drop("n")

    def each(self):
        """A function of a batch: of each row the template's (tokens, classes), or nothing."""
        shared = self.shared

        def get(batch):
            if shared is not None:
                return [shared.value.get(h) for h in batch.column("h").to_pylist()]
            return [t and (t, c) for t, c in zip(batch.column("t_tokens").to_pylist(), batch.column("t_classes").to_pylist(), strict=True)]

        return get


def templates(parsed: DataFrame, min_share: float = 0.5, min_pages: int = 3, max_broadcast: int = 500_000) -> DataFrame:
    """(h, n, tokens, classes, parents, gaps): the template of each host, n its pages; a class of parent 0 is at the top."""
    token = parsed.select("h", "mark", "tokens").mapInArrow(_vectors, "h long, token long, n_pages long, vector long")
    # one row a token and host: pages that have it, and its occurrence vector as one number
    token = token.groupBy("h", "token").agg(F.sum("n_pages").alias("n_pages"), F.sum(F.col("vector").cast("decimal(38,0)")).alias("vector"))
    token = token.filter(F.col("n_pages") >= min_pages)
    size = token.filter("token = 0").select("h", F.col("n_pages").alias("n"))
    often = token.filter("token <> 0").join(size, "h").filter(F.col("n_pages") >= min_share * F.col("n"))
    often = often.select("h", "n", "token", F.xxhash64("vector", "n_pages").alias("class"))
    found = often.groupBy("h", "n").agg(F.collect_list("token").alias("tokens"), F.collect_list("class").alias("classes"))
    for test in (_orders, _nesting):
        found = _valid(parsed, stored(found), test, max_broadcast)
    return found


def _valid(parsed: DataFrame, found: DataFrame, test, max_broadcast: int) -> DataFrame:
    """The classes that pass a test on each page of their host, and with the same result, which is (parents, gaps)."""
    model = _Model(found, max_broadcast)
    get = model.each()

    def check(batches):
        for batch in batches:
            seen: dict = {}
            of: dict = {}
            for h, tokens, template in zip(batch.column("h").to_pylist(), batch.column("tokens").to_pylist(), get(batch), strict=True):
                if not template:
                    continue
                if h not in of:
                    of[h] = dict(zip(*template, strict=True)), Counter(template[1])
                for c, a, b, good in test(tokens, *of[h]):
                    old = seen.setdefault((h, c), (a, b, good))
                    if old != (a, b, good):
                        seen[h, c] = (a, b, False)
            cols = zip(*((h, c, *x) for (h, c), x in seen.items()), strict=True) if seen else [[]] * 5
            kinds = [pa.int64()] * 4 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=["h", "class", "a", "b", "good"])

    seen = model.beside(parsed.select("h", "mark", "tokens")).mapInArrow(check, "h long, class long, a long, b long, good boolean")
    both = F.struct("a", "b")
    valid = seen.groupBy("h", "class").agg(F.min(both).alias("low"), F.max(both).alias("high"), F.min("good").alias("good")).filter("low = high and good")
    each = found.select("h", "n", F.explode(F.arrays_zip("tokens", "classes")).alias("x")).select("h", "n", F.col("x.tokens").alias("token"), F.col("x.classes").alias("class"))
    each = each.join(valid.select("h", "class", "low.a", "low.b"), ["h", "class"])
    lists = [F.collect_list(c).alias(name) for c, name in (("token", "tokens"), ("class", "classes"), ("a", "parents"), ("b", "gaps"))]
    return each.groupBy("h", "n").agg(*lists)


def extract(pages: DataFrame, url: str = "url", html: str = "html", keep_html: bool = False, max_broadcast: int = 500_000, **options) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` added (or replaced), without the html unless ``keep_html``."""
    added = ("text", "n_chars")
    old = [c for c in pages.columns if c.lower() not in added and (keep_html or c != html)]
    parsed = parsed_pages(pages, url, html, old)
    model = _Model(stored(templates(parsed, max_broadcast=max_broadcast, **options)), max_broadcast)
    get = model.each()
    rows = model.beside(parsed.select("h", "row", "mark", F.transform("place", lambda i: F.get("tokens", i)).alias("tokens"), "text", "inside", "links"))
    schema = T.StructType([parsed.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                own = batch.slice(i, 512)
                sets: dict = {}
                text = []
                for h, template, blocks in zip(own.column("h").to_pylist(), get(own), zip(*(own.column(c).to_pylist() for c in ("tokens", "text", "inside", "links")), strict=True), strict=True):
                    if h not in sets:
                        sets[h] = frozenset(template[0]) if template else frozenset()
                    text.append(_article(list(zip(*blocks, strict=True)), sets[h]))
                yield pa.RecordBatch.from_arrays([own.column("row"), pa.array(text, pa.string()), pa.array(np.array([len(t) for t in text], np.int64))], names=schema.names)

    out = rows.mapInArrow(run, schema)
    return out.select(*(F.col("row").getField(c).alias(c) for c in old), *added)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
