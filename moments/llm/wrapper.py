"""Main text of web pages by wrapper induction.

Every page is parsed into a small tree. The pages of a host are aligned with reference pages of that host by simple tree
matching: the matching of two nodes with equal tags is one plus the best order-keeping matching of their children. Aligned
text nodes that are the same over most different articles of a layout are its template; what varies is a slot.

A host has up to ``references`` reference pages, one of each of its most frequent layouts (a layout is the set of sectioning
elements and class names of a page); a page of another layout goes with the reference that it matches best. Template counts are
grouped by (host, reference, node, text), so a host with a third of all pages is spread by the partial sums, and the pages of
a frequent host meet its references under several salts. Exact copies of one article on a host count once; a page of which
the template would take most of the main text is a near copy of other articles and keeps it.

What a page says of its parts comes second: elements that are never content (navigation, forms, scripts) go everywhere; words
of class names and ids only outside an article or main element, where any word of NAMES counts; inside one, only block elements
count whose whole class or id is a name of INSIDE (adverts, comments and the like, which vary by page as content does).

Matching works on shapes (a tag and the shapes of its children), so equal subtrees are matched once, and it is exact for
lists of any length: long ones are aligned by halves in linear memory.

Defined results: a null or empty page has empty text; a null url is a host of its own; pages without an article element are
read from the body; repeated rows give repeated results; an empty table gives no rows; rows without page_id are never
references.
"""

from __future__ import annotations

import html
import re
import sys
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moments.llm.common import save

#: Elements that are never part of an article.
NEVER = set(
    "nav footer aside form script style noscript template iframe svg canvas object embed button select option input textarea "
    "label dialog menu head title meta link audio video map datalist fieldset legend".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg".split())
BLOCKS = set(
    "address article blockquote body center dd details dir div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "html li main nav ol p pre section summary table tbody td tfoot th thead tr ul aside br".split()
)
#: Words of class, id or role that name a part outside the article; used outside article and main only.
NAMES = set(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription signup paywall nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs pagination pager sidebar side rail widget widgets related recommended recommendations share sharing "
    "social footer header masthead comment comments commentlist disqus reply replies toolbar toc skip search login tags "
    "contentinfo complementary dialog tablist hidden".split()
)
#: Whole class names and ids of blocks inside an article that are not its text, and roles that say so.
INSIDE = set(
    "ad ads advert adverts advertisement advertisements adsense ad-box ad-container ad-slot sponsored sponsored-content promo "
    "comment comments comment-list commentlist comments-area comments-section comment-section comment-thread comment-form disqus "
    "disqus_thread replies reader-comments related related-posts related-articles related-stories recommended-articles share "
    "share-buttons share-bar sharing social social-share newsletter newsletter-signup newsletter-box subscribe-box paywall "
    "cookie-banner cookie-notice cookie-consent consent-banner sidebar breadcrumb breadcrumbs pagination".split()
)
ROLES = set("navigation complementary contentinfo dialog search".split())
HOLDERS = set("div section article ul ol dl table header details figure center".split())
CLOSES = {  # an opening tag that ends an open element of these
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
# A quoted value may hold > but not <; a quote without its pair is a character like others, so that every tag ends.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+'|["'])*+)(?:>|(?=<)|\Z)""",
    re.S,
)
_NAME = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_SPACE = re.compile(r"\s+")


@dataclass(frozen=True)
class WrapperRules:
    #: Share of the different articles of a layout in which a text must stand to be template, and the least number of them.
    share: float = 0.7
    least: int = 3
    #: A page keeps what would be template beyond this share of its main text; of its body where it has no main element.
    most_of_main: float = 0.5
    most_of_body: float = 0.9
    references: int = 3
    #: Pages of a host to a salt of the join with its references.
    salt_pages: int = 5000
    broadcast_bytes: int = 64_000_000
    #: Whether what a page says of its parts (elements, names, main elements) counts beside alignment.
    named: bool = True


class Node:
    __slots__ = ("tag", "kids", "text", "out", "main", "shape")

    def __init__(self, tag: str, out: bool = False, main: bool = False):
        self.tag, self.kids, self.text, self.out, self.main, self.shape = tag, [], "", out, main, 0


def _outside(tag: str, attributes: str, main: bool) -> bool:
    """Whether an element says that it is not part of an article; ``main``: it stands inside an article or main element."""
    if tag in NEVER:
        return True
    if "=" not in attributes and "hidden" not in attributes.lower():
        return False
    for name, value in _NAME.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" and not value or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value.strip() in ROLES:
            return True
        if name not in ("class", "id", "role") or tag in ("html", "body"):
            continue
        if main:
            if tag in HOLDERS and INSIDE & set(value.split()):
                return True
        elif tag not in ("article", "main") and NAMES & set(re.split(r"[^a-z0-9]+", value)):
            return True
    return False


def parse(page: str, named: bool = True) -> Node:
    """A tree of elements and text nodes (tag "#"); raw elements and comments leave nothing. named: whether elements and their names
    put parts outside the article."""
    root = Node("#root")
    open_, at, n = [root], 0, len(page)
    count: dict[str, int] = {}

    def close(i: int) -> None:
        for x in open_[i:]:
            count[x.tag] -= 1
        del open_[i:]

    def text(piece: str) -> None:
        if piece:
            node = Node("#", open_[-1].out, open_[-1].main)
            node.text = html.unescape(piece) if "&" in piece else piece
            open_[-1].kids.append(node)

    for m in iter(lambda: _TOKEN.search(page, at), None):
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if count.get(tag):  # an end tag of nothing open is left out
                close(next(i for i in range(len(open_) - 1, 0, -1) if open_[i].tag == tag))
            continue
        if tag in BLOCKS and tag not in ("br", "hr") and open_[-1].tag == "p" and tag != "p":
            close(len(open_) - 1)
        for i in range(len(open_) - 1, max(0, len(open_) - 4), -1):
            if open_[i].tag in CLOSES.get(tag, ()):
                close(i)
                break
            if open_[i].tag in ("ul", "ol", "table", "dl", "div", "article", "section", "body"):
                break
        inside = open_[-1].main
        out = named and (open_[-1].out or _outside(tag, m[3], inside))
        node = Node(tag, out, named and (inside or tag in ("article", "main")))
        if tag in RAW:
            end = re.compile(rf"</{tag}(?:\s[^>]*)?>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        open_[-1].kids.append(node)
        if tag not in VOID and not m[3].endswith("/"):
            open_.append(node)
            count[tag] = count.get(tag, 0) + 1
    text(page[at:])
    return root


def squeezed(text: str) -> str:
    return _SPACE.sub(" ", text)


def _in_order(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack.extend(reversed(x.kids))
    return out


def _last_row(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Best scores of all of a with each beginning of b."""
    row = np.zeros(len(b) + 1, "int64")
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[:-1] + s[x, b], row[1:]))
    return row


def _aligned(a: np.ndarray, b: np.ndarray, s: np.ndarray, cells: int = 1 << 22) -> list[tuple[int, int]]:
    """The pairs of places of a best order-keeping matching of two lists of kinds; s: the score of each pair of kinds."""
    m, n = len(a), len(b)
    if not m or not n:
        return []
    if m > 1 and m * n > cells:
        half = m // 2
        j = int(np.argmax(_last_row(a[:half], b, s) + _last_row(a[half:][::-1], b[::-1], s)[::-1]))
        return _aligned(a[:half], b[:j], s, cells) + [(i + half, k + j) for i, k in _aligned(a[half:], b[j:], s, cells)]
    rows = np.zeros((m + 1, n + 1), "int64")
    for i, x in enumerate(a, 1):
        rows[i, 1:] = np.maximum.accumulate(np.maximum(rows[i - 1, :-1] + s[x, b], rows[i - 1, 1:]))
    pairs, i, j = [], m, n
    while i and j:
        if rows[i, j] == rows[i - 1, j]:
            i -= 1
        elif rows[i, j] == rows[i, j - 1]:
            j -= 1
        else:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
    return pairs[::-1]


class Matcher:
    """Simple tree matching over shapes. What lies inside parts that are never content has no part in a shape."""

    def __init__(self):
        self.names: dict[tuple, int] = {}
        self.tags: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self.best: dict[tuple[int, int], int] = {}

    def shape(self, root: Node) -> Node:
        """Sets the shape of every node."""
        for x in reversed(_in_order(root)):
            key = (x.tag, () if x.out else tuple(k.shape for k in x.kids))
            if key not in self.names:
                self.names[key] = len(self.tags)
                self.tags.append(x.tag)
                self.kids.append(key[1])
                self.sizes.append(1 + sum(self.sizes[k] for k in key[1]))
            x.shape = self.names[key]
        return root

    def _kinds(self, a: int, b: int):
        """The children of two shapes as kinds, and the scores of all pairs of kinds."""
        ka, ia = np.unique(np.array(self.kids[a]), return_inverse=True)
        kb, ib = np.unique(np.array(self.kids[b]), return_inverse=True)
        return ia, ib, np.array([[self.score(int(x), int(y)) for y in kb] for x in ka])

    def score(self, a: int, b: int) -> int:
        """Nodes in the best matching of two shapes."""
        if a == b:
            return self.sizes[a]
        if self.tags[a] != self.tags[b]:
            return 0
        if not self.kids[a] or not self.kids[b]:
            return 1
        key = (a, b) if a < b else (b, a)
        if key not in self.best:
            if len(self.kids[a]) == len(self.kids[b]) == 1:
                self.best[key] = 1 + self.score(self.kids[a][0], self.kids[b][0])
            else:
                self.best[key] = 1 + int(_last_row(*self._kinds(*key))[-1])
        return self.best[key]

    def match(self, a: Node, b: Node) -> dict[int, Node]:
        """The pairs of a best matching, as {id of a's node: b's node}."""
        found, stack = {}, [(a, b)]
        while stack:
            x, y = stack.pop()
            if x.tag != y.tag:
                continue
            found[id(x)] = y
            if x.out or y.out:
                continue
            if x.shape == y.shape:
                stack.extend(zip(x.kids, y.kids))
            elif x.kids and y.kids:
                stack.extend((x.kids[i], y.kids[j]) for i, j in _aligned(*self._kinds(x.shape, y.shape)))
        return found


def pieces(root: Node, found: dict[int, Node], numbers: dict[int, int], named: bool = True):
    """The candidate text in page order, (block, number of the aligned reference node or -1, text), and whether it comes from
    article or main elements."""
    mains, stack = [], [root]
    while stack:
        x = stack.pop()
        if x.main and not x.out:
            mains.append(x)
        else:
            stack.extend(reversed(x.kids))
    out, block = [], 0
    for start in mains or [root]:
        todo = [(start, True)]
        while todo:
            x, opening = todo.pop()
            if not opening:
                block += 1
            elif x.tag == "#":
                if not x.out and x.text:
                    to = found.get(id(x))
                    out.append((block, -1 if to is None else numbers[id(to)], squeezed(x.text)))
            elif not x.out and (x.main or not named or x.tag != "header"):
                if x.tag in BLOCKS:
                    block += 1
                    todo.append((x, False))
                todo.extend((k, True) for k in reversed(x.kids))
        block += 1
    return out, bool(mains)


def _host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))


def _layout(page: Column) -> Column:
    """The set of sectioning elements and of class names of a page."""
    said = r"(?i)<(?:nav|header|footer|aside|main|article|section|form)\b|\bclass\s*=\s*[\"']?[a-z_-]+"
    parts = F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(said), F.lit(0))
    return F.xxhash64(F.array_sort(F.array_distinct(parts)))


def _references(pages: DataFrame, rules: WrapperRules) -> tuple[DataFrame, bool]:
    """(host, pages, layouts, trees): the pages of each host and its references by layout; and whether all may be broadcast."""
    counts = save(
        pages.filter("html is not null").groupBy("host", "layout").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("page_id"))
    )
    left, chosen = counts, None
    for _ in range(rules.references):  # partial maxima: a host of very many layouts is no group of a task
        first = save(left.groupBy("host").agg(F.max(F.struct("n", -F.col("page_id"), "layout")).alias("x")).select("host", F.col("x.layout").alias("layout")))
        chosen = first if chosen is None else chosen.unionByName(first)
        left = left.join(first, ["host", "layout"], "left_anti")
    few = save(counts.join(chosen, ["host", "layout"]).select("host", "layout", "page_id", "n"))
    small = few.count() * 64 <= rules.broadcast_bytes
    met = pages.select("host", "layout", "page_id", "html").join((F.broadcast(few) if small else few).drop("n"), ["host", "layout", "page_id"])
    one = met.groupBy("host", "layout").agg(F.max("html").alias("html"))
    trees = F.sort_array(F.collect_list(F.struct("layout", "html")))  # at most ``references`` of a host
    found = one.groupBy("host").agg(trees.alias("refs"))
    whole = counts.groupBy("host").agg(F.sum("n").alias("pages"))
    out = save(found.join(whole, "host").select("host", "pages", F.col("refs.layout").alias("layouts"), F.col("refs.html").alias("trees")))
    size = out.agg(F.sum(F.aggregate("trees", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x))).alias("n")).first()["n"] or 0
    return out, size <= rules.broadcast_bytes


def aligned(pages: DataFrame, rules: WrapperRules) -> DataFrame:
    """(page_id, url, host, ref, main, article, pieces): article is a hash of the page's candidate text."""
    hosted = pages.select("page_id", "url", "html", _host(F.col("url")).alias("host"), _layout(F.col("html")).alias("layout"))
    reference, small = _references(hosted, rules)
    if small:
        joined = hosted.join(F.broadcast(reference), "host", "left")
    else:
        salts = F.ceil(F.col("pages") / rules.salt_pages).cast("int")
        salted = reference.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).withColumn("salts", salts)
        spread = save(salted.select("host", "salts").filter("salts > 1").distinct())  # hosts of more than salt_pages pages
        own = hosted.join(spread, "host", "left").withColumn(
            "salt", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("salts", F.lit(1)).cast("long")).cast("int")
        )
        joined = own.drop("salts").join(salted.drop("salts"), ["host", "salt"], "left")
    schema = "page_id long, url string, host string, ref int, main boolean, article long, pieces array<struct<b:int,n:int,h:int,t:string>>"
    kind = pa.list_(pa.struct([("b", pa.int32()), ("n", pa.int32()), ("h", pa.int32()), ("t", pa.string())]))

    def scan(batches):
        sys.setrecursionlimit(1_000_000)  # deep pages: frames of Python functions, not of the machine's stack
        known: dict[str, list] = {}
        matcher = Matcher()
        for batch in batches:
            articles, rows, refs, mains = [], [], [], []
            for page, host, layout, layouts, trees in zip(
                *(batch.column(k).to_pylist() for k in ("html", "host", "layout", "layouts", "trees"))
            ):
                if len(matcher.tags) > 500_000:  # shapes and references are made anew
                    known, matcher = {}, Matcher()
                if host not in known:
                    made = [matcher.shape(parse(x, rules.named)) for x in trees or ()]
                    known[host] = [(t, {id(x): i for i, x in enumerate(_in_order(t))}) for t in made]
                root = matcher.shape(parse(page or "", rules.named))
                at = -1
                if known[host]:
                    at = layouts.index(layout) if layout in layouts else max(
                        range(len(known[host])), key=lambda i: (matcher.score(root.shape, known[host][i][0].shape), -i)
                    )
                tree, numbers = known[host][at] if at >= 0 else (None, {})
                found, main = pieces(root, matcher.match(root, tree) if tree else {}, numbers, rules.named)
                said = [(b, n, zlib.crc32(t.strip().encode("utf-8", "replace")) & 0x7FFFFFFF, t) for b, n, t in found]
                long = sorted({h for _, _, h, t in said if len(t) >= 40}) or [h for _, _, h, _ in said]
                articles.append(zlib.crc32(np.array(long, "int64").tobytes()))
                rows.append([{"b": b, "n": n, "h": h, "t": t.encode("utf-8", "replace").decode()} for b, n, h, t in said])
                refs.append(at)
                mains.append(main)
            cols = [
                batch.column("page_id"), batch.column("url"), batch.column("host"), pa.array(refs, pa.int32()),
                pa.array(mains, pa.bool_()), pa.array(articles, pa.int64()), pa.array(rows, kind),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "host", "ref", "main", "article", "pieces"])

    return joined.select("page_id", "url", "host", "html", "layout", "layouts", "trees").mapInArrow(scan, schema)


def _code(p: Column) -> Column:
    return p.n.cast("long") * 2**31 + p.h


def template(found: DataFrame, rules: WrapperRules) -> DataFrame:
    """(host, ref, nodes): the aligned texts, as node * 2^31 + hash, that most different articles of a layout share."""
    slots = found.select("host", "ref", "article", F.explode("pieces").alias("p")).filter("p.n >= 0 and trim(p.t) <> ''")
    different = slots.select("host", "ref", "article", _code(F.col("p")).alias("code")).distinct()
    counts = different.groupBy("host", "ref", "code").agg(F.count(F.lit(1)).alias("n"))
    articles = found.select("host", "ref", "article").distinct().groupBy("host", "ref").agg(F.count(F.lit(1)).alias("all"))
    often = counts.filter(F.col("n") >= rules.least).join(articles, ["host", "ref"]).filter(F.col("n") >= F.col("all") * rules.share)
    return often.groupBy("host", "ref").agg(F.collect_set("code").alias("nodes"))  # at most the nodes of one page


def main_text(pages: DataFrame, rules: WrapperRules = WrapperRules()) -> DataFrame:
    """(page_id, url, text, n_aligned), one row for each row of pages; n_aligned: characters that only alignment took from its text."""
    found = save(aligned(pages, rules))
    constant = save(template(found, rules))
    few = (constant.agg(F.sum(F.size("nodes") * 8 + 64).alias("n")).first()["n"] or 0) <= rules.broadcast_bytes
    joined = found.join(F.broadcast(constant) if few else constant, ["host", "ref"], "left")
    nodes = F.coalesce("nodes", F.array().cast("array<long>"))
    fresh = F.filter("pieces", lambda p: (p.n < 0) | ~F.array_contains(nodes, _code(p)))
    length = lambda of: F.aggregate(of, F.lit(0).cast("long"), lambda n, p: n + F.length(F.trim(p.t)))
    most = F.when(F.col("main"), rules.most_of_main).otherwise(rules.most_of_body)
    marked = joined.withColumn("fresh", F.when(F.size(nodes) > 0, fresh))
    copied = length("fresh") < length("pieces") * (1 - most)
    kept = marked.withColumn("kept", F.when(F.col("fresh").isNull() | copied, F.col("pieces")).otherwise(F.col("fresh")))
    apart = lambda p, i: F.when((i > 0) & (F.get("kept", i - 1).b != p.b), F.lit("\n")).otherwise(F.lit(""))
    whole = F.array_join(F.transform("kept", lambda p, i: F.concat(apart(p, i), p.t)), "")
    tidy = F.transform(F.split(whole, "\n"), lambda x: F.trim(F.regexp_replace(x, " +", " ")))
    gone = length("pieces") - length("kept")
    return kept.select("page_id", "url", F.array_join(F.filter(tidy, lambda x: x != ""), "\n").alias("text"), gone.alias("n_aligned"))
