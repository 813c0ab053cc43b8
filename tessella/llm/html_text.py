"""Main text of web pages by a site style tree.

The element trees of all pages of a host are merged into one style tree: an element's place in it is its path of
tags and classes. Entropy over the host's pages gives each place two importances: that of its presentation, from the
ways in which pages show its children, and that of its content, from the texts that pages have there. Where all
pages are alike both are 0, on a host of one page both are 1, and copies of a page count as one page. In a page the
importance of a branch is composed from its place and, upward, from all branches and texts in it. What an element
says of itself (class "ad", "comments", ...) is evidence that scales this; branches that fall below a limit go.

Some elements are no part of an article by their meaning and always go (nav, footer, form, script, ...). If a page
has an article or main element with text, what is outside is not looked at; plain paragraphs, headings, lists and
tables inside stay even where many pages share them.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, join_small, materialize, sliced

#: A branch goes if its importance is below the first. An element with l presentations owes GAMMA ** l of its importance to what is in it.
IMPORTANCE, GAMMA = 0.2, 0.9
#: What evidence leaves of an importance: a class, id or role that is made of noise words only; one that has other words, too, or stands beside one for an article.
STRONG, WEAK = 0.1, 0.5

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*>|</?[a-zA-Z][^>]*\Z",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table caption thead tbody tfoot tr td th figure figcaption section article main".split())
#: Elements that an opening tag ends, if one is open nearer than the given ancestors.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "body": ("head", "html")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
NOISE_TAGS = frozenset("nav aside footer form script style noscript template iframe object svg canvas select button dialog head menu textarea title search applet video audio datalist".split())
#: Words in class, id or role that name a part of a page other than its article.
NOISE_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar widget toolbar masthead topbar footer copyright contentinfo "
    "comment comments commentlist reply replies respond disqus discussion related recommended recommendations share sharing social pagination pager search complementary skip".split()
)
#: Words that may stand beside them in a name without changing what it says.
GENERIC_WORDS = frozenset("area bar bottom box container has inner is item items js left link links list main outer right section site title top wrap wrapper".split())
OWN_WORDS = frozenset("article body content entry main post story text".split())

#: Of a place: what its presentation adds to a branch's importance, the share that comes from what is in it, and the importance of its own texts.
Place = tuple[float, float, float]
ALONE: Place = (1 - GAMMA, GAMMA, 1.0)


def place_id(parent: int, name: str) -> int:
    return int.from_bytes(blake2b(parent.to_bytes(8, "big", signed=True) + name.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


@dataclass(slots=True)
class Element:
    tag: str
    parent: int  # its number; elements are numbered as they open
    place: int  # id of its path of tags and classes from the root, of block elements
    noise: bool  # it or an ancestor is no part of an article by its meaning
    article: bool  # in an article or main element, or one itself
    plain: bool  # all elements from the article down are plain
    evidence: float = 1.0
    children: list[str] = field(default_factory=list)


@dataclass(slots=True)
class Text:
    inside: int  # number of its block element
    text: str


def _names(attrs: str) -> tuple[str, list[list[str]], bool]:
    """Class and id without digits, the words of each name in class, id and role, and whether the element is hidden."""
    if not attrs or not attrs.strip(" /"):
        return "", [], False
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attrs)}
    names = " ".join(filter(None, (found.get("class"), found.get("id")))).lower()
    words = [w for name in f"{names} {found.get('role', '').lower()}".split() if (w := re.findall("[a-z]+", name))]
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    return ".".join(sorted(re.sub(r"\d+", "", names).split())), words, hidden


def evidence(names: list[list[str]]) -> float:
    """What the names of an element leave of its importance."""
    noise = [w for w in names if not NOISE_WORDS.isdisjoint(w)]
    if not noise:
        return 1.0
    whole = any(all(x in NOISE_WORDS or x in GENERIC_WORDS for x in w) for w in noise)
    beside = any(x in OWN_WORDS for w in names if w not in noise for x in w)
    return STRONG if whole and not beside else WEAK


def parse(page: str | None) -> tuple[list[Element], list[Text]]:
    """Block elements in the order in which they open, the first being the page itself, and the texts outside noise in page order.

    Linear in the page. Broken markup: an end tag without an open element is not looked at, an inline element ends
    with its block at the latest, a tag cut off at the end of the page goes.
    """
    page = page or ""
    elements = [Element("", -1, 0, False, False, True)]
    texts: list[Text] = []
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, number of the block element, whether text goes
    opened: Counter[str] = Counter()
    raw: list[str] = []
    ids: dict[tuple[int, str], int] = {}

    def flush() -> None:
        if raw:
            text = " ".join(html.unescape("".join(raw)).split())
            raw.clear()
            if text and not elements[stack[-1][1]].noise:
                texts.append(Text(stack[-1][1], text))

    def pop(depth: int) -> None:
        while len(stack) > depth:
            tag = stack[-1][0]
            if tag in BLOCK:
                flush()
            opened[tag] -= 1
            stack.pop()

    def close(tags: frozenset[str], within: frozenset[str] | None) -> None:
        """End the nearest open element of one of these tags, unless one of those in within (None: any block) is nearer."""
        if any(opened[t] for t in tags):
            for depth in range(len(stack) - 1, 0, -1):
                tag = stack[depth][0]
                if tag in tags:
                    return pop(depth)
                if tag in BLOCK if within is None else tag in within:
                    return None
        return None

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        end = m.start() if m else size
        if end > at and not stack[-1][2]:
            raw.append(page[at:end])
        if m is None:
            break
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["close"] or m["close2"]:
            close(frozenset([tag]), frozenset() if tag in BLOCK else None)
            continue
        if tag == "br":
            raw.append(" ")
            continue
        attrs = m["attrs"] or ""
        names, words, hidden = _names(attrs)
        if tag in BLOCK:
            flush()
            close(frozenset(["p"]), None)  # a block ends an open paragraph
        if tag in ENDS:
            close(*ENDS[tag])
        _, number, gone = stack[-1]
        top = elements[number]
        name = f"{tag}.{names}" if names else tag
        if tag in BLOCK:
            top.children.append(name)
        if tag in VOID:
            continue
        noise = hidden or tag in NOISE_TAGS or (tag == "header" and not top.article)
        weight = 1.0 if tag in ("html", "body", "article", "main") else evidence(words)
        if tag == "article" and any(x in ("comment", "comments", "reply") for w in words for x in w):
            noise = True
        if tag in BLOCK:
            if (number, name) not in ids:
                ids[number, name] = place_id(top.place, name)
            inside = top.article and tag not in ("article", "main")
            plain = (top.plain if inside else True) and tag in PLAIN and (not names or tag in ("article", "main"))
            elements.append(Element(tag, number, ids[number, name], top.noise or noise, top.article or tag in ("article", "main"), plain, weight))
            number, gone = len(elements) - 1, False
        elif noise or weight < WEAK:  # an inline part that is no content: its text goes, the text around it stays
            raw.append(" ")
            if attrs.endswith("/"):
                continue
            gone = True
        stack.append((tag, number, gone))
        opened[tag] += 1
        if tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            at = found.start() if found else size
    pop(1)
    flush()
    return elements, texts


def main_text(page: str | None, places: Mapping[int, Place] | None = None) -> str:
    """The texts of a page that are its article, joined by two "\\n"; places: those of its host that are not as on a host of one page."""
    elements, texts = parse(page)
    places = places or {}
    own = [places.get(e.place, ALONE) for e in elements]
    total, parts = [0.0] * len(elements), [0] * len(elements)
    for t in texts:
        total[t.inside] += own[t.inside][2]
        parts[t.inside] += 1
    importance = [0.0] * len(elements)
    for k in range(len(elements) - 1, -1, -1):  # children have higher numbers
        if parts[k]:
            inner = total[k] / parts[k]
            importance[k] = own[k][0] + own[k][1] * inner if elements[k].children else inner
            if k:
                total[elements[k].parent] += importance[k]
                parts[elements[k].parent] += 1
    gone = [False] * len(elements)
    for k, e in enumerate(elements[1:], 1):
        safe = e.tag in ("html", "body", "article", "main") or e.article and e.plain
        gone[k] = gone[e.parent] or e.noise or not safe and importance[k] * e.evidence < IMPORTANCE
    kept = [t for t in texts if not gone[t.inside]]
    if any(elements[t.inside].article for t in kept):
        kept = [t for t in kept if elements[t.inside].article]
    return "\n\n".join(t.text for t in kept)


def _style_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, place, kind, feature, pages): kind 0 for presentations of children, 1 for texts; weights summed per batch."""
    for batch in sliced(batches):
        seen: dict[tuple, float] = defaultdict(float)
        for host, page, copies in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            elements, texts = parse(page)
            rows = {(host, e.place, 0, place_id(0, ",".join(dict.fromkeys(e.children)))) for e in elements if e.children and not e.noise}
            rows |= {(host, elements[t.inside].place, 1, place_id(0, t.text)) for t in texts}
            for row in rows:
                seen[row] += 1 / copies
        columns = list(zip(*seen, strict=True)) or [[], [], [], []]
        types = [pa.string(), pa.int64(), pa.int32(), pa.int64()]
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)] + [pa.array(list(seen.values()), pa.float64())]
        yield pa.record_batch(arrays, names=["host", "place", "kind", "feature", "pages"])


def style_tree(hosted: DataFrame) -> DataFrame:
    """(host, places): of each host the places that more than one page has, as (place, own, inner, content). hosted(host, html).

    With c of m pages sharing a feature, the importance is the entropy of the shares c / m to the base m.
    """
    hashed = hosted.select("host", "html", F.xxhash64("host", "html").alias("page"))
    copies = materialize(hashed.groupBy("page").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    weighed = join_small(hashed, copies, "page", "left").select("host", "html", F.coalesce("copies", F.lit(1)).alias("copies"))
    features = weighed.mapInArrow(_style_rows, "host string, place long, kind int, feature long, pages double")
    features = features.groupBy("host", "place", "kind", "feature").agg(F.sum("pages").alias("c"))
    kinds = features.groupBy("host", "place", "kind").agg(F.sum("c").alias("m"), F.count("*").alias("l"), F.sum(F.col("c") * F.log("c")).alias("clogc"))
    varied = F.when(F.col("m") < 1.5, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("clogc") / (F.col("m") * F.log("m"))))
    of_kind = lambda k, c, none: F.coalesce(F.max(F.when(F.col("kind") == k, c)), F.lit(none))
    shown = F.pow(F.lit(GAMMA), F.col("l"))
    places = kinds.groupBy("host", "place").agg(
        of_kind(0, (1 - shown) * varied, ALONE[0]).alias("own"), of_kind(0, shown, ALONE[1]).alias("inner"), of_kind(1, varied, ALONE[2]).alias("content"), F.max("m").alias("m")
    )
    return places.where("m >= 1.5").groupBy("host").agg(F.collect_list(F.struct("place", "own", "inner", "content")).alias("places"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tree: bool = True) -> DataFrame:
    """(id, url, text, n_chars) of every row of pages.

    text: the texts of the main text's blocks, character references decoded, white space inside a block turned into
    one space, joined by two "\\n"; empty if there is none, as for a null or empty html. n_chars: its code points.
    Pages of any length and depth are taken whole. Pages without a host in their url (null, relative) make up a host
    of their own. Rows that repeat count as one page in the style tree; ids may repeat or be null, each row gives a
    row; other columns are not looked at. An empty table gives no rows. tree False: each page for itself, as on a
    host of one page.
    """
    host = F.coalesce(F.lower(F.regexp_extract(url_col, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    hosted = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    if tree:
        found = materialize(style_tree(hosted), "places")
        few = found.agg(F.coalesce(F.sum(F.size("places") + 4), F.lit(0))).first()[0] <= BROADCAST_ROWS
        rows = hosted.join(F.broadcast(found) if few else found, "host", "left").select("id", "url", "html", "host", "places")
    else:
        rows = hosted.select("id", "url", "html", "host", F.lit(None).cast("array<struct<place:long,own:double,inner:double,content:double>>").alias("places"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[str | None, dict[int, Place]] = (None, {})
        for batch in sliced(batches, 256):
            texts = []
            for k, (page, host) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if host != known[0]:
                    known = (host, {p["place"]: (p["own"], p["inner"], p["content"]) for p in batch.column(4)[k].as_py() or ()})
                texts.append(main_text(page, known[1]))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    out = rows.mapInArrow(work, "id long, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
