"""Main-text extraction with a site style tree.

The pages of one host are merged into a tree of block elements.  A node is a
path of labels from the root: tag, id, role and all classes of each element,
with numbers made equal, so that ``post-12`` and ``post-13`` are one node.
For every node the tree holds how often each presentation (the run of its
child labels) and each content (the text of its own blocks) occurs on the
site's pages.  The importance of either is its entropy to the base of the
number of pages: what is the same on page after page is of none.  Few pages,
and sites whose pages are all alike, prove little and leave it near 1.

On a page, importances are composed from the leaves up:
``(1 - GAMMA**l) * presentation + GAMMA**l * content below``, for a node with l
presentations, contents weighed by their words.  Then the page is walked from
its root.  Every element gets a score: part of its parent's, what its names
say of it (``NAMES``), and a penalty if its importance is below ``THRESHOLD``.
Branches with a negative score are removed.  So names decide where the site has one page or
all its pages differ, and repetition overrules them: a ``content`` that is the
same everywhere goes, a ``post-header`` inside an article that isn't stays.
A name counts whole (``related``) or by its parts if the others only tell of
layout (``related-box``); a compound with any other word (``market-share``)
says little, and less than the main text around or below it.
Elements that hold no text by their kind (``nav``, ``script``, forms) always go.

Everything about nodes is grouped by (host, node).  A host's tree is sent to
each of the host's groups of pages once, ahead of them.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraspan.llm._spark import as_table, cut, ensure_importable, text_or_empty
from terraspan.llm.url_filter import host_and_path

THRESHOLD = 0.35
GAMMA = 0.9
#: Penalty of a node of no importance on very many pages that all differ.
PENALTY = 5.0
#: A node is part of the site's style if it is on so many of its pages, or of a
#: small site on a hundredth, but on two at least.
PAGES, LEAST_PAGES = 10, 2
#: What names say of an element, and what is left of a parent's score.
NAMES = {"main": 2.0, "noise": -6.0, "compound": -2.4, "doubtful": -1.5}
KEEPS, LEAST, MOST, START = 0.8, -4.0, 3.0, 1.0
#: Key of the root.
ROOT = 0
#: Pages of a group at most, about; larger hosts are dealt over several.
GROUP = 1024

#: Elements inside a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup.
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
#: Elements that never hold main text.
NOISE_TAGS = frozenset(
    "head nav footer aside form script style noscript iframe template textarea title button select menu dialog svg canvas object applet map datalist fieldset".split()
)
#: Words in a class, id or role that tell of noise.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup login search share sharing social related recommended widget pagination pager toolbar comment comments respond reply replies disqus discussion copyright legal disclaimer skip hidden".split()
)
#: Of these, the words that say little inside main text.
DOUBTFUL_WORDS = frozenset("header masthead notice notices alert hidden legal copyright disclaimer side search social skip".split())
#: Words of compound names that only tell of layout.
LAYOUT_WORDS = frozenset(
    "area bar bars block blocks body bottom box boxes btn button buttons center col cols column columns container content entry fixed float form full global group head icon icons image images inner item items large layer left link links list lists main mobile module modules nav outer page panel pane post posts primary region right row secondary section site sitewide slot small stack sticky story tab tabs text title top unit units wide wrap wrapper zone user users reader readers visitor guest blog article news your our facebook twitter email".split()
)
#: Elements and words that tell of main text.
MAIN_TAGS = frozenset(["article", "main"])
MAIN_WORDS = frozenset("article main content post entry story body text".split())
#: An open p ends where one of these begins.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
#: An open element of the key ends where one of the values begins.
SIBLINGS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option", "optgroup"), "tr": ("tr",),
    "td": ("td", "th", "tr"), "th": ("td", "th", "tr"), "thead": ("tbody", "tfoot"), "tbody": ("tbody", "tfoot"),
}

_OPENS = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_STOPS = re.compile("[>=]")
_BLANK = re.compile(r"\s*")
#: The rest of a tag whose quotes all hold values; anything else is looked at step by step.
_PLAIN = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
_NAMED = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
_PARTS = re.compile(r"[^a-z]+")
_DIGITS = re.compile(r"[0-9]+")


class Node:
    __slots__ = ("tag", "label", "key", "up", "children", "names", "words", "main", "noise", "compound")

    def __init__(self, tag: str, label: str, key: int, up: int, names: frozenset[str] = frozenset(), noise: frozenset[str] = frozenset(), compound: bool = False):
        self.tag, self.label, self.key, self.up, self.names, self.noise, self.compound = tag, label, key, up, names, noise, compound
        self.children: list[str] = []
        self.words = 0  # below it, itself included
        self.main = 0  # elements named as main text below it, itself included


def _number(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@lru_cache(1 << 16)
def _key(parent: int, label: str) -> int:
    return _number(f"{parent}/{label}")


@lru_cache(1 << 14)
def _label(tag: str, names: str) -> tuple[str, frozenset[str], frozenset[str], bool]:
    """The element's label, the words of its names, those that tell of noise,
    and whether only a compound name with another word does."""
    found = {k.lower(): (a or b or c).lower() for k, a, b, c in _NAMED.findall(names)}
    parts = [tag]
    for mark, kind in (("#", "id"), ("@", "role"), (".", "class")):
        parts += [mark + _DIGITS.sub("0", x) for x in sorted(set(found.get(kind, "").split()))]
    if tag in ("html", "body"):  # the names of the whole page's elements tell of its layout
        return "".join(parts), frozenset(), frozenset(), False
    noise: set[str] = set()
    compound = False
    for name in " ".join(found.values()).split():
        words = {w for w in _PARTS.split(name) if w}
        if words & NOISE_WORDS:
            if words <= NOISE_WORDS | LAYOUT_WORDS:
                noise |= words & NOISE_WORDS
            else:
                compound = True
    return "".join(parts), frozenset(_WORDS.findall(" ".join(found.values()))), frozenset(noise), compound and not noise


def tag_end(page: str, at: int) -> int:
    """The place of the ``>`` that ends a tag, -1 if there is none; a quote
    holds a value only behind ``=``, and only if it is closed."""
    while m := _STOPS.search(page, at):
        if m[0] == ">":
            return m.start()
        at = _BLANK.match(page, m.end()).end()
        if page[at : at + 1] in ("'", '"') and at < len(page):
            close = page.find(page[at], at + 1)
            at = close + 1 if close >= 0 else at + 1
    return -1


def tokens(page: str) -> Iterator[tuple[str, str, str, str, int]]:
    """(text before, slash, tag, attributes, place behind) of every tag, in one
    pass over the page; a comment or declaration has no tag, the last row
    neither.  The receiver may send a place to go on from.

    A tag without an end runs to the end of the page, and so does a comment;
    without any ``>`` behind it, a ``<`` is text, but for a last unfinished
    tag."""
    at, text_from = 0, 0
    while m := _OPENS.search(page, at):
        if page.startswith("<!--", m.start()):
            end = page.find("-->", m.start() + 4)
            end = end + 2 if end >= 0 else -1
        else:
            plain = _PLAIN.match(page, m.end()) if m[2] else None
            end = plain.end() - 1 if plain else tag_end(page, m.end()) if m[2] else page.find(">", m.end())
        if end < 0:
            rest = page.rfind("<") if not page.startswith("<!--", m.start()) and page.find(">", m.start()) < 0 else m.start()
            yield page[text_from : rest if _OPENS.match(page, rest) else len(page)], "", "", "", len(page)
            return
        sent = yield page[text_from : m.start()], m[1] or "", (m[2] or "").lower(), page[m.end() : end] if m[2] else "", end + 1
        at = text_from = end + 1 if sent is None else sent
    yield page[text_from:], "", "", "", len(page)


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """All block elements, parents before children, and the texts of the
    blocks in page order."""
    root = Node("", "", ROOT, -1)
    nodes, blocks, stack, places, pending = [root], [], [root], [0], []

    def flush() -> None:
        if pending:
            text = " ".join(html.unescape("".join(pending)).split())
            pending.clear()
            if text:
                blocks.append((stack[-1], text))

    found, go_on = tokens(page), None
    while True:
        try:
            before, slash, tag, attributes, behind = found.send(go_on)
        except StopIteration:
            break
        go_on = None
        if before:
            pending.append(before)
        if not tag:
            continue
        if tag in INLINE:
            if tag == "br":
                pending.append(" ")
            continue
        flush()
        if slash:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:], places[k:]
                    break
            continue
        if tag in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:], places[k:]
                    break
                if stack[k].tag not in SIBLINGS:
                    break
        if len(stack) > 1 and tag in SIBLINGS.get(stack[-1].tag, ()):
            stack.pop()
            places.pop()
        label, names, noise, compound = _label(tag, attributes if attributes and _NAMED.search(attributes) else "")
        top = stack[-1]
        node = Node(tag, label, _key(top.key, label), places[-1], names, noise, compound)
        if not top.children or top.children[-1] != label:
            top.children.append(label)
        nodes.append(node)
        if tag in VOID or attributes.endswith("/"):
            continue
        stack.append(node)
        places.append(len(nodes) - 1)
        if tag in RAW:
            stack.pop()
            places.pop()
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, behind)
            end = page.find(">", close.end()) if close else -1
            go_on = end + 1 if end >= 0 else len(page)
    flush()
    for x, text in blocks:
        x.words += len(text.split())
    for x in reversed(nodes[1:]):
        x.main += x.tag in MAIN_TAGS or bool(x.names & MAIN_WORDS)
        nodes[x.up].words += x.words
        nodes[x.up].main += x.main
    return nodes, blocks


def style_counts(pages: DataFrame) -> DataFrame:
    """host, path (the node's key), kind, value, n over all pages (host, html).

    ``style`` and ``content``: the number of pages per value (the root's
    content is the whole page's text); ``page``: the number of pages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from terraspan.llm.html_extract import NOISE_TAGS, ROOT, _number, parse

        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(seen)
            rec = pa.RecordBatch.from_arrays(
                [pa.array([k[j] for k in keys], t) for j, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64()))]
                + [pa.array(list(seen.values()), pa.int64())],
                ["host", "path", "kind", "value", "n"],
            )
            seen.clear()
            return rec

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                nodes, blocks = parse(page)
                texts: dict[int, list[str]] = {}
                gone = [False] * len(nodes)
                own = {(host, ROOT, "page", 0), (host, ROOT, "content", _number("\n".join(text for _, text in blocks)))}
                styles: dict[int, list[str]] = {}
                for k, x in enumerate(nodes[1:], 1):
                    gone[k] = gone[x.up] or x.tag in NOISE_TAGS
                    if gone[k]:
                        continue
                    own.add((host, x.key, "page", 0))
                    styles.setdefault(x.key, []).append(" ".join(x.children))
                    texts.setdefault(x.key, [])
                for key, each in styles.items():
                    own.add((host, key, "style", _number("\n".join(each))))
                for x, text in blocks:
                    if x.key in texts:
                        texts[x.key].append(text)
                for key, each in texts.items():
                    if each:
                        own.add((host, key, "content", _number("\n".join(each))))
                seen.update(own)
                if len(seen) > 50_000:
                    yield out()
        if seen:
            yield out()

    each = pages.select("host", "html").mapInArrow(run, "host string, path long, kind string, value long, n long")
    return each.groupBy("host", "path", "kind", "value").agg(F.sum("n").alias("n"))


def importances(counts: DataFrame) -> DataFrame:
    """host, path, style, content, styles: importance (0 to 1) of the
    presentations and contents, and the number of presentations, of the nodes
    that are on PAGES of their host's pages at least (of small hosts on fewer),
    from ``style_counts``."""
    c = F.col("n").cast("double")

    def of(kind: str, x: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, x)), F.lit(0.0))

    def entropy(kind: str) -> Column:
        return F.coalesce(F.log(of(kind, c)) - of(kind, c * F.log(c)) / of(kind, c), F.lit(0.0))

    own = counts.groupBy("host", "path").agg(
        of("page", c).alias("pages"), of("style", F.lit(1.0)).alias("styles"), entropy("style").alias("style"), entropy("content").alias("content")
    ).where("pages > 1")
    own = cut(own)  # read twice
    own = own.withColumns({k: F.least(F.lit(1.0), F.col(k) / F.log("pages")) for k in ("style", "content")})
    site = own.where(F.col("path") == ROOT).select("host", F.col("pages").alias("site"), F.col("content").alias("differ"))
    proof = F.col("differ") * (1 - 1 / F.col("pages"))
    nodes = own.where(F.col("path") != ROOT).join(site, "host").where(F.col("pages") >= F.least(F.lit(PAGES), F.greatest(F.lit(LEAST_PAGES), F.col("site") / 100)))
    return nodes.select("host", "path", *[(1 - proof * (1 - F.col(k))).alias(k) for k in ("style", "content")], "styles")


Site = dict[int, tuple[float, float, float]]


def main_text(page: str, site: Site) -> str:
    """The page's text without the branches that score below 0, one line per
    block.  ``site``: importance of presentation and content, and number of
    presentations, by node."""
    nodes, blocks = parse(page)
    told, weight = [0.0] * len(nodes), [0] * len(nodes)
    alone = (1.0, 1.0, 1.0)
    place = {id(x): k for k, x in enumerate(nodes)}
    for x, text in blocks:
        k, n = place[id(x)], len(text.split())
        told[k] += n * site.get(x.key, alone)[1]
        weight[k] += n
    score = [START] * len(nodes)
    importance = [1.0] * len(nodes)
    for k in range(len(nodes) - 1, 0, -1):
        x = nodes[k]
        style, _, styles = site.get(x.key, alone)
        below = told[k] / weight[k] if weight[k] else style
        share = GAMMA**styles
        # a node without elements inside has no presentation of its own
        importance[k] = (1 - share) * style + share * below if x.children else below
        told[x.up] += told[k]
        weight[x.up] += weight[k]
    inside = [False] * len(nodes)
    for k, x in enumerate(nodes[1:], 1):
        up = score[x.up]
        if up < 0 or x.tag in NOISE_TAGS:
            score[k] = LEAST
            continue
        named = x.tag in MAIN_TAGS or bool(x.names & MAIN_WORDS)
        inside[k] = inside[x.up] or named
        noise = x.noise | {"header"} if x.tag == "header" else x.noise
        # a wrapper of nearly the whole page with all the main text inside isn't what its names say
        below = x.main - named
        wraps = below > 0 and x.main == nodes[0].main and 10 * x.words >= 9 * nodes[0].words
        own = NAMES["main"] if named else 0.0
        if noise and not wraps:
            own = NAMES["noise"]
            if inside[x.up] and noise <= DOUBTFUL_WORDS:
                own = NAMES["doubtful"] + (NAMES["main"] if named else 0.0)
        elif x.compound and not noise and not below:
            # it counts most beside main text that is named so, and not at all where none is
            own += NAMES["doubtful"] if inside[x.up] else NAMES["compound"] if nodes[0].main else 0.0
        low = max(0.0, THRESHOLD - importance[k]) / THRESHOLD
        score[k] = max(LEAST, min(MOST, KEEPS * up + own - PENALTY * low))
    return "\n".join(text for x, text in blocks if score[place[id(x)]] >= 0)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars.

    Null html counts as empty, null urls as the empty host.  Text is empty if
    no block is left.  Pages of any length and depth are handled whole.
    Repeated rows are extracted each (the tree counts them each).  An empty
    table gives an empty result.  Extra columns are ignored, whatever their
    names.

    A host's tree goes ahead of its pages to the group that holds them; hosts
    of more than ``GROUP`` pages are dealt over several groups.
    """
    ensure_importable(pages.sparkSession)
    host, _ = host_and_path(F.col(url_col))
    base = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), text_or_empty(html_col).alias("html")
    )
    # a row for every GROUP pages at most; as a table, so that the planner knows its size
    large = base.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP)
    large = as_table(large.select("host", F.ceil(F.col("n") / GROUP).cast("int").alias("salts")), "hosts")

    def salted(df: DataFrame, salts: Column) -> DataFrame:
        return df.join(large, "host", "left").withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn("salt", salts).drop("salts")

    tree = salted(importances(style_counts(base)), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    id_type = base.schema["id"].dataType.simpleString()
    none = {"path": "long", "style": "double", "content": "double", "styles": "double"}
    ahead = tree.select("host", "salt", *[F.col(k).cast(t) for k, t in none.items()], *[F.lit(None).cast(t).alias(k) for k, t in (("id", id_type), ("url", "string"), ("html", "string"))])
    dealt = salted(base, F.pmod(F.xxhash64("html"), F.col("salts")).cast("int"))
    rows = ahead.unionByName(dealt.select("host", "salt", *[F.lit(None).cast(t).alias(k) for k, t in none.items()], "id", "url", "html"))
    rows = rows.repartition("host", "salt").sortWithinPartitions("host", "salt", F.col("html").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from terraspan.llm.html_extract import main_text

        at, site = None, {}
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                texts, kept = [], []
                told = (part.column(j).to_pylist() for j in (0, 1, 2, 3, 4, 5, 8))
                for row, (host, salt, path, style, content, styles, page) in enumerate(zip(*told, strict=True)):
                    if (host, salt) != at:
                        at, site = (host, salt), {}
                    if page is None:
                        site[path] = style, content, styles
                    else:
                        texts.append(main_text(page, site))
                        kept.append(row)
                if kept:
                    pages = part.take(pa.array(kept))
                    yield pa.RecordBatch.from_arrays(
                        [pages.column(6), pages.column(7), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                        ["id", "url", "text", "n_chars"],
                    )

    return rows.select("host", "salt", "path", "style", "content", "styles", "id", "url", "html").mapInArrow(
        run, f"id {id_type}, url string, text string, n_chars long"
    ).withColumnRenamed("id", id_col)
