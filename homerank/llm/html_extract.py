"""HTML extraction by site style trees: same-host pages merged node by node, branches of low importance removed from each page."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, materialize

#: A node below this importance is noise.
LEAST_IMPORTANCE = 0.28
#: How much of a node's importance is its content's; the rest is its layout's.
CONTENT_SHARE = 0.75
#: Words of a content feature at least, one in how many words may end one, the words beyond which a text has longer ones, and how many features' worth the same node on other hosts counts.
GRAM, ENDS, LONG, PRIOR = 3, 2, 12, 40
#: Kinds of features: content, sequences of children, and how many blocks of a node a page has.
CONTENT, SHAPE, COUNT = 0, 1, 2

# HTML's elements by how they lay out text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
SKIPPED = frozenset("script style noscript template iframe object svg canvas audio video textarea title button select datalist".split())
RAW = frozenset("script style textarea title iframe noscript".split())
NOISE_TAGS = frozenset("nav aside footer form menu dialog search head".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words of class names and ids that mark noise, and words beside which they still do: a name of other words too marks nothing.
NOISE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar side aside widget footer foot header masthead topbar toolbar notice notices cookie cookies consent gdpr popup modal overlay alert newsletter subscribe signup login share sharing social related recommended recommend comment comments commentlist disqus reply replies respond copyright legal skip pagination pager".split())
NEUTRAL_WORDS = frozenset("area bar block body bottom box button buttons col column container content global group inner item items left link links list outer page panel posts primary reader readers right secondary section site slot text top unit user wrap wrapper".split())
#: Words that mark nothing inside an article, which has a header and a footer of its own.
ARTICLE_WORDS = frozenset("header footer foot masthead side legal copyright banner".split())
#: Elements that an opening of these closes, inside the nearest of the last set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}


class _Node:
    __slots__ = ("tag", "path", "above", "noise", "article", "children")

    def __init__(self, tag: str, path: int, above: int, noise: bool, article: bool):
        self.tag, self.path, self.above, self.noise, self.article, self.children = tag, path, above, noise, article, []


def _marks_noise(names: str, in_article: bool) -> bool:
    """Whether some name of a class or id attribute is made of noise words, and of neutral ones at most beside them."""
    for name in names.split():
        words = {w.lower() for w in _WORD.findall(name)}
        noise = words & NOISE_WORDS
        if noise and words <= NOISE_WORDS | NEUTRAL_WORDS and not (in_article and noise <= ARTICLE_WORDS):
            return True
    return False


def _open(tag: str, attributes: str, parent: _Node) -> _Node:
    label, noise = tag, tag in NOISE_TAGS or (tag == "header" and not parent.article)
    if attributes.strip():
        for name, a, b, c in _NAMED.findall(attributes):
            value = html.unescape(a or b or c)
            if name.lower() == "role":
                noise |= value.lower() in NOISE_ROLES
            else:
                noise |= tag not in ("html", "body", "article", "main") and _marks_noise(value, parent.article)
                label += ("." if name.lower() == "class" else "#") + re.sub(r"\d+", "0", value.strip())
    main = tag in ("article", "main")
    # A comment's own article element is no main article. A path is the hash of all its labels.
    path = xxhash.xxh3_64_intdigest(f"{parent.path}>{label}") >> 1
    # Body and html hold everything, so their layout says nothing about a branch.
    above = 0 if parent.tag in ("", "html", "body") else parent.path
    return _Node(tag, path, above, parent.noise or noise, parent.article or (main and not parent.noise))


def _partners(page: str, tag: str) -> dict[int, int]:
    """Of each element `tag` that is closed: where its name ends -> where it ends. One pass, however many stay open."""
    opened, out = [], {}
    for m in re.finditer(rf"<(/?){tag}\b", page, re.I):
        if not m[1]:
            opened.append(m.end())
        elif opened:
            end = page.find(">", m.end())
            out[opened.pop()] = end + 1 if end >= 0 else len(page)
    return out


def blocks_of(page: str | None) -> tuple[list[tuple[int, int, bool, bool, str]], list[tuple[int, str]]]:
    """(path, parent's path, in an article, noise by its markup, text) of each block in page order; (path, children) of each element.

    In time that grows with the page, however badly it is nested. Reads any text as HTML: unclosed, wrongly nested and cut-off elements included. Text in a block is one block even if
    inline elements or line breaks divide it; a nested block divides it.
    """
    root = _Node("", 0, 0, False, False)
    stack, blocks, shapes, run, pos = [root], [], [], [], 0
    page = page or ""
    partners: dict[str, dict[int, int]] = {}
    standing: Counter[str] = Counter()  # open elements by name

    def flush() -> None:
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                node = stack[-1]
                blocks.append((node.path, node.above, node.article, node.noise, text))

    def close(at: int) -> None:
        flush()
        for node in reversed(stack[at:]):
            shapes.append((node.path, ",".join(node.children)))
            standing[node.tag] -= 1
        del stack[at:]

    while True:
        found = _MARKUP.search(page, pos)
        if found is None:
            run.append(html.unescape(page[pos:]))
            break
        if found.start() > pos:
            run.append(html.unescape(page[pos : found.start()]))
        pos = found.end()
        tag = found[2] or found[5]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), found[1] or found[4], found[3] or found[6] or ""
        if closing:
            if tag in BLOCKS:
                if standing[tag]:
                    close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
                else:
                    flush()
        elif tag in SKIPPED and not attributes.endswith("/"):
            if tag in RAW:
                end = _END[tag].search(page, pos)
                pos = end.end() if end else len(page)
            else:
                if tag not in partners:
                    partners[tag] = _partners(page, tag)
                pos = max(pos, partners[tag].get(found.start() + 1 + len(tag), pos))
            run.append(" ")
        elif tag == "br" or tag == "hr" or tag in VOID:
            flush() if tag == "hr" else run.append(" " if tag == "br" else "")
        elif tag in BLOCKS:
            flush()
            if tag in CLOSES:
                shut, bounds = CLOSES[tag]
                for i in range(len(stack) - 1, 0, -1) if any(standing[t] for t in shut) else ():
                    if stack[i].tag in shut:
                        close(i)
                        break
                    if stack[i].tag in bounds:
                        break
            if stack[-1].tag == "p":
                close(len(stack) - 1)
            node = _open(tag, attributes, stack[-1])
            stack[-1].children.append(tag)
            stack.append(node)
            standing[tag] += 1
    close(1) if len(stack) > 1 else flush()
    return blocks, shapes


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def content_features(text: str) -> list[int]:
    """Hashed runs of words, of which each word of the text is in exactly one: a run ends after a word with a hash that ENDS divides, once it
    has GRAM words (twice as many with each doubling of the text beyond LONG words), and what is left at the end belongs to the last one.
    Where runs end depends on the text alone, so what two texts of about one length share is found in both."""
    words = text.lower().split()
    least = GRAM << max(len(words) // LONG, 1).bit_length() - 1
    ends, begin = [], 0
    for i, word in enumerate(words, 1):
        if i - begin >= least and zlib.crc32(word.encode("utf-8")) % ENDS == 0:
            ends.append(i)
            begin = i
    if ends and len(words) - begin < least:
        ends.pop()
    ends.append(len(words))
    return [xxhash.xxh3_64_intdigest(" ".join(words[i:j])) >> 1 for i, j in zip([0, *ends], ends)]


def page_sign(blocks: list[tuple[int, int, bool, bool, str]]) -> int:
    """The hash of the text of the node with the longest text."""
    of: dict[int, list[str]] = {}
    for path, _, _, _, text in blocks:
        of.setdefault(path, []).append(text)
    return xxhash.xxh3_64_intdigest("\n".join(max(of.values(), key=lambda texts: sum(map(len, texts)), default=()))) >> 1


def page_features(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path, above, kind, feature, sign, low, high, n: how often a feature is in a node of a host, and the least and greatest sign of
    the pages that have it; a row for each sign (null for content, whose signs are not needed one by one).

    A page's sign is the hash of the text of the node that has most of it, so pages that show one article again, whatever stands around
    it, count as one page. Where that is no article but the same on all pages, a host's pages count as one and it keeps everything.
    Tasks count their own; a narrow aggregation sums up, so a host with a third of all pages is no hot group. Written once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[tuple[str, int, int, int, int, int]] = Counter()
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                host = host_of(url)
                blocks, shapes = blocks_of(page)
                sign = page_sign(blocks)
                number: Counter[tuple[int, int]] = Counter()
                for path, above, _, _, text in blocks:
                    number[path, above] += 1
                    for feature in content_features(text):
                        counts[host, path, above, CONTENT, feature, sign] += 1
                for (path, above), n in number.items():
                    counts[host, path, above, COUNT, n, sign] += 1
                for path, children in shapes:
                    counts[host, path, 0, SHAPE, xxhash.xxh3_64_intdigest(children) >> 1, sign] += 1
            keys = list(zip(*counts)) if counts else [()] * 6
            types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(k, t) for k, t in zip(keys, types)), pa.array(list(counts.values()), pa.int64())], ["host", "path", "above", "kind", "feature", "sign", "n"])

    counted = pages.select(url_col, html_col).mapInArrow(run, "host string, path bigint, above bigint, kind int, feature bigint, sign bigint, n bigint")
    by_sign = F.when(F.col("kind") != CONTENT, F.col("sign")).alias("sign")
    summed = counted.withColumn("s", F.col("sign")).groupBy("host", "path", "above", "kind", "feature", by_sign).agg(F.min("s").alias("low"), F.max("s").alias("high"), F.sum("n").alias("n"))
    return materialize(summed, "html-features")


def _diversity(features: DataFrame, kind: int, name: str) -> DataFrame:
    """host, path and the normalised entropy of a node's features of one kind over the pages of its host that differ: 0 if all look alike."""
    seen = features.filter(F.col("kind") == kind).groupBy("host", "path", "feature").agg(F.count_distinct("sign").alias("k"))
    total, logs = F.sum("k"), F.sum(F.col("k") * F.log("k"))
    return seen.groupBy("host", "path").agg(F.when(total > 1, (F.log(total) - logs / total) / F.log(total)).otherwise(0.0).alias(name))


def style_tree(features: DataFrame) -> DataFrame:
    """host, path, content, layout, importance: the merged nodes of each host's pages.

    A node's content features are runs of words of its blocks. Over the pages of the crawl that differ, a feature on k of them has an
    entropy of log2 k bits, which counts up to one bit: what stands on two pages is of no importance. The node's content is the mean
    importance of its features; as a host with few pages shows little, nodes of that path on all hosts count like PRIOR features more.
    Its layout is how much its pages differ in it: the normalised entropy of how many blocks of it they have, or, if that is more,
    of its parent's sequence of children, which importance descends by; what stands in the body itself takes nothing from it. The node's
    importance is the weighted mean of both.
    """
    own = features.filter(F.col("kind") == CONTENT)
    once = own.groupBy("feature").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low = high").select("feature")
    single = own.filter("low = high").join(once, "feature", "left_semi").groupBy("host", "path").agg(F.sum("n").alias("single"))
    nodes = own.groupBy("host", "path", "above").agg(F.sum("n").alias("n")).join(single, ["host", "path"], "left").withColumn("single", F.coalesce("single", F.lit(0)))
    everywhere = nodes.groupBy("path").agg((F.sum("single") / F.sum("n")).alias("prior"))
    nodes = nodes.join(everywhere, "path").withColumn("content", (F.col("single") + PRIOR * F.col("prior")) / (F.col("n") + PRIOR))
    nodes = nodes.join(_diversity(features, COUNT, "count"), ["host", "path"], "left")
    parents = _diversity(features, SHAPE, "shape").withColumnRenamed("path", "above")
    nodes = nodes.join(parents, ["host", "above"], "left")
    layout = F.greatest(F.coalesce("count", F.lit(0.0)), F.when(F.col("above") != 0, F.coalesce("shape", F.lit(0.0))).otherwise(0.0))
    return nodes.select("host", "path", "content", layout.alias("layout"), (CONTENT_SHARE * F.col("content") + (1 - CONTENT_SHARE) * layout).alias("importance"))


def low_nodes(features: DataFrame, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """host, path of the nodes that are noise."""
    return style_tree(features).filter(F.col("importance") < least).select("host", "path")


def extract(page: str | None, low: frozenset[int] | set[int], by_markup: bool = True) -> str:
    """The main text of one page: its blocks, without those of low nodes and those that markup says are noise; only those of the article
    if there are any in one. by_markup: whether names of elements, classes and roles count."""
    blocks = [b for b in blocks_of(page)[0] if b[0] not in low and not (by_markup and b[3])]
    if by_markup and any(b[2] for b in blocks):
        blocks = [b for b in blocks if b[2]]
    return "\n\n".join(b[4] for b in blocks)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: float = LEAST_IMPORTANCE, by_markup: bool = True) -> DataFrame:
    """id_col, url_col, text, n_chars: the main text of every page; empty where there is none.

    Null html is empty; null and bad urls make one host of their own; repeated rows are repeated. Nodes of low importance are few (each
    stands for a branch of a host); while they stay below the limit for broadcasts every task gets them by host, beyond it each host's
    are joined to its pages. Both ways read a URL's host by host_of. No rows give no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    low = materialize(low_nodes(page_features(pages, url_col, html_col), least), "html-low")
    most = BROADCAST_BYTES // 1000
    few = low.limit(most + 1).collect()
    sent = None
    inner = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("__hr_html"))
    if len(few) <= most:
        by_host: dict[str, set[int]] = {}
        for r in few:
            by_host.setdefault(r["host"], set()).add(r["path"])
        sent = spark.sparkContext.broadcast(by_host)
        inner = inner.withColumn("__hr_low", F.lit(None).cast("array<bigint>"))
    else:
        own = low.groupBy("host").agg(F.collect_set("path").alias("__hr_low")).withColumnRenamed("host", "__hr_host")
        inner = _with_host(inner, url_col).join(own, "__hr_host", "left").select(id_col, url_col, "__hr_html", "__hr_low")
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema[:2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for url, page, joined in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                low_here = sent.value.get(host_of(url), ()) if sent is not None else set(joined or ())
                texts.append(extract(page, low_here, by_markup))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return inner.mapInArrow(run, ", ".join(types) + ", text string, n_chars bigint")


def _with_host(rows: DataFrame, url_col: str) -> DataFrame:
    """rows with __hr_host."""
    columns, at = rows.columns, rows.columns.index(url_col)
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = pa.array([host_of(u) for u in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, hosts], [*columns, "__hr_host"])

    return rows.mapInArrow(run, ", ".join([*types, "__hr_host string"]))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
