"""Main text of web pages by paths that the pages of a host agree on.

Method: consensus host paths.  Every page scores its containers, named by their path
of tags and generalised classes.  The scores are votes, summed per host and template in
Spark; the winning path of a template then selects the text of each of its pages.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import join_groups, stored

# HTML elements by what they do to text.
RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "title", "textarea"}
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
    "source", "track", "wbr",
}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details",
    "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html",
    "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
BARRED = {
    "head", "nav", "header", "footer", "aside", "form", "menu", "button", "select",
    "option", "label", "dialog", "fieldset", "input", "datalist",
}
BARRED_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb",
    "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "copyright",
    "disqus", "footer", "header", "login", "menu", "nav", "navbar", "navigation",
    "newsletter", "notice", "notices", "pagination", "popup", "promo", "promoted",
    "related", "replies", "reply", "respond", "rail", "share", "sharing", "sidebar",
    "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
BARRED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu"}
# a start tag of the key ends open elements of the values, up to a container
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"},
}
TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?:[!?/][^>]*(?:>|\Z)|[a-zA-Z][^>]*\Z)",
    re.S,
)
ATTRIBUTE = re.compile(
    r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?"
)
WORD = re.compile(r"[a-z]+")
SEMANTIC = {"article", "main"}
ROOTS = {"html", "body"}
# elements that hold text of the container around them
FLOW = {
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "ul", "ol", "li", "dl", "dt", "dd",
    "blockquote", "pre", "figure", "figcaption", "table", "thead", "tbody", "tfoot", "tr",
    "th", "td", "details", "summary", "address",
}
TABLES = {"table", "thead", "tbody", "tfoot", "tr", "th", "td"}
COVER = 0.9
MOST = 0.5


# classes that say how a page is laid out or filed, not what an element is
ABOUT = {
    "has", "with", "without", "no", "not", "is", "hide", "show", "category", "tag", "type",
    "format", "layout", "template", "page", "post", "body",
}
# comments may be longer than the article
COMMENTS = {"comment", "comments", "disqus", "replies", "reply", "respond"}
SOFT_TAGS = {"form", "fieldset"}
KEPT, SOFT, HARD = range(3)


def bar_of(names: str) -> int:
    """How a class or id bars its element.

    A name that is a barred word, or begins or ends with a word for comments, bars it; one
    that begins or ends with another barred word bars it if it is not the page's main part.
    """
    found = KEPT
    for name in names.split():
        words = WORD.findall(name)
        if name in BARRED_NAMES:
            return HARD
        if not words or not ABOUT.isdisjoint(words[:-1]):
            continue
        ends = {words[0], words[-1]}
        if not COMMENTS.isdisjoint(ends):
            return HARD
        if not BARRED_NAMES.isdisjoint(ends):
            found = SOFT
    return found


def step_of(tag: str, attributes: str, inside: bool = False) -> tuple[str, int]:
    """(path step, bar): the tag and its first class, digits generalised.

    ``inside`` an article or main element a header has the headline and stays.
    """
    bar, name = KEPT, ""
    if tag in BARRED and not (inside and tag == "header"):
        bar = SOFT if tag in SOFT_TAGS else HARD
    if attributes:
        for key, *values in ATTRIBUTE.findall(attributes):
            value = "".join(values).lower()
            key = key.lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true"):
                bar = HARD
            elif key == "role":
                bar = HARD if value in BARRED_ROLES else bar
            elif key in ("class", "id"):
                if tag not in ("html", "body", "article", "main"):
                    bar = max(bar, bar_of(value))
                if key == "class" and value.split():
                    name = "." + re.sub(r"\d+", "#", value.split()[0])
    return tag + name, bar


def blocks_of(page: str) -> list[tuple[tuple[str, ...], str, int, int]]:
    """(path, text, linked characters, article) of each block outside barred parts.

    ``article`` numbers the outermost article or main element around it, 0 is none.

    White space within a block is one space.  Tags that are not closed end with their
    parent; a comment or tag that the page's end cuts off is dropped.  An element that is only
    by its look a form, menu or notice (``bar_of``) is barred unless it holds more than half of
    the page's unlinked text.
    """
    found: list[tuple[tuple[str, ...], str, int, int]] = []
    # the softly barred elements around each block, and their unlinked text
    around: list[tuple[int, ...]] = []
    soft_worth: list[int] = []
    # tag, step, barred here or above, number of the outermost article, softly barred ones
    stack: list[tuple[str, str, bool, int, tuple[int, ...]]] = []
    texts: list[str] = []
    linked = in_link = articles = 0
    at, size = 0, len(page)

    def end_block() -> None:
        nonlocal linked
        if texts:
            text = " ".join(html.unescape("".join(texts)).split())
            if text and not (stack and stack[-1][2]):
                path = tuple(s for t, s, *_ in stack if t in BLOCKS)
                found.append((path, text, linked, stack[-1][3] if stack else 0))
                around.append(stack[-1][4] if stack else ())
                for k in around[-1]:
                    soft_worth[k] += worth_of(text, linked)
            texts.clear()
        linked = 0

    def close(k: int) -> None:
        nonlocal in_link
        end_block_needed = any(t in BLOCKS for t, *_ in stack[k:])
        if end_block_needed:
            end_block()
        for tag, *_ in stack[k:]:
            in_link -= tag == "a"
        del stack[k:]

    while at < size:
        match = TAG.search(page, at)
        stop = match.start() if match else size
        if stop > at and not (stack and stack[-1][2]):
            texts.append(page[at:stop])
            if in_link:
                linked += stop - at
        if not match:
            break
        at = match.end()
        closing, tag, attributes = match.group(1), match.group(2), match.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if tag in ("p", "br") and tag == "br":
                texts.append(" ")
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if tag not in BLOCKS and stack[k][0] in BLOCKS:
                    break
            continue
        if tag in RAW:
            if attributes.endswith("/"):
                continue
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            if end:
                at = end.end()
            elif tag in ("script", "style"):
                at = size
            elif tag in ("title", "textarea"):
                # never closed: it ends where another element begins
                after = page.find("<", at)
                at = size if after < 0 else after
            continue
        if tag in BLOCKS:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
            ends = CLOSES.get(tag)
            if ends:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ends:
                        close(k)
                        break
                    if stack[k][0] in BLOCKS:
                        break
            end_block()
        if tag in VOID:
            texts.append(" " if tag in ("br", "wbr") and tag == "br" else "")
            continue
        if attributes.endswith("/") and tag not in BLOCKS:
            continue
        article = stack[-1][3] if stack else 0
        step, bar = step_of(tag, attributes, article > 0)
        if tag in SEMANTIC:
            articles += 1
            article = article or articles
        barred = bar == HARD or bool(stack and stack[-1][2])
        soft = stack[-1][4] if stack else ()
        if bar == SOFT and not barred:
            soft = (*soft, len(soft_worth))
            soft_worth.append(0)
        stack.append((tag, step, barred, article, soft))
        in_link += tag == "a"
    end_block()
    # an element that may be a form, menu or notice is one unless it holds most of the text
    whole = sum(worth_of(text, linked) for _, text, linked, _ in found)
    barred_ones = {k for k, worth in enumerate(soft_worth) if worth <= MOST * whole}
    if barred_ones:
        found = [b for b, soft in zip(found, around, strict=True) if barred_ones.isdisjoint(soft)]
    return found


class Scores(dict[tuple[str, ...], float]):
    """Score of each container: the unlinked text at or below it; and the blocks."""

    blocks: list
    whole: float


def worth_of(text: str, linked: int) -> int:
    return max(0, len(text) - 2 * linked)


def scores_of(blocks: list) -> Scores:
    scores = Scores()
    scores.blocks, scores.whole = blocks, 0.0
    for path, text, linked, _ in blocks:
        worth = worth_of(text, linked)
        scores.whole += worth
        for k in range(1, len(path) + 1):
            scores[path[:k]] = scores.get(path[:k], 0.0) + worth
    return scores


def tag_of(step: str) -> str:
    return step.partition(".")[0]


def article_end(path: tuple[str, ...]) -> int:
    """Length of the path to its outermost article or main, 0 without one."""
    return next((k + 1 for k, step in enumerate(path) if tag_of(step) in SEMANTIC), 0)


def climb(blocks: list, path: tuple[str, ...]) -> tuple[str, ...]:
    """The outermost container around ``path`` whose further text is not mostly links.

    Neither the body, which holds all sections of a page, nor what is around an article is
    climbed to; a container without further text adds nothing and is not climbed to.
    """
    n = len(path)
    if article_end(path):
        return path
    texts, links = [0] * (n + 1), [0] * (n + 1)
    for at, text, linked, _ in blocks:
        if at[:n] != path:
            k = 0
            while k < len(at) and at[k] == path[k]:
                k += 1
            texts[k] += len(text)
            links[k] += linked
    more = linked = 0
    best = n
    for k in range(n - 1, 0, -1):
        if path[k - 1] and tag_of(path[k - 1]) in ROOTS:
            break
        more += texts[k]
        linked += links[k]
        if texts[k] and 2 * linked <= more:
            best = k
    return path[:best]


def container(scores: Scores) -> tuple[str, ...]:
    """The container of the page's text.

    From the deepest path with nearly all of the text, out of elements that are text
    themselves, to the article that encloses it or as far as ``climb`` goes.  A single
    article elsewhere is the container when it alone holds most of the text.
    """
    best: tuple[str, ...] = ()
    for path, score in scores.items():
        if len(path) > len(best) and score >= COVER * scores.whole and score > 0:
            best = path
    if best and tag_of(best[-1]) == "td":
        best = best[:-1]
    while best and tag_of(best[-1]) in FLOW - TABLES:
        best = best[:-1]
    end = article_end(best)
    if end:
        return best[:end]
    single: dict[int, int] = {}
    paths: dict[int, tuple[str, ...]] = {}
    for path, text, linked, article in scores.blocks:
        if article:
            single[article] = single.get(article, 0) + worth_of(text, linked)
            paths[article] = path[: article_end(path)]
    if single:
        most = max(single, key=lambda k: (single[k], -k))
        if single[most] > MOST * scores.whole:
            return paths[most]
    return climb(scores.blocks, best)


def in_flow(at: tuple[str, ...], path: tuple[str, ...]) -> bool:
    """Whether a block is text that stands directly in a container around ``path``."""
    k = 0
    while k < len(at) and k < len(path) and at[k] == path[k]:
        k += 1
    return all(tag_of(step) in FLOW for step in at[k:])


def text_of(blocks: list, path: tuple[str, ...]) -> str:
    """Text of the blocks below ``path``, and of headings, paragraphs and lists directly in
    the containers around it unless they are mostly links; empty if none is below."""
    n = len(path)
    if not any(at[:n] == path for at, *_ in blocks):
        return ""
    return "\n".join(
        text
        for at, text, linked, _ in blocks
        if at[:n] == path or (2 * linked <= len(text) and in_flow(at, path))
    )


def template_of(blocks: list) -> str:
    """Digest of the sections that hold text, as far as two below the body.

    Pages of one template have the same sections; the elements of running text do not count.
    """
    sections = set()
    for path, *_ in blocks:
        n = next((k for k, step in enumerate(path) if tag_of(step) in FLOW), len(path))
        roots = sum(tag_of(step) in ROOTS for step in path[:2])
        sections.add(path[: min(n, roots + 2)])
    written = "\n".join(sorted(SEPARATOR.join(path) for path in sections))
    return hashlib.blake2b(written.encode("utf-8", "replace"), digest_size=8).hexdigest()


SEPARATOR = ">"


def site_of(host: str, blocks: list) -> str:
    return f"{host} {template_of(blocks)}"


def host_paths(pages: DataFrame) -> DataFrame:
    """(site, path, pages): the path with most votes of each host's template, and its pages.

    ``site`` is ``site_of`` the page.  A page votes for its container, by the square root of its text's length, so a
    few long pages do not outvote the rest.  Votes are summed per (site, path), in
    each task first, and the best path of a site is an aggregate too: neither a host of
    many pages nor one of many paths meets in one task.
    """

    kinds = (pa.string(), pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sites, paths, votes = [], [], []
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for host, page in pairs:
                blocks = blocks_of(page or "")
                sites.append(site_of(host, blocks))
                scores = scores_of(blocks)
                path = container(scores)
                paths.append(SEPARATOR.join(path) if path else None)
                # whole numbers: their sum does not depend on the order of rows
                votes.append(round(scores[path] ** 0.5) if path else 0)
            yield pa.record_batch(
                [pa.array(x, t) for x, t in zip((sites, paths, votes), kinds, strict=True)],
                names=["site", "path", "votes"],
            )

    voted = (
        pages.where("host is not null")
        .select("host", "html")
        .mapInArrow(run, "site string, path string, votes long")
        .groupBy("site", "path")
        .agg(F.sum("votes").alias("votes"), F.count(F.lit(1)).alias("n"))
    )
    best = F.min(F.when(F.col("path").isNotNull(), F.struct(-F.col("votes"), "path")))
    return voted.groupBy("site").agg(best.alias("best"), F.sum("n").alias("pages")).select(
        "site", "best.path", "pages"
    )


def with_sites(rows: DataFrame) -> DataFrame:
    """(page_id, url, html, site) of rows that have a host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            sites = [site_of(host, blocks_of(page or "")) for page, host in pairs]
            yield pa.record_batch(
                [*batch.columns[:3], pa.array(sites, pa.string())],
                names=["page_id", "url", "html", "site"],
            )

    return rows.mapInArrow(run, "page_id long, url string, html string, site string")


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(page_id, url, text): one row per input row.

    Blocks below the winning container of the page's host and template, in page order, one
    per line; character references are decoded, white space inside a block is one space.
    The container is widened in each page as ``climb`` says, and text that stands directly
    in the containers around it (``text_of``) belongs to it.  A page that has nothing
    there, or whose url is null or names no host, uses its own best container.  A null or empty html, and one without text outside the
    barred parts, gives the empty text.  Ids may be null or repeat; other columns are
    not looked at.  Of paths with equal votes the first by name wins.

    A site with more than 1/1024 of the pages is spread over several join cells.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        url.alias("url"),
        F.col(html_col).cast("string").alias("html"),
        F.nullif(
            F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)),
            F.lit(""),
        ).alias("host"),
    )
    hosts = stored(host_paths(rows), "host-paths")
    named = join_groups(
        with_sites(rows.where("host is not null").select("page_id", "url", "html", "host")),
        hosts, "site", "pages", F.xxhash64("page_id", "url"),
    ).select("page_id", "url", "html", "path")
    unnamed = rows.where("host is null").select(
        "page_id", "url", "html", F.lit(None).cast("string").alias("path")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            for page, path in pairs:
                blocks = blocks_of(page or "")
                text = text_of(blocks, climb(blocks, tuple(path.split(SEPARATOR)))) if path else ""
                texts.append(text or text_of(blocks, container(scores_of(blocks))))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                names=["page_id", "url", "text"],
            )

    return named.unionByName(unnamed).mapInArrow(run, "page_id long, url string, text string")
