"""Main-text extraction by consensus host paths.

A first pass scores the containers of every page and lets each page vote for its best ones under a
generalised path (tags with classes, digits struck out). Spark sums the votes by host and path; a host's
winner is the path with most votes. A second pass extracts each page again from the containers on its host's
winning path, or from its own best container where that path has no text there. Both passes are one linear scan
of the page for tags.

What is boilerplate by tag, role or a class that names comments or adverts is left out. Other class names of
boilerplate, and forms, only make an element suspect: it is left out unless another of its classes says that it is
the text, or it holds most of the page's text (as a wrapper of a whole page does).
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, broadcast_if_small, stored

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=>"'/]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
LONG_NAME, LONG_PATH = 200, 200  # characters; what is longer goes by its hash
WRAPPER = 0.6  # of a page's text outside links: what a suspect element holds to be no boilerplate
STRONG_WRAPPER = 0.9  # and what one named after comments or adverts holds, beside a clean container that promises text
TEASER = 0.2  # of the best container's score: what the winning path scores at least unless the page has its article elsewhere
SIBLING = 0.3  # of a container's score: what a promising one beside it scores to be part of the same article
VOTES = 10**12  # of a page, over its containers by squared score

# Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
LEFT_OUT = frozenset("aside button canvas datalist dialog footer head header iframe menu nav noscript object script select style svg template textarea title video audio".split())
CONTAINER = frozenset("article body div main section td".split())
BLOCK = CONTAINER | LEFT_OUT | frozenset("form address blockquote caption center dd details dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li ol p pre summary table tbody tfoot th thead tr ul".split())
SCOPES = CONTAINER | frozenset("ul ol dl table".split())
CLOSES_ITSELF = frozenset("dd dt li option p td th tr".split())
NOISE = frozenset(
    "ad ads adsense advert advertisement advertising adverts alert banner breadcrumb breadcrumbs byline comment commentlist comments consent cookie cookies copyright disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination popup promo promos promotion recommended related reply respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar widget widgets".split()
)
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
GOOD = frozenset("article articlebody body content entry main post story text".split())
ABOUT_LAYOUT = frozenset("has is layout no page with without".split())
# What may stand beside a word of NOISE in one name.
BESIDE = frozenset("area bar block bottom box col column container content footer global group header holder inner item items left list main module outer page panel primary region right row secondary section site top wrap wrapper".split())
NEVER_NOISE = frozenset(["html", "body", "main"])
STRONG = frozenset("ad ads advert adverts advertisement comment commentlist comments disqus promo promos related reply respond responses sponsored".split())
CLEAN, SUSPECT, STRONGLY, NOISY = 0, 1, 2, 3


def parts(name: str) -> list[str]:
    return [x for x in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if x]


def name_says(name: str) -> tuple[int, bool]:
    """(CLEAN, SUSPECT or STRONGLY so, whether it promises text) of one class or id."""
    p = parts(name)
    if p and p[0] in ABOUT_LAYOUT:  # has-sidebar, no-comments
        return CLEAN, False
    for k, word in enumerate(p):
        if word in ("with", "has", "no", "without", "free"):  # article-with-sidebar, ad-free
            p = p[:k] if word != "free" else p[: max(0, k - 1)]
            break
    words = set(p)
    good = not GOOD.isdisjoint(words)
    if NOISE.isdisjoint(words) or not words <= NOISE | BESIDE | GOOD:  # widget in elementor-widget-container says nothing
        return CLEAN, good
    return (SUSPECT, False) if STRONG.isdisjoint(words) else (STRONGLY, False)


def look(tag: str, attributes: str) -> tuple[int, bool, str]:
    """(CLEAN, SUSPECT, STRONGLY so or NOISY, promising, generalised name) of an element."""
    state = NOISY if tag in LEFT_OUT else SUSPECT if tag == "form" else CLEAN
    said, good, names = CLEAN, tag in ("article", "main"), []
    if "=" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            kind = m[1].lower()
            if kind not in ("class", "id", "role"):
                continue
            value = m[2] or m[3] or m[4] or ""
            value = unescape(value) if "&" in value else value
            if kind == "role":
                if value.lower() in ROLES:
                    state = max(state, NOISY if tag not in NEVER_NOISE else CLEAN)
                good = good or value.lower() in ("main", "article")
                continue
            for name in value.split():
                noise, promise = name_says(name)
                said, good = max(said, noise), good or promise
                if kind == "class":
                    names.append(re.sub(r"\d+", "", name.lower()))
    if tag not in NEVER_NOISE and not (said == SUSPECT and good):  # of content and sidebar-right, content counts
        state = max(state, said)
    name = tag + "".join(f".{n}" for n in sorted(set(names)))
    return state, good, name if len(name) <= LONG_NAME else f"{tag}.#{xxhash.xxh64_hexdigest(name.encode('utf-8', 'replace'))}"


class Page:
    """Containers and text blocks of a page, boilerplate left out. Memory is linear in the page."""

    def __init__(self, html: str):
        self.paths: list[str] = ["html"]
        self.parents: list[int] = [-1]
        self.good: list[bool] = [False]
        self.blocks: list[tuple[str, int, int]] = []  # text, characters of links, container
        self.region: list[int] = [-1]  # of each container: the innermost suspect element around it
        self.strong: list[bool] = []  # of each suspect element
        self.holds_good: list[bool] = []  # of each suspect element: a clean container that promises text
        suspects, within = self._scan(html)
        self._settle(suspects, within)

    def _path(self, container: int, name: str) -> str:
        above = self.paths[container]
        if len(above) > LONG_PATH:
            above = f"#{xxhash.xxh64_hexdigest(above.encode('utf-8', 'replace'))}"
        return f"{above}>{name}"

    def _scan(self, html: str) -> tuple[list[int], list[int]]:
        """(the suspect element around each suspect element, the one around each block), -1 for none."""
        # an open element: tag, whether left out, innermost container, innermost suspect, open tags of its scope by place
        stack: list[tuple[str, bool, int, int, dict]] = [("", False, 0, -1, {})]
        opened: dict[str, int] = defaultdict(int)
        text: list[str] = []
        suspects: list[int] = []
        within: list[int] = []
        links, in_link, at = 0, 0, 0

        def flush() -> None:
            nonlocal links
            if text:
                block = " ".join(unescape("".join(text)).split())
                text.clear()
                if block:
                    self.blocks.append((block, links, stack[-1][2]))
                    within.append(stack[-1][3])
            links = 0

        def take(piece: str) -> None:
            nonlocal links
            if piece and not stack[-1][1]:
                text.append(piece)
                if in_link:
                    links += len(piece)

        def close(depth: int) -> None:
            nonlocal in_link
            if any(x[0] in BLOCK for x in stack[depth:]):
                flush()
            for d in range(len(stack) - 1, depth - 1, -1):
                tag = stack[d][0]
                opened[tag] -= 1
                in_link -= tag == "a"
                stack[d - 1][4][tag].pop()
            del stack[depth:]

        while True:
            m = TAG.search(html, at)
            if not m:
                take(html[at:])
                break
            take(html[at : m.start()])
            at = m.end()
            ending, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if ending:
                if opened.get(tag):  # so the search stops at what it closes
                    close(next(d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == tag))
                elif tag in BLOCK:
                    flush()
                continue
            if tag == "br":
                take(" ")
            if tag in VOID:
                if tag == "hr":
                    flush()
                continue
            if tag in BLOCK:
                # a block ends a paragraph that is open in its scope, an item the item before it
                here = stack[-1][4]
                depth = max([places[-1] for t in {"p", tag if tag in CLOSES_ITSELF else "p"} if (places := here.get(t))], default=0)
                if depth:
                    close(depth)
                flush()
            elif tag != "a" and "=" not in attributes and tag not in RAW:
                continue
            state, good, name = look(tag, attributes)
            if tag not in BLOCK and tag != "a" and state == CLEAN and tag not in RAW:
                continue
            _, skipped, container, suspect, scope = stack[-1]
            if state in (SUSPECT, STRONGLY) and not skipped:
                flush()
                suspects.append(suspect)
                self.strong.append(state == STRONGLY)
                self.holds_good.append(False)
                suspect = len(suspects) - 1
            skipped = skipped or state == NOISY
            if tag in CONTAINER and not skipped:
                self.paths.append(self._path(container, name))
                self.parents.append(container)
                self.good.append(good)
                self.region.append(suspect)
                if suspect >= 0 and good and state == CLEAN:
                    self.holds_good[suspect] = True
                container = len(self.paths) - 1
            if tag in RAW:  # its content isn't markup
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(html, at)
                at = end.start() if end else len(html)
                skipped = True
            scope.setdefault(tag, []).append(len(stack))
            stack.append((tag, skipped, container, suspect, {} if tag in SCOPES else scope))
            opened[tag] += 1
            in_link += tag == "a"
        flush()
        return suspects, within

    def _settle(self, suspects: list[int], within: list[int]) -> None:
        """Drop the blocks and containers of suspect elements but those that hold most of the page's text."""
        if not suspects:
            return
        sizes = [max(0, len(block) - links) for block, links, _ in self.blocks]
        dropped = [False] * len(suspects)

        def held() -> tuple[list[float], float]:
            """Text in each suspect element, and in all of the page, without what is dropped."""
            each, total = [0.0] * len(suspects), 0.0
            for size, r in zip(sizes, within, strict=True):
                if r < 0 or not dropped[r]:
                    total += size
                    if r >= 0:
                        each[r] += size
            for r in range(len(suspects) - 1, -1, -1):  # an inner one comes after those around it
                if suspects[r] >= 0:
                    each[suspects[r]] += each[r]
            return each, total

        for r in range(len(suspects) - 1, -1, -1):
            if suspects[r] >= 0 and self.holds_good[r]:
                self.holds_good[suspects[r]] = True
        for kind, share in ((True, STRONG_WRAPPER), (False, WRAPPER)):
            each, total = held()
            for r, outer in enumerate(suspects):
                if self.strong[r] == kind:
                    dropped[r] = not (each[r] > 0 and each[r] >= share * total and (self.holds_good[r] or not kind))
                dropped[r] = dropped[r] or outer >= 0 and dropped[outer]
        self.blocks = [b for b, r in zip(self.blocks, within, strict=True) if r < 0 or not dropped[r]]

    def scores(self) -> list[float]:
        """Text of each container outside links; what lies in an inner container counts less."""
        own = [0.0] * len(self.paths)
        for block, links, c in self.blocks:
            own[c] += max(0, len(block) - 1.5 * links)
        for c in range(len(own) - 1, 0, -1):  # a container comes after those around it
            own[self.parents[c]] += 0.6 * own[c]
        return [s * (1.5 if g else 1.0) for s, g in zip(own, self.good, strict=True)]

    def votes(self) -> list[tuple[str, int]]:
        """The page's votes over the paths of its containers that have text, by squared score."""
        by_path: dict[str, float] = defaultdict(float)
        for p, s in zip(self.paths, self.scores(), strict=True):
            by_path[p] = max(by_path[p], s)
        total = sum(s * s for s in by_path.values()) or 1.0
        return [(p, int(VOTES * s * s / total)) for p, s in by_path.items() if s > 0]

    def text(self, path: str | None) -> str:
        """Blocks inside the containers on `path`, or inside the page's best container.

        The best one stands in where there is no text on the path; and where its name promises text and the path has
        little beside it, under TEASER of its score, in containers apart from it. Of equal scores the first container is best. Containers next to the chosen ones whose names promise text and
        that score well beside them (SIBLING) belong to the same article.
        """
        s = self.scores()
        best = max(range(len(s)), key=s.__getitem__)
        chosen = [i for i, p in enumerate(self.paths) if p == path and s[i] > 0]
        if not chosen or self.good[best] and max(s[i] for i in chosen) < TEASER * s[best] and self._apart(chosen, best):
            chosen = [best] if s[best] > 0 else []
        beside = {self.parents[i]: max(s[j] for j in chosen if self.parents[j] == self.parents[i]) for i in chosen}
        more = [i for i in range(1, len(s)) if self.good[i] and self.parents[i] in beside and s[i] >= SIBLING * beside[self.parents[i]]]
        inside = [False] * len(s)
        for i in chosen + more:
            inside[i] = True
        return self._inside(inside)

    def _apart(self, chosen: list[int], best: int) -> bool:
        """Whether the best container is neither one of these nor in or around one."""
        inside = set(chosen)
        at = best
        while at >= 0 and at not in inside:
            at = self.parents[at]
        below = {best}
        for i in range(best + 1, len(self.parents)):  # a container comes after those around it
            if self.parents[i] in below:
                below.add(i)
        return at < 0 and inside.isdisjoint(below)

    def _inside(self, inside: list[bool]) -> str:
        if not any(inside):
            return ""
        for c in range(1, len(inside)):
            inside[c] = inside[c] or inside[self.parents[c]]
        return "\n".join(block for block, _, c in self.blocks if inside[c])


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, votes): the winning path of each host. Ties go to the path that sorts last; pages without a host have no vote.

    Names and paths of over LONG_NAME and LONG_PATH characters are named by their hash in it.
    """
    def run(batches):
        for b in bounded(batches, 1):
            count: dict[tuple[str, str], int] = defaultdict(int)
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for path, n in Page(html).votes():
                    count[host, path] += n
            rows = list(count.items())
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k, _ in rows], pa.string()) for i in (0, 1)] + [pa.array([n for _, n in rows], pa.int64())], names=["host", "path", "votes"])

    source = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")).where("host <> ''")
    votes = source.mapInArrow(run, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return votes.groupBy("host").agg(F.max(F.struct("votes", "path")).alias("best")).select("host", "best.path", "best.votes")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages.

    Null, empty and text-free html give an empty text. Rows whose url has no host are extracted from their own best container. Truncated pages are
    read to their end; a tag cut off there is dropped. A quote that never closes ends with its tag. Repeated rows get a row each. An empty table gives an
    empty result. Other columns of pages are not looked at.
    """
    winners = stored(host_paths(pages, url_col, html_col).select("host", "path"), "host-paths")
    winners = broadcast_if_small(winners, size=F.length("host") + F.length("path"))
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), host_of(F.col(url_col)).alias("host"))

    def run(batches):
        for b in bounded(batches, 2):
            texts = [Page(html).text(path) for html, path in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return source.join(winners, "host", "left").select("page_id", "url", "html", "path").mapInArrow(run, "page_id long, url string, text string, n_chars long")
