"""Main text of web pages: containers are scored page by page, hosts agree on a path."""

from __future__ import annotations

import hashlib
import html as _html
import re
import sys
from array import array
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmill.llm.common import materialise, slices

#: A comment, a tag or a declaration.  Loops are possessive and quotes count after "=" only, so that nothing is scanned twice.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|<[!?][^>]*+>", re.S
)
#: The same without quotes: used behind a tag that does not end.
PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>", re.S)
ATTR = re.compile(r"(?<![^\s\"'/])([^\s=\"'/]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "textarea", "title", "select"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul video audio dialog".split()
)
CONTAINER = {"html", "body", "article", "main", "section", "div", "td", "blockquote", "center"}
OUT = {"head", "nav", "footer", "aside", "form", "button", "input", "label", "menu", "dialog", "header"}
OUT_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
#: Words that mark what surrounds an article, where a class or an id has no others but NEUTRAL ones.
OUT_WORD = set(
    "ad ads advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar"
    " footer header masthead cookie cookies consent notice gdpr popup modal overlay newsletter subscribe subscription signup"
    " login share sharing social related recommended comment comments disqus reply replies pagination pager widget toolbar".split()
)
NEUTRAL = set("area bar block bottom box column container end group inner item items left list outer page panel right section site small top wrap wrapper".split())
GOOD_WORD = {"article", "content", "entry", "main", "post", "story", "text", "body"}
#: A start tag closes an open element of these kinds.
CLOSES = {t: {"p"} for t in BLOCK - {"br"}} | {"li": {"p", "li"}, "dt": {"p", "dd", "dt"}, "dd": {"p", "dd", "dt"}, "tr": {"p", "td", "th", "tr"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"}, "option": {"option"}}


HEADING = re.compile(r"<h[1-6][\s>]", re.I)
NAME_START = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ/")

#: Characters of all hosts' paths up to which they are broadcast; more are joined by shuffling the pages.
BROADCAST_CHARS = 16_000_000
#: Containers of a page that vote, and pages of a host on which a container's text is a template's if half of them repeat it.
VOTES, TEMPLATE_PAGES = 3, 3
#: A part beside the chosen container is left out if more than this share of its characters is linked.
LINKED = 1 / 3


def _words(value: str) -> list[str]:
    return [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()) if w]


def _marks(name: str) -> bool:
    """Whether a class or id says that its element surrounds an article: ``cookie-notice`` does, ``share-of-market`` does not."""
    words = _words(name)
    return any(w in OUT_WORD for w in words) and all(w in OUT_WORD or w in NEUTRAL for w in words)


def tokens(page: str):
    """``(start, end, match)`` of the page's tags and comments, each character scanned a fixed number of times."""
    last, at, pattern = page.rfind(">"), 0, TOKEN
    while (start := page.find("<", at)) >= 0:
        m = pattern.match(page, start)
        if m is None and page[start + 1 : start + 2] in NAME_START and pattern is TOKEN and start < last:
            # a tag whose quotes never end: from here on quotes do not count
            pattern, m = PLAIN, PLAIN.match(page, start)
        if m is None and start > last:
            return
        if m is None:
            at = start + 1
            continue
        at = yield start, m.end(), m
        at = at or m.end()


class Page:
    """Elements and blocks of a page, in page order.

    ``up``, ``tag``, ``path`` and ``box`` have an entry for each element; 0 is
    the page.  A path is a number that stands for its parent path and a step of
    tag and classes, digits generalised to ``#``.  ``box`` is the nearest
    container, from the element upwards, that is part of an article; ``out`` marks elements
    that are not, as they or one above them are navigation or the like;
    ``art`` is the outermost article or main element around, 0 without one.
    ``blocks`` are (element, text, linked characters).
    """

    def __init__(self, page: str):
        self.up, self.tag, self.path, self.box, self.art = array("l", [-1]), [""], array("l", [0]), array("l", [0]), array("l", [0])
        self.out, self.good, self.link, self.blocks = bytearray(1), bytearray(1), bytearray(1), []
        self.paths: dict[int, int] = {}
        self.steps: dict[str, int] = {}
        self.parents, self.names = array("l", [-1]), [""]
        self._read(page)

    def _path(self, parent: int, step: str) -> int:
        key = parent << 32 | self.steps.setdefault(step, len(self.steps))
        got = self.paths.get(key)
        if got is None:
            got = self.paths[key] = len(self.parents)
            self.parents.append(parent)
            self.names.append(sys.intern(step))
        return got

    def path_text(self, path: int) -> str:
        """The steps of a path from the root, each after a ``>``."""
        steps = []
        while path > 0:
            steps.append(self.names[path])
            path = self.parents[path]
        return "".join(">" + x for x in reversed(steps))

    def find_path(self, text: str) -> int | None:
        """The path with that text, if the page has it."""
        path = 0
        for step in text.split(">")[1:]:
            n = self.steps.get(step)
            path = None if n is None else self.paths.get(path << 32 | n)
            if path is None:
                return None
        return path

    def _read(self, page: str) -> None:
        tags, out, blocks = self.tag, self.out, self.blocks
        stack, buf, linked = [0], [], 0
        # places in the stack: of each open tag, of open blocks, of open containers
        open_, block_at, box_at = defaultdict(list), [], []

        def flush():
            nonlocal buf, linked
            text = " ".join("".join(buf).split())
            if text:
                blocks.append((stack[-1], text, linked))
            buf, linked = [], 0

        def pop_to(i: int):
            for e in reversed(stack[i:]):
                t = tags[e]
                open_[t].pop()
                if t in BLOCK:
                    block_at.pop()
                if t in CONTAINER:
                    box_at.pop()
            del stack[i:]

        def say(chunk: str):
            nonlocal linked
            if chunk and not out[stack[-1]]:
                t = _html.unescape(chunk)
                buf.append(t)
                linked += len(t.strip()) if self.link[stack[-1]] else 0

        at, walk = 0, tokens(page)
        item = next(walk, None)
        while item:
            start, end, m = item
            say(page[at:start])
            at, jump = end, None
            if m[2] is not None:
                jump = self._tag(page, m, at, stack, open_, block_at, box_at, flush, pop_to)
                at = jump or at
            try:
                item = walk.send(jump)
            except StopIteration:
                break
        say(page[at:])
        flush()

    def _tag(self, page, m, at, stack, open_, block_at, box_at, flush, pop_to) -> int | None:
        """One tag; the place to go on at, if it is not the tag's end."""
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            mine = open_[tag][-1] if open_[tag] else 0
            # an inline end tag does not reach out of its container
            if mine and (tag in BLOCK or not box_at or box_at[-1] <= mine):
                pop_to(mine)
            return None
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(page, at)
            return end.end() if end else len(page)
        if tag in BLOCK:
            flush()
        if tag in VOID:
            return None
        closes = CLOSES.get(tag)
        while closes and block_at and (t := self.tag[stack[block_at[-1]]]) in closes:
            pop_to(block_at[-1])
            if t != "p" and tag in ("li", "dt", "dd", "td", "th", "option"):
                break
        if tag == "a" and open_["a"] and (not box_at or box_at[-1] <= open_["a"][-1]):
            pop_to(open_["a"][-1])  # links do not nest
        attrs = {k.lower(): a or b or c for k, a, b, c in ATTR.findall(m[3])} if m[3] else {}
        cls, top, e = attrs.get("class", ""), stack[-1], len(self.up)
        names = [*cls.split(), attrs.get("id", "")] if attrs else []
        hides = tag in OUT or attrs.get("role") in OUT_ROLE or (tag not in ("html", "body", "article", "main") and any(map(_marks, names))) or attrs.get("aria-hidden") == "true" or "hidden" in m[3].split()
        if hides and tag == "header" and self.art[top]:  # an article's own header holds its headline
            hides = HEADING.search(page, at, len(page) if (end := page.find("</header", at)) < 0 else end) is None
        gone = bool(self.out[top] or hides)
        self.art.append(self.art[top] or (e if not gone and (tag in ("article", "main") or attrs.get("role") == "main") else 0))
        self.up.append(top)
        self.tag.append(sys.intern(tag))
        self.out.append(gone)
        self.link.append(self.link[top] or tag == "a" and "href" in attrs)
        self.good.append(tag in ("article", "main") or any(w in GOOD_WORD for n in names for w in _words(n)) or attrs.get("role") == "main")
        self.path.append(self._path(self.path[top], tag + "".join("." + re.sub(r"\d+", "#", c) for c in sorted(cls.replace(">", "_").split()))))
        self.box.append(e if tag in CONTAINER and not gone else self.box[top])
        if not m[3].endswith("/"):
            open_[tag].append(len(stack))
            if tag in BLOCK:
                block_at.append(len(stack))
            if tag in CONTAINER:
                box_at.append(len(stack))
            stack.append(e)
        return None

    def score(self) -> dict[int, float]:
        """Points by container path: unlinked text counts for its container, and by a falling share for those above."""
        points: dict[int, float] = defaultdict(float)
        for e, text, linked in self.blocks:
            worth, share, e = max(0, len(text) - 2 * linked) + 25 * text.count(","), 1.0, self.box[e]
            while e > 0 and share > 0.2:
                points[self.path[e]] += worth * share * (1.3 if self.good[e] else 1.0)
                share *= 0.75
                e = self.box[self.up[e]]
        return points

    def _sums(self) -> tuple[list[int], list[int]]:
        """Characters at or below each element, and the linked ones of them."""
        chars, linked = [0] * len(self.up), [0] * len(self.up)
        for e, text, n in self.blocks:
            if not self.out[e]:
                chars[e] += len(text)
                linked[e] += min(n, len(text))
        for e in range(len(self.up) - 1, 0, -1):
            chars[self.up[e]] += chars[e]
            linked[self.up[e]] += linked[e]
        return chars, linked

    def article(self, chars: list[int], linked: list[int]) -> int:
        """The element that the page itself marks as its article, 0 without one.

        The outermost article or main element with the most unlinked text, or
        within a main element its article, if that has most of it.  Where
        several hold comparable text, the element around them all.
        """
        worth = lambda e: chars[e] - linked[e]
        tops = [e for e in range(1, len(self.up)) if self.art[e] == e and worth(e) > 0]
        if not tops:
            return 0
        best = max(tops, key=worth)
        if worth(best) < 0.6 * sum(map(worth, tops)):
            return self._around(tops)
        if self.tag[best] != "article":
            inner = [e for e in range(best + 1, len(self.up)) if self.tag[e] == "article" and self.art[e] == best and not self.out[e]]
            if inner and worth(one := max(inner, key=worth)) > 0.6 * worth(best):
                return one
        return best

    def _around(self, elements: list[int]) -> int:
        """The innermost element around all of ``elements``: parents have smaller numbers."""
        left = set(elements)
        while len(left) > 1:
            e = max(left)
            left.remove(e)
            left.add(self.up[e])
        return left.pop()

    def ballot(self) -> list[tuple[str, float]]:
        """The container paths that the page votes for, each with a share of its points; the article alone if it is marked, the whole page only if it has no parts."""
        if marked := self.article(*self._sums()):
            return [(self.path_text(self.path[marked]), 1.0)]
        points = self.score()
        whole = sum(points.values()) or 1.0
        named = sorted((-v / whole, self.path_text(k)) for k, v in points.items())
        parts = [(v, p) for v, p in named if p.rsplit(">", 1)[-1].split(".")[0] not in ("html", "body")]
        return [(p, -v) for v, p in (parts or named)[:VOTES]]

    def regions(self) -> list[tuple[str, str, str]]:
        """Each container's path, a digest of its own text and one of the page's text, where the page marks no article."""
        if self.article(*self._sums()):
            return []
        texts: dict[int, list[str]] = defaultdict(list)
        for e, text, _ in self.blocks:
            if not self.out[e] and self.box[e]:
                texts[self.box[e]].append(text)
        digest = lambda lines: hashlib.md5("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()
        whole = digest(t for _, t, _ in self.blocks)
        return [(self.path_text(self.path[e]), digest(t), whole) for e, t in texts.items() if self.tag[e] not in ("html", "body")]

    def text(self, path: str | None = None, templates=()) -> str:
        """The article's text, given the path that its host's pages agree on and the paths of the host's templates.

        The marked article, unless another element at the host's path has more
        unlinked text; all of it is kept.  Without a marked article: all of the
        elements at the host's path, or of the page's own best container, and
        of what lies beside them, up to the page, each part that is neither a
        template nor mostly links.
        """
        chars, linked = self._sums()
        worth = lambda e: chars[e] - linked[e]
        known = self.find_path(path) if path else None
        at = [e for e in range(1, len(self.up)) if self.path[e] == known and not self.out[e] and chars[e]] if known is not None else []
        marked = self.article(chars, linked)
        if marked and sum(map(worth, at)) <= worth(marked) or marked and any(self._within(e, marked) or self._within(marked, e) for e in at):
            base = [marked]
        else:
            # of the whole page, its heaviest part: what lies beside it is then looked at part by part
            base, marked = [self._heaviest(e, worth) for e in at or [self._own()]], 0
        inside, on_line, drop = bytearray(len(self.up)), bytearray(len(self.up)), bytearray(len(self.up))
        for e in base:
            inside[e] = 1
            while not marked and e > 0 and not on_line[self.up[e]]:
                e = self.up[e]
                on_line[e] = 1
        gone = {k for k in map(self.find_path, templates) if k is not None}
        for e in range(1, len(self.up)):
            up = self.up[e]
            inside[e] = inside[e] or inside[up]
            if not inside[e] and not on_line[e]:
                drop[e] = drop[up] or self.path[e] in gone or bool(on_line[up]) and linked[e] > LINKED * chars[e]

        def stays(e, text, n):
            if self.out[e] or marked and not inside[e]:
                return False
            return inside[e] or not drop[e] and not (on_line[e] and min(n, len(text)) > LINKED * len(text))

        return "\n".join(t for e, t, n in self.blocks if stays(e, t, n))

    def _own(self) -> int:
        """The element of the page's best container path with the most text, else the page."""
        points = self.score()
        if not points:
            return 0
        most = max(points.values())
        path = min((k for k, v in points.items() if v == most), key=self.path_text)
        chars, _ = self._sums()
        return max((e for e in range(len(self.up)) if self.path[e] == path and not self.out[e]), key=lambda e: (chars[e], -e))

    def _heaviest(self, e: int, worth) -> int:
        """``e``, or within html and body elements the part with the most unlinked text, the first on a tie."""
        while self.tag[e] in ("", "html", "body"):
            parts = [i for i in range(e + 1, len(self.up)) if self.up[i] == e and not self.out[i] and worth(i) > 0]
            if not parts:
                break
            e = max(parts, key=lambda i: (worth(i), -i))
        return e

    def _within(self, e: int, outer: int) -> bool:
        while e > outer:
            e = self.up[e]
        return e == outer


def extract(page: str, path: str | None = None, templates=()) -> str:
    """The main text of a page, given its host's path and templates."""
    return Page(page).text(path, templates)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract_pages(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` to page_id, url, text, n_chars, container.

    Each page votes with shares of its points for paths of generalised
    tag-class steps: its marked article, or its best containers.  Containers
    whose text half of a host's different pages or more repeat are templates
    and get no votes; a host's path is the one with most votes (ties: the smaller).  Pages
    are then extracted at their host's path, without its templates.  Votes are
    summed before the shuffle; the hosts' paths are broadcast if they are few
    enough, else the join lets Spark split the pages of a hot host.

    Null html gives the empty text, a page without a host is on its own,
    repeated rows stay, an empty table gives no rows, other columns are ignored.
    """

    def vote(batches):
        import pyarrow as pa

        for part in slices(batches):
            rows = []
            for host, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                page = Page(text or "")
                rows += [(host, p, v, None, None) for p, v in page.ballot()] + [(host, p, 0.0, d, w) for p, d, w in page.regions()]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.float64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["host", "path", "share", "digest", "page"])

    def take(batches):
        import pyarrow as pa

        for part in slices(batches):
            text = [extract(h or "", p, t or ()) for h, p, t in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64()), part.column(3)], names=["page_id", "url", "text", "n_chars", "container"])

    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), F.nullif(host_of(pages["url"]), F.lit("")).alias("host"))
    ballots = materialise(rows.where("host is not null").select("host", "html").mapInArrow(vote, "host string, path string, share double, digest string, page string"))
    seen = ballots.where("digest is not null").select("host", "path", "digest", "page").distinct().groupBy("host", "path", "digest").agg(F.count("*").alias("n"))
    templates = seen.groupBy("host", "path").agg(F.sum("n").alias("n"), F.count("*").alias("different")).where((F.col("n") >= TEMPLATE_PAGES) & (2 * F.col("different") <= F.col("n"))).select("host", "path")
    votes = ballots.where("share > 0").groupBy("host", "path").agg(F.round(F.sum("share"), 6).alias("votes")).join(templates, ["host", "path"], "left_anti")
    # a struct's order is by field: most votes, then the smaller path
    winners = votes.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), F.col("path"))).alias("w")).select("host", F.col("w.path").alias("path"))
    listed = templates.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("templates"))
    winners = materialise(winners.join(listed, "host", "full"))
    size = winners.agg(F.sum(F.length("host") + F.coalesce(F.length("path"), F.lit(0)) + F.coalesce(F.length(F.concat_ws("", "templates")), F.lit(0)))).first()[0] or 0
    if size <= BROADCAST_CHARS:
        winners = F.broadcast(winners)
    id_type = pages.schema["page_id"].dataType.simpleString()
    return rows.join(winners, "host", "left").select("page_id", "url", "html", "path", "templates").mapInArrow(take, f"page_id {id_type}, url string, text string, n_chars long, container string")
