"""Main text of web pages by consensus of each host's pages.

Every page scores its containers and votes for the path, generalised to tags and
classes, of the best one.  Votes are summed per host in Spark; then every page is read
again and gives the text of its containers on the highest voted path that it has.

A path is named by a hash of its steps, each chained to the one before, so names are
short however deep a page is nested.  Reading a page takes time and memory in proportion
to its length.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, holding, kept

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"<]*+"|'[^'<]*+')*+[^>]*+)>""")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)

# What HTML calls these elements, and names that mark boilerplate.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("body div section article main td center".split())
BLOCKS = CONTAINERS | frozenset(
    "html head p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr th caption blockquote pre figure figcaption address details summary hgroup fieldset legend hr "
    "nav header footer aside form button select option optgroup label dialog menu noscript template svg object canvas video audio map search".split()
)
UNWANTED = frozenset("nav footer aside form button select option optgroup label dialog menu noscript template svg object canvas video audio map search head fieldset script style textarea title xmp iframe noembed noframes".split())
UNWANTED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
UNWANTED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus discussion footer gdpr menu menus modal nav navbar navigation newsletter notice notices "
    "pager pagination popup promo promos promotion recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets masthead skip".split()
)
_CLOSES_P = BLOCKS - frozenset(("td", "th", "tr", "thead", "tbody", "tfoot", "caption", "li", "dt", "dd", "option", "optgroup", "label", "button"))
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",), "p": ("p",)}
_STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("table", "tr"), "th": ("table", "tr"), "tr": ("table", "tbody", "thead", "tfoot"), "option": ("select",)}
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.IGNORECASE) for t in RAW}
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")


class Paths:
    """The container paths of one page, by number; 0 is the page itself, and a path's parent has a smaller number."""

    def __init__(self):
        self.parent, self.depth, self.key = [-1], [0], [b"\0" * 16]
        self.inside = [False]  # below a step that names an article or main
        self.first = [(None, None)]  # the first article and the first main on the way
        self._step: dict[tuple[int, str], int] = {}

    def __len__(self) -> int:
        return len(self.parent)

    def child(self, up: int, tag: str, classes: str) -> int:
        """The path one step down: a tag and a class."""
        step = f"{tag}.{classes}" if classes else tag
        found = self._step.get((up, step))
        if found is None:
            found = self._step[up, step] = len(self.parent)
            self.parent.append(up)
            self.depth.append(self.depth[up] + 1)
            self.key.append(hashlib.blake2b(self.key[up] + step.encode("utf-8", "replace"), digest_size=16).digest())
            self.inside.append(self.inside[up] or "article" in step or "main" in step)
            article, main = self.first[up]
            self.first.append((found if article is None and tag == "article" else article, found if main is None and tag == "main" else main))
        return found


class _Stack:
    """Open elements with their tags' places, so that the nearest one of a kind is found at once."""

    def __init__(self):
        self.tags, self.paths = ["html"], [0]
        self.at: dict[str, list[int]] = {}
        self.containers: list[int] = []
        self.dropped_from: int | None = None  # the lowest element of boilerplate that is open

    def push(self, tag: str, path: int, dropped: bool) -> None:
        k = len(self.tags)
        self.tags.append(tag)
        self.paths.append(path)
        self.at.setdefault(tag, []).append(k)
        if tag in CONTAINERS:
            self.containers.append(k)
        if dropped and self.dropped_from is None:
            self.dropped_from = k

    def cut(self, k: int) -> None:
        """Closes all elements from place k on."""
        while len(self.tags) > k:
            tag = self.tags.pop()
            self.paths.pop()
            self.at[tag].pop()
            if tag in CONTAINERS:
                self.containers.pop()
        if self.dropped_from is not None and self.dropped_from >= k:
            self.dropped_from = None

    def nearest(self, *tags: str) -> int:
        """The place of the innermost open element of these tags, 0 without one."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)


def _names(value: str) -> list[str]:
    return _WORD.findall(_CAMEL.sub(r"\1 \2", value).lower())


def blocks(page: str) -> tuple[list[tuple[int, str, int]], Paths]:
    """(number of the container's path, text, characters in links) of each block outside boilerplate, in page order; and the paths.

    Paths are of containers only: tag and first class or id with digits left out.
    Elements that are left open end where their parent does; p, li, cells and the like
    end at the next one; an article or main ends boilerplate that was left open.  Any
    length and depth is read; a tag without an end is text.
    """
    stack, paths = _Stack(), Paths()
    out: list[tuple[int, str, int]] = []
    held: list[str] = []
    linked, in_link = 0, False
    n = len(page)
    last_end = page.rfind(">")  # behind it no tag ends
    open_quote = False  # a tag's quotes stayed open up to the page's end: so will those of any later one
    endless: set[str] = set()  # raw elements without an end tag ahead

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text and stack.dropped_from is None:
                out.append((stack.paths[-1], text, linked))
            held.clear()
        linked = 0

    def close(tags: tuple[str, ...], stops: tuple[str, ...] = ()) -> None:
        """Ends the innermost of the tags unless a container or a stop is inside it."""
        k = stack.nearest(*tags)
        if k and k >= stack.nearest(*stops) and k >= (stack.containers[-1] if stack.containers else 0):
            flush()
            stack.cut(k)

    def add(start: int, end: int) -> None:
        nonlocal linked
        if end > start:
            piece = page[start:end]
            held.append(entities.unescape(piece) if "&" in piece else piece)
            if in_link:
                linked += len(piece)

    at = seen = 0  # what is before ``at`` is done, and no tag begins in at..seen
    while True:
        start = page.find("<", seen)
        if start < 0:
            add(at, n)
            break
        two = page[start + 1 : start + 2]
        if two == "!" or two == "?":
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                end = n if end < 0 else end + 3
            elif start < last_end:
                end = page.find(">", start) + 1
            else:
                seen = start + 1
                continue
            add(at, start)
            at = seen = end
            continue
        m = _TAG.match(page, start) if start < last_end and not open_quote and two and (two == "/" or two.isalpha()) else None
        if m is None:
            after = page[start + 2 : start + 3] if two == "/" else two
            open_quote = open_quote or (start < last_end and after.isascii() and after.isalpha())
            seen = start + 1
            continue
        add(at, start)
        at = seen = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                in_link = False
            elif tag in BLOCKS:
                place = stack.nearest(tag)
                if place or tag == "p":  # any other end tag without a start is nothing
                    flush()
                if place:
                    stack.cut(place)
            continue
        if tag in RAW:
            stop = None if tag in endless else _ENDS[tag].search(page, at, last_end + 1)
            if stop is None:
                endless.add(tag)
            if tag in ("textarea", "title", "script", "style") or stop:
                at = seen = stop.end() if stop else n
            continue
        if tag in VOID:
            if tag == "br":
                held.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag == "a":
            in_link = True
            continue
        if tag not in BLOCKS:
            continue
        flush()
        in_link = False
        if tag in ("article", "main") and stack.dropped_from is not None:
            named = [stack.at[t][0] for t in ("article", "main") if stack.at.get(t)]
            if not named or min(named) >= stack.dropped_from:
                stack.cut(stack.dropped_from)
        if tag == "body" and stack.at.get("head"):
            stack.cut(stack.at["head"][0])
        if tag in _CLOSES_P or tag == "p":
            close(("p",))
        if tag in _SIBLINGS and tag != "p":
            close(_SIBLINGS[tag], _STOPS[tag])
        up = stack.paths[-1]
        classes, names, role, hidden = "", [], "", False
        if m[3]:
            for a in _ATTRIBUTE.finditer(m[3]):
                key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if key == "class" or key == "id":
                    names += _names(value)
                    if key == "class" or not classes:
                        classes = re.sub(r"[0-9]+", "", (value.split() or [""])[0].lower())
                elif key == "role":
                    role = value.strip().lower()
                elif key == "hidden":
                    hidden = True
                elif key == "style":
                    hidden = hidden or bool(re.search(r"display\s*:\s*none", value, re.IGNORECASE))
        inside = paths.inside[up]
        dropped = stack.dropped_from is not None or hidden or tag in UNWANTED or role in UNWANTED_ROLES
        if tag not in ("article", "main", "body", "html"):
            dropped = dropped or not UNWANTED_WORDS.isdisjoint(names) or (not inside and (tag == "header" or "header" in names))
        elif tag == "article" and not dropped and up and inside:
            dropped = not UNWANTED_WORDS.isdisjoint(names)
        stack.push(tag, paths.child(up, tag, classes) if tag in CONTAINERS else up, dropped)
    flush()
    return out, paths


def best_path(found: list[tuple[int, str, int]], paths: Paths) -> tuple[int, float] | None:
    """The path a page votes for, with its score: text outside links of its own blocks, and half of its children's."""
    score: dict[int, float] = {}
    for path, text, linked in found:
        worth = max(0.0, len(text) - 2.0 * linked) * (1.0 if text.count(" ") >= 2 else 0.2)
        score[path] = score.get(path, 0.0) + worth
        above = paths.parent[path]
        if above > 0:
            score[above] = score.get(above, 0.0) + worth / 2
    if not score:
        return None
    path = max(score, key=lambda p: (score[p], paths.depth[p], paths.key[p]))
    # a named container is the whole, whatever part of it scored best
    return next((k for k in paths.first[path] if k is not None), path), score[path]


def present(found: list[tuple[int, str, int]], paths: Paths) -> list[bool]:
    """Which paths hold a block, in themselves or below."""
    out = [False] * len(paths)
    for path, _, _ in found:
        while path >= 0 and not out[path]:
            out[path] = True
            path = paths.parent[path]
    return out


def text_of(found: list[tuple[int, str, int]], paths: Paths, ranked: list[bytes]) -> str:
    """Blocks of the containers on the first of the ranked paths that the page has; without one, on its own best path."""
    if not found:
        return ""
    have = {paths.key[k]: k for k, x in enumerate(present(found, paths)) if x}
    chosen = next((have[key] for key in ranked if key in have), None)
    if chosen is None:
        chosen = best_path(found, paths)[0]
    under = [False] * len(paths)
    for k in range(len(paths)):
        under[k] = k == chosen or (k > 0 and under[paths.parent[k]])
    return "\n".join(t for p, t, _ in found if under[p])


def _votes(batches):
    for batch in batches:
        hosts, keys, scores = [], [], []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            found, paths = blocks(page.as_py())
            vote = best_path(found, paths)
            if vote and vote[1] > 0:
                hosts.append(host), keys.append(paths.key[vote[0]]), scores.append(vote[1])
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.binary()), pa.array(scores, pa.float64())], ["host", "path", "score"])


def _present(batches):
    """(host, name, path) of the paths that a page has; ``name`` tells pages apart by their content."""
    for batch in batches:
        hosts, names, keys = [], [], []
        for host, name, page in zip(batch.column("host").to_pylist(), batch.column("name").to_pylist(), batch.column("html"), strict=True):
            found, paths = blocks(page.as_py())
            own = [paths.key[k] for k, x in enumerate(present(found, paths)) if x]
            hosts += [host] * len(own)
            names += [name] * len(own)
            keys += own
        for k in range(0, len(keys), 1 << 16):
            part = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(hosts[part], pa.string()), pa.array(names[part], pa.binary()), pa.array(keys[part], pa.binary())], ["host", "name", "path"])


def _texts(batches):
    for batch in batches:
        texts = [text_of(*blocks(page.as_py()), ranked or []) for page, ranked in zip(batch.column("html"), batch.column("paths").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, score): the voted paths of each host.  Scores are whole numbers, so that their sums don't hang on an order."""
    return pages.select("host", "html").mapInArrow(_votes, "host string, path binary, score double").groupBy("host", "path").agg(F.sum(F.round("score").cast("long")).alias("score"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", listed: int = 1000) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars.

    Null html is empty and gives an empty text; pages without a host in their url vote
    together.  Repeated pages vote and are extracted each; other columns are ignored.
    Pages of any length and depth are read whole.  Votes are summed before they are
    shuffled.  The paths of a host that has up to ``listed`` of them come to its pages as
    one ranked list, by a join that is a broadcast where the written table is under the
    session's threshold.  The pages of other hosts meet the votes path by path, and each
    content keeps its highest voted one: the same choice, without a list that grows.
    """
    bounded_batches(pages.sparkSession, 500)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), host.alias("host"))
    voted = kept(votes(rows), "votes")
    place = F.struct((-F.col("score")).alias("place"), "path")
    paths = lambda ranked: F.transform(ranked, lambda x: x["path"]).alias("paths")
    large = kept(voted.groupBy("host").count().where(F.col("count") > listed).select("host"), "hosts")
    short = voted if large.isEmpty() else voted.join(large, "host", "left_anti")
    # once written its size is known: a small table is broadcast, and pages are not moved
    lists = kept(short.groupBy("host").agg(paths(F.array_sort(F.collect_list(place)))), "paths")
    columns = "page_id long, url string, text string, n_chars long"
    if large.isEmpty():
        out = rows.join(lists, "host", "left").select("page_id", "url", "html", "paths").mapInArrow(_texts, columns)
        return holding(out, voted, large, lists)
    few = rows.join(large, "host", "left_anti").join(lists, "host", "left").select("page_id", "url", "html", "paths")
    many = rows.join(large, "host", "left_semi").withColumn("name", F.unhex(F.sha2("html", 256)))
    own = many.select("host", "name", "html").dropDuplicates(["host", "name"]).mapInArrow(_present, "host string, name binary, path binary")
    best = own.join(voted, ["host", "path"]).groupBy("host", "name").agg(F.array(F.min(place)["path"]).alias("paths"))
    many = many.join(kept(best, "best"), ["host", "name"], "left").select("page_id", "url", "html", "paths")
    return holding(few.unionByName(many).mapInArrow(_texts, columns), voted, large, lists)
