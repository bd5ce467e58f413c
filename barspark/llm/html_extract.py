"""Main text of web pages by consensus: pages vote for a container path per host, then every page is extracted by the winner."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .url_filter import url_parts

#: What begins at a place: a comment, a tag (its name), another declaration, or text.
_TOKEN = re.compile(r"(<!--)|<(/?)([a-zA-Z][^\s/>]*)|(<[!?])|([^<]+|<)")
_QUOTE = re.compile("[\"'>]")
#: One attribute after the other, each with its whole value, so that no name is found within a value or another name.
_ATTR = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>"'][^\s>]*)))?""")
RAW = frozenset("script style noscript template textarea svg math iframe object audio video canvas title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article main section div td body".split())
BLOCKS = CONTAINERS | frozenset("html head p ul ol li dl dt dd table thead tbody tfoot tr th caption h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption header footer nav aside form fieldset address details summary hgroup menu dialog search".split())
CHROME = frozenset("head nav aside footer form menu dialog search button select".split())
#: Words of a class, id or role that mark what is not the article, if the name has no others but those of its place or form.
CHROME_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice popup promo promotion related replies reply search share sharing sidebar social sponsor sponsored subscribe toolbar".split())
PLACE_WORDS = frozenset("area article articles bar block bottom box button buttons col column container count desktop entry field fields first fixed form g global head header icon icons inner item items js large last left link links list main mega mini mobile module my outer page panel post posts primary region right row secondary section side signup site slot small sticky sub thread toggle top unit upper user view widget widgets wrap wrapper zone".split())
CONTENT_WORDS = frozenset("article body content entry main post story text".split())
_WORDS = re.compile(r"[A-Za-z]+")
_DIGITS = re.compile(r"\d+")
#: A host's path gives way to the page's own best container if it holds less than this share of the page's unlinked text, and the
#: latter this many characters: a paragraph that isn't chance.
LITTLE, PARAGRAPH = 1 / 20, 200


def attributes(tag: str) -> dict[str, str]:
    """The attributes of a start tag by lower-cased name; the first of a name counts."""
    out: dict[str, str] = {}
    for name, *value in _ATTR.findall(tag):
        out.setdefault(name.lower(), "".join(value))
    return out


def is_hidden(a: dict[str, str]) -> bool:
    return "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")) is not None


def is_chrome(name: str) -> bool:
    """Whether one class, id or role names what is not the article: 'site-footer' does, 'has-sidebar' or 'social-policy' doesn't."""
    words = {w.lower() for w in _WORDS.findall(name)}
    return bool(words & CHROME_WORDS) and words <= CHROME_WORDS | PLACE_WORDS


def _hash(path: str) -> int:
    return xxhash.xxh3_64_intdigest(path) - (1 << 63)


def _worth(text: str, linked: int) -> int:
    return max(0, len(text) - 2 * linked)


class Tags:
    """Finds where tags end, outside their quotes; a page is read once, however many quotes stay open."""

    def __init__(self, html: str):
        self.html, self.dead, self.last = html, set(), html.rfind(">")

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends the tag whose name ends at ``at``: the first outside quotes, else the first; -1 without any."""
        seen, p = [], at
        while (m := _QUOTE.search(self.html, p)) and m.start() not in self.dead:
            if m[0] == ">":
                return m.start()
            seen.append(m.start())
            p = self.html.find(m[0], m.end()) + 1
            if not p:
                break
        self.dead.update(seen)  # from here, outside quotes, there is no end
        return self.html.find(">", at) if at <= self.last else -1


class Page:
    """The page's blocks of clean text, each with the container around it. Time and memory are linear in the page, however deep it nests.

    ``blocks``: (container number, text, characters in links); ``parent``, ``depth`` and ``weight`` (how much its kind looks like an article) of each
    container; ``paths``: a hash of its generalised path, numbers in classes as ``#``, None if it is hidden.

    Blocks that are chrome by name alone, and forms, are doubtful: they are hidden unless they hold most of the page's unlinked text (see ``_settle``)."""

    def __init__(self, html: str | None):
        self.blocks: list[tuple[int, str, int]] = []
        self.parent, self.depth, self.weight = [-1], [0], [0.5]
        self.paths: list[int | None] = [_hash("body")]
        self._read(html or "")

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int, bool, int]] = []  # tag, container number or -1, hidden from here on, doubtful block's number or -1
        open_: dict[str, int] = {}  # how many of a tag the stack holds
        inside = 0  # the container
        within = -1  # the doubtful block
        above: list[int] = []  # the one around each doubtful block
        around = [-1]  # the one around each container
        content = [False]  # containers that say they are the content, and all within
        held: list[int] = []  # the doubtful block around each block of text
        text: list[str] = []
        linked = links = hidden = semantic = at = 0
        tags = Tags(html)

        def flush() -> None:
            nonlocal linked
            if text:
                if line := " ".join("".join(text).split()):
                    self.blocks.append((inside, line, linked))
                    held.append(within)
                text.clear()
                linked = 0

        def close() -> str:
            nonlocal hidden, semantic, inside, within
            t, number, off, doubt = stack.pop()
            open_[t] -= 1
            hidden -= off
            semantic -= t in ("article", "main")
            if number >= 0:
                inside = self.parent[number]
            if doubt >= 0:
                within = above[doubt]
            return t

        while m := _TOKEN.match(html, at):
            at = m.end()
            words, tag, closing, rest = m[5], m[3], m[2], ""
            if m[1]:
                at = end + 3 if (end := html.find("-->", at)) >= 0 else len(html)
                continue
            if words is None:
                end = tags.end(at) if tag else html.find(">", at) if at <= tags.last else -1
                if end < 0:
                    at, words = m.start() + 1, "<"
                else:
                    rest, at = html[at:end], end + 1
            if words is not None:
                if not hidden:
                    words = entities.unescape(words)
                    text.append(words)
                    linked += len(words) if links else 0
                continue
            if not tag:
                continue
            tag = tag.lower()
            if tag in RAW and not closing:
                if not rest.endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
                    at = end.end() if end else len(html)
                continue
            if tag in VOID:
                if tag in ("br", "hr"):
                    flush()
                continue
            if tag == "a":
                links = 0 if closing else 1
                continue
            known = tag in BLOCKS or tag in CHROME
            if not known:  # of the others only hidden ones count, and what stands in them
                if closing:
                    if open_.get(tag):
                        if stack[-1][0] != tag:
                            flush()
                        while close() != tag:
                            pass
                elif not rest.endswith("/") and (open_.get(tag) or ("hidden" in rest or "display" in rest) and is_hidden(attributes(rest))):
                    off = is_hidden(attributes(rest))
                    stack.append((tag, -1, off, -1))
                    open_[tag] = open_.get(tag, 0) + 1
                    hidden += off
                continue
            flush()
            if not closing:
                a = attributes(rest) if rest else {}
                words = {w.lower() for k in ("class", "id", "role") if k in a for w in _WORDS.findall(a[k])}
                off = tag in CHROME and tag != "form" or tag == "header" and not semantic or is_hidden(a)
                number = doubt = -1
                if tag == "p" and stack and stack[-1][0] == "p":
                    close()
                if not hidden and not off and (tag == "form" or bool(words & CHROME_WORDS) and tag not in ("html", "body", "article", "main") and any(map(is_chrome, f"{a.get('class', '')} {a.get('id', '')} {a.get('role', '')}".split()))):
                    doubt = len(above)
                    above.append(within)
                    within = doubt
                if tag in CONTAINERS and tag != "body" and not hidden and not off:
                    number = len(self.paths)
                    named = ".".join([tag, *sorted(_DIGITS.sub("#", c) for c in a.get("class", "").split())])
                    self.paths.append(_hash(f"{self.paths[inside]}>{named}"))
                    self.parent.append(inside)
                    self.depth.append(self.depth[inside] + 1)
                    self.weight.append({"article": 1.5, "main": 1.4}.get(tag, 1.3 if words & CONTENT_WORDS else 1.0))
                    content.append(content[inside] or tag in ("article", "main") or bool(words & CONTENT_WORDS) and doubt < 0)
                    inside = number
                    around.append(within)
                stack.append((tag, number, off, doubt))
                open_[tag] = open_.get(tag, 0) + 1
                hidden += off
                semantic += tag in ("article", "main")
            elif open_.get(tag):
                while close() != tag:
                    pass
                links = 0
        flush()
        if above:
            self._settle(above, around, content, held)

    def _settle(self, above: list[int], around: list[int], content: list[bool], held: list[int]) -> None:
        """Hides the doubtful blocks, but for those with most of the page's unlinked text, if what stands in containers that
        say they are the content, outside the block and all other doubt, is less than a tenth of that."""
        n, total = len(above), 0
        of, plain = [0] * (n + 1), [0] * (n + 1)  # the last: outside all doubt
        for d, (inside, text, linked) in zip(held, self.blocks, strict=True):
            w = _worth(text, linked)
            total += w
            of[d] += w
            plain[d] += w if content[inside] else 0
        for d in range(n - 1, -1, -1):
            if above[d] >= 0:
                of[above[d]] += of[d]
        off, beside = [False] * (n + 1), [0] * (n + 1)
        for d in range(n):
            beside[d] = beside[above[d]] + plain[above[d]]
            off[d] = off[above[d]] or not (2 * of[d] > total and 10 * beside[d] < of[d])
        self.blocks = [b for b, d in zip(self.blocks, held, strict=True) if not off[d]]
        self.paths = [None if off[d] else p for p, d in zip(self.paths, around, strict=True)]

    def votes(self) -> list[tuple[int, int, int]]:
        """Every container path that holds text, best first: its hash, depth, and score in millionths, which is its share of unlinked text by the
        weight of its kind. Ties: the deeper, then the smaller hash."""
        score = [0.0] * len(self.parent)
        for inside, text, linked in self.blocks:
            score[inside] += _worth(text, linked)
        for c in range(len(score) - 1, 0, -1):
            score[self.parent[c]] += score[c]
        total, by = score[0], {}
        if not total:
            return []
        for path, depth, s, weight in zip(self.paths, self.depth, score, self.weight, strict=True):
            if s and path is not None:
                by[path, depth] = by.get((path, depth), 0.0) + s / total * weight
        return sorted(((p, d, round(1e6 * s)) for (p, d), s in by.items()), key=lambda x: (-x[2], -x[1], x[0]))

    def _within(self, path: int | None) -> list[bool]:
        """Which containers are at the path, or within one that is."""
        out: list[bool] = []
        for p, up in zip(self.paths, self.parent, strict=True):
            out.append(p is not None and p == path or up >= 0 and out[up])
        return out

    def text(self, path: int | None) -> str:
        """The blocks within the containers at ``path``; without such a container, or if it holds too little, within the page's own best one."""
        wanted = self._within(path)
        held = lambda some: sum(_worth(t, linked) for inside, t, linked in self.blocks if some is None or some[inside])
        if (not any(wanted) or held(wanted) < LITTLE * held(None)) and (own := self.votes()):
            best = self._within(own[0][0])
            if not any(wanted) or held(best) >= PARAGRAPH:
                wanted = best
        every = not any(wanted)
        return "\n".join(t for inside, t, _ in self.blocks if every or wanted[inside])


def _ballot(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        sums: dict[tuple[str, int, int], int] = {}
        for h, x in zip(f.host, f.html, strict=True):
            for p, depth, s in Page(x).votes():
                sums[h, p, depth] = sums.get((h, p, depth), 0) + s
        yield pd.DataFrame([(*k, s) for k, s in sums.items()], columns=["host", "path", "depth", "score"])


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(host, path)``: the hash of each host's container path with the most votes (ties: the deeper, then the smaller hash). Every path of a page votes.

    Votes are summed by host and path before they are shuffled by host, so a common host is no large group."""
    host = url_parts(F.col("__url"))[0]
    votes = pages.select(F.col(f"`{url_col}`").alias("__url"), F.col(f"`{html_col}`").alias("html")).select(host.alias("host"), "html")
    votes = votes.mapInPandas(_ballot, "host string, path long, depth long, score long").groupBy("host", "path", "depth").agg(F.sum("score").alias("score"))
    return votes.groupBy("host").agg(F.min_by("path", F.struct(-F.col("score"), -F.col("depth"), F.col("path"))).alias("path"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", small: int = 20_000) -> DataFrame:
    """One row per row of ``pages``: its id, url, main ``text`` and ``n_chars`` (code points).

    The text holds the blocks of the host's winning container, without menus, headers, footers, sidebars, notices, adverts,
    forms, scripts and comments; a block that is one of these by name only, or a form, stays if it holds most of the page's unlinked text. Null or empty html, and pages without text, give an empty text; a null or malformed url belongs to the host
    ''; repeated rows repeat; further columns are ignored. Up to ``small`` winning paths are broadcast; more are joined by host.
    """
    paths = materialize(host_paths(pages, url_col, html_col), "host-paths").withColumnRenamed("host", "__host")
    paths = F.broadcast(paths) if paths.count() <= small else paths
    p = pages.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{url_col}`").alias(url_col), F.col(f"`{url_col}`").alias("__url"), F.col(f"`{html_col}`").alias("html"))
    p = p.withColumn("__h", url_parts(F.col("__url"))[0]).join(paths, F.col("__h") == F.col("__host"), "left").select(F.col(id_col), F.col(url_col), "html", F.col("path").cast("string").alias("path"))
    kind = p.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({id_col: f[id_col], url_col: f[url_col], "text": [Page(h).text(None if pd.isna(w) else int(w)) for h, w in zip(f.html, f.path, strict=True)]})

    return p.mapInPandas(run, f"`{id_col}` {kind}, `{url_col}` string, text string").withColumn("n_chars", F.length("text").cast("long"))
