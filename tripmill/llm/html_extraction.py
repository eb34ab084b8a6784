"""Main text of web pages as the maximum-scoring subsequence of their tokens (after Pasternack and Roth, 2009).

1. One scan cuts a page into words and tags. Comments, scripts, styles and other raw elements are no text. An open-element stack follows
   the rules for omitted end tags, so unclosed paragraphs and list items do no harm.
2. Elements that call themselves menu, header, footer, sidebar, notice, advert, form or reader comments, by tag, role, class or id, are cut
   out with all they hold.
3. What is left is scored: a word by its block's tag and length, links around it, and whether it lies in the page's article or main
   element if there is one; a tag by its name, never above zero. The weights are log-odds from labelled pages: those of
   ``labelled_pages`` and, at most ``sample`` of them, pages of the table that mark their article.
4. One linear scan finds the contiguous region with the highest sum; its text is the result.

Blocks are what block-level tags enclose or separate; a line break or table cell is no more than white space or a boundary. Character
references are decoded as HTML5 does. White space is what Unicode calls so, no-break spaces included. Empty blocks give no line.

Null and empty pages, and pages without any word of positive score, have the text "" and 0 characters. Pages that are cut short keep
what they have; an unfinished tag is dropped. Rows that repeat a page_id, or have none, are returned each. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from html import unescape
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_slices, table
from .labelled_pages import PAGES

#: A tag with quoted values, the start of a comment or declaration, or that of a tag without end; LOOSE knows no quotes.
TOKEN = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=|["'])*+)>|!--|[!?/a-zA-Z])""")
LOOSE = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|!--|[!?/a-zA-Z])")
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.IGNORECASE)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

RAW = frozenset("script style title noscript template iframe noembed noframes xmp textarea svg".split())
RAW_END = {name: re.compile(f"</{name}", re.IGNORECASE) for name in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Which open elements a start tag ends, and where the search for them stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "a": ({"a"}, BLOCK)}
NO_P_END = frozenset("html body td th caption table button object".split())

ALWAYS_OUT = frozenset("nav aside footer menu dialog button select datalist search audio video canvas map".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form tablist".split())
COMMENTS = frozenset("comment comments commentlist disqus respond replies reply".split())
#: Names of classes and ids that say what an element is.
CUES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner breadcrumb breadcrumbs colophon consent cookie cookies copyright dropdown footer footers gdpr header "
    "login masthead menu menus modal nav navbar navigation newsletter notice notices notification notifications alert overlay pager pagination paywall popup promo promos promoted promotion recommended "
    "recommendations related rail search share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription toolbar topbar trending".split()
) | COMMENTS
#: A name after one of these says what an element has or had, not what it is.
OTHERS = frozenset("has have with without no not open opened closed enable enabled disable disabled show hide below above after before".split())
HINTS = frozenset("article body content entry main page post story text".split())

IN, OUT, NONE = "in", "out", "none"


class Page:
    """A parsed page: ``items`` in order, each (tag name, None, block, element, mark) or (None, text, block, element, mark), and its elements."""

    def __init__(self, html: str):
        self.items: list[tuple] = []
        self.names, self.parents, self.kinds, self.hints, self.linked, self.words, self.headed = ["html"], [-1], [""], [False], [False], [0], [False]
        self.block_tags = ["html"]
        self._parse(html)
        self._choose()

    def _parse(self, html: str) -> None:
        stack, open_, at, block, mark, pattern = [0], Counter(), 0, 0, False, TOKEN
        items, names = self.items, self.names
        while True:
            m = pattern.search(html, at)
            text = html[at : m.start() if m else len(html)]
            if text:
                items.append((None, text, block, stack[-1], mark))
            if not m:
                break
            name = m[2]
            if name is None and m[0][1:2].isalpha() or m[0] == "</" and html[m.end() : m.end() + 1].isalpha():
                if pattern is LOOSE:  # an unfinished tag at the end
                    break
                at, pattern = m.start(), LOOSE  # quotes don't match up, here or further on
                continue
            if m[0] == "<!--":
                end = html.find("-->", m.end())
                at = end + 3 if end >= 0 else len(html)
                mark = {"<!--main-->": True, "<!--/main-->": False}.get(html[m.start() : at], mark)
                continue
            if name is None:  # a declaration, an instruction or a nameless end tag
                end = html.find(">", m.end())
                at = end + 1 if end >= 0 else len(html)
                continue
            at, name, closing, attributes = m.end(), name.lower(), bool(m[1]), m[3]
            if name in BLOCK:
                block += 1
                self.block_tags.append("after" if closing else name)
            if closing:
                self._end(name, stack, open_)
                items.append((name, None, block, stack[-1], mark))
                continue
            if name in RAW:
                end = RAW_END[name].search(html, at)
                at = end.start() if end else len(html)
                continue
            if name == "br":
                items.append((None, " ", block, stack[-1], mark))
            if name in VOID:
                items.append((name, None, block, stack[-1], mark))
                continue
            self._end_implied(name, stack, open_)
            items.append((name, None, block, stack[-1], mark))
            if name in BLOCK or name in ("a", "button", "select") or open_[name] or (attributes and ATTRIBUTE.search(attributes)):
                kind, hint = self._kind(name, attributes)
                parent = stack[-1]
                names.append(name), self.parents.append(parent), self.kinds.append(kind), self.words.append(0), self.headed.append(name in HEADINGS)
                self.hints.append(hint or self.hints[parent]), self.linked.append(name == "a" or self.linked[parent])
                stack.append(len(names) - 1)
                open_[name] += 1

    def _end(self, name: str, stack: list[int], open_: Counter) -> None:
        """An end tag closes the nearest open element of its name; one of a block closes all within, others stop at blocks."""
        if not open_[name]:
            return
        names, i = self.names, len(stack) - 1
        while names[stack[i]] != name:
            if name not in BLOCK and names[stack[i]] in BLOCK:
                return
            i -= 1
        for e in stack[i:]:
            open_[names[e]] -= 1
        del stack[i:]

    def _end_implied(self, name: str, stack: list[int], open_: Counter) -> None:
        names = self.names
        wanted, stops = ({"p"}, NO_P_END) if name in BLOCK and open_["p"] else (set(), NO_P_END)
        for targets, until in ((wanted, stops), ENDS.get(name, (set(), set()))):
            if not any(open_[t] for t in targets):
                continue
            for i in range(len(stack) - 1, 0, -1):
                here = names[stack[i]]
                if here in targets:
                    for e in stack[i:]:
                        open_[names[e]] -= 1
                    del stack[i:]
                    break
                if here in until or (targets == {"p"} and here in BLOCK):
                    break

    def _kind(self, name: str, attributes: str) -> tuple[str, bool]:
        """always, comments, cue, header, nested or nothing; whether names hint at content."""
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
        role, kind, hint = found.get("role", "").lower(), "", found.get("itemprop") == "articleBody"
        for value in f"{found.get('class', '')} {found.get('id', '')}".split():
            parts = [p.lower() for p in NAME.findall(value)]
            hint = hint or any(p in HINTS for p in parts)
            if OTHERS.isdisjoint(parts):
                if not COMMENTS.isdisjoint(parts):
                    kind = "comments"
                elif kind in ("", "header") and not CUES.isdisjoint(parts):
                    kind = "header" if CUES.isdisjoint(set(parts) - {"header"}) else "cue"
        if name in ("html", "body", "main") or role == "main":
            return ("main" if name == "main" or role == "main" else ""), hint
        if name in ALWAYS_OUT or role in OUT_ROLES:
            return "always", hint
        if name == "header":
            return "header", hint
        if name == "form":
            return kind or "cue", hint
        return kind or ("article" if name == "article" else ""), hint

    def _choose(self) -> None:
        """Which elements are out, and the one that holds the article, if any."""
        n = len(self.names)
        self.counts = [len(t.split()) if t else 0 for _, t, *_ in self.items]
        for (_, _, _, e, _), words in zip(self.items, self.counts):
            self.words[e] += words
        for e in range(n - 1, 0, -1):
            self.words[self.parents[e]] += self.words[e]
            self.headed[self.parents[e]] = self.headed[self.parents[e]] or self.headed[e]
        whole, holds = self.words[0], [k in ("article", "main") for k in self.kinds]
        navs = [name == "nav" for name in self.names]
        for e in range(n - 1, 0, -1):
            holds[self.parents[e]] = holds[self.parents[e]] or holds[e]
            navs[self.parents[e]] = navs[self.parents[e]] or navs[e]
        out, inner = [False] * n, [False] * n
        for e in range(1, n):
            parent, kind = self.parents[e], self.kinds[e]
            inner[e] = inner[parent] or kind in ("article", "main")
            if out[parent] or kind == "always":
                out[e] = True
            elif kind == "comments":
                out[e] = not holds[e] or inner[parent]
            elif kind == "cue":  # a wrapper of nearly all of the page is none
                out[e] = not holds[e] and (2 * self.words[e] <= whole or inner[parent])
            elif kind == "header":
                out[e] = not self.headed[e] or navs[e] or not (inner[parent] or self.hints[parent])
        own = [0] * n
        for (_, _, _, e, _), words in zip(self.items, self.counts):
            own[e] += 0 if out[e] else words
        for e in range(n - 1, 0, -1):
            own[self.parents[e]] += own[e]
        pick = lambda kind: max((e for e in range(n) if self.kinds[e] == kind and not out[e]), key=lambda e: (own[e], -e), default=0)
        article, main = pick("article"), pick("main")
        chosen = main if main and (not article or own[main] > 2 * own[article]) else article
        self.chosen = chosen if chosen and own[chosen] and 4 * own[chosen] >= own[0] else 0
        self.place = [NONE if not self.chosen else OUT] * n
        for e in range(1, n):
            if e == self.chosen or self.place[self.parents[e]] == IN:
                self.place[e] = IN
                if self.kinds[e] == "article" and self.names[self.chosen] == "article" and e != self.chosen:
                    out[e] = True
            out[e] = out[e] or out[self.parents[e]]
        self.out = out
        self.sizes: Counter = Counter()
        for (_, _, block, e, _), words in zip(self.items, self.counts):
            if not out[e]:
                self.sizes[block] += words

    def features(self, i: int, placed: bool = True) -> tuple[str, ...]:
        """What a word's or tag's score depends on; not ``placed``: as if the page marked no article."""
        name, _, block, e, _ = self.items[i]
        place = self.place[e] if placed else NONE
        if name:
            return (f"tag {name}" if name in BLOCK or name in VOID or name in ("a", "b", "i", "em", "strong", "span") else "tag other", f"tag {place}")
        if place == IN:  # by that alone: nothing of the article is lost at its ends
            return (f"place {IN}", "any word")
        size = self.sizes[block]
        return (f"place {place}", f"block {self.block_tags[block]} {min(3, size.bit_length() // 2)}", f"link {self.linked[e]}", f"hint {self.hints[e]}", "any word")

    def scored(self, weights: dict[str, float]) -> list[float]:
        """A score for every item: words of a piece of text count together, since all score alike."""
        out = []
        for i, (name, _, _, e, _) in enumerate(self.items):
            if self.out[e] or (name is None and not self.counts[i]):
                out.append(0.0)
            elif name:
                out.append(min(-0.01, sum(weights.get(f, -0.2) for f in self.features(i))))
            else:
                out.append(self.counts[i] * sum(weights.get(f, 0.0) for f in self.features(i)))
        return out

    def text(self, start: int, end: int) -> str:
        lines: list[str] = []
        held: list[str] = []
        last = None
        for name, text, block, e, _ in self.items[start:end]:
            if block != last:
                lines.append(" ".join(unescape("".join(held)).split()))
                held, last = [], block
            if name is None and not self.out[e]:
                held.append(text)
        lines.append(" ".join(unescape("".join(held)).split()))
        return "\n".join(line for line in lines if line)


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous region with the highest sum, the first of equal ones; empty if no score is positive."""
    best, region, run, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += score
        if run > best:
            best, region = run, (start, i + 1)
    return region


def tally(pages: Iterable[str | None], marked: bool) -> Counter:
    """How many words and tags with each feature lie inside (feature, True) and outside of the main text.

    marked: the text lies between <!--main--> and <!--/main-->; else in the article that the page marks, and features of the place are left out.
    """
    counts: Counter = Counter()
    for html in pages:
        page = Page(html or "")
        if not marked and not page.chosen:
            continue
        for i, (name, _, _, e, mark) in enumerate(page.items):
            if page.out[e]:
                continue
            main = mark if marked else page.place[e] == IN
            for f in page.features(i, marked):
                if marked or not f.endswith(f" {NONE}"):
                    counts[f, main] += 1 if name else page.counts[i]
            counts[("all tags" if name else "all words"), main] += 1 if name else page.counts[i]
    return counts


def log_odds(counts: Counter, most: float = 6.0) -> dict[str, float]:
    out = {}
    for f in {f for f, _ in counts} - {"all tags", "all words"}:
        whole = "all tags" if f.startswith("tag ") else "all words"
        inside, outside = counts[f, True], counts[f, False]
        odds = log((inside + 1) / (outside + 1))
        if f != "any word":  # relative to all words or tags
            odds -= log((counts[whole, True] + 1) / (counts[whole, False] + 1))
        out[f] = max(-most, min(most, odds))
    return out


def weights_of(pages: DataFrame, *, sample: int = 500, share: float = 0.5) -> dict[str, float]:
    """Weights from the labelled pages and from at most ``sample`` pages of the table (the smallest by hash) that mark their article.

    Only pages whose hash lies in the share that holds about four times the sample are looked at, so few rows meet in the last sort.
    Counts of the table are scaled to at most ``share`` of those of the labelled pages, since such pages are labelled by their markup only.
    """
    among = min(1.0, 4 * sample / max(1, pages.count()))
    hashed = pages.select("html", F.xxhash64("page_id", "url", "html").alias("h"))
    some = hashed.where(F.shiftrightunsigned("h", 33) < int(among * 2**31)).where(F.contains("html", F.lit("<article"))).orderBy("h", "html").limit(sample).select("html")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for whole in batches:
            for batch in small_slices(whole, "html"):
                counts += tally(batch.column(0).to_pylist(), False)
        rows = [(f, main, n) for (f, main), n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.bool_(), pa.int64()))], names=["feature", "main", "n"])

    hand = tally(PAGES, True)
    found = Counter({(f, main): n for f, main, n in some.mapInArrow(count, "feature string, main boolean, n long").groupBy("feature", "main").agg(F.sum("n")).collect()})
    words = lambda c: c["all words", True] + c["all words", False]
    scale = min(1.0, share * words(hand) / max(1, words(found)))
    return log_odds(hand + Counter({k: n * scale for k, n in found.items()}))


def main_text(html: str | None, weights: dict[str, float]) -> str:
    if not html:
        return ""
    page = Page(html)
    return page.text(*best_region(page.scored(weights)))


def extract(pages: DataFrame, weights: dict[str, float] | None = None, **options) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""
    weights = weights_of(pages, **options) if weights is None else weights
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_slices(whole, "html"):
                found = [main_text(html, weights) for html in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(texts, "page_id long, url string, text string, n_chars long")


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


#: The tables' pages all mark their article and put nothing else into it, so plain patterns give its text.
SQL = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)</article>', 1), '(?s)<!--.*?-->', '', 'g') AS a FROM pages),
b AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(a, '<br ?/?>', ' ', 'g'), '</?(?:h[1-6]|p|div|ul|ol|li)(?: [^>]*)?>', chr(1), 'g'), chr(1)) AS b FROM a),
t AS (
  SELECT page_id, url, list_filter(list_transform(b, lambda x: trim(regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'),
    '\s+', ' ', 'g'))), lambda x: x <> '') AS t FROM b)
SELECT page_id, url, array_to_string(t, chr(10)) AS text, CAST(length(array_to_string(t, chr(10))) AS BIGINT) AS n_chars FROM t
"""
QUERIES = {"op12_html_extraction": op12_html_extraction}
ORACLES = {"op12_html_extraction": SQL}
