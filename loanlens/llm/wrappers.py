"""Main text of web pages by inferred wrappers.

A page's tokens are tags and texts.  What repeats side by side becomes a repeated group, so a page
has a short form.  The forms of one host are aligned one by one with the host's wrapper, a regular
expression without unions: equal tokens stay, texts that differ become slots, and what one side
lacks becomes optional, or part of the repeated group next to it.  Texts at a fixed place that are
the same on all of a host's pages belong to its template; the main text is what fills the slots of
the content region outside menus, notices, forms and the like.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import isqrt

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import stage, with_id
from loanlens.llm.url_filter import host_of

GROUP_PAGES = 500  # pages, then wrappers, that are aligned in one task
TEMPLATE_PAGES = 10  # a host with fewer pages proves no template text
PERIOD = 24  # tokens of a repeated group, at most

# Elements and the words in class, id and role that are not main text.
SILENT = frozenset("head title noscript template select option datalist canvas object iframe svg math audio video".split())
SIDE = frozenset("nav footer aside form button menu dialog label input fieldset".split())
SIDE_WORDS = frozenset(
    "nav navbar navigation menu header footer sidebar aside ad ads advert adverts advertisement advertising banner cookie cookies "
    "consent notice notices promo sponsor sponsored share sharing social related recommended comment comments discussion reply replies "
    "respond disqus newsletter subscribe signup login popup modal overlay breadcrumb breadcrumbs pagination pager toolbar masthead "
    "copyright legal disclaimer contentinfo complementary search widget".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub "
                   "sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<", re.DOTALL | re.IGNORECASE)
MARKS = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.IGNORECASE)
NAMES = re.compile(r"[a-z]+")
ODD = re.compile(r"[^a-z0-9:-]")

OPEN, CLOSE, GROUP, NAMED = 0xE000, 0xF0000, 0x100000, 30_000  # ranges of one-character names for tokens
LAST = {"<": 0xF8FF, ">": 0xFFFFD, "+": 0x10FFFD}
REPEATS = [re.compile("([\ue000-\uf8ff\U00100000-\U0010fffd].{%d})\\1+" % n, re.DOTALL) for n in range(PERIOD)]


class Page:
    """The tokens of a page: its form, and each text with where it stands."""

    __slots__ = ("tokens", "texts")

    def __init__(self, source: str):
        self.tokens: list[str] = []  # `<div.ad`, `>div` or `#` for a text
        self.texts: list[tuple[str, int, bool]] = []  # text, in a side part, in a main part
        stack: list[tuple[str, int, bool]] = []  # name, side (1: the header of an article, 2: another), main
        open_names: Counter[str] = Counter()
        side, main = 0, False
        for m in TOKEN.finditer(source):
            name = m[3]
            if name is None:
                part = m[0]
                if part[0] != "<" or part == "<":
                    if part.strip():
                        self.tokens.append("#")
                        self.texts.append((part, side, main))
                continue
            name = ODD.sub("_", name.lower())
            if m[2]:
                if open_names[name]:  # what fits nothing that is open is passed over
                    while True:
                        closed = stack.pop()[0]
                        open_names[closed] -= 1
                        if closed == name:
                            break
                    side, main = stack[-1][1:] if stack else (0, False)
                self.tokens.append(">" + name)
                continue
            marks = ""
            drop = 2 if name in SIDE or name in SILENT else 0 if name != "header" else 1 if main else 2
            if m[4]:
                words = [w for a in MARKS.finditer(m[4]) for w in NAMES.findall((a[2] or a[3] or a[4] or "").lower())]
                marks = ".".join(["", *words])
                if not SIDE_WORDS.isdisjoint(words) and name not in MAIN and name not in ("body", "header") or HIDDEN.search(m[4]):
                    drop = 2
            self.tokens.append("<" + name + marks)
            if name in VOID or m[4].endswith("/"):
                continue
            if name in MAIN and not _comment(marks):
                side, main = 0, True  # an element that was never closed does not swallow the article
            elif side == 1 and name in HEADINGS:
                side = 0
            else:
                side = max(side, drop)
            stack.append((name, side, main))
            open_names[name] += 1

    def form(self, names: "Names") -> tuple[str, list[int]]:
        """One character per token, groups that repeat side by side folded into one, and how many
        texts each of the characters stands for."""
        now, before = "".join(map(names.of, self.tokens)), None
        texts = [int(t == "#") for t in self.tokens]
        while now != before:
            before = now
            for repeat in REPEATS:  # the shortest groups first, so that they fold within longer ones
                out, counts, at = [], [], 0
                for m in repeat.finditer(now):
                    start, end = m.span()
                    out += [now[at:start], names.group(m[1])]
                    counts += [*texts[at:start], sum(texts[start:end])]
                    at = end
                if at:
                    now, texts = "".join([*out, now[at:]]), counts + texts[at:]
        return now, texts


def _comment(marks: str) -> bool:
    return not SIDE_WORDS.isdisjoint(marks.split("."))


class Names:
    """One-character names of tokens and groups, and back.

    A page with more kinds of tokens than there are characters has one more kind for all others of a
    sort; this can only make its form coarser, no text goes.
    """

    def __init__(self):
        self.known: dict[str, str] = {"#": "#", "<*": chr(OPEN), ">*": chr(CLOSE), "+(*)": chr(GROUP)}
        self.back: dict[str, str] = {c: token for token, c in self.known.items()}
        self.next = {"<": OPEN + 1, ">": CLOSE + 1, "+": GROUP + 1}

    def of(self, token: str) -> str:
        c = self.known.get(token)
        if c is None:
            token_range = token[0]
            if token_range == "<" and self.next["<"] > LAST["<"]:
                token_range = "+"  # more kinds of tags than there are characters in the first range
            if self.next[token_range] > LAST[token_range]:
                return self.known["+(*)" if token[0] == "+" else token[0] + "*"]
            c = chr(self.next[token_range])
            self.next[token_range] += 1
            self.known[token], self.back[c] = c, token
        return c

    def group(self, body: str) -> str:
        return self.of("+(" + "".join(self.spell(c) for c in body) + ")")

    def spell(self, c: str) -> str:
        return self.back[c]

    def full(self) -> bool:
        """Time for a new set of names; pages told apart by forms must share one."""
        return len(self.known) > NAMED


# A wrapper is a list of items [token, text, optional]; a token `+(...)` is a repeated group, and the
# text of `#` is a hash of what all pages have there, or null for a slot.


def page_items(page: Page, form: str, counts: list[int], names: Names) -> list[list]:
    """The page as a wrapper of its own; texts within groups have no fixed place and are left out."""
    items, at = [], 0
    for c, n in zip(form, counts, strict=True):
        items.append([names.spell(c), _plain(page.texts[at][0]) if c == "#" else None, False])
        at += n
    return items


def matching(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """Blocks (place in a, place in b, length) of equal tokens, in order.

    Equal ends go first, then tokens that occur once in both lists hold the lists together, in the
    longest row that rises in both; of what lies between, of any length, the longest common row of
    tokens is equal.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [(0, 0, head)] if head else []
    low, high = (head, head), (len(a) - tail, len(b) - tail)
    once = Counter(a[low[0] : high[0]]), Counter(b[low[1] : high[1]])
    at = {t: k for k, t in enumerate(b[low[1] : high[1]], low[1]) if once[0][t] == once[1][t] == 1}
    anchors = _rising([(i, at[t]) for i, t in enumerate(a[low[0] : high[0]], low[0]) if t in at])
    i, j = low
    for x, y in [*anchors, high]:
        if i < x and j < y:
            out += [(i + p, j + q, n) for p, q, n in _common(a[i:x], b[j:y])]
        if (x, y) != high:
            out.append((x, y, 1))
        i, j = x + 1, y + 1
    return [*out, (*high, tail)] if tail else out


def _common(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """Blocks of a longest common subsequence.

    A number's bits hold a row of the table of lengths, one bit per token of `a` (Hyyrö, "Bit-parallel
    LCS-length computation revisited", AWOCA 2004): 0 where the length grows.  Rows are kept in steps
    of the root of their number; those between are worked out again on the way back, so two pages of
    100,000 tokens take some 10 MB.
    """
    places: dict[str, int] = {}
    for i, token in enumerate(a):
        places[token] = places.get(token, 0) | 1 << i
    full, step = (1 << len(a)) - 1, max(1, isqrt(len(b)))

    def rows(v: int, start: int, end: int) -> Iterator[int]:
        for token in b[start:end]:
            u = v & places.get(token, 0)
            v = ((v + u) | (v - u)) & full
            yield v

    kept = [full]  # the row before every step-th token
    for start in range(0, len(b), step):
        v = kept[-1]
        for v in rows(v, start, start + step):
            pass
        kept.append(v)
    out: list[tuple[int, int, int]] = []
    x, y = len(a), len(b)
    while x and y:
        start = (y - 1) // step * step
        held = [r.to_bytes(len(a) // 8 + 1, "little") for r in (kept[start // step], *rows(kept[start // step], start, y))]
        while x and y > start:
            if held[y - start][(x - 1) >> 3] >> (x - 1 & 7) & 1:
                x -= 1
            elif held[y - start - 1][(x - 1) >> 3] >> (x - 1 & 7) & 1:
                x, y = x - 1, y - 1
                if out and out[-1][:2] == (x + 1, y + 1):
                    out[-1] = (x, y, out[-1][2] + 1)
                else:
                    out.append((x, y, 1))
            else:
                y -= 1
    return out[::-1]


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest row of pairs whose second numbers rise, too."""
    ends: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, y) in enumerate(pairs):
        n = bisect_left(ends, y)
        if n == len(ends):
            ends.append(y)
            last.append(k)
        else:
            ends[n], last[n] = y, k
        before[k] = last[n - 1] if n else -1
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(wrapper: list[list], other: list[list]) -> list[list]:
    """The wrapper of both: equal tokens stay, differing texts become slots, the rest optional."""
    a, b = [i[0] for i in wrapper], [i[0] for i in other]
    out: list[list] = []
    i = k = 0
    for x, y, n in [*matching(a, b), (len(a), len(b), 0)]:
        out += [[w[0], w[1], True] for w in wrapper[i:x]] + [[o[0], o[1], True] for o in other[k:y]]
        out += [[w[0], w[1] if w[1] == o[1] else None, w[2] or o[2]] for w, o in zip(wrapper[x : x + n], other[y : y + n], strict=True)]
        i, k = x + n, y + n
    return _absorb(out)


def _absorb(items: list[list]) -> list[list]:
    """Drop an optional run that the repeated group next to it covers already."""
    at = 0
    while at < len(items):
        token = items[at][0]
        if token[0] == "+":
            body = re.findall(r"\+\([^()]*\)|[<>#][^<>#()+]*", token[2:-1])
            n = len(body)
            for start in (at + 1, at - n):
                run = items[max(start, 0) : start + n]
                if start >= 0 and len(run) == n and all(x[2] and x[0] == y for x, y in zip(run, body, strict=True)):
                    del items[start : start + n]
                    at -= n * (start < at)
        at += 1
    return items


def _plain(text: str) -> str:
    return xxhash.xxh64_hexdigest(" ".join(html.unescape(text).split()).encode("utf-8", "surrogatepass"))


def _fold_wrappers(wrappers: list[tuple[str, int]]) -> tuple[str, int]:
    """Align wrappers of one host, those of many pages first."""
    order = sorted(wrappers, key=lambda w: (-w[1], w[0]))
    now = json.loads(order[0][0])
    for w, _ in order[1:]:
        now = align(now, json.loads(w))
    return json.dumps(now, ensure_ascii=False), sum(n for _, n in order)


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """One wrapper per host: host, wrapper (JSON), n_pages.  All pages take part.

    Groups of about GROUP_PAGES pages of one host are aligned in a task each; their wrappers are
    then aligned in groups in the same way, until there is one per host.  So a host with a third of
    all pages meets in no task.
    """
    rows = pages.where("html is not null and html != ''").select(host_of(F.col("url")).alias("host"), "html")

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pages of equal form on a host become one wrapper where they stand."""
        names, turn = Names(), 0
        for b in batches:
            met: dict[tuple[str, int, str], tuple[list, int]] = {}
            for host, source in zip(b["host"], b["html"], strict=True):
                if names.full():
                    names, turn = Names(), turn + 1
                page = Page(source)
                form, counts = page.form(names)
                items = page_items(page, form, counts, names)
                old = met.get((host, turn, form))
                if old:
                    for x, y in zip(old[0], items, strict=True):
                        if x[1] != y[1]:
                            x[1] = None
                    met[host, turn, form] = (old[0], old[1] + 1)
                else:
                    met[host, turn, form] = (items, 1)
            if met:
                by_host: dict[str, list] = {}
                for (host, _, _), (items, n) in met.items():
                    by_host.setdefault(host, []).append((json.dumps(items, ensure_ascii=False), n))
                folded = {host: _fold_wrappers(w) for host, w in by_host.items()}
                yield pd.DataFrame({"host": list(folded), "wrapper": [w for w, _ in folded.values()], "n_pages": [n for _, n in folded.values()]})

    def merge(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        wrapper, n = _fold_wrappers(list(zip(b["wrapper"], b["n_pages"].tolist(), strict=True)))
        return pd.DataFrame({"host": [key[0]], "wrapper": [wrapper], "n_pages": [n]})

    fields = "host string, wrapper string, n_pages long"
    now = stage(rows.mapInPandas(local, fields))
    while True:
        most = now.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return now
        groups = -(-most // GROUP_PAGES)
        dealt = now.withColumn("g", F.pmod(F.xxhash64("wrapper", "n_pages"), F.lit(groups)) if groups > 1 else F.lit(0))
        now = stage(dealt.groupBy("host", "g").applyInPandas(merge, fields))


def template_texts(wrapper: list[list], n_pages: int) -> set[int]:
    """Which items of the wrapper are template texts: the same on every page of a host whose pages differ."""
    texts = [k for k, i in enumerate(wrapper) if i[0] == "#"]
    fixed = {k for k in texts if wrapper[k][1] is not None and not wrapper[k][2]}
    varied = len(fixed) < len(texts) or any(i[0][0] == "+" for i in wrapper)
    return fixed if n_pages >= TEMPLATE_PAGES and varied else set()


def _template_places(form: list[str], wrapper: list[list], fixed: set[int]) -> set[int]:
    """Where the wrapper's template texts stand in a page's form."""
    places = set()
    if fixed:
        for a, b, n in matching(form, [i[0] for i in wrapper]):
            places |= {a + d for d in range(n) if b + d in fixed}
    return places


def main_text(page: Page, names: Names, wrapper: list[list], fixed: set[int], places: dict) -> str:
    """The texts of the main part, or of the whole page where none is marked, without side parts and,
    where none is marked, without template texts; character references decoded, white space made one space."""
    skip: set[int] = set()
    has_main = any(t[2] and not t[1] for t in page.texts)
    if fixed and not has_main:  # a marked part is the article, also where its heading is that of other pages
        form, counts = page.form(names)
        if form not in places:
            places[form] = _template_places([names.spell(c) for c in form], wrapper, fixed)
        at = 0
        for k, n in enumerate(counts):
            if k in places[form]:
                skip.add(at)
            at += n
    out, at = [], 0
    for token in page.tokens:
        if token != "#":
            name = token[1:].split(".", 1)[0]
            if name not in INLINE:
                out.append(" ")
            continue
        text, side, main = page.texts[at]
        if not side and at not in skip and (main or not has_main):
            out.append(html.unescape(text))
        at += 1
    return " ".join("".join(out).split())


def extract_text(pages: DataFrame) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars (code points).

    Null and empty html give an empty text; null urls count as one host without a name; pages of
    hosts with few pages rely on tags alone; malformed markup is read as far as it goes; repeated
    rows are answered each.  Other columns are not looked at; no rows give no rows.
    """
    wrappers = stage(infer_wrappers(pages)).withColumnRenamed("host", "of")
    rows = with_id(pages, "page_id", "url", "html", host_of(F.col("url")).alias("host"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = Names()
        known: dict[str | None, tuple] = {}
        for b in batches:
            out = []
            for host, source, wrapper, n in zip(b["host"], b["html"], b["wrapper"], b["n_pages"], strict=True):
                if not source:
                    out.append("")
                    continue
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    items = json.loads(wrapper)
                    known[host] = (items, template_texts(items, int(n)), {})
                if names.full():
                    names = Names()
                    known = {h: (items, fixed, {}) for h, (items, fixed, _) in known.items()}
                page = Page(source)
                items, fixed, places = known[host]
                out.append(main_text(page, names, items, fixed, places))
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": out, "n_chars": [len(t) for t in out]})

    joined = rows.join(wrappers, rows["host"] == wrappers["of"], "left").select("page_id", "url", "html", "host", "wrapper", "n_pages")
    return joined.mapInPandas(run, "page_id string, url string, text string, n_chars long").withColumn("page_id", F.col("page_id").cast("long"))
