"""Main text of web pages by deduction of the site's template from equivalence classes.

Pages of a host come from templates that repeat. A page is read as tokens: tags with their place in the document tree,
and runs of text. Tokens of a host that occur the same number of times in the same pages share an occurrence vector
and form an equivalence class. Large and frequent classes whose tokens stand in one order in every page, and which
nest in one slot of another class without crossing it, make up the host's templates. What stands between template
tokens are the slots. Text of the template goes; slots are ranked by how much text they hold and how much it varies
between pages, and those far below the best, outside article or main elements, go too. Tags and names of elements
tell varying chrome (adverts, comments, forms) from the article, and serve hosts without a template.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: A template token occurs in at least so many pages of its host, and that share of them; its class has so many tokens.
#: The share bounds a host's templates to 1 / LEAST_SHARE times the tokens of an average page, however many its pages.
LEAST_PAGES, LEAST_SHARE, LEAST_CLASS = 3, 0.05, 4
#: Classes in this share of the host's pages are its main template. Others are those of some kinds of its pages if they
#: have tags and so many pages; else they are passages that articles share. Within article or main only the main one counts.
MAIN_SHARE, KIND_PAGES = 0.5, 10
#: Slots that hold less than this part of what the host's best slot does (characters times variation) are poor.
POOR = 0.05
#: Where less than this part of a page's text is outside elements with names of chrome, the names are not heeded.
LEAST_UNNAMED = 0.05
#: Where template text is more than this part of the text in article or main, the pages are copies, and it stays.
MOST_IN_MAIN = 0.5
#: Bytes of templates up to which they are broadcast to the pages.
BROADCAST_BYTES = 32 << 20

_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*"[^"]*+"|=\s*'[^']*+'|=)*+)(?:>|$)""", re.S)
_ATTRS = re.compile(r"""([^\s=\"'<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW = {"script", "style", "template", "noscript", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_HEADINGS = {"h1", "h2"}
_CHROME = {"header", "footer", "aside", "button", "select", "dialog", "menu", "head", "label", "legend"}
_CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar"}
#: Words that name chrome at the end of a class or id, or at its start if the rest are HOLDERS.
_NAMES = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promotions banner banners menu menus nav navbar navigation breadcrumb breadcrumbs "
    "sidebar aside footer header masthead cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing shares social related "
    "recommended recommendations comment comments commentlist respond disqus replies reply pagination pager toolbar widget widgets skip legal copyright".split()
)
#: More of them, within an article.
_NAMES_WITHIN = {"thread", "discussion", "responses", "reactions"}
_HOLDERS = set(
    "container wrapper wrap box bar block links link buttons button section area item items posts post list inner outer content body text group panel row col column unit slot top bottom "
    "left right form feed icons icon title heading sticky fixed mobile desktop primary secondary global wide small large".split()
)
_NEGATED = {"has", "with", "without", "no", "not", "is"}
_LAYOUTS = {"content", "main", "layout", "page", "body", "site"}
#: Start tags that close an open tag of the same group.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BLOCKS_END_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}

#: What holds a token: chrome by tag, a form, chrome by name, article or main, a heading, nav, a heading of the first level.
STRONG, FORM, NAMED, MAIN, HEADING, NAV, TITLE = 1, 2, 4, 8, 16, 32, 64
#: Kinds of tokens: text, tags within a line, line breaks, other tags.
TEXT, INLINE, BREAK, BLOCK = range(4)


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; '' for null or without one."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _hash(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x) - (1 << 63)


def names_chrome(value: str, within: bool = False) -> bool:
    """Whether one of the names in a class or id attribute is that of chrome."""
    for name in value.lower().split():
        parts = [p.rstrip("0123456789") for p in re.split(r"[-_]+", name)]
        parts = [p for p in parts if p]
        if not parts or parts[0] in _NEGATED or parts[-1] == "sidebar" and parts[0] in _LAYOUTS:
            continue
        words = _NAMES | _NAMES_WITHIN if within else _NAMES
        if parts[-1] in words or parts[0] in words and all(p in _HOLDERS or p in words for p in parts[1:]):
            return True
    return False


def _held(tag: str, attrs: str, up: int) -> int:
    """Flags of an element's contents, from its tag and those of what holds it."""
    if tag == "main":
        return MAIN
    if tag == "article" and not up & (STRONG | NAMED):
        return MAIN
    own = up | (HEADING if tag in _HEADINGS else 0) | (TITLE if tag == "h1" else 0)
    if tag == "nav":
        own |= NAV
    elif tag == "form":
        own |= FORM
    elif tag in _CHROME and not (tag == "header" and up & MAIN):
        own |= STRONG
    for m in _ATTRS.finditer(attrs) if attrs and tag not in ("html", "body") else ():
        name, value = m.group(1).lower(), next((x for x in m.groups()[1:] if x is not None), "")
        if name == "role" and value.strip().lower() in _CHROME_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            own |= STRONG
        elif name in ("class", "id") and not (tag == "header" and up & MAIN) and names_chrome(value, bool(up & MAIN)):
            own |= NAMED
    return own


def tokens(page: str) -> tuple[list[int], list[int], list[int], list[str]]:
    """Keys, kinds and flags of a page's tags and text runs, and the texts of the runs, unescaped.

    A key is a hash of the token's place in the tree and its marks (class, id, role) or text. Comments and raw elements
    are no tokens. Broken markup is read as browsers do, roughly: a start tag ends open paragraphs or items that it can't
    stand in, an end tag closes what is open inside its element, an end tag without a start is passed over.
    """
    keys: list[int] = []
    kinds: list[int] = []
    flags: list[int] = []
    texts: list[str] = []
    stack: list[tuple[str, int, int]] = []  # tag, flags, path
    open_: Counter[str] = Counter()  # how often each tag is in it
    wide: list[int] = []  # where in it tags are that stand for more than a line
    at, n = 0, len(page)

    def put(key: str, kind: int, flag: int) -> None:
        keys.append(_hash(key)), kinds.append(kind), flags.append(flag)

    def close(k: int) -> None:
        for x, _, _ in stack[k:]:
            open_[x] -= 1
        del stack[k:]
        while wide and wide[-1] >= k:
            wide.pop()

    def text(a: int, b: int) -> None:
        if a >= b:
            return
        t = entities.unescape(page[a:b])
        if t.strip():
            _, f, path = stack[-1] if stack else ("", 0, 0)
            put(f"text\x1f{path}\x1f{' '.join(t.split())}", TEXT, f)
            texts.append(t)
        elif texts:
            texts[-1] += " "  # if a block ends in between, it is trimmed

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text(at, n)
            break
        text(at, m.start())
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        kind = BREAK if tag == "br" else INLINE if tag in _INLINE else BLOCK
        if m.group(1):
            if open_[tag]:
                k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag)  # what is passed over is closed
                put(f"close\x1f{stack[k][2]}", kind, stack[k][1])
                close(k)
            continue
        if tag in _RAW:
            e = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = e.end() if e else n
            continue
        if tag in _BLOCKS_END_P or tag in _CLOSES:
            ends = _CLOSES.get(tag, set()) | ({"p"} if tag in _BLOCKS_END_P else set())
            if wide and stack[wide[-1]][0] in ends:
                close(wide[-1])
        _, held, path = stack[-1] if stack else ("", 0, 0)
        attrs = m.group(3)
        f = _held(tag, attrs, held)
        path = _hash(f"{path}/{tag}")
        marks = " ".join(sorted(f"{a.group(1).lower()}={next((x for x in a.groups()[1:] if x is not None), '')}" for a in _ATTRS.finditer(attrs) if a.group(1).lower() in ("class", "id", "role"))) if attrs else ""
        put(f"open\x1f{path}\x1f{marks}", kind, f)
        if tag not in _VOID and not attrs.rstrip().endswith("/"):
            if tag not in _INLINE:
                wide.append(len(stack))
            stack.append((tag, f, path))
            open_[tag] += 1
    return keys, kinds, flags, texts


class Template:
    """A host's valid classes: each token's class and place in its order."""

    def __init__(self, classes: list[tuple[int, int, list[int]]], poor: set[tuple[int, int]] | None = None) -> None:
        self.place = {t: (c, i) for c, _, order in classes for i, t in enumerate(order)}
        self.last = {c: len(order) - 1 for c, _, order in classes}
        self.main = {t for _, is_main, order in classes for t in order if is_main}
        self.poor = poor or set()

    def parse(self, keys: list[int]) -> tuple[list[tuple[int, int] | None], dict[int, tuple[int, int]], set[int]]:
        """The slot (class, place) of each token, None for template tokens; the slot that each class lies in; and classes that
        are crossed by another or lie in several slots. The slot outside all classes is (0, 0)."""
        open_: list[list[int]] = []
        slots: list[tuple[int, int] | None] = []
        parents: dict[int, tuple[int, int]] = {}
        bad: set[int] = set()
        for t in keys:
            if (m := self.place.get(t)) is None:
                slots.append((open_[-1][0], open_[-1][1]) if open_ else (0, 0))
                continue
            c, i = m
            slots.append(None)
            if not any(x[0] == c for x in open_):
                if i:
                    bad.add(c)
                    continue
                at = (open_[-1][0], open_[-1][1]) if open_ else (0, 0)
                if parents.setdefault(c, at) != at:
                    bad.add(c)
                open_.append([c, 0])
                continue
            while open_[-1][0] != c:
                bad.add(open_.pop()[0])
            open_[-1][1] = i
            if i == self.last[c]:
                open_.pop()
        bad.update(c for c, _ in open_)
        return slots, parents, bad


def order_of(keys: list[int], of: dict) -> dict:
    """Each class's order of tokens in a page, if they repeat in one order; else None. of: classes of tokens."""
    seen: dict = {}
    for t in keys:
        if (c := of.get(t)) is not None:
            seen.setdefault(c, []).append(t)
    out = {}
    for c, s in seen.items():
        k = len(set(s))
        out[c] = tuple(s[:k]) if len(s) % k == 0 and s == s[:k] * (len(s) // k) else None
    return out


def article(keys: list[int], kinds: list[int], flags: list[int], texts: list[str], template: Template) -> str:
    """The text of a page's remaining slots, its blocks joined by one space."""
    slots, _, _ = template.parse(keys) if template.place else ([(0, 0)] * len(keys), {}, set())
    runs = [i for i, k in enumerate(kinds) if k == TEXT]
    text_at = dict(zip(runs, texts, strict=True))
    block = np.cumsum([k == BLOCK for k in kinds]).tolist()

    def chosen(chrome: int) -> tuple[set[int], int]:
        # a name does not take its title from an article
        own = [i for i in runs if not flags[i] & chrome or flags[i] & chrome == NAMED and flags[i] & TITLE and flags[i] & MAIN]
        within = [i for i in own if flags[i] & MAIN]
        if within:
            size = sum(len(text_at[i]) for i in within)
            varied = {block[i] for i in within if keys[i] not in template.main}  # a block goes if all of it is template
            if sum(len(text_at[i]) for i in within if block[i] not in varied) <= MOST_IN_MAIN * size:
                within = [i for i in within if block[i] in varied]
            own = within
        else:
            own = [i for i in own if slots[i] is not None and (slots[i] not in template.poor or flags[i] & HEADING)]
        return set(own), sum(len(text_at[i]) for i in own)

    keep, size = chosen(STRONG | FORM | NAMED | NAV)
    wider, more = chosen(STRONG | NAMED | NAV)
    if size < more / 4:  # the page itself is in a form
        keep, size = wider, more
    wider, more = chosen(STRONG | FORM | NAV)
    if size < more * LEAST_UNNAMED:  # what looks like a name of chrome is that of the article
        keep = wider
    blocks: list[str] = []
    run: list[str] = []
    for i, kind in enumerate(kinds):
        if kind == TEXT and i in keep:
            run.append(text_at[i])
        elif kind == BREAK:
            run.append(" ")
        elif kind != INLINE and run:
            blocks.append("".join(run))
            run = []
    blocks.append("".join(run))
    return " ".join(s for b in blocks if (s := " ".join(b.split())))


TOKENS = "_host string, _key long, _keys binary, _kinds binary, _sizes binary"


def tokenised(pages: DataFrame) -> DataFrame:
    """TOKENS of each page (keys, kinds and sizes of its tokens; a size is that of a text) from _host, _key and _html."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[["_host", "_key"]].reset_index(drop=True)
            keys, kinds, sizes = [], [], []
            for x in b["_html"]:
                k, kind, _, texts = tokens(x or "")
                runs = iter(texts)
                keys.append(np.array(k, dtype=np.int64).tobytes()), kinds.append(bytes(kind))
                sizes.append(np.array([len(next(runs)) if i == TEXT else 0 for i in kind], dtype=np.int32).tobytes())
            out["_keys"], out["_kinds"], out["_sizes"] = keys, kinds, sizes
            yield out

    return pages.select("_host", "_key", "_html").mapInPandas(run, TOKENS)


def _ints(b: bytes) -> list[int]:
    return np.frombuffer(b, dtype=np.int64).tolist()


def occurrences(distinct: DataFrame) -> DataFrame:
    """(host, token, vector, pages, text) from distinct pages: vector hashes in which pages a token occurs how often; text: it is a run of text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hosts, found = [], []
            for key, host, keys, kinds in zip(b["_key"], b["_host"], b["_keys"], b["_kinds"], strict=True):
                k, first, c = np.unique(np.frombuffer(keys, dtype=np.int64), return_index=True, return_counts=True)
                times = {n: _hash(f"{key}:{n}") for n in np.unique(c).tolist()}
                found.append((k, [times[n] for n in c.tolist()], np.frombuffer(kinds, dtype=np.uint8)[first] == TEXT))
                hosts += [host] * len(k)
            if hosts:
                yield pd.DataFrame({"host": hosts, "token": np.concatenate([x for x, _, _ in found]), "vector": [v for _, x, _ in found for v in x], "text": np.concatenate([x for _, _, x in found])})

    each = distinct.select("_host", "_key", "_keys", "_kinds").mapInPandas(run, "host string, token long, vector long, text boolean")
    return each.groupBy("host", "token").agg(F.bit_xor("vector").alias("vector"), F.count(F.lit(1)).alias("pages"), F.max("text").alias("text"))


def _per_host(pages: DataFrame, hosts: DataFrame, *payload: str) -> DataFrame:
    """pages with the payload of their host: by a broadcast up to BROADCAST_BYTES, else by a join that adaptive execution splits."""
    size = hosts.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in payload), F.lit(64)))).first()[0] or 0
    h = hosts.select(F.col("host").alias("_th"), *payload)
    return pages.join(F.broadcast(h) if size <= BROADCAST_BYTES else h, F.col("_host") == F.col("_th"), "left").drop("_th")


def _packed(df: DataFrame) -> DataFrame:
    """(host, _classes): the (class, main, tokens) rows of each host as bytes: per class its id, whether it is of the main template, the number of its tokens, and they."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("class")
        return pd.DataFrame({"host": [key[0]], "_classes": [_bytes(zip(rows["class"], rows["main"], rows["tokens"], strict=True))]})

    return df.groupBy("host").applyInPandas(run, "host string, _classes binary")  # a host's templates, bounded by LEAST_SHARE


def _bytes(classes: Iterable[tuple[int, int, list[int]]]) -> bytes:
    return b"".join(np.array([c, m, len(t), *t], dtype=np.int64).tobytes() for c, m, t in classes)


def unpacked(classes: bytes | None) -> list[tuple[int, int, list[int]]]:
    a, out, at = _ints(classes or b""), [], 0
    while at < len(a):
        out.append((a[at], a[at + 1], a[at + 3 : at + 3 + a[at + 2]]))
        at += 3 + a[at + 2]
    return out


class _Known:
    """What was made of the last hosts' payloads."""

    def __init__(self, make) -> None:
        self.make, self.of = make, {}

    def __call__(self, host: str, *payload):
        if host not in self.of:
            if len(self.of) > 200:
                self.of.clear()
            self.of[host] = self.make(*payload)
        return self.of[host]


def templates(pages: DataFrame) -> DataFrame:
    """(host, _classes, _poor) from _host, _key and _html of pages: the host's valid classes in order of their tokens, and its poor slots.

    A class is a host's tokens of equal vectors: LEAST_CLASS of them, in LEAST_PAGES pages and LEAST_SHARE of the host's
    (see MAIN_SHARE and KIND_PAGES). It is valid if its tokens repeat in one order, the same in all pages, and if it lies
    in one slot of the classes around it and crosses none. Pages that are exact copies count as one.
    """
    distinct = written(tokenised(pages.where("_html <> ''")).dropDuplicates(["_host", "_key"]), "page-tokens")
    size = distinct.groupBy("_host").agg(F.count(F.lit(1)).alias("of")).where(F.col("of") >= LEAST_PAGES).select(F.col("_host").alias("host"), "of")
    occ = occurrences(distinct).where(F.col("pages") >= LEAST_PAGES).join(size, "host").where(F.col("pages") >= F.col("of") * LEAST_SHARE)
    classes = occ.groupBy("host", F.col("vector").alias("class"), "pages", "of").agg(F.collect_list("token").alias("tokens"), F.count_if(~F.col("text")).alias("tags"))
    main = F.col("pages") >= F.col("of") * MAIN_SHARE
    classes = classes.where((F.size("tokens") >= LEAST_CLASS) & (main | (F.col("tags") > 0) & (F.col("pages") >= KIND_PAGES)))
    found = written(_packed(classes.select("host", "class", main.cast("long").alias("main"), "tokens")), "page-classes")

    def orders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Known(lambda c: {t: (k, m) for k, m, ts in unpacked(c) for t in ts})
        for b in batches:
            out = []
            for host, keys, c in zip(b["_host"], b["_keys"], b["_classes"], strict=True):
                out += [(host, k, m, None if o is None else np.array(o, dtype=np.int64).tobytes()) for (k, m), o in order_of(_ints(keys), known(host, c)).items()]
            yield pd.DataFrame(out, columns=["host", "class", "main", "tokens"])

    ordered = _per_host(distinct, found, "_classes").where("_classes is not null").select("_host", "_keys", "_classes").mapInPandas(orders, "host string, class long, main long, tokens binary")
    ordered = ordered.groupBy("host", "class", "main").agg(F.min("tokens").alias("a"), F.max("tokens").alias("b"), F.count_if(F.col("tokens").isNull()).alias("n")).where("n = 0 and a = b")
    longs = F.pandas_udf(lambda s: s.map(_ints), "array<long>")
    ordered = written(_packed(ordered.select("host", "class", "main", longs("a").alias("tokens"))), "page-orders")

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Known(lambda c: Template(unpacked(c)))
        for b in batches:
            out = []
            for host, keys, kinds, sizes, c in zip(b["_host"], b["_keys"], b["_kinds"], b["_sizes"], b["_classes"], strict=True):
                keys = _ints(keys)
                at, parents, bad = known(host, c).parse(keys)
                out += [(host, k, -1, 0, 0 if k in bad else _hash(f"{p}")) for k, p in parents.items()] + [(host, k, -1, 0, 0) for k in bad if k not in parents]
                held: dict[tuple[int, int], list[tuple[int, int]]] = {}
                for s, kind, t, n in zip(at, kinds, keys, np.frombuffer(sizes, dtype=np.int32).tolist(), strict=True):
                    if kind == TEXT and s is not None:
                        held.setdefault(s, []).append((n, t))
                out += [(host, k, i, sum(n for n, _ in ts), _hash(f"{[t for _, t in ts]}")) for (k, i), ts in held.items()]
            yield pd.DataFrame(out, columns=["host", "class", "at", "chars", "told"])

    seen = _per_host(distinct, ordered, "_classes").where("_classes is not null").mapInPandas(slots, "host string, class long, at int, chars long, told long")
    seen = written(seen.groupBy("host", "class", "at", "told").agg(F.count(F.lit(1)).alias("pages"), F.sum("chars").alias("chars")), "page-slots")
    bad = seen.where("at = -1").groupBy("host", "class").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("told") == 0).alias("crossed")).where("n > 1 or crossed > 0").select("host", "class")
    ranked = seen.where("at >= 0").groupBy("host", "class", "at").agg((F.sum("chars") * F.count(F.lit(1)) / F.sum("pages")).alias("score"))
    best = ranked.groupBy("host").agg(F.max("score").alias("best"))
    poor = ranked.join(best, "host").where(F.col("score") < F.col("best") * POOR).groupBy("host").agg(F.collect_list(F.struct("class", "at")).alias("_poor"))
    bad = bad.groupBy("host").agg(F.collect_list("class").alias("_bad"))

    def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for host, c, no, poor_ in zip(b["host"], b["_classes"], b["_bad"], b["_poor"], strict=True):
                gone = set() if no is None else set(map(int, no))
                out.append((host, _bytes(x for x in unpacked(c) if x[0] not in gone), b"" if poor_ is None else np.array([(x["class"], x["at"]) for x in poor_], dtype=np.int64).tobytes()))
            yield pd.DataFrame(out, columns=["host", "_classes", "_poor"])

    return written(ordered.join(bad, "host", "left").join(poor, "host", "left").mapInPandas(final, "host string, _classes binary, _poor binary"), "page-templates")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, ``text`` and ``n_chars`` per page.

    Null or empty html: empty text; an empty table: an empty result. Null URLs share one host ''. Hosts of fewer than
    LEAST_PAGES distinct pages have no template; their pages are read by their tags alone. Repeated rows give the same
    text. Slots of equal scores are alike: all poor, or none. Long pages are read in time linear in their length. Other
    columns play no part.

    Distinct pages are tokenised into a table of numbers, a fifth of their size, from which templates are deduced; whole
    pages are read once more in the end. Tokens of a host are counted with partial sums, so a hot host is spread over
    all tasks; what comes back to its pages is its templates, whose size LEAST_SHARE bounds.
    """
    p = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), host_of(F.col(url_col)).alias("_host"), F.xxhash64(F.col(html_col)).alias("_key"), F.col(html_col).alias("_html"))
    j = _per_host(p, templates(p), "_classes", "_poor").select("_id", "_url", "_host", "_html", "_classes", "_poor")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Known(lambda c, poor: Template(unpacked(c), set(map(tuple, np.frombuffer(poor or b"", dtype=np.int64).reshape(-1, 2).tolist()))))
        for b in batches:
            texts = [article(*tokens(page), known(host, c, poor)) if page else "" for host, page, c, poor in zip(b["_host"], b["_html"], b["_classes"], b["_poor"], strict=True)]
            yield pd.DataFrame({"_id": b["_id"], "_url": b["_url"], "text": texts, "n_chars": [len(x) for x in texts]})

    kinds = dict(j.dtypes)
    out = j.mapInPandas(run, f"_id {kinds['_id']}, _url {kinds['_url']}, text string, n_chars long")
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", "n_chars")
