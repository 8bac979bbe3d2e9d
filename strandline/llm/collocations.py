"""Phrase collocations from generalised suffix automata, one per shard of texts.

A shard's automaton has a state for each class of phrases that end at the same places (endpos), with its longest phrase,
the length its suffix link leads to, and its number of places. Only phrases of bounded length are wanted, so states
are made by sorting: phrases of one length are numbered by (number of the phrase without its last word, last word), and
a phrase that stands as often as its suffix is in its suffix's state. The phrases that states hold are listed, dealt out
by hash, and their places added over all shards.

Texts are read four times. First words, then pairs, then triples of words are counted by hash in a table of fixed size,
each made of parts whose hashes stand often enough; the automata then only see such words, pairs and triples. A phrase
is never more frequent than its parts, nor a part than all that shares its hash, so this leaves out nothing that reaches
the least count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import if_small, written

LONGEST = 5
#: Bytes of text that are split into words at a time (about half a million words), and places of a shard; a distinct word
#: weighs as much as eight.
SHARD_BYTES, SHARD_PLACES = 3_000_000, 4_000_000
#: Bits of the hashes that words and pairs are counted by, and of those that counts are dealt out by. The filter made of
#: them is broadcast, 16 MB whatever the corpus. A task holds so many counts before it sends them on.
FILTER_BITS, PART_BITS, HELD_COUNTS = 27, 11, 4_000_000
#: Bits of the hashes that phrases are dealt out by.
PHRASE_BITS = 10
#: Buckets that a language's phrases are ranked in before they are ranked together.
BUCKETS = 32

#: Bytes that end a piece; all become one that no word holds.
ENDS = bytes.maketrans(b",;:!?\x0a\x0b\x0c\x0d", b"." * 9)
_COUNTS = "part int, lang string, n long, ids binary, counts binary"


@dataclass
class Automaton:
    """States of a shard's automaton: where the longest phrase of each ends, its words, those of the phrase its suffix
    link leads to, and the number of its places."""

    end: np.ndarray
    longest: np.ndarray
    link: np.ndarray
    places: np.ndarray


def automaton(codes: np.ndarray, kinds: int, depth: int, lent: np.ndarray | None = None, joins: tuple[np.ndarray, ...] = ()) -> Automaton:
    """The automaton of phrases of up to depth words. codes: numbers of words below kinds, -1 where a piece ends. Places in
    ``lent`` only lend their words to later ones. joins: whether a phrase of two, of three (and so on; the last holds for
    longer ones too) words may end at a place."""
    n = len(codes)
    lent = np.zeros(n, bool) if lent is None else lent
    now, by_depth = codes.astype(np.int64), []  # numbers of the phrases that end at each place; per depth: a place, suffix and count of each
    for d in range(1, depth + 1):
        suffix = None
        if d > 1:
            ok = np.concatenate([[False], now[:-1] >= 0]) & (codes >= 0)
            at = np.flatnonzero(ok & joins[min(d - 2, len(joins) - 1)] if joins else ok)
            _, number = np.unique(now[at - 1] * kinds + codes[at], return_inverse=True)
        else:
            at = np.flatnonzero(now >= 0)
            number = now[at]
        early, size = lent[at], int(number.max(initial=-1)) + 1 if d > 1 else kinds
        count = np.bincount(number[~early], minlength=size)
        end = np.zeros(size, np.int64)
        for own in (early, ~early):  # one of a phrase's places; where it has any that counts, one of these
            end[number[own]] = at[own]
        if d > 1:
            suffix = now[end]
            now.fill(-1)
            now[at] = number
        by_depth.append((end, suffix, count))
        if not len(at):
            break
    top = [np.ones(len(c), bool) for _, _, c in by_depth]
    low = [np.zeros(len(c), np.int64) for _, _, c in by_depth]
    for d in range(1, len(by_depth)):
        _, suffix, count = by_depth[d]
        same = by_depth[d - 1][2][suffix] == count
        top[d - 1][suffix[same]] = False
        low[d] = np.where(same, low[d - 1][suffix], d)
    own = [top[d] & (c > 0) for d, (_, _, c) in enumerate(by_depth)]
    end, link, places = (np.concatenate([x[o] for x, o in zip(xs, own, strict=True)]) for xs in ([e for e, _, _ in by_depth], low, [c for _, _, c in by_depth]))
    return Automaton(end, np.repeat(np.arange(1, len(own) + 1), [int(o.sum()) for o in own]), link, places)


def mixed(h: np.ndarray, bits: int, *more: np.ndarray) -> np.ndarray:
    """Places in a filter of 2**bits bits, of words' hashes or of sequences of them."""
    h = h.astype(np.uint64)
    for x in (*more, np.zeros(1, np.uint64)):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + x.astype(np.uint64)
    return h >> np.uint64(64 - bits)


def word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    return pd.util.hash_array(np.array([lang.encode() + b" " + w for w in words], dtype=object), categorize=False) if words else np.zeros(0, np.uint64)


def bits_of(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (filter_[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


@dataclass
class _Open:
    """Text of a language that is not a shard yet, and the words before it."""

    parts: list[bytes]
    size: int
    tail: list[bytes]

    def words(self, lend: int) -> tuple[list[bytes], int]:
        new = b"".join(self.parts).lower().translate(ENDS).replace(b".", b" . ").split()  # of bytes: lower() alters A to Z only, split() is at spaces and tabs here
        words, counted = self.tail + new, len(self.tail)
        self.parts, self.size, self.tail = [], 0, words[-lend:] if lend else []
        return words, counted


def _cut(text: bytes, size: int) -> Iterator[bytes]:
    """A text in parts of about some size, cut before a space or tab."""
    at = 0
    while len(text) - at > size:
        end = max(text.rfind(b" ", at + 1, at + size), text.rfind(b"\t", at + 1, at + size))
        if end < 0:
            end = min((i for c in (b" ", b"\t") if (i := text.find(c, at + size)) >= 0), default=len(text))
        yield text[at:end]
        at = end
    yield text[at:]


def _shards(batches: Iterator[pd.DataFrame], size: int, lend: int) -> Iterator[tuple[str, list[bytes], int]]:
    """(lang, words with b"." where pieces end, how many of them only lend): of one language each; of all that waits, four shards
    at most are held."""
    held: dict[str, _Open] = {}
    for b in batches:
        for lang, text in zip(b["lang"], b["text"], strict=True):
            own = held.setdefault(lang, _Open([], 0, []))
            for part in _cut(text, size):
                own.parts.append(part)
                own.size += len(part)
                if own.size >= size:
                    yield lang, *own.words(lend)
            own.parts.append(b".")
            own.size += 1
            if len(held) > 4 and sum(x.size for x in held.values()) >= 4 * size:
                most = max(held, key=lambda x: held[x].size)
                yield most, *held.pop(most).words(0)
    for lang, own in held.items():
        yield lang, *own.words(0)


@dataclass
class Shard:
    """Words of a language as numbers (-1 where pieces end), the words and their hashes, and how many only lend."""

    lang: str
    codes: np.ndarray
    kinds: np.ndarray
    hashes: np.ndarray
    counted: int

    def keep(self, words: np.ndarray) -> None:
        """Ends a piece at every word whose hash is not in the filter."""
        self.codes = np.where((self.codes >= 0) & bits_of(words, mixed(self.hashes, FILTER_BITS))[self.codes], self.codes, -1)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of words that follow one, and the hashes of the two."""
        at = 1 + np.flatnonzero((self.codes[1:] >= 0) & (self.codes[:-1] >= 0))
        return at, mixed(self.hashes[self.codes[at - 1]], FILTER_BITS, self.hashes[self.codes[at]])

    def joined(self, pairs: np.ndarray) -> np.ndarray:
        """Where a pair ends whose hash is in the filter."""
        out = np.zeros(len(self.codes), bool)
        at, h = self.pairs()
        out[at] = bits_of(pairs, h)
        return out

    def triples(self, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where two such pairs in a row end, and the hashes of their words."""
        at = 1 + np.flatnonzero(two[1:] & two[:-1])
        x, y, z = (self.hashes[self.codes[at - k]] for k in (2, 1, 0))
        return at, mixed(x, FILTER_BITS, y, z)


def _read(batches: Iterator[pd.DataFrame], size: int, lend: int) -> Iterator[Shard]:
    for lang, tokens, counted in _shards(batches, size, lend):
        codes, kinds = pd.factorize(np.array([b".", *tokens], dtype=object))
        codes = codes[1:].astype(np.int64)
        codes[codes == 0] = -1
        yield Shard(lang, codes, kinds, word_hashes(kinds.tolist(), lang), counted)


def _narrow(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x, np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _wide(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(4, -1).T).view(np.uint32).reshape(-1).astype(np.int64)


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    ids, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
    return ids, np.bincount(at, weights=np.concatenate([c for _, c in held]), minlength=len(ids)).astype(np.int64)


def _sent(held: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """A row per part of the hashes: those that occur, as differences, and their counts."""
    ids, counts = _merged(held)
    parts = (ids >> (FILTER_BITS - PART_BITS)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(parts, prepend=-1))
    rows = [(int(parts[i]), None, 0, _narrow(np.diff(ids[i:j], prepend=parts[i] << (FILTER_BITS - PART_BITS))), _narrow(counts[i:j])) for i, j in zip(cuts, [*cuts[1:], len(ids)], strict=True)]
    return pd.DataFrame(rows, columns=[f.split()[0] for f in _COUNTS.split(", ")])


def hash_counts(batches: Iterator[pd.DataFrame], filters: list[Broadcast], size: int) -> Iterator[pd.DataFrame]:
    """How often each hash of a word stands, and the number of words per language; with one filter, hashes of pairs of words
    in it; with two, hashes of triples of pairs in the second."""
    held, n = [], 0
    for s in _read(batches, size, len(filters)):
        if not filters:
            own = s.codes[s.counted :]
            count = np.bincount(own[own >= 0], minlength=len(s.kinds))
            yield pd.DataFrame({"part": [-1], "lang": [s.lang], "n": [int(count.sum())], "ids": [None], "counts": [None]})
            held.append((mixed(s.hashes, FILTER_BITS).astype(np.int64)[count > 0], count[count > 0]))
        else:
            s.keep(filters[0].value)
            at, h = s.pairs() if len(filters) == 1 else s.triples(s.joined(filters[1].value))
            held.append(np.unique(h[at >= s.counted].astype(np.int64), return_counts=True))
        n += len(held[-1][0])
        if n > HELD_COUNTS:
            held = [_merged(held)]
            n = len(held[0][0])
            if n > HELD_COUNTS // 2:
                yield _sent(held)
                held, n = [], 0
    if n:
        yield _sent(held)


def _often(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """Of rows in order of part: the words of 64 bits of the filter that have any bit set. A part's counts are held, no more."""
    width, part, total = 1 << (FILTER_BITS - PART_BITS), None, None

    def full() -> pd.DataFrame:
        bits = np.packbits(total >= least, bitorder="little").view(np.uint64)
        at = np.flatnonzero(bits)
        return pd.DataFrame({"i": part * (width >> 6) + at, "bits": bits[at].view(np.int64)})

    for b in batches:
        for p, ids, counts in zip(b["part"], b["ids"], b["counts"], strict=True):
            if p != part:
                if part is not None:
                    yield full()
                part, total = int(p), np.zeros(width, np.int64)
            total[np.cumsum(_wide(ids))] += _wide(counts)  # hashes of a row are distinct
    if part is not None:
        yield full()


def _filter(counts: DataFrame, least: int) -> Broadcast:
    """Bits of the hashes that stand least times or more, for all tasks. At most 2**21 rows of 16 bytes come to the driver,
    however many words there are."""
    d = counts.where("part >= 0").select("part", "ids", "counts").repartition("part").sortWithinPartitions("part")
    t = d.mapInPandas(partial(_often, least=least), "i long, bits long").toArrow()
    out = np.zeros(2 ** (FILTER_BITS - 6), np.uint64)
    out[t["i"].to_numpy()] = t["bits"].to_numpy().view(np.uint64)
    return counts.sparkSession.sparkContext.broadcast(out)


class _Runs:
    """Runs of words of a language that may be in phrases, until they are a shard, and how often each word stands."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.count = np.zeros(0, np.int64)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.places = 0

    def add(self, s: Shard, pairs: np.ndarray, triples: np.ndarray) -> None:
        two, three = s.joined(pairs), np.zeros(len(s.codes), bool)
        at, h = s.triples(two)
        three[at] = bits_of(triples, h)
        seen = np.bincount(s.codes[s.codes >= 0], minlength=len(s.kinds)) > 0
        own = np.full(len(s.kinds), -1, np.int64)
        own[seen] = [self.number.setdefault(k, len(self.number)) for k in s.kinds[seen].tolist()]
        count = s.codes[s.counted :]
        self.count = np.concatenate([self.count, np.zeros(len(self.number) - len(self.count), np.int64)])
        self.count[own[seen]] += np.bincount(count[count >= 0], minlength=len(s.kinds))[seen]
        kept = np.flatnonzero(two | np.concatenate([two[1:], [False]]))  # whoever is in a pair; neighbours stay neighbours
        self.parts.append((own[s.codes[kept]], kept < s.counted, two[kept], three[kept]))
        self.places += len(kept)

    def phrases(self, lang: str, depth: int) -> pd.DataFrame:
        """A row per part of the hashes of the shard's phrases: these, parted by line ends, and their places."""
        kinds = np.array([*self.number, b""], dtype=object)[:-1]
        once = np.flatnonzero(self.count)
        texts, places = [kinds[once]], [self.count[once]]
        codes, lent, two, three = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        a = automaton(codes, len(kinds), depth, lent, (two, three))
        for m in range(2, depth + 1):
            own = np.flatnonzero((a.link < m) & (m <= a.longest))  # a state's phrases are the suffixes of its longest one
            text = kinds[codes[a.end[own] - m + 1]]
            for k in range(m - 2, -1, -1):
                text = text + b" " + kinds[codes[a.end[own] - k]]
            texts.append(text)
            places.append(a.places[own])
        text, n = np.concatenate(texts), np.concatenate(places)
        part = (pd.util.hash_array(text, categorize=False) >> np.uint64(64 - PHRASE_BITS)).astype(np.int64) if len(text) else np.zeros(0, np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
        rows = [(int(part[at[0]]), lang, len(at), b"\n".join(text[at]), _narrow(n[at])) for at in np.split(order, cuts[1:])] if len(order) else []
        return pd.DataFrame(rows, columns=[f.split()[0] for f in _COUNTS.split(", ")])


def shard_phrases(batches: Iterator[pd.DataFrame], depth: int, words: Broadcast, pairs: Broadcast, triples: Broadcast, size: int, places: int) -> Iterator[pd.DataFrame]:
    """Phrases and places of the shards' automata. Words are counted by themselves, and only words in pairs are in automata."""
    held: dict[str, _Runs] = {}
    for s in _read(batches, size, depth - 1):
        s.keep(words.value)
        own = held.setdefault(s.lang, _Runs())
        own.add(s, pairs.value, triples.value)
        weight = {lang: r.places + 8 * len(r.number) for lang, r in held.items()}
        while sum(weight.values()) >= places:
            most = max(weight, key=weight.__getitem__)
            weight.pop(most)
            yield held.pop(most).phrases(most, depth)
    for lang, r in held.items():
        yield r.phrases(lang, depth)


def _added(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """Of rows in order of part: phrases that stand least times or more. A part's phrases are held, no more."""
    part, total = None, {}

    def full() -> pd.DataFrame:
        often = [(lang, phrase, f) for lang, d in total.items() for phrase, f in d.items() if f >= least]
        return pd.DataFrame(often, columns=["lang", "phrase", "f"])

    for b in batches:
        for p, lang, phrases, n in zip(b["part"], b["lang"], b["ids"], b["counts"], strict=True):
            if p != part:
                yield full()
                part, total = p, {}
            own = total.setdefault(lang, {})
            for phrase, f in zip(phrases.split(b"\n"), _wide(n).tolist(), strict=True):
                own[phrase] = own.get(phrase, 0) + f
    yield full()


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, shard_bytes: int = SHARD_BYTES, shard_places: int = SHARD_PLACES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of the phrases of 1 to LONGEST words that stand at ``least`` places or more, and (lang, n),
    the number of all words."""
    lang, text = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")), F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "utf-8")
    texts = docs.select(lang.alias("lang"), text.alias("text"))
    once = written(texts.mapInPandas(partial(hash_counts, filters=[], size=shard_bytes), _COUNTS), "colloc-words")
    filters = [_filter(once, least)]
    for _ in range(2):
        filters.append(_filter(texts.mapInPandas(partial(hash_counts, filters=list(filters), size=shard_bytes), _COUNTS), least))
    names = dict(zip(("words", "pairs", "triples"), filters, strict=True))
    s = texts.mapInPandas(partial(shard_phrases, depth=LONGEST, size=shard_bytes, places=shard_places, **names), _COUNTS)
    f = s.repartition("part").sortWithinPartitions("part").mapInPandas(partial(_added, least=least), "lang string, phrase binary, f long")
    f = f.select("lang", F.col("phrase").cast("string").alias("phrase"), "f").withColumn("words", F.size(F.split("phrase", " ")))
    return written(f, "colloc-phrases"), once.where("part < 0").groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, top: int = 2000, shard_bytes: int = SHARD_BYTES, shard_places: int = SHARD_PLACES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score (all numbers long): each language's best phrases of 2 to LONGEST words.

    Texts are lower-cased (A to Z), split at . , ; : ! ? and line ends into pieces and those at spaces and tabs into words.
    a is a phrase's number of places, overlaps included, l and r those of the parts it is cut into, n the language's
    words; score is floor(1000 * a * n / (l * r)) at the cut where it is lowest (the first on ties), in exact
    decimals. A phrase inside a longer one that stands as often is left out: its suffix link, or the phrase less its
    last word, has no more places. Of the rest, the ``top`` by score, a (both descending) and phrase (ascending, by bytes).

    - Null language: und. Null and empty texts have no words. Repeated rows count each time. Other columns play no part.
    - Long texts are read in parts of ``shard_bytes``, that lend each other the words phrases may begin with.
    - Ties of score and a go by phrase. An empty table, or one without phrases frequent enough, gives an empty result.
    """
    all_, n = phrases(docs, text_col, lang_col, least, shard_bytes, shard_places)
    c = all_.where("words > 1")
    part = lambda name: all_.select("lang", F.col("phrase").alias(f"_{name}"), F.col("f").alias(name))
    cuts = c.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"_l": F.expr("substring_index(phrase, ' ', k)"), "_r": F.expr("substring_index(phrase, ' ', k - words)")})
    cuts = cuts.join(part("l"), ["lang", "_l"]).join(part("r"), ["lang", "_r"]).join(if_small(written(n, "colloc-languages")), "lang")
    wide = {x: F.col(x).cast("decimal(19,0)") for x in ("f", "n", "l", "r")}
    cuts = cuts.withColumns({"_over": wide["f"] * wide["n"] * F.lit(1000).cast("decimal(4,0)"), "_under": wide["l"] * wide["r"]})
    best = cuts.groupBy("lang", "phrase", F.col("f").alias("a"), "n").agg(F.min(F.struct(F.expr("_over div _under").alias("score"), "k", "l", "r")).alias("_m"))
    one_less = F.array(F.expr("substring_index(phrase, ' ', 1 - words)"), F.expr("substring_index(phrase, ' ', words - 1)"))
    inside = all_.where("words > 2").select("lang", F.explode(one_less).alias("phrase"), F.col("f").alias("_f")).groupBy("lang", "phrase").agg(F.max("_f").alias("_longer"))
    best = best.join(inside, ["lang", "phrase"], "left").where("_longer IS NULL OR _longer < a")
    best = best.select("lang", "phrase", "a", "_m.l", "_m.r", "n", "_m.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = best.withColumn("_b", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS)))
    best = best.withColumn("_i", F.row_number().over(Window.partitionBy("lang", "_b").orderBy(*order))).where(F.col("_i") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
