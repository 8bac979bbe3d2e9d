"""Similarity self-join on word n-grams: MinHash candidates, Bayesian pruning, exact verification.

1. Every text gets a fingerprint of its words and a MinHash signature of its distinct five-word shingles. Texts of
   equal fingerprint are copies: they form a class, and one row of it goes on.
2. Bands of the signature are candidates' buckets. Within a bucket (in blocks, if it is large) pairs compare their
   signatures step by step; a pair is dropped as soon as the posterior probability, from the matches so far, that its
   similarity reaches the threshold falls below a tolerance.
3. Surviving pairs are joined to groups. Texts meet once per group (in blocks, if it is large), where all pairs that
   the signatures don't rule out are verified on their shingles, and each text's links are counted.

No pair is ever a row: blocks report each text's number of links and a spanning forest of them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, if_small, row_key, unboxed, written
from .components import components

WORDS_PER_SHINGLE = 5
THRESHOLD = 0.8
#: Bands of ROWS hashes each; a pair of similarity 0.8 shares none of the bands with probability 3e-6.
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Hashes compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-6
#: Texts of a block in a bucket and in a group.
BUCKET_BLOCK, GROUP_BLOCK = 512, 256
PAIRS_AT_ONCE = 500_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_U = np.uint64
_rng = np.random.default_rng(20)
_A = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * _U(2) + _U(1)
_B = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64)
_P = _U(0x9E3779B97F4A7C15)


def word_hashes(text: str | None, cache: dict[str, int]) -> np.ndarray:
    ws = _WORD.findall(text.lower()) if text else []
    if len(cache) > 400_000:
        cache.clear()
    for w in ws:
        if w not in cache:
            cache[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(cache.__getitem__, ws), dtype=np.uint64, count=len(ws))


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of five words; fewer words are one shingle."""
    n = min(WORDS_PER_SHINGLE, len(words))
    if not n:
        return words
    h = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        h = (h ^ words[i : len(words) - n + 1 + i]) * _P
        h ^= h >> _U(29)
    return np.unique(h)


def fingerprint(words: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(words.tobytes()) - (1 << 63)


def signature(s: np.ndarray) -> np.ndarray:
    """HASHES MinHash values, 16 bits of each."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), 1024):
        np.minimum(low, ((s[at : at + 1024] ^ _B[:, None]) * _A[:, None]).min(axis=1), out=low)
    return ((low * _P) >> _U(48)).astype(np.uint16)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(n, m): after n hashes, fewer than m matches make P(similarity >= threshold) < tolerance, under a uniform prior.

    The posterior is Beta(m + 1, n - m + 1), whose tail is that of a binomial: P(Bin(n + 1, threshold) <= m).
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, 0
        while True:
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def prune(sigs: np.ndarray, a: np.ndarray, b: np.ndarray, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (rows a, b of sigs) that survive every step."""
    matches, at = np.zeros(len(a), dtype=np.int32), 0
    for n, least in bounds:
        matches = matches + (sigs[a, at:n] == sigs[b, at:n]).sum(axis=1, dtype=np.int32)
        stay = matches >= least
        a, b, matches, at = a[stay], b[stay], matches[stay], n
        if not len(a):
            break
    return a, b


class Forest:
    """Union-find over any ids; remembers nothing but parents."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def pairs_of(side: np.ndarray, diagonal: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within a block, or between the two blocks that side tells apart, so many at once."""
    first, second = (np.arange(len(side)),) * 2 if diagonal else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    rows = max(1, PAIRS_AT_ONCE // max(1, len(second)))
    for k in range(0, len(first), rows):
        x, y = np.meshgrid(first[k : k + rows], second, indexing="ij")
        use = (x < y) if diagonal else np.ones(x.shape, dtype=bool)
        yield x[use], y[use]


def groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[list[pd.DataFrame]]:
    """Runs of equal keys in sorted batches, as lists of pieces."""
    held: list[pd.DataFrame] = []
    last = None
    for b in batches:
        k = b[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1), len(b)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i == j:
                continue
            now = tuple(k[i])
            if held and now != last:
                yield held
                held = []
            last = now
            held.append(b.iloc[i:j])
    if held:
        yield held


def _blocks(df: DataFrame, key: str, block: int) -> DataFrame:
    """Rows (with _n of their key) dealt to pairs of blocks: _i <= _j, and _side, which of the two a row is of."""
    d = df.withColumn("_nb", F.ceil(F.col("_n") / block).cast("int")).withColumn("_my", F.pmod(F.xxhash64(F.lit("block"), "_v", key), F.col("_nb")).cast("int"))
    d = d.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    d = d.withColumns({"_i": F.least("_my", "_o"), "_j": F.greatest("_my", "_o")}).withColumn("_side", (F.col("_my") != F.col("_i")).cast("int"))
    return d.drop("_nb", "_my", "_o", "_n").repartition(key, "_i", "_j").sortWithinPartitions(key, "_i", "_j")


def _signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _k1, _k2, _v (fingerprint; null without words), _sig per row."""
    d = docs.select(F.col(id_col).cast("long").alias("_id"), *row_key(id_col, text_col), F.col(text_col).alias("_t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, int] = {}
        for b in batches:
            v, sig = [], []
            for t in b["_t"]:
                w = word_hashes(t, cache)
                v.append(fingerprint(w) if len(w) else None)
                sig.append(signature(shingles(w)).tobytes() if len(w) else None)
            out = b[["_id", "_k1", "_k2"]].reset_index(drop=True)
            out["_id"] = out["_id"].astype("Int64")
            out["_v"], out["_sig"] = pd.array(v, dtype="Int64"), sig
            yield out

    return d.mapInPandas(run, "_id long, _k1 long, _k2 int, _v long, _sig binary")


def _candidates(reps: DataFrame) -> DataFrame:
    """Edges (a, b) that join all pairs which share a band and survive the pruning."""
    width = 2 * ROWS
    bands = reps.select("_v", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("_sig"), i * width + 1, F.lit(width))))).alias("_band"))
    several = bands.groupBy("_band").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    met = bands.join(several, "_band").join(reps.select("_v", "_sig"), "_v")
    bounds = least_matches()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, out = Forest(), []
        for g in groups(batches, ["_band", "_i", "_j"]):
            v = np.concatenate([x["_v"].to_numpy() for x in g])
            side = np.concatenate([x["_side"].to_numpy() for x in g])
            sigs = np.frombuffer(b"".join(s for x in g for s in x["_sig"]), dtype=np.uint16).reshape(len(v), HASHES)
            diagonal = g[0]["_i"].iloc[0] == g[0]["_j"].iloc[0]
            for a, b in pairs_of(side, diagonal):
                a, b = prune(sigs, a, b, bounds)
                out += [(x, y) for x, y in zip(v[a].tolist(), v[b].tolist(), strict=True) if forest.join(x, y)]
            if len(forest.up) > 500_000 or len(out) > 100_000:
                yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
                forest, out = Forest(), []
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return _blocks(met.select("_v", "_band", "_n", "_sig"), "_band", BUCKET_BLOCK).mapInPandas(run, "a long, b long")


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sorted sets."""
    own, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    if len(a) <= 4 * len(own) or len(own) < 8:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], dtype=np.int64)
    lens = [len(sets[i]) for i in own]
    _, col = np.unique(np.concatenate([sets[i] for i in own]), return_inverse=True)
    row = np.repeat(np.arange(len(own)), lens)
    use = np.bincount(col)[col] > 1
    row, (_, col) = row[use], np.unique(col[use], return_inverse=True)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((len(own), len(own)), dtype=np.float32)
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        i, j = np.searchsorted(col, [at, at + 4096])
        m = np.zeros((len(own), 4096), dtype=np.float32)
        m[row[i:j], col[i:j] - at] = 1
        both += m @ m.T
    return both[inv[: len(a)], inv[len(a) :]].astype(np.int64)


def _verified(members: DataFrame, threshold: float) -> DataFrame:
    """(_v, root, links) from (_c, _n, _v, _copies, _sig, _t): per block pair and text with links, the number of rows it is linked to, and the least text it hangs together with there."""
    bounds = least_matches(threshold)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, int] = {}
        for g in groups(batches, ["_c", "_i", "_j"]):
            v, copies, side, sigs, sets = [], [], [], [], []
            seen: set[int] = set()
            for x in g:
                for k, c, s, sig, t in zip(x["_v"], x["_copies"], x["_side"], x["_sig"], x["_t"], strict=True):
                    w = word_hashes(t, cache)
                    if k in seen or fingerprint(w) != k:
                        continue  # another row of the same id
                    seen.add(k)
                    v.append(k), copies.append(c), side.append(s), sigs.append(sig), sets.append(shingles(w))
            n, sig = len(v), np.frombuffer(b"".join(sigs), dtype=np.uint16).reshape(len(v), HASHES)
            copies, sizes, links, forest = np.array(copies), np.array([len(s) for s in sets]), np.zeros(n, dtype=np.int64), Forest()
            for a, b in pairs_of(np.array(side), bool(g[0]["_i"].iloc[0] == g[0]["_j"].iloc[0])):
                fit = np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b]) - 1e-9
                a, b = prune(sig, a[fit], b[fit], bounds)
                if not len(a):
                    continue
                both = overlaps(sets, a, b)
                yes = both >= threshold * (sizes[a] + sizes[b] - both) - 1e-9
                a, b = a[yes], b[yes]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                for i, j in zip(a.tolist(), b.tolist(), strict=True):
                    forest.join(v[i], v[j])
            linked = np.flatnonzero(links)
            if len(linked):
                yield pd.DataFrame({"_v": [v[i] for i in linked], "root": [forest.root(v[i]) for i in linked], "links": links[linked]})

    return _blocks(members, "_c", GROUP_BLOCK).mapInPandas(run, "_v long, root long, links long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: id, _k1, _k2, ``class_id``, ``n_links``, ``n_copies``.

    Words are runs of anything but ASCII white space, lower case; two texts are linked if the Jaccard similarity of
    their sets of five-word shingles is ``threshold`` or more. class_id: the least id of all rows connected by links;
    n_links: the number of other rows linked to the row, copies included; n_copies: rows of the very same words.

    Ids are integers. Texts of fewer than five words are one shingle. Null texts, texts without words and rows without
    an id link to nothing; their class is their own id. Repeated rows are copies of each other. Other columns play no
    part. An empty table gives an empty result. Texts are told apart by 64-bit fingerprints.
    """
    signed = written(_signed(docs, id_col, text_col), "join-signed")
    named = signed.where("_v is not null and _id is not null")
    reps = written(named.groupBy("_v").agg(F.count(F.lit(1)).alias("_copies"), F.min("_id").alias("_rep"), F.first("_sig").alias("_sig")), "join-reps")
    near = components(_candidates(reps))
    near = written(near.join(near.groupBy("c").agg(F.count(F.lit(1)).alias("_n")), "c").select(F.col("c").alias("_c"), "_n", F.col("v").alias("_v")).join(reps, "_v"), "join-groups")
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_rep"), F.col(text_col).alias("_t"))
    members = texts.join(if_small(near, 100_000), "_rep").drop("_rep")
    checked = written(_verified(members.select("_c", "_n", "_v", "_copies", "_sig", "_t"), threshold), "join-links")
    links = checked.groupBy("_v").agg(F.sum("links").alias("_links"))
    linked = components(checked.select(F.col("_v").alias("a"), F.col("root").alias("b")))
    whole = linked.join(reps.select(F.col("_v").alias("v"), "_rep"), "v")
    least = whole.groupBy("c").agg(F.min("_rep").alias("_class"))
    own = whole.join(least, "c").select(F.col("v").alias("_v"), "_class").join(links, "_v")
    per = reps.select("_v", "_copies", "_rep").join(own, "_v", "left")
    per = per.select(F.col("_v").alias("_w"), "_copies", F.coalesce("_class", "_rep").alias("_class"), (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).alias("_links"))
    per = written(per, "join-classes")  # so that the join below has an exchange of its own on either side, and copies split
    out = signed.select("_id", "_k1", "_k2", F.when(F.col("_id").isNotNull(), F.col("_v")).alias("_v")).join(per, F.col("_v") == F.col("_w"), "left")
    return out.select(F.col("_id").alias(id_col), "_k1", "_k2", F.coalesce("_class", "_id").alias("class_id"), F.coalesce("_links", F.lit(0)).alias("n_links"), F.coalesce("_copies", F.lit(1)).alias("n_copies"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each class: the one of the least id. Rows without an id or words stay."""
    bad = written(classes(docs, id_col, text_col, threshold).where(F.col(id_col) != F.col("class_id")).select("_k1", "_k2").distinct(), "join-dropped")
    return boxed(docs, id_col, text_col).join(if_small(bad), ["_k1", "_k2"], "left_anti").select(*unboxed(docs.columns))
