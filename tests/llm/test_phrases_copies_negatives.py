"""Collocations, exact dedup and hard negatives against plain Python, and their edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from strandline.llm import collocations, exact_dedup, hard_negatives

SPACES = str.maketrans("", "", " \t\n\v\f\r")


# collocations


def brute_phrases(docs, least, top):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for m in range(1, 6):
                f.update((lang, tuple(ws[i : i + m])) for i in range(len(ws) - m + 1))
    often = {k: v for k, v in f.items() if v >= least}
    inside = set()
    for (lang, p), v in often.items():
        for i in range(len(p)):
            for j in range(i + 1, len(p) + 1):
                if j - i < len(p) and v >= often[lang, p[i:j]]:
                    inside.add((lang, p[i:j]))
    rows = {}
    for (lang, p), a in often.items():
        if len(p) > 1 and (lang, p) not in inside:
            cuts = [(1000 * a * n[lang] // (often[lang, p[:k]] * often[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), often[lang, p[:k]], often[lang, p[k:]]))
    out = []
    for lang, r in rows.items():
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(r)[:top])]
    return sorted(out)


def random_docs(rng, n, words=("a", "b", "c", "B", "É", "é", "x-1", "\x1cz", "d")):
    ends = [" ", " ", " ", " ", "\t", ", ", ".", "\n", " ! ", "\r\n"]
    return ["".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("size", [7, 200, 6_000_000])
def test_collocations_match_brute_force(spark, make, size):
    rng = random.Random(size)
    texts = random_docs(rng, 120) + ["a a a a a a a b", "", None, "one two three four five six seven " * 9, "A B C D " * 8]
    rows = [(i, t, rng.choice(["en", "de", None])) for i, t in enumerate(texts)]
    got = collocations.collocations(make(rows, clash=True), least=6, top=25, shard_bytes=size, shard_places=size)
    assert sorted(map(tuple, got.collect())) == brute_phrases([r[1:3] for r in rows], 6, 25)
    assert {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}


def test_collocations_of_nothing(spark, make):
    assert collocations.collocations(make([])).count() == 0
    assert collocations.collocations(make([(1, None), (2, ""), (3, " . "), (4, "rare words only")])).count() == 0


def test_automaton_is_the_classes_of_end_places():
    rng = np.random.default_rng(3)
    for counted in (0, 3):
        codes = rng.integers(-1, 3, 80)
        ends = {}
        for p in range(len(codes)):
            for m in range(1, 6):
                if p - m + 1 >= 0 and (codes[p - m + 1 : p + 1] >= 0).all():
                    ends.setdefault(tuple(codes[p - m + 1 : p + 1].tolist()), set()).add(p)
        classes = {}
        for s, e in ends.items():
            if places := frozenset(x for x in e if x >= counted):
                classes.setdefault((places, s[-1]), []).append(len(s))
        a = collocations.automaton(codes, 3, 5, np.arange(80) < counted)
        got = sorted(zip(a.longest.tolist(), a.link.tolist(), a.places.tolist(), strict=True))
        # phrases that end at the same places are suffixes of one another, so a class is a run of lengths
        assert got == sorted((max(v), min(v) - 1, len(k[0])) for k, v in classes.items())


def test_collocations_products_beyond_64_bits(spark, make, monkeypatch):
    """Counts of 10**9 and more: the score is the exact floor."""
    a, n, left, right = 3_000_000_007, 40_000_000_000_001, 5_000_000_029, 7_000_000_001
    big = spark.createDataFrame([("en", "p q", 2, a), ("en", "p", 1, left), ("en", "q", 1, right)], "lang string, phrase string, words int, f long")
    monkeypatch.setattr(collocations, "phrases", lambda *_: (big, spark.createDataFrame([("en", n)], "lang string, n long")))
    row = collocations.collocations(make([])).first()
    assert row.score == 1000 * a * n // (left * right) and (row.a, row.l, row.r, row.n) == (a, left, right, n)


# exact dedup


def brute_copies(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(SPACES), []).append((-len(t or ""), i is None, i or 0, i))
    return {k: (min(v)[3], len(v), hashlib.sha256(k.encode()).hexdigest()) for k, v in groups.items()}


def check_copies(got, rows):
    groups = brute_copies(rows)
    assert len(got) == len(rows)
    kept = Counter()
    for r in got:
        keep, size, sha = groups[key := (r["text"] or "").translate(SPACES)]
        assert (r["keep_id"], r["group_size"], r["text_sha256"]) == (keep, size, sha)
        if r["kept"]:
            kept[key] += 1
            assert r["doc_id"] == keep
    assert kept == dict.fromkeys(groups, 1)


@pytest.mark.parametrize("ranges", [1, 2, 40])
def test_copies_match_brute_force(spark, make, ranges):
    rng = random.Random(ranges)
    rows = [(i, rng.choice(["same text", "same  text\n", "sametext", None, "", " \t", "same textual", "É x", "x" * 5000, f"own {i}", f"own {i // 3}"])) for i in range(400)]
    got = exact_dedup.mark_copies(make(rows, clash=True), ranges=ranges)
    check_copies(got.collect(), rows)
    stay = exact_dedup.drop_copies(make(rows, clash=True), ranges=ranges)
    assert stay.columns == make([], clash=True).columns and stay.count() == len(brute_copies(rows))
    assert all(r.kept == 7 for r in stay.select("kept").collect())


def test_one_group_is_cut_into_ranges(spark, make):
    """A text that all rows share is dealt out over many ranges, and still one group."""
    rows = [(i, "one text" + " " * (i % 5)) for i in range(1000)]
    d = make(rows)
    splitters = exact_dedup._splitters(d, "doc_id", "text", 50, 16)
    assert len(splitters) > 40 and len({s.rpartition(".")[0] for s in splitters}) == 1
    check_copies(exact_dedup.mark_copies(d, ranges=50).collect(), rows)


def test_copies_edges(spark, make):
    assert exact_dedup.mark_copies(make([])).count() == 0 and exact_dedup.drop_copies(make([])).count() == 0
    rows = [(None, "a b"), (3, "a b"), (2, "ab"), (None, "ab c"), (None, "abc"), (5, "z"), (5, "z"), (6, "q " * 300_000), (7, "qq" * 150_000)]
    got = exact_dedup.mark_copies(make(rows), ranges=3).collect()
    check_copies(got, rows)
    assert sum(r.kept for r in got) == 4


# hard negatives


def brute_negatives(rows, anchors, positives=5, negatives=3):
    q = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q[i] = ([math.floor(256 * float(np.float32(x))) for x in v], label)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a in sorted(x for x in q if anchors(x)):
        va, la = q[a]
        s = sorted((-dot(va, v), i, label) for i, (v, label) in q.items() if i != a)
        for ps, p, _ in [x for x in s if x[2] == la][:positives]:
            ok = [(ns, i) for ns, i, label in s if label != la and 50 * -ps <= 100 * -ns <= 95 * -ps]
            out += [(a, p, k + 1, i, -ps, -ns) for k, (ns, i) in enumerate(ok[:negatives])]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int, rank int, key string"


@pytest.mark.parametrize("how", [{}, {"dims": 3, "anchor_rows": 4, "block_rows": 20}, {"dims": 1, "anchor_rows": 1000, "block_rows": 5}])
def test_negatives_match_brute_force(spark, how):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=7) * 0.3 + 0.4 * (i % 3)).tolist(), int(min(rng.integers(0, 9), 4))) for i in range(240)]
    rows += [(240 + i, rows[3][1], 1) for i in range(12)] + [(260 + i, rows[4][1], i % 2) for i in range(9)]  # ties
    rows += [(300, None, 1), (301, [0.1] * 7, None), (302, [0.1, None] + [0.2] * 5, 1), (305, [math.nan] * 7, 1), (310, [math.inf] * 7, 2), (None, [0.2] * 7, 1), (315, [], 3), (320, [0.5, 0.5], 2), (325, [0.3] * 7, 77)]
    d = spark.createDataFrame([(*r, 1, "k") for r in rows], VECTORS)
    got = hard_negatives.mine(d.union(d.where("vec_id % 2 = 0")), "vec_id % 5 = 0", **how)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, lambda i: i % 5 == 0)


def test_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(empty, "vec_id % 5 = 0").count() == 0
    one = spark.createDataFrame([(5, [0.1], 1, 1, "k"), (6, [0.1], 2, 1, "k")], VECTORS)
    assert hard_negatives.mine(one, "vec_id % 5 = 0").count() == 0 and hard_negatives.mine(one, "false").count() == 0


def test_tiles_are_exact_beyond_doubles():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(2**26), 2**26, (5, 40)), rng.integers(-(2**26), 2**26, (6, 40))
    want = np.array([[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in b] for u in a])
    assert (hard_negatives.product(a, b) == want).all()
    for x in (want, a, a % 100, np.zeros((3, 0), np.int64)):
        assert (hard_negatives.unpacked(hard_negatives.packed(x), len(x)) == x).all()
