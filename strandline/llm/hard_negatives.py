"""Hard negatives by a two-dimensional block matrix multiply.

Vectors become small integers and are dealt into blocks: anchors into blocks of rows, all vectors into blocks of rows of
one label (labels of few rows share blocks). Each block is cut into chunks of dimensions. Every pair of an anchor
block and a row block gives one partial tile of scores per chunk; tiles of a pair are shuffled together and added as
64-bit integers. Tiles within a label give each anchor's positives; tiles between labels give, for each window of
scores that an anchor's positives open, the best negatives. Only these few rows per tile go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import if_small, written

#: Anchors and rows of a block, on average, and dimensions of a chunk.
ANCHORS, ROWS, DIMS = 1024, 4096, 32
#: Components of this size or more, scaled, have no place in 64-bit scores.
LARGEST = 2**27

_BLOCK = "side int, i int, g long, s int, k int, ids binary, keys binary, labels binary, x binary, wins binary"
_TILE = "i int, g long, s int, k int, na int, nb int, a binary, b binary, wins binary, x binary"


def packed(x: np.ndarray) -> bytes:
    """A matrix of integers in the narrowest of three types, its bytes apart by place, compressed: sign and high bytes
    take next to no room."""
    top = int(np.abs(x).max(initial=0))
    kind = next(t for t, most in (("<i2", 2**15), ("<i4", 2**31), ("<i8", 2**63)) if top < most)
    flat = np.ascontiguousarray(x, dtype=kind).reshape(-1).view(np.uint8).reshape(-1, int(kind[2]))
    return kind.encode() + zstandard.compress(flat.T.tobytes(), 1)


def unpacked(b: bytes, rows: int) -> np.ndarray:
    """The matrix as int64."""
    kind = b[:3].decode()
    planes = np.frombuffer(zstandard.decompress(b[3:]), np.uint8).reshape(int(kind[2]), -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(rows, -1 if planes.size else 0).astype(np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exact: in doubles where no sum can pass 2**53, else in 64-bit integers."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.einsum("ik,jk->ij", a, b)


def first_best(score: np.ndarray, ids: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Places of the n highest scores, highest first, ties by id, then by key."""
    if len(score) > n:
        least = np.partition(score, len(score) - n)[len(score) - n]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((keys[at], ids[at], -score[at]))[:n]]


def _blocks(chunks: int, dims: int, side: int):
    def block(g: pd.DataFrame) -> pd.DataFrame:
        width = chunks * dims
        x = np.zeros((len(g), width), np.int64)
        for r, v in enumerate(g["q"]):
            x[r, : len(v)] = v
        head = [g[c].to_numpy(np.int64).tobytes() for c in ("id", "key", "label")]
        i, gg, s = (int(g[c].iloc[0]) for c in ("i", "g", "s"))
        rows = [(side, i, gg, s, k, *(head if k == 0 else [None, None, head[2]]), packed(x[:, k * dims : (k + 1) * dims]), None) for k in range(chunks)]
        return pd.DataFrame(rows, columns=[f.split()[0] for f in _BLOCK.split(", ")])

    return block


def _chosen(a_labels: np.ndarray, b_labels: np.ndarray, within: bool) -> np.ndarray:
    """Which anchors of a block meet a block of rows: those that share a label with it, or those that don't share all."""
    own = np.unique(b_labels)
    return np.isin(a_labels, own) if within else (np.ones(len(a_labels), bool) if len(own) != 1 else a_labels != own[0])


def _partial(within: bool):
    def tiles(g: pd.DataFrame) -> pd.DataFrame:
        """Of one anchor block and the row blocks of one slot, in one chunk of dimensions: a partial tile for each row block."""
        anchors, rows = g[g["side"] == 0], g[g["side"] == 1]
        out = []
        if len(anchors) and len(rows):
            a = anchors.iloc[0]
            labels = np.frombuffer(a["labels"], np.int64)
            x = unpacked(a["x"], len(labels))
            for b in rows.itertuples():
                own = np.frombuffer(b.labels, np.int64)
                if not (at := np.flatnonzero(_chosen(labels, own, within))).size:
                    continue
                first = a["k"] == 0
                heads = [None, None, None]
                if first:
                    ids, keys = (np.frombuffer(a[c], np.int64)[at] for c in ("ids", "keys"))
                    heads = [np.concatenate([ids, keys, labels[at]]).tobytes(), b.ids + b.keys + b.labels, a["wins"]]
                out.append((a["i"], b.g, b.s, a["k"], len(at), len(own), *heads, packed(product(x[at], unpacked(b.x, len(own))))))
        return pd.DataFrame(out, columns=[f.split()[0] for f in _TILE.split(", ")])

    return tiles


def _summed(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Heads of anchors and rows (id, key, label) and the whole tile: partial ones added."""
    na, nb = int(g["na"].iloc[0]), int(g["nb"].iloc[0])
    total = np.zeros((na, nb), np.int64)
    for x in g["x"]:
        total += unpacked(x, na)
    head = g[g["k"] == 0].iloc[0]
    wins = np.frombuffer(head["wins"] or b"", np.int64).reshape(-1, 4)
    return np.frombuffer(head["a"], np.int64).reshape(3, na), np.frombuffer(head["b"], np.int64).reshape(3, nb), total, wins


def _positives(n: int):
    def best(g: pd.DataFrame) -> pd.DataFrame:
        a, b, score, _ = _summed(g)
        out = []
        for r in range(a.shape[1]):
            at = np.flatnonzero((b[2] == a[2, r]) & (b[0] != a[0, r]))
            at = at[first_best(score[r, at], b[0, at], b[1, at], n)]
            out += zip([a[0, r]] * len(at), [a[1, r]] * len(at), b[0, at], b[1, at], score[r, at], strict=True)
        return pd.DataFrame(out, columns=["anchor_id", "anchor_key", "positive_id", "positive_key", "positive_score"])

    return best


def _negatives(n: int, low: int, high: int):
    def best(g: pd.DataFrame) -> pd.DataFrame:
        a, b, score, wins = _summed(g)
        place = {(i, k): r for r, (i, k) in enumerate(zip(a[0].tolist(), a[1].tolist(), strict=True))}
        one = len(np.unique(b[2])) == 1  # a block of one label, which none of these anchors has
        out, row, r0 = [], None, -1
        for w, (i, k, p, _) in enumerate(wins.tolist()):
            if (r := place.get((i, k))) is None:
                continue
            if r != r0:
                row, r0 = 100 * score[r], r
            ok = (row >= low * p) & (row <= high * p)
            at = np.flatnonzero(ok if one else ok & (b[2] != a[2, r]))
            at = at[first_best(score[r, at], b[0, at], b[1, at], n)]
            out += zip([w] * len(at), b[0, at], b[1, at], score[r, at], strict=True)
        w = wins[[x[0] for x in out]] if out else wins[:0]
        more = pd.DataFrame(out, columns=["w", "negative_id", "negative_key", "negative_score"]).drop(columns="w")
        return pd.DataFrame({"anchor_id": w[:, 0], "anchor_key": w[:, 1], "positive_score": w[:, 2], "window": w[:, 3]}).join(more)

    return best


def quantised(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """id, label, q (array of long), key, of the rows that take part, each once."""
    x = F.col(f"`{vector_col}`")
    fit = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    sound = F.forall(x, lambda v: F.coalesce(~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < LARGEST / scale), F.lit(False)))
    d = vectors.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull() & x.isNotNull() & sound)
    d = d.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), fit.alias("q")).distinct()
    return d.withColumn("key", F.xxhash64("id", "label", "q"))


def mine(vectors: DataFrame, anchors: Column | str, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, dims: int = DIMS, anchor_rows: int = ANCHORS, block_rows: int = ROWS) -> DataFrame:
    """anchor_id, positive_id, rank (int, from 1), negative_id, positive_score, negative_score (long).

    A score is the inner product of the integers floor(scale * component). Of the rows that ``anchors`` (a condition on
    the input's columns) selects, each one's positives are its ``positives`` best other rows of the same label, and
    its negatives for one of them the best ``negatives`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score. Higher scores first, ties by smaller id.

    - Rows with a null id, label or vector, a null or non-finite component, or one of 2**27 / scale or more, take no part.
    - Rows alike in id, label and vector are one row. Rows that share an id but differ are each a row; a row of an
      anchor's own id is not its positive; ties of one id go by a hash of the row.
    - Vectors of fewer components than the longest one are filled with zeros. Empty vectors score 0.
    - An anchor without another row of its label gives no rows, nor does a positive with nothing in its window (as for
      scores below zero). An empty table gives an empty result. Other columns play no part.

    Blocks are dealt by hash of the whole row, so their sizes stay near ``anchor_rows`` and ``block_rows`` whatever the
    labels' sizes. The work, and the scores shuffled (some two bytes each and chunk), grow with anchors times rows.
    """
    is_anchor = F.expr(anchors) if isinstance(anchors, str) else anchors
    taken = vectors.where(F.coalesce(is_anchor, F.lit(False)))
    q = quantised(vectors, id_col, vector_col, label_col, scale)
    counts = written(q.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("q")).alias("d")), "negatives-labels")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("d"), F.lit(0)).alias("d"), F.coalesce(F.sum(F.when(F.col("n") < block_rows, F.col("n"))), F.lit(0)).alias("few")).first()
    chunks, shared = max(1, -(-total["d"] // dims)), max(1, -(-total["few"] // block_rows))
    # g: a label of many rows, or (negative) one of the groups that labels of few rows share
    few = F.col("n") < block_rows
    place = counts.select("label", F.when(few, -1 - F.pmod(F.xxhash64("label"), F.lit(shared))).otherwise(F.abs(F.xxhash64(F.lit(7), "label") % (2**62))).alias("g"), F.when(few, 1).otherwise(F.ceil(F.col("n") / block_rows)).alias("_b"))
    rows = q.join(if_small(place), "label").withColumns({"i": F.lit(0), "s": F.pmod("key", "_b").cast("int")}).drop("_b")
    blocks = written(rows.groupBy("g", "s").applyInPandas(_blocks(chunks, dims, 1), _BLOCK), "negatives-rows")
    a = quantised(taken, id_col, vector_col, label_col, scale)
    n_anchor_blocks = max(1, -(-a.count() // anchor_rows))
    a = a.withColumns({"i": F.pmod("key", F.lit(n_anchor_blocks)).cast("int"), "g": F.lit(0).cast("long"), "s": F.lit(0)})
    a = written(a.groupBy("i").applyInPandas(_blocks(chunks, dims, 0), _BLOCK), "negatives-anchors")
    slots = max(1, blocks.count() // chunks)

    def tiles(heads: DataFrame, within: bool) -> DataFrame:
        """A row per pair of blocks and chunk. Anchor blocks go to every slot, row blocks to their own, once per anchor block."""
        slot = F.pmod(F.xxhash64("g", "s"), F.lit(slots)).cast("int")
        left = heads.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
        right = blocks.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_anchor_blocks - 1)))).withColumn("slot", slot)
        return left.unionByName(right).groupBy("i", "slot", "k").applyInPandas(_partial(within), _TILE).groupBy("i", "g", "s")

    found = tiles(a, True).applyInPandas(_positives(positives), "anchor_id long, anchor_key long, positive_id long, positive_key long, positive_score long")
    w = Window.partitionBy("anchor_id", "anchor_key").orderBy(F.desc("positive_score"), "positive_id", "positive_key")
    found = written(found.withColumn("window", F.row_number().over(w).cast("long")).where(F.col("window") <= positives), "negatives-positives")
    four = F.array("anchor_id", "anchor_key", "positive_score", "window")
    wins = found.groupBy(F.pmod("anchor_key", F.lit(n_anchor_blocks)).cast("int").alias("i")).agg(F.sort_array(F.collect_list(four)).alias("_w"))  # a block's anchors only
    wins = wins.select("i", F.flatten("_w").alias("_w")).mapInPandas(_as_bytes, "i int, _w binary")
    heads = a.where("k = 0").drop("wins").join(wins, "i", "left").withColumnRenamed("_w", "wins").unionByName(a.where("k <> 0"))
    chosen = tiles(heads, False).applyInPandas(_negatives(negatives, low, high), "anchor_id long, anchor_key long, positive_score long, window long, negative_id long, negative_key long, negative_score long")
    w = Window.partitionBy("anchor_id", "anchor_key", "window").orderBy(F.desc("negative_score"), "negative_id", "negative_key")
    chosen = chosen.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= negatives)
    named = found.select("anchor_id", "anchor_key", "window", "positive_id")
    out = chosen.join(named, ["anchor_id", "anchor_key", "window"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _as_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"i": b["i"], "_w": [np.asarray(x, np.int64).tobytes() for x in b["_w"]]})
