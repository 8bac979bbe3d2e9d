"""The operators' SQL on DuckDB, each by itself and in a row, as a second version of the queries and of the pipeline."""

import base64
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from test_text_ops import brute_base

from strandline.llm import fertility, queries


def connected(spark, small):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE TABLE {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def canonical(df):
    def value(v):
        return "" if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v) else format(v, ".9g") if isinstance(v, float) else str(v)

    return sorted(tuple(value(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, small, name):
    got, want = queries.QUERIES[name](spark, small).toPandas(), connected(spark, small).execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


def brute_quality(docs):
    """Rows that the fertility rules keep, text by text: tokens by plain encoding, bands by numpy."""
    import sentencepiece
    import tiktoken

    with open(f"{fertility.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        bpe = tiktoken.Encoding("b", pat_str=fertility.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    pieces = sentencepiece.SentencePieceProcessor(model_file=f"{fertility.TOKENIZERS}/piece_bpe_32k.model")
    rows = []
    for r in docs.itertuples():
        n, chars, _, _, again = brute_base(r.text)
        failed = n < 50 or 100 * again > 50 * n
        m = (0.0, 0.0, 0.0)
        if n:
            plain = " ".join(r.text.split())
            ids, sub = bpe.encode(" " + plain, disallowed_special=()), pieces.encode(plain)
            p = np.unique(ids, return_counts=True)[1] / len(ids)
            m = (chars + n) / len(ids), sum(map(pieces.is_byte, sub)) / len(sub), -(p * np.log2(p)).sum() / math.log2(len(ids)) if len(ids) > 1 else 0.0
        rows.append((r.Index, n, failed, "script:" + fertility.script_of(r.text or "") if r.lang is None else r.lang, fertility.script_of(r.text or ""), *m))
    t = pd.DataFrame(rows, columns=["at", "n", "failed", "band", "script", *fertility.LEAST_RANGE]).set_index("at")
    good = t[~t.failed]

    def fences(rows, c, wide):
        low, high = np.percentile(rows[c].round(3), [25, 75])
        by = fertility.FENCE * max(high - low, fertility.LEAST_RANGE[c]) * wide * math.sqrt(max(1, 50 / len(rows)))
        return low - by, high + by

    kept = []
    for r in good.itertuples():
        own = good[good.band == r.band]
        wide, ok = math.sqrt(max(1, fertility.EVEN_WORDS / r.n)), True
        for c in fertility.LEAST_RANGE:
            low, high = fences(own, c, wide)
            v = getattr(r, c)
            ok &= (c == "fallback_share" or v >= low) and (c == "token_entropy" or v <= high)
        if ok:
            kept.append(r.Index)
    return docs.loc[kept]


def test_verdicts_match_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = fertility.keep_good(docs).toPandas()
    assert sorted(got["doc_id"]) == sorted(brute_quality(docs.toPandas())["doc_id"])


def first_words(text, n):
    out = text
    while len(out.split()) > n:
        out = out[: out.rindex(out.split()[-1])].rstrip(" \t\n\v\f\r")
    return out


def test_pipeline_matches_brute_force(spark, small):
    import corpus_pipeline as cp

    con = connected(spark, small)
    docs = brute_quality(spark.read.parquet(f"{small}/documents.parquet").toPandas())

    def result(name):
        con.execute("DROP TABLE IF EXISTS documents")
        con.register("rows", docs)
        con.execute("CREATE TABLE documents AS SELECT * FROM rows")
        return con.execute(queries.ORACLE_SQL[name]).df()

    cut = result("op6_line_dedup").set_index("doc_id")
    docs["text"] = docs["doc_id"].map(cut["text"])
    docs["n_chars"] = docs["text"].str.len()
    docs = docs[docs["text"].str.strip(" \t\n\v\f\r").ne("")]
    cls = result("op2_ngram_join").set_index("doc_id")["class_id"]
    docs = docs[docs["doc_id"].map(cls) == docs["doc_id"]]
    docs = docs[~docs["doc_id"].isin(result("op10_decontamination")["doc_id"])]
    taken = result("op8_mixing").set_index("doc_id")
    want = []
    for r in docs.itertuples():
        t, left = taken.loc[r.doc_id], int(taken.loc[r.doc_id].taken)
        for copy, at in ((1, t.first_position), (2, t.second_position)):
            if not pd.isna(at):
                words = min(int(t["size"]), left)
                left -= words
                text = first_words(r.text, words) if words < t["size"] else r.text
                want.append((r.doc_id, copy, words, text, len(text), f"{at:.6f}"))
    got = cp.run(spark, small)
    mix = got.toPandas()
    assert sorted(zip(mix.doc_id, mix["copy"], mix.words, mix.text, mix.n_chars, mix.position.map("{:.6f}".format), strict=True)) == sorted(want)
    assert mix.position.is_monotonic_increasing or got.rdd.getNumPartitions() > 1


def test_stages_handle_edges(spark, make, small):
    import corpus_pipeline as cp

    words = " ".join(f"word{i}" for i in range(80))
    rows = [(1, None, None, None), (2, ""), (3, " \n "), (None, words), (4, words, None, None), (4, words, None, None), (5, "\n".join(f"line {i} of a text" for i in range(200))), (6, "x " * 100_000)]
    for d in (make(rows, clash=True), make([]).drop("n_chars")):
        for k, (_, stage) in enumerate(cp.STAGES):
            out = stage(spark, d, small)
            n = out.count()
            if k < 4:
                assert out.columns == d.columns and n <= d.count()
