"""Quality rules by tokeniser fertility.

Public vocabularies tell odd text from usual text of its language: how many characters a token covers, what share of
the tokens are single bytes that the vocabulary has no piece for, and how evenly tokens are used. Every text is
measured; per language (or script, where the language isn't known) bands around the quartiles of all measured texts
decide, wider ones where texts are few. Simple counts of words, symbols, repeated lines and repeated word windows come along as base rules.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, if_small, row_key, unboxed, written

TOKENIZERS = "/opt/tokenizers"
SYMBOLS = "#*$%&|<>"
#: Fences: quartiles plus or minus this many interquartile ranges, each at least so wide; texts of fewer words than
#: EVEN_WORDS get wider ones, by the square root of what they lack, as a mean over fewer tokens scatters more. FENCE is the
#: narrowest of 1.25, 1.5, 2, 2.5, 3 and 3.5 that rejected at most 0.2 % of the good texts in one half of the labels of sf0.1.
FENCE = 2.5
LEAST_RANGE = {"chars_per_token": 0.05, "fallback_share": 0.02, "token_entropy": 0.03}
EVEN_WORDS = 300
#: The fences of a language (or script) of fewer measured texts are wider by the square root of what it lacks of them, as quartiles of
#: few texts scatter more: the same rule at every size, the language's own texts alone.
LEAST_TEXTS = 50
#: The pre-token pattern of the byte-level vocabulary; fixed value, public.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SCRIPTS = (("Latin", "A-Za-zÀ-ɏ"), ("Greek", "Ͱ-Ͽ"), ("Cyrillic", "Ѐ-ԯ"), ("Hebrew", "֐-׿"), ("Arabic", "؀-ۿ"), ("Devanagari", "ऀ-ॿ"), ("Kana", "぀-ヿ"), ("Han", "㐀-鿿"), ("Hangul", "가-힯"))
_loaded: dict[str, "Fertility"] = {}


class Fertility:
    """The two vocabularies of a folder."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        import tiktoken

        with open(f"{path}/byte_bpe_50k.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=f"{path}/piece_bpe_32k.model")
        self.bytes = {i for i in range(self.pieces.get_piece_size()) if self.pieces.is_byte(i)}
        self.known: dict[str, bool] = {}

    def tokens(self, text: str) -> np.ndarray:
        return self.bpe.encode_to_numpy(text, allowed_special=set(), disallowed_special=())

    def fallback(self, text: str) -> float:
        """Share of byte pieces. Only a character without a piece of its own becomes bytes, so a text without any has none
        and isn't encoded."""
        for c in set(text):
            if c not in self.known:
                self.known[c] = not self.bytes.intersection(self.pieces.encode(c))
            if not self.known[c]:
                break
        else:
            return 0.0
        ids = self.pieces.encode(text)
        return sum(i in self.bytes for i in ids) / max(1, len(ids))


def script_of(text: str) -> str:
    """The script with the most letters; 'none' without any of _SCRIPTS."""
    letters = "".join(set(text))
    there = [(name, r) for name, r in _SCRIPTS if re.search(f"[{r}]", letters)]
    if len(there) < 2:
        return there[0][0] if there else "none"
    return max((len(re.findall(f"[{r}]", text)), name) for name, r in there)[1]


def measure(text: str | None, fertility: Fertility) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars_per_token, fallback_share, token_entropy (last three None without words)."""
    text = text or ""
    ws = _WORD.findall(text)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    if not ws:
        return 0, 0, symbols, 0, 0, None, None, None
    local = {w: i for i, w in enumerate(dict.fromkeys(ws))}
    ids = np.fromiter(map(local.__getitem__, ws), dtype=np.int64, count=len(ws))
    n, m = len(ws), len(local)
    repeated = 0
    if n > 2 and m < n:
        if m < 2_000_000:
            key = (ids[:-2] * m + ids[1:-1]) * m + ids[2:]
        else:
            key = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]]), axis=1, return_inverse=True)[1].ravel()
        _, at, count = np.unique(key, return_inverse=True, return_counts=True)
        again = count[at] > 1
        cover = np.zeros(n, dtype=bool)
        for k in range(3):
            cover[k : n - 2 + k] |= again
        repeated = int(cover.sum())
    plain = " ".join(ws)
    counts = np.unique(fertility.tokens(" " + plain), return_counts=True)[1].astype(np.float64)
    total = counts.sum()
    share = counts / total
    entropy = float(-(share * np.log2(share)).sum() / np.log2(total)) if total > 1 else 0.0
    chars = sum(map(len, ws))
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, (chars + n) / float(total), fertility.fallback(plain), entropy


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars_per_token double, fallback_share double, token_entropy double"


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", path: str = TOKENIZERS) -> DataFrame:
    """id, _k1, _k2, ``band`` (lang, or else the script), ``script`` and MEASURES per row. path: the vocabularies' folder on every worker."""
    d = docs.select(F.col(id_col).alias("_id"), *row_key(id_col, text_col), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if path not in _loaded:
            _loaded[path] = Fertility(path)
        f = _loaded[path]
        names = [x.split()[0] for x in MEASURES.split(", ")]
        for b in batches:
            rows = pd.DataFrame([measure(t, f) for t in b["_text"]], columns=names)
            out = b[["_id", "_k1", "_k2"]].reset_index(drop=True)
            out["script"] = [script_of(t or "") for t in b["_text"]]
            out["band"] = [x if x is not None else "script:" + y for x, y in zip(b["_lang"], out["script"], strict=True)]
            for c in names:
                out[c] = rows[c].astype("float64" if c in LEAST_RANGE else "int64")
            yield out

    kind = d.schema["_id"].dataType.simpleString()
    return d.mapInPandas(run, f"_id {kind}, _k1 long, _k2 int, script string, band string, {MEASURES}").withColumnRenamed("_id", id_col)


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", path: str = TOKENIZERS, fence: float = FENCE, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """measures() plus ``base_failed`` and ``kept``.

    base_failed: under ``least_words`` words, or over ``most_repeated`` percent of them in repeated windows. kept: not
    that, and every measure within the bands of the row's language or script: the quartiles of all rows that pass the
    base rules, plus or minus ``fence`` interquartile ranges, wider for short texts and for languages of few such rows (values rounded to
    thousandths, so that the exact quartiles need a bounded table). Bands come from all rows; nothing is sampled, no row goes
    unjudged, and none is judged by another language or script.

    Null and empty texts have no words and fail; values on a fence stay; long texts and words are measured whole. Null lang: by
    script. A language of one text is kept, if the base rules pass it. Rows alike in id and text are measured alike.
    Other columns play no part. An empty table gives an empty result.
    """
    names = list(LEAST_RANGE)
    m = written(measures(docs, id_col, text_col, lang_col, path), "fertility")
    m = m.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words")))
    quart = F.array(F.lit(0.25), F.lit(0.75))
    use = m.where(~F.col("base_failed")).select("band", *[F.round(c, 3).alias(c) for c in names])
    bands = use.groupBy("band").agg(F.count(F.lit(1)).alias("_n"), *[F.percentile(c, quart).alias(c) for c in names])
    spread = {c: F.greatest(F.col(c)[1] - F.col(c)[0], F.lit(least)) for c, least in LEAST_RANGE.items()}
    few = F.sqrt(F.greatest(F.lit(1.0), F.lit(float(LEAST_TEXTS)) / F.col("_n")))
    bands = written(bands.select("band", *[F.struct(F.col(c)[0].alias("low"), F.col(c)[1].alias("high"), (fence * few * spread[c]).alias("by")).alias(f"_{c}") for c in names]), "fertility-bands")
    j = m.join(if_small(bands), "band", "left")
    ok, wider = F.lit(True), F.sqrt(F.greatest(F.lit(1.0), F.lit(float(EVEN_WORDS)) / F.greatest(F.lit(1), F.col("n_words"))))
    for c in names:
        own = F.col(f"_{c}")
        if c != "fallback_share":
            ok = ok & (F.col(c) >= own["low"] - wider * own["by"])
        if c != "token_entropy":
            ok = ok & (F.col(c) <= own["high"] + wider * own["by"])
    return j.withColumn("kept", ~F.col("base_failed") & F.coalesce(ok, F.lit(False))).select(*m.columns, "kept")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """docs without the rows that the rules reject. Only the rejected rows' keys travel, or are joined by a shuffle if many."""
    bad = written(verdicts(docs, id_col, text_col, lang_col, **how).where(~F.col("kept")).select("_k1", "_k2").distinct(), "fertility-rejected")
    return boxed(docs, id_col, text_col).join(if_small(bad), ["_k1", "_k2"], "left_anti").select(*unboxed(docs.columns))
