"""Personal data: base patterns, secrets, and information-theoretic sanitisation of what gives them away, with DataFrame functions only.

A protected entity is a value that a base pattern finds (one address, one number) or a secret (a long string of high
entropy). All words of the texts are terms. Over the distinct texts of the corpus, the pointwise mutual information of a
term and an entity, as a share of the entity's own information, says how much the term gives away: PMI(e, t) / IC(e) = 1
if the term never occurs without the entity, 0 if it says nothing. Terms beyond ``generalise`` are replaced by a word
that says what kind of term it was, beyond ``remove`` dropped, wherever they stand in a text that holds the entity.

Entities of the same texts are one for this purpose, and so are terms of the same texts: they share their counts. What
is paired within a text are these classes, and only of terms rare enough for the commonest entity of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, if_small, row_key, unboxed, written

#: Base kinds in their order. The patterns find what the contract's do, but never scan a run of characters twice:
#: possessive quantifiers, and no start inside a run whose start has failed (\\G: right after the match before).
#: Runs of under 12 digits are no card, so the pattern asks for 12.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A secret: so many characters of keys and tokens, with digits among them and no long run of small letters as words have, and
#: so many bits a character.
SECRET = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
LEAST_BITS = 3.0
_HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){11}", "phone": "+", "secret": SECRET}
#: Terms, as hashes of 8 bytes, up to which they are broadcast to find them in all texts (some 30 MB); else texts' words are shuffled.
BROADCAST_HASHES = 1_000_000
#: A term is a run of letters, marks and digits, in lower case: of the word alone, which may have more code points than it.
TERM = r"[\p{L}\p{M}\p{N}]+"


#: Matches of a block, in finding where matches start.
BLOCK = 64


def _starts(matches: Column, pieces: Column) -> Column:
    """The code point at which each match starts, from the matches and the pieces between them: sums over blocks of matches,
    then within the block, so time grows with their number."""
    n, zero = F.size(matches), F.lit(0).cast("long")
    total = lambda a: F.aggregate(a, zero, lambda x, y: x + y)
    step = F.transform(_indices(matches), lambda i: (F.char_length(F.get(pieces, i)) + F.char_length(F.get(matches, i))).cast("long"))

    def placed(steps: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: total(F.slice(steps, b * BLOCK + 1, BLOCK)))
        grow = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        before = F.aggregate(sums, F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out")), grow, lambda acc: acc["out"])

        def at(offsets: Column) -> Column:
            block = lambda i: F.floor(i / BLOCK).cast("int")
            return F.transform(_indices(matches), lambda i: (F.get(offsets, block(i)) + total(F.slice(steps, block(i) * BLOCK + 1, i % BLOCK)) + F.char_length(F.get(pieces, i))).cast("int"))

        return F.transform(F.array(before), at)[0]

    return F.when(n > 0, F.transform(F.array(step), placed)[0]).otherwise(F.array().cast("array<int>"))


def _indices(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))


def entropy(v: Column) -> Column:
    """Bits a character."""
    n = F.char_length(v)
    share = lambda c: (n - F.char_length(F.replace(v, c, F.lit("")))) / n
    return -F.aggregate(F.array_remove(F.array_distinct(F.split(v, "")), ""), F.lit(0.0), lambda acc, c: acc + share(c) * F.log2(share(c)))


def _valid(kind: str, v: Column) -> Column:
    if kind == "secret":
        return v.rlike("[0-9].*[0-9].*[0-9].*[0-9]") & v.rlike("[A-Za-z]") & ~v.rlike("[a-z]{7}") & (entropy(v) >= LEAST_BITS)
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
        return v.rlike(rf"^{part}(?:\.{part}){{3}}$")
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "card":
        back = F.reverse(digits)
        d = F.transform(F.sequence(F.lit(1), F.length(back)), lambda i: F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
        total = F.aggregate(F.transform(d, lambda x: F.when(x > 9, x - 9).otherwise(x)), F.lit(0), lambda a, x: a + x)
        return F.length(digits).between(12, 19) & (total % 10 == 0)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _found(no: int, kind: str) -> Column:
    """The valid matches of a kind, from the columns _m, _p and _s of that kind."""
    m, starts = F.col(f"_m{no}"), F.col(f"_s{no}")

    def one(i: Column) -> Column:
        v = F.get(m, i)
        entity = F.xxhash64(F.lit(kind), F.lower(v) if kind in ("email", "ip") else v if kind == "secret" else F.regexp_replace(v, "[^0-9]", ""))
        return F.struct(F.get(starts, i).alias("start"), F.lit(no).alias("no"), (F.get(starts, i) + F.char_length(v)).alias("end"), F.lit(kind).alias("kind"), entity.alias("entity"), v.alias("value"))

    return F.filter(F.transform(_indices(m), one), lambda z: _valid(kind, z["value"]))


def terms_of(text: Column) -> Column:
    """Distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, _k1, _k2, _kt (hashes), ``base`` (array of start, no, end, kind, entity; secrets come last) and, if it isn't empty, ``_terms``."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col), *row_key(id_col, text_col), F.xxhash64(t).alias("_kt"), t.alias("_t"))
    none = F.array().cast("array<string>")
    kinds = KINDS | {"secret": SECRET}
    for no, (kind, pattern) in enumerate(kinds.items()):
        hint = F.contains(F.col("_t"), F.lit(_HINT[kind])) if kind in ("email", "phone") else F.col("_t").rlike(_HINT[kind])
        d = d.withColumn(f"_h{no}", hint)
        d = d.withColumns({f"_m{no}": F.when(F.col(f"_h{no}"), F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))).otherwise(none), f"_p{no}": F.when(F.col(f"_h{no}"), F.split("_t", pattern, -1)).otherwise(none)})
    d = d.withColumns({f"_s{no}": _starts(F.col(f"_m{no}"), F.col(f"_p{no}")) for no in range(len(kinds))})
    d = d.withColumn("_all", F.concat(*[_found(no, kind) for no, kind in enumerate(kinds)]))
    d = d.withColumn("base", F.array_sort(F.transform("_all", lambda s: F.struct(s["start"], s["no"], s["end"], s["kind"], s["entity"]))))
    return d.select(id_col, "_k1", "_k2", "_kt", "base", F.when(F.size("base") > 0, terms_of(F.col("_t"))).alias("_terms"))


def _share(et: str, e: str, t: str) -> Column:
    """PMI / IC from the counts of texts with both, with the entity, with the term, and of all (_n); null for an entity in all texts."""
    return F.try_divide(F.log2(F.col(et) * F.col("_n") / (F.col(e) * F.col(t))), F.log2(F.col("_n") / F.col(e)))


def disclosures(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = 0.9, support: int = 3) -> DataFrame:
    """(_kt, term, share) of the terms that give away an entity of the text: PMI / IC of at least ``generalise``, and at
    least ``support`` distinct texts hold both. Counts are over all distinct texts.

    A term in t texts and an entity in e of n can reach the share g only if t <= e^g n^(1-g); what is rarer goes on.
    """
    n = F.broadcast(found.select("_kt").distinct().agg(F.count(F.lit(1)).alias("_n")))  # one row
    held = found.where(F.size("base") > 0).select("_kt", F.explode("base.entity").alias("entity")).distinct()
    entities = held.groupBy("entity").agg(F.count(F.lit(1)).alias("_e"), F.bit_xor(F.xxhash64("_kt")).alias("_ev")).where(F.col("_e") >= support)
    held = written(held.join(entities, "entity").join(n).where("_e < _n").select("_kt", "_ev", "_e", "_n").distinct(), "pii-held")
    reach = lambda e: F.pow(F.col(e), generalise) * F.pow(F.col("_n"), 1 - generalise) + 1e-6
    top = held.groupBy("_kt").agg(F.max("_e").alias("_top"), F.max("_n").alias("_n"))
    words = written(found.where(F.size("base") > 0).select("_kt", "_terms").join(if_small(top), "_kt").select("_kt", "_top", "_n", F.explode("_terms").alias("term")).distinct(), "pii-words")
    # texts with the term among those with an entity are a lower bound of those with the term: what it rules out needs no count
    terms = words.groupBy("term").agg(F.count(F.lit(1)).alias("_t"), F.bit_xor(F.xxhash64("_kt")).alias("_tv")).where(F.col("_t") >= support)
    words = written(words.join(terms, "term").where(F.col("_t") <= reach("_top")).select("_kt", "term", "_tv", "_t"), "pii-rare")
    pairs = words.select("_kt", "_tv", "_t").distinct().join(held, "_kt").where(F.col("_t") <= reach("_e"))
    pairs = pairs.groupBy("_ev", "_e", "_tv", "_t", "_n").agg(F.count(F.lit(1)).alias("_et")).where((F.col("_et") >= support) & (_share("_et", "_e", "_t") >= generalise))
    pairs = written(pairs.join(words.select("_tv", "term").distinct(), "_tv").select("_ev", "_e", "_et", "_n", "term"), "pii-pairs")
    pairs = pairs.withColumn("_h", F.xxhash64("term"))
    # a text counts once: rows weigh 1, but for copies, of which only those of one key count, together as one
    keys = found.groupBy("_kt", "_k1", "_k2").agg(F.count(F.lit(1)).alias("_r"))
    one = keys.groupBy("_kt").agg(F.sum("_r").alias("_m"), F.min(F.struct("_k1", "_k2")).alias("_rep")).where("_m > 1")
    copies = keys.join(one, "_kt").select("_k1", "_k2", F.when(F.struct("_k1", "_k2") == F.col("_rep"), 1 / F.col("_r")).otherwise(0.0).alias("_weight"))
    texts = docs.where(F.col(text_col).isNotNull()).select(*row_key(id_col, text_col), F.col(text_col).alias("_t"))
    texts = texts.join(if_small(written(copies, "pii-copies")), ["_k1", "_k2"], "left").where("_weight is null or _weight > 0")
    bag = texts.select(F.coalesce("_weight", F.lit(1.0)).alias("_weight"), F.explode(terms_of(F.col("_t"))).alias("term")).select("_weight", F.xxhash64("term").alias("_h"))
    of_term = bag.join(if_small(pairs.select("_h").distinct(), BROADCAST_HASHES), "_h", "left_semi").groupBy("_h").agg(F.round(F.sum("_weight")).alias("_t"))
    told = pairs.join(of_term, "_h").withColumn("share", _share("_et", "_e", "_t")).where(F.col("share") >= generalise).select("_ev", "term", "share")
    told = written(told, "pii-told")
    here = words.join(if_small(told.select("term").distinct()), "term", "left_semi").select("_kt", "term").join(held.select("_kt", "_ev"), "_kt")
    return here.join(if_small(told), ["_ev", "term"]).groupBy("_kt", "term").agg(F.max("share").alias("share"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = 0.9, remove: float = 0.98, support: int = 3) -> DataFrame:
    """Per row of docs: id, _k1, _k2 and ``found``, an array of (start, no, end, kind, action) sorted by start, then kind.

    Kinds: email, ip, card, phone, secret (action mask), and term (action generalise or remove): every occurrence, outside
    the other spans, of a word that gives away an entity of the text. Offsets are code points, end exclusive. Base
    spans never change.

    Null and empty texts have no spans. Rows alike in id and text have the same spans. Entities and terms of texts
    that are exact copies count once. A term that gives away several entities counts with its largest share. Long texts
    are searched whole. Other columns play no part. An empty table gives an empty result.
    """
    found = written(find(docs, id_col, text_col), "pii-found")
    told = written(disclosures(docs, found, id_col, text_col, generalise, support), "pii-texts")
    key = ["_k1", "_k2"]
    d = docs.select(*row_key(id_col, text_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_kt"), F.col(text_col).alias("_t"))
    d = d.join(if_small(written(told.select("_kt").distinct(), "pii-telling")), "_kt", "left_semi").dropDuplicates(key)
    d = d.select(*key, "_kt", F.regexp_extract_all("_t", F.lit(TERM), F.lit(0)).alias("_m"), F.split("_t", TERM, -1).alias("_p"))
    # a row per word of the texts that have something to hide, joined with what is to be hidden there
    at = d.select(*key, "_kt", F.explode(F.arrays_zip(F.col("_m").alias("m"), _starts(F.col("_m"), F.col("_p")).alias("s"))).alias("_w"))
    at = at.select(*key, "_kt", F.col("_w.s").alias("start"), (F.col("_w.s") + F.char_length("_w.m")).alias("end"), F.lower("_w.m").alias("term"))
    hits = at.join(if_small(told), ["_kt", "term"]).select(*key, "start", "end", "share")
    # those that meet a base span are left: of base spans that start before a word ends, does the furthest reach into it
    based = found.where(F.size("base") > 0).dropDuplicates(key).join(if_small(written(d.select(*key), "pii-rows")), key, "left_semi")
    based = based.select(*key, F.explode("base").alias("_b")).select(*key, F.col("_b.start").alias("start"), F.col("_b.end").alias("end"), F.lit(None).cast("double").alias("share"))
    own = F.col("share").isNotNull()
    w = Window.partitionBy(*key).orderBy(F.when(own, F.col("end")).otherwise(F.col("start")), F.when(own, 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    free = hits.unionByName(based).withColumn("_reach", F.max(F.when(~own, F.col("end"))).over(w)).where(own & F.coalesce(F.col("_reach") <= F.col("start"), F.lit(True)))
    put = F.struct("start", F.lit(len(KINDS) + 1).alias("no"), "end", F.lit("term").alias("kind"), F.when(F.col("share") >= remove, "remove").otherwise("generalise").alias("action"))
    add = free.groupBy(*key).agg(F.collect_list(put).alias("_add"))  # a text's own words
    base = F.transform("base", lambda b: F.struct(b["start"], b["no"], b["end"], b["kind"], F.lit("mask").alias("action")))
    out = found.join(add, key, "left")
    return out.select(id_col, *key, F.when(F.col("_add").isNull(), base).otherwise(F.array_sort(F.concat(base, F.col("_add")))).alias("found"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with each span of ``text`` replaced: [EMAIL] etc. for base kinds and secrets, [NUMBER], [NAME] or [WORD] for
    generalised terms (with a digit; capitalised; others), nothing for removed ones. Spans that overlap are one, from the
    first's start to the furthest end, replaced as the first is. Null stays null."""
    key = ["_k1", "_k2"]
    s = spans(docs, id_col, text_col, **how).where(F.size("found") > 0).select(*key, "found").dropDuplicates(key).select(*key, F.explode("found").alias("_f")).select(*key, "_f.*")
    w = Window.partitionBy(*key).orderBy("start", "no")
    s = s.withColumn("_new", F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)) <= F.col("start"), F.lit(True)).cast("int"))
    s = s.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = s.groupBy(*key, "_run").agg(F.min(F.struct("start", "no", "kind", "action")).alias("_m"), F.max("end").alias("end"))
    runs = runs.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_m.start", "end", "_m.kind", "_m.action"))).alias("found"))  # a text's own spans
    d = boxed(docs, id_col, text_col)
    t = F.col("_row").getField(text_col)

    def cut(chars: Column) -> Column:
        """Pieces of the text and what stands for the spans, in order; each character is looked at once."""
        part = lambda a, b: F.array_join(F.slice(chars, a + 1, b - a), "")
        broader = lambda v: F.when(v.rlike(r"\p{N}"), "[NUMBER]").when(v.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
        put = lambda x: F.when(x["action"] == "remove", "").when(x["action"] == "generalise", broader(part(x["start"], x["end"]))).otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        before = lambda i: F.when(i > 0, F.get("found", i - 1)["end"]).otherwise(0)
        out = F.transform("found", lambda x, i: F.concat(part(before(i), x["start"]), put(x)))
        return F.array_join(F.concat(out, F.array(part(F.element_at("found", -1)["end"], F.size(chars)))), "")

    new = F.when(F.col("found").isNull(), t).otherwise(F.transform(F.array(F.regexp_extract_all(t, F.lit(r"(?s)."), F.lit(0))), cut)[0])
    return d.join(runs, key, "left").select(*[new.alias(c) if c == text_col else x for c, x in zip(docs.columns, unboxed(docs.columns), strict=True)])


def digest(spanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the contract, from the result of spans()."""
    line = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["no"] < len(KINDS))
    count = lambda no: F.size(F.filter("found", lambda s: s["no"] == no)).cast("long")
    n = [count(no).alias(f"n_{kind}") for no, kind in enumerate([*KINDS, "secret", "term"])]
    return spanned.select(id_col, *n[:4], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("found")).alias("spans"), *n[4:], F.size("found").cast("long").alias("n_spans"))
