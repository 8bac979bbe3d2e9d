"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Texts become templates: runs of numbers (in digits or words), units after numbers and runs of names turn into typed
placeholders, other words lose case and closing punctuation. What is a name is told by the benchmark's own words, not
by capitals, so that texts in capitals, in title case or in lower case come out alike: plain words are those that some
item has in lower case, and any other word stands where a name may. A window is a run of plain words with the
placeholders between them, so placeholders never crowd out words. Every window of every document
is joined by hash with those of the benchmark. Windows of one document and item must then agree on their slots: a
value of the item (a name, a number) has one replacement throughout, or at least throughout one occurrence of the
item in the document. That keeps re-parameterised questions and drops windows alike by chance.

Items of too few plain words for a template are looked for word by word instead, and items of under ``LITERALS`` words
in all as whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, boxed, if_small, row_key, unboxed, written

#: Units of measure, lower case, as they follow a number.
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "ft", "yard", "yards", "mile", "miles", "mg", "g", "kg",
    "gram", "grams", "kilogram", "kilograms", "ton", "tons", "tonnes", "oz", "ounce", "ounces", "lb", "lbs", "pound",
    "pounds", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "s", "sec", "second", "seconds",
    "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year",
    "years", "cent", "cents", "dollar", "dollars", "euro", "euros", "percent", "%", "degrees", "mph", "kmh", "watts",
    "volts", "joules", "newtons", "hz", "mb", "gb", "tb",
)

#: Words for numbers, lower case; joined by hyphens or spaces they are one number.
NUMBERS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen",
    "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty",
    "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion", "dozen",
)

#: Plain words of a window; an item of fewer is one window, if it has LITERALS plain words at least.
WIDTH, LITERALS = 6, 5
#: Words of a window of items that have too few plain words, and are matched word by word.
EXACT = 8

#: Keys of texts, of 12 bytes, up to which they are broadcast (some 40 MB).
BROADCAST_KEYS = 1_000_000

CLOSING = r"""[.,;:!?"'\)\]]"""
# a slot is its kind (number \x01, name \x02, unit \x03), its value, and an end (\x04, \x05, \x07); \x06 joins the words of a value
_SLOT, _END = r"[\x01-\x03]", r"[\x04\x05\x07]"


def squeezed(text: Column) -> Column:
    """Runs of white space (and of the characters that mark slots) to one space, trimmed; null: ''."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x01-\x07\x20\x09-\x0D]+", " "))


def _numbered(text: Column) -> Column:
    """A squeezed text with a space before it, and with its numbers and the units after them marked.

    A number is a word whose first letter or digit is a digit, or made of NUMBERS; a unit a word of UNITS right after one.
    Every pattern starts with a character that is rare or a space, so texts are scanned fast.
    """
    n = "|".join(NUMBERS)
    t = F.concat(F.lit(" "), text)
    t = F.regexp_replace(t, rf" ([^ \p{{L}}\p{{N}}]*+(?:\p{{N}}[^ ]*+|(?i:{n})(?:-(?i:{n}))*+[^ \p{{L}}\p{{N}}]*+(?= |$)))", " \x01$1\x04")
    return F.regexp_replace(t, rf"\x04 ((?i:{'|'.join(UNITS)}){CLOSING}*+)(?= |$)", "\x04 \x03$1\x07")


def vocabulary(benchmark: DataFrame, item_text: str = "text") -> list[str]:
    """The plain words of the items: those, less case and closing punctuation, that stand somewhere without a capital, a
    number or a unit. They come to the driver and go to all tasks; they grow with the benchmark, not with the documents."""
    w = benchmark.select(F.explode(F.split(_numbered(squeezed(F.col(item_text))), " ")).alias("_w")).where(F.col("_w").rlike(r"^[^\x01\x03]") & ~F.col("_w").rlike(r"^[^\p{L}\p{N}]*+\p{Lu}"))
    return sorted(r[0] for r in w.select(bare(F.col("_w"))).distinct().collect() if r[0])


def marked(text: Column, plain: list[str]) -> Column:
    """A squeezed text in lower case, without closing punctuation, with its slots marked and put before the word that
    follows, so that a space parts plain words. A name is a word, neither number nor unit, that is not in ``plain``."""
    slot = lambda w: w.startswith("\x01") | w.startswith("\x03") | (w == "")
    known = lambda w: w.isin(plain) if plain else F.lit(False)
    t = F.array_join(F.transform(F.split(bare(_numbered(text)), " "), lambda w: F.when(slot(w) | known(w), w).otherwise(F.concat(F.lit("\x02"), w, F.lit("\x05")))), " ")
    for end in "\x04\x05\x07":
        t = F.replace(t, F.lit(end + " "), F.lit(end))
    for run in ("\x04\x01", "\x05\x02"):
        t = F.replace(t, F.lit(run), F.lit("\x06"))
    return F.trim(t)


def bare(text: Column) -> Column:
    """Lower case, no closing punctuation at the ends of words (a word of nothing else keeps its first character)."""
    return F.lower(F.regexp_replace(text, rf"([^ \x04-\x07]){CLOSING}++(?= |$)", "$1"))


def template(marks: Column) -> Column:
    """The template of a marked text: slots without their values."""
    return F.regexp_replace(marks, rf"({_SLOT})[^\x04\x05\x07]*+{_END}", "$1")


def _prepared(df: DataFrame, names: list[str], plain: list[str]) -> DataFrame:
    """names, _tpl (template words with the slots before them), _own (those words alone), _n (their number), _lit (all words), from _s."""
    d = df.select(*names, "_s", template(marked(F.col("_s"), plain)).alias("_t"))
    d = d.select(*names, F.split("_t", " ").alias("_tpl"), F.split(F.translate("_t", "\x01\x02\x03", ""), " ").alias("_own"), F.split(bare(F.col("_s")), " ").alias("_lit"))
    return d.withColumn("_n", F.size("_own") - (F.element_at("_own", -1) == "").cast("int"))  # slots at the end have no word


def _hashes(form: str) -> tuple[Column, Column]:
    """96 bits of the window at _p of a form: t6 (six plain words), x8 (any eight words), w0 (the whole text); null beyond the end."""
    kind, width = form[0], int(form[1:])
    if kind == "w":
        words, fits = [F.array_join("_lit", " ")], (F.col("_p") == 0) & (F.size("_lit") < LITERALS)
    elif kind == "x":
        words, fits = [F.get("_lit", F.col("_p") + i) for i in range(width)], F.col("_p") + width <= F.size("_lit")
    else:
        words, fits = [F.get("_own" if i == 0 else "_tpl", F.col("_p") + i) for i in range(width)], F.col("_p") + width <= F.col("_n")
    return F.when(fits, F.xxhash64(F.lit(form), *words)), F.hash(*reversed(words))


def _windows(d: DataFrame, names: list[str], forms: list[str]) -> DataFrame:
    """names, _form, _p, _h, _g: a narrow row per window of a prepared table."""
    words = F.col("_n") if all(f[0] == "t" for f in forms) else F.size("_lit")  # at least as many as template words
    least = min(int(f[1:]) for f in forms)
    d = d.withColumn("_p", F.explode(F.sequence(F.lit(0), F.greatest(words - least, F.lit(0)))))
    each = [F.struct(F.lit(f).alias("_form"), h.alias("_h"), g.alias("_g")) for f in forms for h, g in [_hashes(f)]]
    d = d.select(*names, "_p", (each[0] if len(each) == 1 else F.explode(F.array(*each))).alias("_w"))
    return d.where("_w._h is not null").select(*names, "_w._form", "_p", "_w._h", "_w._g")


def _slots(words: str) -> Column:
    """Kinds and values of the slots within the window of _form at _p of marked words, in order; none in windows word by word."""
    width = F.substring("_form", 2, 9).cast("int")
    t = F.array_join(F.slice(words, F.col("_p") + 1, F.greatest(width, F.lit(1))), " ")
    t = F.regexp_replace(t, rf"^(?:{_SLOT}[^\x04\x05\x07]*+{_END})+", "")
    t = F.regexp_replace(t, rf"{CLOSING}++(?=[\x04-\x07])", "")
    return F.when(F.col("_form").startswith("t"), F.regexp_extract_all(t, F.lit(rf"({_SLOT}[^\x04\x05\x07]*){_END}"), F.lit(1))).otherwise(F.array().cast("array<string>"))


def _agreeing(pairs: DataFrame, on: list[str]) -> DataFrame:
    """on, _hits, _slots, _changed: per group of matched windows the item's windows that agree on their slots, and the
    values replaced. A value's replacement is the one most windows of the group show, least on ties."""
    votes = pairs.select(*on, F.explode("_slots").alias("_z")).groupBy(*on, "_z").agg(F.count(F.lit(1)).alias("_n"))
    best = votes.groupBy(*on, F.col("_z.was").alias("was")).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_z.now").alias("now"))).alias("_m"))
    best = best.groupBy(*on).agg(F.collect_list(F.struct("was", F.col("_m.now").alias("now"))).alias("_best"))
    kept = pairs.join(best, on, "left").where(F.size(F.array_except("_slots", F.coalesce("_best", F.array().cast("array<struct<was:string,now:string>>")))) == 0)
    found = kept.groupBy(*on).agg(F.countDistinct("_bp").alias("_hits")).join(best, on, "left")
    count = lambda a: F.coalesce(F.when(F.col("_best").isNotNull(), F.size(a)), F.lit(0))
    return found.select(*on, "_hits", count(F.col("_best")).alias("_slots"), count(F.filter("_best", lambda z: z["was"] != z["now"])).alias("_changed"))


def benchmark_windows(benchmark: DataFrame, item_col: str, item_text: str, width: int, plain: list[str]) -> DataFrame:
    """_item, _form, _bp, _h, _g, _bs (slots) per window of the items; each item has windows of one form."""
    b = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("_item"), squeezed(F.col(item_text)).alias("_s")).where("_s <> ''").distinct()
    d = _prepared(b.withColumn("_marks", F.split(marked(F.col("_s"), plain), " ")), ["_item", "_marks"], plain)
    words = F.size("_lit")
    own = F.when(F.col("_n") >= LITERALS, F.concat(F.lit("t"), F.least("_n", F.lit(width)))).when(words >= LITERALS, F.concat(F.lit("x"), F.least(words, F.lit(EXACT)))).otherwise("w0")
    forms = [*(f"t{w}" for w in range(LITERALS, width + 1)), *(f"x{w}" for w in range(LITERALS, EXACT + 1)), "w0"]
    w = _windows(d.withColumn("_as", own), ["_item", "_marks", "_as"], forms).where("_form = _as")
    return w.select("_item", "_form", F.col("_p").alias("_bp"), "_h", "_g", _slots("_marks").alias("_bs"))


def _matches(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, width: int, share: float, broadcast_rows: int) -> DataFrame:
    """_id, _k1, _k2, _item, n_windows, n_hits, n_slots, _changed per row key and item with enough hits."""
    plain = vocabulary(benchmark.where(F.col(item_col).isNotNull()), item_text)
    b = written(benchmark_windows(benchmark, item_col, item_text, width, plain), "bench-windows")
    forms = [r["_form"] for r in b.select("_form").distinct().orderBy("_form").collect()] or ["w0"]  # a few kinds of windows
    keys = ["_form", "_h", "_g"]
    d = docs.select(F.col(id_col).alias("_id"), squeezed(F.col(text_col)).alias("_s"), *row_key(id_col, text_col))
    w = _windows(_prepared(d, ["_k1", "_k2"], plain), ["_k1", "_k2"], forms)
    hits = written(w.join(if_small(b.select(*keys).distinct(), broadcast_rows), keys, "left_semi"), "bench-hits")
    # slots can only rule windows out, so only texts with enough of them for some item are read again, for its windows
    positions = written(b.groupBy("_item").agg(F.countDistinct("_bp").alias("n_windows")), "bench-items")
    met = hits.join(b.select("_item", "_bp", *keys), keys).groupBy("_k1", "_k2", "_item").agg(F.countDistinct("_bp").alias("_n"))
    met = met.join(positions, "_item").where((F.col("_n") >= F.col("n_windows") * share) & (F.col("_n") > 0)).select("_k1", "_k2", "_item")
    met = written(met, "bench-met")
    telling = if_small(written(met.select("_k1", "_k2").distinct(), "bench-telling"), BROADCAST_KEYS)
    wanted = hits.join(telling, ["_k1", "_k2"], "left_semi")
    held = written(wanted.groupBy("_k1", "_k2").agg(F.collect_set(F.struct("_form", "_p", "_h", "_g")).alias("_at")), "bench-held")  # at most a text's windows
    some = held.agg(F.sum(F.size("_at"))).first()[0] or 0
    texts = d.join(telling, ["_k1", "_k2"], "left_semi")  # so that where windows are too many to broadcast, few texts travel
    texts = texts.join(F.broadcast(held) if some <= broadcast_rows else held, ["_k1", "_k2"])
    texts = texts.select("_id", "_k1", "_k2", "_at", F.split(marked(F.col("_s"), plain), " ").alias("_marks"))  # before the rows of hits, so once a text
    texts = texts.select("_id", "_k1", "_k2", "_marks", F.explode("_at").alias("_a"))
    texts = texts.select("_id", "_k1", "_k2", "_a.*", "_marks").select("_id", "_k1", "_k2", *keys, "_p", _slots("_marks").alias("_ds")).distinct()
    pairs = texts.join(b, keys).join(if_small(met, broadcast_rows), ["_k1", "_k2", "_item"], "left_semi")
    both = F.transform(F.arrays_zip("_bs", "_ds"), lambda z: F.struct(z["_bs"].alias("was"), z["_ds"].alias("now")))
    pairs = written(pairs.select("_id", "_k1", "_k2", "_item", "_bp", "_p", F.array_distinct(both).alias("_slots")), "bench-pairs")
    on = ["_id", "_k1", "_k2", "_item"]
    # not by id, which may be null; rows of one key are alike
    key = ["_k1", "_k2", "_item"]
    # several copies with other values may tie the votes of the whole document: each occurrence, told by where the item would begin, is judged by itself too
    groups = _agreeing(pairs, key).unionByName(_agreeing(pairs.withColumn("_from", F.col("_p") - F.col("_bp")), [*key, "_from"]).drop("_from"))
    best = groups.groupBy(*key).agg(F.max(F.struct("_hits", (-F.col("_changed")).alias("_same"), "_slots")).alias("_m"))
    out = best.join(positions, "_item").where(F.col("_m._hits") >= F.col("n_windows") * share).join(pairs.select(*on).distinct(), key)
    return out.select(*on, "n_windows", F.col("_m._hits").alias("n_hits"), F.col("_m._slots").alias("n_slots"), (-F.col("_m._same")).alias("_changed"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, share: float = 0.5, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Pairs of a document and a benchmark item whose text it holds.

    Returns id, item, ``n_windows`` (windows of the item), ``n_hits`` (those found in the document with
    consistent slots), ``n_slots`` (distinct values replaced) and ``exact`` (no slot differs), for pairs with n_hits of
    at least ``share`` of n_windows. Slots are consistent over the whole document or over the item's best occurrence
    in it, whichever gives more hits.

    Letter case plays no part on the documents' side: neither in words nor in what is a name. An item's own capitals only
    tell, together with all other items, which words are plain.

    An item's windows are of ``width`` plain words; those of an item with LITERALS or more, but fewer than ``width``, are
    of all it has. An item with under LITERALS plain words is matched by its words as they are (closing
    punctuation apart), in windows of up to EXACT words; one of under LITERALS words in all only by a document that
    says nothing else.

    Null ids are not reported; null and empty texts have no windows; rows alike in id and text count once, and of rows
    of one id and other texts the best counts; texts of one item id are one item. Ties of votes: the least value. Long
    texts: a row per window, of numbers only. Other columns play no part. An empty table on either side gives an empty
    result.

    Documents' windows never travel unless their hash is one of the benchmark's: the distinct hashes, 16 bytes each,
    are broadcast if there are at most ``broadcast_rows``, and joined by a shuffle otherwise. The words of a slot are
    fetched from the texts that have hits, in a second reading.
    """
    m = _matches(docs.where(F.col(id_col).isNotNull()), benchmark, id_col, text_col, item_col, item_text, width, share, broadcast_rows)
    best = m.groupBy("_id", "_item").agg(F.max(F.struct("n_hits", (-F.col("_changed")).alias("_same"), "n_slots", "n_windows")).alias("_m"))
    return best.select(F.col("_id").alias(id_col), F.col("_item").alias(item_col), "_m.n_windows", "_m.n_hits", F.col("_m.n_slots").cast("long").alias("n_slots"), (F.col("_m._same") == 0).alias("exact"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, share: float = 0.5, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs without the rows that hold a benchmark item. Rows are judged by id and text, so one that shares its id with a
    leaking one stays if it doesn't leak, and a leaking row without an id goes."""
    m = _matches(docs, benchmark, id_col, text_col, item_col, item_text, width, share, broadcast_rows)
    bad = written(m.select("_k1", "_k2").distinct(), "bench-rejected")
    return boxed(docs, id_col, text_col).join(if_small(bad), ["_k1", "_k2"], "left_anti").select(*unboxed(docs.columns))
