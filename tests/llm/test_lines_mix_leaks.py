import collections
import random
import time

import pytest
from pyspark.sql import functions as F

from strandline.llm import decontam, line_dedup, mixing


def lines(d):
    return {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in d.collect()}


def test_repeated_windows_go_and_first_stay(make):
    a = "one\ntwo\nthree\nfour"
    got = lines(line_dedup.dedup_lines(make([(2, "x\ntwo\nthree\nfour\ny"), (1, a), (3, "one\ntwo\nzzz")], clash=True)))
    assert got == {1: (a, 4, 0), 2: ("x\ny", 5, 3), 3: ("one\ntwo\nzzz", 3, 0)}


def test_overlap_with_the_first_keeps_the_first(make):
    assert lines(line_dedup.dedup_lines(make([(1, "a\na\na\na\na")])))[1] == ("a\na\na", 5, 2)


def test_line_edges(make, spark):
    rows = [(None, "p\nq\nr"), (5, "p\nq\nr"), (5, "p\nq\nr"), (6, None), (7, ""), (8, "p\nq"), (9, "\n".join(map(str, range(20_000))))]
    got = line_dedup.dedup_lines(make(rows, clash=True)).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.text, r.n_lines, r.n_removed))
    assert by[None] == [("", 3, 3)]  # a row without an id comes last
    assert by[5] == [("p\nq\nr", 3, 0)] * 2 and by[6] == [(None, 0, 0)] and by[7] == [("", 1, 0)] and by[8] == [("p\nq", 2, 0)]
    assert by[9][0][2] == 0
    assert line_dedup.dedup_lines(make([])).count() == 0


def brute_lines(rows):
    """Texts, in order of (id, position), less the lines of windows seen before."""
    first, out = {}, {}
    for i, t in sorted(rows):
        own = t.split("\n")
        gone = set()
        for p in range(len(own) - 2):
            w = tuple(own[p : p + 3])
            d, q = first.setdefault(w, (i, p))
            if (d, q) != (i, p):
                gone |= set(range(max(p, q + 3) if d == i else p, p + 3))
        out[i] = "\n".join(x for p, x in enumerate(own) if p not in gone)
    return out


def test_lines_match_brute_force(make):
    rng = random.Random(13)
    rows = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randrange(1, 30)))) for i in range(80)]
    assert {i: t for i, (t, _, _) in lines(line_dedup.dedup_lines(make(rows))).items()} == brute_lines(rows)


def test_a_long_text_loses_lines_in_linear_time(make):
    def took(n):
        rows = [(1, "\n".join(f"line {i}" for i in range(0, n, 3))), (2, "\n".join(f"line {i}" if i % 3 == 0 else "x" * (i % 50) for i in range(n))), (3, "\n".join(f"line {i // 2}" for i in range(n)))]
        rows.append((4, rows[2][1] + "\nend"))
        start = time.time()
        got = lines(line_dedup.dedup_lines(make(rows)))
        assert {i: t for i, (t, _, _) in got.items()} == brute_lines(rows)
        return time.time() - start

    took(1000)
    assert took(32_000) < 4 * took(8_000) + 3


def brute_targets(sizes, weights, share=1.5, cap=2.0):
    total, target, left = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while left:
        w = sum(weights[i] for i in left)
        over = [i for i in left if total * weights[i] / w > cap * sizes[i] + 1e-9]
        if not over:
            for i in left:
                target[i] = total * weights[i] / w
            break
        for i in over:
            target[i] = cap * sizes[i]
            total -= target[i]
            left.discard(i)
    return target


@pytest.mark.parametrize("sizes", [[10, 1000, 20, 5], [1, 1, 1, 1, 1], [0, 50, 0], [1000, 1, 1, 1000, 3], [7]])
def test_targets_match_resharing(spark, sizes):
    d = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = [r.target for r in mixing.source_targets(d).orderBy("rank").collect()]
    assert got == pytest.approx(brute_targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))]))


def test_mix_takes_its_targets(make):
    rows = [(i, "w " * (i % 17), "en", None if i % 5 == 0 else f"s{i % 4}") for i in range(300)] + [(1, None, "en", "s1"), (None, "a b c", "en", "s2"), (7, "x y", "en", "s0"), (7, "x y", "en", "s0")]
    d = make(rows, clash=True)
    a = mixing.assign_positions(d).toPandas()
    assert len(a) == len(rows) and (a["taken"] <= 2 * a["size"]).all()
    per = a.groupby(a["source"].fillna("~")).agg(taken=("taken", "sum"), target=("target", "max"))
    assert (abs(per["taken"] - per["target"]) <= 1).all()
    assert a["first_position"].dropna().between(0, 1).all()
    again = mixing.assign_positions(d.repartition(7), per_bucket=10).toPandas()
    key = ["doc_id", "source", "size", "taken", "first_position"]
    assert sorted(map(str, a[key].round(9).itertuples(index=False))) == sorted(map(str, again[key].round(9).itertuples(index=False)))
    assert mixing.assign_positions(make([])).count() == 0


def test_thousands_of_sources(make):
    a = mixing.assign_positions(make([(i, "w " * (1 + i % 9), "en", f"s{i % 3000}") for i in range(6000)])).toPandas()
    per = a.groupby("source").agg(taken=("taken", "sum"), target=("target", "max"), size=("source_size", "max"))
    assert len(per) == 3000 and (abs(per["taken"] - per["target"]) <= 0.5 + 1e-9).all() and (per["target"] <= 2 * per["size"] + 1e-9).all()
    assert per["target"].sum() == pytest.approx(1.5 * per["size"].sum())


def test_first_words_cut(make):
    rows = [(1, "  a b\tc\n\nd  "), (2, "one"), (3, None), (4, ""), (5, "x " * 100_000)]
    cut = lambda n: {r.doc_id: r.t for r in make(rows).select("doc_id", mixing.first_words("text", F.lit(n)).alias("t")).collect()}
    assert cut(3) == {1: "  a b\tc", 2: "one", 3: None, 4: "", 5: "x x x"} and cut(4)[1] == "  a b\tc\n\nd" and cut(9)[1] == rows[0][1]
    assert cut(60_000)[5] == "x " * 59_999 + "x"


def test_positions_invert_the_schedule(spark):
    d = spark.range(101).select((F.col("id") / 100).alias("y"))
    for k, knots in enumerate(mixing.SCHEDULES):
        for r in d.select("y", mixing._position(F.col("y"), F.lit(k + 1), mixing.SCHEDULES).alias("t")).collect():
            area = whole = 0.0
            for (a, u), (b, v) in zip(knots, knots[1:], strict=False):
                whole += (b - a) * (u + v) / 2
                c = min(max(r.t, a), b)
                area += (c - a) * (u + u + (v - u) * (c - a) / (b - a)) / 2
            assert area / whole == pytest.approx(r.y, abs=1e-9)


def test_curriculum_is_sorted_and_follows_weights(documents):
    c = mixing.curriculum(documents).toPandas()
    assert (c["words"] > 0).all() and set(c["copy"]) <= {1, 2}
    assert c["words"].sum() == pytest.approx(1.5 * documents.select(F.sum(mixing.size_of("text"))).first()[0], rel=1e-3)


QUESTION = "The train leaves with 12 wagons and then Alice counts every single wagon twice before 30 minutes pass by the old gate of the town."


def test_leaks_exact_changed_and_clean(make, spark):
    bench = spark.createDataFrame([(1, QUESTION), (2, None), (3, ""), (1, QUESTION), (4, "too short")], "item_id long, text string")
    changed = QUESTION.replace("12", "57").replace("Alice", "Robert").replace("30", "45")
    mixed = QUESTION.replace("with 12 wagons", "with 99 wagons")
    rows = [(1, "Intro here. " + QUESTION + " More."), (2, changed), (3, "Nothing of that kind is said in this text at all, it is about gardens and rain."), (4, None), (5, ""), (None, QUESTION), (6, QUESTION), (6, QUESTION), (7, mixed)]
    got = {r.doc_id: r for r in decontam.contaminated(make(rows, clash=True), bench).collect()}
    assert set(got) == {1, 2, 6, 7}
    assert got[1].exact and got[6].exact and not got[2].exact and got[2].n_slots >= 3 and not got[7].exact
    rows.append((6, "A clean text under the id of one that leaks, it talks of gardens and of rain."))
    kept = sorted(x.doc_id or -1 for x in decontam.decontaminate(make(rows, clash=True), bench).collect())
    assert kept == [3, 4, 5, 6]  # the row without an id leaks too
    assert decontam.contaminated(make([]), bench).count() == 0
    assert decontam.contaminated(make(rows), bench.limit(0)).count() == 0


def test_inconsistent_slots_are_dropped(make, spark):
    item = "he gave 5 coins to the man and then the boy took 5 coins from the box and put 5 coins into a jar near the door of it"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    odd = item.replace("5", "8", 1).replace("5", "9", 1)  # 8, 9, 5: three values for one
    got = decontam.contaminated(make([(1, item.replace("5", "8")), (2, odd)]), bench, share=0.0).collect()
    hits = {r.doc_id: r.n_hits for r in got}
    assert hits[1] == got[0].n_windows and hits[2] < hits[1]


def test_each_occurrence_is_consistent_by_itself(make, spark):
    item = "Then Alice gave 5 coins to old Robert near the gate and Alice gave 7 coins to old Robert near the door"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    change = lambda *to: item.replace("Alice", to[0]).replace("5", to[1]).replace("Robert", to[2]).replace("7", to[3])
    sheet = ". ".join(change(*to) for to in (("Zoe", "1", "Bert", "9"), ("Ann", "8", "Carl", "3"), ("Mia", "4", "Abe", "6")))  # tied votes, least values of different copies
    got = decontam.contaminated(make([(1, sheet), (2, sheet + ". " + item)]), bench).collect()
    assert {r.doc_id: r.n_hits for r in got} == {1: got[0].n_windows, 2: got[0].n_windows}


NAMES = "Tom Bob Alice Carol Zoe Dan Ann Mary Kim Lee Omar Ines Mei Raj Eva Max".split()
THINGS = "apples wagons coins pens stamps eggs books tickets marbles chairs".split()
ITEMS = (
    "{A} has {a} red {T} in a basket. {B} has {b} green {T} in a box. How many {T} do they have in all?",
    "{A} bought {a} pens for {b} dollars and {B} bought {c} pens for {d} dollars each",
    "{A} walks {a} km to school every day. {A} also runs {b} km home. How far does {A} go in {c} days?",
    "If {a} workers build {b} walls in {c} hours, how long do {d} workers need for the same work?",
    "There are {a} {T} on the table. {A} takes {b} of them and {B} puts {c} back. How many are left there?",
    "{A} gave {a} {T} to {B}. {B} gave {b} of them back to {A} later. Who has more {T} now and by how many?",
)


def worded(rng, n):
    return rng.choice([str(n), decontam.NUMBERS[n]]) if n < 20 else rng.choice([str(n), f"{decontam.NUMBERS[18 + n // 10]}{f'-{decontam.NUMBERS[n % 10]}' if n % 10 else ''}"])


def test_reparameterised_questions_are_found_and_others_left(make, spark):
    rng = random.Random(21)
    fill = lambda t, thing: t.format(T=thing, **dict(zip("AB", rng.sample(NAMES, 2), strict=True)), **{k: worded(rng, rng.randrange(2, 99)) for k in "abcd"})
    items = [(i, ITEMS[i % len(ITEMS)], THINGS[i // len(ITEMS) % len(THINGS)]) for i in range(len(ITEMS) * len(THINGS))]
    bench = spark.createDataFrame([(i, fill(t, thing)) for i, t, thing in items], "item_id long, text string")
    filler = "the garden lies behind a wall and nobody has seen the old gate open since the rain began to fall that year".split()
    noise = lambda: " ".join(rng.choice(filler) for _ in range(rng.randrange(5, 60)))
    rows = [(i, f"{noise()}. {fill(t, thing)} {noise()}") for i, t, thing in items for _ in range(5)]
    clean = [(10_000 + i, ". ".join(f"{rng.choice(NAMES)} has {rng.randrange(99)} {rng.choice(THINGS)} and {noise()}" for _ in range(5))) for i in range(200)]
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(make([(1000 * k + i, t) for k, (i, t) in enumerate(rows)] + [(10**7 + i, t) for i, t in clean]), bench).collect()}
    found = sum((1000 * k + i, i) in got for k, (i, _) in enumerate(rows))
    assert found >= 0.97 * len(rows)
    assert not [d for d, _ in got if d >= 10**7]


CASES = {"capitals": str.upper, "title": str.title, "lower": str.lower, "swapped": str.swapcase}


def test_letter_case_plays_no_part(make, spark):
    """Verbatim items in any case are found, whole; and, generated anew in any case, 0.95 of them; clean texts are left."""
    rng = random.Random(22)
    fill = lambda t, thing: t.format(T=thing, **dict(zip("AB", rng.sample(NAMES, 2), strict=True)), **{k: worded(rng, rng.randrange(2, 99)) for k in "abcd"})
    items = [(i, ITEMS[i % len(ITEMS)], THINGS[i // len(ITEMS) % len(THINGS)]) for i in range(len(ITEMS) * len(THINGS))]
    text = {i: fill(t, thing) for i, t, thing in items}
    text |= {1000: QUESTION, 1001: "What is the capital of France", 1002: "Who wrote it?"}
    bench = spark.createDataFrame(list(text.items()), "item_id long, text string")
    filler = "the garden lies behind a wall and nobody has seen the old gate open since the rain began to fall that year".split()
    noise = lambda: " ".join(rng.choice(filler) for _ in range(rng.randrange(5, 40)))
    rows, owner = [], {}
    for case in CASES.values():
        for i, t in text.items():
            owner[len(rows)] = ("verbatim", i)
            rows.append((len(rows), case(t) if i == 1002 else f"{noise()}. {case(t)} {noise()}"))
        for i, t, thing in items:
            owner[len(rows)] = ("anew", i)
            rows.append((len(rows), case(f"{noise()}. {fill(t, thing)} {noise()}")))
        for _ in range(60):
            owner[len(rows)] = ("clean", None)
            rows.append((len(rows), case(". ".join(f"{rng.choice(NAMES)} has {rng.randrange(99)} {rng.choice(THINGS)} and {noise()}" for _ in range(5)))))
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(make(rows), bench).collect()}
    for d, (kind, i) in owner.items():
        if kind == "verbatim":
            assert got[d, i].n_hits == got[d, i].n_windows, (rows[d], text[i])
    anew = [(d, i) for d, (kind, i) in owner.items() if kind == "anew"]
    assert sum(k in got for k in anew) >= 0.95 * len(anew)
    assert not [d for d, _ in got if owner[d][0] == "clean"]


def test_short_and_dense_items(make, spark):
    short = {1: "What is the capital of France", 2: "What is 12 + 30 - 7 * 2?", 3: "How Many Apples Does Tom Have Left Today", 4: "Who wrote it?", 5: "the seven words of a short item"}
    bench = spark.createDataFrame(list(short.items()), "item_id long, text string")
    rows = [(i, t if i == 4 else f"Some words before. {t} And some after it.") for i, t in short.items()]
    rows += [(11, "What is the capital of Peru you ask"), (12, "What is 13 + 31 - 8 * 3?"), (14, "He asked who wrote it? Nobody knew."), (15, "And the nine words of a short item")]
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(make(rows), bench).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (15, 5)}


def test_long_texts_the_shuffled_way(make, spark):
    rng = random.Random(5)
    bench = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    long_ = " ".join(f"w{rng.randrange(5000)}" if rng.random() < 0.1 else rng.choice("of in at by the on to or".split()) for _ in range(100_000))
    changed = QUESTION.replace("12", "57").replace("Alice", "Robert")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = decontam.contaminated(make([(1, long_ + " " + changed), (2, long_)]), bench, broadcast_rows=0).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [(r.doc_id, r.item_id, r.exact) for r in got] == [(1, 1, False)]
