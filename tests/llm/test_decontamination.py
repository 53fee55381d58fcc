import random
import re

from parlance.llm import decontamination as dc


def readings(text):
    """Tokens of both readings as (what is compared, slot value or None)."""
    found = re.findall(r"\d+(?:[.,]\d+)*|[^\W\d_]+", text or "")
    template, run = [], None
    for t in found:
        if len(t) > 1 and t[0].isupper() and t[1:].islower() and t.lower() not in dc.STARTERS:
            if run is None:
                run = []
                template.append(("<name>", run))
            run.append(t.lower())
            continue
        run = None
        low = t.lower()
        template.append(("<num>", [low]) if t[0].isdigit() else ("<unit>", [low]) if low in dc.UNITS else (low, None))
    return [(t.lower(), None) for t in found], template


def contains(doc, item):
    for reading, (d, i) in enumerate(zip(readings(doc), readings(item), strict=True)):
        n = min(dc.WINDOW, len(i))

        def windows(x):
            cut = [(k, tuple(t for t, _ in x[k : k + n])) for k in range(len(x) - n + 1)]
            return [(k, w) for k, w in cut if reading == 0 or sum(not t.startswith("<") for t in w) >= dc.LEAST_WORDS]

        if not n:
            continue
        own, ats = windows(i), set()
        shifts = {}
        for k, w in windows(d):
            for j, v in own:
                if w == v:
                    shifts.setdefault(k - j, []).append(j)
        for shift, at in shifts.items():
            pairs = {((i[j + k][0], tuple(i[j + k][1])), (d[j + k + shift][0], tuple(d[j + k + shift][1]))) for j in at for k in range(n) if i[j + k][1] is not None}
            if reading == 0 or len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
                ats |= set(at)
        if own and len(ats) >= min(len(own), dc.ENOUGH):
            return True
    return False


ITEMS = [
    (1, "If Tom has 12 apples and buys 30 more apples from Mary for 5 dollars each, how many apples does Tom have in the end after all"),
    (2, "the quick brown fox jumps over the lazy dog while seven wizards watch from the old stone tower nearby tonight"),
    (3, "too short to count"),
    (4, None),
    (5, "If Ann has 7 apples and buys 8 more apples from Joe for 2 euros each, how many apples does Ann have in the end after all"),
    (6, ""),
]


def test_cases(spark):
    asked = "If Anna has 9 apples and buys 41 more apples from Peter for 3 euros each, how many apples does Anna have in the end after all"
    docs = [
        (10, "Some text before it. " + ITEMS[0][1] + " and after", True),
        (11, "x " + asked, True),
        (12, asked.replace("does Anna", "does Bob"), False),  # the slots of one name differ
        (13, ITEMS[1][1].upper(), True),
        (14, "the quick brown fox jumps over the lazy dog", False),
        (15, None, False),
        (16, "", False),
        (16, "", False),
        (17, "too short to count", True),  # a short item is looked for as a whole
        (19, "it was too short, to be sure, to count", False),
        (None, ITEMS[1][1], True),
        (18, ("filler words without meaning here " * 300) + ITEMS[1][1] + (" more filler" * 200), True),
    ]
    given = spark.createDataFrame([(d, t, 1) for d, t, _ in docs], "doc_id long, text string, UID int")
    bench = spark.createDataFrame([(i, t, "q") for i, t in ITEMS], "item_id long, text string, h string")
    got = sorted(((r.doc_id, r.contaminated) for r in dc.contamination(given, bench).collect()), key=str)
    assert got == sorted(((d, c) for d, _, c in docs), key=str)
    by = {r.doc_id: r for r in dc.contamination(given, bench).collect()}
    assert (by[10].first_item, by[10].n_items) == (1, 2)
    kept = dc.without_contaminated(given, bench)
    assert kept.columns == given.columns and kept.count() == sum(not c for _, _, c in docs)
    assert dc.contamination(given, bench.limit(0)).where("contaminated").count() == 0
    assert dc.contamination(given.limit(0), bench).count() == 0


def test_against_brute_force(spark, monkeypatch):
    rnd = random.Random(11)
    words = "red blue green house tree river stone cloud walks runs sees finds over under with".split()
    names, units = ["Tom", "Ann", "Mary Ann", "Joe"], ["km", "hours", "kg"]

    def token():
        r = rnd.random()
        return rnd.choice(names) if r < 0.15 else str(rnd.randint(1, 3)) if r < 0.25 else rnd.choice(units) if r < 0.3 else rnd.choice(words)

    items = [(k, " ".join(token() for _ in range(rnd.choice([1, 3, 5, 6, 7, 8, 9, 14, 25])))) for k in range(24)]
    items += [(None, items[3][1]), (None, " ".join(token() for _ in range(20))), (3, items[5][1])]
    docs = []
    for k in range(120):
        parts = [token() for _ in range(rnd.randint(0, 30))]
        item = rnd.choice(items)[1].split()
        lo = rnd.randrange(len(item)) if rnd.random() < 0.3 else 0
        swap = dict(zip(names[:2] + ["1", "2", "km"], rnd.choice([["Ann", "Tom", "2", "1", "kg"], ["Bob", "Bob", "7", "8", "mm"], ["Tom", "Ann", "1", "2", "km"]]), strict=True))
        parts[len(parts) // 2 : len(parts) // 2] = [swap.get(w, w) for w in item[lo:]]
        docs.append((k, " ".join(parts)))
    docs = [d for d in docs if not contains(d[1], items[0][1]) or d[0] % 9 == 0]  # an item of one word is nearly everywhere
    given, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for broadcast in (dc.BROADCAST_WINDOWS, 0):
        monkeypatch.setattr(dc, "BROADCAST_WINDOWS", broadcast)
        got = {r.doc_id: tuple(r)[1:] for r in dc.contamination(given, bench).collect()}
        want = {}
        for d, t in docs:
            inside = [k for k, i in items if contains(t, i)]
            want[d] = (bool(inside), len(inside), min((k for k in inside if k is not None), default=None))
        assert got == want and 10 < sum(w[0] for w in want.values()) < len(docs) - 5
    assert dc.without_contaminated(given, bench).count() == sum(not w[0] for w in want.values())


def test_names_at_borders_and_units(spark):
    """Re-parameterised items that begin with a recurring name, behind a name in the text before; units in the plural."""
    item = "Natalia sold 40 clips to her friends in the month of April. After Natalia sold half as many clips in May"
    hours = "it took the slow train 1 hour to get to the next town and then 3 hours to get over the long bridge to the coast again"
    titled = "Dr. Smith had 5 red pens on the table. After Dr. Smith lost 2 of the red pens he went on the way to the small shop by the river"
    asked = item.replace("Natalia", "Joan").replace("40", "72")
    docs = [
        (1, f"Question: {asked}", True),
        (2, f"He was born in Paris. {asked}", True),
        (3, f"The capital is Paris\n{asked}", True),
        (4, f"Question: {asked.replace('After Joan', 'After Mark')}", False),  # the slots of one name differ
        (5, hours.replace("1 hour", "2 hours").replace("3 hours", "5 hours"), True),
        (6, titled.replace("Dr. Smith", "Anna").replace("5", "9"), True),  # a name with a period in it is one name still
        (7, item, True),
    ]
    bench = spark.createDataFrame([(1, item), (2, hours), (3, titled)], "item_id long, text string")
    got = {r.doc_id: r.contaminated for r in dc.contamination(spark.createDataFrame([x[:2] for x in docs], "doc_id long, text string"), bench).collect()}
    assert got == {d: c for d, _, c in docs}


def test_items_of_one_prompt(spark):
    """Thousands of items begin with one long prompt, or are one template: all that a document has are counted."""
    prompt = "read the following short story with great care and then choose the best of the four answers that are given below it"
    phrase = "which one of these is the right answer here"
    bench = [(k, f"{prompt} q{'abcdefghij'[k % 10]}{k // 10:x}z ends") for k in range(3000)]
    bench += [(10_000 + k, f"the old miller sold {k} bags of flour to the baker of the town and kept {k + 1} more for the winter") for k in range(2000)]
    bench += [(20_000 + k, f"{phrase} " + " ".join(f"w{'abcdefghij'[(k + j) % 10]}x{'abcdefghij'[k // 100]}{'abcdefghij'[k // 10 % 10]}{'abcdefghij'[k % 10]}" for j in range(9))) for k in range(1000)]
    docs = [(1, prompt.upper()), (2, "the old miller sold 7 bags of flour to the baker of the town and kept 99 more for the winter"), (3, phrase), (4, bench[-1][1]), (5, "nothing of it")] + [(100 + k, f"x{k} {prompt}") for k in range(10)]
    got = {r.doc_id: tuple(r)[1:] for r in dc.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    want = {1: (True, 3000, 0), 2: (True, 2000, 10_000), 3: (False, 0, None), 4: (True, 1, 20_999), 5: (False, 0, None)}
    assert got == want | {100 + k: want[1] for k in range(10)}


def test_long_items_and_scripts_without_spaces(spark):
    rnd = random.Random(5)
    long = " ".join(rnd.choice(["Tom", "12", "7", "km", "red", "blue", "tree"]) for _ in range(60_000))
    han = "\u4e2d\u6587\u6ca1\u6709\u7a7a\u683c\u7684\u95ee\u9898\u5e94\u8be5\u4e5f\u88ab\u627e\u5230"
    docs = [(1, long), (2, f"\u6211\u8bf4{han}\u5417"), (3, han[:5]), (4, "red blue tree")]
    bench = spark.createDataFrame([(1, long), (2, han)], "item_id long, text string")
    got = {r.doc_id: (r.n_items, r.first_item) for r in dc.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (0, None), 4: (0, None)}


def test_texts_end_to_end_are_those_one_by_one():
    """Windows, places and readings of texts read together are those of each alone; no window lies in two of them."""
    rnd = random.Random(3)
    some = ["Anna", "Bob", "Mary-Jane", "Dr. Smith", "12", "3.5", "miles", "feet", "buys", "red", "apples", "and", "sells", "them", ", ", "\n", "If", "猫が"]
    texts = [None, "", *(" ".join(rnd.choices(some, k=rnd.randrange(60))) for _ in range(60)), "", "..."]
    windows = dc.Windows((2, 5))
    alone = {(k, reading, n, int(a), int(x), tuple(values[a : a + n].tolist())) for k, text in enumerate(texts) for reading, (h, at, n, values) in windows(text) for x, a in zip(h, at, strict=True)}
    together = set()
    for reading, (h, at, n, values), of, begins in windows.of(texts):
        for x, a in zip(h, at, strict=True):
            assert of[a] == of[a + n - 1]
            together.add((int(of[a]), reading, n, int(a - begins[of[a]]), int(x), tuple(values[a : a + n].tolist())))
    assert together == alone and {r for _, r, *_ in alone} == {0, 1, 2}
