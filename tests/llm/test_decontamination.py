import random

import numpy as np
import pytest

from tallyloom.llm import decontamination as dc


@pytest.fixture(scope="module")
def items(spark, words):
    rows = [(i, words(30, 900 + i)) for i in range(12)]
    rows += [(50, "A train leaves Boston at 60 mph and travels for 3 hours before it stops; how many miles did the train travel?"), (51, "short one"), (52, None), (None, words(25, 777)), (53, "what is the capital city of the country named here")]
    return spark.createDataFrame(rows, "item_id long, text string"), dict(rows)


def found(docs, items):
    return sorted(((r.doc_id, r.item_id) for r in dc.contaminated(docs, items).collect()), key=str)


def test_passages_and_new_numbers(make, words, items):
    table, texts = items
    rows = [(d, words(200, d)) for d in range(20)]
    inside = lambda t, s: f"{words(40, s)} {t} {words(30, s + 1)}"
    rows += [
        (100, inside(texts[3], 1)),
        (101, inside(" ".join(texts[4].split()[5:20]), 2)),  # half an item
        (102, inside(texts[50].replace("60", "45").replace("3 ", "7 "), 3)),  # with new numbers
        (103, inside(texts[50].replace("Boston", "Denver").upper(), 4)),
        (104, " ".join(texts[5].split()[:6]) + " " + words(30, 5)),  # too little of it
        (105, inside(texts[None], 6)),
        (106, texts[53]),
        (107, inside(texts[3] + " " + texts[6], 8)),
    ]
    assert found(make(rows), table) == sorted([(100, 3), (101, 4), (102, 50), (103, 50), (105, None), (106, 53), (107, 3), (107, 6)], key=str)
    kept = dc.decontaminated(make(rows), table)
    assert sorted(r.doc_id for r in kept.collect()) == [*range(20), 104]
    assert kept.columns == make(rows).columns


def test_slots_must_be_filled_consistently():
    assert dc._consistent([b"1", b"2", b"1"], [b"5", b"6", b"5"])
    assert not dc._consistent([b"1", b"2", b"1"], [b"5", b"6", b"7"])
    assert not dc._consistent([b"1", b"2"], [b"5", b"5"])


def test_inconsistent_numbers_are_no_leak(make, spark):
    item = "add 3 apples to 3 pears then take 4 apples from 3 pears and count"
    table = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = make([(1, item.replace("3", "8").replace("4", "9")), (2, "add 1 apples to 2 pears then take 5 apples from 6 pears and count")])
    assert found(docs, table) == [(1, 1)]


def brute(rows, items):
    """Verbatim runs of RUN words, by trying all."""
    out = set()
    for d, t in rows:
        own = [bare(w) for w in (t or "").split()]
        grams = {tuple(own[i : i + dc.RUN]) for i in range(len(own) - dc.RUN + 1)}
        for i, text in items.items():
            w = [bare(x) for x in (text or "").split()]
            if any(tuple(w[k : k + dc.RUN]) in grams for k in range(len(w) - dc.RUN + 1)):
                out.add((d, i))
    return out


def test_no_verbatim_run_is_missed(make, words, items):
    table, texts = items
    rng = random.Random(9)
    rows = []
    for d in range(60):
        parts = [words(rng.randint(0, 30), d)]
        for _ in range(rng.randint(0, 3)):
            own = texts[rng.randint(0, 11)].split()
            a = rng.randint(0, 20)
            parts += [" ".join(own[a : a + rng.randint(4, 20)]), words(rng.randint(1, 9), rng.random())]
        rows.append((d, " ".join(parts)))
    assert brute(rows, texts) <= set(found(make(rows), table))


def bare(word):
    return word.encode().strip(dc._EDGE).decode().lower()


def plain_tokens(text):
    """(type, value, first word, words) of each token, one word at a time."""
    out = []
    ended = True
    for i, word in enumerate(text.split()):
        shown = word.encode().strip(dc._EDGE).decode()
        low = shown.lower()
        number = dc._NUMBER.fullmatch(low.encode())
        if number and (number[1] is None or number[1] in dc._UNITS) or low.encode() in dc._NUMBER_WORDS:
            kind = "number"
        elif low.encode() in dc._UNITS:
            kind = "unit"
        else:
            kind = "name" if shown[:1].isupper() and len(shown) > 1 and not shown.isupper() else None
        last = None if ended else before
        if (kind == "name" and last == "name") or (kind == "unit" and last == "number"):
            k, v, at, n = out[-1]
            out[-1] = (k, f"{v} {low}", at, n + 1)
        else:
            out.append((kind or low, low, i, 1))
        ended, before = word.rstrip("\"')]}*_")[-1:] in list(".!?:"), kind
    return out


KINDS = ("number", "unit", "name")


def one_to_one(pairs):
    return len(set(pairs)) == len({x for x, _ in pairs}) == len({y for _, y in pairs})


def leaks(item, doc):
    """Whether an item leaks into a document, by trying all diagonals, stretches and splits."""
    a, b = plain_tokens(item), plain_tokens(doc)
    n = len(a)
    if not n or n < dc.LEAST:
        return bool(n) and [bare(w) for w in item.split()] == [bare(w) for w in doc.split()]
    width = dc.window_width(n, 0)
    for shift in range(-n, len(b)):
        same = [0 <= i + shift < len(b) and a[i][0] == b[i + shift][0] for i in range(n)]
        if not any(all(same[i : i + width]) for i in range(n - width + 1)):
            continue
        words_a, words_b = [bare(w) for w in item.split()], [bare(w) for w in doc.split()]
        for i in range(n):  # verbatim words on the word diagonals of meeting tokens
            if same[i] and (i == 0 or not same[i - 1]):
                away, run = b[i + shift][2] - a[i][2], 0
                for j in range(len(words_a)):
                    run = run + 1 if 0 <= j + away < len(words_b) and words_a[j] == words_b[j + away] else 0
                    if run >= dc.RUN:
                        return True
        for i in range(n):
            for j in range(i + dc.RUN, n + 1):
                if all(same[i:j]):
                    pairs = [(a[k][1], b[k + shift][1]) for k in range(i, j) if a[k][0] in KINDS]
                    if len(pairs) * 2 <= j - i and one_to_one(pairs) and (j - i - len(pairs) >= dc.RUN or not all(same[i - 1 : i] + same[j : j + 1]) or (i, j) == (0, n)):
                        whole_run = (i == 0 or not same[i - 1]) and (j == n or not same[j])
                        if whole_run or j - i - len(pairs) >= dc.RUN:
                            return True
        for other in range(-dc.SHIFT, dc.SHIFT + 1):
            for at in range(n + 1):
                use = [(k, k + shift) for k in range(at) if same[k]]
                use += [(k, k + shift + other) for k in range(at, n) if 0 <= k + shift + other < len(b) and a[k][0] == b[k + shift + other][0]]
                slots = [(a[k][1], b[m][1]) for k, m in use if a[k][0] in KINDS]
                if len(use) >= dc.SHARE * n and one_to_one(slots) and len(slots) * 2 <= len(use):
                    return True
    return False


def test_templates_and_slots_by_trying_all(make, spark):
    rng = random.Random(11)
    stock = "the a of apples pears sold counted farmer river road carried early morning then before after every small great".split()

    def text(n):
        made = []
        for _ in range(n):
            r = rng.random()
            made.append(str(rng.randint(1, 9)) if r < 0.15 else rng.choice(["Ann", "Bob", "Eve", "Lee"]) if r < 0.3 else rng.choice(["km", "kg"]) if r < 0.36 else rng.choice(stock))
        return made

    items = {i: text(rng.choice([3, 6, 9, 12, 16, 24])) for i in range(25)}
    rows = []
    for d in range(120):
        own = list(items[rng.randint(0, 24)])
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(own))
            own[at : at + rng.randint(0, 1)] = text(rng.randint(0, 1)) or ["so"]
        if rng.random() < 0.5:  # other numbers, mapped one to one
            own = [str(int(w) + 20) if w.isdigit() else w for w in own]
        rows.append((d, " ".join(text(rng.choice([0, 0, 8])) + own + text(rng.choice([0, 0, 8])))))
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    want = {(d, i) for d, t in rows for i, x in items.items() if leaks(" ".join(x), t)}
    got = set(found(make(rows), table))
    assert want <= got
    # the most frequent values of a slot stand where a split is inconsistent, which brute force doesn't try
    assert len(got - want) <= 0.1 * len(want) and len(want) > 60


def test_other_names_units_and_added_words(make, spark):
    items = [
        (1, "How many apples does Ann Lee have after Bob eats 3 pears"),
        (2, "a tank holds 20 kg of sand and a truck brings 5km more of it every day"),
        (3, "the clerk counts seven boxes on monday and the others wait outside for him"),
        (4, "what is that"),
        (5, "one word was put into the middle of this item"),
    ]
    docs = make(
        [
            (1, "So: How many apples does Eve have after Tom eats 4 pears"),
            (2, "a tank holds 30kg of sand and a truck brings 7 miles more of it every day"),
            (3, "the clerk counts 9 boxes on monday and the others wait outside for him"),
            (4, "What is that?"),
            (5, "but what is that here"),
            (6, "one word was put right into the middle of this item"),
        ]
    )
    assert found(docs, spark.createDataFrame(items, "item_id long, text string")) == [(1, 1), (2, 2), (3, 3), (4, 4), (6, 5)]


@pytest.mark.parametrize(("name", "value"), [("ITEM_BYTES", 300), ("SCREEN_WINDOWS", 0), ("BROADCAST_ROWS", 0), ("SALTS", 1)])
def test_limits_change_nothing(make, items, monkeypatch, name, value):
    table, texts = items
    docs = make([(i, t) for i, t in enumerate(texts.values())])
    whole = found(docs, table)
    monkeypatch.setattr(dc, name, value)
    assert found(docs, table) == whole
    assert dc.decontaminated(docs, table).count() == len(texts) - len({d for d, _ in whole})


def test_names_of_columns(spark, items):
    docs = spark.createDataFrame([(1, items[1][0], 7, 8, 9), (2, "clean", 7, 8, 9)], "doc_id long, text string, of long, of_key long, KEY long")
    assert [tuple(r) for r in dc.decontaminated(docs, items[0]).collect()] == [(2, "clean", 7, 8, 9)]


def test_odd_rows(odd, make, items, spark):
    docs, rows = odd
    assert found(docs, items[0]) == []
    assert dc.decontaminated(docs, items[0]).count() == len(rows)
    assert found(make([]), items[0]) == [] and found(docs, items[0].limit(0)) == []
    one = items[1][0]
    assert found(make([(1, one), (1, one), (None, one)]), items[0]) == [(1, 0), (1, 0), (None, 0)]
    twice = spark.createDataFrame([(7, one), (7, one)], "item_id long, text string")
    assert found(make([(1, one)]), twice) == [(1, 7), (1, 7)]


def test_what_differs_beside_a_run_takes_nothing_from_it(make, spark):
    head = "the old farmer by the river sold 5 dollars worth of ripe"
    tail = "to the quiet neighbours who came along the muddy road early in the morning with a cart and counted 5 apples"
    item = f"{head} {tail}"
    numbers = "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20"
    heavy = f"{numbers} x so then each of the workers carried a heavy sack home"
    table = spark.createDataFrame([(1, item), (2, heavy)], "item_id long, text string")
    docs = make(
        [
            (1, item.replace("5 apples", "6 apples")),  # a verbatim run, and a slot that contradicts another one
            (2, f"{head.replace('5', '7')} {tail.replace('5', '8')}"),  # each half consistent by itself
            (3, heavy.replace("1 2 3", "3 2 2")),  # a longer run of slots, and a verbatim one after it
            (4, heavy.replace(numbers, " ".join(str(90 - n) for n in range(20))).replace("sack", "bag").replace("then", "now")),  # too few words
        ]
    )
    assert found(docs, table) == [(1, 1), (2, 1), (3, 2)]


def test_consistent_stretches_by_trying_all():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randint(8, 30)
        slots = np.array([rng.random() < 0.5 for _ in range(n)])
        mine = [str(rng.randint(0, 4)).encode() if s else b"w" for s in slots]
        theirs = [str(rng.randint(0, 9) if rng.random() < 0.15 else int(x) + 1).encode() if s else b"w" for s, x in zip(slots, mine, strict=True)]
        fits = []
        for i in range(n):
            for j in range(i + dc.RUN, n + 1):
                picks = [k for k in range(i, j) if slots[k]]
                if len(picks) * 2 <= j - i and j - i - len(picks) >= dc.RUN and dc._consistent([mine[k] for k in picks], [theirs[k] for k in picks]):
                    fits.append(j - i)
        got = dc._consistent_run(slots, mine, theirs)
        assert (got[1] - got[0] if got else 0) == max(fits, default=0)
