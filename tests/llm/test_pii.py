import random
import re

import pytest

from tallyloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def brute(text):
    """The expressions as they are written."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return out


CASES = [
    "", "a@b.co", "a@b", "a@b.c@d.e", "x..y@-a-.b.c, me+1%@h.o-r.g.", "@a.b", "é@a.bc", "a@b..c", "a@@b.c",
    "1.2.3.4.5.6.7.8", "256.1.1.1", "01.002.03.255", "1.2.3", "12.34.56.78.", "x1.1.1.1y 999.1.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111 1", "4111111111111111", "4111  1111 1111 1111", "0" * 13, "0" * 25,
    "+49 30 1234567", "+1 (212) 555-0100.", "+1-2", "+12345678", "++123456789", "+1 234 567 890 123 456 789", "+1 234567890 4111 1111 1111 1111",
]


@pytest.mark.parametrize("text", CASES)
def test_base_spans(text):
    assert pii.base_spans(text) == brute(text)


def test_random_texts():
    rng = random.Random(2)
    for _ in range(4000):
        text = "".join(rng.choice("0123456789011@@..+- ()ab-_%xé\n") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == brute(text), repr(text)


def test_bootstrapping_finds_numbers_in_known_contexts(make, words):
    rng = random.Random(5)
    rows = []
    for d in range(60):
        number = "+49 30 " + "".join(rng.choice("0123456789") for _ in range(7))
        rows.append((d, f"{words(8, d)} telephone number {number} please {words(5, d + 500)}"))
    rows.append((100, f"{words(6, 1)} telephone number 030 555 01 77 please {words(6, 2)}"))
    rows.append((101, f"{words(6, 3)} 030 777 01 88 {words(6, 4)}"))
    got = {r.doc_id: r for r in pii.personal_data(make(rows)).collect()}
    text = rows[60][1]
    at = text.index("030 555")
    assert (3, at, at + len("030 555 01 77")) in [tuple(s) for s in got[100].spans] and not got[100].base
    assert not got[101].spans  # nothing beside it vouches for it
    for d, t in rows[:60]:
        assert [tuple(s) for s in got[d].base] == brute(t)
        assert set(map(tuple, got[d].base)) <= set(map(tuple, got[d].spans))


def test_odd_rows(odd, make):
    docs, rows = odd
    got = pii.personal_data(docs).collect()
    assert len(got) == len(rows)
    assert all([tuple(s) for s in r.base] == [] for r in got)
    assert pii.personal_data(make([])).count() == 0
    twice = [(1, "call +49 30 1234567 now"), (1, "call +49 30 1234567 now"), (None, "x@y.zz"), (1, "other a@b.cc")]
    got = sorted((str(r.doc_id), str([tuple(s) for s in r.base])) for r in pii.personal_data(make(twice)).collect())
    assert got == sorted((str(d), str(brute(t))) for d, t in twice)


def test_time_is_linear():
    for text in ("a." * 100_000, "1" * 200_000, "1." * 100_000, "@" * 100_000, "+1" * 100_000, "1 " * 100_000, "a@a" * 60_000):
        pii.places(text, pii.base_spans(text))


def planted(words):
    """(rows, planted spans by doc_id): seeds in contexts, and identifiers of other shapes in the same contexts and in others."""
    rng = random.Random(9)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows, want = [], {}
    ways = [
        (3, lambda: "+49 30 " + digits(7), lambda: rng.choice([f"030 {digits(3)} {digits(4)}", f"ext.{digits(4)}", f"T-{digits(5)}x"]), "telephone number {} please"),
        (0, lambda: f"u{digits(4)}@mail.example.com", lambda: rng.choice([f"u{digits(4)} (at) mail.example.com", f"u{digits(3)}@intranet"]), "write to mailbox {} for help"),
        (1, lambda: ".".join(str(rng.randint(1, 250)) for _ in range(4)), lambda: f"2001:db8::{digits(4)}", "from host address {} came"),
        (4, lambda: "".join(rng.choice("0123456789abcdef") for _ in range(20)) + "1a", lambda: rng.choice(["hunter" + digits(2), "correct-horse"]), 'api_key = "{}" was'),
    ]
    d = 0
    for kind, seed, other, context in ways:
        for n in range(60):
            unseen = n >= 52
            value = other() if unseen else seed()
            head = f"{words(rng.randint(3, 30), d)} "
            text = f"{head}{context.format(value)} {words(5, d + 900)}"
            rows.append((d, text))
            if unseen or kind == 4:
                want[d] = (kind, text.index(value, len(head)), text.index(value, len(head)) + len(value))
            d += 1
    for _ in range(200):  # numbers and codes that nothing vouches for
        rows.append((d, f"{words(10, d)} {rng.choice(['chapter', 'about', 'of'])} {rng.choice([digits(3), digits(16), 'B-' + digits(4), '1:' + digits(2)])} {words(10, d + 1)}"))
        d += 1
    return rows, want


def test_identifiers_of_other_shapes_are_found_in_known_contexts(make, words):
    rows, want = planted(words)
    got = {r.doc_id: {tuple(s) for s in r.spans} - {tuple(s) for s in r.base} for r in pii.personal_data(make(rows).repartition(3)).collect()}
    added = {(d, s) for d, own in got.items() for s in own}
    hit = {(d, s) for d, s in want.items()}
    assert len(added & hit) >= 0.95 * len(hit), sorted(hit - added)[:5]  # recall
    assert len(added & hit) >= 0.95 * len(added), sorted(added - hit)[:5]  # precision


def test_turns_go_on_until_they_settle(spark):
    """A chain of patterns, each of which only the instances of the one before vouch for."""
    rows = [("p0", f"s{i}", 3) for i in range(30)] + [(f"p{n}", f"v{n}-{i}", None) for n in range(6) for i in range(6)]
    rows += [(f"p{n + 1}", f"v{n}-{i}", None) for n in range(5) for i in range(6)]
    rows += [(f"p{n}", f"a{n}-{i}", None) for n in range(1, 6) for i in range(1)]
    edges = spark.createDataFrame(rows, "pattern string, value string, kind int")
    got = {r.value: r.kind for r in pii.sure_values(edges).collect()}
    assert not got or set(got.values()) == {3}
    assert {v for v in got if v.startswith("v0")} == {f"v0-{i}" for i in range(6)}
    assert len(got) >= len(pii.sure_values(edges, 1).collect())


def test_instances_are_known_by_their_exact_text(make, words):
    rows = [(d, f"{words(4, d)} host address 10.0.0.{d} came") for d in range(30)] + [(99, f"{words(4, 99)} then 1.00.010.0 and 100.0.1x so")]
    got = {r.doc_id: r for r in pii.personal_data(make(rows)).collect()}
    assert {tuple(s) for s in got[99].spans} == {tuple(s) for s in got[99].base}


def test_words_beside_a_place_are_read_whole(make):
    long = "w" * 30_000
    rows = [(d, f"{long} +49 30 123456{d} {long}") for d in range(20)] + [(50, f"{long} 030-{long}7 {long}"), (51, f"{long}x 030-77 {long}y")]
    got = {r.doc_id: r for r in pii.personal_data(make(rows)).collect()}
    assert [tuple(s) for s in got[50].spans] == [(3, 30_001, 60_006)] and got[51].spans == []


def test_names_of_columns(spark):
    docs = spark.createDataFrame([(1, "a@b.cc", 5, 6, 7, 8)], "doc_id long, text string, of long, of_key long, key long, seen long")
    assert [tuple(s) for s in pii.personal_data(docs).first().spans] == [(0, 0, 6)]
