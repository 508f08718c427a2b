from collections import defaultdict

from tallyloom.llm.line_dedup import line_dedup


def brute(rows, sites):
    spread = defaultdict(set)
    bare = lambda x: x.strip(" \t\r")
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            if bare(x) and s is not None:
                spread[bare(x)].add(s)
    out = []
    for d, t, _ in rows:
        own = (t or "").split("\n")
        stay = [x for x in own if len(spread[bare(x)]) < sites or not bare(x)]
        out.append((str(d), len(own), len(own) - len(stay), "\n".join(stay)))
    return sorted(out)


def check(make, rows, sites=5):
    docs = make([(d, t, "en", s) for d, t, s in rows])
    got = sorted((str(r.doc_id), r.n_lines, r.n_removed, r.kept) for r in line_dedup(docs, "source", sites).collect())
    assert got == brute(rows, sites)


def test_lines_of_many_sites_go(make):
    rows = [(d, f"own {d}\nshared by all \t\n\n  shared by {d % 7 % 5}\nshared by all", f"s{d % 7}") for d in range(40)]
    check(make, rows)
    check(make, rows, 1)
    check(make, rows, 7)


def test_near_the_threshold(make):
    for sites in (4, 5, 6, 30):
        rows = [(1000 * n + i, f"line of {n}\nown {n} {i}", f"s{i}") for n in (sites - 1, sites, sites + 1) for i in range(n)]
        check(make, rows, sites)


def test_odd_rows(odd, make):
    _, rows = odd
    # one doc_id with several texts is several rows, each judged by its own lines
    check(make, [(d, t, None if i % 5 == 0 else f"s{i}") for i, (d, t) in enumerate(rows)], 2)
    check(make, [(None, "a\nb", "s1"), (None, "a\nc", "s2"), (1, "a", None), (2, "a", None), (3, "\n\n", "s1"), (3, "", "s2")], 2)
    assert line_dedup(make([])).count() == 0
