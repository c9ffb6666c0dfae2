import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from stratalog.llm import bwt
from stratalog.llm.common import Scratch
from stratalog.llm.components import components
from stratalog.llm.op06_jaccard_join import near_duplicates, one_of_each
from stratalog.llm.op09_suffix_dedup import remove_repeats


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def shingles_key(text):
    return tuple(sorted(shingles(text)))


def union(pairs, nodes):
    group = {n: n for n in nodes}
    for a, b in pairs:
        low, high = sorted((group[a], group[b]))
        if low != high:
            group = {k: low if v == high else v for k, v in group.items()}
    return group


def brute(rows):
    """(doc_id, set size, component) of each row."""
    sets = [shingles(t) for _, t in rows]
    group = union([(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and 100 * len(a & b) >= 75 * len(a | b)], range(len(rows)))
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[group[i]].append(d)
    return [(d, len(s), min(ids[group[i]], default=None) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def test_jaccard_join(docs, rows, empty):
    got = [tuple(r) for r in near_duplicates(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))
    assert len({c for *_, c in got}) < len(got) - 20
    assert near_duplicates(empty).count() == 0


def test_one_document_of_each_group_stays(docs, rows):
    left = one_of_each(docs)
    assert left.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in left.collect()]
    sets = [shingles(t) for _, t in kept]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            assert not (a and b and 100 * len(a & b) >= 75 * len(a | b))
    texts = {shingles_key(t) for _, t in kept}
    groups = brute(rows)
    for (d, t), (_, n, c) in zip(rows, groups):  # who went has a group whose least document stays
        assert not n or shingles_key(t) in texts or c in {k for k, _ in kept}
    assert sum(not s for s in sets) == sum(not shingles(t) for _, t in rows)


def test_large_group_of_near_copies(spark):
    """All of a large group link to few; their number of pairs would be its square."""
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        w = base[:]
        w[rnd.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"u{i}_{j}" for j in range(60))) for i in range(20)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(got[i] == 0 for i in range(400)) and all(got[1000 + i] == 1000 + i for i in range(20))


def test_components(spark):
    rnd = random.Random(1)
    for n, k in ((60, 40), (30, 0)):
        first = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(k)]
        more = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(10)]
        frame = lambda e: spark.createDataFrame(e, "a long, b long")
        scratch = Scratch(spark, "test-components")
        found = components(frame(first), scratch, "one")
        both = components(frame(more), scratch, "two", known=found)
        linked = {x for e in first + more if e[0] != e[1] for x in e}
        want = union(first + more, range(n))
        assert {r.node: r.comp for r in both.collect()} == {x: want[x] for x in linked}


def test_repeated_strings():
    rnd = random.Random(3)
    for _ in range(60):
        length = rnd.choice([3, 5, 8, 20])
        parts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(1, 40))) for _ in range(rnd.randrange(1, 12))]
        symbols, valid, want = [], [], defaultdict(set)
        for p in parts:
            for i in range(len(p)):
                valid.append(i + length <= len(p))
                if valid[-1]:
                    want[p[i : i + length]].add(len(symbols) + i)
            symbols += [b + 1 for b in p] + [0]
            valid.append(False)
        at, kind = bwt.repeated(np.array(symbols, np.int16), np.array(valid), length)
        got = defaultdict(set)
        for a, k in zip(at.tolist(), kind.tolist()):
            got[k].add(a)
        assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in want.values() if len(x) > 1}


def kept_by_brute_force(own, length):
    seen, want = set(), {}
    for d, t in sorted(own):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(b[i : i + length])
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        want[d] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return want


def kept(spark, own, *more):
    df = spark.createDataFrame(own, "doc_id long, text string").repartition(5)
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df, *more).collect()}


@pytest.mark.parametrize("length", [100, 30, 16, 135, 136, 300])
def test_suffix_dedup(spark, rows, empty, length):
    base = "abcdefghij klmnop qrst" * 20
    own = [r for r in rows if r[0] not in (None, 904)]
    own += [(10**6, "a" * 1000), (10**6 + 1, "a" * 99), (10**6 + 4, base), (10**6 + 5, "x" + base[3:200] + "y" + base[5:]), (10**6 + 6, "é" * 300), (10**6 + 7, "z" * 100 + base)]
    assert kept(spark, own, length) == kept_by_brute_force(own, length)
    assert remove_repeats(empty, length).count() == 0


@pytest.mark.parametrize("hot", [None, 8])
def test_one_very_common_anchor(spark, hot, monkeypatch):
    """Many documents share one line in unlike surroundings; with hot = 8 its contexts are sent window by window."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(3, 9)))
    line, edge = " ".join(word() for _ in range(14)), [word() for _ in range(4)]
    own = [(i, " ".join([word() for _ in range(rnd.randrange(30))] + [rnd.choice(edge), line, rnd.choice(edge)] + [word() for _ in range(rnd.randrange(30))])) for i in range(400)]
    want = kept_by_brute_force(own, 100)
    assert kept(spark, own, 100, hot) == want and sum(w[1] > 0 for w in want.values()) > 100


def test_copies_are_one_document(spark):
    """Rows with equal doc_id and text have one result, also if they fall into different blocks."""
    rnd = random.Random(2)
    text = lambda: "".join(rnd.choice("abcd") for _ in range(400))
    first, other = text(), text()
    own = [(5, first + other), (3, first), (5, first + other), (5, first + other), (9, other + first)]
    df = spark.createDataFrame(own, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_removed) for r in remove_repeats(df).collect())
    assert got == [(3, 0), (5, 400), (5, 400), (5, 400), (9, 800)]


@pytest.mark.parametrize("length", [15, 0, -1, 40_000])
def test_lengths_that_are_refused(spark, empty, length):
    with pytest.raises(ValueError):
        remove_repeats(empty, length)


def test_suffix_dedup_of_odd_rows(docs, rows):
    got = remove_repeats(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in rows)


@pytest.mark.parametrize("n", [1, 7, 211])
def test_labels_are_dealt_out_evenly(spark, n):
    from pyspark.sql import functions as F

    from stratalog.llm.common import label_of, number_of

    numbers = np.array([*range(1000), 2**31 - 1, 123456789])
    labels = label_of(numbers)
    assert (number_of(labels) == numbers).all() and len(set(labels.tolist())) == len(numbers)
    df = spark.createDataFrame([(int(j), int(x)) for j, x in zip(numbers, labels)], "j long, label int")
    assert df.filter(F.pmod(F.hash("label"), F.lit(n)) != F.col("j") % n).count() == 0
