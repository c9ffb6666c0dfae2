import random
import zlib
from collections import Counter

import numpy as np
import pytest

from stratalog.llm.common import Scratch
from stratalog.llm.op01_packing import Sweep, pack
from stratalog.llm.op08_token_store import lookup, read_token_store, summarise, write_token_store
from stratalog.llm.tokens import default_path, encoder


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def ids(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


@pytest.mark.parametrize("text", ["Hello, world! it's 1234 I'LL don't", "a<|endoftext|>b <|startoftext|>", "É é ñÑ ß ÿ ÿÿ", "ﬁne ½ ² ①", "tab\tnew\nline\x0bvt\x1cfs\x85nel\xa0nbsp", "é combining", "İstanbul ΣΑΣ σας", "日本語 😀😀", "''''s 's't", "x" * 5000, " sep", "$$$&&& --- ...", " ", "", None, "nul\x00byte \x7f del"])
def test_word_cache_gives_the_library_s_ids(tokenizer, text):
    assert encoder(default_path())(text) == ids(tokenizer, text).tobytes()


def test_random_texts(tokenizer):
    rnd = random.Random(1)
    for _ in range(400):
        text = "".join(rnd.choice("abE é'sß1 2.,\t́ Ω<|>😀") for _ in range(rnd.randrange(40)))
        assert encoder(default_path())(text) == ids(tokenizer, text).tobytes(), repr(text)


def test_store_round_trip(spark, docs, rows, empty, tokenizer):
    scratch = Scratch(spark, "test-store")
    write_token_store(docs, scratch.path("orc"))
    store = read_token_store(spark, scratch.path("orc"))
    got = sorted(((r.doc_id is not None, r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in summarise(store).collect()), key=lambda r: r[2])
    want, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        x = ids(tokenizer, t)
        want.append((d is not None, d, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert got == want
    found = lookup(spark, scratch.path("orc"), [3, 901, 12345])
    assert {(r.doc_id, len(r.ids)) for r in found.collect()} == {(3, len(ids(tokenizer, dict(rows)[3]))), (901, 1)}
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()
    write_token_store(empty, scratch.path("none"))
    assert summarise(read_token_store(spark, scratch.path("none"))).count() == 0


def check_packing(got, capacity):
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [4096, 64, 7])
def test_packing(docs, rows, tokenizer, capacity):
    got = pack(docs, capacity).collect()
    want = Counter()
    for d, t in rows:
        x = ids(tokenizer, t)
        want.update((d, k, k * capacity, len(x[k * capacity : (k + 1) * capacity]), zlib.crc32(x[k * capacity : (k + 1) * capacity].tobytes())) for k in range(-(-len(x) // capacity)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    used, least = check_packing(got, capacity), -(-sum(r.length for r in got) // capacity)
    assert used <= least * 1.05 + 1


def test_packing_nothing(empty):
    assert pack(empty).count() == 0


def test_sweep_is_best_fit():
    rnd = random.Random(2)
    for _ in range(200):
        capacity = rnd.choice([10, 50])
        sizes = [rnd.randrange(1, capacity + 1) for _ in range(rnd.randrange(60))]
        work = Sweep([], capacity)
        assert work.run([(s, 0, n) for s, n in Counter(sizes).items()], 0) == []
        placed = [(b + i // k, at + i % k * s, s) for s, _, n, b, k, at in work.placed for i in range(n)]
        gaps: list[int] = []
        for s in sorted(sizes, reverse=True):  # one by one, into the smallest gap that is large enough
            fits = [g for g in gaps if g >= s]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - s)
            else:
                gaps.append(capacity - s)
        assert sorted(s for *_, s in placed) == sorted(sizes) and len({b for b, *_ in placed}) == len(gaps)
        ends = Counter()
        for b, at, s in sorted(placed):
            assert ends[b] == at
            ends[b] += s
        assert max(ends.values(), default=0) <= capacity


def test_other_tokenizers_go_through_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    other, texts = Tokenizer.from_file(path), ["Hello,  World! it's 1234", " é😀 <|endoftext|> b", "", None]
    for t in texts:
        assert encoder(path)(t) == ids(other, t).tobytes()
    got = pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 64, path).collect()
    assert {r.doc_id: (r.length, r.ids_crc32) for r in got} == {i: (len(ids(other, t)), zlib.crc32(ids(other, t).tobytes())) for i, t in enumerate(texts)}


def test_equal_rows_are_packed_each(spark):
    """A third of all rows are one row, many times."""
    df = spark.createDataFrame([(7, "the very same text")] * 300 + [(i, "other words " * (i % 9)) for i in range(600)], "doc_id long, text string").repartition(4)
    got = pack(df, 64).collect()
    assert len(got) == 900 and len({(r.sequence_id, r.offset) for r in got}) == 900
    check_packing(got, 64)
    scratch = Scratch(spark, "test-equal")
    write_token_store(df, scratch.path("orc"))
    places = sorted((r.start, r.n_tokens, r.doc_id) for r in summarise(read_token_store(spark, scratch.path("orc"))).collect())
    assert len(places) == 900 and all(a[0] + a[1] == b[0] and a[2] <= b[2] for a, b in zip(places, places[1:]))
