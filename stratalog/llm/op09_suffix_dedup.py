"""Operator 9: removal of repeated byte strings by threshold-bounded interval expansion on Burrows-Wheeler transforms.

A string of ``length`` bytes (a window) is sent to one place by its content: of its 16-byte substrings, the one with the
smallest hash (the leftmost, if equal) is its anchor. On one side of the anchor at least half of the window's other bytes
lie; the anchor with these is the window's *key*. Neighbouring windows mostly share a key; a *context* is such a run of
windows with the bytes they cover. Equal windows have equal keys, so all places of a string meet in the bucket of its
key's hash, and no bucket has to see the whole corpus.

1. Documents are packed into blocks of some megabytes, stored in a bucketed table: what comes back for a block meets it
   without shuffling texts again.
2. Every block sends the hashes of its keys, without any text. Keys of two contexts or more come back; a key of very many
   different contexts comes back marked as hot.
3. Blocks send the contexts of such keys alone. Of equal contexts in a block (bytes are compared) the earliest is sent;
   the others are repeats as they stand. Contexts of a hot key are sent window by window, each with its own content as
   key, so that no key gathers an unbounded number of different contexts; equal ones come once from a block at most.
4. In a bucket, of equal contexts the earliest stays. Where a key has different contexts, a Burrows-Wheeler transform of
   their concatenation is expanded (see ``bwt``) until common prefixes reach ``length``; rows that no shorter common
   prefix parts start with one string. All its places but the earliest are repeats.
5. Repeats become byte intervals, which go back to the blocks.

The number of buckets follows the bytes of text, so a bucket's size does not grow with the input.

Order is doc_id, then a hash of the text, then position. Edge cases: null or empty text has no bytes; texts shorter than
``length`` keep all; rows with equal doc_id are ordered by their text's hash, and rows that also have equal text are one
document with one result; a null doc_id comes first; an empty table gives no rows; other columns are ignored; a length
outside 16 to 30000 is refused.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches, ending, give_back, label_of, number_of, partitions_for, shuffle_partitions

SEED, LONGEST = 16, 30_000
#: Bytes of text hashed at once, and of contexts in one transform (a key's contexts stay together).
CHUNK, SHARD = 1 << 20, 1 << 20
#: Bytes of text in a block (a longer document is a block of its own) and for each bucket.
BLOCK, BUCKET = 8 << 20, 8 << 20
PACKED = "slot int, block long, raw long, blob binary"
KEYS = "bucket int, slot int, blob binary"
SENT = "bucket int, slot int, block long, blob binary, spans binary"
SPANS = "slot int, block long, spans binary"
_HOT = 1 << 63


def _anchors(data: bytes, length: int):
    """For each position the place of its window's anchor. len(data) < 2**24."""
    import numpy as np

    from .shingles import mix

    n = len(data)
    padded = np.frombuffer(data + bytes(SEED), np.uint8)
    words = np.ndarray((n + 8,), "<u8", padded.data, 0, (1,))
    h = mix(words[:n] * np.uint64(0x9E3779B97F4A7C15) + mix(words[8 : n + 8] + np.uint64(0x632BE59BD9B4E019)))
    least = (h & ~np.uint64(0xFFFFFF)) | np.arange(n, dtype=np.uint64)
    wide, span = length - SEED + 1, 1
    while 2 * span <= wide:
        np.minimum(least[:-span], least[span:], out=least[:-span])
        span *= 2
    if wide > span:
        np.minimum(least[: span - wide], least[wide - span :].copy(), out=least[: span - wide])
    return (least & np.uint64(0xFFFFFF)).astype(np.int64)


def contexts(texts: list[bytes], length: int):
    """(text, start, size, key hash, content hash) arrays of all contexts of the texts."""
    import numpy as np

    from .shingles import _power, mix

    half = (length - SEED + 1) // 2

    pieces = [(i, at, min(CHUNK, len(t) - at - length + 1)) for i, t in enumerate(texts) for at in range(0, max(len(t) - length + 1, 0), CHUNK)]
    out: list[list] = [[] for _ in range(5)]
    k = 0
    while k < len(pieces):
        group, total = [], 0
        while k < len(pieces) and (not group or total + pieces[k][2] <= CHUNK):
            group.append(pieces[k])
            total += pieces[k][2]
            k += 1
        sizes = np.array([w + length - 1 for *_, w in group], np.int64)
        base = np.cumsum(sizes) - sizes
        data = b"".join([texts[i][at : at + w + length - 1] for i, at, w in group])
        place = _anchors(data, length)
        windows = np.array([w for *_, w in group], np.int64)
        which = np.repeat(np.arange(len(group)), windows)
        at = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows) + base[which]
        anchor = place[at]
        left = anchor - at >= half  # the key lies to the left of the anchor's end, or to the right of its start
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (which[1:] != which[:-1]) | (left[1:] != left[:-1])]))
        last = np.concatenate([first[1:], [len(at)]]) - 1
        up, down = _power(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        hashed = lambda s, e, more: mix((sums[e] - sums[s]) * down[s] + more.astype(np.uint64))  # noqa: B023,E731
        s, e, left = at[first], at[last] + length, left[first]
        low = anchor[first] - half * left
        offset = np.array([o for _, o, _ in group], np.int64) - base
        for col, x in zip(out, (np.array([i for i, *_ in group], np.int64)[which[first]], s + offset[which[first]], e - s, hashed(low, low + SEED + half, left), hashed(s, e, e - s))):
            col.append(x)
    kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64)
    return [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, kinds)]


def _merged(key, start, end):
    """Unions of overlapping or touching intervals of one key; rows must be sorted by key, then start."""
    import numpy as np

    if not len(key):
        return key, start, end
    far = np.int64(1 << 44)
    reach = np.maximum.accumulate(end + key * far) - key * far  # keys ascend, so an earlier key never reaches a later one
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (start[1:] > reach[:-1])])
    first = np.flatnonzero(new)
    return key[first], start[first], np.maximum.reduceat(end, first)


def _rank(doc, h):
    """Dense numbers of (doc, h) pairs in their order, and the pairs."""
    import numpy as np

    order = np.lexsort((h, doc))
    new = np.concatenate([[False], (doc[order[1:]] != doc[order[:-1]]) | (h[order[1:]] != h[order[:-1]])]) if len(doc) else np.zeros(0, bool)
    rank = np.empty(len(doc), np.int64)
    rank[order] = np.cumsum(new)
    firsts = order[np.concatenate([[True], new[1:]])] if len(doc) else order
    return rank, doc[firsts], h[firsts]


def _blocks(slots: int):
    """Documents (doc_id, h, text) as one row for each block. Blocks go round the slots, so that these are of one size."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0
        pack = zstandard.ZstdCompressor(level=3)

        def packed():
            doc, h, texts = zip(*held)
            head = [np.array([len(held)], "<u8"), np.array(doc, "<i8"), np.array(h, "<i8"), np.array([len(t) for t in texts], "<u8")]
            blob = pack.compress(b"".join([x.tobytes() for x in head] + list(texts)))
            cells = ((int(label_of((part + k) % slots)), pa.int32()), (part << 32 | k, pa.int64()), (size, pa.int64()), (blob, pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in cells], names=["slot", "block", "raw", "blob"])

        for batch in batches:
            for d, h, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                held.append((d, h, t.encode()))
                size += len(held[-1][2])
                if size >= BLOCK:
                    yield packed()
                    k, held, size = k + 1, [], 0
        if held:
            yield packed()

    return ending(run)


def _unpacked(blob: bytes):
    """doc, h, texts of a block."""
    import numpy as np
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    doc, h, size = (np.frombuffer(raw, t, n, 8 + 8 * n * i) for i, t in enumerate(("<i8", "<i8", "<u8")))
    ends = (8 + 24 * n + np.cumsum(size)).astype(np.int64).tolist()
    return doc, h, [raw[b - z : b] for b, z in zip(ends, size.tolist())]


def _only(doc, h):
    """Number of each row's document, and the first row of each; rows with equal doc_id and text are one."""
    import numpy as np

    rank, _, _ = _rank(doc, h)
    _, first = np.unique(rank, return_index=True)
    return rank, first


def _sections(keys, buckets: int):
    """(bucket's label, positions) of the keys that go to each bucket, positions ascending."""
    import numpy as np

    to = (keys % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(to, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], to[by[1:]] != to[by[:-1]], [True]])) if len(to) else np.zeros(1, np.int64)
    names = label_of(to[by[edge[:-1]]] if len(to) else to).tolist()
    for x, y, name in zip(edge[:-1].tolist(), edge[1:].tolist(), names):
        yield name, by[x:y]


def _keys(length: int, buckets: int):
    """For each bucket a block's keys, 32 bits of each besides the bucket, with the number of its different contexts (255 at most)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out: list[list] = [[], [], []]
            for slot, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc, h, texts = _unpacked(blob)
                _, _, _, key, content = contexts([texts[i] for i in _only(doc, h)[1].tolist()], length)
                order = np.lexsort((content, key))
                key, content = key[order], content[order]
                other = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
                first = np.flatnonzero(other)
                fresh = other | np.concatenate([[True], content[1:] != content[:-1]]) if len(key) else other
                number = np.minimum(np.add.reduceat(fresh, first, dtype=np.int64), 255) if len(first) else first
                # a key of equal contexts alone is no less repeated: what is sent of them shows it
                number = np.maximum(number, np.minimum(np.diff(np.append(first, len(key))), 2))
                key = key[first]
                for to, own in _sections(key, buckets):
                    for col, v in zip(out, (to, slot, np.array([len(own)], "<u8").tobytes() + (key[own] >> np.uint64(32)).astype("<u4").tobytes() + number[own].astype("u1").tobytes())):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "slot", "blob"])

    return ending(run)


def _repeated(hot: int):
    """A bucket's keys of two contexts or more, for each slot that has them: bucket and key in one integer, its top bit for hot keys."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        bucket, slots, blobs = int(number_of(table.column("bucket")[0].as_py())), table.column("slot").to_numpy(), table.column("blob").to_pylist()
        del table
        n = np.array([int(np.frombuffer(x, "<u8", 1)[0]) for x in blobs], np.int64)
        key = np.concatenate([np.frombuffer(x, "<u4", k, 8) for x, k in zip(blobs, n.tolist())])
        number = np.concatenate([np.frombuffer(x, "u1", k, 8 + 4 * k) for x, k in zip(blobs, n.tolist())])
        del blobs
        slot = np.repeat(slots, n)
        _, which = np.unique(key, return_inverse=True)
        total = np.bincount(which, weights=number)[which] if len(which) else number
        own = np.flatnonzero(total > 1)
        code = np.uint64(bucket << 32) | key[own].astype(np.uint64) | np.where(total[own] > hot, np.uint64(_HOT), np.uint64(0))
        slot = slot[own]
        order = np.lexsort((code, slot))
        code, slot = code[order], slot[order]
        edge = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1], [True]])) if len(slot) else np.zeros(1, np.int64)
        pairs = [(int(slot[a]), np.unique(code[a:b]).astype("<u8").tobytes()) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
        give_back()
        return pa.table({"slot": pa.array([p[0] for p in pairs], pa.int32()), "blob": pa.array([p[1] for p in pairs], pa.binary())})

    return run


def _spelled(which, start, end) -> bytes:
    import numpy as np

    return np.stack([np.asarray(x, "<u4") for x in (which, start, end)], 1).tobytes()


def _send(length: int, buckets: int):
    """Of each block the contexts of repeated keys, for each bucket, and its own repeats as spans (row, start, end)."""

    def wanted(texts, known):
        """which, start, size, key, content of what is sent: contexts, and the windows of hot keys."""
        import numpy as np
        import xxhash

        found = contexts(texts, length)
        if not len(known) or not len(found[0]):
            return [x[:0] for x in found]
        key = found[3]
        known = np.unique(known)
        codes = known & np.uint64(_HOT - 1)
        by = np.argsort(codes)
        codes, hot = codes[by], known[by] >= np.uint64(_HOT)
        code = (key % np.uint64(buckets)) << np.uint64(32) | key >> np.uint64(32)
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        hit = codes[at] == code
        plain, single = np.flatnonzero(hit & ~hot[at]), np.flatnonzero(hit & hot[at])
        out = [x[plain] for x in found]
        if len(single):
            n = found[2][single] - length + 1
            which = np.repeat(found[0][single], n)
            start = np.repeat(found[1][single], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            own = np.fromiter((xxhash.xxh3_64_intdigest(texts[i][s : s + length]) for i, s in zip(which.tolist(), start.tolist())), np.uint64, len(which))
            out = [np.concatenate(x) for x in zip(out, (which, start, np.full(len(which), length), own, own))]
        return out

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for slot, block, blob, known in zip(*(batch.column(i).to_pylist() for i in range(4))):
                doc, h, texts = _unpacked(blob)
                _, only = _only(doc, h)
                doc, h, texts = doc[only], h[only], [texts[i] for i in only.tolist()]
                which, start, size, key, content = wanted(texts, np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x, "<u8") for x in known or []]]))
                order = np.lexsort((start, which, size, content, key))
                again = np.zeros(len(order), bool)
                again[1:] = (key[order[1:]] == key[order[:-1]]) & (content[order[1:]] == content[order[:-1]]) & (size[order[1:]] == size[order[:-1]])
                for j in np.flatnonzero(again).tolist():  # hashes don't decide
                    x, y = order[j - 1], order[j]
                    again[j] = texts[which[x]][start[x] : start[x] + size[x]] == texts[which[y]][start[y] : start[y] + size[y]]
                gone, kept = order[again], np.sort(order[~again])
                gone = gone[np.lexsort((start[gone], which[gone]))]
                row = only.astype(np.int64)
                if len(gone):
                    k, a, b = _merged(which[gone], start[gone], start[gone] + size[gone])
                    for col, v in zip(out, (int(label_of(block % buckets)), slot, block, None, _spelled(row[k], a, b))):
                        col.append(v)
                for to, x in _sections(key[kept], buckets):
                    own = kept[x]
                    head = [np.array([len(own)], "<u8"), key[own].astype("<u8"), doc[which[own]].astype("<i8"), h[which[own]].astype("<i8"), row[which[own]].astype("<u4"), start[own].astype("<u4"), size[own].astype("<u4")]
                    body = b"".join([texts[i][s : s + z] for i, s, z in zip(which[own].tolist(), start[own].tolist(), size[own].tolist())])
                    for col, v in zip(out, (to, slot, block, pack.compress(b"".join([p.tobytes() for p in head]) + body), None)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["bucket", "slot", "block", "blob", "spans"])

    return ending(run)


def _open(blobs: list[bytes]):
    """key, doc, h, row, start, size, number of the blob, body (one bytes object) and each context's place in it, for keys with two contexts or more."""
    import numpy as np
    import zstandard

    read, parts, counts = zstandard.ZstdDecompressor(), [], []
    for x in blobs:
        raw = read.decompress(x)
        counts.append(np.frombuffer(raw, "<u8", int(np.frombuffer(raw, "<u8", 1)[0]), 8))
    names, n = np.unique(np.concatenate(counts), return_counts=True)
    many = names[n > 1]
    del names, n, counts
    for number, x in enumerate(blobs):
        raw = read.decompress(x)
        k = int(np.frombuffer(raw, "<u8", 1)[0])
        key, doc, h = (np.frombuffer(raw, t, k, 8 + 8 * k * i) for i, t in enumerate(("<u8", "<i8", "<i8")))
        row, start, size = (np.frombuffer(raw, "<u4", k, 8 + 24 * k + 4 * k * i).astype(np.int64) for i in range(3))
        at = 8 + 36 * k + np.cumsum(size) - size
        i = np.minimum(np.searchsorted(many, key), max(len(many) - 1, 0))
        own = np.flatnonzero(many[i] == key) if len(many) else np.zeros(0, np.int64)
        parts.append((key[own], doc[own], h[own], row[own], start[own], size[own], np.full(len(own), number), b"".join([raw[s : s + z] for s, z in zip(at[own].tolist(), size[own].tolist())])))
    *columns, size, number = (np.concatenate([p[i] for p in parts]) for i in range(7))
    return *columns, size, number, b"".join([p[7] for p in parts]), np.cumsum(size) - size


def _judge(length: int):
    """A bucket's contexts: spans (row, start, end) of repeats for each block; those that blocks found themselves pass."""

    def run(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        from .bwt import repeated

        ready = table.filter(pc.is_null(table.column("blob"))).select(["slot", "block", "spans"])
        table = table.filter(pc.is_valid(table.column("blob")))
        slots, blocks, blobs = (table.column(c).to_pylist() for c in ("slot", "block", "blob"))
        del table
        if not blobs:
            return ready
        key, doc, h, row, start, size, number, body, at = _open(blobs)
        del blobs
        rank, _, _ = _rank(doc, h)
        order = np.lexsort((start, rank, key))
        out: list[list] = [[], [], []]

        def repeat(which, a, b):
            for col, x in zip(out, (which, a, b)):
                col.append(np.asarray(x, np.int64))

        groups = np.flatnonzero(np.concatenate([[True], key[order[1:]] != key[order[:-1]], [True]])) if len(order) else np.zeros(1, np.int64)
        shard, held = [], 0
        gone: list[int] = []
        places, sizes, names, ranks, starts = at.tolist(), size.tolist(), order.tolist(), rank.tolist(), start.tolist()

        def expand(shard):
            """All repeats among the contexts of a shard."""
            own = np.array(shard, np.int64)
            n = size[own] + 1
            base = np.cumsum(n) - n
            symbols = np.zeros(int(n.sum()), np.int16)
            joined = np.frombuffer(b"".join([body[places[i] : places[i] + sizes[i]] for i in shard]), np.uint8)
            inside = np.ones(len(symbols), bool)
            inside[base + n - 1] = False
            symbols[inside] = joined.astype(np.int16) + 1
            of = np.repeat(np.arange(len(own)), n)
            off = np.arange(len(symbols)) - base[of]
            position, kind = repeated(symbols, off + length <= size[own][of], length)
            r, s = rank[own][of[position]], start[own][of[position]] + off[position]
            by = np.lexsort((s, r, kind))
            r, s, kind = r[by], s[by], kind[by]
            lead = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]])) if len(kind) else np.zeros(0, np.int64)
            lead = np.repeat(lead, np.diff(np.append(lead, len(kind))))  # the earliest place of each string
            later = np.flatnonzero((r != r[lead]) | (s != s[lead]))
            later = later[np.lexsort((s[later], r[later]))]
            repeat(*_merged(r[later], s[later], s[later] + length))

        for x, y in zip(groups[:-1].tolist(), groups[1:].tolist()):
            first: dict[bytes, int] = {}
            for i in names[x:y]:
                if (j := first.setdefault(body[places[i] : places[i] + sizes[i]], i)) != i and (ranks[i] != ranks[j] or starts[i] != starts[j]):
                    gone.append(i)
            if len(first) > 1:
                shard += first.values()
                held += sum(map(len, first))
            if held >= SHARD:
                expand(shard)
                shard, held = [], 0
        if shard:
            expand(shard)
        own = np.array(gone, np.int64)
        repeat(rank[own], start[own], start[own] + size[own])
        which, a, b = (np.concatenate(c) for c in out)
        by = np.lexsort((a, which))
        which, a, b = _merged(which[by], a[by], b[by])
        # every row that is the document gets its spans
        code, sample = np.unique(rank * np.int64(len(blocks)) + number, return_index=True)
        low, high = (np.searchsorted(code, x * np.int64(len(blocks))) for x in (which, which + 1))
        n = high - low
        owner = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        a, b, owner = np.repeat(a, n), np.repeat(b, n), sample[owner]
        by = np.argsort(number[owner], kind="stable")
        a, b, owner = a[by], b[by], owner[by]
        edge = np.flatnonzero(np.concatenate([[True], number[owner[1:]] != number[owner[:-1]], [True]])) if len(owner) else np.zeros(1, np.int64)
        found = [(int(number[owner[x]]), _spelled(row[owner[x:y]], a[x:y], b[x:y])) for x, y in zip(edge[:-1].tolist(), edge[1:].tolist())]
        more = pa.table({"slot": pa.array([slots[k] for k, _ in found], pa.int32()), "block": pa.array([blocks[k] for k, _ in found], pa.int64()), "spans": pa.array([v for _, v in found], pa.binary())})
        del key, doc, h, row, start, size, body, at, order, places, sizes, names, ranks, starts
        give_back()
        return pa.concat_tables([ready.cast(more.schema), more])

    return run


def _keep(batches: Iterator) -> Iterator:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of the blocks."""
    import hashlib

    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for block, blob, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
            doc, h, texts = _unpacked(blob)
            rank, only = _only(doc, h)
            found = np.concatenate([np.zeros((0, 3), "<u4"), *[np.frombuffer(x["spans"], "<u4").reshape(-1, 3) for x in spans or [] if x["block"] == block]]).astype(np.int64)
            found = found[np.lexsort((found[:, 1], found[:, 0]))]
            which, a, b = _merged(*found.T)
            low, high = (np.searchsorted(which, only[rank], side).tolist() for side in ("left", "right"))
            a, b, out = a.tolist(), b.tolist(), [[], [], [], []]
            for text, x, y in zip(texts, low, high):
                kept, end = hashlib.sha256(), 0
                for s, e in zip(a[x:y], b[x:y]):
                    kept.update(text[end:s])
                    end = e
                kept.update(text[end:])
                for col, v in zip(out, (len(text), sum(b[x:y]) - sum(a[x:y]), y - x, kept.hexdigest())):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(doc), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


#: Stands for a null doc_id while documents are ordered.
NO_ID = -(1 << 63)


def remove_repeats(docs: DataFrame, length: int = 100, hot: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each document. hot: different contexts of a key beyond which it is split into windows."""
    if not SEED <= length <= LONGEST:
        raise ValueError(f"length must be {SEED} to {LONGEST}")
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    hot = hot or max(64, SHARD // (2 * length))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    n, name = partitions_for(docs), f"stratalog_{uuid.uuid4().hex[:16]}"
    with arrow_batches(spark):
        packed = rows.mapInArrow(_blocks(n), PACKED).write.format("parquet").bucketBy(n, "slot")
        # few large cells: Parquet must look at sizes after every row
        checks = {"parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.block.size": 32 << 20, "compression": "uncompressed"}
        packed.options(path=scratch.path("blocks"), **checks).saveAsTable(name)
    try:
        blocks = spark.table(name)
        buckets = max(shuffle_partitions(spark), -(-(blocks.agg(F.sum("raw")).first()[0] or 0) // BUCKET))
        met = lambda rows, *what: blocks.join(rows.repartition(n, "slot").groupBy("slot").agg(*what).hint("shuffle_hash"), "slot", "left")
        with arrow_batches(spark, rows=1):
            keys = blocks.select("slot", "blob").mapInArrow(_keys(length, buckets), KEYS)
            known = scratch.save(keys.groupBy("bucket").applyInArrow(_repeated(hot), "slot int, blob binary"), "known")
            asked = met(known.withColumnRenamed("blob", "known"), F.collect_list("known").alias("known")).select("slot", "block", "blob", "known")
            sent = asked.mapInArrow(_send(length, buckets), SENT)
            spans = scratch.save(sent.groupBy("bucket").applyInArrow(_judge(length), SPANS), "spans")
            told = met(spans, F.collect_list(F.struct("block", "spans")).alias("spans")).select("block", "blob", "spans")
            out = scratch.save(told.mapInArrow(ending(_keep), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), "kept")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        for done in ("blocks", "known", "spans"):
            scratch.drop(done)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
