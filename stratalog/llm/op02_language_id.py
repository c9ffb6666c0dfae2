"""Operator 2: language identification by error-correcting output codes.

Every language has a codeword of bits; for each bit a binary classifier over hashed byte trigrams says how likely it is
set. A text's language is the one whose codeword has the least loss: each bit's logistic loss, weighted by how reliable
that bit was in training. The share of the best codeword (soft-min over losses) is the score; a text whose best two
codewords are close is flagged as ambiguous.

Classifiers learn from a sample of the labelled rows: of the ``MOST_LANGUAGES`` most frequent languages at most ``MOST_TRAIN``
texts each, and ``MOST_TEXTS`` in all, those with the least hashes of id and text; whole texts count, each as a distribution.
Distributions are added up by language on the executors; the driver gets one vector a language and one margin a bit and
text. Prediction reads the text alone, all of it.

``keep_identified`` rejects what is null, has no letter, or is written in nothing like the learned languages: a text of
``ENOUGH`` trigrams or more of which too few occur in any training text. The limit is half the share that the strangest
thousandth of the training texts have in common with the others, and ``FAMILIAR`` at most. Short, mixed and ambiguous texts stay.

Edge cases: null text, or one without any letter, is ``und`` with score 0; an unlabelled or empty training set makes
everything ``und``, but ``keep_identified`` then keeps every text with a letter; a single language is predicted with score 1;
rows with equal doc_id are judged each; a null doc_id counts as the text "" in the fold; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches, ending, fresh, give_back

MOST_TRAIN, MOST_TEXTS, MOST_LANGUAGES = 800, 50_000, 500
BINS = 1 << 16
UNKNOWN = "und"
#: Bytes whose trigrams are looked up at once.
CHUNK = 1 << 19
#: A text is ambiguous if the best share is less than this above the second.
CLOSE = 0.2
#: A text of at least ENOUGH trigrams can be foreign, if less than FAMILIAR of them occur in training texts.
FAMILIAR, ENOUGH = 0.4, 30


def fold(doc_id) -> object:
    """crc32 of doc_id as text, modulo 3; 1 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def trigrams(text: str) -> Iterator:
    """Bins of the byte trigrams of a lower-cased text between spaces, in chunks."""
    import numpy as np

    data = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    for at in range(0, max(len(data) - 2, 1), CHUNK):
        part = data[at : at + CHUNK + 2]
        code = part[:-2] | part[1:-1] << np.uint32(8) | part[2:] << np.uint32(16)
        yield (code * np.uint32(2654435761)) >> np.uint32(16)


def codewords(k: int):
    """k rows of -1 and 1: the exhaustive code for few languages, else the best of many random ones by least distance."""
    import numpy as np

    if k <= 5:
        return np.array([[1 if (c >> (k - 1 - r)) & 1 else -1 for c in range(1, 1 << (k - 1))] for r in range(k)], np.int8)
    bits, best, far = int(np.ceil(10 * np.log2(k))), None, -1
    for seed in range(200):
        code = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (k, bits))
        apart = (bits - code.astype(np.int32) @ code.T.astype(np.int32)) // 2 + bits * np.eye(k, dtype=np.int32)
        if np.abs(code.sum(0)).max() < k and apart.min() > far:
            best, far = code, apart.min()
    return best


def _features(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        out = []
        for text in batch.column(1).to_pylist():
            n = np.zeros(BINS)
            for bins in trigrams(text):
                n += np.bincount(bins, minlength=BINS)
            own = np.flatnonzero(n)
            out.append(own.astype("<u2").tobytes() + n[own].astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["lang", "bins"])


def _opened(b: bytes):
    """(bins, counts) of one text's features."""
    import numpy as np

    return np.frombuffer(b, "<u2", len(b) // 6).astype(np.int64), np.frombuffer(b, "<f4", len(b) // 6, len(b) // 6 * 2).astype(np.float64)


def _shares(table):
    """Of one language's texts: lang, the sum of their distributions, and in how many of them each bin is; an empty text teaches nothing."""
    import pyarrow as pa

    total, texts = _sums(table.column("bins").to_pylist())
    give_back()
    return pa.table({"lang": table.column("lang")[:1], "share": pa.array([total.astype("<f4").tobytes()], pa.binary()), "texts": pa.array([texts.astype("<u4").tobytes()], pa.binary())})


def _sums(features: list[bytes]):
    import numpy as np

    total, texts = np.zeros(BINS), np.zeros(BINS, np.int64)
    for b in features:
        if b:
            own, n = _opened(b)
            total[own] += n / n.sum()
            texts[own] += 1
    return total, texts


def _measured(model: Model, b: bytes):
    """Each bit's margin of a training text, and the share of its trigrams that another training text has (1 for few trigrams)."""
    import numpy as np

    own, n = _opened(b)
    shared = float(n[model.texts[own] > 1].sum() / n.sum()) if n.sum() >= ENOUGH else 1.0
    return (n @ model.weights[own] / np.sqrt(n.sum()) if len(model.languages) > 1 else np.zeros(0)), shared


def _margins(model: Model):
    """lang, margins and shared part of every text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            kept = [(lang, *_measured(model, b)) for lang, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if b]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, *_ in kept], pa.string()), pa.array([x.astype("<f4").tobytes() for _, x, _ in kept], pa.binary()), pa.array([x for *_, x in kept], pa.float64())], names=["lang", "margin", "shared"])

    return ending(run)


class Model:
    """languages, code, weights (bins x bits), texts that have each bin, limit of familiarity, scale and reliability of each bit."""

    def __init__(self, rows: list[tuple[str, bytes]]):
        rows = [(lang, b) for lang, b in rows if b]
        self.learn({x: _sums([b for lang, b in rows if lang == x]) for x in {lang for lang, _ in rows}})
        if self.languages:
            self.weigh([(lang, *_measured(self, b)) for lang, b in rows])

    def learn(self, sums: dict) -> None:
        """sums: of each language the sum of its texts' distributions, and in how many each bin is."""
        import numpy as np

        self.languages = sorted(lang for lang, (x, _) in sums.items() if x.any())
        if not (k := len(self.languages)):
            return
        share = np.stack([sums[x][0] for x in self.languages])
        self.texts = np.sum([n for _, n in sums.values()], axis=0)
        if k < 2:
            return
        self.code = codewords(k)
        share = share + 1e-7
        share /= share.sum(1, keepdims=True)
        share = 0.98 * share + 0.02 * share.mean(0)  # no language rules a trigram out
        yes, no = ((self.code.T == s).astype(float) @ share / (self.code.T == s).sum(1, keepdims=True) for s in (1, -1))
        self.weights = np.ascontiguousarray((np.log(yes) - np.log(no)).T.astype(np.float32))

    def weigh(self, texts: list) -> None:
        """texts: (language, each bit's margin, shared part) of the training texts."""
        import numpy as np

        shared = sorted(x for *_, x in texts)
        self.limit = min(FAMILIAR, 0.5 * shared[len(shared) // 1000])
        if len(self.languages) < 2:
            return
        at = {x: i for i, x in enumerate(self.languages)}
        label = np.array([at[lang] for lang, *_ in texts])
        signed = np.array([m for _, m, _ in texts]) * self.code[label]
        self.scale = np.ones(self.code.shape[1])
        for _ in range(100):  # one slope for each bit, by logistic regression
            p = 1 / (1 + np.exp(-np.clip(signed * self.scale, -30, 30)))
            self.scale += 0.5 * ((1 - p) * signed).mean(0) / (np.abs(signed).mean(0) ** 2 + 1e-9)
        self.scale = np.clip(self.scale, 0.05, 20)
        right = (signed > 0).mean(0)
        self.reliability = np.clip(right - 0.5, 0.02, None) / np.clip(right - 0.5, 0.02, None).sum()

    def decode(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous)"""
        return self.judge(text)[:3]

    def judge(self, text: str | None) -> tuple[str, float, bool, bool]:
        """(language, score, ambiguous, foreign)"""
        import numpy as np

        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False, False
        many = len(self.languages) > 1
        total, n, seen = np.zeros(self.code.shape[1] if many else 1), 0, 0
        for bins in trigrams(text):
            if many:
                total += self.weights[bins].sum(0, dtype=np.float64)
            n, seen = n + len(bins), seen + int((self.texts[bins] > 0).sum())
        foreign = n >= ENOUGH and seen < self.limit * n
        if not many:
            return self.languages[0], 1.0, False, foreign
        z = np.clip(self.code * (self.scale * total / np.sqrt(max(n, 1))), -30, 30)
        loss = (np.log1p(np.exp(-z)) * self.reliability).sum(1) * self.code.shape[1]
        share = np.exp(loss.min() - loss)
        share /= share.sum()
        best, second = np.argsort(-share, kind="stable")[:2]
        return self.languages[best], float(share[best]), bool(share[best] - share[second] < CLOSE), foreign


def train(docs: DataFrame, most: int = MOST_TRAIN) -> Model:
    """Learns from labelled documents of the training folds, at most ``most`` of each language."""
    import numpy as np

    text = F.col("text").cast("string")
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 1)).select(F.col("lang").cast("string").alias("lang"), text.alias("text"), F.xxhash64("doc_id", text).alias("at"))
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(MOST_LANGUAGES).collect()}
    model = Model([])
    if not counts:
        return model
    most = max(1, min(most, MOST_TEXTS // len(counts)))
    # hashes below a bound give about as many as are wanted; the rank takes what is above it, whatever the hashes are like
    bound = F.coalesce(*[F.when(F.col("lang") == x, int(min(1.0, 1.5 * most / n) * (1 << 30))) for x, n in counts.items()])
    sample = known.filter(F.pmod("at", F.lit(1 << 30)) < bound)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("at"))
    sample = sample.withColumn("nth", nth).filter(F.col("nth") <= most).select("lang", "text")
    scratch = Scratch(docs.sparkSession, "language-training")
    with arrow_batches(docs.sparkSession, rows=256):
        texts = scratch.save(sample.mapInArrow(ending(_features), "lang string, bins binary"), "features")
        sums = texts.groupBy("lang").applyInArrow(_shares, "lang string, share binary, texts binary").collect()  # two vectors a language
        model.learn({lang: (np.frombuffer(x, "<f4").astype(np.float64), np.frombuffer(n, "<u4").astype(np.int64)) for lang, x, n in sums})
        if model.languages:
            measured = texts.mapInArrow(_margins(model), "lang string, margin binary, shared double").collect()  # a number a bit and text
            model.weigh(sorted((lang, np.frombuffer(x, "<f4").astype(np.float64).tolist(), part) for lang, x, part in measured))
    scratch.drop()
    return model


def _predict(model: Model):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                found = list(zip(*[model.decode(t) for t in batch.column(2).to_pylist()]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found[0]), pa.array(found[1], pa.float64()), pa.array(found[2], pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return ending(run)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for each document."""
    model = model or train(docs)
    rows = docs.select(F.col("doc_id").cast("long"), (fold(F.col("doc_id")) == 1).alias("held_out"), F.col("text").cast("string"))
    with arrow_batches(docs.sparkSession):
        out = rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
        return Scratch(docs.sparkSession, "language").save(out, "found")


def keeps(model: Model, text: str | None) -> bool:
    """Whether a text stays: it has a letter, and its trigrams are not foreign to all learned languages."""
    if not model.languages:  # nothing was learned, so nothing can be told apart but texts without letters
        return bool(text) and any(map(str.isalpha, text))
    language, _, _, foreign = model.judge(text)
    return language != UNKNOWN and not foreign


def _rejected(model: Model):
    """doc_id and the hashes of the texts that don't stay."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                yield batch.select(["doc_id", "h1", "h2"]).filter(pa.array([not keeps(model, t) for t in batch.column(3).to_pylist()], pa.bool_()))

    return ending(run)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents, all columns, whose language can be told: not null, with a letter, and not foreign to all learned languages.

    The rejected ones, by id and two hashes of the text, are stored; texts are not written twice."""
    model, text = train(docs), F.col("text").cast("string")
    key = [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]
    with arrow_batches(docs.sparkSession):
        gone = docs.filter(text.isNotNull()).select(*key, text.alias("text")).mapInArrow(_rejected(model), "doc_id long, h1 long, h2 long")
        gone = Scratch(docs.sparkSession, "rejected").save(gone, "keys").distinct()
    names = [fresh(docs, f"rejected_{c}") for c in ("id", "h1", "h2")]
    own = [F.col("doc_id").cast("long"), F.xxhash64(text), F.xxhash64(F.lit(1), text)]
    same = [a.eqNullSafe(F.col(b)) for a, b in zip(own, names)]
    return docs.filter(text.isNotNull()).join(gone.toDF(*names), same[0] & same[1] & same[2], "left_anti")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
