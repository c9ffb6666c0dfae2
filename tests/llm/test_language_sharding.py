import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import op02_language_id as lid
from stratalog.llm import op07_sharding as shard
from stratalog.llm.queries import ORACLES, QUERIES


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    known = {r.doc_id: r.lang for r in docs.collect()}
    got = lid.identify(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == known[r.doc_id] for r in held]) > 0.98


def test_language_edge_cases(spark, docs, rows, empty):
    got = lid.identify(docs)
    assert got.count() == len(rows)
    found = {r.doc_id: r for r in got.collect()}
    assert [found[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and found[903].lang_pred in ("en", "de", "fr")
    assert lid.identify(empty).count() == 0
    assert {r.lang_pred for r in lid.identify(docs, lid.Model([])).collect()} == {"und"}
    model = lid.train(docs)
    assert np.isfinite(model.scale).all() and model.decode("words of a text")[1] > 0  # empty training texts do no harm
    kept = lid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len([1 for _, t in rows if t and re.search(r"[^\W\d_]", t)])


def test_no_model_keeps_texts_with_letters(docs, rows):
    kept = lid.keep_identified(docs.withColumn("lang", F.lit(None).cast("string")))
    assert kept.columns == docs.columns and kept.count() == len([1 for _, t in rows if t and re.search(r"[^\W\d_]", t)])


@pytest.mark.parametrize("k", [2, 3, 5, 9, 30])
def test_codewords_are_apart(k):
    code = lid.codewords(k)
    apart = min((code[i] != code[j]).sum() for i in range(k) for j in range(i))
    assert apart >= (1 if k < 3 else code.shape[1] / 4) and all(-k < s < k for s in code.astype(int).sum(0))


def test_wrong_bits_are_corrected():
    texts = {x: " ".join(f"{x}{y}{x}" for y in "abcdefgh") for x in ("qu", "zw", "xj", "kv", "yp")}

    def features(t):
        n = np.bincount(np.concatenate(list(lid.trigrams(t))), minlength=lid.BINS)
        own = np.flatnonzero(n)
        return own.astype("<u2").tobytes() + n[own].astype("<f4").tobytes()

    model = lid.Model([(x, features(t)) for x, t in texts.items()])
    assert all(model.decode(t)[0] == x for x, t in texts.items())
    model.weights[:, :3] *= -1  # three of fifteen classifiers always wrong
    assert all(model.decode(t)[0] == x for x, t in texts.items())


@pytest.mark.parametrize("limit", [300, 5000, 1 << 20])
def test_sharding(docs, rows, empty, limit):
    got = shard.assign(docs, limit).toPandas()
    assert len(got) == len(rows)
    for name, g in got.groupby("shard"):
        assert g.n_bytes.sum() == g.shard_bytes.iloc[0] and len(g) == g.shard_docs.iloc[0] and g.depth.nunique() == 1 and len(name) == g.depth.iloc[0]
        assert g.shard_bytes.iloc[0] <= limit or (g.doc_id.nunique(dropna=False) == 1 and g.oversized.all())
    names = sorted(got["shard"].unique())
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))  # no shard's prefix holds another's
    for name in names:  # a sibling pair would fit together only if it could not
        pair = got[got["shard"].str.startswith(name[:-1])]
        assert not name or pair.n_bytes.sum() > limit
    assert shard.assign(empty, limit).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want, got = con.execute(ORACLES[name]).df(), QUERIES[name](spark, sf_dir).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    text = lambda f: sorted(map(str, f[columns].itertuples(index=False, name=None)))
    assert text(got) == text(want)


def features(text):
    n = np.bincount(np.concatenate(list(lid.trigrams(text))), minlength=lid.BINS)
    own = np.flatnonzero(n)
    return own.astype("<u2").tobytes() + n[own].astype("<f4").tobytes()


def plain_decode(rows, text):
    """The same method word by word of its description, in loops over bits and languages."""
    languages = sorted({x for x, _ in rows})
    code = lid.codewords(len(languages))
    count = {x: [0.0] * lid.BINS for x in languages}
    for x, t in rows:
        own = np.bincount(np.concatenate(list(lid.trigrams(t))), minlength=lid.BINS)
        for i in np.flatnonzero(own):
            count[x][i] += own[i] / own.sum()
    share = np.array([count[x] for x in languages]) + 1e-7
    share = np.array([s / s.sum() for s in share])
    share = np.array([0.98 * s + 0.02 * share.mean(0) for s in share])
    scales, sure, weights = [], [], []
    for bit in range(code.shape[1]):
        yes, no = (np.mean([s for s, c in zip(share, code[:, bit]) if c == side], axis=0) for side in (1, -1))
        w = np.log(yes) - np.log(no)
        signed = []
        for x, t in rows:
            bins = np.concatenate(list(lid.trigrams(t)))
            signed.append(code[languages.index(x), bit] * w[bins].sum() / np.sqrt(len(bins)))
        scale = 1.0
        for _ in range(100):
            p = [1 / (1 + np.exp(-np.clip(s * scale, -30, 30))) for s in signed]
            scale += 0.5 * np.mean([(1 - a) * s for a, s in zip(p, signed)]) / (np.mean(np.abs(signed)) ** 2 + 1e-9)
        scales.append(min(20, max(0.05, scale)))
        sure.append(max(0.02, np.mean([s > 0 for s in signed]) - 0.5))
        weights.append(w)
    bins = np.concatenate(list(lid.trigrams(text)))
    loss = []
    for i in range(len(languages)):
        z = [np.clip(code[i, b] * scales[b] * weights[b][bins].sum() / np.sqrt(len(bins)), -30, 30) for b in range(code.shape[1])]
        loss.append(sum(np.log1p(np.exp(-x)) * q / sum(sure) for x, q in zip(z, sure)) * code.shape[1])
    best = int(np.argmin(loss))
    return languages[best], 1 / sum(np.exp(loss[best] - x) for x in loss)


def test_decoding_against_a_plain_version(rows):
    texts = [(("en", "de", "fr")[i % 3], t + f" q{i % 3}x" * 9) for i, (d, t) in enumerate(rows) if d is not None and d < 30]
    model = lid.Model([(x, features(t)) for x, t in texts])
    for _, t in [*texts[:6], ("", "q0x q0x q1x"), ("", "nothing of it at all")]:
        want, score = plain_decode(texts, t)
        assert model.decode(t)[0] == want and model.decode(t)[1] == pytest.approx(score, rel=1e-3, abs=1e-6)


def test_training_on_executors_is_training_on_the_driver(spark, docs):
    known = [(r.lang, r.text) for r in docs.collect() if r.lang and r.text and zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 3 != 1]
    here, there = lid.Model([(x, features(t)) for x, t in known]), lid.train(docs)
    assert here.languages == there.languages and (here.texts == there.texts).all() and there.limit == pytest.approx(here.limit)
    assert here.weights == pytest.approx(there.weights, abs=1e-3) and here.scale == pytest.approx(there.scale, rel=1e-2)
    few = lid.train(docs, most=5)
    assert few.texts.max() <= 15 and set(few.languages) <= set(here.languages)


def test_foreign_texts_go_and_clean_ones_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    odd = [(-1, "日本語のテキストはここにあります。" * 4), (-2, "".join(chr(0x4E00 + 37 * i % 20000) for i in range(200))), (-3, "?? 12 --"), (-4, "ok")]
    more = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"), allowMissingColumns=True)
    kept = {r.doc_id for r in lid.keep_identified(more).select("doc_id").collect()}
    want = {r.doc_id for r in docs.collect() if r.text and re.search(r"[^\W\d_]", r.text)}
    assert kept == want | {-4}


def test_written_shards(spark, docs, rows, empty, tmp_path):
    path = f"file://{tmp_path}/shards"
    shard.write_shards(docs, path, 5000)
    back = spark.read.parquet(path)
    assert sorted((str(r.doc_id), str(r.text)) for r in back.collect()) == sorted((str(d), str(t)) for d, t in rows)
    assert set(back.columns) == {*docs.columns, "shard"}
    of = {(r.doc_id, r.n_bytes): f"p{r.shard}" for r in shard.assign(docs, 5000).collect()}
    assert {of[(r.doc_id, len((r.text or "").encode()))] == r.shard for r in back.collect()} == {True} and len(set(of.values())) > 3
    for folder in (tmp_path / "shards").glob("shard=*"):
        assert len(list(folder.glob("*.parquet"))) == 1
    shard.write_shards(empty, f"file://{tmp_path}/none")
    assert not list((tmp_path / "none").glob("shard=*"))
    with pytest.raises(ValueError):
        shard.write_shards(docs.withColumn("Shard", F.lit(1)), path)


def test_only_the_first_bits_shards_are_broadcast(spark, monkeypatch):
    plans, save = {}, shard.Scratch.save

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    monkeypatch.setattr(shard.Scratch, "save", lambda self, df, name: (plans.setdefault(name, plan(df)), save(self, df, name))[1])
    got = shard.assign(spark.range(12_000).selectExpr("id AS doc_id", "'x' AS text"), 2)
    assert {"leaves0", "leaves13"} <= set(plans) and got.filter("shard_docs > 2 OR oversized").count() == 0
    assert "Broadcast" not in plans["leaves0"] + plans["sums13"] + plans["leaves13"]
    assert plan(got).count("BroadcastHashJoin") == 1 and plan(got).count("SortMergeJoin") >= 1  # the first round's, and later ones
