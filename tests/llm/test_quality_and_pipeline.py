from __future__ import annotations

import math
import pickle
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ratelake.llm import kneser
from tests.conftest import SF_MID, SF_SMALL
from tests.llm.cases import awkward_docs, no_docs


def _brute_model(texts, order):
    """p(byte | up to order - 1 bytes before) by the textbook recursion over dictionaries."""
    raw = Counter()
    for t in texts:
        s = b"\xff" * (order - 1) + t
        raw.update(s[i : i + order] for i in range(len(t)))
    counts = {order: raw}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def cuts(table):
        n = Counter(min(c, 5) for c in table.values())
        if not all(n[i] for i in (1, 2, 3, 4)):
            return 0.5, 1.0, 1.5
        y = n[1] / (n[1] + 2 * n[2])
        return tuple(min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.0), i) for i in (1, 2, 3))

    d = {n: cuts(counts[n]) for n in counts}
    after = {n: defaultdict(list) for n in counts}
    for n in counts:
        for g, c in counts[n].items():
            after[n][g[:-1]].append(c)

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / 256
        seen = after[n].get(gram[:-1])
        if not seen:
            return p(gram[1:])
        cut = lambda c: d[n][min(c, 3) - 1]
        c = counts[n].get(gram, 0)
        own = (c - cut(c)) / sum(seen) if c else 0.0
        return own + sum(map(cut, seen)) / sum(seen) * p(gram[1:])

    return p


TRUSTED = ["the cat sat on the mat and the rat ran.", "a cat and a dog ran to the mat", "él niño está en la niebla", "the end"]


def test_a_held_model_passes_the_driver_compressed(spark, monkeypatch):
    rng = np.random.default_rng(7)
    words = ["".join(w) for w in rng.choice(list("abcdefghijklmnopqrstuvwxyzé"), (800, 6))]
    texts = [" ".join(rng.choice(words, 60)).encode() for _ in range(300)] + [b"", None]
    docs = spark.createDataFrame([(0, i, i, "en", t) for i, t in enumerate(texts)], "part int, doc_id long, key long, lang string, t binary")
    model = kneser.train(docs.select("t").where("length(t) > 0"))
    sent, own = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or own(self, value))
    got = {r.doc_id: r.perplexity for r in kneser.held_scores(docs, model).collect()}
    want = {r.doc_id: r.perplexity for r in kneser.sharded_scores(docs, model, 1).collect()}
    assert got.keys() == want.keys() and all(got[i] == want[i] or got[i] == pytest.approx(want[i], rel=1e-5) for i in got)
    tables = [t for pair in model for t in pair]
    rows = sum(t.count() for t in tables)
    raw = pickle.dumps(sent[0])
    assert rows > 10_000 and len(raw) < 0.75 * 16 * rows  # 16 bytes a row if sent as arrays
    held = pickle.loads(raw)
    for k, table in enumerate(tables):
        name = table.columns[1:]
        have = sorted(map(tuple, table.select(*name).toPandas().itertuples(index=False)))
        # the tables of order n: 2 * (n - 1) probabilities, 2 * (n - 1) + 1 weights
        assert [x[0] for x in have] == held[0, k][0].tolist() and [x[1] for x in have] == held[0, k][1].tolist()


def test_pieces_of_a_held_model_meet_again_in_order(monkeypatch):
    monkeypatch.setattr(kneser, "HELD_PIECE", 40)
    rng = np.random.default_rng(1)
    rows = [(k, m, int(key), float(rng.random())) for k in (0, 3) for m in (0, 2) for key in rng.permutation(1 << 20)[:100] << 20]
    rng.shuffle(rows)
    whole = pa.RecordBatch.from_arrays([pa.array([t(r[i]) for r in rows]) for i, t in enumerate((int, int, int, float))], names=["kind", "m", "key", "v"])
    out = list(kneser._pieces(iter([whole.slice(at, 15) for at in range(0, len(rows), 15)])))
    assert len(out) > 5 and not list(kneser._pieces(iter([whole.slice(0, 0)]))) and kneser._arrays([]) == {}
    tables = kneser._arrays([r for b in out for r in b.to_pylist()])
    assert {(m, k, a, b) for (m, k), (key, v) in tables.items() for a, b in zip(key.tolist(), v.tolist(), strict=True)} == {
        (int(m), int(k), int(a), b) for k, m, a, b in rows
    }
    assert all((np.diff(key) > 0).all() for key, _ in tables.values())


@pytest.mark.parametrize(("order", "held"), [(2, 0), (4, 0), (4, kneser.HELD_ROWS)])
def test_perplexity_equals_the_textbook_model(spark, monkeypatch, order, held):
    monkeypatch.setattr(kneser, "HELD_ROWS", held)
    others = ["the mat sat on the cat", "zzz qqq €", "x", "a" * 300, "", None]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(TRUSTED + others)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(4)] + [(5, 0, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    rows_of = docs.select("doc_id", F.col("text").cast("binary").alias("t"))
    part = {r.doc_id: r.part for r in kneser._parts(rows_of, labels).collect()}
    assert {part[i] for i in range(len(TRUSTED))} == {0, 1} and {part[i] for i in range(len(TRUSTED), len(rows))} == {kneser.FOLDS}
    # a trusted text is scored by a model that has not seen it
    models = {f: _brute_model([t.encode() for i, t in enumerate(TRUSTED) if part[i] != f], order) for f in (0, 1, kneser.FOLDS)}
    for r in kneser.judge(docs, labels, order).collect():
        p = models[part[r.doc_id]]
        t = (rows[r.doc_id][1] or "").encode()
        if not t:
            assert r.perplexity is None and not r.keep
            continue
        s = b"\xff" * (order - 1) + t
        want = math.exp(-sum(math.log(p(s[i : i + order])) for i in range(len(t))) / len(t))
        assert r.perplexity == pytest.approx(want, rel=1e-5)
        assert r.n_bytes == len(t)


def test_probabilities_of_a_context_sum_to_one(spark):
    texts = spark.createDataFrame([(t.encode(),) for t in TRUSTED], "t binary")
    model = kneser.train(texts, 3)
    asked = spark.createDataFrame([(0, int.from_bytes(h + bytes([b]), "big")) for h in (b"th", b"\xff\xff", b"qq") for b in range(256)], "m int, key long")
    got = kneser.log_probabilities(asked, model).withColumn("h", F.shiftright("key", 8)).groupBy("h").agg(F.sum(F.exp("lp")).alias("s"))
    assert all(r.s == pytest.approx(1, abs=1e-9) for r in got.collect()) and got.count() == 3


def test_model_grows_with_the_trusted_text(spark):
    sizes = []
    for d in (SF_SMALL, SF_MID):
        docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
        texts = docs.join(kneser.trusted_ids(labels), "doc_id").select(F.col("text").cast("binary").alias("t"))
        sizes.append(kneser.ngram_counts(texts, kneser.ORDER).count())
    assert sizes[1] >= 1.5 * sizes[0]


def test_classifier_keeps_clean_and_rejects_junk(spark):
    docs, labels = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "labels"))
    junk = [(10_000 + i, "".join(chr(33 + (i * 7 + k * k) % 90) for k in range(400)), lang, "x", 0) for i, lang in enumerate(["en", "xx", None])]
    got = kneser.quality_report(docs.unionAll(spark.createDataFrame(junk, docs.schema)), labels).toPandas()
    assert len(got) == docs.count() + 3 and not got[got.doc_id >= 10_000].keep.any()
    good = labels.where("quality = 1").toPandas()
    trusted = good[good.toxic == 0].doc_id
    assert got[got.doc_id.isin(trusted)].keep.mean() >= 0.99


def test_unseen_clean_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "labels"))
    known = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0
    got = kneser.quality_report(docs, labels.where(known)).join(labels.where(~known), "doc_id").toPandas()
    clean, bad = got[(got.quality == 1) & (got.toxic == 0)], got[(got.quality == 0) & (got.toxic == 0)]
    assert len(clean) > 100 and clean.keep.mean() >= 0.95 and bad.keep.mean() <= 0.5


def test_single_toxic_words_are_rejected(spark):
    docs, labels = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "labels"))
    clean = docs.join(labels.where("quality = 1 AND toxic = 0"), "doc_id").where("lang = 'en' AND length(text) > 2000").limit(20).collect()
    rows = [(50_000 + i, r.text + " You moron.", r.lang, r.source, 0) for i, r in enumerate(clean)]
    rows += [(60_000 + i, r.text + " You and the others.", r.lang, r.source, 0) for i, r in enumerate(clean)]
    got = kneser.quality_report(docs.unionAll(spark.createDataFrame(rows, docs.schema)), labels).toPandas()
    assert not got[got.doc_id.between(50_000, 59_999)].keep.any() and got[got.doc_id >= 60_000].keep.all()
    toxic = labels.where("toxic = 1").toPandas().doc_id
    assert got[got.doc_id.isin(toxic)].keep.mean() <= 0.4


def test_classifier_takes_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (2, 0, 0), (None, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    docs = awkward_docs(spark)
    rows = kneser.quality_report(docs, labels).collect()
    assert len(rows) == 12 and all(r.keep == (r.n_bytes > 0 and r.perplexity is not None and r.low <= r.perplexity <= r.high) for r in rows)
    out = kneser.filter_documents(docs, labels)
    assert out.columns == docs.columns and 0 < out.count() < 12
    assert kneser.quality_report(no_docs(spark), labels).count() == 0
    nothing = kneser.quality_report(docs, labels.limit(0)).collect()  # no trusted text: only empty texts go
    assert [r.keep for r in nothing] == [r.n_bytes > 0 for r in nothing]


def test_sharded_and_broadcast_models_score_alike(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "labels"))
    one = kneser.quality_report(docs, labels).orderBy("doc_id").toPandas()
    monkeypatch.setattr(kneser, "HELD_ROWS", 0)
    monkeypatch.setattr(kneser, "BLOCK_BYTES", 3000)
    many = kneser.quality_report(docs, labels).orderBy("doc_id").toPandas()
    assert list(many.doc_id) == list(one.doc_id) and np.allclose(many.perplexity, one.perplexity) and list(many.keep) == list(one.keep)


def test_pipeline_stages_run_in_order_and_keep_their_columns(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["keep_quality", "drop_near_duplicates", "decontaminate", "mix_sources", "shard"]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = corpus_pipeline.run(spark, SF_SMALL).cache()
    assert out.columns == [*docs.columns, "shard", "slot"]
    ids = {r.doc_id for r in out.collect()}
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    kept = {r.doc_id for r in kneser.quality_report(docs, labels).where("keep").collect()}
    assert ids <= kept and len(ids) > 0.6 * docs.count()
    texts = [r.text for r in out.dropDuplicates(["doc_id"]).collect()]
    assert len(texts) == len(set(texts))  # no two documents of one text are left
    sizes = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_pipeline_stages_take_awkward_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "some benchmark text")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (awkward_docs(spark), no_docs(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path)).checkpoint()
        assert {"shard", "slot"} <= set(docs.columns)
