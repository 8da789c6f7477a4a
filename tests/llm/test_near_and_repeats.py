from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ratelake.llm import components, lpf, simhash
from tests.conftest import SF_MID
from tests.llm.cases import PLAIN, awkward_docs, no_docs


def _groups(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_masks_cover_every_small_difference():
    masks = simhash.covering_masks(2, bits=12)
    for bits in itertools.combinations(range(12), 2):
        assert any(not m & (1 << bits[0] | 1 << bits[1]) for m in masks)
    masks, rng = simhash.covering_masks(4), random.Random(1)
    for _ in range(5000):
        gone = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(m & gone == 0 for m in masks)


def _fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    prints = {r.doc_id: _fingerprint(r.text) for r in docs.collect()}
    ids = sorted(prints)
    f = np.array([prints[i] for i in ids], np.uint64)
    pairs = [(ids[k], ids[k + 1 + j]) for k in range(len(f)) for j in np.nonzero(np.bitwise_count(f[k + 1 :] ^ f[k]) <= 4)[0]]
    want = _groups(ids, pairs)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in ids}


def test_large_buckets_are_split_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 4)
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 60:
        fps.add(rng.choice(sorted(fps)) ^ 1 << rng.randrange(12) ^ 1 << rng.randrange(12))
    values = sorted(simhash.signed(x) for x in fps)
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    got = _groups(values, [(r.a, r.b) for r in simhash.links(frame, 4).collect()])
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4
    want = _groups(values, [(a, b) for a, b in itertools.combinations(values, 2) if near(a, b)])
    assert got == want


def test_simhash_takes_awkward_rows(spark):
    rows = simhash.near_duplicates(awkward_docs(spark)).collect()
    assert len(rows) == 12
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {3}  # null and blank texts are linked
    assert simhash.near_duplicates(no_docs(spark)).count() == 0


def test_components_of_chains_and_hubs(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(1000, 100 + i) for i in range(30)] + [(5, 5)]
    got = {r.node: r.label for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == _groups(nodes, pairs)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dedup_keeps_the_smallest_id_of_each_component(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    rng = random.Random(5)
    extra = []
    for n, r in enumerate([r for r in docs.collect() if 300 < len(r.text.split()) < 2000][:60]):
        words = r.text.split()
        words[rng.randrange(len(words))] = "changed"
        extra += [(20_000 + n, " ".join(words), r.lang, r.source, 0)] * (1 + n % 2)
    both = docs.unionAll(spark.createDataFrame(extra, docs.schema)).unionAll(docs.where("doc_id % 9 = 0"))
    rows = both.collect()
    prints = {r.doc_id: _fingerprint(r.text) for r in rows}
    ids = sorted(prints)
    f = np.array([prints[i] for i in ids], np.uint64)
    pairs = [(ids[k], ids[k + 1 + j]) for k in range(len(f)) for j in np.nonzero(np.bitwise_count(f[k + 1 :] ^ f[k]) <= 4)[0]]
    want = sorted(set(_groups(ids, pairs).values()))
    out = simhash.drop_near_duplicates(both)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == want and len(want) < len(ids) - 40
    assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in rows}


def test_dedup_takes_awkward_rows(spark):
    docs = awkward_docs(spark)
    docs = docs.withColumns({"k1": F.lit(1), "K2_": F.lit("x"), "label": F.lit(2), "stay": F.map_from_arrays(F.array(F.lit("a")), F.array(F.lit(1)))})
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert [r.doc_id for r in rows if r.text == PLAIN * 8] == [1]  # of two equal rows and a copy one stays
    assert [r.doc_id for r in rows if not (r.text or "").split()] == [3]
    assert sorted(str(r.doc_id) for r in rows) == ["1", "2", "3", "7", "8", "9", "None"]
    nulls = spark.createDataFrame([(None, "the same words in every row", 1)] * 5 + [(None, "quite another text of some words", 1)], "doc_id long, text string, n int")
    assert len(simhash.drop_near_duplicates(nulls).collect()) == 2
    assert simhash.drop_near_duplicates(no_docs(spark)).count() == 0


def _brute(rows, length, keep):
    """{row number: (removed, runs, sha256 of what is left)} by every window's bytes."""
    seen = Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    earlier, out = set(), {}
    for n, (_, t) in enumerate(rows):
        cover = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if (seen[w] > 1) if keep == "none" else (w in earlier):
                cover[i] += 1
                cover[i + length] -= 1
            earlier.add(w)
        on = np.cumsum(cover)[:-1] > 0
        runs = int(np.diff(np.r_[0, on.astype(int)]).clip(0).sum())
        out[n] = int(on.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~on].tobytes()).hexdigest()
    return out


def _repeat_rows():
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, other = text(120), text(90)
    rows = [text(rng.randrange(5, 150)) for _ in range(25)]
    rows += [text(rng.randrange(20)) + passage + text(rng.randrange(20)) for _ in range(12)]
    rows += [text(3) + passage[100:] + other + text(2), other + passage, passage[:450] + other[50:], "ab" * 700, "x" * 401, "x" * 400]
    rows += [rows[0], rows[30], "", "short", passage + passage, "\x00" * 900, "a\x00" * 300]
    return [(i, t.encode()) for i, t in enumerate(rows)]


@pytest.mark.parametrize("hot", [4096, 1])
@pytest.mark.parametrize("keep", ["none", "first"])
def test_repeats_equal_brute_force(spark, monkeypatch, keep, hot):
    monkeypatch.setattr(lpf, "HOT", hot)
    rows = _repeat_rows()
    frame = spark.createDataFrame([(i, t.decode()) for i, t in rows], "doc_id long, text string")
    got = {}
    for r in lpf.remove_repeats(frame, 400, keep).collect():
        got[r.doc_id] = sum(b - a for a, b in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()
    assert got == _brute(rows, 400, keep)


def test_long_texts_are_cut_into_pieces_without_losing_matches(spark, monkeypatch):
    monkeypatch.setattr(lpf, "PIECE", 1000)
    rows = _repeat_rows()
    rows.append((len(rows), b" ".join(t for _, t in rows[:40])))
    power, want = lpf._powers(), {}
    for i, first, last, _, hashes in lpf.segments([t for _, t in rows], 400, power):
        for a, b, h in zip(first.tolist(), last.tolist(), hashes.tolist(), strict=True):
            for s in range(a, b + 1):
                assert want.setdefault(rows[i][1][s : s + 400], h) == h  # equal windows, equal anchors
    assert len(want) == len({t[s : s + 400] for _, t in rows for s in range(len(t) - 399)})


def test_repeats_take_awkward_rows(spark):
    rows = lpf.repeat_report(awkward_docs(spark)).collect()
    assert len(rows) == 12
    by_text = {r.doc_id: r for r in rows if r.doc_id in (3, 4, 7)}
    assert by_text[3].n_bytes == by_text[4].n_bytes == 0 and by_text[7].n_removed == 0
    assert [r.n_removed == r.n_bytes for r in rows if r.n_bytes == 8 * len(PLAIN)] == [True] * 3
    assert lpf.repeat_report(no_docs(spark)).count() == 0
    first = lpf.remove_repeats(awkward_docs(spark), 400, "first").where("doc_id = 2").collect()
    assert sorted(len(r.kept) for r in first) == [0, 30]
