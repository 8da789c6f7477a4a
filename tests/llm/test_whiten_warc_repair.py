from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ratelake.llm import repair, warc, whiten
from ratelake.session import scratch_path
from tests.conftest import SF_MID

# ---- whitening ----


def _plain_whitening(vectors, k):
    x = np.floor(np.array(vectors, np.float64) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    values, u = np.linalg.eigh(c.T @ c / n)
    values, u = values[::-1][:k], u[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(axis=1), c @ u / np.sqrt(values), values / (c * c).sum() * n


def _held_against_numpy(rows, vectors, k):
    n, deviation, white, share = _plain_whitening(vectors, k)
    got = sorted(rows, key=lambda r: (r.vec_id, r.component))
    assert [(r.vec_id, r.component) for r in got] == [(i, c) for i in range(len(vectors)) for c in range(1, k + 1)]
    assert {r.n for r in got} == {n} and [r.deviation for r in got[::k]] == deviation.tolist()
    w = np.array([r.whitened for r in got]).reshape(-1, k)
    assert np.abs(w * np.sign((w * white).sum(axis=0)) - white).max() < 1e-10
    assert np.allclose([r.explained for r in got[:k]], share, rtol=1e-12)
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and abs(errors.pop() - np.abs(w.T @ w / n - np.eye(k)).max()) < 1e-12


def test_whitening_equals_dense_eigenvectors(spark):
    table = spark.read.parquet(f"{SF_MID}/embeddings.parquet").orderBy("vec_id")
    _held_against_numpy(whiten.whitening_report(table).collect(), [r.embedding for r in table.collect()], 8)


def test_whitening_with_wide_integers_and_sums_in_spark(spark, monkeypatch):
    monkeypatch.setattr(whiten, "GATHER_TASKS", 0)
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((60, 12)) * [1, 2, 4, 8, 16, 32, 3e6, 5e6, 1, 1, 1, 1]).tolist()
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(5)
    rows = whiten.whitening_report(table, 3).collect()
    n, _, white, share = _plain_whitening(vectors, 3)
    w = np.array([r.whitened for r in sorted(rows, key=lambda r: (r.vec_id, r.component))]).reshape(-1, 3)
    assert np.abs(np.abs(w[:, :2]) - np.abs(white[:, :2])).max() < 1e-8
    x = np.floor(np.array(vectors) * 1024).astype(np.int64).astype(object) + 100_000
    exact = ((n * x - x.sum(axis=0)) ** 2).sum(axis=1)
    want = {i: int(e) if e < 2**63 else None for i, e in enumerate(exact)}
    assert {r.vec_id: r.deviation for r in rows} == want and any(v is None for v in want.values())


def test_whitening_takes_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0, 3.0], [2.0, 1.0, 0.5], [0.0, -1.0, 1.0], [0.0, -1.0, 1.0], [5.0, 1.0, 1.0]]
    rows = [(i, v, "x") for i, v in enumerate(good)]
    bad = [(90, None), (91, [None, 1.0, 2.0]), (92, [nan, 1.0, 2.0]), (93, [1.0, -inf, 2.0]), (94, [1e300, 1.0, 2.0]), (95, [1.0]), (96, []), (None, None)]
    rows += [(i, v, None) for i, v in bad]
    schema = "vec_id long, embedding array<double>, n string"
    out = whiten.whitening_report(spark.createDataFrame(rows, schema), 8)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    _held_against_numpy(out.collect(), good, 3)
    repeated = whiten.whitening_report(spark.createDataFrame([(None, v, "x") for v in good], schema), 2).collect()
    assert len(repeated) == 10 and {r.vec_id for r in repeated} == {None}
    for none in ([], rows[5:7], [(1, [1.0, 2.0], "x")] * 3):
        assert whiten.whitening_report(spark.createDataFrame(none, schema)).count() == 0


def test_jacobi_davidson_on_close_and_multiple_values():
    rng = np.random.default_rng(8)
    for values in ([5.0, 5.0, 5.0, 1.0] + [0.5] * 60, list(1 + 1e-7 * np.arange(80)), [1e9, 1.0, 1e-3] + [0.0] * 40, [2.0, 1.0]):
        q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
        a = (q * values) @ q.T
        k = min(4, len(values))
        got, u = whiten.jacobi_davidson(lambda x, a=a: a @ x, len(values), k)
        want = np.sort(values)[::-1][:k]
        assert np.abs(got - want).max() <= 1e-12 * want[0]
        assert np.linalg.norm(a @ u - u * got, axis=0).max() <= 1e-12 * want[0] and np.abs(u.T @ u - np.eye(k)).max() < 1e-12


# ---- archive ----


def _digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


PAGES = "page_id long, url string, html string, digest string, payload string"


def _awkward_pages(spark):
    rows = [
        (1, "http://a/", "<p>one</p>", "x", "y"),
        (2, "http://b/ c\r\nX: y", "<p>one</p>", None, None),
        (2, "http://b/ c\r\nX: y", "<p>one</p>", None, None),  # a repeated row
        (3, None, None, None, None),
        (4, "http://d/", "", "x", "y"),
        (None, "http://e/", "<p>one</p>", "x", "y"),
        (None, "http://f/", "no id", "x", "y"),
        (6, "http://g/", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nb" * 3, "x", "y"),
        (7, "http://h/", "é 漢字 🙂" * 60_000, "x", "y"),
        (8, "http://i/", "one of its kind", "x", "y"),
    ]
    return spark.createDataFrame(rows, PAGES).repartition(3)


def test_archive_report_of_awkward_pages(spark):
    pages = _awkward_pages(spark)
    rows = warc.archive_report(pages).collect()
    want = []
    for p in pages.collect():
        first = {"<p>one</p>": 2, "": 4}.get(p.html or "", p.page_id)
        want.append((p.page_id, len((p.html or "").encode()), _digest(p.html), first if p.page_id != first else None))
    assert sorted(map(str, ((r.page_id, r.payload_bytes, r.payload_digest, r.refers_to if r.refers_to != r.page_id else None) for r in rows))) == sorted(map(str, want))
    # one response for each payload, and of the two equal rows one revisits the other
    assert sorted(r.payload_digest for r in rows if r.record_type == "response") == sorted({_digest(p.html) for p in pages.collect()})
    assert sorted(r.record_type for r in rows if r.page_id == 2) == ["response", "revisit"]
    assert all((r.refers_to is None) == (r.record_type == "response") for r in rows)


def test_small_payloads_stay_responses(spark):
    rows = warc.archive_report(_awkward_pages(spark), least=11).collect()
    assert {r.record_type for r in rows} == {"response"}
    rows = warc.archive_report(_awkward_pages(spark), least=10).collect()
    assert sorted(r.page_id or -1 for r in rows if r.record_type == "revisit") == [-1, 1, 2]


def test_empty_archive(spark):
    assert warc.archive_report(spark.createDataFrame([], PAGES)).collect() == []


def test_files_give_the_same_records_back(spark):
    path = scratch_path(spark, "warc-test")
    warc.store(_awkward_pages(spark), f"{path}/archive")
    records = warc.records(spark, f"{path}/archive")
    warc.write_files(records, f"{path}/files", files=2)
    back = warc.read_files(spark, f"{path}/files")
    assert sorted(bytes(r.record) for r in back.collect()) == sorted(bytes(r.record) for r in records.collect())
    assert sorted(map(str, warc.page_report(warc.parsed(back)).collect())) == sorted(map(str, warc.page_report(warc.parsed(records)).collect()))
    for record in (bytes(r.record) for r in records.collect()):
        head, body = record.split(b"\r\n\r\n", 1)
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert int(fields["Content-Length"]) == len(body) and "\n" not in fields.get("WARC-Target-URI", "")
        assert fields["WARC-Type"] == "revisit" or fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body.split(b"\r\n\r\n", 1)[1]).digest()).decode()


def test_a_payload_is_stored_once_and_damage_is_noticed(spark):
    path = scratch_path(spark, "warc-damage")
    warc.store(_awkward_pages(spark), path)
    payloads = spark.read.parquet(f"{path}/payloads")
    assert payloads.count() == 6
    other = scratch_path(spark, "warc-damaged")
    spark.read.parquet(f"{path}/records").write.parquet(f"{other}/records")
    payloads.withColumn("payload", F.when(F.octet_length("payload") == 10, F.encode(F.lit("<p>two</p>"), "UTF-8")).otherwise(F.col("payload"))).write.parquet(f"{other}/payloads")
    with pytest.raises(PySparkException, match="wrong bytes under digest"):
        warc.page_report(warc.parsed(warc.records(spark, other))).collect()


# ---- conversations ----


def _brute_edits(codes):
    """Cheapest (cost, initials) by dynamic programming over the rows."""
    far = (1 << 60, "")
    best = [(0, ""), far, far, (0, "")]
    for i in range(len(codes), -1, -1):
        if i < len(codes):
            best = [min([far, *((c + best[to][0], l + best[to][1]) for l, c, taken, to in repair.MOVES[codes[i]][e] if taken)]) for e in range(4)]
        for _ in range(6):
            best = [min(best[e], (3 + best[repair.INSERTED[e]][0], "I" + best[repair.INSERTED[e]][1])) for e in range(4)]
    return best[0]


def test_search_equals_dynamic_programming():
    rng = random.Random(5)
    for _ in range(1500):
        codes = bytes(rng.randrange(12) for _ in range(rng.randrange(0, 14)))
        assert repair.cheapest_edits(codes) == _brute_edits(codes)
    for _ in range(10):
        codes = bytes(rng.choice([0, 3, 3, 6, 6, 3, 6, 4, 7, 5, 8, 9]) for _ in range(500))
        assert repair.cheapest_edits(codes) == _brute_edits(codes)


def _plain_repairs(rows):
    """The contract in plain Python: {conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha256)}."""
    own = lambda v: " " if v is None else str(v)
    hurt = {}
    for conv, turn, role, text in rows:
        kind, role, text = zlib.crc32(f"{own(conv)}:{own(turn)}".encode()) % 20, own(role), own(text)
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        hurt.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    out = {}
    for conv, own_rows in hurt.items():
        own_rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults, codes, counts = set(), [], [], [0, 0, 0]
        for _, role, text in own_rows:
            end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            fault = 1 if not end else 2 if (role, text) in seen else 0 if end in ".!?" else 3
            seen.add((role, text))
            counts[fault - 1] += fault > 0
            faults.append(fault)
            codes.append(repair.CODE[role[:1] if role[:1] and role[:1] in "sua" else "?", (0, 2, 2, 1)[fault]])
        turns = [t for t, _, _ in own_rows if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own_rows, own_rows[1:], strict=False))
        cost, audit = _brute_edits(codes)
        lines, at, roles = [], 0, ""
        for edit in audit:
            put = "user" if not roles or roles[-1] in "sa" else "assistant"
            if edit == "I":
                role, text = put, ""
            else:
                role, text = own_rows[at][1:]
                role, at = put if edit == "R" else role, at + 1
            if edit != "D":
                lines.append(f"{role}:{text}")
                roles += role[0]
        assert at == len(own_rows) and (not roles or roles.removeprefix("s") == "ua" * (len(roles) // 2) != "")
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def _repairs_of(df, **kwargs):
    rows = repair.repair_report(df, **kwargs).collect()
    got = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(got) == len(rows)
    return got


def test_repairs_equal_plain_python(spark):
    table = spark.read.parquet(f"{SF_MID}/conversations.parquet")
    want = _plain_repairs([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    for held in (repair.HELD_BYTES, 1000):
        got = _repairs_of(table, held_bytes=held)
        assert {k: v for k, v in got.items() if k in want} == {k: v for k, v in want.items() if k in got} and len(got) == len(want)


def test_repairs_of_awkward_conversations(spark):
    rng = random.Random(2)
    rows = []
    for conv in [*range(40), None]:
        for turn in [*range(rng.randrange(1, 9)), *([None, None, 3] if conv is None or conv % 5 == 0 else [])]:
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "Admin"])
            text = rng.choice(["Hello there.", "Hello there.", "cut off", "", " \t\n", None, "Fine! \x0b ", "é 漢字？", "yes? ", "long " * 5000 + "end."])
            rows.append((conv, turn, role, text, "x", 1))
    rows.append((99, 0, "user", "dropped.", "x", 1))
    n = next(t for t in range(1000) if zlib.crc32(f"99:{t}".encode()) % 20 == 0)
    rows[-1] = (99, n, "user", "dropped.", "x", 1)
    rows += [(77, t * 10**17, "user" if t % 2 == 0 else "assistant", "Over.", "x", 1) for t in range(-90, 90)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost string, `c` int").repartition(3)
    want = _plain_repairs([r[:4] for r in rows])
    assert want[99] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    for held in (repair.HELD_BYTES, 300):
        got = _repairs_of(table, held_bytes=held)
        want[77] = (got[77][0], *want[77][1:])  # the gap is beyond a long
        assert got == want and got[77][0] == 2**63 - 1
    assert repair.repair_report(table.limit(0)).collect() == []
