"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

The model is an n-gram model over UTF-8 bytes, trained on all trusted text (rows
labelled of good quality and not toxic); its counts grow with that text. A byte
n-gram is one long, so contexts and suffixes are shifts and masks and every step
of the estimate is an aggregation or an equi-join of sharded tables:

* raw counts of the highest order, continuation counts of every lower one,
* three discounts per order from the counts of counts,
* a back-off weight per context, and interpolated probabilities bottom up.

While the model's counted rows are at most ``HELD_ROWS`` its arrays are broadcast and texts are
scored where they are read. A larger model stays sharded: texts are packed once into compressed
blocks of about ``BLOCK_BYTES``, however small the input's partitions, a block asks only for its
distinct n-grams, and the answers are joined from the sharded tables and meet the block again by its id.
Both ways give the same perplexities, which are held against quantiles of the trusted documents of
the same language.

No text is scored by a model that has learned from it. Trusted texts are dealt into two folds by
their hash, so copies stay together, and a trusted document's perplexity comes from a model of the
other fold; all others' comes from the model of both. So the quantiles say what text that was never
seen looks like. A language with few trusted documents has no tails of its own: it uses the
wider of its own limits and those of all trusted documents.

Perplexity is a mean and does not see a few words, so a text also goes for any single
word that marks toxic text; these words come from the labelled rows, counted by distinct
contexts so that copies of a toxic text do not turn its ordinary words into marks.

Defined results: a null or empty text has no perplexity and is rejected; a language
without trusted documents (a null language is one of its own) uses the quantiles of
all trusted documents; without any trusted text nothing but empty texts is rejected;
equal rows get equal results; an empty table gives an empty result; extra columns
are kept by ``filter_documents`` and ignored elsewhere.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelake.llm.common import free_name, saved, small_side

ORDER = 5
START = b"\xff"  # never part of UTF-8
FOLDS = 2
BLOCK_BYTES = 64 << 20
PIECE_ROWS = 512
CHUNK_BYTES = 4 << 20
# A text is kept between these quantiles of its language's trusted texts, widened by the slack (a share of log perplexity).
LOW, HIGH = 0.0005, 0.998
SLACK = 0.05
# A word marks toxic text if its share of toxic documents is, by this many standard errors, above this multiple of its share of trusted ones.
ERRORS, TIMES = 2.33, 5.0
CHANCE = 0.01
LEAST = 1e-12  # the least probability of a byte: discounts of zero leave nothing to unseen ones
HELD_ROWS = 6_000_000  # rows of all tables of a broadcast model, 16 bytes each
HELD_PIECE = 1 << 18  # rows of a broadcast model that are sorted and compressed at once
JOINED_ROWS = 50_000  # rows of a table that the estimate joins by broadcast: the driver holds such a side several times
FEW = 400  # trusted documents of a language below which its own quantiles are not relied on alone


def _keys(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram of every byte of every text (its context padded at the start), and the texts' lengths."""
    pad = START * (order - 1)
    raw = np.frombuffer(pad + pad.join(texts), np.uint8)
    n = len(raw) - order + 1
    keys = np.zeros(max(n, 0), np.int64)
    for i in range(order):
        keys = (keys << 8) | raw[i : i + n]
    size = np.array([len(t) for t in texts], np.int64)
    # Between two texts lie order - 1 pad bytes: drop the n-grams that end in one.
    ends = np.cumsum(size + order - 1) - (order - 1)
    keep = np.ones(n, bool)
    for i in range(order - 1):
        keep[(ends[:-1] + i)[ends[:-1] + i < n]] = False
    return keys[keep], size


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    size = 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= CHUNK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def ngram_counts(docs: DataFrame, order: int) -> DataFrame:
    """(key, c): raw counts of all n-grams of column ``t`` (bytes); one table a ``fold`` if there is such a column."""
    fold = "fold" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = batch.column(1).to_numpy()
            for f in np.unique(folds).tolist():
                own = batch.column(0).filter(pa.array(folds == f))
                for texts in _chunks([t for t in own.to_pylist() if t]):
                    got = pc.value_counts(pa.array(_keys(texts, order)[0]))
                    key, c = got.field("values"), got.field("counts")
                    yield pa.RecordBatch.from_pydict({"fold": pa.array(np.full(len(key), f), pa.int32()), "key": key, "c": c})

    rows = docs.select("t", F.col("fold").cast("int") if fold else F.lit(0))
    counts = rows.mapInArrow(run, "fold int, key long, c long")
    return counts.groupBy(*(["fold"] if fold else []), "key").agg(F.sum("c").alias("c"))


def discounts(table: DataFrame) -> tuple[Column, int]:
    """The discount of a row of (m, key, c), D1, D2 or D3+ of its model's counts of counts, and the number of rows."""
    n = [F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]
    cut, total = F.lit(0.0), 0
    for r in table.groupBy("m").agg(*n, F.count(F.lit(1)).alias("rows")).collect():  # a row a model
        n1, n2, n3, n4, total = r["n1"], r["n2"], r["n3"], r["n4"], total + r["rows"]
        d = (0.5, 1.0, 1.5)
        if n1 and n2 and n3 and n4:
            y = n1 / (n1 + 2 * n2)
            d = tuple(min(max(i - (i + 1) * y * b / a, 0.0), float(i)) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
        own = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        cut = F.when(F.col("m") == r["m"], own).otherwise(cut)
    return cut, total


def suffix(key: Column, n: int) -> Column:
    return key.bitwiseAND(F.lit((1 << (8 * n)) - 1))


class Model(list[tuple[DataFrame, DataFrame]]):
    """For n = 1..order: (m, key, p) interpolated probabilities and (m, h, g) back-off weights of contexts, each marked
    for a broadcast join if its counted rows are few. ``rows`` bounds the rows of all tables."""

    rows = 0


def train(trusted: DataFrame, order: int = ORDER) -> Model:
    """One model (m = 0) of all of ``trusted``."""
    return estimate(saved(ngram_counts(trusted, order).withColumn("m", F.lit(0))), order)


def estimate(counts: DataFrame, order: int) -> Model:
    """The models of raw counts (m, key, c) of the highest order, one for each m, in one set of tables."""
    tables = [counts]
    for n in range(order - 1, 0, -1):
        tables.append(saved(tables[-1].groupBy("m", suffix(F.col("key"), n).alias("key")).agg(F.count(F.lit(1)).alias("c"))))
    model = Model()
    for n, table in enumerate(reversed(tables), 1):
        cut, n_rows = discounts(table)
        rows = table.withColumn("h", F.shiftright("key", 8)).withColumn("d", cut)
        contexts = saved(rows.groupBy("m", "h").agg(F.sum("c").alias("s"), (F.sum("d") / F.sum("c")).alias("g")))
        contexts = small_side(contexts, n_rows, JOINED_ROWS)  # never more contexts than rows
        model.rows += 2 * n_rows
        rows = rows.join(contexts, ["m", "h"])
        if n == 1:
            lower = F.lit(1.0 / 256)
        else:
            below = model[-1][0].select("m", F.col("key").alias("low"), F.col("p").alias("q"))
            rows = rows.withColumn("low", suffix(F.col("key"), n - 1)).join(below, ["m", "low"])
            lower = F.col("q")
        p = (F.col("c") - F.col("d")) / F.col("s") + F.col("g") * lower
        model.append((small_side(saved(rows.select("m", "key", p.alias("p"))), n_rows, JOINED_ROWS), contexts.select("m", "h", "g")))
    return model


def log_probabilities(keys: DataFrame, model: Model) -> DataFrame:
    """(m, key, lp): the natural log probability of every asked n-gram (m, key), backing off where it was never seen."""
    order = len(model)
    top = keys.join(model[-1][0], ["m", "key"], "left")
    seen = top.where(F.col("p").isNotNull()).select("m", "key", F.log(F.greatest("p", F.lit(LEAST))).alias("lp"))
    rest = saved(top.where(F.col("p").isNull()).select("m", "key"))
    estimate: Column = F.lit(1.0 / 256)
    for n in range(1, order + 1):
        probs, contexts = model[n - 1]
        here = suffix(F.col("key"), n)
        rest = rest.withColumn("h", F.shiftright(here, 8)).join(contexts.withColumnRenamed("g", f"g{n}"), ["m", "h"], "left").drop("h")
        estimate = F.coalesce(F.col(f"g{n}"), F.lit(1.0)) * estimate
        if n < order:
            probs = probs.select("m", F.col("key").alias("low"), F.col("p").alias(f"p{n}"))
            rest = rest.withColumn("low", here).join(probs, ["m", "low"], "left").drop("low")
            estimate = F.coalesce(F.col(f"p{n}"), estimate)
    return seen.unionAll(rest.select("m", "key", F.log(F.greatest(estimate, F.lit(LEAST))).alias("lp")))


def pack(docs: DataFrame) -> DataFrame:
    """(block, payload): rows of part, doc_id, key, lang, t in compressed Arrow blocks of about one size, written once."""
    size = docs.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, held, full = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            out = io.BytesIO()
            options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=9))
            with pa.ipc.new_stream(out, held[0].schema, options=options) as writer:
                for b in held:
                    writer.write_batch(b)
            return pa.RecordBatch.from_pydict(
                {"block": pa.array([(task << 24) | n], pa.int64()), "payload": pa.array([out.getvalue()], pa.binary())}
            )

        for batch in batches:
            for at in range(0, batch.num_rows, PIECE_ROWS):
                piece = batch.slice(at, PIECE_ROWS)
                held.append(piece)
                full += pc.sum(pc.binary_length(piece.column("t"))).as_py() or 0
                if full >= BLOCK_BYTES:
                    yield flush()
                    held, full, n = [], 0, n + 1
        if held:
            yield flush()

    return saved(docs.coalesce(max(1, -(-size // BLOCK_BYTES))).mapInArrow(run, "block long, payload binary"))


def _unpacked(payload: bytes) -> Iterator[pa.RecordBatch]:
    yield from pa.ipc.open_stream(payload)


SCORED = "part int, doc_id long, key long, lang string, n_bytes long, perplexity double"


def _scored(piece: pa.RecordBatch, order: int, logs: Callable[[int, np.ndarray], np.ndarray]) -> pa.RecordBatch:
    """The rows of ``SCORED`` for rows of part, doc_id, key, lang, t; ``logs`` gives a part's n-grams' log probabilities."""
    texts = [t or b"" for t in piece.column("t").to_pylist()]
    parts = piece.column("part").to_numpy()
    value = np.full(len(texts), np.nan)
    for part in np.unique(parts).tolist():
        own = np.nonzero((parts == part) & np.array([bool(t) for t in texts]))[0]
        at = 0
        for chunk in _chunks([texts[i] for i in own]):
            keys, size = _keys(chunk, order)
            each = np.add.reduceat(logs(part, keys), np.r_[0, np.cumsum(size)[:-1]])
            value[own[at : at + len(chunk)]] = np.exp(-each / size)
            at += len(chunk)
    schema = pa.schema(
        [("part", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("lang", pa.string()), ("n_bytes", pa.int64()), ("perplexity", pa.float64())]
    )
    columns = [piece.column(c) for c in ("part", "doc_id", "key", "lang")]
    columns += [pa.array([len(t) for t in texts], pa.int64()), pa.array(value, pa.float64(), mask=np.isnan(value))]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def scores(docs: DataFrame, model: Model, parts: int) -> DataFrame:
    """part, doc_id, key, lang, n_bytes, perplexity of every row of ``docs`` (part, doc_id, key, lang, t), by the model m = part; saved."""
    return held_scores(docs, model) if model.rows <= HELD_ROWS else saved(sharded_scores(docs, model, parts))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind, m, key, v as (kind, m, n, payload): the keys' sorted steps and the values, compressed."""
    codec = pa.Codec("zstd")

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        kind, m, key, v = (c.to_numpy() for c in pa.Table.from_batches(held).columns)
        out = []
        for k, part in np.unique(np.stack([kind, m], axis=1), axis=0).tolist():
            own = np.flatnonzero((kind == k) & (m == part))
            own = own[np.argsort(key[own])]
            steps = np.diff(key[own], prepend=np.int64(0))
            out.append((k, part, len(own), codec.compress(steps.tobytes() + v[own].tobytes(), asbytes=True)))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["kind", "m", "n", "payload"])

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= HELD_PIECE:
            yield packed(held)
            held, n = [], 0
    if held:
        yield packed(held)


def _arrays(pieces: list[dict]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """The sorted keys and the values of each (m, kind) of ``_pieces``."""
    codec = pa.Codec("zstd")
    found: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    for piece in pieces:
        n = piece["n"]
        raw = codec.decompress(piece["payload"], decompressed_size=16 * n)
        own = np.cumsum(np.frombuffer(raw, np.int64, n)), np.frombuffer(raw, np.float64, n, 8 * n)
        found.setdefault((piece["m"], piece["kind"]), []).append(own)
    tables = {}
    for name in list(found):
        key, v = (np.concatenate(x) for x in zip(*found.pop(name), strict=True))
        sort = np.argsort(key, kind="stable")
        tables[name] = key[sort], v[sort]
    return tables


class _Packed:
    """Compressed tables that turn into ``_arrays`` where a worker first reads them."""

    def __init__(self, pieces: list[dict]) -> None:
        self.pieces = pieces

    def __reduce__(self) -> tuple:
        return _arrays, (self.pieces,)


def held_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``scores`` with the tables of a small model broadcast as sorted arrays. Tasks compress them: the driver passes them on as they are."""
    order, rows = len(model), None
    for n, (probs, contexts) in enumerate(model):
        both = probs.select(F.lit(2 * n).alias("kind"), "m", "key", F.col("p").alias("v"))
        both = both.unionAll(contexts.select(F.lit(2 * n + 1), "m", "h", "g"))
        rows = both if rows is None else rows.unionAll(both)
    assert rows is not None
    pieces = rows.mapInArrow(_pieces, "kind int, m int, n long, payload binary").toArrow().to_pylist()  # of at most HELD_ROWS rows
    held = docs.sparkSession.sparkContext.broadcast(_Packed(pieces))
    del pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = held.value

        def known(part: int, k: int, keys: np.ndarray, missing: np.ndarray | float) -> np.ndarray:
            have, values = arrays.get((part, k), (np.empty(0, np.int64), np.empty(0)))
            if not len(have):
                return np.broadcast_to(missing, keys.shape)
            at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
            return np.where(have[at] == keys, values[at], missing)

        def logs(part: int, keys: np.ndarray) -> np.ndarray:
            coded = pa.array(keys).dictionary_encode()
            own = coded.dictionary.to_numpy()
            estimate = np.full(len(own), 1.0 / 256)
            for n in range(1, order + 1):
                here = own & ((1 << (8 * n)) - 1)
                estimate = known(part, 2 * n - 1, here >> 8, 1.0) * estimate
                estimate = known(part, 2 * n - 2, here, estimate)
            return np.log(np.maximum(estimate, LEAST))[coded.indices.to_numpy()]

        for batch in batches:
            yield _scored(batch, order, logs)

    out = saved(docs.select("part", "doc_id", "key", "lang", "t").mapInArrow(run, SCORED))
    held.destroy()
    return out


def sharded_scores(docs: DataFrame, model: Model, parts: int) -> DataFrame:
    """``scores`` with a model of any size: part, doc_id, key, lang, n_bytes, perplexity of every row of ``docs`` (part, doc_id, key, lang, t), by the model m = part."""
    order = len(model)
    blocks = pack(docs)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own, more = np.empty(0, np.int64), []
                for piece in _unpacked(payload.as_buffer()):
                    for texts in _chunks([t for t in piece.column("t").to_pylist() if t]):
                        more.append(pc.unique(pa.array(_keys(texts, order)[0])).to_numpy())
                        if len(more) == 8:
                            own, more = np.unique(np.concatenate([own, *more])), []
                own = np.unique(np.concatenate([own, *more]))
                for at in range(0, len(own), 1 << 16):
                    keys = own[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_pydict({"block": np.full(len(keys), block), "key": keys})

    asked = saved(blocks.mapInArrow(ask, "block long, key long"))
    wanted = asked.select("key").distinct().select(F.explode(F.array(*[F.lit(m) for m in range(parts)])).alias("m"), "key")
    each = [F.max(F.when(F.col("m") == m, F.col("lp"))).cast("float") for m in range(parts)]
    answers = log_probabilities(wanted, model).groupBy("key").agg(F.array(*each).alias("lp"))
    told = asked.join(answers, "key").select("block", "key", "lp")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        known = right.column("key").combine_chunks()
        lp = right.column("lp").combine_chunks().flatten().to_numpy().reshape(-1, parts).astype(np.float64)

        def logs(part: int, keys: np.ndarray) -> np.ndarray:
            return lp[pc.index_in(pa.array(keys), value_set=known).to_numpy(), part]

        return pa.Table.from_batches([_scored(piece, order, logs) for payload in left.column("payload") for piece in _unpacked(payload.as_buffer())])

    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, SCORED)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids all of whose labels say good quality and not toxic."""
    good = (F.coalesce(F.col("quality"), F.lit(0)) == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(good).alias("good")).where("good").select("doc_id")


def _words(text: Column) -> Column:
    """The distinct lower-cased words (runs of letters)."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1)))


def _in_context(texts: DataFrame) -> DataFrame:
    """toxic, tongue, word, around of every word of column ``t``; ``around`` is a hash of the words beside it."""
    rows = texts.withColumn("w", F.regexp_extract_all(F.lower("t"), F.lit(r"(\p{L}+)"), F.lit(1)))
    rows = rows.select("toxic", "tongue", "w", F.concat(F.array(F.lit("")), "w").alias("before"), F.slice("w", F.lit(2), F.size("w")).alias("behind"))
    rows = rows.select("toxic", "tongue", F.explode(F.arrays_zip("w", "before", "behind")).alias("z")).where("z.w IS NOT NULL")
    around = F.xxhash64(F.coalesce("z.before", F.lit("")), F.coalesce("z.behind", F.lit("")))
    return rows.select("toxic", "tongue", F.col("z.w").alias("word"), around.alias("around"))


def toxic_words(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(tongue, word): words that mark toxic text of a language, from the labelled rows of ``rows`` (doc_id, lang, t).

    Candidates are words whose share of the language's toxic documents is, less ``ERRORS`` standard errors
    of the log ratio, ``TIMES`` that of trusted ones. Copies of a text say the same thing many
    times, so a candidate is then counted by its distinct contexts (the words beside it). It marks
    toxic text if the chance that as many of them are toxic, were it only ``TIMES`` as frequent there, is below
    ``CHANCE`` after all words tried (Chernoff's bound).
    """
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce(F.col("toxic"), F.lit(0)) == 1).alias("toxic"))
    known = known.join(trusted_ids(labels).withColumn("good", F.lit(True)), "doc_id", "left").where("toxic OR good")
    known = saved(known.select("doc_id", "toxic"))
    texts = rows.join(small_side(known, known.count()), "doc_id").where(F.length("t") > 0)
    texts = texts.select("toxic", F.coalesce("lang", F.lit("")).alias("tongue"), F.col("t").cast("string").alias("t"))
    sizes = texts.groupBy("tongue").agg(F.count_if("toxic").alias("bad"), F.count_if(~F.col("toxic")).alias("fine"))
    each = texts.select("toxic", "tongue", F.explode(_words(F.col("t"))).alias("word"))
    counts = each.groupBy("tongue", "word").agg(F.count_if("toxic").alias("b"), F.count_if(~F.col("toxic")).alias("f")).where("b > 0")
    b, f = F.col("b") + 0.5, F.col("f") + 0.5
    ratio = F.log(b / (F.col("bad") + 1)) - F.log(f / (F.col("fine") + 1))
    strong = ratio - ERRORS * F.sqrt(1 / b + 1 / f) >= math.log(TIMES)
    counts = saved(counts)
    tried = counts.groupBy("tongue").agg(F.count(F.lit(1)).alias("tried")).join(sizes, "tongue")
    candidates = saved(counts.join(tried, "tongue").where(strong).select("tongue", "word", "bad", "fine", "tried"))
    spots = _in_context(texts).join(small_side(candidates, candidates.count()), ["tongue", "word"])
    spots = spots.groupBy("tongue", "word", "around").agg(F.max("toxic").alias("toxic"), *[F.first(c).alias(c) for c in ("bad", "fine", "tried")])
    seen = spots.groupBy("tongue", "word").agg(
        F.count_if("toxic").alias("b"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("bad", "fine", "tried")]
    )
    q, p = F.col("b") / F.col("n"), TIMES * (F.col("bad") + 1) / (TIMES * (F.col("bad") + 1) + F.col("fine") + 1)
    rest = F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0)
    bound = F.when(q > p, F.col("n") * (q * F.log(q / p) + rest)).otherwise(0.0)
    return seen.where(bound >= F.log(F.col("tried") / CHANCE)).select("tongue", "word")


def _parts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``part``: the fold of a trusted row, ``FOLDS`` for all others."""
    trusted = saved(trusted_ids(labels))
    known = small_side(trusted.withColumn("good", F.lit(True)), trusted.count())
    fold = F.pmod(F.xxhash64("t", F.lit("fold")), F.lit(FOLDS)).cast("int")
    return rows.join(known, "doc_id", "left").withColumn("part", F.when(F.col("good"), fold).otherwise(FOLDS)).drop("good")


def judge(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, key, lang, n_bytes, perplexity, low, high, toxic_words, keep of every row."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("doc_id", "text", "lang").alias("key"),
        F.col("lang").cast("string").alias("lang"),
        F.col("text").cast("binary").alias("t"),
    )
    parts = _parts(rows, labels).select("part", "doc_id", "key", "lang", "t")
    seen = parts.where(F.col("part") < FOLDS).where(F.length("t") > 0).select("t", F.col("part").alias("fold"))
    # Model m < FOLDS has all folds but m, model FOLDS has all.
    learns = F.explode(F.array(*[F.when(F.col("fold") == m, None).otherwise(F.lit(m)) for m in range(FOLDS)], F.lit(FOLDS)))
    counts = ngram_counts(seen, order).select("key", "c", learns.alias("m")).where("m IS NOT NULL")
    model = estimate(saved(counts.groupBy("m", "key").agg(F.sum("c").alias("c"))), order)
    got = scores(parts, model, FOLDS + 1)
    of_trusted = got.where(F.col("part") < FOLDS).where("perplexity IS NOT NULL").withColumn("lp", F.log("perplexity"))
    cuts = F.percentile_approx("lp", F.array(F.lit(LOW), F.lit(HIGH)), 10_000)
    everything = of_trusted.agg(cuts.alias("q")).first()["q"]
    far = (float("-inf"), float("inf")) if everything is None else ((1 - SLACK) * everything[0], (1 + SLACK) * everything[1])
    few = F.col("n") < FEW
    low, high = (1 - SLACK) * F.col("q")[0], (1 + SLACK) * F.col("q")[1]
    by_lang = of_trusted.groupBy("lang").agg(cuts.alias("q"), F.count(F.lit(1)).alias("n")).select(
        F.coalesce("lang", F.lit("")).alias("known"),
        F.col("lang").isNull().alias("none"),
        F.when(few, F.least(low, F.lit(far[0]))).otherwise(low).alias("low"),
        F.when(few, F.greatest(high, F.lit(far[1]))).otherwise(high).alias("high"),
    )
    by_lang = saved(by_lang)
    marks = saved(toxic_words(rows, labels))
    each = rows.select("key", F.coalesce("lang", F.lit("")).alias("tongue"), F.explode(_words(F.col("t").cast("string"))).alias("word"))
    each = each.join(small_side(marks, marks.count()), ["tongue", "word"])
    marked = saved(each.groupBy("key").agg(F.count_distinct("word").cast("int").alias("toxic_words")))
    got = got.join(small_side(marked, marked.count()), "key", "left").withColumn("toxic_words", F.coalesce("toxic_words", F.lit(0)))
    joined = got.join(
        small_side(by_lang, by_lang.count()),
        (F.coalesce("lang", F.lit("")) == F.col("known")) & (F.col("lang").isNull() == F.col("none")),
        "left",
    )
    lp = F.log("perplexity")
    low, high = F.coalesce("low", F.lit(far[0])), F.coalesce("high", F.lit(far[1]))
    keep = F.coalesce((lp >= low) & (lp <= high) & (F.col("toxic_words") == 0), F.lit(False))
    return joined.select(
        "doc_id", "key", "lang", "n_bytes", "perplexity", F.exp(low).alias("low"), F.exp(high).alias("high"), "toxic_words", keep.alias("keep")
    )


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: perplexity, its language's limits and the decision."""
    return judge(docs, labels).drop("key")


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects."""
    gone = free_name(docs, "gone")
    bad = saved(judge(docs, labels).where("NOT keep").select(F.col("key").alias(gone)).distinct())
    return docs.join(small_side(bad, bad.count()), F.xxhash64("doc_id", "text", "lang") == F.col(gone), "left_anti")
