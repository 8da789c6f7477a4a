"""The prediction store as a managed table: folding of micro-batches, clustering and pruned lookups.

The scoring stream leaves one folder for each date and micro-batch (``epoch_writer``), 43,200 a day
at a trigger of two seconds. ``compact`` folds closed epochs into sized, clustered files::

    <store>/event_date=D/epoch=Q-N/    as the stream writes them (query Q, micro-batch N)
    <store>/_folded/segment=S/event_date=D/    what ``compact`` wrote
    <store>/_manifest/<version>.json   which segments count, and up to which N each query is folded

A version of the manifest appears by one rename, so a reader sees the rows before or after a
fold, never both and never neither. An epoch counts once, whatever happens: epochs up to a query's
folded number are read from segments only, so a replay that writes such a folder again
changes nothing; the newest epoch of a query, which a restart may replay, stays open until
a newer one or its commit in the checkpoint shows that it is over. Two folds at once
collide on the version number and one fails. Folded folders are deleted by ``vacuum`` after a
grace time, so running readers of an older version finish.

A date gets one segment for each fold that meets it; at ``fan_in`` segments they are rewritten as one,
so its number of files is bounded by its size and ``fan_in``. Rows of a segment are ordered by date and
by a grid of user and item hashes (their bits interleaved): a small row group then holds
few of the users and few of the items, and Parquet's bloom filters and dictionaries on both ids leave the
others unread. A table of n row groups reads about the root of n for one user or one item.

Beside the rows stand partial aggregates (``streaming.panels``) for the dashboard's panels::

    <store>/_panels/epoch=Q-N/    cells of one micro-batch, written by ``epoch_writer(panels=True)``
    <store>/_panels/piece=P/      cells of folded epochs, merged by ``compact`` where a stream writes cells

They follow the epochs: the same manifest says which pieces and which epochs count, so a replayed epoch
replaces its cells and a folded one counts once. Cells of an epoch that has none (another
writer, or a crash between rows and cells) are made from its rows when they are read or folded.
Pieces are merged by size: a new piece takes in older ones of up to ``fan_in`` times its rows, so there are few
of them and a cell is rewritten a logarithmic number of times.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelake import schemas
from ratelake.operators import dashboard as D
from ratelake.sources import files as FS
from ratelake.streaming import panels as P

DATE = "event_date"
NO_DATE = "__HIVE_DEFAULT_PARTITION__"  # fixed value: Spark's folder name of a null partition
GRID_BITS = 6
FILE_BYTES = 256 << 20
FILE_ROWS = 1 << 19  # rows or cells of a file, which one task sorts: about 50 MB
ROW_GROUP_BYTES = 16 << 20
CELL_BYTES = 24  # about what a cell takes in a file
GRACE_SECONDS = 24 * 3600
KEPT_VERSIONS = 20


@dataclass
class Manifest:
    """One version: live segments [{segment, date, rows}], folded epoch numbers by query, folders to delete, cells [{piece, rows}]."""

    version: int = 0
    segments: list[dict[str, Any]] = field(default_factory=list)
    folded: dict[str, int] = field(default_factory=dict)
    gone: list[dict[str, Any]] = field(default_factory=list)
    pieces: list[dict[str, Any]] = field(default_factory=list)


def grid_cell(user: str | Column = "userId", item: str | Column = "movieId", bits: int = GRID_BITS) -> Column:
    """The cell of a user and an item in a grid of 2**bits by 2**bits hashes, along a Z-shaped curve."""
    u, i = (F.pmod(F.xxhash64(c), F.lit(1 << bits)).cast("int") for c in (user, item))
    bit = lambda c, b: F.shiftright(c, b).bitwiseAND(F.lit(1))
    parts = [F.shiftleft(bit(c, b), 2 * b + k) for b in range(bits) for k, c in enumerate((i, u))]
    out = parts[0]
    for part in parts[1:]:
        out = out + part
    return out


def write_clustered(
    df: DataFrame, path: str, files: int, date_col: str = DATE, ids: Sequence[str] = ("userId", "movieId"), row_group_bytes: int = ROW_GROUP_BYTES
) -> None:
    """Write ``df`` by date into about ``files`` files (and one more a date) ordered by grid cell, with bloom filters on ids.

    Rows of one cell are told apart by a hash of the row, so a user and item that hold a third
    of all rows still spread over files.
    """
    cell, salt = grid_cell(*ids), F.xxhash64(*[c for c in df.columns if c != date_col])
    ordered = df.repartitionByRange(max(1, files), date_col, cell, salt).sortWithinPartitions(date_col, cell, *ids)
    writer = ordered.write.option("parquet.block.size", row_group_bytes).option("parquet.bloom.filter.adaptive.enabled", "true")
    for c in ids:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.partitionBy(date_col).parquet(path)


class PredictionStore:
    """A store folder with its manifest. Cheap to make; every call reads the newest manifest."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- manifest ---------------------------------------------------------------------------------

    def manifest(self) -> Manifest:
        versions = FS.matching(self.spark, f"{self.path}/_manifest/[0-9]*.json")
        return Manifest(**FS.read_json(self.spark, versions[-1])) if versions else Manifest()

    def _publish(self, m: Manifest) -> Manifest:
        m.version += 1
        FS.write_json(self.spark, f"{self.path}/_manifest/{m.version:010d}.json", asdict(m))
        return m

    def _segment(self, segment: dict[str, Any]) -> str:
        return f"{self.path}/_folded/segment={segment['segment']}/{DATE}={segment['date'] or NO_DATE}"

    def _epochs(self) -> list[tuple[str, str, str, int]]:
        """(folder, date or '', query, number) of every epoch folder the stream has left.

        Files that lie in a date's folder itself (a store written in one go) count as an epoch of no query.
        """
        out = []
        for folder in FS.matching(self.spark, f"{self.path}/{DATE}=*/epoch=*"):
            date, epoch = (part.split("=", 1)[1] for part in folder.rsplit("/", 2)[1:])
            query, _, number = epoch.rpartition("-")
            out.append((folder, "" if date == NO_DATE else date, query, int(number)))
        loose = sorted({f.rsplit("/", 1)[0] for f in FS.matching(self.spark, f"{self.path}/{DATE}=*/*.parquet")})
        for folder in loose:
            date = folder.rsplit("=", 1)[1]
            out.append((f"{folder}/*.parquet", "" if date == NO_DATE else date, "", 0))
        return out

    def _open(self, m: Manifest) -> list[tuple[str, str, str, int]]:
        return [e for e in self._epochs() if e[3] > m.folded.get(e[2], -1)]

    # -- reading ----------------------------------------------------------------------------------

    def _rows(self, segments: Iterable[dict[str, Any]], epochs: Iterable[tuple[str, str, str, int]]) -> DataFrame | None:
        """Segments and epoch folders as one table, only the named folders being listed and read."""
        reader, out = self.spark.read, None
        sources = ((f"{self.path}/_folded", [self._segment(s) for s in segments], "segment"), (self.path, [e[0] for e in epochs], "epoch"))
        for base, folders, extra in sources:
            if folders:
                df = reader.option("basePath", base).parquet(*folders).drop(extra)  # a hidden base still reads what is named
                df = df.withColumn(DATE, F.col(DATE).cast("date"))
                out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out

    def read(self, dates: Iterable[str] | None = None) -> DataFrame:
        """All rows, or those of the given dates ('2024-01-30'; '' for rows without a time)."""
        m = self.manifest()
        segments, epochs = m.segments, self._open(m)
        if dates is not None:
            wanted = set(dates)
            segments, epochs = [s for s in segments if s["date"] in wanted], [e for e in epochs if e[1] in wanted]
        df = self._rows(segments, epochs)
        return self.spark.createDataFrame([], schemas.PREDICTIONS) if df is None else df

    def dates(self) -> list[str]:
        """Dates that hold rows, newest first, '' (no time) last."""
        m = self.manifest()
        return sorted({s["date"] for s in m.segments} | {e[1] for e in self._open(m)}, reverse=True)

    def latest(self, k: int = 10, ts: str = "timestamp", tie: Any = ("movieId", "userId"), columns: Sequence[str] | None = None) -> DataFrame:
        """The ``k`` most recent rows, from the newest dates that hold them: other dates are not opened.

        Row counts of segments stand in the manifest; only dates with open epochs are counted
        (from Parquet footers). The search ends at the first date that completes ``k`` rows.
        """
        m = self.manifest()
        open_, chosen, held = self._open(m), [], 0
        for date in sorted({s["date"] for s in m.segments} | {e[1] for e in open_}, reverse=True):
            if held >= k:
                break
            chosen.append(date)
            held += sum(s["rows"] for s in m.segments if s["date"] == date)
            fresh = self._rows([], [e for e in open_ if e[1] == date])
            held += fresh.count() if fresh is not None and held < k else 0
        return D.latest(self.read(chosen), k, ts=ts, tie=tie, columns=columns)

    def since(self, as_of: dt.datetime, hours: int = 24, ts: str = "timestamp") -> DataFrame:
        """Rows of the last ``hours`` hours: only their dates are opened."""
        first = (as_of - dt.timedelta(hours=hours)).date().isoformat()
        return D.last_hours(self.read([d for d in self.dates() if d >= first]), as_of, hours, ts)

    def item_stats(self, item_id: int) -> DataFrame:
        """One item's mean, count, max and min; row groups without the item are skipped."""
        return D.dash_item_stats(self.read(), item_id)

    def user_top(self, user_id: int, k: int = 5, tie: Any = ("movieId",)) -> DataFrame:
        """One user's best ``k`` predictions; row groups without the user are skipped."""
        return D.user_top(self.read(), user_id, k, tie=tie)

    # -- panels -----------------------------------------------------------------------------------

    def _cells(self, m: Manifest, epochs: Iterable[tuple[str, str, str, int]], pieces: Iterable[dict[str, Any]]) -> DataFrame:
        """Cells of these pieces and epochs, a key repeated for each of them."""
        epochs = list(epochs)
        done = {f.rsplit("/", 2)[1] for f in FS.matching(self.spark, f"{self.path}/_panels/epoch=*/_SUCCESS")}
        name = lambda e: f"epoch={e[2]}-{e[3]}"
        folders = [f"{self.path}/_panels/piece={p['piece']}" for p in pieces]
        folders += [f"{self.path}/_panels/{n}" for n in sorted({name(e) for e in epochs} & done)]
        out = self.spark.createDataFrame([], P.SCHEMA)
        for folder in folders:  # few: pieces grow geometrically, open epochs are those since the last fold
            out = out.unionByName(self.spark.read.schema(P.SCHEMA).option("basePath", folder).parquet(folder))
        # A store folded before its stream wrote cells has segments and no piece.
        rows = self._rows([] if m.pieces else m.segments, [e for e in epochs if name(e) not in done])
        return out if rows is None else out.unionByName(P.partials(rows))

    def cells(self) -> DataFrame:
        """The partial aggregates of the whole store."""
        m = self.manifest()
        return self._cells(m, self._open(m), m.pieces)

    def window_cells(self, as_of: dt.datetime, hours: int = 24, cells: DataFrame | None = None) -> DataFrame:
        """Cells of the last ``hours`` hours; of the window's first, partial hour the rows are read."""
        cells = self.cells() if cells is None else cells
        start, full = P.window_edge(as_of, hours)
        days = {start.date().isoformat(), full.date().isoformat()}
        edge = self.read(days).filter((F.col("timestamp") >= D._wall_clock(start)) & (F.col("timestamp") < D._wall_clock(full)))
        return P.in_window(cells, edge, as_of, hours)

    def newest(self) -> dt.datetime | None:
        """The latest time of a row, from the newest date that holds one."""
        for date in self.dates():
            found = D.resolve_as_of(self.read([date]), "timestamp") if date else None
            if found is not None:
                return found
        return None

    def panel_stats(self, approx_users: bool = False) -> DataFrame:
        return P.stats(self.cells(), approx_users)

    def panel_top_items(self, min_count: int = 5, k: int = 10) -> DataFrame:
        return P.top_items(self.cells(), min_count, k)

    def panel_distribution(self) -> DataFrame:
        return P.distribution(self.cells())

    def panel_trends(self, as_of: dt.datetime, hours: int = 24) -> DataFrame:
        return P.trends(self.window_cells(as_of, hours))

    def panel_summary(self, as_of: dt.datetime | None, hours: int = 24, approx_users: bool = False) -> DataFrame:
        cells = self.cells()
        return P.summary(cells, None if as_of is None else self.window_cells(as_of, hours, cells), approx_users)

    # -- folding ----------------------------------------------------------------------------------

    def _closed(self, m: Manifest, checkpoints: Iterable[str]) -> list[tuple[str, str, str, int]]:
        """Open epochs that no restart can write again: older than their query's newest, or committed."""
        open_ = [e for e in self._open(m) if e[2]]
        newest: dict[str, int] = {}
        for _, _, query, number in open_:
            newest[query] = max(number, newest.get(query, -1))
        over = {q: n - 1 for q, n in newest.items()}
        for checkpoint in checkpoints:
            query = FS.read_json(self.spark, f"{checkpoint}/metadata")["id"]
            if query in newest and FS.exists(self.spark, f"{checkpoint}/commits/{newest[query]}"):
                over[query] = newest[query]
        return [e for e in open_ if e[3] <= over[e[2]]]

    def compact(
        self, checkpoints: Iterable[str] = (), fan_in: int = 8, file_bytes: int = FILE_BYTES, row_group_bytes: int = ROW_GROUP_BYTES
    ) -> Manifest | None:
        """Fold every closed epoch; returns the new version, or None if nothing is closed.

        ``checkpoints`` names the checkpoints of streams that have ended or are idle, whose last
        committed epoch may then be folded too.
        """
        m = self.manifest()
        closed = self._closed(m, checkpoints)
        if not closed:
            return None
        held: dict[str, list[dict[str, Any]]] = {}
        for s in m.segments:
            held.setdefault(s["date"], []).append(s)
        merged = [s for date in {e[1] for e in closed} if len(held.get(date, ())) + 1 >= fan_in for s in held[date]]
        rows = self._rows(merged, closed)
        assert rows is not None
        name = f"{m.version + 1:010d}-{uuid.uuid4().hex[:8]}"
        folder = f"{self.path}/_folded/segment={name}"
        sources = [e[0] for e in closed] + [self._segment(s) for s in merged]
        fresh = self._rows([], closed)
        assert fresh is not None
        n = sum(s["rows"] for s in merged) + fresh.count()  # from footers
        files = max(-(-FS.data_size(self.spark, sources) // file_bytes), -(-n // FILE_ROWS))
        write_clustered(rows, folder, files, row_group_bytes=row_group_bytes)
        written = self.spark.read.parquet(folder).groupBy(F.col(DATE).cast("string").alias("date")).count().collect()  # a row a date
        pieces, absorbed = self._fold_cells(m, closed, name, fan_in, file_bytes)
        celled = {f.rsplit("/", 1)[1] for f in FS.matching(self.spark, f"{self.path}/_panels/epoch=*")}
        panels = [f"epoch={q}-{n}" for q, n in sorted({(e[2], e[3]) for e in closed}) if f"epoch={q}-{n}" in celled]
        panels += [f"piece={p['piece']}" for p in absorbed]
        gone_now = [{"folder": p, "at": time.time()} for p in sources + [f"{self.path}/_panels/{p}" for p in panels]]
        folded = dict(m.folded)
        for _, _, query, number in closed:
            folded[query] = max(number, folded.get(query, -1))
        dropped = {(s["segment"], s["date"]) for s in merged}
        segments = [s for s in m.segments if (s["segment"], s["date"]) not in dropped]
        segments += [{"segment": name, "date": r["date"] or "", "rows": r["count"]} for r in sorted(written, key=lambda r: r["date"] or "")]
        return self._publish(Manifest(m.version, segments, folded, m.gone + gone_now, [p for p in m.pieces if p not in absorbed] + pieces))

    def _fold_cells(
        self, m: Manifest, closed: list[tuple[str, str, str, int]], name: str, fan_in: int, file_bytes: int
    ) -> tuple[list[dict[str, Any]], list[dict[str, Any]]]:
        """Write one piece with the cells of the closed epochs and of recent pieces that are not much larger.

        A store whose stream writes no cells gets none.
        """
        if not m.pieces and not FS.matching(self.spark, f"{self.path}/_panels/epoch=*/_SUCCESS"):
            return [], []
        fresh = P.merged(self._cells(m, closed, []))
        grown, absorbed = self._cells(m, closed, []).count(), []  # from footers where cells are written; not merged, so a bound
        for piece in reversed(m.pieces):
            if piece["rows"] > fan_in * grown:
                break
            absorbed.append(piece)
            grown += piece["rows"]
        folder = f"{self.path}/_panels/piece={name}"
        cells = P.merged(self._cells(m, closed, absorbed)) if absorbed else fresh
        P.write(cells, folder, max(-(-grown * CELL_BYTES // file_bytes), -(-grown // FILE_ROWS)))
        rows = self.spark.read.schema(P.SCHEMA).parquet(folder).count()
        return [{"piece": name, "rows": rows}], absorbed

    def vacuum(self, grace_seconds: float = GRACE_SECONDS) -> int:
        """Delete folders folded longer than ``grace_seconds`` ago; returns how many."""
        m = self.manifest()
        old = [g for g in m.gone if g["at"] <= time.time() - grace_seconds]
        # A replay may have written a folded epoch's folder again: it never counts, so it goes as well.
        again = [e for e in self._epochs() if grace_seconds <= 0 and e[3] <= m.folded.get(e[2], -1)]
        cells = {f"{self.path}/_panels/epoch={e[2]}-{e[3]}" for e in again}
        folders = {e[0] for e in again} | {c for c in cells if FS.exists(self.spark, c)}
        old += [{"folder": f} for f in sorted(folders - {g["folder"] for g in old})]
        if old:
            FS.delete(self.spark, [g["folder"] for g in old])
            dead = {g["folder"] for g in old}
            self._publish(Manifest(m.version, m.segments, m.folded, [g for g in m.gone if g["folder"] not in dead], m.pieces))
        FS.delete(self.spark, FS.matching(self.spark, f"{self.path}/_manifest/[0-9]*.json")[:-KEPT_VERSIONS])
        return len(old)
