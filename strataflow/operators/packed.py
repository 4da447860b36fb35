"""Bootstrap draws and their metrics with all replicates of a row packed together.

The draws are those of ``bootstrap.resample_counts``, but no row is multiplied. Rows of a
stratum in order of their hash fall into cells of about ``CELL`` places; place k makes one
draw per replicate, known without its row, and draws travel to their cell as packed numbers.
There they become one count per row and replicate. Counted rows go on as packed points to a
cell of scores, and a cell of scores gives its share of every metric, for all replicates.
Binned calibration asks the cells twice more: for the scores at the ranks of the edges of
quantile bins, then for their sums in every bin.

Rows that leave a task: one per stratum and cell, whatever the number of replicates. The
driver holds one number per cell of places (one in ``CELL`` / 2 rows, at most 2 ** ``BITS`` per
stratum), which closures and one broadcast row per stratum carry. One cell is held in one task.

Where no stratum has over ``WHOLE`` rows, and rows are evaluated within the strata they are
drawn in, no draw travels at all: a task takes the rows of one stratum and makes the draws of
``BLOCK`` replicates itself, one replicate after the other. Draws and results are the same.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.functions.hashing import hash_key, hash_slice
from strataflow.functions.scalar import CLIP
from strataflow.operators.metrics import AUC_UNDEFINED, ECE_METRICS, LOSS_UNDEFINED
from strataflow.operators.running import ALL, quoted
from strataflow.session import cut_lineage

BOOT = "boot_iter"
# largest prime below 2**45; the number of a replicate is multiplied in two parts of
# 17 bits, so that no product reaches 2**63
PRIME = 35184372088777
PART = 2**17
#: Most places of a cell, and leading bits of the hash that tell cells apart.
CELL, BITS = 32768, 14
#: Numbers held at once by one step.
HELD = 1 << 20
#: Replicates whose sums travel together.
GROUP = 64
#: Most rows of a stratum that one task holds, and replicates it makes of them; the rows travel once per block.
WHOLE, BLOCK = 1 << 23, 250
#: Places whose draws are made at once.
STEP = 1 << 15
METRICS = ("auc", "auprc", "loss_bce", "brier", "mean_prediction")
_SUMS = ("n1", "n0", "auc", "loss_bce", "brier", "mean_prediction")


def supported(metrics: Sequence[str]) -> bool:
    return set(metrics) <= {*METRICS, *ECE_METRICS} and ("auc" in metrics or "auprc" in metrics)


def _binary(data: bytes, bounds: np.ndarray) -> pa.Array:
    """Consecutive slices of ``data`` as one binary column."""
    offsets = pa.py_buffer(np.ascontiguousarray(bounds, np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(data)])


def _table(names: Sequence[str], ints: Sequence, payload: pa.Array) -> pa.Table:
    n = len(payload)
    arrays = [pa.array(np.ascontiguousarray(np.broadcast_to(x, n), np.int32)) for x in ints]
    return pa.table([*arrays, payload], names=list(names))


def _runs(keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal neighbours, and the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


class Cells:
    """Strata of a frame with the first place of each of their cells."""

    def __init__(self, df: DataFrame, strata: Sequence[str], ids: Sequence[str], seed: int):
        self.strata, self.keys = list(strata), list(strata) or [ALL]
        rows = df if strata else df.withColumn(ALL, F.lit(0))
        rows = rows.where(" AND ".join(f"{quoted(s)} IS NOT NULL" for s in self.keys))
        self.rows = rows.withColumn("__d", F.expr(hash_key(seed, *map(quoted, ids))))
        self.seed, k = seed, ", ".join(map(quoted, self.keys))
        leading = f"shiftright(CAST({hash_slice('__d', 1, 4)} AS INT), {16 - BITS})"
        fine = self.rows.groupBy(*map(quoted, self.keys), F.expr(leading).alias("__fine")).agg(F.count("*").alias("__m"))
        sized = fine.selectExpr("*", f"sum(__m) OVER (PARTITION BY {k}) AS __n")
        sized = sized.selectExpr("*", f"CAST(least({BITS}, greatest(0, ceil(log2(__n / {CELL}D)))) AS INT) AS __k")
        cells = sized.groupBy(
            *map(quoted, self.keys), "__n", "__k", F.expr(f"shiftright(__fine, {BITS} - __k)").alias("__cell")
        ).agg(F.sum("__m").alias("__m"))
        found: dict = {}
        for row in cells.collect():
            key = tuple(row)[: len(self.keys)]
            found.setdefault((*key, row["__n"], row["__k"]), []).append((row["__cell"], row["__m"]))
        self.names, self.offsets = sorted(found, key=repr), []
        for name in self.names:
            held = np.zeros((1 << name[-1]) + 1, np.int64)
            for cell, m in found[name]:
                held[cell + 1] = m
            self.offsets.append(np.cumsum(held))
        fields = ", ".join([*[f"{quoted(f)} {rows.schema[f].dataType.simpleString()}" for f in self.keys], "__n long, __k int, __s int"])
        self.table = df.sparkSession.createDataFrame([(*name, s) for s, name in enumerate(self.names)], fields)

    @property
    def most(self) -> int:
        return max((int(o[-1]) for o in self.offsets), default=0)

    def placed(self, columns: Sequence[str]) -> DataFrame:
        """Rows with the number of their stratum, their cell and 120 bits of their hash."""
        leading = f"shiftright(CAST({hash_slice('__d', 1, 4)} AS INT), {16 - BITS} + {BITS} - __k)"
        return self.rows.join(F.broadcast(self.table), self.keys).selectExpr(
            "__s AS s", f"{leading} AS cell", f"{hash_slice('__d', 1, 15)} AS h1", f"{hash_slice('__d', 16, 15)} AS h2", *columns
        )

    def draws(self, n_boot: int, first: int) -> DataFrame:
        """All draws: stratum, cell and packed (place in the cell, replicate)."""
        tasks = int(self.table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        digest = hash_key(self.seed, "'draw'", *map(quoted, self.strata), "rank0")
        starts = self.table.selectExpr("*", f"explode(sequence(0L, __n - 1, {CELL}L)) AS start").repartition(tasks, "__s", "start")
        places = starts.selectExpr("*", f"explode(sequence(start, least(start + {CELL}, __n) - 1)) AS rank0")
        hashed = places.withColumn("__d", F.expr(digest)).selectExpr(
            "__s", f"{hash_slice('__d', 1)} % {PRIME}L AS h1", f"{hash_slice('__d', 13)} % {PRIME}L AS h2"
        )
        offsets, code = self.offsets, self.code(n_boot)
        replicates = np.arange(first, first + n_boot, dtype=np.int64)
        low, high = replicates % PART, replicates // PART

        def pack(batches):
            step = max(1, HELD // n_boot)
            for batch in batches:
                s, h1, h2 = (batch.column(i).to_numpy() for i in range(3))
                runs = _runs(s)
                for a, b in zip(runs, runs[1:]):
                    begins = offsets[s[a]]
                    for i in range(a, b, step):
                        x, y = h1[i : min(i + step, b), None], h2[i : min(i + step, b), None]
                        place = ((x + low * y + high * y % PRIME * PART) % PRIME % begins[-1]).ravel()
                        cell = np.searchsorted(begins, place, "right") - 1
                        packed = (place - begins[cell]) * n_boot + np.tile(np.arange(n_boot), len(x))
                        order = np.argsort(cell, kind="stable")
                        cell, packed = cell[order], packed[order].astype(code)
                        at = _runs(cell)
                        made = _table(("s", "cell", "draws"), (s[a], cell[at[:-1]]), _binary(packed.tobytes(), at * packed.itemsize))
                        yield from made.to_batches()

        return hashed.mapInArrow(pack, "s int, cell int, draws binary")

    def code(self, n_boot: int) -> str:
        largest = max((int(np.diff(o).max()) for o in self.offsets), default=0)
        return "<u4" if largest * n_boot < 2**32 else "<u8"


def _counts(rows: pa.Table, draws: pa.Table, code: str, n_boot: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of a cell's rows by their hash, and how often each is drawn."""
    order = np.lexsort((rows["h2"].to_numpy(), rows["h1"].to_numpy()))
    size = len(order) * n_boot
    packed = np.frombuffer(b"".join(draws["draws"].to_pylist()), code)
    return order, np.bincount(packed.astype(np.int64), minlength=size).reshape(len(order), n_boot)


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values as doubles, 0 where NULL; and which are NULL."""
    null = column.is_null().to_numpy()
    return column.fill_null(0).to_numpy().astype(np.float64), null


def score_cells(p: np.ndarray, bits: int) -> np.ndarray:
    """Ordered cell of a score, fine near 0 and near 1, by whole numbers alone: any machine gives the same."""
    shift = np.int64(52 - bits)

    def place(x):
        i = x.view(np.int64)
        return np.where(i < 0, -(i & np.int64(2**63 - 1)), i) >> shift

    return place(p) - place((1.0 - p) + 0.0)


def _points(p: np.ndarray, positive: np.ndarray, counts: np.ndarray, bits: int):
    """Packed points by score cell: ``cell`` and ``points``. Points of one score and label become one."""
    p = p + 0.0
    order = np.lexsort((positive, p))
    p, positive = p[order], positive[order]
    at = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (positive[1:] != positive[:-1])])) if len(p) else order
    counts = np.add.reduceat(counts[order], at, axis=0) if len(at) else counts[:0]
    keep = counts.any(axis=1)
    p, positive, counts = p[at][keep], positive[at][keep], counts[keep]
    parts = []
    while len(p):
        rec = np.empty(len(p), _record(counts.shape[1]))
        rec["p"], rec["y"], rec["w"] = p, positive, np.minimum(counts, 255)
        parts.append(rec)
        # a count over one byte goes on in a further point
        more = (counts > 255).any(axis=1)
        p, positive, counts = p[more], positive[more], np.maximum(counts[more] - 255, 0)
    for rec in parts:
        cells = score_cells(np.ascontiguousarray(rec["p"]), bits)
        at = _runs(cells)
        yield cells[at[:-1]], _binary(rec.tobytes(), at * rec.itemsize)


def _record(n_boot: int) -> np.dtype:
    return np.dtype([("p", "<f8"), ("y", "u1"), ("w", "u1", (n_boot,))])


_POINTS = "s int, side int, part int, cell long, points binary"


def _point_table(s: int, side: int, part: int, cells: np.ndarray, points: pa.Array) -> pa.Table:
    made = _table(("s", "side", "part", "points"), (s, side, part), points)
    return made.add_column(3, "cell", pa.array(np.ascontiguousarray(cells, np.int64)))


def _whole(tables: list[pa.Table], schema: pa.Schema) -> pa.Table:
    return pa.concat_tables(tables) if tables else schema.empty_table()


_POINT_SCHEMA = pa.schema([("s", pa.int32()), ("side", pa.int32()), ("part", pa.int32()), ("cell", pa.int64()), ("points", pa.binary())])
_SUM_FIELDS = [
    ("s", pa.int32()), ("side", pa.int32()), ("part", pa.int32()), ("cell", pa.int64()),
    ("sums", pa.binary()), ("curve", pa.binary()), ("ends", pa.binary()), ("points", pa.binary()),
]


def _bits(most: int, n_boot: int) -> int:
    """Score cells per doubling, as a power of two, for cells of bounded size."""
    target = min(CELL, max(1024, (1 << 18) // n_boot))
    return int(np.clip(np.ceil(np.log2(max(most, 1) / (8 * target))), -11, 14))


def _cell_sums(n_boot: int, curve: bool, binned: bool):
    """A score cell's own sums per replicate; its curve are the counts at each of its scores.

    What is ``binned`` later needs the number, least and largest score of a replicate, and the points.
    """

    def run(key, rows):
        s, side, part, cell = (k.as_py() for k in key)
        rec = np.frombuffer(b"".join(rows["points"].to_pylist()), _record(n_boot))
        rec = rec[np.argsort(rec["p"], kind="stable")]
        at = _runs(rec["p"])[:-1]
        p, y = np.ascontiguousarray(rec["p"][at]), rec["y"].astype(bool)
        near = np.clip(p, CLIP, 1 - CLIP)
        out = []
        for group, a in enumerate(range(0, n_boot, GROUP)):
            w = rec["w"][:, a : a + GROUP].astype(np.float64)
            pos = np.add.reduceat(w * y[:, None], at, axis=0)
            neg = np.add.reduceat(w, at, axis=0) - pos
            ahead = np.cumsum(neg, axis=0) - neg
            sums = np.stack([
                pos.sum(0), neg.sum(0), (pos * (ahead + neg / 2)).sum(0),
                -(np.log(near) @ pos + np.log(1 - near) @ neg),
                ((1 - p) ** 2) @ pos + (p * p) @ neg,
                p @ (pos + neg),
            ])
            held = np.stack([pos, neg]).astype("<u4").tobytes() if curve else b""
            ends = points = b""
            if binned:
                drawn = pos + neg
                low, high = (np.where(drawn > 0, p[:, None], x) for x in (np.inf, -np.inf))
                ends = np.stack([drawn.sum(0), low.min(0), high.max(0)]).tobytes()
                own = np.empty(len(rec), _record(w.shape[1]))
                own["p"], own["y"], own["w"] = rec["p"], rec["y"], rec["w"][:, a : a + GROUP]
                points = own[own["w"].any(axis=1)].tobytes()
            out.append((s, side, part if n_boot == 1 else group, cell, sums.tobytes(), held, ends, points))
        return pa.table([pa.array(c, t) for c, (_, t) in zip(zip(*out), _SUM_FIELDS)], names=[n for n, _ in _SUM_FIELDS])

    return run


def _stacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the cells of one stratum in order: cells x sums x replicates."""
    order = np.argsort(rows["cell"].to_numpy(), kind="stable")
    held = rows["sums"].to_pylist()
    return order, np.stack([np.frombuffer(held[i]).reshape(len(_SUMS), -1) for i in order])


def _finished(rows: DataFrame, n_boot: int, first: int) -> DataFrame:
    """Sums of all cells; a cell learns here how many negatives lie before it."""

    def run(key, held):
        s, side, part = (k.as_py() for k in key)
        _, sums = _stacked(held)
        before = np.cumsum(sums[:, 1], axis=0) - sums[:, 1]
        sums[:, 2] += sums[:, 0] * before
        total = sums.sum(0)
        replicates = first + (part if n_boot == 1 else part * GROUP) + np.arange(total.shape[1])
        there = total[0] + total[1] > 0
        n = int(there.sum())
        ints = [pa.array(np.broadcast_to(np.int32(x), n)) for x in (s, side)]
        return pa.table([*ints, pa.array(replicates[there].astype(np.int32)), *[pa.array(x[there]) for x in total]],
                        names=["s", "side", BOOT, *_SUMS])

    schema = f"s int, side int, {BOOT} int, " + ", ".join(f"{c} double" for c in _SUMS)
    return rows.select("s", "side", "part", "cell", "sums").groupBy("s", "side", "part").applyInArrow(run, schema)


def _precision(cells: DataFrame, n_boot: int, first: int) -> DataFrame:
    """Average precision from the curves: recall steps times precision, from above."""

    def before(key, held):
        order, sums = _stacked(held)
        counts = sums[:, :2]
        total = counts.sum(0)
        above = total - (np.cumsum(counts, axis=0) - counts)
        packed = [np.stack([total, a]).tobytes() for a in above]
        return held.select(["s", "side", "part", "cell"]).take(pa.array(order)).append_column("above", pa.array(packed, pa.binary()))

    def share(key, cell, known):
        s, side, part, _ = (k.as_py() for k in key)
        total, above = np.frombuffer(known["above"][0].as_py()).reshape(2, 2, -1)
        pos, neg = np.frombuffer(cell["curve"][0].as_py(), "<u4").reshape(2, -1, total.shape[1]).astype(np.float64)
        true = above[0] - (np.cumsum(pos, axis=0) - pos)
        false = above[1] - (np.cumsum(neg, axis=0) - neg)
        value = (pos / np.maximum(total[0], 1) * true / np.maximum(true + false, 1)).sum(0)
        replicates = first + (part if n_boot == 1 else part * GROUP) + np.arange(len(value))
        ints = [pa.array(np.broadcast_to(np.int32(x), len(value))) for x in (s, side)]
        return pa.table([*ints, pa.array(replicates.astype(np.int32)), pa.array(value)], names=["s", "side", BOOT, "auprc"])

    place = ["s", "side", "part", "cell"]
    known = cells.select(*place, "sums").groupBy("s", "side", "part").applyInArrow(
        before, "s int, side int, part int, cell long, above binary"
    )
    shares = cells.select(*place, "curve").groupBy(*place).cogroup(known.groupBy(*place)).applyInArrow(
        share, f"s int, side int, {BOOT} int, auprc double"
    )
    return shares.groupBy("s", "side", BOOT).agg(F.sum("auprc").alias("auprc"))


#: Bins of calibration errors; quantiles are those at the ends of the bins.
BINS = 10
_PLACE = ["s", "side", "part"]
_EDGES = "s int, side int, part int, edges binary"


def _located(cells: DataFrame) -> DataFrame:
    """Cells that hold a rank next to a quantile, with the rows before them and the totals of their stratum.

    The first cell of a stratum is always there, so that every stratum is.
    """

    def run(key, held):
        order = np.argsort(held["cell"].to_numpy(), kind="stable")
        packed = held["ends"].to_pylist()
        ends = np.stack([np.frombuffer(packed[i]).reshape(3, -1) for i in order])
        n, total = ends[:, 0], ends[:, 0].sum(0)
        before = np.cumsum(n, axis=0) - n
        wanted = _ranks(total).reshape(-1, len(total))
        here = [i == 0 or bool(((wanted >= b) & (wanted < b + m)).any()) for i, (b, m) in enumerate(zip(before, n))]
        low, high = ends[:, 1].min(0), ends[:, 2].max(0)
        known = [np.stack([b, total, low, high]).tobytes() for b, there in zip(before, here) if there]
        rows = held.select([*_PLACE, "cell"]).take(pa.array(order[here]))
        return rows.append_column("known", pa.array(known, pa.binary()))

    return cells.select(*_PLACE, "cell", "ends").groupBy(*_PLACE).applyInArrow(
        run, "s int, side int, part int, cell long, known binary"
    )


def _ranks(total: np.ndarray) -> np.ndarray:
    """Ranks below and above each quantile: 2 x quantiles x replicates."""
    at = (total - 1) * (np.arange(BINS + 1) / BINS)[:, None]
    return np.stack([np.floor(at), np.ceil(at)])


def _bin_edges(cells: DataFrame) -> DataFrame:
    """Inner edges of the bins of each replicate, of equal width and between quantiles.

    Quantile edges are not numbers where two of all edges coincide.
    """

    def find(batches):
        for batch in batches:
            out = []
            for known, points in zip(batch.column("known").to_pylist(), batch.column("points").to_pylist()):
                before, total, low, high = np.frombuffer(known).reshape(4, -1)
                rec = np.frombuffer(points, _record(len(total)))
                upto = before + np.cumsum(rec["w"], axis=0, dtype=np.float64)
                wanted, found = _ranks(total), np.full((2, BINS + 1, len(total)), np.nan)
                for b in range(len(total)):
                    at = np.searchsorted(upto[:, b], wanted[..., b], "right")
                    here = (wanted[..., b] >= before[b]) & (at < len(rec))
                    found[..., b][here] = rec["p"][at[here]]
                out.append(np.concatenate([[total, low, high], found.reshape(-1, len(total))]).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], [*_PLACE, "edges"])

    def join(key, held):
        packed = held["edges"].to_pylist()
        each = np.stack([np.frombuffer(x).reshape(2 * BINS + 5, -1) for x in packed])
        total, low, high = each[0, :3]
        below, above = np.fmax.reduce(each[:, 3:], axis=0).reshape(2, BINS + 1, -1)
        at = (total - 1) * (np.arange(BINS + 1) / BINS)[:, None]
        q = below + (above - below) * (at - np.floor(at))
        q[:, (np.diff(q, axis=0) == 0).any(axis=0)] = np.nan
        with np.errstate(invalid="ignore"):
            width = low + (high - low) / BINS * np.arange(1, BINS)[:, None]
        edges = np.stack([width, q[1:-1]]).tobytes()
        return pa.table([*held.slice(0, 1).select(_PLACE).columns, pa.array([edges], pa.binary())], names=[*_PLACE, "edges"])

    known = _located(cells).join(cells.select(*_PLACE, "cell", "points"), [*_PLACE, "cell"])
    found = known.select(*_PLACE, "known", "points").mapInArrow(find, _EDGES)
    return found.groupBy(*_PLACE).applyInArrow(join, _EDGES)


def _calibration(cells: DataFrame, names: Sequence[str], n_boot: int, first: int) -> DataFrame:
    """The named binned calibration errors per stratum, side and replicate."""

    def add(batches):
        totals: dict = {}
        for batch in batches:
            for *key, edges, points in zip(*(c.to_pylist() for c in batch.columns)):
                edges = np.frombuffer(edges).reshape(2, BINS - 1, -1)
                n = edges.shape[2]
                rec = np.frombuffer(points, _record(n))
                p, w = rec["p"][:, None], rec["w"].astype(np.float64)
                terms, sums = (w, w * p, w * rec["y"][:, None]), np.empty((2, 3, BINS * n))
                for kind in (0, 1):
                    place = np.zeros(w.shape, np.int64)
                    for edge in edges[kind]:
                        place += p > edge
                    place = (place * n + np.arange(n)).ravel()
                    for i, term in enumerate(terms):
                        sums[kind, i] = np.bincount(place, term.ravel(), BINS * n)
                sums = sums.reshape(2, 3, BINS, n)
                sums[1, :, :, np.isnan(edges[1]).any(axis=0)] = np.nan
                key = tuple(key)
                totals[key] = totals[key] + sums if key in totals else sums
        # one row per stratum and task, however many cells the task had
        for (s, side, part), sums in totals.items():
            yield _table(_PLACE + ["edges"], (s, side, part), pa.array([sums.tobytes()], pa.binary())).to_batches()[0]

    def finish(key, held):
        s, side, part = (k.as_py() for k in key)
        w, p, y = np.moveaxis(sum(np.frombuffer(x) for x in held["edges"].to_pylist()).reshape(2, 3, BINS, -1), 1, 0)
        n = w[0].sum(0)
        off = (p - y) / np.where(w == 0, 1, w)
        out = []
        for name in names:
            variant, quantile = ECE_METRICS[name]
            d = off[int(quantile)]
            error = {"abs": np.abs(d), "signed": d}.get(variant, d * d)
            value = (w[int(quantile)] * error).sum(0) / np.maximum(n, 1)
            value = np.sqrt(value) if variant == "rmse" else value
            out.append(pa.array(value[n > 0], mask=np.isnan(value[n > 0])))
        replicates = first + (part if n_boot == 1 else part * GROUP) + np.flatnonzero(n > 0)
        ints = [pa.array(np.broadcast_to(np.int32(x), len(replicates))) for x in (s, side)]
        return pa.table([*ints, pa.array(replicates.astype(np.int32)), *out], names=["s", "side", BOOT, *names])

    placed = cells.select(*_PLACE, "points").join(_bin_edges(cells), _PLACE).select(*_PLACE, "edges", "points")
    schema = f"s int, side int, {BOOT} int, " + ", ".join(f"{m} double" for m in names)
    return placed.mapInArrow(add, _EDGES).groupBy(*_PLACE).applyInArrow(finish, schema)


def _draw_hashes(name: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Both numbers of all places of a stratum, as ``hash_key`` and ``hash_slice`` make them of its name."""
    h1, h2 = np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(0, n, STEP):
        b = min(a + STEP, n)
        digests = np.frombuffer(b"".join([md5(b"%b|%d" % (name, k)).digest() for k in range(a, b)]), np.uint8).reshape(-1, 16)
        for h, at in ((h1, 0), (h2, 6)):
            wide = np.zeros((b - a, 8), np.uint8)
            wide[:, 2:] = digests[:, at : at + 6]
            h[a:b] = wide.view(">u8")[:, 0].astype(np.int64) % PRIME
    return h1, h2


def _drawn(h1: np.ndarray, h2: np.ndarray, first: int, n_boot: int):
    """How often each place is drawn, for one replicate after the other."""
    n = len(h1)
    at = (h1 + first % PART * h2 + first // PART * h2 % PRIME * PART) % PRIME
    place = np.empty(n, np.int64)
    for left in range(n_boot, 0, -1):
        for a in range(0, n, STEP):
            x, out = at[a : a + STEP], place[a : a + STEP]
            np.floor_divide(x, n, out=out)
            out *= -n
            out += x
            # the next replicate's number is this one and the second hash, below the prime
            x += h2[a : a + STEP]
            x -= (x >= PRIME) * np.int64(PRIME)
        # rows are looked up in the order of their scores, which small numbers make fast
        counts = np.bincount(place, minlength=n)
        yield counts.astype(np.min_scalar_type(counts.max()))


class Side:
    """Rows of a stratum under one score, in the order of that score, ready to be counted."""

    def __init__(self, p: np.ndarray, positive: np.ndarray, known: np.ndarray, metrics: Sequence[str]):
        p = p + 0.0
        order = np.flatnonzero(known)
        order = order[np.argsort(p[order], kind="stable")]
        is_one = positive[order]
        self.ones, self.zeros = order[is_one], order[~is_one]
        p1, p0 = p[self.ones], p[self.zeros]
        # positives of one score are one: the negatives below it, and up to it
        self.starts = _runs(p1)[:-1]
        each = p1[self.starts]
        self.single = len(each) == len(p1)
        self.below, self.upto = np.searchsorted(p0, each, "left"), np.searchsorted(p0, each, "right")
        self.curve = "auprc" in metrics
        near1, near0 = np.clip(p1, CLIP, 1 - CLIP), np.clip(p0, CLIP, 1 - CLIP)
        rows = {
            "loss_bce": (-np.log(near1), -np.log(1 - near0)),
            "brier": ((1 - p1) ** 2, p0 * p0),
            "mean_prediction": (p1, p0),
        }
        self.rows = {m: x for m, x in rows.items() if m in metrics}

    def sums(self, counts: np.ndarray) -> tuple[list[float], float]:
        """The sums of ``_SUMS`` of one replicate, and its average precision."""
        ones, zeros = (counts[i].astype(np.float64) for i in (self.ones, self.zeros))
        ahead = np.concatenate([[0.0], np.cumsum(zeros)])
        each = ones if self.single or not len(ones) else np.add.reduceat(ones, self.starts)
        below, n1, n0 = ahead[self.below], float(ones.sum()), float(ahead[-1])
        found = [n1, n0, float(each @ (below + ahead[self.upto])) / 2]
        found += [float(ones @ self.rows[m][0] + zeros @ self.rows[m][1]) if m in self.rows else 0.0 for m in _SUMS[3:]]
        precision = 0.0
        if self.curve and n1 > 0:
            true = n1 - (np.cumsum(each) - each)
            precision = float((each / n1 * true / np.maximum(true + n0 - below, 1)).sum())
        return found, precision


def _row_record(n_sides: int) -> np.dtype:
    return np.dtype([("h", "<i8", (2,)), ("p", "<f8", (n_sides,)), ("y", "u1", (n_sides,)), ("known", "u1", (n_sides,))])


def _in_whole_strata(
    rows: DataFrame, names: Sequence[str], n_sides: int, n_boot: int, metrics: Sequence[str], first: int
) -> DataFrame:
    """Sums per stratum, side and replicate of rows ``s, h1, h2, p0, y0, ...``; ``names`` are the strata in hashes."""
    record, blocks = _row_record(n_sides), -(-n_boot // BLOCK)

    def pack(batches):
        for batch in batches:
            columns = pa.Table.from_batches([batch])
            s = columns["s"].to_numpy()
            order = np.argsort(s, kind="stable")
            rec = np.empty(len(s), record)
            for i in (0, 1):
                rec["h"][:, i] = columns[f"h{i + 1}"].to_numpy()
            for i in range(n_sides):
                (p, no_p), (y, no_y) = _numbers(columns[f"p{i}"]), _numbers(columns[f"y{i}"])
                rec["p"][:, i], rec["y"][:, i], rec["known"][:, i] = p, y == 1, ~(no_p | no_y | np.isnan(p))
            rec, s = rec[order], s[order]
            at = _runs(s)
            held = _binary(rec.tobytes(), at * record.itemsize)
            yield pa.RecordBatch.from_arrays([pa.array(s[at[:-1]], pa.int32()), held], ["s", "rows"])

    def run(key, held):
        s, block = (k.as_py() for k in key)
        rec = np.concatenate([np.frombuffer(x.as_buffer(), record) for x in held["rows"]])
        del held
        rec = rec[np.lexsort((rec["h"][:, 1], rec["h"][:, 0]))]
        sides = [Side(rec["p"][:, i], rec["y"][:, i] == 1, rec["known"][:, i] == 1, metrics) for i in range(n_sides)]
        n, start = len(rec), block * BLOCK
        del rec
        out = []
        drawn = _drawn(*_draw_hashes(names[s].encode(), n), first + start, min(BLOCK, n_boot - start))
        for replicate, counts in enumerate(drawn, first + start):
            for i, side in enumerate(sides):
                sums, precision = side.sums(counts)
                if sums[0] + sums[1] > 0:
                    out.append((s, i, replicate, *sums, precision))
        columns = [pa.array(c, t.type) for c, t in zip(zip(*out) if out else [[]] * len(fields), fields)]
        return pa.Table.from_arrays(columns, schema=pa.schema(fields))

    fields = [pa.field(c, pa.int32()) for c in ("s", "side", BOOT)] + [pa.field(c, pa.float64()) for c in (*_SUMS, "auprc")]
    schema = f"s int, side int, {BOOT} int, " + ", ".join(f"{c} double" for c in (*_SUMS, "auprc"))
    packed = rows.mapInArrow(pack, "s int, rows binary")
    spread = packed.selectExpr("s", f"explode(sequence(0, {blocks - 1})) AS block", "rows")
    # few groups of much work: more partitions than groups, so that few partitions have several
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(tasks, min(4 * len(names) * blocks, 1024))
    return spread.repartition(parts, "s", "block").groupBy("s", "block").applyInArrow(run, schema)


class Strata:
    """Strata of a frame with their rows and what stands for them in the hashes of draws."""

    def __init__(self, df: DataFrame, strata: Sequence[str], ids: Sequence[str], seed: int):
        self.strata, self.keys = list(strata), list(strata) or [ALL]
        rows = df if strata else df.withColumn(ALL, F.lit(0))
        rows = rows.where(" AND ".join(f"{quoted(s)} IS NOT NULL" for s in self.keys))
        name = f"concat_ws('|', {', '.join([repr(str(seed)), repr('draw'), *map(quoted, self.strata)])}) AS __name"
        sized = rows.groupBy(*map(quoted, self.keys)).agg(F.count("*").alias("__n"))
        found = sorted(sized.selectExpr("*", name).collect(), key=repr)
        self.sizes = [r["__n"] for r in found]
        self.names = [r["__name"] for r in found]
        fields = ", ".join([*[f"{quoted(f)} {rows.schema[f].dataType.simpleString()}" for f in self.keys], "__s int"])
        keyed = [(*[r[k] for k in self.keys], s) for s, r in enumerate(found)]
        self.table = df.sparkSession.createDataFrame(keyed, fields)
        self.rows = rows.withColumn("__d", F.expr(hash_key(seed, *map(quoted, ids))))

    def numbered(self, columns: Sequence[str]) -> DataFrame:
        """Rows with the number of their stratum and 120 bits of their hash."""
        return self.rows.join(F.broadcast(self.table), self.keys).selectExpr(
            "__s AS s", f"{hash_slice('__d', 1, 15)} AS h1", f"{hash_slice('__d', 16, 15)} AS h2", *columns
        )


def _measured(
    points: DataFrame, named: DataFrame, strata: Sequence[str], sides: Sequence[str], metrics: Sequence[str],
    most: int, n_boot: int, first: int
) -> DataFrame:
    curve, binned = "auprc" in metrics, [m for m in metrics if m in ECE_METRICS]
    schema = "s int, side int, part int, cell long, sums binary, curve binary, ends binary, points binary"
    cells = points.groupBy("s", "side", "part", "cell").applyInArrow(_cell_sums(n_boot, curve, bool(binned)), schema)
    if curve or binned:
        cells = cut_lineage(cells)
    total = _finished(cells, n_boot, first)
    if curve:
        total = total.join(_precision(cells, n_boot, first), ["s", "side", BOOT])
    if binned:
        total = total.join(_calibration(cells, binned, n_boot, first), ["s", "side", BOOT])
    return _valued(total, named, strata, sides, metrics)


def _valued(
    total: DataFrame, named: DataFrame, strata: Sequence[str], sides: Sequence[str], metrics: Sequence[str]
) -> DataFrame:
    """Metrics of the sums of strata, sides and replicates."""
    values = {
        "auc": f"coalesce(try_divide(auc, n1 * n0), {AUC_UNDEFINED!r}D)",
        "auprc": "IF(n1 > 0, auprc, NULL)",
        "loss_bce": f"IF(n1 = 0 OR n0 = 0, {LOSS_UNDEFINED!r}D, loss_bce / (n1 + n0))",
        "brier": "brier / (n1 + n0)",
        "mean_prediction": "mean_prediction / (n1 + n0)",
        **{m: m for m in metrics if m in ECE_METRICS},
    }
    stacked = ", ".join(f"'{m}', {values[m]}" for m in metrics)
    side = [f"element_at(array({', '.join(map(repr, sides))}), side + 1) AS side"] if len(sides) > 1 else []
    wide = total.join(F.broadcast(named), "s")
    return wide.selectExpr(
        f"stack({len(metrics)}, {stacked}) AS (metric, performance)", *side, BOOT, *map(quoted, strata)
    ).select("metric", *(["side"] if side else []), BOOT, *strata, "performance")


def _evaluated_strata(cells: Cells, strata: Sequence[str]):
    """Numbers of the strata that are evaluated, for the number of each stratum of the draws."""
    places = [cells.keys.index(s) for s in strata]
    names: dict = {}
    of = [names.setdefault(tuple(name[i] for i in places), len(names)) for name in cells.names]
    fields = ", ".join([*[f"{quoted(s)} {cells.rows.schema[s].dataType.simpleString()}" for s in strata], "s int"])
    named = cells.table.sparkSession.createDataFrame([(*k, i) for k, i in names.items()], fields)
    sizes = np.zeros(max(len(names), 1), np.int64)
    for i, offsets in zip(of, cells.offsets):
        sizes[i] += offsets[-1]
    return of, named, sizes


def replicated(
    df: DataFrame,
    within: Sequence[str],
    strata: Sequence[str],
    ids: Sequence[str],
    n_boot: int,
    metrics: Sequence[str],
    seed: int = 44,
    first: int = 1,
    sides: Mapping[str, tuple[str, str]] | None = None,
    ensemble: bool = False,
) -> DataFrame:
    """Metrics per replicate and stratum of rows drawn ``within`` strata: ``metric, [side], boot_iter, strata, performance``.

    ``sides`` names pairs of score and label, all on the same draws. An ``ensemble`` takes,
    per id and replicate, the mean of what was drawn of it, and evaluates these means.
    """
    sides = sides or {"": ("pred_probs", "labels")}
    n_sides = len(sides)
    label = "CAST(CAST({} AS INT) AS DOUBLE)" if not ensemble else "CAST({} AS DOUBLE)"
    columns = [
        e for i, (p, y) in enumerate(sides.values())
        for e in (f"CAST({quoted(p)} AS DOUBLE) AS p{i}", f"{label.format(quoted(y))} AS y{i}")
    ]
    if not ensemble and list(within) == list(strata) and set(metrics) <= set(METRICS):
        held = Strata(df, within, ids, seed)
        if max(held.sizes, default=0) <= WHOLE:
            total = _in_whole_strata(held.numbered(columns), held.names, n_sides, n_boot, metrics, first)
            return _valued(total, held.table.withColumnRenamed("__s", "s"), strata, list(sides), metrics)
    cells = Cells(df, within, ids, seed)
    of, named, sizes = _evaluated_strata(cells, strata)
    code = cells.code(n_boot)
    most = int(sizes.max())
    bits = _bits(most, 1 if ensemble else n_boot)

    def points(key, rows, draws):
        if not rows.num_rows:
            return _POINT_SCHEMA.empty_table()
        order, counts = _counts(rows, draws, code, n_boot)
        out = []
        for i in range(n_sides):
            (p, no_p), (y, no_y) = _numbers(rows[f"p{i}"]), _numbers(rows[f"y{i}"])
            keep = ~(no_p | no_y | np.isnan(p))[order]
            for c, x in _points(p[order][keep], (y == 1)[order][keep], counts[keep], bits):
                out.append(_point_table(of[key[0].as_py()], i, 0, c, x))
        return _whole(out, _POINT_SCHEMA)

    placed = cells.placed(columns).groupBy("s", "cell")
    drawn = cells.draws(n_boot, first).groupBy("s", "cell")
    if not ensemble:
        made = placed.cogroup(drawn).applyInArrow(points, _POINTS)
        return _measured(made, named, strata, list(sides), metrics, most, n_boot, first)

    blocks = [int(np.ceil(np.log2(max(1, n / CELL)))) for n in sizes]
    record = np.dtype([("h", "<i8", (2,)), ("v", "<f8", (2 * n_sides,)), ("null", "u1", (2 * n_sides,)), ("w", "u1", (n_boot,))])

    def by_id(key, rows, draws):
        s, out = of[key[0].as_py()], []
        if not rows.num_rows:
            return pa.schema([("s", pa.int32()), ("block", pa.int32()), ("rows", pa.binary())]).empty_table()
        order, counts = _counts(rows, draws, code, n_boot)
        rec = np.zeros(len(order), record)
        for i in (0, 1):
            rec["h"][:, i] = rows[f"h{i + 1}"].to_numpy()[order]
        for i in range(n_sides):
            for j, c in enumerate((f"p{i}", f"y{i}")):
                value, null = _numbers(rows[c])
                rec["v"][:, 2 * i + j], rec["null"][:, 2 * i + j] = value[order], null[order]
        while len(rec):
            rec["w"] = np.minimum(counts, 255)
            block = rec["h"][:, 0] >> (60 - blocks[s])
            at = _runs(block)
            out.append(_table(("s", "block", "rows"), (s, block[at[:-1]]), _binary(rec.tobytes(), at * rec.itemsize)))
            more = (counts > 255).any(axis=1)
            rec, counts = rec[more], np.maximum(counts[more] - 255, 0)
        return pa.concat_tables(out)

    def means(key, rows):
        rec = np.frombuffer(b"".join(rows["rows"].to_pylist()), record)
        rec = rec[np.lexsort((rec["h"][:, 1], rec["h"][:, 0]))]
        h = rec["h"]
        at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]).any(axis=1)]))
        s, out = key[0].as_py(), []
        step = max(1, HELD // len(rec))
        for a in range(0, n_boot, step):
            w = rec["w"][:, a : a + step].astype(np.float64)
            n = np.add.reduceat(w, at, axis=0)
            for i in range(n_sides):
                mean, there = [], n > 0
                for j in (2 * i, 2 * i + 1):
                    given = w * (rec["null"][:, j] == 0)[:, None]
                    # a score that is not drawn doesn't count, even if it is not a number
                    value = np.where(given > 0, given * rec["v"][:, j, None], 0.0)
                    mean.append(np.add.reduceat(value, at, axis=0) / np.maximum(n, 1))
                    there = there & (np.add.reduceat(given, at, axis=0) > 0)
                there &= ~np.isnan(mean[0])
                positive = np.floor(mean[1] + 0.5) == 1
                for b in range(n.shape[1]):
                    k = there[:, b]
                    one = np.ones((int(k.sum()), 1), np.int64)
                    for c, x in _points(mean[0][k, b], positive[k, b], one, bits):
                        out.append(_point_table(s, i, a + b, c, x))
        return _whole(out, _POINT_SCHEMA)

    grouped = placed.cogroup(drawn).applyInArrow(by_id, "s int, block int, rows binary")
    made = grouped.groupBy("s", "block").applyInArrow(means, _POINTS)
    return _measured(made, named, strata, list(sides), metrics, most, 1, first)
