"""Time-binned features from event tables.

Long form (one row per patient and feature) is the primary form. Every event
table is read once: bins come from a CASE per row instead of a query per bin,
and counts and statistics of one table share one aggregation.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from strataflow.operators.running import quoted, running_sums
from strataflow.session import cut_lineage

# Edges in days around the reference time, the far edge that
# stands for all history, and the statistics of a measurement.
DEFAULT_EDGES = ("-180", "-30", "-7", "0", "0.167")
ALL_HISTORY = "-365000"
STATS = ("min", "max", "avg")
#: Numbers of dense arrays made at once.
ARRAYS_HELD = 1 << 20

LONG_COLUMNS = (
    "subject_id",
    "feature_id",
    "feature_val",
    "concept_id",
    "feature_tag",
    "feature_type",
    "stat",
    "bin_left",
    "bin_right",
)

_MICROS_PER_HOUR = 3_600_000_000


@dataclass(frozen=True)
class TimeBin:
    """Days relative to the reference time, both ends inclusive."""

    left: str
    right: str

    @property
    def name(self) -> str:
        return f"bin_{self.left}_{self.right}"

    def bounds(self) -> tuple[int, int]:
        """Offsets in microseconds; fractions of a day are rounded to whole hours."""
        return tuple(round(float(e) * 24) * _MICROS_PER_HOUR for e in (self.left, self.right))


def build_time_bins(edges: Sequence[str] = DEFAULT_EDGES, include_all_history: bool = True) -> list[TimeBin]:
    edges = [str(e) for e in edges]
    if include_all_history:
        edges = [ALL_HISTORY, *edges]
    return [TimeBin(a, b) for a, b in zip(edges, edges[1:])]


@dataclass(frozen=True)
class Source:
    """One configured feature source."""

    table: str
    concept_id: str
    timestamp: str
    feature_tag: str
    feature_type: str

    def bins(self, bins: Iterable[TimeBin]) -> list[TimeBin]:
        """Bins this source is computed for.

        Counts at discharge only before the reference time, measurements of the
        unit only after it, everything else in all bins.
        """
        if self.feature_type == "count" and self.timestamp == "discharge":
            return [b for b in bins if float(b.right) <= 0]
        if self.timestamp == "discharge":
            return []
        if self.feature_type == "measurement" and "icu" in self.feature_tag:
            return [b for b in bins if float(b.left) >= 0]
        return list(bins)


@dataclass
class FeatureConfig:
    """What to extract: the same settings a feature file names."""

    sources: list[Source]
    time_bins: Sequence[str] = DEFAULT_EDGES
    include_all_history: bool = True
    analysis_id: str = ""
    bins: list[TimeBin] = field(init=False)

    def __post_init__(self):
        self.bins = build_time_bins(self.time_bins, self.include_all_history)

    @classmethod
    def from_dict(cls, conf: Mapping) -> "FeatureConfig":
        sources = [
            Source(
                table=t["concept_table"].split(".")[-1],
                concept_id=t["concept_id"],
                timestamp=t["timestamp"],
                feature_tag=t["feature_tag"],
                feature_type=t["feature_type"],
            )
            for t in conf["tables_to_build"].values()
        ]
        return cls(
            sources,
            conf.get("time_bins", DEFAULT_EDGES),
            conf.get("include_all_history", True),
            conf.get("analysis_id", ""),
        )


# The seven standard sources.
STANDARD_SOURCES = [
    Source("diagnoses_icd", "icd_code", "discharge", "diag", "count"),
    Source("hcpcsevents", "hcpcs_cd", "discharge", "hcpcs", "count"),
    Source("labevents", "itemid", "charttime", "lab", "count"),
    Source("prescriptions", "ndc", "starttime", "presc", "count"),
    Source("procedures_icd", "icd_code", "discharge", "proc", "count"),
    Source("chartevents", "itemid", "charttime", "icucharts", "measurement"),
    Source("labevents", "itemid", "charttime", "labs", "measurement"),
]


def bin_index(ts: str, ref: str, bins: Sequence[TimeBin]) -> str:
    """Array of the bins (places in ``bins``) that hold ``ts``; an edge belongs to both neighbours."""
    offset = f"timestampdiff(MICROSECOND, {ref}, {ts})"
    hits = []
    for i, b in enumerate(bins):
        lo, hi = b.bounds()
        hits.append(f"CASE WHEN {offset} BETWEEN {lo}L AND {hi}L THEN {i} END")
    return f"array_compact(array({', '.join(hits)}))"


def _pick(values: Sequence[str]) -> str:
    """The value at place ``bin``."""
    return "CASE bin " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def admission_index(cohort: DataFrame, admissions: DataFrame) -> DataFrame:
    """All admissions of the cohort's patients with the reference time."""
    return cohort.select("subject_id", "ref_datetime").join(
        admissions.select("subject_id", "hadm_id", "dischtime"), "subject_id"
    )


def binned_events(
    index: DataFrame,
    events: DataFrame,
    concept_col: str,
    ts_col: str | None,
    bins: Sequence[TimeBin],
    values: bool = False,
) -> DataFrame:
    """Events of the indexed admissions, one row per bin they fall in (``bin``).

    ``index`` comes from ``admission_index``. ``ts_col=None`` dates an event by
    the discharge of its admission; the bin is then found before the events are
    joined, so admissions outside all bins never meet the event table.
    """
    cols = ["hadm_id", f"CAST({concept_col} AS STRING) AS concept_id"]
    if values:
        cols += ["valuenum", "value"]
    if ts_col is None:
        hit = bin_index("dischtime", "ref_datetime", bins)
        index = index.selectExpr("subject_id", "hadm_id", f"explode({hit}) AS bin")
        return events.selectExpr(*cols).join(index, "hadm_id")
    joined = events.selectExpr(*cols, f"{ts_col} AS __ts").join(index.drop("dischtime"), "hadm_id")
    kept = ["subject_id", "hadm_id", "concept_id", *(["valuenum", "value"] if values else [])]
    return joined.selectExpr(*kept, f"explode({bin_index('__ts', 'ref_datetime', bins)}) AS bin")


def _finish(df: DataFrame, tag: str, kind: str, stat: str, bins: Sequence[TimeBin], extra: Sequence[str] = ()) -> DataFrame:
    """Long columns from ``concept_id, bin, feature_val``; tag, kind and stat are SQL text."""
    name = _pick([b.name for b in bins])
    return df.selectExpr(
        "subject_id",
        f"concat_ws('_', concept_id, {tag}, {kind}, {stat}, {name}) AS feature_id",
        "CAST(feature_val AS DOUBLE) AS feature_val",
        "concept_id",
        f"{tag} AS feature_tag",
        f"{kind} AS feature_type",
        f"{stat} AS stat",
        f"{_pick([b.left for b in bins])} AS bin_left",
        f"{_pick([b.right for b in bins])} AS bin_right",
        *extra,
    )


def count_features(
    index: DataFrame,
    events: DataFrame,
    concept_col: str,
    ts_col: str | None,
    bins: Sequence[TimeBin],
    tag: str,
    with_admissions: bool = False,
) -> DataFrame:
    """Number of events per patient, concept and bin (optionally of distinct admissions)."""
    ev = binned_events(index, events, concept_col, ts_col, bins)
    aggs = [F.expr("count(*) AS feature_val")]
    if with_admissions:
        aggs.append(F.expr("count(DISTINCT hadm_id) AS n_admissions"))
    counts = ev.groupBy("subject_id", "concept_id", "bin").agg(*aggs)
    extra = ["n_admissions"] if with_admissions else []
    return _finish(counts, f"'{tag}'", "'count'", "CAST(NULL AS STRING)", bins, extra)


def _stat_aggs(stats: Sequence[str]) -> list[Column]:
    number = "try_cast(value AS DOUBLE)"
    value = f"coalesce(valuenum, CASE WHEN NOT isnan({number}) THEN {number} END)"
    return [F.expr(f"{s}({value}) AS `{s}`") for s in stats]


def _stack(columns: Sequence[str]) -> str:
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in columns)
    return f"stack({len(columns)}, {pairs}) AS (stat, feature_val)"


def measurement_features(
    index: DataFrame,
    events: DataFrame,
    concept_col: str,
    ts_col: str,
    bins: Sequence[TimeBin],
    tag: str,
    stats: Sequence[str] = STATS,
) -> DataFrame:
    """Minimum, maximum and mean per patient, concept and bin in one aggregation."""
    some = events.where("valuenum IS NOT NULL OR value IS NOT NULL")
    ev = binned_events(index, some, concept_col, ts_col, bins, values=True)
    agg = ev.groupBy("subject_id", "concept_id", "bin").agg(*_stat_aggs(stats))
    rows = agg.selectExpr("subject_id", "concept_id", "bin", _stack(stats)).where("feature_val IS NOT NULL")
    return _finish(rows, f"'{tag}'", "'measurement'", "stat", bins)


def _counts_and_measurements(index, events, count_src: Source, meas_src: Source, bins, stats):
    """Both feature kinds of one table from one scan and one aggregation."""
    ev = binned_events(index, events, count_src.concept_id, count_src.timestamp, bins, values=True)
    agg = ev.groupBy("subject_id", "concept_id", "bin").agg(F.expr("count(*) AS n"), *_stat_aggs(stats))
    rows = agg.selectExpr("subject_id", "concept_id", "bin", _stack(["n", *stats])).where("feature_val IS NOT NULL")
    places = lambda src: ", ".join(str(bins.index(b)) for b in src.bins(bins))
    rows = rows.where(
        f"CASE WHEN stat = 'n' THEN bin IN ({places(count_src)}) ELSE bin IN ({places(meas_src)}) END"
    )
    return _finish(
        rows,
        f"CASE WHEN stat = 'n' THEN '{count_src.feature_tag}' ELSE '{meas_src.feature_tag}' END",
        "CASE WHEN stat = 'n' THEN 'count' ELSE 'measurement' END",
        "nullif(stat, 'n')",
        bins,
    )


def build_features(
    cohort: DataFrame,
    admissions: DataFrame,
    tables: Mapping[str, DataFrame],
    config: FeatureConfig,
    stats: Sequence[str] = STATS,
) -> DataFrame:
    """All configured features in long form; NULL values are left out.

    Pieces never overlap (tag and type are part of the name), so they are
    appended without a distinct.
    """
    # the small side of every join is computed once
    index = cut_lineage(admission_index(cohort, admissions))
    grouped: dict[tuple, list[Source]] = {}
    for s in config.sources:
        grouped.setdefault((s.table, s.concept_id, s.timestamp), []).append(s)
    parts = []
    for (table, concept, ts), sources in grouped.items():
        kinds = sorted(s.feature_type for s in sources)
        if kinds == ["count", "measurement"] and ts != "discharge":
            pair = {s.feature_type: s for s in sources}
            parts.append(
                _counts_and_measurements(
                    index, tables[table], pair["count"], pair["measurement"], config.bins, stats
                )
            )
            continue
        for s in sources:
            bins = s.bins(config.bins)
            if not bins:
                continue
            if s.feature_type == "count":
                at = None if ts == "discharge" else ts
                part = count_features(index, tables[table], concept, at, bins, s.feature_tag)
            else:
                part = measurement_features(
                    index, tables[table], concept, ts, bins, s.feature_tag, stats
                )
            parts.append(part)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("feature_val IS NOT NULL").select(*LONG_COLUMNS)


def vocabulary(long: DataFrame) -> DataFrame:
    """Feature ids with a dense index in name order, for vectors and pivots."""
    from strataflow.operators.running import running_sums

    ids = long.select("feature_id").distinct().selectExpr("feature_id", "1L AS __one", "0 AS __k")
    placed = running_sums(ids, ["__k"], ["feature_id"], ["__one"], "substring(feature_id, 1, 4)")
    return placed.selectExpr("feature_id", "CAST(before___one AS INT) AS idx")


def feature_names(long: DataFrame) -> list[str]:
    """All feature ids of the data in name order: the columns of its wide form."""
    return [r[0] for r in long.select("feature_id").distinct().orderBy("feature_id").collect()]


def pivot_features(long: DataFrame, feature_ids: Sequence[str], zero_fill_tag: str = "count") -> DataFrame:
    """Wide form for an explicit list of features; missing counts become 0."""
    wide = long.groupBy("subject_id").pivot("feature_id", list(feature_ids)).agg(F.avg("feature_val"))
    return wide.selectExpr(
        "subject_id",
        *[f"coalesce(`{c}`, 0D) AS `{c}`" if zero_fill_tag in c else f"`{c}`" for c in feature_ids],
    )


def feature_cells(long: DataFrame, places: DataFrame) -> DataFrame:
    """A patient's features as one list of (place, value), ``cells``; ``places`` are those of ``feature_places``.

    Numbers instead of names are sent, once: both aggregations use the same parts.
    """
    known = long.join(F.broadcast(places), "feature_id", "left").select("subject_id", "at", "feature_val")
    each = known.repartition("subject_id").groupBy("subject_id", "at").agg(F.avg("feature_val").alias("x"))
    return each.groupBy("subject_id").agg(F.collect_list(F.struct("at", "x")).alias("cells"))


def dense_arrays(held: DataFrame, feature_ids: Sequence[str], zero_fill_tag: str = "count") -> DataFrame:
    """The last column, ``cells``, as one array ``values`` in the order of ``feature_ids``; a row without cells has none.

    Code and buffers don't grow with the number of features; a task holds some rows' arrays at a time.
    """
    zero, size = np.array([zero_fill_tag in c for c in feature_ids], bool), len(feature_ids)
    fields = held.drop("cells").schema.add("values", ArrayType(DoubleType()))

    def dense(batches):
        step = max(1, ARRAYS_HELD // max(size, 1))
        for whole in batches:
            for first in range(0, whole.num_rows, step):
                batch = whole.slice(first, step)
                lists, n = batch.column(batch.num_columns - 1), batch.num_rows
                row = np.repeat(np.arange(n), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                at, x = lists.flatten().flatten()
                known = at.is_valid().to_numpy(zero_copy_only=False)
                place = row[known] * size + at.fill_null(0).to_numpy(zero_copy_only=False)[known]
                given = known & x.is_valid().to_numpy(zero_copy_only=False)
                values, empty = np.zeros(n * size), np.tile(~zero, n)
                values[place[given[known]]] = x.fill_null(0.0).to_numpy(zero_copy_only=False)[given]
                empty[place[given[known]]] = False
                offsets = pa.array(np.arange(n + 1) * size, pa.int32())
                arrays = pa.ListArray.from_arrays(offsets, pa.array(values, mask=empty), mask=lists.is_null())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], arrays], [*batch.schema.names[:-1], "values"])

    return held.mapInArrow(dense, fields)


def pivot_arrays(
    long: DataFrame, places: DataFrame, feature_ids: Sequence[str], zero_fill_tag: str = "count"
) -> DataFrame:
    """The wide form of ``pivot_features`` with one array per patient, in the order of ``feature_ids``."""
    return dense_arrays(feature_cells(long, places), feature_ids, zero_fill_tag)


def feature_places(spark: SparkSession, feature_ids: Sequence[str]) -> DataFrame:
    """``feature_id`` and its place ``at`` in the list."""
    return spark.createDataFrame([(c, i) for i, c in enumerate(feature_ids)], "feature_id string, at int")


def stack_arrays(wide: DataFrame, places: DataFrame, size: int, keys: Sequence[str]) -> DataFrame:
    """One row per row and feature of ``pivot_arrays``; a row without an array has NULL for each."""
    filled = f"posexplode(coalesce(values, array_repeat(CAST(NULL AS DOUBLE), {size}))) AS (at, value)"
    rows = wide.selectExpr(*map(quoted, keys), filled).join(F.broadcast(places), "at")
    return rows.select(*keys, F.col("feature_id").alias("feature"), "value")


def feature_table(demographics: DataFrame, wide: DataFrame) -> DataFrame:
    """Demographics with features; patients without events keep NULL, counts too."""
    return demographics.join(wide, "subject_id", "left")
