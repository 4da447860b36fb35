"""SQL texts of splits, metrics, fits and draws for the checking engine.

``src`` is a FROM item with columns ``labels, pred_probs`` and, where weighted, ``w``.
"""

from __future__ import annotations

from collections.abc import Sequence

from strataflow.operators.bootstrap import PRIME
from strataflow.plans.registry import r


def q(names: Sequence[str], prefix: str = "") -> str:
    return ", ".join(f'{prefix}"{n}"' for n in names)


def folds_sql(src: str, fractions: dict, label: str = "label", id_col: str = "subject_id", seed: int = 44) -> str:
    whens, cum = [], 0.0
    names = list(fractions)
    for n in names[:-1]:
        cum += fractions[n]
        whens.append(f"WHEN rank0 < floor(n * {cum!r}::DOUBLE + 0.5::DOUBLE) THEN '{n}'")
    return f"""
SELECT * EXCLUDE (rank0, n), CASE {' '.join(whens)} ELSE '{names[-1]}' END AS fold_id FROM (
  SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5(concat_ws('|', {seed}, {id_col})), {id_col}) - 1 AS rank0,
         count(*) OVER (PARTITION BY {label}) AS n
  FROM {src} WHERE {label} IS NOT NULL)"""


def ranks_sql(src: str, strata: Sequence[str]) -> str:
    s = q(strata)
    return f"""
SELECT {s}, p, pos, neg, coalesce(sum(pos) OVER w, 0) AS before_pos, coalesce(sum(neg) OVER w, 0) AS before_neg,
       sum(pos) OVER (PARTITION BY {s}) AS total_pos, sum(neg) OVER (PARTITION BY {s}) AS total_neg
FROM (SELECT {s}, pred_probs AS p, sum(CASE WHEN labels = 1 THEN w ELSE 0 END)::DOUBLE AS pos,
             sum(CASE WHEN labels = 1 THEN 0 ELSE w END)::DOUBLE AS neg
      FROM {src} GROUP BY {s}, pred_probs)
WINDOW w AS (PARTITION BY {s} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


_CLIPPED = "least(greatest(pred_probs, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE)"
ROW_SQL = {
    "brier": "sum(w * (pred_probs - labels) * (pred_probs - labels)) / sum(w)",
    "loss_bce": f"CASE WHEN min(labels) = max(labels) THEN 1e18 ELSE "
    f"sum(w * -(CASE WHEN labels = 1 THEN ln({_CLIPPED}) ELSE ln(1 - {_CLIPPED}) END)) / sum(w) END",
    "mean_prediction": "sum(w * pred_probs) / sum(w)",
    "mean_prediction_0": "sum(w * pred_probs) FILTER (labels = 0) / sum(w) FILTER (labels = 0)",
    "mean_prediction_1": "sum(w * pred_probs) FILTER (labels = 1) / sum(w) FILTER (labels = 1)",
    "spiegelhalter_z": "sum(w * (labels - pred_probs) * (1 - 2 * pred_probs)) / "
    "sqrt(sum(w * (1 - 2 * pred_probs) * (1 - 2 * pred_probs) * pred_probs * (1 - pred_probs)))",
}
RANK_SQL = {
    "auc": "coalesce(sum(pos * (before_neg + neg / 2)) / nullif(max(total_pos) * max(total_neg), 0), -1)",
    "auprc": "sum(pos / nullif(total_pos, 0) * (total_pos - before_pos) / "
    "(total_pos - before_pos + total_neg - before_neg))",
}


def threshold_sql(name: str, positive: str) -> str:
    tp = f"sum(CASE WHEN {positive} AND labels = 1 THEN w ELSE 0 END)"
    fp = f"sum(CASE WHEN {positive} AND labels = 0 THEN w ELSE 0 END)"
    fn = f"sum(CASE WHEN NOT ({positive}) AND labels = 1 THEN w ELSE 0 END)"
    tn = f"sum(CASE WHEN NOT ({positive}) AND labels = 0 THEN w ELSE 0 END)"
    num, den = {
        "sensitivity": (tp, f"({tp} + {fn})"),
        "recall": (tp, f"({tp} + {fn})"),
        "specificity": (tn, f"({tn} + {fp})"),
        "ppv": (tp, f"({tp} + {fp})"),
        "precision": (tp, f"({tp} + {fp})"),
        "npv": (tn, f"({tn} + {fn})"),
        "fpr": (fp, f"({fp} + {tn})"),
        "fnr": (fn, f"({fn} + {tp})"),
        "fdr": (fp, f"({fp} + {tp})"),
    }[name]
    return f"{num}::DOUBLE / nullif({den}::DOUBLE, 0)"


def at_threshold_sql(metric: str) -> str:
    kind, _, t = metric.rpartition("_")
    return f"coalesce({threshold_sql(kind, f'pred_probs >= {t}::DOUBLE')}, 0)"


def weighted(view: str, weight: str = "1.0::DOUBLE") -> str:
    return f"(SELECT *, {weight} AS w FROM {view})"


def metrics_sql(src: str, strata: Sequence[str], metrics: Sequence[str], threshold: str | None = None, rounded: bool = True) -> str:
    """Long metric rows: ``metric, strata, performance``."""
    s, parts = q(strata), []
    fin = r if rounded else (lambda e: f"({e})::DOUBLE")
    comma = f"{s}," if s else ""
    group = f"GROUP BY {s}" if s else ""
    for m in metrics:
        if m in RANK_SQL:
            parts.append(
                f"SELECT '{m}' AS metric, {comma} {fin(RANK_SQL[m])} AS performance FROM ({ranks_sql(src, strata)}) {group}"
            )
        else:
            if m in ROW_SQL:
                e = ROW_SQL[m]
            elif "_" in m and m.rpartition("_")[0] in ("recall", "precision", "specificity"):
                e = at_threshold_sql(m)
            else:
                e = threshold_sql(m, f"pred_probs > {threshold}")
            parts.append(f"SELECT '{m}' AS metric, {comma} {fin(e)} AS performance FROM {src} {group}")
    return "\nUNION ALL\n".join(parts)


def newton_views(points: str, keys: Sequence[str], name: str, steps: int = 14) -> dict[str, str]:
    """Plain Newton steps as a chain of views; ``mat_<name>_<steps>`` holds ``a, b`` per key.

    ``points`` has ``keys, x, w1, w0``.
    """
    k = q(keys)
    views = {
        f"mat_{name}_pts": f"SELECT * FROM ({points})",
        f"mat_{name}_0": f"SELECT {k}, ln(sum(w1) / sum(w0)) AS a, 0.0::DOUBLE AS b FROM mat_{name}_pts GROUP BY {k}",
    }
    for i in range(1, steps + 1):
        views[f"mat_{name}_{i}"] = f"""
SELECT {k}, a + (g0 * h11 - g1 * h01) / (h00 * h11 - h01 * h01) AS a, b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b
FROM (SELECT {k}, any_value(a) AS a, any_value(b) AS b, sum(w1 - n * p) AS g0, sum((w1 - n * p) * x) AS g1,
             sum(n * p * (1 - p)) AS h00, sum(n * p * (1 - p) * x) AS h01, sum(n * p * (1 - p) * x * x) AS h11
      FROM (SELECT *, w1 + w0 AS n, 1 / (1 + exp(-(a + b * x))) AS p FROM mat_{name}_pts JOIN mat_{name}_{i - 1} USING ({k}))
      GROUP BY {k})"""
    views[f"{name}_curve"] = f"""
SELECT *, 1 / (1 + exp(-(a + b * x))) AS density FROM mat_{name}_pts JOIN mat_{name}_{steps} USING ({k})"""
    views[f"{name}_coefs"] = f"SELECT * FROM mat_{name}_{steps}"
    return views


def points_sql(src: str, keys: Sequence[str], transform: str | None) -> str:
    x = {None: "pred_probs", "log": "ln(pred_probs)", "logit": "ln(pred_probs / (1 - pred_probs))",
         "c_log_log": "ln(-ln(1 - pred_probs))"}[transform]
    where = "" if transform is None else "WHERE pred_probs > 1e-15::DOUBLE AND pred_probs < 1 - 1e-15::DOUBLE"
    return f"""
SELECT {q(keys)}, pred_probs, any_value({x}) AS x, sum(CASE WHEN labels = 1 THEN w ELSE 0 END)::DOUBLE AS w1,
       sum(CASE WHEN labels = 1 THEN 0 ELSE w END)::DOUBLE AS w0
FROM {src} {where} GROUP BY {q(keys)}, pred_probs"""


def draw_views(src: str, strata: Sequence[str], ids: Sequence[str], n_boot: int, name: str = "drawn", seed: int = 44) -> dict[str, str]:
    """View ``<name>``: source rows with ``boot_iter`` and weight ``w``."""
    s, i = q(strata), q(ids)
    on = " AND ".join(f'u."{c}" = d."{c}"' for c in [*strata, "rank0"])
    hash_of = ", ".join([str(seed), "'draw'", *[f'"{c}"' for c in strata], "rank0"])
    whole = " AND ".join(f'"{c}" IS NOT NULL' for c in strata)
    return {
        f"mat_{name}_units": f"""
SELECT *, md5(concat_ws('|', {hash_of})) AS digest FROM (
  SELECT *, row_number() OVER (PARTITION BY {s} ORDER BY md5(concat_ws('|', {seed}, {i})), {i}) - 1 AS rank0,
         count(*) OVER (PARTITION BY {s}) AS n
  FROM {src} WHERE {whole})""",
        f"mat_{name}_draws": f"""
SELECT {s}, boot_iter, place AS rank0, count(*)::DOUBLE AS w FROM (
  SELECT {s}, boot_iter, (h1 + boot_iter * h2) % {PRIME} % n AS place FROM (
    SELECT {s}, n, ('0x' || substr(digest, 1, 12))::BIGINT % {PRIME} AS h1, ('0x' || substr(digest, 13, 12))::BIGINT % {PRIME} AS h2,
           unnest(range(1, {n_boot + 1}))::INTEGER AS boot_iter FROM mat_{name}_units))
GROUP BY {s}, boot_iter, place""",
        name: f"SELECT u.* EXCLUDE (rank0, n, digest), d.boot_iter, d.w FROM mat_{name}_units u JOIN mat_{name}_draws d ON {on}",
    }


def interval_sql(src: str, keys: Sequence[str], value: str = "performance", alpha: float = 0.05, rounded: bool = True) -> str:
    fin = r if rounded else (lambda e: f"({e})::DOUBLE")
    cols = ", ".join(
        f"{fin(f'quantile_cont({value}, {p!r})')} AS {n}"
        for n, p in (("ci_lower", alpha / 2), ("ci_med", 0.5), ("ci_upper", 1 - alpha / 2))
    )
    return f"SELECT {q(keys)}, {cols} FROM {src} WHERE {value} IS NOT NULL GROUP BY {q(keys)}"


def block_draw_views(src: str, strata: Sequence[str], n_boot: int, leaf: int, levels: int, name: str = "blocks", seed: int = 44) -> dict[str, str]:
    """View ``<name>``: ``strata, boot_iter, pred_probs, labels, w``, the draws dealt down a tree over cells of scores.

    ``levels`` halvings must reach the cells of all rows; halvings of empty nodes draw nothing.
    """
    s, key = q(strata), f"concat_ws('|', {q(strata)})"
    whole = " AND ".join(f'"{c}" IS NOT NULL' for c in [*strata, "labels", "pred_probs"])
    hashed = lambda *parts: f"md5(concat_ws('|', {', '.join(map(str, [seed, *parts]))}))"
    part = lambda d, a: f"('0x' || substr({d}, {a}, 12))::BIGINT % {PRIME}"
    number = lambda d: f"(({part(d, 1)} + boot_iter * ({part(d, 13)})) % {PRIME} + 0.5) / {PRIME}"

    def quantiles(trials: str) -> str:
        """Least k whose cumulated binomial terms reach u: ``trials`` has ``id, m, p, u``."""
        reach = "12 * sqrt(m * p * (1 - p)) + 20"
        return f"""
SELECT id, min(k) FILTER (cum >= u * tot) AS got FROM (
  SELECT *, sum(w) OVER (PARTITION BY id ORDER BY k) AS cum, sum(w) OVER (PARTITION BY id) AS tot FROM (
    SELECT *, exp(lw - max(lw) OVER (PARTITION BY id)) AS w FROM (
      SELECT *, sum(CASE WHEN k = lo THEN 0.0::DOUBLE ELSE ln((m - k + 1)::DOUBLE / k * (p / (1 - p))) END) OVER (PARTITION BY id ORDER BY k) AS lw
      FROM (SELECT *, unnest(range(lo, hi + 1)) AS k FROM (
        SELECT *, greatest(floor(m * p - ({reach})), 0)::BIGINT AS lo, least(ceil(m * p + ({reach})), m)::BIGINT AS hi FROM {trials})))))
GROUP BY id"""

    views = {
        f"mat_{name}_points": f"""
SELECT *, 2 * (before // {leaf}) + CASE WHEN c0 + c1 >= {leaf} THEN 1 ELSE 0 END AS cell FROM (
  SELECT *, coalesce(sum(c0 + c1) OVER (PARTITION BY name ORDER BY pred_probs ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM (SELECT {key} AS name, {s}, pred_probs, count(*) FILTER (labels <> 1) AS c0, count(*) FILTER (labels = 1) AS c1
        FROM {src} WHERE {whole} GROUP BY ALL))""",
        f"mat_{name}_sizes": f"""
SELECT name, label, cell, CASE label WHEN 0 THEN c0 ELSE c1 END AS size
FROM (SELECT name, cell, sum(c0)::BIGINT AS c0, sum(c1)::BIGINT AS c1 FROM mat_{name}_points GROUP BY ALL), range(2) AS l(label)""",
        f"mat_{name}_roots": f"""
SELECT row_number() OVER () AS id, name, n1, n AS m, n1::DOUBLE / n AS p, boot_iter, {number(hashed("'label'", "name"))} AS u
FROM (SELECT name, sum(size)::BIGINT AS n, (sum(size) FILTER (label = 1))::BIGINT AS n1 FROM mat_{name}_sizes GROUP BY name),
     range(1, {n_boot + 1}) AS b(boot_iter)""",
        f"mat_{name}_{levels}": f"""
SELECT name, label, 0 AS node, boot_iter, CASE label WHEN 1 THEN ones ELSE m - ones END AS m FROM (
  SELECT name, boot_iter, m, CASE WHEN n1 = m THEN m WHEN n1 = 0 THEN 0 ELSE got END AS ones FROM mat_{name}_roots
  LEFT JOIN ({quantiles(f"(FROM mat_{name}_roots WHERE n1 > 0 AND n1 < m)")}) USING (id)), range(2) AS l(label)""",
    }
    for level in range(levels - 1, -1, -1):
        size = f"SELECT name, label, cell >> {level} AS node, sum(size)::BIGINT AS size FROM mat_{name}_sizes GROUP BY ALL"
        views[f"mat_{name}_halves_{level}"] = f"""
SELECT row_number() OVER () AS id, p.name, p.label, p.node, p.boot_iter, p.m, coalesce(a.size, 0) AS a, coalesce(b.size, 0) AS b,
       coalesce(a.size, 0)::DOUBLE / (coalesce(a.size, 0) + coalesce(b.size, 0)) AS p,
       {number(hashed("'split'", "p.name", "p.label", level + 1, "p.node"))} AS u
FROM mat_{name}_{level + 1} p LEFT JOIN ({size}) a ON p.name = a.name AND p.label = a.label AND a.node = 2 * p.node
LEFT JOIN ({size}) b ON p.name = b.name AND p.label = b.label AND b.node = 2 * p.node + 1"""
        views[f"mat_{name}_{level}"] = f"""
SELECT name, label, 2 * node + side AS node, boot_iter, CASE side WHEN 0 THEN low ELSE m - low END AS m FROM (
  SELECT name, label, node, boot_iter, m, a, b, CASE WHEN b = 0 THEN m WHEN a = 0 THEN 0 ELSE got END AS low FROM mat_{name}_halves_{level}
  LEFT JOIN ({quantiles(f"(FROM mat_{name}_halves_{level} WHERE a > 0 AND b > 0)")}) USING (id)), range(2) AS l(side)
WHERE CASE side WHEN 0 THEN a ELSE b END > 0"""
    views[f"mat_{name}_rows"] = f"""
SELECT {s}, name, cell, label, pred_probs, c AS size,
       (sum(c) OVER (PARTITION BY name, cell, label ORDER BY pred_probs ROWS UNBOUNDED PRECEDING) - c)::BIGINT AS start
FROM (SELECT {s}, name, cell, pred_probs, label, CASE label WHEN 0 THEN c0 ELSE c1 END AS c FROM mat_{name}_points, range(2) AS l(label))
WHERE c > 0"""
    views[f"mat_{name}_places"] = f"""
SELECT name, label, cell, boot_iter, ({part("digest", 1)} + boot_iter * ({part("digest", 13)})) % {PRIME} % size AS place FROM (
  SELECT m.name, m.label, m.node AS cell, m.boot_iter, size, {hashed("'draw'", "m.name", "m.label", "m.node", "j")} AS digest
  FROM (SELECT *, unnest(range(m)) AS j FROM mat_{name}_0) m JOIN mat_{name}_sizes z ON m.name = z.name AND m.label = z.label AND m.node = z.cell)"""
    views[name] = f"""
SELECT {q(strata, 'r.')}, boot_iter::INTEGER AS boot_iter, pred_probs, r.label::INTEGER AS labels, count(*)::DOUBLE AS w
FROM mat_{name}_places p ASOF JOIN mat_{name}_rows r ON p.name = r.name AND p.label = r.label AND p.cell = r.cell AND p.place >= r.start
GROUP BY ALL"""
    return views
