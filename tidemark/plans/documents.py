"""Models as documents, what their states mean, and the algebra of chains taken together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import algebra
from ..functions import probability as pr
from ..operators import regimes
from ..sources import models, tables
from ..sources.scratch import folder, stored
from . import walkforward as wf
from .library import W, grid, query, r
from .regimewalk import KINDS, PANELS, panel_matrices

#: The given chains: growth alone, and inflation with rates.
_GROWTH = {"start": [0.5, 0.5], "transition": [[0.95, 0.05], [0.1, 0.9]], "means": [[-0.8], [0.8]], "covariances": [[[1.0]], [[1.0]]]}
_LEVELS = {"start": [0.4, 0.6], "transition": [[0.9, 0.1], [0.2, 0.8]], "means": [[-0.7, -0.2], [0.6, 0.9]], "covariances": [[[1.0, 0.2], [0.2, 1.0]], [[1.5, -0.3], [-0.3, 0.8]]]}


def _literal(x: list) -> Column:
    return F.array(*(_literal(v) if isinstance(v, list) else F.lit(v) for v in x))


def _chain(columns: list[str], parts: dict) -> Column:
    return models.chain(columns, *(_literal(parts[p]) for p in models.PARTS))


def given_documents(panels: DataFrame) -> DataFrame:
    """(panel, document) of two models for each panel: the growth chain, and its product with the levels chain."""
    one, two = models.document(_chain(["growth"], _GROWTH)), models.document(_chain(["growth"], _GROWTH), _chain(["inflation", "rates"], _LEVELS))
    return panels.select("panel").distinct().select("panel", F.explode(F.array(one, two)).alias("document"))


def _density(parts: dict, k: int, columns: list[str]) -> str:
    """A normal density in SQL, of one dimension or two."""
    m, c = parts["means"][k], np.array(parts["covariances"][k])
    inverse, size = np.linalg.inv(c), float(np.sqrt((2 * np.pi) ** len(m) * np.linalg.det(c)))
    d = [f"({x} - ({v}))" for x, v in zip(columns, m)]
    q = " + ".join(f"({float(inverse[i, j])!r})::DOUBLE * {d[i]} * {d[j]}" for i in range(len(m)) for j in range(len(m)))
    return f"exp(-0.5 * ({q})) / {size!r}::DOUBLE"


def _smooth(p: str, parts: dict, columns: list[str]) -> str:
    """CTEs: the forward and backward recursion of a chain of two states over the panels, `{p}s` has the smoothed chances."""
    (a, b), (c, d) = parts["transition"]
    s0, s1 = parts["start"]
    x, y = f"(p * {a}::DOUBLE + (1 - p) * {c}::DOUBLE)", f"(p * {b}::DOUBLE + (1 - p) * {d}::DOUBLE)"
    return f"""{p}e AS MATERIALIZED (SELECT panel, month, row_number() OVER (PARTITION BY panel ORDER BY month) AS n, {_density(parts, 0, columns)} AS e0, {_density(parts, 1, columns)} AS e1 FROM pz),
{p}f AS (SELECT panel, month, n, (e0 * {s0} / (e0 * {s0} + e1 * {s1}))::DOUBLE AS p FROM {p}e WHERE n = 1 UNION ALL SELECT e.panel, e.month, e.n, (e.e0 * {x} / (e.e0 * {x} + e.e1 * {y}))::DOUBLE FROM {p}f f JOIN {p}e e ON e.panel = f.panel AND e.n = f.n + 1),
{p}m AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY panel) AS last FROM {p}f),
{p}s AS (SELECT panel, month, n, p AS g FROM {p}m WHERE n = last UNION ALL SELECT m.panel, m.month, m.n, (p * ({a}::DOUBLE * g / {x} + {b}::DOUBLE * (1 - g) / {y}))::DOUBLE FROM {p}s s JOIN {p}m m ON m.panel = s.panel AND m.n = s.n - 1)"""


def _words(means: list[float]) -> str:
    return ", ".join(f"{n} {'high' if z > 0.5 else 'low' if z < -0.5 else 'middling'}" for n, z in zip(KINDS, means))


def _duration(*stays: float) -> float:
    return 1 / (1 - float(np.prod(stays)))


_STATES = [("single_chain", k, _words(_GROWTH["means"][k]), _duration(_GROWTH["transition"][k][k]), "a.g" if k == 0 else "1 - a.g") for k in (0, 1)] + [
    ("two_chains", 2 * i + j, _words(_GROWTH["means"][i] + _LEVELS["means"][j]), _duration(_GROWTH["transition"][i][i], _LEVELS["transition"][j][j]), f"({'a.g' if i == 0 else '1 - a.g'}) * ({'b.g' if j == 0 else '1 - b.g'})")
    for i in (0, 1)
    for j in (0, 1)
]


@query(
    PANELS + f", {_smooth('g', _GROWTH, ['g'])}, {_smooth('v', _LEVELS, ['i', 'x'])}, each AS ({' UNION ALL '.join(f'''SELECT '{c}' AS model_class, {k}::INTEGER AS state, '{w}' AS label, {d!r}::DOUBLE AS duration, a.panel, a.month, {e} AS w FROM gs a JOIN vs b ON b.panel = a.panel AND b.month = a.month''' for c, k, w, d, e in _STATES)}) "
    f"SELECT e.panel, model_class, state, any_value(label) AS label, {r('avg(w)')} AS share, {r('any_value(duration)')} AS duration, {r('sum(w * growth) / sum(w)')} AS mean_growth, {r('CASE WHEN any_value(model_class) = $$two_chains$$ THEN sum(w * inflation) / sum(w) END')} AS mean_inflation, {r('CASE WHEN any_value(model_class) = $$two_chains$$ THEN sum(w * rates) / sum(w) END')} AS mean_rates FROM each e JOIN pl USING (panel, month) GROUP BY e.panel, model_class, state"
)
def model_descriptions(spark, sf_dir):
    """Models written as documents, read back by their class, and every state described in all its dimensions."""
    found, path = panel_matrices(spark, sf_dir), folder(spark, "models")
    models.write(given_documents(found), path)
    read = stored(models.read(spark, path, "panel string"), "read")
    natural = tables.panel_measures(spark, sf_dir).groupBy("panel", "month").pivot("series_id", list(KINDS)).agg(F.first("value"))
    out = None
    for kind, columns in ((models.SINGLE, ["growth"]), (models.TWO, list(KINDS))):
        own = read.where(F.col("model_class") == kind)
        states = regimes.smoothed_states(found, own, ["panel"], ["panel"], "month", columns)
        rows = regimes.described(states, natural, own, ["panel"], ["panel"], "month", columns).withColumn("model_class", F.lit(kind))
        means = [F.col(f"mean_{c}") if c in columns else F.lit(None).cast("double").alias(f"mean_{c}") for c in KINDS]
        rows = rows.select("panel", "model_class", "state", "label", "share", "duration", *means)
        out = rows if out is None else out.unionByName(rows)
    return out


# ---- two chains as one


def second_moduli(df: DataFrame, matrices: dict[str, str]) -> DataFrame:
    """Adds to each row the modulus of the second eigenvalue of each named matrix column; matrices of one size are
    decomposed together, batch by batch."""
    names = list(matrices)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"{n} double" for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            for name in names:
                rows, out = batch.column(batch.schema.get_field_index(matrices[name])).to_pylist(), np.full(batch.num_rows, np.nan)
                sizes = np.array([len(m) if m else 0 for m in rows])
                for size in np.unique(sizes[sizes > 0]):
                    at = np.flatnonzero(sizes == size)
                    values = np.sort(np.abs(np.linalg.eigvals(np.array([rows[i] for i in at], dtype=float))), axis=1)
                    out[at] = values[:, -2] if size > 1 else 0.0
                columns.append(pa.array(out, from_pandas=True))
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *names])

    return df.mapInArrow(run, schema)


@query(
    W + f""", one AS (SELECT series_id, max_by(entry, known_month) AS entry, max_by(stay, known_month) AS stay FROM rates GROUP BY 1), m AS (SELECT *, abs(stay - entry) AS ratio FROM one)
    SELECT a.series_id AS first, b.series_id AS second, {r('greatest(a.ratio, b.ratio)')} AS second_modulus, {r('CASE WHEN greatest(a.ratio, b.ratio) <= 0 THEN 0 ELSE ln(0.5) / ln(greatest(a.ratio, b.ratio)) END')} AS half_life,
    {r('greatest(a.ratio, b.ratio) - CASE WHEN a.ratio >= b.ratio THEN a.ratio ELSE b.ratio END')} AS residual, 4::INTEGER AS joint_states, (3 + 12 + 4 * 2 + 4 * 3)::INTEGER AS joint_parameters, 2 * (1 + 2 + 2 + 2)::INTEGER AS separate_parameters FROM m a JOIN m b ON a.series_id < b.series_id"""
)
def product_chains(spark, sf_dir):
    """Any two conditions' chains as one of four states: the second eigenvalue of the product, found by decomposing it, is
    the larger of theirs, and its parameters are many more."""
    last = wf.known_rates(grid(spark, sf_dir)).groupBy("series_id").agg(F.max_by(F.struct("entry", "stay"), "known_month").alias("r"))
    chain = F.array(F.array(1 - F.col("r.entry"), F.col("r.entry")), F.array(1 - F.col("r.stay"), F.col("r.stay")))
    chains = stored(last.select("series_id", chain.alias("m")), "chains")
    a, b = chains.toDF("first", "a"), chains.toDF("second", "b")
    both = a.join(b, F.col("first") < F.col("second")).withColumn("joint", algebra.kron_matrix(F.col("a"), F.col("b")))  # pairs of series
    rows = second_moduli(both, {"of_a": "a", "of_b": "b", "second_modulus": "joint"})
    k, j = F.size("a"), F.size("joint")
    return rows.select(
        "first", "second", "second_modulus", pr.half_life(F.col("second_modulus")).alias("half_life"), (F.col("second_modulus") - F.greatest("of_a", "of_b")).alias("residual"), j.alias("joint_states"),
        algebra.free_parameters(j, F.lit(2)).alias("joint_parameters"), (algebra.free_parameters(k, F.lit(1)) + algebra.free_parameters(F.size("b"), F.lit(1))).alias("separate_parameters"),
    )
