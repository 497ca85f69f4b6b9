"""The batch folds' step objects as keyed streaming state.

Rows of a key are sorted inside each micro-batch by the given order; the step, as checked and versioned
JSON, is the state.  Idle keys are evicted by a processing-time timeout.  With a watermark, rows that
are later than it are dropped before they reach a step (a step never goes back in time); without one,
late rows are folded in when they come.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import state as states
from ..plans.fold import Step


def stream_fold(df: DataFrame, keys: list[str], order: list[str], carry: list[str], make: Callable[[], Step], ttl_ms: int | None = None, watermark: tuple[str, str] | None = None, **renamed: str) -> DataFrame:
    """Streaming twin of :func:`tarnwatch.plans.fold.fold`; ``watermark`` is (event-time column, delay)."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    df = df.withColumns({name: F.col(column) for name, column in renamed.items()}) if renamed else df
    if watermark:
        df = df.withWatermark(*watermark)

    step = make()
    carried = [c for c in carry if c not in keys]
    fields = [df.schema[c] for c in [*keys, *carried]]
    schema = T.StructType([*fields, *T._parse_datatype_string(", ".join(f"{n} {k}" for n, k in step.fields)).fields])
    names = [n for n, _ in step.fields]

    def run(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        held = states.load(state.get[0], make()) if state.exists else make()
        rows = pd.concat(list(pdfs)).sort_values(order)
        out = []
        for row, values in zip(rows[carried].itertuples(index=False), rows[list(held.inputs)].itertuples(index=False), strict=True):
            got = held.update(*values)
            if got is not None:
                out.append((*key, *row, *got))
        state.update((states.dump(held),))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=[*keys, *carried, *names])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms is not None else GroupStateTimeout.NoTimeout
    return df.groupBy(*keys).applyInPandasWithState(run, schema, "step binary", "append", timeout)


def score_stream(df: DataFrame, model, **how) -> DataFrame:
    """A frozen forest applied to a stream; between micro-batches the model may be replaced (see :func:`learner`)."""
    return model.score(df, **how)


def learner(model_box: list, sink: Callable[[DataFrame, int], None], **how):
    """``foreachBatch`` function: scores a micro-batch with the model so far, then lets the model learn from it.

    Every version's sample is written to the checkpoint folder and read from there, so lineage does not grow, and
    the version before is released."""

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        before = model_box[0]
        sink(before.score(batch, **how), number)
        model_box[0] = before.update(batch).settled()
        before.release()
        batch.unpersist()

    return run


def csv_points(lines: DataFrame, width: int, column: str = "value") -> DataFrame:
    """Points of a stream or table of comma-separated lines; lines of another width or with other cells are no points."""
    cells = F.transform(F.split(F.trim(column), r"\s*,\s*"), lambda c: c.try_cast("double"))
    return lines.withColumn("features", cells).where((F.size("features") == width) & ~F.exists("features", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))


def score_lines(lines: DataFrame, model, threshold: float, column: str = "value") -> DataFrame:
    """``score,is_anomaly`` for each line of points."""
    scored = model.score(csv_points(lines, model.params.dimension, column))
    return scored.select(F.concat_ws(",", F.round("score", 6), F.col("score") > threshold).alias("value"))
