"""Ordered folds over keyed rows, in bounded memory.

Rows are dealt by key, sorted by key and order within each partition, and streamed through a
step object per key.  A key's history is never gathered: what is held is one Arrow batch and
one step object, however long the key.  A fold may begin with the states that an earlier one left
(:func:`states`).  The same step objects serve Structured Streaming (:mod:`tarnwatch.streaming`), so batch
and stream agree by construction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import state

STATE = "_tarnwatch_state"


class Step:
    """State of one key.  ``inputs`` names the columns handed to :meth:`update`; ``fields`` what it returns."""

    inputs: tuple[str, ...] = ("value",)
    fields: tuple[tuple[str, str], ...] = ()

    def update(self, *values):
        """Takes one row in; a tuple of the fields, or None to emit nothing."""
        raise NotImplementedError

    def update_many(self, columns: list[list]) -> list:
        """The results of consecutive rows of the key; steps with a form for whole columns override it."""
        return list(map(self.update, *columns))


def run_rows(pdfs: Iterator[pd.DataFrame], keys: list[str], carry: list[str], make: Callable[[], Step], columns: list[str], last: bool = False) -> Iterator[pd.DataFrame]:
    """Each row's output, or (``last``) each key's state after its last row."""
    current, step = None, None
    inputs = make().inputs
    for pdf in pdfs:
        if not len(pdf):
            continue
        key_rows = list(zip(*[pdf[k] for k in keys], strict=True)) if keys else [()] * len(pdf)
        heads = pdf[STATE].tolist() if STATE in pdf.columns else None
        values = [pdf[c].tolist() for c in inputs]
        cuts = [0, *[n for n in range(1, len(key_rows)) if key_rows[n] != key_rows[n - 1]], len(key_rows)]
        kept, out, ended = [], [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if step is None or key_rows[a] != current:
                if last and step is not None:
                    ended.append((*current, state.dump(step)))
                current, step = key_rows[a], make()
            if heads is not None and heads[a] is not None:
                step, a = state.load(heads[a], step), a + 1
            for n, got in enumerate(step.update_many([v[a:b] for v in values]) if a < b else (), a):
                if got is not None and not last:
                    kept.append(n)
                    out.append(got)
        if last:
            yield pd.DataFrame(ended, columns=[*keys, "state"])
            continue
        left = pdf[[*keys, *carry]].iloc[kept].reset_index(drop=True)
        yield pd.concat([left, pd.DataFrame(out, columns=columns)], axis=1)
    if last and step is not None:
        yield pd.DataFrame([(*current, state.dump(step))], columns=[*keys, "state"])


def _dealt(df: DataFrame, keys: list[str], order: list[str], need: list[str], initial: DataFrame | None) -> DataFrame:
    """Rows by key and in order, with what a step needs; what only the order needs stays out of Python."""
    kept = need
    need = list(dict.fromkeys([*need, *order]))
    rows = df.select(*need)
    if initial is not None:
        heads = initial.select(*[c if c in keys else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in need], F.col("state").alias(STATE))
        rows = rows.withColumn(STATE, F.lit(None).cast("binary")).unionByName(heads)
    rows = rows.repartition(*keys) if keys else rows.coalesce(1)
    return rows.sortWithinPartitions(*keys, *([F.col(STATE).isNull()] if initial is not None else []), *order).select(*kept, *([STATE] if initial is not None else []))


def _named(df: DataFrame, renamed: dict[str, str]) -> DataFrame:
    return df.withColumns({name: df[column] for name, column in renamed.items()})


def fold(df: DataFrame, keys: list[str], order: list[str], carry: list[str], make: Callable[[], Step], initial: DataFrame | None = None, **renamed: str) -> DataFrame:
    """Output fields of each row's step beside its keys and carried columns.

    ``renamed`` maps a step's input names to columns of ``df``; ``initial`` has the keys' states before.
    """
    step, df = make(), _named(df, renamed)
    need = list(dict.fromkeys([*keys, *carry, *step.inputs]))
    kinds = [df.schema[c] for c in dict.fromkeys([*keys, *carry])]
    schema = T.StructType([*kinds, *T._parse_datatype_string(", ".join(f"{n} {k}" for n, k in step.fields)).fields])
    columns = [n for n, _ in step.fields]
    carried = [c for c in dict.fromkeys(carry) if c not in keys]
    return _dealt(df, keys, order, need, initial).mapInPandas(lambda it: run_rows(it, keys, carried, make, columns), schema)


def states(df: DataFrame, keys: list[str], order: list[str], make: Callable[[], Step], initial: DataFrame | None = None, **renamed: str) -> DataFrame:
    """The keys and ``state`` (binary) after each key's last row, to begin a later fold with."""
    df = _named(df, renamed)
    need = list(dict.fromkeys([*keys, *make().inputs]))
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("state", T.BinaryType())])
    return _dealt(df, keys, order, need, initial).mapInPandas(lambda it: run_rows(it, keys, [], make, [], True), schema)
