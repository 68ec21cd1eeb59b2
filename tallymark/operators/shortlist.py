"""Shortlists for all entities and axes at once: blocked products, bounded lists in the tasks, one merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import TextConfig

#: Axes travel with the tasks: their bytes, cells of a block of cosines, and rows that a task holds before it hands them on.
AXIS_BYTES, CELLS, HELD = 8 << 20, 1 << 21, 1 << 18


def cosines(rows: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Cosines of rows to axes, 0 where a side is zero; summed dimension by dimension, so equal rows have equal cosines wherever they stand."""
    dot, a, b = np.zeros((len(rows), len(axes))), np.zeros(len(rows)), np.zeros(len(axes))
    for j in range(rows.shape[1]):
        x, y = rows[:, j], axes[:, j]
        dot += x[:, None] * y
        a += x * x
        b += y * y
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(dot / (np.sqrt(a)[:, None] * np.sqrt(b)), nan=0.0, posinf=0.0, neginf=0.0)


def _best(found: pd.DataFrame, top_k: int) -> pd.DataFrame:
    s = found.sort_values(["cosine", "seq"], ascending=[False, True], kind="stable")
    return s[s.groupby(["entity", "axis"], dropna=False, sort=False).cumcount() < top_k]


def shortlists(snippets: DataFrame, axes: dict[str, list[float]], entity: str = "entity_id", seq: str = "seq", vector: str = "vector", cfg: TextConfig = TextConfig(), most: int = HELD) -> DataFrame:
    """(entity, axis, place, seq, cosine): the top rows of each entity by cosine to each axis, from the least cosine on, ties by seq.

    Each task keeps the best rows of the pairs (entity, axis) that it has seen and hands them on when it holds more than `most`,
    so of an entity with any number of snippets a task sends top_k rows each time; a window with a limit, which
    Spark applies before its shuffle too, merges them. Vectors that are null, of another length than the axes or
    with a null component are left out, a null entity is an entity, seq must not be null. No axes give no rows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in snippets.schema}
    made = f"entity {kinds[entity]}, axis string, seq {kinds[seq]}, cosine double"
    names, matrix = list(axes), np.array(list(axes.values()), dtype=np.float64)
    if matrix.nbytes > AXIS_BYTES:
        raise ValueError(f"axes have {matrix.nbytes} bytes, {AXIS_BYTES} at most")
    width, least, top_k = matrix.shape[-1] if names else 0, cfg.min_cosine, cfg.top_k

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held = None, None
        for batch in batches:
            schema = pa.schema([("entity", batch.schema.field(0).type), ("axis", pa.string()), ("seq", batch.schema.field(1).type), ("cosine", pa.float64())])
            block = max(CELLS // len(names), 1)
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                cos = cosines(part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width), matrix)
                row, axis = np.nonzero(cos >= least)
                ent, num = part.column(0).to_pandas().to_numpy(dtype=object), part.column(1).to_pandas().to_numpy()
                found = pd.DataFrame({"entity": ent[row], "axis": axis, "seq": num[row], "cosine": cos[row, axis]})
                held = found if held is None else pd.concat([held, found], ignore_index=True)
                if len(held) > most:
                    held = _best(held, top_k)
                    if len(held) > most // 2:
                        yield frame(held, schema)
                        held = None
        if held is not None and len(held):
            yield frame(_best(held, top_k), schema)

    def frame(best: pd.DataFrame, schema: pa.Schema) -> pa.RecordBatch:
        columns = [best["entity"].tolist(), [names[i] for i in best["axis"]], best["seq"], best["cosine"]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=True) for c, f in zip(columns, schema)], schema=schema)

    v = F.col(vector).cast("array<double>")
    whole = snippets.select(F.col(entity), F.col(seq), v.alias("_vector"))
    whole = whole.where((F.size("_vector") == width) & F.forall("_vector", lambda c: c.isNotNull())) if names else whole.limit(0)
    best = whole.mapInArrow(local, made)
    place = F.row_number().over(Window.partitionBy("entity", "axis").orderBy(F.desc("cosine"), "seq"))
    return best.withColumn("place", place).where(F.col("place") <= top_k).select(F.col("entity").alias(entity), "axis", "place", F.col("seq").alias(seq), "cosine")
