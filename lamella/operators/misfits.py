"""Rows that a narrowing reader would refuse, counted instead of raised."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.plans.schema import Option, Primitive, Struct, bare


def misfits(df: DataFrame, writer: Struct, reader: Struct) -> DataFrame:
    """path, rows: for every top-level integer whose range shrank, how many values of df no longer fit."""
    known = {f.name: f for f in writer.fields}
    counts = []
    for f in reader.fields:
        found = next((known[n] for n in f.names if n in known), None)
        if found is None:
            continue
        w, r = bare(found.node), bare(f.node)
        w, r = (bare(x.inner) if isinstance(x, Option) else x for x in (w, r))
        if isinstance(w, Primitive) and isinstance(r, Primitive) and w.integer and r.integer and max(w.width, r.width) < 16:
            low, high = r.bounds()
            if low > w.bounds()[0] or high < w.bounds()[1]:
                c = F.col(f"`{found.name}`")
                counts.append((f.name, F.count_if((c < F.lit(low).cast("decimal(20,0)")) | (c > F.lit(high).cast("decimal(20,0)")))))
    if not counts:
        return df.sparkSession.createDataFrame([], "path string, rows long")
    one = df.agg(*[c.alias(n) for n, c in counts])  # one row, a partial sum in every task
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("path"), F.col(f"`{n}`").cast("long").alias("rows")) for n, _ in counts])).alias("x")).select("x.path", "x.rows")
