"""Between the array layout (one row per measurement) and the long layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def explode_image(df: DataFrame, image: str = "measurement_data") -> DataFrame:
    """Image cells to pixel rows. A row expands inside its own task, so a
    reduction that follows combines before anything is shuffled."""
    rest = [c for c in df.columns if c != image]
    rows = df.select(*rest, F.posexplode(image).alias("row_idx", "_line"))
    return rows.select(
        *rest, "row_idx", F.posexplode("_line").alias("col_idx", "value")
    )


def explode_profile(
    df: DataFrame, profile: str = "radial_profile_data", q: str | None = None
) -> DataFrame:
    """Profile cells to point rows with ``pos``, ``intensity``, ``n_points``."""
    rest = [c for c in df.columns if c not in {profile, q}]
    cells = df.select(
        *rest,
        *([q] if q else []),
        F.size(profile).alias("n_points"),
        F.posexplode(profile).alias("pos", "intensity"),
    )
    if q:
        cells = cells.withColumn("q", F.get(q, F.col("pos"))).drop(q)
    return cells


def collect_profile(
    df: DataFrame, keys: list[str], pos: str, values: dict[str, str]
) -> DataFrame:
    """Point rows to one row of ordered arrays per key. A group holds the
    points of one profile, at most the number of bins."""
    points = F.sort_array(F.collect_list(F.struct(pos, *values)))
    out = df.groupBy(*keys).agg(points.alias("_points"))
    return out.select(
        *keys,
        *[F.col(f"_points.{v}").alias(name) for v, name in values.items()],
    )


def dense_profile(
    df: DataFrame, keys: list[str], npt: int, values: dict[str, str], q: str
) -> DataFrame:
    """Binned point rows (with ``q_first``, ``q_step``) to arrays of ``npt``
    values per key; an empty bin is 0 and keeps its q."""
    out = df.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("pos", F.struct(*values)))).alias(
            "_cells"
        ),
        F.max("q_first").alias("_first"),
        F.max("q_step").alias("_step"),
    )
    bins = F.sequence(F.lit(0), F.lit(npt - 1))

    def filled(value: str):
        return F.transform(
            bins,
            lambda p: F.coalesce(
                F.try_element_at("_cells", p).getField(value), F.lit(0.0)
            ),
        )

    return out.select(
        *keys,
        F.transform(bins, lambda p: F.col("_first") + (p + 0.5) * F.col("_step")).alias(q),
        *[filled(v).alias(name) for v, name in values.items()],
    )


def collect_image(
    df: DataFrame,
    keys: list[str],
    n_rows: int,
    n_cols: int,
    value: str = "value",
    name: str = "measurement_data",
) -> DataFrame:
    """Pixel rows to one dense image cell per key, absent pixels 0. Lines are
    built first, so a group never exceeds one detector line or one column."""
    cells = df.groupBy(*keys, "row_idx").agg(
        F.map_from_entries(
            F.collect_list(F.struct("col_idx", F.col(value).cast("double")))
        ).alias("_cells")
    )
    line = F.transform(
        F.sequence(F.lit(0), F.lit(n_cols - 1)),
        lambda c: F.coalesce(F.try_element_at("_cells", c), F.lit(0.0)),
    )
    lines = cells.select(*keys, "row_idx", line.alias("_line"))
    stacked = lines.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("row_idx", "_line"))).alias("_rows")
    )
    blank = F.array_repeat(F.lit(0.0), n_cols)
    return stacked.select(
        *keys,
        F.transform(
            F.sequence(F.lit(0), F.lit(n_rows - 1)),
            lambda r: F.coalesce(F.try_element_at("_rows", r), blank),
        ).alias(name),
    )
