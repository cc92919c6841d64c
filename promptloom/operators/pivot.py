"""Files of a case: long rows, wide rows and maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The file paths of the wide corpus, and the text of a file a case does not have.
FILE_PATHS = [
    "0/nuTilda", "system/controlDict", "system/fvSchemes", "0/p",
    "constant/turbulenceProperties", "system/fvSolution", "0/nut", "0/k", "0/U",
    "constant/transportProperties", "0/epsilon", "0/sigma", "constant/fvOptions", "0/omega",
    "0/s", "constant/MRFProperties", "constant/dynamicMeshDict", "system/topoSetDict",
]
ABSENT = "NONE"


def _known(df: DataFrame, name: str, names: list[str], on_unknown: str) -> DataFrame:
    known = F.col(name).isin(names)
    if on_unknown == "drop":
        return df.filter(known)
    if on_unknown != "error":
        raise ValueError("on_unknown is 'error' or 'drop'")
    failure = F.raise_error(F.concat(F.lit("unknown file name: "), F.col(name)))
    return df.withColumn(name, F.when(known, F.col(name)).otherwise(failure))


def pivot_files(
    df: DataFrame, keys: list[str], name: str, value: str, names: list[str],
    on_unknown: str = "error",
) -> DataFrame:
    """One row per case and one column per declared name; an absent file is ``NONE``.

    The names are declared, so there is no extra job to find them, and a hot case shrinks to one
    row per map task before the shuffle.
    """
    wide = (
        _known(df, name, names, on_unknown)
        .groupBy(*keys)
        .pivot(name, names)
        .agg(F.first(value, ignorenulls=True))
    )
    return wide.na.fill(ABSENT, subset=names)


def unpivot_files(
    df: DataFrame, keys: list[str], names: list[str], name: str = "path", value: str = "content"
) -> DataFrame:
    """Wide rows back to one row per file.  A file whose text is ``NONE`` cannot be told apart
    from an absent one and is left out with it."""
    return df.unpivot(keys, names, name, value).filter(F.col(value) != ABSENT)


def _file_map(files) -> Column:
    return F.from_json(files, "map<string,string>")


def raw_to_files(
    df: DataFrame, keys: list[str], paths: str, files: str, on_missing: str = "error"
) -> DataFrame:
    """Raw corpus rows (path list and JSON object of texts) as long rows; no shuffle.

    A broken object, or a listed path that it lacks, is an error; with ``on_missing='null'`` the
    content is null instead.  ``broken_files`` lists such rows.
    """
    if on_missing not in ("error", "null"):
        raise ValueError("on_missing is 'error' or 'null'")
    mapped = df.withColumn("_map", _file_map(files))
    found = F.try_element_at("_map", F.col("path"))
    if on_missing == "error":
        there = F.coalesce(F.map_contains_key("_map", F.col("path")), F.lit(False))
        failure = F.concat(F.lit("no content for file "), F.coalesce("path", F.lit("(null)")))
        found = F.when(there, found).otherwise(F.raise_error(failure))
    return mapped.select(*keys, "_map", F.explode(paths).alias("path")).select(
        *keys, "path", found.alias("content")
    )


def broken_files(df: DataFrame, keys: list[str], paths: str, files: str) -> DataFrame:
    """``keys, path`` of the listed files whose object is broken or lacks them."""
    rows = df.select(*keys, _file_map(files).alias("_map"), F.explode(paths).alias("path"))
    there = F.coalesce(F.map_contains_key("_map", F.col("path")), F.lit(False))
    return rows.filter(~there).select(*keys, "path")


def files_map(
    df: DataFrame, key: str, order: str, name: Column, value: str, most: int = 256
) -> DataFrame:
    """``key, volume, file_tree, files``: the files of a case as a list of names and a map.

    ``order`` is an integer, unique in the case; a volume holds at most ``most`` files, so that
    a case of any size stays in rows of bounded size.
    """
    entries = F.array_sort(
        F.collect_list(F.struct(F.col(order).alias("o"), name.alias("k"), F.col(value).alias("v")))
    )
    gathered = df.groupBy(key, F.floor(F.col(order) / most).alias("volume")).agg(
        entries.alias("_files")
    )
    return gathered.select(
        key, "volume",
        F.transform("_files", lambda e: e.k).alias("file_tree"),
        F.map_from_arrays(
            F.transform("_files", lambda e: e.k), F.transform("_files", lambda e: e.v)
        ).alias("files"),
    )


def path_vocabulary(df: DataFrame, paths) -> DataFrame:
    """Every path with the number of rows and of places it occurs in."""
    # one entry a place and one a distinct path, summed before the shuffle
    def entries(column, row: int, place: int) -> Column:
        return F.transform(
            column, lambda p: F.struct(p.alias("path"), F.lit(row).alias("_r"), F.lit(place).alias("_n"))
        )

    counted = df.select(F.inline(F.concat(entries(paths, 0, 1), entries(F.array_distinct(paths), 1, 0))))
    return counted.groupBy("path").agg(
        F.sum("_r").alias("n_rows"), F.sum("_n").alias("occurrences")
    )


def new_paths(df: DataFrame, seen: DataFrame, paths) -> DataFrame:
    """Distinct paths of ``df`` that never occur in ``seen``."""
    found = df.select(F.explode(paths).alias("path")).distinct()
    return found.subtract(seen.select(F.explode(paths).alias("path")).distinct())
