"""Validation of path manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalized(path: Column) -> Column:
    """Is the path free of repeated, trailing and dot segments? The root and one leading pair of
    slashes are allowed."""
    body = F.regexp_replace(path, "^//?", "")
    return (path != "") & ~body.contains("//") & ~body.startswith("/") & ((body == "") | ~body.endswith("/")) & ~F.concat(F.lit("/"), body, F.lit("/")).contains("/./") | (path == ".")


def path_manifest_check(paths: DataFrame, existing: DataFrame, share_dir: str, here: str = "/work") -> DataFrame:
    """(path, out_path, error): the first rule that a path breaks, else where it is shared.

    ``existing`` lists the paths that exist. Duplicates are found after relative paths are made
    absolute in ``here``; counts are summed before the shuffle and joined back."""
    path = F.col("path")
    absolute = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(here.rstrip("/") + "/"), path))
    known = existing.select("path").distinct().withColumn("_there", F.lit(True))
    checked = paths.withColumn("_absolute", absolute).join(known, "path", "left")
    often = checked.groupBy("_absolute").agg(F.count("*").alias("_n"))
    base = F.substring_index(path, "/", -1)
    return checked.join(often, "_absolute").select(
        "path",
        F.when(base.startswith("."), "hidden")
        .when(path.contains(".."), "parent")
        .when(~normalized(path), "not normalized")
        .when(F.col("_there").isNull(), "missing")
        .when(F.col("_n") > 1, "duplicate")
        .alias("error"),
        "_absolute",
    ).select("path", F.when(F.col("error").isNull(), F.concat(F.lit(share_dir.rstrip("/")), F.col("_absolute"))).alias("out_path"), "error")
