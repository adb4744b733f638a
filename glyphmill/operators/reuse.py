"""Results of stages that later runs read in place of computing them again."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators.storage import fresh_path, shared_dir

_ENTRY = "key string, path string, at timestamp"


def input_state(spark: SparkSession, paths: list[str]) -> str:
    """Changes when a file under `paths` comes, goes or is written again: from the files' names, lengths and times, in any order. Contents are not read."""
    if not paths:
        return ""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length", "modificationTime")
    each = [F.xxhash64(F.lit(seed), "path", "length", "modificationTime") for seed in (1, 2)]
    row = files.select(*(h.alias(f"h{i}") for i, h in enumerate(each))).agg(F.count(F.lit(1)), *(F.bit_xor(f"h{i}") for i in range(2)), *(F.sum(F.col(f"h{i}") % 1_000_003) for i in range(2))).first()
    return ":".join(map(str, row))


def reused(stage: DataFrame, name: str, *, inputs: list[str] | None = None, parameters: dict | None = None, folder: str | None = None) -> DataFrame:
    """`stage` as written by an earlier run with the same name, parameters, schema, plan and input files; else it is computed, written and published.

    `inputs` are the files or folders that it reads, by default those that Spark finds in its plan. What Python functions inside do is not part of a plan: their
    versions belong into `parameters`. The manifest in `folder` (the shared folder) gets its entry, by an atomic commit of its own, only once
    the data are written whole, so a run that breaks off publishes nothing. Of two runs that publish at once the later is read. An entry whose
    data are gone counts as none.
    """
    spark = stage.sparkSession
    root = folder or shared_dir(spark)
    manifest = f"{root}/reuse-manifest"
    files = stage.inputFiles() if inputs is None else inputs
    what = [name, repr(sorted((parameters or {}).items())), stage.schema.json(), str(stage.semanticHash()), input_state(spark, list(files))]
    key = hashlib.sha256("\n".join(what).encode()).hexdigest()
    try:
        entry = spark.read.schema(_ENTRY).json(manifest).where(F.col("key") == key).orderBy(F.desc("at"), "path").first()
        if entry:
            return spark.read.schema(stage.schema).parquet(entry["path"])
    except AnalysisException:  # no manifest yet, or data that are gone
        pass
    path = f"{root}/{fresh_path(spark, f'reuse-{name}').rsplit('/', 1)[1]}"
    stage.write.parquet(path)
    spark.createDataFrame([(key, path)], "key string, path string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(manifest)
    return spark.read.schema(stage.schema).parquet(path)
