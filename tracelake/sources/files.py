"""Readers and writers of the file formats around score tables and corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCORE = "idx bigint, id bigint, score double"


def parquet(spark: SparkSession, *paths: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(*paths)
    return df.select(*columns) if columns else df


def strict_scores(spark: SparkSession, path: str) -> DataFrame:
    """Score rows; a malformed line fails the read, a null key or score too."""
    df = spark.read.schema(SCORE).option("mode", "FAILFAST").json(path)
    bad = F.col("id").isNull() | F.col("score").isNull()
    return df.where(F.when(bad, F.raise_error(F.lit("a score row lacks id or score")).cast("boolean")).otherwise(True))


def lenient_scores(spark: SparkSession, path: str) -> DataFrame:
    """Score rows; malformed lines and scores that are no numbers are skipped."""
    raw = spark.read.schema("idx bigint, id bigint, score string, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return raw.where("_bad is null").select("idx", "id", F.col("score").try_cast("double").alias("score")).where("score is not null")


def metric_files(spark: SparkSession, glob: str) -> DataFrame:
    """``attack, auroc``: one JSON document per file, the attack is the file's stem; ``auroc``, else ``roc_auc``, as percent."""
    df = spark.read.schema("auroc double, roc_auc double").option("multiLine", True).json(glob)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return df.select(stem.alias("attack"), F.round(100 * F.coalesce("auroc", "roc_auc"), 2).alias("auroc"))


def auroc_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="attack string, auroc double")


def ground_truths(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of a text file; of a file that ends in ``.json`` the non-blank entries of its one list of texts."""
    if path.endswith(".json"):
        listed = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", "array<string>")).alias("value"))
    else:
        listed = spark.read.text(path)
    return listed.where(F.trim("value") != "").select(F.col("value").alias("ground_truth"))


def json_rows(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    """JSON Lines, or files of one document or list each, under an explicit ``schema``; what doesn't fit it is null."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def named_split(spark: SparkSession, root: str, name: str, split: str = "train") -> DataFrame:
    """A dataset by name and split below ``root``: the Parquet, JSON Lines or CSV files of ``root/name/split``; an error if there are none."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/{split}")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    for ending, read in ((".parquet", spark.read.parquet), (".jsonl", spark.read.json), (".csv", spark.read.option("header", True).csv)):
        if any(n.endswith(ending) for n in names):
            return read(f"{folder}/*{ending}")
    raise FileNotFoundError(f"no dataset {name} with split {split} below {root}")


def shared_copy(spark: SparkSession, uri: str, cache: str) -> str:
    """The path of a copy of ``uri`` below ``cache``, a folder that all executors share; made once, under a hash of the address.

    Spark reads remote files by itself; a copy is for what is read many times. It is written beside its place
    and then moved there, so that a run that breaks off leaves nothing half done.
    """
    import hashlib

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    source = path(uri)
    target = path(f"{cache}/{hashlib.md5(uri.encode()).hexdigest()}/{source.getName()}")
    there = target.getFileSystem(conf)
    if not there.exists(target):
        partial = path(f"{target}.part")
        there.mkdirs(target.getParent())
        jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, there, partial, False, True, conf)
        there.rename(partial, target)
    return target.toString()


def markdown_corpus(spark: SparkSession, glob: str) -> DataFrame:
    """``id, text``: whole files; the id is the name of their folder."""
    df = spark.read.option("wholetext", True).text(glob)
    return df.select(F.try_element_at(F.split(F.input_file_name(), "/"), F.lit(-2)).alias("id"), F.col("value").alias("text"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON document a line."""
    df.write.mode(mode).json(path)


def write_train(df: DataFrame, folder: str, name: str = "train", copy_to: str | None = None) -> str:
    """The table as Parquet below ``folder``, and once more below ``copy_to``; the path of the first."""
    path = f"{folder}/{name}.parquet"
    df.write.mode("overwrite").parquet(path)
    if copy_to:
        df.sparkSession.read.parquet(path).write.mode("overwrite").parquet(f"{copy_to}/{name}.parquet")
    return path


def write_by_membership(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("is_member").json(path)


def write_results(df: DataFrame, summary: dict, folder: str, stem: str) -> dict[str, str]:
    """Rows per example and their summary: all, members and non-members, under names that fit a file system.

    The rows, which may be many, are written by their tasks; the summary is one document. Returns the paths.
    """
    import json

    name = result_name(stem)
    paths = {"all": f"{folder}/{name}", "members": f"{folder}/{name}_members", "nonmembers": f"{folder}/{name}_nonmembers", "summary": f"{folder}/{name}_summary"}
    df.write.mode("overwrite").json(paths["all"])
    stored = df.sparkSession.read.schema(df.schema).json(paths["all"])
    stored.where("is_member").write.mode("overwrite").json(paths["members"])
    stored.where("not is_member").write.mode("overwrite").json(paths["nonmembers"])
    df.sparkSession.createDataFrame([(json.dumps(summary, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(paths["summary"])
    return paths


def write_leaderboard(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """``attack, auroc`` with the three summary rows behind: the best, and the means of the five and ten best.

    A leaderboard has a row per score and is written as one file, best first.
    """
    from pyspark.sql import Window

    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("auroc"), "attack")))  # a row per score
    top = [ranked.where(F.col("rn") <= n).agg(F.lit(label).alias("attack"), F.round(F.avg("auroc"), 2).alias("auroc"), F.lit(10**9 + n).alias("rn")) for n, label in ((1, "top1"), (5, "top5_mean"), (10, "top10_mean"))]
    both = ranked.select("attack", "auroc", "rn")
    for t in top:
        both = both.unionByName(t)
    out = both.coalesce(1).sortWithinPartitions("rn").select("attack", "auroc").write.mode("overwrite")
    out.option("header", True).csv(path) if kind == "csv" else out.json(path)


def dump_generations(df: DataFrame, folder: str, step: int) -> str:
    """``input, output, score`` and further columns of one step as JSON Lines, in a folder of its own; a step written again replaces the old one."""
    path = f"{folder}/step={int(step)}"
    df.write.mode("overwrite").json(path)
    return path


def result_name(stem: str, limit: int = 200) -> str:
    """``stem``, or if it is longer than ``limit`` its ends around a hash of the whole."""
    import hashlib

    if len(stem) <= limit:
        return stem
    h = hashlib.md5(stem.encode()).hexdigest()[:12]
    side = (limit - len(h) - 2) // 2
    return f"{stem[:side]}_{h}_{stem[-side:]}"


def index_keys(df: DataFrame, key: str) -> DataFrame:
    """``is_member, key``: the keys of a sample, one a row and in order, to be written beside its manifest."""
    return df.select("is_member", F.col(key).alias("key")).distinct().sort("is_member", "key")


def index_manifest(df: DataFrame, key: str, seed: int) -> DataFrame:
    """``is_member, seed, n, first, last``: what a sample holds; the keys themselves are :func:`index_keys`."""
    return df.groupBy("is_member").agg(F.lit(seed).alias("seed"), F.count("*").alias("n"), F.min(key).alias("first"), F.max(key).alias("last"))


def read_or_compute(spark: SparkSession, path: str, compute) -> DataFrame:
    """What stands at ``path``, written there first if nothing does."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
