"""Tables, annotation logs, exclusion logs, label bundles and run records."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenrank.schemas import EXCLUSIONS, PAIRWISE, RATINGS, conform, empty_table


def _missing(error: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error)


#: CSV as it is written and read: quotes are doubled, values keep their spaces and line breaks (so a file is read by one task).
_CSV = {"header": True, "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _rename(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"cannot rename {source} to {target}")


def _beside(spark: SparkSession, path: str) -> tuple:
    """The file system, the table's path, and what a swap may have left beside it, by kind (tmp, ready, old)."""
    fs, target = _filesystem(spark, path.rstrip("/"))
    left = {}
    if target.getParent() is not None and fs.exists(target.getParent()):
        for kind in ("tmp", "ready", "old"):
            found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f"{target.getName()}__{kind}_*"))
            left[kind] = sorted((x.getPath() for x in found or []), key=str)
    return fs, target, left


def _current(spark: SparkSession, path: str) -> str:
    """Where a table is read. In the middle of a swap, when its path is missing, that is the new table, which is whole."""
    fs, target, left = _beside(spark, path)
    if not fs.exists(target):
        for kind in ("ready", "old"):
            if left.get(kind):
                return str(left[kind][-1])
    return path


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet or CSV table by suffix, with the columns of schema by name; an empty table where there is none.

    A table whose replacement broke off is read as it was before or after, whole.
    """
    found = _current(spark, path)
    try:
        df = spark.read.options(**_CSV).csv(found) if path.rstrip("/").endswith(".csv") else spark.read.parquet(found)
    except AnalysisException as error:
        if not _missing(error):
            raise
        return empty_table(spark, schema)
    return conform(df, schema)


def _settled(spark: SparkSession, path: str) -> tuple:
    """As _beside, after a swap that broke off was brought to its end."""
    fs, target, left = _beside(spark, path)
    if not fs.exists(target) and (left.get("ready") or left.get("old")):
        _rename(fs, (left["ready"] or left["old"])[-1], target)
        fs, target, left = _beside(spark, path)
    return fs, target, left


def append_table(df: DataFrame, path: str) -> None:
    """Add rows to a Parquet table, by one writer at a time. The rows that are there are neither read nor written again.

    Where the appending breaks off, the table has none or some of the rows; a writer that adds what is missing by key ends with all. If
    columns or types differ from the table's, it is replaced by both, with nulls where a column is missing.
    """
    spark = df.sparkSession
    fs, target, _ = _settled(spark, path)
    if fs.exists(target):
        try:
            old = spark.read.parquet(path)
        except AnalysisException as error:
            if not _missing(error):
                raise
        else:
            if dict(old.dtypes) != dict(df.dtypes):
                return write_table(old.unionByName(df, allowMissingColumns=True), path)
    df.write.mode("append").parquet(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace a Parquet or CSV table, by one writer at a time. df may read the old one. In a CSV table an empty text is null.

    The new table is written beside the old one and marked as ready by a rename; then the old one is put aside, the new
    one takes its place, and the old one is deleted. Each step is one rename: wherever it breaks off, read_table
    finds the old table or the new one, and the next write clears up.
    """
    spark = df.sparkSession
    fs, target, left = _settled(spark, path)
    own = uuid.uuid4().hex
    at = lambda kind: spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}__{kind}_{own}")
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    if path.rstrip("/").endswith(".csv"):
        writer.options(**{k: v for k, v in _CSV.items() if k != "multiLine"}).csv(str(at("tmp")))
    else:
        writer.parquet(str(at("tmp")))
    _rename(fs, at("tmp"), at("ready"))
    if fs.exists(target):
        _rename(fs, target, at("old"))
    _rename(fs, at("ready"), target)
    for rest in [at("old"), *[x for kind in left.values() for x in kind]]:
        fs.delete(rest, True)


#: Folders that appended rows are dealt to, by rater.
BUCKETS = 16


def _record(spark: SparkSession, path: str) -> dict:
    """The record of a compaction (Spark's readers pass over files whose names begin so)."""
    fs, at = _filesystem(spark, path)
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _listed(spark: SparkSession, folder: str) -> tuple[list[str], list[str], list[str]]:
    """Paths of the CSV files, of appended Parquet files and of other Parquet files of a folder.

    The last compaction of each log says which files it has merged; they do not count, even where they are still there.
    """
    fs, root = _filesystem(spark, folder)
    files, found = fs.listFiles(root, True), []
    while files.hasNext():
        found.append(files.next().getPath().toString())
    last: dict[str, str] = {}
    for path in sorted(x for x in found if _COMPACTION.search(x)):
        last[path.rsplit("/", 1)[0]] = path
    merged, live = set(), set()
    for path in last.values():
        said = _record(spark, path)
        merged |= set(said["merged"])
        live.add(f"{path.rsplit('/', 1)[0]}/{said['folder']}/")
    inner = lambda path: path[len(root.toString()) :]
    parquet = [x for x in found if x.endswith(".parquet") and x not in merged and (any(x.startswith(k) for k in live) or not re.search("/[_.]", inner(x)))]
    own = [x for x in parquet if "/bucket=" in x]
    return [x for x in found if x.endswith(".csv") and not re.search("/[_.]", inner(x))], own, [x for x in parquet if "/bucket=" not in x]


def read_annotations(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All annotation logs of a folder, CSV and Parquet, conformed by name (files may order columns differently)."""
    fs, root = _filesystem(spark, folder)
    if not fs.exists(root):
        return empty_table(spark, schema)
    out = empty_table(spark, schema)
    csv, own, foreign = _listed(spark, folder)
    plain = spark.read.option("recursiveFileLookup", True)
    if csv:
        # the headers decide: files that agree on theirs are read together; one job finds them all
        lines = plain.text(csv).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).withColumn("at", F.monotonically_increasing_id())
        heads = lines.filter("start = 0").groupBy("file").agg(F.min_by("value", "at").alias("head"))
        for r in heads.groupBy("head").agg(F.collect_list("file").alias("files")).collect():
            out = out.unionByName(conform(spark.read.options(**_CSV).csv(r["files"]), schema))
    if own:
        # what append_ and compact_log have written has the schema's columns
        out = out.unionByName(conform(plain.schema(schema).parquet(*own), schema))
    if foreign:
        out = out.unionByName(conform(plain.option("mergeSchema", True).parquet(*foreign), schema))
    return out


def _append(rows: DataFrame, folder: str, buckets: int) -> None:
    # at most one file a bucket and append, more for a bucket with very many rows
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("rater_id"), F.lit(buckets)))
    dealt.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(folder)


def append_ratings(df: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Add rating events; ids and times that are missing are given once, when written."""
    rows = conform(df, RATINGS)
    rows = rows.withColumn("rating_id", F.coalesce("rating_id", F.uuid())).withColumn("rating_timestamp", F.coalesce("rating_timestamp", F.current_timestamp()))
    _append(rows, folder, buckets)


def append_pairwise(df: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Add preference events."""
    rows = conform(df, PAIRWISE)
    rows = rows.withColumn("pair_id", F.coalesce("pair_id", F.uuid())).withColumn("timestamp", F.coalesce("timestamp", F.current_timestamp()))
    _append(rows, folder, buckets)


_COMPACTION = re.compile(r"/_compaction-\d{8}\.json$")


def compact_log(spark: SparkSession, folder: str, schema: T.StructType, buckets: int = BUCKETS) -> int:
    """Merge the Parquet files that appends have left in folder into a few; the number of files merged.

    Merged rows are written to a folder of their own. Then a record that names it, and the files that it stands for, is
    renamed into place: before that moment readers see the old files, after it the new ones. The old files are deleted last. One
    compaction at a time; appends may go on meanwhile, as their files are not in the record.
    """
    fs, root = _filesystem(spark, folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    _, own, _ = _listed(spark, folder)
    records = sorted(str(x.getPath()) for x in fs.globStatus(path(root, "_compaction-*.json")) or [])
    if own:
        name, number = f"_merged-{uuid.uuid4().hex}", int(records[-1][-13:-5]) + 1 if records else 1
        _append(conform(spark.read.option("recursiveFileLookup", True).schema(schema).parquet(*own), schema), f"{folder.rstrip('/')}/{name}", buckets)
        out = fs.create(path(root, f"{name}.json"), True)
        out.write(bytearray(json.dumps({"folder": name, "merged": own}).encode()))
        out.close()
        _rename(fs, path(root, f"{name}.json"), path(root, f"_compaction-{number:08d}.json"))
        records.append(f"{root}/_compaction-{number:08d}.json")
    # what the last record stands for, and what earlier ones have left
    if records:
        said = _record(spark, records[-1])
        for old in [*said["merged"], *records[:-1], *[str(x.getPath()) for x in fs.globStatus(path(root, "_merged-*")) or [] if x.getPath().getName() != said["folder"]]]:
            fs.delete(path(old), True)
    return len(own)


# Fixed value: the header of the older layout of exclusion logs.
OLD_EXCLUSIONS = "image_id,excluded,reason,timestamp"


def split_csv(line: Column) -> Column:
    """The fields of a CSV line; a field in quotes may hold commas and doubled quotes."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("[^"]*(?:""[^"]*)*"[^,]*|[^,]*)'), F.lit(1))
    inner = lambda x: F.replace(F.regexp_replace(x, '^"|"(?=[^"]*$)', ""), F.lit('""'), F.lit('"'))
    return F.transform(raw, lambda x: F.when(x.startswith('"'), inner(x)).otherwise(x))


def parse_exclusions(lines: DataFrame) -> DataFrame:
    """Exclusion events from the lines of logs (value, file) of either layout, the rest of a log's lines as its header says.

    Under the header of the older layout, four fields are image_id, excluded, reason, timestamp, where the reason may
    hold `reason | path`. Five or more are image_id, relative_path, excluded, reason, and the rest, which is
    the timestamp. Other lines go.
    """
    # one row a file of the older layout
    old_files = lines.filter(F.trim("value") == OLD_EXCLUSIONS).select("file").distinct().withColumn("_old", F.lit(True))
    rows = lines.join(F.broadcast(old_files), "file", "left").filter((F.trim("value") != "") & ~F.col("value").startswith("image_id,")).withColumn("_v", split_csv(F.col("value")))
    v, n = F.col("_v"), F.size("_v")
    both = F.split(F.element_at(v, 3), r" \| ", 2)
    old = F.struct(v[0].alias("image_id"), F.when(F.size(both) == 2, both[1]).otherwise("").alias("relative_path"), v[1].alias("excluded"), both[0].alias("reason"), v[3].alias("timestamp"))
    new = F.struct(v[0].alias("image_id"), v[1].alias("relative_path"), v[2].alias("excluded"), v[3].alias("reason"), F.array_join(F.slice(v, F.lit(5), F.greatest(n - 4, F.lit(0))), ",").alias("timestamp"))
    picked = rows.select(F.when((n == 4) & F.col("_old"), old).when(n >= 5, new).alias("x"))
    return picked.filter("x IS NOT NULL").select("x.*").select(*[f.name for f in EXCLUSIONS])


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    fs, p = _filesystem(spark, path)
    if not fs.exists(p):
        return empty_table(spark, EXCLUSIONS)
    return parse_exclusions(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")))


def append_exclusions(df: DataFrame, path: str) -> None:
    """Add exclusion and restore events as CSV lines, in the five-field layout. Line breaks in a field become spaces."""
    at = F.coalesce("timestamp", F.current_timestamp().cast("string")) if "timestamp" in df.columns else F.current_timestamp().cast("string")
    rows = df.select("image_id", F.coalesce("relative_path", F.lit("")).alias("relative_path"), F.initcap(F.col("excluded").cast("string")).alias("excluded"), F.coalesce("reason", F.lit("")).alias("reason"), at.alias("timestamp"))

    def field(c: str) -> Column:
        plain = F.regexp_replace(c, r"[\r\n]+", " ")
        return F.when(plain.rlike('[",]'), F.concat(F.lit('"'), F.replace(plain, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(plain)

    rows.select(F.concat_ws(",", *[field(f.name) for f in EXCLUSIONS]).alias("value")).write.mode("append").text(path)


_BUNDLE = (
    "rater_id string, session_id string, "
    "ratings array<struct<image_id:string,score:double,note:string,timestamp:string,rater_id:string>>, "
    "pairwise array<struct<left_image_id:string,right_image_id:string,winner:string,tie_flag:boolean,preference_strength:double,timestamp:string,rater_id:string>>, "
    "imported_images array<struct<image_id:string,data_url:string>>"
)


def read_label_bundles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ratings, preferences, images) of label bundles, one JSON document a file.

    A field missing (or empty) in an item comes from its bundle, then from a default.
    """
    bundles = spark.read.schema(_BUNDLE).option("multiLine", True).json(path)
    given = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])
    rater, session = given(F.col("x.rater_id"), F.col("rater_id"), F.lit("friend")), given(F.col("session_id"), F.lit("friend_export"))
    r = bundles.select("rater_id", "session_id", F.explode("ratings").alias("x"))
    ratings = r.select(
        F.sha2(F.concat_ws("|", rater, session, "x.image_id", F.coalesce("x.timestamp", F.lit("")), F.col("x.score").cast("string")), 256).alias("rating_id"),
        F.col("x.image_id").alias("image_id"), rater.alias("rater_id"), session.alias("rating_session_id"), F.col("x.score").alias("raw_score_1_to_10"), F.col("x.timestamp").try_cast("timestamp").alias("rating_timestamp"), F.col("x.note").alias("note"),
    )
    p = bundles.select("rater_id", "session_id", F.explode("pairwise").alias("x"))
    pairs = p.select(
        F.sha2(F.concat_ws("|", rater, "x.left_image_id", "x.right_image_id", F.coalesce("x.timestamp", F.lit(""))), 256).alias("pair_id"),
        "x.left_image_id", "x.right_image_id", rater.alias("rater_id"), F.nullif(F.col("x.winner"), F.lit("")).alias("winner"), F.coalesce("x.tie_flag", F.lit(False)).alias("tie_flag"), F.coalesce("x.preference_strength", F.lit(0.5)).alias("preference_strength"), F.col("x.timestamp").try_cast("timestamp").alias("timestamp"),
    )
    images = decode_data_urls(bundles.select(F.explode("imported_images").alias("x")).select("x.image_id", "x.data_url"))
    return ratings, pairs, images


def decode_data_urls(df: DataFrame, column: str = "data_url") -> DataFrame:
    """df with content (bytes) and suffix of data URLs; rows without a comma go. Only the header tells the type."""
    head = F.substring_index(column, ",", 1)
    there = df.filter(F.contains(F.col(column), F.lit(",")))
    body = F.substr(F.col(column), F.char_length(head) + 2)
    return there.withColumn("content", F.try_to_binary(body, F.lit("base64"))).withColumn("suffix", F.when(F.lower(head).rlike("jpe?g"), ".jpg").otherwise(".png")).drop(column)


#: Items in one exported document, about.
EXPORT_ITEMS = 10_000


def export_manifest(manifest: DataFrame, name: str, rater_hint: str = "", shards: int | None = None) -> DataFrame:
    """shard, document: JSON documents of a header and an array of items, by id; by hash of the id into documents of about EXPORT_ITEMS."""
    item = F.struct("image_id", "relative_path", F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("height", F.lit(0)).alias("height"))
    shards = shards or max(1, -(-manifest.count() // EXPORT_ITEMS))
    lists = manifest.groupBy(F.pmod(F.hash("image_id"), F.lit(shards)).cast("int").alias("shard")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return lists.select("shard", F.to_json(F.struct(F.lit(name).alias("package_name"), F.lit(rater_hint).alias("rater_hint"), F.size("items").alias("n_items"), "items")).alias("document"))


def write_run(df: DataFrame, root: str, run_id: str) -> None:
    """A run's summary record as JSON, in a folder of the run's name."""
    df.coalesce(1).write.mode("overwrite").json(f"{root.rstrip('/')}/{run_id}/summary.json")


def read_runs(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    """Summaries of all runs that have one, with run_id from the path, newest name first."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        df = reader.json(f"{root.rstrip('/')}/*/summary.json")
    except AnalysisException as error:
        if not _missing(error):
            raise
        return spark.createDataFrame([], schema or "run_id string")
    return df.withColumn("run_id", F.element_at(F.split("_metadata.file_path", "/"), -3)).orderBy(F.desc("run_id"))
