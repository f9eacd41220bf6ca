"""Label files, session metadata and device payloads as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import intervals


class LabelError(ValueError):
    """Label files are missing or have faulty lines."""


def _stem(path: Column) -> Column:
    """A file's name without its ending; label files end in .ads.txt or .txt."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.ads)?\.[^./]+$", 1)


def listed(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path and chunk of the files of a folder, empty ones included, by the listing that Spark's readers hold."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).inputFiles()
    rows = spark.createDataFrame([(x,) for x in sorted(found)], "path string")
    return rows.select("path", F.url_decode(_stem(F.col("path"))).alias("chunk"))


def label_lines(spark: SparkSession, folder: str, session_id: str) -> DataFrame:
    """session_id, chunk, line and text of the label files (*.ads.txt or *.txt) of a session's folder."""
    rows = spark.read.option("pathGlobFilter", "*.txt").text(folder).withColumn("chunk", F.url_decode(_stem(F.input_file_name())))
    return rows.select(F.lit(session_id).alias("session_id"), "chunk", F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"))


def labels(lines: DataFrame, shown: int = 20) -> DataFrame:
    """Good spans of label lines; faulty lines or overlapping spans are an error that lists some."""
    parsed = intervals.parse_labels(lines)
    faults = parsed.filter("error is not null").select("session_id", "chunk", "line", "error")
    good = parsed.filter("error is null").drop("error", "line")
    crossed = intervals.overlaps(good).select("session_id", "chunk", F.lit(None).cast("long").alias("line"), F.lit("overlaps the span before").alias("error"))
    if found := faults.union(crossed).limit(shown).collect():
        raise LabelError("; ".join(f"{r.session_id}/{r.chunk} {'' if r.line is None else r.line}: {r.error}" for r in found))
    return good


def paired(wavs: DataFrame, label_files: DataFrame, shown: int = 20) -> DataFrame:
    """WAV files (path, chunk) that all have a label file, which may be empty (no ads).

    No WAV files, or some without a label file, are an error that names some.
    """
    if wavs.isEmpty():
        raise LabelError("no WAV files")
    missing = intervals.unlabelled(wavs.select("chunk"), label_files.select("chunk").distinct(), "chunk").orderBy("chunk").limit(shown).collect()
    if missing:
        raise LabelError(f"no labels for {', '.join(r.chunk for r in missing)}")
    return wavs


def session_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A session.json file; one that can't be read is an error, one that isn't there gives no rows."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path):
        return spark.createDataFrame([], "session_id string")
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").schema("session_id string").json(path)


def active_app(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Adds app_id and app_name of an active-app payload: null if it can't be read, empty without an app."""
    schema = "app struct<_id: string, _VALUE: string>, _corrupt_record string"
    rows = payloads.withColumn("_xml", F.from_xml(F.col(column), schema))
    broken = F.col(column).isNull() | F.col("_xml").isNull() | F.col("_xml._corrupt_record").isNotNull()
    part = lambda c: F.when(~broken, F.coalesce(F.trim(F.col(f"_xml.app.{c}")), F.lit("")))
    return rows.withColumn("app_id", part("_id")).withColumn("app_name", part("_VALUE")).drop("_xml")


def device_info(payloads: DataFrame, column: str = "payload", root: str = "device-info") -> DataFrame:
    """Adds info: the text of each child of a device description, by the child's name (of equal names the last).

    Entities are decoded; attributes are no text, and neither are a child's own
    children. Null if the payload can't be read; empty if it has no children.
    """
    bare = F.regexp_replace(F.regexp_replace(column, r"^\s*(<\?xml[^>]*\?>)?\s*", ""), rf"""^<{root}(\s+[\w:.-]+\s*=\s*("[^"]*"|'[^']*'))*\s*(/?)>""", f"<{root}$3>")
    within = F.concat(F.lit("<x>"), bare, F.lit("</x>"))  # a row's root has no name of its own in a schema
    parsed = lambda value: F.from_xml(within, f"`{root}` map<string, {value}>, _corrupt_record string")
    rows = payloads.withColumn("_text", parsed("string")).withColumn("_child", parsed("struct<_VALUE: string>"))
    text, child = F.col("_text").getField(root), F.col("_child").getField(root)
    # Read as texts, a child with children is its markup; read as structures, it has no value.
    plain = F.transform_values(text, lambda k, v: F.when(child.isNull(), v).otherwise(F.coalesce(child[k]["_VALUE"], F.lit(""))))
    info = F.map_filter(plain, lambda k, v: k != "_VALUE")
    none = F.col("_text._corrupt_record").isNull() & bare.rlike(rf"^<{root}[\s/>]")
    return rows.withColumn("info", F.coalesce(info, F.when(none, F.create_map().cast("map<string,string>")))).drop("_text", "_child")


#: What a recorder writes beside each recording.
SIDECAR = "label string, note string, recorded_at timestamp, device string, sample_rate int, channels int, seconds double, wav string"


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecar files (*.json but session.json) of a folder; recorded_at is ISO 8601 with an offset. A faulty file is an error."""
    files = spark.read.option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "*.json").schema(SIDECAR)
    return files.json(folder).filter(~F.col("_metadata.file_name").isin("session.json"))


def write_sidecars(rows: DataFrame, path: str) -> None:
    """Appends rows of that schema as JSON; time stamps keep their offset."""
    rows.select(*(x.split()[0] for x in SIDECAR.split(", "))).write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
