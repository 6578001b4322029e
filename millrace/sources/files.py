"""File, request and template sources. Bad inputs become rows with an error code, not failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import file_extension, file_name

IMAGES = ("jpg", "jpeg", "png", "tiff", "tif", "bmp", "webp")
MAX_IMAGE, MAX_PDF = 20 << 20, 50 << 20
MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "tiff": "image/tiff", "tif": "image/tiff", "bmp": "image/bmp", "webp": "image/webp", "pdf": "application/pdf"}


def file_error(path: Column, size: Column) -> Column:
    """The first rule that a file breaks, or null."""
    ext = F.ltrim(file_extension(path), F.lit("."))
    return (
        F.when(~ext.isin(*IMAGES, "pdf"), "UNSUPPORTED_EXTENSION")
        .when(size <= 0, "EMPTY_FILE")
        .when((ext == "pdf") & (size > MAX_PDF), "PDF_TOO_LARGE")
        .when((ext != "pdf") & (size > MAX_IMAGE), "IMAGE_TOO_LARGE")
    )


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, ext, size, is_pdf, is_image, error of a folder's own files, not its subfolders'. Contents are not read until they are asked for. Spark's reader leaves out files without a byte; file_error finds them in other listings."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(folder)
    ext = F.ltrim(file_extension(F.col("path")), F.lit("."))
    return files.select("path", file_name(F.col("path")).alias("name"), ext.alias("ext"), F.col("length").alias("size"), (ext == "pdf").alias("is_pdf"), ext.isin(*IMAGES).alias("is_image"), file_error(F.col("path"), F.col("length")).alias("error"))


def data_urls(spark: SparkSession, folder: str) -> DataFrame:
    """path, url: each supported file as a data URL."""
    files = spark.read.format("binaryFile").load(folder)
    ext = F.ltrim(file_extension(F.col("path")), F.lit("."))
    mime = F.element_at(F.create_map(*[F.lit(x) for p in MIME.items() for x in p]), ext)
    return files.where(file_error(F.col("path"), F.col("length")).isNull()).select("path", F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64("content")).alias("url"))


#: Request options and their defaults; others are dropped.
OPTIONS = {"documentMode": "AUTO", "enableVisualOcr": "true", "enableOnlineFallback": "false", "maxImageWidth": "1800", "timeoutPerImage": "45", "timeoutPerCandidate": "8", "outputDateFormat": "yyyy-MM-dd", "countryFormat": "ISO3", "includeErrorsSheet": "true", "includeInstructionsSheet": "true", "includeDiagnosticsSheet": "true"}


def requests(spark: SparkSession, path: str) -> DataFrame:
    """jobId, inputPaths, outputPath, options (each default unless given), error of JSON job requests."""
    options = T.StructType([T.StructField(n, T.StringType()) for n in OPTIONS])
    schema = T.StructType().add("jobId", "string").add("inputPaths", T.ArrayType(T.StringType())).add("outputPath", "string").add("options", options)
    r = spark.read.schema(schema).option("multiLine", True).json(path)
    merged = F.struct(*[F.coalesce(F.col(f"options.{n}"), F.lit(d)).alias(n) for n, d in OPTIONS.items()])
    error = F.when(F.coalesce(F.col("jobId"), F.lit("")) == "", "MISSING_JOB_ID").when(F.coalesce(F.size("inputPaths"), F.lit(0)) <= 0, "MISSING_INPUT_PATHS")
    return r.select("jobId", "inputPaths", "outputPath", merged.alias("options"), error.alias("error"))


TEMPLATE = "id string, name string, type string, mappings array<struct<source:string,target:string,enabled:boolean,transforms:array<map<string,string>>>>"


def templates(rows: DataFrame, json_col: str) -> DataFrame:
    """id, name, type, mappings of JSON templates; those without any of the four, and broken ones, go."""
    parsed = rows.select(F.from_json(F.col(json_col), TEMPLATE).alias("t")).select("t.*")
    return parsed.where("id is not null and name is not null and type is not null and mappings is not null")


#: Recognised documents of a REST service: fields by name, each with a text and a confidence.
SERVICE_FIELD = "map<string,struct<valueString:string,content:string,confidence:double>>"


def service_fields(rows: DataFrame, key: str, json_col: str, names: dict[str, str]) -> DataFrame:
    """key, field, value, confidence of a service's first document; fields that names does not map go, and of several for one name the last stays."""
    schema = f"analyzeResult struct<documents:array<struct<fields:{SERVICE_FIELD}>>>"
    fields = F.try_element_at(F.from_json(F.col(json_col), schema)["analyzeResult"]["documents"], F.lit(1))["fields"]
    mapping = F.create_map(*[F.lit(x) for p in names.items() for x in p])
    listed = rows.select(key, F.posexplode(F.map_entries(fields)).alias("pos", "e")).withColumn("field", F.try_element_at(mapping, F.col("e.key"))).where("field is not null")
    value = F.struct(F.coalesce("e.value.valueString", "e.value.content").alias("value"), F.col("e.value.confidence").alias("confidence"))
    return listed.groupBy(key, "field").agg(F.max_by(value, "pos").alias("v")).select(key, "field", "v.*")
