"""File sources and sinks: frame listings, JSON documents, output inventories."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

C = F.col

# Names of raw-frame trees (fixed values).
LIGHT_SUFFIXES = (".fit", ".fits", ".fts")
LIGHT_DIRS = ("light", "lights")
CALIBRATION_DIRS = ("bias", "biases", "dark", "darks", "darkflat", "darkflats", "dark-flat", "dark-flats", "flat", "flats")
MANAGED_DIRS = ("checkpoints", "process", "results", "review_bundles", "runs")
CALIBRATION_PREFIXES = ("bias_", "dark_", "darkflat_", "dark-flat_", "flat_")


def list_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Listing of a tree (path relative to the root, length, modificationTime); contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rel = F.regexp_replace("path", "^.*?" + root.strip("/").replace(".", r"\.") + "/", "")
    return reader.load(root).select(rel.alias("path"), "length", "modificationTime")


def frame_scan(listing: DataFrame) -> DataFrame:
    """Raw light frames of a listing(path): suffix, hidden, calibration and managed rules, light name or directory."""
    parts = F.split("path", "/")
    dirs = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.lower(F.trim(p)))
    base = F.lower(F.element_at(parts, -1))
    stem = F.trim(F.regexp_replace(base, r"\.[^.]*$", ""))
    has = lambda names: F.arrays_overlap(dirs, F.array(*[F.lit(n) for n in names]))
    starts = lambda ps: stem.rlike("^(" + "|".join(ps) + ")")
    ok = base.rlike(r"\.(fit|fits|fts)$") & ~F.exists(parts, lambda p: p.startswith(".")) & ~has(CALIBRATION_DIRS) & ~has(MANAGED_DIRS) & ~starts(CALIBRATION_PREFIXES)
    return listing.where(ok & (starts(("light_",)) | has(LIGHT_DIRS)))


def read_json_documents(spark: SparkSession, root: str, schema: str, glob: str = "*.json") -> DataFrame:
    """One row per JSON document file that holds an object; others give no row."""
    docs = spark.read.option("wholetext", "true").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(root)
    return json_objects(docs.withColumn("path", F.input_file_name()), "value", schema)


def json_objects(docs: DataFrame, column: str, schema: str) -> DataFrame:
    """Parsed documents; malformed text and values that are no object are dropped, not failed."""
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = docs.withColumn("doc", F.from_json(column, schema + ", _corrupt string", opts))
    return parsed.where(C("doc").isNotNull() & C("doc._corrupt").isNull() & F.trim(column).startswith("{")).drop(column)


CATALOG_SCHEMA = "name string, aliases array<string>, type string, ra_deg double, dec_deg double, size_arcmin array<double>, features array<string>, policy string"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOG_SCHEMA).option("multiLine", "true").json(path)


def catalog_rows(docs: DataFrame, column: str) -> DataFrame:
    """Catalogue entries from JSON text, one row per name or alias."""
    d = json_objects(docs, column, CATALOG_SCHEMA).select("doc.*")
    names = F.filter(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda n: n.isNotNull() & (n != ""))
    return d.select("name", F.posexplode(names).alias("pos", "alias"), "type", "ra_deg", "dec_deg", F.array_max("size_arcmin").alias("size_arcmin"), F.size("features").alias("features"), "policy")


def metric_records(metrics: DataFrame, order: Sequence[str]) -> DataFrame:
    """JSON record per (run, stage) with its sequence number inside the run."""
    seq = F.row_number().over(W.partitionBy("run_id").orderBy(*order))
    rest = [c for c in metrics.columns if c != "run_id"]
    return metrics.withColumn("seq", seq).select("run_id", "seq", F.to_json(F.struct("seq", *sorted(rest))).alias("record"))


def append_metrics(records: DataFrame, path: str) -> None:
    """Appends records as JSON lines, one directory per run."""
    records.select("run_id", "record").write.mode("append").partitionBy("run_id").text(path)


def output_inventory(files: DataFrame, run_start: Column, basenames: DataFrame, durable: Sequence[str]) -> DataFrame:
    """Outputs of a run: durable names, fresh ``result_`` files, fresh files of a requested base name.

    The base name of a file is its text before the first ``.`` or ``_`` boundary that
    matches, so the test is an equi join on the possible prefixes.
    """
    low = F.lower(F.element_at(F.split("path", "/"), -1))
    f = files.withColumns({"_low": low, "_fresh": C("mtime") >= run_start - F.expr("INTERVAL 1 SECOND")})
    cuts = F.filter(F.transform(F.sequence(F.lit(1), F.length("_low")), lambda i: F.when(F.substr("_low", i, F.lit(1)).isin(".", "_"), F.substr("_low", F.lit(1), i - 1))), lambda p: p.isNotNull())
    named = f.select("run_id", "path", F.explode(F.array_distinct(cuts)).alias("base")).join(basenames.select("run_id", F.lower(F.trim("base")).alias("base")), ["run_id", "base"], "left_semi")
    hit = named.select("run_id", "path", F.lit(True).alias("_named")).distinct()
    j = f.join(hit, ["run_id", "path"], "left")
    why = F.when(C("_low").isin(*durable), "durable").when(C("_fresh") & C("_low").startswith("result_"), "result").when(C("_fresh") & C("_named"), "basename")
    return j.withColumn("reason", why).where(C("reason").isNotNull()).select("run_id", "path", "size", "reason")


def container_probe(files: DataFrame) -> DataFrame:
    """Format, depth and colour type from the leading bytes of files(content BINARY)."""
    hx = F.hex(F.substring("content", 1, 32))
    fmt = (
        F.when(hx.startswith("89504E470D0A1A0A"), "png").when(hx.startswith("49492A00") | hx.startswith("4D4D002A"), "tif")
        .when(hx.startswith("53494D504C45"), "fit").otherwise("unknown"))
    byte = lambda i: F.conv(F.substring(hx, 2 * i + 1, 2), 16, 10).cast("int")
    return files.withColumns({"format": fmt, "bit_depth": F.when(fmt == "png", byte(24)), "colour_type": F.when(fmt == "png", byte(25))}).drop("content")


def output_manifest(requested: DataFrame, probed: DataFrame) -> DataFrame:
    """One row per requested (run, format): what was found, or missing."""
    p = probed.groupBy("run_id", "format").agg(F.min("path").alias("path"), F.max("bit_depth").alias("bit_depth"), F.max("colour_type").alias("colour_type"))
    j = requested.join(p, ["run_id", "format"], "left")
    status = F.when(C("path").isNull(), "missing").when((C("format") == "png") & ((C("bit_depth") != 16) | ~C("colour_type").isin(2, 6)), "wrong_depth_or_colour").otherwise("ok")
    return j.select("run_id", "format", "path", "bit_depth", status.alias("status"))


LIGHT_DIAGNOSTICS = (".json", ".jsonl", ".txt", ".log", ".csv", ".md")


def diagnostic_archive_list(files: DataFrame, limit_bytes: int) -> DataFrame:
    """Light text diagnostics by extension and size; images and large files stay out."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.select("run_id", "path", "size", (ext.isin(*LIGHT_DIAGNOSTICS) & (C("size") <= limit_bytes)).alias("include"))
