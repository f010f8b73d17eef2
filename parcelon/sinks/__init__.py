"""Writers: CSV tables, GeoJSON, audit bundles, snapshots, copies by type, runs that can be taken up
again. All refuse to overwrite what is there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.versions import fingerprint_table

NEW = "errorifexists"


def one_file(rows: DataFrame, order: list[str]) -> DataFrame:
    """Sorted by all tasks, then read by one: reports are single files."""
    return rows.orderBy(*order).coalesce(1) if order else rows.coalesce(1)


def write_table(rows: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """A CSV of fixed columns in a fixed order; null and false are told apart from empty text by the
    caller, as CSV has none of them."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]
    sorted_rows = rows.orderBy(*order) if order else rows
    sorted_rows.select(*shown).coalesce(1).write.mode(NEW).csv(path, header=True, emptyValue="", lineSep="\n")


def write_union(tables: list[DataFrame], path: str, order: list[str]) -> None:
    """A CSV of tables with different columns: all names, sorted, blank where a table lacks them."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    write_table(rows, path, sorted(rows.columns), order)


def feature(properties: list[str], polygons: str = "polygons") -> Column:
    """A GeoJSON feature from an array of polygons; booleans become 0 and 1, as other sinks have them."""
    rings = F.transform(polygons, lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.array(v["x"], v["y"]))))
    shape = F.struct(F.lit("MultiPolygon").alias("type"), rings.alias("coordinates"))
    told = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"})
    geometry = F.when(F.col(polygons).isNull(), F.lit("null")).otherwise(F.to_json(shape))
    return F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), told, F.lit("}"))


def write_geojson(rows: DataFrame, path: str, properties: list[str], polygons: str = "polygons", order: list[str] | None = None) -> None:
    """One feature collection; a task streams it, so no more than a feature is held."""

    def lines(batches):
        import pyarrow as pa

        yield pa.record_batch([pa.array(['{"type":"FeatureCollection","features":['])], ["value"])
        first = True
        for batch in batches:
            found = batch.column(0).to_pylist()
            out = [("" if first and not i else ",") + f for i, f in enumerate(found)]
            first = first and not found
            yield pa.record_batch([pa.array(out, pa.string())], ["value"])
        yield pa.record_batch([pa.array(["]}"])], ["value"])

    told = one_file(rows, order or []).select(feature(properties, polygons).alias("value"))
    told.mapInArrow(lines, "value string").write.mode(NEW).text(path)


def write_audit(folder: str, comparison: DataFrame, holes: DataFrame, summary: DataFrame, differences: DataFrame, srs: int = 6668) -> None:
    """The bundle of an audit: comparison and holes as JSON and CSV, the summary, the differences as
    GeoJSON and GeoPackage. Needs sources.register()."""
    for name, rows in (("comparison", comparison), ("holes", holes)):
        order = [c for c in ("stage", "key") if c in rows.columns]
        one_file(rows, order).write.mode(NEW).option("ignoreNullFields", "false").json(f"{folder}/{name}.json")
        write_table(rows, f"{folder}/{name}.csv", sorted(rows.columns), order)
    summary.coalesce(1).write.mode(NEW).option("ignoreNullFields", "false").json(f"{folder}/summary.json")
    properties = [c for c in differences.columns if c != "polygons"]
    write_geojson(differences, f"{folder}/differences.geojson", properties, order=properties)
    differences.write.format("gpkg").options(path=f"{folder}/differences.gpkg", layer="differences", srs=srs).mode("append").save()


def resumed(spark: SparkSession, inputs: DataFrame, key: str, work, path: str) -> DataFrame:
    """work(inputs), kept per key: keys whose inputs are as they were in an earlier run are read, not
    computed again. inputs has the key and `input_sha`; work gives the key and its results. Results
    are appended under Spark's commit, so that a run which stops leaves whole batches or nothing."""
    wanted = inputs.select(key, "input_sha").distinct()
    try:
        done = spark.read.parquet(path)
        todo = wanted.join(done.select(key, "input_sha").distinct(), [key, "input_sha"], "left_anti")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        todo = wanted
    todo = todo.select(key, "input_sha")
    if todo.head(1):
        made = work(inputs.join(todo, [key, "input_sha"], "left_semi"))
        made.join(todo, key).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(wanted, [key, "input_sha"], "left_semi")


def _print_of(rows: DataFrame) -> tuple:
    return tuple(fingerprint_table(rows, {c: f"{t}:" for c, t in rows.dtypes}).first())


def snapshot(rows: DataFrame, folder: str) -> None:
    """The rows as Parquet and, last, their number and fingerprint: a snapshot without one is not whole."""
    rows.write.mode(NEW).parquet(f"{folder}/rows")
    n, sha = _print_of(rows.sparkSession.read.parquet(f"{folder}/rows"))
    if (n, sha) != _print_of(rows):
        raise ValueError(f"{folder}: what was written differs from the rows")
    rows.sparkSession.createDataFrame([(n, sha)], "n_rows long, sha string").write.mode(NEW).json(f"{folder}/fingerprint")


def restored(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of a snapshot; fails if they are not those that were written."""
    rows = spark.read.parquet(f"{folder}/rows")
    wanted = spark.read.schema("n_rows long, sha string").json(f"{folder}/fingerprint").first()
    if wanted is None or tuple(wanted) != _print_of(rows):
        raise ValueError(f"{folder}: the rows differ from their fingerprint")
    return rows


def typed_copy(rows: DataFrame, kind: str, path: str) -> DataFrame:
    """A copy in one folder per type, read again; fails if it differs, as with a type that no folder
    can be named after."""
    rows.write.mode(NEW).partitionBy(kind).parquet(path)
    back = rows.sparkSession.read.schema(rows.schema).parquet(path).select(*rows.columns)
    if _print_of(back) != _print_of(rows):
        raise ValueError(f"{path}: the copy differs from the rows")
    return back
