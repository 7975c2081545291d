"""Readers for the file formats of the pipeline: explicit schemas, alternative headers, several encodings."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions import geometry as g
from glyphmill.functions.text import map_tag
from glyphmill.operators.labels import latest
from glyphmill.operators.lineage import cut

#: Header names in the order they are tried.
KEY_NAMES = ("image_id", "image_name", "filename")
TEXT_NAMES = ("gt_text", "ocr_text", "text")
SCORE_NAMES = ("conf", "confidence", "score", "prob", "probability")
MANIFEST = "image_path string, text string, split string, source_image string, source_image_id string, annotation_id string, class string, x int, y int, w int, h int"
MATCHES = "det_crop string, photo string, gt_index int, iou double, conf double, status string"
TAGS = "image_name string, region string, name string, tag string, verdict string, eval_name string, eval_tag string"


def pick(df: DataFrame, names: tuple[str, ...]) -> str | None:
    """The first of ``names`` among the columns, letter case, blanks and a byte-order mark set aside."""
    own = {c.strip().lstrip("\ufeff").lower(): c for c in df.columns}
    return next((own[n] for n in names if n in own), None)


def stem(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^.*[/\\]", ""), r"\.[^.]*$", "")


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", sep: str = ",") -> DataFrame:
    """All columns as strings; quoted cells may hold newlines and doubled quotes; empty cells are null."""
    df = spark.read.csv(path, header=True, encoding=encoding, sep=sep, multiLine=True, quote='"', escape='"')
    return df.withColumnsRenamed({c: c.lstrip("\ufeff") for c in df.columns})


def text_map(df: DataFrame, ordinal: str) -> DataFrame:
    """``(key, text)``: key without ending, last row wins by ``ordinal``, rows with an empty key left out, text never null."""
    k, t = pick(df, KEY_NAMES), pick(df, TEXT_NAMES)
    if k is None or t is None:
        raise ValueError(f"no key or text among {df.columns}")
    rows = df.select(stem(F.trim(k)).alias("key"), F.coalesce(t, F.lit("")).alias("text"), F.col(ordinal).alias("_o")).where("key <> ''")
    return latest(rows, "key", "_o").drop("_o")


def newest_run(df: DataFrame, by: list[str], run: str = "run", changed: str = "modified") -> DataFrame:
    """Rows of the newest run per group."""
    last = df.groupBy(*by).agg(F.max_by(run, F.struct(changed, run)).alias(run))
    return df.join(last, [*by, run], "left_semi")


def scored_boxes(df: DataFrame) -> DataFrame:
    """``(filename, w, h, box, conf)`` with a confidence of 1 where there is no such column or value."""
    s = pick(df, SCORE_NAMES)
    b = g.box(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")])
    conf = F.coalesce(F.col(s).try_cast("double"), F.lit(1.0)) if s else F.lit(1.0)
    return df.select("filename", F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"), b.alias("box"), conf.alias("conf"))


def rescaled_truth(truth: DataFrame, sizes: DataFrame) -> DataFrame:
    """Truth ``(filename, w, h, box)`` in the pixel space of ``sizes (filename, w, h)``; unknown files stay as they are."""
    p = sizes.select("filename", F.col("w").alias("pw"), F.col("h").alias("ph")).distinct()
    return truth.join(p, "filename", "left").withColumn("box", g.rescale(F.col("box"), F.col("w"), F.col("h"), F.col("pw"), F.col("ph"))).drop("pw", "ph")


def yolo_labels(lines: DataFrame, photos: DataFrame) -> DataFrame:
    """``(photo, cls, box)`` from ``lines (photo, value)`` of ``cls xc yc w h``; ``photos (photo, w, h)``; a photo without lines
    has one row with a null box."""
    p = F.split(F.trim("value"), r"\s+")
    n = lambda i: F.try_element_at(p, F.lit(i + 1)).try_cast("double")
    y = F.struct(n(1).alias("xc"), n(2).alias("yc"), n(3).alias("w"), n(4).alias("h"))
    j = photos.join(lines.where(F.size(p) >= 5), "photo", "left")
    return j.select("photo", n(0).cast("int").alias("cls"), F.when(F.col("value").isNotNull(), g.from_yolo(y, F.col("w"), F.col("h"))).alias("box"))


def detections_json(df: DataFrame, col: str = "value") -> DataFrame:
    """``(photo, w, h, box, conf)`` of ``{photo: {size: [w, h], boxes: [[x0, y0, x1, y1, conf]]}}``."""
    m = F.from_json(col, "map<string, struct<size: array<int>, boxes: array<array<double>>>>")
    e = df.select(F.explode(m).alias("photo", "d")).select("photo", F.col("d.size")[0].alias("w"), F.col("d.size")[1].alias("h"), F.explode("d.boxes").alias("b"))
    return e.select("photo", "w", "h", g.box(*[F.col("b")[i] for i in range(4)]).alias("box"), F.coalesce(F.try_element_at("b", F.lit(5)), F.lit(1.0)).alias("conf"))


def annotations_of(images: DataFrame, annotations: DataFrame, kind: str) -> DataFrame:
    """Annotations of the images of one type: a semi join."""
    return annotations.join(images.where(F.col("type") == kind).select(F.col("id").alias("image_id")), "image_id", "left_semi")


def coco_faults(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """``(fault, n)``: annotations with an unknown image or category or a bad box."""
    a = annotations
    bad = a.where(F.col("bbox").isNull() | (F.size("bbox") != 4) | (F.col("bbox")[2] <= 0) | (F.col("bbox")[3] <= 0))
    parts = [("image", a.join(images, a.image_id == images.id, "left_anti")), ("category", a.join(categories, a.category_id == categories.id, "left_anti")), ("box", bad)]
    out = None
    for name, d in parts:
        n = d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("fault"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def path_list(df: DataFrame, col: str = "value") -> DataFrame:
    """``(path, text)`` of tab-separated lines; what follows the first tab is text."""
    p = F.split(col, "\t", 2)
    return df.where(F.contains(F.col(col), F.lit("\t"))).select(p[0].alias("path"), p[1].alias("text"))


def poi_elements(df: DataFrame, keys: list[str]) -> DataFrame:
    """``(name, tag)`` of elements with a ``tags`` map: each of three name fields, the first matching key as ``key=value``."""
    tag = F.coalesce(*[F.when(F.col("tags")[k].isNotNull(), F.concat(F.lit(f"{k}="), F.col("tags")[k])) for k in keys], F.lit(""))
    names = F.array_distinct(F.array_compact(F.array(*[F.col("tags")[n] for n in ("name", "name:ko", "name:en")])))
    return df.select(F.explode(names).alias("name"), tag.alias("tag"))


def in_region(df: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows with a readable position inside a region's box, borders included; ``regions`` is one row per region."""
    d = df.withColumns({"lat": F.col("lat").try_cast("double"), "lon": F.col("lon").try_cast("double")}).where("lat is not null and lon is not null")
    r = regions
    on = d.lat.between(r.lat0, r.lat1) & d.lon.between(r.lon0, r.lon1)
    return d.join(r, on).drop("lat0", "lat1", "lon0", "lon1")


def not_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return todo.join(done.select(key), key, "left_anti")


def write_lines_csv(df: DataFrame, path: str, text: str = "gt_text") -> None:
    """Every cell quoted, newlines inside text as a literal backslash-n."""
    df.withColumn(text, F.replace(text, F.lit("\n"), F.lit("\\n"))).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def numbered_samples(df: DataFrame, order: str, text: str, path: str) -> None:
    """Key-value samples ``image-%09d`` / ``label-%09d`` and their number under ``num-samples``, numbered by ``order``.

    The rows are range-sorted; a row's number is its place in its partition behind the sizes of the partitions before, of
    which one row each is joined.
    """
    s = cut(df.orderBy(order)).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    per = s.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    per = per.select("_p", "_first", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    n = s.join(F.broadcast(per), "_p").withColumn("n", F.col("_i") - F.col("_first") + F.col("_before") + 1)
    kv = F.array(F.struct(F.format_string("image-%09d", "n").alias("key"), F.col(order).cast("string").alias("value")), F.struct(F.format_string("label-%09d", "n").alias("key"), F.col(text).alias("value")))
    count = n.agg(F.lit("num-samples").alias("key"), F.count(F.lit(1)).cast("string").alias("value"))
    n.select(F.explode(kv).alias("kv")).select("kv.*").unionByName(count).write.mode("overwrite").parquet(path)


def write_metrics(df: DataFrame, path: str, digits: int = 4) -> None:
    """A CSV with a header, doubles as text with ``digits`` decimals."""
    kinds = dict(df.dtypes)
    df.select(*[F.format_string(f"%.{digits}f", c).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns]).write.mode("overwrite").csv(path, header=True)


def append_rows(df: DataFrame, path: str) -> None:
    """Rows behind those already at ``path``; every part file of a CSV folder has its own header."""
    df.write.mode("append").csv(path, header=True)


def concat(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The rows of the named CSV files, by column name; a column that a file lacks is null there. No pattern is matched."""
    out = None
    for p in paths:
        d = read_csv(spark, p)
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    if out is None:
        raise ValueError("no path is given")
    return out


def write_manifest(df: DataFrame, path: str, split: str = "split", key: str = "image_path", text: str = "text", sep: str = "\t") -> None:
    """A trainer's list per split: one line ``key, sep, text`` per row, blanks in the text made single."""
    line = F.concat_ws(sep, F.col(key), F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))
    df.where(F.col(split).isNotNull()).select(F.col(split).alias("split"), line.alias("value")).write.mode("overwrite").partitionBy("split").text(path)


def probed_csv(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("utf-8-sig", "cp949")) -> DataFrame:
    """CSV files in the first encoding that decodes them whole, else the last with replacement; all columns as strings.

    Spark's reader knows no Korean code page, so each file is decoded and parsed in one task; the header is that of the
    first file by name.
    """

    def decoded(data: bytes) -> str:
        for e in encodings:
            try:
                return data.decode(e)
            except UnicodeDecodeError:
                continue
        return data.decode(encodings[-1], "replace")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                for r in csv.DictReader(io.StringIO(decoded(bytes(data)), newline="")):
                    yield pd.DataFrame({"row": [{k: v for k, v in r.items() if k is not None and isinstance(v, str)}]})

    files = spark.read.format("binaryFile").load(path)
    rows = files.select("content").mapInPandas(run, "row map<string, string>")
    first = rows_of_header(files.orderBy("path").select("content").limit(1), decoded)
    return rows.select(*[F.col("row")[c].alias(c) for c in first])


def rows_of_header(file: DataFrame, decoded: Callable[[bytes], str]) -> list[str]:
    """The columns of the one file in ``file (content)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                yield pd.DataFrame({"c": next(csv.reader(io.StringIO(decoded(bytes(data)), newline="")), [])})

    return [r["c"] for r in file.mapInPandas(run, "c string").collect()]


def shops(df: DataFrame, regions: DataFrame, names: tuple[str, ...] = ("name", "상호명"), lats: tuple[str, ...] = ("lat", "위도"), lons: tuple[str, ...] = ("lon", "경도")) -> DataFrame:
    """``(name, lat, lon, region)`` of a shop list under any of the headers; rows without a readable place are left out."""
    n, la, lo = pick(df, names), pick(df, lats), pick(df, lons)
    if n is None or la is None or lo is None:
        raise ValueError(f"no name or place among {df.columns}")
    return in_region(df.select(F.trim(n).alias("name"), F.col(la).alias("lat"), F.col(lo).alias("lon")).where("name <> ''"), regions)


def paged(df: DataFrame, name: str, category: str, rules: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """``(rows, unmapped)`` of landed pages ``(value)``, each a JSON array of flat objects: names with the tag the rules give
    their category, and the categories no rule takes with their counts."""
    each = df.select(F.explode(F.from_json("value", "array<map<string, string>>")).alias("o")).select(F.trim(F.col("o")[name]).alias("name"), F.col("o")[category].alias("category"))
    rows = each.where("name <> ''").withColumn("tag", map_tag(F.coalesce("category", F.lit("")), rules, lower=True))
    return rows, rows.where("tag = ''").groupBy("category").agg(F.count(F.lit(1)).alias("rows"))


def polygons(df: DataFrame, labels: list[str], least: float = 2.0) -> DataFrame:
    """``(photo, label, points)`` of annotation files ``(photo, value)`` with ``shapes``: the wanted labels whose box has both
    sides of at least ``least``."""
    s = F.from_json("value", "struct<shapes: array<struct<label: string, points: array<array<double>>>>>")
    e = df.select("photo", F.explode(s["shapes"]).alias("s")).select("photo", "s.label", F.transform("s.points", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("points"))
    side = lambda c: F.array_max(F.transform("points", lambda p: p[c])) - F.array_min(F.transform("points", lambda p: p[c]))
    return e.where(F.col("label").isin(labels) & (side("x") >= least) & (side("y") >= least))


def flexible_box(c: Column) -> Column:
    """A box ``[x, y, w, h]`` that is an array or the text of one; null if neither."""
    return F.from_json(F.regexp_replace(c, r'^"|"$', ""), "array<double>")
