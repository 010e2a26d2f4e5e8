"""File sources and sinks: delimited sheets (S-01), centre lists (S-07),
GeoJSON polygons (S-06), pt-BR CSV / JSON / rejects writers (K-11..K-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.fmt import number_ptbr
from ..functions.text import fold_headers
from ..functions.text import fold_accents as _fold
from ..session import cut_lineage

BOM = "﻿"


def sniff_separator(spark: SparkSession, path: str) -> str:
    """`;` when the first line has one, else `,` (reads one line only)."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    return ";" if ";" in (line or "") else ","


def scan_delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """S-01: every cell a string, headers folded (strip, lower, no accents, no BOM),
    null cells -> ''."""
    sep = sep or sniff_separator(spark, path)
    df = (spark.read.option("header", True).option("sep", sep).option("inferSchema", False)
          .option("encoding", "UTF-8").csv(path))
    df = df.toDF(*fold_headers([c.replace(BOM, "") for c in df.columns]))
    return df.na.fill("")


# Header aliases of the centre list and its required/optional columns.
CENTER_ALIASES = {"bandeira cliente": "bandeira", "razao": "bandeira"}
CENTER_REQUIRED = ["logradouro", "bairro", "cidade", "uf"]
CENTER_OPTIONAL = ["numero", "cep", "cnpj", "bandeira"]


def scan_centers(spark: SparkSession, path: str) -> DataFrame:
    """S-07: centre list; aliases renamed, required columns checked (schema only),
    optional ones defaulted to ''."""
    df = scan_delimited(spark, path)
    df = df.withColumnsRenamed({k: v for k, v in CENTER_ALIASES.items() if k in df.columns})
    missing = [c for c in CENTER_REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns in centre file: {', '.join(missing)}")
    for c in CENTER_OPTIONAL:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    return df


# Property names that may carry the city and the state.
CITY_PROPS = ["NM_MUN", "name", "municipio", "nome"]
UF_PROPS = ["SIGLA_UF", "UF", "uf", "state"]


# Fixed patterns: an escaped character, and a JSON string or what is left of one at the end.
JSON_ESCAPE = r"\\."
JSON_STRING = r'"(?:[^"\\]++|\\.)*+(?:"|\z)'
JSON_STRING_TAIL = r'^(?:[^"\\]++|\\.)*+(?:"|\z)'
BEFORE_BRACE = r'(?s)^(?:[^"{]++|"(?:[^"\\]++|\\.)*+")*+\{'


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """The objects one level below the root of JSON documents (`{..., "features": [{...}, {...}]}`)
    as text, one row each (`arquivo`, `objeto`), whatever the line breaks.

    A document is read as text cut at every closing brace, so that many tasks share one file;
    a piece knows its file, its block and its place in the block.  Whether a piece begins
    within a string follows from the quotes before it, and its depth from the braces before it:
    running sums inside a block plus the sums of the blocks before, one row a block.  A task
    holds a block, and one object at a time must fit in memory.
    """
    f = (spark.read.option("lineSep", "}").text(path)
         .select(F.col("_metadata.file_path").alias("arquivo"), F.col("_metadata.file_block_start").alias("_blk"),
                 F.monotonically_increasing_id().alias("_pos"), "value"))
    bare = F.regexp_replace("value", JSON_ESCAPE, "")
    f = cut_lineage(f.withColumn("_quotes", F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))))
    inside = Window.partitionBy("arquivo", "_blk").orderBy("_pos")

    def running(df: DataFrame, value: str, out: str) -> DataFrame:
        """Sum of `value` over the pieces of the file up to and with this one."""
        blocks = df.groupBy("arquivo", "_blk").agg(F.sum(value).alias("_s"))
        earlier = Window.partitionBy("arquivo").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.select("arquivo", "_blk", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_off"))
        return (df.withColumn(out, F.sum(value).over(inside)).join(blocks, ["arquivo", "_blk"])
                .withColumn(out, F.col(out) + F.col("_off")).drop("_off"))

    f = running(f, "_quotes", "_q")
    began = (F.col("_q") - F.col("_quotes")) % 2 == 1  # this piece begins within a string
    plain = F.regexp_replace(F.when(began, F.regexp_replace("value", JSON_STRING_TAIL, "")).otherwise(F.col("value")), JSON_STRING, "")
    real = F.col("_q") % 2 == 0  # the brace at its end is no part of a string
    opened = F.length(plain) - F.length(F.replace(plain, F.lit("{"), F.lit("")))
    f = running(f.withColumn("_real", real).withColumn("_step", opened - F.when(real, 1).otherwise(0)), "_step", "_depth")
    f = running(f.withColumn("_closes", (F.col("_real") & (F.col("_depth") == 1)).cast("int")), "_closes", "_c")
    f = f.withColumn("_obj", F.col("_c") - F.col("_closes"))
    g = f.groupBy("arquivo", "_obj").agg(
        F.max("_closes").alias("_whole"), F.array_sort(F.collect_list(F.struct("_blk", "_pos", "value"))).alias("_v"))
    text = F.concat(F.array_join(F.transform("_v", lambda v: v["value"]), "}"), F.lit("}"))
    # before an object stand commas, brackets and plain members of the root; before the first also the root's brace
    first = F.regexp_replace(text, BEFORE_BRACE, "")
    body = F.when(F.col("_obj") == 0, F.regexp_replace(first, BEFORE_BRACE, "{")).otherwise(F.regexp_replace(text, BEFORE_BRACE, "{"))
    return g.filter("_whole = 1").select("arquivo", body.alias("objeto"))


FEATURE = "type string, properties map<string,string>, geometry struct<type:string,coordinates:string>"


def scan_polygons(spark: SparkSession, path: str) -> DataFrame:
    """S-06: GeoJSON FeatureCollection -> one row per vertex
    (cidade_key, uf_key, ring, seq, lon, lat), ready for `point_in_polygon`.

    Polygon and MultiPolygon are both read (all rings of all parts; parity
    handles holes); features without a city or state name are skipped, as is
    what else the document holds.  Features are read by many tasks (`json_objects`).
    """
    feats = json_objects(spark, path).select(F.from_json("objeto", FEATURE).alias("f")).filter(F.col("f.type") == "Feature")

    def first_prop(names):
        return F.coalesce(*[F.col("f.properties").getItem(n) for n in names])

    g = feats.select(F.upper(F.trim(_fold(first_prop(CITY_PROPS)))).alias("cidade_key"),
                     F.upper(F.trim(first_prop(UF_PROPS))).alias("uf_key"),
                     F.col("f.geometry.type").alias("gtype"),
                     F.col("f.geometry.coordinates").alias("coords"))
    g = g.filter(F.col("cidade_key").isNotNull() & (F.col("cidade_key") != "") & F.col("uf_key").isNotNull())
    poly = F.from_json(F.col("coords"), "array<array<array<double>>>")
    multi = F.from_json(F.col("coords"), "array<array<array<array<double>>>>")
    rings = F.when(F.col("gtype") == "Polygon", poly).otherwise(F.flatten(multi))
    r = g.select("cidade_key", "uf_key", F.posexplode(rings).alias("ring", "pts"))
    v = r.select("cidade_key", "uf_key", "ring", F.posexplode("pts").alias("seq", "xy"))
    return v.select("cidade_key", "uf_key", "ring", "seq",
                    F.col("xy")[0].alias("lon"), F.col("xy")[1].alias("lat"))


def write_csv_ptbr(df: DataFrame, path: str, decimals: int = 2) -> None:
    """K-11: `;` separator, decimal comma, no thousands mark, fixed decimals, BOM-prefixed header
    (so spreadsheet tools read UTF-8)."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float", "decimal"):
            fixed = F.round(F.col(f.name), decimals).cast(f"decimal(38,{decimals})").cast("string")
            out.append(F.translate(fixed, ".", ",").alias(f.name))
        else:
            out.append(F.col(f.name))
    cols = [c for c in df.columns]
    renamed = df.select(*out).toDF(*([BOM + cols[0]] + cols[1:]) if cols else cols)
    renamed.write.mode("overwrite").option("header", True).option("sep", ";").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """K-12."""
    df.write.mode("overwrite").json(path)


def write_rejects(df: DataFrame, path: str, reason: str = "motivo_invalidade") -> bool:
    """K-13: rejected rows with their reason, partitioned by reason; nothing when empty."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").option("header", True).option("sep", ";").partitionBy(reason).csv(path)
    return True


__all__ = ["scan_delimited", "scan_centers", "scan_polygons", "write_csv_ptbr", "write_json",
           "write_rejects", "number_ptbr"]
