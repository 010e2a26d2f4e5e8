"""Point quality: sheet cleaning (C-02 front half), validation (C-01), boundary
status (C-03) and spatial outliers (C-04)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text
from ..functions.geo import valid_coord
from ..session import spread_rows
from .spatial import knn_distances

REQUIRED = ["cnpj", "logradouro", "cidade", "uf"]


def clean_points_raw(raw: DataFrame, row_id: str = "row_id", nfc: bool = False) -> DataFrame:
    """Clean a sheet of string cells into the point schema.

    The text rules cost far more a row than its bytes, and a sheet of a million rows may be
    one file split: its rows are spread by count first.

    Written as stages whose outputs are referenced by name, so every regular
    expression is evaluated once per row and the generated code stays small.
    A missing CNPJ gets a surrogate `X` + 13-digit row id with `cnpj_gerado`
    set, so it can never be mistaken for a real identifier.

    `nfc` also composes letters that a sheet spells with combining marks (P-03); it
    reads the sheet twice, once for the rows that have such letters.
    """
    cells = ["cnpj", "logradouro", "numero", "bairro", "cidade", "uf"]
    raw = spread_rows(raw)
    s1 = raw.select(F.col(row_id),
                    *[text.fix_encoding(text.strip_ws(F.coalesce(F.col(c), F.lit("")))).alias("_" + c)
                      for c in cells],
                    text.fix_encoding(F.coalesce(F.col("cep"), F.lit(""))).alias("_cep"),
                    text.fix_encoding(F.coalesce(F.col("pdv_vendas"), F.lit(""))).alias("_vendas"))
    if nfc:
        s1 = text.nfc_odd_rows(s1, *["_" + c for c in cells])
    s2 = s1.select(row_id,
                   ids.clean_cnpj("_cnpj").alias("_cnpj1"),
                   *[F.when(F.col("_" + c).isin("nan", "None"), F.lit("")).otherwise(F.col("_" + c)).alias("_" + c)
                     for c in cells[1:]],
                   F.regexp_replace("_cep", r"[^0-9]", "").alias("cep"),
                   ids.parse_money_br("_vendas").alias("pdv_vendas"))
    street, number = text.split_trailing_number(F.col("_logradouro"))
    s3 = s2.select(row_id, "_cnpj1", "_numero", "_bairro", "cep", "pdv_vendas",
                   street.alias("_street"), number.alias("_num_tail"),
                   F.upper(text.strip_ws("_cidade")).alias("cidade"),
                   F.upper(text.strip_ws("_uf")).alias("uf"))
    gerado = F.col("_cnpj1") == ""
    numero_final = F.when(text.strip_ws("_numero") != "", F.col("_numero")).otherwise(F.col("_num_tail"))
    s4 = s3.select(
        row_id,
        F.when(gerado, F.concat(F.lit("X"), F.lpad(F.col(row_id).cast("string"), 13, "0")))
        .otherwise(F.col("_cnpj1")).alias("cnpj"),
        gerado.alias("cnpj_gerado"),
        text.clean_street("_street").alias("logradouro"),
        text.clean_number(numero_final).alias("numero"),
        text.clean_district(F.col("_bairro"), F.col("cidade")).alias("bairro"),
        "cidade", "uf", "cep", "pdv_vendas")
    s5 = s4.withColumn("pdv_endereco_completo",
                       text.compose_address("logradouro", "numero", "bairro", "cidade", "uf", "cep"))
    return s5.withColumn("endereco_cache_key", text.cache_key(F.col("pdv_endereco_completo")))


def validate_points(df: DataFrame, existing: DataFrame | None = None, key: str = "cnpj") -> DataFrame:
    """C-01: one `motivo_invalidade` column (null = valid), by precedence:
    missing required fields (listed) > no number and no CEP > CNPJ repeated in
    the file (every copy) > CNPJ already stored for this input.

    Duplicates are counted with a grouped count joined back (partial
    aggregation map-side), not a window, so one hot CNPJ does not end up as a
    single window partition.  Rejects are kept whole (Q10).
    """
    def empty(c):
        return F.col(c).isNull() | (F.col(c) == "")

    missing = F.concat_ws(", ", *[F.when(empty(c), F.lit(c)) for c in REQUIRED])
    first = (F.when(missing != "", missing)
             .when(empty("numero") & empty("cep"), F.lit("numero")))
    staged = df.withColumn("motivo_invalidade", first)
    counts = (staged.filter(F.col("motivo_invalidade").isNull())
              .groupBy(key).agg(F.count(F.lit(1)).alias("_n")))
    staged = staged.join(counts, key, "left")
    reason = F.coalesce(F.col("motivo_invalidade"),
                        F.when(F.col("_n") > 1, F.lit("CNPJ duplicado no arquivo")))
    staged = staged.withColumn("motivo_invalidade", reason).drop("_n")
    if existing is not None:
        ex = existing.select(F.col(key).alias("_k")).distinct().withColumn("_seen", F.lit(True))
        staged = (staged.join(ex, staged[key] == ex["_k"], "left")
                  .withColumn("motivo_invalidade",
                              F.coalesce(F.col("motivo_invalidade"),
                                         F.when(F.col("_seen"), F.lit("CNPJ duplicado neste input_id"))))
                  .drop("_k", "_seen"))
    return staged


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """U-01/U-02: valid rows and rejects from one reason column."""
    return (validated.filter(F.col("motivo_invalidade").isNull()).drop("motivo_invalidade"),
            validated.filter(F.col("motivo_invalidade").isNotNull()))


def state_bbox_status(df: DataFrame, bounds: DataFrame, lat: str = "pdv_lat", lon: str = "pdv_lon",
                      uf: str = "uf") -> DataFrame:
    """G-09: ok / falha_geolocalizacao / uf_invalida / coordenadas_fora_limites.

    `bounds` is the 27-row state dimension: broadcast is size-safe.
    """
    b = bounds.select(F.col("uf").alias("_uf"), "lat_min", "lat_max", "lon_min", "lon_max")
    j = df.join(F.broadcast(b), F.col(uf) == F.col("_uf"), "left")
    la, lo = F.col(lat), F.col(lon)
    status = (F.when(la.isNull() | lo.isNull() | F.isnan(la) | F.isnan(lo), F.lit("falha_geolocalizacao"))
              .when(F.col("_uf").isNull(), F.lit("uf_invalida"))
              .when(~(la.between(F.col("lat_min"), F.col("lat_max")) & lo.between(F.col("lon_min"), F.col("lon_max"))),
                    F.lit("coordenadas_fora_limites"))
              .otherwise(F.lit("ok")))
    return j.withColumn("motivo_geo", status).drop("_uf", "lat_min", "lat_max", "lon_min", "lon_max")


def flag_outliers(points: DataFrame, z: float = 1.5, pid: str = "pdv_id", lat: str = "lat", lon: str = "lon",
                  by: tuple[str, ...] = (), k: int = 5) -> DataFrame:
    """C-04: nearest-neighbour km > mean + z * population std (per `by` group);
    groups with fewer than 5 points are never flagged.  Also the mean km to the
    k nearest neighbours (`distancia_media_km`)."""
    by = tuple(by)
    nn = knn_distances(points.filter(valid_coord(F.col(lat), F.col(lon))), k, pid=pid, lat=lat, lon=lon, by=by)
    stats = nn.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"),
                                (F.avg("d1_km") + F.lit(float(z)) * F.stddev_pop("d1_km")).alias("_lim"))
    if by:
        j = nn.join(stats, list(by))
    else:
        r = stats.first()  # two scalars to the driver
        j = nn.withColumn("_n", F.lit(r["_n"])).withColumn("_lim", F.lit(r["_lim"]))
    return j.select(pid, *by, F.col("d1_km").alias("dist_vizinho_km"),
                    F.col("dk_mean_km").alias("distancia_media_km"),
                    ((F.col("_n") >= 5) & (F.col("d1_km") > F.col("_lim"))).alias("is_outlier"))


def cep_to_state(df: DataFrame, ranges: DataFrame, cep: str = "cep") -> DataFrame:
    """J-06: state of a CEP by `lo <= cep <= hi`; the narrowest range wins (ties by uf).

    Ranges are exploded into 4-digit prefixes (at most 10,000 rows, a bounded
    broadcast); each prefix holds its candidate ranges sorted by width, and a
    row takes the first one that contains it.  The big side is never grouped.
    """
    r = (ranges.withColumn("_w", F.col("hi").cast("long") - F.col("lo").cast("long"))
         .withColumn("_p", F.explode(F.sequence(F.substring("lo", 1, 4).cast("int"),
                                                F.substring("hi", 1, 4).cast("int")))))
    dim = (r.groupBy("_p").agg(F.array_sort(F.collect_list(F.struct("_w", "uf", "lo", "hi"))).alias("_rs")))
    j = df.join(F.broadcast(dim), F.substring(F.col(cep), 1, 4).try_cast("int") == F.col("_p"), "left")
    hit = F.filter(F.coalesce(F.col("_rs"), F.array()), lambda e: (F.col(cep) >= e["lo"]) & (F.col(cep) <= e["hi"]))
    return j.withColumn("uf_cep", F.try_element_at(hit, F.lit(1))["uf"]).drop("_p", "_rs")


def capital_flag(df: DataFrame, capitals: DataFrame, city: str = "cidade", uf: str = "uf") -> DataFrame:
    """G-08: is the (folded, upper-case) city the capital of its state?  27-row broadcast."""
    cap = capitals.select(F.col("cidade").alias("_cc"), F.col("uf").alias("_cu"), F.lit(True).alias("_cap"))
    j = df.join(F.broadcast(cap), (text.city_key(F.col(city)) == F.col("_cc"))
                & (F.upper(text.strip_ws(F.col(uf))) == F.col("_cu")), "left")
    return j.withColumn("is_capital", F.coalesce("_cap", F.lit(False))).drop("_cc", "_cu", "_cap")
