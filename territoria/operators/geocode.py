"""Geocoding as joins (J-01..J-03) and the ingest flow (C-02).

The reference calls a cache table row by row and then HTTP geocoders.  Here
every tier is a reference table and the whole batch meets each tier in one
equi-join: cache by canonical address key, then an address gazetteer by
(street, number, city, state), then a street gazetteer by (street, city,
state).  The first tier with a coordinate wins; a tier's coordinate is only
taken when it is not a generic fallback point (G-06).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.geo import generic_coord
from ..sources import dims
from .quality import clean_points_raw, split_valid, state_bbox_status, validate_points
from ..session import cut_lineage
from .tables import insert_ignore, upsert_guarded

NO_HIT = "falha"


def geocode_cascade(rows: DataFrame, cache: DataFrame, gaz_number: DataFrame | None = None,
                    gaz_street: DataFrame | None = None, capitals: DataFrame | None = None,
                    capital_polygons: DataFrame | None = None, row_id: str = "row_id") -> DataFrame:
    """J-01 + J-02: append pdv_lat, pdv_lon, status_geolocalizacao.

    `rows` needs endereco_cache_key, logradouro, numero, cidade, uf.
    `cache`: endereco, lat, lon.  `gaz_number`: rua_key, numero, cidade, uf,
    lat, lon.  `gaz_street`: rua_key, cidade, uf, lat, lon.  Each lookup side
    is de-duplicated on its key first so no join fans out.

    With `capitals` (cidade, uf) and `capital_polygons` (vertex rows keyed by
    cidade_key, uf_key, ring, seq, lon, lat), a row in a capital only takes a
    tier's coordinate that lies inside its city polygon (banded ray casting on
    the candidate coordinates of capital rows only).
    """
    r = rows.withColumn("_rua", text.normalize_full_address(F.col("logradouro")))
    tiers = []
    c = (cache.select(F.col("endereco").alias("endereco_cache_key"), "lat", "lon")
         .groupBy("endereco_cache_key").agg(F.min_by(F.struct("lat", "lon"), F.struct("lat", "lon")).alias("_t1")))
    r = r.join(c, "endereco_cache_key", "left")
    tiers.append(("_t1", "cache"))
    if gaz_number is not None:
        g = (gaz_number.select(F.col("rua_key").alias("_rua"), "numero", "cidade", "uf", "lat", "lon")
             .groupBy("_rua", "numero", "cidade", "uf").agg(F.min_by(F.struct("lat", "lon"), F.struct("lat", "lon")).alias("_t2")))
        r = r.join(g, ["_rua", "numero", "cidade", "uf"], "left")
        tiers.append(("_t2", "gazetteer_numero"))
    if gaz_street is not None:
        g = (gaz_street.select(F.col("rua_key").alias("_rua"), "cidade", "uf", "lat", "lon")
             .groupBy("_rua", "cidade", "uf").agg(F.min_by(F.struct("lat", "lon"), F.struct("lat", "lon")).alias("_t3")))
        r = r.join(g, ["_rua", "cidade", "uf"], "left")
        tiers.append(("_t3", "gazetteer_rua"))
    gate = None
    if capitals is not None and capital_polygons is not None:
        from .polygons import point_in_polygon
        from .quality import capital_flag
        r = capital_flag(r, capitals)
        cands = [F.when(F.col(t).isNotNull(), F.struct(F.lit(i).alias("tier"), F.col(t + ".lat").alias("lat"),
                                                         F.col(t + ".lon").alias("lon")))
                 for i, (t, _) in enumerate(tiers)]
        cp = (r.filter("is_capital").select(row_id, text.city_key(F.col("cidade")).alias("cidade_key"),
                                             F.upper(F.col("uf")).alias("uf_key"),
                                             F.explode(F.filter(F.array(*cands), lambda x: x.isNotNull())).alias("_c"))
              .select(row_id, "cidade_key", "uf_key", F.col("_c.tier").alias("tier"),
                      F.col("_c.lat").alias("lat"), F.col("_c.lon").alias("lon"))
              .withColumn("_cand", F.col(row_id) * 16 + F.col("tier")))
        tested = point_in_polygon(cp, capital_polygons, "_cand", ["cidade_key", "uf_key"], ring="ring")
        gate = tested.groupBy(row_id).agg(*[F.max(F.when(F.col("tier") == i, F.coalesce("dentro", F.lit(False))))
                                            .alias(f"_in{i}") for i in range(len(tiers))])
        r = r.join(gate, row_id, "left")
    picks = []
    for i, (col, name) in enumerate(tiers):
        usable = F.col(col).isNotNull() & ~generic_coord(F.col(col + ".lat"), F.col(col + ".lon"))
        if gate is not None:
            usable = usable & (~F.col("is_capital") | F.coalesce(F.col(f"_in{i}"), F.lit(False)))
        picks.append(F.when(usable, F.struct(F.col(col + ".lat").alias("lat"), F.col(col + ".lon").alias("lon"),
                                             F.lit(name).alias("origem"))))
    best = F.coalesce(*picks) if picks else F.lit(None)
    r = r.withColumn("_g", best)
    return (r.withColumn("pdv_lat", F.col("_g.lat")).withColumn("pdv_lon", F.col("_g.lon"))
            .withColumn("status_geolocalizacao", F.coalesce(F.col("_g.origem"), F.lit(NO_HIT)))
            .drop("_g", "_rua", *[t for t, _ in tiers], *[f"_in{i}" for i in range(len(tiers))]))


def cache_write_back(cache: DataFrame, geocoded: DataFrame) -> DataFrame:
    """J-03: new coordinates (not from the cache, not failures) upserted into the
    cache; rows stamped `manual_edit` stay as they are (K-02)."""
    fresh = (geocoded.filter(~F.col("status_geolocalizacao").isin("cache", NO_HIT))
             .select(F.col("endereco_cache_key").alias("endereco"), F.col("pdv_lat").alias("lat"),
                     F.col("pdv_lon").alias("lon"), F.col("status_geolocalizacao").alias("origem"), "row_id"))
    return upsert_guarded(cache, fresh, ["endereco"], ["lat", "lon", "origem"],
                          guard=F.col("origem") == "manual_edit", reject=generic_coord("lat", "lon"), order="row_id")


def ingest_points(raw: DataFrame | None, stored: DataFrame, cache: DataFrame, gaz_number: DataFrame | None,
                  gaz_street: DataFrame | None, spark_dims_source, clean: DataFrame | None = None
                  ) -> tuple[DataFrame, DataFrame]:
    """C-02: clean -> validate (incl. CNPJs already stored) -> geocode -> state box
    -> insert-ignore.  Returns (decision per sheet row, new stored table).

    The cleaned sheet feeds several branches, so it is checkpointed once to
    the shared folder instead of re-running the text rules per branch.
    """
    if clean is None:
        clean = cut_lineage(clean_points_raw(raw))
    validated = validate_points(clean, existing=stored)
    valid, rejects = split_valid(validated)
    geo = geocode_cascade(valid, cache, gaz_number, gaz_street)
    boxed = state_bbox_status(geo, dims.state_bounds(spark_dims_source))
    ok = boxed.filter(F.col("motivo_geo") == "ok")
    decision = (rejects.select("row_id", "cnpj", F.col("motivo_invalidade").alias("motivo"))
                .unionByName(boxed.select("row_id", "cnpj", F.col("motivo_geo").alias("motivo"))))
    new_rows = ok.select(*[c for c in stored.columns if c in ok.columns])
    return decision, insert_ignore(stored, new_rows, ["cnpj"], order="row_id" if "row_id" in stored.columns else None)


def reverse_geocode(centres: DataFrame, cache: DataFrame, gazetteer: DataFrame, cid: str = "centro_id",
                    tol: float = 1e-6) -> DataFrame:
    """C-21: centre coordinates -> (rua, bairro, origem).  First the reverse cache
    (coordinates equal within `tol`: equi-join on a grid of edge 10*tol and its
    8 neighbours, then the exact residual), else the nearest gazetteer point
    (exact grid nearest, J-07)."""
    from .spatial import nearest
    step = tol * 10
    c = centres.select(cid, "lat", "lon")
    k = cache.select(F.col("lat").alias("_klat"), F.col("lon").alias("_klon"), F.col("rua").alias("_krua"),
                     F.col("bairro").alias("_kbai"))
    k = k.withColumn("_a", F.floor(F.col("_klat") / step)).withColumn("_b", F.floor(F.col("_klon") / step))
    offs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    q = (c.withColumn("_o", F.explode(offs)).withColumn("_a", F.floor(F.col("lat") / step) + F.col("_o.i"))
         .withColumn("_b", F.floor(F.col("lon") / step) + F.col("_o.j")))
    hits = (q.join(k, ["_a", "_b"]).filter((F.abs(F.col("_klat") - F.col("lat")) < tol)
                                          & (F.abs(F.col("_klon") - F.col("lon")) < tol))
            .groupBy(cid).agg(F.min(F.struct("_krua", "_kbai")).alias("_h")))
    c2 = c.join(hits, cid, "left")
    found = c2.filter(F.col("_h").isNotNull()).select(cid, F.col("_h._krua").alias("rua"),
                                                      F.col("_h._kbai").alias("bairro"), F.lit("cache").alias("origem"))
    miss = c2.filter(F.col("_h").isNull()).select(cid, "lat", "lon")
    g = gazetteer.select(F.col("gid"), "lat", "lon", F.col("rua").alias("_grua"), F.col("bairro").alias("_gbai"))
    near = nearest(miss, g.select("gid", "lat", "lon"), "gid", out_id="gid").join(g.drop("lat", "lon"), "gid")
    return found.unionByName(near.select(cid, F.col("_grua").alias("rua"), F.col("_gbai").alias("bairro"),
                                         F.lit("gazetteer").alias("origem")))
