"""X-10: the layers of a map as tables; drawing them is left to the reader.

Every layer is joins, a filter and column expressions, so a layer is as large as
the rows it shows and nothing is gathered but the cells of a density grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fmt import address_fallback
from ..functions.geo import jitter

ADDRESS = ("endereco_completo", "logradouro", "numero", "bairro", "cidade", "uf")
BUBBLE_MIN, BUBBLE_MAX, BUBBLE_STEP = 3.0, 12.0, 0.6
LABEL_JITTER_DEG = 0.010


def bubble_size(n: Column) -> Column:
    """Bubble radius: 3 + 0.6 n, kept within 3 and 12."""
    return F.greatest(F.lit(BUBBLE_MIN), F.least(F.lit(BUBBLE_MAX), F.lit(BUBBLE_MIN) + F.lit(BUBBLE_STEP) * n))


def point_layer(points: DataFrame, tenant_id: int, input_id: str | None = None, uf: str | None = None,
                cidade: str | None = None) -> DataFrame:
    """Points of one tenant with their address; a city filter wins over a state filter,
    both whatever the case.  A missing coordinate shows as 0."""
    p = points.filter(F.col("tenant_id") == F.lit(tenant_id))
    if input_id is not None:
        p = p.filter(F.col("input_id") == F.lit(input_id))
    if cidade:
        p = p.filter(F.lower("cidade") == F.lower(F.lit(cidade)))
    elif uf:
        p = p.filter(F.lower("uf") == F.lower(F.lit(uf)))
    return p.select("pdv_id", "cnpj", F.coalesce("lat", F.lit(0.0)).alias("lat"), F.coalesce("lon", F.lit(0.0)).alias("lon"),
                    "cidade", "uf", address_fallback(*ADDRESS).alias("endereco"))


def cluster_layer(members: DataFrame, sectors: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Points with their sector's label and centre.  What the membership stored (lat, lon,
    cidade, uf, cnpj, endereco_completo) wins over the point; `keys` name the sector."""
    stored = ["lat", "lon", "cidade", "uf", "cnpj"]
    m = members.select(*keys, "pdv_id", *[F.col(c).alias("_m_" + c) for c in stored],
                       F.nullif(F.col("endereco_completo"), F.lit("")).alias("_m_end"))
    s = sectors.select(*keys, "cluster_label", "centro_lat", "centro_lon")
    j = m.join(s, keys).join(points, "pdv_id", "left")
    return j.select("pdv_id", "cluster_label", "centro_lat", "centro_lon",
                    *[F.coalesce(F.col("_m_" + c), F.col(c)).alias(c) for c in stored],
                    F.coalesce("_m_end", address_fallback(*ADDRESS)).alias("endereco"))


def density_layer(points: DataFrame, cell_deg: float) -> DataFrame:
    """Number of points in each cell of a grid, its centre and its bubble."""
    def cell(c):
        return F.floor(F.col(c) / F.lit(float(cell_deg))).cast("long")
    g = (points.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
         .groupBy(cell("lat").alias("gy"), cell("lon").alias("gx")).agg(F.count(F.lit(1)).alias("n")))
    return g.select("gy", "gx", "n", ((F.col("gy") + 0.5) * F.lit(float(cell_deg))).alias("cell_lat"),
                    ((F.col("gx") + 0.5) * F.lit(float(cell_deg))).alias("cell_lon"), bubble_size(F.col("n")).alias("tamanho"))


def noise_layer(members: DataFrame, cell_deg: float, cluster: str = "cluster_id") -> DataFrame:
    """Density of the points that no cluster took; a coordinate of 0 counts as missing."""
    left = members.filter(F.col(cluster).isNull() & (F.col("lat") != 0) & (F.col("lon") != 0))
    return density_layer(left, cell_deg)


def route_layer(paths: DataFrame, seq: DataFrame, centres: DataFrame, route: list[str],
                order: str = "sequencia_ordem") -> DataFrame:
    """Vertices of the routes and their stops in one table: `camada` is `caminho` for a
    vertex (from `routing.route_paths`) and `parada` for a stop, each with its route's centre."""
    v = paths.select(*route, F.lit("caminho").alias("camada"), F.col("ponto").cast("long").alias("ordem"),
                     F.lit(None).cast("long").alias("pdv_id"), "lat", "lon")
    s = (seq.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
         .select(*route, F.lit("parada").alias("camada"), F.col(order).cast("long").alias("ordem"), F.col("pdv_id").cast("long").alias("pdv_id"),
                 "lat", "lon"))
    return v.unionByName(s).join(centres.select(*route, "centro_lat", "centro_lon"), route, "left")


def vendor_layer(vendor_points: DataFrame, points: DataFrame, bases: DataFrame) -> DataFrame:
    """Points of every vendor beside the vendor's base and its totals; points without a
    coordinate are left out, vendors without a base stay."""
    p = points.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("pdv_id", "lat", "lon", "cidade", "uf")
    return (vendor_points.select("pdv_id", "vendedor_id").join(p, "pdv_id")
            .join(bases.select("vendedor_id", "base_lat", "base_lon", "total_rotas", "total_pdvs"), "vendedor_id", "left"))


def cep_bubble_layer(ceps: DataFrame, cluster: str = "cluster_id", spread: bool = False) -> DataFrame:
    """One bubble a CEP at its cluster's centre, sized by target clients, or by all clients
    where it has no target; beside it the cluster's totals.  `spread` shifts the bubbles of a
    cluster by a repeatable jitter so that they do not cover each other."""
    tot = ceps.groupBy(cluster).agg(F.sum("clientes_total").cast("long").alias("cluster_total"),
                                    F.sum("clientes_target").cast("long").alias("cluster_target"))
    base = F.when(F.col("clientes_target") > 0, F.col("clientes_target")).otherwise(F.col("clientes_total"))
    lat, lon = F.col("cluster_lat"), F.col("cluster_lon")
    if spread:
        lat, lon = jitter("cep", lat, lon, LABEL_JITTER_DEG)
    return ceps.join(tot, cluster).select(
        cluster, "cep", "clientes_total", "clientes_target", lat.alias("lat"), lon.alias("lon"),
        F.coalesce(F.nullif(F.col("cluster_bairro"), F.lit("")), F.lit("N/D")).alias("bairro"),
        "dist_km", "tempo_min", bubble_size(base).alias("tamanho"), "cluster_total", "cluster_target")
