"""Report and history builders (X-01..X-12) over DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import format_cnpj
from ..operators.routing import routing_summary
from ..operators.windows import latest_per_key


def optional_filters(df: DataFrame, **eq) -> DataFrame:
    """F-01: conjunction of only the filters that were given (None = not given)."""
    conds = [F.col(k) == F.lit(v) for k, v in eq.items() if v is not None]
    return df.filter(reduce(lambda a, b: a & b, conds)) if conds else df


def history_page(jobs: DataFrame, tenant_id: int, statuses: list[str] | None = None, text: str | None = None,
                 date_from: str | None = None, date_to: str | None = None, limit: int = 20,
                 offset: int = 0, ts: str = "criado_em") -> DataFrame:
    """X-11: tenant-isolated (F-08), optional filters (F-01, F-03), inclusive date
    range as a half-open upper bound (F-04), newest first, one page (L-02) and
    the filtered total beside it (W-02, computed as one scalar)."""
    f = jobs.filter(F.col("tenant_id") == F.lit(tenant_id))
    if statuses:
        f = f.filter(F.col("status").isin(statuses))
    if text:
        f = f.filter(F.col("job_id").ilike(f"%{text}%"))
    if date_from:
        f = f.filter(F.col(ts) >= F.to_timestamp(F.lit(date_from)))
    if date_to:
        f = f.filter(F.col(ts) < F.to_timestamp(F.date_add(F.to_date(F.lit(date_to)), 1)))
    total = f.count()
    page = f.orderBy(F.col(ts).desc(), F.col("id").desc()).offset(offset).limit(limit)
    return page.select("id", "job_id", "input_id", "status", ts, F.lit(total).cast("long").alias("total"))


def _dated(df: DataFrame, date_from: str | None, date_to: str | None, ts: str = "criado_em") -> DataFrame:
    """F-04: both days included, the second as a half-open bound."""
    if date_from:
        df = df.filter(F.col(ts) >= F.to_timestamp(F.lit(date_from)))
    if date_to:
        df = df.filter(F.col(ts) < F.to_timestamp(F.date_add(F.to_date(F.lit(date_to)), 1)))
    return df


def _described(df: DataFrame, text: str | None) -> DataFrame:
    return df.filter(F.contains(F.lower("descricao"), F.lower(F.lit(text)))) if text else df


def run_summary(runs: DataFrame, sectors: DataFrame, done_only: bool = False) -> DataFrame:
    """Newest run of every clustering (ties by id) with its number of sectors and of points;
    0 where the run has no sector.  `done_only` asks for the newest finished run."""
    if done_only:
        runs = runs.filter(F.col("status") == "done")
    last = latest_per_key(runs, ["clusterization_id"], "criado_em", "run_id")
    # Sectors are summed a run before the join, so the history of old runs stays small.
    per_run = sectors.groupBy("run_id").agg(F.count(F.lit(1)).alias("_k"), F.sum("n_pdvs").alias("_n"))
    return (last.join(per_run, "run_id", "left")
            .withColumn("qtd_clusters", F.coalesce("_k", F.lit(0)).cast("long"))
            .withColumn("pdvs_total", F.coalesce("_n", F.lit(0)).cast("long")).drop("_k", "_n"))


def clustering_inputs(jobs: DataFrame, points: DataFrame, tenant_id: int, date_from: str | None = None,
                      date_to: str | None = None, text: str | None = None, limit: int = 5, offset: int = 0) -> DataFrame:
    """X-11: uploads ready for clustering, newest first: one row a finished job (input, date,
    description) with the number of points of the input, its first state and city, and
    beside it the number of different inputs that pass the filters."""
    done = _described(_dated(jobs.filter((F.col("tenant_id") == F.lit(tenant_id)) & (F.col("status") == "done")),
                             date_from, date_to), text)
    total = done.agg(F.count_distinct("input_id").alias("total"))
    heads = done.groupBy("input_id", "criado_em", "descricao").agg(F.count(F.lit(1)).alias("_jobs"))
    page = heads.orderBy(F.col("criado_em").desc(), "input_id", "descricao").offset(offset).limit(limit)
    p = points.filter(F.col("tenant_id") == F.lit(tenant_id)).groupBy("input_id").agg(
        F.min("uf").alias("uf"), F.min("cidade").alias("cidade"), F.count(F.lit(1)).alias("_n"))
    return page.join(p, "input_id", "left").select(
        "input_id", "criado_em", "descricao", "uf", "cidade",
        (F.coalesce("_n", F.lit(0)) * F.col("_jobs")).cast("long").alias("total_pdvs"), total.scalar().alias("total"))


def clustering_history(jobs: DataFrame, runs: DataFrame, sectors: DataFrame, tenant_id: int, date_from: str | None = None,
                       date_to: str | None = None, text: str | None = None, limit: int = 5, offset: int = 0) -> DataFrame:
    """X-11: clustering jobs of a tenant, newest first, each with the sectors and points of
    the newest run of its clustering (0 where it has none), and the filtered total."""
    f = _described(_dated(jobs.filter(F.col("tenant_id") == F.lit(tenant_id)), date_from, date_to), text)
    total = f.agg(F.count(F.lit(1)).alias("total"))
    page = f.orderBy(F.col("criado_em").desc(), F.col("id").desc()).offset(offset).limit(limit)
    s = run_summary(runs.filter(F.col("tenant_id") == F.lit(tenant_id)), sectors).select("clusterization_id", "qtd_clusters", "pdvs_total")
    return page.join(s, "clusterization_id", "left").select(
        "id", "criado_em", "clusterization_id", "descricao", "status",
        F.coalesce("qtd_clusters", F.lit(0)).cast("long").alias("qtd_clusters"),
        F.coalesce("pdvs_total", F.lit(0)).cast("long").alias("pdvs_total"), total.scalar().alias("total"))


def finished_clusterings(runs: DataFrame, sectors: DataFrame, tenant_id: int, limit: int = 50) -> DataFrame:
    """X-11: newest finished run of each clustering of a tenant, newest first."""
    s = run_summary(runs.filter(F.col("tenant_id") == F.lit(tenant_id)), sectors, done_only=True)
    return s.select("clusterization_id", "run_id", "criado_em", "status", "qtd_clusters", "pdvs_total") \
        .orderBy(F.col("criado_em").desc(), F.col("run_id").desc()).limit(limit)


def routing_runs(summaries: DataFrame, jobs: DataFrame, tenant_id: int, limit: int = 200) -> DataFrame:
    """A-09 / X-11: routings of a tenant, newest first (ties by id): date of the last execution,
    different clusters, and sums of routes, points, km and minutes.  km and minutes are summed
    in hundredths and tenths, so the order of rows does not show."""
    g = summaries.filter(F.col("tenant_id") == F.lit(tenant_id)).groupBy("routing_id").agg(
        F.max("criado_em").alias("criado_em"), F.count_distinct("cluster_id").alias("clusters_processados"),
        F.sum("qtd_subclusters").cast("long").alias("total_rotas"), F.sum("qtd_pdvs").cast("long").alias("total_pdvs"),
        (F.sum(F.round(F.col("dist_total_km") * 100, 0).cast("long")) / F.lit(100.0)).alias("total_km"),
        (F.sum(F.round(F.col("tempo_total_min") * 10, 0).cast("long")) / F.lit(10.0)).alias("total_min"))
    page = g.orderBy(F.col("criado_em").desc(), F.col("routing_id").desc()).limit(limit)
    d = jobs.filter(F.col("tenant_id") == F.lit(tenant_id)).select("routing_id", "descricao")
    return page.join(d, "routing_id", "left").withColumn("descricao", F.coalesce("descricao", F.lit("")))


def cluster_route_report(routes: DataFrame, stops: DataFrame, points: DataFrame, centres: DataFrame, cluster: list[str]) -> DataFrame:
    """X-07: per cluster its points, mean, largest and total minutes and km of its routes,
    sales of its points (a missing sale counts as 0) and its centre."""
    s = routing_summary(routes, cluster).select(*cluster, "qtd_pdvs", "tempo_medio_min", "tempo_total_min", "dist_media_km", "dist_total_km")
    most = routes.groupBy(*cluster).agg(F.max("tempo_total_min").alias("tempo_max_min"), F.max("dist_total_km").alias("dist_max_km"))
    cents = F.round(F.coalesce("pdv_vendas", F.lit(0.0)) * 100, 0).cast("long")
    sales = (stops.select(*cluster, "pdv_id").join(points.select("pdv_id", "pdv_vendas"), "pdv_id", "left")
             .groupBy(*cluster).agg((F.sum(cents) / F.lit(100.0)).alias("valor_total_vendas")))
    c = centres.select(*cluster, F.col("lat").alias("centro_lat"), F.col("lon").alias("centro_lon"))
    return s.join(most, cluster).join(sales, cluster, "left").join(c, cluster, "left")


def cep_cluster_report(ceps: DataFrame) -> DataFrame:
    """X-09: per cluster of CEPs the sheet's row: centre's name, CNPJ in its written form,
    district (`Não identificado` where none is known), centre with a decimal comma, different
    CEPs, clients, and mean and largest km and minutes."""
    g = ceps.groupBy("cluster_id").agg(
        F.min("centro_nome").alias("centro_nome"), F.min("centro_cnpj").alias("_cnpj"), F.min(F.nullif(F.col("cluster_bairro"), F.lit(""))).alias("_b"),
        F.round(F.avg("cluster_lat"), 6).alias("_lat"), F.round(F.avg("cluster_lon"), 6).alias("_lon"),
        F.count_distinct("cep").alias("qtd_ceps"), F.sum("clientes_total").cast("long").alias("clientes_total"),
        F.sum("clientes_target").cast("long").alias("clientes_target"),
        F.round(F.avg("dist_km"), 2).alias("distancia_media_km"), F.round(F.avg("tempo_min"), 2).alias("tempo_medio_min"),
        F.round(F.max("dist_km"), 2).alias("distancia_max_km"), F.round(F.max("tempo_min"), 2).alias("tempo_max_min"))

    def comma(c):
        return F.replace(F.format_string("%.6f", F.col(c)), F.lit("."), F.lit(","))
    return g.select("cluster_id", "centro_nome", format_cnpj("_cnpj").alias("centro_cnpj"),
                    F.coalesce("_b", F.lit("Não identificado")).alias("cluster_bairro"), comma("_lat").alias("cluster_lat"),
                    comma("_lon").alias("cluster_lon"), "qtd_ceps", "clientes_total", "clientes_target",
                    "distancia_media_km", "tempo_medio_min", "distancia_max_km", "tempo_max_min")
