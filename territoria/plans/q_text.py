"""Registered text / identifier queries over the uploaded-sheet fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators.quality import clean_points_raw, validate_points
from ..sources import fixtures as fx
from . import duck as D
from .registry import register


def _clean_sql() -> str:
    def cell(c):
        v = D.fix_encoding(D.strip(f"coalesce({c}, '')"))
        return f"(case when {v} in ('nan', 'None') then '' else {v} end)"

    cnpj = D.clean_cnpj(D.fix_encoding(D.strip("coalesce(cnpj, '')")))
    gerado = f"({cnpj} = '')"
    street, number = D.split_trailing_number("_log")
    numero_final = f"(case when {D.strip('_num')} <> '' then _num else {number} end)"
    return f"""
s1 as (
  select row_id,
         case when {gerado} then 'X' || lpad(cast(row_id as varchar), 13, '0') else {cnpj} end as cnpj,
         {gerado} as cnpj_gerado,
         {cell('logradouro')} as _log, {cell('numero')} as _num, {cell('bairro')} as _bai,
         upper({D.strip(cell('cidade'))}) as cidade,
         upper({D.strip(cell('uf'))}) as uf,
         {D.rr(D.fix_encoding("coalesce(cep, '')"), '[^0-9]', '')} as cep,
         {D.parse_money_br("coalesce(pdv_vendas, '')")} as pdv_vendas
  from points_raw),
s2 as (
  select row_id, cnpj, cnpj_gerado,
         {D.clean_street(street)} as logradouro,
         {D.clean_number(numero_final)} as numero,
         {D.clean_district('_bai', 'cidade')} as bairro,
         cidade, uf, cep, pdv_vendas
  from s1),
clean as (
  select *, {D.cache_key(D.compose_address('logradouro', 'numero', 'bairro', 'cidade', 'uf', 'cep'))} as endereco_cache_key,
         {D.compose_address('logradouro', 'numero', 'bairro', 'cidade', 'uf', 'cep')} as pdv_endereco_completo
  from s2)
"""


CLEAN_SQL = fx.with_fixtures("points_raw").rstrip() + "," + _clean_sql()


@register("points_clean", sql=CLEAN_SQL + "select * from clean")
def q_points_clean(spark, sf_dir):
    """S-01 cells -> P-03, P-14..P-19, P-21, P-25: the sheet cleaned into the point schema."""
    return clean_points_raw(fx.points_raw(spark, sf_dir))


@register("points_clean_nfc", sql=CLEAN_SQL + "select * from clean")
def q_points_clean_nfc(spark, sf_dir):
    """P-03 / N-02: a sheet whose accents are combining marks is cleaned into the same points."""
    raw = fx.points_raw(spark, sf_dir)
    for composed, spelt in (("ã", "a\u0303"), ("ô", "o\u0302"), ("Ç", "C\u0327")):
        raw = raw.withColumn("logradouro", F.replace("logradouro", F.lit(composed), F.lit(spelt)))
    return clean_points_raw(raw, nfc=True)


@register("address_forms", sql=CLEAN_SQL + f"""
select row_id,
       {D.normalize_base('pdv_endereco_completo')} as endereco_base,
       {D.normalize_for_geocoding(D.normalize_base('pdv_endereco_completo'))} as endereco_geocode,
       {D.normalize_full_address('pdv_endereco_completo')} as endereco_completo_norm,
       {D.tidy("upper(cidade) || ' ,, '")} as cidade_tidy,
       nullif({D.strip(f"upper({D.fold('bairro')})")}, '') as bairro_key
from clean
""")
def q_address_forms(spark, sf_dir):
    """P-04..P-13: base, geocoding and full-normalised forms of every composed address."""
    c = clean_points_raw(fx.points_raw(spark, sf_dir))
    base = text.normalize_base(F.col("pdv_endereco_completo"))
    return c.select("row_id", base.alias("endereco_base"),
                    text.normalize_for_geocoding(base).alias("endereco_geocode"),
                    text.normalize_full_address(F.col("pdv_endereco_completo")).alias("endereco_completo_norm"),
                    text.tidy(F.concat(F.upper("cidade"), F.lit(" ,, "))).alias("cidade_tidy"),
                    text.city_key(F.col("bairro")).alias("bairro_key"))


@register("points_validate", sql=CLEAN_SQL + """,
staged as (
  select *, case
      when concat_ws(', ', case when cnpj is null or cnpj = '' then 'cnpj' end,
                           case when logradouro is null or logradouro = '' then 'logradouro' end,
                           case when cidade is null or cidade = '' then 'cidade' end,
                           case when uf is null or uf = '' then 'uf' end) <> ''
        then concat_ws(', ', case when cnpj is null or cnpj = '' then 'cnpj' end,
                           case when logradouro is null or logradouro = '' then 'logradouro' end,
                           case when cidade is null or cidade = '' then 'cidade' end,
                           case when uf is null or uf = '' then 'uf' end)
      when (numero is null or numero = '') and (cep is null or cep = '') then 'numero' end as m1
  from clean),
cnt as (select cnpj, count(*) as n from staged where m1 is null group by cnpj)
select s.row_id, s.cnpj, s.uf,
       coalesce(s.m1, case when c.n > 1 then 'CNPJ duplicado no arquivo' end) as motivo_invalidade
from staged s left join cnt c on c.cnpj = s.cnpj
""")
def q_points_validate(spark, sf_dir):
    """C-01: reason per row (missing fields > no number and no CEP > CNPJ repeated in file)."""
    c = clean_points_raw(fx.points_raw(spark, sf_dir))
    return validate_points(c).select("row_id", "cnpj", "uf", "motivo_invalidade")


@register("ids_formats", sql=fx.with_fixtures("points_raw") + f"""
select row_id,
       case when length({D.rr("coalesce(cnpj, '')", '[^0-9]', '')}) = 14 then {D.rr("coalesce(cnpj, '')", '[^0-9]', '')} end as cnpj14,
       case when length({D.rr("coalesce(cep, '')", '[^0-9]', '')}) in (5, 8) then lpad({D.rr("coalesce(cep, '')", '[^0-9]', '')}, 8, '0') end as cep8,
       (cep = '' or not regexp_matches(cep, '^[0-9]+$') or length(cep) <> 8 or cep = '00000000') as cep_ruim,
       case when length(lpad(cnpj, 14, '0')) = 14
            then regexp_replace(lpad(cnpj, 14, '0'), '^(\\d{{2}})(\\d{{3}})(\\d{{3}})(\\d{{4}})(\\d{{2}})$', '\\1.\\2.\\3/\\4-\\5')
            else lpad(cnpj, 14, '0') end as cnpj_fmt
from points_raw
""")
def q_ids_formats(spark, sf_dir):
    """P-22, P-23, P-24 over the sheet's raw CNPJ and CEP cells."""
    r = fx.points_raw(spark, sf_dir)
    return r.select("row_id", ids.valid_cnpj14("cnpj").alias("cnpj14"), ids.valid_cep("cep").alias("cep8"),
                    ids.bad_cep("cep").alias("cep_ruim"), ids.format_cnpj("cnpj").alias("cnpj_fmt"))
