"""Batch twin of the job-state stream (T-02), checked against DuckDB."""

from __future__ import annotations

from ..sources import fixtures as fx
from ..streaming.stream import _fix_state_cols, job_state
from .registry import register


@register("job_state_batch", sql=fx.with_fixtures("job_log") + """
select job_id, date_trunc('day', criado_em) as dia,
       arg_max(status, (criado_em, id)) as status, arg_max(id, (criado_em, id)) as ultimo_id,
       min(criado_em) as inicio, max(criado_em) as fim, count(*) as n_eventos,
       cast(epoch_us(max(criado_em)) - epoch_us(min(criado_em)) as double) / 1e6 as duracao_s
from job_log group by job_id, date_trunc('day', criado_em)
""")
def q_job_state_batch(spark, sf_dir):
    """T-02 in batch form: latest status, first/last event and duration per (job, day)."""
    return _fix_state_cols(job_state(fx.job_log(spark, sf_dir)))
