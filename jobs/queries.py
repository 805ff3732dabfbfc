"""The jobs as queries: each runs twice over the whole tables into a new folder, and gives the output as it then stands."""

from __future__ import annotations

import uuid

from freshet.plans import contract
from freshet.scratch import scratch_root
from jobs import delivery_intake, gage_report


def _folder(spark, name: str) -> str:
    return f"{scratch_root(spark)}/jobs/{name}-{uuid.uuid4().hex}"


def job1_gage_report(spark, sf_dir):
    config = gage_report.Config(sf_dir, _folder(spark, "gage-report"), contract.START, contract.END, contract.COEFFICIENT)
    for _ in range(2):
        gage_report.run(spark, config)
    return gage_report.result(spark, config.out)


def job2_delivery_intake(spark, sf_dir):
    folder = _folder(spark, "delivery-intake")
    config = delivery_intake.Config(f"{sf_dir}/documents.parquet", f"{folder}/out", f"{folder}/checkpoint")
    for _ in range(2):
        delivery_intake.run(spark, config)
    return delivery_intake.result(spark, config.out)


QUERIES = {"job1_gage_report": job1_gage_report, "job2_delivery_intake": job2_delivery_intake}

_SPACE = r"'[ \t\n\x0B\f\r]+'"
ORACLES = {
    "job1_gage_report": f"""WITH RECURSIVE {contract._UNIT}, m AS (
  SELECT date, gage_id, comid, flow_cms AS observed_cms, {contract._FLOW} AS modeled_cms FROM {contract._COMPILED} JOIN unit USING (comid)
), v AS (SELECT *, CASE WHEN observed_cms <= 0 THEN 'dry' WHEN modeled_cms <= 0 THEN 'unmodeled' WHEN modeled_cms / observed_cms > 2 THEN 'high' WHEN modeled_cms / observed_cms < 0.5 THEN 'low' ELSE 'met' END AS verdict FROM m),
g AS (SELECT gage_id, comid, COUNT(*) AS n_months, COUNT(*) FILTER (WHERE verdict = 'met') AS n_met, AVG(modeled_cms - observed_cms) AS bias,
  sqrt(AVG((modeled_cms - observed_cms) * (modeled_cms - observed_cms))) AS rmse, var_pop(observed_cms) AS spread FROM v GROUP BY ALL)
SELECT gage_id, comid, date, observed_cms, modeled_cms, verdict, n_months, n_met, bias, rmse, CASE WHEN spread > 0 THEN 1 - rmse * rmse / spread END AS nse,
CASE WHEN n_met >= 0.5 * n_months THEN 'good' WHEN n_met * 2 >= 0.5 * n_months THEN 'fair' ELSE 'poor' END AS grade FROM v JOIN g USING (gage_id, comid)""",
    "job2_delivery_intake": f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, string_split(trim(regexp_replace(unnest(string_split(t, chr(10))), {_SPACE}, ' ', 'g'), ' '), ' ') AS w FROM d),
s AS (SELECT doc_id, CASE WHEN array_to_string(w, '') = '' THEN 'blank' WHEN len(w) < 14 THEN 'short'
  WHEN regexp_matches(w[2], '^(1[6-9]|[2-9][0-9])[0-9]{{2}}$') AND len(list_filter(w[3:14], lambda x: NOT regexp_matches(x, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$'))) = 0 THEN 'row' ELSE 'bad' END AS state FROM w),
n AS (SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (WHERE state IN ('row', 'bad')) AS n_rows, COUNT(*) FILTER (WHERE state = 'short') AS n_short, COUNT(*) FILTER (WHERE state = 'bad') AS n_bad FROM s GROUP BY doc_id),
f AS (SELECT t, MIN(doc_id) AS first FROM d GROUP BY t)
SELECT d.doc_id, n_lines, n_rows, n_short, n_bad, sha256(d.t) AS text_sha256, CASE WHEN first <> d.doc_id THEN first END AS copy_of,
CASE WHEN n_rows = 0 THEN 'empty' WHEN n_bad > 0 THEN 'broken' WHEN first <> d.doc_id THEN 'copy' ELSE 'usable' END AS status, source
FROM d JOIN n USING (doc_id) JOIN f ON d.t = f.t""",
}
