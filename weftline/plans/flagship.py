"""A cost-centre style mapping from source to targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline import functions as E
from weftline.operators.joins import lookup
from weftline.operators.project import expression, filter_rows
from weftline.plans.catalog import Tables, query
from weftline.session import scratch_path
from weftline.sinks import write_files

_SQL = """
SELECT c_custkey AS centre_code, 'LC' || n_name AS country_code,
       c_name || '-' || CASE WHEN c_mktsegment = 'BUILDING' THEN 'B' ELSE 'O' END AS centre_name,
       CASE WHEN c_acctbal < 0 THEN 'I' ELSE 'C' END AS action_code,
       '' AS blank
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
WHERE c_acctbal >= 0
"""


def cost_centres(t: Tables) -> DataFrame:
    """Source -> lookup -> expression -> filter."""
    named = lookup(t.customer, t.nation, {"c_nationkey": "n_nationkey"}, ["n_name"])
    suffix = E.iif(F.col("c_mktsegment") == "BUILDING", "B", "O")
    active = filter_rows(named, "c_acctbal >= 0")
    return expression(active, {
        "centre_code": F.col("c_custkey"),
        "country_code": E.concat(F.lit("LC"), "n_name"),
        "centre_name": E.concat_op("c_name", F.lit("-"), suffix),
        "action_code": E.iif(F.col("c_acctbal") < 0, "I", "C"),
        "blank": F.lit(""),
    })


@query("flagship_cost_centres", _SQL)
def flagship(t: Tables) -> DataFrame:
    """The mapping with its file target, read back."""
    path = scratch_path(t.spark, "cost-centres")
    write_files(cost_centres(t), path)
    return t.spark.read.parquet(path)
