"""The flat statistics dataset over all requests, whatever their dates."""

from __future__ import annotations

from pyspark.sql import DataFrame

from permitflow.functions import text as T
from permitflow.operators import reports
from permitflow.plans.daily import Lookups, place, requests


def dataset(pdf: DataFrame | None, api: DataFrame | None, look: Lookups) -> DataFrame:
    """Flat records of both sources: PDF dates are those of the request, API dates those of approval."""
    out = None
    for lines, kind in ((pdf, "requested"), (api, "approved")):
        if lines is None:
            continue
        p = reports.stat_record(place(requests(lines), look), kind)
        p = p.withColumn("species", T.species_text("species"))
        out = p if out is None else out.unionByName(p)
    return out
