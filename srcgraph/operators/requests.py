"""Admission of analysis and query requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.functions.joins import keyed_join
from srcgraph.functions.text import is_repo_url


def admit_requests(requests: DataFrame, sessions: DataFrame, kind: str, host: str = "github.com") -> DataFrame:
    """`(…, ok, status, reason)`, the first failing rule deciding.

    requests  session_id plus `repo_url` (kind "analyze") or `question` (kind "query")
    sessions  known session_id values

    Requests with a missing field are answered without the join: their null session
    ids would all meet in one task.
    """
    body = {"analyze": "repo_url", "query": "question"}[kind]
    present = (F.col("session_id").isNotNull() & (F.col("session_id").cast("string") != "")
               & F.col(body).isNotNull() & (F.col(body) != ""))
    present = F.coalesce(present, F.lit(False))
    missing = requests.filter(~present).withColumn("known", F.lit(None).cast("boolean"))
    known = sessions.select("session_id").distinct().withColumn("known", F.lit(True))
    complete = keyed_join(requests.filter(present), known, ["session_id"], "left").withColumn(
        "known", F.coalesce("known", F.lit(False))
    )
    checked = complete.unionByName(missing)
    # The statuses and the texts of the refusals.
    status = F.when(F.col("known").isNull(), 400).when(~F.col("known"), 404)
    reason = F.when(F.col("known").isNull(), f"sessionId and {'repoUrl' if kind == 'analyze' else body} are required") \
        .when(~F.col("known"), "Session not found")
    if kind == "analyze":
        bad = ~is_repo_url(F.col(body), host)
        status = status.when(bad, 400)
        reason = reason.when(bad, "Invalid GitHub repository URL")
    status = status.otherwise(200)
    return checked.select(
        *requests.columns, (status == 200).alias("ok"), status.alias("status"), reason.alias("reason")
    )
