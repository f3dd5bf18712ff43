"""How an episode ended, from the events that follow it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outturn.functions import vocab
from outturn.operators.timeline import OUTCOME_EVENTS


def label_outcomes(
    timeline: DataFrame,
    data_cut: str | date,
    resolution_days: int = vocab.RESOLUTION_DAYS,
    survival_days: int = vocab.SURVIVAL_DAYS,
    pending_days: int = vocab.PENDING_DAYS,
) -> DataFrame:
    """Adds label, resolved_on, days_to_resolution, evidence and the resolving filing.

    An event counts when it is filed after the announcement and no later than
    ``resolution_days`` after the last announcement, and before the next episode. A
    periodic report filed more than ``survival_days`` after the last announcement shows
    that the registrant carried on, however late it comes.
    """
    cut = F.lit(str(data_cut)).cast("date")
    horizon = F.least(
        F.date_add("last_announcement", resolution_days), F.date_sub("next_announced", 1)
    )
    hit = {e: F.when(F.col(e)["filed"] <= horizon, F.col(e)) for e in OUTCOME_EVENTS.values()}
    found = timeline.select(
        *[c for c in timeline.columns if c not in hit],
        *[c.alias(e) for e, c in hit.items()],
        F.coalesce(F.col("first_periodic") <= F.col("announced"), F.lit(False)).alias("registrant"),
        F.coalesce(
            F.col("last_periodic") > F.date_add("last_announcement", survival_days), F.lit(False)
        ).alias("survived"),
    )

    def verdict(label: str, event: str | None = None) -> Column:
        by = F.col(event) if event else F.lit(None).cast(timeline.schema["dereg"].dataType)
        return F.struct(F.lit(label).alias("label"), by.alias("by"))

    def seen(event: str) -> Column:
        return F.col(event).isNotNull()

    survived = F.col("survived")
    outcome = (
        F.when(~F.col("registrant"), verdict("not_registrant"))
        .when(seen("dereg"), verdict("completed", "dereg"))
        .when(seen("shell_exit"), verdict("completed_shell", "shell_exit"))
        .when(seen("change_control") & ~survived, verdict("completed", "change_control"))
        .when(survived & seen("termination"), verdict("terminated", "termination"))
        .when(survived & seen("completion"), verdict("acquirer_side", "completion"))
        .when(survived, verdict("unresolved"))
        .when(seen("completion"), verdict("completed", "completion"))
        .when(F.datediff(cut, F.col("last_announcement")) < pending_days, verdict("pending"))
        .otherwise(verdict("unresolved"))
    )
    evidence = F.array_compact(
        F.array(
            *[
                F.concat(
                    F.lit(f"{tag}:"), F.col(e)["form"], F.lit("@"), F.col(e)["filed"].cast("string")
                )
                for tag, e in OUTCOME_EVENTS.items()
            ]
        )
    )
    by = F.col("outcome.by")
    return found.select("*", outcome.alias("outcome"), evidence.alias("evidence")).select(
        "cik", "episode_no", "announced", "last_announcement", "next_announced",
        "n_announcements", "tender_offer_filing", "going_private",
        F.col("outcome.label").alias("label"),
        by["filed"].alias("resolved_on"),
        F.datediff(by["filed"], F.col("announced")).alias("days_to_resolution"),
        "evidence",
        by["accession"].alias("resolved_accession"),
        by["form"].alias("resolved_form"),
        F.nullif(by["primary_document"], F.lit("")).alias("resolved_document"),
    )
