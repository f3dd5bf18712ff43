"""Episodes and the events around them, from one pass over an entity's history.

Only the calendar day of an event matters for splitting episodes and for finding
the first event after an announcement, so the history is first reduced to one row
per (entity, day). That reduction is keyed by both columns and combined on the map
side, which spreads an entity with a huge history over many tasks; after it an
entity has at most one row per calendar day and the windows by entity are small.
The order windows then replace every range join: "the first event of a kind after
this day" is a running value over the days in reverse.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outturn.functions import forms, vocab

# evidence tag -> the column holding the first event of that kind on a day
OUTCOME_EVENTS = {
    "dereg": "dereg",
    "item5.01": "change_control",
    "item5.06": "shell_exit",
    "item2.01": "completion",
    "item1.02": "termination",
}
_ITEM_EVENTS = {
    "change_control": vocab.ITEM_CHANGE_CONTROL,
    "shell_exit": vocab.ITEM_SHELL_STATUS,
    "completion": vocab.ITEM_COMPLETION,
    "termination": vocab.ITEM_TERMINATION,
    "agreement": vocab.ITEM_MATERIAL_AGREEMENT,
}
_EVENTS = [*OUTCOME_EVENTS.values(), "agreement"]
# place of each kind in the bits of a filing
_BITS = {kind: at for at, kind in enumerate([*_EVENTS, "periodic", "announced", "14d9", "13e3"])}


def _with_order(df: DataFrame) -> DataFrame:
    """``seq`` keeps the source order of same-day rows; without one the accession decides."""
    if "seq" not in df.columns:
        df = df.withColumn("seq", F.lit(0))
    if "primary_document" not in df.columns:
        df = df.withColumn("primary_document", F.lit(None).cast("string"))
    return df


def _tagged(filings: DataFrame, with_announcements: bool) -> DataFrame:
    """One row per filing that counts as something, with ``kinds`` as bits; others drop out here.

    What names a filing is kept where it is an event, so that the many others are short rows. A filing that is periodic and
    nothing else has no day of its own (``rest``): only the first and the last of an entity are ever asked for.
    """
    form, items, filed = F.col("form"), F.col("items"), F.col("filed")
    current = forms.is_current_report(form)
    kinds: dict[str, Column] = {"dereg": forms.is_deregistration(form)}
    for name, code in _ITEM_EVENTS.items():
        kinds[name] = current & forms.has_item(items, code)
    kinds["periodic"] = forms.is_periodic(form)
    if with_announcements:
        kinds |= _announced(form)
    bits = F.col("kinds")
    event = bits.bitwiseAND(sum(1 << _BITS[e] for e in _EVENTS)) != 0
    rest = bits == 1 << _BITS["periodic"]
    # a generated column: the test on it stays here, and is not copied into the reading of the table with all it is made of
    return (
        _with_order(filings)
        .select("cik", "filed", "seq", "accession", "form", "primary_document", F.explode(F.array(_bits(kinds))).alias("kinds"))
        .where(bits != 0)
        .select(
            "cik", F.when(~rest, filed).alias("filed"), rest.alias("rest"), "kinds",
            F.when(_is(bits, "periodic"), filed).alias("periodic"),
            *[F.when(event, F.col(c)).alias(c) for c in ("seq", "accession", "form", "primary_document")],
        )
    )


def _announced(form: Column) -> dict[str, Column]:
    """An announcement, and the two forms that are counted."""
    announced = forms.is_announcement(form)
    return {"announced": announced, "14d9": announced & form.contains("14D9"), "13e3": announced & form.contains("13E3")}


def _bits(kinds: dict[str, Column]) -> Column:
    return reduce(Column.bitwiseOR, [F.when(c, 1 << _BITS[n]).otherwise(0) for n, c in kinds.items()])


def _is(kinds: Column, name: str) -> Column:
    return kinds.bitwiseAND(1 << _BITS[name]) != 0


def event_days(filings: DataFrame, announcements: DataFrame | None = None) -> DataFrame:
    """One row per (cik, filed) with an event or an announcement: first event of each kind, announcement counts.

    ``periodic_from`` and ``periodic_to`` are the first and last periodic report; those of days without anything else are in
    one row of the entity, which has no day. ``announcements`` defaults to the announcement forms inside ``filings``; pass the
    index scan to take them from there instead.
    """
    rows = _tagged(filings, with_announcements=announcements is None)
    if announcements is not None:
        # every row of the index is an announcement, whatever its form
        form = F.col("form")
        counted = {"announced": F.lit(True), "14d9": form.contains("14D9"), "13e3": form.contains("13E3")}
        rows = rows.unionByName(
            announcements.select("cik", "filed", F.lit(False).alias("rest"), _bits(counted).alias("kinds")),
            allowMissingColumns=True,
        )
    event = F.struct("filed", "seq", "accession", "form", "primary_document")
    kinds = F.col("kinds")
    return rows.groupBy("cik", "filed", "rest").agg(
        *[F.min(F.when(_is(kinds, n), event)).alias(n) for n in _EVENTS],
        F.min("periodic").alias("periodic_from"),
        F.max("periodic").alias("periodic_to"),
        *[F.count_if(_is(kinds, n)).alias(f"n_{n}") for n in ("announced", "14d9", "13e3")],
    ).drop("rest")


def announcement_days(
    filings: DataFrame,
    announcements: DataFrame | None = None,
    gap_days: int = vocab.EPISODE_GAP_DAYS,
) -> DataFrame:
    """Announcement days with their episode number and the events before and after.

    An episode ends when the gap to the next announcement exceeds ``gap_days`` or when
    a termination or deregistration falls strictly between the two.
    """
    days = event_days(filings, announcements)
    by_day = Window.partitionBy("cik").orderBy("filed")
    before = by_day.rowsBetween(Window.unboundedPreceding, -1)
    upto = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = (
        Window.partitionBy("cik")
        .orderBy(F.col("filed").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # ordered like the others, so that one pass over the days of an entity serves all three
    entity = by_day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    is_announced = F.col("n_announced") > 0
    is_mark = F.col("dereg").isNotNull() | F.col("termination").isNotNull()
    counts = ["n_announced", "n_14d9", "n_13e3"]
    marked = days.select(
        "*",
        F.max(F.when(is_announced, F.col("filed"))).over(before).alias("prev_announced"),
        F.max(F.when(is_mark, F.col("filed"))).over(before).alias("prev_mark"),
        F.last("agreement", ignorenulls=True).over(upto).alias("prior_agreement"),
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in counts],
        F.max(F.when(is_announced, F.col("filed"))).over(entity).alias("final_announced"),
        F.min("periodic_from").over(entity).alias("first_periodic"),
        F.max("periodic_to").over(entity).alias("last_periodic"),
        *[F.sum(c).over(entity).alias(f"{c}_total") for c in counts],
        *[F.last(e, ignorenulls=True).over(after).alias(f"next_{e}") for e in _EVENTS],
    ).drop(*_EVENTS, "periodic_from", "periodic_to")
    starts = (
        F.col("prev_announced").isNull()
        | (F.datediff("filed", "prev_announced") > gap_days)
        | F.coalesce(F.col("prev_mark") > F.col("prev_announced"), F.lit(False))
    )
    return (
        marked.where(is_announced)
        .withColumn("starts", starts)
        .withColumn("episode_no", F.sum(F.col("starts").cast("int")).over(upto).cast("int"))
    )


def episode_timeline(
    filings: DataFrame,
    announcements: DataFrame | None = None,
    gap_days: int = vocab.EPISODE_GAP_DAYS,
) -> DataFrame:
    """One row per episode with everything later operators need to label it.

    Columns: cik, episode_no, announced, last_announcement, next_announced,
    n_announcements, tender_offer_filing, going_private, first_periodic,
    last_periodic, the first event of each kind after the announcement, and the
    material-agreement reports either side of it.
    """
    return timeline_of(announcement_days(filings, announcements, gap_days))


def timeline_of(days: DataFrame) -> DataFrame:
    """The episode timeline from :func:`announcement_days`, for those who need both."""
    in_order = Window.partitionBy("cik").orderBy("filed")

    def within(count: str) -> Column:
        following = F.lead(f"{count}_before").over(in_order)
        return F.coalesce(following, F.col(f"{count}_total")) - F.col(f"{count}_before")

    return days.where("starts").select(
        "cik",
        "episode_no",
        F.col("filed").alias("announced"),
        F.coalesce(F.lead("prev_announced").over(in_order), F.col("final_announced")).alias(
            "last_announcement"
        ),
        F.lead("filed").over(in_order).alias("next_announced"),
        within("n_announced").alias("n_announcements"),
        (within("n_14d9") > 0).alias("tender_offer_filing"),
        (within("n_13e3") > 0).alias("going_private"),
        "first_periodic",
        "last_periodic",
        *[F.col(f"next_{e}").alias(e) for e in OUTCOME_EVENTS.values()],
        "prior_agreement",
        "next_agreement",
    )


def episodes(timeline: DataFrame) -> DataFrame:
    return timeline.select(
        "cik", "episode_no", "announced", "last_announcement", "next_announced", "n_announcements"
    )


def episode_filings(
    announcements: DataFrame, days: DataFrame
) -> DataFrame:
    """Every announcement filing with the episode it belongs to, one row each.

    ``days`` is :func:`announcement_days`. Kept long rather than as an array per
    episode, so no episode has to fit in one row.
    """
    members = days.select("cik", "filed", "episode_no", "n_announced_before")
    return (
        _with_order(announcements)
        .select("cik", "filed", "seq", "accession", "form")
        .join(members, ["cik", "filed"])
    )


def episode_arrays(
    announcements: DataFrame, days: DataFrame, chunk: int = 10_000
) -> DataFrame:
    """Form and accession arrays per episode, in filing order.

    An array holds at most ``chunk`` filings; a longer episode continues on further
    rows with the next ``chunk_no``, so nothing is dropped and no row is unbounded.
    """
    first = days.where("starts").select(
        "cik", "episode_no", F.col("filed").alias("announced"),
        F.col("n_announced_before").alias("episode_offset"),
    )
    same_day = Window.partitionBy("cik", "filed").orderBy("seq", "accession", "form")
    rows = episode_filings(announcements, days).join(first, ["cik", "episode_no"])
    position = (
        F.col("n_announced_before") - F.col("episode_offset") + F.row_number().over(same_day) - 1
    )
    row = F.struct("position", "form", "accession")
    return (
        rows.withColumn("position", position)
        .withColumn("chunk_no", F.floor(F.col("position") / chunk).cast("int"))
        .groupBy("cik", "episode_no", "announced", "chunk_no")
        .agg(F.sort_array(F.collect_list(row)).alias("rows"))
        .select(
            "cik", "episode_no", "announced", "chunk_no",
            F.col("rows.form").alias("announcement_forms"),
            F.col("rows.accession").alias("announcement_accessions"),
        )
    )


def announcement_report(
    timeline: DataFrame,
    lookback_days: int = vocab.AGREEMENT_LOOKBACK_DAYS,
    lookahead_days: int = vocab.AGREEMENT_LOOKAHEAD_DAYS,
) -> DataFrame:
    """The material-agreement report nearest the announcement, or null.

    Candidates lie between ``announced - lookback`` and ``last + lookahead``; at equal
    distance the earlier report wins.
    """
    prior, following = F.col("prior_agreement"), F.col("next_agreement")
    prior_ok = prior["filed"] >= F.date_sub("announced", lookback_days)
    next_ok = following["filed"] <= F.date_add("last_announcement", lookahead_days)
    nearer = F.datediff("announced", prior["filed"]) <= F.datediff(following["filed"], F.col("announced"))
    chosen = (
        F.when(prior_ok & (~F.coalesce(next_ok, F.lit(False)) | nearer), prior)
        .when(next_ok, following)
    )
    return timeline.select("*", chosen.alias("agreement")).select(
        "cik", "episode_no", "announced", "last_announcement",
        F.col("agreement.filed").alias("report_filed"),
        F.col("agreement.form").alias("report_form"),
        F.col("agreement.accession").alias("accession"),
        F.col("agreement.primary_document").alias("primary_document"),
    )
