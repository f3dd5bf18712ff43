"""Predicates on form types, item lists and industry codes, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from outturn.functions import vocab


def _normal(form: Column) -> Column:
    return F.upper(F.trim(form))


def _form_or_amendment(form: Column, forms: list[str]) -> Column:
    """Exact form, or the form followed by ``/`` and anything."""
    return F.substring_index(_normal(form), "/", 1).isin(forms)


def is_announcement(form: Column) -> Column:
    return _form_or_amendment(form, vocab.ANNOUNCEMENT_FORMS)


def is_deregistration(form: Column) -> Column:
    return _form_or_amendment(form, vocab.DEREGISTRATION_FORMS)


def is_periodic(form: Column) -> Column:
    return _normal(form).isin(vocab.PERIODIC_FORMS)


def is_current_report(form: Column) -> Column:
    """A prefix test, so amendments count."""
    return form.startswith(vocab.CURRENT_REPORT_PREFIX)


def is_shell_sic(sic: Column) -> Column:
    return F.trim(F.coalesce(sic, F.lit(""))) == vocab.SHELL_SIC


def has_item(items: Column, code: str) -> Column:
    """Whole-token membership in a comma list; a null or blank list has no items."""
    token = r"(?U)(?:^|,)\s*" + code.replace(".", r"\.") + r"\s*(?:,|$)"
    return F.coalesce(items.contains(code) & items.rlike(token), F.lit(False))


def sector(sic: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(sic, F.lit("")), "[^0-9]", "")
    return F.when(F.length(digits) >= 2, F.substring(digits, 1, 2)).otherwise("unknown")
