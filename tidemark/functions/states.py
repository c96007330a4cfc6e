"""States of contents, sources and retries as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What each kind of state may be.
STATES = {
    "read_state": ("unread", "reading", "read"),
    "processing": ("pending", "in_progress", "succeeded", "failed"),
    "tag_scope": ("system", "custom"),
    "source_kind": ("article", "thread", "post", "website", "video", "podcast", "pdf"),
    "refresh": ("pending", "in_progress", "succeeded", "failed", "no_feed"),
}


def state(kind: str, value: Column) -> Column:
    """The value if it is one of its kind's, else null."""
    return F.when(value.isin(*STATES[kind]), value)


def needs_processing(fetch: Column, parse: Column, has_document: Column) -> Column:
    """Is a content still to be fetched or parsed, or to be tried again?"""
    open_ = lambda c: F.coalesce(c.isin("pending", "failed"), F.lit(False))
    return ~F.coalesce(has_document, F.lit(False)) | open_(fetch) | open_(parse)


def keeps_waiting(fetch: Column, parse: Column) -> Column:
    """Is somebody at work on a content?"""
    busy = lambda c: F.coalesce(c.isin("pending", "in_progress"), F.lit(False))
    return busy(fetch) | busy(parse)


def retry_count(value: Column) -> Column:
    """A count of retries from a number: whole, none for what is missing, not finite or not above zero."""
    fine = value.isNotNull() & ~F.isnan(value) & (value > 0) & (value < float("inf"))
    return F.when(fine, F.floor(value)).otherwise(0).cast("int")


def is_fully_curated(curated_at: Column, curated_by: Column) -> Column:
    """Both marks of a curation are there."""
    return curated_at.isNotNull() & curated_by.isNotNull()


def changed(old: Column, new: Column) -> Column:
    """Do two values differ, null being a value like any other?"""
    return ~old.eqNullSafe(new)
