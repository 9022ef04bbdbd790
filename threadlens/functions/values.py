"""Small scalar rules: sizes, days, cost, expiry."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values -----------------------------------------------------------
PRICE_IN_PER_MTOK = 1.0
PRICE_OUT_PER_MTOK = 5.0
BATCH_DISCOUNT = 0.5
RECORD_TTL_DAYS = 29
SIZE_LABEL_KB = {"small": 10, "medium": 100, "large": 500, "xlarge": 1000, "huge": 5000}
# ------------------------------------------------------------------------


def positive_int(col: Column) -> Column:
    """A positive whole number, else null."""
    number = F.trim(col.cast("string")).try_cast("bigint")
    return F.when(number > 0, number)


def size_label_kb(col: Column) -> Column:
    """Named size to KB; unknown names mean no filter."""
    out = F.lit(None).cast("bigint")
    for label, kb in SIZE_LABEL_KB.items():
        out = F.when(col == label, F.lit(kb).cast("bigint")).otherwise(out)
    return out


def message_day(col: Column) -> Column:
    return F.substring(F.coalesce(col, F.lit("")), 1, 10)


def month_start(ts: Column) -> Column:
    return F.date_format(F.date_trunc("month", ts), "yyyy-MM-dd")


def cost(requests: Column, batched: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Dollars; the batch discount follows the share of requests."""
    share = F.when(requests > 0, batched / requests).otherwise(F.lit(0.0))
    dollars = tokens_in / 1e6 * PRICE_IN_PER_MTOK + tokens_out / 1e6 * PRICE_OUT_PER_MTOK
    return dollars * (1 - F.lit(BATCH_DISCOUNT) * share)


def expired(submitted: Column, now: Column, days: int = RECORD_TTL_DAYS) -> Column:
    """Whole days since an ISO stamp exceed ``days``; bad stamps never expire."""
    when = F.try_to_timestamp(submitted)
    whole = F.floor((F.unix_micros(now) - F.unix_micros(when)) / F.lit(86_400_000_000))
    return F.coalesce(whole > days, F.lit(False))
