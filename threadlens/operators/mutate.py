"""Table changes as pure (current, incoming) -> new functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from threadlens.operators.tagging import last_rows
from threadlens.schemas import KEY

# The columns a conflict overwrites -------------------------
SYNC_UPDATES = [
    "n_messages", "day_min", "day_max", "date_last", "has_attachments", "max_attachment_size",
    "attachments_incomplete", "web_link", "last_synced", "body_char_count", "body_scan_status",
    "tags_truncated",
]
IMPORT_UPDATES = [
    *SYNC_UPDATES, "subject", "date_first", "user_tags", "manually_reviewed",
]
COOLDOWN_STATUS = "denied"
# ------------------------------------------------------------------------
#: The placeholder tenant of this library.
ADOPTED_TENANT = "__unclaimed__"


def merge(
    current: DataFrame, incoming: DataFrame, keys: list[str], updates: list[str],
    keep_if_empty: tuple[str, ...] = (), order: str | None = None,
) -> DataFrame:
    """Insert new keys; on conflict overwrite ``updates``.

    A key comes once in ``incoming``, or its last row by ``order`` counts.

    ``keep_if_empty`` names lists that only a non-empty incoming list replaces.
    Columns the incoming side lacks keep their old value, null for new rows.
    """
    if order is not None:
        incoming = last_rows(incoming, keys, order)
    new = incoming.select(
        *keys, *[F.col(c).alias(f"_new_{c}") for c in incoming.columns if c not in keys],
        F.lit(True).alias("_new"),
    )
    old = current.withColumn("_old", F.lit(True))
    out = []
    for c in current.columns:
        if c in keys or c not in incoming.columns:
            out.append(F.col(c))
        elif c in keep_if_empty:
            take = F.col("_old").isNull() | (F.col("_new") & (F.size(f"_new_{c}") > 0))
            out.append(F.when(take, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        elif c in updates:
            out.append(F.when(F.col("_new"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(F.col("_old").isNull(), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
    return old.join(new, keys, "full_outer").select(*out)


def upsert_threads(current: DataFrame, incoming: DataFrame, refresh_headers: bool = False) -> DataFrame:
    """Store synced threads; tags survive an incoming empty list."""
    updates = SYNC_UPDATES + (["subject", "date_first"] if refresh_headers else [])
    return merge(current, incoming, KEY, updates, ("ai_tags",))


def store_untagged(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Store threads before tagging: no tags yet, no extracted text."""
    bare = incoming.drop("body_text", "ai_tags", "tags_truncated").withColumns({
        "ai_tags": F.array().cast("array<string>"), "tags_truncated": F.lit(False),
    })
    return upsert_threads(current, bare)


def collapse_import(rows: DataFrame, order: str = "row_no") -> DataFrame:
    """One row per thread of an import file: the last one, with the last
    non-empty tag list."""
    rest = [c for c in rows.columns if c not in (*KEY, order)]
    filled = F.when(F.size("ai_tags") > 0, F.col(order))
    return (
        rows.groupBy(*KEY)
        .agg(
            F.max_by(F.struct(*rest), order).alias("last"),
            F.max_by("ai_tags", filled).alias("tags"),
        )
        .select(*KEY, "last.*", "tags")
        .withColumn("ai_tags", F.coalesce("tags", "ai_tags"))
        .drop("tags")
    )


def import_merge(current: DataFrame, incoming: DataFrame, replace: str | None = None) -> DataFrame:
    """Load exported threads; ``replace`` names a tenant whose own rows go first, even for an empty file."""
    if replace is not None:
        current = current.filter(F.col("user_id") != replace)
    return merge(current, incoming, KEY, IMPORT_UPDATES, ("ai_tags",))


def import_file(current: DataFrame, exported: DataFrame, replace: str | None = None) -> DataFrame:
    """Rows of an export file as read, with repeated threads folded, merged into the table."""
    return import_merge(current, collapse_import(exported), replace)


def delete(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose thread is not in ``keys``; fits every child table too."""
    return table.join(keys.select(*KEY).distinct(), KEY, "left_anti")


def wipe(table: DataFrame, users: DataFrame) -> DataFrame:
    return table.join(users.select("user_id").distinct(), "user_id", "left_anti")


def upsert_users(users: DataFrame, logins: DataFrame, order: str = "seq") -> DataFrame:
    """Latest e-mail, name and last_seen; first_seen is kept."""
    latest = logins.groupBy("user_id").agg(
        F.max_by("email", order).alias("email"),
        F.max_by("display_name", order).alias("display_name"),
        F.min_by("now", order).alias("first_seen"), F.max_by("now", order).alias("last_seen"),
    )
    return merge(users, latest, ["user_id"], ["email", "display_name", "last_seen"])


def users_by_email(users: DataFrame, emails: DataFrame) -> DataFrame:
    wanted = emails.select(F.lower("email").alias("_e")).distinct()
    return users.join(wanted, F.lower(users["email"]) == F.col("_e"), "left_semi")


# Tenants --------------------------------------------------------------------

def adopt_untenanted(old: DataFrame, current: DataFrame, tenant: str = ADOPTED_TENANT) -> DataFrame:
    """Rows from before tenants existed, under the placeholder tenant."""
    return current.unionByName(old.withColumn("user_id", F.lit(tenant)), allowMissingColumns=True)


def claim_collisions(threads: DataFrame, src: str, dst: str) -> DataFrame:
    """Thread ids both tenants hold."""
    mine = threads.filter(F.col("user_id") == dst).select("thread_id")
    return threads.filter(F.col("user_id") == src).select("thread_id").join(
        mine, "thread_id", "left_semi"
    )


def claim(threads: DataFrame, src: str, dst: str, drop_duplicates: bool = False) -> DataFrame:
    """Re-key the threads of ``src`` to ``dst``; the latter's own copies stay.

    Adds ``claimed`` (moved / duplicate / null). Duplicates stay with ``src``
    unless dropped.
    """
    from_src = F.coalesce(F.col("user_id") == src, F.lit(False))
    held = threads.filter(F.col("user_id") == dst).select("thread_id", F.lit(True).alias("_held"))
    # Only the two tenants are joined; all other rows pass as they are.
    own = threads.filter(from_src).join(held, "thread_id", "left").withColumn(
        "claimed", F.when(F.col("_held").isNull(), "moved").otherwise("duplicate")
    )
    if drop_duplicates:
        own = own.filter(F.col("claimed") != "duplicate")
    own = own.withColumn(
        "user_id", F.when(F.col("claimed") == "moved", dst).otherwise(F.col("user_id"))
    ).select(*threads.columns, "claimed")
    return threads.filter(~from_src).withColumn("claimed", F.lit(None).cast("string")).unionByName(own)


def claim_counts(threads: DataFrame, src: str, dst: str) -> DataFrame:
    return claim(threads, src, dst).agg(
        F.count_if(F.col("claimed") == "moved").alias("moved"),
        F.count_if(F.col("claimed") == "duplicate").alias("duplicates"),
    )


def tenant_summary(threads: DataFrame, tenant: str) -> tuple[DataFrame, DataFrame]:
    """(count, oldest, newest) of a tenant, and its eight oldest threads."""
    own = threads.filter(F.col("user_id") == tenant)
    summary = own.agg(
        F.count("*").alias("threads"), F.min("date_first").alias("oldest"),
        F.max("date_last").alias("newest"),
    )
    oldest = own.select("thread_id", "subject", "date_first").orderBy("date_first", "thread_id")
    return summary, oldest.limit(8)


# Access ----------------------------------------------------------------------

def access_requests(current: DataFrame, attempts: DataFrame, order: str = "seq") -> DataFrame:
    """Record sign-in attempts: new users are pending, decisions are kept."""
    names = [c for c in ("email", "display_name") if c in attempts.columns]
    latest = attempts.groupBy("user_id").agg(
        *[F.max_by(c, order).alias(c) for c in names], F.max_by("now", order).alias("requested_at"),
        F.lit("pending").alias("status"),
    )
    return merge(current, latest, ["user_id"], [*names, "requested_at"])


def decide(requests: DataFrame, decisions: DataFrame, cooldown_minutes: int = 60) -> DataFrame:
    """Apply ``decisions(user_id, decision, decided)``: approve, deny, revoke.

    Of several decisions about a user the last by ``decided`` counts.
    Only a denial sets ``denied_until``; a revocation can be asked again at once.
    """
    latest = decisions.groupBy("user_id").agg(F.max(F.struct("decided", "decision")).alias("d"))
    given = latest.select("user_id", "d.decision", F.col("d.decided").alias("_at"))
    status = F.when(F.col("decision") == "approve", "approved").otherwise("denied")
    until = F.when(
        F.col("decision") == "deny",
        F.date_format(
            F.try_to_timestamp("_at") + F.make_dt_interval(mins=F.lit(cooldown_minutes)),
            "yyyy-MM-dd HH:mm:ss",
        ),
    )
    hit = F.col("decision").isNotNull()
    return requests.join(given, "user_id", "left").withColumns({
        "status": F.when(hit, status).otherwise(F.col("status")),
        "decided_at": F.when(hit, F.col("_at")).otherwise(F.col("decided_at")),
        "denied_until": F.when(hit, until).otherwise(F.col("denied_until")),
    }).drop("decision", "_at")


def access_state(requests: DataFrame, now: str) -> DataFrame:
    """What a sign-in at ``now`` meets: approved, pending, cooldown or reopened."""
    waiting = F.coalesce(F.col("denied_until") > now, F.lit(False))
    state = (
        F.when(F.col("status") == "approved", "approved")
        .when((F.col("status") == COOLDOWN_STATUS) & waiting, "cooldown")
        .when(F.col("status") == COOLDOWN_STATUS, "reopened")
        .otherwise("pending")
    )
    return requests.withColumn("state", state)


def reopen(requests: DataFrame, now: str) -> DataFrame:
    """Denied requests past their cooldown become pending again."""
    again = F.col("state") == "reopened"
    return access_state(requests, now).withColumns({
        "status": F.when(again, "pending").otherwise(F.col("status")),
        "requested_at": F.when(again, F.lit(now)).otherwise(F.col("requested_at")),
        "decided_at": F.when(again, F.lit(now)).otherwise(F.col("decided_at")),
        "denied_until": F.when(again, F.lit(None).cast("string")).otherwise(F.col("denied_until")),
    })


def mark_notified(requests: DataFrame, notices: DataFrame) -> DataFrame:
    """Stamp ``notified_at`` from ``notices(user_id, now)``."""
    given = notices.groupBy("user_id").agg(F.max("now").alias("_at"))
    return requests.join(given, "user_id", "left").withColumn(
        "notified_at", F.coalesce("_at", "notified_at")
    ).drop("_at")


def access_queue(requests: DataFrame, status: str | None = None) -> DataFrame:
    """Pending first, then denied, then the rest; newest first in each."""
    rows = requests if status is None else requests.filter(F.col("status") == status)
    rank = F.when(F.col("status") == "pending", 0).when(F.col("status") == "denied", 1).otherwise(2)
    return rows.orderBy(rank, F.col("requested_at").desc(), "user_id")
