"""Catalogue synchronisation with a provider (E16-E18, J4, Q12) and dataset counts.

A sync row: ``product_id, server, desired`` (a struct), ``version, synced_version, state,
remote_id, error_code, attempt_count, next_attempt_at``; key ``(product_id, server)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import changed, keyed_diff

KEY = ["product_id", "server"]


def reconcile_catalog(products: DataFrame, sync: DataFrame, server: str, now) -> DataFrame:
    """The next snapshot of ``sync`` for ``server`` after looking at ``products``
    (``product_id, desired`` with an ``archived`` field): missing rows are inserted; a
    changed document raises the version, clears attempts and queues the row (one that is
    being created and has no remote id stays ``creating``); a row whose product is gone
    is archived once."""
    p = products.select("product_id", F.col("desired").alias("wanted"), F.lit(server).alias("server"))
    x = sync.where(F.col("server") == server).join(p, KEY, "full")
    gone = F.col("wanted").isNull() & ~F.col("desired.archived")
    fresh = F.col("version").isNull()
    target = F.when(gone, F.col("desired").withField("archived", F.lit(True))).otherwise(F.coalesce("wanted", "desired"))
    moved = ~fresh & changed("desired", target)
    state = (F.when(fresh, "queued").when(moved, F.when((F.col("state") == "creating") & F.col("remote_id").isNull(), "creating")
                                          .otherwise("queued")).otherwise(F.col("state")))
    at = F.lit(now).cast("timestamp_ntz")
    anew = fresh | moved
    return x.select(
        *KEY, target.alias("desired"), F.when(fresh, 1).otherwise(F.col("version") + moved.cast("int")).cast("int").alias("version"),
        F.coalesce("synced_version", F.lit(0)).alias("synced_version"), state.alias("state"), "remote_id",
        F.when(~anew, F.col("error_code")).alias("error_code"), F.when(anew, 0).otherwise(F.col("attempt_count")).alias("attempt_count"),
        F.when(anew, at).otherwise(F.col("next_attempt_at")).alias("next_attempt_at"))


def sync_results(sync: DataFrame, results: DataFrame, now) -> DataFrame:
    """``sync`` after job results (``product_id, server, job_version, ok, remote_id,
    uncertain, error_code, retry_at``).  Success stores the remote id and the job's version
    and is ``synced`` only if that is still the current one, else ``queued``; an uncertain
    failure is ``creating``; another is ``error`` for the current version, else ``queued``;
    a stale job is tried again now, and its error code isn't kept."""
    r = results.select(*KEY, "job_version", "ok", F.col("remote_id").alias("new_id"), "uncertain",
                       F.col("error_code").alias("new_code"), "retry_at")
    x = sync.join(r, KEY, "left")
    none = F.col("ok").isNull()
    current = F.col("job_version") == F.col("version")
    at = F.lit(now).cast("timestamp_ntz")
    return x.select(
        *KEY, "version",
        F.when(F.col("ok"), F.col("job_version")).otherwise(F.col("synced_version")).alias("synced_version"),
        F.when(none, F.col("state")).when(F.col("ok"), F.when(current, "synced").otherwise("queued"))
        .when(F.col("uncertain"), "creating").when(current, "error").otherwise("queued").alias("state"),
        F.when(F.col("ok"), F.col("new_id")).otherwise(F.col("remote_id")).alias("remote_id"),
        F.when(none, F.col("error_code")).when(~F.col("ok") & current, F.col("new_code")).alias("error_code"),
        F.when(none, F.col("next_attempt_at")).when(F.col("ok") & current, F.lit(None)).when(current, F.col("retry_at"))
        .otherwise(at).alias("next_attempt_at"))


def restart_stopped(sync: DataFrame, server: str, now, product_id=None) -> DataFrame:
    """Rows of ``server`` (or one product's) that are not synced and have no next
    attempt start again: no attempts, due now, ``creating`` without a remote id while
    creating, else ``queued``."""
    stopped = (F.col("server") == server) & (F.col("state") != "synced") & F.col("next_attempt_at").isNull()
    if product_id is not None:
        stopped = stopped & (F.col("product_id") == product_id)
    return sync.select(
        *KEY, F.when(stopped, F.when(F.col("state") == "creating", "creating").otherwise("queued")).otherwise(F.col("state")).alias("state"),
        F.when(stopped, 0).otherwise(F.col("attempt_count")).alias("attempt_count"),
        F.when(stopped, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("next_attempt_at")).alias("next_attempt_at"))


def billing_readiness(products: DataFrame, sync: DataFrame, server: str) -> DataFrame:
    """Q12 over J4 (left join on product and server): ``ready``, ``failed`` or ``pending``."""
    s = sync.where(F.col("server") == server).select("product_id", "state", "version", "synced_version", "remote_id", "next_attempt_at")
    x = products.select("product_id").join(s, "product_id", "left")
    ready = (F.col("state") == "synced") & (F.col("version") == F.col("synced_version")) & F.col("remote_id").isNotNull()
    failed = (F.col("state") == "error") | (F.col("state").isNotNull() & F.col("next_attempt_at").isNull())
    return x.select("product_id", F.when(ready, "ready").when(failed, "failed").otherwise("pending").alias("readiness"))


def sync_dataset(remote: DataFrame, local: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """How many rows to create, update and delete, and how many ids ``remote`` holds
    twice (an error).  One row."""
    per_key = remote.groupBy(key).agg(*[F.first(c).alias(c) for c in cols], F.count("*").alias("n"))
    doubled = per_key.agg(F.count_if(F.col("n") > 1)).scalar()
    return keyed_diff(per_key, local, key, cols).agg(
        *[F.count_if(F.col("action") == a).alias(n) for a, n in (("create", "created"), ("update", "updated"), ("delete", "deleted"))],
        F.lit(0).alias("zero")).select("created", "updated", "deleted", doubled.alias("duplicate_ids"))
