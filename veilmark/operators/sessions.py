"""Salts that belong to a session and change in time.

With a salt of its own per session, a value has another token in each session, so tokens
cannot be linked across them; a rotated salt breaks the link in time too.  Which salt holds
for a request follows from its time, not from when a job runs, so a replay gives the same
tokens.  Restoration looks tokens up in the session they came from, whatever salt made them.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.functions.exprs import inline_rows
from veilmark.functions.fixed import DEFAULT_TTL_SECONDS
from veilmark.functions.tokens import SaltColumn
from veilmark.operators.detect import BatchDetector, detect
from veilmark.operators.redact import apply_fail_policy, redact_findings
from veilmark.operators.rehydrate import rehydrate, scoped
from veilmark.operators.vault import vault_put
from veilmark.options import Options

NO_SALT = "no salt holds for this session and time"


def salt_intervals(salts: DataFrame) -> DataFrame:
    """(session_id, salt_version, salt, valid_from, valid_to): each salt until the next one.

    ``salts`` has (session_id, salt_version, salt, valid_from).  Of salts that begin at the same
    moment the highest version holds; the last one has no end.
    """
    order = Window.partitionBy("session_id").orderBy("valid_from", "salt_version")
    return salts.select(
        "session_id",
        "salt_version",
        "salt",
        "valid_from",
        F.lead("valid_from").over(order).alias("valid_to"),
    )


def with_salts(requests: DataFrame, salts: DataFrame) -> DataFrame:
    """Requests (session_id, ts, ...) with the ``salt`` and ``salt_version`` that hold at ``ts``.

    An as-of join as an equi-join: a salt stands once for each day of its interval on which
    there can be a request, and a request meets only its session's salts of its day.  So a
    session with very many requests is spread by days, and one with very many salts is
    not compared with all of them.  Requests before their session's first salt, or without a
    session or time, have null for both.
    """
    day = F.to_date("ts")
    first, last = requests.agg(F.min(day), F.max(day)).first()
    spans = salt_intervals(salts)
    if first is None:
        first = last = "1970-01-01"
    begin = F.greatest(F.to_date("valid_from"), F.lit(first).cast("date"))
    end = F.least(F.coalesce(F.to_date("valid_to"), F.lit(last).cast("date")), F.lit(last).cast("date"))
    daily = (
        spans.where((begin <= end) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from"))))
        .withColumn("_day", F.explode(F.sequence(begin, end)))
        .withColumnRenamed("session_id", "_session")
    )
    same = (F.col("session_id") == F.col("_session")) & (F.to_date("ts") == F.col("_day"))
    inside = (F.col("ts") >= F.col("valid_from")) & (
        F.col("valid_to").isNull() | (F.col("ts") < F.col("valid_to"))
    )
    return requests.join(daily, same & inside, "left").drop(
        "_session", "_day", "valid_from", "valid_to"
    )


def redact_sessions(
    requests: DataFrame,
    salts: DataFrame,
    options: Options,
    text: str = "text",
    detector: BatchDetector | None = None,
) -> DataFrame:
    """``redact`` with the salt of each request's session and time.

    ``options.salt`` is not used.  Adds ``salt_version`` beside what ``redact`` adds; the salt
    itself is not in the result.  A request in which something is found but for which no salt
    holds counts as a detection that failed.
    """
    found = detect(with_salts(requests, salts), options, text, detector)
    bare = F.col("salt").isNull() & (F.size("findings") > 0)
    found = found.withColumn("detect_error", F.coalesce("detect_error", F.when(bare, NO_SALT)))
    done = redact_findings(found, SaltColumn("coalesce(salt, '')"), text)
    return apply_fail_policy(done.drop("findings", "salt"), options, text)


def session_vault(
    redacted: DataFrame,
    ttl_seconds: int = DEFAULT_TTL_SECONDS,
    written_at: datetime | str | Column | None = None,
) -> DataFrame:
    """Vault rows of redacted requests; their tokens are named by session.

    Vault reading, writing, expiry and purging work on them as on any others.  A session's
    tokens of several salt versions have different ids and stand side by side.
    """
    rows = inline_rows(redacted, ["session_id", "salt_version"], "mappings").distinct()
    named = rows.where("session_id is not null").withColumn("token", scoped("session_id", "token"))
    return vault_put(named, ttl_seconds, written_at)


def rehydrate_sessions(
    answers: DataFrame,
    vault: DataFrame,
    text: str = "text",
    now: datetime | str | Column | None = None,
) -> DataFrame:
    """Restore the tokens of answers (session_id, text, ...), each in its own session.

    A token of another session stays as it is, also where that session's vault rows live.
    """
    return rehydrate(answers, vault, None, text, now, scope="session_id")
