"""What happens to a finding: tokenize, mask, block or audit, by where the request came from.

Rules lie in a table: namespace, beginning of the route, entity type, action.  ``*`` stands for
any namespace or entity type, an empty beginning for any route.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.functions.exprs import FINDINGS, MAPPINGS, empty
from veilmark.functions.policy import ACTIONS, ANY, AUDITED, TOKENIZE, act_on
from veilmark.operators.detect import BatchDetector, detect
from veilmark.options import Options


def route_prefixes(route: str) -> str:
    """SQL text: the beginnings of a route, whole steps each, the empty one included."""
    steps = f"filter(split(coalesce({route}, ''), '/'), s -> s <> '')"
    return (
        f"transform(sequence(0, size({steps})), n -> "
        f"if(n = 0, '', concat('/', array_join(slice({steps}, 1, n), '/'))))"
    )


def resolve_policies(places: DataFrame, policies: DataFrame) -> DataFrame:
    """(namespace, route, actions): for each place a map from entity type to action.

    Of the rules that hold for a place and an entity type, one for its own namespace goes
    before one for any, then the longest beginning of its route, then the strictest action.
    The map keeps ``*`` apart: it counts only for types without a rule of their own.  A
    place's beginnings are rows, so finding the longest is an equi-join and a maximum;
    no rule is compared with places it does not hold for.  Places may repeat and hold nulls:
    a null namespace has the rules for any, a null route those of the empty beginning.  Rules
    with an unknown action or a null are an error.
    """
    known = F.array(*map(F.lit, ACTIONS))
    strict = F.array_position(known, F.col("action"))
    wrong = (strict <= 0) | F.greatest(
        *(F.col(c).isNull() for c in ("namespace", "route", "entity_type", "action"))
    )
    error = F.raise_error(F.lit("a policy has a null or an unknown action"))
    # on the join key, where no filter passes it by
    rules = policies.select(
        F.when(F.coalesce(wrong, F.lit(True)), error).otherwise(F.col("namespace")).alias("_namespace"),
        F.regexp_replace("route", "/+$", "").alias("_prefix"),
        "entity_type",
        strict.cast("int").alias("_strict"),
    )
    distinct = places.select("namespace", "route").distinct()
    spread = distinct.select(
        "namespace", "route", F.explode(F.expr(route_prefixes("route"))).alias("_prefix")
    ).select(
        "*",
        F.explode(F.array_distinct(F.array(F.coalesce("namespace", F.lit(ANY)), F.lit(ANY)))).alias("_namespace"),
    )
    own = (F.col("_namespace") != ANY).cast("int")
    best = F.max(F.struct(own, F.length("_prefix"), "_strict"))["_strict"]
    return (
        spread.join(rules, ["_namespace", "_prefix"])
        .groupBy("namespace", "route", "entity_type")
        .agg(F.element_at(known, best).alias("action"))
        .groupBy("namespace", "route")
        .agg(F.map_from_entries(F.collect_list(F.struct("entity_type", "action"))).alias("actions"))
    )


def redact_by_policy(
    requests: DataFrame,
    policies: DataFrame,
    options: Options,
    text: str = "text",
    default: str = TOKENIZE,
    detector: BatchDetector | None = None,
) -> DataFrame:
    """Requests (namespace, route, text, ...) after the action of each finding's rule.

    Adds ``mappings`` (of tokenized spans), ``audit`` (entity type, action, start, end of every
    chosen span, never a value), ``detect_error`` and ``status``: ``blocked`` (text null),
    ``redacted``, ``audited`` (findings, but the text stays), ``unchanged``, or
    ``passed_uninspected`` and ``rejected`` as in ``redact``.  A finding without a rule gets the
    ``default`` action.
    """
    if default not in ACTIONS:
        raise ValueError(f"unknown action {default!r}")
    known = resolve_policies(requests, policies).withColumnsRenamed(
        {"namespace": "_namespace", "route": "_route"}
    )
    here = F.col("namespace").eqNullSafe(F.col("_namespace")) & F.col("route").eqNullSafe(F.col("_route"))
    found = detect(requests.join(known, here, "left").drop("_namespace", "_route"), options, text, detector)
    acted = F.expr(act_on(text, f"coalesce(findings, {empty(FINDINGS)})", "actions", default, options.salt))
    done = found.withColumn("_done", F.when(F.col("detect_error").isNull(), acted))
    failed = F.col("detect_error").isNotNull() & F.col(text).isNotNull()
    closed = options.on_error == "closed"
    touched = F.exists("_done.audit", lambda a: a["action"].isin("tokenize", "mask"))
    return done.withColumns(
        {
            text: F.when(failed, F.lit(None) if closed else F.col(text)).otherwise(F.col("_done.text")),
            "mappings": F.coalesce("_done.mappings", F.expr(empty(MAPPINGS))),
            "audit": F.coalesce("_done.audit", F.expr(empty(AUDITED))),
            "status": F.when(failed, "rejected" if closed else "passed_uninspected")
            .when(F.col("_done.blocked"), "blocked")
            .when(touched, "redacted")
            .when(F.size("_done.audit") > 0, "audited")
            .otherwise("unchanged"),
        }
    ).drop("_done", "findings", "actions")
