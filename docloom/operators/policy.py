"""Access decisions and the governance state machine, as total expressions: what matches no rule is denied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Roles, purposes and the types that the allow rule covers (fixed values).
ROLES = ("clinician", "biller", "operations", "researcher")
PURPOSES = ("TREAT", "HPAYMT", "HOPERAT", "HRESCH", "ETREAT")
CLINICAL_TYPES = ("Patient", "Encounter", "Condition", "Observation", "MedicationRequest", "AllergyIntolerance", "Procedure", "DocumentReference")
#: Legal transitions (fixed values): (state, action) -> state.
TRANSITIONS = {("proposed", "approve"): "approved", ("proposed", "reject"): "rejected", ("approved", "commit"): "committed"}


def matched_rule(role: Column, purpose: Column, subject: Column, request: Column, resource: Column, kind: Column) -> Column:
    allow = (role == "clinician") & (purpose == "TREAT") & (subject == request) & (resource == request) & kind.isin(*CLINICAL_TYPES)
    return F.when(F.coalesce(allow, F.lit(False)), F.lit("v0-clinician-treat"))


def decision(rule: Column) -> Column:
    return F.when(rule.isNotNull(), "allow").otherwise("deny")


def scope(role: Column, purpose: Column, same_tenant: Column) -> Column:
    """The searchable types that the decision allows, as an array."""
    fits = F.coalesce((role == "clinician") & (purpose == "TREAT") & same_tenant, F.lit(False))
    return F.when(fits, F.array(*[F.lit(t) for t in CLINICAL_TYPES])).otherwise(F.array().cast("array<string>"))


#: Ids of the rules that allow a governance action (fixed values).
GOVERNANCE_RULES = {
    "propose": "bf09-propose-any-role",
    "approve": "bf09-approve-clinician",
    "commit": "bf09-commit-clinician",
    "reject": "bf09-reject-clinician",
}


def governance_rule(action: Column, role: Column, actor: Column, bound: Column, rules: dict[str, str] = GOVERNANCE_RULES) -> Column:
    """The id of the rule that allows the action to an actor bound to the session; null where none does."""
    same = F.coalesce(actor == bound, F.lit(False))
    out = F.when(same & (action == "propose"), rules["propose"])
    for name in ("approve", "commit", "reject"):
        out = out.when(same & (action == name) & (role == "clinician"), rules[name])
    return out


def excluded_types(types: Column, allowed: Column, reason: str = "no-rule-allows") -> Column:
    """The asked types outside the allowed ones, each with its reason."""
    return F.transform(F.array_sort(F.array_except(types, allowed)), lambda t: F.struct(t.alias("resource_type"), F.lit(reason).alias("reason")))


def receipt(decision: Column, actor: Column, tenant: Column, purpose: Column, reason: Column, occurred_at: Column, rule: Column | None = None, resource_type: Column | None = None) -> Column:
    """One audit receipt as a struct of the audit log's fields; search, walk and context receipts differ in their reason."""
    none = F.lit(None).cast("string")
    return F.struct(
        actor.alias("actor_id"), decision.alias("decision"), (rule if rule is not None else none).alias("matched_rule_id"), occurred_at.alias("occurred_at"),
        tenant.alias("practice_id"), purpose.alias("purpose_of_use"), reason.alias("reason"), (resource_type if resource_type is not None else none).alias("resource_type"),
    )


def next_state(state: Column, action: Column) -> Column:
    out: Column | None = None
    for (before, step), after in TRANSITIONS.items():
        hit = (state == before) & (action == step)
        out = F.when(hit, after) if out is None else out.when(hit, after)
    return out


def proposal_states(proposals: DataFrame, events: DataFrame, key: str = "proposal_id") -> DataFrame:
    """key, state of each proposal: committed, approved or proposed by its events (action). A commit without an approve
    means a corrupt log and fails the query."""
    seen = events.groupBy(key).agg(F.max(F.col("action") == "commit").alias("__c"), F.max(F.col("action") == "approve").alias("__a"))
    corrupt = F.raise_error(F.lit("GOVERNANCE_LOG_CORRUPT: commit without approve")).cast("string")
    state = F.when(F.col("__c") & ~F.col("__a"), corrupt).when(F.col("__c"), "committed").when(F.col("__a"), "approved").otherwise("proposed")
    return proposals.select(key).distinct().join(seen, key, "left").select(key, state.alias("state"))


def governed(events: DataFrame, key: str = "proposal_id") -> DataFrame:
    """events (key, event_no, action, role, actor, bound) with before, outcome (done, DENIED or ILLEGAL_TRANSITION), after.

    Each proposal's actions are taken in order of event_no; a refused one changes nothing. A proposal has a handful of
    events, which are folded inside one array."""
    rule = governance_rule(F.col("action"), F.col("role"), F.col("actor"), F.col("bound"))
    packed = events.withColumn("__ok", rule.isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("event_no", "action", F.col("__ok").alias("ok")))).alias("log"))
    kind = "array<struct<event_no:bigint,action:string,before:string,outcome:string,after:string>>"

    def step(done: Column, event: Column) -> Column:
        state = F.coalesce(F.try_element_at(done, F.lit(-1))["after"], F.lit("proposed"))
        following = F.when(event["action"] == "propose", state).otherwise(next_state(state, event["action"]))
        outcome = F.when(~event["ok"], "DENIED").when(following.isNull(), "ILLEGAL_TRANSITION").otherwise("done")
        after = F.when(event["ok"], F.coalesce(following, state)).otherwise(state)
        row = F.struct(event["event_no"].cast("bigint").alias("event_no"), event["action"].alias("action"), state.alias("before"), outcome.alias("outcome"), after.alias("after"))
        return F.concat(done, F.array(row)).cast(kind)

    folded = packed.select(key, F.explode(F.aggregate("log", F.array().cast(kind), step)).alias("e"))
    return folded.select(key, "e.*")
