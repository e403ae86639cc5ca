"""Predicates, joins, aggregates, windows and pages over the engine's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Orders of risks and roles, node and edge types, categories, states.
RISKS = ["Low", "Medium", "High", "Critical"]
ROLE_RANKS = {"admin": 100, "manager": 50, "member": 10, "guest": 1}
NODE_TYPES = ["SOP", "Step", "Policy", "System", "Team", "Role", "Person", "Rule", "Entity"]
EDGE_TYPES = ["HAS_STEP", "REQUIRES_ROLE", "TARGETS_SYSTEM", "DEPENDS_ON", "SUPERSEDES", "GOVERNED_BY", "OWNS", "REQUIRES", "MODIFIES", "EXECUTES"]
CATEGORIES = ["Engineering", "Support", "Billing", "Operations", "Security"]
TRANSITIONS = {
    "IDLE": ["PLANNING", "FAILED"], "PLANNING": ["AUDITING", "FAILED"], "AUDITING": ["AWAITING_APPROVAL", "EXECUTING", "FAILED"],
    "AWAITING_APPROVAL": ["EXECUTING", "FAILED", "PAUSED"], "PAUSED": ["EXECUTING", "AWAITING_APPROVAL", "FAILED"],
    "EXECUTING": ["COMPLETED", "FAILED", "PAUSED"], "COMPLETED": ["IDLE"], "FAILED": ["IDLE", "PLANNING"],
}


def rank_of(c: Column, order: list[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, order)), c)


def tenant_scope(rows: DataFrame, column: str, tenant, shared: tuple = ()) -> DataFrame:
    """Rows of one tenant, and shared ones (null or named); without a tenant there are no rows."""
    if tenant is None:
        return rows.filter(F.lit(False))
    own = F.col(column) == tenant
    for s in shared:
        own = own | (F.col(column).isNull() if s is None else F.col(column) == s)
    return rows.filter(own)


def role_visible(roles: Column, role: str | None) -> Column:
    """Admins see all, others rows without a list and rows whose list has their role."""
    return F.lit(role == "admin") | roles.isNull() | F.coalesce(F.array_contains(roles, F.lit(role or "")), F.lit(False))


def allowed(column: Column, ids: list | None) -> Column:
    """No list is no restriction; an empty list admits nothing."""
    return F.lit(True) if ids is None else column.isin(ids) if ids else F.lit(False)


def predicate_set(rows: DataFrame, any_of: list[dict[str, tuple]]) -> DataFrame:
    """Rows that fit one of several sets of conditions, column to (operator, value), all of which must hold. A
    comparison with null is false; null and not_null ask for it."""
    ops = {
        "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "lt": lambda c, v: c < v, "le": lambda c, v: c <= v, "gt": lambda c, v: c > v, "ge": lambda c, v: c >= v,
        "in": lambda c, v: c.isin(list(v)), "like": lambda c, v: c.like(v), "ilike": lambda c, v: c.ilike(v), "null": lambda c, v: c.isNull(), "not_null": lambda c, v: c.isNotNull(),
        "between": lambda c, v: (c >= v[0]) & (c < v[1]), "multiple_of": lambda c, v: c % v == 0,
    }
    keep = F.lit(False)
    for group in any_of:
        own = F.lit(True)
        for column, (name, value) in group.items():
            own = own & F.coalesce(ops[name](F.col(column), value), F.lit(False))
        keep = keep | own
    return rows.filter(keep)


def listed(rows: DataFrame, fixed: dict, newest: str, key: str) -> DataFrame:
    """Rows with the given values, the largest of ``newest`` first."""
    return predicate_set(rows, [{c: ("eq", v) for c, v in fixed.items()}]).orderBy(F.desc(newest), key)


def keyword_search(rows: DataFrame, word: str, fields: list[str]) -> DataFrame:
    """Rows one of whose fields has the word, in any case."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.contains(F.lower(f), F.lit(word.lower())), F.lit(False))
    return rows.filter(hit)


def edge_valid_at(start: Column, end: Column, at: Column) -> Column:
    return (start.isNull() | (at >= start)) & (end.isNull() | (at <= end))


def stale_flags(rows: DataFrame, confirmed: str, at: Column, days: int = 30, flag: str = "is_stale") -> DataFrame:
    return rows.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)) | F.coalesce(F.col(confirmed) < at - F.expr(f"interval {days} days"), F.lit(False)))


def embedding_staleness(force: Column, vector: Column, dims: int, model: Column, version: Column, content: Column, hashed: Column, want_model: str, want_version: str) -> Column:
    """Why a chunk must be embedded again: the first reason that holds, else null."""
    differs = lambda a, b: ~a.eqNullSafe(b)
    return (
        F.when(force, "force").when(vector.isNull() | (F.size(vector) != dims), "missing_embedding").when(differs(model, F.lit(want_model)), "model_mismatch")
        .when(differs(version, F.lit(want_version)), "version_mismatch").when(differs(hashed, F.sha2(content, 256)), "content_hash_mismatch")
    )


def execution_gate(calls: DataFrame, approvals: DataFrame) -> DataFrame:
    """calls (sop_id, risk_level, human_gate, trust_role, approval_id) with gated and approval_status."""
    a = approvals.select(F.col("id").alias("approval_id"), F.col("sop_id").alias("a_sop"), F.col("status").alias("a_status"), F.col("consumed_at").alias("a_consumed"))
    high = F.col("risk_level").isin("High", "Critical") | F.coalesce("human_gate", F.lit(False))
    needs = high & (F.col("trust_role") == "low_trust")
    good = (F.col("a_sop") == F.col("sop_id")) & (F.col("a_status") == "approved") & F.col("a_consumed").isNull()
    gated = F.coalesce(needs, F.lit(False)) & ~F.coalesce(good, F.lit(False))
    status = F.when(F.col("a_status").isNull(), "unrequested").when(F.col("a_consumed").isNotNull(), "already_consumed").otherwise(F.col("a_status"))
    return calls.join(a, "approval_id", "left").withColumns({"gated": gated, "approval_status": F.when(gated, status)}).drop("a_sop", "a_status", "a_consumed")


def policy_audit(steps: DataFrame) -> DataFrame:
    """Per plan_id: flags, highest risk, whether a human must approve, and the reasons by step and rule (reasons). steps:
    plan_id, query, trust_role, step_number, action, target_system, parameters (JSON), risk_level, human_gate."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    action, target = low(F.col("action")), low(F.col("target_system"))
    any_of = lambda c, *words: F.regexp_like(c, F.lit("|".join(words)))
    # What a reason says.
    said = [
        F.lit("Policy Trigger: Financial refund action detected. Human manager approval required."),
        F.concat(F.lit('Policy Trigger: Direct database mutation action "'), text("action"), F.lit('" on '), text("target_system"), F.lit(". Human manager approval required.")),
        F.concat(F.lit('Policy Trigger: Security critical credential/permission modification "'), text("action"), F.lit('".')),
        F.concat(F.lit("Policy Trigger: Step "), text("step_number"), F.lit(' explicitly marked with risk level "'), F.coalesce(F.nullif("risk_level", F.lit("")), F.lit("High")), F.lit('".')),
    ]
    rules = [
        (any_of(F.concat(action, low(F.col("parameters")), low(F.col("query"))), "refund"), F.lit(3)),
        (any_of(target, "postgres", "database") & any_of(action, "delete", "drop", "mutate", "update"), F.lit(3)),
        (any_of(action, "secret", "credential", "revoke", "elevate"), F.lit(4)),
        (F.col("risk_level").isin("High", "Critical") | F.coalesce("human_gate", F.lit(False)), F.when(F.col("risk_level") == "Critical", 4).otherwise(3)),
    ]
    hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("rule"), r.alias("risk"), t.alias("text"))) for k, ((c, r), t) in enumerate(zip(rules, said, strict=True), 1)]))
    told = F.when(F.size("hits") > 0, F.struct("step_number", F.col("hits")["rule"].alias("rules"), F.col("hits")["text"].alias("texts")))
    judged = steps.withColumn("hits", hits).groupBy("plan_id").agg(
        F.sum(F.size("hits")).alias("flags"), F.max(F.greatest(F.lit(1), F.coalesce(F.array_max(F.transform("hits", lambda h: h["risk"])), F.lit(1)))).alias("rank"),
        F.bool_or(F.coalesce(F.col("trust_role") == "admin", F.lit(False))).alias("admin"), F.array_sort(F.collect_list(told)).alias("told"),  # one plan's steps
    )
    reasons = F.flatten(F.transform("told", lambda x: x["texts"])).alias("reasons")
    risk = F.element_at(F.array(*map(F.lit, RISKS)), F.col("rank").cast("int")).alias("risk_level")
    return judged.select("plan_id", "flags", risk, ((F.col("flags") > 0) & ~(F.col("admin") & (F.col("rank") < 4))).alias("requires_human_approval"), reasons)


def role_clearance(role: Column, required: Column, sensitivity: Column, clearance: Column) -> Column:
    rank = lambda c: F.coalesce(F.create_map(*[F.lit(x) for kv in ROLE_RANKS.items() for x in kv])[c], F.lit(0))
    return F.coalesce((rank(role) >= rank(required)) & ((rank(role) >= ROLE_RANKS["manager"]) | (sensitivity <= clearance)), F.lit(False))


def triple_validate(triples: DataFrame, named: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid with the predicate in upper case, rejected with reason). With ``named`` the ends are known not to be
    empty, and aren't looked at."""
    t = triples.withColumn("predicate", F.upper(F.trim("predicate")))
    empty = lambda c: F.lit(False) if named else F.coalesce(F.trim(c), F.lit("")) == ""
    reason = (
        F.when(empty("subject"), "empty_subject").when(empty("object"), "empty_object").when(~F.coalesce(F.col("subject_type").isin(NODE_TYPES), F.lit(False)), "bad_subject_type")
        .when(~F.coalesce(F.col("object_type").isin(NODE_TYPES), F.lit(False)), "bad_object_type").when(~F.coalesce(F.col("predicate").isin(EDGE_TYPES), F.lit(False)), "bad_predicate")
    )
    judged = t.withColumn("reason", reason)
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")


CLAIMS = "struct<claims:array<struct<claim_text:string,claim_type:string,confidence:double,char_start:int,char_end:int>>>"


def claim_validate(responses: DataFrame, response: str, content: str, most: int = 20) -> DataFrame:
    """Adds ``claims`` (null if any of them is bad) from a JSON response about a chunk's content."""
    from corpusspark.functions.text import strip_json_fence

    parsed = F.from_json(strip_json_fence(F.col(response)), CLAIMS)["claims"]
    good = lambda c: F.coalesce(
        F.length(c["claim_text"]).between(10, 2000) & F.length(F.coalesce(c["claim_type"], F.lit("operational"))).between(1, 50) & c["confidence"].between(0, 1)
        & (c["char_start"] >= 0) & (c["char_start"] < c["char_end"]) & (c["char_end"] <= F.length(content)), F.lit(False)
    )
    fixed = F.transform(parsed, lambda c: c.withField("claim_type", F.coalesce(c["claim_type"], F.lit("operational"))))
    return responses.withColumn("claims", F.when((F.size(parsed) <= most) & F.forall(parsed, good), fixed))


SOP = "struct<is_valid_sop:boolean,confidence:double,title:string,trigger_condition:string,category:string,risk_level:string,requires_human_gate:boolean>"


def sop_validate(responses: DataFrame, response: str, least: float = 0.4) -> DataFrame:
    """Adds the parsed procedure and ``accepted``; risk is Low and the gate follows from risk by default."""
    from corpusspark.functions.text import strip_json_fence

    p = responses.withColumn("p", F.from_json(strip_json_fence(F.col(response)), SOP))
    risk = F.coalesce("p.risk_level", F.lit("Low"))
    gate = F.coalesce("p.requires_human_gate", risk.isin("High", "Critical"))
    fits = F.coalesce(F.col("p.category").isin(CATEGORIES) & risk.isin(RISKS) & (F.col("p.title") != ""), F.lit(False))
    return p.select(*responses.columns, "p.title", "p.trigger_condition", "p.category", risk.alias("risk_level"), gate.alias("requires_human_gate"), (fits & F.coalesce(F.col("p.is_valid_sop") & (F.col("p.confidence") >= least), F.lit(False))).alias("accepted"))


# Openings of answers without claims.
FILLERS = ["sure, i can help", "here is the information", "ok", "understood", "processing your request"]


def grounding_score(total: Column, unsupported: Column) -> Column:
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (total - unsupported) / total))  # these two skip nulls
    return F.when(total <= 0, 1.0).when(total.isNotNull() & unsupported.isNotNull(), score)


def grounding_guard(answers: DataFrame, answer: str, score: str, unsupported: str, least: float = 0.95) -> DataFrame:
    """Adds grounded and the score it goes by: empty and short filler answers pass, others need the judge's score."""
    text = F.trim(F.coalesce(F.col(answer), F.lit("")))
    filler = F.regexp_like(F.lower(text), F.lit("^(" + "|".join(FILLERS) + ")")) & (F.length(text) < 60)
    free = (text == "") | filler
    return answers.withColumns({"grounded": free | F.coalesce((F.col(score) >= least) & (F.col(unsupported) == 0), F.lit(False)), "grounding_score": F.when(free, 1.0).otherwise(F.coalesce(score, F.lit(0.0)))})


def grounding_scores(judgements: DataFrame, judge: str, least: float = 0.95) -> DataFrame:
    """Adds score and passed from the judge's JSON (total_claims, unsupported_claims); unreadable JSON fails."""
    from corpusspark.functions.text import strip_json_fence

    j = F.from_json(strip_json_fence(F.col(judge)), "struct<total_claims:int,unsupported_claims:array<string>>")
    total, bad = j["total_claims"], F.coalesce(F.size(j["unsupported_claims"]), F.lit(0))
    score = F.coalesce(grounding_score(total, F.greatest(bad, F.lit(0))), F.lit(0.0))
    return judgements.withColumns({"score": score, "passed": F.coalesce((score >= least) & total.isNotNull() & (bad <= 0), F.lit(False))})


# ---- joins ----


def explicit_grants(rows: DataFrame, grants: DataFrame, row_id: str, user, roles: list[str], is_admin: bool = False, risk: str = "risk_level") -> DataFrame:
    """Rows that are open (risk Low) or granted to the user or to one of the roles; an admin sees all."""
    if is_admin:
        return rows
    own = grants.filter(((F.col("principal_type") == "user") & (F.col("principal_id") == str(user))) | ((F.col("principal_type") == "role") & F.col("principal_id").isin(roles)))
    return rows.filter(F.col(risk) == "Low").unionByName(rows.filter(F.coalesce(F.col(risk) != "Low", F.lit(True))).join(own.select(row_id), row_id, "left_semi"))


def accessible_docs(tuples: DataFrame, user: str) -> DataFrame:
    """doc_id of documents that a user has as viewer, reader or owner, from ``user#relation@document:id``."""
    parts = tuples.select(*[F.regexp_extract("tuple", r"^(.+)#(.+)@document:(.+)$", k).alias(n) for k, n in enumerate(("user", "relation", "doc_id"), 1)])
    return parts.filter((F.col("user") == user) & F.col("relation").isin("viewer", "read", "owner")).select("doc_id").distinct()


def sha_delta(tree: DataFrame, indexed: DataFrame, key: str = "path", sha: str = "sha") -> DataFrame:
    """key and change: added, removed, changed or unchanged."""
    t, i = tree.select(key, F.col(sha).alias("t"), F.lit(True).alias("in_t")), indexed.select(key, F.col(sha).alias("i"), F.lit(True).alias("in_i"))
    change = F.when(F.col("in_i").isNull(), "added").when(F.col("in_t").isNull(), "removed").when(F.col("t").eqNullSafe(F.col("i")), "unchanged").otherwise("changed")
    return t.join(i, key, "full").select(key, change.alias("change"))


def pending_approvals(approvals: DataFrame, owners: DataFrame, owner: str, at: str, key: str, status: str = "status", pending: str = "pending") -> DataFrame:
    """Approvals that wait, with their owner's columns, the newest first."""
    return approvals.filter(F.col(status) == pending).join(owners, owner).orderBy(F.desc(at), key)


def unseen_items(incoming: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose keys were not seen. A null key was never seen."""
    return incoming.join(seen.select(*keys).hint("merge"), keys, "left_anti")


def reconcile_deletions(indexed: DataFrame, tree: DataFrame, key: str = "path") -> DataFrame:
    """What is indexed but no longer in the source's tree."""
    return indexed.join(tree.select(key).hint("merge"), key, "left_anti")


def unchanged_skip(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming documents but for those that are stored, complete, with the same content hash."""
    return incoming.join(stored.filter("extraction_stage = 'completed'").select(*keys, "content_hash"), [*keys, "content_hash"], "left_anti")


def stale_events(events: DataFrame, leases: DataFrame, at: Column, minutes: int = 10) -> DataFrame:
    """event_id and outcome of events that are received or processing and old: requeued, or skipped under a live lease."""
    old = events.filter(F.col("status").isin("received", "processing") & (F.col("updated_at") < at - F.expr(f"interval {minutes} minutes")))
    live = leases.filter((F.col("status") == "pending") & (F.col("expires_at") > at)).select("key").distinct().withColumn("live", F.lit(True))
    held = F.coalesce((F.col("status") == "processing") & F.col("live"), F.lit(False))
    return old.join(live, "key", "left").select("event_id", F.when(held, "skipped").otherwise("requeued").alias("outcome"))


# ---- windows and pages ----


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_claims(claims: DataFrame, k: int = 20) -> DataFrame:
    return top_per_group(claims, ["doc_id"], [F.desc("confidence"), F.asc("claim_id")], max(1, min(50, k)))


def keyset_page(rows: DataFrame, key: str, cursor, limit: int = 100) -> DataFrame:
    """The next page in descending order of the key, with the cursor for the one after it (null on a short page)."""
    n = max(1, min(500, limit))
    page = rows.filter(F.col(key) < cursor) if cursor is not None else rows
    page = page.orderBy(F.desc(key)).limit(n)
    size, last = F.count(F.lit(1)).over(Window.partitionBy()), F.min(key).over(Window.partitionBy())
    return page.withColumn("next_cursor", F.when(size == n, last))


def single_use_approval(uses: DataFrame, approval: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy(approval).orderBy(*order)
    return uses.withColumn("outcome", F.when(F.row_number().over(w) == 1, "consumed").otherwise("rejected"))


def illegal_transitions(states: DataFrame, entity: str, order: list[str], status: str, legal: dict[str, list[str]] = TRANSITIONS) -> DataFrame:
    """Changes between consecutive states that the map doesn't allow."""
    table = F.create_map(*[y for k, v in legal.items() for y in (F.lit(k), F.array(*map(F.lit, v)))])
    before = F.lag(status).over(Window.partitionBy(entity).orderBy(*order))
    s = states.withColumn("from_status", before)
    fine = F.col("from_status").isNull() | (F.col("from_status") == F.col(status)) | F.coalesce(F.array_contains(table[F.col("from_status")], F.col(status)), F.lit(False))
    return s.filter(~fine).withColumnRenamed(status, "to_status")


def version_history(changes: DataFrame, entity: str, order: list[str], fields: list[str]) -> DataFrame:
    """A snapshot of the state before each change but the first, with its version number."""
    w = Window.partitionBy(entity).orderBy(*order)
    snap = F.to_json(F.struct(*fields))
    return changes.withColumns({"version_number": F.row_number().over(w) - 1, "snapshot": F.lag(snap).over(w)}).filter("version_number > 0")


def rank_fusion(dense: DataFrame, sparse: DataFrame, key: str = "id", k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of legs with (key, rank): score, and each leg's rank where it has one."""
    both = dense.select(key, F.col("rank").alias("dense_rank"), F.lit(None).cast("int").alias("sparse_rank")).unionByName(sparse.select(key, F.lit(None).cast("int").alias("dense_rank"), F.col("rank").alias("sparse_rank")))
    part = lambda c: F.coalesce(1 / (k + F.max(c)), F.lit(0.0))
    return both.groupBy(key).agg(F.max("dense_rank").alias("dense_rank"), F.max("sparse_rank").alias("sparse_rank"), (part("dense_rank") + part("sparse_rank")).alias("score"))


def rollup_sets(rows: DataFrame, by: list[str], sets: list[list[str]], **aggs: Column) -> DataFrame:
    """Grouping sets; ``breakdown`` names the set of a row by its columns."""
    out = None
    for s in sets:
        part = rows.groupBy(*s).agg(*[v.alias(k) for k, v in aggs.items()])
        part = part.select(F.lit("+".join(s)).alias("breakdown"), *[F.col(c).cast("string").alias(c) if c in s else F.lit(None).cast("string").alias(c) for c in by], *aggs)
        out = part if out is None else out.unionByName(part)
    return out


def confidence(n: Column) -> Column:
    return F.least(F.lit(0.95), F.lit(0.7) + 0.05 * (n - 1))


def sop_dashboard(sops: DataFrame, approvals: DataFrame, runs: DataFrame, threads: DataFrame, at: Column, days: int = 7) -> DataFrame:
    """workspace_id, breakdown, value, n of each workspace: procedures by status, category and risk (Low without one), all
    and stale ones, approvals that are pending, runs of the last days, and threads by source. sops: id, workspace_id,
    status, category, risk_level, is_stale; approvals: sop_id, status; runs: sop_id, created_at; threads: workspace_id,
    source. Approvals and runs are counted by procedure before they meet the procedures."""
    own = sops.withColumn("risk_level", F.coalesce("risk_level", F.lit("Low")))
    one = lambda df, name, value: df.groupBy("workspace_id").agg(value.alias("n")).select("workspace_id", F.lit(name).alias("breakdown"), F.lit(None).cast("string").alias("value"), "n")
    out = [own.groupBy("workspace_id", c).agg(F.count(F.lit(1)).alias("n")).select("workspace_id", F.lit(c).alias("breakdown"), F.col(c).alias("value"), "n") for c in ("status", "category", "risk_level")]
    out += [one(own, "total", F.count(F.lit(1))), one(own, "stale", F.count_if(F.coalesce("is_stale", F.lit(False))))]
    of = own.select(F.col("id").alias("sop_id"), "workspace_id").hint("merge")
    per = lambda df: df.groupBy("sop_id").agg(F.count(F.lit(1)).alias("k")).join(of, "sop_id")
    out.append(one(per(approvals.filter("status = 'pending'")), "pending_approvals", F.sum("k")))
    out.append(one(per(runs.filter(F.col("created_at") >= at - F.expr(f"interval {days} days"))), "recent_executions", F.sum("k")))
    out.append(threads.groupBy("workspace_id", "source").agg(F.count(F.lit(1)).alias("n")).select("workspace_id", F.lit("source").alias("breakdown"), F.col("source").alias("value"), "n"))
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


def period_cost(usage: DataFrame, at: str, cost: str, by: list[str], units: tuple[str, ...] = ("hour", "day", "month")) -> DataFrame:
    """unit, period (epoch seconds of its start), the columns of ``by`` and the cost, for each unit of time. Rows are
    counted by the shortest unit first; longer ones add these up."""
    out, level = None, usage
    for u in units:
        level = level.groupBy(F.date_trunc(u, at).alias(at), *by).agg(F.sum(cost).alias(cost))
        part = level.select(F.lit(u).alias("unit"), F.unix_timestamp(at).alias("period"), *by, cost)
        out = part if out is None else out.unionByName(part)
    return out


def quota_check(usage: DataFrame, quotas: DataFrame, key: str, amount: str) -> DataFrame:
    """key, usage, allowed, reason: under a quota (key, quota) that is above 0; no quota or 0 has no limit."""
    used = usage.groupBy(key).agg(F.sum(amount).alias("usage")).join(quotas.select(key, "quota").hint("merge"), key, "left")
    ok = F.coalesce(F.col("quota") <= 0, F.lit(True)) | (F.coalesce("usage", F.lit(0.0)) < F.col("quota"))
    return used.select(key, "usage", ok.alias("allowed"), F.when(~ok, "quota_exceeded").alias("reason"))


def metric_rollup(samples: DataFrame, labels: list[str], value: str) -> DataFrame:
    """metric (labels joined by colons), n, total, mean."""
    return samples.groupBy(F.concat_ws(":", *[F.col(c).cast("string") for c in labels]).alias("metric")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def sync_stats(items: DataFrame, phase: str, outcome: str, outcomes: tuple[str, ...] = ("indexed", "skipped", "failed")) -> DataFrame:
    """For each phase how many items had each outcome."""
    return items.groupBy(F.col(phase).alias("phase")).agg(*[F.count_if(F.col(outcome) == o).alias(o) for o in outcomes])


def distinct_values(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*columns).distinct()


def graph_page(nodes: DataFrame, edges: DataFrame, n_nodes: int = 50, n_edges: int = 100) -> DataFrame:
    """kind, id: the first nodes and the first edges (id) of a graph."""
    first = lambda df, kind, n: df.select(F.lit(kind).alias("kind"), "id").orderBy("id").limit(n)
    return first(nodes, "node", n_nodes).unionByName(first(edges, "edge", n_edges))


def distinct_tuples(edges: DataFrame, most: int = 25, source: str = "source_id", kind: str = "edge_type", target: str = "target_id") -> DataFrame:
    """tuple: the first of the different edges as texts."""
    text = F.concat_ws(" ", *[F.col(c).cast("string") for c in (source, kind, target)])
    return edges.select(text.alias("tuple")).distinct().orderBy("tuple").limit(most)


def sync_since(state: DataFrame, requests: DataFrame, at: Column, look_back: str = "24 hours") -> DataFrame:
    """workspace_id, repository, since, phase, completed_phases for each request (workspace_id, repository,
    incremental). ``since``: where the last run ended, else the look-back; null for a first sync. A run that
    was left in the middle (status running) goes on with its resume token, others begin anew. state:
    workspace_id, repository, kind, status, updated_at, phase, completed_phases."""
    keys = ["workspace_id", "repository", "kind"]
    asked = requests.withColumn("kind", F.when(F.col("incremental"), "incremental").otherwise("initial"))
    met = asked.join(state.select(*keys, "status", "updated_at", F.col("phase").alias("p"), F.col("completed_phases").alias("c")).hint("merge"), keys, "left")
    going = F.coalesce(F.col("status") == "running", F.lit(False))
    since = F.when(F.col("incremental"), F.coalesce("updated_at", at - F.expr(f"interval {look_back}")))
    done = F.coalesce(F.when(going, F.col("c")), F.array().cast("array<string>"))
    return met.select("workspace_id", "repository", since.alias("since"), F.when(going, F.col("p")).alias("phase"), done.alias("completed_phases"))


def sync_state(state: DataFrame, runs: DataFrame) -> DataFrame:
    """The state after runs (workspace_id, repository, kind, status, updated_at, phase, completed_phases): the last
    one of each key stands, and a completed one has no resume token."""
    keys = ["workspace_id", "repository", "kind"]
    rest = ["status", "updated_at", "phase", "completed_phases"]
    last = state.select(*keys, *rest).unionByName(runs.select(*keys, *rest)).groupBy(*keys).agg(F.max_by(F.struct(*rest), "updated_at").alias("r")).select(*keys, "r.*")
    over = F.col("status") == "completed"
    return last.withColumns({"phase": F.when(~over, F.col("phase")), "completed_phases": F.when(over, F.array().cast("array<string>")).otherwise(F.col("completed_phases"))})
