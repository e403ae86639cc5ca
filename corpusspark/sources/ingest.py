"""Ingestion: provider payloads to threads and documents, ledgers, upserts, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusspark.functions.text import blank, dedupe_key, fallback_id

_S = T.StringType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def _strings(names: str) -> dict:
    return dict.fromkeys(names.split(), _S)


MESSAGES = T.ArrayType(_struct(user=_S, text=_S, timestamp=_S))
_NAME = _struct(login=_S, name=_S)
#: One schema for the payloads of all providers; what a payload lacks is null.
PAYLOAD = _struct(
    **_strings("workspace_id external_thread_id channel_or_project team group subject from body text type database_name runbook_name notes queries title category author description"),
    messages=T.ArrayType(_struct(**_strings("user text timestamp ts from body"))),
    issue=_struct(**_strings("number title body created_at"), user=_NAME), pull_request=_struct(**_strings("number title body created_at"), user=_NAME),
    comment=_struct(**_strings("body created_at"), user=_NAME), repository=_struct(full_name=_S), steps=T.ArrayType(_S),
    data=_struct(**_strings("id issueId teamId description body createdAt creatorId userId"), team=_struct(key=_S), creator=_NAME, user=_NAME),
    ticket=_struct(**_strings("id group_name subject description requester_name created_at"), comments=T.ArrayType(_struct(**_strings("author_name body created_at"), public=T.BooleanType()))),
    comments=T.ArrayType(_struct(**_strings("body text created_at createdAt userName"), user=_NAME)),
)
THREAD = ["workspace_id", "source", "external_thread_id", "channel_or_project", "messages"]


def _message(user: Column, text: Column, at: Column) -> Column:
    return F.struct(user.alias("user"), F.coalesce(text, F.lit("")).alias("text"), at.alias("timestamp"))


def normalize_threads(deliveries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deliveries (provider, received_at, payload JSON) as threads, and those that can't be read as (delivery, reason).

    A delivery with a workspace and a message list is an envelope that every provider may send; else the
    provider's own form is read: its body, its comment and its comments become messages, in this order."""
    # As a generator's output the parsed payload is worked out once, however often its fields are named below.
    p = deliveries.select("*", F.explode(F.array(F.from_json("payload", PAYLOAD))).alias("p"))
    f = lambda x: F.col(f"p.{x}")
    has = F.size("p.messages") > 0
    user_default = F.when(F.col("provider") == "zendesk", "Agent/Customer").when(F.col("provider") == "email", "Sender").otherwise("Unknown")
    envelope = F.transform(f("messages"), lambda m: _message(F.coalesce(blank(m["user"]), blank(m["from"]), user_default), F.coalesce(blank(m["text"]), m["body"]), F.coalesce(m["timestamp"], m["ts"])))
    issue = F.coalesce(f("issue"), f("pull_request"))
    who = lambda c, other: F.coalesce(blank(c["login"]), blank(c["name"]), F.lit(other))
    comments = F.coalesce(F.transform(f("comments"), lambda c: _message(F.coalesce(blank(c["user"]["login"]), blank(c["user"]["name"]), blank(c["userName"]), F.lit("commenter")), F.coalesce(blank(c["body"]), c["text"]), F.coalesce(c["created_at"], c["createdAt"]))), F.array().cast(MESSAGES))
    one = lambda when, m: F.when(when, F.array(m))
    parts = lambda *xs: F.concat(*[F.coalesce(x, F.array().cast(MESSAGES)) for x in xs])
    given = lambda c: F.coalesce(c != "", F.lit(False))
    github = parts(
        one(issue.isNotNull() & given(F.concat(F.coalesce(issue["title"], F.lit("")), F.coalesce(issue["body"], F.lit("")))), _message(who(issue["user"], "author"), F.concat(F.coalesce(issue["title"], F.lit("")), F.lit("\n"), F.coalesce(issue["body"], F.lit(""))), issue["created_at"])),
        one(given(f("comment.body")), _message(who(f("comment.user"), "commenter"), f("comment.body"), f("comment.created_at"))), comments,
    )
    data = f("data")
    linear = parts(
        one(given(data["description"]), _message(F.coalesce(blank(data["creator"]["name"]), blank(data["creatorId"]), F.lit("author")), data["description"], data["createdAt"])),
        one(given(data["body"]) & (f("type") == "Comment"), _message(F.coalesce(blank(data["user"]["name"]), blank(data["userId"]), F.lit("commenter")), data["body"], data["createdAt"])), comments,
    )
    t = f("ticket")
    zendesk = parts(
        one(given(t["description"]) | given(t["subject"]), _message(F.coalesce(blank(t["requester_name"]), F.lit("Customer")), F.concat(F.lit("Subject: "), F.coalesce(t["subject"], F.lit("")), F.lit("\n"), F.coalesce(t["description"], F.lit(""))), t["created_at"])),
        F.transform(t["comments"], lambda c: _message(F.coalesce(blank(c["author_name"]), F.when(c["public"], "Customer").otherwise("Support Agent")), c["body"], c["created_at"])),
    )
    at, empty = F.col("received_at").cast("string"), F.lit("")
    text = F.coalesce(blank(f("body")), blank(f("text")))
    email = parts(one(text.isNotNull(), _message(F.coalesce(blank(f("from")), F.lit("Sender")), F.concat(F.lit("Subject: "), F.coalesce(f("subject"), empty), F.lit("\n"), text), at)))
    database = parts(one(given(f("notes")) | given(f("queries")), _message(F.lit("Database Engineer"), F.concat(F.lit("Runbook: "), F.coalesce(blank(f("runbook_name")), F.lit("Operational Query Procedure")), F.lit("\nNotes: "), F.coalesce(f("notes"), empty), F.lit("\nQueries: "), F.coalesce(f("queries"), F.lit("[]"))), at)))
    steps = F.array_join(F.transform(F.coalesce(f("steps"), F.array().cast("array<string>")), lambda s, i: F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": "), s)), "\n")
    teach = parts(one(given(f("title")) & given(f("description")), _message(F.coalesce(blank(f("author")), F.lit("Senior Domain Expert")), F.concat(F.lit("EXPLICIT OPERATIONAL SOP DECREE: "), f("title"), F.lit("\nCategory: "), F.coalesce(blank(f("category")), F.lit("Operations")), F.lit("\nScenario: "), f("description"), F.lit("\n\nConfirmed Steps:\n"), steps), at)))
    own = {"slack": F.array().cast(MESSAGES), "github": github, "linear": linear, "zendesk": zendesk, "email": email, "database": database, "direct_teach": teach}
    prefix = {"github": "gh", "linear": "lin", "zendesk": "zen", "email": "email", "database": "db", "direct_teach": "teach"}
    channel = {
        "slack": [F.lit("general")], "github": [f("repository.full_name"), F.lit("unknown-repo")], "linear": [data["team"]["key"], data["teamId"], f("team"), F.lit("unknown-team")],
        "zendesk": [t["group_name"], f("group"), F.lit("support")], "email": [f("subject"), F.lit("inbox")], "database": [f("database_name"), F.lit("postgres")], "direct_teach": [f("category"), F.lit("Tacit Knowledge")],
    }
    own_id = {
        "github": F.when(issue.isNotNull(), F.concat(F.lit("gh-"), F.coalesce(f("repository.full_name"), F.lit("unknown-repo")), F.lit("-"), issue["number"])),
        "linear": F.when(data.isNotNull() & F.coalesce(data["id"], data["issueId"]).isNotNull(), F.concat(F.lit("lin-"), F.coalesce(data["id"], data["issueId"]))),
        "zendesk": F.when(t["id"].isNotNull(), F.concat(F.lit("zen-ticket-"), t["id"])),
    }
    pick = lambda values, other: F.coalesce(*[F.when(F.col("provider") == k, v) for k, v in values.items()], other)
    messages = F.when(has, envelope).otherwise(pick(own, F.array().cast(MESSAGES)))
    # Slack names its threads itself; the others fall back to a hash of what they sent.
    fallback = pick({k: fallback_id(v, F.col("payload")) for k, v in prefix.items()}, F.lit(None).cast("string"))
    thread_id = F.coalesce(blank(f("external_thread_id")), F.when(~F.coalesce(has, F.lit(False)), pick(own_id, F.lit(None).cast("string"))), fallback)
    out = p.select(
        *deliveries.columns, blank(f("workspace_id")).alias("workspace_id"), F.col("provider").alias("source"), thread_id.alias("external_thread_id"),
        F.coalesce(blank(f("channel_or_project")), pick({k: F.coalesce(*map(blank, v)) for k, v in channel.items()}, F.lit("unknown"))).alias("channel_or_project"), messages.alias("messages"),
    )
    reason = (
        F.when(~F.col("provider").isin(*own), "unknown_provider").when(F.col("workspace_id").isNull(), "no_workspace")
        .when(F.coalesce(F.size("messages"), F.lit(0)) < 1, "no_messages").when(F.col("external_thread_id").isNull(), "no_thread_id")
    )
    judged = out.withColumn("reason", reason)
    return judged.filter("reason is null").select(*THREAD), judged.filter("reason is not null").select(*deliveries.columns, "reason")


def normalize_slack_event(events: DataFrame, payload: str = "payload", workspace: str = "workspace_id") -> DataFrame:
    """Events-API envelopes as one-message threads; those without ts or text are acknowledged only."""
    j = lambda path: F.get_json_object(payload, f"$.event.{path}")
    text = F.coalesce(j("text"), j("message.text"))
    out = events.select(
        F.col(workspace).alias("workspace_id"), F.lit("slack").alias("source"),
        F.concat_ws(":", F.lit("slack"), F.coalesce(j("channel"), F.lit("unknown")), F.coalesce(blank(j("thread_ts")), j("ts"))).alias("external_thread_id"),
        F.coalesce(j("channel"), F.lit("general")).alias("channel_or_project"), F.coalesce(j("user"), j("message.user"), F.lit("Unknown")).alias("user"),
        text.alias("text"), j("ts").alias("timestamp"),
    )
    return out.filter("coalesce(timestamp, '') != '' and coalesce(text, '') != ''")


def event_timestamp(provider: Column, payload: Column) -> Column:
    """The provider's own time of a delivery: the first field that is there."""
    j = lambda *paths: F.coalesce(*[F.get_json_object(payload, f"$.{p}") for p in paths])
    return (
        F.when(provider == "slack", j("event.ts", "event_time", "timestamp"))
        .when(provider == "github", j("comment.created_at", "issue.updated_at", "issue.created_at", "pull_request.created_at"))
        .when(provider == "linear", j("data.createdAt", "createdAt", "updatedAt"))
    )


def event_action(event: Column, payload: Column) -> tuple[Column, Column]:
    """(action, branch) of a repository host's delivery; a null action is unhandled."""
    j = lambda p: F.get_json_object(payload, f"$.{p}")
    repo, action = j("repository.full_name").isNotNull(), j("action")
    kind = F.when(j("installation.id").isNotNull(), (
        F.when((event == "installation") & (action == "deleted"), "unmap_installation").when((event == "installation") & action.isin("created", "unsuspend"), "sync_installation")
        .when(event == "installation", "map_installation").when(event == "installation_repositories", "sync_installation")
        .when(event.isin("push", "pull_request", "issues", "issue_comment", "discussion", "discussion_comment", "release") & repo, "sync_repository")
        .when((event == "repository") & repo & (action == "deleted"), "unmap_installation").when((event == "repository") & repo, "sync_repository")
    ))
    branch = F.when((event == "push") & (kind == "sync_repository"), blank(F.replace(F.coalesce(j("ref"), F.lit("")), F.lit("refs/heads/"), F.lit(""))))
    return kind, branch


def repo_objects_to_documents(objects: DataFrame) -> DataFrame:
    """Rows of repo, type (file, issue, pull_request, release, discussion, wiki), key, title, body, url as documents."""
    title = F.coalesce("title", F.lit(""))
    return objects.select(
        F.lit("github").alias("source"), F.concat_ws("/", "repo", "type", F.col("key").cast("string")).alias("external_id"), F.col("type").alias("document_type"), title.alias("title"),
        F.when(F.coalesce("body", F.lit("")) == "", title).otherwise(F.concat(title, F.lit("\n\n"), F.col("body"))).alias("text"), "url",
    )


# What is never indexed, and what is.
IGNORED_DIRECTORIES = (
    "node_modules .git .github dist build out target bin obj vendor .next .nuxt coverage .cache .idea .vscode .gradle .venv venv __pycache__ Pods DerivedData .terraform tmp logs"
).split()
BINARY_EXTENSIONS = (
    "png jpg jpeg gif svg webp ico bmp tiff avif heic mp4 mkv avi mov webm flv wmv mpg mpeg m4v mp3 wav flac ogg m4a aac wma opus zip tar gz tgz bz2 xz 7z rar zst "
    "jar war ear apk ipa exe msi dll so dylib a o obj bin dat db sqlite sqlite3 class pyc pyo whl deb rpm pdf doc docx ppt pptx xls xlsx odt ods odp epub mobi ttf otf woff woff2 eot"
).split()
TEXT_EXTENSIONS = (
    "ts tsx js jsx mjs cjs py rb go java rs c h cpp cc cxx hpp cs php swift kt kts scala sh bash zsh fish ps1 bat cmd sql graphql gql proto prisma vue svelte astro lua pl r dart "
    "elm ex exs erl hrl clj cljs nim zig cob asm fs fsx sol tf hcl dockerfile json jsonc yaml yml toml ini cfg conf properties env xml csv tsv md markdown mdx txt rst adoc html htm css scss sass less"
).split()
TEXT_NAMES = "dockerfile makefile license licence copying readme changelog changelog.md".split()
IGNORED_NAMES = (
    "package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml poetry.lock cargo.lock go.sum gemfile.lock composer.lock pdm.lock uv.lock pipfile.lock flake.lock bun.lockb bun.lock deno.lock"
).split()


def indexable_path(path: Column, size: Column | None = None, most: int = 400_000) -> Column:
    """Whether a repository path is text worth indexing; ``public/vendor`` counts as a pair of directories."""
    parts = F.split(path, "/")
    folders, name = F.slice(parts, 1, F.size(parts) - 1), F.lower(F.element_at(parts, -1))
    extension = F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
    ignored = F.arrays_overlap(folders, F.array(*map(F.lit, IGNORED_DIRECTORIES))) | F.concat(F.lit("/"), F.array_join(folders, "/"), F.lit("/")).contains("/public/vendor/")
    good = extension.isin(TEXT_EXTENSIONS) | name.isin(TEXT_NAMES)
    out = (path != "") & ~ignored & ~name.isin(IGNORED_NAMES) & ~extension.isin(BINARY_EXTENSIONS) & good
    return F.coalesce(out if size is None else out & (size <= most), F.lit(False))


# Extensions by MIME type.
MIME_EXTENSIONS = {"application/pdf": ".pdf", "text/plain": ".txt", "text/markdown": ".md", "text/csv": ".csv", "text/html": ".html", "application/json": ".json"}


def content_addressed_objects(objects: DataFrame, workspace: str, content: str, mime: str, order: str) -> DataFrame:
    """object_path, owner, uploads: an object's path follows from its content; the first upload owns it and the
    later ones map to it."""
    ext = F.coalesce(F.create_map(*[F.lit(x) for kv in MIME_EXTENSIONS.items() for x in kv])[F.col(mime)], F.lit(".bin"))
    path = F.concat(F.lit("raw/"), F.col(workspace).cast("string"), F.lit("/"), F.sha2(content, 256), ext)
    return objects.groupBy(path.alias("object_path")).agg(F.min(order).alias("owner"), F.count(F.lit(1)).alias("uploads"))


def event_ledger_append(ledger: DataFrame, deliveries: DataFrame, seq: str) -> DataFrame:
    """The deliveries (with dedupe_key) that the ledger hasn't, the first of each key."""
    first = deliveries.groupBy("dedupe_key").agg(F.min_by(F.struct(*[c for c in deliveries.columns if c != "dedupe_key"]), seq).alias("r")).select("dedupe_key", "r.*")
    return first.join(ledger.select("dedupe_key"), "dedupe_key", "left_anti")


def with_dedupe_key(events: DataFrame, workspace: str, provider: str, external_id: str, ts: str, payload: str) -> DataFrame:
    return events.withColumn("dedupe_key", dedupe_key(*map(F.col, (workspace, provider, external_id, ts, payload))))


def upsert_by_key(current: DataFrame, changes: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Both tables' latest row of each key by ``seq``; on equal seq the changes win."""
    tagged = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    rest = [c for c in current.columns if c not in keys]
    return tagged.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(seq, "_new")).alias("r")).select(*keys, "r.*")


def update_delete_by_key(rows: DataFrame, updates: dict[str, tuple[Column, Column]], delete: Column) -> DataFrame:
    """Rows without those that ``delete`` holds for; columns as (condition, new value) are changed."""
    kept = rows.filter(~F.coalesce(delete, F.lit(False)))
    return kept.withColumns({c: F.when(when, value).otherwise(F.col(c)) for c, (when, value) in updates.items()})


def quarantine_split(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, bad with ``reasons``): a rule names what is wrong where its condition holds."""
    judged = rows.withColumn("reasons", F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()])))
    return judged.filter(F.size("reasons") == 0).drop("reasons"), judged.filter(F.size("reasons") > 0)


def acl_rows(docs: DataFrame, doc_id: str, roles: str, default: tuple[str, ...] = ("admin", "member")) -> DataFrame:
    own = F.when(F.size(roles) > 0, F.col(roles)).otherwise(F.array(*map(F.lit, default)))
    return docs.select(F.col(doc_id), F.explode(F.array_distinct(own)).alias("principal_id")).withColumns({"principal_type": F.lit("role"), "permission": F.lit("read")})


# What marks a thread as one that may hold a procedure.
PROCEDURE_SIGNALS = r"(?i)resolution:|mitigation:|rollback:|root\s*cause:|\[P0\]|\[P1\]|sop:|procedure:|runbook:|workaround:|incident\s*override"


def thread_candidates(messages: DataFrame, thread: str, order: list[str], text: str, least: int = 4, signals: str = PROCEDURE_SIGNALS) -> DataFrame:
    """thread, replies of threads with enough messages one of which has a signal. No thread is gathered whole."""
    hit = F.max(F.regexp_like(F.coalesce(F.col(text), F.lit("")), F.lit(signals)).cast("int"))
    return messages.groupBy(thread).agg(F.count(F.lit(1)).alias("replies"), hit.alias("hit")).filter(f"replies >= {least} and hit = 1").drop("hit")


def execution_log(runs: DataFrame, actor: str, action: str, target: str, status: str, details: list[str]) -> DataFrame:
    """Rows for an append-only log, with the details as JSON; write with mode append, by date."""
    return runs.select(F.col(actor).alias("actor"), F.col(action).alias("action"), F.col(target).alias("target"), F.col(status).alias("status"), F.to_json(F.struct(*details)).alias("payload"))


def tenant_lookup(deliveries: DataFrame, installations: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(mapped, rejected) deliveries by provider and organisation."""
    joined = deliveries.join(installations, keys, "left")
    return joined.filter("workspace_id is not null"), joined.filter("workspace_id is null")


def union_sources(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out
