"""Scalar functions: hashes, keys, text clean-up, vectors, cost, decay. All are column expressions."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "[REDACTED]"
#: White space as JavaScript's trim and \s have it, as a class body both Java and RE2 read.
WS = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

# Patterns of secrets, applied in this order, case-insensitively but for the last.
# SECRET_OPENINGS has, in the same order, lower-case literals of which a match of the pattern has one.
SECRET_PATTERNS = [
    r"(?i)bearer\s+[a-z0-9._~+/=-]{8,}",
    r"(?i)basic\s+[a-z0-9+/=]{8,}",
    r"(?i)sk-[a-z0-9_-]{8,}",
    r"(?i)aiza[0-9a-z_-]{20,}",
    r"(?i)gh[pousr]_[a-z0-9]{20,}",
    r"(?i)github_pat_[a-z0-9_]{20,}",
    r"(?i)xox[baprs]-[a-z0-9-]{10,}",
    r"(?i)xapp-[a-z0-9-]{10,}",
    r"(?i)hooks\.slack\.com/services/[a-z0-9]+/[a-z0-9]+/[a-z0-9]+",
    r"(?i)eyj[a-z0-9_-]{10,}\.[a-z0-9_-]{10,}\.[a-z0-9_-]{10,}",
    r"(?i)\b(?:akia|asia)[0-9a-z]{16}\b",
    r"(?i)-----begin [a-z ]*private key-----[\s\S]*?-----end [a-z ]*private key-----",
    r"""(?i)(?:password|passwd|pwd|api[_-]?key|secret|token|client[_-]?secret)\s*[:=]\s*["']?[^\s"',}\\]{6,}""",
    r"//[^:\s/]+:[^@\s/]+@",
]
SECRET_OPENINGS = [
    ["bearer"], ["basic"], ["sk-"], ["aiza"], ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], ["github_pat_"], ["xox"], ["xapp-"], ["hooks.slack.com/services/"], ["eyj"],
    ["akia", "asia"], ["-----begin "], ["password", "passwd", "pwd", "api", "secret", "token"], ["//"],
]
# Normalised names of keys whose values are secret.
SECRET_KEYS = (
    "authorization auth apikey xapikey xapi password passwd pwd passphrase userpassword temporarypassword secret secrets secretkey "
    "vaultsecret vaultkey vaultsecretkey masterkey kmsmasterkey encryptionkey token tokens accesstoken accesstokens refreshtoken oauthtoken "
    "idtoken authtoken authtokens sessiontoken csrftoken signedtoken bearer bearertoken clientsecret signingsecret webhooksecret privatekey "
    "privatepem cookie cookies setcookie session sessionid credentials slacktoken githubtoken supabaseservicerolekey supabaseanonkey "
    "openrouterapikey openrouterkey geminiapikey anthropicapikey openiaikey openaiapikey ssn creditcard creditcardnumber"
).split()
# Cents per million input and output tokens; the first pattern that the model's name has.
PRICES = [
    ("gemini", 125, 500), ("deepseek|v4-flash|flash", 15, 60), (r"gpt-4o|gpt-4\.1", 250, 1000), ("gpt-4", 3000, 6000), (r"gpt-3\.5|turbo", 50, 150),
    ("claude-3-5-haiku|claude-3-haiku", 80, 400), ("claude-3-5-sonnet|claude-3-sonnet", 300, 1500), ("llama", 20, 80),
]
DEFAULT_PRICE = (50, 150)
# Names of systems and what they are resolved to.
ALIASES = {
    "pg": "postgresql_db", "postgres": "postgresql_db", "postgresql": "postgresql_db", "postgresql primary": "postgresql_db",
    "pg_primary": "postgresql_db", "postgres_db": "postgresql_db", "replica_db": "postgresql_replica", "github_actions": "gh_ci",
    "gh_actions": "gh_ci", "github ci": "gh_ci", "actions": "gh_ci", "k8s": "kubernetes", "kube": "kubernetes", "k8s cluster": "kubernetes",
    "aws_s3": "s3_storage", "s3": "s3_storage", "s3 bucket": "s3_storage", "stripe": "stripe_api", "stripe_payments": "stripe_api",
    "stripe gateway": "stripe_api", "stripe_billing": "stripe_api", "slack": "slack_workspace", "slack_channel": "slack_workspace",
    "zendesk": "zendesk_support", "linear": "linear_tracker",
}


def blank(c: Column) -> Column:
    """Null for an empty string, as ``x || default`` treats it."""
    return F.nullif(c, F.lit(""))


def clean(c: Column) -> Column:
    """Trims white space of every kind at both ends."""
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def token_estimate(text: Column) -> Column:
    """At least one; else a quarter of the code points, rounded up."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")


def idempotency_key(*parts: Column) -> Column:
    """Hash of the parts joined by colons; a null part is empty and keeps its separator."""
    return F.sha2(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def dedupe_key(workspace: Column, provider: Column, external_id: Column, event_ts: Column, payload: Column) -> Column:
    return idempotency_key(workspace, provider, external_id, F.coalesce(event_ts, F.sha2(F.coalesce(payload, F.lit("{}")), 256)))


def fallback_id(prefix: str, *fields: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.to_json(F.struct(*fields)), 256), 1, 24))


def source_key(workspace: Column, source: Column, external_id: Column) -> Column:
    return F.concat_ws(":", workspace, source, external_id)


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is bound to a variable, so that it is worked out once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def canonical_entity(name: Column) -> Column:
    """The alias's target by slug, else by the name with a space for every mark, else the slug."""
    table = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    # Each step is bound to a variable, so that it is worked out once.
    forms = lambda low: F.struct(F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9\s_-]", ""), r"\s+", "_").alias("slug"), F.regexp_replace(low, "[^a-z0-9]", " ").alias("spaced"))
    resolved = lambda f: F.coalesce(table[f["slug"]], table[f["spaced"]], blank(f["slug"]), F.lit("unnamed_entity"))
    return F.get(F.transform(F.transform(F.array(F.lower(clean(name))), forms), resolved), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for null, empty or unequally long vectors and for zero norms."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def parse_vector(text: Column) -> Column:
    """The finite numbers of ``[a,b,...]``."""
    parts = F.transform(F.split(F.regexp_replace(text, r"[\[\]\s]", ""), ","), lambda x: x.try_cast("double"))
    return F.filter(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def vector_valid(v: Column, dims: int) -> Column:
    """Exactly so many values, all finite. Nothing is repaired."""
    return F.coalesce((F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def time_decay(created: Column, at: Column, half_life: Column | float = 30.0) -> Column:
    days = (F.unix_micros(at) - F.unix_micros(created)) / 86_400_000_000
    life = half_life if isinstance(half_life, Column) else F.lit(float(half_life))
    return F.greatest(F.lit(0.01), F.least(F.lit(1.0), F.exp(-F.log(F.lit(2.0)) / life * days)))


def llm_cost(provider: Column, model: Column, prompt: Column, completion: Column) -> Column:
    """Cents, rounded half up."""
    price = lambda k: F.coalesce(*[F.when(F.regexp_like(model, F.lit(f"(?i){p[0]}")), p[k]) for p in PRICES], F.lit(DEFAULT_PRICE[k - 1]))
    cents = F.floor((prompt * price(1) + completion * price(2)) / 1_000_000 + 0.5)
    return F.when(provider == "ollama", 0).otherwise(cents).cast("long")


def redact_text(text: Column) -> Column:
    """Secrets masked. A pattern runs only over a text that has one of its literals, which a plain search finds;
    masking adds none. Each step is a function of one variable, so that no step's text is worked out twice."""

    def step(has: Column, pattern: str):
        return lambda t: F.when(has, F.regexp_replace(t, pattern, REDACTED)).otherwise(t)

    def masked(s: Column) -> Column:
        out = s["text"]
        for pattern, literals in zip(SECRET_PATTERNS, SECRET_OPENINGS, strict=True):
            has = F.lit(False)
            for x in literals:
                has = has | F.contains(s["low"], F.lit(x))
            out = F.get(F.transform(F.array(out), step(has, pattern)), F.lit(0))
        return out

    # Lower case keeps the letters that (?i) takes for ASCII ones.
    return F.get(F.transform(F.array(F.struct(F.lower(text).alias("low"), text.alias("text"))), masked), F.lit(0))


def redact_map(m: Column) -> Column:
    """Values of secret keys are masked whole, the others as text."""
    return F.transform_values(m, lambda k, v: F.when(F.regexp_replace(F.lower(k), "[^a-z0-9]", "").isin(SECRET_KEYS), REDACTED).otherwise(redact_text(v)))


def strip_json_fence(text: Column) -> Column:
    """What stands inside a Markdown code fence, if there is one."""
    return clean(F.regexp_replace(F.regexp_replace(clean(text), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))


def keyword_vector(*parts: Column, stop: tuple[str, ...] = ("a", "an", "and", "the", "of", "to", "in", "is", "or", "for")) -> Column:
    """Distinct lower-case words without stop words, sorted."""
    found = F.regexp_extract_all(F.lower(F.concat_ws(" ", *parts)), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_sort(F.array_except(F.array_distinct(found), F.array(*map(F.lit, stop))))


def ipv4(text: Column) -> Column:
    """The address as a number; null if it isn't one."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))
    number = F.aggregate(F.transform(parts, lambda x: x.cast("long")), F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    good = F.regexp_like(text, F.lit(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$")) & F.forall(parts, lambda x: x.cast("long") <= 255)
    return F.when(good, number)


# Private, reserved and special IPv4 ranges.
BLOCKED_V4 = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
]


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def ipv6(text: Column) -> Column:
    """The address as eight numbers; null if it isn't one. Its last two groups may be written as an IPv4 address."""
    v4 = r"\d{1,3}(?:\.\d{1,3}){3}$"
    tail = lambda n: F.concat(F.regexp_replace(text, v4, ""), F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n.bitwiseAND(0xFFFF)))
    plain = F.when(F.regexp_like(text, F.lit(":" + v4)), _once(ipv4(F.regexp_extract(text, v4, 0)), tail)).otherwise(text)
    groups = lambda side: F.when(F.coalesce(side, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(side, ":", -1))

    def every(x: Column) -> Column:
        given = F.size(x["left"]) + F.size(x["right"])
        fits = (x["sides"] == 1) & (given == 8) | (x["sides"] == 2) & (given < 8)
        filled = F.concat(x["left"], F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - given)), x["right"])
        good = fits & F.forall(F.concat(x["left"], x["right"]), lambda g: F.regexp_like(g, F.lit("^[0-9A-Fa-f]{1,4}$")))
        return F.when(good, F.transform(filled, lambda g: F.conv(g, 16, 10).cast("int")))

    parted = lambda sides: F.struct(F.size(sides).alias("sides"), groups(F.get(sides, F.lit(0))).alias("left"), groups(F.get(sides, F.lit(1))).alias("right"))
    return _once(_once(F.split(plain, "::", -1), parted), every)


def _in_network(address: Column, net: ipaddress.IPv4Network | ipaddress.IPv6Network) -> Column:
    """Whether an address (v4: a number, v6: eight numbers; one of them or none) lies in a range of its kind."""
    if net.version == 4:
        shift = 32 - net.prefixlen
        return F.coalesce(F.shiftright(address["v4"], shift) == (int(net.network_address) >> shift), F.lit(False))
    want, whole, rest = net.network_address.packed, net.prefixlen // 16, net.prefixlen % 16
    of = lambda k: int.from_bytes(want[2 * k:2 * k + 2], "big")
    inside = address["v6"].isNotNull()
    for k in range(whole):
        inside = inside & (F.get(address["v6"], F.lit(k)) == of(k))
    if rest:
        inside = inside & (F.shiftright(F.get(address["v6"], F.lit(whole)), 16 - rest) == (of(whole) >> 16 - rest))
    return F.coalesce(inside, F.lit(False))


def _network(cidr: str) -> ipaddress.IPv4Network | ipaddress.IPv6Network | None:
    """A range, a bare address being a range of one; None for a malformed one."""
    _, slash, bits = cidr.partition("/")
    try:
        return ipaddress.ip_network(cidr, strict=False) if not slash or bits.isdigit() else None
    except ValueError:
        return None


def cidr_allow(ip: Column, ranges: list[str]) -> Column:
    """Whether one of the ranges has the address; ``*`` has all. A malformed address is in no other, and a malformed
    range ends the list: a list with an error in it admits nothing more. An IPv6 address that maps an IPv4 one is
    that one."""
    nets: list = []
    for r in map(str.strip, ranges):
        net = r if r == "*" else _network(r)
        if net is None:
            break
        nets.append(net)

    def fits(address: Column) -> Column:
        out = F.lit(False)
        for net in nets:
            out = out | (F.lit(True) if net == "*" else _in_network(address, net))
        return out

    text = F.trim(ip)
    mapped = lambda six: F.forall(F.slice(six, 1, 5), lambda x: x == 0) & (F.get(six, F.lit(5)) == 0xFFFF)
    low = lambda six: F.get(six, F.lit(6)).cast("long") * 65536 + F.get(six, F.lit(7))
    both = lambda six: F.struct(F.coalesce(ipv4(text), F.when(mapped(six), low(six))).alias("v4"), F.when(~mapped(six), six).alias("v6"))
    return _once(_once(ipv6(text), both), fits)


def blocked_ip(ip: Column) -> Column:
    """Malformed addresses are blocked."""

    def blocked(address: Column) -> Column:
        out = address["v4"].isNull()
        for r in BLOCKED_V4:
            out = out | _in_network(address, _network(r))
        return out

    return _once(F.struct(ipv4(ip).alias("v4")), blocked)
