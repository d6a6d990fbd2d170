"""Scalar column functions: ids, paths, digests, labels."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

SKILL_ID = r"^[a-z0-9:_./-]{1,64}$"
REPO_SLUG = r"^[a-z0-9._-]+/[a-z0-9._-]+$"
COMMAND = r"<command-name>([^<>]{1,80})</command-name>"
# Commands of the harness itself, which are no skills.
HARNESS_COMMANDS = (
    "end model usage compact clear resume status context effort branch help login doctor cost init exit hooks memory mcp "
    "permissions agents export todos vim add-dir bashes ide bug release-notes privacy-settings upgrade terminal-setup install-github-app "
    "pr-comments review logout config output-style rewind statusline migrate-installer"
).split()
_BLANK = r"^\s+|\s+$"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, _BLANK, "")


def skill_id(raw: Column) -> Column:
    """Canonical skill id, or null: without a leading slash, lower case, ``x:x`` as ``x``, no harness command."""
    flat = F.regexp_replace(F.lower(trimmed(raw)), "^/", "")
    flat = F.regexp_replace(flat, r"^([^:]*):\1$", "$1")
    return F.when(flat.rlike(SKILL_ID) & ~flat.isin(*HARNESS_COMMANDS), flat)


def agent_id(raw: Column) -> Column:
    flat = F.lower(trimmed(raw))
    return F.when(flat.rlike(SKILL_ID), flat)


def command_tags(text: Column, tag: str = "command-name") -> Column:
    """The values of all such tags in a text."""
    return F.regexp_extract_all(text, F.lit(COMMAND.replace("command-name", tag)), F.lit(1))


def repo_slug(url: Column) -> Column:
    """``owner/name`` of a remote url in lower case; null if it has none."""
    flat = trimmed(url)
    bare = F.when(flat.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), F.regexp_replace(flat, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")).otherwise(F.regexp_replace(flat, r"^([^:]*):", "$1/"))
    parts = F.filter(F.split(bare, "/"), lambda p: p != "")
    slug = F.lower(F.concat_ws("/", F.try_element_at(parts, F.lit(-2)), F.regexp_replace(F.try_element_at(parts, F.lit(-1)), r"(?i)\.git$", "")))
    return F.when((F.size(parts) >= 2) & slug.rlike(REPO_SLUG), slug)


def org_repo(enrolled: Column, slug: Column) -> Column:
    """The slug, only where the device is enrolled and the slug is one."""
    flat = F.lower(trimmed(slug))
    return F.when(F.coalesce(enrolled, F.lit(False)) & flat.rlike(REPO_SLUG), flat)


def base_name(path: Column) -> Column:
    """Last segment of a path with either separator; null for roots."""
    name = F.regexp_extract(F.regexp_replace(path, r"[/\\]+$", ""), r"([^/\\]+)$", 1)
    return F.when((name != "") & ~name.rlike(r"^[A-Za-z]:$"), name)


def entry_point(raw: Column, sidechain: Column) -> Column:
    """Where a session was started, from a client name."""
    flat = F.lower(trimmed(raw))
    # The client names that logs use.
    known = (
        F.when(F.coalesce(sidechain, F.lit(False)), "subagent")
        .when(flat.isNull() | (flat == ""), "unknown")
        .when(flat.isin("vs-code", "vscode"), "vscode")
        .when(flat.isin("codex_vscode", "codex-vscode"), "codex-vscode")
        .when(flat.isin("claude-desktop", "desktop"), "desktop")
        .when(flat.isin("terminal", "cli"), "cli")
    )
    return known.when(flat.startswith("opencode") | flat.rlike(r"^[a-z0-9._:-]{1,64}$"), flat).otherwise("unknown")


def hermes_entry_point(raw: Column) -> Column:
    """Where a session was started, for stores that name platforms: well-formed names stand for themselves."""
    flat = F.lower(trimmed(raw))
    return F.when(flat.isin("cli", "terminal"), "cli").when(flat.rlike(r"^[a-z0-9._:-]{1,64}$"), flat).otherwise("unknown")


def hmac_hex(key: bytes, message: Column, digits: int = 32) -> Column:
    """First hexadecimal digits of HMAC-SHA256; the key is padded here, the rest are built-in functions."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in block).hex() for pad in (0x36, 0x5C))
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), F.encode(message, "UTF-8")), 256)
    return F.substring(F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256), 1, digits)


def repo_hash(key: bytes, label: Column) -> Column:
    return hmac_hex(key, F.lower(trimmed(base_name(label))))


def semver(version: Column) -> Column:
    """A version as ``[major, minor, patch]``, comparable; null if it is none."""
    parts = [F.regexp_extract(trimmed(version), r"^v?(\d+)\.(\d+)\.(\d+)", k) for k in (1, 2, 3)]
    return F.when(parts[0] != "", F.array(*(F.when(p != "", p).cast("int") for p in parts)))


def newer(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as version ``a`` comes before, with or after ``b``; 0 if either is none."""
    a, b = semver(a), semver(b)
    return F.coalesce(F.when(a < b, -1).when(a > b, 1), F.lit(0))


def one_digit(x: Column) -> Column:
    """A double of 0 or more with one decimal, rounded by its exact binary value; exact halves go up."""
    tenths = F.floor(x * 10).cast("long")
    odd = (tenths * 2 + 1).cast("double")
    up = (x * 16 - odd) + x * 4 >= 0  # 20 x against an odd number; near a half each step is exact
    tenths = tenths + F.when(up, 1).otherwise(0)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def compact(n: Column) -> Column:
    """1234567 as ``1.2M``, -1234567 as ``-1.2M``; numbers under a thousand as they are."""
    n = n.cast("double")
    size = F.abs(n)
    sign = F.when(n < 0, "-").otherwise("")
    out = F.when(n == F.floor(n), n.cast("long").cast("string")).otherwise(n.cast("string"))
    for unit_size, unit in ((1e3, "K"), (1e6, "M"), (1e9, "B")):
        out = F.when(size >= unit_size, F.concat(sign, one_digit(size / unit_size), F.lit(unit))).otherwise(out)
    return out


def grouped(n: Column) -> Column:
    """10412388 as ``10,412,388``, halves up."""
    return F.regexp_replace(F.floor(n.cast("double") + 0.5).cast("string"), r"\B(?=(\d{3})+(?!\d))", ",")


def money_tick(v: Column) -> Column:
    """Dollars on an axis: ``$600``, ``$1.2k``, ``$2k``."""
    v = v.cast("double")
    thousands = F.regexp_replace(one_digit(v / 1000), r"\.0$", "")
    return F.when(v >= 1000, F.concat(F.lit("$"), thousands, F.lit("k"))).otherwise(F.concat(F.lit("$"), F.floor(v + 0.5).cast("string")))


def short_span(minutes: Column) -> Column:
    """Minutes as a short span: ``45m``, ``3h 12m``, ``6d``."""
    m = F.greatest(F.lit(0), F.floor(minutes.cast("double") + 0.5)).cast("long")
    rest = F.when(m % 60 != 0, F.concat(F.lit(" "), (m % 60).cast("string"), F.lit("m"))).otherwise("")
    days = F.floor(m.cast("double") / 1440 + 0.5).cast("string")
    return F.when(m < 60, F.concat(m.cast("string"), F.lit("m"))).when(m < 2880, F.concat(F.floor(m / 60).cast("string"), F.lit("h"), rest)).otherwise(F.concat(days, F.lit("d")))


def clock(ms: Column) -> Column:
    """Milliseconds as ``h:mm``."""
    minutes = F.floor(ms / 60_000)
    return F.concat(F.floor(minutes / 60).cast("string"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"))


def short_model(model: Column, most: int = 14) -> Column:
    flat = F.regexp_replace(model, "^claude-", "")
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def live_signature(models: Column) -> Column:
    """Sorted ``id:counts`` of an array of ``(model, input, output, cache_read, cache_creation)``."""
    each = F.transform(models, lambda m: F.concat_ws(":", m["model"], *(m[c].cast("string") for c in ("input", "output", "cache_read", "cache_creation"))))
    return F.concat_ws("|", F.array_sort(each))


def model_of_json(raw: Column) -> Column:
    """``provider/id`` of ``{"id", "providerID"}``; the bare id without a provider; null without an id."""
    model, provider = F.get_json_object(raw, "$.id"), F.get_json_object(raw, "$.providerID")
    return F.when(F.length(model) > 0, F.concat_ws("/", F.when(F.length(provider) > 0, provider), model))


def weighted(cache_share: float = 0.02) -> Column:
    """Tokens with cache reads at a small share, for comparing totals."""
    return F.col("input") + F.col("output") + F.col("cache_creation") + F.col("cache_read") * cache_share


def percent(p: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), p))


def billing_source(cloud: Column, bearer: Column, api_key: Column, login: Column) -> Column:
    """How usage is paid: a cloud platform beats a bearer token, that an API key, that a subscription login."""
    return F.when(cloud, "cloud").when(bearer, "bearer").when(api_key, "api_key").when(login, "subscription").otherwise("unknown")


def flip_kind(before: Column, now: Column) -> Column:
    """What a change of billing source means: the costly one from subscription to key, any other, or none."""
    return F.when(before.isNull() | (before == now), "none").when((before == "subscription") & (now == "api_key"), "to_api_key").otherwise("other_change")


def org_slug(given: Column) -> Column:
    """An organisation's slug from a bare slug or a url with ``/org/<slug>``; null for anything else."""
    flat = trimmed(given)
    found = F.regexp_extract(flat, r"(?i)/org/([^/?#]+)", 1)
    return F.when(found != "", F.lower(found)).when((flat != "") & ~flat.rlike(r"[\s/]"), F.lower(flat))


def counts_only(models: Column) -> Column:
    """An array of model structs as a map from id to its four counts, and nothing else."""
    return F.map_from_entries(F.transform(models, lambda m: F.struct(m["model"].alias("key"), F.struct(*(m[c].alias(c) for c in ("input", "output", "cache_read", "cache_creation"))).alias("value"))))


def native_providers(model: Column) -> Column:
    """The catalog names of the vendor that makes a model, most likely first."""
    # Id prefix and provider names.
    vendors = [
        ("claude-", ["anthropic"]),
        ("gpt-", ["openai"]),
        ("grok-", ["xai"]),
        ("gemini-", ["google", "google-ai-studio", "gemini"]),
        ("kimi-", ["moonshotai", "moonshot"]),
        ("glm-", ["zai", "z-ai", "zhipuai"]),
    ]
    out = F.array().cast("array<string>")
    for prefix, names in reversed(vendors):
        out = F.when(model.startswith(prefix), F.array(*(F.lit(n) for n in names))).otherwise(out)
    return out


def rate_errors(model: Column, input_: Column, output: Column, cache_read: Column, cache_write: Column) -> Column:
    """What is wrong with a rate that a user states, as an array of messages."""

    def bad(name: str, c: Column, least_open: bool) -> Column:
        low = c <= 0 if least_open else c < 0
        return F.when((c.isNull() & F.lit(least_open)) | low | (c > 10_000) | F.isnan(c), f"{name} out of range")

    checks = F.array(
        F.when(F.coalesce(~model.rlike(r"^[\w.\-/:@]{1,128}$"), F.lit(True)), "bad model id"),
        bad("input", input_, True), bad("output", output, True), bad("cache read", cache_read, False), bad("cache write", cache_write, False),
    )
    return F.array_compact(checks)


def provider_of_path(path: Column) -> Column:
    """The harness that a log file belongs to, by the end of its path or its layout; null for others."""
    flat = F.lower(F.translate(path, "\\", "/"))
    return (
        F.when(flat.rlike(r"/\.codex/sessions/(.*/)?rollout-[^/]*\.jsonl$"), "codex")
        .when(flat.endswith("/logs/unified.jsonl"), "grok")
        .when(flat.contains("/agent/sessions/"), "pi")
        .when(flat.rlike(r"/agents/[^/]+/sessions/.+\.jsonl$") & ~flat.endswith(".trajectory.jsonl"), "openclaw")
        .when(flat.rlike(r"(^|/)opencode(-[a-z0-9._-]+)?\.db$"), "opencode")
        .when(flat.endswith("/state.db"), "hermes")
        .when(flat.endswith("/session-store.db"), "copilot")
        .when(flat.endswith(".jsonl"), "claude")
    )
