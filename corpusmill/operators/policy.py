"""Sourcing policy: robots.txt after RFC 9309, opt-out registries, and opt-out signals of pages."""

from __future__ import annotations

import re
import time
from collections import defaultdict
from collections.abc import Callable, Iterable
from urllib.parse import quote, unquote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions import text as T

ROBOTS_BYTES = 500 << 10
HTML_CHARS = 200_000
TRAINING_AGENTS = ("Ai2Bot", "Applebot-Extended", "CCBot", "ClaudeBot", "GPTBot", "Google-Extended")
DEFAULT_AGENT = "corpusmill"
_FIELDS = {"user agent": "agent", "useragent": "agent", "user-agent": "agent"} | {k: k for k in ("allow", "disallow")} | {f"content-{k}": "signal" for k in ("signal", "usage")}


def normal_path(path: str) -> str:
    """One spelling for paths that differ in percent-encoding alone."""
    return quote(unquote(path), safe="!$&'()*+,-./:;=?@_~")


def path_matches(pattern: str, path: str) -> bool:
    """A rule's path against a normal path: * is any text, a final $ the end. Pieces are sought left to right, in linear time."""
    exact, body = pattern.endswith("$"), pattern.removesuffix("$")
    pieces = [normal_path(p) for p in body.split("*")]
    if not path.startswith(pieces[0]):
        return False
    at = len(pieces[0])
    if len(pieces) == 1:
        return not exact or len(path) == at
    for piece in pieces[1:-1]:
        at = path.find(piece, at) + len(piece)
        if at < len(piece):
            return False
    return path.endswith(pieces[-1]) and len(path) - len(pieces[-1]) >= at if exact else path.find(pieces[-1], at) >= 0


def token_of(agent: str) -> str:
    return agent.lower().partition("/")[0].strip()


class Robots:
    """Groups of (agents, rules, signals); or one answer for all paths."""

    def __init__(self, groups: Iterable[tuple] = (), everywhere: bool | None = None):
        self.groups, self.everywhere = list(groups), everywhere

    @classmethod
    def parse(cls, body: str | bytes) -> Robots:
        if isinstance(body, bytes):
            body = body[:ROBOTS_BYTES].decode("utf-8", "replace")
        groups: list[tuple[set, list, list]] = []
        for line in body.splitlines():
            name, colon, value = line.partition("#")[0].partition(":")
            what, value = _FIELDS.get(name.strip().lower()), value.strip()
            if not colon or what is None:
                continue
            if what == "agent":
                if not groups or groups[-1][1] or groups[-1][2]:
                    groups.append((set(), [], []))
                groups[-1][0].add(token_of(value))
            elif groups and what == "signal":
                groups[-1][2].append(value)
            elif groups and value:
                groups[-1][1].append((value, what == "allow"))
        return cls(groups)

    @classmethod
    def of_status(cls, status: int) -> Robots:
        """Client errors allow all; server errors and no answer forbid all."""
        return cls(everywhere=400 <= status < 500)

    def of_agent(self, agent: str, others: bool = True) -> list[tuple]:
        """All groups of the agent together, or else those of *."""
        own = [g for g in self.groups if token_of(agent) in g[0]]
        return own or [g for g in self.groups if others and "*" in g[0]]

    def allowed(self, url: str, agent: str, others: bool = True) -> bool:
        """The longest matching path decides; of equally long ones allow."""
        if self.everywhere is not None:
            return self.everywhere
        at = urlsplit(url)
        path = normal_path(at.path or "/") + ("?" + normal_path(at.query) if at.query else "")
        if path == "/robots.txt":
            return True
        hits = [(len(normal_path(p)), allow) for g in self.of_agent(agent, others) for p, allow in g[1] if path_matches(p, path)]
        return max(hits)[1] if hits else True

    def signals(self, agent: str) -> list[str]:
        return [s for g in self.of_agent(agent) for s in g[2]]


def forbids_training(value: str) -> bool:
    terms = {k.strip().lower(): v.strip().lower() for k, _, v in (t.partition("=") for t in re.split(r"[\s,;]+", value))}
    return "no" == terms.get("ai-train") or terms.get("train-ai", "") in ("no", "n")


def page_opt_out(headers: dict[str, str] | None, page: str | None) -> str | None:
    """The first opt-out signal of a page's headers and meta tags."""
    known = defaultdict(str, {k.lower(): v or "" for k, v in (headers or {}).items()})
    if "noai" in known["x-robots-tag"].lower():
        return "x_robots_noai"
    if known["tdm-reservation"].strip() == "1":
        return "tdm_reservation"
    if forbids_training(known["content-usage"]):
        return "content_usage"
    for tag in re.finditer(r"<meta\s[^>]*>", (page or "")[:HTML_CHARS], re.I):
        found = {m[1].lower(): m[3] for m in re.finditer(r"\b(name|http-equiv|content)\s*=\s*([\"'])([^\"']*)[\"']", tag[0], re.I)}
        who, what = (found.get("name") or found.get("http-equiv") or "").lower(), found.get("content", "").lower()
        if who == "tdm-reservation" and what.strip() == "1":
            return "tdm_reservation"
        if who in ("googlebot", "robots") and re.search(r"\bnoai\b", what):
            return "meta_noai"
    return None


class Registry:
    """Hosts (with their subdomains) and URL prefixes that asked to be left out."""

    def __init__(self, lines: Iterable[str]):
        entries = [e for e in (x.partition("#")[0].strip().lower() for x in lines) if e]
        bare = [re.sub(r"^.*?://", "", e) for e in entries]
        self.prefixes = tuple(e.removeprefix("www.") for e in bare if "/" in e)
        self.hosts = frozenset(e.removeprefix("www.") for e in bare if "/" not in e)

    def __contains__(self, url: str):
        labels = re.sub(r"^www\.", "", urlsplit(url).hostname or "").split(".")
        if any(".".join(labels[k:]) in self.hosts for k in range(len(labels))):
            return True
        return re.sub(r"^.*?://", "", url.lower()).removeprefix("www.").startswith(self.prefixes or ("\0",))


def in_registry(url: Column, lines: Iterable[str]) -> Column:
    """The registry as a column expression."""
    registry = Registry(lines)
    host = T.host_of(url)
    parents = F.transform(F.sequence(F.lit(0), F.regexp_count(host, F.lit(r"\."))), lambda i: F.call_function("substring_index", host, F.lit("."), -(i + 1)))
    hit = F.coalesce(F.arrays_overlap(parents, F.array(*map(F.lit, sorted(registry.hosts))).cast("array<string>")), F.lit(False))
    bare = F.regexp_replace(F.regexp_replace(F.lower(url), r"^.*?://", ""), r"^www\.", "")
    for prefix in sorted(registry.prefixes):
        hit = hit | bare.startswith(prefix)
    return hit


def check(url: str, robots: Robots | None, headers: dict | None = None, page: str | None = None, agent: str = DEFAULT_AGENT, training_agents: Iterable[str] = TRAINING_AGENTS, registry: Registry | None = None) -> str | None:
    """Why a page can't be used, or None. A training agent counts only where robots.txt names it."""
    if registry is not None and url in registry:
        return "opt_out_registry"
    if robots is not None:
        if not robots.allowed(url, agent):
            return "robots_disallow"
        if any(not robots.allowed(url, a, False) for a in training_agents if robots.of_agent(a, False)):
            return "ai_agent_blocked"
        if any(map(forbids_training, robots.signals(agent))):
            return "robots_content_signal"
    return page_opt_out(headers, page)


def policy(pages: DataFrame, robots: DataFrame, url: str = "url", page: str | None = "html", headers: str | None = None, agent: str = DEFAULT_AGENT, training_agents: Iterable[str] = TRAINING_AGENTS, registry_lines: Iterable[str] = ()) -> DataFrame:
    """pages with policy_reason and robots_unknown. robots: (origin, status, body), the last row of an origin in fetched order having won before (latest_robots). Spark broadcasts it only if small."""
    lines, agents = tuple(registry_lines), tuple(training_agents)

    @F.pandas_udf("string")
    def reason(urls: pd.Series, status: pd.Series, body: pd.Series, page: pd.Series, head: pd.Series) -> pd.Series:
        registry, parsed, out = Registry(lines), {}, []
        for u, s, b, p, h in zip(urls, status, body, page, head, strict=True):
            robots = None
            if s is not None and s == s:
                key = (int(s), b)
                if key not in parsed:
                    if len(parsed) > 1000:
                        parsed.clear()
                    parsed[key] = Robots.parse(b or "") if 200 <= s < 300 else Robots.of_status(int(s))
                robots = parsed[key]
            out.append(check(u or "", robots, dict(h) if h is not None else None, p, agent, agents, registry))
        return pd.Series(out, dtype=object)

    none = F.lit(None)
    known = robots.select(F.col("origin").alias("__o"), F.col("status").cast("double").alias("__s"), F.col("body").cast("string").alias("__b"))
    joined = pages.withColumn("__origin", T.origin_of(F.col(url))).join(known, F.col("__origin") == F.col("__o"), "left")
    found = reason(F.col(url), F.col("__s"), F.col("__b"), F.col(page) if page else none.cast("string"), F.col(headers) if headers else none.cast("map<string,string>"))
    return joined.withColumn("policy_reason", found).withColumn("robots_unknown", F.col("__s").isNull()).drop("__origin", "__o", "__s", "__b")


def latest_robots(rows: DataFrame, order: str) -> DataFrame:
    """The last (status, body) of each origin in `order`."""
    last = rows.groupBy(F.lower("origin").alias("origin")).agg(F.max_by(F.struct("status", "body"), order).alias("r"))
    return last.select("origin", "r.status", "r.body")


class RobotsCache:
    """fetch(url) gives (status, body) or raises OSError. robots.txt by origin, fetched again after `ttl` seconds. While a host fails its last good copy holds; without one everything is forbidden."""

    def __init__(self, fetch: Callable, ttl: float = 86_400, clock: Callable = time.time):
        self.fetch, self.ttl, self.clock, self.held = fetch, ttl, clock, {}

    def get(self, url: str) -> Robots:
        at = urlsplit(url)
        origin = f"{at.scheme}://{at.netloc}"
        since, last = self.held.get(origin, (None, None))
        if since is not None and self.clock() - since < self.ttl:
            return last
        try:
            status, body = self.fetch(f"{origin}/robots.txt")
        except OSError:
            status, body = 599, b""
            if last is None:
                return Robots.of_status(status)
        if status >= 500 and last is not None:
            return last
        found = Robots.parse(body) if status // 100 == 2 else Robots.of_status(status)
        self.held[origin] = self.clock(), found
        return found
