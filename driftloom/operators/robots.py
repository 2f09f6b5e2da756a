"""Robots rules: parsing, the rules that bind an agent, and the test of URLs against them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.weburl import parse

RULES = "origin string, group_ord int, agents array<string>, kind string, pattern string, regex string, specificity int"


@dataclass
class Group:
    agents: list[str] = field(default_factory=list)
    rules: list[tuple[str, str]] = field(default_factory=list)


def parse_groups(body: str, strict: bool = False) -> tuple[list[Group], list[str]]:
    """Groups and raw sitemap values.

    Consecutive agents share a group; an agent after a rule opens the next.
    With `strict`, a line that is blank or only a comment also ends a group, so
    rules after it bind no agent.
    """
    groups, sitemaps, here = [], [], Group()
    for raw in re.split(r"\r?\n", body):
        line = raw.partition("#")[0].strip()
        name, colon, value = line.partition(":")
        name, value = name.strip().lower(), value.strip()
        opens = name == "user-agent" and colon and here.rules
        if opens or (strict and not line):
            groups.append(here)
            here = Group()
        if not colon:
            continue
        if name == "sitemap" and value:
            sitemaps.append(value)
        elif name == "user-agent":
            here.agents.append(value.lower())
        elif name in ("allow", "disallow") and value:
            here.rules.append((name, value))
    return [g for g in [*groups, here] if g.agents or g.rules], sitemaps


def rule_regex(pattern: str) -> str:
    """The rule as an expression anchored at the start: `*` is any run, a last `$` the end."""
    stem, end = (pattern[:-1], r"\z") if pattern.endswith("$") else (pattern, "")
    return "^" + ".*".join(re.sub(r"([^A-Za-z0-9_/])", r"\\\1", part) for part in stem.split("*")) + end


def specificity(pattern: str) -> int:
    return len(pattern.replace("*", "").replace("$", ""))


def agent_tokens(user_agent: str) -> set[str]:
    return set(re.findall(r"[a-z][a-z0-9_-]*", user_agent.lower()))


def agent_match(agents: list[str], user_agent: str) -> int:
    """Length of the longest agent name that the user agent carries; 0 for `*`, -1 for none."""
    tokens = agent_tokens(user_agent)
    return max((len(a) if a in tokens else 0 if a == "*" else -1 for a in agents), default=-1)


@dataclass
class Robots:
    """Rules that bind one agent at one origin."""

    rules: list[tuple[str, str]] = field(default_factory=list)
    sitemaps: list[str] = field(default_factory=list)

    def __post_init__(self):
        self._ready = [(kind, specificity(p), re.compile(rule_regex(p).replace(r"\z", r"\Z"))) for kind, p in self.rules]

    def allowed(self, url: str) -> bool:
        place = parse(url)
        if place is None:
            return False
        path = place.path + (f"?{place.query}" if place.query else "")
        best = {"allow": 0, "disallow": 0}
        for kind, weight, test in self._ready:
            if weight > best[kind] and test.match(path):
                best[kind] = weight
        return best["allow"] >= best["disallow"]


def robots_for(body: str, origin: str, user_agent: str, strict: bool = False) -> Robots:
    groups, sitemaps = parse_groups(body, strict)
    matches = [agent_match(g.agents, user_agent) for g in groups]
    top = max(matches, default=-1)
    rules = [r for g, m in zip(groups, matches, strict=True) if m == top >= 0 for r in g.rules]
    places = [parse(s, origin + "/") for s in sitemaps]
    return Robots(rules, [p.href for p in places if p])


def rules_table(files: DataFrame, strict: bool = False) -> DataFrame:
    """RULES of the rows (origin, body)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for origin, body in zip(batch.origin, batch.body, strict=True):
                for i, group in enumerate(parse_groups(body or "", strict)[0]):
                    rows += [(origin, i, group.agents, kind, p, rule_regex(p), specificity(p)) for kind, p in group.rules]
            yield pd.DataFrame(rows, columns=["origin", "group_ord", "agents", "kind", "pattern", "regex", "specificity"])

    return files.select("origin", "body").mapInPandas(read, RULES)


def binding_rules(rules: DataFrame, user_agent: str) -> DataFrame:
    """Rules of the groups that name the agent best, at each origin; equally good groups join."""
    tokens = F.array(*[F.lit(t) for t in sorted(agent_tokens(user_agent))]) if agent_tokens(user_agent) else F.array().cast("array<string>")
    match = F.array_max(F.transform("agents", lambda a: F.when(a == "*", 0).when(F.array_contains(tokens, a), F.length(a)).otherwise(-1)))
    rated = rules.withColumn("match", F.coalesce(match, F.lit(-1))).where("match >= 0")
    best = rated.groupBy("origin").agg(F.max("match").alias("match"))
    return rated.join(best, ["origin", "match"]).drop("match")


def robots_path(url: Column | str) -> Column:
    return F.concat(U.path(url), U.search(url))


def allowed_urls(urls: DataFrame, rules: DataFrame, user_agent: str) -> DataFrame:
    """The rows (url, ...) with `allowed`: the strongest allow against the strongest disallow.

    URLs meet only the rules of their own origin; each URL is tested once, and
    maxima fold before the shuffle.
    """
    bound = binding_rules(rules, user_agent).select("origin", "kind", "regex", "specificity")
    each = urls.select("url").distinct().withColumn("origin", U.origin("url"))
    hits = each.join(bound, "origin").where(F.rlike(robots_path("url"), F.col("regex")))
    weight = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("specificity"))), F.lit(0))
    verdict = hits.groupBy("url").agg((weight("allow") >= weight("disallow")).alias("allowed"))
    return urls.join(verdict, "url", "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))
