"""robots.txt rules."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import quote, unquote, urlsplit


@dataclass
class Group:
    agents: list[str] = field(default_factory=list)
    rules: list[tuple[bool, str]] = field(default_factory=list)
    delay: float | None = None


@dataclass
class Robots:
    """Parsed rules of one origin; without text everything is allowed."""

    groups: list[Group]
    sitemaps: list[str]

    def _for(self, agent: str) -> list[Group]:
        name = agent.split("/")[0].strip().lower()
        named = [g for g in self.groups if any(a != "*" and a in name for a in g.agents)]
        return named or [g for g in self.groups if "*" in g.agents]

    def allowed(self, url: str, agent: str) -> bool:
        """The longest matching rule decides; Allow wins a tie; no rule allows."""
        split = urlsplit(url)
        path = _escaped(split.path or "/") + (f"?{split.query}" if split.query else "")
        found = [(len(p), allow) for g in self._for(agent) for allow, p in g.rules if _matches(p, path)]
        return max(found, default=(0, True))[1]

    def delay(self, agent: str) -> float | None:
        return next((g.delay for g in self._for(agent) if g.delay is not None), None)


def _escaped(path: str) -> str:
    return quote(unquote(path), safe="/*$!'()+,-.:;=@_~&")


def _matches(pattern: str, path: str) -> bool:
    end = pattern.endswith("$")
    body = ".*".join(re.escape(p) for p in pattern.removesuffix("$").split("*"))
    return re.match(body + ("$" if end else ""), path) is not None


def parse_robots(text: str | None) -> Robots:
    """Lines of ``field: value``; what is no such line is passed over."""
    out, naming = Robots([], []), False
    for line in (text or "").splitlines():
        name, mark, value = line.split("#")[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not mark:
            continue
        if name == "user-agent":
            if not naming:
                out.groups.append(Group())
            out.groups[-1].agents.append(value.split("/")[0].lower())
            naming = True
        elif name == "sitemap":
            out.sitemaps.append(line.split(":", 1)[1].strip())
        elif name in ("allow", "disallow", "crawl-delay"):
            naming = False
            if not out.groups:
                continue
            if name == "crawl-delay":
                try:
                    out.groups[-1].delay = float(value)
                except ValueError:
                    pass
            elif value:
                out.groups[-1].rules.append((name == "allow", _escaped(value)))
    return out
