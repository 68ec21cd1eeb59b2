"""Configuration of the engine: frozen values with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

MONTH_DAYS = 30.44
#: Months that stand for an unknown date.
UNKNOWN_MONTHS = 36.0


@dataclass(frozen=True)
class BandConfig:
    """Bands from the highest down, with their least percent; hysteresis in points; the other scoring knobs."""

    bands: tuple[tuple[str, float], ...] = (("leader", 80.0), ("contender", 50.0), ("candidate", 20.0), ("unverified", 0.0))
    hysteresis: float = 5.0
    dead_code_months: float = 24.0
    dead_product_months: float = 12.0
    dead_forum_weeks: float = 8.0
    halflife_code: float = 6.0
    halflife_forum: float = 3.0
    halflife_citation: float = 24.0
    winsor: tuple[float, float] = (1.0, 99.0)
    w_usage: float = 0.5
    w_recency: float = 0.3
    w_network: float = 0.2
    top_k: int = 20

    def __post_init__(self):
        if len(self.bands) != 4:
            raise ValueError("exactly four bands are needed")


@dataclass(frozen=True)
class EntityConfig:
    auto: float = 0.92
    gray: float = 0.70


@dataclass(frozen=True)
class DiscoveryConfig:
    max_items: int = 30
    max_comments: int = 10
    max_chars: int = 1500
    rate_per_minute: float = 30.0


@dataclass(frozen=True)
class SnapshotConfig:
    active_days: int = 7
    stable_days: int = 60
    active_window_days: float = 30.0


@dataclass(frozen=True)
class TextConfig:
    top_k: int = 30
    min_cosine: float = 0.35


@dataclass(frozen=True)
class ProfilerConfig:
    ttl_days: float = 90.0
    rrf_k: int = 60
    fan_out: int = 5


@dataclass(frozen=True)
class CapabilityConfig:
    """Headings to keep and to drop, in lower case, and the words of the fallback."""

    keep: tuple[str, ...] = ("features", "capabilities", "architecture", "limitations", "comparison", "benchmarks")
    drop: tuple[str, ...] = ("installation", "quickstart", "license", "contributing", "sponsors", "badges")
    fallback_words: int = 500


@dataclass(frozen=True)
class Engine:
    band: BandConfig = field(default_factory=BandConfig)
    entity: EntityConfig = field(default_factory=EntityConfig)
    discovery: DiscoveryConfig = field(default_factory=DiscoveryConfig)
    snapshot: SnapshotConfig = field(default_factory=SnapshotConfig)
    text: TextConfig = field(default_factory=TextConfig)
    profiler: ProfilerConfig = field(default_factory=ProfilerConfig)
    capability: CapabilityConfig = field(default_factory=CapabilityConfig)


#: Least sample size by domain.
DOMAIN_SAMPLE = {"web-frameworks": 50, "ai-ml": 50, "databases": 40, "devsecops": 30, "compilers": 30, "data-engineering": 40, "cloud-native": 40}
DEFAULT_SAMPLE = 30
#: Words that name no competitor.
STOP_WORDS = (
    "a an the and or vs versus to from for in on at by with about is are was were be been solid alternative alternatives "
    "migrating leaving switch switching replace replacing replacement better than comparison compare compared show hn ask why we "
    "left not how what which my our side project weekly thread topic using use uses good bad new over into out of it its up shows any some"
).split()
#: Families of complaint patterns, searched without regard to case.
PATTERN_FAMILIES = {
    "doesnt_work": (r"doesn'?t\s+work", r"not\s+working", r"fail(ed|s)?"),
    "broke_after": (r"broke\s+after", r"broken\s+by", r"break(s)?\s+after"),
    "tried_docs": (r"tried\s+(the\s+docs|that|everything)", r"followed\s+the\s+(guide|docs)"),
    "regression": (r"regression", r"degraded\s+in"),
    "crash": (r"crash(ed|es|ing)?", r"panic(ked)?"),
}
#: Fixed value: the default pattern of tools in the proxy golden set.
PROXY_TOOLS = r"(?i)\b(yt-?dlp|streamlink|youtube-?dl)\b"
