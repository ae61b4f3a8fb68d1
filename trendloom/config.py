"""Weights, half-lives and thresholds, in groups that can be overridden and are checked."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace

# Source keys by weight; all others weigh DEFAULT_SOURCE_WEIGHT.
SOURCE_WEIGHT = {
    "yna": 2.5, "naver_news_ranking": 2.5, "bigkinds_issues": 2.5, "youtube": 2.5,
    "sbs": 2.2, "kbs": 2.2, "mbc": 2.2, "jtbc": 2.2, "chosun": 2.2, "joins": 2.2,
    "khan": 2.0, "mk": 2.0, "hani": 2.0, "donga": 2.0, "hankyung": 2.0, "ytn": 2.0, "etnews": 2.0,
    "daum_news": 1.8, "newsis": 1.8, "google_news_kr": 1.6, "ddanzi": 1.6, "kopis_boxoffice": 1.2,
    "yozm": 1.0, "dcinside": 1.0, "bobaedream": 1.0, "ruliweb": 1.0, "theqoo": 1.0, "instiz": 1.0, "natepann": 1.0, "ppomppu": 1.0,
    "ruliweb_hot": 0.9, "clien_jirum": 0.9, "quasarzone_deal": 0.9, "dcinside_hotdeal": 0.9,
}
DEFAULT_SOURCE_WEIGHT = 0.8
# Weights and half-lives (minutes) of community sources.
COMMUNITY_WEIGHT = {
    "theqoo": 1.4, "instiz": 1.35, "natepann": 1.3, "clien": 1.2, "dcinside": 1.15, "todayhumor": 1.1,
    "bobaedream": 1.0, "mlbpark": 1.0, "cook82": 1.0, "dogdrip": 1.0, "inven": 0.9,
    "humoruniv": 0.85, "ygosu": 0.85, "slrclub": 0.8, "etoland": 0.8,
}
COMMUNITY_HALF_LIFE = {
    "dcinside": 120, "dogdrip": 120, "theqoo": 150, "instiz": 150, "natepann": 150, "todayhumor": 150, "cook82": 150,
    "mlbpark": 180, "inven": 180, "ppomppu": 180, "clien": 200, "bobaedream": 200,
}
# Half-lives (minutes) of news sources and of channels.
NEWS_HALF_LIFE = {
    "yna": 180, "newsis": 180, "naver_news_ranking": 180, "ytn": 200, "daum_news": 200, "google_news_kr": 200,
    "sbs": 240, "kbs": 240, "mbc": 240, "jtbc": 240, "chosun": 300, "joins": 300, "donga": 300, "khan": 300, "hani": 300,
    "mk": 320, "hankyung": 320, "etnews": 320,
}
CHANNEL_HALF_LIFE = {"community": 150, "sns": 120, "news": 240, "specialized": 300, "video": 360}
# Tiers of news sources, and category weights.
SOURCE_TIER = {
    "yna": 1, "naver_news_ranking": 1, "bigkinds_issues": 1, "sbs": 2, "kbs": 2, "mbc": 2, "jtbc": 2, "chosun": 2, "joins": 2,
    "khan": 3, "mk": 3, "hani": 3, "donga": 3, "hankyung": 3, "ytn": 3, "etnews": 3,
    "daum_news": 4, "newsis": 4, "nate_news": 4, "zum_news": 4, "google_news_kr": 4,
}
CATEGORY_WEIGHT = {
    "alert": 1.25, "news": 1.2, "portal": 1.2, "trend": 1.15, "tech": 1.15, "community": 1.08,
    "video": 0.95, "entertainment": 1.05, "deals": 1.0, "government": 0.85, "newsletter": 0.8,
}
# Portal sources' multiplier and share passed on to siblings.
PORTAL = {
    "naver_news_ranking": (0.90, 0.75), "bigkinds_issues": (0.90, 0.70), "nate_news": (0.80, 0.60),
    "google_news_kr": (0.80, 0.60), "zum_news": (0.75, 0.55),
}
# Weights of comments and likes by channel.
COMMENT_LIKE_WEIGHT = {"community": (1.5, 2.0), "news": (0.5, 0.3), "video": (1.0, 1.2), "sns": (1.0, 1.5), "specialized": (1.0, 0.8)}


@dataclass(frozen=True)
class Scoring:
    """All thresholds of the scoring plans; ``overlay`` changes some of them."""

    half_life_default: float = 300.0
    news_half_life_default: float = 240.0
    community_half_life_default: float = 150.0
    community_weight_default: float = 1.0
    squash_gain: float = 0.75
    squash_width: float = 1.5
    squash_floor: float = 0.5
    score_offset: float = 2.5
    echo_cosine: float = 0.75
    echo_alpha: float = 0.25
    echo_cap: float = 1.0
    cluster_cosine: float = 0.78
    cluster_hours: float = 12.0
    cluster_size: int = 50
    cluster_sources: int = 2
    rank_top: int = 10
    rank_alpha: float = 0.25
    bigram_jaccard: float = 0.8
    word_jaccard: float = 0.65
    title_length: int = 8
    dedup_hours: float = 6.0
    topic_jaccard: float = 0.4
    burst: float = 2.0
    rate: float = 0.01
    news_signals: tuple = (0.32, 0.27, 0.18, 0.13, 0.10, 0.08)
    trend_base: tuple = (1.0, 1.15, 1.35, 1.6)
    trend_cap: float = 1.8
    source_weight: dict = field(default_factory=lambda: dict(SOURCE_WEIGHT))
    community_weight: dict = field(default_factory=lambda: dict(COMMUNITY_WEIGHT))

    def overlay(self, changes: str | dict) -> Scoring:
        """A copy with ``changes``, a dict or its JSON; unknown names and other types are errors.

        Numbers must be finite and not negative; dicts are merged key by key.
        """
        changes = json.loads(changes) if isinstance(changes, str) else changes
        known = {f.name: getattr(self, f.name) for f in fields(self)}
        clean = {}
        for name, value in changes.items():
            if name not in known:
                raise ValueError(f"unknown setting {name}")
            old = known[name]
            if isinstance(old, dict):
                if not isinstance(value, dict) or not all(isinstance(v, int | float) and v >= 0 for v in value.values()):
                    raise ValueError(f"{name} takes names and numbers")
                value = old | value
            elif isinstance(old, tuple):
                value = tuple(value)
                if len(value) != len(old):
                    raise ValueError(f"{name} takes {len(old)} numbers")
            elif isinstance(value, bool) or not isinstance(value, int | float) or not 0 <= value < float("inf"):
                raise ValueError(f"{name} takes a number from 0")
            clean[name] = value
        return replace(self, **clean)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


DEFAULT = Scoring()
