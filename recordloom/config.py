"""Weights, rules and dictionaries as data: plans are compiled from them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

# Scoring constants of the lost-and-found domain.
BANDS = (("VERY_HIGH", 95.0, 100.0, "AUTO_RECOMMEND"), ("HIGH", 85.0, 95.0, "HUMAN_REVIEW"), ("MEDIUM", 70.0, 85.0, "HUMAN_REVIEW"), ("LOW", 50.0, 70.0, "DO_NOT_RECOMMEND"), ("IGNORE", 0.0, 50.0, "DO_NOT_RECOMMEND"))
DIMENSIONS = ("category", "attribute", "location", "time", "distinctive", "semantic", "keyword", "image")
WEIGHTS = {"category": 0.1, "attribute": 0.25, "location": 0.15, "time": 0.1, "distinctive": 0.15, "semantic": 0.15, "keyword": 0.05, "image": 0.05}
TAU = {"location_tau_m": 500.0, "time_tau_hours": 24.0}
CATEGORY_WEIGHTS = {
    "smartphone": (0.08, 0.32, 0.13, 0.09, 0.16, 0.12, 0.05, 0.05),
    "wallet": (0.08, 0.3, 0.16, 0.1, 0.18, 0.11, 0.03, 0.04),
    "umbrella": (0.12, 0.26, 0.2, 0.14, 0.14, 0.09, 0.02, 0.03),
    "passport": (0.05, 0.45, 0.1, 0.07, 0.13, 0.1, 0.06, 0.04),
    "laptop": (0.08, 0.34, 0.13, 0.09, 0.16, 0.11, 0.05, 0.04),
    "jewelry": (0.08, 0.28, 0.14, 0.1, 0.22, 0.09, 0.03, 0.06),
}
CATEGORY_TAU = {"smartphone": (500.0, 24.0), "wallet": (400.0, 36.0), "umbrella": (300.0, 48.0), "passport": (1000.0, 72.0), "laptop": (500.0, 24.0), "jewelry": (300.0, 48.0)}
RELIABILITY = {"SERIAL": 1.0, "SYSTEM": 0.95, "VISION": 0.95, "OCR": 0.9, "ADMIN": 0.95, "STAFF": 0.95, "USER": 0.85, "AI": 0.7, "IMPORT": 0.8, "INFERRED": 0.7, "UNCERTAIN": 0.5, "EXPLICIT": 0.85}
ZONE_SCORES = {"SAME_LOCATION": 100.0, "SAME_FACILITY": 95.0, "NEARBY": 80.0, "SAME_AREA": 60.0}
PROFILES = {
    "default": {"brand": 4, "model": 5, "color": 2, "material": 2, "size": 1, "pattern": 3, "distinctive": 5, "serial_number": 10},
    "smartphone": {"imei": 10, "serial_number": 10, "model": 8, "brand": 6, "distinctive": 6, "case": 4, "case_color": 3, "color": 2, "size": 1, "carrier": 2, "lock_screen": 4},
    "wallet": {"contents": 8, "brand": 5, "pattern": 5, "color": 3, "material": 3, "wallet_type": 3, "card_count": 2, "distinctive": 6},
    "umbrella": {"pattern": 6, "handle": 5, "color": 4, "brand": 2, "length": 2, "umbrella_type": 3, "distinctive": 5},
    "passport": {"passport_number": 10, "nationality": 10, "holder_name": 10, "expiry_date": 6, "color": 0.5, "distinctive": 3},
    "laptop": {"serial_number": 10, "model": 8, "brand": 6, "distinctive": 6, "sticker": 6, "screen_size": 4, "color": 2, "os": 2},
    "bag": {"brand": 5, "color": 4, "material": 4, "bag_type": 4, "pattern": 4, "contents": 6, "distinctive": 6, "size": 2},
    "earbuds": {"serial_number": 10, "model": 7, "brand": 6, "case_condition": 4, "engraving": 8, "color": 3, "distinctive": 6},
    "keys": {"key_count": 5, "keychain": 8, "distinctive": 8, "color": 2, "brand": 2},
    "sake": {"brand": 6, "volume": 5, "sake_type": 6, "packaging": 4, "color": 1, "distinctive": 5},
    "water_bottle": {"brand": 5, "color": 5, "material": 4, "capacity": 4, "pattern": 4, "distinctive": 6},
}
ATTRIBUTE_ALIASES = {"手机壳": "case", "保护壳": "case", "手机套": "case", "颜色": "color", "品牌": "brand", "型号": "model", "材质": "material", "尺寸": "size", "图案": "pattern", "贴纸": "distinctive", "序列号": "serial_number", "sticker": "distinctive", "stickers": "distinctive", "distinctive_features": "distinctive", "case_type": "case", "protective_case": "case", "容量": "capacity", "包装": "packaging", "酒类": "sake_type", "花柄": "pattern", "模様": "pattern", "図案": "pattern"}
SEVERITY_PENALTY = {"CRITICAL": 70.0, "MAJOR": 40.0, "MINOR": 10.0}
COLOR_FAMILIES = {
    "black": ("black", "黑色", "黑", "黒", "ブラック", "dark gray", "dark grey", "深灰", "深灰色", "深色", "charcoal"),
    "white": ("white", "白色", "白", "ホワイト", "ivory", "off-white", "米白"),
    "gray": ("gray", "grey", "灰色", "グレー", "silver", "银色", "シルバー"),
    "blue": ("blue", "蓝色", "青", "ブルー", "navy", "藏青", "深蓝", "light blue", "浅蓝"),
    "red": ("red", "红色", "赤", "レッド", "crimson", "酒红", "wine"),
    "pink": ("pink", "粉色", "ピンク", "rose", "玫瑰金", "rose gold"),
    "green": ("green", "绿色", "緑", "グリーン", "olive", "墨绿"),
    "yellow": ("yellow", "黄色", "黄", "イエロー", "gold", "金色", "ゴールド"),
    "brown": ("brown", "棕色", "茶色", "ブラウン", "coffee", "咖啡色", "tan"),
    "purple": ("purple", "紫色", "パープル", "violet"),
    "orange": ("orange", "橙色", "オレンジ"),
    "transparent": ("transparent", "clear", "透明", "クリア", "无色"),
}
# Weights and constants of the exam-question domain.
EXAM_BANDS = (("DUPLICATE", 95.0, 100.0, "AUTO_MERGE"), ("LIKELY_DUPLICATE", 88.0, 95.0, "HUMAN_REVIEW"), ("SAME_TOPIC", 78.0, 88.0, "KEEP_BOTH"), ("RELATED", 60.0, 78.0, "KEEP_BOTH"), ("DISTINCT", 0.0, 60.0, "KEEP_BOTH"))
EXAM_WEIGHTS = {"stem": 0.26, "answer": 0.26, "services": 0.14, "kps": 0.14, "constraints": 0.15, "keyword": 0.05}
EXCLUSIVE_GOALS = (("scope_new", "scope_existing"), ("cost", "performance"), ("cost", "availability"), ("downtime", "cost"), ("migration_effort", "performance"), ("speed_to_implement", "cost"))
# Limits of the retrieval funnel.
FUNNEL = {"pool": 5000, "structured": 5000, "keyword": 500, "vector": 500, "fused": 1000, "scored": 200, "reranked": 20, "rrf_k": 60}


@dataclass(frozen=True)
class Rule:
    """A conflict rule: sides that both have ``attribute`` conflict where the comparator says so."""

    attribute: str
    severity: str
    comparator: str = "normalized"
    penalty: float | None = None
    reject: bool = False
    reason: str = ""

    @property
    def cost(self) -> float:
        return SEVERITY_PENALTY[self.severity] if self.penalty is None else self.penalty


# The conflict rules, in the order in which they are tried.
RULES = (
    Rule("imei", "CRITICAL", "exact", reject=True, reason="IMEI differs"),
    Rule("serial_number", "CRITICAL", "exact", reject=True, reason="serial number differs"),
    Rule("passport_number", "CRITICAL", "exact", reject=True, reason="document number differs"),
    Rule("model", "CRITICAL", "model", 70.0, reason="model differs"),
    Rule("brand", "MAJOR", "normalized", 45.0, reason="brand differs"),
    Rule("category", "MAJOR", "normalized", 50.0, reason="category differs"),
    Rule("nationality", "MAJOR", "normalized", 50.0, reason="nationality differs"),
    Rule("color", "MINOR", "color", 8.0, reason="color differs"),
    Rule("material", "MINOR", "normalized", 8.0, reason="material differs"),
    Rule("size", "MINOR", "normalized", 6.0, reason="size differs"),
    Rule("case", "MINOR", "normalized", 10.0, reason="case differs"),
)


@dataclass(frozen=True)
class DomainSpec:
    """What makes the scoring kernel a domain's: dimensions, weights, bands and caps."""

    dimensions: tuple[str, ...]
    weights: dict[str, float]
    bands: tuple[tuple[str, float, float, str], ...]
    critical_cap: str
    identity_cap: str
    identity_dimensions: tuple[str, ...]
    coverage_caps: tuple[tuple[float, str], ...]
    bonus_cap: float
    category_weights: dict[str, dict[str, float]] = field(default_factory=dict)


LOST_FOUND = DomainSpec(DIMENSIONS, WEIGHTS, BANDS, "LOW", "LOW", ("attribute", "distinctive", "category"), ((0.3, "LOW"), (0.55, "MEDIUM")), 10.0, {c: dict(zip(DIMENSIONS, w)) for c, w in CATEGORY_WEIGHTS.items()})
EXAM = DomainSpec(tuple(EXAM_WEIGHTS), EXAM_WEIGHTS, EXAM_BANDS, "SAME_TOPIC", "RELATED", ("answer", "services", "kps"), ((0.35, "RELATED"), (0.6, "SAME_TOPIC")), 0.0)


def load_json(path: str) -> dict[str, Any]:
    """A configuration file; keys that start with an underscore are notes."""
    return json.loads(Path(path).read_text(encoding="utf-8"))


class Watched:
    """A configuration file that is read again once it has changed (SRC4)."""

    def __init__(self, path: str, read=load_json):
        self.path, self.read = Path(path), read
        self.stamp: tuple[int, int] | None = None
        self.value: Any = None

    def __call__(self) -> Any:
        found = self.path.stat()
        if (found.st_mtime_ns, found.st_size) != self.stamp:
            self.value, self.stamp = self.read(str(self.path)), (found.st_mtime_ns, found.st_size)
        return self.value


def domain_from_json(path: str, base: DomainSpec = LOST_FOUND) -> DomainSpec:
    """A spec from a weights file (keys as in the built-in one); what the file leaves out stays as in ``base``."""
    raw = load_json(path)
    some = {}
    if "match_levels" in raw:
        some["bands"] = tuple((b["level"], float(b["min"]), float(b["max"]), b["action"]) for b in raw["match_levels"])
    for key, name in (("critical_conflict_max_level", "critical_cap"), ("no_identity_evidence_max_level", "identity_cap"), ("evidence_bonus_max", "bonus_cap")):
        if key in raw:
            some[name] = raw[key]
    if "identity_dimensions" in raw:
        some["identity_dimensions"] = tuple(raw["identity_dimensions"])
    if "evidence_coverage_caps" in raw:
        some["coverage_caps"] = tuple((float(c["below"]), c["max_level"]) for c in raw["evidence_coverage_caps"])
    if "default" in raw:
        some["weights"] = {d: float(raw["default"].get(d, 0)) for d in base.dimensions}
    if "categories" in raw:
        some["category_weights"] = {c: {d: float(w.get(d, 0)) for d in base.dimensions} for c, w in raw["categories"].items()}
    return replace(base, **some)


def rules_from_json(path: str) -> tuple[Rule, ...]:
    """Conflict rules from a file, in its order."""
    return tuple(Rule(r["attribute"], r["severity"], r.get("comparator", "normalized"), r.get("penalty"), bool(r.get("reject")), r.get("reason", "")) for r in load_json(path)["rules"])


#: A small dictionary to start with; load_json brings a domain's own one of the same shape.
SYNONYMS: dict[str, dict[str, tuple[str, ...]]] = {
    "category": {"smartphone": ("phone", "mobile phone", "iphone", "手机", "スマホ"), "wallet": ("purse", "钱包", "財布"), "umbrella": ("parasol", "雨伞", "傘"), "bag": ("backpack", "handbag", "鞄", "包"), "water_bottle": ("bottle", "flask", "水筒"), "sake": ("rice wine", "日本酒"), "keys": ("key", "keyring", "鍵")},
    "brand": {"Apple": ("apple", "苹果"), "Samsung": ("samsung",), "Sony": ("sony",)},
    "color": {"black": ("黑色", "黒"), "white": ("白色",), "blue": ("navy", "蓝色"), "red": ("crimson", "红色"), "green": ("olive",)},
    "material": {"leather": ("皮革",), "metal": ("steel",), "plastic": ()},
    "location": {"Central Station": ("main station",), "Airport": ("terminal",)},
}
