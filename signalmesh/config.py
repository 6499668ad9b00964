"""Theme configuration: data model, the shipped default catalogue, loading.

The configuration is small by construction (a file edited by people), so it
lives on the driver and is compiled into column expressions / a broadcastable
dimension table.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class ThemeDef:
    id: str
    label: str
    keywords: tuple[str, ...]
    category: str


@dataclass(frozen=True)
class ThemesConfig:
    version: int
    themes: tuple[ThemeDef, ...]
    stop_words: tuple[str, ...] = ()
    emerging_theme_min_frequency: int = 3

    @staticmethod
    def from_dict(raw: dict) -> "ThemesConfig":
        themes = raw.get("themes") if isinstance(raw, dict) else None
        if not isinstance(themes, list):
            raise ValueError('Invalid themes config: "themes" must be an array of theme definitions.')
        return ThemesConfig(
            version=int(raw.get("version", 0)),
            themes=tuple(
                ThemeDef(str(t["id"]), str(t.get("label", t["id"])), tuple(t.get("keywords") or ()),
                         str(t.get("category", "")))
                for t in themes
            ),
            stop_words=tuple(raw.get("stop_words") or ()),
            emerging_theme_min_frequency=int(raw.get("emerging_theme_min_frequency", 3)),
        )

    def to_dict(self) -> dict:
        return {
            "version": self.version,
            "themes": [
                {"id": t.id, "label": t.label, "keywords": list(t.keywords), "category": t.category}
                for t in self.themes
            ],
            "stop_words": list(self.stop_words),
            "emerging_theme_min_frequency": self.emerging_theme_min_frequency,
        }


THEME_SCHEMA = T.StructType([
    T.StructField("theme_idx", T.IntegerType(), False),
    T.StructField("theme_id", T.StringType(), False),
    T.StructField("label", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("keywords", T.ArrayType(T.StringType()), False),
])


def themes_frame(spark: SparkSession, cfg: ThemesConfig) -> DataFrame:
    """Dimension table ``themes(theme_idx, theme_id, label, category, keywords)``."""
    rows = [(i, t.id, t.label, t.category, list(t.keywords)) for i, t in enumerate(cfg.themes)]
    return spark.createDataFrame(rows, THEME_SCHEMA)


def load_themes_config(path: str | Path) -> ThemesConfig:
    """Read the JSON config file; re-read on every run so it stays hot-editable."""
    p = Path(path)
    try:
        raw = json.loads(p.read_text(encoding="utf-8"))
    except (OSError, ValueError) as exc:
        raise ValueError(
            f"Failed to load themes config ({p}): {exc}. The file must exist and contain valid JSON."
        ) from exc
    return ThemesConfig.from_dict(raw)


def read_themes_config(spark: SparkSession, path: str) -> ThemesConfig:
    """S1 through Spark's JSON reader (for configs kept on shared storage).

    The file is one multi-line JSON object; its size is that of a hand-edited
    config, so bringing the single row to the driver is bounded.
    """
    df = spark.read.option("multiLine", True).json(path)
    if "themes" not in df.columns or not isinstance(df.schema["themes"].dataType, T.ArrayType):
        raise ValueError('Invalid themes config: "themes" must be an array of theme definitions.')
    first = df.toJSON().first()
    if first is None:
        raise ValueError(f"Failed to load themes config ({path}): empty file")
    return ThemesConfig.from_dict(json.loads(first))


# The default theme catalogue (version, themes with keywords and
# categories, stop words, minimum emerging frequency), in file order.
DEFAULT_THEMES = ThemesConfig.from_dict({
    "version": 2,
    "themes": [
        {"id": "booking-scheduling", "label": "Booking & Scheduling",
         "keywords": ["booking", "bookings", "schedule", "scheduling", "appointment", "availability", "time slot",
                      "reschedule", "rescheduling", "recurring", "booking type", "booking types", "booking page",
                      "cancellation", "cancel booking", "no show", "buffer time", "date range"],
         "category": "core"},
        {"id": "billing-payment", "label": "Billing & Payment",
         "keywords": ["billing", "payment", "invoice", "charge", "refund", "subscription", "pricing", "upgrade",
                      "downgrade", "credit card", "receipt", "coupon", "discount", "stripe", "pay per"],
         "category": "billing"},
        {"id": "email-smtp", "label": "Email & Delivery",
         "keywords": ["smtp", "email delivery", "email sending", "campaign", "unsubscribe", "email template",
                      "sender", "deliverability", "confirmation email", "reminder email", "bounce", "spam",
                      "opt-in", "double opt"],
         "category": "communication"},
        {"id": "notifications", "label": "Notifications & Reminders",
         "keywords": ["notification", "notifications", "reminder", "reminders", "email notification",
                      "sms reminder", "alert", "notify", "push notification", "whatsapp"],
         "category": "communication"},
        {"id": "whitelabel-branding", "label": "Whitelabel & Branding",
         "keywords": ["whitelabel", "white label", "cname", "custom domain", "branding", "powered by",
                      "remove logo", "embed", "embedded", "logo", "brand", "custom url"],
         "category": "customization"},
        {"id": "account-licensing", "label": "Account & Licensing",
         "keywords": ["account", "license", "tier", "plan", "upgrade", "downgrade", "cancel account", "lifetime",
                      "agency plan", "individual plan", "free tier", "credits"],
         "category": "account"},
        {"id": "calendar-sync", "label": "Calendar Sync",
         "keywords": ["calendar sync", "google calendar", "outlook calendar", "ical", "calendar integration",
                      "sync calendar", "calendar connect", "google meet", "zoom", "teams meeting", "caldav",
                      "double booking"],
         "category": "integration"},
        {"id": "integrations", "label": "Integrations",
         "keywords": ["zapier", "pabbly", "make.com", "integration", "integrate", "crm", "hubspot", "google drive",
                      "connect", "third party", "workflow"],
         "category": "integration"},
        {"id": "api-webhooks", "label": "API & Webhooks",
         "keywords": ["api", "webhook", "webhooks", "api access", "api endpoint", "rest api", "api key",
                      "developer"],
         "category": "integration"},
        {"id": "templates-editor", "label": "Templates & Editor",
         "keywords": ["template", "templates", "editor", "wysiwyg", "document", "pdf", "form field",
                      "content block", "signature field", "reusable", "duplicate", "fields"],
         "category": "product"},
        {"id": "team-collaboration", "label": "Team & Collaboration",
         "keywords": ["team", "agency", "member", "collaborator", "workspace", "permission", "round robin",
                      "team member", "multi user", "shared", "staff access"],
         "category": "account"},
        {"id": "login-auth", "label": "Login & Auth",
         "keywords": ["login", "sign in", "sign up", "password", "authentication", "sso", "two factor", "2fa",
                      "reset password", "locked out", "cant login", "access denied", "change email"],
         "category": "auth"},
        {"id": "compliance-security", "label": "Compliance & Security",
         "keywords": ["gdpr", "hipaa", "compliance", "security", "pci", "data protection", "privacy", "dpa",
                      "encryption", "audit trail"],
         "category": "trust"},
        {"id": "customization", "label": "Customization",
         "keywords": ["customize", "customization", "custom field", "font", "style", "color", "css", "theme",
                      "design", "layout", "custom cta", "redirect url"],
         "category": "customization"},
        {"id": "mobile-app", "label": "Mobile App",
         "keywords": ["mobile app", "mobile version", "ios app", "android app", "mobile friendly", "phone app"],
         "category": "platform"},
        {"id": "performance", "label": "Performance & Bugs",
         "keywords": ["slow", "loading", "speed", "performance", "timeout", "lag", "page load", "crashes", "bug",
                      "error", "broken", "not working", "500 error"],
         "category": "reliability"},
    ],
    "stop_words": [
        "the", "a", "an", "is", "are", "was", "were", "be", "been", "being",
        "have", "has", "had", "do", "does", "did", "will", "would", "could",
        "should", "may", "might", "shall", "can", "need", "must",
        "to", "of", "in", "for", "on", "with", "at", "by", "from", "as",
        "into", "through", "during", "before", "after", "above", "below",
        "between", "out", "off", "over", "under", "again", "further", "then",
        "once", "here", "there", "when", "where", "why", "how", "all", "each",
        "every", "both", "few", "more", "most", "other", "some", "such", "no",
        "nor", "not", "only", "own", "same", "so", "than", "too", "very",
        "just", "because", "but", "and", "or", "if", "while", "about",
        "it", "its", "this", "that", "these", "those", "i", "me", "my",
        "we", "our", "you", "your", "he", "him", "his", "she", "her",
        "they", "them", "their", "what", "which", "who", "whom",
        "up", "also", "get", "got", "like", "want", "use", "using",
        "please", "thanks", "thank", "hi", "hello", "hey",
        "generated", "draft", "happy", "help", "glad", "able", "hope", "helps",
        "apologize", "inconvenience", "hesitate", "reach", "reaching",
        "understand", "frustrating", "completely", "fantastic", "news",
        "forward", "hearing", "bringing", "checked", "finds", "well",
        "sorry", "kind", "words", "clarify", "letting", "truly", "appreciate",
        "identified", "global", "reported", "redesigned", "potential",
        "collaboration", "sent", "regarding", "issue", "best", "regards",
        "dear", "sincerely", "warm", "great", "question", "looking",
    ],
    "emerging_theme_min_frequency": 3,
})

# The test catalogue used against the driver's tables
# (FIXTURES.md B3): label = category = id, default stop words, minimum 3.
FIXTURE_THEMES = ThemesConfig(
    version=2,
    themes=tuple(
        ThemeDef(tid, tid, tuple(kws), tid)
        for tid, kws in [
            ("licensing", ["license", "apache license"]),
            ("english_core", ["that", "from"]),
            ("german_core", ["nicht", "einen"]),
            ("french_core", ["que", "dans"]),
            ("spanish_core", ["para", "como"]),
            ("phrase", ["of the", "in the"]),
            ("rare", ["token"]),
            ("zero", ["zxqwv"]),
        ]
    ),
    stop_words=DEFAULT_THEMES.stop_words,
    emerging_theme_min_frequency=3,
)
