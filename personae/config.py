"""Settings of the enrichment model.

Everything here is data a user may replace: pass another ``Weights``, another
alias table or another list of ``Descriptors`` to the operators that take them, or
read them from JSON files with ``weights_from``, ``aliases_from``, ``descriptors_from``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, fields
from functools import cached_property

PIPELINE_VERSION = "1.0.0"

# --- fixed values: evidence strength per source -----------------------------


@dataclass(frozen=True)
class Weights:
    full_name: int = 100
    display_name: int = 98
    email: int = 95
    username: int = 60
    instagram: int = 80
    tiktok: int = 80
    facebook: int = 80
    youtube: int = 80
    generic_scrape: int = 55
    email_ambiguous_penalty: int = 15
    review_threshold: int = 70


DEFAULT_WEIGHTS = Weights()

# --- fixed values: header spellings per canonical field ----------------------

COLUMN_ALIASES: dict[str, list[str]] = {
    "fullName": ["full name", "name", "creator name", "full_name"],
    "username": ["username", "handle", "user name", "user_name"],
    "email": ["email", "email address", "e-mail", "contact email"],
    "profileUrl": [
        "profile url", "profile link", "url", "link", "profile_url",
        "instagram", "instagram url", "instagram handle", "ig",
        "tiktok", "tiktok url", "tiktok handle",
    ],
    "platform": ["platform", "channel", "network"],
}

# canonical field -> raw column of the creators table
RAW_COLUMNS: dict[str, str] = {
    "fullName": "raw_full_name",
    "username": "raw_username",
    "email": "raw_email",
    "profileUrl": "raw_profile_url",
    "platform": "raw_platform",
}

# --- fixed values: words that describe a person but do not name one ----------

DESCRIPTORS: list[str] = [
    "coach", "dr", "mrs", "mr", "ms", "miss", "mx", "ugc", "travel", "fitness",
    "pilates", "yoga", "wellness", "hairstylist", "stylist", "barber",
    "esthetician", "founder", "co-founder", "cofounder", "ceo", "cmo", "cto",
    "president", "trainer", "athlete", "creator", "content creator",
    "lifestyle creator", "influencer", "blogger", "vlogger", "author",
    "speaker", "entrepreneur", "model", "artist", "designer", "photographer",
    "musician", "podcaster", "host", "mom", "dad", "wife", "husband",
    "she/her", "he/him", "they/them",
]

# --- fixed values: enumerations ----------------------------------------------

PLATFORMS = ["instagram", "tiktok", "facebook", "youtube", "generic"]

# platform of a page -> candidate source it counts as
SOURCE_BY_PLATFORM = {
    "instagram": "instagram",
    "tiktok": "tiktok",
    "facebook": "facebook",
    "youtube": "youtube",
    "generic": "generic_scrape",
}

CANDIDATE_SOURCES = [
    "full_name", "email", "display_name", "username", "instagram", "tiktok",
    "facebook", "youtube", "generic_scrape",
]
CONFIDENCE_SOURCES = [*CANDIDATE_SOURCES, "manual_override"]
PROCESSING_STATUSES = [
    "cache_hit", "enriched", "partially_enriched", "needs_review", "failed",
]
REVIEW_STATUSES = ["pending", "approved", "ignored"]
IMPORT_STATUSES = ["uploaded", "mapped", "processing", "completed", "failed"]
FILE_TYPES = ["csv", "xlsx"]
KEY_TYPES = ["email", "username", "profile_url"]
LOG_STATUSES = ["success", "skipped", "failed"]
EXPORT_TYPES = ["quick", "full"]
FETCHED_VIA = ["static", "browser"]

# reviewer-facing field name -> column stem (resolved_<stem> / cache <stem>)
OVERRIDABLE_FIELDS: dict[str, str] = {
    "firstName": "first_name",
    "lastName": "last_name",
    "displayName": "display_name",
    "platform": "platform",
    "profileUrl": "profile_url",
    "email": "email",
    "socialHandle": "social_handle",
}

# --- fixed values: labels shown to reviewers -----------------------------------

EVIDENCE_LABELS: dict[str, str] = {
    "full_name": "Full Name",
    "email": "Email",
    "username": "Username",
    "display_name": "Display Name",
    "instagram": "Instagram",
    "tiktok": "TikTok",
    "facebook": "Facebook",
    "youtube": "YouTube",
    "generic_scrape": "Web Profile",
    "manual_override": "Manual Override",
}
IMPORT_STATUS_LABELS: dict[str, str] = {
    "uploaded": "Uploaded — mapping not confirmed",
    "mapped": "Mapped — ready to enrich",
    "processing": "Enriching…",
    "completed": "Ready for review",
    "failed": "Failed",
}
NEXT_ACTIONS: dict[str, str] = {
    "uploaded": "reupload",
    "mapped": "enrich",
    "processing": "wait",
    "completed": "review",
    "failed": "reupload",
}

PREVIEW_ROWS = 20
LIST_LIMIT = 50
MIN_USABLE_HTML = 2000
MIN_PREFIX = 5      # shortest first name accepted in front of a run-on handle
MIN_REMAINDER = 4   # shortest surname accepted behind it


# --- settings a user edits ----------------------------------------------------


@dataclass(frozen=True)
class Descriptors:
    """Words that describe a person, as patterns for the text functions.

    Words are matched literally, whatever characters they hold, the longest first.
    """

    words: Sequence[str]

    @cached_property
    def _longest_first(self) -> list[str]:
        return sorted({w.strip().lower() for w in self.words if w.strip()}, key=len, reverse=True)

    @cached_property
    def anywhere(self) -> str:
        """A descriptor that stands alone among ASCII words."""
        if not self.words:
            return "(?!)"
        some = "|".join(map(_literal, self._longest_first))
        return rf"(?i)(?<![A-Za-z0-9_])(?:{some})(?![A-Za-z0-9_])"

    @cached_property
    def glued(self) -> str:
        """Descriptors as they end a handle: their ASCII letters alone."""
        bare = ("".join(ch for ch in w if "a" <= ch <= "z") for w in self._longest_first)
        return "|".join(dict.fromkeys(b for b in bare if b)) or "(?!)"

    @cached_property
    def exact(self) -> list[str]:
        return self._longest_first


def _literal(word: str) -> str:
    return re.sub(r"([^A-Za-z0-9 ])", r"\\\1", word)


DEFAULT_DESCRIPTORS = Descriptors(tuple(DESCRIPTORS))


def weights_from(path: str) -> Weights:
    """Weights from a JSON object of their names; what it leaves out keeps its default."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    if unknown := sorted(set(given) - {f.name for f in fields(Weights)}):
        raise ValueError(f"no such weights: {unknown}")
    return Weights(**{k: int(v) for k, v in given.items()})


def aliases_from(path: str) -> dict[str, list[str]]:
    """Header spellings from a JSON object {canonical field: [spelling, ...]}."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    if unknown := sorted(set(given) - set(RAW_COLUMNS)):
        raise ValueError(f"no such fields: {unknown}")
    return given


def descriptors_from(path: str) -> Descriptors:
    """Descriptors from a JSON array of words."""
    with open(path, encoding="utf-8") as f:
        return Descriptors(tuple(json.load(f)))
