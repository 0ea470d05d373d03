"""Canonical identity keys and platform of a profile URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from personae.functions.text import js_trim

_SPECIAL = r"(?:https?|ftp|wss?):[/\\]*"      # schemes that always have a host
_WITH_HOST = rf"(?is)^(?:{_SPECIAL}|[a-z][a-z0-9+.-]*://)(?:[^/@?#]*@)?"
_HOST = rf"{_WITH_HOST}([^/:?#\\]+)"
# host without www., path without trailing slashes; user, port, query and fragment go
_KEY = rf"{_WITH_HOST}(?:www\.)?([^/:?#\\]+)(?::[0-9]*)?([^?#]*?)/*(?:[?#].*)?$"
# the same with the query apart
_FETCH = rf"{_WITH_HOST}(?:www\.)?([^/:?#\\]+)(?::[0-9]*)?([^?#]*?)/*(\?[^#]*)?(?:#.*)?$"
# scheme:path without a host
_OPAQUE_KEY = r"(?s)^[a-z][a-z0-9+.-]*:(?!//)(?!(?:https?|ftp|wss?):)([^?#]*?)/*(?:[?#].*)?$"


def canonical_email(c: Column) -> Column:
    return F.lower(js_trim(c))


def canonical_username(c: Column) -> Column:
    return F.regexp_replace(F.lower(js_trim(c)), "^@", "")


def url_host(c: Column) -> Column:
    """Lower-case host without ``www.``, '' when the text is not an absolute URL."""
    return F.regexp_replace(F.lower(F.regexp_extract(js_trim(c), _HOST, 1)), r"^www\.", "")


def _percent_encoded(c: Column) -> Column:
    """Characters a URL path cannot hold as they are, as %XX of their UTF-8 bytes."""
    special = r"[^!-~]|[\"<>`{}]"
    encoded = F.array_join(
        F.transform(
            F.split(c, ""),
            lambda ch: F.when(ch == " ", "%20")
            .when(ch.rlike(special), F.url_encode(ch)).otherwise(ch),
        ),
        "",
    )
    return F.when(c.rlike(special), encoded).otherwise(c)


def canonical_profile_url(c: Column) -> Column:
    """Lower-case host and path; text that is no URL only loses trailing slashes."""
    key = F.regexp_replace(F.lower(_percent_encoded(js_trim(c))), _KEY, "$1$2")
    absolute = js_trim(c).rlike(_HOST)
    plain = F.regexp_replace(F.lower(js_trim(c)), _OPAQUE_KEY, "$1")
    return F.when(absolute, key).otherwise(F.regexp_replace(plain, "/+$", ""))


def fetch_key(c: Column) -> Column:
    """What a request for the URL would ask for: host, path with its case, query.

    Scheme, user, ``www.``, port, trailing slashes and fragment make no difference.
    """
    trimmed = js_trim(c)
    asked = F.concat(url_host(c), F.regexp_replace(trimmed, _FETCH, "$2$3"))
    return F.when(trimmed.rlike(_HOST), asked).otherwise(trimmed)


def platform_of_host(host: Column) -> Column:
    def within(domain: str) -> Column:
        return (host == domain) | host.endswith("." + domain)

    return (
        F.when(within("instagram.com"), "instagram")
        .when(within("tiktok.com"), "tiktok")
        .when(within("facebook.com") | within("fb.com"), "facebook")
        .when(within("youtube.com") | (host == "youtu.be"), "youtube")
        .otherwise("generic")
    )


def platform_of(url: Column) -> Column:
    return platform_of_host(F.coalesce(url_host(url), F.lit("")))


def identity_keys(email: Column, username: Column, profile_url: Column) -> Column:
    """array<struct<key_type,key_value>> of the keys that are present, in that order."""
    return key_array(
        canonical_email(email), canonical_username(username),
        canonical_profile_url(profile_url),
    )


def key_array(email: Column, username: Column, profile_url: Column) -> Column:
    """``identity_keys`` of already canonical values."""

    def entry(kind: str, value: Column) -> Column:
        return F.when(
            value != "",
            F.struct(F.lit(kind).alias("key_type"), value.alias("key_value")),
        )

    return F.array_compact(
        F.array(
            entry("email", email),
            entry("username", username),
            entry("profile_url", profile_url),
        )
    )
