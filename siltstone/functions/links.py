"""Social links: their platform and handle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Part of a host, and its platform.
HOSTS = (("twitter.com", "twitter"), ("x.com", "twitter"), ("facebook.com", "facebook"), ("fb.com", "facebook"), ("instagram.com", "instagram"), ("youtube.com", "youtube"), ("youtu.be", "youtube"), ("tiktok.com", "tiktok"), ("linkedin.com", "linkedin"), ("bsky.app", "bluesky"), ("threads.net", "threads"), ("mastodon", "mastodon"))
#: Last parts of system pages, which are no handles.
IGNORED = ("home", "explore", "login", "signup", "signin", "about", "share", "sharer.php", "intent", "tr", "i")
PLATFORMS = tuple(dict.fromkeys(name for _, name in HOSTS))


def canonical_social(url: Column, hint: Column | None = None) -> Column:
    """A link as a struct of platform and handle; system pages and strangers are ``other``.

    ``hint`` names a platform for links whose host doesn't tell.
    """
    s = F.trim(url)
    s = F.when(s.rlike("^https?://"), s).otherwise(F.concat(F.lit("https://"), F.regexp_replace(s, "^/+", "")))
    host = lambda s: F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(s, r"^https?://([^/?#:]+)", 1)), r"^www\.", ""), r"^m\.", "")
    path = lambda s: F.regexp_extract(s, r"^https?://[^/?#]+([^?#]*)", 1)
    parts = _let(s, lambda s: F.struct(s.alias("url"), host(s).alias("host"), path(s).alias("path"), F.filter(F.split(path(s), "/"), lambda x: x != "").alias("segments")))
    told = _let(parts, lambda p: F.struct(p.alias("p"), _platform(p["host"], hint).alias("platform")))
    found = _let(told, lambda t: F.struct(t["platform"].alias("platform"), _handle(t["platform"], t["p"]).alias("handle")))

    def checked(f: Column) -> Column:
        other = f["platform"].isNull() | (F.trim(f["handle"]) == "") | F.lower(f["handle"]).isin(*IGNORED)
        return F.struct(F.when(other, "other").otherwise(f["platform"]).alias("platform"), F.when(~other, f["handle"]).alias("handle"))

    return _let(found, checked)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def _platform(host: Column, hint: Column | None) -> Column:
    platform = F.lit(None).cast("string")
    for part, name in reversed(HOSTS):
        platform = F.when(F.contains(host, F.lit(part)), name).otherwise(platform)
    if hint is None:
        return platform
    said = F.lower(hint)
    return F.coalesce(platform, F.when(said.isin(*PLATFORMS), said).when(said == "x.com", "twitter").when(F.contains(said, F.lit("mastodon")), "mastodon"))


def _handle(platform: Column, parts: Column) -> Column:
    segments, path = parts["segments"], parts["path"]
    last, first, second = (F.try_element_at(segments, F.lit(k)) for k in (-1, 1, 2))
    places = F.sequence(F.lit(1), F.greatest(F.size(segments), F.lit(1)))
    after = lambda *names: F.try_element_at(F.filter(F.transform(places, lambda i: F.when(F.try_element_at(segments, i).isin(*names), F.try_element_at(segments, i + 1))), lambda x: x.isNotNull()), F.lit(1))
    plain = F.regexp_replace(last, "^@", "")
    old_id = F.regexp_extract(parts["url"], r"[?&]id=([^&#]+)", 1)
    return (
        F.when(platform.isin("twitter", "instagram", "tiktok"), plain)
        .when((platform == "facebook") & path.rlike(r"profile\.php/*$") & (old_id != ""), F.concat(F.lit("id:"), old_id))
        .when(platform == "facebook", plain)
        .when(platform == "youtube", F.when(first.isin("channel", "user", "c") & second.isNotNull(), second).otherwise(last))
        .when(platform == "linkedin", F.coalesce(after("in", "company", "pub"), last))
        .when((platform == "mastodon") & first.startswith("@"), F.concat(first, F.lit("@"), parts["host"]))
        .when(platform == "bluesky", after("profile"))
        .when(platform == "threads", F.when(first.startswith("@"), F.regexp_replace(first, "^@", "")).otherwise(last))
    )
