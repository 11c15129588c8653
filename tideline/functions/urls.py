"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: query parameters that only track
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "yclid", "ref"]
# fixed values: hosts of videos, and the kinds of paths that hold an id
VIDEO_HOSTS = ["youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com", "youtu.be", "www.youtube-nocookie.com", "youtube-nocookie.com"]
# fixed values: first parts of paths that are no owner of a repository or model
NO_OWNER = "about apps collections contact customer-stories enterprise events explore features login marketplace orgs pricing readme resources security settings signup site solutions sponsors team topics trending".split()
NO_MODEL = "blog docs join learn login models organizations papers posts pricing settings tasks".split()
# fixed values: link kinds, the most useful first, and hosts that are never official sites
KINDS = ["repo", "model", "dataset", "demo", "official", "store", "paper"]
NOT_OFFICIAL = "t.me telegram.me twitter.com x.com facebook.com instagram.com vk.com youtube.com youtu.be reddit.com news.google.com wikipedia.org linkedin.com tiktok.com discord.gg discord.com".split()
OFFICIAL = r"официальн\w*\s+(?:сайт|страниц|блог|анонс)|сайт\w*\s+(?:проекта|компании|разработчик)|official\s+(?:site|website|page|blog|announcement)|project\s+page|homepage"
# fixed values: labels before a country's that belong to the registered name
SECOND_LEVEL = ["co", "com", "org", "net", "gov", "ac", "edu"]
# fixed values: search locales by language
LOCALES = {"de": ("DE", "de"), "en": ("US", "en"), "es": ("ES", "es"), "fr": ("FR", "fr"), "it": ("IT", "it"), "ja": ("JP", "ja"), "pt": ("BR", "pt-419"), "ru": ("RU", "ru"), "uk": ("UA", "uk")}
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column | str) -> Column:
    return F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def encoded(text: Column) -> Column:
    """A form value with percent signs, spaces as +."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalized_url(url: Column | str) -> Column:
    """Lower scheme and host, no trailing slash (an empty path is /), parameters encoded again without the tracking ones, no fragment."""
    u = F.trim(_c(url))
    scheme, place, p, query = (F.regexp_extract(u, _PARTS, g) for g in (1, 2, 3, 4))
    p = F.regexp_replace(p, "/+$", "")
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.struct(plain(F.substring_index(x, "=", 1)).alias("k"), plain(F.when(F.contains(x, F.lit("=")), F.regexp_extract(x, "(?s)=(.*)$", 1)).otherwise("")).alias("v")))
    kept = F.transform(F.filter(pairs, lambda x: ~F.lower(x["k"]).isin(TRACKING)), lambda x: F.concat(encoded(x["k"]), F.lit("="), encoded(x["v"])))
    return F.concat(
        F.when(scheme != "", F.concat(F.lower(scheme), F.lit(":"))).otherwise(""), F.when(place != "", F.concat(F.lit("//"), F.lower(place))).otherwise(""),
        F.when(p == "", "/").otherwise(p), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""),
    )


def steps(url: Column | str) -> Column:
    """The parts of a path that are not empty."""
    return F.filter(F.split(path(url), "/"), lambda x: x != "")


def site(url: Column | str) -> Column:
    """The registered name of the host: its last two labels, or three where the last but one is of a registry."""
    labels = F.split(host(url), r"\.")
    n = F.when((F.size(labels) >= 3) & F.element_at(labels, F.greatest(-F.size(labels), F.lit(-2))).isin(SECOND_LEVEL), 3).otherwise(2)
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")


def brand(url: Column | str) -> Column:
    return F.substring_index(site(url), ".", 1)


def parameter(url: Column | str, name: str) -> Column:
    """The first value of a query parameter; empty if there is none."""
    return F.regexp_extract(_c(url), rf"[?&]{name}=([^&#]*)", 1)


def video_id(url: Column | str) -> Column:
    """The 11 signs that name a video on one of its hosts; empty if there are none."""
    u, s = F.trim(_c(url)), steps(F.trim(_c(url)))
    first = F.coalesce(F.get(s, F.lit(0)), F.lit(""))
    found = F.when(host(u) == "youtu.be", first).when(first == "watch", parameter(u, "v")).when(first.isin("shorts", "embed", "live", "v"), F.get(s, F.lit(1)))
    return F.when(host(u).isin(VIDEO_HOSTS) & found.rlike("^[A-Za-z0-9_-]{11}$"), found).otherwise("")


def video_source(value: Column | str) -> Column:
    """kind and value of what names a source of videos: channel, handle, playlist or search; null for a link to anything else."""
    v = F.trim(_c(value))
    u = F.when(F.contains(v, F.lit("://")), v).otherwise(F.concat(F.lit("https://"), v))
    s = steps(u)
    first, second = F.coalesce(F.get(s, F.lit(0)), F.lit("")), F.coalesce(F.get(s, F.lit(1)), F.lit(""))
    of = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("value"))
    channel = "^UC[A-Za-z0-9_-]{22}$"
    return (
        F.when(v.rlike(channel), of("channel", v))
        .when(v.rlike("^@[A-Za-z0-9._-]{3,100}$"), of("handle", v))
        .when(~host(u).isin(VIDEO_HOSTS) | F.contains(v, F.lit(" ")), of("search", v))
        .when(parameter(u, "list") != "", of("playlist", parameter(u, "list")))
        .when((first == "channel") & second.rlike(channel), of("channel", second))
        .when(first.startswith("@"), of("handle", first))
        .when(first.isin("c", "user") & (second != ""), of("handle", F.concat(first, F.lit("/"), second)))
    )


def channel_name(value: Column | str) -> Column:
    """A channel's bare name from a link, a handle or the name itself."""
    return F.regexp_replace(F.regexp_replace(F.trim(_c(value)), r"^(?:https?://)?t\.me/(?:s/)?", ""), r"^@|[/?].*$", "")


def subreddit(value: Column | str) -> Column:
    return F.regexp_extract(_c(value), r"^(?:https?://(?:www\.|old\.)?reddit\.com)?/?(?:r/)?([A-Za-z0-9_]{2,21})/?$", 1)


def link(url: Column | str, anchor: Column | None = None, own: Column | None = None) -> Column:
    """url, kind and label of a link that is of use to readers, in its shortest form; null for others.

    An official site is told by its anchor; own is the host of the page itself.
    """
    u, s = _c(url), steps(url)
    h = F.regexp_replace(host(u), r"^www\.", "")
    n, at = F.size(s), lambda i: F.coalesce(F.get(s, F.lit(i)), F.lit(""))
    of = lambda kind, shown, label: F.struct(shown.alias("url"), F.lit(kind).alias("kind"), label.alias("label"))
    whole = lambda k: F.concat(F.lit("https://"), h, F.lit("/"), F.array_join(F.slice(s, 1, k), "/"))
    repo, paper = F.regexp_replace(at(1), r"\.git$", ""), F.regexp_replace(at(1), r"\.pdf$", "")
    hub, apple = h == "huggingface.co", h == "apps.apple.com"
    official = F.lit(False)
    if anchor is not None:
        foreign = ~F.exists(F.array(*map(F.lit, NOT_OFFICIAL)), lambda d: (h == d) | h.endswith(F.concat(F.lit("."), d)))
        official = F.coalesce(anchor.rlike(f"(?iuU){OFFICIAL}"), F.lit(False)) & (h != F.coalesce(own if own is not None else F.lit(""), F.lit(""))) & foreign
    return F.when(u.rlike("^https?://") & (h != ""),
        F.when(h.isin("github.com", "gitlab.com") & (n >= 2) & ~F.lower(at(0)).isin(NO_OWNER), of("repo", F.concat(F.lit("https://"), h, F.lit("/"), at(0), F.lit("/"), repo), repo))
        .when(hub & (n >= 3) & (at(0) == "datasets"), of("dataset", whole(3), at(2)))
        .when(hub & (n >= 3) & (at(0) == "spaces"), of("demo", whole(3), at(2)))
        .when(hub & (n >= 2) & ~at(0).isin([*NO_MODEL, "datasets", "spaces"]), of("model", whole(2), at(1)))
        .when(~hub & (h == "arxiv.org") & (n >= 2) & at(0).isin("abs", "pdf"), of("paper", F.concat(F.lit("https://arxiv.org/abs/"), paper), F.lit("arXiv")))
        .when((h == "store.steampowered.com") & (n >= 2) & (at(0) == "app"), of("store", whole(2), F.lit("Steam")))
        .when(apple | ((h == "play.google.com") & (at(0) == "store") & (at(1) == "apps")), of("store", u, F.when(apple, "App Store").otherwise("Google Play")))
        .when(~hub & (n >= 0) & official, of("official", u, h)))


def link_kind(url: Column | str) -> Column:
    return link(url)["kind"]


def merged_links(own: Column, links: Column, most: int = 5) -> Column:
    """An item's own link, if it is one, then those of its text, each address once."""
    both = F.concat(F.filter(F.array(own), lambda x: x.isNotNull()), links)
    known = F.transform(both, lambda x: x["url"])
    return F.slice(F.filter(both, lambda x, i: F.array_position(known, x["url"]) == i + 1), 1, most)


def best_link(links: Column) -> Column:
    """The most useful link; of one kind the first."""
    order = F.array(*map(F.lit, KINDS))
    ranked = F.transform(links, lambda x, i: F.struct(F.array_position(order, x["kind"]).alias("r"), i.alias("i"), x.alias("x")))
    return F.array_min(F.filter(ranked, lambda x: x["r"] > 0))["x"]


def news_search(query: Column | str, language: Column | str) -> Column:
    """The address of a news search in a language's own edition."""
    code = F.substring_index(F.lower(F.coalesce(_c(language), F.lit("ru"))), "-", 1)
    pick = lambda i, other: F.coalesce(F.create_map(*[F.lit(x) for k, v in LOCALES.items() for x in (k, v[i])])[code], other)
    country, hl = pick(0, F.lit("US")), pick(1, F.when(F.length(code) == 2, code).otherwise("en"))
    return F.concat(F.lit("https://news.google.com/rss/search?q="), encoded(F.trim(_c(query))), F.lit("&hl="), hl, F.lit("&gl="), country, F.lit("&ceid="), country, F.lit("%3A"), hl)


def news_address(identifier: Column | str) -> Column:
    """The address that the old form of a news link's id holds; null if there is none."""
    i = F.translate(_c(identifier), "-_", "+/")
    raw = F.unbase64(F.concat(i, F.repeat(F.lit("="), F.pmod(-F.length(i), F.lit(4)))))
    found = F.regexp_extract(F.decode(raw, "ISO-8859-1"), r"https?://[!-~]+", 0)
    return F.when(found != "", found)


def image_key(url: Column | str) -> Column:
    """A picture's name without host, size and format; the address where nothing is left."""
    name = F.lower(F.substring_index(F.substring_index(path(url), "/", -1), ".", 1))
    key = F.regexp_replace(name, r"[-_@](?:\d{2,5}x\d{2,5}|\d{2,5}w|\d(?:\.\d)?x)$", "")
    return F.when(key != "", key).otherwise(_c(url))


def blocked(url: Column | str, domains: list[str]) -> Column:
    """Whether a host is one of domains or below one."""
    h = host(url)
    return F.exists(F.array(*[F.lit(d) for d in domains]), lambda d: (h == d) | h.endswith(F.concat(F.lit("."), d)))
