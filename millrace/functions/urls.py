"""Url expressions: canonical form, link resolution and eligibility, siblings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import java

#: Parameters that vary by visit, not by page.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "referrer", "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid")
#: What is not a page.
SKIP_EXTENSION = (
    r"(?i)\.(pdf|jpe?g|png|gif|webp|svg|ico|css|js|mjs|json|xml|rss|atom|zip|tar|gz|rar|7z|mp3|mp4|avi|mov|webm|woff2?|ttf|eot|exe|dmg|apk|csv|xlsx?|docx?|pptx?)$"
)
SKIP_SCHEME = r"(?i)^(mailto|tel|javascript|data|blob|ftp):"
WIKI_META = r"(?i)/(portal|help|special|talk|category|file|template|wikipedia|user|draft|mediawiki|module|book|timedtext|topic)[:%]"
UTILITY = (
    r"(?i)(^|/)(login|log-in|signin|sign-in|signup|sign-up|register|logout|account|cart|checkout|basket|search|admin|dashboard|preferences|settings|donate|privacy|terms|cookie-policy|legal|sitemap|rss|feed)(/|$)"
)
LANDING = r"(?i)(^|/)(index\.\w+|home|main_page|main-page|frontpage|front-page)$"
DISAMBIGUATION = r"(?i)\(disambiguation\)"
ORIGIN = r"^https?://[^/?#]+"


#: A segment that means its own folder, and one that means the folder above, also percent-encoded.
_DOT, _DOTS = r"(?i)\A(?:\.|%2e)\z", r"(?i)\A(?:\.|%2e){2}\z"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def origin(url: Column) -> Column:
    """Scheme and host in lower case, with a port that is not the scheme's own and without user info; empty for other schemes."""
    whole = F.lower(F.regexp_replace(F.regexp_extract(url, java("(?i)" + ORIGIN), 0), r"//[^/]*@", "//"))
    return F.regexp_replace(F.regexp_replace(whole, r"\A(http://[^/]+?):0*80\z|\A(https://[^/]+?):0*443\z", "$1$2"), r":\z", "")


def _encoded(x: Column) -> Column:
    """Blanks and characters beyond ASCII percent-encoded."""
    each = lambda v: F.transform(F.split(v, ""), lambda c: F.when(c.rlike(r"[^\x21-\x7E]"), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c))
    return bound(x, lambda v: F.when(v.rlike(r"[^\x21-\x7E]"), F.array_join(each(v), "")).otherwise(v))


def _without_dots(path: Column) -> Column:
    """A path that starts with a slash, its dot segments resolved; one at the end leaves a closing slash."""
    fold = lambda parts: F.aggregate(
        parts, F.expr("cast(array() as array<string>)"),
        lambda a, s: F.when(s.rlike(_DOT), a).when(s.rlike(_DOTS), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))),
    )
    closing = lambda p: F.when(p.rlike(r"(?i)/(?:\.|%2e){1,2}\z"), "/").otherwise("")
    resolved = lambda p: bound(fold(F.split(F.substring(p, 2, 1 << 30), "/")), lambda kept: F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(F.size(kept) > 0, closing(p)).otherwise("")))
    return bound(path, lambda p: F.when(p.rlike(r"(?i)/(?:\.|%2e){1,2}(?:/|\z)"), resolved(p)).otherwise(p))


def path(url: Column) -> Column:
    """The path of an absolute url with its dot segments resolved, "/" if it has none."""
    found = F.translate(F.regexp_extract(url, r"(?i)\Ahttps?:[/\\]{2}[^/\\?#]+([^?#]*)", 1), "\\", "/")
    return bound(found, lambda p: F.when(p == "", "/").otherwise(_encoded(_without_dots(p))))


def _parameters(query: Column) -> Column:
    """Parameters of a query in form encoding, sorted by name, later ones of a name after earlier ones, without tracking."""
    decoded = lambda x: F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p, i: F.struct(decoded(F.substring_index(p, "=", 1)).alias("k"), i.alias("i"), decoded(F.regexp_extract(p, "=(.*)", 1)).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~p["k"].isin(*TRACKING)))
    return F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")


def normalized(url: Column) -> Column:
    """Without fragment and tracking parameters, other parameters by name, one closing slash dropped unless the path is "/". Null for what is no http url."""
    query = bound(_parameters(F.regexp_extract(url, r"\A[^?#]*\?([^#]*)", 1)), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    joined = lambda site, p: bound(F.concat(site, p, query), lambda w: F.when(F.endswith(w, F.lit("/")) & (p != "/"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))
    return bound(origin(url), lambda site: F.when(site != "", bound(path(url), lambda p: joined(site, p))))


def absolute(href: Column, current: Column) -> Column:
    """The href against the current url: absolute, protocol- or root-relative, query, or relative to its folder; dot segments are resolved in all of them."""
    plain = F.regexp_replace(href, r"[\t\r\n]", "")
    rest = lambda h: F.regexp_extract(h, r"\A[^?#]*(.*)", 1)
    local = lambda head: F.when(head == "", path(current)).when(head.startswith("/"), head).otherwise(F.concat(F.regexp_extract(path(current), r"\A.*/", 0), head))
    whole = lambda head: F.when(head.rlike(r"(?i)\Ahttps?:"), head).when(head.startswith("//"), F.concat(F.regexp_extract(current, r"\A[A-Za-z]+:", 0), head))
    joined = lambda head: bound(whole(head), lambda w: F.when(w.isNotNull(), F.concat(origin(w), path(w))).otherwise(F.concat(origin(current), _encoded(_without_dots(local(head))))))
    other = lambda h: h.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:") & ~h.rlike(r"(?i)\Ahttps?:")
    return bound(plain, lambda h: F.when(other(h), h).otherwise(F.concat(joined(F.translate(F.regexp_extract(h, r"\A[^?#]*", 0), "\\", "/")), rest(h))))


def eligible(href: Column, current: Column, start_path: Column | None = None) -> Column:
    """The canonical target of a link that a crawl may follow from ``current``, else null: same origin, a page, no site machinery; the start path always passes."""
    trimmed = F.trim(href)
    bad = (trimmed == "") | trimmed.startswith("#") | trimmed.rlike(java(SKIP_SCHEME))

    def judged(url: Column, p: Column) -> Column:
        decoded = F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p)
        machinery = p.rlike(java(WIKI_META)) | p.rlike(java(UTILITY)) | (p == "/") | p.rlike(java(LANDING)) | decoded.rlike(java(DISAMBIGUATION))
        start = F.coalesce(p == start_path, F.lit(False)) if start_path is not None else F.lit(False)
        return F.when(bound(origin(url), lambda site: (site != "") & (site == origin(current))) & ~p.rlike(java(SKIP_EXTENSION)) & (start | ~machinery), normalized(url))

    return F.when(~bad, bound(absolute(trimmed, current), lambda url: bound(path(url), lambda p: judged(url, p))))


def is_sibling(url: Column, start_path: Column) -> Column:
    """Whether a url lies in the start path's folder, unless that is the root."""
    folder = F.regexp_extract(start_path, r"\A.*/", 0)
    return F.coalesce((F.length(folder) > 1) & path(url).startswith(folder), F.lit(False))


def parsed_input(text: Column) -> Column:
    """A user's url: https:// when schemeless, http(s) only, one closing slash dropped; null if it is none."""
    t = F.trim(text)
    full = F.when(t.rlike(r"(?i)\Ahttps?://"), t).when(t.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), None).otherwise(F.concat(F.lit("https://"), t))
    return F.when(full.rlike(r"(?i)\Ahttps?://[^/?#\s]+"), F.regexp_replace(full, r"/\z", ""))


def is_disambiguation(title: Column, text: Column) -> Column:
    """Whether a page only lists meanings: by title, by its footer, or short with "may refer to" near its start."""
    opening = F.substring(text, 1, 400).rlike(java(r"(?i)\bmay (?:refer|also refer) to\b")) & (F.length(text) < 4000)
    footer = text.rlike(r"(?i)this disambiguation page lists articles|topics referred to by the same term")
    return F.coalesce(title.rlike(java(DISAMBIGUATION)), F.lit(False)) | F.coalesce(footer | opening, F.lit(False))
