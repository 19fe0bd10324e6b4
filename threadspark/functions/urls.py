"""Thread addresses, page numbers and endpoint rules.  The forum host is always an argument."""

from pyspark.sql import Column, functions as F

from threadspark import fixed_values as fv
from threadspark.functions.text import trim


def _part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def thread_id_from_url(url: Column, host: str, path: str = "p") -> Column:
    """Digits after ``/<path>/`` of an https address on exactly this host, else null."""
    found = F.regexp_extract(
        F.coalesce(_part(url, "PATH"), F.lit("")), rf"^/{path}/([0-9]+)(?:/|$)", 1
    )
    on_host = (_part(url, "PROTOCOL") == "https") & (_part(url, "HOST") == host)
    return F.when(on_host & (found != ""), found)


def canonical_thread_url(url: Column, host: str, path: str = "p") -> Column:
    return F.concat(F.lit(f"https://{host}/{path}/"), thread_id_from_url(url, host, path))


def same_thread(thread_id: Column, thread_url: Column, url: Column, host: str, path: str = "p") -> Column:
    candidate = thread_id_from_url(url, host, path)
    own = F.coalesce(thread_id, thread_id_from_url(thread_url, host, path))
    return F.coalesce(candidate == own, F.lit(False))


def classify_url(thread_id: Column, thread_url: Column, url: Column, host: str, path: str = "p") -> Column:
    return (
        F.when(url.isNull(), F.lit("unknown"))
        .when(same_thread(thread_id, thread_url, url, host, path), F.lit("same"))
        .otherwise(F.lit("different"))
    )


def page_number_from_url(url: Column, parameter: str = "pn") -> Column:
    raw = F.try_parse_url(url, F.lit("QUERY"), F.lit(parameter))
    number = F.when(raw.rlike("^[0-9]{1,9}$"), raw.try_cast("int"))
    return F.when(number > 0, number).otherwise(F.lit(1))


def max_known_page(
    page_url: Column, link_urls: Column, explicit_total: Column, host: str, parameter: str = "pn", path: str = "p"
) -> Column:
    """Largest page number proven by the page itself, its pager links or a declared total."""
    own = thread_id_from_url(page_url, host, path)
    related = F.filter(
        link_urls,
        lambda link: own.isNull() | F.coalesce(thread_id_from_url(link, host, path) == own, F.lit(False)),
    )
    linked = F.array_max(F.transform(related, lambda link: page_number_from_url(link, parameter)))
    return F.greatest(page_number_from_url(page_url, parameter), linked, explicit_total)


def single_page_proven(max_page: Column, explicit_total: Column, pager_text: Column) -> Column:
    told = F.coalesce(pager_text.rlike(rf"共[{fv.SPACE}]*1[{fv.SPACE}]*页"), F.lit(False))
    return (max_page == 1) & (F.coalesce(explicit_total == 1, F.lit(False)) | told)


def normalize_provider(value: Column, endpoint: Column) -> Column:
    """The named provider when known, else the one of the endpoint's exact host, else the default."""
    host = F.lower(_part(trim(endpoint), "HOST"))
    by_host = F.lit(fv.DEFAULT_PROVIDER)
    for name, provider in fv.PROVIDER_HOSTS.items():
        by_host = F.when(host == name, F.lit(provider)).otherwise(by_host)
    known = [fv.DEFAULT_PROVIDER, *fv.PROVIDER_HOSTS.values()]
    return F.when(value.isin(known), value).otherwise(by_host)


def normalize_endpoint(endpoint: Column) -> Column:
    """Endpoint without fragment and trailing slash; scheme and host in lower case."""
    text = trim(endpoint)
    bare = F.regexp_replace(text, "#.*$", "")
    scheme, host = _part(text, "PROTOCOL"), _part(text, "HOST")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    authority = F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1), "^https?$", "")
    parsed = F.concat(F.lower(scheme), F.lit("://"), F.lower(authority), rest)
    return F.when(
        scheme.isNotNull() & host.isNotNull(), F.regexp_replace(parsed, "/$", "")
    ).otherwise(F.regexp_replace(text, "/+$", ""))


def endpoint_violations(endpoint: Column, forum_host: str) -> Column:
    """Reasons why an endpoint may not be stored or called."""
    text = trim(endpoint)
    scheme, host = F.lower(_part(text, "PROTOCOL")), F.lower(_part(text, "HOST"))
    keys = F.transform(
        F.regexp_extract_all(F.coalesce(_part(text, "QUERY"), F.lit("")), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1)),
        lambda key: F.regexp_replace(F.lower(key), "[^a-z0-9]", ""),
    )
    suffixes = "(?:" + "|".join(fv.CREDENTIAL_QUERY_SUFFIXES) + ")$"
    credential = F.exists(keys, lambda key: key.isin(fv.CREDENTIAL_QUERY_KEYS) | key.rlike(suffixes))
    local = host.isin("localhost", "127.0.0.1")
    checks = [
        (scheme.isNull() | host.isNull(), "not_a_url"),
        (_part(text, "USERINFO").isNotNull(), "credentials_in_address"),
        ((scheme == "http") & ~local, "plain_http"),
        (scheme.isNotNull() & ~scheme.isin("http", "https"), "scheme"),
        (host == forum_host, "forum_host"),
        (_part(text, "REF").isNotNull(), "fragment"),
        (credential, "credential_in_query"),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(code)) for test, code in checks]))
