"""Addresses and stable identifiers taken from them."""

from pyspark.sql import Column, functions as F

from listwatch.functions.text import first_text

# Shapes of a DOI and of one publisher's article code.
DOI = r"(?i)10\.\d{4,9}/[^\s\"'<>?#]+"
ARTICLE_CODE_DOI = r"(?i)^10\.54648/([a-z]+\d{6,})$"
ARTICLE_CODE = r"(?i)/([A-Z]{2,}\d{6,})$"


def without_query(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)[?#].*$", "")


def doi_of(explicit: Column, *places: Column) -> Column:
    """Explicit DOI, else the first one found in the other fields; lower case, no final dot."""
    found = [F.regexp_extract(F.coalesce(p, F.lit("")), "(" + DOI + ")", 1) for p in places]
    return F.lower(F.regexp_replace(F.trim(first_text(explicit, *found)), r"\.+$", ""))


def article_key(doi: Column, link: Column) -> Column:
    """Identifier of an article that does not change with its source."""
    trimmed = F.trim(F.coalesce(doi, F.lit("")))
    code = F.upper(F.regexp_extract(trimmed, ARTICLE_CODE_DOI, 1))
    link_code = F.upper(F.regexp_extract(F.coalesce(link, F.lit("")), ARTICLE_CODE, 1))
    return first_text(code, trimmed, link_code, link)


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def allowed_link(url: Column, hosts: Column) -> Column:
    """True for http(s) links whose host is listed or is a subdomain of a listed one."""
    host = host_of(url)
    listed = F.exists(hosts, lambda h: (host == h) | host.endswith(F.concat(F.lit("."), h)))
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & listed, F.lit(False))


def link_shape(href: Column) -> Column:
    """Shape of a link: digit runs become N, the query keeps only its sorted parameter names."""
    bare = F.regexp_replace(href, r"(?s)#.*$", "")
    path = F.regexp_replace(F.substring_index(bare, "?", 1), r"\d+", "N")
    query = F.when(bare.contains("?"), F.regexp_replace(bare, r"(?s)^[^?]*\?", "")).otherwise("")
    names = F.array_sort(F.array_distinct(F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.substring_index(p, "=", 1))))
    return F.when(query == "", path).otherwise(F.concat(path, F.lit("?"), F.array_join(names, "&")))


def absolute(href: Column, base: str) -> Column:
    """Resolve a root-relative address and encode blanks."""
    return F.replace(F.when(href.startswith("/"), F.concat(F.lit(base), href)).otherwise(href),
                     F.lit(" "), F.lit("%20"))
