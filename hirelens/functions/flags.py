"""C7 job key, C8/C9 intern flags, C10 non-IT flag, C11 whitelist, C16 labels, S7/S8."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelens import dims
from hirelens.functions.text import any_substring, ustrip


def _nz(c: Column) -> Column:
    return F.when(c.isNotNull() & (c != ""), c)


def make_job_key(job_key: Column, url: Column, title: Column, company: Column,
                 city: Column) -> Column:
    """Official id, else URL, else 'h'+md5(title|company|city); >128 chars -> 'h'+md5(key).

    Missing parts of the hash base print as ``None`` (as a Python f-string would).
    """
    base = F.concat_ws("|", *[F.coalesce(c, F.lit("None")) for c in (title, company, city)])
    key = F.coalesce(_nz(job_key), _nz(url), F.concat(F.lit("h"), F.md5(base)))
    return F.when(F.char_length(key) > dims.JOB_KEY_MAX,
                  F.concat(F.lit("h"), F.md5(key))).otherwise(key)


def intern_flag(title: Column, url: Column | None = None) -> Column:
    """C8 (collector): intern keyword in title, or the direct-hire URL marker."""
    hit = F.coalesce(any_substring(title, dims.INTERN_KWS), F.lit(False))
    if url is not None:
        hit = hit | F.coalesce(F.instr(url, dims.INTERN_URL_MARK) > 0, F.lit(False))
    return hit


def intern_title_flag(title: Column) -> Column:
    """C9 (clean-up): negation phrases win, then the intern keywords; blank -> false."""
    neg = any_substring(title, dims.INTERN_NEGATIONS)
    pos = any_substring(title, dims.INTERN_KWS)
    return F.coalesce((title != "") & ~neg & pos, F.lit(False))


def nontech_flag(title: Column, tech=None, nontech=None) -> Column:
    """White-list protects; otherwise a black-list hit flags; blank -> false."""
    white = any_substring(title, tech if tech is not None else dims.TECH_KWS)
    black = any_substring(title, nontech if nontech is not None else dims.NONTECH_KWS)
    return F.coalesce((title != "") & ~white & black, F.lit(False))


def in_whitelist(city: Column, cities: list[str]) -> Column:
    """C11: trimmed city in the whitelist; null/blank -> false."""
    return F.coalesce(ustrip(city).isin(cities), F.lit(False))


def url_job_id(url: Column) -> Column:
    """Numeric id from /job/N or /lptjob/N, else URL without query, else ''."""
    m = F.regexp_extract(url, dims.URL_JOB_ID_PATTERN, 1)
    return (F.when(url.isNull() | (url == ""), F.lit(""))
            .when(m != "", m)
            .otherwise(F.split_part(url, F.lit("?"), F.lit(1))))


def area_to_city(area: Column, sep: str, fallback: Column | None = None) -> Column:
    """Text before the first separator, trimmed; blank -> fallback."""
    c = ustrip(F.split_part(area, F.lit(sep), F.lit(1)))
    c = F.when(c != "", c)
    return F.coalesce(c, fallback) if fallback is not None else c


# C16 presentation labels -----------------------------------------------------

def eta_label(eta: Column) -> Column:
    return (F.when(eta >= 0.14, "大").when(eta >= 0.06, "中").when(eta >= 0.01, "小")
            .otherwise("极小"))


def d_label(d: Column) -> Column:
    a = F.abs(d)
    return F.when(a >= 0.8, "大").when(a >= 0.5, "中").when(a >= 0.2, "小").otherwise("极小")


def p_stars(p: Column) -> Column:
    return (F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*")
            .otherwise("n.s."))


def rho_strength(rho: Column) -> Column:
    a = F.abs(rho)
    return F.when(a >= 0.5, "强").when(a >= 0.3, "中").otherwise("弱")


def rho_direction(rho: Column) -> Column:
    return F.when(rho > 0, "递增").otherwise("递减")
