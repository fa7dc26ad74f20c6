"""The column functions as DuckDB expressions over a column's name, for the comparison of results."""

from __future__ import annotations

from rimlight.functions import text as t

SPACE = "[\\x20\\x09-\\x0D]+"


def squeeze(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{SPACE}', ' ', 'g'))"


def squeeze_unicode(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{t.UNICODE_SPACE}', ' ', 'g'))"


def sanitize(c: str) -> str:
    return squeeze(f"translate(coalesce({c}, ''), '{t.CONFUSED_FROM}', '{t.CONFUSED_TO}')")


def key(c: str) -> str:
    return f"upper(regexp_replace(coalesce({c}, ''), '[^A-Za-z0-9]', '', 'g'))"


def week_ok(c: str) -> str:
    return f"(length({c}) = 4 and coalesce(try_cast(substr({c}, 1, 2) as int) between 1 and 53, false))"


def sizes(src: str, c: str, keep: str) -> str:
    """A subquery with size_found, size_raw, size_norm, size_quality beside `keep`."""
    x = lambda i: f"regexp_extract(m, '{t.SIZE}', {i})"
    return f"""(select {keep}, ok as size_found, case when ok then raw else '' end as size_raw,
      case when ok then w || '/' || a || ' ' || case when k = '' then 'R' else k end || r || case when s = '' then '' else ' ' || s end else '' end as size_norm,
      case when ok then least(1.0::double, case when contains(m, '/') then 1.0::double else 0.88::double end + case when s = '' then 0.0::double else 0.03::double end) else 0.0::double end as size_quality
      from (select *, coalesce(try_cast(w as int) between 125 and 395 and try_cast(a as int) between 20 and 95 and try_cast(r as int) between 10 and 24, false) as ok
        from (select *, {x(2)} as w, {x(3)} as a, {x(4)} as k, {x(5)} as r, {x(6)} as s
          from (select *, regexp_extract({sanitize(c)}, '{t.SIZE}', 0) as m, {squeeze(c)} as raw from {src}))))"""


def dots(src: str, c: str, keep: str) -> str:
    """A subquery with dot_found, dot_norm, dot_full, dot_full_norm, wy_found, wy, dot_quality beside `keep`."""
    return f"""(select {keep}, (body <> '' or dated) as dot_found, case when body <> '' then 'DOT' || body when dated then digits else '' end as dot_norm,
      length(body) >= 8 as dot_full, case when body <> '' then 'DOT' || body else '' end as dot_full_norm, dated as wy_found, case when dated then digits else '' end as wy,
      case when length(body) >= 8 and dated then 1.0::double when dated then 0.82::double when body <> '' then 0.55::double else 0.0::double end as dot_quality
      from (select *, {week_ok('digits')} as dated
        from (select *, regexp_extract({key(c)}, '{t.DOT}', 1) as body, regexp_extract({key(sanitize(c))}, '{t.WEEK_YEAR}', 1) as digits from {src})))"""


def clamp01(x: str) -> str:
    return f"greatest(0.0::double, least(1.0::double, {x}))"


def iou(a: str, b: str) -> str:
    """Of two sets of columns with prefixes a and b: x, y, w, h."""
    w = f"greatest(0, least({a}x + {a}w, {b}x + {b}w) - greatest({a}x, {b}x))::double"
    h = f"greatest(0, least({a}y + {a}h, {b}y + {b}h) - greatest({a}y, {b}y))::double"
    both = f"({a}w::double * {a}h + {b}w::double * {b}h - {w} * {h})"
    return f"case when {both} > 0 then {w} * {h} / {both} else 0.0::double end"
