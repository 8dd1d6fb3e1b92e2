"""Tail probabilities as plain SQL, by Simpson's rule and series: the reference side of the p-value checks."""

_SIMPSON = "(case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end)"


def normal(z: str) -> str:
    a = f"least(abs({z}), 9.0::double)"
    return (
        f"(1 - 2 * {a} / 6000.0::double * 0.3989422804014327::double * list_sum(list_transform(range(0, 2001), "
        f"lambda i: {_SIMPSON} * exp(-0.5::double * pow({a} * i / 2000.0::double, 2)))))"
    )


def student(t: str, df: str) -> str:
    th = f"atan(abs({t}) / sqrt({df}))"
    return (
        f"(1 - 2 * exp(lgamma((({df}) + 1) / 2) - lgamma(({df}) / 2)) / sqrt(pi()) * {th} / 6000.0::double * "
        f"list_sum(list_transform(range(0, 2001), lambda i: {_SIMPSON} * pow(cos({th} * i / 2000.0::double), ({df}) - 1))))"
    )


def chi2(x: str, df: str) -> str:
    return (
        f"(1 - list_sum(list_transform(range(0, 600), lambda i: exp(-({x}) / 2 + (({df}) / 2.0::double + i) * ln(({x}) / 2) "
        f"- lgamma(({df}) / 2.0::double + i + 1)))))"
    )


def _choose(a: str, b: str) -> str:
    return f"(lgamma(({a}) + 1.0::double) - lgamma(({b}) + 1.0::double) - lgamma(({a}) - ({b}) + 1.0::double))"


def hypergeom(k: str, n: str, m: str, u: str) -> str:
    return (
        f"coalesce(list_sum(list_transform(range(greatest({k}, {n} + {m} - {u}, 0)::bigint, least({n}, {m})::bigint + 1), "
        f"lambda i: exp({_choose(m, 'i')} + {_choose(f'{u} - {m}', f'{n} - i')} - {_choose(u, n)}))), 0)"
    )


def avg_rank(part: str, value: str) -> str:
    p = f"partition by {part}" if part else ""
    pv = f"partition by {part}, {value}" if part else f"partition by {value}"
    return f"(rank() over ({p} order by {value}) + (count(*) over ({pv}) - 1) / 2.0::double)"


def bh(keys: str, p: str) -> str:
    """CTE body computing q over a table ``tests``."""
    part = f"partition by {keys}" if keys else ""
    return (
        f"select * exclude (raw, rk, m), least(min(raw) over ({part} order by {p} desc range between unbounded preceding and current row), 1.0::double) as q "
        f"from (select *, {p} * m / rk as raw from (select *, count({p}) over ({part}) as m, "
        f"count({p}) over ({part} order by {p} range between unbounded preceding and current row) as rk from tests))"
    )


#: Places of rows in their hash order, and 50 rounds of draws with replacement: {i} the id, {t} the table, {f} the share drawn.
PLACES = """pl as (select *, row_number() over (order by ('0x' || substr(md5('42:' || {i}), 1, 13))::bigint, md5('42:' || {i})) as pos, count(*) over () as n from {t}),
    dr as (select r as round, floor(('0x' || substr(md5('42b:' || r || ':' || j), 1, 13))::bigint / {space}::double * (select max(n) from pl)) + 1 as pos, count(*) as weight
      from (select unnest(range(1, 51)) as r), (select unnest(range(0, (select greatest(1, floor({f}::double * max(n))) from pl)::bigint)) as j) group by all)"""
