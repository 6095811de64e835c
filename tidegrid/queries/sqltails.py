"""Distribution tails and small regression trees written in SQL for the reference queries."""


def normal_cdf(z: str) -> str:
    y = f"abs({z})"
    phi = f"(exp(-{y} * {y} / 2) / sqrt(2 * pi()))"
    series = f"list_reduce(range(80, 0, -1), lambda acc, k: 1 + {y} * {y} / (2 * k + 1) * acc, 1.0::DOUBLE)"
    frac = f"list_reduce(range(80, 0, -1), lambda acc, k: {y} + k / acc, ({y})::DOUBLE)"
    up = f"(CASE WHEN {y} <= 3 THEN 0.5 - {phi} * {y} * {series} ELSE {phi} / {frac} END)"
    return f"(CASE WHEN {z} <= 0 THEN {up} ELSE 1 - {up} END)"


def t_two_sided(t: str, df: str) -> str:
    a = f"atan(abs({t}) / sqrt({df}))"
    h = f"((pi() / 2 - {a}) / 2000)"
    w = "(CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    area = f"list_sum(list_transform(range(0, 2001), lambda i: {w} * pow(greatest(cos({a} + i * {h}), 0), {df} - 1))) * {h} / 3"
    return f"({area} / (sqrt(pi()) * exp(lgamma(({df}) / 2.0) - lgamma((({df}) + 1) / 2.0)) / 2))"


def kolmogorov(x: str) -> str:
    s = f"list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * {x} * {x})))"
    return f"(CASE WHEN {x} < 0.05 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * {s})) END)"


def best_split(tag: str, src: str, features: list[str], y: str, by: str | None = None) -> str:
    """Table ``tag``: per group of ``src``, the feature and threshold that lower the squared error of ``y`` most, and by how much."""
    g = by or "0"
    cells = " UNION ALL ".join(f"SELECT {g} AS g, '{f}' AS f, {f} AS x, {y} AS y FROM {src}" for f in features)
    return f"""{tag}_bins AS (SELECT g, f, x, count(*) AS n, sum(y) AS s FROM ({cells}) GROUP BY 1, 2, 3),
{tag}_cum AS (SELECT g, f, x, lead(x) OVER w AS nx, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER (PARTITION BY g, f) AS nt, sum(s) OVER (PARTITION BY g, f) AS st FROM {tag}_bins WINDOW w AS (PARTITION BY g, f ORDER BY x)),
{tag} AS (SELECT g, f, (x + nx) / 2 AS t, sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) - st * st / nt AS gain FROM {tag}_cum WHERE nl < nt QUALIFY row_number() OVER (PARTITION BY g ORDER BY gain DESC) = 1)"""


def side(features: list[str], f: str = "f", t: str = "t") -> str:
    """Whether a row falls right of a split."""
    return f"((CASE {f} " + " ".join(f"WHEN '{c}' THEN {c}" for c in features) + f" END) > {t})"


def two_level_tree(src: str, features: list[str], y: str, learn: str) -> str:
    """Tables ``top`` and ``low`` (the splits of a tree of depth two learned from ``src`` where ``learn``) and ``leafed`` (rows with their leaf)."""
    return f"""learn AS (SELECT * FROM {src} WHERE {learn}), {best_split('top', 'learn', features, y)},
halved AS (SELECT {src}.*, {side(features)} AS half_ FROM {src}, top), learn2 AS (SELECT * FROM halved WHERE {learn}), {best_split('low', 'learn2', features, y, 'half_')},
leafed AS (SELECT halved.*, {side(features)} AS leaf FROM halved JOIN low ON low.g = halved.half_)"""


def tree_importance(features: list[str]) -> str:
    """Table ``imp``: each feature's share of the error that the splits of ``top`` and ``low`` remove."""
    names = ", ".join(f"('{f}')" for f in features)
    return f"""gains AS (SELECT f, gain FROM top UNION ALL SELECT f, gain FROM low),
imp AS (SELECT feature, coalesce(sum(gain), 0) / (SELECT sum(gain) FROM gains) AS importance FROM (VALUES {names}) v(feature) LEFT JOIN gains ON f = feature GROUP BY 1)"""
