"""The registered queries in plain SQL, for a second engine."""

from __future__ import annotations

from math import factorial

from .functions.fusing import owa_weights
from .operators.fusion import RISKS
from .queries import GROUPS, NUMERIC, OWA_RISK

E = "e AS (SELECT vec_id AS id, label, unnest(range(len(embedding)))::INT AS f, unnest(embedding)::DOUBLE AS v FROM embeddings)"
IMB = "imb AS (SELECT vec_id AS id, CASE WHEN label = 0 THEN 1 ELSE 0 END AS label, embedding FROM embeddings)"
MM = "mm AS (SELECT f, min(v) AS mn, max(v) AS mx FROM e GROUP BY f)"
SC = "sc AS (SELECT id, label, e.f, CASE WHEN mn = mx THEN 0.5::DOUBLE ELSE (v - mn) / (mx - mn) END AS v FROM e JOIN mm ON e.f = mm.f)"


def _bin(v: str, mn: str, mx: str, n: int = 10) -> str:
    w = f"(({mx} - {mn}) / {n}.0::DOUBLE)"
    k = f"floor(({v} - {mn}) / {w})"
    fixed = f"({k} + CASE WHEN {v} >= {mn} + ({k} + 1) * {w} THEN 1 ELSE 0 END - CASE WHEN {v} < {mn} + {k} * {w} THEN 1 ELSE 0 END)"
    return f"(CASE WHEN {mn} = {mx} THEN 0 ELSE greatest(0, least({fixed}, {n - 1})) END)::INT"


BN = f"bn AS (SELECT id, label, f, {_bin('v', '0.0::DOUBLE', '1.0::DOUBLE')} AS bin FROM sc)"
ALL = f"{E}, {MM}, {SC}, {BN}"
#: The label as one more feature.
BL = "bl AS (SELECT id, f, bin FROM bn UNION ALL SELECT DISTINCT id, (SELECT max(f) + 1 FROM bn)::INT, label FROM bn)"
H = "h AS (SELECT f, -sum(n / t * log2(n / t)) AS h FROM (SELECT f, bin, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY f)::DOUBLE AS t FROM bl GROUP BY f, bin) GROUP BY f)"
HXY = "hxy AS (SELECT x, y, -sum(n / t * log2(n / t)) AS hxy FROM (SELECT a.f AS x, b.f AS y, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY a.f, b.f)::DOUBLE AS t FROM bl a JOIN bl b ON a.id = b.id AND a.f < b.f GROUP BY a.f, b.f, a.bin, b.bin) GROUP BY x, y)"


def _matrix(normalised: bool) -> str:
    v = "2 * (a.h + b.h - hxy) / (a.h + b.h)" if normalised else "a.h + b.h - hxy"
    return f"""WITH {ALL}, {BL}, {H}, {HXY}, u AS (SELECT x, y, {v} AS v FROM hxy JOIN h a ON a.f = x JOIN h b ON b.f = y)
SELECT x, y, round(v, 6) AS v FROM (SELECT * FROM u UNION ALL SELECT y, x, v FROM u UNION ALL SELECT f, f, {'1.0' if normalised else 'h'} FROM h)"""


def _h(cells: str, by: str, source: str, name: str) -> str:
    return f"{name} AS (SELECT {by}, -sum(n / t * log2(n / t)) AS {name} FROM (SELECT {by}, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY {by})::DOUBLE AS t FROM {source} GROUP BY {by}, {cells}) GROUP BY {by})"


PAIR = "pr AS (SELECT a.f AS x, b.f AS y, a.bin AS i, b.bin AS j, a.label AS z FROM bn a JOIN bn b ON a.id = b.id AND a.f < b.f)"
CMI = f"""WITH {ALL}, {PAIR}, {_h('bin', 'f', 'bn', 'hx')}, {_h('bin, label', 'f', 'bn', 'hxz')}, {_h('label', 'f', 'bn', 'hz')}, {_h('i, j', 'x, y', 'pr', 'hxy')}, {_h('i, j, z', 'x, y', 'pr', 'hxyz')},
one AS (SELECT hx.f, hx, hxz, hz FROM hx JOIN hxz ON hx.f = hxz.f JOIN hz ON hx.f = hz.f),
u AS (SELECT hxy.x, hxy.y, 0.5 * (2 * hxy + b.hxz + a.hxz - 2 * hxyz - b.hx - a.hx) AS v FROM hxy JOIN hxyz ON hxy.x = hxyz.x AND hxy.y = hxyz.y JOIN one a ON a.f = hxy.x JOIN one b ON b.f = hxy.y)
SELECT x, y, round(v, 6) AS v FROM (SELECT * FROM u UNION ALL SELECT y, x, v FROM u UNION ALL SELECT f, f, hx + hz - hxz FROM one)"""

SU_LABEL = f"""WITH {ALL}, {_h('bin', 'f', 'bn', 'hx')}, {_h('bin, label', 'f', 'bn', 'hxz')}, {_h('label', 'f', 'bn', 'hz')},
s AS (SELECT hx.f, round(2 * (hx + hz - hxz) / (hx + hz), 6) AS v FROM hx JOIN hxz ON hx.f = hxz.f JOIN hz ON hx.f = hz.f)
SELECT f::VARCHAR AS item, v, (row_number() OVER (ORDER BY v DESC, f DESC) - 1)::INT AS pos FROM s"""


def _spread(groups: int = GROUPS, source: str = "imb") -> str:
    return f"{IMB}, sp AS (SELECT id, label, embedding, ((row_number() OVER (PARTITION BY label ORDER BY id) - 1) % {groups})::INT AS p FROM {source})"


MINORITY = "mn AS (SELECT p, label, n FROM (SELECT p, label, count(*) AS n, row_number() OVER (PARTITION BY p ORDER BY count(*), label) AS k FROM sp GROUP BY p, label) WHERE k = 1)"
VEC = "ve AS (SELECT p, id, label, unnest(range(len(embedding)))::INT AS f, unnest(embedding)::DOUBLE AS v FROM sp)"


def _draw(key: str) -> str:
    return f"('0x' || substr(md5({key}), 1, 8))::BIGINT"


def _near_miss(order: str) -> str:
    return f"""WITH {_spread()}, {MINORITY}, {VEC},
d AS (SELECT a.p, a.id, b.id AS n_id, round(sum(abs(a.v - b.v)), 9) AS dist FROM ve a JOIN mn ON a.p = mn.p AND a.label <> mn.label JOIN ve b ON b.p = a.p AND b.label = mn.label AND b.f = a.f GROUP BY a.p, a.id, b.id),
s AS (SELECT p, id, round(sum(dist), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY p, id ORDER BY dist {order}, n_id) AS k FROM d) WHERE k <= 5 GROUP BY p, id),
r AS (SELECT s.p, id, score, n, row_number() OVER (PARTITION BY s.p ORDER BY score, id) AS k FROM s JOIN mn ON s.p = mn.p)
SELECT p, id, false AS is_minority, score FROM r WHERE k <= n UNION ALL SELECT sp.p, id, true, NULL FROM sp JOIN mn ON sp.p = mn.p AND sp.label = mn.label"""


BAG = f"""{_spread()}, {MINORITY},
o AS (SELECT sp.p, id, row_number() OVER (PARTITION BY sp.p ORDER BY id) - 1 AS k FROM sp JOIN mn ON sp.p = mn.p AND sp.label <> mn.label),
sz AS (SELECT o.p, count(*) AS m, any_value(n) AS n FROM o JOIN mn ON o.p = mn.p GROUP BY o.p),
pk AS (SELECT p, bag, i, {_draw("'5341-' || p || '-' || bag || '-' || i")} % m AS k FROM (SELECT p, m, unnest(range(1, n + 1)) AS i, n FROM sz), (SELECT unnest([0, 1, 2]) AS bag)),
bg AS (SELECT pk.p, bag, 'o' || i AS draw, o.id, false AS is_minority FROM pk JOIN o ON pk.p = o.p AND pk.k = o.k
UNION ALL SELECT sp.p, bag, 'm' || id, id, true FROM sp JOIN mn ON sp.p = mn.p AND sp.label = mn.label, (SELECT unnest([0, 1, 2]) AS bag))"""

SMOTE = f"""WITH {_spread()}, {MINORITY}, {VEC}, mi AS (SELECT ve.* FROM ve JOIN mn ON ve.p = mn.p AND ve.label = mn.label),
d AS (SELECT a.p, a.id, b.id AS n_id, round(sqrt(sum((a.v - b.v) * (a.v - b.v))), 9) AS dist FROM mi a JOIN mi b ON a.p = b.p AND a.f = b.f AND a.id <> b.id GROUP BY a.p, a.id, b.id),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p, id ORDER BY dist, n_id) AS r FROM d) WHERE r <= 5),
pk AS (SELECT p, id, 1 AS i, {_draw("'5341-' || p || '-' || id || '-1'")} % max(r) + 1 AS r FROM k GROUP BY p, id)
SELECT a.p, a.id, i, n_id, a.f, round(a.v + {_draw("'5341-gap'")} / 4294967296.0::DOUBLE * (b.v - a.v), 6) AS v FROM pk JOIN k USING (p, id, r) JOIN mi a ON a.p = pk.p AND a.id = pk.id JOIN mi b ON b.p = pk.p AND b.id = n_id AND b.f = a.f"""


def _pairs(value: str) -> str:
    return f"WITH {_spread(16)}, {VEC} SELECT a.p, a.id, b.id AS n_id, round({value}, 6) AS dist FROM ve a JOIN ve b ON a.p = b.p AND a.f = b.f AND a.id < b.id GROUP BY a.p, a.id, b.id"


def _knn(rule: str = "true", order: str = "", per: str = "") -> str:
    return f"""WITH sp AS (SELECT vec_id AS id, label, embedding, ((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % {GROUPS})::INT AS p FROM embeddings), {VEC},
d AS (SELECT a.p, a.id, b.id AS n_id, any_value(b.label) AS n_label, round(sqrt(sum((a.v - b.v) * (a.v - b.v))), 9) AS dist FROM ve a JOIN ve b ON a.p = b.p AND a.f = b.f AND a.id <> b.id AND {rule} GROUP BY a.p, a.id, b.id)
SELECT p, id, n_id, n_label, round(dist, 6) AS dist, k::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id{per} ORDER BY dist {order}, n_id) AS k FROM d) WHERE k <= 3"""


RELIEFF = f"""WITH {E}, {MM}, {SC}, x AS (SELECT id, CASE WHEN label = 0 THEN 1 ELSE 0 END AS label, f, v FROM sc), r AS (SELECT DISTINCT id, label FROM x),
pr AS (SELECT label, count(*) / (SELECT count(*) FROM r)::DOUBLE AS pr FROM r GROUP BY label),
s AS (SELECT id, label FROM (SELECT *, row_number() OVER (ORDER BY md5('5341-' || id), id) AS k FROM r) WHERE k <= 20),
d AS (SELECT a.id, any_value(a.label) AS label, b.id AS n_id, any_value(b.label) AS n_label, round(sqrt(sum((a.v - b.v) * (a.v - b.v))), 9) AS dist FROM x a JOIN s ON s.id = a.id JOIN x b ON a.f = b.f AND a.id <> b.id GROUP BY a.id, b.id),
n AS (SELECT *, row_number() OVER (PARTITION BY id, n_label ORDER BY dist, n_id) AS k FROM d)
SELECT a.f, round(sum(CASE WHEN n.label = n_label THEN -1.0 ELSE q.pr / (1 - o.pr) END * abs(a.v - b.v)), 6) AS w FROM n JOIN pr o ON o.label = n.label JOIN pr q ON q.label = n_label JOIN x a ON a.id = n.id JOIN x b ON b.id = n_id AND b.f = a.f WHERE k <= 10 GROUP BY a.f"""

#: Bags, their neighbours by class, weights of features, and both fusions by the least rank.
ENSEMBLE_RELIEFF = f"""WITH {E}, {MM}, {SC}, {BAG},
r AS (SELECT bg.p, bag, draw, bg.id, sp.label FROM bg JOIN sp ON bg.id = sp.id), x AS (SELECT r.*, f, v FROM r JOIN sc ON sc.id = r.id),
pr AS (SELECT p, bag, label, count(*) / sum(count(*)) OVER (PARTITION BY p, bag)::DOUBLE AS pr FROM r GROUP BY p, bag, label),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p, bag ORDER BY md5('5341-' || p || '-' || bag || '-' || draw), draw) AS k FROM r) WHERE k <= 20),
d AS (SELECT a.p, a.bag, a.draw, any_value(a.label) AS label, b.draw AS n_draw, any_value(b.label) AS n_label, round(sqrt(sum((a.v - b.v) * (a.v - b.v))), 9) AS dist
  FROM x a JOIN s ON s.p = a.p AND s.bag = a.bag AND s.draw = a.draw JOIN x b ON a.p = b.p AND a.bag = b.bag AND a.f = b.f AND a.id <> b.id GROUP BY a.p, a.bag, a.draw, b.draw),
n AS (SELECT *, row_number() OVER (PARTITION BY p, bag, draw, n_label ORDER BY dist, n_draw) AS k FROM d),
w AS (SELECT n.p, n.bag, a.f, round(sum(CASE WHEN n.label = n_label THEN -1.0 ELSE q.pr / (1 - o.pr) END * abs(a.v - b.v)), 12) AS w FROM n
  JOIN pr o ON o.p = n.p AND o.bag = n.bag AND o.label = n.label JOIN pr q ON q.p = n.p AND q.bag = n.bag AND q.label = n_label
  JOIN x a ON a.p = n.p AND a.bag = n.bag AND a.draw = n.draw JOIN x b ON b.p = n.p AND b.bag = n.bag AND b.draw = n_draw AND b.f = a.f WHERE k <= 20 GROUP BY n.p, n.bag, a.f),
l AS (SELECT p, bag, f::VARCHAR AS item, row_number() OVER (PARTITION BY p, bag ORDER BY w DESC, f DESC) AS pos FROM w),
g AS (SELECT p, item, row_number() OVER (PARTITION BY p ORDER BY min(pos), item) AS pos FROM l GROUP BY p, item),
t AS (SELECT item, min(pos) / (SELECT count(DISTINCT f) FROM w)::DOUBLE AS score FROM g GROUP BY item)
SELECT item, round(score, 9) AS score, (row_number() OVER (ORDER BY round(score, 12), item) - 1)::INT AS pos FROM t"""

LISTS = f"{E}, w AS (SELECT id % 4 AS l, f, round(avg(v), 9) AS w FROM e GROUP BY ALL), ls AS (SELECT l, f::VARCHAR AS item, row_number() OVER (PARTITION BY l ORDER BY w DESC, f DESC) AS pos FROM w), r AS (SELECT item, list_sort(list(pos / (SELECT count(DISTINCT f) FROM w)::DOUBLE)) AS r FROM ls GROUP BY item)"


def _fuse(score: str) -> str:
    return f"WITH {LISTS}, s AS (SELECT item, {score} AS score FROM r) SELECT item, round(score, 8) AS score, (row_number() OVER (ORDER BY round(score, 12), item) - 1)::INT AS pos FROM s"


def _stuart(n: int) -> str:
    """The recursion written out for n sorted ranks."""
    v, powers = ["1.0::DOUBLE"], [1]
    for k in range(1, n + 1):
        powers.append(powers[-1] * k)
        v.append("(" + " ".join(f"{'-' if i % 2 == 0 else '+'} {v[k - i]} * r[{n - k + 1}] ** {i} / {powers[i]}" for i in range(1, k + 1)) + ")")
    return f"{powers[n]} * {v[n]}"


def _rra(n: int) -> str:
    """n times the least binomial tail."""
    choose = lambda j: factorial(n) // factorial(j) // factorial(n - j)
    tails = ["(" + " + ".join(f"{choose(j)} * r[{i}] ** {j} * (1 - r[{i}]) ** {n - j}" for j in range(i, n + 1)) + ")" for i in range(1, n + 1)]
    return f"least(1.0::DOUBLE, {n} * least({', '.join(tails)}))"


def _mean(n: int) -> str:
    """Normal distribution by its odd series; (2 k + 1)!! by way of gamma."""
    z = f"((({' + '.join(f'r[{i + 1}]' for i in range(n))}) / {n} - 0.5::DOUBLE) * sqrt({12 * n}.0::DOUBLE))"
    return f"(0.5::DOUBLE + exp(-{z} * {z} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 70), lambda k: {z} ** (2 * k + 1) * sqrt(pi()) / (2.0::DOUBLE ** (k + 1) * gamma(k + 1.5)))))"


def _owa(n: int, risk: float) -> str:
    return "(" + " + ".join(f"r[{n - i}] * {w!r}::DOUBLE" for i, w in enumerate(owa_weights(n, risk))) + ")"


def _scores(n: int) -> dict[str, str]:
    """Of n sorted ranks r, by method."""
    return {
        "min": "r[1]", "median": f"r[{n // 2 + 1}]", "geom.mean": f"exp(({' + '.join(f'ln(r[{i + 1}])' for i in range(n))}) / {n})",
        "mean": _mean(n), "RRA": _rra(n), "stuart": _stuart(n), **{f"owa {a:g}": _owa(n, a) for a in RISKS},
    }


def _sweep() -> str:
    """All settings: scores over the three bags of a group, positions, scores over the four groups, positions."""
    first, second = _scores(3), _scores(4)
    settings = [(m, m, m) for m in first if not m.startswith("owa")] + [(f"{a} {b[4:]}", a, b) for a in first for b in second if a.startswith("owa") and b.startswith("owa")]
    ones = " UNION ALL ".join(f"SELECT p, item, '{m}' AS one, {f} AS score FROM ra" for m, f in first.items())
    both = " UNION ALL ".join(f"SELECT '{s}' AS setting, item, {second[b]} AS score FROM rb WHERE one = '{a}'" for s, a, b in settings)
    return f"""WITH {E}, w AS (SELECT id % 4 AS p, (id // 4) % 3 AS bag, f, round(avg(v), 9) AS w FROM e GROUP BY ALL), nf AS (SELECT count(DISTINCT f)::DOUBLE AS n FROM w),
a AS (SELECT p, bag, f::VARCHAR AS item, row_number() OVER (PARTITION BY p, bag ORDER BY w DESC, f DESC) AS pos FROM w),
ra AS (SELECT p, item, list_sort(list(pos / (SELECT n FROM nf))) AS r FROM a GROUP BY p, item), s1 AS ({ones}),
b AS (SELECT p, one, item, row_number() OVER (PARTITION BY p, one ORDER BY round(score, 12), item) AS pos FROM s1),
rb AS (SELECT one, item, list_sort(list(pos / (SELECT n FROM nf))) AS r FROM b GROUP BY one, item), s2 AS ({both})
SELECT setting, item, round(score, 8) AS score, (row_number() OVER (PARTITION BY setting ORDER BY round(score, 12), item) - 1)::INT AS pos FROM s2"""


TWO_LEVEL = f"""WITH {E}, w AS (SELECT id % 4 AS p, (id // 4) % 3 AS bag, f, round(avg(v), 9) AS w FROM e GROUP BY ALL), nf AS (SELECT count(DISTINCT f)::DOUBLE AS n FROM w),
a AS (SELECT p, bag, f::VARCHAR AS item, row_number() OVER (PARTITION BY p, bag ORDER BY w DESC, f DESC) AS pos FROM w),
b AS (SELECT p, item, row_number() OVER (PARTITION BY p ORDER BY min(pos), item) AS pos FROM a GROUP BY p, item),
s AS (SELECT item, min(pos) / (SELECT n FROM nf) AS score FROM b GROUP BY item)
SELECT item, round(score, 9) AS score, (row_number() OVER (ORDER BY round(score, 12), item) - 1)::INT AS pos FROM s"""

ITEMS = " UNION ALL ".join(f"SELECT {i} AS f, {c}::DOUBLE AS v FROM lineitem" for i, c in enumerate(NUMERIC))
_bounds = ", ".join(f"min({c})::DOUBLE AS a{i}, max({c})::DOUBLE AS b{i}" for i, c in enumerate(NUMERIC))
_bins = ", ".join(_bin(f"{c}::DOUBLE", f"a{i}", f"b{i}") for i, c in enumerate(NUMERIC))
CONTINGENCY = f"""WITH m AS (SELECT {_bounds} FROM lineitem), z AS (SELECT l_returnflag AS g, (row_number() OVER (ORDER BY count(*) DESC, l_returnflag) - 1)::INT AS z FROM lineitem GROUP BY l_returnflag),
b AS (SELECT [{_bins}, z] AS b FROM lineitem JOIN z ON g = l_returnflag, m)
SELECT x::INT AS x, y::INT AS y, b[x + 1] AS i, b[y + 1] AS j, count(*) AS n FROM b, (SELECT unnest(range({len(NUMERIC) + 1})) AS x) q, (SELECT unnest(range({len(NUMERIC) + 1})) AS y) p WHERE x < y GROUP BY ALL"""


def _byte(c: str) -> str:
    return f"(CASE WHEN {c} % 256 > 127 THEN {c} % 256 - 256 ELSE {c} % 256 END)::TINYINT"


SQL = {
    "feature_minmax": f"WITH {E}, {MM} SELECT f, mn, mx FROM mm",
    "minmax_scaled": f"WITH {E}, {MM}, {SC} SELECT id, f, round(v, 6) AS v FROM sc",
    "equal_width_bins": f"WITH {E}, {MM} SELECT id, e.f, {_bin('v', 'mn', 'mx')} AS bin FROM e JOIN mm ON e.f = mm.f",
    "scaled_bins": f"WITH {ALL} SELECT id, f, bin FROM bn",
    "quantile_bins_exact": f"WITH {E} SELECT id, f, (ntile(4) OVER (PARTITION BY f ORDER BY v, id) - 1)::INT AS bin FROM e",
    "nominal_features": f"SELECT f::INT AS f, count(DISTINCT v) AS n_values, count(DISTINCT v) < 60 AS is_nominal FROM ({ITEMS}) GROUP BY f",
    "label_index": "SELECT o_orderpriority AS value, count(*) AS n, (row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1)::DOUBLE AS idx FROM orders GROUP BY o_orderpriority",
    "class_spread_counts": f"WITH {_spread()} SELECT p, label, count(*) AS n FROM sp GROUP BY p, label",
    "minority_split": f"WITH {_spread()}, {MINORITY} SELECT * FROM mn",
    "bagging_undersample": f"WITH {BAG} SELECT * FROM bg",
    "nearmiss1": _near_miss(""),
    "nearmiss2": _near_miss("DESC"),
    "smote_synthetic": SMOTE,
    "pair_euclidean": _pairs("sqrt(sum((a.v - b.v) * (a.v - b.v)))"),
    "pair_manhattan": _pairs("sum(abs(a.v - b.v))"),
    "knn": _knn(),
    "knn_hit": _knn("a.label = b.label"),
    "knn_miss": _knn("a.label <> b.label"),
    "knn_by_class": _knn(per=", n_label"),
    "k_furthest": _knn(order="DESC"),
    "entropy": f"WITH {ALL}, {BL}, {H} SELECT f, round(h, 6) AS h FROM h",
    "contingency": CONTINGENCY,
    "mi_matrix": _matrix(False),
    "su_matrix": _matrix(True),
    "cmi_matrix": CMI,
    "su_label_rank": SU_LABEL,
    "relieff_weights": RELIEFF,
    "fuse_min": _fuse("r[1]"),
    "fuse_median": _fuse("r[3]"),
    "fuse_geom_mean": _fuse("exp((ln(r[1]) + ln(r[2]) + ln(r[3]) + ln(r[4])) / 4)"),
    "fuse_mean": _fuse(_mean(4)),
    "fuse_rra": _fuse(_rra(4)),
    "fuse_stuart": _fuse(_stuart(4)),
    "fuse_owa": _fuse(_owa(4, OWA_RISK)),
    "fusion_sweep": _sweep(),
    "ensemble_relieff_min": ENSEMBLE_RELIEFF,
    "scaled_nan_kept": f"WITH {E}, h AS (SELECT id, f, v, (id + f) % 11 = 0 AS n FROM e), b AS (SELECT f, min(v) AS mn, max(v) AS mx FROM h WHERE NOT n GROUP BY f) SELECT id, h.f, n AS is_nan, CASE WHEN n THEN NULL ELSE round((v - mn) / (mx - mn), 6) END AS v FROM h JOIN b ON h.f = b.f",
    "strict_bins": f"WITH {E}, {MM} SELECT e.f, {_bin('v', 'mn', 'mx', 7)} AS bin, count(*) AS n FROM e JOIN mm ON e.f = mm.f GROUP BY ALL",
    "prepared": "WITH i AS (SELECT p_brand AS b, (row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1)::DOUBLE AS label FROM part GROUP BY p_brand), m AS (SELECT min(p_size)::DOUBLE AS a, max(p_size)::DOUBLE AS b, min(p_retailprice)::DOUBLE AS c, max(p_retailprice)::DOUBLE AS d FROM part) SELECT p_partkey, label, f::INT AS f, round(-1 + 2 * (CASE WHEN f = 0 THEN (p_size - a) / (m.b - a) ELSE (p_retailprice - c) / (d - c) END), 6) AS v FROM part JOIN i ON p_brand = i.b, m, (SELECT unnest([0, 1]) AS f)",
    "balanced_none": f"WITH {_spread()} SELECT p, bag, label, count(*) AS n, sum(id)::BIGINT AS ids FROM sp, (SELECT unnest([0, 1])::INT AS bag) GROUP BY p, bag, label",
    "two_level_fusion_min": TWO_LEVEL,
    "csv_roundtrip": "SELECT " + ", ".join(f"{c}::DOUBLE AS col{i}" for i, c in enumerate(NUMERIC)) + ", CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label FROM lineitem",
    "binary_records": "SELECT " + ", ".join(f"{_byte(c)} AS {n}" for c, n in (("l_orderkey", "col0"), ("l_partkey", "col1"), ("l_suppkey", "col2"), ("l_linenumber", "label"))) + " FROM lineitem",
}
