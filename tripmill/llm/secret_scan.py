"""Secret scans by a battery of randomness tests, with DataFrame and SQL functions only.

Base kinds come from patterns (``assign``, ``access``, ``hex``). The method adds ``random``: runs of at least ``LEAST`` key characters
with letters and digits that no base match overlaps and that look drawn at random from the alphabet of their inferred encoding
(hex, base32, base62 or base64). The battery has the null hypothesis of uniform independent symbols:

* chi-squared uniformity over the alphabet and over its groups (vowels, common and rare consonants, capitals, digits and signs),
  by Wilson and Hilferty; the groups have power in short runs too,
* runs above and below the middle of the alphabet (Wald and Wolfowitz),
* serial correlation of neighbouring symbols.

The battery's p-value is four times the least of them; runs with less than ``refuse`` are patterns and not reported.

Not being refused is no evidence in a short run. So what is reported is tested the other way round: the null hypothesis is text
that people write, in the symbol shares of one of ``STYLES`` (camel case, snake case, capitals, numbers), and the statistic is the
log-likelihood of uniform symbols over that style, whose mean and variance follow from the run's length. The p-value is the
largest over the styles, the variance being doubled since symbols of words are not independent. False discoveries are controlled by
step-up within each length class (powers of two): a run is reported at a p-value at which ``rate`` times the number of reported
runs is at least what all candidates of its class would give by chance. P-values are rounded up to a grid of 1/32 binary orders, so the
step-up needs only counts by class and grid point, a table of bounded size, and no sort of all candidates.

Null and empty texts have no spans. Rows are returned one for one, repeated rows and null doc_id too. Places are code points.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, table
from .native import folded, gated, matches, quoted

#: The base patterns in the order of their kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LEAST = 20
RUN = rf"[A-Za-z0-9+/_-]{{{LEAST},}}"
#: Alphabets by encoding.
ALPHABETS = {
    "hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
ENCODINGS = (("hex", "0-9a-f"), ("HEX", "0-9A-F"), ("base32", "A-Z2-7"), ("base62", "A-Za-z0-9"), ("base64", "A-Za-z0-9+/"))
#: Groups of symbols, and the share of each in what people write, by style.
GROUPS = ("aeiou", "cdlmnprst", "bfghjkqvwxyz", "AEIOU", "CDLMNPRST", "BFGHJKQVWXYZ", "0123456789", "+/-_")
STYLES = {
    "camel": (0.30, 0.36, 0.12, 0.05, 0.06, 0.03, 0.06, 0.02), "snake": (0.33, 0.38, 0.12, 0.01, 0.01, 0.01, 0.06, 0.08),
    "capitals": (0.01, 0.01, 0.01, 0.31, 0.37, 0.12, 0.07, 0.10), "numbers": (0.02, 0.02, 0.02, 0.02, 0.02, 0.02, 0.82, 0.06),
}
GRID, DEEPEST = 32, 64 * 32


def _uniform(encoding: str) -> list[float]:
    return [sum(c in g for c in ALPHABETS[encoding]) / len(ALPHABETS[encoding]) for g in GROUPS]


def _pooled(encoding: str) -> list[list[int]]:
    """Indices of groups that the chi-squared test of an encoding takes as one: none is rare at 20 symbols."""
    sets = [[0], [1], [2], [3, 4, 5], [6, 7]] if _uniform(encoding)[2] and _uniform(encoding)[5] else [[i] for i in range(6)] + [[6, 7]]
    return [g for g in sets if sum(_uniform(encoding)[i] for i in g)]


def _group_chi(encoding: str, n: str, count: str) -> tuple[str, int]:
    """SQL for the chi-squared statistic of the pooled groups over ``count`` (a format for one group's count), and its groups."""
    terms = []
    for group in _pooled(encoding):
        share = sum(_uniform(encoding)[i] for i in group)
        terms.append(f"power({' + '.join(count.format(i) for i in group)} - {n} * {share:.9f}e0, 2) / ({n} * {share:.9f}e0)")
    return "(" + " + ".join(terms) + ")", len(terms)


def _style_z(encoding: str, style: str, n: str, count: str) -> str:
    """SQL for the standardised log-likelihood of uniform symbols over a style, under that style."""
    p = _uniform(encoding)
    q = [x if p[i] else 0.0 for i, x in enumerate(STYLES[style])]
    q = [x / sum(q) for x in q]
    w = [log(a / b) if a else 0.0 for a, b in zip(p, q)]
    mean = sum(x * y for x, y in zip(q, w))
    variance = 2 * (sum(x * y * y for x, y in zip(q, w)) - mean**2)
    total = " + ".join(f"{count.format(i)} * ({x:.9f}e0)" for i, x in enumerate(w) if x)
    return f"(({total} - {n} * ({mean:.9f}e0)) / sqrt({n} * {variance:.9f}e0))"


def _two_sided(z: str) -> str:
    """Two-sided normal tail: erfc(|z| / sqrt 2) by the rational approximation of Abramowitz and Stegun 7.1.26."""
    x = f"(abs({z}) / sqrt(2D))"
    t = f"(1D / (1D + 0.3275911D * {x}))"
    return f"({t} * (0.254829592D + {t} * (-0.284496736D + {t} * (1.421413741D + {t} * (-1.453152027D + {t} * 1.061405429D)))) * exp(-{x} * {x}))"


def _chi_tail(chi: str, free: str) -> str:
    """Upper tail of chi-squared by the approximation of Wilson and Hilferty."""
    third = f"(2D / (9D * {free}))"
    z = f"((power({chi} / {free}, 1D / 3) - (1D - {third})) / sqrt({third}))"
    return f"CASE WHEN {z} > 0 THEN {_two_sided(z)} / 2 ELSE 1D - {_two_sided(z)} / 2 END"


def _steps() -> list[tuple[str, str]]:
    """The battery as named values, each over those before it, of one run ``m.x``. All are linear in the run."""
    name = "CASE " + " ".join(f"WHEN m.x RLIKE '^[{chars}]+$' THEN '{n}'" for n, chars in ENCODINGS) + " ELSE 'base64url' END"
    counts = "aggregate(sequence(1, m.k), 0D, (a, i) -> a + power(CAST(m.n - length(replace(m.x, substring(m.abc, i, 1), '')) AS DOUBLE), 2D))"
    per = lambda f: "CASE m.encoding " + " ".join(f"WHEN '{e}' THEN {f(e)}" for e in ALPHABETS) + " END"
    changes = "(size(split(m.bits, '01', -1)) + size(split(m.bits, '10', -1)) - 1)"
    return [
        ("encoding", name),
        ("abc", per(lambda e: f"'{ALPHABETS[e]}'")),
        ("n", "length(m.x)"),
        ("k", "length(m.abc)"),
        ("chi", f"m.k / CAST(m.n AS DOUBLE) * {counts} - m.n"),
        ("p_chi", _chi_tail("m.chi", "(m.k - 1)")),
        ("marks", f"translate(m.x, '{''.join(GROUPS)}', '{''.join(str(i) * len(g) for i, g in enumerate(GROUPS))}')"),
        *((f"g{i}", f"CAST(m.n - length(replace(m.marks, '{i}', '')) AS DOUBLE)") for i in range(len(GROUPS))),
        ("group_chi", per(lambda e: _group_chi(e, "m.n", "m.g{}")[0])),
        ("groups", per(lambda e: f"{_group_chi(e, 'm.n', 'm.g{}')[1]}D")),
        ("p_group", _chi_tail("m.group_chi", "(m.groups - 1)")),
        ("bits", "translate(m.x, m.abc, concat(repeat('0', CAST(floor(m.k / 2) AS INT)), repeat('1', m.k - CAST(floor(m.k / 2) AS INT))))"),
        ("n1", "CAST(length(replace(m.bits, '0', '')) AS DOUBLE)"),
        ("mu", "1D + 2D * m.n1 * (m.n - m.n1) / m.n"),
        ("p_runs", _two_sided(f"(({changes} - m.mu) / sqrt(greatest((m.mu - 1D) * (m.mu - 2D) / (m.n - 1D), 1e-9D)))")),
        ("v", "transform(split(m.x, '', m.n), c -> CAST(instr(m.abc, c) AS DOUBLE))"),
        ("mean", "aggregate(m.v, 0D, (a, y) -> a + y) / m.n"),
        ("var", "aggregate(m.v, 0D, (a, y) -> a + (y - m.mean) * (y - m.mean))"),
        ("r", "IF(m.var > 0, aggregate(zip_with(slice(m.v, 1, m.n - 1), slice(m.v, 2, m.n - 1), (a, b) -> (a - m.mean) * (b - m.mean)), 0D, (a, y) -> a + y) / m.var, 1D)"),
        ("p_serial", _two_sided("((m.r + 1D / m.n) * sqrt(CAST(m.n AS DOUBLE)))")),
        ("p", "least(1D, 4D * least(m.p_chi, m.p_group, m.p_runs, m.p_serial))"),
        *((f"z_{style}", per(lambda e, style=style: _style_z(e, style, "m.n", "m.g{}"))) for style in STYLES),
        ("z", f"least({', '.join(f'm.z_{style}' for style in STYLES)})"),
        ("p_words", f"CASE WHEN m.z > 0 THEN {_two_sided('m.z')} / 2 ELSE 1D END"),
        ("class", "CAST(floor(log2(CAST(m.n AS DOUBLE))) AS INT)"),
        ("grid", f"CAST(least({DEEPEST}, floor(-{GRID} * log2(greatest(m.p_words, 1e-300D)))) AS INT)"),
    ]


RESULTS = ("s", "e", "x", "encoding", "n", "p_chi", "p_group", "p_runs", "p_serial", "p", "p_words", "class", "grid")


def randomness(rows: DataFrame, column: str) -> DataFrame:
    """Adds the tests to every struct<s, e, x> of an array column: the fields of ``RESULTS``. Few fields are carried along at a time."""
    have = ["s", "e", "x"]
    for name, value in _steps():
        fields = ", ".join(f"m.{f} AS {f}" for f in have)
        rows = rows.withColumn(column, F.expr(f"transform({column}, m -> struct({fields}, {value} AS {name}))"))
        have.append(name)
    return rows.withColumn(column, F.expr(f"transform({column}, m -> struct({', '.join(f'm.{f} AS {f}' for f in RESULTS)}))"))


def limits_by_class(tests: DataFrame, rate: float, refuse: float) -> DataFrame:
    """(class, grid, p) of all candidates -> (class, limit): those at or past the limit, and not refused as patterns, are reported.
    One row a class; a class is a power of two, so there are at most 31."""
    counts = tests.groupBy("class", "grid").agg(F.count("*").alias("n"), F.count(F.when(F.col("p") >= refuse, 1)).alias("good"))
    upto = W.partitionBy("class").orderBy(F.col("grid").desc())
    stepped = counts.withColumn("k", F.sum("good").over(upto)).withColumn("m", F.sum("n").over(W.partitionBy("class")))
    return stepped.where(F.pow(F.lit(2.0), -F.col("grid") / GRID) * F.col("m") <= rate * F.col("k")).groupBy("class").agg(F.min("grid").alias("limit"))


ITEM = "struct<s:int,k:int,e:int,x:string>"


def scan_secrets(docs: DataFrame, *, rate: float = 0.05, refuse: float = 0.01, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, the columns of ``keep``, n_assign, n_access, n_hex, base_sha256, spans, and ``found``: start,
    kind (0 to 3) and end of every span in the order of start, then kind. Texts are scanned once; no shuffle but of counts."""
    assign = f"filter({matches('text', quoted(ASSIGN), group=2)}, m -> length(m.y) >= 8)"
    tag = lambda column, rank: f"transform({column}, m -> struct(m.s AS s, {rank} AS k, m.e AS e))"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)
    rows = rows.withColumn("a", F.expr(gated(f"text RLIKE {quoted('(?i)passw|secret|token|api_?key')}", assign)))
    rows = rows.withColumn("c", F.expr(gated("contains(text, 'AKIA')", matches("text", quoted(ACCESS)))))
    rows = rows.withColumn("h", F.expr(gated("text RLIKE '[0-9a-f]{32}'", matches("text", quoted(HEX)))))
    mixed = f"filter({matches('text', quoted(RUN))}, m -> m.x RLIKE '[0-9]' AND m.x RLIKE '[A-Za-z]')"
    rows = rows.withColumn("r", F.expr(gated(f"text RLIKE '[A-Za-z0-9+/_-]{{{LEAST}}}'", mixed)))
    rows = rows.withColumn("base", F.expr(f"array_sort(concat({tag('a', 0)}, {tag('c', 1)}, {tag('h', 2)}))"))
    # Runs that no base match overlaps, by two sweeps: the furthest end of a match before, the nearest start of one behind.
    both = "array_sort(concat(transform(base, b -> struct(b.s AS s, b.k AS k, b.e AS e, CAST(NULL AS STRING) AS x)), transform(r, m -> struct(m.s AS s, 3 AS k, m.e AS e, m.x AS x))))"
    ahead = folded(both, "0", ITEM, lambda p: f"IF(z.k < 3, greatest({p}, z.e), {p})", "z.k < 3 OR r.p <= z.s", "z")
    clear = folded(f"reverse({ahead})", "2147483647", ITEM, lambda p: f"IF(z.k < 3, least({p}, z.s), {p})", "z.k = 3 AND z.e <= r.p", "z")
    rows = rows.withColumn("r", F.expr(f"CASE WHEN size(r) > 0 AND size(base) > 0 THEN transform(reverse({clear}), m -> struct(m.s AS s, m.e AS e, m.x AS x)) ELSE transform(r, m -> struct(m.s AS s, m.e AS e, m.x AS x)) END"))
    scratch = Scratch(docs.sparkSession, "secrets")
    rows = scratch.keep(randomness(rows.select("doc_id", *keep, "base", "r"), "r"), "tested")
    limits = limits_by_class(rows.where(F.size("r") > 0).select(F.explode("r").alias("m")).select("m.class", "m.grid", "m.p"), rate, refuse).collect()
    limit = F.create_map(*(F.lit(x) for row in limits for x in (row["class"], row["limit"]))) if limits else F.expr(f"map(0, {DEEPEST + 1})")
    kept = f"filter(r, m -> m.p >= {refuse} AND m.grid >= coalesce(limits[m.class], {DEEPEST + 1}))"
    rows = rows.withColumn("limits", limit).withColumn("found", F.expr(f"array_sort(concat(base, {tag(kept, 3)}))"))
    count = lambda k: F.expr(f"CAST(size(filter(base, b -> b.k = {k})) AS BIGINT)")
    return rows.select("doc_id", *keep, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(F.expr(_spans("base")), 256).alias("base_sha256"), F.expr(_spans("found")).alias("spans"), "found")


def _spans(column: str) -> str:
    kinds = "array('assign', 'access', 'hex', 'random')"
    return f"array_join(transform({column}, b -> concat(element_at({kinds}, b.k + 1), ':', b.s, ':', b.e)), ',')"


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents")).drop("found")


def redact_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """Documents with every found span replaced by ``mark`` and n_chars counted anew; documents without one are unchanged.

    Spans are applied in the order of start; one that starts within what is cut before only lengthens the cut."""
    scanned = scan_secrets(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")), keep=("row",))
    end = "struct(CAST(length(row.text) AS INT) AS s, 4 AS k, CAST(length(row.text) AS INT) AS e)"
    # pieces are cut from an encoding of fixed width: substring() of a string counts from its start each time
    pieces = folded(f"concat(found, array({end}))", "0", "string", lambda p: f"greatest({p}, z.e)", "z.s >= r.p", "decode(substring(b, 4 * r.p + 1, 4 * (z.s - r.p)), 'UTF-32')")
    cut = f"transform(array(encode(row.text, 'UTF-32')), b -> array_join({pieces}, '{mark}'))[0]"
    hit = F.size("found") > 0
    new = {"text": F.when(hit, F.expr(cut)).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.length(new["text"])).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return scanned.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def _sql(rate: float = 0.05, refuse: float = 0.01) -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'"
    kinds = " UNION ALL ".join(f"SELECT i, {k} AS k, regexp_extract_all(t, {text(p)}) AS m, regexp_extract_all(t, {text(p)}, {g}) AS y, regexp_split_to_array(t, {text(p)}) AS g FROM d WHERE regexp_matches(t, {text(p)})" for k, (p, g) in enumerate(((ASSIGN, 2), (ACCESS, 0), (HEX, 0), (RUN, 0))))
    size = lambda x: f"coalesce(list_sum(list_transform({x}, lambda z: length(z))), 0)"
    encoding = "CASE " + " ".join(f"WHEN regexp_full_match(x, '[{chars}]+') THEN '{n}'" for n, chars in ENCODINGS) + " ELSE 'base64url' END"
    per = lambda f: "CASE encoding " + " ".join(f"WHEN '{e}' THEN {f(e)}" for e in ALPHABETS) + " END"
    shares = ", ".join(f"CAST(length(regexp_replace(x, '[^{g}]', '', 'g')) AS DOUBLE) AS g{i}" for i, g in enumerate(g.replace("+/-_", "+/_-") for g in GROUPS))

    def tail(z: str) -> str:
        w = f"(abs({z}) / sqrt(2e0))"
        t = f"(1e0 / (1e0 + 0.3275911e0 * {w}))"
        return f"({t} * (0.254829592e0 + {t} * (-0.284496736e0 + {t} * (1.421413741e0 + {t} * (-1.453152027e0 + {t} * 1.061405429e0)))) * exp(-{w} * {w}))"

    def chi_tail(chi: str, free: str) -> str:
        third = f"(2e0 / (9e0 * {free}))"
        z = f"((power({chi} / {free}, 1e0 / 3) - (1e0 - {third})) / sqrt({third}))"
        return f"CASE WHEN {z} > 0 THEN {tail(z)} / 2 ELSE 1e0 - {tail(z)} / 2 END"

    return f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS t FROM documents),
x AS ({kinds}),
s AS (SELECT i, k, {size("g[1:j]")} + {size("m[1:j - 1]")} AS s, m[j] AS x, y[j] AS y FROM (SELECT *, unnest(range(1, len(m) + 1)) AS j FROM x)),
b AS (SELECT i, k, s, s + length(x) AS e FROM s WHERE k < 3 AND (k > 0 OR length(y) >= 8)),
c0 AS (
  SELECT i, s, x, length(x) AS n, {encoding} AS encoding, {shares} FROM s WHERE k = 3 AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]')
  AND NOT EXISTS (SELECT 1 FROM b WHERE b.i = s.i AND b.s < s.s + length(s.x) AND s.s < b.e)),
c1 AS (
  SELECT *, {per(lambda e: f"'{ALPHABETS[e]}'")} AS abc, {per(lambda e: _group_chi(e, "n", "g{}")[0])} AS group_chi, {per(lambda e: str(_group_chi(e, "n", "g{}")[1]))} AS groups,
         least({", ".join(per(lambda e, style=style: _style_z(e, style, "n", "g{}")) for style in STYLES)}) AS z FROM c0),
c2 AS (SELECT *, length(abc) AS k, list_transform(range(1, n + 1), lambda j: CAST(strpos(abc, x[j]) AS DOUBLE)) AS v FROM c1),
c3 AS (
  SELECT *, k / CAST(n AS DOUBLE) * list_sum(list_transform(range(1, k + 1), lambda j: CAST((n - length(replace(x, abc[j], ''))) ** 2 AS DOUBLE))) - n AS chi,
         list_transform(v, lambda y: y > k // 2) AS bits, list_sum(v) / n AS mean FROM c2),
c4 AS (
  SELECT *, CAST(len(list_filter(bits, lambda y: y)) AS DOUBLE) AS n1, CAST(1 + len(list_filter(range(1, n), lambda j: bits[j] <> bits[j + 1])) AS DOUBLE) AS runs,
         list_sum(list_transform(v, lambda y: (y - mean) * (y - mean))) AS var, list_sum(list_transform(range(1, n), lambda j: (v[j] - mean) * (v[j + 1] - mean))) AS cov FROM c3),
c5 AS (SELECT *, 1e0 + 2e0 * n1 * (n - n1) / n AS mu, CASE WHEN var > 0 THEN cov / var ELSE 1e0 END AS r FROM c4),
c6 AS (
  SELECT i, s, s + n AS e, CAST(floor(log2(n)) AS INT) AS class, CASE WHEN z > 0 THEN {tail("z")} / 2 ELSE 1e0 END AS p_words,
         4e0 * least({chi_tail("chi", "(k - 1)")}, {chi_tail("group_chi", "(groups - 1)")}, {tail("((runs - mu) / sqrt(greatest((mu - 1e0) * (mu - 2e0) / (n - 1e0), 1e-9)))")}, {tail("((r + 1e0 / n) * sqrt(CAST(n AS DOUBLE)))")}) >= {refuse} AS good FROM c5),
c7 AS (SELECT *, CAST(least({DEEPEST}, floor(-{GRID} * log2(greatest(p_words, 1e-300)))) AS INT) AS grid FROM c6),
h AS (SELECT class, grid, count(*) FILTER (good) OVER (PARTITION BY class ORDER BY grid DESC) AS k, count(*) OVER (PARTITION BY class) AS m FROM c7),
l AS (SELECT class, min(grid) AS stop FROM h WHERE 2e0 ** (-grid / {GRID}e0) * m <= {rate} * k GROUP BY class),
f AS (SELECT i, k, s, e FROM b UNION ALL SELECT i, 3, s, e FROM c7 JOIN l ON c7.class = l.class WHERE good AND grid >= l.stop),
o AS (
  SELECT i, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS c, count(*) FILTER (k = 2) AS h,
         string_agg(concat(['assign', 'access', 'hex'][k + 1], ':', s, ':', e), ',' ORDER BY s, k) FILTER (k < 3) AS base,
         string_agg(concat(['assign', 'access', 'hex', 'random'][k + 1], ':', s, ':', e), ',' ORDER BY s, k) AS spans FROM f GROUP BY i)
SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(c, 0) AS BIGINT) AS n_access, CAST(coalesce(h, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN o ON d.i = o.i
"""


QUERIES = {"op8_secret_scan": op8_secret_scan}
ORACLES = {"op8_secret_scan": _sql()}
