"""License scans by ordered signature rules, with DataFrame and SQL functions only.

A text is ASCII-lower-cased and taken as words, each written between its own two blanks, so that a signature is an ordinary regular
expression over whole words and places are counted in words. The rules (``license_rules``) are hand-written, some 320. No rule runs
on a text that holds no stem of any (``GATE``); of the others a rule runs only on texts that hold its keyword, which is looked up once for
all its rules. A detection whose words lie within those of one of its own or a better priority is suppressed; of equal spans
the better priority stays, then the earlier rule. One sweep in order of start decides all of a text.

Null and empty texts have no words and no labels. Very long texts are scanned whole; the cost of a text grows with the power
1.5 of its detections at most. Rows are returned one for one, repeated rows and null doc_id too. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, table
from .license_rules import parsed
from .native import folded, matches, quoted

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: What a text must hold for any rule to match: all stems of one line and, where there is one, its expression. Stems are looked
#: up as plain strings, which costs a tenth of an expression with as many alternatives.
GATE = (
    (("licen",), ""), (("spdx",), ""), (("gpl",), ""), (("copyright",), ""), (("rights", "reserved"), ""), (("public", "domain"), ""), (("wtfpl",), ""), (("cddl",), ""), (("eupl",), ""), (("cc0",), ""), (("commons",), ""), (("bsd",), ""),
    (("apache",), ""), (("mozilla",), ""), (("openssl",), ""), (("openrail",), ""), (("odbl",), ""), (("hereby", "granted"), ""), (("redistribut",), ""), (("misrepresented",), ""), (("altered", "plainly"), ""), (("unencumbered",), ""), (("noninfringement",), ""),
    (("endorse", "promote"), ""), (("advertising", "acknowledgement"), ""), (("reproduced", "part"), ""), (("confidential",), ""), (("warranty",), ""), (("illinois", "developed"), ""), (("prior", "written", "permission"), ""), (("same", "terms", "perl"), ""), (("fuck",), ""),
    (("attribution", "mit"), ""), (("only", "internal"), ""), (("only", "commercial"), ""), (("only", "personal"), ""), (("only", "research"), ""), (("only", "evaluation"), ""),
    (("cc", "by"), r"cc[^a-z0-9]+by"), (("mpl",), r"(?<![a-z0-9])mpl(?![a-z0-9])"), (("epl",), r"(?<![a-z0-9])epl(?![a-z0-9])"),
    *(((name, "under"), r"(?:released|distributed|available|published|provided)[^a-z0-9]+under") for name in ("mit", "expat", "isc", "zlib", "ofl")),
)
WEIGHT = {0: 0.4, 1: 1.0, 2: 0.9, 3: 0.8, 4: 0.6, 5: 0.5}


def signature(words: str) -> str:
    """Words in the notation of ``NAMES`` as a regular expression over words that stand between their own blanks."""
    out = []
    for token in words.split():
        maybe, token = token.endswith("?"), token.rstrip("?")
        choice = "|".join(f" {w} " for w in token.strip("()").split("|"))
        out.append(f"(?:{choice})" + "?" * maybe if maybe or "|" in choice else choice)
    return "".join(out)


def rules() -> list[tuple[int, str, str, str]]:
    """(priority, label, keyword, pattern) in the order of precedence."""
    return [(priority, label, f" {keyword} ", signature(words)) for priority, label, keyword, words in parsed()]


TIERS = (1, 2, 3, 4, 5)
COUNT = "CAST((length({0}) - length(replace({0}, ' ', ''))) / 2 AS INT)"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and ``found``, the
    detections that stay: start, end (words from 0, end exclusive), tier, label. No shuffle."""
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_ascii("text"), F.lit(BREAK), F.lit("  "))), F.lit(" "))
    opens = " OR ".join("(" + " AND ".join([*(f"contains(t, '{stem}')" for stem in stems), *([f"t RLIKE {quoted(pattern)}"] if pattern else [])]) + ")" for stems, pattern in GATE)
    gate = F.expr(f"transform(array(lower(text)), t -> {opens})[0]")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.regexp_count("text", F.lit(RAW_WORD)), F.lit(0)).cast("long").alias("n_words"), F.when(gate, words).alias("w"))
    base = ", ".join(f"struct({quoted(signature(phrase))} AS r, '{label}' AS l)" for phrase, label in BASE)
    places = matches("w", "b.r", COUNT)
    rows = rows.withColumn("base", F.expr(f"CASE WHEN w IS NULL THEN NULL ELSE flatten(transform(filter(array({base}), b -> contains(w, b.r)), b -> transform({places}, m -> struct(m.s AS s, m.e AS e, b.l AS l)))) END"))
    by_keyword: dict[str, list[str]] = {}
    for order, (tier, label, keyword, pattern) in enumerate(rules()):
        by_keyword.setdefault(keyword, []).append(f"struct({tier} AS t, {order} AS o, '{label}' AS l, {quoted(pattern)} AS r)")
    table_ = ", ".join(f"struct('{keyword}' AS k, array({', '.join(own)}) AS rules)" for keyword, own in by_keyword.items())
    ready = f"filter(flatten(transform(filter(array({table_}), g -> contains(w, g.k)), g -> g.rules)), b -> regexp_like(w, b.r))"
    detect = f"flatten(transform({ready}, b -> transform({places}, m -> struct(m.s AS s, -m.e AS e, b.t AS t, b.o AS o, b.l AS l))))"
    rows = rows.withColumn("all", F.expr(f"CASE WHEN w IS NULL THEN NULL ELSE array_sort({detect}) END"))
    # A sweep by start, then longest, then best rule: whatever can contain a detection comes before it. r1 to r5: the furthest end so far in a priority or a better one.
    ends = lambda p: "struct(" + ", ".join(f"IF(z.t <= {t}, greatest({p}.r{t}, -z.e), {p}.r{t}) AS r{t}" for t in TIERS) + ")"
    inside = "CASE z.t " + " ".join(f"WHEN {t} THEN r.p.r{t}" for t in TIERS) + " END"
    start = "struct(" + ", ".join(f"-1 AS r{t}" for t in TIERS) + ")"
    rows = rows.withColumn("found", F.expr(folded("all", start, "struct<s:int,e:int,t:int,l:string>", ends, f"{inside} < -z.e", "struct(z.s AS s, -z.e AS e, z.t AS t, z.l AS l)")))
    names = lambda x: f"array_join(array_sort(array_distinct({x})), ',')"
    tier = "CASE WHEN size(found) > 0 THEN array_min(transform(found, d -> d.t)) WHEN size(base) > 0 THEN 0 END"
    weights = " ".join(f"WHEN {t} THEN {w}D" for t, w in WEIGHT.items())
    return rows.selectExpr(
        "doc_id", "n_words", "CAST(coalesce(size(base), 0) AS BIGINT) AS n_base", "CAST(array_min(transform(base, d -> d.s)) AS BIGINT) AS first_word", "CAST(array_max(transform(base, d -> d.s)) AS BIGINT) AS last_word",
        f"coalesce({names('transform(base, d -> d.l)')}, '') AS base_labels", f"coalesce({names('concat(transform(base, d -> d.l), transform(found, d -> d.l))')}, '') AS labels", f"CASE {tier} {weights} ELSE 0D END AS score", "found",
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("found")


def _sql() -> str:
    text = lambda s: "'" + s.replace("'", "''") + "'"
    base = ", ".join(f"({text(signature(p))}, {text(label)}, 0, 0, ' ')" for p, label in BASE)
    table_ = ", ".join(f"({text(p)}, {text(label)}, {tier}, {i}, {text(k)})" for i, (tier, label, k, p) in enumerate(rules()))
    ends = ", ".join(f"max(CASE WHEN t <= {t} THEN s + n END) OVER o AS r{t}" for t in TIERS)
    own = " ".join(f"WHEN {t} THEN r{t}" for t in TIERS)
    weights = " ".join(f"WHEN f.t = {t} THEN {WEIGHT[t]}" for t in TIERS)
    n = lambda x: f"(length({x}) - length(replace({x}, ' ', ''))) // 2"
    return rf"""
WITH w AS (
  SELECT row_number() OVER () AS i, doc_id, len(regexp_extract_all(coalesce(text, ''), '{RAW_WORD}')) AS n_words,
         ' ' || trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BREAK}', '  ', 'g'), ' ') || ' ' AS w FROM documents),
r AS (SELECT * FROM (VALUES {base}, {table_}) AS v(p, l, t, o, k)),
m AS (SELECT i, l, t, o, regexp_extract_all(w, p) AS m, regexp_split_to_array(w, p) AS g FROM w JOIN r ON contains(w, k) WHERE regexp_matches(w, p)),
d AS (
  SELECT i, l, t, o, list_sum(list_transform(g[1:j], lambda x: {n("x")})) + coalesce(list_sum(list_transform(m[1:j - 1], lambda x: {n("x")})), 0) AS s, {n("m[j]")} AS n
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS j FROM m)),
k AS (SELECT *, {ends}
      FROM d WHERE t > 0 WINDOW o AS (PARTITION BY i ORDER BY s, s + n DESC, t, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT i, min(t) AS t, list(l) AS l FROM k WHERE NOT coalesce(CASE t {own} END >= s + n, false) GROUP BY i),
b AS (SELECT i, count(*) AS n, min(s) AS a, max(s) AS z, list(l) AS l FROM d WHERE t = 0 GROUP BY i)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(b.a AS BIGINT) AS first_word, CAST(b.z AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(list_distinct(b.l)), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.l, []), coalesce(f.l, [])))), ','), '') AS labels,
       CAST(CASE {weights} WHEN b.n > 0 THEN {WEIGHT[0]} ELSE 0 END AS DOUBLE) AS score
FROM w LEFT JOIN b ON w.i = b.i LEFT JOIN f ON w.i = f.i
"""


QUERIES = {"op2_license_scan": op2_license_scan}
ORACLES = {"op2_license_scan": _sql()}
