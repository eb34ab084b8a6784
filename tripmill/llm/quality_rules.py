"""Quality rules as a ledger: every rule is evaluated once, failures are bits of one integer, policies are masks.

``ledger`` measures whole texts and sets one bit for each rule that fails; the measurements stay beside the bits. ``stored_ledger``
writes it to the shared folder, once. A policy is a version, the mask of the rules that it enforces, and nothing else, so a new
policy or an ablation never reads a text again: ``apply_policy`` is one bitwise AND a row and ``ablation`` one aggregate over the
distinct masks, both over the stored ledger.

Null and empty texts have no words and fail ``few_words``. Rows are returned one for one, repeated rows too, and a null
doc_id stays null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, byte_column, small_slices, table
from .textkernel import word_hashes, word_spans

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper")

#: The rules in the order of their bits, each as SQL text over the measurements; true means that it fails.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbol_heavy", "10 * n_symbols > n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 3 * n_words"),
    ("long_words", "word_chars > 12 * n_words"),
    ("shouting", "2 * n_upper > n_letters"),
    ("few_letters", "2 * n_letters < word_chars"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Policies by version: the rules that each enforces.
POLICIES = {
    1: ("few_words", "repeated_windows"),
    2: ("few_words", "repeated_windows", "symbol_heavy", "short_words", "long_words", "shouting", "few_letters"),
    3: tuple(BIT),
}
BASE, CURRENT = 1, 2


def mask(version: int) -> int:
    return sum(BIT[name] for name in POLICIES[version])


def _ids(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def repeated_words(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text, the words inside windows of WINDOW words that occur at least twice in it. Windows are named exactly, by
    doubling: a name of 2k words is a pair of names of k words."""
    n, texts = len(words), len(first) - 1
    out = np.zeros(texts, np.int64)
    if n < WINDOW:
        return out
    doc = np.repeat(np.arange(texts), np.diff(first))
    name, width = _ids(words), 1
    while width < WINDOW:
        pair = name[:-width] * n + name[width:]
        name, width = _ids(pair), 2 * width
    whole = doc[: len(name)] == doc[WINDOW - 1 :]
    at = np.flatnonzero(whole)
    _, inverse, often = np.unique(doc[at] * n + name[at], return_inverse=True, return_counts=True)
    at = at[often[inverse] > 1]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    covered = np.cumsum(cover[:n]) > 0
    np.add.at(out, doc[covered], 1)
    return out


def _per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


CLASSES = {c: np.isin(np.arange(256), list(codes)) for c, codes in {
    "start": [*range(0x80), *range(0xC0, 0x100)],
    "symbol": b"#*$%&|<>",
    "upper": range(65, 91),
    "letter": [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)],
}.items()}


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in small_slices(whole, "text"):
            buf, offs = byte_column(batch.column(1))
            words, first = word_hashes(buf, offs)
            starts, ends, _ = word_spans(buf, offs) if len(buf) else (np.zeros(0, np.int64),) * 2 + (None,)
            chars = np.zeros(len(buf) + 1, np.int64)
            np.cumsum(CLASSES["start"][buf], out=chars[1:])
            length = np.zeros(len(starts) + 1, np.int64)
            np.cumsum(chars[ends] - chars[starts], out=length[1:])
            dup, lines = np.zeros(len(offs) - 1, np.int64), np.zeros(len(offs) - 1, np.int64)
            data = buf.tobytes()
            for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
                full = [x for x in data[a:b].split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
                lines[i], dup[i] = len(full), len(full) - len(set(full))
            columns = {
                "n_words": np.diff(first), "word_chars": length[first[1:]] - length[first[:-1]], "n_symbols": _per_text(CLASSES["symbol"][buf], offs), "n_dup_lines": dup,
                "n_repeat_words": repeated_words(words, first), "n_lines": lines, "n_letters": _per_text(CLASSES["letter"][buf], offs), "n_upper": _per_text(CLASSES["upper"][buf], offs),
            }
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(columns[m].astype(np.int64)) for m in MEASURES)], names=["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and ``failed``: bit i is set if rule i fails. No shuffle; columns other than the two are not read."""
    measured = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(measure, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = (F.when(F.expr(rule), F.lit(BIT[name])).otherwise(0) for name, rule in RULES)
    return measured.withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long"))


def stored_ledger(docs: DataFrame) -> DataFrame:
    """The ledger as a table that policies and ablations read instead of texts."""
    return Scratch(docs.sparkSession, "ledger").keep(ledger(docs), "ledger")


def apply_policy(rows: DataFrame, version: int = CURRENT, name: str = "kept") -> DataFrame:
    """Adds ``name``: none of the policy's rules fails."""
    return rows.withColumn(name, F.col("failed").bitwiseAND(F.lit(mask(version))) == 0)


def ablation(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """One row a rule of a policy: how many rows fail it, fail it alone within the policy (and so come back if the rule is
    dropped), and how many the policy keeps with and without it. Works on the distinct masks, not on the rows; those may be counted
    already, as ``n``."""
    m = mask(version)
    count = F.sum("n") if "n" in rows.columns else F.count("*")
    masks = rows.groupBy(F.col("failed").bitwiseAND(F.lit(m)).alias("failed")).agg(count.alias("n"))
    rules = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name in POLICIES[version]))
    each = masks.withColumn("r", F.explode(rules))
    hit = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return each.groupBy("r.rule", "r.bit").agg(
        hit(F.col("failed").bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"), hit(F.col("failed") == F.col("r.bit")).alias("n_only"), hit(F.col("failed") == 0).alias("n_kept"),
        hit(F.col("failed").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0).alias("n_kept_without"),
    )


def ablations(rows: DataFrame) -> DataFrame:
    """The ablation of every policy, with its ``version``; all from one aggregate over the distinct masks of the ledger."""
    masks = rows.groupBy("failed").agg(F.count("*").alias("n"))
    each = [ablation(masks, v).withColumn("version", F.lit(v)) for v in POLICIES]
    return reduce(DataFrame.unionByName, each)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored_ledger(table(spark, sf_dir, "documents"))
    for version in POLICIES:
        rows = apply_policy(rows, version, f"kept_v{version}")
    return rows.select("doc_id", *MEASURES, (~F.col(f"kept_v{BASE}")).alias("base_failed"), F.col(f"kept_v{CURRENT}").alias("kept"), *(f"kept_v{v}" for v in POLICIES), "failed")


def op1_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablations(stored_ledger(table(spark, sf_dir, "documents")))


LEDGER_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
         row_number() OVER () AS r
  FROM documents),
g AS (SELECT r, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM d) GROUP BY r),
m AS (
  SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper,
         CAST(length(t) - length(regexp_replace(t, '[A-Za-z\x{80}-\x{10FFFF}]', '', 'g')) AS BIGINT) AS n_letters
  FROM w LEFT JOIN c ON w.r = c.r),
f AS (
  SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
         + 8 * (100 * n_dup_lines > 30 * n_lines)::INT + 16 * (word_chars < 3 * n_words)::INT + 32 * (word_chars > 12 * n_words)::INT
         + 64 * (2 * n_upper > n_letters)::INT + 128 * (2 * n_letters < word_chars)::INT AS BIGINT) AS failed
  FROM m)
"""
SQL = LEDGER_SQL + """SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_letters, n_upper, failed & 3 <> 0 AS base_failed, failed & 247 = 0 AS kept,
  failed & 3 = 0 AS kept_v1, failed & 247 = 0 AS kept_v2, failed & 255 = 0 AS kept_v3, failed FROM f"""
ABLATION_SQL = LEDGER_SQL + """, p AS (SELECT * FROM (VALUES (1, 3), (2, 247), (3, 255)) AS v(version, m)),
r AS (SELECT * FROM (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbol_heavy', 4), ('duplicate_lines', 8), ('short_words', 16), ('long_words', 32), ('shouting', 64), ('few_letters', 128)) AS v(rule, bit))
SELECT version, rule, CAST(bit AS BIGINT) AS bit, CAST(sum((failed & bit <> 0)::INT) AS BIGINT) AS n_failed, CAST(sum((failed & m = bit)::INT) AS BIGINT) AS n_only, CAST(sum((failed & m = 0)::INT) AS BIGINT) AS n_kept,
  CAST(sum((failed & m & ~bit = 0)::INT) AS BIGINT) AS n_kept_without FROM f CROSS JOIN p JOIN r ON m & bit <> 0 GROUP BY version, rule, bit"""
QUERIES = {"op1_quality_rules": op1_quality_rules, "ablation_quality_rules": op1_ablation}
ORACLES = {"op1_quality_rules": SQL, "ablation_quality_rules": ABLATION_SQL}
