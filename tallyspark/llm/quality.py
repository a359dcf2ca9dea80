"""Quality rules as a ledger of bit masks.

Every rule is evaluated once for each document; the ledger keeps the measurements and one bit
for each failed rule. Policies are named, versioned masks over those bits, so a new policy or an
ablation reads the ledger and never the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, free_name, table

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")

#: Bit -> (name, what a failing document fulfils); ``m`` gives the column of a measurement.
RULES = (
    ("few_words", lambda m: m("n_words") < 50),
    ("repeated_words", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
    ("many_words", lambda m: m("n_words") > 200_000),
    ("short_mean_word", lambda m: m("word_chars") < 2 * m("n_words")),
    ("long_mean_word", lambda m: m("word_chars") > 15 * m("n_words")),
    ("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    ("repeated_lines", lambda m: 100 * m("n_dup_lines") > 50 * m("n_lines")),
    ("capitals", lambda m: 100 * m("n_upper") > 60 * m("n_letters")),
)
BASE = 0b00000011


@dataclass(frozen=True)
class Policy:
    """A document passes if it failed none of the rules in ``mask``."""

    name: str
    version: int
    mask: int


#: The third version of the strict policy no longer rejects for length alone.
POLICIES = (Policy("base", 1, BASE), Policy("strict", 1, 0b00111111), Policy("strict", 2, 0b11111111), Policy("strict", 3, 0b11111011))
CURRENT = POLICIES[-1]


def _measure(text: str | None) -> tuple[int, ...]:
    text = text or ""
    raw = text.encode()
    words = raw.split()  # splits at ASCII white space
    n = len(words)
    repeated = 0
    if n > 3:
        ids: dict[bytes, int] = {}
        seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        size = len(ids)
        _, pair = np.unique(seq[:-1] * size + seq[1:], return_inverse=True)
        _, kind, times = np.unique(pair[:-1] * size + seq[2:], return_inverse=True, return_counts=True)
        again = np.flatnonzero(times[kind] > 1)
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[again + k] = True
        repeated = int(covered.sum())
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    codes = np.frombuffer(raw, np.uint8)
    upper = int(((codes >= 65) & (codes <= 90)).sum())
    letters = upper + int(((codes >= 97) & (codes <= 122)).sum())
    return (n, len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), upper, letters)


def with_ledger(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the ledger's columns, and their names by measurement and for ``failed``."""
    names = {m: free_name(m, docs) for m in (*MEASURES, "failed")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col):
            rows = np.array([_measure(x) for x in batch[text_col].to_pylist()], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(rows[:, i]) for i in range(len(MEASURES)))], [*batch.schema.names, *(names[m] for m in MEASURES)])

    measured = docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(names[m], T.LongType()) for m in MEASURES)]))
    bits = [F.when(fails(lambda m: F.col(names[m])), F.lit(1 << r)).otherwise(F.lit(0)) for r, (_, fails) in enumerate(RULES)]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn(names["failed"], failed.cast("long")), names


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, measurements, ``failed`` (bit r: rule r failed).

    A null or empty text has no words and so fails the first rule. Rows that are repeated, or share
    an id (null ids, too), are judged each by itself. Whole texts count, however long. Other columns, whatever their
    names, are not read. An empty table gives an empty ledger. Map-only.
    """
    rows, names = with_ledger(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__text")
    return rows.select(F.col("__id").alias(id_col), *(names[m] for m in MEASURES), names["failed"])


def passes(policy: Policy, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(policy.mask)) == 0


def ablations(rows: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """What each rule of ``policy`` does: documents that fail it, that fail it alone (dropping the
    rule would keep them), and that the policy without it keeps. Reads one row for each distinct mask."""
    masks = rows.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(name).alias("name"), F.lit(1 << r).cast("long").alias("bit")) for r, (name, _) in enumerate(RULES) if policy.mask >> r & 1))
    each = masks.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.*")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return each.groupBy("rule", "name").agg(total(hit).alias("n_failed"), total(hit & rest).alias("n_failed_alone"), total(rest).alias("n_kept_without"))


def keep_good(docs: DataFrame, policy: Policy = CURRENT, text_col: str = "text") -> DataFrame:
    """The documents that pass by their ledger, with all their columns, whatever those are called; nulls, repeated rows
    and empty tables as in ``ledger``. Map-only."""
    rows, names = with_ledger(docs, text_col)
    return rows.filter(passes(policy, names["failed"])).select(*(f"`{c}`" for c in docs.columns))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablations(ledger(table(spark, sf_dir, "documents")))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed").bitwiseAND(F.lit(BASE)) != 0).alias("base_failed"),
        (passes(POLICIES[0]) & passes(CURRENT)).alias("kept"),
        "failed",
    )


OP4_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
k AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) > 2),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM k),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
      FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
        length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::BIGINT AS n_letters FROM w),
a AS (SELECT m.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM m LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
        + CASE WHEN n_words > 200000 THEN 4 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END
        + CASE WHEN word_chars > 15 * n_words THEN 16 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 32 ELSE 0 END
        + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 64 ELSE 0 END
        + CASE WHEN 100 * n_upper > 60 * n_letters THEN 128 ELSE 0 END)::BIGINT AS failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed & 3 <> 0 AS base_failed, failed & 251 = 0 AS kept, failed FROM b
"""

ABLATIONS_SQL = f"""
WITH f AS (SELECT failed & {CURRENT.mask} AS bits FROM ({OP4_SQL})),
r AS (SELECT unnest({[r for r in range(len(RULES)) if CURRENT.mask >> r & 1]}) AS rule, unnest({[n for r, (n, _) in enumerate(RULES) if CURRENT.mask >> r & 1]}) AS name)
SELECT rule::INTEGER AS rule, name, count(*) FILTER (bits >> rule & 1 = 1) AS n_failed, count(*) FILTER (bits = 1 << rule) AS n_failed_alone,
       count(*) FILTER (bits & ~(1 << rule) = 0) AS n_kept_without
FROM f, r GROUP BY rule, name
"""
