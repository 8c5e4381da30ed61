"""Quality rules as a ledger of bits.

Every text is measured once, whole, however long it is. The ledger keeps, for each document, the measurements and one
long whose bit k says that rule k failed, and is written to a table. A policy is a version and a mask of rules; applying
one is a bitwise AND over the ledger, with no text read again, and what a rule does alone or beside others (an ablation)
is a bitwise aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import extended, record_batch, slices, stored, utf8, view

WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_word_bytes", "n_alpha_words", "n_marked_words", "n_bullet_lines", "n_ellipsis_lines", "n_stutters"]
_LEDGER = pa.schema([("row_id", pa.int64()), *[(m, pa.int64()) for m in MEASURES]])

_SPACES = [0x20, *range(0x09, 0x0E)]
_SYMBOLS = list(b"#*$%&|<>")
_NO_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())


#: Rule k is bit k. Bits are never given another meaning; a changed rule gets a new bit.
RULES: list[tuple[str, Callable[[Callable[[str], Column]], Column]]] = [
    ("few_words", lambda c: c("n_words") < 20),
    ("repeated_words", lambda c: 100 * c("n_repeat_words") > 30 * c("n_words")),
    ("many_symbols", lambda c: 10 * c("n_symbols") > 3 * c("n_words")),
    ("shouting", lambda c: 100 * c("n_upper") > 30 * c("n_letters")),
    ("long_words", lambda c: c("word_chars") > 14 * c("n_words")),
    ("short_words", lambda c: c("word_chars") < 2 * c("n_words")),
    ("few_alpha_words", lambda c: 100 * c("n_alpha_words") < 70 * c("n_words")),
    ("repeated_lines", lambda c: (100 * c("n_dup_lines") > 30 * c("n_lines")) & (c("n_lines") >= 5)),
    ("bullets", lambda c: (100 * c("n_bullet_lines") > 90 * c("n_lines")) & (c("n_lines") >= 5)),
    ("ellipses", lambda c: (100 * c("n_ellipsis_lines") > 30 * c("n_lines")) & (c("n_lines") >= 5)),
    ("marked_words", lambda c: 100 * c("n_marked_words") > 30 * c("n_words")),
    ("many_words", lambda c: c("n_words") > 1_000_000),
    ("stutter", lambda c: 100 * c("n_stutters") > 30 * c("n_words")),
]
BIT = {name: k for k, (name, _) in enumerate(RULES)}
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """A version of what rejects a document: the rules of which one failure is enough."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << BIT[r] for r in self.rules)


#: In v1 the rules that look at the words themselves; v2 adds those on a text's form.
POLICIES = {
    p.version: p
    for p in (
        Policy("base", BASE),
        Policy("v1", (*BASE, "many_symbols", "long_words", "short_words", "few_alpha_words")),
        Policy("v2", (*BASE, "many_symbols", "shouting", "long_words", "short_words", "few_alpha_words", "bullets", "ellipses", "marked_words", "stutter")),
    )
}
PRODUCTION = "v2"


def repeated(ids: np.ndarray, n_distinct: int, window: int = WINDOW) -> int:
    """Words of ids (0..n_distinct-1) in windows that occur twice or more. Exact: as many words as fit into 63 bits
    are packed, and packs are renumbered by rank before they are packed further."""
    n = len(ids) - window + 1
    if n < 2 or n_distinct == len(ids):
        return 0
    keys, width, distinct = ids.astype(np.int64), 1, n_distinct
    while width < window:
        bits = max(1, int(distinct - 1).bit_length())
        times = 1
        while width * times * 2 <= window and bits * times * 2 <= 63:
            times *= 2
        if times == 1:  # two packs don't fit into 63 bits: never for fewer than 2^31 different ones
            raise OverflowError("too many different words in a text")
        m = len(keys) - width * (times - 1)
        packed = np.zeros(m, np.int64)
        for j in range(times):
            packed = (packed << bits) | keys[j * width : j * width + m]
        width *= times
        if width < window:
            values, keys = np.unique(packed, return_inverse=True)
            distinct = len(values)
        else:
            keys = packed
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    cover = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    words = text.split()  # of bytes: at [\x20\x09-\x0D]+
    n = len(words)
    if not n:
        return (0,) * 5 + (text.count(b"\n") + 1,) + (0,) * 8  # no words: no other counts
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    spaces = int(hist[_SPACES].sum())
    points = len(text) - int(hist[0x80:0xC0].sum())
    upper = int(hist[65:91].sum())
    letters = upper + int(hist[97:123].sum())
    number = dict.fromkeys(words)
    number = dict(zip(number, range(len(number))))
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    times = np.bincount(ids, minlength=len(number))
    alpha = np.fromiter((bool(w.translate(None, _NO_LETTERS)) for w in number), bool, len(number))
    marked = np.fromiter((w[-1] in b"!#*$%&|<>" for w in number), bool, len(number))
    lines = text.split(b"\n")
    full = [x for x in lines if x and not x.isspace()]
    heads = [x.lstrip()[:3] for x in full]
    return (
        n,
        points - spaces,
        int(hist[_SYMBOLS].sum()),
        len(full) - len(set(full)),
        repeated(ids, len(number)),
        len(lines),
        letters,
        upper,
        len(text) - spaces,
        int(times[alpha].sum()),
        int(times[marked].sum()),
        sum(x[:1] in (b"-", b"*") or x == "•".encode() for x in heads),
        sum(x.rstrip().endswith((b"...", "…".encode())) for x in full),
        int((ids[1:] == ids[:-1]).sum()),
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [measure(t) for t in utf8(batch["text"])]
        yield record_batch(_LEDGER, {"row_id": batch["row_id"]} | {m: [r[k] for r in rows] for k, m in enumerate(MEASURES)})


def _bits(df: DataFrame, mark: str = "") -> DataFrame:
    """df with failures, from the measurements, the names of all of which begin with mark."""
    bits = F.lit(0).cast("long")
    for k, (_, failed) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(failed(lambda m: F.col(f"`{mark}{m}`")), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return df.withColumn(f"{mark}failures", bits)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: row_id (the id), the measurements and failures, the bitmask of RULES.

    Null text counts as empty: no words, so that few_words fails. Ids aren't looked at: null or repeated ones give
    a row each. An empty table gives no rows.
    """
    return _bits(view(docs, row_id=id_col, text=text_col).select(F.col("row_id").cast("long"), "text").mapInArrow(_measure, "row_id long, " + ", ".join(f"{m} long" for m in MEASURES)))


def rejected(policy: Policy, failures: str = "failures") -> Column:
    return F.col(f"`{failures}`").bitwiseAND(F.lit(policy.mask)) != 0


def ablation(book: DataFrame, policy: Policy) -> DataFrame:
    """One row per rule of the policy: rule, n_failed (documents that fail it), n_only (that no other rule of the
    policy rejects: those that dropping the rule would bring back), n_kept_without. From the ledger alone."""
    hit = F.col("failures").bitwiseAND(F.lit(policy.mask))
    counts = book.select(hit.alias("hit")).groupBy("hit").agg(F.count("*").alias("n"))  # at most 2^rules rows a task
    rules = [(r, 1 << BIT[r]) for r in policy.rules]
    aggs = [F.sum(F.when(F.col("hit").bitwiseAND(F.lit(b)) != 0, F.col("n")).otherwise(0)).alias(f"f_{r}") for r, b in rules]
    aggs += [F.sum(F.when(F.col("hit") == b, F.col("n")).otherwise(0)).alias(f"o_{r}") for r, b in rules]
    totals = counts.agg(F.sum(F.when(F.col("hit") == 0, F.col("n")).otherwise(0)).alias("kept"), *aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("n_failed"), F.col(f"o_{r}").alias("n_only"), (F.col("kept") + F.col(f"o_{r}")).alias("n_kept_without")) for r, _ in rules]))
    return totals.select(rows.alias("x")).select(*[F.coalesce(f"x.{k}", F.lit(0)).alias(k) if k != "rule" else F.col("x.rule") for k in ("rule", "n_failed", "n_only", "n_kept_without")])


def with_ledger(docs: DataFrame, mark: str = "", text_col: str = "text") -> DataFrame:
    """The rows of docs with their lines of the ledger beside them: the measurements and failures, their names behind mark."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [measure(t) for t in utf8(batch.column(batch.schema.get_field_index(text_col)))]
            extra = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*names, *[f"{mark}{m}" for m in MEASURES]])

    return _bits(docs.mapInArrow(run, extended(docs, {f"{mark}{m}": "long" for m in MEASURES})), mark)


def quality_filter(docs: DataFrame, policy: Policy = POLICIES[PRODUCTION], text_col: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps, with all their columns: the mask over a ledger that is written beside the
    rows. Null text is rejected where few_words is a rule. Every column may be null in the result."""
    names, mark = docs.columns, "__m_"
    while any(x.startswith(mark) for x in names):
        mark = f"_{mark}"
    book = stored(with_ledger(docs, mark, text_col), "ledger")
    return book.filter(~rejected(policy, f"{mark}failures")).select(*[F.col(f"`{x}`") for x in names])


def verdicts(book: DataFrame, policy: Policy = POLICIES[PRODUCTION]) -> DataFrame:
    """One row per line of a ledger: doc_id, the first five measurements, base_failed, kept and failures."""
    base = rejected(POLICIES["base"])
    return book.select(F.col("row_id").alias("doc_id"), *MEASURES[:5], base.alias("base_failed"), (~base & ~rejected(policy)).alias("kept"), "failures")


def report(docs: DataFrame, policy: Policy = POLICIES[PRODUCTION]) -> DataFrame:
    """verdicts over a ledger of docs, which is written first."""
    return verdicts(stored(ledger(docs), "ledger"), policy)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def quality_ablation(spark, sf_dir: str) -> DataFrame:
    """What each rule of the production policy does, from a stored ledger."""
    return ablation(stored(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), "ledger"), POLICIES[PRODUCTION])


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, string_split(t, chr(10)) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i : i + 7]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM k WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
    length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper,
    len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS alpha, len(list_filter(ws, lambda x: regexp_matches(x, '[!#*$%&|<>]$'))) AS marked,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS bullets, len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS ellipses,
    len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS stutters
  FROM w LEFT JOIN r USING (doc_id)),
b AS (
  SELECT *, CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * upper > 30 * letters THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 14 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 100 * alpha < 70 * n_words THEN 64 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 30 * n_lines AND n_lines >= 5 THEN 128 ELSE 0 END
    + CASE WHEN 100 * bullets > 90 * n_lines AND n_lines >= 5 THEN 256 ELSE 0 END + CASE WHEN 100 * ellipses > 30 * n_lines AND n_lines >= 5 THEN 512 ELSE 0 END
    + CASE WHEN 100 * marked > 30 * n_words THEN 1024 ELSE 0 END + CASE WHEN n_words > 1000000 THEN 2048 ELSE 0 END
    + CASE WHEN 100 * stutters > 30 * n_words THEN 4096 ELSE 0 END AS failures
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures & 6015 = 0 AS kept, failures::BIGINT AS failures FROM b
"""

_RULES_SQL = ", ".join(f"('{r}', {1 << BIT[r]})" for r in POLICIES[PRODUCTION].rules)
ABLATION_SQL = f"""
WITH book AS ({SQL.strip()}), hits AS (SELECT failures & {POLICIES[PRODUCTION].mask} AS hit FROM book)
SELECT rule, count(*) FILTER (hit & bit <> 0) AS n_failed, count(*) FILTER (hit = bit) AS n_only, count(*) FILTER (hit = 0 OR hit = bit) AS n_kept_without
FROM (VALUES {_RULES_SQL}) r(rule, bit), hits GROUP BY rule
"""
