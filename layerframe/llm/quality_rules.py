"""Quality rules as a short-circuit cascade of native expressions.

Each rule names the condition under which a document is rejected, and the work that asking it takes: characters that its
expressions go through. On a bounded sample the cascade takes both from the same rows and orders the rules greedily: next
comes the rule with most rejections per work among the rows that still reach it, so most rejected documents never reach the
dear rules. Work is counted, not timed, so reruns give one order whatever else the machine does. The order changes
the cost, never the verdict.

`judge` adds the counts that its contract asks for, so these are computed for every document and rules that only compare them
cost nothing more. `keep` returns the kept rows alone: there every count is computed inside the rule that needs it, and
only for documents that reach the rule.

Defined results: a null or empty text has no words and fails the base rules; extra columns pass through, those named as a result are replaced,
and names that start with _rules_ are reserved;
repeated rows and ties are judged row by row; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, Scratch, let, split_words

SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the same text.

    Windows are compared by a 64-bit hash. Only texts in which some hash repeats sort (hash, place) pairs, so the
    cost is n log n in the words, whatever the text repeats.
    """
    def windows(w: Column) -> Column:
        one = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        return F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), one)).otherwise(
            F.array().cast("array<bigint>")
        )

    def repeated(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        places = lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])), lambda x: x["p"]
        ))
        covered = lambda p: F.aggregate(
            F.transform(p, lambda v, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - v, F.lit(3)))),
            F.lit(0).cast("bigint"), lambda a, b: a + b,
        )
        return let(let(pairs, places), covered)

    return let(let(words, windows), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(repeated(h)))


def dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))


def features(text: Column, words: Column) -> dict[str, Column]:
    """What rules may look at, as expressions of a text without nulls and its words."""
    return {
        "text": text,
        "n_words": F.size(words).cast("bigint"),
        "word_chars": F.length(F.regexp_replace(text, WHITE, "")).cast("bigint"),
        "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("bigint"),
        "n_dup_lines": dup_lines(text),
        "n_repeat_words": repeat_words(words),
    }


def base_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the five base counts (long) for every whole text."""
    made = features(F.coalesce(F.col(text), F.lit("")), F.col("_rules_w"))
    return df.withColumn("_rules_w", split_words(F.col(text))).withColumns({k: made[k] for k in BASE}).drop("_rules_w")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """rejects and work get the features by name; done: the names that are finished columns, whose work is paid already."""

    name: str
    rejects: Callable[[dict[str, Column]], Column]
    work: Callable[[dict[str, Column], frozenset[str]], Column] = lambda f, done: F.lit(1.0)


def _scan(f: dict[str, Column], done: frozenset[str], name: str, times: float) -> Column:
    return F.lit(0.0) if name in done else times * F.length(f["text"])


def _once(f: dict[str, Column], name: str, body: Callable[[Column], Column]) -> Column:
    """body(feature) with the feature computed once."""
    return body(f[name]) if f.get("finished") else let(f[name], body)


#: Characters gone through for each character of the text, about, by what the expression does with it.
SCAN, CLASSES, SORT = 1.0, 2.0, 6.0


def base_rules() -> list[Rule]:
    return [
        Rule("few_words", lambda f: f["n_words"] < 50),
        Rule("repeated_words", lambda f: 100 * f["n_repeat_words"] > 50 * f["n_words"], lambda f, done: 1 + _scan(f, done, "n_repeat_words", SORT)),
    ]


def default_rules() -> list[Rule]:
    """Lenient document rules beyond the base ones. Each holds for a document of n_words > 0."""
    letters = lambda f: F.length(F.regexp_replace(f["text"], "[^\\p{L}]+", ""))
    upper = lambda f: F.length(F.regexp_replace(f["text"], "[^\\p{Lu}]+", ""))
    n_lines = lambda f: F.size(F.split(f["text"], "\n"))
    return [
        Rule("word_length", lambda f: _once(f, "word_chars", lambda c: (c < 2 * f["n_words"]) | (c > 15 * f["n_words"])), lambda f, done: 1 + _scan(f, done, "word_chars", SCAN)),
        Rule("symbols", lambda f: 10 * f["n_symbols"] > f["n_words"], lambda f, done: 1 + _scan(f, done, "n_symbols", SCAN)),
        Rule(
            "repeated_lines", lambda f: _once(f, "n_dup_lines", lambda n: (n >= 3) & (10 * n > 3 * n_lines(f))),
            lambda f, done: 1 + _scan(f, done, "n_dup_lines", CLASSES) + (F.when(f["n_dup_lines"] >= 3, SCAN * F.length(f["text"])).otherwise(0.0) if "n_dup_lines" in done else 0.0)),
        Rule("shouting", lambda f: 10 * upper(f) > 4 * letters(f), lambda f, done: 1 + 2 * CLASSES * F.length(f["text"])),
        Rule("few_letters", lambda f: 2 * letters(f) < f["word_chars"], lambda f, done: 1 + CLASSES * F.length(f["text"]) + _scan(f, done, "word_chars", SCAN)),
    ]


def sample_of(df: DataFrame, rows: int) -> DataFrame:
    """About `rows` rows, drawn within each partition: nothing is dealt out for it."""
    return df.sample(min(1.0, rows / max(1, df.count())), seed=7)


def finished(df: DataFrame, text: str = "text") -> dict:
    """The features that df has as columns, by name."""
    return {"text": F.coalesce(F.col(text), F.lit("")), "finished": True} | {k: F.col(k) for k in BASE if k in df.columns}


def order_rules(sample: DataFrame, rules: list[Rule], text: str = "text", done: frozenset[str] = frozenset(BASE)) -> list[Rule]:
    """The rules by rejection per work among the rows that reach them. sample: few rows with finished features; done: those that need no
    work when the rules are asked. Rows with the same verdicts are summed, so at most one row per set of verdicts reaches the driver."""
    f = finished(sample, text)
    masks = F.concat(*[F.when(F.coalesce(r.rejects(f), F.lit(False)), F.lit("1")).otherwise(F.lit("0")) for r in rules])
    works = [F.sum(F.coalesce(r.work(f, done), F.lit(0)).cast("double")).alias(f"w{i}") for i, r in enumerate(rules)]
    left = sample.groupBy(masks.alias("mask")).agg(F.count("*").alias("n"), *works).collect()
    todo, out = list(range(len(rules))), []
    while todo:
        def gain(i: int) -> tuple:
            work = sum(x[f"w{i}"] for x in left)
            rejected = sum(x["n"] for x in left if x["mask"][i] == "1")
            return -rejected / max(work, 1e-9), work, rules[i].name

        best = min(todo, key=gain)
        todo.remove(best)
        out.append(rules[best])
        left = [x for x in left if x["mask"][best] == "0"]
    return out


def cascade(rules: list[Rule], f: dict[str, Column]) -> Column:
    """True if no rule rejects. CASE stops at the first rule that does."""
    out = F.when(F.lit(False), F.lit(True))
    for rule in rules:
        out = out.when(F.coalesce(rule.rejects(f), F.lit(False)), F.lit(False))
    return out.otherwise(F.lit(True))


def _sampled(df: DataFrame, text: str, rows: int) -> DataFrame:
    return base_features(sample_of(df.select(text), rows), text)


def judge(df: DataFrame, text: str = "text", sample_rows: int = 2000) -> DataFrame:
    """df with the base counts, base_failed and kept; the base rules are asked first, then the ordered cascade."""
    out = base_features(df, text).withColumn("base_failed", base_failed())
    rules = order_rules(_sampled(df, text, sample_rows), default_rules(), text)
    base = Rule("base", lambda f: F.col("base_failed"))
    return out.withColumn("kept", cascade([base, *rules], finished(out, text)))


def keep(df: DataFrame, text: str = "text", sample_rows: int = 2000) -> DataFrame:
    """The rows of df that judge keeps, without its counts: all rules, the base ones too, in one cascade."""
    rules = order_rules(_sampled(df, text, sample_rows), [*base_rules(), *default_rules()], text, frozenset({"n_words"}))
    t = F.coalesce(F.col(text), F.lit(""))
    return df.where(let(split_words(F.col(text)), lambda w: cascade(rules, features(t, w))))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", *BASE, "base_failed", "kept")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
pos AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 3),
win AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM pos),
dup AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win),
cov AS (SELECT DISTINCT doc_id, i + d AS p FROM dup, (SELECT unnest([0, 1, 2]) AS d) WHERE n >= 2),
rep AS (SELECT doc_id, count(*) AS n FROM cov GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n, count(*) AS k FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (
  SELECT w.doc_id, coalesce(text, '') AS text, len(ws)::BIGINT AS n_words,
    length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dl USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS letters, length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS upper_letters,
    len(string_split(text, chr(10))) AS n_lines FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words
    OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines) OR 10 * upper_letters > 4 * letters OR 2 * letters < word_chars) AS kept
FROM b
"""
