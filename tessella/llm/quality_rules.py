"""Quality rules as a short-circuit cascade of SQL expressions.

Each rule rejects by features of the text. On a hash sample of whole texts, read in one job, the rules' rejections are
counted jointly and their costs estimated from the characters and words that their features go through. The rule with
the most rejections per cost comes first, then that with the most among what it leaves, at the cost of the features
not yet computed, and so on. Each rule is a filter of its own behind the features that it needs, so a document that
one rejects is not looked at by the next. The verdict is the conjunction of all rules, so it depends neither on the
order nor on the sample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import computed_once

#: White space between words, and the symbols that are counted.
SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"
#: Rows of the sample, about; and at most.
SAMPLE_ROWS, SAMPLE_LIMIT = 1024, 4096


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def window_hashes(w: Column) -> Column:
    """A 64-bit hash of each 3-word window of the array w, which must be a column."""
    return F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    )


def placed(h: Column) -> Column:
    """Sorted (hash, position) pairs of the array h of window hashes; empty where no hash repeats."""
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("int").alias("i"))))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(pairs)


def repeated(s: Column) -> Column:
    """Sorted positions of the pairs of the column s whose hash repeats."""
    same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
    found = F.filter(s, lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
    return F.sort_array(F.transform(found, lambda x: x["i"]))


def covered(p: Column) -> Column:
    """Words in the 3-word windows at the sorted positions of the column p."""
    return F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x
    )


@dataclass(frozen=True)
class Feature:
    """A column made of those in needs (TEXT: the text) by build; its cost in nanoseconds for a character and a word."""

    needs: tuple[str, ...]
    build: Callable[..., Column]
    per_char: float
    per_word: float


TEXT = "text"
#: Costs as measured on one core, text in memory; only their proportions matter.
FEATURES: dict[str, Feature] = {
    "words": Feature((TEXT,), words, 20, 100),
    "windows": Feature(("words",), window_hashes, 0, 900),
    "places": Feature(("windows",), placed, 0, 700),
    "repeats": Feature(("places",), repeated, 0, 50),
    "n_words": Feature(("words",), lambda w: F.size(w).cast("long"), 0, 0),
    "word_chars": Feature(("words",), lambda w: F.length(F.array_join(w, "")).cast("long"), 2, 10),
    "n_symbols": Feature((TEXT,), lambda t: F.regexp_count(t, F.lit(SYMBOLS)).cast("long"), 9, 0),
    "n_dup_lines": Feature((TEXT,), n_dup_lines, 6, 0),
    "n_repeat_words": Feature(("repeats",), covered, 0, 10),
    "n_shouts": Feature((TEXT,), lambda t: F.regexp_count(t, F.lit("!!")).cast("long"), 8, 0),
}


@dataclass(frozen=True)
class Rule:
    """rejects: a condition on the columns of the features, in their order."""

    name: str
    features: tuple[str, ...]
    rejects: Callable[..., Column]


#: The base rules are the first two.
RULES = (
    Rule("short", ("n_words",), lambda n: n < 50),
    Rule("repeats", ("n_words", "n_repeat_words"), lambda n, r: 100 * r > 50 * n),
    Rule("symbols", ("n_words", "n_symbols"), lambda n, s: 10 * s > n),
    Rule("shouts", ("n_words", "n_shouts"), lambda n, s: 10 * s > n),
    Rule("word length", ("n_words", "word_chars"), lambda n, c: (c < 2 * n) | (c > 16 * n)),
    Rule("repeated lines", ("n_words", "n_dup_lines"), lambda n, d: 10 * d > n),
)
BASE = ("short", "repeats")
#: Columns that the registered query returns for every row.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_OWN = "__rules_"


def _needed(names: Iterable[str], features: dict[str, Feature], have: set[str]) -> list[str]:
    """names and what they are made of, without have, in the order in which they can be computed."""
    out: list[str] = []
    for name in names:
        if name != TEXT and name not in have and name not in out:
            out += [x for x in _needed(features[name].needs, features, have | set(out))] + [name]
    return out


def _with(df: DataFrame, names: Iterable[str], features: dict[str, Feature], have: set[str]) -> DataFrame:
    """df with the features, as columns whose names start with _OWN; have is brought up to date."""
    for name in _needed(names, features, have):
        df = df.withColumn(_OWN + name, features[name].build(*[F.col(_OWN + x) for x in features[name].needs]))
        have.add(name)
    return df


def _with_text(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.withColumn(_OWN + TEXT, F.coalesce(F.col(text_col), F.lit("")))


def _rejects(rule: Rule, inline: dict[str, Column] | None = None) -> Column:
    """The rule's condition, false for null, on columns of features but for those that inline has."""
    columns = {f: F.col(_OWN + f) for f in rule.features} | (inline or {})
    return F.coalesce(rule.rejects(*[columns[f] for f in rule.features]), F.lit(False))


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", features: dict[str, Feature] = FEATURES) -> list[Rule]:
    """rules by rejections per cost on a sample, each among what those before it leave; ties keep their order.

    The sample takes rows by a hash of their simple columns, about SAMPLE_ROWS of them, texts whole.
    """
    simple = [f.name for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    share = max(1, docs.count() // SAMPLE_ROWS)
    sample = docs.where(F.pmod(F.xxhash64(*simple), F.lit(share)) == 0).select(F.col(text_col).alias(TEXT)).limit(SAMPLE_LIMIT)
    have: set[str] = set()
    found = _with(_with_text(sample, TEXT), [*dict.fromkeys(f for r in rules for f in r.features), "n_words"], features, have)
    verdicts = [_rejects(r).alias(f"r{k}") for k, r in enumerate(rules)]
    found = found.select(*verdicts, F.length(_OWN + TEXT).alias("chars"), F.col(_OWN + "n_words").alias("n"))
    kinds = found.groupBy(*[f"r{k}" for k in range(len(rules))]).agg(F.count("*").alias("rows"), F.sum("chars").alias("chars"), F.sum("n").alias("n")).collect()  # 2 ** rules at most

    ordered: list[Rule] = []
    done: set[str] = set()
    while len(ordered) < len(rules):
        chars, n = sum(k["chars"] for k in kinds), sum(k["n"] for k in kinds)

        def worth(rule: Rule) -> float:
            cost = sum(features[f].per_char * chars + features[f].per_word * n for f in _needed(rule.features, features, done))  # noqa: B023
            return sum(k["rows"] for k in kinds if k[f"r{rules.index(rule)}"]) / (cost + 1)  # noqa: B023

        best = max((r for r in rules if r not in ordered), key=worth)
        ordered.append(best)
        done |= set(_needed(best.features, features, done))
        kinds = [k for k in kinds if not k[f"r{rules.index(best)}"]]
    return ordered


def apply_rules(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with the features REPORTED (names after prefix), base_failed and kept, in place of columns of these names.

    Words are runs of characters other than space and U+0009 to U+000D; a null or empty text has none, so the rule
    for short texts rejects it; texts of any length are taken whole. n_dup_lines: lines with a word equal to an earlier
    one; n_repeat_words: words in 3-word windows that the text has twice or more, by a 64-bit hash of the window.
    base_failed: a base rule rejects; kept: no rule does. The features REPORTED are computed for every row; other
    features only where no rule earlier in the cascade rejects. Rows are independent, ids are not looked at: rows that
    repeat get equal verdicts. An empty table gives no rows.
    """
    have: set[str] = set()
    out = _with(_with_text(docs, text_col), REPORTED, FEATURES, have)
    base = F.lit(False)
    for rule in (r for r in RULES if r.name in BASE):
        base = base | _rejects(rule)
    kept = F.when(base, False)
    for rule in (r for r in order_rules(docs, RULES, text_col) if r.name not in BASE):
        # the branches of a condition are evaluated in turn, so what is inlined here only where none before it holds
        late = {f: FEATURES[f].build(F.col(_OWN + TEXT)) for f in rule.features if f not in have}
        kept = kept.when(_rejects(rule, late), False)
    columns = {prefix + f: F.col(_OWN + f) for f in REPORTED} | {f"{prefix}base_failed": base, f"{prefix}kept": kept.otherwise(True)}
    return out.withColumns(columns).drop(*[_OWN + f for f in [TEXT, *have]])


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, features: dict[str, Feature] = FEATURES) -> DataFrame:
    """The rows of docs that no rule rejects, with their columns as they were; a filter for each rule, in the order of the cascade."""
    out, have = _with_text(docs, text_col), set()
    for rule in order_rules(docs, rules, text_col, features):
        out = computed_once(_with(out, rule.features, features, have), ~_rejects(rule))
    return out.select(*docs.columns)


#: The features and rules in DuckDB SQL, over documents(doc_id, text).
SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY 1),
f AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_words,
    length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len(regexp_extract_all(text, '!!'))::BIGINT AS n_shouts
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 10 * n_shouts > n_words
    OR word_chars < 2 * n_words OR word_chars > 16 * n_words OR 10 * n_dup_lines > n_words) AS kept
FROM f
"""
