"""Quality rules: a threshold table compiled into one projection, without user functions.

Words are ``[^\\x20\\x09-\\x0D]+``. Every rule names a ratio and the closed
interval in which a text passes; the table becomes one boolean column, so a
filter on it runs in the scan's own stage and moves no rows between tasks.

Null and empty texts have no words: all counts are 0, ``base_failed`` is true
and ``kept`` false. An empty table gives an empty result. Very long texts are measured whole;
positions of words have 28 bits, and a text of a string column has fewer words. A ratio
that ties with a bound passes. Ids are not read. Repeated rows give repeated results. Results
replace kept columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Frequent function words of the languages in scope.
STOP_WORDS = (
    "the and of to in is that for with it as on was be at by or from this an are "
    "der die das und ist von mit nicht ein eine zu auf für im den sie es "
    "le la les de des et un une que qui dans pour est en du il elle par sur avec au "
    "los las el y una con por para del se su al lo no"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes if ``low <= ratio <= high``; ``ratio`` is SQL over the counts."""

    name: str
    ratio: str
    low: float
    high: float


#: Over the counts of ``measure``; n_words is at least 1 where they are evaluated.
RULES = (
    Rule("word_length", "word_chars / n_words", 2.0, 12.0),
    Rule("symbols", "n_symbols / word_chars", 0.0, 0.1),
    Rule("stop_words", "n_stop_words / n_words", 0.04, 1.0),
    Rule("duplicate_lines", "n_dup_lines / n_lines", 0.0, 0.5),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_INDEX_BITS = 28


def _repeated_words() -> list[dict[str, Column]]:
    """Projections, one after the other, that count the words in 3-word windows found twice or more.

    Windows are packed as (36 bits of hash, 28 bits of position) and sorted as
    longs; the positions whose hash bits recur are then compared word by word.
    Each step is a projection of its own because Spark evaluates an expression
    that is inlined into a lambda once for each element.
    """
    mask = (1 << _INDEX_BITS) - 1
    return [
        {"__p": F.expr(f"if(size(__w) < 3, cast(array() as array<bigint>), sort_array(transform(sequence(0, greatest(size(__w), 3) - 3), i -> (xxhash64(__w[i], __w[i + 1], __w[i + 2]) & {-mask - 1}L) | i)))")},
        {"__c": F.expr(f"transform(filter(__p, (x, k) -> shiftright(x ^ get(__p, k - 1), {_INDEX_BITS}) = 0 or shiftright(x ^ get(__p, k + 1), {_INDEX_BITS}) = 0), x -> cast(x & {mask}L as int))")},
        {"__s": F.expr("sort_array(transform(__c, i -> struct(__w[i] as a, __w[i + 1] as b, __w[i + 2] as c, i as i)))")},
        {"__r": F.expr("sort_array(transform(filter(__s, (x, k) -> (x.a = get(__s, k - 1).a and x.b = get(__s, k - 1).b and x.c = get(__s, k - 1).c) or (x.a = get(__s, k + 1).a and x.b = get(__s, k + 1).b and x.c = get(__s, k + 1).c)), x -> x.i))")},
        {"n_repeat_words": F.expr("aggregate(transform(__r, (p, k) -> coalesce(least(3, get(__r, k + 1) - p), 3)), 0L, (s, x) -> s + x)")},
    ]


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words")


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the counts that the rules are written over."""
    whole = F.coalesce(F.col(text), F.lit(""))
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    out = df.drop(*COUNTS).withColumns({
        "__w": F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)),
        "__l": F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD)),
    })
    out = out.withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.length(F.translate(whole, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("__l").cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "n_stop_words": F.expr(f"size(filter(__w, x -> lower(rtrim('.,;:!?', x)) in ({stop})))").cast("long"),
    })
    for step in _repeated_words():
        out = out.withColumns(step)
    # a generator of one row: a filter over the counts would else be pushed into the scan with all their steps inlined, each many times
    once = F.explode(F.array(F.struct(*COUNTS))).alias("__m")
    return out.select(*(c for c in df.columns if c not in COUNTS), once).select("*", "__m.*").drop("__m")


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one boolean expression."""
    passed = F.lit(True)
    for r in rules:
        passed &= F.coalesce(F.expr(r.ratio.replace(" / ", " / nullif(") + ", 0)"), F.lit(0.0)).between(r.low, r.high)
    return passed


def apply_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with the counts, base_failed and kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measure(df.drop("base_failed", "kept"), text).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


RESULT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return apply_rules(docs).select(*RESULT)


def _oracle() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    rules = " and ".join(f"coalesce({r.ratio.replace(' / ', ' / nullif(')}, 0), 0) between {r.low} and {r.high}" for r in RULES)
    return rf"""
with words as (
  select doc_id, coalesce(text, '') as body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents),
windows as (select doc_id, w, unnest(range(1, len(w) - 1)) as i from words where len(w) >= 3),
found as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as n from windows),
covered as (
  select doc_id, count(distinct j) as n from (select doc_id, unnest([i, i + 1, i + 2]) as j from found where n > 1) group by doc_id),
counts as (
  select words.doc_id, len(w)::bigint as n_words, length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, len(l)::bigint as n_lines,
         (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
         len(list_filter(w, lambda x: lower(rtrim(x, '.,;:!?')) in ({stop})))::bigint as n_stop_words,
         coalesce(covered.n, 0)::bigint as n_repeat_words
  from words left join covered using (doc_id)),
judged as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from counts)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {rules} as kept
from judged
"""


ORACLE_SQL = _oracle()
