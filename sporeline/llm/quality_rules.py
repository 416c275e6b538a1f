"""Quality rules: a threshold table compiled into one projection of native functions.

Nulls and empty texts count as texts without words, and so fail the base rules. Repeated rows and repeated
doc_ids are judged row by row, and texts of any length alike. Extra columns of the input don't matter; a kept column with
the name of a result column is returned with "kept_" before its name. An empty table gives an empty result.
Rules on the length of words and on stop words speak only of texts that are mostly written in Latin letters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sporeline.llm._shared import let, table

# The white space that parts words, and the characters that count as symbols.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

# Common function words of English, German, French, Spanish, Portuguese, Italian, Dutch, Polish, Turkish and Swedish.
STOP_WORDS = """
the of and to in is that it for on with as was be by are this an or from at have not
der die das und zu den von mit sich des auf für ist im dem nicht ein eine als auch es an
le la les de des et un une du en que qui dans est pour au sur par ne se plus pas avec
el los las y del se por con no una su para como más al lo o pero sus
os um uma não com do da em ao il di che per sono gli della het een van dat met niet voor
nie się na jest że jak ale bir ve bu için ile daha och att som på är inte med av
""".split()


@dataclass(frozen=True)
class Rule:
    """Keeps a document if low <= 100 * count / per <= high; a bound that is None doesn't hold.

    It speaks only of documents with at_least words, and if latin only of those with Latin letters for half of their characters.
    """

    name: str
    count: str
    per: str
    low: int | None
    high: int | None
    at_least: int = 0
    latin: bool = False


#: Counts are those of measures(); bounds are in hundredths.
RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 1500, latin=True),
    Rule("symbols", "n_symbols", "n_words", None, 30),
    Rule("stop_words", "n_stop_words", "n_words", 1, None, at_least=60, latin=True),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 50),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 30),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 90),
)
MIN_WORDS, MAX_REPEATED, WINDOW = 10, 20, 5


def _repeated(words: Column) -> Column:
    """Words in windows of WINDOW words that the text has twice or more.

    Windows are compared by a 64-bit hash. A text without a repeated window needs no sort. Otherwise windows are
    sorted by hash with their positions, and each repeated one adds the words that no earlier one has covered.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(pairs, lambda s: F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"])))
        at = F.sort_array(F.transform(F.filter(twice, lambda x: x.isNotNull()), lambda x: x["i"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(at, start, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n")), lambda a: a["n"])

    return F.when(F.size(words) <= WINDOW, 0).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))))


def measures(text: Column) -> Column:
    """A struct of the counts that rules speak of."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")

    def counts(w: Column) -> Column:
        n = lambda c, name: c.cast("long").alias(name)
        return F.struct(
            n(F.size(w), "n_words"), n(F.length(F.array_join(w, "")), "word_chars"),
            n(F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))), "n_stop_words"), n(_repeated(w), "n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        n = lambda c, name: c.cast("long").alias(name)
        return F.struct(
            n(F.size(x), "n_lines"), n(F.size(x) - F.size(F.array_distinct(x)), "n_dup_lines"),
            n(F.size(F.filter(x, lambda s: s.endswith("...") | s.endswith("…"))), "n_ellipsis_lines"),
            n(F.size(F.filter(x, lambda s: F.substring(s, 1, 1).isin("-", "*", "•"))), "n_bullet_lines"),
        )

    def of_class(chars: str, name: str) -> Column:
        """Characters of a class, as what a text loses without their runs; regexp_count would make a string of each one."""
        return F.coalesce(F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", "")), F.lit(0)).cast("long").alias(name)

    return F.struct(let(words, counts).alias("w"), let(lines, of_lines).alias("l"), of_class(SYMBOLS, "n_symbols"), of_class("A-Za-z", "n_latin"))


def base_failed(of=F.col) -> Column:
    return (of("n_words") < MIN_WORDS) | (100 * of("n_repeat_words") > MAX_REPEATED * of("n_words"))


def verdict(rules: tuple[Rule, ...] = RULES, of=F.col) -> Column:
    """The rules as one boolean expression over the counts; of gives a count's column by its name."""
    kept = F.lit(True)
    for r in rules:
        per = of(r.per)
        holds = F.lit(True)
        if r.low is not None:
            holds &= 100 * of(r.count) >= r.low * per
        if r.high is not None:
            holds &= 100 * of(r.count) <= r.high * per
        kept &= holds | (of("n_words") < r.at_least) | (2 * of("n_latin") < of("word_chars") if r.latin else F.lit(False))
    return kept


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns with the counts, base_failed and kept, for each row of docs."""
    kept = F.struct(*(docs[c].alias(f"kept_{c}" if c.lower() in RESULT else c) for c in keep))
    counts = docs.select(kept.alias("row"), measures(docs[text]).alias("m")).select("row", "m.w.*", "m.l.*", "m.n_symbols", "m.n_latin")
    return counts.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & verdict(rules)}).select("row.*", *RESULT)


RESULT = ("n_words", "word_chars", "n_stop_words", "n_repeat_words", "n_lines", "n_dup_lines", "n_ellipsis_lines", "n_bullet_lines", "n_symbols", "n_latin", "base_failed", "kept")


def kept_rows(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns. The counts are made once for each row."""
    w, lines = ("n_words", "word_chars", "n_stop_words", "n_repeat_words"), ("n_lines", "n_dup_lines", "n_ellipsis_lines", "n_bullet_lines")

    def judged(m: Column) -> Column:
        of = lambda name: m["w"][name] if name in w else m["l"][name] if name in lines else m[name]
        return ~base_failed(of) & verdict(rules, of)

    return docs.where(let(measures(docs[text]), judged))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_rules(rules: tuple[Rule, ...] = RULES) -> str:
    parts = []
    for r in rules:
        both = [f"100 * {r.count} >= {r.low} * {r.per}"] * (r.low is not None) + [f"100 * {r.count} <= {r.high} * {r.per}"] * (r.high is not None)
        parts.append(f"({' AND '.join(both)} OR n_words < {r.at_least}{' OR 2 * n_latin < word_chars' * r.latin})")
    return " AND ".join(parts)


ORACLE_SQL = f"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS l
  FROM documents
), win AS (
  SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM t WHERE len(w) >= {WINDOW})
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY r
), c AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::BIGINT AS n_latin,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(l)::BIGINT AS n_lines,
         len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))})))::BIGINT AS n_stop_words,
         len(list_filter(l, lambda x: ends_with(x, '...') OR ends_with(x, '…')))::BIGINT AS n_ellipsis_lines,
         len(list_filter(l, lambda x: x[1] IN ('-', '*', '•')))::BIGINT AS n_bullet_lines
  FROM t LEFT JOIN rep ON t.r = rep.r
), f AS (
  SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AS base_failed FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {_sql_rules()}) AS kept FROM f
"""

QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLES = {"op10_quality_rules": ORACLE_SQL}
