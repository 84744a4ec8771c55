"""Quality rules: a threshold table compiled into one projection of built-in functions.

Each row of RULES names a ratio and the range that a kept document's ratio must lie in; compile_rules() turns the table
into one boolean column. Nothing is shuffled and no user function runs. Words found in 3-word windows that occur twice
are counted inside the row: windows are hashed, sorted with their positions, and neighbours with equal hashes are
compared word by word, so a collision of hashes can't make two windows equal.

Defined cases. Null text: no words, every count is zero and the document fails. A ratio over nothing is zero. Repeated
rows are judged one by one; a null doc_id stays null. Other columns are ignored, whatever their names. Texts of any
length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_SPLIT = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
# Frequent function words of the four languages.
STOP_WORDS = (
    "the and of to in a is that for it was on are as with be this by "
    "der die und das den von zu mit ist ein nicht "
    "le la de et les des un une du en que pour est dans qui "
    "el los las y del se por con para es su al lo como"
).split()

#: ratio, least, most: a kept document's ratio lies within the bounds, both included.
RULES = (
    ("mean_word_chars", 2.0, 12.0),
    ("symbol_ratio", None, 0.15),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.4),
    ("repeat_word_ratio", None, 0.3),
    ("bullet_line_ratio", None, 0.9),
    ("ellipsis_line_ratio", None, 0.5),
    ("alpha_word_ratio", 0.5, None),
    ("loud_word_ratio", None, 0.4),
)


def measured(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id and the counts that the ratios are made of, and the struct row of the named columns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = [F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row")] if columns else []
    also = ["row"] if columns else []
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"), *row).select(
        "doc_id", "t", *also, F.filter(F.split("t", WORD_SPLIT), lambda w: w != "").alias("w"), F.filter(F.split("t", "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")).alias("lines")
    )
    # (hash of the window that starts at word i, i) in order; the first of a run and the rest of it both count
    windows = words.withColumn(
        "h", F.expr("IF(size(w) < 3, array(), array_sort(transform(sequence(1, greatest(size(w) - 2, 1)), i -> struct(xxhash64(w[i - 1], w[i], w[i + 1]) AS k, i AS i))))")
    )
    same = "(h[{a}].k = h[{b}].k AND w[h[{a}].i - 1] = w[h[{b}].i - 1] AND w[h[{a}].i] = w[h[{b}].i] AND w[h[{a}].i + 1] = w[h[{b}].i + 1])"
    found = windows.withColumn(
        "starts",
        F.expr(
            "transform(filter(transform(h, (x, j) -> struct(x.i AS i, "
            f"((j > 0 AND {same.format(a='j', b='greatest(j - 1, 0)')}) OR (j + 1 < size(h) AND {same.format(a='j', b='least(j + 1, size(h) - 1)')})) AS twice)), x -> x.twice), x -> x.i)"
        ),
    )
    # from a generator of one row, as no filter on a count is pushed below that, where the count would be made anew for each mention
    counts = F.struct(
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("t", "[\\x20\\x09-\\x0D]", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("size(array_distinct(flatten(transform(starts, i -> array(i, i + 1, i + 2)))))").cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda line: line.rlike("^[\\x20\\x09]*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda line: line.rlike("(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter("w", lambda w: F.lower(F.regexp_replace(w, "[.,!?;:]+$", "")).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter("w", lambda w: w.rlike("\\p{L}"))).cast("long").alias("n_alpha_words"),
        F.size(F.filter("w", lambda w: w.rlike("[!?]{2}$|[#*$%&|<>]{2}$"))).cast("long").alias("n_loud_words"),
    )
    return found.select("doc_id", *also, F.inline(F.array(counts)))


def ratios() -> dict[str, Column]:
    def over(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))

    return {
        "mean_word_chars": over("word_chars", "n_words"),
        "symbol_ratio": over("n_symbols", "n_words"),
        "stop_word_ratio": over("n_stop_words", "n_words"),
        "dup_line_ratio": over("n_dup_lines", "n_lines"),
        "repeat_word_ratio": over("n_repeat_words", "n_words"),
        "bullet_line_ratio": over("n_bullet_lines", "n_lines"),
        "ellipsis_line_ratio": over("n_ellipsis_lines", "n_lines"),
        "alpha_word_ratio": over("n_alpha_words", "n_words"),
        "loud_word_ratio": over("n_loud_words", "n_words"),
    }


def compile_rules(rules=RULES) -> Column:
    """True where every ratio lies within its bounds."""
    ratio, verdict = ratios(), F.lit(True)
    for name, least, most in rules:
        if least is not None:
            verdict = verdict & (ratio[name] >= least)
        if most is not None:
            verdict = verdict & (ratio[name] <= most)
    return verdict


def failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(docs: DataFrame, rules=RULES) -> DataFrame:
    """The contract's rows: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    return measured(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed().alias("base_failed"), (~failed() & compile_rules(rules)).alias("kept"), *(c.alias(n) for n, c in ratios().items())
    )


def kept(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns; nothing is shuffled."""
    return measured(docs, *docs.columns).where(~failed() & compile_rules(rules)).select([F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _bounds_sql(rules=RULES) -> str:
    return " AND ".join([f"{n} >= {a}" for n, a, _ in rules if a is not None] + [f"{n} <= {b}" for n, _, b in rules if b is not None])


ORACLE_SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
s AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM s QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1),
m AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '{SYMBOLS}'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    len(lines) AS n_lines, len(list_filter(lines, lambda x: regexp_matches(x, '^[\\x20\\x09]*[-*•]'))) AS n_bullet_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS n_ellipsis_lines,
    len(list_filter(w, lambda x: list_contains([{", ".join(f"'{x}'" for x in STOP_WORDS)}], lower(regexp_replace(x, '[.,!?;:]+$', ''))))) AS n_stop_words,
    len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_alpha_words,
    len(list_filter(w, lambda x: regexp_matches(x, '[!?]{{2}}$|[#*$%&|<>]{{2}}$'))) AS n_loud_words
  FROM w LEFT JOIN r USING (doc_id)),
q AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END AS mean_word_chars, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0.0 END AS symbol_ratio,
    CASE WHEN n_words > 0 THEN n_stop_words / n_words ELSE 0.0 END AS stop_word_ratio, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END AS dup_line_ratio,
    CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0.0 END AS repeat_word_ratio, CASE WHEN n_lines > 0 THEN n_bullet_lines / n_lines ELSE 0.0 END AS bullet_line_ratio,
    CASE WHEN n_lines > 0 THEN n_ellipsis_lines / n_lines ELSE 0.0 END AS ellipsis_line_ratio, CASE WHEN n_words > 0 THEN n_alpha_words / n_words ELSE 0.0 END AS alpha_word_ratio,
    CASE WHEN n_words > 0 THEN n_loud_words / n_words ELSE 0.0 END AS loud_word_ratio
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_bounds_sql()} AS kept,
  mean_word_chars, symbol_ratio, stop_word_ratio, dup_line_ratio, repeat_word_ratio, bullet_line_ratio, ellipsis_line_ratio, alpha_word_ratio, loud_word_ratio
FROM q
"""
