"""Quality rules, native: clean line by line, then judge what is left.

Each line is held against punctuation, navigation and boilerplate rules; lines that fail are removed,
and a document that loses too large a share of its words is rejected.  Everything is an
expression over the row's own text: no shuffle, no Python, one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: A line with more symbols than words times this is no prose.
SYMBOL_SHARE = 0.2
#: A line that ends without one of these and has fewer words than SHORT_LINE is a heading or a menu entry.
ENDS = ".!?:;,\"'”’»…)]。！？"
SHORT_LINE = 4
#: Separators of menus and bread crumbs.
NAVIGATION = r"(\|[^|]*\|)|(»[^»]*»)|( > [^>]* > )|(?i)^\s*(home|menu|login|log in|sign up|sign in|search|next|previous|back to top|read more|share)\s*$"
#: Phrases of pages rather than of texts.
BOILERPLATE = r"(?i)lorem ipsum|enable javascript|javascript is (disabled|required)|use of cookies|uses cookies|cookie policy|privacy policy|terms of (use|service)|all rights reserved|click here|subscribe to our newsletter"
#: A document is rejected when it loses more than this share of its words, or has fewer than MIN_WORDS or too many repeats.
MAX_LOSS = 0.5
MIN_WORDS = 50


def words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ in order; null has none."""
    return F.coalesce(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), F.array().cast("array<string>"))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def _repeated() -> Column:
    """Words in a 3-word window that occurs twice or more in the text, from the array column ``_pairs``.

    Windows are (hash, place) pairs in sorted order, so equal windows are neighbours; the places of those with
    an equal neighbour are sorted again and each adds the words that the one before does not cover. n log n in
    the text's length. The hash has 64 bits and is only compared within one text.
    """
    equal = "(k > 0 and get(_pairs, k - 1).h = p.h) or (k < size(_pairs) - 1 and get(_pairs, k + 1).h = p.h)"
    places = f"sort_array(transform(filter(_pairs, (p, k) -> {equal}), p -> p.i))"
    return F.expr(f"aggregate({places}, struct(0L as n, -3 as at), (a, i) -> struct(a.n + least(3, i - a.at) as n, i as at), a -> a.n)")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns that are computed once a row: neither a filter nor a later column repeats the work."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def measured(docs: DataFrame) -> DataFrame:
    """docs (with ``_text``) and _w, _lines (those with a word) and the counts of the base rules."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    bare = text
    for c in SYMBOLS:
        bare = F.replace(bare, F.lit(c))
    step = once(docs, _w=words(F.col("_text")), _lines=F.filter(lines(text), lambda s: F.rlike(s, F.lit(r"[^\x20\x09-\x0D]"))), n_symbols=(F.length(text) - F.length(bare)).cast("long"))
    step = once(step, _pairs=F.expr("sort_array(transform(case when size(_w) >= 3 then sequence(0, size(_w) - 3) else cast(array() as array<int>) end, i -> struct(xxhash64(_w[i], _w[i + 1], _w[i + 2]) as h, i as i)))"))
    return once(
        step,
        n_words=F.size("_w").cast("long"),
        word_chars=F.length(F.array_join("_w", "")).cast("long"),
        n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        n_repeat_words=_repeated().cast("long"),
        _kept=F.filter("_lines", lambda s: ~line_fails(s)),
    )


def line_fails(line: Column) -> Column:
    """Whether a line breaks the punctuation, navigation or boilerplate rule."""
    count = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    trimmed = F.rtrim(line)
    bare = line
    for c in SYMBOLS:
        bare = F.replace(bare, F.lit(c))
    punctuation = (~F.contains(F.lit(ENDS), F.right(trimmed, F.lit(1))) & (count < SHORT_LINE)) | ((F.length(line) - F.length(bare)) > SYMBOL_SHARE * count)
    return punctuation | F.rlike(line, F.lit(NAVIGATION)) | F.rlike(line, F.lit(BOILERPLATE))


def without_failing_lines(text: Column) -> Column:
    """The text without the lines that break a rule; blank lines stay where they are."""
    return F.array_join(F.filter(lines(text), lambda s: ~(F.rlike(s, F.lit(r"[^\x20\x09-\x0D]")) & line_fails(s))), "\n")


def rate_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_loss: float = MAX_LOSS) -> DataFrame:
    """A row for each document: id, the base counts, base_failed, n_lines, n_bad_lines, n_lost_words, clean_text, kept.

    clean_text has the lines that pass. kept is false if the base rules fail or more than ``max_loss`` of the
    words are lost. A null or empty text has no words and fails; repeated ids are judged one by one;
    other columns, whatever their names, are left out before anything is computed.
    """
    step = measured(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")))
    step = once(step, _left=F.aggregate("_kept", F.lit(0).cast("long"), lambda n, s: n + F.regexp_count(s, F.lit(r"[^\x20\x09-\x0D]+"))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    lost = F.col("n_words") - F.col("_left")
    return step.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.size("_lines").alias("n_lines"),
        (F.size("_lines") - F.size("_kept")).alias("n_bad_lines"), lost.alias("n_lost_words"), F.array_join("_kept", "\n").alias("clean_text"), (~failed & (lost <= max_loss * F.col("n_words"))).alias("kept"),
    )
