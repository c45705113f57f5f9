"""Quality rules: base counts of a text, and its divergence from its language.

The histograms of character classes and of common words (with one bin for all
other words) of each document are compared by Jensen-Shannon distance with a
reference of its language: the sums over the language's documents that pass
the base rules.  Languages with few words in those are compared with the sums
over all languages.  Very short texts have too few counts and are guarded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import WORD, free_name, let, sent_if_small, written

# Common words of four languages, the bins of the word histogram.
COMMON_WORDS = (
    "the of and to in is that for it as was with be by on at from this are or "
    "der die und den das mit von ist nicht des sich ein eine zu auf "
    "le les et la un une que qui dans pour par sur avec du "
    "el los de en y las del se con su al lo no es"
).split()
#: One character for each common word; the words of a text become a string of these.
CODES = "".join(chr(0x4E00 + i) for i in range(len(COMMON_WORDS)))
# The symbols of the contract.
SYMBOLS = "#*$%&|<>"
#: Character classes, with a pattern of runs for those that are rare; what is left is "other", mostly small letters.
CHAR_CLASSES = {"upper": "[A-Z]+", "digit": "[0-9]+", "mark": r"[.,;:!?'\"()\[\]{}/\\@=_+~^`-]+", "symbol": r"[#*$%&|<>]+", "wide": r"[^\x00-\x7F]+"}
#: Largest distances that pass, and the fewest words for which a distance counts.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, MIN_WORDS = 0.30, 0.32, 50
#: Words that a language's reference needs; below, the reference of all languages stands in.
MIN_REFERENCE_WORDS = 10_000
#: Bytes of a rejected text's key, and of a language's sums, in tables that are sent whole.
KEY_BYTES, REFERENCE_BYTES = 64, 2048
WINDOW, MIN_BASE_WORDS, MAX_REPEAT_SHARE = 3, 50, 50


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more, the first included.

    Windows are compared by a 64-bit hash: sorting (hash, place) puts equal
    ones side by side, so the work is n log n for a text of any length.
    """
    at = lambda w, i: F.get(w, i)
    n = F.size(words)
    places = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    windows = let(words, lambda w: F.sort_array(F.transform(places, lambda i: F.struct(F.xxhash64(at(w, i), at(w, i + 1), at(w, i + 2)).alias("h"), i.alias("i")))))
    twice = let(windows, lambda s: F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1).h == x.h)) | F.coalesce(F.get(s, k + 1).h == x.h, F.lit(False))))
    starts = F.sort_array(F.transform(twice, lambda x: x.i))
    first = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(starts, first, lambda a, i: F.struct(i.alias("last"), (a.n + F.least(F.lit(WINDOW), i - a["last"])).alias("n")), lambda a: a.n)


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def document_features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text_key (MD5) and the counts of each row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars, common (histograms)."""
    text = F.coalesce("text", F.lit(""))
    src = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), text.alias("t"), F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))
    codes = F.create_map(*[F.lit(x) for pair in zip(COMMON_WORDS, CODES, strict=True) for x in pair])
    known = F.transform(F.filter(F.transform("w", lambda x: F.lower(x)), lambda x: x.isin(*COMMON_WORDS)), lambda x: codes[x])
    found = src.select(
        "doc_id", "lang", "t", F.unhex(F.md5(F.col("t").cast("binary"))).alias("text_key"), F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length("t").alias("n_chars"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w")).cast("long").alias("n_repeat_words"),
        F.array_join(known, "").alias("codes"),
    )
    counts = found.select("*", *[(F.col("n_chars") - _without(F.col("t"), p)).cast("long").alias(f"c_{k}") for k, p in CHAR_CLASSES.items()])
    space = F.col("n_chars") - F.col("word_chars")
    rest = F.col("word_chars")
    for k in CHAR_CLASSES:
        rest = rest - F.col(f"c_{k}")
    n_codes = F.length("codes")
    common = [(n_codes - F.length(F.replace("codes", F.lit(c), F.lit("")))).cast("long") for c in CODES]
    return counts.select(
        "doc_id", "lang", "text_key", "n_words", "word_chars", F.col("c_symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
        F.array(space.cast("long"), rest, *[F.col(f"c_{k}") for k in CHAR_CLASSES]).alias("chars"),
        F.array(F.col("n_words") - n_codes, *common).alias("common"),
    )


def jensen_shannon(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (root of the divergence in bits, 0 to 1) of two histograms; null where one is empty."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    shares = lambda x: let(F.nullif(total(x), F.lit(0.0)), lambda t: F.transform(x, lambda v: v.cast("double") / t))
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    terms = F.zip_with(shares(p), shares(q), lambda a, b: 0.5 * (part(a, b) + part(b, a)))
    sum_of = F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)
    return F.sqrt(F.when(sum_of < 0, 0.0).otherwise(sum_of))


def _judged(docs: DataFrame, max_char: float, max_word: float, min_words: int) -> DataFrame:
    failed = (F.col("n_words") < MIN_BASE_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_SHARE * F.col("n_words"))
    features = written(document_features(docs).withColumn("base_failed", failed), "quality-features")
    n_chars, n_common = 2 + len(CHAR_CLASSES), 1 + len(COMMON_WORDS)
    sums = lambda name, n: F.array(*[F.coalesce(F.sum(F.get(F.col(name), F.lit(i))), F.lit(0)) for i in range(n)]).alias(f"all_{name}")
    good = features.where(~F.col("base_failed"))
    by_lang = written(good.groupBy("lang").agg(sums("chars", n_chars), sums("common", n_common), F.sum("n_words").alias("n")).where(F.col("n") >= MIN_REFERENCE_WORDS).drop("n"), "quality-references")
    every = good.agg(sums("chars", n_chars), sums("common", n_common)).first()  # one row of sums
    seen = features.join(sent_if_small(by_lang, REFERENCE_BYTES), "lang", "left")
    of = lambda name: F.coalesce(f"all_{name}", F.lit(list(every[f"all_{name}"])).cast("array<bigint>"))
    seen = seen.withColumns({"char_distance": jensen_shannon(F.col("chars"), of("chars")), "word_distance": jensen_shannon(F.col("common"), of("common"))})
    far = (F.col("n_words") >= min_words) & ((F.coalesce("char_distance", F.lit(0.0)) > max_char) | (F.coalesce("word_distance", F.lit(0.0)) > max_word))
    return seen.withColumn("kept", ~F.col("base_failed") & ~far)


def judge_quality(docs: DataFrame, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each row of docs (doc_id, text, lang; other columns are ignored).

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, char_distance, word_distance, kept.  A null text has no
    words; a null lang is a language of its own.  Distances count from
    min_words words.  References are sums over all documents that pass the
    base rules, by language, or over all of them where a language has fewer
    than MIN_REFERENCE_WORDS words; where none passes, distances are null.
    Repeated rows are judged alike; an empty table gives no rows.
    """
    seen = _judged(docs, max_char, max_word, min_words)
    return seen.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.round("char_distance", 4).alias("char_distance"), F.round("word_distance", 4).alias("word_distance"), "kept")


def keep_good_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge_quality keeps, with all their columns.

    The verdict follows from text and lang, so rejected (text, lang) pairs are
    taken out by an anti-join, which sends them whole only where they are few.
    Nulls, empty texts, repeated rows and empty tables are as in judge_quality.
    """
    of_key, of_lang = free_name(docs, "rejected_key"), free_name(docs, "rejected_lang")
    rejected = _judged(docs, MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, MIN_WORDS).where(~F.col("kept")).select(F.col("text_key").alias(of_key), F.col("lang").alias(of_lang)).distinct()
    side = sent_if_small(written(rejected, "rejected"), KEY_BYTES)
    key = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return docs.join(side, (key == F.col(of_key)) & (F.coalesce("lang", F.lit("")) == F.col(of_lang)), "left_anti")
