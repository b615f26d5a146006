"""Quality rules: counts of one document, and how often its lines occur in other documents of its host.

DataFrame functions only. Lines are normalised (white space runs to one space, trimmed, lower case, digits to
0) and hashed. For each host, the distinct documents that hold a line are counted, equal texts as one; a line
above the host's limit is removed, and a document of which too little remains is rejected.

Row-level work is arrays within a row. Hashes of lines are counted with partial sums, so the holders of a hot line
are no single task; the lines above a limit are broadcast after a check of their size (a hundred a host and line of
an average document at most), and what they remove is joined back by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaframe.llm.shared import small, written

WINDOW = 5
#: A line is removed when more than LIMIT of its host's distinct documents hold it, and at least LEAST.
LIMIT, LEAST = 0.01, 10
#: A document is rejected when less than this share of its words remains.
REMAINS = 0.3
_WHITE = "[\\x20\\x09-\\x0D]+"
_WORD = "[^\\x20\\x09-\\x0D]+"


def _n(array: Column) -> Column:
    return F.size(array).cast("long")


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, "")).cast("long")


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed in columns that begin with an underscore.

    Intermediate arrays are columns of their own, each used more than once, so they are computed once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    docs = docs.select(
        "*",
        F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), lambda w: F.xxhash64(w)).alias("_w"),
        _without(text, " \t\n\x0b\x0c\r").alias("_word_chars"),
        (F.length(text) - _without(text, "#*$%&|<>")).cast("long").alias("_n_symbols"),
        lines.alias("_lines"),
    )
    docs = docs.select("*", _n("_w").alias("_n_words"), (_n("_lines") - _n(F.array_distinct("_lines"))).alias("_n_dup_lines"))
    pair = lambda x, y: F.zip_with(x, y, lambda p, q: F.xxhash64(p, q))
    part = lambda c, start, less: F.slice(c, F.lit(start), F.greatest(F.size("_w") - less, F.lit(0)))
    docs = docs.withColumn("_two", pair(part("_w", 1, 1), part("_w", 2, 1)))
    docs = docs.withColumn("_four", pair(part("_two", 1, 3), part("_two", 3, 3))).drop("_two")
    docs = docs.withColumn("_h", pair(part("_four", 1, WINDOW - 1), part("_w", WINDOW, WINDOW - 1))).drop("_w", "_four")
    placed = F.when(F.size("_h") > F.size(F.array_distinct("_h")), F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    docs = docs.withColumn("_s", placed).drop("_h")
    rest = F.size("_s") - 1
    same = F.zip_with(F.slice("_s", F.lit(1), rest), F.slice("_s", F.lit(2), rest), lambda x, y: F.when(x.h == y.h, F.array(x.i, y.i)).otherwise(F.array().cast("array<int>")))
    docs = docs.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(F.array_distinct(F.flatten(same))))).drop("_s")
    rest = F.size("_p") - 1
    steps = F.zip_with(F.slice("_p", F.lit(1), rest), F.slice("_p", F.lit(2), rest), lambda x, y: F.least(y - x, F.lit(WINDOW)).cast("long"))
    repeat = F.when(F.col("_p").isNull() | (F.size("_p") == 0), F.lit(0).cast("long")).otherwise(F.aggregate(steps, F.lit(WINDOW).cast("long"), lambda s, x: s + x))
    docs = docs.withColumn("_n_repeat_words", repeat).drop("_p")
    return docs.withColumn("_base_failed", (F.col("_n_words") < 10) | (100 * F.col("_n_repeat_words") > 20 * F.col("_n_words")))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """For each row: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and n_removed_words.

    Null texts are empty: no words, and so base_failed. Rows without a host are one host. Rows that repeat a
    text are rows like any other, but count once in the host's documents. Other columns are not looked at.
    """
    docs = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("_host"), F.col(text_col).alias("_text"))
    normal = lambda x: F.translate(F.lower(F.trim(F.regexp_replace(x, _WHITE, " "))), "123456789", "000000000")
    line = lambda x: F.struct(F.xxhash64(normal(x)).alias("line"), F.size(F.split(F.trim(F.regexp_replace(x, _WHITE, " ")), " ")).cast("long").alias("words"))
    base = counts(docs, "_text").select(
        F.monotonically_increasing_id().alias("_row"), "_id", "_host", F.xxhash64(F.coalesce("_text", F.lit("")), F.lit(0)).alias("_content"), F.transform("_lines", line).alias("_own"),
        *[f"_{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")],
    )
    base = written(base, "quality")
    firsts = base.groupBy("_host", "_content").agg(F.min("_row").alias("_row"))
    texts = base.join(firsts.select("_row"), "_row", "left_semi")
    hosts = firsts.groupBy("_host").agg(F.greatest(F.lit(LEAST - 1), F.floor(LIMIT * F.count("*"))).alias("limit"))
    holders = texts.select("_host", F.explode(F.array_distinct(F.transform("_own", lambda x: x.line))).alias("line")).groupBy("_host", "line").agg(F.count("*").alias("n"))
    frequent = small(written(holders.where(F.col("n") >= LEAST).join(hosts, "_host").where("n > limit").select("_host", "line"), "frequent"))
    removed = base.select("_row", "_host", F.explode("_own").alias("x")).select("_row", "_host", "x.line", "x.words").join(frequent, ["_host", "line"]).groupBy("_row").agg(F.sum("words").alias("_removed"))
    out = base.drop("_own").join(removed, "_row", "left").withColumn("_removed", F.coalesce("_removed", F.lit(0).cast("long")))
    kept = ~F.col("_base_failed") & (F.col("_n_words") - F.col("_removed") >= F.lit(REMAINS) * F.col("_n_words"))
    return out.select(F.col("_id").alias(id_col), *[F.col(f"_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], kept.alias("kept"), F.col("_removed").alias("n_removed_words"))
