"""Spelling variants grouped by permuterm rotations.

A word w of m code points, marked with the terminator `$`, has m + 1 rotations w[j:] + `$` + w[:j]. Leaving out the
code point at i of the rotation that starts just after it gives the *skip key* w[i+1:] + `$` + w[:i]:

* two words of one length that differ only at i have the same skip key at i, and no other common one (the place of `$`
  fixes i): a replacement;
* a word v that is w without its code point at i has the *full* rotation v[i:] + `$` + v[:i] equal to w's skip key at i:
  a deletion (an insertion seen from v). Where w has a run of equal code points, every place in the run gives v; only
  the first place of a run (i = 0 or w[i-1] != w[i]) is taken, so that each pair meets under one key alone.

Sorting all rotations brings equal keys together; Spark does that sorting as a window over keys, in one shuffle. A row is the
key, the code point left out (null: a full rotation) and n: the word is what stands after the `$`, the code point, and what
stands before. No pair of a group is formed: a group gives each of its members the number of its neighbours in the group
and the best of them (largest n, then smallest word), from the group's two best skip members, its best first-of-run skip
member and its full member. Words are distinct, so a group has at most one skip member for each letter (90) and one full one.
Forms point to words with ten times the count or more, so a chain of forms is short (at most
log10 of all occurrences); roots are found by pointer doubling in as many rounds as the chain's length has bits.

Results for odd inputs: a null text has no runs; a null doc_id counts as the empty text in `<doc_id>:<run>`; empty and
letterless texts give nothing; repeated rows count each time (n counts occurrences); an empty table gives an empty
result. Only the columns doc_id and text are read, so other columns of any name don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from workmart.llm.common import store

# Fixed values of the contract: runs of letters, the letters that are lower-cased, the terminator.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = "$"
#: A word counts if it has so many code points and occurs so many times at least.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A near word is a word's form if its count is so many times the word's at least.
FORM_RATIO = 10
#: Every `drop_every`-th (by crc32) run loses one code point.
DROP_EVERY = 31


def runs(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row for each run of letters: `word`, lower-cased (A-Z only), with one code point dropped where crc32 says."""
    found = docs.select(F.col(id).alias("_id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), 0)).alias("_run"))
    lowered = F.translate("_run", UPPER, LOWER)
    h = F.crc32(F.encode(F.concat(F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit(":"), lowered), "UTF-8"))
    at = (h % F.length(lowered)).cast("int")
    dropped = F.concat(F.expr("substring(translate(_run, '{0}', '{1}'), 1, {2})".format(UPPER, LOWER, "_at")), F.expr("substring(translate(_run, '{0}', '{1}'), _at + 2)".format(UPPER, LOWER)))
    return found.withColumn("_at", at).select(F.when(h % DROP_EVERY == 0, dropped).otherwise(lowered).alias("word"))


def words(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """word, n: distinct words of LEAST_LENGTH code points or more that occur LEAST_COUNT times or more."""
    counted = runs(docs, text, id).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))


def rotations(vocabulary: DataFrame) -> DataFrame:
    """key, c (the code point left out; null: a full rotation), n; `word_of` gives the word."""
    places = vocabulary.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i"))
    # a full rotation, and at each place but the end the one that lacks a code point
    made = F.array(F.struct(F.expr(f"concat(substring(word, i + 1), '{END}', substring(word, 1, i))").alias("key"), F.lit(None).cast("string").alias("c")),
                   F.struct(F.expr(f"concat(substring(word, i + 2), '{END}', substring(word, 1, i))").alias("key"), F.expr("substring(word, i + 1, 1)").alias("c")))
    rows = places.select("n", F.explode(made).alias("_r")).select("_r.key", "_r.c", "n")
    return rows.filter(F.col("c").isNull() | (F.col("c") != ""))


def word_of(c: Column) -> Column:
    return F.concat(F.substring_index("key", END, -1), F.coalesce(c, F.lit("")), F.substring_index("key", END, 1))


def _rank(n: Column, c: Column) -> Column:
    """Smaller is better: larger n, then smaller word (UTF-8 byte order is code-point order)."""
    return F.struct((-n).alias("neg_n"), word_of(c).alias("word"))


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """word, n, n_near, best (struct of neg_n and word of the best near word, null if none)."""
    members = rotations(vocabulary).select("key", "c", "n", F.struct("n", "c").alias("_m"))
    skip, first = F.col("c").isNotNull(), F.coalesce(F.col("c") != F.expr("substring(key, -1, 1)"), F.lit(False))
    # skip members first, best first: words of one key are ordered as the code points left out are
    group = W.partitionBy("key").orderBy(F.desc(skip), F.desc("n"), "c").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    told = members.select(
        "key", "c", "n", F.count(F.when(skip, 1)).over(group).alias("n_skip"), F.count(F.when(first, 1)).over(group).alias("n_first"),
        F.count(F.when(~skip, 1)).over(group).alias("n_full"), F.first("_m").over(group).alias("one"), F.nth_value("_m", 2).over(group).alias("two"),
        F.first(F.when(first, F.col("_m")), ignorenulls=True).over(group).alias("best_first"), F.last("_m").over(group).alias("full"))
    near = F.when(skip, F.col("n_skip") - 1 + F.when(first, F.col("n_full")).otherwise(0)).otherwise(F.col("n_first"))
    told = told.withColumn("_near", near).filter("_near > 0")

    def rank(member: str) -> Column:
        return _rank(F.col(f"{member}.n"), F.col(f"{member}.c"))

    other_skip = F.when(F.col("n_skip") > 1, F.when(F.col("c") == F.col("one.c"), rank("two")).otherwise(rank("one")))
    of_full = F.when(F.col("n_full") > 0, rank("full"))
    best = F.when(skip, F.when(first, F.least(other_skip, of_full)).otherwise(other_skip)).otherwise(rank("best_first"))
    per_word = told.select(word_of(F.col("c")).alias("word"), "_near", best.alias("_best")).groupBy("word").agg(F.sum("_near").alias("n_near"), F.min("_best").alias("best"))
    return vocabulary.join(per_word, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "best")


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form) with root: the last word of the chain of forms, by pointer doubling."""
    up = store(forms.select("word", F.coalesce("form", "word").alias("up")))
    while True:
        step = up.alias("a").join(up.alias("b"), F.col("a.up") == F.col("b.word"), "left").select(
            F.col("a.word").alias("word"), F.coalesce(F.col("b.up"), F.col("a.up")).alias("up"), (F.col("b.up").isNotNull() & (F.col("b.up") != F.col("a.up"))).alias("_moved"))
        step = store(step)
        if step.filter("_moved").isEmpty():
            return forms.join(step.select("word", F.col("up").alias("root")), "word")
        up = step.drop("_moved")


def variants(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """word, form, root (string), n, n_near, form_n (long): one row for each word, as the module says."""
    found = neighbours(store(words(docs, text, id)))
    is_form = F.col("best").isNotNull() & (-F.col("best.neg_n") >= FORM_RATIO * F.col("n"))
    forms = found.select("word", "n", "n_near", F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.neg_n")).cast("long").alias("form_n"))
    return roots(store(forms)).select("word", "form", "root", F.col("n").cast("long").alias("n"), "n_near", "form_n")
