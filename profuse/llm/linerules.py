"""Quality rules, lines first.

Each line is judged by punctuation, navigation and boilerplate rules; failing
lines go, and a document that loses too much of its text this way, or that fails
the base rules, is rejected.  Everything is computed inside the row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from profuse.llm.common import SPACE, let, text_of, words

GRAM = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: A short clean document may lose most of itself with one licence line (0.81 of the characters is the most among the labelled ones).
MAX_LOST = 0.85
SYMBOLS = "#*$%&|<>"
MAX_SYMBOL_SHARE = 0.08
MAX_STUTTER_SHARE = 0.4
SALAD_WORDS = 20
# Phrases of notices and licences, lower case.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "terms of use", "terms of service", "privacy policy",
    "cookie policy", "uses cookies", "enable javascript", "lorem ipsum", "copyright (c)", "creative commons",
)
# Words of menus, lower case.
MENU = ("home", "menu", "login", "logout", "register", "contact", "about", "search", "sitemap", "next", "previous", "share", "print", "top", "help", "faq")
MENU_LINE = r"^(?:[\x20\x09|>/·»›•-]*(?:" + "|".join(MENU) + r")\b[\x20\x09|>/·»›•-]*)+$"

#: Punctuation of any script that parts sentences or words, without signs of markup, units and quoting.
STOPS = r"[\p{Po}&&[^#%&*@/\\'\"]]"


def repeated_words(found: Column) -> Column:
    """Number of words that lie in windows of five which the text holds twice or more."""
    at = lambda k: F.get(found, k)
    windows = F.transform(F.slice(found, 1, F.greatest(F.size(found) - (GRAM - 1), F.lit(0))),
                          lambda w, i: F.xxhash64(w, *[at(i + k) for k in range(1, GRAM)]))

    def covered(hashes: Column) -> Column:
        """Sort by hash; neighbours with equal hashes are repeats; sum the stretches they cover."""
        def repeats(s: Column) -> Column:
            twin = lambda e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
            return F.transform(F.filter(s, lambda e, k: twin(e, k - 1) | twin(e, k + 1)), lambda e: e["p"])

        def stretch(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda v, k: F.least(F.coalesce(F.get(p, k + 1) - v, F.lit(GRAM)), F.lit(GRAM))),
                               F.lit(0), lambda a, v: a + v)

        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return let(let(placed, lambda s: F.sort_array(repeats(s))), stretch)

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))


def stutters(found: Column) -> Column:
    """Words equal to the word before them."""
    return F.size(F.filter(found, lambda w, i: F.coalesce(F.get(found, i - 1) == w, F.lit(False))))


def is_boilerplate(line: Column) -> Column:
    """Whether a line holds a phrase of notices and licences."""
    low, found = F.lower(line), F.lit(False)
    for phrase in BOILERPLATE:
        found = found | F.contains(low, F.lit(phrase))
    return found


def line_fails(line: Column) -> Column:
    """Whether a line is navigation or has the punctuation of neither prose nor verse."""
    symbols = F.regexp_count(line, F.lit(f"[{SYMBOLS}]")) > MAX_SYMBOL_SHARE * F.length(line)
    shouting = F.regexp_count(line, F.lit("!!")) * 20 > F.length(line)
    salad = ~line.rlike(STOPS) & (F.regexp_count(line, F.lit(SPACE)) >= SALAD_WORDS)
    return symbols | shouting | salad | F.lower(F.trim(line)).rlike(MENU_LINE)


def _row(t: Column) -> Column:
    lines = F.split(t, "\n", -1)
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")

    def by_words(found: Column) -> Column:
        return F.struct(F.size(found).cast("long").alias("n_words"), repeated_words(found).cast("long").alias("n_repeat_words"),
                        stutters(found).alias("stutters"))

    def by_lines(all_lines: Column) -> Column:
        worded = F.filter(all_lines, has_word)
        own = F.filter(all_lines, lambda line: ~(is_boilerplate(line) | line_fails(line)))
        total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, line: a + F.length(line))
        return F.struct(
            let(worded, lambda w: F.size(w) - F.size(F.array_distinct(w))).cast("long").alias("n_dup_lines"),
            let(own, lambda k: F.struct(total(k).alias("chars"), F.size(k).alias("lines"), F.array_join(k, "\n").alias("text"))).alias("kept"),
            total(all_lines).alias("chars"), F.size(all_lines).alias("lines"))

    return F.struct(
        let(words(t), by_words).alias("w"), let(lines, by_lines).alias("l"),
        F.length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"))


def verdict(text: str = "text") -> Column:
    """Struct n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, clean (the lines that stay)."""
    def judged(r: Column) -> Column:
        w, lines = r["w"], r["l"]
        failed = (w["n_words"] < MIN_WORDS) | (100 * w["n_repeat_words"] > MAX_REPEAT_PERCENT * w["n_words"])
        whole, left = lines["chars"], lines["kept"]["chars"]
        # Every line that goes counts as lost; so does text in a stutter where it outweighs the rest.
        good = (left > 0) & (whole - left <= MAX_LOST * whole) & (w["stutters"] <= MAX_STUTTER_SHARE * w["n_words"])
        return F.struct(
            w["n_words"].alias("n_words"), r["word_chars"].alias("word_chars"), r["n_symbols"].alias("n_symbols"),
            lines["n_dup_lines"].alias("n_dup_lines"), w["n_repeat_words"].alias("n_repeat_words"),
            failed.alias("base_failed"), (~failed & good).alias("kept"),
            F.when(lines["kept"]["lines"] < lines["lines"], lines["kept"]["text"]).alias("clean"))

    return let(_row(text_of(text)), judged)


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key and the fields of ``verdict`` without the text.

    Null and empty texts have no word and fail.  Equal lines count from the
    second on; repeated rows and null keys are judged like others; other columns
    are not read; an empty table gives an empty result.
    """
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rows = docs.select(F.col(key).alias("_key"), verdict(text).alias("_v"))
    return rows.select(F.col("_key").alias(key), *[F.col("_v")[f].alias(f) for f in fields])


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are kept, without their failing lines; all columns stay.

    The verdict is filtered inside an array and exploded: a filter on a column
    would be pushed below the projection and the lines judged twice.
    """
    rows = docs.select("*", F.explode(F.filter(F.array(verdict(text)), lambda v: v["kept"])).alias("_pf_v"))
    return rows.withColumn(text, F.coalesce(F.col("_pf_v")["clean"], F.col(text))).drop("_pf_v")
