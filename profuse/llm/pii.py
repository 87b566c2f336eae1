"""Personal data: base patterns, then bootstrapped contextual extraction.

Base matches are the seeds.  The words left and right of a mention are lexical
patterns.  In rounds, Spark scores the graph of patterns and instances: a
pattern's confidence for a kind is the share of all its occurrences in the
corpus whose slot holds a known instance of that kind; instances that look like
the kind and stand in patterns of high confidence become known.  Rounds end when
nothing is added.  The texts are read once for mentions and once for the counts
of pattern words; the rest works on the mentions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from profuse.llm.common import BROADCAST_ROWS, join_checked, let, text_of
from profuse.session import stored

KINDS = ("email", "ip", "card", "phone")
# The base patterns, written so that no start inside a run is tried again and no group recurses.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: A word with a digit or @.
LOOSE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
_GROUP = r"\(?[0-9][0-9./()-]*+(?![^\x20\x09-\x0D,;:!?\"'\]}>])"
#: Two or more groups of digits with single spaces between them, some perhaps in brackets.
SPACED = rf"(?<![^\x20\x09-\x0D\"'\[{{<]){_GROUP}(?: {_GROUP})++"
#: What an instance of a kind must look like to be taken from its context alone.
SHAPES = {
    "email": r"^[^@]+@[^@]+$",
    "ip": r"^(?:[0-9]{1,3}(?:[.:-][0-9]{1,3}){3}|[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7})$",
    "card": r"^[0-9](?:[ ./-]?[0-9]){11,18}$",
    "phone": r"^[(0-9](?:(?:\)[ -]| \(|[ ()./-])?[0-9]){6,14}$",
}
EDGES = "\"'()[]{}<>.,;:!?"
#: Windows in which the word beside a mention is sought, each only if it has no end in the one before; then the whole side.
CONTEXT = (64, 1 << 12, 1 << 18)
WORD_BREAK = r"[\x20\x09-\x0D\"'()\[\]{}<>.,;:!?]+"
#: A left or right window that may cut its word: nothing but breaks and one word, up to the edge.
CUT_LEFT, CUT_RIGHT = (f"^[^{WORD_BREAK[1:-2]}]*+[{WORD_BREAK[1:-2]}]*+$", f"^[{WORD_BREAK[1:-2]}]*+[^{WORD_BREAK[1:-2]}]*+$")
MIN_SUPPORT, MIN_CONFIDENCE, MIN_SCORE = 3, 0.5, 0.6


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)
    digit = lambda i: F.substr(turned, i, F.lit(1)).cast("int")
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0),
                        lambda acc, i: acc + F.when(i % 2 == 0, doubled(digit(i))).otherwise(digit(i)))
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def found(text: Column, pattern: str, kind: str | None) -> Column:
    """Array of (start, ord, end, kind, value) of the matches, in code points, ends exclusive."""
    order = KINDS.index(kind) if kind else len(KINDS)
    empty = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string,value:string>>")

    def place(both: Column) -> Column:
        gaps, hits = both["gaps"], both["hits"]
        size = lambda x, k: F.coalesce(F.length(F.get(x, k)), F.lit(0))
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(
            F.sequence(F.lit(0), F.size(hits) - 1), first,
            lambda acc, k: F.struct((acc["at"] + size(gaps, k) + size(hits, k)).alias("at"),
                                    F.concat(acc["starts"], F.array(acc["at"] + size(gaps, k))).alias("starts")),
            lambda acc: acc["starts"])
        row = lambda s, v: F.struct(
            s.alias("start"), F.lit(order).alias("ord"), (s + F.length(v)).alias("end"), F.lit(kind).cast("string").alias("kind"), v.alias("value"))
        return F.when(F.size(hits) == 0, empty).otherwise(let(starts, lambda st: F.transform(hits, lambda v, k: row(F.get(st, k), v))))

    spans = let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("hits")), place)
    if kind:
        spans = F.filter(spans, lambda s: valid(kind, s["value"]))
    return spans


def base_spans(text: Column) -> Column:
    """All valid base matches, by start and then kind."""
    empty = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string,value:string>>")
    has_digit = text.rlike("[0-9]")
    parts = []
    for kind in KINDS:
        need = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else F.lit(True)
        need = need if kind == "email" else need & has_digit
        parts.append(F.when(need, found(text, PATTERNS[kind], kind)).otherwise(empty))
    return F.sort_array(F.concat(*parts))


def loose_spans(text: Column, base: Column) -> Column:
    """Identifier-like words and spaced numbers that no base match touches, without the signs around them."""
    empty = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string,value:string>>")

    def trim(s: Column) -> Column:
        edges = F.lit(EDGES.replace("(", ""))
        head = F.ltrim(s["value"], edges)
        body = F.rtrim(head, F.lit(EDGES))
        start = s["start"] + F.length(s["value"]) - F.length(head)
        return F.struct(start.alias("start"), s["ord"].alias("ord"), (start + F.length(body)).alias("end"), s["kind"].alias("kind"), body.alias("value"))

    shaped = lambda s: s["value"].rlike(SHAPES["phone"]) | s["value"].rlike(SHAPES["card"])
    trimmed = F.concat(F.transform(found(text, LOOSE, None), trim), F.filter(F.transform(found(text, SPACED, None), trim), shaped))
    free = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])) & (F.length(s["value"]) > 4)
    return F.when(text.rlike("[0-9@]"), F.filter(trimmed, free)).otherwise(empty)


def _with_context(text: Column, spans: Column) -> Column:
    """Adds the lower-cased whole words left and right of each span, however long or far; empty where a side has none."""
    def side(of, cut: str, room: Column) -> Column:
        """The narrowest window that holds the whole word."""
        found = of(room)
        for width in reversed(CONTEXT):
            found = F.when((room > width) & of(F.lit(width)).rlike(cut), found).otherwise(of(F.least(room, F.lit(width))))
        return found

    def context(s: Column, length: Column) -> Column:
        left = side(lambda n: F.substr(text, s["start"] - n + 1, n), CUT_LEFT, s["start"])
        right = side(lambda n: F.substr(text, s["end"] + 1, n), CUT_RIGHT, length - s["end"])
        word = lambda w, side: F.element_at(F.concat(F.array(F.lit("")), F.array_remove(F.split(F.lower(w), WORD_BREAK), "")), side)
        last = word(left, -1)
        after = F.array_remove(F.split(F.lower(right), WORD_BREAK), "")
        return F.struct(s["start"], s["end"], s["kind"], s["value"], last.alias("left"), F.coalesce(F.get(after, F.lit(0)), F.lit("")).alias("right"))
    return let(F.length(text), lambda length: F.transform(spans, lambda s: context(s, length)))


def mark(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored: key, row hashes h and g, base spans, and all mentions with context.  Texts are not kept."""
    rows = docs.select(F.col(key).alias("id"), text_of(text).alias("t"))
    rows = rows.select("id", F.xxhash64("id", "t").alias("h"), F.hash("t").alias("g"), "t", base_spans(F.col("t")).alias("base"))
    both = let(F.col("t"), lambda t: let(F.col("base"), lambda b: _with_context(t, F.concat(b, loose_spans(t, b)))))
    return stored(rows.select("id", "h", "g", "base", F.when(F.col("t").rlike("[0-9@]"), both).alias("mentions")), "mentions")


def word_counts(docs: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """How often each wanted word (``word``) stands in all texts."""
    every = docs.select(F.explode(F.split(F.lower(text_of(text)), WORD_BREAK)).alias("word"))
    if wanted.count() <= BROADCAST_ROWS:
        return every.join(F.broadcast(wanted), "word", "left_semi").groupBy("word").agg(F.count("*").alias("total"))
    return every.groupBy("word").agg(F.count("*").alias("total")).join(wanted, "word", "left_semi")


def bootstrap(docs: DataFrame, marked: DataFrame, text: str = "text") -> DataFrame:
    """(kind, value, score) of the instances that contexts have taught, beyond the base ones."""
    flat = marked.where("mentions is not null").select(F.explode("mentions").alias("m")).select("m.*")
    sides = F.array(F.struct(F.lit("L").alias("side"), F.col("left").alias("word")), F.struct(F.lit("R").alias("side"), F.col("right").alias("word")))
    edges = stored(
        flat.select("kind", "value", F.explode(sides).alias("p")).select("kind", "value", "p.*").where("word <> ''")
        .groupBy("kind", "value", "side", "word").agg(F.count("*").alias("n")), "edges")
    known = edges.where("kind is not null").select("kind", "value").distinct()
    shaped = F.filter(F.array(*[F.when(F.col("value").rlike(SHAPES[k]), F.lit(k)) for k in KINDS]), lambda k: k.isNotNull())
    slots = stored(edges.where("kind is null").select("value", "side", "word", "n", F.explode(shaped).alias("kind")), "slots")
    seeds = stored(known.withColumn("score", F.lit(1.0)), "seeds")
    taught = seeds
    if slots.isEmpty() or seeds.isEmpty():
        return seeds.limit(0)
    # Only words beside a seed can become patterns in the first round; later rounds may need words beside slots.
    wanted = stored(edges.select("word").distinct(), "pattern-words")
    totals = stored(word_counts(docs, wanted, text), "pattern-counts")
    uses = edges.where("kind is not null").select("kind", "value", "side", "word", "n").unionByName(
        slots.select("kind", "value", "side", "word", "n"))
    size = -1
    # More instances only raise confidences, so the instances grow until nothing is added.
    while True:
        support = uses.join(taught.select("kind", "value"), ["kind", "value"], "left_semi").groupBy("kind", "side", "word").agg(
            F.count_distinct("value").alias("support"), F.sum("n").alias("held"))
        patterns = support.where(F.col("support") >= MIN_SUPPORT).join(totals, "word").select(
            "kind", "side", "word", F.least(F.col("held") / F.greatest("total", "held"), F.lit(0.99)).alias("confidence")
        ).where(F.col("confidence") >= MIN_CONFIDENCE)
        scored = slots.join(patterns, ["kind", "side", "word"]).groupBy("kind", "value").agg(
            (1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score")).where(F.col("score") >= MIN_SCORE)
        fresh = stored(scored, "taught")
        taught = seeds.unionByName(fresh)
        before, size = size, fresh.count()
        if size == before or not size:
            break
    # A value that several kinds claim goes to the surest, then to the first kind.
    rank = F.struct(F.col("score"), *[(F.col("kind") == k).cast("int") for k in KINDS])
    return fresh.groupBy("value").agg(F.max_by("kind", rank).alias("kind"), F.max("score").alias("score"))


def added_spans(docs: DataFrame, marked: DataFrame, text: str = "text") -> DataFrame:
    """Per row (h, g): the spans that the method adds."""
    taught = stored(bootstrap(docs, marked, text).select("value", F.col("kind").alias("found")), "identifiers")
    flat = marked.where("mentions is not null").select("h", "g", F.explode("mentions").alias("m")).select("h", "g", "m.*").where("kind is null")
    hits = join_checked(flat, taught, ["value"], "inner")
    order = sum((F.when(F.col("found") == k, F.lit(i)).otherwise(0) for i, k in enumerate(KINDS)), F.lit(0))
    span = F.struct("start", order.cast("int").alias("ord"), "end", F.col("found").alias("kind"), "value")
    # A word inside a longer identifier is part of it.
    inside = lambda s, o: (o["start"] <= s["start"]) & (s["end"] <= o["end"]) & (o["end"] - o["start"] > s["end"] - s["start"])
    more = hits.groupBy("h", "g").agg(F.collect_set(span).alias("all"))
    widest = F.filter("all", lambda s: ~F.exists("all", lambda o: inside(s, o)))
    return stored(more.select("h", "g", widest.alias("more")), "added")


def _listed(spans: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, ``base`` and ``spans`` (arrays of start, ord, end, kind, value).

    Null and empty texts have none.  Ties between kinds at one start go by the
    order of ``KINDS``.  Repeated rows each get a row, null keys stay null, other
    columns are not read, an empty table gives an empty result.
    """
    marked = mark(docs, key, text)
    more = added_spans(docs, marked, text)
    both = join_checked(marked, more, ["h", "g"])
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "more")))
    return both.select(F.col("id").alias(key), "base", spans.alias("spans"))


def digest(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests of ``find``: the counts and the hash are those of the base spans."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select(key, *[count(k) for k in KINDS], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
                        _listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; other columns and other texts stay.

    Only spans added by the method need a join; texts are not shuffled while
    those are few.
    """
    more = added_spans(docs, mark(docs, key, text), text).toDF("_pf_h", "_pf_g", "_pf_more")
    t = text_of(text)
    rows = docs.withColumns({"_pf_h": F.xxhash64(F.col(key), t), "_pf_g": F.hash(t), "_pf_base": base_spans(t)})
    rows = join_checked(rows, more, ["_pf_h", "_pf_g"])
    spans = F.sort_array(F.when(F.col("_pf_more").isNull(), F.col("_pf_base")).otherwise(F.concat("_pf_base", "_pf_more")))

    def cut(whole: Column) -> Column:
        t, spans = whole["t"], whole["spans"]
        piece = lambda a, b: F.substr(t, a + 1, b - a)
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        return F.aggregate(
            spans, start,
            lambda acc, s: F.struct(
                F.greatest(acc["at"], s["end"]).alias("at"),
                F.when(s["start"] >= acc["at"], F.concat(acc["out"], piece(acc["at"], s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")))
                .otherwise(acc["out"]).alias("out")),
            lambda acc: F.concat(acc["out"], piece(acc["at"], F.length(t))))

    clean = let(F.struct(t.alias("t"), F.col("_pf_spans").alias("spans")), cut)
    rows = rows.withColumn("_pf_spans", spans)
    return rows.withColumn(text, F.when(F.size("_pf_spans") == 0, F.col(text)).otherwise(clean)).select(*docs.columns)
