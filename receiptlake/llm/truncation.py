"""Texts that were cut off by field limits or in transfer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

# Marks that end sentences, quotes that may close behind them, the mark of a character cut in two.
TERMINATORS = ".!?。！？।"
CLOSERS = "\"'”’»」』"
BROKEN = "�"
#: A final word is unknown if the texts that hold it before their end are at most this share of those that end in it.
UNKNOWN = 0.02
#: Open ends gather at a length if their odds are this many times those of the source's other texts, by a likelihood ratio
#: of at least RATIO (p < 0.001), both over distinct texts.
ODDS, RATIO = 4.0, 10.83
#: Share of the texts of a kind or source that close, from which on an open end is unusual there.
SENTENCES = 0.8
#: Share of the texts of a kind that end in recurring lines, from which on other last lines count as cut; a recurring line
#: is the last of at least RECURRING of the kind's distinct texts.
FIXED, RECURRING = 0.9, 0.005
#: Width of the windows of lengths in which texts cut at a word's end gather below a limit.
WINDOW = 16


#: What may stand behind an end, read backwards: blanks, closing tags, symbols and invisible marks.
_BEHIND = r"(?:>\s*/?\w+/?<|[\p{So}\p{Sk}\p{Cf}&&[^\x{FFFD}]]|[\p{Z}\s\x{FE0F}\x{1F3FB}-\x{1F3FF}])*+"
#: Characters of an end in which marks, the final word and a signature are looked for; longer ones have none.
END = 400
#: A last line up to this long recurs if only its numbers differ, a longer one if it is the same.
LINE = 200


def _run(backwards: Column, pattern: str) -> Column:
    """Length of the run at the start of a reversed text that the pattern matches, so that only the run is scanned."""
    return F.length(F.regexp_extract(backwards, f"^{pattern}", 0))


def _plain(text: Column) -> Column:
    """In lower case, with usual blanks and without accents and invisible marks."""
    blanks = F.regexp_replace(F.regexp_replace(F.lower(text), r"\p{Cf}", ""), r"[\p{Z}\t]+", " ")
    return F.translate(blanks, "áàâäãéèêëíìîïóòôöõúùûüñç", "aaaaaeeeeiiiiooooouuuunc")


def _shape(line: Column) -> Column:
    """A line with its numbers alike; digits behind a decimal mark keep their count."""
    return F.regexp_replace(F.regexp_replace(F.trim(_plain(line)), r"\d", "9"), r"(?<![.9])9+", "9")


def _signed(end: Column) -> Column:
    """Whether the last lines, reversed, are a signature: a name of up to three words, above it up to three words that no
    sentence mark ends, and above these nothing or a closed sentence."""
    few = r"[\p{L}\p{M}.'-]+(?:[\p{Z} ]+[\p{L}\p{M}.'-]+){0,2}"
    plain = r"[\p{L}\p{M}'-]+(?:[\p{Z} ]+[\p{L}\p{M}'-]+){0,2}"
    return F.regexp_like(end, F.lit(rf"^{few}[\p{{Z}}\t ]*[\r\n][\p{{Z}}\s]*[,.!]?[\p{{Z}} ]*{plain}[\p{{Z}}\t ]*(?:$|[\r\n][\p{{Z}}\s]*(?:$|[{CLOSERS}]*[{TERMINATORS}]))"))


def known_prefixes(bodies: DataFrame, ends: DataFrame) -> DataFrame:
    """(word) of ends(word, tid) that is an unknown word and a proper prefix of known ones: a node of the vocabulary's trie, not a word.

    bodies(body): all texts without their final word. A word is known by the texts that hold it there. An end is unknown if
    those are at most ``UNKNOWN`` of the texts that end in it, and it begins known words if at least as many texts hold or end in
    longer words of that beginning as different texts end in it. Both are shares, so nothing fades as the corpus grows. Of the trie
    only the depths at which some text ends are made, and only its nodes at which one does are kept.
    """
    vocabulary = cut(bodies.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("body"), F.lit(r"([\p{L}\p{M}]++)"), F.lit(1)))).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "vocabulary")
    at_end = cut(ends.groupBy("word").agg(F.count("*").alias("m"), F.countDistinct("tid").alias("texts")), "end_words")
    depths = sorted(r[0] for r in at_end.select(F.length("word")).distinct().collect())  # as many as the longest word has letters
    steps = F.filter(F.array(*map(F.lit, depths)) if depths else F.array().cast("array<int>"), lambda i: i < F.length("word"))
    held = vocabulary.select("word", "n").union(at_end.select("word", "m"))
    nodes = held.select("n", F.explode(F.transform(steps, lambda i: F.substring(F.col("word"), F.lit(1), i))).alias("word")).groupBy("word").agg(F.sum("n").alias("longer"))
    known = vocabulary.select("word", "n")
    return at_end.join(nodes, "word").where("longer >= texts").join(known, "word", "left").where(F.coalesce("n", F.lit(0)) <= F.col("m") * UNKNOWN).select("word")


def _lengths() -> Column:
    """The lengths at which a text counts: its characters, its bytes, and windows of characters in two alignments."""
    return F.array(
        F.concat(F.lit("c"), F.col("n_chars")), F.concat(F.lit("b"), F.col("n_bytes")), F.concat(F.lit("w"), F.floor(F.col("n_chars") / WINDOW)), F.concat(F.lit("v"), F.floor((F.col("n_chars") + WINDOW // 2) / WINDOW))
    )


def limits(texts: DataFrame) -> DataFrame:
    """(source, habit, at): the lengths of each source at which open ends gather, by characters, bytes and windows, out of distinct
    texts (source, n_chars, n_bytes, open). habit is the share of the source's texts that close.

    A field's limit cuts texts at one length, so that many open ends lie there beside few or no closed ones; whole texts of
    that length close as often as others.
    """
    per = texts.select("source", "open", F.explode(_lengths()).alias("at")).groupBy("source", "at").agg(F.count("*").cast("double").alias("n"), F.count_if("open").cast("double").alias("o"))
    whole = texts.groupBy(F.col("source").alias("_s")).agg(F.count("*").cast("double").alias("nn"), F.count_if("open").cast("double").alias("oo"))
    j = per.join(whole, F.col("source").eqNullSafe(F.col("_s"))).select("source", "at", "n", "o", "nn", "oo", (F.col("n") * F.col("oo") / F.col("nn")).alias("e"))
    term = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    ratio = 2 * (term(F.col("o"), F.col("e")) + term(F.col("n") - F.col("o"), F.col("n") - F.col("e")))
    gathered = (F.col("o") > F.col("e")) & (ratio >= RATIO) & (F.col("o") * (F.col("nn") - F.col("oo") + 0.5) >= ODDS * F.col("oo") * (F.col("n") - F.col("o")))
    return j.groupBy("source").agg((1 - F.first("oo") / F.first("nn")).alias("habit"), F.collect_list(F.when(gathered, F.col("at"))).alias("limits"))


def endings(df: DataFrame, key: str = "doc_id", text: str = "text", kind: str = "doc_type", source: str = "source") -> DataFrame:
    """(key, source, kind, n_chars, cut, why, trie, at_limit) of all rows; cut says whether the rest of the text was lost.

    Two pieces of evidence decide first, on texts with an open end, that is without a mark that ends a sentence:
    - ``word``: the final word is unknown and the beginning of known ones (``trie``); not in a signature, unless at a limit;
    - ``length``: the text has a length at which the source's open ends gather (``at_limit``), though the source's texts close.
    ``word+length`` has both. What both leave open is judged by the end alone:
    - ``broken``: it ends in the mark that stands for a character cut in two;
    - ``ellipsis``: it ends in an ellipsis though texts of its kind end like sentences;
    - ``sentence``: it ends neither like a sentence nor signed, though texts of its kind do;
    - ``line``: its last line is none of the recurring ones, though texts of its kind end in such;
    - ``amount``: at a limit it ends in an amount with a decimal mark and nothing behind.
    Kinds and sources are told apart by their own distinct texts; a null one is one too. Null, empty and blank texts are not
    cut; a text of only marks isn't either. Repeated texts of a source are judged alike; repeated keys give their rows.
    """
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.col(kind), F.lit("")).alias("kind"), F.col(source).alias("source"))
    back = docs.select("key", "kind", "source", F.length("text").alias("n_chars"), F.octet_length("text").alias("n_bytes"), F.xxhash64("text").alias("tid"), F.reverse("text").alias("back"))
    back = back.withColumn("run", _run(F.col("back"), _BEHIND))
    back = back.select("*", F.substring(F.col("back"), F.col("run") + 1, F.lit(END)).alias("end"))
    line = F.reverse(F.regexp_extract(F.substring(F.col("back"), F.col("run") + 1, F.col("n_chars")), r"^[^\r\n]*", 0))
    full = F.coalesce(F.length(F.regexp_extract("end", r"[^\p{Z}\s\p{Cf}]", 0)) > 0, F.lit(False))
    ended = F.regexp_like("end", F.lit(rf"^[{CLOSERS}]*[{TERMINATORS}]"))
    word = F.when(~ended, F.lower(F.reverse(F.regexp_extract("end", rf"^{BROKEN}*([\p{{L}}\p{{M}}]*+)", 1)))).otherwise("")
    back = back.select("*", line.alias("l"))
    at = cut(
        back.select(
            "key", "kind", "source", "n_chars", "n_bytes", "tid", F.regexp_like("end", F.lit(f"^{BROKEN}")).alias("broken"), full.alias("full"), ended.alias("ended"), _signed(F.col("end")).alias("signed"),
            F.regexp_like("end", F.lit(rf"^[{CLOSERS}]*(?:\.\.\.|…)")).alias("ellipsis"),
            F.regexp_like("end", F.lit(r"^\.(?:\d{3},)*\d{1,3}\s?(?:MR|RYM|£|\$|PBG|DSU|DUA|DGS)")).alias("amount"),
            F.when(F.length("l") <= LINE, _shape(F.col("l"))).otherwise(F.concat(F.lit("#"), F.xxhash64("l"))).alias("line"), word.alias("word"),
        ),
        "endings",
    )
    some = at.where("full")
    # an ellipsis is no end of a sentence of its own: in kinds that close it stands for the rest
    texts = cut(some.groupBy("kind", "source", "tid", "n_bytes").agg(*(F.first(c).alias(c) for c in ("line", "n_chars")), F.first(F.expr("NOT ended AND NOT signed OR ellipsis")).alias("open")), "texts")
    by_line = texts.groupBy("kind", "line").agg(F.count("*").alias("n"))
    total = texts.groupBy("kind").agg(F.count("*").alias("total"), F.avg(F.when(F.col("open"), 0.0).otherwise(1.0)).alias("sentences"))
    recurring = by_line.join(total, "kind").where(F.col("n") >= F.greatest(F.lit(2), F.col("total") * RECURRING)).select("kind", "line", "n")
    fixed = recurring.groupBy("kind").agg(F.sum("n").alias("fixed"))
    style = total.join(fixed, "kind", "left").select("kind", F.when(F.col("sentences") >= SENTENCES, "sentences").when(F.col("fixed") >= FIXED * F.col("total"), "lines").otherwise("free").alias("style"))
    bodies = docs.select("text", (F.length("text") - _run(F.reverse("text"), rf"{_BEHIND}{BROKEN}*+[\p{{L}}\p{{M}}]*+")).alias("n")).select(F.substring(F.col("text"), F.lit(1), F.col("n")).alias("body"))
    trie = known_prefixes(bodies, some.where("word <> ''").select("word", "tid")).select("word", F.lit(True).alias("trie"))
    peaks = limits(texts).select(F.col("source").alias("_s"), "habit", "limits")
    got = some.withColumn("word", F.when(F.col("word") != "", F.col("word")).otherwise(F.concat(F.lit("\x00"), F.col("tid"))))  # what can't match isn't one key
    got = got.join(style, "kind").join(recurring.select("kind", "line", F.lit(True).alias("recurs")), ["kind", "line"], "left").join(trie, "word", "left").join(peaks, F.col("source").eqNullSafe(F.col("_s")))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    opened = ~F.col("ended")
    sentences, lines = F.col("style") == "sentences", F.col("style") == "lines"
    gathers = F.arrays_overlap("limits", _lengths())
    at_limit = gathers & (F.col("habit") >= SENTENCES) & opened & ~F.col("signed")
    begun = yes("trie") & (~F.col("signed") | lines | gathers) & ~(lines & yes("recurs"))
    why = (
        F.when(begun & at_limit, "word+length")
        .when(begun, "word")
        .when(at_limit, "length")
        .when(F.col("broken"), "broken")
        .when(sentences & F.col("ellipsis"), "ellipsis")
        .when(sentences & opened & ~F.col("signed"), "sentence")
        .when(lines & ~yes("recurs"), "line")
        .when(sentences & gathers & F.col("amount"), "amount")
    )
    judged = got.select("key", "source", "kind", "n_chars", why.alias("why"), begun.alias("trie"), at_limit.alias("at_limit"))
    rest = at.where("NOT full").select("key", "source", "kind", "n_chars", F.lit(None).cast("string").alias("why"), F.lit(False).alias("trie"), F.lit(False).alias("at_limit"))
    return judged.union(rest).select(F.col("key").alias(key), "source", "kind", "n_chars", F.col("why").isNotNull().alias("cut"), "why", "trie", "at_limit")


def report(ends: DataFrame) -> DataFrame:
    """(source, n_docs, n_cut, cut_share) of all rows, null and blank ones included."""
    return ends.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("cut").cast("long")).alias("n_cut"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("cut_share"))


def evidence(ends: DataFrame) -> DataFrame:
    """(kind, why, trie, at_limit, n): how many texts each piece of evidence decides."""
    return ends.groupBy("kind", "why", "trie", "at_limit").agg(F.count("*").alias("n"))
