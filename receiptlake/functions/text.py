"""Text expressions: Column -> Column, all inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that decide the three spend classes; food comes before grocery.
FOOD_WORDS = (
    "restaurant", "cafe", "caf ", "kopitiam", "coffee", "kitchen", "resto",
    "bistro", "food", "nasi", "mee", "noodle", "steak", "pizza", "burger",
    "bakery", "bake", "beverage", "seafood", "grill", "dining", "eatery",
    "snack", "juice", "warung", "catering", "chicken", "rice",
    "tea", "drink", "milk",
)
GROCERY_WORDS = (
    "supermarket", "super market", "hypermarket", "hypermart", "mart",
    "grocery", "grocer", "minimart", "mini market", "sundry",
    "provision", "fresh", " market",
)
SPEND_CLASSES = ("retail", "restaurant")
FRAUD_CLASSES = ("genuine", "tampered", "multi_bill", "handwritten")


def clean_text(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def merchant_key(c: Column) -> Column:
    """Lower case ASCII words; ``&`` is read as ``and``. A name in another script becomes empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "&", " and "), "[^a-z0-9]+", " "))


def merchant_words(c: Column) -> Column:
    """Lower case letters and digits of any script, one blank between words."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def token_jaccard(a: Column, b: Column) -> Column:
    """Share of common words of two normal forms; 0 if either has none."""
    x, y = (F.filter(F.split(c, " "), lambda w: w != "") for c in (a, b))
    both, any_ = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(both / any_)


def name_similarity(a: Column, b: Column) -> Column:
    """The larger of one minus the relative edit distance and the word overlap of two normal forms; 0 if either is empty."""
    edit = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(F.greatest(edit, token_jaccard(a, b)))


def edit_distance_share(a: Column, b: Column) -> Column:
    """Edit distance by the longer length; 0 for two empty texts."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / n)


def fingerprint(merchant: Column, day: Column, total: Column) -> Column:
    """SHA-256 of merchant, day and total with two decimals, joined by bars; null total counts as 0.00."""
    amount = F.coalesce(total.cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)")).cast("string")
    return F.sha2(F.concat_ws("|", F.lower(F.trim(F.coalesce(merchant, F.lit("")))), F.trim(F.coalesce(day, F.lit(""))), amount), 256)


def document_id(name: Column) -> Column:
    """A key of letters, digits and ``_``, at most 100 long; names without any, or reserved ones, by their hash."""
    plain = F.substring(F.regexp_replace(name, "[^a-zA-Z0-9]", "_"), 1, 100)
    bad = ~F.regexp_like(plain, F.lit("[a-zA-Z0-9]")) | F.regexp_like(plain, F.lit("^__.*__$"))
    return F.when(bad, F.concat(F.lit("m_"), F.substring(F.sha2(name, 256), 1, 16))).otherwise(plain)


def _any_of(padded: Column, words: tuple[str, ...]) -> Column:
    return F.regexp_like(padded, F.lit("|".join(words)))


def spend_class(text: Column) -> Column:
    """One of three spend classes by the words a text holds anywhere, even inside others."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    return F.when(_any_of(padded, FOOD_WORDS), "Food & Beverage").when(_any_of(padded, GROCERY_WORDS), "Supermarket / Grocery").otherwise("General Retail")


def category_family(c: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    has = lambda *ws: F.regexp_like(t, F.lit("|".join(ws)))
    return F.when(has("grocery", "supermarket"), "grocery").when(has("food", "beverage", "restaurant"), "food").when(has("retail", "shopping"), "retail").otherwise("general")


def category_code(c: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(t.contains("grocery"), 0).when(t.contains("food"), 1).when(t.contains("retail"), 2).when(t.contains("restaurant"), 1).otherwise(3)


def split_category(c: Column) -> tuple[Column, Column]:
    """(spend category, fraud label): at most one is filled, both are empty for other values."""
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(t.isin(*SPEND_CLASSES), t).otherwise(""), F.when(t.isin(*FRAUD_CLASSES), t).otherwise("")


def first_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit(""))


def without_fence(c: Column) -> Column:
    """A text without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def field_messages(fields: dict[str, Column]) -> Column:
    """An array of the messages of the conditions that hold."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(text)) for text, cond in fields.items()]))


def missing_fields(fields: dict[str, Column]) -> Column:
    """The messages of the conditions that hold, joined by ``; ``."""
    return F.array_join(field_messages(fields), "; ")


def search(df: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """Rows of which one of the columns holds a term, whatever its case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(term.lower())
    return df.where(hit)


def in_category(df: DataFrame, column: str, category: str) -> DataFrame:
    """Rows whose category holds a word; ``all`` keeps every row."""
    return df if category == "all" else search(df, category, [column])


def sentence_list(parts: Column) -> Column:
    """``a``, ``a and b``, ``a, b and c``."""
    n = F.size(parts)
    head = F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 0, F.lit("")).when(n == 1, F.element_at(parts, 1)).otherwise(F.concat(head, F.lit(" and "), F.try_element_at(parts, F.lit(-1))))


def path_parts(path: Column) -> dict[str, Column]:
    """name, stem, ext, parent and depth of a path."""
    name = F.substring_index(path, "/", -1)
    return {
        "name": name,
        "stem": F.regexp_replace(name, r"\.[^.]+$", ""),
        "ext": F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)),
        "parent": F.substring_index(F.substring_index(path, "/", -2), "/", 1),
        "depth": F.size(F.split(path, "/")),
    }


def receipt_group(path: Column) -> Column:
    """The stem without ``_tampered`` and ``_tampered_v<n>`` at its end, trimmed, in lower case."""
    return F.lower(F.trim(F.regexp_replace(path_parts(path)["stem"], r"_tampered(_v\d+)?$", "")))


def words_share(text: Column, vocabulary: list[str]) -> Column:
    """Share of a text's words that are in a vocabulary."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]{3,})"), F.lit(1))
    known = F.filter(words, lambda w: w.isin(vocabulary))
    return F.size(known) / F.greatest(F.size(words), F.lit(1))


def normal_email(c: Column) -> Column:
    return F.lower(F.trim(c))


# Words of error messages by what can be done about them, the first that fits holds.
ERROR_CLASSES = {
    "unsupported": ["unsupported", "not supported", "invalid argument", "not found"],
    "quota": ["quota", "rate limit", "429", "exhausted"],
    "transient": ["503", "500", "timeout", "unavailable", "overloaded", "deadline"],
}


def error_class(message: Column) -> Column:
    """unsupported, quota, transient or permanent by the words of a message; null for a null one."""
    m, out = F.lower(message), F.lit("permanent")
    for name, words in reversed(ERROR_CLASSES.items()):
        out = F.when(F.regexp_like(m, F.lit("|".join(words))), F.lit(name)).otherwise(out)
    return F.when(message.isNotNull(), out)


def lakh_grouped(whole: Column) -> Column:
    """A whole number with its last three digits apart and the others in pairs, as in 12,34,567."""
    digits = F.abs(whole).cast("string")
    head = F.substring(digits, F.lit(1), F.greatest(F.length(digits) - 3, F.lit(0)))
    pairs = F.regexp_replace(head, r"(?<=\d)(?=(?:\d\d)+$)", ",")
    grouped = F.when(F.length(digits) > 3, F.concat(pairs, F.lit(","), F.right(digits, F.lit(3)))).otherwise(digits)
    return F.concat(F.when(whole < 0, F.lit("-")).otherwise(F.lit("")), grouped)


def found_in_text(c: Column) -> dict[str, Column]:
    """What a receipt's text holds: its number behind a word for it, how many dates and amounts, and how many words of three letters on."""
    t = F.lower(F.coalesce(c, F.lit("")))
    number = F.regexp_extract(t, r"(?:receipt|invoice|bill|inv|ref|no)\.?\s*(?:no\.?|#|:)?\s*([a-z]*\d[a-z\d-]{2,})", 1)
    return {
        "number": F.nullif(number, F.lit("")),
        "n_dates": F.size(F.regexp_extract_all(t, F.lit(r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"), F.lit(1))),
        "n_amounts": F.size(F.regexp_extract_all(t, F.lit(r"(\d+\.\d{2})"), F.lit(1))),
        "n_words": F.size(F.regexp_extract_all(t, F.lit(r"([a-z]{3,})"), F.lit(1))),
    }
