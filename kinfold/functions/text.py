"""Built-in text expressions: tokens, token repair, sound keys, set measures, buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no identity, web words that squashed names leave out.
NOISE = ("and", "the", "of", "a", "an")
DOMAIN_WORDS = ("com", "www", "net", "org", "co", "in", "io", "biz", "info", "html")
# Digits that stand for letters in mixed words.
DIGITS, LETTERS = "01345678", "oleasgtb"
# Accented letters of the Latin tables and their plain forms.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def words(text: Column) -> Column:
    """Lower-cased ASCII words of a text, accents folded by table."""
    return F.regexp_extract_all(F.translate(F.lower(text), ACCENTED, PLAIN), F.lit("[a-z0-9]+"), F.lit(0))


def without(tokens: Column, stop: tuple[str, ...] = NOISE) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*stop))


def repaired(token: Column) -> Column:
    """Digits read as letters, in tokens that mix both."""
    mixed = F.rlike(token, F.lit("[0-9]")) & F.rlike(token, F.lit("[a-z]"))
    return F.when(mixed, F.translate(token, DIGITS, LETTERS)).otherwise(token)


def name_key(tokens: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(tokens)), " ")


def squash(tokens: Column) -> Column:
    return F.array_join(without(tokens, DOMAIN_WORDS), "")


def consonants(token: Column) -> Column:
    """The blocking skeleton: sh to s, ph to f, c to k, vowels dropped."""
    return F.translate(F.replace(F.replace(token, F.lit("sh"), F.lit("s")), F.lit("ph"), F.lit("f")), "caeiou", "k")


# The sound-alike rules, in order.
SOUND_RULES = (
    ("ph", "f"), ("sh", "s"), ("ck", "k"), ("c(?=[eiy])", "s"), ("c", "k"), ("q", "k"), ("x", "ks"),
    ("z", "s"), ("w", "v"), ("j", "g"), ("h", ""), ("[aeiouy]", ""), (r"(.)\1+", "$1"),
)


def sound_key(token: Column) -> Column:
    for pattern, to in SOUND_RULES:
        token = F.regexp_replace(token, pattern, to)
    return token


def jaccard(a: Column, b: Column) -> Column:
    """0 when either set is empty or null."""
    both = F.size(F.array_intersect(a, b)).cast("double") / F.size(F.array_union(a, b))
    return F.when((F.size(F.coalesce(a, F.array().cast("array<string>"))) > 0) & (F.size(F.coalesce(b, F.array().cast("array<string>"))) > 0), both).otherwise(0.0)


def micro_idf(total: int, df: Column) -> Column:
    """ln(1 + total / df) in millionths, an integer, so that sums don't depend on their order."""
    return F.floor(F.log(F.lit(1.0) + F.lit(float(total)) / df) * 1e6 + 0.5).cast("long")


def bucket(key: Column, n: int, salt: str = "") -> Column:
    """0 to n - 1 from md5, the same in any engine; another salt for another use."""
    text = F.concat(F.lit(salt), key.cast("string")) if salt else key.cast("string")
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n).cast("int")


# English words that n-gram counts leave out.
STOP_WORDS = ("and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")


def word_ngrams(tokens: Column, hi: int = 2, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Runs of 1 to ``hi`` words, joined by a space; stop words are taken out first."""
    def grow(kept: Column) -> Column:
        """The runs of each length, from those one word shorter and the words that follow them."""
        out, runs = [kept], kept
        for n in range(2, hi + 1):
            last = F.greatest(F.size(kept) - (n - 1), F.lit(0))
            runs = F.zip_with(F.slice(runs, F.lit(1), last), F.slice(kept, F.lit(n), last), lambda a, b: F.concat(a, F.lit(" "), b))
            out.append(runs)
        return F.concat(*out)

    return F.element_at(F.transform(F.array(without(tokens, stop)), grow), 1)


# Words that the second prototype cleaner respells.
PROTOTYPE_FORMS = {"corporation": "corp", "private": "pvt", "limited": "ltd", "incorporated": "inc", "rd": "road", "st": "street"}


def char_ngrams(token: Column, lo: int, hi: int) -> Column:
    """Character n-grams of a word padded by a space on each side, of lo to hi letters."""
    padded = F.concat(F.lit(" "), token, F.lit(" "))

    def of(n: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i: F.substr(padded, i, F.lit(n)))
        return F.when(F.length(padded) >= n, cut).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*[of(n) for n in range(lo, hi + 1)]))
