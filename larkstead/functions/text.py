"""Text as tokens, scripts and languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCRIPTS = ("Latin", "Cyrillic", "Greek", "Hebrew", "Arabic", "Thai", "Hiragana", "Katakana", "Han")
#: Function words by language: our own short lists, to be replaced by a table of the same shape.
FUNCTION_WORDS = {
    "en": ("the", "and", "of", "to", "that", "is", "with", "for", "was", "on"),
    "de": ("der", "die", "und", "das", "den", "ist", "mit", "von", "zu", "ein"),
    "fr": ("le", "la", "les", "et", "des", "une", "est", "que", "pour", "dans"),
    "es": ("el", "los", "las", "que", "una", "por", "con", "para", "del", "y"),
}


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.col(text) if isinstance(text, str) else text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, n): an inverted index, each document's tokens once with counts."""
    return docs.select(key, F.explode(tokens(text)).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))


def search_term(docs: DataFrame, key: str, text: str, term: str) -> DataFrame:
    """Keys of documents with a token, without exploding: one pass over the text."""
    return docs.where(F.array_contains(tokens(text), term.lower())).select(key)


def search_prefix(docs: DataFrame, key: str, text: str, prefix: str) -> DataFrame:
    return docs.where(F.exists(tokens(text), lambda t: t.startswith(prefix.lower()))).select(key)


def document_frequency(docs: DataFrame, text: str) -> DataFrame:
    """(token, df): how many documents have each token."""
    return docs.select(F.explode(F.array_distinct(tokens(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def script_counts(text: Column | str) -> dict[str, Column]:
    """Letters of each script. Texts without letters beyond Latin ones (most) are read twice, not once a script."""
    t = F.col(text) if isinstance(text, str) else text
    latin = F.regexp_count(t, F.lit(r"\p{IsLatin}")).cast("long")
    others = t.rlike("[" + "".join(rf"\p{{Is{s}}}" for s in SCRIPTS if s != "Latin") + "]")
    return {s.lower(): latin if s == "Latin" else F.when(others, F.regexp_count(t, F.lit(rf"\p{{Is{s}}}"))).otherwise(F.when(t.isNotNull(), 0)).cast("long") for s in SCRIPTS}


def main_script(text: Column | str) -> Column:
    """The script of most letters, the first of SCRIPTS between equals; null without letters."""
    counts = list(zip(SCRIPTS, script_counts(text).values(), strict=True))
    best = F.greatest(*[c for _, c in counts])
    return F.when(best > 0, F.coalesce(*[F.when(c == best, F.lit(s)) for s, c in counts]))


def function_word_scores(text: Column | str, words: dict[str, tuple[str, ...]] = FUNCTION_WORDS) -> dict[str, Column]:
    """Tokens of a text that are function words of each language; no join. The text is cut once, to tokens that any language has."""
    every = sorted({w for of in words.values() for w in of})
    own = F.filter(tokens(text), lambda t: t.isin(*every))

    def count(of: tuple[str, ...]) -> Column:
        return F.size(F.filter(F.col("_function_words"), lambda t: t.isin(*of))).cast("long")

    return {"_function_words": own} | {lang: count(of) for lang, of in words.items()}


def guess_language(docs: DataFrame, text: str, words: dict[str, tuple[str, ...]] = FUNCTION_WORDS) -> DataFrame:
    """docs with guess and score: the language of most function words, first by name between equals; null without any."""
    scores = function_word_scores(text, words)
    scored = docs.withColumn("_function_words", scores.pop("_function_words")).withColumns({f"_{lang}": c for lang, c in scores.items()})
    best = F.greatest(*[F.col(f"_{lang}") for lang in words])
    first = F.coalesce(*[F.when(F.col(f"_{lang}") == best, F.lit(lang)) for lang in sorted(words)])
    return scored.withColumn("guess", F.when(best > 0, first)).withColumn("score", best).drop("_function_words", *[f"_{lang}" for lang in words])


def index_codes(text: Column | str) -> Column:
    """Language codes that stand alone on lines of a printed index, in order, each once."""
    t = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x.rlike("^[A-Z]{2}(-[A-Z]{2})?$")))


def index_entries(text: Column | str) -> Column:
    """(code, title, page) of index lines 'CODE title ... page'."""
    t = F.col(text) if isinstance(text, str) else text
    pattern = r"^([A-Z]{2}(?:-[A-Z]{2})?)\s+(.+?)[\s.]+(\d+)$"
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(pattern))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("code"), F.regexp_extract(x, pattern, 2).alias("title"), F.regexp_extract(x, pattern, 3).cast("int").alias("page")))
