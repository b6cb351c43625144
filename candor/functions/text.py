"""Text features as column expressions: one narrow projection, no Python, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor import config

# fixed values: listed phrases and words, and the character classes of the features
AI_PHRASES = (
    "as an ai",
    "i'm an ai",
    "as a language model",
    "i don't have personal",
    "i can't browse",
    "i don't have access",
    "as of my last update",
    "i'm sorry, but i",
    "i understand you're looking",
    "it's important to note",
    "please note that",
    "i'd be happy to help",
    "furthermore",
    "moreover",
    "additionally",
    "in conclusion",
)
FORMAL_WORDS = ("utilize", "facilitate", "implement", "furthermore", "therefore", "however")
WHITESPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SENTENCE_END = "[.!?]+"
UPPERCASE = r"\p{IsUppercase}"
# the same classes with their rare characters behind one range, so that most characters are decided by few comparisons
_BLANK = r"[[\t-\r\x{1c}-\x{20}][[\x{85}-\x{3000}]&&" + WHITESPACE + "]]"
CAPITAL_START = f"^{WHITESPACE}*" + UPPERCASE
DIGIT = (
    r"[\p{Nd}\x{b2}\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}"
    r"\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}\x{24ea}"
    r"\x{24f5}-\x{24fd}\x{24ff}\x{2776}-\x{277e}\x{2780}-\x{2788}\x{278a}-\x{2792}"
    r"\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}]"
)
_NUMERAL = r"[[0-9][[\x{b2}-\x{10ffff}]&&" + DIGIT + "]]"
STOP_WORDS = {
    "en": "the of and to in is it that for on with as was by be this are at from his they".split(),
    "fr": "le la les de des du et un une est que qui dans en pour par sur au avec pas".split(),
    "de": "der die das und ist von zu mit den dem ein eine nicht sich auf für im auch es als".split(),
    "es": "el los las de del y un una es que en por con para se su al lo como más".split(),
}

FEATURES = (
    "char_count",
    "word_count",
    "sentence_count",
    "flesch_reading_ease",
    "flesch_kincaid_grade",
    "language",
    "is_english",
    "exclamation_ratio",
    "question_ratio",
    "period_ratio",
    "comma_ratio",
    "uppercase_ratio",
    "digit_ratio",
    "avg_word_length",
    "word_length_std",
    "avg_sentence_length",
    "sentence_length_std",
    "ai_phrase_density",
    "repetition_score",
    "formal_language_density",
    "perfect_punctuation",
)


def words(text: Column) -> Column:
    """Whitespace-separated words, without empty ones."""
    return F.array_remove(F.split(text, _BLANK + "+"), "")


def sentences(text: Column) -> Column:
    """Pieces between runs of end marks; empty pieces at the ends are kept."""
    return F.split(text, SENTENCE_END)


def occurrences(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _matching(text: Column, single: str) -> Column:
    """How many characters match, by what is left without them."""
    return F.length(text) - F.length(F.regexp_replace(text, single, ""))


def listed(text: Column, items) -> Column:
    """How many of the listed strings occur in the text."""
    total = F.lit(0)
    for item in items:
        total = total + F.contains(text, F.lit(item)).cast("int")
    return total


def _moments(values: Column) -> Column:
    """Struct of n, sum and sum of squares of an integer array; no struct is built per element."""
    zero = F.lit(0).cast("long")
    return F.struct(
        F.size(values).cast("long").alias("n"),
        F.aggregate(values, zero, lambda a, v: a + v).alias("s"),
        F.aggregate(values, zero, lambda a, v: a + v.cast("long") * v).alias("q"),
    )


def _mean(m: Column) -> Column:
    return F.when(m["n"] > 0, m["s"] / m["n"])


def _std(m: Column) -> Column:
    """Population deviation; the numerator is exact integer arithmetic."""
    spread = (m["n"] * m["q"] - m["s"] * m["s"]).cast("double")
    return F.when(m["n"] > 0, F.sqrt(spread) / m["n"])


def top_frequency(values: Column) -> Column:
    """Count of the most frequent element: sort, then the longest run."""
    none = F.lit(0).cast("long")
    start = F.struct(F.lit("").alias("last"), none.alias("run"), none.alias("best"))

    def step(a, w):
        return F.when(a["last"] == w, F.struct(a["last"].alias("last"), (a["run"] + 1).alias("run"), a["best"].alias("best"))).otherwise(
            F.struct(w.alias("last"), F.lit(1).cast("long").alias("run"), F.greatest(a["best"], a["run"]).alias("best"))
        )

    return F.aggregate(F.sort_array(values), start, step, lambda a: F.greatest(a["best"], a["run"]))


def stop_words_in(tokens: Column) -> Column:
    """Only the tokens that are a stop word of some language."""
    every = sorted({w for listed_words in STOP_WORDS.values() for w in listed_words})
    return F.filter(tokens, lambda w: w.isin(*every))


def language_vote(stop_words: Column) -> Column:
    """Struct of (minus hits, language) of the language with most stop-word hits.

    Ties go to the smaller language code.
    """

    def hits(listed_words):
        return F.size(F.filter(stop_words, lambda w: w.isin(*listed_words)))

    return F.array_min(
        F.array(
            *[
                F.struct((-hits(listed_words)).alias("miss"), F.lit(lang).alias("lang"))
                for lang, listed_words in sorted(STOP_WORDS.items())
            ]
        )
    )


def voted_language(vote: Column) -> Column:
    return F.when(vote["miss"] < 0, vote["lang"]).otherwise(F.lit("unknown"))


def with_text_features(df: DataFrame, text: str = "content", out: str = "features") -> DataFrame:
    """Add a struct of all text features; null for missing or empty text.

    The token arrays are computed once in an inner projection and shared by the
    features above it.
    """
    t = F.col(text)
    staged = df.select(
        "*",
        F.lower(t).alias("_low"),
        (F.size(F.split(F.lower(t), "[aeiouy]+")) - 1).alias("_syllables"),
        words(t).alias("_words"),
        sentences(t).alias("_pieces"),
    ).select(
        "*",
        F.size("_words").alias("_n"),
        F.transform("_words", F.length).alias("_lengths"),
        F.filter(F.transform("_pieces", lambda s: F.size(words(s))), lambda k: k > 0).alias("_spoken"),
        F.transform("_words", F.lower).alias("_lows"),
    )
    staged = staged.select(
        "*", _moments(F.col("_lengths")).alias("_wm"), _moments(F.col("_spoken")).alias("_sm"), stop_words_in(F.col("_lows")).alias("_stop")
    )
    staged = staged.select("*", language_vote(F.col("_stop")).alias("_vote"))
    return staged.select(*df.columns, F.when(F.length(t) > 0, _feature_struct(t)).alias(out))


def _feature_struct(t: Column) -> Column:
    low, lows, pieces, n = F.col("_low"), F.col("_lows"), F.col("_pieces"), F.col("_n")
    wm, sm = F.col("_wm"), F.col("_sm")
    chars = F.length(t)
    per_word = lambda hits: F.when(n > 0, hits / n).otherwise(0.0)
    per_char = lambda hits: hits / chars

    spoken = F.greatest(sm["n"], F.lit(1).cast("long"))
    per_sentence, per_syllable = n / spoken, F.col("_syllables") / n
    ease = F.lit(206.835) - F.lit(1.015) * per_sentence - F.lit(84.6) * per_syllable
    grade = F.lit(0.39) * per_sentence + F.lit(11.8) * per_syllable - F.lit(15.59)

    language = voted_language(F.col("_vote"))
    longest = top_frequency(F.filter(lows, lambda w: F.length(w) > 3))
    capitals = F.size(F.filter(pieces, lambda s: s.rlike(CAPITAL_START)))
    perfect = (F.size(pieces) >= 2) & (capitals / F.size(pieces) > 0.95)

    values = {
        "char_count": chars.cast("long"),
        "word_count": n.cast("long"),
        "sentence_count": F.size(pieces).cast("long"),
        "flesch_reading_ease": F.when(n > 0, ease).otherwise(0.0),
        "flesch_kincaid_grade": F.when(n > 0, grade).otherwise(0.0),
        "language": language,
        "is_english": (language == "en").cast("double"),
        "exclamation_ratio": per_char(occurrences(t, "!")),
        "question_ratio": per_char(occurrences(t, "?")),
        "period_ratio": per_char(occurrences(t, ".")),
        "comma_ratio": per_char(occurrences(t, ",")),
        "uppercase_ratio": per_char(_matching(t, UPPERCASE)),
        "digit_ratio": per_char(_matching(t, _NUMERAL)),
        "avg_word_length": _mean(wm),
        "word_length_std": _std(wm),
        "avg_sentence_length": _mean(sm),
        "sentence_length_std": _std(sm),
        "ai_phrase_density": per_word(listed(low, AI_PHRASES)),
        "repetition_score": F.when(n >= 2, longest / n).otherwise(0.0),
        "formal_language_density": per_word(listed(low, FORMAL_WORDS)),
        "perfect_punctuation": perfect.cast("double"),
    }
    return F.struct(*[values[name].alias(name) for name in FEATURES])


def tag_shares(df: DataFrame, lexicon: DataFrame, id: str = "id", text: str = "content", tags=("NOUN", "VERB", "ADJ", "ADV"), max_chars: int | None = None) -> DataFrame:
    """Share of each tag among the words of a text, looked up in a lexicon (word, pos).

    Words are counted per text before the lookup. A counted lexicon of moderate
    size is broadcast; a larger one is joined on the word, with the hottest words
    spread over salts. ``max_chars`` restricts the texts to a leading window.
    """
    source = F.col(text) if max_chars is None else F.substring(text, 1, max_chars)
    tokens = df.select(F.col(id), F.explode(words(F.lower(source))).alias("word"))
    counted = tokens.groupBy(id, "word").agg(F.count("*").alias("n"))
    lexicon = lexicon.groupBy("word").agg(F.collect_set("pos").alias("pos"))  # a word may have several tags
    if lexicon.limit(config.BROADCAST_ROWS + 1).count() <= config.BROADCAST_ROWS:
        tagged = counted.join(F.broadcast(lexicon), "word", "left")
    else:
        salts = 32
        spread = lexicon.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        tagged = counted.withColumn("salt", F.pmod(F.xxhash64(id), F.lit(salts)).cast("int")).join(
            spread, ["word", "salt"], "left"
        )
    total = F.sum("n")
    return tagged.groupBy(id).agg(
        total.alias("tokens"),
        *[
            (F.coalesce(F.sum(F.when(F.array_contains("pos", tag), F.col("n"))), F.lit(0)) / total).alias(f"{tag.lower()}_ratio")
            for tag in tags
        ],
    )
