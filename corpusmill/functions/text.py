"""Token-level expressions (operators X1-X15, X20-X24).

Everything here builds ``Column`` expressions, so tokenization runs inside the
JVM next to the scan: no Python per row.  Token arrays are processed with
higher-order functions (``transform``/``filter``/``zip_with``) so that
positional operators (bigrams, chunks) need no window or shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical tokens.
# ---------------------------------------------------------------------------
# ASCII punctuation as in Python's string.punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Punctuation stripped by the sentence word tokenizer (X10): the set above
# without . , ! ? $ plus typographic quotes.
SENTENCE_STRIP = "\"#%&'();:*+-/<=>@[\\]^_`{|}~‘’“”"
# Indicator tokens of the plain tokenizer.
PLAIN_NUMBER = "num_indic"
PLAIN_CURRENCY = "curr_indic"
PLAIN_CHEMICAL = "chem_indic"
# Indicator tokens of the index tokenizer (X7), spelled as in the reference.
INDEX_NUMBER = "number_inidicator"
INDEX_CURRENCY = "currency_inidicator"
INDEX_CHEMICAL = "chemical_inidicator"
# English stopword list (the public NLTK English list).
STOPWORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you",
    "you're", "you've", "you'll", "you'd", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "she's", "her", "hers",
    "herself", "it", "it's", "its", "itself", "they", "them", "their",
    "theirs", "themselves", "what", "which", "who", "whom", "this", "that",
    "that'll", "these", "those", "am", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "having", "do", "does", "did",
    "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as",
    "until", "while", "of", "at", "by", "for", "with", "about", "against",
    "between", "into", "through", "during", "before", "after", "above",
    "below", "to", "from", "up", "down", "in", "out", "on", "off", "over",
    "under", "again", "further", "then", "once", "here", "there", "when",
    "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own",
    "same", "so", "than", "too", "very", "s", "t", "can", "will", "just",
    "don", "don't", "should", "should've", "now", "d", "ll", "m", "o", "re",
    "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't", "didn",
    "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't",
    "haven", "haven't", "isn", "isn't", "ma", "mightn", "mightn't", "mustn",
    "mustn't", "needn", "needn't", "shan", "shan't", "shouldn", "shouldn't",
    "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn",
    "wouldn't",
]
# Extra words of the word-utility tokenizer.
EXTRA_STOPWORDS = ["'s", "n't", "'t", "nt", "didn"]
# Abbreviations that keep their trailing dot in the sentence tokenizer
# and do not end a sentence (X16); numbers 1-39 and single letters are added
# by rule in ABBREVIATIONS below.
ABBREVIATION_WORDS = [
    "u.s", "fig", "figs", "no", "ser", "jan", "feb", "mar", "apr", "may",
    "jun", "jul", "aug", "sep", "oct", "nov", "dec", "proc", "natl", "sci",
    "al", "biochem", "mol", "res", "biophys", "commun", "acad", "chem", "med",
    "biol", "enzymol", "Am", "Soc", "pat", "nos", "id", "seq", "gen", "ed",
    "publ", "cell", "ii", "iii", "iv", "viral", "dis", "infect", "rev",
    "supp", "dev", "pp", "genet", "pp", "nucl", "pub", "etc", "virol",
    "u.s. pat", "u.s. ser", "u.s. patent", "ann", "microbiol", "environ",
    "U.S", "curr", "vol", "enz", "struct", "exp", "approx", "int", "oncol",
    "appl", "math", "adv", "u.s.c", "et", "app", "biosci", "molec",
]
ABBREVIATIONS = sorted(set(ABBREVIATION_WORDS)
                       | {str(i) for i in range(1, 40)}
                       | set("abcdefghijklmnopqrstuvwxyz"))
# Minimum sentence length and table-row rule of the sentence merger.
MIN_SENTENCE_LENGTH = 50
MAX_TABLE_ROW_LENGTH = 100
# Minimum node length of the paragraph extractor.
MIN_PARAGRAPH_NODE_LENGTH = 50

# ---------------------------------------------------------------------------
# Patterns.  Explicit ASCII classes so that Java regex (Spark) and RE2
# (DuckDB oracle) agree; Python 2's ``\s`` without the unicode flag is the
# same set.
# ---------------------------------------------------------------------------
WHITESPACE = r"[ \t\n\r\f\x0B]+"
# Python float() grammar after removing commas (lower-cased input).
NUMBER_PATTERN = (r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?"
                  r"|nan|inf|infinity)\z")
# Letters of words that need no pattern (X10); words with others are right too, but slower.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœšž"


def _lit(s: str) -> Column:
    return F.lit(s)


def whitespace_split(text: Column) -> Column:
    """Split on runs of whitespace, dropping empty strings."""
    return F.filter(F.split(text, WHITESPACE), lambda t: t != "")


def strip_chars(tok: Column, chars: str = PUNCTUATION) -> Column:
    """Strip a character set from both ends."""
    return F.btrim(tok, _lit(chars))


def _class(chars: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"


def stripped_tokens(text: Column, chars: str = PUNCTUATION) -> Column:
    """X1 and X2 in lower case: the tokens of a text without ``chars`` at their ends, empty ones dropped.  The ends are cut
    out of the whole text by one pattern, which costs far less than a call for each token."""
    end, run = r"[^ \t\n\r\f\x0B]", _class(chars)
    return whitespace_split(F.regexp_replace(F.lower(text), f"(?<!{end}){run}++|(?<!{run}){run}++(?!{end})", ""))


def is_number(tok: Column) -> Column:
    """Token parses as a float once commas are removed."""
    return F.regexp_replace(tok, ",", "").rlike(NUMBER_PATTERN)


def is_number_stripped(tok: Column) -> Column:
    """X3 for tokens already stripped of punctuation: such a number starts
    with a digit (signs and dots are punctuation) or is nan/inf/infinity.
    The cheap first-character test skips the regex for ordinary words."""
    first = F.substring(tok, 1, 1)
    return ((first >= "0") & (first <= "9") & is_number(tok)) | tok.isin("nan", "inf", "infinity")


def is_currency(tok: Column) -> Column:
    """Token starts with a dollar sign."""
    return tok.startswith("$")


def hyphens(tok: Column) -> Column:
    return F.length(tok) - F.length(F.replace(tok, _lit("-"), _lit("")))


def is_chemical(tok: Column) -> Column:
    """More than three hyphens."""
    return tok.contains("-") & (hyphens(tok) > 3)


def is_chemical_new(tok: Column) -> Column:
    """(more than two hyphens and length >= 25) or length >= 40."""
    return ((hyphens(tok) > 2) & (F.length(tok) >= 25)) | (F.length(tok) >= 40)


def is_stopword(tok: Column, words=None) -> Column:
    # isin with > 10 literals is turned into a hash-set lookup by the optimizer
    return tok.isin(list(words or STOPWORDS))


def plain_tokens(text: Column, min_size: int = 1) -> Column:
    """Lower, strip punctuation, map numbers/currency/chemicals to
    indicators, keep tokens of at least ``min_size`` characters."""
    toks = stripped_tokens(text)
    toks = F.transform(
        toks,
        lambda s: F.when(is_number_stripped(s), _lit(PLAIN_NUMBER))
        .when(is_currency(s), _lit(PLAIN_CURRENCY))
        .when(is_chemical(s), _lit(PLAIN_CHEMICAL))
        .otherwise(s))
    return F.filter(toks, lambda s: F.length(s) >= min_size)


def index_unigrams(text: Column, min_size: int = 3) -> Column:
    """X7 without its stemmer: lower, strip, indicators, drop stopwords,
    keep tokens of at least ``min_size`` characters.  The stemmed form is
    :func:`corpusmill.functions.stem.stemmed_unigrams`."""
    toks = stripped_tokens(text)
    toks = F.transform(
        toks,
        lambda s: F.when(is_number_stripped(s), _lit(INDEX_NUMBER))
        .when(is_currency(s), _lit(INDEX_CURRENCY))
        .when(is_chemical(s), _lit(INDEX_CHEMICAL))
        .when(is_stopword(s), F.lit(None).cast("string"))
        .otherwise(s))
    return F.filter(toks, lambda s: s.isNotNull() & (F.length(s) >= min_size))


def word_unigrams(text: Column, min_size: int = 3) -> Column:
    """X11: lower, strip, drop stopwords, keep tokens of at least
    ``min_size`` characters; numbers, currency and chemicals stay as they are."""
    return F.filter(stripped_tokens(text), lambda s: (F.length(s) >= min_size) & ~is_stopword(s))


def bigrams(unigrams: Column) -> Column:
    """Previous kept unigram + space + current (a dropped token does not
    break the pair, because the input holds kept tokens only)."""
    n = F.size(unigrams)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(
        F.zip_with(F.slice(unigrams, 1, n - 1), F.slice(unigrams, 2, n - 1),
                   lambda a, b: F.concat(a, _lit(" "), b)))


def token_bucket(tok: Column) -> Column:
    """Empty / number / stopword / word."""
    return (F.when(F.trim(tok) == "", _lit("empty"))
            .when(is_number(tok), _lit("number"))
            .when(is_stopword(tok, STOPWORDS + EXTRA_STOPWORDS), _lit("stopword"))
            .otherwise(_lit("word")))


def is_valid_stem(tok: Column) -> Column:
    """Length > 1, not a number, not starting with a digit."""
    return (F.length(tok) > 1) & ~is_number(tok) & ~tok.rlike(r"^[0-9]")


def digit_punct_tokens(text: Column) -> Column:
    """X12 without lemmatizer/stemmer: digits and punctuation become spaces,
    split, lower, drop stopwords (with the extra list)."""
    cleaned = F.regexp_replace(F.lower(text), r"[0-9!-/:-@\[-`{-~]", " ")
    toks = whitespace_split(cleaned)
    return F.filter(toks, lambda s: ~is_stopword(s, STOPWORDS + EXTRA_STOPWORDS))


def sentence_word_tokens(text: Column) -> Column:
    """Words with separated leading/trailing sentence punctuation.

    Strip the reduced set, map number/currency/chemical (new rule); else
    split ``^([.,!?;:]*)(.+?)([.,!?;:]?)$`` into three parts, re-strip each,
    and glue a trailing dot back onto known abbreviations.  A word of letters
    only, or of letters and one mark, as most are, needs neither the patterns nor the strips.
    """
    toks = stripped_tokens(text, SENTENCE_STRIP)
    pat = r"^([.,!?;:]*)(.+?)([.,!?;:]?)$"

    def ordinary(s):
        return (F.length(s) < 40) & ~s.isin("nan", "inf", "infinity")

    def marked(s):
        word = F.substring(s, F.lit(1), F.length(s) - 1)
        return F.when(word.isin(ABBREVIATIONS), F.array(s)).otherwise(F.array(word, F.right(s, F.lit(1))))

    def parts(s):
        lead = strip_chars(F.regexp_extract(s, pat, 1), SENTENCE_STRIP)
        mid = strip_chars(F.regexp_extract(s, pat, 2), SENTENCE_STRIP)
        tail = strip_chars(F.regexp_extract(s, pat, 3), SENTENCE_STRIP)
        # through an array of one, so that each part is found once
        split3 = F.flatten(F.transform(
            F.array(F.struct(lead.alias("lead"), mid.alias("mid"), tail.alias("tail"))),
            lambda p: F.when(p["mid"].isin(ABBREVIATIONS), F.array(p["lead"], F.concat(p["mid"], p["tail"])))
            .otherwise(F.array(p["lead"], p["mid"], p["tail"]))))
        other = F.translate(s, LETTERS, "")
        return (F.when((other == "") & ordinary(s), F.array(s))
                .when(other.isin(".", ",", "!", "?") & (F.right(s, F.lit(1)) == other) & (F.length(s) < 40)
                      & ordinary(F.substring(s, F.lit(1), F.length(s) - 1)), marked(s))
                .when(is_number(s), F.array(_lit(PLAIN_NUMBER)))
                .when(is_currency(s), F.array(_lit(PLAIN_CURRENCY)))
                .when(is_chemical_new(s), F.array(_lit(PLAIN_CHEMICAL)))
                .otherwise(split3))

    return F.filter(F.flatten(F.transform(toks, parts)), lambda s: s != "")


def chunk_bounds(n: Column, parts: int) -> Column:
    """Start offsets (0-based) and lengths of ``parts`` chunks of a list
    of length n: size floor(n/parts), the last chunk takes the rest; a list
    shorter than ``parts`` goes whole into chunk 1 (the others are empty)."""
    size = F.floor(n / parts).cast("int")
    return F.transform(
        F.sequence(F.lit(1), F.lit(parts)),
        lambda i: F.struct(
            i.alias("part_no"),
            F.when(size == 0, F.lit(0)).otherwise((i - 1) * size).alias("start"),
            F.when(size == 0, F.when(i == 1, n).otherwise(F.lit(0)))
            .when(i == parts, n - (i - 1) * size)
            .otherwise(size).alias("len")))
