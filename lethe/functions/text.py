"""Text column expressions with Python's string semantics, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's \w for str: letters, numbers, underscore (Java's own \w is ASCII).
WORD = r"[\p{L}\p{N}_]"
# The characters str.split() and str.strip() treat as blank.
BLANK = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
# string.punctuation as ranges.
ASCII_PUNCTUATION = r"[!-/:-@\[-`{-~]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def is_nonblank(text: Column) -> Column:
    return F.coalesce(strip(text) != "", F.lit(False))


def digest(*columns: Column) -> Column:
    """256-bit key of the given values; lengths keep ('ab','c') and ('a','bc') apart."""
    parts = [
        F.concat(F.coalesce(F.length(c), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(c, F.lit("")))
        for c in columns
    ]
    key = F.unhex(F.sha2(F.concat_ws("|", *parts), 256))
    # Never null, and declared so: joins on it then add no null test that hashes the text again.
    return F.coalesce(key, F.lit(b""))


def question(text: Column) -> Column:
    """Text up to the first question mark; the mark is added when there is none."""
    return F.concat(F.substring_index(text, "?", 1), F.lit("?"))


def first_line(text: Column) -> Column:
    return strip(F.substring_index(text, "\n", 1))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{WORD}+")).cast("bigint")


# Lower-case letters that equal another letter when case is ignored.
VARIANTS = {
    "ı": "i",
    "ſ": "s",
    "µ": "μ",
    "ς": "σ",
    "ϐ": "β",
    "ϑ": "θ",
    "ϰ": "κ",
    "ϖ": "π",
    "ϕ": "φ",
    "ϱ": "ρ",
    "ϵ": "ε",
    "\u0345": "ι",
    "\u1fbe": "ι",
    "\u1fd3": "\u0390",
    "\u1fe3": "\u03b0",
    "ẛ": "ṡ",
    "\ufb05": "\ufb06",
}
DOTTED_I = "i\u0307"  # lower case of the capital I with a dot


def fold(text: Column) -> Column:
    """Lower case with the case-insensitive variants (long s, final sigma, ...) made equal.

    Two texts that match letter by letter ignoring case fold to the same text.
    """

    def plain(t: Column) -> Column:
        special = F.contains(t, F.lit(DOTTED_I))
        for letter in VARIANTS:
            special = special | F.contains(t, F.lit(letter))
        mapped = F.translate(
            F.replace(t, F.lit(DOTTED_I), F.lit("i")), "".join(VARIANTS), "".join(VARIANTS.values())
        )
        return F.when(special, mapped).otherwise(t)

    return let(F.lower(text), plain)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD}+)"), F.lit(1))


def _run_starts(s: Column) -> Column:
    """Indices at which a sorted array changes its value."""
    return F.filter(
        F.transform(s, lambda _, i: i), lambda i: (i == 0) | (F.get(s, i - 1) != F.get(s, i))
    )


def run_lengths(items: Column) -> Column:
    """How often each distinct item occurs, in n log n per row."""

    def lengths(s: Column) -> Column:
        return let(
            _run_starts(s),
            lambda st: F.transform(st, lambda x, j: F.coalesce(F.get(st, j + 1), F.size(s)) - x),
        )

    return let(F.sort_array(items), lengths)


def _numbered(items: Column) -> Column:
    """Give equal items distinct names ('a 1','a 2'), so set operations respect multiplicity."""

    def number(s: Column) -> Column:
        def spell(st: Column) -> Column:
            return F.flatten(
                F.transform(
                    st,
                    lambda x, j: F.transform(
                        F.sequence(F.lit(1), F.coalesce(F.get(st, j + 1), F.size(s)) - x),
                        lambda k: F.concat(F.get(s, x), F.lit(" "), k.cast("string")),
                    ),
                )
            )

        return let(_run_starts(s), spell)

    return let(F.sort_array(items), number)


def match_tokens(text: Column) -> Column:
    """Tokens for answer comparison: lower case, no ASCII punctuation, no articles."""
    bare = F.regexp_replace(F.lower(text), ASCII_PUNCTUATION, "")
    no_articles = F.regexp_replace(bare, rf"(?<!{WORD})(a|an|the)(?!{WORD})", " ")
    return F.regexp_extract_all(no_articles, F.lit(rf"([^{BLANK}]+)"), F.lit(1))


def match_form(text: Column) -> Column:
    return F.array_join(match_tokens(text), " ")


def exact_match(prediction: Column, reference: Column) -> Column:
    return (match_form(prediction) == match_form(reference)).cast("double")


def _f1(p: Column, r: Column, common: Column) -> Column:
    precision = common / p
    recall = common / r
    return (
        F.when((p == 0) | (r == 0), (p == r).cast("double"))
        .when(common == 0, F.lit(0.0))
        .otherwise(2 * precision * recall / (precision + recall))
    )


def _numbered_tokens(text: Column) -> Column:
    return _numbered(match_tokens(text))


def _numbered_f1(p: Column, r: Column) -> Column:
    return let(F.size(F.array_intersect(p, r)), lambda common: _f1(F.size(p), F.size(r), common))


def token_f1(prediction: Column, reference: Column) -> Column:
    """Multiset token F1; two empty texts count as equal."""
    both = F.struct(_numbered_tokens(prediction).alias("p"), _numbered_tokens(reference).alias("r"))
    return let(both, lambda b: _numbered_f1(b["p"], b["r"]))


def best_token_f1(prediction: Column, aliases: Column) -> Column:
    """Highest token F1 over an array of accepted answers."""
    return let(
        _numbered_tokens(prediction),
        lambda p: F.array_max(
            F.transform(aliases, lambda a: let(_numbered_tokens(a), lambda r: _numbered_f1(p, r)))
        ),
    )


def ngrams(tokens: Column, n: int) -> Column:
    """Neighboring tokens joined by a space; empty when there are fewer than n."""
    count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    grams = F.slice(tokens, 1, count)
    for k in range(1, n):
        grams = F.zip_with(grams, F.slice(tokens, k + 1, count), lambda a, b: F.concat(a, F.lit(" "), b))
    return grams


def ngram_entropy(tokens: Column, n: int) -> Column:
    """Shannon entropy in bits of the n-grams of a token array; 0 when shorter than n."""

    def entropy(counts: Column) -> Column:
        total = F.aggregate(counts, F.lit(0), lambda acc, c: acc + c)
        weighted = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c * F.log2(c))
        return F.when(F.size(counts) == 0, F.lit(0.0)).otherwise(F.log2(total) - weighted / total)

    return let(run_lengths(let(tokens, lambda t: ngrams(t, n))), entropy)


def weighted_entropy(h2: Column, h3: Column) -> Column:
    return ((F.lit(2.0) / 3.0) * h2 + (F.lit(4.0) / 3.0) * h3) / 2.0


def fluency(text: Column) -> Column:
    """Struct(h2, h3) of bigram and trigram entropy; the text is split once."""
    return let(
        entropy_tokens(text),
        lambda t: F.struct(ngram_entropy(t, 2).alias("h2"), ngram_entropy(t, 3).alias("h3")),
    )


# Abbreviations after which a full stop ends no sentence. They stand in for a trained model of them.
ABBREVIATIONS = ["dr", "mr", "mrs", "ms", "prof", "st", "jr", "sr", "vs", "etc", "inc", "e.g", "i.e", "gen", "col", "gov", "sen", "rev"]
# The public Treebank rules for words, in their order, as pattern and replacement. A line is a sentence.
TREEBANK = [
    # Quotes that open.
    ("(?=[«“‘„`])([«“‘„]|`+)", " $1 "),
    ('(?m)^"', "``"),
    ("(``)", " $1 "),
    ("([ (\\[{<])(\"|'{2})", "$1 `` "),
    (f"(?i)(')(?!re|ve|ll|m|t|s|d|n)({WORD})(?!{WORD})", "$1 $2"),
    # Marks; the full stop only at the end of the sentence.
    ("(?m)([^.])(\\.)([\\])}>\"'»”’ ]*) *$", "$1 $2 $3 "),
    ("([:,])([^\\p{Nd}\n])", " $1 $2"),
    ("(?m)([:,])$", " $1 "),
    ("(\\.{2,})", " $1 "),
    ("([;@#$%&])", " $1 "),
    ("(?m)([^.])(\\.)([\\])}>\"']*) *$", "$1 $2$3 "),
    ("([?!])", " $1 "),
    ("([^'])' ", "$1 ' "),
    ("([*])", " $1 "),
    # Brackets and dashes.
    ("([\\]\\[(){}<>])", " $1 "),
    ("--", " -- "),
    ("(?m)^(.*)$", " $1 "),
    # Quotes that close, and what hangs on a word.
    ("([»”’])", " $1 "),
    ("''", " '' "),
    ('"', " '' "),
    (" +", " "),
    ("([^' ])(?=')('[sS]|'[mM]|'[dD]|') ", "$1 $2 "),
    ("([^' ])(?=['nN])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
    # Words that were drawn together; no two of them touch, so that one pass does them all.
    (
        f"(?i)(?=[cdglmw])(?<!{WORD})(?:(?:(can)(not)|(d)('ye)|(gim)(me)|(gon)(na)|(got)(ta)|(lem)(me)|(more)('n))(?!{WORD})|(wan)(na)(?=\\s))",
        f" {''.join(f'${i}' for i in range(1, 16, 2))} {''.join(f'${i}' for i in range(2, 17, 2))} ",
    ),
    (f"(?i) ('t)(is|was)(?!{WORD})", " $1 $2 "),
]
# Quotes and apostrophes, and the places in the list of the rules that ask for one of them.
QUOTES = "'\"`«“‘„»”’"
QUOTE_RULES = frozenset([0, 1, 2, 3, 4, 12, 17, 18, 19, 21, 22, 24])
CLOSING = "[\"')\\]}»”’]*"


def sentence_lines(text: Column) -> Column:
    """The text with a line for each sentence and single spaces in between.

    A sentence ends at a mark (. ? !) that white space follows, not after an abbreviation or a single capital, and after
    several full stops only where no small letter follows.
    """
    flat = strip(F.regexp_replace(text, f"[{BLANK}]+", " "))
    lines = F.regexp_replace(flat, f"([.?!]{CLOSING}) ", "$1\n")
    listed = "|".join(a.replace(".", "\\.") for a in ABBREVIATIONS)
    lines = F.regexp_replace(lines, f"(?i)(?<![^ \n(\"'])((?:{listed})\\.)\n", "$1 ")
    lines = F.regexp_replace(lines, "(?<![^ \n(\"'])([A-Z]\\.)\n", "$1 ")
    return F.regexp_replace(lines, f"(\\.\\.{CLOSING})\n(?=[a-z])", "$1 ")


def entropy_tokens(text: Column) -> Column:
    """Words of the text by the Treebank rules, sentence by sentence; without quotes their rules are left out."""

    def ruled(without: frozenset[int]) -> Column:
        value = sentence_lines(text)
        for i, (pattern, replacement) in enumerate(TREEBANK):
            if i not in without:
                value = F.regexp_replace(value, F.lit(pattern), F.lit(replacement))
        return value

    value = F.when(text.rlike(f"[{QUOTES}]"), ruled(frozenset())).otherwise(ruled(QUOTE_RULES))
    return F.regexp_extract_all(value, F.lit("([^ \n]+)"), F.lit(1))


def py_round(value: Column, digits: int) -> Column:
    """Python's round(): half-even on the exact binary value (0.295 -> 0.29, 0.125 -> 0.12).

    ``value * 10**digits`` is split into product and rounding error, so a tie is only a
    tie when the stored double lies exactly on it.
    """
    scale = float(10**digits)

    def rounded(x: Column) -> Column:
        p = x * scale
        c = x * 134217729.0  # 2**27 + 1, splits a double into two exact halves
        hi = c - (c - x)
        lo = x - hi
        error = (hi * scale - p) + lo * scale
        low = F.floor(p).cast("double")
        side = (p - low - 0.5) + error
        whole = (
            F.when(side > 0, low + 1)
            .when(side < 0, low)
            .otherwise(F.when(low % 2 == 0, low).otherwise(low + 1))
        )
        return whole / scale

    return let(value.cast("double"), rounded)


def extract_answer(prediction: Column) -> Column:
    """Text after 'the answer is' up to a full stop, else the whole text, else NOANSWER."""
    found = F.regexp_extract(prediction, r"[t|T]he answer is (.*?)\.", 1)
    marked = F.regexp_like(prediction, F.lit(r"[t|T]he answer is (.*?)\."))
    whole = strip(prediction)
    return F.when(marked, strip(found)).when(whole == "", F.lit("NOANSWER")).otherwise(whole)


def prefixed_prompt(rendered: Column, prefix: str, space_if_needed: bool = True) -> Column:
    """Append an assistant prefix, with a space unless the prompt already ends in one."""
    if not prefix:
        return rendered
    if not space_if_needed:
        return F.concat(rendered, F.lit(prefix))
    spaced = F.concat(rendered, F.lit(" " + prefix))
    return F.when(F.substring(rendered, -1, 1).isin("\n", " "), F.concat(rendered, F.lit(prefix))).otherwise(spaced)
