"""Text functions as column expressions, with Arrow variants where Spark has no built-in."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# Ranges of combining marks that stay attached to their letter, and the stop words of the span filter.
MARKS = "̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯"
STOP_WORDS = (
    "a an and are as at be been being by can could did do does for from had has have how i if in into is it its may more most "
    "not of on or our should so than that the their them these they this those to was we were what when where which who will "
    "with would you your"
).split()

UNIT = rf"[\p{{L}}\p{{N}}][{MARKS}]*"
#: A word: letters and digits with their marks, and inner apostrophes.
WORD = rf"(?:{UNIT})+(?:['’](?:{UNIT})+)*"
#: White space in the widest sense, also the separators U+001C to U+001F.
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
NOT_SPACE = r"[^\p{IsWhite_Space}\x1c-\x1f]"
NUMBER = r"\d+(?:[.,:]\d+)*"


#: Letters beyond ASCII for which lower case, with ß as ss, is the whole of compatibility folding.
PLAIN = r"À-ÖØ-öø-įĴ-ľŁ-ňŊ-žА-яЁёЀ-Џѐђѓєѕіїјљњћќѝўџ一-鿿"
#: A word character, or a mark, that needs more than that; any character that does in a whole text.
_INTRICATE_WORD = rf"[[\p{{L}}\p{{N}}\p{{M}}]&&[^\x00-\x7f{PLAIN}]]"
_INTRICATE_TEXT = rf"[^\x00-\x7f{PLAIN}–—‘’“”]"


def intricate(text: Column, kind: str) -> Column:
    """Whether a text needs exact folding: ASCII by its lengths alone, then the kind's class on what is not ASCII."""
    rest = F.regexp_replace(text, r"[\x00-\x7f]+", "")
    return F.coalesce((F.octet_length(text) != F.length(text)) & rest.rlike(kind), F.lit(False))


def fold(text: Column) -> Column:
    """Caseless form by built-ins, for texts without intricate characters."""
    return F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("’"), F.lit("'"))


def words(text: Column) -> Column:
    """Compatibility-folded words of a text, in order.

    Texts with characters whose folding Spark has no function for go through ``tokens_exact``;
    the others stay in built-ins, with the same result. ``with_words`` does the same for a table, and sends only the rows
    that need it to Python.
    """
    odd = intricate(text, _INTRICATE_WORD)
    return F.when(odd, exact_words(F.when(odd, text))).otherwise(plain_words(text))


def plain_words(text: Column) -> Column:
    """``words`` of a text without intricate characters."""
    return F.regexp_extract_all(fold(text), F.lit(WORD), F.lit(0))


def exact_words(text: Column) -> Column:
    return F.transform(tokens_exact(text), lambda t: t["value"])


def _in_two(df: DataFrame, text: Column, name: str, kind: str, plain: Callable[[Column], Column], exact: Callable[[Column], Column]) -> DataFrame:
    odd = intricate(text, kind)
    return df.where(~odd).withColumn(name, plain(text)).unionByName(df.where(odd).withColumn(name, exact(text)))


def with_words(df: DataFrame, text: Column, name: str = "tokens") -> DataFrame:
    """``df`` with the words of a text, in a plan whose Python node gets only rows with intricate characters.

    Read twice, each time as far as the cheap screen; ``df`` should be a scan or a table, not a costly plan.
    """
    return _in_two(df, text, name, _INTRICATE_WORD, plain_words, exact_words)


def with_normalized(df: DataFrame, text: Column, name: str = "normalized") -> DataFrame:
    """``df`` with a text's ``normalized`` form, as in ``with_words``."""
    return _in_two(df, text, name, _INTRICATE_TEXT, plain_normalized, normalized_exact)


def gram(tokens: Column, start: Column, n: int = 5) -> Column:
    """n words from a 0-based place, joined by U+001F."""
    return F.array_join(F.slice(tokens, start + 1, n), "\x1f")


def grams(tokens: Column, n: int = 5, stride: int = 1) -> Column:
    """(pos, gram) of every stride-th n-gram."""
    last = F.size(tokens) - n
    places = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("pos"), gram(tokens, i, n).alias("gram")))


def fingerprint(joined: Column) -> Column:
    """First 24 hex digits of the SHA-256 of a joined gram."""
    return F.substring(F.sha2(joined, 256), 1, 24)


def normalized(text: Column) -> Column:
    """Compatibility-folded, white space collapsed to single spaces and trimmed; built-ins where they are exact."""
    odd = intricate(text, _INTRICATE_TEXT)
    return F.when(odd, normalized_exact(F.when(odd, text))).otherwise(plain_normalized(text))


def plain_normalized(text: Column) -> Column:
    """``normalized`` of a text without intricate characters."""
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), f"{SPACE}+", " "))


def text_hash(text: Column) -> Column:
    return F.sha2(normalized(text), 256)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{NOT_SPACE}+"))


def utf16_units(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def utf16_offset(text: Column, codepoints: Column) -> Column:
    """A code-point offset in UTF-16 code units."""
    return utf16_units(text.substr(F.lit(1), codepoints))


def draw(seed: str, key: Column) -> Column:
    """Uniform number from the first 16 hex digits of a SHA-256, as an exact double of int / 2**64."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), key), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("double") / F.lit(2.0**64)


def sigmoid(x: Column) -> Column:
    """Logistic function without overflow on either side."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def softmax_first(logits: Column) -> Column:
    """The first class's share of the exponentials of an array of logits, without overflow; null for a null or non-finite logit."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    fine = (F.size(logits) > 0) & ~F.exists(logits, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(F.coalesce(fine, F.lit(False)), F.exp(F.try_element_at(logits, F.lit(1)) - top) / total)


def git_blob_id(data: Column) -> Column:
    """The id that git gives to a file of these bytes (a binary column)."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(data).cast("string")), "UTF-8"), F.unhex(F.lit("00")), data))


def utc_iso(at: Column) -> Column:
    """A timestamp as ISO 8601 in UTC, with microseconds."""
    zone = F.to_utc_timestamp(at, F.current_timezone())
    return F.concat(F.date_format(zone, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def shown_score(score: Column, plain_from: float = 1e-6, power_digits: int = 1) -> Column:
    """A score from 0 to 1 with ten significant digits, or all of its digits where ten would change it; else Unavailable.

    Scores below ``plain_from`` are written with an exponent of ``power_digits`` digits at least.
    """
    written = score.cast("string")
    plain = F.regexp_replace(written.cast("decimal(38,30)").cast("string"), r"\.?0+$", "")
    digits = F.regexp_replace(F.replace(F.regexp_replace(written, "E.*$", ""), F.lit("."), F.lit("")), "^0+|0+$", "")
    small = (score > 0) & (score < plain_from)
    exact = F.regexp_extract(written, "E-(.*)$", 1)
    power = F.concat(F.lit("e-"), F.lpad(exact, F.greatest(F.length(exact), F.lit(power_digits)), F.lit("0")))
    padded = F.rpad(digits, 10, "0")
    whole = F.when(score >= 1, F.lit("1.000000000")).when(score == 0, F.lit("0.000000000")).otherwise(F.concat(F.regexp_extract(plain, r"^0\.0*", 0), padded))
    exponent = F.concat(F.substring(padded, 1, 1), F.lit("."), F.substring(padded, 2, 9), power)
    long = F.length(digits) > 10
    shown = F.when(small & long, F.concat(F.regexp_replace(F.regexp_replace(written, "E.*$", ""), r"\.0$", ""), power)).when(small, exponent).when(long, plain).otherwise(whole)
    return F.when(F.coalesce(score.between(0, 1) & ~F.isnan(score), F.lit(False)), shown).otherwise("Unavailable")


def numbers(text: Column) -> Column:
    """Distinct sorted numbers in a text."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))))


def ends_sentence(text: Column) -> Column:
    return F.trim(text).rlike("[.!?][\"'”’]*$")


def closed(text: Column) -> Column:
    """Trimmed, with a full stop if nothing else ends it."""
    trimmed = F.trim(text)
    return F.when((trimmed != "") & ~ends_sentence(trimmed), F.concat(trimmed, F.lit("."))).otherwise(trimmed)


def schema_fragment(text: Column) -> Column:
    """Whether a text holds a key of the answer format, in quotes before a colon."""
    return text.rlike("[\"'](?:summary|suggestions|sentence_id|issue|why|suggestion|rewrite)[\"']\\s*:")


def valid_url(url: Column, optional: bool = False) -> Column:
    """http(s) with a host, without credentials, white space or control characters."""
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    fine = scheme.isin("http", "https") & (F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")) != "") & F.try_parse_url(url, F.lit("USERINFO")).isNull()
    fine = F.coalesce(fine & ~url.rlike(rf"{SPACE}|[\x00-\x1f]"), F.lit(False))
    return (url.isNull() | (url == "") | fine) if optional else fine


_LOCATED = re.compile(WORD.replace(r"[\p{L}\p{N}]", r"[^\W_]"))
_TOKENS = pa.struct([("value", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def _folded(forms: pa.Array) -> pa.Array:
    """Full compatibility folding of strings, each distinct one folded once."""
    coded = forms.dictionary_encode()
    return pa.array([unicodedata.normalize("NFKC", x).casefold() for x in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


@F.arrow_udf(ArrayType(StructType([StructField("value", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])))
def tokens_exact(texts: pa.Array) -> pa.Array:
    """Words with full Unicode compatibility folding and code-point offsets into the unmodified text; a null text has none."""
    places, ends, forms = [], [0], []
    for text in texts.to_pylist():
        if text is not None:
            for found in _LOCATED.finditer(text):
                places.append(found.span())
                forms.append(found[0].replace("’", "'"))
        ends.append(len(places))
    at = np.array(places, np.int32).reshape(-1, 2)
    flat = pa.StructArray.from_arrays([_folded(pa.array(forms, pa.string())), pa.array(at[:, 0].copy()), pa.array(at[:, 1].copy())], fields=list(_TOKENS))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


@F.arrow_udf(StringType())
def normalized_exact(texts: pa.Array) -> pa.Array:
    """Compatibility-composed, fully case-folded, white space collapsed."""
    return pa.array([None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()) for x in texts.to_pylist()], pa.string())
