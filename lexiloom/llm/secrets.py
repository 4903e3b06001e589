"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Everything here is DataFrame functions; no Python runs on the executors. The patterns give the base
spans. Beyond them, each maximal run of token characters that is long enough and has both a letter
and a digit is scored by two first-order Markov models over characters, one of random strings and
one of ordinary identifiers, both trained from labelled samples. Runs whose log-likelihood ratio
passes the threshold are secrets too, of kind markov, unless base spans cover all of them; one that is
covered in part keeps its whole span, which then overlaps the base spans.

Offsets come from splitting a text by a pattern: the lengths of the parts between the matches
and of the matches add up to their starts. Texts without a match take none of these steps.

Defined results: a null text counts as empty and has no spans (its base_sha256 is that of the empty
string); repeated rows are each reported; of overlapping spans of one start the kind listed first comes first; a very
long text is scanned whole, and the work on it grows with its length and its spans; an empty table gives an empty
result; other columns are left aside by the scan and kept by the redaction, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The base patterns by kind, in their order, the group that a length is asked of, and that length.
BASE_KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
]

#: Characters of the models, in the order of their numbers; 0 stands for any other.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Shortest run that the models judge, and the natural logarithm of the odds they must give.
MIN_RUN, MIN_ODDS = 20, 12.0
_TOKEN = r"[A-Za-z0-9+/_=-]"
#: Maximal runs with a digit and a letter.
RUNS = rf"(?<!{_TOKEN})(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z]){_TOKEN}{{{MIN_RUN},}}"

# Words of ordinary identifiers, for the labelled samples.
IDENTIFIER_WORDS = (
    "get set add remove update delete create build make parse format read write open close load save send fetch find search "
    "sort filter map reduce merge split join count index key value name type size length width height color style class "
    "module package import export default config option setting user account profile session request response server client "
    "service handler manager factory controller model view template component element node tree list array table column row "
    "record field schema query result error message warning debug info log level time date year month day hour minute second "
    "file path folder directory image video audio document text string number integer float boolean object method function "
    "variable constant parameter argument return start stop begin end first last next previous current total average minimum "
    "maximum random version release license public private static final abstract interface test example sample data source "
    "target input output stream buffer cache memory thread process worker queue task job schedule event listener callback"
).split()


def training_samples(spark: SparkSession, rows: int = 6_000) -> DataFrame:
    """label (1 random, 0 ordinary), sample: ``rows`` made strings of each label, the same on every run."""
    words = F.lit(IDENTIFIER_WORDS)
    n = len(IDENTIFIER_WORDS)
    base = spark.range(rows)
    digest = F.sha2(F.concat(F.lit("sample:"), F.col("id").cast("string")), 512)
    size = (F.col("id") % 29 + MIN_RUN).cast("int")
    encoded = F.translate(F.base64(F.unhex(digest)), "=\r\n", "")
    random = (
        F.when(F.col("id") % 4 == 0, F.substring(digest, 1, 40))
        .when(F.col("id") % 4 == 1, F.regexp_replace(F.upper(encoded), "[+/]", "7"))
        .when(F.col("id") % 4 == 2, F.regexp_replace(encoded, "[+/]", "x"))
        .otherwise(encoded)
    )

    def word(k: int) -> Column:
        return F.element_at(words, (F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(n)) + 1).cast("int"))

    number = F.element_at(F.lit(["", "", "2", "01", "2024", "10", "v2", "3"]), (F.pmod(F.xxhash64("id"), F.lit(8)) + 1).cast("int"))
    parts = [word(k) for k in range(4)]
    style = F.col("id") % 6
    ordinary = (
        F.when(style == 0, F.concat_ws("_", *parts, number))
        .when(style == 1, F.concat(parts[0], *(F.initcap(p) for p in parts[1:]), number))
        .when(style == 2, F.concat_ws("-", *parts, number))
        .when(style == 3, F.concat_ws("/", *parts, number))
        .when(style == 4, F.upper(F.concat_ws("_", *parts, number)))
        .otherwise(F.concat(*parts, number))
    )
    randoms = base.select(F.lit(1).alias("label"), random.substr(F.lit(1), size).alias("sample"))
    return randoms.unionByName(base.select(F.lit(0).alias("label"), ordinary.alias("sample")))


def _codes(text: Column) -> Column:
    """Numbers of a text's characters: places in ALPHABET from 1, 0 for others."""
    return F.transform(F.split(text, ""), lambda c: F.position(c, F.lit(ALPHABET)))


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """log P(b|a) of random strings less that of identifiers, at place a * (len(ALPHABET) + 1) + b.

    Only the counts of character pairs come to the driver, (len(ALPHABET) + 1) ** 2 for each label at most.
    """
    size = len(ALPHABET) + 1
    codes = _codes(F.col("sample"))
    pairs = samples.where(F.length("sample") > 1).select("label", codes.alias("c"))
    pairs = pairs.select("label", F.explode(F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: a * size + b)).alias("pair"))
    counts = [[smoothing] * (size * size) for _ in range(2)]
    for row in pairs.groupBy("label", "pair").count().collect():
        counts[row["label"]][row["pair"]] += row["count"]
    logs = []
    for own in counts:
        sums = [sum(own[a * size : (a + 1) * size]) for a in range(size)]
        logs.append([math.log(x / sums[k // size]) for k, x in enumerate(own)])
    return [a - b for a, b in zip(logs[1], logs[0], strict=True)]


def log_odds(token: Column, table: list[float]) -> Column:
    """Sum of the ratios over the neighbouring characters of a token."""
    size = len(ALPHABET) + 1
    values = F.lit([round(x, 4) for x in table])
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("before"))
    return F.aggregate(
        _codes(token),
        start,
        lambda acc, c: F.struct(
            (acc["sum"] + F.when(acc["before"] >= 0, F.element_at(values, acc["before"] * size + c + 1)).otherwise(F.lit(0.0))).alias("sum"),
            c.alias("before"),
        ),
        lambda acc: acc["sum"],
    )


_SPAN = "array<struct<at:int,kind:int,stop:int,token:string>>"
#: Members of a block of an array that is built by adding to its end; blocks keep the copying linear.
ADDED = 256


def _in_blocks(items: Column) -> Column:
    """An array cut into arrays of ADDED members."""
    last = F.floor((F.size(items) - 1) / ADDED).cast("int")
    blocks = F.when(F.size(items) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(blocks, lambda b: F.slice(items, b * ADDED + 1, F.lit(ADDED)))


def _gathered(items: Column, state: Column, kind: str, step) -> Column:
    """What a fold over an array gathers: ``step`` takes state and member, and gives the next state and an array of additions."""
    none = F.array().cast(kind)

    def inner(acc: Column, x: Column) -> Column:
        after, more = step(acc["state"], x)
        return F.struct(after.alias("state"), F.concat(acc["found"], more).alias("found"))

    def outer(acc: Column, block: Column) -> Column:
        # a one-member array holds what the block gives, so that it is worked out once
        told = F.array(F.aggregate(block, F.struct(acc["state"].alias("state"), none.alias("found")), inner))
        return F.element_at(F.transform(told, lambda t: F.struct(t["state"].alias("state"), F.concat(acc["found"], F.array(t["found"])).alias("found"))), 1)

    start = F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("found"))
    return F.aggregate(_in_blocks(items), start, outer, lambda acc: F.flatten(acc["found"]))


def _matches(text: Column, pattern: str, kind: int, group: int, at_least: int) -> Column:
    """Spans of the pattern's leftmost non-overlapping matches whose group is long enough."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    asked = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    between = F.split(text, pattern, -1)
    steps = F.arrays_zip(F.slice(between, F.lit(1), F.size(whole)).alias("gap"), whole.alias("match"), asked.alias("asked"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        stop = start + F.length(x["match"])
        span = F.array(F.struct(start.alias("at"), F.lit(kind).alias("kind"), stop.alias("stop"), x["asked"].alias("token")))
        return stop, F.when(F.length(x["asked"]) >= at_least, span).otherwise(F.array().cast(_SPAN))

    return _gathered(steps, F.lit(0), _SPAN, step)


def spans_column(text: Column, table: list[float], min_odds: float = MIN_ODDS) -> tuple[Column, Column]:
    """Base spans and markov spans of a text, each sorted by start and kind."""
    none = F.array().cast(_SPAN)
    base = F.array_sort(F.concat(*(F.when(text.rlike(_screen(kind, pattern, least)), _matches(text, pattern, k, group, least)).otherwise(none) for k, (kind, pattern, group, least) in enumerate(BASE_KINDS))))
    runs = F.when(text.rlike(RUNS), F.filter(_matches(text, RUNS, len(BASE_KINDS), 0, MIN_RUN), lambda x: log_odds(x["token"], table) >= min_odds)).otherwise(none)
    return base, runs


def _screen(kind: str, pattern: str, least: int) -> str:
    """A pattern that finds something in every text with a base span of the kind."""
    return {"assign": pattern, "access": rf"AKIA[A-Z0-9]{{{least - 4}}}", "hex": rf"[0-9a-f]{{{least}}}"}[kind]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names that ``df`` has no column of."""
    found = []
    for name in names:
        while name in df.columns:
            name += "_"
        found.append(name)
    return found


def find_spans(docs: DataFrame, text_col: str = "text", table: list[float] | None = None, min_odds: float = MIN_ODDS, names: tuple[str, str] = ("_base", "_markov")) -> DataFrame:
    """``docs`` with two more columns of the given names, base and Markov spans: arrays of structs at, kind (a number), stop, token."""
    table = train(training_samples(docs.sparkSession)) if table is None else table
    base, markov = names
    (both,) = free_names(docs.select("*", F.lit(0).alias(base), F.lit(0).alias(markov)), "_spans")
    told, runs = spans_column(F.coalesce(F.col(text_col).cast("string"), F.lit("")), table, min_odds)

    def free(x: Column) -> Column:
        # base spans come by their starts: how far they cover the run from its start on without a gap
        reach = lambda r: F.aggregate(x["base"], r["at"], lambda at, b: F.when(b["at"] <= at, F.greatest(at, b["stop"])).otherwise(at))
        return F.struct(x["base"].alias("base"), F.filter(x["runs"], lambda r: reach(r) < r["stop"]).alias("markov"))

    # a one-member array holds both kinds, so that they are worked out once and not for each run
    found = docs.withColumn(both, F.element_at(F.transform(F.array(F.struct(told.alias("base"), runs.alias("runs"))), free), 1))
    return found.withColumns({base: F.col(both)["base"], markov: F.col(both)["markov"]}).drop(both)


def _told(spans: Column) -> Column:
    names = F.lit([*(kind for kind, *_ in BASE_KINDS), "markov"])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["at"], x["stop"])), ",")


def _number(kind: int) -> Column:
    return F.size(F.filter("_base", lambda x: x["kind"] == kind)).cast("long")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: list[float] | None = None) -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans and n_markov of every text."""
    found = find_spans(docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("_text")), "_text", table)
    return found.select(
        id_col,
        *(_number(k).alias(f"n_{kind}") for k, (kind, *_) in enumerate(BASE_KINDS)),
        F.sha2(_told(F.col("_base")), 256).alias("base_sha256"),
        _told(F.array_sort(F.concat("_base", "_markov"))).alias("spans"),
        F.size("_markov").cast("long").alias("n_markov"),
    )


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", table: list[float] | None = None) -> DataFrame:
    """``docs`` with every span of the texts replaced by ``mark``; overlapping spans become one mark.

    Texts without a span, null texts among them, stay as they are.
    """
    base, markov = names = free_names(docs, "_base", "_markov")
    found = find_spans(docs, text_col, table, names=(base, markov))
    spans = F.array_sort(F.concat(*names))
    merged = "array<struct<at:int,stop:int>>"

    def step(open_: Column, x: Column) -> tuple[Column, Column]:
        apart = x["at"] >= open_["stop"]
        done = F.when(apart & (open_["stop"] >= 0), F.array(open_)).otherwise(F.array().cast(merged))
        after = F.struct(F.when(apart, x["at"]).otherwise(open_["at"]).alias("at"), F.when(apart, x["stop"]).otherwise(F.greatest(open_["stop"], x["stop"])).alias("stop"))
        return after, done

    # a span beyond all others closes the last one
    closing = F.array(F.struct(F.lit(2**31 - 1).alias("at"), F.lit(0).alias("kind"), F.lit(2**31 - 1).alias("stop"), F.lit("").alias("token")))
    runs = _gathered(F.concat(spans, closing), F.struct(F.lit(-1).alias("at"), F.lit(-1).alias("stop")), merged, step)
    text = F.col(text_col)
    (kept,) = free_names(found, "_spans")
    found = found.withColumn(kept, F.when(F.size(spans) > 0, _in_blocks(runs)))
    # a block's part of the text first, then the pieces of it, so that no piece is sought from the text's start
    last = lambda i: F.when(i > 0, F.element_at(F.element_at(kept, F.greatest(i, F.lit(1))), -1)["stop"]).otherwise(F.lit(0))
    parts = F.transform(kept, lambda block, i: F.struct(block.alias("block"), last(i).alias("start"), text.substr(last(i) + 1, F.element_at(block, -1)["stop"] - last(i)).alias("text")))

    def cut(part: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            before = F.when(i > 0, F.element_at(part["block"], F.greatest(i, F.lit(1)))["stop"]).otherwise(part["start"])
            return F.concat(part["text"].substr(before - part["start"] + 1, x["at"] - before), F.lit(mark))

        return F.array_join(F.transform(part["block"], piece), "")

    end = F.element_at(F.element_at(kept, -1), -1)["stop"]
    cleaned = F.concat(F.array_join(F.transform(parts, cut), ""), text.substr(end + 1, F.length(text)))
    return found.withColumn(text_col, F.when(F.col(kept).isNotNull(), cleaned).otherwise(text)).drop(*names, kept)
