"""Passage overlap search: exact and lightly edited spans shared by passages and a library.

Everything up to the near-run chains is joins, windows and aggregates. The library side is first probed at
every fifth place only (its index); just the (passage, document) pairs that share such a seed are then
compared at all places, so the wide explode touches few documents.

A library is a table of texts, which every search reads and tokenises, or one that is stored with its index
(``sources.library``), of which a search opens the entries of the passages' grams and the tokens of the documents found.

``search`` is bounded by default, for each passage on its own: hits, documents, runs and matches. Whatever a bound
leaves out makes the passage's status ``partial``; ``EXACT`` has no bounds and leaves out nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import STOP_WORDS, grams, tokens_exact, utf16_offset, with_words
from lexiloom.storage import Scratch, materialize

# Words of a seed, places between indexed seeds, least words of exact and near spans,
# least similarity and largest extent of near spans, words a near span may skip, and the bounds of a report.
SEED, STRIDE = 5, 5
MIN_EXACT, MIN_NEAR, MIN_SIMILARITY, MAX_SPAN, MAX_GAP, MAX_HOPS = 12, 18, 0.85, 250, 4, 20
TOP_DOCUMENTS, TOP_BLOCKS, TOP_MATCHES, MAX_HITS, MAX_RUNS = 24, 400, 40, 12_000, 3_000
#: Spans of a pair, by rank, that are held against all others of it, and those of a pair that meet them in one task.
FIRST_SPANS, CHUNK_SPANS = 256, 8_192
# What is said of a passage's outcome, and of a match that should be reviewed.
SUMMARIES = {
    "unavailable": "The local reference library is unavailable. No source comparison was completed.",
    "empty": "The local reference library is empty. No source comparison was completed.",
    "insufficient_text": "At least 12 words are needed for this local overlap check.",
    "matched": "Matching wording was found in the local reference library. Review sources and attribution; overlap alone does not establish plagiarism.",
    "partial": "No source match was returned by this incomplete local comparison.",
    "complete": "No source match found in the local corpus. This does not establish originality or exclude paraphrased reuse.",
}
PARTIAL = "Results are partial because comparison limits were reached. Absence of a match is inconclusive."
NOTE_TITLE = "Review quotation and attribution"
NOTE_ACTION = (
    "Check whether this wording is already correctly quoted and cited. If you reuse it, preserve its meaning and credit the source; "
    "add your own analysis where it contributes. This does not predict an AI score change."
)
SOURCE = ["title", "url", "license_id", "license_url", "source_provider", "attribution", "license_evidence"]

BLOCK = ["passage_id", "document_id", "q_start", "q_end", "s_start", "s_end", "matched"]


@dataclass(frozen=True)
class Bounds:
    """The most hits, documents and runs of a passage, runs of a passage and document, and matches shown; None is no bound."""

    hits: int | None = MAX_HITS
    documents: int | None = TOP_DOCUMENTS
    runs: int | None = MAX_RUNS
    pair_runs: int | None = TOP_BLOCKS
    matches: int | None = TOP_MATCHES


EXACT = Bounds(None, None, None, None, None)


def tokenized(df: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    texts = df.select(F.col(id_col).alias(name), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return with_words(texts, F.col("_text")).drop("_text")


def index_of(tokens: DataFrame, stride: int = STRIDE) -> DataFrame:
    """document_id, s_pos, gram of documents' tokens."""
    return tokens.select("document_id", F.inline(grams(F.col("tokens"), SEED, stride)).alias("s_pos", "gram"))


def index(library: DataFrame, id_col: str = "document_id", text_col: str = "text", stride: int = STRIDE) -> DataFrame:
    """document_id, s_pos, gram: the inverted index of a library."""
    return index_of(tokenized(library, id_col, text_col, "document_id"), stride)


class TextLibrary:
    """A library that is a table of texts."""

    def __init__(self, documents: DataFrame, document_id: str = "document_id", text: str = "text"):
        self.source, self.names = documents, (document_id, text)

    def hits(self, asked: DataFrame) -> DataFrame:
        """passage_id, document_id, q_pos, s_pos, gram for the places of grams asked for (passage_id, q_pos, gram)."""
        return index(self.source, *self.names).join(asked, "gram").select("passage_id", "document_id", "q_pos", "s_pos", "gram")

    def tokens(self, wanted: DataFrame) -> DataFrame:
        """document_id, tokens of the documents with the ids wanted (distinct)."""
        texts = self.source.select(F.col(self.names[0]).alias("document_id"), F.col(self.names[1]).alias("text")).join(wanted, "document_id", "left_semi")
        return tokenized(texts, "document_id", "text", "document_id")

    def is_empty(self) -> bool:
        return self.source.isEmpty()


def _library(library, document_id: str, text: str):
    return TextLibrary(library, document_id, text) if isinstance(library, DataFrame) else library


def asked_grams(tokens: DataFrame) -> DataFrame:
    """passage_id, q_pos, gram of passages' tokens."""
    return tokens.select("passage_id", F.inline(grams(F.col("tokens"))).alias("q_pos", "gram"))


def seeds(passages: DataFrame, library, passage_id: str = "passage_id", document_id: str = "document_id", text: str = "text") -> DataFrame:
    """passage_id, document_id, q_pos, s_pos, gram: index hits with every place of the gram in the passage."""
    return _library(library, document_id, text).hits(asked_grams(tokenized(passages, passage_id, text, "passage_id")))


def ranked_documents(found: DataFrame) -> DataFrame:
    """passage_id, document_id, seeds, rank: documents by distinct matched seeds, ties to the smaller id."""
    counted = found.groupBy("passage_id", "document_id").agg(F.countDistinct("gram").alias("seeds"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("passage_id").orderBy(F.desc("seeds"), "document_id")))


def top_documents(found: DataFrame, k: int = TOP_DOCUMENTS) -> DataFrame:
    """The first k of ``ranked_documents``."""
    return ranked_documents(found).where(F.col("rank") <= k)


def bounded_hits(found: DataFrame, limit: int = MAX_HITS) -> DataFrame:
    """The first ``limit`` hits of each passage by (gram, document, place), with ``truncated`` where more were found."""
    w = Window.partitionBy("passage_id")
    ranked = found.withColumn("n", F.row_number().over(w.orderBy("gram", "document_id", "s_pos", "q_pos"))).withColumn("all", F.count("*").over(w))
    return ranked.where(F.col("n") <= limit).withColumn("truncated", F.col("all") > limit).drop("n", "all")


def blocks(passages: DataFrame, library, pairs: DataFrame, passage_id: str = "passage_id", document_id: str = "document_id", text: str = "text") -> DataFrame:
    """Maximal runs of equal words on a diagonal that hold an indexed seed, for the given pairs.

    A run of n words is n - 4 consecutive equal grams, so runs are islands of gram matches. The pairs are written once, as both
    sides are chosen by them, and making them may take a pass over the whole library.
    """
    wanted = materialize(pairs.select("passage_id", "document_id").distinct(), "overlap-wanted")
    return runs_of(tokenized(passages, passage_id, text, "passage_id"), _library(library, document_id, text), wanted)


def runs_of(tokens: DataFrame, library, pairs: DataFrame) -> DataFrame:
    """``blocks`` of passages' tokens."""
    wanted = pairs.select("passage_id", "document_id").distinct()
    asked = tokens.join(wanted, "passage_id")
    asked = asked.select("passage_id", "document_id", F.inline(grams(F.col("tokens"))).alias("q_pos", "gram"))
    held = library.tokens(wanted.select("document_id").distinct())
    held = held.select("document_id", F.inline(grams(F.col("tokens"))).alias("s_pos", "gram"))
    # equal grams of other documents never meet: the document is part of the key
    hits = asked.join(held, ["document_id", "gram"])
    diagonal = hits.withColumn("diagonal", F.col("q_pos") - F.col("s_pos"))
    place = F.row_number().over(Window.partitionBy("passage_id", "document_id", "diagonal").orderBy("q_pos"))
    islands = diagonal.withColumn("island", F.col("q_pos") - place).groupBy("passage_id", "document_id", "diagonal", "island").agg(
        F.min("q_pos").alias("q_start"), (F.max("q_pos") + SEED).alias("q_end"), F.min("s_pos").alias("s_start"), (F.max("s_pos") + SEED).alias("s_end"),
        F.bool_or(F.col("s_pos") % STRIDE == 0).alias("seeded"),
    )
    return islands.where("seeded").select(*BLOCK[:-1], (F.col("q_end") - F.col("q_start")).alias("matched"))


def similarity() -> Column:
    return 2 * F.col("matched") / (F.col("q_end") - F.col("q_start") + F.col("s_end") - F.col("s_start"))


def informative(tokens: Column) -> Column:
    """At least five distinct words of the span are longer than three characters and no stop words."""
    span = F.slice(tokens, F.col("q_start") + 1, F.col("q_end") - F.col("q_start"))
    return F.size(F.array_distinct(F.filter(span, lambda w: (F.length(w) > 3) & ~w.isin(STOP_WORDS)))) >= 5


def exact_spans(found: DataFrame, passages: DataFrame, passage_id: str = "passage_id", text: str = "text") -> DataFrame:
    """Informative runs of at least twelve words."""
    return informative_spans(found.where(F.col("matched") >= MIN_EXACT), tokenized(passages, passage_id, text, "passage_id"))


def informative_spans(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    return spans.join(tokens, "passage_id").where(informative(F.col("tokens"))).select(*BLOCK)


def top_blocks(found: DataFrame, k: int = TOP_BLOCKS) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("passage_id", "document_id").orderBy(F.desc("matched"), "q_start", "s_start"))
    return found.withColumn("block_rank", rank).where(F.col("block_rank") <= k)


def chain_runs(runs: pd.DataFrame) -> pd.DataFrame:
    """Near spans of one passage and document from its ranked runs.

    From each run the chain goes on to the longest run that starts within the gap on both sides and keeps the
    extent; among equally long ones to that with the smallest place in the passage, then the best rank. Every
    prefix of a chain that is long and similar enough is a span.
    """
    runs = runs.sort_values("block_rank")
    columns = ["q_start", "q_end", "s_start", "s_end", "matched"]
    rows = list(runs[columns].itertuples(index=False, name=None))
    follow: dict[int, list[int]] = {}
    for i, row in enumerate(rows):
        follow.setdefault(row[0], []).append(i)
    spans = []
    for q0, q1, s0, s1, n in rows:
        for _ in range(MAX_HOPS):
            nearby = [i for at in range(q1, q1 + MAX_GAP + 1) for i in follow.get(at, ())]
            fit = [i for i in nearby if 0 <= rows[i][2] - s1 <= MAX_GAP and rows[i][1] - q0 <= MAX_SPAN and rows[i][3] - s0 <= MAX_SPAN]
            if not fit:
                break
            _, q1, _, s1, gained = rows[max(fit, key=lambda i: rows[i][4])]
            n += gained
            if n >= MIN_NEAR and 2 * n / (q1 - q0 + s1 - s0) >= MIN_SIMILARITY:
                spans.append((q0, q1, s0, s1, n))
    out = pd.DataFrame(spans, columns=columns)
    out.insert(0, "document_id", runs["document_id"].iloc[0])
    out.insert(0, "passage_id", runs["passage_id"].iloc[0])
    return out


def near_spans(found: DataFrame, passages: DataFrame, passage_id: str = "passage_id", text: str = "text", k: int | None = TOP_BLOCKS) -> DataFrame:
    """Informative chains of runs; the greedy choice depends on the path, so it runs per pair, over its k best runs.

    Without a bound (None) a pair's runs still are no more than the words of the two texts allow.
    """
    return informative_spans(chained(found, k), tokenized(passages, passage_id, text, "passage_id"))


def chained(found: DataFrame, k: int | None = TOP_BLOCKS) -> DataFrame:
    """Chains of the k best runs of each pair, a pair in one task; without a bound on its runs, hop by hop (``chained_by_hops``)."""
    if k is None:
        return chained_by_hops(found)
    # few bytes, but much work a pair: a number that is named is not made smaller for them
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = top_blocks(found.repartition(tasks, "passage_id", "document_id"), k)
    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in BLOCK)
    return ranked.groupBy("passage_id", "document_id").applyInPandas(chain_runs, schema).distinct()


def chained_by_hops(found: DataFrame) -> DataFrame:
    """What ``chain_runs`` gives, for pairs of any number of runs: all chains go on by one run at a time, by a join on the place where it may start.

    A chain's next run depends on where it began, so there is no pointer to double; but a chain has at most twenty hops, and those that end drop out.
    """
    pair = ["passage_id", "document_id"]
    with Scratch(found.sparkSession) as put:
        # a chain prefers the longest run, of those the first in the passage, and of those the first by rank, which is by the source's place
        runs = put(found.select(*BLOCK), "chain-runs")
        nexts = runs.select(*pair, F.col("q_start").alias("at"), F.struct("matched", -F.col("q_start"), -F.col("s_start"), "q_end", "s_end", "s_start").alias("run"))
        state, told = runs, []
        for _ in range(MAX_HOPS):
            asked = state.withColumn("at", F.explode(F.sequence(F.col("q_end"), F.col("q_end") + MAX_GAP)))
            fit = (
                F.col("run.s_start").between(F.col("s_end"), F.col("s_end") + MAX_GAP) & (F.col("run.q_end") - F.col("q_start") <= MAX_SPAN) & (F.col("run.s_end") - F.col("s_start") <= MAX_SPAN)
            )
            hop = asked.join(nexts, [*pair, "at"]).where(fit).groupBy(*BLOCK).agg(F.max("run").alias("run"))
            grown = {"q_end": F.col("run.q_end"), "s_end": F.col("run.s_end"), "matched": F.col("matched") + F.col("run.matched")}
            state = put(hop.select(*(grown.get(c, F.col(c)).alias(c) for c in BLOCK)), "chain-hop")
            if state.isEmpty():
                break
            told.append(state.where((F.col("matched") >= MIN_NEAR) & (similarity() >= MIN_SIMILARITY)))
        out = runs.limit(0)
        for part in told:
            out = out.unionByName(part)
        return put.keep(put(out.distinct(), "chain-spans"))


def _dead(inner: DataFrame, outer: DataFrame, key: list[str]) -> DataFrame:
    """passage_id, document_id, place of the inner spans that lie in an earlier-ranked outer one with an equal key."""
    o = outer.select(*key, *(F.col(c).alias("o_" + c) for c in ["place", *BLOCK[2:6]]))
    inside = (
        (F.col("o_place") < F.col("place")) & (F.col("o_q_start") <= F.col("q_start")) & (F.col("o_q_end") >= F.col("q_end"))
        & (F.col("o_s_start") <= F.col("s_start")) & (F.col("o_s_end") >= F.col("s_end"))
    )
    return inner.join(o, key).where(inside).select("passage_id", "document_id", "place").distinct()


def suppressed(spans: DataFrame) -> DataFrame:
    """Spans not inside an earlier-ranked one on both sides; rank by matched words, similarity, places.

    Containment is transitive, so it does not matter whether the earlier span was itself accepted. The first spans of a pair, which
    are its longest, are held against all of its others, in chunks. What they leave is looked up in a grid: a span of length
    2**l or more, below 2**(l + 1), is entered in the two or so cells of that size that it touches on each side, and a span looks for outer ones
    of every two lengths, from its own on, that its pair has, in the one cell where its starts lie.
    """
    pair = ["passage_id", "document_id"]
    w = Window.partitionBy(*pair).orderBy(F.desc("matched"), F.desc(similarity()), "q_start", "s_start")
    with Scratch(spans.sparkSession) as put:
        ranked = put(spans.distinct().withColumn("place", F.row_number().over(w)), "spans-ranked")
        chunk = F.expr(f"place div {CHUNK_SPANS}")
        chunks = ranked.groupBy(*pair).agg(F.max(chunk).alias("last"))
        first = ranked.where(F.col("place") <= FIRST_SPANS).join(chunks, pair).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
        left = put(ranked.join(_dead(ranked.withColumn("chunk", chunk), first, [*pair, "chunk"]), [*pair, "place"], "left_anti"), "spans-left")

        level = lambda side: F.floor(F.log2(F.greatest(F.col(f"{side}_end") - F.col(f"{side}_start"), F.lit(1)))).cast("int")
        cell = lambda at, side: F.call_function("shiftright", at, F.col(f"{side}_level") + 1)
        touched = lambda side: F.explode(F.sequence(cell(F.col(f"{side}_start"), side), cell(F.col(f"{side}_end"), side))).alias(f"{side}_cell")
        sized = left.withColumns({"q_level": level("q"), "s_level": level("s")})
        outer = sized.select("*", touched("q")).select("*", touched("s"))
        levels = sized.groupBy(*pair).agg(F.collect_set(F.struct("q_level", "s_level")).alias("levels"))
        own = left.withColumns({"q_own": level("q"), "s_own": level("s")}).join(levels, pair).select("*", F.inline("levels")).where("q_level >= q_own and s_level >= s_own")
        inner = own.withColumns({f"{side}_cell": cell(F.col(f"{side}_start"), side) for side in ("q", "s")})
        dead = _dead(inner, outer, [*pair, "q_level", "s_level", "q_cell", "s_cell"])
        return put.keep(put(left.join(dead, [*pair, "place"], "left_anti").select(*BLOCK), "spans-accepted"))


def report(spans: DataFrame, k: int | None = TOP_MATCHES) -> DataFrame:
    """The k best spans of each passage, renumbered by their place in it: adds similarity, kind, match_no, n_spans, status."""
    best = Window.partitionBy("passage_id").orderBy(F.desc("matched"), F.desc("similarity"), "q_start", "document_id", "s_start")
    shown = Window.partitionBy("passage_id").orderBy("q_start", F.desc("q_end"), "document_id", "s_start")
    scored = spans.withColumn("similarity", similarity()).withColumn("n_spans", F.count("*").over(Window.partitionBy("passage_id")))
    top = scored if k is None else scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")
    kind = F.when(F.col("similarity") == 1, "exact_text_overlap").otherwise("near_exact_text_overlap")
    status = F.lit("complete") if k is None else F.when(F.col("n_spans") > k, "partial").otherwise("complete")
    return top.withColumn("kind", kind).withColumn("match_no", F.row_number().over(shown)).withColumn("status", status)


def _bounded(rows: DataFrame, k: int | None, key: list[str], order: list) -> tuple[DataFrame, DataFrame]:
    """The first k rows of each key, and the passages that have more."""
    if k is None:
        return rows, rows.select("passage_id").limit(0)
    placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return placed.where(F.col("_place") <= k).drop("_place"), placed.where(F.col("_place") == k + 1).select("passage_id")


def _ranked_pairs(found: DataFrame, limit: int | None) -> DataFrame:
    """passage_id, document_id, rank, cut of the documents by their first ``limit`` hits; one that has none of them has no rank, and tells a cut."""
    if limit is None:
        return ranked_documents(found).select("passage_id", "document_id", "rank", F.lit(False).alias("cut"))
    place = F.row_number().over(Window.partitionBy("passage_id").orderBy("gram", "document_id", "s_pos", "q_pos"))
    first = found.withColumn("place", place).where(F.col("place") <= limit + 1)
    gram = F.when(F.col("place") <= limit, F.col("gram"))
    counted = first.groupBy("passage_id", "document_id").agg(F.countDistinct(gram).alias("seeds"), (F.max("place") > limit).alias("cut"))
    rank = F.row_number().over(Window.partitionBy("passage_id").orderBy(F.desc("seeds"), "document_id"))
    return counted.withColumn("rank", F.when(F.col("seeds") > 0, rank)).select("passage_id", "document_id", "rank", "cut")


def search(passages: DataFrame, library, bounds: Bounds = Bounds(), passage_id: str = "passage_id", document_id: str = "document_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The matches, as of ``report``, and the outcome of every passage; ``library`` is a table of texts or a stored library.

    Seeds, best documents, runs, exact and near spans, suppression, report. An outcome has passage_id, status
    (complete, partial, insufficient_text, or empty for an empty library), matches, summary and warning. The passages' tokens, pairs
    and runs are written once to the shared folder, as several steps read them.
    """
    spark = passages.sparkSession
    library = _library(library, document_id, text)
    with Scratch(spark) as put:
        tokens = put(tokenized(passages, passage_id, text, "passage_id"), "overlap-tokens")
        ranked = put(_ranked_pairs(library.hits(asked_grams(tokens)), bounds.hits), "overlap-pairs")
        cuts = [ranked.where("cut").select("passage_id")]
        ranked = ranked.where("rank is not null").drop("cut")
        pairs, cut = _bounded(ranked, bounds.documents, ["passage_id"], ["rank"])
        cuts.append(cut)
        found = runs_of(tokens, library, pairs).join(ranked, ["passage_id", "document_id"])
        found = put(found, "overlap-runs")
        kept, cut = _bounded(found, bounds.runs, ["passage_id"], ["rank", "q_start", "s_start"])
        cuts.append(cut)
        kept, cut = _bounded(kept.drop("rank"), bounds.pair_runs, ["passage_id", "document_id"], [F.desc("matched"), "q_start", "s_start"])
        cuts.append(cut)
        long = kept.where(F.col("matched") >= MIN_EXACT).select(*BLOCK)
        spans = informative_spans(long.unionByName(chained(kept, bounds.pair_runs)), tokens)
        matches = report(suppressed(spans), bounds.matches)
        cuts.append(matches.where("status = 'partial'").select("passage_id"))
        matches = put(matches.drop("status"), "overlap-matches")
        partial = cuts[0]
        for cut in cuts[1:]:
            partial = partial.unionByName(cut)
        partial = put(partial.distinct(), "overlap-partial")
        told = put.keep(put(_outcomes(tokens, partial, matches, library.is_empty()), "overlap-outcomes"))
        status = F.when(F.col("cut"), "partial").otherwise("complete")
        flagged = matches.join(partial.withColumn("cut", F.lit(True)), "passage_id", "left").withColumn("status", status).drop("cut")
        put.keep(matches)
        put.keep(partial)
        return flagged, told


def _outcomes(asked: DataFrame, partial: DataFrame, matches: DataFrame, empty: bool) -> DataFrame:
    found = matches.groupBy("passage_id").agg(F.count("*").alias("matches"))
    rows = asked.select("passage_id", F.size("tokens").alias("words")).join(partial.withColumn("cut", F.lit(True)), "passage_id", "left").join(found, "passage_id", "left")
    status = F.when(F.lit(empty), "empty").when(F.col("words") < MIN_EXACT, "insufficient_text").when(F.col("cut"), "partial").otherwise("complete")
    count = F.when(F.col("words") < MIN_EXACT, F.lit(0)).otherwise(F.coalesce("matches", F.lit(0))).cast("long")
    said = F.create_map(*(F.lit(x) for pair in SUMMARIES.items() for x in pair))
    rows = rows.select("passage_id", status.alias("status"), count.alias("matches"))
    key = F.when((F.col("matches") > 0) & F.col("status").isin("complete", "partial"), F.lit("matched")).otherwise(F.col("status"))
    return rows.select("passage_id", "status", "matches", F.element_at(said, key).alias("summary"), F.when(F.col("status") == "partial", F.lit(PARTIAL)).alias("warning"))


def unavailable(passages: DataFrame, passage_id: str = "passage_id") -> DataFrame:
    """The outcomes where the library can't be read."""
    none = F.lit(None).cast("string")
    return passages.select(F.col(passage_id).alias("passage_id"), F.lit("unavailable").alias("status"), F.lit(0).cast("long").alias("matches"), F.lit(SUMMARIES["unavailable"]).alias("summary"), none.alias("warning"))


def find_overlaps(passages: DataFrame, library, passage_id: str = "passage_id", document_id: str = "document_id", text: str = "text", bounds: Bounds = Bounds()) -> DataFrame:
    """The matches of ``search``; passages of fewer than twelve words have none by the least lengths of spans."""
    return search(passages, library, bounds, passage_id, document_id, text)[0]


def attributed(matches: DataFrame, library: DataFrame, document_id: str = "document_id") -> DataFrame:
    """Matches with the title, address, licence, provider, attribution and evidence of their sources.

    The last two come from the library's metadata, a JSON string; what it lacks is empty.
    """
    told = {c: F.coalesce(F.get_json_object("metadata", f"$.{c}"), F.lit("")) if c in ("attribution", "license_evidence") else F.col(c) for c in SOURCE}
    sources = library.select(F.col(document_id).alias("document_id"), *(c.alias(name) for name, c in told.items()))
    return matches.join(sources, "document_id")


def suggestions(matches: DataFrame) -> DataFrame:
    """One note a match: which passage place to review, why, and what to do; from matches with a title of their source."""
    number = F.col("match_no").cast("string")
    return matches.select(
        "passage_id", F.concat(F.lit("suggestion-"), number).alias("id"), F.concat(F.lit("match-"), number).alias("match_id"), "q_start", "q_end",
        F.lit(NOTE_TITLE).alias("title"), F.concat(F.lit("This passage shares wording with "), F.col("title"), F.lit(".")).alias("reason"), F.lit(NOTE_ACTION).alias("action"),
    )


def displayed(matches: DataFrame, passages: DataFrame, library: DataFrame, passage_id: str = "passage_id", document_id: str = "document_id", text: str = "text") -> DataFrame:
    """Matches with the texts of their spans and UTF-16 offsets; only texts with a match are tokenised."""
    both = matches
    for side, df, own, name in (("q", passages, passage_id, "passage_id"), ("s", library, document_id, "document_id")):
        texts = df.select(F.col(own).alias(name), F.col(text).alias(f"{side}_text")).join(matches.select(name).distinct(), name, "left_semi")
        both = both.join(texts.withColumn(f"{side}_tokens", tokens_exact(F.col(f"{side}_text"))), name)
        start = F.element_at(f"{side}_tokens", F.col(f"{side}_start") + 1)["start"]
        end = F.element_at(f"{side}_tokens", F.col(f"{side}_end"))["end"]
        both = both.withColumn(f"{side}_span", F.col(f"{side}_text").substr(start + 1, end - start))
        both = both.withColumn(f"{side}_from", utf16_offset(F.col(f"{side}_text"), start)).withColumn(f"{side}_to", utf16_offset(F.col(f"{side}_text"), end))
    return both.drop("q_text", "s_text", "q_tokens", "s_tokens")
