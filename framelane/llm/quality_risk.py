"""Quality rules with risk-controlled thresholds.

Fixed rules reject the clearly broken texts. On top, each measure (share of symbols, of shouting, ...) may get a cutoff per
stratum (a language). A hash of the id deals the labelled documents to two halves. The first half chooses: of each measure's grid, laid down
beforehand, the cutoff that rejects most labelled bad documents while next to no good ones, the loosest of equal ones; measures that reject
more bad documents come first. The second half certifies: the joint rule of the first measure, of the first two, and so on, is tested by the
exact binomial (Clopper-Pearson) bound for rejecting at most ``alpha`` of the stratum's good documents, until one fails. Such a fixed sequence needs
no division among its tests; over the strata ``delta`` is divided (Bonferroni). So with probability 1 - ``delta`` the verdict of every
stratum, all its cutoffs taken together, rejects at most ``alpha`` of the good documents that pass the fixed rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from framelane.llm.shared import SPACES, checkpointed, words_of

#: The measures (from the columns of ``text_stats``) and their grids; a document with a measure at or above the cutoff goes. Fixed beforehand.
MEASURES = {
    "symbols": "n_symbols / word_chars",
    "shouting": "n_shouted / word_chars",
    "dup_lines": "n_dup_lines / n_words",
    "repeats": "n_repeat_words / n_words",
    "long_words": "word_chars / n_words / 100",
}
USED = ("n_words", "word_chars", "n_symbols", "n_shouted", "n_dup_lines", "n_repeat_words")
GRID = (0.02, 0.03, 0.05, 0.08, 0.12, 0.16, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9)


def text_stats(text: Column) -> dict[str, Column]:
    """Column expressions in two steps: apply the first dictionary's columns, then those of ``derived_stats``."""
    full = F.coalesce(text, F.lit(""))
    return {
        "_words": words_of(text),
        "_lines": F.filter(F.split(full, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != ""),
        "n_symbols": F.regexp_count(full, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_shouted": F.regexp_count(full, F.lit(r"[A-Z!]")).cast("long"),
    }


def repeated_words(hashes: Column, n_words: Column, window: int) -> Column:
    """Words covered by windows whose hash occurs twice or more in the text; ``hashes`` has one 64-bit hash per window start."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeats(s: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
        places = F.transform(s, lambda x, j: F.when(same(j, j - 1) | same(j, j + 1), x["i"]))
        starts = F.array_sort(F.filter(places, lambda i: i.isNotNull()))
        grown = F.aggregate(
            starts,
            F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
            lambda acc, i: F.struct((i + window).alias("end"), (acc["n"] + F.least(F.lit(window), i + window - acc["end"])).alias("n")),
        )
        return grown["n"]

    one = F.transform(F.array(pairs), repeats)  # names the sorted list once
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.get(one, F.lit(0))).otherwise(F.lit(0)).cast("long")


def with_stats(df: DataFrame, text_col: str = "text", window: int = 8) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_shouted, n_dup_lines, n_repeat_words (long) and base_failed; a null text counts as empty."""
    first = df.withColumns(text_stats(F.col(text_col)))
    second = first.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_hashes": F.when(
                F.size("_words") >= window,
                F.transform(F.sequence(F.lit(1), F.size("_words") - window + 1), lambda i: F.xxhash64(F.slice(F.col("_words"), i, F.lit(window)))),
            ).otherwise(F.array().cast("array<bigint>")),
        }
    )
    third = second.withColumn("n_repeat_words", repeated_words(F.col("_hashes"), F.col("n_words"), window))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return third.withColumn("base_failed", failed).drop("_words", "_lines", "_hashes")


def measure(name: str) -> Column:
    """A measure's value; 0 where the text has no words."""
    return F.coalesce(F.expr(f"CASE WHEN n_words > 0 THEN {MEASURES[name]} END"), F.lit(0.0))


def binomial_passes(k: Column, n: Column, alpha: float, delta: Column) -> Column:
    """Is P(X <= k) <= delta for X ~ Bin(n, alpha)? Then k rejections of n prove a rate below alpha at that confidence.

    Summed exactly from the k-th term down, in logs; more than n * alpha rejections never pass.
    """
    odds = math.log(alpha) - math.log1p(-alpha)
    up_to = lambda end: F.when(end >= 1, F.sequence(F.lit(1).cast("long"), end)).otherwise(F.array().cast("array<bigint>"))
    choose = F.aggregate(up_to(k), F.lit(0.0), lambda acc, i: acc + F.log((n - i + 1) / i))
    down = F.aggregate(
        F.reverse(up_to(k)),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda acc, i: F.struct(
            (acc["term"] * i / (n - i + 1) * math.exp(-odds)).alias("term"),
            (acc["sum"] + acc["term"] * i / (n - i + 1) * math.exp(-odds)).alias("sum"),
        ),
    )["sum"]
    tail = n * math.log1p(-alpha) + choose + k * odds + F.log(down)
    return F.when((n > 0) & (k <= n * alpha), tail <= F.log(delta)).otherwise(F.lit(False))


def choosing_half(doc_id: Column) -> Column:
    """Is a labelled document in the half that chooses the cutoffs? The other half certifies them."""
    return F.pmod(F.xxhash64(F.lit("half"), doc_id), F.lit(2)) == 0


def choose_cutoffs(held: DataFrame, alpha: float, grid) -> DataFrame:
    """Per ``stratum`` the array ``_chain`` of (bad, m, cut): at most one cutoff per measure, best first; ``held`` has the choosing half.

    A measure's cutoff may reject its share of half of ``alpha`` among the good documents of this half, so that the joint rule can be certified.
    """
    good = F.col("_good")
    counts = [F.sum(good.cast("long")).alias("n_good")]
    for name in MEASURES:
        for i, cut in enumerate(grid):
            over = measure(name) >= cut
            counts += [F.sum((over & good).cast("long")).alias(f"{name}_{i}_good"), F.sum((over & ~good).cast("long")).alias(f"{name}_{i}_bad")]
    tests = [
        F.struct(F.lit(m).alias("m"), F.lit(float(cut)).alias("cut"), F.col(f"{name}_{i}_good").alias("k"), F.col(f"{name}_{i}_bad").alias("bad"))
        for m, name in enumerate(MEASURES)
        for i, cut in enumerate(grid)
    ]
    rows = held.groupBy("stratum").agg(*counts).select("stratum", "n_good", F.explode(F.array(*tests)).alias("t"))
    open_ = rows.filter((F.col("t.bad") > 0) & (F.col("t.k") <= F.col("n_good") * (alpha / 2 / len(MEASURES))))
    best = open_.groupBy("stratum", F.col("t.m").alias("m")).agg(F.max(F.struct("t.bad", "t.cut")).alias("_best"))
    chain = F.array_sort(F.collect_list(F.struct((-F.col("_best.bad")).alias("less"), "m", F.col("_best.cut").alias("cut"))))
    return best.groupBy("stratum").agg(chain.alias("_chain"))


def select_cutoffs(stats: DataFrame, labels: DataFrame, stratum: str, alpha: float = 0.02, delta: float = 0.05, grid=GRID) -> DataFrame:
    """One row per stratum with cutoffs: ``stratum`` and ``cut_<measure>`` (null: none certified).

    ``labels``: ``doc_id``, ``quality`` (1 good, 0 bad; null left out; of repeated labels of a document the worst counts).
    Documents that fail the fixed rules take no part: they go anyway. With the default bounds and four strata a stratum needs 217 good
    documents in the certifying half if none of them is rejected. Tables of strata have one row each, with five cutoffs at most.
    """
    quality = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    joined = stats.filter(~F.col("base_failed")).join(quality, "doc_id")
    held = joined.select(F.col(stratum).alias("stratum"), (F.col("_quality") == 1).alias("_good"), choosing_half(F.col("doc_id")).alias("_chooses"), *USED)
    chains = choose_cutoffs(held.filter("_chooses"), alpha, grid)
    values = F.array(*[measure(m) for m in MEASURES])
    hit = F.array_position(F.transform("_chain", lambda t: F.get(F.col("_values"), t["m"]) >= t["cut"]), True)
    tried = held.filter("_good AND NOT _chooses").withColumn("_values", values).join(chains.withColumnRenamed("stratum", "_of"), F.col("stratum").eqNullSafe(F.col("_of")))
    rejected = [F.sum(((F.col("_hit") > 0) & (F.col("_hit") <= i + 1)).cast("long")).alias(f"_k{i}") for i in range(len(MEASURES))]
    counts = tried.withColumn("_hit", hit).groupBy("stratum").agg(F.count("*").alias("n_good"), F.first("_chain").alias("_chain"), *rejected)
    strata = counts.withColumn("_strata", chains.groupBy().agg(F.count("*")).scalar())
    passes = F.array(*[binomial_passes(F.col(f"_k{i}"), F.col("n_good"), alpha, delta / F.col("_strata")) for i in range(len(MEASURES))])
    proved = F.coalesce(F.nullif(F.array_position(passes, False), F.lit(0)) - 1, F.lit(len(MEASURES)))
    kept = strata.withColumn("_chain", F.slice("_chain", F.lit(1), proved.cast("int"))).filter(F.size("_chain") > 0)
    cut = lambda i: F.get(F.filter("_chain", lambda t: t["m"] == i), F.lit(0))["cut"]
    return kept.select("stratum", *[cut(i).alias(f"cut_{m}") for i, m in enumerate(MEASURES)])


def verdicts(stats: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """Adds ``kept``; strata without cutoffs keep all that pass the fixed rules. The cutoff table has one row per stratum."""
    joined = stats.join(cutoffs, F.col(stratum).eqNullSafe(F.col("stratum")), "left")
    over = [F.coalesce(measure(m) >= F.col(f"cut_{m}"), F.lit(False)) for m in MEASURES]
    kept = ~F.col("base_failed")
    for o in over:
        kept = kept & ~o
    return joined.withColumn("kept", kept).drop("stratum", *[f"cut_{m}" for m in MEASURES])


OUTPUT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def judge_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **kw) -> DataFrame:
    """The ``OUTPUT`` columns for every row of ``docs`` (``doc_id``, ``text`` and the stratum are read, others not).

    Null and empty texts have no words and fail the fixed rules; a null stratum is one of its own; repeated rows are judged
    alike; empty labels give no cutoffs. The measures are taken in one pass over the texts and written once, without them.
    """
    stats = checkpointed(with_stats(docs.select("doc_id", "text", F.col(stratum).alias("_stratum"))).drop("text"))
    return verdicts(stats, select_cutoffs(stats, labels, "_stratum", **kw), "_stratum").select(*OUTPUT)


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **kw) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns. Verdicts are found by id and a hash of the text, nulls included."""
    doc, tie = F.coalesce("doc_id", F.lit(2**63 - 1)).cast("long"), F.xxhash64(F.coalesce("text", F.lit("")))
    stats = checkpointed(with_stats(docs.select("doc_id", "text", F.col(stratum).alias("_stratum"), doc.alias("_doc"), tie.alias("_tie"))).drop("text"))
    good = verdicts(stats, select_cutoffs(stats, labels, "_stratum", **kw), "_stratum").filter("kept").select("_doc", "_tie", "_stratum")
    packed = docs.select(F.struct("*").alias("_row"), F.col(stratum).alias("_own"), doc.alias("_id"), tie.alias("_hash"))
    found = (F.col("_id") == F.col("_doc")) & (F.col("_hash") == F.col("_tie")) & F.col("_own").eqNullSafe(F.col("_stratum"))
    return packed.join(good, found, "left_semi").select("_row.*")
