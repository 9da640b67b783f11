"""License scan by a positional rare-token index.

Each template (a licence notice as words) posts its rarest words, by document frequency in the scanned corpus, with their
places. A file's own rare licence words are looked up; hits that agree on the relative position (word place in the file minus
place in the template) form a candidate alignment, scored by the share of the template's IDF weight that it holds. An
alignment counts once the template's mandatory key phrase stands in the file. DataFrame and SQL expressions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from framelane.llm.shared import checkpointed

#: Base phrases and labels. Fixed values.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Templates: label, notice, key phrase that must stand in the file. Fixed values.
TEMPLATES = (
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("mpl-2", "subject to the terms of the mozilla public license version 2 0", "mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
)
#: A word: letters, digits and whatever is not ASCII.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The Kelvin sign is the one other character whose lower case is a single ASCII letter.
KELVIN = "K"


def lower_ascii_words(text: Column) -> Column:
    """A text's words in ASCII lower case; null has none. Other letters may change case but stay other letters."""
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit("é")))
    return F.filter(F.split(low, GAP), lambda w: w != "")


def phrase_starts(words: Column, phrase: str) -> Column:
    """Word places (from 0) where the phrase's words stand consecutively, overlaps counted; looked for only where it can stand."""
    parts = phrase.split()
    fits = lambda i: _all(F.get(words, i + k) == p for k, p in enumerate(parts))
    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), fits)
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    return F.when((F.size(words) > 0) & F.contains(joined, F.lit(f" {phrase} ")), places).otherwise(F.array().cast("array<int>"))


def _all(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def rare_postings(files: DataFrame, templates=TEMPLATES, rare: int = 5) -> list[tuple[int, str, int, float]]:
    """(template, token, place, share of the template's weight) of the ``rare`` highest-IDF words of each template.

    Document frequencies cover every row of ``files`` (``_words``); only the templates' own words are counted, so the driver gets one
    number per such word. Words that no file has come last, as they hit
    nothing; of equally rare words those of the key phrase come first.
    """
    vocabulary = sorted({w for _, notice, _ in templates for w in notice.split()})
    known = F.array(*[F.lit(w) for w in vocabulary])
    seen = files.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(known, "_words"))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    df = {r.token: r.df for r in seen.collect()}  # at most one row per vocabulary word
    idf = {w: math.log((df.get("", 0) + 1) / (df.get(w, 0) + 1)) + 0.1 for w in vocabulary}
    out = []
    for t, (_, notice, key) in enumerate(templates):
        best = sorted(enumerate(notice.split()), key=lambda x: (x[1] not in df, -idf[x[1]], x[1] not in key.split(), x[0]))[:rare]
        weight = sum(idf[w] for _, w in best)
        out += [(t, w, place, idf[w] / weight) for place, w in best]
    return out


def scan(files: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES, least: float = 0.6) -> DataFrame:
    """One row per row of ``files``: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``score`` is the best alignment's share of its template's weight, 0 without one; a template's label counts from ``least`` on.
    Null and empty texts have no words, no places and empty label lists. Equal rows are joined by a row key of id and text,
    so they get equal results. Texts without any rare licence word are passed by; those with one send their hits only.
    """
    packed = files.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    worded = packed.withColumn("_words", lower_ascii_words(F.col("_text")))
    postings = rare_postings(worded, templates)
    rare = F.array(*[F.lit(w) for w in sorted({p[1] for p in postings})])
    starts = {f"_p{i}": phrase_starts(F.col("_words"), p) for i, p in enumerate(phrases)}
    based = worded.withColumns(starts).withColumn("_key", F.xxhash64("doc_id", F.coalesce("_text", F.lit("")), F.isnull("_text")))
    all_starts = F.concat(*[F.col(c) for c in starts])
    labels = F.array_sort(F.array_distinct(F.concat(*[F.when(F.size(c) > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for c, label in zip(starts, phrases.values())])))
    light = based.select(
        "doc_id",
        "_key",
        F.size("_words").cast("long").alias("n_words"),
        F.size(all_starts).cast("long").alias("n_base"),
        F.array_min(all_starts).cast("long").alias("first_word"),
        F.array_max(all_starts).cast("long").alias("last_word"),
        labels.alias("_base"),
        F.when(
            F.arrays_overlap("_words", rare),
            F.filter(F.transform("_words", lambda w, i: F.struct(w.alias("token"), i.alias("at"))), lambda x: x["token"].isin([p[1] for p in postings])),
        ).alias("_hits"),
        F.when(F.arrays_overlap("_words", rare), F.array(*[
            F.contains(F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" ")), F.lit(f" {key} ")) for _, _, key in templates
        ])).alias("_keys"),
    )
    light = checkpointed(light)  # without the texts
    names = F.array(*[F.lit(label) for label, _, _ in templates])
    hits = light.filter("_hits IS NOT NULL").dropDuplicates(["_key"]).select("_key", "_keys", F.explode("_hits").alias("h")).select("_key", "_keys", "h.token", "h.at")
    posted = F.array(*[F.struct(F.lit(t).alias("template"), F.lit(w).alias("token"), F.lit(p).alias("place"), F.lit(x).alias("share")) for t, w, p, x in postings])
    own = F.filter(posted, lambda p: (p["token"] == F.col("token")) & F.get("_keys", p["template"]))
    aligned = hits.select("_key", "at", F.explode(own).alias("p")).select("_key", "p.template", "p.share", (F.col("at") - F.col("p.place")).alias("shift"))
    scored = aligned.groupBy("_key", "template", "shift").agg(F.sum("share").alias("part"))
    best = scored.groupBy("_key").agg(
        F.max("part").alias("_part"),
        F.collect_set(F.when(F.col("part") >= least, F.get(names, F.col("template")))).alias("_found"),
    ).withColumnRenamed("_key", "_of")
    joined = light.drop("_hits", "_keys").join(best, F.col("_key") == F.col("_of"), "left")
    found = F.array_sort(F.array_distinct(F.concat("_base", F.coalesce("_found", F.array().cast("array<string>")))))
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(found, ",").alias("labels"),
        F.least(F.lit(1.0), F.coalesce("_part", F.lit(0.0))).alias("score"),
    )
