"""License notices: phrases at consecutive words, and an exact containment join with templates.

The join is a set-similarity join between blocks of all texts and license templates.  Blocks
are lines, or windows of consecutive words that no line break ends.  Tokens are ordered by
their frequency over all blocks, rarest first.  A block can hold `threshold` of a template's
tokens only if it shares a token of the template's prefix in that order; length and
positions rule out further pairs before tokens are compared.
"""

import math

from pyspark.sql import DataFrame, functions as F

from packmill.llm.common import Scratch, bundled, lower_ascii

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
THRESHOLD = 0.85

# Wording that licenses prescribe for notices.
TEMPLATES = {
    "mit-release": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software "
                 "and associated documentation files",
    "apache-2.0": "licensed under the apache license version 2 0",
    "gpl-3.0": "licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the "
                  "gnu general public license as published by the free software foundation",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-4.0": "licensed under a creative commons attribution 4 0 international license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided "
           "that the following conditions are met",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee "
           "is hereby granted",
}


def _spaces(column):
    return F.length(column) - F.length(F.replace(column, F.lit(" ")))


def _phrase(joined, n_words, phrase: str):
    """Places of a phrase in words joined by single spaces: count, first and last start.

    No phrase overlaps itself, so the words before the first and after the last place tell both.
    """
    parts = F.split(joined, f"(?<= ){phrase}(?= )")
    places = F.size(parts) - 1
    first = _spaces(F.element_at(parts, 1)) - 1
    last = n_words - (_spaces(F.element_at(parts, -1)) - 1) - len(phrase.split())
    return F.struct(places.cast("long").alias("n"), F.when(places > 0, first).cast("long").alias("first"),
                    F.when(places > 0, last).cast("long").alias("last"))


def _windows(words, n_words, length: int):
    """Windows of 2 * length words at every length / 2 words: what lies in 1.5 * length words
    stands whole in one of them, and none holds words further apart than 2 * length."""
    width, step = 2 * length, (length + 1) // 2
    steps = F.ceil(F.greatest(n_words - width, F.lit(0)) / F.lit(step)).cast("int")
    return F.transform(F.sequence(F.lit(0), steps), lambda k: F.slice(words, k * step + 1, F.lit(width)))


def find_licenses(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None,
                  threshold: float = THRESHOLD, carry: tuple[str, ...] | None = None,
                  windows: bool = False) -> DataFrame:
    """Documents (struct `row`, of the columns `carry` if given) with n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base: places where the words of a phrase of PHRASES stand consecutively in the whole
    text.  labels adds each template of which one line holds at least `threshold` of the
    distinct words; score is the largest such share, 0 without one.  With `windows` the words
    of the whole text count and not its lines: for each template, windows of twice its words
    at every half of them, so a notice may be wrapped anywhere, and words that are scattered
    over a long line are none.  A null text counts as
    empty: no words, no places, no labels.  Rows that repeat are scored one by one.  The
    templates are broadcast; they are an argument, not data.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    sets = {label: list(dict.fromkeys(words.split())) for label, words in (templates or TEMPLATES).items()}
    # lines are compared with all templates, windows with the templates of their length
    lengths = {label: len(words.split()) if windows else 0 for label, words in (templates or TEMPLATES).items()}
    needs = {label: math.ceil(threshold * len(words) - 1e-9) for label, words in sets.items()}
    vocabulary = sorted({w for words in sets.values() for w in words})
    known = F.array(*[F.lit(w) for w in vocabulary])

    def tokens(words):
        return F.array_intersect(words, known)

    def blocks_of_lines(lines):
        return F.transform(lines, lambda ws: F.struct(F.lit(0).alias("length"), tokens(ws).alias("tokens")))

    def blocks_of_windows(words):
        # only texts that hold enough words of a template of this length anywhere are cut
        return F.concat(*[F.when(
            F.greatest(*[(F.size(F.array_intersect("held", F.array(*map(F.lit, sets[x])))) >= needs[x]).cast("int")
                         for x in sets if lengths[x] == length], F.lit(0)) > 0,
            F.transform(_windows(words, F.size(words), length), lambda ws: F.struct(
                F.lit(length).alias("length"), tokens(ws).alias("tokens"))))
            .otherwise(F.array().cast("array<struct<length:int,tokens:array<string>>>"))
            for length in sorted(set(lengths.values()))])

    found_words = lambda part: F.regexp_extract_all(part, F.lit(WORD), F.lit(0))
    base = bundled(docs, carry, lower=lower_ascii(F.coalesce(F.col(text), F.lit("")))).select(
        "row", (F.array(found_words(F.col("lower"))) if windows else F.transform(F.split("lower", "\n"), found_words)).alias("lines"),
        F.contains("lower", F.lit("license")).alias("maybe"))
    if windows:
        base = base.withColumn("held", tokens(F.col("lines")[0]))
    base = base.select(
        "row", F.aggregate("lines", F.lit(0).cast("long"), lambda n, ws: n + F.size(ws)).alias("n_words"),
        F.when(F.col("maybe"), F.concat(F.lit(" "), F.concat_ws(" ", F.flatten("lines")), F.lit(" "))).alias("joined"),
        F.filter(blocks_of_windows(F.col("lines")[0]) if windows else blocks_of_lines(F.col("lines")),
                 lambda b: F.size(b["tokens"]) > 0).alias("blocks"))
    found = F.array(*[_phrase(F.col("joined"), F.col("n_words"), p) for p, _ in PHRASES])
    base = base.withColumn("found", F.when(F.col("joined").isNotNull(), found)).select(
        "row", "n_words", "blocks",
        F.coalesce(F.aggregate("found", F.lit(0).cast("long"), lambda n, f: n + f["n"]), F.lit(0)).alias("n_base"),
        F.array_min(F.transform("found", lambda f: f["first"])).alias("first_word"),
        F.array_max(F.transform("found", lambda f: f["last"])).alias("last_word"),
        F.filter(F.array(*[F.when(F.col("found")[k]["n"] > 0, label) for k, (_, label) in enumerate(PHRASES)]),
                 lambda x: x.isNotNull()).alias("base_set"))
    base = scratch.table(base.withColumn("rid", F.monotonically_increasing_id()))

    # frequencies of the template words alone: as many rows as the templates have words
    counts = dict(base.select(F.explode("blocks.tokens").alias("tokens")).select(F.explode("tokens").alias("token"))
                  .groupBy("token").count().collect())
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    ranks = F.create_map(*[x for w in vocabulary for x in (F.lit(w), F.lit(rank[w]))])
    prefixes = []
    for label, words in sets.items():
        order = sorted(rank[w] for w in words)
        need = needs[label]
        prefixes += [F.struct(F.lit(label).alias("label"), F.lit(lengths[label]).alias("length"),
                              F.array(*map(F.lit, order)).alias("template"),
                              F.lit(need).alias("need"), F.lit(i).alias("i"), F.lit(order[i]).alias("token"))
                     for i in range(len(order) - need + 1)]
    index = spark.range(1).select(F.inline(F.array(*prefixes)))

    least = min(needs.values())
    blocks = (base.select("rid", F.explode("blocks").alias("b"))
              .select("rid", "b.length", F.array_sort(F.transform("b.tokens", lambda t: ranks[t])).alias("line"))
              .where(F.size("line") >= least)
              .withColumn("m", F.size("line")))
    # the line's own prefix: its rarest tokens up to the least number that any template needs
    probes = blocks.select("*", F.posexplode(F.slice("line", F.lit(1), F.col("m") - least + 1)).alias("j", "token"))
    common = F.size(F.array_intersect("line", "template"))
    matches = (probes.join(F.broadcast(index), ["token", "length"])
               .where((F.col("m") >= F.col("need")) & (F.col("j") <= F.col("m") - F.col("need"))
                      & (1 + F.least(F.size("template") - F.col("i") - 1, F.col("m") - F.col("j") - 1) >= F.col("need")))
               .withColumn("common", common).where(F.col("common") >= F.col("need"))
               .groupBy("rid").agg(F.collect_set("label").alias("method_set"),
                                   F.max(F.col("common") / F.size("template")).alias("best")))
    none = F.array().cast("array<string>")
    return base.drop("blocks").join(matches, "rid", "left").select(
        "row", "n_words", "n_base", "first_word", "last_word",
        F.concat_ws(",", F.array_sort("base_set")).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union("base_set", F.coalesce("method_set", none)))).alias("labels"),
        F.coalesce("best", F.lit(0.0)).alias("score"))


def op2_prefix_filter(spark, sf_dir: str) -> DataFrame:
    """Blocks are windows of words, so that notices are found wherever lines break."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_licenses(docs, carry=("doc_id",), windows=True).select(
        "row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _sql() -> str:
    words = (r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
             r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
    places = " UNION ALL ".join(
        f"SELECT r, p - 1 AS p, '{label}' AS label FROM k WHERE " + " AND ".join(
            f"w[p{f' + {i}' if i else ''}] = '{word}'" for i, word in enumerate(phrase.split()))
        for phrase, label in PHRASES)
    rows = ", ".join(f"('{label}', list_distinct(string_split('{text}', ' ')), {len(text.split())})" for label, text in TEMPLATES.items())
    needed = f"ceil({THRESHOLD} * len(t) - 1e-9)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {words.format('text')} AS w FROM documents),
k AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d WHERE list_contains(w, 'license')),
b AS (SELECT r, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, list(DISTINCT label) AS labels
      FROM ({places}) GROUP BY r),
t(label, t, n) AS (VALUES {rows}),
l AS (SELECT r, label, t, n, w, (n + 1) // 2 AS step FROM (SELECT r, w, list_distinct(w) AS s FROM d), t
      WHERE len(list_intersect(s, t)) >= {needed}),
v AS (SELECT r, label, t, list_distinct(w[k * step + 1 : k * step + 2 * n]) AS w
      FROM (SELECT *, unnest(range(0, CAST(ceil(greatest(len(w) - 2 * n, 0) / step) AS BIGINT) + 1)) AS k FROM l)),
m AS (SELECT r, label, len(list_intersect(w, t)) / len(t) AS score FROM v
      WHERE len(list_intersect(w, t)) >= {needed}),
s AS (SELECT r, list(DISTINCT label) AS labels, max(score) AS score FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(s.labels, [])))), ','), '') AS labels,
       coalesce(score, 0.0) AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN s USING (r)"""


OP2_SQL = _sql()
