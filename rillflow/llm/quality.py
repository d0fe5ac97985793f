"""Quality rules in DataFrame operations only: base counts and distribution divergence.

A document's histograms of character classes and of common words are compared with language
references by Jensen-Shannon distance (base 2, so between 0 and 1). The bins of a reference
are the function words of a language (``FUNCTION_WORDS``) and one bin for all other words. Its
shares, and those of the character classes, are counted over all documents whose ``lang`` is
that language and shrunk towards shipped shares that weigh as much as ``PRIOR_WORDS`` words;
so every listed language has a reference in a table of any size, an empty one included, and no
test is switched on or off by the amount of text.

A document passes a test if it lies near any reference. Its own ``lang`` plays no part in its
verdict, so neither a wrong mark nor NULL nor an unlisted one condemns or saves a text. Long
text in a language that no reference covers is far from all of them and is rejected: give
``function_words`` for such a language.

Guards: the character test needs ``MIN_BYTES`` bytes, the word test ``MIN_WORDS`` words; a
document below a guard passes that test.

One pass over the texts writes a slim profile per document; references and verdicts read
that. All counting inside a document happens on its own row, windows of words are hashed by
doubling (1, 2, 4, 8 words), and only documents that repeat a window have them sorted. What
reaches the driver is one reference per listed language.

NULL or empty text: no words, so the base rules fail. Very long texts are read whole, on their
row. Repeated rows are judged one by one and alike. An empty table gives an empty result.
``filter_documents`` keeps all columns; names that begin with ``_rule`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import SPACE, WORD
from rillflow.scratch import store

MIN_BASE_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
MIN_BYTES = 100
MIN_WORDS = 100
#: Weight of the shipped shares in a reference.
PRIOR_WORDS = 2000
#: Both lie between clean and junk rows of two labelled tables; README has recall and false rejections.
MOST_CLASS_DISTANCE = 0.30
#: Of the distance that a document without any function word has.
MOST_WORD_SHARE = 0.85
SYMBOLS = "#*$%&|<>"
DIGITS = "0123456789"
#: Frequent function words per language code.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as on was by are this from at be or".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch".split(),
    "fr": "de la le et les des en un une du que est pour qui dans par plus au sur pas".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
    "it": "di e il la che in a per un del è con non si le da i una dei come".split(),
    "pt": "de a o que e do da em um para com não uma os no se na por mais as".split(),
    "nl": "de van het een in en is dat op te voor met zijn die aan er niet ook als door".split(),
}

#: Shipped shares: all function words of a language together, the k-th listed in proportion to 1/k;
#: bytes of white space, digits, symbols, continuation bytes and all others, and bytes a word.
PRIOR_HELD = 0.35
PRIOR_CLASSES = (0.16, 0.01, 0.001, 0.02, 0.809)
PRIOR_WORD_BYTES = 6.0


def _occurrences(text: Column, characters: str) -> Column:
    """How often any of some ASCII characters occurs; texts without them are not rewritten."""
    return F.when(text.rlike(f"[{characters}]"), F.length(text) - F.length(F.translate(text, characters, ""))).otherwise(0)


def _doubled(hashes: Column, n: Column, step: int) -> Column:
    """Hashes of runs of 2 * ``step`` from the ``n`` hashes of runs of ``step``."""
    return F.zip_with(F.slice(hashes, 1, n - step), F.slice(hashes, step + 1, n - step), lambda a, b: F.xxhash64(a, b))


def prior_shares(words: list[str]) -> dict[str, float]:
    """Shipped share of every function word of one language."""
    whole = sum(1 / k for k in range(1, len(words) + 1))
    return {w: PRIOR_HELD / (k * whole) for k, w in enumerate(words, 1)}


def profiled(docs: DataFrame, keep: list[str], function_words: dict[str, list[str]] = FUNCTION_WORDS) -> DataFrame:
    """``keep``, ``_rule_lang`` and per document: ``_rule`` (base counts), ``_rule_classes`` (bytes
    per class: white space, digits, symbols, continuation bytes, all others) and ``_rule_common``,
    the (w, n) of its function words. The base counts are long, ``base_failed`` boolean."""
    text = F.coalesce("text", F.lit(""))
    kept = [F.col(f"`{c}`").alias(f"_rule_{i}") for i, c in enumerate(keep)]
    out = docs.select(F.struct(*kept).alias("_rule_kept"), F.col("lang").alias("_rule_lang"), text.alias("_rule_text"))
    text = F.col("_rule_text")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    out = out.withColumns({"_rule_words": F.array_remove(F.split(text, SPACE), ""), "_rule_lines": lines})
    words, n = F.col("_rule_words"), F.col("_rule_n")
    out = out.withColumns({"_rule_n": F.size(words), "_rule_1": F.transform(words, lambda w: F.xxhash64(w))})
    out = out.withColumn("_rule_2", F.when(n >= WINDOW, _doubled(F.col("_rule_1"), n, 1)))
    out = out.withColumn("_rule_4", F.when(n >= WINDOW, _doubled(F.col("_rule_2"), n - 1, 2)))
    # without a run of four words that repeats there is none of eight
    again = F.size(F.array_distinct("_rule_4")) < F.size("_rule_4")
    out = out.withColumn("_rule_8", F.when(again, _doubled(F.col("_rule_4"), n - 3, 4)))
    repeats = F.size(F.array_distinct("_rule_8")) < F.size("_rule_8")
    pairs = F.sort_array(F.transform("_rule_8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_rule_pairs", F.when(repeats, pairs))
    p = F.col("_rule_pairs")
    same = lambda x, i: F.coalesce(F.get(p, i)["h"] == x["h"], F.lit(False))
    twice = F.filter(p, lambda x, i: same(x, i - 1) | same(x, i + 1))
    out = out.withColumn("_rule_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    at = F.col("_rule_at")
    gaps = F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW))))
    out = out.withColumn("_rule_repeated", F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)))
    failed = (n < MIN_BASE_WORDS) | (100 * F.col("_rule_repeated") > REPEAT_PERCENT * n)
    listed = sorted({w for ws in function_words.values() for w in ws})
    out = out.withColumns(
        {
            "_rule_chars": F.length(text),
            "_rule_word_chars": F.length(F.array_join(words, "")),
            "_rule_symbols": _occurrences(text, SYMBOLS),
            "_rule_found": F.sort_array(F.filter(words, lambda w: w.isin(listed))),
        }
    )
    c = F.col("_rule_found")
    starts = F.filter(F.transform(c, lambda w, i: F.when((i == 0) | (F.get(c, i - 1) != w), i)), lambda i: i.isNotNull())
    out = out.withColumn("_rule_starts", starts)
    s = F.col("_rule_starts")
    runs = F.transform(s, lambda i, j: F.struct(F.get(c, i).alias("w"), (F.coalesce(F.get(s, j + 1), F.size(c)) - i).cast("double").alias("n")))
    n_bytes, chars = F.octet_length(text), F.col("_rule_chars")
    classes = [chars - F.col("_rule_word_chars"), _occurrences(text, DIGITS), F.col("_rule_symbols"), n_bytes - chars]
    out = out.withColumn("_rule_four", F.array(*[x.cast("double") for x in classes]))
    rest = n_bytes - F.aggregate("_rule_four", F.lit(0.0), lambda a, x: a + x)
    rule = F.struct(
        n.cast("long").alias("n_words"),
        F.col("_rule_word_chars").cast("long").alias("word_chars"),
        F.col("_rule_symbols").cast("long").alias("n_symbols"),
        (F.size("_rule_lines") - F.size(F.array_distinct("_rule_lines"))).cast("long").alias("n_dup_lines"),
        F.col("_rule_repeated").cast("long").alias("n_repeat_words"),
        failed.alias("base_failed"),
    )
    return out.select(
        *[F.col("_rule_kept").getField(f"_rule_{i}").alias(c) for i, c in enumerate(keep)],
        "_rule_lang",
        rule.alias("_rule"),
        F.array_append("_rule_four", rest).alias("_rule_classes"),
        runs.alias("_rule_common"),
    )


def references(profiles: DataFrame, function_words: dict[str, list[str]] = FUNCTION_WORDS) -> list[dict]:
    """One reference per listed language: counts over its documents, shrunk towards the shipped shares."""
    listed = profiles.filter(F.col("_rule_lang").isin(list(function_words)))
    sums = listed.groupBy("_rule_lang").agg(
        F.sum("_rule.n_words").alias("total"), *[F.sum(F.col("_rule_classes")[i]).alias(f"c{i}") for i in range(5)]
    )
    words = listed.select("_rule_lang", F.inline("_rule_common")).groupBy("_rule_lang", "w").agg(F.sum("n").alias("n"))
    per_word: dict[str, dict[str, float]] = {}
    for r in words.collect():
        per_word.setdefault(r["_rule_lang"], {})[r["w"]] = r["n"]
    seen = {r["_rule_lang"]: r for r in sums.collect()}
    found = []
    for lang, ws in sorted(function_words.items()):
        r, own = seen.get(lang), per_word.get(lang, {})
        total, counts = (r["total"], [r[f"c{i}"] for i in range(5)]) if r else (0, [0.0] * 5)
        shares = {w: (PRIOR_WORDS * q + own.get(w, 0.0)) / (PRIOR_WORDS + total) for w, q in prior_shares(ws).items()}
        prior_bytes = PRIOR_WORDS * PRIOR_WORD_BYTES
        classes = [(prior_bytes * q + x) / (prior_bytes + sum(counts)) for q, x in zip(PRIOR_CLASSES, counts)]
        found.append({"lang": lang, "words": shares, "classes": classes})
    return found


def _half(p: Column, q: Column) -> Column:
    """One bin's part of the Jensen-Shannon divergence in bits."""
    part = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)
    return 0.5 * (part(p) + part(q))


def _class_distance(counts: Column, n_bytes: Column, ref: Column) -> Column:
    total = F.aggregate(F.zip_with(counts, ref["classes"], lambda c, q: _half(c / n_bytes, q)), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def _word_distance(counts: Column, n: Column, ref: Column) -> Column:
    """Distance as a share of that of a document without any function word.

    ``counts``: (w, n) of the document's function words. A word of the reference that the
    document lacks adds half its share; so all shares are halved first and present words corrected.
    """

    def add(a: Column, x: Column) -> Column:
        q = F.element_at(ref["words"], x["w"])
        return F.when(q.isNull(), a).otherwise(F.struct((a["d"] + _half(x["n"] / n, q) - 0.5 * q).alias("d"), (a["n"] + x["n"]).alias("n")))

    start = F.struct((0.5 * ref["held"]).alias("d"), F.lit(0.0).alias("n"))
    here = F.aggregate(counts, start, add, lambda a: F.sqrt(F.greatest(a["d"] + _half((n - a["n"]) / n, 1 - ref["held"]), F.lit(0.0))))
    return here / F.sqrt(0.5 * ref["held"] + _half(F.lit(1.0), 1 - ref["held"]))


def judged(docs: DataFrame, keep: list[str] | None = None, function_words: dict[str, list[str]] = FUNCTION_WORDS) -> DataFrame:
    """The ``keep`` columns (all, if not given), the struct ``_rule`` of the base counts and the verdict ``_rule_kept``."""
    keep = docs.columns if keep is None else keep
    profiles = store(profiled(docs, keep, function_words), "profiles")
    refs = references(profiles, function_words)
    literal = F.array(
        *[
            F.struct(
                F.create_map(*[F.lit(x) for pair in r["words"].items() for x in pair]).alias("words"),
                F.lit(float(sum(r["words"].values()))).alias("held"),
                F.array(*[F.lit(float(x)) for x in r["classes"]]).alias("classes"),
            )
            for r in refs
        ]
    )
    n = F.col("_rule.n_words").cast("double")
    out = profiles.withColumn("_rule_bytes", F.aggregate("_rule_classes", F.lit(0.0), lambda a, x: a + x))
    n_bytes = F.col("_rule_bytes")

    def near(distance, most: float) -> Column:
        return F.exists(literal, lambda r: distance(r) <= most)

    classes_ok = (n_bytes < MIN_BYTES) | near(lambda r: _class_distance(F.col("_rule_classes"), n_bytes, r), MOST_CLASS_DISTANCE)
    words_ok = (n < MIN_WORDS) | near(lambda r: _word_distance(F.col("_rule_common"), n, r), MOST_WORD_SHARE)
    kept = F.when(F.col("_rule.base_failed"), False).otherwise(classes_ok & words_ok)
    return out.select(*[F.col(f"`{c}`") for c in keep], "_rule", kept.alias("_rule_kept"))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns."""
    return judged(docs).filter("_rule_kept").select(*[F.col(f"`{c}`") for c in docs.columns])
