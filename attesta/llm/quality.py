"""Quality rules: base counts, and divergence of character-class and common-word histograms from language references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import WORD_SPACES, pick, staged

#: Frequent function words of the reference languages.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "it", "as", "with", "on", "be", "by", "this", "are", "an", "at", "from", "he"),
    "fr": ("le", "la", "les", "des", "et", "en", "un", "une", "du", "que", "qui", "dans", "pour", "par", "sur", "au", "ou", "de", "est", "elle"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"),
    "es": ("el", "la", "de", "que", "y", "en", "un", "los", "se", "del", "las", "por", "con", "no", "una", "su", "para", "es", "al", "lo"),
}
LANGUAGES = tuple(COMMON)
COMMON_WORDS = tuple(sorted({w for ws in COMMON.values() for w in ws}))
CLASSES = ("lower", "upper", "digit", "space", "stop", "mark", "symbol", "other")
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: The class distance allowed shrinks with length, as a histogram of few words is far from any reference by chance;
#: common words are judged only from so many words on.
MIN_COMMON_WORDS = 100
CLASS_DISTANCE, CLASS_DISTANCE_WORDS, MAX_COMMON_DISTANCE = 0.11, 8.0, 0.36


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{WORD_SPACES}]+"))


#: Bits of a packed window that hold its position; longer texts are compared by their full hashes at once.
POSITION_BITS = 24


def repeated_windows(words: Column) -> Column:
    """Positions (from 0) of the 3-word windows that occur twice or more in the text.

    Hash and position are packed into one long, so that a primitive sort brings equal windows together; only those next
    to one that looks equal are compared by full hashes.
    """
    n = F.greatest(F.size(words) - 2, F.lit(0))
    full = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    here = (1 << POSITION_BITS) - 1
    packed = F.transform(F.slice(words, F.lit(1), n), lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.lit(~here)).bitwiseOR(i))
    ordered = F.sort_array(packed)

    def alike(xs: Column) -> Column:
        same = lambda x, y: x.bitwiseXOR(y).bitwiseAND(F.lit(~here)) == 0
        return F.filter(xs, lambda x, k: F.coalesce(same(x, F.get(xs, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(xs, k + 1)), F.lit(False)))

    near = F.get(F.transform(F.array(ordered), alike), F.lit(0))
    at = F.when(n < here, F.transform(near, lambda x: x.bitwiseAND(F.lit(here)).cast("int"))).when(n > 0, F.sequence(F.lit(0), n - 1))
    exact = F.sort_array(F.transform(at, lambda i: F.struct(full(i).alias("h"), i.alias("i"))))
    twice = lambda xs: F.filter(xs, lambda x, k: F.coalesce(x["h"] == F.get(xs, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(xs, k + 1)["h"], F.lit(False)))
    return F.transform(F.get(F.transform(F.array(exact), twice), F.lit(0)), lambda x: x["i"])


def features(docs: DataFrame, id_col: str, text_col: str, lang_col: str, text_hash: bool = False) -> DataFrame:
    """One narrow row for each document: base counts and the two histograms, without leaving the row."""
    d = pick(docs, doc_id=id_col, text=text_col, lang=lang_col).withColumn("text", F.coalesce("text", F.lit("")))
    extra = [F.xxhash64("text").alias("text_hash")] if text_hash else []
    t, w = F.col("text"), F.col("words")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{WORD_SPACES}]"))
    d = d.withColumn("words", words_of(t)).withColumn("rest", F.regexp_replace(t, rf"[\p{{Ll}}{WORD_SPACES}]++", "")).withColumn("lines", lines)
    d = d.withColumn("twice", repeated_windows(w))
    d = d.withColumn("common", F.filter(F.transform(w, F.lower), lambda x: x.isin(*COMMON_WORDS)))
    covered = F.array_distinct(F.flatten(F.transform("twice", lambda i: F.array(i, i + 1, i + 2))))
    d = d.select(
        "doc_id", "lang", *extra, F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), F.length(t).cast("long").alias("n_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size(covered).cast("long").alias("n_repeat_words"), "rest",
        F.concat(F.lit(" "), F.array_join("common", "  "), F.lit(" ")).alias("common"), F.size("common").cast("long").alias("n_common"),
    )
    r = F.col("rest")  # what is neither a lower-case letter nor white space: short, so counting over it is cheap
    d = d.withColumn("upper", F.regexp_count(r, F.lit(r"\p{Lu}"))).withColumn("digit", F.regexp_count(r, F.lit("[0-9]"))).withColumn("stop", F.regexp_count(r, F.lit("[.,;:]")))
    d = d.withColumn("mark", F.regexp_count(r, F.lit(r"[!?'\"()\[\]{}/\\=_+@~^-]"))).withColumn("n_symbols", F.regexp_count(r, F.lit(f"[{SYMBOLS}]")).cast("long"))
    d = d.withColumn("lower", F.col("word_chars") - F.length(r)).withColumn("space", F.col("n_chars") - F.col("word_chars")).withColumn("symbol", F.col("n_symbols"))
    d = d.withColumn("other", F.length(r) - F.col("upper") - F.col("digit") - F.col("stop") - F.col("mark") - F.col("symbol"))
    times = lambda x: ((F.octet_length("common") - F.octet_length(F.replace("common", F.lit(f" {x} "), F.lit("")))) / (len(x.encode()) + 2)).cast("long")
    hist = F.array(*[times(x) for x in COMMON_WORDS], F.col("n_words") - F.col("n_common"))
    return d.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.array(*[F.col(c).cast("long") for c in CLASSES]).alias("classes"), hist.alias("common"), *(["text_hash"] if text_hash else []))


def jensen_shannon(p: Column, q: list[float]) -> Column:
    """Distance (square root of the divergence in bits) of an array of shares from fixed shares.

    Where one of two shares is 0, the other is twice their mean, so its part is the share itself: most words of a document
    are of one language, and need no logarithm.
    """
    def term(a: Column, b: Column) -> Column:
        m = (a + b) / 2
        part = lambda x: x * F.log2(x / m)
        return F.when(a == 0, b / 2).when(b == 0, a / 2).otherwise((part(a) + part(b)) / 2)

    total = F.aggregate(F.zip_with(p, F.array(*[F.lit(float(x)) for x in q]), term), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def references(shares: DataFrame) -> dict[str, dict[str, list[float]]]:
    """The central histogram of each reference language: a few numbers for each of four languages.

    It is the squared mean, over the language's documents that pass the base rules, of the square roots of their shares
    (the centre in Hellinger distance), so that a minority of junk with symbols or capitals hardly moves it.
    """
    n, m = len(CLASSES), len(COMMON_WORDS) + 1
    means = [F.avg(F.sqrt(F.col(c)[i])).alias(f"{c}{i}") for c, k in (("classes", n), ("common", m)) for i in range(k)]
    out = {}
    for r in shares.where(F.col("lang").isin(*LANGUAGES) & ~F.col("base_failed")).groupBy("lang").agg(*means).collect():
        square = lambda c, k: [r[f"{c}{i}"] ** 2 for i in range(k)]  # noqa: B023, E731
        out[r["lang"]] = {c: [x / sum(v) for x in v] for c, v in (("classes", square("classes", n)), ("common", square("common", m)))}
    return out


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", text_hash: bool = False) -> DataFrame:
    """Base counts and the verdict of each document.

    ``base_failed``: fewer than 50 words, or over half of the words in repeated 3-word windows. Else, a document is
    kept if the nearest language reference is within ``CLASS_DISTANCE + CLASS_DISTANCE_WORDS / n_words`` by character
    classes and, from ``MIN_COMMON_WORDS`` words on, within ``MAX_COMMON_DISTANCE`` by common words.
    References come from all documents of each language in the table; with none, only the base rules hold. A null text counts
    as empty; null, unknown or wrong languages don't matter to a document's verdict. Rows are judged one by one, so
    repeated rows and ids get a row each. ``text_hash`` adds a hash of the text, to find the row again.
    """
    feats = staged(features(docs, id_col, text_col, lang_col, text_hash), "quality")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    total = lambda c: F.greatest(F.aggregate(c, F.lit(0).cast("long"), lambda s, y: s + y), F.lit(1))
    # totals here and shares below are bound once: the optimizer would put them wherever they are used, for each element
    share = lambda c: F.get(F.transform(F.array(total(c)), lambda n: F.transform(c, lambda x: x / n)), F.lit(0))
    d = feats.withColumn("base_failed", failed).withColumn("classes", share("classes")).withColumn("common", share("common"))
    refs = references(d)
    distance = lambda kind: lambda p: F.array_min(F.array(*[F.round(jensen_shannon(p, r[kind]), 6) for r in refs.values()]))
    nearest = lambda kind: F.get(F.transform(F.array(F.col(kind)), distance(kind)), F.lit(0)) if refs else F.lit(0.0)
    d = d.withColumn("class_distance", nearest("classes")).withColumn("common_distance", nearest("common"))
    fits = (F.col("class_distance") <= CLASS_DISTANCE + CLASS_DISTANCE_WORDS / F.greatest(F.col("n_words"), F.lit(1))) & ((F.col("n_words") < MIN_COMMON_WORDS) | (F.col("common_distance") <= MAX_COMMON_DISTANCE))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & fits).alias("kept"), "class_distance", "common_distance", *(["text_hash"] if text_hash else []))


def keep_good(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns. The verdict depends on the text only."""
    verdicts = judge(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, text_hash=True)
    good = verdicts.where("kept").select("doc_id", "text_hash").distinct()
    return docs.join(good, docs[id_col].eqNullSafe(good["doc_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == good["text_hash"]), "left_semi")
