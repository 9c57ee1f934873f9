"""Quality rules by distribution divergence, in built-in functions only.

A document is described by two histograms: its characters by class and its words by common word of its
language.  The reference of a language is the mean histogram of its documents that pass the base rules,
each counting alike, so one long or repeated document does not move it.  A document far from the
reference of its language, by Jensen-Shannon distance (0 equal, 1 disjoint), is rejected.  Short
histograms are noisy and are not judged.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from listwatch.llm.common import staged

SPACE = r"\x20\x09-\x0D"
#: Character classes; symbols, white space and the rest (lower-case letters mostly) are counted besides.
CLASSES = ("A-Z", "0-9", r".,;:!?'\"()\-", r"^\x00-\x7F")
#: The most frequent function words of a language.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "was", "for", "on", "are", "as", "with", "at", "be", "this",
           "have", "from", "or", "by", "an", "not"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht",
           "ein", "eine", "als", "auch", "es", "an", "werden"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus",
           "pas", "au", "sur", "ne", "se", "ce"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es",
           "al", "lo", "como", "más", "o"),
}


def with_repeat_words(rows: DataFrame) -> DataFrame:
    """``n_repeat_words`` for ``words``: words inside 3-word windows that occur twice or more in the text.

    Every window is its hash and its place.  Sorted, equal windows are neighbours; neighbours with one hash are
    compared word by word.  The steps are columns of their own, so none is evaluated per element.
    """
    windows = F.transform(F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))), lambda w, i: F.struct(
        F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("at")))
    rows = rows.withColumn("_windows", F.sort_array(windows))

    def equal(x: Column, y: Column) -> Column:
        found = x["h"] == y["h"]
        for k in range(3):
            found = found & (F.get("words", x["at"] + k) == F.get("words", y["at"] + k))
        return found

    after = F.slice("_windows", 2, F.greatest(F.size("_windows"), F.lit(1)))
    # Both of each two equal neighbours; the last element has none after it.
    pairs = F.zip_with("_windows", after, lambda x, y: F.when(equal(x, y), F.array(x["at"], y["at"])))
    rows = rows.withColumn("_pairs", F.filter(pairs, lambda p: p.isNotNull()))
    inside = F.transform(F.flatten("_pairs"), lambda x: F.array(*[x + k for k in range(3)]))
    rows = rows.withColumn("n_repeat_words", F.size(F.array_distinct(F.flatten(inside))).cast("long"))
    return rows.drop("_windows", "_pairs")


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of shares."""
    term = F.zip_with(p, q, lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
                      + F.when(b > 0, b * F.log2(2 * b / (a + b))).otherwise(F.lit(0.0)))
    total = F.aggregate(term, F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


@dataclass(frozen=True)
class Divergence:
    """Base rules and distribution verdict per document.

    Null and empty texts have no words and fail the base rules.  A null or unknown language, or one
    with fewer than ``least_docs`` documents behind its reference, has no reference: the base rules
    decide alone.  Ids may be null or repeated; every row is judged for itself.  Other columns are ignored.
    """

    class_limit: float = 0.30
    word_limit: float = 0.30
    least_words: int = 100
    least_chars: int = 300
    least_docs: int = 20
    id: str = "doc_id"
    text: str = "text"
    lang: str = "lang"

    def measure(self, docs: DataFrame) -> DataFrame:
        """Counts and histograms of every row."""
        text = F.coalesce(F.col(self.text), F.lit(""))
        rows = docs.select(F.col(self.id).alias("id"), F.col(self.lang).alias("lang"), text.alias("text"))
        rows = rows.withColumns({"words": F.array_remove(F.split("text", f"[{SPACE}]+"), ""),
                                 "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))})
        rows = with_repeat_words(rows)
        common = sorted({w for words in COMMON.values() for w in words})
        known = F.array_join(F.filter("words", lambda w: w.isin(*common)), "  ")
        rows = rows.withColumn("known", F.concat(F.lit(" "), known, F.lit(" ")))
        lists = F.create_map(*[x for k, v in COMMON.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
        length = F.length("text")
        counts = [length - F.length(F.regexp_replace("text", f"[{c}]+", "")) for c in CLASSES]
        # Every known word between two spaces of its own: what replacing one shortens the string by gives its count.
        bytes_ = F.octet_length
        counted = lambda c: ((bytes_("known") - bytes_(F.replace("known", F.concat(F.lit(" "), c, F.lit(" ")))))
                             / (bytes_(c) + 2)).cast("int")
        rows = rows.select(
            "id", "lang", F.size("words").cast("long").alias("n_words"),
            F.length(F.regexp_replace("text", f"[{SPACE}]+", "")).cast("long").alias("word_chars"), length.alias("n_chars"),
            F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            "n_repeat_words", F.array(*counts).alias("classes"),
            F.transform(lists[F.col("lang")], counted).alias("common"))
        total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
        space = (F.col("n_chars") - F.col("word_chars")).cast("int")
        rows = rows.withColumns({
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "classes": F.concat("classes", F.array(F.col("n_symbols").cast("int"), space,
                                                   F.col("n_chars") - space - F.col("n_symbols").cast("int") - total(F.col("classes")))),
            "common": F.concat("common", F.array(F.col("n_words").cast("int") - total(F.col("common"))))})
        shares = lambda a, n: F.transform(a, lambda x: x / F.greatest(n, F.lit(1)))
        return rows.withColumns({"classes": shares(F.col("classes"), F.col("n_chars")),
                                 "common": shares(F.col("common"), F.col("n_words"))})

    def references(self, measured: DataFrame) -> DataFrame:
        """lang, ref_classes, ref_common: mean shares of the documents that pass the base rules."""
        bins = len(CLASSES) + 3, max(map(len, COMMON.values())) + 1
        sound = measured.where(~F.col("base_failed") & F.col("common").isNotNull())
        means = [[F.avg(F.get(a, F.lit(i))).alias(f"{a}{i}") for i in range(n)] for a, n in zip(("classes", "common"), bins)]
        refs = sound.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *means[0], *means[1]).where(F.col("n") >= self.least_docs)
        array = lambda a, n: F.array(*[F.coalesce(F.col(f"{a}{i}"), F.lit(0.0)) for i in range(n)])
        return refs.select("lang", array("classes", bins[0]).alias("ref_classes"), array("common", bins[1]).alias("ref_common"))

    def judge(self, docs: DataFrame) -> DataFrame:
        """Counts, base_failed, class_distance, word_distance (null: not judged) and kept per row."""
        measured = staged(self.measure(docs), "measures")
        # One row per language that has common words.
        rows = measured.join(self.references(measured), "lang", "left")
        judged = F.col("n_chars") >= self.least_chars
        rows = rows.withColumns({
            "class_distance": F.when(judged, distance(F.col("classes"), F.col("ref_classes"))),
            "word_distance": F.when(F.col("n_words") >= self.least_words, distance(F.col("common"), F.col("ref_common")))})
        far = (F.coalesce(F.col("class_distance") > self.class_limit, F.lit(False))
               | F.coalesce(F.col("word_distance") > self.word_limit, F.lit(False)))
        return rows.select(F.col("id").alias(self.id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                           "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "class_distance", "word_distance")
