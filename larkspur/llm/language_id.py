"""Language identification by Bayesian evidence fusion.

Evidence for each language, added up as logarithms:

* the text: hashed byte-trigram naive Bayes, fitted on a bounded sample of each label's rows
  (the ones whose keys hash lowest; ``SAMPLE_ROWS`` in all, ``LABEL_ROWS`` a label at most and
  ``LEAST_LABELLED`` at least; a documented limit of the fit only), applied to whole texts.
  Labels are counted over all rows, so that each with enough of them is a class. The mean log-likelihood counts for at most ``WEIGHT``
  trigrams, since neighbouring trigrams aren't independent;
* the declared markup language, trusted as far as declarations agree with texts over all rows;
* the address: its country suffix or a language segment of its path;
* the host: a prior from text decisions over all rows, by grouped aggregation, smoothed
  towards the prior of the host's suffix, which is smoothed towards the prior of all rows.

Text likelihoods are computed once and kept in the shared checkpoint folder, a few numbers
a row; texts never shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import bound_batches, map_texts
from larkspur.llm.shared import cut_lineage, look_up

SAMPLE_ROWS = 4000
LABEL_ROWS = 1000  # Spark limits such groups before it shuffles them
LEAST_LABELLED = 5
BUCKETS = 1 << 16
WEIGHT = 200.0
SMOOTH = 20.0
LEAST_CONFIDENCE = 0.5
ADDRESS_TRUST = 0.8
SUFFIXES = {
    "en": ("uk", "us", "ie", "nz"), "de": ("de", "at"), "fr": ("fr",), "es": ("es", "mx", "ar", "cl", "co"), "it": ("it",),
    "pt": ("pt", "br"), "nl": ("nl",), "pl": ("pl",), "sv": ("se",), "da": ("dk",), "fi": ("fi",), "cs": ("cz",), "ru": ("ru",),
    "ja": ("jp",), "ko": ("kr",), "zh": ("cn", "tw"), "tr": ("tr",), "el": ("gr",), "hu": ("hu",),
}
CLASS = np.array([b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)], dtype=np.uint8)


def trigrams(text: str | None) -> np.ndarray:
    """Bucket of each byte trigram of the lower-cased letters, runs of anything else as one space."""
    data = CLASS[np.frombuffer((" " + (text or "").lower() + " ").encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    keep = np.ones(data.size, dtype=bool)
    keep[1:] = (data[1:] != 0x20) | (data[:-1] != 0x20)
    b = data[keep].astype(np.uint32)
    if b.size < 3:
        return np.zeros(0, dtype=np.int64)
    key = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    return ((key * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


class TextModel:
    """Log-probabilities of trigram buckets for each language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        total = counts.sum(axis=0, keepdims=True)
        self.table = np.log((counts + 0.5) / (total + 0.5 * BUCKETS)).astype(np.float32)

    def score(self, text: str | None) -> tuple[int, list[float]]:
        """Number of trigrams, and the weighted log-likelihood for each language (0 without letters)."""
        grams = trigrams(text)
        n = grams.size
        if not n:
            return 0, [0.0] * len(self.languages)
        total = np.zeros(len(self.languages))
        for start in range(0, n, 1 << 18):
            total += self.table[grams[start : start + (1 << 18)]].sum(axis=0, dtype=np.float64)
        return n, (total * (min(n, WEIGHT) / n)).tolist()


def fit(df: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int = SAMPLE_ROWS) -> TextModel:
    """Fit the text model on a sample of each label's keys; counts are summed in Spark.

    Rows with a null id, text or label are left out, and a table without any gives a model
    without languages; a repeated id counts with all its rows. The labels with ``LEAST_LABELLED`` of all rows (or as many as the most frequent has) share
    ``sample_rows`` evenly, with ``LEAST_LABELLED`` keys at least and ``LABEL_ROWS`` at most.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{label_col}`").cast("string").alias("l"), F.col(f"`{text_col}`").cast("string").alias("t"))
    rows = rows.where("i is not null and l is not null and t is not null")
    bound_batches(df.sparkSession)
    sizes = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    languages = sorted(x for x, n in sizes.items() if n >= min(LEAST_LABELLED, max(sizes.values())))
    most = max(LEAST_LABELLED, min(LABEL_ROWS, sample_rows // max(1, len(languages))))
    # A frequent label's keys are thinned by their hash to about twice the sample, so that no task ranks a third of all rows.
    share = F.lit(1.0)
    for language in languages:
        share = F.when(F.col("l") == language, F.lit(min(1.0, 2 * most / sizes[language]))).otherwise(share)
    keys = rows.where(F.col("l").isin(languages)).select("l", "i", F.xxhash64("i").alias("h"))
    keys = keys.where(F.shiftrightunsigned("h", 1) / F.lit(float(1 << 63)) < share).distinct()
    keys = keys.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h", "i")))
    keys = keys.where(F.col("r") <= most).select("l", "i")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(label, np.zeros(BUCKETS, dtype=np.int64))
                held[label] += np.bincount(trigrams(text), minlength=BUCKETS)
        for label, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"l": [label] * at.size, "b": at.tolist(), "n": counts[at].tolist()})

    counted = rows.join(F.broadcast(keys), ["l", "i"], "left_semi").select("l", "t").mapInArrow(count, "l string, b bigint, n bigint")
    counted = counted.groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows a language
    table = np.zeros((BUCKETS, len(languages)))
    for i, language in enumerate(languages):
        own = counted[counted.l == language]
        table[own.b.to_numpy(), i] = own.n.to_numpy()
    return TextModel(languages, table)


def host_of(url: Column) -> Column:
    """The lower-case host of an address, empty if it has none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def address_language(url: Column, languages: list[str]) -> Column:
    """The language that an address names by a path segment or its country suffix, else null."""
    text = F.lower(F.coalesce(url.cast("string"), F.lit("")))
    segment = F.regexp_extract(text, r"^[a-z][a-z0-9+.\-]*://[^/?#]+/([a-z]{2})(?:[/\-_?#]|$)", 1)
    suffix = F.regexp_extract(host_of(url), r"\.([a-z]+)$", 1)
    out = F.when(segment.isin(languages), segment) if languages else F.lit(None).cast("string")
    for language in languages:
        if ends := SUFFIXES.get(language):
            out = out.when(suffix.isin(*ends), F.lit(language))
    return out


def markup_language(html: Column) -> Column:
    """The primary language that the html element declares, else null."""
    found = F.lower(F.regexp_extract(F.coalesce(html.cast("string"), F.lit("")), r"(?is)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    return F.when(found != "", found)


def identify(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang",
    host_col: str | None = "source", url_col: str | None = None, model: TextModel | None = None,
    least_confidence: float = LEAST_CONFIDENCE, html_col: str | None = None,
) -> DataFrame:
    """(id, language, text_language, confidence, n_trigrams, kept): one row per input row.

    ``confidence`` is the posterior of the chosen language; ties go to the first language in
    alphabetical order. A row is kept if its text has letters, the confidence reaches
    ``least_confidence`` and the text's own language explains its trigrams better than noise
    (equal probabilities of all buckets) does; text in no language of the labels is rejected so. Null, empty and letterless texts have null languages, confidence 0
    and aren't kept. Missing declarations, hosts and addresses are no evidence; null hosts
    share the prior of all rows. With ``html_col`` its markup declares the language where no
    ``declared_col`` does, and its main text is read if it is the text column. Repeated rows get equal results, an empty table or one without labels
    keeps nothing, other columns are ignored.
    """
    if model is None:
        model = fit(df, id_col, text_col, declared_col)
    languages, none = model.languages, F.lit(None).cast("string")
    rows = df.select(
        F.col(f"`{id_col}`").alias("i"),
        F.coalesce(
            F.lower(F.col(f"`{declared_col}`").cast("string")) if declared_col else none,
            markup_language(F.col(f"`{html_col}`")) if html_col else none,
        ).alias("declared"),
        (F.col(f"`{host_col}`").cast("string") if host_col else host_of(F.col(f"`{url_col}`")) if url_col else none).alias("host"),
        (address_language(F.col(f"`{url_col}`"), languages) if url_col else none).alias("address"),
        (F.regexp_extract(host_of(F.col(f"`{url_col}`")), r"\.([a-z]+)$", 1) if url_col else F.lit("")).alias("suffix"),
        F.col(f"`{text_col}`").alias("t"),
    )

    def kernel():
        from larkspur.llm.html_extract import extract_page  # which imports this module

        def apply(texts: list) -> dict:
            made = [model.score(extract_page(t, None) if text_col == html_col else t) for t in texts]
            return {"n": [n for n, _ in made], "ll": [ll for _, ll in made]}

        return apply

    scored = map_texts(rows, ["i", "declared", "host", "address", "suffix"], "t", kernel, [("n", "bigint"), ("ll", "array<double>")])
    if not languages:
        return scored.select(
            F.col("i").alias(id_col), none.alias("language"), none.alias("text_language"), F.lit(0.0).alias("confidence"),
            F.col("n").alias("n_trigrams"), F.lit(False).alias("kept"),
        )
    names = F.array(*map(F.lit, languages))
    best = F.when(F.col("n") > 0, F.element_at(names, F.array_position("ll", F.array_max("ll")).cast("int")))
    scored = cut_lineage(scored.withColumn("own", best))

    tally = [F.count_if(F.col("own") == x).cast("double").alias(f"c{i}") for i, x in enumerate(languages)]
    overall = scored.agg(*tally, F.count_if(F.expr("own = declared")).alias("agree"), F.count_if(F.expr("own is not null and declared is not null")).alias("both")).first()
    total = sum(overall[f"c{i}"] for i in range(len(languages)))
    trust = min(0.98, (overall["agree"] + 1) / (overall["both"] + 2))
    whole = [(overall[f"c{i}"] + 1) / (total + len(languages)) for i in range(len(languages))]

    def prior(level: str, counts: DataFrame, above: list[Column]) -> DataFrame:
        """Counts of a level as probabilities smoothed towards those of the level above."""
        n = sum((F.col(f"c{i}") for i in range(len(languages))), F.lit(0.0))
        return counts.select(*[c for c in ("host", "suffix") if c in counts.columns], *[((F.col(f"c{i}") + SMOOTH * p) / (n + SMOOTH)).alias(f"{level}{i}") for i, p in enumerate(above)])

    hosts = scored.where("host is not null").groupBy("host", "suffix").agg(*tally)
    suffixes = hosts.groupBy("suffix").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(languages))])
    suffixes = prior("s", suffixes, [F.lit(p) for p in whole])
    hosts = hosts.join(suffixes, "suffix")
    hosts = prior("p", hosts, [F.col(f"s{i}") for i in range(len(languages))])
    fused = look_up(scored, hosts, ["host", "suffix"], "i")

    rest = max(1, len(languages) - 1)

    def named(column: str, language: str, sure: float) -> Column:
        known = F.col(column).isin(languages)
        return F.when(F.col(column) == language, F.lit(float(np.log(sure)))).when(known, F.lit(float(np.log(max(1e-6, (1 - sure) / rest))))).otherwise(F.lit(0.0))

    logs = [
        F.get("ll", F.lit(i)) + F.log(F.coalesce(F.col(f"p{i}"), F.lit(whole[i]))) + named("declared", x, trust) + named("address", x, ADDRESS_TRUST)
        for i, x in enumerate(languages)
    ]
    noise = F.array_max("ll") < F.least(F.col("n").cast("double"), F.lit(WEIGHT)) * float(-np.log(BUCKETS))
    fused = fused.select("i", "own", "n", noise.alias("noise"), F.array(*logs).alias("logs")).withColumn("top", F.array_max("logs"))
    chosen = F.element_at(names, F.array_position("logs", F.col("top")).cast("int"))
    share = F.lit(1.0) / F.aggregate("logs", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top")))
    return fused.select(
        F.col("i").alias(id_col),
        F.when(F.col("n") > 0, chosen).alias("language"),
        F.col("own").alias("text_language"),
        F.when(F.col("n") > 0, F.round(share, 6)).otherwise(0.0).alias("confidence"),
        F.col("n").alias("n_trigrams"),
        ((F.col("n") > 0) & ~F.col("noise") & (share >= least_confidence)).alias("kept"),
    )
