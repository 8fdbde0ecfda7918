"""Language identification by Bayesian evidence fusion.

Four sources of evidence meet in one posterior: the likelihood of the text's letter trigrams, the language
that the markup declares, and the prior of the host, smoothed towards that of its address suffix, which is
smoothed towards that of the whole table. How far a declaration can be trusted and what a host writes in
are not assumed but counted: grouped sums of the posteriors that the texts alone give.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, whole_text, without

#: Trigram buckets of the text model.
BUCKETS = 1 << 15
#: Labelled documents of each language from which the text model learns, at most: those with the smallest hashes of id and text.
SAMPLE_DOCS = 4000
#: Weight of a trigram's log likelihood: neighbours overlap, so they aren't independent evidence.
TEMPER = 0.3
#: Pseudo-counts of the parent prior at a suffix and at a host.
SUFFIX_WEIGHT, HOST_WEIGHT = 20.0, 5.0
UNKNOWN = "und"

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def trigram_buckets(text: str | None) -> np.ndarray:
    """Buckets of the byte trigrams of the text's words, lower-cased, one space around each."""
    words = (text or "").lower().encode().translate(_LETTERS).split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    b = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8).astype(np.uint32)
    return (
        (
            b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)
        ) >> np.uint32(17)
    ).astype(np.int64)


@dataclass(frozen=True)
class TextModel:
    """Log probability of each bucket (rows) in each language (columns); the last column is the unknown language."""

    languages: list[str]
    table: np.ndarray

    def evidence(self, text: str | None) -> tuple[np.ndarray, int]:
        """(tempered log likelihoods, number of trigrams)."""
        at = trigram_buckets(text)
        total = np.zeros(self.table.shape[1])
        for k in range(0, len(at), 1 << 20):
            total += self.table[at[k:k + (1 << 20)]].sum(0, dtype=np.float64)
        return TEMPER * total, len(at)


def fit_text_model(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample_docs: int = SAMPLE_DOCS, least_docs: int = 5
) -> TextModel:
    """Smoothed trigram frequencies of the languages with ``least_docs`` labelled documents, counted over all rows.

    Each language has a sample of its own, bounded by ``sample_docs``, so that a rare one is learnt at every
    size of the table. Labels count by their primary subtag. Rows without label or text are passed over; with
    nothing to learn from, every text is unknown.
    """
    usable = labelled.filter(F.col(lang_col).isNotNull() & (F.length(whole_text(text_col)) > 0))
    usable = usable.select(
        primary_subtag(F.col(lang_col)).alias("lang"), F.col(text_col).alias("text"),
        F.xxhash64(id_col, text_col).alias("_hash")
    )
    sizes = durable(
        usable.groupBy("lang").agg(F.count("*").alias("_n")).filter(
            (F.col("_n") >= least_docs) & ~F.col("lang").isin("", UNKNOWN)
        ),
        "language-sizes"
    )
    # hashes are uniform, so this share holds the sample but for a chance below one in a billion, and few rows beyond it
    share = F.lit(2.0**64 * (sample_docs + 6 * sample_docs**0.5 + 50)) / F.col("_n")
    near = usable.select("lang", "_hash").join(F.broadcast(sizes), "lang").filter(
        F.col("_hash").cast("double") + F.lit(2.0**63) <= share
    )
    last = near.withColumn(
        "_k", F.row_number().over(Window.partitionBy("lang").orderBy("_hash"))
    ).filter(F.col("_k") <= sample_docs).groupBy("lang").agg(F.max("_hash").alias("_last"))
    rows = usable.join(
        F.broadcast(durable(last, "language-samples")), "lang"
    ).filter(F.col("_hash") <= F.col("_last")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, np.ndarray] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                own = sums.setdefault(lang, np.zeros(BUCKETS + 1, dtype=np.int64))
                own[:BUCKETS] += np.bincount(trigram_buckets(text), minlength=BUCKETS)
                own[BUCKETS] += 1  # the number of documents
            for lang, n in sums.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])],
                    names=["lang", "bucket", "n"]
                )

    counted = rows.mapInArrow(
        count, "lang string, bucket int, n long"
    ).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    labels = counted.column("lang").combine_chunks().dictionary_encode()
    table = np.zeros((len(labels.dictionary), BUCKETS + 1))
    table[labels.indices.to_numpy(), counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    sums = dict(zip(labels.dictionary.to_pylist(), table))
    languages = sorted(sums)
    columns = [np.log((sums[x][:BUCKETS] + 0.05) / (sums[x][:BUCKETS].sum() + 0.05 * BUCKETS)) for x in languages]
    return TextModel(
        [*languages, UNKNOWN], np.stack([*columns, np.full(BUCKETS, -np.log(BUCKETS))], axis=1).astype(np.float32)
    )


def primary_subtag(tag: Column) -> Column:
    """``en`` of ``en-GB`` or ``EN_us``; null stays null."""
    return F.lower(F.regexp_extract(F.trim(tag), r"^([A-Za-z]*)", 1))


def url_host(url: Column) -> Column:
    """The host of an address, lower-cased; empty if there is none."""
    return F.coalesce(
        F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit("")
    )


_OPENS = re.compile(r"(?i)<!--|<(script|style)\b")
_CLOSES = {"": re.compile("-->"), "script": re.compile(r"(?i)</script\s*>"), "style": re.compile(r"(?i)</style\s*>")}
_PAGE = re.compile(r"(?i)<html\b([^>]*)")
_DECLARED = re.compile(r"""(?i)\blang\s*=\s*["']?([A-Za-z]+)""")


def _shown(page: str) -> str:
    """The page without scripts, styles and comments; what is opened and never closed stays. One pass: no end is looked for twice."""
    parts, at, scan, endless = [], 0, 0, set()
    while opened := _OPENS.search(page, scan):
        kind, scan = (opened[1] or "").lower(), opened.end()
        closed = None if kind in endless else _CLOSES[kind].search(page, scan)
        if closed is None:
            endless.add(kind)
            continue
        parts += [page[at:opened.start()], " "]
        at = scan = closed.end()
    return "".join([*parts, page[at:]])


def visible_text(page: str) -> str:
    """The text between a page's tags, without scripts, styles and comments."""
    page, parts, at = _shown(page), [], 0
    while (start := page.find("<", at)) >= 0 and (end := page.find(">", start)) >= 0:
        parts.append(page[at:start])
        at = end + 1
    return html.unescape(" ".join([*parts, page[at:]]))


def declared_language(page: str) -> str | None:
    """The language that the first html tag with one declares."""
    return next((m[1] for tag in _PAGE.finditer(page) if (m := _DECLARED.search(tag[1]))), None)


def page_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(_id, _text, _declared, _host) of web pages. Null pages are empty, repeated ones stay, other columns are ignored."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("html").to_pylist()
            declared = [declared_language(x) for x in raw]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"), pa.array([visible_text(x) for x in raw], pa.string()),
                    pa.array(declared, pa.string()), batch.column("_host")
                ],
                names=["_id", "_text", "_declared", "_host"]
            )

    rows = pages.select(
        F.col(id_col).cast("long").alias("_id"), whole_text(html_col).alias("html"),
        url_host(F.col(url_col)).alias("_host")
    )
    return rows.mapInArrow(read, "_id long, _text string, _declared string, _host string")


def document_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """(_id, _text, _declared, _host) of documents: the label is what they declare, the source their host."""
    return docs.select(
        F.col(id_col).cast("long").alias("_id"), whole_text(text_col).alias("_text"),
        F.col(lang_col).cast("string").alias("_declared"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_host")
    )


def identify(rows: DataFrame, model: TextModel, least_confidence: float = 0.5) -> DataFrame:
    """Every row's language: ``_id``, ``language``, ``confidence``, ``accepted``, ``text_language``, ``declared``, ``host``, ``row_hash``.

    ``rows`` are those of ``page_rows`` or ``document_rows``. ``language`` is the most probable one; a row is
    accepted when that isn't the unknown language, its posterior is ``least_confidence`` or more and the text
    has letters. Without letters the other evidence decides the language, and the row isn't accepted.
    Ties go to the first language in the alphabet. Repeated rows each get the same result; an empty table gives none.
    """
    languages, shared = model.languages, rows.sparkSession.sparkContext.broadcast(model)
    n = len(languages)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.evidence(t.as_py()) for t in batch.column("_text")]
            logs = [x - x.max() for x, _ in found]
            alone = [np.exp(x) / np.exp(x).sum() for x in logs]
            yield pa.RecordBatch.from_arrays([
                *(
                    batch.column(c) for c in ("_id", "_declared", "_host", "_suffix", "_row")
                ), pa.array(logs, pa.list_(pa.float64())), pa.array(alone, pa.list_(pa.float64())), pa.array([k for _, k in found], pa.int64()),
            ], names=["_id", "_declared", "_host", "_suffix", "_row", "_logs", "_alone", "_trigrams"])

    declared = primary_subtag(F.col("_declared"))
    known = F.when(
        declared.isNull() | (declared == ""), "none"
    ).when(declared.isin(languages[:-1]), declared).otherwise("other")
    suffix = F.regexp_extract("_host", r"\.([A-Za-z]+)$", 1)
    prepared = rows.select(
        "_id", "_text", known.alias("_declared"), "_host", suffix.alias("_suffix"), F.xxhash64("_text").alias("_row")
    )
    seen = durable(
        prepared.mapInArrow(
            read,
            "_id long, _declared string, _host string, _suffix string, _row long, _logs array<double>, _alone array<double>, _trigrams long"
        ),
        "language-evidence"
    )

    # texts without letters tell nothing of their host
    sums = [F.sum(F.when(F.col("_trigrams") > 0, F.get("_alone", k)).otherwise(0.0)).alias(f"n{k}") for k in range(n)]
    again = [F.sum(f"n{k}").alias(f"n{k}") for k in range(n)]
    by_host = durable(  # combined before the shuffle
        seen.groupBy("_host", "_suffix", "_declared").agg(*sums), "language-sums"
    )
    counts = lambda row: np.array([row[f"n{k}"] or 0.0 for k in range(n)])
    tables = {  # a row per language, "none" and "other"
        r["_declared"]: counts(r) for r in by_host.groupBy("_declared").agg(*again).collect()
    }
    total = sum(tables.values(), np.zeros(n))
    overall = (total + 1) / (total + 1).sum()
    said = {d: c for d, c in tables.items() if d != "none"}
    spoken = sum(said.values(), np.zeros(n))
    given = {  # no declaration is no evidence
        d: np.log((c + 0.5) / (spoken + 0.5 * len(said))) for d, c in said.items()
    } | {"none": np.zeros(n)}
    log_given = F.create_map(*[x for d, v in given.items() for x in (F.lit(d), F.array(*map(F.lit, v.tolist())))])

    def smoothed(parent: list[Column], weight: float) -> list[Column]:
        size = sum((F.col(f"n{k}") for k in range(1, n)), F.col("n0"))
        return [(F.col(f"n{k}") + weight * parent[k]) / (size + weight) for k in range(n)]

    by_suffix = by_host.groupBy("_suffix").agg(*again)
    by_suffix = by_suffix.select(
        "_suffix", F.array(*smoothed([F.lit(float(x)) for x in overall], SUFFIX_WEIGHT)).alias("_parent")
    )
    hosts = by_host.groupBy("_host", "_suffix").agg(*again).join(by_suffix, "_suffix")
    priors = durable(
        hosts.select("_host", F.array(*smoothed([F.get("_parent", k) for k in range(n)], HOST_WEIGHT)).alias("_prior")),
        "host-priors"
    )

    joined = seen.join(priors, "_host").withColumn("_given", log_given[F.col("_declared")])
    score = F.array(*[F.get("_logs", k) + F.log(F.get("_prior", k)) + F.get("_given", k) for k in range(n)])
    scored = joined.withColumn("_score", score).withColumn("_best", F.array_max("_score"))
    names = F.array(*map(F.lit, languages))
    pick = lambda a: F.get(names, F.array_position(a, F.array_max(a)).cast("int") - 1)
    confidence = 1 / F.aggregate("_score", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("_best")))
    out = scored.select(
        "_id", pick(F.col("_score")).alias("language"), confidence.alias("confidence"), F.when(
            F.col("_trigrams") > 0, pick(F.col("_alone"))
        ).alias("text_language"),
        F.col("_declared").alias("declared"), F.col("_host").alias("host"), "_trigrams", F.col("_row").alias("row_hash"))
    accepted = (F.col("_trigrams") > 0) & (F.col("language") != UNKNOWN) & (F.col("confidence") >= least_confidence)
    return out.withColumn("accepted", accepted).drop("_trigrams")


def keep_identified(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """The rows of ``docs`` whose language is accepted, with all their columns. The text model is fitted on their own labels."""
    found = identify(
        document_rows(docs, id_col, text_col, lang_col, source_col), fit_text_model(docs, id_col, text_col, lang_col)
    )
    rejected = durable(found.filter(~F.col("accepted")).select("_id", "row_hash"), "language-rejects")
    return without(docs, [F.col(id_col).cast("long"), F.xxhash64(whole_text(text_col))], rejected)
