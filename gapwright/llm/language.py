"""Languages of web pages by Bayesian evidence fusion (operator 1).

Four kinds of evidence add up as log odds: the text's likelihood under byte trigram models, the language that the markup
declares, the address suffix, and a host prior that is shrunk to its domain's and that to the global one. The last three
come from the corpus itself by grouped sums of text posteriors; a page's own posterior is taken out of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _kernels as K
from ._workspace import materialise

#: Buckets of hashed trigrams, and a trigram's pseudo-count.
BUCKETS, ALPHA = 1 << 16, 0.5
#: Trigrams of a text that count as independent; longer texts are no surer than texts of so many.
EFFECTIVE = 60
#: Pseudo-counts of the parent's distribution: for a declared language or suffix, for a host and for a domain.
K_SIGN, K_HOST, K_DOMAIN = 5.0, 10.0, 20.0
#: Languages of a model at most, as every task holds the whole model.
MOST_LANGUAGES = 500


@dataclass(frozen=True)
class Model:
    """Languages and for each a row of log probabilities of the trigram buckets."""

    languages: tuple[str, ...]
    logp: np.ndarray


def _buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of the trigram that starts at each byte but the last two."""
    x = data.astype(np.uint32)
    h = (x[:-2] | (x[1:-1] << np.uint32(8)) | (x[2:] << np.uint32(16))) * np.uint32(2654435761)
    return (h >> np.uint32(16)).astype(np.int64)


def _spread(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last trigram of each text."""
    first = offsets[:-1]
    return first, np.maximum(offsets[1:] - 2, first)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts the trigrams of all docs by language. Null languages and texts add nothing; no docs give no languages.

    Each task sums up its own counts, so what is shuffled is bounded by languages times buckets. More than
    MOST_LANGUAGES languages are refused before anything comes to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets = K.text_bytes(batch.column("_text"))
            names = np.array(batch.column("_lang").to_pylist(), dtype=object)
            for i, j in K.chunks(offsets):
                part = data[offsets[i] : offsets[j]]
                if len(part) < 3:
                    continue
                bucket = _buckets(part)
                first, last = _spread(offsets[i : j + 1] - offsets[i])
                own: dict[str, list[np.ndarray]] = {}
                for k, name in enumerate(names[i:j]):
                    if last[k] > first[k]:
                        own.setdefault(name, []).append(bucket[first[k] : last[k]])
                for name, parts in own.items():
                    sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                    sums[name] += np.bincount(np.concatenate(parts), minlength=BUCKETS)
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "bucket", "n"])

    source = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("_lang"), F.lower(text_col).alias("_text"))
    table = materialise(source.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    if table.select("lang").distinct().count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} declared languages")
    rows = table.toPandas()
    languages = tuple(sorted(rows["lang"].unique()))
    counts = np.full((len(languages), BUCKETS), ALPHA)
    np.add.at(counts, (np.searchsorted(np.array(languages, dtype=object), rows["lang"].to_numpy(dtype=object)), rows["bucket"].to_numpy(np.int64)), rows["n"].to_numpy(np.float64))
    return Model(languages, np.log(counts / counts.sum(axis=1, keepdims=True)) if languages else counts)


def visible_text(html: Column) -> Column:
    """The text of a page without scripts, styles, comments, tags and entities, in lower case."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^<>]*+>|&#?[A-Za-z0-9]{1,10};", " "), r"\s++", " ")))


def signs(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, declared, suffix, host, domain, _text): what a page's markup and address say; absent is null or ''."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    declared = F.regexp_extract(html, r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b", 1)
    host = F.lower(F.coalesce(F.try_parse_url(F.col(url_col), F.lit("HOST")), F.lit("")))
    return pages.select(F.col(id_col), F.lower(declared).alias("declared"), F.substring_index(host, ".", -1).alias("suffix"), host.alias("host"), F.substring_index(host, ".", -2).alias("domain"), visible_text(html).alias("_text"))


def text_scores(told: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """(*keep, ll_0, ll_1, ..): log likelihoods by language, over EFFECTIVE trigrams at most; 0 for texts of under 3 bytes."""
    kinds = ", ".join(f"`{c}` {told.schema[c].dataType.simpleString()}" for c in keep)
    n_langs, logp = len(model.languages), model.logp.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column("_text"))
            out = np.zeros((batch.num_rows, n_langs))
            for i, j in K.chunks(offsets):
                part = data[offsets[i] : offsets[j]]
                if len(part) < 3:
                    continue
                bucket = _buckets(part)
                first, last = _spread(offsets[i : j + 1] - offsets[i])
                first, last = np.minimum(first, len(bucket)), np.minimum(last, len(bucket))
                n = np.maximum(last - first, 0)
                for k in range(n_langs):
                    sums = np.concatenate([[0.0], np.cumsum(logp[k][bucket], dtype=np.float64)])
                    out[i:j, k] = (sums[last] - sums[first]) / np.maximum(n, 1) * np.minimum(n, EFFECTIVE)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(out[:, k]) for k in range(n_langs))], names=[*keep, *(f"ll_{k}" for k in range(n_langs))])

    return told.select(*keep, "_text").mapInArrow(run, ", ".join([kinds, *(f"ll_{k} double" for k in range(n_langs))]))


def _softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    raised = [F.exp(s - top) for s in scores]
    total = sum(raised[1:], raised[0])
    return [r / total for r in raised]


def _sums(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(f"n_{key}"), *(F.sum(f"t_{k}").alias(f"{key}_{k}") for k in range(n)))


def identify(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, lang, probability, text_lang, declared, suffix, host): one row for each page.

    Null html is empty and decides by address and prior; null or unreadable addresses form the host ''; an undeclared
    language is ''. Ties go to the first language by name; repeated rows are judged alike; other columns are not read;
    an empty table gives no rows, a model without languages null ones.
    """
    n, keep = len(model.languages), [id_col, "declared", "suffix", "host", "domain"]
    told = signs(pages, id_col, url_col, html_col)
    if not n:
        return told.select(id_col, F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"), "declared", "suffix", "host")
    scored = text_scores(told, model, keep)
    own = _softmax([F.col(f"ll_{k}") for k in range(n)])
    scored = materialise(scored.select(*keep, *(F.col(f"ll_{k}") for k in range(n)), *(t.alias(f"t_{k}") for k, t in enumerate(own))), "text-scores")
    world = scored.agg(*(F.avg(f"t_{k}") for k in range(n))).first()
    if world[0] is None:
        return scored.select(id_col, F.lit("").alias("lang"), F.lit(0.0).alias("probability"), F.lit("").alias("text_lang"), "declared", "suffix", "host")
    g = [max(x, 1e-6) for x in world]
    hosts = materialise(scored.groupBy("host", "domain").agg(F.count("*").alias("n_host"), *(F.sum(f"t_{k}").alias(f"host_{k}") for k in range(n))), "hosts")
    domains = hosts.groupBy("domain").agg(F.sum("n_host").alias("n_domain"), *(F.sum(f"host_{k}").alias(f"domain_{k}") for k in range(n)))
    out = scored.join(hosts.join(domains, "domain").drop("domain"), "host").join(_sums(scored, "declared", n), "declared").join(_sums(scored, "suffix", n), "suffix")
    scores = []
    for k in range(n):
        t, c = F.col(f"t_{k}"), lambda key, k=k: F.greatest(F.col(f"{key}_{k}") - F.col(f"t_{k}"), F.lit(0.0))
        domain = (c("domain") + K_DOMAIN * g[k]) / (F.col("n_domain") - 1 + K_DOMAIN)
        prior = (c("host") + K_HOST * domain) / (F.col("n_host") - 1 + K_HOST)
        score = F.col(f"ll_{k}") + F.log(prior)
        for key in ("declared", "suffix"):
            ratio = F.log((c(key) + K_SIGN * g[k]) / (F.col(f"n_{key}") - 1 + K_SIGN) / g[k])
            score = score + F.when(F.col(key) == "", 0.0).otherwise(ratio)
        scores.append(score)

    def best(values: list[Column]) -> Column:
        names = F.array(*map(F.lit, model.languages))
        array = F.array(*values)
        return F.element_at(names, F.array_position(array, F.array_max(array)).cast("int"))

    final = _softmax(scores)
    out = out.select(*keep, *(p.alias(f"p_{k}") for k, p in enumerate(final)), *(f"t_{k}" for k in range(n)))
    return out.select(id_col, best([F.col(f"p_{k}") for k in range(n)]).alias("lang"), F.array_max(F.array(*(F.col(f"p_{k}") for k in range(n)))).alias("probability"), best([F.col(f"t_{k}") for k in range(n)]).alias("text_lang"), "declared", "suffix", "host")
