"""Language identification by Bayesian evidence fusion.

Byte n-gram likelihoods of the text are combined with the language that the markup declares, the address's suffix, and a
prior of the host, which is smoothed by its domain's and that by all hosts'. The priors are sums of text posteriors,
computed by grouped aggregation, without the row that they are for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm.scratch import written
from ledgerleaf.llm.textbytes import LOWER_ASCII, pieces

# Languages of country suffixes.
SUFFIX_LANGUAGE = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "cl": "es", "co": "es", "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en", "it": "it", "nl": "nl", "pt": "pt", "br": "pt", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh", "in": "en"}

TRIPLES = 1 << 19
_LETTERS = LOWER_ASCII.copy()
_LETTERS[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


@dataclass
class Settings:
    sample: int = 600  # labelled texts of a language that the n-grams are learned from, about
    weigh: int = 150  # bytes at which a text's likelihood stops growing: n-grams of a text aren't independent
    strength: float = 5.0  # rows that the prior of a level weighs in the next
    declared_right: float = 0.9
    suffix_right: float = 0.8
    most_bits: float = 6.0  # a byte; a text that no language explains better is rejected
    least_posterior: float = 0.5
    least_share: float = 0.001  # of all labelled texts; rarer languages are not learned
    most_languages: int = 32  # the most frequent of them are learned; a task's tables grow with their number
    broadcast_hosts: int = 100_000  # as many sums, of some hundred bytes each, are broadcast; more are joined with salt
    salts: int = 32


def letters(data: np.ndarray) -> np.ndarray:
    out = _LETTERS[data]
    if len(data):
        out[1:] += ((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)).astype(np.uint8) * 32
    return out


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair of bytes before, hashed triple, byte, text) at each place with two bytes before it, but for runs of blanks."""
    x = letters(data).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if len(x) < 3:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    fits = (text[2:] == text[:-2]) & ~((x[2:] == 32) & (x[1:-1] == 32))
    pair, last = x[:-2][fits] * 256 + x[1:-1][fits], x[2:][fits]
    triple = ((pair * 256 + last) * 2654435761 >> 7) % TRIPLES
    return pair, triple, last, text[2:][fits]


@dataclass
class Model:
    names: list[str]
    table: np.ndarray  # natural logs of counts, triple by language
    per_pair: np.ndarray  # pair by language: minus the log of the pair's count and one more
    one: np.ndarray  # byte by language
    seen: np.ndarray = field(default_factory=lambda: np.zeros((TRIPLES, 0), bool))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each text's log-likelihood in each language, and how many bytes it is over; 1 at least where there is any letter."""
        pair, triple, last, text = grams(data, offsets)
        n = len(offsets) - 1
        out = np.zeros((n, len(self.names)))
        for k in range(len(self.names)):
            p = self.per_pair[pair, k] + np.where(self.seen[triple, k], self.table[triple, k], self.one[last, k])
            out[:, k] = np.bincount(text, np.minimum(p, 0.0), n)
        some = np.concatenate([[0], np.cumsum(letters(data) != 32)])[offsets]
        return out, np.maximum(np.bincount(text, minlength=n), np.diff(some) > 0)


def code(column: str) -> Column:
    """A language's two letters; null for what doesn't begin with two."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(column)), "^[a-z]{2}", 0), F.lit(""))


def deal() -> Column:
    """A number below a million by which texts are chosen to learn from."""
    return F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000))


def shares(labelled: DataFrame, settings: Settings) -> dict[str, float]:
    """The languages that are learned, and what share of each one's texts is read."""
    known = labelled.where("text is not null").select(code("language").alias("language")).where("language is not null")
    sizes = known.groupBy("language").count().orderBy(F.desc("count"), "language").limit(settings.most_languages).collect()
    total = sum(r["count"] for r in sizes)
    return {r.language: min(1.0, settings.sample / r["count"]) for r in sorted(sizes, key=lambda r: r.language) if r["count"] >= settings.least_share * total}


def chosen(shares: dict[str, float], language: Column) -> Column:
    """Whether a row (id, text) is one of those to learn `language` from."""
    if not shares:
        return F.lit(False)
    of = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])
    return F.coalesce(deal() < of[language] * 1_000_000, F.lit(False))


def fit(labelled: DataFrame, settings: Settings, share: dict[str, float] | None = None) -> Model:
    """From labelled (id, language, text). Of a language's rows those are read whose hash is low, about `sample` of them. Codes
    are taken by their first two letters; a language of fewer than least_share of all rows, or beyond the most_languages most
    frequent, is not learned. Languages with equally many rows are taken by name."""
    share = shares(labelled, settings) if share is None else share
    names = sorted(share)
    if not names:
        return Model([], np.zeros((TRIPLES, 0)), np.zeros((65_536, 0)), np.zeros((256, 0)))
    number = F.create_map(*[F.lit(x) for i, k in enumerate(names) for x in (k, i)])
    rows = labelled.where("text is not null").select("id", "text", code("language").alias("language"))
    some = rows.where(chosen(share, F.col("language"))).select(number[F.col("language")].alias("k"), "text")
    size = len(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((TRIPLES + 65_536 + 256) * size, np.int64)
        for batch in batches:
            k_all = batch.column(0).to_numpy()
            for lo, hi, data, offsets in pieces(batch.column(1)):
                pair, triple, last, text = grams(data, offsets)
                k = k_all[lo:hi][text]
                for base, x in ((0, triple), (TRIPLES, pair), (TRIPLES + 65_536, last)):
                    total += np.bincount((base + x) * size + k, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    cells = some.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # as many as there are cells at most
    total = np.zeros((TRIPLES + 65_536 + 256) * size)
    total[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    total = total.reshape(-1, size)
    triple, pair, one = total[:TRIPLES], total[TRIPLES : TRIPLES + 65_536], total[TRIPLES + 65_536 :]
    log_one = np.log((one + 0.1) / (one.sum(0) + 25.6))
    table = np.log(np.maximum(triple, 1))
    return Model(names, table.astype(np.float32), -np.log(pair + 1).astype(np.float32), log_one.astype(np.float32), triple > 0)


def identify(rows: DataFrame, model: Model, settings: Settings | None = None, text_of: str | None = None) -> DataFrame:
    """(id, language, posterior, text_language, bits_per_byte, accepted) of each of rows (id, text, declared, suffix, host).

    A text without letters, of which no language explains a byte in most_bits, or whose posterior is below
    least_posterior is not accepted; without letters its language is `und`. Of languages equally likely the first by name is
    taken. A null declared, suffix or host is no evidence, nor is a declared language that the model hasn't learned.
    Null, blank and empty texts have no letters. Repeated ids and rows get a row each; other columns are left out.

    text_of: rows hold a struct `row` instead of text, and its field of this name is the text; `row` is passed on, so that a
    caller can filter what it holds without a join."""
    settings = settings or Settings()
    names, size = model.names, len(model.names)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    carried = [] if text_of is None else ["row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1) if text_of is None else batch.column(1).field(text_of)
            for lo, hi, data, offsets in pieces(text):
                scores, n = shared.value.score(data, offsets)
                kept = [batch.column(i).slice(lo, hi - lo) for i in (0, 2, 3, 4)] + [batch.column(1).slice(lo, hi - lo)] * len(carried)
                yield pa.record_batch([*kept, pa.array(list(scores), pa.list_(pa.float64())), pa.array(n.astype(np.int64))], names=["id", "declared", "suffix", "host", *carried, "scores", "n"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    plain = rows.select("id", "row" if carried else "text", code("declared").alias("declared"), F.lower("suffix").alias("suffix"), F.lower("host").alias("host"))
    scored = plain.mapInArrow(run, f"id {kinds['id']}, declared string, suffix string, host string, " + "".join(f"row {kinds['row']}, " for _ in carried) + "scores array<double>, n long")
    # a likelihood over more than `weigh` bytes counts like one over so many
    tempered = F.transform("scores", lambda x: x * F.least(F.lit(1.0), F.lit(float(settings.weigh)) / F.greatest(F.col("n"), F.lit(1).cast("long"))))
    scored = scored.withColumn("text_log", tempered)

    def normal(logs: Column) -> Column:
        top = F.array_max(logs)
        e = F.transform(logs, lambda x: F.exp(x - top))
        total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
        return F.transform(e, lambda x: x / total)

    scored = scored.withColumn("by_text", F.when(F.col("n") > 0, normal(F.col("text_log"))))
    scored = written(scored.withColumn("domain", F.regexp_extract(F.coalesce("host", F.lit("")), r"([^.]+\.[^.]+)$", 1)), "evidence")
    known = scored.where("by_text is not null")
    sums = [F.sum(F.col("by_text")[i]).alias(f"s{i}") for i in range(size)]
    mine = F.coalesce("by_text", F.array(*[F.lit(0.0)] * size)) if size else F.array().cast("array<double>")
    if not size:
        none = scored.select("id", *carried, F.lit("und").alias("language"), F.lit(0.0).alias("posterior"), F.lit(None).cast("string").alias("text_language"), F.lit(None).cast("double").alias("bits_per_byte"), F.lit(False).alias("accepted"))
        return none
    everywhere = known.agg(*sums).first()
    whole = [float(everywhere[f"s{i}"] or 0) for i in range(size)]
    flat = F.array(*[F.lit((w + 1) / (sum(whole) + size)) for w in whole])

    def with_sums(left: DataFrame, key: str) -> DataFrame:
        """left with the sums of its key: a host may hold a third of all rows, so its rows never meet in one task."""
        found = written(known.where(F.col(key) != "").groupBy(key).agg(*sums).select(key, F.array(*[f"s{i}" for i in range(size)]).alias(f"{key}_sums")), key)
        if found.count() <= settings.broadcast_hosts:
            return left.join(F.broadcast(found), key, "left")
        salted = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(settings.salts - 1))))
        return left.withColumn("_salt", F.pmod(F.xxhash64("id", "n", "scores"), F.lit(settings.salts)).cast("int")).join(salted, [key, "_salt"], "left").drop("_salt")

    def smoothed(own: str, above: Column) -> Column:
        """Sums without the row itself, and the prior above as so many rows more."""
        rest = F.zip_with(F.coalesce(own, mine), mine, lambda a, b: F.greatest(a - b, F.lit(0.0)))
        total = F.aggregate(rest, F.lit(0.0), lambda a, x: a + x) + settings.strength
        return F.zip_with(rest, above, lambda a, b: (a + settings.strength * b) / total)

    def says(column: str, right: float) -> Column:
        """log P(what is declared | language): right for the language named, the rest shared by the others."""
        wrong = (1 - right) / max(1, size - 1)
        return F.array(*[F.when(F.col(column).isNull() | ~F.col(column).isin(names), F.lit(0.0)).when(F.col(column) == k, F.lit(float(np.log(right)))).otherwise(F.lit(float(np.log(max(wrong, 1e-9))))) for k in names])

    country = F.create_map(*[F.lit(x) for kv in SUFFIX_LANGUAGE.items() for x in kv])
    joined = with_sums(with_sums(scored, "host"), "domain")
    joined = joined.withColumn("by_suffix", country[F.col("suffix")])
    joined = joined.withColumn("prior", smoothed("host_sums", smoothed("domain_sums", flat)))
    logs = F.zip_with(F.zip_with("text_log", F.transform("prior", lambda x: F.log(x)), lambda a, b: a + b), F.zip_with(says("declared", settings.declared_right), says("by_suffix", settings.suffix_right), lambda a, b: a + b), lambda a, b: a + b)
    joined = joined.withColumn("posteriors", normal(logs))
    name = F.array(*[F.lit(k) for k in names])
    best = lambda x: F.element_at(name, F.array_position(x, F.array_max(x)).cast("int"))
    bits = -F.array_max("scores") / F.col("n") / float(np.log(2))
    some = F.col("n") > 0
    out = joined.select(
        "id", *carried, F.when(some, best(F.col("posteriors"))).otherwise("und").alias("language"), F.when(some, F.array_max("posteriors")).otherwise(0.0).alias("posterior"),
        F.when(some, best(F.col("by_text"))).alias("text_language"), F.when(some, bits).alias("bits_per_byte"),
    )
    return out.withColumn("accepted", F.coalesce((F.col("bits_per_byte") <= settings.most_bits) & (F.col("posterior") >= settings.least_posterior), F.lit(False)))


def page_evidence(pages: DataFrame) -> DataFrame:
    """(id, text, declared, suffix, host) of pages (page_id, url, html): the text without markup, the html element's lang attribute, and the address's parts."""
    text = F.regexp_replace("html", r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))
    declared = F.regexp_extract("html", r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2})", 1)
    return pages.select(F.col("page_id").alias("id"), text.alias("text"), F.nullif(declared, F.lit("")).alias("declared"), F.nullif(F.regexp_extract(host, r"\.([a-z]+)$", 1), F.lit("")).alias("suffix"), F.nullif(host, F.lit("")).alias("host"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/pages.parquet")
    settings = Settings()
    model = fit(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), "text"), settings)
    return identify(page_evidence(pages), model, settings).withColumnRenamed("id", "page_id")
