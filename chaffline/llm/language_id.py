"""Language identification by interpolated Kneser-Ney character models, one per language.

Characters are letters in lower case; everything between them is one space. Grams of all training
texts are counted in Spark. The highest order discounts its counts, the lower ones count in how
many contexts a gram appears, and all orders are interpolated down to a uniform distribution over
the letters seen. A language's model is kept as sorted arrays of 64-bit gram hashes, each with a log
probability and a back-off weight. It grows with the corpus: up to `MODEL_ROWS` rows it is sent to
the tasks, a larger one stays a table in Spark, with which the distinct grams of each document are
joined.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chaffline.llm.arrays import slices, texts_of
from chaffline.session import cut_lineage

ORDER = 3
#: Rows of a model that are sent to all tasks at most.
MODEL_ROWS = 4_000_000
#: Gram codes up to this number are counted in an array, above by sorting.
DENSE_CODES = 1 << 22
TEXT_BYTES = 4 << 20
#: Characters that count in a confidence: more do not make it surer.
CONFIDENT_CHARS = 64
#: Code point that stands for the beginning of a text; it is no letter.
START = 2

_fold: np.ndarray | None = None


def _folding() -> np.ndarray:
    """Code point to the code point of its lower case letter, 32 where it is no letter."""
    global _fold
    if _fold is None:
        table = np.full(sys.maxunicode + 1, 32, np.uint32)
        for code in range(sys.maxunicode + 1):
            letter = chr(code)
            if letter.isalpha():
                low = letter.lower()
                table[code] = ord(low) if len(low) == 1 else code
        _fold = table
    return _fold


def folded(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The texts as folded code points, `order` marks before each, and the text of each code point.

    The mark START stands for the beginning of a text; runs of non-letters are one space.
    """
    pad = order
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    codes = _folding()[codes]
    owner = np.repeat(np.arange(len(texts)), sizes)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32) | (owner[1:] != owner[:-1])
    codes, owner = codes[keep], owner[keep]
    counts = np.bincount(owner, minlength=len(texts))
    out = np.full(len(codes) + pad * len(texts), START, np.uint32)
    place = np.arange(len(codes)) + pad * (owner + 1)
    out[place] = codes
    return out, np.repeat(np.arange(len(texts)), counts + pad)


def grams(codes: np.ndarray, owner: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams (rows of code points), and for every real character its gram and its text."""
    present = np.zeros(sys.maxunicode + 1, bool)
    present[codes] = True
    letters = np.flatnonzero(present)
    if not len(codes):
        return np.zeros((0, order), np.uint32), np.zeros(0, np.int64), owner
    number = np.zeros(sys.maxunicode + 1, np.uint64)
    number[letters] = np.arange(len(letters), dtype=np.uint64)
    small, size = number[codes], np.uint64(len(letters))
    key = np.zeros(len(codes) - order + 1, np.uint64)
    for i in range(order):
        key = key * size + small[i : i + len(key)]
    real = codes[order - 1 :] != START
    key, owner = key[real], owner[order - 1 :][real]
    if len(letters) ** order <= DENSE_CODES:
        seen = np.bincount(key.astype(np.int64), minlength=len(letters) ** order) > 0
        distinct = np.flatnonzero(seen).astype(np.uint64)
        which = (np.cumsum(seen) - 1)[key.astype(np.int64)]
    else:
        distinct, which = np.unique(key, return_inverse=True)
    rows = np.zeros((len(distinct), order), np.uint32)
    rest = distinct
    for i in reversed(range(order)):
        rows[:, i] = letters[(rest % size).astype(np.int64)]
        rest = rest // size
    return rows, which, owner


def _strings(rows: np.ndarray) -> list[str]:
    order = rows.shape[1]
    joined = np.ascontiguousarray(rows).tobytes().decode("utf-32-le")
    return [joined[i : i + order] for i in range(0, len(joined), order)]


def count_grams(documents: DataFrame, order: int, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, gram, n) over whole texts; every text starts with `order` - 1 marks START."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, TEXT_BYTES):
            codes, owner = folded(texts_of(batch, text).to_pylist(), order)
            rows, which, owner = grams(codes, owner, order)
            names = batch.column(lang).dictionary_encode()
            language = np.asarray(names.indices)[owner]
            size = len(rows)
            counts = np.bincount(language * size + which, minlength=size * len(names.dictionary))
            found = np.flatnonzero(counts)
            texts = pa.array(_strings(rows), pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    names.dictionary.take(pa.array(found // max(size, 1))),
                    texts.take(pa.array(found % max(size, 1))),
                    pa.array(counts[found].astype(np.int64)),
                ],
                ["lang", "gram", "n"],
            )

    counted = documents.select(lang, text).mapInArrow(run, "lang string, gram string, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame, order: int) -> DataFrame:
    """The model's rows: lang, size (of the gram), gram, logp, backoff.

    `logp` is the interpolated log probability of the last character after the others, `backoff` the
    log weight of the shorter context where a longer gram beginning with this one is not known.
    The row of size 0 has the probability of a letter never seen.
    """
    levels = {order: cut_lineage(counts)}
    for size in range(order - 1, 0, -1):
        # In how many contexts a gram appears: the longer grams that end with it.
        shorter = levels[size + 1].groupBy("lang", F.substring("gram", 2, size).alias("gram"))
        levels[size] = cut_lineage(shorter.agg(F.count(F.lit(1)).alias("n")))

    letters = levels[1].groupBy("lang").agg(F.count(F.lit(1)).alias("letters"))
    lower = letters.select("lang", F.lit("").alias("gram"), (1 / (F.col("letters") + 1)).alias("p"))
    rows = None
    for size in range(1, order + 1):
        grams_ = levels[size]
        once, twice = (F.count(F.when(F.col("n") == i, 1)) for i in (1, 2))
        discount = F.when((once > 0) & (twice > 0), once / (once + 2 * twice)).otherwise(0.5)
        discounts = grams_.groupBy("lang").agg(discount.alias("d"))
        contexts = (
            grams_.groupBy("lang", F.substring("gram", 1, size - 1).alias("context"))
            .agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"))
            .join(discounts, "lang")
            .select("lang", "context", "total", "d", (F.col("d") * F.col("types") / F.col("total")).alias("weight"))
        )
        below = lower.withColumnRenamed("gram", "suffix").withColumnRenamed("p", "lower_p")
        level = cut_lineage(
            grams_.withColumn("context", F.substring("gram", 1, size - 1))
            .withColumn("suffix", F.substring("gram", 2, size - 1))
            .join(contexts, ["lang", "context"])
            .join(below, ["lang", "suffix"])
            .select(
                "lang", "gram",
                ((F.col("n") - F.col("d")) / F.col("total") + F.col("weight") * F.col("lower_p")).alias("p"),
            )
        )
        backoffs = contexts.select("lang", F.col("context").alias("gram"), F.log("weight").alias("backoff"))
        previous = lower.select("lang", "gram", F.log("p").alias("logp"))
        own = previous.join(backoffs, ["lang", "gram"], "full").withColumn("size", F.lit(size - 1))
        rows = own if rows is None else rows.unionByName(own)
        lower = level
    top = lower.select(
        "lang", "gram", F.log("p").alias("logp"), F.lit(None).cast("double").alias("backoff"), F.lit(order).alias("size")
    )
    return rows.unionByName(top)


@dataclass
class Model:
    """Per language and size of gram: sorted hashes, log probabilities (NaN if none) and back-offs."""

    languages: list[str]
    order: int
    hashes: list[list[np.ndarray]]
    logp: list[list[np.ndarray]]
    backoff: list[list[np.ndarray]]

    def _find(self, language: int, size: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = self.hashes[language][size]
        logp, backoff = np.full(len(wanted), np.nan), np.zeros(len(wanted))
        if len(own):
            at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
            known = own[at] == wanted
            logp[known] = self.logp[language][size][at[known]]
            backoff[known] = self.backoff[language][size][at[known]]
        return logp, backoff

    def log_probabilities(self, texts: list[str]) -> np.ndarray:
        """For each gram of full order the log probability of its last character, by language."""
        order, count = self.order, len(self.languages)
        asked = {}
        for size in range(1, order + 1):
            for name, cut in (("gram", slice(order - size, None)), ("context", slice(order - size, -1))):
                short, which = np.unique([t[cut] for t in texts], return_inverse=True)
                hashes = (xxhash.xxh64_intdigest(t, 42) for t in short.tolist())
                asked[name, size] = np.fromiter(hashes, np.uint64, len(short)).view(np.int64), which
        total = np.zeros((len(texts), count))
        for language in range(count):
            # The row of size 0 has the empty gram.
            total[:, language] = self.logp[language][0][0] + self.backoff[language][0][0]
            for size in range(1, order + 1):
                if size > 1:
                    wanted, which = asked["context", size]
                    total[:, language] += self._find(language, size - 1, wanted)[1][which]
                wanted, which = asked["gram", size]
                own = self._find(language, size, wanted)[0][which]
                total[:, language] = np.where(np.isnan(own), total[:, language], own)
        return total

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character by text and language, and the characters of each text."""
        codes, owner = folded(texts, self.order)
        rows, which, owner = grams(codes, owner, self.order)
        counts = np.bincount(owner, minlength=len(texts))
        sums = np.zeros((len(texts), len(self.languages)))
        if len(rows):
            table = self.log_probabilities(_strings(rows))
            for i in range(len(self.languages)):
                sums[:, i] = np.bincount(owner, weights=table[which, i], minlength=len(texts))
        return -sums / np.maximum(counts, 1)[:, None], counts


@dataclass
class ModelTable:
    """A model that stays in Spark: a row per gram with its values by number of language."""

    languages: list[str]
    order: int
    grams: DataFrame  # gram, size, logp map<int, double>, backoff map<int, double>

    def resolved(self, asked: DataFrame) -> DataFrame:
        """(gram, logp array by language) of the distinct `gram`s of full order in a table."""
        order, found = self.order, asked.select("gram").distinct()
        base = self.grams.where("size = 0").select("logp", "backoff").first()
        numbers = range(len(self.languages))
        value = {i: F.lit(base.logp[i] + base.backoff.get(i, 0.0)) for i in numbers}
        for size in range(1, order + 1):
            known = self.grams.where(F.col("size") == size).select(F.col("gram").alias(f"_g{size}"), F.col("logp").alias(f"_l{size}"))
            found = found.withColumn(f"_g{size}", F.substring("gram", order - size + 1, size)).join(known, f"_g{size}", "left")
            if size > 1:
                context = self.grams.where(F.col("size") == size - 1).select(F.col("gram").alias(f"_c{size}"), F.col("backoff").alias(f"_b{size}"))
                found = found.withColumn(f"_c{size}", F.substring("gram", order - size + 1, size - 1)).join(context, f"_c{size}", "left")
            for i in numbers:
                own = F.try_element_at(f"_l{size}", F.lit(i))
                weight = F.coalesce(F.try_element_at(f"_b{size}", F.lit(i)), F.lit(0.0)) if size > 1 else F.lit(0.0)
                value[i] = F.coalesce(own, value[i] + weight)
        return found.select("gram", F.array(*[value[i] for i in numbers]).alias("logp"))


def build_model(rows: DataFrame, order: int) -> Model | ModelTable:
    """The rows as sorted arrays where they are at most `MODEL_ROWS`, else as a table."""
    rows = cut_lineage(rows)
    languages = sorted(r[0] for r in rows.where("size = 0").select("lang").collect())  # a row per language
    if rows.count() > MODEL_ROWS:
        numbers = F.create_map(*[F.lit(x) for pair in zip(languages, range(len(languages))) for x in pair])
        entry = lambda c: F.map_from_entries(
            F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.element_at(numbers, F.col("lang")), F.col(c))))
        )
        table = rows.groupBy("gram", "size").agg(entry("logp").alias("logp"), entry("backoff").alias("backoff"))
        return ModelTable(languages, order, cut_lineage(table))
    table = rows.select("lang", "size", F.xxhash64("gram").alias("hash"), "logp", "backoff").toArrow()
    language = np.searchsorted(languages, np.asarray(table["lang"].to_pylist(), dtype=object)) if languages else np.zeros(0, int)
    size, hashes = np.asarray(table["size"]), np.asarray(table["hash"])
    logp, backoff = (np.asarray(table[c].to_pandas(), dtype=np.float64) for c in ("logp", "backoff"))
    model = Model(languages, order, [], [], [])
    for number in range(len(languages)):
        parts = [np.flatnonzero((language == number) & (size == k)) for k in range(order + 1)]
        parts = [own[np.argsort(hashes[own])] for own in parts]
        model.hashes.append([hashes[own] for own in parts])
        model.logp.append([logp[own].astype(np.float32) for own in parts])
        model.backoff.append([np.nan_to_num(backoff[own], nan=0.0).astype(np.float32) for own in parts])
    return model


def fit_model(documents: DataFrame, order: int = ORDER, lang: str = "lang", text: str = "text") -> Model | ModelTable:
    """Models of all languages of the rows with a language; counts cover all of their texts."""
    training = documents.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    return build_model(kneser_ney(count_grams(training, order, lang, text), order), order)


_SCORED = "entropy array<double>, chars long, lettered boolean"


def _entropies(documents: DataFrame, model: Model, doc_id: str, text: str) -> DataFrame:
    """(doc_id, entropy by language, chars, lettered) with a model that the tasks hold."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, text, TEXT_BYTES):
            texts = texts_of(batch, text).to_pylist()
            lettered = np.fromiter((any(map(str.isalpha, t)) for t in texts), bool, len(texts))
            entropy, chars = model.cross_entropies(texts)
            offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * entropy.shape[1])
            lists = pa.ListArray.from_arrays(offsets, pa.array(entropy.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(doc_id), lists, pa.array(chars.astype(np.int64)), pa.array(lettered)],
                ["doc_id", "entropy", "chars", "lettered"],
            )

    chosen = documents.select(doc_id, text)
    schema = T.StructType([T.StructField("doc_id", chosen.schema[doc_id].dataType)])
    for field in T._parse_datatype_string(_SCORED).fields:
        schema.add(field)
    return chosen.mapInArrow(run, schema)


def _joined_entropies(documents: DataFrame, model: ModelTable, doc_id: str, text: str) -> DataFrame:
    """The same with a model in Spark: the distinct grams of each document meet the table."""
    keyed = cut_lineage(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row")))
    order = model.order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", TEXT_BYTES):
            codes, owner = folded(texts_of(batch, "text").to_pylist(), order)
            rows, which, owner = grams(codes, owner, order)
            size = max(len(rows), 1)
            found, counts = np.unique(owner * size + which, return_counts=True)
            texts = pa.array(_strings(rows) if len(rows) else [], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(found // size)), texts.take(pa.array(found % size)), pa.array(counts.astype(np.int64))],
                ["row", "gram", "n"],
            )

    counted = cut_lineage(keyed.select("row", "text").mapInArrow(run, "row long, gram string, n long"))
    values = counted.join(cut_lineage(model.resolved(counted)), "gram")
    sums = [F.sum(F.col("n") * F.col("logp")[i]).alias(f"_s{i}") for i in range(len(model.languages))]
    per_row = values.groupBy("row").agg(F.sum("n").alias("chars"), *sums)
    entropy = F.array(*[F.coalesce(-F.col(f"_s{i}") / F.col("chars"), F.lit(0.0)) for i in range(len(model.languages))])
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return keyed.join(per_row, "row", "left").select(
        "doc_id", entropy.alias("entropy"), F.coalesce("chars", F.lit(0)).alias("chars"), lettered.alias("lettered")
    )


def identify(
    documents: DataFrame,
    model: Model | ModelTable,
    limits: dict[str, tuple[float, float]] | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    name_rejected: bool = False,
) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), cross_entropy (nats per character), chars, rejected.

    The language with the lowest cross-entropy per character wins, the first by name among equal
    ones. The score is its probability among the languages, counting at most 64 characters. A text
    that is null or has no letter is `und` with score 0. With `limits` (see `calibrate`) a text
    whose cross-entropy is above its language's limit is rejected, and `und` too unless
    `name_rejected` asks for the language all the same. Texts are read whole. An empty table gives
    no rows, a model without languages only `und`. Other columns are not read; repeated rows and
    null doc_ids stay as they are.
    """
    if not model.languages:
        plain = documents.select(F.col(doc_id).alias("doc_id"))
        return plain.select(
            "doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("cross_entropy"),
            F.lit(0).cast("long").alias("chars"), F.lit(False).alias("rejected"),
        )
    scored = (_joined_entropies if isinstance(model, ModelTable) else _entropies)(documents, model, doc_id, text)
    low = F.array_min("entropy")
    best = F.array_position("entropy", low).cast("int") - 1
    ahead = F.aggregate(
        "entropy", F.lit(0.0), lambda s, e: s + F.exp((F.col("low") - e) * F.least(F.col("chars"), F.lit(CONFIDENT_CHARS)))
    )
    name = F.get(F.lit(model.languages), F.col("best"))
    bound: Column = F.lit(float("inf"))
    if limits:
        of = lambda i: F.lit([float(limits.get(x, (np.inf, 0.0))[i]) for x in model.languages])
        bound = F.get(of(0), F.col("best")) + F.get(of(1), F.col("best")) / F.sqrt(F.greatest(F.col("chars"), F.lit(1)))
    rejected = F.col("lettered") & (F.col("low") > bound)
    named = F.col("lettered") if name_rejected else F.col("lettered") & ~F.col("rejected")
    return (
        scored.withColumn("low", low).withColumn("best", best).withColumn("rejected", rejected)
        .select(
            "doc_id", F.when(named, name).otherwise("und").alias("lang_pred"),
            F.when(F.col("lettered"), 1 / ahead).otherwise(0.0).alias("score"), F.col("low").alias("cross_entropy"), "chars", "rejected",
        )
    )


def calibrate(scored: DataFrame, deviations: float = 6.0) -> dict[str, tuple[float, float]]:
    """Limits of accepted cross-entropies, from texts known to be in a model's languages.

    `scored` is a result of `identify` without limits. Per language: the mean over its texts, and
    `deviations` times the spread around it, which shrinks with the root of a text's length.
    """
    known = scored.where("lang_pred <> 'und'")
    means = known.groupBy("lang_pred").agg(F.avg("cross_entropy").alias("mean"))
    off = (F.col("cross_entropy") - F.col("mean")) * F.sqrt("chars")
    rows = (
        known.join(F.broadcast(means), "lang_pred")  # a row per language
        .groupBy("lang_pred")
        .agg(F.first("mean").alias("mean"), F.sqrt(F.avg(off * off)).alias("spread"))
        .collect()  # a row per language
    )
    return {r["lang_pred"]: (r["mean"], deviations * r["spread"]) for r in rows}
