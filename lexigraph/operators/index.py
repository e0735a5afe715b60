"""Inverted index and TF-IDF vectors.

The long table of term frequencies feeds everything else, so ``build`` writes it once to the shared folder, with the
frequencies by term. The widest shuffle is that of the texts by document; document frequencies and norms combine on the
map side before theirs, and the weights need none where the vocabulary is small enough to be broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.functions.text import is_indexed, stem, terms, words
from lexigraph.session import cut


#: Documents of a term that one row of stored postings holds.
SEGMENT = 100_000
#: Rows and bytes up to which a side is broadcast; what is more is joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 64 << 20
#: Bytes of stored input whose texts one task splits into terms, and bytes below which no task is made for idle cores.
DEALT_BYTES, LEAST_DEALT_BYTES = 4 << 20, 256 << 10


def stored_bytes(df: DataFrame) -> int | None:
    """Bytes of what a plan reads; None where a source does not know."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    held = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return held if held < 1 << 60 else None


def dealt(docs: DataFrame, key: str, text: Column, times: int = 1) -> DataFrame:
    """(key, _text) dealt by key to as many tasks as the input's bytes ask for, so that a task's memory does not grow with them.

    Left to itself, adaptive execution fills a task up to a size of compressed texts whose terms take fifty times that.
    ``times``: how often the text holds what is stored once.
    """
    rows = docs.select(key, text.alias("_text"))
    return spread(rows, stored_bytes(rows), key, times)


def spread(rows: DataFrame, held: int | None, key: str, times: int = 1) -> DataFrame:
    """Dealt by key to a task for each DEALT_BYTES of the stored bytes ``held``, whatever partitions the session has."""
    if held is None:
        return rows.repartition(F.col(key))
    held *= times
    idle = min(rows.sparkSession.sparkContext.defaultParallelism, held // LEAST_DEALT_BYTES)
    return rows.repartition(max(1, idle, -(-held // DEALT_BYTES)), F.col(key))


def term_frequencies(docs: DataFrame, key: str, text: Column, times: int = 1) -> DataFrame:
    """(key, term, tf), without positions: words are exploded first, so filter and stem run as generated code.

    Texts are dealt by key before that, fewer bytes than their terms; counting by key and term then needs no exchange.
    """
    exploded = dealt(docs, key, text, times).select(key, F.explode(words(F.col("_text"))).alias("word")).where(is_indexed(F.col("word")))
    return exploded.select(key, stem(F.col("word")).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def positions(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, term, position): places count after filtering."""
    return dealt(docs, key, text).select(key, F.posexplode(terms(F.col("_text"))).alias("position", "term"))


def occurrences(placed: DataFrame, key: str) -> DataFrame:
    """(key, term, positions) from positions; those of a document lie together, so this needs no exchange."""
    return placed.groupBy(key, "term").agg(F.array_sort(F.collect_list("position")).alias("positions"))


def numbered_occurrences(docs: DataFrame, key: str, text: Column, times: int = 1) -> DataFrame:
    """(term, number, positions, key) in one pass: a document's number, a few bytes, stands for its key of 64 letters.

    The key is given with the document's first term and null with others. Numbers hold within one run of this: write it.
    """
    rows = dealt(docs, key, text, times).withColumn("number", F.monotonically_increasing_id())
    placed = rows.select("number", key, F.posexplode(terms(F.col("_text"))).alias("position", "term"))
    own = placed.groupBy("term", "number", key).agg(F.array_sort(F.collect_list("position")).alias("positions"))
    return own.select("term", "number", "positions", F.when(F.get("positions", F.lit(0)) == 0, F.col(key)).alias(key))


def by_term(df: DataFrame) -> DataFrame:
    """Laid out in order of the term, so that a stored table is read only where it holds the terms asked for."""
    return df.repartitionByRange("term").sortWithinPartitions("term")


def vocabulary(tf: DataFrame) -> DataFrame:
    """(place, term): the terms in order, numbered from 0; each range is numbered by itself, from the sizes of those before."""
    part = F.spark_partition_id().alias("part")
    laid = cut(by_term(tf.select("term").distinct()).select("term", part, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")))
    # One row a partition
    order = Window.orderBy("part")
    before = laid.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.sum("n").over(order) - F.col("n")).alias("before"))
    return laid.join(F.broadcast(before), "part").select((F.col("before") + F.col("at")).alias("place"), "term")


def damped(tf: Column) -> Column:
    return F.when(tf > 0, 1 + F.log10(tf)).otherwise(0.0)


def inverse_frequency(documents: Column, df: Column) -> Column:
    return F.when((documents > 0) & (df > 0), F.log10((documents + 1) / (df + 1)) + 1).otherwise(0.0)


def document_frequencies(tf: DataFrame, docs: DataFrame) -> DataFrame:
    """(term, df, idf); the corpus size is one row, broadcast."""
    size = docs.agg(F.count("*").alias("documents"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(size)).select("term", "df", inverse_frequency(F.col("documents"), F.col("df")).alias("idf"))


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """By a count that stops after ``rows``, and the bytes of these rows."""
    size = [F.octet_length(F.col(c)) if t == "string" else F.lit(8) for c, t in df.dtypes]
    there, held = df.limit(rows + 1).agg(F.count("*"), F.sum(sum((F.coalesce(x, F.lit(0)).cast("bigint") for x in size), F.lit(16)))).first()
    return there <= rows and (held or 0) <= BROADCAST_BYTES


def with_idf(tf: DataFrame, idf: DataFrame, what: str = "idf") -> DataFrame:
    """tf with idf (or df) by term, for an idf of all of tf's terms. It is broadcast if small, or without the terms of one document if
    these make it large: what is not found has their value. The hint keeps the far larger tf from being broadcast instead.
    """
    pairs = idf.select("term", what)
    if is_small(pairs):
        return tf.join(F.broadcast(pairs), "term")
    shared = idf.where("df > 1").select("term", what)
    if is_small(shared):
        own = idf.where("df = 1").select(what).first()
        return tf.join(F.broadcast(shared), "term", "left").withColumn(what, F.coalesce(what, F.lit(own and own[0])))
    return tf.join(pairs.hint("shuffle_hash"), "term")


def raw_weights(tf: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    return with_idf(tf, idf).select(key, "term", (damped(F.col("tf")) * F.col("idf")).alias("raw"))


def of_unit_length(raw: DataFrame, key: str) -> DataFrame:
    """(key, term, weight) from (key, term, raw). A document's rows lie together, so its sum is made before the exchange."""
    lengths = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(lengths, key).select(key, "term", (F.col("raw") / F.col("norm")).alias("weight"))


def weights(tf: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """(key, term, weight) of unit length for each document; documents without terms have no rows.

    Rows are dealt by the bytes of tf and sorted once, so that a task's sort does not grow with them; squares are summed in
    order of the term, so weights can be repeated.
    """
    own = Window.partitionBy(key).orderBy("term").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    raw = spread(raw_weights(tf, idf, key), stored_bytes(tf), key)
    return raw.select(key, "term", (F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(own))).alias("weight"))


def norms(tf: DataFrame, idf: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """(key, norm) for every document; 0 without terms."""
    raw = raw_weights(tf, idf, key)
    return docs.select(key).join(raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm")), key, "left").select(key, F.coalesce("norm", F.lit(0.0)).alias("norm"))


def token_counts(tf: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """(key, token_count, unique_term_count) for every document."""
    counts = tf.groupBy(key).agg(F.sum("tf").alias("token_count"), F.count("*").alias("unique_term_count"))
    return docs.select(key).join(counts, key, "left").select(key, *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("token_count", "unique_term_count")))


def postings(placed: DataFrame, key: str) -> DataFrame:
    """(term, document_frequency, postings sorted by key); each posting has tf and ascending positions."""
    own = placed.groupBy("term", key).agg(F.array_sort(F.collect_list("position")).alias("positions"))
    posting = F.struct(F.col(key), F.size("positions").alias("term_frequency"), "positions")
    return own.groupBy("term").agg(F.count("*").alias("document_frequency"), F.array_sort(F.collect_list(posting)).alias("postings"))


def packed(key: Column) -> Column:
    """A string in bytes: half as many where it is hexadecimal, as keys are, which no fast codec finds out."""
    return F.when(key.rlike("^(?:[0-9a-f]{2})+$"), F.concat(F.lit(b"\x01"), F.unhex(key))).otherwise(F.concat(F.lit(b"\x00"), F.encode(key, "UTF-8")))


def unpacked(key: Column) -> Column:
    whole = F.substring(key, 2, 1 << 30)
    return F.when(F.substring(key, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(whole))).otherwise(F.decode(whole, "UTF-8"))


def posted(own: DataFrame, frequencies: DataFrame, key: str, most: int = SEGMENT) -> DataFrame:
    """(term, segment, document_frequency, postings) in order of the term, from ``occurrences`` and (term, df).

    A term of more than ``most`` documents, about, has several rows. Occurrences are moved once, to where their rows are
    written; few terms are that frequent, so these are broadcast.
    """
    text = dict(own.dtypes)[key] == "string"
    pack, unpack = (packed, unpacked) if text else (lambda c: c, lambda c: c)
    heavy = frequencies.where(F.col("df") > most).select("term", F.col("df").alias("of"))
    segment = F.coalesce(F.pmod(F.xxhash64(key), F.ceil(F.col("of") / most)).cast("int"), F.lit(0))
    rows = own.join(F.broadcast(heavy), "term", "left").select("term", segment.alias("segment"), "of", pack(F.col(key)).alias(key), "positions")
    laid = rows.repartitionByRange("term", "segment").select("term", "segment", "of", unpack(F.col(key)).alias(key), "positions")
    posting = F.struct(F.col(key), F.size("positions").alias("term_frequency"), "positions")
    out = laid.groupBy("term", "segment").agg(F.coalesce(F.max("of"), F.count("*")).alias("document_frequency"), F.array_sort(F.collect_list(posting)).alias("postings"))
    return out.sortWithinPartitions("term", "segment")


def segmented_postings(placed: DataFrame, key: str, most: int = SEGMENT) -> DataFrame:
    """``posted`` from positions."""
    own = occurrences(placed, key)
    return posted(own, own.groupBy("term").agg(F.count("*").alias("df")), key, most)


def document_vectors(docs: DataFrame, key: str, text: Column, idf: DataFrame, documents: int, numbers: DataFrame, carried: list[str], times: int = 1) -> DataFrame:
    """The stored form: key, number, carried columns, token_count, unique_term_count, norm, documents and, in order of the
    term, arrays of terms, of their frequencies here and in documents. These small numbers make the weights
    (``with_vectors``), which as doubles would take most of the table.

    One pass over texts dealt by document; their terms are moved nowhere else.
    """
    known = with_idf(term_frequencies(docs, key, text, times), idf, "df")
    raw = damped(F.col("tf")) * inverse_frequency(F.lit(documents), F.col("df"))
    each = known.groupBy(key).agg(
        F.sum("tf").alias("token_count"), F.count("*").alias("unique_term_count"), F.sqrt(F.sum(raw * raw)).alias("norm"),
        F.array_sort(F.collect_list(F.struct("term", F.col("tf").cast("int").alias("tf"), F.col("df").cast("int").alias("df")))).alias("entries"),
    )
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("token_count", "unique_term_count")]
    listed = [F.coalesce(f"entries.{c}", F.array().cast(f"array<{kind}>")).alias(f"{c}s") for c, kind in (("term", "string"), ("tf", "int"), ("df", "int"))]
    rows = docs.select(key, *carried).join(numbers, key, "left").join(each, key, "left")
    return rows.select(key, "number", *carried, *counts, F.coalesce("norm", F.lit(0.0)).alias("norm"), F.lit(documents).cast("bigint").alias("documents"), *listed)


def with_vectors(kept: DataFrame) -> DataFrame:
    """Stored document vectors with the vector as a map; the same doubles as weights have that were never stored."""
    weight = lambda tf, df: damped(tf) * inverse_frequency(F.col("documents"), df) / F.col("norm")
    return kept.withColumn("vector", F.map_from_arrays("terms", F.zip_with("tfs", "dfs", weight))).drop("documents", "terms", "tfs", "dfs")


@dataclass
class Index:
    """The long tables that search reads; ``vectors`` also gives the map form."""

    key: str
    docs: DataFrame
    tf: DataFrame | None
    idf: DataFrame
    weights: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.weights is None:
            self.weights = weights(self.tf, self.idf, self.key)

    def weights_of(self, terms: list[str]) -> DataFrame:
        """The weights of these terms alone. Where they are not stored, only documents that have one of the terms are weighed."""
        wanted = F.col("term").isin(terms)
        if self.tf is None:
            return self.weights.where(wanted)
        holders = self.tf.where(wanted).select(self.key).distinct()
        raw = raw_weights(self.tf.join(holders, self.key, "left_semi"), self.idf, self.key)
        return of_unit_length(raw, self.key).where(wanted)

    def vectors(self) -> DataFrame:
        entries = self.weights.groupBy(self.key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "weight")))).alias("vector"))
        return self.docs.join(entries, self.key, "left").withColumn("vector", F.coalesce("vector", F.create_map().cast("map<string,double>")))

    def metadata(self, name: str = "publication_index") -> DataFrame:
        documents = self.docs.agg(F.count("*").alias("document_count"))
        vocabulary = self.idf.agg(F.count("*").alias("vocabulary_size"))
        return documents.crossJoin(vocabulary).select(F.lit(name).alias("name"), "document_count", "vocabulary_size")


def build(docs: DataFrame, key: str, text: Column) -> Index:
    tf = cut(term_frequencies(docs, key, text))
    return Index(key, docs, tf, cut(document_frequencies(tf, docs)))
