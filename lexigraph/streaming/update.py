"""Updates: crawl, save, index; once, on an interval, or per micro-batch of a stream of page files."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexigraph.config import EngineConfig
from lexigraph.functions.text import indexed_text
from lexigraph.operators.index import Index, by_term, damped, document_frequencies, document_vectors, inverse_frequency, numbered_occurrences, posted, stored_bytes
from lexigraph.operators.store import Store
from lexigraph.session import cut, release

from .crawl import CrawlOutput, crawl, run_row

SECONDS_A_DAY = 86_400
#: How often the indexed text holds the fields that are stored once, with their compression, against a table of texts.
HELD_TIMES = 2
#: Stored bytes of publications for one more slice of the postings, and slices at most: while a slice is written, its
#: occurrences lie in a shuffle's files, three times the bytes that they take before and after.
SLICE_BYTES, SLICES = 16 << 20, 4


@dataclass
class UpdateResult:
    crawl: CrawlOutput
    saved: int
    run_id: str
    indexed: int
    terms: int
    started_at: datetime
    finished_at: datetime

    def __str__(self) -> str:
        return f"run {self.run_id}: {self.crawl.pages_visited} pages, {self.saved} publications saved; {index_line(self.indexed, self.terms)}"


def index_line(documents: int, terms: int) -> str:
    return f"{documents} documents and {terms} terms are in the index"


def now() -> datetime:
    return datetime.now(timezone.utc)


def interval_seconds(days: float) -> int:
    if days <= 0:
        raise ValueError("the interval must be longer than zero days")
    return max(1, int(days * SECONDS_A_DAY))


def rebuild_index(store: Store) -> tuple[int, int]:
    """Writes postings, idf, vectors with their norms, and metadata, which readers see all at once; returns documents and terms.

    What moves is the texts, twice, and each document's occurrences of a term, once, to where the postings are written. One
    table is written after another, and what it alone needs goes before the next.
    """
    publications, key, text = store.read("publications"), "publication_key", indexed_text()
    slices = min(SLICES, -(-(stored_bytes(publications) or 0) // SLICE_BYTES) or 1)
    own = cut(numbered_occurrences(publications, key, text, HELD_TIMES).withColumn("slice", F.pmod(F.xxhash64("term"), F.lit(slices)).cast("int")), "slice")
    numbers, idf = cut(own.where(F.col(key).isNotNull()).select(key, "number")), cut(document_frequencies(own, publications))
    carried = ["title", "publication_url", "publication_year", "authors"]
    at = F.lit(now())  # one time a build

    def tables() -> Iterator[tuple[str, DataFrame]]:
        for i in range(slices):
            yield "inverted_index", posted(own.where(F.col("slice") == i).select("term", "number", "positions"), idf, "number")
        release(own)
        yield "document_vectors", document_vectors(publications, key, text, idf, publications.count(), numbers, carried, HELD_TIMES).withColumn("indexed_at", at)
        yield "idf", by_term(idf)
        yield "index_metadata", Index(key, publications, None, idf, publications).metadata().withColumn("indexed_at", at)

    store.replace_all(tables())
    release(numbers, idf)
    store.vacuum()
    meta = store.read("index_metadata").first()
    return meta["document_count"], meta["vocabulary_size"]


def stored_index(store: Store) -> Index:
    """What search reads: idf and postings, both in order of the term, and norms, which make weights of them."""
    key = "publication_key"
    postings = store.read("inverted_index").select("term", "document_frequency", F.explode("postings").alias("p")).select("term", "document_frequency", "p.number", "p.term_frequency")
    size = F.broadcast(store.read("index_metadata").select("document_count"))  # one row
    raw = damped(F.col("term_frequency")) * inverse_frequency(F.col("document_count"), F.col("document_frequency"))
    norms = store.read("document_vectors").select("number", key, "norm")
    weights = postings.crossJoin(size).join(norms, "number").select(key, "term", (raw / F.col("norm")).alias("weight"))
    return Index(key, store.read("publications").select(key), None, store.read("idf"), weights)


def run_once(spark: SparkSession, config: EngineConfig, source, store: Store, **caps: int | None) -> UpdateResult:
    started = now()
    store.check()
    output = crawl(spark, config, source, **caps)
    order = output.publications.withColumn("ord", F.struct("page_ord", "ord"))
    saved = store.upsert_publications(order.drop("page_ord"))
    run_id = store.save_run(run_row(spark, config, output, saved, started, now()))
    return UpdateResult(output, saved, run_id, *rebuild_index(store), started, now())


def run_forever(update: Callable[[], UpdateResult], days: float, run_immediately: bool = True, keep_going: bool = False, sleep: Callable[[float], None] = time.sleep, turns: int | None = None) -> None:
    """Updates every interval. A failed update ends the loop unless ``keep_going``; ``turns`` bounds it for tests."""
    wait, done = interval_seconds(days), 0

    def attempt() -> None:
        try:
            update()
        except Exception:  # noqa: BLE001
            if not keep_going:
                raise

    if run_immediately:
        attempt()
    while turns is None or done < turns:
        sleep(wait)
        attempt()
        done += 1


def stream(spark: SparkSession, folder: str, schema, each_batch: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """New Parquet files of a folder in micro-batches: what is there now, or on an interval such as "7 days"."""
    writer = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
