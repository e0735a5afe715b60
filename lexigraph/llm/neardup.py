"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

A text's shingles are runs of five words (letters and digits in lower case; fewer words make one shingle). A shingle
weighs one plus the logarithm of its occurrences, times its inverse document frequency. Document frequencies are counted
over all documents in a table of fixed size that shingles share by hash; what chance alone puts into an entry is taken
off, so frequent shingles are told from the rest at any size of the corpus. Frequencies are normalised, from 1 for a
shingle of every document to nearly 2 for one of a single document. Texts that agree in a band of samples are candidates; a
candidate pair whose weighted Jaccard similarity is at least ``threshold`` is a link; linked texts and exact copies form a
class.

Exact copies meet by digest alone. Within a band's bucket every text is compared with one leader, the text that shares
most buckets. Where a bucket's texts are then still in different classes, those outside its largest class are compared
with all others in blocks of bounded size, where a matrix product gives all similarities at once and only links leave
the task. So pairs are never listed, and no pair of texts that agree in a band is skipped.

Null texts are empty texts; texts without words are in a class with their exact copies only. A class goes by its least
doc_id. Where different texts share a doc_id, it names the class of the text of least digest; a class that no doc_id names,
as one of rows without any, has a negative class_id from its digest. One row of each class is kept: of the doc_id that
names it the first. An empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, durable, release, slices, text_or_empty, unused
from .graph import components

WORDS, THRESHOLD, EPSILON = 5, 0.8, 1e-9
BANDS, ROWS = 16, 4
#: Entries of the document frequency table, and of the pieces in which tasks hand theirs over.
FREQUENCIES, PIECE = 1 << 20, 1 << 14
#: Standard deviations of what chance puts into an entry that are taken off besides its mean.
CHANCE = 3.0
#: Elements that one sampling step holds, texts and bytes in a block of a scanned bucket, and elements that a task keeps.
BLOCK, SCAN, SCAN_BYTES, KEPT_ELEMENTS = 4096, 256, 16 << 20, 4_000_000
#: Parts of a large class when its least doc_id is joined to its texts.
SALTS = 16
#: Expected samples below the first bound of a text's search, and the factor by which a bound that held none grows.
BOUND, WIDER = 3.0, 4.0
#: Bytes that are hashed at once, and bytes of a word up to which it is hashed with others.
TEXT_BLOCK, LONGEST = 1 << 18, 1 << 16
#: Stands for a missing doc_id.
NO_ID = (1 << 63) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_bytes() -> np.ndarray:
    """Which bytes belong to words: ASCII letters and digits, and all beyond ASCII."""
    table = np.zeros(256, bool)
    table[[ord(c) for c in string.ascii_letters + string.digits]] = True
    table[128:] = True
    return table


_WORD = word_bytes()
#: A word's hash sums its bytes times keys by place, which are random but the same in every task.
_KEYS = np.random.default_rng(29).integers(0, 1 << 64, LONGEST + 1, np.uint64)


def long_hash(word: bytes) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little") | 1)


def block_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a byte block that begins and ends between words."""
    inside = np.concatenate(([False], _WORD[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    origin = np.zeros(len(raw), np.int32)
    origin[starts] = starts
    place = np.minimum(np.arange(len(raw), dtype=np.int32) - np.maximum.accumulate(origin), LONGEST)
    sums = np.add.reduceat((raw * inside[1:-1] + inside[1:-1]).astype(np.uint64) * _KEYS[place], starts)
    h = np.maximum(mixed(mixed(sums + (ends - starts).astype(np.uint64))), np.uint64(1))
    for i in np.flatnonzero(ends - starts > LONGEST):
        h[i] = long_hash(raw[starts[i] : ends[i]].tobytes())
    return h, starts


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """64 bits for each word of each text, over the bytes of many texts at once; words of more than LONGEST bytes alone."""
    if not texts:
        return []
    parts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    found, places, at = [], [], 0
    while at < len(raw):
        end = min(at + TEXT_BLOCK, len(raw))
        while end < len(raw) and _WORD[raw[end - 1]]:
            gap = np.flatnonzero(~_WORD[raw[end : end + 4096]])
            end += int(gap[0]) + 1 if len(gap) else 4096
        end = min(end, len(raw))
        own = end
        if end - at > TEXT_BLOCK + LONGEST:  # the last word goes alone
            before = np.flatnonzero(~_WORD[raw[at : at + TEXT_BLOCK]])
            own = at + int(before[-1]) + 1 if len(before) else at
        if own > at:
            h, starts = block_hashes(raw[at:own])
            found.append(h)
            places.append(starts + at)
        if own < end:
            last = end - 1 if not _WORD[raw[end - 1]] else end
            found.append(np.array([long_hash(raw[own:last].tobytes())]))
            places.append(np.array([own]))
        at = end
    cuts = np.searchsorted(np.concatenate(places), np.cumsum([len(p) + 1 for p in parts])[:-1])
    return np.split(np.concatenate(found), cuts)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def entry_of(h: np.ndarray) -> np.ndarray:
    """A shingle's entry in the table of document frequencies."""
    return (h >> np.uint64(64 - FREQUENCIES.bit_length() + 1)).astype(np.int64)


def counted(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in ascending order, and their occurrences."""
    if not len(words):
        return words, np.zeros(0, np.int64)
    n = min(WORDS, len(words))
    many = len(words) - n + 1
    h = np.zeros(many, np.uint64)
    for i in range(n):
        h = mixed(h + words[i : i + many])
    h = np.sort(h)
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[first], np.diff(np.append(first, many))


def shingles(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes in ascending order, their inverse document frequencies and occurrences."""
    h, times = counted(words)
    return h, idf[entry_of(h)].astype(np.float64), times


def elements(h: np.ndarray, idf: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One hash and weight an occurrence, each the increase of ``damped``: what two texts' elements have in common then
    weighs what the weighted minimum does."""
    if not len(h) or times.max() == 1:
        return h, idf
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return mixed(np.repeat(h, times) + nth.astype(np.uint64)), np.repeat(idf, times) * (damped(nth + 1) - np.where(nth > 0, damped(np.maximum(nth, 1)), 0))


def damped(times: np.ndarray) -> np.ndarray:
    """The weight of occurrences: 1 + ln."""
    return 1 + np.log(times)


def similarities(texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weighted Jaccard similarity of all texts' elements to each other."""
    sizes = [len(h) for h, _ in texts]
    weight = np.concatenate([w for _, w in texts])
    _, first, where, times = np.unique(np.concatenate([h for h, _ in texts]), return_index=True, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(texts)), sizes)
    column = np.cumsum(times > 1) - 1
    both = times[where] > 1
    owner, at, root = owner[both], column[where[both]], np.sqrt(weight[first][times > 1])
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    common = np.zeros((len(texts), len(texts)))
    for low in range(0, len(root), 2048):
        a, b = np.searchsorted(at, [low, low + 2048])
        held = np.zeros((len(texts), min(2048, len(root) - low)))
        held[owner[a:b], at[a:b] - low] = root[at[a:b]]
        common += held @ held.T
    total = np.bincount(np.repeat(np.arange(len(texts)), sizes), weight, len(texts))
    either = total[:, None] + total[None, :] - common
    return np.divide(common, either, out=np.zeros_like(common), where=either > 0)


class Curve:
    """A function on an even grid, by linear interpolation; its ends hold beyond it."""

    def __init__(self, x: np.ndarray, y: np.ndarray, points: int = 1 << 13):
        self.low, self.scale, self.most = x[0], (points - 1) / (x[-1] - x[0]), points - 1
        self.y = np.interp(np.linspace(x[0], x[-1], points), x, y)
        self.rise = np.append(np.diff(self.y), 0)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        place = np.clip((x - self.low) * self.scale, 0, self.most)
        cell = place.astype(np.int64)
        return self.y[cell] + self.rise[cell] * (place - cell)


def tail_curves() -> tuple[Curve, Curve, Curve]:
    """ln x by the logit of F(x) = x E1(x) + 1 - exp(-x), ln E1(x) by ln x, and ln x by -ln E1(x); E1 is the exponential integral."""
    s = np.linspace(-34, 4, 1 << 16)
    x = np.exp(s)
    slope = np.exp(-x)
    parts = (slope[1:] + slope[:-1]) / 2 * np.diff(s)
    e1 = np.append(np.cumsum(parts[::-1])[::-1], 0) + slope[-1] / (x[-1] + 1)
    logit = np.log(x * e1 - np.expm1(-x)) - np.log(slope - x * e1)
    inside = np.abs(logit) < 24
    return Curve(logit[inside], s[inside]), Curve(s, np.log(e1)), Curve(-np.log(e1), s)


class Sampler:
    """Improved consistent weighted sampling. An element's hash draws its gamma variates r and c and its uniform beta anew
    in each sample, so that however many elements a text has, no two share them.

    An element's value c exp(-r (t - beta + 1)) is at least x / weight with x = c exp(-r). The density of x is E1(x), so 32
    bits of hash give F(x) and most elements are passed over by comparing them; for the others c follows from x: m has the
    density exp(-m) / m beyond x, and c exceeds m by an exponential variate.
    """

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, k = bands, rows, bands * rows
        self.odd = (rng.integers(0, 1 << 31, k, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.shift = rng.integers(0, 1 << 32, k, dtype=np.uint32)
        self.salt = rng.integers(0, 1 << 63, k, dtype=np.uint64)
        self.ln_x_of, self.ln_e1_of, self.ln_beyond_of = tail_curves()

    def drawn(self, h: np.ndarray, ln_weight: np.ndarray, u: np.ndarray, sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The logarithm of each element's value in its sample, and t."""
        bits = mixed(mixed(h + self.salt[sample]))
        beta = (mixed(bits + _MIX) >> np.uint64(11)) * 2.0**-53
        first, second = ((b + 0.5) * 2.0**-32 for b in (bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF)))
        below = u + 0.5
        ln_x = self.ln_x_of(np.log(below / (2.0**32 - below)))
        ln_c = np.log(np.exp(self.ln_beyond_of(-self.ln_e1_of(ln_x) - np.log(first))) - np.log(second))
        r = np.maximum(ln_c - ln_x, 1e-12)
        t = np.floor(ln_weight / r + beta)
        return ln_c - r * (t - beta + 1), t.astype(np.int64)

    def samples(self, h: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """bands * rows identities (element and its weight's step) of a text's samples."""
        return self.samples_of([(h, weight)])[:, 0]

    def samples_of(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """A column of samples for each text with elements: in each sample the element of least value.

        All elements that can lie below a text's bound are drawn; a sample whose least value does not is searched again.
        """
        n, sizes = len(texts), np.array([len(h) for h, _ in texts])
        h, weight = (np.concatenate(c) for c in zip(*texts))
        text, start = np.repeat(np.arange(n), sizes), np.cumsum(sizes) - sizes
        small, ln_weight = (h >> np.uint64(32)).astype(np.uint32), np.log(weight)
        bound = BOUND / np.bincount(text, weight, n)
        least, out = np.full(len(self.odd) * n, np.inf), np.zeros(len(self.odd) * n, np.uint64)

        def keep(sample: np.ndarray, at: np.ndarray, u: np.ndarray) -> None:
            """Elements ``at`` with their hashes, in order of sample and text."""
            if not len(at):
                return
            value, t = self.drawn(h[at], ln_weight[at], u, sample)
            cell = sample * n + text[at]
            starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            here = np.minimum.reduceat(value, starts)
            hits = np.flatnonzero(value == np.repeat(here, np.diff(np.append(starts, len(cell)))))
            best = hits[np.searchsorted(hits, starts)][here < least[cell[starts]]]
            least[cell[best]] = value[best]
            out[cell[best]] = mixed(h[at[best]] + t[best].astype(np.uint64))

        reach = reached(weight * bound[text])
        for a in range(0, len(h), BLOCK):
            u = bits_of(small[None, a : a + BLOCK], self.odd[:, None], self.shift[:, None])
            near = np.flatnonzero(u <= reach[None, a : a + BLOCK])
            sample, at = np.divmod(near, u.shape[1])
            keep(sample, at + a, u.ravel()[near])
        left = np.arange(len(least))
        while len(left := left[least[left] > np.log(bound)[left % n]]):
            bound = bound * WIDER
            sizes_left = sizes[left % n]
            ends = np.cumsum(sizes_left)
            for a in range(0, ends[-1], 64 * BLOCK):
                item = np.arange(a, min(a + 64 * BLOCK, ends[-1]))
                of = np.searchsorted(ends, item, "right")
                sample, at = left[of] // n, start[left[of] % n] + item - (ends - sizes_left)[of]
                u = bits_of(small[at], self.odd[sample], self.shift[sample])
                near = np.flatnonzero(u <= reached(weight[at] * bound[text[at]]))
                keep(sample[near], at[near], u[near])
        return out.reshape(-1, n)

    def buckets(self, texts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[list[int]]:
        """One signed 64-bit bucket a band for each text, given as ``shingles`` does."""
        out: list[list[int]] = [[] for _ in texts]
        there = [i for i, (h, _, _) in enumerate(texts) if len(h)]
        if there:
            s = self.samples_of([(h, idf * damped(times)) for h, idf, times in (texts[i] for i in there)]).reshape(self.bands, self.rows, -1)
            name = np.repeat(np.arange(1, self.bands + 1, dtype=np.uint64)[:, None], len(there), 1)
            for i in range(self.rows):
                name = mixed(name + s[:, i])
            for i, own in zip(there, name.T.view(np.int64).tolist()):
                out[i] = own
        return out


def bits_of(small: np.ndarray, odd: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """32 bits for an element in a sample."""
    p = small * odd
    p += shift
    p ^= p >> np.uint32(15)
    p *= np.uint32(0x2C1B3C6D)
    p ^= p >> np.uint32(16)
    p *= np.uint32(0x297A2D39)
    return p


def reached(x: np.ndarray) -> np.ndarray:
    """The greatest 32 bits at which F can still be x or less, or a little more."""
    return np.minimum(x * (1 + np.log1p(1 / x)) * 2.0**32 + 1, (1 << 32) - 1).astype(np.uint32)


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Normalised inverse document frequency by a shingle's entry, over all rows: 1 + ln((N + 1) / (df + 1)) / ln(N + 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FREQUENCIES, np.int64), 0
        for batch in slices(batches):
            for words in word_hashes(batch.column(0).to_pylist()):
                np.add.at(df, entry_of(counted(words)[0]), 1)
            n += batch.num_rows
        pieces = [df[a : a + PIECE] for a in range(0, FREQUENCIES, PIECE)]
        full = [i for i, p in enumerate(pieces) if p.any()]
        yield pa.RecordBatch.from_pydict({"piece": pa.array([*full, -1], pa.int32()), "held": pa.array([*(pieces[i].tobytes() for i in full), np.int64(n).tobytes()], pa.binary())})

    def added(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, total = None, 0
        for batch in group:
            for i, held in zip(*(c.to_pylist() for c in batch.columns)):
                piece, total = i, total + np.frombuffer(held, np.int64)
        yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int32()), "held": pa.array([total.tobytes()], pa.binary())})

    # One piece of each kind from a task; FREQUENCIES numbers and one more come to the driver, whatever the corpus
    got = docs.select("text").mapInArrow(run, "piece int, held binary").groupBy("piece").applyInArrow(added, "piece int, held binary").toArrow()
    out, n = np.zeros(FREQUENCIES), 0
    for piece, held in zip(got["piece"].to_pylist(), got["held"].to_pylist()):
        if piece < 0:
            n = int(np.frombuffer(held, np.int64)[0])
        else:
            out[piece * PIECE : (piece + 1) * PIECE] = np.frombuffer(held, np.int64)
    chance = out.sum() / FREQUENCIES
    df = np.clip(out - np.floor(chance + CHANCE * np.sqrt(chance)), 1, max(n, 1))
    return (1 + np.log((n + 1) / (df + 1)) / np.log(n + 2)).astype(np.float32)


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, digest, class_id, kept) for every row; class_id names the class, and one row of it is kept."""
    spark = docs.sparkSession
    docs = docs.select(identity().alias("doc_id"), text_or_empty().alias("text"))
    docs = docs.withColumn("digest", digest_of("text"))
    idf = spark.sparkContext.broadcast(document_frequencies(docs))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, row = Sampler(), TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            distinct = list(dict.fromkeys(texts))
            made = dict(zip(distinct, sampler.buckets([shingles(words, idf.value) for words in word_hashes(distinct)])))
            rows, sizes = pa.array(range(row, row + len(texts)), pa.int64()), pa.array([len(t) for t in texts], pa.int64())
            row += len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), rows, sizes, pa.array([made[t] for t in texts], pa.list_(pa.int64()))], ["doc_id", "digest", "row", "size", "buckets"])

    signed = durable(docs.mapInArrow(sampled, "doc_id bigint, digest binary, row bigint, size bigint, buckets array<bigint>"), "signed")
    texts = signed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("buckets").alias("buckets"))
    every = durable(texts.select("digest", "doc_id", "size", F.explode("buckets").alias("bucket")), "members")
    # Aggregates are written before they are joined, so that adaptive execution can split a hot bucket or digest
    sizes = durable(every.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    members = durable(every.join(sizes, "bucket"), "shared")
    release(every, sizes)
    wanted = members.groupBy("digest", "doc_id").agg(F.sum("n").alias("central"))
    leaders = members.join(wanted, ["digest", "doc_id"]).groupBy("bucket").agg(F.max(F.struct("central", "digest"))["digest"].alias("leader"))
    leaders = durable(leaders, "leaders")
    texts = durable(docs.join(wanted, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"]).select("digest", "text"), "candidates")
    pairs = members.join(leaders, "bucket").where("digest <> leader").select(F.least("leader", "digest").alias("a"), F.greatest("leader", "digest").alias("b")).distinct()
    links = _verified(pairs, texts, idf, threshold)
    found = components(links)
    placed = members.select("bucket", "digest", "size").join(found.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    placed = durable(placed, "placed")
    more = _scanned(placed, texts, idf, threshold)
    release(members, leaders, placed, texts)
    if not more.isEmpty():
        found = components(links.union(more))
    heads = durable(_heads(signed), "heads")
    linked = durable(found.select(F.col("node").alias("digest"), "component").join(heads, "digest"), "linked")
    salt, salts = F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    named = linked.groupBy("component").agg(F.min("head").alias("head")).select("component", "head", salts)
    named = linked.select("digest", "component", salt).join(named, ["component", "salt"]).select("digest", F.col("head").alias("of_class"))
    classed = durable(heads.join(named, "digest", "left").select("digest", F.coalesce("of_class", "head").alias("head")), "classed")
    release(links, more, found, heads, linked)
    class_id = F.when(F.col("head.doc_id") < NO_ID, F.col("head.doc_id")).otherwise(-1 - F.pmod(F.xxhash64("head.digest"), F.lit(1 << 62)))
    return signed.select("doc_id", "digest", "row").join(classed, "digest").select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "digest", class_id.alias("class_id"), (F.col("row") == F.col("head.row")).alias("kept"))


def _heads(signed: DataFrame) -> DataFrame:
    """(digest, head): each text's least doc_id of those that it owns (NO_ID if none), its digest, and the first row with them.

    Of the texts under one doc_id the one of least digest owns it.
    """
    own = signed.where(F.col("doc_id") < NO_ID).groupBy("doc_id").agg(F.min(F.struct("digest", "row")).alias("at"))
    own = own.groupBy(F.col("at.digest").alias("digest")).agg(F.min(F.struct("doc_id", "at.digest", "at.row")).alias("own"))
    every = signed.groupBy("digest").agg(F.min("row").alias("row"))
    return every.join(own, "digest", "left").select("digest", F.coalesce("own", F.struct(F.lit(NO_ID).alias("doc_id"), "digest", "row")).alias("head"))


def identity() -> Column:
    """doc_id as a number that can be compared; rows without one come last."""
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))


def digest_of(text: str) -> Column:
    return F.unhex(F.sha2(F.encode(text_or_empty(text), "UTF-8"), 256))


def representatives(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class."""
    own_id, own_digest, turn = (unused(name, *docs.columns) for name in ("kept_id", "kept_digest", "kept_turn"))
    keep = classes(docs, threshold).where("kept").select(identity().alias(own_id), F.col("digest").alias(own_digest))
    order = Window.partitionBy(own_id, own_digest).orderBy(own_digest)
    kept = docs.withColumns({own_id: identity(), own_digest: digest_of("text")}).join(keep, [own_id, own_digest], "left_semi")
    return kept.withColumn(turn, F.row_number().over(order)).where(F.col(turn) == 1).select(docs.columns)


def _verified(pairs: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """The pairs (a, b) of digests whose texts' weighted Jaccard similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Table(lambda text: elements(*shingles(word_hashes([text])[0], idf.value)), KEPT_ELEMENTS, lambda value: len(value[0]))
        for batch in slices(batches, "tb"):
            near = [similarities([known[x], known[y]])[0, 1] >= threshold - EPSILON for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.filter(pa.array(near, pa.bool_())).select(["a", "b"])

    with_b = pairs.join(texts.select(F.col("digest").alias("b"), F.col("text").alias("tb")), "b")
    with_both = with_b.join(texts.select(F.col("digest").alias("a"), F.col("text").alias("ta")), "a")
    return durable(with_both.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary"), "links")


def _scanned(placed: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """Links (a, b) between the components that share a bucket; ``placed`` has bucket, digest, size, component.

    A bucket's largest component, its core, is cut into blocks, and so is the rest; every block of the rest meets every
    other block. Blocks of the core need not meet each other.
    """
    told = F.xxhash64("digest")
    held = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"), F.bit_xor(told).alias("x"), F.bit_xor(F.xxhash64(told)).alias("y"))
    # Buckets of the same texts are scanned once
    apart = durable(held.where("low <> high").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket"), "apart")
    rows = placed.join(apart, "bucket")
    parts = rows.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    parts = durable(parts, "parts")
    blocks = lambda n, size: F.ceil(F.greatest(n / SCAN, size / SCAN_BYTES)).cast("int")
    core = parts.groupBy("bucket").agg(F.max(F.struct("n", "bytes", "component")).alias("core"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    core = core.select("bucket", F.col("core.component").alias("core"), blocks(F.col("core.n"), F.col("core.bytes")).alias("in_core"), blocks(F.col("n") - F.col("core.n"), F.col("bytes") - F.col("core.bytes")).alias("in_rest"))
    rows = rows.join(durable(core, "core"), "bucket")
    inside = F.col("component") == F.col("core")
    rows = rows.withColumn("own", F.when(inside, F.col("in_rest") + F.pmod(told, F.col("in_core"))).otherwise(F.pmod(told, F.col("in_rest"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(inside, F.col("in_rest")).otherwise(F.col("in_rest") + F.col("in_core")) - 1)))
    key = ["bucket", "i", "j"]
    rows = rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "digest", "component")
    rows = rows.join(texts, "digest").repartition(*key).sortWithinPartitions(*key).select(*key, "digest", "component", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Table(lambda text: elements(*shingles(word_hashes([text])[0], idf.value)), KEPT_ELEMENTS, lambda value: len(value[0]))

        def links(group: list[tuple]) -> Iterator[tuple[bytes, bytes]]:
            classes = np.unique([g[1] for g in group], return_inverse=True)[1]
            if len(group) > 1 and classes.max() > 0:
                near = np.triu((similarities([g[2] for g in group]) >= threshold - EPSILON) & (classes[:, None] != classes[None, :]))
                for x, y in zip(*np.nonzero(near)):
                    yield group[x][0], group[y][0]

        def found() -> Iterator[tuple[bytes, bytes]]:
            at, group = None, []
            for batch in slices(batches):
                columns = [c.to_pylist() for c in batch.columns]
                for bucket, i, j, digest, component, text in zip(*columns):
                    if (bucket, i, j) != at:
                        yield from links(group)
                        at, group = (bucket, i, j), []
                    group.append((digest, component, known[text]))
            yield from links(group)

        out: list[tuple[bytes, bytes]] = []
        for link in found():
            out.append(link)
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out)], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out)], ["a", "b"])

    return durable(rows.mapInArrow(run, "a binary, b binary"), "across")
