"""Document fingerprints by randomised edit embedding.

Every character of a text is repeated a random number of times; how often is read from shared tables that
depend on the place reached so far and on the character.  Two texts that differ by few insertions, deletions
and replacements fall into step again soon after each edit, so that edit distance becomes the number of
places at which the two embedded strings differ.  The fingerprint keeps bits of sampled places.  Places are
sampled consistently: a slot's place depends on the length of the text alone, and changes seldom with it.

A walk starts afresh every RESTART characters, so that all stretches of all texts of a batch walk at once.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerlake import session
from tickerlake.llm import common, ordered
from tickerlake.llm.components import components

WALKS = 2
BITS = 512
RESTART = 4096
PERIOD = 512
CLASSES = 256
PAD = CLASSES
SLICE_BYTES = 4_000_000
#: Stretches that walk at once.
PIECES = 1024
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


@functools.cache
def jumps() -> np.ndarray:
    """Flat (walk, class, place): how often the character is repeated when its first copy stands at the place."""
    moves = (common.mix(np.arange(WALKS * CLASSES * PERIOD)) & common.U64(1)).astype(bool).reshape(-1, PERIOD)
    moves[:, 127::128] = True
    place = np.where(np.hstack([moves, moves]), np.arange(2 * PERIOD), 4 * PERIOD)
    ahead = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, :PERIOD]
    return (ahead - np.arange(PERIOD) + 1).astype(np.intp).ravel()


@functools.cache
def records() -> np.ndarray:
    """(slot, k): places that a slot takes up one after the other while a text grows; the last one inside it is
    spread evenly over the text."""
    out = np.zeros((BITS, 96))
    for k in range(1, out.shape[1]):
        out[:, k] = np.minimum(np.floor((out[:, k - 1] + 1) / common.unit(np.arange(BITS) + BITS * k + (1 << 40))), 2.0**60)
    return out.astype(np.int64)


@functools.cache
def earliest() -> np.ndarray:
    """The smallest place of any slot after k moves."""
    return records().min(axis=0)


@functools.cache
def faces() -> np.ndarray:
    """(slot, class): the bit that stands for a character in a slot."""
    return (common.mix(np.arange(BITS * (CLASSES + 1)) + (1 << 41)) & common.U64(1)).astype(bool).reshape(BITS, CLASSES + 1)


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    wide = points >= CLASSES
    out = points.astype(np.uint8)
    if wide.any():
        out[wide] = (common.mix(points[wide]) & common.U64(CLASSES - 1)).astype(np.uint8)
    return out


def walk(pieces: list[np.ndarray], begin: np.ndarray) -> list[np.ndarray]:
    """For every piece (at most RESTART characters) the places, (walk, character), behind each character's copies.

    begin: (walk, piece), where the first copy stands.  All pieces take each step together, the longest first.
    """
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    rank = np.empty(len(pieces), dtype=np.int64)
    rank[order] = np.arange(len(pieces))
    active = len(pieces) - np.searchsorted(np.sort(sizes), np.arange(sizes.max() if len(pieces) else 0), side="right")
    start = np.concatenate([[0], np.cumsum(active)])
    symbols = np.empty(start[-1], dtype=np.uint8)
    for r, piece in zip(rank, pieces):
        symbols[start[: len(piece)] + r] = piece
    symbols = symbols.astype(np.intp) * PERIOD
    ends = np.empty((WALKS, start[-1]), dtype=np.uint16)
    key = np.empty(len(pieces), dtype=np.intp)
    for w in range(WALKS):
        table = jumps()[w * CLASSES * PERIOD : (w + 1) * CLASSES * PERIOD]
        at = begin[w, order].astype(np.intp)
        for a, n in zip(start.tolist(), active.tolist()):
            at = at[:n]
            k = np.bitwise_and(at, PERIOD - 1, out=key[:n])
            k += symbols[a : a + n]
            at = at + table[k]
            ends[w, a : a + n] = at
    return [ends.take(start[: len(p)] + r, axis=1) for r, p in zip(rank, pieces)]


def walk_all(pieces: list[np.ndarray], begin: np.ndarray) -> list[np.ndarray]:
    """The walks of any number of pieces, PIECES at a time: what a long text takes besides its walks is bounded."""
    return [ends for a in range(0, len(pieces), PIECES) for ends in walk(pieces[a : a + PIECES], begin[:, a : a + PIECES])]


class Embedded:
    """A text with its walks, block by block."""

    def __init__(self, chars: np.ndarray):
        self.chars, self.blocks = chars, []

    def bits(self) -> np.ndarray:
        n, out = len(self.chars), np.zeros(BITS, dtype=bool)
        if not n:
            return out
        slots, per = np.arange(BITS), BITS // WALKS
        rec = records()[:, : np.searchsorted(earliest(), 2 * n)]
        place = rec[slots, (rec < 2 * n).sum(axis=1) - 1]
        block, inside = place // (2 * RESTART), place % (2 * RESTART)
        seen = np.full(BITS, PAD)
        for b in [0] if n <= RESTART else np.unique(block).tolist():
            ends = self.blocks[b]
            for w in range(WALKS):
                mine = slice(w * per, (w + 1) * per) if n <= RESTART else np.flatnonzero(block[w * per : (w + 1) * per] == b) + w * per
                i = np.searchsorted(ends[w], inside[mine].astype(np.uint16), side="right")
                seen[mine] = np.where(i < ends.shape[1], self.chars[np.minimum(b * RESTART + i, n - 1)], PAD)
        return faces()[slots, seen]


def embed(texts: list[str]) -> list[Embedded]:
    out = [Embedded(classes(t)) for t in texts]
    cut = [(e, e.chars[a : a + RESTART]) for e in out for a in range(0, len(e.chars), RESTART)]
    for (e, _), ends in zip(cut, walk_all([p for _, p in cut], np.zeros((WALKS, len(cut))))):
        e.blocks.append(ends)
    return out


def embed_changed(old: list[Embedded], texts: list[str], kept: list[int]) -> list[Embedded]:
    """Texts that begin with the first kept[i] characters of old[i]: walks go on from there."""
    out, cut, heads, begin = [], [], [], []
    for was, text, k in zip(old, texts, kept):
        e = Embedded(np.concatenate([was.chars[:k], classes(text[k:])]))
        whole = k // RESTART
        e.blocks = list(was.blocks[:whole])
        for a in range(whole * RESTART, len(e.chars), RESTART):
            head = was.blocks[whole][:, : k - a] if k > a else np.empty((WALKS, 0), dtype=np.uint16)
            cut.append((e, e.chars[max(a, k) : a + RESTART]))
            heads.append(head)
            begin.append(head[:, -1] if head.shape[1] else np.zeros(WALKS))
        out.append(e)
    for (e, _), head, ends in zip(cut, heads, walk_all([p for _, p in cut], np.array(begin).reshape(-1, WALKS).T)):
        e.blocks.append(np.hstack([head, ends]) if head.shape[1] else ends)
    return out


def embed_bits(texts: list[str]) -> np.ndarray:
    """(text, BITS) sampled bits of the embedded strings; equal texts have equal bits."""
    return stacked(embed(texts))


def stacked(embedded: list[Embedded]) -> np.ndarray:
    return np.array([e.bits() for e in embedded]).reshape(-1, BITS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of agreeing places: differing bits are half of the differing places."""
    return np.maximum(0.0, 1.0 - 2.0 * (a != b).sum(axis=-1) / BITS)


def as_hex(bits: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in np.packbits(bits, axis=1)]


def edit(text: str, after: str) -> str:
    """The last half of a text, rounded down, replaced by as much of the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness.

    docs: doc_id, text (further columns are ignored).  Documents stand in ascending doc_id; a missing doc_id
    comes first, equal ids are ordered by text, and repeated rows follow each other, each giving its own row.
    A null text is empty; the fingerprint of an empty text has no bit set.  The last document is followed by
    the first, a single document by itself.  An empty table gives an empty result.
    """
    docs = common.documents(docs)
    firsts, nulls = ordered.bounds(docs)

    def run(batches):
        held = None  # (doc_id, text, embedded) of a row whose next one is not known yet
        for batch in common.slices(batches, "text", SLICE_BYTES):
            tails, ids, texts = (batch.column(k).to_pylist() for k in (1, 2, 3))
            if held is None and tails[0]:
                continue
            keep = tails.index(True) + 1 if True in tails else len(tails)  # the first tail row is the last that counts
            ids, texts, last_is_tail = ids[:keep], texts[:keep], tails[keep - 1]
            rows = ([held[:2]] if held else []) + list(zip(ids, texts))
            pairs = list(zip(rows, rows[1:]))
            changed = [edit(x[1], y[1]) for x, y in pairs]
            own = embed(texts)
            was = own if held is None else [held[2], *own]
            now = stacked(was)
            edited = stacked(embed_changed(was, changed, [len(x[1]) - len(x[1]) // 2 for x, _ in pairs]))
            if pairs:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x, _ in pairs], pa.int64()),
                        pa.array([len(x[1]) for x, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                        pa.array(as_hex(now[:-1])),
                        pa.array(as_hex(edited)),
                        pa.array(likeness(now[:-1], edited)),
                        pa.array(likeness(now[:-1], now[1:])),
                    ],
                    OUT.replace(" long", "").replace(" string", "").replace(" double", "").split(", "),
                )
            held = None if last_is_tail else (*rows[-1], was[-1])

    return ordered.deal(docs, firsts, nulls, with_next=True).mapInArrow(run, OUT)


# --- near-duplicates by banding and verification ------------------------------------------------

#: Bands, bits sampled for each, likeness of a link, largest group that is linked in one go, rows of a part of larger ones.
BANDS, BAND_BITS = 48, 20
THRESHOLD = 0.8
LARGE, PART = 64, 512
#: Largest bucket that is split by two words of its members, pairs compared at once, and how likely the words may hide a link.
MANY, AT_ONCE, MISSED = 1024, 1 << 21, 1e-9
WORDS64 = BITS // 64


@functools.cache
def sampled() -> np.ndarray:
    """(band, k): the bits that make a band's key."""
    return (common.mix(np.arange(BANDS * BAND_BITS) + (1 << 42)) % common.U64(BITS)).astype(np.int64).reshape(BANDS, BAND_BITS)


def band_keys(bits: np.ndarray) -> np.ndarray:
    """(fingerprint, band) keys."""
    return (bits[:, sampled()] << np.arange(BAND_BITS)).sum(axis=2).astype(np.int32)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every document."""

    def run(batches):
        for batch in common.slices(batches, "text", SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(as_hex(embed_bits(batch.column(1).to_pylist())))], ["doc_id", "fingerprint"])

    return common.documents(docs).mapInArrow(run, "doc_id long, fingerprint string")


def with_bands(nodes: DataFrame) -> DataFrame:
    """(node, bits array<long>, bands array<int>) of nodes (node long, fingerprint)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                packed = np.frombuffer(bytes.fromhex("".join(batch.column(1).to_pylist())), dtype=np.uint8).reshape(batch.num_rows, -1)
                words, keys = packed.view(">i8").astype(np.int64), band_keys(np.unpackbits(packed, axis=1))
                columns = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(kind)) for x, kind in ((words, pa.int64()), (keys, pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["node", "bits", "bands"])

    return nodes.select("node", "fingerprint").mapInArrow(run, "node long, bits array<long>, bands array<int>")


def most_apart(threshold: float) -> int:
    return int((1 - threshold) / 2 * BITS)


def most_in_words(most: int, bits: int = 128) -> int:
    """In how many of ``bits`` bits two fingerprints may differ that differ in ``most`` of all bits, but for a chance of MISSED."""
    beyond = 0.0
    for n in range(bits, -1, -1):
        beyond += math.comb(most, n) * math.comb(BITS - most, bits - n) / math.comb(BITS, bits)
        if beyond > MISSED:
            return n
    return 0


def groups(words: list[np.ndarray], most: int) -> np.ndarray:
    """(bucket, member): the first member of the bucket that is reached over words at most ``most`` bits apart together."""
    near = sum(np.bitwise_count(w[:, :, None] ^ w[:, None, :]) for w in words) <= most
    size = near.shape[1]
    found = np.broadcast_to(np.arange(size), near.shape[:2])
    while True:
        least = np.where(near, found[:, None, :], size).min(axis=2)
        least = np.take_along_axis(least, least, axis=1)
        if np.array_equal(least, found):
            return found
        found = least


def met(buckets: DataFrame, most: int) -> DataFrame:
    """(bucket, leader, n, node) of the members of (bucket, node, one, other) that may be near another one of their bucket.

    A bucket's members fall into groups by two words of their fingerprints, which hold apart those that share a band by
    chance; ``leader`` is the smallest node of a group and n its members.  A bucket of more than MANY members is a
    group as it is, with MANY + 1 for n.
    """
    limit = most_in_words(most)

    def out(bucket: np.ndarray, leader: np.ndarray, n: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (bucket, leader, n, node)], ["bucket", "leader", "n", "node"])

    def split(bucket: np.ndarray, node: np.ndarray, *words: np.ndarray):
        """The groups of whole buckets, those of one size together."""
        _, first, sizes = np.unique(bucket, return_index=True, return_counts=True)
        for size in np.unique(sizes[sizes > 1]).tolist():
            starts, step = first[sizes == size], max(1, AT_ONCE // size**2)
            for a in range(0, len(starts), step):
                at = starts[a : a + step, None] + np.arange(size)
                if size > MANY:
                    yield out(bucket[at].ravel(), np.repeat(node[at[:, 0]], size), np.full(at.size, MANY + 1), node[at].ravel())
                    continue
                found = groups([w[at].view(np.uint64) for w in words], limit)
                n = (found[:, :, None] == found[:, None, :]).sum(axis=2)
                kept = n > 1
                yield out(bucket[at][kept], np.take_along_axis(node[at], found, axis=1)[kept], n[kept], node[at][kept])

    def run(batches):
        held, wide = [np.empty(0, dtype=np.int64)] * 4, None  # the bucket that may go on; (bucket, leader) of one above MANY
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns)]
            if wide is not None:
                own = np.searchsorted(rows[0], wide[0], side="right")
                if own:
                    yield out(rows[0][:own], np.full(own, wide[1]), np.full(own, MANY + 1), rows[1][:own])
                rows = [r[own:] for r in rows]
            if len(rows[0]):
                last = np.searchsorted(rows[0], rows[0][-1])
                wide = None
                if last:
                    yield from split(*(r[:last] for r in rows))
                rows = [r[last:] for r in rows]
                if len(rows[0]) > MANY:
                    wide = rows[0][0], rows[1][0]
                    yield out(rows[0], np.full(len(rows[0]), wide[1]), np.full(len(rows[0]), MANY + 1), rows[1])
                    rows = [r[:0] for r in rows]
            held = rows
        if len(held[0]):
            yield from split(*held)

    dealt = buckets.select("bucket", "node", "one", "other").repartition("bucket").sortWithinPartitions("bucket", "node")
    return dealt.mapInArrow(run, "bucket long, leader long, n long, node long")


def trees(nodes: np.ndarray, words: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that connect whatever the verified pairs of these fingerprints connect, fewer than there are nodes."""
    root = np.arange(len(nodes))
    out = []
    for i in range(len(nodes)):
        near = np.flatnonzero(np.bitwise_count(words[: i + 1] ^ words[i]).sum(axis=1) <= most)
        groups = np.unique(root[near])
        out += [(nodes[g], nodes[i]) for g in groups if g != i]
        root[np.isin(root, groups)] = i
    return out


def forest(pdf: pd.DataFrame, most: int) -> pd.DataFrame:
    """``trees`` of a part."""
    nodes = pdf["node"].to_numpy()
    words = np.array(pdf["bits"].tolist(), dtype=np.int64).view(np.uint64).reshape(len(nodes), WORDS64)
    return pd.DataFrame(trees(nodes, words, most), columns=["a", "b"])


def apart(a: str, b: str):
    """Bits in which two fingerprints differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def thinned(links: DataFrame) -> DataFrame:
    """Links (a, b) that connect what all of them connect, each once, hardly more than there are nodes.

    In the place of b the smallest of its smaller neighbours, c, is linked with the others.  That makes no link more and
    connects the same, and links that members of a group have found in many bands fall together.  It is repeated while
    it takes a tenth of them away.  The new links connect, but are not verified pairs.
    """

    def once(found: DataFrame) -> DataFrame:
        return session.stage(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")

    kept = once(links)
    n, was = kept.count(), math.inf
    while n < 0.9 * was:
        told = kept.withColumn("c", F.min("a").over(Window.partitionBy("b")))  # neighbours within groups of LARGE, and leaders
        first, others = told.where("a = c").select("a", "b"), told.where("a > c").select(F.col("c").alias("a"), F.col("a").alias("b"))
        kept, was = once(first.unionByName(others)), n
        n = kept.count()
    return kept


def linked(members: DataFrame, most: int) -> DataFrame:
    """(a, b): ``trees`` of every group of (bucket, leader, node, bits), fewer than it has members; no pairs are listed.

    Groups stream through a task in order.  Mostly all members are near the smallest node, which takes no more than that look.
    """

    def links(bucket: np.ndarray, leader: np.ndarray, node: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
        new = np.append(True, (np.diff(bucket) != 0) | (np.diff(leader) != 0))
        first, own = np.flatnonzero(new), np.cumsum(new) - 1
        size = np.diff(first, append=len(node))
        near = np.bitwise_count(words ^ words[first][own]).sum(axis=1) <= most
        star = np.logical_and.reduceat(near, first)
        kept = star[own] & ~new
        more = [x for g in np.flatnonzero(~star & (size > 2)).tolist() for x in trees(*(c[first[g] : first[g] + size[g]] for c in (node, words)), most)]
        a, b = np.array(more, dtype=np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(np.append(node[first][own][kept], a)), pa.array(np.append(node[kept], b))], ["a", "b"])

    def run(batches):
        held = None  # the group that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, leader, node = (c.to_numpy() for c in batch.columns[:3])
            rows = [bucket, leader, node, batch.column(3).flatten().to_numpy().view(np.uint64).reshape(-1, WORDS64)]
            rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
            last = np.flatnonzero((rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]))[0]
            if last:
                yield links(*(x[:last] for x in rows))
            held = [x[last:] for x in rows]
        if held is not None:
            yield links(*held)

    dealt = members.select("bucket", "leader", "node", "bits").repartition("bucket", "leader").sortWithinPartitions("bucket", "leader", "node")
    return dealt.mapInArrow(run, "a long, b long")


def near_links(distinct: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b) of distinct fingerprints (node long, bits, bands) that share a band and are verified on all bits.

    A bucket is moved once, with two words of each member, and split by them (``met``); bits are brought to the members that
    are left.  A group of up to LARGE members is linked in one go.  In a larger one those near its smallest node are linked with it, which connects
    whatever pairs they form.  Only the others, in parts of about PART, meet all members, each two parts in a task of
    their own that returns enough links to connect its members, so that no pair is lost and none but links are written.
    Links found in several bands are repeated.
    """
    most, group = most_apart(threshold), ["bucket", "leader"]
    keyed = distinct.select("node", "bits", F.posexplode("bands").alias("band", "key"))
    one, other = (F.get("bits", (F.col("band") + k) % WORDS64) for k in (0, 3))  # the bands take turns, so that no link hangs on two words alone
    shared = met(keyed.select((F.col("band") * F.lit(1 << BAND_BITS).cast("long") + F.col("key")).alias("bucket"), "node", one.alias("one"), other.alias("other")), most)
    shared = session.stage(shared.join(distinct.select("node", "bits"), "node"), "bands")
    small = linked(shared.where(F.col("n") <= LARGE), most)
    leaders = distinct.select(F.col("node").alias("leader"), F.col("bits").alias("leading"))
    large = shared.where(F.col("n") > LARGE).join(leaders, "leader")
    large = session.stage(large.select(*group, "node", "bits", (apart("bits", "leading") <= most).alias("near")), "large")
    stars = large.where("near and node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    sizes = large.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(~F.col("near")).alias("others")).where("others > 0")
    left = large.join(sizes, group)
    all_parts, other_parts = (F.ceil(F.col(x) / PART).cast("int") for x in ("n", "others"))
    own = F.xxhash64("node", "bucket")
    one_side = left.where("not near").withColumn("i", F.pmod(own, other_parts).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), all_parts - 1)))
    other_side = left.withColumn("j", F.pmod(own, all_parts).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), other_parts - 1)))
    both = one_side.select(*group, "i", "j", "node", "bits").unionByName(other_side.select(*group, "i", "j", "node", "bits"))
    rest = both.groupBy(*group, "i", "j").applyInPandas(lambda pdf: forest(pdf.drop_duplicates("node"), most), "a long, b long")
    return small.unionByName(stars).unionByName(rest)


def classes_of(prints: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(fingerprint, class_id, class_size) of every fingerprint in prints (doc_id, fingerprint): the smallest doc_id
    reachable over links, and the rows of the class."""
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id())
    distinct = session.stage(distinct, "distinct")
    found = components(thinned(near_links(session.stage(with_bands(distinct), "prints"), threshold)))
    whole = distinct.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = whole.groupBy("component").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    return whole.join(named, "component").select("fingerprint", "class_id", "class_size")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, fingerprint, class_id) of every document; class_id is the smallest doc_id reachable over links.

    Null texts are empty; repeated rows are repeated; class_id is null only where no document of a class has an id;
    an empty table gives an empty result.
    """
    prints = session.stage(fingerprints(docs), "prints")
    return prints.join(classes_of(prints, threshold), "fingerprint").select("doc_id", "fingerprint", "class_id")


def with_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of with_next with class_id and class_size: the class of near-duplicates that a document belongs to
    and its rows.  A document without near-duplicates is a class of its own."""
    rows = session.stage(with_next(docs), "fingerprints")
    return rows.join(classes_of(rows, threshold), "fingerprint").select(*rows.columns, "class_id", "class_size")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_classes(common.table(spark, sf_dir, "documents"))
