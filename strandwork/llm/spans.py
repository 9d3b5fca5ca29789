"""Long verbatim spans shared between documents (problem 7).

Wanted: every pair of documents that share a span of at least ``SPAN`` code points, and per
document how many of its characters stand in such spans. Suffix automata give matching
statistics, but one automaton over a corpus doesn't fit a worker, and streaming every
document past every shard's automaton costs shards x corpus. So documents are first routed
to the shards they can match:

1. *Routing.* A local minimum rule picks, in every window of ``SPAN`` characters, one
   ``ANCHOR``-gram by its hash; equal windows pick equal grams, so two documents that share a
   span share an anchor. Anchors seen in one text only are dropped. About 2.7 % of all
   positions become rows; whole texts are scanned.
2. *Reference shards.* The shard of an anchor holds, from each document with it, the region
   that any window picking this anchor must lie in. Equal regions are kept once.
3. *Suffix automata.* Per shard of at most ``SHARD`` regions a generalised suffix automaton is
   built; the regions are streamed through it for matching statistics. The states in which a
   match of ``SPAN`` characters ends tell which regions hold it; runs of positions with the
   same holders are maximal spans.
4. *Hot shards*, with more regions than that (boilerplate a little shorter than ``SPAN``),
   go the exact way round the automaton: every ``SPAN``-window of a region becomes a row under
   its 128-bit hash and windows are grouped, so work stays linear and splits over tasks.

The result is a *membership* table ``(span_class, text key, begin, end)``; members of one class
hold the same span. Identical texts are one text throughout and are expanded at the end.
Null texts and texts shorter than ``SPAN`` have no spans. Text is compared as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwork.functions.hashing import content_key
from strandwork.llm.bits import bit_map, bits_for, thin
from strandwork.llm.pairing import pairs_within
from strandwork.runtime import fan_out, settle, spread

SPAN = 200
ANCHOR = 128
SHARD = 48
BATCH_CHARS = 1 << 20
PIECE_ROWS = 5000  # put out at once
_MULTIPLIERS = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def gram_hashes(points: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every ``width``-gram (any width below 256), by doubling."""
    power = (points.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * _MULTIPLIERS[0]
    out, done, size, level = None, 0, 1, 0
    while True:
        if width & size:
            out = power if out is None else out[: len(power) - done] * _MULTIPLIERS[7] + power[done:]
            done += size
        if done == width:
            break
        level += 1
        power = power[:-size] * _MULTIPLIERS[level % 7] + power[size:]
        power ^= power >> np.uint64(29)
        size *= 2
    out = out * _MULTIPLIERS[1]
    return out ^ (out >> np.uint64(31))


def _sliding(op, values: np.ndarray, width: int) -> np.ndarray:
    """``op`` over every run of ``width`` values, by doubling."""
    size, cur = 1, values
    while size * 2 <= width:
        cur = op(cur[:-size], cur[size:])
        size *= 2
    return cur if size == width else op(cur[: len(values) - width + 1], cur[width - size : width - size + len(values) - width + 1])


def anchor_positions(points: np.ndarray, text_starts: np.ndarray, text_ends: np.ndarray, span: int = SPAN, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors in texts laid end to end.

    In every window of ``span`` characters inside one text, at least one occurrence of the
    window's least ``anchor``-gram is kept. Of runs of equal grams (repetitive text) only as
    many are kept as that needs.
    """
    n, reach = len(points), span - anchor + 1
    if n < span:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    hashes = gram_hashes(points, anchor) >> np.uint64(1)
    least = _sliding(np.minimum, hashes, reach)  # one per window of the span's length
    whole = np.ones(len(least), dtype=bool)
    for a, b in zip(text_starts.tolist(), text_ends.tolist()):
        whole[max(a, b - span + 1) : b] = False
    # a gram is kept if it is the least of some whole window around it
    least = np.where(whole, least + np.uint64(1), np.uint64(0))
    padded = np.concatenate([np.zeros(reach - 1, dtype=np.uint64), least, np.zeros(reach - 1, dtype=np.uint64)])
    around = _sliding(np.maximum, padded, reach)
    picked = np.flatnonzero(around == hashes + np.uint64(1))
    value = hashes[picked]
    tied = np.flatnonzero((value[1:] == value[:-1]) & (np.diff(picked) < reach)) + 1
    if len(tied):
        keep = np.ones(len(picked), dtype=bool)
        ties = set(tied.tolist())
        for i in tied.tolist():
            if i - 1 in ties:
                continue
            last, j = picked[i - 1], i  # a chain of equal grams begins at i - 1
            while j in ties:
                # drop j if the next of the chain still overlaps every window past the last kept
                if j + 1 in ties and picked[j + 1] - last <= reach:
                    keep[j] = False
                else:
                    last = picked[j]
                j += 1
        picked, value = picked[keep], value[keep]
    return picked, value


def _batches(texts: list[str], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def keyed_texts(documents: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """``doc_id, k1, k2, text`` of the texts long enough to hold a span; ``k1, k2`` name the text."""
    k1, k2 = content_key(F.col(text))
    return documents.where(F.length(text) >= span).select(F.col(key).alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.col(text).alias("text"))


def anchors(texts: DataFrame, span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    """``k1, k2, h, pos``: the anchors of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            values = batch.column(2).to_pylist()
            for a, b in _batches(values):
                part = values[a:b]
                points = np.frombuffer("".join(part).encode("utf-32-le"), dtype=np.uint32)
                ends = np.cumsum([len(t) for t in part])
                starts = np.concatenate([[0], ends[:-1]])
                at, value = anchor_positions(points, starts, ends, span, anchor)
                own = np.searchsorted(ends, at, side="right")
                yield pa.RecordBatch.from_arrays([pa.array(k1[a:b][own]), pa.array(k2[a:b][own]), pa.array(value.astype(np.int64)), pa.array((at - starts[own]).astype(np.int32))], names=["k1", "k2", "h", "pos"])

    return spread(texts.select("k1", "k2", "text")).mapInArrow(run, "k1 long, k2 long, h long, pos int")


def regions(texts: DataFrame, shared: DataFrame, span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    """``h, k1, k2, begin, r1, r2, region``: the surroundings of each shared anchor, keyed by content."""
    before = span - anchor
    # the set is bounded by the text's own length; copies of a text add nothing to it
    wanted = settle(shared.groupBy("k1", "k2").agg(F.collect_set(F.struct("h", "pos")).alias("at")), "span-wanted")
    bits = bits_for(wanted.count())
    few = thin(texts.select("k1", "k2", "text"), bit_map(wanted, bits, "k1"), bits, "k1")
    each = few.groupBy("k1", "k2").agg(F.first("text").alias("text")).join(wanted, ["k1", "k2"])
    columns = ["h", "k1", "k2", "begin", "r1", "r2", "region"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k1, k2, text, at in zip(pdf["k1"], pdf["k2"], pdf["text"], pdf["at"]):
                for x in at:
                    begin = max(0, x["pos"] - before)
                    region = text[begin : x["pos"] + span]
                    digest = xxhash.xxh3_128_intdigest(region.encode("utf-8"))
                    rows.append((x["h"], k1, k2, begin, (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63), region))
                if len(rows) > PIECE_ROWS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    return each.mapInPandas(run, "h long, k1 long, k2 long, begin int, r1 long, r2 long, region string")


class SuffixAutomaton:
    """A generalised suffix automaton over several texts."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, edges: dict[str, int], link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def add(self, text: str) -> None:
        edges, link, length = self.next, self.link, self.length
        last = 0
        for c in text:
            known = edges[last].get(c)
            if known is not None:
                if length[known] == length[last] + 1:
                    last = known
                    continue
                last = self._split(last, known, c)
                continue
            cur = self._state(length[last] + 1, {}, 0)
            p = last
            while p >= 0 and c not in edges[p]:
                edges[p][c] = cur
                p = link[p]
            if p >= 0:
                q = edges[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, c)
            last = cur

    def _split(self, p: int, q: int, c: str) -> int:
        edges, link, length = self.next, self.link, self.length
        clone = self._state(length[p] + 1, dict(edges[q]), link[q])
        link[q] = clone
        while p >= 0 and edges[p].get(c) == q:
            edges[p][c] = clone
            p = link[p]
        return clone

    def stream(self, text: str, span: int) -> list[int]:
        """Matching statistics: per position, the state of its longest match cut to the least state that still holds the last ``span`` characters; 0 where the match is shorter."""
        edges, link, length = self.next, self.link, self.length
        at = matched = 0
        out = []
        for c in text:
            while at and c not in edges[at]:
                at = link[at]
                matched = length[at]
            if c in edges[at]:
                at, matched = edges[at][c], matched + 1
            while at and length[link[at]] >= span:
                at = link[at]
                matched = length[at]
            out.append(at if matched >= span else 0)
        return out


def shard_spans(texts: list[str], span: int = SPAN) -> list[tuple[int, int, int, int]]:
    """``(bit set of the texts, text, begin, end)`` of the maximal spans that a shard's texts share."""
    automaton = SuffixAutomaton()
    for t in texts:
        automaton.add(t)
    streams = [automaton.stream(t, span) for t in texts]
    holders: dict[int, int] = {}
    for i, states in enumerate(streams):
        for state in set(states):
            holders[state] = holders.get(state, 0) | 1 << i
    holders[0] = 0
    out = []
    for i, states in enumerate(streams):
        current = begin = stop = 0
        for end, state in enumerate(states, 1):
            held = holders[state]
            if held == current:
                stop = end
                continue
            if current & (current - 1):
                out.append((current, i, begin, stop))
            current, begin, stop = held, end - span, end
        if current & (current - 1):
            out.append((current, i, begin, stop))
    return out


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Runs of rows with equal first column, over batch boundaries."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[0] != held[0][0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _automaton_rows(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """``batches``: ``h, r1, r2, region``, sorted; at most ``SHARD`` rows share an ``h``."""
    rows: list[tuple] = []
    for shard in _shards(batches):
        h = shard[0][0]
        for holders, i, begin, end in shard_spans([x[3] for x in shard], span):
            name = xxhash.xxh3_128_intdigest(f"{h}:{holders}".encode())
            rows.append((h, (name >> 64) - (1 << 63), (name & ((1 << 64) - 1)) - (1 << 63), shard[i][1], shard[i][2], begin, end))
        if len(rows) > 20_000:
            yield _hit_batch(rows)
            rows = []
    if rows:
        yield _hit_batch(rows)


def _hit_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.int32()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["h", "c1", "c2", "r1", "r2", "from", "to"])


def _window_rows(batches: Iterator[pd.DataFrame], span: int) -> Iterator[pd.DataFrame]:
    columns = ["h", "c1", "c2", "r1", "r2", "from", "to"]
    for pdf in batches:
        rows = []
        for h, r1, r2, region in zip(pdf["h"], pdf["r1"], pdf["r2"], pdf["region"]):
            for i in range(len(region) - span + 1):
                name = xxhash.xxh3_128_intdigest(region[i : i + span].encode("utf-8"))
                rows.append((h, (name >> 64) - (1 << 63), (name & ((1 << 64) - 1)) - (1 << 63), r1, r2, i, i + span))
            if len(rows) > PIECE_ROWS:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        yield pd.DataFrame(rows, columns=columns)


def span_members(texts: DataFrame, span: int = SPAN, anchor: int = ANCHOR, shard: int = SHARD) -> DataFrame:
    """``c1, c2, k1, k2, begin, end``: the members of each class of equal spans (see the module).

    ``texts`` as from :func:`keyed_texts`. The spans of a text's copies count as one member.
    """
    found = settle(anchors(texts, span, anchor), "span-anchors")
    several = found.groupBy("h").agg(F.min("k1").alias("a1"), F.max("k1").alias("b1"), F.min("k2").alias("a2"), F.max("k2").alias("b2")).where("a1 <> b1 OR a2 <> b2").select("h")
    around = settle(regions(texts, found.join(several, "h", "left_semi"), span, anchor), "span-regions")
    distinct = around.groupBy("h", "r1", "r2").agg(F.first("region").alias("region"))
    # One distinct region under an anchor: every holder shares all of it.
    sizes = settle(distinct.groupBy("h").agg(F.count("*").alias("n")), "span-shards")
    out_schema = "h long, c1 long, c2 long, r1 long, r2 long, `from` int, `to` int"
    one = sizes.where("n = 1").select("h")
    same = around.join(one, "h", "left_semi").select(F.col("h").alias("c1"), F.lit(0).cast("bigint").alias("c2"), "k1", "k2", "begin", (F.col("begin") + F.length("region")).alias("end"))
    some = distinct.join(sizes.where(f"n BETWEEN 2 AND {shard}").select("h"), "h", "left_semi")
    ordered = fan_out(some.select("h", "r1", "r2", "region"), "h").sortWithinPartitions("h", "r1", "r2")
    by_automaton = ordered.mapInArrow(lambda it: _automaton_rows(it, span), out_schema)
    many = distinct.join(sizes.where(f"n > {shard}").select("h"), "h", "left_semi")
    windows = many.mapInPandas(lambda it: _window_rows(it, span), out_schema)
    hits = by_automaton.unionByName(windows)
    # also the holders of one region among several share that region
    copies = around.join(sizes.where("n > 1").select("h"), "h", "left_semi")
    held = copies.select("h", "r1", "r2", "k1", "k2", "begin")
    inner = hits.join(held, ["h", "r1", "r2"]).select("c1", "c2", "k1", "k2", (F.col("begin") + F.col("from")).alias("begin"), (F.col("begin") + F.col("to")).alias("end"))
    equal = copies.select(F.xxhash64("h", "r1", "r2").alias("c1"), F.col("r2").alias("c2"), "k1", "k2", "begin", (F.col("begin") + F.length("region")).alias("end"))
    members = settle(same.unionByName(inner).unionByName(equal), "span-members")
    shared = members.groupBy("c1", "c2").agg(F.min("k1").alias("a1"), F.max("k1").alias("b1"), F.min("k2").alias("a2"), F.max("k2").alias("b2")).where("a1 <> b1 OR a2 <> b2").select("c1", "c2")
    return members.join(shared, ["c1", "c2"], "left_semi")


def shared_pairs(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """``doc_a, doc_b`` (a < b): documents that share a span of at least ``span`` code points, each pair once."""
    texts = keyed_texts(documents, span=span)
    owners = settle(texts.select("doc_id", "k1", "k2").distinct(), "span-owners")
    classes = settle(span_members(texts, span).select("c1", "c2", "k1", "k2").distinct(), "span-classes")
    names = {f"{side}_k{i}": f"k{side}{i}" for side in "ab" for i in (1, 2)}
    between = pairs_within(classes, ["c1", "c2"], ["k1", "k2"]).withColumnsRenamed(names).distinct()
    left = owners.select(F.col("doc_id").alias("da"), F.col("k1").alias("ka1"), F.col("k2").alias("ka2"))
    right = owners.select(F.col("doc_id").alias("db"), F.col("k1").alias("kb1"), F.col("k2").alias("kb2"))
    apart = between.join(left, ["ka1", "ka2"]).join(right, ["kb1", "kb2"]).select(F.least("da", "db").alias("doc_a"), F.greatest("da", "db").alias("doc_b"))
    copies = pairs_within(owners, ["k1", "k2"], ["doc_id"]).select(F.col("a_doc_id").alias("doc_a"), F.col("b_doc_id").alias("doc_b"))
    return apart.unionByName(copies)


def shared_shares(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """``doc_id, n_chars, shared_chars, shared_share``: per document, its characters that stand elsewhere too.

    One row per document. Null texts have null sizes and 0 shared characters. A text with a
    copy (of at least ``span`` characters) is shared whole.
    """
    texts = keyed_texts(documents, span=span)
    copied = texts.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.first(F.length("text")).alias("size")).where("n > 1").select("k1", "k2", F.lit(0).alias("begin"), F.col("size").alias("end"))
    spans = span_members(texts, span).select("k1", "k2", "begin", "end").unionByName(copied).distinct()
    # union of intervals: a span counts only what lies beyond all spans that begin before it
    earlier = Window.partitionBy("k1", "k2").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    gained = spans.withColumn("upto", F.coalesce(F.max("end").over(earlier), F.lit(0))).select("k1", "k2", F.greatest(F.lit(0), F.col("end") - F.greatest("begin", "upto")).alias("gain"))
    covered = gained.groupBy("k1", "k2").agg(F.sum("gain").alias("shared"))
    k1, k2 = content_key(F.col("text"))
    every = documents.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), k1.alias("k1"), k2.alias("k2"))
    shared = F.coalesce("shared", F.lit(0)).cast("bigint")
    return every.join(covered, ["k1", "k2"], "left").select("doc_id", "n_chars", shared.alias("shared_chars"), F.round(shared / F.when(F.col("n_chars") > 0, F.col("n_chars")), 6).alias("shared_share"))


def without_shared_spans(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """``doc_id, n_chars, removed_chars, text``: the documents without spans that a document of a lower id has.

    Of every maximal span of at least ``span`` characters that several documents share, the
    lowest ``doc_id`` keeps its characters, and all others lose theirs; so a copy of an earlier text becomes
    empty. One row per input row. Null texts stay null, with 0 characters removed.
    """
    texts = keyed_texts(documents, span=span)
    owners = settle(texts.groupBy("k1", "k2").agg(F.min("doc_id").alias("owner")), "span-first-owners")
    members = settle(span_members(texts, span).join(owners, ["k1", "k2"]), "span-owned")
    keepers = members.groupBy("c1", "c2").agg(F.min("owner").alias("keeper"))
    gone = members.join(keepers, ["c1", "c2"]).where("owner > keeper").select("k1", "k2", "begin", "end").distinct()
    # merge what touches: an island begins where a span begins beyond all earlier ends
    per_text = Window.partitionBy("k1", "k2").orderBy("begin", "end")
    earlier = F.max("end").over(per_text.rowsBetween(Window.unboundedPreceding, -1))
    islands = gone.withColumn("fresh", (earlier.isNull() | (F.col("begin") > earlier)).cast("int")).withColumn("island", F.sum("fresh").over(per_text))
    merged = islands.groupBy("k1", "k2", "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    # disjoint and at least a span long each, so bounded by the length of their text
    cuts = merged.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("cuts"), F.sum(F.col("end") - F.col("begin")).alias("size"))
    k1, k2 = content_key(F.col("text"))
    every = documents.select("doc_id", "text", F.length("text").cast("bigint").alias("n_chars"), k1.alias("k1"), k2.alias("k2"))
    whole = (F.col("n_chars") >= span) & (F.col("doc_id") > F.col("owner"))
    starts = F.concat(F.array(F.lit(0)), F.transform("cuts", lambda c: c["end"]))
    stops = F.concat(F.transform("cuts", lambda c: c["begin"]), F.array(F.length("text")))
    pieces = F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda p: F.substring(F.col("text"), p["a"] + 1, p["b"] - p["a"]))
    left = F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.array_join(pieces, ""))
    return (
        every.join(owners.join(cuts, ["k1", "k2"], "left"), ["k1", "k2"], "left")
        .withColumn("whole", F.coalesce(whole, F.lit(False)))
        .select("doc_id", "n_chars", F.when(F.col("whole"), F.col("n_chars")).otherwise(F.coalesce("size", F.lit(0))).cast("bigint").alias("removed_chars"), F.when(F.col("whole"), F.lit("")).otherwise(left).alias("text"))
    )
