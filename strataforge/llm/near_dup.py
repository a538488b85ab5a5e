"""Near-duplicate documents by BagMinHash signatures of their multisets of word shingles.

Signatures (Ertl 2018): a weight is a half-open range of levels [0, w). Levels
are grouped into dyadic blocks [0,1), [1,2), [2,4), [4,8), ..., each with a Poisson
process of rate equal to its length, seeded by shingle and block. Every point has
a time, a signature place and a level; a point counts if its level is below
the shingle's weight, and a place keeps its earliest time. Points are drawn only
until they are later than all places' times. Two places agree with probability
sum(min) / sum(max) of the weights, the weighted Jaccard similarity.

Candidates: PLACES places in bands of BAND; equal texts are one node. In each
bucket every member is compared with the member that shares most buckets with
others. A member that no comparison has put into the bucket's largest component is
then compared with all members of other components, block by block on packed
signatures, and every likely pair that its block's links have not joined yet is verified there.
So a bucket of copies costs one comparison a member, no likely pair is left out, and pairs never become rows.
Elements of a block that are more than CELL_BYTES are verified in ranges, whose counts are added.
Verification computes the exact multiset similarity; links at LEAST or more
form components, which are the classes.

Edge cases: a null text counts as empty; texts without words equal each other
and nothing else. A null doc_id has class null. Repeated rows are one node.
Texts of fewer than five words have one shingle. Other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .batches import divided, filter_place, groups, key_filter, maybe
from .components import connected_components
from .shared import forget, written
from .words import U

PLACES, BAND = 128, 4
LEAST = 0.8
SLACK = 0.12  # estimates from 128 places are off by 0.035 at 0.8; pairs below LEAST - SLACK aren't verified
CHUNK = 1024  # rows of a bucket compared at once
CELL_BYTES = 32 << 20  # elements compared at once; what holds more is cut by ranges of elements

_GAMMA, _BLOCK = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)


def multisets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles, their counts, offsets of documents), shingles ascending within a document."""
    hashed, first = words.hashes(column)
    shingle, offsets = words.shingles(hashed, first)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((shingle, doc))
    shingle, doc = shingle[order], doc[order]
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return shingle[at], np.diff(np.append(at, len(shingle))), words.by_document(doc[at], len(offsets) - 1)


def signatures(shingle: np.ndarray, weight: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """documents x PLACES earliest times; infinite for documents without shingles."""
    n = len(offsets) - 1
    times = np.full(n * PLACES, np.inf)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    seeds, rates, lows, owners, caps = [], [], [], [], []
    low, k = 0, 0
    while (inside := weight > low).any():  # block k covers levels low .. low + length
        length = max(1, low)
        seeds.append(words.mix(shingle[inside] + U((k + 1) * int(_BLOCK) & 0xFFFFFFFFFFFFFFFF)))
        rates.append(np.full(int(inside.sum()), float(length)))
        lows.append(np.full(int(inside.sum()), float(low)))
        owners.append(doc[inside])
        caps.append(weight[inside].astype(np.float64))
        low, k = low + length, k + 1
    if not seeds:
        return times.reshape(n, PLACES)
    seed, rate, low_, doc, cap = map(np.concatenate, (seeds, rates, lows, owners, caps))
    now, drawn = np.zeros(len(seed)), U(0)
    while len(seed):
        step = max(1, min(64, 16384 // len(seed)))  # a few processes left: several points of each at once
        r = words.mix(seed[:, None] + (drawn + np.arange(1, step + 1, dtype=np.uint64))[None] * _GAMMA)
        gaps = -np.log(((r >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[:, None]
        at = now[:, None] + np.cumsum(gaps, axis=1)
        r = words.mix(r)
        level = low_[:, None] + rate[:, None] * ((r >> U(32)).astype(np.float64) * 2.0**-32)
        place = doc[:, None] * PLACES + (r & U(PLACES - 1)).astype(np.int64)
        counts = level < cap[:, None]
        np.minimum.at(times, place[counts], at[counts])
        now, drawn = at[:, -1], drawn + U(step)
        latest = times.reshape(n, PLACES).max(axis=1)
        go = now < latest[doc]
        seed, rate, low_, doc, cap, now = seed[go], rate[go], low_[go], doc[go], cap[go], now[go]
    return times.reshape(n, PLACES)


def bands(times: np.ndarray) -> np.ndarray:
    """documents x bands hashes."""
    bits = times.view(np.uint64).reshape(len(times), -1, BAND)
    out = np.arange(1, bits.shape[1] + 1, dtype=np.uint64)[None] * _BLOCK
    for j in range(BAND):
        out = words.mix(out + bits[:, :, j] * _GAMMA)
    return out.view(np.int64)


def sketches(times: np.ndarray) -> list[bytes]:
    """Four bits of each place, for estimates."""
    low = (words.mix(times.view(np.uint64)) & U(15)).astype(np.uint8)
    return [row.tobytes() for row in (low[:, ::2] << 4) | low[:, 1::2]]


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity estimated from two arrays of sketches (last axis: bytes)."""
    x = a ^ b
    same = ((x & 15) == 0).mean(axis=-1, dtype=np.float32) / 2 + ((x >> 4) == 0).mean(axis=-1, dtype=np.float32) / 2
    return (same - 1 / 16) / (15 / 16)


def node_of(text: str | None) -> bytes:
    return hashlib.md5((text or "").encode(), usedforsecurity=False).digest()


def _node() -> Column:
    """:func:`node_of` as a column."""
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, node (MD5 of the text), sketch (with each band's hash), bands; bands are empty for texts without words. A narrow map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches):
            column = batch.column("text")
            shingle, weight, offsets = multisets(column)
            times = signatures(shingle, weight, offsets)
            found, has = bands(times), np.diff(offsets) > 0
            ends = np.concatenate([[0], np.cumsum(has * found.shape[1])]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(found[has].ravel()))
            nodes = pa.array([node_of(t) for t in column.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), nodes, pa.array([a + b.tobytes() for a, b in zip(sketches(times), found)], pa.binary()), listed], ["doc_id", "node", "sketch", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, node binary, sketch binary, bands array<long>")


def _likely(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches are alike enough to verify."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1)[:, : PLACES // 2] for c in ("sa", "sb"))
                yield batch.select(["a", "b"]).filter(pa.array(estimate(left, right) >= LEAST - SLACK))

    both = pairs.join(sketch.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b").join(sketch.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def _elements(needed: DataFrame, docs: DataFrame, into: list[str] | None) -> DataFrame:
    """node, elements (a hash of each copy of each shingle, 8 bytes each), size (their number) of the texts in ``needed`` (node).

    Only such texts are shuffled: a Bloom filter of fixed size drops others where they are read.
    """
    bits = docs.sparkSession.sparkContext.broadcast(key_filter(needed, "node"))
    texts = docs.select(_node().alias("node"), "text").withColumn("h", filter_place("node"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in words.slices(iter([whole.filter(maybe(bits.value, whole.column("h")))])):
                shingle, weight, offsets = multisets(batch.column("text"))
                copy = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
                each = words.mix(np.repeat(shingle, weight) + copy.astype(np.uint64) * _GAMMA)  # the k-th copy of a shingle is an element of its own
                ends = np.concatenate([[0], np.cumsum(weight)])[offsets]
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([each[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())], ["node", "elements"])

    elements = texts.select("node", "text", "h").mapInArrow(sets, "node binary, elements binary")
    owned = needed.join(elements, "node").groupBy("node").agg(F.first("elements").alias("elements"))
    return written(owned.withColumn("size", (F.octet_length("elements") / 8).cast("long")), "elements", into)


def verify(pairs: DataFrame, docs: DataFrame, into: list[str] | None = None) -> DataFrame:
    """The pairs (a, b) of nodes with an exact multiset similarity of LEAST or more.

    ``a`` is the end that may be in very many pairs. Its elements meet pairs that carry those of ``b``
    last, so a hub's pairs are large by then, which lets adaptive execution split them between tasks.
    """
    pairs = written(pairs, "pairs", into)
    owned = _elements(pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).select(F.col("a").alias("node")).distinct(), docs, into)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sets_ = [[np.frombuffer(e, np.uint64) for e in part.column(c).to_pylist()] for c in ("ea", "eb")]
                sizes = [np.array([len(e) for e in s]) for s in sets_]
                own = [np.repeat(words.mix(np.arange(1, part.num_rows + 1, dtype=np.uint64) * _BLOCK), n) for n in sizes]
                both = np.concatenate([np.concatenate(s) ^ o for s, o in zip(sets_, own)])
                pair = np.concatenate([np.repeat(np.arange(part.num_rows), n) for n in sizes])
                order = np.argsort(both)
                both, pair = both[order], pair[order]
                shared = np.bincount(pair[1:][both[1:] == both[:-1]], minlength=part.num_rows)
                alike = shared / np.maximum(sizes[0] + sizes[1] - shared, 1) >= LEAST
                yield part.select(["a", "b"]).filter(pa.array(alike))
        words.give_back()

    both = pairs.join(owned.select(F.col("node").alias("b"), F.col("elements").alias("eb")), "b").join(owned.select(F.col("node").alias("a"), F.col("elements").alias("ea")), "a")
    return both.select("a", "b", "ea", "eb").mapInArrow(compare, "a binary, b binary")


def _cells(members: DataFrame, component: DataFrame, sketch: DataFrame, into: list[str]) -> DataFrame:
    """bucket, band, i, j, role, node, c, sketch: what to compare in each bucket of several components.

    Members outside a bucket's largest component ask, all are asked. Both are dealt to blocks of CHUNK,
    and a member goes to each block of the other side: n members of which m ask make about m + n
    rows as long as m is below CHUNK, and n if n is. ``role`` is 1 for asking, 0 for asked, 2 for both.
    """
    named = members.join(component, "node", "left").select("bucket", "band", "node", F.coalesce("component", "node").alias("c"))
    per = named.groupBy("bucket", "c").count()
    main = per.groupBy("bucket").agg(F.max(F.struct("count", "c")).alias("m"), F.count(F.lit(1)).alias("parts"), F.sum("count").alias("size")).filter("parts > 1 and size > 2")
    blocks = lambda n: F.ceil(n / CHUNK).cast("int")
    main = written(main.select("bucket", F.col("m.c").alias("main"), blocks(F.col("size")).alias("all_blocks"), blocks(F.col("size") - F.col("m.count")).alias("ask_blocks")), "open-buckets", into)
    rows = written(named.join(main, "bucket").join(sketch, "node").withColumns({"h": F.xxhash64("node", "bucket"), "asks": F.col("c") != F.col("main")}), "open-members", into)
    own = lambda n: F.pmod(F.col("h"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = ["node", "c", "sketch"]
    small = rows.filter("all_blocks = 1").select("bucket", "band", F.lit(0).alias("i"), F.lit(0).alias("j"), F.when(F.col("asks"), 2).otherwise(0).alias("role"), *rest)
    asks = rows.filter("all_blocks > 1 and asks").select("bucket", "band", own("ask_blocks").alias("i"), every("all_blocks").alias("j"), F.lit(1).alias("role"), *rest)
    asked = rows.filter("all_blocks > 1").select("bucket", "band", every("ask_blocks").alias("i"), own("all_blocks").alias("j"), F.lit(0).alias("role"), *rest)
    return small.unionByName(asks).unionByName(asked)


def _likely_pairs(cell: pa.RecordBatch, joined: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(asking row, likely partners, likeliest first) of a cell; ``joined`` numbers components and may change meanwhile.

    A pair is taken only in the first band that both rows share, so no pair is compared in two buckets.
    """
    role, band = cell.column("role").to_numpy(), cell.column("band")[0].as_py()
    both = np.frombuffer(b"".join(cell.column("sketch").to_pylist()), np.uint8).reshape(cell.num_rows, -1)
    sketch, digests = both[:, : PLACES // 2], np.ascontiguousarray(both[:, PLACES // 2 :]).view(np.int64)[:, :band]
    right = np.flatnonzero(role != 1)
    own = sketch[right]
    for i in np.flatnonzero(role > 0):
        alike = estimate(own, sketch[i][None])
        at = np.flatnonzero((alike >= LEAST - SLACK) & (joined[right] != joined[i]) & ((role[right] != 2) | (right > i)))
        if len(at):
            found = right[at[np.argsort(-alike[at], kind="stable")]]
            found = found[~(digests[found] == digests[i]).any(axis=1)]
            if len(found):
                yield i, found


def _numbered(names: pa.Array) -> np.ndarray:
    return np.unique(np.array(names.to_pylist(), object), return_inverse=True)[1]


def shared_counts(sets: list[np.ndarray], asking: np.ndarray) -> Iterator[np.ndarray]:
    """For each set in ``asking``, how many elements it shares with every set; elements are distinct within a set."""
    ends = np.concatenate([[0], np.cumsum([len(e) for e in sets])])
    member = np.repeat(np.arange(len(sets)), np.diff(ends))
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    holders = member[np.argsort(code, kind="stable")]
    held = np.bincount(code)
    start = np.cumsum(held) - held
    for i in asking:
        own = code[ends[i] : ends[i + 1]]
        n = held[own]
        at = np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        yield np.bincount(holders[at], minlength=len(sets))


def _links_of_large(rows: DataFrame) -> DataFrame:
    """Links (a, b) of cells whose elements are too many for one task; ``rows`` also has elements, size and parts.

    A cell is cut into parts by ranges of elements, so each element is shuffled once. A part counts what likely
    pairs share of its range, one row an asking member with its partners' counts side by side; the sums decide.
    """
    keys = ["bucket", "i", "j"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row, parts = batch.slice(k, 1), batch.column("parts")[k].as_py()
                own = np.sort(np.frombuffer(row.column("elements")[0].as_py(), np.uint64))
                ends = np.searchsorted((own >> U(32)) * U(parts) >> U(32), np.arange(parts + 1))
                rest = row.drop_columns(["elements", "parts"]).take(pa.array(np.zeros(parts, np.int64)))
                pieces = pa.array([own[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([*rest.columns, pieces, pa.array(np.arange(parts, dtype=np.int32))], [*rest.schema.names, "elements", "part"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in groups(batches, [*keys, "part"]):  # rows come in the same order in every part
            joined, size = _numbered(cell.column("c")), cell.column("size").to_numpy()
            likely = list(_likely_pairs(cell, joined))
            node = np.array(cell.column("node").to_pylist(), object)
            sets = [np.frombuffer(e, np.uint64) for e in cell.column("elements").to_pylist()]
            first = cell.column("part")[0].as_py() == 0  # one part names the partners
            for (i, found), shared in zip(likely, shared_counts(sets, np.array([i for i, _ in likely], np.int64))):
                named = (b"".join(node[found]), (size[found] + size[i]).astype(np.int64).tobytes(), joined[found].astype(np.int64).tobytes()) if first else (b"", b"", b"")
                values = [*(cell.column(k)[0].as_py() for k in keys), node[i], shared[found].astype(np.int64).tobytes(), *named]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, counted)], counted)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, [*keys, "a"]):
            total, component = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.int64) for c in ("total", "component"))
            shared = sum(np.frombuffer(x, np.int64) for x in part.column("shared").to_pylist())
            at = np.flatnonzero(shared / (total - shared) >= LEAST)
            at = at[np.unique(component[at], return_index=True)[1]]  # a link to each component is enough
            mates = b"".join(part.column("mates").to_pylist())
            width = len(mates) // len(total)
            b = pa.array([mates[k * width : (k + 1) * width] for k in at], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("a").take(pa.array(np.zeros(len(at), np.int64))), b], ["a", "b"])

    counted = pa.schema([("bucket", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("a", pa.binary()), ("shared", pa.binary()), ("mates", pa.binary()), ("total", pa.binary()), ("component", pa.binary())])
    fields = "bucket long, band int, i int, j int, role int, node binary, c binary, sketch binary, size long"
    pieces = rows.select(*(f.split()[0] for f in fields.split(", ")), "elements", "parts").mapInArrow(cut, f"{fields}, elements binary, part int")
    pieces = pieces.repartition(*keys, "part").sortWithinPartitions(*keys, "part", "node", "role")
    counts = pieces.mapInArrow(count, "bucket long, i int, j int, a binary, shared binary, mates binary, total binary, component binary")
    return counts.repartition(*keys, "a").sortWithinPartitions(*keys, "a").mapInArrow(decide, "a binary, b binary")


def _links_left(members: DataFrame, component: DataFrame, sketch: DataFrame, docs: DataFrame, into: list[str]) -> DataFrame:
    """Links (a, b) between components, from every likely pair of a bucket's members; enough of them to join what belongs together.

    Pairs are never rows of a table: a first pass keeps the members that have a likely partner, a second
    compares the elements of such members inside their cells.
    """
    keys = ["bucket", "i", "j"]
    fields = "bucket long, band int, i int, j int, role int, node binary, c binary, sketch binary"

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in groups(batches, keys):
            wanted = np.zeros(cell.num_rows, bool)
            for i, found in _likely_pairs(cell, _numbered(cell.column("c"))):
                wanted[i] = wanted[found] = True
            yield cell.filter(pa.array(wanted))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in groups(batches, keys):
            joined, x, y = _numbered(cell.column("c")), [], []
            elements = [np.frombuffer(e, np.uint64) for e in cell.column("elements").to_pylist()]
            for i, found in _likely_pairs(cell, joined):
                own, step = np.sort(elements[i]), 8
                while len(found):
                    some, found = found[:step], found[step:]
                    sizes = np.array([len(elements[k]) for k in some])
                    theirs = np.concatenate([elements[k] for k in some])
                    hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
                    shared = np.bincount(np.repeat(np.arange(len(some)), sizes)[hit], minlength=len(some))
                    for k in some[shared / (sizes + len(own) - shared) >= LEAST]:
                        if joined[k] != joined[i]:
                            x.append(i)
                            y.append(k)
                            joined[joined == joined[k]] = joined[i]
                    found, step = found[joined[found] != joined[i]], 4 * step
            if x:
                node = cell.column("node")
                yield pa.RecordBatch.from_arrays([node.take(pa.array(z, pa.int64())) for z in (x, y)], ["a", "b"])

    by_cell = lambda df: df.repartition(*keys).sortWithinPartitions(*keys)
    marked = written(by_cell(_cells(members, component, sketch, into)).mapInArrow(mark, fields), "likely-members", into)
    elements = _elements(marked.select("node").distinct(), docs, into)
    parts = marked.join(elements.select("node", "size"), "node").groupBy(*keys).agg(F.ceil(F.sum("size") * 8 / CELL_BYTES).cast("int").alias("parts"))
    large = written(parts.filter("parts > 1"), "large-cells", into)
    found = by_cell(marked.join(large, keys, "left_anti").join(elements, "node")).mapInArrow(compare, "a binary, b binary")
    return found if large.isEmpty() else found.unionByName(_links_of_large(marked.join(large, keys).join(elements, "node")))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, node, class_id, class_size of each row: the smallest doc_id of its near-duplicates, its own if it has none."""
    temp: list[str] = []
    rows = written(signed(docs), "signatures", temp)
    # One row a text, by partial aggregation, so a text that very many rows have is merged before its shuffle.
    nodes = written(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("doc_id").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")), "nodes", temp)
    placed = nodes.filter("first_id is not null").select("node", F.posexplode("bands").alias("band", "bucket"))
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = written(placed.join(sizes, "bucket").select("bucket", "band", "node", "size"), "members", temp)
    degree = members.groupBy("node").agg(F.sum("size").alias("degree"))
    centers = written(members.join(degree, "node").groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("m")).select("bucket", F.col("m.node").alias("center")), "centers", temp)
    sketch = written(nodes.select("node", "sketch").join(degree, "node", "left_semi"), "sketches", temp)
    pairs = written(members.join(centers, "bucket").filter("node != center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct(), "star-pairs", temp)
    links = written(verify(_likely(pairs, sketch), docs, temp), "links", temp)
    component = connected_components(links, "a", "b", temp)
    more = written(_links_left(members, component, sketch, docs, temp), "links", temp)
    if not more.isEmpty():
        component = connected_components(links.unionByName(more), "a", "b", temp)
    component = written(component, "components", temp)
    ids = component.join(nodes.select("node", "first_id", "n"), "node").groupBy("component").agg(F.min("first_id").alias("class_id"), F.sum("n").alias("class_size"))
    named = component.join(ids, "component").select("node", "class_id", "class_size")
    by_node = nodes.select("node", "first_id", "n").join(named, "node", "left")
    by_node = written(by_node.select("node", F.coalesce("class_id", "first_id").alias("class_id"), F.coalesce("class_size", "n").alias("class_size")), "classes")
    forget(docs.sparkSession, temp)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _node().alias("node")).join(by_node, "node")
    given = F.col("doc_id").isNotNull()
    return own.select("doc_id", "node", F.when(given, F.col("class_id")).alias("class_id"), F.when(given, F.col("class_size")).otherwise(1).alias("class_size"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the row with the smallest doc_id stays; rows with null doc_id stay."""
    temp: list[str] = []
    found = written(classes(docs).select(F.col("doc_id").alias("id"), "node", "class_id"), "row-classes", temp)
    drop = written(found.filter("id != class_id").select("id", "node").distinct(), "dropped")
    twice = written(found.filter("id = class_id").groupBy("id", "node").count().filter("count > 1").select("id", "node"), "repeated")
    forget(docs.sparkSession, temp)
    bits = docs.sparkSession.sparkContext.broadcast(key_filter(drop, "node"))
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), _node().alias("node")).withColumn("place", filter_place("node"))
    some, others = divided(marked, "place", bits)  # texts that no class drops are not shuffled
    kept = some.join(drop, ["id", "node"], "left_anti").unionByName(others)
    if not twice.isEmpty():  # repeated rows of the document that stays
        same = kept.join(twice, ["id", "node"], "left_semi").dropDuplicates(["id", "node"])
        kept = kept.join(twice, ["id", "node"], "left_anti").unionByName(same)
    return kept.select("row.*")
