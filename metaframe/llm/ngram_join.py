"""Exact n-gram Jaccard self-join at 0.9 and the groups that it links.

Documents become sets of hashed word shingles, and equal sets one node. Nodes meet in size-banded tiles: the
hash space is cut into slices, and a tile is a size band with one slice's content. Two sets of sizes a and b
with a Jaccard similarity of at least 0.9 differ in at most (a + b) / 19 shingles, so with two slices more
than that at least two slices are equal: no link is lost, whatever the words' frequencies. In a tile,
bitmap signatures (a bit flips with each shingle of its hash class) bound the difference from below, and
with it the overlap from above; what passes goes to an exact intersection of sorted arrays.

All pairs of a tile are not compared at first. Each member is compared with the tile's least node, links are
contracted to components, and only nodes of one tile in different components are compared further, in blocks
of bounded size. So a group of n near copies costs about n comparisons, and links between texts that could
join two components are all tried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaframe.llm.components import components
from metaframe.llm.kernels import U64, Texts, batches, int64, list_array, mix, shingles, trim, unique_within
from metaframe.llm.shared import small, written

SHINGLE = 3
#: Sets link when 100 * intersection >= 90 * union, that is, when 19 * difference <= a + b.
DIFFERENCE = 19
#: The smallest set that may link with one that is not equal: with one of a member more, 19 * 1 <= 9 + 10.
LEAST = 9
BITS = 512
#: Most nodes of a block in which all pairs' signatures are compared.
BLOCK = 256
_LONGS = [f"b{i}" for i in range(BITS // 64)]
_SETS = "id long, n long, fp long, keys array<long>, " + ", ".join(f"{b} long" for b in _LONGS)


def bands() -> np.ndarray:
    """Lower ends of the size bands, each half as large again as the one before."""
    ends = [1]
    while ends[-1] < 1 << 40:
        ends.append(ends[-1] + max(1, ends[-1] // 2))
    return np.array(ends)


_BANDS = bands()


def slices_of(band: int) -> int:
    """Slices of a band: with its largest set and the largest one that may link to it, two more than can differ."""
    top = int(_BANDS[band + 1]) - 1
    return (top + top * 10 // 9) // DIFFERENCE + 2


def tile_keys(values: np.ndarray) -> np.ndarray:
    """The tiles of one sorted set. A set meets those of its own band and, if near its low end, those of the band below.

    A set of less than LEAST members links with equal ones alone, which are one node, so it is in no tile.
    """
    n = len(values)
    if n < LEAST:
        return np.zeros(0, U64)
    own = int(np.searchsorted(_BANDS, n, side="right")) - 1
    out = []
    spread = mix(values)
    for band in {own, own - 1} - {-1}:
        if band != own and 9 * n > 10 * (int(_BANDS[band + 1]) - 1):
            continue
        k = slices_of(band)
        at = (spread >> U64(32)).astype(np.int64) * k >> 32
        sums = np.zeros(k, dtype=U64)
        np.add.at(sums, at, spread)
        counts = np.bincount(at, minlength=k)
        where = np.flatnonzero(counts).astype(U64)
        salt = U64(band) * U64(0x9E3779B1)
        out.append(mix(sums[where] ^ mix(where + (salt << U64(20)))))
        bare = np.flatnonzero(counts == 0)
        if len(bare) >= 2:  # two equal slices may both be bare
            i, j = np.triu_indices(len(bare), 1)
            out.append(mix(mix(bare[i].astype(U64) * U64(k) + bare[j].astype(U64)) ^ (salt + U64(1) << U64(40))))
    return np.concatenate(out)


def parity_bits(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of BITS / 64 words for each set: bit h is the parity of the members in hash class h."""
    docs = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    cls = (mix(values ^ U64(0xA5A5)) % U64(BITS)).astype(np.int64)
    odd = np.bincount(docs * BITS + cls, minlength=(len(bounds) - 1) * BITS).reshape(-1, BITS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)


def fingerprints(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    total = np.concatenate(([U64(0)], np.cumsum(mix(values ^ U64(77)), dtype=U64)))
    return mix(total[bounds[1:]] - total[bounds[:-1]] + mix(np.diff(bounds).astype(U64))).view(np.int64)


def _described(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(stream):
        words = Texts(batch.column(1)).words()
        values, bounds = unique_within(*shingles(words.hashes(), words.first, SHINGLE))
        bits = parity_bits(values, bounds)
        keys = [tile_keys(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        flat = np.concatenate(keys) if keys else np.zeros(0, U64)
        n = np.diff(bounds)
        yield pa.record_batch(
            [batch.column(0), pa.array(n.astype(np.int64)), pa.array(fingerprints(values, bounds), mask=n == 0), list_array(flat, np.concatenate(([0], np.cumsum([len(k) for k in keys])))), *(pa.array(bits[:, i]) for i in range(bits.shape[1]))],
            names=["id", "n", "fp", "keys", *_LONGS],
        )


def _sets(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(stream):
        words = Texts(batch.column(0)).words()
        values, bounds = unique_within(*shingles(words.hashes(), words.first, SHINGLE))
        yield pa.record_batch([pa.array(fingerprints(values, bounds)), list_array(values, bounds)], names=["fp", "members"])


def _far(a: str, b: str) -> Column:
    """The least number of shingles in which the two sets differ, by their signatures."""
    return sum((F.bit_count(F.col(f"{a}.{x}").bitwiseXOR(F.col(f"{b}.{x}"))) for x in _LONGS), F.lit(0))


def _verified(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, v, and the members of both: the pairs that link."""
    for batch in stream:
        keep = []
        left, right = batch.column(2), batch.column(3)
        lo, ro, lv, rv = left.offsets.to_numpy(), right.offsets.to_numpy(), left.values.to_numpy(), right.values.to_numpy()
        for i in range(batch.num_rows):
            a, b = lv[lo[i] : lo[i + 1]].view(U64), rv[ro[i] : ro[i + 1]].view(U64)
            same = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(100 * same >= 90 * (len(a) + len(b) - same))
        yield pa.record_batch([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], names=["u", "v"])
    trim()


def _block_pairs(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block: pairs of a block in different components whose sizes and signatures allow a link. A block has 2 * BLOCK nodes or so."""

    def of(t: pa.Table) -> pa.RecordBatch:
        root, fp, n = (t.column(c).to_numpy() for c in ("root", "fp", "n"))
        side = t.column("side").to_numpy()
        bits = np.stack([t.column(c).to_numpy() for c in _LONGS], axis=1).view(U64)
        us, vs = [], []
        for i in range(len(fp)):
            far = np.bitwise_count(bits[i + 1 :] ^ bits[i]).sum(axis=1)
            ok = np.flatnonzero((root[i + 1 :] != root[i]) & ((side[i + 1 :] != side[i]) | (side[i] == 0)) & (DIFFERENCE * far <= n[i + 1 :] + n[i]) & (DIFFERENCE * np.abs(n[i + 1 :] - n[i]) <= n[i + 1 :] + n[i]))
            us.append(np.full(len(ok), fp[i]))
            vs.append(fp[i + 1 :][ok])
        u, v = np.concatenate(us), np.concatenate(vs)
        return pa.record_batch([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    rest: pa.Table | None = None
    for batch in stream:
        t = pa.Table.from_batches([batch])
        rest = t if rest is None else pa.concat_tables([rest, t])
        key = rest.column("block").to_numpy()
        cuts = np.flatnonzero(np.diff(key)) + 1
        last = 0
        for c in cuts:
            yield of(rest.slice(last, c - last))
            last = c
        rest = rest.slice(last).combine_chunks()
    if rest is not None and rest.num_rows:
        yield of(rest)
    trim()


def _links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes, of which those that are links are left. Only the sets of nodes in question are made again from the texts."""
    a, b = nodes.alias("a"), nodes.alias("b")
    near = written(
        pairs.join(a, F.col("u") == F.col("a.fp")).join(b, F.col("v") == F.col("b.fp"))
        .where((DIFFERENCE * _far("a", "b") <= F.col("a.n") + F.col("b.n")) & (DIFFERENCE * F.abs(F.col("a.n") - F.col("b.n")) <= F.col("a.n") + F.col("b.n")))
        .select("u", "v"),
        "near",
    )
    asked = written(near.select(F.explode(F.array("u", "v")).alias("fp")).distinct().join(nodes, "fp").select("fp", "id"), "asked")
    ids = small(asked.select(F.col("id").alias("_id")).distinct())
    texts = docs.join(ids, F.col("id").eqNullSafe(F.col("_id")), "left_semi").select("text")  # an id may have other texts too, so fingerprints decide
    sets = written(texts.mapInArrow(_sets, "fp long, members array<long>").join(small(asked.select("fp")), "fp", "left_semi").dropDuplicates(["fp"]), "sets")
    left, right = sets.select(F.col("fp").alias("u"), F.col("members").alias("left")), sets.select(F.col("fp").alias("v"), F.col("members").alias("right"))
    return near.join(left, "u").join(right, "v").select("u", "v", "left", "right").mapInArrow(_verified, "u long, v long")


def ngram_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for each row: the number of distinct 3-word shingles, and the least id that links reach.

    Words are runs of other than ASCII white space, with A-Z lowered; a text of one or two words is one
    shingle. A null, empty or blank text has 0 shingles and is linked with nothing: its component is its own
    id. Rows that repeat an id count as one document where their texts differ little, and keep a row each. A
    null id is linked like any other, but never names a component unless all the group's ids are null. Other
    columns are not looked at.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    described = written(docs.mapInArrow(_described, _SETS), "described")
    nodes = written(described.where("fp is not null").groupBy("fp").agg(F.min("id").alias("id"), F.first("n").alias("n"), *(F.first(x).alias(x) for x in _LONGS)), "nodes")
    keys = described.where("fp is not null").select("fp", F.explode("keys").alias("key"))
    tiles = keys.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("key", "low")
    met = written(keys.join(tiles, "key").select("key", "fp", "low").distinct(), "met")
    stars = met.where("fp <> low").select(F.col("fp").alias("u"), F.col("low").alias("v")).distinct()
    links = written(_links(stars, nodes, docs), "links")
    found = written(components(links), "components")

    rooted = met.join(found, met.fp == found.node, "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    open_tiles = rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("size")).where("r0 < r1 and size > 2")
    spread = rooted.join(open_tiles.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "key").withColumn("mine", F.pmod(F.xxhash64("fp", "key"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = (
        spread.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("block"), F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side"), "fp", "root")
        .join(nodes.drop("id"), "fp")
    )
    blocks = blocks.repartition("block").sortWithinPartitions("block")
    more = written(blocks.mapInArrow(_block_pairs, "u long, v long").distinct(), "more")
    if not more.isEmpty():
        links = links.unionByName(written(_links(more.join(stars.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), ["u", "v"], "left_anti"), nodes, docs), "links"))
        found = written(components(links), "components")
    named = nodes.select("fp", "id").join(found, F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    named = named.join(named.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("fp", "component_id")
    return described.select("id", "n", "fp").join(named, "fp", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that link to one of a lesser id; all columns stay. Rows that repeat an id stay or go together, and rows of a null id stay."""
    groups = ngram_groups(docs, id_col, text_col)
    gone = written(groups.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col)).distinct(), "copies")
    return docs.join(small(gone), id_col, "left_anti")
