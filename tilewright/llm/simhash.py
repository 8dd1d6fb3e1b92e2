"""SimHash near-duplicates, found exactly through vantage-point trees.

Fingerprints are 64 bits of 3-word shingles. Equal fingerprints are one node. A vantage-point tree parts the nodes: at each
level a node lies inside or outside a ball about a vantage fingerprint. Two nodes within ``bits`` of each other differ by at
most ``bits`` in their distance to any vantage point (triangle inequality), so a node outside also visits the inside of a
ball whose border is within ``bits``, and a visitor goes down only those branches its bounds allow. Each pair meets in exactly
one shard. Shards that hold many nodes are split into blocks, and each shard reports a spanning forest instead of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import fresh, give_back, map_arrow, only, text_groups
from tilewright.llm.graph import component_roots

SEED = 42
#: Nodes that a shard is to hold, and how many nodes and visitors a block of a shard may hold.
SHARD, NODES, VISITORS = 1024, 4096, 65536
#: The tree is fitted on so many fingerprints at most, and has so many levels at most.
SAMPLE, LEVELS = 16384, 11


def shingle_hashes(text: str, words: int = 3) -> list[int]:
    """XXH64 of each shingle of the text, ASCII upper case lowered."""
    from xxhash import xxh64_intdigest

    w = text.encode().lower().split()
    if not w:
        return []
    if len(w) <= words:
        return [xxh64_intdigest(b" ".join(w), SEED)]
    return [xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(w[i:] for i in range(words)), strict=False)]


def simhash(hashes: list[list[int]]) -> np.ndarray:
    """A fingerprint for each list: bit i is set if it is set in over half of the hashes; zero if there are none."""
    sizes = np.array([len(h) for h in hashes])
    out = np.zeros(len(hashes), "<u8")
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.array([x for h in hashes for x in h], "<u8")
        bits = np.unpackbits(flat.view("u1").reshape(-1, 8), axis=1, bitorder="little")
        starts = np.cumsum(sizes[full]) - sizes[full]
        counts = np.add.reduceat(bits, starts, axis=0, dtype="int32")
        set_ = counts * 2 > sizes[full][:, None]
        out[full] = np.packbits(set_, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp) of whole texts, one narrow pass; ``fp`` holds the 64 bits as a long. Null and empty texts, and those
    without a word, have zero."""
    kind = dict(df.dtypes)[id_col]

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [simhash([shingle_hashes(t, words) for t in g]) for g in text_groups(batch.column(1))]
            fp = pa.array(np.concatenate(found).view("<i8"), pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0), fp], ["doc_id", "fp"])

        return each

    return map_arrow(only(df, doc_id=id_col, text=text_col), make, f"doc_id {kind}, fp bigint")


class Tree:
    """Vantage points and radii of a full binary tree in heap order; node 1 is the root."""

    def __init__(self, sample: np.ndarray, levels: int):
        self.levels = levels
        self.vantage = np.zeros(1 << levels, "<u8")
        self.radius = np.zeros(1 << levels, "int16")
        inside = {1: sample}
        for node in range(1, 1 << levels):
            own = inside.pop(node)
            if len(own):
                tried = own[:: max(1, len(own) // 8)][:8]
                spread = [np.bitwise_count(own ^ v).std() for v in tried]
                self.vantage[node] = tried[int(np.argmax(spread))]
            d = np.bitwise_count(own ^ self.vantage[node]).astype("int16")
            self.radius[node] = int(np.median(d)) if len(own) else 32
            inside[2 * node], inside[2 * node + 1] = own[d <= self.radius[node]], own[d > self.radius[node]]

    def route(self, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into fp, shard, is it at home there) of every shard that a fingerprint lives in or visits."""
        item, node, home = np.arange(len(fp)), np.ones(len(fp), "int64"), np.ones(len(fp), bool)
        for _ in range(self.levels):
            r = self.radius[node]
            d = np.bitwise_count(fp[item] ^ self.vantage[node]).astype("int16")
            inner = np.where(home, d <= r, d <= r + bits)
            outer = np.where(home, d > r, d > r - bits)
            guest = home & (d > r) & (d <= r + bits)
            parts = ((inner, 0, home), (outer, 1, home), (guest, 0, np.zeros_like(home)))
            item, node, home = (
                np.concatenate(x)
                for x in zip(*((item[m], 2 * node[m] + side, h[m]) for m, side, h in parts), strict=True)
            )
        return item, node - (1 << self.levels), home


def _mixed(fp: np.ndarray) -> np.ndarray:
    """A number that deals fingerprints evenly whatever their bits are."""
    x = fp * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32))) >> np.uint64(8)


def _loads(nodes: DataFrame, tree: Tree, bits: int) -> dict[int, tuple[int, int]]:
    """Nodes and visitors of each shard: at most 2^LEVELS rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << tree.levels), "int64")
        for b in batches:
            _, shard, home = tree.route(b.column(0).to_numpy().view("<u8"), bits)
            counts += np.stack([np.bincount(shard[m], minlength=counts.shape[1]) for m in (home, ~home)])
        used = np.flatnonzero(counts.sum(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in (used, counts[0][used], counts[1][used])], ["shard", "h", "v"]
        )
        give_back()

    rows = nodes.mapInArrow(run, "shard bigint, h bigint, v bigint").groupBy("shard").agg(F.sum("h"), F.sum("v"))
    return {r[0]: (r[1], r[2]) for r in rows.collect()}


def shard_links(nodes: DataFrame, bits: int = 3) -> DataFrame:
    """(u, v): links between distinct fingerprints of ``nodes(fp)``, enough to connect all that are within ``bits``."""
    total = nodes.count()
    wanted = int(np.ceil(np.log2(max(1, total / SHARD))))
    sample = nodes.where(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(4)) == 0).orderBy(F.xxhash64("fp")).limit(SAMPLE)
    levels = min(wanted, LEVELS)
    drawn = np.array([r[0] for r in sample.collect()] if levels else [], "<i8").view("<u8")
    tree = Tree(drawn, levels)
    loads = _loads(nodes, tree, bits)
    node_blocks = np.ones(1 << levels, "int64")
    guest_blocks = np.ones(1 << levels, "int64")
    for shard, (h, v) in loads.items():
        node_blocks[shard] = -(-h // NODES) or 1
        guest_blocks[shard] = -(-(v + (h if h > NODES else 0)) // VISITORS) or 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            everything = b.column(0).to_numpy().view("<u8")
            for at in range(0, len(everything), 4096):
                fp = everything[at : at + 4096]
                item, shard, home = tree.route(fp, bits)
                nb, gb, mix = node_blocks[shard], guest_blocks[shard], _mixed(fp)[item]
                own, lane = (mix % nb.astype("u8")).astype("int64"), (mix // nb.astype("u8") % gb.astype("u8"))
                lane = lane.astype("int64")
                # at home: in the own block for every lane of visitors, and a visitor of the blocks before it
                times = np.where(home, gb + own, nb)
                row = np.repeat(np.arange(len(item)), times)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                living = home[row] & (nth < gb[row])
                block = np.where(living, own[row], np.where(home[row], nth - gb[row], nth))
                arrays = [
                    pa.array(shard[row].astype("int32")),
                    pa.array(block.astype("int32")),
                    pa.array(np.where(living, nth, lane[row]).astype("int32")),
                    pa.array(living),
                    pa.array(fp[item[row]].view("<i8")),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["shard", "block", "lane", "living", "fp"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        living = pdf["living"].to_numpy()
        lane = int(pdf["lane"].iloc[0])
        h = pdf["fp"].to_numpy()[living].view("<u8")
        v = pdf["fp"].to_numpy()[~living].view("<u8")
        label = np.arange(len(h) + len(v))
        # nodes meet each other in the first lane, and every visitor meets all of them
        for at in range(0, len(v), 2048):
            _join(label, h, v[at : at + 2048], len(h) + at, bits)
        for at in range(0, len(h) if lane == 0 else 0, 2048):
            _join(label, h, h[at : at + 2048], at, bits)
        fp = np.concatenate([h, v]).view("<i8")
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"u": fp[moved], "v": fp[label[moved]]})

    dealt = nodes.mapInArrow(deal, "shard int, block int, lane int, living boolean, fp bigint")
    return dealt.groupBy("shard", "block", "lane").applyInPandas(meet, "u bigint, v bigint")


def _join(label: np.ndarray, h: np.ndarray, some: np.ndarray, first: int, bits: int) -> None:
    """Give linked nodes a common label; ``some`` has the places from ``first`` on."""
    if not len(h):
        return
    b, a = np.nonzero(np.bitwise_count(some[:, None] ^ h[None, :]) <= bits)
    b += first
    keep = a != b
    a, b = a[keep], b[keep]
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label[:] = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 3) -> DataFrame:
    """Per row: ``doc_id``, ``fp`` (long) and ``component_id``, the smallest id reachable over links of at most ``bits``.

    Texts without a word have fingerprint zero and link like others. Repeated rows come back as often as they came; null
    ids never name a component unless there is no other id in it; an empty table gives no rows; other columns are not
    carried. Links are between distinct fingerprints, so copies cost nothing, and a component's rows never meet in one task.
    """
    own = fresh(fingerprints(df, id_col, text_col), "fingerprints")
    nodes = fresh(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = component_roots(shard_links(nodes.select("fp"), bits))
    linked = fresh(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left"), "linked")
    linked = linked.withColumn("root", F.coalesce("root", "fp"))
    lowest = fresh(linked.groupBy("root").agg(F.min("first").alias("component_id")), "lowest")
    classes = fresh(linked.join(lowest, "root").select("fp", "component_id"), "classes")
    return own.join(classes, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: str = "fp"):
    """16 lower-case digits of a fingerprint."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 3) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of their near-duplicate group; all columns stay. Rows without an id are
    kept, and rows that share the smallest id are one document."""
    others = near_duplicates(df, id_col, text_col, bits).where("doc_id <> component_id").select("doc_id").distinct()
    others = fresh(others.select(F.col("doc_id").alias("_gone")), "gone")
    return df.join(others, df[id_col] == others["_gone"], "left_anti")
