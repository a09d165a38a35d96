"""Exact Jaccard join of documents over sets of word n-grams.

Universe-partition pigeonhole. Sizes are cut into bands; in a band all n-grams are hashed into a fixed
number of segments. Sets with enough in common differ in at most ``H`` elements, so among any ``H + 1``
segments one is the same in both. The smaller set of a pair indexes all its segments, the larger one
probes the ``H + 1`` that cost least. In a few segments of a band the sets also index what is left without
one element; probing these with the segment and its own one-deletion neighbourhood tolerates one
difference there and counts twice. The cost is judged by the elements of a segment that are not frequent
in the corpus: empty segments and those made of a common passage are only probed when nothing else is left.
Allocation changes the work, never the result.

Sets that are equal are one node. Nodes that meet by a signature are all compared with one of them, its
hub, the node that meets most. That is exact on the whole sets of 64-bit n-gram hashes and joins a group of
copies at about the cost of its size. Two nodes of which one is not near the hub may still be near each
other. They differ from one another in what their differences from the hub differ in, so these differences,
are joined by a prefix filter: their first common element must stand early in both. A hub that is a variant
itself lacks what most of its members share, so elements that a few of its members, its guides, differ from it
in come last, the most frequent at the end. What stands early then is a member's own, and no link between
components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.components import connected
from tidecast.llm.meeting import INDEX, MEETING, PROBE, meeting_batch, met_rows, node_ids, split_by_keys
from tidecast.llm.textbytes import SMALL_BLOCK, frugal, mix, ragged, shingle_hashes, text_blocks, word_hashes
from tidecast.session import stage

#: Sizes of a band grow by this ratio.
BAND_RATIO = 1.5
#: Segments beyond those that the pigeonhole needs, from which costly ones are left out.
SLACK = 0.03
#: One of so many segments has a one-deletion neighbourhood.
DELETION_EVERY = 32
#: An n-gram is frequent if it is in more than one of so many documents; only costs depend on it.
FREQUENT_SHARE = 256
FREQUENT_KEPT = 200_000
#: Members of a hub that are compared with it in one run.
MEMBERS = 256
#: Most members of a hub that tell what its members often differ from it in, and the members for each.
GUIDES, GUIDED = 32, 8
#: What a row is to its hub, in the order in which a run needs them.
HUB, GUIDE, MEMBER = 0, 1, 2

_DELETED = np.uint64(0x5851F42D4C957F2D)


class Bands:
    """Bands of set sizes for a threshold in percent, and the segments of each."""

    def __init__(self, percent: int, largest: int):
        self.percent = percent
        lows = [1]
        while lows[-1] <= largest:
            lows.append(max(lows[-1] + 1, int(lows[-1] * BAND_RATIO)))
        self.low = np.array(lows)  # band j holds the sizes low[j] .. low[j + 1] - 1
        self.guest = np.array([(h - 1) * 100 // percent for h in lows[1:]])  # its largest partners
        most = self.differences(self.guest, self.low[1:] - 1)
        self.segments = np.maximum(1, np.ceil((most + 1) * (1 + SLACK)).astype(np.int64))
        self.deletions = self.segments // DELETION_EVERY

    def differences(self, a, b):
        """Most elements in which sets of these sizes may differ."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, side="right") - 1


def _sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of every text of a block."""
    hashes, first = word_hashes(data, offsets)
    grams, ends = shingle_hashes(hashes, first, k)
    return [np.unique(grams[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _nodes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Size and fingerprint of every set; equal sets have equal fingerprints."""
    sizes = np.array([s.size for s in sets], dtype=np.int64)
    flat = mix(np.concatenate([*sets, np.zeros(0, np.uint64)]) + np.uint64(1))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat, dtype=np.uint64)])
    ends = np.cumsum(sizes)
    prints = mix(total[ends] - total[ends - sizes] + mix(sizes.astype(np.uint64)))
    return sizes, node_ids(prints)


def document_sets(documents: DataFrame, k: int) -> DataFrame:
    """``kind, id, number, hash``: for each document its id, set size and fingerprint (kind 0), and for each
    n-gram that is frequent in a block of texts the number of documents there (kind 1).
    """

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_blocks(batch.column(1), SMALL_BLOCK):
                sets = _sets(data, offsets, k)
                sizes, prints = _nodes(sets)
                grams, counts = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
                often = counts >= max(4, len(sets) // (FREQUENT_SHARE // 2))
                ids = pa.concat_arrays([batch.column(0).slice(first, last - first), pa.nulls(int(often.sum()), pa.int64())])
                kind = np.repeat([0, 1], [len(sets), int(often.sum())])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(kind, pa.int32()),
                        ids,
                        pa.array(np.concatenate([sizes, counts[often]]), pa.int64()),
                        pa.array(np.concatenate([prints, grams[often].view(np.int64)]), pa.int64()),
                    ],
                    names=["kind", "id", "number", "hash"],
                )

    rows = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "kind int, id long, number long, hash long")


def _signatures(sets, prints, bands: Bands, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signature, node and role of all segments of a block's sets, each node once."""
    _, pick = np.unique(prints, return_index=True)
    pick = [i for i in pick.tolist() if sets[i].size]
    sizes = np.array([sets[i].size for i in pick], dtype=np.int64)
    if not len(pick):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    band = bands.of(sizes)
    guest = np.flatnonzero((band > 0) & (sizes <= bands.guest[band - 1]))
    # One entry per set and band: its own band, then the one below for which it is a larger partner.
    of = np.concatenate([np.arange(len(pick)), guest])
    level = np.concatenate([band, band[guest] - 1])
    visiting = np.arange(of.size) >= len(pick)
    n = sizes[of]
    partner = np.where(visiting, bands.low[level + 1] - 1, n)
    need = bands.differences(n, partner) + 1
    segments = bands.segments[level]
    base = np.concatenate([[0], np.cumsum(segments)])

    flat = np.concatenate([sets[i] for i in pick])
    ends = np.cumsum(sizes)
    at = ragged((ends - sizes)[of], n)
    entry = np.repeat(np.arange(of.size), n)
    value = mix(flat[at])
    rare = np.ones(at.size, dtype=bool)
    if frequent.size:
        place = np.minimum(np.searchsorted(frequent, flat[at]), frequent.size - 1)
        rare = frequent[place] != flat[at]
    segment = base[entry] + (mix(value + level[entry].astype(np.uint64)) % segments[entry].astype(np.uint64)).astype(np.int64)
    order = np.argsort(segment, kind="stable")
    segment, value, rare = segment[order], value[order], rare[order]
    count = np.bincount(segment, minlength=base[-1])
    uncommon = np.bincount(segment, rare, minlength=base[-1]).astype(np.int64)
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    last = np.cumsum(count)
    total = running[last] - running[last - count]
    owner = np.repeat(np.arange(of.size), segments)
    number = np.arange(base[-1]) - base[owner]
    salt = mix((level[owner].astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64) + np.uint64(1))
    deletable = number < bands.deletions[level[owner]]

    # Units of tolerance, cheapest first: many uncommon elements, then many elements, empty ones last.
    worth = np.where(count == 0, -1, uncommon * 1024 + np.minimum(count, 1023))
    second = np.flatnonzero(deletable & (count > 0))
    unit_owner = np.concatenate([owner, owner[second]])
    unit_worth = np.concatenate([worth, worth[second] - 1025])
    unit_segment = np.concatenate([np.arange(owner.size), second])
    unit_again = np.arange(unit_owner.size) >= owner.size
    ranked = np.lexsort((unit_segment, unit_again, -unit_worth, unit_owner))
    starts = np.searchsorted(unit_owner[ranked], np.arange(of.size))
    place = np.arange(ranked.size) - starts[unit_owner[ranked]]
    taken = ranked[place < need[unit_owner[ranked]]]
    probed = np.zeros(owner.size, dtype=bool)
    probed[unit_segment[taken[~unit_again[taken]]]] = True
    tolerant = np.zeros(owner.size, dtype=bool)
    tolerant[unit_segment[taken[unit_again[taken]]]] = True

    node = prints[pick][of]
    whole = mix(total + salt)
    role = probed * PROBE + ~visiting[owner] * INDEX
    keep = role > 0
    parts = [(whole[keep], node[owner[keep]], role[keep])]
    # What is left of a segment without one element, for indexing and for probing.
    own = np.flatnonzero(deletable[segment])
    without = total[segment[own]] - value[own] + salt[segment[own]]
    indexed = ~visiting[owner[segment[own]]]
    parts.append((mix(without[indexed] + _DELETED), node[owner[segment[own][indexed]]], np.full(int(indexed.sum()), INDEX)))
    probing = tolerant[segment[own]]
    parts.append((mix(without[probing]), node[owner[segment[own][probing]]], np.full(int(probing.sum()), PROBE)))
    parts.append((mix((total + salt)[tolerant] + _DELETED), node[owner[tolerant]], np.full(int(tolerant.sum()), PROBE)))
    return tuple(np.concatenate(column) for column in zip(*parts))


def signatures(documents: DataFrame, k: int, bands: Bands, frequent: np.ndarray) -> DataFrame:
    """The rows of all sets that are to meet by their signature."""
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast((bands, frequent))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0), SMALL_BLOCK):
                sets = _sets(data, offsets, k)
                sig, node, role = _signatures(sets, _nodes(sets)[1], *sent.value)
                yield meeting_batch(sig, node, role)

    rows = documents.select(F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, MEETING)


class _Compare:
    """Compares the sets of members with their hub's; a hub's rows come in a run, the hub first, then its guides.

    Elements of a difference are ordered by the guides that differ from the hub in them; then come those that
    only the member has, ``frequent`` n-grams late, before those that only the hub has. All runs of a hub have
    the same guides, so the order is one for all its members.
    """

    def __init__(self, k: int, percent: int, frequent: np.ndarray):
        self.k, self.percent, self.frequent = k, percent, frequent
        self.bands = Bands(percent, 1)

    def member(
        self, hub: np.ndarray, own: np.ndarray, listed: bool, usual: tuple[np.ndarray, np.ndarray]
    ) -> tuple[bool, int, np.ndarray]:
        """Whether the sets link, the size of their difference, and the first elements of it, if ``listed``.

        ``usual`` are the elements in which guides differ from the hub, sorted, and the number of these guides.
        """
        beyond = np.setdiff1d(own, hub, assume_unique=True)
        both = own.size - beyond.size
        apart = own.size + hub.size - 2 * both
        linked = 100 * both >= self.percent * (own.size + hub.size - both)
        if not listed:
            return linked, apart, own[:0]
        if self.frequent.size and beyond.size:
            at = np.minimum(np.searchsorted(self.frequent, beyond), self.frequent.size - 1)
            late = self.frequent[at] == beyond
            beyond = np.concatenate([beyond[~late], beyond[late]])
        most = int(self.bands.differences(own.size, own.size * 100 // self.percent)) + 1
        often, times = usual
        if often.size or beyond.size < most:
            beyond = np.concatenate([beyond, np.setdiff1d(hub, own, assume_unique=True)])
        if often.size:
            at = np.minimum(np.searchsorted(often, beyond), often.size - 1)
            beyond = beyond[np.argsort(np.where(often[at] == beyond, times[at], 0), kind="stable")]
        return linked, apart, beyond[:most]

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_sets, guides, usual = None, [], [], None
        for batch in batches:
            for first, last, data, offsets in text_blocks(batch.column(6), SMALL_BLOCK):
                part = batch.slice(first, last - first)
                sets = _sets(data, offsets, self.k)
                prints = _nodes(sets)[1]
                hubs, salts, nodes, hashes, listed = (part.column(c).to_pylist() for c in (0, 1, 3, 4, 5))
                kinds = part.column(2).to_pylist()
                out = []
                for i in range(len(sets)):
                    if prints[i] != hashes[i]:
                        continue  # another text with the same id
                    at = hubs[i], salts[i]
                    if kinds[i] == HUB:
                        hub, hub_sets, guides, usual = at, [*(hub_sets if hub == at else []), sets[i]], [], None
                        continue
                    if kinds[i] == GUIDE:
                        if hub == at:
                            guides.append(np.setxor1d(hub_sets[0], sets[i], assume_unique=True))
                        continue
                    if usual is None:
                        usual = np.unique(np.concatenate([*guides, np.zeros(0, np.uint64)]), return_counts=True)
                        guides = []
                    for hub_set in hub_sets if hub == at else []:
                        linked, apart, prefix = self.member(hub_set, sets[i], listed[i], usual)
                        out.append((hubs[i], nodes[i], linked, sets[i].size, apart, prefix.view(np.int64)))
                columns = zip(*out) if out else [[]] * 6
                types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type) for c, type in zip(columns, types)],
                    names=["hub", "node", "linked", "size", "apart", "prefix"],
                )


def compare(documents: DataFrame, nodes: DataFrame, pairs: DataFrame, compared: _Compare) -> DataFrame:
    """``hub, node, linked, size, apart, prefix`` for ``pairs(hub, node, listed)`` of nodes.

    Texts go to the hub's place, and the hub's own text and its guides' with them, once for every ``MEMBERS``
    members; so neither a large group nor its texts come together in one task. Guides are picked by hash
    among the listed members, one for every ``GUIDED`` of them up to ``GUIDES``.
    """
    sizes = pairs.groupBy("hub").agg(
        F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts"),
        F.least(F.floor(F.count_if("listed") / GUIDED), F.lit(GUIDES)).cast("int").alias("guides"),
    )
    hashed = F.xxhash64("node")
    salted = pairs.join(sizes, "hub").withColumn("salt", F.pmod(hashed, F.col("salts")).cast("int"))
    salted = salted.select("hub", "salt", F.lit(MEMBER).alias("kind"), "node", "listed")
    every = F.explode(F.expr("sequence(0, salts - 1)")).alias("salt")
    heads = sizes.select("hub", every, F.lit(HUB).alias("kind"), F.col("hub").alias("node"), F.lit(False).alias("listed"))
    guides = pairs.filter("listed").join(sizes.filter("guides > 0"), "hub")
    guides = guides.groupBy("hub", "salts", F.pmod(F.shiftright(hashed, 32), F.col("guides")).alias("place"))
    guides = guides.agg(F.min_by("node", hashed).alias("node"))
    guides = guides.select("hub", every, F.lit(GUIDE).alias("kind"), "node", F.lit(False).alias("listed"))
    asked = salted.unionByName(heads).unionByName(guides)
    asked = stage(asked.join(nodes.select("node", "hash"), "node"))
    texts = documents.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    some, _ = split_by_keys(texts, "node", asked.select("node"))
    rows = some.join(asked, "node")
    rows = rows.select("hub", "salt", "kind", "node", "hash", "listed", "text")
    placed = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "kind", "node")
    schema = "hub long, node long, linked boolean, size long, apart long, prefix array<long>"
    return placed.mapInArrow(frugal(compared.run), schema)


def _beside_hub(found: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """``hub, node``: pairs of members of one hub, one of them not near it, that may link.

    In the order of ``prefix``, what stands before the first common element of two differences is in one
    of them alone, and no more can be common than what stands from there on. Members that ``links(a, b)``
    already hold together need no pair; nor does an element that only one such component has.
    """
    held = connected(links).withColumnRenamed("component", "label")
    open_hubs = found.groupBy("hub").agg(F.count("*").alias("n"), F.bool_and("linked").alias("done"))
    open_hubs = open_hubs.filter("n > 1 and not done").select("hub")
    labelled = found.join(open_hubs, "hub", "left_semi").join(held, "node", "left")
    rows = labelled.select(
        "hub",
        "node",
        "linked",
        "size",
        "apart",
        F.coalesce("label", "node").alias("label"),
        F.posexplode("prefix").alias("at", "element"),
    )
    # Most elements are one member's own: they are shuffled once, and only what is shared meets itself.
    meeting = Window.partitionBy("hub", "element")
    rows = rows.withColumns({"low": F.min("label").over(meeting), "high": F.max("label").over(meeting)})
    rows = stage(rows.filter("low < high").drop("low", "high"))
    right = rows.select("hub", "element", *(F.col(c).alias(f"r_{c}") for c in ("node", "linked", "size", "apart", "label", "at")))
    most = F.floor((F.col("size") + F.col("r_size")) * (100 - percent) / (100 + percent))
    rest = F.least(F.col("apart") - F.col("at"), F.col("r_apart") - F.col("r_at"))
    left = rows.filter(~F.col("linked"))
    pairs = left.join(right, ["hub", "element"]).filter(
        (F.col("label") != F.col("r_label"))
        & (F.col("r_linked") | (F.col("node") < F.col("r_node")))
        & (F.col("at") + F.col("r_at") <= most)
        & (F.col("apart") + F.col("r_apart") - 2 * rest <= most)
        & (F.least("size", "r_size") * 100 >= F.greatest("size", "r_size") * percent)
    )
    return pairs.select(F.col("node").alias("hub"), F.col("r_node").alias("node")).distinct()


def linked_nodes(documents: DataFrame, nodes: DataFrame, met: DataFrame, compared: _Compare) -> DataFrame:
    """``a, b``: links that hold together every component of the nodes that meet."""
    degrees = met.groupBy("node").agg(F.count("*").alias("degree"))
    ranked = met.join(degrees, "node")
    hubs = ranked.groupBy("sig").agg(F.max(F.struct("degree", "node")).alias("best")).select("sig", F.col("best.node").alias("hub"))
    pairs = met.join(hubs, "sig").filter("node <> hub").select("hub", "node").distinct()
    size = nodes.select("node", "size")
    pairs = pairs.join(size, "node").join(size.toDF("hub", "hub_size"), "hub")
    alone = pairs.groupBy("hub").agg((F.count("*") == 1).alias("alone"))
    pairs = pairs.join(alone, "hub")
    # A hub's only member matters only if the sizes allow a link.
    near = F.least("size", "hub_size") * 100 >= F.greatest("size", "hub_size") * compared.percent
    pairs = stage(pairs.filter(~F.col("alone") | near).select("hub", "node", (~F.col("alone")).alias("listed")))
    found = stage(compare(documents, nodes, pairs, compared))
    ends = [F.col("hub").alias("a"), F.col("node").alias("b")]
    first = stage(found.filter("linked").select(ends).distinct())
    beside = stage(_beside_hub(found, first, compared.percent)).withColumn("listed", F.lit(False))
    more = compare(documents, nodes, beside, compared).filter("linked").select(ends)
    return stage(first.unionByName(more).distinct())


def jaccard_components(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` of every row of ``documents(doc_id, text)``.

    Words are lower-cased (A-Z) runs without ASCII white space; a document's set holds its distinct runs of
    ``k`` words, or all its words as one if it has fewer. Documents link when ``100 * intersection >=
    percent * union``; the component is the smallest id reachable. ``n_links`` counts the verified links
    of the document's set with other sets, enough to hold the component together. A null, empty or blank
    text has the empty set, links with nothing and is its own component. Rows that repeat an id with the
    same text are returned as often; one id with several texts joins their components through it. A row
    with a null id is returned with a null component and links with nothing. Other columns are ignored.
    """
    sized = stage(document_sets(documents, k))
    members = sized.filter("kind = 0").select("id", "number", "hash")
    total, largest = members.agg(F.count("*"), F.max("number")).head()
    # A node goes by the smallest document that has the set.
    nodes = members.filter("id is not null and number > 0").groupBy("hash")
    nodes = stage(nodes.agg(F.min("id").alias("node"), F.max("number").alias("size")))
    often = sized.filter("kind = 1").groupBy("hash").agg(F.sum("number").alias("n"))
    often = often.filter(F.col("n") * FREQUENT_SHARE >= total).orderBy(F.desc("n"), "hash").limit(FREQUENT_KEPT)
    frequent = np.sort(often.select("hash").toArrow().column(0).to_numpy().view(np.uint64))
    rows = signatures(documents.filter("doc_id is not null"), k, Bands(percent, largest or 1), frequent)
    met = met_rows(rows).withColumnRenamed("node", "hash")
    met = stage(met.join(nodes.select("hash", "node"), "hash").select("sig", "node").distinct())
    links = linked_nodes(documents, nodes, met, _Compare(k, percent, frequent))
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    labels = connected(links).join(ends, "node")
    named = members.join(nodes.select("hash", "node"), "hash", "left")
    named = named.withColumn("node", F.when(F.col("number") > 0, F.col("node")).otherwise(F.col("id")))
    named = named.withColumn("node", F.when(F.col("id").isNotNull(), F.col("node"))).join(labels, "node", "left")
    return named.select(
        F.col("id").alias("doc_id"),
        F.col("number").alias("n_shingles"),
        F.coalesce("component", "node").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those of a component that a smaller id stands for.

    Of rows that repeat the staying id, all stay. Rows with a null id stay.
    """
    found = jaccard_components(documents, k, percent)
    gone = stage(found.filter("component_id <> doc_id").select("doc_id").distinct())
    some, rest = split_by_keys(documents, "doc_id", gone)
    return some.join(gone, "doc_id", "left_anti").select(*documents.columns).unionByName(rest)
