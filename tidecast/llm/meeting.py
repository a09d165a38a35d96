"""Rows that meet by a signature: what similarity joins of n-gram sets and of lines share.

A row says that a node indexes or probes a signature. Nodes that meet are candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.textbytes import frugal

INDEX, PROBE = 1, 2
MEETING = "place long, node long"
#: Nodes are hashes whose last two bits are free; on their way to the meeting they hold the role.
ROLES = 3
#: The last bits of a place hold the salt, those before them the signature. Signatures that differ in these
#: bits alone meet in vain, which costs a look at one candidate more.
SALTS = 127
#: Nodes of one block that may share a signature before one of them goes for all.
LOCAL_HOT = 16
#: Largest key filter that is sent to the executors, in words of 64 bits.
FILTER_WORDS = 1 << 20


def node_ids(hashes: np.ndarray) -> np.ndarray:
    """Hashes as nodes: signed, with free last bits."""
    return (hashes & ~np.uint64(ROLES)).view(np.int64)


def meeting_batch(sig: np.ndarray, node: np.ndarray, role: np.ndarray) -> pa.RecordBatch:
    """The rows of a block of texts, the roles inside the nodes.

    Where many nodes of the block share a signature, one of them goes to the meeting for all (salt 0, with
    the roles of all). They have met already, so all of them, that one too, are spread by a salt: it stays
    even if no other block has the signature. Rows of a signature and node may therefore repeat. Most of what
    a join shuffles are these rows, so they have no column that can be done without.
    """
    sig = sig & ~np.uint64(SALTS)
    order = np.argsort(sig, kind="stable")
    sig, node, role = sig[order], node[order], role[order].astype(np.int64)
    head = np.ones(sig.size, dtype=bool)
    head[1:] = sig[1:] != sig[:-1]
    start = np.flatnonzero(head)
    run_of = np.cumsum(head) - 1
    size = np.diff(np.append(start, sig.size))
    hot = (size > LOCAL_HOT)[run_of]
    salt = np.where(hot, 1 + ((node.view(np.uint64) >> np.uint64(8)) % np.uint64(64)).astype(np.int64), 0)
    for_all = np.flatnonzero(hot & head)
    if for_all.size:
        roles = np.bitwise_or.reduceat(role, start)[run_of[for_all]]
        sig, node, role = (np.append(a, b) for a, b in ((sig, sig[for_all]), (node, node[for_all]), (role, roles)))
        salt = np.append(salt, np.zeros(for_all.size, dtype=salt.dtype))
    columns = [pa.array(sig.view(np.int64) | salt), pa.array(node | role)]
    return pa.RecordBatch.from_arrays(columns, names=["place", "node"])


def met_rows(rows: DataFrame) -> DataFrame:
    """``sig, node, role`` of signatures that several nodes have, one of them probing another one's index.

    A signature and node may come more than once, with roles of its own or of all nodes it went for.
    """
    role = F.col("node").bitwiseAND(ROLES)
    own = F.col("node") - role
    meeting = Window.partitionBy("place")
    seen = rows.withColumns(
        {
            "low": F.min(own).over(meeting),
            "high": F.max(own).over(meeting),
            "roles": F.bit_or(role).over(meeting),
        }
    )
    salt = F.col("place").bitwiseAND(SALTS)
    kept = seen.filter((salt > 0) | ((F.col("low") < F.col("high")) & (F.col("roles") == ROLES)))
    return kept.select((F.col("place") - salt).alias("sig"), own.alias("node"), role.alias("role"))


def fresh_name(name: str, table: DataFrame) -> str:
    """``name``, lengthened until no column of the table has it."""
    taken = {column.lower() for column in table.columns}
    while name.lower() in taken:
        name += "_"
    return name


def split_by_keys(
    rows: DataFrame, key: str, wanted: DataFrame, rest_with: tuple[Callable, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``key`` may be in ``wanted``, which has one long column, and those whose key is not.

    A bit filter of the wanted keys is sent to the executors, so that only rows that pass it need to be
    shuffled for an exact join. It has a fixed largest size; where the keys are too many for it, more rows
    pass. Rows with a null key do not pass. ``rest_with`` is a function over the batches of the rows that do
    not pass, and its schema; it runs in the Python worker that sorts them out.
    """
    wanted = wanted.toDF("wanted_key").distinct()
    words = max(64, min(FILTER_WORDS, 1 << max(wanted.count() // 4, 1).bit_length()))
    bits = wanted.select(
        F.pmod(F.xxhash64("wanted_key"), F.lit(words)).cast("int").alias("word"),
        F.expr("shiftleft(1L, cast(pmod(shiftright(xxhash64(wanted_key), 40), 64) as int))").alias("bit"),
    )
    table = np.zeros(words, dtype=np.int64)
    got = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    sent = rows.sparkSession.sparkContext.broadcast(table)
    names = rows.columns
    place = names.index(key)
    hashed = F.xxhash64(F.col(key).cast("long"))
    named = rows.select(
        *(F.col(f"`{name}`") for name in names),
        F.pmod(hashed, F.lit(words)).alias(fresh_name("filter_word", rows)),
        F.pmod(F.shiftright(hashed, 40), F.lit(64)).alias(fresh_name("filter_bit", rows)),
    )
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def side(passing: bool) -> DataFrame:
        @frugal
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                word, bit = (batch.column(len(names) + i).to_numpy() for i in range(2))
                hit = pa.array((sent.value[word] >> bit) & 1 == 1)
                hit = pc.and_kleene(hit, batch.column(place).is_valid())
                yield batch.filter(hit if passing else pc.invert(hit)).select(list(range(len(names))))

        if passing or rest_with is None:
            return named.mapInArrow(run, fields)
        return named.mapInArrow(lambda batches: rest_with[0](run(batches)), rest_with[1])

    return side(True), side(False)


def with_keys(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose ``key`` is in ``wanted``, which has one long column; see ``split_by_keys``."""
    wanted = wanted.toDF("wanted_key").distinct()
    some, _ = split_by_keys(rows, key, wanted)
    return some.join(wanted, some[key] == wanted["wanted_key"], "left_semi")
