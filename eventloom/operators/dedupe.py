"""Exactly one row of each event that was delivered at least once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators.components import connected_components
from eventloom.session import written

#: Bits of the permuted identifier that name its shard; the rest is the remainder.
QUOTIENT_BITS = 16
#: Characters in the half of the identifier that is mixed, and bits of each.
_HEAD, _WIDE = 3, 21
_REST_BITS = _HEAD * _WIDE - QUOTIENT_BITS
#: Rows that a task gathers before it fills the shards that are whole.
ROWS_AT_ONCE = 500_000


def quotient_key(identifier: Column) -> Column:
    """The identifier, permuted: ``struct(quotient, rest, tail)``; null for a null identifier.

    The first three characters, as 63 bits, are one half of a Feistel round, the length in bytes and all further
    characters the other. The first half is mixed with a hash of the second one, which stays as it is, so the round can
    be undone and two identifiers have the same key only if they are equal: no false matches at any length. ``quotient``
    is the shard, ``rest`` and ``tail`` are the complete remainder that the shard stores.
    """
    code = lambda k: F.ascii(identifier.substr(F.lit(k + 1), F.lit(1))).cast("bigint")
    head = code(0)
    for k in range(1, _HEAD):
        head = F.shiftleft(head, _WIDE).bitwiseOR(code(k))
    tail = F.concat(F.octet_length(identifier).cast("string"), F.lit(":"), identifier.substr(F.lit(_HEAD + 1), F.length(identifier)))
    mixed = head.bitwiseXOR(F.shiftrightunsigned(F.xxhash64(tail), 64 - _HEAD * _WIDE))
    return F.when(
        identifier.isNotNull(),
        F.struct(
            F.shiftright(mixed, _REST_BITS).cast("int").alias("quotient"),
            mixed.bitwiseAND(F.lit((1 << _REST_BITS) - 1)).alias("rest"),
            tail.alias("tail"),
        ),
    )


def event_keys(events: DataFrame) -> DataFrame:
    """``(delivery_seq, quotient, rest, tail)``: the permuted identifiers by which a delivery is recognised, a row each.

    One is the id without outer blanks and letter case, after an ``i``; the other the session with its non-empty
    ``dedupe_hash``, after an ``h`` and the session's length, so that no two pairs run together.
    """
    session, digest = F.col("session_id"), F.col("dedupe_hash")
    by_id = F.concat(F.lit("i"), F.lower(F.btrim("id", F.lit(" \t\r\n"))))
    by_hash = F.when(digest != "", F.concat(F.lit("h"), F.length(session).cast("string"), F.lit(":"), session, digest))
    named = events.where("delivery_seq IS NOT NULL").select("delivery_seq", F.explode(F.array(by_id, by_hash)).alias("name"))
    return named.where("name IS NOT NULL").select("delivery_seq", quotient_key(F.col("name")).alias("k")).select("delivery_seq", "k.quotient", "k.rest", "k.tail")


def _inserted(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Insert remainders into a table: the first row of each different one, and ``(row, first row)`` of all others.

    Rows are compared by their whole remainder; of equal ones that with the least ``delivery_seq`` is first.
    """
    tail = rows.column("tail").combine_chunks().dictionary_encode().indices.to_numpy()
    quotient, rest, seq = (rows.column(c).to_numpy() for c in ("quotient", "rest", "delivery_seq"))
    order = np.lexsort((seq, tail, rest, quotient))
    new = np.ones(len(order), bool)
    new[1:] = False
    for column in (quotient[order], rest[order], tail[order]):
        new[1:] |= column[1:] != column[:-1]
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return order[new], order[~new], first[~new]


_ENTRIES = "delivery_seq bigint, quotient int, rest bigint, tail string, first_seq bigint"


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch the different identifiers, and links of the rows that repeat one; so a hot identifier is sent once
    a batch. A link has a ``first_seq`` and no remainder."""
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        kept, again, first = _inserted(rows)
        seq = rows.column("delivery_seq").to_numpy()
        entries = rows.take(pa.array(kept)).append_column("first_seq", pa.nulls(len(kept), pa.int64()))
        links = pa.table([seq[again], rows.column("quotient").to_numpy()[again], pa.nulls(len(again), pa.int64()), pa.nulls(len(again), pa.string()), seq[first]], entries.schema)
        yield from pa.concat_tables([entries, links]).combine_chunks().to_batches()


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fill the shards of a task, which come in the order of their quotients, with the identifiers sent to them; gives the
    links of repeated ones to the first. Only shards that are not whole yet are held."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= ROWS_AT_ONCE:
            rows = pa.Table.from_batches(held)
            quotient = rows.column("quotient").to_numpy()
            whole = int(np.searchsorted(quotient, quotient[-1]))
            yield from _found(rows.slice(0, whole))
            rest = rows.slice(whole)
            held, n = rest.combine_chunks().to_batches(), len(rest) if whole else 0
    if held:
        yield from _found(pa.Table.from_batches(held))


def _found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The links of the identifiers of whole shards, and those that were made before."""
    sent = rows.filter(rows.column("first_seq").is_valid()).select(["delivery_seq", "first_seq"])
    rows = rows.filter(rows.column("tail").is_valid())
    _, again, first = _inserted(rows)
    seq = rows.column("delivery_seq").to_numpy()
    found = pa.table([seq[again], seq[first]], names=["delivery_seq", "first_seq"])
    for table in (sent, found):
        yield from table.filter(pc.not_equal(table.column(0), table.column(1))).combine_chunks().to_batches()


def repeat_links(events: DataFrame) -> DataFrame:
    """Links ``(delivery_seq, first_seq)`` of each row that repeats an identifier to the first row that has it.

    Every identifier goes to the shard that its quotient names and is inserted there once, by its complete remainder.
    The repeats within one batch of a map task are linked before the shuffle, so an identifier that a third of all rows
    have is sent once a batch. A task takes the shards of its quotients one after the other from a sort that can spill, and
    the permutation fills them alike, so its memory is that of a few shards whatever the size of its partition.
    """
    local = event_keys(events).mapInArrow(_collapsed, _ENTRIES)
    placed = local.repartition(F.col("quotient")).sortWithinPartitions("quotient")
    return placed.mapInArrow(_shards, "delivery_seq bigint, first_seq bigint")


def repeated_deliveries(events: DataFrame) -> DataFrame:
    """Every row of an event but its first delivery: ``(delivery_seq, event_seq)``.

    Two rows are one event if their normalised ids are equal or if session and non-empty hash are, along chains;
    ``event_seq`` is the lowest ``delivery_seq`` of the event. Identifiers are inserted once into exact quotient tables
    (``repeat_links``); each repeat links to the first row with its identifier, and only linked rows take part in the
    component search along chains.

    Nulls: a null id, session or hash links nothing, a row with none of them is an event of its own; a row without
    ``delivery_seq`` is ignored. A blank id is an id like any other. Repeated rows with one ``delivery_seq`` count once.
    Empty input gives no rows. Extra columns are ignored, whatever their names.
    """
    parts = connected_components(repeat_links(events), "delivery_seq", "first_seq")
    return parts.where("node <> component").select(F.col("node").alias("delivery_seq"), F.col("component").alias("event_seq"))


def kept_events(events: DataFrame) -> DataFrame:
    """The rows of ``events`` that are the first delivery of their event, with all their columns."""
    return events.join(repeated_deliveries(events).select("delivery_seq"), "delivery_seq", "left_anti")


class QuotientTable:
    """A table of identifiers in the shared folder, in folders by batch and group of quotients.

    ``insert`` adds the identifiers that are not held and returns them. The remainders are stored whole, so a match is
    never false. A batch is joined with all identifiers held, a shuffle of the table; a stream without end that repeats only
    what is recent should take ``streaming.pipelines.distinct_hashes``, whose state is bounded.
    """

    _KIND = "rest bigint, tail string, quotient int, batch string, bucket int"

    def __init__(self, spark, path: str, groups: int = 64):
        self.spark, self.path, self.groups = spark, path, groups

    def held(self) -> DataFrame | None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return None  # the first batch finds no table
        return self.spark.read.schema(self._KIND).parquet(self.path)

    def insert(self, rows: DataFrame, column: str, batch: str) -> DataFrame:
        """Insert the identifiers in ``column`` under a batch's name; returns the new ones. Nulls are ignored.

        What the same batch inserted before is replaced and counts as new again, so a batch may be retried.
        """
        keyed = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("named"), quotient_key(F.col(column)).alias("key"))
        keys = keyed.select("named", "key.*", (F.col("key.quotient") % self.groups).alias("bucket"))
        new, held = keys.dropDuplicates(["quotient", "rest", "tail"]), self.held()
        if held is not None:
            new = new.join(held.where(F.col("batch") != batch), ["bucket", "quotient", "rest", "tail"], "left_anti")
        new = written(new, "quotient-batch")
        entries = new.select("rest", "tail", "quotient", "bucket").repartition("bucket")
        entries.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch={batch}")
        return new.select(F.col("named").alias(column))
