"""Line dedup that can be undone: sharded cuckoo filters over exact reference counts.

``references`` is the exact table: one row per line key and document with its
number of lines. A key is *blocked* while at least ``min_docs`` documents hold
it. Cuckoo filters, one per shard of keys, hold the blocked keys; inserting or
deleting documents changes the counts, and each key that crosses the limit is
inserted into or deleted from its shard's filter. Cleaning asks the filters
first and looks only the hits up in the exact counts, so a filter's false
positives never change a result.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.llm.common import part_of, parts_for, texts_of, total_bytes, written

STRIPPED = " \t\n\x0b\x0c\r"
MIN_LENGTH = 40  # code points of a key
MIN_DOCS = 5
SLOTS = 4
KICKS = 500
FILTER_KEYS = 500_000  # keys in one filter, at most about a megabyte
CELL_ROWS = 1_000_000  # references asked of one filter in one task
PART_BYTES = 8 << 20


def line_key(line: str) -> str:
    """The line without white space at its ends, A-Z in lower case."""
    return line.strip(STRIPPED).encode().lower().decode()


def key_digest(line: str, min_length: int) -> bytes | None:
    """128-bit digest of a line's key, none for short keys."""
    bare = line.strip(STRIPPED)
    if len(bare) < min_length:
        return None
    return blake2b(bare.encode().lower(), digest_size=16).digest()


class CuckooFilter:
    """Set of 16-byte digests in buckets of four 16-bit fingerprints."""

    def __init__(self, table: np.ndarray):
        self.table, self.mask = table, len(table) - 1

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, keys) / SLOTS / 0.85))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def of(cls, keys: list[bytes]) -> CuckooFilter:
        made = cls.sized(len(keys))
        while not all(map(made.insert, keys)):  # too full: twice the buckets
            made = cls(np.zeros((2 * len(made.table), SLOTS), np.uint16))
        return made

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, key: bytes) -> tuple[int, int, int]:
        print_ = int.from_bytes(key[:2], "little") or 1
        first = int.from_bytes(key[2:10], "little") & self.mask
        return print_, first, self._other(first, print_)

    def _other(self, bucket: int, print_: int) -> int:
        return (bucket ^ (print_ * 0x5BD1E995)) & self.mask

    def __contains__(self, key: bytes) -> bool:
        print_, a, b = self._places(key)
        return bool((self.table[a] == print_).any() or (self.table[b] == print_).any())

    def insert(self, key: bytes) -> bool:
        """False when no place was found; the filter must then be built anew."""
        print_, a, b = self._places(key)
        for at in (a, b):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = print_
                return True
        for kick in range(KICKS):
            slot = (kick + print_) % SLOTS
            print_, self.table[a, slot] = int(self.table[a, slot]), print_
            a = self._other(a, print_)
            free = np.flatnonzero(self.table[a] == 0)
            if len(free):
                self.table[a, free[0]] = print_
                return True
        return False

    def delete(self, key: bytes) -> bool:
        print_, a, b = self._places(key)
        for at in (a, b):
            held = np.flatnonzero(self.table[at] == print_)
            if len(held):
                self.table[at, held[0]] = 0
                return True
        return False


def references(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """``key, doc_id, lines``: one row per long line key and document. Rows without
    a ``doc_id`` are no documents and are not counted."""

    def found(batches):
        for batch in batches:
            keys, ids, lines = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen: dict[bytes, int] = {}
                for line in text.split("\n"):
                    if digest := key_digest(line, min_length):
                        seen[digest] = seen.get(digest, 0) + 1
                keys += seen
                ids += [doc] * len(seen)
                lines += seen.values()
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(lines, pa.int64())],
                ["key", "doc_id", "lines"],
            )

    rows = texts_of(docs).where(F.col("doc_id").isNotNull()).mapInArrow(found, "key binary, doc_id long, lines long")
    return rows.groupBy("key", "doc_id").agg(F.sum("lines").alias("lines"))


@dataclass
class LineIndex:
    """Exact references and the filters of the blocked keys, both written tables."""

    references: DataFrame
    blocked: DataFrame  # key, n_docs, last_doc
    filters: DataFrame  # shard, filter
    shards: int
    min_docs: int = MIN_DOCS
    min_length: int = MIN_LENGTH

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = MIN_DOCS, min_length: int = MIN_LENGTH) -> LineIndex:
        refs = written(references(docs, min_length), "line-references")
        blocked = written(_blocked(refs, min_docs), "line-blocked")
        shards = parts_for(blocked.count(), FILTER_KEYS)
        return cls(refs, blocked, written(_filters(blocked, shards), "line-filters"), shards, min_docs, min_length)

    def insert(self, docs: DataFrame) -> LineIndex:
        """Index with more documents; one whose id is there already adds its lines to it."""
        both = self.references.unionByName(references(docs, self.min_length))
        return self._changed(both.groupBy("key", "doc_id").agg(F.sum("lines").alias("lines")))

    def delete(self, ids: DataFrame) -> LineIndex:
        """Index without the documents named in ``doc_id`` of ``ids``."""
        gone = ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        return self._changed(self.references.join(gone, "doc_id", "left_anti").select("key", "doc_id", "lines"))

    def _changed(self, refs: DataFrame) -> LineIndex:
        refs = written(refs, "line-references")
        blocked = written(_blocked(refs, self.min_docs), "line-blocked")
        crossed = (
            self.blocked.select("key", F.lit(-1).alias("by"))
            .unionByName(blocked.select("key", F.lit(1).alias("by")))
            .groupBy("key").agg(F.sum("by").alias("by")).where("by <> 0")
            .withColumn("shard", part_of("key", self.shards))
        )

        def changed(filters: pa.Table, keys: pa.Table) -> pa.Table:
            held = filters.column("filter").to_pylist()
            made = CuckooFilter.load(held[0]) if held else CuckooFilter.sized(keys.num_rows)
            todo = sorted(zip(keys.column("by").to_pylist(), keys.column("key").to_pylist()))
            whole = True
            for by, key in todo:
                whole &= made.insert(key) if by > 0 else made.delete(key)
            shard = (filters if held else keys).column("shard")[0].as_py()
            return pa.table({"shard": pa.array([shard], pa.int32()), "filter": [made.dump() if whole else None]})

        filters = written(
            self.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInArrow(
                changed, "shard int, filter binary"
            ),
            "line-filters",
        )
        if filters.where("filter IS NULL").limit(1).count():  # one ran full: build them anew, sized to the keys
            shards = parts_for(blocked.count(), FILTER_KEYS)
            return LineIndex(refs, blocked, written(_filters(blocked, shards), "line-filters"), shards,
                             self.min_docs, self.min_length)
        return LineIndex(refs, blocked, filters, self.shards, self.min_docs, self.min_length)

    def dropped(self) -> DataFrame:
        """``doc_id, key`` of the lines to drop: blocked keys, except in the
        largest document that holds each. Filters are asked in cells of a shard
        and a slice of the documents, so a key that a third of all documents hold
        spreads over many tasks."""
        salts = parts_for(self.references.count(), CELL_ROWS * self.shards)
        asked = self.references.select(
            part_of("key", self.shards).alias("shard"), part_of("doc_id", salts).alias("salt"), "key", "doc_id"
        )
        filters = self.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

        def hits(rows: pa.Table, held: pa.Table) -> pa.Table:
            got = held.column("filter").to_pylist()
            if not got:
                return rows.select(["doc_id", "key"]).slice(0, 0)
            known = CuckooFilter.load(got[0])
            keys = rows.column("key").combine_chunks()
            coded = keys.dictionary_encode()
            if isinstance(coded, pa.ChunkedArray):
                coded = coded.combine_chunks()
            yes = np.fromiter((k in known for k in coded.dictionary.to_pylist()), bool, len(coded.dictionary))
            return rows.select(["doc_id", "key"]).filter(pa.array(yes[coded.indices.to_numpy(zero_copy_only=False)]))

        maybe = asked.groupBy("shard", "salt").cogroup(filters.groupBy("shard", "salt")).applyInArrow(
            hits, "doc_id long, key binary"
        )
        return maybe.join(self.blocked, "key").where("doc_id <> last_doc").select("doc_id", "key")

    def clean(self, docs: DataFrame, counts: bool = False) -> DataFrame:
        """``docs`` with the dropped lines taken out of ``text``; other lines stay,
        joined by line breaks. A null text or id stays as it is. With ``counts``
        the columns ``n_lines`` (before) and ``n_dropped`` are added."""
        parts = parts_for(total_bytes(docs), PART_BYTES)
        gone = self.dropped().withColumn("__part", part_of("doc_id", parts))
        # columns by place, so that no name of the table can be one of the names used here
        names, min_length = docs.columns, self.min_length
        key, at = f"c{names.index('doc_id')}", names.index("text")
        rows = docs.toDF(*(f"c{i}" for i in range(len(names))))
        schema = T.StructType(list(rows.schema.fields))
        if counts:
            schema = schema.add("n_lines", "long").add("n_dropped", "long")

        def cut(table: pa.Table, drops: pa.Table) -> pa.Table:
            drop: dict[int, set[bytes]] = {}
            for doc, line in zip(drops.column("doc_id").to_pylist(), drops.column("key").to_pylist()):
                drop.setdefault(doc, set()).add(line)
            out, n_lines, n_dropped = [], [], []
            for doc, text in zip(table.column(key).to_pylist(), table.column(at).to_pylist()):
                lines = (text or "").split("\n")
                bad = drop.get(doc)
                kept = [x for x in lines if key_digest(x, min_length) not in bad] if bad else lines
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
                out.append("\n".join(kept) if len(kept) < len(lines) else text)
            table = table.select(range(len(names))).set_column(at, f"c{at}", pa.array(out, pa.string()))
            if counts:
                table = table.append_column("n_lines", pa.array(n_lines, pa.int64()))
                table = table.append_column("n_dropped", pa.array(n_dropped, pa.int64()))
            return table

        def uncut(batches):
            none = pa.table({"doc_id": pa.array([], pa.int64()), "key": pa.array([], pa.binary())})
            for batch in batches:
                yield from cut(pa.Table.from_batches([batch]), none).to_batches()

        # rows without an id lose no lines; they stay out of the groups, where all would meet in one
        named = rows.where(f"{key} IS NOT NULL").withColumn("__part", part_of(key, parts))
        done = named.groupBy("__part").cogroup(gone.groupBy("__part")).applyInArrow(cut, schema).unionByName(
            rows.where(f"{key} IS NULL").mapInArrow(uncut, schema)
        )
        return done.toDF(*names, *schema.names[len(names) :])


def _blocked(refs: DataFrame, min_docs: int) -> DataFrame:
    return (
        refs.groupBy("key")
        .agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        .where(F.col("n_docs") >= min_docs)
    )


def _filters(blocked: DataFrame, shards: int) -> DataFrame:
    def build(table: pa.Table) -> pa.Table:
        made = CuckooFilter.of(table.column("key").to_pylist())
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "filter": [made.dump()]})

    return (
        blocked.select("key", part_of("key", shards).alias("shard"))
        .groupBy("shard").applyInArrow(build, "shard int, filter binary")
    )
