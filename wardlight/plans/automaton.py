"""Many short strings looked for in many texts: one Aho-Corasick automaton per
bounded shard of strings, run over each text once.

The strings are dealt into shards of at most ``SHARD_CHARS`` characters. A shard is
broadcast, every Python worker builds its automaton once, and the texts are scanned where
they lie; only the found pairs leave a task.
"""

from __future__ import annotations

from collections import OrderedDict
from functools import reduce
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from wardlight.plans.session import materialise

SHARD_CHARS = 2_000_000
SHARDS = 8  # scans of the texts that are still cheaper than preparing them
KEPT = 2  # automata a worker keeps
_built: OrderedDict = OrderedDict()


def shards_of(strings: DataFrame, text: str) -> int:
    """Shards that the distinct strings need."""
    chars = strings.agg(F.sum(F.char_length(text) + 1)).first()[0] or 0
    return max(1, -(-chars // SHARD_CHARS))


def _automaton(name: str, strings: list[str]):
    import ahocorasick

    if name not in _built:
        made = ahocorasick.Automaton()
        for place, string in enumerate(strings):
            if string:
                made.add_word(string, place)
        made.make_automaton()
        _built[name] = made
        while len(_built) > KEPT:
            _built.popitem(last=False)
    _built.move_to_end(name)
    return _built[name]


def find_strings(strings: DataFrame, texts: DataFrame, shards: int) -> DataFrame:
    """Pairs of ids of a string and a text that contains it. ``strings`` is (id, string), each
    string once; ``texts`` (id, text), both named as they are in the result. The empty string is
    in every text; nulls match nothing. The texts are not shuffled."""
    strings = strings.where(F.col("string").isNotNull())
    parts = []
    for i in range(shards):
        # a shard holds about SHARD_CHARS characters
        shard = strings.where(F.pmod(F.xxhash64("string"), F.lit(shards)) == i)
        sent = texts.sparkSession.sparkContext.broadcast([tuple(r) for r in shard.collect()])
        part = _scan(sent, strings.schema[0], texts)
        if shards > SHARDS:  # one shard after the other, so that the driver holds one only
            part = materialise(part)
            sent.destroy()
        parts.append(part)
    return reduce(DataFrame.unionByName, parts)


def _scan(sent, string_id, texts: DataFrame) -> DataFrame:
    name, text_id = uuid4().hex, texts.schema[0]
    kind = to_arrow_type(string_id.dataType)
    schema = StructType([string_id, text_id])

    def scan(batches):
        ids, strings = [n for n, _ in sent.value], [s for _, s in sent.value]
        everywhere = [place for place, s in enumerate(strings) if not s]
        automaton = _automaton(name, strings) if len(strings) > len(everywhere) else None
        for batch in batches:
            owners, found = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                hits = {place for _, place in automaton.iter(text)} if automaton else set()
                hits.update(everywhere)
                owners += [row] * len(hits)
                found += [ids[place] for place in hits]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, kind), batch.column(0).take(pa.array(owners, pa.int64()))], [string_id.name, text_id.name]
            )

    return texts.where(F.col(texts.columns[1]).isNotNull()).mapInArrow(scan, schema)
