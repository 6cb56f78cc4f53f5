"""Texts are hashed in small groups, whatever the size of an Arrow batch."""

import pyarrow as pa

from weirline.llm import suffix_dedup


def test_a_worker_hashes_about_a_megabyte_at_once():
    texts = [bytes([65 + i]) * 300_000 for i in range(12)]
    batch = pa.RecordBatch.from_pydict({"row": list(range(12)), "data": texts})
    groups = list(suffix_dedup.read(iter([batch]), ("row",)))
    assert [p for _, _, parts in groups for p in parts] == texts
    assert max(sum(map(len, parts)) for _, _, parts in groups) <= 1_300_000
