"""Token counts (operator 9): lengths only, from batch encoding in Arrow functions.

Rows are taken in batches balanced by bytes. The tokenizer drops white space and never joins what
stands on either side of a space or a line break, so texts are split there into words, long texts
included, and the counts of the parts add up. A word that a worker has counted before is looked up
in a table of bounded size; the others of a batch are encoded together.

Defined results: a null text counts like an empty one (0 bytes, 0 tokens); repeated rows each get a
result; other columns are ignored whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from assaylane.llm.common import chunks_by_size, worker_cache

BATCH_BYTES = 4 << 20
KNOWN_WORDS = 1 << 20  # words a worker remembers
LONG_WORD = 1 << 10  # longer words are counted each time


def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _stem(word: str) -> tuple[str, int]:
    """A word that is counted in its place, and the tokens to add: a comma or point after an ASCII letter or
    digit is a token of its own, and ASCII capitals count as small letters. Special tokens are matched in small letters
    only, so what may hold one is left as it is."""
    if "<|" in word:
        return word, 0
    if word[-1:] in (",", ".") and word[-2:-1].isascii() and word[-2:-1].isalnum():
        return (word[:-1].lower() if word.isascii() else word[:-1]), 1
    return (word.lower() if word.isascii() else word), 0


def _counts(tokenizer, known: dict[str, int], texts: list[str]) -> list[int]:
    """Tokens of every text of a batch."""
    words = [t.replace("\n", " ").split(" ") for t in texts]
    every = set().union(*words)
    if len(known) + len(every) > KNOWN_WORDS:
        known.clear()
    new = {w: _stem(w) for w in every.difference(known)}
    stems = list({s for s, _ in new.values()}.difference(known))
    fresh = {
        s: len(e.ids) for s, e in zip(stems, tokenizer.encode_batch_fast(stems, add_special_tokens=False), strict=True)
    }
    known.update(fresh)
    known.update((w, known[s] + more) for w, (s, more) in new.items())
    counts = [sum(map(known.__getitem__, w)) for w in words]
    for w in {*new, *fresh}:
        if len(w) > LONG_WORD:
            known.pop(w, None)
    return counts


def count_tokens(docs: DataFrame, path: str, limit: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: ``key``, n_bytes, n_tokens, over_limit. ``path``: a tokenizer file of .json form."""
    named = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    key_type = to_arrow_type(named.schema["key"].dataType)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_cache(("tokenizer", path), lambda: _tokenizer(path))
        known = worker_cache(("known", path), dict)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            sizes = [len(t.encode()) for t in texts]
            counts: list[int] = []
            for begin, end in chunks_by_size(sizes, BATCH_BYTES):
                counts += _counts(tokenizer, known, texts[begin:end])
            yield pa.record_batch(
                [batch.column("key").cast(key_type), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                names=["key", "n_bytes", "n_tokens"],
            )

    schema = f"key {named.schema['key'].dataType.simpleString()}, n_bytes long, n_tokens long"
    counted = named.mapInArrow(count, schema)
    return counted.select(
        F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
