"""Token counts by a two-tier lookup of pre-token lengths, map-side only.

A text is cut into pre-tokens before every run of spaces.  No piece of the vocabulary holds the space
mark after another character, so the tokens of a text are the tokens of its pre-tokens.  Tier one is a
broadcast table with the lengths of frequent pre-tokens; tier two is a worker-local cache in front of
the tokenizer.  Pre-tokens are never shuffled: each task tells the driver its heaviest ones, and what
all tasks tell together is bounded, however many they are.

Both tiers are caches: the counts are those of the library whatever the tables hold.  Null and empty
texts have 0 bytes and 0 tokens; repeated rows are counted each; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import pieces

MARK = "▁"
_PRE = re.compile(r" +[^ ]*")
_loaded: dict[str, object] = {}
_misses: dict[str, dict[str, int]] = {}


def _library(name: str):
    if name not in _loaded:
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path(name)))
        cut = re.compile(f"[^{MARK}]{MARK}")
        if any(cut.search(model.id_to_piece(i)) for i in range(model.get_piece_size())):
            raise ValueError(f"{name}: a piece crosses a space, pre-tokens can't be counted apart")
        _loaded[name] = model
    return _loaded[name]


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text; each begins with the space mark that the library puts in front."""
    return _PRE.findall(" " + text.replace(MARK, " ")) if text else []


def _length(model, word: str) -> int:
    # the library puts one mark in front of what it encodes; a lone mark is one token
    return len(model.encode(word[1:])) if len(word) > 1 else 1


def shares(tasks: int, per_task: int, told: int) -> tuple[int, int]:
    """How many pre-tokens each task tells, and into how many slices pre-tokens are dealt."""
    own = max(1, min(per_task, told // max(1, tasks)))
    return own, -(-per_task // own)


def frequent_lengths(docs: DataFrame, name: str, text: str = "text", per_task: int = 4096, size: int = 65536, held: int = 200_000, told: int = 1 << 17) -> dict[str, int]:
    """Lengths of the ``size`` heaviest pre-tokens; bounded by parameters, whatever the corpus.

    Every text is counted.  A task that holds over ``held`` distinct pre-tokens halves its counts and
    drops the ones that reach zero, so its memory is bounded too.  All tasks together tell at most
    ``told`` pre-tokens (one each at least).  Beyond ``told / per_task`` tasks each tells fewer, and only
    those of one slice, dealt by hash: tasks of the same slice tell of the same pre-tokens, and all
    slices together still hold about ``per_task`` of the heaviest.
    """
    own, slices = shares(docs.rdd.getNumPartitions(), per_task, told)

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen: Counter[str] = Counter()
        for batch in batches:
            for part in pieces(batch, "text"):
                for value in part.column("text").to_pylist():
                    if value:
                        seen.update(_PRE.findall(" " + value.replace(MARK, " ")))
                while len(seen) > held:
                    seen = Counter({k: n >> 1 for k, n in seen.items() if n > 1})
        mine = TaskContext.get().partitionId() % slices
        top = Counter({w: n for w, n in seen.items() if n > 1 and len(w) <= 64 and (slices == 1 or crc32(w.encode()) % slices == mine)}).most_common(own)
        model = _library(name)
        yield pa.RecordBatch.from_pydict({"word": [w for w, _ in top], "seen": [n for _, n in top], "length": [_length(model, w) for w, _ in top]}, schema=pa.schema([("word", pa.string()), ("seen", pa.int64()), ("length", pa.int32())]))

    found = docs.select(F.col(text).alias("text")).mapInArrow(heavy, "word string, seen long, length int").toArrow()
    merged = found.group_by("word").aggregate([("seen", "sum"), ("length", "min")]).sort_by([("seen_sum", "descending"), ("word", "ascending")]).slice(0, size)
    return dict(zip(merged["word"].to_pylist(), merged["length_min"].to_pylist(), strict=True))


def count_tokens(docs: DataFrame, name: str = "piece_bpe_32k.model", limit: int = 4096, doc_id: str = "doc_id", text: str = "text", lengths: dict[str, int] | None = None, cached: int = 300_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; ``name`` is a file of the tokenizer library."""
    lengths = frequent_lengths(docs, name, text) if lengths is None else lengths
    shared = docs.sparkSession.sparkContext.broadcast(lengths)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, model = shared.value, _library(name)
        missed = _misses.setdefault(name, {})
        for batch in batches:
            for part in pieces(batch, "text"):
                totals, sizes = [], []
                for value in part.column("text").to_pylist():
                    total = 0
                    for word in _PRE.findall(" " + value.replace(MARK, " ")) if value else ():
                        n = common.get(word) or missed.get(word)
                        if n is None:
                            n = _length(model, word)
                            if len(word) <= 64:
                                if len(missed) >= cached:
                                    missed.clear()
                                missed[word] = n
                        total += n
                    totals.append(total)
                    sizes.append(len(value.encode()) if value else 0)
                n_tokens = pa.array(totals, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), n_tokens, pa.compute.greater(n_tokens, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
