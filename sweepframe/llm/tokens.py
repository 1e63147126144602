"""Encoding of a corpus with a public byte-level BPE vocabulary.

Method: a minimal acyclic transducer lexicon. One pass counts the words of all texts; the frequent ones are compiled with
their ids into a shared-suffix automaton, distributed as a file and memory-mapped by every task; words it lacks are merged
exactly by rank. The lexicon only decides speed: any lexicon, the empty one included, gives the same ids.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from . import lexicon

#: Folder of the public tokenizers, the vocabulary of ranks, and the lexicon's size in words (a bound, whatever the corpus).
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
LEXICON_WORDS = 65_536
#: Words a task counts before it passes them on, so that its memory is bounded.
COUNTER_WORDS = 200_000
# Fixed value: the pattern that cuts a text into words, as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of one word: the pair of lowest rank, leftmost first, is merged until none is left."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, at = min(((rank.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(itertools.pairwise(parts))))
        if best == 1 << 60:
            break
        pair = parts[at] + parts[at + 1]
        merged, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and parts[i] + parts[i + 1] == pair:
                merged.append(pair)
                i += 2
            else:
                merged.append(parts[i])
                i += 1
        parts = merged
    return [rank[p] for p in parts]


def merge_long(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """merge() for long words: a heap of pairs over a linked list, so a word of n bytes takes n log n steps."""
    import heapq

    n = len(word)
    end, nxt, prv = [i + 1 for i in range(n)], [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    dead = bytearray(n)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        j = nxt[i]
        if dead[i] or j < 0 or end[i] != mid or end[j] != stop:
            continue
        end[i], nxt[i], dead[j] = end[j], nxt[j], 1
        if nxt[j] >= 0:
            prv[nxt[j]] = i
        for a in (prv[i], i):
            if a >= 0 and (b := nxt[a]) >= 0 and (r := rank.get(word[a : end[b]])) is not None:
                heapq.heappush(heap, (r, a, end[a], end[b]))
    out, i = [], 0
    while i >= 0:
        out.append(rank[word[i : end[i]]])
        i = nxt[i]
    return out


def encode_word(word: bytes, rank: dict[bytes, int]) -> list[int]:
    whole = rank.get(word)
    return [whole] if whole is not None else merge(word, rank) if len(word) <= 64 else merge_long(word, rank)


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(word, n) over all texts; counted inside each task first, so what is shuffled is its distinct words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen = regex.compile(PATTERN).findall, Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([w.encode("utf-8", "replace") for w in seen], pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return batch

        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(find(t))
                if len(seen) > COUNTER_WORDS:
                    yield out()
        if seen:
            yield out()

    return df.where(F.col(text).isNotNull()).select(text).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(df: DataFrame, text: str, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, words: int = LEXICON_WORDS) -> str:
    """Count the words of all texts, compile the most frequent into an automaton, and hand its file to every executor.

    Returns the name under which SparkFiles finds it. At most `words` words of at most 64 bytes reach the driver.
    """
    spark = df.sparkSession
    frequent = word_counts(df, text).where("n > 1 and length(word) <= 64").orderBy(F.desc("n"), "word").limit(words).collect()
    rank = ranks(os.path.join(tokenizers, vocabulary))
    flat = lexicon.build({bytes(r.word): encode_word(bytes(r.word), rank) for r in frequent})
    name = f"lexicon-{hashlib.sha256(flat.tobytes()).hexdigest()[:24]}.bin"
    _distribute(spark, name, flat.tobytes())
    return name


def _distribute(spark: SparkSession, name: str, data: bytes) -> None:
    """Write a file to the shared folder, on whatever file system it is, and add it to the session's files."""
    jvm, target = spark._jvm, f"{shared_dir(spark).rstrip('/')}/{name}"
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        stream = fs.create(path, True)
        for i in range(0, len(data), 1 << 20):
            stream.write(bytearray(data[i : i + (1 << 20)]))
        stream.close()
    spark.sparkContext.addFile(target)


class Encoder:
    """Encodes lists of texts with a memory-mapped lexicon and exact merges behind it."""

    def __init__(self, name: str, vocabulary: str):
        path = SparkFiles.get(name)
        self.lexicon = lexicon.Lexicon(np.memmap(path, np.int64, "r"))
        self.rank = ranks(vocabulary)
        self.find = regex.compile(PATTERN).findall
        self.unseen = lru_cache(maxsize=65_536)(lambda w: encode_word(w, self.rank))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of all texts one after another; null and empty texts have none."""
        number: dict[str, int] = {}
        words = [[number.setdefault(w, len(number)) for w in self.find(t)] if t else [] for t in texts]
        raw = [w.encode("utf-8", "replace") for w in number]
        found = self.lexicon.find(raw)
        each = [self.lexicon.ids_of(k) if k >= 0 else np.array(self.unseen(w), np.int64) for k, w in zip(found.tolist(), raw)]
        if not each:
            return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64)
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        starts, pool = np.cumsum(sizes) - sizes, np.concatenate(each)
        order = np.fromiter(itertools.chain.from_iterable(words), np.int64)
        n = sizes[order]
        ends = np.cumsum(n)
        ids = pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[order] - (ends - n), n)] if len(order) else np.zeros(0, np.int64)
        per_word = np.concatenate([[0], ends])
        return per_word[np.cumsum([0, *map(len, words)])], ids


def encode(df: DataFrame, id_col: str, text: str, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, words: int = LEXICON_WORDS, counts_only: bool = False) -> DataFrame:
    """(id, ids ARRAY<INT>) of every row, or (id, n_tokens BIGINT) with counts_only.

    Null and empty texts have the empty list and size 0. Special tokens' strings are ordinary text. Repeated ids and texts
    each give their own row; texts of any length are encoded whole; other columns are ignored.
    """
    name = compile_lexicon(df, text, tokenizers, vocabulary, words)
    kind = df.schema[id_col].dataType.simpleString()
    path = os.path.join(tokenizers, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for b in batches:
            encoder = encoder or Encoder(name, path)
            texts = b.column(1).to_pylist()
            step = max(1, int(len(texts) * 4_000_000 / max(1, sum(len(t) for t in texts if t))))
            for i in range(0, len(texts), step):
                offsets, ids = encoder(texts[i : i + step])
                if counts_only:
                    value = pa.array(np.diff(offsets), pa.int64())
                else:
                    value = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, step), value], [id_col, "n_tokens" if counts_only else "ids"])

    return df.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, " + ("n_tokens bigint" if counts_only else "ids array<int>"))
