"""Token ids of a whole corpus: every distinct word is encoded once and its ids are joined back."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.session import written

#: The published word pattern of the byte-level vocabularies, and the white space of Unicode.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

#: Words of one block at most; a longer single text is a block of its own.
BLOCK_WORDS = 2_000_000

_BLOCKS = "block bigint, doc_id bigint, codes array<int>, word string, code int"


def words_of(text: Column) -> Column:
    """The words of a text in order, so that they join to the text again."""
    pattern = PATTERN.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _split_again(texts: pa.Array) -> list[list[str]]:
    """The words of texts with characters that the JVM's Unicode tables do not know yet."""
    import regex

    pattern = regex.compile(PATTERN)
    return [pattern.findall(x) for x in texts.to_pylist()]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as lists of codes, then the words that the codes stand for, block by block."""
    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("codes", pa.list_(pa.int32())), ("word", pa.string()), ("code", pa.int32())])
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        words = batch.column("words")
        strange = batch.column("strange")
        if pc.any(strange).as_py():
            lists = words.to_pylist()
            for i, again in zip(np.flatnonzero(strange), _split_again(batch.column("text").filter(strange)), strict=True):
                lists[i] = again
            words = pa.array(lists, pa.list_(pa.string()))
        ends = np.asarray(words.offsets)[1:]
        start = 0
        while start < len(words):
            low = int(words.offsets[start].as_py())
            stop = max(start + 1, int(np.searchsorted(ends, low + BLOCK_WORDS, "right")))
            part = words.slice(start, stop - start)
            coded = part.flatten().dictionary_encode()
            offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(part).fill_null(0))]).astype(np.int32)
            codes = pa.ListArray.from_arrays(pa.array(offsets), coded.indices.cast(pa.int32()))
            n, m = len(part), len(coded.dictionary)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block)), batch.column("doc_id").slice(start, n), codes, pa.nulls(n, pa.string()), pa.nulls(n, pa.int32())], schema=schema
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, block)), pa.nulls(m, pa.int64()), pa.nulls(m, schema.field("codes").type), coded.dictionary.cast(pa.string()), pa.array(np.arange(m, dtype=np.int32))], schema=schema
            )
            block, start = block + 1, stop


_CODERS: dict[bytes, object] = {}


def _coder(ranks: bytes):
    """The tokenizer of a rank file, built once in each Python worker."""
    import hashlib

    import tiktoken

    key = hashlib.sha1(ranks).digest()
    if key not in _CODERS:
        pairs = (line.split() for line in ranks.splitlines() if line)
        _CODERS[key] = tiktoken.Encoding(
            "ranks", pat_str=PATTERN, mergeable_ranks={base64.b64decode(t): int(r) for t, r in pairs}, special_tokens={}
        )
    return _CODERS[key]


def _assemble(docs: pa.Table, words: pa.Table) -> pa.Table:
    """The ids of a block's documents, from the ids of its words."""
    order = np.argsort(words.column("code").to_numpy())
    ids = words.column("ids").combine_chunks().take(pa.array(order)) if len(order) else pa.array([], pa.list_(pa.int32()))
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    first = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))]).astype(np.int64)
    codes = docs.column("codes").combine_chunks()
    if isinstance(codes, pa.ChunkedArray):
        codes = codes.combine_chunks()
    code = codes.flatten().to_numpy(zero_copy_only=False)
    sizes = (first[1:] - first[:-1])[code] if len(code) else np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    taken = flat[np.repeat(first[code] - (ends - sizes), sizes) + np.arange(total)] if total else np.zeros(0, np.int32)
    word_ends = np.concatenate([[0], np.cumsum(pc.list_value_length(codes).to_numpy(zero_copy_only=False))]).astype(np.int64)
    offsets = np.concatenate([[0], ends])[word_ends].astype(np.int32)
    out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(taken.astype(np.int32)))
    return pa.table({"doc_id": docs.column("doc_id"), "ids": out})


def rank_file(path: str) -> bytes:
    """The contents of a rank file (about 0.8 MB, of a fixed size for a vocabulary)."""
    with open(path, "rb") as f:
        return f.read()


def encode_corpus(documents: DataFrame, ranks: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The token ids of every text: ``(doc_id, ids)``, without special tokens.

    Texts are split into words in the JVM; a block of texts keeps its words in order as codes of the block's distinct
    words, so that only distinct words are shuffled, not every position. Each word that is distinct over the whole
    corpus is encoded once, its ids join back to the blocks that have it, and a block's texts are put together again
    from its codes. A frequent word has a row for each block, not for each place, so no key is hot in proportion to the
    text; a block has ``BLOCK_WORDS`` words at most, unless one text alone has more.

    A null or empty text gives an empty list, a null id stays null, repeated rows come out as often as they go in. Text
    that looks like a special token is ordinary text. Extra columns are ignored. An empty table gives no rows.
    """
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(ranks)
    strange = F.coalesce(F.col(text).rlike(r"\p{Cn}"), F.lit(False))
    split = documents.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), words_of(F.col(text)).alias("words"), strange.alias("strange"),
        F.when(strange, F.col(text)).alias("text"),
    )
    blocks = written(split.mapInArrow(_blocks, _BLOCKS), "token-blocks")
    words = blocks.where("word IS NOT NULL").select("block", "code", "word")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(sent.value)
        for batch in batches:
            ids = pa.array([coder.encode_ordinary(w) for w in batch.column("word").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("word"), ids], ["word", "ids"])

    known = words.select("word").distinct().mapInArrow(encode, "word string, ids array<int>")
    coded = words.join(known, "word").select(F.col("block").alias("of_block"), "code", "ids")
    docs = blocks.where("codes IS NOT NULL").select("block", "doc_id", "codes")
    return (
        docs.groupBy("block").cogroup(coded.groupBy("of_block")).applyInArrow(_assemble, "doc_id bigint, ids array<int>")
    )


def token_table(ranks: bytes) -> pa.Array:
    """The bytes of each token, at the place of its id; null where no token has the id."""
    pairs = [line.split() for line in ranks.splitlines() if line]
    ids = np.array([int(r) for _, r in pairs])
    table = np.full(ids.max(initial=-1) + 1, None, object)
    table[ids] = [base64.b64decode(t) for t, _ in pairs]
    return pa.array(table, pa.binary())


def decode_ids(encoded: DataFrame, ranks: bytes, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """The texts of id lists: ``(doc_id, text)``, by a join of every position with the token table.

    The table has the fixed size of the vocabulary and is sent to every task, where a batch of lists takes its bytes from
    it at once; nothing is shuffled. An empty or null list gives an empty text; an id that the vocabulary lacks gives
    nothing in its place, bytes that are no text a replacement character. Repeated rows and null keys come out as often.
    """
    sent = encoded.sparkSession.sparkContext.broadcast(token_table(ranks))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            lists = batch.column("ids")
            flat = lists.flatten()
            known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(table)))
            pieces = pc.fill_null(table.take(pc.if_else(known, flat, None)), b"")
            ends = np.cumsum(pc.list_value_length(lists).to_numpy())
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pieces), b"")
            texts = [x.decode("utf-8", "replace") for x in joined.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    empty = F.array().cast("array<int>")
    listed = encoded.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.filter(ids, lambda x: x.isNotNull()), empty).alias("ids"))
    return listed.mapInArrow(decode, "doc_id bigint, text string")
